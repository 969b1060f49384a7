"""A FHIR server as a Spark data source, and a writer to one.

    spark.dataSource.register(FhirSource)
    spark.read.format("fhir").option("url", ...).option("types", "Patient,Observation").load()

Each resource type (and block of patients, if given) is one partition, read page by page on an executor. Rows are
resource_type, id and resource (JSON text). A task that fails is run again by Spark; within a task, requests are repeated.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from base64 import b64encode
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

_RETRY = (429, 500, 502, 503, 504)


class Client:
    """Requests with none, basic, token or oauth2 authentication. ``send`` opens a request; tests give their own."""

    def __init__(self, options: dict, send=None):
        self.url = options["url"].rstrip("/")
        self.auth, self.options = options.get("auth", "none"), options
        self.retries, self.wait = int(options.get("maxRetries", 3)), float(options.get("retryWait", 1))
        self.send = send or (lambda r: urllib.request.urlopen(r, timeout=float(options.get("timeout", 60))))
        self._token, self._until = options.get("token"), 0.0

    def _header(self) -> dict[str, str]:
        head = {"Accept": "application/fhir+json", "Content-Type": "application/fhir+json"}
        if self.auth == "basic":
            head["Authorization"] = "Basic " + b64encode(f"{self.options['user']}:{self.options['password']}".encode()).decode()
        elif self.auth == "token":
            head["Authorization"] = f"Bearer {self._token}"
        elif self.auth == "oauth2":
            head["Authorization"] = f"Bearer {self._fetched()}"
        elif self.auth != "none":
            raise ValueError(f"unknown authentication {self.auth!r}")
        return head

    def _fetched(self) -> str:
        """The token, asked for again a minute before it ends; its address comes from the server's metadata if not given."""
        if not self._token or time.time() >= self._until:
            address = self.options.get("tokenUrl") or self._discovered()
            form = urllib.parse.urlencode({"grant_type": "client_credentials", "client_id": self.options["clientId"], "client_secret": self.options["clientSecret"]}).encode()
            with self.send(urllib.request.Request(address, data=form)) as answer:
                got = json.load(answer)
            self._token, self._until = got["access_token"], time.time() + float(got.get("expires_in", 3600)) - 60
        return self._token

    def _discovered(self) -> str:
        with self.send(urllib.request.Request(f"{self.url}/metadata", headers={"Accept": "application/fhir+json"})) as answer:
            rest = json.load(answer).get("rest", [{}])[0]
        for e in rest.get("security", {}).get("extension", []):
            for x in e.get("extension", []):
                if x.get("url") == "token":
                    return x["valueUri"]
        raise ValueError("the server's metadata name no token address")

    def call(self, method: str, path: str, body: str | None = None) -> dict:
        """JSON of an answer. Repeats on 429 (as long as the server says) and 5xx, and once after a refused token."""
        address, refused = path if path.startswith("http") else f"{self.url}/{path}", False
        for i in range(self.retries + 1):
            request = urllib.request.Request(address, data=body.encode() if body else None, headers=self._header(), method=method)
            try:
                with self.send(request) as answer:
                    text = answer.read()
                    return json.loads(text) if text else {}
            except urllib.error.HTTPError as e:
                if e.code == 401 and self.auth == "oauth2" and not refused:
                    refused, self._token = True, None
                    continue
                if e.code not in _RETRY or i == self.retries:
                    raise
                time.sleep(float(e.headers.get("Retry-After") or self.wait * 2**i))
        raise RuntimeError(f"no answer from {address}")

    def search(self, kind: str, parameters: dict[str, str], most: int | None = None, page: int = 100) -> Iterator[dict]:
        """Resources of a search, page after page by the server's next links, at most ``most``."""
        query = parameters | {"_count": str(min(page, most) if most else page)}
        path, n = f"{kind}?{urllib.parse.urlencode(query)}", 0
        while path and (most is None or n < most):
            bundle = self.call("GET", path)
            for e in bundle.get("entry", []):
                if most is not None and n >= most:
                    return
                if e.get("resource"):
                    n += 1
                    yield e["resource"]
            path = next((x["url"] for x in bundle.get("link", []) if x.get("relation") == "next"), None)

    def get(self, kind: str, id_: str) -> dict | None:
        """One resource by its id; None if there is none."""
        try:
            return self.call("GET", f"{kind}/{urllib.parse.quote(id_, safe='')}") or None
        except urllib.error.HTTPError as e:
            if e.code in (404, 410):
                return None
            raise


class _Part(InputPartition):
    """A search, or with ``ids`` single resources."""

    def __init__(self, kind: str, parameters: dict[str, str], ids: list[str] | None = None):
        self.kind, self.parameters, self.ids = kind, parameters, ids


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = {k.lower(): v for k, v in options.items()}
        self.kinds: set[str] | None = None
        self.ids: set[str] | None = None

    def pushFilters(self, filters: list[Filter]):
        """Takes over equality and membership of resource_type and id (if spark.sql.python.filterPushdown.enabled): other types aren't
        asked for, and resources of given ids are read one by one instead of page after page."""
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is None or f.attribute not in (("resource_type",), ("id",)):
                yield f
                continue
            name = "kinds" if f.attribute == ("resource_type",) else "ids"
            before = getattr(self, name)
            setattr(self, name, values if before is None else before & values)

    def _client(self) -> Client:
        names = ("url", "auth", "user", "password", "token", "tokenUrl", "clientId", "clientSecret", "maxRetries", "retryWait", "timeout")
        return Client({n: self.options[n.lower()] for n in names if n.lower() in self.options})

    def partitions(self) -> list[InputPartition]:
        kinds = [k.strip() for k in self.options.get("types", "Patient").split(",")]
        if self.options.get("mode") != "everything":
            kinds = [k for k in kinds if self.kinds is None or k in self.kinds]
        patients = [p.strip() for p in self.options.get("patients", "").split(",") if p.strip()]
        size = int(self.options.get("patientsperpartition", 50))
        if self.ids is not None and not patients:
            ids = sorted(self.ids)
            return [_Part(k, {}, ids[i : i + size]) for k in kinds for i in range(0, len(ids), size)]
        if not patients:
            return [_Part(k, {}) for k in kinds]
        if self.options.get("mode") == "everything":
            return [_Part(f"Patient/{p}/$everything", {}) for p in patients]
        blocks = [patients[i : i + size] for i in range(0, len(patients), size)]
        return [_Part(k, {"_id" if k == "Patient" else "patient": ",".join(b)}) for k in kinds for b in blocks]

    def read(self, partition: _Part) -> Iterator[tuple]:
        most = self.options.get("maxcount")
        client = self._client()
        if partition.ids is not None:
            found = filter(None, (client.get(partition.kind, i) for i in partition.ids))
        else:
            found = client.search(partition.kind, partition.parameters, int(most) if most else None, int(self.options.get("pagesize", 100)))
        for r in found:
            kind, id_ = r.get("resourceType"), r.get("id")
            if (self.kinds is None or kind in self.kinds) and (self.ids is None or id_ in self.ids):
                yield kind, id_, json.dumps(r)


class FhirSource(DataSource):
    """Options: url, types, patients, mode (everything), maxCount, pageSize, patientsPerPartition, and those of Client."""

    @classmethod
    def name(cls) -> str:
        return "fhir"

    def schema(self) -> str:
        return "resource_type string, id string, resource string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def send(resources: DataFrame, options: dict, method: str = "PUT") -> DataFrame:
    """Creates (POST), updates (PUT) or deletes (DELETE) resources, one request a row, from the executors. Returns
    resource_type, id, and status: ok, or the error."""

    def run(rows: Iterator[Row]) -> Iterator[tuple]:
        client = Client(options)
        for r in rows:
            path = r.resource_type if method == "POST" else f"{r.resource_type}/{r.id}"
            try:
                client.call(method, path, None if method == "DELETE" else r.resource)
                yield r.resource_type, r.id, "ok"
            except (urllib.error.URLError, ValueError) as e:
                yield r.resource_type, r.id, str(e)

    def batches(parts):
        import pandas as pd

        for part in parts:
            yield pd.DataFrame(list(run(part.itertuples(index=False))), columns=["resource_type", "id", "status"])

    return resources.select("resource_type", "id", "resource").mapInPandas(batches, "resource_type string, id string, status string")
