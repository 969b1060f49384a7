"""Toxic spans by a linear-chain conditional random field with two states, clean and toxic.

Documents are labelled, tokens are not: a token of a toxic training document counts as toxic if its word or the word's
beginning is significantly tied to toxic documents. The field is fitted to those token labels with hashed features
of the word, its beginnings and its neighbours. Forward-backward marginals give every token's probability; a document's
score is a calibrated sum of its tokens' evidence, its spans are the runs of tokens that are likelier toxic than not.

The chain is evaluated over the tokens of a whole batch at once: a text's first token resets the state, and 2x2
transfer matrices are multiplied down columns of equal length, side by side.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import fold, windows
from .words import SPACES, Words, grams, mix

#: The labelled rows that the field is fitted on: at most so many of each label. Of a text of more than WINDOWS times WINDOW characters,
#: so many windows of that length, spread evenly from its beginning to its end.
SAMPLE_OF_EACH = 1500
WINDOWS, WINDOW = 10, 1000
_PART = 200
_BITS = 18
_COLUMN = 256
_PREFIXES = (4, 5, 6, 7, 8)
_FLOOR = 0.05
_SEPARATORS = SPACES.copy()
_SEPARATORS[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


class Tokens:
    """Tokens of texts with their hashed features; a feature that a token lacks has the index 0, whose weight stays 0."""

    def __init__(self, texts):
        self.words = Words(texts, lower=True, separators=_SEPARATORS)
        w, n = self.words, len(self.words)
        word, *starts = w.hashes(w.end, *(np.minimum(w.start + k, w.end) for k in _PREFIXES))
        length = w.end - w.start
        self.reset = np.zeros(n, bool)
        self.reset[w.first[:-1][w.counts() > 0]] = True
        slots = [word, *(np.where(length > k, mix(s + np.uint64(k)), np.uint64(0)) for k, s in zip(_PREFIXES, starts))]
        near = np.zeros((2, n), np.uint64)
        near[0, 1:] = np.where(self.reset[1:], np.uint64(0), mix(word[:-1] + np.uint64(101)))
        near[1, :-1] = np.where(self.reset[1:], np.uint64(0), mix(word[1:] + np.uint64(102)))
        self.keys = slots
        self.index = np.stack([(x >> np.uint64(64 - _BITS)).astype(np.int32) for x in (*slots, *near)])


def _scan(m: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Row vector (1, 1) times the product of the matrices up to each position, scaled to sum 1. m: m00, m01, m10, m11."""
    n = len(m[0])
    columns = -(-n // _COLUMN)
    pad = columns * _COLUMN - n
    a, b, c, d = (np.concatenate([x, np.full(pad, 0.5)]).reshape(columns, _COLUMN).T.copy() for x in m)
    one, zero = np.ones(columns), np.zeros(columns)
    p, q, r, s = one, zero, zero, one
    for t in range(_COLUMN):
        p, q, r, s = p * a[t] + q * c[t], p * b[t] + q * d[t], r * a[t] + s * c[t], r * b[t] + s * d[t]
        z = p + q + r + s
        p, q, r, s = p / z, q / z, r / z, s / z
    into = np.empty((2, columns))
    x, y = 0.5, 0.5
    for k, (p_, q_, r_, s_) in enumerate(zip(p.tolist(), q.tolist(), r.tolist(), s.tolist())):
        into[0, k], into[1, k] = x, y
        x, y = x * p_ + y * r_, x * q_ + y * s_
        z = x + y
        x, y = x / z, y / z
    out = np.empty((2, _COLUMN, columns))
    x, y = into
    for t in range(_COLUMN):
        x, y = x * a[t] + y * c[t], x * b[t] + y * d[t]
        z = x + y
        x, y = x / z, y / z
        out[0, t], out[1, t] = x, y
    return out[0].T.ravel()[:n], out[1].T.ravel()[:n]


class Field:
    def __init__(self):
        self.weights = np.zeros(1 << _BITS)
        self.move = np.log(np.array([[0.95, 0.05], [0.5, 0.5]]))
        self.start = np.log(np.array([0.95, 0.05]))
        self.scale = np.array([1.0, -2.0])

    def _matrices(self, x: Tokens) -> list[np.ndarray]:
        e = np.exp(np.clip(self.weights[x.index].sum(axis=0), -30, 30))
        t, s = np.exp(self.move), np.exp(self.start)
        return [np.where(x.reset, s[j], t[i, j]) * (e if j else 1.0) for i in (0, 1) for j in (0, 1)]

    def marginals(self, x: Tokens, pairs: bool = False):
        """The probability of the toxic state at each token; with ``pairs``, also those of each move and each start."""
        m = self._matrices(x)
        if not len(m[0]):
            return (np.zeros(0), np.zeros((2, 2)), np.zeros(2)) if pairs else np.zeros(0)
        forward = _scan(m)
        back = [y[::-1] for y in _scan([m[k][::-1] for k in (0, 2, 1, 3)])]
        after = [np.append(y[1:], 0.5) for y in back]
        zero, one = forward[0] * after[0], forward[1] * after[1]
        p = one / (zero + one)
        if not pairs:
            return p
        before = [np.concatenate([[0.5], y[:-1]]) for y in forward]
        joint = np.stack([before[i] * m[2 * i + j] * after[j] for i in (0, 1) for j in (0, 1)])
        joint = (joint / joint.sum(axis=0))[:, ~x.reset].sum(axis=1).reshape(2, 2)
        return p, joint, np.array([(1 - p)[x.reset].sum(), p[x.reset].sum()])

    def fit(self, parts: list[tuple[Tokens, np.ndarray]], rounds: int = 15, rate: float = 1.0, penalty: float = 1e-6) -> None:
        """Gradient ascent on the conditional likelihood over parts of the sample, with a step for each weight that shrinks
        as it is used."""
        moved, started, n = np.zeros((2, 2)), np.zeros(2), max(1, sum(len(y) for _, y in parts))
        for x, y in parts:
            inner, before = ~x.reset, np.concatenate([[0], y[:-1]])
            np.add.at(moved, (before[inner], y[inner]), 1)
            started += [(1 - y)[x.reset].sum(), y[x.reset].sum()]
        used = np.full(1 << _BITS, 1e-8)
        for _ in range(rounds):
            g, joint, begun = -penalty * n * self.weights, np.zeros((2, 2)), np.zeros(2)
            for x, y in parts:
                p, j, b = self.marginals(x, pairs=True)
                joint, begun = joint + j, begun + b
                for index in x.index:
                    g += np.bincount(index, y - p, 1 << _BITS)
            g[0] = 0
            used += g * g
            self.weights += rate * g / np.sqrt(used)
            self.move += 5 * (moved - joint) / n
            self.start += 5 * (started - begun) / max(1.0, started.sum())

    def evidence(self, x: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """Each token's probability, and each text's sum of -log(1 - p) over tokens with p of 0.05 or more."""
        p = self.marginals(x)
        each = np.where(p >= _FLOOR, -np.log1p(-np.minimum(p, 1 - 1e-9)), 0.0)
        total = np.concatenate([[0.0], np.cumsum(each)])
        return p, total[x.words.first[1:]] - total[x.words.first[:-1]]

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * np.log(evidence + 0.01) + self.scale[1], -30, 30)))

    def calibrate(self, evidence: np.ndarray, y: np.ndarray, share: float) -> None:
        """Logistic regression of the label on the log of the evidence, weighted to the share of toxic rows."""
        z = np.stack([np.log(evidence + 0.01), np.ones(len(y))])
        weight = np.where(y == 1, share / max(1, (y == 1).sum()), (1 - share) / max(1, (y == 0).sum())) * len(y)
        beta = np.zeros(2)
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(beta @ z, -30, 30)))
            h = (z * (weight * p * (1 - p))) @ z.T + 0.05 * np.eye(2)
            beta = beta + np.linalg.solve(h, z @ (weight * (y - p)) - 0.05 * beta)
        self.scale = np.array([max(beta[0], 0.0), beta[1]])


def token_labels(x: Tokens, toxic: np.ndarray) -> np.ndarray:
    """1 for tokens of toxic documents that hold a word, or the beginning of one, that such documents have significantly
    more often. Near copies, found by their smallest hash of three words, count once."""
    w, doc = x.words, x.words.doc()
    n = len(w.first) - 1
    hashes = w.hashes()[0]
    g = grams(hashes, 3)
    low = np.full(n, np.iinfo(np.uint64).max)
    np.minimum.at(low, doc[: len(g)], g)
    _, one = np.unique(low, return_index=True)
    counts = np.zeros(n, bool)
    counts[one] = True
    n1, n0 = (counts & toxic).sum(), (counts & ~toxic).sum()
    out = np.zeros(len(w), np.int64)
    for keys in x.keys:
        names, at = np.unique(keys, return_inverse=True)
        pairs = np.unique(at[counts[doc]].astype(np.int64) * n + doc[counts[doc]])
        yes = np.bincount(pairs // n, toxic[pairs % n], len(names))
        no = np.bincount(pairs // n, ~toxic[pairs % n], len(names))
        share = n1 / max(n1 + n0, 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            surprise = 2 * (np.where(yes > 0, yes * np.log(yes / ((yes + no) * share)), 0) + np.where(no > 0, no * np.log(no / ((yes + no) * (1 - share))), 0))
        strong = (surprise >= 25) & (yes / max(n1, 1) >= 6 * (no + 0.5) / max(n0, 1)) & (names != 0)
        out |= strong[at] & toxic[doc]
    return out


def fit(docs: DataFrame, labels: DataFrame, of_each: int = SAMPLE_OF_EACH) -> Field:
    """Fits the field on at most ``of_each`` rows of either label, those of the smallest hashed ids, without the rows whose
    crc32(doc_id) mod 4 is 2; long texts by their ``windows``. Of rows that repeat an id, the smallest text counts. Without
    toxic rows its scores are near 0."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), 4) != 2)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64("doc_id")
    ids = [known.where(F.col("toxic") == t).orderBy(order, "doc_id").limit(of_each) for t in (0, 1)]
    rows = docs.select("doc_id", "text").join(F.broadcast(ids[0].union(ids[1])), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    sample = rows.select("doc_id", F.concat_ws(" ", windows(F.col("text"), WINDOWS, WINDOW)).alias("text"), "toxic", F.lit(0).alias("one"))
    share = max(1, n.get(1, 0)) / max(1, n.get(0, 0) + n.get(1, 0))
    # The sample is bounded, so it is fitted in one task, which has more room than the driver.
    fitted = sample.groupBy("one").applyInArrow(_fitted(share), "weights binary, move array<double>, start array<double>, scale array<double>").first()
    field = Field()
    if fitted is not None:
        field.weights = np.frombuffer(fitted.weights, np.float32).astype(np.float64)
        field.move, field.start, field.scale = np.array(fitted.move).reshape(2, 2), np.array(fitted.start), np.array(fitted.scale)
    return field


def _fitted(share: float):
    def fitted(key, rows):
        rows = rows.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        field, texts, y = Field(), rows.column("text"), rows.column("toxic").to_numpy().astype(np.int64)
        whole = Tokens(texts)
        marks, first = token_labels(whole, y == 1), whole.words.first
        del whole
        parts = []
        for i in range(0, len(y), _PART):
            parts.append((Tokens(texts.slice(i, _PART)), marks[first[i] : first[min(i + _PART, len(y))]]))
            parts[-1][0].keys = ()
        if y.sum():
            field.fit(parts)
        field.calibrate(np.concatenate([field.evidence(x)[1] for x, _ in parts]), y, share)
        return pa.table([pa.array([field.weights.astype(np.float32).tobytes()], pa.binary()), *(pa.array([x.ravel().tolist()], pa.list_(pa.float64())) for x in (field.move, field.start, field.scale))], ["weights", "move", "start", "scale"])

    return fitted


_SPANS = pa.struct([("start", pa.int64()), ("end", pa.int64())])


def _apply(field: Field, carry: list[str]):
    def apply(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                x = Tokens(part.column("text"))
                p, evidence = field.evidence(x)
                w, hot = x.words, p >= 0.5
                edge = np.flatnonzero(hot & (np.concatenate([[True], ~hot[:-1]]) | x.reset)) if len(hot) else np.zeros(0, int)
                stop = np.flatnonzero(hot & np.append(~hot[1:] | x.reset[1:], True)) if len(hot) else edge
                doc = w.doc()[edge]
                per = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=part.num_rows))])
                spans = [{"start": int(a), "end": int(b)} for a, b in zip(w.start[edge] - w.offsets[doc], w.end[stop] - w.offsets[doc])]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carry), pa.array(field.score(evidence)), pa.ListArray.from_arrays(pa.array(per, pa.int32()), pa.array(spans, _SPANS))], [*carry, "score", "spans"])

    return apply


def tag(docs: DataFrame, field: Field, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of ``carry``, score (0 to 1) and spans (byte offsets of toxic passages) of every row.

    Texts of any length are scored whole. Null texts count as empty: no evidence, the lowest score. Rows are scored each for itself; only the text is read. An
    empty table gives an empty result; columns that aren't carried are ignored, whatever their names.
    """
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry) + ", score double, spans array<struct<start: long, end: long>>"
    columns = list(dict.fromkeys([*carry, "text"]))
    return docs.select(*columns).mapInArrow(_apply(field, list(carry)), schema)


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from ``threshold`` on) and spans of every row of ``docs``."""
    tagged = tag(docs, fit(docs, labels))
    return tagged.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "spans")
