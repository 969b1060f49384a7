"""Quality classifier: perplexity under an interpolated modified Kneser-Ney trigram model of trusted text.

All trusted texts of the model's half are counted. A word's probability needs the counts of its trigram, its last two words and its context,
all of which hold the word before it: texts go as packed numbers of words to shards by that word, where the trusted ones of them are
counted, and the others' losses looked up and sent back by document. Texts are judged a third at a time, and what a third has shuffled is removed
before the next, so that not all words' messages are on disk at once. Only the vocabulary of the trusted texts is held whole. A document's loss
per word is shrunk towards its language's mean, so that very short texts aren't judged by a word or two, and compared with a quantile of trusted documents of its language that the model was
not fitted on: trusted ids are split by hash, one half for the model, the other for means and quantiles. The fewer of these a language
has, the less its own quantile counts against where one is expected by their mean and spread.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import checkpointed, chunks_of, tidied
from .words import SPACES, Words, mix, pack, unpack, utf8

#: Bytes of text that go to a shard together, and those of a shard.
SLICE, SHARD = 2 << 20, 32 << 20
#: Parts of the texts that are judged one after another: the larger, the less disk at once, but the trusted texts go to the shards for each.
PARTS = 3
#: Ids up to which a list of them is broadcast.
IDS = 1 << 22
#: The unit of losses (shares are no more precise), which are whole numbers until they are summed, so that the sum doesn't depend on its order.
UNIT = 2.0**24
#: Words' worth of the language's mean that a document's loss is mixed with.
PRIOR_WORDS = 20.0
#: Rows' worth of all languages' spread that a language's spread is mixed with.
PRIOR_ROWS = 10.0
_END, _START = np.uint64(0xE4D), np.uint64(0x57A)
_SEPARATORS = SPACES.copy()
_SEPARATORS[[ord(c) for c in ".,;:!?"]] = True


class Table:
    """A hashed table from 64-bit keys to numbers, 0 for other keys. It travels as its entries and is built where it arrives."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.entries = keys, values
        self._build(keys, values)

    def __getstate__(self):
        return self.entries

    def __setstate__(self, entries):
        self.__init__(*entries)

    def _build(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = np.uint64(64 - max(4, int(len(keys) * 3).bit_length()))
        size = 1 << (64 - int(self.bits))
        self.keys, self.values = np.zeros(size, np.uint64), np.zeros(size, values.dtype)
        keys, at, self.probes = keys | np.uint64(1), (keys >> self.bits).astype(np.int64), 1
        while len(keys):
            free = np.flatnonzero(self.keys[at] == 0)
            _, one = np.unique(at[free], return_index=True)
            put = free[one]
            self.keys[at[put]], self.values[at[put]] = keys[put], values[put]
            rest = np.ones(len(keys), bool)
            rest[put] = False
            keys, values, at = keys[rest], values[rest], (at[rest] + 1) & (size - 1)
            self.probes += 1

    def get(self, keys: np.ndarray) -> np.ndarray:
        at, keys = (keys >> self.bits).astype(np.int64), keys | np.uint64(1)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], self.values.dtype.type(0))
        todo = np.flatnonzero((found != keys) & (found != 0))
        for _ in range(self.probes):
            if not len(todo):
                break
            at[todo] = (at[todo] + 1) & (len(self.keys) - 1)
            found = self.keys[at[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[~hit & (found != 0)]
        return out


def tokens(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words and one end of each text, the keys of the two and the three words up to each, and where each text begins."""
    w = Words(texts, lower=True, separators=_SEPARATORS)
    one = np.insert(w.hashes()[0], w.first[1:], _END)
    first = w.first + np.arange(len(w.first))
    back = [np.concatenate([np.full(k, _START), one[:-k]])[: len(one)] for k in (1, 2)]
    for k, b in zip((1, 2), back):
        for i in range(k):
            at = first[:-1] + i
            b[at[at < first[1:]]] = _START
    two = mix(back[0] * np.uint64(3) + one)
    return one, two, mix(mix(back[1] * np.uint64(3) + back[0]) * np.uint64(5) + two), first


def counts(texts, begins: np.ndarray | None = None, ends: np.ndarray | None = None) -> pa.Table:
    """Distinct trigrams (keys): how often (n), their last two words (pair), the last (word), the first two (of3) and the middle one (of2).
    Where ``begins`` or ``ends`` is false a text is a piece that goes on there: no trigram with a start or an end is counted."""
    one, two, three, first = tokens(texts)
    counted = np.ones(len(one), bool)
    if begins is not None:
        counted[first[1:][~ends] - 1] = False
        for i in (0, 1):
            at = first[:-1][~begins] + i
            counted[at[at < first[1:][~begins]]] = False
    of = []
    for x in (one, two):
        y = np.concatenate([[_START], x[:-1]])[: len(x)]
        y[first[:-1]] = _START
        of.append(y)
    places = np.flatnonzero(counted)
    keys, at, n = np.unique(three[places], return_index=True, return_counts=True)
    at = places[at]
    return pa.table([pa.array(x.astype(np.int64)) for x in (keys, n, two[at], one[at], of[1][at], of[0][at])], COUNTED)


COUNTED = ["keys", "n", "pair", "word", "of3", "of2"]


class Model:
    def __init__(self, texts=(), counted: pa.Table | None = None):
        """A model of ``texts``, or of trigrams counted already."""
        counted = counts(pa.array(texts) if isinstance(texts, (list, tuple)) else texts) if counted is None else counted
        keys, n, pair, word, of3, of2 = (counted.column(c).to_numpy().view(np.uint64) for c in COUNTED)
        self.shards = [self._order(keys, n.astype(np.int64), of3)]
        pairs, at, types = np.unique(pair, return_index=True, return_counts=True)
        self.shards.append(self._order(pairs, types, of2[at]))
        words, types = np.unique(word[at], return_counts=True)
        total = max(1, types.sum())
        d = self._discounts(types)[np.minimum(types, 3)]
        self.unseen = float(d.sum() / total / (len(words) + 1)) if len(words) else 1.0
        self.words = Table(words, ((types - d) / total).astype(np.float32))

    @staticmethod
    def _discounts(counts: np.ndarray) -> np.ndarray:
        return Model.discounts([(counts == k).sum() for k in (1, 2, 3, 4)])

    @staticmethod
    def discounts(n: list[int]) -> np.ndarray:
        """What is taken off counts of 0 to 3 and more, given how many are 1 to 4."""
        if not n[0] or not n[1]:
            return np.array([0, 0.5, 0.75, 0.75])
        y = n[0] / (n[0] + 2 * n[1])
        return np.array([0.0, *(np.clip(k - (k + 1) * y * n[k] / max(1, n[k - 1]), 0.05, k - 0.05) for k in (1, 2, 3))])

    @staticmethod
    def _order(keys, counts, context, discounts: np.ndarray | None = None) -> tuple[Table, Table]:
        """Discounted shares by key, and what is left for the shorter context by context."""
        names, at = np.unique(context, return_inverse=True)
        total = np.bincount(at, counts, len(names))
        d = (Model._discounts(counts) if discounts is None else discounts)[np.minimum(counts, 3)]
        return Table(keys, ((counts - d) / total[at]).astype(np.float32)), Table(names, (np.bincount(at, d, len(names)) / total).astype(np.float32))

    def loss(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Words (with one end) and the sum of -ln p of each text."""
        one, two, three, first = tokens(texts)
        p = self.words.get(one).astype(np.float64) + self.unseen
        for (share, left), key, prior in zip(reversed(self.shards), (two, three), (one, two)):
            context = np.concatenate([[_START], prior[:-1]])[: len(prior)]
            context[first[:-1]] = _START
            rest = left.get(context)
            p = share.get(key) + np.where(rest > 0, rest, 1.0) * p
        total = np.concatenate([[0.0], np.cumsum(-np.log(p))])
        return np.diff(first), total[first[1:]] - total[first[:-1]]


def _for_cut(doc_id: str):
    """Trusted ids of this half are for means and quantiles, and never in the model."""
    return F.pmod(F.xxhash64(F.lit("cut"), doc_id), F.lit(2)) == 1


#: Numbers of words: of those that no trusted text has, of the start, and the first of the others, the most frequent one.
_UNKNOWN, _FIRST, _WORD = 0, 1, 2
_SENT = "shard int, kind int, batch long, tokens long, data binary"
#: Kinds of messages, in the order in which a shard takes them: trusted texts, texts to judge, whose texts these are.
_TEACH, _JUDGE, _HEAD = 0, 1, 2


def _slices(batches):
    """Rows of about ``SLICE`` bytes of text."""
    for batch in batches:
        begin, ends = 0, utf8(batch.column("text"))[1][1:]
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + SLICE)))
            yield batch.slice(begin, end - begin)
            begin = end


def _packed(*columns: np.ndarray) -> bytes:
    return pa.compress(b"".join(pack(c) for c in columns), codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int, *kinds) -> list[np.ndarray]:
    sizes = [n * np.dtype(k).itemsize for k in kinds]
    raw, at = pa.decompress(data, sum(sizes), codec="zstd", asbytes=True), np.cumsum([0, *sizes])
    return [unpack(raw[i:j], k) for i, j, k in zip(at, at[1:], kinds)]


def _by_pair(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.argsort(v.astype(np.int64) << 32 | w, kind="stable")


def _message(v: np.ndarray, w: np.ndarray, *more: np.ndarray) -> bytes:
    """Columns of rows that ascend by v, then w: of these only the steps, which are small."""
    step = np.diff(v, prepend=0).astype(np.int32)
    return _packed(step, np.where(step == 0, np.diff(w, prepend=0), w).astype(np.int32), *(c.astype(np.int32) for c in more))


def _columns(data: bytes, n: int, more: int) -> list[np.ndarray]:
    """v, w and the ``more`` further columns of a message of ``n`` rows."""
    v, w, *others = _unpacked(data, n, *[np.int32] * (2 + more))
    begins = np.flatnonzero(v)
    if n and (not len(begins) or begins[0]):
        begins = np.concatenate([[0], begins])
    total = np.cumsum(w, dtype=np.int64)
    return [np.cumsum(v, dtype=np.int32), (total - np.repeat(total[begins] - w[begins], np.diff(begins, append=n))).astype(np.int32), *others]


def _seen(batches):
    for part in _slices(batches):
        words, n = np.unique(tokens(part.column("text"))[0], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], ["word", "n"])


def _sent(vocabulary, shards: int, shares=None):
    """Of each slice of texts a message to each shard: each word, the two before it and, of texts to judge (those with ``shares``), its text. Of
    these also one with the rows' doc_id, lang, numbers of words and sums for the words that need no shard."""

    def sent(batches):
        task = TaskContext.get().partitionId()
        for i, part in enumerate(_slices(batches)):
            one, _, _, first = tokens(part.column("text"))
            w, text = vocabulary.value.get(one), np.repeat(np.arange(len(first) - 1), np.diff(first))
            v = np.concatenate([[_FIRST], w[:-1]])[: len(w)].astype(np.int32)
            v[first[:-1]] = _FIRST
            u = np.concatenate([[_FIRST], v[:-1]])[: len(w)].astype(np.int32)
            u[first[:-1]] = _FIRST
            # After an unknown word nothing is looked up but the word itself.
            alone = v == _UNKNOWN
            shard = np.where(alone, shards, (mix(v.astype(np.uint64)) % np.uint64(shards)).astype(np.int64))
            order = _by_pair(v, w)
            order = order[np.argsort(shard[order], kind="stable")]
            ends = np.searchsorted(shard[order], np.arange(shards + 1))
            batch, out = (task << 33) + i, []
            for s in np.flatnonzero(np.diff(ends)):
                at = order[ends[s] : ends[s + 1]]
                more = (u[at], text[at]) if shares else (u[at],)
                out.append((int(s), _JUDGE if shares else _TEACH, batch, len(at), _message(v[at], w[at], *more)))
            if shares:
                own = np.zeros(part.num_rows, np.int64)
                np.add.at(own, text[alone], _units(shares.value[w[alone]]))
                head = pa.record_batch([part.column("doc_id"), part.column("lang"), pa.array(np.diff(first)), pa.array(own)], ["doc_id", "lang", "n", "own"])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, head.schema) as stream:
                    stream.write_batch(head)
                out.append((batch % shards, _HEAD, batch, 0, sink.getvalue().to_pybytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], ["shard", "kind", "batch", "tokens", "data"])

    return sent


def _units(p: np.ndarray) -> np.ndarray:
    return np.rint(-np.log(p) * UNIT).astype(np.int64)


def _keys(u: np.ndarray, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of trigrams: their keys, those of their last two words, of the first two, and of the middle one."""
    u, v, w = (x.astype(np.uint64) for x in (u, v, w))
    two = lambda a, b: mix(a << np.uint64(32) | b)
    return mix(two(u, v) * np.uint64(3) + mix(w)), two(v, w), two(u, v), mix(v)


def _counts_of(messages) -> tuple[np.ndarray, ...]:
    """Distinct trigrams of (tokens, data): how often, and u, v, w."""
    v, w, u = (np.concatenate(c) for c in zip(*(_columns(data, n, 1) for n, data in messages)))
    _, at, n = np.unique(_keys(u, v, w)[0], return_index=True, return_counts=True)
    return n, u[at], v[at], w[at]


def _summary(table: pa.Table) -> pa.Table:
    """Of a shard's trusted texts: how many trigrams (level 3) and pairs of words (2) have the count ``key``, 5 standing for more, and after how
    many different words each word (1) comes."""
    n, _, v, w = _counts_of(zip(table.column("tokens").to_pylist(), table.column("data").to_pylist()))
    _, at, types = np.unique(_keys(v, v, w)[1], return_index=True, return_counts=True)
    out = [np.unique(x, return_counts=True) for x in (w[at], np.minimum(types, 5), np.minimum(n, 5))]
    level = np.repeat([1, 2, 3], [len(k) for k, _ in out])
    return pa.table([pa.array(x.astype(np.int64)) for x in (level, np.concatenate([k for k, _ in out]), np.concatenate([c for _, c in out]))], ["level", "key", "n"])


def _small(ids: DataFrame) -> DataFrame:
    """Broadcast if they are at most ``IDS``, so that texts stay where they are; of more Spark joins as it does."""
    return F.broadcast(ids) if ids.limit(IDS + 1).count() <= IDS else ids


def _once(rows: DataFrame) -> DataFrame:
    """The texts of ``rows``, of an id that repeats the smallest. Only the texts of such ids are shuffled."""
    again = _small(rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    least = rows.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    return rows.join(again, "doc_id", "left_anti").select("text").unionAll(least.select("text"))


class Fitted:
    """A model whose counts are in the messages ``taught``; words' numbers and shares and the discounts are here."""

    def __init__(self, taught: DataFrame, vocabulary, words: int, shards: int):
        self.taught, self.vocabulary, self.shards = taught, vocabulary, shards
        rows = taught.groupBy("shard").applyInArrow(_summary, "level long, key long, n long").groupBy("level", "key").agg(F.sum("n").alias("n")).toArrow()
        level, key, n = (rows.column(c).to_numpy() for c in ("level", "key", "n"))
        self.discounts = [Model.discounts([int(n[(level == k) & (key == i)].sum()) for i in (1, 2, 3, 4)]) for k in (3, 2)]
        types = np.zeros(words + _WORD, np.int64)
        types[key[level == 1]] = n[level == 1]
        total = max(1, types.sum())
        d = np.where(types > 0, Model._discounts(types[types > 0])[np.minimum(types, 3)], 0.0)
        self.unseen = float(d.sum() / total / (words + 1)) if words else 1.0
        self.shares = (types - d) / total + self.unseen


def fit(docs: DataFrame, labels: DataFrame, shards: int | None = None) -> Fitted:
    """A model of all trusted texts (quality 1) of the model's half, whole. Of rows that repeat an id, the smallest text counts."""
    shards = shards or chunks_of(docs, SHARD)
    trusted = labels.where("quality = 1 AND doc_id IS NOT NULL").where(~_for_cut("doc_id")).select("doc_id").distinct()
    rows = _once(docs.select("doc_id", "text").join(_small(trusted), "doc_id", "left_semi"))
    seen = rows.mapInArrow(_seen, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    words, n = seen.column("word").to_numpy().view(np.uint64), seen.column("n").to_numpy()
    order = np.lexsort((words, -n))
    vocabulary = docs.sparkSession.sparkContext.broadcast(Table(words[order], np.arange(_WORD, len(words) + _WORD, dtype=np.int32)))
    return Fitted(rows.mapInArrow(_sent(vocabulary, shards), _SENT), vocabulary, len(words), shards)


def _answers(shares, discounts):
    """Of each message of texts to judge the texts' sums of -ln p, in parts of ``UNIT``, under the counts of the trusted ones of its shard."""

    def answer(model, n: int, data: bytes) -> tuple[int, bytes]:
        v, w, u, text = _columns(data, n, 2)
        p = shares.value[w]
        if model:
            three, two, of3, of2 = _keys(u, v, w)
            for (share, left), key, context in zip(reversed(model), (two, three), (of2, of3)):
                rest = left.get(context)
                p = share.get(key) + np.where(rest > 0, rest, 1.0) * p
        texts, at = np.unique(text, return_inverse=True)
        sums = np.zeros(len(texts), np.int64)
        np.add.at(sums, at, _units(p))
        return len(texts), _packed(np.diff(texts, prepend=0).astype(np.uint32), sums)

    def model_of(messages):
        if not messages:
            return None
        n, u, v, w = _counts_of(messages)
        three, two, of3, of2 = _keys(u, v, w)
        pairs, at, types = np.unique(two, return_index=True, return_counts=True)
        return [Model._order(three, n, of3, discounts[0]), Model._order(pairs, types, of2[at], discounts[1])]

    def answers(batches):
        shard, taught, model = None, [], None
        for batch in batches:
            out = []
            for s, kind, number, n, data in zip(*(batch.column(c).to_pylist() for c in ("shard", "kind", "batch", "tokens", "data"))):
                if s != shard:
                    shard, taught, model = s, [], None
                if kind == _TEACH:
                    taught.append((n, data))
                    continue
                if taught:
                    model, taught = model_of(taught), []
                out.append((number, kind, *(answer(model, n, data) if kind == _JUDGE else (0, data))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.binary()))], ["batch", "kind", "n", "data"])

    return answers


def _summed(table: pa.Table) -> pa.Table:
    rows = list(zip(*(table.column(c).to_pylist() for c in ("kind", "n", "data"))))
    head = pa.ipc.open_stream(next(data for kind, _, data in rows if kind == _HEAD)).read_all()
    loss = head.column("own").to_numpy().copy()
    for kind, n, data in rows:
        if kind == _JUDGE:
            step, sums = _unpacked(data, n, np.uint32, np.int64)
            loss[np.cumsum(step, dtype=np.int64)] += sums
    return head.drop_columns("own").append_column("loss", pa.array(loss / UNIT))


def losses(docs: DataFrame, model: Fitted, parts: int = PARTS) -> DataFrame:
    """doc_id, lang, n (words and one end) and loss (the sum of -ln p) of each row of ``docs``, materialised part by part."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    shares = docs.sparkSession.sparkContext.broadcast(model.shares)
    done = []
    with tidied(docs.sparkSession):
        for k in range(parts):
            part = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)) == k)
            sent = model.taught.unionAll(part.mapInArrow(_sent(model.vocabulary, model.shards, shares), _SENT))
            dealt = sent.repartition(model.shards, "shard").sortWithinPartitions("shard", "kind")
            answers = dealt.mapInArrow(_answers(shares, model.discounts), "batch long, kind int, n long, data binary")
            done.append(checkpointed(answers.groupBy("batch").applyInArrow(_summed, "doc_id long, lang string, n long, loss double")))
    return functools.reduce(DataFrame.unionAll, done)


def _cuts(trusted: DataFrame, quantile: float) -> DataFrame:
    """of (a language) and cut. Of n trusted rows n * (1 - quantile) are expected beyond the quantile, and its own counts so much against one
    row's worth of where a further row's is expected: mean and spread as measured in n rows (the factors of a prediction
    interval, Student's t to its first order), and all languages' quantile of the deviations by spread."""
    each = trusted.groupBy("lang").agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"), F.percentile_approx("x", quantile, 100_000).alias("own")).withColumnRenamed("lang", "of")
    pooled = each.agg((F.sum(F.col("n") * F.col("v")) / F.sum("n")).alias("v")).first()["v"] or 0.0
    spread = F.sqrt((F.col("n") * F.col("v") + PRIOR_ROWS * pooled) / (F.col("n") + PRIOR_ROWS))
    each = each.withColumn("s", spread)
    apart = F.coalesce((F.col("x") - F.col("m")) / F.nullif(F.col("s"), F.lit(0.0)), F.lit(0.0))
    z = trusted.join(each, F.col("lang").eqNullSafe(F.col("of"))).agg(F.percentile_approx(apart, quantile, 100_000).alias("z")).first()["z"] or 0.0
    wide = F.col("m") + z * F.col("s") * F.sqrt(1 + 1 / F.col("n")) * (1 + (z * z + 1) / (4 * (F.col("n") + PRIOR_ROWS - 1)))
    tail = F.col("n") * (1 - quantile)
    return each.select("of", ((tail * F.col("own") + wide) / (tail + 1)).alias("cut"))


def score(docs: DataFrame, labels: DataFrame, quantile: float = 0.995) -> DataFrame:
    """doc_id, lang, perplexity (of the shrunk loss), threshold and kept of every row of ``docs``.

    Texts of any length are judged whole. A loss equal to the threshold is kept. Further columns are ignored, whatever their names.
    Null texts count as empty, and are judged by their end alone. A null language is a language; one without trusted rows
    gets the threshold of all. Without trusted rows in the half for thresholds everything is kept. Repeated rows are each judged; an empty table
    gives an empty result.
    """
    with tidied(docs.sparkSession):
        each = losses(docs, fit(docs, labels))
        trusted = labels.where("quality = 1 AND doc_id IS NOT NULL").where(_for_cut("doc_id")).select(F.col("doc_id").alias("id")).distinct()
        each = checkpointed(each.join(trusted, F.col("doc_id") == F.col("id"), "left").select("doc_id", "lang", "n", "loss", F.col("id").isNotNull().alias("trusted")))
        means = each.where("trusted").groupBy("lang").agg((F.sum("loss") / F.sum("n")).alias("mean")).withColumnRenamed("lang", "of")
        overall = each.where("trusted").agg((F.sum("loss") / F.sum("n")).alias("mean")).first()["mean"] or 0.0
        mean = F.coalesce("mean", F.lit(overall))
        shrunk = checkpointed(each.join(means, F.col("lang").eqNullSafe(F.col("of")), "left").select("doc_id", "lang", "trusted", ((F.col("loss") + PRIOR_WORDS * mean) / (F.col("n") + PRIOR_WORDS)).alias("x")))
        cuts = _cuts(shrunk.where("trusted"), quantile)
        every = shrunk.where("trusted").agg(F.percentile_approx("x", quantile, 100_000).alias("cut")).first()["cut"]
    cut = F.coalesce("cut", F.lit(every).cast("double"))
    judged = shrunk.join(cuts, F.col("lang").eqNullSafe(F.col("of")), "left")
    return judged.select("doc_id", "lang", F.exp("x").alias("perplexity"), F.exp(cut).alias("threshold"), F.coalesce(F.col("x") <= cut, F.lit(True)).alias("kept"))


def filtered(docs: DataFrame, labels: DataFrame, quantile: float = 0.995) -> DataFrame:
    """``score``, only the rows kept."""
    return score(docs, labels, quantile).where("kept")
