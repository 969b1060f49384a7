"""Hierarchical Pitman-Yor language model over words, trained and applied in one pass over chunks and shards.

Every word (and one end mark per text) is a customer in the restaurant of the word before it; all those restaurants
share one parent, the root, whose customers are their tables and whose base measure is uniform over the vocabulary
and one unknown type. Chunks of texts send their distinct words and word pairs, as packed sorted hashes, to shards;
a shard sums the counts of its keys, draws the seating of its restaurants by Gibbs sampling (in each sweep, all customers of a dish are
removed and seated again given the rest of the restaurant), averages the sweeps
and answers each chunk in the chunk's own key order. So the traffic is one packed entry for each distinct word or pair
of a chunk and grows in proportion to the corpus; a frequent word costs one entry per chunk, not one per occurrence.

The levels are coupled by two exchanges of one entry for each word of a shard. Shards send how many of their contexts have
a word; the root, seated from those, returns the words' prior, by which the contexts are sampled. The tables of each sweep
kept go back by word, and the root that scores is seated from them. Nothing of this depends on how texts are dealt
into chunks, but for the random draws. The shards' keys are read for each step and not kept in between.

The dishes of context restaurants are identified by 32-bit hashes of the context and of the word, the root's by 64 bits;
words of the root that share 32 bits divide their tables by their counts.
A context frequent enough to fill a shard is spread over several by word; each chunk asks all of them for its tables.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import chunked, chunks_of, fold
from .words import Words, mix, pack, pack_sorted, tidy, unpack, unpack_sorted

_END = np.uint64(0xE4D)
_PROBE = np.uint64(0xFFFFFFFF)
_LOW = np.uint64(0xFFFFFFFF)
#: Customers of a dish up to which its tables are drawn by their exact conditional, and dishes drawn at once.
_EXACT, _ROWS_AT_ONCE = 64, 20_000
_NAMES = "kind shard chunk head keys counts extra"
_ROWS = "kind int, shard int, chunk int, head binary, keys binary, counts binary, extra binary"
_ANSWERS = "kind int, shard int, chunk int, head binary, values binary, extra binary"
_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def seat(c: np.ndarray, new: np.ndarray, d: float, rng: np.random.Generator, t: np.ndarray | None = None, k: int = 1) -> np.ndarray:
    """Tables of dishes with ``c`` customers, seated one by one; ``new`` is the weight of a new table, with the
    dish's prior in it. Beyond 64 customers, runs that double in length are seated with the weights at their start. ``t``: the tables of
    the first ``k`` customers."""
    t = (c > 0).astype(np.float64) if t is None else t.copy()
    live = np.flatnonzero(c > k)
    while len(live):
        step = 1 if k < 64 else k
        take = np.minimum(step, c[live] - k)
        p = new[live] / (np.maximum(k - d * t[live], 0) + new[live])
        t[live] += rng.binomial(take.astype(np.int64), np.clip(p, 0, 1))
        k += step
        live = live[c[live] > k]
    return t


@cache
def stirling(d: float, most: int) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers of type (-1, -d, 0): in how many ways, by weight, n customers of a dish sit at t
    tables; row n, column t, up to ``most``."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[0, 0] = 0.0
    n = np.arange(most + 1)
    for i in range(most):
        stay = np.where((n >= 1) & (n <= i), out[i] + np.log(np.maximum(i - d * n, 1e-300)), -np.inf)
        out[i + 1, 1:] = np.logaddexp(out[i, :-1], stay[1:])
    return out


def reseated(c: np.ndarray, t: np.ndarray, rest: np.ndarray, prior: np.ndarray, d: float, theta: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes with ``c`` customers, drawn anew given ``rest``, the tables of the other dishes of the restaurant: all customers of a
    dish are removed and seated again, by the exact conditional up to ``_EXACT`` of them; the others follow as in ``seat``."""
    out, ways = np.minimum(c, 1).astype(np.float64), stirling(d, _EXACT)
    few = np.minimum(c, _EXACT).astype(np.int64)
    for n in np.unique(few[few > 1]):
        rows = np.flatnonzero(few == n)
        for i in range(0, len(rows), _ROWS_AT_ONCE):
            at = rows[i : i + _ROWS_AT_ONCE]
            gain = np.log(theta + d * (rest[at, None] + np.arange(n))) + np.log(prior[at, None])
            w = np.cumsum(gain, axis=1) + ways[n, 1 : n + 1]
            w = np.cumsum(np.exp(w - w.max(axis=1, keepdims=True)), axis=1)
            out[at] = 1 + (w < rng.random((len(at), 1)) * w[:, -1:]).sum(axis=1)
    many = np.flatnonzero(c > _EXACT)
    if len(many):
        out[many] = seat(c[many], (theta + d * (rest[many] + out[many])) * prior[many], d, rng, out[many], _EXACT)
    return out


def sampled(c, context, prior, d, theta, spread, sweeps, burn, seed):
    """Tables per dish in each of the sweeps after ``burn``. ``context``: the restaurant of each dish, from 0 on;
    ``spread``: in how many shards each restaurant is. A sweep takes the dishes in four random parts, each given all others."""
    rng = np.random.default_rng(seed)
    t = (c > 0).astype(np.float64)
    several = np.flatnonzero(c > 1)
    total = lambda: np.bincount(context, t, minlength=len(spread)) * spread
    prior = np.broadcast_to(prior, c.shape)
    t[several] = seat(c[several], ((theta + d * total()[context]) * prior)[several], d, rng)
    for i in range(sweeps):
        part = rng.integers(0, 4, len(several))
        for k in range(4):
            some = several[part == k]
            t[some] = reseated(c[some], t[some], total()[context[some]] - t[some], prior[some], d, theta, rng)
        if i >= burn:
            yield t.copy()


def gibbs(c, context, prior, d, theta, spread, sweeps, burn, seed) -> np.ndarray:
    """Mean tables per dish over the sweeps after ``burn``."""
    mean = np.zeros(len(c))
    for t in sampled(c, context, prior, d, theta, spread, sweeps, burn, seed):
        mean += t / (sweeps - burn)
    return mean


def seated_root(customers: np.ndarray, parts: int, d: float, theta: float, sweeps: int, burn: int, seed: int) -> np.ndarray:
    """Mean tables per word of a root shard, one of ``parts``: a new table weighs (theta + d * tables) / (words + 1), of which
    the shard takes its own words' and tables' part, as words are dealt by their hash."""
    words = np.count_nonzero(customers)
    return gibbs(customers, np.zeros(len(customers), np.int64), 1 / (words + 1 / parts), d, theta / parts, np.ones(1), sweeps, burn, seed)


def _cuts(low: np.ndarray, shards: int) -> np.ndarray:
    """Where each root shard begins among ascending lower halves of words."""
    return np.searchsorted(low * np.uint64(shards) >> np.uint64(32), np.arange(shards + 1))


class _Chunk:
    """Tokens, distinct words and distinct pairs of a chunk's texts, in an order that depends only on the texts."""

    def __init__(self, table: pa.Table, shards: int, hot: dict[int, int]):
        w = Words(table.column("text"), lower=True)
        self.n = w.counts() + 1
        self.first = np.concatenate([[0], np.cumsum(self.n)])
        tokens = np.insert(w.hashes()[0], w.first[1:], _END)
        train = np.repeat(table.column("fold").to_numpy() != 1, self.n)
        self.words, self.word = np.unique(tokens, return_inverse=True)
        self.counts = np.bincount(self.word, train, len(self.words)).astype(np.int64)
        before = np.empty_like(self.word)
        before[1:] = self.word[:-1]
        before[:1] = np.searchsorted(self.words, _END)
        self.before = before
        pairs, self.pair = np.unique(before * len(self.words) + self.word, return_inverse=True)
        self.u, self.w = pairs // len(self.words), pairs % len(self.words)
        self.pair_counts = np.bincount(self.pair, train, len(pairs)).astype(np.int64)
        self.high = mix(self.words) >> np.uint64(32)
        low = self.words & _LOW
        u, key = self.u, (self.high[self.u] << np.uint64(32)) | low[self.w]
        spread = np.array([hot.get(int(x), 1) for x in self.high], dtype=np.uint64)
        shard = (self.high[u] + mix(low[self.w]) % spread[u]) % np.uint64(shards)
        probes = [(i, j) for i in np.flatnonzero(spread > 1) for j in range(int(spread[i]))]
        if probes:
            i, j = np.array(probes, dtype=np.int64).T
            key = np.concatenate([key, (self.high[i] << np.uint64(32)) | _PROBE])
            shard = np.concatenate([shard, (self.high[i] + j.astype(np.uint64)) % np.uint64(shards)])
            u = np.concatenate([u, i])
        self.key, self.key_u = key, u
        self.order = np.lexsort((key, shard))
        self.cuts = np.searchsorted(shard[self.order], np.arange(shards + 1))
        #: The root's keys: words with the lower half first, as the pairs' keys have no more of a word.
        turned = self.words << np.uint64(32) | self.words >> np.uint64(32)
        self.word_order = np.argsort(turned)
        self.turned = turned[self.word_order]
        self.word_cuts = _cuts(self.turned >> np.uint64(32), shards)


def _gather(shards: int, hot: dict[int, int]):
    def gather(key, table):
        tidy()
        x, rows = _Chunk(table, shards, hot), []
        counts = np.zeros(len(x.key), np.int64)
        counts[: len(x.pair_counts)] = x.pair_counts
        for s in range(shards):
            a, b = x.word_cuts[s], x.word_cuts[s + 1]
            rows.append((0, s, key[0].as_py(), b"", pack_sorted(x.turned[a:b]), pack(x.counts[x.word_order[a:b]]), b""))
            i = x.order[x.cuts[s] : x.cuts[s + 1]]
            if len(i):
                rows.append((1, s, key[0].as_py(), b"", pack_sorted(x.key[i]), pack(counts[i]), b""))
        return _rows(rows, _NAMES)

    return gather


def _rows(rows: list[tuple], names: str) -> pa.Table:
    kinds = [pa.int32()] * 3 + [pa.binary()] * (len(names.split()) - 3)
    return pa.table([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [()] * len(kinds), kinds)], names.split())


def _sum(table: pa.Table) -> tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a shard's messages by sender: the senders, the distinct keys, the place of each message's keys among them, where
    each message begins, and the keys' counts."""
    table = table.sort_by("chunk")
    asked = [unpack_sorted(x) for x in table.column("keys").to_pylist()]
    counts = np.concatenate([unpack(x, np.int64) for x in table.column("counts").to_pylist()])
    keys, at = np.unique(np.concatenate(asked), return_inverse=True)
    cuts = np.concatenate([[0], np.cumsum([len(x) for x in asked])])
    return table.column("chunk").to_pylist(), keys, at, cuts, np.bincount(at, counts, len(keys)).astype(np.int64)


def _by_word(keys: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of a shard's dishes with customers, and of each dish the place of its word."""
    return np.unique(keys[c > 0] & _LOW, return_inverse=True)


def _to_root(shard: int, shards: int, words: np.ndarray, numbers: list[np.ndarray]) -> pa.Table:
    cuts = _cuts(words, shards)
    return _rows([(0, r, shard, b"", pack_sorted(words[a:b]), pack(np.concatenate([x[a:b] for x in numbers]).astype(np.int64)), b"") for r, (a, b) in enumerate(zip(cuts, cuts[1:]))], _NAMES)


def _from_shards(told: pa.Table) -> tuple[list[int], list[np.ndarray], np.ndarray, np.ndarray]:
    """The senders and, for each, the places of its words; the distinct words, and their summed numbers, a row for each sweep."""
    told = told.sort_by("chunk")
    sent = [unpack_sorted(x) for x in told.column("keys").to_pylist()]
    words, at = np.unique(np.concatenate(sent), return_inverse=True)
    at = np.split(at, np.cumsum([len(x) for x in sent])[:-1])
    out = None
    for i, x in zip(at, told.column("counts").to_pylist()):
        x = unpack(x, np.int64)
        if len(i):
            out = np.zeros((len(x) // len(i), len(words)), np.int64) if out is None else out
            out[:, i] += x.reshape(-1, len(i))
    return told.column("chunk").to_pylist(), at, words, np.zeros((1, 0), np.int64) if out is None else out


def _types(shards: int):
    """Of a shard of contexts: in how many of them each word occurs, for the root."""

    def types(key, table):
        tidy()
        if key[0].as_py() == 0:
            return _rows([], _NAMES)
        _, keys, _, _, c = _sum(table)
        words, of = _by_word(keys, c)
        return _to_root(key[1].as_py(), shards, words, [np.bincount(of, minlength=len(words))])

    return types


def _priors(shards: int, root_d: float, root_theta: float, sweeps: int, burn: int):
    """The root as seated from those, for each shard's words in the order they came in."""

    def priors(key, table):
        tidy()
        shard = key[1].as_py()
        senders, at, words, n = _from_shards(table)
        tables = seated_root(n[0], shards, root_d, root_theta, sweeps, burn, shard)
        head = np.array([n.sum(), tables.sum(), len(words)], np.float64).tobytes()
        values = (n[0] - root_d * tables).astype(np.float32)
        return _rows([(1, s, shard, head, b"", pack(values[i]), b"") for s, i in zip(senders, at)], _NAMES)

    return priors


def _prior(told: pa.Table, root_d: float, root_theta: float) -> np.ndarray:
    """The root's probability of each of a shard's words."""
    told = told.sort_by("chunk")
    customers, tables, words = np.sum([np.frombuffer(x) for x in told.column("head").to_pylist()], axis=0)
    left = np.concatenate([unpack(x, np.float32) for x in told.column("counts").to_pylist()])
    return (left + (root_theta + root_d * tables) / (words + 1)) / (root_theta + customers)


def _contexts(keys, c, told, hot: dict[int, int], root_d: float, root_theta: float):
    """Of a shard of contexts: each dish's restaurant and prior, in how many shards each restaurant is, and what ``_by_word`` gives.
    Without the root's answer words are equally likely."""
    contexts, context = np.unique(keys >> np.uint64(32), return_inverse=True)
    spread = np.array([hot.get(int(x), 1) for x in contexts], dtype=np.float64)
    words, of = _by_word(keys, c)
    prior = np.zeros(len(keys))
    prior[c > 0] = (_prior(told, root_d, root_theta) if told is not None else np.full(len(words), 1 / max(1, len(words))))[of]
    return context, prior, spread, words, of


def _tables(shards: int, hot: dict[int, int], d: float, theta: float, root_d: float, root_theta: float, sweeps: int, burn: int):
    """Of a shard of contexts: the tables of each word in each sweep kept, for the root."""

    def tables(key, table, told):
        tidy()
        if key[0].as_py() == 0:
            return _rows([], _NAMES)
        _, keys, _, _, c = _sum(table)
        context, prior, spread, words, of = _contexts(keys, c, told, hot, root_d, root_theta)
        each = [np.bincount(of, t[c > 0], len(words)) for t in sampled(c, context, prior, d, theta, spread, sweeps, burn, key[1].as_py())]
        return _to_root(key[1].as_py(), shards, words, each)

    return tables


def _customers(keys: np.ndarray, c: np.ndarray, words: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """The root's customers in each sweep: the contexts' tables of a word; words that share their lower half divide them by counts."""
    at = np.searchsorted(words, keys >> np.uint64(32))
    at = np.where(c > 0, np.minimum(at, max(0, len(words) - 1)), 0)
    total = np.bincount(at, c, max(1, len(words)))
    share = c / np.maximum(total[at], 1)
    return np.maximum(np.round(tables[:, at] * share), c > 0).astype(np.int64) if len(words) else np.zeros((1, len(keys)), np.int64)


def _answer(hot: dict[int, int], d: float, theta: float, root_d: float, sweeps: int, burn: int, shards: int = 1, root_theta: float = 1.0):
    def answer(key, table, told=None):
        """``told``: to the root, the contexts' tables; to contexts, their words' prior."""
        tidy()
        kind, shard = key[0].as_py(), key[1].as_py()
        chunks, keys, at, cuts, c = _sum(table)
        if kind == 0:
            customers = _customers(keys, c, *_from_shards(told)[2:]) if told is not None and told.num_rows else (c > 0).astype(np.int64)[None]
            mean = np.mean([seated_root(n, shards, root_d, root_theta, sweeps, burn, shard) for n in customers], axis=0)
            n = customers.mean(axis=0)
            head = np.array([c.sum(), (c > 0).sum(), n.sum(), mean.sum()]).tobytes()
            values = (n - root_d * mean).astype(np.float32)
            out = [(0, shard, k, head, pack(values[i]), pack(c[i])) for k, i in zip(chunks, (at[a:b] for a, b in zip(cuts, cuts[1:])))]
        else:
            context, prior, spread, _, _ = _contexts(keys, c, told, hot, root_d, root_theta)
            mean = gibbs(c, context, prior, d, theta, spread, sweeps, burn, shard)
            tables = np.bincount(context, mean, minlength=len(spread)).astype(np.float32)
            values, out = (c - d * mean).astype(np.float32), []
            for k, a, b in zip(chunks, cuts, cuts[1:]):
                i = at[a:b]
                out.append((1, shard, k, b"", pack(values[i]), pack(tables[np.unique(context[i])])))
        return _rows(out, "kind shard chunk head values extra")

    return answer


def _probabilities(x: _Chunk, got: dict, shards: int, d: float, theta: float, root_d: float, root_theta: float) -> tuple[np.ndarray, np.ndarray, float, float]:
    """From the shards' answers by (kind, shard): the probability of each distinct pair of the chunk, the training count of each
    distinct word, and the training tokens and distinct words of the corpus."""
    total = np.zeros(4)
    root, c = np.zeros(len(x.words)), np.zeros(len(x.words), np.int64)
    left, tables = np.zeros(len(x.key)), np.zeros(len(x.words))
    for s in range(shards) if got else ():
        head, values, extra = got[0, s]
        total += np.frombuffer(head)
        i = x.word_order[x.word_cuts[s] : x.word_cuts[s + 1]]
        root[i] = unpack(values, np.float32)
        c[i] = unpack(extra, np.int64)
        i = x.order[x.cuts[s] : x.cuts[s + 1]]
        if len(i):
            _, values, extra = got[1, s]
            left[i] = unpack(values, np.float32)
            _, one = np.unique(x.key[i] >> np.uint64(32), return_index=True)
            np.add.at(tables, x.key_u[i[one]], unpack(extra, np.float32))
    n, v, customers, root_tables = total
    parent = (root + (root_theta + root_d * root_tables) / (v + 1)) / (root_theta + customers)
    return (left[: len(x.u)] + (theta + d * tables[x.u]) * parent[x.w]) / (theta + c[x.u]), c, n, v


def _score(shards: int, hot: dict[int, int], d: float, theta: float, root_d: float, root_theta: float):
    def score(key, docs, answers):
        tidy()
        x = _Chunk(docs, shards, hot)
        got = {(k, s): (h, v, e) for k, s, h, v, e in zip(*(answers.column(n).to_pylist() for n in ("kind", "shard", "head", "values", "extra")))} if docs.num_rows else {}
        p, c, n, v = _probabilities(x, got, shards, d, theta, root_d, root_theta)
        each = np.log10(p)[x.pair]
        base = np.log10((c + 0.5) / (n + 0.5 * (v + 1)))[x.word]
        known = (c > 0)[x.word].astype(np.int64)
        parts = [np.add.reduceat(y, x.first[:-1]) if len(x.n) else y[:0] for y in (known, base, each)]
        ids = docs.column("doc_id").cast(pa.int64())
        return pa.table([ids, pa.array(docs.column("fold").to_numpy() == 1), pa.array(x.n.astype(np.int64)), pa.array(parts[0]), pa.array(np.full(len(x.n), int(n))), pa.array(parts[1]), pa.array(parts[2])], [f.split()[0] for f in _SCORES.split(", ")])

    return score


def _heavy(share: float):
    """Words with at least ``share`` of a batch's tokens. A word with that share of all has it in some batch."""

    def heavy(batches):
        for batch in batches:
            w = Words(batch.column("text"), lower=True)
            tokens = np.concatenate([w.hashes()[0], np.full(batch.num_rows, _END)])
            words, n = np.unique(tokens, return_counts=True)
            keep = n >= share * max(1, len(tokens))
            yield pa.RecordBatch.from_arrays([pa.array((mix(words[keep]) >> np.uint64(32)).astype(np.int64)), pa.array(n[keep].astype(np.int64))], ["word", "n"])

    return heavy


def score(docs: DataFrame, d: float = 0.8, theta: float = 1.0, root_d: float = 0.6, root_theta: float = 1.0, sweeps: int = 6, burn: int = 2, chunk_bytes: int = 8 << 20, chunks_per_shard: int = 1) -> DataFrame:
    """Each text's log10 probability under the model, and under the unigram base.

    Columns: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. Texts whose crc32(doc_id) mod 5 is 1
    are held out of training. Texts of any length are scored whole. Null or empty texts are scored as an end mark alone, a null id hashes as an empty text,
    repeated rows count and are scored each, an empty table gives an empty result, further columns are ignored, whatever their names.
    """
    docs = docs.select("doc_id", "text", fold(F.col("doc_id"), 5).cast("int").alias("fold"))
    n = chunks_of(docs, chunk_bytes)
    shards = max(1, -(-n // chunks_per_shard))
    share = 1 / (4 * shards + 1000)
    heavy = docs.select("text").mapInArrow(_heavy(share), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    tokens = docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 1
    # Only words that could fill a good part of a shard: at most 4 * shards of them, as a text has more bytes than words.
    hot = {r.word: int(r.n * 8 * shards // tokens) + 1 for r in heavy.where(F.col("n") * 8 * shards > tokens).collect()}
    dealt = chunked(docs, n)
    asked = dealt.groupBy("__chunk").applyInArrow(_gather(shards, hot), _ROWS)
    by = ("kind", "shard")
    priors = asked.groupBy(*by).applyInArrow(_types(shards), _ROWS).groupBy(*by).applyInArrow(_priors(shards, root_d, root_theta, sweeps, burn), _ROWS)
    tables = asked.groupBy(*by).cogroup(priors.groupBy(*by)).applyInArrow(_tables(shards, hot, d, theta, root_d, root_theta, sweeps, burn), _ROWS)
    answer = _answer(hot, d, theta, root_d, sweeps, burn, shards, root_theta)
    answers = asked.groupBy(*by).cogroup(priors.unionByName(tables).groupBy(*by)).applyInArrow(lambda key, table, told: answer(key, table, told), _ANSWERS)
    return dealt.groupBy("__chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_score(shards, hot, d, theta, root_d, root_theta), _SCORES)
