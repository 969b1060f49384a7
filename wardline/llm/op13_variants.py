"""Spelling variants: words one edit apart, found by Aho-Corasick automata of the words' halves.

One edit leaves one of a word's two halves as it is, at the start or the end of the other word, whose length differs by one at most. Every
half goes to a shard by its hash, and so does every word, once for each half that such a neighbour could have; so a shard's automaton
meets the words that may hold its halves, however many words there are. A match counts if it stands at the right end of the word and the
lengths fit; then the other halves are compared, in matrices of code points. Where very many words share a half, their other halves
are cut in two again, in the same way, and halves of more words than one task should hold are dealt over several.
"""

from __future__ import annotations

import math
from collections import defaultdict

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import BROADCAST, checkpointed, lowered

LETTERS = "a-zÀ-ÿ"
LEAST_LENGTH, LEAST_COUNT, RATIO, TAMPER = 7, 2, 10, 31
#: Words and characters for a shard, owners of one half for a part of it, comparisons of one matrix, and comparisons beyond which halves are halved.
WORDS, CHARACTERS, OWNERS, _TILE, _MANY = 50_000, 1 << 20, 20_000, 1 << 20, 1 << 22
_FIRST, _LAST = 1, 2


def tampered(doc_id: Column, run: Column) -> Column:
    """``run`` without the character at h % length if 31 divides h, the crc32 of ``<doc_id>:<run>``; a null id counts as empty."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    return F.when(h % TAMPER == 0, F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))).otherwise(run)


def counted(docs: DataFrame) -> DataFrame:
    """word and n, over all whole texts of ``docs``: maximal runs of letters, A-Z lower-cased, some of them misspelt by ``tampered``."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(lowered("text"), F.lit(f"[{LETTERS}]+"), F.lit(0))).alias("run"))
    words = runs.where(F.char_length("run") >= LEAST_LENGTH).select(tampered(F.col("doc_id"), F.col("run")).alias("word"))
    return words.where(F.char_length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _sent(words: DataFrame, shards: int) -> DataFrame:
    """word, n, shard and role: every word for each half that it, or a word one edit from it, has. Role 0 is to be scanned only; else the
    word owns its first (1) or last (2) half there."""
    n = F.char_length("word")
    half = lambda size: F.floor(size / 2).cast("int")
    first = lambda k: F.struct(F.lit(_FIRST).alias("kind"), F.substr("word", F.lit(1), k).alias("half"), (k == half(n)).alias("own"))
    last = lambda k: F.struct(F.lit(_LAST).alias("kind"), F.substr("word", n - k + 1, k).alias("half"), (k == n - half(n)).alias("own"))
    sizes = F.array_distinct(F.array(half(n - 1), half(n), half(n + 1)))
    others = F.array_distinct(F.array(*(m - half(m) for m in (n - 1, n, n + 1))))
    sent = words.select("word", "n", F.explode(F.concat(F.transform(sizes, first), F.transform(others, last))).alias("s")).select("word", "n", "s.*")
    common = sent.where("own").groupBy("kind", "half").agg(F.count("*").alias("_n")).where(F.col("_n") > OWNERS)
    common = checkpointed(common.select("kind", "half", F.ceil(F.col("_n") / OWNERS).cast("int").alias("parts")))
    dealt = sent.join(F.broadcast(common) if common.limit(BROADCAST + 1).count() <= BROADCAST else common, ["kind", "half"], "left")
    parts = F.coalesce("parts", F.lit(1))
    mine = F.pmod(F.xxhash64("word"), parts).cast("int")
    dealt = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    shard = F.pmod(F.xxhash64("kind", "half", "part"), F.lit(shards)).cast("int")
    role = F.when(F.col("own") & (F.col("part") == mine), F.col("kind")).otherwise(0)
    return dealt.select("word", "n", shard.alias("shard"), role.alias("role"))


def _points(texts: list[str], width: int) -> np.ndarray:
    """Texts of ``width`` characters as rows of code points."""
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).reshape(len(texts), width)


def _compared(a: list[str], b: list[str]):
    """Pairs of places (in ``a``, in ``b``) of texts that are exactly one edit apart; all of ``a`` have one length, and all of ``b``."""
    if len(a[0]) > len(b[0]):
        for j, i in _compared(b, a):
            yield i, j
        return
    short, long = len(a[0]), len(b[0])
    if long == 1 and not short:
        yield np.repeat(np.arange(len(a)), len(b)), np.tile(np.arange(len(b)), len(a))
        return
    x, y = _points(a, short), _points(b, long)
    step = max(1, _TILE // len(b))
    for i in range(0, len(a), step):
        some = x[i : i + step]
        if short == long:
            differ = np.zeros((len(some), len(b)), np.int32)
            for k in range(short):
                differ += some[:, k, None] != y[None, :, k]
            near = differ == 1
        else:
            # The characters that agree from the left and from the right together are all of the shorter text.
            agree = np.zeros((len(some), len(b)), np.int32)
            for way in (range(short), range(-1, -short - 1, -1)):
                same = np.ones((len(some), len(b)), bool)
                for k in way:
                    same &= some[:, k, None] == y[None, :, k]
                    agree += same
            near = agree >= short
        p, q = np.nonzero(near)
        yield p + i, q


def _halves(text: str) -> tuple[str, str]:
    return text[: len(text) // 2], text[len(text) // 2 :]


def neighbours(owners: list[str], roles: list[int], scanned: list[str]):
    """Arrays of places (in ``owners``, in ``scanned``) of texts one edit apart where the owner's half, first or last as its role says, is
    as it is in the scanned text; a pair of which both are is given once if the owner has both roles, with its first."""
    automaton, of = ahocorasick.Automaton(), {}
    for i, (text, role) in enumerate(zip(owners, roles)):
        for kind, half in zip((_FIRST, _LAST), _halves(text)):
            if role & kind:
                of.setdefault(half, ([], []))[kind - 1].append(i)
    hits: dict[str, tuple[list[int], list[int]]] = defaultdict(lambda: ([], []))
    empty = of.get("")
    for half in of:
        if half:
            automaton.add_word(half, half)
    automaton.make_automaton()
    for j, text in enumerate(scanned):
        if empty:
            hits[""][0].append(j)
            hits[""][1].append(j)
        if len(automaton):
            for end, half in automaton.iter(text):
                if end + 1 == len(half):
                    hits[half][0].append(j)
                if end + 1 == len(text):
                    hits[half][1].append(j)
    for half, found in hits.items():
        for kind in (_FIRST, _LAST):
            mine, js = of[half][kind - 1], found[kind - 1]
            if mine and js:
                k = len(half)
                rest = (lambda t: t[k:]) if kind == _FIRST else (lambda t: t[: len(t) - k])
                for p, q in _apart([rest(owners[i]) for i in mine], [rest(scanned[j]) for j in js]):
                    p, q = np.array(mine)[p], np.array(js)[q]
                    if kind == _LAST:
                        # An owner's first half that stands there too has found the pair, wherever its shard is.
                        new = np.array([not scanned[j].startswith(_halves(owners[i])[0]) for i, j in zip(p.tolist(), q.tolist())], bool)
                        p, q = p[new], q[new]
                    yield p, q


def _apart(a: list[str], b: list[str]):
    """Arrays of places of texts of ``a`` and ``b`` one edit apart."""
    by_length: dict[int, list[int]] = defaultdict(list)
    for j, text in enumerate(b):
        by_length[len(text)].append(j)
    lengths: dict[int, list[int]] = defaultdict(list)
    for i, text in enumerate(a):
        lengths[len(text)].append(i)
    if len(a) * len(b) > _MANY and min(lengths) >= 4:
        yield from neighbours(a, [_FIRST | _LAST] * len(a), b)
        return
    for n, mine in lengths.items():
        for m in (n - 1, n, n + 1):
            if others := by_length.get(m):
                for p, q in _compared([a[i] for i in mine], [b[j] for j in others]):
                    yield np.array(mine)[p], np.array(others)[q]


_NEAR = "word string, n_near long, n long, form string"


def _shard(table: pa.Table) -> pa.Table:
    roles: dict[str, int] = defaultdict(int)
    count: dict[str, int] = {}
    for word, n, role in zip(*(table.column(c).to_pylist() for c in ("word", "n", "role"))):
        roles[word] |= role
        count[word] = n
    words = list(roles)
    owners = [w for w in words if roles[w]]
    near, best = [0] * len(owners), [None] * len(owners)
    for p, q in neighbours(owners, [roles[w] for w in owners], words):
        for i, j in zip(p.tolist(), q.tolist()):
            form = (-count[words[j]], words[j])
            near[i] += 1
            if best[i] is None or form < best[i]:
                best[i] = form
    rows = [(w, n, -b[0], b[1]) for w, n, b in zip(owners, near, best) if n]
    columns = zip(*rows) if rows else [()] * 4
    return pa.table([pa.array(x, kind) for x, kind in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()))], ["word", "n_near", "n", "form"])


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near (the words one edit away, if any), and of these the one of largest n, ties to the smallest: form and form_n. ``words``: word, n."""
    size = words.agg(F.count("*").alias("n"), F.sum(F.char_length("word")).alias("c")).first()
    shards = max(1, math.ceil(size.n / WORDS), math.ceil((size.c or 0) / CHARACTERS))
    parts = _sent(words, shards).groupBy("shard").applyInArrow(_shard, _NEAR)
    best = parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), "form")).alias("best"))
    return best.select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))


def rooted(links: DataFrame, most: int, ratio: int) -> DataFrame:
    """word and root: ``links`` (word, form) followed to the last. Each form is ``ratio`` times as frequent as its word, so chains are as short as
    the logarithm of the largest count, ``most``; each round doubles the steps taken."""
    out, steps, longest = links.select("word", F.col("form").alias("root")), 1, math.log(max(most, 2), ratio)
    while steps < longest:
        out = checkpointed(out)
        onward = out.select(F.col("word").alias("root"), F.col("root").alias("to"))
        out, steps = out.join(onward, "root", "left").select("word", F.coalesce("to", "root").alias("root")), steps * 2
    return out


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near and form_n of every row of ``words`` (distinct words of any length, and n).

    Words are near if one inserted, deleted or replaced character turns one into the other. A word's form is its near word of largest n (ties:
    the smallest in code-point order) if that is ``ratio`` times its own n or more, else null; the root is the last of the forms that follow from
    a word, the word itself if it has none. An empty table gives an empty result.
    """
    words = checkpointed(words.select("word", "n"))
    most = words.agg(F.max("n").alias("n")).first().n or 0
    better = F.col("form_n") >= ratio * F.col("n")
    found = words.join(near_words(words), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(better, F.col("form")).alias("form"), F.when(better, F.col("form_n")).alias("form_n"))
    found = checkpointed(found)
    roots = rooted(found.where("form IS NOT NULL"), most, ratio)
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def grouped(docs: DataFrame) -> DataFrame:
    """The variants among the words of all whole texts (null: none); ids may be null or repeated, every row counts, and further columns are ignored,
    whatever their names."""
    return variants(counted(docs))
