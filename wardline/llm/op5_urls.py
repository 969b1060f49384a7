"""URL filter: host and path rules, and for the rest a likelihood ratio of two character models; DataFrame operations only.

The models are variable-order Markov models of up to three characters of context, one of the URLs that rules allow and
one of those they block. They read the whole URL, scheme, query and fragment included. A context's counts are smoothed by
those of the context one shorter (Dirichlet, down to uniform). Their log-likelihood difference for a URL, divided by its
length, is compared with a threshold. A fifth of the distinct URLs that rules decide, dealt by hash, is kept out of the models, and
the threshold is calibrated on that fifth alone. Characters outside a-z, 0-9 and "./-:?#=&%_" count as one, so that the model has
fewer than 48**4 entries, each two longs: it is always broadcast. Grams carry their row's number, not its URL, so that the cost is linear
in a URL's length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import checkpointed, lowered

#: (verdict, host, path): a rule fits its host and all subdomains if the path starts with the rule's.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
ORDER = 3
_LETTERS = 47
_STRENGTH = 4.0
_UNIT = float(1 << 20)
#: One part in so many of the ruled URLs calibrates the threshold and teaches nothing.
FOLDS = 5


def parts(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    get = lambda i: F.coalesce(F.regexp_extract(url, pattern, i), F.lit(""))
    return lowered(get(1)), get(2)


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (null if none), and its verdict."""
    rule = verdict = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def _plain(text: Column) -> Column:
    return F.regexp_replace(lowered(F.coalesce(text, F.lit(""))), r"[^a-z0-9./:?#=&%_-]", "~")


def calibrates(text: Column) -> Column:
    """Whether a ruled URL is kept for the threshold."""
    return F.pmod(F.xxhash64(F.lit("cut"), text), F.lit(FOLDS)) == 0


def _grams(texts: DataFrame, *keep: str) -> DataFrame:
    """Every character of ``text`` with the three before it, as ``gram``, beside the columns of ``keep``; ``^`` stands before the first."""
    characters = F.split(F.concat(F.lit("^" * ORDER), F.col("text")), "")
    grams = F.slice(characters, F.lit(1), F.length("text"))
    for k in range(1, ORDER + 1):
        grams = F.zip_with(grams, F.slice(characters, F.lit(k + 1), F.length("text")), lambda x, y: F.concat(x, y))
    return texts.select(*keep, F.explode(grams).alias("gram"))


def _packed(gram: Column) -> Column:
    """A gram's characters, all ASCII, in one long."""
    out = F.lit(0).cast("long")
    for k in range(ORDER + 1):
        out = out * 128 + F.ascii(F.substring(gram, k + 1, 1))
    return out


def model(labelled: DataFrame, seen: DataFrame) -> DataFrame:
    """``labelled``: text and allow (0 or 1); ``seen``: the grams to have. Returns gram and ratio: the difference of the log
    probabilities of the gram's last character under the two models, in units of 2**-20."""
    counts = checkpointed(_grams(labelled, "allow").groupBy("gram").agg(*(F.count(F.when(F.col("allow") == y, 1)).alias(f"n{y}") for y in (0, 1))))
    entries = seen.select("gram")
    totals = counts.agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).first()
    for k in range(ORDER + 1):
        for what, start, length in (("pair", ORDER - k + 1, k + 1), ("context", ORDER - k + 1, k)):
            if length:
                part = F.substring("gram", start, length)
                sums = counts.groupBy(part.alias(f"{what}{k}")).agg(*(F.sum(f"n{y}").alias(f"{what}{k}_{y}") for y in (0, 1)))
                entries = entries.withColumn(f"{what}{k}", part).join(sums, f"{what}{k}", "left").drop(f"{what}{k}")

    def log_p(y: int) -> Column:
        n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
        total = float((totals.n0, totals.n1)[y] or 0)
        p = (n(f"pair0_{y}") + 1.0) / (total + _LETTERS)
        for k in range(1, ORDER + 1):
            p = (n(f"pair{k}_{y}") + _STRENGTH * p) / (n(f"context{k}_{y}") + _STRENGTH)
        return F.ln(p)

    return entries.select("gram", F.round((log_p(1) - log_p(0)) * _UNIT).cast("long").alias("ratio"))


def scored(rows: DataFrame, labelled: DataFrame) -> DataFrame:
    """``rows`` (with ``key``, a number of each row, and ``text``) and ``score``, the log-likelihood difference per character; 0 for an empty text."""
    entries = model(labelled, _grams(rows).distinct()).select(_packed(F.col("gram")).alias("gram"), "ratio")
    grams = _grams(rows, "key").select("key", _packed(F.col("gram")).alias("gram"))
    # A row's grams are in one task, which adds them up: one pair of longs of each row is shuffled.
    sums = grams.join(F.broadcast(checkpointed(entries)), "gram").groupBy("key").agg(F.sum("ratio").alias("ratio"))
    score = F.coalesce(F.col("ratio") / _UNIT / F.length("text"), F.lit(0.0))
    return rows.join(sums, "key", "left").withColumn("score", score).drop("ratio")


def threshold(held_out: DataFrame) -> float:
    """``held_out``: allow (0 or 1) and score of URLs that the models haven't seen. Where the two groups' means are equally many of
    their standard deviations away; 0, at which both models are equally likely, if a group is empty."""
    known = held_out.groupBy("allow").agg(F.avg("score").alias("mean"), F.coalesce(F.stddev_samp("score"), F.lit(0.0)).alias("spread"))
    fit = {r["allow"]: (r["mean"], r["spread"] + 1e-9) for r in known.collect()}
    if len(fit) < 2:
        return 0.0
    (m0, s0), (m1, s1) = fit[0], fit[1]
    # Rounded, as sums of doubles in another order differ in their last digits.
    return round((m0 * s1 + m1 * s0) / (s0 + s1), 9)


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score and threshold of every row of ``pages``.

    A null url or one without ``://`` has an empty host and path and fits no rule; the models read its characters all the same. A
    null or empty url has none and scores 0. A score equal to the threshold is allowed. Texts of any length are read whole.
    Repeated rows are each judged, and teach once; ids may be null; further columns are ignored, whatever their names. If
    rules allow or block nothing, or leave nothing for the threshold, that is 0. An empty table gives an empty result.
    """
    host, path = parts(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"), _plain(F.col("url")).alias("text"))
    rule, decided = ruled(F.col("host"), F.col("path"), rules)
    rows = checkpointed(split.select("*", rule.alias("rule"), decided.alias("decided"), F.monotonically_increasing_id().alias("key")))
    ruled_rows, allow = F.col("decided").isNotNull(), (F.col("decided") == "allow").cast("int").alias("allow")
    known = rows.where(ruled_rows & ~calibrates(F.col("text"))).select("text", allow).distinct()
    scores = checkpointed(scored(rows, known))
    cut = threshold(scores.where(ruled_rows & calibrates(F.col("text"))).select("text", allow, "score").distinct())
    verdict = F.coalesce("decided", F.when(F.col("score") >= cut, "allow").otherwise("block"))
    return scores.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score", F.lit(cut).alias("threshold"))
