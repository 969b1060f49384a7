"""Small shared steps: reading a table, materialising in the cluster's shared folder, dealing texts into chunks."""

from __future__ import annotations

import contextlib
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.frames import shared_folder

#: A word, and what separates words, for Spark's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` materialised in the folder that spark.checkpoint.dir names; where it is unset, in a temporary one if all tasks are on this
    machine, else that is an error."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


@contextlib.contextmanager
def tidied(spark: SparkSession):
    """What an action in this block has shuffled is removed when it ends, not whenever the driver's garbage is collected."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, "false")
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def lowered(text: Column) -> Column:
    """A-Z only; lower() would change other letters as well."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold(doc_id: Column, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % of


def windows(text: Column, count: int, each: int) -> Column:
    """A text (null: empty) in an array, or ``count`` pieces of ``each`` characters spread evenly over a longer one, its end included."""
    text = F.coalesce(text, F.lit(""))
    n = F.length(text)
    start = lambda i: ((n - each).cast("long") * i / (count - 1)).cast("int") + 1
    pieces = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.substr(text, start(i), F.lit(each)))
    return F.when(n <= count * each, F.array(text)).otherwise(pieces)


def chunks_of(docs: DataFrame, bytes_each: int) -> int:
    """How many chunks of about ``bytes_each`` the texts of ``docs`` make."""
    total = docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    return max(1, math.ceil(total / bytes_each))


def chunked(docs: DataFrame, n: int) -> DataFrame:
    """Adds ``__chunk``: texts dealt evenly over ``n`` chunks, whatever key or source is frequent."""
    return docs.withColumn("__chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int"))


#: Rows up to which a table of keys is broadcast, and over how many salts a frequent key is spread beyond.
BROADCAST, SALTS = 100_000, 64


def attached(rows: DataFrame, known: DataFrame, key: str, spread_by: str) -> DataFrame:
    """``rows`` with the columns of ``known``, which has one row for each ``key`` (null is a key). A frequent key doesn't
    meet in one task: ``known`` is broadcast if it is small, and else copied for salts that ``spread_by`` deals out."""
    other = known.withColumnRenamed(key, "_key")
    on = F.col(key).eqNullSafe(F.col("_key"))
    if other.limit(BROADCAST + 1).count() <= BROADCAST:
        return rows.join(F.broadcast(other), on).drop("_key")
    salted = other.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, on & (F.col("_salt") == F.col("_copy"))).drop("_key", "_salt", "_copy")
