"""The corpus pipeline: toxic documents go, near duplicates go, repeated passages go, sources are mixed, texts are encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs. In all stages a
null text counts as an empty one and is kept as null where it stays, any column may be null, an empty table gives an empty
result, and columns beyond those of ``documents`` are left out, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardline.frames import shared_folder
from wardline.llm import op2_bpe, op3_toxicity, op4_mixing, op9_substrings, op10_simhash
from wardline.llm.tables import table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str, threshold: float = 0.3) -> DataFrame:
    """Documents whose toxicity score is under the threshold; the field is fitted on labelled rows among them. Repeated rows are
    each judged, and alike; without labels nothing is toxic."""
    field = op3_toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return op3_toxicity.tag(docs, field, COLUMNS).where(F.col("score") < threshold).select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near copies: texts linked by SimHash whose sets of five words have a Jaccard of
    0.8 or more, verified. Of rows that share that id, the one of the smallest text (then language, source, length) stays; rows without
    an id stay."""
    kept = op10_simhash.similar_documents(docs, shingle=5, least=0.8).where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy("text", "lang", "source", "n_chars"))
    with_id = docs.where("doc_id IS NOT NULL").join(kept, "doc_id", "left_semi").select(*COLUMNS, first.alias("_first")).where("_first = 1").select(*COLUMNS)
    return with_id.unionByName(docs.where("doc_id IS NULL").select(*COLUMNS))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that documents of smaller ids hold. Untouched texts stay as they are; the others are the words
    left, joined by one space. Rows that repeat an id are one document to the rule, and all stay."""
    cut = op9_substrings.remove_repeats(docs, COLUMNS)
    touched = F.col("n_removed") > 0
    text = F.when(touched, F.col("kept")).otherwise(F.col("text"))
    n_chars = F.when(touched, F.length("kept").cast("long")).otherwise(F.col("n_chars"))
    return cut.select("doc_id", text.alias("text"), "lang", "source", n_chars.alias("n_chars"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: rows that share an id and a source are one document and are repeated alike.
    A null source is a source."""
    copies = op4_mixing.mix(docs).groupBy("source", "doc_id").agg(F.max("copies").alias("copies"))
    c = copies.select(F.col("source").alias("s"), F.col("doc_id").alias("d"), "copies")
    joined = docs.join(c, F.col("source").eqNullSafe(F.col("s")) & F.col("doc_id").eqNullSafe(F.col("d")))
    return joined.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, with digests of the ids and of the bytes they decode to; every row is encoded for itself."""
    rows = op2_bpe.encode(docs, ("doc_id", "source"))
    n = (F.octet_length("ids") / 4).cast("long")
    return rows.select("doc_id", "source", n.alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", not_toxic), ("simhash", one_of_each), ("substrings", without_repeats), ("mixing", mixed), ("bpe", encoded)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the cluster's shared folder and read again. A stage's table is deleted
    once the next one's is written; the last one's is the result's and stays."""
    folder, before = shared_folder(spark), None
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{folder}/corpus-{uuid.uuid4().hex}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            old = spark._jvm.org.apache.hadoop.fs.Path(before)
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
        before = path
    return docs
