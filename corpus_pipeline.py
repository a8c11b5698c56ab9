"""A training corpus from ``documents``: quality, near-duplicates, repeated passages, benchmark leaks, source weights.

Each stage takes (spark, docs, sf_dir), works on all rows of its predecessor, and its decisions take effect. All but the
last return the columns of ``documents``. Nulls, empty texts, repeated rows, empty tables and further columns are allowed
as the operators define them; further columns are passed on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfield.llm.decontaminate import contamination
from wayfield.llm.minhash import near_duplicates
from wayfield.llm.mixing import mix, word_count
from wayfield.llm.quality import judge
from wayfield.llm.store import fresh, made, release, written
from wayfield.llm.substring import without_repeats


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the posterior rejects go; null and empty texts fail the base rule."""
    return judge(docs).filter("kept").select("d.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, and one of rows that repeat an id and text, or a text without an id."""
    kept = near_duplicates(docs).filter("kept").groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("n"))
    # tables of ids grow with the corpus: here and below they are merged with the texts, at any size, and not broadcast
    kept = written(kept.select(F.struct("doc_id", "text_key", "n").alias("k")), "kept").hint("merge")
    rows = docs.select(F.struct("*").alias("d")).join(kept, F.expr("d.doc_id <=> k.doc_id and xxhash64(coalesce(d.text, '')) = k.text_key"))
    once = rows.filter("k.n = 1").select("d.*")
    return once.unionByName(rows.filter("k.n > 1").select("d.*").dropDuplicates(["doc_id", "text"]))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages are cut out; a document that was nothing else goes. ``n_chars`` follows the text."""
    cut = without_repeats(docs)
    left = cut.filter("n_removed = 0 or text rlike '[^\\\\x20\\\\x09-\\\\x0D]'")
    return left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth of their words or more inside benchmark windows go."""
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = found.filter("n_hit > 0 and 20 * n_hit >= n_words").select(F.struct("doc_id", "text_key").alias("k")).distinct()
    return docs.select(F.struct("*").alias("d")).join(written(bad, "contaminated").hint("merge"), F.expr("d.doc_id <=> k.doc_id and xxhash64(coalesce(d.text, '')) = k.text_key"), "left_anti").select("d.*")


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with ``copies``: how often each is to be read."""
    taken = mix(docs).filter("copies > 0").select(F.struct("doc_id", "source", "size").alias("k"), "copies").distinct()
    rows = docs.drop("copies").select(F.struct("*").alias("d"), word_count("text").alias("size"))
    return rows.join(written(taken, "taken").hint("merge"), F.expr("d.doc_id <=> k.doc_id and d.source <=> k.source and size = k.size")).select("d.*", "copies")


STAGES = [
    ("quality_rules", quality_rules),
    ("minhash_near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
]

#: EM, the choice of sentences to cut and the pivotal draws have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mark = made()
    for name, stage in STAGES:
        out = fresh(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(out)
        # what the stage wrote for itself, and its input, are not needed any more
        release(spark, mark, keep=(out,))
        docs = spark.read.parquet(out)
    return docs
