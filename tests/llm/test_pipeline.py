"""The pipeline stage by stage against brute force, and on tables with nulls, repeats, further columns and no rows."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import CLASH, components_of, fill, shingles, words
from wayfield.llm import decontaminate, quality, substring
from wayfield.llm.store import fresh

SF = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")


def test_stages_follow_their_decisions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        out = fresh(spark, name)
        stage(spark, docs, SF).write.parquet(out)
        docs = spark.read.parquet(out)
        after[name] = docs
        kept = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        given = {r.doc_id: r.text for r in before.select("doc_id", "text").collect()}
        if name != "source_mixing":
            assert docs.columns == before.columns
        if name == "quality_rules":
            assert set(kept) == {r.doc_id for r in quality.judge(before).filter("kept").select("d.doc_id").collect()}
        if name == "minhash_near_dedup":
            found = components_of({i: shingles(t) for i, t in given.items()})
            assert set(kept) == {i for i in given if found[i] == i}
        if name == "substring_dedup":
            cut = {r.doc_id: r.text for r in substring.without_repeats(before).collect()}
            assert kept == {i: t for i, t in cut.items() if words(t)}
        if name == "benchmark_decontamination":
            found = decontaminate.contamination(before, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()
            assert set(kept) == {r.doc_id for r in found if not (r.n_hit > 0 and 20 * r.n_hit >= r.n_words)}
        if name == "source_mixing":
            sizes, taken = {}, {}
            for r in before.collect():
                sizes[r.source] = sizes.get(r.source, 0) + len(words(r.text))
            for r in docs.collect():
                taken[r.source] = taken.get(r.source, 0) + r.copies * len(words(r.text))
            largest = max(len(words(t)) for t in given.values())
            assert all(abs(taken.get(s, 0) - t) <= largest for s, t in fill(sizes).items())
    ran = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, ran.collect()), key=str) == sorted(map(tuple, docs.collect()), key=str)


def test_odd_rows_and_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = [c.split() for c in CLASH.split(", ") if c.split()[0] not in docs.columns]
    odd = docs.limit(40).unionByName(docs.limit(40)).unionByName(docs.limit(5).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema)))
    odd = odd.unionByName(docs.limit(8).withColumn("doc_id", F.lit(None).cast("long"))).unionByName(docs.limit(3).withColumns({"source": F.lit(None).cast("string"), "n_chars": F.lit(None).cast("long")}))
    odd = odd.select("*", *(F.lit(None).cast(kind).alias(name) for name, kind in more))
    for table in (odd, odd.limit(0)):
        rows = table
        for name, stage in corpus_pipeline.STAGES:
            out = fresh(spark, name)
            stage(spark, rows, SF).write.parquet(out)
            rows = spark.read.parquet(out)
            assert set(rows.columns) == set(odd.columns)
        assert rows.groupBy("doc_id", "text").count().filter("count > 1").count() == 0
