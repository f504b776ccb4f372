import corpus_pipeline as C
from cases import edge_docs, no_docs
from pyspark.sql import functions as F

from plaudit.llm.common import stored

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), []
    names = docs.columns
    for k, (_, stage) in enumerate(C.STAGES):
        out = stored(stage(spark, docs, SF))
        assert k == len(C.STAGES) - 1 or out.columns == names
        seen.append(out.count())
        if k < 3:
            assert out.join(docs.select("doc_id"), "doc_id", "left_anti").isEmpty() and seen[-1] < docs.count()
        docs = out
    assert seen[0] > seen[1] >= seen[2] and seen[3] == seen[4] > 0


def test_later_stages_agree_with_brute_force(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in C.quality(spark, docs, SF).select("doc_id").collect()}
    good = set(labels[labels["quality"] == 1]["doc_id"])
    assert len(good - kept) <= 0.02 * len(good)
    mixed = stored(C.mixed(spark, docs, SF))
    plan = C.packed(spark, mixed, SF)
    words = mixed.select(F.sum(F.size(F.expr("filter(split(text, '[ \\\\t-\\\\r]+'), w -> w <> '')")))).first()[0]
    assert plan.agg(F.sum("n_tokens")).first()[0] == words


def test_edge_rows_pass_through_all_stages(spark):
    docs = edge_docs(spark).withColumnsRenamed({"id": "__removed", "th": "__score"}).withColumn("predicted", F.lit(0))
    names, given = docs.columns, {r["score"] for r in docs.collect()}
    for k, (_, stage) in enumerate(C.STAGES):
        docs = stored(stage(spark, docs, SF))
        if k < 4:
            assert docs.columns == names
            assert {(r["score"], r["removed_words"], r["predicted"], r["__removed"], r["__score"]) for r in docs.collect()} == {(0.5, "q", 0, "x", 1)}
    assert given == {0.5} and docs.filter("doc_id = 5").count() > 0


def test_empty_table_and_repeated_rows(spark):
    docs = no_docs(spark)
    for _, stage in C.STAGES:
        docs = stored(stage(spark, docs, SF))
        assert docs.count() == 0
    docs = edge_docs(spark).select("doc_id", "text", "lang", "source", "n_chars")
    one, two = [stored(C.near_copies(spark, stored(C.lines(spark, d, SF)), SF)) for d in (docs, docs.unionByName(docs))]
    assert sorted(map(str, one.distinct().collect())) == sorted(map(str, two.distinct().collect()))
