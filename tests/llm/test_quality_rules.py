import math

import pytest
from cases import edge_docs, no_docs, no_labels
from pyspark.sql import functions as F

from plaudit.llm import quality_rules as R


@pytest.mark.parametrize("n, risk, error", [(10, 0.1, 0.05), (50, 0.1, 0.05), (300, 0.02, 0.01), (5000, 0.01, 0.001), (1, 0.9, 0.5)])
def test_most_allowed(spark, n, risk, error):
    got = spark.range(1).select(R.most_allowed(F.lit(n).cast("bigint"), risk, error)).first()[0]
    cdf, want = 0.0, -1
    for k in range(n + 1):
        cdf += math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(risk) + (n - k) * math.log(1 - risk))
        if cdf > error:
            break
        want = k
    assert got == want


def repeated(words):
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    return len({i + o for i, g in enumerate(grams) if grams.count(g) > 1 for o in range(3)})


def test_repeated_words(spark):
    texts = ["", "a", "a b c", "a b c a b c", "a a a a", "x a b c y a b c z", "a b a b a b q", "p q r s p q t q r s"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", R.repeated_words(F.filter(F.split("t", " "), lambda w: w != "")).alias("n")).collect()
    assert all(r.n == repeated(r.t.split()) for r in rows)


def test_rejections_are_limited(spark):
    """Good texts of one language have few symbols; only where enough labels prove it, a cutoff is set."""
    rows, labels = [], []
    for i in range(4000):
        good = i % 4 > 0
        text = " ".join(f"w{(i * 7 + k * k) % 5003}" for k in range(60)) + (" ###" * 40 if not good else " #" * (i % 400 == 1))
        rows.append((i, text, "en" if i % 10 else "rare"))
        labels.append((i, int(good)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    config = R.RuleConfig()
    got = R.apply_rules(docs, spark.createDataFrame(labels, "doc_id long, quality int"), config).toPandas()
    good = got["doc_id"] % 4 > 0
    en = got["lang"] == "en"
    assert (~got[good & en]["kept"]).mean() <= config.risk
    assert not got[~good & en]["kept"].any() and (got[~good & en]["rejected_by"] == "symbols").all()
    assert got[got["lang"] == "rare"]["kept"].all()  # 300 labels prove nothing at this level


def test_edges(spark):
    docs = edge_docs(spark)
    labels = spark.createDataFrame([(1, 1), (1, 0), (5, 1), (None, 1), (7, None)], "doc_id long, quality int")
    rows = R.apply_rules(docs, labels).toPandas()
    assert len(rows) == docs.count() and rows["n_words"].notna().all() and rows["kept"].notna().all()
    assert rows[rows["doc_id"] == 5]["kept"].all() and rows[rows["n_words"] < 50]["base_failed"].all()
    nine = rows[rows["doc_id"] == 9].iloc[0]
    assert (nine["n_dup_lines"], nine["n_symbols"], nine["n_words"], nine["n_repeat_words"]) == (1, 18, 10, 6)
    assert R.apply_rules(no_docs(spark), labels).count() == 0
    assert R.apply_rules(docs, no_labels(spark)).filter("rejected_by is not null").count() == 0


def test_one_pass_without_python(spark):
    counted = R.with_counts(edge_docs(spark).select("doc_id", "lang", "text"))
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
