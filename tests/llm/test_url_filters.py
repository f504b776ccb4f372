import pytest

from plaudit.llm import url_filters as U


def test_parts_and_rules(spark):
    urls = [
        (1, "HTTP://A.Example.ORG/es/x?y"), (2, "http://example.org/en/12#z"), (3, "http://x.com/de/"), (4, "http://x.com/fr/1"),
        (5, "https://ads-track.example.net"), (6, "no url"), (7, None), (8, "http://q?://second/x"), (9, "ftp://notexample.org/es/a"),
        (10, "http://example.orgx/es/"), (11, "a\nb://Host/p\nq"), (12, ""), (12, ""),
    ]
    pages = spark.createDataFrame(urls, "page_id long, url string").selectExpr("*", "'clash' AS host", "'clash' AS verdict", "1 AS listed")
    got = {r.page_id: r for r in U.judge_urls(pages).collect()}
    assert len(got) == 12 and U.judge_urls(pages).count() == 13
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert (got[2].rule, got[2].verdict) == ("example.org/en/1", "block")
    assert got[3].rule == "com/de/" and got[4].verdict == "allow"
    assert (got[5].host, got[5].path, got[5].rule, got[5].verdict) == ("ads-track.example.net", "", None, "block")
    assert all((got[i].host, got[i].path, got[i].verdict) == ("", "", "allow") for i in (6, 7, 12))
    assert got[8].host == "q" and got[9].rule == "org/" and got[10].rule is None
    assert (got[11].host, got[11].path) == ("host", "/p\nq")
    assert U.judge_urls(pages.limit(0)).count() == 0


@pytest.mark.parametrize("share", [0, 1, 30, 100])
def test_cascade_is_exact_on_its_universe(spark, share):
    keys = spark.range(20_000).selectExpr("concat('key', id) AS key", f"pmod(xxhash64(id), 100) < {share} AS listed")
    universe = keys.unionAll(keys.limit(50)).unionAll(spark.sql("SELECT cast(null AS string), true"))
    cascade = U.build_cascade(universe, U.CascadeConfig(first_rate=0.2))
    got = U.with_listed(keys.withColumnRenamed("listed", "truth"), "key", cascade)
    assert got.filter("truth <> listed").count() == 0
    assert len(cascade.levels) >= (2 if 0 < share < 100 else share > 0)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    assert U.with_listed(spark.sql("SELECT cast(null AS string) AS key"), "key", cascade).first().listed is False


def test_lists_beyond_the_bound_are_joined(spark):
    keys = spark.range(5_000).selectExpr("concat('key', id) AS key", "id % 7 = 0 AS listed")
    cascade = U.build_cascade(keys, U.CascadeConfig(max_bits=128))
    assert not cascade.fits
    got = U.with_listed(keys.withColumnRenamed("listed", "truth"), "key", cascade)
    assert got.count() == 5_000 and got.filter("truth <> listed").count() == 0
