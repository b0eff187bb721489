"""URL rules and reputations against plain Python and the registered SQL."""

import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import queries, url_filters

URLS = [None, "", "no scheme", "http://", "://x.com", "http://A.EXAMPLE.com/en/7x?q#f", "https://example.com/en/8", "http://b.example.net/de/81", "http://example.net/de/9", "ftp://u@h.org:80/es/#x", "http://ÄB.com/EN/", "http://a.co.uk/x://y", "http://x.com?/en/", "http://com/en/", "http://xcom/en/", "http://a..b.com./en/", "http://" + "s." * 3000 + "example.com/en/7"]


def plain(url):
    m = re.search("://", url or "")
    rest = url[m.end() :] if m else ""
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fit = [(h + p, a) for a, h, p in queries.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *max(fit, key=lambda x: len(x[0]), default=(None, None))


@pytest.fixture(scope="module")
def pages(spark, sf_dir):
    odd = spark.createDataFrame([(-k - 1, u) for k, u in enumerate(URLS)] + [(None, "http://a.com/en/")], "page_id long, url string")
    return odd.unionByName(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")).withColumn("host", F.lit("clash")).withColumn("bad", F.lit(1))


def test_rules(spark, pages):
    outcomes = spark.createDataFrame([(25, 1), (25, 1), (27, None), (None, 1)], "page_id long, bad int")
    rows = url_filters.judge(pages, outcomes, queries.RULES).collect()
    urls = {r.page_id: r.url for r in pages.collect()}
    assert len(rows) == pages.count()
    for r in rows:
        host, path, rule, action = plain(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (action or ("block" if r.p_above > url_filters.LEVEL else "allow"))


def test_bad_hosts_are_blocked_and_shrunk(spark):
    pages = [(k, f"http://h{k % 20}.bad.com/{k}") for k in range(400)] + [(1000 + k, f"http://g{k % 20}.good.com/{k}") for k in range(400)] + [(2000, "http://new.bad.com/x"), (2001, "http://new.good.com/x"), (2002, "http://other.org/")]
    outcomes = [(k, int(k % 10 != 0)) for k in range(400)] + [(1000 + k, int(k % 10 == 0)) for k in range(400)]
    rows = {r.page_id: r for r in url_filters.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(outcomes, "page_id long, bad int"), []).collect()}
    assert rows[2000].verdict == rows[1].verdict == "block" and rows[2001].verdict == rows[1001].verdict == "allow"
    assert 0.3 < rows[2002].bad_rate < 0.7, "an unseen suffix inherits the rate of all"
    assert 0.5 < rows[2000].bad_rate


def test_no_labels_and_empty(spark, pages):
    none = spark.createDataFrame([], "page_id long, bad int")
    assert {r.verdict for r in url_filters.judge(pages, none, []).collect()} == {"allow"}
    assert url_filters.judge(pages.limit(0), none, queries.RULES).count() == 0


def test_many_rules_are_joined_with_the_same_result(spark, pages, monkeypatch):
    hosts = ["com", "example.com", "b.example.net", "net", "org", "", "com.", "a.b.c.d.e", "ÄB.com", "s.example.com"]
    paths = ["", "/", "/en/", "/en/7", "/de/8", "/es/", "/en/7x", "/x://y", "/EN/", "/a/very/long/path/that/no/url/has"]
    rules = [(("allow", "block")[(i + j) % 2], h, p) for i, h in enumerate(hosts) for j, p in enumerate(paths)] + [("allow", "net", "/"), ("block", "net", "/")]
    none = spark.createDataFrame([], "page_id long, bad int")
    read = lambda: sorted(repr((r.page_id, r.host, r.path, r.rule, r.verdict)) for r in url_filters.judge(pages, none, rules).collect())
    literal = read()
    monkeypatch.setattr(url_filters, "LITERALS", 0)
    assert read() == literal and "block" in str(literal)
    empty = spark.createDataFrame([], "action string, host string, path string")
    assert {(r.rule, r.verdict) for r in url_filters.judge(pages, none, empty).collect()} == {(None, "allow")}


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_sql(spark, size):
    d = f"/root/testdata/{size}"
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()["op1_url_filters"])
    names = [c[0] for c in want.description]
    got = queries.op1_url_filters(spark, d)
    assert sorted(map(repr, want.fetchall())) == sorted(repr(tuple(r)) for r in got.select(*names).collect())
    assert set(names) == set(got.columns)


def test_share_above_is_the_beta_distribution_s(spark):
    draw = np.random.default_rng(8)
    cases = [(0.5, 2.0), (0.9, 1.0), (0.001, 1.0), (0.999, 1001.0), (0.02, 50000.0), (0.49, 5000.0), (0.51, 5000.0), (0.3, 12.0), (0.7, 3.5), (0.5, 1e7)]
    rows = spark.createDataFrame([(float(r), float(n)) for r, n in cases], "bad_rate double, bad_rate_size double")
    for max_bad in (0.5, 0.2):
        got = rows
        for step in url_filters.above_steps(max_bad):
            got = got.selectExpr("bad_rate", "bad_rate_size", *[f"{e} AS {c}" for c, e in step.items()])
        for r in got.collect():
            sample = (draw.beta(r.bad_rate * r.bad_rate_size, (1 - r.bad_rate) * r.bad_rate_size, 400_000) > max_bad).mean()
            assert abs(r.p_above - sample) < 0.004, r
