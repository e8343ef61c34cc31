"""Sharding at any size and with many equal rows, very long URLs, pages with unclosed unrendered elements."""
import math
import time
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from callwright.llm import html_extract, sharding, url_lists

# ------------------------------------------------------------- 3 sharding


def test_inversion_has_the_hypergeometric_probabilities():
    good, bad, n = 30, 50, 25
    law = {k: float(Fraction(math.comb(good, k) * math.comb(bad, n - k), math.comb(good + bad, n))) for k in range(26)}
    draw = np.random.default_rng(5)
    drawn = Counter(sharding._by_inversion(draw, good, bad, n) for _ in range(20_000))
    for k, p in law.items():
        assert abs(drawn[k] / 20_000 - p) < 5 * math.sqrt(p / 20_000) + 1e-4, k
    assert all(sharding._by_inversion(draw, 1, 1, 2) == 1 and sharding._by_inversion(draw, 5, 3, 7) in (4, 5) for _ in range(20))


def test_law_beyond_the_generators_size():
    good, bad, n = 3 * 10**9, 7 * 10**9 + 1, 1_000_000
    draw = np.random.default_rng(6)
    x = np.array([sharding._hypergeometric(draw, good, bad, n) for _ in range(4000)], float)
    total, p = good + bad, good / (good + bad)
    mean, var = n * p, n * p * (1 - p) * (total - n) / (total - 1)
    z = (x - mean) / math.sqrt(var)
    assert abs(z.mean()) < 5 / math.sqrt(4000) and abs(z.var() - 1) < 5 * math.sqrt(2 / 4000)
    for t, share in ((1.0, 0.158655), (2.0, 0.022750), (3.0, 0.001350)):  # tails of the limit law; steps are 1/458 wide
        for side in (z > t, z < -t):
            assert abs(side.mean() - share) < 5 * math.sqrt(share / 4000) + 0.002
    assert (x == np.floor(x)).all() and not (np.diff(x) == 0).all()
    one = sharding.matrix([5 * 10**9, 5 * 10**9 + 3, 7], 8, 1)
    assert one.sum(1).tolist() == [5 * 10**9, 5 * 10**9 + 3, 7] and set(one.sum(0).tolist()) <= {1250000001, 1250000002}


def test_equal_rows_spread(spark):
    docs = spark.range(0, 6000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 > 0, F.lit("own")).otherwise(F.lit("the same")).alias("text"))
    out = sharding.shuffle_into_shards(docs, 4, rows=100).cache()
    assert out.count() == 6000 and out.select("shard", "slot").distinct().count() == 6000
    of_shard = {r.shard: r["count"] for r in out.where("doc_id is null").groupBy("shard").count().collect()}
    assert sum(of_shard.values()) == 2000 and all(abs(n - 500) < 6 * math.sqrt(500 * 0.5) for n in of_shard.values())
    # within a shard the copies stand everywhere, as after a uniform shuffle
    tenths = out.where("doc_id is null and shard = 0").groupBy(F.floor(F.col("slot") / 150)).count().collect()
    assert len(tenths) == 10 and all(20 <= r["count"] <= 85 for r in tenths)
    again = sharding.shuffle_into_shards(docs.repartition(3), 4, rows=100)
    assert Counter(map(tuple, again.collect())) == Counter(map(tuple, out.collect()))


# ------------------------------------------------------------- 5 URL lists


def names_by_spelling(url):
    import re

    host = re.search(url_lists.HOST, url)
    if not host:
        return set()
    host = host[1].lower()
    path = re.search(url_lists.PATH, url)
    parts = [p for p in (path[1] if path else "").split("/") if p]
    labels = host.split(".")
    return {("domain", ".".join(labels[i:])) for i in range(len(labels))} | {("prefix", f"{host}/{'/'.join(parts[:i])}".lower()) for i in range(len(parts) + 1)}


def test_names_equal_spelled_out_names(spark):
    urls = ["http://a.b.c/x//y/Z?q#f", "https://u:p@A.b..c:80", "ftp://c/", "http://b.c/x/y/z/", "nothing", "http://b.c/x/y", "http://.b.c./x", "http://c/a.b/c", "http://b.c/b.c"]
    patterns = {p for u in urls for p in names_by_spelling(u)}
    patterns |= {("prefix", p) for p in ("b.c", "b.c/x/", "b.c//x", "x", "/", "b.c/x/yy", "", "c/a.b")} | {("domain", p) for p in ("", ".", "c.", "x.c", "b.c/x", "c/")}
    entries = spark.createDataFrame([(p, k, "add", "2024-01-01") for k, p in patterns], "pattern string, kind string, action string, at string").withColumn("at", F.to_date("at"))
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id bigint, url string").withColumn("fetched_on", F.to_date(F.lit("2024-02-01")))
    rows = {r.page_id: (r.kind, r.pattern) if r.blocked else None for r in url_lists.as_of(pages, url_lists.intervals(entries)).collect()}
    for i, u in enumerate(urls):
        assert rows[i] == min(names_by_spelling(u) & patterns, default=None), u


def test_url_of_a_megabyte(spark):
    long = "http://host.example/" + "/".join("abcdefghij"[: 1 + i % 10] for i in range(160_000))
    many = "http://" + "a." * 20_000 + "end.example/p"
    assert len(long) > 1_000_000
    deep = "host.example/" + "/".join("abcdefghij"[: 1 + i % 10] for i in range(50))
    entries = spark.createDataFrame([(deep, "prefix", "add", "2024-01-01"), ("end.example", "domain", "add", "2024-01-01")], "pattern string, kind string, action string, at string").withColumn("at", F.to_date("at"))
    pages = spark.createDataFrame([(1, long), (2, many), (3, long + "?x"), (4, "http://host.example/b")], "page_id bigint, url string").withColumn("fetched_on", F.to_date(F.lit("2024-02-01")))
    began = time.time()
    got = {r.page_id: r.pattern for r in url_lists.as_of(pages, url_lists.intervals(entries)).collect()}
    assert got == {1: deep, 2: "end.example", 3: deep, 4: None}
    assert time.time() - began < 60


# ------------------------------------------------------------- 8 html


def texts(page):
    return [t for _, t, _ in html_extract.blocks(page)]


@pytest.mark.parametrize(
    "page, want",
    [
        ("<p>a</p><svg><g><p>b</p>c", ["a", "b", "c"]),
        ("<div><svg><path d='x'/><text>no</text></div><p>b</p>", ["b"]),
        ("<svg><text>no</text></svg><p>b</p>", ["b"]),
        ("<p>a</p><option>b</option><p>c</p>", ["a", "b", "c"]),
        ("<map name=m><p>in map</p><area></map>tail", ["in map", "tail"]),
        ("<p>a<noscript><p>b</p>", ["a", "b"]),
        ("<p>a</p><noscript><div>no</div></noscript><p>b</p>", ["a", "b"]),
        ("<iframe src=x><p>b</p>", ["b"]),
        ("<div><select><option>no</div><p>b</p><select><option>no</select>c", ["b", "c"]),
        ("<object><object>no</object>no</object>yes", ["yes"]),
        ("<article><video><p>no</article><p>yes</p><video></video>", ["yes"]),
        ("<template><p>no</p></template><canvas>no</canvas>yes", ["yes"]),
        ("a<title>no", ["a"]),
    ],
)
def test_unrendered_elements_end(page, want):
    assert texts(page) == want


def test_sample_is_bounded_whatever_the_copies(spark):
    pages = spark.range(0, 3000).select(F.col("id").alias("page_id"), F.concat(F.lit("<p>"), F.col("id").cast("string")).alias("html"))
    small = html_extract.sample_of(pages, n=20)
    keys = pages.select(F.xxhash64("page_id", "html").alias("k"), "html").orderBy("k").limit(20).collect()
    assert list(small) == [r.html for r in keys]
    copies = spark.range(0, 3000).select(F.lit(7).cast("bigint").alias("page_id"), F.lit("<p>x").alias("html"))
    assert html_extract.sample_of(copies, n=20) == ("<p>x",)
    mixed = copies.unionByName(pages.where("page_id < 30"))
    assert len(html_extract.sample_of(mixed, n=20)) == 20
    big = pages.limit(3).withColumn("html", F.repeat("html", 100_000))
    assert html_extract.sample_of(big, n=20) == () and html_extract.sample_of(pages.where("false")) == ()
