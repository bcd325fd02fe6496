from pyspark.sql import functions as F

from galerna.llm import urls, warc
from galerna.llm.queries import op6_warc

RULES = [urls.Rule("block", "net"), urls.Rule("allow", "example.net", "/en/"), urls.Rule("block", "example.com", "/de/")]
URLS = [
    (1, "http://A.Example.NET/en/x?q#f", "a.example.net", "/en/x", "example.net/en/", "allow"), (2, "https://example.net", "example.net", "", None, "allow"),
    (3, "x://badexample.com/de/", "badexample.com", "/de/", None, "allow"), (4, "http://w.example.com/de/1", "w.example.com", "/de/1", "example.com/de/", "block"),
    (5, None, "", "", None, "allow"), (6, "no scheme/net/", "", "", None, "allow"), (7, "http://host7.org?x=/a", "host7.org", "", None, "block"),
    (8, "a://b://c/d", "b:", "//c/d", None, "allow"), (9, "http://z.net/\nline", "z.net", "/\nline", "net/", "block"),
]


def hosts(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "key string")


def test_rules_and_edges(spark):
    df = spark.createDataFrame([(u[0], u[1], "x") for u in URLS] * 2, "page_id long, url string, host string")
    listed = hosts(spark, "host7.org", "host7.org", "never.seen", None)
    rows = urls.judge(df, RULES, listed).collect()
    assert sorted((r.page_id, r.host, r.path, str(r.rule), r.verdict) for r in rows) == sorted((*(u[0], *u[2:4], str(u[4])), u[5]) for u in URLS * 2)
    assert urls.judge(df.limit(0), RULES, listed).count() == 0
    assert urls.judge(df, [], hosts(spark)).filter("verdict = 'block'").count() == 0


def test_cascade_is_exact(spark, monkeypatch):
    universe = spark.range(20_000).select(F.concat(F.lit("host"), F.col("id")).alias("key"), (F.col("id") % 7 == 0).alias("listed"))
    listed = universe.filter("listed").select("key")
    rows = universe.unionByName(universe.filter("key = 'host7'").crossJoin(spark.range(3000)).drop("id"))  # a hot host

    def wrong(cascade):
        marked = cascade.mark(rows, "key", "__in")
        assert marked.count() == 23_000
        return marked.filter("__in <> listed").count()

    one = urls.Cascade.fit(universe, listed)
    assert one.shards == 1 and one.filters.count() > 1 and wrong(one) == 0
    monkeypatch.setattr(urls, "SHARD_KEYS", 3000)
    several = urls.Cascade.fit(universe, listed)
    assert several.shards == 7 and wrong(several) == 0
    monkeypatch.setattr(urls, "MAX_FILTER_BYTES", 100)  # filters that are not sent to all tasks
    monkeypatch.setattr(urls, "PART_ROWS", 500)
    assert wrong(several) == 0


def test_keys_that_no_hash_tells_apart(spark, monkeypatch):
    plain = urls._hashes
    same = ("host14", "host15", "host22")  # one of them is listed

    def forced(key):
        return [F.when(key.isin(*same), F.lit(5).cast("long")).otherwise(h) for h in plain(key)]

    monkeypatch.setattr(urls, "_hashes", forced)
    universe = spark.range(300).select(F.concat(F.lit("host"), F.col("id")).alias("key"), (F.col("id") % 7 == 0).alias("listed"))
    cascade = urls.Cascade.fit(universe, universe.filter("listed").select("key"))
    assert cascade.filters.filter("number < 0").count() == 1
    assert cascade.mark(universe, "key", "__in").filter("__in <> listed").count() == 0
    monkeypatch.setattr(urls, "MAX_FILTER_BYTES", 0)
    assert cascade.mark(universe, "key", "__in").filter("__in <> listed").count() == 0


def test_hashes_are_independent(spark):
    a, b = (spark.range(5).select(h.alias("h")).collect() for h in urls._hashes(F.col("id").cast("string")))
    assert all(x != y for x, y in zip(a, b))
    # the second is no function of the key's own 64-bit hash: the literal seeds it
    own = spark.range(1).select(F.xxhash64(F.lit("k")).alias("x"), F.hash(F.lit("k")).alias("y"), *(h.alias(n) for h, n in zip(urls._hashes(F.lit("k")), "ab"))).head()
    assert own.x not in (own.a, own.b)


def test_audit_finds_every_difference(spark):
    rows = [(k, f"record {k} " * (k % 9 + 1)) for k in range(3000)] + [(5000, None)]
    good = spark.createDataFrame(rows, "key long, payload string").withColumn("record", warc.response_record(F.lit("http://x/"), F.col("payload")))
    placed = warc.lay_out(good, "key", 3).cache()
    assert placed.count() == 3001 and placed.select("file", "offset").distinct().count() == 3001
    changed, lost = {17, 900, 901, 2999}, {5, 1200}
    bad = placed.filter(~F.col("key").isin(*lost)).withColumn("leaf", F.when(F.col("key").isin(*changed), F.lit("0")).otherwise(F.col("leaf")))
    extra = spark.createDataFrame([(0, 10**9, "aa")], "file long, offset long, leaf string")
    ours = placed.select("file", "offset", "leaf")
    theirs = bad.select("file", "offset", "leaf").unionByName(extra)
    found = warc.audit(ours, theirs, range_bytes=1024, fanout=4).join(placed.select("file", "offset", "key"), ["file", "offset"], "left").collect()
    assert {(r.key, r.status) for r in found} == {(k, "changed") for k in changed} | {(k, "missing") for k in lost} | {(None, "added")}
    assert warc.audit(ours, ours).count() == 0
    assert warc.audit(ours.limit(0), ours.limit(0)).count() == 0
    assert {r.status for r in warc.audit(ours, ours.limit(0)).collect()} == {"missing"}


def test_pages_of_one_id_or_none_are_records_of_their_own(spark, tmp_path):
    rows = [(1, "http://a/", "x"), (1, "http://a/", "x"), (1, "http://b/", None), (None, "http://c/", "y"), (7, "http://d/", "z"), (13, "http://e/", "w"), (13, "http://e/", "w")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted((str(r.page_id), r.status) for r in op6_warc(spark, str(tmp_path)).collect())
    assert got == sorted([("1", "intact")] * 3 + [("None", "intact"), ("7", "missing"), ("13", "changed"), ("13", "changed")])
