import os

from pyspark.sql import functions as F

from hashlode.functions import net as N
from hashlode.functions.text import blank
from hashlode.operators import enrich, lookup
from hashlode.operators import registry as R
from hashlode.operators import retention as K
from hashlode.operators.dedupe import rolling_dedup
from hashlode.streaming import flows

COLUMNS = "info_hash string, title string, magnet string, seeders long, info_b64 string, first_seen_ms long, last_seen_ms long"


def test_merge_is_idempotent(spark):
    old = spark.createDataFrame([("a", "t", None, 3, None, 5, 9)], COLUMNS)
    new = spark.createDataFrame([("a", " ", "m", 1, "x", 7, 12), ("b", None, None, 0, None, 1, 1)], COLUMNS)
    once = R.merge(old, new)
    assert sorted(map(tuple, once.collect())) == [("a", "t", "m", 3, "x", 5, 12), ("b", None, None, 0, None, 1, 1)]
    assert sorted(map(tuple, R.merge(once, new).collect())) == sorted(map(tuple, once.collect()))


def test_retention_boundaries(spark):
    now = 1_000_000
    rows = [("ttl", None, None, 9, None, 0, now - 100_000), ("young", None, None, 9, None, 0, now - 99_999), ("edge", None, None, 1, None, now - 50_000, now), ("low", None, None, 1, None, now - 50_001, now)]
    reg = spark.createDataFrame(rows, COLUMNS)
    got = {r.info_hash: r.action for r in K.sweep(reg, now, 100, 50).collect()}
    assert got == {"ttl": "ttl", "young": "keep", "edge": "keep", "low": "low_seed"}
    assert {r.info_hash: r.action for r in K.sweep(reg, now, 100, 50, batch=1).collect()} == got
    capped = {r.info_hash: r.action for r in K.sweep(reg, now, 100, 50, most=1).collect()}
    assert capped == got | {"young": "cap"}


def test_rolling_dedup(spark):
    b = 900_000
    ms = [0, 10, b, 2 * b + 1, 3 * b, 7 * b]
    got = sorted(r.bucket for r in rolling_dedup(spark.createDataFrame([("a", x) for x in ms], "info_hash string, ms long")).collect())
    assert got == [0, 2, 7]


def test_addresses(spark):
    ips = {"10.1.2.3": (False, False), "8.8.8.8": (True, True), "169.254.1.1": (False, True), "224.0.0.1": (False, True), "198.19.0.1": (False, True), "198.20.0.1": (True, True), "0.0.0.0": (False, False), "172.32.0.1": (True, True), "1.2.3.999": (False, False)}
    df = spark.createDataFrame([(k,) for k in ips], "ip string").withColumn("n", N.v4_number(F.col("ip")))
    none = F.lit(None).cast("string")
    got = {r.ip: (r.a, r.b) for r in df.select("ip", N.routable(F.col("n"), none).alias("a"), N.reachable_peer(F.col("n"), none, F.lit(1)).alias("b")).collect()}
    assert got == ips


def test_pieces_short_and_missing(spark):
    p = spark.createDataFrame([(1, 0, 1, b"abcd"), (1, 0, 2, b"AB"), (1, 2, 1, b"zz")], "key long, idx int, seq int, data binary")
    t = spark.createDataFrame([(1, 9), (2, 0)], "key long, total long")
    got = {r.key: bytes(r.payload) for r in R.assemble_pieces(p, t, 4).collect()}
    assert got == {1: b"AB\0\0\0\0\0\0z", 2: b""}


def test_white_space_of_any_kind_is_blank(spark):
    rows = {None: True, "": True, "  ": True, "\t\n\r ": True, "\u00a0\u2003": True, " x\t": False}
    df = spark.createDataFrame([(k,) for k in rows], "s string").select("s", blank(F.col("s")).alias("b"))
    assert {r.s: r.b for r in df.collect()} == rows


def test_merge_ties_do_not_follow_row_order(spark):
    rows = [("h", x, x, 1, x, 1, 5) for x in ("b", "c", "a")]
    for order in (rows, rows[::-1], rows[1:] + rows[:1]):
        df = spark.createDataFrame(order, COLUMNS)
        assert [tuple(r) for r in R.merge(df, df.limit(0)).collect()] == [("h", "c", "c", 1, "c", 1, 5)]


def test_null_fields_survive_a_rewrite(spark):
    rows = [("h", None, 1, 2), ("g", 3, None, None)]
    df = spark.createDataFrame(rows, "info_hash string, seeders long, first_seen_ms long, last_seen_ms long")
    assert sorted(map(tuple, R.decode_values(R.encode_values(df).drop("info_hash")).collect()), key=str) == sorted(rows, key=str)


def test_one_answer_serves_one_request(spark):
    sent = spark.createDataFrame([("a", 0), ("a", 10), ("b", 0), ("b", 0), ("c", 0)], "tx string, sent_ms long")
    got = spark.createDataFrame([("a", 20), ("a", 25), ("b", 5), ("b", 900), ("c", 901)], "tx string, got_ms long")
    assert sorted(map(tuple, lookup.match_inflight(sent, got).collect())) == [("a", 10, 20), ("b", 0, 5)]


def test_answers_match_once_as_a_stream(spark, tmp_path):
    rows = [("a", 0, False), ("a", 10, False), ("a", 20, True), ("a", 25, True), ("b", 0, False), ("b", 5, True), ("b", 900, True), ("c", 0, False), ("c", 901, True)]
    spark.createDataFrame(rows, "tx string, ms long, is_answer boolean").withColumn("ts", F.timestamp_millis(F.col("ms") + 10**9)).coalesce(1).write.parquet(f"{tmp_path}/in")
    events = lambda: spark.readStream.schema("tx string, ms long, is_answer boolean, ts timestamp").parquet(f"{tmp_path}/in")
    out = flows.match_inflight_stream(events().where("NOT is_answer").withColumnRenamed("ts", "sent_ts"), events().where("is_answer").withColumnRenamed("ts", "got_ts"))
    out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/progress").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.parquet(f"{tmp_path}/out").select("tx", F.unix_millis("sent_ts") - 10**9, F.unix_millis("got_ts") - 10**9).collect()
    assert sorted(map(tuple, found)) == [("a", 10, 20), ("b", 0, 5)]


def test_cap_without_a_sort(spark):
    rows = [(f"{i * 7919 % 65537:040x}", None, None, 9, None, 0, i // 50 - 2) for i in range(1000)]
    df = spark.createDataFrame(rows, COLUMNS)
    want = sorted((max(r[6], 0), r[0]) for r in rows)
    for most in (1, 333, 999):
        out = K.over_cap(df, most)
        assert sorted((max(r.last_seen_ms, 0), r.info_hash) for r in out.collect()) == want[: 1000 - most]
        assert "Sort" not in out._jdf.queryExecution().toString() and "SinglePartition" not in out._jdf.queryExecution().toString()
    assert K.over_cap(df, 1000).count() == K.over_cap(df, 0).count() == 0


def test_stale_entries_are_counted(spark):
    swept = K.sweep(spark.createDataFrame([("a", None, None, 9, None, 0, 100), ("b", None, None, 9, None, 0, 0)], COLUMNS), 100_000, 50, 50)
    index = spark.createDataFrame([("a",), ("x",), ("y",)], "info_hash string")
    assert tuple(K.sweep_counters(swept, index).first()) == (2, 2, 0, 2)


def test_a_maintained_registry_is_swept_between_batches(spark, tmp_path):
    hour = 3_600_000
    batches = [[("old", 0, 9), ("kept", 0, 9)], [("kept", 20 * hour, 1), ("low", 10 * hour, 1)], [("kept", 30 * hour, 0), ("new", 31 * hour, 5)], [("old", 32 * hour, 2)], [("late", 33 * hour, 1)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "info_hash string, ms long, seeders long").coalesce(1).write.parquet(f"{tmp_path}/in/part={i}")
        os.utime(next((tmp_path / "in" / f"part={i}").glob("*.parquet")), (1000 + i, 1000 + i))
    seen = spark.readStream.schema("info_hash string, ms long, seeders long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/part=*")
    run = lambda: flows.maintain_registry(seen, f"{tmp_path}/reg", f"{tmp_path}/progress", 24 * 3600, 12 * 3600, every=2, availableNow=True).awaitTermination()
    run()
    got = sorted(map(tuple, flows.read_maintained(spark, f"{tmp_path}/reg").select("info_hash", "first_seen_ms", "last_seen_ms", "seeders").collect()))
    # after batch 1 (20 h): low is in its grace; after batch 3 (32 h) low goes by it, and old came back before the sweep
    assert got == [("kept", 0, 30 * hour, 9), ("late", 33 * hour, 33 * hour, 1), ("new", 31 * hour, 31 * hour, 5), ("old", 0, 32 * hour, 9)]
    assert sorted(p.name for p in (tmp_path / "reg" / "base").iterdir()) == ["upto=1", "upto=3"]
    assert sorted(p.name for p in (tmp_path / "reg" / "folds").glob("batch=*")) == ["batch=2", "batch=3", "batch=4"]


def test_answers_that_fail_leave_rows_as_they_are(spark):
    def fetch(h):
        if h == "bad":
            raise OSError(h)
        return None if h == "none" else b"d4:name2:  e" if h == "blank" else b"d4:name3:newe"

    reg = spark.createDataFrame([(h, "t", None, 3, None, 0, 0) for h in ("bad", "none", "blank", "good")], COLUMNS)
    out = enrich.apply_enriched(reg, enrich.enrich(R.worklist(reg), fetch, 2))
    got = {r.info_hash: (r.title, r.info_b64 is not None) for r in out.collect()}
    assert got == {"bad": ("t", False), "none": ("t", False), "blank": ("t", True), "good": ("new", True)} and out.columns == reg.columns
    assert enrich.enrich(reg.limit(0), fetch, 2).count() == 0
