"""Stateful operators, in batches and streams."""

import datetime as dt
import random

from pyspark.sql import functions as F

from lumenweave.streaming import state

START = dt.datetime(2024, 1, 1)


def plain(requests, capacity, refill):
    out, tokens, last = {}, None, None
    for ts, seq in sorted(requests):
        have = capacity if tokens is None else min(capacity, tokens + (ts - last).total_seconds() * refill)
        out[seq] = ((1 - have) / refill if have < 1 else 0.0, max(0.0, have - 1))
        tokens, last = max(0.0, have - 1), ts
    return out


def requests(n, seed):
    r = random.Random(seed)
    return [(r.choice("aaab"), START + dt.timedelta(seconds=r.randrange(4000)), i) for i in range(n)]


def test_token_bucket(spark):
    rows = requests(500, 1)
    df = spark.createDataFrame(rows, "source string, ts timestamp, seq long")
    got = {r.seq: (r.wait, r.tokens) for r in state.token_waits(df, state.buckets(spark, {"a": (3, 1 / 30), "b": (1, 1 / 50)})).collect()}
    want = plain([(t, s) for k, t, s in rows if k == "a"], 3, 1 / 30) | plain([(t, s) for k, t, s in rows if k == "b"], 1, 1 / 50)
    assert got.keys() == want.keys()
    assert all(abs(got[k][0] - want[k][0]) < 1e-6 and abs(got[k][1] - want[k][1]) < 1e-6 for k in want)


def test_second_call_waits(spark):
    rows = [("arxiv", START, 0), ("arxiv", START + dt.timedelta(milliseconds=100), 1)]
    got = [r.wait for r in state.token_waits(spark.createDataFrame(rows, "source string, ts timestamp, seq long"), state.buckets(spark)).orderBy("seq").collect()]
    assert got[0] == 0 and 2 < got[1] < 3


def test_token_bucket_stream(spark, tmp_path):
    rows = requests(120, 2)
    folder = str(tmp_path / "in")
    spark.createDataFrame(rows, "source string, ts timestamp, seq long").coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema("source string, ts timestamp, seq long").parquet(folder)
    q = state.token_waits_stream(stream, 3.0, 1 / 30).writeStream.format("memory").queryName("waits").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.seq: r.wait for r in spark.table("waits").collect()}
    want = {}
    for k in "ab":
        want |= {s: w for s, (w, _) in plain([(t, s) for x, t, s in rows if x == k], 3, 1 / 30).items()}
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_cache(spark):
    at = lambda m: START + dt.timedelta(minutes=m)
    puts = spark.createDataFrame([("k", at(0), at(10), "old"), ("k", at(20), None, "new"), ("other", at(0), None, "x")], "key string, ts timestamp, expires_at timestamp, body string")
    gets = spark.createDataFrame([("k", at(-1), 0), ("k", at(10), 1), ("k", at(11), 2), ("k", at(20), 3), ("none", at(5), 4)], "key string, ts timestamp, seq long")
    assert {r.seq: r.body for r in state.ttl_lookups(puts, gets).collect()} == {0: None, 1: "old", 2: None, 3: "new", 4: None}


def run_stream(spark, folder, out, checkpoint, buckets=256):
    stream = spark.readStream.schema("id int, v string, seq int").option("maxFilesPerTrigger", 1).parquet(folder)
    q = state.upsert_stream(stream, out, ["id"], "seq", checkpoint, buckets)
    q.processAllAvailable()
    q.stop()


def test_upsert_stream(spark, tmp_path):
    folder, out, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    assert state.upserted(spark, out) is None
    rows = [(i % 7, f"v{i}", i) for i in range(50)] + [(None, "null key", 3), (3, "no seq", None)]
    spark.createDataFrame(rows, "id int, v string, seq int").repartition(5).write.parquet(folder)
    run_stream(spark, folder, out, checkpoint, 4)
    got = {r.id: r.v for r in state.upserted(spark, out).collect()}
    assert got == {i: f"v{max(n for n in range(50) if n % 7 == i)}" for i in range(7)} | {None: "null key"}


def test_upsert_stream_writes_what_a_batch_hits(spark, tmp_path):
    folder, out, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    spark.createDataFrame([(i, "old", 0) for i in range(5000)], "id int, v string, seq int").coalesce(1).write.parquet(folder)
    run_stream(spark, folder, out, checkpoint)
    before = {p: p.stat().st_size for p in (tmp_path / "out/runs").rglob("*.parquet")}
    spark.createDataFrame([(17, "new", 1), (17, "older", -1), (9999, "more", 0)], "id int, v string, seq int").coalesce(1).write.mode("append").parquet(folder)
    run_stream(spark, folder, out, checkpoint)
    after = {p: p.stat().st_size for p in (tmp_path / "out/runs").rglob("*.parquet")}
    assert before.items() <= after.items()
    new = [p for p in after if p not in before]
    assert 0 < sum(spark.read.parquet(str(p)).count() for p in new) < 150
    got = {r.id: r.v for r in state.upserted(spark, out).collect()}
    assert got == {i: "old" for i in range(5000)} | {17: "new", 9999: "more"}


def test_upserts(spark):
    base = spark.createDataFrame([(1, "a", "x"), (2, "b", None)], "id int, title string, doi string")
    delta = spark.createDataFrame([(1, None, None, 5), (1, "z", "y", 4), (3, "c", "w", 1)], "id int, title string, doi string, seq int")
    got = {r.id: (r.title, r.doi) for r in state.coalesce_upsert(base, delta, ["id"], "seq", always=["title"]).collect()}
    assert got == {1: (None, "x"), 2: ("b", None), 3: ("c", "w")}


def test_work_lists(spark):
    snaps = spark.createDataFrame([("r", "s1")], "repo_id string, commit_sha string")
    want = spark.createDataFrame([("r", "s1"), ("r", "s2")], "repo_id string, commit_sha string")
    assert [r.commit_sha for r in state.to_index(snaps, want).collect()] == ["s2"]
    v = spark.createDataFrame([("p1v1", "3", "LATEX"), ("p2v1", "2", "LATEX"), ("p3v1", "2", "PDF")], "paper_version string, parser_version string, source_kind string")
    asked = v.select("paper_version").union(spark.createDataFrame([("p4v1",)], "x string"))
    assert sorted(r[0] for r in state.to_parse(v, asked).select(F.col("paper_version")).collect()) == ["p2v1", "p4v1"]
