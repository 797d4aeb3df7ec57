"""Stateful operators: token buckets, time-limited cache, upserts and derivation upkeep; in batches and in streams."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Capacity and refill per second by source.
BUCKETS = {"arxiv": (1.0, 1 / 3), "semanticscholar": (1.0, 1.0), "openalex": (10.0, 10.0), "github": (5.0, 1.39), "crossref": (5.0, 5.0)}
PARSER_VERSION = "3"


def buckets(spark, limits: dict = BUCKETS) -> DataFrame:
    return spark.createDataFrame([(k, float(c), float(r)) for k, (c, r) in limits.items()], "source string, capacity double, refill double")


def _after(tokens: float | None, gap: float, capacity: float, refill: float) -> tuple[float, float]:
    """(wait, tokens left) of a request gap seconds after the state of tokens; None: a full bucket."""
    have = capacity if tokens is None else min(capacity, tokens + gap * refill)
    return ((1 - have) / refill if have < 1 else 0.0), max(0.0, have - 1)


def _stretches(batches):
    """For each stretch of a source in a part: first and last time, and what the requests after its first do to the tokens.

    A request turns t into clip(t + gain - 1, 0, capacity - 1); such functions compose to clip(t + s, low, high).
    """
    from pyspark import TaskContext
    import pandas as pd

    part, now = TaskContext.get().partitionId(), None
    done = []
    for frame in batches:
        for source, us, capacity, refill in frame[["source", "us", "capacity", "refill"]].itertuples(index=False):
            if now is None or now["source"] != source:
                now = {"part": part, "source": source, "first": us, "last": us, "s": 0.0, "low": float("-inf"), "high": float("inf"), "capacity": capacity, "refill": refill}
                done.append(now)
                continue
            gain = (us - now["last"]) / 1e6 * refill - 1
            clip = lambda x, top=capacity - 1: min(top, max(0.0, x))
            now |= {"last": us, "s": now["s"] + gain, "low": clip(now["low"] + gain), "high": clip(now["high"] + gain)}
    yield pd.DataFrame(done, columns=["part", "source", "first", "last", "s", "low", "high", "capacity", "refill"])


def token_waits(requests: DataFrame, limits: DataFrame) -> DataFrame:
    """requests (source, ts: timestamp, seq) to (source, ts, seq, wait, tokens): seconds to wait, and tokens left.

    Requests take effect in order of (ts, seq). The clamp to capacity is no window sum, but clamped steps compose: parts
    of each bucket's time line are summed up at once, the few sums are chained, and all parts are replayed from their
    starts, so no bucket is held in one task.
    """
    import pandas as pd

    from ..sources.landing import shared_checkpoints

    spark = requests.sparkSession
    shared_checkpoints(spark)
    rows = requests.join(F.broadcast(limits), "source").select("source", "ts", F.unix_micros("ts").alias("us"), F.col("seq").cast("long").alias("seq"), "capacity", "refill")
    dealt = rows.repartitionByRange("source", "us", "seq").sortWithinPartitions("source", "us", "seq").checkpoint()
    parts = dealt.mapInPandas(_stretches, "part int, source string, first long, last long, s double, low double, high double, capacity double, refill double")
    starts: dict[tuple[int, str], tuple[float | None, int]] = {}
    state: dict[str, tuple[float, int]] = {}
    for r in parts.orderBy("source", "part").collect():  # one row for each part of a bucket
        tokens, last = state.get(r.source, (None, r.first))
        starts[r.part, r.source] = (tokens, last)
        t = _after(tokens, (r.first - last) / 1e6, r.capacity, r.refill)[1]
        state[r.source] = (min(r.high, max(r.low, t + r.s)), r.last)

    def replay(batches):
        from pyspark import TaskContext

        part, own, tokens, last = TaskContext.get().partitionId(), None, None, 0
        for frame in batches:
            out = []
            for source, ts, us, seq, capacity, refill in frame[["source", "ts", "us", "seq", "capacity", "refill"]].itertuples(index=False):
                if source != own:
                    own, (tokens, last) = source, starts[part, source]
                wait, tokens = _after(tokens, (us - last) / 1e6, capacity, refill)
                last = us
                out.append((source, ts, seq, wait, tokens))
            yield pd.DataFrame(out, columns=["source", "ts", "seq", "wait", "tokens"])

    return dealt.mapInPandas(replay, "source string, ts timestamp, seq long, wait double, tokens double")


def token_waits_stream(requests: DataFrame, capacity: float, refill: float) -> DataFrame:
    """The same over a stream of (source, ts, seq): the bucket of each source is kept as state."""
    import pandas as pd

    def step(key, frames: Iterator[pd.DataFrame], state):
        tokens, last = state.get if state.exists else (None, None)
        for frame in frames:
            out = []
            for ts, seq in frame.sort_values(["ts", "seq"])[["ts", "seq"]].itertuples(index=False):
                us = ts.value // 1000
                wait, tokens = _after(tokens, 0.0 if last is None else (us - last) / 1e6, capacity, refill)
                last = us
                out.append((key[0], ts, seq, wait, tokens))
            yield pd.DataFrame(out, columns=["source", "ts", "seq", "wait", "tokens"])
        state.update((tokens, last))

    return requests.groupBy("source").applyInPandasWithState(step, "source string, ts timestamp, seq long, wait double, tokens double", "tokens double, last long", "append", "NoTimeout")


def ttl_lookups(puts: DataFrame, gets: DataFrame) -> DataFrame:
    """puts (key, ts, expires_at, body) and gets (key, ts, seq) to gets with hit and body.

    A get sees the last put at or before it, of its key; it is a hit if that has no expiry or one not before the get.
    One pass over both in order of time stands for an as-of join.
    """
    a = puts.select("key", "ts", F.lit(0).alias("late"), F.lit(None).cast("long").alias("seq"), F.struct("expires_at", "body").alias("put"))
    b = gets.select("key", "ts", F.lit(1).alias("late"), F.col("seq").cast("long").alias("seq"), F.lit(None).cast(a.schema["put"].dataType).alias("put"))
    before = Window.partitionBy("key").orderBy("ts", "late").rowsBetween(Window.unboundedPreceding, 0)
    rows = a.unionByName(b).withColumn("seen", F.last("put", ignorenulls=True).over(before)).where("late = 1")
    hit = F.col("seen").isNotNull() & (F.col("seen.expires_at").isNull() | (F.col("seen.expires_at") >= F.col("ts")))
    return rows.select("key", "ts", "seq", hit.alias("hit"), F.when(hit, F.col("seen.body")).alias("body"))


def last_writer_wins(rows: DataFrame, key: list[str], seq: str) -> DataFrame:
    """Each key's row of the largest seq; rows without one lose to others."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(F.col(seq).isNotNull(), seq)).alias("x")).select(*key, "x.*").select(*rows.columns)


def coalesce_upsert(base: DataFrame, delta: DataFrame, key: list[str], seq: str, always: list[str] = ()) -> DataFrame:
    """base updated by the last delta row of each key, in which null doesn't overwrite except in the columns always taken."""
    new = last_writer_wins(delta, key, seq).drop(seq)
    columns = [c for c in base.columns if c not in key]
    joined = base.withColumn("was", F.lit(True)).alias("b").join(new.withColumn("comes", F.lit(True)).alias("d"), key, "full_outer")
    pick = lambda c: F.when(F.col("d.comes"), F.col(f"d.{c}")).otherwise(F.col(f"b.{c}")) if c in always else F.coalesce(f"d.{c}", f"b.{c}")
    return joined.select(*key, *(pick(c).alias(c) for c in columns))


def rederived(old: DataFrame, fresh: DataFrame, papers: DataFrame) -> DataFrame:
    """Components or claims after papers were parsed anew: their deterministic rows are replaced, others are kept."""
    stale = F.col("source") == "DETERMINISTIC"
    kept = old.where(~stale).unionByName(old.where(stale).join(papers.select("paper_version").distinct(), "paper_version", "left_anti"))
    return kept.unionByName(fresh)


def to_parse(versions: DataFrame, wanted: DataFrame, parser: str = PARSER_VERSION) -> DataFrame:
    """wanted (paper_version) that must be parsed: not there, or of another parser and from LaTeX."""
    served = versions.where((F.col("parser_version") == parser) | (F.col("source_kind") != "LATEX"))
    return wanted.join(served.select("paper_version"), "paper_version", "left_anti")


def to_index(snapshots: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (repo_id, commit_sha) that no snapshot holds; a snapshot never changes."""
    return wanted.join(snapshots.select("repo_id", "commit_sha"), ["repo_id", "commit_sha"], "left_anti")


_BUCKET = "key_bucket"


def _buckets(spark, path: str):
    from ..plans.publish import Published

    return Published(spark, path, {"rows": [_BUCKET]})


def upserted(spark, path: str) -> DataFrame | None:
    """The rows that a stream of upserts has left so far, as of its last whole batch; None before the first."""
    rows = _buckets(spark, path).read("rows")
    return None if rows is None else rows.drop(_BUCKET)


def upsert_stream(stream: DataFrame, path: str, key: list[str], seq: str, checkpoint: str, buckets: int = 256):
    """Starts a query that keeps the last row of each key of a stream under a folder; upserted reads it.

    Keys are dealt into buckets by hash. A batch reads and writes the buckets of its own keys only, and all of them count
    at once, so what is written follows the batch, and a batch that is repeated after a failure leaves the same rows. Rows
    that a reader has begun on stay for one more batch. buckets mustn't change under a folder in use.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        tables = _buckets(spark, path)
        rows = batch.withColumn(_BUCKET, F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("string")).persist()
        hit = [r[0] for r in rows.select(_BUCKET).distinct().collect()]  # as many as buckets at most
        if hit:
            old = tables.read("rows", tables.valid().where(F.col("key").isin(hit)))
            new = rows if old is None else old.where(F.col(_BUCKET).isin(hit)).unionByName(rows)
            run = tables.new_run()
            tables.write(run, "rows", last_writer_wins(new, [_BUCKET, *key], seq))
            tables.publish(spark.createDataFrame([(b, str(number), run) for b in hit], "key string, stamp string, run string"))
            tables.clear()
        rows.unpersist()

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).outputMode("update").start()
