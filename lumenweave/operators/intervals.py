"""Places and the spans around them, by one sweep over both in order."""

from __future__ import annotations

from functools import partial
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A range of places is 2**RANGE long; a span is dealt to each range that it reaches into.
RANGE = 12


def _sweep(by: list[str], schema: pa.Schema, batches):
    """Rows in order of key, range, place, spans before places: the open spans lie in a heap by rank."""
    key, heap = None, []
    for b in batches:
        out = []
        for row in zip(*(b.column(c).to_pylist() for c in (*by, "range", "at", "span", "last", "rank", "value"))):
            own, at, (is_span, last, rank, value) = row[: len(by) + 1], row[len(by) + 1], row[len(by) + 2 :]
            if own != key:
                key, heap = own, []
            if is_span:
                heappush(heap, (rank, value, last))
                continue
            first = second = None
            held = []
            while heap and second is None:
                top = heap[0]
                if top[2] < at:
                    heappop(heap)
                elif first is None or top[1] == first:
                    first = top[1]
                    held.append(heappop(heap))
                else:
                    second = top[1]
            for x in held:
                heappush(heap, x)
            if first is not None:
                out.append((*own[:-1], at, first, second))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * len(schema), schema.types)], schema=schema)


def around(places: DataFrame, spans: DataFrame, by: list[str], at: str) -> DataFrame:
    """places (by, at) to (by, at, first, second): of the spans around each place that of the least rank, and the next of another value.

    spans: by, start, last (both inside), rank (long), value; of equal ranks the smaller value comes first. Keys are
    strings, places whole numbers. Each distinct place comes once, places that no span holds don't, and null places or
    keys lie in none. Places and spans are dealt by key and range of places, so a long key is many tasks, and nothing is
    paired: a place costs the spans that close before it.
    """
    spots = places.select(*by, F.col(at).cast("long").alias("at")).distinct()
    none = lambda kind: F.lit(None).cast(kind)
    a = spots.select(*by, F.shiftright("at", RANGE).alias("range"), "at", F.lit(False).alias("span"), none("long").alias("last"), none("long").alias("rank"), none("string").alias("value"))
    s = spans.where("start <= last").select(*by, F.col("start").cast("long").alias("start"), F.col("last").cast("long").alias("last"), F.col("rank").cast("long").alias("rank"), "value")
    s = s.select("*", F.explode(F.sequence(F.shiftright("start", RANGE), F.shiftright("last", RANGE))).alias("range"))
    s = s.select(*by, "range", F.greatest("start", F.shiftleft("range", RANGE)).alias("at"), F.lit(True).alias("span"), "last", "rank", "value")
    rows = a.unionByName(s).where(" and ".join(f"{c} is not null" for c in (*by, "at")))
    dealt = rows.repartition(*by, "range").sortWithinPartitions(*by, "range", "at", F.desc("span"))
    schema = pa.schema([*((c, pa.string()) for c in by), ("at", pa.int64()), ("first", pa.string()), ("second", pa.string())])
    found = dealt.mapInArrow(partial(_sweep, by, schema), ", ".join([*(f"{c} string" for c in by), "at long", "first string", "second string"]))
    return found.select(*by, F.col("at").cast(places.schema[at].dataType).alias(at), "first", "second")
