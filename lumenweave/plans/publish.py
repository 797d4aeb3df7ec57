"""Tables written in runs and made visible at once: a list names, for each key, the run whose rows count.

A run writes the rows of its keys (papers, repositories, pairs of both) into a folder of its own, table by table. Then one
write of the list makes them count, for all tables together; until then, and if a run stops halfway, readers see what was
there. The list is a small Parquet table, one for each turn; the last complete one holds.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LIST = "key string, stamp string, run string"


class Published:
    """Tables under a root folder. keys: table to the columns that make up its key, joined by |."""

    def __init__(self, spark: SparkSession, root: str, keys: dict[str, list[str]]):
        self.spark, self.root, self.keys = spark, root.rstrip("/"), keys
        self._hadoop = spark._jvm.org.apache.hadoop.fs

    def _files(self, path: str):
        p = self._hadoop.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, folder: str) -> list[str]:
        files, path = self._files(f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in files.listStatus(path)) if files.exists(path) else []

    def _complete(self, path: str) -> bool:
        files, p = self._files(f"{path}/_SUCCESS")
        return files.exists(p)

    def turn(self) -> int:
        """The number of the last complete list, 0 if there is none."""
        turns = [int(n.removeprefix("turn=")) for n in self._names("valid")]
        return max((t for t in turns if self._complete(f"{self.root}/valid/turn={t}")), default=0)

    def valid(self, turn: int | None = None) -> DataFrame:
        """The list (key, stamp, run) of a turn, of the last one if none is named."""
        turn = self.turn() if turn is None else turn
        return self.spark.read.schema(LIST).parquet(f"{self.root}/valid/turn={turn}") if turn else self.spark.createDataFrame([], LIST)

    def new_run(self) -> str:
        return uuid.uuid4().hex

    def write(self, run: str, name: str, rows: DataFrame) -> None:
        """The rows of a run's keys in a table, ordered by key; a repeated write of the same run replaces them."""
        key = F.concat_ws("|", *self.keys[name])
        rows.withColumn("_key", key).repartition("_key").sortWithinPartitions("_key").drop("_key").write.mode("overwrite").parquet(f"{self.root}/runs/{run}/{name}")

    def read(self, name: str, valid: DataFrame | None = None) -> DataFrame | None:
        """A table as a list has it, the published one if none is given; None if no run has written it."""
        valid = self.valid() if valid is None else valid
        runs = [r.run for r in valid.select("run").distinct().collect()]  # one for each run that still counts
        runs = [r for r in sorted(runs) if self._complete(f"{self.root}/runs/{r}/{name}")]
        if not runs:
            return None
        parts = [self.spark.read.parquet(f"{self.root}/runs/{r}/{name}").withColumn("_run", F.lit(r)) for r in runs]
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        on = valid.select(F.col("key").alias("_key"), F.col("run").alias("_run"))
        return rows.withColumn("_key", F.concat_ws("|", *self.keys[name])).join(on, ["_key", "_run"], "left_semi").drop("_key", "_run")

    def planned(self, entries: DataFrame, base: DataFrame) -> DataFrame:
        """A list with the entries (key, stamp, run) in place of those of the same keys."""
        return base.join(entries.select("key"), "key", "left_anti").unionByName(entries.select("key", "stamp", "run"))

    def publish(self, entries: DataFrame) -> int:
        """Makes the runs of entries count for their keys; the new turn. Two at a time: the second fails and sees the first's list when run again."""
        turn = self.turn()
        self.planned(entries, self.valid(turn)).coalesce(1).write.mode("error").parquet(f"{self.root}/valid/turn={turn + 1}")
        return turn + 1

    def clear(self, keep: int = 2) -> list[str]:
        """Removes lists but the last ones, and runs that no list left names, such as those of a run that stopped; their names."""
        turn = self.turn()
        old = [n for n in self._names("valid") if int(n.removeprefix("turn=")) <= turn - keep]
        lists = [self.valid(t) for t in range(max(1, turn - keep + 1), turn + 1)]
        named = {r.run for x in lists for r in x.select("run").distinct().collect()}
        unused = [r for r in self._names("runs") if r not in named]
        for path in (*(f"valid/{n}" for n in old), *(f"runs/{r}" for r in unused)):
            files, p = self._files(f"{self.root}/{path}")
            files.delete(p, True)
        return unused
