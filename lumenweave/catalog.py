"""The graph's tables as Parquet folders: reading, replacing, upserting and adapting to a changed schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import PERMITTED, TABLES
from .streaming.state import coalesce_upsert, last_writer_wins


class Catalog:
    """Tables under a root folder, one folder each, partitioned where papers or snapshots are replaced as a whole."""

    #: Tables that are rewritten by paper version; other partitions stay.
    BY_PAPER = {"sections", "equations", "components", "algorithms", "stated_values", "declared_urls", "bib_entries", "citation_sites", "differences"}

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def read(self, name: str) -> DataFrame:
        """A table in its declared schema; a folder that isn't there is an empty table, and other columns are left out."""
        schema, _ = TABLES[name]
        empty = self.spark.createDataFrame([], schema)
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        if not hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop):
            return empty
        return adapt(self.spark.read.parquet(self.path(name)), name)

    def write(self, name: str, df: DataFrame) -> None:
        """Replaces the paper versions that df holds, or the whole table if it isn't kept by paper."""
        rows = adapt(df, name)
        if name in self.BY_PAPER:
            (rows.repartition("paper_version").write.mode("overwrite").partitionBy("paper_version").option("partitionOverwriteMode", "dynamic").parquet(self.path(name)))
        else:
            rows.write.mode("overwrite").parquet(self.path(name))

    def export_json(self, results: dict[str, DataFrame], root: str) -> None:
        """Results by tool (each with a paper_version) as lines of JSON under root/paper_version=<paper>/tool=<tool>; papers written before are replaced tool by tool."""
        for tool, rows in results.items():
            lines = rows.select("paper_version", F.lit(tool).alias("tool"), F.to_json(F.struct(*(c for c in rows.columns if c != "paper_version")), {"ignoreNullFields": "false"}).alias("value"))
            lines.repartition("paper_version").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("paper_version", "tool").text(root)

    def views(self) -> None:
        for name in TABLES:
            self.read(name).createOrReplaceTempView(name)


def adapt(df: DataFrame, name: str) -> DataFrame:
    """df in a table's declared columns: shared ones cast, new ones null; rows with values that aren't permitted go."""
    schema = df.sparkSession.createDataFrame([], TABLES[name][0]).schema
    have = set(df.columns)
    out = df.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))
    for (table, column), values in PERMITTED.items():
        if table == name:
            out = out.where(F.col(column).isNull() | F.col(column).isin(values))
    return out


def upsert(name: str, base: DataFrame, delta: DataFrame, seq: str) -> DataFrame:
    """base with the last row of delta for each key; papers keep known values where the new ones are null."""
    key = TABLES[name][1]
    if name == "papers":
        return coalesce_upsert(base, delta, key, seq, always=["title"])
    return last_writer_wins(base.withColumn(seq, F.lit(None).cast(delta.schema[seq].dataType)).unionByName(delta, allowMissingColumns=True), key, seq).drop(seq)
