"""Reproduction plans: what is known of each part of a paper in a repository, risks, and what can be verified."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.correlate import PAIR
from ..operators.grams import dealt

# Parts of a plan and the component kinds of each.
PARTS = {"dataset": ["dataset"], "preprocessing": ["preprocessing"], "architecture": ["architecture", "module"], "training": ["training", "loss", "optimizer"], "evaluation": ["evaluation", "inference"]}
STATUSES = ["KNOWN", "PARTIAL", "UNKNOWN"]


def with_status(rows: DataFrame, mappings: DataFrame) -> DataFrame:
    """Components or values of papers with the verdict on them in each repository of pairs, UNMAPPED where there is none."""
    m = mappings.select("paper_version", "repo", F.col("anchor_id").alias("id"), "status", "confidence")
    return dealt(rows).join(m, ["paper_version", "repo", "id"], "left").withColumns({"status": F.coalesce("status", F.lit("UNMAPPED")), "confidence": F.coalesce("confidence", F.lit("UNKNOWN"))})


def component_parts(components: DataFrame, mappings: DataFrame, pairs: DataFrame) -> DataFrame:
    """(paper_version, repo, part, status, n, n_matched): no components: UNKNOWN; all matched: KNOWN; else PARTIAL."""
    part = F.lit(None).cast("string")
    for name, kinds in PARTS.items():
        part = F.when(F.col("kind").isin(kinds), name).otherwise(part)
    rows = with_status(components.join(dealt(pairs), "paper_version"), mappings).withColumn("part", part).where("part is not null")
    n = rows.groupBy(*PAIR, "part").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "MATCHED").alias("n_matched"))
    every = pairs.select(*PAIR, F.explode(F.array(*map(F.lit, PARTS))).alias("part")).join(n, [*PAIR, "part"], "left").na.fill(0, ["n", "n_matched"])
    return every.withColumn("status", F.when(F.col("n") == 0, "UNKNOWN").when(F.col("n") == F.col("n_matched"), "KNOWN").otherwise("PARTIAL"))


def value_part(values: DataFrame, mappings: DataFrame, pairs: DataFrame) -> DataFrame:
    """Hyperparameters are never fully known: PARTIAL if any was located."""
    rows = with_status(values.join(dealt(pairs), "paper_version"), mappings)
    n = rows.groupBy(*PAIR).agg(F.count("*").alias("n"), F.count_if(F.col("status") == "MATCHED").alias("n_matched"))
    out = pairs.join(n, PAIR, "left").na.fill(0, ["n", "n_matched"])
    return out.select(*PAIR, F.lit("hyperparameters").alias("part"), "n", "n_matched", F.when(F.col("n_matched") > 0, "PARTIAL").otherwise("UNKNOWN").alias("status"))


def manifest_parts(dependencies: DataFrame, environment: DataFrame, pairs: DataFrame) -> DataFrame:
    """environment: both versions KNOWN, one PARTIAL; dependencies: all pinned KNOWN, else PARTIAL; nothing UNKNOWN."""
    n = (F.col("python").isNotNull().cast("int") + F.col("cuda").isNotNull().cast("int")).cast("long")
    e = pairs.join(environment, "repo", "left").withColumn("n", F.coalesce(n, F.lit(0)))
    e = e.select(*PAIR, F.lit("environment").alias("part"), "n", F.col("n").alias("n_matched"), F.when(F.col("n") > 1, "KNOWN").when(F.col("n") == 1, "PARTIAL").otherwise("UNKNOWN").alias("status"))
    d = dependencies.groupBy("repo").agg(F.count("*").alias("n"), F.count_if("pinned").alias("n_matched"))
    d = pairs.join(d, "repo", "left").na.fill(0, ["n", "n_matched"])
    d = d.select(*PAIR, F.lit("dependencies").alias("part"), "n", "n_matched", F.when(F.col("n") == 0, "UNKNOWN").when(F.col("n") == F.col("n_matched"), "KNOWN").otherwise("PARTIAL").alias("status"))
    return e.unionByName(d)


def verification(mappings: DataFrame) -> DataFrame:
    """Checks that verdicts support: located values, and absent components to be written and tested."""
    values = mappings.where("anchor_kind = 'stated_value' and status = 'MATCHED'").select(*PAIR, F.lit("value").alias("check"), F.concat("label", F.lit(" = "), "value_text").alias("subject"), F.col("site").alias("where"))
    parts = mappings.where("anchor_kind = 'component' and status = 'ABSENT'").select(*PAIR, F.lit("component").alias("check"), F.col("label").alias("subject"), F.lit(None).cast("string").alias("where"))
    return values.unionByName(parts)


def missing_information(mappings: DataFrame) -> DataFrame:
    """(paper_version, repo, anchor_id, item): what a reproduction would have to make up, each absent anchor and reason once."""
    return mappings.where("status = 'ABSENT'").select(*PAIR, "anchor_id", F.col("reasoning").alias("item")).distinct()


def expected_results(values: DataFrame, limit: int = 8) -> DataFrame:
    """Stated values that speak of accuracy or BLEU, the first of each paper by line."""
    says = lambda c: F.lower(F.coalesce(c, F.lit(""))).rlike("accuracy|bleu")
    rows = values.where(says(F.col("symbol")) | says(F.col("context")))
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("paper_version").orderBy("src_line", "ordinal"))).where(F.col("n") <= limit)


def risks(differences: DataFrame) -> DataFrame:
    """Differences as risks, placed by severity."""
    return differences.withColumn("place", F.row_number().over(Window.partitionBy(*PAIR).orderBy("severity_order", "kind", "subject")))


def readiness(parts: DataFrame) -> DataFrame:
    """How many parts of each plan are known, partly known and unknown."""
    return parts.groupBy(*PAIR).agg(*(F.count_if(F.col("status") == s).alias(f"n_{s.lower()}") for s in STATUSES))


def plan(tables: dict[str, DataFrame], mappings: DataFrame, pairs: DataFrame, dependencies: DataFrame, environment: DataFrame) -> DataFrame:
    """All eight parts of every plan."""
    parts = [component_parts(tables["components"], mappings, pairs), value_part(tables["stated_values"], mappings, pairs), manifest_parts(dependencies, environment, pairs)]
    return reduce(DataFrame.unionByName, [p.select(*PAIR, "part", "n", "n_matched", "status") for p in parts])
