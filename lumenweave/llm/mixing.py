"""Mixing sources to target weights by iterative proportional fitting, then sampling documents.

Token totals of the cells (source, language, topic) are raked until each margin has its target shares. A cell's
documents are kept with one probability, calibrated so that the expected tokens meet the budget as far as texts last.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import prepare, table, text_column, written

MARGINS = ("source", "lang", "topic")
#: Cells that the driver rakes in memory (some 100 bytes each); more are raked in Spark.
MOST_CELLS = 100_000
ROUNDS, EXACT = 200, 1e-9
#: Target shares of values without a stated one are observed ones to this power; and the share of all tokens to keep.
POWER, BUDGET = 0.5, 0.5
#: Stated targets of the registered query and of the pipeline; other languages share what is left.
TARGETS = {"lang": {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.1}}
SEED = 17


def topic_of(text: Column) -> Column:
    """A coarse topic by form, for documents without a topic column."""
    return (
        F.when(F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit(""))) >= 5, "table")
        .when(F.lower(text).rlike("licen[cs]e"), "license")
        .when(F.contains(text, F.lit("@")) | F.contains(text, F.lit("token =")), "contact")
        .when(F.length(text) < 600, "short").when(F.length(text) < 4000, "prose").otherwise("long")
    )


def described(docs: DataFrame) -> DataFrame:
    """docs with mix_tokens (words and one end) and the three margins as strings, null as an empty string."""
    text = text_column(docs)
    have = lambda c, other: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in docs.columns else other
    out = {"mix_tokens": F.regexp_count(text, F.lit(r"[^ \t-\r]+")).cast("long") + 1, "mix_source": have("source", F.lit("")), "mix_lang": have("lang", F.lit("")), "mix_topic": have("topic", topic_of(text))}
    return docs.withColumns(out)


def targets_of(totals: dict, given: dict | None, power: float) -> dict:
    """Target shares of a margin's values, which sum to 1.

    Values with a stated share have that; the others share what is left of 1 in proportion to observed totals to a power.
    Stated values that don't occur are passed over.
    """
    given = given or {}
    left = max(0.0, 1.0 - sum(given.values()))
    others = {k: float(t) ** power for k, t in totals.items() if k not in given}
    whole = sum(others.values())
    raw = {k: float(given[k]) if k in given else left * others[k] / whole for k in totals}
    whole = sum(raw.values())
    return {k: x / whole if whole else 0.0 for k, x in raw.items()}


def rake(labels: list[np.ndarray], tokens: np.ndarray, targets: list[np.ndarray]) -> np.ndarray:
    """Cell shares that meet each margin's targets; labels number the values of a margin. Margins that contradict each other end with the last one met."""
    share = tokens / tokens.sum()
    for _ in range(ROUNDS):
        off = 0.0
        for own, target in zip(labels, targets):
            now = np.bincount(own, share, len(target))
            ratio = np.divide(target, now, out=np.zeros_like(now), where=now > 0)
            off = max(off, float(np.abs(now - target)[now > 0].max(initial=0)))
            share = share * ratio[own]
        if off < EXACT:
            break
    return share


def calibrated(share: np.ndarray, tokens: np.ndarray, budget: float) -> np.ndarray:
    """Probabilities min(1, s * share / tokens) with s such that budget tokens are expected, or all there are."""
    want = share / tokens
    order = np.argsort(-want, kind="stable")
    full = np.concatenate(([0.0], np.cumsum(tokens[order])))
    rest = share.sum() - np.concatenate(([0.0], np.cumsum(share[order])))
    for k in range(len(order)):
        s = (budget - full[k]) / rest[k] if rest[k] > 1e-15 else 0.0
        if s * want[order[k]] <= 1:
            return np.minimum(1.0, np.maximum(s, 0.0) * want) if not k else np.where(np.isin(np.arange(len(order)), order[:k]), 1.0, np.minimum(1.0, np.maximum(s, 0.0) * want))
    return np.where(share > 0, 1.0, 0.0)


def weights(cells: DataFrame, targets: dict | None = None, power: float = POWER, budget: float = BUDGET) -> DataFrame:
    """cells (mix_source, mix_lang, mix_topic, tokens) with probability."""
    names = [f"mix_{m}" for m in MARGINS]
    if cells.count() > MOST_CELLS:
        return _weights_in_spark(cells, targets or {}, power, budget)
    rows = cells.orderBy(*names).collect()
    schema = ", ".join(f"{n} string" for n in names) + ", tokens long, probability double"
    if not rows:
        return cells.sparkSession.createDataFrame([], schema)
    tokens = np.array([r.tokens for r in rows], float)
    labels, goals = [], []
    for m, n in zip(MARGINS, names):
        values, own = np.unique([r[n] for r in rows], return_inverse=True)
        totals = dict(zip(values.tolist(), np.bincount(own, tokens)))
        goal = targets_of(totals, (targets or {}).get(m), power)
        labels.append(own)
        goals.append(np.array([goal[v] for v in values.tolist()]))
    p = calibrated(rake(labels, tokens, goals), tokens, budget * tokens.sum())
    return cells.sparkSession.createDataFrame([(*(r[n] for n in names), r.tokens, float(x)) for r, x in zip(rows, p)], schema)


def _weights_in_spark(cells: DataFrame, targets: dict, power: float, budget: float) -> DataFrame:
    """The same by joins and sums, for any number of cells; every round ends in a checkpoint."""
    spark = cells.sparkSession
    prepare(spark)
    total = float(cells.agg(F.sum("tokens")).first()[0])
    names = [f"mix_{m}" for m in MARGINS]
    out = cells.withColumn("share", F.col("tokens") / F.lit(total)).checkpoint()
    goals = []
    for m, n in zip(MARGINS, names):
        raw = out.groupBy(n).agg(F.sum("tokens").alias("t"))
        given = spark.createDataFrame([(str(k), float(v)) for k, v in (targets.get(m) or {}).items()], f"{n} string, stated double")
        raw = raw.join(given, n, "left").withColumn("other", F.when(F.col("stated").isNull(), F.pow("t", F.lit(power))).otherwise(0.0)).checkpoint()
        others = float(raw.agg(F.sum("other")).first()[0] or 0) or 1.0
        left = max(0.0, 1.0 - sum((targets.get(m) or {}).values()))
        raw = raw.select(n, F.coalesce("stated", F.col("other") * F.lit(left / others)).alias("raw"))
        whole = float(raw.agg(F.sum("raw")).first()[0]) or 1.0
        goals.append(raw.select(n, (F.col("raw") / whole).alias("goal")).checkpoint())
    for _ in range(ROUNDS):
        off = 0.0
        for n, goal in zip(names, goals):
            now = out.groupBy(n).agg(F.sum("share").alias("now")).join(goal, n).checkpoint()
            off = max(off, float(now.where("now > 0").agg(F.max(F.abs(F.col("now") - F.col("goal")))).first()[0] or 0))
            out = out.join(now, n).withColumn("share", F.when(F.col("now") > 0, F.col("share") * F.col("goal") / F.col("now")).otherwise(0.0)).drop("now", "goal")
        out = out.checkpoint()
        if off < EXACT:
            break
    want = budget * total
    p = F.col("probability")
    out = out.withColumn("probability", F.lit(0.0))
    for _ in range(ROUNDS):  # full cells are set aside until the others meet what is left of the budget
        left = out.where(p < 1).agg(F.sum("share")).first()[0] or 0.0
        held = float(out.where(p >= 1).agg(F.sum("tokens")).first()[0] or 0.0)
        if left <= 1e-15:
            break
        s = max(0.0, want - held) / left
        out = out.withColumn("probability", F.when(p >= 1, 1.0).otherwise(F.least(F.lit(1.0), F.lit(s) * F.col("share") / F.col("tokens")))).checkpoint()
        if float(out.where(p >= 1).agg(F.sum("tokens")).first()[0] or 0.0) == held:
            break
    return out.select(*names, "tokens", "probability")


def mix(docs: DataFrame, targets: dict | None = None, power: float = POWER, budget: float = BUDGET, seed: int = SEED) -> DataFrame:
    """docs with mix_tokens, mix_source, mix_lang, mix_topic, probability and kept added (columns of those names are replaced).

    targets: margin to {value: share}, as `targets_of` reads them. Nulls are a value of their own (empty string); null and empty texts hold one token. A document is kept if a uniform hash of its doc_id
    (of its text if that is null) and the seed lies under its cell's probability, so repeated rows share their fate. An
    empty table gives an empty table.
    """
    prepare(docs.sparkSession)
    rows = described(docs.drop("probability", "kept"))
    names = [f"mix_{m}" for m in MARGINS]
    cells = written(rows.groupBy(*names).agg(F.sum("mix_tokens").alias("tokens")), "cells")
    found = weights(cells, targets, power, budget).drop("tokens")
    if cells.count() <= MOST_CELLS:  # some MB at most, so no text is shuffled
        found = F.broadcast(found)
    luck = F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.col("text")), F.lit(seed)), 11) / F.lit(float(1 << 53))
    # the place of kept is taken before the join, so that texts need not go through it
    out = rows.withColumn("kept", luck).join(found, names)
    return out.select(*rows.columns, "probability", (F.col("kept") < F.col("probability")).alias("kept"))


def op10_mixing(spark, sf_dir):
    got = mix(table(spark, sf_dir, "documents"), TARGETS)
    return got.select("doc_id", "mix_source", "mix_lang", "mix_topic", "mix_tokens", "probability", "kept")
