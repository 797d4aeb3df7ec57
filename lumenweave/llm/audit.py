"""How filters of documents interact: what each removes alone, together, and in every order.

Documents are counted once, by the sets of filters that they fail together: a count for each of the 32 intersections, as
a sum of products of flags. All answers follow from these counts by inclusion and exclusion. What survives a set of filters
is the alternating sum over its subsets; what fails one filter only is the alternating sum over the sets that hold it; and
the number that a set removes is a game whose Harsanyi dividends are the signed counts, so a filter's Shapley value is the
sum of its sets' dividends, each shared evenly.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import prepare, table, text_column

FILTERS = "ABCDE"
#: White space between words, and the bounds of the filters, in hundredths where they are shares.
SPACE = r"[\x20\x09-\x0D]+"
FEWEST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, ODD = 100, 80, 10, "[#$%&*|]"

SETS = range(1 << len(FILTERS))
COUNTED = ["n", "good", "toxic"]


def flagged(docs: DataFrame) -> DataFrame:
    """documents to (doc_id, part, digest, a, b, c, d): the language, the text's SHA-256 and 1 for each failed filter but E."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text_column(docs).alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", SPACE), ""))
    n, distinct = F.size("words"), F.size(F.array_distinct("words"))
    capitals = F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    fails = {"a": n < FEWEST_WORDS, "b": 100 * distinct < LEAST_DISTINCT * n, "c": 100 * capitals > MOST_CAPITALS * F.length("text"), "d": F.col("text").rlike(ODD)}
    return rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), *(x.cast("int").alias(c) for c, x in fails.items()))


def copies(flags: DataFrame, labels: DataFrame) -> DataFrame:
    """Flags and labels to (part, good, toxic, a, b, c, d, n, e): documents of equal text and kind in one row, e of them failing E.

    Equal texts are counted before they meet, so a text that a third of all documents share is a few rows by then. A
    document fails E if its text has a smaller doc_id anywhere; documents without doc_id neither fail nor make others fail.
    """
    each = flags.groupBy("doc_id", "part", "digest", *"abcd").agg(F.count("*").alias("n"))
    told = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*(F.coalesce(F.bool_or(F.col(c) == 1), F.lit(False)).cast("int").alias(as_) for c, as_ in (("quality", "good"), ("toxic", "toxic"))))
    rows = each.join(told, "doc_id", "left").na.fill(0, ["good", "toxic"])
    numbered = F.when(F.col("doc_id").isNotNull(), F.col("n")).otherwise(0)
    kinds = rows.groupBy("digest", "part", "good", "toxic", *"abcd").agg(F.sum("n").alias("n"), F.sum(numbered).alias("numbered"), F.min("doc_id").alias("first"), F.min_by("n", "doc_id").alias("at_first"))
    least = F.min("first").over(Window.partitionBy("digest"))
    later = F.col("numbered") - F.when(F.col("first") == least, F.col("at_first")).otherwise(0)
    return kinds.withColumn("e", later).drop("digest", "numbered", "first", "at_first")


def joint_failures(rows: DataFrame) -> DataFrame:
    """(part, n_0 .. n_31, good_0 .., toxic_0 ..): documents that fail all filters of a set, bit by bit A to E, at least.

    A row of copies counts with all its documents for sets without E, and with those that fail E for sets with it.
    """
    sums = []
    for s in SETS:
        product = F.col("e") if s & 16 else F.col("n")
        for bit, flag in enumerate("abcd"):
            if s >> bit & 1:
                product = product * F.col(flag)
        sums += [F.sum(product).alias(f"n_{s}"), *(F.sum(product * F.col(w)).alias(f"{w}_{s}") for w in COUNTED[1:])]
    return rows.groupBy("part").agg(*sums)


def _signed(counts: list[tuple[int, Column]]) -> Column:
    out = F.lit(0).cast("long")
    for sign, c in counts:
        out = out + c if sign > 0 else out - c
    return out


def interactions(joint: DataFrame) -> DataFrame:
    """Joint failures to one row for each part, order of filters and step; see audit."""
    size = lambda s: bin(s).count("1")
    count = lambda w, s: F.col(f"{w}_{s}")
    singles = [1 << i for i in range(len(FILTERS))]
    orders = factorial(len(FILTERS))
    survivors = [F.array(*(_signed([((-1) ** size(t), count(w, t)) for t in SETS if t & s == t]) for s in SETS)).alias(f"left_{w}") for w in COUNTED]
    unique = F.array(*(_signed([((-1) ** (size(t) - 1), count("n", t)) for t in SETS if t & f]) for f in singles))
    shapley = F.array(*(_signed([((-1) ** (size(t) + 1), count("n", t) * (orders // size(t))) for t in SETS if t & f]) for f in singles))
    alone = F.array(*(count("n", f) for f in singles))
    parts = joint.select("part", *survivors, unique.alias("unique"), shapley.alias("shapley"), alone.alias("alone"))
    each = parts.select("*", F.explode(F.array(*(F.lit("".join(p)) for p in permutations(FILTERS)))).alias("filter_order"))
    steps = each.select("*", F.posexplode(F.split("filter_order", "")).alias("place", "letter"))
    which = F.instr(F.lit(FILTERS), F.col("letter"))
    before = F.lit(0)
    for i, letter in enumerate(FILTERS):
        before = before + F.when(F.instr("filter_order", letter) <= F.col("place"), 1 << i).otherwise(0)
    steps = steps.withColumns({"which": which, "before": before, "after": before + F.element_at(F.array(*map(F.lit, singles)), which)})
    left = lambda w, s: F.element_at(f"left_{w}", F.col(s) + 1)
    of = lambda c: F.element_at(c, F.col("which"))
    gone = {w: left(w, "before") - left(w, "after") for w in COUNTED}
    return steps.select(
        "part", "filter_order", (F.col("place") + 1).alias("step"), left("n", "after").alias("kept"), gone["n"].alias("removed"), (of("alone") - gone["n"]).alias("redundant"),
        of("unique").alias("unique_fails"), gone["good"].alias("good_lost"), gone["toxic"].alias("toxic_lost"), of("shapley").alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """documents and labels to 600 rows for each language: 120 orders of five filters, and their five steps.

    Columns: part, filter_order, step, kept after the step, removed by it, redundant (failing its filter, removed before),
    unique_fails (failing its filter only), good_lost and toxic_lost (removed with such a label), and shapley (removed by
    its filter, summed over all orders). Null texts are empty ones, null languages the empty string. Every row of documents
    counts, repeated ones too. A document has a label if any row of labels gives it; rows without doc_id have none and
    neither are nor have earlier copies. Empty documents give no rows, empty labels no losses. Other columns are not read.
    """
    prepare(docs.sparkSession)
    return interactions(joint_failures(copies(flagged(docs), labels)))


def op12_audit(spark, sf_dir):
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
