"""What each of five filters does beside the others: an audit from histograms of failure masks.

Native expressions turn every text into four bits: A few words, B few distinct words, C many capitals, D a symbol. The fifth, E
(the text stands in a document of a smaller id), comes from grouping by text: rows are added up by text, part and labels
first, so a text that a third of all rows share is a few rows when its smallest id is looked for. What remains of a part are 32
cells - documents, good and toxic ones by mask - and every order of the filters is enumerated from the cells alone.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
SPACES = "[ \\x09-\\x0D]+"


def failures(text: Column, words: Column, distinct: Column) -> Column:
    """Bits of the filters A to D (1, 2, 4, 8) that a text fails; words and distinct are its numbers of words."""
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    failed = [words < 200, distinct * 100 < words * 50, capitals * 100 > F.length(text) * 2, text.rlike("[#$%&*|]")]
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failed)), F.lit(0)).cast("int")


def masked(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, source) -> (doc_id, part, text_key, mask): one narrow stage; a text is known by its SHA-256 from here on."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["source"].cast("string"), F.lit("")).alias("part"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.filter(F.split("text", SPACES), lambda w: w != ""))
    rows = rows.select("doc_id", "part", "text", F.size("words").alias("words"), F.size(F.array_distinct("words")).alias("distinct"))
    return rows.select("doc_id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("text_key"), failures(F.col("text"), F.col("words"), F.col("distinct")).alias("mask"))


def known(labels: DataFrame) -> DataFrame:
    """(label_id, good, toxic, here): 1 where any row of that id says so."""
    rows = labels.select(labels["doc_id"].cast("long").alias("label_id"), labels["quality"].cast("int").alias("quality"), labels["toxic"].cast("int").alias("toxic"))
    any_ = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(c)
    found = rows.where("label_id IS NOT NULL").groupBy("label_id").agg(any_("quality"), any_("toxic"))
    return found.select("label_id", F.col("quality").alias("good"), "toxic", F.lit(True).alias("here"))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and failed filters, bits as in FILTERS; only masks that occur.

    Texts are known by their hash. A null doc_id is smaller than no other and has no smaller one, so its row never fails E; rows
    that repeat a doc_id do not fail for each other. Null ids look for no label: they go by their text's hash, not into one task.
    """
    rows = masked(docs).withColumn("here", F.col("doc_id").isNotNull()).withColumn("label_id", F.coalesce("doc_id", F.xxhash64("text_key", "part")))
    rows = rows.join(known(labels), ["label_id", "here"], "left")
    kinds = ["part", "mask", "good", "toxic"]
    rows = rows.select("doc_id", "text_key", "part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    by_id = rows.groupBy("doc_id", "text_key", *kinds).agg(F.count(F.lit(1)).alias("n"))
    by_text = by_id.groupBy("text_key", *kinds).agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.coalesce(F.min_by("n", "doc_id"), F.lit(0)).alias("at_least"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless")
    )
    first = F.min("least").over(Window.partitionBy("text_key"))  # a row for each part and labels that the text occurs with
    by_text = by_text.withColumn("first", first)
    kept = F.when(F.col("least") == F.col("first"), F.col("at_least")).otherwise(0) + F.col("nameless")
    split = F.array(F.struct(F.col("mask").alias("mask"), kept.alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - kept).alias("n")))
    parts = by_text.select("part", "good", "toxic", F.inline(split)).where("n > 0")
    return parts.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def enumerated(found: DataFrame) -> DataFrame:
    """cells -> a row for each part, order and step; each sum goes over a part's 32 cells at most."""
    by_part = found.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    orders = F.lit(",".join("".join(p) for p in permutations(FILTERS)))
    rows = by_part.select("part", "cells", F.explode(F.split(orders, ",")).alias("filter_order"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    bit = lambda at: F.call_function("shiftleft", F.lit(1), F.ascii(F.substr("filter_order", at, F.lit(1))) - ord("A"))
    before = F.aggregate(F.sequence(F.lit(0), F.col("step") - 1), F.lit(0), lambda m, j: F.when(j > 0, m.bitwiseOR(bit(j))).otherwise(m))
    rows = rows.withColumn("own", bit(F.col("step"))).withColumn("before", before)
    own, earlier = (lambda m: m.bitwiseAND(F.col("own")) != 0), (lambda m: m.bitwiseAND(F.col("before")) != 0)

    def total(what: str, when) -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda s, c: s + F.when(when(c["mask"]), c[what]).otherwise(0))

    def removed(m: Column) -> Column:
        return own(m) & ~earlier(m)

    orders_of = lambda m: F.expr("120") / F.bit_count(m)  # noqa: E731 - the orders in which one of the failed filters comes first
    shapley = F.aggregate("cells", F.lit(0).cast("long"), lambda s, c: s + F.when(own(c["mask"]), c["n"] * orders_of(c["mask"]).cast("long")).otherwise(0))
    return rows.select(
        "part", "filter_order", "step",
        total("n", lambda m: ~own(m) & ~earlier(m)).alias("kept"),
        total("n", removed).alias("removed"),
        total("n", lambda m: own(m) & earlier(m)).alias("redundant"),
        total("n", lambda m: m == F.col("own")).alias("unique_fails"),
        total("good", removed).alias("good_lost"),
        total("toxic", removed).alias("toxic_lost"),
        shapley.alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs(doc_id, text, source), labels(doc_id, quality, toxic) -> (part, filter_order, step, kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley): for each part all 120 orders of five filters, and each step.

    Null texts are empty, null sources the part ''; documents without labels are neither good nor toxic, of several labels of an
    id the larger ones count. An empty table has no part and gives an empty result; further columns are not read.
    """
    return enumerated(cells(docs, labels))
