"""Mixing sources to target weights by fitting a token budget as a subset sum.

Every source gets a target number of words.  It is met by whole repeats of all its documents
and, for the rest of the budget, by a seeded choice of documents: documents are counted by
exact length, each length gives a fixed share of its documents, and bounded-knapsack dynamic
programming over the lengths left over fills what is still missing, to the word where a
subset exists.  Which documents of a length are taken depends on a seeded hash only, so
reruns agree.

Null text and text of white space have size 0; such documents take nothing.  A null source is
a source of its own, the last.  Rows that repeat a doc_id are rows of their own.  An empty
table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluicegate.llm.base import WORD, free_name, table, written

#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: Times its size that a source, and so a document, may be taken at most.
MOST = 3
#: Words that dynamic programming fills; what is left above goes by the largest length first.
DP_WORDS = 1 << 16
#: Ranges of the seeded hash that ranks the documents of a length.
HASH_RANGES = 4096


def row_hash(seed: int, text: Column | None = None) -> Column:
    """The seeded hash that ranks a row: by id and text, so that rows of one id differ."""
    text = F.col("text") if text is None else text
    return F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("doc_id").isNull(),
                      F.coalesce(text.cast("string"), F.lit("")))


def source_key() -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null"))


def sizes(docs: DataFrame, seed: int = 7) -> DataFrame:
    return docs.select(
        "doc_id", "source", row_hash(seed).alias("h"),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def source_targets(sized: DataFrame, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """A row per source: source, source_size, target.

    A source stops at ``most`` times its size and its excess goes to the others by weight, so
    targets are min(most * size, weight * level) with the level that spends all words.  The
    sources are few against the documents, and aggregated before they are put in order.
    """
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy("full_level", F.col("source").asc_nulls_last())
    all_rows = Window.partitionBy(F.lit(1))
    known = F.array(*[F.lit(float(w)) for w in weights])
    weighed = (
        per_source
        .withColumn("weight", F.element_at(known, F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))).cast("int") + 1))
        .withColumn("cap", F.lit(float(most)) * F.col("source_size"))
        .withColumn("full_level", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(all_rows).cast("double")))
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cap.rowsBetween(0, Window.unboundedFollowing)
    # Level if exactly the sources before this one are full; the right one is the first that fills no more.
    levels = weighed.withColumn(
        "level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    chosen = F.min(F.when(F.col("level") <= F.col("full_level"), F.struct("full_level", "level"))).over(all_rows)
    return levels.select(
        "source", "source_size",
        F.least("cap", F.col("weight") * F.coalesce(chosen.getField("level"), F.lit(0.0))).alias("target"))


def fit_lengths(lengths: np.ndarray, counts: np.ndarray, budget: int, dp_words: int = DP_WORDS) -> np.ndarray:
    """How many documents of each length to take so that their words come as near to the budget
    from below as bounded-knapsack dynamic programming finds; exact if it reaches the budget."""
    take = np.zeros(len(lengths), np.int64)
    total = int((lengths * counts).sum())
    if budget <= 0 or not total:
        return take
    if budget >= total:
        return counts.astype(np.int64)
    # An even share of every length first: Python integers, since products pass 64 bits.
    take[:] = [int(c) * budget // total for c in counts]
    left, rest = counts - take, budget - int((lengths * take).sum())
    order = np.argsort(-lengths, kind="stable")
    for i in order:  # down to what dynamic programming can fill
        if rest <= dp_words:
            break
        more = min(int(left[i]), (rest - dp_words) // int(lengths[i]) + 1, rest // int(lengths[i]))
        take[i] += more
        left[i] -= more
        rest -= more * int(lengths[i])
    if rest > dp_words:
        return take  # nothing is left that fits
    reached = np.zeros(rest + 1, bool)
    reached[0] = True
    item, copies = np.full(rest + 1, -1, np.int64), np.zeros(rest + 1, np.int64)
    for i in order[::-1]:
        size, most = int(lengths[i]), int(left[i])
        if size > rest or reached[rest]:
            break
        front = np.flatnonzero(reached)
        for used in range(1, min(most, rest // size) + 1):
            front = front + size
            front = front[front <= rest]
            front = front[~reached[front]]
            if not len(front):
                break
            reached[front], item[front], copies[front] = True, i, used
    at = int(np.flatnonzero(reached)[-1])
    while at:
        i, used = int(item[at]), int(copies[at])
        take[i] += used
        at -= used * int(lengths[i])
    return take


def _fit(pdf: pd.DataFrame) -> pd.DataFrame:
    lengths, counts = pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
    order = np.argsort(lengths, kind="stable")
    out = pdf.iloc[order][["source_key", "size"]].copy()
    out["take"] = fit_lengths(lengths[order], counts[order], int(pdf["budget"].iloc[0]))
    return out


def mixed(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST, seed: int = 7) -> DataFrame:
    """A row per row of docs: doc_id, size, source_size, target, taken, repeats, source."""
    return _mixed(docs, weights, most, seed).drop("h", "source_key")


def _mixed(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST, seed: int = 7) -> DataFrame:
    rows = written(sizes(docs, seed), "mix-sizes")
    targets = source_targets(rows, weights, most)
    targets = targets.select(
        source_key().alias("source_key"), "source_size", "target",
        F.when(F.col("source_size") > 0, F.least(
            F.floor((F.col("target") + 1e-6) / F.col("source_size")), F.lit(most))).otherwise(0).cast("long").alias("whole"))
    targets = written(targets.withColumn("budget", F.greatest(
        F.lit(0), F.round("target") - F.col("whole") * F.col("source_size")).cast("long")), "mix-targets")

    ranked = rows.select("doc_id", "source", "size", source_key().alias("source_key"), "h",
                         F.pmod(F.col("h"), F.lit(HASH_RANGES)).alias("hash_range"))
    # Documents by source, length and range of the hash: a hot source or length is summed before
    # the shuffle, and its documents are ranked range by range.
    cells = ranked.groupBy("source_key", "size", "hash_range").agg(F.count(F.lit(1)).alias("n"))
    lengths = cells.where("size > 0").groupBy("source_key", "size").agg(F.sum("n").alias("n"))
    take = (
        lengths.join(targets.where("budget > 0").select("source_key", "budget"), "source_key")
        .groupBy("source_key").applyInPandas(_fit, "source_key string, size long, take long"))
    upto = Window.partitionBy("source_key", "size").orderBy("hash_range").rowsBetween(Window.unboundedPreceding, 0)
    quota = (
        cells.withColumn("upto", F.sum("n").over(upto)).join(take.where("take > 0"), ["source_key", "size"])
        .select("source_key", "size", "hash_range",
                F.least("n", F.greatest(F.lit(0), F.col("take") - F.col("upto") + F.col("n"))).alias("quota"), "n")
        .where("quota > 0"))
    chosen = ranked.join(quota, ["source_key", "size", "hash_range"], "left")
    within = Window.partitionBy("source_key", "size", "hash_range").orderBy("h", F.col("doc_id").asc_nulls_last())
    # Only one range of a length is taken in part; there the documents are ranked.
    whole_range = F.col("quota").isNull() | (F.col("quota") == F.col("n"))
    full = chosen.where(whole_range).withColumn("extra", F.when(F.col("quota").isNull(), 0).otherwise(1))
    cut = chosen.where(~whole_range).withColumn("extra", F.when(F.row_number().over(within) <= F.col("quota"), 1).otherwise(0))
    return (
        full.unionByName(cut).join(targets.drop("budget"), "source_key")
        .select("doc_id", "size", "source_size", "target",
                (F.col("size") * (F.col("whole") + F.col("extra"))).cast("long").alias("taken"),
                (F.col("whole") + F.col("extra")).cast("int").alias("repeats"), "source", "h", "source_key"))


def mixture(docs: DataFrame, seed: int = 7, **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, with its columns.

    Documents without words take part in no budget and stay once.  Repeats belong to rows, known
    by id, text and source: of rows that agree in these, some may be taken once more than others.
    """
    h, key, each, more, rank, n = (
        free_name(docs.columns, x) for x in ("mix_hash", "mix_key", "mix_each", "mix_more", "mix_rank", "mix_n"))
    rows = _mixed(docs, seed=seed, **options).withColumn(
        "repeats", F.when(F.col("size") == 0, 1).otherwise(F.col("repeats")))
    alike = rows.groupBy("h", "source_key").agg(F.count(F.lit(1)).alias("n"), F.sum("repeats").alias("total"))
    alike = written(alike.where("total > 0").select(
        F.col("h").alias(h), F.col("source_key").alias(key), F.expr("total div n").cast("int").alias(each),
        (F.col("total") % F.col("n")).alias(more)), "mix-repeats")
    # A row per document: never a side to broadcast.
    taken = docs.withColumns({h: row_hash(seed), key: source_key()}).join(alike.hint("merge"), [h, key])
    # Only where rows that are alike share the repeats unevenly are they put in order.
    first = Window.partitionBy(h, key).orderBy(F.lit(1))
    uneven = taken.where(F.col(more) > 0).withColumn(rank, F.row_number().over(first)).withColumn(
        each, F.col(each) + F.when(F.col(rank) <= F.col(more), 1).otherwise(0)).drop(rank)
    columns = [f"`{c}`" for c in docs.columns]
    return (
        taken.where(F.col(more) == 0).unionByName(uneven).where(F.col(each) > 0)
        .withColumn(n, F.explode(F.array_repeat(F.lit(0), F.col(each))))
        .select(*columns))


def op9_subset_sum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"))


QUERIES = {"op9_subset_sum_mix": op9_subset_sum_mix}
SQL: dict[str, str] = {}
