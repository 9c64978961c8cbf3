"""Exact de-duplication by counting quotient filters.

Each partition turns the fingerprints of its texts into a counting quotient filter: the high
bits (quotient) say where an entry belongs, the remainders of a quotient are kept sorted, each
with its count.  Filters of all partitions are cut at the same quotients and merged range by
range; merging sorted remainders loses nothing.  Only fingerprints whose merged count is above
one are routed to byte verification, all other rows are unique.

Null text counts as empty.  Rows that repeat a doc_id are rows of their own: each counts in
``group_size``; if the id stays, all rows of that id and text are marked kept.  A null id is
larger than any other.  An empty table gives no rows.  Other columns play no part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluicegate.llm.base import SPACES, free_name, pack, pack_sorted, table, unpack, unpack_sorted, written
from sluicegate.session import shuffle_partitions


#: Rows of a table that may be broadcast, some 30 MB; larger ones are joined by shuffles.
BROADCAST_ROWS = 250_000


def build_filter(fingerprints: np.ndarray, remainder_bits: int):
    """(occupied quotients, entries of each, remainders sorted within a quotient, counts)."""
    f = np.sort(fingerprints.astype(np.uint64))
    first = np.flatnonzero(np.diff(f, prepend=f[:1] ^ np.uint64(1)) != 0)
    counts = np.diff(np.append(first, len(f)))
    return _split(f[first], counts, remainder_bits)


def _split(entries: np.ndarray, counts: np.ndarray, bits: int):
    quotient = entries >> np.uint64(bits)
    start = np.flatnonzero(np.diff(quotient, prepend=quotient[:1] ^ np.uint64(1)) != 0)
    runs = np.diff(np.append(start, len(entries)))
    remainder = entries & np.uint64((1 << bits) - 1)
    return quotient[start], runs.astype(np.uint64), remainder, counts.astype(np.uint64)


def merge_filters(filters: list, remainder_bits: int):
    """One filter with the summed counts of all of them."""
    entries = np.concatenate([
        (np.repeat(q, runs.astype(np.int64)) << np.uint64(remainder_bits)) | r for q, runs, r, _ in filters])
    counts = np.concatenate([c for *_, c in filters])
    order = np.argsort(entries, kind="stable")  # merges the sorted runs
    entries, counts = entries[order], counts[order]
    first = np.flatnonzero(np.diff(entries, prepend=entries[:1] ^ np.uint64(1)) != 0)
    return _split(entries[first], np.add.reduceat(counts, first) if len(first) else counts, remainder_bits)


def body(text: Column) -> Column:
    """The bytes of a text without its white space; null counts as empty."""
    out = F.coalesce(text.cast("string"), F.lit(""))
    for space in SPACES.decode():
        out = F.replace(out, F.lit(space), F.lit(""))
    return out.cast("binary")


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(body(text), 256))


def broadcast_if_small(df: DataFrame, most: int) -> DataFrame:
    """A written table with a broadcast hint if it has at most ``most`` rows, else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def _partition_filters(range_bits: int, quotient_bits: int):
    """One filter for a partition, cut into ranges of quotients."""
    rest = 64 - quotient_bits

    def build(batches):
        parts = [b.column(0).to_numpy().view(np.uint64) for b in batches if b.num_rows]
        if not parts:
            return
        q, runs, r, c = build_filter(np.concatenate(parts), rest)
        upto = np.concatenate([[0], np.cumsum(runs)]).astype(np.int64)
        piece = q >> np.uint64(quotient_bits - range_bits)
        cut = np.flatnonzero(np.diff(piece, prepend=piece[:1] ^ np.uint64(1)) != 0)
        rows = []
        for a, b in zip(cut, np.append(cut[1:], len(q))):
            low, high = upto[a], upto[b]
            rows.append((int(piece[a]), pack_sorted(q[a:b]), pack(runs[a:b]), pack(r[low:high]), pack(c[low:high])))
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, t) for x, t in zip(zip(*rows), [pa.int64()] + [pa.binary()] * 4)],
            ["range", "quotients", "runs", "remainders", "counts"])

    return build


def _repeated(remainder_bits: int):
    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        q, runs, r, c = merge_filters([
            (unpack_sorted(a), unpack(b, np.uint64), unpack(x, np.uint64), unpack(y, np.uint64))
            for a, b, x, y in zip(pdf["quotients"], pdf["runs"], pdf["remainders"], pdf["counts"])], remainder_bits)
        entries = (np.repeat(q, runs.astype(np.int64)) << np.uint64(remainder_bits)) | r
        return pd.DataFrame({"fingerprint": entries[c > 1].view(np.int64)})

    return merge


def repeated_fingerprints(fingerprints: DataFrame, quotient_bits: int = 32) -> DataFrame:
    """Fingerprints (one long column) that occur more than once."""
    pieces = max(1, shuffle_partitions(fingerprints.sparkSession) * 2)
    range_bits = min(quotient_bits, (pieces - 1).bit_length())
    filters = fingerprints.mapInArrow(
        _partition_filters(range_bits, quotient_bits),
        "range long, quotients binary, runs binary, remainders binary, counts binary")
    return filters.groupBy("range").applyInPandas(_repeated(64 - quotient_bits), "fingerprint long")


def _groups(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """Texts that occur more than once in ``rows`` (doc_id, n_points, sha, fingerprint): fingerprint,
    sha, keep_id, size, and how many rows of the group have the id that stays."""
    repeated = written(repeated_fingerprints(rows.select("fingerprint")), "exact-repeated")
    repeated = broadcast_if_small(repeated, BROADCAST_ROWS)
    routed = rows.join(repeated, "fingerprint", "left_semi")

    # Byte verification: texts of routed rows are grouped by their bytes, copies within a task
    # before they are moved.  A digest that stood for two different texts would stop the job
    # here instead of merging them.
    bodies = (
        texts.select(body(F.col("text")).alias("body")).withColumn("fingerprint", F.xxhash64("body"))
        .join(repeated, "fingerprint", "left_semi"))
    same = (
        bodies.groupBy("body").agg(F.count(F.lit(1)).alias("copies"))
        .groupBy(F.unhex(F.sha2("body", 256)).alias("sha")).agg(F.count(F.lit(1)).alias("texts")))
    verified = same.select("sha", F.when(F.col("texts") == 1, True).otherwise(
        F.raise_error(F.lit("one SHA-256 digest stands for different texts")).cast("boolean")).alias("equal"))
    # Most code points first, then the smallest id; a null id comes last.
    by_id = routed.groupBy("fingerprint", "sha", "doc_id").agg(F.max("n_points").alias("points"), F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct(-F.col("points"), F.col("doc_id").isNull(), F.col("doc_id"), F.col("n")))
    groups = by_id.groupBy("fingerprint", "sha").agg(best.alias("best"), F.sum("n").alias("size"))
    # The groups are written so that the join reads them as they are and can split a hot one.
    return written(groups.join(verified, "sha").where("equal").select(
        "fingerprint", "sha", F.col("best.doc_id").alias("keep_id"), "size", F.col("best.n").alias("same_id")), "exact-groups")


def _rows(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return texts, written(texts.select(
        "doc_id", F.coalesce(F.char_length("text"), F.lit(0)).alias("n_points"), digest(F.col("text")).alias("sha"),
        F.xxhash64(body(F.col("text"))).alias("fingerprint")), "exact-rows")


def exact_groups(docs: DataFrame) -> DataFrame:
    """A row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    texts, rows = _rows(docs)
    # A digest of one fingerprint may share it with another text: such a row has no group or one of its own.
    out = rows.join(_groups(texts, rows).select("sha", "keep_id", "size"), "sha", "left")
    keep = F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("size", F.lit(1).cast("long")).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The documents that stay, with their columns; repeated rows of one id and text leave one row.

    Documents are matched with the groups by fingerprint and digest where they are read; only if
    there are more than ``BROADCAST_ROWS`` groups are they shuffled for it.
    """
    key, of_key, group, rank = (free_name(docs.columns, x) for x in ("kept_key", "kept_group_key", "kept_group", "kept_rank"))
    found = _groups(*_rows(docs))
    groups = broadcast_if_small(written(found.groupBy(F.col("fingerprint").alias(of_key)).agg(
        F.collect_list(F.struct("sha", "keep_id", "same_id")).alias(group)), "exact-keys"), BROADCAST_ROWS)
    own = F.when(F.col(group).isNotNull(), F.get(F.filter(group, lambda g: g["sha"] == digest(F.col("text"))), F.lit(0)))
    # An id alone does not tell which of its rows stay: texts of one id, or of none, may differ.
    matched = docs.withColumn(key, F.xxhash64(body(F.col("text")))).join(
        groups, F.col(key) == F.col(of_key), "left").withColumn(group, own)
    kept = matched.where(F.col(group).isNull() | F.col("doc_id").eqNullSafe(F.col(group)["keep_id"]))
    columns = [f"`{c}`" for c in docs.columns]
    if found.where("same_id > 1").isEmpty():
        return kept.select(*columns)
    again = F.coalesce(F.col(group)["same_id"] > 1, F.lit(False))
    copies = Window.partitionBy(key, "text").orderBy(F.lit(1))
    once = kept.where(again).withColumn(rank, F.row_number().over(copies)).where(F.col(rank) == 1)
    return kept.where(~again).select(*columns).union(once.select(*columns))


def op8_quotient_filter_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


SQL = {"op8_quotient_filter_dedup": r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body
  FROM documents),
g AS (
  SELECT doc_id, body,
         first_value(doc_id) OVER (PARTITION BY body ORDER BY points DESC, doc_id NULLS LAST) AS keep_id,
         count(*) OVER (PARTITION BY body) AS group_size
  FROM n)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept,
       sha256(body) AS text_sha256
FROM g"""}

QUERIES = {"op8_quotient_filter_dedup": op8_quotient_filter_dedup}
