"""One outcome per incoming row: invalid, dup_in_batch, dup_in_target or accepted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sluicegate.operators import dedup
from sluicegate.session import written

INVALID, DUP_IN_BATCH, DUP_IN_TARGET, ACCEPTED = "invalid", "dup_in_batch", "dup_in_target", "accepted"
OUTCOME = "outcome"


def assign_outcomes(rows: DataFrame, valid: Column, batch_keys: Sequence[str],
                    order: Sequence[str | Column], target: DataFrame,
                    target_keys: Sequence[str]) -> DataFrame:
    """Add ``outcome``.  Only valid rows compete for being first; only first rows are
    looked up in the target.  The checked rows are written once, since they are read twice."""
    checked = rows.withColumn("_valid", F.coalesce(valid, F.lit(False)))
    checked = written(checked.withColumn(dedup.ROW_HASH, dedup.row_hash(checked, target_keys)), "checked")
    flagged = dedup.flag_copies(checked, ["_valid", *batch_keys], order)
    candidate = F.col("_valid") & F.col(dedup.IS_FIRST)
    probed = dedup.mark_in_target(flagged, target, target_keys, "_known", when=candidate, probes=checked)
    outcome = (
        F.when(~F.col("_valid"), F.lit(INVALID))
        .when(~F.col(dedup.IS_FIRST), F.lit(DUP_IN_BATCH))
        .when(F.col("_known"), F.lit(DUP_IN_TARGET))
        .otherwise(F.lit(ACCEPTED))
    )
    return probed.withColumn(OUTCOME, outcome).drop("_valid", "_known", dedup.ROW_HASH, dedup.IS_FIRST, dedup.LATER_COPIES)

