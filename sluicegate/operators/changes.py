"""Keyed changes on small tables and the current state of append-only event tables.

Parquet tables have no UPDATE or DELETE.  Each function returns the next snapshot; write
it to a new place, or use MERGE where the catalog supports it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The last row of each key; a partial aggregate, so long histories do not gather."""
    rest = [c for c in df.columns if c not in keys]
    newest = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return newest.select(*keys, "_row.*").select(*df.columns)


def keyed_upsert(base: DataFrame, changes: DataFrame, keys: Sequence[str],
                 order: Sequence[Column] | None = None) -> DataFrame:
    """Changed keys take the new row, the others stay.

    ``changes`` must hold one row per key; pass ``order`` to keep its last row per key.
    """
    if order is not None:
        changes = latest_per_key(changes, keys, order)
    kept = base.join(changes.select(*keys), list(keys), "left_anti").select(*base.columns)
    return kept.unionByName(changes.select(*base.columns))


def keyed_delete(base: DataFrame, removed: DataFrame, keys: Sequence[str]) -> DataFrame:
    return base.join(removed.select(*keys), list(keys), "left_anti").select(*base.columns)


def grant_role(roles: DataFrame, users: DataFrame, role: str, granted_by: str) -> DataFrame:
    """Give ``role`` to every ``username`` of ``users``; names are trimmed and lower-cased."""
    name = F.lower(F.trim("username"))
    changes = users.select(name.alias("username")).filter(F.length("username") > 0).distinct().select(
        "username", F.lit(role).alias("role"), F.lit(granted_by).alias("granted_by"),
        F.current_timestamp().alias("granted_at"))
    return keyed_upsert(roles, changes, ["username"])


def save_labels(labels: DataFrame, changes: DataFrame, updated_by: str) -> DataFrame:
    """Upsert of template labels; blank texts are stored as NULL."""
    def blank_to_null(c: str) -> Column:
        return F.nullif(F.trim(c), F.lit("")).alias(c)

    stamped = changes.select(
        "template_id", blank_to_null("display_name"), blank_to_null("description"),
        F.lit(updated_by).alias("updated_by"), F.current_timestamp().alias("updated_at"))
    return keyed_upsert(labels, stamped, ["template_id"])


def current_status(events: DataFrame, key: str, status: str, order: Sequence[str | Column]) -> DataFrame:
    """Latest status per key of an append-only event table."""
    by = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order])
    return events.groupBy(key).agg(F.max_by(status, by).alias(status))
