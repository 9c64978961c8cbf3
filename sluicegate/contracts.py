"""Declared contracts: which headers a batch carries and what each column becomes.

A contract is plain data.  ``project`` turns it into native projections: header mapping,
casts and constants, without a shuffle or a Python function.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, functions as F, types as T

from sluicegate.functions import casts, names


@dataclass(frozen=True)
class Field:
    header: str
    name: str
    type: str
    required: bool = False


@dataclass(frozen=True)
class Constant:
    name: str
    type: str
    value: str


@dataclass(frozen=True)
class Contract:
    id: str
    title: str
    table: str
    fields: tuple[Field, ...]
    description: str = ""
    constants: tuple[Constant, ...] = ()
    ready: bool = True
    flow: str = "contract"
    rules: tuple = field(default=(), compare=False)

    @property
    def column_names(self) -> list[str]:
        """Data columns, then constants: the duplicate key and the target layout."""
        return [f.name for f in self.fields] + [c.name for c in self.constants]

    @property
    def required_headers(self) -> list[str]:
        return [f.header for f in self.fields if f.required]

    def schema(self) -> T.StructType:
        typed = [*self.fields, *self.constants]
        return T.StructType([T.StructField(c.name, store_type(c.type, self.flow)) for c in typed])


class ContractError(ValueError):
    """A batch or a request that does not fit its contract."""


def store_type(type_text: str, flow: str = "contract") -> T.DataType:
    """Spark type for a declared type name; unknown names are text."""
    name = type_text.strip().upper()
    if name == "INT":
        return T.IntegerType()
    if name == "BIGINT" and flow == "free":
        return T.LongType()
    if name == "FLOAT":
        return T.DoubleType()
    if name == "DATE":
        return T.DateType()
    if name == "BIT":
        return T.IntegerType() if flow == "free" else T.StringType()
    if name.startswith("DECIMAL") and flow == "contract":
        return T.DecimalType(10, 2)
    return T.StringType()


def text_limit(type_text: str) -> int | None:
    """Length limit carried by NVARCHAR(n); None when unlimited or not text."""
    sized = re.fullmatch(r"NVARCHAR\((\d+)\)", type_text.strip().upper())
    return int(sized.group(1)) if sized else None


def check_headers(columns: Iterable[str], contract: Contract) -> None:
    """Raise with every missing required header; runs on names, before any job."""
    present = {names.header_key(c) for c in columns}
    missing = [h for h in contract.required_headers if names.header_key(h) not in present]
    if missing:
        raise ContractError(f"missing required columns: {', '.join(missing)}")


def project(df: DataFrame, contract: Contract, keep: Iterable[str] = ()) -> DataFrame:
    """Map headers to typed target columns in contract order.

    Headers match after trim and lower-casing, the first match wins, an unmatched optional
    header becomes NULL and unknown columns are dropped.  ``keep`` passes bookkeeping
    columns (row number, file) through untouched.
    """
    kept = list(keep)
    cells = _cells([c for c in df.columns if c not in kept], contract)
    typed = casts.apply_casts(df, {f.name: (_cast_of(f, contract), raw) for f, raw in cells}, kept)
    constants = [F.lit(c.value).cast(store_type(c.type)).alias(c.name) for c in contract.constants]
    return typed.select("*", *constants) if constants else typed


def _cells(columns: Sequence[str], contract: Contract) -> list[tuple[Field, Column]]:
    """Each field with the text column it is read from."""
    check_headers(columns, contract)
    by_key: dict[str, str] = {}
    for column in columns:
        by_key.setdefault(names.header_key(column), column)

    def cell(f: Field) -> Column:
        source = by_key.get(names.header_key(f.header))
        return F.lit(None).cast("string") if source is None else F.col(names.quoted(source)).cast("string")

    return [(f, cell(f)) for f in contract.fields]


def _cast_of(f: Field, contract: Contract) -> casts.Cast:
    return casts.contract_cast(f.type) if contract.flow == "contract" else casts.free_cast(f.type)


def cast_failures(df: DataFrame, contract: Contract) -> DataFrame:
    """Per column: how many filled cells became NULL when cast.  One pass, long result."""
    cells = _cells(df.columns, contract)
    wanted = {}
    for i, (f, raw) in enumerate(cells):
        wanted[f"v{i}"] = (_cast_of(f, contract), raw)
        wanted[f"t{i}"] = (casts.Cast(casts.is_filled), raw)
    both = casts.apply_casts(df, wanted)
    totals = both.agg(*[
        F.count_if(F.col(f"t{i}") & F.col(f"v{i}").isNull()).alias(f"f{i}") for i in range(len(cells))])
    entries = [
        F.struct(F.lit(f.name).alias("column_name"), F.col(f"f{i}").alias("cast_failures"))
        for i, (f, _) in enumerate(cells)
    ]
    return totals.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def with_overrides(contract: Contract, overrides: Mapping[str, Mapping[str, str]],
                   allowed: Iterable[str]) -> Contract:
    """Apply user choices per header: ``{"header": {"name": ..., "type": ...}}``.

    An unknown type falls back to NVARCHAR(255); an empty name keeps the old one.
    """
    allowed = set(allowed)
    fields = []
    for f in contract.fields:
        choice = overrides.get(f.header, {})
        name = names.sanitize_name(choice["name"]) if (choice.get("name") or "").strip() else f.name
        wanted = choice.get("type") or f.type
        fields.append(replace(f, name=name, type=wanted if wanted in allowed else "NVARCHAR(255)"))
    unique = names.unique_names([f.name for f in fields])
    return replace(contract, fields=tuple(replace(f, name=n) for f, n in zip(fields, unique)))


# A free column fits a table's column of these types; every value keeps its meaning.
_WIDER = {"INT": ("BIGINT", "FLOAT", "NVARCHAR(MAX)"), "BIGINT": ("FLOAT", "NVARCHAR(MAX)"),
          "FLOAT": ("NVARCHAR(MAX)",), "DATE": ("NVARCHAR(MAX)",)}


def with_table_types(contract: Contract, table: T.StructType | None) -> Contract:
    """A free contract whose columns take the wider types that an existing table has for them."""
    named = {T.LongType: "BIGINT", T.DoubleType: "FLOAT", T.StringType: "NVARCHAR(MAX)"}
    have = {f.name: named.get(type(f.dataType)) for f in table} if table else {}
    return replace(contract, fields=tuple(
        replace(f, type=have[f.name]) if have.get(f.name) in _WIDER.get(f.type, ()) else f for f in contract.fields))


class Registry:
    """Contracts by id; unknown or unfinished ones are refused."""

    def __init__(self, contracts: Iterable[Contract]):
        self._by_id = {c.id: c for c in contracts}

    def __iter__(self):
        return iter(self._by_id.values())

    def get(self, contract_id: str) -> Contract:
        if contract_id not in self._by_id:
            raise ContractError(f"unknown contract: {contract_id}")
        contract = self._by_id[contract_id]
        if not contract.ready:
            raise ContractError(f"contract is not ready: {contract_id}")
        return contract
