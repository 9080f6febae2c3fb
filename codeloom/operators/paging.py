"""Keyset pages over any DataFrame with a total order, and prefixes within a byte budget."""

from __future__ import annotations

import base64
import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DEFAULT_LIMIT, MAX_LIMIT = 20, 200
RESPONSE_BYTES, TALLY_RESERVE = 20_000, 8_000
TALLY_FILES = 200


@dataclass(frozen=True)
class Key:
    """A sort column. Booleans sort as 0 and 1, so that every engine agrees on the order."""

    column: str
    descending: bool = False

    def value(self) -> Column:
        return F.col(self.column)

    def order(self) -> Column:
        return self.value().desc() if self.descending else self.value().asc()


STRUCTURAL = (Key("resolvedRank", True), Key("locality"), Key("id"))
OUTLINE = (Key("startLine"), Key("startCol"), Key("id"))
SCORE = (Key("score", True), Key("id"))


@dataclass
class Page:
    """One page of results; ``all_unresolved`` says that it has rows and none is resolved."""

    results: list[Row] = field(default_factory=list)
    has_more: bool = False
    next_cursor: str | None = None
    all_unresolved: bool = False


def clamp(limit: int | None) -> int:
    return DEFAULT_LIMIT if limit is None else max(1, min(limit, MAX_LIMIT))


def encode_cursor(values: dict) -> str:
    return base64.b64encode(json.dumps(values, separators=(",", ":")).encode()).decode()


def decode_cursor(cursor: str, keys: tuple[Key, ...]) -> list:
    """The values that a cursor holds for the keys; ValueError if it isn't one."""
    try:
        held = json.loads(base64.b64decode(cursor, validate=True))
        return [held[k.column] for k in keys]
    except (ValueError, KeyError, TypeError) as e:
        raise ValueError(f"not a cursor for this order: {cursor!r}") from e


def after(keys: tuple[Key, ...], values: list) -> Column:
    """Rows strictly behind a position: a chain of comparisons that also reaches the scan's statistics."""
    out, equal = F.lit(False), F.lit(True)
    for key, value in zip(keys, values, strict=True):
        c = key.value()
        out = out | (equal & (c < F.lit(value) if key.descending else c > F.lit(value)))
        equal = equal & (c == F.lit(value))
    return out


def page_frame(df: DataFrame, keys: tuple[Key, ...], rows: int, cursor: list | None = None) -> DataFrame:
    """The first rows behind a cursor, in order: a filter and a top-n, never an offset."""
    df = df if cursor is None else df.where(after(keys, cursor))
    return df.orderBy(*[k.order() for k in keys]).limit(rows)


def budget_frame(df: DataFrame, keys: tuple[Key, ...], columns: list[str], budget: int) -> DataFrame:
    """The longest prefix whose JSON array fits a byte budget; one row at least.

    For page frames: it orders the rows in one task, so the caller bounds them first.
    """
    item = F.octet_length(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))
    order = W.orderBy(*[k.order() for k in keys])
    run = order.rowsBetween(W.unboundedPreceding, 0)
    out = df.withColumn("_bytes", F.sum(item).over(run) + F.row_number().over(order) + 1).withColumn("_row", F.row_number().over(order))
    return out.where((F.col("_bytes") <= budget) | (F.col("_row") == 1)).drop("_bytes", "_row")


def paginate(df: DataFrame, keys: tuple[Key, ...], limit: int | None = None, cursor: str | None = None, columns: list[str] | None = None, budget: int | None = None) -> Page:
    """Collects one page: at most ``limit`` rows and ``budget`` bytes of JSON; one row more tells whether there is more."""
    size = clamp(limit)
    rows = page_frame(df, keys, size + 1, decode_cursor(cursor, keys) if cursor else None).collect()
    more, rows = len(rows) > size, rows[:size]
    if budget is not None and rows:
        names, used, kept = columns or list(rows[0].asDict()), 1, 0
        for row in rows:
            used += len(json.dumps({n: row[n] for n in names}, separators=(",", ":"), ensure_ascii=False).encode()) + 1
            if used > budget and kept:
                break
            kept += 1
        more, rows = more or kept < len(rows), rows[:kept]
    last = encode_cursor({k.column: rows[-1][k.column] for k in keys}) if more and rows else None
    flags = [r["resolved"] for r in rows if "resolved" in r.asDict()]
    return Page(rows, more, last, bool(flags) and not any(flags))
