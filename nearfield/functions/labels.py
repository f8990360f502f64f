"""Tenant, label and rate names; filter predicates; payload sizes; unit changes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tenant_for_id(row_id: Column, count: int, prefix: str = "tenant_", width: int = 4) -> Column:
    """``prefix`` and the zero-padded id modulo ``count``; long numbers are not cut."""
    number = F.pmod(row_id.cast("bigint"), F.lit(count))
    return F.concat(F.lit(prefix), F.format_string(f"%0{width}d", number))


def label_value(share: Column) -> Column:
    """Share of rows to label: 0.05 -> ``label_5p``, 0.001 -> ``label_0.1p``."""
    p = share * 100
    return F.when(p >= 1, F.format_string("label_%dp", p.cast("int"))).otherwise(F.format_string("label_%.1fp", p))


def int_rate(rate: Column) -> Column:
    """Removed share to rate name: 0.01 -> ``int_1p``, 0.995 -> ``int_99.5p``."""
    p = rate * 100
    whole = (p >= 1) & (p <= 99)
    return F.when(whole, F.format_string("int_%dp", p.cast("int"))).otherwise(F.format_string("int_%.1fp", p))


def int_truth_name(rate: Column) -> Column:
    """Truth table of an integer filter."""
    return F.concat(F.lit("neighbors_"), int_rate(rate))


def legacy_int_truth_name(rate: Column) -> Column:
    """Truth table of the older two integer filters; null for any other rate."""
    return F.when(rate == 0.01, F.lit("neighbors_head_1p")).when(rate == 0.99, F.lit("neighbors_tail_1p"))


def _rate_text(rate: float) -> str:
    p = rate * 100
    return f"{int(p)}p" if 1 <= p <= 99 else f"{p:.1f}p"


def int_truth_table(rate: float) -> str:
    """Truth table name of one integer-filter rate."""
    return f"neighbors_int_{_rate_text(rate)}"


def label_truth_table(share: float, field: str = "labels") -> str:
    """Truth table name of one label share."""
    p = share * 100
    return f"neighbors_{field}_label_{int(p)}p" if p >= 1 else f"neighbors_{field}_label_{p:.1f}p"


def int_at_least(column: Column, size: int, rate: float, strict: bool = False) -> Column:
    """Rows at or above ``int(size * rate)``: removes ``rate`` of a dense id range."""
    bound = F.lit(int(size * rate))
    return column > bound if strict else column >= bound


def label_equals(column: Column, value) -> Column:
    return column == F.lit(value)


def tenant_equals(column: Column, tenant: str, extra: Column | None = None) -> Column:
    """Tenant equality, AND-ed with any other predicate."""
    mine = column == F.lit(tenant)
    return mine if extra is None else mine & extra


def id_and_range(filters: dict, id_col: Column, range_col: Column) -> Column:
    """Exact ``id`` and/or lower bound on ``metadata``; no filter keeps every row."""
    out = F.lit(True)
    if filters.get("id") is not None:
        out = out & (id_col == F.lit(filters["id"]))
    if filters.get("metadata") is not None:
        out = out & (range_col >= F.lit(filters["metadata"]))
    return out


# Bytes per hit for the id and distance, a scalar label, a text; bytes per dimension.
HIT_BYTES, LABEL_BYTES, TEXT_BYTES, DIM_BYTES = 20, 16, 512, 4


def payload_bytes(profile: Column, k: Column, dim: Column) -> Column:
    """Estimated response bytes of one query; null for an unknown profile."""
    return (
        F.when(profile == "ids_only", k * HIT_BYTES)
        .when(profile == "vector", k * (dim * DIM_BYTES + HIT_BYTES))
        .when(profile == "scalar_label", k * (HIT_BYTES + LABEL_BYTES))
        .when(profile == "text", k * (HIT_BYTES + TEXT_BYTES))
    ).cast("bigint")


def to_thousands(count: Column) -> Column:
    """Counts to K, positive values only."""
    return F.when(count > 0, count / 1000).otherwise(count)


def to_millis(seconds: Column) -> Column:
    """Seconds to ms, positive values only; a missing value counts as 0."""
    s = F.coalesce(seconds, F.lit(0.0))
    return F.when(s > 0, s * 1000).otherwise(s)


def db_name(db: Column, label: Column, version: Column | None = None) -> Column:
    """``db[-label][-version]``, leaving out empty parts."""
    parts = [db, F.nullif(label, F.lit(""))]
    if version is not None:
        parts.append(F.nullif(version, F.lit("")))
    return F.concat_ws("-", *parts)
