"""Vector expressions. Every sum is accumulated in DOUBLE and stays on the JVM side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def _col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: ColumnLike, b: ColumnLike) -> Column:
    """Inner product."""
    return _total(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")))


def norm(v: ColumnLike) -> Column:
    """Euclidean length."""
    return F.sqrt(_total(F.transform(_col(v), lambda x: x.cast("double") * x.cast("double"))))


def l2_normalize(v: ColumnLike) -> Column:
    """Unit-length copy; a zero vector has no direction and becomes null."""
    length = norm(v)
    return F.when(length > 0, F.transform(_col(v), lambda x: x.cast("double") / length))


def inner_product(a: ColumnLike, b: ColumnLike) -> Column:
    """Similarity score; larger is nearer."""
    return dot(a, b)


def l2_distance(a: ColumnLike, b: ColumnLike) -> Column:
    """Euclidean distance."""

    def squared_gap(x: Column, y: Column) -> Column:
        gap = x.cast("double") - y.cast("double")
        return gap * gap

    return F.sqrt(_total(F.zip_with(_col(a), _col(b), squared_gap)))


def cosine_distance(a: ColumnLike, b: ColumnLike) -> Column:
    """One minus the cosine; null when either vector is zero."""
    lengths = norm(a) * norm(b)
    return F.when(lengths > 0, F.lit(1.0) - dot(a, b) / lengths)


WORD_BITS = 32


def binary_quantize(v: ColumnLike) -> Column:
    """Sign bits (1 where x > 0) packed into BIGINT words of 32 dimensions, first one lowest."""
    vec = _col(v)
    words = F.sequence(F.lit(0), F.ceil(F.size(vec) / F.lit(WORD_BITS)).cast("int") - 1)

    def pack(w: Column) -> Column:
        part = F.slice(vec, w * WORD_BITS + 1, F.lit(WORD_BITS))
        bits = F.transform(part, lambda x, i: F.when(x > 0, F.expr("1L")).otherwise(F.expr("0L")) * F.pow(F.lit(2.0), i).cast("bigint"))
        return F.aggregate(bits, F.expr("0L"), lambda acc, x: acc + x)

    return F.when(F.size(vec) > 0, F.transform(words, pack)).otherwise(F.expr("cast(array() as array<bigint>)"))


def _bits(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda acc, x: acc + F.bit_count(x))


def hamming_distance(a: ColumnLike, b: ColumnLike) -> Column:
    """Number of differing bits between packed words."""
    return _bits(F.zip_with(_col(a), _col(b), lambda x, y: x.bitwiseXOR(y))).cast("bigint")


def jaccard_distance(a: ColumnLike, b: ColumnLike) -> Column:
    """One minus shared bits over set bits; 0 when both have none."""
    shared = _bits(F.zip_with(_col(a), _col(b), lambda x, y: x.bitwiseAND(y)))
    either = _bits(F.zip_with(_col(a), _col(b), lambda x, y: x.bitwiseOR(y)))
    return F.when(either > 0, F.lit(1.0) - shared / either).otherwise(F.lit(0.0))


_METRICS: dict[str, tuple[Callable[[ColumnLike, ColumnLike], Column], bool]] = {
    "l2": (l2_distance, True),
    "cos": (cosine_distance, True),
    "ip": (inner_product, False),
    "dp": (inner_product, False),
    "hamming": (hamming_distance, True),
    "jaccard": (jaccard_distance, True),
}
_BUILT_IN = frozenset(_METRICS)


_BLOCKS: dict[str, Callable] = {}
_SINGLE: dict[str, float | None] = {}


def register_metric(name: str, expr: Callable[[ColumnLike, ColumnLike], Column], lower_is_nearer: bool = True, block: Callable | None = None, single: float | None = None) -> None:
    """Make a measure available by name: to the re-ranker by its expression, to the searches by its block form.

    ``block(a, b)`` is the same measure in numpy: it takes double arrays that broadcast, and
    reduces their last axis. It is sent to the executors. A vector that it gives NaN for is not ranked.
    With ``single``, the most that a component adds to its error in single precision, pairs are ruled out
    by ``block`` of single-precision arrays, and what is left is measured in double precision.
    """
    if name in _BUILT_IN:
        raise ValueError(f"{name!r} is a built-in metric")
    _METRICS[name] = (expr, lower_is_nearer)
    _BLOCKS.pop(name, None)
    _SINGLE[name] = single
    if block is not None:
        _BLOCKS[name] = block


def block_metric(name: str) -> Callable:
    """The numpy form of a registered metric."""
    metric(name)
    if name not in _BLOCKS:
        raise ValueError(f"metric {name!r} was registered without a block form, which searches need")
    return _BLOCKS[name]


def block_single(name: str) -> float | None:
    """What a component adds at most to the error of the numpy form in single precision, where that is known."""
    return _SINGLE.get(name)


def lower_is_nearer(name: str) -> bool:
    return metric(name)[1]


def metric(name: str) -> tuple[Callable[[ColumnLike, ColumnLike], Column], bool]:
    """The expression of a metric and whether smaller values are nearer."""
    if name not in _METRICS:
        raise ValueError(f"unknown metric {name!r}; known: {sorted(_METRICS)}")
    return _METRICS[name]
