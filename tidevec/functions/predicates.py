"""Predicates over numeric ranges and label sets, as Catalyst expressions.

A conjunction is a list over the attributes: ``[lo, hi]`` for a numeric one
(both ends included), a list of labels for a categorical one, ``[]`` for no
constraint.  A disjunction is a list of such terms; there a numeric entry can
hold several pairs (any of them), and a mode per entry chooses for labels
between all of them (1, the default), any of them (0) and no check (-1).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ..schema import CATEGORICAL, MAX_TERMS, NUMERIC

SKIP, ANY, ALL = -1, 0, 1



def terms_type(types: Sequence[int] = (NUMERIC, CATEGORICAL)) -> str:
    """The type of a disjunction as data, one row per query: ranges of a numeric attribute, labels and a mode of a categorical one."""
    parts = [f"a{i}: array<struct<lo: int, hi: int>>" if kind == NUMERIC else f"a{i}: array<int>, a{i}_mode: int" for i, kind in enumerate(types)]
    return f"array<struct<{', '.join(parts)}>>"


TERMS_TYPE = terms_type()


def kinds_of(terms: StructType) -> dict[str, int]:
    """The attributes of a term held as data, by the fields of its struct."""
    return {f.name: NUMERIC if isinstance(f.dataType.elementType, StructType) else CATEGORICAL for f in terms.fields if isinstance(f.dataType, ArrayType)}


def in_range(c: Column, lo: int, hi: int) -> Column:
    return c.between(F.lit(int(lo)), F.lit(int(hi)))


def has_all(c: Column, labels: Sequence[int]) -> Column:
    return reduce(lambda a, b: a & b, [F.array_contains(c, int(x)) for x in sorted(set(labels))])


def has_any(c: Column, labels: Sequence[int]) -> Column:
    return F.arrays_overlap(c, F.array(*[F.lit(int(x)) for x in sorted(set(labels))]))


def _check_labels(labels: Sequence[int], max_cate_size: int | None) -> None:
    if any(x < 0 or (max_cate_size is not None and x >= max_cate_size) for x in labels):
        raise ValueError("label outside the categorical range")


def pairs_of(values: Sequence[int]) -> list[tuple[int, int]]:
    if len(values) % 2:
        raise ValueError("a numeric entry needs pairs of bounds")
    return [(int(a), int(b)) for a, b in zip(values[::2], values[1::2])]


def conjunction(predicate: Sequence[Sequence[int]], types: Sequence[int] = (NUMERIC, CATEGORICAL), max_cate_size: int | None = None) -> Column:
    """All attributes' constraints together; true for a predicate without any."""
    if len(predicate) != len(types):
        raise ValueError(f"{len(types)} attributes expected, got {len(predicate)}")
    parts = []
    for i, (values, kind) in enumerate(zip(predicate, types)):
        if not len(values):
            continue
        if kind == NUMERIC:
            if len(values) != 2:
                raise ValueError("a numeric constraint has no or two bounds")
            parts.append(in_range(F.col(f"a{i}"), *values))
        else:
            _check_labels(values, max_cate_size)
            parts.append(has_all(F.col(f"a{i}"), values))
    return reduce(lambda a, b: a & b, parts, F.lit(True)) if parts else F.lit(True)


def term(values_of: Sequence[Sequence[int]], modes: Sequence[int] | None = None, types: Sequence[int] = (NUMERIC, CATEGORICAL), max_cate_size: int | None = None) -> Column:
    """One term of a disjunction."""
    if len(values_of) != len(types):
        raise ValueError(f"{len(types)} attributes expected, got {len(values_of)}")
    parts = []
    for i, (values, kind) in enumerate(zip(values_of, types)):
        mode = ALL if modes is None else modes[i]
        if mode not in (SKIP, ANY, ALL):
            raise ValueError("modes are -1, 0 and 1")
        if mode == SKIP or not len(values):
            continue
        c = F.col(f"a{i}")
        if kind == NUMERIC:
            parts.append(reduce(lambda a, b: a | b, [in_range(c, lo, hi) for lo, hi in pairs_of(values)]))
        else:
            _check_labels(values, max_cate_size)
            parts.append(has_any(c, values) if mode == ANY else has_all(c, values))
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def disjunction(terms: Sequence[Sequence[Sequence[int]]], modes: Sequence[Sequence[int]] | None = None, types: Sequence[int] = (NUMERIC, CATEGORICAL), max_cate_size: int | None = None) -> Column:
    """Any of the terms; no term matches nothing, more than 16 are refused."""
    if len(terms) > MAX_TERMS:
        raise ValueError(f"at most {MAX_TERMS} terms")
    if modes is not None and len(modes) != len(terms):
        raise ValueError("one list of modes for each term")
    if not terms:
        return F.lit(False)
    return reduce(lambda a, b: a | b, [term(t, modes[i] if modes else None, types, max_cate_size) for i, t in enumerate(terms)])


def is_disjunction(predicates: Sequence) -> bool:
    """Whether a batch of predicates is [query][term][attr] rather than [query][attr], by its depth."""
    for q in predicates:
        for t in q:
            if len(t):
                return isinstance(t[0], (list, tuple))
    return False


def matches(terms: Column, a0: Column | None = None, a1: Column | None = None, attrs: dict[str, tuple[int, Column]] | None = None) -> Column:
    """A row against a disjunction held as data (``terms_type``), for predicates that differ by query.

    ``attrs`` has the kind and column of each attribute; without it there are a0 (numeric) and a1 (labels).
    """
    attrs = attrs if attrs is not None else {"a0": (NUMERIC, a0), "a1": (CATEGORICAL, a1)}

    def part(t: Column, name: str, kind: int, c: Column) -> Column:
        free = F.coalesce(F.size(t[name]), F.lit(0)) == 0
        if kind == NUMERIC:
            return free | F.exists(t[name], lambda r: c.between(r["lo"], r["hi"]))
        mode = t[f"{name}_mode"]
        held = F.when(mode == ANY, F.arrays_overlap(c, t[name])).otherwise(F.size(F.array_except(t[name], c)) == 0)
        return free | (mode == SKIP) | held

    return F.exists(terms, lambda t: reduce(lambda a, b: a & b, [part(t, name, *attr) for name, attr in attrs.items()], F.lit(True)))


def as_text(values_of: Sequence[Sequence[int]], types: Sequence[int] = (NUMERIC, CATEGORICAL)) -> str:
    """A term as a SQL filter string."""
    parts = []
    for i, (values, kind) in enumerate(zip(values_of, types)):
        if not len(values):
            continue
        if kind == NUMERIC:
            parts.append("(" + " OR ".join(f"a{i} BETWEEN {lo} AND {hi}" for lo, hi in pairs_of(values)) + ")")
        else:
            parts += [f"array_contains(a{i}, {int(x)})" for x in values]
    return " AND ".join(parts) if parts else "TRUE"


def flattened(predicate: Sequence[Sequence[int]], types: Sequence[int] = (NUMERIC, CATEGORICAL), max_cate_size: int = 64) -> list[int]:
    """The flat integer form: two bounds for a number ([-1, -1] for none), words of label bits for a category."""
    out: list[int] = []
    for values, kind in zip(predicate, types, strict=True):
        if kind == NUMERIC:
            if len(values) not in (0, 2):
                raise ValueError("a numeric constraint has no or two bounds")
            out += list(map(int, values)) or [-1, -1]
        else:
            _check_labels(values, max_cate_size)
            words = [0] * ((max_cate_size + 31) // 32)
            for x in values:
                words[x // 32] |= 1 << (x % 32)
            out += words if values else [(1 << 32) - 1] * len(words)
    return out


def mask_sql(c: str) -> str:
    """SQL for labels 0 to 62 as bits of a long."""
    return f"aggregate({c}, 0L, (m, x) -> m | shiftleft(1L, x))"


def from_mask(mask: Column, n: int) -> Column:
    """The labels whose bits are set."""
    return F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.getbit(mask, i) == 1)
