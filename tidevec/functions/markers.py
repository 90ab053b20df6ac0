"""Markers: small bitmaps that say which slots a record, edge or cluster holds.

A Marker is an array of longs of ``bits`` bits.  Testing a predicate's Marker
never refuses a record that matches; what it lets through is checked exactly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .predicates import ANY, SKIP, pairs_of

WORD = 63  # bits used of each long, so that none is negative


def words(bits: int) -> int:
    return -(-bits // WORD)


def encode(slots: Column, bits: int) -> Column:
    """Marker of an array of slots."""

    def word(w: int) -> Column:
        here = F.filter(slots, lambda x: (x >= w * WORD) & (x < (w + 1) * WORD))
        bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x - w * WORD)
        return F.aggregate(here, F.lit(0).cast("long"), lambda m, x: m.bitwiseOR(bit(x)))

    return F.array(*[word(w) for w in range(words(bits))])


def literal(slots: Sequence[int], bits: int) -> list[int]:
    out = [0] * words(bits)
    for s in slots:
        out[s // WORD] |= 1 << (s % WORD)
    return out


def merged(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseOR(y))


def merged_agg(marker: Column, bits: int) -> Column:
    """Aggregate: the union of many Markers, word by word."""
    return F.array(*[F.coalesce(F.bit_or(F.get(marker, w)), F.lit(0).cast("long")) for w in range(words(bits))])


def covers(marker: Column, record: Column) -> Column:
    """All bits of the record are in the Marker."""
    return F.forall(F.zip_with(marker, record, lambda m, r: m.bitwiseAND(r) == r), lambda x: x)


def overlaps(marker: Column, wanted: Sequence[int]) -> Column:
    return F.exists(F.zip_with(marker, F.array(*[F.lit(x).cast("long") for x in wanted]), lambda m, p: m.bitwiseAND(p) != 0), lambda x: x)


def holds(marker: Column, wanted: Sequence[int]) -> Column:
    return covers(marker, F.array(*[F.lit(x).cast("long") for x in wanted]))


def n_bits(marker: Column) -> Column:
    return F.aggregate(marker, F.lit(0), lambda s, m: s + F.bit_count(m).cast("int"))


def range_slots(lo: int, hi: int, starts: Sequence[int]) -> list[int]:
    """Slots that values of [lo, hi] fall in."""
    slot = lambda v: max(0, sum(s <= v for s in starts) - 1)
    return list(range(slot(lo), slot(hi) + 1)) if lo <= hi else []


def term_gate(values_of: Sequence[Sequence[int]], books: Sequence, bits: int, modes: Sequence[int] | None = None, prefix: str = "m") -> Column:
    """A term against the Markers m0, m1, ... of as many attributes as there are codebooks.

    A numeric attribute's book is its slot starts (a list), a label
    attribute's its slots by label (a dict).  Labels without a slot match nothing when all labels are asked for.
    """
    if len(values_of) != len(books):
        raise ValueError(f"{len(books)} attributes expected, got {len(values_of)}")
    out = F.lit(True)
    for i, (values, book) in enumerate(zip(values_of, books)):
        mode = None if modes is None else modes[i]
        if not len(values) or mode == SKIP:
            continue
        m = F.col(f"{prefix}{i}")
        if not isinstance(book, dict):
            slots = sorted({s for lo, hi in pairs_of(values) for s in range_slots(lo, hi, book)})
            out = out & overlaps(m, literal(slots, bits))
            continue
        known = [book[x] for x in values if book.get(x, -1) >= 0]
        if mode == ANY:
            out = out & overlaps(m, literal(known, bits))
        elif len(known) < len(values):
            out = F.lit(False)
        else:
            out = out & holds(m, literal(known, bits))
    return out


def gate(terms: Sequence, books: Sequence, bits: int, modes: Sequence | None = None, prefix: str = "m") -> Column:
    """Any of the terms, see ``term_gate``."""
    out = F.lit(False)
    for i, t in enumerate(terms):
        out = out | term_gate(t, books, bits, modes[i] if modes else None, prefix)
    return out


def term_test(values_of: Sequence[Sequence[int]], starts: Sequence[int], mapping: dict[int, int], bits: int, modes: Sequence[int] | None = None) -> Column:
    """A term against the Markers of attribute 0 (numeric) and 1 (labels)."""
    return term_gate(values_of, (list(starts), mapping), bits, modes)


def disjunction_test(terms: Sequence, starts: Sequence[int], mapping: dict[int, int], bits: int, modes: Sequence | None = None) -> Column:
    return gate(terms, (list(starts), mapping), bits, modes)


def rates(passed: Column, matched: Column) -> list[Column]:
    """Aggregates of a pruning test: rows, passed, true and false positives, and their shares."""
    n, p = F.count(F.lit(1)), F.count_if(passed)
    tp, fp = F.count_if(passed & matched), F.count_if(passed & ~matched)
    return [
        n.alias("rows"), p.alias("passed"), tp.alias("true_positives"), fp.alias("false_positives"),
        F.count_if(~passed & matched).alias("false_negatives"),
        F.coalesce(F.try_divide(fp.cast("double"), p.cast("double")), F.lit(0.0)).alias("fp_rate"),
        F.coalesce(F.try_divide((n - p).cast("double"), n.cast("double")), F.lit(0.0)).alias("rejection_rate"),
    ]
