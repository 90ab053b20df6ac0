"""The data model: points with one vector and integer attributes, and an index's settings."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMERIC, CATEGORICAL = 0, 1
METRICS = ("l2", "ip", "cosine")
#: Version of the snapshot layout that this code writes and reads.
FORMAT_VERSION = 1
#: Most terms of a disjunction.
MAX_TERMS = 16


@dataclass(frozen=True)
class IndexConfig:
    """Settings of an index; defaults as in the reference behaviour."""

    dim: int
    space: str = "l2"
    max_elements: int = 1 << 40
    M: int = 16
    ef_construction: int = 200
    seed: int = 100
    ft_bits: int = 128
    attr_types: tuple[int, ...] = (NUMERIC, CATEGORICAL)
    max_cate_size: int = 5
    cht_quota: int = 16
    patch_ratio: float = 0.20
    rebuild_ratio: float = 0.50
    min_new_deletes: int = 100_000
    repair_ratio: float = 0.10
    codebook: tuple = field(default=())

    def __post_init__(self) -> None:
        if self.space not in METRICS:
            raise ValueError(f"space must be one of {METRICS}, not {self.space!r}")
        if self.dim <= 0:
            raise ValueError("dim must be positive")
        if any(t not in (NUMERIC, CATEGORICAL) for t in self.attr_types):
            raise ValueError("attribute types are 0 (numeric) and 1 (categorical)")
        if self.ft_bits <= 0 or self.ft_bits % 8:
            raise ValueError("ft_bits must be a positive multiple of 8")

    def attr(self, i: int) -> str:
        return f"a{i}"

    def with_(self, **changes) -> IndexConfig:
        return replace(self, **changes)

    def manifest(self) -> dict:
        return asdict(self) | {"format_version": FORMAT_VERSION}


@dataclass(frozen=True)
class SearchConfig:
    """Knobs of approximate search: clusters probed, pruning by Marker, the routing floor of clusters and of edges, seeds."""

    nprobe: int = 8
    use_markers: bool = True
    routing: bool = True
    min_clusters: int = 2
    min_degree: int = 10
    ef_top: int = 4
    exact_below: float = 0.05
    policy: str = "admit"

    @classmethod
    def variant(cls, name: str, **changes) -> SearchConfig:
        """Ablation variants: components switched on one after the other, or one switched off."""
        table = {
            "baseline": {"use_markers": False, "routing": False},
            "c1": {"use_markers": True, "routing": False},
            "c1_c2": {"use_markers": True, "routing": True, "exact_below": 0.0},
            "full": {},
            "without_c1": {"use_markers": False},
            "strict": {"policy": "strict"},
        }
        if name not in table:
            raise ValueError(f"unknown variant {name!r}")
        return cls(**(table[name] | changes))


def record_errors(df: DataFrame, cfg: IndexConfig) -> Column:
    """A message for a row that breaks the schema, else null."""
    bad = F.when(F.col("label").isNull() | (F.col("label") < 0), F.lit("label must be a non-negative integer"))
    bad = bad.when(F.col("vector").isNull() | (F.size("vector") != cfg.dim), F.lit(f"vector must have {cfg.dim} components"))
    bad = bad.when(F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit("vector must be finite"))
    for i, kind in enumerate(cfg.attr_types):
        c = F.col(cfg.attr(i))
        if kind == NUMERIC:
            bad = bad.when(c.isNull(), F.lit(f"attribute {i} needs exactly one number"))
        else:
            bad = bad.when(c.isNull(), F.lit(f"attribute {i} needs a list of labels"))
            bad = bad.when(F.exists(c, lambda x: x.isNull() | (x < 0) | (x >= cfg.max_cate_size)), F.lit(f"attribute {i} has a label outside [0, {cfg.max_cate_size})"))
    return bad


def checked(df: DataFrame, cfg: IndexConfig) -> DataFrame:
    """``df`` whose action fails on the first record that breaks the schema; Catalyst keeps the check in one pass."""
    bad = record_errors(df, cfg)
    return df.where(F.assert_true(bad.isNull(), F.coalesce(bad, F.lit(""))).isNull())


def wire_to_columns(attrs: Column, types: Sequence[int]) -> list[Column]:
    """Typed columns a0, a1, ... from the nested list form [attr][value...]."""
    out = []
    for i, kind in enumerate(types):
        v = F.get(attrs, i)
        out.append((F.get(v, 0) if kind == NUMERIC else F.array_sort(F.array_distinct(v))).alias(f"a{i}"))
    return out


def columns_to_wire(types: Sequence[int]) -> Column:
    """The nested list form of the typed columns."""
    return F.array(*[F.array(f"a{i}") if kind == NUMERIC else F.col(f"a{i}") for i, kind in enumerate(types)])
