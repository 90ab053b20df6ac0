"""Choice of access path: exact filtered scan or probing clusters, by estimated matches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import disjunction, is_disjunction
from ..operators import ann
from ..operators.knn import knn
from ..schema import SearchConfig


def term_selectivity(shares: Sequence[float]) -> float:
    """Share of rows that meet all constraints, taken as independent."""
    out = 1.0
    for s in shares:
        out *= s
    return out


def any_selectivity(shares: Sequence[float]) -> float:
    """Share of rows that meet any of several independent terms."""
    out = 1.0
    for s in shares:
        out *= 1.0 - s
    return 1.0 - out


def choose(estimate: float, total: float, config: SearchConfig) -> str:
    """``exact`` when few rows match or the policy demands it, else ``probe``."""
    if config.policy == "strict" or not total or estimate / total <= config.exact_below:
        return "exact"
    return "probe"


def hybrid(index: ann.ClusterIndex, queries: DataFrame, predicate: Sequence, k: int = 10, config: SearchConfig = SearchConfig(), modes: Sequence | None = None) -> DataFrame:
    """Filtered search by the cheaper path; ``predicate`` is a conjunction or a list of terms."""
    terms = list(predicate) if is_disjunction([predicate]) or not predicate else [list(predicate)]
    estimate, total = ann.estimated_rows(index, terms, modes).agg(F.sum("estimate")).first()[0] or 0, index.clusters.agg(F.sum("live")).first()[0] or 0
    if choose(float(estimate), float(total), config) == "exact":
        live = index.points.where(~F.col("deleted"))
        return knn(live, queries, k, index.cfg.space, disjunction(terms, modes, index.cfg.attr_types))
    return ann.search(index, queries, k, config, terms, modes)
