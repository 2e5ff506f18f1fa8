"""The public search verb, store presets, and the choice of strategy."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame

from vexel.functions import filters
from vexel.operators import indexes, knn


@dataclass(frozen=True)
class Config:
    dimension: int
    lists: int = 256
    probes: int = 8
    metric: str = "euclidean"
    strategy: str = "adaptive"
    exact_up_to: int = 100_000  # rows up to which adaptive search is exact
    compression: str = "zstd"


#: Named starting points.
PRESETS = {
    "quick": Config(128, lists=16, probes=4),
    "research": Config(768, lists=1024, probes=64, strategy="exact"),
    "production": Config(768, lists=1024, probes=16),
    "enterprise": Config(1536, lists=4096, probes=32),
    "embedded": Config(64, lists=16, probes=2, exact_up_to=10_000),
}


def preset(name: str, **changes: object) -> Config:
    return replace(PRESETS[name], **changes)  # type: ignore[arg-type]


@dataclass
class Index:
    """An inverted-list index: the rows with list_id, and the centroids."""

    lists: DataFrame
    centroids: np.ndarray


def search(rows: DataFrame, queries: DataFrame, k: int = 10, metric: str = "cosine", strategy: str = "adaptive", where: Column | object | None = None, index: Index | None = None, config: Config | None = None) -> DataFrame:
    """query_id, rank, id, distance of the k nearest rows that meet the condition.

    rows: id, vector and what the condition reads; queries: query_id, query. The condition (a column or a filter tree) is
    applied before the cut to k. Without an index, and for few rows under the adaptive strategy, the search is exact.
    """
    config = config or Config(0)
    if where is not None and not isinstance(where, Column):
        where = filters.compile_filter(where)
    exact = index is None or strategy == "exact" or (strategy == "adaptive" and rows.limit(config.exact_up_to + 1).count() <= config.exact_up_to)
    if exact:
        return knn.search(rows, queries, k, metric, where)
    return indexes.search_lists(index.lists, index.centroids, queries, k, config.probes, strategy, metric, where)
