"""Settings of a linkage run."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class LinkConfig:
    """What a run can be tuned by. Reference records are "S1", those to be linked "R"."""

    k: int = 10  # neighbours of an R record
    name_k: int = 5  # neighbours of one without an address, by name
    max_gap: float = 0.25  # a neighbour is dropped if it is that much less similar than the best
    buckets: int = 10  # of clusters, for folds
    fold_a: tuple[int, ...] = (2, 3, 4, 5)
    fold_b: tuple[int, ...] = (6, 7, 8, 9)
    kept_share: float = 0.9995  # of true pairs that the prefilter keeps
    thresholds: tuple[float, ...] = tuple(round(0.20 + 0.05 * i, 2) for i in range(16))
    floors: tuple[float, ...] = tuple(round(0.1 * i, 1) for i in range(10))
    confident_r: float = 0.5
    confident_s1: float = 0.9
