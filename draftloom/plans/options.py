"""Thresholds of the engine, as literals for plans (Catalyst folds them)."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Options:
    min_wall_length: float = 24.0
    snap: float = 2.0
    axis_tolerance: float = 1.5
    pair_min: float = 2.0
    pair_max: float = 24.0
    pair_overlap: float = 0.55
    opening_min: float = 8.0
    opening_max: float = 60.0
    run_gap: float = 6.0
    nearby_radius: float = 90.0
    nearby_count: int = 5
    seeds_per_page: int = 15_000
    linework_per_page: int = 6_000
    candidates_per_page: int = 400
    crops_per_page: int = 200
    rooms_per_page: int = 250
    arcs_per_page: int = 1_200
    junction_tolerance: float = 0.001


DEFAULT = Options()
