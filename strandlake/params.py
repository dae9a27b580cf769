"""Pipeline parameters. The defaults are fixed values that define the results."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    # field to skeleton
    core_threshold: float = 0.28
    smooth_sigma: float = 0.60
    spur_rounds: int = 0
    # severing of short cross links
    max_rung_length: int = 14
    min_neighbor_length: int = 30
    perp_thresh: float = 0.50
    # gap bridging
    max_gap: float = 24.0
    mutual_thresh: float = 0.50
    min_turn_cos: float = -0.30
    durable_thresh: float = 0.40
    durable_min_fraction: float = 0.40
    gap_samples: int = 7
    # fragments and chains
    min_fragment_length: int = 1
    max_commit_cost: float = 35.0
    min_chain_length: int = 5
    # diffusion
    fg_threshold: float = 0.10
    vol_threshold: float = 0.05
    diffuse_rule: str = "flood"   # or "nearest"
    # borders and chunks
    cut_border: int = 32
    chunk_size: int = 512
    chunk_overlap: int = 256
    min_overlap_ratio: float = 0.80


# Cost weights (fixed values).
LENGTH_BONUS = 0.10
CURVATURE_WEIGHT = 8.0
SHARP_ANGLE_DEG = 55.0
SHARP_PENALTY = 50.0
STUB_PENALTY = 200.0
STUB_LENGTH = 12
GAP_WEIGHT = 0.25
TURN_WEIGHT = 5.0
