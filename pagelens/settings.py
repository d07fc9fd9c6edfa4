"""Thresholds the rules run with, passed to operators as literals."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    det_conf: float = 0.30
    text_iou: float = 0.45
    parent_iou: float = 0.65
    parent_contain: float = 0.80
    nested_contain: float = 0.80
    parent_cover: float = 0.65
    parent_slack: float = 0.05
    tile_overlap: float = 0.15
    tile_gate: int = 900
    tile_margin: float = 2.0
    seed_thresh: float = 0.50
    grow_thresh: float = 0.118
    dilate_ratio: float = 0.30
    halo_deviation: int = 12
    min_component: int = 50
    min_ink_ratio: float = 0.015
    flat_spread: int = 10
    flat_spread_noisy: int = 7
    min_font: int = 11
    min_font_ref_width: int = 1134
    min_font_abs: int = 6
    max_font: int = 96
    cap_per_side: float = 0.117
    cap_per_size: float = 0.844
    pad_ratio: float = 0.04
    condense: float = 0.85
    residue_deviation: int = 20
    residue_blob_max: int = 12
    max_escalation: int = 2
    chunk: int = 50
    retry_gap_seconds: int = 1800
    deadline_seconds: float = 240.0


SETTINGS = Settings()
