"""Thresholds of the attribution operators, as plan-time constants."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    fps: float = 2.0
    match_threshold: float = 0.72
    debounce_seconds: float = 1.0
    grace_bridge_seconds: float = 3.0
    caption_lag_seconds: float = 1.5
    caller_label: str = "Caller"
    self_label: str = "You"
    caption_region: tuple[int, int, int, int] | None = None
    dark_level: int = 90
    dark_fraction: float = 0.35


def parse_region(value: str) -> tuple[int, int, int, int]:
    """``x,y,w,h`` as four whole numbers."""
    parts = value.split(",")
    if len(parts) != 4:
        raise ValueError(f"a region has four numbers x,y,w,h: {value!r}")
    x, y, w, h = (int(p) for p in parts)
    return x, y, w, h
