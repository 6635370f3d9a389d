"""Settings of a run, and what follows from them by arithmetic."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, functions as F

from cuewright.functions.language import normalized


@dataclass(frozen=True)
class Settings:
    """The defaults. Times in seconds, trims in percent, the budget in minutes of audio."""

    preferred_languages: str = ""
    by_transcript: bool = False
    anchor_count: int = 5
    anchor_window_s: float = 30.0
    head_trim: float = 5.0
    tail_trim: float = 8.0
    max_offset_s: float = 120.0
    vad_windows: int = 12
    tolerance_s: float = 0.35
    max_residual_s: float = 1.5
    snap_frame_rates: bool = True
    min_error_to_repair_s: float = 0.6
    min_confidence_to_repair: float = 0.4
    chunk_s: float = 600.0
    audio_minute_budget: float = 240.0
    max_concurrency: int = 0
    cost_per_minute: Decimal = Decimal(0)

    def audio_seconds(self, tracks: int = 1) -> float:
        """Audio that one item sends to a transcriber."""
        return max(tracks, 0) * max(self.anchor_count, 0) * max(self.anchor_window_s, 0.0) if self.by_transcript else 0.0

    def quote(self, items: Column) -> list[Column]:
        """(items, minutes, over_budget) of a run over a count of items, before anything is spent."""
        minutes = items * (self.audio_seconds(1) / 60.0)
        over = F.lit(self.audio_minute_budget > 0) & (minutes > self.audio_minute_budget)
        return [items.alias("items"), minutes.alias("minutes"), over.alias("over_budget")]

    def lanes(self, cpus: int) -> int:
        """How many items may be in work at once."""
        return min(self.max_concurrency, 16) if self.max_concurrency > 0 else min(max(cpus // 2, 1), 4)


def language_list(setting: Column) -> Column:
    """Codes of a list with commas or semicolons, each once, in order."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(setting, F.lit("")), "[,;]"), normalized), lambda c: c != ""))
