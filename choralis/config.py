"""All settings of an analysis, and the bounds that follow from them."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Thresholds:
    human: float = 0.40
    automation: float = 0.65

    def __post_init__(self):
        if not 0 <= self.human <= self.automation <= 1:
            raise ValueError("thresholds must satisfy 0 <= human <= automation <= 1")

    def at(self, sensitivity: float) -> Thresholds:
        """The thresholds at another sensitivity, 0 to 100; 50: these."""
        shift = (sensitivity - 50) / 50 * 0.2
        high = min(max(self.automation - shift, 0.3), 0.95)
        return Thresholds(min(max(self.human - shift, 0.05), high - 0.05), high)


@dataclass(frozen=True)
class Config:
    max_replies: int = 400
    max_text: int = 5000
    max_id: int = 100
    similar: float = 0.72
    top_k: int = 6
    near_duplicate: float = 0.93
    coordinated: float = 0.75
    text_weight: float = 0.55
    timing_weight: float = 0.30
    pattern_weight: float = 0.15
    window_seconds: int = 120
    min_cluster: int = 3
    large_cluster: int = 5
    min_phrase_accounts: int = 3
    max_patterns: int = 30
    burst: int = 2
    retention: int = 30
    idle_scans: int = 5
    capture_minutes: int = 6
    scorer_partitions: int = 8
    scorer: str = "heuristic"
    scorer_url: str = ""
    scorer_token: str = field(default="", repr=False)
    scorer_seconds: float = 8.0
    scorer_model: str = ""
    quiet_ms: int = 2_000
    longest_wait_ms: int = 6_000
    thresholds: Thresholds = field(default_factory=Thresholds)

    @property
    def least_similarity(self) -> float | None:
        """Pairs below can't reach the rounded coordination score, however close in time and phrases; None: no bound."""
        spare = self.coordinated - 0.0005 - self.timing_weight - self.pattern_weight
        return spare / self.text_weight if spare > 0 else None

    @property
    def most_seconds(self) -> float | None:
        """Pairs further apart can't reach it, however similar; None: no bound."""
        spare = self.coordinated - 0.0005 - self.text_weight - self.pattern_weight
        return self.window_seconds * (1 - spare / self.timing_weight) if spare > 0 else None
