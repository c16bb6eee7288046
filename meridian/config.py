"""Settings that the pipelines take explicitly."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    """Fixed values of the linkage policy, the time gates and the queue."""

    dev_end: str = "2026-06-30"
    eval_start: str = "2026-07-01"
    train_end: str = "2026-04-30"
    valid_start: str = "2026-05-01"
    high: tuple[float, float] = (0.90, 0.05)
    medium: tuple[float, float] = (0.78, 0.12)
    low: tuple[float, float] = (0.55, 0.20)
    phone_only_name_floor: float = 0.45
    candidate_cap: int = 300
    tier_shares: tuple[float, float, float] = (0.15, 0.30, 0.50)
    capacity: int = 10
    seed: int = 42
    # weights of a linkage score: phone, name, village, gender, age
    weights: tuple[float, ...] = (0.45, 0.35, 0.12, 0.05, 0.03)
    # weights of a priority: risk, urgency, consequence, feasibility
    priority: tuple[float, ...] = (0.60, 0.25, 0.10, 0.05)


DEFAULT = Settings()
