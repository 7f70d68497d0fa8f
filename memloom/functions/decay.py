"""Forgetting curves and access scores as column expressions. Times are explicit: every function takes ``as_of``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
RATE = 0.0015
CURVE_RATES = {"standard": 0.0015, "optimistic": 0.0005, "pessimistic": 0.003}
SCORE_CAP = 10.0


@dataclass(frozen=True)
class DecayConfig:
    """Decay per hour, bounds of a score, boost of one access."""

    rate: float = RATE
    min_score: float = 0.1
    max_score: float = SCORE_CAP
    boost: float = 1.0

    def __post_init__(self):
        if not 0 <= self.rate <= 1:
            raise ValueError("rate is outside [0, 1]")
        if self.min_score < 0 or self.max_score <= self.min_score:
            raise ValueError("bounds of the score are no interval")


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def hours(since: Column, as_of: Column) -> Column:
    """Fractional hours, not below 0."""
    return F.greatest((F.unix_micros(as_of) - F.unix_micros(since)) / 3.6e9, F.lit(0.0))


def whole_hours(since: Column, as_of: Column) -> Column:
    return F.floor(hours(since, as_of)).cast("double")


def node_decayed(score: Column, accessed: Column, as_of: Column, rate: float = RATE) -> Column:
    """Score after whole hours without access; never accessed: as it is."""
    return F.when(accessed.isNull(), score).otherwise(score * F.exp(-F.lit(rate) * whole_hours(accessed, as_of)))


def retention(t: Column, curve: str = "ebbinghaus", alpha: float = 0.5) -> Column:
    """Share kept after t hours."""
    if curve == "ebbinghaus":
        return F.exp(-F.lit(RATE) * t)
    if curve == "power_law":
        return F.when(t <= 1, F.lit(1.0)).otherwise(F.pow(t, F.lit(-alpha)))
    if curve == "hyperbolic":
        return 1 / (1 + 0.01 * t)
    if curve == "none":
        return F.lit(1.0)
    raise ValueError(f"curve {curve!r}")


def curve_rate(kind: str, repetitions: Column | None = None) -> Column:
    if kind == "with_repetition":
        return F.lit(RATE) / (1 + F.log1p(repetitions))
    return F.lit(CURVE_RATES[kind])


def time_to_threshold(threshold: Column, rate: Column) -> Column:
    """Hours until retention falls to the threshold; null outside (0, 1)."""
    return F.when((threshold > 0) & (threshold < 1), -F.log(threshold) / rate)


def current_score(score: Column, accessed: Column, as_of: Column, config: DecayConfig = DecayConfig()) -> Column:
    """Accessed: decayed by fractional hours and clamped; never accessed: as it is."""
    faded = score * F.exp(-F.lit(config.rate) * hours(accessed, as_of))
    return F.when(accessed.isNull(), score).otherwise(clamp(faded, config.min_score, config.max_score))


def raw_score(score: Column, accessed: Column, as_of: Column, config: DecayConfig = DecayConfig()) -> Column:
    """As current_score, without the clamp: what pruning goes by."""
    return F.when(accessed.isNull(), score).otherwise(score * F.exp(-F.lit(config.rate) * hours(accessed, as_of)))


def boosted(score: Column, times: Column, config: DecayConfig = DecayConfig()) -> Column:
    return clamp(score + config.boost * times, config.min_score, config.max_score)


def accessed(score: Column, boost: Column) -> Column:
    return clamp(score + boost, 0.0, SCORE_CAP)


def reinforced(score: Column, delta: Column) -> Column:
    return F.least(score + delta, F.lit(SCORE_CAP))


def should_archive(score: Column, last: Column, as_of: Column, threshold: float) -> Column:
    return node_decayed(score, last, as_of) < threshold
