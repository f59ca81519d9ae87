"""Every constant of the analysis in one place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Ramps:
    eps: float = 0.02
    delta: float = 0.10
    min_minutes: int = 10


@dataclass(frozen=True)
class Tail:
    quantiles: tuple[float, ...] = (0.80, 0.90)
    near_m: float = 5000.0
    cloud_speeds_ms: tuple[float, ...] = (10.0, 15.0, 20.0)
    permutations: int = 199
    bootstraps: int = 100
    alpha: float = 0.05
    max_window_min: float = 30.0


@dataclass(frozen=True)
class Extremes:
    min_ramps: int = 60
    min_exceed: int = 5
    min_declustered: int = 30
    max_shape: float = 0.5
    run_lengths: int = 19
    #: Candidate run lengths in minutes; fixed values.
    run_lengths_min: tuple[float, ...] = (1, 2, 3, 5, 7, 10, 15, 20, 30, 45, 60, 90, 120, 180, 240, 360, 480, 720, 1440)
    quantile_low: float = 0.70
    quantile_high: float = 0.98
    min_candidate: int = 30
    min_series: int = 20
    min_clusters: int = 50
    horizons_years: tuple[float, ...] = (0.25, 0.5, 1.0, 2.0)


@dataclass(frozen=True)
class Resampling:
    replicates: int = 150
    position_draws: int = 1000


@dataclass(frozen=True)
class Geometry:
    earth_radius_m: float = 6_371_000.0
    metres_per_degree: float = 111_320.0


@dataclass(frozen=True)
class Config:
    ramps: Ramps = Ramps()
    tail: Tail = Tail()
    extremes: Extremes = Extremes()
    resampling: Resampling = Resampling()
    geometry: Geometry = Geometry()
    seed: int = 42
    test_from: str = "2024-01-23"


CONFIG = Config()
