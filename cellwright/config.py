"""Settings of the operators: plain values with validation, no behaviour."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Months from here on are the hold-out period.
HOLD_OUT_FROM = (2023, 1)

#: States of a month: closed vocabulary.
STATES = {
    0: "not loaded",
    1: "finished",
    2: "incomplete",
    3: "being written",
    4: "region complete",
    5: "not at provider",
}
FINISHED, REGION = 1, 4


class HoldOutLocked(ValueError):
    """A month of the hold-out period was asked for without release."""


class MonthNotFinished(ValueError):
    """An asked-for month is not finished; unfinished months are never read as empty."""


class CubeFormatError(ValueError):
    """A table lacks what a cube or its state table must have."""


@dataclass(frozen=True)
class SnowRule:
    min_lat: float = 23.5
    winter_north: tuple = (11, 12, 1, 2, 3, 4)
    winter_south: tuple = (5, 6, 7, 8, 9, 10)
    observed_below: float = 0.9


@dataclass(frozen=True)
class Thresholds:
    """Anomaly detection."""

    pixels_per_cell: int = 3600
    cell_degrees: float = 0.25
    min_observed: float = 0.5
    medium_observed: float = 0.7
    good_observed: float = 0.9
    min_base_years: int = 5
    medium_base_years: int = 6
    good_base_years: int = 8
    mad_factor: float = 1.4826
    min_spread: float = 0.5
    pool_percentile: float = 75.0
    pool_brightness: float = 1.0
    pool_min_cells: int = 100
    q: float = 0.05
    z_min: float = 5.0
    min_cells: int = 4
    min_months: int = 1
    z_strong: float = 8.0
    z_extreme: float = 12.0
    diagnosis_median_z: float = 0.5
    diagnosis_marked: float = 0.10
    snow: SnowRule = field(default_factory=SnowRule)

    def __post_init__(self):
        if not 0 < self.min_observed <= self.medium_observed <= self.good_observed <= 1:
            raise ValueError("observed shares must rise from above 0 to at most 1")
        if not 2 <= self.min_base_years <= self.medium_base_years <= self.good_base_years:
            raise ValueError("base years must rise from at least 2")
        if not 0 < self.z_min <= self.z_strong <= self.z_extreme:
            raise ValueError("bands must rise from above 0")
        if not 0 < self.q < 1:
            raise ValueError("q must lie between 0 and 1")
        if self.min_cells < 1 or self.min_months < 1:
            raise ValueError("min_cells and min_months must be at least 1")
        if self.diagnosis_median_z <= 0 or not 0 < self.diagnosis_marked <= 1:
            raise ValueError("diagnosis bounds must be positive")


@dataclass(frozen=True)
class MinLengths:
    mann_kendall: int = 24
    autocorrelation: int = 60
    per_calendar_month: int = 3
    base_years: int = 5
    moran_cells: int = 30

    def __post_init__(self):
        if self.mann_kendall < 10 or self.autocorrelation < self.mann_kendall:
            raise ValueError("mann_kendall must be at least 10 and not above autocorrelation")
        if self.per_calendar_month < 2 or self.base_years < 2 or self.moran_cells < 3:
            raise ValueError("minimum lengths too small")


@dataclass(frozen=True)
class TrendSettings:
    min_observed: float = 0.5
    alpha_global: float = 0.05
    band_level: float = 0.95
    moran_slices: int = 12
    min_cells: int = 4
    relative_brightness: float = 1.0
    exclude_snow: bool = True
    hamed_rao_lags: int = 3
    lengths: MinLengths = field(default_factory=MinLengths)
    snow: SnowRule = field(default_factory=SnowRule)


@dataclass(frozen=True)
class LinkSettings:
    distribution: str = "normalised"
    min_land: float = 0.05
    purity_threshold: float = 0.9
    purity_limit: float = 0.5
    min_coverage: float = 0.9
    min_observed: float = 0.5
    with_unclear: bool = True
    snow: SnowRule = field(default_factory=SnowRule)

    def __post_init__(self):
        if self.distribution not in ("normalised", "area"):
            raise ValueError("distribution is 'normalised' or 'area'")
        if not (0 <= self.min_land < 1 and 0 < self.min_coverage <= 1 and 0 < self.min_observed <= 1):
            raise ValueError("limits out of range")


@dataclass(frozen=True)
class CrossSectionRules:
    min_good_months: int = 6
    few_months_up_to: int = 8
    north_limit: float = 65.0
    pure_from: float = 0.999
    purity_limit: float = 0.5
    purity_variants: tuple = (0.3, 0.7)
    min_light_coverage: float = 0.9
    few_months_share: float = 1 / 3
    bootstrap: int = 2000
    seed: int = 20260928
    link: LinkSettings = field(default_factory=LinkSettings)


@dataclass(frozen=True)
class SeriesRules:
    min_coverage: float = 0.9
    snow_from: float = 0.05
    not_loaded_from: float = 0.005
    window: int = 12
    per_calendar_month: int = 3
    index_year: int = 2018


@dataclass(frozen=True)
class DiagnosisRules:
    min_observed: float = 0.5
    base_years: tuple = tuple(range(2013, 2020))
    min_base_years: int = 4
    min_level_months: int = 42
    min_base_value: float = 0.5
    dark_to: float = 0.5
    medium_to: float = 5.0
    bootstrap: int = 500
    seed: int = 20261005
    edge_months: int = 12
    block_months: int = 12
    r1_land: float = 0.99
    r1_lat: tuple = (15.0, 35.0)
    r1_min_months: int = 60
    r1_max: float = 0.1
    r2_lat: float = 50.0
    r2_min_months: int = 70
    r2_per_year: int = 6
    r2_deviation: float = 0.048790164169432  # ln 1.05
    r2_min_cells: int = 30
    r2_fallback: float = 0.1
    panel_lat: float = 35.0


@dataclass(frozen=True)
class Criteria:
    """Two-source comparison."""

    dark_to: float = 0.5
    medium_to: float = 5.0
    log_offset: float = 0.1
    k1_r: float = 0.95
    k2_median: tuple = (0.90, 1.10)
    k2_deviation: float = 0.15
    k3_factor2: float = 0.05
    k4_false_from: float = 1.0
    k4_share: float = 0.02
    k5_same: float = 0.95
    k5_missing: float = 0.05
    k6_city: tuple = (0.67, 1.5)
    k6_desert: float = 0.5


@dataclass(frozen=True)
class AbsenceRules:
    """Tiles that a provider is known to lack. At most ten, in the four northern rows, from April to August."""

    most: int = 10
    rows: tuple = (0, 1, 2, 3)
    months: tuple = (4, 5, 6, 7, 8)
    shown: int = 5

    def __post_init__(self):
        if self.most < 0 or self.shown < 1 or not self.months:
            raise ValueError("most must not be negative, shown must be at least 1, months must name one")


# Latitude bands of the comparison, north to south, lower end included.
LATITUDE_BANDS = ((76, 80), (72, 76), (68, 72), (65, 68), (60, 65), (55, 60), (40, 55), (20, 40), (0, 20), (-20, 0), (-40, -20), (-60, -40))
