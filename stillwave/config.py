"""Configurations: typed sections of TOML files with their invariants."""

from __future__ import annotations

import dataclasses
import datetime as dt
import math
import re
import tomllib
import typing
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ConfigError(ValueError):
    """A configuration that breaks an invariant."""


def exactly_one(**given) -> str:
    """The name of the only value that is given."""
    named = [k for k, v in given.items() if v is not None]
    if len(named) != 1:
        raise ConfigError(f"give exactly one of {', '.join(given)}; given: {', '.join(named) or 'none'}")
    return named[0]


Moment = dt.datetime | dt.date | str


def moment(value: Moment) -> dt.datetime:
    """A time from a date (its midnight), a time, or the text of either."""
    if isinstance(value, str):
        value = dt.datetime.fromisoformat(value)
    return value if isinstance(value, dt.datetime) else dt.datetime.combine(value, dt.time())


def seconds(value: float | str | dt.timedelta) -> float:
    """A length of time from seconds or a text like "6 hours" or "1 day 30 min"."""
    if isinstance(value, dt.timedelta):
        return value.total_seconds()
    if not isinstance(value, str):
        return float(value)
    units = {"s": 1.0, "sec": 1.0, "second": 1.0, "min": 60.0, "minute": 60.0, "h": 3600.0, "hour": 3600.0, "d": 86_400.0, "day": 86_400.0, "w": 604_800.0, "week": 604_800.0}
    parts = re.findall(r"([0-9.]+)\s*([a-z]+)", value.lower())
    names = [u if u in units else u.removesuffix("s") for _, u in parts]
    if not parts or any(u not in units for u in names) or re.sub(r"[0-9.]+\s*[a-z]+|[\s,]+", "", value.lower()):
        raise ConfigError(f"{value!r} is no length of time")
    return sum(float(n) * units[u] for (n, _), u in zip(parts, names, strict=True))


def one_of(name: str, value: str, allowed: tuple[str, ...]) -> None:
    if value not in allowed:
        raise ConfigError(f"{name} {value}; known are {', '.join(allowed)}")


@dataclass(frozen=True)
class DatachunkParams:
    sampling_rate: float = 24.0
    prefiltering_low: float = 0.01
    prefiltering_high: float = 12.0
    prefiltering_order: int = 4
    preprocessing_taper_type: str = "cosine"
    preprocessing_taper_side: str = "both"
    preprocessing_taper_max_length: float = 5.0
    preprocessing_taper_max_percentage: float = 0.1
    remove_response: bool = False
    response_constant_coefficient: float | None = None
    datachunk_sample_tolerance: float | None = None
    #: The part of the samples that must be there: one less the tolerance. Give one of the two.
    datachunk_sample_threshold: float | None = None
    max_gap_for_merging: int = 10
    zero_padding_method: str = "padded"
    padding_taper_type: str = "cosine"
    padding_taper_max_length: float = 5.0
    padding_taper_max_percentage: float = 0.1

    def __post_init__(self):
        one_of("zero_padding_method", self.zero_padding_method, ("padded", "tapered_padded", "interpolated"))
        if self.datachunk_sample_tolerance is not None and self.datachunk_sample_threshold is not None:
            raise ConfigError("give only one of datachunk_sample_tolerance and datachunk_sample_threshold")
        tolerance = self.datachunk_sample_tolerance
        if tolerance is None:
            tolerance = 0.02 if self.datachunk_sample_threshold is None else 1 - self.datachunk_sample_threshold
        if not 0 <= tolerance < 1:
            raise ConfigError("datachunk_sample_tolerance must be at least 0 and below 1")
        object.__setattr__(self, "datachunk_sample_tolerance", tolerance)


@dataclass(frozen=True)
class ProcessedDatachunkParams:
    datachunk_params_id: int = 1
    qcone_config_id: int | None = None
    filtering_low: float = 0.1
    filtering_high: float = 3.0
    filtering_order: int = 4
    waterlevel_ratio_to_max: float = 0.001
    convolution_sliding_window_min_samples: int = 10
    convolution_sliding_window_max_ratio_to_fmin: float = 0.5
    convolution_sliding_window_ratio_to_bandwidth: float = 0.15
    quefrency_filter_lowpass_pct: float = 0.5
    quefrency_filter_taper_min_samples: int = 10
    quefrency_filter_taper_length_ratio_to_length_cepstrum: float = 0.01
    spectral_whitening: bool = True
    one_bit: bool = True
    quefrency: bool = False


@dataclass(frozen=True)
class CrosscorrelationCartesianParams:
    processed_datachunk_params_id: int = 1
    correlation_max_lag: float = 20.0
    sampling_rate: float = 24.0

    @property
    def lag_samples(self) -> int:
        return int(round(self.correlation_max_lag * self.sampling_rate))

    @property
    def lags(self) -> list[float]:
        """Lag times, by index, so that both ends are exact."""
        return [i / self.sampling_rate for i in range(-self.lag_samples, self.lag_samples + 1)]


@dataclass(frozen=True)
class CrosscorrelationCylindricalParams:
    crosscorrelation_cartesian_params_id: int = 1


@dataclass(frozen=True)
class RejectedTime:
    """A period of a component, or of a pair of components, that isn't accepted."""

    starttime: Moment
    endtime: Moment
    network: str | None = None
    station: str | None = None
    component: str | None = None
    network_a: str | None = None
    station_a: str | None = None
    component_a: str | None = None
    network_b: str | None = None
    station_b: str | None = None
    component_b: str | None = None

    def __post_init__(self):
        one = [self.network, self.station, self.component]
        two = [self.network_a, self.station_a, self.component_a, self.network_b, self.station_b, self.component_b]
        if (None in one or any(two)) and (None in two or any(one)):
            raise ConfigError("a rejected time names one component, or two")


class _Policy:
    """What the configurations of both quality controls share."""

    def _settle(self) -> None:
        object.__setattr__(self, "null_policy", self.null_treatment_policy or self.null_policy)
        one_of("null_policy", self.null_policy, ("fail", "pass"))
        object.__setattr__(self, "rejected_times", tuple(t if isinstance(t, RejectedTime) else _typed(RejectedTime, t) for t in self.rejected_times))

    @property
    def null_value(self) -> bool:
        return self.null_policy == "pass"


_STATISTICS = ("signal_energy", "signal_min_value", "signal_max_value", "signal_mean_value", "signal_variance", "signal_skewness", "signal_kurtosis")


@dataclass(frozen=True)
class QCOneConfig(_Policy):
    datachunk_params_id: int = 1
    null_treatment_policy: str | None = None
    null_policy: str = "pass"
    strict_gps: bool = False
    starttime: Moment = dt.date(2010, 1, 1)
    endtime: Moment = dt.date(2030, 1, 1)
    avg_gps_time_error_min: float | None = None
    avg_gps_time_error_max: float | None = None
    avg_gps_time_uncertainty_min: float | None = None
    avg_gps_time_uncertainty_max: float | None = None
    rejected_times: list | tuple = ()
    signal_energy_min: float | None = None
    signal_energy_max: float | None = None
    signal_min_value_min: float | None = None
    signal_min_value_max: float | None = None
    signal_max_value_min: float | None = None
    signal_max_value_max: float | None = None
    signal_mean_value_min: float | None = None
    signal_mean_value_max: float | None = None
    signal_variance_min: float | None = None
    signal_variance_max: float | None = None
    signal_skewness_min: float | None = None
    signal_skewness_max: float | None = None
    signal_kurtosis_min: float | None = None
    signal_kurtosis_max: float | None = None

    def __post_init__(self):
        self._settle()

    @property
    def bounds(self) -> dict[str, float | None]:
        """The statistics' bounds, by the names that the verdicts take."""
        short = lambda n: n.removeprefix("signal_").removesuffix("_value")
        return {f"{short(n)}_{side}": getattr(self, f"{n}_{side}") for n in _STATISTICS for side in ("min", "max")}

    @property
    def gps_bounds(self) -> dict[str, float | None]:
        return {f"{n}_{side}": getattr(self, f"avg_gps_time_{n}_{side}") for n in ("error", "uncertainty") for side in ("min", "max")}

    @property
    def uses_gps(self) -> bool:
        return any(v is not None for v in self.gps_bounds.values())

    @property
    def uses_stats(self) -> bool:
        return any(v is not None for v in self.bounds.values())


@dataclass(frozen=True)
class QCTwoConfig(_Policy):
    crosscorrelation_cartesian_params_id: int = 1
    null_treatment_policy: str | None = None
    null_policy: str = "pass"
    starttime: Moment = dt.date(2010, 1, 1)
    endtime: Moment = dt.date(2030, 1, 1)
    rejected_times: list | tuple = ()

    def __post_init__(self):
        self._settle()


@dataclass(frozen=True)
class StackingSchema:
    qctwo_config_id: int = 1
    minimum_ccf_count: int = 1
    starttime: Moment = dt.date(2010, 1, 1)
    endtime: Moment = dt.date(2030, 1, 1)
    stacking_length: float | str = 86_400.0
    stacking_step: float | str | None = None
    stacking_overlap: float | str | None = None

    def __post_init__(self):
        exactly_one(stacking_step=self.stacking_step, stacking_overlap=self.stacking_overlap)
        if self.length_s <= 0 or self.step_s <= 0:
            raise ConfigError("windows and steps take time, so an overlap is shorter than its window")

    @property
    def length_s(self) -> float:
        return seconds(self.stacking_length)

    @property
    def step_s(self) -> float:
        return seconds(self.stacking_step) if self.stacking_step is not None else self.length_s - seconds(self.stacking_overlap)

    @property
    def overlap_s(self) -> float:
        return self.length_s - self.step_s


@dataclass(frozen=True)
class PPSDParams:
    datachunk_params_id: int = 1
    segment_length: float = 600.0
    segment_step: float = 500.0
    freq_min: float = 0.1
    freq_max: float = 5.0
    taper_type: str | None = None
    taper_max_percentage: float | None = None
    resample: bool = False
    resampled_frequency_start: float | None = None
    resampled_frequency_stop: float | None = None
    resampled_frequency_step: float | None = None
    rejected_windows_quantile: float = 0.1
    save_all_windows: bool = False
    save_compressed: bool = True
    sampling_rate: float = 24.0

    def __post_init__(self):
        if self.resample and None in (self.resampled_frequency_start, self.resampled_frequency_stop, self.resampled_frequency_step):
            raise ConfigError("resampling needs resampled_frequency_start, _stop and _step")
        if not 0 <= self.freq_min < self.freq_max:
            raise ConfigError("freq_min must be below freq_max")
        if self.resampled_frequency_start is not None and self.resampled_frequency_start < self.freq_min:
            raise ConfigError("resampled_frequency_start is below freq_min")
        if self.resampled_frequency_stop is not None and self.resampled_frequency_stop > self.freq_max:
            raise ConfigError("resampled_frequency_stop is above freq_max")
        if self.taper_max_percentage is not None and self.taper_type is None:
            raise ConfigError("taper_max_percentage needs taper_type")
        if not 0 <= self.rejected_windows_quantile < 0.5:
            raise ConfigError("rejected_windows_quantile must be at least 0 and below 0.5")

    @property
    def segment_samples(self) -> int:
        return int(self.sampling_rate * self.segment_length)

    @property
    def step_samples(self) -> int:
        return int(self.sampling_rate * self.segment_step)

    @property
    def frequencies(self) -> list[float]:
        """Those of the segment's transform within the accepted band."""
        n = self.segment_samples
        return [k * self.sampling_rate / n for k in range((n - 1) // 2 + 1) if self.freq_min <= k * self.sampling_rate / n <= self.freq_max]

    @property
    def resampled_frequencies(self) -> list[float]:
        """From start, by step, below stop."""
        start, stop, step = self.resampled_frequency_start, self.resampled_frequency_stop, self.resampled_frequency_step
        return [start + k * step for k in range(max(0, math.ceil((stop - start) / step)))]


@dataclass(frozen=True)
class BeamformingParams:
    qcone_config_id: int | None = None
    min_freq: float = 0.5
    max_freq: float = 1.0
    slowness_x_min: float = -0.5
    slowness_x_max: float = 0.5
    slowness_y_min: float = -0.5
    slowness_y_max: float = 0.5
    slowness_step: float = 0.05
    slowness_x_step: float | None = None
    slowness_y_step: float | None = None
    window_length: float | None = None
    window_length_minimum_periods: float | None = None
    window_step: float | None = None
    window_step_fraction: float | None = None
    perform_statistical_reject: bool = False
    n_sigma_stat_reject: float = 2.5
    prop_bad_freqs_stat_reject: float = 0.5
    save_average_beamformer_abspower: bool = True
    save_all_beamformers_abspower: bool = False
    save_average_beamformer_relpower: bool = False
    save_all_beamformers_relpower: bool = False
    perform_deconvolution_all: bool = False
    perform_deconvolution_average: bool = True
    save_all_arf: bool = False
    save_average_arf: bool = True
    arf_enlarge_ratio: float = 2.0
    smin1: float | None = None
    smax1: float | None = None
    smin2: float | None = None
    smax2: float | None = None
    thetamin1: float | None = None
    thetamax1: float | None = None
    thetamin2: float | None = None
    thetamax2: float | None = None
    sparsity_max: int = 3
    sigma_angle_kernels: float = 10.0
    sigma_slowness_kernels_ratio_to_ds: float = 1.0
    rms_threshold_deconv: float = 0.01
    reg_coef_deconv: float = 1.0
    #: The older name of reg_coef_deconv, which files still have.
    alpha_reg: float | None = None
    rel_rms_thresh_admissible_slowness: float = 2.0
    rel_rms_stop_crit_increase_sparsity: float = 0.25
    extract_peaks_average_beamformer_abspower: bool = True
    extract_peaks_all_beamformers_abspower: bool = False
    extract_peaks_average_beamformer_relpower: bool = False
    extract_peaks_all_beamformers_relpower: bool = False
    neighborhood_size: float | None = None
    neighborhood_size_xaxis_fraction: float | None = None
    maxima_threshold: float = 0.0
    best_point_count: int = 10
    beam_portion_threshold: float = 0.1
    semblance_threshold: float = -1e9
    velocity_threshold: float = -1e9
    prewhiten: bool = False
    method: str = "beamforming"
    used_component_codes: list | tuple = ("Z",)
    minimum_trace_count: int = 3

    def __post_init__(self):
        exactly_one(window_length=self.window_length, window_length_minimum_periods=self.window_length_minimum_periods)
        exactly_one(window_step=self.window_step, window_step_fraction=self.window_step_fraction)
        if self.neighborhood_size is not None and self.neighborhood_size_xaxis_fraction is not None:
            raise ConfigError("give only one of neighborhood_size and neighborhood_size_xaxis_fraction")
        one_of("method", self.method, ("beamforming", "bartlett", "capon"))
        for axis in "xy":
            low, high = getattr(self, f"slowness_{axis}_min"), getattr(self, f"slowness_{axis}_max")
            if low >= high:
                raise ConfigError(f"slowness_{axis}_min must be below slowness_{axis}_max")
        if self.minimum_trace_count < 1:
            raise ConfigError("minimum_trace_count must be at least 1")
        if self.alpha_reg is not None:
            object.__setattr__(self, "reg_coef_deconv", self.alpha_reg)

    @property
    def central_freq(self) -> float:
        return (self.min_freq + self.max_freq) / 2

    def axis(self, name: str) -> list[float]:
        """Slowness nodes, the upper end included; by index, so rounding adds none."""
        low, high, step = (getattr(self, f"slowness_{name}_{k}") for k in ("min", "max", "step"))
        step = self.slowness_step if step is None else step
        return [low + step * i for i in range(int(round((high - low) / step)) + 1)]

    @property
    def window_s(self) -> float:
        return self.window_length if self.window_length is not None else self.window_length_minimum_periods / self.min_freq

    @property
    def step_s(self) -> float:
        return self.window_step if self.window_step is not None else self.window_s * self.window_step_fraction

    @property
    def neighborhood(self) -> float:
        """Nodes around a maximum; by default one on either side."""
        if self.neighborhood_size_xaxis_fraction is not None:
            return len(self.axis("x")) * self.neighborhood_size_xaxis_fraction
        return 3.0 if self.neighborhood_size is None else self.neighborhood_size

    @property
    def uses_absolute_power(self) -> bool:
        return any(getattr(self, f"{do}_{which}_abspower") for do in ("save", "extract_peaks") for which in ("average_beamformer", "all_beamformers"))

    @property
    def uses_relative_power(self) -> bool:
        return any(getattr(self, f"{do}_{which}_relpower") for do in ("save", "extract_peaks") for which in ("average_beamformer", "all_beamformers"))

    @property
    def max_slowness(self) -> float:
        """The largest slowness on the grid, to three digits."""
        x, y = (max(abs(getattr(self, f"slowness_{a}_min")), abs(getattr(self, f"slowness_{a}_max"))) for a in "xy")
        return round(math.hypot(x, y), 3)


#: Older names of the detection's values.
_DETECTION = {"n_short": "n_short_time_average", "n_long": "n_long_time_average", "trigger_on": "trigger_value", "trigger_off": "detrigger_value"}


@dataclass(frozen=True)
class EventDetectionParams:
    datachunk_params_id: int = 1
    detection_type: str = "sta_lta"
    minimum_frequency: float | None = None
    maximum_frequency: float | None = None
    output_margin_length_sec: float = 0.0
    trace_trimming_sec: float | None = None
    n_short_time_average: int | None = None
    n_long_time_average: int | None = None
    trigger_value: float | None = None
    detrigger_value: float | None = None
    peak_ground_velocity_threshold: float | None = None

    def __post_init__(self):
        needed = {"sta_lta": tuple(_DETECTION.values()), "amplitude_spike": ("peak_ground_velocity_threshold",)}
        one_of("detection_type", self.detection_type, tuple(needed))
        if missing := [k for k in needed[self.detection_type] if getattr(self, k) is None]:
            raise ConfigError(f"{self.detection_type} needs {', '.join(missing)}")


@dataclass(frozen=True)
class EventConfirmationParams:
    datachunk_params_id: int = 1
    event_detection_params_id: int = 1
    time_lag: float = 10.0
    sampling_step: float = 1.0
    vote_threshold: float = 2.0
    vote_weight: list | tuple | None = None

    @property
    def weights(self) -> dict[str, float]:
        """Votes by station, from entries like "STA:2"; other stations have one."""
        return {s: float(n) for entry in self.vote_weight or () for s, n in split_stations(entry).items()}


SECTIONS = {c.__name__: c for c in (
    DatachunkParams, ProcessedDatachunkParams, CrosscorrelationCartesianParams, CrosscorrelationCylindricalParams, QCOneConfig,
    QCTwoConfig, StackingSchema, PPSDParams, BeamformingParams, EventDetectionParams, EventConfirmationParams,
)} | {"QCOne": QCOneConfig, "QCTwo": QCTwoConfig}

#: By section, the field that names a parent and the parent's section.
PARENTS: dict[type, dict[str, type]] = {
    ProcessedDatachunkParams: {"datachunk_params_id": DatachunkParams, "qcone_config_id": QCOneConfig},
    CrosscorrelationCartesianParams: {"processed_datachunk_params_id": ProcessedDatachunkParams},
    CrosscorrelationCylindricalParams: {"crosscorrelation_cartesian_params_id": CrosscorrelationCartesianParams},
    QCOneConfig: {"datachunk_params_id": DatachunkParams},
    QCTwoConfig: {"crosscorrelation_cartesian_params_id": CrosscorrelationCartesianParams},
    StackingSchema: {"qctwo_config_id": QCTwoConfig},
    PPSDParams: {"datachunk_params_id": DatachunkParams},
    BeamformingParams: {"qcone_config_id": QCOneConfig},
    EventDetectionParams: {"datachunk_params_id": DatachunkParams},
    EventConfirmationParams: {"datachunk_params_id": DatachunkParams, "event_detection_params_id": EventDetectionParams},
}


def _coerced(kind, value):
    """Strings that stand for booleans and numbers become them."""
    options = [k for k in typing.get_args(kind) if k is not type(None)] or [kind]
    if bool in options and isinstance(value, str):
        if value.lower() not in ("true", "false"):
            raise ConfigError(f"{value!r} is no boolean")
        return value.lower() == "true"
    if isinstance(value, str) and str not in options and (float in options or int in options):
        return (float if float in options else int)(value)
    return float(value) if float in options and isinstance(value, int) and not isinstance(value, bool) else value


def _typed(kind: type, values: dict):
    types = typing.get_type_hints(kind)
    if unknown := sorted(set(values) - set(types)):
        raise ConfigError(f"{kind.__name__} has no {', '.join(unknown)}")
    try:
        return kind(**{k: _coerced(types[k], v) for k, v in values.items()})
    except TypeError as e:
        raise ConfigError(str(e)) from e


def parse(text: str, section: str | None = None):
    """The typed section of a TOML text. A file of one section names it, and ``section``, if
    given, must be the same; a file without sections holds the values of the given one."""
    if section is not None and section not in SECTIONS:
        raise ConfigError(f"no section {section}; known are {sorted(SECTIONS)}")
    found = tomllib.loads(text)
    name = next(iter(found)) if len(found) == 1 else None
    if name is None or (section is not None and not isinstance(found[name], dict)):
        if section is None:
            raise ConfigError(f"name one of the sections {sorted(SECTIONS)}")
        return _typed(SECTIONS[section], found)
    if name not in SECTIONS or (section is not None and SECTIONS[section] is not SECTIONS[name]):
        raise ConfigError(f"expected the section {section or sorted(SECTIONS)}, found {name}")
    return _typed(SECTIONS[name], found[name])


def load(path: str | Path, section: str | None = None):
    return parse(Path(path).read_text(), section)


def stored(params, tables: dict[type, DataFrame]) -> DataFrame:
    """The table of ``params``' kind with a row more, under the next id. ``tables`` has one
    for each kind, with ``id`` and the kind's fields; a parent that is named must be there."""
    from stillwave.operators import chunks

    kind = type(params)
    for name, parent in PARENTS.get(kind, {}).items():
        wanted = getattr(params, name)
        if wanted is not None and (parent not in tables or tables[parent].filter(F.col("id") == wanted).isEmpty()):
            raise ConfigError(f"{kind.__name__}: no {parent.__name__} with the id {wanted}")
    old = tables[kind]
    values = {f.name: getattr(params, f.name) for f in dataclasses.fields(kind)}
    row = chunks.next_id(old, "id").withColumnsRenamed({"next_id": "id"})
    return old.unionByName(row.select("id", *(F.lit(_plain(values[c])).cast(t).alias(c) for c, t in old.dtypes if c != "id")))


def _plain(value):
    """Lists as text, as the tables keep them."""
    return ";".join(map(str, value)) if isinstance(value, list | tuple) else value


def fetch(table: DataFrame, id: int) -> DataFrame:
    """The one row with an id; none is an error."""
    found = table.filter(F.col("id") == id)
    if found.isEmpty():
        raise LookupError(f"no row with the id {id}")
    return found


def rejected_components(params: QCOneConfig, components: DataFrame) -> DataFrame:
    """``component_id``, ``starttime``, ``endtime`` of the rejected times; one whose component
    isn't known, or known twice, is an error."""
    return _resolved(params.rejected_times, components, [("network", "station", "component")], ["component_id"])


def rejected_pairs(params: QCTwoConfig, pairs: DataFrame) -> DataFrame:
    """The same of pairs, by the ids of both sides. A pair that is stored the other way round
    is told apart in the error."""
    sides = [(f"network_{s}", f"station_{s}", f"component_{s}") for s in "ab"]
    try:
        return _resolved(params.rejected_times, pairs, sides, ["component_id_a", "component_id_b"])
    except LookupError as e:
        turned = pairs.select(*(F.col(c).alias(f"{c[:-1]}{'b' if c[-1] == 'a' else 'a'}") for s in sides for c in s))
        names = [c for s in sides for c in s]
        wanted = [tuple(getattr(t, c) for c in names) for t in params.rejected_times]
        known = {tuple(r) for r in turned.join(_listed(pairs, wanted, names), names, "left_semi").select(*names).collect()}
        if known:
            raise LookupError(f"{e}; the other way round there is {sorted(known)}") from e
        raise


def _listed(like: DataFrame, rows: list[tuple], names: list[str]) -> DataFrame:
    return like.sparkSession.createDataFrame(rows, ", ".join(f"{n} string" for n in names))


def _resolved(times: tuple[RejectedTime, ...], table: DataFrame, sides: list[tuple[str, ...]], ids: list[str]) -> DataFrame:
    names = [c for s in sides for c in s]
    spark = table.sparkSession
    schema = ", ".join(["n int", *(f"{c} string" for c in names), "starttime timestamp_ntz", "endtime timestamp_ntz"])
    wanted = spark.createDataFrame([(n, *(getattr(t, c) for c in names), moment(t.starttime), moment(t.endtime)) for n, t in enumerate(times)], schema)
    found = wanted.join(table.select(*names, *ids), names, "left")
    # As many rows as the configuration lists.
    if wrong := found.groupBy("n", *names).agg(F.count(ids[0]).alias("c")).filter("c <> 1").orderBy("n").collect():
        raise LookupError(f"rejected times of components that aren't known exactly once: {[tuple(r[c] for c in names) for r in wrong]}")
    return found.select(*ids, "starttime", "endtime")


def over_windows(params: BeamformingParams, freq_min: float, freq_max: float, step: float, width: float) -> list[BeamformingParams]:
    """One configuration for each frequency window, corners rounded to nine digits."""
    count = int(round((freq_max - freq_min - width) / step)) + 1
    return [dataclasses.replace(params, min_freq=round(freq_min + i * step, 9), max_freq=round(freq_min + i * step + width, 9)) for i in range(max(0, count))]


def merge_intervals(a: tuple[float, float], b: tuple[float, float]) -> tuple[float, float]:
    """What two intervals of slowness share."""
    out = (max(a[0], b[0]), min(a[1], b[1]))
    if out[0] >= out[1]:
        raise ConfigError(f"{a} and {b} share nothing")
    return out


def merge_angles(a: tuple[float, float], b: tuple[float, float]) -> tuple[float, float]:
    """The same of angles, after the remainder by 360."""
    return merge_intervals(*(tuple(v % 360 if v != 360 else 360.0 for v in x) for x in (a, b)))


def split_stations(text: str) -> dict[str, int]:
    """Station and parameter numbers from "STA:1 STB-2"."""
    parts = [p for p in re.split(r"[-:\s]+", text) if p]
    if len(parts) % 2:
        raise ConfigError(f"{text!r} isn't pairs of a station and a number")
    return {s: int(n) for s, n in zip(parts[::2], parts[1::2], strict=True)}
