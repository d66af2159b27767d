"""Signal kernels over DataFrames: thin Arrow wrappers, and what Spark can express itself."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stillwave.config import BeamformingParams, EventDetectionParams, PPSDParams
from stillwave.functions import deconvolution, dsp, ordered


def _stage(name: str, rate: float, o: dict):
    """The function of traces side by side that a stage's name and options stand for; with
    ``ordered`` that of short traces, whose sums are added in order."""
    kernels = ordered if o.get("ordered") else dsp
    if name == "detrend":
        return lambda x: kernels.detrend(x, o["order"])
    if name == "resample":
        return lambda x: dsp.resample(x, rate, o["new_rate"])
    if name == "bandpass":
        return lambda x: kernels.bandpass(x, o["low"], o["high"], rate, o.get("order", 4), o.get("zero_phase", False))
    if name == "whiten":
        return lambda x: kernels.whiten(x, o["water"], o.get("quefrency"), rate)
    if name == "response":
        return lambda x: dsp.remove_response(x, rate, *o["response"])
    if name == "power_spectrum":
        return lambda x: dsp.power_spectrum(x, rate)
    if name == "process":  # whiten, filter, one-bit
        return lambda x: np.sign(dsp.bandpass(dsp.whiten(x, o["water"], o.get("quefrency"), rate), o["low"], o["high"], rate))
    if name in ("whitened", "processed"):  # as parameters of processing switch and tune it
        p = o["params"]
        smooth = {
            "min_samples": p.convolution_sliding_window_min_samples, "ratio_to_bandwidth": p.convolution_sliding_window_ratio_to_bandwidth, "max_ratio_to_low": p.convolution_sliding_window_max_ratio_to_fmin,
            "lowpass": p.quefrency_filter_lowpass_pct, "taper_samples": p.quefrency_filter_taper_min_samples, "taper_ratio": p.quefrency_filter_taper_length_ratio_to_length_cepstrum,
        }

        def white(x: np.ndarray) -> np.ndarray:
            return kernels.whitened(x, rate, p.filtering_low, p.filtering_high, p.waterlevel_ratio_to_max, smooth if p.quefrency else None)

        def by_params(x: np.ndarray) -> np.ndarray:
            if p.spectral_whitening:
                x = white(x)
            x = dsp.bandpass(x, p.filtering_low, p.filtering_high, rate, p.filtering_order)
            return np.sign(x) if p.one_bit else x

        return white if name == "whitened" else by_params
    if name == "prepared":  # detrend, demean, resample, trim, taper and filter by parameters of chunks
        c = o["params"]

        def ready(x: np.ndarray) -> np.ndarray:
            x = dsp.detrend(x)
            x = dsp.resample(x - x.mean(-1, keepdims=True), rate, c.sampling_rate)[..., : o["samples"]]
            n = x.shape[-1]
            width = min(int(c.preprocessing_taper_max_percentage * n), int(c.preprocessing_taper_max_length * c.sampling_rate), n // 2)
            x = x * dsp.taper_ends(n, width, c.preprocessing_taper_type, c.preprocessing_taper_side)
            return dsp.bandpass(x, c.prefiltering_low, c.prefiltering_high, c.sampling_rate, c.prefiltering_order)

        return ready
    if name == "preprocess":  # detrend, demean, resample, taper, filter, response, and filter without delay
        new = o["new_rate"]

        def whole(x: np.ndarray) -> np.ndarray:
            x = kernels.detrend(x)
            x = dsp.taper(kernels.resample(x - kernels.mean(x), rate, new))
            x = kernels.bandpass(x, o["low"], o["high"], new)
            if o.get("response"):
                x = dsp.remove_response(x, new, *o["response"])
            return kernels.bandpass(x * o.get("coefficient", 1.0), o["low"], o["high"], new, zero_phase=True)

        return whole
    raise ValueError(f"no stage {name}")


#: Samples that a stage works on at once.
SAMPLES = 4_000_000


def _side_by_side(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and matrices of the traces that aren't null, by length, in bounded parts."""
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    for n in np.unique(lengths[lengths >= 0]).tolist():
        places = np.flatnonzero(lengths == n)
        few = max(1, SAMPLES // max(1, n))
        for k in range(0, len(places), few):
            at = places[k : k + few]
            yield at, column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(at), n)


def _tried(run, x: np.ndarray) -> Iterator[tuple[np.ndarray | None, str | None]]:
    """Each trace's result, or why there is none. All run side by side; only if that fails is
    each tried by itself."""
    try:
        found = list(run(x))
    except Exception:
        found = []
        for trace in x:
            try:
                found.append(run(trace[None])[0])
            except Exception as e:
                found.append(f"{type(e).__name__}: {e}")
    for y in found:
        if isinstance(y, str):
            yield None, y
        elif not np.isfinite(y).all():
            yield None, "a result that isn't finite"
        else:
            yield y, None


def per_trace(df: DataFrame, stage: str, rate: float, id: str = "vec_id", array: str = "x", problems: bool = False, **options) -> DataFrame:
    """``id`` and ``y``, the stage's result for each trace; a null trace stays null, an empty one
    empty. One narrow pass: nothing is shuffled, and traces of one length run side by side.
    With ``ordered`` short traces' sums are added in order (:mod:`ordered`), else the fast way.
    With ``problems`` a trace that the stage fails on, or whose result isn't finite, has a null
    and its ``problem``, and others aren't affected; else it is an error."""
    run = _stage(stage, rate, options)

    def batches(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in given:
            out: list = [None] * batch.num_rows
            why: list = [None] * batch.num_rows
            for at, x in _side_by_side(batch.column(1)):
                found = _tried(run, x) if problems and x.shape[1] else zip(run(x) if x.shape[1] else x, [None] * len(x), strict=True)
                for i, (y, problem) in zip(at, found, strict=True):
                    out[i], why[i] = y, problem
            columns = [batch.column(0), pa.array(out, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(why, pa.string())] if problems else columns, [id, "y", "problem"] if problems else [id, "y"])

    kind = df.schema[id].dataType.simpleString()
    return df.select(id, F.col(array).cast("array<double>").alias(array)).mapInArrow(batches, f"{id} {kind}, y array<double>" + ", problem string" * problems)


def correlations(df: DataFrame, keys: list[str], a: str, b: str, max_lag: int, normalise: bool = True, demean: bool = True) -> DataFrame:
    """``keys`` and ``y``, the correlation of both arrays at lags from -max_lag to max_lag, by
    Fourier transform. Null where either is null or empty or their lengths differ. Narrow."""

    def batches(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in given:
            first, second = batch.column(len(keys)), batch.column(len(keys) + 1)
            other = pc.fill_null(pc.list_value_length(second), -1).to_numpy(zero_copy_only=False)
            out: list = [None] * batch.num_rows
            for at, x in _side_by_side(first):
                same = other[at] == x.shape[1]
                at, x = at[same], x[same]
                if x.size:
                    y = second.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(x.shape)
                    for i, c in zip(at, dsp.correlate(x, y, max_lag, normalise, demean), strict=True):
                        out[i] = c
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(out, pa.list_(pa.float64()))], [*keys, "y"])

    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.select(*keys, F.col(a).cast("array<double>").alias("_a"), F.col(b).cast("array<double>").alias("_b")).mapInArrow(batches, f"{kinds}, y array<double>")


#: Components in a block, on average, and pairs that are correlated at once.
BLOCK, PAIRS = 32, 32


def block_correlations(chunks: DataFrame, todo: DataFrame, max_lag: int, normalise: bool = True, demean: bool = True, block: int = BLOCK) -> DataFrame:
    """(``component_id_a``, ``component_id_b``, ``timespan_id``, ``ccf``) for the pairs of ``todo``
    (the same keys) from ``chunks`` (``component_id``, ``timespan_id``, ``samples``).

    Components are dealt to blocks, and a window's pairs to the pairs of their blocks. There a
    chunk is transformed once for all its pairs, so what is shuffled are a chunk's samples
    once for each block that it meets, not for each pair; a task holds two blocks. Pairs of which
    a chunk is missing, null, empty or of another length than its partner have no row. Of
    chunks that repeat a key the one of the largest samples counts. Rows of ``todo`` that
    repeat each other give a row each.
    """
    key = ["component_id_a", "component_id_b", "timespan_id"]
    known = todo.select(F.col("component_id_a").alias("c")).unionByName(todo.select(F.col("component_id_b").alias("c"))).distinct().count()
    number = lambda c: F.pmod(F.xxhash64(c), F.lit(max(1, -(-known // block))))
    a, b = number("component_id_a"), number("component_id_b")
    work = todo.select(*key, F.least(a, b).alias("_i"), F.greatest(a, b).alias("_j"))
    side = lambda s: work.select(F.col(f"component_id_{s}").alias("component_id"), "timespan_id", F.struct("_i", "_j").alias("_to"))
    needed = side("a").unionByName(side("b")).groupBy("component_id", "timespan_id").agg(F.collect_set("_to").alias("_to"))
    held = chunks.select("component_id", "timespan_id", F.col("samples").cast("array<double>").alias("samples")).filter("size(samples) > 0")
    copies = held.join(needed, ["component_id", "timespan_id"]).select("component_id", "timespan_id", "samples", F.explode("_to").alias("_to"))
    copies = copies.select("component_id", "timespan_id", "samples", "_to.*")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found: dict = {}
        for component, samples in zip(left["component_id"].to_pylist(), left["samples"], strict=True):
            x = samples.values.to_numpy(zero_copy_only=False).astype(float)
            if component not in found or x.tolist() > found[component].tolist():
                found[component] = x
        place, groups = {}, {}
        for component, x in found.items():
            place[component] = (len(x), len(groups.setdefault(len(x), [])))
            groups[len(x)].append(x)
        spectra = {n: dsp.transformed(np.array(x), max_lag, demean) for n, x in groups.items()}
        rows: dict[int, list[tuple[int, int, int]]] = {}
        for row, (c, d) in enumerate(zip(right["component_id_a"].to_pylist(), right["component_id_b"].to_pylist(), strict=True)):
            if c in place and d in place and place[c][0] == place[d][0]:
                rows.setdefault(place[c][0], []).append((row, place[c][1], place[d][1]))
        at, out = [], []
        for n, some in rows.items():
            x, energy = spectra[n]
            for s in range(0, len(some), PAIRS):
                row, p, q = np.array(some[s : s + PAIRS]).T
                at += row.tolist()
                out += list(dsp.correlate_transformed((x[p], energy[p]), (x[q], energy[q]), max_lag, normalise))
        kept = right.select(["component_id_a", "component_id_b", "_w"]).take(pa.array(at, pa.int64()))
        return pa.table([*kept.columns, pa.array(out, pa.list_(pa.float64()))], [*key, "ccf"])

    kinds = ", ".join(f"{k} {todo.schema[k].dataType.simpleString()}" for k in key)
    wanted = work.select(*key[:2], *(F.col(c).alias(n) for c, n in (("timespan_id", "_w"), ("_i", "_p"), ("_j", "_q"))))
    return copies.groupBy("timespan_id", "_i", "_j").cogroup(wanted.groupBy("_w", "_p", "_q")).applyInArrow(run, f"{kinds}, ccf array<double>")


def spectra(df: DataFrame, params: PPSDParams, id: str = "vec_id", array: str = "x") -> DataFrame:
    """``id``, ``mean`` and ``std`` of the densities of a trace's segments, without those of too
    little or too much energy, and ``segments``, how many there were; null for a trace
    shorter than one."""
    at = np.array(params.resampled_frequencies) if params.resample else None
    tapered = None if params.taper_type is None else (params.taper_max_percentage or 0.05)

    def batches(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in given:
            out: list[list] = [[], [], []]
            for v in batch.column(1):
                values = (None, None, 0)
                if v.is_valid:
                    x = v.values.to_numpy(zero_copy_only=False).astype(float)
                    found = dsp.segment_spectra(x, params.sampling_rate, params.segment_samples, params.step_samples, params.freq_min, params.freq_max, at, tapered)
                    values = (*dsp.mean_spectrum(found, params.rejected_windows_quantile), len(found)) if len(found) else values
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            kinds = (pa.list_(pa.float64()), pa.list_(pa.float64()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(out, kinds, strict=True))], [id, "mean", "std", "segments"])

    kind = df.schema[id].dataType.simpleString()
    return df.select(id, F.col(array).cast("array<double>")).mapInArrow(batches, f"{id} {kind}, mean array<double>, std array<double>, segments long")


def array_response(stations: DataFrame, axis: list[float], freqs: list[float]) -> DataFrame:
    """Array response on a slowness grid: the trapezoid over frequencies of the squared sum
    of the stations' phases, over its maximum. Grid and frequencies are literals; the sums
    over stations are partial aggregates."""
    spark = stations.sparkSession
    weights = [0.0] * len(freqs)
    for k in range(len(freqs) - 1):
        weights[k] += (freqs[k + 1] - freqs[k]) / 2
        weights[k + 1] += (freqs[k + 1] - freqs[k]) / 2
    nodes = spark.createDataFrame([(x, y, f, w) for x in axis for y in axis for f, w in zip(freqs, weights, strict=True)], "sx double, sy double, freq double, w double")
    phase = 2 * 3.141592653589793 * F.col("freq") * (F.col("px") * F.col("sx") + F.col("py") * F.col("sy"))
    each = stations.crossJoin(F.broadcast(nodes)).groupBy("sx", "sy", "freq", "w").agg(F.sum(F.cos(phase)).alias("c"), F.sum(F.sin(phase)).alias("s"))
    power = each.groupBy("sx", "sy").agg(F.sum(F.col("w") * (F.col("c") * F.col("c") + F.col("s") * F.col("s"))).alias("power"))
    largest = power.agg(F.max("power").alias("largest"))
    return power.crossJoin(F.broadcast(largest)).select("sx", "sy", (F.col("power") / F.col("largest")).alias("response"))  # one row


def _alike(table: pa.Table) -> list[tuple]:
    """Rows (``vec_id``, ``x``, ``px``, ``py``) of one window by id: of its traces the whole ones (not
    null, no component null or NaN) of the commonest length, the longer of two as common."""
    rows = [r for r in zip(*(table[c].to_pylist() for c in ("vec_id", "x", "px", "py")), strict=True) if r[1] and None not in r]
    rows = [r for r in rows if None not in r[1] and np.isfinite(r[1]).all()]
    lengths = Counter(len(r[1]) for r in rows)
    common = max(lengths, key=lambda n: (lengths[n], n), default=0)
    return sorted(r for r in rows if len(r[1]) == common)


def kept_stations(traces: DataFrame, window: str) -> DataFrame:
    """(``vec_id``, ``kept``): the traces ``x`` of each window, and which of them its sigma clipping
    keeps. One that is null, empty or odd in length, or holds a null or NaN, isn't kept and
    has no part in the others' levels."""

    def run(group: pa.Table) -> pa.Table:
        zeros = pa.array(np.zeros(group.num_rows))
        good = _alike(group.append_column("px", zeros).append_column("py", zeros))
        kept = dsp.statistical_reject(np.fft.rfft(np.array([r[1] for r in good], float))[:, 1:]) if good else []
        ids = {r[0] for r, k in zip(good, kept, strict=True) if k}
        return pa.table([group["vec_id"], pa.array([i in ids for i in group["vec_id"].to_pylist()])], ["vec_id", "kept"])

    return traces.select("vec_id", "x", window).groupBy(window).applyInArrow(run, f"vec_id {traces.schema['vec_id'].dataType.simpleString()}, kept boolean")


def beams(traces: DataFrame, rate: float, low: float, high: float, axis: list[float], method: str, peaks: int, least: int = 3) -> DataFrame:
    """Peaks of the beam power of each window: ``timespan_id``, ``rank``, ``sx``, ``sy``,
    ``slowness``, ``azimuth``, ``power``.

    ``traces`` has ``timespan_id``, ``vec_id``, ``x``, ``px``, ``py``: one row for each
    station of a window, so a group is as large as the array. Traces that are null, hold a
    null or NaN, or are not as long as most of their window, are left out, as are stations
    that the spectra reject, and windows of fewer than ``least`` traces.
    """
    nodes = np.array(axis)

    def run(table: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in ("timespan_id", "rank", "sx", "sy", "slowness", "azimuth", "power")}
        rows = _alike(table)
        if len(rows) >= least:
            spectra = np.fft.rfft(np.array([r[1] for r in rows], float))
            freqs = np.fft.rfftfreq(len(rows[0][1]), 1 / rate)
            band = (freqs >= low) & (freqs <= high)
            kept = dsp.statistical_reject(spectra[:, band])
            places = np.array([r[2:] for r in rows])[kept]
            power = dsp.beam_power(spectra[kept][:, band], freqs[band], places, nodes, method)
            for k, (i, j) in enumerate(dsp.local_maxima(power, peaks)):
                sx, sy = float(nodes[i]), float(nodes[j])
                values = (table["timespan_id"][0].as_py(), k + 1, sx, sy, float(np.hypot(sx, sy)), float(np.degrees(np.arctan2(sx, sy))), float(power[i, j]))
                for column, value in zip(out.values(), values, strict=True):
                    column.append(value)
        kinds = [pa.int64(), pa.int32()] + [pa.float64()] * 5
        return pa.table([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))

    schema = "timespan_id long, rank int, sx double, sy double, slowness double, azimuth double, power double"
    return traces.select("timespan_id", "vec_id", "x", "px", "py").groupBy("timespan_id").applyInArrow(run, schema)


def beam_peaks(traces: DataFrame, params: BeamformingParams, rate: float, source: bool = False) -> DataFrame:
    """Peaks of the beams of each window of analysis: ``timespan_id``, ``kind`` (average or all
    windows of beam power, absolute or relative), ``rank``, ``sx``, ``sy``, ``slowness``,
    ``azimuth``, ``backazimuth``, ``amplitude``, ``occurrences`` and ``proportion``.

    ``traces`` has ``timespan_id``, ``vec_id``, ``x``, ``px``, ``py``: one row for each station,
    so a group is as large as the array. Within it the beam runs over whole windows of the
    parameters' length and step. Traces that are null, hold a null or NaN, or are not as long
    as most of their window, are left out, and windows with fewer than the parameters ask for. With ``source`` nodes are places, not slownesses.
    """
    x, y = (np.array(params.axis(a)) for a in "xy")
    length, step = int(round(params.window_s * rate)), max(1, int(round(params.step_s * rate)))
    kinds = [f"{which}_{power}power" for power in ("abs", "rel") for which in ("average", "all")]
    wanted = [k for k in kinds if getattr(params, "extract_peaks_" + k.replace("average_", "average_beamformer_").replace("all_", "all_beamformers_"))]

    def run(table: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in range(11)]
        rows = _alike(table)
        if len(rows) >= params.minimum_trace_count and len(rows[0][1]) >= length:
            data, places = np.array([r[1] for r in rows], float), np.array([r[2:] for r in rows], float)
            freqs = np.fft.rfftfreq(length, 1 / rate)
            band = (freqs >= params.min_freq) & (freqs <= params.max_freq)
            maps: dict[str, list[np.ndarray]] = {"abs": [], "rel": []}
            for s in range(0, data.shape[1] - length + 1, step):
                spectra = np.fft.rfft(data[:, s : s + length])[:, band]
                kept = dsp.statistical_reject(spectra, params.n_sigma_stat_reject) if params.perform_statistical_reject else np.ones(len(spectra), bool)
                delays = dsp.source_delays(places[kept], x, y) if source else dsp.plane_delays(places[kept], x, y)
                for name, m in zip(("abs", "rel"), dsp.beam_maps(spectra[kept], freqs[band], delays, params.method), strict=True):
                    maps[name].append(m.reshape(len(x), len(y)))
            for kind in wanted:
                held = maps[kind.split("_")[1][:3]]
                held = [np.mean(held, axis=0)] if kind.startswith("average") else held
                tops = [[(i, j, float(m[i, j])) for i, j in dsp.peaks(m, params.neighborhood, params.maxima_threshold, params.best_point_count)] for m in held]
                for rank, (i, j, amplitude, n, share) in enumerate(dsp.significant(tops, params.beam_portion_threshold), 1):
                    azimuth = float(np.degrees(np.arctan2(x[i], y[j])))
                    values = (table["timespan_id"][0].as_py(), kind, rank, float(x[i]), float(y[j]), float(np.hypot(x[i], y[j])), azimuth, azimuth % -360 + 180, amplitude, n, share)
                    for column, value in zip(out, values, strict=True):
                        column.append(value)
        types = [pa.int64(), pa.string(), pa.int32(), *[pa.float64()] * 6, pa.int32(), pa.float64()]
        names = ["timespan_id", "kind", "rank", "sx", "sy", "slowness", "azimuth", "backazimuth", "amplitude", "occurrences", "proportion"]
        return pa.table([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)

    schema = "timespan_id long, kind string, rank int, sx double, sy double, slowness double, azimuth double, backazimuth double, amplitude double, occurrences int, proportion double"
    return traces.select("timespan_id", "vec_id", "x", "px", "py").groupBy("timespan_id").applyInArrow(run, schema)


def deconvolutions(maps: DataFrame, params: BeamformingParams, response: np.ndarray, keys: list[str], array: str = "power") -> DataFrame:
    """``keys``, ``radii`` (slownesses, in the order in which they were chosen), ``weights`` (the sum
    of each one's elements'), ``rms`` (of what is left over that of the map) and ``sources`` (the
    map without the array's response), for maps (row y, column x, flat) on the parameters' axes.

    ``response`` is the array's on a grid of the same step. The dictionary is made once in each
    worker. A null map, one of another size, and one that holds a null or NaN have nulls, one
    without structure has no radii. Narrow.
    """
    x, y = (np.array(params.axis(a)) for a in "xy")
    step = params.sigma_slowness_kernels_ratio_to_ds * params.slowness_step
    ranges = [(params.smin1, params.smax1), (params.smin2, params.smax2)]
    ranges = [r for r in ranges if r[0] is not None] or [(0.0, min(params.slowness_x_max, params.slowness_y_max))]
    angles = [(params.thetamin1, params.thetamax1), (params.thetamin2, params.thetamax2)]
    angles = [a for a in angles if a[0] is not None] or [(0.0, 360.0)]
    if len(angles) == 1:
        angles *= len(ranges)
    bounds = [deconvolution.Bounds(*r, *a) for r, a in zip(ranges, angles, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary = deconvolution.Dictionary(x, y, response, bounds, step, params.sigma_angle_kernels)
        for batch in batches:
            out: list[list] = [[None] * batch.num_rows for _ in range(4)]
            for at, values in _side_by_side(batch.column(len(keys))):
                if values.shape[1] != len(x) * len(y):
                    continue
                good = np.isfinite(values).all(1)
                found = deconvolution.deconvolved_maps(
                    values[good].reshape(-1, len(y), len(x)), dictionary, params.sparsity_max, params.rms_threshold_deconv, params.reg_coef_deconv,
                    params.rel_rms_thresh_admissible_slowness, params.rel_rms_stop_crit_increase_sparsity,
                )
                for i, f in zip(at[good], found, strict=True):
                    for column, v in zip(out, (f.radii, [float(w.sum()) for w in f.weights], f.rms, f.sources.ravel()), strict=True):
                        column[i] = v
            kinds = (pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *(pa.array(c, t) for c, t in zip(out, kinds, strict=True))], [*keys, "radii", "weights", "rms", "sources"])

    kinds = ", ".join(f"{k} {maps.schema[k].dataType.simpleString()}" for k in keys)
    return maps.select(*keys, F.col(array).cast("array<double>")).mapInArrow(run, f"{kinds}, radii array<double>, weights array<double>, rms double, sources array<double>")


def detections(df: DataFrame, params: EventDetectionParams, rate: float, keys: list[str], array: str = "x") -> DataFrame:
    """Events of each trace: ``keys``, ``first`` and ``last`` sample (with the margin, within the
    trimmed trace), ``pgv`` (largest size there) and ``ratio`` (the largest STA/LTA; null for
    spikes). The trace is trimmed and filtered first. Averages are as long as so many periods
    of the lowest frequency; spikes are samples of at least the threshold, joined over the
    margin. Narrow: none or several rows for each trace."""
    margin, trim = int(round(params.output_margin_length_sec * rate)), int(round((params.trace_trimming_sec or 0) * rate))

    def events(x: np.ndarray) -> list[tuple[int, int, float, float | None]]:
        x = x[trim : len(x) - trim]
        if not len(x):
            return []
        if params.minimum_frequency is not None and params.maximum_frequency is not None:
            x = dsp.bandpass(x, params.minimum_frequency, params.maximum_frequency, rate)
        if params.detection_type == "sta_lta":
            short, long = (max(1, int(n / (params.minimum_frequency or 1.0) * rate)) for n in (params.n_short_time_average, params.n_long_time_average))
            ratio = dsp.classic_sta_lta(x, short, long)
            found = [(a, b, float(ratio[a : b + 1].max())) for a, b in dsp.triggers(ratio, params.trigger_value, params.detrigger_value)]
        else:
            at = np.flatnonzero(np.abs(x) >= params.peak_ground_velocity_threshold)
            cut = np.flatnonzero(np.diff(at) > 2 * margin + 1)
            found = [(int(p[0]), int(p[-1]), None) for p in np.split(at, cut + 1) if len(p)]
        wide = [(max(0, a - margin), min(len(x) - 1, b + margin), r) for a, b, r in found]
        return [(trim + a, trim + b, float(np.abs(x[a : b + 1]).max()), r) for a, b, r in wide]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, v in enumerate(batch.column(len(keys))):
                if v.is_valid:
                    new = events(v.values.to_numpy(zero_copy_only=False).astype(float))
                    at += [i] * len(new)
                    rows += new
            types = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
            columns = [c.take(pa.array(at, pa.int64())) for c in batch.columns[: len(keys)]]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array([r[k] for r in rows], t) for k, t in enumerate(types))], [*keys, "first", "last", "pgv", "ratio"])

    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.select(*keys, F.col(array).cast("array<double>")).mapInArrow(run, f"{kinds}, first long, last long, pgv double, ratio double")
