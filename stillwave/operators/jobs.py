"""Steps of the processing chain as incremental jobs.

A step takes the tables it reads, and the table of its results so far. It does only the work
that has no result yet, or whose inputs have changed since, and returns the table with the
new rows; running it again on the same input changes nothing. A window, chunk or pair that
can't be done has no row, so it is tried again when more data has come; with a ``quarantine``
it has a row there, and what would end the job ends that item alone (or the job, if that is
the quarantine's policy). Results are committed by ``committed``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stillwave import config
from stillwave.functions import arrays as A
from stillwave.functions import columns as C
from stillwave.operators import chunks as K
from stillwave.operators import grid, inventory, preparation, responses, signals, stacking
from stillwave.operators.quarantine import Quarantine
from stillwave.operators.snapshots import Snapshots

Compute = Callable[[DataFrame], DataFrame]


def step(work: DataFrame, results: DataFrame, key: list[str], compute: Compute) -> DataFrame:
    """The results with those of the work that had none. Which that is is found by keys alone, so
    Spark may send around a short list of them instead of moving all work's arrays."""
    todo = K.not_done(work.select(*key).distinct(), results, key)
    new = compute(work.join(todo, key, "left_semi"))
    return K.upsert(results, new.select(*results.columns), key, nothing_on_conflict=True)


def committed(table: Snapshots, work: DataFrame, key: list[str], compute: Compute) -> int:
    """Computes what the table's last snapshot lacks of the work, publishes it as a new one, and
    returns its version; a run that fails leaves the table as it was."""
    todo = K.not_done(work.select(*key).distinct(), table.read(), key)
    return table.upsert(compute(work.join(todo, key, "left_semi")), nothing_on_conflict=True)


def sound(work: DataFrame, name: str, key: list[str], array: str, quarantine: Quarantine | None) -> DataFrame:
    """The work whose array is whole, with a quarantine for the rest; without one, all of it."""
    return work if quarantine is None else quarantine.sound(name, key, work, array)


def index(records: DataFrame, table: DataFrame) -> DataFrame:
    """Files and channels of records, with their first and last time; rows of files that were
    read again are replaced."""
    from stillwave.sources.miniseed import time_series_index

    return K.upsert(table, time_series_index(records).select(*table.columns), ["path", "network", "station", "location", "channel"])


def timespans(table: DataFrame, start: str, end: str, length_s: float, overlap_s: float = 0.0) -> DataFrame:
    """The grid of windows with those that aren't there yet, numbered on in order of time."""
    new = grid.timespans(table.sparkSession, start, end, length_s, overlap_s).join(table.select("starttime", "endtime"), ["starttime", "endtime"], "left_anti")
    first = K.next_id(table, "timespan_id")
    # A grid is generated from its ends, so its windows are few and numbered as they come.
    numbered = K.numbered(new.withColumn("_day", F.to_date("starttime")).withColumn("_all", F.lit(0)), ["_all"], "_day", ["starttime", "endtime"], "_n")
    numbered = numbered.crossJoin(F.broadcast(first)).withColumn("timespan_id", F.col("_n") + F.col("next_id") - 1)  # one row
    return table.unionByName(numbered.select(*table.columns))


def pairs(components: DataFrame, table: DataFrame) -> DataFrame:
    """All pairs of components with those that aren't there yet."""
    return step(inventory.pairs(components), table, ["component_id_a", "component_id_b"], lambda new: new)


def datachunks(records: DataFrame, spans: DataFrame, table: DataFrame, params: config.DatachunkParams, rate: float, quarantine: Quarantine | None = None) -> DataFrame:
    """Chunks (``component_id``, ``timespan_id``, ``samples``, ``deficit``) of records."""
    key = ["component_id", "timespan_id"]
    sliced = preparation.slices(records, spans, ["component_id"], 3600)
    good = (lambda df: df.filter("problem is null")) if quarantine is None else (lambda df: quarantine.split("datachunks", key, df))
    return step(sliced, table, key, lambda new: good(preparation.filled(new, ["component_id"], params, rate)))


def preprocessed(datachunks: DataFrame, spans: DataFrame, epochs: DataFrame, table: DataFrame, params: config.DatachunkParams, rate: float, quarantine: Quarantine | None = None) -> DataFrame:
    """Chunks of ``rate`` brought to the parameters' one: detrended, resampled, cut to the window's
    number of samples, tapered and filtered; the response of their component's epoch at their
    window's start is taken off if the parameters say so; they are multiplied by the
    parameters' coefficient, or, if it is 0, divided by the sensitivity; and filtered again
    without delay. A chunk whose response isn't known has no row. ``epochs`` is what
    ``read_responses`` gives, by ``component_id``."""
    key = ["component_id", "timespan_id"]
    new, band = params.sampling_rate, {"low": params.prefiltering_low, "high": params.prefiltering_high, "order": params.prefiltering_order}
    length = F.unix_micros(F.col("endtime").cast("timestamp_ltz")) - F.unix_micros(F.col("starttime").cast("timestamp_ltz"))
    lengths = [r.n for r in spans.select(length.alias("n")).distinct().limit(2).collect()]
    if len(lengths) > 1:
        raise ValueError("windows of one set of parameters have one length")
    samples = int(round(lengths[0] / 1e6 * new)) if lengths else 0
    share = min(params.preprocessing_taper_max_length * new / max(samples, 1), params.preprocessing_taper_max_percentage * 0.01, 0.05)

    good = (lambda df: df.filter("problem is null").drop("problem")) if quarantine is None else (lambda df: quarantine.split("preprocessed", key, df))
    datachunks = sound(datachunks, "preprocessed", key, "samples", quarantine)

    def staged(df: DataFrame, stage: str, at: float, **options) -> DataFrame:
        rest = F.struct(*[c for c in df.columns if c != "samples"])
        found = signals.per_trace(df.select(rest.alias("k"), F.col("samples").alias("x")), stage, at, id="k", problems=quarantine is not None, **options)
        return found.select("k.*", F.col("y").alias("samples")) if quarantine is None else good(found.select("k.*", F.col("y").alias("samples"), "problem"))

    def known(df: DataFrame, **options) -> DataFrame:
        return good(responses.without_response(df, epochs, new, key=["component_id"], taper_share=share, **options))

    def compute(work: DataFrame) -> DataFrame:
        out = staged(work.select(*key, "samples").join(spans.select("timespan_id", "starttime"), "timespan_id"), "prepared", rate, params=params, samples=samples)
        if params.remove_response:
            out = known(out)
        if params.response_constant_coefficient == 0:
            out = known(out, sensitivity_only=True)
        elif params.response_constant_coefficient is not None:
            out = out.withColumn("samples", A.scaled(F.col("samples"), params.response_constant_coefficient))
        return staged(out, "bandpass", new, zero_phase=True, **band).filter("samples is not null")

    return step(datachunks, table, key, compute)


def statistics(datachunks: DataFrame, table: DataFrame, quarantine: Quarantine | None = None) -> DataFrame:
    """Statistics of chunks."""
    key = ["component_id", "timespan_id"]
    datachunks = sound(datachunks, "statistics", key, "samples", quarantine)
    return step(datachunks, table, key, lambda new: new.select(*key, *(c.alias(n) for n, c in K.array_statistics(F.col("samples")).items())))


def processed(datachunks: DataFrame, table: DataFrame, params: config.ProcessedDatachunkParams, rate: float, quarantine: Quarantine | None = None) -> DataFrame:
    """Chunks whitened, filtered and reduced to signs, as far as the parameters say so."""
    key = ["component_id", "timespan_id"]
    datachunks = sound(datachunks, "processed", key, "samples", quarantine)

    def compute(new: DataFrame) -> DataFrame:
        named = new.select(F.struct(*key).alias("k"), F.col("samples").alias("x"))
        if quarantine is None:
            return signals.per_trace(named, "processed", rate, id="k", params=params).select("k.*", F.col("y").alias("samples"))
        found = signals.per_trace(named, "processed", rate, id="k", problems=True, params=params)
        return quarantine.split("processed", key, found.select("k.*", F.col("y").alias("samples"), "problem"))

    return step(datachunks, table, key, compute)


def qc_one(statistics: DataFrame, spans: DataFrame, gps: DataFrame, periods: DataFrame, table: DataFrame, params: config.QCOneConfig) -> DataFrame:
    """Verdicts of chunks with statistics. ``gps`` has ``error`` and ``uncertainty`` by component
    and window, ``periods`` the rejected times by component. A verdict is made anew, since
    GPS rows and periods that came later change it; it takes a chunk's numbers, no samples."""
    key = ["component_id", "timespan_id"]

    def compute(new: DataFrame) -> DataFrame:
        work = new.join(spans.select("timespan_id", "starttime", "endtime"), "timespan_id").withColumn("chunk_id", F.concat_ws("/", *key))
        work = K.outside_rejected(K.with_gps(work, gps, key, params.strict_gps), periods, "component_id")
        start, end = (F.lit(config.moment(t).isoformat(" ")).cast("timestamp_ntz") for t in (params.starttime, params.endtime))
        verdicts = [*K.time_verdicts(start, end), F.col("ok_accepted_time"), *K.bounds_verdicts(params.bounds, params.null_value), *K.bounds_verdicts(params.gps_bounds, params.null_value)]
        found = work.select(*key, *verdicts)
        return found.withColumn("is_passing", K.passing([c for c in found.columns if c.startswith("ok_")]))

    return K.upsert(table, compute(statistics).select(*table.columns), key)


def crosscorrelations(processed: DataFrame, pairs: DataFrame, table: DataFrame, max_lag: int, verdicts: DataFrame | None = None, quarantine: Quarantine | None = None) -> DataFrame:
    """Correlations (``component_id_a``, ``component_id_b``, ``timespan_id``, ``ccf``) of the
    pairs whose chunks are both there in a window and, where verdicts are given, pass.

    What is left to do is found by keys alone; the samples of finished work aren't moved."""
    chunk = ["component_id", "timespan_id"]
    processed = sound(processed, "crosscorrelations", chunk, "samples", quarantine)
    held = processed if verdicts is None else K.passed_only(processed, verdicts, chunk)
    key = ["component_id_a", "component_id_b", "timespan_id"]
    there = held.select(*chunk).distinct()
    side = lambda s: there.withColumnRenamed("component_id", f"component_id_{s}")
    known = pairs.select("component_id_a", "component_id_b").distinct()
    todo = K.not_done(known.join(side("a"), "component_id_a").join(side("b"), ["component_id_b", "timespan_id"]), table, key)
    return table.unionByName(signals.block_correlations(held, todo, max_lag).select(*table.columns))


#: By rotated code, the letters at both stations of the correlations that it combines, in order.
_PARTS = {
    "RR": ("EE", "EN", "NE", "NN"), "TT": ("EE", "EN", "NE", "NN"), "RT": ("EE", "EN", "NE", "NN"), "TR": ("EE", "EN", "NE", "NN"),
    "RZ": ("EZ", "NZ"), "TZ": ("EZ", "NZ"), "ZR": ("ZE", "ZN"), "ZT": ("ZE", "ZN"),
}


def cylindrical(ccfs: DataFrame, pairs: DataFrame, table: DataFrame, quarantine: Quarantine | None = None) -> DataFrame:
    """Rotated correlations (``station_a``, ``station_b``, ``code``, ``timespan_id``, ``ccf``) of
    the pairs (``inventory.cylindrical_pairs`` with backazimuth) whose parts are all there.

    A part is looked up by its two components, whichever of them the correlation has first;
    one that is stored the other way round is turned over in time.
    """
    key = ["station_a", "station_b", "code", "timespan_id"]
    ccfs = sound(ccfs, "cylindrical", ["component_id_a", "component_id_b", "timespan_id"], "ccf", quarantine)
    need = F.create_map(*[x for code, parts in _PARTS.items() for x in (F.lit(code), F.array(*map(F.lit, parts)))])
    ids = lambda s, letter: F.coalesce(*(F.when(letter == x, F.col(f"{s}{x}")) for x in "ENZ"))
    wanted = pairs.withColumn("code", F.col("component_cylindrical_code_pair")).withColumn("part", F.explode(F.element_at(need, F.col("code"))))
    wanted = wanted.withColumn("_a", ids("a", F.substring("part", 1, 1))).withColumn("_b", ids("b", F.substring("part", 2, 1)))
    wanted = wanted.select("station_a", "station_b", "code", "backazimuth", "part", "_a", F.least("_a", "_b").alias("low"), F.greatest("_a", "_b").alias("high"))
    held = ccfs.select("component_id_a", "timespan_id", "ccf", F.least("component_id_a", "component_id_b").alias("low"), F.greatest("component_id_a", "component_id_b").alias("high"))
    found = wanted.join(held, ["low", "high"])
    found = found.withColumn("ccf", F.when(F.col("component_id_a") == F.col("_a"), F.col("ccf")).otherwise(F.reverse("ccf")))

    def compute(new: DataFrame) -> DataFrame:
        slots = sorted({p for parts in _PARTS.values() for p in parts})
        picked = [F.max(F.when(F.col("part") == p, F.col("ccf"))).alias(p) for p in slots]
        wide = new.groupBy(*key, "backazimuth").agg(*picked)
        out = F.when(F.lit(False), F.col(slots[0]))
        for code, parts in _PARTS.items():
            columns, back = [F.col(p) for p in parts], F.col("backazimuth")
            value = A.rotate(code, *columns, back) if len(parts) == 4 else A.rotate_vertical(code, *columns, back)
            whole = inventory.every([c.isNotNull() for c in columns])
            out = out.when((F.col("code") == code) & whole, value)
        return wide.select(*key, out.alias("ccf")).filter("ccf is not null")

    return step(found, table, key, compute)


def qc_two(ccfs: DataFrame, spans: DataFrame, periods: DataFrame, table: DataFrame, params: config.QCTwoConfig) -> DataFrame:
    """Verdicts of correlations: within the accepted period, and outside the rejected times of
    their pair (``component_id_a``, ``component_id_b``, ``starttime``, ``endtime``)."""
    pair = ["component_id_a", "component_id_b"]
    key = [*pair, "timespan_id"]

    def compute(new: DataFrame) -> DataFrame:
        work = new.select(*key).join(spans.select("timespan_id", "starttime", "endtime"), "timespan_id").withColumn("chunk_id", F.concat_ws("/", *key))
        work = K.outside_rejected(work, periods, pair)
        start, end = (F.lit(config.moment(t).isoformat(" ")).cast("timestamp_ntz") for t in (params.starttime, params.endtime))
        found = work.select(*key, *K.time_verdicts(start, end, params.null_value), "ok_accepted_time")
        return found.withColumn("is_passing", K.passing(["ok_starttime", "ok_endtime", "ok_accepted_time"]))

    return step(ccfs, table, key, compute)


def changed(work: DataFrame, table: DataFrame, key: list[str], input: str, count: str | None = None) -> DataFrame:
    """Keys of ``work`` whose inputs differ from those that their result was made of, or which
    have none, with ``inputs``, a digest of the ids in ``input``.

    The digest is compared if the table keeps one in ``inputs``; ``count``, if given, is the
    table's column with the number of inputs. With neither, keys that have a result are done.
    """
    ids = F.xxhash64(input).cast("decimal(38,0)")
    now = work.groupBy(*key).agg(F.pmod(F.sum(ids), F.lit(2**62)).cast("long").alias("inputs"), F.count("*").alias("_count"))
    kept = {"inputs": "inputs"} if "inputs" in table.columns else {}
    kept |= {count: "_count"} if count else {}
    then = table.select(*key, *(F.col(c).alias(f"_then{c}") for c in kept), F.lit(True).alias("_there")).distinct()
    same = inventory.every([F.col("_there").isNotNull(), *(F.col(f"_then{c}") == F.col(n) for c, n in kept.items())])
    return now.join(then, key, "left").filter(~F.coalesce(same, F.lit(False))).select(*key, "inputs")


def renewed(table: DataFrame, todo: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """The table with ``new`` in place of the rows of ``todo``'s keys."""
    held = table.join(todo.select(*key), key, "left_anti")
    if "inputs" in table.columns:
        new = new.join(todo, key)
    return held.select(*table.columns).unionByName(new.select(*table.columns))


def stacks(ccfs: DataFrame, spans: DataFrame, stack_spans: DataFrame, table: DataFrame, least: int, verdicts: DataFrame | None = None, quarantine: Quarantine | None = None) -> DataFrame:
    """Mean correlations by pair and stacking window (``stack_id``, ``stack_start``,
    ``stack_end``), of the windows within it whose verdicts, where given, pass.

    A stack is made anew when the windows within it have changed: by their number
    (``no_ccfs``) and, if the table has ``inputs``, by which they are. One that has fewer than
    ``least`` of them now goes. Which these are is found without moving correlations.
    """
    pair = ["component_id_a", "component_id_b"]
    key = [*pair, "stack_id"]
    held = sound(ccfs, "stacks", [*pair, "timespan_id"], "ccf", quarantine).filter("ccf is not null")
    held = held if verdicts is None else K.passed_only(held, verdicts, [*pair, "timespan_id"])
    within = grid.bucketed_containment_join(spans.select("timespan_id", "starttime", "endtime"), stack_spans, "starttime", "endtime", "stack_start", "stack_end", 3600)
    within = within.select("timespan_id", "stack_id")
    todo = changed(held.select(*pair, "timespan_id").join(within, "timespan_id"), table, key, "timespan_id", "no_ccfs")
    work = held.join(within, "timespan_id").join(todo.select(*key), key, "left_semi")
    return renewed(table, todo, stacking.linear_stack(work, key, "ccf", least), key)


def power_spectra(datachunks: DataFrame, table: DataFrame, params: config.PPSDParams, quarantine: Quarantine | None = None) -> DataFrame:
    """Mean spectra of chunks."""
    key = ["component_id", "timespan_id"]
    datachunks = sound(datachunks, "power_spectra", key, "samples", quarantine)

    def compute(new: DataFrame) -> DataFrame:
        named = new.select(F.struct(*key).alias("k"), F.col("samples").alias("x"))
        return signals.spectra(named, params, id="k").filter("segments > 0").select("k.*", "mean", "std", "segments")

    return step(datachunks, table, key, compute)


def beams(datachunks: DataFrame, places: DataFrame, table: DataFrame, params: config.BeamformingParams, rate: float, quarantine: Quarantine | None = None) -> DataFrame:
    """Peaks of the beams of windows. ``places`` has ``component_id``, ``px``, ``py``. If the table
    has ``inputs``, a window is done again when other components have come to it."""
    key = ["timespan_id"]
    datachunks = sound(datachunks, "beams", ["component_id", "timespan_id"], "samples", quarantine)
    placed = datachunks.join(places, "component_id")
    todo = changed(placed.select(*key, "component_id"), table, key, "component_id")
    work = placed.select("timespan_id", F.col("component_id").alias("vec_id"), F.col("samples").alias("x"), "px", "py").join(todo.select(*key), key, "left_semi")
    return renewed(table, todo, signals.beam_peaks(work, params, rate), key)


def events(datachunks: DataFrame, searched: DataFrame, params: config.EventDetectionParams, rate: float, quarantine: Quarantine | None = None) -> tuple[DataFrame, DataFrame]:
    """Detections of chunks that weren't searched yet, and the table ``searched`` of keys with
    them added: a chunk may well have no event."""
    key = ["component_id", "timespan_id"]
    datachunks = sound(datachunks, "events", key, "samples", quarantine)
    todo = K.not_done(datachunks, searched, key)
    found = signals.detections(todo, params, rate, key, array="samples")
    return found, searched.unionByName(todo.select(*key).distinct().select(*searched.columns))


def soh(samples: DataFrame, components: DataFrame, spans: DataFrame, table: DataFrame, bucket_s: int = 3600) -> DataFrame:
    """Mean GPS error and uncertainty by component and window from state-of-health samples
    (``station``, ``datetime``, ``time_error``, ``time_uncertainty``); ends are inclusive, and a
    window's row is made anew, since late samples change it."""
    held = grid.bucketed_range_join(samples, spans.select("timespan_id", "starttime", "endtime"), "datetime", "starttime", "endtime", bucket_s, closed=True)
    means = held.groupBy("station", "timespan_id").agg(F.avg("time_error").alias("error"), F.avg("time_uncertainty").alias("uncertainty"))
    new = means.join(components.select("component_id", "station"), "station").select("component_id", "timespan_id", "error", "uncertainty")
    return K.upsert(table, new.select(*table.columns), ["component_id", "timespan_id"])


def overlapping(df: DataFrame, start, end) -> DataFrame:
    """Rows whose period overlaps another, ends included."""
    return df.filter(C.overlaps(F.col("starttime"), F.col("endtime"), start, end))
