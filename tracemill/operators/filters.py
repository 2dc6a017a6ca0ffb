"""Zero-phase filters and peak events on traces(roi, i, t, value) sampled every dt; i counts from 0.

A low-pass applied forward and backward has a real response, so a trace is filtered by one multiplication
in the frequency domain, after REACH timescales of padding at either end, where the two-way response has
died away (below 1e-12): no kernel is cut off. All passes of a filter happen in one task on one stretch of
a trace. Stretches of CHUNK samples overlap by as much as the passes reach, so a trace of any length is
spread over tasks; only a masked run longer than the overlap would be bridged from nearer samples.
A null sample makes what is made of its stretch null; an empty table gives no row.
"""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.functions.numbers import sigma
from tracemill.functions.tables import numbered, written

ORDER = 5
REACH = 30  # timescales of padding
CHUNK = 1 << 18
PORTION = 256  # traces
MAD = 1.4826  # deviations of a normal variable in its median absolute deviation

EVENT = "peakpoint double, z_max double, t0 double, halfwidth double, height double, auc double, time array<double>, trace array<double>"


@functools.lru_cache
def kernel(samples: int, order: int = ORDER, reach: int = REACH) -> list[float]:
    """The filter as a symmetric kernel, cut off at reach timescales: the cosine transform of its response."""
    f = (np.arange(4096) + 0.5) / 4096
    at = gain_at(f, samples, order)
    half = np.array([(at * np.cos(np.pi * f * j)).mean() for j in range(reach * samples + 1)])
    return np.concatenate([half[:0:-1], half]).tolist()


def gain_at(f: np.ndarray, samples: float, order: int = ORDER) -> np.ndarray:
    """1 / (1 + (tan(pi f / 2) / tan(pi fc / 2)) ^ (2 order)), frequencies relative to half the sampling rate."""
    return 1 / (1 + (np.tan(np.pi * f / 2) / math.tan(math.pi / samples / 2)) ** (2 * order))


def response(frequency: Column, samples: float, order: int = ORDER) -> Column:
    """The two-way gain at a frequency relative to half the sampling rate."""
    return 1 / (1 + F.pow(F.tan(frequency * math.pi / 2) / math.tan(math.pi / samples / 2), F.lit(2.0 * order)))


def smoothed(v: np.ndarray, samples: float, mirror: bool = False, order: int = ORDER) -> np.ndarray:
    """v through the two-way low-pass. The ends go on by odd reflection, or as a mirror for one timescale and level beyond."""
    n, width = len(v), math.ceil(REACH * samples)
    j = np.arange(1, width + 1)
    if mirror:
        at = np.minimum(j, min(max(int(samples), 1), n)) - 1
        left, right = v[at], v[n - 1 - at]
    else:
        left, right = 2 * v[0] - v[np.minimum(j, n - 1)], 2 * v[-1] - v[np.maximum(n - 1 - j, 0)]
    whole = np.concatenate([left[::-1], v, right])
    f = np.arange(len(whole) // 2 + 1) * 2 / len(whole)
    return np.fft.irfft(np.fft.rfft(whole) * gain_at(f, samples, order), len(whole))[width : width + n]


def widened(mask: np.ndarray, size: int) -> np.ndarray:
    """A mask widened by an odd kernel."""
    if size < 3 or not mask.any():
        return mask
    sums = np.concatenate([[0], np.cumsum(np.pad(mask, size // 2))])
    return sums[size:] > sums[:-size]


def odd(size: float) -> int:
    return int(size) + 1 - int(size) % 2


def without_excursions(v: np.ndarray, samples: float, cutoff: float, passes: int) -> np.ndarray:
    """The slow part of v: each pass masks z above the cutoff, widens the mask by a tenth of the timescale,
    replaces masked samples by the line between the nearest unmasked values of the slow part, and filters
    again. The first and last two samples are never masked."""
    slow, clean, at = smoothed(v, samples), v.copy(), np.arange(len(v))
    for _ in range(passes):
        masked = widened((v - slow) / np.sqrt(np.maximum(slow, 3.0)) > cutoff, odd(samples // 10))
        masked[:2] = masked[-2:] = False
        clean[masked] = np.interp(at[masked], at[~masked], slow[~masked])
        slow = smoothed(clean, samples)
    return slow


def without_excursions_lines(v: np.ndarray, samples: float, gain: float, cutoff: float, passes: int, dilation: bool) -> np.ndarray:
    """Likewise for lines of photon counts: deviations are sqrt(gain x slow + 1), the mask is widened by a
    fifth of the timescale, and masked samples are bridged by the trace itself. A trace all masked stays as it is."""
    slow, at = smoothed(v, samples, mirror=True), np.arange(len(v))
    for _ in range(passes if cutoff else 0):
        masked = v - slow > cutoff * np.sqrt(np.maximum(slow * gain + 1, 0.0))
        masked = widened(masked, odd(samples * 0.2)) if dilation else masked
        if masked.any() and not masked.all():
            clean = v.copy()
            clean[masked] = np.interp(at[masked], at[~masked], v[~masked])
            slow = smoothed(clean, samples, mirror=True)
    return slow


def stretches(df: DataFrame, keys: list[str], columns: list[str], reach: int | None) -> DataFrame:
    """keys, part and rows, the samples of a stretch in order; without reach a stretch is a whole trace."""
    if reach is None:
        parted = df.withColumn("part", F.lit(0).cast("long"))
    else:
        first, last = F.greatest(F.floor((F.col("i") - reach) / CHUNK), F.lit(0)), F.floor((F.col("i") + reach) / CHUNK)
        parted = df.withColumn("part", F.explode(F.sequence(first, last)))
    return parted.groupBy(*keys, "part").agg(F.sort_array(F.collect_list(F.struct("i", *columns))).alias("rows"))


def portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """batches a few traces at a time, so that what is made of them is never a whole batch in memory."""
    for batch in batches:
        for start in range(0, batch.num_rows, PORTION):
            yield batch.slice(start, PORTION)


def _columns(rows: pa.Array, names: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Bounds of the traces in a batch, and the columns of their samples."""
    bounds = rows.offsets.to_numpy().astype(np.int64)
    flat = rows.flatten()
    columns = [flat.field(flat.type.get_field_index(c)) for c in names]
    return bounds - bounds[0], [c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in columns]


def traced(df: DataFrame, keys: list[str], needed: list[str], made: list[str], f: Callable[..., tuple], reach: int | None = None) -> DataFrame:
    """df with columns made by f of the arrays of the needed columns of each trace."""
    others = [c for c in df.columns if c not in keys and c != "i" and c not in made]
    rows = stretches(df, keys, others, reach)
    schema = T.StructType([*rows.schema.fields, *(T.StructField(c, T.ArrayType(T.DoubleType())) for c in made)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            bounds, columns = _columns(batch.column("rows"), needed)
            results = [f(*(c[a:b] for c in columns)) for a, b in zip(bounds, bounds[1:], strict=False)]
            lists = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.concatenate(r), from_pandas=True)) for r in zip(*results, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(lists or [pa.array([], pa.list_(pa.float64()))] * len(made))], names=schema.names)

    flat = rows.mapInArrow(run, schema).select(*keys, "part", F.explode(F.arrays_zip("rows", *made)).alias("p"))
    own = flat if reach is None else flat.filter(F.floor(F.col("p.rows.i") / CHUNK) == F.col("part"))
    return own.select(*keys, "p.rows.i", *(F.col(f"p.rows.{c}").alias(c) for c in others), *(F.col(f"p.{c}").alias(c) for c in made))


def reach_of(samples: float, passes: int) -> int:
    return math.ceil(REACH * samples) * (passes + 1)


def lowpass(df: DataFrame, samples: float, keys=("roi",), column: str = "value", out: str = "slow") -> DataFrame:
    """out = column through the two-way low-pass of samples a timescale, the ends extended by odd reflection."""
    source = df.withColumn("_", F.col(column)) if out == column else df
    return traced(source, list(keys), ["_" if out == column else column], [out], lambda v: (smoothed(v, samples),), reach_of(samples, 0)).drop("_")


def scored(df: DataFrame) -> DataFrame:
    return df.withColumn("fast", F.col("value") - F.col("slow")).withColumn("z", F.col("fast") / sigma(F.col("slow")))


def fast_filter(df: DataFrame, samples: float, cutoff: float = 3.0, passes: int = 3, keys=("roi",)) -> DataFrame:
    """slow, fast and z, with excursions taken out of slow (``without_excursions``)."""
    return scored(traced(df, list(keys), ["value"], ["slow"], lambda v: (without_excursions(v, samples, cutoff, passes),), reach_of(samples, passes)))


def fast_filter_lines(df: DataFrame, samples: float, gain: float = 1.0, cutoff: float = 3.0, passes: int = 2, dilation: bool = True, keys=("roi",)) -> DataFrame:
    """slow, fast and z of line scans (``without_excursions_lines``); a cutoff of 0 masks nothing."""
    rows = traced(df, list(keys), ["value"], ["slow"], lambda v: (without_excursions_lines(v, samples, gain, cutoff, passes, dilation),), reach_of(samples, passes))
    fast = F.col("value") - F.col("slow")
    return rows.withColumn("fast", fast).withColumn("z", F.col("fast") / F.sqrt(F.col("slow") * gain + 1))


def running_average(v: np.ndarray, size: int) -> np.ndarray:
    """Means of an odd number of samples; the ends are mirrored."""
    if size < 3:
        return v
    half = min(size // 2, len(v))
    whole = np.concatenate([v[:half][::-1], v, v[len(v) - half :][::-1]])
    return np.lib.stride_tricks.sliding_window_view(whole, 2 * half + 1).mean(axis=1)


def local_maxima(z: np.ndarray) -> np.ndarray:
    """Middles of level stretches that are higher than what comes before and after them."""
    if len(z) < 3:
        return np.zeros(0, np.int64)
    starts = np.flatnonzero(np.append(True, z[1:] != z[:-1]))
    ends = np.append(starts[1:], len(z)) - 1
    level = z[starts]
    top = np.flatnonzero((level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])) + 1
    return (starts[top] + ends[top]) // 2


def left_bases(z: list[float]) -> tuple[list[float], list[int]]:
    """For each sample the lowest value after the last higher sample before it, itself included, and the nearest place of it.

    One pass with a stack of falling samples, each with the lowest value since the one below it.
    """
    lows, places, stack = [], [], []
    for i, v in enumerate(z):
        low, place = v, i
        while stack and stack[-1][0] <= v:
            _, below, at = stack.pop()
            if below < low:
                low, place = below, at
        stack.append((v, low, place))
        lows.append(low)
        places.append(place)
    return lows, places


def peak_events(z: np.ndarray, z_th: float, least: float, most: float) -> list[tuple[int, float, float]]:
    """(peak, left end, right end) of the local maxima of at least z_th whose width at half their prominence is least to most samples.

    The prominence is the height over the higher of the two bases, the lowest samples before the next
    higher sample, or the end, on either side. Ends are where the line between samples crosses half of it.
    """
    if np.isnan(z).any():
        return []
    peaks = local_maxima(z)
    peaks = peaks[z[peaks] >= z_th]
    if not len(peaks):
        return []
    values = z.tolist()
    n = len(values)
    low_l, at_l = left_bases(values)
    low_r, at_r = left_bases(values[::-1])
    found = []
    for p in peaks.tolist():
        half = values[p] - (values[p] - max(low_l[p], low_r[n - 1 - p])) * 0.5
        i, first = p, at_l[p]
        while first < i and half < values[i]:
            i -= 1
        begin = i + (half - values[i]) / (values[i + 1] - values[i]) if values[i] < half else float(i)
        i, last = p, n - 1 - at_r[n - 1 - p]
        while i < last and half < values[i]:
            i += 1
        end = i - (half - values[i]) / (values[i - 1] - values[i]) if values[i] < half else float(i)
        if least <= end - begin <= most:
            found.append((p, begin, end))
    return found


def events_of(z: np.ndarray, fast: np.ndarray | None, slow: np.ndarray | None, t: np.ndarray, samples: float, dt: float, z_th: float, least: float, smooth: int) -> list[tuple]:
    """Rows of EVENT of one trace."""
    z = running_average(z, smooth)
    fast = None if fast is None else running_average(fast, smooth)
    rows = []
    for p, begin, end in peak_events(z, z_th, least * samples, samples):
        a, b = int(begin), min(int(end + 2), len(z))
        height = auc = trace = None
        if fast is not None:
            height, auc, trace = float(fast[p] / slow[p]), float((fast[a:b] / slow[a:b]).sum() * dt), (fast[a:b] + slow[a:b]).tolist()
        rows.append((float(p * dt + t[0]), float(z[p]), float(begin * dt + t[0]), float((end - begin) * dt), height, auc, t[a:b].tolist(), trace))
    return rows


def smoothing(samples: float) -> int:
    """The default size of the running average before a search: a tenth of the timescale, made odd."""
    return odd(samples / 10)


def _event_batch(batch: pa.RecordBatch, keys: list[str], found: list[tuple[int, tuple]]) -> pa.RecordBatch:
    kinds = [pa.float64()] * 6 + [pa.list_(pa.float64())] * 2
    origin = pa.array([k for k, _ in found], pa.int64())
    columns = list(zip(*(row for _, row in found), strict=True)) or [[]] * len(kinds)
    names = [c.split(" ")[0] for c in EVENT.split(", ")]
    return pa.RecordBatch.from_arrays([*(batch.column(c).take(origin) for c in keys), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[*keys, *names])


def detect_events(df: DataFrame, samples: float, dt: float, z_th: float = 3.0, least: float = 0.1, keys=("roi",), smooth: int | None = None) -> DataFrame:
    """keys and EVENT: peaks of z of at least z_th, between the crossings of half their prominence, that are least to 1 timescales wide.

    z and fast are first averaged over smooth samples. height is fast over slow at the peak, auc the sum of
    that ratio over the event times dt, time and trace its samples; without fast and slow these are null.
    The search follows a trace from end to end, so each trace is one array in one task. A trace with a
    null sample has no event.
    """
    keys = list(keys)
    whole = {"fast", "slow"} <= set(df.columns)
    needed = ["z", *(["fast", "slow"] if whole else [])]
    timed = df if "t" in df.columns else df.withColumn("t", F.col("i") * dt)
    rows = stretches(timed, keys, [*needed, "t"], None)
    size = smoothing(samples) if smooth is None else smooth

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            bounds, columns = _columns(batch.column("rows"), [*needed, "t"])
            found = []
            for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                z, *both, t = (c[a:b] for c in columns)
                fast, slow = both or (None, None)
                found += [(k, row) for row in events_of(z, fast, slow, t, samples, dt, z_th, least, size)]
            yield _event_batch(batch, keys, found)

    schema = T.StructType([*(rows.schema[c] for c in keys), *T._parse_datatype_string(EVENT).fields])
    return rows.mapInArrow(run, schema)


def prepared(df: DataFrame, timescales: list[float], dt: float, points: int = 30, keys=("roi",)) -> DataFrame:
    """ts, keys, i, value: traces rebinned for each timescale to about so many samples a timescale, one at least; incomplete bins go."""
    rows = df.withColumn("ts", F.explode(F.array(*map(F.lit, timescales))))
    n = F.greatest(F.lit(1), F.floor(F.col("ts") / dt / points)).cast("int")
    out = rows.withColumn("n_", n).groupBy("ts", "n_", *keys, F.floor(F.col("i") / F.col("n_")).cast("int").alias("i")).agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("held_"))
    return out.filter("held_ = n_").select("ts", *keys, "i", "value")


def default_timescales() -> list[float]:
    """Quarter octaves from 4 to 256, to three digits."""
    return sorted({float(f"{2 ** (2 + k / 4):.3g}") for k in range(25)})


def scaled(z: DataFrame, keys: list[str], mode: str) -> DataFrame:
    """z(its, keys, deviation, ...) with scale: the median deviation of a timescale and recording, the trace's own, or 1."""
    if mode != "soft":
        return z.withColumn("scale", F.col("deviation") if mode == "hard" else F.lit(1.0))
    of = ["its", *keys[:-1]]
    middle = z.groupBy(*of).agg(F.percentile("deviation", F.lit(0.5)).alias("scale"))
    # One row a timescale and recording. Dealt by its, of which there are a few, all traces would fall to as few tasks.
    middle = F.broadcast(middle.select("scale", *(F.col(c).alias(f"_{c}") for c in of)))
    return z.join(middle, functools.reduce(operator.and_, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in of))).select(*z.columns, "scale")


def candidate_events(df: DataFrame, dt: float, timescales: list[float] | None = None, cutoff: float = 2.0, passes: int = 3, z_th: float = 3.0, keys=("roi",), mode: str = "soft", smooth: int | None = None) -> DataFrame:
    """event_id, its, ts, keys and EVENT: events of every timescale (in units of dt) that is longer than five samples and shorter than a third of its trace.

    z is first divided by the median over the traces of a recording (all keys but the last) of their
    deviations ("soft"), or by each trace's own MAD ("hard"); any other mode leaves it. event_id numbers
    the events by (its, keys, t0) from 0 without a gap. A trace is filtered at all its timescales by one task.
    """
    keys = list(keys)
    scales = sorted(set(default_timescales() if timescales is None else map(float, timescales)))
    scales = [ts for ts in scales if ts > 5 * dt] if timescales is None else scales
    timed = df if "t" in df.columns else df.withColumn("t", F.col("i") * dt)
    rows = stretches(timed, keys, ["value", "t"], None)
    own_keys = [rows.schema[c] for c in keys]
    kinds = [pa.int32(), pa.float64(), pa.float64(), *[pa.list_(pa.float64())] * 3]
    names = ["its", "ts", "deviation", "times", "slow", "z"]

    def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            bounds, (value, time) = _columns(batch.column("rows"), ["value", "t"])
            for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                v, t, out = value[a:b], time[a:b], []
                for its, ts in enumerate(scales):
                    if timescales is None and ts >= t[-1] / 3:
                        break
                    slow = without_excursions(v, ts / dt, cutoff, passes)
                    z = (v - slow) / np.sqrt(np.maximum(slow, 3.0))
                    deviation = MAD * float(np.median(np.abs(z - np.median(z)))) if mode == "hard" else float(z.std())
                    out.append((its, ts, deviation, t, slow, z))
                columns = list(zip(*out, strict=True)) or [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array([k] * len(out), pa.int64())) for c in keys), *(pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True))], names=[*keys, *names])

    made = T._parse_datatype_string("its int, ts double, deviation double, times array<double>, slow array<double>, z array<double>").fields
    z = written(rows.mapInArrow(filtered, T.StructType([*own_keys, *made])), "filtered")
    ready = scaled(z, keys, mode)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            found = []
            for k, (ts, scale) in enumerate(zip(batch.column("ts").to_pylist(), batch.column("scale").to_pylist(), strict=True)):
                t, slow, own = (batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in ("times", "slow", "z"))
                fast = own * np.sqrt(np.maximum(slow, 3.0))
                if scale:
                    size = smoothing(ts / dt) if smooth is None else smooth
                    found += [(k, row) for row in events_of(own / scale, fast, slow, t, ts / dt, dt, z_th, 0.1, size)]
            yield _event_batch(batch, ["its", "ts", *keys], found)

    schema = T.StructType([*made[:2], *own_keys, *T._parse_datatype_string(EVENT).fields])
    return numbered(ready.mapInArrow(search, schema), ["its", *keys, "t0", "peakpoint"], "event_id")
