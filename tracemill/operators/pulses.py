"""Shapes of events: two families of pulses, their fit to events, and the pursuit of pulses in traces.

A pulse has a model ("gamma" or "lognormal"), loc, the time of its first point of inflection, width, the
time from there to the second one, and form: for gamma the mode's distance from the beginning in units
of the decay time, for lognormal the deviation of the logarithm. It is scaled to a peak of 1, so that no
normalising constant of a density is needed. Under CUT of the peak a pulse counts as over.

Fits are grids over (loc, width, form); from the best point of every form, each next one is finer and
follows its best point for up to MOVES steps; amplitude and a
straight background are the least-squares ones for each point of the grid, in closed form.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Generator, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.functions.tables import spread
from tracemill.operators import filters as fl

CUT = 0.01
BEFORE, AFTER = 0.7, 3.0  # a window, in halfwidths from an event's start
MODELS = ["gamma", "lognormal"]

FIT = "model string, loc double, width double, form double, amplitude double, offset double, end double, halfwidth double, chi2 double"


def lognormal_scale(width, form, exp=np.exp, sqrt=np.sqrt):
    """(scale, where the first point of inflection lies in it) of numbers or columns."""
    half = form * sqrt(1 + form * form / 4)
    first, second = exp(-1.5 * form * form - half), exp(-1.5 * form * form + half)
    scale = width / (second - first)
    return scale, scale * first


def shares(model: str, t: np.ndarray, loc, width, form) -> np.ndarray:
    """Heights of pulses of peak 1 at times t; parameters may be columns of an array."""
    with np.errstate(divide="ignore", invalid="ignore"):
        if model == "gamma":
            u = (t - loc) * 2 * np.sqrt(form) / width + form - np.sqrt(form)
            logs = form * np.log(u / form) + form - u
        else:
            scale, first = lognormal_scale(width, form)
            u = t - loc + first
            w = np.log(u / scale)
            logs = -w - w * w / (2 * form * form) - form * form / 2
        return np.where(u > 0, np.exp(logs), 0.0)


def modes(model: str, loc, width, form) -> np.ndarray:
    """Times of peaks."""
    if model == "gamma":
        return loc + width / 2 + 0 * form
    scale, first = lognormal_scale(width, form)
    return loc - first + scale * np.exp(-form * form)


def halfwidths(model: str, width, form) -> np.ndarray:
    """Widths at half height. For gamma each distinct form is solved for once."""
    width, form = np.asarray(width, float), np.asarray(form, float)
    if model == "lognormal":
        return lognormal_scale(width, form)[0] * np.exp(-form * form) * 2 * np.sinh(form * math.sqrt(2 * math.log(2)))
    distinct, places = np.unique(form, return_inverse=True)
    return np.array([_apart(f) for f in distinct.tolist()])[places].reshape(form.shape) * np.sqrt(form) * width / 2


@functools.lru_cache(1 << 16)
def _apart(form: float) -> float:
    """How far apart, in units of form, a gamma pulse crosses half its height."""
    # r - 1 - ln r = ln 2 / form has a root on either side of 1; Newton's steps in ln r
    rest = math.log(2) / form
    ends = []
    for q in (-1 - rest, np.log1p(2 * rest / 3 + np.sqrt((2 * rest / 3) ** 2 + 2 * rest))):
        for _ in range(40):
            q = q - (np.exp(q) - 1 - q - rest) / (np.exp(q) - 1)
        ends.append(np.exp(q))
    return float(ends[1] - ends[0])


def share(model: Column, t: Column, loc: Column, width: Column, form: Column) -> Column:
    """``shares`` as a column, and 0 under CUT."""
    u = (t - loc) * 2 * F.sqrt(form) / width + form - F.sqrt(form)
    gamma = F.when(u > 0, F.exp(form * F.ln(u / form) + form - u))
    scale, first = lognormal_scale(width, form, F.exp, F.sqrt)
    x = t - loc + first
    w = F.ln(x / scale)
    lognormal = F.when(x > 0, F.exp(-w - w * w / (2 * form * form) - form * form / 2))
    found = F.coalesce(F.when(model == "gamma", gamma).when(model == "lognormal", lognormal), F.lit(0.0))
    return F.when(found < CUT, 0.0).otherwise(found)


def gamma_pulse(t: Column, amplitude: Column, loc: Column, scale: Column, s: Column) -> Column:
    """amplitude times the density of a gamma variable of shape s > 1 that begins at loc, over its peak."""
    u, m = (t - loc) / scale, s - 1
    return F.when(u > 0, amplitude * F.exp(m * F.ln(u / m) + m - u)).otherwise(0.0)


def background(t: Column, begin: Column, end: Column, offset: Column, last: Column) -> Column:
    """offset before begin, last from end on, the straight line between them."""
    return F.when(t <= begin, offset).when(t >= end, last).otherwise(offset + (last - offset) * (t - begin) / (end - begin))


def support(model: Column, loc: Column, width: Column, form: Column) -> tuple[Column, Column]:
    """Times outside which a pulse is under CUT."""
    rate, rest = 2 * F.sqrt(form) / width, math.log(1 / CUT) / form
    far = 1 + 2 * rest / 3 + F.sqrt((2 * rest / 3) * (2 * rest / 3) + 2 * rest)  # r - 1 - ln r >= x^2 / (2 + 4 x / 3) at r = 1 + x
    scale, first = lognormal_scale(width, form, F.exp, F.sqrt)
    log_far = form * math.sqrt(2 * math.log(1 / CUT))
    low = F.when(model == "gamma", loc - (form - F.sqrt(form)) / rate).otherwise(loc - first + scale * F.exp(-form * form - log_far))
    high = F.when(model == "gamma", loc + (far * form - form + F.sqrt(form)) / rate).otherwise(loc - first + scale * F.exp(-form * form + log_far))
    return low, high


def sum_of_pulses(pulses: DataFrame, samples: DataFrame, dt: float, keys=("roi",), begin: float = 0.0) -> DataFrame:
    """samples(keys, i, t, ...) with pulses, the sum of the pulses (model, loc, width, form, amplitude) of the same keys there.

    Each pulse meets the samples that it covers by their number, t = begin + i dt.
    """
    keys = list(keys)
    pars = ["model", "loc", "width", "form"]
    low, high = support(*map(F.col, pars))
    first, last = F.greatest(F.ceil((low - begin) / dt), F.lit(0)), F.floor((high - begin) / dt)
    # dealt by trace before each pulse becomes one row a sample: the sums need no further shuffle
    covered = spread(pulses.filter(first <= last), *keys).select(*keys, *pars, "amplitude", F.explode(F.sequence(first, last)).alias("i"))
    height = F.col("amplitude") * share(F.col("model"), F.col("i") * dt + begin, F.col("loc"), F.col("width"), F.col("form"))
    sums = covered.groupBy(*keys, F.col("i").cast(samples.schema["i"].dataType).alias("i")).agg(F.sum(height).alias("pulses"))
    return samples.drop("pulses").join(sums, [*keys, "i"], "left").withColumn("pulses", F.coalesce("pulses", F.lit(0.0)))


@dataclass(frozen=True)
class Grid:
    """Points around an event: loc in halfwidths from its start, width in halfwidths, forms of either model (none: the model is left out)."""

    loc: tuple[float, ...] = (-0.2, 0.0, 0.2, 0.4, 0.6)
    width: tuple[float, ...] = (0.5, 0.7, 1.0, 1.4)
    gamma: tuple[float, ...] = (1.0, 2.5, 6.0, 15.0)
    lognormal: tuple[float, ...] = (0.2, 0.35, 0.6, 1.0)

    def points(self, model: str) -> np.ndarray:
        forms = self.gamma if model == "gamma" else self.lognormal
        return np.array([(a, b, c) for a in self.loc for b in self.width for c in forms]).reshape(-1, 3)


MOVES = 8  # of a finer grid after its best point, before it is made finer again
LEAST_RISE = 1e-9  # of a pulse over its window's mean; below it is rounding
START = 0.1  # where loc is sought first, in halfwidths from the start


STEPS = np.array([(a, b, c) for a in (0, -1, 1) for b in (0, -1, 1) for c in (0, -1, 1)])


def finer(best: np.ndarray, level: int) -> np.ndarray:
    """27 points around each (loc, width, form), closer at each level; the first is the point itself."""
    loc, ratio, form = 0.1 / 2 ** (level - 1), 1.19 ** (1 / 2 ** (level - 1)), 1.6 ** (1 / 2 ** (level - 1))
    a, b, c = STEPS.T
    return np.stack([best[:, :1] + a * loc, best[:, 1:2] * ratio ** b.astype(float), best[:, 2:] * form ** c.astype(float)], axis=2)


def scored(windows: Windows, model: str, points: np.ndarray, relative: bool) -> tuple[np.ndarray, ...]:
    """Of each window's points score, amplitude, and background at the window's ends. The score is infinite where the pulse is no fit:
    not upward, fewer than three samples, no peak inside the window, too far from where it was sought, or a curve that is not positive."""
    w, hw, held = windows, windows.halfwidth[:, None], windows.held[:, None, :]
    loc, width, form = w.t0[:, None] + points[..., 0] * hw, points[..., 1] * hw, points[..., 2] + 0 * hw
    p = np.where(held, shares(model, w.t[:, None, :], loc[..., None], width[..., None], form[..., None]), 0.0)
    n, tau = w.n[:, None], w.tau[:, None, :]
    slopes = np.where(w.squares > 0, (p @ w.tau[:, :, None])[..., 0].T / np.where(w.squares > 0, w.squares, 1.0), 0.0).T
    level = p.sum(axis=2) / n
    free = np.where(held, p - level[..., None] - slopes[..., None] * tau, 0.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        amplitude = (free @ w.y[:, :, None])[..., 0] / np.einsum("eps,eps->ep", free, free)
        base = w.mean[:, None] - amplitude * level
        slope = w.slope[:, None] - amplitude * slopes
        curve = amplitude[..., None] * p + base[..., None] + slope[..., None] * tau
        part = p >= CUT
        seen = part.sum(axis=2)
        low = np.where(part, curve, np.inf).min(axis=2)
        spread = curve + low[..., None] / 100 if relative else 1.0
        score = np.where(part, (w.y[:, None, :] - curve) ** 2 / spread, 0.0).sum(axis=2) / seen
    peak = modes(model, loc, width, form)
    moved = np.abs(points[..., 0] - START) * hw <= hw + halfwidths(model, width, form)
    fine = (amplitude > LEAST_RISE * np.abs(w.mean)[:, None]) & (seen >= 3) & (peak > w.first[:, None]) & (peak < w.last[:, None]) & moved & np.isfinite(score) & ((low > 0) if relative else True)
    begin, end = (slope * (side - w.middle)[:, None] for side in (w.first, w.last))
    return np.where(fine, score, np.inf), amplitude, base + begin, base + end


class Windows:
    """Windows of several events side by side, filled up to the longest one, with what all fits to them need."""

    def __init__(self, windows: list[tuple], jump: list[bool]):
        """windows: (t, y, t0, halfwidth) each."""
        sizes = np.array([len(w[0]) for w in windows])
        self.held = np.arange(sizes.max()) < sizes[:, None]
        self.t, self.y = np.zeros(self.held.shape), np.zeros(self.held.shape)
        self.t[self.held], self.y[self.held] = (np.concatenate([w[k] for w in windows]) for k in (0, 1))
        self.t0, self.halfwidth = (np.array([w[k] for w in windows], float) for k in (2, 3))
        self.first, self.last = self.t[:, 0], self.t[np.arange(len(sizes)), sizes - 1]
        self.n = sizes.astype(float)
        self.middle, self.mean = np.array([w[0].mean() for w in windows]), np.array([w[1].mean() for w in windows])
        self.tau = np.where(self.held, self.t - self.middle[:, None], 0.0)
        self.squares = np.where(np.array(jump), (self.tau * self.tau).sum(axis=1), 0.0)
        self.slope = np.where(self.squares > 0, (self.tau * self.y).sum(axis=1) / np.where(self.squares > 0, self.squares, 1.0), 0.0)

    def of(self, rows: np.ndarray) -> Windows:
        """Some of them."""
        part = object.__new__(Windows)
        part.__dict__ = {k: v[rows] for k, v in self.__dict__.items()}
        return part


TOGETHER = 1 << 17  # samples of points that are scored at once


def best_points(windows: Windows, model: str, points: np.ndarray, relative: bool) -> tuple[np.ndarray, ...]:
    """(score, point, amplitude, offset, end, its place) of each window's best of points(window or one for all, point, parameter)."""
    step, out = max(1, TOGETHER // (points.shape[1] * windows.t.shape[1])), []
    for start in range(0, len(windows.t0), step):
        rows = np.arange(start, min(start + step, len(windows.t0)))
        own = points if len(points) == 1 else points[rows]
        score, *others = scored(windows.of(rows), model, own, relative)
        k, each = score.argmin(axis=1), np.arange(len(rows))
        out.append((score[each, k], own[0 if len(own) == 1 else each, k], *(c[each, k] for c in others), k))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def fit_windows(windows: list[tuple], grid: Grid, levels: int, jump: list[bool], relative: bool = True) -> list[tuple | None]:
    """For each window (t, y, t0, halfwidth) of an event a row of FIT, or None if no pulse fits. All are fitted side by side."""
    found: list[tuple | None] = [None] * len(windows)
    fit = [k for k, (t, y, _, hw) in enumerate(windows) if len(t) >= 4 and hw is not None and hw > 0 and np.isfinite(y).all()]
    fit.sort(key=lambda k: len(windows[k][0]))
    for start in range(0, len(fit), SIDE_BY_SIDE):  # of about one length
        places = fit[start : start + SIDE_BY_SIDE]
        for k, row in zip(places, _fit_together(Windows([windows[k] for k in places], [jump[k] for k in places]), grid, levels, relative), strict=True):
            found[k] = row
    return found


SIDE_BY_SIDE = 64  # windows


def _fit_together(w: Windows, grid: Grid, levels: int, relative: bool) -> list[tuple | None]:
    best = [None] * len(w.t0)
    for model in MODELS:
        every = grid.points(model)
        forms = list(dict.fromkeys(every[:, 2]))
        if not forms:
            continue
        starts = [best_points(w, model, every[every[:, 2] == form][None], relative) for form in forms]
        # one line for a window and a form, forms of a window following one another
        score, point, amplitude, offset, end, _ = (np.stack(c, axis=1).reshape(len(w.t0) * len(forms), *c[0].shape[1:]) for c in zip(*starts, strict=True))
        window = np.repeat(np.arange(len(w.t0)), len(forms))
        for level in range(1, levels):
            moving = np.flatnonzero(np.isfinite(score))
            for _ in range(MOVES):
                if not len(moving):
                    break
                new = best_points(w.of(window[moving]), model, finer(point[moving], level), relative)
                better = np.isfinite(new[0])
                for held, c in zip((score, point, amplitude, offset, end), new, strict=False):
                    held[moving[better]] = c[better]
                # what has no better point near it is done at this level; where nothing fits any more, the same would be found again
                moving = moving[better & (new[5] > 0)]
        for j in np.flatnonzero(np.isfinite(score)).tolist():
            k = int(window[j])
            if best[k] is None or score[j] < best[k][1]:
                best[k] = (model, float(score[j]), point[j].tolist(), float(amplitude[j]), float(offset[j]), float(end[j]))
    rows = []
    for k, found in enumerate(best):
        if found is None:
            rows.append(None)
            continue
        model, score_, (loc, width, form), a, first, last = found
        t0, hw = float(w.t0[k]), float(w.halfwidth[k])
        rows.append((model, t0 + loc * hw, width * hw, form, a, first, last, float(halfwidths(model, width * hw, form)), score_))
    return rows


def fit_window(t: np.ndarray, y: np.ndarray, t0: float, halfwidth: float, grid: Grid, levels: int, jump: bool = True, relative: bool = True) -> tuple | None:
    """A row of FIT for one event's window, or None if no pulse fits."""
    return fit_windows([(t, y, t0, halfwidth)], grid, levels, [jump], relative)[0]


def event_samples(events: DataFrame, samples: DataFrame, dt: float, keys: list[str], column: str, begin: float = 0.0) -> DataFrame:
    """keys, event_id, t0, halfwidth and rows, the samples (i, t, y) of each event's window; events without one are left out."""
    first = F.greatest(F.ceil((F.col("t0") - BEFORE * F.col("halfwidth") - begin) / dt), F.lit(0))
    last = F.ceil((F.col("t0") + AFTER * F.col("halfwidth") - begin) / dt) - 1
    kind = samples.schema["i"].dataType
    wanted = events.filter(first <= last).select(*keys, "event_id", "t0", "halfwidth", F.explode(F.sequence(first.cast(kind), last.cast(kind))).alias("i"))
    met = wanted.join(samples.select(*keys, "i", "t", F.col(column).cast("double").alias("y")), [*keys, "i"])
    return met.groupBy(*keys, "event_id", "t0", "halfwidth").agg(F.sort_array(F.collect_list(F.struct("i", "t", "y"))).alias("rows"))


def fit_event_shapes(events: DataFrame, samples: DataFrame, dt: float, keys=("roi",), column: str = "value", grid: Grid = Grid(), levels: int = 5, jump: bool = True, min_halfwidth: float = 0.0, z_th: float | None = None, begin: float = 0.0) -> DataFrame:
    """keys, event_id and FIT: the better of the two models, by mean squared distance over the fitted curve, for each event.

    events(keys, event_id, t0, halfwidth), samples(keys, i, t, value) with t = begin + i dt. A window lasts from
    BEFORE halfwidths before the start to AFTER behind it. Events go that no pulse of the grid fits, whose pulse is
    narrower than min_halfwidth, or, with z_th, whose window never is z_th deviations of its whole trace above
    zero. jump allows a background that rises or falls. Equal scores: gamma, then the first point of the grid.
    Null times or samples fit nothing; repeated rows of an event are one event; an empty table gives no row.
    """
    keys = list(keys)
    rows = event_samples(events, samples, dt, keys, column, begin)
    if z_th is not None:
        spread = samples.groupBy(*keys).agg((F.stddev_pop(column) * z_th).alias("least"))
        rows = rows.join(spread, keys).filter(F.array_max(F.transform("rows", lambda r: r["y"])) > F.col("least")).drop("least")
    own = [*keys, "event_id"]
    schema = T.StructType([*(rows.schema[c] for c in own), *T._parse_datatype_string(FIT).fields])
    kinds = [pa.string(), *[pa.float64()] * 8]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bounds, (time, values) = fl._columns(batch.column("rows"), ["t", "y"])
            found = []
            windows = [(time[a:b], values[a:b], t0, hw) for a, b, t0, hw in zip(bounds, bounds[1:], batch.column("t0").to_pylist(), batch.column("halfwidth").to_pylist(), strict=False)]
            for k, row in enumerate(fit_windows(windows, grid, levels, [jump] * len(windows))):
                if row and row[7] >= min_halfwidth:
                    found.append((k, row))
            origin = pa.array([k for k, _ in found], pa.int64())
            columns = list(zip(*(row for _, row in found), strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(origin) for c in own), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=schema.names)

    return rows.mapInArrow(run, schema)


def pursuit(t: np.ndarray, y: np.ndarray, samples: float, dt: float, z_th: float, rounds: int, least_drop: float, tolerance: float) -> Generator[tuple, tuple | None, list[tuple]]:
    """(round, explained, *row of FIT) of the pulses in one trace; yields (t, y, t0, halfwidth, jump) of a window and is sent its fit.

    A round seeks peaks in what is left, in units of its MAD around its median. A window is cut at the lowest
    sample towards the next peak on either side; where it is, the background may be sloped by the neighbour.
    The highest peak comes first, and those are passed over whose windows overlap a pulse of this round; a
    pulse stays if it takes least_drop of its window's squares away. It ends with the round that explains
    less than tolerance of what was left, whose pulses go.
    """
    left, found, before = y.copy(), [], float(y.var())
    for turn in range(rounds):
        spread = fl.MAD * float(np.median(np.abs(left - np.median(left)))) or float(left.std())
        if not spread or not np.isfinite(spread):
            break
        z = fl.running_average((left - np.median(left)) / spread, fl.smoothing(samples))
        peaks = fl.peak_events(z, z_th, 0.1 * samples, samples)
        tops = [p for p, _, _ in peaks]
        valleys = [0, *(p + int(np.argmin(z[p:q])) for p, q in zip(tops, tops[1:], strict=False)), len(t) - 1]
        taken, new, rest = [], [], left.copy()
        for j in sorted(range(len(peaks)), key=lambda j: -z[tops[j]]):
            t0, hw = peaks[j][1] * dt + t[0], (peaks[j][2] - peaks[j][1]) * dt
            whole = np.searchsorted(t, [t0 - BEFORE * hw, t0 + AFTER * hw]).tolist()
            a, b = max(whole[0], valleys[j]), min(whole[1], valleys[j + 1] + 1)
            if any(a < d and c < b for c, d in taken):
                continue
            row = yield t[a:b], left[a:b], t0, hw, [a, b] != whole
            if row is None:
                continue
            pulse = row[4] * shares(row[0], t, *row[1:4])
            old = float(((left[a:b] - left[a:b].mean()) ** 2).sum())
            after = left[a:b] - pulse[a:b]
            if float(((after - after.mean()) ** 2).sum()) > (1 - least_drop) * old:
                continue
            taken.append((a, b))
            new.append(row)
            rest -= pulse
        now = float(rest.var())
        if not new or 1 - now / before < tolerance:
            break
        found += [(turn, 1 - now / float(y.var()), *row) for row in new]
        left, before = rest, now
    return found


def pursued(traces: list[tuple[np.ndarray, np.ndarray]], grid: Grid, levels: int, **how) -> list[list[tuple]]:
    """The pulses of several traces (t, y) by ``pursuit``; their next windows are fitted side by side."""
    found: list[list[tuple]] = [[] for _ in traces]
    going = {k: pursuit(t, y, **how) for k, (t, y) in enumerate(traces)}
    rows: dict[int, tuple | None] = dict.fromkeys(going)
    while going:
        wanted = {}
        for k, pursued_ in list(going.items()):
            try:
                wanted[k] = pursued_.send(rows[k])
            except StopIteration as end:
                found[k] = end.value
                del going[k]
        rows = dict(zip(wanted, fit_windows([w[:4] for w in wanted.values()], grid, levels, [w[4] for w in wanted.values()], False), strict=True))
    return found


def greedy_pulse_fit(df: DataFrame, samples: float, dt: float, keys=("roi",), column: str = "value", z_th: float = 3.0, grid: Grid = Grid(gamma=()), levels: int = 5, rounds: int = 10, least_drop: float = 0.01, tolerance: float = 0.1) -> DataFrame:
    """keys, round, explained (the share of the variance that all pulses so far explain) and FIT of pulses that add up to a trace.

    All traces are pursued at once, each by one task (``pursuit``). chi2 is here the mean squared distance.
    """
    keys = list(keys)
    timed = (df if "t" in df.columns else df.withColumn("t", F.col("i") * dt)).withColumn("y", F.col(column).cast("double"))
    rows = fl.stretches(timed, keys, ["t", "y"], None)
    made = T._parse_datatype_string(f"round int, explained double, {FIT}").fields
    schema = T.StructType([*(rows.schema[c] for c in keys), *made])
    kinds = [pa.int32(), pa.float64(), pa.string(), *[pa.float64()] * 8]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in fl.portions(batches):
            bounds, (time, values) = fl._columns(batch.column("rows"), ["t", "y"])
            traces = [(time[a:b], values[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]
            each = pursued(traces, grid, levels, samples=samples, dt=dt, z_th=z_th, rounds=rounds, least_drop=least_drop, tolerance=tolerance)
            found = [(k, row) for k, rows_ in enumerate(each) for row in rows_]
            origin = pa.array([k for k, _ in found], pa.int64())
            columns = list(zip(*(row for _, row in found), strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(origin) for c in keys), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=schema.names)

    return rows.mapInArrow(run, schema)
