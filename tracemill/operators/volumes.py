"""Shifts of stacks: voxels(recording, frame, z, y, x, value), places from 0; shifts(recording, frame, dz, dy, dx).

A shift is where a frame's content has gone; taking it back moves content by its negative. A frame, one
stack, is one array in a task while it is compared; whole movies never are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tracemill.functions.tables import discard, written

MODES = ["consecutive", "template", "consecutive+template"]
MOST = (2, 5, 5)
ROUNDS = 10
AXES = ["z", "y", "x"]


def taken_back(stack: np.ndarray, shift: tuple[float, float, float]) -> np.ndarray:
    """stack with its shift taken back: eight weights of the voxels around, nothing beyond the stack."""
    out = np.zeros(stack.shape)
    whole = [math.floor(d) for d in shift]
    for corner in np.ndindex(2, 2, 2):
        weight, here, there = 1.0, [], []
        for d, w, up, n in zip(shift, whole, corner, stack.shape, strict=True):
            weight *= d - w if up else 1 - (d - w)
            here.append(slice(min(max(0, -w - up), n), max(0, min(n, n - w - up))))
            there.append(slice(min(max(0, w + up), n), max(0, min(n, n + w + up))))
        out[tuple(here)] += weight * stack[tuple(there)]
    return out


def apply_shifts_3d(voxels: DataFrame, shifts: DataFrame) -> DataFrame:
    """Frames with their shift taken back: eight weights of the voxels around, nothing beyond the stack, clipped to the frame's own range.

    Frames without a shift go, and voxels without a place. A frame is moved as one array, so nothing is shuffled for a weight.
    """
    here = ["recording", "frame", *AXES]
    frames = voxels.dropna(subset=AXES).groupBy("recording", "frame").agg(F.collect_list(F.struct(*AXES, F.col("value").cast("double").alias("value"))).alias("s"))
    rows = frames.join(shifts.select("recording", "frame", *(F.col(f"d{a}").cast("double").alias(f"d{a}") for a in AXES)), ["recording", "frame"])
    schema = T.StructType([*(rows.schema[c] for c in ("recording", "frame", "s")), T.StructField("moved", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            moved = []
            for k, shift in enumerate(zip(*(batch.column(f"d{a}").to_pylist() for a in AXES), strict=True)):
                own = batch.column("s")[k].values
                at = tuple(own.field(a).to_numpy() for a in AXES)
                v = own.field("value").to_numpy(zero_copy_only=False)
                if None in shift or np.isnan(v).all():
                    moved.append([None] * len(v))
                    continue
                stack = np.zeros(tuple(int(p.max()) + 1 for p in at))
                stack[at] = np.where(np.isnan(v), 0.0, v)
                moved.append(np.clip(taken_back(stack, shift)[at], np.nanmin(v), np.nanmax(v)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in schema.names[:3]), pa.array(moved, pa.list_(pa.float64()))], names=schema.names)

    flat = rows.mapInArrow(run, schema).select("recording", "frame", F.explode(F.arrays_zip("s", "moved")).alias("p"))
    return flat.select("recording", "frame", *(F.col(f"p.s.{a}").alias(a) for a in AXES), F.col("p.moved").alias("value")).select(*here, "value")


def moved_stacks(whole: DataFrame, shifts: DataFrame) -> DataFrame:
    """As apply_shifts_3d, of stacks."""
    rows, names = whole.join(shifts.select("recording", "frame", *(f"d{a}" for a in AXES)), ["recording", "frame"]), whole.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, (*shape, dz, dy, dx) in enumerate(zip(*(batch.column(c).to_pylist() for c in (*(f"n{a}" for a in AXES), *(f"d{a}" for a in AXES))), strict=True)):
                v = batch.column("v")[k].values.to_numpy(zero_copy_only=False)
                out.append(np.clip(taken_back(v.reshape(shape), (dz, dy, dx)), v.min(), v.max()).ravel())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:-1]), pa.array(out, pa.list_(pa.float64()))], names=names)

    return rows.select(*names, *(f"d{a}" for a in AXES)).mapInArrow(run, whole.schema)


def scores(stack: np.ndarray, template: np.ndarray, most: tuple[int, int, int]) -> np.ndarray:
    """Correlation of the template without a margin of most with the stack at every offset up to most."""
    inner = template[tuple(slice(m, n - m) for m, n in zip(most, template.shape, strict=True))]
    if 0 in inner.shape:
        raise ValueError(f"a stack of {template.shape} has no voxel more than {most} from its sides")
    t = (inner - inner.mean()).ravel()
    norm = np.sqrt(t @ t)
    out = np.zeros(tuple(2 * m + 1 for m in most))
    for at in np.ndindex(out.shape):
        s = stack[tuple(slice(k, k + n) for k, n in zip(at, inner.shape, strict=True))].ravel()
        s = s - s.mean()
        spread = np.sqrt(s @ s) * norm
        out[at] = s @ t / spread if spread > 1e-12 else 0.0
    return out


def best_offset(found: np.ndarray, most: tuple[int, int, int]) -> tuple[float, float, float]:
    """The offset of the highest score, refined on each axis by the parabola through three logarithms where its top is
    within one voxel; no score above 0 is no shift. Of equal scores (to nine digits) the one nearest to none counts."""
    if found.max() <= 0:
        return 0.0, 0.0, 0.0
    level = np.round(found, 9)
    top = min(np.argwhere(level == level.max()).tolist(), key=lambda at: (sum(abs(k - m) for k, m in zip(at, most, strict=True)), at))
    at = [min(max(k, 1), 2 * m - 1) if m else 0 for k, m in zip(top, most, strict=True)]
    logs, out = np.log(1e-10 + np.maximum(found, 0)), []
    for axis, (k, m) in enumerate(zip(at, most, strict=True)):
        place = float(k)
        if m:
            a, b, c = (logs[tuple([*at[:axis], k + d, *at[axis + 1 :]])] for d in (-1, 0, 1))
            bend = (a + c - 2 * b) / 2
            if abs(bend) >= 1e-10 and abs((c - a) / (4 * bend)) < 1:
                place = k - (c - a) / (4 * bend)
        out.append(float(np.clip(place - m, -m - 0.5, m + 0.5)))
    return tuple(out)


def stacks(voxels: DataFrame) -> DataFrame:
    """A row a frame: size of each axis and its values in the order of (z, y, x). Frames need every voxel."""
    rows = voxels.groupBy("recording", "frame").agg(*(F.max(a).cast("int").alias(f"n{a}") for a in AXES), F.sort_array(F.collect_list(F.struct(*AXES, F.col("value").cast("double").alias("value")))).alias("s"))
    return rows.select("recording", "frame", *((F.col(f"n{a}") + 1).alias(f"n{a}") for a in AXES), F.transform("s", lambda s: s["value"]).alias("v"))


def offsets(pairs: DataFrame, most: tuple[int, int, int]) -> DataFrame:
    """recording, frame, dz, dy, dx of pairs(recording, frame, nz, ny, nx, v, t): where the stack v has t's content."""
    kind = pairs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, shape in enumerate(zip(*(batch.column(f"n{a}").to_pylist() for a in AXES), strict=True)):
                v, t = (batch.column(c)[k].values.to_numpy(zero_copy_only=False).reshape(shape) for c in ("v", "t"))
                out.append(best_offset(scores(v, t, most), most))
            columns = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([batch.column("recording"), batch.column("frame"), *(pa.array(c, pa.float64()) for c in columns)], names=["recording", "frame", "dz", "dy", "dx"])

    return pairs.mapInArrow(run, f"recording {kind['recording'].dataType.simpleString()}, frame {kind['frame'].dataType.simpleString()}, dz double, dy double, dx double")


def consecutive_shifts(whole: DataFrame, most: tuple[int, int, int] = MOST) -> DataFrame:
    """Offsets of each of the stacks against the one before, added up, around their median over the recording's frames."""
    order = Window.partitionBy("recording").orderBy("frame")
    before = whole.select("recording", "frame").withColumn("last", F.lag("frame").over(order)).filter("last is not null")
    earlier = whole.select("recording", F.col("frame").alias("last"), F.col("v").alias("t"))
    steps = written(offsets(whole.join(before, ["recording", "frame"]).join(earlier, ["recording", "last"]), most), "steps")
    every = whole.select("recording", "frame").join(steps, ["recording", "frame"], "left").fillna(0.0, ["dz", "dy", "dx"])
    sums = every.select("recording", "frame", *(F.sum(f"d{a}").over(order).alias(f"d{a}") for a in AXES))
    middle = sums.groupBy("recording").agg(*(F.percentile(f"d{a}", F.lit(0.5)).alias(f"m{a}") for a in AXES))
    return sums.join(middle, "recording").select("recording", "frame", *((F.col(f"d{a}") - F.col(f"m{a}")).alias(f"d{a}") for a in AXES))


def medoids(whole: DataFrame) -> DataFrame:
    """recording, t: of each recording the stack of the least absolute distance to the median stack, as a written table.

    A recording's stacks have one shape. Medians are a row a voxel of a recording, however many frames it has.
    """
    each = whole.select("recording", F.posexplode("v").alias("p", "value")).groupBy("recording", "p").agg(F.percentile("value", F.lit(0.5)).alias("m"))
    middle = written(each.groupBy("recording").agg(F.transform(F.sort_array(F.collect_list(F.struct("p", "m"))), lambda s: s["m"]).alias("m")), "middle")
    off = F.aggregate(F.zip_with("v", "m", lambda v, m: F.abs(v - m)), F.lit(0.0), lambda acc, d: acc + d)
    far = whole.join(middle, "recording").select("recording", "frame", F.round(off, 9).alias("far"))
    best = far.groupBy("recording").agg(F.min(F.struct("far", "frame")).alias("b")).select("recording", "b.frame")
    found = written(whole.join(best, ["recording", "frame"]).select("recording", F.col("v").alias("t")), "templates")
    discard(middle)
    return found


def templates(whole: DataFrame, template: DataFrame | None) -> DataFrame:
    """recording, t: the given template(recording, z, y, x, value) as stacks, or the medoids."""
    return medoids(whole) if template is None else stacks(template.withColumn("frame", F.lit(0))).select("recording", F.col("v").alias("t"))


def template_shifts(voxels: DataFrame, template: DataFrame | None = None, most: tuple[int, int, int] = MOST) -> DataFrame:
    """Offsets of each frame against template(recording, z, y, x, value), the medoid frame where none is given."""
    whole = written(stacks(voxels), "stacks")
    return offsets(whole.join(templates(whole, template), "recording"), most)


def likeness(pairs: DataFrame) -> DataFrame:
    """recording, frame, score: the correlation of v and t of pairs, null where one of them does not vary."""
    kind = pairs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                v, t = (batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in ("v", "t"))
                level = v.min() == v.max() or t.min() == t.max()
                out.append(None if level else float(((v - v.mean()) * (t - t.mean())).mean() / (v.std() * t.std())))
            yield pa.RecordBatch.from_arrays([batch.column("recording"), batch.column("frame"), pa.array(out, pa.float64())], names=["recording", "frame", "score"])

    return pairs.mapInArrow(run, T.StructType([kind["recording"], kind["frame"], T.StructField("score", T.DoubleType())]))


def estimate_shifts_3d(voxels: DataFrame, mode: str = "consecutive+template", most: tuple[int, int, int] = MOST, template: DataFrame | None = None) -> DataFrame:
    """shifts of every frame, and score, the correlation of the corrected frame with its recording's template (null in mode "consecutive").

    "consecutive" adds up the offsets of neighbours; "template" compares with the template, takes back what
    it finds and goes on, at most ROUNDS times, until all offsets are below most; the other mode does one
    after the other. A null recording is none: its frames go. An empty table gives no row.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    whole = written(stacks(voxels), "stacks")
    none = whole.select("recording", "frame", *(F.lit(0.0).alias(f"d{a}") for a in AXES))
    total = written(consecutive_shifts(whole, most) if "consecutive" in mode else none, "shifts")
    if mode == "consecutive":
        return total.withColumn("score", F.lit(None).cast("double"))
    now = written(moved_stacks(whole, total) if "consecutive" in mode else whole, "moved")
    for _ in range(ROUNDS):
        step = written(offsets(now.join(templates(now, template), "recording"), most), "step")
        added = total.join(step.select("recording", "frame", *(F.col(f"d{a}").alias(f"s{a}") for a in AXES)), ["recording", "frame"], "left")
        last, total = total, written(added.select("recording", "frame", *((F.col(f"d{a}") + F.coalesce(f"s{a}", F.lit(0.0))).alias(f"d{a}") for a in AXES)), "shifts")
        discard(last)
        far = step.agg(*(F.max(F.abs(f"d{a}")).alias(a) for a in AXES)).first()
        if all(m == 0 or far[a] is None or far[a] < m for a, m in zip(AXES, most, strict=True)):
            break
        last, now = now, written(moved_stacks(now, step), "moved")
        discard(last)
    discard(now)
    corrected = written(moved_stacks(whole, total), "corrected")
    discard(whole)
    found = likeness(corrected.join(templates(corrected, template), "recording"))
    return total.join(found, ["recording", "frame"], "left")
