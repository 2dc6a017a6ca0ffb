import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemill.operators import centres as ce
from tracemill.operators import volumes as vo

SCHEMA = "recording string, frame int, z int, y int, x int, value double"


def voxels(spark, made):
    return spark.createDataFrame([(rec, f, z, y, x, float(v)) for (rec, f), s in made.items() for (z, y, x), v in np.ndenumerate(s)], SCHEMA)


def scene(shift, shape=(9, 22, 22), seed=0):
    """Smooth blobs whose content has gone by shift."""
    r = np.random.default_rng(seed)
    blobs = [(r.uniform(1, shape[0] - 1), r.uniform(2, shape[1] - 2), r.uniform(2, shape[2] - 2), r.uniform(5, 20)) for _ in range(60)]
    z, y, x = np.indices(shape)
    return 10 + sum(a * np.exp(-((z - bz - shift[0]) ** 2 / 2 + ((y - by - shift[1]) ** 2 + (x - bx - shift[2]) ** 2) / 3)) for bz, by, bx, a in blobs)


def plain_shift(s, shift):
    out = np.zeros_like(s)
    for at in np.ndindex(s.shape):
        for k in range(8):
            w, place = 1.0, []
            for c, d, up in zip(at, shift, (k >> 2, k >> 1 & 1, k & 1), strict=True):
                w *= d - math.floor(d) if up else 1 - (d - math.floor(d))
                place.append(c + math.floor(d) + up)
            if all(0 <= p < n for p, n in zip(place, s.shape, strict=True)):
                out[at] += w * s[tuple(place)]
    return np.clip(out, s.min(), s.max())


def test_whole_and_half_voxels_against_a_plain_loop(spark):
    shifts = [(0, 0, 0), (1, -2, 0), (0.5, 0, 0), (-0.25, 0.5, 1.75), (9, 0, 0)]
    made = {("a", k): np.random.default_rng(k).normal(5, 2, (3, 4, 5)) for k in range(len(shifts))}
    moves = spark.createDataFrame([("a", k, *map(float, s)) for k, s in enumerate(shifts)], "recording string, frame int, dz double, dy double, dx double")
    got = {(r.frame, r.z, r.y, r.x): r.value for r in vo.apply_shifts_3d(voxels(spark, made), moves).collect()}
    assert len(got) == 60 * len(shifts)
    for k, s in enumerate(shifts):
        want = plain_shift(made["a", k], s)
        assert all(got[k, *at] == pytest.approx(v) for at, v in np.ndenumerate(want))


@pytest.mark.parametrize("mode", vo.MODES)
def test_planted_shifts(spark, mode):
    true = {"a": [(0, 0, 0), (0.5, 1, -1), (0, -0.4, -0.4), (-0.5, 0.6, 0.6)], "b": [(0, 0, 0), (0, 1, 0), (0, 2, 0)]}
    made = {(rec, k): scene(s, seed=len(rec)) for rec, own in true.items() for k, s in enumerate(own)}
    got = vo.estimate_shifts_3d(voxels(spark, made), mode, (2, 3, 3)).collect()
    assert len(got) == 7
    for rec, own in true.items():
        found = {r.frame: np.array([r.dz, r.dy, r.dx]) for r in got if r.recording == rec}
        for k, s in enumerate(own):  # one constant for all frames is free
            assert np.abs(found[k] - found[0] - (np.array(s) - np.array(own[0]))).max() < 0.5
    assert all(r.score is None if mode == "consecutive" else r.score > 0.6 for r in got)


def test_given_template_flat_frames_and_nothing(spark):
    made = {("a", 0): scene((0, 1, 0)), ("a", 1): np.full((9, 22, 22), 3.0)}
    template = voxels(spark, {("a", 0): scene((0, 0, 0))}).drop("frame")
    got = {r.frame: r for r in vo.template_shifts(voxels(spark, made), template, (2, 3, 3)).collect()}
    assert abs(got[0].dy - 1) < 0.1 and abs(got[0].dz) < 0.1 and (got[1].dz, got[1].dy, got[1].dx) == (0, 0, 0)
    none = voxels(spark, made).limit(0)
    assert vo.estimate_shifts_3d(none, most=(2, 3, 3)).collect() == []
    with pytest.raises(ValueError, match="mode"):
        vo.estimate_shifts_3d(none, "all")
    with pytest.raises(ValueError, match="no voxel"):
        vo.scores(np.zeros((4, 9, 9)), np.zeros((4, 9, 9)), (2, 3, 3))


def test_a_frame_is_moved_as_one_array(spark):
    """no row for a weight of a voxel; each of eight was shuffled. Voxels that are missing or null count as nothing."""
    s = np.random.default_rng(5).normal(5, 2, (3, 4, 5))
    full = voxels(spark, {("a", 0): s})
    moves = spark.createDataFrame([("a", 0, 0.5, -0.25, 1.0)], "recording string, frame int, dz double, dy double, dx double")
    moved = vo.apply_shifts_3d(full, moves)
    assert "place" not in moved.columns and "sum(" not in moved._jdf.queryExecution().executedPlan().toString()
    holes = full.filter("not (z = 1 and y = 2 and x = 3)").withColumn("value", F.when((F.col("z") != 2) | (F.col("y") != 1), F.col("value")))
    got = {(r.z, r.y, r.x): r.value for r in vo.apply_shifts_3d(holes, moves).collect()}
    left = s.copy()
    left[1, 2, 3] = left[2, 1, :] = 0
    known = [s[at] for at in np.ndindex(s.shape) if left[at] != 0]
    want = np.clip(vo.taken_back(left, (0.5, -0.25, 1.0)), min(known), max(known))
    assert len(got) == 59 and all(v == pytest.approx(want[at]) for at, v in got.items())


def test_blobs_are_the_centres(spark):
    blobs = {"a": [(20, 20), (50, 70)], "b": [(30, 30)]}
    rows = [(rec, y, x, sum(math.exp(-((y - a) ** 2 + (x - b) ** 2) / 40) for a, b in own) + 0.02) for rec, own in blobs.items() for y in range(80) for x in range(90)]
    rows += [("dark", 0, 0, 0.0), ("dark", 0, 1, -1.0)]
    image = spark.createDataFrame(rows, "recording string, y int, x int, value double")
    got = ce.interesting_centres(image, 150, 3.0, 12.0, seed=5).collect()
    assert {r.recording for r in got} == {"a", "b"}
    for rec, own in blobs.items():
        best = sorted((r for r in got if r.recording == rec), key=lambda r: -r.n)[: len(own)]
        assert sorted((round(r.y / 10), round(r.x / 10)) for r in best) == sorted((round(a / 10), round(b / 10)) for a, b in own)
    again = ce.drawn_pixels(image, 150, 3.0, seed=5)
    assert again.count() == 300 and sorted(map(tuple, again.collect())) == sorted(map(tuple, ce.drawn_pixels(image.repartition(3), 150, 3.0, seed=5).collect()))
    assert set(map(tuple, again.collect())) != set(map(tuple, ce.drawn_pixels(image, 150, 3.0, seed=6).collect()))
    assert ce.interesting_centres(image.limit(0)).collect() == []
