import numpy as np
import pytest

from tracemill.operators import frames as fr


@pytest.mark.parametrize("weights", [[0.25, 0.5, 0.25], [0.1, 0.2, 0.4, 0.2, 0.1]])
@pytest.mark.parametrize("high", [7, 0, None])
def test_blur_reads_its_pixels_once(spark, weights, high):
    """no union of parts that each work out the pixels again."""
    size = (7 if high is None else high) + 1
    values = np.random.default_rng(1).normal(size=(2, size))
    px = spark.createDataFrame([("a", 0, y, x, float(values[y, x])) for y in range(2) for x in range(size)], "recording string, frame int, y int, x int, value double")
    found = fr.blur(px, "x", weights, 0, high)
    half = len(weights) // 2
    want = {(y, x): sum(w * values[y, min(max(x + k - half, 0), size - 1)] for k, w in enumerate(weights)) for y in range(2) for x in range(size)}
    got = {(g.y, g.x): g.value for g in found.collect()}
    assert got == {k: pytest.approx(v) for k, v in want.items()}
    assert "Union" not in found._jdf.queryExecution().optimizedPlan().toString()
