import numpy as np
import pytest

from tracemill.operators import frames as fr


def test_high_percentile_without_whole_time_courses(spark):
    """a pixel's values above the percentile are kept, not all of them; frames repeated, few or null."""
    r = np.random.default_rng(5)
    made = {("a", 0, 0): r.normal(size=300).round(1).tolist(), ("a", 0, 1): [None, *r.normal(size=299).tolist()], ("b", 0, 0): [3.0, 1.0, 2.0], ("b", 0, 1): [None] * 3}
    rows = [(rec, f, y, x, v) for (rec, y, x), vs in made.items() for f, v in enumerate(vs)]
    repeated = [(rec, f, y, x, v) for rec, f, y, x, v in rows if (rec, x) == ("a", 0)]
    px = spark.createDataFrame(rows + repeated, "recording string, frame int, y int, x int, value double")
    found = fr.stat_images(px)
    got = {(g.recording, g.y, g.x): g.highperc for g in found.collect()}
    for place, vs in made.items():
        held = sorted(v for v in vs * (1 + (place == ("a", 0, 0))) if v is not None)
        if not held:
            assert got[place] is None
            continue
        at = (len(held) - 1) * max(1 - 10 / len(vs), 0)
        k = int(at)
        assert got[place] == pytest.approx(held[k] + (held[min(k + 1, len(held) - 1)] - held[k]) * (at - k))
    assert "collect_list(value" not in found._jdf.queryExecution().optimizedPlan().toString()
