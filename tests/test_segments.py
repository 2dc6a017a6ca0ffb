"""Rois that fall apart are split; small rois merge as a plain loop over one image says."""

from collections import defaultdict

from tracemill.operators import rois, segments

W = rois.WIDTH


def tables(spark, cells, values):
    pixels = spark.createDataFrame([("first", n, y, x) for n, y, x in cells], "recording string, roi long, y int, x int")
    image = spark.createDataFrame([("first", y, x, v) for (y, x), v in values.items()], "recording string, y int, x int, value double")
    return pixels, image


def test_split_by_corners(spark):
    values = {(0, 0): 9.0, (0, 1): 5.0, (1, 2): 3.0, (2, 2): 4.0, (3, 3): 1.0}
    pixels, image = tables(spark, [(0, y, x) for y, x in values], values)
    got = {(r["roi"], r["y"], r["x"]) for r in segments.split_unconnected(pixels, image).collect()}
    assert got == {(0, 0, 0), (0, 0, 1), (2 * W + 2, 1, 2), (2 * W + 2, 2, 2), (3 * W + 3, 3, 3)}


def corners(cells):
    """Border nodes of a set of pixels, half a pixel up and left."""
    sides = defaultdict(int)
    for y, x in cells:
        for e in (("h", y, x), ("h", y + 1, x), ("v", y, x), ("v", y, x + 1)):
            sides[e] += 1
    edges = {e for e, n in sides.items() if n == 1}
    nodes = {n for s, y, x in edges for n in ((y, x), (y, x + 1) if s == "h" else (y + 1, x))}
    return edges, nodes


def merged_by_hand(cells, values, fraction, most, rounds=20):
    own = defaultdict(set)
    for n, y, x in cells:
        own[n].add((y, x))
    for _ in range(rounds):
        sizes = sorted(len(c) for c in own.values())
        k = (len(sizes) - 1) * fraction
        limit = sizes[int(k)] + (sizes[min(int(k) + 1, len(sizes) - 1)] - sizes[int(k)]) * (k - int(k))
        peak = {n: max(c, key=lambda p: (values[p], -p[0], -p[1])) for n, c in own.items()}
        ends = {n: corners(c) for n, c in own.items()}
        to = {}
        for n, c in own.items():
            if len(c) > limit:
                continue
            near = [m for m in own if m != n and ends[n][0] & ends[m][0] and min(((y - 0.5 - peak[n][0]) ** 2 + (x - 0.5 - peak[n][1]) ** 2) ** 0.5 for y, x in ends[m][1]) <= most]
            if near:
                to[n] = max(near, key=lambda m: (len(own[m]), -m))
        top = lambda n: values[peak[n]]
        to = {a: b for a, b in to.items() if to.get(b) != a or (top(a), a) < (top(b), b)}
        if not to:
            break
        groups = {n: {n} for n in own}
        for a, b in to.items():
            both = groups[a] | groups[b]
            for n in both:
                groups[n] = both
        after = defaultdict(set)
        for n, c in own.items():
            survivor = max((m for m in groups[n] if m not in to), key=lambda m: (top(m), -m))
            after[survivor] |= c
        own = after
    return {(n, y, x) for n, c in own.items() for y, x in c}


def test_merge_closest_equals_a_plain_loop(spark):
    import random

    rng = random.Random(5)
    values = {(y, x): float(rng.randrange(10_000)) for y in range(9) for x in range(9)}
    _, image = tables(spark, [(0, 0, 0)], values)
    found = [(r["roi"], r["y"], r["x"]) for r in rois.grow_basins(image).collect()]
    pixels, image = tables(spark, found, values)
    got = {(r["roi"], r["y"], r["x"]) for r in segments.merge_closest(pixels, image, 0.5, 1.5).collect()}
    assert got == merged_by_hand(found, values, 0.5, 1.5)
    assert len({n for n, _, _ in got}) < len({n for n, _, _ in found})
