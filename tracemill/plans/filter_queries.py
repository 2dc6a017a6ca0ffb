"""Queries of the filters on weekly supplier volumes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.functions.numbers import tidy
from tracemill.operators import events as ev_
from tracemill.operators import filters as fl
from tracemill.plans.registry import query
from tracemill.plans.trace_queries import r
from tracemill.sources import bindings as b

N = 6
SMOOTH = 3


#: Events are sought in volumes lifted by this much: in weeks without any the slow part is about nothing, and no ratio to it has digits to compare.
LIFT = 100.0
LIFTED = f"lt AS (SELECT roi, i, t, value + {LIFT} AS value FROM tr)"


def low(name: str, source: str, column: str, n: int = N, mirror: bool = False) -> str:
    """Table name(roi, i, slow): source's column through the kernel of n samples a timescale."""
    w = fl.kernel(n)
    p = len(w) // 2
    if mirror:
        left, right = f"v[least(j, {n}, len(v))]", f"v[len(v) + 1 - least(j, {n}, len(v))]"
    else:
        left, right = "2 * v[1] - v[least(j, len(v) - 1) + 1]", "2 * v[len(v)] - v[greatest(len(v) - 1 - j, 0) + 1]"
    pad = f"list_concat(list_transform(generate_series({p}, 1, -1), lambda j: {left}), v, list_transform(generate_series(1, {p}), lambda j: {right}))"
    return f"""{name}_v AS MATERIALIZED (SELECT roi, list({column} ORDER BY i) AS v FROM {source} GROUP BY roi), {name}_p AS MATERIALIZED (SELECT roi, len(v) AS n, {pad} AS p FROM {name}_v),
{name} AS MATERIALIZED (SELECT roi, CAST(k AS INTEGER) AS i, list_inner_product(p[k + 1:k + {len(w)}], {w}::DOUBLE[]) AS slow FROM (SELECT roi, p, unnest(generate_series(0, n - 1)) AS k FROM {name}_p))"""


def between(value: str, source: str) -> str:
    """The nearest free samples before and after, and their values, of source with a column free."""
    before, after = "PARTITION BY roi ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW", "PARTITION BY roi ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"
    return f"SELECT *, last_value(CASE WHEN free THEN i END IGNORE NULLS) OVER a AS ai, last_value(CASE WHEN free THEN {value} END IGNORE NULLS) OVER a AS sa, first_value(CASE WHEN free THEN i END IGNORE NULLS) OVER z AS bi, first_value(CASE WHEN free THEN {value} END IGNORE NULLS) OVER z AS sb FROM {source} WINDOW a AS ({before}), z AS ({after})"


def one_pass(n: int = N, x: str = "", source: str = "tr") -> str:
    """Table ff(roi, i, t, value, slow, fast, z) after one pass; names end in x. Masks are not widened at under 30 samples."""
    return low(f"s0{x}", source, "value", n) + f""",
ma{x} AS (SELECT tr.roi, tr.i, value, slow, CASE WHEN (value - slow) / sqrt(greatest(slow, 3.0)) > 2 THEN 1 ELSE 0 END AS m FROM {source} AS tr JOIN s0{x} USING (roi, i)),
fe{x} AS (SELECT *, m = 0 OR row_number() OVER (PARTITION BY roi ORDER BY i) <= 2 OR row_number() OVER (PARTITION BY roi ORDER BY i DESC) <= 2 AS free FROM ma{x}),
ab{x} AS ({between("slow", f"fe{x}")}),
cn{x} AS (SELECT roi, i, value, CASE WHEN free THEN value ELSE sa + (sb - sa) * (i - ai) / nullif(bi - ai, 0) END AS clean FROM ab{x}),
""" + low(f"s1{x}", f"cn{x}", "clean", n) + f""",
ff{x} AS MATERIALIZED (SELECT tr.roi, tr.i, t, value, slow, value - slow AS fast, (value - slow) / sqrt(greatest(slow, 3.0)) AS z FROM {source} AS tr JOIN s1{x} USING (roi, i))"""


PASS = one_pass()

#: Mirrored ends, a mask of a fifth of the timescale (3 samples of 15), bridged by the trace.
LINES_N = 15
LINES = low("s0", "tr", "value", LINES_N, True) + f""",
ma AS (SELECT tr.roi, tr.i, value, slow, CASE WHEN value - slow > 2 * sqrt(greatest(slow * 0.5 + 1, 0)) THEN 1 ELSE 0 END AS m FROM tr JOIN s0 USING (roi, i)),
fe AS (SELECT *, max(m) OVER (PARTITION BY roi ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) = 0 AS free FROM ma),
ab AS ({between("value", "fe")}),
cn AS (SELECT roi, i, value, CASE WHEN free OR (ai IS NULL AND bi IS NULL) THEN value WHEN ai IS NULL THEN sb WHEN bi IS NULL THEN sa ELSE sa + (sb - sa) * (i - ai) / (bi - ai) END AS clean FROM ab),
""" + low("s1", "cn", "clean", LINES_N, True) + """,
ff AS MATERIALIZED (SELECT tr.roi, tr.i, value, slow, value - slow AS fast, (value - slow) / sqrt(slow * 0.5 + 1) AS z FROM tr JOIN s1 USING (roi, i))"""


def peaks(n: int = N, x: str = "", scale: str = "1.0", z_th: float = 3.0) -> str:
    """Table xx of events of ffx, whose z is divided by scale: p, zp and the ends x0 and x1 in samples; sm has the smoothed samples."""
    three = lambda c: f"(coalesce(lag({c}) OVER w, {c}) + {c} + coalesce(lead({c}) OVER w, {c})) / 3"
    return f"""sm{x} AS MATERIALIZED (SELECT roi, i, t, slow, {three("fast")} AS fast, {three(f"(z / {scale})")} AS z FROM ff{x} WINDOW w AS (PARTITION BY roi ORDER BY i)),
ru{x} AS (SELECT roi, run, any_value(z) AS z, (min(i) + max(i)) // 2 AS p FROM (SELECT *, sum(new) OVER (PARTITION BY roi ORDER BY i) AS run FROM (SELECT *, CASE WHEN z = lag(z) OVER (PARTITION BY roi ORDER BY i) THEN 0 ELSE 1 END AS new FROM sm{x})) GROUP BY roi, run),
pk{x} AS (SELECT roi, p, z AS zp FROM (SELECT *, lag(z) OVER (PARTITION BY roi ORDER BY run) AS b, lead(z) OVER (PARTITION BY roi ORDER BY run) AS a FROM ru{x}) WHERE z >= {z_th} AND z > b AND z > a),
bo{x} AS (SELECT pk{x}.*, s.i AS j, s.z AS zj, max(CASE WHEN s.i < p AND s.z > zp THEN s.i END) OVER w AS lo, min(CASE WHEN s.i > p AND s.z > zp THEN s.i END) OVER w AS hi FROM pk{x} JOIN sm{x} s ON s.roi = pk{x}.roi WINDOW w AS (PARTITION BY pk{x}.roi, p)),
ha{x} AS (SELECT *, zp - (zp - greatest(coalesce(min(CASE WHEN j < p THEN zj END) OVER w, zp), coalesce(min(CASE WHEN j > p THEN zj END) OVER w, zp))) * 0.5 AS half FROM bo{x} WHERE (lo IS NULL OR j > lo) AND (hi IS NULL OR j < hi) WINDOW w AS (PARTITION BY roi, p)),
en{x} AS (SELECT roi, p, zp, half, max(CASE WHEN j < p AND zj <= half THEN j END) AS lj, min(CASE WHEN j > p AND zj <= half THEN j END) AS rj FROM ha{x} GROUP BY 1, 2, 3, 4),
xx{x} AS (SELECT * FROM (SELECT en{x}.*, lj + (half - l0.z) / (l1.z - l0.z) AS x0, rj - (half - r0.z) / (r1.z - r0.z) AS x1 FROM en{x} JOIN sm{x} l0 ON l0.roi = en{x}.roi AND l0.i = lj JOIN sm{x} l1 ON l1.roi = en{x}.roi AND l1.i = lj + 1 JOIN sm{x} r0 ON r0.roi = en{x}.roi AND r0.i = rj JOIN sm{x} r1 ON r1.roi = en{x}.roi AND r1.i = rj - 1) WHERE x1 - x0 BETWEEN 0.1 * {n} AND {n}),
au{x} AS (SELECT xx{x}.roi, p, any_value(zp) AS zp, any_value(x0) AS x0, any_value(x1) AS x1, max(CASE WHEN s.i = p THEN s.fast / s.slow END) AS height, sum(s.fast / s.slow) * 7 AS auc, count(*) AS n_samples, min(s.t) AS first_time, sum(s.fast + s.slow) AS total FROM xx{x} JOIN sm{x} s ON s.roi = xx{x}.roi AND s.i >= floor(x0) AND s.i < floor(x1 + 2) GROUP BY xx{x}.roi, p)"""


EVENT_SQL = f"p * 7.0::DOUBLE AS peakpoint, {r('zp')} AS z_max, round(x0 * 7, 3) + 0.0 AS t0, round((x1 - x0) * 7, 3) + 0.0 AS halfwidth, {r('height')} AS height, {r('auc')} AS auc, n_samples, first_time, round(total, 3) + 0.0 AS total"


def event_columns(found):
    total = F.aggregate("trace", F.lit(0.0), lambda acc, x: acc + x)
    return [
        "roi", "peakpoint", tidy("z_max").alias("z_max"), tidy("t0", 3).alias("t0"), tidy("halfwidth", 3).alias("halfwidth"), tidy("height").alias("height"), tidy("auc").alias("auc"),
        F.size("trace").cast("long").alias("n_samples"), F.element_at("time", 1).alias("first_time"), tidy(total, 3).alias("total"),
    ]


def lifted(spark, sf_dir):
    return b.traces_week(spark, sf_dir).withColumn("value", F.col("value") + LIFT)


@query("t4_lowpass", b.sql("week", then=low("s0", "tr", "value")) + f"SELECT roi, i, {r('slow')} AS slow FROM s0")
def t4(spark, sf_dir):
    return fl.lowpass(b.traces_week(spark, sf_dir), N).select("roi", "i", tidy("slow").alias("slow"))


@query("t7_fast_filter", b.sql("week", then=PASS) + f"SELECT roi, i, {r('slow')} AS slow, {r('fast')} AS fast, {r('z')} AS z FROM ff")
def t7(spark, sf_dir):
    return fl.fast_filter(b.traces_week(spark, sf_dir), N, 2.0, 1).select("roi", "i", tidy("slow").alias("slow"), tidy("fast").alias("fast"), tidy("z").alias("z"))


@query("t8_fast_filter_lines", b.sql("week", then=LINES) + f"SELECT roi, i, {r('slow')} AS slow, {r('fast')} AS fast, {r('z')} AS z FROM ff")
def t8(spark, sf_dir):
    found = fl.fast_filter_lines(b.traces_week(spark, sf_dir), LINES_N, 0.5, 2.0, 1)
    return found.select("roi", "i", tidy("slow").alias("slow"), tidy("fast").alias("fast"), tidy("z").alias("z"))


@query("e2_detect_events", b.sql("week", then=f"{LIFTED},\n{one_pass(source='lt')},\n{peaks()}") + f"SELECT roi, {EVENT_SQL} FROM au")
def e2(spark, sf_dir):
    found = fl.detect_events(fl.fast_filter(lifted(spark, sf_dir), N, 2.0, 1), N, 7.0, smooth=SMOOTH)
    return found.select(*event_columns(found))


SCALES = [4, 6, 8]
EACH = ",\n".join(f"{one_pass(n, f'_{n}', 'lt')},\nsc_{n} AS (SELECT median(s) AS s FROM (SELECT stddev_pop(z) AS s FROM ff_{n} GROUP BY roi)),\n{peaks(n, f'_{n}', f'(SELECT s FROM sc_{n})', 1.5)}" for n in SCALES)
ALL = " UNION ALL ".join(f"SELECT CAST({k} AS INTEGER) AS its, {7.0 * n}::DOUBLE AS ts, * FROM au_{n}" for k, n in enumerate(SCALES))


@query("e3_candidate_events", b.sql("week", then=f"{LIFTED},\n{EACH},\nev AS ({ALL})") + f"SELECT row_number() OVER (ORDER BY its, roi, x0, p) - 1 AS event_id, its, ts, roi, {EVENT_SQL} FROM ev")
def e3(spark, sf_dir):
    found = fl.candidate_events(lifted(spark, sf_dir), 7.0, [7.0 * n for n in SCALES], 2.0, 1, 1.5, smooth=SMOOTH)
    return found.select("event_id", "its", "ts", *event_columns(found))


#: Windows of the candidates in the trace and in the slow part of their own timescale, then components.
SLOWS = " UNION ALL ".join(f"SELECT CAST({k} AS INTEGER) AS its, roi, i, value, slow FROM ff_{n}" for k, n in enumerate(SCALES))
HEIGHTS = f"""ca AS (SELECT row_number() OVER (ORDER BY its, roi, x0, p) - 1 AS event_id, its, roi, x0 * 7 AS t0, x1 * 7 AS tend, (x1 - x0) * 7 AS halfwidth, height FROM ev),
sl AS MATERIALIZED ({SLOWS}),
wi AS (SELECT event_id, i, value, slow, count(*) OVER w AS n, row_number() OVER (w ORDER BY i) AS k FROM ca JOIN sl ON sl.roi = ca.roi AND sl.its = ca.its AND i BETWEEN greatest(ceil(t0 / 7) - 1, 0) AND ceil((t0 + halfwidth) / 7) WINDOW w AS (PARTITION BY event_id)),
en AS (SELECT event_id, any_value(n) AS n, max(CASE WHEN k = 1 THEN slow END) AS s1, max(CASE WHEN k = n THEN slow END) AS s9, (max(CASE WHEN k = n THEN slow END) - max(CASE WHEN k = n - 1 THEN slow END) - max(CASE WHEN k = 2 THEN slow END) + max(CASE WHEN k = 1 THEN slow END)) / (any_value(n) - 2) AS bs, (max(CASE WHEN k = n THEN value END) - max(CASE WHEN k = n - 1 THEN value END) - max(CASE WHEN k = 2 THEN value END) + max(CASE WHEN k = 1 THEN value END)) / (any_value(n) - 2) AS bt FROM wi WHERE n >= 3 GROUP BY event_id),
ov AS (SELECT en.event_id, any_value(en.n) AS n, any_value(bs) AS bs, any_value(bt) AS bt, any_value(s1 + s9) / 2 AS middle, quantile_cont(value - s1 - (k - 1) * (s9 - s1) / (en.n - 1), 0.95) AS over FROM en JOIN wi USING (event_id) GROUP BY en.event_id),
ju AS (SELECT ca.*, CASE WHEN n IS NULL THEN 'too short' WHEN n > 20 AND bs > 0.1 AND bs > -0.5 * bt THEN 'spurious' WHEN over / nullif(middle, 0) < {ev_.BELOW} THEN 'too steep' ELSE 'ok' END AS status FROM ca LEFT JOIN ov USING (event_id)),
lk AS (SELECT a.event_id AS a, c.event_id AS b FROM ju a JOIN ju c ON a.roi = c.roi AND abs(a.t0 - c.t0) < 0.33 * a.halfwidth AND abs(a.tend - c.tend) < 0.33 * a.halfwidth WHERE a.status = 'ok'),
un AS (SELECT a, b FROM lk UNION SELECT b, a FROM lk),
cc(node, root) AS (SELECT a, a FROM un UNION SELECT un.b, cc.root FROM cc JOIN un ON un.a = cc.node),
ro AS (SELECT node, min(root) AS root FROM cc GROUP BY node)"""


@query("e8_distill_by_height", b.sql("week", then=f"{LIFTED},\n{EACH},\nev AS ({ALL}),\n{HEIGHTS}") + f"SELECT root, roi, its, clique_size, {r('t0')} AS t0, {r('halfwidth')} AS halfwidth, {r('height')} AS height FROM (SELECT *, count(*) OVER (PARTITION BY root) AS clique_size FROM ju JOIN ro ON event_id = node QUALIFY row_number() OVER (PARTITION BY root ORDER BY height DESC, event_id) = 1)".replace("SELECT root, roi", "SELECT event_id, roi"))
def e8(spark, sf_dir):
    given = lifted(spark, sf_dir)
    found = fl.candidate_events(given, 7.0, [7.0 * n for n in SCALES], 2.0, 1, 1.5, smooth=SMOOTH)
    events = found.select("event_id", "its", "roi", "t0", (F.col("t0") + F.col("halfwidth")).alias("tend"), "halfwidth", "height")
    slows = None
    for its, n in enumerate(SCALES):
        own = fl.fast_filter(given, n, 2.0, 1).select("roi", F.lit(its).alias("its"), "i", "value", "slow")
        slows = own if slows is None else slows.unionByName(own)
    best = ev_.distill_by_height(events, slows, 7.0)
    return best.select("event_id", "roi", "its", "clique_size", tidy("t0").alias("t0"), tidy("halfwidth").alias("halfwidth"), tidy("height").alias("height"))
