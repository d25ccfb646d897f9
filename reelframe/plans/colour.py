"""Queries over pixels and grades."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import colour
from ..operators import grading as ops
from ..sinks import interchange
from ..sources.views import FRAME_SIDE, FRAMES_SQL, PIXELS_SQL, frames, pixels, read
from .registry import query

REFERENCE = "NO"


def _lin(c: str) -> str:
    return f"CASE WHEN {c} <= 0.04045::DOUBLE THEN {c} / 12.92::DOUBLE ELSE pow(({c} + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END"


def _f(c: str) -> str:
    return f"CASE WHEN {c} > 216.0::DOUBLE / 24389.0::DOUBLE THEN cbrt({c}) ELSE ({24389.0 / 27.0!r}::DOUBLE * {c} + 16.0::DOUBLE) / 116.0::DOUBLE END"


def lab_sql(source: str, keep: str) -> str:
    m, w = colour.RGB_TO_XYZ, colour.WHITE
    xyz = ", ".join(f"(lr * {r[0]!r}::DOUBLE + lg * {r[1]!r}::DOUBLE + lb * {r[2]!r}::DOUBLE) / {v!r}::DOUBLE AS {n}" for r, v, n in zip(m, w, ("qx", "qy", "qz"), strict=True))
    return f"""lin AS (SELECT {keep}, {_lin('r')} AS lr, {_lin('g')} AS lg, {_lin('b')} AS lb FROM {source}), xyz AS (SELECT {keep}, {xyz} FROM lin),
    ff AS (SELECT {keep}, {_f('qx')} AS fx, {_f('qy')} AS fy, {_f('qz')} AS fz FROM xyz),
    lab AS (SELECT {keep}, 116.0::DOUBLE * fy - 16.0::DOUBLE AS light, 500.0::DOUBLE * (fx - fy) AS a, 200.0::DOUBLE * (fy - fz) AS b_ FROM ff)"""


_L = f"WITH {PIXELS_SQL}, {lab_sql('pixels', 'frame, r, g, b')}"
_STATS = _L + """, st AS (SELECT frame, avg(light) AS ml, stddev_pop(light) AS sl, avg(a) AS ma, stddev_pop(a) AS sa, avg(b_) AS mb, stddev_pop(b_) AS sb FROM lab GROUP BY frame),
    ref AS (SELECT ml AS rml, sl AS rsl, ma AS rma, sa AS rsa, mb AS rmb, sb AS rsb FROM st WHERE frame = 'NO'),
    matched AS (SELECT lab.*, st.* EXCLUDE (frame), ref.*, (light - ml) * (rsl / CASE WHEN sl < 1e-6 THEN 1.0 ELSE sl END) + rml AS tl, (a - ma) * (rsa / CASE WHEN sa < 1e-6 THEN 1.0 ELSE sa END) + rma AS ta, (b_ - mb) * (rsb / CASE WHEN sb < 1e-6 THEN 1.0 ELSE sb END) + rmb AS tb FROM lab JOIN st USING (frame), ref)"""


def _lab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.with_lab(pixels(spark, sf_dir))


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = _lab(spark, sf_dir)
    st = ops.stats(lab, "frame")
    return ops.reinhard(lab, st, st.where(F.col("frame") == REFERENCE), "frame")


def _rounded(df: DataFrame, keys: list[str], cols: list[str], n: int = 4) -> DataFrame:
    return df.select(*keys, *((F.round(F.col(c), n) + F.lit(0.0)).alias(c) for c in cols))


@query(_L + " SELECT frame, CAST(count(*) AS BIGINT) AS n, round(light, 4) + 0.0::DOUBLE AS light, round(a, 4) + 0.0::DOUBLE AS a, round(b_, 4) + 0.0::DOUBLE AS b_ FROM lab GROUP BY ALL")
def srgb_to_lab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_lab(spark, sf_dir), ["frame"], ["light", "a", "b_"]).groupBy("frame", "light", "a", "b_").agg(F.count(F.lit(1)).alias("n"))


@query(_STATS + " SELECT frame, round(ml, 5) AS mean_light, round(sl, 5) AS std_light, round(ma, 5) AS mean_a, round(sa, 5) AS std_a, round(mb, 5) AS mean_b_, round(sb, 5) AS std_b_ FROM st")
def lab_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    st = ops.stats(_lab(spark, sf_dir), "frame")
    return _rounded(st, ["frame"], [c for c in st.columns if c != "frame"], 5)


@query(_STATS + " SELECT frame, round(avg(tl), 4) AS light, round(avg(ta), 4) AS a, round(avg(tb), 4) AS b_, round(stddev_pop(tl), 4) AS spread FROM matched GROUP BY frame")
def reinhard_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _matched(spark, sf_dir).groupBy("frame").agg(F.avg("to_light").alias("light"), F.avg("to_a").alias("a"), F.avg("to_b_").alias("b_"), F.stddev_pop("to_light").alias("spread"))
    return _rounded(m, ["frame"], ["light", "a", "b_", "spread"])


@query(_STATS + """, d AS (SELECT frame, sqrt((ml - rml) * (ml - rml) + (ma - rma) * (ma - rma) + (mb - rmb) * (mb - rmb)) AS before FROM st, ref),
    h AS (SELECT frame, 0.5::DOUBLE * before AS after, before FROM d) SELECT frame, round(before, 5) AS before, round(after, 5) AS after, round(CASE WHEN before > 1e-6 THEN 1.0::DOUBLE - after / before ELSE 0.0::DOUBLE END, 5) AS shrink FROM h""")
def delta_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of the means before and after a match at half strength."""
    lab = _lab(spark, sf_dir)
    st = ops.stats(lab, "frame")
    ref = st.where(F.col("frame") == REFERENCE)
    means = st.select("frame", F.col("mean_light").alias("light"), F.col("mean_a").alias("a"), F.col("mean_b_").alias("b_"))
    m = ops.reinhard(means, st, ref, "frame", 0.5)
    target = [F.col("r_mean_" + c) for c in ("light", "a", "b_")]
    before, after = colour.delta_e([F.col(c) for c in ("light", "a", "b_")], target), colour.delta_e([F.col("to_" + c) for c in ("light", "a", "b_")], target)
    return _rounded(m.withColumns({"before": before, "after": after, "shrink": ops.shrink(before, after)}), ["frame"], ["before", "after", "shrink"], 5)


_Q = ", ".join(repr(i / 255) for i in range(256))


@query(_L + f", q AS (SELECT frame, quantile_cont(light, [{_Q}]) AS v FROM lab GROUP BY frame) SELECT frame, CAST(generate_subscripts(v, 1) - 1 AS INTEGER) AS q, round(unnest(v), 5) AS value FROM q")
def quantile_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ops.quantile_curve(_lab(spark, sf_dir), "frame"), ["frame", "q"], ["value"], 5)


@query(_L + f""", qs AS (SELECT frame, quantile_cont(light, [{_Q}]) AS v FROM lab GROUP BY frame), q AS (SELECT frame, generate_subscripts(v, 1) - 1 AS q, unnest(v) AS value FROM qs),
    pads AS (SELECT frame, d AS k, q.value FROM q, generate_series(-4, 259) AS g(d) WHERE q.q = least(255, greatest(0, d))), s AS (SELECT frame, k, avg(value) OVER (PARTITION BY frame ORDER BY k ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS smooth FROM pads)
    SELECT frame, CAST(k AS INTEGER) AS q, round(smooth, 5) AS smooth FROM s WHERE k BETWEEN 0 AND 255""")
def moving_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ops.moving_average(ops.quantile_curve(_lab(spark, sf_dir), "frame"), "frame"), ["frame", "q"], ["smooth"], 5)


_REP = "round(quantile_cont({0}, 0.005), 1) AS black, round(quantile_cont({0}, 0.995), 1) AS white, round(stddev_pop({0}), 1) AS contrast, round(avg(sqrt({1} * {1} + {2} * {2})), 1) AS chroma"


@query(_STATS + f""", src AS (SELECT frame, {_REP.format('light', 'a', 'b_')} FROM lab GROUP BY frame), res AS (SELECT frame, {_REP.format('(0.9::DOUBLE * light + 9.0::DOUBLE)', '(0.5::DOUBLE * a)', '(0.5::DOUBLE * b_)')} FROM lab GROUP BY frame),
    f AS (SELECT src.frame, list_filter([CASE WHEN res.contrast < 0.8::DOUBLE * ref.contrast THEN 'flat' END, CASE WHEN res.chroma < 0.6::DOUBLE * src.chroma AND res.chroma < 0.85::DOUBLE * ref.chroma THEN 'washed_out' END,
      CASE WHEN res.black > ref.black + 8 THEN 'milky' END, CASE WHEN res.white < least(ref.white, src.white + 14.0) - 6 THEN 'dim' END], lambda x: x IS NOT NULL) AS f FROM src JOIN res USING (frame), (SELECT * FROM src WHERE frame = 'NO') ref)
    SELECT frame, array_to_string(f, ',') AS flags, len(f) = 0 AS acceptable FROM f""")
def quality_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grade that lifts blacks and halves chroma, judged against one frame."""
    lab = _lab(spark, sf_dir)
    src = ops.report(lab, "frame")
    graded = lab.select("frame", (F.lit(0.9) * F.col("light") + F.lit(9.0)).alias("light"), (F.lit(0.5) * F.col("a")).alias("a"), (F.lit(0.5) * F.col("b_")).alias("b_"))
    named = lambda df, p: df.select("frame", *(F.col(c).alias(p + c) for c in df.columns if c != "frame"))
    ref = named(src.where(F.col("frame") == REFERENCE), "ref_").drop("frame")
    rows = named(src, "src_").join(named(ops.report(graded, "frame"), "res_"), "frame").crossJoin(F.broadcast(ref))
    return ops.quality(rows).select("frame", F.array_join("flags", ",").alias("flags"), "acceptable")


@query(_L + """, p AS (SELECT frame, light AS s, least(100.0::DOUBLE, floor(light / 4) * 4 + 8) AS o FROM lab),
    g AS (SELECT frame, avg(CASE WHEN s > 96.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS cs, avg(CASE WHEN o > 96.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS cr, count(*) FILTER (o > 80) AS n, count(DISTINCT CASE WHEN o > 80 THEN round(o, 1) END) AS lo, count(DISTINCT CASE WHEN o > 80 THEN round(s, 1) END) AS ls FROM p GROUP BY frame)
    SELECT frame, round(cs, 6) AS clipped_source, round(cr, 6) AS clipped_result, round(CASE WHEN n > 20 THEN greatest(0.0::DOUBLE, 1.0::DOUBLE - lo / greatest(ls, 1)) ELSE 0.0::DOUBLE END, 4) AS posterization FROM g""")
def posterization_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _lab(spark, sf_dir).select("frame", F.col("light").alias("source"), F.least(F.lit(100.0), F.floor(F.col("light") / 4) * 4 + F.lit(8.0)).alias("result"))
    d = ops.damage(p, "frame", enough=20)
    return d.select("frame", F.round("clipped_source", 6).alias("clipped_source"), F.round("clipped_result", 6).alias("clipped_result"), F.round("posterization", 4).alias("posterization"))


@query(_STATS + """, c AS (SELECT frame, a + (rma - ma) * (0.55::DOUBLE + 0.45::DOUBLE * least(1.0::DOUBLE, greatest(0.0::DOUBLE, light / 100.0::DOUBLE))) AS pa, b_ + (rmb - mb) * (0.55::DOUBLE + 0.45::DOUBLE * least(1.0::DOUBLE, greatest(0.0::DOUBLE, light / 100.0::DOUBLE))) AS pb FROM matched)
    SELECT frame, round(avg(pa), 4) AS a, round(avg(pb), 4) AS b_, round(stddev_pop(pa), 4) AS spread FROM c GROUP BY frame""")
def chroma_preserve(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = ops.preserve_chroma(_matched(spark, sf_dir)).groupBy("frame").agg(F.avg("to_a").alias("a"), F.avg("to_b_").alias("b_"), F.stddev_pop("to_a").alias("spread"))
    return _rounded(m, ["frame"], ["a", "b_", "spread"])


@query("""WITH g AS (SELECT 'f' || (p_partkey // 400) AS frame, CAST(p_partkey % 400 // 20 AS BIGINT) AS y, CAST(p_partkey % 20 AS BIGINT) AS x, p_size / 50.0::DOUBLE AS gray FROM part), e AS (SELECT frame, max(x) AS mx, max(y) AS my, min(x) AS nx, min(y) AS ny FROM g GROUP BY frame),
    full_ AS (SELECT frame FROM g GROUP BY frame HAVING count(*) = 400), k AS (SELECT g.* FROM g JOIN full_ USING (frame)),
    b AS (SELECT k.frame, k.y, k.x, avg(n.gray) AS blur FROM k JOIN e USING (frame), generate_series(-2, 2) AS dx(dx), generate_series(-2, 2) AS dy(dy), k n WHERE n.frame = k.frame AND n.x = least(mx, greatest(nx, k.x + dx)) AND n.y = least(my, greatest(ny, k.y + dy)) GROUP BY ALL)
    SELECT frame, y, x, round(blur, 6) AS blur FROM b""")
def box_blur_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as frames of 20 by 20 pixels."""
    k = F.col("p_partkey")
    g = read(spark, sf_dir, "part").select(F.concat(F.lit("f"), F.floor(k / 400).cast("string")).alias("frame"), F.floor(k % 400 / 20).cast("long").alias("y"), (k % 20).cast("long").alias("x"), (F.col("p_size") / F.lit(50.0)).alias("gray"))
    whole = g.groupBy("frame").agg(F.count(F.lit(1)).alias("n")).where("n = 400")
    return _rounded(ops.box_blur(g.join(whole, "frame", "left_semi"), "frame"), ["frame", "y", "x"], ["blur"], 6)


#: The frame that others are matched to, and pixels above which small frames are measured.
GOAL, ENOUGH = "f1", (10, 20)
_CHANNELS = ("light", "a", "b_")


def _curves_sql(source: str) -> str:
    """CTEs that end in kn(frame, ch, q, x, y): the smoothed, capped curves."""
    pad = lambda new, old, half: f"""{new} AS (SELECT frame, ch, d AS q, v FROM {old}, generate_series({-half}, {255 + half}) AS g(d) WHERE {old}.q = least(255, greatest(0, d)))"""
    mean = lambda new, old, half: f"""{new} AS (SELECT * FROM (SELECT frame, ch, q, avg(v) OVER (PARTITION BY frame, ch ORDER BY q ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING) AS v FROM {old}) WHERE q BETWEEN 0 AND 255)"""
    lists = " UNION ALL ".join(f"SELECT frame, '{c}' AS ch, quantile_cont({c}, [{_Q}]) AS v FROM {source} GROUP BY frame" for c in _CHANNELS)
    return f"""ql AS ({lists}), q0 AS (SELECT frame, ch, generate_subscripts(v, 1) - 1 AS q, unnest(v) AS v FROM ql),
    {pad('p1', 'q0', 4)}, {mean('q1', 'p1', 4)}, {pad('p2', 'q1', 4)}, {mean('q2', 'p2', 4)},
    tp AS (SELECT frame, ch, q, least(1.0, least(q, 255 - q) / 12.0::DOUBLE) AS w, q2.v AS twice, q0.v AS raw FROM q2 JOIN q0 USING (frame, ch, q)),
    sm AS (SELECT frame, ch, q, max(w * twice + (1 - w) * raw) OVER (PARTITION BY frame, ch ORDER BY q) AS v FROM tp),
    kp AS (SELECT s.frame, s.ch, s.q, s.v AS x, r.v AS y FROM sm s JOIN sm r ON s.ch = r.ch AND s.q = r.q WHERE r.frame = '{GOAL}'),
    d1 AS (SELECT *, lead(x) OVER w - x AS dx, lead(y) OVER w - y AS dy FROM kp WHERE ch = 'light' WINDOW w AS (PARTITION BY frame ORDER BY q)),
    d2 AS (SELECT *, CASE WHEN dx > 1e-9 THEN dy / dx ELSE 0.0::DOUBLE END AS s FROM d1),
    md AS (SELECT frame, coalesce(quantile_cont(s, 0.5) FILTER (q < 247 AND dx > 1e-9), 1.0::DOUBLE) AS m FROM d2 GROUP BY frame),
    d3 AS (SELECT d2.*, least(greatest(s, 0.0::DOUBLE), CASE WHEN q < 247 THEN greatest(1.6::DOUBLE, 2.2::DOUBLE * m) ELSE greatest(3.5::DOUBLE, 1.8::DOUBLE * m) END) * dx AS step FROM d2 JOIN md USING (frame)),
    z0 AS (SELECT frame, q, x, y, first_value(y) OVER w + coalesce(sum(step) OVER (PARTITION BY frame ORDER BY q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS z FROM d3 WINDOW w AS (PARTITION BY frame ORDER BY q)),
    en AS (SELECT frame, max(z) FILTER (q = 248) AS kink, max(z) FILTER (q = 255) AS last, max(y) FILTER (q = 255) AS goal FROM z0 GROUP BY frame),
    z1 AS (SELECT frame, q, x, CASE WHEN goal - last > 0.5 AND last - kink > 1e-6 AND q > 247 THEN kink + (z - kink) * (last - kink + goal - last) / (last - kink) ELSE z END AS z FROM z0 JOIN en USING (frame)),
    pe AS (SELECT frame, d AS q, z FROM z1, generate_series(234, 258) AS g(d) WHERE z1.q = least(256 - 1, greatest(236, d)) AND d BETWEEN 234 AND 257 OR z1.q = 255 AND d = 258),
    ea AS (SELECT frame, q, avg(z) OVER (PARTITION BY frame ORDER BY q ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS e FROM pe),
    z2 AS (SELECT z1.frame, z1.q, x, CASE WHEN z1.q BETWEEN 236 AND 255 THEN z * (1 - mix) + e * mix ELSE z END AS z FROM (SELECT *, 2.0::DOUBLE * least((q - 236) / 19.0::DOUBLE, 1.0::DOUBLE - (q - 236) / 19.0::DOUBLE) AS mix FROM z1) z1 LEFT JOIN ea ON z1.frame = ea.frame AND z1.q = ea.q),
    kn AS (SELECT frame, 'light' AS ch, q, x, max(z) OVER (PARTITION BY frame ORDER BY q) AS y FROM z2 UNION ALL SELECT frame, ch, q, x, y FROM kp WHERE ch <> 'light')"""


_F = f"WITH {FRAMES_SQL}, {lab_sql('frames', 'frame, y, x, r, g, b')}"
_CURVES = f"{_F}, {_curves_sql('lab')}"


@query(_CURVES + " SELECT frame, ch AS channel, CAST(q AS INTEGER) AS q, round(x, 4) + 0.0::DOUBLE AS x, round(y, 4) + 0.0::DOUBLE AS y FROM kn")
def histogram_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The curves that match every frame's quantiles to those of one frame: smoothed twice, lightness with capped slopes."""
    lab = ops.with_lab(frames(spark, sf_dir))
    return _rounded(ops.histogram_curves(lab, lab.where(F.col("frame") == GOAL), "frame"), ["frame", "channel", "q"], ["x", "y"])


def _at(v: str, c: str) -> str:
    i = f"len(list_filter(x_{c}, lambda k: k <= {v}))"
    return f"CASE WHEN {i} = 0 THEN y_{c}[1] WHEN {i} >= 256 OR x_{c}[{i} + 1] <= x_{c}[{i}] THEN y_{c}[{i}] ELSE y_{c}[{i}] + ({v} - x_{c}[{i}]) * (y_{c}[{i} + 1] - y_{c}[{i}]) / (x_{c}[{i} + 1] - x_{c}[{i}]) END"


_KNOTS = "ka AS (SELECT frame, " + ", ".join(f"list({f} ORDER BY q) FILTER (ch = '{c}') AS {f}_{c}" for c in _CHANNELS for f in "xy") + " FROM kn GROUP BY frame)"
_MATCHED = f"{_CURVES}, {_KNOTS}, mt AS (SELECT lab.*, " + ", ".join(f"{_at(c, c)} AS m_{c}" for c in _CHANNELS) + " FROM lab JOIN ka USING (frame))"


@query(_MATCHED + " SELECT frame, y, x, round(m_light, 3) + 0.0::DOUBLE AS light, round(m_a, 3) + 0.0::DOUBLE AS a, round(m_b_, 3) + 0.0::DOUBLE AS b_ FROM mt")
def histogram_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = ops.with_lab(frames(spark, sf_dir))
    m = ops.histogram_match(lab, ops.histogram_curves(lab, lab.where(F.col("frame") == GOAL), "frame"), "frame")
    return _rounded(m.select("frame", "y", "x", *(F.col(f"to_{c}").alias(c) for c in _CHANNELS)), ["frame", "y", "x"], list(_CHANNELS), 3)


def _blur_sql(name: str, source: str, key: str, v: str, half: int) -> str:
    top = FRAME_SIDE - 1
    return f"""{name} AS (SELECT k.{key}, k.y, k.x, avg(n.{v}) AS {name} FROM {source} k, generate_series({-half}, {half}) AS gx(dx), generate_series({-half}, {half}) AS gy(dy), {source} n
        WHERE n.{key} = k.{key} AND n.x = least({top}, greatest(0, k.x + dx)) AND n.y = least({top}, greatest(0, k.y + dy)) GROUP BY ALL)"""


def _rgb_sql() -> str:
    back = lambda f: f"CASE WHEN {f} * {f} * {f} > 216.0::DOUBLE / 24389.0::DOUBLE THEN {f} * {f} * {f} ELSE (116.0::DOUBLE * {f} - 16.0::DOUBLE) / {24389.0 / 27.0!r}::DOUBLE END"
    enc = lambda c: f"CASE WHEN {c} <= 0.0031308::DOUBLE THEN {c} * 12.92::DOUBLE ELSE 1.055::DOUBLE * pow(greatest({c}, 0.0::DOUBLE), 1.0::DOUBLE / 2.4::DOUBLE) - 0.055::DOUBLE END"
    m = ", ".join(f"X * {r[0]!r}::DOUBLE + Y * {r[1]!r}::DOUBLE + Z * {r[2]!r}::DOUBLE AS l{n}" for r, n in zip(colour.XYZ_TO_RGB, "rgb", strict=True))
    w = colour.WHITE
    return f"""h1 AS (SELECT *, (t_light + 16.0::DOUBLE) / 116.0::DOUBLE AS fy FROM tr), h2 AS (SELECT *, fy + t_a / 500.0::DOUBLE AS fx, fy - t_b_ / 200.0::DOUBLE AS fz FROM h1),
    h3 AS (SELECT * EXCLUDE (x, y), x AS px, y AS py, ({back('fx')}) * {w[0]!r}::DOUBLE AS cx, ({back('fy')}) * {w[1]!r}::DOUBLE AS cy, ({back('fz')}) * {w[2]!r}::DOUBLE AS cz FROM h2),
    h4 AS (SELECT *, {m.replace('X *', 'cx *').replace('Y *', 'cy *').replace('Z *', 'cz *')} FROM h3),
    h5 AS (SELECT *, {", ".join(f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, {enc('l' + n)})) AS o{n}" for n in "rgb")} FROM h4),
    h6 AS (SELECT *, ({_lin('"or"')}) * {colour.RGB_TO_XYZ[1][0]!r}::DOUBLE + ({_lin('og')}) * {colour.RGB_TO_XYZ[1][1]!r}::DOUBLE + ({_lin('ob')}) * {colour.RGB_TO_XYZ[1][2]!r}::DOUBLE AS oy FROM h5)""".replace("AS or,", 'AS "or",')


def _attempts_sql(strengths: list[float]) -> str:
    s = ", ".join(f"({i}, {x!r}::DOUBLE)" for i, x in enumerate(strengths))
    rep = lambda light, a, b: _REP.format(light, a, b)
    ratio = lambda m: f"o_{m} / greatest(s_{m}, 1e-6::DOUBLE)"
    masks = {"all": "TRUE", "shadow": "light < 30.0", "smooth": "abs(gray - b7) * 100.0::DOUBLE < 0.8"}
    spread = ", ".join(f"stddev_pop(gray - b5) FILTER ({m}) AS s_{n}, stddev_pop(og_ - ob5) FILTER ({m}) AS o_{n}, count(*) FILTER ({m}) AS n_{n}" for n, m in masks.items())
    lost = lambda m, n: f"CASE WHEN count(*) FILTER ({m}) > {n} THEN greatest(0.0::DOUBLE, 1.0::DOUBLE - count(DISTINCT CASE WHEN {m} THEN round(result, 1) END) / greatest(count(DISTINCT CASE WHEN {m} THEN round(light, 1) END), 1)) ELSE 0.0::DOUBLE END"
    mean_at = {"light": "l", "a": "a", "b_": "b"}
    middle = ", ".join(f"{_at('m' + n, c)} AS p_{c}" for c, n in mean_at.items())
    weight = "(0.55::DOUBLE + 0.45::DOUBLE * least(1.0::DOUBLE, greatest(0.0::DOUBLE, {0} / 100.0::DOUBLE)))"
    return f"""{_F}, gr AS (SELECT *, (r + g + b) / 3.0::DOUBLE AS gray FROM frames), {_curves_sql('lab')}, {_KNOTS},
    {_blur_sql('b5', 'gr', 'frame', 'gray', 2)}, {_blur_sql('b7', 'gr', 'frame', 'gray', 3)}, {_blur_sql('l7', 'lab', 'frame', 'light', 3)},
    st AS (SELECT frame, avg(light) AS ml, avg(a) AS ma, avg(b_) AS mb FROM lab GROUP BY frame), rf AS (SELECT ml AS rml, ma AS rma, mb AS rmb FROM st WHERE frame = '{GOAL}'),
    sg AS (SELECT * FROM (VALUES {s}) AS v(try, s)),
    px AS (SELECT lab.*, gray, b5, b7, l7, ml, ma, mb, rf.*, {_at('light', 'light')} AS m_light FROM lab JOIN gr USING (frame, y, x) JOIN b5 USING (frame, y, x) JOIN b7 USING (frame, y, x) JOIN l7 USING (frame, y, x) JOIN ka USING (frame) JOIN st USING (frame), rf),
    tr AS (SELECT px.*, try, s, frame || '#' || try AS shot, light + s * (m_light - light) AS t_light, a + (rma - ma) * s * {weight.format('light')} AS t_a, b_ + (rmb - mb) * s * {weight.format('light')} AS t_b_ FROM px, sg),
    {_rgb_sql()},
    af AS (SELECT * EXCLUDE (px, py), px AS x, py AS y, ("or" + og + ob) / 3.0::DOUBLE AS og_, 116.0::DOUBLE * ({_f('oy')}) - 16.0::DOUBLE AS result FROM h6),
    {_blur_sql('ob5', 'af', 'shot', 'og_', 2)}, fl AS (SELECT af.*, ob5 FROM af JOIN ob5 USING (shot, y, x)),
    nz AS (SELECT shot, any_value(frame) AS frame, any_value(try) AS try, any_value(s) AS strength, {spread}, avg(CASE WHEN light > 96.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS cs, avg(CASE WHEN result > 96.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS cr,
           {lost('result > 80', ENOUGH[0])} AS posterization, {lost('abs(light - l7) < 0.8', ENOUGH[1])} AS banding, {rep('t_light', 't_a', 't_b_')} FROM fl GROUP BY shot),
    sr AS (SELECT frame, {rep('light', 'a', 'b_')} FROM lab GROUP BY frame), wp AS (SELECT frame, quantile_cont(light, 0.995) AS wp FROM lab GROUP BY frame),
    hz AS (SELECT frame, avg(CASE WHEN abs(light - l7) < 0.8 AND light > wp - 6.0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS haze FROM px JOIN wp USING (frame) GROUP BY frame),
    mp AS (SELECT st.*, rf.*, {middle} FROM st JOIN ka USING (frame), rf),
    de AS (SELECT frame, try, sqrt((ml - rml) ** 2 + (ma - rma) ** 2 + (mb - rmb) ** 2) AS before, sqrt((ml + s * (p_light - ml) - rml) ** 2 + (ma + (rma - ma) * s * {weight.format('ml')} - rma) ** 2 + (mb + (rmb - mb) * s * {weight.format('ml')} - rmb) ** 2) AS after FROM mp, sg),
    ms AS (SELECT nz.frame, nz.try, nz.strength, before, after, CASE WHEN before > 1e-6 THEN 1.0::DOUBLE - after / before ELSE 0.0::DOUBLE END AS shrink, round({ratio('all')}, 2) AS overall_ratio, round(CASE WHEN n_shadow > 0 THEN {ratio('shadow')} ELSE {ratio('all')} END, 2) AS shadow_ratio,
           round(CASE WHEN n_smooth > {ENOUGH[1]} THEN {ratio('smooth')} ELSE 1.0::DOUBLE END, 2) AS smooth_ratio, cs, cr, posterization, banding, haze, sr.black AS sb, sr.white AS sw, sr.chroma AS sc, nz.black, nz.white, nz.contrast, nz.chroma, rr.black AS rb, rr.white AS rw, rr.contrast AS rc, rr.chroma AS rch
           FROM nz JOIN de ON nz.frame = de.frame AND nz.try = de.try JOIN hz ON hz.frame = nz.frame JOIN sr ON sr.frame = nz.frame, (SELECT * FROM sr WHERE frame = '{GOAL}') rr),
    fg AS (SELECT *, list_filter([CASE WHEN contrast < 0.8::DOUBLE * rc THEN 'flat' END, CASE WHEN chroma < 0.6::DOUBLE * sc AND chroma < 0.85::DOUBLE * rch THEN 'washed_out' END, CASE WHEN black > rb + 8 THEN 'milky' END,
      CASE WHEN white < least(rw, sw + CASE WHEN haze > 0.10 THEN 6.0 ELSE 14.0 END) - 6 THEN 'dim' END, CASE WHEN shadow_ratio > 1.6 OR overall_ratio > 1.5 OR smooth_ratio > 1.6 THEN 'noisy' END, CASE WHEN cr - cs > 0.005 THEN 'clipped' END,
      CASE WHEN posterization > 0.25 THEN 'posterized' END, CASE WHEN banding > 0.3 THEN 'banding' END], lambda x: x IS NOT NULL) AS f FROM ms)"""


_SHOWN = ["before", "after", "shrink", "overall_ratio", "shadow_ratio", "smooth_ratio", "posterization", "banding", "haze"]


@query(_attempts_sql([1.0]) + " SELECT frame, " + ", ".join(f"round({c}, 2) + 0.0::DOUBLE AS {c}" for c in _SHOWN) + ", array_to_string(f, ',') AS flags, len(f) = 0 AS acceptable FROM fg")
def color_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frame matched to one by its histogram with the chroma kept: distances, noise ratios, damage, haze and flags."""
    rows = frames(spark, sf_dir)
    found = ops.attempts(rows, rows.where(F.col("frame") == GOAL), "frame", [1.0], enough=ENOUGH)
    return _rounded(found.withColumns({"flags": F.array_join("flags", ",")}), ["frame", "flags", "acceptable"], _SHOWN, 2)


@query(_attempts_sql([1.0, 0.8, 0.64]) + """, rk AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY len(f), try) AS k FROM fg)
    SELECT frame, try, strength, array_to_string(f, ',') AS flags, CASE WHEN len(f) = 0 THEN 'graded' ELSE 'needs_human' END AS status, round(shrink, 2) + 0.0::DOUBLE AS shrink FROM rk WHERE k = 1""")
def grade_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All strengths of the retry schedule at once; of each frame the first acceptable one, else the one with the fewest flags."""
    rows = frames(spark, sf_dir)
    found = ops.attempts(rows, rows.where(F.col("frame") == GOAL), "frame", ops.strengths(1.0), enough=ENOUGH)
    best = ops.best_attempt(found, "frame").withColumn("flags", F.array_join("flags", ","))
    return _rounded(best, ["frame", "try", "strength", "flags", "status"], ["shrink"], 2)


_GRID = "SELECT b * 4225 + g * 65 + r AS pos, r / 64.0::DOUBLE AS r, g / 64.0::DOUBLE AS g, b / 64.0::DOUBLE AS b FROM generate_series(0, 64) AS x(r), generate_series(0, 64) AS y(g), generate_series(0, 64) AS z(b)"


@query(_GRID)
def lut_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.lut_grid(spark)


def _baked_sql() -> str:
    moved = ", ".join(f"(gl.{c} - s.m{n}) * (r.s{n} / CASE WHEN s.s{n} < 1e-6 THEN 1.0 ELSE s.s{n} END) + r.m{n} AS t_{c}" for c, n in (("light", "l"), ("a", "a"), ("b_", "b")))
    grid_lab = lab_sql("gd", "pos").replace("lin AS", "glin AS").replace("FROM lin)", "FROM glin)").replace(" xyz AS", " gxyz AS").replace("FROM xyz)", "FROM gxyz)").replace("ff AS", "gff AS").replace("FROM ff)", "FROM gff)").replace("lab AS", "gl AS")
    return f"""{_STATS}, gd AS ({_GRID}), {grid_lab}, tr AS (SELECT pos, 0 AS x, 0 AS y, {moved} FROM gl, (SELECT * FROM st WHERE frame = 'RF') s, (SELECT * FROM st WHERE frame = 'NO') r), {_rgb_sql()}
    SELECT pos, round("or", 6) + 0.0::DOUBLE AS r, round(og, 6) + 0.0::DOUBLE AS g, round(ob, 6) + 0.0::DOUBLE AS b FROM h5"""


@query(_baked_sql())
def lut_baked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 65-point LUT of a match of one frame to another."""
    st = ops.stats(_lab(spark, sf_dir), "frame")
    source = st.where("frame = 'RF'").withColumn("frame", F.lit("lut"))
    match = lambda lab: ops.reinhard(lab.withColumn("frame", F.lit("lut")), F.broadcast(source), st.where(F.col("frame") == REFERENCE), "frame")
    return _rounded(ops.bake(ops.lut_grid(spark), match), ["pos"], ["r", "g", "b"], 6)


@query(_F + f""", wp AS (SELECT frame, quantile_cont(light, 0.995) AS wp FROM lab GROUP BY frame), {_blur_sql('l7', 'lab', 'frame', 'light', 3)},
    hz AS (SELECT frame, avg(CASE WHEN abs(light - l7) < 0.8 AND light > wp - 6.0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS haze FROM lab JOIN l7 USING (frame, y, x) JOIN wp USING (frame) GROUP BY frame)
    SELECT CAST(substr(frame, 2) AS BIGINT) // 3 AS clip, round(max(haze), 4) AS haze FROM hz GROUP BY ALL""")
def haze_worst_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three frames stand for a clip; its haze is that of its worst frame."""
    lab = ops.box_blur(ops.with_lab(frames(spark, sf_dir)), "frame", 3, "light")
    clip = F.floor(F.substring("frame", 2, 20).cast("long") / 3).alias("clip")
    return _rounded(ops.worst_frame(ops.haze_fraction(lab, "frame").select(clip, "haze"), "clip", ["haze"]), ["clip"], ["haze"])


@query("""WITH s AS (SELECT c_custkey AS k, (c_custkey % 21) / 20.0::DOUBLE AS s FROM customer), t AS (SELECT k, n, round(greatest(s * pow(0.8::DOUBLE, n), 0.5::DOUBLE), 4) AS v FROM s, generate_series(0, 2) AS g(n)),
    f AS (SELECT k, v, min(n) AS n FROM t GROUP BY k, v) SELECT k, row_number() OVER (PARTITION BY k ORDER BY n) - 1 AS try, v AS strength FROM f""")
def strength_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = (F.col("c_custkey") % 21) / F.lit(20.0)
    rows = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.posexplode(ops.schedule(s)).alias("try", "strength"))
    return rows.withColumn("try", F.col("try").cast("long"))


@query("""WITH a AS (SELECT c_custkey // 4 AS clip, c_custkey % 4 AS try, c_nationkey % 3 AS n FROM customer), r AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY n, try) AS r FROM a) SELECT clip, try, CASE WHEN n = 0 THEN 'graded' ELSE 'needs_human' END AS status FROM r WHERE r = 1""")
def best_attempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    a = read(spark, sf_dir, "customer").select(F.floor(k / 4).cast("long").alias("clip"), (k % 4).alias("try"), F.slice(F.array(F.lit("flat"), F.lit("dim")), F.lit(1), F.col("c_nationkey") % 3).alias("flags"))
    return ops.best_attempt(a, "clip").select("clip", "try", "status")


@query("WITH a AS (SELECT c_custkey // 4 AS clip, c_custkey % 4 AS try, c_nationkey % 3 AS n FROM customer), m AS (SELECT clip, min(n) AS n FROM a GROUP BY clip) SELECT count(*) FILTER (n = 0) AS graded, count(*) FILTER (n > 0) AS needs_human FROM m")
def grade_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.tally(best_attempt(spark, sf_dir))


@query(f"SELECT pos, printf('%.6f %.6f %.6f', r, g, b) AS line FROM ({_GRID}) UNION ALL SELECT * FROM (VALUES (-4, 'TITLE \"grid\"'), (-3, 'LUT_3D_SIZE 65'), (-2, 'DOMAIN_MIN 0.0 0.0 0.0'), (-1, 'DOMAIN_MAX 1.0 1.0 1.0')) AS h(pos, line)")
def cube_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of an identity LUT file."""
    return interchange.cube(ops.lut_grid(spark), "grid", ops.LUT_SIZE)
