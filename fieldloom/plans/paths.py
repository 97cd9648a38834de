"""Queries on tracked paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.adapters import PATH, SKY, path, rounded, sky, sql_rounded, table
from fieldloom.functions import pose as P
from fieldloom.operators import windows as ops
from fieldloom.plans.registry import query

PATHS = f"WITH RECURSIVE {PATH}, good AS (SELECT * FROM path WHERE x IS NOT NULL)"


def _compose(a: str, b: str) -> str:
    return (f"{{'x': {a}.x + cos({a}.r)*{b}.x - sin({a}.r)*{b}.y, 'y': {a}.y + sin({a}.r)*{b}.x + cos({a}.r)*{b}.y, "
            f"'r': atan2(sin({a}.r + {b}.r), cos({a}.r + {b}.r))}}")  # fmt: skip


def _invert(a: str) -> str:
    return f"{{'x': -cos({a}.r)*{a}.x - sin({a}.r)*{a}.y, 'y': sin({a}.r)*{a}.x - cos({a}.r)*{a}.y, 'r': atan2(sin(-{a}.r), cos(-{a}.r))}}"


PAIRED = f"""{PATHS}, pr AS (SELECT video_id, frame, {{'x': x, 'y': y, 'r': rotation}} AS b, lag({{'x': x, 'y': y, 'r': rotation}}) OVER (PARTITION BY video_id ORDER BY frame) AS a FROM good),
    two AS (SELECT * FROM pr WHERE a IS NOT NULL)"""


def _paired(spark, folder):
    from pyspark.sql import Window

    own = P.pose("x", "y", "rotation")
    rows = path(spark, folder).where("x IS NOT NULL").select("video_id", "frame", own.alias("b"))
    return rows.withColumn("a", F.lag("b").over(Window.partitionBy("video_id").orderBy("frame"))).where("a IS NOT NULL")


@query("pose_compose", f"{PAIRED}, c AS (SELECT video_id, frame, {_compose('a', 'b')} AS p FROM two) SELECT video_id, frame, round(p.x, 4) + 0.0 AS x, round(p.y, 4) + 0.0 AS y, round(p.r, 7) + 0.0 AS rotation FROM c")
def pose_compose(spark, folder):
    rows = _paired(spark, folder).select("video_id", "frame", P.compose(F.col("a"), F.col("b")).alias("p"))
    return rows.select("video_id", "frame", (F.round("p.x", 4) + 0.0).alias("x"), (F.round("p.y", 4) + 0.0).alias("y"), (F.round("p.rotation", 7) + 0.0).alias("rotation"))


@query("pose_relative", f"""{PAIRED} SELECT video_id, frame, round(cos(a.r)*(b.x-a.x) + sin(a.r)*(b.y-a.y), 4) + 0.0 AS x, round(cos(a.r)*(b.y-a.y) - sin(a.r)*(b.x-a.x), 4) + 0.0 AS y,
    round(atan2(sin(b.r-a.r), cos(b.r-a.r)), 7) + 0.0 AS rotation FROM two""")
def pose_relative(spark, folder):
    rows = _paired(spark, folder).select("video_id", "frame", P.relative(F.col("b"), F.col("a")).alias("p"))
    return rounded(rows.select("video_id", "frame", "p.*"))


@query("pose_interpolate", f"""{PAIRED}, i AS (SELECT video_id, frame, a, b, {_invert('a')} AS n FROM two), r AS (SELECT video_id, frame, a, {_compose('n', 'b')} AS q FROM i),
    f AS (SELECT *, CASE WHEN abs(q.r) < 1e-8 THEN 1 - q.r*q.r/6 ELSE sin(q.r)/q.r END AS fa, CASE WHEN abs(q.r) < 1e-8 THEN q.r/2 ELSE (1-cos(q.r))/q.r END AS fb FROM r),
    t AS (SELECT video_id, frame, a, {{'x': 0.25*(fa*q.x+fb*q.y)/(fa*fa+fb*fb), 'y': 0.25*(fa*q.y-fb*q.x)/(fa*fa+fb*fb), 'r': 0.25*q.r}} AS w FROM f),
    g AS (SELECT *, CASE WHEN abs(w.r) < 1e-8 THEN 1 - w.r*w.r/6 ELSE sin(w.r)/w.r END AS ga, CASE WHEN abs(w.r) < 1e-8 THEN w.r/2 ELSE (1-cos(w.r))/w.r END AS gb FROM t),
    e AS (SELECT video_id, frame, a, {{'x': ga*w.x-gb*w.y, 'y': gb*w.x+ga*w.y, 'r': w.r}} AS m FROM g), z AS (SELECT video_id, frame, {_compose('a', 'm')} AS p FROM e)
    SELECT video_id, frame, {sql_rounded('p.x')} AS x, {sql_rounded('p.y')} AS y, {sql_rounded('p.r', 7)} AS rotation FROM z""")
def pose_interpolate(spark, folder):
    rows = _paired(spark, folder).select("video_id", "frame", P.interpolate(F.col("a"), F.col("b"), F.lit(0.25)).alias("p"))
    return rounded(rows.select("video_id", "frame", "p.*"), shift=0.123)


@query("pose_stabilize", f"""WITH {PATH}, w AS (SELECT video_id, frame, x, y, rotation, CASE WHEN x IS NOT NULL THEN greatest(1, points) END AS w FROM path)
    SELECT video_id, frame, CASE WHEN w IS NOT NULL THEN {sql_rounded('sum(w*x) OVER o / sum(w) OVER o')} END AS x, CASE WHEN w IS NOT NULL THEN {sql_rounded('sum(w*y) OVER o / sum(w) OVER o')} END AS y,
           CASE WHEN w IS NOT NULL THEN {sql_rounded('atan2(sum(w*sin(rotation)) OVER o, sum(w*cos(rotation)) OVER o)', 7)} END AS rotation
    FROM w WINDOW o AS (PARTITION BY video_id ORDER BY frame ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def pose_stabilize(spark, folder):
    return rounded(ops.stabilised(path(spark, folder), "video_id", "frame", 5), shift=0.123)


@query("visit_sessions", f"""WITH {SKY}, f AS (SELECT track, frame, coalesce((frame - lag(frame) OVER (PARTITION BY track ORDER BY frame) > 256)::INT, 0) AS s FROM sky)
    SELECT track, frame, (sum(s) OVER (PARTITION BY track ORDER BY frame))::BIGINT AS visit FROM f""")
def visit_sessions(spark, folder):
    return ops.visits(sky(spark, folder), "track", "frame").select("track", "frame", "visit")


TRAVELLED = f"""{PATHS}, st AS (SELECT *, coalesce(sqrt((x - lag(x) OVER w)**2 + (y - lag(y) OVER w)**2), 0) AS d FROM good WINDOW w AS (PARTITION BY video_id ORDER BY frame)),
    tr AS (SELECT *, sum(d) OVER (PARTITION BY video_id ORDER BY frame ROWS UNBOUNDED PRECEDING) AS travelled FROM st)"""


@query("travelled_distance", f"{TRAVELLED} SELECT video_id, frame, round(travelled, 3) AS travelled FROM tr")
def travelled_distance(spark, folder):
    return rounded(ops.travelled(path(spark, folder), "video_id", "frame").select("video_id", "frame", "travelled"), 3)


@query("path_anomaly", f"""{PATHS}, n AS (SELECT *, lag(frame) OVER w AS bf, lead(frame) OVER w AS af, lag(x) OVER w AS bx, lead(x) OVER w AS ax, lag(y) OVER w AS by_, lead(y) OVER w AS ay,
      lag(rotation) OVER w AS br, lead(rotation) OVER w AS ar FROM good WINDOW w AS (PARTITION BY video_id ORDER BY frame)),
    s AS (SELECT *, (frame-bf)/greatest(1, af-bf) AS f, atan2(sin(ar-br), cos(ar-br)) AS t FROM n), v AS (SELECT *, rotation-br-f*t AS u FROM s)
    SELECT video_id, frame, round(coalesce(sqrt((x-bx-f*(ax-bx))**2 + (y-by_-f*(ay-by_))**2 + (100*atan2(sin(u), cos(u)))**2), 0), 4) AS anomaly FROM v""")
def path_anomaly(spark, folder):
    return rounded(ops.anomalies(path(spark, folder), "video_id", "frame"))


CLOSURES = "cl AS (SELECT video_id, min(frame) + 10 AS a, min(frame) + 10 + v.k * 20 AS f, -1.5 * v.k AS dx, 0.75 * v.k AS dy, 0.001 * v.k AS t FROM good, (VALUES (1), (2)) v(k) GROUP BY video_id, v.k)"


def _closures(spark, folder):
    first = path(spark, folder).where("x IS NOT NULL").groupBy("video_id").agg((F.min("frame") + 10).alias("anchor")).withColumn("k", F.explode(F.array(F.lit(1), F.lit(2))))
    return first.select("video_id", "anchor", (F.col("anchor") + F.col("k") * 20).alias("frame"), (-1.5 * F.col("k")).alias("dx"), (0.75 * F.col("k")).alias("dy"), (0.001 * F.col("k")).alias("turn"))


@query("loop_closure", f"""{PATHS}, {CLOSURES}, m AS (SELECT g.video_id, g.frame, sum(least(1, (g.frame-a)/(f-a))*dx) AS dx, sum(least(1, (g.frame-a)/(f-a))*dy) AS dy, sum(least(1, (g.frame-a)/(f-a))*t) AS t
      FROM good g JOIN cl ON cl.video_id = g.video_id AND g.frame > a GROUP BY ALL)
    SELECT video_id, frame, round(x+coalesce(dx, 0), 4) + 0.0 AS x, round(y+coalesce(dy, 0), 4) + 0.0 AS y,
           round(atan2(sin(rotation+coalesce(t, 0)), cos(rotation+coalesce(t, 0))), 7) + 0.0 AS rotation FROM good LEFT JOIN m USING (video_id, frame)""")
def loop_closure(spark, folder):
    return rounded(ops.closed_loops(path(spark, folder), _closures(spark, folder), "video_id", "frame"))


ANCHORS = "an AS (SELECT video_id, frame, x + 2 AS ax, y - 1 + frame % 3 AS ay, rotation + 0.01 AS ar FROM good WHERE frame % 25 = 0)"


def _anchors(spark, folder):
    return path(spark, folder).where("x IS NOT NULL AND frame % 25 = 0").select("video_id", "frame", (F.col("x") + 2).alias("ax"), (F.col("y") - 1 + F.col("frame") % 3).alias("ay"), (F.col("rotation") + 0.01).alias("arotation"))


@query("interpolate_by_frame", f"""{PATHS}, {ANCHORS}, v AS (SELECT g.*, ax, ay, ar, coalesce((frame - lag(frame) OVER (PARTITION BY video_id ORDER BY frame) > 256)::INT, 0) AS s FROM good g LEFT JOIN an USING (video_id, frame)),
    w AS (SELECT *, sum(s) OVER (PARTITION BY video_id ORDER BY frame) AS visit FROM v),
    b AS (SELECT w.*, l.frame AS lf, r.frame AS rf FROM w
          LEFT JOIN LATERAL (SELECT max(frame) AS frame FROM w k WHERE k.video_id = w.video_id AND k.visit = w.visit AND k.ax IS NOT NULL AND k.frame <= w.frame) l ON true
          LEFT JOIN LATERAL (SELECT min(frame) AS frame FROM w k WHERE k.video_id = w.video_id AND k.visit = w.visit AND k.ax IS NOT NULL AND k.frame >= w.frame) r ON true WHERE w.ax IS NULL),
    c AS (SELECT b.video_id, b.frame, b.x, b.y, b.rotation AS r, coalesce(lf, rf) AS lf, coalesce(rf, lf) AS rf FROM b WHERE coalesce(lf, rf) IS NOT NULL),
    d AS (SELECT c.*, p.x AS px, p.y AS py, p.rotation AS pr, p.ax AS pax, p.ay AS pay, p.ar AS par, q.x AS qx, q.y AS qy, q.rotation AS qr, q.ax AS qax, q.ay AS qay, q.ar AS qar
          FROM c JOIN w p ON p.video_id = c.video_id AND p.frame = c.lf JOIN w q ON q.video_id = c.video_id AND q.frame = c.rf),
    e AS (SELECT video_id, frame, CASE WHEN lf = rf THEN 0 ELSE (frame-lf)/(rf-lf) END AS s,
          pax + cos(par-pr)*(x-px) - sin(par-pr)*(y-py) AS x1, pay + sin(par-pr)*(x-px) + cos(par-pr)*(y-py) AS y1, r+par-pr AS r1,
          qax + cos(qar-qr)*(x-qx) - sin(qar-qr)*(y-qy) AS x2, qay + sin(qar-qr)*(x-qx) + cos(qar-qr)*(y-qy) AS y2, r+qar-qr AS r2 FROM d)
    SELECT video_id, frame, round(x1+s*(x2-x1), 4) + 0.0 AS x, round(y1+s*(y2-y1), 4) + 0.0 AS y,
           round(atan2(sin(r1+s*atan2(sin(r2-r1), cos(r2-r1))), cos(r1+s*atan2(sin(r2-r1), cos(r2-r1)))), 7) + 0.0 AS rotation FROM e""")
def interpolate_by_frame(spark, folder):
    return rounded(ops.within_visits(path(spark, folder), _anchors(spark, folder), "video_id", "frame"))


@query("interpolate_by_distance", f"""{TRAVELLED}, {ANCHORS}, j AS (SELECT t.*, ax, ay, ar FROM tr t LEFT JOIN an USING (video_id, frame)),
    b AS (SELECT j.*, last_value(CASE WHEN ax IS NOT NULL THEN frame END IGNORE NULLS) OVER (PARTITION BY video_id ORDER BY frame ROWS UNBOUNDED PRECEDING) AS lf,
                 first_value(CASE WHEN ax IS NOT NULL THEN frame END IGNORE NULLS) OVER (PARTITION BY video_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rf FROM j),
    c AS (SELECT *, coalesce(lf, rf) AS l, coalesce(rf, lf) AS r FROM b WHERE coalesce(lf, rf) IS NOT NULL),
    fx AS (SELECT video_id, frame, travelled AS way, atan2(sin(ar-rotation), cos(ar-rotation)) AS fr, ax - (cos(ar-rotation)*x - sin(ar-rotation)*y) AS fx, ay - (sin(ar-rotation)*x + cos(ar-rotation)*y) AS fy
           FROM j WHERE ax IS NOT NULL),
    d AS (SELECT c.video_id, c.frame, c.x, c.y, c.rotation, {{'x': p.fx, 'y': p.fy, 'r': p.fr}} AS a, {{'x': q.fx, 'y': q.fy, 'r': q.fr}} AS b,
                 CASE WHEN l = r THEN 0 WHEN q.way-p.way > 1e-8 THEN (travelled-p.way)/(q.way-p.way) ELSE (c.frame-l)/(r-l) END AS s
          FROM c JOIN fx p ON p.video_id = c.video_id AND p.frame = c.l JOIN fx q ON q.video_id = c.video_id AND q.frame = c.r),
    i AS (SELECT *, {_invert('a')} AS n FROM d), k AS (SELECT *, {_compose('n', 'b')} AS q FROM i),
    f AS (SELECT *, CASE WHEN abs(q.r) < 1e-8 THEN 1 - q.r*q.r/6 ELSE sin(q.r)/q.r END AS fa, CASE WHEN abs(q.r) < 1e-8 THEN q.r/2 ELSE (1-cos(q.r))/q.r END AS fb FROM k),
    t AS (SELECT *, {{'x': s*(fa*q.x+fb*q.y)/(fa*fa+fb*fb), 'y': s*(fa*q.y-fb*q.x)/(fa*fa+fb*fb), 'r': s*q.r}} AS w FROM f),
    g AS (SELECT *, CASE WHEN abs(w.r) < 1e-8 THEN 1 - w.r*w.r/6 ELSE sin(w.r)/w.r END AS ga, CASE WHEN abs(w.r) < 1e-8 THEN w.r/2 ELSE (1-cos(w.r))/w.r END AS gb FROM t),
    e AS (SELECT video_id, frame, a, {{'x': ga*w.x-gb*w.y, 'y': gb*w.x+ga*w.y, 'r': w.r}} AS m, {{'x': x, 'y': y, 'r': rotation}} AS o FROM g),
    z AS (SELECT video_id, frame, o, {_compose('a', 'm')} AS h FROM e), y AS (SELECT video_id, frame, {_compose('h', 'o')} AS p FROM z)
    SELECT video_id, frame, {sql_rounded('p.x')} AS x, {sql_rounded('p.y')} AS y, {sql_rounded('p.r', 7)} AS rotation FROM y""")
def interpolate_by_distance(spark, folder):
    return rounded(ops.between_anchors(path(spark, folder), _anchors(spark, folder), "video_id", "frame"), shift=0.123)


@query("evenly_spaced", """WITH r AS (SELECT video_id, frame, row_number() OVER (PARTITION BY video_id ORDER BY frame) - 1 AS i, count(*) OVER (PARTITION BY video_id) AS n FROM (SELECT DISTINCT video_id, frame FROM path_entries)),
    p AS (SELECT DISTINCT video_id, floor(k*(n-1)/6.0 + 0.5)::BIGINT AS i FROM (SELECT DISTINCT video_id, n FROM r WHERE n > 7), range(7) t(k))
    SELECT video_id, frame FROM r WHERE n <= 7 UNION ALL SELECT video_id, frame FROM r JOIN p USING (video_id, i)""")
def evenly_spaced(spark, folder):
    frames = table(spark, folder, "path_entries").select("video_id", "frame").distinct()
    return ops.evenly_spaced(frames, "video_id", "frame", 7)


@query("midpoint_sample", """WITH r AS (SELECT video_id, frame, row_number() OVER (PARTITION BY video_id ORDER BY frame) - 1 AS i, count(*) OVER (PARTITION BY video_id) AS n FROM (SELECT DISTINCT video_id, frame FROM path_entries)),
    p AS (SELECT DISTINCT video_id, floor((k+0.5)*n/6)::BIGINT AS i FROM (SELECT DISTINCT video_id, n FROM r WHERE n > 6), range(6) t(k))
    SELECT video_id, frame FROM r WHERE n <= 6 UNION ALL SELECT video_id, frame FROM r JOIN p USING (video_id, i)""")
def midpoint_sample(spark, folder):
    frames = table(spark, folder, "path_entries").select("video_id", "frame").distinct()
    return ops.midpoints(frames, "video_id", "frame", 6)


@query("strata_representatives", f"""WITH {PATH}, r AS (SELECT video_id, frame, sharpness, row_number() OVER (PARTITION BY video_id ORDER BY frame) - 1 AS i, count(*) OVER (PARTITION BY video_id) AS n FROM path),
    p AS (SELECT *, floor(i*5/n)::BIGINT AS part FROM r), k AS (SELECT *, row_number() OVER (PARTITION BY video_id, part ORDER BY sharpness DESC NULLS LAST, frame) AS rank FROM p)
    SELECT video_id, part, rank, frame FROM k WHERE rank <= 3""")
def strata_representatives(spark, folder):
    return ops.strata(path(spark, folder), "video_id", "frame", 5, "sharpness").where("rank <= 3").select("video_id", "part", "rank", "frame")


@query("sharpest_first", f"WITH {PATH} SELECT video_id, frame, row_number() OVER (PARTITION BY video_id ORDER BY sharpness DESC NULLS LAST, frame) AS place FROM path")
def sharpest_first(spark, folder):
    from pyspark.sql import Window

    return path(spark, folder).select("video_id", "frame", F.row_number().over(Window.partitionBy("video_id").orderBy(F.col("sharpness").desc_nulls_last(), "frame")).alias("place"))


@query("decode_frontier", f"""WITH {SKY}, s AS (SELECT track, frame, timestamp_us, xor(row_number() OVER (PARTITION BY track ORDER BY timestamp_us, frame) - 1, 1) AS i FROM sky)
    SELECT track, frame, max(i) OVER (PARTITION BY track ORDER BY timestamp_us, frame ROWS UNBOUNDED PRECEDING) AS frontier FROM s""")
def decode_frontier(spark, folder):
    from pyspark.sql import Window

    by = Window.partitionBy("track").orderBy("timestamp_us", "frame")
    rows = sky(spark, folder).withColumn("k", F.row_number().over(by) - 1).withColumn("i", F.col("k").bitwiseXOR(F.lit(1)))
    return ops.frontier(rows, "track", "k", "i").select("track", "frame", F.col("frontier").cast("long").alias("frontier"))


@query("vfr_flag", """WITH r AS (SELECT DISTINCT video_id, frame, timestamp_us FROM path_entries), s AS (SELECT video_id, timestamp_us - lag(timestamp_us) OVER (PARTITION BY video_id ORDER BY timestamp_us) AS d FROM r),
    a AS (SELECT video_id, avg(d) AS m, min(d) AS l, max(d) AS h FROM s WHERE d IS NOT NULL GROUP BY video_id)
    SELECT video_id, round(1e6/nullif(m, 0), 4) AS fps, greatest(h-m, m-l) > greatest(100, 0.02*m) AS variable FROM a""")
def vfr_flag(spark, folder):
    samples = table(spark, folder, "path_entries").select("video_id", "frame", "timestamp_us").distinct()
    return rounded(ops.frame_rates(samples, "video_id", "timestamp_us"))


@query("closest_timestamp", f"""WITH {PATH}, f AS (SELECT frame_id, any_value(video_id) AS video_id, any_value(timestamp_us) AS t FROM frames GROUP BY frame_id),
    n AS (SELECT frame_id, frame, row_number() OVER (PARTITION BY frame_id ORDER BY abs(timestamp_us - t), timestamp_us DESC) AS k FROM f JOIN path USING (video_id))
    SELECT frame_id AS ask, frame FROM n WHERE k = 1""")
def closest_timestamp(spark, folder):
    asks = table(spark, folder, "frames").select(F.col("frame_id").alias("ask"), "video_id", "timestamp_us").dropDuplicates(["ask"])
    samples = path(spark, folder).select("video_id", "timestamp_us", "frame")
    return ops.closest_in_time(asks, samples, "video_id", "timestamp_us", "frame").where("frame IS NOT NULL")


@query("reference_counts", """WITH e AS (SELECT DISTINCT video_id, frame, incremental_match.frame AS m, coalesce(incremental_match.accepted, false) AS a FROM path_entries WHERE incremental_match.frame IS NOT NULL AND incremental_match.frame <> frame),
    f AS (SELECT DISTINCT video_id, frame FROM path_entries)
    SELECT f.video_id, f.frame, (SELECT count(DISTINCT e.frame) FROM e WHERE e.video_id = f.video_id AND e.m = f.frame) AS referenced_by,
           (SELECT count(DISTINCT e.m) FROM e WHERE e.video_id = f.video_id AND e.frame = f.frame) AS refers_to,
           (SELECT count(DISTINCT e.frame) FROM e WHERE e.a AND e.video_id = f.video_id AND e.m = f.frame) AS consensus_by FROM f""")
def reference_counts(spark, folder):
    m = F.col("incremental_match")
    entries = table(spark, folder, "path_entries")
    links = entries.select("video_id", "frame", m["frame"].alias("m"), F.coalesce(m["accepted"], F.lit(False)).alias("a")).where("m IS NOT NULL AND m != frame")
    by = links.groupBy("video_id", F.col("m").alias("frame")).agg(F.count_distinct("frame").alias("referenced_by"), F.count_distinct(F.when(F.col("a"), F.col("frame"))).alias("consensus_by"))
    to = links.groupBy("video_id", "frame").agg(F.count_distinct("m").alias("refers_to"))
    all_ = entries.select("video_id", "frame").distinct().join(by, ["video_id", "frame"], "left").join(to, ["video_id", "frame"], "left").na.fill(0)
    return all_.select("video_id", "frame", "referenced_by", "refers_to", "consensus_by")


@query("match_reasons", "SELECT coalesce(incremental_match.reason, '') AS reason, count(*) AS n, count(DISTINCT video_id) AS videos FROM path_entries WHERE incremental_match IS NOT NULL GROUP BY 1")
def match_reasons(spark, folder):
    rows = table(spark, folder, "path_entries").where("incremental_match IS NOT NULL")
    return rows.groupBy(F.coalesce("incremental_match.reason", F.lit("")).alias("reason")).agg(F.count("*").alias("n"), F.count_distinct("video_id").alias("videos"))


@query("validate_tracking", """WITH e AS (SELECT DISTINCT entry_no, video_id, frame, incremental_match.frame AS m FROM path_entries), f AS (SELECT DISTINCT video_id, frame FROM path_entries)
    SELECT video_id, frame, 'frame twice' AS rule FROM e GROUP BY video_id, frame HAVING count(DISTINCT entry_no) > 1
    UNION ALL SELECT DISTINCT e.video_id, e.frame, 'unknown reference' FROM e LEFT JOIN f ON f.video_id = e.video_id AND f.frame = e.m WHERE e.m IS NOT NULL AND f.frame IS NULL
    UNION ALL SELECT DISTINCT e.video_id, e.frame, 'beyond the video' FROM e JOIN videos v USING (video_id) WHERE e.frame >= v.frame_count OR e.frame < 0""")
def validate_tracking(spark, folder):
    e = table(spark, folder, "path_entries").select("entry_no", "video_id", "frame", F.col("incremental_match.frame").alias("m")).distinct()
    frames = e.select("video_id", F.col("frame").alias("m")).distinct()
    twice = e.groupBy("video_id", "frame").agg(F.count_distinct("entry_no").alias("k")).where("k > 1").select("video_id", "frame", F.lit("frame twice").alias("rule"))
    unknown = e.where("m IS NOT NULL").join(frames, ["video_id", "m"], "left_anti").select("video_id", "frame").distinct().withColumn("rule", F.lit("unknown reference"))
    videos = table(spark, folder, "videos").select("video_id", "frame_count")
    beyond = e.join(videos, "video_id").where("frame >= frame_count OR frame < 0").select("video_id", "frame").distinct().withColumn("rule", F.lit("beyond the video"))
    return twice.unionByName(unknown).unionByName(beyond)


@query("movement_csv", f"""WITH {PATH} SELECT video_id, frame, timestamp_us, round(x, 4) AS x_px, round(y, 4) AS y_px, round(degrees(rotation), 4) AS rotation_deg, points AS patches FROM path WHERE x IS NOT NULL""")
def movement_csv(spark, folder):
    from fieldloom.sources.tracking import movement_rows

    return rounded(movement_rows(path(spark, folder)))
