"""Queries on frames as rectangles of a plane."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fieldloom.adapters import OBSERVATIONS, PATH, SKY, path, points, rounded, sky, table
from fieldloom.operators import spatial as ops
from fieldloom.plans.registry import query

PLANE = ops.Plane()

FRAMES = f"""WITH {SKY}, g AS (SELECT * EXCLUDE (kind), cos(rotation) AS c, sin(rotation) AS s FROM sky WHERE success),
    e AS (SELECT *, x-(abs(c)*200+abs(s)*150) AS lx, x+(abs(c)*200+abs(s)*150) AS hx, y-(abs(s)*200+abs(c)*150) AS ly, y+(abs(s)*200+abs(c)*150) AS hy FROM g),
    bd AS (SELECT floor(min(lx))::BIGINT AS x0, floor(min(ly))::BIGINT AS y0, ceil(max(hx))::BIGINT AS x1, ceil(max(hy))::BIGINT AS y1 FROM e)"""


def _cells(size: float, margin: float = 0) -> str:
    return f"""cells AS (SELECT e.*, i AS cell_col, j AS cell_row, bd.x0+i*{size}::DOUBLE AS cx0, bd.y0+j*{size}::DOUBLE AS cy0, least(bd.x1, bd.x0+(i+1)*{size}::DOUBLE) AS cx1, least(bd.y1, bd.y0+(j+1)*{size}::DOUBLE) AS cy1
        FROM e, bd, unnest(range(greatest(0, floor((lx-{margin}-bd.x0)/{size}))::BIGINT, least(ceil((bd.x1-bd.x0)/{size})-1, floor((hx+{margin}-bd.x0)/{size}))::BIGINT+1)) AS a(i),
             unnest(range(greatest(0, floor((ly-{margin}-bd.y0)/{size}))::BIGINT, least(ceil((bd.y1-bd.y0)/{size})-1, floor((hy+{margin}-bd.y0)/{size}))::BIGINT+1)) AS b(j))"""


def _holds(px: str, py: str, t: str = "", test: str = "u >= 0 AND v >= 0 AND u < 400 AND v < 300") -> str:
    u = f"({t}c*({px}-{t}x)+{t}s*({py}-{t}y)+200)"
    v = f"({t}c*({py}-{t}y)-{t}s*({px}-{t}x)+150)"
    return "(" + " AND ".join(w.replace("u", u).replace("v", v) if w[0] in "uv" else w for w in test.split(" AND ")) + ")"


SELECTED = f"""{FRAMES}, {_cells(64, 1)}, pr AS (SELECT frame, sharpness, cell_col, cell_row, k, cx0+(k%8+0.5)/8*(cx1-cx0) AS px, cy0+(k//8+0.5)/8*(cy1-cy0) AS py, x, y, c, s FROM cells, range(64) t(k)),
    rk AS (SELECT frame, row_number() OVER (PARTITION BY cell_col, cell_row, k ORDER BY sharpness DESC NULLS LAST, frame) AS rank FROM pr WHERE {_holds('px', 'py')}),
    sel AS (SELECT DISTINCT frame FROM rk WHERE rank <= 4)"""


def _frames(spark, folder):
    return sky(spark, folder).where("success")


@query("merge_frame_selection", f"{SELECTED} SELECT frame FROM sel")
def merge_frame_selection(spark, folder):
    return ops.merge_frames(PLANE, _frames(spark, folder), 3)


@query("merge_bounds_estimate", f"""{FRAMES} SELECT x0 AS min_x, y0 AS min_y, x1 AS max_x, y1 AS max_y, ceil((x1-x0)/2048)::BIGINT AS columns, ceil((y1-y0)/2048)::BIGINT AS rows,
    (ceil((x1-x0)/2048)*ceil((y1-y0)/2048))::BIGINT AS tiles, (x1-x0)*(y1-y0)*4 AS bytes FROM bd""")
def merge_bounds_estimate(spark, folder):
    return ops.estimate(ops.bounds(PLANE.extent(_frames(spark, folder))))


@query("approx_top_frames", f"""{FRAMES}, {_cells(64)}, r AS (SELECT frame, row_number() OVER (PARTITION BY cell_col, cell_row ORDER BY sharpness DESC NULLS LAST, frame) AS k FROM cells WHERE {_holds('(cx0+32)', '(cy0+32)')})
    SELECT DISTINCT frame FROM r WHERE k <= 3""")
def approx_top_frames(spark, folder):
    return ops.top_frames(PLANE, _frames(spark, folder), 3)


_CLOSED = "u >= -1e-7 AND v >= -1e-7 AND u <= 400.0000001 AND v <= 300.0000001"
BLOCKS = f"""{FRAMES}, {_cells(60)}, m AS (SELECT * FROM cells WHERE lx < cx1 AND hx > cx0 AND ly < cy1 AND hy > cy0),
    w AS (SELECT frame, sharpness, cell_col, cell_row, {' AND '.join(_holds(a, b, '', _CLOSED) for a in ('cx0', 'cx1') for b in ('cy0', 'cy1'))} AS whole FROM m),
    rb AS (SELECT *, row_number() OVER (PARTITION BY cell_col, cell_row, whole ORDER BY sharpness DESC NULLS LAST, frame) AS rank FROM w)"""


@query("reduce_by_blocks", f"{BLOCKS} SELECT DISTINCT frame FROM rb WHERE whole AND rank <= 3")
def reduce_by_blocks(spark, folder):
    return ops.reduced_frames(ops.block_ranks(PLANE, _frames(spark, folder)))


@query("block_summary", f"""{BLOCKS}, c AS (SELECT cell_col, cell_row, count(CASE WHEN whole AND rank <= 3 THEN 1 END) AS n FROM rb GROUP BY ALL)
    SELECT count(*) AS blocks, count(CASE WHEN n < 3 THEN 1 END) AS short_blocks, count(CASE WHEN n = 0 THEN 1 END) AS uncovered_blocks FROM c""")
def block_summary(spark, folder):
    return ops.block_summary(ops.block_ranks(PLANE, _frames(spark, folder)))


TILES = f"{FRAMES}, {_cells(512, 1)}, tl AS (SELECT cell_row, cell_col, count(*) AS frames, min(frame) AS first_frame, list(frame ORDER BY sharpness DESC NULLS LAST, frame)[1:8] AS sharpest FROM cells GROUP BY ALL)"


@query("tile_plan", f"{TILES} SELECT * FROM tl")
def tile_plan(spark, folder):
    return ops.tiles(PLANE, _frames(spark, folder), 512)


@query("tiff_parts", f"{TILES} SELECT (cell_row // 3)::BIGINT AS part, count(*) AS tiles, min(cell_row) AS first_row, max(cell_row) AS last_row FROM tl GROUP BY 1")
def tiff_parts(spark, folder):
    return ops.tile_parts(ops.tiles(PLANE, _frames(spark, folder), 512), 3)


def _apart(a: str, b: str) -> str:
    cos, sin = f"abs({a}.c*{b}.c+{a}.s*{b}.s)", f"abs({a}.s*{b}.c-{a}.c*{b}.s)"
    dx, dy = f"({b}.x-{a}.x)", f"({b}.y-{a}.y)"
    return " OR ".join(f"abs({dx}*{p}.c+{dy}*{p}.s) >= 200+200*{cos}+150*{sin} OR abs({dy}*{p}.c-{dx}*{p}.s) >= 150+200*{sin}+150*{cos}" for p in (a, b))


@query("polygon_overlap", f"""{FRAMES}, n AS (SELECT track, frame, {{'x': x, 'y': y, 'c': c, 's': s}} AS b, lag({{'x': x, 'y': y, 'c': c, 's': s}}) OVER (PARTITION BY track ORDER BY frame) AS a FROM e)
    SELECT track, frame, NOT ({_apart('a', 'b')}) AS overlaps FROM n WHERE a IS NOT NULL""")
def polygon_overlap(spark, folder):
    rows = PLANE.extent(_frames(spark, folder)).select("track", "frame", *[F.col(c).alias(f"b_{c}") for c in "xycs"])
    by = Window.partitionBy("track").orderBy("frame")
    both = rows.select("*", *[F.lag(f"b_{c}").over(by).alias(f"a_{c}") for c in "xycs"]).where("a_x IS NOT NULL")
    return both.select("track", "frame", (~ops.apart(PLANE, "a_", "b_")).alias("overlaps"))


@query("overlap_pairs", f"""{SELECTED}, f AS (SELECT e.* FROM e JOIN sel USING (frame)),
    cl AS (SELECT frame, i, j FROM f, unnest(range(floor(lx/400)::BIGINT, floor(hx/400)::BIGINT+1)) a(i), unnest(range(floor(ly/400)::BIGINT, floor(hy/400)::BIGINT+1)) b(j)),
    kr AS (SELECT *, row_number() OVER (PARTITION BY i, j ORDER BY frame) AS k FROM cl),
    cand AS (SELECT DISTINCT a.frame AS a, b.frame AS b, 0 AS kind FROM kr a JOIN kr b USING (i, j) WHERE a.k < b.k AND (a.k = 1 OR b.k-a.k <= 31)
             UNION ALL SELECT a, b, 1 FROM (SELECT lag(frame) OVER (ORDER BY frame) AS a, frame AS b FROM f) WHERE a IS NOT NULL),
    ov AS (SELECT c.a, c.b, c.kind, p.x AS fa_x, p.y AS fa_y, p.c AS fa_c, p.s AS fa_s, q.x AS fb_x, q.y AS fb_y, q.c AS fb_c, q.s AS fb_s, greatest(p.lx, q.lx) AS bx0, least(p.hx, q.hx) AS bx1, greatest(p.ly, q.ly) AS by0, least(p.hy, q.hy) AS by1
           FROM cand c JOIN f p ON p.frame = c.a JOIN f q ON q.frame = c.b WHERE NOT ({_apart('p', 'q')})),
    pb AS (SELECT a, b, kind, fa_x, fa_y, fa_c, fa_s, fb_x, fb_y, fb_c, fb_s, bx0+(k%16+0.5)*(bx1-bx0)/16 AS px, by0+(k//16+0.5)*(by1-by0)/16 AS py FROM (SELECT *, unnest(range(256)) AS k FROM ov)),
    su AS (SELECT a, b, kind, count(*) AS support FROM pb WHERE {_holds('px', 'py', 'fa_')} AND {_holds('px', 'py', 'fb_')} GROUP BY ALL HAVING count(*) >= 4),
    rn AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY support DESC, a) AS k FROM su WHERE kind = 0)
    SELECT a AS reference, b AS current, true AS temporal, support FROM su WHERE kind = 1
    UNION ALL SELECT a, b, false, support FROM rn WHERE k <= 4 AND NOT EXISTS (SELECT 1 FROM su t WHERE t.kind = 1 AND t.a = rn.a AND t.b = rn.b)""")
def overlap_pairs(spark, folder):
    frames = _frames(spark, folder)
    pairs = ops.overlap_pairs(PLANE, frames.join(ops.merge_frames(PLANE, frames, 3), "frame", "left_semi"))
    return pairs.select("reference", "current", (F.col("kind") == "temporal").alias("temporal"), "support")


NEIGHBOURS = f"""WITH {PATH}, g AS (SELECT video_id, frame, x, y FROM path WHERE x IS NOT NULL),
    n AS (SELECT a.video_id, a.frame AS ask, b.frame AS near, (b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y) AS d, least(a.frame, b.frame) AS reference, greatest(a.frame, b.frame) AS current
          FROM g a JOIN g b ON b.video_id = a.video_id AND b.frame <> a.frame AND (b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y) < 16)"""


@query("nearest_frames", f"""{NEIGHBOURS}, r AS (SELECT *, row_number() OVER (PARTITION BY video_id, ask ORDER BY d, near) AS place FROM n)
    SELECT video_id, ask, near, place, round(sqrt(d), 4) AS distance FROM r WHERE place <= 3""")
def nearest_frames(spark, folder):
    return rounded(ops.nearest(path(spark, folder).where("x IS NOT NULL"), "frame", ["video_id"], 3, 4.0))


@query("fine_pairs", f"""{NEIGHBOURS}, dl AS (SELECT video_id, frame AS reference, frame + 1 AS current FROM path WHERE success = false),
    kn AS (SELECT video_id, least(frame, matched) AS reference, greatest(frame, matched) AS current, max(1 + frame % 8) AS weight FROM path WHERE accepted AND matched <> frame GROUP BY ALL),
    m AS (SELECT n.*, weight FROM n ANTI JOIN dl USING (video_id, reference, current) LEFT JOIN kn USING (video_id, reference, current)),
    r AS (SELECT *, row_number() OVER (PARTITION BY video_id, ask ORDER BY d, near) AS place, row_number() OVER (PARTITION BY video_id, ask ORDER BY weight DESC NULLS LAST, d, near) AS strong FROM m)
    SELECT DISTINCT video_id, reference, current FROM r WHERE place <= 3 OR (strong = 1 AND weight IS NOT NULL)""")
def fine_pairs(spark, folder):
    p = path(spark, folder)
    known = p.where("accepted AND matched != frame").groupBy("video_id", F.least("frame", "matched").alias("reference"), F.greatest("frame", "matched").alias("current")).agg(F.max(1 + F.col("frame") % 8).alias("weight"))
    barred = p.where("success = false").select("video_id", F.col("frame").alias("reference"), (F.col("frame") + 1).alias("current"))
    return ops.fine_pairs(p.where("x IS NOT NULL"), known, barred, "frame", ["video_id"], 3, 4.0)


@query("mutual_nearest", f"""WITH {OBSERVATIONS}, o AS (SELECT frame_id, lead(frame_id) OVER (PARTITION BY video_id ORDER BY frame_id) AS nxt FROM obs),
    d AS (SELECT a.frame_id, a.pos AS a, b.pos AS b, (b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y) AS d FROM o JOIN pts a ON a.frame_id = o.frame_id JOIN pts b ON b.frame_id = o.nxt),
    r AS (SELECT *, row_number() OVER (PARTITION BY frame_id, a ORDER BY d, b) AS ka, row_number() OVER (PARTITION BY frame_id, b ORDER BY d, a) AS kb FROM d WHERE d <= 192*192)
    SELECT frame_id, a, b, round(sqrt(d), 4) AS distance FROM r WHERE ka = 1 AND kb = 1""")
def mutual_nearest(spark, folder):
    pts = points(spark, folder)
    frames = table(spark, folder, "frames").select("frame_id", "video_id").distinct()
    nxt = frames.select(F.lead("frame_id").over(Window.partitionBy("video_id").orderBy("frame_id")).alias("nxt"), "frame_id").where("nxt IS NOT NULL")
    left = pts.select("frame_id", F.col("pos").cast("long").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    right = pts.select(F.col("frame_id").alias("nxt"), F.col("pos").cast("long").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by")).join(nxt, "nxt").drop("nxt")
    return rounded(ops.mutual_nearest(left, right, ["frame_id"], 192.0))


@query("mask_lookup", f"""WITH {OBSERVATIONS}, m AS (SELECT i AS mask_col, j AS mask_row, (i*7+j*3) % 3 AS value FROM range(90) a(i), range(60) b(j)),
    p AS (SELECT frame_id, floor(x/24)::BIGINT AS mask_col, floor(y/24)::BIGINT AS mask_row FROM pts)
    SELECT frame_id, count(CASE WHEN value = 1 THEN 1 END) AS searched, count(CASE WHEN value = 2 THEN 1 END) AS forbidden, count(*) AS points FROM p LEFT JOIN m USING (mask_col, mask_row) GROUP BY frame_id""")
def mask_lookup(spark, folder):
    mask = spark.range(90).withColumnRenamed("id", "mask_col").crossJoin(spark.range(60).withColumnRenamed("id", "mask_row")).withColumn("value", (F.col("mask_col") * 7 + F.col("mask_row") * 3) % 3)
    placed = points(spark, folder).select("frame_id", F.floor(F.col("x") / 24).alias("mask_col"), F.floor(F.col("y") / 24).alias("mask_row"))
    # A mask has one row for each cell of one picture.
    found = placed.join(F.broadcast(mask), ["mask_col", "mask_row"], "left")
    return found.groupBy("frame_id").agg(F.count(F.when(F.col("value") == 1, 1)).alias("searched"), F.count(F.when(F.col("value") == 2, 1)).alias("forbidden"), F.count("*").alias("points"))
