"""Queries on masks and maps of pictures."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.adapters import OBSERVATIONS, PATH, PIXELS, path, pixels, points, rounded, sql_rounded
from fieldloom.operators import masks as ops
from fieldloom.plans.registry import query

GRID = ops.Grid(2160, 1440, 24)
MASK = "m AS (SELECT i AS mask_col, j AS mask_row, (i*7 + j*3 + i*j) % 11 AS k, CASE WHEN k < 2 THEN k + 1 ELSE 0 END AS value FROM range(90) a(i), range(60) b(j))"


def _mask(spark):
    k = (F.col("mask_col") * 7 + F.col("mask_row") * 3 + F.col("mask_col") * F.col("mask_row")) % 11
    return ops.empty(spark, GRID).withColumn("value", F.when(k < 2, k + 1).otherwise(0).cast("int"))


TOUCH = f"""WITH {OBSERVATIONS}, {MASK}, c AS (SELECT frame_id, pos, x, y, i AS mask_col, j AS mask_row FROM pts, unnest(range(greatest(0, floor((x-8)/24))::BIGINT, least(89, floor((x+8)/24))::BIGINT+1)) a(i), unnest(range(greatest(0, floor((y-8)/24))::BIGINT, least(59, floor((y+8)/24))::BIGINT+1)) b(j)),
    f AS (SELECT DISTINCT frame_id, pos FROM c JOIN m USING (mask_col, mask_row) WHERE value = 2)"""


@query("patch_touches", f"{TOUCH} SELECT frame_id, pos::INT AS pos FROM f")
def patch_touches(spark, folder):
    return ops.touching(points(spark, folder), _mask(spark), GRID, ["frame_id", "pos"], 16, ops.FORBIDDEN)


@query("patch_allowed", f"""{TOUCH} SELECT p.frame_id, p.pos::INT AS pos FROM pts p JOIN m ON m.mask_col = greatest(0, least(89, floor(p.x/24)))::BIGINT AND m.mask_row = greatest(0, least(59, floor(p.y/24)))::BIGINT
    WHERE m.value = 1 AND NOT EXISTS (SELECT 1 FROM f WHERE f.frame_id = p.frame_id AND f.pos = p.pos)""")
def patch_allowed(spark, folder):
    return ops.allowed(points(spark, folder), _mask(spark), GRID, ["frame_id", "pos"], 16, True).select("frame_id", "pos")


@query("mask_validation", f"""{TOUCH} SELECT p.frame_id, count(*) AS points, count(f.pos) AS invalid FROM pts p LEFT JOIN f ON f.frame_id = p.frame_id AND f.pos = p.pos GROUP BY p.frame_id""")
def mask_validation(spark, folder):
    p = points(spark, folder)
    bad = ops.touching(p, _mask(spark), GRID, ["frame_id", "pos"], 16, ops.FORBIDDEN).withColumn("bad", F.lit(True))
    return p.join(bad, ["frame_id", "pos"], "left").groupBy("frame_id").agg(F.count("*").alias("points"), F.count("bad").alias("invalid"))


@query("mask_paint", f"""WITH {MASK}, s AS (SELECT i AS step, (i*137) % 2200 AS x, (i*211) % 1500 AS y, 20 + (i*13) % 60 AS r, i % 3 AS v FROM range(40) t(i)),
    h AS (SELECT mask_col, mask_row, arg_max(v, step) AS new FROM m, s WHERE mask_col BETWEEN floor((x-r)/24) AND floor((x+r)/24) AND mask_row BETWEEN floor((y-r)/24) AND floor((y+r)/24) AND (greatest(mask_col*24, least(x, (mask_col+1)*24))-x)**2 + (greatest(mask_row*24, least(y, (mask_row+1)*24))-y)**2 <= r*r GROUP BY ALL)
    SELECT m.mask_col, m.mask_row, coalesce(new, value)::INT AS value FROM m LEFT JOIN h USING (mask_col, mask_row)""")
def mask_paint(spark, folder):
    i = F.col("id")
    strokes = spark.range(40).select(i.alias("step"), ((i * 137) % 2200).alias("x"), ((i * 211) % 1500).alias("y"), (20 + (i * 13) % 60).alias("radius"), (i % 3).cast("int").alias("value"))
    return ops.painted(_mask(spark), strokes, GRID)


@query("local_selection", f"""WITH {PATH}, s AS (SELECT video_id, frame, 1000 + x % 300 AS x, 700 + y % 300 AS y FROM path WHERE x IS NOT NULL AND abs(x) < 1e6 AND abs(y) < 1e6),
    c AS (SELECT i, j, least(2159.0::DOUBLE, (i+0.5::DOUBLE)*24) AS px, least(1439.0::DOUBLE, (j+0.5::DOUBLE)*24) AS py FROM range(90) a(i), range(60) b(j))
    SELECT video_id, frame, count(*) AS cells FROM s, c WHERE (px-x)*(px-x) + (py-y)*(py-y) <= 216.0::DOUBLE*216 GROUP BY ALL""")
def local_selection(spark, folder):
    p = path(spark, folder).where("x IS NOT NULL AND abs(x) < 1e6 AND abs(y) < 1e6").select("video_id", "frame", (1000 + F.col("x") % 300).alias("x"), (700 + F.col("y") % 300).alias("y"))
    return ops.around(p, GRID, 0.3).groupBy("video_id", "frame").agg(F.count("*").alias("cells"))


MAPS = "mp AS (SELECT i AS u, j AS v, i*2.1::DOUBLE + j*0.3::DOUBLE - 40 AS x, j*1.9::DOUBLE - i*0.2::DOUBLE + 30 AS y, (i*j) % 17 <> 3 AS valid FROM range(900) a(i), range(700) b(j))"


def _maps(spark):
    u, v = F.col("u"), F.col("v")
    grid = spark.range(900 * 700).select((F.col("id") % 900).alias("u"), F.floor(F.col("id") / 900).alias("v"))
    return grid.select("u", "v", (u * 2.1 + v * 0.3 - 40).alias("x"), (v * 1.9 - u * 0.2 + 30).alias("y"), ((u * v) % 17 != 3).alias("valid"))


@query("mask_remap", f"""WITH {MASK}, {MAPS}, c AS (SELECT i, j, least(899, floor((i+0.5)*4))::BIGINT AS u, least(699, floor((j+0.5)*4))::BIGINT AS v FROM range(225) a(i), range(175) b(j))
    SELECT c.i AS mask_col, c.j AS mask_row FROM c JOIN mp USING (u, v) JOIN m ON m.mask_col = least(89, floor(x/24))::BIGINT AND m.mask_row = least(59, floor(y/24))::BIGINT WHERE valid AND x >= 0 AND y >= 0 AND x < 2160 AND y < 1440 AND value = 1""")
def mask_remap(spark, folder):
    return ops.remapped(_mask(spark), GRID, _maps(spark), ops.Grid(900, 700))


@query("crop_maps", f"WITH {MAPS} SELECT u-100 AS u, v-50 AS v, {sql_rounded('x')} AS x, {sql_rounded('y')} AS y, valid FROM mp WHERE u BETWEEN 100 AND 399 AND v BETWEEN 50 AND 249")
def crop_maps(spark, folder):
    return rounded(ops.cropped(_maps(spark), 100, 50, 300, 200), shift=0.123)


@query("dense_remap", f"""WITH {PIXELS}, s AS (SELECT image, (i-1) % 8 AS px, (i-1)//8 AS py, g AS value, (image + i) % 19 > 0 AS allowed FROM (SELECT image, unnest(gray) AS g, generate_subscripts(gray, 1) AS i FROM pixels)),
    mp AS (SELECT image, u, v, u*0.9::DOUBLE + v*0.1::DOUBLE - (image % 5)*0.11::DOUBLE AS x, v*0.8::DOUBLE + (image % 3)*0.27::DOUBLE AS y, (u + v) % 5 > 0 AS valid FROM pixels, range(8) a(u), range(8) b(v)),
    c AS (SELECT image, u, v, floor(x)::BIGINT + a AS px, floor(y)::BIGINT + b AS py, abs(1-a-(x-floor(x)))*abs(1-b-(y-floor(y))) AS w FROM mp, range(2) s(a), range(2) t(b) WHERE valid)
    SELECT image, u, v, {sql_rounded('sum(w*value)')} AS value FROM c JOIN s USING (image, px, py) WHERE allowed GROUP BY image, u, v HAVING count(*) = 4""")
def dense_remap(spark, folder):
    p = pixels(spark, folder).select("image", F.posexplode("gray").alias("p", "value"))
    source = p.select("image", (F.col("p") % 8).cast("long").alias("px"), F.floor(F.col("p") / 8).alias("py"), "value", ((F.col("image") + F.col("p") + 1) % 19 > 0).alias("allowed"))
    each = pixels(spark, folder).select("image", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long"))).alias("k"))
    u, v, i = F.col("u"), F.col("v"), F.col("image")
    maps = each.select("image", (F.col("k") % 8).alias("u"), F.floor(F.col("k") / 8).alias("v")).select("image", "u", "v", (u * 0.9 + v * 0.1 - (i % 5) * 0.11).alias("x"), (v * 0.8 + (i % 3) * 0.27).alias("y"), ((u + v) % 5 > 0).alias("valid"))
    return rounded(ops.remap(maps, source, ["image"], "value"), shift=0.123)
