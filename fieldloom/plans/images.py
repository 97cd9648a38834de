"""Queries on pictures, fields and pixel rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fieldloom.adapters import OBSERVATIONS, PIXELS, pixels, points, rounded, sql_rounded, table
from fieldloom.functions import image, spline
from fieldloom.operators import images as ops
from fieldloom.plans.registry import query

OPEN = f"WITH {PIXELS}, px AS (SELECT image, source, (i-1)//8 AS row, (i-1)%8 AS col, g AS v FROM (SELECT image, source, unnest(gray) AS g, generate_subscripts(gray, 1) AS i FROM pixels))"


def _open(spark, folder):
    rows = pixels(spark, folder).select("image", "source", F.posexplode("gray").alias("p", "v"))
    return rows.select("image", "source", F.floor(F.col("p") / 8).cast("int").alias("row"), (F.col("p") % 8).alias("col"), "v")


@query("sharpness_grid", f"""{OPEN}, l AS (SELECT c.image, c.v, 4*c.v-u.v-d.v-l.v-r.v AS lap FROM px c JOIN px u ON u.image = c.image AND u.row = c.row-1 AND u.col = c.col JOIN px d ON d.image = c.image AND d.row = c.row+1 AND d.col = c.col
      JOIN px l ON l.image = c.image AND l.row = c.row AND l.col = c.col-1 JOIN px r ON r.image = c.image AND r.row = c.row AND r.col = c.col+1)
    SELECT image, {sql_rounded('var_pop(lap)')} AS variance, {sql_rounded('stddev_pop(v)')} AS contrast FROM l GROUP BY image""")
def sharpness_grid(spark, folder):
    return rounded(ops.sharpness(pixels(spark, folder), "image", "gray", 8), shift=0.123)


@query("gray_pyramid", f"""{OPEN}, h AS (SELECT image, row//2 AS row, col//2 AS col, (sum(v)+2)//4 AS v FROM px GROUP BY ALL) SELECT image, list(v::INT ORDER BY row, col) AS gray FROM h GROUP BY image""")
def gray_pyramid(spark, folder):
    return ops.half_size(pixels(spark, folder), "image", "gray", 8)


@query("ncc_correlation", f"""{OPEN}, n AS (SELECT image, lead(image) OVER (PARTITION BY source ORDER BY image) AS nxt FROM pixels), p AS (SELECT n.image, a.v::DOUBLE AS a, b.v::DOUBLE AS b FROM n JOIN px a ON a.image = n.image JOIN px b ON b.image = n.nxt AND b.row = a.row AND b.col = a.col)
    SELECT image, count(*) AS n, {sql_rounded('corr(a, b)')} AS score, {sql_rounded('regr_slope(b, a)')} AS gain, {sql_rounded('regr_intercept(b, a)')} AS bias FROM p GROUP BY image HAVING count(*) >= 16 AND least(var_pop(a), var_pop(b)) >= 4""")
def ncc_correlation(spark, folder):
    return rounded(ops.correlation(_next(spark, folder).select("image", F.inline(F.arrays_zip("a", "b"))), ["image"], "a", "b"), shift=0.123)


def _next(spark, folder):
    by = Window.partitionBy("source").orderBy("image")
    return pixels(spark, folder).select("image", F.col("gray").alias("a"), F.lead("gray").over(by).alias("b")).where("b IS NOT NULL")


@query("patch_shift")
def patch_shift(spark, folder):
    return rounded(ops.shifts(_next(spark, folder), "image", 8))


@query("hamming_match", """WITH s AS (SELECT vec_id AS item, list_sum(list_transform(range(32), lambda i: CASE WHEN embedding[i+1] > 0 THEN 1::BIGINT << i ELSE 0 END))::BIGINT AS a,
      list_sum(list_transform(range(32), lambda i: CASE WHEN embedding[i+33] > 0 THEN 1::BIGINT << i ELSE 0 END))::BIGINT AS b FROM embeddings),
    d AS (SELECT q.item AS ask, s.item AS near, bit_count(xor(q.a, s.a)) + bit_count(xor(q.b, s.b)) AS bits FROM s q JOIN s ON q.item <> s.item WHERE q.item % 20 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY ask ORDER BY bits, near) AS k FROM d) SELECT ask, near, bits::INT AS bits FROM r WHERE k = 1""")
def hamming_match(spark, folder):
    word = lambda start: F.expr(f"aggregate(sequence(0, 31), 0L, (s, i) -> s | if(embedding[i + {start}] > 0, shiftleft(1L, i), 0L))")
    bits = table(spark, folder, "embeddings").select(F.col("vec_id").alias("item"), word(0).alias("a"), word(32).alias("b"))
    # A stated query set against all rows: best per ask is a partial aggregate, so no pair is shuffled.
    asks = bits.where("item % 20 = 0").withColumnsRenamed({"item": "ask", "a": "qa", "b": "qb"})
    far = ops.hamming(F.col("a"), F.col("qa")) + ops.hamming(F.col("b"), F.col("qb"))
    best = bits.join(asks, F.col("item") != F.col("ask")).groupBy("ask").agg(F.min(F.struct(far.alias("bits"), F.col("item").alias("near"))).alias("m"))
    return best.select("ask", "m.near", "m.bits")


@query("capped_blend", f"""{OPEN}, a AS (SELECT source, row, col, image, v::DOUBLE AS v, (1 + image % 4)/4.0::DOUBLE AS alpha FROM px), t AS (SELECT *, greatest(0, least(alpha, 2.5::DOUBLE - coalesce(sum(alpha) OVER (PARTITION BY source, row, col ORDER BY image ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS t FROM a)
    SELECT source, row::INT AS row, col::INT AS col, {sql_rounded('sum(v*t)/sum(t)')} AS value, {sql_rounded('sum(t)')} AS alpha FROM t GROUP BY source, row, col HAVING sum(t) > 0""")
def capped_blend(spark, folder):
    layers = _open(spark, folder).select("source", "row", "col", "image", F.col("v").cast("double").alias("value"), ((1 + F.col("image") % 4) / 4.0).alias("alpha"))
    return rounded(ops.capped_blend(layers, ["source", "row", "col"], "image", 2.5), shift=0.123)


@query("field_smooth", f"""{OPEN}, n AS (SELECT c.image, c.row, c.col, c.v, avg(o.v) AS m FROM px c LEFT JOIN px o ON o.image = c.image AND abs(o.row-c.row)+abs(o.col-c.col) = 1 GROUP BY ALL)
    SELECT image, row::INT AS row, col::INT AS col, {sql_rounded('v + 0.08::DOUBLE*(coalesce(m, v)-v)')} AS value FROM n""")
def field_smooth(spark, folder):
    cells = _open(spark, folder).select("image", "row", "col", F.col("v").cast("double").alias("value"))
    return rounded(ops.smoothed(cells, ["image"]), shift=0.123)


@query("edge_feather", f"""WITH {OBSERVATIONS}, t AS (SELECT frame_id, pos, greatest(0, least(1, least(x+0.5, 2160-x-0.5, y+0.5, 1440-y-0.5)/216)) AS t FROM pts) SELECT frame_id, pos::INT AS pos, {sql_rounded('t*t*(3-2*t)')} AS weight FROM t""")
def edge_feather(spark, folder):
    return rounded(points(spark, folder).select("frame_id", "pos", image.edge_weight(F.col("x"), F.col("y"), 2160, 1440).alias("weight")), shift=0.123)


@query("srgb_gain", f"""{OPEN}, l AS (SELECT image, row, col, v, CASE WHEN v/255 <= 0.04045 THEN v/255/12.92 ELSE pow((v/255+0.055)/1.055, 2.4) END * (0.5 + col*0.1) AS g FROM px), m AS (SELECT *, least(1, greatest(0, g)) AS c FROM l)
    SELECT image, row::INT AS row, col::INT AS col, CASE WHEN (row+col) % 5 = 0 THEN v ELSE floor(CASE WHEN c <= 0.0031308 THEN c*12.92 ELSE 1.055*pow(c, 1/2.4)-0.055 END*255+0.5) END::BIGINT AS v FROM m""")
def srgb_gain(spark, folder):
    alpha = F.when((F.col("row") + F.col("col")) % 5 == 0, 0).otherwise(255)
    return _open(spark, folder).select("image", "row", "col", image.with_gain(F.col("v"), 0.5 + F.col("col") * 0.1, alpha).cast("long").alias("v"))


@query("refit_gray", f"""{OPEN} SELECT image, row::INT AS row, col::INT AS col, {sql_rounded('255*pow(least(1, greatest(0, ((0.299*v+0.587*(255-v)+0.114*col*30)/255::DOUBLE-0.5)*1.5+0.6)), 1/1.8)')} AS gray FROM px""")
def refit_gray(spark, folder):
    v = F.col("v")
    return rounded(_open(spark, folder).select("image", "row", "col", image.refit_gray(v, 255 - v, F.col("col") * 30, (0.299, 0.587, 0.114), 1.5, 0.1, 1.8).alias("gray")), shift=0.123)


@query("spline_basis", f"""WITH {OBSERVATIONS}, t AS (SELECT frame_id, pos, x/300 - floor(x/300) AS t FROM pts)
    SELECT frame_id, pos::INT AS pos, {sql_rounded('pow(1-t, 3)/6')} AS b0, {sql_rounded('(3*pow(t, 3)-6*t*t+4)/6')} AS b1, {sql_rounded('(-3*pow(t, 3)+3*t*t+3*t+1)/6')} AS b2, {sql_rounded('pow(t, 3)/6')} AS b3 FROM t""")
def spline_basis(spark, folder):
    t = F.col("x") / 300 - F.floor(F.col("x") / 300)
    rows = points(spark, folder).select("frame_id", "pos", t.alias("t")).select("frame_id", "pos", spline.basis(F.col("t")).alias("b"))
    return rounded(rows.select("frame_id", "pos", *[F.col("b")[i].alias(f"b{i}") for i in range(4)]), shift=0.123)


@query("spline_evaluate", f"""WITH {OBSERVATIONS}, f AS (SELECT i AS cx, j AS cy, sin(i)*3 AS dx, cos(j)*2 + i*0.1 AS dy FROM range(12) a(i), range(10) b(j)),
    p AS (SELECT frame_id, pos, floor(x/300)::BIGINT AS iu, floor(y/300)::BIGINT AS iv, x/300-floor(x/300) AS u, y/300-floor(y/300) AS v FROM pts),
    w AS (SELECT *, [pow(1-u, 3)/6, (3*pow(u, 3)-6*u*u+4)/6, (-3*pow(u, 3)+3*u*u+3*u+1)/6, pow(u, 3)/6] AS a, [pow(1-v, 3)/6, (3*pow(v, 3)-6*v*v+4)/6, (-3*pow(v, 3)+3*v*v+3*v+1)/6, pow(v, 3)/6] AS b FROM p)
    SELECT frame_id, pos::INT AS pos, {sql_rounded('sum(a[i+1]*b[j+1]*dx)')} AS dx, {sql_rounded('sum(a[i+1]*b[j+1]*dy)')} AS dy FROM w, range(4) s(i), range(4) t(j), f WHERE f.cx = iu+i AND f.cy = iv+j GROUP BY frame_id, pos""")
def spline_evaluate(spark, folder):
    grid = spark.range(12).withColumnRenamed("id", "cx").crossJoin(spark.range(10).withColumnRenamed("id", "cy"))
    field = grid.select("cx", "cy", (F.sin("cx") * 3).alias("dx"), (F.cos("cy") * 2 + F.col("cx") * 0.1).alias("dy"))
    rows = points(spark, folder).select(F.struct("frame_id", "pos").alias("k"), "x", "y")
    return rounded(spline.evaluate(rows, F.broadcast(field), "k", "x", "y", 300.0).select("k.frame_id", "k.pos", "dx", "dy"), shift=0.123)
