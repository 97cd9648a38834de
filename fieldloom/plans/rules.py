"""Queries on scalar rules: orientations, colours, sizes, keys, acceptance."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.adapters import OBSERVATIONS, PATH, PIXELS, observations, path, pixels, points, rounded, sql_rounded, table
from fieldloom.functions import geometry as G
from fieldloom.functions import image, keys
from fieldloom.plans.registry import query


@query("video_orientation", """WITH m AS (SELECT video_id, width AS w, height AS h, [1,0,-1,0,1,-1,0,2][video_id % 8 + 1] AS a, [0,1,0,-1,0,0,1,0][video_id % 8 + 1] AS b, [0,-1,0,1,0,0,1,0][video_id % 8 + 1] AS c, [1,0,-1,0,-1,1,0,1][video_id % 8 + 1] AS d FROM videos),
    k AS (SELECT *, [0, a*w, c*h, a*w+c*h] AS xs, [0, b*w, d*h, b*w+d*h] AS ys FROM m WHERE abs(a)+abs(b) = 1 AND abs(c)+abs(d) = 1 AND abs(a*d-b*c) = 1)
    SELECT video_id, -list_min(xs) AS shift_x, -list_min(ys) AS shift_y, list_max(xs)-list_min(xs) AS width, list_max(ys)-list_min(ys) AS height, NOT (a = 1 AND b = 0 AND c = 0 AND d = 1) AS moved FROM k""")
def video_orientation(spark, folder):
    pick = lambda *v: F.get(F.array(*map(F.lit, v)), (F.col("video_id") % 8).cast("int"))
    turned = G.orientation(pick(1, 0, -1, 0, 1, -1, 0, 2), pick(0, 1, 0, -1, 0, 0, 1, 0), pick(0, -1, 0, 1, 0, 0, 1, 0), pick(1, 0, -1, 0, -1, 1, 0, 1), F.col("width"), F.col("height"))
    return table(spark, folder, "videos").select("video_id", turned.alias("o")).where("o IS NOT NULL").select("video_id", "o.*")


@query("grid_place", f"""WITH {OBSERVATIONS}, t AS (SELECT frame_id, pos, col, row, (frame_id % 7)/10.0::DOUBLE AS a FROM pts)
    SELECT frame_id, pos::INT AS pos, {sql_rounded('40*(cos(a)*col - sin(a)*row) + frame_id % 5')} AS x, {sql_rounded('40*(sin(a)*col + cos(a)*row) - frame_id % 3')} AS y FROM t""")
def grid_place(spark, folder):
    f = F.col("frame_id")
    x, y = G.grid_place(F.col("col"), F.col("row"), f % 5, -(f % 3), (f % 7) / 10.0, F.lit(40.0))
    return rounded(points(spark, folder).select("frame_id", "pos", x.alias("x"), y.alias("y")), shift=0.123)


@query("inside_convex", f"""WITH {OBSERVATIONS}, q AS (SELECT frame_id, pos, x, y, [1000, 2500 + (frame_id % 9)*50, 2400, 900] AS px, [300, 500, 1700, 1500 - (frame_id % 4)*40] AS py FROM pts),
    s AS (SELECT frame_id, pos, unnest([(px[i%4+1]-px[i])*(y-py[i]) - (py[i%4+1]-py[i])*(x-px[i]) FOR i IN range(1, 5)]) AS t FROM q)
    SELECT frame_id, pos::INT AS pos, count(DISTINCT CASE WHEN abs(t) >= 1e-7 THEN sign(t) END) = 1 AS inside FROM s GROUP BY frame_id, pos""")
def inside_convex(spark, folder):
    f = F.col("frame_id")
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    shape = F.array(corner(F.lit(1000), F.lit(300)), corner(2500 + f % 9 * 50, F.lit(500)), corner(F.lit(2400), F.lit(1700)), corner(F.lit(900), 1500 - f % 4 * 40))
    return points(spark, folder).withColumn("shape", shape).select("frame_id", "pos", G.inside_convex(F.col("shape"), F.col("x"), F.col("y")).alias("inside"))


_T = "(({1}.x-{0}.x)*({2}.y-{0}.y)-({1}.y-{0}.y)*({2}.x-{0}.x))"


@query("segment_crossings", f"""WITH {PATH}, g AS (SELECT video_id, frame, {{'x': x, 'y': y}} AS p FROM path WHERE x IS NOT NULL), s AS (SELECT video_id, frame, lag(p, 3) OVER w AS a, lag(p, 2) OVER w AS b, lag(p) OVER w AS c, p AS d FROM g WINDOW w AS (PARTITION BY video_id ORDER BY frame))
    SELECT video_id, frame, {_T.format('a', 'b', 'c')}*{_T.format('a', 'b', 'd')} < -1e-10 AND {_T.format('c', 'd', 'a')}*{_T.format('c', 'd', 'b')} < -1e-10 AS crosses FROM s WHERE a IS NOT NULL""")
def segment_crossings(spark, folder):
    from pyspark.sql import Window

    by = Window.partitionBy("video_id").orderBy("frame")
    p = path(spark, folder).where("x IS NOT NULL").select("video_id", "frame", F.struct("x", "y").alias("d"))
    rows = p.select("video_id", "frame", *[F.lag("d", k).over(by).alias(n) for k, n in ((3, "a"), (2, "b"), (1, "c"))], "d").where("a IS NOT NULL")
    return rows.select("video_id", "frame", G.segments_cross(*[F.col(n) for n in "abcd"]).alias("crosses"))


@query("selection_distance", f"""WITH {PATH} SELECT video_id, frame, {sql_rounded('sqrt(greatest(0, -x, x-400)**2 + greatest(0, -y, y-300)**2)')} AS distance FROM path WHERE x IS NOT NULL""")
def selection_distance(spark, folder):
    p = path(spark, folder).where("x IS NOT NULL")
    return rounded(p.select("video_id", "frame", G.rectangle_distance(F.col("x"), F.col("y"), 400.0, 300.0).alias("distance")), shift=0.123)


@query("search_radii", """WITH RECURSIVE v AS (SELECT video_id, (8 + video_id % 5)::BIGINT AS r, greatest(8 + video_id % 5, ceil(sqrt((width*width+height*height)::DOUBLE)*0.8))::BIGINT AS m, video_id % 3 <> 0 AS s FROM videos),
    w AS (SELECT video_id, 0 AS place, r, m, s FROM v UNION ALL SELECT video_id, place+1, least(m, r*2), m, s FROM w WHERE s AND r < m) SELECT video_id, place, r AS radius FROM w""")
def search_radii(spark, folder):
    v = F.col("video_id")
    radii = G.search_radii(8 + v % 5, F.col("width").cast("double"), F.col("height").cast("double"), v % 3 != 0)
    return table(spark, folder, "videos").select("video_id", F.posexplode(radii).alias("place", "radius"))


@query("field_colour", f"""WITH {PATH} SELECT video_id, frame, floor(127.5*(1+greatest(-1, least(1, (x-200)/500)))+0.5)::BIGINT AS red, floor(127.5*(1+greatest(-1, least(1, (y-100)/500)))+0.5)::BIGINT AS blue FROM path WHERE x IS NOT NULL""")
def field_colour(spark, folder):
    p = path(spark, folder).where("x IS NOT NULL").select("video_id", "frame", image.field_colour(F.col("x") - 200, F.col("y") - 100, 500.0).alias("c"))
    return p.select("video_id", "frame", F.col("c")[0].alias("red"), F.col("c")[2].alias("blue"))


@query("deviation_colour", "SELECT video_id, 'hsl(' || round(120*(1-greatest(0, least(1, (video_id % 13)/10.0::DOUBLE))), 3)::VARCHAR || ' 75% 45%)' AS colour FROM videos")
def deviation_colour(spark, folder):
    return table(spark, folder, "videos").select("video_id", image.deviation_colour((F.col("video_id") % 13) / 10.0).alias("colour"))


@query("refit_parameters", f"""WITH p AS (SELECT video_id, least(1, greatest(-1, coalesce(CASE WHEN video_id % 4 > 0 THEN (video_id % 7 - 3)/2.0::DOUBLE END, 0))) AS brightness, least(4, greatest(0.1, fps/10)) AS contrast, least(4, greatest(0.1, (video_id % 11)/2.0::DOUBLE)) AS gamma,
      least(4, greatest(0, (video_id % 3)::DOUBLE)) AS r, least(4, greatest(0, (video_id % 6)::DOUBLE - 1)) AS g, CASE WHEN video_id % 2 = 0 THEN least(4, greatest(0, (video_id % 9)::DOUBLE)) ELSE 0.114 END AS b FROM videos)
    SELECT video_id, {sql_rounded('brightness')} AS brightness, {sql_rounded('contrast')} AS contrast, {sql_rounded('gamma')} AS gamma, {sql_rounded('r/CASE WHEN r+g+b = 0 THEN 1 ELSE r+g+b END')} AS red,
           {sql_rounded('g/CASE WHEN r+g+b = 0 THEN 1 ELSE r+g+b END')} AS green, {sql_rounded('b/CASE WHEN r+g+b = 0 THEN 1 ELSE r+g+b END')} AS blue FROM p""")
def refit_parameters(spark, folder):
    v = F.col("video_id")
    p = image.refit_parameters(F.when(v % 4 > 0, (v % 7 - 3) / 2.0), F.col("fps") / 10, (v % 11) / 2.0, (v % 3).cast("double"), (v % 6).cast("double") - 1, F.when(v % 2 == 0, (v % 9).cast("double")))
    return rounded(table(spark, folder, "videos").select("video_id", p.alias("p")).select("video_id", "p.*"), shift=0.123)


@query("detection_size", """WITH s AS (SELECT video_id, width AS w, height AS h, least(1.0::DOUBLE, 1600::DOUBLE/greatest(width, height)) AS k FROM videos)
    SELECT video_id, greatest(1, floor(w*k+0.5))::BIGINT AS width, greatest(1, floor(h*k+0.5))::BIGINT AS height FROM s""")
def detection_size(spark, folder):
    w, h = image.detection_size(F.col("width"), F.col("height"), 1600)
    return table(spark, folder, "videos").select("video_id", w.cast("long").alias("width"), h.cast("long").alias("height"))


@query("overlay_tile_size", """WITH e AS (SELECT video_id, least(4096, 8192, floor(sqrt((1610612736 - 17*width::BIGINT*height*(1 + video_id % 7))/24.0::DOUBLE))) AS e, 1610612736 - 17*width::BIGINT*height*(1 + video_id % 7) AS l FROM videos)
    SELECT video_id, CASE WHEN l > 0 AND e >= 512 THEN pow(2, floor(log2(e)))::BIGINT END AS edge FROM e""")
def overlay_tile_size(spark, folder):
    return table(spark, folder, "videos").select("video_id", image.overlay_tile_edge(F.col("width").cast("long"), F.col("height") * (1 + F.col("video_id") % 7)).alias("edge"))


@query("metric_scale", f"""WITH m AS (SELECT video_id, CASE WHEN video_id % 4 > 0 THEN (video_id % 4)/2.0::DOUBLE END AS mm, 30.0::DOUBLE + video_id % 9 AS s FROM videos) SELECT video_id, {sql_rounded('mm/s')} AS mm_per_pixel, {sql_rounded('25.4::DOUBLE*s/mm')} AS dpi FROM m""")
def metric_scale(spark, folder):
    mm, dpi = image.metric_scale((F.col("video_id") % 4) / 2.0, 30.0 + F.col("video_id") % 9)
    return rounded(table(spark, folder, "videos").select("video_id", mm.alias("mm_per_pixel"), dpi.alias("dpi")), shift=0.123)


@query("brightness_preview", f"""WITH {PIXELS}, g AS (SELECT image, i-1 AS pos, 0.5::DOUBLE + v/128.0::DOUBLE AS gain FROM (SELECT image, unnest(gray) AS v, generate_subscripts(gray, 1) AS i FROM pixels))
    SELECT image, pos::INT AS pos, floor(greatest(0, least(1, (1/gain-0.6::DOUBLE)/(1.4::DOUBLE-0.6::DOUBLE)))*255+0.5)::BIGINT AS gray FROM g WHERE pos % 13 > 0""")
def brightness_preview(spark, folder):
    rows = pixels(spark, folder).select("image", F.posexplode("gray").alias("pos", "v")).where("pos % 13 > 0")
    return rows.select("image", "pos", image.preview_gray(0.5 + F.col("v") / 128.0).cast("long").alias("gray"))


@query("gray_sampler", f"""WITH {PIXELS}, p AS (SELECT image, gray, (image % 71)/10.0::DOUBLE AS x, (image % 37)/5.0::DOUBLE AS y FROM pixels), q AS (SELECT *, floor(x)::INT AS i, floor(y)::INT AS j FROM p WHERE x < 7 AND y < 7)
    SELECT image, {sql_rounded('(1-(y-j))*((1-(x-i))*gray[j*8+i+1]+(x-i)*gray[j*8+i+2])+(y-j)*((1-(x-i))*gray[j*8+i+9]+(x-i)*gray[j*8+i+10])')} AS value FROM q""")
def gray_sampler(spark, folder):
    i = F.col("image")
    return rounded(pixels(spark, folder).select("image", image.bilinear(F.col("gray"), 8, (i % 71) / 10.0, (i % 37) / 5.0).alias("value")).where("value IS NOT NULL"), shift=0.123)


@query("geometry_key", """SELECT video_id, '{"width":' || width || ',"height":' || height || ',"name":' || coalesce(to_json(name)::VARCHAR, 'null') || ',"frames":' || coalesce(frame_count::VARCHAR, 'null') || '}' AS key FROM videos""")
def geometry_key(spark, folder):
    return table(spark, folder, "videos").select("video_id", keys.canonical("width", "height", "name", F.col("frame_count").alias("frames")).alias("key"))


@query("brightness_identity", "SELECT video_id, sha256('field:' || width || 'x' || height || ':' || coalesce(codec, '')) AS identity FROM videos")
def brightness_identity(spark, folder):
    text = F.concat(F.lit("field:"), "width", F.lit("x"), "height", F.lit(":"), F.coalesce("codec", F.lit("")))
    return table(spark, folder, "videos").select("video_id", keys.identity(text).alias("identity"))


@query("run_fingerprint", """WITH t AS (SELECT video_id, coalesce(name, '') || '|' || width || '|' || coalesce(frame_count::VARCHAR, '?') AS s FROM videos),
    h AS (SELECT video_id, len(s) AS n, list_reduce(list_transform(string_split(s, ''), lambda c: unicode(c)::BIGINT), lambda h, c: (xor(h, c)*16777619) % 4294967296, 2166136261::BIGINT) AS h FROM t)
    SELECT video_id, n || ':' || lower(hex(h)) AS fingerprint FROM h""")
def run_fingerprint(spark, folder):
    text = F.concat_ws("|", F.coalesce("name", F.lit("")), F.col("width").cast("string"), F.coalesce(F.col("frame_count").cast("string"), F.lit("?")))
    return table(spark, folder, "videos").select("video_id", keys.fingerprint(text).alias("fingerprint"))


@query("brightness_candidates", f"""WITH {OBSERVATIONS}, c AS (SELECT video_id, frame_id FROM obs WHERE enabled AND reason = 'usable board' AND len(points) >= 4)
    SELECT video_id, frame_id FROM c WHERE video_id IN (SELECT video_id FROM c GROUP BY video_id HAVING count(*) >= 5)""")
def brightness_candidates(spark, folder):
    from fieldloom.operators.observations import enough_frames

    usable = observations(spark, folder).where("enabled AND reason = 'usable board' AND size(points) >= 4").select("video_id", "frame_id")
    return enough_frames(usable, "video_id", 5)


@query("observation_order", f"WITH {OBSERVATIONS} SELECT video_id, frame_id, row_number() OVER (PARTITION BY video_id ORDER BY enabled DESC NULLS LAST, frame_id) AS place FROM obs")
def observation_order(spark, folder):
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("video_id").orderBy(F.col("enabled").desc_nulls_last(), "frame_id"))
    return observations(spark, folder).select("video_id", "frame_id", place.alias("place"))


@query("reference_candidates", f"""WITH {OBSERVATIONS}, t AS (SELECT video_id, frame_id, len(points) AS n, frame_id = min(frame_id) OVER (PARTITION BY video_id) AS preferred FROM obs WHERE enabled AND role = 'train' AND len(points) >= 6)
    SELECT video_id, frame_id, row_number() OVER (PARTITION BY video_id ORDER BY preferred DESC, n DESC, frame_id) AS place FROM t""")
def reference_candidates(spark, folder):
    from fieldloom.operators.observations import reference_order

    train = observations(spark, folder).where("enabled AND role = 'train' AND size(points) >= 6")
    before = train.groupBy("video_id").agg(F.min("frame_id").alias("preferred"))
    return reference_order(train, before)
