"""Queries on ordered choices and budgets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fieldloom.adapters import OBSERVATIONS, PATH, PIXELS, SKY, observations, path, pixels, points, rounded, sky, sql_rounded, table
from fieldloom.functions import image
from fieldloom.functions import pose as P
from fieldloom.operators import graph, network, observations as obs, planning
from fieldloom.operators import steps as ops
from fieldloom.plans.registry import query


@query("context_trigger", f"""WITH RECURSIVE {PATH}, r AS (SELECT video_id, frame, score, row_number() OVER (PARTITION BY video_id ORDER BY frame) AS i FROM path),
    w AS (SELECT video_id, i, frame AS last, true AS runs, frame FROM r WHERE i = 1 UNION ALL
          SELECT r.video_id, r.i, CASE WHEN r.frame - w.last >= 8 OR coalesce(r.score < 0.75, false) THEN r.frame ELSE w.last END, r.frame - w.last >= 8 OR coalesce(r.score < 0.75, false), r.frame FROM w JOIN r ON r.video_id = w.video_id AND r.i = w.i + 1)
    SELECT video_id, frame FROM w WHERE runs""")
def context_trigger(spark, folder):
    return ops.context_frames(path(spark, folder), "video_id", "frame", "score")


@query("bridge_budget", f"""WITH {PATH}, fl AS (SELECT DISTINCT video_id, matched AS reference, frame AS current FROM path WHERE accepted = false AND matched < frame),
    l AS (SELECT f.video_id, f.reference, f.current, lag(p.frame) OVER w AS a, p.frame AS b, count(*) OVER (PARTITION BY f.video_id, f.reference, f.current) - 1 AS n
      FROM fl f JOIN path p ON p.video_id = f.video_id AND p.frame BETWEEN f.reference AND f.current WINDOW w AS (PARTITION BY f.video_id, f.reference, f.current ORDER BY p.frame)),
    c AS (SELECT DISTINCT video_id, reference, current, n FROM l WHERE n >= 2), s AS (SELECT *, sum(n) OVER (PARTITION BY video_id ORDER BY n, reference, current ROWS UNBOUNDED PRECEDING) AS spent FROM c)
    SELECT l.video_id, l.reference, l.current, a AS "from", b AS "to" FROM l JOIN s ON s.video_id = l.video_id AND s.reference = l.reference AND s.current = l.current WHERE spent <= 40 AND a IS NOT NULL""")
def bridge_budget(spark, folder):
    p = path(spark, folder)
    failed = p.where("accepted = false AND matched < frame").select("video_id", F.col("matched").alias("reference"), F.col("frame").alias("current")).distinct()
    chains = planning.bridge_chains(failed, p, "video_id", "frame")
    return ops.within_budget(chains, ["video_id"], ["reference", "current"], "length", 40).select("video_id", "reference", "current", "from", "to")


@query("untried_skips", f"""WITH {PATH}, c AS (SELECT video_id, lag(frame) OVER w AS a, frame AS b, coalesce(NOT accepted, true) AS f FROM path WINDOW w AS (PARTITION BY video_id ORDER BY frame)),
    n AS (SELECT *, lag(a) OVER w AS before, lead(b) OVER w AS after FROM c WHERE a IS NOT NULL WINDOW w AS (PARTITION BY video_id ORDER BY a)),
    s AS (SELECT DISTINCT * FROM (SELECT video_id, before AS reference, b AS current FROM n WHERE f AND before IS NOT NULL UNION ALL SELECT video_id, a, after FROM n WHERE f AND after IS NOT NULL))
    SELECT * FROM s ANTI JOIN (SELECT video_id, matched AS reference, frame AS current FROM path) t USING (video_id, reference, current)""")
def untried_skips(spark, folder):
    p = path(spark, folder)
    chain = p.select("video_id", F.lag("frame").over(Window.partitionBy("video_id").orderBy("frame")).alias("reference"), F.col("frame").alias("current"), F.coalesce(~F.col("accepted"), F.lit(True)).alias("failed"))
    tried = p.where("matched IS NOT NULL").select("video_id", F.col("matched").alias("reference"), F.col("frame").alias("current"))
    return planning.skips(chain.where("reference IS NOT NULL"), ["video_id"], "reference", "current", "failed").join(tried, ["video_id", "reference", "current"], "left_anti")


@query("farthest_points")
def farthest_points(spark, folder):
    return ops.farthest_points(path(spark, folder).where("x IS NOT NULL"), "video_id", "frame", 6)


@query("intermediate_frames")
def intermediate_frames(spark, folder):
    p = path(spark, folder)
    return ops.intermediate_frames(p, p.where("frame % 10 = 0"), "video_id", "frame", 12)


@query("closure_confirmation", f"""WITH {PATH}, r AS (SELECT video_id, frame, coalesce(accepted, false) AS s, x % 50 AS x, y % 50 AS y, rotation, CASE WHEN frame % 6 = 0 THEN [[matched], [matched + 40]] ELSE [[matched]] END AS g FROM path WHERE x IS NOT NULL AND matched IS NOT NULL),
    b AS (SELECT *, lag(CASE WHEN s THEN {{'x': x, 'y': y, 'r': rotation, 'g': g}} END) OVER (PARTITION BY video_id ORDER BY frame) AS p FROM r),
    q AS (SELECT video_id, frame, len(g) >= 2 AS independent, coalesce(sqrt((x-p.x)**2+(y-p.y)**2)+abs(atan2(sin(rotation-p.r), cos(rotation-p.r)))*250 <= 6
          AND (SELECT bool_or(abs(u-v) <= 8) FROM unnest(flatten(p.g)) a(u), unnest(flatten(g)) c(v)), false) AS following FROM b WHERE s)
    SELECT video_id, frame, independent, following, independent OR following AS confirmed FROM q""")
def closure_confirmation(spark, folder):
    m = F.col("matched")
    groups = F.when(F.col("frame") % 6 == 0, F.array(F.array(m), F.array(m + 40))).otherwise(F.array(F.array(m)))
    rows = path(spark, folder).where("x IS NOT NULL AND matched IS NOT NULL").select("video_id", "frame", F.coalesce("accepted", F.lit(False)).alias("supported"), (F.col("x") % 50).alias("x"), (F.col("y") % 50).alias("y"), "rotation", groups.alias("groups"))
    return ops.confirmed_closures(rows, "video_id", "frame", 250.0, 6.0)


@query("measured_component", f"""WITH RECURSIVE {SKY}, e AS (SELECT track, least(frame, frame + 1 + frame % 7) AS a, frame + 1 + frame % 7 AS b FROM sky WHERE kind <> 'error' AND frame % 3 > 0),
    n AS (SELECT DISTINCT track, frame FROM sky), f AS (SELECT e.* FROM e JOIN n ON n.track = e.track AND n.frame = e.b), l AS (SELECT track, a, b FROM f UNION SELECT track, b, a FROM f),
    w(track, frame, label) USING KEY (track, frame) AS (SELECT track, frame, frame FROM n UNION
        SELECT w.track, l.b, min(w.label) FROM w JOIN l ON l.track = w.track AND l.a = w.frame JOIN recurring.w AS k ON k.track = l.track AND k.frame = l.b WHERE w.label < k.label GROUP BY w.track, l.b),
    s AS (SELECT track, label, count(*) AS c FROM w GROUP BY ALL), g AS (SELECT track, label, row_number() OVER (PARTITION BY track ORDER BY c DESC, label) AS k FROM s)
    SELECT w.track, w.frame, w.label FROM w JOIN g ON g.track = w.track AND g.label = w.label WHERE k = 1""")
def measured_component(spark, folder):
    rows = sky(spark, folder)
    edges = rows.where("kind != 'error' AND frame % 3 > 0").select("track", F.col("frame").alias("reference"), (F.col("frame") + 1 + F.col("frame") % 7).alias("current"))
    nodes = rows.select("track", "frame").distinct()
    inner = edges.join(nodes.withColumnRenamed("frame", "current"), ["track", "current"], "left_semi")
    return ops.largest_component(graph.components(nodes, inner, ["track"]), "track").select("track", "frame", "label")


@query("cycle_error", f"""WITH {PATH}, n AS (SELECT video_id, frame, x, y, rotation AS r, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(rotation) OVER w AS pr FROM path WHERE x IS NOT NULL WINDOW w AS (PARTITION BY video_id ORDER BY frame)),
    t AS (SELECT *, ((k % 16 + 0.5)/16 - 0.5)*400 AS u, ((k//16 + 0.5)/16 - 0.5)*300 AS v FROM n, range(256) g(k) WHERE px IS NOT NULL),
    d AS (SELECT video_id, frame, x, y, r, px, py, pr, sqrt((px+cos(pr)*u-sin(pr)*v-x-cos(r)*u+sin(r)*v)**2+(py+sin(pr)*u+cos(pr)*v-y-sin(r)*u-cos(r)*v)**2) AS e FROM t)
    SELECT video_id, frame, {sql_rounded('any_value(sqrt((x-px)**2+(y-py)**2))', 3)} AS shift, round(any_value(abs(atan2(sin(r-pr), cos(r-pr)))), 7) + 0.0 AS rotation, {sql_rounded('list_sort(list(e))[129]', 3)} AS median, {sql_rounded('sqrt(avg(e*e))', 3)} AS rms, {sql_rounded('quantile_cont(e, 0.95)', 3)} AS p95 FROM d GROUP BY video_id, frame""")
def cycle_error(spark, folder):
    own = P.pose("x", "y", "rotation")
    rows = path(spark, folder).where("x IS NOT NULL").select("video_id", "frame", own.alias("measured"), F.lag(own).over(Window.partitionBy("video_id").orderBy("frame")).alias("expected")).where("expected IS NOT NULL")
    return rounded(ops.cycle_errors(rows, 400.0, 300.0), 3, shift=0.123)


@query("spatial_consensus", f"""WITH {PATH}, v AS (SELECT DISTINCT ON (entry_no) video_id, frame, entry_no AS item, incremental_match.pose.x AS x, incremental_match.pose.y AS y, incremental_match.pose.rotation AS rotation, incremental_match.accepted AS ok FROM path_entries),
    u AS (SELECT * FROM v WHERE ok AND isfinite(x) AND isfinite(y) AND isfinite(rotation)), p AS (SELECT video_id, frame, 1.0::DOUBLE AS px, 2.0::DOUBLE AS py, 0.5::DOUBLE AS pr FROM path),
    nb AS (SELECT a.video_id, a.frame, a.item AS a, b.x, b.y, atan2(sin(b.rotation-0.5), cos(b.rotation-0.5)) AS dr FROM u a JOIN u b USING (video_id, frame) WHERE sqrt((b.x-a.x)**2+(b.y-a.y)**2) + abs(atan2(sin(b.rotation-a.rotation), cos(b.rotation-a.rotation)))*250 <= 4),
    st AS (SELECT video_id, frame, a, count(*) AS n, list_sort(list(x)) AS sx, list_sort(list(y)) AS sy, list_sort(list(dr)) AS sr FROM nb GROUP BY ALL), bs AS (SELECT *, row_number() OVER (PARTITION BY video_id, frame ORDER BY n DESC, a) AS k FROM st),
    tt AS (SELECT video_id, frame, count(*) AS votes FROM u GROUP BY ALL), g AS (SELECT * FROM bs JOIN tt USING (video_id, frame) WHERE k = 1 AND n >= 2 AND 2*n > votes)
    SELECT video_id, frame, n IS NOT NULL AS supported, round(coalesce(sx[n//2+1], px), 4) + 0.0 AS x, round(coalesce(sy[n//2+1], py), 4) + 0.0 AS y, round(coalesce(pr + sr[n//2+1], pr), 7) + 0.0 AS rotation FROM p LEFT JOIN g USING (video_id, frame)""")
def spatial_consensus(spark, folder):
    m = F.col("incremental_match")
    votes = table(spark, folder, "path_entries").where(m["accepted"] & P.valid(m["pose"])).select("video_id", "frame", F.col("entry_no").alias("item"), m["pose"]["x"].alias("x"), m["pose"]["y"].alias("y"), m["pose"]["rotation"].alias("rotation")).dropDuplicates(["item"])
    predictions = path(spark, folder).select("video_id", "frame", F.lit(1.0).alias("px"), F.lit(2.0).alias("py"), F.lit(0.5).alias("protation"))
    return rounded(network.consensus_or_prediction(votes, predictions, ["video_id", "frame"], "item", 4.0, 250.0))


@query("distinct_cells")
def distinct_cells(spark, folder):
    cells = obs.grid_cells(points(spark, folder)).withColumn("place", F.row_number().over(Window.partitionBy("frame_id").orderBy("row", "col", "area")))
    return rounded(ops.distinct_places(cells, "frame_id", "place", 30.0))


@query("motion_filter")
def motion_filter(spark, folder):
    frames = observations(spark, folder).where("enabled AND role IS NOT NULL AND points IS NOT NULL").withColumn("points", F.filter("points", lambda p: p["x"].isNotNull() & p["y"].isNotNull()))
    return ops.moved_enough(frames, ["video_id", "role"], 3.0)


@query("white_parity", f"""WITH {PIXELS}, p AS (SELECT image, ((i-1)//8 + (i-1) % 8) % 2 AS parity, g/255.0::DOUBLE AS v FROM (SELECT image, unnest(gray) AS g, generate_subscripts(gray, 1) AS i FROM pixels) WHERE g > 2),
    m AS (SELECT image, median(v) FILTER (WHERE parity = 0) AS a, median(v) FILTER (WHERE parity = 1) AS b FROM p GROUP BY image)
    SELECT image, CASE WHEN greatest(a, b) >= least(a, b)*1.05 THEN (b > a)::INT END AS parity FROM m""")
def white_parity(spark, folder):
    cells = pixels(spark, folder).select("image", F.posexplode("gray").alias("p", "g")).where("g > 2")
    rows = cells.select("image", F.floor(F.col("p") / 8).alias("row"), (F.col("p") % 8).alias("col"), (F.col("g") / 255.0).alias("v"))
    return obs.white_parity(rows, ["image"], "v", 1.05)


@query("block_luminance", f"""WITH {PIXELS}, l AS (SELECT image, g, CASE WHEN g/255.0::DOUBLE <= 0.04045 THEN g/255.0::DOUBLE/12.92 ELSE pow((g/255.0::DOUBLE+0.055)/1.055, 2.4) END AS v, ((i-1)//8)//2 AS row, ((i-1) % 8)//2 AS col FROM (SELECT image, unnest(gray) AS g, generate_subscripts(gray, 1) AS i FROM pixels))
    SELECT image, row, col, {sql_rounded('avg(v)', 6)} AS luminance FROM l GROUP BY image, row, col HAVING max(g) < 253 AND min(v) > 0.01 AND stddev_pop(v)/avg(v) <= 0.3 AND (max(v)-min(v))/avg(v) <= 0.9""")
def block_luminance(spark, folder):
    cells = pixels(spark, folder).select("image", F.posexplode("gray").alias("p", "g"))
    rows = cells.select("image", F.floor(F.col("p") / 16).alias("row"), F.floor((F.col("p") % 8) / 2).alias("col"), "g", image.to_linear(F.col("g") / 255.0).alias("v"))
    return rounded(obs.block_luminance(rows, ["image", "row", "col"], 0.3, 0.9), 6, shift=0.123)


@query("pattern_squares", "SELECT r AS row, c AS col, 12*c AS x, 12*r AS y FROM range(100) a(r), range(100) b(c) WHERE (r + c) % 2 = 0")
def pattern_squares(spark, folder):
    from fieldloom.sources.tracking import pattern_squares

    return pattern_squares(spark)


@query("decode_lookahead", f"""WITH {SKY}, s AS (SELECT track, row_number() OVER (PARTITION BY track ORDER BY timestamp_us, frame) - 1 AS k FROM sky) SELECT track, 2 + greatest(2, max(abs(xor(k, 1) - k))) AS lookahead FROM s GROUP BY track""")
def decode_lookahead(spark, folder):
    by = Window.partitionBy("track").orderBy("timestamp_us", "frame")
    rows = sky(spark, folder).withColumn("k", (F.row_number().over(by) - 1).cast("long"))
    apart = F.abs(F.col("k").bitwiseXOR(F.lit(1).cast("long")) - F.col("k"))
    return rows.groupBy("track").agg((2 + F.greatest(F.lit(2).cast("long"), F.max(apart))).alias("lookahead"))
