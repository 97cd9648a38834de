"""Queries on what to measure next and what to keep."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.adapters import OBSERVATIONS, PATH, SKY, observations, path, pixels, points, rounded, sky, table
from fieldloom.operators import fits
from fieldloom.operators import planning as ops
from fieldloom.operators import windows
from fieldloom.operators.observations import error_statistics, heldout_errors
from fieldloom.plans.observations import ERRORS
from fieldloom.plans.registry import query

FAILED = "fl AS (SELECT DISTINCT video_id, matched AS reference, frame AS current FROM path WHERE accepted = false AND matched < frame)"


@query("temporal_bridges", f"""WITH {PATH}, {FAILED}, l AS (SELECT f.video_id, f.reference, f.current, lag(p.frame) OVER w AS a, p.frame AS b, count(*) OVER (PARTITION BY f.video_id, f.reference, f.current) AS n
      FROM fl f JOIN path p ON p.video_id = f.video_id AND p.frame BETWEEN f.reference AND f.current WINDOW w AS (PARTITION BY f.video_id, f.reference, f.current ORDER BY p.frame))
    SELECT video_id, reference, current, a AS "from", b AS "to", n-1 AS length FROM l WHERE a IS NOT NULL AND n >= 3""")
def temporal_bridges(spark, folder):
    p = path(spark, folder)
    failed = p.where("accepted = false AND matched < frame").select("video_id", F.col("matched").alias("reference"), F.col("frame").alias("current")).distinct()
    return ops.bridge_chains(failed, p, "video_id", "frame")


@query("temporal_skips", f"""WITH {PATH}, c AS (SELECT video_id, lag(frame) OVER w AS a, frame AS b, coalesce(NOT accepted, true) AS f FROM path WINDOW w AS (PARTITION BY video_id ORDER BY frame)),
    n AS (SELECT *, lag(a) OVER w AS before, lead(b) OVER w AS after FROM c WHERE a IS NOT NULL WINDOW w AS (PARTITION BY video_id ORDER BY a))
    SELECT DISTINCT * FROM (SELECT video_id, before AS reference, b AS current FROM n WHERE f AND before IS NOT NULL UNION ALL SELECT video_id, a, after FROM n WHERE f AND after IS NOT NULL)""")
def temporal_skips(spark, folder):
    from pyspark.sql import Window

    chain = path(spark, folder).select("video_id", F.lag("frame").over(Window.partitionBy("video_id").orderBy("frame")).alias("reference"), F.col("frame").alias("current"), F.coalesce(~F.col("accepted"), F.lit(True)).alias("failed"))
    return ops.skips(chain.where("reference IS NOT NULL"), ["video_id"], "reference", "current", "failed")


@query("focused_pairs", f"""WITH {SKY}, f AS (SELECT track, frame, sharpness, coalesce((frame - lag(frame) OVER (PARTITION BY track ORDER BY frame) > 256)::INT, 0) AS s FROM sky),
    v AS (SELECT track, frame, sharpness, sum(s) OVER (PARTITION BY track ORDER BY frame) AS visit FROM f), k AS (SELECT *, row_number() OVER (PARTITION BY track, visit ORDER BY sharpness DESC NULLS LAST, frame) AS k FROM v),
    p AS (SELECT a.track, a.frame AS a, b.frame AS b FROM k a JOIN k b ON b.track = a.track AND b.visit = a.visit AND b.k = 1
          UNION ALL SELECT track, frame, lag(frame) OVER (PARTITION BY track, visit ORDER BY frame) FROM k
          UNION ALL SELECT a.track, a.frame, b.frame FROM k a JOIN k b ON b.track = a.track AND (b.visit = 0 OR b.visit = a.visit-1) WHERE a.visit > 0 AND a.k <= 2 AND b.k <= 2)
    SELECT DISTINCT track, least(a, b) AS reference, greatest(a, b) AS current FROM p WHERE b IS NOT NULL AND a <> b""")
def focused_pairs(spark, folder):
    return ops.visit_pairs(windows.visits(sky(spark, folder), "track", "frame"), "track", "frame", "sharpness")


@query("remove_unselected", f"""WITH {PATH}, k AS (SELECT video_id, frame FROM path WHERE x IS NOT NULL AND success) SELECT p.video_id, p.frame, r.frame AS matched FROM path p SEMI JOIN k ON k.video_id = p.video_id AND k.frame = p.frame LEFT JOIN k r ON r.video_id = p.video_id AND r.frame = p.matched""")
def remove_unselected(spark, folder):
    p = path(spark, folder)
    return ops.kept(p, p.where("x IS NOT NULL AND success"), "video_id", "frame", "matched").select("video_id", "frame", "matched")


#: The 95 % error that counts as good here: the test grids are numbered differently from frame to frame, so fits are far from pixels.
GOOD = 20.0


@query("quality_verdict", f"""{ERRORS}, g AS (SELECT video_id, count(*) AS frames, sum(len(points)) AS n, avg((len(points) >= 9)::INT) AS share FROM obs WHERE role = 'validation' AND points IS NOT NULL GROUP BY video_id),
    v AS (SELECT video_id, list_sort(list(se)) AS s FROM e WHERE role = 'validation' GROUP BY video_id)
    SELECT g.video_id, CASE WHEN n >= 20 AND frames >= 2 AND share >= 0.6 AND s[least(len(s)-1, floor(len(s)*0.95))::INT+1] <= {GOOD} THEN 'validated' ELSE 'provisional' END AS quality FROM g LEFT JOIN v ON v.video_id = g.video_id""")
def quality_verdict(spark, folder):
    g = observations(spark, folder).where("role = 'validation' AND points IS NOT NULL").groupBy("video_id").agg(F.count("*").alias("frames"), F.sum(F.size("points")).alias("n"), F.avg((F.size("points") >= 9).cast("int")).alias("share"))
    errors = error_statistics(fits.residuals(points(spark, folder).where("role = 'validation'"), ["video_id", "frame_id"]), ["video_id"], "similarity_error")
    both = g.join(errors.select("video_id", "p95"), "video_id", "left")
    return both.select("video_id", ops.quality(F.col("n"), F.col("frames"), F.col("share"), F.col("p95"), GOOD).alias("quality"))


@query("heldout_verdict")
def heldout_verdict(spark, folder):
    frames = observations(spark, folder).where("enabled AND role = 'validation' AND points IS NOT NULL")
    # The step of a video's grid is the middle scale of its train frames; there is no calibrated field, so pictures count as they are.
    scales = fits.rigid_fit(points(spark, folder).where("enabled AND role = 'train'"), ["video_id", "frame_id"]).where("n >= 3")
    errors = heldout_errors(frames.join(scales.groupBy("video_id").agg(F.median("scale").alias("step")), "video_id"))
    scored = errors.groupBy("video_id").agg(F.count_distinct("frame_id").alias("scored"))
    g = frames.groupBy("video_id").agg(F.count("*").alias("frames")).join(scored, "video_id", "left").join(error_statistics(errors, ["video_id"], "error"), "video_id", "left")
    share = F.coalesce("scored", F.lit(0)) / F.col("frames")
    return g.select("video_id", "frames", F.coalesce("n", F.lit(0)).alias("n"), share.alias("share"), "rms", "p95", ops.quality(F.col("n"), F.col("frames"), share, F.col("p95")).alias("quality"))


@query("role_assignment", f"""WITH {OBSERVATIONS}, d AS (SELECT video_id, max(timestamp_us) AS t FROM obs GROUP BY video_id) SELECT frame_id, coalesce(role, CASE WHEN timestamp_us >= t*0.8 THEN 'validation' ELSE 'train' END) AS role FROM obs JOIN d USING (video_id)""")
def role_assignment(spark, folder):
    o = observations(spark, folder)
    last = o.groupBy("video_id").agg(F.max("timestamp_us").alias("t"))
    return o.join(last, "video_id").select("frame_id", ops.role(F.col("timestamp_us"), F.col("t"), 0.8, F.col("role")).alias("role"))


@query("display_range", """WITH s AS (SELECT label AS source, list_sort(list(1 + e::DOUBLE)) AS s FROM (SELECT label, unnest(embedding) AS e FROM embeddings) GROUP BY label),
    h AS (SELECT source, greatest(0.01, abs(s[floor((len(s)-1)*0.02)::INT+1]-1), abs(s[floor((len(s)-1)*0.98)::INT+1]-1)) AS h FROM s) SELECT source, round(1-h, 6) AS low, round(1+h, 6) AS high FROM h""")
def display_range(spark, folder):
    values = table(spark, folder, "embeddings").select(F.col("label").alias("source"), F.explode("embedding").alias("e")).select("source", (1 + F.col("e").cast("double")).alias("v"))
    return rounded(ops.display_range(values, ["source"], "v"), 6)


@query("brightness_fit")
def brightness_fit(spark, folder):
    cells = pixels(spark, folder).select("image", F.posexplode("gray").alias("p", "v")).select("image", F.floor(F.col("p") / 8).alias("row"), (F.col("p") % 8).alias("col"), F.col("v").cast("double").alias("value"))
    return rounded(ops.fitted_brightness(cells, "image")[1], 6)
