"""Queries on pairwise measurements and pose graphs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fieldloom.adapters import PATH, SKY, path, rounded, sky, sql_rounded, table
from fieldloom.functions import image
from fieldloom.functions import pose as P
from fieldloom.operators import graph, network
from fieldloom.plans.registry import query
from fieldloom.storage import Scratch

MATCH = f"""WITH {SKY}, mt AS (SELECT track, frame, lag(frame) OVER (PARTITION BY track ORDER BY frame) AS reference, kind, 0.85 + (frame % 150)/1000.0::DOUBLE AS score, (64*(1+frame%16))::DOUBLE AS support,
    (frame % 80)/20.0::DOUBLE AS cycle, x, y, rotation FROM sky)"""


def _matches(spark, folder):
    rows = sky(spark, folder)
    f = F.col("frame")
    return rows.select("track", "frame", F.lag("frame").over(Window.partitionBy("track").orderBy("frame")).alias("reference"), "kind", (0.85 + (f % 150) / 1000.0).alias("score"),
                       (64 * (1 + f % 16)).cast("double").alias("support"), ((f % 80) / 20.0).alias("cycle"), "x", "y", "rotation")


@query("accepted_constraints", f"""{MATCH} SELECT frame, CASE WHEN kind = 'error' THEN 'direction' WHEN cycle > 2 THEN 'cycle' WHEN score < 0.9 THEN 'correlation' WHEN support < 128 THEN 'support' WHEN reference IS NULL THEN 'pose' END AS reason FROM mt""")
def accepted_constraints(spark, folder):
    m = _matches(spark, folder)
    ok = F.col("kind") != "error"
    return m.select("frame", network.verdict(ok, ok, F.col("cycle"), F.col("score"), F.col("support"), F.col("reference").isNotNull()).alias("reason"))


@query("pair_stiffness", f"""{MATCH} SELECT frame, {sql_rounded("greatest(1, least(256, 4 + 12*greatest(0, least(1, (score-0.9)/0.1))*least(16, sqrt(support/128))*least(4, sqrt((frame%12)/3.0::DOUBLE))/(1+((frame%7)/4.0::DOUBLE)**2+(cycle/10)**2)))")} AS weight FROM mt""")
def pair_stiffness(spark, folder):
    m = _matches(spark, folder)
    f = F.col("frame")
    w = image.stiffness(F.col("score"), F.col("support"), F.lit(None).cast("double"), f % 12, (f % 7).cast("double"), F.col("cycle"))
    return rounded(m.select("frame", w.alias("weight")), shift=0.123)


@query("pair_id", "SELECT DISTINCT video_id, least(frame, incremental_match.frame)::VARCHAR || ':' || greatest(frame, incremental_match.frame)::VARCHAR AS pair FROM path_entries WHERE incremental_match.frame IS NOT NULL")
def pair_id(spark, folder):
    rows = table(spark, folder, "path_entries").where("incremental_match.frame IS NOT NULL")
    return rows.select("video_id", image.pair_id(F.col("frame"), F.col("incremental_match.frame")).alias("pair")).distinct()


CELLS = """WITH pc AS (SELECT l_partkey AS reference, 2000 + l_suppkey AS current, l_quantity*10 AS rx, l_extendedprice/100 AS ry, l_quantity*10 + 3 + l_linenumber % 2 AS cx, l_extendedprice/100 - 2 AS cy, 1 - l_discount AS quality FROM lineitem),
    m AS (SELECT reference, current, count(*) AS n, sum(quality) AS w, sum(quality*rx) AS srx, sum(quality*ry) AS sry, sum(quality*cx) AS scx, sum(quality*cy) AS scy, sum(quality*(cx*rx+cy*ry)) AS d0, sum(quality*(cx*ry-cy*rx)) AS k0, sum(quality*(rx*rx+ry*ry)) AS rr
          FROM pc GROUP BY ALL HAVING count(*) >= 3 AND sum(quality) > 0),
    f AS (SELECT *, d0-(scx*srx+scy*sry)/w AS dot, k0-(scx*sry-scy*srx)/w AS crs, rr/w-(srx/w)**2-(sry/w)**2 AS spread FROM m),
    ed AS (SELECT reference, current, n, srx/w AS rx, sry/w AS ry, scx/w AS cx, scy/w AS cy, atan2(crs, dot) AS rotation, (1+reference%8)*w/greatest(3, w) AS weight FROM f WHERE spread >= 64)"""


def _cells(spark, folder):
    li = table(spark, folder, "lineitem")
    q, p = F.col("l_quantity") * 10, F.col("l_extendedprice") / 100
    return li.select(F.col("l_partkey").alias("reference"), (2000 + F.col("l_suppkey")).alias("current"), q.alias("rx"), p.alias("ry"), (q + 3 + F.col("l_linenumber") % 2).alias("cx"), (p - 2).alias("cy"), (1 - F.col("l_discount")).alias("quality"), F.lit(None).cast("double").alias("confidence"))


def _pairs(cells):
    return cells.select("reference", "current").distinct().withColumn("weight", 1 + F.col("reference") % 8)


@query("network_edges", f"""{CELLS} SELECT reference, current, n, {sql_rounded('rx - cos(rotation)*cx + sin(rotation)*cy')} AS x, {sql_rounded('ry - sin(rotation)*cx - cos(rotation)*cy')} AS y, {sql_rounded('rotation', 7)} AS rotation, {sql_rounded('weight')} AS weight FROM ed""")
def network_edges(spark, folder):
    c = _cells(spark, folder)
    return rounded(network.cell_edges(_pairs(c), c, ["reference", "current"]), shift=0.123)


@query("apply_network", f"""WITH {PATH}, g AS (SELECT DISTINCT video_id, least(frame, matched) AS reference, greatest(frame, matched) AS current FROM path WHERE matched IS NOT NULL AND matched <> frame),
    nw AS (SELECT DISTINCT video_id, matched AS reference, frame AS current FROM path WHERE accepted AND matched < frame), dl AS (SELECT video_id, frame AS reference, frame + 1 AS current FROM path WHERE success = false),
    kn AS (SELECT * FROM nw UNION SELECT * FROM dl), nd AS (SELECT video_id, frame FROM path WHERE x IS NOT NULL)
    SELECT g.*, 'graph' AS kind FROM g ANTI JOIN kn USING (video_id, reference, current)
    UNION ALL SELECT n.*, 'network' FROM nw n ANTI JOIN dl USING (video_id, reference, current) SEMI JOIN nd a ON a.video_id = n.video_id AND a.frame = n.reference SEMI JOIN nd b ON b.video_id = n.video_id AND b.frame = n.current""")
def apply_network(spark, folder):
    p = path(spark, folder)
    m = p.where("matched IS NOT NULL AND matched != frame")
    key = ["video_id", "reference", "current"]
    g = m.select("video_id", F.least("frame", "matched").alias("reference"), F.greatest("frame", "matched").alias("current")).distinct()
    net = p.where("accepted AND matched < frame").select("video_id", F.col("matched").alias("reference"), F.col("frame").alias("current")).distinct()
    gone = p.where("success = false").select("video_id", F.col("frame").alias("reference"), (F.col("frame") + 1).alias("current"))
    return network.applied(g, net, gone, p.where("x IS NOT NULL").select("video_id", "frame"), key)


@query("pose_graph_edges", f"""WITH {PATH}, n AS (SELECT * FROM path WHERE x IS NOT NULL)
    SELECT b.video_id, a.frame AS reference, b.frame AS current, round(cos(a.rotation)*(b.x-a.x)+sin(a.rotation)*(b.y-a.y), 4) + 0.0 AS dx, round(cos(a.rotation)*(b.y-a.y)-sin(a.rotation)*(b.x-a.x), 4) + 0.0 AS dy,
           round(atan2(sin(b.rotation-a.rotation), cos(b.rotation-a.rotation)), 7) + 0.0 AS rotation, CASE WHEN b.frame - a.frame = 1 THEN 1 ELSE 8 END AS weight
    FROM n b JOIN n a ON a.video_id = b.video_id AND a.frame = b.matched WHERE b.accepted AND a.frame <> b.frame""")
def pose_graph_edges(spark, folder):
    return rounded(_edges(spark, folder).withColumnRenamed("turn", "rotation"))


def _edges(spark, folder):
    n = path(spark, folder).where("x IS NOT NULL")
    a = n.select("video_id", F.col("frame").alias("reference"), P.pose("x", "y", "rotation").alias("a"))
    b = n.where("accepted").select("video_id", F.col("matched").alias("reference"), F.col("frame").alias("current"), P.pose("x", "y", "rotation").alias("b"))
    rel = b.where("reference != current").join(a, ["video_id", "reference"]).select("video_id", "reference", "current", P.relative(F.col("b"), F.col("a")).alias("m"))
    weight = F.when(F.col("current") - F.col("reference") == 1, 1).otherwise(8)
    return rel.select("video_id", "reference", "current", F.col("m.x").alias("dx"), F.col("m.y").alias("dy"), F.col("m.rotation").alias("turn"), weight.alias("weight"))


@query("connected_components", f"""WITH RECURSIVE {PATH}, n AS (SELECT video_id, frame FROM path WHERE x IS NOT NULL),
    e AS (SELECT DISTINCT p.video_id, p.frame AS a, p.matched AS b FROM path p JOIN n ON n.video_id = p.video_id AND n.frame = p.matched WHERE p.accepted AND p.x IS NOT NULL AND p.frame <> p.matched),
    l AS (SELECT video_id, a, b FROM e UNION SELECT video_id, b, a FROM e),
    w(video_id, frame, label) USING KEY (video_id, frame) AS (SELECT video_id, frame, frame FROM n UNION
        SELECT w.video_id, l.b, min(w.label) FROM w JOIN l ON l.video_id = w.video_id AND l.a = w.frame JOIN recurring.w AS k ON k.video_id = l.video_id AND k.frame = l.b WHERE w.label < k.label GROUP BY w.video_id, l.b)
    SELECT video_id, frame, label FROM w""")
def connected_components(spark, folder):
    nodes = path(spark, folder).where("x IS NOT NULL").select("video_id", "frame")
    return graph.components(nodes, _edges(spark, folder).select("video_id", "reference", "current"), ["video_id"])


@query("keyframes")
def keyframes(spark, folder):
    return graph.keyframes(path(spark, folder), "video_id", "frame", 20.0)


@query("pose_graph_optimize")
def pose_graph_optimize(spark, folder):
    scratch = Scratch(spark, "keyframes")  # each use would fold the tracks again
    keys = scratch.save(graph.keyframes(path(spark, folder), "video_id", "frame", 20.0), "keys")
    by = Window.partitionBy("video_id").orderBy("frame")
    links = []
    for back in (1, 2):
        then = keys.select("video_id", "frame", P.pose("x", "y", "rotation").alias("b"), F.lag("frame", back).over(by).alias("reference"), F.lag(P.pose("x", "y", "rotation"), back).over(by).alias("a")).where("reference IS NOT NULL")
        rel = then.select("video_id", "reference", F.col("frame").alias("current"), P.relative(F.col("b"), F.col("a")).alias("m"))
        links.append(rel.select("video_id", "reference", "current", (F.col("m.x") + (0.5 if back == 2 else 0.0)).alias("dx"), F.col("m.y").alias("dy"), F.col("m.rotation").alias("turn"), F.lit(float(back)).alias("weight")))
    ends = keys.select("video_id", "frame")
    matched = _edges(spark, folder).withColumn("weight", F.col("weight").cast("double"))
    for end in ("reference", "current"):
        matched = matched.join(ends.withColumnRenamed("frame", end), ["video_id", end], "left_semi")
    edges = scratch.save(links[0].unionByName(links[1]).unionByName(matched), "edges")
    return graph.adjusted_poses(keys, edges, ["video_id"])


@query("consensus_pose", f"""WITH {PATH}, v AS (SELECT r.video_id, r.frame, r.entry_no AS item, incremental_match.pose.x AS x, incremental_match.pose.y AS y, incremental_match.pose.rotation AS rotation FROM
      (SELECT DISTINCT ON (entry_no) video_id, frame, entry_no, incremental_match FROM path_entries) r WHERE incremental_match.accepted AND isfinite(x) AND isfinite(y) AND isfinite(rotation)),
    nb AS (SELECT a.video_id, a.frame, a.item AS a, a.rotation AS ar, b.x, b.y, atan2(sin(b.rotation-a.rotation), cos(b.rotation-a.rotation)) AS dr FROM v a JOIN v b USING (video_id, frame)
           WHERE sqrt((b.x-a.x)**2+(b.y-a.y)**2) + abs(atan2(sin(b.rotation-a.rotation), cos(b.rotation-a.rotation)))*250 <= 4),
    st AS (SELECT video_id, frame, a, any_value(ar) AS ar, count(*) AS inliers, list_sort(list(x)) AS sx, list_sort(list(y)) AS sy, list_sort(list(dr)) AS sr FROM nb GROUP BY ALL),
    bs AS (SELECT *, row_number() OVER (PARTITION BY video_id, frame ORDER BY inliers DESC, a) AS k FROM st), tt AS (SELECT video_id, frame, count(*) AS votes FROM v GROUP BY ALL)
    SELECT video_id, frame, inliers, votes, round(sx[len(sx)//2+1], 4) + 0.0 AS x, round(sy[len(sy)//2+1], 4) + 0.0 AS y, round(ar+sr[len(sr)//2+1], 7) + 0.0 AS rotation FROM bs JOIN tt USING (video_id, frame) WHERE k = 1 AND inliers >= 2 AND 2*inliers > votes""")
def consensus_pose(spark, folder):
    m = F.col("incremental_match")
    votes = table(spark, folder, "path_entries").where(m["accepted"] & P.valid(m["pose"])).select("video_id", "frame", F.col("entry_no").alias("item"), m["pose"]["x"].alias("x"), m["pose"]["y"].alias("y"), m["pose"]["rotation"].alias("rotation")).dropDuplicates(["item"])
    return rounded(network.consensus(votes, ["video_id", "frame"], "item", 4.0, 250.0))


@query("overlap_checks", f"""WITH {PATH}, st AS (SELECT video_id, frame, x, y, coalesce(sqrt((x - lag(x) OVER w)**2 + (y - lag(y) OVER w)**2), 0) AS d FROM path WHERE x IS NOT NULL WINDOW w AS (PARTITION BY video_id ORDER BY frame)),
    tr AS (SELECT *, sum(d) OVER (PARTITION BY video_id ORDER BY frame ROWS UNBOUNDED PRECEDING) AS t FROM st),
    pr AS (SELECT a.video_id, a.frame AS reference, b.frame AS current, sqrt((b.x-a.x)**2+(b.y-a.y)**2) AS d, (a.x+b.x)/2 AS x, (a.y+b.y)/2 AS y FROM tr a JOIN tr b ON a.video_id = b.video_id AND b.frame > a.frame AND b.t-a.t >= 40 AND sqrt((b.x-a.x)**2+(b.y-a.y)**2) < 20),
    b1 AS (SELECT *, row_number() OVER (PARTITION BY video_id, reference ORDER BY d, current) AS k FROM pr), b2 AS (SELECT *, row_number() OVER (PARTITION BY video_id, floor(x/10), floor(y/10) ORDER BY d, reference) AS r FROM b1 WHERE k = 1)
    SELECT video_id, reference, current, round(d, 4) AS d FROM b2 WHERE r = 1""")
def overlap_checks(spark, folder):
    return rounded(network.overlap_checks(path(spark, folder), "video_id", "frame", 20.0))


@query("frame_report", f"""WITH {PATH}, p AS (SELECT video_id, matched AS reference, frame AS current, coalesce(accepted, false) AS a, CASE WHEN isfinite(score) THEN score END AS s FROM path WHERE matched IS NOT NULL),
    e AS (SELECT video_id, reference AS frame, current AS partner, a, CASE WHEN a THEN s ELSE 0.75*s END AS v FROM p UNION ALL SELECT video_id, current, reference, a, CASE WHEN a THEN s ELSE 0.75*s END FROM p),
    r AS (SELECT *, row_number() OVER (PARTITION BY video_id, frame ORDER BY v NULLS FIRST, partner) AS k FROM e)
    SELECT video_id, frame, count(*) AS attempts, count(CASE WHEN a THEN 1 END) AS accepted, round(any_value(v) FILTER (WHERE k = 1), 9) AS worst_score, any_value(partner) FILTER (WHERE k = 1) AS worst_partner FROM r GROUP BY ALL""")
def frame_report(spark, folder):
    s = F.col("score")
    pairs = path(spark, folder).where("matched IS NOT NULL").select("video_id", F.col("matched").alias("reference"), F.col("frame").alias("current"), F.coalesce("accepted", F.lit(False)).alias("accepted"), F.when(P.finite(s), s).alias("score"))
    return rounded(network.frame_report(pairs, "video_id"), 9)
