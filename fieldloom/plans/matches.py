"""Queries on the match network: acceptance rules, merging of matches, tombstones, graph edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.adapters import PATH, path, rounded, sql_rounded, table
from fieldloom.functions import pose as P
from fieldloom.operators import matches as ops
from fieldloom.plans.registry import query

KEY = ["video_id", "reference", "current"]
#: Matches of neighbouring frames are gathered in pairs of eighths, so that a pair is measured more than once.
MATCHES = """mt AS (SELECT DISTINCT ON (entry_no) video_id, entry_no AS step, incremental_match.frame//8 AS reference, frame//8 AS current, coalesce(incremental_match.accepted, false) AS accepted, incremental_match.frame AS r0, frame AS c0
    FROM path_entries WHERE incremental_match.frame IS NOT NULL AND incremental_match.frame//8 <> frame//8),
cl AS (SELECT *, k, (step*k) % 6*10::DOUBLE AS rx, 8::DOUBLE*k + 1 AS ry, (step*k) % 6*10::DOUBLE + step % 3 AS cx, 8::DOUBLE*k - step % 2 AS cy, ((step+k) % 25)::DOUBLE AS psr FROM mt, range(1, 5) t(k) WHERE k <= 1 + step % 4)"""
ORIENTED = f"""{MATCHES}, oc AS (SELECT video_id, step, accepted, least(reference, current) AS reference, greatest(reference, current) AS current, CASE WHEN reference > current THEN cx ELSE rx END AS ax, CASE WHEN reference > current THEN cy ELSE ry END AS ay,
    CASE WHEN reference > current THEN rx ELSE cx END AS bx, CASE WHEN reference > current THEN ry ELSE cy END AS "by", greatest(0.2::DOUBLE, least(1.0::DOUBLE, psr/20)) AS quality FROM cl),
oi AS (SELECT *, concat_ws(':', floor(ax/8+0.5)::BIGINT, floor(ay/8+0.5)::BIGINT, floor(bx/8+0.5)::BIGINT, floor("by"/8+0.5)::BIGINT) AS id FROM oc)"""


def _raw(spark, folder):
    m = F.col("incremental_match")
    rows = table(spark, folder, "path_entries").where(m["frame"].isNotNull()).select(
        "video_id", F.col("entry_no").alias("step"), F.floor(m["frame"] / 8).alias("reference"), F.floor(F.col("frame") / 8).alias("current"), F.coalesce(m["accepted"], F.lit(False)).alias("accepted"),
        m["frame"].alias("r0"), F.col("frame").alias("c0"),
    ).dropDuplicates(["step"]).where("reference != current")
    at = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    s = F.col("step")

    def cell(k):
        x = (s * k) % 6 * 10
        return F.struct(at(x, 8 * k + 1).alias("reference"), at(x + s % 3, 8 * k - s % 2).alias("current"), ((s + k) % 25).cast("double").alias("psr"), (64 + k).alias("support"))

    return rows.withColumns({
        "measurement": P.pose((s % 50).cast("double"), (s % 30).cast("double"), (s % 100) / 50.0 - 1), "cells": F.transform(F.sequence(F.lit(1).cast("long"), 1 + s % 4), cell),
        "weight": (1 + s % 8).cast("double"), "approximate": s % 3 == 0,
    })


def _oriented(spark, folder):
    return ops.oriented(_raw(spark, folder))


@query("gpu_acceptance", f"""WITH {MATCHES}, g AS (SELECT step, accepted, c0-r0 AS gap, (step % 70)::DOUBLE AS corr, 0.9885::DOUBLE + (step % 13)/1000.0::DOUBLE AS f, 900 + (step % 5)*100 AS support, (step % 9)/4.0::DOUBLE AS cycle, (step % 10) > 0 AS four,
      (step % 4)*10 + 500 >= 512 AND 0.985::DOUBLE + (step % 3)*0.01::DOUBLE >= 0.99::DOUBLE AND step % 7 <= 6 AS good FROM mt),
    v AS (SELECT *, accepted AND gap > 0 AND gap <= 128 AND support >= 1024 AS sound FROM g)
    SELECT step, CASE WHEN sound AND gap <= 16 AND f >= 0.9995::DOUBLE AND cycle <= 1 AND corr <= 32 THEN 'near-duplicate' WHEN sound AND f >= 0.99::DOUBLE AND cycle <= 2 AND corr <= 64 AND four AND good THEN 'independent-regions' END AS method FROM v""")
def gpu_acceptance(spark, folder):
    s, one = F.col("step"), F.lit(1)
    score = 0.9885 + (s % 13) / 1000.0
    region = F.struct((0.985 + (s % 3) * 0.01).alias("score"), (500 + (s % 4) * 10).alias("support"), (s % 7).cast("double").alias("distance"))
    regions = F.when(s % 10 > 0, F.array(*[region] * 4)).otherwise(F.array(*[region] * 3))
    kind = F.when(F.col("accepted"), "temporal").otherwise("spatial")
    method = ops.gpu_method(kind, F.col("c0") - F.col("r0"), (s % 70).cast("double"), score, one * 1.0, 900 + (s % 5) * 100, (s % 9) / 4.0, regions)
    return _raw(spark, folder).select("step", method.alias("method"))


@query("local_match_rules", f"""WITH {PATH}, p AS (SELECT video_id, frame, x, y, rotation, accepted, score, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(rotation) OVER w AS pr FROM path WHERE x IS NOT NULL WINDOW w AS (PARTITION BY video_id ORDER BY frame))
    SELECT video_id, frame, coalesce(accepted OR (frame % 3 > 0 AND isfinite(score) AND score >= 0.93), false) AS usable,
           sqrt((x-px)**2+(y-py)**2) <= 1.05::DOUBLE*50 AND abs(degrees(atan2(sin(rotation-pr), cos(rotation-pr)))) <= 2 AS bounded,
           CASE WHEN coalesce(accepted, false) = (frame % 5 > 0) AND (NOT coalesce(accepted, false) OR frame % 7/20.0::DOUBLE <= 0.1) AND frame % 11 < 6 THEN 'second' ELSE 'first' END AS backend FROM p WHERE px IS NOT NULL""")
def local_match_rules(spark, folder):
    from pyspark.sql import Window

    by = Window.partitionBy("video_id").orderBy("frame")
    own = P.pose("x", "y", "rotation")
    rows = path(spark, folder).where("x IS NOT NULL").withColumns({"own": own, "before": F.lag(own).over(by)}).where("before IS NOT NULL")
    f, ok = F.col("frame"), F.coalesce("accepted", F.lit(False))
    return rows.select(
        "video_id", "frame", ops.usable_locally(F.col("accepted"), f % 3 > 0, F.col("score"), F.col("own")).alias("usable"), ops.bounded(F.col("own"), F.col("before"), 2.0, 30, 40).alias("bounded"),
        ops.backend(ok, f % 5 > 0, f % 7 / 20.0, F.lit(6), f % 11).alias("backend"),
    )


@query("pair_from_match", f"""WITH {ORIENTED} SELECT step, reference, current, id, ax, ay, bx, "by", round(quality, 6) AS quality FROM oi""")
def pair_from_match(spark, folder):
    rows = _oriented(spark, folder).select("step", "reference", "current", F.explode("cells").alias("c"))
    return rows.select("step", "reference", "current", "c.id", F.col("c.reference.x").alias("ax"), F.col("c.reference.y").alias("ay"), F.col("c.current.x").alias("bx"), F.col("c.current.y").alias("by"), F.round("c.quality", 6).alias("quality"))


@query("normalise_network", f"""WITH {MATCHES} SELECT m.step, (SELECT count(*) FROM cl WHERE cl.step = m.step AND k <> 2) AS cells FROM mt m WHERE step % 8 > 0 AND step % 9 > 0""")
def normalise_network(spark, folder):
    s = F.col("step")
    # Some weights are 0, some measurements not finite, and the second cell has no end.
    rows = _oriented(spark, folder).withColumns({
        "weight": (s % 8).cast("double"), "measurement": F.when(s % 9 == 0, P.pose(F.lit(float("nan")), F.lit(0.0), F.lit(0.0))).otherwise(F.col("measurement")),
        "cells": F.transform("cells", lambda c, i: F.when(i == 1, c.withField("current", F.lit(None).cast("struct<x:double,y:double>"))).otherwise(c)),
    })
    return ops.normalised(rows).select("step", F.size("cells").cast("long").alias("cells"))


MERGED = f"""{ORIENTED}, op AS (SELECT video_id, step, least(reference, current) AS reference, greatest(reference, current) AS current, step % 3 = 0 AS approximate, (1 + step % 8)::DOUBLE AS weight FROM mt
      WHERE accepted AND (least(reference, current)*31 + greatest(reference, current)) % 17 > 0),
    pc AS (SELECT *, bool_and(approximate) OVER w AS none, min(CASE WHEN NOT approximate THEN step END) OVER w AS fp FROM op WINDOW w AS (PARTITION BY video_id, reference, current)),
    ct AS (SELECT * FROM pc WHERE none OR NOT approximate)"""


def _merged(spark, folder):
    known = _oriented(spark, folder).where("accepted")
    gone = known.where("(reference * 31 + current) % 17 = 0").select(*KEY)
    return ops.merged(known, gone, KEY, keep_strength=True)


@query("network_merge", f"""WITH {MERGED}, st AS (SELECT video_id, reference, current, max(weight) AS weight FROM pc WHERE none OR NOT approximate OR step < fp GROUP BY ALL)
    SELECT video_id, reference, current, max(step) AS step, bool_and(approximate) AS approximate, any_value(st.weight) AS weight, count(*) AS updates FROM ct JOIN st USING (video_id, reference, current) GROUP BY ALL""")
def network_merge(spark, folder):
    return _merged(spark, folder)[0].select(*KEY, "step", "approximate", "weight", "updates")


CELLS = f"""{MERGED}, uc AS (SELECT o.video_id, o.reference, o.current, o.id, o.step, o.quality, min(o.step) OVER w AS since, row_number() OVER (PARTITION BY o.video_id, o.reference, o.current, o.id ORDER BY o.step DESC, o.ax, o.ay) AS k
      FROM oi o JOIN ct USING (video_id, step) WINDOW w AS (PARTITION BY o.video_id, o.reference, o.current, o.id))"""


@query("network_cells", f"""WITH {CELLS}, ev AS (SELECT video_id, reference, current, id, arg_max((step % 12)/10.0::DOUBLE, step) AS c FROM (SELECT oi.*, uc.since FROM oi JOIN (SELECT DISTINCT video_id, reference, current, id, since FROM uc) uc USING (video_id, reference, current, id)) WHERE step % 2 = 0 AND step > since GROUP BY ALL)
    SELECT video_id, reference, current, id, since, round(coalesce(greatest(0.05, least(1, c)), 1), 6) AS confidence FROM uc LEFT JOIN ev USING (video_id, reference, current, id) WHERE k = 1""")
def network_cells(spark, folder):
    _, cells = _merged(spark, folder)
    checks = _oriented(spark, folder).where("step % 2 = 0").select(*KEY, "step", F.explode("cells.id").alias("id"), ((F.col("step") % 12) / 10.0).alias("confidence"))
    return ops.revalued(cells, checks, KEY).select(*KEY, "id", "since", F.round("confidence", 6).alias("confidence"))


@query("network_delete_cells", f"""WITH {CELLS} SELECT video_id, count(CASE WHEN since % 5 > 0 THEN 1 END) AS cells, count(CASE WHEN since % 5 = 0 THEN 1 END) AS tombs, 16.0::DOUBLE AS radius FROM uc WHERE k = 1 GROUP BY video_id""")
def network_delete_cells(spark, folder):
    _, cells = _merged(spark, folder)
    left, tombs = ops.deleted_cells(cells, cells.where("since % 5 = 0"), KEY)
    both = left.select("video_id", F.lit(1).alias("c"), F.lit(None).cast("double").alias("radius")).unionByName(tombs.select("video_id", F.lit(None).cast("int").alias("c"), "radius"))
    return both.groupBy("video_id").agg(F.count("c").alias("cells"), F.count("radius").alias("tombs"), F.lit(16.0).alias("radius"))


@query("network_migrate", f"""WITH {MERGED}, fr AS (SELECT video_id, least(reference, current) AS reference, greatest(reference, current) AS current FROM mt WHERE NOT accepted GROUP BY ALL)
    SELECT video_id, reference, current, true AS has_cells FROM (SELECT DISTINCT video_id, reference, current FROM ct) UNION ALL SELECT video_id, reference, current, false FROM fr ANTI JOIN ct USING (video_id, reference, current)""")
def network_migrate(spark, folder):
    stored = _raw(spark, folder).where("NOT accepted").select(*KEY, "step", "measurement", "weight")
    return ops.migrated(_merged(spark, folder)[0], stored, KEY).select(*KEY, "has_cells")


@query("project_cells", f"""WITH {CELLS}, {PATH}, l AS (SELECT o.video_id, o.reference, o.current, o.id, o.ax, o.ay, o.bx, o."by" AS b2, row_number() OVER (PARTITION BY o.video_id, o.reference, o.current, o.id ORDER BY o.step DESC) AS k FROM oi o JOIN ct USING (video_id, step)),
    n AS (SELECT video_id, frame, x, y, rotation FROM path WHERE x IS NOT NULL)
    SELECT l.video_id, l.reference, l.current, id, {sql_rounded('a.x+cos(a.rotation)*ax-sin(a.rotation)*ay')} AS rx, {sql_rounded('a.y+sin(a.rotation)*ax+cos(a.rotation)*ay')} AS ry, {sql_rounded('b.x+cos(b.rotation)*bx-sin(b.rotation)*b2')} AS cx, {sql_rounded('b.y+sin(b.rotation)*bx+cos(b.rotation)*b2')} AS cy
    FROM l JOIN n a ON a.video_id = l.video_id AND a.frame = l.reference JOIN n b ON b.video_id = l.video_id AND b.frame = l.current WHERE k = 1""")
def project_cells(spark, folder):
    _, cells = _merged(spark, folder)
    return rounded(ops.projected(cells, path(spark, folder).where("x IS NOT NULL"), ["video_id"]), shift=0.123)


@query("pose_graph_kinds", f"""WITH {PATH}, n AS (SELECT * FROM path WHERE x IS NOT NULL),
    k AS (SELECT b.video_id, b.matched AS reference, b.frame AS current, a.x AS ax, a.y AS ay, a.rotation AS ar, b.x, b.y, b.rotation, CASE WHEN b.frame - b.matched BETWEEN 1 AND 8 THEN CASE WHEN b.accepted THEN 'incremental' END
        WHEN coalesce(b.accepted, false) AND (b.frame % 10 = 0 OR b.frame % 80/20.0::DOUBLE <= 1.5) THEN 'spatial-strict' WHEN coalesce(b.accepted, false) OR b.frame % 3 = 0 THEN 'spatial-conditional' END AS kind FROM n b JOIN n a ON a.video_id = b.video_id AND a.frame = b.matched)
    SELECT video_id, reference, current, kind, CASE kind WHEN 'incremental' THEN 1 WHEN 'spatial-strict' THEN 8 ELSE 4 END AS weight, {sql_rounded('cos(ar)*(x-ax)+sin(ar)*(y-ay)')} AS dx, {sql_rounded('cos(ar)*(y-ay)-sin(ar)*(x-ax)')} AS dy FROM k WHERE kind IS NOT NULL""")
def pose_graph_kinds(spark, folder):
    nodes = path(spark, folder).where("x IS NOT NULL")
    at = nodes.select("video_id", F.col("frame").alias("reference"), P.pose("x", "y", "rotation").alias("reference_pose"))
    f = F.col("current")
    found = nodes.where("matched IS NOT NULL").select(
        "video_id", F.col("matched").alias("reference"), F.col("frame").alias("current"), (~(F.col("frame") - F.col("matched")).between(1, 8)).alias("spatial"), F.coalesce("accepted", F.lit(False)).alias("accepted"),
        P.pose("x", "y", "rotation").alias("pose"),
    ).withColumns({"confirmed": f % 3 == 0, "cycle": F.when(f % 10 > 0, f % 80 / 20.0)}).join(at, ["video_id", "reference"])
    edges = ops.graph_edges(found, nodes.select("video_id", "frame"), ["video_id"])
    return rounded(edges.select("video_id", "reference", "current", "kind", "weight", F.col("m.x").alias("dx"), F.col("m.y").alias("dy")), shift=0.123)


@query("local_refit_edges", f"""WITH {MATCHES}, g AS (SELECT video_id, reference//4 AS grp, step AS item, reference, current, ((step % 5)*2)::DOUBLE AS x, ((step % 3)*2)::DOUBLE AS y, (step % 4)*0.002::DOUBLE AS r, 0.97::DOUBLE + (step % 4)/100.0::DOUBLE AS score, step % 6 > 0 AS strict FROM mt WHERE accepted AND step % 9/1.0::DOUBLE <= 7.5),
    nb AS (SELECT a.video_id, a.grp, a.item AS a, b.* EXCLUDE (video_id, grp) FROM g a JOIN g b USING (video_id, grp) WHERE sqrt((b.x-a.x)**2+(b.y-a.y)**2+(1000*atan2(sin(b.r-a.r), cos(b.r-a.r)))**2) <= 7.5),
    st AS (SELECT video_id, grp, a, count(*) AS n, count(DISTINCT current) AS ce, count(DISTINCT reference) AS re FROM nb GROUP BY ALL), b1 AS (SELECT *, row_number() OVER (PARTITION BY video_id, grp ORDER BY n DESC, a) AS k FROM st),
    ag AS (SELECT b1.video_id, b1.grp, a FROM b1 JOIN (SELECT video_id, grp, count(*) AS m FROM g GROUP BY ALL) USING (video_id, grp) WHERE k = 1 AND ce >= 2 AND re >= 2 AND 2*n > m),
    al AS (SELECT video_id, grp, reference, current, item, 'consensus' AS "by" FROM nb SEMI JOIN ag USING (video_id, grp, a)
        UNION ALL SELECT video_id, grp, reference, current, item, 'strict' FROM (SELECT *, row_number() OVER (PARTITION BY video_id, grp ORDER BY score DESC, item) AS k FROM g ANTI JOIN ag USING (video_id, grp) WHERE strict) WHERE k = 1),
    o AS (SELECT *, row_number() OVER (PARTITION BY video_id, reference, current ORDER BY grp, item) AS k FROM al) SELECT video_id, grp, reference, current, item, "by" FROM o WHERE k = 1""")
def local_refit_edges(spark, folder):
    s = F.col("step")
    rows = _raw(spark, folder).select(
        "video_id", F.floor(F.col("reference") / 4).alias("grp"), s.alias("item"), "reference", "current", ((s % 5) * 2).cast("double").alias("x"), ((s % 3) * 2).cast("double").alias("y"), ((s % 4) * 0.002).alias("rotation"),
        F.col("accepted").alias("usable"), (s % 9 / 1.0).alias("cycle"), (s % 6 > 0).alias("strict"), (0.97 + (s % 4) / 100.0).alias("score"),
    )
    return ops.local_edges(rows, ["video_id", "grp"])
