"""Queries on observation frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.adapters import OBSERVATIONS, observations, points, rounded
from fieldloom.operators import fits
from fieldloom.operators import observations as ops
from fieldloom.plans.registry import query

MOMENTS = f"""WITH {OBSERVATIONS},
s AS (SELECT video_id, frame_id, count(*) AS n, sum(w) AS sw, sum(w*col) AS su, sum(w*row) AS sv, sum(w*x) AS sx, sum(w*y) AS sy, sum(w*col*col) AS suu,
             sum(w*col*row) AS suv, sum(w*row*row) AS svv, sum(w*col*x) AS sux, sum(w*row*x) AS svx, sum(w*col*y) AS suy, sum(w*row*y) AS svy
      FROM pts GROUP BY video_id, frame_id HAVING sum(w) > 0),
m AS (SELECT video_id, frame_id, n, su/sw AS mu, sv/sw AS mv, sx/sw AS mx, sy/sw AS my, suu-su*su/sw AS uu, suv-su*sv/sw AS uv, svv-sv*sv/sw AS vv,
             sux-su*sx/sw AS ux, svx-sv*sx/sw AS vx, suy-su*sy/sw AS uy, svy-sv*sy/sw AS vy FROM s),
f AS (SELECT *, atan2(uy-vx, ux+vy) AS theta, CASE WHEN uu+vv > 1e-9 THEN sqrt((ux+vy)**2 + (uy-vx)**2)/(uu+vv) ELSE 1 END AS scale FROM m)"""

ERRORS = f"""{MOMENTS},
e AS (SELECT p.*, f.scale, f.mx, f.my,
             sqrt((x-mx-(cos(theta)*(col-mu)-sin(theta)*(row-mv)))**2 + (y-my-(sin(theta)*(col-mu)+cos(theta)*(row-mv)))**2) AS re,
             sqrt((x-mx-scale*(cos(theta)*(col-mu)-sin(theta)*(row-mv)))**2 + (y-my-scale*(sin(theta)*(col-mu)+cos(theta)*(row-mv)))**2) AS se
      FROM pts p JOIN f USING (video_id, frame_id))"""

METRICS = f"""{ERRORS},
fm AS (SELECT video_id, frame_id, count(*) AS n, sqrt(avg(re*re)) AS rigid_rms, sqrt(avg(se*se)) AS similarity_rms, any_value(scale) AS scale,
              any_value(mx) AS cx, any_value(my) AS cy FROM e WHERE enabled GROUP BY ALL HAVING count(*) >= 3),
mv AS (SELECT *, sqrt(dx*dx+dy*dy) AS moved FROM (SELECT video_id, frame_id, cx - lag(cx) OVER w AS dx, cy - lag(cy) OVER w AS dy FROM fm
       WINDOW w AS (PARTITION BY video_id ORDER BY frame_id)) WHERE dx IS NOT NULL)"""

AFFINE = f"""{MOMENTS},
d AS (SELECT *, uu*vv-uv*uv AS det FROM m WHERE n >= 3 AND uu*vv-uv*uv > 1e-12),
ab AS (SELECT video_id, frame_id, (ux*vv-vx*uv)/det AS a, (vx*uu-ux*uv)/det AS b, (uy*vv-vy*uv)/det AS c, (vy*uu-uy*uv)/det AS d FROM d),
g AS (SELECT video_id, frame_id, sqrt(a*d-b*c) AS scale, a*a+b*b+c*c+d*d AS t, a*d-b*c AS area FROM ab WHERE a*d-b*c > 0),
affine AS (SELECT video_id, frame_id, scale, CASE WHEN t - sqrt(greatest(0, t*t-4*area*area)) > 0
                  THEN sqrt((t+sqrt(greatest(0, t*t-4*area*area)))/2) / sqrt((t-sqrt(greatest(0, t*t-4*area*area)))/2) END AS anisotropy FROM g)"""


def _nearest(a: str, f: float) -> str:
    return f"coalesce({a}[least(len({a}), floor((len({a}) - 1) * {f} + 0.5)::INT + 1)], 0)"


@query("rigid_pose_fit", f"{MOMENTS} SELECT video_id, frame_id, n, round(theta, 7) + 0.0 AS theta, round(mx-cos(theta)*mu+sin(theta)*mv, 4) + 0.0 AS tx, round(my-sin(theta)*mu-cos(theta)*mv, 4) + 0.0 AS ty FROM f")
def rigid_pose_fit(spark, folder):
    return rounded(fits.rigid_fit(points(spark, folder), ["video_id", "frame_id"]).select("video_id", "frame_id", "n", "theta", "tx", "ty"))


@query("similarity_fit", f"{MOMENTS} SELECT frame_id, round(scale, 4) AS scale, round(theta, 7) + 0.0 AS theta FROM f")
def similarity_fit(spark, folder):
    return rounded(fits.rigid_fit(points(spark, folder), ["video_id", "frame_id"]).select("frame_id", "scale", "theta"))


@query("affine_geometry", f"{AFFINE} SELECT frame_id, round(scale, 4) AS scale, round(anisotropy, 4) AS anisotropy FROM affine")
def affine_geometry(spark, folder):
    return rounded(fits.affine_geometry(points(spark, folder), ["frame_id"]))


@query("error_statistics", f"""{ERRORS}, l AS (SELECT video_id, list_sort(list(se)) AS s, sqrt(avg(se*se)) AS rms FROM e GROUP BY video_id)
    SELECT video_id, len(s) AS n, round(s[floor(len(s)*0.5)::INT+1], 4) AS median, round(rms, 4) AS rms,
           round(s[least(len(s)-1, floor(len(s)*0.95))::INT+1], 4) AS p95 FROM l""")
def error_statistics(spark, folder):
    errors = fits.residuals(points(spark, folder), ["video_id", "frame_id"])
    return rounded(ops.error_statistics(errors, ["video_id"], "similarity_error"))


@query("frame_metrics", f"{METRICS} SELECT frame_id, n, round(rigid_rms, 4) AS rigid_rms, round(similarity_rms, 4) AS similarity_rms, round(scale, 4) AS scale FROM fm")
def frame_metrics(spark, folder):
    return rounded(ops.frame_metrics(points(spark, folder)).select("frame_id", "n", "rigid_rms", "similarity_rms", "scale"))


@query("observation_metrics", f"""{METRICS},
    a AS (SELECT video_id, count(*) AS frames, sum(n) AS points, list_sort(list(rigid_rms)) AS r, list_sort(list(similarity_rms)) AS s, list_sort(list(scale)) AS c FROM fm GROUP BY video_id),
    b AS (SELECT video_id, list_sort(list(moved)) AS m, count(DISTINCT CASE WHEN moved >= 1 THEN (floor(atan2(dy, dx)/(pi()/4)+0.5)+8)::INT % 8 END) AS d,
                 avg((moved < 1)::INT) AS near FROM mv GROUP BY video_id)
    SELECT video_id, frames, points::BIGINT AS points, round({_nearest('r', 0.5)}, 4) AS rigid_median, round({_nearest('r', 0.95)}, 4) AS rigid_p95,
           round({_nearest('s', 0.5)}, 4) AS similarity_median, round({_nearest('s', 0.95)}, 4) AS similarity_p95, round({_nearest('c', 0.05)}, 4) AS scale_p05,
           round({_nearest('c', 0.95)}, 4) AS scale_p95, round(CASE WHEN m IS NULL THEN 0 ELSE {_nearest('m', 0.5)} END, 4) AS movement_median,
           coalesce(d, 0) AS direction_bins, round(coalesce(near, 0), 4) AS near_share
    FROM a LEFT JOIN b USING (video_id)""")
def observation_metrics(spark, folder):
    return rounded(ops.video_metrics(points(spark, folder)))


@query("movement_metrics", f"""{METRICS} SELECT video_id, frame_id, round(moved, 4) AS moved,
    CASE WHEN moved >= 1 THEN (floor(atan2(dy, dx)/(pi()/4)+0.5)+8)::BIGINT % 8 END AS octant, moved < 1 AS near FROM mv""")
def movement_metrics(spark, folder):
    return rounded(ops.movements(ops.frame_metrics(points(spark, folder))))


@query("observation_grid", f"""{ERRORS} SELECT greatest(0, least(89, floor(x/2160*90)))::INT AS cell_col, greatest(0, least(59, floor(y/1440*60)))::INT AS cell_row,
    count(DISTINCT frame_id) AS frames, count(*) AS points, round(sum(re), 3) AS error_sum FROM e WHERE enabled GROUP BY ALL""")
def observation_grid(spark, folder):
    return rounded(ops.residual_grid(points(spark, folder), 2160.0, 1440.0, 90, 60), 3)


@query("consistent_cluster", f"""{AFFINE}, l AS (SELECT frame_id, ln(scale) AS ls, ln(anisotropy) AS la FROM affine),
    c AS (SELECT a.frame_id, a.ls, a.la, count(*) AS k FROM l a JOIN l b ON abs(a.ls-b.ls) <= ln(1.01) AND abs(a.la-b.la) <= ln(1.01) GROUP BY ALL ORDER BY k DESC, frame_id LIMIT 1)
    SELECT l.frame_id, abs(l.ls-c.ls) <= ln(1.01) AND abs(l.la-c.la) <= ln(1.01) AS selected FROM l, c""")
def consistent_cluster(spark, folder):
    return ops.consistent_cluster(fits.affine_geometry(points(spark, folder), ["frame_id"]))


COVERAGE = f"""WITH {OBSERVATIONS}, c AS (SELECT p.frame_id, x, y, i AS cell_col, j AS cell_row FROM pts p,
        unnest(range(greatest(0, ceil((x-20)/24-0.5))::BIGINT, least(89, floor((x+20)/24-0.5))::BIGINT+1)) AS a(i),
        unnest(range(greatest(0, ceil((y-20)/24-0.5))::BIGINT, least(59, floor((y+20)/24-0.5))::BIGINT+1)) AS b(j)
      WHERE enabled AND role = 'train'),
    cov AS (SELECT cell_col, cell_row, least(255, count(DISTINCT frame_id)) AS frames FROM c
            WHERE ((cell_col+0.5)*24-x)**2 + ((cell_row+0.5)*24-y)**2 <= 400 GROUP BY ALL)"""


@query("coverage_grid", f"{COVERAGE} SELECT * FROM cov")
def coverage_grid(spark, folder):
    return ops.coverage_grid(points(spark, folder), 24.0, 20.0, 90, 60)


@query("coverage_scale", f"""{COVERAGE}, s AS (SELECT min(frames) AS low, max(frames) AS high FROM cov WHERE frames > 0)
    SELECT cell_col, cell_row, frames, round(CASE WHEN high > low THEN (frames-low)/(high-low) ELSE 1 END, 4) AS place FROM cov, s WHERE frames > 0""")
def coverage_scale(spark, folder):
    return rounded(ops.coverage_scale(ops.coverage_grid(points(spark, folder), 24.0, 20.0, 90, 60), "frames"))


CELLS = f"""WITH {OBSERVATIONS}, c AS (
    SELECT a.frame_id, a.col, a.row, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1, c.x AS x2, c.y AS y2, d.x AS x3, d.y AS y3 FROM pts a
    JOIN pts b ON b.frame_id = a.frame_id AND b.col = a.col+1 AND b.row = a.row JOIN pts c ON c.frame_id = a.frame_id AND c.col = a.col+1 AND c.row = a.row+1
    JOIN pts d ON d.frame_id = a.frame_id AND d.col = a.col AND d.row = a.row+1),
t AS (SELECT *, (x1-x0)*(y2-y1)-(y1-y0)*(x2-x1) AS t0, (x2-x1)*(y3-y2)-(y2-y1)*(x3-x2) AS t1, (x3-x2)*(y0-y3)-(y3-y2)*(x0-x3) AS t2, (x0-x3)*(y1-y0)-(y0-y3)*(x1-x0) AS t3 FROM c),
cells AS (SELECT frame_id, col, row, abs(x0*y1-x1*y0+x1*y2-x2*y1+x2*y3-x3*y2+x3*y0-x0*y3)/2 AS area, (x0+x1+x2+x3)/4 AS x, (y0+y1+y2+y3)/4 AS y FROM t
          WHERE (t0 > 0 AND t1 > 0 AND t2 > 0 AND t3 > 0) OR (t0 < 0 AND t1 < 0 AND t2 < 0 AND t3 < 0))"""


@query("cell_areas", f"{CELLS} SELECT frame_id, col, row, round(area, 7) AS area, round(x, 7) AS x, round(y, 7) AS y FROM cells")
def cell_areas(spark, folder):
    return rounded(ops.grid_cells(points(spark, folder)), 7)


@query("area_summary", f"""{CELLS} SELECT frame_id, count(*) AS n, round(min(area), 8) AS low, round(max(area), 8) AS high, round(avg(area), 8) AS mean,
    round(median(area), 8) AS middle, round(stddev_pop(area), 8) AS deviation, round(greatest(max(area)-avg(area), avg(area)-min(area))/avg(area), 8) AS worst FROM cells GROUP BY frame_id""")
def area_summary(spark, folder):
    return rounded(ops.area_summary(ops.grid_cells(points(spark, folder))), 8)


@query("validate_observations", f"""WITH {OBSERVATIONS}
    SELECT frame_id, 'role' AS rule FROM obs WHERE role IS NULL OR role NOT IN ('train', 'validation')
    UNION ALL SELECT frame_id, 'few points' FROM obs WHERE points IS NULL OR len(points) < 6
    UNION ALL SELECT frame_id, 'place twice' FROM pts GROUP BY frame_id HAVING count(DISTINCT (col, row)) < count(*)
    UNION ALL SELECT DISTINCT frame_id, 'confidence' FROM pts WHERE w <= 0 OR w > 1""")
def validate_observations(spark, folder):
    return ops.violations(observations(spark, folder))


@query("reason_histogram", "WITH " + OBSERVATIONS + " SELECT reason, count(*) AS n FROM obs WHERE NOT enabled GROUP BY reason")
def reason_histogram(spark, folder):
    return observations(spark, folder).where("NOT enabled").groupBy("reason").agg(F.count("*").alias("n"))


@query("training_frames", f"WITH {OBSERVATIONS} SELECT frame_id, len(points) AS n FROM obs WHERE enabled AND role = 'train' AND len(points) >= 6")
def training_frames(spark, folder):
    return observations(spark, folder).where("enabled AND role = 'train' AND size(points) >= 6").select("frame_id", F.size("points").alias("n"))
