import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.kernels.spline import Lattice, robust_rigid
from fieldloom.operators import calibration as cal

LATTICE = Lattice(640, 480, 80.0)


def test_basis_affine_and_inverse():
    rng = np.random.default_rng(0)
    x, y = rng.uniform(0, 639, 200), rng.uniform(0, 479, 200)
    at, w = LATTICE.design(x, y)
    assert np.abs(w.sum(axis=1) - 1).max() < 1e-13 and at.min() >= 0 and at.max() < LATTICE.size
    affine = LATTICE.start(np.array([1.1, 0.05, -0.04, 0.95, 3.0, -2.0]))
    u, v = LATTICE.moved(affine, x, y)
    assert np.abs(u - (1.1 * x + 0.05 * y + 3)).max() < 1e-10 and np.abs(v - (-0.04 * x + 0.95 * y - 2)).max() < 1e-10
    bent = affine + rng.normal(0, 2.0, affine.shape)
    back = LATTICE.inverse(bent, *LATTICE.moved(bent, x, y))
    assert np.nanmax(np.abs(back - np.stack([x, y], 1))) < 1e-3 and np.isfinite(back).all()
    assert np.isnan(LATTICE.inverse(affine, np.array([1e5]), np.array([0.0]))).all()
    step = 1e-5
    jac = LATTICE.jacobian(bent, x, y)
    ux, vx = LATTICE.moved(bent, x + step, y)
    u0, v0 = LATTICE.moved(bent, x, y)
    assert np.abs((ux - u0) / step - jac[:, 0, 0]).max() < 1e-4 and np.abs((vx - v0) / step - jac[:, 1, 0]).max() < 1e-4


def test_folds():
    flat = LATTICE.start(np.array([1.0, 0, 0, 1.0, 0, 0]))
    assert LATTICE.folds(flat)[0] and LATTICE.folds(flat)[1] == pytest.approx(1)
    assert LATTICE.folds(LATTICE.start(np.array([-1.0, 0, 0, 1.0, 0, 0])))[3] == "determinant"
    assert LATTICE.folds(LATTICE.start(np.array([0.04, 0, 0, 1.0, 0, 0])))[3] == "stretch"
    torn = flat.copy()
    torn[LATTICE.nx * 3 + 4] += [400, 0]
    assert not LATTICE.folds(torn)[0]


def _frames(bend):
    rows = []
    for k in range(14):
        turn, ox, oy = 0.15 * np.sin(k), 90 + 23 * (k % 5), 60 + 31 * (k % 4)
        col, row = (a.ravel().astype(float) for a in np.meshgrid(np.arange(9), np.arange(7)))
        u, v = 40 * (np.cos(turn) * col - np.sin(turn) * row) + ox, 40 * (np.sin(turn) * col + np.cos(turn) * row) + oy
        x, y = u - bend * 3 * np.sin(u / 150) * np.cos(v / 210), v - bend * 2 * np.cos(u / 170) - bend * (u / 300) ** 2
        keep = (x >= 0) & (x < 639) & (y >= 0) & (y < 479)
        points = [(int(c), int(r), float(a), float(b), 1.0) for c, r, a, b in zip(col[keep], row[keep], x[keep], y[keep], strict=True)]
        rows.append((1, k, k < 11, points))
    return rows


@pytest.mark.parametrize("bend,train,heldout", [(0.0, 1e-3, 1e-3), (1.0, 0.15, 0.2)])
def test_fit_of_a_field(spark, bend, train, heldout):
    schema = "video_id long, frame_id long, train boolean, points array<struct<grid_col:int,grid_row:int,x:double,y:double,confidence:double>>"
    df = spark.createDataFrame(_frames(bend) + [(1, 99, True, None), (2, 1, True, [(0, 0, 1.0, 1.0, None)] * 4)], schema)
    steps = spark.createDataFrame([(1, 40.0), (2, 40.0)], "video_id long, step double")
    fields = cal.fitted_fields(df.where("train"), steps, LATTICE, smooth=1e-4)
    rows = fields.collect()
    assert [r.video_id for r in rows] == [1] and rows[0].rms < train
    errors = cal.field_errors(df.where("NOT train"), fields, LATTICE, heldout=True).agg(F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("rms"), F.count("*").alias("n")).first()
    assert errors.n > 60 and errors.rms < heldout
    plain = cal.field_errors(df.where("NOT train"), cal.start_fields(df.where("train"), steps, LATTICE), LATTICE, heldout=True).agg(F.avg("error")).first()[0]
    assert bend == 0 or errors.rms < plain / 2
    assert cal.fold_checks(fields, LATTICE).first().sound


def _naive(frames, step, limit, smooth, rounds, still):
    """The field of one video, frame by frame."""
    k = LATTICE.size
    arrays = {f: np.array([p[:4] + (1.0,) for p in points], float) for _, f, _, points in frames}
    reference = min((f for f in arrays if cal._affine(arrays[f], step, 0.05)), key=lambda f: (-len(arrays[f]), f))
    c, before = LATTICE.start(np.array(cal._affine(arrays[reference], step, 0.05))), np.inf
    for _ in range(rounds):
        a, b, e, n = smooth * LATTICE.bending() + 1e-9 * np.eye(k), np.zeros((k, 2)), 0.0, 0
        for f, v in arrays.items():
            at, w = LATTICE.design(v[:, 2], v[:, 3])
            (x, y), q = LATTICE.moved(c, v[:, 2], v[:, 3]), step * (v[:, 0] + 1j * v[:, 1])
            z = x + 1j * y
            turn, shift, weight = robust_rigid(q, z, v[:, 4], limit)
            goal = shift + turn * q
            if f == reference:
                goal, weight = q, v[:, 4] * np.minimum(1, limit / np.maximum(np.abs(q - z), 1e-20))
            design = np.zeros((len(v), k))
            design[np.arange(len(v))[:, None], at] = w
            a += (design * weight[:, None]).T @ design
            b += (design * weight[:, None]).T @ np.stack([goal.real - v[:, 2], goal.imag - v[:, 3]], axis=1)
            e, n = e + (np.abs(goal - z) ** 2).sum(), n + len(v)
        c, rms = np.linalg.solve(a, b), np.sqrt(e / n)
        if abs(rms - before) <= still:
            break
        before = rms
    return reference, n, rms, c


@pytest.mark.parametrize("whole,jobs", [(250_000, 20), (0, None)])
def test_small_videos_take_all_turns_in_one_task(spark, monkeypatch, whole, jobs):
    monkeypatch.setattr(cal, "WHOLE", whole or 1, raising=False)
    schema = "video_id long, frame_id long, train boolean, points array<struct<grid_col:int,grid_row:int,x:double,y:double,confidence:double>>"
    videos = {v: _frames(0.3 * v) for v in range(1, 4)}
    df = spark.createDataFrame([(v, *r[1:]) for v, rows in videos.items() for r in rows], schema)
    spark.sparkContext.setJobGroup(f"turns{whole}", "")
    try:
        got = {r.video_id: r for r in cal.fitted_fields(df, spark.createDataFrame([(v, 40.0) for v in videos], "video_id long, step double"), LATTICE, rounds=4, still=0.0).collect()}
        used = spark.sparkContext.statusTracker().getJobIdsForGroup(f"turns{whole}")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # Turns used to be jobs, three and more for each.
    assert jobs is None or len(used) < jobs
    for v, rows in videos.items():
        reference, n, rms, c = _naive(rows, 40.0, 1.5, 0.01, 4, 0.0)
        assert (got[v].reference, got[v].n) == (reference, n) and abs(got[v].rms - rms) < 1e-9
        assert np.abs(np.array(got[v].coefficients).reshape(-1, 2) - c).max() < 1e-5


def test_fold_checks_share_their_grid(monkeypatch):
    lattice, rng, calls = Lattice(700, 500, 90.0), np.random.default_rng(3), []
    design = Lattice.design
    monkeypatch.setattr(Lattice, "design", lambda self, *a: calls.append(1) or design(self, *a))
    seen = set()
    for k in range(40):
        c = lattice.start(np.array([1.0, 0, 0, rng.uniform(0.06, 1.2), 0, 0])) + rng.normal(0, [1, 40][k % 2], (lattice.size, 2))
        sound, det, stretch, reason = lattice.folds(c)
        seen.add(reason)
        x, y = (a.ravel() for a in np.meshgrid(np.linspace(0, 699, 4 * (lattice.nx - 3) + 1), np.linspace(0, 499, 4 * (lattice.ny - 3) + 1)))
        jac = np.broadcast_to(np.eye(2), (len(x), 2, 2)).copy()
        for i, d in enumerate(((1, 0), (0, 1))):
            at, w = design(lattice, x, y, *d)
            jac[:, :, i] += np.einsum("nk,nkc->nc", w, c[at])
        if reason == "determinant":
            assert det == pytest.approx(np.linalg.det(jac).min(), abs=1e-9) and stretch == pytest.approx(np.linalg.svd(jac, compute_uv=False).min(), abs=1e-9)
    assert {None, "determinant"} <= seen
    # Each field used to build its grid and the weights there anew, four times.
    assert len(calls) <= 6
