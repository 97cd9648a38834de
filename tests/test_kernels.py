import numpy as np

from fieldloom.kernels import images
from fieldloom.kernels.forest import star_forest


def test_laplacian_tells_flat_from_sharp():
    ramp = np.tile(np.arange(24), (24, 1))
    check = np.indices((24, 24)).sum(0) % 2 * 255
    variance, _ = images.laplacian(np.stack([np.full((24, 24), 9), ramp, check]))
    assert variance[0] == variance[1] == 0 and variance[2] > 1000


def test_pyramid_keeps_what_is_missing():
    g = np.array([[[1, 2, 9, 9], [3, 4, 9, -1]]])
    assert images.halved(g).tolist() == [[[3, -1]]]


def test_shift_is_found():
    rng = np.random.default_rng(2)
    big = rng.normal(size=(80, 80))
    for _ in range(2):
        big = (big + np.roll(big, 1, 0) + np.roll(big, 1, 1)) / 3
    a, b = big[10:58, 10:58], big[13:61, 8:56]
    dx, dy, psr = images.phase_shift(a[None] * 50, b[None] * 50)
    assert abs(dx[0] - 2) < 0.5 and abs(dy[0] + 3) < 0.5 and psr[0] > 5


def test_feather_of_a_full_mask():
    w = images.feather_weights(np.ones((8, 20), bool))
    assert w[4, :3].tolist() == [40, 215, 255] and (w == w[:, ::-1]).all()
    mask = np.ones((30, 30), bool)
    mask[15, 15] = False
    near = images.feather_weights(mask, 0.2)
    assert near[15, 15] == 0 and 0 < near[15, 16] < near[15, 18] and (near == near.T).all()


def test_fill_reaches_every_cell():
    known = np.zeros((5, 5), bool)
    known[0, 0] = True
    assert (images.box_filled(np.full((5, 5), 7.0), known) == 7).all()


def test_star_forest_matches_components():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 80, 60), rng.integers(0, 80, 60)
    keep = a != b
    a, b = np.maximum(a, b)[keep], np.minimum(a, b)[keep]
    label = {x: x for x in {*a.tolist(), *b.tolist()}}
    for _ in range(100):
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            label[x] = label[y] = min(label[x], label[y])
    member, head, node = star_forest([np.zeros(len(a), np.int64)], a, b)
    got = dict(zip(node[member].tolist(), node[head].tolist(), strict=True))
    assert got == {k: v for k, v in label.items() if k != v}
