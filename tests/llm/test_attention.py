"""The gradient of the attention model against finite differences."""

import numpy as np

from tessera.llm import attention as A


def test_gradient_is_the_slope_of_the_loss():
    rng = np.random.default_rng(3)
    v = A.Vocabulary(rng.integers(0, 50, A.IDS).astype(float), rng.integers(0, 2, A.IDS))
    p = A.initial(v)
    rows, classes = rng.integers(0, 40, (5, A.CONTEXT)), rng.integers(0, A.CLASSES, (5, A.CONTEXT))
    valid = rng.random(rows.shape) < 0.8
    loss, g = A.gradient(p, rows, classes, valid)
    room = np.full((100, A.CLASSES), 7, np.float32)
    again, same = A.gradient(p, rows, classes, valid, room)
    assert again == loss and all(np.array_equal(g[k], same[k]) for k in A.NAMES)
    assert np.isclose(loss, -A.log_chance(p, rows, valid, classes[valid]).mean(), rtol=1e-5)
    p = {k: x.astype(np.float64) for k, x in p.items()}
    for name in A.NAMES:
        way = g[name].astype(np.float64) / np.linalg.norm(g[name])
        up, down = (A.gradient(p | {name: p[name] + s * 0.01 * way}, rows, classes, valid)[0] for s in (1, -1))
        assert np.isclose((up - down) / 0.02, np.linalg.norm(g[name]), rtol=0.03), name
