"""A small causal self-attention model over subword ids, in numpy.

One layer, one head: x = embedding + place; h = x + attention(x); y = h + relu(h W1) W2; the softmax of
y U + b gives the class of the next subword, and the corpus counts of its class give the subword. Classes
are the commonest subwords, one each, and bins of equal mass of the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WIDTH, HIDDEN = 16, 32
#: Subwords in a context window; each window after the first of a text scores its last STRIDE subwords.
CONTEXT, STRIDE = 16, 12
CLASSES, BINS = 112, 16
EMBEDDINGS, SHARED = 4096, 256
IDS = 50257
#: Ends a text; the id of the vocabulary's own end mark, which ordinary text never gives.
END = 50256
#: Passes over few windows.
PASSES = 6
_TRIANGLE = np.tril(np.ones((CONTEXT, CONTEXT), np.float32))
_ONES = np.ones(CLASSES, np.float32)
NAMES = ("embed", "place", "qkv", "out", "w1", "b1", "w2", "u", "b")


class Vocabulary:
    """Class, chance within the class and embedding row of every id, from the corpus counts of ids."""

    def __init__(self, counts: np.ndarray, begins_word: np.ndarray) -> None:
        order = np.lexsort((np.arange(IDS), -counts))
        single = CLASSES - BINS
        self.of = np.empty(IDS, np.int64)
        self.of[order[:single]] = np.arange(single)
        rest = order[single:]
        for side in (0, 1):
            own = rest[begins_word[rest] == side]
            mass = np.cumsum(counts[own] + 1.0)
            self.of[own] = single + side * (BINS // 2) + np.minimum((mass / max(mass[-1] if len(mass) else 1, 1) * (BINS // 2)).astype(np.int64), BINS // 2 - 1)
        smooth = counts + 1.0
        self.within = np.log(smooth / np.bincount(self.of, smooth, CLASSES)[self.of]).astype(np.float32)
        self.row = np.empty(IDS, np.int64)
        own = EMBEDDINGS - SHARED - 1
        self.row[order[:own]] = np.arange(own)
        self.row[order[own:]] = own + order[own:] % SHARED
        self.mass = np.bincount(self.of, smooth, CLASSES)


#: Embedding row of the start of a text.
START = EMBEDDINGS - 1


def initial(vocabulary: Vocabulary, seed: int = 5) -> dict[str, np.ndarray]:
    """Weights that predict the corpus shares of the classes, whatever the context."""
    rng = np.random.default_rng(seed)
    draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    share = vocabulary.mass / vocabulary.mass.sum()
    return {
        "embed": draw(EMBEDDINGS, WIDTH, scale=0.3), "place": draw(CONTEXT, WIDTH, scale=0.1), "qkv": draw(WIDTH, 3 * WIDTH, scale=WIDTH**-0.5),
        "out": draw(WIDTH, WIDTH, scale=WIDTH**-0.5), "w1": draw(WIDTH, HIDDEN, scale=WIDTH**-0.5), "b1": np.zeros(HIDDEN, np.float32),
        "w2": draw(HIDDEN, WIDTH, scale=0.1), "u": draw(WIDTH, CLASSES, scale=0.05), "b": np.log(share).astype(np.float32),
    }


def _hidden(p: dict[str, np.ndarray], rows: np.ndarray) -> tuple:
    n = len(rows)
    x = p["embed"][rows] + p["place"]
    flat = x.reshape(-1, WIDTH)
    q, k, v = (a.reshape(n, CONTEXT, WIDTH) for a in np.split(flat @ p["qkv"], 3, axis=1))
    a = q @ k.transpose(0, 2, 1)
    a *= np.float32(WIDTH**-0.5)
    np.exp(np.minimum(a, 60, out=a), out=a)
    a *= _TRIANGLE
    a /= a.sum(2, keepdims=True)
    o = (a @ v).reshape(-1, WIDTH)
    return x, q, k, v, a, o, flat + o @ p["out"]


def _logits(p: dict[str, np.ndarray], y: np.ndarray, room: np.ndarray | None) -> np.ndarray:
    """Scores of all classes, at most 80, in the rows of `room` if given: fresh pages cost more than the products."""
    out = np.empty((len(y), CLASSES), np.float32) if room is None else room[: len(y)]
    np.matmul(y, p["u"], out=out)
    out += p["b"]
    return np.minimum(out, 80, out=out)


def log_chance(p: dict[str, np.ndarray], rows: np.ndarray, counted: np.ndarray, classes: np.ndarray, room: np.ndarray | None = None) -> np.ndarray:
    """Log probability of the class that follows each counted place."""
    h = _hidden(p, rows)[-1][counted.ravel()]
    r = h @ p["w1"]
    r += p["b1"]
    h += np.maximum(r, 0, out=r) @ p["w2"]
    e = _logits(p, h, room)
    got = e[np.arange(len(e)), classes]
    return got - np.log(np.exp(e, out=e) @ _ONES)


def gradient(p: dict[str, np.ndarray], rows: np.ndarray, classes: np.ndarray, valid: np.ndarray, room: np.ndarray | None = None) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss in nats over the valid targets, and its gradient."""
    x, q, k, v, a, o, h = _hidden(p, rows)
    r = np.maximum(h @ p["w1"] + p["b1"], 0)
    y = h + r @ p["w2"]
    n, count, c, ok = len(rows), max(int(valid.sum()), 1), classes.ravel(), valid.ravel()
    d, place = _logits(p, y, room), np.arange(len(c))
    got = d[place, c]
    total = np.exp(d, out=d) @ _ONES
    loss = float((np.log(total) - got)[ok].sum()) / count
    part = ok / np.float32(count)
    d *= (part / total)[:, None]
    d[place, c] -= part
    g = {"u": y.T @ d, "b": np.ones(len(c), np.float32) @ d}
    dy = d @ p["u"].T
    dr = (dy @ p["w2"].T) * (r > 0)
    g |= {"w2": r.T @ dy, "w1": h.T @ dr, "b1": dr.sum(0)}
    dh = dy + dr @ p["w1"].T
    g["out"] = o.T @ dh
    do = (dh @ p["out"].T).reshape(n, CONTEXT, WIDTH)
    da = do @ v.transpose(0, 2, 1)
    da -= np.einsum("nij,nij->ni", da, a)[:, :, None]
    da *= a
    da *= np.float32(WIDTH**-0.5)
    parts = np.empty((n, CONTEXT, 3 * WIDTH), np.float32)
    np.matmul(da, k, out=parts[:, :, :WIDTH])
    np.matmul(da.transpose(0, 2, 1), q, out=parts[:, :, WIDTH : 2 * WIDTH])
    np.matmul(a.transpose(0, 2, 1), do, out=parts[:, :, 2 * WIDTH :])
    parts = parts.reshape(-1, 3 * WIDTH)
    g["qkv"] = x.reshape(-1, WIDTH).T @ parts
    dx = dh + parts @ p["qkv"].T
    g["place"] = dx.reshape(n, CONTEXT, WIDTH).sum(0)
    g["embed"] = np.zeros_like(p["embed"])
    order = np.argsort(rows.ravel().astype(np.int16), kind="stable")  # EMBEDDINGS rows: a radix sort
    sorted_rows = rows.ravel()[order]
    first = np.flatnonzero(np.r_[True, sorted_rows[1:] != sorted_rows[:-1]])
    g["embed"][sorted_rows[first]] = np.add.reduceat(dx[order], first)
    return loss, g


def fit(p: dict[str, np.ndarray], rows: np.ndarray, classes: np.ndarray, valid: np.ndarray, steps: int, rate: float, batch: int = 64, seed: int = 1) -> dict[str, np.ndarray]:
    """Adam over shuffled batches: about `steps` of them, but one pass over all windows at least and PASSES at most."""
    p = {k: v.copy() for k, v in p.items()}
    m, s = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    rng, n = np.random.default_rng(seed), len(rows)
    per_pass = -(-n // batch)
    total = min(max(1, -(-steps // per_pass)), PASSES) * per_pass
    order, room = np.empty(0, np.int64), np.empty((batch * CONTEXT, CLASSES), np.float32)
    for t in range(1, total + 1):
        if len(order) < min(batch, n):
            order = np.r_[order, rng.permutation(n)]
        part, order = order[:batch], order[batch:]
        _, g = gradient(p, rows[part], classes[part], valid[part], room)
        now = rate * (1 - 0.9 * (t - 1) / total)
        for key in NAMES:
            m[key] += 0.1 * (g[key] - m[key])
            s[key] += 0.01 * (g[key] * g[key] - s[key])
            p[key] -= (now / (1 - 0.9**t)) * m[key] / (np.sqrt(s[key] / (1 - 0.99**t)) + 1e-8)
    return {k: v.astype(np.float32) for k, v in p.items()}


def score_ids(p: dict[str, np.ndarray], vocabulary: Vocabulary, ids: np.ndarray, sizes: np.ndarray, batch: int = 64) -> np.ndarray:
    """Natural log probability of every id; ids: those of all texts in a row, sizes: ids of each (1 at least).

    Windows overlap by CONTEXT - STRIDE; every id is scored once, with CONTEXT - STRIDE ids before it at
    least, or all there are.
    """
    begin = np.cumsum(sizes) - sizes
    windows = 1 + -(-np.maximum(sizes - CONTEXT, 0) // STRIDE)
    text = np.repeat(np.arange(len(sizes)), windows)
    nth = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    first, last = begin[text] + nth * STRIDE, begin[text] + sizes[text]
    before = np.r_[START, vocabulary.row[ids[:-1]]]
    before[begin] = START
    before = np.r_[before, np.full(CONTEXT, START)]
    of, out, place = vocabulary.of[ids], np.zeros(len(ids)), np.arange(CONTEXT)
    room = np.empty((batch * CONTEXT, CLASSES), np.float32)
    for a in range(0, len(first), batch):
        at = first[a : a + batch, None] + place
        counted = (at < last[a : a + batch, None]) & ((place >= CONTEXT - STRIDE) | (nth[a : a + batch, None] == 0))
        use = at[counted]
        out[use] = log_chance(p, before[at], counted, of[use], room)
    return out + vocabulary.within[ids]


def averaged(parts: Iterator[tuple[int, dict[str, np.ndarray]]]) -> tuple[int, dict[str, np.ndarray]]:
    """The mean of the weights, by the number of windows."""
    n, total = 0, None
    for m, p in parts:
        n += m
        total = {k: p[k].astype(np.float64) * m + (total[k] if total else 0) for k in NAMES}
    return n, {k: (v / max(n, 1)).astype(np.float32) for k, v in total.items()} if total else {}
