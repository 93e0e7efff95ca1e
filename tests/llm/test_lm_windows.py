"""The attention model learns from the whole of every training text."""

import numpy as np

from tessera.llm import attention, lm, packing


def test_every_subword_is_a_target_once():
    path = packing.ranks_path()
    texts = [b"", b"one", b"red green blue " * 2_000, b"not learned from " * 50]
    words = lm.Words(texts)
    ids, sizes = words.subwords(path)
    rows = lm._windows(words, ids, sizes, np.array([True, True, True, False]))
    encode = packing.encoding(path).encode_ordinary
    want = [[i for w in t.decode().split() for i in encode(" " + w)] + [attention.END] for t in texts[:3]]
    assert [i for i in rows[:, 1:].ravel().tolist() if i >= 0] == sum(want, [])
    assert (rows[:, 0] == -1).sum() == 3
    assert all(a[-1] == b[0] for a, b in zip(rows, rows[1:], strict=False) if b[0] >= 0)


def test_rounds_cover_all_windows():
    for n in (1, 10, 50_000):
        rows = np.arange(n)[:, None]
        assert set(np.concatenate([lm._turn(rows, k) for k in range(lm.ROUNDS)]).ravel().tolist()) == set(range(n))


def test_windows_place_the_words_once_a_chunk(monkeypatch):
    words = lm.Words([b"one two three", b"two four", b"", b"one five six seven"])
    ids, sizes = words.subwords(packing.ranks_path())
    begins, spread = [], lm._spread

    def watched(ids, sizes, word, begin=None):
        begins.append(begin)
        return spread(ids, sizes, word, begin)

    monkeypatch.setattr(lm, "_spread", watched)
    lm._windows(words, ids, sizes, np.array([True] * 4))
    assert len(begins) == 4 and begins[0] is not None and all(b is begins[0] for b in begins)  # not a pass over all words for each text
