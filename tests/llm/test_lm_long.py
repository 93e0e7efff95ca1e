"""Language-model scores beside a text that is a single word of very many subwords."""

import random

import numpy as np

from tessera.llm import lm, packing


def test_word_of_many_subwords_leaves_other_scores(spark):
    rng = random.Random(5)
    path = packing.ranks_path()
    run = "".join(rng.choices("0123456789abcdefghijklmnopqrstuvwxyz+/", k=130_000))
    size = len(packing.encoding(path).encode_ordinary(" " + run))
    assert size > 65_535
    held = next(i for i in range(100) if lm.is_held_out(i))  # nothing is learned from it
    learn = [i for i in range(100, 160) if not lm.is_held_out(i)][:20]
    pool = ["".join(rng.choices("abcdefghijklm", k=rng.randrange(2, 9))) for _ in range(300)]  # some come after the run in order of hash
    rows = [(i, " ".join(rng.choices(pool, k=60))) for i in learn]
    with_run = rows + [(held, run)]
    schema = "doc_id long, text string"
    alone = {r["doc_id"]: r["score"] for r in lm.score(spark.createDataFrame(rows, schema).coalesce(1)).collect()}
    beside = {r["doc_id"]: r["score"] for r in lm.score(spark.createDataFrame(with_run, schema).coalesce(1)).collect()}
    for i in learn:
        assert np.isclose(alone[i], beside[i], rtol=1e-5), (i, alone[i], beside[i])
    assert beside[held] < -2 * size  # every subword is scored
