"""Token ids against the contract's own tokenizer, long white space included."""

import time

import pytest
import tokenizers

from conftest import DATA
from tessera.llm import packing


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers

    return tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def same(reference, text):
    assert packing.ids_of(packing.ranks_path(), text) == reference.encode(text, add_special_tokens=False).ids


def test_ids_of_all_documents(spark, reference):
    for r in spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").select("text").collect():
        same(reference, r["text"] or "")


def test_long_white_space(reference):
    n = packing.LONG_BLANK + 5
    for blank in (" ", "\n", "\t ", "\u3000", " \n"):
        for text in (blank * n, "a" + blank * n, blank * n + "b", f"x {blank * n}'s y{blank * n}\x1cz", f"q{blank * n}{packing.END_MARK} r"):
            same(reference, text)


def test_a_million_characters_take_seconds(spark, reference):
    texts = [" " * 1_000_000, "x" + "\n" * 1_000_000 + "y", "a" * 1_000_000, "7" * 300_000]
    began = time.time()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["n"] for r in packing.token_pieces(docs).groupBy("doc_id").sum("length").withColumnRenamed("sum(length)", "n").collect()}
    assert time.time() - began < 60
    assert got[0] == 1_000_001
    for i in (0, 1):
        assert got[i] == len(reference.encode(texts[i], add_special_tokens=False).ids) + 1
