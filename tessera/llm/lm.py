"""Language-model scores: corpus-wide word counts and a causal self-attention model over subword ids.

Chunks of documents count their words and send each distinct word's hash and training count to a bucket;
buckets add up and answer in the order asked, so every document learns the corpus count of its words. The
counts of subwords over all training documents shape the vocabulary of the attention model; the training
documents are cut into consecutive context windows, each subword the target of one, and the tasks that hold
them train in numpy on all of them, a chunk at a time, the weights averaged between rounds. Every subword of every text is then scored once in overlapping windows. The chance of a
word is that of its subwords, mixed with the word's corpus share (c / N; a share of 0 for unknown words), so
the score is the log probability of a proper model of texts.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.shared import materialize
from tessera.llm import attention as A
from tessera.llm.exchange import NO_ID, bucket_of, chunk_count, chunked, mix, unpack, unzip_arrays, word_hashes, zip_arrays
from tessera.llm.packing import encoding, ordinary_ids, ranks_path

DIVISOR, HELD_OUT = 7, 2
ROUNDS, STEPS, RATE = 2, 300, 0.01
#: Weight of the attention model against the corpus share of the word, for words that training documents have.
MIXED = 0.5
#: Training tasks average in this many groups before the driver adds up the last few.
GROUPS = 8
BLOCK_BYTES = 150_000


def is_held_out(doc_id: int) -> bool:
    return doc_id != NO_ID and zlib.crc32(str(doc_id).encode()) % DIVISOR == HELD_OUT


class Words:
    """The words of a chunk's texts: number of each in the sorted distinct hashes, and words of each text."""

    def __init__(self, texts: list[bytes]) -> None:
        hashes, starts, ends, self.counts = [np.empty(0, np.uint64)], [], [], np.zeros(len(texts), np.int64)
        self.buffer = b"\n".join(texts)
        at = first = 0
        while first < len(texts):
            last, size = first, 0
            while last < len(texts) and size < BLOCK_BYTES:
                size += len(texts[last]) + 1
                last += 1
            h, s, e = word_hashes(self.buffer[at : at + size])
            bounds = at + np.cumsum([0, *(len(t) + 1 for t in texts[first:last])])
            self.counts[first:last] = np.diff(np.searchsorted(s + at, bounds))
            hashes.append(h)
            starts.append(s + at)
            ends.append(e + at)
            at, first = at + size, last
        h = np.concatenate(hashes)
        self.hashes, place, self.word = np.unique(h, return_index=True, return_inverse=True)
        start, end = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (starts, ends))
        self.start, self.end = start[place], end[place]
        self.text = np.repeat(np.arange(len(texts)), self.counts)

    def subwords(self, path: str) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all distinct words in a row, ids of each): each word is encoded after a blank."""
        found = [ordinary_ids(path, " " + self.buffer[a:z].decode()) for a, z in zip(self.start.tolist(), self.end.tolist(), strict=True)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for ids in found for i in ids), np.uint16, int(sizes.sum())), sizes

    def by_bucket(self, buckets: int) -> Iterator[tuple[int, slice]]:
        edges = np.searchsorted(bucket_of(self.hashes, buckets), np.arange(buckets + 1))
        return ((int(b), slice(int(edges[b]), int(edges[b + 1]))) for b in np.flatnonzero(np.diff(edges)))


def _spread(ids: np.ndarray, sizes: np.ndarray, word: np.ndarray, begin: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(subwords of a run of words, how many each has); begin: where each word's start, if known: it takes a pass over all words."""
    n = sizes[word]
    begin = (np.cumsum(sizes) - sizes if begin is None else begin)[word]
    return ids[np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())].astype(np.int64), n


def _windows(words: Words, ids: np.ndarray, sizes: np.ndarray, learn: np.ndarray) -> np.ndarray:
    """All training texts as rows of CONTEXT + 1 ids, each from the last id of the row before; -1: the start, -2: nothing."""
    upto, begin = np.r_[0, np.cumsum(words.counts)], np.cumsum(sizes) - sizes
    rows = [np.empty((0, A.CONTEXT + 1), np.int32)]
    for t in np.flatnonzero(learn).tolist():
        own, _ = _spread(ids, sizes, words.word[upto[t] : upto[t + 1]], begin)
        n = -(-(len(own) + 1) // A.CONTEXT)
        full = np.full(n * A.CONTEXT + 1, -2, np.int32)
        full[0], full[1 : len(own) + 1], full[len(own) + 1] = -1, own, A.END
        rows.append(np.lib.stride_tricks.sliding_window_view(full, A.CONTEXT + 1)[:: A.CONTEXT])
    return np.concatenate(rows)


def _turn(rows: np.ndarray, round_: int) -> np.ndarray:
    """The rows of a round, a share by hash whatever their number, so that the rounds together see every row."""
    return rows[mix(np.arange(len(rows), dtype=np.uint64)) % np.uint64(ROUNDS) == round_]


def _dump(p: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **p)
    return out.getvalue()


def _load(blob: bytes) -> dict[str, np.ndarray]:
    return dict(np.load(io.BytesIO(blob)))


def _train(windows: DataFrame, vocabulary: A.Vocabulary) -> dict[str, np.ndarray]:
    """Rounds of local training on each chunk's windows, each from the mean weights of the last."""
    weights, context = A.initial(vocabulary), windows.sparkSession.sparkContext

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, mean = A.averaged((int(m), _load(w)) for batch in batches for m, w in zip(batch["n"], batch["weights"], strict=True))
        if n:
            yield pd.DataFrame({"n": [n], "weights": [_dump(mean)]})

    for round_ in range(ROUNDS):
        sent = context.broadcast((weights, vocabulary))

        def learn(batches: Iterator[pd.DataFrame], sent=sent, round_=round_) -> Iterator[pd.DataFrame]:
            weights, vocabulary = sent.value
            for batch in batches:
                for m in batch["message"]:  # a chunk at a time: memory stays bounded
                    rows = np.frombuffer(unzip_arrays(m)[0], np.int32).reshape(-1, A.CONTEXT + 1)
                    rows = _turn(rows[np.lexsort(rows.T)], round_)
                    if not len(rows):
                        continue
                    safe = np.maximum(rows, 0)
                    inputs = np.where(rows[:, :-1] >= 0, vocabulary.row[safe[:, :-1]], A.START)
                    valid = rows[:, 1:] >= 0
                    out = A.fit(weights, inputs, vocabulary.of[safe[:, 1:]], valid, STEPS, RATE / (1 + 2 * round_), seed=round_)
                    yield pd.DataFrame({"n": [len(rows)], "weights": [_dump(out)]})

        done = windows.mapInPandas(learn, "n long, weights binary").repartition(GROUPS).mapInPandas(merge, "n long, weights binary").collect()
        if not done:
            return weights
        _, weights = A.averaged((r["n"], _load(r["weights"])) for r in sorted(done, key=lambda r: (r["n"], r["weights"])))
    return weights


def score(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words of the text with A to Z in lower case, then one end. base_score is the add-one
    unigram score in log10, score the attention model's log10 probability of the words' subwords and the
    end. A null text is empty (its end is scored); rows that repeat a doc_id count and get a row each; a row
    with a null doc_id is scored, not held out, and nothing is learned from it; an empty table gives no rows;
    without training documents every count is 0.
    """
    path = path or ranks_path()
    chunks = chunk_count(docs)
    buckets = chunks
    texts = chunked(docs, chunks)

    def read(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, Words]:
        ids, own = unpack(pdf["blob"])
        held = np.array([is_held_out(i) for i in ids.tolist()], bool)
        return ids, held, Words([t.lower() for t in own])

    def count(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        doc_ids, held, words = read(pdf)
        learn = ~held & (doc_ids != NO_ID)
        n = np.bincount(words.word, learn[words.text], len(words.hashes)).astype(np.uint32)
        ids, sizes = words.subwords(path)
        rows = [(0, b, key[0], zip_arrays(words.hashes[part], n[part])) for b, part in words.by_bucket(buckets)]
        often = np.bincount(ids, np.repeat(n, sizes), A.IDS)
        often[A.END] += learn.sum()
        seen = np.flatnonzero(often)
        rows += [(1, int(learn.sum()), key[0], zip_arrays(seen.astype(np.int64), often[seen].astype(np.int64)))]
        rows += [(2, 0, key[0], zip_arrays(_windows(words, ids, sizes, learn))), (3, 0, key[0], zip_arrays(ids, sizes))]
        return pd.DataFrame(rows, columns=["kind", "bucket", "chunk", "message"])

    counted = materialize(texts.groupBy("chunk").applyInPandas(count, "kind int, bucket int, chunk int, message binary"), "words")

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [[np.frombuffer(a, t) for a, t in zip(unzip_arrays(m), (np.uint64, np.uint32), strict=True)] for m in pdf["message"]]
        known, inverse = np.unique(np.concatenate([h for h, _ in parts]), return_inverse=True)
        total = np.bincount(inverse, np.concatenate([n for _, n in parts]), len(known)).astype(np.int64)
        ends = np.cumsum([len(h) for h, _ in parts])
        answers = [zip_arrays(total[part]) for part in np.split(inverse, ends[:-1])]
        return pd.DataFrame({"chunk": pdf["chunk"].to_numpy(), "bucket": key[0], "message": answers, "tokens": [int(total.sum()), *[0] * (len(parts) - 1)], "types": [int((total > 0).sum()), *[0] * (len(parts) - 1)]})

    added = materialize(counted.where("kind = 0").groupBy("bucket").applyInPandas(add, "chunk int, bucket int, message binary, tokens long, types long"), "counts")
    sums = added.agg(F.sum("tokens").alias("n"), F.sum("types").alias("v")).first()
    trained = int(counted.where("kind = 1").agg(F.sum("bucket")).first()[0] or 0)
    n_all, types = (sums["n"] or 0) + trained, (sums["v"] or 0) + (trained > 0)

    def subword_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(A.IDS, np.int64)
        for batch in batches:
            for m in batch["message"]:
                seen, often = (np.frombuffer(a, np.int64) for a in unzip_arrays(m))
                total[seen] += often
        seen = np.flatnonzero(total)
        yield pd.DataFrame({"id": seen, "n": total[seen]})

    often = np.zeros(A.IDS)
    for r in counted.where("kind = 1").mapInPandas(subword_rows, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        often[r["id"]] = r["n"]  # a row for each id of the vocabulary at most
    begins = np.zeros(A.IDS, np.int64)
    for i in range(A.END):
        begins[i] = encoding(path).decode_single_token_bytes(i)[:1] == b" "
    vocabulary = A.Vocabulary(often, begins)
    weights = _train(counted.where("kind = 2").select("message"), vocabulary)
    sent = docs.sparkSession.sparkContext.broadcast((weights, vocabulary))

    def finish(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        weights, vocabulary = sent.value
        doc_ids, held, words = read(left)
        corpus = np.zeros(len(words.hashes), np.int64)
        answers = dict(zip(right["bucket"], right["message"], strict=True))
        for b, part in words.by_bucket(buckets):
            corpus[part] = np.frombuffer(unzip_arrays(answers[b])[0], np.int64)
        ids, sizes = unzip_arrays(answers[-1])
        ids, sizes = np.frombuffer(ids, np.uint16), np.frombuffer(sizes, np.int64)
        n_texts = len(doc_ids)
        tokens = words.counts + 1
        base = np.bincount(words.text, np.log10(corpus + 1.0)[words.word], n_texts) + np.log10(trained + 1.0) - tokens * np.log10(n_all + types + 1.0)
        known = np.bincount(words.text, (corpus > 0)[words.word], n_texts).astype(np.int64) + (trained > 0)
        with np.errstate(divide="ignore"):
            share = np.log(corpus / max(n_all, 1)) + np.log(1 - MIXED)
            end_share = np.log(trained / max(n_all, 1)) + np.log(1 - MIXED)
        upto, chance = np.r_[0, np.cumsum(words.counts)], np.zeros(n_texts)
        first = 0
        while first < n_texts:  # some texts at a time: memory stays bounded
            last = max(first + 1, int(np.searchsorted(upto, upto[first] + 100_000)) - 1)
            own, m = _spread(ids, sizes, words.word[upto[first] : upto[last]])
            text = np.repeat(words.text[upto[first] : upto[last]] - first, m)
            size = np.bincount(text, minlength=last - first) + 1
            ends = np.cumsum(size) - 1
            full = np.full(int(size.sum()), A.END, np.int64)
            place = np.ones(len(full), bool)
            place[ends] = False
            full[place] = own
            each = A.score_ids(weights, vocabulary, full, size)
            starts = np.r_[0, np.cumsum(sizes[words.word[upto[first] : upto[last]]])[:-1]] if len(own) else np.empty(0, np.int64)
            by_word = np.add.reduceat(each[place], starts) if len(own) else np.empty(0)
            mixed = np.logaddexp(np.log(MIXED) + by_word, share[words.word[upto[first] : upto[last]]])
            chance[first:last] = np.bincount(words.text[upto[first] : upto[last]] - first, mixed, last - first)
            chance[first:last] += np.logaddexp(np.log(MIXED) + each[ends], end_share)
            first = last
        out = pd.DataFrame({"doc_id": pd.Series([None if i == NO_ID else i for i in doc_ids.tolist()], dtype="Int64"), "held_out": held, "n_tokens": tokens, "n_known": known})
        return out.assign(train_tokens=n_all, base_score=base, score=chance / np.log(10))

    back = added.select("chunk", "bucket", "message").unionByName(counted.where("kind = 3").selectExpr("chunk", "-1 AS bucket", "message"))
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return texts.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInPandas(finish, schema)
