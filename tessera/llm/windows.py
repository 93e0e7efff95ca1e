"""Which fixed-length windows of a document start in an earlier document too.

Every window of `length` symbols (bytes or words) picks as its anchor the smallest hash among its runs of
`anchor` symbols. Equal windows have equal anchors, so windows need only be compared within an anchor.
  1. Chunks send the hashes of their anchors; buckets answer which are in two documents at least.
  2. Chunks send, for those, the pieces of text whose windows have that anchor: each distinct piece once,
     with its places. Buckets compare the windows of all distinct pieces exactly, as the operator says, and
     answer each chunk with the places where a window is in an earlier document.
A common passage is one piece for each chunk, however many of its documents hold it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tessera.llm.exchange import NO_ID, bucket_of, chunk_count, chunked, mix, unpack, unzip_arrays, zip_arrays

#: Windows of a piece at most: longer runs of one anchor (periodic text) are sent in several pieces.
PIECE_WINDOWS = 64
KEY_BYTES = 6
#: Buckets hold less than chunks: a bucket's pieces are held and sorted together.
BUCKETS_PER_CHUNK = 3
#: Texts are hashed together in blocks that fit a core's cache.
BLOCK_BYTES = 150_000


@dataclass(frozen=True)
class Scheme:
    """length, anchor: in symbols.

    block(texts) -> (symbols, symbols of each text, buffer, start, end): 64-bit symbols of all texts in a row and
    where each is in a byte buffer, so that buffer[start[i]:end[j]] spells the symbols i to j.
    least(pieces, windows, doc_ids, anchors) -> for each piece an array with the smallest doc_id of each of its
    windows, by the method of the operator; pieces come by anchor, which are numbers. finish(doc_id, text, removed symbols or None) -> the output row.
    """

    length: int
    anchor: int
    block: Callable
    least: Callable
    finish: Callable
    schema: str


def rolling(symbols: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k symbols in a row, from those of halves."""
    left, n, cur, out, used = k, 1, symbols, None, 0
    while left:
        if left & 1:
            if out is None:
                out, used = cur, n
            else:
                m = min(len(out), len(cur) - used)
                out, used = (out[:m] ^ (out[:m] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + cur[used : used + m], used + n
        left >>= 1
        if left:
            m = len(cur) - n
            cur, n = (cur[:m] ^ (cur[:m] >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) + cur[n : n + m], 2 * n
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    n = 1
    while 2 * n <= w:
        h, n = np.minimum(h[:-n], h[n:]), 2 * n
    return np.minimum(h[: len(h) - (w - n)], h[w - n :]) if n < w else h


def anchors(symbols: np.ndarray, counts: np.ndarray, scheme: Scheme) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, first window, windows) of the runs of windows of one text that have one anchor; places in symbols."""
    none = np.empty(0, np.int64)
    if len(symbols) < scheme.length:
        return np.empty(0, np.uint64), none, none, none
    low = sliding_min(rolling(symbols, scheme.anchor), scheme.length - scheme.anchor + 1)
    begin = np.cumsum(counts) - counts
    stop = begin + np.maximum(counts - scheme.length + 1, 0)
    breaks = np.zeros(len(low) + 1, bool)
    breaks[1:-1] = low[1:] != low[:-1]
    breaks[0] = True
    breaks[begin[begin < len(low)]] = True
    breaks[stop[stop < len(low)]] = True
    first = np.flatnonzero(breaks[:-1])
    n = np.diff(np.r_[first, len(low)])
    text = np.searchsorted(begin, first, side="right") - 1
    inside = first < stop[text]
    first, n, text = first[inside], n[inside], text[inside]
    if len(n) and n.max() > PIECE_WINDOWS:
        parts = -(-n // PIECE_WINDOWS)
        k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        first, text = np.repeat(first, parts) + k * PIECE_WINDOWS, np.repeat(text, parts)
        n = np.minimum(np.repeat(n, parts) - k * PIECE_WINDOWS, PIECE_WINDOWS)
    return mix(low[first]), text, first, n  # minima are small: spread them over all hashes again


def _blocks(ids: np.ndarray, texts: list[bytes], scheme: Scheme) -> Iterator[tuple]:
    """(hash, row, first, windows, first symbol of each text, block) for blocks of texts with an id."""
    rows, size = [], 0
    use = [k for k in range(len(texts)) if ids[k] != NO_ID]
    for at, k in enumerate(use):
        rows.append(k)
        size += len(texts[k])
        if size >= BLOCK_BYTES or at == len(use) - 1:
            symbols, counts, buffer, start, end = scheme.block([texts[k] for k in rows])
            h, text, first, n = anchors(symbols, counts, scheme)
            yield h, np.array(rows)[text], first, n, (np.cumsum(counts) - counts)[text], (buffer, start, end)
            rows, size = [], 0


def _distinct(h: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted anchors, and whether two documents have each; ids ascend."""
    order = np.argsort(h, kind="stable")
    h, ids = h[order], ids[order]
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.empty(0, np.int64)
    last = np.r_[first[1:], len(h)] - 1
    return h[first], ids[first] != ids[last]


def _by_bucket(h: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    edges = np.searchsorted(bucket_of(h, buckets), np.arange(buckets + 1))
    return ((int(b), slice(int(edges[b]), int(edges[b + 1]))) for b in np.flatnonzero(np.diff(edges)))


def _pieces(ids: np.ndarray, texts: list[bytes], scheme: Scheme, buckets: int, masks: dict[int, bytes]) -> Iterator[tuple[int, bytes]]:
    """(bucket, message): hash, text and windows of each distinct piece, and its places (row, first symbol, doc_id)."""
    if not masks:
        return
    blocks = list(_blocks(ids, texts, scheme))
    shared, _ = _distinct(np.concatenate([b[0] for b in blocks]), np.concatenate([ids[b[1]] for b in blocks]))
    keep = np.zeros(len(shared), bool)
    for b, part in _by_bucket(shared, buckets):
        if b in masks:
            keep[part] = np.unpackbits(np.frombuffer(masks[b], np.uint8))[: part.stop - part.start]
    shared = shared[keep]
    known: dict[tuple[int, bytes], int] = {}
    piece, rows, places = [], [], []
    for h, row, first, n, begin, (buffer, start, end) in blocks:
        use = shared[np.minimum(np.searchsorted(shared, h), len(shared) - 1)] == h
        h, row, first, n, begin = h[use], row[use], first[use], n[use], begin[use]
        a, z = start[first].tolist(), end[first + n + scheme.length - 2].tolist()
        piece += [known.setdefault((x, buffer[i:j]), len(known)) for x, i, j in zip(h.tolist(), a, z, strict=True)]
        rows.append(row)
        places.append(np.stack([first - begin, n], 1))
    if not piece:
        return
    piece, rows, places = np.array(piece), np.concatenate(rows), np.concatenate(places)
    hashes, pieces = np.array([x for x, _ in known], np.uint64), [t for _, t in known]
    by_hash = np.argsort(hashes, kind="stable")
    number = np.empty(len(by_hash), np.int64)
    number[by_hash] = np.arange(len(by_hash))
    order = np.argsort(number[piece], kind="stable")
    rows, places, held = rows[order], places[order], np.bincount(number[piece], minlength=len(by_hash))
    upto = np.r_[0, np.cumsum(held)]
    windows = places[upto[:-1], 1]
    hashes = hashes[by_hash]
    for b, part in _by_bucket(hashes, buckets):
        own = [pieces[k] for k in by_hash[part]]
        at = slice(upto[part.start], upto[part.stop])
        yield b, zip_arrays(
            hashes[part], windows[part].astype(np.uint8), np.array([len(t) for t in own], np.uint32), b"".join(own),
            held[part].astype(np.uint32), rows[at].astype(np.uint32), places[at, 0].astype(np.uint32), ids[rows[at]],
        )


def _answers(messages: list[bytes], scheme: Scheme) -> Iterator[bytes]:
    """For each message: row, first symbol and symbols of what earlier documents cover."""
    number: dict[tuple[int, bytes], int] = {}
    windows, asked = [], []
    for blob in messages:
        h, n, sizes, joined, held, row, first, ids = unzip_arrays(blob)
        joined, h, n = bytes(joined), np.frombuffer(h, np.uint64).tolist(), np.frombuffer(n, np.uint8)
        ends = np.cumsum(np.frombuffer(sizes, np.uint32).astype(np.int64))
        begins = np.r_[0, ends[:-1]]
        before = len(number)
        mine = np.array([number.setdefault((x, joined[i:j]), len(number)) for x, i, j in zip(h, begins.tolist(), ends.tolist(), strict=True)], np.int64)
        new = np.flatnonzero(mine >= before)
        fresh = np.empty(len(number) - before, np.int64)
        fresh[mine[new] - before] = n[new]
        windows.append(fresh)
        asked.append((np.repeat(mine, np.frombuffer(held, np.uint32)), np.frombuffer(row, np.uint32), np.frombuffer(first, np.uint32), np.frombuffer(ids, np.int64)))
    windows = np.concatenate(windows)
    least = np.full(len(windows), NO_ID)
    for piece, _, _, ids in asked:
        np.minimum.at(least, piece, ids)
    hashes = np.fromiter((x for x, _ in number), np.uint64, len(number))
    _, inverse, count = np.unique(hashes, return_inverse=True, return_counts=True)
    several = np.flatnonzero(count[inverse] > 1)  # an anchor with one text has nothing to compare it with
    several = several[np.argsort(inverse[several], kind="stable")]
    varying: dict[int, np.ndarray] = {}
    varies = np.zeros(len(windows), bool)
    if len(several):
        texts = [t for _, t in number]
        found = scheme.least([texts[k] for k in several], windows[several].tolist(), least[several].tolist(), inverse[several].tolist())
        for k, low in zip(several.tolist(), found, strict=True):
            least[k] = low[0]
            if low[0] != low.min() or low[0] != low.max():
                varies[k], varying[k] = True, low
    for piece, row, first, ids in asked:
        whole = ~varies[piece] & (least[piece] < ids)
        out = [(row[whole], first[whole], windows[piece[whole]] + scheme.length - 1)]
        for j in np.flatnonzero(varies[piece]).tolist():
            edge = np.flatnonzero(np.diff(np.r_[False, varying[int(piece[j])] < ids[j], False].astype(np.int8)))
            a, n = edge[::2], edge[1::2] - edge[::2]
            out.append((np.full(len(a), row[j]), first[j] + a, n + scheme.length - 1))
        yield zip_arrays(*(np.concatenate(x).astype(np.uint32) for x in zip(*out, strict=True)))


def _covered(answers: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    """(row, removed symbols) of the rows that lose some; the array ends with the last of them."""
    parts = [[np.frombuffer(x, np.uint32).astype(np.int64) for x in unzip_arrays(blob)] for blob in answers]
    if not parts:
        return
    row, first, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(row, kind="stable")
    row, first, n = row[order], first[order], n[order]
    edge = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.empty(0, np.int64)
    for a, z in zip(edge, np.r_[edge[1:], len(row)], strict=True):
        change = np.zeros(int((first[a:z] + n[a:z]).max()) + 1, np.int32)
        np.add.at(change, first[a:z], 1)
        np.add.at(change, first[a:z] + n[a:z], -1)
        yield int(row[a]), np.cumsum(change[:-1]) > 0


def process(docs: DataFrame, scheme: Scheme) -> DataFrame:
    """scheme.finish() of every document with the symbols that its windows of earlier documents cover.

    Documents with a null doc_id are neither searched nor searched for. Rows that repeat a doc_id are the
    same document to each other.
    """
    chunks = chunk_count(docs)
    buckets = BUCKETS_PER_CHUNK * chunks
    texts = chunked(docs, chunks)

    def ask(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ids, own = unpack(pdf["blob"])
        parts = [(h, ids[row]) for h, row, *_ in _blocks(ids, own, scheme)]
        h, twice = _distinct(*map(np.concatenate, zip(*parts, strict=True))) if parts else (np.empty(0, np.uint64), np.empty(0, bool))
        rows = []
        for b, part in _by_bucket(h, buckets):
            low = np.ascontiguousarray(h[part]).view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]
            rows.append((b, key[0], low.tobytes() + np.packbits(twice[part]).tobytes(), part.stop - part.start))
        return pd.DataFrame(rows, columns=["bucket", "chunk", "message", "n"])

    def tell(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        size = pdf["n"].to_numpy()
        h, twice = np.zeros((size.sum(), 8), np.uint8), np.zeros(size.sum(), bool)
        ends = np.cumsum(size)
        for end, n, message in zip(ends, size, pdf["message"], strict=True):
            h[end - n : end, :KEY_BYTES] = np.frombuffer(message[: n * KEY_BYTES], np.uint8).reshape(-1, KEY_BYTES)
            twice[end - n : end] = np.unpackbits(np.frombuffer(message[n * KEY_BYTES :], np.uint8))[:n]
        h = h.view(np.uint64).ravel()
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        # a bit of one chunk counts for all that have the anchor: they are two chunks, so two documents
        twice[order] |= np.r_[False, same] | np.r_[same, False]
        rows = [(c, key[0], np.packbits(twice[end - n : end]).tobytes()) for end, n, c in zip(ends, size, pdf["chunk"], strict=True) if twice[end - n : end].any()]
        return pd.DataFrame(rows, columns=["chunk", "bucket", "message"])

    def send(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        masks = dict(zip(right["bucket"], right["message"], strict=True))
        rows = [(b, key[0], m) for b, m in _pieces(*unpack(left["blob"]), scheme, buckets, masks)]
        return pd.DataFrame(rows, columns=["bucket", "chunk", "message"])

    def resolve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        return pd.DataFrame({"chunk": pdf["chunk"].to_numpy(), "message": list(_answers(list(pdf["message"]), scheme))})

    def apply(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        ids, own = unpack(left["blob"])
        gone = dict(_covered(list(right["message"])))
        rows = [scheme.finish(None if i == NO_ID else i, t, gone.get(row)) for row, (i, t) in enumerate(zip(ids.tolist(), own, strict=True))]
        out = pd.DataFrame(rows, columns=[f.split()[0] for f in scheme.schema.split(", ")])
        out["doc_id"] = out["doc_id"].astype("Int64")
        return out

    asked = texts.groupBy("chunk").applyInPandas(ask, "bucket int, chunk int, message binary, n int")
    masks = asked.groupBy("bucket").applyInPandas(tell, "chunk int, bucket int, message binary")
    sent = texts.groupBy("chunk").cogroup(masks.groupBy("chunk")).applyInPandas(send, "bucket int, chunk int, message binary")
    answers = sent.groupBy("bucket").applyInPandas(resolve, "chunk int, message binary")
    return texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(apply, scheme.schema)
