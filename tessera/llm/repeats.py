"""Suffix-array deduplication with a common-prefix interval tree.

Windows of 50 bytes meet by anchor (see windows.py). The suffixes at the starts of these windows are sorted
into an enhanced suffix array; a stack scan over its common prefixes gives the tree of intervals. An
interval whose suffixes have different left neighbours is a maximal repeat: a group of all its occurrences.
Bytes of an occurrence go if the group holds a smaller doc_id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import windows
from tessera.llm.exchange import BYTE_CODE

MIN_BYTES = 50
ANCHOR_BYTES = 16
#: Windows in one suffix array, about.
ARRAY_WINDOWS = 100_000


def _words(buffer: np.ndarray) -> np.ndarray:
    """The 8 bytes from every place on, as a number that orders like them."""
    n = len(buffer) - 8
    out = np.zeros(n, np.uint64)
    for j in range(8):
        out |= buffer[j : j + n].astype(np.uint64) << np.uint64(56 - 8 * j)
    return out


def suffix_array(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp) of the suffixes buffer[start:end]; lcp[i] is shared by order[i - 1] and order[i], lcp[0] is 0.

    buffer has 16 spare bytes at its end. Common prefixes under `least` may be given too short. Suffixes are sorted by 8 bytes, then only ties by the next 8.
    """
    word, longest = _words(buffer), int((ends - starts).max(initial=0))

    def at(rows: np.ndarray, depth: int) -> np.ndarray:
        left = ends[rows] - starts[rows] - depth
        w = word[np.minimum(starts[rows] + depth, len(word) - 1)]
        cut = np.uint64(64) - np.uint64(8) * np.clip(left, 0, 8).astype(np.uint64)
        return np.where(left > 0, w >> (cut % np.uint64(64)) << (cut % np.uint64(64)), np.uint64(0))

    key = at(np.arange(len(starts)), 0)
    order = np.argsort(key, kind="stable")
    same = np.r_[False, key[order][1:] == key[order][:-1]]
    lcp = np.zeros(len(order), np.int64)
    for depth in range(8, longest + 8, 8):
        lcp[same] = depth
        tied = np.flatnonzero(same | np.r_[same[1:], False])
        if not len(tied):
            break
        rows, group = order[tied], np.cumsum(~same)[tied]
        key = at(rows, depth)
        by = np.lexsort((key, group))
        order[tied], key = rows[by], key[by]
        same[tied] &= np.r_[False, key[1:] == key[:-1]]
    deep = np.flatnonzero(lcp >= least - least % 8)
    gap = at(order[deep - 1], lcp[deep]) ^ at(order[deep], lcp[deep])
    lcp[deep] += sum((gap >> np.uint64(64 - 8 * k) == 0).astype(np.int64) for k in range(1, 8))
    size = ends - starts
    if len(order):
        lcp[1:] = np.minimum(lcp[1:], np.minimum(size[order[1:]], size[order[:-1]]))
    return order, lcp


def intervals(lcp: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """(first, last, length) of every node of the interval tree whose common prefix is at least `least` long."""
    stack: list[tuple[int, int]] = []
    for i in range(1, len(lcp) + 1):
        now, first = lcp[i] if i < len(lcp) else 0, i - 1
        while stack and stack[-1][1] > now:
            first, length = stack.pop()
            if length >= least:
                yield first, i - 1, length
        if now >= least and (not stack or stack[-1][1] < now):
            stack.append((first, now))


def _layout(pieces: list[bytes], n: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buffer, window starts and ends, left neighbours (-1 at the start of a piece, else the byte)."""
    buffer = np.frombuffer(b"".join(pieces) + bytes(16), np.uint8)
    size, count = np.array([len(p) for p in pieces], np.int64), np.array(n, np.int64)
    first = np.cumsum(size) - size
    piece = np.repeat(np.arange(len(pieces)), count)
    within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    starts = first[piece] + within
    left = np.where(within > 0, buffer[starts - 1].astype(np.int64), -1)
    return buffer, starts, (first + size)[piece], left


def _paired(left: np.ndarray, order: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of the intervals order[at:at + 2], those with different left neighbours."""
    a, b = left[order[at]], left[order[at + 1]]
    return at[(a < 0) | (b < 0) | (a != b)]


def maximal_repeats(pieces: list[bytes], n: list[int], least: int = MIN_BYTES) -> tuple[tuple, Iterator[tuple[int, np.ndarray]]]:
    """((lengths, first windows, second windows) of the repeats with two windows, (length, windows) of the others).

    Windows are numbered piece by piece. Pairs, most of the tree, are leaves and need no stack.
    """
    buffer, starts, ends, left = _layout(pieces, n)
    order, lcp = suffix_array(buffer, starts, ends, least)
    breaks = np.flatnonzero(lcp < least)
    size = np.diff(np.r_[breaks, len(lcp)])
    two = _paired(left, order, breaks[size == 2])

    def larger() -> Iterator[tuple[int, np.ndarray]]:
        for a, m in zip(breaks[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            inner = lcp[a : a + m].tolist()
            inner[0] = 0
            around = left[order[a : a + m]].tolist()
            for first, last, length in intervals(inner, least):
                own = around[first : last + 1]
                if min(own) < 0 or min(own) != max(own):
                    yield length, order[a + first : a + last + 1]

    return (lcp[two + 1], order[two], order[two + 1]), larger()


def least_ids(pieces: list[bytes], n: list[int], doc_ids: list[int], anchors: list[int], least: int = MIN_BYTES) -> list[np.ndarray]:
    """For each piece, the smallest doc_id that has each of its windows; a suffix array holds some anchors at a time."""
    out, at = [], 0
    while at < len(pieces):
        end, size = at, 0
        while end < len(pieces) and (size < ARRAY_WINDOWS or anchors[end] == anchors[end - 1]):
            size += n[end]
            end += 1
        out += _least(pieces[at:end], n[at:end], doc_ids[at:end], least)
        at = end
    return out


def _least(pieces: list[bytes], n: list[int], doc_ids: list[int], least: int) -> list[np.ndarray]:
    count = np.array(n, np.int64)
    own = np.repeat(np.array(doc_ids, np.int64), count)
    found = own.copy()
    (lengths, one, two), larger = maximal_repeats(pieces, n, least)
    many = lengths - least + 1
    step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    low = np.repeat(np.minimum(own[one], own[two]), many)
    for side in (one, two):
        np.minimum.at(found, np.repeat(side, many) + step, low)
    for length, members in larger:
        places = members[:, None] + np.arange(length - least + 1)
        found[places] = np.minimum(found[places], own[members].min())
    return np.split(found, np.cumsum(count)[:-1])


def _block(texts: list[bytes]) -> tuple:
    buffer = b"".join(texts)
    place = np.arange(len(buffer))
    return BYTE_CODE[np.frombuffer(buffer, np.uint8)], np.array([len(t) for t in texts], np.int64), buffer, place, place + 1


def _spans(removed: np.ndarray | None) -> np.ndarray:
    """(start, end) rows of the removed runs."""
    if removed is None:
        return np.empty((0, 2), np.int64)
    return np.flatnonzero(np.diff(np.r_[False, removed, False].astype(np.int8))).reshape(-1, 2)


def _finish(doc_id: int | None, text: bytes, removed: np.ndarray | None) -> tuple:
    spans = _spans(removed)
    kept, at = [], 0
    for a, b in spans.tolist():
        kept.append(text[at:a])
        at = b
    kept.append(text[at:])
    return doc_id, len(text), int((spans[:, 1] - spans[:, 0]).sum()), len(spans), spans.ravel().tolist(), b"".join(kept), hashlib.md5(text).hexdigest()


SCHEME = windows.Scheme(MIN_BYTES, ANCHOR_BYTES, _block, least_ids, _finish, "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<long>, kept binary, text_md5 string")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, spans (start, end, ... in bytes), kept (bytes), text_md5.

    Every byte goes that is covered by 50 bytes which also start in a document with a smaller doc_id. A null
    text is empty; texts under 50 bytes are kept; rows that repeat a doc_id do not remove each other's text;
    rows with a null doc_id are kept whole and remove nothing; an empty table gives no rows.
    """
    return windows.process(docs, SCHEME)


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with what is left as text (a character cut in two becomes U+FFFD) and n_chars to match.

    Documents of which every byte goes are dropped; all other rows and columns stay as they are.
    """
    found = remove_repeats(docs).where("doc_id is not null and n_removed > 0")
    found = found.select(F.col("doc_id").alias("_id"), F.col("text_md5").alias("_md5"), F.make_valid_utf8(F.col("kept").cast("string")).alias("_kept")).dropDuplicates(["_id", "_md5"])
    joined = docs.join(found, (docs["doc_id"].cast("long") == found["_id"]) & (F.md5(docs["text"].cast("binary")) == found["_md5"]), "left")
    put = {"text": F.coalesce("_kept", docs["text"])}
    if "n_chars" in docs.columns:
        put["n_chars"] = F.when(F.col("_kept").isNull(), docs["n_chars"]).otherwise(F.length("_kept")).cast(docs.schema["n_chars"].dataType)
    return joined.where("_kept is null or _kept <> ''").withColumns(put).select(*docs.columns)
