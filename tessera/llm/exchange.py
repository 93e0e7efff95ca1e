"""Documents in chunks, and the two-way exchange of what chunks share.

A chunk is the documents of one hash of doc_id, CHUNK_BYTES of text on average, shuffled as compressed
blobs. Facts about the corpus (which strings occur in other documents, how often a word occurs) are asked
for in bulk: each chunk sends one message to every bucket of a hash range, each bucket answers the chunks
in the order of their entries. So a shuffled row is a message, an entry costs a few bytes, and whatever a
chunk holds many times is sent once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame

from tessera.llm.inputs import documents, text_bytes

CHUNK_BYTES = 6_000_000
FLUSH_BYTES = 32_000_000
#: Stands for a null doc_id inside blobs.
NO_ID = np.iinfo(np.int64).max

_SPACES = np.zeros(256, bool)
_SPACES[[32, *range(9, 14)]] = True
_RANDOM = np.random.default_rng(20240229)
#: A random 64-bit value for each byte, and the same with A to Z as a to z.
BYTE_CODE = _RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER_CODE = BYTE_CODE.copy()
LOWER_CODE[65:91] = BYTE_CODE[97:123]
_BASE, _STEP = 0x9E3779B97F4A7C15, 1 << 20
_powers: list = []


def chunk_count(docs: DataFrame) -> int:
    return max(1, -(-text_bytes(docs) // CHUNK_BYTES))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of the hash, so they keep its order."""
    return (((h >> np.uint64(40)) * np.uint64(buckets)) >> np.uint64(24)).astype(np.int64)


def zip_arrays(*arrays: np.ndarray | bytes) -> bytes:
    parts = [a if isinstance(a, bytes) else np.ascontiguousarray(a).tobytes() for a in arrays]
    head = np.array([len(parts), *map(len, parts)], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(parts))


def unzip_arrays(blob: bytes) -> list[memoryview]:
    raw = memoryview(zstandard.ZstdDecompressor().decompress(blob))
    n = int(np.frombuffer(raw[:8], np.int64)[0])
    at = 8 * (n + 1)
    out = []
    for size in np.frombuffer(raw[8:at], np.int64):
        out.append(raw[at : at + int(size)])
        at += int(size)
    return out


def chunked(docs: DataFrame, chunks: int) -> DataFrame:
    """chunk, blob: the documents' ids and UTF-8 texts, compressed, a few blobs a task and chunk."""

    def pack(ids: list, texts: list[bytes]) -> pd.DataFrame:
        key = np.array(ids, np.int64)
        chunk = (mix(key.view(np.uint64)) % np.uint64(chunks)).astype(np.int64)
        rows = []
        for c in np.unique(chunk):
            own = np.flatnonzero(chunk == c)
            mine = [texts[i] for i in own]
            rows.append((c, zip_arrays(key[own], np.array([len(t) for t in mine], np.int64), b"".join(mine))))
        return pd.DataFrame(rows, columns=["chunk", "blob"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, texts, size = [], [], 0
        for batch in batches:
            for i, t in zip(batch["doc_id"], batch["text"], strict=True):
                ids.append(NO_ID if pd.isna(i) else int(i))
                texts.append(t.encode())
                size += len(texts[-1])
                if size >= FLUSH_BYTES:
                    yield pack(ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield pack(ids, texts)

    return documents(docs).mapInPandas(run, "chunk int, blob binary")


def unpack(blobs: pd.Series) -> tuple[np.ndarray, list[bytes]]:
    """Ids and texts of a chunk, by doc_id and text, whatever the order of the blobs."""
    found = []
    for blob in blobs:
        ids, sizes, joined = unzip_arrays(blob)
        joined, at = bytes(joined), 0
        for i, n in zip(np.frombuffer(ids, np.int64).tolist(), np.frombuffer(sizes, np.int64).tolist(), strict=True):
            found.append((i, joined[at : at + n]))
            at += n
    found.sort()
    return np.array([i for i, _ in found], np.int64), [t for _, t in found]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, _STEP) + 1
        inverse = pow(_BASE, -1, 1 << 64)
        _powers[:] = [np.cumprod(np.r_[np.uint64(1), np.full(size, b, np.uint64)]) for b in (_BASE, inverse)]
    return _powers[0], _powers[1]


def word_hashes(text: bytes, code: np.ndarray = BYTE_CODE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of the words of a text, in the order of the text."""
    b = np.frombuffer(text, np.uint8)
    inside = ~_SPACES[b]
    edge = np.flatnonzero(np.diff(np.r_[False, inside, False].astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.empty(0, np.uint64), start, end
    power, inverse = _power_tables(len(b) + 1)
    total = np.r_[np.uint64(0), np.cumsum(code[b] * power[: len(b)])]
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64)), start, end
