"""Removing spans of known words with suffix automata of reference shards.

The reference texts of a document are those of smaller doc_ids. Only pieces whose anchor occurs in two
documents can match (see windows.py), so a reference shard is the distinct pieces of a range of anchors, of
SHARD_WORDS words about, and its suffix automaton goes to the tasks that hold documents with those anchors
instead of to all tasks: broadcasting every shard to every document would read the corpus once a shard.
The pieces of documents are streamed through the automaton; where the matching statistic reaches 13 words,
the state of the last 13 words names the smallest doc_id that has them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from tessera.llm import windows
from tessera.llm.exchange import word_hashes

MIN_WORDS = 13
ANCHOR_WORDS = 5
SHARD_WORDS = 60_000


class Automaton:
    """A suffix automaton of several word sequences; low[v] is the smallest doc_id that has the state's words."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length, self.low = [-1], [0], [np.iinfo(np.int64).max]

    def _state(self, length: int, link: int, to: dict[bytes, int], low: int) -> int:
        self.next.append(to)
        self.link.append(link)
        self.length.append(length)
        self.low.append(low)
        return len(self.link) - 1

    def _clone(self, p: int, word: bytes, q: int) -> int:
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]), self.low[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def add(self, words: list[bytes], doc_id: int) -> None:
        last = 0
        for word in words:
            p, q = last, self.next[last].get(word)
            if q is not None:
                last = q if self.length[q] == self.length[p] + 1 else self._clone(p, word, q)
            else:
                last = self._state(self.length[p] + 1, 0, {}, doc_id)
                while p >= 0 and word not in self.next[p]:
                    self.next[p][word] = last
                    p = self.link[p]
                if p >= 0:
                    q = self.next[p][word]
                    self.link[last] = q if self.length[q] == self.length[p] + 1 else self._clone(p, word, q)
            self.low[last] = min(self.low[last], doc_id)

    def close(self) -> None:
        """Every state's doc_ids are its own and those of the states that end in its words."""
        for v in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            u = self.link[v]
            self.low[u] = min(self.low[u], self.low[v])

    def match(self, words: list[bytes], least: int) -> Iterator[tuple[int, int | None]]:
        """(matching statistic up to least, smallest doc_id of the last least words or None) after every word."""
        v = have = 0
        for word in words:
            while v and word not in self.next[v]:
                v = self.link[v]
                have = self.length[v]
            if word in self.next[v]:
                v = self.next[v][word]
                have = min(have + 1, least)
                while self.length[self.link[v]] >= have and self.link[v] > 0:
                    v = self.link[v]
            yield have, self.low[v] if have == least else None


def least_ids(pieces: list[bytes], n: list[int], doc_ids: list[int], anchors: list[int], least: int = MIN_WORDS) -> list[np.ndarray]:
    """For each piece, the smallest doc_id that has each of its windows of `least` words."""
    out, at = [], 0
    texts = [p.split(b" ") for p in pieces]
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (size < SHARD_WORDS or anchors[end] == anchors[end - 1]):
            size += len(texts[end])
            end += 1
        shard = Automaton()
        for words, doc_id in zip(texts[at:end], doc_ids[at:end], strict=True):
            shard.add(words, doc_id)
        shard.close()
        out += [np.array([low for have, low in shard.match(words, least) if have == least], np.int64) for words in texts[at:end]]
        at = end
    return out


def _block(texts: list[bytes]) -> tuple:
    words = [t.split() for t in texts]
    buffer = b" ".join(b" ".join(w) for w in words)
    symbols, start, end = word_hashes(buffer)
    return symbols, np.array([len(w) for w in words], np.int64), buffer, start, end


def _finish(doc_id: int | None, text: bytes, removed: np.ndarray | None) -> tuple:
    words = text.split()
    kept, gone = words, 0
    if removed is not None:
        gone = int(removed.sum())
        kept = [w for w, r in zip(words, removed.tolist(), strict=False) if not r] + words[len(removed) :]
    joined = b" ".join(kept)
    return doc_id, len(words), gone, joined.decode(), hashlib.sha256(joined).hexdigest()


SCHEME = windows.Scheme(MIN_WORDS, ANCHOR_WORDS, _block, least_ids, _finish, "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string")


def remove_known_spans(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept (kept words joined by one space), kept_sha256.

    Every word goes that is covered by 13 words in a row which also start in a document with a smaller
    doc_id. A null text has no words; texts under 13 words are kept; rows that repeat a doc_id do not remove
    each other's words; rows with a null doc_id are kept whole and remove nothing; an empty table gives no rows.
    """
    return windows.process(docs, SCHEME)
