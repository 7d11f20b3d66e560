"""Token counts by a linear longest-match automaton.

The vocabulary is a trie over bytes. Greedy longest match normally backs up to the end of the last
matched piece; here every trie node has a failure link to the node that stands for what is left after
its longest-match pieces are popped, and the number of pieces popped on the way is precomputed. A text
is then counted in one pass, each byte read once, and no piece is ever built. Failure links are
composed with the trie's edges into one dense (state, byte) table, so that a step is one lookup.

Words are maximal runs of non-space bytes; a word is matched as a space followed by its bytes, or bare
where the text starts with it, as the byte-level vocabulary has it. Every single byte is a piece, so
every word can be matched.

Defined cases: a null or blank text has no tokens; null and repeated ids are rows of their own; extra
columns are ignored; an empty table gives no rows; texts of any length are read whole.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def read_ranks(path: str) -> list[bytes]:
    """The pieces of a ``base64 rank`` vocabulary file."""
    with open(path, "rb") as lines:
        return [base64.b64decode(line.split()[0]) for line in lines if line.strip()]


class Automaton:
    """Greedy longest-match counting over a byte vocabulary that holds every single byte."""

    def __init__(self, vocabulary: Iterable[bytes]) -> None:
        edges: list[dict[int, int]] = [{}]
        piece = [False]
        for word in vocabulary:
            node = 0
            for b in word:
                if b not in edges[node]:
                    edges[node][b] = len(edges)
                    edges.append({})
                    piece.append(False)
                node = edges[node][b]
            piece[node] = node != 0
        missing = [b for b in range(256) if b not in edges[0] or not piece[edges[0][b]]]
        if missing:
            raise ValueError(f"bytes without a piece of their own: {missing[:8]}")
        size = len(edges)
        self.step = np.zeros((size, 256), np.int32)  # next state
        self.pops = np.zeros((size, 256), np.int16)  # pieces popped on the way
        fail = np.zeros(size, np.int32)
        lost = np.zeros(size, np.int32)  # pieces popped when the failure link is taken
        todo: deque[tuple[int, int, int]] = deque((0, b, n) for b, n in edges[0].items())
        for b, n in edges[0].items():
            self.step[0, b] = n
        while todo:
            parent, b, node = todo.popleft()
            if piece[node]:
                fail[node], lost[node] = 0, 1
            else:  # the parent's remainder, moved on by this byte
                rest = fail[parent]
                fail[node], lost[node] = self.step[rest, b], lost[parent] + self.pops[rest, b]
            # Bytes without an edge go where the failure state goes; it is shallower, so it is complete.
            self.step[node] = self.step[fail[node]]
            self.pops[node] = self.pops[fail[node]] + lost[node]
            for c, child in edges[node].items():
                self.step[node, c], self.pops[node, c] = child, 0
                todo.append((node, c, child))
        self.end = np.zeros(size, np.int32)  # pieces popped at the end of a word
        for state in range(size):
            at, n = state, 0
            while at:
                n, at = n + lost[at], fail[at]
            self.end[state] = n

    def count(self, word: bytes) -> int:
        state = n = 0
        for b in word:
            n += int(self.pops[state, b])
            state = int(self.step[state, b])
        return n + int(self.end[state])

    def count_many(self, words: list[bytes]) -> np.ndarray:
        """Counts of many words, all moved on together byte by byte, longest first."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-lengths, kind="stable")
        flat = np.frombuffer(b"".join(words), np.uint8)
        starts = (np.cumsum(lengths) - lengths)[order]
        lengths = lengths[order]
        state, n = np.zeros(len(words), np.int32), np.zeros(len(words), np.int64)
        alive, at = int((lengths > 0).sum()), 0
        while alive:
            b = flat[starts[:alive] + at]
            here = state[:alive]
            n[:alive] += self.pops[here, b]
            state[:alive] = self.step[here, b]
            at += 1
            alive = int(np.searchsorted(-lengths, -at, side="left"))
        out = np.empty(len(words), np.int64)
        out[order] = n + self.end[state]
        return out


@lru_cache(maxsize=2)
def automaton(path: str) -> Automaton:
    return Automaton(read_ranks(path))


#: Distinct words whose counts a task remembers before it starts afresh.
REMEMBERED = 1_000_000


def _counter(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto, known = automaton(path), {}
        for batch in batches:
            n_words, n_tokens = [], []
            for text in batch.column("text").to_pylist():
                raw = (text or "").encode("utf-8", "surrogatepass")
                words = raw.split()
                keys = [b" " + w for w in words]
                if words and raw[:1] == words[0][:1]:
                    keys[0] = words[0]
                new = [w for w in dict.fromkeys(keys) if w not in known]
                if len(known) + len(new) > REMEMBERED:
                    known, new = {}, list(dict.fromkeys(keys))
                known.update(zip(new, auto.count_many(new).tolist(), strict=True) if new else ())
                n_words.append(len(words))
                n_tokens.append(sum(map(known.__getitem__, keys)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())],
                names=["doc_id", "n_words", "n_tokens"],
            )

    return count


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_tokens``. ``vocabulary``: path of a rank file that
    every executor can open."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_counter(vocabulary), f"doc_id {kind}, n_words bigint, n_tokens bigint")
