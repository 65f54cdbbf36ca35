"""Token counts by a linear longest-match automaton.

A trie over the vocabulary is completed with failure links. Each node also holds
how many pieces are popped when its link is taken, so a word is read once, byte
by byte, and the number of greedy longest-match pieces comes out without building
a piece. Texts are first split by the vocabulary's own pattern; as a piece may not
cross such a split and words repeat, each worker counts a distinct word once.
"""

from __future__ import annotations

import base64
from collections import deque

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Splits a text into the words that the vocabulary was made for.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def read_vocabulary(raw: bytes) -> list[bytes]:
    """Pieces of a file that has base64 and rank on each line."""
    return [base64.b64decode(line.split()[0]) for line in raw.splitlines() if line.strip()]


class LongestMatch:
    """Greedy longest-match piece counts of a word in one pass over its bytes."""

    def __init__(self, pieces: list[bytes]) -> None:
        step: dict[int, int] = {}
        ends, kids = [False], [[]]
        for piece in pieces:
            at = 0
            for byte in piece:
                key = at << 8 | byte
                to = step.get(key)
                if to is None:
                    to = step[key] = len(ends)
                    ends.append(False)
                    kids.append([])
                    kids[at].append((byte, to))
                at = to
            ends[at] = bool(piece)
        fail, pops = [-1] * len(ends), [0] * len(ends)
        queue = deque([0])
        while queue:
            at = queue.popleft()
            for byte, to in kids[at]:
                queue.append(to)
                if ends[to]:
                    fail[to], pops[to] = 0, 1
                    continue
                back, popped = fail[at], pops[at]
                while back >= 0 and (back << 8 | byte) not in step:
                    popped, back = popped + pops[back], fail[back]
                if back >= 0:
                    fail[to], pops[to] = step[back << 8 | byte], popped
        self.step, self.fail, self.pops = step, fail, pops

    def count(self, word: bytes) -> int:
        """Pieces of ``word``; a word that no run of pieces spells counts as one unknown piece."""
        step, fail, pops = self.step.get, self.fail, self.pops
        at = n = 0
        for byte in word:
            to = step(at << 8 | byte)
            while to is None:
                n += pops[at]
                at = fail[at]
                if at < 0:
                    return 1
                to = step(at << 8 | byte)
            at = to
        while at > 0:
            n += pops[at]
            at = fail[at]
        return n if at == 0 else 1


_COUNTERS: dict[int, Memo] = {}


def counter_of(raw: bytes) -> Memo:
    """The worker's own memo of word -> pieces for a vocabulary file's bytes."""
    key = hash(raw)
    if key not in _COUNTERS:
        _COUNTERS.clear()
        count = LongestMatch(read_vocabulary(raw)).count
        _COUNTERS[key] = Memo(lambda word: count(word.encode("utf-8", "surrogatepass")), 500_000)
    return _COUNTERS[key]


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """``doc_id, n_tokens`` for every row of ``docs``, over its whole text.

    Null text gives null, empty text 0. Repeated rows, null ids included, are
    counted one by one; other columns are dropped. Empty tables give empty ones.
    A map without a shuffle; the vocabulary file is read on the driver and
    broadcast (under 1 MB whatever the data).
    """
    with open(vocabulary, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf("bigint")
    def pieces(texts: pd.Series) -> pd.Series:
        split, memo = regex.compile(pattern).findall, counter_of(shared.value)
        get = memo.__getitem__
        return pd.Series([None if t is None else sum(map(get, split(t))) for t in texts], dtype="Int64")

    return docs.select("doc_id", pieces(F.col("text").cast("string")).alias("n_tokens"))
