"""Encoding into the pieces of a published model, and decoding back.

An Aho-Corasick automaton over the pieces reads the text once. At each position
its output links give every piece that ends there, and each relaxes what the
position holds. In a unigram model scores are log probabilities: the best sum wins.
In a model made by merging pairs scores are only the order of merges, and the best
sum of them isn't the model's segmentation. There the relaxation asks instead
whether a piece can follow the one that the path ends in: exactly one can, as a
sequence is the model's own if every two neighbours, merged by themselves, stay as
they are. Both take one pass.

White space is written as U+2581 first, as the model does. If no piece has that
mark behind another character, no piece crosses from a word into the next space, so
the path of a text is the paths of its words one after the other; each worker then
keeps the path of a distinct word.
"""

from __future__ import annotations

import re
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6
#: As much worse than the worst piece as the published encoder takes a character without a piece to be.
UNKNOWN_PENALTY = 10.0


def _fields(buf: bytes):
    """Protocol-buffer fields of ``buf``: number and value."""

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = buf[i]
            value |= (byte & 127) << shift
            i, shift = i + 1, shift + 7
            if byte < 128:
                return value, i

    i = 0
    while i < len(buf):
        key, i = varint(i)
        if key & 7 == 0:
            value, i = varint(i)
        elif key & 7 == 2:
            size, i = varint(i)
            value, i = buf[i : i + size], i + size
        else:
            size = 4 if key & 7 == 5 else 8
            value, i = buf[i : i + size], i + size
        yield key >> 3, value


def read_model(raw: bytes) -> list[tuple[str, float, int]]:
    """(piece, score, kind) by id, from the bytes of a model file."""
    pieces = []
    for number, value in _fields(raw):
        if number == 1:
            piece = dict(_fields(value))
            score = float(np.frombuffer(piece.get(2, b"\0\0\0\0"), "<f4")[0])
            pieces.append((piece.get(1, b"").decode("utf-8"), score, piece.get(3, _NORMAL)))
    return pieces


def is_merging(raw: bytes) -> bool:
    """Whether the model's trainer settings say that it was made by merging pairs (byte-pair encoding)."""
    return any(number == 2 and dict(_fields(value)).get(3, 1) == 2 for number, value in _fields(raw))


class PieceCodec:
    """The model's segmentation into ids, and its inverse; ``merging`` models by merges, others by best score."""

    def __init__(self, pieces: list[tuple[str, float, int]], merging: bool = False) -> None:
        self.automaton = ahocorasick.Automaton()
        usable = {p: (len(p), score, i) for i, (p, score, kind) in enumerate(pieces) if kind in (_NORMAL, _USER) and p}
        for piece, entry in usable.items():
            self.automaton.add_word(piece, entry)
        self.automaton.make_automaton()
        self.empty = not usable
        self.byte_id = {int(p[1:-1], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == _BYTE}
        self.unknown = next((i for i, (_, _, kind) in enumerate(pieces) if kind == _UNKNOWN), 0)
        self.unknown_score = min((e[1] for e in usable.values()), default=0.0) - UNKNOWN_PENALTY
        self.by_word = not any(SPACE in p.lstrip(SPACE) for p in usable)
        self.bytes_of = [
            bytes([int(p[1:-1], 16)]) if kind == _BYTE else b"" if kind == _CONTROL else p.encode("utf-8")
            for p, _, kind in pieces
        ]
        self.width = np.dtype("<u2") if len(pieces) <= 65536 else np.dtype("<u4")
        segment, code = self.merged if merging else self.segment, self.width.char
        self.words = Memo(lambda w: array(code, segment(w)).tobytes(), 500_000)
        self.scores = {p: e[1] for p, e in usable.items()}
        #: Pieces by id, then the characters met that are none; the last of the pieces' places stands for a text's begin.
        self.names = [*(p for p, _, _ in pieces), ""]
        self.strange: dict[str, int] = {}
        self.begin = len(pieces)
        self.growth = Memo(self._growth, 300_000)
        self.may_follow = Memo(self._may_follow, 1_000_000)

    def segment(self, text: str) -> list[int]:
        """Ids of the best path; of equal scores the one whose last piece is longest wins.

        A character that no piece covers falls back to its UTF-8 bytes, or to the
        unknown id where the model has no byte pieces.
        """
        n = len(text)
        best, back = [-1e300] * (n + 1), [(1, -1)] * (n + 1)
        best[0] = 0.0
        reach = 0  # positions up to here are final
        matches = () if self.empty else self.automaton.iter(text)
        for end, entry in matches:
            while reach < end:
                reach += 1
                if best[reach] < (score := best[reach - 1] + self.unknown_score):
                    best[reach], back[reach] = score, (1, -1)
            length, score, _ = entry
            score += best[end + 1 - length]
            if score > best[end + 1]:
                best[end + 1], back[end + 1] = score, entry
        while reach < n:
            reach += 1
            if best[reach] < (score := best[reach - 1] + self.unknown_score):
                best[reach], back[reach] = score, (1, -1)
        ids: list[int] = []
        at = n
        while at:
            length, piece = back[at][0], back[at][-1]
            if piece >= 0:
                ids.append(piece)
            elif self.byte_id:
                ids.extend(self.byte_id[b] for b in reversed(text[at - 1].encode("utf-8", "surrogatepass")))
            else:
                ids.append(self.unknown)
            at -= length
        return ids[::-1]

    def _growth(self, piece: str):
        """What stands at either end of a piece while it is merged: (part, score at which it is merged on), last to stay.

        None if merging the piece's characters ends in anything else.
        """
        parts, scores = list(piece), self.scores
        at_left, at_right = [], []
        while len(parts) > 1:
            best, at = -float("inf"), -1
            for i in range(len(parts) - 1):
                if (score := scores.get(parts[i] + parts[i + 1])) is not None and score > best:
                    best, at = score, i
            if at < 0:
                return None
            if at == 0:
                at_left.append((parts[0], best))
            if at == len(parts) - 2:
                at_right.append((parts[-1], best))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        stays = (piece, -float("inf"))
        return [*at_left, stays], [*at_right, stays]

    def _may_follow(self, pair: int) -> bool:
        """Whether two pieces (ids in the upper and lower half) stay as they are when merged side by side.

        At a text's begin the second must stay by itself.

        They do if at no time the parts that meet are merged before one of them is
        merged inside its piece; of equal scores the pair further left comes first.
        """
        before, after = self.names[pair >> 32], self.names[pair & 0xFFFFFFFF]
        second = self.growth[after]
        if second is None or not before:
            return second is not None
        first = self.growth[before]
        if first is None:
            return False
        i = j = 0
        while True:
            (x, leaves_x), (y, leaves_y) = first[1][i], second[0][j]
            score = self.scores.get(x + y)
            if score is not None and score > leaves_x and score >= leaves_y:
                return False
            if leaves_x == leaves_y == -float("inf"):
                return True
            if leaves_x >= leaves_y:
                i += 1
            else:
                j += 1

    def merged(self, text: str) -> list[int]:
        """Ids of the segmentation that merging gives, in one pass.

        The last piece of each prefix is the one that may follow the last piece of
        the prefix before it. A character without a piece stands for itself, then
        falls back to its UTF-8 bytes, or to the unknown id.
        """
        n = len(text)
        last = [self.begin] + [-1] * n
        may_follow = self.may_follow
        for end, (length, _, piece) in () if self.empty else self.automaton.iter(text):
            if last[end + 1] < 0:
                before = last[end + 1 - length]
                if before < 0:  # all matches that end there have been seen
                    before = last[end + 1 - length] = self._stranger(text[end - length])
                if may_follow[before << 32 | piece]:
                    last[end + 1] = piece
        ids: list[int] = []
        while n:
            piece = last[n]
            if 0 <= piece < self.begin:
                ids.append(piece)
                n -= len(self.names[piece])
                continue
            n -= 1
            if self.byte_id:
                ids.extend(self.byte_id[b] for b in reversed(text[n].encode("utf-8", "surrogatepass")))
            else:
                ids.append(self.unknown)
        return ids[::-1]

    def _stranger(self, character: str) -> int:
        """A number for a character that no piece is."""
        if character not in self.strange:
            self.strange[character] = len(self.names)
            self.names.append(character)
        return self.strange[character]

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, self.width)
        marked = SPACE + text.replace(" ", SPACE)
        parts = _WORDS.findall(marked) if self.by_word else [marked]
        return np.frombuffer(b"".join(map(self.words.__getitem__, parts)), self.width)

    def decode(self, ids) -> str:
        joined = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace").replace(SPACE, " ")
        return joined[1:] if joined[:1] == " " else joined


#: A run of space marks with the run of other characters behind it.
_WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_CODECS: dict[int, PieceCodec] = {}


def codec_of(raw: bytes) -> PieceCodec:
    key = hash(raw)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = PieceCodec(read_model(raw), is_merging(raw))
    return _CODECS[key]


def encode_pieces(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """``doc_id, ids, n_pieces, round_trip`` for every row, over its whole text.

    Ids are those of the model's own encoder: by best score for a unigram model, by
    merges for a merging one (see the module).

    ``round_trip`` says whether decoding the ids gives the text again; it fails
    only where the text itself holds U+2581, which stands for a space. Null text
    gives nulls, empty text no ids. Rows are taken one by one, so repeated rows
    and null ids stay; other columns are dropped. No shuffle; the model file is
    read on the driver and broadcast (0.5 MB whatever the data).
    """
    with open(model, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        codec = codec_of(shared.value)
        for batch in batches:
            texts, sizes, valid, parts, same = batch.column(1), [0], [], [], []
            out = []
            for scalar in texts:
                text = scalar.as_py()
                ids = codec.encode(text) if text is not None else _NONE
                parts.append(ids)
                sizes.append(len(ids))
                valid.append(text is not None)
                same.append(None if text is None else codec.decode(ids.tolist()) == text)
                if len(parts) >= 2000:
                    out.append(_arrays(parts, sizes, valid, same))
                    parts, sizes, valid, same = [], [0], [], []
            if parts:
                out.append(_arrays(parts, sizes, valid, same))
            at = 0
            for columns in out:
                n = len(columns[1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, n), *columns], names=["doc_id", "ids", "n_pieces", "round_trip"]
                )
                at += n

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id bigint, ids array<int>, n_pieces bigint, round_trip boolean")


_NONE = np.empty(0, np.uint16)


def _arrays(parts, sizes, valid, same) -> list[pa.Array]:
    values = pa.array(np.concatenate(parts).astype(np.int32))
    offsets = pa.array(np.cumsum(sizes), pa.int32(), mask=np.array([*(not v for v in valid), False]))
    lists = pa.ListArray.from_arrays(offsets, values)
    counts = pa.array([n if v else None for n, v in zip(sizes[1:], valid)], pa.int64())
    return [lists, counts, pa.array(same, pa.bool_())]


def decode_pieces(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; null ids give null text, no ids the empty one.

    Rows are taken one by one, so repeated rows and null doc_ids stay; other columns
    are dropped; an empty table gives an empty one.
    """
    with open(model, "rb") as f:
        shared = rows.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf("string")
    def text_of(ids):
        decode = codec_of(shared.value).decode
        return ids.map(lambda x: None if x is None else decode([int(i) for i in x]))

    return rows.select("doc_id", text_of(F.col("ids").cast("array<int>")).alias("text"))
