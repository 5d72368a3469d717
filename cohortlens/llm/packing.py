"""Packing of documents into sequences by Karmarkar-Karp multiway differencing.

Documents are cut at fixed places: whole windows first, the rest into pieces small enough to
balance. Whole windows are sequences of their own. The other pieces are dealt into groups of
about ``GROUP_PIECES``, and each group is differenced into near-equal windows: partial
partitions start with one piece, and the two with the widest spread are merged, the largest
window of one with the smallest of the other. When a window would exceed the capacity the
number of windows rises by one and the group is differenced again.
"""

from __future__ import annotations

import functools
import heapq
import os
import re
import struct
import zlib
from bisect import insort
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortlens.llm.common import arrow_rows, raw
from cohortlens.session import materialize

CAPACITY = 4096
#: Pieces of at most this many tokens are balanced; smaller ones balance better and cut more often.
PIECE = 512
#: Pieces in a group, on average. Rounding up wastes half a window a group.
GROUP_PIECES = 2048
MAX_MEMO = 600_000
MAX_MARKS = 10_000
PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                    ("doc_tokens", pa.int64())])
PACKED = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


#: Latin letters that normalising leaves alone but for their case, then plain punctuation: two matches of the split.
SIMPLE = re.compile("([a-zß-öø-ÿA-ZÀ-ÖØ-Þ]+)([!#$%&*,.:;?]*)")


def byte_alphabet() -> dict[int, str]:
    """Byte-level vocabularies write printable bytes as themselves and the others from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Memo(dict):
    """Packed ids by word; a missing one is encoded when it is first looked up."""

    def __init__(self, encode: Callable[[bytes], bytes]):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: bytes) -> bytes:
        found = self[word] = self.encode(word)
        return found


class WordTokenizer:
    """Ids of a vocabulary that drops white space, so that each word can be looked up.

    Simple words go straight to the merges, their letters and what follows looked up apart; all others go through the
    whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.memo, self.marks = Memo(self.word_ids), {"": b""}
        self.alphabet = byte_alphabet()

    def merged(self, part: str) -> bytes:
        """Packed ids of letters, or of marks, by the merges alone."""
        if not part.isascii():
            part = part.lower().encode().decode("latin-1").translate(self.alphabet)
        return packed([t.id for t in self.tokenizer.model.tokenize(part)])

    def word_ids(self, word: bytes) -> bytes:
        """Packed ids of a word whose letters A-Z are lower-cased."""
        text = word.decode("utf-8", "replace")
        found = SIMPLE.fullmatch(text)
        if not found:
            return packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        letters, marks = found.groups()
        if not marks:
            return self.merged(letters)
        if marks not in self.marks:
            if len(self.marks) > MAX_MARKS:
                self.marks = {"": b""}
            self.marks[marks] = self.merged(marks)
        return self.memo[letters.encode()] + self.marks[marks]

    def packed_ids(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian 32-bit numbers."""
        if len(self.memo) > MAX_MEMO:
            self.memo.clear()
        return b"".join(map(self.memo.__getitem__, raw(text).lower().split()))


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def cuts(tokens: int, capacity: int, piece: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces: whole windows, then smaller pieces of the rest."""
    at = 0
    while tokens - at >= capacity:
        yield at, capacity
        at += capacity
    while at < tokens:
        size = min(piece, tokens - at)
        yield at, size
        at += size


def pieces_of(docs: DataFrame, path: str, end_id: int, key: str, text: str, capacity: int, piece: int) -> DataFrame:
    """Where each document is cut, with a checksum of each piece's ids."""

    def build(columns: dict) -> dict:
        own = tokenizer(path)
        end = np.array([end_id], "<u4").tobytes()
        rows: list[list[int]] = [[], [], [], [], []]
        for doc, value in zip(columns["k"].to_pylist(), columns["t"]):
            ids = own.packed_ids(value.as_py()) + end
            total = len(ids) // 4
            for start, length in cuts(total, capacity, piece):
                crc = zlib.crc32(ids[4 * start : 4 * (start + length)])
                for column, cell in zip(rows, (doc, start, length, crc, total)):
                    column.append(cell)
        return dict(zip(PIECES.names, rows))

    return docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).mapInArrow(
        arrow_rows(build, PIECES), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def difference(lengths: list[int], windows: int) -> list[list[int]]:
    """Indices of ``lengths`` in each of at most ``windows`` near-equal windows.

    A partial partition lists (-sum, node) by falling sum and leaves out empty windows. A node
    is an index or a pair of nodes, so that joining two windows copies nothing.
    """
    heap: list[tuple] = []
    tie = 0
    for at, size in enumerate(lengths):
        heap.append((-size, tie, [(-size, at)]))
        tie += 1
    heapq.heapify(heap)
    while len(heap) > 1:
        one, two = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        if len(one) < len(two):
            one, two = two, one
        # The largest of the shorter meet the smallest of the longer, empty windows first.
        free = windows - len(one)
        joined = []
        while free + len(joined) < len(two):
            small, large = one.pop(), two[len(joined)]
            joined.append((small[0] + large[0], (small[1], large[1])))
        rest = two[len(joined):]
        for window in joined + rest:
            insort(one, window, key=lambda w: w[0])
        spread = -one[0][0] + (one[-1][0] if len(one) == windows else 0)
        heapq.heappush(heap, (-spread, tie, one))
        tie += 1
    out = []
    for _, node in heap[0][2] if heap else []:
        members, todo = [], [node]
        while todo:
            top = todo.pop()
            if isinstance(top, tuple):
                todo += top
            else:
                members.append(top)
        out.append(members)
    return out


def near_equal(lengths: list[int], capacity: int) -> list[list[int]]:
    """Windows within the capacity, their number raised as often as needed."""
    windows = max(1, -(-sum(lengths) // capacity))
    while True:
        found = difference(lengths, windows)
        if all(sum(lengths[i] for i in members) <= capacity for members in found):
            return found
        windows += 1


def pack(docs: DataFrame, path: str, end_id: int = 2, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
         piece: int = PIECE, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Put every id of every document, and its end id, into exactly one sequence.

    One row per piece. A null or empty text still has its end id. Rows that repeat an id are
    packed each. Equal inputs may be dealt into other sequences when partitions differ, never
    lost. The pieces (a few numbers each) are written once, so text is read and tokenised once;
    only pieces shuffle, evenly, whatever their document.
    """
    cut = materialize(pieces_of(docs, path, end_id, key, text, capacity, piece), "pieces").withColumn(
        "mark", F.monotonically_increasing_id())
    whole = cut.filter(F.col("length") == capacity).select(
        *PIECES.names, (F.col("mark") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = cut.filter(F.col("length") < capacity)
    groups = max(1, -(-rest.count() // group_pieces))

    def windows(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("mark").reset_index(drop=True)
        first = int(frame["group"].iloc[0]) << 32
        lengths = frame["length"].tolist()
        sequence, offset = np.zeros(len(frame), np.int64), np.zeros(len(frame), np.int64)
        for at, members in enumerate(near_equal(lengths, capacity)):
            members.sort()
            sequence[members] = 2 * (first + at)
            sizes = frame["length"].to_numpy()[members]
            offset[members] = np.cumsum(sizes) - sizes
        return frame[PIECES.names].assign(sequence_id=sequence, offset=offset)

    dealt = rest.withColumn("group", F.pmod(F.xxhash64("mark"), F.lit(groups)))
    balanced = dealt.groupBy("group").applyInPandas(windows, ", ".join(f"{c} long" for c in PACKED))
    return whole.select(*PACKED).unionByName(balanced)
