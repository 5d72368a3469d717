"""Byte-level BPE as a lazily determinised finite-state transducer, and streaming decoding.

Two adjacent tokens *agree* when merging their joined bytes gives the same two tokens. A
sequence is the BPE of its bytes exactly when all neighbours agree, so each prefix of a
piece has one last token. The transducer reads bytes. A state holds the tokens that are
under way: their place in a trie of the vocabulary, the token before them, and the output
since the last common one. What all of them share is emitted at once, so a token leaves
after a lookahead of at most the longest token. States and transitions are made when they
are first met, and dropped together when there are too many.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterable, Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F

from cohortlens.llm.common import fields, frame_of, raw, with_result

ROOT = 0
ITEMS, FINAL = -1, -2
MAX_STATES = 400_000
MAX_MEMO = 400_000


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of the token's bytes, a space, and its id, on each line."""
    with open(path, "rb") as lines:
        pairs = (line.split() for line in lines if line.strip())
        return {base64.b64decode(token): int(rank) for token, rank in pairs}


def merge_parts(piece: bytes, ranks: dict[bytes, int], below: int | None = None) -> list[bytes]:
    """Plain BPE: the lowest-ranked neighbours first, the leftmost of equals; ``below`` bars later merges."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best = min(((r, i) for i, r in enumerate(ranks.get(a + b) for a, b in zip(parts, parts[1:])) if r is not None),
                   default=None)
        if best is None or (below is not None and best[0] >= below):
            break
        at = best[1]
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Transducer:
    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES):
        self.ranks, self.max_states = ranks, max_states
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.child: dict[int, int] = {}
        self.token: list[int | None] = [None]
        self.inner: set[int] = set()
        for text, rank in ranks.items():
            node = ROOT
            for byte in text:
                key = node << 8 | byte
                after = self.child.get(key)
                if after is None:
                    after = self.child[key] = len(self.token)
                    self.token.append(None)
                    self.inner.add(node)
                node = after
            self.token[node] = rank
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.agreed: dict[int, bool] = {}
        self.reset()

    def reset(self) -> None:
        """Forget the states made so far."""
        self.states: dict[tuple, dict] = {}
        self.start = self._state(((ROOT, -1, ()),))

    def _state(self, items: tuple) -> dict:
        """A state is a dict from a byte to (next state, output); ``ITEMS`` and ``FINAL`` are its own entries."""
        row = self.states.get(items)
        if row is None:
            row = self.states[items] = {ITEMS: items, FINAL: items[-1][2]}
        return row

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge made this one; none for a byte."""
        if token not in self.halves:
            text = self.bytes_of[token]
            parts = merge_parts(text, self.ranks, below=token) if len(text) > 1 else []
            self.halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self.halves[token]

    def agree(self, left: int, right: int) -> bool:
        """Whether the two tokens stay apart. Undoes the merges next to the border, the latest first,
        and asks each time whether the border itself would have merged before them."""
        key = left << 32 | right
        known = self.agreed.get(key)
        if known is None:
            if len(self.agreed) > 4 * MAX_MEMO:
                self.agreed.clear()
            known = self.agreed[key] = self._agree(left, right)
        return known

    def _agree(self, left: int, right: int) -> bool:
        # (rank, side): at equal rank the merge further left comes first, so a merge inside
        # the left token beats the border and the border beats one inside the right token.
        limit = (len(self.ranks) + self.max_rank, 0)
        while True:
            border = self.ranks.get(self.bytes_of[left] + self.bytes_of[right])
            if border is not None and (border, 1) < limit:
                return False
            into_left, into_right = self.split(left), self.split(right)
            if into_left is None and into_right is None:
                return True
            if into_right is None or (into_left is not None and left > right):
                limit, left = (left, 0), into_left[1]
            else:
                limit, right = (right, 2), into_right[0]

    @functools.cached_property
    def max_rank(self) -> int:
        return max(self.ranks.values(), default=0) + 1

    def _step(self, state: dict, byte: int) -> tuple[dict, tuple[int, ...]]:
        """Make the transition, emitting the output that all tokens under way share."""
        items, ended = [], None
        for node, before, pending in state[ITEMS]:
            node = self.child.get(node << 8 | byte)
            if node is None:
                continue
            token = self.token[node]
            if ended is None and token is not None and (before < 0 or self.agree(before, token)):
                ended = (ROOT, token, pending + (token,))
            if node in self.inner:
                items.append((node, before, pending))
        if ended is None:
            raise ValueError(f"the vocabulary has no token for byte {byte}")
        items.append(ended)
        shared = 0
        shortest = min(len(p) for _, _, p in items)
        while shared < shortest and all(p[shared] == ended[2][shared] for _, _, p in items):
            shared += 1
        out = ended[2][:shared]
        move = state[byte] = self._state(tuple((n, b, p[shared:]) for n, b, p in items)), out
        return move

    def encode_piece(self, piece: bytes) -> list[int]:
        if len(self.states) > self.max_states:
            self.reset()
        state, out = self.start, []
        for byte in piece:
            try:
                state, emitted = state[byte]
            except KeyError:
                state, emitted = self._step(state, byte)
            if emitted:
                out += emitted
        out += state[FINAL]
        return out


def _well_formed(lead: int) -> tuple[int, int, int]:
    """For a lead byte: bytes that follow, and the range of the next one."""
    if 0xC2 <= lead <= 0xDF:
        return 1, 0x80, 0xBF
    if 0xE0 <= lead <= 0xEF:
        return 2, 0xA0 if lead == 0xE0 else 0x80, 0x9F if lead == 0xED else 0xBF
    if 0xF0 <= lead <= 0xF4:
        return 3, 0x90 if lead == 0xF0 else 0x80, 0x8F if lead == 0xF4 else 0xBF
    return 0, 0, 0


class Utf8Machine:
    """Bytes to text as they come. The state is the unfinished character; each broken run gives U+FFFD."""

    def __init__(self) -> None:
        self.left, self.low, self.high, self.code, self.held = 0, 0x80, 0xBF, 0, b""

    def feed(self, data: bytes) -> str:
        out = []
        for byte in data:
            if self.left:
                if self.low <= byte <= self.high:
                    self.code = self.code << 6 | byte & 0x3F
                    self.left, self.low, self.high, self.held = self.left - 1, 0x80, 0xBF, self.held + bytes([byte])
                    if not self.left:
                        out.append(chr(self.code))
                        self.held = b""
                    continue
                out.append("�")
                self.left, self.held = 0, b""
            if byte < 0x80:
                out.append(chr(byte))
                continue
            self.left, self.low, self.high = _well_formed(byte)
            if self.left:
                self.code, self.held = byte & 0x3F >> self.left, bytes([byte])
            else:
                out.append("�")
        return "".join(out)

    def close(self) -> str:
        broken, self.left, self.held = self.held, 0, b""
        return "�" if broken else ""


class Codec:
    """Encodes texts by a pattern and ranks, and decodes ids."""

    #: White space of the pattern: Unicode's White_Space.
    SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.machine = Transducer(ranks)
        self.pattern = regex.compile(pattern)
        # No match of the pattern crosses these borders, so a run is looked up whole.
        self.runs = re.compile(f" ?[^{self.SPACE}]+|[{self.SPACE}]+(?![^{self.SPACE}])|[{self.SPACE}]")
        self.letters_whole = all(self.pattern.findall(w) == [w] for w in ("aZ", " aZ", "éª", " éª"))
        self.memo: dict[str, tuple[int, ...]] = {}
        self.names = {i: str(i) for i in self.machine.bytes_of}
        self.moves: dict[bytes, dict[int, tuple[str, bytes]]] = {}

    def _run(self, run: str) -> tuple[int, ...]:
        out: list[int] = []
        # Letters of the Latin blocks are one match; their classes do not change between Unicode versions.
        plain = self.letters_whole and run.lstrip(" ").isalpha() and max(run) < "\u0250"
        for piece in (run,) if plain else self.pattern.findall(run):
            out += self.machine.encode_piece(piece.encode("utf-8", "surrogatepass"))
        if len(run) <= 64:
            if len(self.memo) >= MAX_MEMO:
                self.memo.clear()
            self.memo[run] = tuple(out)
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        known = self.memo.get
        for run in self.runs.findall(text):
            ids += known(run) or self._run(run)
        return ids

    def decode_stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Text as ids arrive; a character is given out when its last byte is known."""
        held = b""
        moves = self.moves.setdefault(held, {})
        for token in ids:
            move = moves.get(token)
            if move is None:
                machine = Utf8Machine()
                machine.feed(held)
                move = moves[token] = (machine.feed(self.machine.bytes_of[token]), machine.held)
            text, after = move
            if after != held:
                held = after
                moves = self.moves.setdefault(held, {})
            if text:
                yield text
        if held:
            yield "�"

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(self.decode_stream(ids))


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One codec per process and vocabulary; its tables are bounded."""
    return Codec(load_ranks(path), pattern)


DIGEST = ["n_tokens", "ids_sha256", "decoded_sha256"]


def round_trip(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every whole text, decode the ids again, and give digests of both.

    One row per input row, in one pass without a shuffle. A null text counts as empty: no
    tokens, and the digests of nothing. Repeated rows are kept. Other columns are not read.
    """

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(texts: pd.Series) -> pd.DataFrame:
        own = codec(path, pattern)
        rows = []
        for value in texts:
            ids = own.encode(value or "")
            written = " ".join(map(own.names.__getitem__, ids)).encode()
            rows.append((len(ids), hashlib.sha256(written).hexdigest(), hashlib.sha256(raw(own.decode(ids))).hexdigest()))
        return frame_of(rows, DIGEST)

    return fields(with_result(docs.select(key, text), digest, "digest", text), [key], DIGEST)


def encode_texts(docs: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with an array of token ids; a null text gives an empty array."""

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        own = codec(path, pattern)
        return pd.Series([own.encode(value or "") for value in texts], dtype=object)

    return docs.withColumn(out, ids(F.col(text)))


def decode_ids(tokens: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``tokens`` with the text of its ids; null ids give an empty text, broken bytes U+FFFD."""

    @F.pandas_udf("string")
    def text(arrays: pd.Series) -> pd.Series:
        own = codec(path, pattern)
        return pd.Series([own.decode([] if a is None else list(map(int, a))) for a in arrays], dtype=object)

    return tokens.withColumn(out, text(F.col(ids)))
