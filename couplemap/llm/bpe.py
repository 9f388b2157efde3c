"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every byte prefix of a piece there is exactly one token that can be the
last one of the prefix's encoding.  ``PrefixTable`` stores that token per
prefix: a longer token is tried first, and it is the right one if the pair
(last token of the shorter prefix, token) would survive the merges.  Reading
the table backwards gives the encoding.  Appending bytes adds entries and
changes none; after an edit the entries are made anew until they agree with
the old ones over the length of the longest token.

Texts are cut by the vocabulary's pattern and each piece is encoded on its
own, as the tiktoken library does, without special tokens.  Pieces recur, so
each task keeps a bounded cache of chunk encodings.

Definitions.  A null text is the empty text and has no ids.  Rows come back
one to one, repeated ids included.
"""

from __future__ import annotations

import string
import uuid

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BoundedCache, chunks, id_and_text, map_slices, read_ranks, resident, whole

CACHE = 120_000
MOVES = 400_000
_NEVER = 1 << 40


class Vocabulary:
    """Ranks, and which tokens may stand side by side."""

    def __init__(self, ranks: list[tuple[bytes, int]], pattern: str):
        self.ranks = dict(ranks)
        self.tokens = {rank: token for token, rank in ranks}
        self.longest = max(map(len, self.ranks))
        self.words = {rank: rank.to_bytes(4, "little") for rank in self.tokens}
        # states of a walk over a text: the longest ending of what was read that begins a token
        self._state_of = {b"": 0}
        self._texts = [b""]
        self.ends: list[tuple[tuple[int, int], ...]] = [()]
        self._begins = {token[:k] for token in self.ranks for k in range(1, len(token) + 1)}
        self.moves: dict[int, int] = {}
        self.find = regex.compile(pattern).findall
        # whether a space and letters of ASCII are one match; such chunks need no search
        letters = string.ascii_letters
        self._letters = all(self.find(" " + x) == [" " + x] for x in (letters, letters[::-1], *letters))
        self._parts: dict = {}
        self._left = BoundedCache(20_000)
        self._right = BoundedCache(20_000)
        self.pairs = BoundedCache(CACHE)
        self._chunks = BoundedCache(CACHE)
        self._pieces = BoundedCache(CACHE)

    def parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens that the token's last merge joins; None for a byte
        and for a token that merges never reach."""
        if token not in self._parts:
            text = self.tokens[token]
            cut = [text[i:i + 1] for i in range(len(text))]
            while len(cut) > 2:
                ranked = [(self.ranks.get(a + b, _NEVER), i) for i, (a, b) in enumerate(zip(cut, cut[1:]))]
                rank, i = min(ranked)
                if rank == _NEVER:
                    break
                cut[i:i + 2] = [cut[i] + cut[i + 1]]
            self._parts[token] = (self.ranks[cut[0]], self.ranks[cut[1]]) if len(cut) == 2 else None
        return self._parts[token]

    def reached(self, token: int) -> bool:
        return len(self.tokens[token]) == 1 or self.parts(token) is not None

    def move(self, state: int, byte: int) -> int:
        """The state after another byte.  States and moves are as many as
        the beginnings of tokens that the texts hold, with their next bytes;
        the moves are made anew when they are ``MOVES``."""
        text = self._texts[state] + bytes((byte,))
        while text not in self._begins and text:
            text = text[1:]
        after = self._state_of.get(text)
        if after is None:
            after = self._state_of[text] = len(self._texts)
            self._texts.append(text)
            # the tokens that end here, the longest first
            ends = [(len(text) - k, self.ranks.get(text[k:])) for k in range(len(text))]
            self.ends.append(tuple((n, token) for n, token in ends if token is not None))
        if len(self.moves) >= MOVES:
            self.moves.clear()
        self.moves[state << 8 | byte] = after
        return after

    def _edge(self, token: int, side: int, memo: BoundedCache) -> list[tuple[bytes, int, int]]:
        """The symbols that stand at one end of the token while it is built:
        (bytes, rank that makes it, rank that swallows it), last one first."""
        if token not in memo:
            edge, above = [], _NEVER
            while True:
                cut = self.parts(token)
                edge.append((self.tokens[token], token if cut else -1, above))
                if cut is None:
                    break
                above, token = token, cut[side]
            memo.room(1)
            memo[self.ranks[edge[0][0]]] = edge
            return edge
        return memo[token]

    def side_by_side(self, a: int, b: int) -> bool:
        """Whether merges leave the boundary between the two tokens alone."""
        key = a << 32 | b
        known = self.pairs.get(key)
        if known is None:
            known = self.pairs.old.get(key)
            if known is not None:
                self.pairs[key] = known
                return known
            known = True
            for x, x_made, x_gone in self._edge(a, 1, self._right):
                for y, y_made, y_gone in self._edge(b, 0, self._left):
                    if max(x_made, y_made) < min(x_gone, y_gone):
                        rank = self.ranks.get(x + y)
                        # of equal pairs the leftmost is merged first
                        if rank is not None and rank < x_gone and rank <= y_gone:
                            known = False
                            break
                if not known:
                    break
            self.pairs.room(1)
            self.pairs[key] = known
        return known

    def piece(self, text: bytes) -> list[int]:
        """Ids of one match of the pattern."""
        whole_piece = self.ranks.get(text)
        if whole_piece is not None:
            return [whole_piece]
        return PrefixTable(self, text).tokens()

    def _learn(self, pieces: list[str]) -> None:
        """Encode pieces in sorted order: each one goes on from the prefix
        that it shares with the one before."""
        table = PrefixTable(self)
        for text in sorted(x.encode() for x in pieces):
            token = self.ranks.get(text)
            if token is None:
                table.restart(text)
            self._pieces[text.decode()] = b"".join(map(self.words.__getitem__, table.tokens())) if token is None else self.words[token]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, as little-endian unsigned 32-bit integers."""
        cuts = [chunks(text) for text in texts]
        # the first chunk of a text has no space before it: it is cut into pieces like a text of its own
        loose = {text if cut is None else cut[0] for text, cut in zip(texts, cuts)}
        loose = {text: self.find(text) for text in loose}
        new = self._chunks.settle(set().union(*(cut[1:] for cut in cuts if cut)))
        find, letters = self.find, self._letters
        new_chunks = {chunk: [" " + chunk] if letters and chunk.isascii() and chunk.isalpha() else find(whole(chunk)) for chunk in new}
        self._learn(self._pieces.settle(set().union(*loose.values(), *new_chunks.values())))
        piece = self._pieces.__getitem__
        for chunk, pieces in new_chunks.items():
            self._chunks[chunk] = b"".join(map(piece, pieces))
        known = self._chunks.__getitem__
        return [
            b"".join(map(piece, loose[text])) if cut is None else b"".join([*map(piece, loose[cut[0]]), *map(known, cut[1:])])
            for text, cut in zip(texts, cuts)
        ]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class PrefixTable:
    """The last token of every byte prefix of one piece."""

    def __init__(self, vocabulary: Vocabulary, text: bytes = b""):
        self.vocabulary = vocabulary
        self.text = text
        self.last: list[int] = []
        self.states: list[int] = [0]  # after every prefix, the empty one included
        self._fill(len(text))

    def _fill(self, end: int) -> None:
        text, last, states, vocabulary = self.text, self.last, self.states, self.vocabulary
        moves, ends, pairs, fits = vocabulary.moves.get, vocabulary.ends, vocabulary.pairs.get, vocabulary.side_by_side
        state = states[-1]
        for i in range(len(last), end):
            byte = text[i]
            after = moves(state << 8 | byte)
            state = vocabulary.move(state, byte) if after is None else after
            states.append(state)
            for length, token in ends[state]:  # the longest first
                if length <= i:
                    before = last[i - length]
                    good = pairs(before << 32 | token)
                    if good is None:
                        good = fits(before, token)
                else:
                    good = vocabulary.reached(token)
                if good:
                    last.append(token)
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")

    def restart(self, text: bytes) -> None:
        """Another text; the entries of the prefix shared with the old one stay."""
        same, end = 0, min(len(text), len(self.text))
        while same < end and text[same] == self.text[same]:
            same += 1
        self.text = text
        del self.last[same:], self.states[same + 1:]
        self._fill(len(text))

    def append(self, more: bytes) -> None:
        self.text += more
        self._fill(len(self.text))

    def edit(self, start: int, end: int, new: bytes) -> int:
        """Replace text[start:end]; the number of entries made anew."""
        old = self.last[end:]
        self.text = self.text[:start] + new + self.text[end:]
        states = self.states[end + 1:]
        del self.last[start:], self.states[start + 1:]
        self._fill(start + len(new))
        agree = 0
        for k, token in enumerate(old):
            if agree == self.vocabulary.longest:  # later entries read only agreeing ones
                self.last.extend(old[k:])
                self.states.extend(states[k:])
                return len(new) + k
            self._fill(start + len(new) + k + 1)
            agree = agree + 1 if self.last[-1] == token and k + 1 >= len(self.vocabulary.tokens[token]) else 0
        return len(new) + len(old)

    def tokens(self) -> list[int]:
        out, at, last, tokens = [], len(self.text), self.last, self.vocabulary.tokens
        while at:
            token = last[at - 1]
            out.append(token)
            at -= len(tokens[token])
        return out[::-1]


# ---- tables ----------------------------------------------------------------------------

def _vocabulary(shipped) -> Vocabulary:
    """One vocabulary per worker process, with its caches."""
    name, ranks, pattern = shipped.value
    return resident(f"ranks {name}", lambda: Vocabulary(ranks, pattern))


def ship_vocabulary(spark: SparkSession, path: str, pattern: str):
    """Broadcast a vocabulary file (its size is that of the file, whatever
    the corpus holds)."""
    return spark.sparkContext.broadcast((uuid.uuid5(uuid.NAMESPACE_URL, path + pattern).hex, read_ranks(path), pattern))


def encode_texts(documents: DataFrame, shipped, id_col: str = "doc_id", text_col: str = "text", decode: bool = False) -> DataFrame:
    """(id, n_tokens, ids): ids are little-endian unsigned 32-bit integers.
    With ``decode`` the bytes decoded from the ids follow, as ``decode_ids``
    gives them, from the same worker."""

    def fn(batch: pa.RecordBatch):
        vocabulary = _vocabulary(shipped)
        ids = vocabulary.encode_all(batch.column(1).to_pylist())
        columns, names = [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["id", "n_tokens", "ids"]
        if decode:
            columns.append(pa.array(map(vocabulary.decode, ids), pa.binary()))
            names.append("decoded")
        yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "id long, n_tokens long, ids binary" + (", decoded binary" if decode else "")
    return map_slices(id_and_text(documents, id_col, text_col), fn, schema, keep=True)


def decode_ids(encoded: DataFrame, shipped) -> DataFrame:
    """Adds ``decoded`` (binary) to what ``encode_texts`` returns."""

    def fn(batch: pa.RecordBatch):
        vocabulary = _vocabulary(shipped)
        texts = [vocabulary.decode(x) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], names=["id", "ids", "n_tokens", "decoded"])

    ordered = encoded.select("id", F.coalesce("ids", F.lit(b"")).alias("ids"), "n_tokens")
    return map_slices(ordered, fn, "id long, ids binary, n_tokens long, decoded binary", keep=True)
