"""Token counts by rank-synchronous merging of ragged arrays.

The distinct pre-tokens of a slice of texts lie side by side in one numpy
array of symbols.  In every round each pre-token's lowest-rank pair is found
with one segmented minimum and all of them are merged at the same time; the
pre-tokens without a mergeable pair leave the array with their number of
symbols.  A text's count is the sum over its pre-tokens.

The counts are those of the ``tokenizers`` library for a byte-level BPE file,
without added begin or end tokens.  The strings of special tokens inside a
text count as one token each, as is the library's default.

Definitions.  A null text is the empty text: no bytes, no tokens.  Rows come
back one to one, repeated ids included.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import BoundedCache, chunks, id_and_text, map_slices, resident, whole

CACHE = 200_000
#: The byte-level pattern that the library uses (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_NONE = np.int64(1) << 40


def byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies:
    printable Latin-1 bytes are themselves, the others follow from 0x100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


class RankMerger:
    """Merge tables as sorted arrays."""

    def __init__(self, spec: dict):
        model = spec["model"]
        if model["type"] != "BPE" or spec.get("normalizer") or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel":
            raise ValueError("not a byte-level BPE file")
        if model.get("dropout") or spec["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("dropout and prefix spaces are not supported")
        vocab = model["vocab"]
        self.size = np.int64(max(vocab.values()) + 1)
        self.symbol_of_byte = np.array([vocab[c] for c in byte_characters()], np.int64)
        pairs = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        key = left * self.size + right
        order = np.argsort(key, kind="stable")
        self.key, self.rank, self.made = key[order], order.astype(np.int64), made
        # a merged symbol's own pairs come later in the list, so equal pairs can be merged together
        born = np.full(self.size, -1, np.int64)
        born[made] = np.arange(len(made))
        if len(np.unique(made)) != len(made) or (np.maximum(born[left], born[right]) >= np.arange(len(made))).any():
            raise ValueError("merges are not in order of dependence")
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        if any(t.get(k) for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that take in their surroundings are not supported")
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.find = regex.compile(PATTERN).findall
        self.chunks = BoundedCache(CACHE)

    def ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank[at], _NONE)

    def counts(self, pieces: list[bytes]) -> np.ndarray:
        """Number of tokens of each pre-token."""
        length = np.fromiter(map(len, pieces), np.int64, len(pieces))
        out = length.copy()
        who = np.flatnonzero(length > 1)
        symbol = self.symbol_of_byte[np.frombuffer(b"".join([pieces[i] for i in who.tolist()]), np.uint8)]
        length = length[who]
        rank = None
        while len(who):
            starts = np.cumsum(length) - length
            ends = starts + length - 1
            if rank is None:
                rank = np.full(len(symbol), _NONE)
                rank[:-1] = self.ranks_of(symbol[:-1], symbol[1:])
                rank[ends] = _NONE
            lowest = np.minimum.reduceat(rank, starts)
            ready = lowest == _NONE
            if ready.any():  # these sequences are done
                out[who[ready]] = length[ready]
                keep = np.repeat(~ready, length)
                symbol, rank, who, length, lowest = symbol[keep], rank[keep], who[~ready], length[~ready], lowest[~ready]
                continue
            owner = np.repeat(np.arange(len(who)), length)
            at = np.flatnonzero(rank == lowest[owner])
            # in a run of overlapping equal pairs (aaa) every other one is merged, from the left
            run = np.flatnonzero(np.diff(at, prepend=-2) != 1)
            inside = np.arange(len(at)) - np.repeat(run, np.diff(run, append=len(at)))
            at = at[inside % 2 == 0]
            symbol[at] = self.made[rank[at]]
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            length = length - np.bincount(owner[at], minlength=len(who))
            place = np.cumsum(keep) - 1
            at = place[at]
            symbol, rank = symbol[keep], rank[keep]
            last = np.zeros(len(symbol), bool)
            last[np.cumsum(length) - 1] = True
            redo = np.unique(np.concatenate([at, at[at > 0] - 1]))
            redo = redo[~last[redo]]
            rank[redo] = self.ranks_of(symbol[redo], symbol[redo + 1])
            rank[np.flatnonzero(last)] = _NONE
        return out

    def texts(self, texts: list[str]) -> list[int]:
        """Number of tokens of each text."""
        parts, owner, total = [], [], [0] * len(texts)
        for k, text in enumerate(texts):
            if self.cut is not None and self.cut.search(text):
                pieces = self.cut.split(text)
                total[k] = len(pieces) - 1
                parts.extend(pieces)
                owner.extend([k] * len(pieces))
            else:
                parts.append(text)
                owner.append(k)
        cuts = [chunks(x) for x in parts]
        loose = {text if cut is None else cut[0] for text, cut in zip(parts, cuts)}
        wanted = {chunk for cut in cuts if cut for chunk in cut[1:]}
        new = self.chunks.settle(wanted)
        loose_pieces = {text: self.find(text) for text in loose}
        new_pieces = [self.find(whole(x)) for x in new]
        distinct = list({p for found in (loose_pieces.values(), new_pieces) for pieces in found for p in pieces})
        count = dict(zip(distinct, self.counts([p.encode() for p in distinct]).tolist())).__getitem__
        for chunk, pieces in zip(new, new_pieces):
            self.chunks[chunk] = sum(map(count, pieces))
        known = self.chunks.__getitem__
        for k, text, cut in zip(owner, parts, cuts):
            if cut is None:
                total[k] += sum(map(count, loose_pieces[text]))
            else:
                total[k] += sum(map(count, loose_pieces[cut[0]])) + sum(map(known, cut[1:]))
        return total


def ship_file(spark: SparkSession, path: str):
    """Broadcast a tokenizer file (bounded by the file, whatever the corpus holds)."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast((uuid.uuid5(uuid.NAMESPACE_URL, path).hex, f.read()))


def count_tokens(documents: DataFrame, shipped, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) per document."""

    def fn(batch: pa.RecordBatch):
        name, text = shipped.value
        merger = resident(f"merges {name}", lambda: RankMerger(json.loads(text)))
        bodies = batch.column(1).to_pylist()
        n = np.array(merger.texts(bodies), np.int64)
        size = pc.binary_length(batch.column(1).cast(pa.binary()))
        yield pa.RecordBatch.from_arrays([batch.column(0), size.cast(pa.int64()), pa.array(n), pa.array(n > limit)], names=["id", "n_bytes", "n_tokens", "over_limit"])

    return map_slices(id_and_text(documents, id_col, text_col), fn, "id long, n_bytes long, n_tokens long, over_limit boolean", keep=True)
