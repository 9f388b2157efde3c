"""Line deduplication by a sharded minimal perfect hash.

1. Every document's lines are hashed (128 bits of xxh3 over the key: the line
   stripped of white space and lower-cased).  One row per distinct key and
   Arrow batch goes to a ``groupBy`` that keeps how many documents hold the
   key and the smallest document id among them.
2. The distinct hashes are cut into shards of about ``SHARD_KEYS``.  Each
   shard becomes a minimal perfect hash (levels of bit arrays) that indexes
   three compact arrays: 64-bit fingerprints, counts and first holders.  One
   row per shard, written to the shared checkpoint folder.
3. Documents send their line hashes, packed per shard, to the shard's arrays
   and get back the hashes of the lines they lose.  No line is joined.  A
   shard with more probes than ``PROBES`` (a line held by a third of all
   documents) is copied, and its probes are dealt over the copies.

Definitions.  A null or empty text is one empty line.  Keys under
``min_chars`` code points are never dropped.  A null document id counts as
the largest id.  Rows that share a document id count as one document.  Two
keys are taken as equal when 128 bits of their hashes agree.  An empty table
gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import id_and_bytes, map_slices

SHARD_KEYS = 1 << 17
PROBES = 1 << 20
NO_ID = (1 << 63) - 1
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


# ---- lines and their hashes ----------------------------------------------------------

def line_hashes(body: bytes, min_chars: int) -> list[bytes]:
    """16 bytes per line of ``body``; b'' for lines that always stay."""
    out = []
    for line in body.lower().split(b"\n"):
        key = line.strip()
        n = len(key)
        if n < min_chars or (n < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars):
            out.append(b"")
        else:
            out.append(xxhash.xxh3_128_digest(key))
    return out


def _batch_pairs(batch: pa.RecordBatch, min_chars: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes as two int64 columns, document ids): one entry per document
    and distinct key."""
    ids, blobs, counts = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False), [], []
    for body in batch.column(1).to_pylist():
        found = set(line_hashes(body, min_chars))
        found.discard(b"")
        blobs.extend(found)
        counts.append(len(found))
    return np.frombuffer(b"".join(blobs), dtype="<i8").reshape(-1, 2), np.repeat(ids, counts)


def _census(min_chars: int):
    def fn(batch: pa.RecordBatch):
        pairs, owner = _batch_pairs(batch, min_chars)
        if not len(owner):
            return
        frame = pd.DataFrame({"h1": pairs[:, 0], "h2": pairs[:, 1], "id": owner}).drop_duplicates()
        out = frame.groupby(["h1", "h2"], sort=False)["id"].agg(["size", "min", "max"]).reset_index()
        out.columns = ["h1", "h2", "n", "lo", "hi"]
        yield pa.RecordBatch.from_pandas(out, preserve_index=False)

    return fn


def line_census(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """(h1, h2, n, lo, hi): per distinct key the number of documents that
    hold it and their smallest and largest id."""
    rows = map_slices(id_and_bytes(documents, id_col, text_col), _census(min_chars), "h1 long, h2 long, n long, lo long, hi long")
    return rows.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


# ---- minimal perfect hash ------------------------------------------------------------

def _slot(keys: np.ndarray, level: int, size: int | np.ndarray) -> np.ndarray:
    x = keys.view(np.uint64) ^ np.uint64((0x9E3779B97F4A7C15 * (2 * level + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return ((x ^ (x >> np.uint64(31))) % np.asarray(size, np.uint64)).astype(np.int64)


def build_hash(h1: np.ndarray, h2: np.ndarray, gamma: float = 1.5) -> tuple[np.ndarray, list[np.ndarray]]:
    """Positions 0..n-1 of the keys, and the bit array of each level.  At a
    level every key that hits a slot alone claims its bit; the others go on.
    Keys are distinct, so h1 xor a mix of h2 tells them apart."""
    key = fold(h1, h2)
    slots, levels, rest, done = np.empty(len(key), np.int64), [], np.arange(len(key)), 0
    while len(rest):
        size = max(64, int(gamma * len(rest)))
        at = _slot(key[rest], len(levels), size)
        alone = np.bincount(at, minlength=size)[at] == 1
        bits = np.zeros(size, bool)
        bits[at[alone]] = True
        rank = np.cumsum(bits)
        slots[rest[alone]] = done + rank[at[alone]] - 1
        done += int(rank[-1])
        levels.append(bits)
        rest = rest[~alone]
        if len(levels) > 200:
            raise ValueError("two distinct keys share all their hash bits")
    return slots, levels


def fold(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    return (h1.view(np.uint64) ^ (h2.view(np.uint64) * _MIX[0])).view(np.int64)


def find(h1: np.ndarray, h2: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """The position of each key; for a key that was not built in, any
    position or -1 (the fingerprint tells)."""
    key, out, rest, done = fold(h1, h2), np.full(len(h1), -1, np.int64), np.arange(len(h1)), 0
    for k, bits in enumerate(levels):
        rank = np.cumsum(bits)
        at = _slot(key[rest], k, len(bits))
        hit = bits[at]
        out[rest[hit]] = done + rank[at[hit]] - 1
        done += int(rank[-1]) if len(rank) else 0
        rest = rest[~hit]
    return out


def _build(key, frame: pd.DataFrame) -> pd.DataFrame:
    h1, h2 = frame["h1"].to_numpy(), frame["h2"].to_numpy()
    slots, levels = build_hash(h1, h2)
    place = np.argsort(slots)
    many = (frame["lo"] < frame["hi"]).to_numpy()
    counts = np.where(many, np.maximum(frame["n"].to_numpy(), 2), 1)
    return pd.DataFrame({
        "shard": [int(key[0])],
        "sizes": [np.array([len(x) for x in levels], "<i8").tobytes()],
        "bits": [b"".join(np.packbits(x).tobytes() for x in levels)],
        "prints": [h2[place].astype("<i8").tobytes()],
        "counts": [np.minimum(counts, 0xFFFFFFFF)[place].astype("<u4").tobytes()],
        "firsts": [frame["lo"].to_numpy()[place].astype("<i8").tobytes()],
    })


def _levels(sizes: bytes, bits: bytes) -> list[np.ndarray]:
    out, at = [], 0
    for n in np.frombuffer(sizes, "<i8"):
        width = -(-int(n) // 8)
        out.append(np.unpackbits(np.frombuffer(bits, np.uint8, width, at), count=int(n)).astype(bool))
        at += width
    return out


def build_index(census: DataFrame, shards: int) -> DataFrame:
    """One row of arrays per shard of the distinct line hashes."""
    return (
        census.withColumn("shard", F.pmod("h1", F.lit(shards)).cast("int"))
        .groupBy("shard")
        .applyInPandas(_build, "shard int, sizes binary, bits binary, prints binary, counts binary, firsts binary")
    )


# ---- probes ---------------------------------------------------------------------------

def _probes(min_chars: int, shards: int, copies):
    """``copies``: a broadcast array, how many copies each shard has."""

    def fn(batch: pa.RecordBatch):
        pairs, owner = _batch_pairs(batch, min_chars)
        if not len(owner):
            return
        shard = pairs[:, 0] % shards
        copy = _slot(owner, 0, copies.value[shard])
        order = np.lexsort((copy, shard))
        s, c = shard[order], copy[order]
        packed = np.column_stack([pairs, owner])[order].astype("<i8")
        cuts = np.flatnonzero(np.diff(s, prepend=-1) | np.diff(c, prepend=-1))
        ends = np.append(cuts[1:], len(s))
        yield pa.RecordBatch.from_arrays(
            [pa.array(s[cuts], pa.int32()), pa.array(c[cuts], pa.int32()), pa.array([packed[a:b].tobytes() for a, b in zip(cuts, ends)], pa.binary())],
            names=["shard", "copy", "probes"],
        )

    return fn


def _answer(min_docs: int):
    def fn(key, probes: pd.DataFrame, arrays: pd.DataFrame) -> pd.DataFrame:
        out_id, out_drop = [], []
        if len(arrays) and len(probes):
            a = arrays.iloc[0]
            levels = _levels(a["sizes"], a["bits"])
            prints, counts, firsts = np.frombuffer(a["prints"], "<i8"), np.frombuffer(a["counts"], "<u4"), np.frombuffer(a["firsts"], "<i8")
            p = np.frombuffer(b"".join(probes["probes"]), "<i8").reshape(-1, 3)
            at = find(np.ascontiguousarray(p[:, 0]), np.ascontiguousarray(p[:, 1]), levels)
            p, at = p[at >= 0], at[at >= 0]
            gone = (prints[at] == p[:, 1]) & (counts[at] >= min_docs) & (firsts[at] != p[:, 2])
            p = p[gone]
            p = p[np.argsort(p[:, 2], kind="stable")]
            cuts = np.flatnonzero(np.diff(p[:, 2], prepend=p[:1, 2] - 1 if len(p) else 0))
            for b, e in zip(cuts, np.append(cuts[1:], len(p))):
                out_id.append(int(p[b, 2]))
                out_drop.append(np.ascontiguousarray(p[b:e, :2]).tobytes())
        return pd.DataFrame({"drop_id": pd.Series(out_id, dtype="int64"), "gone": pd.Series(out_drop, dtype=object)})

    return fn


def _strip(min_chars: int):
    def fn(batch: pa.RecordBatch):
        kept, total, dropped = [], [], []
        for body, blobs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            lines = body.split(b"\n")
            total.append(len(lines))
            if not blobs:
                kept.append(body)
                dropped.append(0)
                continue
            joined = b"".join(blobs)
            gone = {joined[i:i + 16] for i in range(0, len(joined), 16)}
            stay = [x for x, h in zip(lines, line_hashes(body, min_chars)) if h not in gone]
            kept.append(b"\n".join(stay))
            dropped.append(len(lines) - len(stay))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(kept, pa.binary()), pa.array(total, pa.int64()), pa.array(dropped, pa.int64()), *batch.columns[3:]],
            names=["id", "kept", "n_lines", "n_dropped", *batch.schema.names[3:]],
        )

    return fn


def dropped_keys(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """(drop_id, gone): per document the packed hashes of the lines it loses,
    from the sharded index."""
    if min_docs > 2:
        raise ValueError("an id may repeat, so the index tells one document from several only")
    census = cut_lineage(line_census(documents, id_col, text_col, min_chars))
    size = census.agg(F.count(F.lit(1)).alias("keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("probes")).first()
    width = documents.sparkSession.sparkContext.defaultParallelism
    shards = max(width, math.ceil(size["keys"] / SHARD_KEYS), math.ceil(size["probes"] / PROBES))
    index = cut_lineage(build_index(census, shards))
    # probes per shard: a number for each shard of the index, in an array for the tasks and a column for the index
    load = cut_lineage(census.groupBy(F.pmod("h1", F.lit(shards)).cast("int").alias("shard")).agg(F.ceil(F.sum("n") / F.lit(PROBES)).cast("int").alias("copies")))
    spread = index.join(load, "shard").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
    several = load.where("copies > 1").toPandas()  # at most probes / PROBES rows
    copies = np.ones(shards, np.int32)
    copies[several["shard"].to_numpy()] = several["copies"].to_numpy()
    shared = documents.sparkSession.sparkContext.broadcast(copies)
    probes = map_slices(id_and_bytes(documents, id_col, text_col), _probes(min_chars, shards, shared), "shard int, copy int, probes binary")
    answers = probes.groupBy("shard", "copy").cogroup(spread.groupBy("shard", "copy")).applyInPandas(_answer(min_docs), "drop_id long, gone binary")
    return answers.groupBy("drop_id").agg(F.collect_list("gone").alias("gone"))


def dedup_lines(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2, carry: list[str] | None = None) -> DataFrame:
    """(id, kept, n_lines, n_dropped, n_chars): per row of ``documents`` the
    text without lines that another document with a smaller id holds, and the
    length of the text as it was.

    ``carry`` names columns of ``documents`` to hand through, packed in a
    struct column ``carried`` so that no name can clash."""
    gone = dropped_keys(documents, id_col, text_col, min_chars, min_docs)
    base = documents.select(
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("body"),
        F.length(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).cast("long").alias("n_chars"),
        *([F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carried")] if carry else []),
    )
    both = base.join(gone.hint("shuffle_hash"), F.coalesce("id", F.lit(NO_ID)) == F.col("drop_id"), "left").select(
        "id", "body", "gone", "n_chars", *(["carried"] if carry else []))
    schema = "id long, kept binary, n_lines long, n_dropped long, n_chars long"
    if carry:
        schema += f", carried {both.schema['carried'].dataType.simpleString()}"
    return map_slices(both, _strip(min_chars), schema).withColumn("kept", F.col("kept").cast("string"))
