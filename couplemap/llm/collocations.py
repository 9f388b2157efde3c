"""Phrase collocations by top-order marginalisation.

Every word of a piece opens one window: the word and the (at most four) words
that follow it in the piece, as columns w1..w5, padded with '' at the end.
Only these longest windows are counted (one ``groupBy``); Spark's ROLLUP over
w1..w5 then sums the counts of successively shorter prefixes, and a prefix's
sum is the count of that phrase, since each occurrence opens one window.  No
separate n-grams are exploded.

A window is padded from the place on where no candidate can go on.  A
candidate's neighbouring pairs and triples of words occur at least ``least``
times.  A first pass counts all pairs by a hash, a second one the triples made
of two pairs that reached ``least``.  The hashes that reach it set bits of a
bitmap of 2 ** ``BITS`` bits, 16 MB whatever the corpus holds, which is
broadcast.  A bit that another pair or triple set keeps a window longer than
needed and changes no count: what is reported is counted on the words
themselves.  With very large corpora the bitmap fills up and the windows stay
long; the result is the same.

Scores are exact: decimals of 38 digits, and integer division.

Definitions.  A null language is ``und`` (and meets a language of that name),
a null text is empty.  Texts without words add nothing.  Repeated rows count
each time.  Ties between cuts go to the shorter first part; phrases of equal
score and count are ordered bytewise.  An empty table has no phrases.  Only the
language and text columns are read.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import map_slices

ORDER = 5
LEAST = 100
TOP = 2000
BITS = 27
PART_BYTES = 128 << 20  # text whose pairs one part of the bitmap counts
LEAST_PARTS = 256
SLICE = 4 << 20
_BREAK = b"\xff"  # in no UTF-8 text
_DELIMITERS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes(0xFF if c in _DELIMITERS else c + 32 if 65 <= c <= 90 else c for c in range(256))
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
COLUMNS = [f"w{k}" for k in range(1, ORDER + 1)]


# ---- slices of text ------------------------------------------------------------------------

def _words(batch: pa.RecordBatch) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(distinct words, code per place with -1 between pieces, language per place)."""
    lists = [(_BREAK + body.translate(_TABLE)).replace(_BREAK, b" \xff ").split() for body in batch.column(1).to_pylist()]
    flat = pa.array([w for words in lists for w in words], pa.binary()).dictionary_encode()
    distinct = flat.dictionary.to_pylist()
    codes = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    if distinct:
        codes[codes == distinct.index(_BREAK)] = -1
    langs = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    return distinct, codes, langs


def _mixed(x: np.ndarray, then: np.ndarray) -> np.ndarray:
    """The hash of a phrase from that of its start and of its last word."""
    x = ((x ^ (x >> np.uint64(31))) + then) * _ODD[2]
    return x ^ (x >> np.uint64(29))


class _Phrases:
    """Pairs and triples of a slice by the place of their first word."""

    def __init__(self, batch: pa.RecordBatch, distinct: list[bytes], codes: np.ndarray, owner: np.ndarray):
        word = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))
        lang = np.fromiter(map(xxhash.xxh3_64_intdigest, batch.column(0).to_pylist()), np.uint64, batch.num_rows)
        h, is_word = word[codes], codes >= 0
        self.pair = _mixed((h[:-1] * _ODD[0] + lang[owner[:-1]]) * _ODD[1], h[1:])
        self.is_pair = is_word[:-1] & is_word[1:]
        self.triple = _mixed(self.pair[:-1], h[2:])

    def marked(self, set_bits: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Which pairs, and which triples, may be frequent."""
        on = self.is_pair & _is_set(set_bits, self.pair, bits)
        both = on[:-1] & on[1:]
        return on, both


def _is_set(set_bits: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    at = _first_bits(h, bits)
    return (set_bits[at >> 3] >> (7 - (at & 7)) & 1) == 1


def _count_hashes(depth: int, pairs, bits: int):
    """Hashes that occur in the slice, packed per part of the hash space (the
    first ``depth`` bits; the next 32 are sent): those found once, and the
    others with their counts.  Pairs, or given their bitmap the triples."""

    def fn(batch: pa.RecordBatch):
        distinct, codes, owner = _words(batch)
        if len(codes) < 3:  # a break, a word
            return
        phrases = _Phrases(batch, distinct, codes, owner)
        if pairs is None:
            h = phrases.pair[phrases.is_pair]
        else:
            h = phrases.triple[phrases.marked(np.frombuffer(pairs.value, np.uint8), bits)[1]]
        if not len(h):
            return
        found, times = np.unique(h >> np.uint64(32 - depth), return_counts=True)
        part, rest = (found >> np.uint64(32)).astype(np.int64), found.astype("<u4")
        cuts = np.flatnonzero(np.diff(part, prepend=-1))
        rows = []
        for a, b in zip(cuts, np.append(cuts[1:], len(part))):
            again = times[a:b] > 1
            rows.append((int(part[a]), rest[a:b][~again].tobytes(), rest[a:b][again].tobytes(), times[a:b][again].astype("<u4").tobytes()))
        columns = list(zip(*rows))
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=["part", "once", "hashes", "times"])

    return fn


def _first_bits(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


# ---- the bitmap of pairs ----------------------------------------------------------------------

def _sum_part(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    read = lambda name: np.frombuffer(b"".join(frame[name]), "<u4")
    once, h = read("once"), read("hashes")
    n = np.concatenate([np.ones(len(once), np.int64), read("times").astype(np.int64)])
    h = np.concatenate([once, h])
    order = np.argsort(h, kind="stable")
    h, n = h[order], n[order]
    starts = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    return h[starts], np.add.reduceat(n, starts)


def frequent_bitmap(texts: DataFrame, least: int = LEAST, bits: int = BITS, pairs=None) -> bytes:
    """A bitmap of 2 ** bits bits: set where the hash of a neighbouring pair
    (with the broadcast bitmap ``pairs``: of a triple) occurs ``least`` times
    or more.  A part sums the counts
    of a range of the hash space; there are as many parts as the texts need.  A
    very common pair is one packed entry per slice."""
    size = texts.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    depth = min(bits - 3, math.ceil(math.log2(max(LEAST_PARTS, size / PART_BYTES))))
    packed = map_slices(texts, _count_hashes(depth, pairs, bits), "part int, once binary, hashes binary, times binary", limit=SLICE)

    def frequent(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        h, n = _sum_part(frame)
        width = 1 << (bits - depth)
        mine = np.zeros(width, bool)
        mine[h[n >= least].astype(np.int64) >> (32 - (bits - depth))] = True
        return pd.DataFrame({"part": [int(key[0])], "map": [zlib.compress(np.packbits(mine).tobytes(), 1)]})

    rows = packed.groupBy("part").applyInPandas(frequent, "part int, map binary").collect()  # the bitmap, of fixed size
    width = 1 << (bits - depth - 3)
    whole = bytearray(width << depth)
    for r in rows:
        whole[r["part"] * width:(r["part"] + 1) * width] = zlib.decompress(bytes(r["map"]))
    return bytes(whole)


# ---- windows -----------------------------------------------------------------------------------

def _distinct_rows(rows: np.ndarray, codes: int) -> np.ndarray:
    """The distinct rows of (language, codes...) and, as last column, how often
    each occurs; rows are numbered column by column."""
    number = rows[:, 0]
    for k in range(1, rows.shape[1]):
        if k == 1 or rows[:, k].max() >= 0:
            number = np.unique(number * (codes + 1) + rows[:, k] + 1, return_inverse=True)[1]
    _, first, times = np.unique(number, return_index=True, return_counts=True)
    return np.column_stack([rows[first], times])


def _windows(bitmap, bits: int):
    def fn(batch: pa.RecordBatch):
        distinct, codes, owner = _words(batch)
        if not len(codes):
            return
        names, lang = np.unique(np.array(batch.column(0).to_pylist(), object), return_inverse=True)
        lang = lang[owner]
        n = len(codes)
        is_word = codes >= 0
        # runs[i]: how many places after i belong to i's window
        runs, on, triples = np.zeros(n, np.int64), np.zeros(n + ORDER, bool), np.zeros(n + ORDER, bool)
        if n > 2:
            phrases, set_bits = _Phrases(batch, distinct, codes, owner), np.frombuffer(bitmap.value, np.uint8)
            on[:n - 1], both = phrases.marked(set_bits, bits)
            triples[:n - 2] = both & _is_set(set_bits, phrases.triple, bits)
        going = on[:n].copy()
        for k in range(ORDER - 1):
            if k:
                going &= triples[k - 1:n + k - 1]
            runs += going
        here = np.flatnonzero(is_word)
        if not len(here):
            return
        columns = [lang[here]]
        wide = np.append(codes, np.full(ORDER, -1))
        for k in range(ORDER):
            columns.append(np.where(runs[here] >= k, wide[here + k], -1))
        rows = []
        for some in (columns[2] < 0, columns[2] >= 0):  # of one word (most), and longer ones
            part = np.column_stack([c[some] for c in columns])
            if len(part):
                rows.append(_distinct_rows(part, len(distinct)))
        table = np.concatenate(rows)
        text = pa.array([*distinct, b""], pa.binary())
        take = lambda c: text.take(pa.array(np.where(c < 0, len(distinct), c))).cast(pa.string())
        yield pa.RecordBatch.from_arrays(
            [pa.array(names[table[:, 0]], pa.string()), *[take(table[:, k]) for k in range(1, ORDER + 1)], pa.array(table[:, -1], pa.int64())],
            names=["lang", *COLUMNS, "n"])

    return fn


def phrase_counts(documents: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, bits: int = BITS) -> DataFrame:
    """(lang, len, phrase, f): len 0 holds the number of word occurrences of a
    language, others the counts of phrases (single words too) with f >= least."""
    texts = documents.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("body"))
    spark = documents.sparkSession
    pairs = frequent_bitmap(texts, least, bits)
    triples = frequent_bitmap(texts, least, bits, spark.sparkContext.broadcast(pairs))
    both = np.frombuffer(pairs, np.uint8) | np.frombuffer(triples, np.uint8)
    bitmap = spark.sparkContext.broadcast(both.tobytes())
    wide = map_slices(texts, _windows(bitmap, bits), "lang string, " + ", ".join(f"{c} string" for c in COLUMNS) + ", n long", limit=SLICE)
    windows = cut_lineage(wide.groupBy("lang", *COLUMNS).agg(F.sum("n").alias("n")))
    sums = windows.rollup("lang", *COLUMNS).agg(F.sum("n").alias("f"), F.grouping_id().alias("g"))
    # grouping_id has one bit per column left out: 2^k - 1 for the last k of them
    length = F.lit(ORDER) - F.round(F.log2(F.col("g") + 1)).cast("int")
    last = F.lit("x")
    for k, c in enumerate(COLUMNS, 1):
        last = F.when(F.col("len") == k, F.col(c)).otherwise(last)
    sums = sums.withColumn("len", length).where((F.col("len") >= 0) & (last != "") & ((F.col("len") == 0) | (F.col("f") >= least)))
    whole = F.array_join(F.slice(F.array(*COLUMNS), F.lit(1), F.col("len")), " ")
    return sums.select("lang", "len", whole.alias("phrase"), "f")


# ---- scores ----------------------------------------------------------------------------------------

def _part(first: Column, count: Column) -> Column:
    return F.array_join(F.slice(F.split("phrase", " "), first, count), " ")


def collocations(documents: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int | None = TOP, bits: int = BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): per language the phrases of two
    to five words, best first; all of them without ``top``."""
    counts = cut_lineage(phrase_counts(documents, text_col, lang_col, least, bits))
    totals = counts.where("len = 0").select("lang", F.col("f").alias("n"))
    known = counts.where("len > 0").select("lang", "phrase", "f")
    candidates = counts.where("len > 1").select("lang", "len", "phrase", F.col("f").alias("a"))

    cuts = candidates.select("*", F.explode(F.sequence(F.lit(1), F.col("len") - 1)).alias("k"))
    cuts = cuts.select(
        "lang", "phrase", "a", "k", _part(F.lit(1), F.col("k")).alias("one"), _part(F.col("k") + 1, F.col("len")).alias("two"))
    ones = known.select("lang", F.col("phrase").alias("one"), F.col("f").alias("l"))
    twos = known.select("lang", F.col("phrase").alias("two"), F.col("f").alias("r"))
    cuts = cuts.join(ones, ["lang", "one"]).join(twos, ["lang", "two"]).join(totals, "lang")
    score = F.expr(
        "cast(cast(1000 as decimal(4,0)) * cast(a as decimal(17,0)) * cast(n as decimal(17,0)) as decimal(38,0)) div "
        "(cast(l as decimal(18,0)) * cast(r as decimal(18,0)))")
    scored = cuts.select("lang", "phrase", "a", "l", "r", "n", "k", score.alias("score"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("c")).select("lang", "phrase", "c.*")

    # a phrase goes that stands as often inside a longer candidate
    longer = candidates.where("len > 2").select("*", F.explode(F.sequence(F.lit(2), F.col("len") - 1)).alias("m"))
    longer = longer.select("*", F.explode(F.sequence(F.lit(1), F.col("len") - F.col("m") + 1)).alias("s"))
    inside = longer.select("lang", _part(F.col("s"), F.col("m")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    kept = best.join(inside, ["lang", "phrase"], "left").where("most is null or 100 * most < 100 * a")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = kept.withColumn("rank", rank.cast("long"))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
