"""Benchmark decontamination with a generalised suffix automaton.

The normalised words of all test items form one suffix automaton (per shard
of at most ``SHARD_BYTES`` of item text).  Training documents stream their
words through it; at every word the automaton gives the length of the longest
match that ends there.  A match of ``window`` words, or of a whole shorter
item, marks its words as hit.  Hit spans are cut out of the text; a document
whose share of hit words exceeds ``max_coverage`` loses its whole text.

Items longer than ``PIECE_WORDS`` are cut into pieces that overlap by
``window - 1`` words, which changes no window.  A benchmark of one shard is
broadcast with its item ids, and nothing is shuffled.  Of a larger one each
distinct piece is kept once, its item ids stay in a side table.  Each shard is
a job of its own that writes what it finds, so one broadcast and one automaton
a worker are alive at a time; the documents are read once a shard.  What was
found then meets the item ids and the documents by joins.

Definitions.  Null and empty texts have no words; such items match nothing.
A null item id is listed as the empty string.  Repeated item ids count once.
Rows come back one to one, repeated document ids included; empty tables give
empty results.
"""

from __future__ import annotations

import math
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, ensure_checkpoint_dir
from .common import id_and_bytes, map_slices, resident, skew_join

WINDOW = 10
SHARD_BYTES = 1 << 20
#: What a piece counts besides its words and item id.
PIECE_BYTES = 8
PIECE_WORDS = 20_000

#: A-Z to a-z; digits, a-z and all bytes from 80 stay; the rest separates.
_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words_of(body: bytes) -> list[bytes]:
    return body.translate(_WORDS).split()


class SuffixAutomaton:
    """Generalised suffix automaton over word sequences.

    ``full[v]``: items with a window whose last word leads to state v;
    ``short[v]``: (length, item) of whole shorter items that end in v."""

    def __init__(self, items: list[tuple[str, list]], window: int):
        self.window = window
        self.next: list[dict] = [{}]
        self.link: list[int] = [-1]
        self.length: list[int] = [0]
        self.vocab: dict = {}
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, self.vocab.setdefault(w, len(self.vocab)))
        self._mark(items)

    def _copy(self, p: int, c: int, q: int) -> int:
        clone = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:  # an earlier item holds this text too
            return q if self.length[q] == self.length[last] + 1 else self._copy(last, c, q)
        new = len(self.next)
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._copy(p, c, q)
        return new

    def _state_of(self, v: int, n: int) -> int:
        """The state that holds the last n words of what leads to v."""
        while self.length[self.link[v]] >= n:
            v = self.link[v]
        return v

    def _mark(self, items: list[tuple[str, list]]) -> None:
        n = len(self.next)
        self.full: list = [None] * n
        self.short: list = [None] * n
        self.shortest = min([self.window, *(len(w) for _, w in items if w)])
        for item, words in items:
            v = 0
            for k, w in enumerate(words, 1):
                v = self.next[v][self.vocab[w]]
                if k >= self.window:
                    u = self._state_of(v, self.window)
                    self.full[u] = (self.full[u] or set()) | {item}
            if 0 < len(words) < self.window:
                u = self._state_of(v, len(words))
                self.short[u] = sorted((self.short[u] or []) + [(len(words), item)])
        # nearest state on the way to the root that holds shorter items, itself included
        self.short_up = [-1] * n
        for v in sorted(range(n), key=self.length.__getitem__):
            self.short_up[v] = v if self.short[v] else self.short_up[self.link[v]] if v else -1
        self.window_up = [self._state_of(v, self.window) if self.length[v] >= self.window else -1 for v in range(n)]
        self.runs = re.compile(b"\x01{%d,}" % self.shortest)

    def scan(self, words: list) -> tuple[list[tuple[int, int]], set]:
        """Hit word intervals (merged, end exclusive) and the items found."""
        spans: list[tuple[int, int]] = []
        found: set = set()
        if not self.vocab:
            return spans, found
        nxt, link, length, window = self.next, self.link, self.length, self.window
        flags = bytes(map(self.vocab.__contains__, words))
        for run in self.runs.finditer(flags):
            v = size = 0
            for i in range(run.start(), run.end()):
                c = self.vocab[words[i]]
                while v and c not in nxt[v]:
                    v = link[v]
                    size = length[v]
                if c in nxt[v]:
                    v = nxt[v][c]
                    size += 1
                longest = 0
                if size >= window:
                    found |= self.full[self.window_up[v]]
                    longest = window
                u = self.short_up[v]
                while u >= 0:
                    for n, item in self.short[u]:
                        if n <= size:
                            found.add(item)
                            longest = max(longest, n)
                    u = self.short_up[link[u]] if u else -1
                if longest:
                    spans.append((i + 1 - longest, i + 1))
        return merged(spans), found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


# ---- the benchmark in shards ----------------------------------------------------------

def _pieces(window: int):
    def fn(batch: pa.RecordBatch):
        items, texts = [], []
        for item, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = words_of(body)
            step = PIECE_WORDS - window + 1
            for at in range(0, max(1, len(words) - window + 1), step):
                part = words[at:at + PIECE_WORDS]
                if part:
                    items.append(item)
                    texts.append(b" ".join(part))
        yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(texts, pa.binary())], names=["item", "words"])

    return fn


def benchmark_pieces(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(item, words), written once."""
    base = benchmark.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("body"),
    )
    return cut_lineage(map_slices(base, _pieces(window), "item string, words binary"))


def _bytes(rows: DataFrame, *columns: str) -> int:
    sizes = [F.octet_length(c) for c in columns]
    return rows.agg(F.coalesce(F.sum(sum(sizes, F.lit(PIECE_BYTES))), F.lit(0)).alias("n")).first()["n"]


def distinct_shards(pieces: DataFrame) -> tuple[int, DataFrame]:
    """(number of shards, (piece, words, shard)): each distinct piece once,
    in order of the shards, so that reading one skips the others."""
    once = pieces.groupBy("words").agg(F.first(F.sha2("words", 256)).alias("piece"))
    shards = max(1, math.ceil(_bytes(once, "words", "piece") / SHARD_BYTES))
    dealt = once.select("piece", "words", F.pmod(F.xxhash64("words"), F.lit(shards)).alias("shard"))
    return shards, cut_lineage(dealt.repartitionByRange("shard").sortWithinPartitions("shard"))


def _automaton(shard, window: int) -> SuffixAutomaton:
    """One automaton at a time is kept per worker."""
    name, items = shard.value
    return resident(f"items {name}", lambda: SuffixAutomaton([(item, words.split()) for item, words in items], window))


# ---- documents -------------------------------------------------------------------------

def char_spans(body: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte intervals of word intervals."""
    at = [m.span() for m in re.finditer(rb"[^ ]+", body.translate(_WORDS))] if spans else []
    return [(at[a][0], at[b - 1][1]) for a, b in spans]


def _find(shard, window: int):
    """(key, hits, pieces) of the documents in which a shard finds something."""

    def fn(batch: pa.RecordBatch):
        automaton = _automaton(shard, window)
        keys, hits, pieces = [], [], []
        for key, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            spans, found = automaton.scan(words_of(body))
            if found:
                keys.append(key)
                hits.append([x for s in spans for x in s])
                pieces.append(sorted(found))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(hits, pa.list_(pa.int64())), pa.array(pieces, pa.list_(pa.string()))], names=["key", "hits", "pieces"])

    return fn


def find_in_shards(bodies: DataFrame, pieces: DataFrame, window: int) -> DataFrame:
    """(key, hits, items) of the documents (key, body) that hold a piece."""
    spark = bodies.sparkSession
    shards, dealt = distinct_shards(pieces)
    target = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    schema = "key string, hits array<bigint>, pieces array<string>"
    for k in range(shards):
        items = [(r["piece"], bytes(r["words"])) for r in dealt.where(F.col("shard") == k).collect()]
        shard = spark.sparkContext.broadcast((uuid.uuid4().hex, items))
        map_slices(bodies, _find(shard, window), schema, keep=True).write.mode("append").parquet(target)
        shard.destroy()
    found = spark.read.schema(schema).parquet(target)
    hits = found.groupBy("key").agg(F.flatten(F.collect_set("hits")).alias("hits"))
    names = pieces.select(F.sha2("words", 256).alias("piece"), "item").distinct()
    held = found.select("key", F.explode("pieces").alias("piece")).distinct()
    items = held.join(names, "piece").groupBy("key").agg(F.collect_set("item").alias("items"))
    return hits.join(items, "key")


def _scanned(shard, window: int):
    """(spans, items) of the rows of a batch: by the one shard, or as found before."""

    def fn(batch: pa.RecordBatch):
        if shard is None:
            for hits, items in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                yield merged(list(zip(hits[::2], hits[1::2]))) if hits else [], sorted(items or ())
        else:
            automaton = _automaton(shard, window)
            for body in batch.column(1).to_pylist():
                spans, found = automaton.scan(words_of(body))
                yield spans, sorted(found)

    return fn


def _finish(shard, window: int, max_coverage: float, with_text: bool):
    scan = _scanned(shard, window)

    def fn(batch: pa.RecordBatch):
        n_words, n_hit, spans, texts, found = [], [], [], [], []
        for body, (pairs, items) in zip(batch.column(1).to_pylist(), scan(batch)):
            n = len(words_of(body))
            hit = sum(b - a for a, b in pairs)
            found.append(items)
            cut = char_spans(body, pairs)
            n_words.append(n)
            n_hit.append(hit)
            spans.append([{"start": len(body[:a].decode()), "end": len(body[:b].decode())} for a, b in cut])
            if with_text:
                keep, at = [], 0
                for a, b in cut:
                    keep.append(body[at:a])
                    at = b
                keep.append(body[at:])
                texts.append(None if hit > max_coverage * n else b"".join(keep))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        columns = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(found, pa.list_(pa.string())), pa.array(spans, kind)]
        names = ["id", "n_words", "n_hit", "items", "spans"]
        if with_text:
            columns.append(pa.array(texts, pa.binary()))
            names.append("clean")
        yield pa.RecordBatch.from_arrays([*columns, *batch.columns[4:]], names=[*names, *batch.schema.names[4:]])

    return fn


def decontaminate(
    documents: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    max_coverage: float = 0.5,
    with_text: bool = True,
    carry: list[str] | None = None,
) -> DataFrame:
    """(id, n_words, n_hit, items, spans[, clean][, carried]) per document.

    ``spans`` are code point intervals of the hit words, ``clean`` the text
    without them (null if more than ``max_coverage`` of the words are hit),
    ``carried`` a struct of the columns named in ``carry``."""
    spark = documents.sparkSession
    now = id_and_bytes(documents, id_col, text_col) if not carry else documents.select(
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("body"),
        F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carried"),
    )
    tail = f", carried {now.schema['carried'].dataType.simpleString()}" if carry else ""
    extra = ["carried"] if carry else []
    pieces = benchmark_pieces(benchmark, item_id_col, item_text_col, window)
    if _bytes(pieces, "words", "item") <= SHARD_BYTES:
        items = [(r["item"], bytes(r["words"])) for r in pieces.collect()]
        shard = spark.sparkContext.broadcast((uuid.uuid4().hex, items))
        now = now.select("id", "body", F.lit(None).cast("array<bigint>").alias("hits"), F.lit(None).cast("array<string>").alias("items"), *extra)
    else:
        shard = None
        now = cut_lineage(now.withColumn("key", F.sha2("body", 256)))
        found = cut_lineage(find_in_shards(now.select("key", "body"), pieces, window))
        now = skew_join(now, found, "key", "id").select("id", "body", "hits", "items", *extra)
    schema = "id long, n_words long, n_hit long, items array<string>, spans array<struct<start:bigint,end:bigint>>"
    schema += (", clean binary" if with_text else "") + tail
    now = map_slices(now, _finish(shard, window, max_coverage, with_text), schema, keep=True)
    return now.withColumn("clean", F.col("clean").cast("string")) if with_text else now
