"""N-gram Jaccard join by vertical partitioning.

A document's set holds the 64-bit hashes of its distinct five-word shingles.
Documents with equal sets are one class; classes are linked when their sets'
Jaccard similarity reaches the threshold.

1. The global order of shingles (by hash) is cut into fragments of about
   ``FRAGMENT`` shingles.  Every class sends each fragment its segment of
   shingles, packed.  A fragment counts in how many classes each of its
   shingles occurs and returns the shared ones by class, packed per bucket of
   classes; the partial counts are summed per class.  A class whose shared shingles are fewer than the
   threshold's part of its set can have no link and leaves.
   Shingles in more than ``HOT`` of all classes (a list of bounded length)
   are known from the first pass.  Their segments are dealt by class, so a
   passage that a third of all documents hold fills no fragment.
2. In order of rising class count, each remaining class's prefix must hold a
   shingle of any partner.  Each prefix shingle's classes are first compared
   with one leader (the class with the most common shingles); what is linked
   is contracted; then only pairs of different components are compared.  So a
   group of thousands of near copies makes few pairs.
3. A pair's overlap is counted fragment by fragment and summed per pair.

No link between different components is lost: a pair is left out only if its
size, its shared shingles or its place in the order rule it out, or if its
classes are already in one component.  Result: one row per document.

Definitions.  Null, empty and wordless texts have an empty set, no links, and
their own id as component.  With fewer than five words the whole sequence is
one shingle.  Repeated rows are copies.  A null id never names a component
unless all its documents lack an id.  Equal 64-bit hashes count as equal
shingles, equal 64-bit hashes of whole sets as equal sets.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..session import cut_lineage
from .common import BoundedCache, id_and_bytes, map_slices

SHINGLE = 5
THRESHOLD = 80  # percent
FRAGMENT = 4 << 20
BUCKET = 1 << 14  # classes whose shared shingles are gathered together
HOT = 1000  # a hot shingle is in more than one class in so many
HOT_LEAST = 4096
COUNT_FRAGMENTS = 8
_ODD = np.array([0x9E3779B97F4A7C15 * (2 * k + 3) % (1 << 64) | 1 for k in range(64)], np.uint64)


# ---- sets ----------------------------------------------------------------------------

def shingle_sets(bodies: list[bytes], width: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes (uint64) of each text."""
    split = [body.lower().split() for body in bodies]
    out = []
    word_hash = xxhash.xxh3_64_intdigest
    for words in split:
        n = len(words)
        if n < width:
            key = [xxhash.xxh3_64_intdigest(b" ".join(words), 1)] if words else []
            out.append(np.array(key, np.uint64))
            continue
        h = np.fromiter(map(word_hash, words), np.uint64, n)
        count = n - width + 1
        key = h[:count] * _ODD[0]
        for k in range(1, width):
            key ^= key >> np.uint64(29)
            key = (key + h[k:k + count]) * _ODD[k]
        key ^= key >> np.uint64(32)
        out.append(np.unique(key))
    return out


def set_key(tokens: np.ndarray) -> int:
    return int(np.frombuffer(xxhash.xxh3_64_digest(tokens.tobytes()), ">i8")[0])


def _pass_one(width: int):
    """A row per document, and a row per shingle that is frequent in the slice."""

    def fn(batch: pa.RecordBatch):
        sets = shingle_sets(batch.column(1).to_pylist(), width)
        keys = [set_key(x) for x in sets]
        size = pa.array([len(x) for x in sets], pa.int64())
        none = pa.nulls(len(sets), pa.int64())
        names = ["id", "row", "n", "key", "token", "df"]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), size, pa.array(keys, pa.int64()), none, none], names=names)
        classes = dict(zip(keys, sets))
        all_tokens = np.sort(np.concatenate(list(classes.values())))
        starts = np.flatnonzero(np.diff(all_tokens, prepend=all_tokens[:1] + np.uint64(1)))
        df = np.diff(starts, append=len(all_tokens))
        hot = df >= max(2, len(classes) / HOT)
        token = pa.array(all_tokens[starts[hot]].view(np.int64))
        none = pa.nulls(len(token), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, token, pa.array(df[hot], pa.int64())], names=names)

    return fn


# ---- fragments -----------------------------------------------------------------------

def _segments(width: int, fragments: int, hot):
    """Packed segments per fragment; hot shingles go to fragments of their
    own, numbered from ``fragments`` on and dealt by class."""
    seen = BoundedCache(1 << 20)
    hot_tokens = hot.value[0]

    def fn(batch: pa.RecordBatch):
        seen.room(batch.num_rows)
        sets = {}
        for tokens in shingle_sets(batch.column(1).to_pylist(), width):
            if len(tokens):
                key = set_key(tokens)
                if key not in seen:
                    seen[key] = True
                    sets[key] = tokens
        if not sets:
            return
        keys = np.fromiter(sets, np.int64, len(sets))
        sizes = np.fromiter(map(len, sets.values()), np.int64, len(sets))
        tokens = np.concatenate(list(sets.values()))
        owner = np.repeat(np.arange(len(sets)), sizes)
        part = ((tokens >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)).astype(np.int64)
        if len(hot_tokens):
            at = np.minimum(np.searchsorted(hot_tokens, tokens), len(hot_tokens) - 1)
            part = np.where(hot_tokens[at] == tokens, fragments + keys[owner] % fragments, part)
        order = np.argsort(part, kind="stable")
        part, owner, tokens = part[order], owner[order], tokens[order]
        cuts = np.flatnonzero(np.diff(part, prepend=-1))
        rows = []
        for a, b in zip(cuts, np.append(cuts[1:], len(part))):
            inner = np.flatnonzero(np.diff(owner[a:b], prepend=-1))
            who = owner[a:b][inner]
            rows.append((int(part[a]), keys[who].tobytes(), sizes[who].tobytes(), np.diff(inner, append=b - a).astype("<i4").tobytes(), tokens[a:b].tobytes()))
        columns = list(zip(*rows))
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])],
            names=["part", "keys", "sizes", "counts", "tokens"])

    return fn


def _pack(tokens: np.ndarray, dfs: np.ndarray, classes: np.ndarray, sizes: np.ndarray, buckets: int) -> pd.DataFrame:
    """Class segments, one packed row per bucket of classes."""
    bucket = classes % buckets
    order = np.lexsort((classes, bucket))
    tokens, dfs, classes, sizes, bucket = tokens[order], dfs[order], classes[order], sizes[order], bucket[order]
    rows = []
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
    for a, b in zip(cuts, np.append(cuts[1:], len(bucket))):
        inner = np.flatnonzero(np.append(True, classes[a + 1:b] != classes[a:b - 1]))
        rows.append((int(bucket[a]), classes[a:b][inner].tobytes(), sizes[a:b][inner].tobytes(), np.diff(inner, append=b - a).astype("<i4").tobytes(), tokens[a:b].tobytes(), dfs[a:b].astype("<i8").tobytes()))
    return pd.DataFrame(rows, columns=["bucket", "keys", "sizes", "counts", "tokens", "dfs"]).astype({"bucket": "int32"})


def _shared(fragments: int, buckets: int, hot):
    """The shingles of one fragment that two classes or more hold, by class."""

    def fn(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        part = int(key[0])
        keys, sizes, counts = (np.frombuffer(b"".join(frame[c]), t) for c, t in (("keys", np.int64), ("sizes", np.int64), ("counts", "<i4")))
        tokens = np.frombuffer(b"".join(frame["tokens"]), np.uint64)
        segment = np.repeat(np.arange(len(keys), dtype=np.int32), counts)
        if part < fragments:
            order = np.argsort(tokens, kind="stable")
            sort = tokens[order]
            again = np.zeros(len(sort), bool)
            again[1:] = sort[1:] == sort[:-1]
            again[:-1] |= again[1:]
            tokens, segment = sort[again], segment[order[again]]
            del order, sort
        classes = keys[segment]
        order = np.lexsort((classes, tokens))  # a class may come from several tasks
        tokens, classes, sizes = tokens[order], classes[order], sizes[segment[order]]
        new = np.ones(len(tokens), bool)
        new[1:] = (tokens[1:] != tokens[:-1]) | (classes[1:] != classes[:-1])
        tokens, classes, sizes = tokens[new], classes[new], sizes[new]
        if part >= fragments:
            hot_tokens, hot_df = hot.value
            return _pack(tokens, hot_df[np.searchsorted(hot_tokens, tokens)], classes, sizes, buckets)
        starts = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1])) if len(tokens) else np.zeros(0, np.int64)
        times = np.diff(starts, append=len(tokens))
        df = np.repeat(times, times)
        keep = df > 1
        return _pack(tokens[keep], df[keep], classes[keep], sizes[keep], buckets)

    return fn


def _gather(threshold: int):
    """All shared shingles of a bucket's classes, rarest first, of those
    classes that share enough of them; with their mean count."""

    def fn(frame: pd.DataFrame) -> pd.DataFrame:
        read = lambda name, kind: np.frombuffer(b"".join(frame[name]), kind)
        counts = read("counts", "<i4")
        classes, sizes = np.repeat(read("keys", np.int64), counts), np.repeat(read("sizes", np.int64), counts)
        tokens, dfs = read("tokens", np.int64), read("dfs", "<i8")
        order = np.lexsort((tokens, dfs, classes))
        classes, sizes, tokens, dfs = classes[order], sizes[order], tokens[order], dfs[order]
        cuts = np.flatnonzero(np.append(True, classes[1:] != classes[:-1]))
        ends = np.append(cuts[1:], len(classes))
        enough = 100 * (ends - cuts) >= threshold * sizes[cuts]
        cuts, ends = cuts[enough], ends[enough]
        return pd.DataFrame({
            "key": classes[cuts], "tokens": pd.Series([tokens[a:b] for a, b in zip(cuts, ends)], dtype=object),
            "score": [float(dfs[a:b].sum()) / float(sizes[a]) for a, b in zip(cuts, ends)], "n": sizes[cuts], "shared": (ends - cuts).astype(np.int64),
        })

    return fn


# ---- pairs -----------------------------------------------------------------------------

def _may_link(a: str, b: str, threshold: int) -> Column:
    """``rest`` is how many shared shingles a class has from this place of
    the order on; both must reach the least overlap."""
    total = F.col(f"{a}.n") + F.col(f"{b}.n")
    return (100 + threshold) * F.least(f"{a}.rest", f"{b}.rest") >= threshold * total


def _links(pairs: DataFrame, classes: DataFrame, threshold: int) -> DataFrame:
    """Of the pairs (a, b) those that are linked: partial overlaps per
    fragment, summed per pair.  Only classes that are in a pair are cut into
    segments."""
    pairs = cut_lineage(pairs)
    ends = pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct()
    segments = classes.join(ends, "key", "left_semi").select("key", "n", F.explode(F.sequence(F.lit(0), F.lit(COUNT_FRAGMENTS - 1))).alias("fragment"), "tokens")
    segments = segments.select("key", "n", "fragment", F.expr(f"filter(tokens, t -> pmod(t, {COUNT_FRAGMENTS}) = fragment)").alias("tokens")).where("size(tokens) > 0")
    segments = cut_lineage(segments)
    left = segments.select(F.col("key").alias("a"), "fragment", F.col("tokens").alias("ta"), F.col("n").alias("na"))
    right = segments.select(F.col("key").alias("b"), "fragment", F.col("tokens").alias("tb"), F.col("n").alias("nb"))
    partial = (
        pairs.join(left, "a").join(right, ["b", "fragment"])
        .select("a", "b", "na", "nb", F.size(F.array_intersect("ta", "tb")).cast("long").alias("part"))
    )
    return (
        partial.groupBy("a", "b").agg(F.sum("part").alias("overlap"), F.min("na").alias("na"), F.min("nb").alias("nb"))
        .where((100 + threshold) * F.col("overlap") >= threshold * (F.col("na") + F.col("nb")))
        .select("a", "b")
    )


def _pair(a: str, b: str) -> list[Column]:
    return [F.least(F.col(a), F.col(b)).alias("a"), F.greatest(F.col(a), F.col(b)).alias("b")]


def _components(links: DataFrame) -> DataFrame:
    """(key, label) of the classes that have links."""
    ends = links.select(F.col("a").alias("id")).union(links.select(F.col("b").alias("id"))).distinct()
    found = connected_components(ends, links.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    return found.select(F.col("id").alias("key"), F.col("comp").alias("label"))


def class_components(documents: DataFrame, sets: DataFrame, hot_rows: DataFrame, id_col: str, text_col: str, width: int, threshold: int,
                     hot_least: int = HOT_LEAST, fragment: int = FRAGMENT) -> DataFrame:
    """(key, label) of all classes that are linked with another class."""
    spark = documents.sparkSession
    size = sets.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens")).first()
    fragments = max(spark.sparkContext.defaultParallelism, math.ceil(size["tokens"] / fragment))
    # at most HOT times the mean set size, whatever the corpus holds
    frequent = hot_rows.groupBy("token").agg(F.sum("df").alias("df")).where(F.col("df") >= max(hot_least, size["docs"] / HOT)).toPandas().sort_values("token")
    tokens = frequent["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    hot = spark.sparkContext.broadcast((tokens[order], frequent["df"].to_numpy(np.int64)[order]))

    segments = map_slices(id_and_bytes(documents, id_col, text_col), _segments(width, fragments, hot), "part int, keys binary, sizes binary, counts binary, tokens binary")
    buckets = max(spark.sparkContext.defaultParallelism, math.ceil(size["docs"] / BUCKET))
    shared = segments.groupBy("part").applyInPandas(_shared(fragments, buckets, hot), "bucket int, keys binary, sizes binary, counts binary, tokens binary, dfs binary")
    left = cut_lineage(shared.groupBy("bucket").applyInPandas(_gather(threshold), "key long, tokens array<long>, score double, n long, shared long"))

    # prefix: all but the last ceil(threshold * n) shingles, and one more; the unshared ones come first and match nothing
    prefix = F.col("shared") - F.ceil(F.col("n") * F.lit(threshold) / F.lit(100)).cast("long") + 1
    postings = cut_lineage(
        left.select("key", "n", "shared", "score", F.posexplode(F.slice("tokens", F.lit(1), F.greatest(prefix, F.lit(0)).cast("int"))).alias("pos", "token"))
        .select("token", "key", "n", "score", (F.col("shared") - F.col("pos")).alias("rest"))
    )
    leaders = cut_lineage(postings.groupBy("token").agg(F.max(F.struct("score", "key", "n", "rest")).alias("top"), F.count(F.lit(1)).alias("many")).where("many > 1").select("token", "top.*"))
    first = (
        postings.alias("x").join(leaders.alias("l"), "token")
        .where((F.col("x.key") != F.col("l.key")) & _may_link("x", "l", threshold))
        .select(*_pair("x.key", "l.key")).distinct()
    )
    links = cut_lineage(_links(first, left, threshold))
    labels = _components(links)

    # what is left: prefix shingles whose classes lie in two components or more
    member = postings.join(labels, "key", "left").withColumn("label", F.coalesce("label", "key")).drop("score")
    member = cut_lineage(member)
    open_tokens = member.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("token")
    member = cut_lineage(member.join(open_tokens, "token"))
    # a class can link with sets of at most this size, from this place of the order on
    most = F.floor(F.col("rest") * F.lit(100 + threshold) / F.lit(threshold) - F.col("n"))
    groups = cut_lineage(member.groupBy("token", "label").agg(F.count(F.lit(1)).alias("many"), F.min("n").alias("least"), F.max(most).alias("most")))
    x, y = groups.alias("x"), groups.alias("y")
    small_first = (F.col("x.many") < F.col("y.many")) | ((F.col("x.many") == F.col("y.many")) & (F.col("x.label") < F.col("y.label")))
    meet = x.join(y, (F.col("x.token") == F.col("y.token")) & small_first & (F.col("x.least") <= F.col("y.most")) & (F.col("y.least") <= F.col("x.most")))
    meet = meet.select(F.col("x.token").alias("token"), F.col("x.label").alias("label"), F.col("y.label").alias("other"))
    one = member.join(meet, ["token", "label"]).select("token", F.col("other").alias("label"), "key", "n", "rest")
    second = (
        one.alias("x").join(member.alias("y"), ["token", "label"])
        .where(_may_link("x", "y", threshold)).select(*_pair("x.key", "y.key")).distinct()
    )
    more = _links(second, left, threshold)
    both = cut_lineage(links.union(more))
    return _components(both)


def jaccard_components(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, threshold: int = THRESHOLD,
                       hot_least: int = HOT_LEAST, fragment: int = FRAGMENT, with_rows: bool = False) -> DataFrame:
    """(id, n_shingles, component_id) per row of ``documents``; ``with_rows``
    adds row (xxhash64 of the text's bytes, empty for null) and group (a number
    that the rows of a component share, null without shingles), which tell rows
    and components apart also where ids are null or repeat."""
    texts = id_and_bytes(documents, id_col, text_col).select("id", "body", F.xxhash64("body").alias("row"))
    rows = cut_lineage(map_slices(texts, _pass_one(width), "id long, row long, n long, key long, token long, df long"))
    sets, hot_rows = rows.where("key is not null").select("id", "row", "n", "key"), rows.where("token is not null").select("token", "df")
    labels = class_components(documents, sets, hot_rows, id_col, text_col, width, threshold, hot_least, fragment)
    classes = sets.where("n > 0").groupBy("key").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("many"))
    labelled = cut_lineage(classes.join(labels, "key", "left").select("key", "first", "many", F.coalesce("label", "key").alias("label")))
    firsts = labelled.groupBy("label").agg(F.min("first").alias("component_id"), F.sum("many").alias("many"))
    # a class of one document alone has its own id
    named = labelled.select("key", "label").join(firsts.where("many > 1"), "label").select("key", "component_id", "label")
    out = sets.join(cut_lineage(named), "key", "left").select(
        "id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component_id", "id")).otherwise(F.col("id")).alias("component_id"),
        "row", F.when(F.col("n") > 0, F.coalesce("label", "key")).alias("group"))
    return out if with_rows else out.drop("row", "group")
