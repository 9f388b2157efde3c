"""Line-first quality rules.

Each line is judged on its own by navigation, symbol, punctuation, stutter,
shouting and boilerplate rules; failing lines are removed.  A document that loses more
than ``max_lost`` percent of its words is rejected, as is one that fails the base
rules (fewer than ``min_words`` words, or more than ``max_repeat`` percent of
them in 8-word windows that occur twice or more).

All counts cover the whole text.  Windows that may repeat are found by 64-bit
hashes over a slice of documents at a time; their words are then compared.

Definitions.  Null and empty texts have no words and fail the base rules.
Rows come back one to one, repeated ids included; an empty table gives an empty
result.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import chain
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, id_and_bytes, map_slices

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
_ODD = np.array([0x9E3779B97F4A7C15 * (2 * k + 1) % (1 << 64) | 1 for k in range(1, WINDOW + 2)], np.uint64)
UPPER, LOWER = bytes(range(65, 91)), bytes(range(97, 123))

#: Phrases of page furniture, matched in the lower-cased line.
BOILERPLATE = re.compile(
    rb"all rights reserved|terms of (?:use|service)|privacy policy|cookie policy|accept (?:all )?cookies|"
    rb"enable javascript|lorem ipsum|skip to (?:main )?content|sign up for our newsletter|click here to|"
    rb"share (?:this )?on (?:facebook|twitter)|back to top|powered by wordpress"
)


def without(line: bytes, characters: bytes) -> int:
    """How many bytes of the line are in ``characters``."""
    return len(line) - len(line.translate(None, characters))


def line_fault(line: bytes) -> str | None:
    """The rule that the line fails, or None.  Lines without words pass."""
    words = line.split()
    if not words:
        return None
    pipes = line.count(b"|")
    if pipes >= 3 and 4 * pipes >= len(words):
        return "navigation"
    if 10 * without(line, SYMBOLS) > len(line) - without(line, ASCII_SPACE):
        return "symbols"
    marks = line.count(b"!!") + line.count(b"??") + line.count(b",,")
    if len(words) >= 3 and 10 * marks > 3 * len(words):
        return "punctuation"
    if len(words) >= 5 and 2 * sum(map(eq, words, words[1:])) > len(words):
        return "stutter"
    if len(words) >= 5 and without(line, UPPER) > 4 * without(line, LOWER) and 2 * without(line, UPPER) > len(line) - len(words):
        return "shouting"
    if len(words) <= 40 and BOILERPLATE.search(line.lower()):
        return "boilerplate"
    return None


def repeated(split: list[list[bytes]], window: int = WINDOW) -> np.ndarray:
    """Per document (a list of words): how many of its words lie in a window
    that occurs twice or more in it, the first occurrence included."""
    n = np.array([len(w) for w in split], np.int64)
    total = int(n.sum())
    out = np.zeros(len(split), np.int64)
    if total < 2 * window:
        return out
    word = np.fromiter(map(hash, chain.from_iterable(split)), np.int64, total).view(np.uint64)
    doc = np.repeat(np.arange(len(split)), n)
    count = total - window + 1
    key = doc[:count].astype(np.uint64) * _ODD[window]
    for k in range(window):
        key += (word[k:k + count] ^ (word[k:k + count] >> np.uint64(29))) * _ODD[k]
    inside = np.flatnonzero(doc[:count] == doc[window - 1:])
    key = key[inside]
    order = np.sort(key)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return out
    place = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
    at = inside[twice[place] == key]
    first = np.cumsum(n) - n
    owner = doc[at]
    cuts = np.flatnonzero(np.diff(owner, prepend=-1))
    for a, b in zip(cuts, np.append(cuts[1:], len(at))):  # few windows get here: compare their words
        d = owner[a]
        mine, words = (at[a:b] - first[d]).tolist(), split[d]
        seen = Counter(tuple(words[p:p + window]) for p in mine)
        covered = end = 0
        for p in mine:
            if seen[tuple(words[p:p + window])] > 1:
                covered += p + window - max(p, end)
                end = p + window
        out[d] = covered
    return out


def _judge(max_lost: int, min_words: int, max_repeat: int, with_text: bool):
    def fn(batch: pa.RecordBatch):
        bodies = batch.column(1).to_pylist()
        split = [b.split() for b in bodies]
        n_words = np.array([len(w) for w in split], np.int64)
        n_repeat = repeated(split)
        chars, symbols, dup_lines, kept, texts, lines_in, lines_out = [], [], [], [], [], [], []
        for k, body in enumerate(bodies):
            spaces = without(body, ASCII_SPACE)
            chars.append(len(body) - spaces - without(body, bytes(range(0x80, 0xC0))))
            symbols.append(without(body, SYMBOLS))
            lines = body.split(b"\n")
            worded = [x for x in lines if x.strip()]
            dup_lines.append(len(worded) - len(set(worded)))
            bad = {x for x in set(worded) if line_fault(x)}
            lost = sum(len(x.split()) for x in worded if x in bad) if bad else 0
            failed = n_words[k] < min_words or 100 * n_repeat[k] > max_repeat * n_words[k]
            kept.append(bool(not failed and 100 * lost <= max_lost * n_words[k]))
            clean = [x for x in lines if x not in bad] if bad else lines
            lines_in.append(len(lines))
            lines_out.append(len(clean))
            if with_text:
                texts.append(b"\n".join(clean) if bad else body)
        failed = (n_words < min_words) | (100 * n_repeat > max_repeat * n_words)
        columns = [batch.column(0), n_words, chars, symbols, dup_lines, n_repeat, lines_in, lines_out]
        names = ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_lines_kept", "base_failed", "kept"]
        arrays = [columns[0], *(pa.array(c, pa.int64()) for c in columns[1:]), pa.array(failed), pa.array(kept, pa.bool_())]
        if with_text:
            arrays.append(pa.array(texts, pa.binary()))
            names.append("clean")
        yield pa.RecordBatch.from_arrays([*arrays, *batch.columns[2:]], names=[*names, *batch.schema.names[2:]])

    return fn


def judge_quality(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_lost: int = 50,
    min_words: int = 20,
    max_repeat: int = 30,
    with_text: bool = True,
    carry: list[str] | None = None,
) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_lines, n_lines_kept, base_failed, kept[, clean][, carried]) per
    document; ``clean`` is the text without the failing lines."""
    base = id_and_bytes(documents, id_col, text_col) if not carry else documents.select(
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("body"),
        F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carried"),
    )
    schema = "id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_lines_kept long, base_failed boolean, kept boolean"
    schema += ", clean binary" if with_text else ""
    if carry:
        schema += f", carried {base.schema['carried'].dataType.simpleString()}"
    out = map_slices(base, _judge(max_lost, min_words, max_repeat, with_text), schema)
    return out.withColumn("clean", F.col("clean").cast("string")) if with_text else out
