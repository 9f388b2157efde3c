"""Shared pieces: typed inputs, Arrow batch helpers, a bounded cache.

Every operator takes a table, reads only the columns it is told to read and
returns new columns of its own, so extra columns (also ones that bear the
names of result columns) never clash.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at a time inside one task.
SLICE_BYTES = 4 << 20

#: White space as the contracts use it: space and the control characters 09 to 0D.
ASCII_SPACE = b" \t\n\r\x0b\x0c"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_bytes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id long, body binary): UTF-8 bytes of the text, empty for null."""
    return df.select(
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("body"),
    )


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id long, body string), null texts empty."""
    return df.select(
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"),
    )


def slices(batch: pa.RecordBatch, column: int = 1, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each piece holds about ``limit`` bytes of the
    column (one row at least)."""
    if batch.num_rows == 0:
        return
    col = batch.column(column)
    if col.nbytes <= limit:
        yield batch
        return
    lengths = pc.binary_length(col).to_pylist()
    start = size = 0
    for i, n in enumerate(lengths):
        n = n or 0
        if size and size + n > limit:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    yield batch.slice(start)


_RESIDENT: dict = {}


def resident(key: str, make: Callable[[], object]) -> object:
    """An object that a worker keeps between batches and tasks (a vocabulary,
    an automaton); one at a time, so that workers do not gather them."""
    if key not in _RESIDENT:
        _RESIDENT.clear()
        _RESIDENT[key] = make()
    return _RESIDENT[key]


def map_slices(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str, keep: bool = False, limit: int = SLICE_BYTES) -> DataFrame:
    """``fn`` over bounded slices of the table's Arrow batches; the second
    column is the one whose bytes are bounded.  Without ``keep`` the worker
    gives up what an earlier operator left resident."""

    def run(batches):
        if not keep:
            _RESIDENT.clear()
        for batch in batches:
            for piece in slices(batch, limit=limit):
                yield from fn(piece)

    return df.mapInArrow(run, schema)


class BoundedCache(dict):
    """A dict of about ``limit`` entries at most, so a worker's memory stays
    bounded whatever the corpus holds.  When it is full its entries become
    the old ones; those that are asked for again come back."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit = limit
        self.old: dict = {}

    def room(self, wanted: int) -> None:
        if len(self) + wanted > self.limit:
            self.old = dict(self)
            self.clear()

    def settle(self, wanted: set) -> list:
        """Makes room for ``wanted``; returns what of it has to be made."""
        missing = [x for x in wanted if x not in self]
        if len(self) + len(missing) > self.limit:
            self.room(self.limit)
            missing = list(wanted)
        new = []
        for x in missing:
            value = self.old.get(x)
            if value is None:
                new.append(x)
            else:
                self[x] = value
        return new


_RARE_SPACES = "\t\r\x0b\x0c\x1c-\x1f\x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_TWO_SPACES = re.compile(f"[ \n][ \n]|[{_RARE_SPACES}]")


def chunks(text: str) -> list[str] | None:
    """Cut a text where the byte-level BPE pattern always cuts: before every
    space and line break that stands alone.  The first chunk is as it is, a
    later one that starts with a line break is as it is, any other one lacks
    its leading space.  None if white space stands next to white space (or
    rarer kinds occur): the pattern then looks further than one character."""
    if _TWO_SPACES.search(text):
        return None
    return text.replace("\n", " \n").split(" ")


def whole(chunk: str) -> str:
    """The text that a chunk (not the first) stands for."""
    return chunk if chunk[:1] == "\n" else " " + chunk


def read_ranks(path: str) -> list[tuple[bytes, int]]:
    """(token, rank) of a vocabulary file in tiktoken's form, read on the driver."""
    with open(path, "rb") as lines:
        return [(base64.b64decode(token), int(rank)) for token, rank in (line.split() for line in lines if line.strip())]


#: Rows of one key that a join leaves together.
KEY_ROWS = 1 << 18


def skew_join(left: DataFrame, right: DataFrame, key: str, spread: str, key_rows: int = KEY_ROWS) -> DataFrame:
    """Left join with a ``right`` that holds each key once.  Keys with more
    than ``key_rows`` left rows (at most rows / key_rows of them, so a short
    list) are dealt over copies of their right row, by a hash of ``spread``."""
    counts = left.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > key_rows)
    hot = {r[key]: -(-r["n"] // key_rows) for r in counts.collect() if r[key] is not None}
    if not hot:
        return left.join(right, key, "left")
    copies = F.create_map(*[F.lit(x) for pair in hot.items() for x in pair])
    n = F.coalesce(F.try_element_at(copies, F.col(key)), F.lit(1))
    salted = left.withColumn("__salt", F.pmod(F.xxhash64(spread), n).cast("int"))
    copied = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), n - 1)))
    return salted.join(copied, [key, "__salt"], "left").drop("__salt")
