"""From source text to words: identifiers, snake/camel split, lower, stem."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import porter

IDENT_RE = r"[\p{L}_][\p{L}\p{N}_]*"
# Fixed value of the reference: camelCase boundaries (lower->Upper, and before
# the last capital of an acronym followed by a lower-case letter).
CAMEL_RE = r".+?(?:(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|$)"


def identifiers(text: Column) -> Column:
    """Regex mode: every run of letters (of any script), digits and underscores
    that does not start with a digit, in text order."""
    return F.regexp_extract_all(text, F.lit(IDENT_RE), 0)


def split_identifier(word: Column) -> Column:
    """snake_case split on '_', then camelCase split of each piece; empty
    pieces vanish (``__init__`` -> [init]).  The look-around pattern only
    runs on words that hold an underscore or a capital after a letter."""
    pieces = F.split(word, "_")
    camel = F.transform(pieces, lambda p: F.regexp_extract_all(p, F.lit(CAMEL_RE), 0))
    split = F.filter(F.flatten(camel), lambda x: F.length(x) > 0)
    return F.when(word.rlike("_|[A-Za-z][A-Z]|^$"), split).otherwise(F.array(word))


def lower_words(words: Column) -> Column:
    return F.transform(words, lambda x: F.lower(x))


def stem_words(tokens: DataFrame, col: str = "word") -> DataFrame:
    """Porter stems, computed once per distinct word and joined back (the
    vocabulary is far smaller than the token stream)."""
    voc = tokens.select(F.col(col).alias("__w")).distinct()
    stems = porter.stem_frame(voc, "__w", "__s")
    return tokens.join(stems, tokens[col] == stems["__w"]).drop(col, "__w").withColumnRenamed("__s", col)


def tokens_from_sources(sources: DataFrame, stem: bool = True, mode: str = "regex") -> DataFrame:
    """sources(path, text) -> tokens(path, ipos, ppos, word): identifiers, split,
    lower-cased, optionally stemmed.  ``mode`` "regex" takes every run of
    letters, "ast" parses Python (see ``python_identifiers``).  Files with no
    identifier keep no rows (they still count as parsed files for idf)."""
    if mode == "ast":
        ids = python_identifiers(sources).where(F.col("parsed") & F.col("ident").isNotNull()) \
            .select("path", "ipos", "ident")
    elif mode == "regex":
        ids = sources.select("path", F.posexplode(identifiers(F.col("text"))).alias("ipos", "ident"))
    else:
        raise ValueError(f"unknown identifier mode {mode!r}")
    parts = ids.select("path", "ipos", F.posexplode(split_identifier(F.col("ident"))).alias("ppos", "word"))
    toks = parts.select("path", "ipos", "ppos", F.lower("word").alias("word"))
    if stem:
        toks = stem_words(toks)
    return toks.select("path", "ipos", "ppos", "word")


def identifier_counts(sources: DataFrame, mode: str = "regex") -> DataFrame:
    """(path, ident, cnt): how often each file holds each identifier.

    In regex mode the texts cross the shuffle, once, dealt by path; what is
    counted by path behind them (here and in ``word_counts``) needs no further
    shuffle.  The number of partitions is given, so that they are not put
    together by the size of the texts, of which the counts are a multiple."""
    if mode == "ast":
        ids = python_identifiers(sources).where(F.col("parsed") & F.col("ident").isNotNull()).select("path", "ident")
    elif mode == "regex":
        parts = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = sources.select("path", "text").repartition(parts, "path")
        ids = dealt.select("path", F.explode(identifiers(F.col("text"))).alias("ident"))
    else:
        raise ValueError(f"unknown identifier mode {mode!r}")
    return ids.groupBy("path", "ident").agg(F.count(F.lit(1)).alias("cnt"))


def identifier_dictionary(idents: DataFrame, stem: bool = True) -> DataFrame:
    """(ident, word, times): the words of every distinct identifier, each
    split, lower-cased and stemmed once."""
    words = idents.select("ident").distinct().select("ident", F.explode(lower_words(split_identifier(F.col("ident")))).alias("word"))
    if stem:
        words = stem_words(words)
    return words.groupBy("ident", "word").agg(F.count(F.lit(1)).alias("times"))


def word_counts(sources: DataFrame, stem: bool = True, mode: str = "regex") -> DataFrame:
    """(path, word, cnt).  Without stems the identifiers of a file are split
    where they were counted; with stems they take the way over the identifier
    dictionary, so that each one is stemmed once."""
    counts = identifier_counts(sources, mode)
    if stem:
        counts = cut_lineage(counts)
        rows = counts.join(identifier_dictionary(counts), "ident").select("path", "word", (F.col("cnt") * F.col("times")).alias("cnt"))
    else:
        rows = counts.select("path", F.explode(lower_words(split_identifier(F.col("ident")))).alias("word"), "cnt")
    return rows.groupBy("path", "word").agg(F.sum("cnt").alias("cnt"))


def parsed_sources(sources: DataFrame, mode: str = "regex") -> DataFrame:
    """The files that count for idf: all of them in regex mode, the ones
    that parse in ast mode."""
    if mode == "ast":
        return python_identifiers(sources).where("parsed").select("path").distinct()
    return sources.select("path").distinct()


def unparsable_sources(sources: DataFrame) -> DataFrame:
    """Paths of the Python sources that do not parse (left out of the corpus)."""
    return python_identifiers(sources).where(~F.col("parsed")).select("path").distinct()


def names_of(root) -> list[str]:
    """Identifiers of a syntax tree in the order of ``ast.walk`` (breadth
    first), without visiting the contexts below names, which hold none."""
    import ast

    found, nodes = [], [root]
    for node in nodes:  # the list grows while it is read
        kind = type(node)
        if kind is ast.Name:
            found.append(node.id)
            continue
        if kind is ast.FunctionDef or kind is ast.ClassDef:
            found.append(node.name)
        for field in kind._fields:
            value = getattr(node, field, None)
            if isinstance(value, list):
                nodes.extend([x for x in value if isinstance(x, ast.AST)])
            elif isinstance(value, ast.AST):
                nodes.append(value)
    return found


def python_identifiers(sources: DataFrame, seen: Observation | None = None) -> DataFrame:
    """AST mode for Python sources: ``Name`` ids plus function and class
    names (not async defs), in ``ast.walk`` order.  A file that does not
    parse gives one row with ``parsed`` false (the reference skips it and
    prints its name; here it stays queryable, see ``unparsable_sources``).

    ``seen`` counts n_unparsed on the same pass.

    Output (path, parsed, ipos, ident); a parsed file without identifiers
    has one row with ipos -1 and NULL ident so that it still counts for idf."""
    import ast

    def run(batches):
        for pdf in batches:
            out_path, out_ok, out_pos, out_id = [], [], [], []
            for path, text in zip(pdf["path"], pdf["text"]):
                try:
                    root = ast.parse(text or "")
                except (SyntaxError, ValueError):
                    out_path.append(path); out_ok.append(False); out_pos.append(-1); out_id.append(None)
                    continue
                found = names_of(root)
                if not found:
                    out_path.append(path); out_ok.append(True); out_pos.append(-1); out_id.append(None)
                out_path.extend([path] * len(found)); out_ok.extend([True] * len(found))
                out_pos.extend(range(len(found))); out_id.extend(found)
            if not out_path:
                continue
            yield pd.DataFrame({"path": out_path, "parsed": out_ok,
                                "ipos": np.array(out_pos, dtype=np.int64), "ident": out_id})

    found = sources.select("path", "text").mapInPandas(run, schema="path string, parsed boolean, ipos long, ident string")
    return found if seen is None else found.observe(seen, F.count_if(~F.col("parsed")).alias("n_unparsed"))
