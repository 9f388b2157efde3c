"""Information-theoretic sanitisation, in DataFrame functions only.

Base spans are e-mail addresses, IP addresses, card numbers and phone numbers
that pass their checks.  Their distinct values are the protected entities.
The corpus tells how much a word discloses of an entity: from the documents
in which both stand in one passage, the pointwise mutual information
``ln(N * n_both / (n_entity * n_word))`` is set against the entity's own
information ``ln(N / n_entity)``.  Where the quotient reaches ``disclosure``
and the two meet in ``support`` documents or more (copies of a line in other
documents count), the word is a term span in every document that holds the
entity.  Entities are generalised to their kind, terms are removed.

A passage is a run of lines: a line break ends it only between two lines that
both end a sentence, so the fields of a signature stay together and sentences
of running text stay apart.  Blank lines do not count.

Words are runs of letters and digits outside base spans, for counting as for
spans.  Word counts cover all documents.  They are summed per task before the
shuffle and joined with the few words that stand beside entities.  Entities in
fewer than ``support`` documents cannot reach it and are left out first.

Definitions.  Null and empty texts have no spans.  Rows come back one to one;
rows with equal ids and texts stay apart.  Positions are code points, end
exclusive.  Terms inside a base span give no span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

KINDS = ["email", "ip", "card", "phone"]
#: Possessive forms of the base patterns; a match begins where a run of its
#: characters begins or where the last match ended, as the leftmost match does.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for the pattern to be worth running.
HINTS = {
    "email": r"[A-Za-z0-9._%+-]@[A-Za-z0-9-]",
    "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]",
    "card": r"[0-9](?:[\x20-]?[0-9]){15}",
    "phone": r"\+[0-9][\x20().0-9-]",
}
WORD = r"[\p{L}\p{N}]++"
#: What a text must hold for any base pattern to match.
ANY_HINT = "|".join(f"(?:{HINTS[k]})" for k in KINDS)
_END = r"[.!?\u2026\u3002\uff01\uff1f\u061f\u0964]"
_CLOSE = r"[\"')\]\u00bb\u2019\u201d]"
#: Line breaks (and blank lines) between two lines that both end a sentence.
PASSAGE = rf"(?<={_END}{_CLOSE}{{0,3}}[ \t\r]{{0,8}})\n\s*+(?=[^\n]*{_END}{_CLOSE}{{0,3}}[ \t\r]{{0,8}}(?:\n|\z))"
BLOCK = 64
#: Stands for a letter or digit of a base span (a private-use character, no letter itself).
MARK = "\ue000"
MARKED_WORD = rf"[\p{{L}}\p{{N}}{MARK}]++"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    def add(total: Column, k: Column) -> Column:
        d = F.substring(digits, -k, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(k % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def is_valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(match, r"\."), lambda p: F.ltrim(p, F.lit("0")))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(F.substring(p, 1, 3).try_cast("int"), F.lit(0)) <= 255))
    digits = _digits(match)
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _valid_span(kind: str):
    return lambda x: is_valid(kind, x["value"])


def _valid_match(kind: str):
    return lambda m: is_valid(kind, m)


def _named(kind: str):
    plain = F.lower if kind in ("email", "ip") else _digits
    return lambda m: F.concat(F.lit(kind + ":"), plain(m))


def _places(x: Column) -> Column:
    return F.struct(x["start"].alias("start"), x["end"].alias("end"))


def _tagged(kind: str):
    tag = F.lit("" if kind == "term" else f"[{kind.upper()}]")
    return lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), tag.alias("tag"))


def _written(kind: str):
    return lambda x: F.concat_ws(":", F.lit(kind), x["start"], x["end"])


def _before(sizes: Column) -> Column:
    """The sum of all earlier entries, per entry; in blocks, so that a text
    with many matches costs little more than one with few."""
    zero = F.lit(0).cast("long")
    plus = lambda a, x: a + x
    n = F.size(sizes)
    blocks = F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int"))
    sums = F.transform(blocks, lambda b: F.aggregate(F.slice(sizes, b * BLOCK + 1, F.lit(BLOCK)), zero, plus))
    heads = F.transform(blocks, lambda b: F.aggregate(F.slice(sums, F.lit(1), b), zero, plus))

    def block(head: Column, b: Column) -> Column:
        own = F.slice(sizes, b * BLOCK + 1, F.lit(BLOCK))
        return F.transform(own, lambda _, k: head + F.aggregate(F.slice(own, F.lit(1), k), zero, plus))

    return F.flatten(F.transform(heads, block))


def with_matches(rows: DataFrame, text: str, pattern: str, name: str, wanted: Column) -> DataFrame:
    """Adds ``name``: the pattern's matches as (value, start, end).  Gaps and
    matches are taken by the same search, their lengths give the places."""
    gap, hit = f"__gap_{name}", f"__hit_{name}"
    rows = rows.withColumn(hit, F.when(wanted, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn(gap, F.when(F.size(hit) > 0, F.split(text, pattern, -1)))
    sizes = F.transform(F.arrays_zip(F.slice(gap, F.lit(1), F.size(hit)).alias("g"), F.col(hit).alias("m")), lambda x: (F.length(x["g"]) + F.length(x["m"])).cast("long"))
    rows = rows.withColumn(f"__size_{name}", F.when(F.size(hit) > 0, sizes))
    rows = rows.withColumn(f"__from_{name}", F.when(F.size(hit) > 0, _before(F.col(f"__size_{name}"))))

    def span(x: Column) -> Column:
        end = x["f"] + x["s"]
        return F.struct(x["m"].alias("value"), (end - F.length(x["m"])).alias("start"), end.alias("end"))

    zipped = F.arrays_zip(F.col(hit).alias("m"), F.col(f"__size_{name}").alias("s"), F.col(f"__from_{name}").alias("f"))
    empty = F.array().cast("array<struct<value:string,start:bigint,end:bigint>>")
    return rows.withColumn(name, F.coalesce(F.when(F.size(hit) > 0, F.transform(zipped, span)), empty)).drop(gap, hit, f"__size_{name}", f"__from_{name}")


def _masked(text: str, kind: str) -> Column:
    """The text with ``MARK`` for every letter and digit inside the kind's
    spans, of the same length.  Marks of the text itself become spaces (they
    are no letters either)."""
    hide = lambda m: F.when(is_valid(kind, m), F.regexp_replace(m, r"[\p{L}\p{N}]", MARK)).otherwise(m)
    gaps = F.transform(F.split(text, PATTERNS[kind], -1), lambda g: F.translate(g, MARK, " "))
    hits = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    return F.array_join(F.zip_with(gaps, hits, lambda g, m: F.concat(g, F.coalesce(hide(m), F.lit("")))), "")


def with_base_spans(rows: DataFrame, text: str = "body") -> DataFrame:
    """Adds one array of (value, start, end) per kind."""
    for kind in KINDS:
        rows = with_matches(rows, text, PATTERNS[kind], kind, F.col(text).rlike(HINTS[kind]))
        rows = rows.withColumn(kind, F.filter(kind, _valid_span(kind)))
    return rows


def _entities(line: Column) -> Column:
    """The protected values in a line, as ``kind:value``."""
    found = []
    for kind in KINDS:
        hits = F.when(line.rlike(HINTS[kind]), F.regexp_extract_all(line, F.lit(PATTERNS[kind]), F.lit(0))).otherwise(F.array().cast("array<string>"))
        found.append(F.transform(F.filter(hits, _valid_match(kind)), _named(kind)))
    return F.array_distinct(F.concat(*found))


def with_free_words(rows: DataFrame, name: str, wanted: Column, text: str = "body") -> DataFrame:
    """Adds ``name``: the words outside base spans as (value, start, end);
    the rows have their base spans.  A text masked by one kind has the same
    words at the same places, so the k-th word overlaps a span of the kind if
    the k-th masked word holds a mark."""
    rows = with_matches(rows, text, WORD, name, wanted)
    for kind in KINDS:
        masked, seen = f"__masked_{kind}", f"__seen_{kind}"
        rows = rows.withColumn(masked, F.when((F.size(name) > 0) & (F.size(kind) > 0), _masked(text, kind)))
        hits = F.when(F.col(masked).isNotNull(), F.regexp_extract_all(masked, F.lit(MARKED_WORD), F.lit(0)))
        rows = rows.withColumn(seen, F.coalesce(hits, F.array().cast("array<string>"))).drop(masked)
    words = F.arrays_zip(F.col(name).alias("w"), *[F.col(f"__seen_{k}").alias(k) for k in KINDS])
    free = lambda x: ~F.greatest(*[F.coalesce(F.contains(x[k], F.lit(MARK)), F.lit(False)) for k in KINDS])
    marked = sum([F.size(f"__seen_{k}") for k in KINDS], F.lit(0)) > 0
    return rows.withColumn(name, F.when(marked, F.transform(F.filter(words, free), lambda x: x["w"])).otherwise(F.col(name))).drop(*[f"__seen_{k}" for k in KINDS])


def _terms(words: Column) -> Column:
    """Distinct lower-case words; lowered one by one, as those of spans are."""
    return F.array_distinct(F.transform(F.array_distinct(words), F.lower))


def document_words(rows: DataFrame) -> DataFrame:
    """(term): the distinct words of every document, places only where a base
    span can be."""
    hint = F.col("body").rlike(ANY_HINT)
    spans = with_free_words(with_base_spans(rows.select("body")), "word", hint)
    return spans.select(F.explode(_terms(F.when(hint, F.col("word")["value"]).otherwise(F.regexp_extract_all("body", F.lit(WORD), F.lit(0))))).alias("term"))


def disclosing_terms(rows: DataFrame, disclosure: float = 0.75, support: int = 3) -> DataFrame:
    """(entity, term) pairs whose mutual information reaches ``disclosure``
    of the entity's information.  ``rows``: (body), one per document."""
    hint = F.col("body").rlike(ANY_HINT)
    # numbered before the explode: in one select with it, each passage would get a number of its own
    numbered = rows.where(hint).select("body", F.monotonically_increasing_id().alias("doc"))
    passages = numbered.select("doc", F.explode(F.split("body", PASSAGE, -1)).alias("body")).where(hint)
    passages = passages.withColumn("entities", _entities(F.col("body"))).where(F.size("entities") > 0)
    words = with_free_words(with_base_spans(passages), "word", F.lit(True))
    # the numbers of documents and passages hold within this table
    beside = cut_lineage(words.select("doc", F.monotonically_increasing_id().alias("passage"), "entities", _terms(F.col("word")["value"]).alias("words")))
    each = beside.select("doc", "passage", F.explode("entities").alias("entity"))
    n_entity = each.groupBy("entity").agg(F.count_distinct("doc").alias("n_entity")).where(F.col("n_entity") >= support)
    known = each.join(n_entity, "entity").groupBy("passage").agg(F.collect_list(F.struct("entity", "n_entity")).alias("known"))
    met = beside.join(known, "passage").select("doc", "words", F.explode("known").alias("e")).select("doc", "e.entity", "e.n_entity", F.explode("words").alias("term"))
    pairs = met.groupBy("entity", "n_entity", "term").agg(F.count_distinct("doc").alias("n_both")).where(F.col("n_both") >= support)
    n_word = document_words(rows).groupBy("term").agg(F.count(F.lit(1)).alias("n_word"))
    total = rows.select(F.count(F.lit(1)).cast("double").alias("n")).scalar()
    shared = F.log(total * F.col("n_both") / (F.col("n_entity").cast("double") * F.col("n_word")))
    own = F.log(total / F.col("n_entity"))
    return pairs.join(n_word, "term").where((own > 0) & (shared >= disclosure * own)).select("entity", "term")


def find_pii(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", disclosure: float = 0.75, support: int = 3, sanitise: bool = True) -> DataFrame:
    """(id, email, ip, card, phone, term[, sanitised]): arrays of (value,
    start, end), and the text with entities generalised and terms removed."""
    base = documents.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"))
    # rows are told apart by id and text, which a lost task makes again alike
    rows = base.withColumn("row", F.xxhash64("id", "body"))
    pairs = disclosing_terms(rows.select("body"), disclosure, support).groupBy("entity").agg(F.collect_list("term").alias("told"))
    holders = rows.where(F.col("body").rlike(ANY_HINT))
    holders = holders.select("row", F.explode(_entities(F.col("body"))).alias("entity")).distinct()
    terms = cut_lineage(holders.join(pairs, "entity").groupBy("row").agg(F.array_distinct(F.flatten(F.collect_list("told"))).alias("terms")))
    spans = with_base_spans(rows).join(terms, "row", "left")
    spans = with_free_words(spans, "term", F.col("terms").isNotNull())
    spans = spans.withColumn("term", F.filter("term", lambda x: F.array_contains("terms", F.lower(x["value"]))))
    out = spans.select("id", *KINDS, "term", *(["body"] if sanitise else []))
    return out.withColumn("sanitised", sanitised(F.col("body"))).drop("body") if sanitise else out


def sanitised(text: Column) -> Column:
    """The text with ``[KIND]`` in place of base spans and without terms;
    of overlapping spans the one that starts first counts."""
    tagged = [F.transform(k, _tagged(k)) for k in [*KINDS, "term"]]
    start = F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at"))

    def step(state: Column, x: Column) -> Column:
        gap = F.substring(text, (state["at"] + 1).cast("int"), (x["start"] - state["at"]).cast("int"))
        return F.when(x["start"] < state["at"], state).otherwise(F.struct(F.concat(state["done"], gap, x["tag"]).alias("done"), x["end"].alias("at")))

    return F.aggregate(F.sort_array(F.concat(*tagged)), start, step, lambda s: F.concat(s["done"], F.substring(text, (s["at"] + 1).cast("int"), F.length(text))))


def span_text(kinds: list[str]) -> Column:
    """``kind:start:end`` of all spans by kind, then start, comma-joined."""
    each = [F.transform(k, _written(k)) for k in kinds]
    return F.array_join(F.concat(*each), ",")
