"""URL filter by host word segmentation and naive Bayes.

Rules name a host (with all its subdomains) and a path prefix; the longest
fitting rule decides.  All other urls are scored: unigram Viterbi splits the
names of the host into words, and multinomial naive Bayes adds up the log
odds of host words and path tokens.

* Unigram counts come from the words of all pages.  Only the substrings of
  host names are joined with them (a word of more than ``KEY_LETTERS`` letters
  by its first ones), so each name brings its own small table to the Viterbi
  step, however large the vocabulary is.  Words may be of any length.
* Naive Bayes learns, for either verdict, from the pages that a rule gives it
  (weighted to be as many for both) and from as many made-up pages of average
  tokens; those for ``block`` hold one of ``seed_words`` besides.  Counts are taken per distinct host and per
  distinct path form first, so a host with a third of all pages is one row.
* The rules' own words (``com``, ``example``, ``de``, ...) are no features: the
  labels are made of them, so a model that sees them only repeats the rules
  where they do not apply, a language code deciding for every host.
* Tokens are runs of letters (digits separate); a token that a path holds
  twice counts twice.

Definitions.  A null url, or one without ``://``, has empty host and path;
with no tokens its score is 0.  A score over 0 blocks.  Rows come back one to
one, repeated ids included; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import map_slices, skew_join

#: (host and path prefix, verdict)
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
#: Words that spam and adult hosts are made of.
SEED_WORDS = ["adult", "ads", "bet", "bets", "casino", "cheap", "farm", "free", "gambling", "loan", "pills", "poker", "porn", "sex", "slots", "spam", "track", "viagra", "win", "xxx"]
#: Letters of a word that the join with the unigrams compares.
KEY_LETTERS = 24
#: First letters of substrings that one row brings to that join.
KEY_STARTS = 1024
#: Longest host or path form that stands for itself beside its tokens.
KEY_LENGTH = 64


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parsed(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """(page_id, host, path, rule, ruled)"""
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    base = pages.select(F.col(id_col).alias("page_id"), url.alias("url"))
    at = F.instr("url", "://")
    rest = F.when(at > 0, F.substring(F.col("url"), at + 3, F.length("url"))).otherwise("")
    base = base.select("page_id", rest.alias("rest"))
    base = base.select("page_id", _lower(F.regexp_extract("rest", "^[^/?#]*", 0)).alias("host"), F.regexp_extract("rest", "^[^/?#]*([^?#]*)", 1).alias("path"))
    rule, ruled = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, verdict in sorted(rules, key=lambda r: len(r[0])):  # the longest comes last and is tried first
        host, slash, path = text.partition("/")
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith(F.col("path"), F.lit(slash + path))
        rule, ruled = F.when(fits, text).otherwise(rule), F.when(fits, verdict).otherwise(ruled)
    return base.select("page_id", "host", "path", rule.alias("rule"), ruled.alias("ruled"))


def unigrams(pages: DataFrame, text_col: str = "html") -> DataFrame:
    """(word, n): words of all pages, tags taken out."""
    plain = F.lower(F.regexp_replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "<[^>]*+>", " "))
    return pages.select(F.explode(F.split(plain, r"[^\p{L}]+", -1)).alias("word")).where(F.length("word") > 0).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def viterbi(name: str, counts: dict[str, int], total: float) -> list[str]:
    """The most likely words that make up the name.  An unknown stretch of n
    letters has probability 10 / (total * 10**n)."""
    lengths = sorted({len(w) for w in counts})
    letter, opening = math.log(10), math.log(total / 10)
    best, back = [0.0], [0]  # by end: the cost, and where the last word starts
    stretch, since = math.inf, 0  # cost and start of the best split that ends in an unknown stretch
    for end in range(1, len(name) + 1):
        anew = best[end - 1] + opening
        stretch, since = (anew + letter, end - 1) if anew < stretch else (stretch + letter, since)
        cost, start = stretch, since
        for n in lengths:
            if n > end:
                break
            seen = counts.get(name[end - n:end])
            if seen and (found := best[end - n] + math.log(total / seen)) <= cost:
                cost, start = found, end - n
        best.append(cost)
        back.append(start)
    words, end = [], len(name)
    while end:
        words.append(name[back[end]:end])
        end = back[end]
    return words[::-1]


def segment_names(names: DataFrame, words: DataFrame) -> DataFrame:
    """(name, words) for a table of distinct names."""
    total = float(words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]) + 10.0
    keyed = names.where(F.length("name") > 0).select("name", F.sha2("name", 256).alias("key"))
    # a long name is cut into rows of bounded size, which do not carry it along
    at = F.explode(F.sequence(F.lit(1), F.length("name"), F.lit(KEY_STARTS)))
    cut = keyed.select("key", "name", at.alias("at")).select("key", F.substring("name", F.col("at"), F.lit(KEY_STARTS + KEY_LETTERS - 1)).alias("part"))
    starts = F.sequence(F.lit(1), F.least(F.lit(KEY_STARTS), F.length("part")))
    cuts = F.flatten(F.transform(starts, lambda a: F.transform(
        F.sequence(F.lit(1), F.least(F.lit(KEY_LETTERS), F.length("part") - a + 1)), lambda k: F.substring(F.col("part"), a, k))))
    parts = cut.select("key", F.explode(F.array_distinct(cuts)).alias("head"))
    known = parts.join(words.withColumn("head", F.substring("word", 1, KEY_LETTERS)), "head").groupBy("key").agg(
        F.collect_set(F.struct("word", "n")).alias("known"))
    ready = keyed.join(known, "key", "left").select("name", F.lit("").alias("pad"), F.col("known.word").alias("known"), F.col("known.n").alias("counts"))

    def fn(batch: pa.RecordBatch):
        found = [viterbi(name, dict(zip(known or (), counts or ())), total) for name, known, counts in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string()))], names=["name", "words"])

    return map_slices(ready, fn, "name string, words array<string>")


def rule_words(rules: list[tuple[str, str]]) -> list[str]:
    """The words that hosts and paths of the rules are made of."""
    return sorted({w for text, _ in rules for w in regex.findall(r"\p{L}+", text.lower())})


def _key(name: str) -> Column:
    """What stands for a host or path form beside each of its tokens: the
    text, or the digest of a long one."""
    return F.when(F.length(name) > KEY_LENGTH, F.sha2(name, 256)).otherwise(F.col(name))


def _tokens(distinct: DataFrame, key: str, names: Column) -> DataFrame:
    return distinct.select(key, F.explode(names).alias("name")).where(F.length("name") > 0)


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", rules: list[tuple[str, str]] = RULES,
                seed_words: list[str] = SEED_WORDS, smoothing: float = 1.0) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) per page."""
    spark = pages.sparkSession
    form = F.array_join(F.filter(F.split(F.lower("path"), r"[^\p{L}]+", -1), lambda w: F.length(w) > 0), " ")
    rows = parsed(pages, id_col, url_col, rules).withColumn("form", form)
    rows = cut_lineage(rows.withColumn("host_key", _key("host")).withColumn("form_key", _key("form")))
    tally = [F.count_if(F.col("ruled") == "allow").alias("allow"), F.count_if(F.col("ruled") == "block").alias("block"), F.count(F.lit(1)).alias("every")]
    hosts, forms = rows.groupBy("host_key", "host").agg(*tally), rows.groupBy("form_key", "form").agg(*tally)
    hosts, forms = cut_lineage(hosts), cut_lineage(forms)

    named = _tokens(hosts, "host_key", F.split("host", r"[^\p{L}]+", -1))
    split = cut_lineage(segment_names(named.select("name").distinct(), unigrams(pages, text_col)))
    host_tokens = cut_lineage(skew_join(named, split, "name", "host_key").select("host_key", F.explode("words").alias("token")))
    form_tokens = _tokens(forms, "form_key", F.split("form", " ")).withColumnRenamed("name", "token")

    pages_of = hosts.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("allow", "block", "every")]).first()
    made_up = float(max(len(seed_words), pages_of["allow"], pages_of["block"]))
    seen = host_tokens.join(hosts.drop("host"), "host_key").select("token", "allow", "block", "every").union(form_tokens.join(forms.drop("form"), "form_key").select("token", "allow", "block", "every"))
    share = {x: F.sum(x) * F.lit(made_up / max(1, pages_of[x])) for x in ("allow", "block", "every")}
    seen = seen.groupBy("token").agg(*[(share[x] + share["every"]).alias(x) for x in ("allow", "block")])
    seeds = spark.createDataFrame([(w, 0.0, made_up / len(seed_words)) for w in seed_words], "token string, allow double, block double")
    counts = cut_lineage(seen.union(seeds).where(~F.col("token").isin(rule_words(rules))).groupBy("token").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")))
    size = counts.agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"), F.count(F.lit(1)).alias("n")).first()
    odds = F.log((F.col("block") + smoothing) / (size["block"] + smoothing * size["n"])) - F.log((F.col("allow") + smoothing) / (size["allow"] + smoothing * size["n"]))
    model = counts.select("token", odds.alias("odds"))
    host_score = skew_join(host_tokens, model, "token", "host_key").groupBy("host_key").agg(F.sum("odds").alias("host_score"))
    form_score = skew_join(form_tokens, model, "token", "form_key").groupBy("form_key").agg(F.sum("odds").alias("form_score"))
    out = skew_join(skew_join(rows.drop("form"), host_score, "host_key", "page_id"), form_score, "form_key", "page_id")
    score = F.coalesce("host_score", F.lit(0.0)) + F.coalesce("form_score", F.lit(0.0))
    verdict = F.coalesce("ruled", F.when(score > 0, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), score.alias("score"))
