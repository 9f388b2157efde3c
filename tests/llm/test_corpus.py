"""Merkle manifest, license scan and collocations against brute-force versions,
over nulls, empty and long texts, ties, repeated rows and clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from couplemap.llm.collocations import collocations, phrase_counts
from couplemap.llm.licenses import BASE_PHRASES, TEMPLATES, label_text, rare_postings, scan_licenses, words_of
from couplemap.llm.merkle import fold, leaf, merkle_manifest, proof_digest

CLASHING = ["id", "grp", "block", "tree", "rank", "h", "w", "base", "found", "codes", "n", "phrase", "body", "w1"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def lower(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


def frame(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for name in CLASHING:
        df = df.withColumn(name, F.lit(f"extra {name}"))
    return df


# ---- manifest ----------------------------------------------------------------------------

def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H("".join(out[-1][i:i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def brute_manifest(rows):
    by = defaultdict(list)
    for r in rows:
        claim = list(r)
        if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
            claim[4] = lower(r[4])
        by[r[1]].append(((r[0] is not None, r[0] or 0), H("".join(map(field, r))), H("".join(map(field, claim))), r[0]))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([x[1] for x in sorted(by[s])]) for s in sources}
    top, out = levels([trees[s][-1][0] for s in sources]), []
    for k, s in enumerate(sources):
        for i, (_, own, value, doc) in enumerate(sorted(by[s])):
            proof = ""
            for tree, j in ((trees[s], i), (top, k)):
                for level in tree[:-1]:
                    at = j // 16 * 16
                    left, right = "".join(level[at:j]), "".join(level[j + 1:at + 16])
                    proof, value, j = proof + left + right, H(left + value + right), j // 16
            out.append((doc, own, trees[s][-1][0], top[-1][0], H(proof), value, value == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("n, sources", [(1, 1), (17, 17), (700, 2), (5000, 40)])
def test_manifest(spark, n, sources):
    rng = random.Random(n)
    names = [None, "", *(f"s{j}é" for j in range(sources))]
    rows = [(None if rng.random() < 0.01 else i, rng.choice(names if i % 3 else names[:1]), rng.choice([None, "en"]), None if i % 7 == 0 else i,
             rng.choice([None, "", f"Abc Äö {i}", "X" * 50_000 if i == 5 else "same"])) for i in range(n)]
    rows += rows[:2]  # repeated rows
    df = frame(spark, rows)
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    low = leaf(*columns[:4], F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    claim = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, low)
    out = merkle_manifest(df, "doc_id", "source", leaf(*columns), claim=claim)
    out = out.select("*", proof_digest(F.col("steps")).alias("proof"), fold(F.coalesce("claim", "leaf"), F.col("steps")).alias("folded"))
    got = sorted(((r.id, r.leaf, r.subroot, r.root, r.proof, r.folded, r.folded == r.root) for r in out.collect()), key=str)
    assert got == brute_manifest(rows)


def test_manifest_empty(spark):
    out = merkle_manifest(frame(spark, [(1, None, None, None, None)]).where("1 = 0"), "doc_id", "source", leaf(F.col("text")))
    assert out.count() == 0 and out.columns == ["id", "group", "leaf", "claim", "subroot", "root", "steps"]


# ---- licenses ------------------------------------------------------------------------------

def brute_licenses(rows):
    split = [words_of(r[4] or "") for r in rows]
    frequencies = Counter(w for words in split for w in set(words))
    out = []
    for r, words in zip(rows, split):
        base = [(i, label) for phrase, label in BASE_PHRASES for i in range(len(words)) if words[i:i + len(phrase.split())] == phrase.split()]
        joined, found = f" {' '.join(words)} ", []
        for label, notice, must in TEMPLATES:
            listed = words_of(notice)
            rare = sorted(set(listed), key=lambda w: (frequencies[w], w))[:8]
            places = [p for p, w in enumerate(listed) if w in rare]
            for offset in range(-len(listed), len(words)):
                same = lambda p: 0 <= offset + p < len(words) and words[offset + p] == listed[p]  # noqa: B023, E731
                if sum(map(same, places)) >= max(2, math.ceil(len(places) / 2)) and all(f" {p} " in joined for p in must):
                    found.append((label, offset, sum(map(same, range(len(listed)))) / len(listed)))
        out.append((r[0], len(words), sorted(base), sorted(found), max((x[2] for x in found), default=0.5 if base else 0.0)))
    return sorted(out, key=str)


def test_licenses(spark):
    rng = random.Random(3)
    noise = "the of and to license public this is software a in any work gnu mit apache 2 0 cc".split()
    rows = [(k, None, None, None, " ".join(rng.choice(noise) for _ in range(60))) for k in range(40)]
    for k, (_, notice, _) in enumerate(TEMPLATES):
        rows.append((100 + k, None, None, None, f"Some words first.\n * {notice.replace(', ', ',' + chr(10) + ' * ')}. The rest"))
        rows.append((200 + k, None, None, None, notice[: len(notice) // 2]))  # cut off
        rows.append((300 + k, None, None, None, re.sub(r" of | in ", " OF the ", notice)))  # edited
    rows += [(1, None, None, None, None), (2, None, None, None, ""), (None, None, None, None, "MIT License"), rows[60], rows[60]]
    rows.append((9, None, None, None, "General  Public-License mit_license MIT/License " * 3000 + " ".join(t[1] for t in TEMPLATES)))
    out = scan_licenses(frame(spark, rows)).collect()
    got = sorted(((r.id, r.n_words, sorted((b.place, b.label) for b in r.base), sorted((f.label, f.place, f.share) for f in r.found), r.score) for r in out), key=str)
    want = brute_licenses(rows)
    assert got == want
    assert {label for row in want for label, _, _ in row[3]} == {t[0] for t in TEMPLATES}


def test_licenses_empty(spark):
    df = frame(spark, [(1, None, None, None, "The MIT License, mit license")])
    assert scan_licenses(df.where("1 = 0")).count() == 0
    row = scan_licenses(df).select(label_text(F.transform("base", lambda x: x["label"])).alias("labels"), "n_words").first()
    assert (row.labels, row.n_words) == ("mit", 5)


def test_rare_postings_are_bounded():
    postings, needed = rare_postings({})
    assert len(needed) == len(TEMPLATES) and all(n >= 2 for n in needed)
    assert len(postings) <= 8 * len(TEMPLATES)


# ---- collocations ------------------------------------------------------------------------------

def brute_counts(rows):
    counts, totals = Counter(), Counter()
    for r in rows:
        lang = "und" if r[2] is None else r[2]
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(r[4] or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, 6):
                counts.update((lang, tuple(words[i:i + k])) for i in range(len(words) - k + 1))
    return counts, totals


def brute_collocations(rows, least, top):
    counts, totals = brute_counts(rows)
    candidates = {p: f for p, f in counts.items() if len(p[1]) > 1 and f >= least}
    out = defaultdict(list)
    for (lang, words), a in candidates.items():
        score, _, left, right = min((1000 * a * totals[lang] // (counts[lang, words[:k]] * counts[lang, words[k:]]), k, counts[lang, words[:k]], counts[lang, words[k:]])
                                    for k in range(1, len(words)))
        inside = any(l == lang and len(o) > len(words) and f >= a and any(o[i:i + len(words)] == words for i in range(len(o) - len(words) + 1))
                     for (l, o), f in candidates.items())
        if not inside:
            out[lang].append((-score, -a, " ".join(words).encode(), left, right))
    return sorted((lang, k + 1, p.decode(), -a, left, right, totals[lang], -score)
                  for lang, found in out.items() for k, (score, a, p, left, right) in enumerate(sorted(found)[:top]))


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(11)
    words = "the of and Cat dog é日本 x-1 don't \x0b new york city \xa0 NEW".split(" ")
    rows = [(k, None, rng.choice([None, "en", "und", "de"]), None, " ".join(rng.choice(words) + rng.choice(["", "", "", ".", ",\n", "\t", " ", "!?"]) for _ in range(80)))
            for k in range(150)]
    rows += [(k, None, "en", None, "in New York City, in new york city; once upon a time there was") for k in range(30)]
    rows += [(1, None, "fr", None, None), (2, None, None, None, ""), (3, None, "", None, "a a a a a a a a a a a a"), (3, None, "", None, "a a a a a a a a a a a a")]
    rows.append((4, None, "long", None, "very long text of words " * 20_000))
    return rows


@pytest.mark.parametrize("least, top", [(20, 2000), (5, 7)])
def test_collocations(spark, prose, least, top):
    out = collocations(frame(spark, prose), least=least, top=top)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in out.collect()) == brute_collocations(prose, least, top)


def test_collocation_counts_do_not_rest_on_the_bitmap(spark, prose):
    counts, totals = brute_counts(prose)
    want = {(lang, len(w), " ".join(w), f) for (lang, w), f in counts.items() if f >= 10} | {(lang, 0, "", n) for lang, n in totals.items() if n}
    for bits in (12, 27):  # nearly every pair meets a set bit; hardly any by chance
        got = phrase_counts(frame(spark, prose), least=10, bits=bits).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_collocations_empty(spark, prose):
    assert collocations(frame(spark, prose).where("1 = 0")).count() == 0


# ---- tokenizers over every code point ---------------------------------------------------------

@pytest.fixture(scope="module")
def code_points(spark):
    """Every code point, in runs and between letters, digits and spaces."""
    points = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    texts = []
    for k in range(0, len(points), 512):
        run = points[k:k + 512]
        texts += ["".join(run), "".join(f"a{c}1 {c}" for c in run)]
    return texts, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)


def test_bpe_of_every_code_point(spark, code_points):
    import numpy as np
    import public_tokenizers
    import tiktoken

    from couplemap.llm.bpe import encode_texts, ship_vocabulary
    from couplemap.llm.common import read_ranks

    texts, df = code_points
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=dict(read_ranks(path)), special_tokens={})
    out = encode_texts(df, ship_vocabulary(spark, path, public_tokenizers.PATTERN), decode=True)
    got = {r.id: (bytes(r.ids), bytes(r.decoded)) for r in out.select("id", "ids", "decoded").collect()}
    for k, t in enumerate(texts):
        assert got[k] == (np.array(library.encode_ordinary(t), "<u4").tobytes(), t.encode())


def test_token_counts_of_every_code_point(spark, code_points):
    import public_tokenizers
    from tokenizers import Tokenizer

    from couplemap.llm.token_counts import count_tokens, ship_file

    texts, df = code_points
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = {r.id: r.n_tokens for r in count_tokens(df, ship_file(spark, path)).collect()}
    assert got == {k: len(library.encode(t, add_special_tokens=False).ids) for k, t in enumerate(texts)}
