"""Every operator on documents against a brute-force version, over rows with
nulls, empty and long texts, ties, repeated rows and clashing column names."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

WS = "\x20\x09\x0a\x0b\x0c\x0d"
CLASHING = ["id", "body", "n_words", "key", "token", "kept", "carried", "gone", "drop_id", "row", "hits", "items", "term", "n_tokens", "p"]


def lower(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def sentence(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    words = [a + b for a in "the of and cat dog éàü 日本 x1".split() for b in ["", "s", "ing", "'s", "er"]]
    long = "\n".join(sentence(rng, 12, words) + "." for _ in range(3000))
    base = [sentence(rng, 120, words) for _ in range(4)]
    near = [b.replace(" ", "  ", 3).replace(b.split()[5], "changed", 1) for b in base]
    shared = "This line of many words stands in a lot of documents."
    rows = [None, "", " \n\t ", "one two", "One  TWO", "a b c d e", long, *base, *base, *near]
    rows += [f"{shared}\nOwn line number {k} of this document here.\n  {shared.upper()} \nshort" for k in range(20)]
    rows += ["mail a.b%c@x-y.example.com,d@e.f@g.h and 10.0.0.255 or 1.2.3.256 or 1.2.3.4.5", "+1 (555) 010-9999 x +49.30.1234567- and ++1-2 4111 1111 1111 1111 4111-1111-1111-1112 12345678901234567890"]
    rows += ["<|endoftext|> it's 12 o'clock\r\n\n  don't stop　now \x1c x ", "🙂é" * 50, "x" * 5000, "word | cell | cell | cell | cell\n" * 9]
    return rows


@pytest.fixture(scope="module")
def rows(texts):
    return [(k * 3 - 5, t) for k, t in enumerate(texts)] + [(4, texts[7]), (4, texts[7]), (None, texts[8])]


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for name in CLASHING:
        df = df.withColumn(name, F.lit(f"extra {name}"))
    return df


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("1 = 0")


def test_line_dedup(docs, rows, empty):
    from couplemap.llm.line_dedup import dedup_lines

    big = 1 << 63
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            key = lower(line.strip(WS))
            if len(key) >= 10:
                holders[key].add(big if i is None else i)
    want = Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders.get(lower(x.strip(WS)), ())) < 2 or min(holders[lower(x.strip(WS))]) == (big if i is None else i)]
        want[i, "\n".join(kept), len(lines), len(lines) - len(kept)] += 1
    got = Counter((r["id"], r["kept"], r["n_lines"], r["n_dropped"]) for r in dedup_lines(docs, carry=docs.columns).collect())
    assert got == want
    assert dedup_lines(empty).collect() == []


def test_line_dedup_hot_key_is_dealt_over_copies(docs, rows, monkeypatch):
    from couplemap.llm import line_dedup

    plain = Counter(tuple(r) for r in line_dedup.dedup_lines(docs).collect())
    monkeypatch.setattr(line_dedup, "PROBES", 4)
    assert Counter(tuple(r) for r in line_dedup.dedup_lines(docs).collect()) == plain


def test_minimal_perfect_hash():
    from couplemap.llm.line_dedup import build_hash, find

    rng = np.random.default_rng(1)
    h1, h2 = rng.integers(-2**62, 2**62, (2, 50_000))
    slots, levels = build_hash(h1, h2)
    assert sorted(slots.tolist()) == list(range(50_000))
    assert (find(h1, h2, levels) == slots).all()
    assert sum(map(len, levels)) < 200_000


def windows_hit(words, items):
    hit, found = set(), set()
    for item, w in items:
        n = min(10, len(w))
        if not n:
            continue
        parts = {tuple(w[k:k + n]) for k in range(len(w) - n + 1)}
        for k in range(len(words) - n + 1):
            if tuple(words[k:k + n]) in parts:
                hit.update(range(k, k + n))
                found.add(item)
    return hit, found


def test_decontaminate(spark, docs, rows, empty, monkeypatch):
    from couplemap.llm import decontaminate as d

    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    first = rows[7][1].split()
    bench = [(1, " ".join(first[20:60])), (1, " ".join(first[20:60])), (2, "one TWO"), (3, None), (4, ""), (5, " ".join(first[58:80])), (6, "cats"), (None, "a b c d e"),
             (7, " ".join(first[30:45] + ["other"] + first[45:70]))]
    items = spark.createDataFrame(bench, "item_id long, text string").withColumn("words", F.lit(1))
    split = [("" if i is None else str(i), word.findall(lower(t or ""))) for i, t in bench]
    want = Counter()
    for i, t in rows:
        words = word.findall(lower(t or ""))
        hit, found = windows_hit(words, split)
        want[i, len(words), len(hit), tuple(sorted(found))] += 1

    def counted(out):
        return Counter((r["id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in out.collect())

    assert counted(d.decontaminate(docs, items, carry=docs.columns)) == want
    monkeypatch.setattr(d, "SHARD_BYTES", 100)  # several shards, and items in pieces
    monkeypatch.setattr(d, "PIECE_WORDS", 12)
    assert counted(d.decontaminate(docs, items)) == want
    assert d.decontaminate(empty, items).collect() == []
    assert counted(d.decontaminate(docs, items.where("1 = 0"))) == Counter((i, len(word.findall(lower(t or ""))), 0, ()) for i, t in rows)


def test_decontaminate_cuts_spans(spark):
    from couplemap.llm.decontaminate import decontaminate

    item = "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10"
    docs = spark.createDataFrame([(1, f"Before é, {item.upper()}! after and so on and on and on and on"), (2, f"x {item} y")], "doc_id long, text string")
    got = {r["id"]: r for r in decontaminate(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got[1]["clean"] == "Before é, ! after and so on and on and on and on" and got[2]["clean"] is None
    assert [tuple(s) for s in got[1]["spans"]] == [(10, 10 + len(item))]


def test_decontaminate_keeps_shards_bounded(spark, docs, rows, monkeypatch):
    """Copies of an item under many ids are one piece; a shard is a job of its
    own, so the plan holds one Python step whatever the number of shards."""
    from couplemap.llm import decontaminate as d

    first = rows[7][1].split()
    bench = [(k, " ".join(first[20:60])) for k in range(50)] + [(100 + k, " ".join(first[k:k + 12])) for k in range(0, 100, 25)]
    items = spark.createDataFrame(bench, "item_id long, text string")
    whole = d.decontaminate(docs, items, carry=["doc_id"])
    monkeypatch.setattr(d, "SHARD_BYTES", 600)
    shards, dealt = d.distinct_shards(d.benchmark_pieces(items, "item_id", "text", 10))
    sizes = [r["n"] for r in dealt.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert shards > 1 and sum(sizes) == 5
    split = d.decontaminate(docs, items, carry=["doc_id"])
    assert split._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert Counter(map(str, split.collect())) == Counter(map(str, whole.collect()))
    assert max(len(r["items"]) for r in split.collect()) > 50


def test_quality(docs, rows, empty):
    from couplemap.llm.quality import judge_quality

    word, want = re.compile("[^\x20\x09-\x0d]+"), Counter()
    for i, t in rows:
        t = t or ""
        w = word.findall(t)
        times = Counter(tuple(w[k:k + 8]) for k in range(len(w) - 7))
        covered = {k + j for k in range(len(w) - 7) if times[tuple(w[k:k + 8])] > 1 for j in range(8)}
        lines = [x for x in t.split("\n") if word.search(x)]
        want[i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)] += 1
    out = judge_quality(docs, carry=docs.columns).collect()
    assert Counter(tuple(r[k] for k in ("id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) for r in out) == want
    assert not any(r["kept"] and r["base_failed"] for r in out)
    assert judge_quality(empty).collect() == []


@pytest.mark.parametrize("line, fault", [
    ("An ordinary sentence, with some words in it.", None), ("", None), ("Ein Satz mit Umlauten: äöü.", None), ("NASA AND ESA", None),
    ("home | news | sport | contact | more", "navigation"), ("of%%% the*** and&&&", "symbols"), ("BUY!! NOW!! TODAY!!", "punctuation"),
    ("the the the of of of", "stutter"), ("THIS IS ALL IN CAPITAL LETTERS", "shouting"), ("Copyright 2020. All rights reserved.", "boilerplate")])
def test_line_rules(line, fault):
    from couplemap.llm.quality import line_fault

    assert line_fault(line.encode()) == fault


def test_quality_removes_lines_first(spark):
    from couplemap.llm.quality import judge_quality

    good = "This sentence has eight words and a full stop."
    good3 = "One line of this text has enough words.\nAnother line has enough words to be of use.\nThe third one ends it and says no more."
    docs = spark.createDataFrame([(1, good3 + "\na | b | c | d"), (2, good + "\n" + "\n".join(f"x{k} | y{k} | z{k} | w{k}" for k in range(20)))], "doc_id long, text string")
    got = {r["id"]: r for r in judge_quality(docs).collect()}
    assert got[1]["kept"] and got[1]["clean"] == good3
    assert not got[2]["kept"]


def jaccard_brute(rows):
    sets, ids = [], []
    for i, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", lower(t or ""))
        sets.append(frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset())
        ids.append(i)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    parent[find(a)] = find(b)
    least = {}
    for k, i in enumerate(ids):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return Counter((i, len(sets[k]), least.get(find(k), i) if sets[k] else i) for k, i in enumerate(ids))


def test_jaccard_join(docs, rows, empty):
    from couplemap.llm.jaccard_join import jaccard_components

    got = jaccard_components(docs)
    assert Counter(tuple(r) for r in got.select("id", "n_shingles", "component_id").collect()) == jaccard_brute(rows)
    assert jaccard_components(empty).collect() == []


def test_jaccard_chains_and_hot_shingles(spark):
    """Groups of variants of one text (near and far), a passage that all
    share, and hot shingles that are dealt by class."""
    from couplemap.llm.jaccard_join import jaccard_components

    rng = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    passage = sentence(rng, 30, words)
    rows = []
    for group in range(3):
        base = sentence(rng, 100, words).split()
        for _ in range(25):
            text = list(base)
            for _ in range(rng.randint(0, 4)):
                text[rng.randrange(100)] = f"v{rng.randrange(10_000)}"
            if rng.random() < 0.5:
                text = text[rng.randint(0, 12):]
            rows.append((len(rows), " ".join(text)))
    rows += [(100 + k, passage + " " + sentence(rng, rng.randint(0, 12), words)) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = jaccard_brute(rows)
    for hot, fragment in ((4096, 1 << 22), (8, 500)):
        got = jaccard_components(docs, hot_least=hot, fragment=fragment)
        assert Counter(tuple(r) for r in got.select("id", "n_shingles", "component_id").collect()) == want


def test_bpe_round_trip(spark, docs, rows, empty):
    import public_tokenizers
    import tiktoken

    from couplemap.llm.bpe import decode_ids, encode_texts, ship_vocabulary
    from couplemap.llm.common import read_ranks

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=dict(read_ranks(path)), special_tokens={})
    shipped = ship_vocabulary(spark, path, public_tokenizers.PATTERN)
    got = decode_ids(encode_texts(docs, shipped), shipped).collect()
    want = Counter((i, np.array(library.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t in rows)
    assert Counter((r["id"], bytes(r["ids"]), bytes(r["decoded"])) for r in got) == want
    assert all(r["n_tokens"] * 4 == len(r["ids"]) for r in got)
    both = encode_texts(docs, shipped, decode=True).select("id", "ids", "decoded").collect()
    assert Counter((r["id"], bytes(r["ids"]), bytes(r["decoded"])) for r in both) == want
    assert encode_texts(empty, shipped).collect() == []


def test_prefix_table_appends_and_edits():
    import public_tokenizers

    from couplemap.llm.bpe import PrefixTable, Vocabulary
    from couplemap.llm.common import read_ranks

    vocabulary = Vocabulary(read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    rng = random.Random(2)
    letters = lambda n: bytes(rng.choice(b"aehinorst ") for _ in range(n))
    for _ in range(200):
        text, new = letters(rng.randint(0, 300)), letters(rng.randint(0, 5))
        a = rng.randint(0, len(text))
        b = rng.randint(a, min(len(text), a + 5))
        table = PrefixTable(vocabulary, text)
        table.edit(a, b, new)
        table.append(b"ing")
        fresh = PrefixTable(vocabulary, text[:a] + new + text[b:] + b"ing")
        assert table.last == fresh.last and table.tokens() == fresh.tokens()
    long = PrefixTable(vocabulary, letters(20_000))
    assert long.edit(100, 101, b"q") < 2_000  # an edit makes only the near entries anew


def test_token_counts(spark, docs, rows, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    from couplemap.llm.token_counts import count_tokens, ship_file

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, shipped = Tokenizer.from_file(path), ship_file(spark, path)
    want = Counter()
    for i, t in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want[i, len((t or "").encode()), n, n > 1024] += 1
    assert Counter(tuple(r) for r in count_tokens(docs, shipped).collect()) == want
    assert count_tokens(empty, shipped).collect() == []


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(t):
    d = lambda m: re.sub("[^0-9]", "", m.group())
    return {
        "email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)],
        "ip": [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))],
        "card": [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(d(m)) <= 19 and luhn(d(m))],
        "phone": [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(d(m)) <= 15],
    }


def test_pii_base_spans(spark, docs, rows, empty):
    from couplemap.llm.pii import KINDS, find_pii

    rng = random.Random(11)
    parts = ["a", "b.c", "@", "x-y", ".", "1", "23", "255", "256", " ", "-", "+", "(", ")", "4111 1111 1111 1111", "+1 (555) 010-9999", "1.2.3.4", "é", "🙂", "\n"]
    more = [(1000 + k, "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))) for k in range(400)]
    more.append((2000, " ".join(f"u{k}@h.org" for k in range(300))))
    table = docs.select("doc_id", "text", "row", "term", "body").union(spark.createDataFrame(more, "doc_id long, text string").selectExpr("doc_id", "text", "1", "2", "3"))
    want = Counter((i, *[tuple(base_spans(t or "")[k]) for k in KINDS]) for i, t in rows + more)
    out = find_pii(table).collect()
    assert Counter((r["id"], *[tuple((s["start"], s["end"]) for s in r[k]) for k in KINDS]) for r in out) == want
    texts = {i: t for i, t in more}
    assert all(s["value"] == texts[r["id"]][s["start"]:s["end"]] for r in out if r["id"] in texts for k in KINDS for s in r[k])
    assert find_pii(empty).collect() == []


def test_pii_terms(spark):
    """A name that only ever stands beside one address is a term there;
    common words, and words met fewer than three times, are not."""
    from couplemap.llm.pii import find_pii

    rows = [(k, f"Note {k}: Zorblatt wrote from z@x.org about item{chr(97 + k)}.\nThe other line is plain.") for k in range(4)]
    rows += [(10 + k, f"Note wrote from about plain line {k}") for k in range(40)]
    got = {r["id"]: r for r in find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k in range(4):
        assert [s["value"] for s in got[k]["term"]] == ["Zorblatt"]
        assert got[k]["sanitised"] == f"Note {k}:  wrote from [EMAIL] about item{chr(97 + k)}.\nThe other line is plain."
    assert all(not got[10 + k]["term"] and got[10 + k]["sanitised"] == rows[4 + k][1] for k in range(40))


def test_pii_terms_counted_by_document(spark):
    """Verbatim lines of other documents count, fields on lines of their own
    meet, words may hold digits; digits of an address are no words."""
    from couplemap.llm.pii import find_pii

    card = "Name: Zorblatt\n\nUser: zb77x\nHost: 10.20.30.40\nEmail: z@x.org"
    rows = [(k, f"Note from the office.\n{card}") for k in range(4)] + [(None, f"Note from the office.\n{card}")]
    rows += [(10 + k, f"Note from the office.\nName, user, host and email of line {k}.") for k in range(60)]
    rows += [(100, "Write to z@x.org or 30 others."), (101, "Zorblatt is 77 today.")]
    got = find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    told = [[s["value"] for s in r["term"]] for r in got]
    assert [t for r, t in zip(got, told) if r["id"] is None or r["id"] < 4] == [["Zorblatt", "zb77x"]] * 5
    assert not any(t for r, t in zip(got, told) if r["id"] is not None and r["id"] >= 10)


def brute_terms(rows, disclosure, support):
    """Term spans per row by plain counting."""
    import math

    def free(text):
        held = [s for spans in base_spans(text).values() for s in spans]
        return [m for m in re.finditer(r"[^\W_]+", text) if not any(a < m.end() and m.start() < b for a, b in held)]

    def entities(text):
        return {(k, text[a:b].lower() if k in ("email", "ip") else re.sub("[^0-9]", "", text[a:b])) for k, spans in base_spans(text).items() for a, b in spans}

    n_entity, n_word, both = Counter(), Counter(), Counter()
    for _, text in rows:
        n_word.update({m.group().lower() for m in free(text)})
        n_entity.update(entities(text))
        met = set()
        for passage in re.split(r"(?<=\.)\n(?=[^\n]*\.(?:\n|$))", text):
            met |= {(e, m.group().lower()) for e in entities(passage) for m in free(passage)}
        both.update(met)
    n = len(rows)
    told = defaultdict(set)
    for (e, w), k in both.items():
        own = math.log(n / n_entity[e])
        if k >= support and own > 0 and math.log(n * k / (n_entity[e] * n_word[w])) >= disclosure * own:
            told[e].add(w)
    return Counter((i, tuple(m.span() for m in free(text) if any(m.group().lower() in told[e] for e in entities(text)))) for i, text in rows)


def test_pii_terms_brute_force(spark):
    from couplemap.llm.pii import find_pii

    rng = random.Random(23)
    people = {f"name{k}": [f"p{k}@x.org", f"10.0.0.{k}", "4111 1111 1111 1111", "+1 555 010 9999"][k % 4] for k in range(12)}
    rows = []
    for k in range(240):
        lines = []
        for _ in range(rng.randint(1, 4)):
            name = rng.choice(list(people))
            value = people[name] if rng.random() < 0.9 else ""
            glue = rng.choice([" ", " ", "é", ", "])
            lines.append(f"{rng.choice(['the', 'a', 'of'])} {name if rng.random() < 0.9 else 'nobody'} {rng.choice('abcdefgh')}{glue}{value}{glue}{rng.choice(['x', 'tail', '\ue000q'])}{rng.choice(['.', ''])}")
        rows.append((k, "\n".join(lines)))
    for disclosure in (0.3, 0.75):
        want = brute_terms(rows, disclosure, 3)
        got = find_pii(spark.createDataFrame(rows, "doc_id long, text string"), disclosure=disclosure).collect()
        assert Counter((r["id"], tuple((s["start"], s["end"]) for s in r["term"])) for r in got) == want
        assert sum(len(spans) * n for (_, spans), n in want.items()) > 20


def test_pii_long_text(spark):
    """Words are set against thousands of spans of one text in linear time."""
    from couplemap.llm.pii import find_pii

    text = " ".join(f"word{i}+ user{i}@host{i}.org\ue000" for i in range(8000))
    (got,) = find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert len(got["email"]) == 8000 and not got["term"]
    assert got["sanitised"] == " ".join(f"word{i}+ [EMAIL]\ue000" for i in range(8000))


def test_toxicity_training_is_bounded(spark, monkeypatch):
    """Repeated documents and labels of an id train once, and ``train_rows``
    bounds the rows that are fitted."""
    from couplemap.llm import toxicity

    rng = random.Random(8)
    docs = [(k, f"{'awful ' if k % 2 else ''}text {rng.randint(0, 9)} copy {c}") for k in range(40) for c in range(5)]
    marks = [(k, 1, k % 2) for k in range(40)] * 3 + [(k, 0, k % 2) for k in range(0, 40, 4)]
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("y", F.lit("extra"))
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int").withColumn("y", F.lit("extra"))
    written = []
    keep = toxicity.cut_lineage
    monkeypatch.setattr(toxicity, "cut_lineage", lambda df: written.append(keep(df)) or written[-1])
    for bound, want in ((10, 10), (1000, 40)):
        written.clear()
        toxicity.train_chain(table, labels, [("quality", 0), ("toxic", 1)], train_rows=bound)
        rows = next(df for df in written if df.columns == ["id", "body", "y"]).collect()
        assert len(rows) == len({r["id"] for r in rows}) == want
        assert all(list(r["y"]) == [0, r["id"] % 2] for r in rows)


def test_toxicity_chain_brute_force():
    """The chain against a dense version of the same steps: later models see
    the earlier probabilities of models that did not train on the row."""
    from couplemap.llm.toxicity import FOLDS, fit_chain, predict

    rng = np.random.default_rng(3)
    n, size = 120, 12
    x = (rng.random((n, size)) < 0.3).astype(float)
    style = rng.random((n, 2))
    first = (x[:, 0] + 0.3 * rng.random(n) > 0.6).astype(float)
    labels = np.column_stack([first, (x[:, 1] + first + 0.4 * rng.random(n) > 1.2)]).astype(float)
    fold = np.arange(n) % FOLDS

    def dense_fit(inputs, label):
        w = np.zeros(inputs.shape[1] + 1)
        a = np.column_stack([inputs, np.ones(len(inputs))])
        w[-1] = np.log(label.mean() / (1 - label.mean()))
        m = v = 0
        for t in range(1, 301):
            g = a.T @ (1 / (1 + np.exp(-a @ w)) - label) / len(label)
            g[:-1] += 1e-4 * w[:-1]
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - 0.05 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        return w

    def dense_predict(w, inputs):
        return 1 / (1 + np.exp(-(inputs @ w[:-1] + w[-1])))

    rows = [np.flatnonzero(r).tolist() for r in x]
    chain = fit_chain(rows, style, labels, fold, size)
    extra, seen = style, style
    for c, part in enumerate(chain):
        inputs = np.column_stack([x, extra])
        want = dense_predict(dense_fit(inputs, labels[:, c]), np.column_stack([x, seen]))
        got = predict((part["w"], np.array(part["v"]), part["bias"]), rows, seen)
        assert np.allclose(got, want, atol=1e-6)
        held = np.zeros(n)
        for k in range(FOLDS):
            out = fold == k
            held[out] = dense_predict(dense_fit(inputs[~out], labels[~out, c]), inputs[out])
        extra, seen = np.column_stack([extra, held]), np.column_stack([seen, want])


def test_toxicity_held_out(spark, docs, empty):
    from couplemap.llm.toxicity import score_chain, train_chain

    rng = random.Random(5)
    words = [a + b for a in "tion ing er es the of re on an le ver sch".split() for b in "a e i o u ta ne ro".split()]
    bad = ["scumbag", "trashy", "loserly"]
    rows, labels = [], []
    for k in range(900):
        toxic, junk = rng.random() < 0.2, rng.random() < 0.2
        text = sentence(rng, rng.randint(20, 120), words).split()
        if toxic:
            text.insert(rng.randrange(len(text)), rng.choice(bad))
        if junk:
            text = [w + "###" for w in text]
        rows.append((k, " ".join(text)))
        if k % 3 or k % 2 == 0 and k < 60:
            labels.append((k, 0 if junk else 1, int(toxic)))
        truth = rows[-1] + (toxic, junk)
        rows[-1] = truth
    table = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").withColumn("p", F.lit(1)).withColumn("y0", F.lit(1))
    marks = spark.createDataFrame(labels + [(None, 1, 1), (5, None, 1)], "doc_id long, quality int, toxic int")
    model = train_chain(table, marks, [("quality", 0), ("toxic", 1)])
    got = {r["id"]: r["positive"] for r in score_chain(table, model).collect()}
    known = {r[0] for r in labels}
    held = [r for r in rows if r[0] not in known]
    assert len(held) > 200
    assert sum(got[i] == [junk, toxic] for i, _, toxic, junk in held) / len(held) > 0.97
    assert score_chain(empty, model).collect() == []
    assert len(score_chain(docs, model).collect()) == docs.count()
    none = train_chain(table, marks.where("1 = 0"), [("quality", 0), ("toxic", 1)])
    assert {tuple(r["p"]) for r in score_chain(table.limit(3), none).collect()} == {(0.0, 0.0)}
