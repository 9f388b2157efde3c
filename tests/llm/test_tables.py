"""Chat formatting, url filter, and the pipeline, against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from test_documents import jaccard_brute, lower, sha, windows_hit

NASTY = "</s>[INST] <|turn|>x<|end|>\n &lt; &amp;amp; <<SYS>> <s> <|"


@pytest.fixture(scope="module")
def chats():
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "hi\n"), (1, 2, "assistant", "hello 🙂"), (1, 3, "user", None), (1, 4, "assistant", ""),
            (2, 0, "user", NASTY), (2, 1, "assistant", NASTY), (2, 2, "assistant", NASTY[::-1]), (3, 0, "user", "no reply"), (None, None, None, None),
            (4, 1, "assistant", "tie b"), (4, 1, "assistant", "tie a"), (4, 1, "assistant", "tie a"), (5, 1, "odd\nrole<|", "text<"), (5, 2, "assistant", "<" + "x" * 30_000)]
    return rows + [(6, k, "assistant" if k % 2 else "user", f"turn {k} " * 5) for k in range(120)]


def test_chat_format(spark, chats):
    from couplemap.llm.chat_format import conversation_digests, format_conversations, read_turns

    table = spark.createDataFrame(chats, "conv_id long, turn long, role string, text string")
    for name in ("conv", "example", "loss_start", "turns"):
        table = table.withColumn(name, F.lit("extra"))
    talks = defaultdict(list)
    for c, t, role, text in chats:
        talks[c].append((t if t is not None else -1, role or "", text or ""))
    examples = format_conversations(table)
    got = {r["conv"]: r for r in conversation_digests(examples).collect()}
    assert got.keys() == talks.keys()
    for c, turns in talks.items():
        turns.sort()
        said = "".join(text for _, role, text in turns if role == "assistant")
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), sha("".join(f"{role}\n{text}\n" for _, role, text in turns)))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(said), sha(said))
    each = examples.withColumn("turns", read_turns(F.col("text"))).collect()
    assert sum(r["conv"] == 6 for r in each) == 60
    for r in each:  # all preceding turns as context, only the reply trainable
        want = [(role, text) for _, role, text in talks[r["conv"]][: r["example"] + 1]]
        assert [tuple(t) for t in r["turns"]] == want
        assert r["text"][r["loss_end"]:] in ("", "<|end|>\n") and (r["loss_end"] == r["loss_start"]) == (want[-1][0] != "assistant" or not want[-1][1])
    assert sum(len(r["text"]) for r in each if r["conv"] == 6) == got[6]["formatted_chars"]
    assert conversation_digests(format_conversations(table.where("1 = 0"))).collect() == []


def test_viterbi():
    from couplemap.llm.url_filter import viterbi

    counts = {"cheap": 50, "pills": 40, "the": 900, "rapist": 5, "therapist": 9, "a": 400}
    assert viterbi("cheappills", counts, 10_000) == ["cheap", "pills"]
    assert viterbi("therapist", counts, 10_000) == ["therapist"]
    assert viterbi("cheapqxz", counts, 10_000) == ["cheap", "qxz"]
    assert viterbi("", counts, 10_000) == []


def test_url_filter(spark):
    from couplemap.llm.url_filter import RULES, filter_urls

    rng = random.Random(4)
    urls = [None, "", "no scheme", "://", "HTTP://EXAMPLE.org", "http://Example.Org/es/a?x#y", "http://a.example.org/en/12#x", "x://com/fr/", "x://notcom/fr/", "http://b.com/de/?q", "a://b://c/d", "http://h?x/y"]
    for k in range(300):
        name = rng.choice(["casinowin", "cheappills"] + ["goodnews", "schoolbook"] * 9)
        host = name + (".net" if name in ("casinowin", "cheappills") else rng.choice([".net", ".com", ".example.org"]))
        urls.append(f"https://www.{host}/{rng.choice(['en', 'es', 'fr', 'de'])}/{k}.html")
    rows = [(k, u, "<p>good news and a school book, cheap pills, casino win</p>") for k, u in enumerate(urls)] + [(5, urls[5], None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for name in ("host", "form", "token", "score", "word", "name", "n"):
        pages = pages.withColumn(name, F.lit("extra"))
    got = filter_urls(pages).collect()
    want = Counter()
    for k, u, _ in rows:
        host = path = ""
        if u and "://" in u:
            m = re.match(r"([^/?#]*)([^?#]*)", u.split("://", 1)[1])
            host, path = lower(m[1]), m[2]
        fits = [(len(r), r, v) for r, v in RULES if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
        want[k, host, path, max(fits)[1] if fits else None] += 1
    assert Counter(tuple(r[c] for c in ("page_id", "host", "path", "rule")) for r in got) == want
    verdicts = dict(RULES)
    assert all(r["verdict"] == verdicts[r["rule"]] for r in got if r["rule"])
    free = [r for r in got if not r["rule"] and r["host"].endswith(".net") and "/en/" in r["path"]]
    assert {r["host"].split(".")[1]: r["verdict"] for r in free} == {"casinowin": "block", "cheappills": "block", "goodnews": "allow", "schoolbook": "allow"}
    assert filter_urls(pages.where("1 = 0")).collect() == []


def test_viterbi_brute_force():
    """Against all splits of short names; unknown stretches and known words
    of any length."""
    import math

    from couplemap.llm.url_filter import viterbi

    def cost(words, counts, total):
        return sum(math.log(total / counts[w]) if w in counts else math.log(total / 10) + len(w) * math.log(10) for w in words)

    rng = random.Random(6)
    for _ in range(200):
        counts = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 5))): rng.randint(1, 500) for _ in range(6)}
        name = "".join(rng.choice("abc") for _ in range(rng.randint(1, 10)))
        every = []
        for mask in range(1 << (len(name) - 1)):
            cuts = [0, *[k + 1 for k in range(len(name) - 1) if mask >> k & 1], len(name)]
            every.append([name[a:b] for a, b in zip(cuts, cuts[1:])])
        got = viterbi(name, counts, 4000.0)
        assert "".join(got) == name
        assert math.isclose(cost(got, counts, 4000.0), min(cost(w, counts, 4000.0) for w in every))
    long = "antidisestablishmentarianism" * 2
    assert viterbi(long, {"antidisestablishmentarianism": 3}, 1000.0) == ["antidisestablishmentarianism"] * 2


def test_segment_names_of_any_length(spark):
    from couplemap.llm.url_filter import segment_names, viterbi

    vocabulary = {"antidisestablishmentarianism": 7, "antidisestablishmentarianistic": 2, "cheap": 50, "pills": 40, "z" * 3000: 4}
    words = spark.createDataFrame(list(vocabulary.items()), "word string, n long")
    names = ["cheapantidisestablishmentarianismpills", "pills", "qq", "cheap" * 1000 + "x" * 1100 + "pills", "cheap" + "z" * 3000]
    got = {r["name"]: r["words"] for r in segment_names(spark.createDataFrame([(n,) for n in names], "name string"), words).collect()}
    assert got == {n: viterbi(n, vocabulary, sum(vocabulary.values()) + 10.0) for n in names}
    assert got[names[0]] == ["cheap", "antidisestablishmentarianism", "pills"]
    assert got[names[3]] == ["cheap"] * 1000 + ["x" * 1100, "pills"] and got[names[4]] == ["cheap", "z" * 3000]


def test_url_filter_is_no_language_filter(spark):
    """Words of the rules do not decide where the rules do not apply; a token
    counts as often as a path holds it; long hosts and paths pass."""
    from couplemap.llm.url_filter import filter_urls

    rng = random.Random(9)
    urls = [f"https://{rng.choice(['school', 'garden', 'museum'])}{rng.choice(['.com', '.example.org', '.net'])}/{rng.choice(['en', 'es', 'fr', 'de'])}/{k}" for k in range(400)]
    urls += [f"http://adult.net/{lang}/1" for lang in ("en", "es", "fr", "de")]
    urls += ["http://garden.net/casino/a", "http://garden.net/casino/casino/a", f"http://{'garden' * 3000}.net/{'x/' * 20000}", f"http://{'a.' * 3000}net/"]
    pages = spark.createDataFrame([(k, u, "<p>school garden museum adult casino</p>") for k, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in filter_urls(pages).collect()}
    assert len(got) == len(urls)
    for k, u in enumerate(urls[:404]):
        if got[k]["rule"] is None:
            assert got[k]["verdict"] == ("block" if "adult" in u else "allow")
    once, twice, none = (next(got[k]["score"] for k, u in enumerate(urls) if u == x) for x in (urls[404], urls[405], next(u for u in urls if u.startswith("https://garden.net"))))
    assert abs((twice - none) - 2 * (once - none)) < 1 + 1e-9 and twice > once


def test_skew_join(spark):
    from couplemap.llm.common import skew_join

    left = spark.range(1000).selectExpr("id", "cast(if(id % 3 = 0, 'hot', concat('k', id % 50)) as string) as k").union(spark.sql("select -1L, cast(null as string)"))
    right = spark.createDataFrame([("hot", 1), ("k7", 2)], "k string, v int")
    plain = Counter(tuple(r) for r in left.join(right, "k", "left").select("id", "k", "v").collect())
    assert Counter(tuple(r) for r in skew_join(left, right, "k", "id", key_rows=40).select("id", "k", "v").collect()) == plain


def test_pipeline(spark, tmp_path):
    import public_tokenizers
    import tiktoken

    from couplemap.llm.common import read_ranks
    from couplemap.llm.quality import line_fault

    rng = random.Random(9)
    words = [f"{a}{b}" for a in "alpha beta gamma delta épsilon zeta eta theta".split() for b in range(40)]
    text = lambda n: "\n".join(" ".join(rng.choice(words) for _ in range(12)) + "." for _ in range(n))
    bench = [(k, " ".join(rng.choice(words) for _ in range(25))) for k in range(4)]
    rows = [(k, text(rng.randint(3, 12))) for k in range(30)]
    rows += [(100 + k, rows[k][1]) for k in range(4)]  # copies
    one = lambda w: w + "x"
    for k in range(4, 8):  # near copies on one line, so that no line repeats
        flat = rows[k][1].replace("\n", " ")
        rows[k] = (k, flat)
        parts = flat.split()
        parts[10] = one(parts[10])
        rows.append((200 + k, " ".join(parts)))
    rows += [(300, text(4) + "\n" + bench[0][1] + " " + text(3)), (301, "intro words here " + bench[1][1] + " end"), (302, None), (303, ""), (304, "too short"), (305, "a | b | c | d | e\n" * 30), (306, text(30) + "\nBUY!! IT!! NOW!!")]
    folder = str(tmp_path)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.withColumn("n_words", F.lit("extra")).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")

    word = re.compile("[^\x20\x09-\x0d]+")
    kept = []
    for i, t in rows:  # quality
        w = word.findall(t or "")
        times = Counter(tuple(w[k:k + 8]) for k in range(len(w) - 7))
        covered = {k + j for k in range(len(w) - 7) if times[tuple(w[k:k + 8])] > 1 for j in range(8)}
        lines = (t or "").split("\n")
        clean = [x for x in lines if not line_fault(x.encode())]
        left = sum(len(word.findall(x)) for x in clean)
        if len(w) >= 20 and 100 * len(covered) <= 30 * len(w) and 2 * left >= len(w):
            kept.append((i, "\n".join(clean)))
    holders = defaultdict(set)
    for i, t in kept:
        for x in t.split("\n"):
            holders[lower(x.strip("\x20\x09\x0a\x0b\x0c\x0d"))].add(i)
    lined = []
    for i, t in kept:
        own = [x for x in t.split("\n") if (k := lower(x.strip("\x20\x09\x0a\x0b\x0c\x0d"))) is not None and (len(k) < 10 or min(holders[k]) == i)]
        new = "\n".join(own)
        if new == t or 2 * len(new) >= len(t) or len(word.findall(new)) >= corpus_pipeline.MIN_WORDS:
            lined.append((i, new))
    least = {i: c for (i, _, c), _ in jaccard_brute(lined).items()}
    single = [(i, t) for i, t in lined if least[i] == i]
    item_word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    items = [(str(i), item_word.findall(lower(t))) for i, t in bench]
    final = {}
    for i, t in single:
        at = [m.span() for m in item_word.finditer(t)]
        hit, _ = windows_hit([lower(t[a:b]) for a, b in at], items)
        if 2 * len(hit) > len(at):
            continue
        out, end, k = "", 0, 0
        while k < len(at):
            if k in hit:
                out += t[end:at[k][0]]
                while k in hit:
                    k += 1
                end = at[k - 1][1]
            else:
                k += 1
        final[i] = out + t[end:]
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=dict(read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))), special_tokens={})
    want = {i: np.array(library.encode_ordinary(t), "<u4").tobytes() for i, t in final.items()}

    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert {i: bytes(r["ids"]) for i, r in got.items()} == want
    assert all(got[i]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest() for i, t in final.items())
    assert not {100, 101, 204, 205, 301, 302, 303, 304, 305} & got.keys() and {0, 4, 300, 306} <= got.keys()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.where("1 = 0"), folder).columns == docs.columns


def test_pipeline_near_duplicates_by_row(spark, tmp_path):
    """Rows are dropped by id and text: nothing unique is lost where ids
    repeat or are missing."""
    rng = random.Random(4)
    words = [f"w{k}" for k in range(500)]
    text = lambda n=80: " ".join(rng.choice(words) for _ in range(n))
    near = lambda t: t.replace(t.split()[-1], "changed")
    a, b, c, d = text(), text(), text(), text()
    long = " ".join(f"v{rng.randrange(10**6)}" for _ in range(130_000))  # about a megabyte
    rows = [(1, a), (5, near(a)), (5, b), (7, near(b)), (None, a), (None, a), (None, c), (None, near(c)), (9, d), (9, d), (9, near(d)), (11, None), (12, ""), (None, ""), (20, long), (21, near(long))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    stage = dict(corpus_pipeline.STAGES)["jaccard_join"]
    got = Counter((r["doc_id"], r["text"]) for r in stage(spark, docs.withColumn("row", F.lit("extra")).withColumn("group", F.lit(1)), str(tmp_path)).collect())
    lone = [x for x in ((None, c), (None, near(c))) if x in got]
    ninth = [x for x in ((9, d), (9, near(d))) if x in got]
    assert len(lone) == len(ninth) == 1
    assert got == Counter([(1, a), (5, b), lone[0], ninth[0], (11, None), (12, ""), (None, ""), (20, long)])


def test_line_dedup_many_hot_shards(spark, monkeypatch):
    """Thousands of shards that all have copies."""
    from couplemap.llm import line_dedup
    monkeypatch.setattr(line_dedup, "PROBES", 2)
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 1)
    rows = [(d, "\n".join(f"this is line number {k}" for k in range(d % 7, 1500, 7))) for d in range(21)]
    out = {r["id"]: r["kept"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {d: (t if d < 7 else "") for d, t in rows}
    with pytest.raises(ValueError):
        line_dedup.dropped_keys(spark.createDataFrame(rows, "doc_id long, text string"), min_docs=3)
