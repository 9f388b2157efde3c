from pyspark.sql import functions as F

from couplemap.functions import porter
from couplemap.functions import text as T
from couplemap.functions import urls as U


def test_split_identifier(spark):
    cases = {"fooBar": ["foo", "Bar"], "foo_bar": ["foo", "bar"], "HTTPServer": ["HTTP", "Server"],
             "_x": ["x"], "__init__": ["init"], "a1B2": ["a1B2"], "": []}
    df = spark.createDataFrame([(k,) for k in cases], "w string")
    got = {r.w: list(r.s) for r in df.select("w", T.split_identifier(F.col("w")).alias("s")).collect()}
    assert got == cases


def test_porter_examples():
    # examples from Porter's 1980 paper and the extended stemmer
    pairs = {"caresses": "caress", "ponies": "poni", "ties": "tie", "cats": "cat", "feed": "feed",
             "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing",
             "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop",
             "falling": "fall", "hissing": "hiss", "failing": "fail", "filing": "file", "happy": "happi",
             "relational": "relat", "conditional": "condit", "rational": "ration", "digitizer": "digit",
             "operator": "oper", "feudalism": "feudal", "hopefulness": "hope", "callousness": "callous",
             "formaliti": "formal", "sensitiviti": "sensit", "triplicate": "triplic", "formative": "form",
             "electrical": "electr", "goodness": "good", "revival": "reviv", "allowance": "allow",
             "inference": "infer", "airliner": "airlin", "adjustable": "adjust", "defensible": "defens",
             "irritant": "irrit", "replacement": "replac", "adjustment": "adjust", "dependent": "depend",
             "adoption": "adopt", "communism": "commun", "activate": "activ", "effective": "effect",
             "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll",
             "sky": "sky", "dying": "die", "is": "is", "generalization": "gener"}
    bad = {w: (porter.stem(w), s) for w, s in pairs.items() if porter.stem(w) != s}
    assert not bad


def test_urls(spark):
    rows = ["https://h/u/r.git", "git@h:u/r.git", "C:/x/r", "https://h/u/r/", "https://x.github.io/r", "noslash"]
    df = spark.createDataFrame([(u,) for u in rows], "url string")
    got = {r.url: (r.remote, r.name) for r in df.select("url", U.is_remote("url").alias("remote"),
                                                       U.repo_name("url").alias("name")).collect()}
    assert got["https://h/u/r.git"] == (True, "r")
    assert got["git@h:u/r.git"] == (True, "r")
    assert got["C:/x/r"] == (False, "r")
    assert got["https://h/u/r/"] == (True, "")
    assert got["https://x.github.io/r"][1] is None
    assert got["noslash"][1] is None


def test_source_tree_ast_mode(spark, tmp_path):
    from couplemap.sources.history import scan_source_tree
    (tmp_path / "pkg").mkdir()
    (tmp_path / "pkg" / "a.py").write_text("def fooBar(x):\n    return x\n\nasync def skipped():\n    pass\n")
    (tmp_path / "b.py").write_text("this is not python (\n")
    src = scan_source_tree(spark, str(tmp_path))
    assert sorted(r.path for r in src.collect()) == ["b.py", "pkg/a.py"]
    toks = sorted((r.path, r.word) for r in T.tokens_from_sources(src, stem=True, mode="ast").collect())
    assert toks == [("pkg/a.py", "bar"), ("pkg/a.py", "foo"), ("pkg/a.py", "x")]
    assert [r.path for r in T.parsed_sources(src, "ast").collect()] == ["pkg/a.py"]
    assert [r.path for r in T.unparsable_sources(src).collect()] == ["b.py"]


def test_extended_stems():
    from couplemap.functions.porter import stem

    got = {w: stem(w) for w in "use using used one age geology biology theology caresses ponies relational hopping happy".split()}
    assert got == {"use": "use", "using": "use", "used": "use", "one": "one", "age": "age", "geology": "geolog", "biology": "biolog",
                   "theology": "theolog", "caresses": "caress", "ponies": "poni", "relational": "relat", "hopping": "hop", "happy": "happi"}


def test_identifiers_of_any_script(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("café número größe item2 2nd __init__ _x HTTPServer",)], ["t"])
    assert df.select(T.identifiers(F.col("t"))).first()[0] == ["café", "número", "größe", "item2", "nd", "__init__", "_x", "HTTPServer"]


def test_stem_expressions_equal_the_word_by_word_stemmer(spark):
    import random

    from couplemap.functions import porter

    rng = random.Random(1)
    endings = [a for a, _ in porter._STEP2 + porter._STEP3] + porter._STEP4 + ["s", "ies", "sses", "ed", "ing", "eed", "ied", "y", "e", "ll", ""]
    words = set(porter._POOL) | {"y" * k for k in range(9)} | {"b" + "y" * k + "ing" for k in range(9)} | {"ñandúes", "été", "日本s", "x" * 3000 + "ing"}
    for _ in range(6000):
        start = "".join(rng.choice("aeioubcdfglmnprstvwxyz") for _ in range(rng.randint(0, 6)))
        words.add(start + rng.choice(endings) + rng.choice(["", "", "s", "ed", "ing", "ly"]))
    df = spark.createDataFrame([(w,) for w in words], "w string")  # the column is named like the expressions' own
    got = {r["w"]: r["p"] for r in porter.stem_frame(df, "w", "p").collect()}
    assert got == {w: porter.stem(w) for w in words}


def test_word_counts_by_dictionary(spark):
    from collections import Counter

    texts = [("a", "fooBar foo_bar foo Foo HTTPServer __init__ plain plain été ÉTÉ"), ("b", "plain foo relational"), ("c", ""), ("d", None)]
    src = spark.createDataFrame(texts, "path string, text string")
    for stem in (False, True):
        want = Counter((r.path, r.word) for r in T.tokens_from_sources(src, stem=stem).collect())
        assert {(r.path, r.word): r.cnt for r in T.word_counts(src, stem=stem).collect()} == want


def test_texts_cross_one_shuffle_and_paths_may_repeat(spark):
    """The counted rows never do: the plan of tf has the exchange of the texts only."""
    from couplemap.operators import similarity as S

    src = spark.createDataFrame([("a", "fooBar foo"), ("a", "foo x"), ("b", "x x y_x"), ("c", ""), (None, "foo z")], "path string, text string")
    tf = S.term_frequency(T.word_counts(src, stem=False))
    assert {(r.path, r.word): round(r.tf, 9) for r in tf.collect()} == {
        ("a", "foo"): 0.6, ("a", "bar"): 0.2, ("a", "x"): 0.2, ("b", "x"): 0.75, ("b", "y"): 0.25}
    plan = tf._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") == 1
    idf = {r.word: r.df for r in S.inverse_doc_frequency(T.word_counts(src, stem=False), src).collect()}
    assert idf == {"foo": 2, "bar": 1, "x": 2, "y": 1, "z": 1}


def test_names_in_the_order_of_ast_walk():
    import ast
    import inspect
    import textwrap

    odd = "@d(a)\nclass C(B, metaclass=M):\n    x: int = y[z:w]\n    async def f(self, *p, q=r, **s): return [i for i in p if i] or {k: v, **u}\n    def g(h): lambda m: (n := m)\nmatch t:\n    case P(o=1) | [_, *rest]: del t\nf'{aa!r:{bb}}'\n"
    for text in (odd, "", "x = 1", textwrap.dedent(inspect.getsource(porter)), textwrap.dedent(inspect.getsource(T))):
        root = ast.parse(text)
        want = [n.id if isinstance(n, ast.Name) else n.name for n in ast.walk(root) if isinstance(n, (ast.Name, ast.FunctionDef, ast.ClassDef))]
        assert T.names_of(root) == want
