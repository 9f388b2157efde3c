"""Hand-made histories for the cases no driver table holds (FIXTURES.md section 4)."""

import datetime as dt

from pyspark.sql import functions as F

from couplemap.operators import history as H
from couplemap.sources.history import History

MODS = "commit_seq long, ord long, old_path string, new_path string"


def make(spark, mods, live, dates=None):
    m = spark.createDataFrame(mods, MODS)
    seqs = sorted({r[0] for r in mods})
    dates = dates or {s: dt.datetime(2024, 1, 1) + dt.timedelta(hours=s) for s in seqs}
    c = spark.createDataFrame([(s, f"c{s}", dates[s], None) for s in seqs],
                              "commit_seq long, commit_id string, committer_ts timestamp, committer_tz string")
    f = spark.createDataFrame([(p,) for p in live], "path string")
    return History(c, m, f)


def resolved(spark, h):
    return {r.path: r.current_path for r in H.resolve_renames(h, H.live_files(h.files)).collect()}


def touches(spark, h, bulk=-1):
    t = H.filter_bulk_commits(H.current_touches(h, H.live_files(h.files)), bulk)
    return sorted((r.commit_seq, r.path) for r in H.incidence_long(t).collect())


def test_delete_then_recreate(spark):
    h = make(spark, [(1, 0, None, "a"), (2, 0, "a", None), (3, 0, None, "a")], ["a"])
    assert touches(spark, h) == [(1, "a"), (3, "a")]


def test_rename_then_old_name_reused(spark):
    h = make(spark, [(1, 0, "a", "b"), (2, 0, None, "a")], ["a", "b"])
    assert resolved(spark, h) == {"a": "a", "b": "b"}


def chain(n):
    return [(i + 1, 0, f"p{i}", f"p{i + 1}") for i in range(n)] + [(0, 0, None, "p0")]


def test_chain_2(spark):
    h = make(spark, chain(2), ["p2"])
    assert resolved(spark, h)["p0"] == "p2"


def test_chain_50_and_51(spark):
    assert resolved(spark, make(spark, chain(50), ["p50"]))["p0"] == "p50"
    # 51 hops: the walk stops at p50 after 50 steps, which is not live
    assert resolved(spark, make(spark, chain(51), ["p51"]))["p0"] == "p50"


def test_cycle(spark):
    h = make(spark, [(1, 0, "a", "b"), (2, 0, "b", "a"), (0, 0, None, "a")], [])
    # 50 hops from a come back to a (even number of steps)
    assert resolved(spark, h)["a"] == "a"


def test_last_write_wins(spark):
    h = make(spark, [(1, 0, "a", "b"), (2, 0, "a", "c"), (0, 0, None, "a")], ["b", "c"])
    assert resolved(spark, h)["a"] == "c"


def test_two_changes_one_commit(spark):
    h = make(spark, [(1, 0, "b", "a"), (1, 1, "a", "a")], ["a"])
    assert touches(spark, h) == [(1, "a")]
    cf = H.commit_to_files(H.current_touches(h, H.live_files(h.files))).collect()
    assert len(cf) == 2  # the commit list keeps both rows


def test_bulk_limit(spark):
    n = 3
    mods = []
    for seq, k in [(1, 1), (2, n - 1), (3, n), (4, n + 1)]:
        mods += [(seq, i, f"f{i}", f"f{i}") for i in range(k)]
    h = make(spark, mods, [f"f{i}" for i in range(n + 1)])
    assert {s for s, _ in touches(spark, h, bulk=n)} == {1, 2}
    t = H.current_touches(h, H.live_files(h.files))
    assert {r.commit_seq for r in H.commit_to_files(t).collect()} == {1, 2, 3, 4}
    assert H.file_dates(t).where("path = 'f0'").first().last_modification == dt.datetime(2024, 1, 1, 4)


def test_date_order(spark):
    dates = {1: dt.datetime(2024, 1, 5), 2: dt.datetime(2024, 1, 2)}
    h = make(spark, [(1, 0, None, "a"), (2, 0, "a", "a")], ["a"], dates)
    d = H.file_dates(H.current_touches(h, H.live_files(h.files))).first()
    assert d.creation_date == dates[1] and d.last_modification == dates[2]


def test_empty_history(spark):
    h = make(spark, [], [])
    assert touches(spark, h) == []


def test_extension_filter(spark):
    from couplemap.functions.paths import extension
    df = spark.createDataFrame([(p,) for p in ["a/b.png", "a/.png", "x.tar.gz", "a.b/c", "..png", "a/.x.png", "x."]], "p string")
    got = {r.p: r.e for r in df.select("p", extension("p").alias("e")).collect()}
    assert got == {"a/b.png": ".png", "a/.png": "", "x.tar.gz": ".gz", "a.b/c": "", "..png": "", "a/.x.png": ".png", "x.": "."}


def test_strip_common_prefix(spark):
    from couplemap.functions.paths import strip_common_prefix
    df = spark.createDataFrame([("/r/src/a.py",), ("/r/src/b/c.py",)], "path string")
    assert sorted(r.path for r in strip_common_prefix(df).collect()) == ["a.py", "b/c.py"]
    one = spark.createDataFrame([("/r/a.py",)], "path string")
    assert [r.path for r in strip_common_prefix(one).collect()] == [""]
