"""Round trips of the text history dump and of the saved result tables."""

import uuid

from pyspark.sql import functions as F

from couplemap.session import ensure_checkpoint_dir
from couplemap.sources import bindings as B
from couplemap.sources.history import load_history_log, write_history_log

SF = "/root/testdata/sf0.001"


def _scratch(spark, name):
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}/{uuid.uuid4().hex}"


def test_history_log_round_trip(spark):
    h = B.events_history(spark, SF)
    folder = _scratch(spark, "logs")
    write_history_log(h, folder)
    back = load_history_log(spark, folder)
    key = ["commit_seq", "old_path", "new_path"]
    norm = lambda rows: sorted(tuple("" if v is None else v for v in r) for r in rows)
    a = norm(h.modifications.select(*key).collect())
    b = norm(back.modifications.select(*key).collect())
    assert a == b
    assert back.commits.count() == h.commits.count()
    # order inside a commit survives as positions
    first = back.modifications.groupBy("commit_seq").agg(F.min("ord").alias("o")).agg(F.max("o")).first()[0]
    assert first == 0


def test_saved_result_round_trip(spark):
    from couplemap.plans.registry import _quick_result
    from couplemap.sources.results import load_result, save_result
    res = _quick_result(spark, SF)
    root = _scratch(spark, "saved")
    save_result(res, root, "logical", "events")
    save_result(res, root, "semantic", "events")
    back = load_result(spark, root, "logical", "events")
    assert sorted(tuple(r) for r in back.routes.collect()) == sorted(tuple(r) for r in res.routes.collect())
    assert back.buildings.count() == res.buildings.count()


def test_history_log_copies_swaps_quotes_and_offsets(spark, tmp_path):
    log = (
        "@@@\nc1\t2024-03-01 10:00:00+02:00\t1\nA\ta.py\nA\tx.py\nA\ty.py\nA\t\"odd\\tname \\\"q\\\" caf\\303\\251.py\"\n"
        "@@@\nc2\t2024-03-02 10:00:00-05:30\t2\nC100\ta.py\tb.py\nR100\tx.py\ty.py\nR100\ty.py\tx.py\n"
        "@@@\nc3\t2024-03-03 10:00:00Z\t3\nD\tb.py\n"
    )
    (tmp_path / "log.txt").write_text(log)
    h = load_history_log(spark, str(tmp_path / "log.txt"))
    assert {r.path for r in h.files.collect()} == {"a.py", "x.py", "y.py", 'odd\tname "q" café.py'}
    folder = _scratch(spark, "logs")
    write_history_log(h, folder)
    back = load_history_log(spark, folder)
    rows = lambda x: sorted(map(str, x.commits.collect()))
    assert rows(back) == rows(h)
    assert {r.commit_id: r.committer_tz for r in back.commits.collect()} == {"c1": "+02:00", "c2": "-05:30", "c3": "+00:00"}
    assert {r.path for r in back.files.collect()} == {r.path for r in h.files.collect()}


def test_history_log_long_commit(spark, tmp_path):
    (tmp_path / "log.txt").write_text("@@@\nc1\t2024-03-01 10:00:00\t1\n" + "".join(f"A\tf{k}.py\n" for k in range(3000)))
    assert load_history_log(spark, str(tmp_path / "log.txt")).modifications.count() == 3000


def test_source_tree_paths(spark, tmp_path):
    from couplemap.sources.history import scan_source_tree

    (tmp_path / "my dir").mkdir()
    (tmp_path / "my dir" / "a+b é%20.py").write_text("x = 1")
    got = scan_source_tree(spark, str(tmp_path)).collect()
    assert [(r.path, r.text) for r in got] == [("my dir/a+b é%20.py", "x = 1")]


def test_events_sources_take_every_document(spark):
    """All documents feed the semantic map, as texts of live files; a file of
    several texts counts once for idf."""
    from couplemap.functions.text import parsed_sources
    from couplemap.operators.history import live_files
    from couplemap.sources import bindings as B

    got = B.events_sources(spark, SF).cache()
    assert sorted(r["text"] or "" for r in got.collect()) == sorted(r["text"] or "" for r in B.table(spark, SF, "documents").collect())
    live = {r["path"] for r in live_files(B.events_history(spark, SF).files).collect()}
    paths = [r["path"] for r in parsed_sources(got).collect()]
    assert set(paths) <= live and len(paths) == len(set(paths)) == got.select("path").distinct().count()


def test_skipped_sources_are_counted(spark, tmp_path):
    from pyspark.sql import Observation

    from couplemap.functions.text import python_identifiers
    from couplemap.sources.history import scan_source_tree, scan_sources

    (tmp_path / "good é.py").write_text("x = 1\n")
    (tmp_path / "bad.py").write_bytes(b"\xff\xfe x = 1")
    (tmp_path / "open.py").write_text("x = (\n")
    seen, parsed = Observation(), Observation()
    src = scan_source_tree(spark, str(tmp_path), seen)
    got = sorted((r.path, r.ident, r.parsed) for r in python_identifiers(src, parsed).collect())
    assert got == [("good é.py", "x", True), ("open.py", None, False)]
    assert seen.get == {"n_files": 3, "n_skipped": 1} and parsed.get == {"n_unparsed": 1}
    rows = [("p", bytearray(b"ok")), ("q", bytearray(b"\xff")), ("r", None)]
    spark.createDataFrame(rows, "path string, content binary").write.parquet(str(tmp_path / "t.parquet"))
    seen = Observation()
    assert [tuple(r) for r in scan_sources(spark, str(tmp_path / "t.parquet"), seen=seen).collect()] == [("p", "ok")]
    assert seen.get == {"n_files": 3, "n_skipped": 2}


def test_repeated_commit_seq_raises(spark, tmp_path):
    import pytest

    from couplemap.sources.history import scan_commits

    folder = str(tmp_path / "commits")
    spark.sql("SELECT 1L AS commit_seq, 'a' AS commit_id, timestamp'2024-01-01' AS committer_ts UNION ALL SELECT 1L, 'b', timestamp'2024-01-02'").write.parquet(folder)
    with pytest.raises(ValueError):
        scan_commits(spark, folder)
