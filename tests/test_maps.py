"""Composed maps end to end on small hand-made inputs."""

import datetime as dt

from couplemap.plans.maps import couplings_map, semantic_map
from couplemap.sources.history import History

MODS = "commit_seq long, ord long, old_path string, new_path string"


def _history(spark):
    mods = [(1, 0, None, "a.py"), (1, 1, None, "b.py"), (2, 0, "a.py", "a.py"), (2, 1, "b.py", "b.py"),
            (3, 0, None, "c.py"), (4, 0, "c.py", "c.py"), (4, 1, None, "d.py")]
    m = spark.createDataFrame(mods, MODS)
    c = spark.createDataFrame([(s, f"h{s}", dt.datetime(2024, 1, s), "+01:00") for s in range(1, 5)],
                              "commit_seq long, commit_id string, committer_ts timestamp, committer_tz string")
    f = spark.createDataFrame([(p,) for p in ["a.py", "b.py", "c.py", "d.py"]], "path string")
    return History(c, m, f)


def test_semantic_map_ast(spark):
    src = spark.createDataFrame([
        ("a.py", "def loadUserData(user_id):\n    return user_id\n"),
        ("b.py", "class UserData:\n    user_id = 1\n"),
        ("c.py", "def renderPage(page):\n    return page\n"),
        ("d.py", "this does not parse ("),
    ], "path string, text string")
    res = semantic_map(_history(spark), src, n_iter=50, mode="ast")
    b = {r.fileName: r.height for r in res.buildings.collect()}
    # d.py does not parse: it is no member of any city; the others keep their commit heights
    assert b == {"a.py": 2, "b.py": 2, "c.py": 2}
    assert res.meta.where("pos = 0").first().commit_id == "None"
    assert res.file_dates.where("path = 'a.py'").first().creation_tz == "+01:00"


def test_couplings_choice(spark):
    import pytest
    with pytest.raises(ValueError):
        couplings_map("other", _history(spark))
    res = couplings_map(None, _history(spark), n_iter=50)
    routes = {(r.start, r.end) for r in res.routes.collect()}
    assert all((e, s) in routes for s, e in routes)
