"""Registered queries: one per operator of the inventory, each over the
driver's tables (bindings in ``sources.bindings``), plus the DuckDB text of
the ones SQL can express.

Outputs are flat, doubles rounded to 6 digits, timestamps as text, so the
two engines can be compared row by row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T
from ..functions import urls as U
from ..functions.indexing import with_global_index
from ..functions.porter import stem_sql
from ..operators import graph as G
from ..operators import history as H
from ..operators import layout as L
from ..operators import similarity as S
from ..sources import bindings as B
from ..session import cut_lineage
from . import oracle_sql as O

Query = Callable[[SparkSession, str], DataFrame]


def r6(c) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def ts(c) -> F.Column:
    return F.date_format(F.col(c) if isinstance(c, str) else c, "yyyy-MM-dd HH:mm:ss")


# ---- shared pieces (events history binding) -----------------------------------------

class _Hist:
    """Per-call bundle of the events history and the tables derived from it."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.h = B.events_history(spark, sf_dir)
        self.live = H.live_files(self.h.files)
        self.touches = cut_lineage(H.current_touches(self.h, self.live))
        self.inc = cut_lineage(H.incidence_long(self.touches))
        self.heights = H.file_heights(self.inc)

    def clusters(self) -> DataFrame:
        """Folder clusters (d0 .. d9): a partition SQL can state too."""
        return self.heights.select("path", F.regexp_extract("path", r"/d([0-9]+)/", 1).cast("int").alias("label"))

    def buildings(self) -> DataFrame:
        return G.city_buildings(self.clusters(), self.heights)

    def routes(self) -> DataFrame:
        return G.cluster_routes(self.inc, self.clusters())

    def dates(self) -> DataFrame:
        return H.file_dates(self.touches)

    def layout(self) -> DataFrame:
        """Stand-in 2-D position of each file: (height, days touched)."""
        days = self.touches.groupBy("path").agg(F.countDistinct(F.to_date("committer_ts")).alias("y"))
        return self.heights.join(days, "path").select("path", F.col("height").cast("double").alias("x"),
                                                      F.col("y").cast("double").alias("y"))

    def cities(self) -> DataFrame:
        return G.centroids_normalized(G.centroids(self.layout(), self.clusters()))


QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


# ---- 2.1 sources ---------------------------------------------------------------------

@register("scan_commits", O.hist(f"SELECT commit_seq, commit_id, strftime(committer_ts, {O.TS}) AS committer_ts FROM commits"))
def q_scan_commits(spark, sf):
    from ..sources.history import scan_commits
    folder = _scratch(spark, "commits")
    B.events_history(spark, sf).commits.write.parquet(folder)
    return scan_commits(spark, folder).select("commit_seq", "commit_id", ts("committer_ts").alias("committer_ts"))


@register("scan_modifications", O.hist("SELECT commit_seq, ord, old_path, new_path FROM mods"))
def q_scan_modifications(spark, sf):
    from ..sources.history import scan_modifications
    folder = _scratch(spark, "modifications")
    B.events_history(spark, sf).modifications.write.parquet(folder)
    return scan_modifications(spark, folder)


@register("scan_modifications_nested", O.hist("""SELECT commit_seq, row_number() OVER (PARTITION BY commit_seq ORDER BY ord) - 1 AS ord,
  old_path, new_path FROM mods"""))
def q_scan_modifications_nested(spark, sf):
    from ..sources.history import scan_modifications
    folder = _scratch(spark, "nested")
    mods = F.sort_array(F.collect_list(F.struct("ord", "old_path", "new_path")))
    B.events_history(spark, sf).modifications.groupBy("commit_seq").agg(
        F.transform(mods, lambda m: F.struct(m["old_path"].alias("old_path"), m["new_path"].alias("new_path"))).alias("modified_files")
    ).write.json(folder)
    return scan_modifications(spark, folder, fmt="json")


@register("scan_files", O.hist("SELECT path FROM files"))
def q_scan_files(spark, sf):
    from ..sources.history import scan_files
    folder = _scratch(spark, "files")
    B.events_history(spark, sf).files.write.parquet(folder)
    return scan_files(spark, folder)


_SKIPPED = 7  # every seventh document is written with a byte that is not UTF-8


@register("scan_sources", f"""SELECT concat('doc_', CAST(doc_id AS VARCHAR)) AS path, length(text) AS n_chars,
  (SELECT count(*) FROM documents) AS n_files, (SELECT count(*) FROM documents WHERE doc_id % {_SKIPPED} = 0) AS n_skipped
FROM documents WHERE doc_id % {_SKIPPED} <> 0 AND text IS NOT NULL""")
def q_scan_sources(spark, sf):
    """All documents written as a table of contents and read back; the
    counters come from the pass that reads."""
    from pyspark.sql import Observation
    from ..sources.history import scan_sources
    folder = _scratch(spark, "sources")
    d = B.table(spark, sf, "documents").where("text is not null")
    plain = F.encode("text", "UTF-8")
    content = F.when(F.col("doc_id") % _SKIPPED == 0, F.concat(F.unhex(F.lit("FF")), plain)).otherwise(plain)
    d.select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("path"), content.alias("content")).write.parquet(folder)
    seen = Observation()
    read = cut_lineage(scan_sources(spark, folder, seen=seen).select("path", F.length("text").cast("long").alias("n_chars")))
    return read.withColumns({k: F.lit(seen.get[k]).cast("long") for k in ("n_files", "n_skipped")})


# ---- 2.2 projections, filters, scalar functions ------------------------------------------

@register("filter_extension", O.hist("SELECT path FROM live"))
def q_filter_extension(spark, sf):
    return H.live_files(B.events_history(spark, sf).files)


_STRIP_SQL = O.hist(r"""
, full_paths AS (SELECT concat('/clone/events/', path) AS full_path FROM files),
parts AS (SELECT full_path, string_split(full_path, '/') AS p FROM full_paths),
b AS (SELECT min(p) AS lo, max(p) AS hi FROM parts),
k AS (SELECT coalesce((SELECT min(i) - 1 FROM b, range(1, least(len(lo), len(hi)) + 1) t(i) WHERE lo[i] <> hi[i]),
                      (SELECT least(len(lo), len(hi)) FROM b)) AS k FROM b),
pre AS (SELECT array_to_string(lo[1:k], '/') AS prefix, k FROM b, k)
SELECT full_path, substr(full_path, CASE WHEN k >= 1 AND prefix = '' THEN 1 ELSE length(prefix) END + 2) AS path
FROM parts, pre""")


@register("strip_common_prefix", _STRIP_SQL)
def q_strip_common_prefix(spark, sf):
    f = B.events_history(spark, sf).files.select(F.concat(F.lit("/clone/events/"), F.col("path")).alias("full_path"))
    return P.strip_common_prefix(f, "full_path", "path").select("full_path", "path")


@register("is_remote", "SELECT page_id, url, (starts_with(url, 'git@') OR starts_with(url, 'https://')) AS is_remote FROM pages")
def q_is_remote(spark, sf):
    return B.urls(spark, sf).select("page_id", "url", U.is_remote("url").alias("is_remote"))


_REPO_NAME_SQL = r"""
SELECT page_id, url, CASE WHEN s = 0 OR e <= s THEN NULL ELSE substr(url, s + 1, e - s - 1) END AS repo_name
FROM (SELECT page_id, url,
        CASE WHEN strpos(reverse(url), '/') = 0 THEN 0 ELSE length(url) - strpos(reverse(url), '/') + 1 END AS s,
        CASE WHEN strpos(reverse(url), 'tig.') = 0 THEN length(url) + 1 ELSE length(url) - strpos(reverse(url), 'tig.') - 2 END AS e
      FROM pages)
"""


@register("repo_name", _REPO_NAME_SQL)
def q_repo_name(spark, sf):
    return B.urls(spark, sf).select("page_id", "url", U.repo_name("url").alias("repo_name"))


@register("normalize_url", r"SELECT page_id, regexp_replace(url, '\.git$', '') AS url FROM pages")
def q_normalize_url(spark, sf):
    return B.urls(spark, sf).select("page_id", U.normalize_url("url").alias("url"))


# the tables' urls hold neither ``.git`` nor backslashes: these put them in
_GIT_URL = "CASE WHEN page_id % 3 = 0 THEN concat(regexp_replace(url, '[?#].*$', ''), '.git') WHEN page_id % 3 = 1 THEN concat(url, '.git/x') ELSE url END"


@register("normalize_git_url", rf"SELECT page_id, regexp_replace({_GIT_URL}, '\.git$', '') AS url FROM pages")
def q_normalize_git_url(spark, sf):
    return B.urls(spark, sf).withColumn("url", F.expr(_GIT_URL)).select("page_id", U.normalize_url("url").alias("url"))


@register("normalize_backslash_path", r"SELECT page_id, replace(replace(url, '/e', '\e'), '\', '/') AS path FROM pages")
def q_normalize_backslash_path(spark, sf):
    p = B.urls(spark, sf).withColumn("url", F.replace("url", F.lit("/e"), F.lit("\\e")))
    return p.select("page_id", P.normalize_path("url").alias("path"))


@register("split_code_identifier", """SELECT ident, array_to_string(string_split(trim(regexp_replace(regexp_replace(regexp_replace(ident,
  '_', ' ', 'g'), '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g')), ' '), ' ') AS words
FROM (SELECT DISTINCT concat(lower(lang), upper(substr(source, 1, 1)), substr(source, 2), '_HTTP', upper(substr(lang, 1, 1)), substr(lang, 2)) AS ident FROM documents
      WHERE lang IS NOT NULL AND source IS NOT NULL)""")
def q_split_code_identifier(spark, sf):
    d = B.table(spark, sf, "documents").where("lang is not null and source is not null")
    name = F.expr("concat(lower(lang), upper(substr(source, 1, 1)), substr(source, 2), '_HTTP', upper(substr(lang, 1, 1)), substr(lang, 2))")
    return d.select(name.alias("ident")).distinct().select("ident", F.array_join(T.split_identifier(F.col("ident")), " ").alias("words"))


@register("normalize_path", r"SELECT page_id, replace(url, '\', '/') AS path FROM pages")
def q_normalize_path(spark, sf):
    return B.urls(spark, sf).select("page_id", P.normalize_path("url").alias("path"))


_LINK_BRANCH = "CASE WHEN starts_with(url, 'git@') OR starts_with(url, 'https://') THEN 'main' ELSE NULL END"


@register("file_link", f"""SELECT page_id, CASE WHEN b IS NOT NULL THEN concat(regexp_replace(url, '\\.git$', ''), '/blob/', b, '/', 'README.md') END AS link
FROM (SELECT page_id, url, {_LINK_BRANCH} AS b FROM pages)""")
def q_file_link(spark, sf):
    p = B.urls(spark, sf)
    branch = F.when(U.is_remote("url"), F.lit("main"))
    return p.select("page_id", U.file_link("url", branch, F.lit("README.md")).alias("link"))


@register("commit_link", """SELECT page_id, CASE WHEN url IS NOT NULL AND h <> 'None' THEN concat(regexp_replace(url, '\\.git$', ''), '/commit/', h) END AS link
FROM (SELECT page_id, url, CASE WHEN starts_with(url, 'http://') THEN 'None' ELSE md5(url) END AS h FROM pages)""")
def q_commit_link(spark, sf):
    p = B.urls(spark, sf)
    # plain-http pages stand for "no commit chosen" ('None'); others carry a hash of the url
    h = F.when(F.col("url").startswith("http://"), F.lit("None")).otherwise(F.md5(F.col("url")))
    return p.select("page_id", U.commit_link("url", h).alias("link"))


_BULK = 20


@register("filter_bulk_commits", O.hist(f"SELECT DISTINCT path, commit_seq FROM touches WHERE n_mods < {_BULK}"))
def q_filter_bulk_commits(spark, sf):
    x = _Hist(spark, sf)
    return H.incidence_long(H.filter_bulk_commits(x.touches, _BULK))


@register("filter_routes_by_width", O.hist("SELECT \"start\", \"end\", width FROM routes WHERE width >= 300"))
def q_filter_routes_by_width(spark, sf):
    from ..operators.lookups import filter_routes_by_width
    return filter_routes_by_width(_Hist(spark, sf).routes(), 300)


@register("extract_identifiers", O.with_(O.CORPUS) + "SELECT path, ipos, ident FROM idents")
def q_extract_identifiers(spark, sf):
    d = B.corpus(spark, sf)
    ids = d.select("path", F.posexplode(T.identifiers(F.col("text"))).alias("ipos", "ident"))
    return ids.select("path", F.col("ipos").cast("long").alias("ipos"), "ident")


_UNPARSED = 5  # every fifth source has a bracket that is never closed

_AST_SQL = f"""WITH w AS (SELECT doc_id, concat('doc_', CAST(doc_id AS VARCHAR)) AS path, regexp_extract_all(text, '[A-Za-z]+') AS w FROM documents WHERE text IS NOT NULL),
names AS (SELECT path, k AS ipos, concat('x_', w[k]) AS ident FROM (SELECT path, w, unnest(range(1, 2 * (len(w) // 2) + 1)) AS k FROM w WHERE doc_id % {_UNPARSED} <> 0))
SELECT path, true AS parsed, ipos, ident, n_unparsed FROM (
  SELECT path, 0 AS ipos, concat('C_', CAST(doc_id AS VARCHAR)) AS ident FROM w WHERE doc_id % {_UNPARSED} <> 0 UNION ALL SELECT * FROM names), (SELECT count(*) AS n_unparsed FROM w WHERE doc_id % {_UNPARSED} = 0)"""


@register("extract_identifiers_ast", _AST_SQL)
def q_extract_identifiers_ast(spark, sf):
    """Each document's words as a Python source of one class and assignments
    (``x_a = x_b``), parsed; sources that do not parse are counted on the way."""
    from pyspark.sql import Observation
    d = B.table(spark, sf, "documents").where("text is not null")
    d = d.select("doc_id", F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)).alias("w"))
    pairs = F.transform(F.filter(F.transform("w", lambda x, k: F.struct(x.alias("a"), F.get("w", k + 1).alias("b"), k.alias("k"))),
                                 lambda p: (p["k"] % 2 == 0) & p["b"].isNotNull()), lambda p: F.concat(F.lit("x_"), p["a"], F.lit(" = x_"), p["b"]))
    opened = F.when(F.col("doc_id") % _UNPARSED == 0, F.lit("\n(")).otherwise(F.lit("\n"))
    source = F.concat(F.lit("class C_"), F.col("doc_id").cast("string"), F.lit(": pass\n"), F.array_join(pairs, "\n"), opened)
    seen = Observation()
    found = cut_lineage(T.python_identifiers(d.select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("path"), source.alias("text")), seen))
    return found.where("parsed").withColumn("n_unparsed", F.lit(seen.get["n_unparsed"]).cast("long"))


@register("split_identifier", O.with_(O.CORPUS) + """SELECT ident, string_agg(w, ' ' ORDER BY spos, k) AS words FROM (
  SELECT DISTINCT ident, spos, k, cw[k] AS w FROM (
    SELECT p.ident, c.spos, c.cw, unnest(generate_series(1, len(c.cw))) AS k
    FROM camel c JOIN (SELECT DISTINCT path, ipos, ident FROM idents) p ON c.path = p.path AND c.ipos = p.ipos)
  WHERE cw[k] <> '') GROUP BY ident""")
def q_split_identifier(spark, sf):
    d = B.corpus(spark, sf)
    ids = d.select(F.explode(T.identifiers(F.col("text"))).alias("ident")).distinct()
    return ids.select("ident", F.array_join(T.split_identifier(F.col("ident")), " ").alias("words")).where(F.col("words") != "")


@register("lower_words", O.with_(O.CORPUS) + "SELECT DISTINCT word FROM tokens")
def q_lower_words(spark, sf):
    return _counts(spark, sf).select("word").distinct()


@register("stem_words", O.with_(O.CORPUS) + stem_sql("SELECT DISTINCT word AS orig FROM tokens"))
def q_stem_words(spark, sf):
    toks = _counts(spark, sf).select("word").distinct()
    return T.stem_words(toks.withColumn("orig", F.col("word"))).select("orig", F.col("word").alias("stem"))


@register("height_scale", O.hist("""SELECT fileName, height, round(CASE WHEN mx - mn = 0 THEN 1.0 ELSE 9.0 / (mx - mn) * height + (mx - 10 * mn) / (mx - mn) END, 6) AS scale
FROM buildings, (SELECT min(height) AS mn, greatest(0, max(height)) AS mx FROM buildings)"""))
def q_height_scale(spark, sf):
    b = _Hist(spark, sf).buildings()
    return L.height_scale(b).select("fileName", "height", r6("scale").alias("scale"))


@register("date_color_hue", O.hist("""SELECT b.fileName, round(130.0 * (epoch_ms(d.last_modification) - lo) / (hi - lo) + 230.0, 6) AS hue
FROM buildings b LEFT JOIN file_dates d ON d.path = b.fileName,
     (SELECT epoch_ms(min(last_modification)) AS lo, epoch_ms(max(last_modification)) AS hi FROM file_dates)"""))
def q_date_color_hue(spark, sf):
    x = _Hist(spark, sf)
    return L.date_color_hue(x.buildings(), x.dates()).select("fileName", r6("hue").alias("hue"))


@register("invert_similarity", O.hist("""SELECT x.path AS a, y.path AS b,
  round(1 - count(*) / (any_value(hx.height) + any_value(hy.height) - count(*)), 6) AS distance
FROM inc x JOIN inc y ON x.commit_seq = y.commit_seq AND x.path < y.path
JOIN heights hx ON hx.path = x.path JOIN heights hy ON hy.path = y.path GROUP BY 1, 2"""))
def q_invert_similarity(spark, sf):
    j = S.jaccard_pairs(_Hist(spark, sf).inc)
    return S.invert_similarity(j.select("a", "b", "similarity")).select("a", "b", r6("distance").alias("distance"))


# ---- 2.3 joins -----------------------------------------------------------------------------

@register("resolve_renames", O.hist("SELECT path, current_path FROM resolved"))
def q_resolve_renames(spark, sf):
    h = B.events_history(spark, sf)
    return H.resolve_renames(h, H.live_files(h.files))


@register("current_touches", O.hist("SELECT commit_seq, ord, path, n_mods FROM touches"))
def q_current_touches(spark, sf):
    return _Hist(spark, sf).touches.select("commit_seq", "ord", "path", "n_mods")


@register("coupled_pairs", O.with_(O.BASKETS) + """SELECT x.path AS a, y.path AS b, count(*) AS n_common
FROM li x JOIN li y ON x.commit_seq = y.commit_seq AND x.path < y.path GROUP BY 1, 2""")
def q_coupled_pairs(spark, sf):
    h = B.lineitem_history(spark, sf)
    inc = h.modifications.select(F.col("new_path").alias("path"), "commit_seq").distinct()
    return S.coupled_pairs(inc)


@register("cluster_routes", O.hist('SELECT "start", "end", width FROM routes'))
def q_cluster_routes(spark, sf):
    return _Hist(spark, sf).routes()


@register("city_buildings", O.hist("SELECT label, fileName, height FROM buildings"))
def q_city_buildings(spark, sf):
    return _Hist(spark, sf).buildings()


@register("commit_files_outer", O.hist("""SELECT c.commit_id, t.ord, t.path FROM commits c
LEFT JOIN touches t ON t.commit_seq = c.commit_seq"""))
def q_commit_files_outer(spark, sf):
    x = _Hist(spark, sf)
    return H.commit_files_outer(x.h.commits, x.touches).select("commit_id", "ord", "path")


@register("highlight_commit", O.hist("""SELECT b.fileName, b.label,
  b.fileName IN (SELECT path FROM touches WHERE commit_seq = (SELECT max(commit_seq) FROM commits)) AS highlighted
FROM buildings b"""))
def q_highlight_commit(spark, sf):
    x = _Hist(spark, sf)
    from ..operators.lookups import highlight_commit
    last = x.h.commits.agg(F.max_by("commit_id", "commit_seq")).first()[0]
    return highlight_commit(x.buildings(), x.touches, last).select("fileName", "label", "highlighted")


@register("highlight_commit_none", O.hist("SELECT fileName, label, false AS highlighted FROM buildings"))
def q_highlight_commit_none(spark, sf):
    from ..operators.lookups import highlight_commit
    x = _Hist(spark, sf)
    return highlight_commit(x.buildings(), x.touches, "None").select("fileName", "label", "highlighted")


@register("select_city", O.hist("""SELECT fileName, height FROM buildings WHERE label = 3"""))
def q_select_city(spark, sf):
    from ..operators.lookups import select_city
    files, _ = select_city(_Hist(spark, sf).buildings(), None, 3)
    return files.select("fileName", "height")


@register("select_city_routes", O.hist("""SELECT "start", "end", width FROM routes WHERE "start" = 3 OR "end" = 3"""))
def q_select_city_routes(spark, sf):
    from ..operators.lookups import select_city
    x = _Hist(spark, sf)
    return select_city(x.buildings(), x.routes(), 3)[1]


@register("route_endpoints", O.hist("""SELECT r."start", r."end", r.width, round(s.x, 6) AS start_x, round(s.y, 6) AS start_y,
  round(e.x, 6) AS end_x, round(e.y, 6) AS end_y
FROM routes r JOIN cities s ON s.label = r."start" JOIN cities e ON e.label = r."end" """))
def q_route_endpoints(spark, sf):
    x = _Hist(spark, sf)
    j = G.route_endpoints(x.routes(), x.cities())
    return j.select("start", "end", "width", *[r6(c).alias(c) for c in ("start_x", "start_y", "end_x", "end_y")])


# ---- 2.4 aggregations ------------------------------------------------------------------------

@register("rename_map", O.hist("SELECT old_path, new_path FROM renames"))
def q_rename_map(spark, sf):
    return H.rename_map(B.events_history(spark, sf).modifications)


@register("incidence_long", O.hist("SELECT path, commit_seq FROM inc"))
def q_incidence_long(spark, sf):
    return _Hist(spark, sf).inc


@register("file_heights", O.hist("SELECT path, height FROM heights"))
def q_file_heights(spark, sf):
    return _Hist(spark, sf).heights


@register("commit_to_files", O.hist("SELECT commit_id, ord, path FROM touches"))
def q_commit_to_files(spark, sf):
    return H.commit_to_files(_Hist(spark, sf).touches).select("commit_id", "ord", "path")


@register("file_dates", O.hist(f"""SELECT path, strftime(creation_date, {O.TS}) AS creation_date,
  strftime(last_modification, {O.TS}) AS last_modification FROM file_dates"""))
def q_file_dates(spark, sf):
    d = _Hist(spark, sf).dates()
    return d.select("path", ts("creation_date").alias("creation_date"), ts("last_modification").alias("last_modification"))


@register("history_counts", O.hist("SELECT (SELECT count(*) FROM live) AS number_files, (SELECT count(*) FROM commits) AS total_commits"))
def q_history_counts(spark, sf):
    h = B.events_history(spark, sf)
    return H.history_counts(H.live_files(h.files), h.commits)


@register("vocabulary", O.with_(O.CORPUS) + "SELECT word, row_number() OVER (ORDER BY word) - 1 AS idx FROM (SELECT DISTINCT word FROM tokens)")
def q_vocabulary(spark, sf):
    return with_global_index(_counts(spark, sf).select("word").distinct(), [F.col("word")], name="idx")


def _counts(spark, sf):
    return T.word_counts(B.corpus(spark, sf), stem=False)


@register("term_frequency", O.with_(O.CORPUS) + "SELECT path, word, round(tf, 6) AS tf FROM tf")
def q_term_frequency(spark, sf):
    return S.term_frequency(_counts(spark, sf)).select("path", "word", r6("tf").alias("tf"))


@register("inverse_doc_frequency", O.with_(O.CORPUS) + "SELECT word, df, round(idf, 6) AS idf FROM idf")
def q_inverse_doc_frequency(spark, sf):
    return S.inverse_doc_frequency(_counts(spark, sf), B.corpus(spark, sf)).select("word", "df", r6("idf").alias("idf"))


@register("tf_idf", O.with_(O.CORPUS) + "SELECT path, word, round(w, 6) AS w FROM tfidf")
def q_tf_idf(spark, sf):
    return S.tf_idf(_counts(spark, sf), B.corpus(spark, sf)).select("path", "word", r6("w").alias("w"))


@register("cluster_members", O.hist("SELECT DISTINCT label, path FROM clusters"))
def q_cluster_members(spark, sf):
    return G.cluster_members(_Hist(spark, sf).clusters())


@register("centroids", O.hist("SELECT label, round(x, 6) AS x, round(y, 6) AS y FROM cents"))
def q_centroids(spark, sf):
    x = _Hist(spark, sf)
    return G.centroids(x.layout(), x.clusters()).select("label", r6("x").alias("x"), r6("y").alias("y"))


@register("centroids_normalized", O.hist("SELECT label, round(x, 6) AS x, round(y, 6) AS y FROM cities"))
def q_centroids_normalized(spark, sf):
    return _Hist(spark, sf).cities().select("label", r6("x").alias("x"), r6("y").alias("y"))


@register("min_max_height", O.hist("SELECT min(height) AS min_height, greatest(0, max(height)) AS max_height FROM buildings"))
def q_min_max_height(spark, sf):
    return L.min_max_height(_Hist(spark, sf).buildings())


@register("min_max_date", O.hist(f"""SELECT strftime(min(creation_date), {O.TS}) AS min_date, strftime(max(creation_date), {O.TS}) AS max_date FROM file_dates"""))
def q_min_max_date(spark, sf):
    m = L.min_max_date(_Hist(spark, sf).dates(), "creation_date")
    return m.select(ts("min_date").alias("min_date"), ts("max_date").alias("max_date"))


@register("max_route_width", O.hist('SELECT coalesce(max(width), 0) AS max_width FROM routes WHERE "start" < "end"'))
def q_max_route_width(spark, sf):
    from ..operators.lookups import max_route_width
    return max_route_width(G.undirected_routes(_Hist(spark, sf).routes()))


# ---- 2.5 pairwise metrics ---------------------------------------------------------------------

_JACCARD_SQL = O.hist("""SELECT x.path AS a, y.path AS b, count(*) AS n_common, any_value(hx.height) AS height_a, any_value(hy.height) AS height_b,
  round(count(*) / (any_value(hx.height) + any_value(hy.height) - count(*)), 6) AS similarity,
  round(1 - count(*) / (any_value(hx.height) + any_value(hy.height) - count(*)), 6) AS distance
FROM inc x JOIN inc y ON x.commit_seq = y.commit_seq AND x.path < y.path
JOIN heights hx ON hx.path = x.path JOIN heights hy ON hy.path = y.path GROUP BY 1, 2""")


def _jaccard_out(j: DataFrame) -> DataFrame:
    return j.select("a", "b", "n_common", "height_a", "height_b", r6("similarity").alias("similarity"),
                    r6("distance").alias("distance"))


@register("jaccard_distance", _JACCARD_SQL)
def q_jaccard_distance(spark, sf):
    return _jaccard_out(S.jaccard_pairs(_Hist(spark, sf).inc))


@register("cosine_similarity", O.with_(O.CORPUS) + "SELECT a, b, round(similarity, 6) AS similarity FROM cosine")
def q_cosine_similarity(spark, sf):
    w = S.tf_idf(_counts(spark, sf), B.corpus(spark, sf))
    return S.cosine_pairs(w).select("a", "b", r6("similarity").alias("similarity"))


@register("cosine_similarity_above", O.with_(O.CORPUS) + "SELECT a, b, round(similarity, 6) AS similarity FROM cosine WHERE similarity >= 0.4")
def q_cosine_similarity_above(spark, sf):
    w = S.tf_idf(_counts(spark, sf), B.corpus(spark, sf))
    return S.cosine_pairs(w, minimum=0.4).select("a", "b", r6("similarity").alias("similarity"))


@register("cosine_top_k", O.with_(O.CORPUS, """
near AS (SELECT a AS path, b AS other, round(similarity, 9) AS s FROM cosine UNION ALL SELECT b, a, round(similarity, 9) FROM cosine),
ranked AS (SELECT path, other, s, row_number() OVER (PARTITION BY path ORDER BY s DESC, other) AS rank FROM near)""") + """
SELECT path, rank, other, round(s, 6) AS similarity FROM ranked WHERE rank <= 5""")
def q_cosine_top_k(spark, sf):
    w = S.tf_idf(_counts(spark, sf), B.corpus(spark, sf))
    return S.cosine_top_k(w, 5).select("path", "rank", "other", r6("similarity").alias("similarity"))


@register("cosine_vectors", O.with_(O.POINTS) + """SELECT x.path AS a, y.path AS b,
  round(list_dot_product(x.v, y.v) / (sqrt(list_dot_product(x.v, x.v)) * sqrt(list_dot_product(y.v, y.v))), 6) AS cosine
FROM pts x JOIN pts y ON y.vec_id = x.vec_id + 1""")
def q_cosine_vectors(spark, sf):
    e = B.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    x = e.select(F.col("vec_id").alias("i"), F.col("v").alias("va"))
    y = e.select((F.col("vec_id") - 1).alias("i"), F.col("v").alias("vb"), F.col("vec_id").alias("j"))
    name = lambda c: F.concat(F.lit("vec_"), F.format_string("%05d", c))
    return x.join(y, "i").select(name(F.col("i")).alias("a"), name(F.col("j")).alias("b"),
                                 r6(S.cosine_vectors(F.col("va"), F.col("vb"))).alias("cosine"))


# ---- 2.8 map tables -------------------------------------------------------------------------------

@register("undirected_routes", O.hist('SELECT "start", "end", width FROM routes WHERE "start" < "end"'))
def q_undirected_routes(spark, sf):
    return G.undirected_routes(_Hist(spark, sf).routes())


_GRID_SQL = O.hist(r"""
, cnt AS (SELECT label, count(*) AS n FROM buildings GROUP BY label),
fac(n, rem, d, fs) AS (
  SELECT DISTINCT n, n, 2, []::BIGINT[] FROM cnt
  UNION ALL
  SELECT n, CASE WHEN rem % d = 0 THEN rem // d ELSE rem END, CASE WHEN rem % d = 0 THEN d ELSE d + 1 END,
         CASE WHEN rem % d = 0 THEN list_append(fs, d) ELSE fs END
  FROM fac WHERE rem >= 2),
done AS (SELECT n, fs FROM fac WHERE rem < 2),
fold(n, fs, i, w, h) AS (
  SELECT n, fs, len(fs), 1::BIGINT, 1::BIGINT FROM done
  UNION ALL
  SELECT n, fs, i - 1, CASE WHEN w <= h THEN w * fs[i] ELSE w END, CASE WHEN w <= h THEN h ELSE h * fs[i] END
  FROM fold WHERE i >= 1),
dims AS (SELECT n, w, h FROM fold WHERE i = 0)
SELECT c.label, c.n AS n_buildings, d.w AS grid_w, d.h AS grid_h,
  CAST(d.w * 10.0 + (d.w + 1) * 2.0 AS DOUBLE) AS ground_width,
  CAST(d.h * 10.0 + (d.h + 1) * 2.0 AS DOUBLE) AS ground_length
FROM cnt c JOIN dims d USING (n)""")


@register("city_grid_dims", f"SELECT label, n_buildings, grid_w, grid_h FROM ({_GRID_SQL})")
def q_city_grid_dims(spark, sf):
    return L.city_grid_dims(_Hist(spark, sf).buildings())


@register("city_ground_size", f"SELECT label, grid_w, grid_h, ground_width, ground_length FROM ({_GRID_SQL})")
def q_city_ground_size(spark, sf):
    return L.city_ground_size(L.city_grid_dims(_Hist(spark, sf).buildings()))


_GRID_CTE = _GRID_SQL[:_GRID_SQL.rindex("SELECT c.label")] + """, ground AS (SELECT c.label, c.n AS n_buildings, d.w AS grid_w, d.h AS grid_h,
  CAST(d.w * 10.0 + (d.w + 1) * 2.0 AS DOUBLE) AS ground_width,
  CAST(d.h * 10.0 + (d.h + 1) * 2.0 AS DOUBLE) AS ground_length
  FROM cnt c JOIN dims d USING (n)),
pos AS (SELECT c.label, c.x * 200.0 AS pos_x, c.y * 200.0 AS pos_z, g.ground_width, g.ground_length
  FROM cities c JOIN ground g USING (label))
"""


@register("building_slots", _GRID_CTE + """SELECT b.label, b.fileName, b.height, b.slot,
  CAST(7.0 + 12.0 * (b.slot % g.grid_w) AS DOUBLE) AS x, CAST(7.0 + 12.0 * (b.slot // g.grid_w) AS DOUBLE) AS z
FROM (SELECT label, fileName, height, row_number() OVER (PARTITION BY label ORDER BY fileName) - 1 AS slot FROM buildings) b
JOIN ground g USING (label)""")
def q_building_slots(spark, sf):
    b = _Hist(spark, sf).buildings()
    return L.building_slots(b, L.city_grid_dims(b))


@register("city_positions", _GRID_CTE + """SELECT label, round(pos_x, 6) AS pos_x, round(pos_z, 6) AS pos_z,
  round(pos_x + ground_width / 2, 6) AS center_x, round(pos_z + ground_length / 2, 6) AS center_z FROM pos""")
def q_city_positions(spark, sf):
    x = _Hist(spark, sf)
    b = x.buildings()
    pos = L.city_positions(x.cities(), L.city_ground_size(L.city_grid_dims(b)))
    return pos.select("label", *[r6(c).alias(c) for c in ("pos_x", "pos_z", "center_x", "center_z")])


@register("overlapping_cities", _GRID_CTE + """SELECT p.label AS i, q.label AS j FROM pos p JOIN pos q ON p.label <> q.label
WHERE p.pos_x - 20 < q.pos_x + q.ground_width AND q.pos_x < p.pos_x - 20 + p.ground_width + 40
  AND p.pos_z - 20 < q.pos_z + q.ground_length AND q.pos_z < p.pos_z - 20 + p.ground_length + 40""")
def q_overlapping_cities(spark, sf):
    x = _Hist(spark, sf)
    b = x.buildings()
    pos = L.city_positions(x.cities(), L.city_ground_size(L.city_grid_dims(b)))
    return L.overlapping_cities(pos)


# ---- 2.9 windows, sorts, sets ----------------------------------------------------------------------

@register("hashes_newest_first", O.hist("""SELECT row_number() OVER (ORDER BY commit_seq DESC) AS pos, commit_id FROM commits
UNION ALL SELECT 0, 'None'"""))
def q_hashes_newest_first(spark, sf):
    return H.hashes_newest_first(B.events_history(spark, sf).commits)


@register("commit_rank", O.hist("SELECT commit_id, row_number() OVER (ORDER BY commit_seq) - 1 AS rank FROM commits"))
def q_commit_rank(spark, sf):
    return H.commit_rank(B.events_history(spark, sf).commits).select("commit_id", "rank")


@register("common_commits", O.hist("""SELECT commit_seq FROM inc JOIN clusters USING (path) WHERE label = 1
INTERSECT SELECT commit_seq FROM inc JOIN clusters USING (path) WHERE label = 2"""))
def q_common_commits(spark, sf):
    x = _Hist(spark, sf)
    return G.common_commits(x.inc, x.clusters(), 1, 2)


# ---- 2.6 clustering --------------------------------------------------------------------------------

_DBSCAN_EPS = 1.15  # pairwise distances of the embeddings: 0.1 % below 1.12, 5 % below 1.26

_DBSCAN_SQL = O.with_(O.POINTS, f"""
e AS (SELECT x.path AS a, y.path AS b FROM pts x JOIN pts y ON x.path < y.path
      WHERE list_distance(x.v, y.v) <= {_DBSCAN_EPS}),
both_dirs AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
core AS (SELECT DISTINCT a AS path FROM both_dirs),
reach(src, dst) AS (SELECT path, path FROM core UNION SELECT r.src, d.b FROM reach r JOIN both_dirs d ON r.dst = d.a),
comp AS (SELECT src AS path, min(dst) AS comp FROM reach GROUP BY src),
ranks AS (SELECT comp, CAST(dense_rank() OVER (ORDER BY comp) - 1 AS INTEGER) AS label FROM (SELECT DISTINCT comp FROM comp)),
lab AS (SELECT p.path, CAST(coalesce(r.label, -1) AS INTEGER) AS label
        FROM pts p LEFT JOIN comp c ON c.path = p.path LEFT JOIN ranks r ON r.comp = c.comp)""", recursive=True)


def _dbscan(spark, sf):
    from ..operators.clustering.dbscan import dbscan_points
    p = B.points(spark, sf).select("path", F.col("embedding").cast("array<double>").alias("v"))
    return dbscan_points(p, _DBSCAN_EPS, 2)


@register("cluster_dbscan", _DBSCAN_SQL + "SELECT path, label FROM lab")
def q_cluster_dbscan(spark, sf):
    return _dbscan(spark, sf)


@register("relabel_noise", _DBSCAN_SQL + """SELECT path, CAST(CASE WHEN label = -1
  THEN -row_number() OVER (PARTITION BY label = -1 ORDER BY path) ELSE label END AS INTEGER) AS label FROM lab""")
def q_relabel_noise(spark, sf):
    return G.relabel_noise(_dbscan(spark, sf), join_clusterless=False)


@register("cluster_average_linkage")
def q_cluster_average_linkage(spark, sf):
    from ..operators.clustering.average_linkage import average_linkage
    x = _Hist(spark, sf)
    return average_linkage(x.heights.select("path"), S.jaccard_pairs(x.inc), incidence=x.inc)


@register("average_linkage_invariant", O.hist("""SELECT count(*) AS n_files, count(*) AS n_labelled, CAST(0 AS BIGINT) AS n_mergeable FROM heights"""))
def q_average_linkage_invariant(spark, sf):
    """Every file has one label, and no two clusters are left whose mean
    similarity is above the cut."""
    from ..operators.clustering.average_linkage import THRESHOLD, average_linkage
    x = _Hist(spark, sf)
    labels = cut_lineage(average_linkage(x.heights.select("path"), S.jaccard_pairs(x.inc), incidence=x.inc))
    size = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    sums = S.jaccard_pairs(x.inc, groups=labels).select(F.col("u").alias("la"), F.col("v").alias("lb"), "w")
    na, nb = (size.select(F.col("label").alias(f"l{c}"), F.col("n").alias(f"n{c}")) for c in ("a", "b"))
    mean = F.col("w") / (F.col("na") * F.col("nb"))
    above = sums.join(na, "la").join(nb, "lb").where(mean > 1 - THRESHOLD + 1e-9).count()
    both = x.heights.select("path").join(labels.select(F.col("path").alias("labelled")), F.col("path") == F.col("labelled"), "full")
    return both.agg(F.countDistinct("path").alias("n_files"), F.countDistinct("labelled").alias("n_labelled")).withColumn("n_mergeable", F.lit(above).cast("long"))


# the embeddings are spread over the unit sphere (no two closer than 0.89), so
# the reference's own cuts (0.5 and 1) would merge nothing
_BIRCH_CUT, _WARD_CUT = 0.8, 1.4


def _points(spark, sf) -> DataFrame:
    return B.points(spark, sf).select("path", F.col("embedding").cast("array<double>").alias("v"))


def _birch(spark, sf) -> DataFrame:
    from ..operators.clustering.birch import birch
    return birch(_points(spark, sf), _BIRCH_CUT)


def _ward(spark, sf) -> DataFrame:
    from ..operators.clustering.ward import ward
    return ward(_points(spark, sf), _WARD_CUT)


@register("cluster_birch")
def q_cluster_birch(spark, sf):
    return _birch(spark, sf)


@register("cluster_ward")
def q_cluster_ward(spark, sf):
    return _ward(spark, sf)


def _cluster_stats(points: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, n, c, s): size, centre and sum of squared distances to it, from
    the points' coordinates."""
    rows = labels.join(points, "path").select("label", F.posexplode("v").alias("k", "x"))
    axes = rows.groupBy("label", "k").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("var"))
    return axes.groupBy("label").agg(
        F.max("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("k", "m"))), lambda x: x["m"]).alias("c"),
        F.sum(F.col("n") * F.col("var")).alias("s"))


def _agglomeration_view(points: DataFrame, labels: DataFrame, reach: float, mergeable, broken) -> DataFrame:
    """(n_points, n_labelled, merged, n_broken, n_mergeable): are all points
    labelled, is there a cluster of two, how many clusters break the rule, and
    how many pairs of clusters could still merge.  ``broken(n, s)`` and
    ``mergeable(na, nb, sa, sb, d)`` state the rule."""
    from ..operators.neighbors import radius_pairs
    labels = cut_lineage(labels)
    stats = cut_lineage(_cluster_stats(points, labels))
    near = radius_pairs(stats.select(F.col("label").alias("path"), F.col("c").alias("v")), reach)
    one, two = (stats.select(F.col("label").alias(x), F.col("n").alias(f"n{x}"), F.col("s").alias(f"s{x}")) for x in "ab")
    left = near.join(one, "a").join(two, "b").where(mergeable(F.col("na"), F.col("nb"), F.col("sa"), F.col("sb"), F.col("dist"))).count()
    seen = stats.agg((F.max("n") > 1).alias("merged"), F.count_if(broken(F.col("n"), F.col("s"))).alias("n_broken"))
    both = points.select("path").join(labels.select(F.col("path").alias("labelled")), F.col("path") == F.col("labelled"), "full")
    counted = both.agg(F.countDistinct("path").alias("n_points"), F.countDistinct("labelled").alias("n_labelled"))
    return counted.join(F.broadcast(seen)).withColumn("n_mergeable", F.lit(left).cast("long"))  # one row each


_AGGLOMERATION_SQL = "SELECT count(*) AS n_points, count(*) AS n_labelled, true AS merged, CAST(0 AS BIGINT) AS n_broken, CAST(0 AS BIGINT) AS n_mergeable FROM embeddings"


@register("birch_invariant", _AGGLOMERATION_SQL)
def q_birch_invariant(spark, sf):
    """No subcluster's radius is above the threshold, and no two subclusters
    with centres two thresholds apart or less could merge within it."""
    t = _BIRCH_CUT
    fits = lambda na, nb, sa, sb, d: (sa + sb + na * nb / (na + nb) * d * d) / (na + nb) <= t * t * (1 - 1e-6)
    return _agglomeration_view(_points(spark, sf), _birch(spark, sf), 2 * t, fits, lambda n, s: s / n > t * t * (1 + 1e-6))


@register("ward_invariant", _AGGLOMERATION_SQL)
def q_ward_invariant(spark, sf):
    """No two clusters are left whose Ward distance is below the cut; a
    cluster's own height is at most that of its last merge, so below the cut
    its scatter is at most (n - 1) / 2 times the cut squared."""
    t = _WARD_CUT
    near = lambda na, nb, sa, sb, d: F.sqrt(2 * na * nb / (na + nb)) * d < t * (1 - 1e-6)
    return _agglomeration_view(_points(spark, sf), _ward(spark, sf), t, near, lambda n, s: s > (n - 1) / 2 * t * t * (1 + 1e-6))


# ---- 2.7 embeddings ------------------------------------------------------------------------------

@register("embed_tsne")
def q_embed_tsne(spark, sf):
    from ..operators.embedding.tsne import neighbours, tsne
    x = _Hist(spark, sf)
    return tsne(x.heights.select("path"), S.jaccard_pairs(x.inc, nearest=neighbours()))


@register("tsne_invariant", O.hist("""SELECT count(*) AS n_files, count(*) AS n_placed, true AS neighbours_nearer FROM heights"""))
def q_tsne_invariant(spark, sf):
    """Every file has a finite place, and files that are neighbours by
    distance lie nearer to each other than the mean pair of files does (the
    mean squared distance of all pairs is twice the variance)."""
    from ..operators.embedding.common import id_pairs, indexed
    from ..operators.embedding.tsne import nearest_pairs, neighbours, tsne
    x = _Hist(spark, sf)
    files = x.heights.select("path")
    pairs = cut_lineage(S.jaccard_pairs(x.inc, nearest=neighbours()))
    places = cut_lineage(tsne(files, pairs))
    ids = indexed(files)
    near = nearest_pairs(ids, id_pairs(ids, pairs, "distance"), ids.count(), 3, 0).where("val < 1")
    at = ids.join(places, "path")
    one, two = (at.select(F.col("id").alias(k), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}")) for k in "ij")
    d = near.join(one, "i").join(two, "j").agg(F.avg((F.col("xi") - F.col("xj")) ** 2 + (F.col("yi") - F.col("yj")) ** 2).alias("near"))
    spread = places.agg((2 * (F.var_samp("x") + F.var_samp("y"))).alias("mean"))
    finite = places.where("not isnan(x) and not isnan(y) and abs(x) < 1e6 and abs(y) < 1e6")
    counted = files.agg(F.count(F.lit(1)).alias("n_files")).join(F.broadcast(finite.agg(F.countDistinct("path").alias("n_placed"))))
    return counted.join(F.broadcast(d.join(F.broadcast(spread)).select((F.col("near") < F.col("mean")).alias("neighbours_nearer"))))  # one row each


@register("embed_mca")
def q_embed_mca(spark, sf):
    from ..operators.embedding.mca import mca
    return mca(_Hist(spark, sf).inc)


@register("mca_invariant", O.hist("""SELECT count(*) AS n_files, count(*) AS n_placed, true AS centred, true AS orthogonal, true AS ordered, true AS within FROM heights"""))
def q_mca_invariant(spark, sf):
    """The axes are centred and orthogonal, the first carries at least the
    inertia of the second, and both together at most the whole (the mean squared
    distance from the centre is 1 with all axes)."""
    from ..operators.embedding.mca import mca
    x = _Hist(spark, sf)
    out = mca(x.inc).select("path", "x", "y")
    both = x.heights.select("path").join(out.withColumnRenamed("path", "placed"), F.col("path") == F.col("placed"), "full")
    sums = both.agg(
        F.countDistinct("path").alias("n_files"), F.countDistinct("placed").alias("n_placed"), F.avg("x").alias("mx"), F.avg("y").alias("my"),
        F.avg(F.col("x") * F.col("x")).alias("xx"), F.avg(F.col("y") * F.col("y")).alias("yy"), F.avg(F.col("x") * F.col("y")).alias("xy"))
    return sums.select(
        "n_files", "n_placed", ((F.abs("mx") < 1e-6) & (F.abs("my") < 1e-6)).alias("centred"), (F.abs("xy") <= 1e-6 * F.col("xx")).alias("orthogonal"),
        (F.col("xx") >= F.col("yy") * (1 - 1e-9)).alias("ordered"), ((F.col("yy") > 0) & (F.col("xx") + F.col("yy") <= 1 + 1e-9)).alias("within"))


# ---- results, log loader, composed maps -----------------------------------------------

def _scratch(spark, name: str) -> str:
    import uuid
    from ..session import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}/{uuid.uuid4().hex}"


def _quick_result(spark, sf):
    """A map result over the folder clusters (no embedding run), for the I/O operators."""
    from ..plans.maps import _tail
    x = _Hist(spark, sf)
    return _tail(x.h, x.touches, x.inc, x.clusters(), x.layout())


@register("write_result", O.hist("SELECT label, fileName, height, round(x, 6) AS x, round(y, 6) AS y FROM buildings JOIN cities USING (label)"))
def q_write_result(spark, sf):
    from ..sources.results import read_result, write_result
    folder = _scratch(spark, "results")
    write_result(_quick_result(spark, sf), folder, write_json=True)
    back = read_result(spark, folder)
    return back.buildings.join(back.cities, "label").select("label", "fileName", "height", r6("x").alias("x"),
                                                            r6("y").alias("y"))


@register("save_result", O.hist("""SELECT "start", "end", width, 'logical' AS couplings, 'events' AS repo FROM routes"""))
def q_save_result(spark, sf):
    from ..sources.results import save_result
    root = _scratch(spark, "saved")
    save_result(_quick_result(spark, sf), root, "logical", "events")
    return spark.read.parquet(f"{root}/routes")


@register("load_result", O.hist('SELECT "start", "end", width FROM routes'))
def q_load_result(spark, sf):
    from ..sources.results import load_result, save_result
    root = _scratch(spark, "saved")
    save_result(_quick_result(spark, sf), root, "logical", "events")
    return load_result(spark, root, "logical", "events").routes


@register("load_history_log", O.hist("""SELECT commit_seq, ord, old_path, new_path FROM (
  SELECT commit_seq, row_number() OVER (PARTITION BY commit_seq ORDER BY ord) - 1 AS ord, old_path, new_path FROM mods)
WHERE old_path IS NOT NULL OR new_path IS NOT NULL"""))
def q_load_history_log(spark, sf):
    from ..sources.history import load_history_log, write_history_log
    folder = _scratch(spark, "logs")
    write_history_log(B.events_history(spark, sf), folder)
    return load_history_log(spark, folder).modifications


def _map_view(res) -> DataFrame:
    return res.buildings.join(res.cities, "label").select(
        "label", "fileName", "height", r6("x").alias("x"), r6("y").alias("y"))


@register("logical_map")
def q_logical_map(spark, sf):
    from ..plans.maps import logical_map
    return _map_view(logical_map(B.events_history(spark, sf)))


@register("semantic_map")
def q_semantic_map(spark, sf):
    from ..plans.maps import semantic_map
    # the test texts are prose, so identifiers come from the regex mode
    return _map_view(semantic_map(B.events_history(spark, sf), B.events_sources(spark, sf), mode="regex"))


@register("couplings_map")
def q_couplings_map(spark, sf):
    from ..plans.maps import couplings_map
    return couplings_map(None, B.events_history(spark, sf)).routes


@register("couplings_map_semantic")
def q_couplings_map_semantic(spark, sf):
    from ..plans.maps import couplings_map
    return couplings_map("semantic", B.events_history(spark, sf), B.events_sources(spark, sf), mode="regex").routes
