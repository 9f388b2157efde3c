"""DuckDB text of the queries that SQL can state on whole tables."""

from .licenses import BASE_PHRASES, RARE, TEMPLATES, words_of

SQL: dict[str, str] = {}

SQL["op9_line_dedup"] = r"""
WITH lines AS (
  SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (
  SELECT doc_id, pos, line,
         translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), dup AS (
  SELECT key, min(doc_id) AS first_doc FROM keyed WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT k.doc_id, k.pos, k.line, (d.key IS NOT NULL AND d.first_doc <> k.doc_id) AS gone
  FROM keyed k LEFT JOIN dup d ON d.key = k.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

SQL["op2_decontaminate"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), wins AS (
  SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS k
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)
), lens AS (SELECT DISTINCT n FROM wins), pos AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)
), hits AS (
  SELECT p.doc_id, p.i, p.n, w.item FROM pos p JOIN wins w ON w.n = p.n AND w.k = p.k
), words AS (
  SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS x FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def _safe(text: str) -> str:
    """The chat template's escapes as nested DuckDB calls."""
    for plain, escaped in (("&", "&amp;"), ("<|", "&lt;|"), ("<s>", "&lt;s>"), ("</s>", "&lt;/s>"), ("[INST]", "&#91;INST]"), ("[/INST]", "&#91;/INST]"), ("<<SYS>>", "&lt;<SYS>>")):
        text = f"replace({text}, '{plain}', '{escaped}')"
    return text


SQL["op8_chat_format"] = rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, length({_safe('text')}) + length({_safe("replace(role, chr(10), '&#10;')")}) + 17 AS size,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM rows
), summed AS (
  SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM sized
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY k)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(upto) FILTER (WHERE role = 'assistant' OR k = n) AS BIGINT) AS formatted_chars
FROM summed GROUP BY conv_id
"""


SQL["op7_quality_rules"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
wins AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
twice AS (SELECT doc_id, k FROM wins GROUP BY doc_id, k HAVING count(*) > 1),
covered AS (
  SELECT doc_id, count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS x FROM wins JOIN twice USING (doc_id, k)) GROUP BY doc_id
), lines AS (
  SELECT doc_id, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
), worded AS (
  SELECT doc_id, line, len(w) AS n, w, (length(line) - length(replace(line, '|', ''))) AS pipes,
         length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g')) AS symbols,
         strlen(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS solid,
         ((length(line) - length(replace(line, '!!', ''))) + (length(line) - length(replace(line, '??', ''))) + (length(line) - length(replace(line, ',,', '')))) // 2 AS marks,
         coalesce(list_sum(list_transform(range(1, len(w)), lambda i: CAST(w[i] = w[i + 1] AS INTEGER))), 0) AS stutter,
         length(line) - length(regexp_replace(line, '[A-Z]', '', 'g')) AS upper,
         length(line) - length(regexp_replace(line, '[a-z]', '', 'g')) AS low
  FROM lines WHERE len(w) > 0
), judged AS (
  SELECT doc_id, line, n,
         (pipes >= 3 AND 4 * pipes >= n) OR 10 * symbols > solid OR (n >= 3 AND 10 * marks > 3 * n) OR (n >= 5 AND 2 * stutter > n)
         OR (n >= 5 AND upper > 4 * low AND 2 * upper > strlen(line) - n)
         OR (n <= 40 AND regexp_matches(lower(line), 'all rights reserved|terms of (use|service)|privacy policy|cookie policy|accept (all )?cookies|enable javascript|lorem ipsum|skip to (main )?content|sign up for our newsletter|click here to|share (this )?on (facebook|twitter)|back to top|powered by wordpress')) AS bad
  FROM worded
), lost AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup, coalesce(sum(n) FILTER (WHERE bad), 0) AS lost FROM judged GROUP BY doc_id
), base AS (
  SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(length(array_to_string(d.w, '')) AS BIGINT) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup, 0) AS n_dup_lines,
         coalesce(covered.n, 0) AS n_repeat_words, coalesce(lost.lost, 0) AS lost
  FROM d LEFT JOIN lost USING (doc_id) LEFT JOIN covered USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 100 * lost <= 50 * n_words AS kept
FROM base
"""


SQL["op10_jaccard_join"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, k FROM (
    SELECT doc_id, array_to_string(w[i:i + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM words WHERE len(w) >= 5)
    UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM words WHERE len(w) BETWEEN 1 AND 4)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM shingles a JOIN shingles b ON a.k = b.k AND a.doc_id <> b.doc_id
  JOIN sizes sa ON sa.doc_id = a.doc_id JOIN sizes sb ON sb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, sa.n, sb.n HAVING 180 * count(*) >= 80 * (sa.n + sb.n)
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y
), least AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, l.component_id
FROM documents d JOIN least l USING (doc_id) LEFT JOIN sizes s USING (doc_id)
"""


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _field(value: str) -> str:
    return f"coalesce(concat(strlen(CAST({value} AS VARCHAR)), ':', CAST({value} AS VARCHAR)), '-')"


def _merkle_levels(name: str, levels: int) -> str:
    """CTEs {name}0..{name}N (grp, r, h) and {name}_steps (grp, r, k, left, right):
    a level's runs of 16 are hashed while the group has more than one node."""
    out = []
    for k in range(levels):
        out.append(f"""{name}{k + 1} AS (
  SELECT grp, r // 16 AS r, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY r)) ELSE any_value(h) END AS h
  FROM (SELECT *, count(*) OVER (PARTITION BY grp) AS n FROM {name}{k}) GROUP BY grp, r // 16)""")
        out.append(f"""{name}_step{k} AS (
  SELECT grp, r, n,
         coalesce(string_agg(h, '') OVER (PARTITION BY grp, r // 16 ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lft,
         coalesce(string_agg(h, '') OVER (PARTITION BY grp, r // 16 ORDER BY r ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rgt
  FROM (SELECT *, count(*) OVER (PARTITION BY grp) AS n FROM {name}{k}))""")
    return ",\n".join(out)


def _merkle_sql(levels: int = 6) -> str:
    """Up to 16 ** levels rows per source, and sources."""
    leaf = "sha256(concat(" + ", ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars")) + ", {}))"
    text, low = _field("text"), _field("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
    fold, proof, joins = "CASE WHEN crc % 5 = 0 THEN tampered ELSE leaf END", [], []
    for name, rank in (("d", "l.r"), ("s", "g.r")):
        for k in range(levels):
            alias = f"{name}{k}_"
            joins.append(f"JOIN {name}_step{k} {alias} ON {alias}.r = {rank} // {16 ** k} AND {alias}.grp IS NOT DISTINCT FROM {'l.grp' if name == 'd' else '0'}")
            proof.append(f"CASE WHEN {alias}.n > 1 THEN {alias}.lft || {alias}.rgt ELSE '' END")
    steps = [f"{name}{k}_" for name in "ds" for k in range(levels)]
    folds, last = [], "f0"
    for i, alias in enumerate(steps):
        folds.append(f"q{i + 1} AS (SELECT *, CASE WHEN n{i} > 1 THEN sha256(concat(l{i}, f{i}, r{i})) ELSE f{i} END AS f{i + 1} FROM q{i})")
        last = f"f{i + 1}"
    picked = ", ".join(f"{alias}.n AS n{i}, {alias}.lft AS l{i}, {alias}.rgt AS r{i}" for i, alias in enumerate(steps))
    return f"""
WITH rows AS (
  SELECT doc_id, source AS grp, {leaf.format(text)} AS leaf, {leaf.format(low)} AS tampered,
         list_reduce([4294967295] || list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ord(substr(CAST(doc_id AS VARCHAR), i, 1)) AS BIGINT)),
           lambda c, b: list_reduce([xor(c, b)] || range(8), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))) AS crc_raw
  FROM documents
), leaves AS (
  SELECT *, 4294967295 - crc_raw AS crc, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf, tampered) - 1 AS r FROM rows
), d0 AS (SELECT grp, r, leaf AS h FROM leaves),
{_merkle_levels("d", levels)},
groups AS (SELECT grp, h, row_number() OVER (ORDER BY grp NULLS FIRST) - 1 AS r FROM d{levels}),
s0 AS (SELECT 0 AS grp, r, h FROM groups),
{_merkle_levels("s", levels)},
q0 AS (
  SELECT l.doc_id, l.leaf, g.h AS subroot, top.h AS root, {fold} AS f0, sha256(concat({", ".join(proof)})) AS proof_sha256, {picked}
  FROM leaves l JOIN groups g ON g.grp IS NOT DISTINCT FROM l.grp CROSS JOIN s{levels} top {" ".join(joins)}
), {", ".join(folds)}
SELECT doc_id, leaf, subroot, root, proof_sha256, {last} AS folded_root, {last} = root AS verified FROM q{len(steps)}
"""


SQL["op11_merkle_manifest"] = _merkle_sql()


def _license_sql() -> str:
    q = lambda text: "'" + text.replace("'", "''") + "'"
    listed = ", ".join(f"({t}, {p}, {q(w)})" for t, (_, notice, _) in enumerate(TEMPLATES) for p, w in enumerate(words_of(notice)))
    labels = ", ".join(f"({t}, {q(label)}, {len(words_of(notice))})" for t, (label, notice, _) in enumerate(TEMPLATES))
    musts = ", ".join(f"({t}, {q(' ' + p + ' ')})" for t, (_, _, must) in enumerate(TEMPLATES) for p in must)
    base = " UNION ALL ".join(
        f"SELECT doc_id, unnest(list_filter(range(len(w)), lambda i: array_to_string(w[i + 1:i + {len(words_of(p))}], ' ') = {q(p)})) AS place, {q(label)} AS label FROM d"
        for p, label in BASE_PHRASES)
    return rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
notice(t, p, word) AS (VALUES {listed}), template(t, label, n) AS (VALUES {labels}), must(t, phrase) AS (VALUES {musts}),
base AS ({base}),
bases AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS labels FROM base GROUP BY doc_id),
hits AS (SELECT doc_id, w[i + 1] AS word, i FROM (SELECT doc_id, w, unnest(range(len(w))) AS i FROM d) WHERE w[i + 1] IN (SELECT word FROM notice)),
df AS (SELECT word, count(DISTINCT doc_id) AS df FROM hits GROUP BY word),
rare AS (
  SELECT t, word FROM (SELECT t, word, row_number() OVER (PARTITION BY t ORDER BY coalesce(df, 0), word) AS k
    FROM (SELECT DISTINCT t, word FROM notice) LEFT JOIN df USING (word)) WHERE k <= {RARE}
), postings AS (SELECT t, p, word FROM notice JOIN rare USING (t, word)),
needed AS (SELECT t, greatest(2, (count(*) + 1) // 2) AS least FROM postings GROUP BY t),
placed AS (
  SELECT doc_id, t, i - p AS place FROM hits JOIN postings USING (word) JOIN needed USING (t)
  GROUP BY doc_id, t, i - p, least HAVING count(*) >= least
), verified AS (
  SELECT doc_id, t, place FROM placed JOIN d USING (doc_id)
  WHERE NOT EXISTS (SELECT 1 FROM must WHERE must.t = placed.t AND NOT contains(concat(' ', array_to_string(d.w, ' '), ' '), must.phrase))
), shares AS (
  SELECT v.doc_id, template.label, (SELECT count(*) FROM notice JOIN hits ON hits.doc_id = v.doc_id AND hits.i = v.place + notice.p AND hits.word = notice.word WHERE notice.t = v.t) / template.n AS share
  FROM verified v JOIN template USING (t)
), found AS (SELECT doc_id, list(DISTINCT label) AS labels, max(share) AS share FROM shares GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       array_to_string(list_sort(coalesce(bases.labels, [])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(bases.labels, []), coalesce(found.labels, [])))), ',') AS labels,
       CAST(coalesce(share, CASE WHEN n_base > 0 THEN 0.5 ELSE 0.0 END) AS DOUBLE) AS score
FROM d LEFT JOIN bases USING (doc_id) LEFT JOIN found USING (doc_id)
"""


SQL["op12_license_scan"] = _license_sql()


SQL["op13_collocations"] = rf"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOW}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
), grams AS (
  SELECT lang, k AS len, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, range(1, 6) AS sizes(k) WHERE len(w) >= k)
), totals AS (SELECT lang, count(*) AS n FROM grams WHERE len = 1 GROUP BY lang),
known AS (SELECT lang, len, phrase, count(*) AS f FROM grams GROUP BY lang, len, phrase HAVING count(*) >= 100),
candidates AS (SELECT lang, len, phrase, f AS a, string_split(phrase, ' ') AS w FROM known WHERE len > 1),
cuts AS (
  SELECT c.lang, c.phrase, c.a, k, x.f AS l, y.f AS r, n, (1000::HUGEINT * c.a * n) // (x.f::HUGEINT * y.f) AS score
  FROM (SELECT *, unnest(range(1, len)) AS k FROM candidates) c
  JOIN known x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:k], ' ')
  JOIN known y ON y.lang = c.lang AND y.phrase = array_to_string(w[k + 1:], ' ')
  JOIN totals t ON t.lang = c.lang
), best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS i FROM cuts) WHERE i = 1),
inside AS (
  SELECT lang, array_to_string(w[s:s + m - 1], ' ') AS phrase, max(a) AS most
  FROM (SELECT *, unnest(range(1, len - m + 2)) AS s FROM (SELECT *, unnest(range(2, len)) AS m FROM candidates WHERE len > 2)) GROUP BY 1, 2
), ranked AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
  FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase WHERE most IS NULL OR 100 * most < 100 * a
)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000
"""
