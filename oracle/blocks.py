"""Shared SQL blocks of the reference statements (DuckDB dialect)."""

from __future__ import annotations

from lexivane.functions.text import ACCENTED, PLAIN, WORD_CHARS
from lexivane.sources.vocabulary import CLUSTER_ONSETS, CODAS, DIGRAPH_VOWELS, DIPHTHONGS, SIMPLE_ONSETS, VOWELS

STRONG = "aàáâãeéêoóôõü"
ACUTE = "íú"
ANY_VOWEL = STRONG + "iu" + ACUTE
OTHER = f"[^{ANY_VOWEL}| ]"
UNITS = {"qu": 57344, "ch": 57345, "lh": 57346, "nh": 57347}
GU = 57348


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def rx(source: str, pattern: str, replacement: str) -> str:
    return f"regexp_replace({source}, {text(pattern)}, {text(replacement)}, 'g')"


def twice(source: str, pattern: str, replacement: str) -> str:
    return rx(rx(source, pattern, replacement), pattern, replacement)


def plain(source: str) -> str:
    return f"translate({source}, '{ACCENTED}', '{PLAIN}')"


def accented_line(source: str) -> str:
    s = f"trim({rx(f'lower({source})', f'[^{WORD_CHARS}]+', ' ')})"
    for pair, code in UNITS.items():
        s = f"replace({s}, '{pair}', chr({code}))"
    s = rx(s, "gu([eéêií])", chr(GU) + "\\1")
    s = twice(s, f"([{STRONG}])([{STRONG}{ACUTE}])", "\\1|\\2")
    s = twice(s, f"([{ACUTE}])([{ANY_VOWEL}])", "\\1|\\2")
    s = twice(s, f"([iu])([{ACUTE}])", "\\1|\\2")
    s = twice(s, f"([{ANY_VOWEL}])({OTHER}*?)([bcdfgptv][lr]|{OTHER})([{ANY_VOWEL}])", "\\1\\2|\\3\\4")
    for pair, code in UNITS.items():
        s = f"replace({s}, chr({code}), '{pair}')"
    return f"replace({s}, chr({GU}), 'gu')"


def line(source: str) -> str:
    return plain(accented_line(source))


def words_of(line_sql: str) -> str:
    return f"list_filter(string_split({line_sql}, ' '), lambda w: w <> '')"


def syllables_of(line_sql: str) -> str:
    return f"list_filter(string_split(replace({line_sql}, '|', ' '), ' '), lambda w: w <> '')"


def soundex(source: str) -> str:
    """Phonetic code of a word of plain letters."""
    codes = "translate({}, 'abcdefghijklmnopqrstuvwxyz', '01230120022455012623010202')"
    first = f"substr({source}, 1, 1)"
    rest = f"translate(substr({source}, 2), 'hw', '')"
    s = codes.format(f"({first} || {rest})")
    for digit in "0123456":
        s = rx(s, f"{digit}+", digit)
    digits = f"replace(substr({s}, 2), '0', '')"
    return f"CASE WHEN {source} = '' THEN '' ELSE upper({first}) || rpad(substr({digits}, 1, 3), 3, '0') END"


def _rows(values: list[str]) -> str:
    return ", ".join(f"({i}, {text(v)})" for i, v in enumerate(values))


def vocab() -> str:
    onsets = [(c, VOWELS) for c in SIMPLE_ONSETS] + list(DIGRAPH_VOWELS.items()) + [(c, VOWELS) for c in CLUSTER_ONSETS]
    onset_rows = ", ".join(f"({i}, '{o}', '{v}')" for i, (o, v) in enumerate(onsets))
    return f"""
onsets(i, o, vs) AS (VALUES {onset_rows}),
codas(k, c) AS (VALUES {_rows(list(CODAS))}),
glides(j, g) AS (VALUES {_rows(DIPHTHONGS)}),
bare(j, v) AS (VALUES {_rows(list(VOWELS))}),
opened AS (SELECT i, j, o || substr(vs, j, 1) AS s FROM onsets, range(1, 6) r(j) WHERE j <= length(vs)),
syllabary AS (
  SELECT 0 AS part, i, j, 0 AS k, s FROM opened
  UNION ALL SELECT 1, 0, j, k, v || c FROM bare, codas
  UNION ALL SELECT 2, i, j, k, s || c FROM opened, codas
  UNION ALL SELECT 3, i, j, 0, o || g FROM onsets, glides
  UNION ALL SELECT 4, 0, j, 0, g FROM glides),
vocab AS (
  SELECT s AS token, row_number() OVER (ORDER BY part, i, j, k) - 1 AS dim
  FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY part, i, j, k) AS n FROM syllabary) WHERE n = 1)"""


def cut(source: str, keys: str, size: int) -> str:
    """Recursive chunking of ``source(keys, text)`` into ``pieces(keys, raw_at, start, text)``."""
    window = f"substr(rest, 1, {size})"
    last = f"CASE WHEN length(rest) <= {size} OR strpos({window}, ' ') = 0 THEN 0 ELSE {size} - strpos(reverse({window}), ' ') + 1 END"
    take = f"CASE WHEN length(rest) <= {size} THEN length(rest) WHEN {last} > 1 THEN {last} - 1 ELSE {size} END"
    return f"""
cut AS (
  SELECT {keys}, text AS rest, CAST(0 AS BIGINT) AS offs, CAST(NULL AS VARCHAR) AS raw, CAST(0 AS BIGINT) AS raw_at FROM {source}
  UNION ALL
  SELECT {keys}, substr(rest, take + 1), offs + take, substr(rest, 1, take), offs
  FROM (SELECT *, {take} AS take FROM cut WHERE length(rest) > 0)),
pieces AS (
  SELECT * FROM (
    SELECT {keys}, raw_at, raw_at + length(raw) - length(regexp_replace(raw, '^\\s+', '')) AS start,
           {rx('raw', '^\\s+|\\s+$', '')} AS text
    FROM cut WHERE raw IS NOT NULL) WHERE text <> '')"""


DOCS = "docs AS (SELECT lang AS collection, source AS base, doc_id AS doc, text FROM documents)"

CHUNKS = f"""
{DOCS},
{cut('docs', 'collection, base, doc', 2048)},
chunks AS MATERIALIZED (
  SELECT collection, base, doc, row_number() OVER (PARTITION BY collection, base ORDER BY doc, raw_at) - 1 AS chunk,
         start, text, {line('text')} AS line
  FROM pieces)"""

# what follows from ``chunks``
STATISTICS = f"""
{vocab()},
tokens AS MATERIALIZED (
  SELECT collection, base, chunk, token, count(*) AS tf
  FROM (SELECT collection, base, chunk, unnest({syllables_of('line')}) AS token FROM chunks)
  GROUP BY ALL),
postings AS MATERIALIZED (SELECT t.*, v.dim FROM tokens t JOIN vocab v USING (token)),
n_base AS (SELECT collection, base, count(*) AS n FROM chunks GROUP BY ALL),
idf AS MATERIALIZED (
  SELECT p.collection, p.base, token, dim, count(*) AS df, any_value(n) AS n, ln((any_value(n) + 1) / count(*)) AS exact,
         ln(any_value(n) / count(*)) AS classic, round(ln((any_value(n) + 1) / count(*)), 6) AS idf
  FROM postings p JOIN n_base USING (collection, base) GROUP BY p.collection, p.base, token, dim),
n_coll AS (SELECT collection, count(*) AS n FROM chunks GROUP BY ALL),
uidf AS MATERIALIZED (
  SELECT p.collection, token, count(*) AS df, ln((any_value(n) + 1) / count(*)) AS uidf
  FROM postings p JOIN n_coll USING (collection) GROUP BY p.collection, token),
norms AS MATERIALIZED (
  SELECT c.collection, c.base, c.chunk,
         round(CASE WHEN coalesce(s, 0) = 0 THEN 1 ELSE sqrt(s) END, 6) AS norm,
         CASE WHEN coalesce(u, 0) = 0 THEN 1 ELSE sqrt(u) END AS union_norm,
         round(CASE WHEN coalesce(l, 0) = 0 THEN 1 ELSE sqrt(l) END, 6) AS classic_norm
  FROM chunks c LEFT JOIN (
    SELECT collection, base, chunk, sum(power(tf * exact, 2)) AS s, sum(power(tf * uidf, 2)) AS u, sum(power(tf * classic, 2)) AS l
    FROM postings JOIN idf USING (collection, base, token) JOIN uidf USING (collection, token) GROUP BY ALL) USING (collection, base, chunk))"""


TOKENS = f"{CHUNKS},{STATISTICS}"


def queries(source: str, suffix: str = "") -> str:
    """Query side: ``q(query_id, query, line)``, its tokens and its key terms."""
    return f"""
q{suffix} AS (SELECT query_id, query, {line('query')} AS line FROM {source}),
q_tokens{suffix} AS (SELECT query_id, token, count(*) AS q_tf FROM (SELECT query_id, unnest({syllables_of('line')}) AS token FROM q{suffix}) GROUP BY ALL),
q_words{suffix} AS (
  SELECT query_id, CASE WHEN len(list_filter(ws, lambda w: contains(w, '|'))) > 0 THEN list_filter(ws, lambda w: contains(w, '|')) ELSE ws END AS ws
  FROM (SELECT query_id, {words_of('line')} AS ws FROM q{suffix})),
terms{suffix} AS (
  SELECT query_id, term_no - 1 AS term_no, term, string_split(term, '|') AS syls, len(string_split(term, '|')) AS k,
         CASE WHEN len(string_split(term, '|')) <= 3 THEN {soundex("replace(term, '|', '')")} ELSE '' END AS sx
  FROM (SELECT query_id, unnest(ws) AS term, unnest(range(1, len(ws) + 1)) AS term_no FROM q_words{suffix}))"""


def literal_queries(texts: list[str]) -> str:
    return f"asked(query_id, query) AS (VALUES {_rows(texts)}),{queries('asked')}"


def recall(where: str = "true", unified: bool = False, cosine: str = "asymmetric", n: int = 20) -> str:
    """``scores`` and ``cands(query_id, collection, base, chunk, doc, cos, rr)``."""
    idf = "i.classic" if cosine == "true" else "i.idf"
    local = f"SELECT query_id, i.collection, i.base, token, q_tf * round({idf}, 6) AS qw FROM q_tokens JOIN idf i USING (token) JOIN scope USING (collection, base)"
    if unified:
        local = f"""{local} WHERE NOT shared
  UNION ALL SELECT query_id, s.collection, s.base, token, q_tf * uidf FROM q_tokens JOIN uidf u USING (token) JOIN scope s ON s.collection = u.collection WHERE shared"""
    norm = "CASE WHEN shared THEN union_norm ELSE norm END" if unified else ("classic_norm" if cosine == "true" else "norm")
    product = "qw * tf * classic" if cosine == "true" else "qw * tf"
    return f"""
scope AS (SELECT collection, base, n, count(*) OVER (PARTITION BY collection) > 1 AS shared FROM n_base WHERE {where}),
qv AS (SELECT * FROM ({local}) WHERE qw <> 0),
qn AS (SELECT query_id, collection, base, sqrt(sum(qw * qw)) AS qn, count(*) AS dims FROM qv GROUP BY ALL),
dots AS (
  SELECT query_id, p.collection, p.base, p.chunk, sum({product}) AS dot
  FROM postings p JOIN qv USING (collection, base, token) JOIN idf USING (collection, base, token) GROUP BY ALL),
scores AS MATERIALIZED (
  SELECT query_id, collection, base, chunk, dot / (qn * {norm}) AS cos
  FROM dots JOIN qn USING (query_id, collection, base) JOIN norms USING (collection, base, chunk) JOIN scope USING (collection, base)
  WHERE dot / (qn * {norm}) > 0),
cands AS MATERIALIZED (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, collection, base ORDER BY round(cos, 9) DESC, chunk DESC) AS rn FROM scores)
  WHERE rn <= {n})"""


def rerank(phonetic: bool = False, cands: str = "cands", suffix: str = "") -> str:
    """``scored(query_id, collection, base, chunk, cos, coverage, span)``."""
    meets = "w.syls[1] = t.syls[1]"
    depth = "len(list_filter(range(1, least(len(w.syls), t.k) + 1), lambda i: w.syls[1:i] = t.syls[1:i]))"
    if phonetic:
        code = soundex("replace(w, '|', '')")
        meets = f"({meets} OR (t.sx <> '' AND w.sx = t.sx))"
        depth = f"CASE WHEN t.sx <> '' AND w.sx = t.sx THEN t.k ELSE {depth} END"
    else:
        code = "''"
    return f"""
weights{suffix} AS (
  SELECT query_id, s.collection, s.base, term_no, coalesce(sum(CASE WHEN shared THEN uidf ELSE idf END), 0) AS w
  FROM (SELECT query_id, term_no, unnest(syls) AS token FROM terms{suffix}) t
  CROSS JOIN scope s LEFT JOIN uidf u ON u.collection = s.collection AND u.token = t.token
  LEFT JOIN idf i ON i.collection = s.collection AND i.base = s.base AND i.token = t.token
  GROUP BY ALL),
spots{suffix} AS MATERIALIZED (
  SELECT collection, base, chunk, wi, string_split(w, '|') AS syls, {code} AS sx
  FROM (SELECT collection, base, chunk, unnest(ws) AS w, unnest(range(len(ws))) AS wi
        FROM (SELECT collection, base, chunk, {words_of('line')} AS ws FROM chunks
              SEMI JOIN {cands} USING (collection, base, chunk)))),
met{suffix} AS MATERIALIZED (
  SELECT c.query_id, c.collection, c.base, c.chunk, t.term_no, t.k, w.wi, {depth} AS m
  FROM {cands} c JOIN terms{suffix} t USING (query_id) JOIN spots{suffix} w ON w.collection = c.collection AND w.base = c.base AND w.chunk = c.chunk AND {meets}),
best{suffix} AS (SELECT query_id, collection, base, chunk, term_no, any_value(k) AS k, max(m) AS best FROM met{suffix} GROUP BY ALL),
present{suffix} AS (SELECT * FROM best{suffix} WHERE best = k OR best >= 3),
places{suffix} AS (SELECT m.query_id, m.collection, m.base, m.chunk, m.term_no, m.wi FROM met{suffix} m JOIN present{suffix} p USING (query_id, collection, base, chunk, term_no) WHERE m.m = p.best),
n_present{suffix} AS (SELECT query_id, collection, base, chunk, count(*) AS np FROM present{suffix} GROUP BY ALL),
latest{suffix} AS (
  SELECT a.query_id, a.collection, a.base, a.chunk, a.wi, b.term_no, max(b.wi) AS last
  FROM (SELECT DISTINCT query_id, collection, base, chunk, wi FROM places{suffix}) a
  JOIN places{suffix} b USING (query_id, collection, base, chunk) WHERE b.wi <= a.wi
  GROUP BY ALL),
spans{suffix} AS (
  SELECT query_id, collection, base, chunk, min(reach) AS span FROM (
    SELECT query_id, collection, base, chunk, wi, wi - min(last) AS reach, count(*) AS seen FROM latest{suffix} GROUP BY query_id, collection, base, chunk, wi) r
  JOIN n_present{suffix} USING (query_id, collection, base, chunk) WHERE seen = np AND np > 1 GROUP BY ALL),
totals{suffix} AS (SELECT query_id, collection, base, sum(w) AS total, count(*) AS n_terms FROM weights{suffix} GROUP BY ALL),
held{suffix} AS (SELECT query_id, collection, base, chunk, sum(w) AS held FROM present{suffix} JOIN weights{suffix} USING (query_id, collection, base, term_no) GROUP BY ALL),
scored{suffix} AS MATERIALIZED (
  SELECT c.*, CASE WHEN n_terms IS NULL THEN 0.0 WHEN total > 0 THEN coalesce(held, 0) / total ELSE coalesce(np, 0) / n_terms END AS coverage,
         coalesce(span, 0) AS span
  FROM {cands} c LEFT JOIN totals{suffix} USING (query_id, collection, base) LEFT JOIN held{suffix} USING (query_id, collection, base, chunk)
  LEFT JOIN n_present{suffix} USING (query_id, collection, base, chunk) LEFT JOIN spans{suffix} USING (query_id, collection, base, chunk))"""


def hits(k: int, source: str = "scored", reranked: bool = True) -> str:
    point = "coverage" if reranked else "cos"
    span = "span" if reranked else "CAST(NULL AS BIGINT)"
    cover = "round(coverage, 6)" if reranked else "CAST(NULL AS DOUBLE)"
    return f"""
SELECT query_id, rank, collection, base, base AS path, round({point}, 6) AS matchpoint, {cover} AS coverage, {span} AS span,
       round(cos, 6) AS cos, chunk, start, '1.000' AS recency
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round({point}, 9) DESC, {span}, round(cos, 9) DESC, collection, base, chunk DESC) AS rank
      FROM {source} JOIN (SELECT collection, base, chunk, start FROM chunks) USING (collection, base, chunk))
WHERE rank <= {k}"""
