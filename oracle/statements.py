"""SQL statements that state the results of the registered queries (DuckDB dialect)."""

from __future__ import annotations

from lexivane.plans import workloads as W
from oracle import blocks as B


def _with(blocks: str, select: str) -> str:
    return f"WITH RECURSIVE {blocks}\n{select}"


def _text_statements() -> dict[str, str]:
    found_words = f"SELECT unnest(regexp_extract_all(lower(text), '[{B.WORD_CHARS}]+')) AS word FROM documents"
    words = f"w AS (SELECT word, count(*) AS n FROM ({found_words}) GROUP BY word)"
    lex = f"""lex AS (SELECT word, {B.plain('word')} AS normalized, replace({B.accented_line('word')}, '|', '-') AS syllables,
      {B.syllables_of(B.line('word'))} AS syls FROM w)"""
    sounds = B.soundex("normalized")
    needles = """SELECT doc_id, array_to_string(list_distinct_in_order, ' ') AS needles FROM (
      SELECT doc_id, list_transform(list_filter(range(1, len(l) + 1), lambda i: list_position(l, l[i]) = i), lambda i: l[i]) AS list_distinct_in_order FROM (
        SELECT doc_id, list_transform(list_filter(regexp_extract_all(text, '[A-Za-z0-9_-]{2,}'), lambda r: regexp_matches(r, '[0-9]')), lambda r: lower(r)) AS l
        FROM documents)) WHERE len(list_distinct_in_order) > 0"""
    trimmed = B.rx("lower(text)", "\\s+", " ")
    drop = B.rx("text", "(^|[^A-Za-zÀ-ÿ])([BCDFGHJKLMNPQRSTVXZ]) ([a-zà-ÿ])", "\\1\\2\\3")
    clean = B.rx(drop, "-\\n([a-zà-ÿ])", "\\1")
    joined = "array_to_string(list_filter(string_split(url, '/'), lambda p: p <> '' AND p <> '.'), '__')"
    derived = f"regexp_replace(regexp_replace({joined}, '^(.+)\\.([^.]*)$', '\\1_\\2'), '^[. ]+', '')"
    last = "list_last(string_split(url, '/'))"
    ext = f"lower(regexp_extract({last}, '^.+(\\.[^.]*)$', 1))"
    return {
        "word_counts": _with(words, "SELECT * FROM w"),
        "syllable_counts": f"SELECT syllable, count(*) AS n FROM (SELECT unnest({B.syllables_of(B.accented_line('text'))}) AS syllable FROM documents) GROUP BY syllable",
        "word_lexicon": _with(
            f"{words}, {lex}",
            f"SELECT word, normalized, syllables, len(syls) AS n_syllables, {sounds} AS phonetic, array_to_string(syls[1:2], '+') AS prefix_key FROM lex",
        ),
        "phonetic_groups": _with(
            f"{words}, {lex}", f"SELECT {sounds} AS phonetic, count(*) AS n_words, min(word) AS first_word FROM lex GROUP BY 1"
        ),
        "literal_needles": needles,
        "query_keys": f"SELECT item_id, md5(trim({trimmed})) AS query_key FROM benchmark",
        "cleaned_texts": f"SELECT doc_id, md5({clean}) AS cleaned FROM documents",
        "page_names": f"""SELECT page_id, base_name, extension,
            CASE WHEN contains(base_name, '__') THEN replace(regexp_extract(base_name, '^(.*)__', 1), '__', '/') || '/page.html' ELSE 'page.html' END AS path,
            decoded, masked
          FROM (SELECT page_id, CASE WHEN {derived} = '' THEN 'base' ELSE {derived} END AS base_name, nullif({ext}, '') AS extension,
                url_decode(replace(url, '+', ' ')) AS decoded, left(url, 6) || '…' || right(url, 4) AS masked FROM pages)""",
        "interpret_pages": _with(
            f"{B.vocab()}, n AS (SELECT count(*) AS n FROM vocab), p AS (SELECT page_id, nullif({ext}, '') AS extension FROM pages)",
            """SELECT page_id, step, extension, m AS matched, CASE WHEN m THEN 'tokens_Web_PTBR.drv' ELSE 'tokens_PTBR.drv' END AS driver,
               CASE WHEN m THEN 'Web' ELSE 'PTBR' END AS language, CASE WHEN m THEN 3 ELSE 0 END AS keywords, n + CASE WHEN m THEN 3 ELSE 0 END AS vocab_size
            FROM (SELECT *, coalesce(step = 'installed' AND extension IN ('.html', '.htm') , false) AS m FROM p CROSS JOIN n
                  CROSS JOIN (VALUES ('before'), ('installed'), ('uninstalled')) s(step))""",
        ),
        "key_terms": _with(
            B.queries("(SELECT item_id AS query_id, text AS query FROM benchmark)"),
            "SELECT query_id AS item_id, term_no, replace(term, '|', '-') AS term, k, sx FROM terms",
        ),
    }


def _index_statements() -> dict[str, str]:
    tok = B.TOKENS
    positions = f"""{B.CHUNKS},
      spots AS (SELECT collection, base, chunk, unnest(s) AS token, unnest(range(len(s))) AS pos FROM (SELECT collection, base, chunk, {B.syllables_of('line')} AS s FROM chunks)),
      lists AS (SELECT collection, base, chunk, token, list(pos ORDER BY pos) AS p FROM spots GROUP BY ALL)"""
    zipf = f"""z AS (SELECT syllable, count(*) AS n FROM (SELECT unnest({B.syllables_of(B.accented_line('text'))}) AS syllable FROM documents) GROUP BY syllable),
      r AS (SELECT syllable, n, row_number() OVER (ORDER BY n DESC, syllable) AS rank, n / sum(n) OVER () AS freq,
            sum(n) OVER (ORDER BY n DESC, syllable ROWS UNBOUNDED PRECEDING) / sum(n) OVER () AS cumulative FROM z)"""
    oov = "SELECT token, CAST(sum(tf) AS BIGINT) AS n FROM tokens ANTI JOIN vocab USING (token) GROUP BY token"
    return {
        "chunk_index": _with(B.CHUNKS, "SELECT collection, base, doc, chunk, start, length(text) AS len, md5(text) AS text_md5 FROM chunks"),
        "chunk_stats": _with(
            tok,
            f"""SELECT collection, base, chunk, len({B.syllables_of('line')}) AS tokens, CAST(len({B.syllables_of('line')}) - coalesce(known, 0) AS BIGINT) AS oov, round(norm, 6) AS norm
            FROM chunks JOIN norms USING (collection, base, chunk)
            LEFT JOIN (SELECT collection, base, chunk, sum(tf) AS known FROM postings GROUP BY ALL) USING (collection, base, chunk)""",
        ),
        "base_meta": _with(
            tok,
            """SELECT collection, base, CAST(bytes AS BIGINT) AS bytes, n AS n_chunks, (SELECT count(*) FROM vocab) AS vocab_size, vocab_used,
                CAST(total AS BIGINT) AS tokens_total, CAST(total - known AS BIGINT) AS oov_total, round(1 - (total - known) / total, 4) AS coverage
            FROM (SELECT collection, base, sum(octet_length(encode(text))) AS bytes FROM docs GROUP BY ALL) JOIN n_base USING (collection, base)
            JOIN (SELECT collection, base, count(*) AS vocab_used FROM idf GROUP BY ALL) USING (collection, base)
            JOIN (SELECT collection, base, sum(tf) AS total FROM tokens GROUP BY ALL) USING (collection, base)
            JOIN (SELECT collection, base, sum(tf) AS known FROM postings GROUP BY ALL) USING (collection, base)""",
        ),
        "idf_table": _with(tok, "SELECT collection, base, dim, token, df, round(idf, 6) AS idf FROM idf"),
        "idf_classic": _with(tok, "SELECT collection, base, token, round(classic, 6) AS idf FROM idf"),
        "postings": _with(tok, "SELECT collection, base, chunk, dim, token, tf FROM postings"),
        "tfidf_weights": _with(
            tok, "SELECT collection, base, chunk, token, round(tf * exact, 6) AS weight FROM postings JOIN idf USING (collection, base, token) WHERE tf * exact <> 0"
        ),
        "position_lists": _with(positions, "SELECT collection, base, chunk, token, array_to_string(p, ' ') AS positions FROM lists"),
        "position_gaps": _with(
            positions,
            "SELECT collection, base, chunk, token, array_to_string(list_transform(range(1, len(p) + 1), lambda i: p[i] - CASE WHEN i = 1 THEN 0 ELSE p[i - 1] END), ' ') AS gaps FROM lists",
        ),
        "seek_position": _with(
            positions,
            "SELECT collection, base, chunk, token, len(list_filter(p, lambda x: x < 100)) AS seek_index, list_filter(p, lambda x: x >= 100)[1] AS seek_position FROM lists",
        ),
        "zipf_table": _with(zipf, "SELECT syllable, n, rank, round(freq, 8) AS freq, round(cumulative, 8) AS cumulative FROM r"),
        "zipf_exponent": _with(zipf, "SELECT round(-regr_slope(ln(n), ln(rank)), 6) AS exponent, count(*) AS n_syllables FROM r"),
        "zipf_coverage": _with(
            zipf, "SELECT top_n, round(sum(freq) FILTER (rank <= top_n), 6) AS covered FROM r, (VALUES (50), (100), (200)) t(top_n) GROUP BY top_n"
        ),
        "active_dims": _with(
            tok, "SELECT collection, base, count(*) AS active_dims, any_value(v) AS vocab_size, round(1 - count(*) / any_value(v), 6) AS sparsity FROM idf, (SELECT count(*) AS v FROM vocab) GROUP BY ALL"
        ),
        "oov_tokens": _with(tok, oov),
        "oov_top": _with(tok, f"{oov} ORDER BY n DESC, token LIMIT 15"),
        "bigrams": _with(
            B.CHUNKS,
            f"""SELECT s[i] AS first, s[i + 1] AS second, count(*) AS n FROM (
              SELECT s, unnest(range(1, len(s))) AS i FROM (SELECT string_split(w, '|') AS s FROM (SELECT unnest({B.words_of('line')}) AS w FROM chunks))) GROUP BY ALL""",
        ),
        "base_embeddings": _with(
            tok,
            """SELECT collection, base, v.dim, v.token, CAST(coalesce(m, 0) AS BIGINT) AS n FROM n_base b CROSS JOIN vocab v
            LEFT JOIN (SELECT collection, base, token, sum(tf) AS m FROM postings GROUP BY ALL) USING (collection, base, token)""",
        ),
    }


def _profile_statements() -> dict[str, str]:
    tok = B.TOKENS
    uprof = f"""{tok},
      udim AS (SELECT collection, token, dim AS u_dim FROM vocab CROSS JOIN (SELECT DISTINCT collection FROM n_base)),
      cprof AS (SELECT * FROM (SELECT u.*, u_dim, row_number() OVER (PARTITION BY collection ORDER BY round(uidf, 9) DESC, u_dim) AS rank
                FROM uidf u JOIN udim USING (collection, token)) WHERE rank <= 40),
      cells AS (SELECT b.collection, b.base, b.n, rank, c.token, uidf * coalesce(m, 0) AS weight FROM n_base b JOIN cprof c USING (collection)
                LEFT JOIN (SELECT collection, base, token, sum(tf) AS m FROM postings GROUP BY ALL) USING (collection, base, token))"""
    hashes = """st AS (SELECT collection, sha256(concat_ws('|', base, n, 1956, base)) AS h FROM n_base),
      bk AS (SELECT collection, left(h, 3) AS b, sha256(string_agg(h, ',' ORDER BY h)) AS h FROM st GROUP BY ALL),
      src AS (SELECT collection, sha256(string_agg(h, ',' ORDER BY h)) AS source_hash FROM bk GROUP BY ALL)"""
    window = f"""SELECT collection, base, chunk, start, length(text) AS len, len({B.syllables_of('line')}) AS tokens,
      CAST(len({B.syllables_of('line')}) - coalesce(known, 0) AS BIGINT) AS oov, md5(text) AS text_md5
      FROM chunks LEFT JOIN (SELECT collection, base, chunk, sum(tf) AS known FROM postings GROUP BY ALL) USING (collection, base, chunk)"""
    return {
        "bases_in_scope": _with(tok, "SELECT collection, base AS name, n AS n_chunks, CAST(1956 AS BIGINT) AS vocab_size, true AS has_text FROM n_base WHERE base LIKE 'src1%'"),
        "collections": "SELECT lang AS collection, count(DISTINCT source) AS bases FROM documents GROUP BY lang",
        "stats_rollup": _with(
            tok,
            """SELECT collection, count(*) AS bases, CAST(sum(n) AS BIGINT) AS chunks, CAST(sum(t) AS BIGINT) AS tokens
            FROM n_base JOIN (SELECT collection, base, sum(tf) AS t FROM tokens GROUP BY ALL) USING (collection, base) GROUP BY ROLLUP (collection)""",
        ),
        "memory_estimate": _with(
            tok,
            """SELECT collection, base, CAST(b AS BIGINT) AS text_bytes, v * 16 AS vec_bytes, CAST(t * 24 AS BIGINT) AS words_bytes
            FROM (SELECT collection, base, sum(octet_length(encode(text))) AS b FROM chunks GROUP BY ALL)
            JOIN (SELECT collection, base, sum(tf) AS t FROM tokens GROUP BY ALL) USING (collection, base)
            JOIN (SELECT collection, base, count(*) AS v FROM postings GROUP BY ALL) USING (collection, base)""",
        ),
        "chunk_window": _with(tok, f"{window} WHERE chunk BETWEEN 2 AND 5"),
        "chunks_by_id": _with(
            B.CHUNKS, "SELECT collection, base, position, chunk, start, md5(text) AS text_md5 FROM chunks JOIN (VALUES (0, 4), (1, 0), (2, 9999)) v(position, chunk) USING (chunk)"
        ),
        "word_keys": _with(
            B.CHUNKS, f"SELECT DISTINCT array_to_string(string_split(w, '|')[1:2], '+') AS key FROM (SELECT unnest({B.words_of('line')}) AS w FROM chunks WHERE collection = 'es')"
        ),
        "union_vocabulary": _with(
            uprof, "SELECT d.collection, d.token, u_dim, df, round(uidf, 6) AS uidf FROM udim d LEFT JOIN uidf USING (collection, token)"
        ),
        "union_norms": _with(tok, "SELECT collection, base, chunk, round(union_norm, 5) AS union_norm FROM norms"),
        "fingerprints": _with(tok, "SELECT collection, count(*) AS n_bases, CAST(sum(n) AS BIGINT) AS total_chunks FROM n_base GROUP BY ALL"),
        "base_profile": _with(
            tok,
            "SELECT * FROM (SELECT collection, base, row_number() OVER (PARTITION BY collection, base ORDER BY idf DESC, dim) AS rank, dim, token AS syllable, round(idf, 6) AS idf FROM idf) WHERE rank <= 20",
        ),
        "collection_profile": _with(uprof, "SELECT collection, rank, u_dim AS dim, token AS syllable, round(uidf, 6) AS uidf FROM cprof WHERE rank <= 20"),
        "base_vectors": _with(uprof, "SELECT collection, base, n AS n_chunks, rank, token AS syllable, round(weight, 6) AS weight FROM cells WHERE rank <= 20"),
        "mined_sources": _with(f"{tok}, {hashes}", "SELECT * FROM src"),
        "mined_anatomy": _with(
            uprof, "SELECT collection, base, n AS n_chunks, CAST(1956 AS BIGINT) AS vocab_size, count(*) AS dims, round(sum(weight), 5) AS mass FROM cells GROUP BY ALL"
        ),
        "mined_records": _with(
            f"{uprof}, {hashes}, parts AS (SELECT collection, base, n, count(*) AS dims, round(sum(weight), 5) AS mass FROM cells GROUP BY ALL)",
            f"""SELECT collection, CAST(0 AS BIGINT) AS level, source_hash, CASE WHEN collection IN ({", ".join(B.text(c) for c in W.MINED_FIRST)}) THEN 0 ELSE 1 END AS cycle,
                'l0-' || left(source_hash, 8) AS digestion_id, true AS traced, CAST(2 AS BIGINT) AS items, n_bases,
                total_chunks, CAST(1956 AS BIGINT) AS unified_vocab_size, token AS first_root, base, n AS n_chunks, dims, mass
            FROM src JOIN (SELECT collection, count(*) AS n_bases, CAST(sum(n) AS BIGINT) AS total_chunks FROM n_base GROUP BY ALL) USING (collection)
            JOIN cprof USING (collection) JOIN parts USING (collection) WHERE rank = 1""",
        ),
    }


def _search_statements() -> dict[str, str]:
    asked = B.literal_queries(W.SEARCHES)

    def search(k=10, n=20, where="true", phonetic=False, unified=False, source=asked):
        return _with(f"{B.TOKENS},\n{source},\n{B.recall(where, unified, n=n)},\n{B.rerank(phonetic)}", B.hits(k))

    def recalled(**options):
        return _with(
            f"{B.TOKENS},\n{asked},\n{B.recall(**options)}",
            "SELECT query_id, collection, base, rn AS recall_rank, chunk, round(cos, 6) AS cos FROM cands",
        )

    bench = B.queries("(SELECT item_id AS query_id, text AS query FROM benchmark)")
    report = """SELECT query_id, s.collection, s.base, n AS n_chunks, coalesce(n_converge, 0) AS n_converge, coalesce(dims, 0) AS dims, CAST(coalesce(oov, 0) AS BIGINT) AS oov
      FROM scope s CROSS JOIN q LEFT JOIN (SELECT query_id, collection, base, count(*) AS n_converge FROM scores GROUP BY ALL) USING (query_id, collection, base)
      LEFT JOIN qn USING (query_id, collection, base)
      LEFT JOIN (SELECT query_id, sum(q_tf) AS oov FROM q_tokens ANTI JOIN vocab USING (token) GROUP BY ALL) USING (query_id)"""
    sequence = f"""
scope AS (SELECT collection, base, n, true AS shared FROM n_base),
qv AS (SELECT * FROM (SELECT query_id, collection, base, token, q_tf * round(classic, 6) AS qw FROM q_tokens JOIN idf USING (token)) WHERE qw <> 0),
qn AS (SELECT query_id, collection, base, sqrt(sum(qw * qw)) AS qn FROM qv GROUP BY ALL),
scores AS (
  SELECT query_id, collection, base, chunk, any_value(dot) / (any_value(qn) * any_value(classic_norm)) AS cos FROM (
    SELECT query_id, p.collection, p.base, p.chunk, sum(qw * tf) AS dot FROM postings p JOIN qv USING (collection, base, token) GROUP BY ALL)
  JOIN qn USING (query_id, collection, base) JOIN norms USING (collection, base, chunk) GROUP BY ALL),
cands AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, collection, base ORDER BY round(cos, 9) DESC, chunk DESC) AS rn FROM scores WHERE cos > 0) WHERE rn <= 5),
qw AS (SELECT query_id, unnest(ws) AS w, unnest(range(len(ws))) AS wno FROM (SELECT query_id, {B.words_of('line')} AS ws FROM q)),
seqs AS (SELECT collection, base, chunk, {B.syllables_of('line')} AS s FROM chunks),
slid AS MATERIALIZED (
  SELECT query_id, collection, base, chunk, wno, len(c) AS k, p, len(list_filter(range(1, len(c) + 1), lambda j: s[p + j] = c[j])) AS m
  FROM (SELECT query_id, collection, base, chunk, wno, string_split(w, '|') AS c, s, unnest(range(len(s) - len(string_split(w, '|')) + 1)) AS p
        FROM cands JOIN qw USING (query_id) JOIN seqs USING (collection, base, chunk))),
peaks AS (SELECT query_id, collection, base, chunk, wno, any_value(k) AS k, max(m) AS best FROM slid GROUP BY ALL),
places AS (SELECT s.* FROM slid s JOIN peaks USING (query_id, collection, base, chunk, wno) WHERE m = best
           UNION ALL SELECT query_id, collection, base, chunk, wno, len(string_split(w, '|')), 0, 0
           FROM cands JOIN qw USING (query_id) JOIN seqs USING (collection, base, chunk) WHERE len(s) < len(string_split(w, '|'))),
n_words AS (SELECT query_id, count(*) AS nw FROM qw GROUP BY ALL),
lists AS (SELECT query_id, collection, base, chunk, p, wno, max(CASE WHEN own THEN p END) OVER w AS last FROM (
    SELECT a.query_id, a.collection, a.base, a.chunk, a.p, q.wno, a.wno = q.wno AS own FROM places a JOIN qw q USING (query_id))
    WINDOW w AS (PARTITION BY query_id, collection, base, chunk, wno ORDER BY p RANGE UNBOUNDED PRECEDING)),
reach AS (SELECT query_id, collection, base, chunk, p, p - min(last) AS r, count(last) = count(*) AS whole FROM (SELECT DISTINCT * FROM lists) GROUP BY query_id, collection, base, chunk, p),
spans AS (SELECT query_id, collection, base, chunk, min(r) AS span FROM reach WHERE whole GROUP BY ALL),
mfs AS (SELECT c.query_id, c.collection, c.base, c.chunk, any_value(cos) AS cos, sum(coalesce(best / k, 0)) / any_value(nw) AS mf, any_value(nw) AS nw
        FROM cands c JOIN qw USING (query_id) JOIN n_words USING (query_id) LEFT JOIN peaks USING (query_id, collection, base, chunk, wno) GROUP BY ALL),
final AS (SELECT *, mf / (1 + sp / 8.0) AS rr FROM (SELECT m.*, CASE WHEN nw > 1 THEN span ELSE 0 END AS sp FROM mfs m LEFT JOIN spans USING (query_id, collection, base, chunk)))"""
    chains = f"asked(query_id, query) AS (VALUES {B._rows(W.CHAINS)}), ch AS (SELECT query_id, {B.syllables_of(B.line('query'))} AS c FROM asked)"
    bag = f"""{B.TOKENS}, {chains},
      wanted AS (SELECT query_id, len(c) AS k, unnest(c) AS token FROM ch),
      mass AS (SELECT collection, base, token, sum(tf) AS n FROM postings GROUP BY ALL),
      dn AS (SELECT collection, base, sqrt(sum(n * n)) AS dn FROM mass GROUP BY ALL),
      qn AS (SELECT query_id, sqrt(sum(q * q)) AS qn FROM (SELECT query_id, token, count(*) AS q FROM wanted SEMI JOIN vocab USING (token) GROUP BY ALL) GROUP BY ALL),
      b AS (SELECT query_id, collection, base, CAST(sum(coalesce(mass.n, 0)) AS BIGINT) AS score, count(mass.n) / count(*) AS coverage
            FROM wanted CROSS JOIN n_base LEFT JOIN mass USING (collection, base, token) GROUP BY ALL)"""
    word_chain = f"""{B.CHUNKS}, {chains},
      dw AS (SELECT collection, base, w, count(*) AS n FROM (SELECT collection, base, unnest({B.words_of('line')}) AS w FROM chunks) GROUP BY ALL),
      sl AS (SELECT collection, base, n, string_split(w, '|') AS s FROM dw),
      full_hits AS (SELECT query_id, collection, base, CAST(sum(n * len(list_filter(range(1, len(s) - len(c) + 2), lambda p: s[p:p + len(c) - 1] = c))) AS BIGINT) AS hits FROM sl CROSS JOIN ch GROUP BY ALL),
      qb AS (SELECT DISTINCT query_id, c[i] AS a, c[i + 1] AS b FROM (SELECT query_id, c, unnest(range(1, len(c))) AS i FROM ch)),
      tb AS (SELECT DISTINCT collection, base, s[i] AS a, s[i + 1] AS b FROM (SELECT collection, base, s, unnest(range(1, len(s))) AS i FROM sl)),
      bg AS (SELECT query_id, collection, base, count(*) AS bigrams FROM qb JOIN tb USING (a, b) GROUP BY ALL),
      al AS (SELECT query_id, collection, base, hits, coalesce(bigrams, 0) AS bigrams FROM full_hits LEFT JOIN bg USING (query_id, collection, base))"""
    phrase = f"""{B.CHUNKS}, {chains},
      s AS (SELECT collection, base, chunk, {B.syllables_of('line')} AS s FROM chunks),
      a AS (SELECT collection, base, chunk, s, query_id, c, unnest(list_filter(range(len(s) - len(c) + 1), lambda p: s[p + 1:p + len(c)] = c)) AS pos FROM s JOIN ch ON len(c) > 1)"""
    in_docs = f"""{B.CHUNKS}, asked(query_id, query) AS (VALUES {B._rows(W.PHRASES)}), ch AS (SELECT query_id, {B.syllables_of(B.line('query'))} AS c FROM asked),
      said AS (SELECT collection, base, doc, flatten(list({B.syllables_of('line')} ORDER BY chunk)) AS s FROM chunks GROUP BY ALL),
      numbered AS (SELECT *, row_number() OVER () AS d FROM said),
      heard AS (SELECT d, unnest(s) AS x, unnest(range(len(s))) AS pos FROM numbered),
      want AS (SELECT query_id, len(c) AS k, unnest(c) AS x, unnest(range(len(c))) AS i FROM ch WHERE len(c) > 1),
      hit AS (SELECT query_id, d, pos - i AS pos FROM heard JOIN want USING (x) GROUP BY query_id, d, pos - i, k HAVING count(*) = k)"""
    curve = f"""{B.CHUNKS}, c AS (SELECT {B.syllables_of(B.line("'keitver'"))} AS c),
      s AS (SELECT collection, base, chunk, {B.syllables_of('line')} AS s FROM chunks),
      f AS (SELECT collection, base, chunk, len(list_filter(range(1, len(c) + 1), lambda j: s[p + j] = c[j])) / len(c) AS f
            FROM (SELECT *, unnest(range(len(s) - len(c) + 1)) AS p FROM s, c))"""
    flat = B.rx("trim(text)", "\\s+", " ")
    shown = f"""{B.TOKENS}, {asked}, {B.recall()}, {B.rerank()},
      top AS (SELECT query_id, rank, text, query FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(coverage, 9) DESC, span, round(cos, 9) DESC, collection, base, chunk DESC) AS rank
          FROM scored JOIN (SELECT collection, base, chunk, text FROM chunks) USING (collection, base, chunk)) JOIN asked USING (query_id) WHERE rank <= 5),
      fl AS (SELECT query_id, rank, {flat} AS f, list_transform(regexp_extract_all(lower(query), '[{B.WORD_CHARS}]+'), lambda w: {B.plain('w')}) AS ws FROM top),
      fp AS (SELECT *, list_filter(list_transform(ws, lambda w: strpos({B.plain('lower(f)')}, w)), lambda p: p > 0)[1] AS p FROM fl),
      ab AS (SELECT *, greatest(p - 36, 0) AS a, least(greatest(p - 36, 0) + 140, length(f)) AS b FROM fp),
      ct AS (SELECT query_id, rank, ws, CASE WHEN p IS NULL THEN substr(f, 1, 140) || CASE WHEN length(f) > 140 THEN '…' ELSE '' END
             ELSE CASE WHEN a > 0 THEN '…' ELSE '' END || trim(substr(f, a + 1, b - a)) || CASE WHEN b < length(f) THEN '…' ELSE '' END END AS o FROM ab),
      mk AS (SELECT query_id, rank, o, w, string_split({B.plain('lower(o)')}, w) AS parts FROM (SELECT query_id, rank, o, unnest(ws) AS w FROM ct)),
      sp AS (SELECT query_id, rank, w, CAST(list_sum(list_transform(parts[1:i], lambda x: length(x))) + (i - 1) * length(w) AS BIGINT) AS a
             FROM (SELECT query_id, rank, w, parts, unnest(range(1, len(parts))) AS i FROM mk)),
      ms AS (SELECT query_id, rank, list(DISTINCT struct_pack(a := a, b := a + length(w))) AS marks FROM sp GROUP BY ALL),
      pt AS (SELECT query_id, rank, list_reverse_sort(coalesce(marks, [])) AS marks, o FROM ct LEFT JOIN ms USING (query_id, rank)),
      step AS (
        SELECT query_id, rank, marks, o, 1 AS i FROM pt
        UNION ALL
        SELECT query_id, rank, marks, substr(o, 1, marks[i].a) || '«' || substr(o, marks[i].a + 1, marks[i].b - marks[i].a) || '»' || substr(o, marks[i].b + 1), i + 1
        FROM step WHERE i <= len(marks))"""
    return {
        "snippets": _with(shown, "SELECT query_id, rank, o AS snippet FROM step WHERE i = len(marks) + 1"),
        "search_all": search(),
        "search_phonetic": search(phonetic=True),
        "search_unified": search(unified=True),
        "search_recall_only": _with(f"{B.TOKENS},\n{asked},\n{B.recall(n=5)}", B.hits(5, "cands", False)),
        "search_one_base": search(5, where="collection = 'en' AND base = 'src1'"),
        "search_one_collection": search(5, 10, "collection = 'fr' AND base LIKE 'src1%'"),
        "search_benchmark": search(5, 5, source=bench),
        "search_report": _with(f"{B.TOKENS},\n{asked},\n{B.recall()}", report),
        "recall_candidates": recalled(),
        "recall_true_cosine": recalled(cosine="true"),
        "recall_unified": recalled(unified=True),
        "search_sequence": _with(
            f"{B.TOKENS},\n{asked},\n{sequence}",
            """SELECT * FROM (SELECT query_id, collection, base, row_number() OVER (PARTITION BY query_id, collection, base ORDER BY round(rr, 9) DESC, round(cos, 9) DESC, chunk DESC) AS rank,
               chunk, round(rr, 6) AS rr, round(mf, 6) AS mf, sp AS span, round(cos, 6) AS cos FROM final) WHERE rank <= 3""",
        ),
        "bag_scores": _with(
            bag,
            """SELECT query_id, b.collection, b.base, score, round(coverage, 6) AS coverage, round(score / (coalesce(qn, 1) * coalesce(dn, 1)), 6) AS cosine,
            CASE WHEN coverage = 1 AND score > 0 THEN 'present' WHEN score > 0 THEN 'partial' ELSE 'absent' END AS verdict
            FROM b LEFT JOIN qn USING (query_id) LEFT JOIN dn USING (collection, base)""",
        ),
        "word_chains": _with(
            word_chain,
            "SELECT query_id, collection, base, hits, bigrams, CASE WHEN hits > 0 THEN 'exists' WHEN bigrams > 0 THEN 'similar' ELSE 'absent' END AS verdict FROM al",
        ),
        "phrase_positions": _with(phrase, "SELECT query_id, collection, base, chunk, pos FROM a"),
        "document_phrases": _with(in_docs, "SELECT query_id, collection, base, doc, pos FROM hit JOIN numbered USING (d)"),
        "sql_syllables": _with(
            f"s AS (SELECT lang, doc_id, unnest({B.syllables_of(B.line('text'))}) AS syllable FROM documents), c AS (SELECT lang, syllable, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM s GROUP BY ALL)",
            f"SELECT lang, syllable, n, n_docs, {B.soundex('syllable')} AS code FROM c",
        ),
        "sql_chunks": _with(
            B.CHUNKS,
            f"""SELECT doc AS doc_id, row_number() OVER (PARTITION BY doc ORDER BY chunk) - 1 AS piece, start, md5(text) AS text_md5,
            CAST(len(regexp_extract_all(lower(text), '[{B.WORD_CHARS}]+')) AS BIGINT) AS n_words FROM chunks""",
        ),
        "correlation_peaks": _with(
            curve, "SELECT collection, base, chunk, count(*) AS offsets, round(max(f), 6) AS peak, round(sum(f), 6) AS mass FROM f GROUP BY ALL"
        ),
    }


def _values(rows: list[tuple]) -> str:
    cell = lambda v: "[" + ", ".join(B.text(x) for x in v) + "]" if isinstance(v, list) else (B.text(v) if isinstance(v, str) else str(v))
    return ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in rows)


def _variants(synonyms: str, source: str) -> str:
    """``variants(query_id, variant_no, variant)`` from ``synonyms(w, s)`` and ``source(query_id, query)``."""
    letters = B.line(f"regexp_replace(w, '[^{B.WORD_CHARS}]', '', 'g')")
    return f"""{synonyms},
      cw AS (SELECT query_id, w, wno FROM (SELECT query_id, unnest(l) AS w, unnest(range(len(l))) AS wno FROM (
          SELECT query_id, list_filter(string_split(trim({B.rx('lower(query)', '\\s+', ' ')}), ' '), lambda w: w <> '') AS l FROM {source}))),
      lw AS (SELECT *, contains({letters}, '|') AS long FROM cw),
      keyed AS (SELECT * FROM (SELECT *, max(long) OVER (PARTITION BY query_id) AS any_long FROM lw) WHERE long OR NOT any_long),
      syn_rows AS (SELECT query_id, wno, w, trim(unnest(s)) AS syn, unnest(range(len(s))) AS sno FROM keyed JOIN synonyms USING (w)),
      firsts AS (SELECT query_id, lower(syn) AS low, min(struct_pack(a := wno, b := sno, c := syn)) AS at_first FROM syn_rows WHERE syn <> '' AND lower(syn) <> w GROUP BY query_id, lower(syn)),
      variants AS (SELECT query_id, n AS variant_no, at_first.c AS variant FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY at_first) AS n FROM firsts) WHERE n <= 12)"""


def _suggest(missing: str) -> str:
    """``near(query_id, rank, word, ...)`` for ``missing(query_id, term)``."""
    return f"""{missing},
      vw AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[{B.WORD_CHARS}]+')) AS word FROM chunks),
      v AS (SELECT word, {B.plain('word')} AS p, {B.soundex(B.plain('word'))} AS sx, {B.syllables_of(B.line('word'))} AS syls FROM vw WHERE length(word) >= 3),
      m AS (SELECT query_id, term, {B.plain('lower(term)')} AS p, {B.soundex("regexp_replace(" + B.plain('lower(term)') + ", '[^a-z]', '', 'g')")} AS sx, {B.syllables_of(B.line('term'))} AS syls FROM missing),
      ms AS (SELECT query_id, list(DISTINCT sx) AS sxs, list_distinct(flatten(list(syls))) AS syls, list(DISTINCT p) AS ps FROM m GROUP BY query_id),
      sug AS (SELECT query_id, word, CAST(list_contains(sxs, sx) AND sx <> '' AS BIGINT) AS same_sound, len(list_filter(v.syls, lambda x: list_contains(ms.syls, x))) AS shared,
              list_min(list_transform(ps, lambda t: levenshtein(v.p, t))) AS distance FROM v CROSS JOIN ms),
      near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY same_sound DESC, shared DESC, distance, length(word), word) AS rank FROM sug WHERE same_sound = 1 OR shared > 0) WHERE rank <= 6)"""


def _fold(source: str, size: int) -> str:
    """Sequential packing of ``source(base, seq, text)``: ``packed(base, start, text)``."""
    window = f"substr(buf, 1, {size})"
    last = f"CASE WHEN strpos({window}, ' ') = 0 THEN 0 ELSE {size} - strpos(reverse({window}), ' ') + 1 END"
    take = f"CASE WHEN {last} > 1 THEN {last} - 1 ELSE {size} END"
    trim = lambda x: B.rx(x, "^\\s+|\\s+$", "")
    lead = lambda x: f"(length({x}) - length(regexp_replace({x}, '^\\s+', '')))"
    return f"""
      seqs AS (SELECT base, text, row_number() OVER (PARTITION BY base ORDER BY seq) AS n, count(*) OVER (PARTITION BY base) AS total FROM {source}),
      fold AS (
        SELECT base, CAST(1 AS BIGINT) AS n, text AS buf, CAST(0 AS BIGINT) AS offs, CAST(NULL AS VARCHAR) AS piece, CAST(0 AS BIGINT) AS start, total FROM seqs WHERE n = 1
        UNION ALL
        SELECT f.base, CASE WHEN length(buf) > {size} THEN f.n ELSE f.n + 1 END,
               CASE WHEN length(buf) > {size} THEN substr(buf, {take} + 1) WHEN f.n < f.total THEN {trim('buf')} || s.text ELSE '' END,
               CASE WHEN length(buf) > {size} THEN offs + {take} ELSE offs + {lead('buf')} END,
               CASE WHEN length(buf) > {size} THEN {trim(f'substr(buf, 1, {take})')} WHEN f.n = f.total THEN {trim('buf')} END,
               CASE WHEN length(buf) > {size} THEN offs + {lead(f'substr(buf, 1, {take})')} ELSE offs + {lead('buf')} END, f.total
        FROM fold f LEFT JOIN seqs s ON s.base = f.base AND s.n = f.n + 1 WHERE f.n <= f.total),
      packed AS (SELECT base, row_number() OVER (PARTITION BY base ORDER BY start) - 1 AS chunk, start, md5(piece) AS text_md5, piece AS text FROM fold WHERE piece IS NOT NULL AND piece <> '')"""


def _expansion_statements() -> dict[str, str]:
    given = _values([(w, s) for w, s in W.SYNONYMS.items()])
    found_words = f"SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[{B.WORD_CHARS}]+')) AS word FROM documents"
    mixed = f"""given(w, s) AS (VALUES {given}),
      spelled AS (SELECT {B.plain('word')} AS w, list(DISTINCT word) AS s FROM ({found_words}) GROUP BY 1),
      synonyms AS (SELECT w, list_sort(list_distinct(flatten(list(s)))) AS s FROM (SELECT * FROM given UNION ALL SELECT * FROM spelled) GROUP BY w)"""
    keys = f"wk AS (SELECT DISTINCT string_split(w, '|')[1:2] AS key FROM (SELECT unnest({B.words_of('line')}) AS w FROM chunks))"
    fixed = f"synonyms(w, s) AS (VALUES {given})"
    expanded_by = lambda asked, variants, more="": f"""{B.TOKENS}, asked(query_id, query) AS (VALUES {asked}), {variants}, {keys},
      ev AS (SELECT query_id, 0 AS variant_no, query AS variant FROM asked UNION ALL SELECT * FROM variants{more}),
      evw AS (SELECT query_id, variant_no, string_split(ew, '|')[1:2] AS key FROM (SELECT query_id, variant_no, unnest({B.words_of(B.line('variant'))}) AS ew FROM ev)),
      kept AS (SELECT * FROM ev SEMI JOIN (SELECT DISTINCT query_id, variant_no FROM evw SEMI JOIN wk USING (key)) USING (query_id, variant_no)),
      batch AS (SELECT query_id * 1000 + variant_no AS query_id, variant AS query FROM kept),
      {B.queries('batch')}, {B.recall()}, {B.rerank()},
      top1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(coverage, 9) DESC, span, round(cos, 9) DESC, collection, base, chunk DESC) AS rank FROM scored) WHERE rank <= 8),
      bestv AS (SELECT query_id // 1000 AS query_id, query_id % 1000 AS variant_no, collection, base, chunk, cos, coverage + CASE WHEN query_id % 1000 = 0 THEN 0.001 ELSE 0 END AS var_cov FROM top1),
      cands2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, collection, base, chunk ORDER BY round(var_cov, 9) DESC, variant_no) AS n FROM bestv) WHERE n = 1),
      {B.queries('asked', '2')}, {B.rerank(cands='cands2', suffix='2')}"""
    expanded = expanded_by(B._rows(W.SEARCHES), _variants(fixed, "asked"))
    missing = f"missing(query_id, term) AS (VALUES {_values([(0, 'therrou'), (0, 'onthe'), (1, 'keitverr'), (2, 'paresi')])})"
    unknown = [(0, "zzzyx qqwk"), (1, "thereou"), (2, "xyzzy")]
    absent = f"""{B.CHUNKS}, asked(query_id, query) AS (VALUES {_values(unknown)}), {keys},
      anch AS (SELECT DISTINCT query_id FROM (SELECT query_id, string_split(unnest({B.words_of(B.line('query'))}), '|')[1:2] AS key FROM asked) SEMI JOIN wk USING (key)),
      {_suggest("missing AS (SELECT query_id, query AS term FROM asked ANTI JOIN anch USING (query_id))")}"""
    literal = f"""{B.CHUNKS}, nd(j, needle) AS (VALUES {_values([(0, 'oe-6016'), (1, '192'), (2, '10'), (3, '2024')])}),
      f AS (SELECT collection, base, doc, chunk, start, text, list(needle ORDER BY j) AS ns FROM chunks JOIN nd ON contains(lower(text), needle) GROUP BY ALL),
      r AS (SELECT *, len(ns) / 4 AS coverage, strpos(lower(text), ns[1]) - 1 AS p0, row_number() OVER (ORDER BY len(ns) DESC, collection, base, chunk) AS rank FROM f)"""
    cached = [(q, n + 1, v) for q in (1, 2) for n, v in enumerate(W.CACHED[W.CASCADE[q]])]
    made_up = [(3, n + 1, v) for n, v in enumerate(W.EXPANDED[W.CASCADE[3]])]
    steps = f"""{_suggest(f"missing(query_id, term) AS (VALUES {_values([(2, W.CASCADE[2])] + [(q, v) for q, _, v in cached if q == 2])})")},
      found AS (SELECT query_id, rank, collection, base, chunk, coverage, span, CASE WHEN variant_no = 0 THEN 'original' ELSE variant END AS via
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(coverage, 9) DESC, round(var_cov, 9) DESC, span, variant_no = 0 DESC, collection, base, chunk) AS rank FROM scored2)
        JOIN (SELECT query_id, variant_no, variant FROM kept) USING (query_id, variant_no) WHERE rank <= 8),
      nd(query_id, needle) AS (VALUES {_values([(4, "oe-6016"), (4, "192"), (4, "10"), (4, "2024"), (6, "2024"), (6, "qx-99999")])}),
      lf AS (SELECT query_id, collection, base, doc, chunk, count(*) AS span FROM chunks JOIN nd ON contains(lower(text), needle) GROUP BY ALL),
      lr AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY span DESC, collection, base, chunk) AS rank, collection, base, chunk,
          span / (SELECT count(*) FROM nd WHERE nd.query_id = lf.query_id) AS coverage, span, 'literal_fallback' AS via FROM lf),
      hits AS (SELECT * FROM found UNION ALL SELECT * FROM lr WHERE rank <= 8),
      every(query_id, step) AS (VALUES {_values([(0, "dict"), (1, "cache"), (2, "cache"), (3, "custom"), (4, "none"), (5, "none"), (6, "none")])}),
      outcome AS (SELECT query_id, CASE WHEN query_id IN (SELECT query_id FROM lr) THEN 'literal_fallback' ELSE step END AS source,
          step <> 'none' AND query_id NOT IN (SELECT query_id FROM kept) AS absent,
          coalesce((SELECT string_agg(variant, ';' ORDER BY variant_no) FROM ev WHERE ev.query_id = every.query_id AND variant_no > 0), '') AS expansions,
          coalesce((SELECT string_agg(variant, ';' ORDER BY variant) FROM ev ANTI JOIN kept USING (query_id, variant_no) WHERE ev.query_id = every.query_id AND variant_no > 0), '') AS dropped FROM every)"""
    cascade = f"""{expanded_by(_values([(q, W.CASCADE[q]) for q in range(4)]), _variants(fixed, "(SELECT * FROM asked WHERE query_id = 0)"), f" UNION ALL VALUES {_values(cached + made_up)}")}, {steps}"""
    best = f"""{B.TOKENS}, {B.literal_queries(W.SEARCHES)}, {B.recall()}, {B.rerank()},
      top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(coverage, 9) DESC, span, round(cos, 9) DESC, collection, base, chunk DESC) AS rank FROM scored) WHERE rank = 1)"""
    slides = f"""{best}, seqs AS (SELECT collection, base, chunk, {B.syllables_of('line')} AS s FROM chunks SEMI JOIN top USING (collection, base, chunk)),
      qw AS (SELECT query_id, unnest(ws) AS w, unnest(range(len(ws))) AS word_no FROM (SELECT query_id, {B.words_of('line')} AS ws FROM q)),
      al AS (SELECT query_id, word_no, w, string_split(w, '|') AS c, s, unnest(range(len(s) - len(string_split(w, '|')) + 1)) AS p FROM top JOIN seqs USING (collection, base, chunk) JOIN qw USING (query_id)),
      sl AS (SELECT query_id, word_no, w, len(c) AS k, p, len(list_filter(range(1, len(c) + 1), lambda j: s[p + j] = c[j])) AS m FROM al),
      pk AS (SELECT query_id, word_no, w, k, max(m) AS best, count(*) AS points FROM sl WHERE m > 0 GROUP BY ALL)"""
    sharded = f"{B.TOKENS}, {B.literal_queries(W.SEARCHES)}, {B.recall(cosine='true')}"
    made = lambda lines, heads: f"""lines AS ({lines}), {heads},
      firsts AS (SELECT w, s, min(pos) AS pos FROM pairs WHERE w <> '' AND s <> '' AND s <> w GROUP BY w, s),
      syn AS (SELECT w, list(s ORDER BY pos, s) AS s FROM firsts GROUP BY w)"""
    comma = made(
        "SELECT list_transform(string_split(lower(replace(p_name, ' ', ',') || ', ' || p_brand), ','), lambda t: trim(t)) AS t FROM part",
        "pairs AS (SELECT t[1] AS w, unnest(t[2:]) AS s, unnest(range(len(t) - 1)) AS pos FROM lines)",
    )
    synset_lines = "SELECT string_split(lower(replace(p_name, ' ', ';') || ';' || p_type), ';') AS t FROM part"
    synset_pairs = """heads AS (SELECT t, unnest(t) AS w, unnest(range(1, len(t) + 1)) AS i FROM lines),
      pairs AS (SELECT w, unnest(o) AS s, unnest(range(len(o))) AS pos FROM (SELECT w, list_concat(t[1:i - 1], t[i + 1:]) AS o FROM heads))"""
    synsets = made(synset_lines, synset_pairs)
    composed = f"""{synsets},
      bridge AS (SELECT lower(split_part(p_name, ' ', 1)) AS w, lower(p_brand) AS s FROM part),
      hops AS (SELECT w, unnest(s) AS syn, unnest(range(len(s))) AS i FROM syn SEMI JOIN bridge USING (w)),
      both_ways AS (SELECT w, s, 0 AS pos FROM bridge UNION ALL SELECT h.w, b.s, (i + 1) * 1000000 FROM hops h JOIN bridge b ON b.w = h.syn),
      cf AS (SELECT w, s, min(pos) AS pos FROM both_ways WHERE s <> w GROUP BY w, s)"""
    listed = "SELECT w, array_to_string(s, ';') AS s FROM syn"
    turns = "turns AS (SELECT CAST(conv_id AS VARCHAR) AS base, turn AS seq, text FROM conversations)"
    size = W.SMALL_CHUNK
    return {
        "dictionary_variants": _with(
            _variants(mixed, "(SELECT item_id AS query_id, text AS query FROM benchmark)"), "SELECT query_id AS item_id, variant_no, variant FROM variants"
        ),
        "search_expanded": _with(
            expanded,
            """SELECT query_id, rank, collection, base, chunk, round(coverage, 6) AS coverage, span, round(cos, 6) AS cos, round(var_cov, 6) AS var_cov,
               CASE WHEN variant_no = 0 THEN 'original' ELSE variant END AS via
            FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(coverage, 9) DESC, round(var_cov, 9) DESC, span, variant_no = 0 DESC, collection, base, chunk) AS rank FROM scored2)
            JOIN (SELECT query_id, variant_no, variant FROM kept) USING (query_id, variant_no) WHERE rank <= 8""",
        ),
        "did_you_mean": _with(f"{B.CHUNKS}, {_suggest(missing)}", "SELECT query_id, rank, word, same_sound, shared, distance FROM near"),
        "absence": _with(
            absent,
            """SELECT query_id, a.query_id NOT IN (SELECT query_id FROM anch) AS absent, '' AS dropped,
               coalesce((SELECT string_agg(word, ' ' ORDER BY rank) FROM near WHERE near.query_id = a.query_id), '') AS did_you_mean FROM asked a""",
        ),
        "literal_hits": _with(
            literal,
            """SELECT rank, collection, base, chunk, start, round(coverage, 6) AS coverage, len(ns) AS span, array_to_string(ns, ' ') AS needles,
               '…' || substr(text, greatest(p0 - 100, 0) + 1, least(p0 + length(ns[1]) + 100, length(text)) - greatest(p0 - 100, 0)) || '…' AS snippet FROM r WHERE rank <= 10""",
        ),
        "search_cascade": _with(
            cascade,
            """SELECT query_id, source, absent, expansions, dropped, rank, collection, base, chunk, round(coverage, 6) AS coverage, span, via,
               CASE WHEN absent THEN coalesce((SELECT string_agg(word, ';' ORDER BY rank) FROM near WHERE near.query_id = outcome.query_id), '') ELSE '' END AS did_you_mean
            FROM outcome LEFT JOIN hits USING (query_id)""",
        ),
        "explained_dims": _with(
            best,
            """SELECT query_id, token, dim, q_tf AS count, p.tf IS NOT NULL AS hit, coalesce(p.tf, 0) AS chunk_count
            FROM top JOIN q_tokens USING (query_id) JOIN vocab v USING (token) LEFT JOIN (SELECT collection, base, chunk, token, tf FROM postings) p USING (collection, base, chunk, token)""",
        ),
        "explained_peaks": _with(
            slides,
            """SELECT query_id, word_no, replace(w, '|', '-') AS term, k, round(best / k, 6) AS peak, (SELECT min(p) FROM sl WHERE sl.query_id = pk.query_id AND sl.word_no = pk.word_no AND sl.m = pk.best) AS peak_pos, points FROM pk""",
        ),
        "recall_sharded": _with(
            sharded,
            """SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(cos, 9) DESC, doc DESC, chunk DESC, collection, base) AS rank, collection, base, chunk, round(cos, 6) AS cos
               FROM scores JOIN (SELECT collection, base, chunk, doc FROM chunks) USING (collection, base, chunk)) WHERE rank <= 20""",
        ),
        "json_contract": _with(
            B.TOKENS,
            f"""SELECT collection, base, n_idf, chunk, start, len({B.syllables_of('line')}) AS tokens, CAST(len({B.syllables_of('line')}) - coalesce(known, 0) AS BIGINT) AS oov,
                coalesce(dims, 0) AS dims, round(norm, 6) AS norm, md5(text) AS text_md5
            FROM chunks JOIN norms USING (collection, base, chunk) JOIN (SELECT collection, base, count(*) AS n_idf FROM idf GROUP BY ALL) USING (collection, base)
            LEFT JOIN (SELECT collection, base, chunk, sum(tf) AS known, count(*) AS dims FROM postings GROUP BY ALL) USING (collection, base, chunk)""",
        ),
        "dictionary_comma": _with(comma, listed),
        "dictionary_synsets": _with(synsets, listed),
        "dictionary_composed": _with(composed, "SELECT w, string_agg(s, ';' ORDER BY pos, s) AS s FROM cf GROUP BY w"),
        "append_streamed": _with(f"{turns}, {_fold('turns', size)}", "SELECT base, chunk, start, text_md5 FROM packed"),
        "append_packed": _with(f"{turns}, {_fold('turns', size)}", "SELECT base, chunk, start, text_md5 FROM packed"),
        "append_to_existing": _with(f"{turns}, {_fold('turns', size)}", "SELECT base, chunk, start, text_md5 FROM packed"),
        "append_index": _with(
            f"{turns}, {_fold('turns', size)}, chunks AS MATERIALIZED (SELECT 'talks' AS collection, base, chunk, start, text_md5, {B.line('text')} AS line FROM packed), {B.STATISTICS}",
            f"""SELECT base, chunk, start, len({B.syllables_of('line')}) AS tokens, CAST(len({B.syllables_of('line')}) - coalesce(known, 0) AS BIGINT) AS oov,
                round(norm, 6) AS norm, round(union_norm, 5) AS union_norm, text_md5
            FROM chunks JOIN norms USING (collection, base, chunk)
            LEFT JOIN (SELECT collection, base, chunk, sum(tf) AS known FROM postings GROUP BY ALL) USING (collection, base, chunk)""",
        ),
    }


def statements() -> dict[str, str]:
    return {**_text_statements(), **_index_statements(), **_profile_statements(), **_search_statements(), **_expansion_statements()}
