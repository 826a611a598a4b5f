"""Registered queries of the operators, with production parameters, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexivane.llm import (
    ann, complement_packing, embedding_dedup, language_id, lexical_rank, line_dedup, lm_scoring, ngram_join, packing, sentence_pieces, token_alignment, url_filter, warc,
)
from lexivane.llm.common import table

# Rules of the registered query: host, path, verdict.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op1_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents, and whether they decode to the text they came from."""
    return sentence_pieces.round_trip(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the three quarters that are not held out."""
    return language_id.identified(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document that repeat an earlier line, or nearly do."""
    return line_dedup.report(table(spark, sf_dir, "documents"), short_repeats=True, near_words=True)


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every document, learned from the nine tenths that are not held out."""
    return lm_scoring.scored(table(spark, sf_dir, "documents"))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors by inner product of every vector whose id is divisible by 20."""
    return ann.every_twentieth(table(spark, sf_dir, "embeddings"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, deciding rule and verdict of every page."""
    return url_filter.judged(table(spark, sf_dir, "pages"), RULES)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the normalised archives of all pages hold, read record by record."""
    return warc.archived(table(spark, sf_dir, "pages"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of vectors of one label with a cosine of 0.93 and more."""
    return embedding_dedup.deduplicated(table(spark, sf_dir, "embeddings"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose word 4-grams agree to 85 % and more."""
    return ngram_join.linked(table(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links between the tokens of two tokenizers over every document, and how usual the links are."""
    return token_alignment.compared(table(spark, sf_dir, "documents"))


def op12_lexical_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents for every benchmark item."""
    return lexical_rank.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_complement_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in as few sequences of 2048 tokens as can be."""
    return complement_packing.pack(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentence_pieces": op1_sentence_pieces,
    "op2_language_id": op2_language_id,
    "op3_line_dedup": op3_line_dedup,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_ann": op5_ann,
    "op6_url_filter": op6_url_filter,
    "op7_warc": op7_warc,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_packing": op9_packing,
    "op10_ngram_jaccard": op10_ngram_jaccard,
    "op11_token_alignment": op11_token_alignment,
    "op12_lexical_rank": op12_lexical_rank,
    "op13_complement_packing": op13_complement_packing,
}

_COMPONENTS = """
    walk AS (
        SELECT node, node AS seen FROM nodes
        UNION
        SELECT w.node, l.b AS seen FROM walk AS w JOIN links AS l ON w.seen = l.a
    ),
    reached AS (SELECT node, min(seen) AS component_id FROM walk GROUP BY node)
"""

SQL: dict[str, str] = {
    "op6_url_filter": """
        WITH parts AS (
            SELECT page_id,
                   coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                   coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
            FROM pages
        ),
        rules(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block'))
        SELECT page_id, host, path,
               (SELECT h || p FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) ORDER BY length(h || p) DESC LIMIT 1) AS rule,
               coalesce((SELECT v FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) ORDER BY length(h || p) DESC LIMIT 1), 'allow') AS verdict
        FROM parts
    """,
    "op7_warc": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        f AS (SELECT payload_digest AS d, min(page_id) AS least FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN least <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN least <> page_id THEN least END AS refers_to
        FROM p LEFT JOIN f ON payload_digest = d
    """,
    "op8_embedding_dedup": """
        WITH RECURSIVE nodes AS (SELECT vec_id AS node FROM embeddings),
        v AS (
            SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
            WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ),
        links AS (
            SELECT x.vec_id AS a, y.vec_id AS b FROM v AS x JOIN v AS y ON x.label = y.label AND x.vec_id <> y.vec_id
            WHERE list_cosine_similarity(x.e, y.e) >= 0.93
        ),""" + _COMPONENTS + """
        SELECT node AS vec_id, (SELECT count(*) FROM links WHERE a = node) AS n_links, component_id, node = component_id AS kept FROM reached
    """,
    "op10_ngram_jaccard": """
        WITH RECURSIVE nodes AS (SELECT doc_id AS node FROM documents),
        w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
        ),
        g AS (
            SELECT DISTINCT doc_id, gram FROM (
                SELECT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
                    ELSE list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')) END) AS gram FROM w)
        ),
        n AS (SELECT doc_id, count(*) AS n_shingles FROM g GROUP BY doc_id),
        met AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g AS x JOIN g AS y ON x.gram = y.gram AND x.doc_id <> y.doc_id GROUP BY ALL),
        links AS (
            SELECT a, b FROM met JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b
            WHERE 100 * c >= 85 * (x.n_shingles + y.n_shingles - c)
        ),""" + _COMPONENTS + """
        SELECT node AS doc_id, coalesce(n_shingles, 0) AS n_shingles, component_id FROM reached LEFT JOIN n ON doc_id = node
    """,
    "op12_lexical_rank": """
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms
            FROM documents
        ),
        size AS (SELECT r, doc_id, len(terms) AS n FROM d WHERE len(terms) > 0),
        whole AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS big_l FROM size),
        asked AS (
            SELECT item_id, term, count(*) AS q FROM (
                SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark)
            GROUP BY ALL
        ),
        held AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
        weights AS (SELECT term, floor(1000 * ln((2 * any_value(big_n) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM held, whole GROUP BY term),
        impacts AS (
            SELECT r, doc_id, term, (1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * big_n) // big_l)) AS impact
            FROM held JOIN size USING (r), whole
        ),
        scores AS (
            SELECT item_id, r, doc_id, sum(q * w * impact)::BIGINT AS score
            FROM asked JOIN weights USING (term) JOIN impacts USING (term) GROUP BY ALL
        )
        SELECT item_id, rank, doc_id, score FROM (
            SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scores WHERE score > 0)
        WHERE rank <= 20
    """,
}
