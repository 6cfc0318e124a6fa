"""Registered queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import collocations, decontaminate, jaccard, packing, quality, ranking, repeats, sharding, simhash, tokens, toxicity, urlfilter, warc
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeated_spans(table(spark, sf_dir, "documents"))


@query
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"))


@query
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.archived(table(spark, sf_dir, "pages"))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"))


@query
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op10_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


@query
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


@query
def op12_nra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op13_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(table(spark, sf_dir, "documents"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE["op11_collocations"] = f"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\n\x0B\x0C\r]')) AS piece FROM documents
), split AS (
    SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS ws FROM pieces
), starts AS (
    SELECT lang, ws, k, unnest(generate_series(1, len(ws) - k + 1)) AS i FROM split, (VALUES (1), (2), (3)) AS s(k)
), f AS (
    SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM starts GROUP BY ALL
), totals AS (
    SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang
), cand AS (
    SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND f >= 10
), cuts AS (
    SELECT lang, k, phrase, a, cut, array_to_string(ws[1:cut], ' ') AS head, array_to_string(ws[cut + 1:k], ' ') AS tail
    FROM cand, (VALUES (1), (2)) AS c(cut) WHERE cut < k
), scored AS (
    SELECT c.lang, c.k, c.phrase, c.a, c.cut, l.f AS l, r.f AS r, (1000000::HUGEINT * c.a * c.a) // (l.f::HUGEINT * r.f) AS score
    FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = c.head JOIN f r ON r.lang = c.lang AND r.phrase = c.tail
), best AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), longer AS (
    SELECT lang, phrase, max(a) AS most FROM (
        SELECT lang, array_to_string(ws[1:2], ' ') AS phrase, a FROM cand WHERE k = 3
        UNION ALL SELECT lang, array_to_string(ws[2:3], ' '), a FROM cand WHERE k = 3) GROUP BY ALL
), kept AS (
    SELECT b.* FROM best b LEFT JOIN longer g ON g.lang = b.lang AND g.phrase = b.phrase AND b.k = 2
    WHERE g.most IS NULL OR 100 * g.most < 50 * b.a
)
SELECT kept.lang, CAST(row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) AS BIGINT) AS rank, phrase,
    CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM kept JOIN totals ON totals.lang = kept.lang QUALIFY rank <= 2000
"""

_TERMS = "regexp_extract_all(" + _LOWER + ", '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

ORACLE["op12_nra"] = f"""
WITH doc AS (
    SELECT doc_id, row_number() OVER () AS d, {_TERMS} AS ts FROM documents
), sizes AS (
    SELECT count(*) FILTER (len(ts) > 0) AS big_n, sum(len(ts))::BIGINT AS big_l FROM doc
), item AS (
    SELECT item_id, row_number() OVER () AS q, {_TERMS} AS ts FROM benchmark
), asked AS (
    SELECT DISTINCT q, item_id, unnest(ts) AS term FROM item
), tf AS (
    SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(ts) AS term FROM doc) GROUP BY ALL
), df AS (
    SELECT term, count(*) AS df FROM tf GROUP BY term
), w AS (
    SELECT term, CAST(floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM df, sizes
), m AS (
    SELECT d, doc_id, 100 - 50 + ((50 * len(ts)::BIGINT * big_n) // big_l) AS m FROM doc, sizes WHERE len(ts) > 0
), scored AS (
    SELECT q, item_id, m.doc_id, m.d, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
    FROM asked JOIN tf USING (term) JOIN w USING (term) JOIN m ON m.d = tf.d GROUP BY ALL
), ranked AS (
    SELECT q, item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS INTEGER) AS rank
    FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""


def registered() -> tuple[dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str]]:
    """All queries of this package, the pipeline included, and the SQL of those that have one."""
    import corpus_pipeline

    oracle = dict(ORACLE)
    if corpus_pipeline.ORACLE_SQL is not None:
        oracle["pipeline"] = corpus_pipeline.ORACLE_SQL
    return {**QUERIES, "pipeline": corpus_pipeline.run}, oracle
