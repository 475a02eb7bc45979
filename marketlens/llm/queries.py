"""The thin ``opN_*`` queries over the corpus operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (decontaminate, licenses, line_dedup, mixing, ngram_join, phrases, pii, quality, token_scan, topk, toxicity, warc,
               whitening)
from .shared import bounded_batches

#: Target shares of 60.  The known sources without a weight of their own (src9 to src19) have one each, and unknown and
#: null sources together are one class with share 1.
SOURCE_SHARES = {"src0": 15, "src1": 6, "src2": 6, "src3": 6, "src4": 3, "src5": 3, "src6": 3, "src7": 3, "src8": 3,
                 **{f"src{i}": 1 for i in range(9, 20)}}
OTHER_SHARE = 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark, sf_dir):
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), n=5, percent=80)


def op2_token_counts(spark, sf_dir):
    return token_scan.token_counts(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark, sf_dir):
    return line_dedup.drop_frequent_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), 10).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def _scored(scored: DataFrame, column: str, parts: int, held_out: int) -> DataFrame:
    return scored.select("doc_id", quality.held_out_column(parts, held_out).alias("held_out"), F.col(column).alias("score"),
                         (F.col(column) >= 0.5).cast("int").alias("predicted"))


def op4_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return _scored(toxicity.score_toxicity(docs, model), "toxicity_score", 5, 0)


def op5_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix_sources(docs, SOURCE_SHARES, OTHER_SHARE).drop("text")


def op6_decontaminate(spark, sf_dir):
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    return _scored(quality.score_quality(docs, model), "quality_score", 3, 1)


def op8_license_scan(spark, sf_dir):
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op9_warc(spark, sf_dir):
    responses = warc.page_responses(table(spark, sf_dir, "pages"))
    made = warc.build_derivatives(responses)
    return made.select("record_id", "warc_type", "refers_to", "target_uri", "date", "content_type", "block_digest",
                       "payload_digest", F.octet_length("block").cast("long").alias("content_length"))


def op10_exact_topk(spark, sf_dir):
    return topk.exact_topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op11_phrases(spark, sf_dir):
    return phrases.collocations(table(spark, sf_dir, "documents"), least=100, longest=5, top=2000, percent=100)


def op12_pii(spark, sf_dir):
    found = pii.personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = F.transform("base", lambda s: s["kind"])
    n = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(pii.KINDS)]
    return found.select("doc_id", *n, F.sha2(pii.span_list(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        pii.span_list(F.col("spans")).alias("spans"))


def op13_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=8)


QUERIES = {f.__name__: f for f in (
    op1_ngram_join, op2_token_counts, op3_line_dedup, op4_toxicity, op5_mixing, op6_decontaminate, op7_quality,
    op8_license_scan, op9_warc, op10_exact_topk, op11_phrases, op12_pii, op13_whitening)}

_JOIN_SQL = r"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
        WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS shingle FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
e AS MATERIALIZED (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT DISTINCT x AS node, x AS root FROM e UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.node AND r.root < e.y),
m AS (SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.root, doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.node = doc_id"""

_LINE_SQL = """
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row_no, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT row_no, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d),
k AS (SELECT row_no, doc_id, i, line, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT row_no) >= 10),
j AS (SELECT k.*, f.key IS NOT NULL AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY row_no, doc_id"""

_TOPK_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT DISTINCT vec_id AS query_id, v AS asked FROM v WHERE vec_id % 50 = 0),
s AS (SELECT query_id, asked, vec_id, CAST(list_inner_product(asked, v) AS BIGINT) AS score
    FROM q JOIN v ON query_id <> vec_id AND len(asked) = len(v)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, asked ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""

_PHRASE_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS row_no,
    string_split(translate(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]', chr(10), 'g'), chr(9), ' '), chr(10)) AS pieces FROM documents),
p AS (SELECT lang, list_filter(string_split(piece, ' '), lambda x: x <> '') AS w FROM (SELECT lang, unnest(pieces) AS piece FROM d)),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])) AS ws
    FROM p, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k),
f AS (SELECT lang, k, ws, array_to_string(ws, ' ') AS phrase, CAST(count(*) AS HUGEINT) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
t AS (SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM p GROUP BY lang),
i AS (SELECT lang, array_to_string(ws[s.a:s.b], ' ') AS phrase, max(f.f) AS longer FROM f,
    (SELECT a, b FROM (SELECT unnest(range(1, 6)) AS a), (SELECT unnest(range(1, 6)) AS b) WHERE b > a) s
    WHERE s.b <= k AND s.b - s.a + 1 < k GROUP BY ALL),
c AS (SELECT f.lang, f.k, f.ws, f.phrase, f.f AS a FROM f LEFT JOIN i USING (lang, phrase)
    WHERE f.k > 1 AND (longer IS NULL OR 100 * longer < 100 * f.f)),
u AS (SELECT c.lang, c.phrase, a, cut, l.f AS l, r.f AS r, n, (1000 * a * n) // (l.f * r.f) AS score
    FROM c JOIN (SELECT unnest(range(1, 5)) AS cut) ON cut < c.k
    JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.ws[1:cut], ' ')
    JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.ws[cut + 1:c.k], ' ')
    JOIN t ON t.lang = c.lang),
b AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS INTEGER) AS rank, phrase,
    CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM b QUALIFY rank <= 2000"""

ORACLE_SQL = {
    "op1_ngram_join": _JOIN_SQL,
    "op3_line_dedup": _LINE_SQL,
    "op8_license_scan": licenses.license_sql(),
    "op10_exact_topk": _TOPK_SQL,
    "op11_phrases": _PHRASE_SQL,
}
