"""The registered queries of the operators in this folder, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm import bpe, centroids, filter_audit, html_extract, jaccard_join, minhash, packing, quality, span_dedup, token_count, toxicity, warc, webp
from pulsegrid.session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_jaccard_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_groups(table(spark, sf_dir, "documents")).drop("row_key")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.fingerprints(table(spark, sf_dir, "documents"))


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op5_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = span_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), F.size("_removed").cast("long").alias("n_removed"), F.expr("aggregate(_removed, 0L, (s, r) -> s + r.end - r.start)").alias("removed_bytes"))


def op6_webp_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webp.round_trip(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_warc_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = warc.round_trip(table(spark, sf_dir, "pages"), with_payload=False)
    return captures.select("metadata.page_id", F.col("read_bytes").alias("payload_bytes"), F.col("read_digest").alias("payload_digest"), "response.record_type", "refers_to")


def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_jaccard_groups": op1_jaccard_groups,
        "op2_toxicity": op2_toxicity,
        "op3_fingerprints": op3_fingerprints,
        "op4_main_text": op4_main_text,
        "op5_span_dedup": op5_span_dedup,
        "op6_webp_media": op6_webp_media,
        "op7_packing": op7_packing,
        "op8_token_counts": op8_token_counts,
        "op9_warc_captures": op9_warc_captures,
        "op10_bpe_round_trip": op10_bpe_round_trip,
        "op11_filter_audit": op11_filter_audit,
        "op12_quality": op12_quality,
        "op13_centroids": op13_centroids,
    }


OP9_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT p.page_id, CAST(p.payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
       CASE WHEN f.first_id IS NOT NULL AND p.page_id <> f.first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN p.page_id <> f.first_id THEN f.first_id END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""


OP1_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
), both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id, doc_id AS r FROM documents
  UNION
  SELECT reach.doc_id, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.r
)
SELECT reach.doc_id, CAST(coalesce(min(sizes.n), 0) AS BIGINT) AS n_shingles, min(r) AS component_id
FROM reach LEFT JOIN sizes ON sizes.doc_id = reach.doc_id GROUP BY reach.doc_id
"""


OP11_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), f AS (
  SELECT doc_id, part, len(words) < 50 AS a, 100 * len(list_distinct(words)) < 65 * len(words) AS b,
         100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
         coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e FROM w
), t AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), x AS (
  SELECT part, [a, b, c, d, e] AS fails, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM f LEFT JOIN t USING (doc_id) GROUP BY ALL
), k AS (SELECT unnest(range(1, 6)) AS i
), o AS (
  SELECT [p.i, q.i, r.i, s.i, u.i] AS o FROM k p, k q, k r, k s, k u WHERE len(list_distinct([p.i, q.i, r.i, s.i, u.i])) = 5
), y AS (
  SELECT part, o, k.i AS step, n, good, toxic, fails[o[k.i]] AS now, len(list_filter(o[1:k.i - 1], lambda j: fails[j])) > 0 AS gone, len(list_filter(fails, lambda z: z)) = 1 AS single FROM x, o, k
), z AS (
  SELECT part, o, step, sum(n) FILTER (NOT now AND NOT gone) AS kept, sum(n) FILTER (now AND NOT gone) AS removed, sum(n) FILTER (now AND gone) AS redundant, sum(n) FILTER (now AND single) AS unique_fails,
         sum(good) FILTER (now AND NOT gone) AS good_lost, sum(toxic) FILTER (now AND NOT gone) AS toxic_lost FROM y GROUP BY ALL
)
SELECT part, array_to_string(list_transform(o, lambda j: substr('ABCDE', j, 1)), '') AS filter_order, CAST(step AS INT) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
       CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
       CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, o[step]) AS BIGINT) AS shapley
FROM z
"""

_ASSIGN = """
d{r} AS (SELECT v.vec_id, c.k, sum((v.x - c.x) * (v.x - c.x)) AS d FROM v JOIN c{r} c USING (i) GROUP BY v.vec_id, c.k),
a{r} AS (SELECT vec_id, k, d FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, k) AS place FROM d{r}) WHERE place = 1)"""
_MOVE = """
s{r} AS (SELECT k, i, sum(x) AS s, count(*) AS n FROM v JOIN a{r} USING (vec_id) GROUP BY k, i),
c{t} AS (SELECT c.k, c.i, coalesce(CAST((s - ((s % n) + n) % n) // n AS BIGINT), c.x) AS x FROM c{r} c LEFT JOIN s{r} USING (k, i))"""
OP13_SQL = f"""
WITH e AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), v AS (SELECT vec_id, i, CAST(floor(256 * v[i]) AS BIGINT) AS x FROM e, (SELECT unnest(range(1, 65)) AS i)
), c0 AS (SELECT k, i, x FROM (SELECT vec_id, row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS k FROM e) JOIN v USING (vec_id) WHERE k < 40
), {",".join(_ASSIGN.format(r=r) + "," + _MOVE.format(r=r, t=r + 1) for r in range(5))}, {_ASSIGN.format(r=5)},
h AS (SELECT k, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS h FROM c5 GROUP BY k)
SELECT vec_id, CAST(k AS INT) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
FROM a5 JOIN h USING (k)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_jaccard_groups": OP1_SQL, "op9_warc_captures": OP9_SQL, "op11_filter_audit": OP11_SQL, "op13_centroids": OP13_SQL}
