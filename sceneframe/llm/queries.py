"""The registered queries of this package and, where SQL can express them, their oracles."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sceneframe.llm import centroids
from sceneframe.llm import exact_dedup as exact
from sceneframe.llm import fingerprints as marks
from sceneframe.llm import filter_audit as audit
from sceneframe.llm import html_text, licences, mixing, near_dedup, packing
from sceneframe.llm import quality as quality_
from sceneframe.llm import tokens as tokens_
from sceneframe.llm import toxicity as toxicity_
from sceneframe.llm import warc as archives


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1)


def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(_table(spark, sf_dir, "documents"))


def document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marks.edited_fingerprints(_table(spark, sf_dir, "documents"))


def minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), shingle_words=3, percent=85)


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens_.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(_table(spark, sf_dir, "pages"))


def license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(_table(spark, sf_dir, "documents"))


def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(_table(spark, sf_dir, "embeddings"), clusters=40, rounds=5, width=64, scale=256, seed="2:")


def warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = archives.archive_pages(_table(spark, sf_dir, "pages"), least_bytes=100)
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_best_fit_packing": best_fit_packing,
    "op2_exact_dedup": exact_dedup,
    "op3_document_fingerprints": document_fingerprints,
    "op4_minhash_near_dedup": minhash_near_dedup,
    "op5_token_counts": token_counts,
    "op6_quality_classifier": quality_classifier,
    "op7_html_extraction": html_extraction,
    "op8_license_scans": license_scans,
    "op9_toxicity": toxicity,
    "op10_source_mixing": source_mixing,
    "op11_filter_interaction_audit": filter_interaction_audit,
    "op12_centroid_clustering": centroid_clustering,
    "op13_warc": warc,
    "pipeline": pipeline,
}



def _rounds_sql(rounds: int) -> str:
    """Plain k-means: every distance worked out, round by round. Doubles hold these whole numbers exactly."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
        a{r} AS MATERIALIZED (
            SELECT k.row, any_value(k.vec_id) AS vec_id, any_value(k.v) AS v, min(struct_pack(
                       d := (list_dot_product(k.v, k.v) + list_dot_product(c.v, c.v) - 2 * list_dot_product(k.v, c.v))::BIGINT, c := c.c)) AS best
            FROM kept k, c{r} c GROUP BY k.row
        )""")
        if r < rounds:
            steps.append(f"""
        c{r + 1} AS MATERIALIZED (
            SELECT c.c, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN (
                SELECT c, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY i) AS v FROM (
                    SELECT best.c AS c, i, sum(v[i]::HUGEINT) AS s, count(*)::HUGEINT AS n FROM a{r}, range(1, 65) t(i) GROUP BY best.c, i
                ) GROUP BY c
            ) m ON m.c = c.c
        )""")
    return ",".join(steps)


#: Those that are plain SQL; the rest is held against brute force in tests/llm.
ORACLES = {
    "op2_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER same AS keep_id,
               count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
        WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
    "op11_filter_interaction_audit": """
        WITH named AS (
            SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id
        ), read AS (
            SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
                   regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words
            FROM documents
        ), marked AS (
            SELECT doc_id, part,
                   CASE WHEN len(words) < 200 THEN 'A' ELSE '' END
                   || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
                   || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 'C' ELSE '' END
                   || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
                   || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS fails
            FROM read
        ), cells AS (
            SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
            FROM marked LEFT JOIN named USING (doc_id) GROUP BY part, fails
        ), letters(f) AS (
            VALUES ('A'), ('B'), ('C'), ('D'), ('E')
        ), orders AS (
            SELECT a.f || b.f || c.f || d.f || e.f AS filter_order
            FROM letters a, letters b, letters c, letters d, letters e
            WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
        ), steps AS (
            SELECT filter_order, step::INTEGER AS step, substr(filter_order, step, 1) AS f, substr(filter_order, 1, step - 1) AS before
            FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
        ), counted AS (
            SELECT part, filter_order, step, f,
                   sum(CASE WHEN NOT early AND NOT here THEN n ELSE 0 END) AS kept,
                   sum(CASE WHEN NOT early AND here THEN n ELSE 0 END) AS removed,
                   sum(CASE WHEN early AND here THEN n ELSE 0 END) AS redundant,
                   sum(CASE WHEN fails = f THEN n ELSE 0 END) AS unique_fails,
                   sum(CASE WHEN NOT early AND here THEN good ELSE 0 END) AS good_lost,
                   sum(CASE WHEN NOT early AND here THEN toxic ELSE 0 END) AS toxic_lost
            FROM (SELECT *, contains(fails, f) AS here, translate(fails, before, '') <> fails AS early FROM cells, steps)
            GROUP BY part, filter_order, step, f
        )
        SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
               unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
               (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
        FROM counted
    """,
    "op12_centroid_clustering": f"""
        WITH kept AS MATERIALIZED (
            SELECT row_number() OVER () AS row, vec_id, [floor(256 * x::DOUBLE) for x in embedding] AS v
            FROM embeddings WHERE len(embedding) = 64 AND len([x for x in embedding if x IS NOT NULL AND isfinite(x)]) = 64
        ), c0 AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c, v FROM kept ORDER BY sha256('2:' || vec_id) LIMIT 40
        ), {_rounds_sql(5)}
        SELECT vec_id, best.c::INTEGER AS cluster, best.d AS distance,
               (sum(best.d) OVER (PARTITION BY best.c))::BIGINT AS cluster_inertia, (sum(best.d) OVER ())::BIGINT AS inertia,
               sha256(array_to_string([x::BIGINT for x in c5.v], ',')) AS centroid_sha256
        FROM a5 JOIN c5 ON c5.c = a5.best.c
    """,
    "op13_warc": """
        WITH read AS (
            SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
        ), grouped AS (
            SELECT page_id, octet_length(payload) AS size, sha256(payload) AS digest, min(page_id) OVER (PARTITION BY payload) AS first FROM read
        )
        SELECT page_id, size::BIGINT AS payload_bytes, digest AS payload_digest,
               CASE WHEN size >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN size >= 100 AND page_id <> first THEN first END AS refers_to
        FROM grouped
    """,
}
