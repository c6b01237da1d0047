"""The queries opN_<name> with production parameters, and SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from chronofold.llm import bpe, centroids, filters, fingerprints, licenses, packing, pii, simhash, suffix_dedup, topk, toxicity, viterbi, warc
from chronofold.llm.common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of whole documents; learned from labelled rows that are not held out. Null and empty texts get the
    score of no match, null ids count as held out, repeated rows repeat, an empty table gives an empty result, further columns are not read."""
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of whole documents by the best unigram segmentation. Null and empty texts have none, null ids stay null, ties go as
    in the tokenizer, repeated rows repeat, an empty table gives an empty result, further columns are not read."""
    return viterbi.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of whole documents and of their edited texts. Null texts are empty, null ids come last, rows of equal id go
    by a hash of their text, an empty table gives an empty result, further columns are not read."""
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document loses and keeps when all 400-byte strings that stand twice go. Null texts are empty, null ids stay
    null, a repeated row loses all that stands in its copy, an empty table gives an empty result, further columns are not read."""
    return suffix_dedup.deduplicate(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in whole documents. Null texts are empty, null ids stay null, repeated rows repeat, of matches that meet the
    leftmost counts, an empty table gives an empty result, further columns are not read."""
    return pii.find(table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and fuzzy notices in whole documents. Null texts are empty, null ids stay null, repeated rows repeat, an
    empty table gives an empty result, further columns are not read."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest integer products of every 20th row. Null, partly null and non-finite vectors and null ids take no part, ties
    go to smaller ids, rows that repeat a candidate count each, rows of the query's own id do not, an empty table gives an
    empty result, further columns are not read."""
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents tokenised, cut and packed into sequences of 2048 tokens. Null and empty texts are the end id alone, null ids stay
    null, ties between pieces of a length go by id and piece, repeated rows are packed each, an empty table gives an empty
    result, further columns are not read."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of whole documents, and what they decode to. Null and empty texts have none, null ids stay null,
    repeated rows repeat, an empty table gives an empty result, further columns are not read."""
    return bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints and components at 4 bits. Null, empty and blank texts have fingerprint zero, null ids stay null and
    name no component unless all do, repeated rows repeat, an empty table gives an empty result, further columns are not read."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC records and read back. Null html is an empty payload, null ids stay null and are smaller than all others,
    rows that repeat the largest id of a payload are all responses, an empty table gives an empty result, further columns are
    not read."""
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of whole-number vectors around 40 centroids. Vectors that are null, of another width or not all finite take no part,
    null ids stay null and start no centroid while others can, ties go to the smaller centroid, repeated rows repeat, an empty
    table gives an empty result, further columns are not read."""
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove in all their orders, by source. Null texts are empty, null sources the part '', null ids fail no E and
    have no labels, of repeated labels the larger count, repeated rows count each, an empty table gives an empty result,
    further columns are not read."""
    return filters.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _centroids_sql(k: int = centroids.CLUSTERS, rounds: int = centroids.ROUNDS) -> str:
    """The rounds one after the other; a vector's nearest centroid is the least of distance * 64 + number."""
    whole = "CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)"
    parts = [
        f"""v AS MATERIALIZED (
            SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: {whole}) AS e FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        )""",
        f"""c0 AS MATERIALIZED (
            SELECT CAST(row_number() OVER (ORDER BY h NULLS LAST, e) - 1 AS BIGINT) AS c, e FROM (SELECT sha256('2:' || vec_id) AS h, e FROM v ORDER BY h NULLS LAST, e LIMIT {k})
        )""",
    ]
    gap = "CAST(list_sum(list_transform(list_zip(v.e, m.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT)"
    for i in range(rounds + 1):
        parts.append(f"a{i} AS MATERIALIZED (SELECT r, any_value(v.vec_id) AS vec_id, any_value(v.e) AS e, min({gap} * 64 + m.c) AS best FROM v CROSS JOIN c{i} m GROUP BY r)")
        if i < rounds:
            parts.append(f"t{i} AS (SELECT best % 64 AS c, unnest(range(64)) AS pos, unnest(e) AS x FROM a{i})")
            parts.append(f"u{i} AS (SELECT c, pos, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM t{i} GROUP BY c, pos)")
            parts.append(f"w{i} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY pos) AS e FROM u{i} GROUP BY c)")
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT o.c, coalesce(w.e, o.e) AS e FROM c{i} o LEFT JOIN w{i} w ON o.c = w.c)")
    return f"""
        WITH {", ".join(parts)}
        SELECT a.vec_id, CAST(a.best % 64 AS INTEGER) AS cluster, a.best // 64 AS distance,
            CAST(sum(a.best // 64) OVER (PARTITION BY a.best % 64) AS BIGINT) AS cluster_inertia, CAST(sum(a.best // 64) OVER () AS BIGINT) AS inertia,
            sha256(array_to_string(m.e, ',')) AS centroid_sha256
        FROM a{rounds} a JOIN c{rounds} m ON a.best % 64 = m.c
    """


_OPERATORS = (
    op1_toxicity, op2_token_counts, op3_fingerprints, op4_suffix_dedup, op5_pii, op6_license_scan, op7_exact_top_k, op8_best_fit_packing, op9_byte_bpe, op10_simhash, op11_warc, op12_centroids,
    op13_filter_audit,
)
QUERIES = {f.__name__: f for f in _OPERATORS}
ORACLES: dict[str, str] = {
    "op7_exact_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0
        )
        SELECT query_id, rank, vec_id, score
        FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s) WHERE rank <= 20
    """,
    "op11_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
        d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS h, max(page_id) OVER (PARTITION BY b) AS last FROM p),
        e AS (
            SELECT *, list_transform(range(32), lambda i: CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) // [32768, 1024, 32, 1][i % 4 + 1] % 32) AS digits FROM d
        )
        SELECT page_id, payload_bytes, array_to_string(list_transform(digits, lambda x: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', x + 1, 1)), '') AS payload_digest,
            CASE WHEN last IS NULL OR page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN last IS NULL OR page_id = last THEN NULL ELSE last END AS refers_to
        FROM e
    """,
    "op12_centroids": _centroids_sql(),
    "op13_filter_audit": r"""
        WITH l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
        d AS (
            SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
                min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first
            FROM documents
        ),
        m AS (
            SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
                (len(words) < 200)::BIGINT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::BIGINT
                + 4 * (100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * len(t))::BIGINT + 8 * regexp_matches(t, '[#$%&*|]')::BIGINT + 16 * coalesce(d.doc_id > first, false)::BIGINT AS mask
            FROM d LEFT JOIN l ON d.doc_id = l.doc_id
        ),
        cells AS (SELECT part, mask, count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic FROM m GROUP BY part, mask),
        f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
        o AS (
            SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a, f b, f c, f d, f e
            WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
        ),
        s AS (
            SELECT filter_order, step, CAST(1 << (ascii(substr(filter_order, step, 1)) - 65) AS BIGINT) AS own,
                CAST(coalesce(list_sum(list_transform(range(1, step), lambda j: 1 << (ascii(substr(filter_order, j, 1)) - 65))), 0) AS BIGINT) AS before
            FROM o, (SELECT unnest(range(1, 6)) AS step)
        ),
        r AS (
            SELECT part, filter_order, step, own, CAST(sum(n) FILTER (mask & (own | before) = 0) AS BIGINT) AS kept, CAST(sum(n) FILTER (mask & own <> 0 AND mask & before = 0) AS BIGINT) AS removed,
                CAST(sum(n) FILTER (mask & own <> 0 AND mask & before <> 0) AS BIGINT) AS redundant, CAST(sum(n) FILTER (mask = own) AS BIGINT) AS unique_fails,
                CAST(sum(good) FILTER (mask & own <> 0 AND mask & before = 0) AS BIGINT) AS good_lost, CAST(sum(toxic) FILTER (mask & own <> 0 AND mask & before = 0) AS BIGINT) AS toxic_lost
            FROM cells, s GROUP BY part, filter_order, step, own
        )
        SELECT part, filter_order, CAST(step AS INTEGER) AS step, coalesce(kept, 0) AS kept, coalesce(removed, 0) AS removed, coalesce(redundant, 0) AS redundant, coalesce(unique_fails, 0) AS unique_fails,
            coalesce(good_lost, 0) AS good_lost, coalesce(toxic_lost, 0) AS toxic_lost, CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
        FROM r
    """,
}
