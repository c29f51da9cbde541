"""The registered queries of the training-data operators, and their SQL.

Each applies its operator with production parameters to its whole table and derives
the contract columns from the operator's own output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, idfile, jaccard_join, negatives, packing, pieces, pii, quality, spelling, syncmers, token_counts, warc, winnow



def vocabulary(name: str) -> str:
    """Where a public vocabulary file is, on the driver and on every executor alike."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_warc(_read(spark, sf_dir, "pages"))
    return warc.read_warc(archives, with_payload=False).select(
        F.col("row_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to_row").alias("refers_to"), "error")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    model = quality.train(docs, labels)
    return quality.scored(docs.select("doc_id", "text"), model).select(
        "doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op4_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_pieces(_read(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), with_ids=False)


def op5_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = idfile.write_ids(_read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=2)
    return idfile.read_ids(manifest)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_read(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_read(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_spans(_read(spark, sf_dir, "documents"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprints(_read(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_read(spark, sf_dir, "documents"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_read(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(_read(spark, sf_dir, "embeddings"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_warc, op2_quality, op3_packing, op4_merge_dropout, op5_id_files, op6_token_counts,
                                   op7_jaccard_join, op8_pii, op9_fingerprints, op10_exact_dedup, op11_spelling, op12_hard_negatives, op13_decontamination)}

ORACLE = {
    "op1_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        d AS (SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha256(body) AS payload_digest FROM p),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to,
               CAST(NULL AS VARCHAR) AS error
        FROM f""",
    "op10_exact_dedup": r"""
        WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, text_sha256
        FROM t WINDOW w AS (PARTITION BY text_sha256)""",
    "op11_spelling": r"""
        WITH RECURSIVE crc_table AS (
            SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
        runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
        counted AS (SELECT doc_id, run, count(*) AS c FROM runs WHERE length(run) >= 7 GROUP BY ALL),
        bytes AS (SELECT *, list_transform(range(CAST(length(hex(encode(doc_id || ':' || run))) / 2 AS BIGINT)),
                         lambda i: CAST(('0x' || substr(hex(encode(doc_id || ':' || run)), 2 * i + 1, 2)) AS BIGINT)) AS b FROM counted),
        hashed AS (SELECT run, c, xor(list_reduce(list_prepend(4294967295, b), lambda s, x: xor(s >> 8, t[xor(s & 255, x) + 1])), 4294967295) AS h FROM bytes, crc_table),
        cut AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM hashed),
        v AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
        places AS (SELECT word, n, unnest(range(length(word))) AS i FROM v),
        gaps AS (SELECT word, n, substr(word, 1, i) AS l, substr(word, i + 2) AS r FROM places),
        shorter AS (SELECT DISTINCT g.word AS long, g.n AS long_n, v.word AS short, v.n AS short_n FROM gaps g JOIN v ON g.l || g.r = v.word),
        pairs AS (SELECT long AS word, short AS near, short_n AS near_n FROM shorter UNION ALL SELECT short, long, long_n FROM shorter
                  UNION ALL SELECT a.word, b.word, b.n FROM gaps a JOIN gaps b ON a.l = b.l AND a.r = b.r AND a.word <> b.word),
        best AS (SELECT word, count(*) AS n_near, max(near_n) AS m, arg_min(near, (-near_n, near)) AS near FROM pairs GROUP BY word),
        forms AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * n THEN near END AS form, CASE WHEN m >= 10 * n THEN m END AS form_n FROM v LEFT JOIN best USING (word)),
        way AS (SELECT word, word AS root, form AS next FROM forms
                UNION ALL SELECT w.word, f.word, f.form FROM way w JOIN forms f ON w.next = f.word)
        SELECT f.word, f.form, w.root, f.n, f.n_near, f.form_n FROM forms f JOIN way w ON f.word = w.word AND w.next IS NULL""",
    "op12_hard_negatives": """
        WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
                   FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
              FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
        p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
              QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
        WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY rank <= 3""",
    "op13_decontamination": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        i AS (SELECT item_id, least(10, len(w)) AS n, w, unnest(range(1, CAST(greatest(1, len(w) - 9) AS BIGINT) + 1)) AS j FROM b WHERE len(w) > 0),
        iw AS (SELECT DISTINCT item_id, n, array_to_string(w[j:j + n - 1], ' ') AS s FROM i),
        dp AS (SELECT doc_id, n, w, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS j FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n),
        dw AS (SELECT doc_id, n, j, array_to_string(w[j:j + n - 1], ' ') AS s FROM dp),
        h AS (SELECT doc_id, item_id, dw.n, j FROM dw JOIN iw ON dw.n = iw.n AND dw.s = iw.s),
        words AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(j, j + n)) AS p FROM h) GROUP BY doc_id),
        names AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM h) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN words USING (doc_id) LEFT JOIN names USING (doc_id)""",
}
