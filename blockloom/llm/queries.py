"""The thin queries over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from blockloom.llm.shared import read_table


def op1_hyperdimensional_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from blockloom.llm.langid import identify

    return identify(read_table(spark, sf_dir, "documents"))


def op2_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from blockloom.llm.orc_tokens import tokenize_and_read_back

    return tokenize_and_read_back(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from blockloom.llm.mixing import in_training_order, mix

    mixed = in_training_order(mix(read_table(spark, sf_dir, "documents")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "first_position")


def op4_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from blockloom.llm.sharding import shard_documents

    placed = shard_documents(read_table(spark, sf_dir, "documents"), n_shards=8, epsilon=0.0)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_crf_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from blockloom.llm.pii import find_personal_data

    return find_personal_data(read_table(spark, sf_dir, "documents"))


def op6_kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from blockloom.llm.toxicity import toxicity

    return toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    from blockloom.llm.knn import top_k

    return top_k(read_table(spark, sf_dir, "embeddings"))


def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from blockloom.llm.decontam import contamination, contamination_digest

    return contamination_digest(contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")))


def op9_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from blockloom.llm.neardup import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "documents"), k=3, percent=85).drop("row", "stays")


def op10_guess_cost_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from blockloom.llm.secret_scan import find_secrets

    return find_secrets(read_table(spark, sf_dir, "documents"))


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
QUERIES = {f.__name__: f for f in (op1_hyperdimensional_langid, op2_orc_tokens, op3_curriculum_mix, op4_ring_shards, op5_crf_personal_data, op6_kneser_ney_toxicity, op7_voronoi_knn, op8_winnowing, op9_circulant_minhash, op10_guess_cost_secrets)}
ORACLES: dict[str, str] = {
    "op3_curriculum_mix": r"""
        WITH sized AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce('=' || source, 'null') || '|' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS h
            FROM documents
        ), sources AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS sid FROM sized GROUP BY source
        ), weighed AS (
            SELECT *, CAST(sid % 3 + 1 AS DOUBLE) AS w, 3 * source_size AS cap FROM sources
        ), ordered AS (  -- capped are those of the least cap by weight, as many as stay below the level that the others get
            SELECT *, row_number() OVER (ORDER BY cap / w, sid) AS place FROM weighed
        ), levels AS (
            SELECT m.place, (SELECT sum(source_size) FROM weighed) - coalesce((SELECT sum(cap) FROM ordered o WHERE o.place < m.place), 0) AS free,
                (SELECT sum(w) FROM ordered o WHERE o.place >= m.place) AS kept, m.cap, m.w FROM ordered m
        ), level AS (
            SELECT arg_min(CAST(free AS DOUBLE) / kept, place) AS level FROM levels WHERE w * (CAST(free AS DOUBLE) / kept) <= cap
        ), targets AS (
            SELECT source, sid, source_size, least(w * coalesce(level, 0), CAST(cap AS DOUBLE)) AS target FROM weighed, level
        ), placed AS (
            SELECT s.doc_id, s.h, s.size, t.sid, t.source_size, t.target, coalesce(sum(s.size) OVER (PARTITION BY t.sid ORDER BY s.h, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
                CAST(round(t.target) AS BIGINT) AS goal, CASE WHEN t.source_size > 0 THEN least(CAST(floor(t.target / t.source_size) AS BIGINT), 3) ELSE 0 END AS epochs
            FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
        ), taken AS (
            SELECT *, CASE WHEN epochs < 3 THEN greatest(least(goal - epochs * source_size - before, size), 0) ELSE 0 END AS extra FROM placed
        ), timed AS (
            SELECT *, least(1.0, (before + CASE WHEN epochs > 0 THEN size ELSE extra END / 2) / greatest(goal, 1)) AS u FROM taken
        )
        SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, CAST(target AS DOUBLE) AS target, CAST(epochs * size + extra AS BIGINT) AS taken,
            CAST(CASE WHEN size = 0 OR epochs + extra = 0 THEN 1.0 + h / 1152921504606846976.0
                WHEN sid % 3 = 0 THEN least((sqrt(greatest(2.25 - 2 * u, 0.0)) - 1.5) / -1.0, 1.0)
                WHEN sid % 3 = 1 THEN least(u, 1.0)
                WHEN u * 0.875 <= 0.3125 THEN least((sqrt(greatest(0.25 + u * 0.875, 0.0)) - 0.5) / 0.5, 0.5)
                ELSE least(0.5 + (sqrt(greatest(0.5625 + 3.0 * greatest(u * 0.875 - 0.3125, 0.0), 0.0)) - 0.75) / 1.5, 1.0) END AS DOUBLE) AS first_position FROM timed""",
    "op8_winnowing": rf"""
        WITH docs AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
        ), items AS (
            SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL
        ), windows AS (
            SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)
        ), grams AS (
            SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
        ), hits AS (
            SELECT DISTINCT r, i, n, item FROM grams JOIN windows USING (n, g)
        ), words AS (
            SELECT r, count(DISTINCT i + j) AS n_hit FROM (SELECT r, i, unnest(range(n)) AS j FROM hits) GROUP BY r
        ), found AS (
            SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM hits GROUP BY r
        )
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM docs LEFT JOIN words USING (r) LEFT JOIN found USING (r)""",
    "op9_circulant_minhash": rf"""
        WITH RECURSIVE docs AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents
        ), shingles AS MATERIALIZED (
            SELECT DISTINCT r, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM docs WHERE len(w) > 0)
        ), sizes AS MATERIALIZED (SELECT r, count(*) AS n FROM shingles GROUP BY r
        ), links AS MATERIALIZED (
            SELECT a.r AS a, b.r AS b FROM (SELECT x.r AS p, y.r AS q, count(*) AS shared FROM shingles x JOIN shingles y ON x.g = y.g AND x.r < y.r GROUP BY x.r, y.r) JOIN sizes a ON a.r = p JOIN sizes b ON b.r = q WHERE 100 * shared >= 85 * (a.n + b.n - shared)
        ), edges AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
        ), reach AS (SELECT r, r AS other FROM docs UNION SELECT reach.r, edges.b FROM reach JOIN edges ON reach.other = edges.a
        ), least_id AS (SELECT reach.r, min(d.doc_id) AS component_id FROM reach JOIN docs d ON d.r = reach.other GROUP BY reach.r)
        SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, coalesce(doc_id = component_id, false) AS kept FROM docs JOIN least_id USING (r) LEFT JOIN sizes USING (r)""",
    "op7_voronoi_knn": """
        WITH base AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM base q JOIN base c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0
        )
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM scored
        QUALIFY rank <= 20""",
}
