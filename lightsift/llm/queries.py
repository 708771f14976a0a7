"""Registered queries of the corpus operators, one per operator, over whole tables; their DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path
from .cross_tokenizer import cross_tokenizer
from .decontaminate import decontaminate
from .exact_dedup import exact_dedup
from .filter_audit import filter_audit
from .html_text import extract_text
from .jaccard_join import jaccard_join
from .license_scan import scan_licenses
from .mixing import mix_sources
from .simhash_dedup import simhash_dedup
from .substring_dedup import substring_dedup
from .suffix_dedup import suffix_dedup
from .toxicity import toxicity
from .token_store import verify_tokens, write_tokens

END_ID = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def covered(spans: str) -> Column:
    """Places that a list of disjoint intervals covers."""
    return F.coalesce(F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]), F.lit(0).cast("long"))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_words", covered("spans").alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages")).select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_dedup(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), END_ID)
    return verify_tokens(spark, path).select(F.col("id").alias("doc_id"), "start", "n_tokens", F.col("crc").alias("ids_crc32"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target", "taken")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", covered("spans").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumn("n_hit", covered("spans"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_licenses(table(spark, sf_dir, "documents"))
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"]))), ",")
    return out.select(F.col("id").alias("doc_id"), "n_words", F.size("matches").cast("long").alias("n_matches"), names.alias("licenses"), F.to_json("matches").alias("spans"))


def op11_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return cross_tokenizer(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")).withColumnRenamed("id", "doc_id")


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_exact_dedup, op2_toxicity, op3_substring_dedup, op4_html_text, op5_simhash_dedup, op6_token_store, op7_mix_sources, op8_suffix_dedup, op9_decontaminate, op10_license_scan, op11_cross_tokenizer, op12_jaccard_join, op13_filter_audit)}

ORACLES: dict[str, str] = {
    "op1_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY body) AS kept, sha256(body) AS text_sha256
        FROM t""",
    "op3_substring_dedup": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        g AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS t FROM w, unnest(range(1, len(ws) - 11)) AS u(i)),
        f AS (SELECT t, min(doc_id) AS m FROM g GROUP BY t),
        r AS (SELECT DISTINCT doc_id, i + k AS p FROM g JOIN f USING (t), unnest(range(0, 13)) AS v(k) WHERE doc_id > m),
        words AS (SELECT doc_id, p, ws[p] AS word FROM w, unnest(range(1, len(ws) + 1)) AS u(p)),
        kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS body, count(*) AS n FROM words ANTI JOIN r USING (doc_id, p) GROUP BY doc_id)
        SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
        FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id""",
    "op7_mix_sources": r"""
        WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                          CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS u FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
                     CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM d GROUP BY source),
        l AS (SELECT source, source_size, w,
                     (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE
                      - CAST(coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
                     / sum(w) OVER (ORDER BY 2 * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s),
        t AS (SELECT source, source_size, least(CAST(2 * source_size AS DOUBLE), max(level) OVER () * w) AS target FROM l),
        n AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS times FROM t),
        c AS (SELECT d.doc_id, d.source, d.size, n.source_size, n.target, n.times, n.target - n.times * n.source_size AS need,
                     sum(d.size) OVER (PARTITION BY d.source ORDER BY u) AS upto
              FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source)
        SELECT doc_id, source, size, source_size, target, CAST(size * (times + CASE WHEN need > 0 AND upto <= need THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM c""",
    "op9_decontaminate": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
        b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
        iw AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS t FROM b, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS u(i) WHERE len(ws) > 0),
        dw AS (SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS t FROM d, (SELECT DISTINCT n FROM iw), unnest(range(1, len(ws) - n + 2)) AS u(i)),
        h AS (SELECT doc_id, i, n, item_id FROM dw JOIN iw USING (n, t)),
        p AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM h, unnest(range(0, n)) AS u(k) GROUP BY doc_id),
        o AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN p ON d.doc_id = p.doc_id LEFT JOIN o ON d.doc_id = o.doc_id""",
    "op12_jaccard_join": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        i AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos, len(ws) AS n FROM w),
        h AS (SELECT doc_id, pos, n, concat_ws(' ', word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o) AS x FROM i WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
        k AS (SELECT doc_id, list(DISTINCT x ORDER BY x) AS t FROM h WHERE pos <= greatest(n - 4, 1) GROUP BY doc_id),
        s AS (SELECT w.doc_id, coalesce(k.t, []) AS t FROM w LEFT JOIN k ON k.doc_id = w.doc_id),
        c AS MATERIALIZED (SELECT t, min(doc_id) AS rep, len(t) AS n FROM s WHERE len(t) > 0 GROUP BY t),
        e AS MATERIALIZED (SELECT rep, n, unnest(t) AS x FROM c),
        p AS MATERIALIZED (SELECT a.rep AS a, b.rep AS b FROM e a JOIN e b ON a.x = b.x AND a.rep < b.rep WHERE 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n
              GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
        l AS MATERIALIZED (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
        r AS (SELECT rep AS node, rep AS root FROM c UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node),
        g AS (SELECT node, min(root) AS root FROM r GROUP BY node)
        SELECT doc_id, CAST(len(s.t) AS BIGINT) AS n_shingles, coalesce(g.root, doc_id) AS component_id FROM s LEFT JOIN c ON c.t = s.t LEFT JOIN g ON g.node = c.rep""",
    "op13_filter_audit": r"""
        WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
                          doc_id > min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS again FROM documents),
        f AS (SELECT doc_id, part, [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws), 100 * len(regexp_replace(body, '[^A-Z]', '', 'g')) > 2 * len(body),
                          regexp_matches(body, '[#$%&*|]'), again] AS fails FROM d),
        m AS (SELECT part, fails[1]::INT + 2 * fails[2]::INT + 4 * fails[3]::INT + 8 * fails[4]::INT + 16 * fails[5]::INT AS mask,
                     count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic FROM f LEFT JOIN labels USING (doc_id) GROUP BY ALL),
        l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
        o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
        s AS (SELECT filter_order, step, 1 << (ascii(filter_order[step]) - 65) AS own, coalesce(list_sum([1 << (ascii(filter_order[i]) - 65) FOR i IN range(1, step)]), 0)::INT AS before FROM o, unnest(range(1, 6)) AS u(step)),
        r AS (SELECT part, filter_order, CAST(step AS INT) AS step, own,
                     CAST(coalesce(sum(n) FILTER (mask & (own | before) = 0), 0) AS BIGINT) AS kept,
                     CAST(coalesce(sum(n) FILTER (mask & own > 0 AND mask & before = 0), 0) AS BIGINT) AS removed,
                     CAST(coalesce(sum(n) FILTER (mask & own > 0 AND mask & before > 0), 0) AS BIGINT) AS redundant,
                     CAST(coalesce(sum(n) FILTER (mask = own), 0) AS BIGINT) AS unique_fails,
                     CAST(coalesce(sum(good) FILTER (mask & own > 0 AND mask & before = 0), 0) AS BIGINT) AS good_lost,
                     CAST(coalesce(sum(toxic) FILTER (mask & own > 0 AND mask & before = 0), 0) AS BIGINT) AS toxic_lost
              FROM s, m GROUP BY ALL)
        SELECT * EXCLUDE (own), CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r""",
}
