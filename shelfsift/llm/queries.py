"""One query per operator over its whole table, with production parameters, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfsift.llm import block_search, centroids, chunk_reuse, filter_audit, hash_tree, legacy_archive, license_scan, packing, pivot_index, quality_rules, sanitize, simhash, token_archive
from shelfsift.llm.support import hex_lower

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.summary(license_scan.scan(table(spark, sf_dir, "documents")))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


OP1_SQL = f"""
WITH templates(k, license, body) AS (
  VALUES {", ".join(f"({k}, {_quoted(n)}, {_quoted(t)})" for k, (n, t) in enumerate(license_scan.TEMPLATES))}),
template_words AS (
  SELECT k, license, list_transform(regexp_extract_all(body, '[A-Za-z0-9]+(?:\\.[0-9]+)*'), lambda w: lower(w)) AS ws
  FROM templates),
template_grams AS (
  SELECT DISTINCT k, license, a, b FROM (
    SELECT k, license, unnest(ws[:-2]) AS a, unnest(ws[2:]) AS b FROM template_words)),
template_sizes AS (SELECT k, license, count(*) AS size FROM template_grams GROUP BY ALL),
docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
all_lines AS (SELECT r, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS n FROM docs),
own AS (
  SELECT r, n, list_transform(regexp_extract_all(line, '[A-Za-z0-9]+(?:\\.[0-9]+)*'), lambda w: lower(w)) AS ws
  FROM all_lines WHERE NOT regexp_matches(line, '^[\\x20\\x09-\\x0D]*(?i:copyright|\\(c\\)|©)')),
grouped AS (SELECT *, sum(CAST(len(ws) = 0 AS INT)) OVER (PARTITION BY r ORDER BY n) AS p FROM own),
worded AS (SELECT * FROM grouped WHERE len(ws) > 0),
units AS (
  SELECT r, n AS first_line, ws FROM worded
  UNION ALL
  SELECT r, min(n), flatten(list(ws ORDER BY n)) FROM worded GROUP BY r, p HAVING count(*) > 1
  UNION ALL
  SELECT r, min(n), flatten(list(ws ORDER BY n)) FROM worded GROUP BY r HAVING count(DISTINCT p) > 1),
numbered AS (SELECT row_number() OVER () AS u, * FROM units),
grams AS (
  SELECT DISTINCT u, a, b FROM (SELECT u, unnest(ws[:-2]) AS a, unnest(ws[2:]) AS b FROM numbered WHERE len(ws) > 1)),
sizes AS (SELECT u, count(*) AS size FROM grams GROUP BY u),
shared AS (SELECT u, k, license, count(*) AS n FROM grams JOIN template_grams USING (a, b) GROUP BY ALL),
scored AS (
  SELECT u, s.license, 2.0 * n / (sizes.size + t.size) AS dice
  FROM shared s JOIN sizes USING (u) JOIN template_sizes t USING (k)),
hits AS (
  SELECT u, license, dice FROM scored WHERE dice >= {license_scan.LEAST_DICE}
  QUALIFY row_number() OVER (PARTITION BY u ORDER BY dice DESC, license) = 1),
placed AS (SELECT r, license, dice, first_line FROM hits JOIN numbered USING (u)),
summed AS (
  SELECT r, count(*) AS n_hits, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses,
    first(license ORDER BY dice DESC, license, first_line) AS best_license,
    first(dice ORDER BY dice DESC, license, first_line) AS best_dice,
    first(first_line ORDER BY dice DESC, license, first_line) AS best_line
  FROM placed GROUP BY r)
SELECT doc_id, coalesce(n_hits, 0) AS n_hits, coalesce(licenses, '') AS licenses, best_license,
  CAST(round(best_dice, 6) AS DOUBLE) AS best_dice, best_line
FROM docs LEFT JOIN summed USING (r)
"""


def op2_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=2, temperature=0.7, digests=True)


def op3_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_tree.assign(table(spark, sf_dir, "documents"))


def op4_legacy_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    arcs = legacy_archive.write_arc(table(spark, sf_dir, "pages"))
    records = legacy_archive.read_warc(spark, legacy_archive.convert(spark, arcs))
    return legacy_archive.resolve(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
WITH sized AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
first AS (SELECT payload_digest, min(page_id) AS least FROM sized GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes < 100 OR page_id = least THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN payload_bytes < 100 OR page_id = least THEN NULL ELSE least END AS refers_to
FROM sized JOIN first USING (payload_digest)
"""


def op5_chunk_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = chunk_reuse.encode(table(spark, sf_dir, "documents"), tokenizer_path())
    return chunk_reuse.decode(encoded, tokenizer_path()).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


def op6_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.ledger(table(spark, sf_dir, "documents"))
    base = ~quality_rules.kept("base-1")
    return rows.select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (~base & quality_rules.kept("corpus-1")).alias("kept"), "fail_bits",
    )


OP6_SQL = """
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
cut AS (
  SELECT r, doc_id, t,
    list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM docs),
each AS (SELECT r, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM cut),
windows AS (
  SELECT r, i, w AS a, lead(w) OVER spot AS b, lead(w, 2) OVER spot AS c
  FROM each WINDOW spot AS (PARTITION BY r ORDER BY i)),
twice AS (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM windows WHERE c IS NOT NULL),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS s(k) WHERE n > 1 GROUP BY r),
measured AS (
  SELECT doc_id, len(words) AS n_words,
    length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(covered.n, 0) AS n_repeat_words,
    len(lines) AS n_lines,
    length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_capitals,
    len(list_filter(lines, lambda x: regexp_matches(x, '^[\\x20\\x09-\\x0D]*[-*•]'))) AS n_bullet_lines,
    len(list_filter(lines, lambda x: regexp_matches(x, '(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$'))) AS n_ellipsis_lines
  FROM cut LEFT JOIN covered USING (r)),
ruled AS (
  SELECT *,
    CAST(n_words < 50 AS BIGINT) + 2 * CAST(100 * n_repeat_words > 50 * n_words AS BIGINT)
    + 4 * CAST(n_words > 100000 AS BIGINT) + 8 * CAST(100 * n_words > 50 * word_chars AS BIGINT)
    + 16 * CAST(word_chars > 15 * n_words AS BIGINT) + 32 * CAST(100 * n_symbols > 25 * n_words AS BIGINT)
    + 64 * CAST(n_lines > 1 AND 100 * n_dup_lines > 50 * n_lines AS BIGINT)
    + 128 * CAST(100 * n_capitals > 50 * word_chars AS BIGINT)
    + 256 * CAST(n_lines > 1 AND 100 * n_bullet_lines > 90 * n_lines AS BIGINT)
    + 512 * CAST(n_lines > 1 AND 100 * n_ellipsis_lines > 30 * n_lines AS BIGINT) AS fail_bits
  FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  fail_bits & 3 <> 0 AS base_failed, fail_bits & ~4 = 0 AS kept, fail_bits
FROM ruled
"""


def op7_pivot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_index.near_duplicates(table(spark, sf_dir, "embeddings"), least_cosine=0.95)


def op8_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sanitize.find(table(spark, sf_dir, "documents"))
    return found.select(
        "row.doc_id",
        *(F.size(kind).cast("bigint").alias(f"n_{kind}") for kind in sanitize.KINDS),
        F.sha2(sanitize.span_list(*sanitize.KINDS), 256).alias("base_sha256"),
        sanitize.span_list(*sanitize.KINDS, "term", "far_term").alias("spans"),
    )


def op9_gray_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, limit=2)
    return found.select("doc_id", hex_lower(F.col("fp"), 16).alias("fingerprint"), "component_id")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_archive.write_token_files(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=1)
    rows = token_archive.read_token_files(spark, folder)
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP11_SQL = """
WITH docs AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
cut AS (
  SELECT *, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e
  FROM docs),
flagged AS (
  SELECT doc_id, part, len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b,
    100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t) AS c,
    regexp_matches(t, '[#$%&*|]') AS d, e
  FROM cut),
marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
known AS (
  SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS bits,
    count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
  FROM flagged LEFT JOIN marks USING (doc_id) GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (
  SELECT [v.bit, w.bit, x.bit, y.bit, z.bit] AS bits, v.letter || w.letter || x.letter || y.letter || z.letter AS filter_order
  FROM letters v, letters w, letters x, letters y, letters z
  WHERE v.bit + w.bit + x.bit + y.bit + z.bit = 31 AND v.bit | w.bit | x.bit | y.bit | z.bit = 31),
steps AS (
  SELECT filter_order, step, bits[step] AS own, coalesce(list_sum(bits[:step - 1]), 0)::INT AS before
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
counted AS (
  SELECT part, filter_order, step, own,
    sum(CASE WHEN bits & (own | before) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN bits & own <> 0 AND bits & before = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN bits & own <> 0 AND bits & before <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN bits = own THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN bits & own <> 0 AND bits & before = 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN bits & own <> 0 AND bits & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM known, steps GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM counted
"""

def op12_equal_average_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"), clusters=8, rounds=10, length=64)


def _op12_sql(rounds: int = 10) -> str:
    """Each round in full: all distances (exact whole numbers in doubles), then the floors of the means."""
    steps = ["""
WITH vecs AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS INT) AS k, v AS c
  FROM vecs QUALIFY k < 8)"""]
    for n in range(rounds + 1):
        steps.append(f"""
a{n} AS MATERIALIZED (
  SELECT r, vec_id, v, k, CAST(d AS BIGINT) AS d
  FROM (SELECT *, list_dot_product(v, v) - 2 * list_dot_product(v, c) + list_dot_product(c, c) AS d FROM vecs, c{n})
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, k) = 1)""")
        if n < rounds:
            steps.append(f"""
c{n + 1} AS MATERIALIZED (
  SELECT k, coalesce(m, c) AS c FROM c{n} LEFT JOIN (
    SELECT k, list(floor(s / n) ORDER BY i) AS m FROM (
      SELECT k, i, sum(x) AS s, count(*) AS n
      FROM (SELECT k, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{n}) GROUP BY k, i)
    GROUP BY k) USING (k))""")
    return ",".join(steps) + f"""
SELECT vec_id, k AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(list_transform(c, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (k)
"""


OP12_SQL = _op12_sql()


def op13_block_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_search.top_k(table(spark, sf_dir, "embeddings"), k=5, every=50, scale=256)


OP13_SQL = """
WITH vecs AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score, q.r
  FROM vecs q JOIN vecs c ON q.r <> c.r WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER spot AS INT) AS rank, vec_id, score
FROM scored WINDOW spot AS (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) QUALIFY rank <= 5
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_mixture_packing": op2_mixture_packing,
    "op3_hash_tree": op3_hash_tree,
    "op4_legacy_archive": op4_legacy_archive,
    "op5_chunk_reuse": op5_chunk_reuse,
    "op6_rule_ledger": op6_rule_ledger,
    "op7_pivot_index": op7_pivot_index,
    "op8_sanitisation": op8_sanitisation,
    "op9_gray_simhash": op9_gray_simhash,
    "op10_token_files": op10_token_files,
    "op11_filter_audit": op11_filter_audit,
    "op12_equal_average_clusters": op12_equal_average_clusters,
    "op13_block_search": op13_block_search,
}

ORACLE: dict[str, str] = {
    "op1_license_scan": OP1_SQL,
    "op4_legacy_archive": OP4_SQL,
    "op6_rule_ledger": OP6_SQL,
    "op11_filter_audit": OP11_SQL,
    "op12_equal_average_clusters": OP12_SQL,
    "op13_block_search": OP13_SQL,
}
