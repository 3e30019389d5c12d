"""The thin queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import chat_formatting, html_extraction, line_dedup, mixing, near_dedup, packing, repetition, secret_scan, toxicity
from tesserae.llm.common import documents
from tesserae.llm.exact_dedup import exact_dedup


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark, f"{sf_dir}/documents.parquet").select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256")
    )


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf_dir))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         (('0x' || substr(md5('mix-1/' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0 AS u
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, list_value(5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE)[(row_number() OVER (ORDER BY source COLLATE C NULLS LAST) - 1) % 3 + 1] AS weight,
         source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS total
  FROM s
), l AS (
  SELECT *, (total - coalesce(sum(cap) OVER b, 0.0::DOUBLE)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0.0::DOUBLE)) AS level,
         row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS k
  FROM w WINDOW b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, least(cap, coalesce(weight * (SELECT min_by(level, k) FROM l WHERE weight * level < cap), cap)) AS target FROM l
), p AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate FROM t
), q AS (
  SELECT *, floor(rate) AS whole, rate - floor(rate) AS p, target - floor(rate) * source_size AS lacks FROM p
), r AS (
  SELECT d.*, q.source_size, q.target, q.whole, q.lacks,
         CASE WHEN q.p > 0 THEN (u / (1 - u)) / (q.p / (1 - q.p)) END AS rank
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
), c AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rank, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS below FROM r
)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN rank IS NOT NULL AND 2 * below + size <= 2 * lacks THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
"""


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(documents(spark, sf_dir, "pages"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_dedup(documents(spark, sf_dir), words=2)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, CASE len(w) WHEN 0 THEN [] WHEN 1 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) END AS s FROM w
), t AS (SELECT doc_id, len(s) AS n, unnest(s) AS token FROM s),
f AS (SELECT token, count(*) AS f FROM t GROUP BY token),
r AS (SELECT t.*, row_number() OVER (PARTITION BY doc_id ORDER BY f, token) AS k FROM t JOIN f USING (token)),
x AS (SELECT doc_id, n, token FROM r WHERE k <= n - (80 * n + 99) // 100 + 1),
p AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b USING (token) WHERE a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
c AS (SELECT p.a, p.b, len(u.s) AS na, len(v.s) AS nb, len(list_intersect(u.s, v.s)) AS met FROM p JOIN s u ON u.doc_id = p.a JOIN s v ON v.doc_id = p.b),
e AS (SELECT a, b FROM c WHERE 100 * met >= 80 * (na + nb - met)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach(i, j) AS (SELECT a, b FROM l UNION SELECT i, b FROM reach JOIN l ON a = j),
m AS (SELECT i, least(i, min(j)) AS component FROM reach GROUP BY i)
SELECT doc_id, len(s)::BIGINT AS n_shingles, coalesce(component, doc_id) AS component_id, coalesce(component, doc_id) = doc_id AS kept FROM s LEFT JOIN m ON i = doc_id
"""


def op4_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repetition.quality_rules(documents(spark, sf_dir))
    return found.withColumn("long_repeat", F.col("longest_repeat") > repetition.MOST_LONGEST).drop("longest_repeat")


OP4_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM w),
g AS (
  SELECT doc_id, k, CASE WHEN k + 2 <= len(w) THEN array_to_string(w[k:k + 2], ' ') END AS g3, CASE WHEN k + 9 <= len(w) THEN array_to_string(w[k:k + 9], ' ') END AS g10,
         CASE WHEN k + 50 <= len(w) THEN md5(array_to_string(w[k:k + 50], ' ')) END AS g51 FROM p
), c AS (
  SELECT doc_id, k, g3 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g3) > 1 AS r3, g10 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g10) > 1 AS r10,
         g51 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g51) > 1 AS r51 FROM g
), m AS (
  SELECT doc_id, max(r3::INT) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS c3,
         max(r10::INT) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS c10, r51 FROM c
), s AS (SELECT doc_id, sum(c3)::BIGINT AS n_repeat_words, sum(c10)::BIGINT AS n_covered, bool_or(r51) AS long_repeat FROM m GROUP BY doc_id),
l AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), f AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_covered, 0) AS n_covered, coalesce(long_repeat, false) AS long_repeat
  FROM w LEFT JOIN l USING (doc_id) LEFT JOIN s USING (doc_id)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 5 * n_covered <= n_words AND NOT long_repeat AS kept FROM f
"""


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.learn(docs, documents(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.line_dedup(documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), "line_no", F.col("first_id").alias("class_doc_id"), F.col("first_line").alias("class_line_no"), "n_links", "removed")


OP6_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(range(len(a))) AS line_no, unnest(a) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)
), w AS (SELECT doc_id, line_no::INT AS line_no, list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM l),
k AS (SELECT doc_id, line_no, array_to_string(w, ' ') AS c, w FROM w WHERE len(w) > 0),
g AS (SELECT c, min(struct_pack(d := doc_id, l := line_no)) AS first, count(*) AS copies, any_value(w) AS w FROM k GROUP BY c),
s AS (SELECT c, row_number() OVER (ORDER BY c) AS i, first, copies, CASE WHEN len(w) < 5 THEN [c] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda j: array_to_string(w[j:j + 4], ' '))) END AS s FROM g),
t AS (SELECT i, len(s) AS n, unnest(s) AS token FROM s),
f AS (SELECT token, count(*) AS f FROM t GROUP BY token),
r AS (SELECT t.*, row_number() OVER (PARTITION BY i ORDER BY f, token) AS k FROM t JOIN f USING (token)),
x AS (SELECT i, n, token FROM r WHERE k <= n - (80 * n + 99) // 100 + 1),
p AS (SELECT DISTINCT a.i AS a, b.i AS b FROM x a JOIN x b USING (token) WHERE a.i < b.i AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
v AS (SELECT p.a, p.b, len(y.s) AS na, len(z.s) AS nb, len(list_intersect(y.s, z.s)) AS met FROM p JOIN s y ON y.i = p.a JOIN s z ON z.i = p.b),
e AS (SELECT a, b FROM v WHERE 100 * met >= 80 * (na + nb - met)),
o AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
m AS (SELECT o.a AS i, min(s.first) AS earliest, sum(s.copies)::BIGINT AS more FROM o JOIN s ON s.i = o.b GROUP BY o.a)
SELECT k.doc_id, k.line_no, s.first.d AS class_doc_id, s.first.l AS class_line_no, (s.copies - 1 + coalesce(m.more, 0))::BIGINT AS n_links,
       struct_pack(d := k.doc_id, l := k.line_no) > s.first OR coalesce(m.earliest < struct_pack(d := k.doc_id, l := k.line_no), false) AS removed
FROM k JOIN s USING (c) LEFT JOIN m ON m.i = s.i
"""


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = documents(spark, sf_dir, "conversations")
    # Nothing is learned from a fifth of the conversations, by which the recovered roles can be judged.
    model = chat_formatting.learn(turns.where(F.crc32(F.col("conv_id").cast("string").cast("binary")) % 5 != 0))
    found = chat_formatting.format_chats(turns, model)
    return found.select(F.col("id").alias("conv_id"), F.col("order").alias("turn"), "piece", "role", "opens", "rendered")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(documents(spark, sf_dir), keys=("doc_id",))
    base = F.filter("spans", lambda s: s["kind"] < len(secret_scan.BASE))
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = (F.size(F.filter(kinds, lambda kind: kind == F.lit(k))).cast("long").alias(f"n_{r.kind}") for k, r in enumerate(secret_scan.BASE))
    return found.select("doc_id", *counts, F.sha2(secret_scan.joined(base), 256).alias("base_sha256"), secret_scan.joined(F.col("spans")).alias("spans"))


def _op10_sql() -> str:
    def rule(number: int, r: secret_scan.Rule) -> str:
        pattern = "'" + r.pattern.replace("'", "''") + "'"
        return f"""
  SELECT * FROM (
    SELECT doc_id, {number} AS k, '{r.kind}' AS kind, unnest(range(1, len(found) + 1)) AS i, gaps, found, value
    FROM (SELECT doc_id, string_split_regex(t, {pattern}) AS gaps, regexp_extract_all(t, {pattern}) AS found,
                 regexp_extract_all(t, {pattern}, {r.group}) AS value FROM d)
  ) WHERE length(value[i]) >= {r.least}"""

    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(rule(k, r) for k, r in enumerate(secret_scan.RULES))}),
p AS (
  SELECT doc_id, k, kind, length(found[i]) AS long,
         list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS start
  FROM m
), s AS (
  SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
         string_agg(kind || ':' || start::BIGINT || ':' || (start + long)::BIGINT, ',' ORDER BY start, k) FILTER (k < 3) AS base,
         string_agg(kind || ':' || start::BIGINT || ':' || (start + long)::BIGINT, ',' ORDER BY start, k) AS spans
  FROM p GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN s USING (doc_id)
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_mixing": op2_mixing,
    "op3_html_extraction": op3_html_extraction,
    "op4_repetition": op4_repetition,
    "op5_near_dedup": op5_near_dedup,
    "op6_line_dedup": op6_line_dedup,
    "op7_packing": op7_packing,
    "op8_toxicity": op8_toxicity,
    "op9_chat_formatting": op9_chat_formatting,
    "op10_secret_scan": op10_secret_scan,
}

ORACLES: dict[str, str] = {
    "op1_exact_dedup": OP1_SQL,
    "op2_mixing": OP2_SQL,
    "op4_repetition": OP4_SQL,
    "op5_near_dedup": OP5_SQL,
    "op6_line_dedup": OP6_SQL,
    "op10_secret_scan": _op10_sql(),
}
