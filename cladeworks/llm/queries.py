"""Queries over the driver's tables, one per operator, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import read_table
from .bpe import bpe_digests
from .decontamination import find_contamination
from .language_id import identify
from .near_duplicates import near_duplicates
from .pii import find_pii
from .quality_classifier import classify
from .quality_rules import quality_rules
from .sharding import SHARD_BYTES, shard
from .substring_dedup import substring_dedup
from .token_counts import token_counts


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op3_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(read_table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(read_table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read_table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(read_table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read_table(spark, sf_dir, "documents"))


def sharding_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 5 with a limit that makes buckets of small tables split as well."""
    return shard(read_table(spark, sf_dir, "documents"), limit=SPLIT_BYTES)


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of operator 10 that SQL can express."""
    return quality_rules(read_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of operator 8 that SQL can express."""
    return find_pii(read_table(spark, sf_dir, "documents")).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


#: Limit of ``sharding_splits``.
SPLIT_BYTES = 64 << 10

QUERIES = {
    "sharding_splits": sharding_splits,
    "quality_base": quality_base,
    "pii_base": pii_base,
    "op1_decontamination": op1_decontamination,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_bpe_roundtrip": op3_bpe_roundtrip,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_sharding": op5_sharding,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_language_id": op7_language_id,
    "op8_pii": op8_pii,
    "op9_token_counts": op9_token_counts,
    "op10_quality_rules": op10_quality_rules,
}

def sharding_sql(limit: int = SHARD_BYTES) -> str:
    return f"""
WITH base AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS h
  FROM documents),
at_depth AS (SELECT b.*, d::INTEGER AS depth, h >> (60 - d)::INTEGER AS q FROM base b, range(0, 61) t(d)),
sums AS (SELECT depth, q, sum(n_bytes)::BIGINT AS shard_bytes, count(*)::BIGINT AS shard_rows FROM at_depth GROUP BY ALL),
leaf AS (
  SELECT a.doc_id, a.n_bytes, a.depth, a.q, s.shard_bytes, s.shard_rows
  FROM at_depth a JOIN sums s USING (depth, q)
  WHERE s.shard_bytes <= {limit} OR s.shard_rows = 1 OR depth = 60
  QUALIFY row_number() OVER (PARTITION BY a.doc_id, a.h ORDER BY depth) = 1)
SELECT doc_id, n_bytes, CASE WHEN depth = 0 THEN '' ELSE substr(lpad(bin(q), 60, '0'), 61 - depth) END AS shard,
       depth, shard_bytes, shard_rows, n_bytes > {limit} AS oversize
FROM leaf"""


SUBSTRING_SQL = r"""
WITH pieces AS (SELECT doc_id, text, regexp_extract_all(text, '[^\n]*?[.!?][ \t]+|[^\n]+\n?|\n') AS us FROM documents),
units AS (
  SELECT doc_id, unnest(us) AS u, generate_subscripts(us, 1) - 1 AS place FROM pieces),
sized AS (
  SELECT doc_id, place, u, trim(regexp_replace(lower(u), '\s+', ' ', 'g')) AS unit,
         sum(length(u)) OVER w AS stop, sum((u LIKE '%' || chr(10))::INT) OVER w - (u LIKE '%' || chr(10))::INT AS line
  FROM units WINDOW w AS (PARTITION BY doc_id ORDER BY place)),
lines AS (
  SELECT doc_id, line, row_number() OVER (PARTITION BY string_agg(unit, ' ' ORDER BY place) ORDER BY doc_id, line) > 1 AS line_again
  FROM sized WHERE unit <> '' GROUP BY doc_id, line),
worded AS (
  SELECT *, stop - length(u) AS start, len(string_split(unit, ' ')) AS words,
         row_number() OVER (PARTITION BY unit ORDER BY doc_id, place) > 1 AS again, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS k
  FROM sized JOIN lines USING (doc_id, line) WHERE unit <> ''),
islands AS (SELECT *, k - row_number() OVER (PARTITION BY doc_id, again ORDER BY k) AS island FROM worded),
judged AS (SELECT *, line_again OR (again AND sum(words) OVER (PARTITION BY doc_id, again, island) >= 8) AS gone FROM islands),
stretches AS (SELECT *, k - row_number() OVER (PARTITION BY doc_id ORDER BY k) AS stretch FROM judged WHERE gone),
runs AS (SELECT doc_id, min(start)::BIGINT AS a, max(stop)::BIGINT AS b, sum(words) AS words FROM stretches GROUP BY doc_id, stretch),
lists AS (
  SELECT doc_id, count(*)::INTEGER AS n_removed, string_agg(a || ':' || b, ',' ORDER BY a) AS removed, sum(b - a)::BIGINT AS n_chars_removed,
         (count(*) FILTER (words >= 50))::INTEGER AS n_passages
  FROM runs GROUP BY doc_id),
kept AS (
  SELECT s.doc_id, string_agg(u, '' ORDER BY place) AS rest FROM sized s
  WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.doc_id = s.doc_id AND r.a <= s.stop - length(u) AND s.stop <= r.b) GROUP BY s.doc_id)
SELECT d.doc_id, coalesce(len(p.us), 0)::INTEGER AS n_units, coalesce(l.n_removed, 0)::INTEGER AS n_removed, coalesce(l.removed, '') AS removed,
       coalesce(l.n_chars_removed, 0)::BIGINT AS n_chars_removed, coalesce(l.n_passages, 0)::INTEGER AS n_passages,
       CASE WHEN d.text IS NOT NULL THEN coalesce(k.rest, '') END AS text
FROM documents d LEFT JOIN pieces p USING (doc_id) LEFT JOIN lists l USING (doc_id) LEFT JOIN kept k USING (doc_id)"""

_WORDS = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda w: w <> '')"

DECONTAMINATION_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents), i AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
dw AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM d),
iw AS (SELECT item_id, len(ws) AS n, unnest(ws) AS w, generate_subscripts(ws, 1) AS q FROM i WHERE len(ws) >= 1),
same AS (SELECT doc_id, item_id, n, p - q AS line, p FROM dw JOIN iw USING (w)),
reach AS (
  SELECT doc_id, item_id, n, p, lead(p, 10) OVER l AS p11, lead(p, 11) OVER l AS p12, lead(p, 12) OVER l AS p13,
         count(*) OVER (PARTITION BY doc_id, item_id, line) AS whole
  FROM same WINDOW l AS (PARTITION BY doc_id, item_id, line ORDER BY p)),
good AS (
  SELECT doc_id, item_id, CASE WHEN n < 13 THEN CASE WHEN whole >= n - n * 2 // 13 THEN whole END
    WHEN p13 - p = 12 THEN 13 WHEN p12 - p <= 12 THEN 12 WHEN p11 - p <= 12 THEN 11 END AS agreed FROM reach)
SELECT doc_id, item_id, max(agreed)::INTEGER AS agreed FROM good WHERE agreed IS NOT NULL GROUP BY ALL"""

QUALITY_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM t),
places AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS p, ws FROM w WHERE len(ws) >= 3),
windows AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, ws[p], ws[p + 1], ws[p + 2]) AS n FROM places),
covered AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM windows WHERE n > 1) GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
       (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(ws) < 50 OR 100 * coalesce(c.n, 0) > 50 * len(ws) AS base_failed
FROM w LEFT JOIN covered c USING (doc_id)"""

_LUHN = "list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN (length(d) - i) % 2 = 0 THEN d[i]::INT ELSE 2 * d[i]::INT - 9 * (d[i]::INT > 4)::INT END)) % 10 = 0"

PII_SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
cards AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, regexp_replace(unnest(regexp_extract_all(text, '[0-9]([\x20-]?[0-9])+')), '[^0-9]', '', 'g') AS d FROM t) WHERE length(d) BETWEEN 14 AND 19 AND {_LUHN} GROUP BY 1)
SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+'))::BIGINT AS n_email,
       len(list_filter(regexp_extract_all(text, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), lambda m: list_max(list_transform(string_split(m, '.'), lambda x: x::HUGEINT)) <= 255))::BIGINT AS n_ip,
       coalesce(c.n, 0)::BIGINT AS n_card,
       len(list_filter(regexp_extract_all(text, '\+[0-9][\x20().0-9-]+[0-9]'), lambda m: length(regexp_replace(m, '[^0-9]', '', 'g')) BETWEEN 10 AND 15))::BIGINT AS n_phone
FROM t LEFT JOIN cards c USING (doc_id)"""

#: Operators that SQL can express; the others are tested against brute force.
SQL: dict[str, str] = {"sharding_splits": sharding_sql(SPLIT_BYTES), "quality_base": QUALITY_SQL, "pii_base": PII_SQL, "op1_decontamination": DECONTAMINATION_SQL, "op5_sharding": sharding_sql(), "op6_substring_dedup": SUBSTRING_SQL}
