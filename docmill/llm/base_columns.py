"""The columns of operators 3, 4, 8 and 10 that SQL can express, as queries over the operators' own results, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import mixing, pii, quality_rules, secrets_crf
from .shared import documents


def base_of_op3(spark, sf_dir: str) -> DataFrame:
    return quality_rules.op3_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def base_of_op4(spark, sf_dir: str) -> DataFrame:
    """Sizes and targets of every document, and whether the mix keeps to the limit of a document and to whole copies."""
    found = mixing.op4_mixing(spark, sf_dir)
    return found.select("doc_id", "size", "source_size", F.round("target", 3).alias("target"), ((F.col("taken") <= 2 * F.col("size")) & (F.col("taken") == F.col("copies") * F.col("size"))).alias("fits"))


def base_of_op8(spark, sf_dir: str) -> DataFrame:
    return secrets_crf.op8_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def base_of_op10(spark, sf_dir: str) -> DataFrame:
    """Of the operator's own matches, in the columns that it gives; the terms that it mines from the whole table add nothing to these."""
    return pii.with_base(documents(spark, sf_dir), "doc_id", "text").select("doc_id", *pii.base_columns()[0])


def _matches(name: str, pattern: str) -> str:
    """SQL of a table (doc_id, k, start, stop, value): all matches of the pattern, in code points."""
    pattern = pattern.replace("'", "''")
    return f"""
{name}_all AS (
  SELECT doc_id, regexp_extract_all(text, '{pattern}') AS found, string_split_regex(text, '{pattern}') AS gaps FROM t
), {name}_each AS (
  SELECT doc_id, unnest(range(1, len(found) + 1)) AS k, found, gaps FROM {name}_all
), {name} AS (
  SELECT doc_id, found[k] AS value,
         sum(length(gaps[k]) + length(found[k])) OVER (PARTITION BY doc_id ORDER BY k) AS stop
  FROM {name}_each
)"""


_KEYS = "|".join("".join(f"[{c}{c.upper()}]" for c in w) for w in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY]"
_ASSIGN = rf"""({_KEYS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""

OP3_BASE_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
win AS (
  SELECT doc_id, i, array_to_string(ws[i : i + 7], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)
), twice AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS times FROM win
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice WHERE times > 1) GROUP BY doc_id
), m AS (
  SELECT w.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM w LEFT JOIN covered USING (doc_id)
)
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m
"""

OP4_BASE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), s AS (
  SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM d GROUP BY source
), w AS (
  SELECT *, CASE k % 3 WHEN 1 THEN 5.0 WHEN 2 THEN 2.0 ELSE 1.0 END::DOUBLE AS w, 1.5 * sum(source_size) OVER () AS budget FROM s
), fill AS (
  -- Sources over twice their size are fixed there, and what they leave is shared anew among the rest, until none is over.
  SELECT 0 AS step, k, w, source_size, budget, false AS fixed, 0.0::DOUBLE AS target FROM w
  UNION ALL
  SELECT step + 1, k, w, source_size, budget, fixed OR share >= 2 * source_size, CASE WHEN fixed OR share >= 2 * source_size THEN 2.0 * source_size ELSE share END
  FROM (SELECT *, w * (budget - coalesce(sum(2.0 * source_size) FILTER (fixed) OVER (), 0)) / nullif(sum(w) FILTER (NOT fixed) OVER (), 0) AS share FROM fill) WHERE step < (SELECT count(*) + 1 FROM w)
), done AS (SELECT k, target FROM fill WHERE step = (SELECT max(step) FROM fill))
SELECT d.doc_id, d.size, w.source_size::BIGINT AS source_size, round(done.target, 3) AS target, true AS fits
FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source JOIN done USING (k)
"""

OP8_BASE_SQL = (
    "WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),"
    + ",".join([_matches("assign", _ASSIGN), _matches("access", "AKIA[A-Z0-9]+"), _matches("hex", "[0-9a-f]+")])
    + r""", kept AS (
  SELECT doc_id, 0 AS kind, 'assign' AS name, stop - length(value) AS start, stop FROM assign
  WHERE length(regexp_extract(value, '[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1)) >= 6
  UNION ALL SELECT doc_id, 1, 'access', stop - length(value), stop FROM access WHERE length(value) >= 20
  UNION ALL SELECT doc_id, 2, 'hex', stop - length(value), stop FROM hex WHERE length(value) >= 24
), per AS (
  SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
         string_agg(name || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, kind) AS spans
  FROM kept GROUP BY doc_id
)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256
FROM t LEFT JOIN per USING (doc_id)
"""
)

OP10_BASE_SQL = (
    "WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),"
    + ",".join([
        _matches("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
        _matches("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"),
        _matches("card", r"[0-9](?:[\x20-]?[0-9])+"),
        _matches("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ])
    + r""", digits AS (
  SELECT doc_id, 2 AS kind, stop, value, regexp_replace(value, '[^0-9]', '', 'g') AS d FROM card
  UNION ALL SELECT doc_id, 3, stop, value, regexp_replace(value, '[^0-9]', '', 'g') FROM phone
), kept AS (
  SELECT doc_id, 0 AS kind, 'email' AS name, stop - length(value) AS start, stop FROM email
  UNION ALL SELECT doc_id, 1, 'ip', stop - length(value), stop FROM ip
  WHERE len(list_filter(string_split(value, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(TRY_CAST(p AS INTEGER), 256) > 255)) = 0
  UNION ALL SELECT doc_id, 2, 'card', stop - length(value), stop FROM digits
  WHERE kind = 2 AND length(d) BETWEEN 13 AND 19
    AND list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN i % 2 = 1 THEN d[length(d) - i + 1]::INT
                 ELSE d[length(d) - i + 1]::INT * 2 - CASE WHEN d[length(d) - i + 1]::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0
  UNION ALL SELECT doc_id, 3, 'phone', stop - length(value), stop FROM digits WHERE kind = 3 AND length(d) BETWEEN 9 AND 15
), per AS (
  SELECT doc_id, count(*) FILTER (kind = 0) AS n_email, count(*) FILTER (kind = 1) AS n_ip, count(*) FILTER (kind = 2) AS n_card, count(*) FILTER (kind = 3) AS n_phone,
         string_agg(name || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY kind, start) AS spans
  FROM kept GROUP BY doc_id
)
SELECT t.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(spans, '')) AS base_sha256
FROM t LEFT JOIN per USING (doc_id)
"""
)

QUERIES = {"base_of_op3": base_of_op3, "base_of_op4": base_of_op4, "base_of_op8": base_of_op8, "base_of_op10": base_of_op10}
SQL = {"base_of_op3": OP3_BASE_SQL, "base_of_op4": OP4_BASE_SQL, "base_of_op8": OP8_BASE_SQL, "base_of_op10": OP10_BASE_SQL}
