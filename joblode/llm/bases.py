"""Base columns of the operators whose own verdicts SQL cannot express, with the SQL that they must equal.

Each query takes the rows of the operator's query and leaves out the columns of its method; the
operators' modules define the results for odd rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from joblode.llm.registry import QUERIES, case

# The patterns of the four base kinds.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

_DIGITS = "regexp_replace({x}, '[^0-9]', '', 'g')"
_LUHN = """list_sum(list_transform(range(len(d)), lambda i: CASE WHEN i % 2 = 0 THEN CAST(substr(reverse(d), i + 1, 1) AS INT)
  ELSE 2 * CAST(substr(reverse(d), i + 1, 1) AS INT) - CASE WHEN substr(reverse(d), i + 1, 1) > '4' THEN 9 ELSE 0 END END)) % 10 = 0"""


@case("op2_base_counts", f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
  n AS (SELECT doc_id, len(regexp_extract_all(text, '{EMAIL}')) AS n_email,
    len(list_filter(regexp_extract_all(text, '{IP}'), lambda x: len(list_filter(string_split(x, '.'),
      lambda p: coalesce(try_cast(p AS BIGINT), 256) > 255)) = 0)) AS n_ip,
    len(list_filter(list_transform(regexp_extract_all(text, '{PHONE}'), lambda x: {_DIGITS.format(x='x')}),
      lambda d: len(d) BETWEEN 10 AND 15)) AS n_phone FROM t),
  c AS (SELECT doc_id, {_DIGITS.format(x='x')} AS d FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{CARD}')) AS x FROM t)),
  cards AS (SELECT doc_id, count(*) AS n FROM c WHERE len(d) BETWEEN 14 AND 19 AND {_LUHN} GROUP BY doc_id)
  SELECT doc_id, n_email, n_ip, coalesce(cards.n, 0) AS n_card, n_phone FROM n LEFT JOIN cards USING (doc_id)""")
def op2_base(spark, sf_dir):
    return QUERIES["op2_personal_data"](spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


@case("op5_base_columns", r"""WITH t AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words
    FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
  grams AS (SELECT doc_id, i, list_slice(words, i, i + 4) AS gram FROM (
    SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM t)),
  again AS (SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
  hit AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + j AS word FROM again, range(5) r(j)) GROUP BY doc_id),
  base AS (SELECT t.doc_id, len(words) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda w: length(w))), 0) AS BIGINT)
      AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines,
    coalesce(hit.n, 0) AS n_repeat_words FROM t LEFT JOIN hit USING (doc_id))
  SELECT doc_id, n_words, word_chars, n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, n_repeat_words,
    n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base""")
def op5_base(spark, sf_dir):
    return QUERIES["op5_ratio_rules"](spark, sf_dir).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


@case("op6_shard_rows", """WITH n AS (SELECT count(*) AS n, sum(strlen(coalesce(text, '')) + 8) AS bytes FROM documents),
  s AS (SELECT CAST(unnest(range(24)) AS INTEGER) AS shard), r AS (SELECT shard,
    n // 24 + CASE WHEN shard < n % 24 THEN 1 ELSE 0 END AS rows, bytes FROM s, n)
  SELECT shard, rows, CAST(0 AS BIGINT) AS first_slot, rows - 1 AS last_slot, rows AS slots, CAST(bytes AS BIGINT) AS table_bytes
  FROM r WHERE rows > 0""")
def op6_rows(spark, sf_dir):
    """Rows of each shard, its slots, and the bytes of all shards."""
    shards = QUERIES["op6_hilbert_shards"](spark, sf_dir).groupBy("shard").agg(
        F.count(F.lit(1)).alias("rows"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"),
        F.count_distinct("slot").alias("slots"), F.sum("size").alias("bytes"))
    total = shards.agg(F.sum("bytes").alias("table_bytes"))  # of 24 rows
    return shards.drop("bytes").join(F.broadcast(total))


@case("op8_base_columns", r"""WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
  w AS (SELECT doc_id, unnest(words) AS a, unnest(range(len(words))) AS i FROM t),
  n AS (SELECT *, lead(a) OVER next AS b, lead(a, 2) OVER next AS c FROM w WINDOW next AS (PARTITION BY doc_id ORDER BY i)),
  places AS (SELECT doc_id, i, 'mit' AS label FROM n WHERE a = 'mit' AND b = 'license'
    UNION ALL SELECT doc_id, i, 'apache' FROM n WHERE a = 'apache' AND b = 'license'
    UNION ALL SELECT doc_id, i, 'gpl' FROM n WHERE a = 'general' AND b = 'public' AND c = 'license'),
  found AS (SELECT doc_id, count(*) AS n, min(i) AS first, max(i) AS last, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
    FROM places GROUP BY doc_id)
  SELECT doc_id, len(words) AS n_words, coalesce(n, 0) AS n_base, first AS first_word, last AS last_word,
    coalesce(labels, '') AS base_labels FROM t LEFT JOIN found USING (doc_id)""")
def op8_base(spark, sf_dir):
    return QUERIES["op8_license_scan"](spark, sf_dir).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
