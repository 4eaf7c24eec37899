"""The operators over the whole tables, as registered queries; SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sitepulse.llm import attribution, decontam, idstore, middle, notices, packing, quality, repair, sharding, simhash, sketch, suffix, toxicity
from sitepulse.llm.common import documents, table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """The same place on all machines, as the vocabulary is installed with Python."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir), 24)


def op2_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir)).drop("h")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digest(documents(spark, sf_dir), 400)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(documents(spark, sf_dir)).drop("rejected_by")  # which of several rules was first depends on their measured cost


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.count_tokens(documents(spark, sf_dir), tokenizer_path())


def op7_notice_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notices.scan(documents(spark, sf_dir))


def op8_id_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = idstore.new_store(spark, "ids")
    idstore.write_ids(documents(spark, sf_dir), path, tokenizer_path(), end_id=0)
    return idstore.read_ids(spark, path)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_path(), 1024, end_id=2)


def op11_paragraph_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.edited_versions(documents(spark, sf_dir))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(table(spark, sf_dir, "conversations"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return middle.digest(middle.arrange(documents(spark, sf_dir)))


QUERIES = {
    f.__name__: f
    for f in (
        op1_feistel_sharding,
        op2_simhash_pivots,
        op3_suffix_dedup,
        op4_toxicity,
        op5_quality_rules,
        op6_token_counts,
        op7_notice_scan,
        op8_id_store,
        op9_decontamination,
        op10_best_fit_packing,
        op11_paragraph_sketch,
        op12_conversation_repair,
        op13_fill_in_middle,
    )
}

#: A window is ten words of an item, or the whole of a shorter one; hit words are counted once.  Places of an item's
#: windows that follow each other are a longer match; of the longest ones the first counts, then the least item.
_OP9 = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (
  SELECT row_number() OVER () AS b, CAST(item_id AS VARCHAR) AS i, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
win AS (
  SELECT b, i, j, least(len(w), 10) AS n, array_to_string(w[j : j + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT b, i, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS j FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
places AS (
  SELECT doc_id, p, n, array_to_string(w[p : p + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, p, n, b, i, j FROM places JOIN win USING (n, s)),
per AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT doc_id, p, n FROM hits)) GROUP BY doc_id),
its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items
  FROM (SELECT DISTINCT doc_id, i FROM hits WHERE i IS NOT NULL) GROUP BY doc_id),
runs AS (
  SELECT doc_id, i, min(p) - 1 AS start, count(*) - 1 + max(n) AS words
  FROM (SELECT *, p - row_number() OVER (PARTITION BY doc_id, b, p - j ORDER BY p) AS g FROM hits) GROUP BY doc_id, b, i, p - j, g),
longest AS (
  SELECT doc_id, words, start, i FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY words DESC, start, i NULLS LAST) = 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
  CAST(coalesce(words, 0) AS BIGINT) AS longest_words, CAST(start AS BIGINT) AS longest_start, longest.i AS longest_item
FROM d LEFT JOIN per USING (doc_id) LEFT JOIN its USING (doc_id) LEFT JOIN longest USING (doc_id)
"""

#: A document is kept if no rule rejects it, in whatever order they run.
_OP5 = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
win AS (
  SELECT r, p, count(*) OVER (PARTITION BY r, s) AS n
  FROM (SELECT r, p, array_to_string(w[p : p + 7], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS p FROM d WHERE len(w) > 8))),
rep AS (SELECT r, count(DISTINCT q) AS n_repeat_words FROM (SELECT r, unnest(range(p, p + 8)) AS q FROM win WHERE n > 1) GROUP BY r),
f AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(list_filter(lines, lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))
      - len(list_distinct(list_filter(lines, lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines,
    len(list_filter(list_zip(w[2:], w[:-2]), lambda x: x[1] = x[2])) AS n_adjacent
  FROM d LEFT JOIN rep USING (r)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR 100 * n_adjacent > 30 * n_words OR 2 * n_dup_lines > n_lines
    OR word_chars < 2 * n_words OR word_chars > 15 * n_words) AS kept
FROM b
"""

#: Units, cuts and forms as the contract says; the restored text is put together from the pieces, not parsed.
_OP13 = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
    sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
k AS (
  SELECT doc_id, t, u, CAST(len(u) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS x, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS y,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 90 THEN 'plain'
      WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
c AS (
  SELECT *, array_to_string(u[1 : least(x, y)], '') AS p, array_to_string(u[least(x, y) + 1 : greatest(x, y)], '') AS m, array_to_string(u[greatest(x, y) + 1 :], '') AS s FROM k)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256,
  sha256(p || m || s) AS restored_sha256
FROM c
"""
ORACLE_SQL: dict[str, str] = {"op5_quality_rules": _OP5, "op9_decontamination": _OP9, "op13_fill_in_middle": _OP13}
