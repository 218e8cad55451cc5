"""The registered queries of the operators, one ``opN_<name>`` each, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import brown_lm, chat_tools, compaction, decontamination, html_extraction, jaccard_join, language_id, packing, quality_rules, token_counts
from .common import Scratch, small_batches, table


def vocabulary(name: str) -> str:
    """A public tokenizer's file, found where the installed package keeps it."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return html_extraction.extract(table(spark, sf_dir, "pages"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language_id.identify(docs).select("doc_id", "held_out", "lang_pred", "score")


def op3_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = chat_tools.from_turns(table(spark, sf_dir, "conversations"))
    linked = chat_tools.link(calls, results, chat_tools.TURN_SCHEMAS)
    return linked.withColumn("errors", F.array_join("errors", ","))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return jaccard_join.join(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return brown_lm.held_out_score(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, vocabulary("byte_bpe_50k.json")).drop("text")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row_hash")


def op8_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as they arrive, three quarters and then the rest, compacted and read back from the last version."""
    docs = table(spark, sf_dir, "documents")
    sharded = compaction.Table(spark, Scratch(spark, "shards").base)
    late = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(0))), F.lit(4)) == 0
    sharded.append(docs.where(~late))
    sharded.append(docs.where(late))
    before = sharded.manifest().count()
    while sharded.compact() is not None:
        sharded.vacuum()
    # Names, sizes and numbers of shards differ from run to run; what holds of them in each does not.
    fewer = sharded.manifest().count() <= before
    return sharded.read().select(
        "doc_id",
        "source",
        "lang",
        "n_chars",
        F.octet_length("text").cast("long").alias("n_bytes"),
        F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"),
        F.lit(sharded.settled()).alias("settled"),
        F.lit(fewer).alias("fewer_shards"),
    )


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality_rules.judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), with_ids=False).drop("ids")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": op1_html_extraction,
    "op2_language_id": op2_language_id,
    "op3_tool_calls": op3_tool_calls,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_brown_lm": op5_brown_lm,
    "op6_token_counts": op6_token_counts,
    "op7_decontamination": op7_decontamination,
    "op8_compaction": op8_compaction,
    "op9_quality_rules": op9_quality_rules,
    "op10_packing": op10_packing,
}


def _quality_sql() -> str:
    stop = ", ".join("'" + w.replace("'", "''") + "'" for w in quality_rules.FUNCTION_WORDS)
    fails = []
    for r in quality_rules.RULES:
        base = r.base or "1"
        parts = [f"{r.per} * {r.figure} < {r.low} * {base}"] * (r.low is not None) + [f"{r.per} * {r.figure} > {r.high} * {base}"] * (r.high is not None)
        only = "coalesce(lang, '') IN (" + ", ".join(f"'{x}'" for x in r.languages) + ") AND " if r.languages is not None else ""
        fails.append(f"({only}(" + " OR ".join(parts) + "))")
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, lang, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT rid, i, array_to_string(list_slice(words, i, i + 7), ' ') AS x FROM (SELECT rid, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, x) AS n FROM win) WHERE n > 1),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM rep) GROUP BY rid),
f AS (SELECT doc_id, lang, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
             CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(regexp_extract_all(text, '!')) AS BIGINT) AS n_exclamations,
             CAST(len(list_filter(words, lambda x: lower(x) IN ({stop}))) AS BIGINT) AS n_stop_words, CAST(len(lines) AS BIGINT) AS n_lines,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN cov USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed, NOT ({" OR ".join(fails)}) AS kept FROM f"""


_DECONTAMINATION_SQL = r"""
WITH dw AS (SELECT rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
            FROM (SELECT row_number() OVER () AS rid, doc_id, text FROM documents)),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
iv AS (SELECT DISTINCT item_id, least(13, len(words)) AS k, array_to_string(list_slice(words, s, s + least(13, len(words)) - 1), ' ') AS x
       FROM (SELECT item_id, words, unnest(range(1, len(words) - least(13, len(words)) + 2)) AS s FROM iw WHERE len(words) > 0)),
ks AS (SELECT DISTINCT k FROM iv),
dv AS (SELECT rid, k, s, array_to_string(list_slice(words, s, s + k - 1), ' ') AS x FROM (SELECT rid, words, k, unnest(range(1, len(words) - k + 2)) AS s FROM dw, ks WHERE len(words) >= k)),
hit AS (SELECT DISTINCT rid, s, dv.k AS k, item_id FROM dv JOIN iv ON dv.k = iv.k AND dv.x = iv.x),
n AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + k)) AS p FROM hit) GROUP BY rid),
it AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item_id FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM dw LEFT JOIN n USING (rid) LEFT JOIN it USING (rid)"""


_TOOL_CALLS_SQL = """
WITH RECURSIVE calls AS (SELECT DISTINCT conv_id, turn, text FROM conversations WHERE role = 'user'),
results AS (SELECT conv_id, turn - 1 AS turn, min(text) AS content FROM conversations WHERE role = 'assistant' GROUP BY ALL),
n AS (SELECT DISTINCT conv_id, turn FROM calls),
lv(conv_id, turn, level) AS (
  SELECT conv_id, turn, 0 FROM n WHERE turn < 2 OR NOT EXISTS (SELECT 1 FROM n p WHERE p.conv_id = n.conv_id AND p.turn = n.turn - 2)
  UNION ALL SELECT n.conv_id, n.turn, lv.level + 1 FROM lv JOIN n ON n.conv_id = lv.conv_id AND n.turn = lv.turn + 2 WHERE n.turn >= 2),
asked AS (SELECT c.conv_id, c.turn, c.text, r.conv_id IS NOT NULL AS linked, r.content, lv.level, c.turn >= 2 AND p.turn IS NULL AS missing
  FROM calls c LEFT JOIN results r ON c.conv_id = r.conv_id AND c.turn = r.turn LEFT JOIN lv ON lv.conv_id = c.conv_id AND lv.turn = c.turn
  LEFT JOIN n p ON p.conv_id = c.conv_id AND p.turn = c.turn - 2)
SELECT conv_id, concat('call_', conv_id, '_', turn) AS call_id, turn, 'reply' AS tool, level, linked, text IS NOT NULL AND NOT missing AS valid,
       concat_ws(',', CASE WHEN text IS NULL THEN 'missing:prompt' END, CASE WHEN missing THEN 'missing_dependency' END) AS errors,
       concat('{"arguments":{', CASE WHEN text IS NOT NULL THEN concat('"prompt":', to_json(text), ',') ELSE '' END, '"turn":', turn, '},"id":"call_', conv_id, '_', turn, '"',
              CASE WHEN content IS NOT NULL THEN concat(',"result":', to_json(content)) ELSE '' END, ',"tool":"reply"}') AS json
FROM asked
UNION ALL
SELECT conv_id, concat('call_', conv_id, '_', turn), turn + 1, NULL, NULL, FALSE, FALSE, 'unknown_call',
       concat('{"id":"call_', conv_id, '_', turn, '"', CASE WHEN content IS NOT NULL THEN concat(',"result":', to_json(content)) ELSE '' END, '}')
FROM results r WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.conv_id = r.conv_id AND n.turn = r.turn)"""


_JACCARD_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(words, i, i + 4), ' ') AS g FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON x = nx.doc_id JOIN n ny ON y = ny.doc_id WHERE 5 * c >= 4 * (nx.n + ny.n - c)),
r(node, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.y, r.root FROM r JOIN l ON l.x = r.node AND r.root < l.y)
SELECT doc_id, min(root) AS class_id, CAST(coalesce(any_value(k), 0) AS BIGINT) AS n_links
FROM documents JOIN r ON node = doc_id LEFT JOIN (SELECT x, count(*) AS k FROM l GROUP BY 1) ON x = doc_id GROUP BY doc_id"""


_COMPACTION_SQL = """
SELECT doc_id, source, lang, n_chars, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes, sha256(text) AS text_sha256, TRUE AS settled, TRUE AS fewer_shards FROM documents"""


def oracle_sql() -> dict[str, str]:
    return {"op8_compaction": _COMPACTION_SQL, "op3_tool_calls": _TOOL_CALLS_SQL, "op4_jaccard_join": _JACCARD_SQL, "op7_decontamination": _DECONTAMINATION_SQL, "op9_quality_rules": _quality_sql()}
