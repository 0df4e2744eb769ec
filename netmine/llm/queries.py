"""The queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from netmine.llm import (
    bpe, chat_format, decontaminate, fill_middle, html_extract, lexical_search, line_dedup, mixing, near_dedup, quality_model, quality_rules, secret_scan,
    url_filter,
)
from netmine.llm.common import table

URL_RULES = [
    url_filter.Rule("com", "/", "allow"),
    url_filter.Rule("example.com", "/en/", "block"),
    url_filter.Rule("www.example.com", "/en/", "allow"),
    url_filter.Rule("net", "/es/", "block"),
    url_filter.Rule("net", "/fr/", "block"),
]


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit(0).cast("long").alias("seq"),
        F.lit("message").alias("kind"), F.expr("if(id = 0, 'user', 'assistant')").alias("role"), F.lit(said).alias("text"),
    )
    events = chat_format.messages_as_events(table(spark, sf_dir, "conversations")).unionByName(extra)
    return chat_format.digest(chat_format.format_events(events)).drop("n_segments")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op3_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_model.scores(spark, docs, quality_model.train(docs, table(spark, sf_dir, "labels")))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(spark, table(spark, sf_dir, "pages"), URL_RULES)


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(table(spark, sf_dir, "documents"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return bpe.digests(spark, docs, bpe.public_vocabulary())


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digest(table(spark, sf_dir, "documents"))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(table(spark, sf_dir, "documents"))


def queries():
    return {
        "pipeline": corpus_pipeline.run,
        "op1_chat_format": op1_chat_format,
        "op2_quality_rules": op2_quality_rules,
        "op3_quality_model": op3_quality_model,
        "op4_url_filter": op4_url_filter,
        "op5_html_extract": op5_html_extract,
        "op6_secret_scan": op6_secret_scan,
        "op7_line_dedup": op7_line_dedup,
        "op8_near_dedup": op8_near_dedup,
        "op9_decontaminate": op9_decontaminate,
        "op10_bpe": op10_bpe,
        "op11_lexical_search": op11_lexical_search,
        "op12_fill_middle": op12_fill_middle,
        "op13_mixing": op13_mixing,
    }


OP1_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(t) + len(regexp_extract_all(t, '<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>')) AS escaped,
  length(role) + len(regexp_extract_all(role, '[\\\n]')) + len(regexp_extract_all(role, '<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>')) AS r FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, role, t)) AS turns_sha256,
  CAST(coalesce(sum(length(t)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, role, t) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN 13 + escaped + 5 ELSE 10 + r + 1 + escaped + 8 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id"""


def _op4_sql() -> str:
    fits = " UNION ALL ".join(
        f"SELECT page_id, r, '{x.text}' AS rule, '{x.verdict}' AS verdict, {len(x.host)} AS hl FROM h WHERE (host = '{x.host}' OR ends_with(host, '.{x.host}')) AND starts_with(path, '{x.path}')"
        for x in URL_RULES
    )
    return f"""
WITH u AS (SELECT page_id, row_number() OVER () AS r, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
h AS (SELECT page_id, r, coalesce(translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
f AS ({fits}),
b AS (SELECT r, arg_max(struct_pack(rule := rule, verdict := verdict), length(rule) * 1000 + hl) AS b FROM f GROUP BY r)
SELECT page_id, host, path, b.rule AS rule, coalesce(b.verdict, '{url_filter.DEFAULT_VERDICT}') AS verdict FROM h LEFT JOIN b USING (r)"""


# Whole texts by brute force; DuckDB joins the windows by hash.
OP9_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
n AS (SELECT DISTINCT least(10, len(w)) AS n FROM i WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, list_slice(w, k, k + least(10, len(w)) - 1) AS s
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM i WHERE len(w) > 0)),
dw AS (SELECT r, n, k, list_slice(w, k, k + n - 1) AS s FROM (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS k FROM d, n WHERE len(w) >= n)),
m AS (SELECT DISTINCT r, n, k, item_id FROM dw JOIN iw USING (n, s)),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM m) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM m WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)"""


def oracle_sql():
    return {
        "op1_chat_format": OP1_SQL,
        "op9_decontaminate": OP9_SQL,
        "op2_quality_rules": quality_rules.oracle(),
        "op4_url_filter": _op4_sql(),
        "op6_secret_scan": secret_scan.oracle(),
        "op11_lexical_search": lexical_search.oracle(),
        "op12_fill_middle": fill_middle.oracle(),
    }
