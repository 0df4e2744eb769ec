"""Quality rules: a table of thresholds compiled into one Spark projection.

Only SQL functions are used: no Python runs on the executors and nothing is
shuffled.  Words are `[^\\x20\\x09-\\x0D]+` of the whole text; null text has none.
Repeated word windows are found by hash first; only a text with two equal
hashes pays for a sort, and equal windows are confirmed on their words.
Defined cases: empty text has 0 words and fails the base; repeated rows are
judged alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 8
BASE_MIN_WORDS = 20
BASE_MAX_REPEAT_PERCENT = 30
SYMBOLS = "#*$%&|<>"

# Frequent words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to a in is that for it as was with be by on not he this are or his from at which but have an had they you were "
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach "
    "le la les de des et un une du en que qui dans pour par sur est pas au plus ce il ne se sont avec son sa ou mais "
    "el los las y del se una con no por su para al lo como más pero sus o este ha si sobre entre cuando muy sin"
).split()

#: name, metric (SQL over the columns below), least, most; null bounds are open.
RULES = [
    ("mean_word_length", "word_chars / n_words", 1.5, 16.0),
    ("symbol_ratio", "n_symbols / word_chars", None, 0.08),
    ("stop_ratio", "n_stop / n_words", 0.04, None),
    ("duplicate_line_ratio", "n_dup_lines / greatest(n_lines, 1)", None, 0.5),
    ("upper_ratio", "n_upper / word_chars", None, 0.4),
    ("repeat_ratio", "n_repeat_words / n_words", None, 0.3),
]

_SPACE = r"[\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _without(column: str, characters: str):
    """The column's text without these characters; one quick pass for each."""
    out = F.col(column)
    for c in characters:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def measures(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """`keep` (doc_id by default) and the measures that rules may use."""
    keep = keep or ["doc_id"]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    stops = list(dict.fromkeys(STOP_WORDS))
    step = docs.select(*[F.col(c) for c in keep], text.alias("__t")).select(
        *keep, "__t", F.btrim("__t", F.lit(" \t\n\x0b\f\r")).alias("__b")
    ).select(*keep, "__t", F.when(F.col("__b") != "", F.split("__b", _SPACE)).otherwise(F.expr("cast(array() AS array<string>)")).alias("__w"))
    step = step.select(
        *keep,
        "__w",
        F.size("__w").cast("long").alias("n_words"),
        F.length(_without("__t", " \t\n\x0b\f\r")).cast("long").alias("word_chars"),
        (F.length("__t") - F.length(_without("__t", SYMBOLS))).cast("long").alias("n_symbols"),
        F.regexp_count("__t", F.lit("[A-Z]")).cast("long").alias("n_upper"),
        F.filter(F.split("__t", "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("__l"),
        F.expr(
            f"CASE WHEN size(__w) > {WINDOW} THEN transform(sequence(1, size(__w) - {WINDOW - 1}), i -> xxhash64(slice(__w, i, {WINDOW}))) END"
        ).alias("__h"),
        F.size(F.filter("__w", lambda w: F.lower(w).isin(stops))).cast("long").alias("n_stop"),
    )
    head = [*keep, "n_words", "word_chars", "n_symbols", "n_upper", "n_stop"]
    step = step.select(
        *head,
        "__w",
        F.size("__l").cast("long").alias("n_lines"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.expr(
            "CASE WHEN size(array_distinct(__h)) < size(__h) THEN array_sort(transform(__h, (h, i) -> struct(h AS h, i AS i))) END"
        ).alias("__s"),
    )
    head += ["n_lines", "n_dup_lines"]
    step = step.select(
        *head,
        F.expr(
            "array_sort(transform(filter(__s, (x, j) -> x.h <=> get(__s, j - 1).h OR x.h <=> get(__s, j + 1).h),"
            f" x -> struct(array_join(slice(__w, x.i + 1, {WINDOW}), ' ') AS s, x.i AS i)))"
        ).alias("__c"),
    )
    return step.select(
        *head,
        F.expr(
            "coalesce(aggregate(array_sort(transform(filter(__c, (x, j) -> x.s <=> get(__c, j - 1).s OR x.s <=> get(__c, j + 1).s), x -> x.i)),"
            f" struct(0L AS n, -{WINDOW} AS last), (a, p) -> struct(a.n + least({WINDOW}, p - a.last) AS n, p AS last), a -> a.n), 0L)"
        ).alias("n_repeat_words"),
    )


def compiled(rules=RULES):
    """One Boolean column: every rule's metric lies within its bounds (a metric that is null passes)."""
    parts = []
    for _, metric, least, most in rules:
        top, bottom = metric.split(" / ")
        metric = f"{top} / nullif({bottom}, 0)"
        bounds = [f"({metric}) >= {least}D"] * (least is not None) + [f"({metric}) <= {most}D"] * (most is not None)
        parts.append(f"coalesce({' AND '.join(bounds)}, true)")
    return F.expr(" AND ".join(parts))


def judge(docs: DataFrame, rules=RULES) -> DataFrame:
    """doc_id, the base measures, base_failed, kept, and the other measures."""
    failed = F.expr(f"n_words < {BASE_MIN_WORDS} OR 100 * n_repeat_words > {BASE_MAX_REPEAT_PERCENT} * n_words")
    return measures(docs).select(
        F.col("doc_id").cast("long").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & compiled(rules)).alias("kept"), "n_stop", "n_upper", "n_lines",
    )


def oracle() -> str:
    stops = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    parts = []
    for _, metric, least, most in RULES:
        top, bottom = metric.split(" / ")
        value = f"CAST({top} AS DOUBLE) / nullif({bottom}, 0)"
        bounds = [f"{value} >= {least}"] * (least is not None) + [f"{value} <= {most}"] * (most is not None)
        parts.append(f"coalesce({' AND '.join(bounds)}, true)")
    return rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
win AS (SELECT r, unnest(range(1, len(w) - {WINDOW - 2})) AS i, w FROM w WHERE len(w) >= {WINDOW}),
s AS (SELECT r, i, array_to_string(list_slice(w, i, i + {WINDOW - 1}), ' ') AS s FROM win),
dup AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS n FROM s) WHERE n > 1),
rep AS (SELECT r, CAST(sum(least({WINDOW}, i - p)) AS BIGINT) AS n_repeat_words
  FROM (SELECT r, i, coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), -{WINDOW}) AS p FROM dup) GROUP BY r),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(translate(t, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols,
  CAST(length(t) - length(translate(t, '{_UPPER}', '')) AS BIGINT) AS n_upper,
  CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
  CAST(len(list_filter(w, lambda x: list_contains([{stops}], lower(x)))) AS BIGINT) AS n_stop,
  coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN rep USING (r)),
b AS (SELECT *, n_words < {BASE_MIN_WORDS} OR 100 * n_repeat_words > {BASE_MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {" AND ".join(parts)} AS kept, n_stop, n_upper, n_lines FROM b"""
