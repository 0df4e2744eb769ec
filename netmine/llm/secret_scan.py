"""Secret scans with a trigram inverted index.

On the driver every rule's regular expression is turned into a Boolean query over
lower-cased trigrams (an OR of ANDs).  The index has one posting (trigram,
doc_id) for each document and each trigram that some query asks for; a join
with the queries' terms fetches the postings, and a count for each document,
rule and conjunction intersects them.  Only candidates are verified with the
expression; rules without mandatory trigrams scan every text.  All of it is SQL
functions: no Python runs on the executors.

Spans are code points, end exclusive; leftmost non-overlapping per kind.
Defined cases: null text is empty; documents that share a doc_id share their
candidate rules, which only adds verification; an empty table gives no rows;
null doc_id is a key like any other; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netmine.llm import patterns


@dataclass(frozen=True)
class SecretRule:
    """`group` (0: the match) needs `least` code points; `base` spans are those of the contract."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


# For access and hex the least length is put into the pattern: their matches end
# where their run of characters ends, so a short match never hides a longer one.
RULES = (
    SecretRule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    SecretRule("access", r"AKIA[A-Z0-9]{16,}", base=True),
    SecretRule("hex", r"[0-9a-f]{24,}", base=True),
    SecretRule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    SecretRule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    SecretRule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    SecretRule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)

_MOST_STRINGS = 8


def _lower(code: int) -> str:
    return chr(code + 32) if 65 <= code <= 90 else chr(code)


def _strings(node) -> set[str] | None:
    """All lower-cased strings of a parsed node, None if they are too many."""
    name = node[0]
    if name == "literal":
        return {_lower(node[1])}
    if name == "set":
        chars = None if node[1] is None else {_lower(c) for c in node[1]}
        return chars if chars is not None and len(chars) <= _MOST_STRINGS else None
    if name == "group":
        return _sequence_strings(node[1])
    if name == "either":
        parts = [_sequence_strings(x) for x in node[1]]
        joined = set().union(*parts) if None not in parts else None
        return joined if joined is not None and len(joined) <= _MOST_STRINGS else None
    if name == "repeat":
        least, most, nodes = node[1]
        inner = _sequence_strings(nodes) if most is not None and most <= 4 else None
        if inner is None:
            return None
        out: set[str] = set()
        power = {""}
        for n in range(most + 1):
            if n >= least:
                out |= power
            power = {a + b for a in power for b in inner}
        return out if len(out) <= _MOST_STRINGS else None
    return {""}


def _sequence_strings(nodes) -> set[str] | None:
    out = {""}
    for node in nodes:
        more = _strings(node)
        if more is None or len(out) * len(more) > _MOST_STRINGS:
            return None
        out = {a + b for a in out for b in more}
    return out


def _query(nodes) -> list[frozenset[str]]:
    """An OR of ANDs of trigrams that every match contains; [frozenset()] asks for nothing."""
    clauses: list[list[frozenset[str]]] = []
    run = {""}

    def flush():
        nonlocal run
        clauses.append(_simplified([frozenset(s[i : i + 3] for i in _covering(len(s))) for s in run]))
        run = {""}

    for node in nodes:
        name = node[0]
        more = _strings(node)
        if more is not None and len(run) * len(more) <= _MOST_STRINGS:
            run = {a + b for a in run for b in more}
            continue
        flush()
        if more is not None:
            run = more
        elif name == "group":
            clauses.append(_query(node[1]))
        elif name == "either":
            clauses.append(_simplified([c for x in node[1] for c in _query(x)]))
        elif name == "repeat" and node[1][0] >= 1:
            clauses.append(_query(node[1][2]))
    flush()
    out = [frozenset()]
    for clause in clauses:
        if len(out) * len(clause) <= 64:
            out = _simplified([a | b for a in out for b in clause])
    return out


def _covering(length: int) -> list[int]:
    """Starts of the fewest trigrams that cover a string."""
    return [*range(0, length - 2, 3), length - 3] if length >= 3 else []


def _simplified(terms: list[frozenset[str]]) -> list[frozenset[str]]:
    terms = list(dict.fromkeys(terms))
    return [t for t in terms if not any(u < t for u in terms)]


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """The rule's query, None if it has no mandatory trigrams."""
    query = _query(patterns.parse(pattern))
    return None if frozenset() in query else query


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index for these trigrams: trigram and the document's key, one row each."""
    low = F.lower(F.coalesce(F.col("text").cast("string"), F.lit("")))  # may fold more than A-Z, which only adds candidates
    found = docs.select("__key", low.alias("__low")).select(
        "__key", F.array_compact(F.array(*[F.when(F.contains("__low", F.lit(t)), F.lit(t)) for t in trigrams])).alias("__found")
    )
    return found.select(F.explode("__found").alias("trigram"), "__key")


def candidates(docs: DataFrame, rules=RULES) -> DataFrame:
    """Keys and the kinds whose trigram query the documents of that key meet; a key that two share only adds candidates."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) is not None}
    terms = [(k, i, t, len(c)) for k, q in queries.items() for i, c in enumerate(q) for t in sorted(c)]
    trigrams = sorted({t for _, _, t, _ in terms})
    if not trigrams:
        return docs.select("__key").where("false").withColumn("__kinds", F.array().cast("array<string>"))
    asked = F.explode(
        F.element_at(
            F.create_map(*[x for t in trigrams for x in (F.lit(t), F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(i).alias("conj"), F.lit(n).alias("need")) for k, i, u, n in terms if u == t]))]),
            F.col("trigram"),
        )
    )
    hits = postings(docs, trigrams).distinct().select("__key", asked.alias("q")).select("__key", "q.*")
    met = hits.groupBy("__key", "kind", "conj", "need").count().where("`count` = need")
    return met.groupBy("__key").agg(F.collect_set("kind").alias("__kinds"))


def _spans(rule: SecretRule, rank: int) -> F.Column:
    """Array of (start, rank, end) from the texts between matches and the matches."""
    pattern = rule.pattern.replace("\\", "\\\\").replace("'", "\\'")
    lengths = f"transform(regexp_extract_all(__t, '{pattern}', 0), x -> length(x))"
    held = f"transform(regexp_extract_all(__t, '{pattern}', {rule.group}), x -> length(x))"
    parts = [f"transform(split(__t, '{pattern}', -1), x -> length(x))", lengths, *[held] * (rule.group > 0)]
    long_enough = f"coalesce(x.`{len(parts) - 1}`, 0) >= {rule.least}"
    return F.expr(
        f"CASE WHEN __t RLIKE '{pattern}' THEN aggregate(arrays_zip({', '.join(parts)}),"
        f" struct(0 AS at, cast(array() AS array<struct<start: int, rank: int, end: int>>) AS out),"
        f" (a, x) -> struct(a.at + x.`0` + coalesce(x.`1`, 0) AS at, CASE WHEN {long_enough}"
        f" THEN concat(a.out, array(struct(a.at + x.`0` AS start, {rank} AS rank, a.at + x.`0` + x.`1` AS end))) ELSE a.out END AS out), a -> a.out)"
        f" ELSE cast(array() AS array<struct<start: int, rank: int, end: int>>) END"
    )


def scan(docs: DataFrame, rules=RULES) -> DataFrame:
    """doc_id, and an array of spans (start, rank, end) in the order of start and kind; rank counts the rules."""
    # documents are known by a hash of id and text, so that rows without an id, or with the same, don't meet in one task
    keyed = docs.withColumn("__key", F.xxhash64("doc_id", F.col("text").cast("string")))
    chosen = candidates(keyed, rules)
    none = "cast(array() AS array<struct<start: int, rank: int, end: int>>)"
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    joined = keyed.select("__key", F.col("doc_id"), text.alias("__t")).join(chosen, "__key", "left")
    found = [
        F.when(F.array_contains("__kinds", r.kind) if trigram_query(r.pattern) is not None else F.lit(True), _spans(r, i)).otherwise(F.expr(none))
        for i, r in enumerate(rules)
    ]
    return joined.select("doc_id", F.array_sort(F.concat(*found)).alias("found"))


def _text(spans: str, rules) -> str:
    names = "array(" + ", ".join(f"'{r.kind}'" for r in rules) + ")"
    return f"array_join(transform({spans}, x -> concat(element_at({names}, x.rank + 1), ':', x.start, ':', x.end)), ',')"


def digest(docs: DataFrame, rules=RULES) -> DataFrame:
    base = [i for i, r in enumerate(rules) if r.base]
    of_base = f"filter(found, x -> x.rank IN ({', '.join(map(str, base))}))"
    return scan(docs, rules).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *[F.expr(f"cast(size(filter(found, x -> x.rank = {i})) AS bigint)").alias(f"n_{rules[i].kind}") for i in base],
        F.expr(f"sha2({_text(of_base, rules)}, 256)").alias("base_sha256"),
        F.expr(_text("found", rules)).alias("spans"),
    )


def oracle(rules=RULES) -> str:
    def spans(r: SecretRule, i: int) -> str:
        p = r.pattern.replace("((?i:password|passwd|secret|token|api_?key))", "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])").replace("'", "''")
        lengths = lambda e: f"list_transform({e}, lambda x: length(x))"
        return (
            f"SELECT r, doc_id, {i} AS rank, '{r.kind}' AS kind, unnest(range(1, len(m) + 1)) AS j, g, m, n FROM (SELECT r, doc_id,"
            f" {lengths(f"string_split_regex(t, '{p}')")} AS g, {lengths(f"regexp_extract_all(t, '{p}')")} AS m, {lengths(f"regexp_extract_all(t, '{p}', {r.group})")} AS n FROM d)"
        )

    base = " , ".join(f"'{r.kind}'" for r in rules if r.base)
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in rules if r.base)
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
s AS ({" UNION ALL ".join(spans(r, i) for i, r in enumerate(rules))}),
p AS (SELECT r, rank, kind, n[j] AS held, list_sum(g[1:j]) + coalesce(list_sum(m[1:j-1]), 0) AS a, m[j] AS size FROM s),
k AS (SELECT r, rank, kind, CAST(a AS BIGINT) AS a, CAST(a + size AS BIGINT) AS b FROM p
  WHERE held >= list_extract([{", ".join(str(r.least) for r in rules)}], rank + 1)),
g AS (SELECT r, {counts},
  coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank) FILTER (WHERE kind IN ({base})), '') AS base,
  string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank) AS spans FROM k GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in rules if r.base)},
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (r)"""
