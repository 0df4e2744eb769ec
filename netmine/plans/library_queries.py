"""Queries over expressions, names, libraries, checks and sinks, with their SQL twins.

Readings of the tables: a part is a library cell, its function the one of three
inputs numbered p_partkey % 256, its name `C<p_size>_X<drive>` with a drive of 1, 2, 4 or 8;
orders are runs, customers are cells in use.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from netmine.functions import expr, names, space, truth
from netmine.operators import checks, library
from netmine.plans.catalogue import P3, forms_sql, pick_sql, query
from netmine.session import shared_folder, table
from netmine.sinks import tables as sinks
from netmine.sinks import versions

_BITS = "lpad(bin(p_partkey % 256), 8, '0')"
_DRIVE = "pow(2, p_partkey % 4)::INT"
_NAME = f"'C' || p_size || '_X' || {_DRIVE}"
#: cells: one row for each part.
CELLS = f"cells AS (SELECT p_partkey AS id, {_NAME} AS name, {_DRIVE} AS drive, p_size AS area, p_brand AS brand, p_type AS kind, {_BITS} AS tt FROM part), keyed AS (SELECT *, '0b' || {P3} AS p_key FROM cells)"


def _fresh(spark) -> str:
    """A new place in the folder that the cluster shares."""
    return f"{shared_folder(spark)}/sink-{uuid.uuid4().hex}"


def cells(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    drive = F.pow(F.lit(2), F.col("p_partkey") % 4).cast("int")
    rows = part.select(
        F.col("p_partkey").alias("id"), F.concat(F.lit("C"), F.col("p_size").cast("string"), F.lit("_X"), drive.cast("string")).alias("name"), drive.alias("drive"),
        F.col("p_size").alias("area"), F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"), F.pmod("p_partkey", F.lit(256)).cast("long").alias("value"),
    )
    return rows.join(space.p_dim(spark, 3), "value").select("*", truth.bits_column(F.col("value"), 3).alias("tt"), truth.key_column(F.col("p"), 3).alias("p_key")).drop("p")


# ---------------------------------------------------------------- expressions


def _spelt(bits, spelling):
    text = truth.minterms(bits, 3)
    return (
        F.when(spelling == 0, text).when(spelling == 1, F.replace(F.replace(text, F.lit(" + "), F.lit(" || ")), F.lit("*"), F.lit(" && ")))
        .when(spelling == 2, F.regexp_replace(F.replace(text, F.lit(" + "), F.lit("|")), r"!(A\d)", "$1'")).otherwise(F.regexp_replace(F.replace(text, F.lit("*"), F.lit("&")), r"!(A\d)", "~($1)"))
    )


@query(f"""WITH b AS (SELECT p_partkey, p_partkey % 256 AS v, {_BITS} AS tt FROM part),
c AS (SELECT *, v IN (0, 255) AS flat FROM b)
SELECT p_partkey, CASE WHEN flat THEN 0 ELSE 3 END AS n_inputs, CASE WHEN flat THEN tt[1] ELSE tt END AS tt, CASE WHEN flat THEN tt[1] ELSE {pick_sql('tt', [0, 4, 2, 6, 1, 5, 3, 7])} END AS tt_least_first,
CASE WHEN flat THEN '1#0x' || tt[1] ELSE '8#0x' || upper(lpad(to_hex(v), 2, '0')) END AS key FROM c""")
def q_expression_table(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", _spelt(truth.bits_column(F.pmod("p_partkey", F.lit(256)), 3), F.col("p_partkey") % 4).alias("e"))
    used = rows.select("p_partkey", "e", expr.variables(F.col("e")).alias("v"))
    both = expr.tabulated(expr.tabulated(used, "e", "v"), "e", "v", "tt_least_first", least_first=True)
    return both.select("p_partkey", F.size("v").alias("n_inputs"), "tt", "tt_least_first", expr.hex_of(F.col("tt")).alias("key"))


@query("""SELECT p_partkey, lpad(bin(p_partkey % 65536), 16, '0') AS bits, '16#0x' || lpad(upper(to_hex(p_partkey % 65536)), 4, '0') AS normal, 4 AS n_inputs FROM part""")
def q_key_parse(spark, sf_dir):
    text = F.concat(F.lit(" 16 # 0x"), F.lower(F.hex(F.pmod("p_partkey", F.lit(65536)))), F.lit(" "))
    rows = table(spark, sf_dir, "part").select("p_partkey", text.alias("k"))
    return rows.select("p_partkey", expr.key_bits(F.col("k")).alias("bits"), expr.normal_key(F.col("k")).alias("normal"), expr.inputs_of_key(F.col("k")).alias("n_inputs"))


_MET = "(SELECT DISTINCT p_partkey % 256 AS v FROM part)"


def _met(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.pmod("p_partkey", F.lit(256)).alias("value")).distinct()


@query(f"SELECT v AS value, lpad(bin(v), 8, '0') AS tt FROM {_MET}")
def q_minimal_sum(spark, sf_dir):
    """The shortest sum of each function met, evaluated again."""
    names_ = F.array(F.lit("a"), F.lit("b"), F.lit("c"))
    rows = _met(spark, sf_dir).select("value", truth.bits_column(F.col("value"), 3).alias("tt"))
    short = rows.select("value", expr.minimise(F.col("tt"), names_).alias("e"))
    return short.select("value", expr.truth_table(F.col("e"), names_).alias("tt"))


@query(f"SELECT p_partkey, {_BITS} IN ('00001111', '00110011', '01010101') AS projection FROM part")
def q_projection_test(spark, sf_dir):
    bits = truth.bits_column(F.pmod("p_partkey", F.lit(256)), 3)
    return table(spark, sf_dir, "part").select("p_partkey", truth.projection(bits, 3).alias("projection"))


@query(f"""WITH t AS (SELECT v, lpad(bin(v), 8, '0') AS tt FROM {_MET})
SELECT v AS value, least({', '.join(forms_sql('tt', 3, range(8), [0, 1]))}) AS smallest FROM (SELECT v, reverse(tt) AS tt FROM t)""")
def q_npn_least_integer(spark, sf_dir):
    return _met(spark, sf_dir).join(space.least_integer_dim(spark, 3), "value").select("value", truth.bits_column(F.col("least"), 3).alias("smallest"))


# ---------------------------------------------------------------- names and numbers


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size AS VARCHAR) ELSE rtrim(rtrim(printf('%.6f', p_size + (p_partkey % 1000) / 1000.0 + 0.25), '0'), '.') END AS shown,
split_part(p_name, ' ', 1) AS first_word, regexp_replace(p_brand, '[^A-Za-z0-9_]', '_', 'g') AS component, CASE WHEN contains(p_type, 'x') THEN split_part(p_type, 'x', 1) WHEN contains(p_type, '_') THEN split_part(p_type, '_', 1) ELSE p_type END AS family,
CASE WHEN contains(p_name, ',') OR contains(p_name, '"') THEN '"' || replace(p_name || '",', '"', '""') || '"' ELSE '"' || replace(p_name || '",', '"', '""') || '"' END AS quoted FROM part""")
def q_name_functions(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    number = F.when(F.col("p_partkey") % 3 == 0, F.col("p_size") + F.lit(1e-11)).otherwise(F.col("p_size") + F.pmod("p_partkey", F.lit(1000)) / 1000.0 + 0.25)
    return part.select(
        "p_partkey", names.format_count(number).alias("shown"), F.element_at(names.split_fields(F.regexp_replace("p_name", " ", ","), 2), 1).alias("first_word"),
        names.component(F.col("p_brand")).alias("component"), names.family(F.col("p_type")).alias("family"), names.csv_quote(F.concat("p_name", F.lit('",'))).alias("quoted"),
    )


@query(f"""WITH {CELLS} SELECT id, drive, 'C' || area || '_X2' AS doubled, CAST(drive AS DOUBLE) AS scale, area % 7 = 3 AS like_three,
CASE WHEN id % 5 = 0 THEN '1#0x1' WHEN id % 5 = 1 THEN '1#0x0' END AS tie, id % 5 > 1 AS logic, id % 2 = 0 AS inverter, id % 2 = 1 AS buffer FROM cells""")
def q_cell_predicates(spark, sf_dir):
    c = cells(spark, sf_dir)
    odd = F.when(F.col("id") % 5 == 0, "TIEHI_1").when(F.col("id") % 5 == 1, "tielo").otherwise("AND2")
    classes = F.when(F.col("id") % 5 < 2, "const")
    function = F.when(F.col("id") % 2 == 0, F.when(F.col("id") % 4 == 0, " ! A").otherwise("A '")).otherwise(" A")
    return c.select(
        "id", names.drive(F.col("name")).alias("drive"), names.with_drive(F.col("name"), 2).alias("doubled"), names.drive_scale(F.col("name")).alias("scale"),
        names.glob_match((F.col("area") % 7).cast("string"), "[3]*").alias("like_three"), names.tie_key(odd).alias("tie"), names.is_logic(F.col("name"), classes).alias("logic"),
        names.is_inverter(function, F.lit("A")).alias("inverter"), names.is_buffer(function, F.lit("A")).alias("buffer"),
    )


@query("""SELECT c_custkey, list_sort([c_name, c_mktsegment])[1] || ';' || list_sort([c_name, c_mktsegment])[2] AS key, 2 AS n_parts,
['a', 'b', 'c', 'd', 'e'][CAST(CAST('0x' || substr(md5(list_sort([c_name, c_mktsegment])[1] || ',' || list_sort([c_name, c_mktsegment])[2]), 1, 15) AS BIGINT) % 5 AS INT) + 1] AS choice,
round(1000 / (100.0 + c_custkey % 7), 6) AS period, (100.0 + c_custkey % 7) AS freq, c_nationkey AS rep FROM customer""")
def q_signature_functions(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    both = F.array("c_name", "c_mktsegment")
    run = F.concat(F.lit("0.5_"), (100 + F.col("c_custkey") % 7).cast("string"), F.lit(".0_"), F.col("c_nationkey").cast("string"))
    _, freq, rep = names.run_parts(run)
    parts = names.signature_parts(F.concat(F.lit(" ; "), F.array_join(both, " ;; "), F.lit(";")))
    return rows.select(
        "c_custkey", names.joined_key(both).alias("key"), F.size(parts).alias("n_parts"), names.seeded_choice(both, F.array(*map(F.lit, "abcde"))).alias("choice"), freq, rep
    ).withColumn("period", F.round(names.period(F.col("freq")), 6))


# ---------------------------------------------------------------- libraries


@query(f"WITH {CELLS}, p AS (SELECT DISTINCT p_key FROM keyed WHERE area <= 5) SELECT id, p_key IN (SELECT p_key FROM p) OR p_key = '0b01' AS by_key, name LIKE 'C1%' OR name LIKE '%\\_X8' ESCAPE '\\' AS by_name FROM keyed")
def q_library_mask(spark, sf_dir):
    c = cells(spark, sf_dir)
    one = c.select(F.concat(F.col("id").cast("string")).alias("name"), "p_key", "id")
    globs = spark.createDataFrame([("C1*",), ("*_X8",)], "pattern string")
    a = library.mask(one, keys=c.where("area <= 5")).select("id", F.col("active").alias("by_key"))
    # names repeat among cells, the mask is by name
    b = library.mask(c.select("name", F.lit("").alias("p_key")).distinct(), patterns=globs).select("name", F.col("active").alias("by_name"))
    return a.join(c.select("id", "name"), "id").join(b, "name").select("id", "by_key", "by_name")


_RULES = """rules AS (SELECT o_orderkey AS run, CASE o_orderkey % 4 WHEN 0 THEN 'filter_deny' WHEN 1 THEN 'only_use' WHEN 2 THEN 'canonical_keys' ELSE 'direct_deny' END AS source,
CASE o_orderkey % 4 WHEN 2 THEN '0b' || lpad(bin(o_orderkey % 64), 8, '0') ELSE 'B' || o_orderkey % 30 END AS value FROM orders WHERE o_orderkey % 10 = 0
UNION ALL SELECT o_orderkey, 'only_use', 'B' || o_orderkey % 25 FROM orders WHERE o_orderkey % 20 = 0)"""
_BRANDS = f"brands AS (SELECT 'B' || i AS name, '0b' || {P3} AS p_key FROM (SELECT i, lpad(bin((37 * i + 11) % 256), 8, '0') AS tt FROM (SELECT unnest(range(1, 26)) AS i)))"


@query(f"""WITH {_RULES}, {_BRANDS},
hit AS (SELECT r.run, r.source, b.name, list_position(['direct_deny', 'provenance_deny', 'filter_deny', 'only_use', 'canonical_keys'], r.source) AS rank
  FROM (SELECT DISTINCT run, source FROM rules) r CROSS JOIN brands b
  WHERE CASE WHEN r.source LIKE '%deny' THEN NOT EXISTS (SELECT 1 FROM rules x WHERE x.run = r.run AND x.source = r.source AND x.value = b.name)
    WHEN r.source = 'only_use' THEN EXISTS (SELECT 1 FROM rules x WHERE x.run = r.run AND x.source = r.source AND x.value = b.name)
    ELSE EXISTS (SELECT 1 FROM rules x WHERE x.run = r.run AND x.source = r.source AND x.value = b.p_key) END)
SELECT run, source, name FROM hit QUALIFY rank = min(rank) OVER (PARTITION BY run)""")
def q_library_subset(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey").where("o_orderkey % 10 = 0")
    rules = o.selectExpr(
        "o_orderkey AS run", "CASE o_orderkey % 4 WHEN 0 THEN 'filter_deny' WHEN 1 THEN 'only_use' WHEN 2 THEN 'canonical_keys' ELSE 'direct_deny' END AS source",
        "CASE o_orderkey % 4 WHEN 2 THEN concat('0b', lpad(bin(o_orderkey % 64), 8, '0')) ELSE concat('B', o_orderkey % 30) END AS value",
    ).union(o.where("o_orderkey % 20 = 0").selectExpr("o_orderkey AS run", "'only_use' AS source", "concat('B', o_orderkey % 25) AS value"))
    brands = spark.range(1, 26).select("id", ((37 * F.col("id") + 11) % 256).alias("value")).join(space.p_dim(spark, 3), "value")
    return library.subset(rules, brands.select(F.concat(F.lit("B"), F.col("id").cast("string")).alias("name"), truth.key_column(F.col("p"), 3).alias("p_key")))


_USED = "used AS (SELECT CASE c_custkey % 3 WHEN 0 THEN 'C' || c_nationkey || '_X' || pow(2, c_custkey % 4)::INT WHEN 1 THEN 'D' || c_nationkey || '_SH' ELSE 'C' || c_nationkey || '_X1' END AS name, count(*) AS n FROM customer GROUP BY 1)"


def _used(spark, sf_dir):
    name = (
        F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("C"), F.col("c_nationkey").cast("string"), F.lit("_X"), F.pow(F.lit(2), F.col("c_custkey") % 4).cast("int").cast("string")))
        .when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("D"), F.col("c_nationkey").cast("string"), F.lit("_SH"))).otherwise(F.concat(F.lit("C"), F.col("c_nationkey").cast("string"), F.lit("_X1")))
    )
    return table(spark, sf_dir, "customer").groupBy(name.alias("name")).agg(F.count("*").alias("n"))


@query(f"""WITH {_USED}, allowed AS (SELECT 'C' || n_nationkey || '_X1' AS a FROM nation WHERE n_nationkey % 2 = 0)
SELECT name, n, CASE WHEN name LIKE 'C1%' OR name LIKE 'D?' OR regexp_matches(name, '^D.\\_SH$') THEN 'violation' ELSE 'ok' END AS by_deny,
CASE WHEN name IN (FROM allowed) THEN 'ok' WHEN regexp_replace(name, '_X[248](_.*)?$', '_X1') IN (FROM allowed) THEN 'drive' WHEN ends_with(name, '_SH') THEN 'sequential' ELSE 'violation' END AS by_allow FROM used""")
def q_compliance(spark, sf_dir):
    used = _used(spark, sf_dir)
    deny = spark.createDataFrame([("C1*",), ("D?_SH",)], "pattern string")
    allow = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.concat(F.lit("C"), F.col("n_nationkey").cast("string"), F.lit("_X1")).alias("pattern"))
    a = library.compliance(used, deny).withColumnRenamed("verdict", "by_deny")
    return library.compliance(a, allow, allow=True).withColumnRenamed("verdict", "by_allow")


@query(f"""WITH {CELLS}, v AS (SELECT DISTINCT name, p_key FROM keyed WHERE id % 2 = 0), asked AS (SELECT DISTINCT name, p_key, drive FROM keyed),
best AS (SELECT p_key, CAST(regexp_extract(name, '_X(\\d+)', 1) AS INT) AS drive, min(name) AS best FROM v GROUP BY 1, 2)
SELECT a.name, a.p_key, CASE WHEN a.name IN (SELECT name FROM v) THEN a.name ELSE coalesce(best, a.name) END AS resolved FROM asked a LEFT JOIN best USING (p_key, drive)""")
def q_resolve_names(spark, sf_dir):
    c = cells(spark, sf_dir)
    return library.resolve(c.select("name", "p_key").distinct(), c.where("id % 2 = 0").select("name", "p_key").distinct())


@query(f"WITH {CELLS} SELECT p_key, CAST(sum(area) AS BIGINT) AS area, arg_min(brand, id) AS brand FROM keyed GROUP BY 1")
def q_remap_keys(spark, sf_dir):
    return library.remap(cells(spark, sf_dir).select("id", "tt", "area", "brand", "p_key"), "p_key", F.col("p_key"), ["area"], ["brand"], "id")


@query("""WITH u AS (SELECT s_nationkey AS run, s_suppkey, s_suppkey % 11 AS cell, s_suppkey % 3 > 0 AS logic, CAST(s_acctbal AS INT) AS n FROM supplier),
a AS (SELECT run, count(*) FILTER (WHERE cell = 7) AS unknown, count(DISTINCT cell) FILTER (WHERE logic AND n > 0) AS active FROM u GROUP BY 1)
SELECT n_nationkey AS run, CASE WHEN n_nationkey % 9 = 0 THEN 'no patterns' WHEN n_nationkey % 9 = 1 THEN 'broken' WHEN coalesce(unknown, 0) > 0 THEN 'unknown cells' WHEN coalesce(active, 0) < 2 THEN 'too few cells' END AS reason FROM nation LEFT JOIN a ON run = n_nationkey""")
def q_run_admission(spark, sf_dir):
    runs = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("run"), (F.col("n_nationkey") % 9 != 0).alias("has_patterns"), (F.col("n_nationkey") % 9 == 1).alias("broken"))
    used = table(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").alias("run"), (F.col("s_suppkey") % 11).cast("string").alias("name"), (F.col("s_suppkey") % 3 > 0).alias("is_logic"), F.col("s_acctbal").cast("int").alias("count")
    )
    vocabulary = spark.range(11).where("id <> 7").select(F.col("id").cast("string").alias("name"))
    return library.admit(runs, used, vocabulary).select("run", "reason")


_METRICS = """m AS (SELECT s_suppkey AS run, s_nationkey AS area, s_suppkey % 13 AS freq, s_suppkey % 5 <> 0 AS completed, (s_suppkey % 9) * -0.005 AS slack_in2reg, (s_suppkey % 6) * -0.004 AS slack_clock,
s_suppkey * 7 % 400 AS drc, s_suppkey * 3 % 25 AS shorts FROM supplier), g AS (SELECT * FROM m WHERE completed AND slack_in2reg >= -0.02 AND slack_clock >= -0.02 AND drc <= 200 AND shorts <= 20)"""


def _metrics(spark, sf_dir):
    return table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS run", "s_nationkey AS area", "s_suppkey % 13 AS freq", "s_suppkey % 5 <> 0 AS completed", "(s_suppkey % 9) * -0.005 AS slack_in2reg", "(s_suppkey % 6) * -0.004 AS slack_clock",
        "s_suppkey * 7 % 400 AS drc", "s_suppkey * 3 % 25 AS shorts",
    )


@query(f"WITH {_METRICS} SELECT 'least area' AS what, freq AS fixed, arg_min(run, (area, run)) AS run, CAST(min(area) AS BIGINT) AS value FROM g GROUP BY freq UNION ALL SELECT 'most freq', area, arg_min(run, (-freq, run)), max(freq) FROM g GROUP BY area")
def q_best_passing(spark, sf_dir):
    m = _metrics(spark, sf_dir)
    a = library.best_passing(m, "freq", "area", least=True).select(F.lit("least area").alias("what"), F.col("freq").cast("long").alias("fixed"), "run", F.col("area").cast("long").alias("value"))
    b = library.best_passing(m, "area", "freq", least=False).select(F.lit("most freq").alias("what"), F.col("area").cast("long").alias("fixed"), "run", F.col("freq").cast("long").alias("value"))
    return a.union(b)


_RANKS = "ranks AS (SELECT p_key, row_number() OVER (ORDER BY count(*) DESC, p_key) - 1 AS r, count(*) OVER () AS n, count(*) AS cnt FROM keyed WHERE id % 3 > 0 GROUP BY 1), rk AS (SELECT p_key, cnt, r / (n - 1) AS rank_norm FROM ranks)"


def _ranks(spark, sf_dir):
    from netmine.operators import clusters

    counted = cells(spark, sf_dir).where("id % 3 > 0").groupBy("p_key").agg(F.count("*").alias("cnt"))
    return clusters.positions(counted, "cnt", "p_key")


@query(f"WITH {CELLS}, {_RANKS} SELECT id, round(coalesce(rank_norm, 1.0), 6) AS rank_norm FROM keyed LEFT JOIN rk USING (p_key)")
def q_rank_default(spark, sf_dir):
    return library.with_rank(cells(spark, sf_dir).select("id", "p_key"), _ranks(spark, sf_dir)).select("id", "rank_norm")


@query(f"WITH {CELLS}, {_RANKS}, a AS (SELECT id, p_key, count(*) OVER (PARTITION BY p_key) AS k FROM keyed WHERE area > 10) SELECT CAST(id AS VARCHAR) AS name, round(cnt / k, 6) AS count FROM a JOIN rk USING (p_key)")
def q_split_counts(spark, sf_dir):
    c = cells(spark, sf_dir).select(F.col("id").cast("string").alias("name"), "p_key", (F.col("area") > 10).alias("active"))
    return library.split_counts(_ranks(spark, sf_dir).select("p_key", F.col("cnt").alias("count")), c).select("name", F.round("count", 6).alias("count"))


@query(f"""WITH {CELLS}, {_RANKS}, c AS (SELECT DISTINCT 'P' || id || '_X' || drive AS name, p_key, id FROM keyed)
SELECT name, c.p_key, round(rank_norm, 6) AS rank_norm FROM c JOIN rk USING (p_key) WHERE id % 6 > 0 AND ends_with(name, '_X1') AND 2 + id % 4 BETWEEN 2 AND 4 ORDER BY rank_norm, name LIMIT 20""")
def q_candidates_by_rank(spark, sf_dir):
    c = cells(spark, sf_dir).select(F.concat(F.lit("P"), F.col("id").cast("string"), F.lit("_X"), F.col("drive").cast("string")).alias("name"), "p_key", (2 + F.col("id") % 4).alias("n_inputs"), "id")
    return library.candidates_by_rank(c, c.where("id % 6 = 0"), _ranks(spark, sf_dir), 2, 4, 20)


@query(f"""WITH {CELLS}, {_RANKS}, top AS (SELECT p_key FROM rk ORDER BY rank_norm, p_key LIMIT 5) SELECT 'P' || id AS name, p_key FROM keyed JOIN top USING (p_key) WHERE id % 7 > 0""")
def q_without_features(spark, sf_dir):
    c = cells(spark, sf_dir).select(F.concat(F.lit("P"), F.col("id").cast("string")).alias("name"), "p_key", "id")
    return library.without_features(_ranks(spark, sf_dir), c, c.where("id % 7 = 0"), 5)


@query(f"WITH {CELLS} SELECT p_key, arg_min('P' || id || '_X' || drive, ((drive <> 1)::INT, id % 4, area, 'P' || id || '_X' || drive)) AS name FROM keyed GROUP BY 1")
def q_preferred_match(spark, sf_dir):
    c = cells(spark, sf_dir).select(F.concat(F.lit("P"), F.col("id").cast("string"), F.lit("_X"), F.col("drive").cast("string")).alias("name"), "p_key", (F.col("id") % 4).alias("n_inputs"), "area")
    return library.preferred(c, "_X1")


@query("SELECT 'placed' AS what, p_name AS name FROM (SELECT p_name FROM part WHERE p_partkey % 2 = 0 INTERSECT SELECT p_name FROM part WHERE p_partkey % 3 = 0) UNION ALL SELECT 'usable', p_name FROM part WHERE p_name IN (SELECT p_name FROM part WHERE p_partkey % 2 = 0) AND p_name IN (SELECT p_name FROM part WHERE p_partkey % 3 = 0) AND p_partkey % 5 = 0")
def q_macro_lists(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"))
    a, b = p.where("p_partkey % 2 = 0"), p.where("p_partkey % 3 = 0")
    return library.placed_macros(a, b).select(F.lit("placed").alias("what"), "name").union(library.usable(p.where("p_partkey % 5 = 0"), a, b).select(F.lit("usable"), "name"))


@query("""WITH a AS (SELECT p_brand AS name, min(p_size) AS v FROM part WHERE p_partkey % 3 = 0 GROUP BY 1), b AS (SELECT p_type AS name, max(p_size) AS v FROM part GROUP BY 1 UNION ALL SELECT p_brand, max(p_size) FROM part GROUP BY 1)
SELECT 'append' AS what, name, v FROM (SELECT * FROM a UNION ALL SELECT * FROM b WHERE name NOT IN (SELECT name FROM a)) UNION ALL SELECT 'union', name, 0 FROM (SELECT name FROM a UNION SELECT name FROM b)
UNION ALL SELECT 'intersect', name, 0 FROM (SELECT name FROM a INTERSECT SELECT name FROM b) UNION ALL SELECT 'except', name, 0 FROM (SELECT name FROM b EXCEPT SELECT name FROM a)""")
def q_cell_sets(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    a = p.where("p_partkey % 3 = 0").groupBy(F.col("p_brand").alias("name")).agg(F.min("p_size").alias("v"))
    b = p.groupBy(F.col("p_type").alias("name")).agg(F.max("p_size").alias("v")).union(p.groupBy("p_brand").agg(F.max("p_size")))
    out = library.append_missing(a, b, "name").select(F.lit("append").alias("what"), "name", "v")
    for how, x, y in (("union", a, b), ("intersect", a, b), ("except", b, a)):
        out = out.union(library.combine(x, y, how).select(F.lit(how), "name", F.lit(0)))
    return out


# ---------------------------------------------------------------- checks


@query("""WITH c AS (SELECT p_name AS name, CASE p_partkey % 6 WHEN 0 THEN 'NaN' WHEN 1 THEN '-' || p_size WHEN 2 THEN p_size || '.5' WHEN 3 THEN 'x' ELSE CAST(p_size AS VARCHAR) END AS count FROM part),
v AS (SELECT name, try_cast(count AS DOUBLE) AS v FROM c)
SELECT 'no number' AS rule, count(*) FILTER (WHERE v IS NULL) AS n FROM v UNION ALL SELECT 'nan', count(*) FILTER (WHERE isnan(v)) FROM v UNION ALL SELECT 'negative', count(*) FILTER (WHERE v < 0) FROM v
UNION ALL SELECT 'not whole', count(*) FILTER (WHERE NOT isnan(v) AND v <> floor(v)) FROM v UNION ALL SELECT 'twice', count(*) FROM (SELECT name FROM v GROUP BY 1 HAVING count(*) > 1)""")
def q_bad_counts(spark, sf_dir):
    k = F.col("p_partkey") % 6
    size = F.col("p_size").cast("string")
    count = F.when(k == 0, "NaN").when(k == 1, F.concat(F.lit("-"), size)).when(k == 2, F.concat(size, F.lit(".5"))).when(k == 3, "x").otherwise(size)
    return checks.bad_counts(table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), count.alias("count")))


@query("""SELECT s_suppkey AS run, s_acctbal AS slack FROM supplier WHERE s_acctbal < -100""")
def q_bad_slack(spark, sf_dir):
    return checks.bad_slack(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("run"), F.col("s_acctbal").alias("slack")), ["slack"])


@query("""WITH f AS (SELECT s_nationkey AS run, 'f' || s_suppkey % 5 AS file FROM supplier), t AS (SELECT DISTINCT s_nationkey AS run FROM supplier WHERE s_suppkey % 4 = 0)
SELECT n_nationkey AS run, coalesce(string_agg(file, ',' ORDER BY file), '') AS missing, n_nationkey IN (SELECT run FROM t) AS finished FROM nation LEFT JOIN (SELECT n.n_nationkey AS run, x.file FROM nation n CROSS JOIN (VALUES ('f0'), ('f1'), ('f2')) x(file)
WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.run = n.n_nationkey AND f.file = x.file)) ON run = n_nationkey GROUP BY n_nationkey""")
def q_completeness(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    files = s.select(F.col("s_nationkey").alias("run"), F.concat(F.lit("f"), (F.col("s_suppkey") % 5).cast("string")).alias("file"))
    tails = s.select(F.col("s_nationkey").alias("run"), F.when(F.col("s_suppkey") % 4 == 0, "run: Exit status 0").otherwise("step").alias("value"))
    runs = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("run"))
    return checks.completeness(runs, files, ["f0", "f1", "f2"], tails, "Exit status 0")


@query("WITH u AS (SELECT DISTINCT p_brand AS name FROM part) SELECT name, CASE WHEN name IN (SELECT p_brand FROM part WHERE p_partkey % 40 = 0) THEN 'exact' ELSE 'missing' END AS status FROM u")
def q_library_mapping(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("name"), "p_partkey")
    return library.library_mapping(p, p.where("p_partkey % 40 = 0"))


@query("WITH n AS (SELECT count(*) AS n, count(*) FILTER (WHERE p_partkey % 7 = 0) AS differ FROM part WHERE p_partkey % 2 = 0) SELECT n, differ, round(differ / n, 6) AS share, differ / n <= 0.25 AS ok FROM n")
def q_vocabulary_agreement(spark, sf_dir):
    c = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("name"), "p_partkey", F.lit("0b01").alias("p_key"))
    other = c.where("p_partkey % 2 = 0").withColumn("p_key", F.when(F.col("p_partkey") % 7 == 0, "0b10").otherwise("0b01"))
    return library.vocabulary_agreement(c, other)


@query("SELECT md5(string_agg(md5(r_name), chr(10) ORDER BY r_regionkey)) AS stamp FROM region")
def q_content_stamp(spark, sf_dir):
    return checks.content_stamp(table(spark, sf_dir, "region").select(F.format_string("%05d", "r_regionkey").alias("path"), F.encode("r_name", "utf-8").alias("content")))


@query("""SELECT CAST(o_orderkey % 16 AS VARCHAR) AS part, count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS customers, CASE WHEN o_orderkey % 16 IN (3, 7) THEN 2 ELSE 1 END AS written FROM orders GROUP BY ALL""")
def q_incremental_parts(spark, sf_dir):
    """Orders by part, summed without those of part 3 and with other customers in part 7, and brought up to date: only these parts are made again."""
    orders = table(spark, sf_dir, "orders").select(F.pmod("o_orderkey", F.lit(16)).cast("string").alias("part"), "o_orderkey", "o_custkey")
    early = orders.where("part <> '3'").withColumn("o_custkey", F.when(F.col("part") == "7", F.col("o_custkey") + 1).otherwise(F.col("o_custkey")))
    folder = f"{shared_folder(spark)}/parts-{uuid.uuid4().hex}"
    for rows in (early, orders):
        versions.refresh(spark, folder, versions.digests(rows, "part"), lambda parts, rows=rows: rows.join(parts, "part").groupBy("part").agg(F.count("*").alias("n"), F.sum("o_custkey").alias("customers")))
    held = versions.manifest(spark, folder).select("part", "written")
    return versions.read(spark, folder).join(held, "part")


@query("""SELECT s_nationkey AS run, CASE WHEN bool_or(s_acctbal < 0) THEN 'BROKEN' ELSE 'OK' END AS status, coalesce(string_agg(DISTINCT 'check' || s_suppkey % 3, ',' ORDER BY 'check' || s_suppkey % 3) FILTER (WHERE s_acctbal < 0), '') AS why FROM supplier GROUP BY 1""")
def q_run_verdicts(spark, sf_dir):
    return checks.verdicts(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("run"), F.concat(F.lit("check"), (F.col("s_suppkey") % 3).cast("string")).alias("check"), (F.col("s_acctbal") < 0).alias("broken")))


# ---------------------------------------------------------------- sinks


@query(f"WITH {CELLS} SELECT '1,New,' || p_key || ',' || count(*) || ',\"a,b\"' AS value FROM keyed GROUP BY p_key")
def q_frequency_lines(spark, sf_dir):
    rows = cells(spark, sf_dir).groupBy("p_key").agg(F.count("*").alias("count"))
    return sinks.frequency_lines(rows.select(F.lit(1).alias("n_outputs"), F.lit("New").alias("label"), "p_key", "count", F.lit("a,b").alias("expr")))


@query(f"""WITH {CELLS}, k AS (SELECT p_key, count(*) AS n FROM keyed GROUP BY 1)
SELECT value FROM (SELECT unnest(['canonical_key=' || p_key, 'count=' || n]) AS value FROM k) UNION ALL SELECT unnest(['clst' || id || ': ' || list_sort([id, id + 1])[1] || ' ' || list_sort([id, id + 1])[2], 'inputs: a b', 'truth_table: ' || tt]) FROM keyed""")
def q_instance_blocks(spark, sf_dir):
    """Written as text to the shared folder and read back."""
    rows = cells(spark, sf_dir).select("p_key", F.col("id").alias("cluster"), F.array(F.col("id") + 1, F.col("id")).alias("cells"), F.array(F.lit("a"), F.lit("b")).alias("inputs"), "tt")
    path = _fresh(spark)
    sinks.write_instances(rows, path)
    return spark.read.text(path)


@query("SELECT 'clst' || p_partkey || ' clst' || p_partkey * 2 AS value FROM part UNION ALL SELECT string_agg('clst' || p_partkey, ' ' ORDER BY p_partkey) FROM part GROUP BY p_brand HAVING count(*) > 1")
def q_relation_lines(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return sinks.subset_lines(p.select(F.col("p_partkey").alias("sub"), (F.col("p_partkey") * 2).alias("sup"))).union(sinks.overlap_lines(p.select(F.col("p_partkey").alias("cluster"), F.col("p_brand").alias("component"))))


@query("SELECT p_partkey || ',' || p_name || ',' || coalesce(CASE WHEN p_partkey % 3 > 0 THEN p_type END, 'UNKNOWN') || ',' || CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS VARCHAR) ELSE 'NaN' END || ',' || CASE WHEN p_partkey % 5 = 0 THEN p_size || '.5' ELSE 'NaN' END AS value FROM part")
def q_cell_map_lines(spark, sf_dir):
    return sinks.cell_map_lines(table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 3 > 0, F.col("p_type")).alias("master"),
        F.when(F.col("p_partkey") % 2 == 0, F.col("p_size").cast("double")).alias("x"), F.when(F.col("p_partkey") % 5 == 0, F.col("p_size") + 0.5).otherwise(float("nan")).alias("y"),
    ))


@query("""SELECT '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","none":null}' AS value FROM nation UNION ALL SELECT 'set_lib_cell_purpose -exclude all [get_lib_cells */*]'
UNION ALL SELECT 'set _c [get_lib_cells -quiet {*/' || r_name || '}]' || chr(10) || 'if {[sizeof_collection $_c] == 0} { error "no cell matches ' || r_name || '" }' || chr(10) || 'set_lib_cell_purpose -include all $_c' FROM region""")
def q_text_sinks(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.lit(None).cast("string").alias("none"))
    lines = sinks.constraint_lines(table(spark, sf_dir, "region").select(F.col("r_name").alias("pattern")))
    return sinks.json_rows(n).union(lines.select("value"))


@query("SELECT 'nation' AS name, count(*) AS n FROM nation UNION ALL SELECT 'region', count(*) FROM region UNION ALL SELECT 'nation 7: ' || n_name, 1 FROM nation WHERE n_nationkey = 7")
def q_database(spark, sf_dir):
    """Two tables written as a database in the shared folder, read back, counted, and one row looked up."""
    path = _fresh(spark)
    sinks.write_database({t: table(spark, sf_dir, t) for t in ("nation", "region")}, path)
    db = sinks.read_database(spark, path, {"nation": "n_nationkey int, n_name string", "region": "r_regionkey int, r_name string"})
    found = sinks.lookup(db["nation"], "n_nationkey", 7)
    return sinks.summary(db).union(found.select(F.concat(F.lit("nation 7: "), F.col("n_name")), F.lit(1).cast("long")))


@query("SELECT p_name AS master_cell, CAST(p_partkey AS VARCHAR) AS count, p_size || '.5' AS selected_area FROM part ORDER BY p_partkey LIMIT 10")
def q_selected_candidates(spark, sf_dir):
    """A top-k report written as CSV and read back."""
    top = table(spark, sf_dir, "part").orderBy("p_partkey").limit(10)
    rows = top.select(
        F.col("p_name").alias("master_cell"), F.lit("s").alias("source_master_cell"), F.lit("p").alias("candidate_pattern"), F.lit("0b01").alias("canonical_key"), F.lit("A,B").alias("logic_expr"),
        F.col("p_partkey").alias("count"), (F.col("p_size") + 0.5).alias("selected_area"), F.lit("lib").alias("selected_lib"),
    )
    path = _fresh(spark)
    sinks.write_selected(rows, path)
    back = spark.read.option("header", True).option("enforceSchema", False).schema(", ".join(f"{c} string" for c in sinks.SELECTED)).csv(path)
    return back.select("master_cell", "count", "selected_area")
