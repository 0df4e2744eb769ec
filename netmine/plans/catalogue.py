"""Every operator as a query over the provided tables, with its SQL twin for DuckDB.

Readings of the tables:
  clusters  cluster = order, cell = part; the order's truth table has a 1 in row i
            if it holds a part with partkey % 8 = i (% 16 for four inputs)
  graph     cell = part p, driven by parts 2p and 2p + 1; gate by p_type,
            sequential cells are those of the least brand
  timing    cell type = event_type, path = user_id
  runs      design = region, run = nation
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netmine.functions import canonical, space, truth
from netmine.operators import clusters, demand, features, graph, grouping, search
from netmine.plans import cone_sql
from netmine.session import saved, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def reliable(spark: SparkSession):
    """Cuts lineage in the folder that the cluster shares."""
    return saved


# ---------------------------------------------------------------- SQL pieces


def pick_sql(b: str, rows: list[int]) -> str:
    return "concat(" + ", ".join(f"substr({b}, {r + 1}, 1)" for r in rows) + ")"


def forms_sql(b: str, n: int, masks, flips) -> list[str]:
    out = []
    for perm in itertools.permutations(range(n)):
        for m in masks:
            form = pick_sql(b, [r ^ m for r in space.permuted_rows(perm)])
            out += [f"translate({form}, '01', '10')" if f else form for f in flips]
    return out


P3 = "least(" + ", ".join(forms_sql("tt", 3, [0], [0])) + ")"
TT8 = "t AS (SELECT l_orderkey AS c, lpad(bin(bit_or(CAST(1 AS BIGINT) << CAST(7 - l_partkey % 8 AS INTEGER))), 8, '0') AS tt FROM lineitem GROUP BY 1)"
KEYED = f"{TT8}, k AS (SELECT c, tt, '0b' || {P3} AS p_key FROM t)"
MEMBERS = "m AS (SELECT DISTINCT l_orderkey AS c, l_partkey AS p FROM lineitem)"
LIBRARY = f"""lib AS (SELECT name, area, '0b' || {P3} AS p_key FROM (SELECT p_name AS name, p_size AS area, lpad(bin(p_partkey % 256), 8, '0') AS tt FROM part))"""
LABELS = "lab AS (SELECT p_key, arg_min(name, (area, name)) AS label FROM lib GROUP BY 1)"
POLARITY = "pol(p_key, np_key, ei, eo) AS (VALUES " + ", ".join(
    f"('0b{space.bits_of(r.p, 3)}', '0b{space.bits_of(r.np_, 3)}', {r.input_inverters}, {r.output_inverter})" for r in space.polarity_rows(3)
) + ")"
PAIRS = f"{MEMBERS}, pr AS (SELECT x.c AS a, y.c AS b, count(*) AS shared FROM m x JOIN m y ON x.p = y.p AND x.c < y.c GROUP BY 1, 2)"
BOTH = "bw AS (SELECT a, b FROM pr UNION ALL SELECT b, a FROM pr)"


# ---------------------------------------------------------------- shared inputs


def truth_tables(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("cluster"))
    return rows.agg(truth.from_members(F.col("l_partkey"), n).cast("long").alias("value"))


def keyed(spark: SparkSession, sf_dir: str, n: int = 3) -> DataFrame:
    """cluster, tt, p_key; the canonical form comes from the finite dimension."""
    rows = truth_tables(spark, sf_dir, n).join(space.p_dim(spark, n), "value")
    return rows.select("cluster", truth.bits_column(F.col("value"), n).alias("tt"), truth.key_column(F.col("p"), n).alias("p_key"))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.members(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey")


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_name", "p_size", F.pmod("p_partkey", F.lit(256)).cast("long").alias("value"))
    return parts.join(space.p_dim(spark, 3), "value").select(F.col("p_name").alias("name"), F.col("p_size").alias("area"), truth.key_column(F.col("p"), 3).alias("p_key"))


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.frequency(keyed(spark, sf_dir))


# ---------------------------------------------------------------- patterns


@query(f"WITH {KEYED}, {LIBRARY}, {LABELS} SELECT p_key, cnt, coalesce(label, 'New') AS label FROM (SELECT p_key, count(*) AS cnt FROM k GROUP BY 1) LEFT JOIN lab USING (p_key)")
def q_pattern_frequency(spark, sf_dir):
    return clusters.frequency(keyed(spark, sf_dir), library(spark, sf_dir))


@query(f"""WITH {KEYED}, {POLARITY}, f AS (SELECT p_key, count(*) AS cnt FROM k GROUP BY 1),
best AS (SELECT p_key, np_key FROM pol QUALIFY ei + eo = min(ei + eo) OVER (PARTITION BY p_key)),
r AS (SELECT coalesce(np_key, f.p_key) AS np_key, CAST(sum(cnt) AS BIGINT) AS cnt FROM f LEFT JOIN (SELECT DISTINCT * FROM best) b ON b.p_key = f.p_key GROUP BY 1)
SELECT np_key, cnt, row_number() OVER (ORDER BY cnt DESC, np_key) - 1 AS rank_no,
  CASE WHEN count(*) OVER () > 1 THEN round((row_number() OVER (ORDER BY cnt DESC, np_key) - 1) / (count(*) OVER () - 1), 6) ELSE 0.0 END AS rank_norm FROM r""")
def q_pattern_rank(spark, sf_dir):
    return clusters.positions(clusters.roll_up(counts(spark, sf_dir), space.polarity_dim(spark, 3)), "cnt", "np_key")


@query(f"""WITH {KEYED}, {LIBRARY}, {LABELS}, {POLARITY}, f AS (SELECT p_key, count(*) AS cnt FROM k GROUP BY 1),
j AS (SELECT f.p_key, cnt, np_key, coalesce(label, np_key) AS grp FROM f JOIN pol USING (p_key) LEFT JOIN lab ON lab.p_key = np_key),
o AS (SELECT p_key, cnt, grp, min(np_key) AS np_key FROM j GROUP BY 1, 2, 3)
SELECT grp, min(np_key) AS np_key, CAST(sum(cnt) AS BIGINT) AS cnt, count(*) AS n_classes FROM o GROUP BY 1""")
def q_pmnpn_rollup(spark, sf_dir):
    labels = clusters.frequency(library(spark, sf_dir).select("p_key"), library(spark, sf_dir)).select("p_key", "label")
    return clusters.grouped_roll_up(counts(spark, sf_dir), space.polarity_dim(spark, 3), labels)


def _forms(kind: str):
    def run(spark, sf_dir):
        rows = truth_tables(spark, sf_dir, 3).groupBy("value").agg(F.count("*").alias("cnt")).join(space.function_dim(spark, 3), "value")
        return rows.groupBy(truth.key_column(F.col(kind), 3).alias("key")).agg(F.sum("cnt").alias("cnt"), F.count("*").alias("n_functions"))

    return run


for _name, _kind, _forms_sql in (
    ("q_p_canonical_n3", "p", P3),
    ("q_npn_canonical_n3", "npn", "greatest(" + ", ".join(forms_sql("tt", 3, range(8), [0, 1])) + ")"),
    ("q_np_canonical_n3", "np", "greatest(" + ", ".join(forms_sql("tt", 3, range(8), [0])) + ")"),
    ("q_npn_no_full_neg_n3", "npn_no_full", "greatest(" + ", ".join(forms_sql("tt", 3, range(7), [0, 1])) + ")"),
):
    QUERIES[_name] = _forms(_kind)
    SQL[_name] = f"WITH {TT8} SELECT '0b' || {_forms_sql} AS key, CAST(sum(n) AS BIGINT) AS cnt, count(*) AS n_functions FROM (SELECT tt, count(*) AS n FROM t GROUP BY 1) GROUP BY 1"


@query(f"""WITH t AS (SELECT l_orderkey AS c, lpad(bin(bit_or(CAST(1 AS BIGINT) << CAST(15 - l_partkey % 16 AS INTEGER))), 16, '0') AS tt FROM lineitem GROUP BY 1)
SELECT '0b' || least({", ".join(forms_sql("tt", 4, [0], [0]))}) AS p_key, CAST(sum(n) AS BIGINT) AS cnt FROM (SELECT tt, count(*) AS n FROM t GROUP BY 1) GROUP BY 1""")
def q_p_canonical_n4(spark, sf_dir):
    return clusters.frequency(keyed(spark, sf_dir, 4))


def _rows_sql(n: int, masks) -> str:
    """Every permutation and mask of n inputs as the list of rows that it reads."""
    return f"w(g) AS (VALUES " + ", ".join("([" + ", ".join(str((r ^ m) + 1) for r in space.permuted_rows(p)) + "])" for p in itertools.permutations(range(n)) for m in masks) + ")"


def _wide_sql(group: str, member: str, n: int, where: str = "true") -> str:
    return f"t AS (SELECT {group} AS c, lpad(bin(bit_or(CAST(1 AS BIGINT) << CAST({(1 << n) - 1} - {member} % {1 << n} AS INTEGER))), {1 << n}, '0') AS tt FROM lineitem WHERE {where} GROUP BY 1), d AS (SELECT tt, count(*) AS n FROM t GROUP BY 1)"


_THIRDS = "l_linenumber = 3 AND l_returnflag = 'R'"
_PICKED = "array_to_string(list_transform(g, lambda r: substr(tt, r, 1)), '')"


@query(f"""WITH {_wide_sql("l_partkey", "l_orderkey", 5)}, {_rows_sql(5, [0])}, f AS (SELECT tt, n, min({_PICKED}) AS p FROM d, w GROUP BY 1, 2)
SELECT '0b' || p AS p_key, CAST(sum(n) AS BIGINT) AS cnt, count(*) AS n_functions FROM f GROUP BY 1""")
def q_p_canonical_n5(spark, sf_dir):
    """Five inputs: a part's function has a 1 in row i if an order with orderkey % 32 = i holds the part."""
    return _wide_forms(spark, sf_dir, "l_partkey", "l_orderkey", "p").withColumnRenamed("key", "p_key")


def _wide_forms(spark, sf_dir, group: str, member: str, kind: str, where: str = "true") -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").where(where).groupBy(group).agg(canonical.members_table(F.col(member), 5).alias("tt"))
    met = saved(rows.groupBy("tt").agg(F.count("*").alias("n")))
    formed = met.join(canonical.classes(met, "tt", (kind,)), "tt")
    return formed.groupBy(F.concat(F.lit("0b"), kind).alias("key")).agg(F.sum("n").alias("cnt"), F.count("*").alias("n_functions"))


@query(f"""WITH {_wide_sql("l_suppkey", "l_orderkey", 5, _THIRDS)}, {_rows_sql(5, range(32))}, f AS (SELECT tt, n, max(greatest({_PICKED}, translate({_PICKED}, '01', '10'))) AS p FROM d, w GROUP BY 1, 2)
SELECT '0b' || p AS key, CAST(sum(n) AS BIGINT) AS cnt, count(*) AS n_functions FROM f GROUP BY 1""")
def q_npn_canonical_n5(spark, sf_dir):
    """Five inputs: a supplier's function has a 1 in row i if an order with orderkey % 32 = i returned its third line, delivered by the supplier."""
    return _wide_forms(spark, sf_dir, "l_suppkey", "l_orderkey", "npn", _THIRDS)


@query(f"""WITH x AS ({{}}), y AS ({{}}), j AS (SELECT a, b, count(*) AS n FROM x JOIN y USING (c) GROUP BY 1, 2), {_rows_sql(5, [0])},
f AS (SELECT a, b, n, min(least(p, q) || ';' || greatest(p, q)) AS joint_key FROM (SELECT a, b, n, {_PICKED.replace('tt', 'a')} AS p, {_PICKED.replace('tt', 'b')} AS q FROM j, w) GROUP BY 1, 2, 3)
SELECT joint_key, CAST(sum(n) AS BIGINT) AS cnt FROM f GROUP BY 1""".format(
    f"SELECT l_suppkey AS c, lpad(bin(bit_or(CAST(1 AS BIGINT) << CAST(31 - l_orderkey % 32 AS INTEGER))), 32, '0') AS a FROM lineitem WHERE {_THIRDS} GROUP BY 1",
    "SELECT l_suppkey AS c, lpad(bin(bit_or(CAST(1 AS BIGINT) << CAST(31 - l_linenumber * l_quantity % 32 AS INTEGER))), 32, '0') AS b FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1",
))
def q_joint_canonical_n5(spark, sf_dir):
    """Two functions of five inputs for each supplier under one permutation: of the orders of `q_npn_canonical_n5`, and of its returned quantities by line."""
    rows = table(spark, sf_dir, "lineitem")
    a = rows.where(_THIRDS).groupBy("l_suppkey").agg(canonical.members_table(F.col("l_orderkey"), 5).alias("a"))
    b = rows.where("l_returnflag = 'R'").groupBy("l_suppkey").agg(canonical.members_table((F.col("l_linenumber") * F.col("l_quantity")).cast("long"), 5).alias("b"))
    met = saved(a.join(b, "l_suppkey").groupBy(F.array("a", "b").alias("outputs")).agg(F.count("*").alias("n")))
    return met.join(canonical.joint_classes(met), "outputs").groupBy(F.col("joint").alias("joint_key")).agg(F.sum("n").alias("cnt"))


_SWAP = space.permuted_rows((1, 0))
_SPLIT_SQL = """t AS (SELECT l_orderkey AS c, lpad(bin(coalesce(bit_or(CASE WHEN l_returnflag = 'R' THEN CAST(1 AS BIGINT) << CAST(3 - l_partkey % 4 AS INTEGER) END), 0)), 4, '0') AS x,
lpad(bin(coalesce(bit_or(CASE WHEN l_returnflag <> 'R' THEN CAST(1 AS BIGINT) << CAST(3 - l_partkey % 4 AS INTEGER) END), 0)), 4, '0') AS y FROM lineitem GROUP BY 1)"""


def _two_tables(spark, sf_dir):
    bit = F.call_function("shiftleft", F.lit(1), (F.lit(3) - F.pmod("l_partkey", F.lit(4))).cast("int"))
    part = lambda test: F.lpad(F.bin(F.coalesce(F.bit_or(F.when(test, bit)), F.lit(0)).cast("long")), 4, "0")
    returned = F.col("l_returnflag") == "R"
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("c")).agg(part(returned).alias("x"), part(~returned).alias("y"))


@query(f"""WITH {_SPLIT_SQL} SELECT least(least(x, y) || ';' || greatest(x, y), least({pick_sql('x', _SWAP)}, {pick_sql('y', _SWAP)}) || ';' || greatest({pick_sql('x', _SWAP)}, {pick_sql('y', _SWAP)})) AS joint_key,
count(*) AS cnt FROM t GROUP BY 1""")
def q_joint_canonical(spark, sf_dir):
    return _two_tables(spark, sf_dir).groupBy(truth.joint_canonical([F.col("x"), F.col("y")], 2).alias("joint_key")).agg(F.count("*").alias("cnt"))


@query(f"""WITH {_SPLIT_SQL} SELECT x AS tt, concat(substr(x,1,1),substr(x,1,1),substr(x,2,1),substr(x,2,1),substr(x,3,1),substr(x,3,1),substr(x,4,1),substr(x,4,1)) AS abc,
concat(x, x) AS cab, concat(substr(x,1,1),substr(x,1,1),substr(x,3,1),substr(x,3,1),substr(x,2,1),substr(x,2,1),substr(x,4,1),substr(x,4,1)) AS bac, count(*) AS cnt FROM t GROUP BY x""")
def q_tt_expand(spark, sf_dir):
    x = F.col("x")
    return _two_tables(spark, sf_dir).groupBy(x.alias("tt")).agg(F.count("*").alias("cnt")).select(
        "tt", truth.expand(F.col("tt"), ["A", "B"], ["A", "B", "C"]).alias("abc"), truth.expand(F.col("tt"), ["A", "B"], ["C", "A", "B"]).alias("cab"),
        truth.expand(F.col("tt"), ["A", "B"], ["B", "A", "C"]).alias("bac"), "cnt",
    )


def _depends(i: int) -> str:
    bit = 1 << (2 - i)
    rows = [a for a in range(8) if not a & bit]
    return f"{pick_sql('tt', rows)} <> {pick_sql('tt', [a | bit for a in rows])}"


@query(f"""WITH {TT8}, d AS (SELECT tt, {_depends(0)} AS a, {_depends(1)} AS b, {_depends(2)} AS c3 FROM t)
SELECT CASE WHEN tt = '00000000' THEN '0' WHEN tt = '11111111' THEN '1' WHEN a AND b AND c3 THEN tt
 WHEN a AND b THEN {pick_sql('tt', [0, 2, 4, 6])} WHEN a AND c3 THEN {pick_sql('tt', [0, 1, 4, 5])} WHEN b AND c3 THEN {pick_sql('tt', [0, 1, 2, 3])}
 WHEN a THEN {pick_sql('tt', [0, 4])} WHEN b THEN {pick_sql('tt', [0, 2])} ELSE {pick_sql('tt', [0, 1])} END AS reduced, count(*) AS cnt FROM d GROUP BY 1""")
def q_arity_reduce(spark, sf_dir):
    tt = truth_tables(spark, sf_dir, 3).groupBy("value").agg(F.count("*").alias("cnt")).select(truth.bits_column(F.col("value"), 3).alias("tt"), "cnt")
    return tt.groupBy(truth.reduce_arity(F.col("tt"), 3).alias("reduced")).agg(F.sum("cnt").alias("cnt"))


def _bit(a: int) -> str:
    return f"CAST(substr(tt, {a + 1}, 1) AS INTEGER)"


_DEGREE = "greatest(0, " + ", ".join(f"CASE WHEN ({' + '.join(_bit(a) for a in range(8) if a & s == a)}) % 2 = 1 THEN {s.bit_count()} ELSE 0 END" for s in range(1, 8)) + ")"
_COVERS = [(a, a | 1 << i) for a in range(8) for i in range(3) if not a >> i & 1]
_UP, _DOWN = (" AND ".join(f"{_bit(a)} {op} {_bit(b)}" for a, b in _COVERS) for op in ("<=", ">="))
_SYM = " AND ".join([f"{_bit(1)} = {_bit(2)}", f"{_bit(1)} = {_bit(4)}", f"{_bit(3)} = {_bit(5)}", f"{_bit(3)} = {_bit(6)}"])
_NEG = " + ".join("CAST((" + " AND ".join(f"{_bit(a)} >= {_bit(b)}" for a, b in _COVERS if a ^ b == bit) + ") AS INTEGER)" for bit in (1, 2, 4))


def _functions(spark, sf_dir):
    rows = truth_tables(spark, sf_dir, 3).groupBy("value").agg(F.count("*").alias("cnt"))
    return rows.select(truth.bits_column(F.col("value"), 3).alias("tt"), "cnt")


@query(f"""WITH {TT8} SELECT tt, count(*) AS cnt, length(replace(tt, '0', '')) / 8.0 AS weight, {_DEGREE} AS degree, {_DEGREE} <= 1 AS is_affine, {_SYM} AS is_symmetric,
{_UP} AS is_monotone, {_DOWN} AS is_anti_monotone, {_NEG} AS negative_inputs FROM t GROUP BY tt""")
def q_tt_features(spark, sf_dir):
    b = F.col("tt")
    return _functions(spark, sf_dir).select(
        "tt", "cnt", truth.weight(b).alias("weight"), truth.anf_degree(b, 3).alias("degree"), (truth.anf_degree(b, 3) <= 1).alias("is_affine"),
        truth.symmetric(b, 3).alias("is_symmetric"), truth.monotone(b, 3).alias("is_monotone"), truth.anti_monotone(b, 3).alias("is_anti_monotone"),
        truth.negative_inputs(b, 3).alias("negative_inputs"),
    )


_CLASS = f"""CASE tt WHEN '00000000' THEN 'CONST0' WHEN '11111111' THEN 'CONST1' WHEN '00000001' THEN 'AND' WHEN '11111110' THEN 'NAND' WHEN '01111111' THEN 'OR'
WHEN '10000000' THEN 'NOR' WHEN '01101001' THEN 'XOR' WHEN '10010110' THEN 'XNOR' WHEN '00010111' THEN 'MAJ' WHEN '11101000' THEN 'MAJI'
ELSE CASE WHEN {_UP} THEN 'AO_OR_OA' WHEN {_DOWN} THEN 'AOI_OR_OAI' ELSE '' END END"""
_FET = """CASE WHEN cls IN ('CONST0', 'CONST1') THEN 0 WHEN cls IN ('NAND', 'NOR', 'AOI_OR_OAI') THEN 6 WHEN cls IN ('AND', 'OR', 'AO_OR_OA') THEN 8
WHEN cls IN ('XOR', 'XNOR') THEN 18 WHEN cls = 'MAJ' THEN 12 WHEN cls = 'MAJI' THEN 10 END"""


@query(f"WITH {TT8} SELECT {_CLASS} AS cls, count(*) AS cnt, count(DISTINCT tt) AS n_functions FROM t GROUP BY 1")
def q_function_class(spark, sf_dir):
    rows = _functions(spark, sf_dir).select(truth.function_class(F.col("tt"), 3).alias("cls"), "cnt")
    return rows.groupBy("cls").agg(F.sum("cnt").alias("cnt"), F.count("*").alias("n_functions"))


@query(f"""WITH {TT8}, c AS (SELECT tt, {_CLASS} AS cls, count(*) AS cnt FROM t GROUP BY 1) SELECT tt, cls, cnt, coalesce({_FET}, -1) AS fet,
CASE WHEN cls IN ('AND', 'OR', 'AO_OR_OA', 'MAJ') THEN 1 WHEN cls <> '' THEN 0 ELSE -1 END AS out_inverters, coalesce(greatest(0, 2 * 6 + 2 * 1 - ({_FET})), 0) AS delta_two_nand FROM c""")
def q_fet_cost(spark, sf_dir):
    rows = _functions(spark, sf_dir).withColumn("cls", truth.function_class(F.col("tt"), 3))
    fet = truth.fet_cost(F.col("cls"), F.lit(3))
    delta = F.when(fet.isNotNull(), truth.delta_fet(F.lit(6), F.lit(2), F.lit(1), fet)).otherwise(0)
    return rows.select("tt", "cls", "cnt", F.coalesce(fet, F.lit(-1)).alias("fet"), F.coalesce(truth.output_inverters(F.col("cls")), F.lit(-1)).alias("out_inverters"), delta.alias("delta_two_nand"))


_TERMS = ", ".join(
    f"CASE WHEN substr(tt, {a + 1}, 1) = '1' THEN '" + "*".join(("" if a >> (2 - i) & 1 else "!") + f"A{i + 1}" for i in range(3)) + "' END" for a in range(8)
)


@query(f"""WITH {TT8}, f AS (SELECT tt, list_sum([{", ".join(f"{_bit(a)} * {1 << (7 - a)}" for a in range(8))}]) AS v, count(*) AS cnt FROM t GROUP BY tt)
SELECT tt, '8#0x' || lpad(hex(CAST(v AS UTINYINT)), 2, '0') AS hex_key, '0b' || tt AS bin_key, '3input0x' || lower(ltrim(hex(CAST(v AS UTINYINT)), '0')) || CASE WHEN v = 0 THEN '0' ELSE '' END || '_X1' AS cell_name,
CASE WHEN v = 0 THEN '0' WHEN v = 255 THEN '1' ELSE concat_ws(' + ', {_TERMS}) END AS sop, cnt FROM f""")
def q_key_codec(spark, sf_dir):
    b = F.col("tt")
    return _functions(spark, sf_dir).select(
        "tt", truth.hex_key(b, 3).alias("hex_key"), F.concat(F.lit("0b"), b).alias("bin_key"), truth.cell_name(b, 3).alias("cell_name"), truth.minterms(b, 3).alias("sop"), "cnt"
    )


@query(f"""WITH {KEYED}, {LIBRARY}, {LABELS}, f AS (SELECT p_key, count(*) AS cnt FROM k GROUP BY 1),
i AS (SELECT p_key, cnt, '0b' || {P3.replace("tt", "translate(substr(p_key, 3), '01', '10')")} AS inverse FROM f)
SELECT i.p_key, cnt, inverse, coalesce(a.label, b.label, 'New') AS label, CASE WHEN a.label IS NULL AND b.label IS NOT NULL THEN 1 ELSE 0 END AS out_inverter
FROM i LEFT JOIN lab a ON a.p_key = i.p_key LEFT JOIN lab b ON b.p_key = inverse""")
def q_bit_inverse_fallback(spark, sf_dir):
    labels = library(spark, sf_dir).groupBy("p_key").agg(F.min_by("name", F.struct("area", "name")).alias("label"))
    rows = counts(spark, sf_dir).withColumn("inverse", F.concat(F.lit("0b"), truth.p_canonical(truth.complement(F.substring("p_key", 3, 8)), 3)))
    both = rows.join(labels.toDF("p_key", "own"), "p_key", "left").join(labels.toDF("inverse", "other"), "inverse", "left")
    return both.select("p_key", "cnt", "inverse", F.coalesce("own", "other", F.lit("New")).alias("label"), F.when(F.col("own").isNull() & F.col("other").isNotNull(), 1).otherwise(0).alias("out_inverter"))


@query(f"WITH t AS (SELECT DISTINCT lpad(bin(p_partkey % 256), 8, '0') AS tt FROM part) SELECT '0b' || {P3} AS p_key, count(*) AS n_functions, min(tt) AS least_tt, max(tt) AS greatest_tt FROM t GROUP BY 1")
def q_function_space(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(truth.bits_column(F.pmod("p_partkey", F.lit(256)), 3).alias("tt")).distinct()
    return rows.groupBy(F.concat(F.lit("0b"), truth.p_canonical(F.col("tt"), 3)).alias("p_key")).agg(
        F.count("*").alias("n_functions"), F.min("tt").alias("least_tt"), F.max("tt").alias("greatest_tt")
    )


# ---------------------------------------------------------------- relations between clusters


@query(f"""WITH {PAIRS}, s AS (SELECT c, count(*) AS n FROM m GROUP BY 1)
SELECT a, b, shared, round(shared / (x.n + y.n - shared), 6) AS jaccard FROM pr JOIN s x ON x.c = a JOIN s y ON y.c = b""")
def q_cluster_overlap_pairs(spark, sf_dir):
    pairs = clusters.overlap_pairs(saved(clusters.sized(members(spark, sf_dir))), saved)
    return pairs.select("a", "b", "shared", clusters.jaccard(pairs).alias("jaccard"))


@query(f"""WITH {PAIRS}, s AS (SELECT c, count(*) AS n FROM m GROUP BY 1)
SELECT CASE WHEN x.n < y.n THEN a ELSE b END AS sub, CASE WHEN x.n < y.n THEN b ELSE a END AS sup FROM pr JOIN s x ON x.c = a JOIN s y ON y.c = b WHERE x.n <> y.n AND shared = least(x.n, y.n)""")
def q_cluster_subset_pairs(spark, sf_dir):
    return clusters.contained(members(spark, sf_dir), saved)


@query("""WITH RECURSIVE m AS MATERIALIZED (SELECT DISTINCT l_orderkey AS c, l_partkey * 100 + l_suppkey % 100 AS p FROM lineitem),
e AS MATERIALIZED (SELECT DISTINCT x.c AS a, y.c AS b FROM m x JOIN m y USING (p) WHERE x.c <> y.c),
r(cluster, component) USING KEY (cluster) AS (SELECT DISTINCT c, c FROM m UNION SELECT e.b, min(r.component) FROM r JOIN e ON e.a = r.cluster JOIN recurring.r AS o ON o.cluster = e.b WHERE r.component < o.component GROUP BY e.b)
SELECT cluster, component FROM r""")
def q_overlap_components(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("cluster"), (F.col("l_partkey") * 100 + F.pmod("l_suppkey", F.lit(100))).alias("cell"))
    return clusters.components(rows, reliable(spark))


@query(f"""WITH {KEYED}, {PAIRS}, {BOTH}, d AS (SELECT a, count(*) AS n FROM bw GROUP BY 1)
SELECT p_key, round(sum(1.0 / (1 + coalesce(n, 0))), 6) AS weighted, count(*) AS cnt FROM k LEFT JOIN d ON a = c GROUP BY 1""")
def q_overlap_weighted_count(spark, sf_dir):
    return clusters.weighted_counts(clusters.neighbour_counts(members(spark, sf_dir), saved), keyed(spark, sf_dir))


@query(f"""WITH {KEYED}, {PAIRS}, {BOTH}, n AS (SELECT p_key, count(*) AS n FROM k GROUP BY 1),
x AS (SELECT ka.p_key AS key_a, kb.p_key AS key_b, count(DISTINCT a) AS t FROM bw JOIN k ka ON ka.c = a JOIN k kb ON kb.c = b WHERE ka.p_key <> kb.p_key GROUP BY 1, 2)
SELECT key_a, key_b, round(t / n, 6) AS overlap_ratio FROM x JOIN n ON p_key = key_a""")
def q_overlap_ratio(spark, sf_dir):
    return clusters.overlap_ratio(members(spark, sf_dir), keyed(spark, sf_dir))


@query(f"""WITH {KEYED}, {MEMBERS}, n AS (SELECT p_key, count(*) AS n FROM k GROUP BY 1)
SELECT k.p_key, p_brand AS master, round(count(DISTINCT k.c) / any_value(n), 6) AS m1, round(count(*) / any_value(n), 6) AS m2
FROM m JOIN part ON p_partkey = p JOIN k ON k.c = m.c JOIN n ON n.p_key = k.p_key GROUP BY 1, 2""")
def q_edge_features(spark, sf_dir):
    master = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("cell"), F.col("p_brand").alias("master"))
    return clusters.presence(saved(members(spark, sf_dir)), keyed(spark, sf_dir), master)


_TOP = "top AS (SELECT p_key FROM k GROUP BY 1 ORDER BY count(*) DESC, p_key LIMIT 1)"


@query(f"""WITH {KEYED}, {PAIRS}, {BOTH}, {_TOP}, x AS (SELECT a, kb.p_key, count(*) AS n FROM bw JOIN k ka ON ka.c = a JOIN top ON top.p_key = ka.p_key JOIN k kb ON kb.c = b
WHERE kb.p_key <> ka.p_key GROUP BY 1, 2) SELECT p_key, max(n) AS max_overlap FROM x GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""")
def q_secondary_overlap_topk(spark, sf_dir):
    k = keyed(spark, sf_dir)
    top = clusters.frequency(k).orderBy(F.col("cnt").desc(), "p_key").limit(1)
    return clusters.secondary(members(spark, sf_dir), k, top, 5, saved)


@query(f"""WITH {KEYED}, {LIBRARY}, a AS (SELECT p_key, count(*) AS n FROM lib GROUP BY 1), b AS (SELECT p_key, count(*) AS n FROM k GROUP BY 1)
SELECT coalesce(a.p_key, b.p_key) AS p_key, coalesce(a.n, 0) + coalesce(b.n, 0) AS total, coalesce(a.n, 0) AS single_cell, coalesce(b.n, 0) AS multi_cell FROM a FULL JOIN b ON a.p_key = b.p_key""")
def q_logic_coverage(spark, sf_dir):
    return clusters.coverage(library(spark, sf_dir), keyed(spark, sf_dir))


@query(f"""WITH {KEYED}, {LIBRARY}, {LABELS}, {PAIRS}, {BOTH}, anchor AS (SELECT p_key FROM k JOIN lab USING (p_key) GROUP BY 1 ORDER BY count(*) DESC, p_key LIMIT 1),
x AS (SELECT kb.p_key, count(DISTINCT b) AS n FROM bw JOIN k ka ON ka.c = a JOIN anchor ON anchor.p_key = ka.p_key JOIN k kb ON kb.c = b JOIN lab l ON l.p_key = kb.p_key WHERE kb.p_key <> ka.p_key GROUP BY 1)
SELECT 'anchor' AS kind, p_key, label, (SELECT count(*) FROM k WHERE k.p_key = anchor.p_key) AS cnt FROM anchor JOIN lab USING (p_key)
UNION ALL SELECT 'overlap', p_key, label, n FROM (SELECT * FROM x ORDER BY n DESC, p_key LIMIT 2) JOIN lab USING (p_key)""")
def q_select_candidates(spark, sf_dir):
    labels = library(spark, sf_dir).groupBy("p_key").agg(F.min_by("name", F.struct("area", "name")).alias("label"))
    return clusters.select_candidates(keyed(spark, sf_dir), labels, members(spark, sf_dir), 2)


@query(f"WITH {KEYED} SELECT count(*) AS total, count(DISTINCT p_key) AS patterns FROM k")
def q_total_occurrences(spark, sf_dir):
    return clusters.totals(counts(spark, sf_dir))


@query(f"WITH {KEYED} SELECT p_key, count(*) AS cnt FROM k GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def q_top_patterns(spark, sf_dir):
    return clusters.top(counts(spark, sf_dir), 10)


@query(f"""WITH {MEMBERS} SELECT c AS cluster, count(*) AS n_cells, CAST(sum(p_size) AS BIGINT) AS total_area, count(DISTINCT p_brand) AS n_masters,
CAST(max(p_size) AS BIGINT) AS max_area FROM m JOIN part ON p_partkey = p GROUP BY 1""")
def q_cluster_attributes(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("cell"), F.col("p_size").alias("area"), F.col("p_brand").alias("master"))
    return clusters.attributes(saved(members(spark, sf_dir)), part)


# ---------------------------------------------------------------- multi-output grouping
# place = order; output = line status and flag; input = part; cell = supplier


def _outputs(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", "p_size")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus").join(part, F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy(F.col("l_orderkey").alias("grp"), F.concat("l_returnflag", "l_linestatus").alias("out")).agg(
        F.array_sort(F.collect_set(F.pmod("l_partkey", F.lit(4)))).alias("inputs"), F.array_sort(F.collect_set(F.pmod("l_suppkey", F.lit(6)))).alias("cells"),
        F.min("p_retailprice").alias("lo_x"), F.max("p_retailprice").alias("hi_x"), F.min("p_size").alias("lo_y"), F.max("p_size").alias("hi_y"),
    )


_OUTPUTS_SQL = """o AS MATERIALIZED (SELECT l_orderkey AS grp, l_returnflag || l_linestatus AS out, list_sort(list_distinct(list(l_partkey % 4))) AS i, list_sort(list_distinct(list(l_suppkey % 6))) AS c,
min(p_retailprice) AS lx, max(p_retailprice) AS hx, min(p_size) AS ly, max(p_size) AS hy FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2),
x AS MATERIALIZED (SELECT a.grp, a.out AS out_a, b.out AS out_b, len(list_intersect(a.i, b.i)) AS ki, len(list_intersect(a.c, b.c)) AS kc, len(list_distinct(list_concat(a.i, b.i))) AS ui,
len(list_distinct(list_concat(a.c, b.c))) AS uc, a.i = b.i AS same, sqrt(pow(greatest(a.hx, b.hx) - least(a.lx, b.lx), 2) + pow(greatest(a.hy, b.hy) - least(a.ly, b.ly), 2)) AS span
FROM o a JOIN o b ON a.grp = b.grp AND a.out < b.out)"""
_PAIR_COLS = "grp, out_a, out_b, ki AS shared_inputs, kc AS shared_cells, round(ki / ui, 6) AS input_overlap, round(kc / uc, 6) AS cell_overlap"


@query(f"WITH {_OUTPUTS_SQL} SELECT {_PAIR_COLS} FROM x WHERE ki >= 1 AND kc >= 1 AND ui <= 6 AND span <= 500")
def q_pair_grouping_shared(spark, sf_dir):
    return grouping.pairs(_outputs(spark, sf_dir), "shared", span=500.0)


@query(f"""WITH {_OUTPUTS_SQL}, p AS MATERIALIZED (SELECT grp || ':' || out_a AS ka, grp || ':' || out_b AS kb, out_b AS o FROM x WHERE ki >= 1 AND kc >= 1 AND ui <= 6),
t AS MATERIALIZED (SELECT p.ka || '|' || q.kb AS ac, q.ka || '|' || q.kb AS bc, p.ka || '|' || p.kb AS ab, q.kb AS kc, p.ka AS ka, p.kb AS kb FROM p JOIN p q ON q.ka = p.kb),
e AS MATERIALIZED (SELECT ka || '|' || kb AS ends FROM p), f AS MATERIALIZED (SELECT t.ka, t.kb, t.kc FROM t JOIN e ON e.ends = t.ac)
SELECT count(*) AS n_quadruples FROM (SELECT f.ka || '|' || p.kb AS ad, f.kb || '|' || p.kb AS bd FROM f JOIN p ON p.ka = f.kc) g JOIN e ON e.ends = g.ad JOIN e e2 ON e2.ends = g.bd""")
def q_quadruple_count(spark, sf_dir):
    """Number of sets of four outputs of one place in which every two pair up."""
    return grouping.tuples(grouping.pairs(_outputs(spark, sf_dir), "shared"), 4, saved).agg(F.count("*").alias("n_quadruples"))


@query(f"WITH {_OUTPUTS_SQL} SELECT {_PAIR_COLS} FROM x WHERE same AND ki >= 1 AND kc >= 0 AND ui <= 6")
def q_pair_grouping_exact(spark, sf_dir):
    return grouping.pairs(_outputs(spark, sf_dir), "exact", least_shared_cells=0)


@query(f"""WITH {_OUTPUTS_SQL}, p AS MATERIALIZED (SELECT grp, out_a, out_b, grp || ':' || out_a AS ka, grp || ':' || out_b AS kb, round(ki / ui, 6) AS s FROM x WHERE ki >= 1 AND kc >= 0 AND ui <= 6),
w AS MATERIALIZED (SELECT p.grp, p.out_a AS a, p.out_b AS b, q.out_b AS c, p.s + q.s AS s, p.ka || '|' || q.kb AS ends FROM p JOIN p q ON q.ka = p.kb),
r AS MATERIALIZED (SELECT ka || '|' || kb AS ends, s FROM p)
SELECT grp, a, b, c, round((w.s + r.s) / 3, 6) AS mean_overlap FROM w JOIN r USING (ends)""")
def q_triple_grouping(spark, sf_dir):
    return grouping.triples(grouping.pairs(_outputs(spark, sf_dir), "shared", least_shared_cells=0), saved)


@query(f"""WITH {_OUTPUTS_SQL}, k AS (SELECT least(out_a, out_b) AS key_a, greatest(out_a, out_b) AS key_b, round(ki / ui, 6) AS i, round(kc / uc, 6) AS c FROM x WHERE ki >= 1 AND kc >= 1 AND ui <= 6)
SELECT key_a || ';' || key_b AS p_key, count(*) AS n, round(avg(i), 6) AS avg_input_overlap, round(avg(c), 6) AS avg_cell_overlap FROM k GROUP BY key_a, key_b""")
def q_merge_frequency(spark, sf_dir):
    outputs = _outputs(spark, sf_dir).withColumn("key", F.col("out"))
    return grouping.merged(outputs, grouping.pairs(outputs, "shared", different_keys=True))


# ---------------------------------------------------------------- graph


def _graph(spark, sf_dir, keep_sequential: bool = False):
    """cells (id, gate, is_seq, is_buffer, n_ports) and edges (driver, load, term)."""
    part = table(spark, sf_dir, "part").where("p_partkey > 0")
    least = part.agg(F.min("p_brand").alias("least"))
    cells = part.crossJoin(F.broadcast(least)).select(  # one row
        F.col("p_partkey").alias("id"), F.col("p_type").alias("gate"), (F.col("p_brand") == F.col("least")).alias("is_seq"), F.col("p_name").alias("name"), F.col("p_size").alias("area"), F.col("p_brand").alias("brand")
    )
    ids = cells.select("id")
    edges = (
        ids.select(F.col("id").alias("driver"), F.floor(F.col("id") / 2).cast("long").alias("load"), F.when(F.col("id") % 2 == 0, "A").otherwise("B").alias("term"))
        .where("load > 0").join(ids.toDF("load"), "load", "left_semi").select("driver", "load", "term")
    )
    if keep_sequential:
        return cells, edges
    cells, edges = graph.drop_sequential(cells, edges)
    present = edges.groupBy(F.col("load").alias("id")).agg(F.count("*").alias("k"))
    return cells.join(present, "id", "left").withColumn("n_ports", (2 - F.coalesce("k", F.lit(0))).cast("int")).drop("k"), edges


@query(cone_sql.expand())
def q_cone_expand(spark, sf_dir):
    checkpoint = reliable(spark)
    cells, edges = _graph(spark, sf_dir)
    found, _ = graph.expand(cells, edges, checkpoint)
    return found.select("root", F.array_join(F.col("cells").cast("array<string>"), ",").alias("cells"), F.size("cells").cast("long").alias("n_cells"), F.col("depth").cast("long").alias("depth"), F.col("n_inputs").cast("long").alias("n_inputs"))


@query(cone_sql.audit())
def q_cone_prune_audit(spark, sf_dir):
    cells, edges = _graph(spark, sf_dir)
    _, verdicts = graph.expand(cells, edges, reliable(spark))
    return verdicts.groupBy("verdict").agg(F.count("*").alias("n"))


@query(cone_sql.truth_table())
def q_cone_truth_table(spark, sf_dir):
    checkpoint = reliable(spark)
    cells, edges = _graph(spark, sf_dir)
    found, _ = graph.expand(cells, edges, checkpoint)
    kinds = cells.select("gate").distinct()
    tables = F.array(*map(F.lit, ["1110", "1000", "0001", "0111", "0110", "1001"]))  # NAND, NOR, AND, OR, XOR, XNOR
    kind = kinds.select("gate", F.element_at(tables, F.row_number().over(Window.orderBy("gate"))).alias("tt"))  # six gates
    gates = cells.join(F.broadcast(kind), "gate").select("id", "tt", F.array(2 * F.col("id"), 2 * F.col("id") + 1).alias("nets"))
    rows = graph.evaluate(found, gates)
    return rows.select("root", F.array_join(F.col("cells").cast("array<string>"), ",").alias("cells"), "tt")


@query(f"""WITH {cone_sql.GRAPH}, c AS ({cone_sql.expand().split(cone_sql.GRAPH, 1)[1]}), m AS (SELECT root, cells, n_inputs, CAST(unnest(string_split(cells, ',')) AS BIGINT) AS id FROM c)
SELECT root, m.cells, CAST(sum(p_size) AS BIGINT) AS area, CAST(count(*) - 1 AS BIGINT) AS internal_nets, CAST(any_value(n_inputs) AS BIGINT) AS boundary_inputs, CAST(1 AS BIGINT) AS boundary_outputs
FROM m JOIN part ON p_partkey = id GROUP BY root, m.cells""")
def q_cone_attributes(spark, sf_dir):
    cells, _ = _graph(spark, sf_dir)
    nets = cells.select("id", "area", F.explode(F.array(2 * F.col("id"), 2 * F.col("id") + 1)).alias("net")).join(cells.select(F.col("id").alias("net"), F.lit(True).alias("there")), "net", "left")
    edges = saved(nets.select(F.when(F.col("there"), F.col("net")).otherwise(-F.col("net")).alias("driver"), F.col("id").alias("load"), F.lit("A").alias("term")))
    found, _ = graph.expand(cells.withColumn("n_ports", F.lit(0)), edges, saved)
    out = graph.attributes(found, edges, cells.select("id", "area"))
    text = F.array_join(F.col("cells").cast("array<string>"), ",").alias("cells")
    return out.select("root", text, *[F.col(c).cast("long").alias(c) for c in ("area", "internal_nets", "boundary_inputs", "boundary_outputs")])


@query(cone_sql.reach())
def q_cone_reach(spark, sf_dir):
    cells, edges = _graph(spark, sf_dir)
    return graph.reach(cells.select("id"), edges, 2).select("root", "id", F.col("depth").cast("long").alias("depth"))


@query("""WITH RECURSIVE p AS (SELECT p_partkey AS id, p_type = (SELECT min(p_type) FROM part) AS buf FROM part WHERE p_partkey > 0),
e AS (SELECT x.id AS driver, y.id AS load, CASE WHEN x.id % 2 = 0 THEN 'A' ELSE 'B' END AS term FROM p x JOIN p y ON y.id = x.id // 2),
one AS (SELECT load AS id, min(driver) AS up FROM e JOIN p ON p.id = e.load AND buf GROUP BY 1),
a AS (SELECT id, up FROM one UNION ALL SELECT a.id, one.up FROM a JOIN one ON one.id = a.up),
f AS (SELECT id, up FROM a WHERE up NOT IN (SELECT id FROM one))
SELECT coalesce(f.up, driver) AS driver, load, term FROM e JOIN p ON p.id = load AND NOT buf LEFT JOIN f ON f.id = driver""")
def q_buffer_collapse(spark, sf_dir):
    cells, edges = _graph(spark, sf_dir, keep_sequential=True)
    least = cells.agg(F.min("gate").alias("least"))
    marked = cells.crossJoin(F.broadcast(least)).select("id", (F.col("gate") == F.col("least")).alias("is_buffer"))  # one row
    return graph.collapse_buffers(marked, edges, reliable(spark))


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 3 > 0 THEN p_name || '__split__' || pin ELSE p_name END AS name, pin
FROM (SELECT *, unnest(range(0, p_partkey % 3 + 1)) AS i FROM part) CROSS JOIN LATERAL (SELECT 'Y' || i AS pin)""")
def q_multi_output_split(spark, sf_dir):
    cells = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.expr("transform(sequence(0, cast(p_partkey % 3 AS int)), i -> concat('Y', i))").alias("outputs")
    )
    return graph.split_outputs(cells).select("id", "name", "pin")


@query("""WITH e AS (SELECT p_partkey AS driver, p_partkey // 2 AS load FROM part WHERE p_partkey > 1)
SELECT 'cell without master' AS rule, CAST(0 AS BIGINT) AS n UNION ALL SELECT 'load without cell', count(*) FROM e WHERE load NOT IN (SELECT p_partkey FROM part WHERE p_partkey > 0)
UNION ALL SELECT 'driver without cell', CAST(0 AS BIGINT) UNION ALL SELECT 'two drivers', CAST(0 AS BIGINT)""")
def q_graph_integrity(spark, sf_dir):
    cells, _ = _graph(spark, sf_dir, keep_sequential=True)
    edges = cells.where("id > 1").select(F.col("id").alias("driver"), F.floor(F.col("id") / 2).cast("long").alias("load"), F.when(F.col("id") % 2 == 0, "A").otherwise("B").alias("term"))
    return graph.integrity(cells, edges, cells.select("gate").distinct())


# ---------------------------------------------------------------- demand
# library cells = brands with function (37 i + 11) % 256; relation costs follow from the numbers of target class and brand


_DEMAND_SQL = f"""{KEYED}, mined AS (SELECT p_key AS key, count(*) AS cnt FROM k GROUP BY 1),
b AS (SELECT brand, row_number() OVER (ORDER BY brand) AS i FROM (SELECT DISTINCT p_brand AS brand FROM part)),
cells AS (SELECT '0b' || {P3} AS key, min(brand) AS name FROM (SELECT brand, lpad(bin((37 * i + 11) % 256), 8, '0') AS tt FROM b) GROUP BY 1),
cn AS (SELECT key, name, row_number() OVER (ORDER BY key) AS j FROM cells), mn AS (SELECT key, cnt, row_number() OVER (ORDER BY key) AS i FROM mined),
rel AS (SELECT mn.key AS target, cn.key AS base, CASE WHEN (i + 2 * j) % 7 = 0 THEN 'TIMEOUT' ELSE 'OK' END AS status, 1 + (i + j) % 4 AS base_count, (i * j) % 3 AS inv_count,
1 + (i + j) % 4 + (i * j) % 3 AS total FROM mn CROSS JOIN cn),
cand AS (SELECT mined.key AS logic, cnt, mined.key AS base, 1 AS base_count, 0 AS inv_count, 1 AS total FROM mined JOIN cells USING (key)
UNION ALL SELECT target, cnt, base, base_count, inv_count, total FROM rel JOIN mined ON key = target WHERE status = 'OK' AND total <= 2 AND base <> target),
cost AS (SELECT key, coalesce({_FET}, 14) AS fet FROM (SELECT key, {_CLASS} AS cls FROM (SELECT key, substr(key, 3) AS tt FROM mined UNION SELECT key, substr(key, 3) FROM cells))),
dl AS (SELECT cand.*, cb.fet AS base_fet, cl.fet AS direct_fet, base_count * cb.fet + 2 * inv_count AS indirect_fet, greatest(0, base_count * cb.fet + 2 * inv_count - cl.fet) AS delta
FROM cand JOIN cost cb ON cb.key = base JOIN cost cl ON cl.key = logic),
sp AS (SELECT *, (1.0 / (1 + delta)) / sum(1.0 / (1 + delta)) OVER (PARTITION BY logic) AS ratio FROM dl)"""


def _demand(spark, sf_dir):
    order = Window.orderBy("key")  # keys are a finite set of classes
    mined = counts(spark, sf_dir).select(F.col("p_key").alias("key"), "cnt", F.lit(3).alias("n"))
    brands = table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand")).distinct()
    numbered = brands.select("brand", ((37 * F.row_number().over(Window.orderBy("brand")) + 11) % 256).cast("long").alias("value"))
    cells = numbered.join(space.p_dim(spark, 3), "value").groupBy(truth.key_column(F.col("p"), 3).alias("key")).agg(F.min("brand").alias("name")).withColumn("n", F.lit(3))
    t = mined.select(F.col("key").alias("target"), F.row_number().over(order).alias("i"))
    b = cells.select(F.col("key").alias("base"), F.row_number().over(order).alias("j"))
    relation = t.crossJoin(b).select(  # 80 classes by 25 brands at most
        "target", "base", F.when((F.col("i") + 2 * F.col("j")) % 7 == 0, "TIMEOUT").otherwise("OK").alias("status"),
        (1 + (F.col("i") + F.col("j")) % 4).alias("base_count"), (F.col("i") * F.col("j") % 3).alias("inv_count"),
    ).withColumn("total", F.col("base_count") + F.col("inv_count"))
    return mined, cells, relation


def _costs(mined, cells):
    keys = mined.select("key").union(cells.select("key")).distinct()
    fet = truth.fet_cost(truth.function_class(F.substring("key", 3, 8), 3), F.lit(3))
    return keys.select("key", F.coalesce(fet, F.lit(14)).alias("fet"))


def _split(spark, sf_dir):
    mined, cells, relation = _demand(spark, sf_dir)
    return demand.weighted_split(demand.with_delta(demand.candidates(mined, cells, relation, 2), _costs(mined, cells)))


@query(f"WITH {_DEMAND_SQL} SELECT logic, cnt, base, base_count, inv_count, total FROM cand")
def q_candidates(spark, sf_dir):
    return demand.candidates(*_demand(spark, sf_dir), 2)


@query(f"WITH {_DEMAND_SQL} SELECT key, cnt FROM mined WHERE key NOT IN (SELECT logic FROM cand)")
def q_uncovered(spark, sf_dir):
    mined, cells, relation = _demand(spark, sf_dir)
    return demand.uncovered(mined, demand.candidates(mined, cells, relation, 2))


@query(f"WITH {_DEMAND_SQL} SELECT logic, base, delta, direct_fet, indirect_fet FROM dl WHERE delta <= 8")
def q_delta_filter(spark, sf_dir):
    mined, cells, relation = _demand(spark, sf_dir)
    rows = demand.with_delta(demand.candidates(mined, cells, relation, 2), _costs(mined, cells)).where("delta <= 8")
    return rows.select("logic", "base", "delta", "direct_fet", "indirect_fet")


@query(f"WITH {_DEMAND_SQL} SELECT logic, base, round(ratio, 6) AS ratio, round(ratio * cnt * base_count, 4) AS base_used, round(ratio * cnt * inv_count, 4) AS inv_used FROM sp")
def q_weighted_split(spark, sf_dir):
    return _split(spark, sf_dir).select("logic", "base", F.round("ratio", 6).alias("ratio"), F.round("base_used", 4).alias("base_used"), F.round("inv_used", 4).alias("inv_used"))


@query(f"""WITH {_DEMAND_SQL} SELECT base AS cell, round(sum(ratio * cnt * base_count), 4) AS used FROM sp GROUP BY 1 UNION ALL SELECT 'INV', round(sum(ratio * cnt * inv_count), 4) FROM sp""")
def q_cell_demand(spark, sf_dir):
    return demand.cell_demand(_split(spark, sf_dir))


_CELL_RELATION_SQL = """r AS (SELECT x.brand AS target, y.brand AS base, CASE WHEN (x.i + 2 * y.i) % 7 = 0 THEN 'TIMEOUT' WHEN (x.i + y.i) % 11 = 0 THEN 'PROJECTION' ELSE 'OK' END AS status,
1 + (x.i * 3 + y.i * 5) % 9 AS total FROM b x JOIN b y ON x.i <> y.i WHERE (x.i * y.i) % 5 <> 0)"""
_BRANDS_SQL = "b AS (SELECT brand, row_number() OVER (ORDER BY brand) AS i FROM (SELECT DISTINCT p_brand AS brand FROM part))"


def _brand_relation(spark, sf_dir):
    brands = table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand")).distinct().select("brand", F.row_number().over(Window.orderBy("brand")).alias("i"))
    x, y = brands.toDF("target", "i"), brands.toDF("base", "j")
    rows = x.crossJoin(y).where("i <> j AND (i * j) % 5 <> 0")  # 25 brands
    return brands, rows.select(
        "target", "base", F.when((F.col("i") + 2 * F.col("j")) % 7 == 0, "TIMEOUT").when((F.col("i") + F.col("j")) % 11 == 0, "PROJECTION").otherwise("OK").alias("status"),
        (1 + (F.col("i") * 3 + F.col("j") * 5) % 9).alias("total"),
    )


@query(f"""WITH {_BRANDS_SQL}, {_CELL_RELATION_SQL}, ks AS (SELECT DISTINCT target AS k FROM r),
j AS (SELECT x.k AS key_a, y.k AS key_b, CASE WHEN ab.status <> 'TIMEOUT' THEN ab.total END AS cost_ab, coalesce(ab.status, 'MISSING') AS status_ab,
CASE WHEN ba.status <> 'TIMEOUT' THEN ba.total END AS cost_ba, coalesce(ba.status, 'MISSING') AS status_ba FROM ks x JOIN ks y ON x.k < y.k
LEFT JOIN r ab ON ab.target = x.k AND ab.base = y.k LEFT JOIN r ba ON ba.target = y.k AND ba.base = x.k)
SELECT key_a, key_b, coalesce(cost_ab, -1) AS cost_ab, status_ab, coalesce(cost_ba, -1) AS cost_ba, status_ba, coalesce(least(cost_ab, cost_ba), -1) AS min_cost, CASE WHEN cost_ab IS NULL AND cost_ba IS NULL THEN 'none' WHEN cost_ba IS NULL OR cost_ab <= cost_ba THEN key_b ELSE key_a END AS absorber,
CASE WHEN least(cost_ab, cost_ba) <= 4 THEN 'YES' ELSE 'NO' END AS overlap FROM j""")
def q_relation_overlap(spark, sf_dir):
    return demand.symmetric_overlap(_brand_relation(spark, sf_dir)[1], 4).fillna(-1, ["cost_ab", "cost_ba", "min_cost"]).fillna("none", ["absorber"])


@query(f"WITH {_BRANDS_SQL}, {_CELL_RELATION_SQL} SELECT x.brand AS target, y.brand AS base FROM b x JOIN b y ON x.brand <> y.brand WHERE (x.brand, y.brand) NOT IN (SELECT target, base FROM r)")
def q_missing_pairs(spark, sf_dir):
    brands, relation = _brand_relation(spark, sf_dir)
    return demand.missing_pairs(brands.select("brand"), relation)


_GAIN_SQL = f"""{KEYED}, {MEMBERS}, {LIBRARY}, ar AS (SELECT c, sum(p_size + 1) AS area FROM m JOIN part ON p_partkey = p GROUP BY 1),
st AS (SELECT p_key, count(*) AS n_clusters, avg(area) AS av, CAST(min(area) AS BIGINT) AS min_area, CAST(max(area) AS BIGINT) AS max_area FROM k JOIN ar USING (c) GROUP BY 1),
nc AS (SELECT p_key, min(name) AS cell, min(area) + 1 AS new_area FROM lib GROUP BY 1),
g AS (SELECT st.p_key, coalesce(cell, '(none)') AS cell, n_clusters, round(av, 4) AS avg_area, min_area, max_area, coalesce(new_area, -1) AS new_area, round(av - new_area, 4) AS gain FROM st LEFT JOIN nc USING (p_key))"""


def _gain(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("cell"), (F.col("p_size") + 1).alias("a"))
    area = members(spark, sf_dir).join(part, "cell").groupBy("cluster").agg(F.sum("a").alias("area"))
    new = library(spark, sf_dir).groupBy("p_key").agg(F.min("name").alias("cell"), (F.min("area") + 1).alias("area"))
    return clusters.area_gain(keyed(spark, sf_dir).join(area, "cluster"), new)


@query(f"WITH {_GAIN_SQL} SELECT * FROM g")
def q_area_gain(spark, sf_dir):
    return _gain(spark, sf_dir)


@query(f"WITH {_GAIN_SQL} SELECT p_key, max(gain) AS best FROM g WHERE gain IS NOT NULL AND p_key <> '0b00000001' GROUP BY 1")
def q_best_gain(spark, sf_dir):
    return _gain(spark, sf_dir).where("gain IS NOT NULL AND p_key <> '0b00000001'").groupBy("p_key").agg(F.max("gain").alias("best"))


# ---------------------------------------------------------------- features


@query("""WITH s AS (SELECT event_type AS kind, count(*) AS n, round(coalesce(avg(value) FILTER (WHERE value > 0), 0), 6) AS avg_value, coalesce(min(value) FILTER (WHERE value > 0), 0) AS min_value,
coalesce(max(value) FILTER (WHERE value > 0), 0) AS max_value, count(DISTINCT user_id) AS t, count(DISTINCT user_id) FILTER (WHERE value < 1) AS f, min(value) AS worst FROM events GROUP BY 1)
SELECT kind, n, avg_value, min_value, max_value, round(f / t, 6) AS violation_ratio, round(t / (SELECT count(DISTINCT user_id) FROM events), 6) AS path_coverage, worst,
CASE WHEN count(*) OVER () = 1 THEN 0.5 ELSE round((row_number() OVER (ORDER BY worst, kind) - 1) / (count(*) OVER () - 1), 6) END AS worst_rank FROM s""")
def q_timing_stats(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), F.col("user_id").alias("path"), "value", (F.col("value") < 1).alias("failing"))
    return features.timing_stats(rows)


_Z = ("p_size", "p_retailprice", "p_partkey")


@query("SELECT p_partkey AS id, " + ", ".join(f"round(({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () < 1e-8 THEN 1 ELSE stddev_pop({c}) OVER () END, 6) AS z_{c}" for c in _Z) + " FROM part")
def q_zscore(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), *_Z)
    return features.z_score(rows, "id", list(_Z))


_USAGE_SQL = "u AS (SELECT p_brand AS name, count(*) AS cnt FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1)"


def _usage(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("name"))
    return table(spark, sf_dir, "lineitem").select("l_partkey").join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("name").agg(F.count("*").alias("cnt"))


@query(f"WITH {_USAGE_SQL} SELECT name, cnt, round(cnt / sum(cnt) OVER (), 6) AS fraction FROM u")
def q_cell_fraction(spark, sf_dir):
    return _usage(spark, sf_dir).select("name", "cnt", F.round(F.col("cnt") / F.sum("cnt").over(Window.partitionBy()), 6).alias("fraction"))


@query(f"WITH {_USAGE_SQL} SELECT name, cnt, CASE WHEN count(*) OVER () = 1 THEN 1.0 ELSE round(1 - (row_number() OVER (ORDER BY cnt DESC, name) - 1) / (count(*) OVER () - 1), 6) END AS usage_rank FROM u WHERE cnt > 0")
def q_usage_rank(spark, sf_dir):
    order = Window.orderBy(F.col("cnt").desc(), "name")
    return _usage(spark, sf_dir).where("cnt > 0").select("name", "cnt", features.ranked(order, descending_share=True, alone=1.0).alias("usage_rank"))


@query(f"WITH {KEYED}, {POLARITY}, c AS (SELECT np_key, count(DISTINCT p_key) AS n FROM pol WHERE p_key IN (SELECT p_key FROM k) GROUP BY 1) SELECT np_key, n, round(n / max(n) OVER (), 6) AS size_norm FROM c")
def q_class_size(spark, sf_dir):
    seen = keyed(spark, sf_dir).select("p_key").distinct()
    sizes = space.polarity_dim(spark, 3).join(seen, "p_key", "left_semi").groupBy("np_key").agg(F.countDistinct("p_key").alias("n"))
    return sizes.select("np_key", "n", F.round(F.col("n") / F.max("n").over(Window.partitionBy()), 6).alias("size_norm"))


@query("""WITH s AS (SELECT l_partkey AS part, s_nationkey % 7 = 0 AS side FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2),
x AS (SELECT part, bool_or(side) AS a, bool_or(NOT side) AS b FROM s GROUP BY 1)
SELECT part, CAST(a AND NOT b AS INTEGER) AS only_a, CAST(a AND b AS INTEGER) AS both, CAST(b AND NOT a AS INTEGER) AS only_b FROM x""")
def q_role_onehot(spark, sf_dir):
    side = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), (F.col("s_nationkey") % 7 == 0).alias("side"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part"), "l_suppkey").join(side, "l_suppkey")
    x = rows.groupBy("part").agg(F.bool_or("side").alias("a"), F.bool_or(~F.col("side")).alias("b"))
    return x.select("part", *features.role(F.col("a"), F.col("b")))


@query("SELECT x.n_regionkey AS design, x.n_nationkey AS run_a, y.n_nationkey AS run_b FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey AND x.n_nationkey <> y.n_nationkey")
def q_run_pairs(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("design"), F.col("n_nationkey").alias("run"))
    return n.toDF("design", "run_a").join(n.toDF("design", "run_b"), "design").where("run_a <> run_b")


_NODE_SQL = f"""{KEYED}, {MEMBERS}, {PAIRS.split(', pr AS')[1].join([', pr AS', ''])[2:]}, {BOTH},
b AS (SELECT brand, row_number() OVER (ORDER BY brand) AS i FROM (SELECT DISTINCT p_brand AS brand FROM part)),
{POLARITY}, node AS (SELECT name, '0b' || x AS p_key, min(np_key) AS np_key, min(ei) AS inv_in, min(eo) AS inv_out FROM (SELECT brand AS name, {P3} AS x FROM (SELECT brand, lpad(bin((37 * i + 11) % 256), 8, '0') AS tt FROM b))
JOIN pol ON pol.p_key = '0b' || x GROUP BY 1, 2),
n AS (SELECT p_key, count(*) AS n FROM k GROUP BY 1),
mi AS (SELECT k.p_key, p_brand AS name, round(count(DISTINCT k.c) / any_value(n), 6) AS m1, round(count(*) / any_value(n), 6) AS m2 FROM m JOIN part ON p_partkey = p JOIN k ON k.c = m.c JOIN n ON n.p_key = k.p_key GROUP BY 1, 2),
x AS (SELECT ka.p_key AS key_a, kb.p_key AS key_b, count(DISTINCT a) AS t FROM bw JOIN k ka ON ka.c = a JOIN k kb ON kb.c = b WHERE ka.p_key <> kb.p_key GROUP BY 1, 2),
ra AS (SELECT key_a, key_b, round(t / n, 6) AS overlap FROM x JOIN n ON p_key = key_a),
ed AS (SELECT d.name AS dst, s.name AS src, CAST(d.p_key = s.p_key AS INTEGER) AS same_key, CAST(d.np_key = s.np_key AS INTEGER) AS same_class, coalesce(m1, 0) AS m1, coalesce(m2, 0) AS m2, coalesce(overlap, 0) AS overlap,
CASE WHEN d.np_key = s.np_key THEN abs(d.inv_in - s.inv_in) ELSE 0 END AS d_in, CASE WHEN d.np_key = s.np_key THEN abs(d.inv_out - s.inv_out) ELSE 0 END AS d_out
FROM node d JOIN node s ON d.name <> s.name LEFT JOIN mi ON mi.p_key = d.p_key AND mi.name = s.name LEFT JOIN ra ON key_a = d.p_key AND key_b = s.p_key),
g AS (SELECT * FROM ed WHERE same_class = 1 OR m1 <> 0 OR m2 <> 0 OR overlap <> 0)"""
_NODE_SQL = _NODE_SQL.replace(f"{MEMBERS}, {MEMBERS}", MEMBERS)


def _feature_graph(spark, sf_dir):
    brands = table(spark, sf_dir, "part").select(F.col("p_brand").alias("name")).distinct()
    value = ((37 * F.row_number().over(Window.orderBy("name")) + 11) % 256).cast("long")
    nodes = brands.select("name", value.alias("value")).join(space.p_dim(spark, 3), "value").select("name", truth.key_column(F.col("p"), 3).alias("p_key"))
    nodes = nodes.join(space.polarity_dim(spark, 3), "p_key").groupBy("name", "p_key").agg(F.min("np_key").alias("np_key"), F.min("ei").alias("inv_in"), F.min("eo").alias("inv_out"))
    return features.graph_edges(saved(nodes), q_edge_features(spark, sf_dir), q_overlap_ratio(spark, sf_dir), saved)


@query(f"WITH {_NODE_SQL} SELECT * FROM g")
def q_feature_graph_edges(spark, sf_dir):
    return _feature_graph(spark, sf_dir)


@query(f"""WITH {_NODE_SQL}, dg AS (SELECT 'out' AS side, count(*) AS k FROM g GROUP BY src UNION ALL SELECT 'in', count(*) FROM g GROUP BY dst)
SELECT side, min(k) AS least, max(k) AS most, round(avg(k), 6) AS mean FROM dg GROUP BY 1""")
def q_degree_summary(spark, sf_dir):
    return features.degrees(_feature_graph(spark, sf_dir))


_SCORES_SQL = """s AS (SELECT n_regionkey AS design, p_brand AS name, count(*) AS cnt FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
JOIN nation ON n_nationkey = s_nationkey GROUP BY 1, 2), q AS (SELECT *, cnt % 5 <> 0 AS mask, (cnt % 100) / 25.0 AS score FROM s)"""


def _scores(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("name"))
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").alias("design"))
    place = table(spark, sf_dir, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), "design")
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").join(part, "l_partkey").join(place, "l_suppkey")
    s = rows.groupBy("design", "name").agg(F.count("*").alias("cnt"))
    return s.select("design", "name", "cnt", (F.col("cnt") % 5 != 0).alias("mask"), ((F.col("cnt") % 100) / 25.0).alias("score"))


@query(f"""WITH {_SCORES_SQL}, e AS (SELECT *, exp(score - max(score) FILTER (WHERE mask) OVER (PARTITION BY design)) AS e FROM q)
SELECT design, name, CASE WHEN mask THEN round(e / sum(e) FILTER (WHERE mask) OVER (PARTITION BY design), 6) ELSE 0 END AS softmax FROM e""")
def q_masked_softmax(spark, sf_dir):
    return features.masked_softmax(_scores(spark, sf_dir), "design", "score", "mask").select("design", "name", "softmax")


@query(f"""WITH {_SCORES_SQL}, e AS (SELECT *, coalesce(sum(cnt) FILTER (WHERE mask) OVER (PARTITION BY design), 0) AS t FROM q)
SELECT design, name, CASE WHEN t <= 1e-9 THEN 0 ELSE round(cnt / t, 6) END AS label FROM e""")
def q_label_norm(spark, sf_dir):
    return features.label_norm(_scores(spark, sf_dir), "design", "cnt", "mask").select("design", "name", "label")


# ---------------------------------------------------------------- combinations, sweeps, resolution, checks


_TOP10_SQL = f"""{_USAGE_SQL}, t AS (SELECT name, cnt, row_number() OVER (ORDER BY cnt DESC, name) AS i FROM u QUALIFY i <= 10), z AS (SELECT p_brand AS name, avg(p_size) AS area FROM part GROUP BY 1),
w AS (SELECT t.*, cnt / sum(cnt) OVER () AS pred, area FROM t JOIN z USING (name))"""


@query(f"""WITH {_TOP10_SQL}, c AS (SELECT a.name AS cell_1, b.name AS cell_2, c.name AS cell_3, round(a.pred + b.pred + c.pred, 6) AS added,
round(a.pred * (a.area + 1) + b.pred * (b.area + 1) + c.pred * (c.area + 1), 6) AS area_weighted FROM w a JOIN w b ON a.i < b.i JOIN w c ON b.i < c.i)
SELECT *, row_number() OVER (ORDER BY area_weighted DESC, cell_1, cell_2, cell_3) AS rank_no FROM c""")
def q_combinations_topk(spark, sf_dir):
    u = _usage(spark, sf_dir).orderBy(F.col("cnt").desc(), "name").limit(10)
    u = u.select("name", "cnt", F.row_number().over(Window.orderBy(F.col("cnt").desc(), "name")).alias("i"))
    area = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("name")).agg(F.avg("p_size").alias("area"))
    w = u.withColumn("pred", F.col("cnt") / F.sum("cnt").over(Window.partitionBy())).join(area, "name")
    side = lambda x: w.select(F.col("name").alias(f"cell_{x}"), F.col("i").alias(f"i{x}"), F.col("pred").alias(f"p{x}"), F.col("area").alias(f"a{x}"))
    joined = side(1).join(side(2), F.col("i1") < F.col("i2")).join(side(3), F.col("i2") < F.col("i3"))  # ten rows a side
    out = joined.select(
        "cell_1", "cell_2", "cell_3", F.round(F.col("p1") + F.col("p2") + F.col("p3"), 6).alias("added"),
        F.round(F.col("p1") * (F.col("a1") + 1) + F.col("p2") * (F.col("a2") + 1) + F.col("p3") * (F.col("a3") + 1), 6).alias("area_weighted"),
    )
    return out.withColumn("rank_no", F.row_number().over(Window.orderBy(F.col("area_weighted").desc(), "cell_1", "cell_2", "cell_3")).cast("long"))


@query(f"""WITH {_TOP10_SQL}, s AS (SELECT range AS mask FROM range(1, 1024)) SELECT mask, string_agg(name, ',' ORDER BY name) AS names, count(*) AS n, CAST(sum(cnt) AS BIGINT) AS cnt
FROM s JOIN t ON (mask >> CAST(i - 1 AS INTEGER)) & 1 = 1 GROUP BY 1""")
def q_subset_enumeration(spark, sf_dir):
    u = _usage(spark, sf_dir).orderBy(F.col("cnt").desc(), "name").limit(10)
    u = u.select("name", "cnt", F.row_number().over(Window.orderBy(F.col("cnt").desc(), "name")).alias("i"))
    rows = u.select("name", "cnt", F.explode(F.sequence(F.lit(1), F.lit(1023))).alias("mask"), "i").where(F.expr("shiftright(mask, i - 1) & 1 = 1"))
    return rows.groupBy(F.col("mask").cast("long").alias("mask")).agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names"), F.count("*").alias("n"), F.sum("cnt").alias("cnt"))


_GRID_SQL = """g AS (SELECT area, freq, rep, 'a' || area || '_f' || freq || '_r' || rep AS run FROM (SELECT unnest([90, 95, 100, 105, 110]) AS area) CROSS JOIN (SELECT unnest([800, 900, 1000, 1100]) AS freq) CROSS JOIN (SELECT unnest([1, 2, 3]) AS rep))"""


def _grid(spark):
    rows = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in (90, 95, 100, 105, 110)])).alias("area"))
    rows = rows.select("area", F.explode(F.array(*[F.lit(x) for x in (800, 900, 1000, 1100)])).alias("freq"))
    rows = rows.select("area", "freq", F.explode(F.array(*[F.lit(x) for x in (1, 2, 3)])).alias("rep"))
    return rows.withColumn("run", F.concat(F.lit("a"), "area", F.lit("_f"), "freq", F.lit("_r"), "rep"))


@query("""WITH g AS (SELECT area, freq, unnest([1, 2, 3]) AS rep FROM (SELECT DISTINCT p_size * 10 AS area FROM part) CROSS JOIN (SELECT DISTINCT 800 + p_partkey % 4 * 100 AS freq FROM part))
SELECT 'a' || area || '_f' || freq || '_r' || rep AS run, area, freq, rep, round(1000.0 / freq, 6) AS period FROM g""")
def q_sweep_grid(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    grid = search.grid(part.select((F.col("p_size") * 10).alias("area")), part.select((800 + F.pmod("p_partkey", F.lit(4)) * 100).alias("freq")), 3)
    rows = grid.select(F.concat(F.lit("a"), "area", F.lit("_f"), "freq", F.lit("_r"), "rep").alias("run"))
    number = lambda k: F.regexp_extract("run", r"^a(\d+)_f(\d+)_r(\d+)$", k).cast("int")
    return rows.select("run", number(1).alias("area"), number(2).alias("freq"), number(3).alias("rep")).withColumn("period", F.round(1000.0 / F.col("freq"), 6))


_PASS_SQL = f"""{_GRID_SQL}, o AS (SELECT o_orderkey % 60 AS j, count(*) AS n, min(o_totalprice) AS lo FROM orders GROUP BY 1),
n AS (SELECT *, row_number() OVER (ORDER BY run) - 1 AS j FROM g), v AS (SELECT n.*, o.n % 40 - 25 AS slack, o.n % 300 AS drc FROM n JOIN o USING (j)), ok AS (SELECT * FROM v WHERE slack >= -20 AND drc <= 280)"""


@query(f"""WITH {_PASS_SQL} SELECT 'area' AS kind, freq AS fixed, min(area) AS best, arg_min(run, (area, run)) AS run FROM ok GROUP BY 2
UNION ALL SELECT 'freq', area, max(freq), arg_min(run, (-freq, run)) FROM ok GROUP BY 2""")
def q_best_pass(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy((F.col("o_orderkey") % 60).alias("j")).agg(F.count("*").alias("n"))
    g = _grid(spark).withColumn("j", F.row_number().over(Window.orderBy("run")) - 1)
    ok = g.join(o, "j").where("n % 40 - 25 >= -20 AND n % 300 <= 280")
    area = ok.groupBy(F.col("freq").alias("fixed")).agg(F.min("area").alias("best"), F.min_by("run", F.struct("area", "run")).alias("run")).select(F.lit("area").alias("kind"), "fixed", "best", "run")
    freq = ok.groupBy(F.col("area").alias("fixed")).agg(F.max("freq").alias("best"), F.min_by("run", F.struct(-F.col("freq"), "run")).alias("run")).select(F.lit("freq"), "fixed", "best", "run")
    return area.union(freq)


@query(f"""WITH v AS (SELECT DISTINCT p_brand || '_X' || (p_size % 3 + 1) AS name, p_type AS fn, p_size % 3 + 1 AS drive FROM part WHERE p_partkey % 2 = 0),
a AS (SELECT p_brand || '_X' || (p_size % 3 + 1) || CASE WHEN p_partkey % 4 = 1 THEN '_alt' ELSE '' END AS asked, p_type AS fn, p_size % 3 + 1 AS drive, p_size AS cnt FROM part),
best AS (SELECT fn, drive, min(name) AS name FROM v GROUP BY 1, 2)
SELECT coalesce(e.name, best.name, asked) AS resolved, CAST(sum(cnt) AS BIGINT) AS cnt, count(*) AS n_asked FROM a LEFT JOIN (SELECT DISTINCT name FROM v) e ON e.name = asked LEFT JOIN best ON best.fn = a.fn AND best.drive = a.drive GROUP BY 1""")
def q_name_resolution(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    drive = F.col("p_size") % 3 + 1
    name = F.concat("p_brand", F.lit("_X"), drive)
    known = part.where("p_partkey % 2 = 0").select(name.alias("name"), F.col("p_type").alias("fn")).distinct()
    token = F.regexp_extract("asked", r"_X(\d+)(?:_|$)", 1)
    asked = part.select(F.concat(name, F.when(F.col("p_partkey") % 4 == 1, "_alt").otherwise("")).alias("asked"), F.col("p_type").alias("fn"), F.col("p_size").alias("cnt"))
    best = known.groupBy("fn", F.regexp_extract("name", r"_X(\d+)(?:_|$)", 1).alias("drive")).agg(F.min("name").alias("other"))
    exact = known.select(F.col("name").alias("asked"), F.col("name").alias("exact")).distinct()
    joined = asked.withColumn("drive", token).join(exact, "asked", "left").join(best, ["fn", "drive"], "left")
    return joined.groupBy(F.coalesce("exact", "other", "asked").alias("resolved")).agg(F.sum("cnt").alias("cnt"), F.count("*").alias("n_asked"))


@query("""SELECT 'negative' AS rule, count(*) AS n FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'nan', count(*) FROM customer WHERE isnan(c_acctbal)
UNION ALL SELECT 'not whole', count(*) FROM lineitem WHERE l_quantity <> floor(l_quantity)
UNION ALL SELECT 'duplicate', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) UNION ALL SELECT 'implausible', count(*) FROM orders WHERE o_totalprice < 1000""")
def q_quality_counts(spark, sf_dir):
    customer, lines, orders = (table(spark, sf_dir, t) for t in ("customer", "lineitem", "orders"))
    one = lambda rule, df: df.agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n")
    return (
        one("negative", customer.where("c_acctbal < 0")).union(one("nan", customer.where(F.isnan("c_acctbal"))))
        .union(one("not whole", lines.where("l_quantity <> floor(l_quantity)")))
        .union(one("duplicate", lines.groupBy("l_orderkey", "l_linenumber").count().where("`count` > 1"))).union(one("implausible", orders.where("o_totalprice < 1000")))
    )


@query(f"WITH {KEYED} SELECT p_key, cnt FROM (SELECT p_key, count(*) AS cnt FROM k GROUP BY 1) ORDER BY cnt DESC, p_key LIMIT 1 OFFSET 2")
def q_nth_rank_row(spark, sf_dir):
    return clusters.positions(counts(spark, sf_dir), "cnt", "p_key").where("rank_no = 2").select("p_key", "cnt")


@query("""WITH o AS (SELECT p_partkey AS k, p_name AS name, p_size AS v FROM part WHERE p_partkey % 3 <> 0), n AS (SELECT p_partkey AS k, upper(p_name) AS name, p_size + 100 AS v FROM part WHERE p_partkey % 2 = 0)
SELECT coalesce(n.k, o.k) AS k, CASE WHEN n.k IS NULL THEN o.name ELSE n.name END AS name, CASE WHEN n.k IS NULL THEN o.v ELSE n.v END AS v FROM o FULL JOIN n ON n.k = o.k""")
def q_upsert(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    old = part.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name"), F.col("p_size").alias("v"))
    new = part.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("k"), F.upper("p_name").alias("name"), (F.col("p_size") + 100).alias("v"))
    return features.upsert(old, new, "k")
