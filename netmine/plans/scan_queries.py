"""Queries over scans: the text of files is made from the tables, scanned, and compared with what it was made from.

One file for each nation unless said otherwise; paths are names only, nothing is read from disk.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netmine.functions import canonical, expr, space, truth
from netmine.operators import checks, clusters, graph, search, transistors
from netmine.plans import cone_sql
from netmine.plans.catalogue import P3, _graph, forms_sql, query
from netmine.session import saved, shared_folder, table
from netmine.sources import blocks, lines, ranges


def _files(spark, sf_dir, text, path="/lib/cell_{}_tt_0.7.lib") -> DataFrame:
    head, tail = path.split("{}")
    return table(spark, sf_dir, "nation").select(F.concat(F.lit(head), F.col("n_nationkey").cast("string"), F.lit(tail)).alias("path"), text.alias("text"))


def _k():
    """The nation's key; made when a query is, as columns need a session."""
    return F.col("n_nationkey")


def _liberty(spark, sf_dir):
    n = F.col("n_nationkey").cast("string")
    pins = ' pin ("A") { direction : input; } pin (B) { direction : "input"; timing () { related_pin : "A"; } } pin (VDD) { direction : internal; }'
    text = F.concat(
        F.lit('/* comment { */ library (l) {\n delay_model : table_lookup;\n cell (C'), n, F.lit(") {\n area : "), n, F.lit(".5;"), F.lit(pins),
        F.when(_k() % 5 == 0, ' ff (IQ, IQN) { clocked_on : "B"; } pin (Q) { direction : output; function : "IQ"; }').otherwise(' pin (Y) { direction : output; function : "(A * B)\'"; }'),
        F.when(_k() % 7 == 0, ' pin (Z) { direction : output; function : "A ^ B"; }').otherwise(""), F.lit("\n}\n cell (D"), n, F.lit(') { area : 1; pin (Y) { direction : output; function : "1"; } }\n}\n'),
    )
    return _files(spark, sf_dir, text)


@query("""SELECT 'C' || n_nationkey AS name, n_nationkey + 0.5 AS area, n_nationkey % 5 = 0 AS is_seq, 3 + (n_nationkey % 7 = 0)::INT AS n_pins, 1 + (n_nationkey % 7 = 0)::INT AS n_functions FROM nation
UNION ALL SELECT 'D' || n_nationkey, 1, false, 1, 1 FROM nation""")
def q_liberty_scan(spark, sf_dir):
    return blocks.liberty(_liberty(spark, sf_dir)).select("name", "area", "is_seq", F.size("pins").alias("n_pins"), F.size("functions").alias("n_functions"))


@query("""SELECT 'C' || n_nationkey AS name, n_nationkey + 0.5 AS area, 2 AS n_inputs, '1110' AS tt FROM nation WHERE n_nationkey % 5 > 0 AND n_nationkey % 7 > 0 UNION ALL SELECT 'D' || n_nationkey, 1, 0, '1' FROM nation""")
def q_liberty_light(spark, sf_dir):
    rows = blocks.light(blocks.liberty(_liberty(spark, sf_dir)))
    return rows.select("name", "area", F.size("inputs").alias("n_inputs"), expr.truth_table(F.col("function"), F.col("inputs")).alias("tt"))


@query("""SELECT 'C' || n_nationkey AS name, CASE WHEN n_nationkey % 5 = 0 THEN 'seq' ELSE 'logic' END AS cell_class, 'cell_' || n_nationkey AS stem FROM nation""")
def q_liberty_classify(spark, sf_dir):
    files = _liberty(spark, sf_dir)
    first = blocks.classified(blocks.liberty(files))
    return first.join(blocks.cell_names(files), ["path", "name"]).select("name", "cell_class", "stem")


@query("SELECT CAST(2 AS BIGINT) AS n_templates, count(*) * 2 AS n_cells, CAST(13 AS BIGINT) AS first_variant, count(*) - 13 AS second_variant FROM nation")
def q_liberty_merge(spark, sf_dir):
    n = F.col("n_nationkey").cast("string")
    files = _files(spark, sf_dir, F.concat(
        F.lit('library (x) {\n date : "'), n, F.lit('";\n lu_table_template (grid) { variable_1 : "a'), (_k() % 2).cast("string"), F.lit('"; }\n cell (C'), n, F.lit(") { values (grid) { } }\n cell (D"), n, F.lit(") { }\n}\n"),
    ))
    parts = blocks.merged_library(files)
    return parts.agg(
        F.count(F.when((F.col("kind") == "head") & F.col("text").rlike(r"lu_table_template \(grid_v\d\)"), 1)).alias("n_templates"), F.count(F.when(F.col("kind") == "cell", 1)).alias("n_cells"),
        F.count(F.when(F.col("text").rlike(r"values \(grid_v0\)"), 1)).alias("first_variant"), F.count(F.when(F.col("text").rlike(r"values \(grid_v1\)"), 1)).alias("second_variant"),
    )


def _one_text(spark, sf_dir, path: str, begin: str, end: str, *lines, width: int = 5001) -> DataFrame:
    """One text with these lines (columns over lineitem) for every line number of every order, by ranges whose borders fall anywhere between them."""
    k = len(lines)
    place = (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * k
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*[F.min(c).alias(c) for c in ("l_partkey", "l_suppkey", "l_quantity", "l_returnflag")])
    rows = items.select(F.explode(F.array(*[F.struct((place + i).alias("no"), x.alias("line")) for i, x in enumerate(lines)])).alias("x")).select("x.no", "x.line")
    ends = spark.range(2).select(F.when(F.col("id") == 0, F.lit(0)).otherwise(F.lit(1 << 60)).alias("no"), F.when(F.col("id") == 0, begin).otherwise(end).alias("line"))
    return ranges.of_table(rows.union(ends), path, "no", "line", width)


def _item() -> Column:
    return F.concat(F.col("l_orderkey").cast("string"), F.lit("_"), F.col("l_linenumber").cast("string"))


_ITEMS = "(SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, min(l_quantity) AS l_quantity, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1, 2)"


@query(f"""SELECT 'u' || l_orderkey || '_' || l_linenumber AS name, CAST(row_number() OVER (ORDER BY l_orderkey, l_linenumber) AS INT) AS number, 'G_' || l_returnflag AS master,
'n' || l_partkey AS a, 's;' || l_suppkey AS y FROM {_ITEMS}""")
def q_netlist_ranges(spark, sf_dir):
    """One netlist of all order lines, in many tasks: statements of three lines with a comment and a name that hold semicolons."""
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    rows = blocks.netlist(_one_text(
        spark, sf_dir, "/net/all.v", "module top (a); input a; /* open", "*/ endmodule", text("; */ G_", F.col("l_returnflag"), " u", _item(), " ( .A(n", F.col("l_partkey"), "), // u1 (;"),
        text(" .Y(\\s;", F.col("l_suppkey"), " ) )"), text("; /* ;"),
    )).where("number > 0")
    pin = lambda p: F.max(F.when(F.col("pin") == p, F.col("net")))
    return rows.groupBy("name", "number", "master").agg(pin("A").alias("a"), pin("Y").alias("y"))


@query(f"SELECT 'C' || l_orderkey || '_' || l_linenumber AS name, l_quantity AS area, l_returnflag = 'R' AS is_seq, 'A' || l_partkey || ' {{' AS function FROM {_ITEMS}")
def q_liberty_ranges(spark, sf_dir):
    """One library with a cell for every order line, in many tasks: groups over several lines, braces in strings and comments."""
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    rows = blocks.liberty(_one_text(
        spark, sf_dir, "/lib/all.lib", 'library (l) { note : "a { b";', "}", text("cell (C", _item(), ") { /* } */ area : ", F.col("l_quantity"), ";"),
        text('pin (Y) { direction : output; function : "A', F.col("l_partkey"), ' {";'), text(F.when(F.col("l_returnflag") == "R", "} ff (IQ) { } }").otherwise("} } // {")),
    ))
    return rows.select("name", "area", "is_seq", F.col("functions")[0]["function"].alias("function"))


def _netlist_lines(spark, sf_dir, sequential: bool = False):
    """One module of all cells of the synthetic tree, instances in the order of their numbers, by ranges of 5 001 lines."""
    cells, _ = _graph(spark, sf_dir, keep_sequential=True)
    i = lambda c: c.cast("string")
    master = F.when(F.col("is_seq") & F.lit(sequential), "DFF").otherwise(F.concat(F.lit("G_"), F.regexp_replace("gate", "[^A-Za-z0-9]", "_")))
    line = F.concat(
        master, F.lit(" u"), i(F.col("id")), F.lit(" ( .A(n"), i(2 * F.col("id")), F.lit("), .B(\\n"), i(2 * F.col("id") + 1), F.lit(" ), .Y(n"), i(F.col("id")), F.lit(") );")
    )
    ends = spark.range(2).select(F.when(F.col("id") == 0, F.lit(0)).otherwise(F.lit(1 << 60)).alias("id"), F.when(F.col("id") == 0, "// net\nmodule top (n1);\noutput n1;\nwire x;").otherwise("endmodule").alias("line"))
    rows = cells.select("id", line.alias("line")).union(ends.select("id", F.explode(F.split("line", "\n")).alias("line")).withColumn("id", F.when(F.col("line").startswith("//"), -3).when(F.col("line").startswith("module"), -2).when(F.col("line").startswith("output"), -1).otherwise(F.col("id"))))
    return ranges.of_table(rows, "/net/top.v", "id", "line", 5001)


def _masters(spark, sf_dir):
    """A library of the six gates of the tree and a flip-flop, scanned from its text."""
    gates = table(spark, sf_dir, "part").where("p_partkey > 0").select(F.col("p_type").alias("gate")).distinct()
    listed = gates.agg(F.array_sort(F.collect_list("gate")).alias("g"))
    functions = F.array(*map(F.lit, ["!(A*B)", "!(A+B)", "A*B", "A|B", "A^B", "(A^B)'"]))
    cell = F.transform("g", lambda x, k: F.concat(
        F.lit("cell (G_"), F.regexp_replace(x, "[^A-Za-z0-9]", "_"), F.lit(') { area : 1; pin (A) { direction : input; } pin (B) { direction : input; } pin (Y) { direction : output; function : "'), F.element_at(functions, k + 1), F.lit('"; } }'),
    ))
    flop = 'cell (DFF) { area : 4; ff (IQ, IQN) { } pin (A) { direction : input; } pin (B) { direction : input; } pin (Y) { direction : output; function : "IQ"; } }'
    return blocks.liberty(listed.select(F.lit("/lib/all.lib").alias("path"), F.concat(F.lit("library (l) {\n"), F.array_join(cell, "\n"), F.lit(f"\n{flop}\n}}")).alias("text")))


def _mined(spark, sf_dir):
    """Library text and netlist text to clusters with their truth tables."""
    masters = saved(_masters(spark, sf_dir))
    rows = saved(blocks.netlist(_netlist_lines(spark, sf_dir, sequential=True)))
    cells, edges = graph.load(rows, masters)
    cells, edges = saved(cells), saved(edges)
    comb = cells.where("NOT is_seq")
    found, _ = graph.expand(comb.withColumn("n_ports", F.lit(0)), edges, saved, roots=graph.roots(comb, masters))
    tables = blocks.light(masters).select(F.col("name").alias("master"), "inputs", expr.truth_table(F.col("function"), F.col("inputs")).alias("tt"))
    nets = edges.groupBy("load").agg(F.array_sort(F.collect_list(F.struct("term", "driver"))).alias("p")).select(F.col("load").alias("id"), F.expr("transform(p, x -> x.driver)").alias("nets"))
    gates = comb.join(nets, "id").join(F.broadcast(tables), "master").select("id", "tt", "nets")
    return graph.evaluate(found, gates)


def _canonical_sql(n: int) -> str:
    return "least(" + ", ".join(forms_sql("tt", n, [0], [0])) + ")"


@query(f"""WITH t AS ({cone_sql.truth_table()}), k AS (SELECT CASE length(tt) WHEN 4 THEN {_canonical_sql(2)} WHEN 8 THEN {_canonical_sql(3)} WHEN 16 THEN {_canonical_sql(4)} END AS p FROM t)
SELECT '0b' || p AS p_key, count(*) AS cnt FROM k GROUP BY 1""")
def q_library_netlist_patterns(spark, sf_dir):
    """From the text of a library and of a netlist to pattern counts."""
    t = canonical.classified(saved(_mined(spark, sf_dir).select("tt")))
    out = t.select(F.concat(F.lit("0b"), "p").alias("p_key"))
    return clusters.frequency(out)


@query("WITH p AS (SELECT p_partkey AS id, p_brand = (SELECT min(p_brand) FROM part WHERE p_partkey > 0) AS seq FROM part WHERE p_partkey > 0) SELECT 'cells' AS what, count(*) AS n FROM p UNION ALL SELECT 'sequential', count(*) FILTER (WHERE seq) FROM p UNION ALL SELECT 'inner edges', count(*) FROM p x JOIN p y ON y.id = x.id // 2 WHERE NOT x.seq AND NOT y.seq UNION ALL SELECT 'open inputs', count(*) FROM (SELECT id, unnest([2 * id, 2 * id + 1]) AS d FROM p WHERE NOT seq) WHERE d NOT IN (SELECT id FROM p WHERE NOT seq)")
def q_graph_load(spark, sf_dir):
    cells, edges = graph.load(blocks.netlist(_netlist_lines(spark, sf_dir, sequential=True)), _masters(spark, sf_dir))
    one = lambda df, what: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    return one(cells, "cells").union(one(cells.where("is_seq"), "sequential")).union(one(edges.where("driver > 0"), "inner edges")).union(one(edges.where("driver < 0"), "open inputs"))


@query("SELECT 'u' || p_partkey AS name, CAST(p_partkey AS INT) AS number, 'n' || p_partkey AS y, 'n' || (2 * p_partkey + 1) AS b FROM part WHERE p_partkey > 0")
def q_netlist_scan(spark, sf_dir):
    rows = blocks.netlist(_netlist_lines(spark, sf_dir)).where("number > 0")
    pin = lambda p: F.max(F.when(F.col("pin") == p, F.col("net")))
    return rows.groupBy("name", "number").agg(pin("Y").alias("y"), pin("B").alias("b"))


@query("""SELECT 's' || s_suppkey || CASE k WHEN 0 THEN '/g' WHEN 1 THEN '/h' ELSE '/t' END AS name, ['INV', 'BUF', 'TIE'][k + 1] AS master,
CASE k WHEN 0 THEN 's' || s_suppkey || '/m' WHEN 1 THEN 'n' || (s_suppkey + 1) ELSE 's' || s_suppkey || '/z' END AS net FROM supplier CROSS JOIN (SELECT unnest(range(0, 3)) AS k) WHERE k < 2 OR s_suppkey % 3 = 0""")
def q_netlist_flatten(spark, sf_dir):
    """One netlist with a chain of modules, one for each supplier; every third is of another kind."""
    sub = "module sub (i, o); input i; output o; INV g (.A(i), .Y(m)); BUF h (.A(m), .Y(o)); endmodule"
    wide = sub.replace("sub", "wide").replace(" endmodule", " TIE t (.Y(z)); endmodule")
    k = F.col("s_suppkey")
    line = F.concat(F.when(k % 3 == 0, "wide").otherwise("sub"), F.lit(" s"), k.cast("string"), F.lit(" (.i(n"), k.cast("string"), F.lit("), .o(n"), (k + 1).cast("string"), F.lit("));"))
    ends = spark.range(2).select(F.when(F.col("id") == 0, F.lit(-1)).otherwise(F.lit(1 << 60)).alias("no"), F.when(F.col("id") == 0, f"{sub} {wide} module top (a);").otherwise("endmodule").alias("line"))
    rows = blocks.netlist(ranges.of_table(table(spark, sf_dir, "supplier").select(k.alias("no"), line.alias("line")).union(ends), "/net/chain.v", "no", "line", 31))
    return blocks.flattened(rows, "top").where("pin = 'Y'").select("name", "master", "net")


@query("""SELECT 'i' || c_custkey AS name, CASE WHEN c_custkey % 3 > 0 THEN c_custkey / 10.0 END AS x, CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 100 / 10.0 END AS y, CAST(n_nationkey AS DOUBLE) AS hi_x FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def q_placement_scan(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    place = F.when(F.col("c_custkey") % 3 > 0, F.concat(F.when(F.col("c_custkey") % 2 == 0, " + PLACED ( ").otherwise(" + FIXED ( "), (F.col("c_custkey") * 100).cast("string"), F.lit(" "), (F.col("c_custkey") % 100 * 100).cast("string"), F.lit(" ) N"))).otherwise("")
    line = F.concat(F.lit("- i"), F.col("c_custkey").cast("string"), F.lit(" G"), place, F.lit(" ;"))
    listed = c.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.array_join(F.collect_list(line), "\n").alias("l"))
    size = (_k() * 1000).cast("string")
    text = F.concat(F.lit("DESIGN d ;\nUNITS DISTANCE MICRONS 1000 ;\nDIEAREA ( 0 0 ) ( 0 5000 ) ( "), size, F.lit(" 5000 ) ;\nCOMPONENTS 2 ;\n"), F.col("l"), F.lit("\nEND COMPONENTS\nEND DESIGN\n"))
    files = listed.select(F.concat(F.lit("/def/"), _k().cast("string"), F.lit(".def")).alias("path"), text.alias("text"))
    names_ = c.select(F.concat(F.lit("/def/"), F.col("c_nationkey").cast("string"), F.lit(".def")).alias("path"), F.concat(F.lit("i"), F.col("c_custkey").cast("string")).alias("name"))
    joined = blocks.placed(names_, blocks.placement(files)).join(blocks.die_area(files), "path")
    return joined.select("name", "x", "y", "hi_x")


@query("SELECT 'M' || n_nationkey AS name, n_nationkey / 10.0 AS width, 0.5 AS height, 'core' AS site, 3 AS symmetry FROM nation")
def q_layout_scan(spark, sf_dir):
    n = F.col("n_nationkey").cast("string")
    text = F.concat(F.lit("VERSION 5.8 ;\nMACRO M"), n, F.lit("\n CLASS CORE ;\n SIZE "), F.round(_k() / 10, 1).cast("string"), F.lit(" BY 0.5 ;\n SYMMETRY X Y ;\n SITE core ;\nEND M"), n, F.lit("\nEND LIBRARY\n"))
    return blocks.macros(_files(spark, sf_dir, text, "/lef/{}.lef")).select("name", "width", "height", "site", "symmetry")


#: Circuits: an inverter, a NAND, a buffer of two stages and an AND-OR-INVERT, by nation key modulo 4.
_CIRCUITS = {
    "INV": ("A Y VDD VSS", ["Y A VDD VDD p", "Y A VSS VSS n"]),
    "NAND2": ("A B Y VDD VSS", ["Y A VDD VDD p", "Y B VDD VDD p", "Y A m VSS n", "m B VSS VSS n"]),
    "BUF": ("A Y VDD VSS", ["i A VDD VDD p", "i A VSS VSS n", "Y i VDD VDD p", "Y i VSS VSS n"]),
    "AOI21": ("A B C Y VDD VSS", ["p A VDD VDD p", "p B VDD VDD p", "Y C p VDD p", "Y A m VSS n", "m B VSS VSS n", "Y C VSS VSS n"]),
}


def _circuit_files(spark, sf_dir):
    n = F.col("n_nationkey").cast("string")
    text = F
    for k, (name, (pins, devices)) in enumerate(_CIRCUITS.items()):
        body = "\n".join(f"M{i} {d[:-2]} {d[-1]}mos_rvt\n+ w=46n l=20n nfin=2" for i, d in enumerate(devices))
        text = text.when(_k() % 4 == k, F.concat(F.lit(f"* {name}\n.SUBCKT {name}_"), n, F.lit(f"_X1 {pins}\n{body}\n.ENDS\n")))
    return _files(spark, sf_dir, text, "/cdl/{}.cdl")


def _devices(spark, sf_dir):
    return blocks.circuits(_circuit_files(spark, sf_dir))


_KIND = "CASE n_nationkey % 4 WHEN 0 THEN 'INV' WHEN 1 THEN 'NAND2' WHEN 2 THEN 'BUF' ELSE 'AOI21' END"
_CELL = f"{_KIND} || '_' || n_nationkey || '_X1'"


def _by_kind(inv, nand, buf, aoi) -> str:
    return f"CASE n_nationkey % 4 WHEN 0 THEN {inv} WHEN 1 THEN {nand} WHEN 2 THEN {buf} ELSE {aoi} END"


@query(f"SELECT {_CELL} AS cell, {_by_kind(1, 2, 2, 3)} AS devices_n, {_by_kind(1, 2, 2, 3)} AS devices_p, {_by_kind(0, 0, 0, 0)} AS breaks_n, {_by_kind(2, 4, 4, 6)} AS cpp_min FROM nation")
def q_transistor_counts(spark, sf_dir):
    rows = transistors.counts(_devices(spark, sf_dir), 40e-9, 40e-9)
    return rows.select("cell", F.col("devices_n").cast("int").alias("devices_n"), F.col("devices_p").cast("int").alias("devices_p"), F.col("breaks_n").cast("int").alias("breaks_n"), F.col("cpp_min").cast("int").alias("cpp_min"))


@query(f"SELECT {_CELL} AS cell, CAST({_by_kind(1, 2, 2, 3)} AS BIGINT) AS n_nmos, {_by_kind(2.0, 4.0, 4.0, 6.0)}::DOUBLE AS nfin_p, 1.0::DOUBLE AS nfin_ratio, CAST({_by_kind(1, 2, 1, 2)} AS BIGINT) AS max_stack_n, CAST({_by_kind(1, 1, 1, 2)} AS BIGINT) AS max_stack_p, CAST({_by_kind(0, 1, 1, 2)} AS BIGINT) AS n_internal FROM nation")
def q_transistor_features(spark, sf_dir):
    return transistors.features(_devices(spark, sf_dir), 2).select("cell", "n_nmos", "nfin_p", "nfin_ratio", "max_stack_n", "max_stack_p", "n_internal")


@query(f"""SELECT {_CELL} AS cell, {_by_kind("'10'", "'1110'", "'01'", "'10101000'")} AS bits, {_by_kind("'!A'", "'!B + !A'", "'A'", "'!B*!C + !A*!C'")} AS expr, CAST({_by_kind(1, 1, 2, 1)} AS BIGINT) AS stages,
round(20.0 / 46 * {_by_kind(1, 1, 2, 1)}, 6) AS r_min, round(20.0 / 46 * {_by_kind(1, 2, 2, 2)}, 6) AS r_max FROM nation""")
def q_transistor_functions(spark, sf_dir):
    rows = transistors.functions(_devices(spark, sf_dir))
    return rows.select("cell", "bits", "expr", "stages", F.round("r_min", 6).alias("r_min"), F.round("r_max", 6).alias("r_max"))


@query(f"""SELECT {_CELL} AS cell, pin, role, n FROM nation, LATERAL (SELECT * FROM (VALUES ('INV', 'A', 'input', 0), ('INV', 'Y', 'output', 1), ('NAND2', 'A', 'input', 0), ('NAND2', 'B', 'input', 0), ('NAND2', 'Y', 'output', 2),
('BUF', 'A', 'input', 0), ('BUF', 'Y', 'output', 1), ('AOI21', 'A', 'input', 0), ('AOI21', 'B', 'input', 0), ('AOI21', 'C', 'input', 0), ('AOI21', 'Y', 'output', 2)) v(kind, pin, role, n) WHERE v.kind = {_KIND})""")
def q_transistor_roles(spark, sf_dir):
    rows = _devices(spark, sf_dir)
    up = transistors.paths(rows).where("polarity = 'p'").select("cell", "pin", F.col("n_paths").cast("int").alias("n"))
    return transistors.roles(rows).join(up, ["cell", "pin"]).select("cell", "pin", "role", "n")


@query(f"""SELECT {_CELL} AS cell, stage, n_up, feeding, depth FROM nation, LATERAL (SELECT * FROM (VALUES ('INV', 'Y', 1, 'A', 1), ('NAND2', 'Y', 2, 'A,B', 1), ('BUF', 'Y', 1, 'i', 2), ('BUF', 'i', 1, 'A', 1), ('AOI21', 'Y', 2, 'A,B,C', 1)) v(kind, stage, n_up, feeding, depth) WHERE v.kind = {_KIND})""")
def q_transistor_stages(spark, sf_dir):
    return transistors.stages(_devices(spark, sf_dir)).select("cell", "stage", F.col("n_up").cast("int").alias("n_up"), "feeding", F.col("depth").cast("int").alias("depth"))


@query(f"SELECT {_KIND} || '_' || n_nationkey || '_X2' AS cell, {_by_kind(2, 4, 4, 6)} * 4.0::DOUBLE AS fins, round({_by_kind(2, 4, 4, 6)} * 92.0, 6)::DOUBLE AS width FROM nation")
def q_drive_doubling(spark, sf_dir):
    rows = blocks.circuits(transistors.doubled(_circuit_files(spark, sf_dir)))
    return rows.groupBy("cell").agg(F.sum("fins").alias("fins"), F.round(F.sum("w") * 1e9, 6).alias("width"))


# ---------------------------------------------------------------- line scans


def _lines(spark, sf_dir, *parts, path="/run/{}/route/report"):
    return _files(spark, sf_dir, F.array_join(F.array(*parts), "\n"), path)


@query("SELECT n_nationkey AS k, '0b' || lpad(bin(n_nationkey % 16), 4, '0') AS canonical, 'clst' || n_nationkey AS cluster, CAST(n_nationkey + 1 AS INT) AS second FROM nation UNION ALL SELECT n_nationkey, '0b01', 'clst9', 4 FROM nation")
def q_pattern_block_scan(spark, sf_dir):
    n = F.col("n_nationkey").cast("string")
    files = _lines(spark, sf_dir, F.concat(F.lit("canonical_key=0b"), F.lpad(F.bin(_k() % 16), 4, "0")), F.lit("count=1"), F.concat(F.lit("clst"), n, F.lit(": "), n, F.lit(" "), (_k() + 1).cast("string")), F.lit("inputs: a b"), F.lit(""), F.lit("canonical_key=0b01"), F.lit("clst9: 3 4"), path="/run/{}/p.txt")
    return lines.pattern_blocks(files).select(F.regexp_extract("path", r"/(\d+)/", 1).cast("int").alias("k"), "canonical", "cluster", F.element_at("cells", 2).alias("second"))


@query(f"""SELECT last_value(CASE WHEN l_linenumber % 3 = 0 THEN '0b' || bin(l_partkey % 16) END IGNORE NULLS) OVER (ORDER BY l_orderkey, l_linenumber) AS canonical,
'clst' || (l_orderkey * 8 + l_linenumber) AS cluster, CAST(l_suppkey AS INT) AS second FROM {_ITEMS}""")
def q_pattern_block_ranges(spark, sf_dir):
    """One file of pattern blocks with a line for every order line, in many tasks; every third line number begins a block."""
    cluster = (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("string")
    head = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("canonical_key=0b"), F.bin(F.col("l_partkey") % 16))).otherwise("count=1")
    text = _one_text(spark, sf_dir, "/run/all.txt", "# patterns", "", head, F.concat(F.lit("clst"), cluster, F.lit(": "), F.col("l_partkey").cast("string"), F.lit(" "), F.col("l_suppkey").cast("string")))
    return lines.pattern_blocks(text).select("canonical", "cluster", F.element_at("cells", 2).alias("second"))


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/scan-{uuid.uuid4().hex}"


@query("SELECT p_partkey AS key, CASE WHEN p_partkey % 7 > 0 THEN p_name || ',\"' || p_brand END AS name, CAST(p_size AS DOUBLE) AS size FROM part")
def q_csv_scan(spark, sf_dir):
    """Parts written as headed text with quotes, commas and empty fields, and scanned under a stated schema."""
    folder = _folder(spark)
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.when(F.col("p_partkey") % 7 > 0, F.concat("p_name", F.lit(',"'), "p_brand")).alias("name"), F.col("p_size").cast("double").alias("size"))
    rows.write.option("header", True).option("escape", '"').csv(folder)
    return lines.table(spark, folder, "key long, name string, size double", escape='"')


@query("SELECT o_orderstatus AS status, count(*) AS n_lines, count(DISTINCT o_custkey) AS n_names, CAST(0 AS BIGINT) AS n_others FROM orders GROUP BY 1")
def q_folder_scan(spark, sf_dir):
    """Lines of files below nested folders, found by their names and read by ranges; files of other names are left out."""
    folder = _folder(spark)
    orders = table(spark, sf_dir, "orders").select("o_orderstatus", F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("value"))
    orders.withColumn("day", F.pmod(F.xxhash64("value"), F.lit(3))).write.partitionBy("o_orderstatus", "day").text(f"{folder}/a/runs")
    orders.limit(1).select(F.lit("other").alias("value")).write.option("compression", "gzip").text(f"{folder}/b")
    rows = ranges.of_files(spark, folder, "*.txt")
    return rows.groupBy(F.regexp_extract("path", "o_orderstatus=(.)", 1).alias("status")).agg(
        F.count("*").alias("n_lines"), F.countDistinct("value").alias("n_names"), F.count(F.when(F.col("value") == "other", 1)).alias("n_others")
    )


@query("""WITH RECURSIVE m AS MATERIALIZED (SELECT q AS x, floor(sum(s) / sum(n)) AS y FROM (SELECT DISTINCT l_quantity AS q FROM lineitem) JOIN (SELECT l_quantity AS l, sum(l_quantity) AS s, count(*) AS n FROM lineitem GROUP BY 1) ON l <= q GROUP BY q),
s(step, value, done) AS (SELECT 0, CAST(50 AS DOUBLE), false UNION ALL SELECT step + 1, y, y = value FROM s JOIN m ON m.x = s.value WHERE NOT done AND step < 20)
SELECT step, value FROM s""")
def q_converged_quantity(spark, sf_dir):
    """A loop of queries: the mean quantity of all lines up to the last mean, until it repeats."""
    rows = table(spark, sf_dir, "lineitem").select("l_quantity")
    mean = lambda x: float(rows.where(F.col("l_quantity") <= x).agg(F.floor(F.sum("l_quantity") / F.count("*")).alias("m")).first().m)
    return spark.createDataFrame(list(enumerate(search.converge(50.0, mean))), "step int, value double")


@query("""WITH o AS (SELECT l_orderkey, list_sort(list_distinct(list(l_partkey))) AS p FROM lineitem GROUP BY 1 HAVING l_orderkey % 10 > 0), i AS (SELECT p, unnest(range(1, len(p) + 1)) AS i FROM o),
x AS (SELECT 'star' AS mode, p[1] AS a, p[i] AS b FROM i WHERE i > 1 UNION ALL SELECT 'pairs', j.p[j.i], j.p[k] FROM (SELECT p, i, unnest(range(i + 1, len(p) + 1)) AS k FROM i) j)
SELECT mode, 'clst' || a AS a, 'clst' || b AS b, count(*) AS n FROM x GROUP BY ALL""")
def q_overlap_line_scan(spark, sf_dir):
    """One file with a line of clusters for every order, its parts; every tenth line is a comment."""
    parts = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_set("l_partkey")), lambda x: F.concat(F.lit("clst"), x.cast("string"))), " ").alias("p"))
    text = ranges.of_table(parts.select("l_orderkey", F.concat(F.when(F.col("l_orderkey") % 10 == 0, "# ").otherwise(""), "p").alias("line")), "/run/all.txt", "l_orderkey", "line", 4001)
    return lines.overlap_counts(saved(text))


@query(f"SELECT 'G_' || l_returnflag || '_X' || l_linenumber AS cell, count(*) AS n FROM {_ITEMS} GROUP BY 1")
def q_cell_count_scan(spark, sf_dir):
    """One netlist with an instance for every order line, among lines that only look like one."""
    cell = F.concat(F.lit("  G_"), F.col("l_returnflag"), F.lit("_X"), F.col("l_linenumber").cast("string"), F.when(F.col("l_partkey") % 2 == 0, "cdl").otherwise(""), F.lit(" u1 (.A(a));"))
    other = F.element_at(F.array(*map(F.lit, ["  input a;", "  integer i;", "  if (a) begin", "  end else begin", "  case x", "  tri t;"])), (F.col("l_suppkey") % 6 + 1).cast("int"))
    return lines.cell_counts(_one_text(spark, sf_dir, "/net/all.v", "module top (a);", "endmodule", other, cell), suffix="cdl").select("cell", F.col("cnt").alias("n"))


@query("SELECT n_nationkey AS k, n_nationkey * -0.5 AS slack_in2reg, 500.0 + n_nationkey AS freq_mhz, -0.25 AS slack_clock, n_nationkey * 2.0 AS cell_area, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey ELSE 0 END AS total, CASE WHEN n_nationkey % 4 = 0 THEN 3 ELSE 0 END AS shorts FROM nation")
def q_report_scan(spark, sf_dir):
    s = lambda c: c.cast("string")
    files = _lines(
        spark, sf_dir, F.lit("Report"), F.concat(F.lit("Summary, "), s(_k() * -0.5), F.lit(", 0, 0, "), s(_k() + 500.0), F.lit(" MHz, -0.25")), F.lit("CAP, FANOUT, x"), F.concat(F.lit("1, 2, 3, 4, "), s(_k() * 2.0)),
        F.when(_k() % 2 == 0, F.concat(F.lit("Design : top  "), s(_k()))).otherwise("No DRCs to report"), F.when(_k() % 4 == 0, F.concat(F.lit(" " * 12), F.lit("Short   3"))).otherwise("-"),
    )
    rows = lines.quality(files).join(lines.violations(files), "path")
    return rows.select(F.regexp_extract("path", r"/(\d+)/", 1).cast("int").alias("k"), "slack_in2reg", "freq_mhz", "slack_clock", "cell_area", "total", "shorts")


@query("SELECT tag, count(*) AS n FROM (SELECT CASE n_nationkey % 3 WHEN 0 THEN 'license' WHEN 1 THEN 'memory' ELSE 'other' END AS tag FROM nation) GROUP BY 1")
def q_log_tag_scan(spark, sf_dir):
    files = _lines(spark, sf_dir, F.lit("Information: fine"), F.when(_k() % 3 == 0, "Error: no license and no memory").when(_k() % 3 == 1, "Error: out of memory (MEM-1)").otherwise("Error: x"), F.lit(" Error: indented"))
    return lines.error_counts(lines.first_tag(files, [("license", "license"), ("memory", "memory")])).groupBy("tag").agg(F.sum("n").alias("n"))


@query("SELECT 'route' AS step, CAST(min(n_nationkey) AS VARCHAR) AS area, CAST(NULL AS VARCHAR) AS power FROM nation")
def q_stage_summary(spark, sf_dir):
    files = _lines(spark, sf_dir, F.concat(F.lit("Total area: "), _k().cast("string")), path="/run/route/r{}")
    rows = lines.stage_summary(files, [("area", r"Total area:\s+(\d+)"), ("power", r"Total power:\s+(\d+)")])
    return rows


_LOG_RULES = {"included outside of the bounds": 1, "state without verdict": 2, "unknown reason": 3, "depth within its bound": 4, "size within its bound": 5, "outputs within their bound": 6, "verdict without state": 7, "two verdicts": 8}


@query(f"""WITH {cone_sql.GRAPH}, c AS ({cone_sql.expand().split(cone_sql.GRAPH, 1)[1]}), s AS (SELECT count(*) AS n FROM c WHERE root % 10 = 9 AND n_cells <= 3)
SELECT rule, count(g.id) AS n FROM (VALUES {', '.join(f"('{r}', {k})" for r, k in _LOG_RULES.items())}) v(rule, k) LEFT JOIN g ON g.id % 10 = k GROUP BY 1 UNION ALL SELECT 'skipped within the bounds', n FROM s""")
def q_log_consistency(spark, sf_dir):
    """The log of the general search over the tree with faults of every kind, by the last digit of the root, held against its rules."""
    from netmine.operators import explore

    cells, edges = _tree_nets(spark, sf_dir)
    bounds = explore.Bounds(max_cells=3)
    found = saved(explore.search(cells, edges.select("driver", "load"), saved, bounds))
    digit, single = F.col("root") % 10, F.size("cells") == 1
    fault = F.when(single, F.element_at(F.create_map(*[F.lit(x) for kv in {1: "include", 2: "missing", 3: "prune:odd", 4: "prune:max_depth", 5: "prune:max_cells", 6: "prune:max_outputs"}.items() for x in kv]), digit.cast("int")))
    log = found.select("root", "cells", F.coalesce(fault, F.when((digit == 9) & (F.col("verdict") == "include"), "skip:bounds"), "verdict").alias("verdict"))
    extra = log.where(single & (digit == 7)).select("root", F.array(-F.col("root")).alias("cells"), F.lit("skip:bounds").alias("verdict"))
    log = log.where("verdict <> 'missing'").union(extra).union(log.where(single & (digit == 8)))
    return checks.log_violations(found.drop("verdict"), log, {k: getattr(bounds, k) for k in ("min_cells", "max_cells", "min_inputs", "max_inputs", "max_outputs", "max_depth")})


def _tree_nets(spark, sf_dir):
    """Cells of the tree (id, gate, x, y) and their pins (driver, load, term); a net without a cell has a number of its own below 0."""
    cells, _ = _graph(spark, sf_dir)
    pins = F.array(F.struct((2 * F.col("id")).alias("net"), F.lit("A").alias("term")), F.struct((2 * F.col("id") + 1).alias("net"), F.lit("B").alias("term")))
    nets = cells.select("id", F.explode(pins).alias("p")).select("id", "p.net", "p.term").join(cells.select(F.col("id").alias("net"), F.lit(True).alias("there")), "net", "left")
    edges = nets.select(F.when(F.col("there"), F.col("net")).otherwise(-F.col("net")).alias("driver"), F.col("id").alias("load"), "term")
    return cells.select("id", "gate", F.lit(0.0).alias("x"), F.lit(0.0).alias("y")), edges


@query(cone_sql.expand())
def q_cone_replay(spark, sf_dir):
    """The clusters of the tree, searched for one cell of each cone and replayed on the others."""
    from netmine.operators import explore

    cells, edges = _tree_nets(spark, sf_dir)
    found = explore.replay(cells, edges, saved).where("verdict = 'include'")
    text = F.array_join(F.col("cells").cast("array<string>"), ",").alias("cells")
    return found.select("root", text, *[F.col(c).cast("long").alias(c) for c in ("n_cells", "depth", "n_inputs")])


@query(f"SELECT 'three' AS what, count(*) AS n FROM part WHERE p_partkey % 256 > 0 AND {P3.replace('tt', 'lpad(bin(p_partkey % 256), 8, ' + chr(39) + '0' + chr(39) + ')')} = '00010111'")
def q_target_filter(spark, sf_dir):
    from netmine.operators import explore

    part = table(spark, sf_dir, "part").where("p_partkey % 256 > 0").select(F.pmod("p_partkey", F.lit(256)).cast("long").alias("value"))
    keyed = part.join(space.p_dim(spark, 3), "value").select(truth.key_column(F.col("p"), 3).alias("p_key"))
    wanted = spark.createDataFrame([("0b00010111",)], "p_key string")
    return explore.only(keyed, wanted).agg(F.count("*").alias("n")).select(F.lit("three").alias("what"), "n")
