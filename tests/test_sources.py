import pytest
from pyspark.sql import functions as F

from netmine.sources import blocks, lines
from netmine.streaming import payloads


def files(spark, *texts):
    return spark.createDataFrame([(f"f{i}", t) for i, t in enumerate(texts)], "path string, text string")


def test_liberty(spark):
    text = """library (x) { /* c */
      cell (AND2) { area : 1.5; pin (A) { direction : input; } pin ("B") { direction : "input"; } pin (Y) { direction : output; function : "(A * B)"; timing () { related_pin : "A"; } }
        pin (z) { direction : internal; } }
      cell (DFF) { area : 4; ff (IQ, IQN) { next_state : "D"; } pin (D) { direction : input; } } }"""
    rows = {r.name: r for r in blocks.liberty(files(spark, text)).collect()}
    assert rows["AND2"].area == 1.5 and not rows["AND2"].is_seq and rows["DFF"].is_seq
    assert [(p.name, p.direction) for p in rows["AND2"].pins] == [("A", "input"), ("B", "input"), ("Y", "output")]
    assert [(f.pin, f.function) for f in rows["AND2"].functions] == [("Y", "(A * B)")]


def test_netlist_and_connections(spark):
    text = """module top (a, b, y); // ports
      input a, b; output y; wire n1;
      NAND2 u1 (.A(a), .B(b), .Y(n1));
      INV u2 (.A(n1), .Y(y)); INV u3 (.A(1'b0), .Y()); endmodule"""
    rows = blocks.netlist(files(spark, text))
    assert {(r.number, r.pin, r.net) for r in rows.collect() if r.number} == {(1, "A", "a"), (1, "B", "b"), (1, "Y", "n1"), (2, "A", "n1"), (2, "Y", "y"), (3, "A", "$const$0"), (3, "Y", "")}
    pins = spark.createDataFrame([(m, p, "output" if p == "Y" else "input") for m, ps in (("NAND2", "ABY"), ("INV", "AY")) for p in ps], "master string, pin string, direction string")
    assert [(r.driver, r.load, r.term) for r in blocks.connections(rows, pins).collect()] == [(1, 2, "A")]
    with pytest.raises(Exception, match="no direction"):
        blocks.connections(rows, pins.where("master = 'INV'")).collect()


def test_layout_and_circuits(spark):
    text = "UNITS DISTANCE MICRONS 1000 ;\nCOMPONENTS 2 ;\n- u1 INV + PLACED ( 1500 -250 ) N ;\n- u2 BUF ;\nEND COMPONENTS"
    assert [(r.name, r.x, r.y) for r in blocks.placement(files(spark, text)).collect()] == [("u1", 1.5, -0.25), ("u2", None, None)]
    macro = "MACRO INV\n SIZE 0.5 BY 1.2 ;\n SYMMETRY X Y ;\n SITE core ;\nEND INV"
    assert [(r.name, r.width, r.height, r.site, r.symmetry) for r in blocks.macros(files(spark, macro)).collect()] == [("INV", 0.5, 1.2, "core", 3)]
    circuit = ".SUBCKT INV A Y VDD VSS\nM1 Y A VDD VDD pfet w=46n l=20n\n+ nfin=2\nM2 Y A VSS VSS nfet w=46n l=20n m=3\n.ENDS"
    rows = blocks.transistors(files(spark, circuit))
    assert {(r.name, r.fins) for r in rows.collect()} == {("M1", 2.0), ("M2", 3.0)}
    c = blocks.transistor_counts(rows).first()
    assert (c.n_nmos, c.n_pmos, c.nfin_n, c.nfin_p) == (1, 1, 3.0, 2.0)
    assert blocks.number("2meg") == 2e6
    with pytest.raises(ValueError):
        blocks.number("2x")


def test_lines(spark, tmp_path):
    text = "# x\ncanonical_key=0b01\nclst1: 1,2\nclst2: 3\nother\ncanonical_key=0b10\nclst3: 4 5"
    got = [(r.canonical, r.cluster, list(r.cells)) for r in lines.pattern_blocks(files(spark, text)).orderBy("cluster").collect()]
    assert got == [("0b01", "clst1", [1, 2]), ("0b01", "clst2", [3]), ("0b10", "clst3", [4, 5])]
    over = files(spark, "# c\nclst1 clst2 clst3")
    assert {tuple(r) for r in lines.overlap_lines(over, "star").collect()} == {("clst1", "clst2"), ("clst1", "clst3")}
    assert lines.overlap_lines(over).count() == 3
    log = files(spark, "Error: out of memory\nok\nError: odd\nCAP, FANOUT\n3, 4\nk=v")
    assert {(r.tag, r.n) for r in lines.error_counts(lines.first_tag(log, [("memory", "memory")])).collect()} == {("memory", 1), ("other", 1)}
    assert lines.next_line(log, "CAP").first().fields == ["3", "4"]
    assert lines.properties(log).select("key", "value").collect() == [("k", "v")]
    assert {(r.cell, r.cnt) for r in lines.cell_counts(files(spark, "module t (a);\n INV u1 (.A(a));\n INV u2 (.A(b));\nwire x;")).collect()} == {("INV", 2)}
    (tmp_path / "t.csv").write_text("a,b\n1,x\n")
    assert lines.table(spark, str(tmp_path / "t.csv"), "a int, b string").collect() == [(1, "x")]
    with pytest.raises(Exception):
        lines.table(spark, str(tmp_path / "t.csv"), "c int, b string").collect()


def test_payload_stream(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    rows = lambda x: spark.createDataFrame(x, "k int, at int, v string").coalesce(1)
    rows([(1, 1, "a"), (2, 1, "b")]).write.parquet(source)
    for _ in range(2):
        payloads.follow(spark, source, rows([]).schema, target, "k", "at", str(tmp_path / "cp")).awaitTermination()
        rows([(2, 2, "B"), (3, 1, "c")]).write.mode("append").parquet(source)
    assert sorted(tuple(r) for r in payloads.latest(spark, target).collect()) == [(1, 1, "a"), (2, 2, "B"), (3, 1, "c")]
