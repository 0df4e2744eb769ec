"""Scans by ranges: any split gives the same rows, from files and from lines of a table."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from netmine.sources import blocks, lines, ranges


def library(rng, n):
    parts = ['/* { " */ library (l) {', ' date : "x"; // }', ' lu_table_template (grid) { variable_1 : "a { b"; }']
    for i in range(n):
        parts.append(f' cell (C{i}) {{')
        parts += [" /* open {", " still } */"] * rng.randint(0, 2)
        parts += [f" area : {i}.5;", ' note : "quoted \\" } \\', ' more // no comment {";'] if rng.random() < 0.5 else [f" area : {i}.5;"]
        parts.append(' pin (A) { direction : input; } pin (Y) { direction : output; function : "!A"; } ' + ("ff (IQ) { } }" if i % 3 == 0 else "}"))
    return "\n".join([*parts, "}", ""])


def netlist(rng, n):
    parts = []
    for m in range(3):
        parts += ["(* keep ; *) module" if m == 1 else "module", f" m{m} (a, b);", "input a;", "/* endmodule ;", " ; */ wire w;"]
        for i in range(n):
            parts += [f"G{i % 4} \\u;{i} ( .A(n{i}), // ; endmodule", rng.choice(["", "(* x = 1; *)"]), f".Y(1'b0) );" + rng.choice(["", f" H v{i} (.Z(w));"])]
        parts.append("endmodule")
    return "\n".join([*parts, ""])


@pytest.fixture
def split(spark):
    key = "spark.sql.files.maxPartitionBytes"
    was = spark.conf.get(key)
    yield lambda n: spark.conf.set(key, str(n))
    spark.conf.set(key, was)


@pytest.mark.parametrize("scan, text", [(blocks.liberty, library), (blocks.netlist, netlist)])
def test_any_split_gives_the_same_rows(spark, split, tmp_path, scan, text):
    whole = text(random.Random(5), 12)
    (tmp_path / "a.txt").write_text(whole)
    (tmp_path / "b.txt").write_text(text(random.Random(6), 3))
    reread = lambda rows: sorted(map(repr, (tuple(r)[1:] for r in rows.collect())))
    texts = spark.createDataFrame([("a", whole), ("b", text(random.Random(6), 3))], "path string, text string")
    want = reread(scan(texts))
    assert len(want) > 12
    for size in (97, 1 << 20):
        split(size)
        lined = ranges.of_files(spark, str(tmp_path))
        assert lined.select("path", "block").distinct().count() > (10 if size == 97 else 1)
        assert reread(scan(lined)) == want
    for width in (3,):
        assert reread(scan(ranges.of_texts(texts, width))) == want


def test_numbers_and_modules(spark):
    rows = blocks.netlist(spark.createDataFrame([("p", netlist(random.Random(1), 5))], "path string, text string")).where("number > 0")
    for m in range(3):
        numbers = sorted({r.number for r in rows.where(F.col("module") == f"m{m}").collect()})
        assert numbers == list(range(1, len(numbers) + 1)) and len(numbers) >= 5
    first = rows.where("module = 'm0' AND number = 1").orderBy("pin").collect()
    assert [(r.name, r.master, r.pin, r.net) for r in first] == [("u;0", "G0", "A", "n0"), ("u;0", "G0", "Y", "$const$0")]


def test_open_text_raises(spark):
    for scan, text in ((blocks.liberty, "library (x) { cell (A) {"), (blocks.liberty, "library (x) { /* }"), (blocks.netlist, "module m (a); /*")):
        with pytest.raises(Exception, match="unbalanced"):
            scan(spark.createDataFrame([("p", text)], "path string, text string")).collect()


def test_empty_and_null_texts(spark):
    rows = spark.createDataFrame([("p", ""), ("q", None), ("r", "  \n ")], "path string, text string")
    assert blocks.liberty(rows).count() == 0 and blocks.netlist(rows).count() == 0


def test_headers_over_borders(spark, split, tmp_path):
    rng, text, want, head = random.Random(3), [], [], None
    for i in range(300):
        if rng.random() < 0.1:
            head = f"0b{i:b}"
            text.append(f"canonical_key={head}")
        text.append(f"clst{i}: {i} {i + 1}")
        want.append((head, f"clst{i}", [i, i + 1]))
    (tmp_path / "p.txt").write_text("\n".join(text))
    for size in (200, 1 << 20):
        split(size)
        got = [(r.canonical, r.cluster, list(r.cells)) for r in lines.pattern_blocks(ranges.of_files(spark, str(tmp_path))).collect()]
        assert sorted(got, key=lambda r: r[2]) == want


def test_merged_library(spark):
    text = lambda d, v, c: f'library (x) {{\n date : "{d}";\n lu_table_template (grid) {{ variable_1 : "{v}"; }}\n cell ({c}) {{ values (grid) {{ }} }}\n}}'
    rows = spark.createDataFrame([("a", text(1, "p", "A")), ("b", text(2, "q", "B")), ("c", text(3, "p", "C"))], "path string, text string")
    parts = [(r.variant, r.path, r.kind, r.text) for r in blocks.merged_library(rows).orderBy("variant", "path", "block", "seq").collect()]
    assert [(v, p, k) for v, p, k, _ in parts] == [(0, "a", "head"), (0, "a", "cell"), (0, "c", "cell"), (1, "b", "head"), (1, "b", "cell")]
    assert "grid_v0" in parts[0][3] and parts[2][3] == "cell (C) { values (grid_v0) { } }" and "grid_v1" in parts[4][3]


def test_walks_in_one_state_go_on_as_one():
    """A range is walked from each of its states only until they meet."""
    held = [ranges._Run(s, {s: (0, ranges._NONE, ranges.UNSET)}) for s in ranges.NETLIST.tokens]
    held = ranges._over(ranges.NETLIST, held, "; */ G u (.A(a), // u (;\n.Y(b) )\n; /* ;\n")
    assert {h.state: sorted(h.begins) for h in held} == {"comment>text": ["comment>name", "comment>text", "name", "text"], "attribute>text": ["attribute>text"], "attribute>name": ["attribute>name"]}
    held = ranges._over(ranges.NETLIST, held, "*) */ ; endmodule module m\n")
    assert [h.state for h in held] == ["text"] and {k: v[2] for k, v in held[0].begins.items()} == dict.fromkeys(ranges.NETLIST.tokens, "m")


def test_rows_of_many_short_texts_go_in_one_batch():
    class Files:
        select = lambda self, *names: self
        mapInArrow = lambda self, run, schema: run

    run = blocks._mapped(Files(), lambda path, text: iter([(path, text)] * 3), "", pa.schema([("path", pa.string()), ("text", pa.string())]))
    made = list(run(iter([pa.RecordBatch.from_pydict({"path": ["p"] * 100, "text": [str(i) for i in range(100)]})])))
    assert [b.num_rows for b in made] == [300] and made[0].column("text")[299].as_py() == "99"


def test_pairs_of_lines_are_dealt_out_before_they_are_counted(spark, monkeypatch):
    monkeypatch.setattr(lines, "PAIRED", 2)
    text = "clst1 clst2 clst3\nclst1 clst2\n# clst1 clst2\nclst9"
    got = lines.overlap_counts(spark.createDataFrame([("p", text)], "path string, text string"))
    assert got.rdd.getNumPartitions() == 5
    want = {("star", 1, 2): 2, ("star", 1, 3): 1, ("pairs", 1, 2): 2, ("pairs", 1, 3): 1, ("pairs", 2, 3): 1}
    assert {(r.mode, int(r.a[4:]), int(r.b[4:])): r.n for r in got.collect()} == want
