import itertools
import random

import pytest
from pyspark.sql import functions as F

from netmine.functions import expr, names


def random_expression(rng, depth=0):
    kind = rng.random()
    if depth > 4 or kind < 0.3:
        x = rng.choice(["a", "b", "c", "d", "1", "0", "TRUE", "false"])
        if x in "abcd" and rng.random() < 0.3:
            return x + "'", f"(not {x})"
        return x, {"1": "True", "0": "False", "TRUE": "True", "false": "False"}.get(x, x)
    if kind < 0.45:
        t, p = random_expression(rng, depth + 1)
        return rng.choice(["!", "~"]) + f"({t})", f"(not {p})"
    if kind < 0.55:
        t, p = random_expression(rng, depth + 1)
        return f"({t})'", f"(not {p})"
    (t, p), (u, q) = random_expression(rng, depth + 1), random_expression(rng, depth + 1)
    op = rng.choice(["&", "&&", "*", "|", "||", "+", "^"])
    python = {"&": "and", "&&": "and", "*": "and", "^": "!="}.get(op, "or")
    return f"({t}) {op} ({u})", f"(({p}) {python} ({q}))"


def test_expressions_against_python():
    rng = random.Random(4)
    for _ in range(400):
        text, python = random_expression(rng)
        want = "".join(str(int(eval(python, {}, dict(zip("abcd", map(bool, row)))))) for row in itertools.product((0, 1), repeat=4))  # noqa: S307  made above
        assert expr.bits(text, ("a", "b", "c", "d")) == want


def test_binding_and_errors():
    assert expr.bits("a | b ^ c & !d", tuple("abcd")) == expr.bits("a | (b ^ (c & (!d)))", tuple("abcd"))
    assert expr.bits("x", ("a",)) == "00"  # unknown names read false
    for bad in ("a b", "a &", "(a", "a)", "'a", "a ? b", "!", "", "a = b"):
        with pytest.raises(ValueError):
            expr.table(bad, ("a", "b"))


def test_minimal_sums_are_equal_and_small():
    rng = random.Random(5)
    literals = lambda s: sum(len(t.split("*")) for t in s.split(" + ")) if s not in "01" else 0
    for n in (1, 2, 3, 4):
        inputs = tuple("abcd"[:n])
        every = range(1 << (1 << n)) if n < 4 else rng.sample(range(1 << 16), 300)
        for v in every:
            bits = f"{v:0{1 << n}b}"
            short = expr.minimal_sum(bits, list(inputs))
            assert expr.bits(short, inputs) == bits
            if n == 2 and bits not in ("0110", "1001"):
                assert literals(short) <= 2


def test_keys(spark):
    rows = spark.createDataFrame([("8#0x1f",), (" 4 # 0x0008 ",), ("1#0X1",), ("64#0xFFFFFFFFFFFFFFFF",), (None,)], "k string")
    got = [(r.n, r.b) for r in rows.select(expr.normal_key(F.col("k")).alias("n"), expr.key_bits(F.col("k")).alias("b")).collect()]
    assert got == [("8#0x1F", "00011111"), ("4#0x8", "1000"), ("1#0x1", "1"), ("64#0x" + "F" * 16, "1" * 64), (None, None)]
    for bad in ("8#1F", "0#0x1", "8#0x", "4#0x1F", "x#0x1", "8#0xG"):
        with pytest.raises(Exception, match="no key"):
            spark.createDataFrame([(bad,)], "k string").select(expr.key_bits(F.col("k"))).collect()


def test_names(spark):
    import fnmatch

    globs = ["a*", "*_X[12]", "[!b]?x", "a.b", "a+(b)", "*"]
    words = ["abc", "q_X1", "q_X3", "cax", "bax", "a.b", "aXb", "a+(b)", ""]
    rows = spark.createDataFrame([(g, w) for g in globs for w in words], "g string, w string")
    for r in rows.select("g", "w", names.glob_match(F.col("w"), F.col("g")).alias("m")).collect():
        assert r.m == fnmatch.fnmatchcase(r.w, r.g), r
    numbers = spark.createDataFrame([(3.0,), (3.0000000001,), (2.5,), (0.1234567,), (-1.25,), (100.0,)], "v double")
    assert [r[0] for r in numbers.select(names.format_count(F.col("v"))).collect()] == ["3", "3", "2.5", "0.123457", "-1.25", "100"]
    fields = spark.createDataFrame([("a,b,c", 'say "x"'), ("a", "plain")], "l string, q string")
    got = fields.select(names.split_fields(F.col("l"), 2).alias("f"), names.csv_quote(F.col("q")).alias("q"), names.csv_row(F.col("l"), F.col("q")).alias("r")).collect()
    assert [(r.f, r.q, r.r) for r in got] == [(["a", "b,c"], '"say ""x"""', '"a,b,c","say ""x"""'), (["a"], "plain", "a,plain")]
    cells = spark.createDataFrame([("TIEHI_X1",), ("2input0x8_X4_SH",), ("INV_X2",), ("\\\\a ",)], "n string")
    got = cells.select(names.tie_key(F.col("n")).alias("t"), names.drive(F.col("n")).alias("d"), names.with_drive(F.col("n"), 1).alias("w"), names.family(F.col("n")).alias("f"), names.is_logic(F.col("n")).alias("l"), names.plain_name(F.col("n")).alias("p")).collect()
    assert [tuple(r)[:5] for r in got[:3]] == [("1#0x1", 1, "TIEHI_X1", "TIEHI", True), (None, 4, "2input0x8_X1_SH", "2input0", True), (None, 2, "INV_X1", "INV", False)]
