import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from netmine.operators import library, model, transistors


def loop_forward(x, edges, attributes, mask, w):
    """The network node by node and edge by edge."""
    n = len(x)
    h = [[sum(x[v][i] * w.entry[0][i][j] for i in range(len(x[v]))) + w.entry[1][j] for j in range(len(w.entry[1]))] for v in range(n)]
    times = lambda m, row: [sum(row[i] * m[i][j] for i in range(len(row))) for j in range(len(m[0]))]
    for ws, wt, we, score, bias in w.layers:
        width = len(score[0])
        new = []
        for v in range(n):
            into = [(s, a) for (s, d), a in zip(edges, attributes) if d == v]
            own = [sum(a[k] for _, a in into) / max(1, len(into)) for k in range(len(we))]
            into.append((v, own))
            out = []
            for head in range(w.heads):
                part = slice(head * width, (head + 1) * width)
                logits, values = [], []
                for s, a in into:
                    sent = times(ws, h[s])[part]
                    z = [p + q + r for p, q, r in zip(sent, times(wt, h[v])[part], times(we, a)[part])]
                    logits.append(sum((t if t > 0 else 0.2 * t) * c for t, c in zip(z, score[head])))
                    values.append(sent)
                e = [math.exp(t - max(logits)) for t in logits]
                out += [sum(p / sum(e) * val[k] for p, val in zip(e, values)) for k in range(width)]
            out = [o + b for o, b in zip(out, bias)]
            new.append([(o if o > 0 else math.expm1(o)) + old for o, old in zip(out, h[v])])
        h = new
    raw = [sum(a * b[0] for a, b in zip(h[v], w.head[0])) + w.head[1][0] for v in range(n)]
    e = [math.exp(raw[v]) if mask[v] else 0.0 for v in range(n)]
    mean = [sum(h[v][j] for v in range(n)) / n for j in range(len(h[0]))]
    scale = math.log1p(math.exp(sum(a * b[0] for a, b in zip(mean, w.scale[0])) + w.scale[1][0]))
    return [t / sum(e) for t in e], scale


def test_forward_pass_against_loops(spark):
    rng = random.Random(6)
    w = model.Weights.seeded(3, 2, hidden=8, heads=2, layers=2, two_head=True, seed=5)
    nodes, edges, want = [], [], {}
    for g in range(3):
        n = 5 + g
        x = [[rng.uniform(-1, 1) for _ in range(3)] for _ in range(n)]
        pairs = [(a, b) for a in range(n) for b in range(n) if a != b and rng.random() < 0.4]
        attributes = [[rng.random(), rng.random()] for _ in pairs]
        mask = [i % 2 == 0 for i in range(n)]
        nodes += [(g, f"n{i}", x[i], mask[i]) for i in range(n)]
        edges += [(g, f"n{a}", f"n{b}", t) for (a, b), t in zip(pairs, attributes)]
        share, scale = loop_forward(x, pairs, attributes, mask, w)
        want.update({(g, f"n{i}"): (share[i], scale) for i in range(n)})
    rows = model.predict(
        spark.createDataFrame(nodes, "graph int, name string, x array<double>, mask boolean"), spark.createDataFrame(edges, "graph int, src string, dst string, attributes array<double>"), w
    ).collect()
    assert len(rows) == len(want)
    for r in rows:
        assert np.allclose([r.share, r.scale, r.pred], [*want[r.graph, r.name], want[r.graph, r.name][0] * want[r.graph, r.name][1]])


def test_forward_pass_in_parts(spark, monkeypatch):
    """A group holds a part of a graph's edges, and the parts give what the whole graph gives."""
    rng = random.Random(8)
    w = model.Weights.seeded(3, 2, hidden=8, heads=2, layers=2, two_head=True, seed=5)
    x = [[rng.uniform(-1, 1) for _ in range(3)] for _ in range(40)]
    pairs = [(a, b) for a in range(40) for b in range(39) if a != b]  # one node has no edge to it
    attributes = [[rng.random(), rng.random()] for _ in pairs]
    share, scale = loop_forward(x, pairs, attributes, [True] * 40, w)
    nodes = spark.createDataFrame([(g, f"n{i}", x[i], True) for g in (None, 1) for i in range(40)], "graph int, name string, x array<double>, mask boolean")
    edges = spark.createDataFrame([(g, f"n{a}", f"n{b}", t) for g in (None, 1) for (a, b), t in zip(pairs, attributes)], "graph int, src string, dst string, attributes array<double>")

    def few(h, edges, *rest, attention=model.attention):
        if edges.shape[1] > 800:
            raise ValueError("a whole graph's edges")
        return attention(h, edges, *rest)

    monkeypatch.setattr(model, "attention", few)
    rows = model.predict(nodes, edges, w, most=100).collect()
    assert len(rows) == 80
    for r in rows:
        assert np.allclose([r.share, r.scale, r.pred], [share[int(r.name[1:])], scale, share[int(r.name[1:])] * scale])


def test_split_keeps_runs_apart(spark):
    pairs = spark.range(400).select(F.lit("d").alias("design"), (F.col("id") % 20).alias("run_a"), F.floor(F.col("id") / 20).alias("run_b")).where("run_a <> run_b")
    rows = model.split(pairs, 0.3, 1).collect()
    val = {r for x in rows if x.part == "val" for r in (x.run_a, x.run_b)}
    train = {r for x in rows if x.part == "train" for r in (x.run_a, x.run_b)}
    assert val and train and not val & train


def test_missing_values_raise(spark):
    nodes = spark.createDataFrame([(1, "a", 1.0), (1, "b", None)], "graph int, name string, v double")
    with pytest.raises(Exception, match="v is null for b"):
        model.node_features(nodes, ["v"], [], [], []).collect()
    cells = spark.createDataFrame([("a", "0b01")], "name string, p_key string")
    relation = spark.createDataFrame([("0b0001", "0b1110", 0, 1)], "p_key string, np_key string, ei int, eo int")
    with pytest.raises(Exception, match="no class"):
        model.class_block(cells, relation).collect()
    other = model.class_block(spark.createDataFrame([("n", "0b1110")], "name string, p_key string"), relation).collect()
    assert [(r.is_rep, r.ei, r.eo) for r in other] == [(0, 0, 2)]  # through the complement


def test_enforce_names_the_cells(spark):
    used = spark.createDataFrame([("A_X1",), ("B_X2",)], "name string")
    judged = library.compliance(used, spark.createDataFrame([("B*",)], "pattern string"))
    with pytest.raises(ValueError, match="B_X2"):
        library.enforce(judged)
    library.enforce(judged.where("name = 'A_X1'"))
    with pytest.raises(ValueError, match="columns differ"):
        library.append_missing(used, used.withColumn("x", F.lit(1)), "name")


def circuit(lines, pins):
    rows = []
    for k, text in enumerate(lines):
        drain, gate, source, kind = text.split()
        rows.append(transistors.Device(f"M{k}", drain, gate, source, kind == "p", 46e-9, 20e-9, 2.0))
    return transistors.Circuit("c", pins.split(), rows)


def test_functions_against_switches():
    """Random series and parallel networks: the table against conduction found by search for every assignment."""
    rng = random.Random(7)
    for _ in range(40):
        inputs = "ABC"[: rng.randint(1, 3)]

        def network(depth=0):
            if depth > 1 or rng.random() < 0.4:
                return rng.choice(inputs)
            return (rng.choice("sp"), network(depth + 1), network(depth + 1))

        tree, lines, fresh = network(), [], iter(range(100))

        def wire(t, a, b, kind, swap):
            if isinstance(t, str):
                lines.append(f"{a} {t} {b} {kind}")
            elif (t[0] == "s") != swap:
                mid = f"{kind}{next(fresh)}"
                wire(t[1], a, mid, kind, swap)
                wire(t[2], mid, b, kind, swap)
            else:
                wire(t[1], a, b, kind, swap)
                wire(t[2], a, b, kind, swap)

        wire(tree, "Y", "VSS", "n", False)
        wire(tree, "Y", "VDD", "p", True)
        used = sorted({x for x in inputs if any(f" {x} " in t for t in lines)})
        c = circuit(lines, " ".join([*used, "Y", "VDD", "VSS"]))
        table = c.evaluate()["Y"]

        def on(t, row):
            if isinstance(t, str):
                return row >> (len(used) - 1 - used.index(t)) & 1
            return on(t[1], row) & on(t[2], row) if t[0] == "s" else on(t[1], row) | on(t[2], row)

        size = 1 << len(used)
        assert [table >> (size - 1 - a) & 1 for a in range(size)] == [1 - on(tree, a) for a in range(size)]
        assert c.inputs == used and c.outputs == ["Y"] and c.depth() == {"Y": 1}


def test_broken_circuits_raise():
    with pytest.raises(ValueError, match="static"):
        circuit(["Y A VSS n"], "A Y").evaluate()
    with pytest.raises(ValueError, match="cycle"):
        circuit(["Y q VSS n", "Y q VDD p", "q Y VSS n", "q Y VDD p"], "Y").depth()
    with pytest.raises(ValueError, match="neither"):
        circuit(["Y A VSS n", "Y A VDD p"], "A B Y")


def test_edges_that_follow_from_the_nodes(spark, monkeypatch):
    """No edge is a row, a call meets few edges, and the result is that of the edges written out; two nodes share a name, one graph is null."""
    rng = random.Random(9)
    w = model.Weights.seeded(3, 2, hidden=8, heads=2, layers=2, two_head=True, seed=5)
    rows = [(g, f"n{i if i != 7 else 6}", [rng.uniform(-1, 1) for _ in range(3)], i % 2 == 0, i) for g in (1, 2, None) for i in range(40)]
    nodes = spark.createDataFrame(rows, "graph int, name string, x array<double>, mask boolean, id long").coalesce(1)
    edges = [(g, f"n{i if i != 7 else 6}", f"n{j if j != 7 else 6}", [i % 2 * 1.0, j % 5 / 5.0]) for g in (1, 2) for i in range(40) for j in range(40) if i != j and (i + j) % 3 == 0]
    want = model.predict(nodes.drop("id"), spark.createDataFrame(edges, "graph int, src string, dst string, attributes array<double>"), w)

    def few(h, edges, *rest, attention=model.attention):
        if edges.shape[1] > 200:
            raise ValueError("a whole graph's edges")
        return attention(h, edges, *rest)

    want = sorted((str(r.graph), r.name, round(r.pred, 9), round(r.scale, 9)) for r in want.collect())
    monkeypatch.setattr(model, "attention", few)
    linked = lambda i, j: (i != j) & ((i + j) % 3 == 0)
    got = model.predict_pairs(nodes, linked, lambda i, j: np.column_stack((i % 2, j % 5 / 5.0)), w, pairs=600, most=200)
    assert sorted((str(r.graph), r.name, round(r.pred, 9), round(r.scale, 9)) for r in got.collect()) == want
