"""Versions by parts, replayed searches, the hinge without pairs."""

import random

import pytest
from pyspark.sql import functions as F

from netmine.operators import explore, model
from netmine.session import saved
from netmine.sinks import versions


def test_one_changed_file_recomputes_one_part(spark, tmp_path):
    folder, made = str(tmp_path / "t"), []
    files = {"a": ["x", "y"], "b": ["z"], "c": []}

    def refresh():
        rows = spark.createDataFrame([(p, t) for p, ts in files.items() for t in ts] or [("", "")], "part string, text string").where("part <> ''")
        inputs = spark.createDataFrame([(p, repr(ts)) for p, ts in files.items()], "part string, digest string")

        def compute(parts):
            made.append(sorted(r.part for r in parts.collect()))
            return rows.join(parts, "part").select("part", F.upper("text").alias("text"))

        return versions.refresh(spark, folder, inputs, compute)

    shown = lambda n=None: sorted((r.part, r.text) for r in versions.read(spark, folder, n).collect())
    assert refresh() == 1 and made == [["a", "b", "c"]] and shown() == [("a", "X"), ("a", "Y"), ("b", "Z")]
    assert refresh() == 1 and len(made) == 1
    files["b"] = ["q", "r"]
    assert refresh() == 2 and made[-1] == ["b"] and shown() == [("a", "X"), ("a", "Y"), ("b", "Q"), ("b", "R")]
    del files["a"]
    files["d"] = ["n"]
    assert refresh() == 3 and made[-1] == ["d"] and shown() == [("b", "Q"), ("b", "R"), ("d", "N")]
    assert shown(1) == [("a", "X"), ("a", "Y"), ("b", "Z")]
    two = spark.createDataFrame([("a", "1"), ("a", "2")], "part string, digest string")
    with pytest.raises(Exception, match="two digests"):
        versions.refresh(spark, folder, two, lambda parts: parts.select("part", F.lit("").alias("text")))


def graph(rng, copies):
    """Copies of three cones, a few of which get another load or share a cell where the others don't."""
    cells, edges, n = [], [], 0
    for c in range(copies):
        kind, ids = c % 3, list(range(n, n + 8))
        n += 8
        cells += [(i, "G" if (i - ids[0] + kind) % 2 else "H") for i in ids]
        wires = [(1, 0, "A"), (2, 0, "B"), (3, 1, "A"), (4, 1, "B"), (4 if kind == 1 else 5, 2, "A"), (6, 2, "B"), (7, 3, "A")]
        edges += [(ids[d], ids[l], t) for d, l, t in wires]
        edges += [(-(c * 10 + k) - 1, ids[k], "C") for k in (4, 5, 6, 7)]
        if c % 5 == 4:
            edges.append((ids[rng.choice([3, 4, 6])], ids[7], "D" if rng.random() < 0.5 else "E"))
    return cells, edges


@pytest.mark.parametrize("bounds", [explore.Bounds(max_cells=4, min_inputs=0, max_inputs=5), explore.Bounds(max_cells=5, max_outputs=3, min_inputs=1, max_inputs=6, max_depth=3, allow_internal_fanout=True)])
def test_replay_equals_the_full_search(spark, bounds):
    cells, edges = graph(random.Random(2), 24)
    c = spark.createDataFrame([(i, g, 0.0, 0.0) for i, g in cells], "id long, gate string, x double, y double")
    e = spark.createDataFrame(edges, "driver long, load long, term string")
    plain = lambda df: sorted((r.root, tuple(r.cells), r.n_inputs, r.n_outputs, r.depth, r.verdict) for r in df.collect())
    full = plain(explore.search(c, e.select("driver", "load"), saved, bounds))
    found = saved(explore.replay(c, e, saved, bounds))
    assert plain(found) == full and any(r[-1] == "include" for r in full)
    judged = found.where("NOT replayed").count()
    assert judged < 0.6 * len(full)
    far = explore.Bounds(max_cells=3, max_distance=1.0)
    assert explore.replay(c, e, saved, far).where("replayed").count() == 0


@pytest.mark.parametrize("margin", [0.02, 0.3, 0.0])
def test_hinge_without_pairs(spark, margin):
    rng = random.Random(int(margin * 100))
    rows = [(g, rng.choice([0.1, 0.5, rng.random()]), rng.choice([0.0, 0.25, 0.5, rng.random()])) for g in "aab" for _ in range(rng.randint(15, 40))] + [("single", 0.3, 0.4)]
    losses = []
    for i, (g, p, y) in enumerate(rows):
        for h, q, z in rows[i + 1 :]:
            if g == h:
                sign = (y > z) - (y < z)
                losses.append(max(0.0, margin - sign * (p - q)))
    frame = model.rank_hinge(spark.createDataFrame(rows, "graph string, share double, label double"), margin)
    assert abs(frame.first()["rank"] - sum(losses) / len(losses)) < 1e-9
    none = spark.createDataFrame([("a", 0.1, 0.2)], "graph string, share double, label double")
    assert model.rank_hinge(none, margin).first()["rank"] is None and model.rank_hinge(none.limit(0), margin).first()["rank"] is None


def test_search_without_places_gives_the_same_states(spark):
    cells = spark.createDataFrame([(i, 0.5 * i, 1.0) for i in range(1, 8)], "id long, x double, y double")
    edges = spark.createDataFrame([(2, 1), (3, 1), (4, 2), (5, 2), (6, 3), (7, 3), (5, 4), (-1, 4), (-2, 5)], "driver long, load long")
    full = explore.search(cells, edges, saved)
    bare = explore.search(cells, edges, saved, places=False)
    assert bare.columns == [c for c in full.columns if c not in ("distance", "dx", "dy")]
    plain = lambda rows: sorted(map(repr, rows.select("root", "cells", "n_inputs", "n_outputs", "depth", "verdict").collect()))
    assert plain(bare) == plain(full) and len(plain(bare)) > 20
