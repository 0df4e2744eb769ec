"""Node features, labels, splits, the attention network's forward pass, losses and scores.

A graph has as many nodes as a library has cells, so a task holds the nodes of a graph, but not its edges;
weights are a few matrices that are sent with the function.  Training is not done here.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netmine.operators.order import numbered
from netmine.session import saved

EPS = 1e-9
#: Edges of a group, about; a node's incoming edges are together.
EDGES = 1 << 18
#: Pairs of nodes of a group, about, where edges follow from the nodes.
PAIRS = 1 << 24


def elu(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x, np.expm1(np.minimum(x, 0)))


def softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, x)


def elu_column(x: Column) -> Column:
    return F.when(x > 0, x).otherwise(F.expm1(x))


def softplus_column(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def learning_rate(epoch: Column, warmup: int, epochs: int) -> Column:
    """Share of the base rate: linear up to `warmup`, then a cosine down to 1 %."""
    t = F.least(F.lit(1.0), (epoch - warmup) / float(max(1, epochs - warmup)))
    return F.when(epoch < warmup, (epoch + 1) / float(max(1, warmup))).otherwise(0.01 + 0.99 * 0.5 * (1 + F.cos(math.pi * t)))


def class_block(cells: DataFrame, relation: DataFrame) -> DataFrame:
    """cells (name, p_key) with is_rep, ei, eo and the size of the class over that of the largest.

    A key without a class takes its complement's, with one output inverter more; a key without either raises.
    """
    sizes = relation.groupBy("np_key").agg(F.count("*").alias("size"))
    known = relation.join(sizes, "np_key").select("p_key", "np_key", "ei", "eo", (F.col("size") / F.max("size").over(Window.partitionBy())).alias("share"))
    inverse = F.concat(F.lit("0b"), F.translate(F.substring("p_key", 3, 1 << 20), "01", "10"))
    other = known.select(*[F.col(c).alias(f"o_{c}") for c in known.columns])
    joined = cells.withColumn("__inv", F.col("inv_key") if "inv_key" in cells.columns else inverse).join(known, "p_key", "left").join(other, F.col("__inv") == F.col("o_p_key"), "left")
    lost = F.raise_error(F.concat(F.lit("no class for "), F.col("p_key"))).cast("int")
    return joined.select(
        "name", "p_key",
        F.when(F.col("np_key").isNotNull(), (F.col("p_key") == F.col("np_key")).cast("int")).when(F.col("o_np_key").isNotNull(), (F.col("__inv") == F.col("o_np_key")).cast("int")).otherwise(lost).alias("is_rep"),
        F.coalesce("ei", "o_ei").alias("ei"), F.coalesce(F.col("eo"), F.col("o_eo") + 1).alias("eo"), F.round(F.coalesce("share", "o_share"), 6).alias("class_share"),
    )


def node_features(nodes: DataFrame, base: list[str], design: list[str], role: list[str], classes: list[str]) -> DataFrame:
    """(graph, name, x): the columns of the four blocks, in order, as one array of doubles; a null raises."""
    columns = [*base, *design, *role, *classes]
    value = lambda c: F.coalesce(F.col(c).cast("double"), F.raise_error(F.concat(F.lit(f"{c} is null for "), F.col("name"))).cast("double"))
    return nodes.select("graph", "name", F.array(*map(value, columns)).alias("x"))


def labels(pairs: DataFrame, weighted: bool = False) -> DataFrame:
    """pairs (graph, name, count_a, count_b, cpp, is_logic, in_b): label = count_b * w over the sum of count_a * w of logic in use; loss_mask = in_b."""
    w = F.col("cpp") if weighted else F.lit(1.0)
    total = F.sum(F.when(F.col("is_logic") & (F.col("count_a") > 0), F.col("count_a") * w)).over(Window.partitionBy("graph"))
    checked = F.when(F.coalesce(total, F.lit(0.0)) > 0, total).otherwise(F.raise_error(F.concat(F.lit("no logic cells in "), F.col("graph").cast("string"))).cast("double"))
    return pairs.select("*", F.round(F.col("count_b") * w / checked, 6).alias("label"), F.col("in_b").cast("double").alias("loss_mask"))


def split(pairs: DataFrame, share: float, seed: int, design: str | None = None) -> DataFrame:
    """pairs (design, run_a, run_b) with `part`: val or train if both runs are of that part, else null.

    Runs of one design are val, or those whose seeded hash is below the share.
    """
    def is_val(run: str):
        if design is not None:
            return F.col("design") == design
        return F.pmod(F.xxhash64(F.col(run), F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000)

    a, b = is_val("run_a"), is_val("run_b")
    return pairs.select("*", F.when(a & b, "val").when(~a & ~b, "train").alias("part"))


# ---------------------------------------------------------------- the network


class Weights:
    """Matrices of the network: entry, attention layers (source, target, edge, score, bias), heads."""

    def __init__(self, entry, layers, head, scale=None, heads: int = 4):
        self.entry, self.layers, self.head, self.scale, self.heads = entry, layers, head, scale, heads

    @classmethod
    def seeded(cls, n_in: int, n_edge: int, hidden: int = 16, heads: int = 4, layers: int = 3, two_head: bool = False, seed: int = 0) -> Weights:
        rng = np.random.default_rng(seed)
        m = lambda *shape: rng.standard_normal(shape) / math.sqrt(shape[0])
        return cls(
            (m(n_in, hidden), np.zeros(hidden)),
            [(m(hidden, hidden), m(hidden, hidden), m(n_edge, hidden), m(heads, hidden // heads), np.zeros(hidden)) for _ in range(layers)],
            (m(hidden, 1), np.zeros(1)), (m(hidden, 1), np.full(1, 0.5413)) if two_head else None, heads,
        )


def attention(h: np.ndarray, edges: np.ndarray, attributes: np.ndarray, layer, heads: int, targets: np.ndarray | None = None) -> np.ndarray:
    """One layer: for each edge a score of leaky(source + target + edge), a softmax over a target's edges, the weighted sum of sources.

    Every node has an edge to itself, with the mean of its incoming edges' attributes.  With `targets`, sorted, all edges go to them and only their rows are made.
    """
    w_source, w_target, w_edge, score, bias = layer
    if targets is None:
        targets = np.arange(len(h))
    n, hidden = len(targets), w_source.shape[1]
    if not n:
        return np.zeros((0, hidden))
    src, at = edges[0], np.searchsorted(targets, edges[1])
    count = np.bincount(at, minlength=n)
    own = np.array([np.bincount(at, c, n) for c in attributes.T]).reshape(-1, n) / np.maximum(count, 1)
    at = np.append(at, np.arange(n))
    order = np.argsort(at, kind="stable")  # a target's edges are together
    src, at = np.append(src, targets)[order], at[order]
    first = np.cumsum(count + 1) - count - 1
    sent = (h @ w_source).T.take(src, axis=1)  # an edge is a column, so a target's edges lie in a row
    z = w_edge.T @ np.concatenate([attributes.T, own], axis=1).take(order, axis=1)
    z += sent
    z += (h[targets] @ w_target).T.take(at, axis=1)
    each = np.zeros((heads, hidden))  # a head's score of its own part
    each[np.arange(hidden) // (hidden // heads), np.arange(hidden)] = score.ravel()
    s = each @ np.maximum(z, 0.2 * z, out=z)
    s -= np.maximum.reduceat(s, first, axis=1).take(at, axis=1)
    e = np.exp(s, out=s)
    sent = sent.reshape(heads, -1, len(at))
    sent *= e[:, None]
    out = np.add.reduceat(sent, first, axis=2) / np.add.reduceat(e, first, axis=1)[:, None]
    return out.reshape(hidden, n).T + bias


def forward(x: np.ndarray, edges: np.ndarray, attributes: np.ndarray, mask: np.ndarray, w: Weights) -> tuple[np.ndarray, float | None]:
    """Shares of the masked nodes, and the scale if there is a second head."""
    h = x @ w.entry[0] + w.entry[1]
    for layer in w.layers:
        h = elu(attention(h, edges, attributes, layer, w.heads)) + h
    raw = (h @ w.head[0] + w.head[1])[:, 0]
    raw = np.where(mask, raw, -np.inf)
    e = np.exp(raw - raw.max()) if mask.any() else np.zeros(len(raw))
    share = e / e.sum() if mask.any() else e
    return share, None if w.scale is None else float(softplus((h.mean(0) @ w.scale[0] + w.scale[1])[0]))


def _nodewise(nodes: DataFrame, run: Callable, ddl: str) -> DataFrame:
    """`run` over pandas batches of nodes."""
    return nodes.mapInPandas(lambda batches: map(run, batches), ddl)


def _by_graph(rows: DataFrame, other: DataFrame, how: str = "inner") -> DataFrame:
    """Join by graph, where null is a graph like others."""
    return rows.join(other.withColumnRenamed("graph", "__graph"), F.col("graph").eqNullSafe(F.col("__graph")), how).drop("__graph")


NAMES = ["graph", "name", "mask", "no"]


def _schema(nodes: DataFrame) -> str:
    return f"graph {nodes.schema['graph'].dataType.simpleString()}, name string, mask boolean, no long, h array<double>"


def _enter(nodes: DataFrame, weights: Weights, kept: tuple[str, ...] = ()) -> DataFrame:
    """The first state of every node: graph, name, mask, no, h, and the columns kept."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        x = np.array(rows.x.tolist(), dtype=float).reshape(len(rows), weights.entry[0].shape[0])
        return rows[NAMES].assign(h=list(x @ weights.entry[0] + weights.entry[1]), **{c: rows[c] for c in kept})

    rows = nodes.select("graph", "name", "x", F.coalesce("mask", F.lit(False)).alias("mask"), F.monotonically_increasing_id().alias("no"), *kept)
    return _nodewise(rows, run, ", ".join([_schema(nodes), *(f"{c} {nodes.schema[c].dataType.simpleString()}" for c in kept)]))


def _leave(state: DataFrame, weights: Weights) -> DataFrame:
    """graph, name, share, scale, pred of the last state, a result of `saved`."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        h = np.array(rows.h.tolist(), dtype=float).reshape(len(rows), weights.head[0].shape[0])
        z = np.zeros(len(rows)) if weights.scale is None else (h @ weights.scale[0])[:, 0]
        return rows[["graph", "name", "mask"]].assign(raw=(h @ weights.head[0] + weights.head[1])[:, 0], z=z)

    kind = state.schema["graph"].dataType.simpleString()
    rows = saved(_nodewise(state, run, f"graph {kind}, name string, mask boolean, raw double, z double"), instead=state)
    top = rows.groupBy("graph").agg(F.max(F.when(F.col("mask"), F.col("raw"))).alias("top"), F.avg("z").alias("z"))
    total = _by_graph(rows, top.select("graph", "top")).where("mask").groupBy("graph").agg(F.sum(F.exp(F.col("raw") - F.col("top"))).alias("total"))
    share = F.when(F.col("mask"), F.exp(F.col("raw") - F.col("top")) / F.col("total")).otherwise(0.0)
    scale = F.lit(None).cast("double") if weights.scale is None else softplus_column(F.col("z") + float(weights.scale[1][0]))
    out = _by_graph(_by_graph(rows.drop("z"), top), total, "left").select("graph", "name", share.alias("share"), scale.alias("scale"))
    return out.withColumn("pred", F.col("share") * F.coalesce("scale", F.lit(1.0)))


def _block(c: str) -> Column:
    return F.pmod(F.xxhash64(c), F.col("n")).cast("int")


def _spread(state: DataFrame, size: DataFrame, *columns: str) -> DataFrame:
    """Every node in each of its graph's n blocks, and whether it is the block's own."""
    rows = _by_graph(state, size).select(*columns, F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("block"), _block("name").alias("at"))
    return rows.select(*columns, "block", (F.col("at") == F.col("block")).alias("own"))


def _places(left: pd.DataFrame, names) -> np.ndarray:
    """Of sorted nodes the last with each name; -1: none."""
    place = left.name[~left.name.duplicated(keep="last")]
    x = pd.Index(place).get_indexer(names)
    return np.where(x < 0, -1, place.index.to_numpy()[x]) if len(place) else np.full(len(x), -1)


def predict(nodes: DataFrame, edges: DataFrame, weights: Weights, most: int = EDGES) -> DataFrame:
    """nodes (graph, name, x, mask), edges (graph, src, dst, attributes): graph, name, share, scale, pred.

    A graph's targets are dealt out so that a group has about `most` edges: it meets all nodes of its graph and gives its
    own targets' next state.  So a task holds a graph's nodes and one group's edges, never a graph's edges.
    """
    def step(layer):
        def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            left = left.sort_values(["name", "no"], ignore_index=True)
            pairs = np.array([_places(left, right[c]) for c in ("src", "dst")], dtype=np.int64).reshape(2, -1)
            if (pairs < 0).any():
                raise KeyError(f"an edge of graph {key[0]} has no node")
            attributes = np.array(right.attributes.tolist(), dtype=float).reshape(len(right), layer[2].shape[0])
            h = np.array(left.h.tolist(), dtype=float).reshape(len(left), layer[0].shape[0])
            own = left.own.to_numpy(bool)
            h = elu(attention(h, pairs, attributes, layer, weights.heads, np.flatnonzero(own))) + h[own]
            return left.loc[own, NAMES].assign(h=list(h))

        return run

    size = edges.groupBy("graph").agg(F.ceil(F.count("*") / most).cast("int").alias("n"))
    dealt = edges.select("graph", "src", "dst", "attributes").transform(_by_graph, size).select("graph", _block("dst").alias("block"), "src", "dst", "attributes")
    size = saved(_by_graph(nodes.select("graph").distinct(), size, "left").select("graph", F.coalesce("n", F.lit(1)).alias("n")))
    state = saved(_enter(nodes, weights))
    for layer in weights.layers:
        spread = _spread(state, size, *NAMES, "h")
        state = saved(spread.groupBy("graph", "block").cogroup(dealt.groupBy("graph", "block")).applyInPandas(step(layer), _schema(nodes)), instead=state)
    return _leave(state, weights)


def predict_pairs(nodes: DataFrame, linked: Callable, attributes: Callable, weights: Weights, pairs: int = PAIRS, most: int = EDGES) -> DataFrame:
    """As `predict` for nodes (graph, name, x, mask, id) whose edges follow from the ids of a graph's nodes: no edge is a row.

    linked(i, j) is true where the source i has an edge to the target j, attributes(i, j) gives a row for each such edge;
    both get arrays.  A null graph has no edges.  A graph's targets are dealt out so that a group looks at about `pairs`
    pairs, for some targets at a time, of about `most` pairs: a task holds a graph's nodes and so many edges.
    """
    def step(layer):
        def run(key, left: pd.DataFrame) -> pd.DataFrame:
            left = left.sort_values(["name", "no"], ignore_index=True)
            place, ids = _places(left, left.name), left.id.to_numpy()
            h = np.array(left.h.tolist(), dtype=float).reshape(len(left), layer[0].shape[0])
            own = np.flatnonzero(left.own.to_numpy(bool))
            to = place[own]
            part = np.searchsorted(to, to) // max(1, most // max(1, len(left)))  # nodes with one name are in one part
            new = [np.zeros((0, h.shape[1]))]
            for rows in np.split(own, np.flatnonzero(part[1:] != part[:-1]) + 1):
                j, i = np.nonzero(linked(ids[None, :], ids[rows, None]) & (not pd.isna(key[0])))
                values = np.asarray(attributes(ids[i], ids[rows[j]]), dtype=float).reshape(len(i), layer[2].shape[0])
                new.append(attention(h, np.array([place[i], place[rows[j]]]), values, layer, weights.heads, rows))
            return left.loc[own, [*NAMES, "id"]].assign(h=list(elu(np.concatenate(new)) + h[own]))

        return run

    size = saved(nodes.groupBy("graph").agg(F.ceil(F.count("*") * F.count("*") / pairs).cast("int").alias("n")))
    state = saved(_enter(nodes, weights, ("id",)))
    for layer in weights.layers:
        spread = _spread(state, size, *NAMES, "h", "id")
        state = saved(spread.groupBy("graph", "block").applyInPandas(step(layer), f"{_schema(nodes)}, id {nodes.schema['id'].dataType.simpleString()}"), instead=state)
    return _leave(state, weights)


# ---------------------------------------------------------------- losses and scores


def rank_hinge(rows: DataFrame, margin: float) -> DataFrame:
    """One row: the mean over all pairs of nodes of a graph of how far they are from being ranked right by `margin`.

    rows (graph, share, label).  No pairs are made.  Labels are ranked, and two different ranks part at exactly one bit of
    their binary prefixes: there the smaller has 0 and the larger 1 below an equal prefix.  So for each bit and prefix the
    nodes are put in order of share, and running sums over the smaller labels give each larger label its loss.
    """
    graph = Window.partitionBy("graph")
    ranked = rows.select("graph", F.col("share").alias("p"), (F.dense_rank().over(graph.orderBy("label")) - 1).cast("long").alias("r"))
    counted = ranked.withColumn("bits", F.length(F.bin(F.max("r").over(graph))))
    level = counted.select("graph", "p", "r", F.explode(F.sequence(F.lit(0), F.col("bits") - 1)).alias("bit")).select(
        "graph", "bit", F.expr("shiftright(r, bit + 1)").alias("prefix"), F.expr("getbit(r, bit) = 1").alias("larger"), "p"
    )
    key = F.when(F.col("larger"), F.col("p") - margin).otherwise(F.col("p"))
    above = Window.partitionBy("graph", "bit", "prefix").orderBy(key.desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    smaller = level.select("*", F.count(F.when(~F.col("larger"), 1)).over(above).alias("n"), F.sum(F.when(~F.col("larger"), F.col("p"))).over(above).alias("s"))
    apart = smaller.where("larger").agg(F.coalesce(F.sum(F.col("n") * (margin - F.col("p")) + F.coalesce("s", F.lit(0.0))), F.lit(0.0)).alias("loss"))
    ties = ranked.groupBy("graph", "r").agg(F.count("*").alias("k"))
    equal = ties.agg(F.coalesce(F.sum(F.col("k") * (F.col("k") - 1) / 2), F.lit(0.0)).alias("equal"))
    pairs = rows.groupBy("graph").agg(F.count("*").alias("k")).agg(F.sum(F.col("k") * (F.col("k") - 1) / 2).alias("pairs"))
    whole = apart.crossJoin(equal).crossJoin(pairs)  # one row each
    return whole.select(F.when(F.col("pairs") > 0, (F.col("loss") + F.col("equal") * max(margin, 0.0)) / F.nullif("pairs", F.lit(0.0))).alias("rank"))


def losses(rows: DataFrame, delta: float = 0.1, margin: float = 0.02) -> DataFrame:
    """One row for rows (graph, name, share, label, mask): cross-entropy for each graph, Huber, squared error, and the hinge over all pairs of a graph."""
    kept = rows.where("mask")
    p, y = F.col("share"), F.col("label")
    gap = F.abs(p - y)
    graphs = rows.agg(F.countDistinct("graph").alias("graphs"))
    sums = kept.agg(
        F.sum(-F.greatest(y, F.lit(0.0)) * F.log(F.greatest(p, F.lit(EPS)))).alias("ce"),
        F.avg(F.when(gap <= delta, 0.5 * gap * gap).otherwise(delta * (gap - 0.5 * delta))).alias("huber"), F.avg(gap * gap).alias("mse"),
    )
    return sums.crossJoin(graphs).crossJoin(rank_hinge(kept, margin)).select(  # one row each
        F.round(F.col("ce") / F.col("graphs"), 6).alias("cross_entropy"), F.round("huber", 6).alias("huber"), F.round("mse", 6).alias("mse"), F.round(F.coalesce("rank", F.lit(0.0)), 6).alias("rank_hinge")
    )


def direction_accuracy(rows: DataFrame, least: float = 1e-4) -> DataFrame:
    """One row: how often prediction and truth have the same sign, among truths beyond `least`; NaN without any."""
    hit = F.avg(((F.col("pred") > 0) == (F.col("truth") > 0)).cast("double"))
    return rows.where(F.abs("truth") > least).agg(F.coalesce(F.round(hit, 6), F.lit(float("nan"))).alias("accuracy"))


def score(combos: DataFrame, cells: DataFrame, gains: DataFrame | None = None) -> DataFrame:
    """combos (combo, name), cells (name, twin, pred, twin_pred, area, twin_area, p_key): sums for each combination.

    added: predictions of the cells and their twins; area: weighted by area + 1; gain: weighted by gains (p_key, drive, gain).
    A combination with a cell, or a twin, that has no gain is left out.
    """
    rows = combos.join(cells, "name")
    if gains is None:
        rows = rows.withColumn("g1", F.lit(0.0)).withColumn("g2", F.lit(0.0))
    else:
        of = lambda d, to: gains.where(F.col("drive") == d).select("p_key", F.col("gain").alias(to))
        rows = rows.join(of(1, "g1"), "p_key", "left").join(of(2, "g2"), "p_key", "left")
    twin = F.when(F.col("twin").isNotNull(), F.col("twin_pred")).otherwise(0.0)
    lacking = F.col("g1").isNull() | (F.col("twin").isNotNull() & F.col("g2").isNull())
    out = rows.groupBy("combo").agg(
        F.round(F.sum(F.col("pred") + twin), 6).alias("added"),
        F.round(F.sum(F.col("pred") * (F.col("area") + 1) + twin * (F.coalesce("twin_area", F.lit(0.0)) + 1)), 6).alias("area_weighted"),
        F.round(F.sum(F.col("pred") * F.coalesce("g1", F.lit(0.0)) + twin * F.coalesce("g2", F.lit(0.0))), 6).alias("gain"), F.bool_or(lacking).alias("lacking"),
    )
    return out.where(~F.col("lacking")).drop("lacking")


def ranked_scores(scored: DataFrame, by: str) -> DataFrame:
    """Scores with their rank from 1, greatest first, ties by combination."""
    ranked = numbered(scored, [F.col(by).desc(), F.col("combo").asc()], "__no")
    return ranked.select((F.col("__no") + 1).alias("rank"), *scored.columns)


def proxy_delay(stack_n: Column, stack_p: Column, cpp: Column) -> Column:
    return (stack_n + stack_p) * cpp


def with_twin(predictions: DataFrame, floor: float, ratio: float) -> DataFrame:
    """Cells whose stronger twin is taken along: predicted at least `floor`, the twin at least `ratio` of that."""
    return predictions.where((F.col("pred") >= floor) & (F.col("twin_pred") / F.col("pred") >= ratio))
