"""Graph preparation and bounded fan-in expansion.

cell(id, gate, is_seq), edge(driver, load, term).  The expansion grows cell sets
from every root in rounds; a set is a sorted array, so equal sets are equal rows.
With one output and no inner fan-out allowed (the default), a predecessor may
join only when all of its loads are inside, which makes the rounds exact
whatever the order; sets that break a bound are pruned with a reason and not
grown, sets below the bounds are grown but not accepted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def integrity(cells: DataFrame, edges: DataFrame, masters: DataFrame) -> DataFrame:
    """Counts of broken rules; all are 0 in a sound graph."""
    missing = cells.join(masters, "gate", "left_anti").agg(F.count("*").alias("n")).select(F.lit("cell without master").alias("rule"), "n")
    loads = edges.join(cells.select(F.col("id").alias("load")), "load", "left_anti").agg(F.count("*").alias("n")).select(F.lit("load without cell").alias("rule"), "n")
    drivers = edges.join(cells.select(F.col("id").alias("driver")), "driver", "left_anti").agg(F.count("*").alias("n")).select(F.lit("driver without cell").alias("rule"), "n")
    twice = edges.groupBy("load", "term").agg(F.countDistinct("driver").alias("k")).where("k > 1").agg(F.count("*").alias("n")).select(F.lit("two drivers").alias("rule"), "n")
    return missing.union(loads).union(drivers).union(twice)


def drop_sequential(cells: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    kept = cells.where("NOT is_seq")
    ids = kept.select("id")
    return kept, edges.join(ids.toDF("driver"), "driver", "left_semi").join(ids.toDF("load"), "load", "left_semi").select("driver", "load", "term")


def collapse_buffers(cells: DataFrame, edges: DataFrame, checkpoint) -> DataFrame:
    """Loads of a buffer move to what drives it, through chains of buffers; (driver, load, term) without buffers.

    Pointer jumping: a chain of length d needs log2(d) rounds.  A buffer that nothing drives stays a driver.
    """
    buffers = cells.where("is_buffer").select("id")
    alias = checkpoint(
        edges.join(buffers.toDF("load"), "load", "left_semi").groupBy("load").agg(F.min("driver").alias("driver")).select(F.col("load").alias("id"), F.col("driver").alias("to"))
    )
    while True:
        step = alias.join(alias.toDF("to", "further"), "to", "left").select("id", F.coalesce("further", "to").alias("next"), (F.col("further").isNotNull()).alias("moved"))
        step = checkpoint(step)
        if not step.where("moved").limit(1).count():
            break
        alias = step.select("id", F.col("next").alias("to"))
    rest = edges.join(buffers.toDF("load"), "load", "left_anti")
    return rest.join(alias.toDF("driver", "to"), "driver", "left").select(F.coalesce("to", "driver").alias("driver"), "load", "term")


def split_outputs(cells: DataFrame, outputs: str = "outputs") -> DataFrame:
    """One virtual cell for each output pin."""
    return cells.select("*", F.explode(outputs).alias("pin")).withColumn(
        "name", F.when(F.size(outputs) > 1, F.concat(F.col("name"), F.lit("__split__"), F.col("pin"))).otherwise(F.col("name"))
    )


def reach(roots: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """(root, id, depth): cells within `depth` steps against the edges, at their least depth."""
    level = roots.select(F.col("id").alias("root"), "id", F.lit(0).alias("depth"))
    found = level
    for d in range(1, depth + 1):
        level = level.join(edges.select(F.col("driver").alias("to"), F.col("load").alias("id")), "id").select("root", F.col("to").alias("id"), F.lit(d).alias("depth")).distinct()
        found = found.union(level)
    return found.groupBy("root", "id").agg(F.min("depth").alias("depth"))


def expand(
    cells: DataFrame, edges: DataFrame, checkpoint, max_cells: int = 8, max_depth: int = 3, min_inputs: int = 2, max_inputs: int = 4, min_cells: int = 2,
    roots: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Accepted clusters (root, cells, depths, depth, n_inputs) and the audit (root, cells, verdict).

    State: cells with their depths, inputs (distinct drivers, of which those below 0 are nets without a cell, and
    n_ports further ones), and the drivers that may join: all loads inside.
    """
    pins = edges.groupBy("load").agg(F.collect_set("driver").alias("drivers"), F.count("*").alias("n_pins"))
    # a driver of more loads than a set may hold never joins: one load that is no cell stands for them
    fan = edges.groupBy("driver").agg(F.countDistinct("load").alias("k")).where(F.col("k") <= max_cells).select("driver")
    loads = edges.join(fan, "driver", "left_semi").groupBy("driver").agg(F.collect_set("load").alias("loads"))
    many = edges.select("driver").distinct().join(fan, "driver", "left_anti").select("driver", F.array(F.lit(-1).cast("long")).alias("loads"))
    fan = loads.union(many)
    info = cells.join(pins, cells["id"] == pins["load"], "left").join(fan, cells["id"] == fan["driver"], "left").select(
        "id", F.coalesce("drivers", F.expr("cast(array() AS array<bigint>)")).alias("drivers"),
        F.coalesce("loads", F.expr("cast(array() AS array<bigint>)")).alias("loads"), F.coalesce(F.col("n_ports"), F.lit(0)).alias("ports"),
    )
    info = checkpoint(info)
    first = info if roots is None else info.join(roots.select("id"), "id", "left_semi")
    state = first.select(
        F.col("id").alias("root"), F.array("id").alias("cells"), F.array(F.lit(1)).alias("depths"), F.col("drivers").alias("front"), F.col("ports").alias("ports"),
    )
    grown, audit = [], []
    for _ in range(max_cells - 1):
        joined = (
            state.select("*", F.explode("front").alias("id"))
            .join(info.select("id", "drivers", "loads", F.col("ports").alias("more")), "id")
        )
        inside = F.expr("forall(loads, x -> array_contains(cells, x))")
        depth = F.expr("1 + array_max(transform(loads, x -> element_at(depths, cast(array_position(cells, x) AS int))))")
        fits = joined.where(inside).withColumn("d", depth)
        refused = joined.where(~inside).select("root", F.array_sort(F.array_append("cells", F.col("id"))).alias("cells"), F.lit("prune:max_outputs").alias("verdict"))
        deep = fits.where(F.col("d") > max_depth).select("root", F.array_sort(F.array_append("cells", F.col("id"))).alias("cells"), F.lit("prune:max_depth").alias("verdict"))
        nxt = fits.where(F.col("d") <= max_depth).select(
            "root",
            F.expr("array_sort(arrays_zip(array_append(cells, id), array_append(depths, d)))").alias("z"),
            F.expr("array_except(array_union(front, drivers), array_append(cells, id))").alias("front"),
            (F.col("ports") + F.col("more")).alias("ports"),
        ).select("root", F.expr("transform(z, x -> x.`0`)").alias("cells"), F.expr("transform(z, x -> x.`1`)").alias("depths"), F.array_sort("front").alias("front"), "ports")
        state = checkpoint(nxt.dropDuplicates(["root", "cells"]))
        audit += [refused, deep]
        if state.isEmpty():
            break
        grown.append(state)
    every = grown[0] if grown else state
    for s in grown[1:]:
        every = every.union(s)
    seen = every.select("root", "cells", "depths", F.array_max("depths").alias("depth"), (F.size("front") + F.col("ports")).alias("n_inputs"))
    accept = (F.size("cells") >= min_cells) & F.col("n_inputs").between(min_inputs, max_inputs) & (F.col("depth") >= 2)
    verdicts = seen.select("root", "cells", F.when(accept, "include").otherwise("skip:bounds").alias("verdict"))
    for a in audit:
        verdicts = verdicts.union(a.distinct())
    return seen.where(accept), verdicts


def load(rows: DataFrame, masters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cells (id, master, is_seq) and edges (driver, load, term, net) of netlist rows (number, master, pin, net) of one module.

    masters: name, is_seq, pins (array of name, direction).  The first output on a net drives it.  A master or pin that
    the library lacks raises, but for masters whose name begins with $; ports drive and load nothing.  A net that no
    combinational cell drives stands for itself, as a driver below 0, so inputs count by net.
    """
    pins = masters.select(F.col("name").alias("master"), "is_seq", F.explode("pins").alias("p")).select("master", "is_seq", F.col("p.name").alias("pin"), "p.direction")
    inner = rows.where((F.col("number") > 0) & ~F.col("master").startswith("$")).join(F.broadcast(pins), ["master", "pin"], "left")
    lost = F.raise_error(F.concat(F.lit("not in the library: "), "master", F.lit("."), "pin"))
    checked = inner.select(F.col("number").cast("long").alias("id"), "master", "pin", "net", F.coalesce("is_seq", lost.cast("boolean")).alias("is_seq"), F.coalesce("direction", lost.cast("string")).alias("direction"))
    cells = checked.groupBy("id").agg(F.min("master").alias("master"), F.bool_or("is_seq").alias("is_seq"))
    out = checked.where("direction = 'output'").groupBy("net").agg(F.min(F.struct("id", "pin", "is_seq")).alias("d")).select("net", "d.*")
    loads = checked.where("NOT is_seq").join(out.toDF("net", "driver", "driver_pin", "driver_seq"), "net", "left")
    loads = loads.where("direction <> 'output' OR (driver <> id OR driver_pin <> pin)")
    alone = -F.pmod(F.xxhash64("net"), F.lit(1 << 62)) - 1
    edges = loads.select(F.when(F.col("driver").isNull() | F.col("driver_seq"), alone).otherwise(F.col("driver")).alias("driver"), F.col("id").alias("load"), F.col("pin").alias("term"), "net")
    return cells, edges


def roots(cells: DataFrame, masters: DataFrame) -> DataFrame:
    """Cells to start from: combinational, one output, no buffer (an output that is its only input)."""
    pins_of = lambda d: F.transform(F.filter("pins", lambda x: x["direction"] == d), lambda x: x["name"])
    single = masters.where(~F.col("is_seq") & (F.size(pins_of("output")) == 1)).withColumn("i", pins_of("input")).withColumn("f", F.col("functions")[0]["function"])
    buffer = (F.size("i") == 1) & F.coalesce(F.regexp_replace("f", r"\s+", "") == F.col("i")[0], F.lit(False))
    return cells.join(F.broadcast(single.where(~buffer).select(F.col("name").alias("master"))), "master", "left_semi").select("id")


#: Column j of a table in a word of 64 rows, the first row highest: the rows whose number has bit j.
_COLUMNS = [sum(1 << (63 - a) for a in range(64) if a >> j & 1) for j in range(6)]


def evaluate(found: DataFrame, gates: DataFrame) -> DataFrame:
    """Truth tables of clusters: found (root, cells, depths), gates (id, tt, nets): the table of each cell and its driver nets, most significant first.

    Cells are folded from the greatest depth to the root, so each one's drivers have their value before it.  A value
    is an array of words with 64 rows each, in which a shorter table repeats; the outside nets, sorted, are the inputs.
    A table has 2**n rows, whatever n.
    """
    rows = found.select("root", "cells", F.explode(F.arrays_zip("cells", "depths")).alias("c")).select("root", "cells", F.col("c.cells").alias("id"), F.col("c.depths").alias("d")).join(gates, "id")
    packed = rows.groupBy("root", "cells").agg(F.array_sort(F.collect_list(F.struct((-F.col("d")).alias("far"), "id", "tt", "nets"))).alias("gates"))
    nets = F.expr("array_sort(array_except(array_distinct(flatten(transform(gates, g -> g.nets))), cells))")
    packed = packed.withColumn("inputs", nets).withColumn("n", F.size("inputs")).withColumn("ones", F.expr("array_repeat(-1L, cast(shiftleft(1, greatest(n - 6, 0)) AS int))"))
    columns = ", ".join(f"{x - (1 << 64) if x >> 63 else x}L" for x in _COLUMNS)
    # input i changes with bit n - 1 - i of the row; from bit 6 on whole words change
    pattern = (
        f"transform(inputs, (x, i) -> if(n - 1 - i < 6, array_repeat(element_at(array({columns}), least(n - i, 6)), size(ones)),"
        " transform(ones, (w, k) -> if(getbit(k, n - 7 - i) = 1, -1L, 0L))))"
    )
    packed = packed.withColumn("start", F.map_from_arrays("inputs", F.expr(pattern)))
    term = "aggregate(sequence(0, size(g.nets) - 1), ones, (x, i) -> zip_with(x, element_at(m, g.nets[i]), (p, q) -> p & if(getbit(r, size(g.nets) - 1 - i) = 1, q, ~q)))"
    value = f"aggregate(sequence(0, length(g.tt) - 1), transform(ones, w -> 0L), (v, r) -> if(substring(g.tt, r + 1, 1) = '1', zip_with(v, {term}, (p, q) -> p | q), v))"
    out = packed.withColumn("out", F.expr(f"element_at(aggregate(gates, start, (m, g) -> map_concat(m, map(g.id, {value}))), root)"))
    bits = F.array_join(F.transform("out", lambda w: F.lpad(F.bin(w), 64, "0")), "")
    return out.select("root", "cells", F.col("inputs"), F.substring(bits, F.lit(1), F.expr("cast(shiftleft(1, n) AS int)")).alias("tt"))


def attributes(found: DataFrame, edges: DataFrame, areas: DataFrame) -> DataFrame:
    """Clusters (root, cells, depth) with area, internal nets (driver and all loads inside), and drivers outside and cells seen from outside.

    A cell's net is seen from outside if it is the root, has a load outside or none at all.
    """
    rows = found.select("root", "cells", "depth", F.explode("cells").alias("id"))
    own = rows.join(areas.select("id", "area"), "id").groupBy("root", "cells", "depth").agg(F.sum("area").alias("area"))
    into = edges.select("driver", F.col("load").alias("id")).distinct()
    inputs = rows.join(into, "id").where(~F.array_contains("cells", F.col("driver"))).groupBy("root", "cells").agg(F.countDistinct("driver").alias("boundary_inputs"))
    out = edges.select(F.col("driver").alias("id"), "load").distinct()
    loads = rows.join(out, "id", "left").groupBy("root", "cells", "id").agg(
        F.count("load").alias("n"), F.count(F.when(F.array_contains("cells", F.col("load")), 1)).alias("inside")
    )
    seen = (F.col("id") == F.col("root")) | (F.col("n") == 0) | (F.col("inside") < F.col("n"))
    nets = loads.groupBy("root", "cells").agg(F.count(F.when(seen, 1)).alias("boundary_outputs"), F.count(F.when((F.col("n") > 0) & (F.col("inside") == F.col("n")), 1)).alias("internal_nets"))
    return own.join(nets, ["root", "cells"]).join(inputs, ["root", "cells"], "left").select("*")
