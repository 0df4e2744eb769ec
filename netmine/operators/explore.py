"""General search for cell sets: several outputs, distances, inner fan-out, with the reason for every set that is left out.

A state is a row: its root, its cells as a sorted array, and what is known of each
cell (drivers, number of loads, place).  Depth is the longest path to the root within
the set, distance the shortest way of hops to it; both follow from the set alone, so
the rounds give the same sets in whatever order they grow.  A set holds a few cells
and a cell a few drivers; of loads only the number is kept, so rows stay small
whatever the fan-out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Bounds:
    min_cells: int = 2
    max_cells: int = 8
    min_inputs: int = 2
    max_inputs: int = 4
    max_outputs: int = 1
    max_depth: int = 3
    max_distance: float | None = None
    max_root_dx: float | None = None
    max_root_dy: float | None = None
    allow_internal_fanout: bool = False


def _info(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """id, drivers, number of loads, x, y; drivers below 0 are nets that no cell drives."""
    pins = edges.groupBy("load").agg(F.array_sort(F.collect_set("driver")).alias("drivers"))
    fan = edges.where("driver >= 0").groupBy("driver").agg(F.countDistinct("load").alias("n_loads"))
    return cells.select("id", "x", "y").join(pins.withColumnRenamed("load", "id"), "id", "left").join(fan.withColumnRenamed("driver", "id"), "id", "left").select(
        "id", F.coalesce("drivers", F.expr("cast(array() AS array<bigint>)")).alias("drivers"), F.coalesce("n_loads", F.lit(0)).alias("n_loads"), "x", "y"
    )


#: For each member the places of its loads within the set, found once for all that follows.
_LOADS = "transform(g, a -> filter(sequence(0, size(g) - 1), j -> array_contains(g[j].drivers, a.id)))"
# relaxations over the members g, as often as there are cells
_DEPTH = """aggregate(sequence(1, size(g)), transform(g, a -> if(a.id = root, 1, 0)), (d, _) -> transform(g, (a, i) -> if(a.id = root, 1,
  1 + coalesce(array_max(transform(inner_loads[i], j -> d[j])), 0))))"""
_HOP = "coalesce(sqrt(pow(nanvl(a.x - g[j].x, 0D), 2) + pow(nanvl(a.y - g[j].y, 0D), 2)), 0D)"
_DIST = f"""aggregate(sequence(1, size(g)), transform(g, a -> if(a.id = root, 0D, cast('Infinity' AS double))), (d, _) -> transform(g, (a, i) -> if(a.id = root, 0D,
  coalesce(array_min(transform(inner_loads[i], j -> d[j] + {_HOP})), cast('Infinity' AS double)))))"""
_AXIS = "array_max(transform(g, a -> coalesce(abs(nanvl(a.{0} - element_at(filter(g, b -> b.id = root), 1).{0}, 0D)), 0D)))"
#: Loads of a member outside of the set.
_OUT = "(a.n_loads - size(inner_loads[i]))"


def _judged(state: DataFrame, bounds: Bounds, places: bool = True) -> DataFrame:
    """State with depth, n_inputs, n_outputs and the verdict; without `places` distances are not made and not bounded."""
    state = state.withColumn("inner_loads", F.expr(_LOADS))
    outside = f"size(filter(g, (a, i) -> a.id <> root AND (a.n_loads = 0 OR {_OUT} > 0)))"
    budget = f"size(filter(g, (a, i) -> a.id <> root AND {_OUT} > {bounds.max_cells} - size(cells))) > 0"
    far = [F.array_max(F.expr(_DIST)).alias("distance"), F.expr(_AXIS.format("x")).alias("dx"), F.expr(_AXIS.format("y")).alias("dy")] if places else []
    rows = state.select(
        "*", F.array_max(F.expr(_DEPTH)).cast("int").alias("depth"), F.expr(f"1 + {outside}").alias("n_outputs"), F.expr(f"{outside} > 0").alias("inner_out"),
        F.expr(budget).alias("over"), *far,
        F.size("front").alias("n_inputs"), F.size("cells").alias("n_cells"),
    )
    limit = lambda column, most: F.lit(False) if most is None or not places else F.col(column) > most
    accept = (
        F.col("n_cells").between(bounds.min_cells, bounds.max_cells) & F.col("n_inputs").between(bounds.min_inputs, bounds.max_inputs) & (F.col("depth") >= 2)
        & (F.lit(bounds.allow_internal_fanout or bounds.max_outputs > 1) | ~F.col("inner_out"))
    )
    verdict = (
        F.when(F.col("n_outputs") > bounds.max_outputs, "prune:max_outputs").when(F.col("over"), "prune:external_loads").when(limit("distance", bounds.max_distance), "prune:max_distance")
        .when(limit("dx", bounds.max_root_dx), "prune:max_root_dx").when(limit("dy", bounds.max_root_dy), "prune:max_root_dy").when(F.col("n_cells") > bounds.max_cells, "prune:max_cells")
        .when(F.col("depth") > bounds.max_depth, "prune:max_depth").when(accept, "include").otherwise("skip:bounds")
    )
    return rows.withColumn("verdict", verdict)


def search(cells: DataFrame, edges: DataFrame, saved, bounds: Bounds = Bounds(), roots: DataFrame | None = None, places: bool = True) -> DataFrame:
    """Every state that is reached: root, cells, n_cells, n_inputs, n_outputs, depth, distance, dx, dy, verdict.

    cells (id, x, y) without sequential ones, edges (driver, load); `saved` cuts the lineage of each round.  Sets that
    are pruned don't grow; sets that only miss the bounds of acceptance do.  Two rounds hold different sizes, so a set
    is met in one round only.  Without `places` there are no distance, dx and dy.
    """
    info = saved(_info(cells, edges))
    member = F.struct("id", "drivers", "n_loads", "x", "y")
    first = info if roots is None else info.join(roots.select("id"), "id", "left_semi")
    state = first.select(F.col("id").alias("root"), F.array("id").alias("cells"), F.array(member).alias("g"), F.col("drivers").alias("front"))
    shown = ["root", "cells", "n_cells", "n_inputs", "n_outputs", "depth", *(["distance", "dx", "dy"] if places else []), "verdict"]
    rounds = []
    for _ in range(bounds.max_cells + 1):
        judged = saved(_judged(state, bounds, places).drop("inner_loads"))
        rounds.append(judged.select(shown))
        open_ = judged.where(~F.col("verdict").startswith("prune:")).select("root", "cells", "g", "front")
        grown = open_.select("*", F.explode("front").alias("id")).join(info, "id").select(
            "root", F.array_sort(F.array_append("cells", F.col("id"))).alias("cells"), F.array_append("g", member).alias("g"),
            F.expr("array_sort(array_except(array_union(front, drivers), array_append(cells, id)))").alias("front"),
        )
        state = grown.dropDuplicates(["root", "cells"])
        if state.isEmpty():
            break
    out = rounds[0]
    for r in rounds[1:]:
        out = out.union(r)
    return out


def only(found: DataFrame, targets: DataFrame) -> DataFrame:
    """Sets (with p_key) of the wanted functions; keys of different numbers of inputs raise."""
    wanted = targets.select("p_key").distinct()
    sizes = wanted.agg(F.countDistinct(F.length("p_key")).alias("k"))
    checked = wanted.crossJoin(sizes).select(  # one row
        F.when(F.col("k") <= 1, F.col("p_key")).otherwise(F.raise_error(F.lit("keys of different numbers of inputs")).cast("string")).alias("p_key")
    )
    return found.join(checked, "p_key", "left_semi")


def structural_groups(cells: DataFrame, edges: DataFrame, saved, depth: int) -> DataFrame:
    """(id, shape): cells with equal shape have cones that look alike down to `depth`: gate, number of loads, and by pin the shapes below.

    One representative of a shape can be searched for all of it.  Shapes are 128-bit digests.
    """
    loads = edges.groupBy("driver").agg(F.countDistinct("load").alias("n")).withColumnRenamed("driver", "id")
    base = cells.select("id", "gate").join(loads, "id", "left").select("id", F.concat_ws("|", F.col("gate"), F.coalesce("n", F.lit(0)).cast("string")).alias("own"))
    shape = saved(base.select("id", F.md5("own").alias("shape")))
    for _ in range(depth - 1):
        below = edges.join(shape.select(F.col("id").alias("driver"), "shape"), "driver", "left").groupBy(F.col("load").alias("id")).agg(
            F.array_sort(F.collect_list(F.struct("term", F.coalesce("shape", F.lit("-")).alias("s")))).alias("l")
        )
        text = F.concat_ws("|", F.col("own"), F.array_join(F.transform("l", lambda x: F.concat(x["term"], F.lit("="), x["s"])), ","))
        shape = saved(base.join(below, "id", "left").select("id", F.md5(text).alias("shape")))
    return shape


def _codes(heads: DataFrame, info: DataFrame, edges: DataFrame, saved, steps: int) -> DataFrame:
    """(root, id, code, paths): every cell or net within `steps` pins of a root, its least path of pin names, and all of them."""
    level = heads.select(F.col("id").alias("root"), "id", F.lit("").alias("path"))
    every = level
    pins = edges.select(F.col("load").alias("id"), "driver", "term")
    for _ in range(steps):
        level = saved(level.join(pins, "id").select("root", F.col("driver").alias("id"), F.concat("path", F.lit("/"), "term").alias("path")))
        every = every.union(level)
    return every.groupBy("root", "id").agg(F.min("path").alias("code"), F.array_sort(F.collect_set("path")).alias("paths"))


def replay(cells: DataFrame, edges: DataFrame, saved, bounds: Bounds = Bounds(), roots: DataFrame | None = None) -> DataFrame:
    """Every state that `search` reaches, most of them without judging: root, cells, n_cells, n_inputs, n_outputs, depth, verdict, replayed.

    cells (id, gate, x, y), edges (driver, load, term).  Roots of one shape are told apart further by where their paths of
    pins meet and how many loads each cell has, so that members of a group have the same cone cell by cell: a state of
    the least member names, by the paths of its cells, a state of every other one, with the same verdict.  A root that
    only looks like others from its gates, say with a lower fan-out or other meeting points, is searched itself.
    Distances depend on places, so bounds on them leave nothing to replay.
    """
    shown = ["root", "cells", "n_cells", "n_inputs", "n_outputs", "depth", "verdict"]
    bare = edges.select("driver", "load")
    if any(b is not None for b in (bounds.max_distance, bounds.max_root_dx, bounds.max_root_dy)):
        return search(cells, bare, saved, bounds, roots).select(*shown, F.lit(False).alias("replayed"))
    steps = bounds.max_depth + 1  # a state reaches one level below the deepest that grows, and its nets one further
    shape = structural_groups(cells, edges, saved, steps)
    shape = shape if roots is None else shape.join(roots.select("id"), "id", "left_semi")
    several = saved(shape.join(shape.groupBy("shape").agg(F.count("*").alias("k")).where("k > 1").select("shape"), "shape"))
    info = saved(_info(cells, bare))
    seen = _codes(several, info, edges, saved, steps).join(info.select("id", F.col("n_loads")), "id", "left")
    # one row for each root: its cells and nets in the order of their codes, which is the same for all members of a group
    cell = F.struct("code", "paths", F.coalesce("n_loads", F.lit(-1)).alias("n"), "id")
    cone = seen.groupBy(F.col("root").alias("id")).agg(F.array_sort(F.collect_list(cell)).alias("c"))
    named = F.transform("c", lambda x: F.struct(x["code"], x["paths"], x["n"]))
    single = F.size(F.array_distinct(F.transform("c", lambda x: x["code"]))) == F.size("c")  # with two drivers at a pin a path names two cells
    groups = saved(several.join(cone.where(single), "id").select("id", F.concat("shape", F.md5(F.to_json(named))).alias("cone"), F.transform("c", lambda x: x["id"]).alias("ids")))
    heads = groups.groupBy("cone").agg(F.min("id").alias("head"))
    member = saved(groups.join(heads, "cone").where("id <> head").select("id", "head", "ids"))
    every = cells.select("id") if roots is None else roots.select("id")
    judged = saved(search(cells, bare, saved, bounds, every.join(member.select("id"), "id", "left_anti"), places=False).select(shown))
    # a head's states as places in that order, and these as the member's cells
    asked = member.select("head").distinct()
    theirs = groups.join(asked, groups["id"] == asked["head"]).select("head", F.col("ids").alias("head_ids"))
    state = judged.join(theirs, judged["root"] == theirs["head"]).select("head", F.expr("transform(cells, x -> cast(array_position(head_ids, x) AS int))").alias("places"), *shown[2:])
    cells_of = F.expr("array_sort(transform(places, k -> ids[k - 1]))")
    whole = F.when(F.array_min("places") > 0, cells_of).otherwise(F.raise_error(F.lit("a replayed set lost a cell")).cast("array<bigint>"))
    mapped = member.join(state, "head").select(F.col("id").alias("root"), whole.alias("cells"), *shown[2:], F.lit(True).alias("replayed"))
    return judged.withColumn("replayed", F.lit(False)).union(mapped)


def replayed(groups: DataFrame, found: DataFrame) -> DataFrame:
    """Counts of each representative's sets times the members of its shape: (shape, representative, members, sets)."""
    head = groups.groupBy("shape").agg(F.min("id").alias("representative"), F.count("*").alias("members"))
    per = found.where("verdict = 'include'").groupBy(F.col("root").alias("representative")).agg(F.count("*").alias("sets"))
    return head.join(per, "representative").select("shape", "representative", "members", "sets")
