"""Transistor-level measures of circuit cells.

A cell is a handful of transistors, so all of a cell's rows go to one Arrow group;
cells are dealt out by name.  The function of every stage is one integer, a truth
table over the input pins: a pull network conducts where some simple path to its
rail has all gates on, so no assignment is walked one by one.
"""

from __future__ import annotations

import math
from collections import defaultdict
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netmine.functions.expr import input_pattern, minimal_sum

# Names of supplies, and the rails that pull up and down.
SUPPLIES = frozenset(["VDD", "VSS", "VCC", "GND", "VPWR", "VGND", "VNW", "VPB"])
UP, DOWN = "VDD", "VSS"


class Device(NamedTuple):
    name: str
    drain: str
    gate: str
    source: str
    pmos: bool
    width: float
    length: float
    fins: float


def supply(net: str) -> bool:
    return net.upper() in SUPPLIES


class Circuit:
    """One cell: pins and devices."""

    def __init__(self, cell: str, pins: list[str], devices: list[Device]):
        self.cell, self.pins, self.devices = cell, pins, devices
        self.touching: dict[tuple[bool, str], list[tuple[Device, str]]] = defaultdict(list)
        for d in devices:
            self.touching[d.pmos, d.drain].append((d, d.source))
            if d.source != d.drain:
                self.touching[d.pmos, d.source].append((d, d.drain))
        self.gates = {d.gate for d in devices if not supply(d.gate)}
        self.channels = {n for d in devices for n in (d.drain, d.source) if not supply(n)}
        self.inputs, self.outputs = self.roles()
        stages = set(self.outputs) | (self.gates & self.channels)
        self.stages = sorted(s for s in stages if self.paths(s, True) or self.paths(s, False))
        self.ones = (1 << (1 << len(self.inputs))) - 1
        self.tables: dict[str, int] = {p: input_pattern(i, len(self.inputs)) for i, p in enumerate(self.inputs)}

    def paths(self, start: str, pmos: bool) -> list[list[Device]]:
        """All simple paths from a net to the rail of that polarity."""
        rail, out = UP if pmos else DOWN, []
        open_ = [(start, frozenset([start]), ())]
        while open_:
            net, seen, used = open_.pop()
            if net == rail:
                out.append(list(used))
                continue
            open_ += [(to, seen | {to}, (*used, d)) for d, to in self.touching[pmos, net] if to not in seen]
        return out

    def roles(self) -> tuple[list[str], list[str]]:
        """Inputs drive gates only; what reaches a rail, or only touches channels, is an output."""
        inputs, outputs = [], []
        for pin in self.pins:
            if supply(pin):
                continue
            if self.paths(pin, True) or self.paths(pin, False) or pin in self.channels and pin not in self.gates:
                outputs.append(pin)
            elif pin in self.gates and pin not in self.channels:
                inputs.append(pin)
            else:
                raise ValueError(f"{self.cell}: pin {pin} is neither an input nor an output")
        return sorted(inputs), sorted(outputs)

    def feeding(self, stage: str) -> list[str]:
        """Nets of the gates that a stage's channels reach without crossing a supply."""
        found, seen, open_ = set(), set(), [stage]
        while open_:
            net = open_.pop()
            if net in seen:
                continue
            seen.add(net)
            for pmos in (True, False):
                for d, to in self.touching[pmos, net]:
                    if not supply(d.gate):
                        found.add(d.gate)
                    if not supply(to):
                        open_.append(to)
        return sorted(found - {stage})

    def ordered(self) -> list[str]:
        """Stages after those that feed them; a cycle raises."""
        out: list[str] = []
        left = {s: {p for p in self.feeding(s) if p in self.stages} for s in self.stages}
        while left:
            ready = sorted(s for s, before in left.items() if before <= set(out))
            if not ready:
                raise ValueError(f"{self.cell}: cycle through {', '.join(sorted(left))}")
            out += ready
            for s in ready:
                del left[s]
        return out

    def evaluate(self) -> dict[str, int]:
        """The table of every stage; one that is not complementary raises."""
        on = lambda d: self.tables[d.gate] ^ (self.ones if d.pmos else 0)
        for stage in self.ordered():
            pulls = []
            for pmos in (True, False):
                conducts = 0
                for path in self.paths(stage, pmos):
                    each = self.ones
                    for d in path:
                        if d.gate not in self.tables:
                            raise ValueError(f"{self.cell}: gate {d.gate} has no value")
                        each &= on(d)
                    conducts |= each
                pulls.append(conducts)
            if pulls[0] ^ pulls[1] != self.ones:
                raise ValueError(f"{self.cell}: {stage} is not static")
            self.tables[stage] = pulls[0]
        return self.tables

    def depth(self) -> dict[str, int]:
        """Stages on the longest way from an input, the stage itself included."""
        out: dict[str, int] = {}
        for s in self.ordered():
            out[s] = 1 + max((out[p] for p in self.feeding(s) if p in out), default=0)
        return out

    def stage_rows(self, diffusion: float = 1.0):
        """Every stage with its paths, greatest resistance l/w of a path to each rail, and capacitance w*l on its net."""
        for s in self.stages:
            up, down = self.paths(s, True), self.paths(s, False)
            r = [max((sum(d.length / d.width if d.width > 0 else 0.0 for d in p) for p in ps), default=0.0) for ps in (up, down)]
            c = sum(d.width * d.length * (diffusion * (s in (d.drain, d.source)) + (d.gate == s)) for d in self.devices)
            yield s, len(up), len(down), *r, c, self.feeding(s)

    def sensitised(self, output: str, value) -> tuple[float, float]:
        """Least and greatest sum of `value` over conducting paths from a toggling input to the output, over all toggles."""
        n = len(self.inputs)
        feeding = {s: self.feeding(s) for s in self.stages}
        at = lambda net, row: self.tables[net] >> ((1 << n) - 1 - row) & 1
        low, high = math.inf, -1.0
        for i, source in enumerate(self.inputs):
            for before in range(1 << n):
                after = before ^ 1 << (n - 1 - i)
                reach: dict[str, tuple[float, float]] = {source: (0.0, 0.0)}
                for s in self.ordered():
                    if at(s, before) == at(s, after):
                        continue
                    came = [reach[p] for p in feeding[s] if p in reach]
                    rises = bool(at(s, after))
                    sums = [sum(map(value, p)) for p in self.paths(s, rises) if all(at(d.gate, after) != d.pmos for d in p)]
                    if came and sums:
                        reach[s] = (min(x for x, _ in came) + min(sums), max(x for _, x in came) + max(sums))
                if output in reach:
                    low, high = min(low, reach[output][0]), max(high, reach[output][1])
        if high < 0:
            raise ValueError(f"{self.cell}: no input reaches {output}")
        return low, high


def _circuit(rows: pd.DataFrame) -> Circuit:
    devices = [
        Device(r.name_, r.drain, r.gate, r.source, not str(r.model).lower().startswith("n"), float(r.w), float(r.l), float(r.fins))
        for r in rows.rename(columns={"name": "name_"}).itertuples()
    ]
    return Circuit(rows.cell.iloc[0], list(rows.pins.iloc[0]), sorted(devices))


def _grouped(rows: DataFrame, measure, schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(list(measure(_circuit(part))), columns=names)

    return rows.select("cell", "pins", "name", "drain", "gate", "source", "model", "w", "l", "fins").groupBy("cell").applyInPandas(run, schema)


def paths(rows: DataFrame) -> DataFrame:
    """For every signal pin and polarity: number of simple paths to the rail, the longest, and the greatest sum of l/w."""
    def measure(c: Circuit):
        for pin in (*c.inputs, *c.outputs):
            for pmos in (True, False):
                found = c.paths(pin, pmos)
                yield c.cell, pin, "p" if pmos else "n", len(found), max(map(len, found), default=0), max((sum(d.length / d.width for d in p) for p in found), default=0.0)

    return _grouped(rows, measure, "cell string, pin string, polarity string, n_paths long, depth long, resistance double")


def roles(rows: DataFrame) -> DataFrame:
    return _grouped(rows, lambda c: [(c.cell, p, "input") for p in c.inputs] + [(c.cell, p, "output") for p in c.outputs], "cell string, pin string, role string")


def stages(rows: DataFrame, diffusion: float = 1.0) -> DataFrame:
    """Stages with their paths, resistance and capacitance, what feeds them, and how many stages lie before and at them."""
    def measure(c: Circuit):
        depth = c.depth()
        for s, up, down, r_up, r_down, cap, feeding in c.stage_rows(diffusion):
            yield c.cell, s, up, down, r_up, r_down, cap, ",".join(feeding), depth[s]

    return _grouped(rows, measure, "cell string, stage string, n_up long, n_down long, r_up double, r_down double, capacitance double, feeding string, depth long")


def functions(rows: DataFrame) -> DataFrame:
    """The truth table of every output over its sorted input pins, a sum of products, and the sensitised ranges."""
    def measure(c: Circuit):
        tables, depth = c.evaluate(), c.depth()
        for out in c.outputs:
            bits = format(tables[out], f"0{1 << len(c.inputs)}b")
            r = c.sensitised(out, lambda d: d.length / d.width)
            cap = c.sensitised(out, lambda d: d.width * d.length)
            yield c.cell, out, ",".join(c.inputs), bits, minimal_sum(bits, c.inputs), depth[out], *r, *cap

    return _grouped(rows, measure, "cell string, output string, inputs string, bits string, expr string, stages long, r_min double, r_max double, c_min double, c_max double")


def _units(width: str, most: float):
    return F.when((F.lit(most) <= 0) | (F.col(width) <= 0), F.lit(1)).otherwise(F.ceil(F.col(width) / most - 1e-9)).cast("long")


def counts(rows: DataFrame, widest_n: float = 0.0, widest_p: float = 0.0) -> DataFrame:
    """Transistors, folded transistors, pitches and breaks of the diffusion of each cell; built-in functions only.

    A device wider than the widest is folded: each further finger counts half.  A diffusion can be drawn
    in one stroke but for (odd - 2) / 2 breaks, odd being the nets that an odd number of its devices touch.
    """
    n = F.lower("model").startswith("n")
    units = F.when(n, _units("w", widest_n)).otherwise(_units("w", widest_p))
    widest = F.when(n, F.lit(widest_n)).otherwise(F.lit(widest_p))
    folded = F.when((widest <= 0) | (F.col("w") <= 0), F.col("fins")).otherwise(1.0 + 0.5 * (F.ceil(F.col("w") / widest) - 1))
    kind = rows.withColumn("n", n)
    ends = kind.select("cell", "n", F.explode(F.array("drain", "source")).alias("net")).groupBy("cell", "n", "net").agg(F.count("*").alias("k"))
    odd = ends.groupBy("cell", "n").agg(F.count(F.when(F.col("k") % 2 == 1, 1)).alias("odd"))
    breaks = odd.select("cell", "n", F.when(F.col("odd") > 2, F.floor((F.col("odd") - 2) / 2)).otherwise(0).cast("long").alias("breaks"))
    each = kind.groupBy("cell", "n").agg(F.count("*").alias("devices"), F.sum(folded).alias("folded"), F.sum(units).alias("pitches"))
    both = each.join(breaks, ["cell", "n"])
    side = lambda name, is_n: F.sum(F.when(F.col("n") == F.lit(is_n), F.col(name)).otherwise(0))
    out = both.groupBy("cell").agg(
        *[side(name, is_n).alias(f"{name}_{'n' if is_n else 'p'}") for name in ("devices", "folded", "pitches", "breaks") for is_n in (True, False)]
    )
    return out.withColumn("cpp_min", F.greatest("pitches_n", "pitches_p")).withColumn("cpp_tight", F.greatest(F.col("pitches_n") + F.col("breaks_n"), F.col("pitches_p") + F.col("breaks_p")))


def features(rows: DataFrame, unit_fins: int) -> DataFrame:
    """Counts by fins, their ratio, longest stacks from the output (Y, else ZN) to each rail, nets inside."""
    n = F.lower("model").startswith("n")
    units = F.round(F.col("fins") / unit_fins).cast("long")
    sums = rows.groupBy("cell").agg(
        F.sum(F.when(n, units).otherwise(0)).alias("n_nmos"), F.sum(F.when(~n, units).otherwise(0)).alias("n_pmos"),
        F.sum(F.when(n, F.col("fins")).otherwise(0.0)).alias("nfin_n"), F.sum(F.when(~n, F.col("fins")).otherwise(0.0)).alias("nfin_p"),
        F.count("*").alias("total"), F.first("pins").alias("pins"), F.array_distinct(F.flatten(F.collect_list(F.array("drain", "source")))).alias("nets"),
    )
    out = F.when(F.array_contains("pins", "Y"), "Y").when(F.array_contains("pins", "ZN"), "ZN").otherwise(F.raise_error(F.concat(F.col("cell"), F.lit(": no output Y or ZN"))).cast("string"))
    stack = paths(rows).groupBy("cell", F.col("pin").alias("output")).agg(
        F.max(F.when(F.col("polarity") == "n", F.col("depth"))).alias("max_stack_n"), F.max(F.when(F.col("polarity") == "p", F.col("depth"))).alias("max_stack_p")
    )
    return sums.withColumn("output", out).join(stack, ["cell", "output"]).select(
        "cell", "n_nmos", "n_pmos", "nfin_n", "nfin_p", F.when(F.col("nfin_n") > 0, F.col("nfin_p") / F.col("nfin_n")).otherwise(0.0).alias("nfin_ratio"),
        "max_stack_n", "max_stack_p", F.size(F.array_except("nets", "pins")).cast("long").alias("n_internal"), "total",
    )


def doubled(files: DataFrame) -> DataFrame:
    """Circuits of drive 1 (path, text) rewritten for drive 2: width 46n to 92n, fins 2 to 4, the name's ending.  Other input raises."""
    text = F.col("text")
    lines = F.filter(F.split(F.regexp_replace(text, r"\n\+", " "), "\n"), lambda x: x.rlike(r"^\s*M\S+\s"))
    bad = F.filter(lines, lambda x: ~(x.rlike(r"[wW]\s*=\s*46(\.0+)?n") & x.rlike(r"\bnfin\s*=\s*2\b")))
    subckts = F.regexp_extract_all(text, F.lit(r"(?im)^\s*\.SUBCKT\s+(\S+)"), F.lit(1))
    wrong = F.filter(subckts, lambda x: ~x.endswith("_X1"))
    fail = lambda why: F.raise_error(F.concat(F.col("path"), F.lit(why))).cast("string")
    out = F.regexp_replace(text, r"(?im)^(\s*\.SUBCKT\s+\S+?)_X1(?=\s|$)", "$1_X2")
    out = F.regexp_replace(F.regexp_replace(out, r"\b([wW])\s*=\s*46(\.0+)?n", "$1=92$2n"), r"\bnfin\s*=\s*2\b", "nfin=4")
    return files.select(
        "path",
        F.when(F.size(subckts) == 0, fail(": no .SUBCKT")).when(F.size(wrong) > 0, fail(": a name without _X1")).when(F.size(lines) == 0, fail(": no transistor"))
        .when(F.size(bad) > 0, fail(": a transistor of another size")).otherwise(out).alias("text"),
    )
