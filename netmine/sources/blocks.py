"""Scans of block-structured text into typed tables.

Libraries and netlists are read by ranges (`ranges`): one file gives many tasks, and
a task parses one cell or statement at a time.  Layout and circuit files are read whole,
one row each.  Parsing runs in Arrow batches with a schema that is stated, never
inferred, and malformed input raises.
"""

from __future__ import annotations

import re
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netmine.operators.order import numbered
from netmine.session import saved
from netmine.sources import ranges

_SEQUENTIAL = frozenset(["ff", "ff_bank", "latch", "latch_bank", "statetable", "sequential"])


def whole_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, text of every matching file below a folder."""
    rows = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def _mapped(files: DataFrame, parse, schema: str, arrow: pa.Schema) -> DataFrame:
    def run(batches):
        texts = ((p.as_py(), t.as_py()) for batch in batches for p, t in zip(batch.column("path"), batch.column("text")))
        rows = (r for path, text in texts for r in parse(path, text))  # one text at a time; rows of many short texts go together
        while piece := list(islice(rows, 4096)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*piece), arrow.types)], schema=arrow)

    return files.select("path", "text").mapInArrow(run, schema)


# ---------------------------------------------------------------- libraries of cells

_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[{}();:,]|[^\s{}();:,"]+')


def _lines(source: DataFrame) -> DataFrame:
    """Lines by ranges as they are, or those of whole texts (path, text)."""
    return source if "value" in source.columns else ranges.of_texts(source)


def _statements(text: str):
    """Nested groups as (name, arguments, attributes, groups) of a text without comments."""
    tokens = _TOKEN.findall(text.replace("\\\n", " "))
    root = ("", [], {}, [])
    stack, i = [root], 0
    while i < len(tokens):
        t = tokens[i]
        if t == "}":
            if len(stack) == 1:
                raise ValueError("unbalanced }")
            stack.pop()
            i += 1
        elif t in ";,":
            i += 1
        elif i + 1 < len(tokens) and tokens[i + 1] == ":":
            j = i + 2
            while j < len(tokens) and tokens[j] not in (";", "}"):
                j += 1
            stack[-1][2].setdefault(t, " ".join(x.strip('"') for x in tokens[i + 2 : j]))
            i = j
        elif i + 1 < len(tokens) and tokens[i + 1] == "(":
            j = tokens.index(")", i)
            group = (t, [x.strip('"') for x in tokens[i + 2 : j] if x != ","], {}, [])
            i = j + 1
            if i < len(tokens) and tokens[i] == "{":
                stack[-1][3].append(group)
                stack.append(group)
                i += 1
        else:
            i += 1
    if len(stack) > 1:
        raise ValueError("unbalanced {")
    return root


#: A record that is a cell.
_CELL = r"^\s*cell\s*\("


def _cell(path: str, cell: tuple):
    pins, functions, sequential = [], [], any(g[0] in _SEQUENTIAL for g in cell[3])
    for g in cell[3]:
        if g[0] == "bus":
            raise ValueError(f"{path}: bus in cell {cell[1][0]} is not supported")
        names = g[1] if g[0] == "pin" else re.split(r"[,\s]+", g[2].get("members", "")) if g[0] == "bundle" else []
        inner = [g] if g[0] == "pin" else [x for x in g[3] if x[0] == "pin"]
        attributes = {**g[2], **(inner[0][2] if g[0] == "bundle" and inner else {})}
        direction = attributes.get("direction", "")
        for name in filter(None, names):
            if direction in ("input", "output", "inout"):
                pins.append({"name": name, "direction": direction})
                if direction == "output" and "function" in attributes:
                    functions.append({"pin": name, "function": attributes["function"]})
    area = float(cell[2]["area"]) if "area" in cell[2] else None
    return path, cell[1][0], area, sequential, pins, functions


def _parsed_cells(path: str, text: str):
    for group in _statements(text)[3]:
        if group[0] == "cell":
            yield _cell(path, group)


def liberty(source: DataFrame) -> DataFrame:
    """One row for each library cell of texts (path, text) or of lines by ranges; pins of other directions than input, output and inout are dropped."""
    pin = pa.list_(pa.struct([("name", pa.string()), ("direction", pa.string())]))
    fun = pa.list_(pa.struct([("pin", pa.string()), ("function", pa.string())]))
    return _mapped(
        ranges.records(ranges.LIBRARY, _lines(source)).where(F.col("text").rlike(_CELL)), _parsed_cells,
        "path string, name string, area double, is_seq boolean, pins array<struct<name: string, direction: string>>, functions array<struct<pin: string, function: string>>",
        pa.schema([("path", pa.string()), ("name", pa.string()), ("area", pa.float64()), ("is_seq", pa.bool_()), ("pins", pin), ("functions", fun)]),
    )


def light(cells: DataFrame) -> DataFrame:
    """Combinational cells with one output: name, area, function, sorted inputs."""
    outputs = F.filter("pins", lambda x: x["direction"] == "output")
    inputs = F.array_sort(F.transform(F.filter("pins", lambda x: x["direction"] == "input"), lambda x: x["name"]))
    return cells.where(~F.col("is_seq") & (F.size(outputs) == 1) & (F.size("functions") == 1)).select("name", "area", F.col("functions")[0]["function"].alias("function"), inputs.alias("inputs"))


def classified(cells: DataFrame) -> DataFrame:
    """path, name, class and the first function of each file: seq, const (no variable), buf_inv (one), logic."""
    from netmine.functions import expr

    first = cells.withColumn("function", F.col("functions")[0]["function"])
    n = F.size(expr.variables(F.col("function")))
    kind = F.when(F.col("is_seq"), "seq").when(F.col("function").isNull(), "none").when(n == 0, "const").when(n == 1, "buf_inv").otherwise("logic")
    return first.select("path", "name", kind.alias("cell_class"), "function").groupBy("path").agg(F.min(F.struct("name", "cell_class", "function")).alias("m")).select("path", "m.*")


def cell_names(files: DataFrame) -> DataFrame:
    """path, stem (what stands before `_tt_` in the file's name) and the name of every cell group; built-in functions only."""
    base = F.element_at(F.split("path", "/"), -1)
    stem = F.regexp_replace(F.split_part(base, F.lit("_tt_"), F.lit(1)), r"\.lib$", "")
    return files.select("path", stem.alias("stem"), F.explode(F.regexp_extract_all("text", F.lit(r"\bcell\s*\(\s*\"?([^\s\")]+)"), F.lit(1))).alias("name"))


def _bare(text: str) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def merged_library(source: DataFrame) -> DataFrame:
    """The parts of one library made from many: variant, path, block, seq, kind (head or cell), text; write them in this order.

    What stands in a file before its first cell is its head.  Files with equal heads (comments and date aside) form a
    variant, numbered by first path, whose templates get the ending _v<number>, in its one head and in its cells.  A head
    is one value; cells stay rows, so the merged text is never in one task.
    """
    parts = saved(ranges.records(ranges.LIBRARY, _lines(source)).withColumn("is_cell", F.col("text").rlike(_CELL)))
    place = F.struct("block", "seq")
    first = parts.where("is_cell").groupBy("path").agg(F.min(place).alias("first"))
    before = parts.join(first, "path").where((F.struct("block", "seq") < F.col("first")) & ~F.col("text").rlike(r"^\s*library\s*\("))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("block", "seq", _bare("text").alias("text")))), lambda x: x["text"])
    plain = F.array_join(F.filter("listed", lambda x: ~x.rlike(r'^date\s*:')), "\n")
    heads = first.join(before.groupBy("path").agg(listed.alias("listed")), "path", "left").select("path", F.coalesce(F.array_join("listed", "\n"), F.lit("")).alias("head"), F.coalesce(plain, F.lit("")).alias("plain"))
    kinds = numbered(heads.groupBy("plain").agg(F.min("path").alias("path"), F.min_by("head", "path").alias("head")), [F.col("path").asc()], "variant")
    template = r"\b\w+\s*\(\s*\"?([A-Za-z_]\w*)\"?\s*\)\s*\{"
    kinds = saved(kinds.withColumn("t", F.array_distinct(F.regexp_extract_all("head", F.lit(template), F.lit(1)))))
    ending = lambda text: F.aggregate("t", text, lambda acc, x: F.regexp_replace(acc, F.concat(F.lit(r"\b"), x, F.lit(r"\b")), F.concat(x, F.lit("_v"), F.col("variant").cast("string"))))
    top = kinds.select("variant", "path", F.lit(-1).cast("long").alias("block"), F.lit(-1).cast("long").alias("seq"), F.lit("head").alias("kind"), ending(F.col("head")).alias("text"))
    of_path = heads.join(kinds.select("plain", "variant", "t"), "plain").select("path", "variant", "t")
    cells = parts.where("is_cell").join(of_path, "path").select("variant", "path", "block", "seq", F.lit("cell").alias("kind"), ending(_bare("text")).alias("text"))
    return top.union(cells)


# ---------------------------------------------------------------- netlists


_PORT = re.compile(r"(input|output|inout)\b\s*(?:wire\b)?\s*(?:\[[^\]]*\])?\s*(.*)$", flags=re.S)
_INSTANCE = re.compile(r"([A-Za-z_]\w*)\s+(\\\S+\s|[\w$.\[\]]+)\s*\((.*)\)\s*$", flags=re.S)
_CONNECTION = re.compile(r"\.(\w+)\s*\(\s*([^()]*?)\s*\)")
_NOT_MASTERS = frozenset(["wire", "assign", "supply0", "supply1", "reg", "parameter", "module"])


def _statement(path: str, text: str):
    """Rows (is_instance, name, master, pin, net) of one statement: an instance's connections, or ports, whose master is their direction."""
    s = text.strip()
    kind = _PORT.match(s)
    if kind:
        for port in filter(None, (x.strip() for x in kind[2].split(","))):
            yield False, port, kind[1], port, port
        return
    inst = _INSTANCE.match(s)
    if not inst or inst[1] in _NOT_MASTERS:
        return
    name, found = inst[2].strip().lstrip("\\"), False
    for pin, net in _CONNECTION.findall(inst[3]):
        if net.startswith("{"):
            raise ValueError(f"{path}: concatenation at {name}.{pin}")
        constant, found = re.fullmatch(r"1'b([01x])", net), True
        yield True, name, inst[1], pin, f"$const${constant[1]}" if constant else net.lstrip("\\").strip()
    if not found:
        yield True, name, inst[1], None, None  # it has a number all the same


def netlist(source: DataFrame) -> DataFrame:
    """Connections (path, module, number, name, master, pin, net) of the modules of texts (path, text) or of lines by ranges.

    Instance numbers count from 1 within a module, ports are 0 with their direction as master.  A number is the place
    inside a range and what the ranges before it hold.
    """
    names = ["path", "module", "block", "seq", "is_instance", "name", "master", "pin", "net"]
    schema = pa.schema([(n, pa.int64() if n in ("block", "seq") else pa.bool_() if n == "is_instance" else pa.string()) for n in names])

    def run(batches):
        for batch in batches:
            path, block, seq, module, text = (batch.column(c).to_pylist() for c in ("path", "block", "seq", "carry", "text"))
            rows = ((p, m, b, k, *r) for p, b, k, m, t in zip(path, block, seq, module, text) for r in _statement(p, t))
            while piece := list(islice(rows, 4096)):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*piece), schema.types)], schema=schema)

    statements = ranges.records(ranges.NETLIST, _lines(source)).where(F.col("carry").isNotNull())
    ddl = ", ".join(f"{n} {'long' if n in ('block', 'seq') else 'boolean' if n == 'is_instance' else 'string'}" for n in names)
    rows = saved(statements.mapInArrow(run, ddl))
    module = ["path", "module"]
    instances = rows.where("is_instance").select(*module, "block", "seq").distinct()
    inside = instances.withColumn("place", F.row_number().over(Window.partitionBy(*module, "block").orderBy("seq")))
    earlier = Window.partitionBy(*module).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = instances.groupBy(*module, "block").agg(F.count("*").alias("n")).select(*module, "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    numbers = inside.join(before, [*module, "block"]).select(*module, "block", "seq", (F.col("before") + F.col("place")).cast("int").alias("number"))
    return rows.join(numbers, [*module, "block", "seq"], "left").where("NOT is_instance OR pin IS NOT NULL").select(
        *module, F.coalesce("number", F.lit(0)).alias("number"), "name", "master", "pin", "net"
    )


def flattened(rows: DataFrame, top: str, depth: int = 16) -> DataFrame:
    """The rows of `netlist` of one design with modules inside `top` opened: instances get names `outer/inner`, nets of ports those outside.

    An instance whose master is a module of the same file is opened, level by level, up to `depth`; a deeper one raises.
    """
    modules = rows.select("path", F.col("module").alias("master")).distinct()
    ports = rows.where("number = 0").select("path", F.col("module").alias("master"), F.col("pin").alias("port"))
    inner = rows.where("number > 0")
    level = inner.where(F.col("module") == top).select("path", "name", "master", "pin", "net")
    done = None
    for _ in range(depth):
        opened = level.join(modules, ["path", "master"], "left_semi")
        leaf = level.join(modules, ["path", "master"], "left_anti")
        done = leaf if done is None else done.union(leaf)
        if opened.isEmpty():
            return done
        outer = opened.join(ports.withColumnRenamed("port", "pin"), ["path", "master", "pin"], "left_semi").select("path", F.col("name").alias("outer"), F.col("master").alias("module"), F.col("pin").alias("inner_net"), F.col("net").alias("outer_net"))
        place = opened.select("path", F.col("name").alias("outer"), F.col("master").alias("module")).distinct()
        below = inner.join(place, ["path", "module"]).join(outer.withColumnRenamed("inner_net", "net"), ["path", "outer", "module", "net"], "left")
        level = below.select(
            "path", F.concat("outer", F.lit("/"), "name").alias("name"), "master", "pin",
            F.when(F.col("outer_net").isNotNull(), F.col("outer_net")).when(F.col("net").startswith("$const$"), F.col("net")).otherwise(F.concat("outer", F.lit("/"), "net")).alias("net"),
        )
    raise ValueError(f"modules are nested deeper than {depth}")


def connections(rows: DataFrame, directions: DataFrame) -> DataFrame:
    """Driver to load edges: rows of `netlist` with directions (master, pin, direction); a pin without one raises.

    The first output pin on a net drives it, later ones count as loads; ports drive and load nothing.
    """
    cells = rows.where("number > 0").join(F.broadcast(directions), ["master", "pin"], "left").withColumn(
        "direction", F.coalesce("direction", F.raise_error(F.concat(F.lit("no direction for "), "master", F.lit("."), "pin")))
    )
    drivers = cells.where("direction = 'output'").groupBy("path", "module", "net").agg(F.min(F.struct("number", "pin")).alias("d"))
    loads = cells.join(drivers, ["path", "module", "net"]).where((F.col("number") != F.col("d.number")) | (F.col("pin") != F.col("d.pin")))
    return loads.select("path", "module", F.col("d.number").cast("long").alias("driver"), F.col("number").cast("long").alias("load"), F.col("pin").alias("term"), "net")


# ---------------------------------------------------------------- layout and circuits


def parse_def(path: str, text: str):
    units = re.search(r"UNITS\s+DISTANCE\s+MICRONS\s+(\d+)", text)
    if not units:
        raise ValueError(f"{path}: no UNITS")
    scale = float(units[1])
    part = re.search(r"\bCOMPONENTS\b(.*?)\bEND\s+COMPONENTS\b", text, flags=re.S)
    for name, master, body in re.findall(r"-\s+(\S+)\s+(\S+)([^;]*);", part[1] if part else ""):
        at = re.search(r"\+\s*(?:PLACED|FIXED)\s*\(\s*(-?\d+)\s+(-?\d+)\s*\)", body)
        yield path, name.lstrip("\\"), master, *((float(at[1]) / scale, float(at[2]) / scale) if at else (None, None))


def placement(files: DataFrame) -> DataFrame:
    """Instances with their master and place in microns; null where unplaced."""
    return _mapped(
        files, parse_def, "path string, name string, master string, x double, y double",
        pa.schema([("path", pa.string()), ("name", pa.string()), ("master", pa.string()), ("x", pa.float64()), ("y", pa.float64())]),
    )


def die_area(files: DataFrame) -> DataFrame:
    """path, lo_x, lo_y, hi_x, hi_y of the bounding box of all points of DIEAREA, in microns; built-in functions only."""
    body = F.regexp_extract("text", r"\bDIEAREA\b([^;]*);", 1)
    scale = F.regexp_extract("text", r"UNITS\s+DISTANCE\s+MICRONS\s+(\d+)", 1).cast("double")
    axis = lambda i: F.transform(F.regexp_extract_all(body, F.lit(r"\(\s*(-?\d+)\s+(-?\d+)\s*\)"), F.lit(i)), lambda x: x.cast("double"))
    rows = files.where(F.size(axis(1)) > 0).select("path", axis(1).alias("x"), axis(2).alias("y"), scale.alias("s"))
    return rows.select("path", *[(f("%s" % c) / F.col("s")).alias(n) for n, f, c in (("lo_x", F.array_min, "x"), ("lo_y", F.array_min, "y"), ("hi_x", F.array_max, "x"), ("hi_y", F.array_max, "y"))])


def placed(instances: DataFrame, places: DataFrame) -> DataFrame:
    """Instances (path, name) with x and y of the layout, null where it has none."""
    return instances.join(places.select("path", "name", "x", "y"), ["path", "name"], "left")


def parse_lef(path: str, text: str):
    found = False
    for name, body in re.findall(r"\bMACRO\s+(\S+)(.*?)\bEND\s+\1\b", text, flags=re.S):
        found = True
        size = re.search(r"\bSIZE\s+([\d.]+)\s+BY\s+([\d.]+)", body)
        site = re.search(r"\bSITE\s+(\S+)\s*;", body)
        symmetry = re.search(r"\bSYMMETRY\s+([^;]*);", body)
        flags = sum({"X": 1, "Y": 2, "R90": 4}.get(x, 0) for x in (symmetry[1].split() if symmetry else []))
        yield path, name, *(map(float, size.groups()) if size else (None, None)), site[1] if site else None, flags
    if not found:
        raise ValueError(f"{path}: no MACRO")


def macros(files: DataFrame) -> DataFrame:
    """Name, width, height, site and symmetry bits (X 1, Y 2, R90 4) of layout macros."""
    return _mapped(
        files, parse_lef, "path string, name string, width double, height double, site string, symmetry int",
        pa.schema([("path", pa.string()), ("name", pa.string()), ("width", pa.float64()), ("height", pa.float64()), ("site", pa.string()), ("symmetry", pa.int32())]),
    )


#: Suffixes of numbers in circuit files.
SUFFIX = {"": 1.0, "meg": 1e6, "g": 1e9, "k": 1e3, "m": 1e-3, "u": 1e-6, "n": 1e-9, "p": 1e-12, "f": 1e-15}


def number(text: str) -> float:
    m = re.fullmatch(r"([-+]?(?:\d+\.?\d*|\.\d+)(?:e[-+]?\d+)?)([a-z]*)", text.strip().lower())
    if not m or m[2] not in SUFFIX:
        raise ValueError(f"not a number: {text!r}")
    return float(m[1]) * SUFFIX[m[2]]


def parse_circuit(path: str, text: str):
    cell, pins = None, []
    for line in re.sub(r"\n\+", " ", text).split("\n"):
        words = line.split()
        if not words:
            continue
        if words[0].upper() == ".SUBCKT":
            cell, pins = words[1], [w for w in words[2:] if "=" not in w]
        elif words[0].upper() == ".ENDS":
            cell = None
        elif words[0][0] in "Mm" and cell is not None:
            options = {k.lower(): number(v) for k, v in (x.split("=", 1) for x in words[6:] if "=" in x)}
            fins = options.get("nfin", options.get("m", 1.0))
            yield path, cell, pins, words[0], words[1], words[2], words[3], words[5], options.get("w"), options.get("l"), fins


def circuits(files: DataFrame) -> DataFrame:
    """Transistors of sub-circuits with the pins of their cell: drain, gate, source, model, width, length, fins (nfin before m)."""
    names = ["name", "drain", "gate", "source", "model"]
    return _mapped(
        files, parse_circuit, "path string, cell string, pins array<string>, " + ", ".join(f"{n} string" for n in names) + ", w double, l double, fins double",
        pa.schema([("path", pa.string()), ("cell", pa.string()), ("pins", pa.list_(pa.string()))] + [(n, pa.string()) for n in names] + [(n, pa.float64()) for n in ("w", "l", "fins")]),
    )


def transistors(files: DataFrame) -> DataFrame:
    """The same without the pins."""
    return circuits(files).drop("pins")


def transistor_counts(rows: DataFrame) -> DataFrame:
    """Counts of both polarities and their fins for each cell; a model whose name starts with n is of type n."""
    n = F.lower("model").startswith("n")
    return rows.groupBy("cell").agg(
        F.count(F.when(n, 1)).alias("n_nmos"), F.count(F.when(~n, 1)).alias("n_pmos"), F.sum(F.when(n, F.col("fins")).otherwise(0)).alias("nfin_n"),
        F.sum(F.when(~n, F.col("fins")).otherwise(0)).alias("nfin_p"), F.count("*").alias("total"),
    )
