"""Nested text read by ranges: many tasks for one file, whatever its size.

Lines come as (path, block, at, value): a block is a byte range of a file, or a run of
lines of a table, and `at` orders lines inside it; a range is whole, and in order, in
one task, which the functions below see to.  Whether a range begins inside a
comment, a string or a group depends on all ranges before it, so a scan has two passes.
The first walks every range from each state it could begin in and keeps one row: where
it ends, how the depth moved, the last name carried.  These rows are put together in
order of the ranges, which gives every range the state it begins with.  The second pass
walks again from there and cuts the text into records.  A record inside a range is done;
what stands before the first border and after the last one is a fragment, and only
fragments are brought together across ranges.

Text that ends in an open group or comment raises; blank records are dropped.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netmine.session import saved

#: Deeper than any group: no border was met.
_NONE = 1 << 30
_CHUNK = 4096
#: Lines that are walked as one text.
_PIECE = 512
#: A name that was not set.
UNSET = "\0"


def of_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Lines of all matching files below a folder; Spark splits large files at `spark.sql.files.maxPartitionBytes`."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")


def of_texts(files: DataFrame, lines: int = 4096) -> DataFrame:
    """Lines of texts that are values of a column (path, text)."""
    rows = files.select("path", F.posexplode(F.split("text", "\r?\n")).alias("at", "value"))  # a text's lines stay in its task, in order
    return rows.select("path", F.expr(f"at div {lines}").alias("block"), F.col("at").cast("long").alias("at"), "value")


def of_table(rows: DataFrame, path: str, order: str, value: str, width: int) -> DataFrame:
    """Lines of a table in the order of an integer column; a block holds the lines of `width` numbers."""
    lines = rows.select(F.lit(path).alias("path"), F.expr(f"{order} div {width}").alias("block"), F.col(order).cast("long").alias("at"), F.col(value).alias("value"))
    return lines.repartition("path", "block").sortWithinPartitions("path", "block", "at")


class Place(NamedTuple):
    """What the text before a place decides: state of the lexer, depth of groups, and the name carried along."""

    state: str
    depth: int = 0
    carry: str | None = None


class Move(NamedTuple):
    """What a token does: the state after it, the change of depth, the name set (`UNSET` leaves it), whether a record ends there, and whether its text is kept."""

    state: str
    depth: int = 0
    carry: str | None = UNSET
    border: bool = False
    keep: bool = False


class Grammar(NamedTuple):
    """`tokens` has, for each state, the pattern of what matters there; `step(token, state)` is what it does.

    Text is kept in the states of `kept`; a record ends at a depth of `deepest` at most.  A search is quick where every
    alternative of a pattern begins with a literal.  A token may be a whole string or comment, if it ends in this piece.
    """

    tokens: dict[str, re.Pattern]
    step: Callable[[str, str], Move]
    kept: frozenset[str]
    deepest: int
    first: str = "text"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, str]]:
    """((path, block, ...), text): up to _PIECE lines of a range as one text, each with its end; a line that is null is empty."""
    for batch in batches:
        path, block = batch.column(0).dictionary_encode().indices.to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
        borders = np.flatnonzero((path[1:] != path[:-1]) | (block[1:] != block[:-1])) + 1
        values = batch.column(batch.num_columns - 1).fill_null("").to_pylist()
        for begin, end in zip([0, *borders.tolist()], [*borders.tolist(), len(values)]):
            key = tuple(c[begin].as_py() for c in batch.columns[:-1]) if end > begin else ()
            for at in range(begin, end, _PIECE):
                yield key, "\n".join(values[at : min(at + _PIECE, end)]) + "\n"


class _Run:
    """A walk that serves all states a range could begin in that have led to its state: for each of them depth, least depth of a border, and name."""

    def __init__(self, state: str, begins: dict[str, tuple[int, int, str | None]]):
        self.state, self.begins = state, begins

    def over(self, grammar: Grammar, text: str) -> None:
        depth, low, carry, at, step = 0, _NONE, UNSET, 0, grammar.step
        while at is not None:
            begin, at, state = at, None, self.state
            for m in grammar.tokens[state].finditer(text, begin):
                after, by, name, border, _ = step(m[0], state)
                depth += by
                if border and depth < low:
                    low = depth
                if name is not UNSET:
                    carry = name
                if after != state:
                    self.state, at = after, m.end()
                    break
        for s, (d, least, name) in self.begins.items():
            self.begins[s] = d + depth, min(least, d + low) if low < _NONE else least, name if carry is UNSET else carry


def _over(grammar: Grammar, held: list[_Run], text: str) -> list[_Run]:
    """The walks after a piece; those in one state are one from here on."""
    met: dict[str, _Run] = {}
    for h in held:
        h.over(grammar, text)
        met.setdefault(h.state, h).begins.update(h.begins)
    return list(met.values())


def _summaries(grammar: Grammar, lines: DataFrame) -> DataFrame:
    """For each range and each state it could begin in: state at its end, change of depth, least depth of a border, whether a name was set, and the name.

    Walks that are in one state at the end of a piece go on as one, so most of a range is walked once or twice.
    """
    states = list(grammar.tokens)
    names = ["path", "block", "begin", "end", "delta", "low", "is_set", "carry"]
    schema = pa.schema(list(zip(names, [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string()])))

    def run(batches):
        key, held = None, []

        def done():
            rows = [(*key, s, h.state, d, low, carry is not UNSET, None if carry is UNSET else carry) for h in held for s, (d, low, carry) in h.begins.items()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

        for now, text in _runs(batches):
            if now != key:
                if key is not None:
                    yield done()
                key, held = now, [_Run(s, {s: (0, _NONE, UNSET)}) for s in states]
            held = _over(grammar, held, text)
        if key is not None:
            yield done()

    return lines.select("path", "block", "value").mapInArrow(run, "path string, block long, begin string, end string, delta long, low long, is_set boolean, carry string")


def _entries(grammar: Grammar, summaries: DataFrame) -> DataFrame:
    """The place at the begin of every range, and the number of ranges with a border before it; one row for each range of a file goes through one group."""
    first, deepest = grammar.first, grammar.deepest

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ends = {(r.block, r.begin): r for r in rows.itertuples()}
        place, number, out = Place(first), 0, []
        for block in sorted(set(rows["block"])):
            out.append((rows["path"].iloc[0], block, place.state, place.depth, place.carry, number))
            r = ends[block, place.state]
            number += place.depth + r.low <= deepest
            place = Place(r.end, place.depth + r.delta, (r.carry if isinstance(r.carry, str) else None) if r.is_set else place.carry)
        if place.depth or place.state != first:
            raise ValueError(f"{rows['path'].iloc[0]}: unbalanced at its end, {place}")
        return pd.DataFrame(out, columns=["path", "block", "state", "depth", "carry", "record"])

    return summaries.groupBy("path").applyInPandas(run, "path string, block long, state string, depth long, carry string, record long")


def records(grammar: Grammar, lines: DataFrame) -> DataFrame:
    """path, block, seq, carry, text: the records in order of (block, seq) in each path, comments replaced by spaces; `carry` is the name at the record's end."""
    entries = saved(_entries(grammar, _summaries(grammar, lines)))
    asked = lines.join(entries, ["path", "block"]).sortWithinPartitions("path", "block", "at").select("path", "block", "state", "depth", "carry", "record", "value")
    names = ["path", "block", "seq", "carry", "text", "record"]
    schema = pa.schema(list(zip(names, [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()])))

    def run(batches):
        out: list[tuple] = []
        key, text, seq, number = None, [], 0, 0
        state, depth, carry, step = grammar.first, 0, None, grammar.step

        def cut(name: str | None, is_inner: bool):
            whole = "".join(text)
            text.clear()
            if not whole.isspace() and whole:
                out.append((key[0], key[1], seq, name, whole, None if is_inner else number))

        def batch():
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
            out.clear()
            return made

        for now, piece in _runs(batches):
            if now[:2] != (key or ())[:2]:
                if key is not None:
                    cut(carry, False)
                key, seq, number = now, 0, now[5]
                state, depth, carry = now[2:5]
            at, goes_on = 0, True
            while goes_on:
                goes_on, here = False, state
                is_kept = here in grammar.kept
                for m in grammar.tokens[here].finditer(piece, at):
                    token, end = m[0], m.start()
                    state, by, name, border, keep = step(token, here)
                    if is_kept:
                        text.append(piece[at:end])
                    else:
                        text.append("\n" * piece.count("\n", at, end))
                    text.append(token if keep else " " + "\n" * token.count("\n") + " " if token[:2] in ("/*", "(*") and len(token) > 2 else " ")
                    at = m.end()
                    depth += by
                    last = carry
                    if name is not UNSET:
                        carry = name
                    if border and depth <= grammar.deepest:
                        cut(carry if carry is not None else last, seq > 0)  # a name that ends here is still the record's
                        number += seq == 0
                        seq += 1
                    if state != here:
                        goes_on = True
                        break
            text.append(piece[at:] if state in grammar.kept else "\n" * piece.count("\n", at))
            if len(out) >= _CHUNK:
                yield batch()
        if key is not None:
            cut(carry, False)
        if out:
            yield batch()

    cut_up = saved(asked.mapInArrow(run, "path string, block long, seq long, carry string, text string, record long"))
    inner = cut_up.where("record IS NULL").drop("record")
    parts = F.array_sort(F.collect_list(F.struct("block", "seq", "text")))  # two for each range
    met = cut_up.where("record IS NOT NULL").groupBy("path", "record").agg(
        F.max("block").alias("block"), F.max_by("seq", "block").alias("seq"), F.max_by("carry", "block").alias("carry"), F.array_join(F.transform(parts, lambda x: x["text"]), "").alias("text"),
    )
    return inner.unionByName(met.select("path", "block", "seq", "carry", "text"))


# ---------------------------------------------------------------- grammars


@lru_cache(maxsize=4096)
def _library_step(token: str, state: str) -> Move:
    if state == "comment":
        return Move("text")
    if state == "string":
        return Move("text" if token == '"' else state, keep=True)
    if token == "/*":
        return Move("comment")
    if token[:2] in ("//", "/*"):
        return Move(state)
    if token[0] == '"':
        return Move("string" if token == '"' else state, keep=True)
    return Move("text", (token == "{") - (token == "}"), border=True, keep=True)


#: Cell libraries: a record is a statement or a whole group inside the outermost group, or the begin or end of that.
LIBRARY = Grammar(
    {"text": re.compile(r'//[^\n]*|/\*[\s\S]*?\*/|/\*|"(?:[^"\\]|\\[\s\S])*+"|"|\{|\}|;'), "comment": re.compile(r"\*/"), "string": re.compile(r'\\.|"')},
    _library_step, frozenset(["text", "string"]), 1,
)


@lru_cache(maxsize=4096)
def _netlist_step(token: str, state: str) -> Move:
    kind, _, back = state.partition(">")
    if kind in ("comment", "attribute"):
        return Move(back)
    if token in ("/*", "(*"):
        return Move(("comment>" if token == "/*" else "attribute>") + state)
    if token[:2] in ("//", "/*", "(*"):
        return Move(state)
    if state == "name":
        return Move("text", carry=token, keep=True)
    if token == "module":
        return Move("name", keep=True)
    if token == "endmodule":
        return Move("text", carry=None, border=True)
    return Move(state, border=token == ";", keep=token != ";")


_WORDS = re.compile(r"//[^\n]*|/\*[\s\S]*?\*/|/\*|\(\*(?!\))[\s\S]*?\*\)|\(\*(?!\))|;|\\\S+|endmodule(?<![\w$.]endmodule)(?![\w$.])|module(?<![\w$.]module)(?![\w$.])")
#: Gate-level netlists: a record is a statement without its semicolon; the module's name is carried.
NETLIST = Grammar(
    {
        "text": _WORDS, "name": re.compile(r"//[^\n]*|/\*|\(\*|[^\s(;]+"), "comment>text": re.compile(r"\*/"), "comment>name": re.compile(r"\*/"),
        "attribute>text": re.compile(r"\*\)"), "attribute>name": re.compile(r"\*\)"),
    },
    _netlist_step, frozenset(["text", "name"]), 0,
)
