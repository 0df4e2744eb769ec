"""Fill-in-the-middle: a text is cut at two units and its middle moved to the end.

A text becomes one array of code points (UTF-32).  Where the class of a code point
differs from its neighbour's a unit ends, so `flatnonzero` over one comparison
gives all boundaries; two of them, chosen by a digest of the id, cut the text into
prefix, middle and suffix, which are slices of the array.  Nothing is shuffled:
a text is read, cut and written by the task that has it, and a lost executor
costs its own partitions only, since cuts follow from the id alone.

Defined cases: null text is empty; an empty text, and one that holds a marker,
stays plain; a null id is hashed as no digits; repeated rows are cut alike; an
empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netmine.llm.common import pieces

UTF32 = "utf-32-le"
NEWLINE = 10
SPACES = np.array([0x20, *range(0x09, 0x0E)], dtype="<u4")


class Markers(NamedTuple):
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"


class Setting(NamedTuple):
    """`unit` is line, word (a run of white space or of other characters) or char; of 100 texts `rate` are cut, and of those `spm` begin with the suffix."""

    unit: str = "line"
    seed: int = 7
    rate: int = 100
    spm: int = 50
    markers: Markers = Markers()


class Cut(NamedTuple):
    """The text as it is written, how it was cut, and the number of units."""

    output: str
    form: str
    units: int
    prefix_chars: int | None = None
    middle_chars: int | None = None


def ends(codes: np.ndarray, unit: str = "line") -> np.ndarray:
    """Ascending ends of all units; the last is the text's length (an empty text has none)."""
    if codes.size == 0:
        return np.zeros(0, dtype=np.int64)
    if unit == "char":
        return np.arange(1, codes.size + 1)
    if unit == "line":
        inner = np.flatnonzero(codes[:-1] == NEWLINE)
    elif unit == "word":
        space = np.isin(codes, SPACES)
        inner = np.flatnonzero(space[:-1] != space[1:])
    else:
        raise ValueError(f"unknown unit {unit!r}")
    return np.append(inner + 1, codes.size)


def draws(seed: int, doc_id: int | None) -> tuple[int, ...]:
    """Four unsigned numbers of 32 bits that belong to the id."""
    name = f"{seed}:{'' if doc_id is None else doc_id}"
    digest = hashlib.sha256(name.encode()).digest()
    return tuple(int(x) for x in np.frombuffer(digest, dtype=">u4", count=4))


def transform(doc_id: int | None, text: str, setting: Setting = Setting()) -> Cut:
    """One text, cut as the setting says."""
    codes = np.frombuffer(text.encode(UTF32), dtype="<u4")
    bounds = ends(codes, setting.unit)
    n = int(bounds.size)
    h1, h2, h3, h4 = draws(setting.seed, doc_id)
    if n == 0 or h3 % 100 >= setting.rate or any(m in text for m in setting.markers):
        return Cut(text, "plain", n)
    first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (int(bounds[r - 1]) if r else 0 for r in (first, last))
    prefix, middle, suffix = (str(memoryview(part), UTF32) for part in (codes[:a], codes[a:b], codes[b:]))
    m = setting.markers
    if h4 % 100 < setting.spm:
        return Cut(f"{m.suffix}{suffix}{m.prefix}{prefix}{m.middle}{middle}", "spm", n, a, b - a)
    return Cut(f"{m.prefix}{prefix}{m.suffix}{suffix}{m.middle}{middle}", "psm", n, a, b - a)


def restore(output: str, form: str, markers: Markers = Markers()) -> str:
    """The text from which `output` was made; markers are found in the output itself."""
    if form == "plain":
        return output
    first, second = (markers.suffix, markers.prefix) if form == "spm" else (markers.prefix, markers.suffix)
    if not output.startswith(first):
        raise ValueError(f"a text of form {form} begins with {first}")
    one, found, rest = output[len(first):].partition(second)
    two, last, middle = rest.partition(markers.middle)
    if not (found and last):
        raise ValueError(f"a text of form {form} has all three markers")
    return two + middle + one if form == "spm" else one + middle + two


def _mapped(docs: DataFrame, setting: Setting, row: Callable, schema: pa.Schema, ddl: str) -> DataFrame:
    """`row(id, cut)` for every document, in the columns of `schema` after doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            ids = batch.column("doc_id")
            made = [row(transform(i, t or "", setting)) for i, t in zip(ids.to_pylist(), batch.column("text").to_pylist())]
            if made:
                yield pa.RecordBatch.from_arrays(
                    [ids] + [pa.array(c, type=f.type) for c, f in zip(zip(*made), schema)], names=["doc_id", *schema.names]
                )

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(run, ddl)


def fill_in_middle(docs: DataFrame, setting: Setting = Setting()) -> DataFrame:
    """doc_id, output (the text for training), form, n (units), prefix_chars, middle_chars (null if plain)."""
    schema = pa.schema([("output", pa.string()), ("form", pa.string()), ("n", pa.int64()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64())])
    return _mapped(
        docs, setting, lambda c: (c.output, c.form, c.units, c.prefix_chars, c.middle_chars), schema,
        "doc_id long, output string, form string, n long, prefix_chars long, middle_chars long",
    )


def restored(made: DataFrame, markers: Markers = Markers()) -> DataFrame:
    """doc_id and the text rebuilt from the columns output and form."""

    def run(batches):
        for batch in pieces(batches):
            texts = [restore(o, f, markers) for o, f in zip(batch.column("output").to_pylist(), batch.column("form").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, type=pa.string())], names=["doc_id", "text"])

    return made.select("doc_id", "output", "form").mapInArrow(run, "doc_id long, text string")


def digest(docs: DataFrame, setting: Setting = Setting()) -> DataFrame:
    """What `fill_in_middle` writes and what `restored` makes of it, as lengths and digests; a text stays in the worker that cut it."""
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    schema = pa.schema([
        ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()),
        ("output_sha256", pa.string()), ("restored_sha256", pa.string()),
    ])
    return _mapped(
        docs, setting,
        lambda c: (c.units, c.form, c.prefix_chars, c.middle_chars, sha(c.output), sha(restore(c.output, c.form, setting.markers))), schema,
        "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string",
    )


def oracle(setting: Setting = Setting()) -> str:
    """DuckDB SQL of `digest` for units of lines; the restored text is the text itself."""
    p, s, m = setting.markers
    h = [f"CAST('0x' || substr(g, {8 * k + 1}, 8) AS BIGINT) AS h{k + 1}" for k in range(4)]
    return rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
  sha256('{setting.seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS g FROM documents),
h AS (SELECT *, CAST(len(u) AS BIGINT) AS n, {', '.join(h)} FROM t),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '{p}') OR contains(t, '{s}') OR contains(t, '{m}') OR h3 % 100 >= {setting.rate} THEN 'plain' WHEN h4 % 100 < {setting.spm} THEN 'spm' ELSE 'psm' END AS form FROM h),
c AS (SELECT *, coalesce(array_to_string(list_slice(u, 1, a), ''), '') AS x, coalesce(array_to_string(list_slice(u, a + 1, b), ''), '') AS y, coalesce(array_to_string(list_slice(u, b + 1, n), ''), '') AS z FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(x) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(y) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{p}' || x || '{s}' || z || '{m}' || y ELSE '{s}' || z || '{p}' || x || '{m}' || y END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM c"""
