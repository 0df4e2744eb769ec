"""Names, numbers and keys as column expressions of built-in functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def format_count(value: Column) -> Column:
    """Whole if within 1e-9 of a whole number, else six decimals without trailing zeros."""
    whole = F.abs(value - F.round(value)) < 1e-9
    return F.when(whole, F.round(value).cast("long").cast("string")).otherwise(F.regexp_replace(F.regexp_replace(F.format_string("%.6f", value.cast("double")), "0+$", ""), r"\.$", ""))


def family(name: Column) -> Column:
    """What stands before the first x, else before the first _, else the whole name."""
    return F.when(name.contains("x"), F.split_part(name, F.lit("x"), F.lit(1))).when(name.contains("_"), F.split_part(name, F.lit("_"), F.lit(1))).otherwise(name)


def plain_name(name: Column) -> Column:
    """Trimmed, without one leading backslash."""
    return F.regexp_replace(F.trim(name), r"^\\", "")


def component(name: Column) -> Column:
    """Other than ASCII letters, digits and _ become _."""
    return F.regexp_replace(name, "[^A-Za-z0-9_]", "_")


def glob_regex(pattern: Column) -> Column:
    """A glob as a regular expression of the whole string: * and ? stand for any characters, [..] for one of a set, [!..] for none of it."""
    quoted = F.regexp_replace(pattern, r"([\\.^$|()+{}])", r"\\$1")
    sets = F.regexp_replace(quoted, r"\[!", "[^")
    return F.concat(F.lit("(?s)^"), F.regexp_replace(F.regexp_replace(sets, r"\*", ".*"), r"\?", "."), F.lit("$"))


def glob_match(name: Column, pattern: Column | str) -> Column:
    return F.regexp_like(name, glob_regex(F.lit(pattern) if isinstance(pattern, str) else pattern))


def csv_quote(value: Column) -> Column:
    """A CSV field, quoted where it holds a comma, a quote or a line end."""
    return F.when(value.rlike('[,"\n\r]'), F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(value)


def csv_row(*fields: Column) -> Column:
    return F.concat_ws(",", *[csv_quote(F.coalesce(f.cast("string"), F.lit(""))) for f in fields])


def split_fields(line: Column, most: int) -> Column:
    """At most so many comma-separated fields; the last one keeps the rest of the line."""
    return F.split(line, ",", most)


def signature_parts(signature: Column) -> Column:
    """Parts of a signature between semicolons, trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(signature, ";"), lambda x: F.trim(x)), lambda x: x != "")


def joined_key(parts: Column) -> Column:
    """Sorted parts joined by semicolons."""
    return F.array_join(F.array_sort(parts), ";")


def tie_key(cell_family: Column) -> Column:
    """Keys of the constant cells, by family."""
    upper = F.upper(cell_family)
    return F.when(upper.contains("TIEHI"), "1#0x1").when(upper.contains("TIELO"), "1#0x0")


def drive(name: Column, missing: int | None = None) -> Column:
    """The number after _X that ends a name or stands before _."""
    found = F.regexp_extract(name, r"_X(\d+)(?:_|$)", 1)
    return F.when(found != "", found.cast("int")).otherwise(F.lit(missing).cast("int"))


def with_drive(name: Column, to: int) -> Column:
    """The same cell with another drive."""
    return F.regexp_replace(name, r"_X\d+(_|$)", rf"_X{to}$1")


def drive_scale(name: Column) -> Column:
    """Drives 1, 2, 4 and 8 as a factor; null for others."""
    d = drive(name)
    return F.when(d.isin(1, 2, 4, 8), d.cast("double"))


def is_logic(name: Column, cell_class: Column | None = None) -> Column:
    """Whether a cell is logic: by its class where it has one, else by the name of buffers, inverters and storage."""
    u = F.upper(name)
    by_name = ~(u.startswith("BUF") | u.startswith("INV") | u.contains("DFF") | u.contains("LATCH") | u.startswith("LHQ") | u.startswith("LHL") | u.startswith("LSQ"))
    return by_name if cell_class is None else F.when(cell_class.isNotNull(), cell_class == "logic").otherwise(by_name)


def is_inverter(function: Column, pin: Column) -> Column:
    """`!A` or `A'` of the only input, whatever the blanks."""
    text = F.regexp_replace(function, r"\s+", "")
    return (text == F.concat(F.lit("!"), pin)) | (text == F.concat(pin, F.lit("'")))


def is_buffer(function: Column, pin: Column) -> Column:
    """The only input itself."""
    return F.regexp_replace(function, r"\s+", "") == pin


def seeded_choice(keys: Column, options: Column) -> Column:
    """One of the options, the same for the same set of keys: the first 15 hex digits of the digest of the sorted keys, modulo their number."""
    digest = F.md5(F.encode(F.array_join(F.array_sort(keys), ","), "utf-8"))
    place = F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.size(options).cast("long"))
    return F.element_at(options, (place + 1).cast("int"))


def run_parts(name: Column) -> list[Column]:
    """area, freq and rep of a run name `<area>_<freq>_<rep>`; null where it has another form."""
    form = r"^([0-9.]+)_([0-9.]+)_([0-9]+)$"
    part = lambda i, kind: F.when(name.rlike(form), F.regexp_extract(name, form, i).cast(kind))
    return [part(1, "double").alias("area"), part(2, "double").alias("freq"), part(3, "int").alias("rep")]


def period(freq_mhz: Column) -> Column:
    """Clock period in nanoseconds."""
    return 1000 / freq_mhz


def jaccard(a: Column, b: Column) -> Column:
    """Size of the intersection over that of the union, 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def like_pattern(glob: str) -> re.Pattern:
    """The same reading of a glob outside of Spark, for tests and plans."""
    out = "".join(".*" if c == "*" else "." if c == "?" else c if c in "[]-" else re.escape(c) for c in glob.replace("[!", "[^"))
    return re.compile(out, re.S)
