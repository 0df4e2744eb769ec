"""Boolean expressions to truth tables.

Operators by binding: NOT (`!` and `~` before, `'` after a name or a closing
bracket), AND (`&`, `&&`, `*`), XOR (`^`), OR (`|`, `||`, `+`); constants 0, 1, TRUE,
FALSE.  Names are letters, digits, `_`, `/` and `$`; one that is not among the inputs
reads false.  Anything else raises.  A table of 2**n rows is one integer, its first
row the highest bit, so an operator is one integer operation for all rows.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAME = r"[A-Za-z0-9_/$]+"
_TOKEN = re.compile(rf"\s*(?:({NAME})|(&&?|\|\|?|[*+^!~()']))")
_LEVEL = {"|": 1, "^": 2, "&": 3, "!": 4}
_SAME = {"&&": "&", "*": "&", "||": "|", "+": "|", "~": "!"}


def input_pattern(i: int, n: int) -> int:
    """The table of input i among n, the first input the most significant."""
    size = 1 << n
    return sum(1 << (size - 1 - a) for a in range(size) if a >> (n - 1 - i) & 1)


def tokens(text: str) -> list[str]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if m is None:
            raise ValueError(f"unknown character in {text!r} at {at}")
        out.append(m[1] or _SAME.get(m[2], m[2]))
        at = m.end()
    return out


@functools.lru_cache(maxsize=1 << 16)
def table(text: str, inputs: tuple[str, ...]) -> int:
    """Operands and waiting operators on two stacks."""
    n = len(inputs)
    ones = (1 << (1 << n)) - 1
    value = {name: input_pattern(i, n) for i, name in enumerate(inputs)}
    operands: list[int] = []
    waiting: list[str] = []

    def apply():
        op = waiting.pop()
        b = operands.pop()
        operands.append(ones ^ b if op == "!" else operands.pop() & b if op == "&" else operands.pop() ^ b if op == "^" else operands.pop() | b)

    after_operand = False
    for t in tokens(text):
        if t == "'":
            if not after_operand:
                raise ValueError(f"misplaced ' in {text!r}")
            operands.append(ones ^ operands.pop())
        elif t in ("!", "("):
            if after_operand:
                raise ValueError(f"operator missing in {text!r}")
            waiting.append(t)
        elif t == ")":
            while after_operand and waiting and waiting[-1] != "(":
                apply()
            if not after_operand or not waiting:
                raise ValueError(f"unbalanced ) in {text!r}")
            waiting.pop()
        elif t in _LEVEL:
            if not after_operand:
                raise ValueError(f"operand missing in {text!r}")
            while waiting and waiting[-1] != "(" and _LEVEL[waiting[-1]] >= _LEVEL[t]:
                apply()
            waiting.append(t)
            after_operand = False
        else:
            if after_operand:
                raise ValueError(f"operator missing in {text!r}")
            operands.append(value[t] if t in value else ones if t == "1" or t.upper() == "TRUE" else 0)
            after_operand = True
    while after_operand and waiting and waiting[-1] != "(":
        apply()
    if waiting or len(operands) != 1:
        raise ValueError(f"incomplete expression {text!r}")
    return operands[0]


def bits(text: str, inputs: tuple[str, ...]) -> str:
    return format(table(text, inputs), f"0{1 << len(inputs)}b")


def variables(expression: Column) -> Column:
    """The names that an expression uses, sorted, without constants."""
    found = F.regexp_extract_all(expression, F.lit(r"([A-Za-z_/$][A-Za-z0-9_/$]*)"), F.lit(1))
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: ~F.upper(x).isin("TRUE", "FALSE"))))


def truth_table(expression: Column, inputs: Column | None = None, least_first: bool = False) -> Column:
    """Bits of an expression over `inputs`, by default its own names sorted; least_first: the first input is the least significant."""
    @F.pandas_udf("string")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for text, names in parts:
            yield pd.Series([None if t is None else bits(t, tuple(n)) for t, n in zip(text, names)], dtype=object)

    names = variables(expression) if inputs is None else inputs
    return run(expression, F.reverse(names) if least_first else names)


def tabulated(rows: DataFrame, expression: str, inputs: str | None = None, into: str = "tt", least_first: bool = False) -> DataFrame:
    """The rows with the truth table of a column of expressions, null where that is.

    Every distinct expression, with its inputs, is parsed once, whatever the number of rows that have it.
    """
    keys = ["__expression", "__inputs"]
    named = rows.withColumn(keys[0], F.col(expression)).withColumn(keys[1], variables(F.col(expression)) if inputs is None else F.col(inputs))
    met = named.where(F.col(keys[0]).isNotNull() & F.col(keys[1]).isNotNull()).select(*keys).distinct()
    return named.join(met.select(*keys, truth_table(F.col(keys[0]), F.col(keys[1]), least_first).alias(into)), keys, "left").drop(*keys)


def hex_of(bits_column: Column) -> Column:
    """<rows>#0x<HEX> of bits of any length."""
    width = F.greatest(F.lit(1), F.ceil(F.length(bits_column) / 4)).cast("int")
    padded = F.lpad(bits_column, 4 * width, "0")
    digits = F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.conv(F.substring(padded, 4 * i + 1, F.lit(4)), 2, 16))
    return F.concat(F.length(bits_column).cast("string"), F.lit("#0x"), F.upper(F.array_join(digits, "")))


def key(expression: Column, inputs: Column | None = None) -> Column:
    """The key of an expression; a constant over no inputs has one row."""
    return hex_of(truth_table(expression, inputs))


def key_bits(hex_key: Column) -> Column:
    """Bits of a key <rows>#0x<HEX> (surrounding blanks and leading zeros allowed); anything else raises."""
    text = F.trim(hex_key)
    rows, digits = F.trim(F.split_part(text, F.lit("#"), F.lit(1))), F.regexp_extract(F.trim(F.split_part(text, F.lit("#"), F.lit(2))), r"^0[xX]([0-9A-Fa-f]+)$", 1)
    good = rows.rlike("^[1-9][0-9]*$") & (digits != "")
    letters = F.filter(F.split(digits, ""), lambda x: x != "")
    spelt = F.array_join(F.transform(letters, lambda x: F.lpad(F.conv(x, 16, 2), 4, "0")), "")
    n = F.try_to_number(rows, F.lit("999999999")).cast("int")
    plain = F.regexp_replace(spelt, "^0+", "")
    fits = good & (F.length(plain) <= n)
    return F.when(text.isNull(), None).when(F.coalesce(fits, F.lit(False)), F.lpad(plain, n, "0")).otherwise(
        F.raise_error(F.concat(F.lit("no key: "), text)).cast("string")
    )


def normal_key(hex_key: Column) -> Column:
    """A key in upper case with all its digits; malformed ones raise."""
    return hex_of(key_bits(hex_key))


def inputs_of_key(hex_key: Column) -> Column:
    """Number of inputs, null if the number of rows is no power of two."""
    n = F.length(key_bits(hex_key))
    return F.when(F.bit_count(n.cast("long")) == 1, F.round(F.log2(n.cast("double"))).cast("int"))


# ---------------------------------------------------------------- two-level minimisation


def prime_implicants(ones: set[int], n: int) -> list[tuple[int, int]]:
    """(mask of cared-for bits, value) of all primes: implicants that no merge of two covers."""
    level, primes = {((1 << n) - 1, a) for a in ones}, set()
    while level:
        merged, used = set(), set()
        for mask, value in level:
            for b in range(n):
                bit = 1 << b
                if mask & bit and not value & bit and (mask, value | bit) in level:
                    merged.add((mask ^ bit, value))
                    used |= {(mask, value), (mask, value | bit)}
        primes |= level - used
        level = merged
    return sorted(primes, key=lambda p: (p[0].bit_count(), p))


def minimal_sum(bits_: str, names: list[str]) -> str:
    """A sum of products: essential primes, then the prime that covers most of the rest, ties by fewest literals and order."""
    n = len(names)
    ones = {a for a, b in enumerate(bits_) if b == "1"}
    if not ones:
        return "0"
    if len(ones) == len(bits_):
        return "1"
    primes = prime_implicants(ones, n)
    covers = {p: {a for a in ones if a & p[0] == p[1]} for p in primes}
    chosen: list[tuple[int, int]] = []
    for a in sorted(ones):
        over = [p for p in primes if a in covers[p]]
        if len(over) == 1 and over[0] not in chosen:
            chosen.append(over[0])
    left = ones - set().union(*(covers[p] for p in chosen), set())
    while left:
        best = max(primes, key=lambda p: len(covers[p] & left))
        chosen.append(best)
        left -= covers[best]
    term = lambda p: "*".join(("" if p[1] >> (n - 1 - i) & 1 else "!") + x for i, x in enumerate(names) if p[0] >> (n - 1 - i) & 1)
    return " + ".join(map(term, sorted(chosen, key=lambda p: (-p[1], p[0]))))


def minimise(bits_column: Column, names: Column) -> Column:
    """Minimised sum of products of a truth table over named inputs."""
    @F.pandas_udf("string")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for tables, inputs in parts:
            yield pd.Series([None if t is None else minimal_sum(t, list(x)) for t, x in zip(tables, inputs)], dtype=object)

    return run(bits_column, names)
