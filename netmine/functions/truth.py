"""Column expressions over truth-table strings.

All of them are built-in functions and stay inside code generation; the number of
inputs is known when the plan is made, so loops become flat expressions.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column
from pyspark.sql import functions as F

from netmine.functions.space import permuted_rows


def row(bits: Column, a: int) -> Column:
    return F.substring(bits, a + 1, 1)


def pick(bits: Column, rows: list[int]) -> Column:
    """The string made of these rows."""
    return F.concat(*[row(bits, a) for a in rows])


def complement(bits: Column) -> Column:
    return F.translate(bits, "01", "10")


def from_members(member: Column, n: int) -> Column:
    """Aggregate: row i is 1 if some member leaves the remainder i modulo 2**n."""
    size = 1 << n
    return F.bit_or(F.call_function("shiftleft", F.lit(1), (F.lit(size - 1) - F.pmod(member, F.lit(size))).cast("int")))


def bits_column(value: Column, n: int) -> Column:
    return F.lpad(F.bin(value.cast("long")), 1 << n, "0")


def key_column(value: Column, n: int) -> Column:
    return F.concat(F.lit("0b"), bits_column(value, n))


def p_canonical(bits: Column, n: int) -> Column:
    """Least over input permutations; for n up to 3 a flat expression, beyond that a lookup is better."""
    forms = [pick(bits, permuted_rows(p)) for p in itertools.permutations(range(n))]
    return F.least(*forms) if len(forms) > 1 else forms[0]


def joint_canonical(outputs: list[Column], n: int) -> Column:
    """One permutation for all outputs, outputs then sorted, least of the vectors joined by ;."""
    forms = [
        F.array_join(F.array_sort(F.array(*[pick(b, permuted_rows(p)) for b in outputs])), ";") for p in itertools.permutations(range(n))
    ]
    return F.least(*forms) if len(forms) > 1 else forms[0]


def expand(bits: Column, inputs: list[str], union: list[str]) -> Column:
    """The same function over a longer list of inputs."""
    n, m = len(inputs), len(union)
    place = [union.index(x) for x in inputs]
    return pick(bits, [sum((a >> (m - 1 - place[i]) & 1) << (n - 1 - i) for i in range(n)) for a in range(1 << m)])


def depends_on(bits: Column, i: int, n: int) -> Column:
    bit = 1 << (n - 1 - i)
    rows = [a for a in range(1 << n) if not a & bit]
    return pick(bits, rows) != pick(bits, [a | bit for a in rows])


def reduce_arity(bits: Column, n: int) -> Column:
    """Drop the inputs that the function does not depend on; a constant becomes one row."""
    needed = [depends_on(bits, i, n) for i in range(n)]
    out = F.when(~bits.contains("1"), "0").when(~bits.contains("0"), "1")
    for kept in itertools.chain.from_iterable(itertools.combinations(range(n), k) for k in range(1, n + 1)):
        rows = [a for a in range(1 << n) if all(i in kept or not a >> (n - 1 - i) & 1 for i in range(n))]
        test = needed[0] if 0 in kept else ~needed[0]
        for i in range(1, n):
            test = test & (needed[i] if i in kept else ~needed[i])
        out = out.when(test, pick(bits, rows))
    return out


def weight(bits: Column) -> Column:
    return F.length(F.replace(bits, F.lit("0"), F.lit(""))) / F.length(bits)


def _coefficient(bits: Column, s: int, n: int) -> Column:
    """Coefficient of the algebraic normal form: parity of the rows below s."""
    below = [a for a in range(1 << n) if a & s == a]
    return F.length(F.replace(pick(bits, below), F.lit("0"), F.lit(""))) % 2 == 1


def anf_degree(bits: Column, n: int) -> Column:
    return F.greatest(F.lit(0), *[F.when(_coefficient(bits, s, n), s.bit_count()).otherwise(0) for s in range(1, 1 << n)])


def _all(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def symmetric(bits: Column, n: int) -> Column:
    by_count: dict[int, list[int]] = {}
    for a in range(1 << n):
        by_count.setdefault(a.bit_count(), []).append(a)
    return _all([row(bits, g[0]) == row(bits, a) for g in by_count.values() for a in g[1:]])


def _covers(n: int):
    return [(a, a | 1 << i) for a in range(1 << n) for i in range(n) if not a >> i & 1]


def monotone(bits: Column, n: int) -> Column:
    return _all([row(bits, a) <= row(bits, b) for a, b in _covers(n)])


def anti_monotone(bits: Column, n: int) -> Column:
    return _all([row(bits, a) >= row(bits, b) for a, b in _covers(n)])


def negative_inputs(bits: Column, n: int) -> Column:
    """Inputs in which the function rises nowhere (one it ignores counts too)."""
    out = F.lit(0)
    for i in range(n):
        pairs = [(a, b) for a, b in _covers(n) if a ^ b == 1 << (n - 1 - i)]
        out = out + _all([row(bits, a) >= row(bits, b) for a, b in pairs]).cast("int")
    return out


def function_class(bits: Column, n: int) -> Column:
    """Name of the function's family; the first that fits."""
    size = 1 << n
    parity = "".join(str(a.bit_count() & 1) for a in range(size))
    flat = {
        "CONST0": "0" * size, "CONST1": "1" * size,
        **({"BUF": "01", "INV": "10"} if n == 1 else {
            "AND": "0" * (size - 1) + "1", "NAND": "1" * (size - 1) + "0", "OR": "0" + "1" * (size - 1), "NOR": "1" + "0" * (size - 1),
            "XOR": parity, "XNOR": parity.translate(str.maketrans("01", "10")),
        }),
        **({"MAJ": "00010111", "MAJI": "11101000"} if n == 3 else {}),
    }
    out = F
    for name, pattern in flat.items():
        out = out.when(bits == pattern, name)
    if n > 1:
        out = out.when(monotone(bits, n), "AO_OR_OA").when(anti_monotone(bits, n), "AOI_OR_OAI")
    return out.otherwise("")


def fet_cost(family: Column, n: Column) -> Column:
    """Transistors of a family with n inputs; null where there is no closed form."""
    return (
        F.when(family.isin("CONST0", "CONST1"), 0).when(family == "INV", 2).when(family == "BUF", 4)
        .when(family.isin("NAND", "NOR", "AOI_OR_OAI"), 2 * n).when(family.isin("AND", "OR", "AO_OR_OA"), 2 * n + 2)
        .when(family.isin("XOR", "XNOR"), 10 + 8 * (n - 2)).when(family == "MAJ", 12).when(family == "MAJI", 10)
    )


def output_inverters(family: Column) -> Column:
    return F.when(family == "BUF", 2).when(family.isin("AND", "OR", "AO_OR_OA", "MAJ"), 1).when(family != "", 0)


def delta_fet(base_cost: Column, base_count: Column, inverters: Column, target_cost: Column) -> Column:
    return F.greatest(F.lit(0), base_count * base_cost + 2 * inverters - target_cost)


def hex_key(bits: Column, n: int) -> Column:
    """<rows>#0x<HEX>, upper case, zero-padded."""
    digits = max(1, (1 << n) // 4)
    return F.concat(F.lit(f"{1 << n}#0x"), F.lpad(F.upper(F.conv(bits, 2, 16)), digits, "0"))


def cell_name(bits: Column, n: int, drive: str = "X1") -> Column:
    return F.concat(F.lit(f"{n}input0x"), F.lower(F.conv(bits, 2, 16)), F.lit(f"_{drive}"))


def minterms(bits: Column, n: int) -> Column:
    """Sum of minterms, A1 the first input; constants are 0 and 1."""
    terms = [
        F.when(row(bits, a) == "1", "*".join(("" if a >> (n - 1 - i) & 1 else "!") + f"A{i + 1}" for i in range(n))) for a in range(1 << n)
    ]
    return F.when(~bits.contains("1"), "0").when(~bits.contains("0"), "1").otherwise(F.concat_ws(" + ", *terms))


def projection(bits: Column, n: int) -> Column:
    """Whether the function is one of its inputs."""
    return bits.isin(["".join(str(a >> (n - 1 - i) & 1) for a in range(1 << n)) for i in range(n)])
