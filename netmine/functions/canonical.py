"""Canonical forms of the functions that a table holds, for any number of inputs.

The finite dimensions of `space` end at four inputs.  Beyond that only the distinct
functions met are classified: Spark makes them distinct, deals them out and joins
the classes back, and a batch of them is refined together in arrays of words.

A least form over all permutations is found place by place.  The first 2**k rows
depend on which k inputs come last, so at each place every input not yet placed is
tried, the tables with the least new half survive, and tables that have become equal
are one.  Inputs that a function does not tell apart give equal tables at once, so
only inputs that tie and still differ are permuted further.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of tables that one batch may hold while it is refined.
BATCH_BYTES = 1 << 26


def _words(tables: np.ndarray) -> np.ndarray:
    """Rows of bits as big-endian words, whose order is that of the strings."""
    packed = np.packbits(tables, axis=1)
    wide = np.zeros((len(packed), -(-packed.shape[1] // 8) * 8), dtype=np.uint8)
    wide[:, : packed.shape[1]] = packed
    return wide.view(">u8").astype(np.uint64)


def _sorted(owner: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.lexsort((*words.T[::-1], owner))


def _least(owner: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Which rows equal the least one of their owner."""
    order = _sorted(owner, words)
    first = order[np.append(True, owner[order][1:] != owner[order][:-1])]
    return (words == words[first][np.searchsorted(owner[first], owner)]).all(axis=1)


def _distinct(owner: np.ndarray, tables: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words = _words(tables)
    order = _sorted(owner, words)
    o, w = owner[order], words[order]
    keep = order[np.append(True, (o[1:] != o[:-1]) | (w[1:] != w[:-1]).any(axis=1))]
    return owner[keep], tables[keep]


def least_forms(owner: np.ndarray, tables: np.ndarray, n: int, outputs: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """For each owner (0, 1, ...) all distinct permuted tables whose first output's function is least; with one output there is one.

    A row of `tables` holds `outputs` functions of 2**n rows, one after another; the same permutation applies to all.
    """
    size = 1 << n
    keep = _least(owner, tables[:, :1].astype(np.uint64))
    owner, tables = _distinct(owner[keep], tables[keep])
    for placed in range(n):
        shaped = tables.reshape(len(tables), outputs, *[2] * n)
        last = n - 1 - placed  # axes above it hold inputs without a place, in their order
        tried = [np.ascontiguousarray(np.moveaxis(shaped, 2 + j, 2 + last)).reshape(len(tables), outputs * size) for j in range(last + 1)]
        tables, owner = np.concatenate(tried), np.tile(owner, last + 1)
        keep = _least(owner, _words(tables[:, 1 << placed : 2 << placed]))
        owner, tables = _distinct(owner[keep], tables[keep])
    return owner, tables


def _as_tables(texts: list[str], n: int) -> np.ndarray:
    return (np.frombuffer("".join(texts).encode(), dtype=np.uint8) - ord("0")).reshape(len(texts), 1 << n)


def _as_texts(tables: np.ndarray) -> list[str]:
    width = tables.shape[1]
    text = (tables + ord("0")).astype(np.uint8).tobytes().decode()
    return [text[i : i + width] for i in range(0, len(text), width)]


def _in_parts(texts: list[str], n: int, forms: int, run: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    step = max(1, BATCH_BYTES // (forms * max(n, 1) << n))
    tables = _as_tables(texts, n)
    return np.concatenate([run(tables[k : k + step]) for k in range(0, len(tables), step)])


def p_forms(texts: list[str], n: int) -> list[str]:
    """The least string over input permutations."""
    return _as_texts(_in_parts(texts, n, 1, lambda t: least_forms(np.arange(len(t)), t, n)[1]))


def negated(tables: np.ndarray, n: int, masks: list[int], flips: list[int]) -> np.ndarray:
    """Every table under every pair of input mask and output flip, tables changing slowest."""
    rows = np.arange(1 << n)
    picked = tables[:, np.stack([rows ^ m for m in masks])]
    return np.stack([picked ^ f for f in flips], axis=2).reshape(-1, 1 << n)


def greatest_forms(texts: list[str], n: int, flip_output: bool, full_mask: bool = True) -> list[str]:
    """The greatest string over permutations, input masks and, if asked, output negation; without `full_mask` not all inputs are negated at once."""
    masks = [m for m in range(1 << n) if full_mask or not n or m != (1 << n) - 1]
    flips = [0, 1] if flip_output else [0]

    def run(tables):
        forms = 1 - negated(tables, n, masks, flips)  # the greatest is the complement of the complements' least
        return 1 - least_forms(np.repeat(np.arange(len(tables)), len(masks) * len(flips)), forms, n)[1]

    return _as_texts(_in_parts(texts, n, len(masks) * len(flips), run))


def joint_form(texts: list[str], n: int) -> list[str]:
    """One permutation for all functions, the results then sorted: the least such vector."""
    tables = _as_tables(texts, n)
    leads = [np.concatenate([tables[i : i + 1], np.delete(tables, i, axis=0)]).reshape(1, -1) for i in range(len(texts))]
    _, forms = least_forms(np.zeros(len(leads), dtype=np.int64), np.concatenate(leads), n, len(texts))
    return min(sorted(_as_texts(f.reshape(len(texts), 1 << n))) for f in forms)


def polarity_rows(text: str, n: int) -> list[tuple[str, int, int, bool]]:
    """Representatives of a P-canonical function with the fewest erased inverters: form, inverters at inputs, at the output, exact.

    The rule is that of `space.polarity_rows`, for one function of any number of inputs.
    """
    masks = list(range(1 << n))
    forms = np.concatenate([negated(_as_tables([text], n), n, masks, [f]) for f in (0, 1)])
    _, canon = least_forms(np.arange(len(forms)), forms, n)
    cost = [(m.bit_count(), f) for f in (0, 1) for m in masks]
    shaped = (1 - canon).reshape(len(canon), *[2] * n)
    unate = np.ones(len(canon), dtype=bool)
    for axis in range(1, n + 1):
        low, high = np.split(shaped, 2, axis=axis)
        unate &= (low <= high).reshape(len(canon), -1).all(axis=1)
    allowed = np.flatnonzero(unate if unate.any() else canon[:, 0] == 1)
    least = min((sum(cost[i]) for i in allowed), default=0)
    # masks ascending, plain output before the negated one: the last one tried decides the split
    tried = sorted((i for i in allowed if sum(cost[i]) == least), key=lambda i: (i % len(masks), i // len(masks)))
    split = {t: cost[i] for i, t in zip(tried, _as_texts(canon[tried]))} if tried else {}
    return [(t, a, o, bool(unate.any())) for t, (a, o) in sorted(split.items())]


KINDS: dict[str, Callable[[list[str], int], list[str]]] = {
    "p": p_forms,
    "npn": lambda t, n: greatest_forms(t, n, True),
    "np": lambda t, n: greatest_forms(t, n, False),
    "npn_no_full": lambda t, n: greatest_forms(t, n, True, full_mask=False),
}


def _by_inputs(texts: list[str]) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for i, t in enumerate(texts):
        out.setdefault(len(t).bit_length() - 1, []).append(i)
    return out


def classes(functions: DataFrame, tt: str = "tt", kinds: tuple[str, ...] = ("p",)) -> DataFrame:
    """`tt` and its canonical strings, one row for each distinct truth table of the column (lengths may differ; null gives no row)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            made = {k: [""] * len(texts) for k in kinds}
            for n, places in _by_inputs(texts).items():
                for kind in kinds:
                    for i, form in zip(places, KINDS[kind]([texts[i] for i in places], n)):
                        made[kind][i] = form
            yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array(made[k], pa.string()) for k in kinds], names=[tt, *kinds])

    met = functions.where(F.col(tt).isNotNull()).select(F.col(tt).cast("string").alias(tt)).distinct()
    return met.mapInArrow(run, ", ".join(f"`{c}` string" for c in (tt, *kinds)))


def classified(rows: DataFrame, tt: str = "tt", kinds: tuple[str, ...] = ("p",)) -> DataFrame:
    """The rows with the canonical strings of their truth table."""
    return rows.join(classes(rows, tt, kinds), tt, "left")


def polarity(keys: DataFrame, p_key: str = "p_key") -> DataFrame:
    """p_key, np_key ('0b' strings), ei, eo, exact for every distinct key of the column."""

    def run(batches):
        for batch in batches:
            found = [(k, f"0b{t}", a, o, e) for k in batch.column(0).to_pylist() for t, a, o, e in polarity_rows(k[2:], (len(k) - 2).bit_length() - 1)]
            if found:
                names = ["p_key", "np_key", "ei", "eo", "exact"]
                types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names=names)

    met = keys.where(F.col(p_key).isNotNull()).select(F.col(p_key).alias("p_key")).distinct()
    return met.mapInArrow(run, "p_key string, np_key string, ei int, eo int, exact boolean")


def joint_classes(vectors: DataFrame, outputs: str = "outputs") -> DataFrame:
    """The array of truth tables (of one length) and its joint canonical form joined by ;, one row for each distinct array."""

    def run(batches):
        for batch in batches:
            forms = [";".join(joint_form(v, len(v[0]).bit_length() - 1)) for v in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(forms, pa.string())], names=[outputs, "joint"])

    met = vectors.where(F.size(outputs) > 0).select(outputs).distinct()
    return met.mapInArrow(run, f"`{outputs}` array<string>, joint string")


def members_table(member: Column, n: int) -> Column:
    """Aggregate: the truth table whose row i is 1 if some member leaves the remainder i modulo 2**n, for up to any number of inputs."""
    held = F.collect_set(F.pmod(member, F.lit(1 << n)))  # at most 2**n values
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit((1 << n) - 1)), lambda i: F.array_contains(held, i.cast("long")).cast("int").cast("string")), "")
