"""Canonical forms above four inputs against all permutations, masks and flips."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from netmine.functions import canonical, space


def picked(text, perm, mask=0):
    return "".join(text[r ^ mask] for r in space.permuted_rows(perm))


def drawn(rng, n, count):
    """Random functions, sparse ones, and ones whose inputs tie."""
    rows = 1 << n
    out = ["".join(rng.choice("01") for _ in range(rows)) for _ in range(count)]
    out += ["".join("1" if rng.random() < 0.1 else "0" for _ in range(rows)) for _ in range(count)]
    out += ["".join(str(a.bit_count() & 1) for a in range(rows)), "0" * (rows - 1) + "1", "1" * rows, "".join(str(a >> 1 & 1 & a) for a in range(rows))]
    majority = "".join(str(int(a.bit_count() > n // 2)) for a in range(rows))
    return [*out, majority, "".join("1" if a.bit_count() == 2 and a & 1 else "0" for a in range(rows))]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 6])
def test_least_over_all_permutations(n):
    texts = drawn(random.Random(n), n, 6)
    assert canonical.p_forms(texts, n) == [min(picked(t, p) for p in itertools.permutations(range(n))) for t in texts]


@pytest.mark.parametrize("n, flip, full", [(3, True, True), (4, False, True), (5, True, True), (5, True, False), (5, False, True)])
def test_greatest_over_permutations_masks_and_flips(n, flip, full):
    texts = drawn(random.Random(n), n, 2)
    turned = str.maketrans("01", "10")
    masks = [m for m in range(1 << n) if full or m != (1 << n) - 1]

    def greatest(text):
        forms = (picked(text, p, m) for p in itertools.permutations(range(n)) for m in masks)
        return max(max(f, f.translate(turned)) if flip else f for f in forms)

    assert canonical.greatest_forms(texts, n, flip, full) == [greatest(t) for t in texts]


def test_same_as_the_dimension_of_four_inputs():
    texts = [space.bits_of(v, 4) for v in range(0, 1 << 16, 37)]
    assert canonical.p_forms(texts, 4) == [space.bits_of(int(space.p_table(4)[int(t, 2)]), 4) for t in texts]
    assert canonical.greatest_forms(texts[:200], 4, True) == [space.bits_of(int(space.negation_table(4, True)[int(t, 2)]), 4) for t in texts[:200]]


def test_polarity_as_in_the_finite_relation():
    for n in (1, 2, 3):
        held = {}
        for r in space.polarity_rows(n):
            held.setdefault(space.bits_of(r.p, n), []).append((space.bits_of(r.np_, n), r.input_inverters, r.output_inverter, r.exact))
        assert {k: sorted(v) for k, v in held.items()} == {k: sorted(canonical.polarity_rows(k, n)) for k in held}


@pytest.mark.parametrize("n, k", [(2, 2), (3, 3), (5, 2), (5, 3)])
def test_joint_form(n, k):
    rng = random.Random(n * k)
    for texts in [[drawn(rng, n, 3)[rng.randrange(10)] for _ in range(k)] for _ in range(6)]:
        slow = min(sorted(picked(t, p) for t in texts) for p in itertools.permutations(range(n)))
        assert canonical.joint_form(texts, n) == slow


@pytest.mark.parametrize("n", [7, 8, 10])
def test_many_inputs_keep_their_class(n):
    rng = random.Random(n)
    symmetric = "".join(str(int(a.bit_count() % 3 == 1)) for a in range(1 << n))
    for text in ("".join(rng.choice("01") for _ in range(1 << n)), symmetric, "0" * ((1 << n) - 1) + "1"):
        perm = rng.sample(range(n), n)
        assert len(set(canonical.p_forms([text, picked(text, perm)], n))) == 1
    if n < 9:
        text = "".join(rng.choice("01") for _ in range(1 << n))
        assert len(set(canonical.greatest_forms([text, picked(text, rng.sample(range(n), n), 5)], n, True))) == 1


def test_table_of_mixed_lengths_nulls_and_repeats(spark):
    rows = spark.createDataFrame([("0110",), (None,), ("0110",), ("0001",), ("00000010",), ("1",), ("0" * 31 + "1",)], "tt string")
    got = {r.tt: r.p for r in canonical.classified(rows).collect()}
    assert got == {"0110": "0110", None: None, "0001": "0001", "00000010": "00000010", "1": "1", "0" * 31 + "1": "0" * 31 + "1"}
    assert canonical.classified(rows).count() == 7 and canonical.classes(rows.limit(0)).count() == 0


def test_members_table(spark):
    rows = spark.createDataFrame([(1, 3), (1, 35), (1, 0), (2, 31), (2, -1)], "g int, m long").groupBy("g").agg(canonical.members_table(F.col("m"), 5).alias("t"))
    assert {r.g: r.t for r in rows.collect()} == {1: "1001" + "0" * 28, 2: "0" * 31 + "1"}
