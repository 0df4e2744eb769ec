import hashlib

import pytest
from pyspark.sql import functions as F

from netmine.functions import space, truth


def test_classes_and_relation_digest():
    assert [len(set(space.p_table(n).tolist())) for n in range(1, 5)] == [4, 12, 80, 3984]
    assert [len(space.polarity_rows(n)) for n in range(1, 5)] == [4, 12, 108, 7080]
    assert hashlib.sha256(space.polarity_csv().encode()).hexdigest() == "96f281d38afec2108e88e04ec738b3e915212376a9164d8599dbeaa01a6c0616"


@pytest.mark.parametrize(
    "bits, inputs, union, out",
    [("1010", "A B", "A B", "1010"), ("1010", "A B", "B A", "1100"), ("0001", "A B", "A B C", "00000011"), ("0001", "A B", "C A B", "00010001"), ("0110", "A B", "B C A", "01011010")],
)
def test_expand(spark, bits, inputs, union, out):
    assert spark.range(1).select(truth.expand(F.lit(bits), inputs.split(), union.split()).alias("x")).first().x == out


def test_flat_expression_agrees_with_dimension(spark):
    rows = spark.range(256).select(F.col("id").alias("value"), truth.bits_column(F.col("id"), 3).alias("tt")).join(space.p_dim(spark, 3), "value")
    assert rows.where(truth.p_canonical(F.col("tt"), 3) != truth.bits_column(F.col("p"), 3)).count() == 0


def test_joint_of_one_is_plain_and_order_does_not_matter(spark):
    rows = spark.range(256).select(truth.bits_column(F.col("id"), 3).alias("a"), truth.bits_column(F.col("id") * 37 % 256, 3).alias("b"))
    a, b = F.col("a"), F.col("b")
    bad = (truth.joint_canonical([a], 3) != truth.p_canonical(a, 3)) | (truth.joint_canonical([a, b], 3) != truth.joint_canonical([b, a], 3))
    assert rows.where(bad).count() == 0


def test_arity_reduction(spark):
    got = [r[0] for r in spark.createDataFrame([("00001111",), ("01010101",), ("00000000",), ("11111111",), ("00000011",), ("01101001",)], "b string").select(truth.reduce_arity(F.col("b"), 3)).collect()]
    assert got == ["01", "01", "0", "1", "0001", "01101001"]
