"""What queries write on their way is gone afterwards."""

import os

import pytest
from pyspark.sql import functions as F

from netmine import session
from netmine.operators.order import numbered


def folders(spark):
    return {n for n in os.listdir(session.shared_folder(spark).removeprefix("file:")) if n.startswith("saved-")}


def test_a_scope_deletes_what_it_wrote(spark):
    session.saved(spark.range(3))
    before = folders(spark)
    with session.scratch(spark):
        rows = numbered(spark.range(10), [F.col("id").desc()])
        kept = session.saved(rows)
        with session.scratch(spark):
            session.saved(kept)
            assert len(folders(spark) - before) == 3
        assert len(folders(spark) - before) == 2 and rows.count() == 10
    assert folders(spark) == before
    with pytest.raises(ValueError), session.scratch(spark):
        session.saved(spark.range(1))
        raise ValueError
    assert folders(spark) == before


def test_everything_else_goes_with_the_driver(tmp_path):
    import subprocess
    import sys

    code = f"""
from pyspark.sql import SparkSession
from netmine.session import saved
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "{tmp_path}").getOrCreate()
saved(spark.range(3))
import os
assert any(n.startswith("saved-") for n in os.listdir("{tmp_path}"))
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    assert subprocess.run([sys.executable, "-c", code], cwd=root, timeout=120).returncode == 0
    assert not [n for n in os.listdir(tmp_path) if n.startswith("saved-")]
