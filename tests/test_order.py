"""Positions in an order over skewed groups."""

import random

from pyspark.sql import functions as F

from carrierlab.functions.order import numbered_lines, row_numbers
from tests.conftest import collect


def test_row_numbers_of_a_large_and_a_null_group(spark):
    rng = random.Random(3)
    rows = [("big", rng.randrange(1000), i) for i in range(3000)] + [(None, None if i % 2 else i, i) for i in range(40)] + [("one", 5, 1)]
    frame = spark.createDataFrame(rows, "g string, v int, i int").repartition(7)
    got = row_numbers(frame, ["g"], [F.desc_nulls_last("v"), "i"])
    assert got.columns == ["g", "v", "i", "position"]
    by = {}
    for g, v, i in rows:
        by.setdefault(g, []).append((v is None, -(v or 0), i, v))
    want = {(g, v, i): k + 1 for g, x in by.items() for k, (_, _, i, v) in enumerate(sorted(x))}
    assert {(r.g, r.v, r.i): r.position for r in got.collect()} == want
    assert row_numbers(frame.limit(0), ["g"], ["v"]).count() == 0


def test_numbered_lines_over_files(spark, tmp_path):
    spark.range(5000).select(F.format_string("%05d", "id").alias("v")).repartitionByRange(6, "v").sortWithinPartitions(
        "v").write.text(str(tmp_path / "t"))
    got = collect(numbered_lines(spark, str(tmp_path / "t")).select("line", "value"), "line")
    assert got == [(k + 1, f"{k:05d}") for k in range(5000)]
