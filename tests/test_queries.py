import datetime

import pytest

from quarry.plans import catalogue
from quarry.sources import listing
from tests.oracle import DATA, same

SQL = catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    same(spark, catalogue.queries()[name], SQL[name])


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_overlay_takes_the_first_of_equally_young_pages(spark, tmp_path):
    """As DuckDB does with the rows of one file."""
    seen = datetime.datetime(1997, 12, 30)
    lines = [(o, p + o, 1, seen) for o in range(40) for p in (0, 1, 2, 3)]
    tables = {"lineitem": (lines, "l_orderkey long, l_partkey long, l_linenumber int, l_shipdate timestamp_ntz"), "orders": ([(o, "F") for o in range(40)], "o_orderkey long, o_orderstatus string")}
    for name, (rows, kind) in tables.items():
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    same(spark, catalogue.queries()["detail_overlay"], SQL["detail_overlay"], str(tmp_path))


def test_overlay_of_pages_with_missing_numbers(spark, tmp_path):
    """Of two pages the younger says nothing, or has no line number, or both have none."""
    day = lambda d: datetime.datetime(1997, 12, d)
    lines = [(1, 0, 1, day(28)), (1, None, 2, day(29)), (2, 1, 7, day(30)), (2, 2, None, day(30)), (3, 3, None, day(30)), (3, 0, None, day(31)), (4, None, None, day(30)), (5, 2, 1, None), (None, 1, 1, day(30))]
    tables = {"lineitem": (lines, "l_orderkey long, l_partkey long, l_linenumber int, l_shipdate timestamp_ntz"), "orders": ([(o, "F") for o in (1, 2, 3, 4, 5, None)], "o_orderkey long, o_orderstatus string")}
    for name, (rows, kind) in tables.items():
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    same(spark, catalogue.queries()["detail_overlay"], SQL["detail_overlay"], str(tmp_path))


def test_lists_are_placed_in_partitions_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(listing, "PART_ROWS", 500)
    scores = catalogue.queries()["result_scores"](spark, DATA)
    assert scores.rdd.getNumPartitions() == 12  # of 6000 rows
    same(spark, catalogue.queries()["result_scores"], SQL["result_scores"])
