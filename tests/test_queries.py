"""Every registered query of the library against its SQL, over the same small tables."""

import pytest

from conftest import rows_of
from corpusloom.plans import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows(name, spark, small, sql):
    got, want = queries.QUERIES[name](spark, small).toPandas(), sql.execute(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)
    assert len(got) or name == "roman_numerals"


def test_replicates_do_not_depend_on_partitions(spark, small):
    first = rows_of(queries.QUERIES["stability_replicates"](spark, small).toPandas())
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert rows_of(queries.QUERIES["stability_replicates"](spark, small).toPandas()) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["group", "item", "count"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
