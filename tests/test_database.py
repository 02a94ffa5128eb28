"""The database sink on the embedded database that comes with Spark."""

import datetime as dt
import decimal

import pytest

from sluice.sources import tables
from sluice.sources.database import DatabaseTable, into_database, jdbc_url

DDL = "id long, url string, score double, open boolean, day date, at timestamp, money decimal(18,2)"


def row(i, url="u", score=1.5):
    return (i, f"{url}{i}", score, i % 2 == 0, dt.date(2024, 1, 1 + i % 28), dt.datetime(2024, 1, 1, i % 24), decimal.Decimal(i) / 4)


@pytest.fixture(scope="module")
def database(spark, tmp_path_factory):
    return f"jdbc:derby:{tmp_path_factory.mktemp('db')}/d;create=true"


def test_round_trip_and_repeats(spark, database):
    table = DatabaseTable(spark, database, "OPPS", "id")
    first = spark.createDataFrame([row(i) for i in range(100)], DDL)
    table.create(first.schema)
    table.create(first.schema)
    assert table.read().count() == 0 and table.merge(first, "s", 0) and table.last_batch("s") == 0
    got = table.read(4)
    assert got.rdd.getNumPartitions() == 4 and sorted(map(tuple, got.collect())) == [row(i) for i in range(100)]
    assert not table.merge(spark.createDataFrame([row(5, "again")], DDL), "s", 0)
    second = spark.createDataFrame([row(5, "new"), row(200), (None, "no key", None, None, None, None, None)], DDL)
    assert table.merge(second, "s", 1) and not table.merge(second, "s", 1) and table.merge(second, "other", 0)
    rows = {r.id: r.url for r in table.read().collect()}
    assert len(rows) == 101 and rows[5] == "new5" and rows[200] == "u200" and rows[6] == "u6"
    ranges = tables.read_jdbc(spark, database, '"OPPS"', '"id"', 0, 200, 3)
    assert ranges.count() == 101 and ranges.rdd.getNumPartitions() == 3


def test_a_batch_that_died_is_repeated_whole(spark, database, monkeypatch):
    table = DatabaseTable(spark, database, "TEXTS", "url", key_chars=50)
    rows = spark.createDataFrame([(f"k{i}", i) for i in range(20)], "url string, n int")
    table.create(rows.schema)
    run = DatabaseTable._run

    def dies(connection, sql, *values):
        if "INTO SLUICE_MARKS" in sql or "UPDATE SLUICE_MARKS" in sql:
            raise RuntimeError("lost")
        return run(connection, sql, *values)

    monkeypatch.setattr(DatabaseTable, "_run", staticmethod(dies))
    with pytest.raises(RuntimeError):
        table.merge(rows, "t", 0)
    monkeypatch.undo()
    assert table.read().count() == 0 and table.last_batch("t") == -1
    into_database(table, "t")(rows, 0)
    into_database(table, "t")(rows.withColumn("n", rows.n + 1), 0)
    assert sorted((r.url, r.n) for r in table.read().collect()) == sorted((f"k{i}", i) for i in range(20))


def test_urls():
    assert jdbc_url("postgres://h/d") == jdbc_url("postgresql://h/d") == "jdbc:postgresql://h/d" and jdbc_url("jdbc:derby:x") == "jdbc:derby:x"
