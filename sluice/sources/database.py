"""A database as sink: staged rows, then one keyed merge in a transaction.

Executors write a batch into a staging table of its own; the database folds that into the
target by key in one statement.  A marks table says which batch of which stream is in, within the
same transaction, so a batch that is repeated, in part or whole, changes nothing.
"""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARKS = "SLUICE_MARKS"
#: Column types by Spark type; texts that are keys need a length.
_KINDS = {
    T.StringType: "VARCHAR(32000)", T.LongType: "BIGINT", T.IntegerType: "INTEGER", T.DoubleType: "DOUBLE PRECISION", T.BooleanType: "BOOLEAN", T.DateType: "DATE",
    T.TimestampType: "TIMESTAMP",
}


def jdbc_url(url: str) -> str:
    """A JDBC URL; those of the database's own form are translated."""
    if url.startswith(("postgres://", "postgresql://")):
        return "jdbc:postgresql://" + url.split("://", 1)[1]
    return url


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def column_types(schema: T.StructType, key_chars: int, keys: tuple[str, ...]) -> dict[str, str]:
    """Database types of the columns; decimals keep their precision."""
    out = {}
    for f in schema:
        kind = f"DECIMAL({f.dataType.precision}, {f.dataType.scale})" if isinstance(f.dataType, T.DecimalType) else _KINDS[type(f.dataType)]
        out[f.name] = f"VARCHAR({key_chars})" if f.name in keys and isinstance(f.dataType, T.StringType) else kind
    return out


class DatabaseTable:
    """A keyed table of a JDBC database."""

    def __init__(self, spark: SparkSession, url: str, table: str, key: str, properties: dict[str, str] | None = None, key_chars: int = 2_000):
        self.spark, self.url, self.table, self.key = spark, jdbc_url(url), table, key
        self.properties, self.key_chars = dict(properties or {}), key_chars

    @contextlib.contextmanager
    def _session(self):
        """A connection whose work is one transaction; an error takes all of it back."""
        jvm = self.spark.sparkContext._jvm
        given = jvm.java.util.Properties()
        for k, v in self.properties.items():
            given.setProperty(k, v)
        if driver := self.properties.get("driver"):
            jvm.java.lang.Class.forName(driver)
        connection = jvm.java.sql.DriverManager.getConnection(self.url, given)
        try:
            connection.setAutoCommit(False)
            yield connection
            connection.commit()
        except BaseException:
            connection.rollback()
            raise
        finally:
            connection.close()

    @staticmethod
    def _run(connection, sql: str, *values) -> int:
        statement = connection.prepareStatement(sql)
        try:
            for i, value in enumerate(values, 1):
                statement.setObject(i, value)
            return statement.executeUpdate()
        finally:
            statement.close()

    def _exists(self, connection, table: str) -> bool:
        found = connection.getMetaData().getTables(None, None, table, None)
        try:
            return found.next()
        finally:
            found.close()

    def create(self, schema: T.StructType) -> None:
        """The table, with its key unique, and the marks' table, unless they are there."""
        kinds = column_types(schema, self.key_chars, (self.key,))
        columns = ", ".join(f"{quoted(c)} {k}{' NOT NULL PRIMARY KEY' if c == self.key else ''}" for c, k in kinds.items())
        with self._session() as c:
            if not self._exists(c, self.table):
                self._run(c, f"CREATE TABLE {quoted(self.table)} ({columns})")
            if not self._exists(c, MARKS):
                self._run(c, f"CREATE TABLE {MARKS} (STREAM VARCHAR(500) NOT NULL PRIMARY KEY, LAST_BATCH BIGINT NOT NULL)")

    def last_batch(self, stream: str) -> int:
        """The last batch of a stream that is in; -1 for none."""
        with self._session() as c:
            return self._last(c, stream)

    @staticmethod
    def _last(connection, stream: str) -> int:
        statement = connection.prepareStatement(f"SELECT LAST_BATCH FROM {MARKS} WHERE STREAM = ?")
        try:
            statement.setString(1, stream)
            rows = statement.executeQuery()
            return rows.getLong(1) if rows.next() else -1
        finally:
            statement.close()

    def merge(self, rows: DataFrame, stream: str, number: int, parts: int = 8) -> bool:
        """Insert ``rows`` or overwrite those of their keys (one row a key; null keys are left out); False if the batch was in.

        ``parts`` bounds the connections that write at a time.  A staging table is the batch's own, so
        what an attempt before has left in it is replaced.
        """
        if number <= self.last_batch(stream):
            return False
        staging = f"{self.table}_STAGING_{number}"
        kinds = column_types(rows.schema, self.key_chars, (self.key,))
        types = ", ".join(f"`{c}` {k}" for c, k in kinds.items() if k.startswith(("VARCHAR", "DECIMAL")))
        staged = rows.where(F.col(f"`{self.key}`").isNotNull()).repartition(parts, f"`{self.key}`")
        options = {**self.properties, "url": self.url, "dbtable": quoted(staging), **({"createTableColumnTypes": types} if types else {})}
        staged.write.format("jdbc").options(**options).mode("overwrite").save()
        rest = [c for c in rows.columns if c != self.key]
        on = f"t.{quoted(self.key)} = s.{quoted(self.key)}"
        update = f"WHEN MATCHED THEN UPDATE SET {', '.join(f'{quoted(c)} = s.{quoted(c)}' for c in rest)} " if rest else ""
        insert = f"WHEN NOT MATCHED THEN INSERT ({', '.join(map(quoted, rows.columns))}) VALUES ({', '.join(f's.{quoted(c)}' for c in rows.columns)})"
        with self._session() as c:
            last = self._last(c, stream)
            if number <= last:
                done = False
            else:
                self._run(c, f"MERGE INTO {quoted(self.table)} t USING {quoted(staging)} s ON {on} {update}{insert}")
                if last < 0:
                    self._run(c, f"INSERT INTO {MARKS} (STREAM, LAST_BATCH) VALUES (?, ?)", stream, number)
                else:
                    self._run(c, f"UPDATE {MARKS} SET LAST_BATCH = ? WHERE STREAM = ?", number, stream)
                done = True
            self._run(c, f"DROP TABLE {quoted(staging)}")
        return done

    def read(self, parts: int = 8) -> DataFrame:
        """All rows; a whole-number key is read in ``parts`` ranges between its least and greatest."""
        options = {**self.properties, "url": self.url}
        reader = self.spark.read.format("jdbc").options(**options)
        with self._session() as c:
            statement = c.prepareStatement(f"SELECT MIN({quoted(self.key)}), MAX({quoted(self.key)}) FROM {quoted(self.table)}")
            ends = statement.executeQuery()
            ends.next()
            low, high = ends.getObject(1), ends.getObject(2)
            statement.close()
        if isinstance(low, int) and low < high:
            reader = reader.options(partitionColumn=quoted(self.key), lowerBound=low, upperBound=high + 1, numPartitions=parts)
        return reader.option("dbtable", quoted(self.table)).load()


def into_database(table: DatabaseTable, stream: str):
    """A foreachBatch function that merges each batch of a stream once."""

    def merge(batch: DataFrame, number: int) -> None:
        table.merge(batch, stream, number)

    return merge
