import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def values(spark):
    """Evaluate column functions over rows given as tuples: values(ddl, rows, *columns) -> list of tuples."""

    def run(ddl, rows, *cols):
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"_i int, {ddl}")
        got = df.select("_i", *[x.alias(f"c{k}") for k, x in enumerate(cols)]).collect()
        out = [tuple(r)[1:] for r in sorted(got)] if not cols else [tuple(r)[1:] for r in sorted(got, key=lambda r: r._i)]
        return [r[0] for r in out] if len(cols) == 1 else out

    return run
