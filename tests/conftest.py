import os
import sys
from datetime import datetime

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from kerbside.session import own_tables  # noqa: E402

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("tables")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    with own_tables(s):
        yield s
    s.stop()


def at(text: str) -> datetime:
    return datetime.fromisoformat(text)


def tuples(df, *columns):
    """Rows as a sorted list of plain tuples."""
    rows = df.select(*[f"`{c}`" for c in columns]).collect() if columns else df.collect()
    return sorted((tuple(r) for r in rows), key=repr)
