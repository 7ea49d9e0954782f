import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tallymart.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[8]",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__sql__shuffle__partitions="4",
        spark__driver__memory="4g",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def rows(spark):
    """Rows of text cells, typed by a DDL schema; ISO text becomes a timestamp."""

    def make(schema, *data):
        from pyspark.sql import functions as F, types as T

        wanted = T.StructType.fromDDL(schema)
        plain = T.StructType(
            [
                T.StructField(f.name, T.StringType() if f.dataType.typeName() in ("timestamp", "date") else f.dataType)
                for f in wanted.fields
            ]
        )
        df = spark.createDataFrame(list(data), plain)
        return df.select(*[F.col(f.name).cast(f.dataType) for f in wanted.fields])

    return make
