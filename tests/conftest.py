import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parent.parent), str(Path(__file__).resolve().parent)]

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pipekit.session import session

    spark = session(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "6g",
            "spark.checkpoint.dir": tmp_path_factory.mktemp("shared").as_uri(),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()


@pytest.fixture(scope="session")
def table(spark):
    return lambda name: spark.read.parquet(f"{SF_DIR}/{name}.parquet")


@pytest.fixture
def people(spark):
    """Nulls in every column, copies, mixed case, odd spaces, an apostrophe and a hyphen."""
    rows = [
        (1, "ANNA@x.org", "\tnew york ", "o'neil-smith", 10.0, 30),
        (1, "ANNA@x.org", "\tnew york ", "o'neil-smith", 10.0, 30),
        (2, None, "PARIS", "sales", None, 41),
        (3, "bob@y.org", None, "éa team", 30.0, None),
        (4, "c@z.org", "oslo", None, float("nan"), 25),
        (None, "", "rome", "R2d2", 50.0, 60),
    ]
    return spark.createDataFrame(
        rows, "id bigint, email string, city string, department string, salary double, age bigint"
    )


def rows(df, *columns):
    """The rows as a sorted list of tuples (nulls first)."""
    chosen = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in chosen.collect()), key=lambda r: [(v is not None, str(type(v)), v) for v in r])


def final_plan(df):
    """The plan as run, after adaptive changes."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()
