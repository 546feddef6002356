"""Every query that has SQL, beside DuckDB on the smallest tables. Reports read one written proteins view."""

import duckdb  # noqa: F401
import pytest

import __spark_entry__ as entry
from angleweave.plans import catalogue
from tests import compare

DIR = "/root/testdata/sf0.001"
NAMES = sorted(n for n in entry.oracle_sql() if not (n.startswith("op") and n[2].isdigit()))


@pytest.fixture(scope="module")
def con():
    return compare.views(DIR)


@pytest.fixture(scope="module", autouse=True)
def written_view(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("view")) + "/proteins"
    make = catalogue.protein_table
    make(spark, DIR).write.parquet(path)
    patch = pytest.MonkeyPatch()
    patch.setattr(catalogue, "protein_table", lambda spark, d: spark.read.parquet(path) if d == DIR else make(spark, d))
    yield
    patch.undo()


@pytest.mark.parametrize("name", NAMES)
def test_pair(spark, con, name):
    assert compare.differences(spark, con, entry.queries()[name], entry.oracle_sql()[name], DIR) == ""
