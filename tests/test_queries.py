"""Every registered query at the smallest scale; those with an oracle must match it."""

import duckdb  # noqa: F401
import pytest
from check_queries import compare, connect

import __spark_entry__ as entry
from statframe.plans import load_all, registry

load_all()
#: Results that may have no rows: nothing to repair, no bend, no rows left over.
MAY_BE_EMPTY = {"logit_fix_linearity"}

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 4


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    got = entry.queries()[name](spark, SF).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert len(got) or name in MAY_BE_EMPTY
        numbers = got.select_dtypes("number")
        assert numbers.notna().any(axis=None) or numbers.empty
        again = entry.queries()[name](spark, SF).toPandas()
        assert compare(got, again) is None
    else:
        assert compare(got, con.execute(sql).df()) is None


def test_queries_return_the_whole_result(spark):
    got = {n: entry.queries()[n](spark, SF).toPandas() for n in ("adf_variants", "density_peaks", "mannwhitney_u_rest", "quality_report_variables")}
    assert set(got["adf_variants"]["diff"]) == {0, 1, 2} and len(got["density_peaks"]) == 4
    assert set(got["quality_report_variables"]["item"]) == {"skew", "outlier share"}
    events = spark.read.parquet(f"{SF}/events.parquet").where("value is not null").count()
    assert got["mannwhitney_u_rest"][["n1", "n2"]].sum(axis=1)[0] == events
    chapters = set(entry.queries()["full_analysis_chapters"](spark, SF).toPandas()["chapter"])
    assert {"selection", "tests"} < chapters
