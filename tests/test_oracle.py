"""A sample of the registered queries against DuckDB; ``tools/check.py`` runs all of them."""

import check
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = ["contract_reasons", "pipeline_report", "contract_profile", "missing_assoc_chi2", "impute_knn", "drift_report", "corrupt_zip", "retrain_set"]


@pytest.mark.parametrize("name", NAMES)
def test_rows_equal(spark, name):
    ok, note = check.compare(spark, check.database(SF), name, SF)
    assert ok, note


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
