import pytest

from tessera.plans.catalog import ORACLES, QUERIES

from ..oracle import FOLDER, compare


@pytest.mark.skipif(not FOLDER.exists(), reason="no driver tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    compare(spark, QUERIES[name], ORACLES[name])


def test_only_known_queries_lack_sql():
    assert set(QUERIES) - set(ORACLES) == {"text_budgets", "consolidated_groups", "entrypoint_detection"}
