import pytest

from heightline.plans import catalog
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_oracle(spark, sf_dir, name):
    same(catalog.queries()[name](spark, sf_dir), catalog.oracle_sql()[name], sf_dir)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_addresses_lead_back_to_their_scripts(spark, sf_dir):
    rows = catalog.queries()["script_addresses"](spark, sf_dir).collect()
    assert rows and all(r["round_trip"] for r in rows) and {r["kind"] for r in rows} == {"p2wpkh", "p2pkh"}
