import pytest

import __spark_entry__ as contract
from checks.compare import connect, differences
from conftest import SF
from registryloom.llm.queries import LLM_QUERIES
from registryloom.llm.sql import LLM_ORACLES


@pytest.mark.parametrize("name", LLM_ORACLES)
def test_query_equals_its_sql(spark, name):
    assert differences(LLM_QUERIES[name](spark, SF), connect(SF), LLM_ORACLES[name]) == ""


def test_each_operator_has_one_query():
    numbers = sorted(int(n[2:].split("_")[0]) for n in contract.queries() if n.startswith("op"))
    assert numbers == list(range(1, 14)) and "pipeline" in contract.queries()
