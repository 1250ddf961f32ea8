import pytest

from gridloom.llm.queries import ORACLES, QUERIES
from tests.test_catalogue import compare

NAMES = sorted(ORACLES)


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, name):
    compare(spark, QUERIES[name], ORACLES[name], "sf0.01")


def test_every_operator_is_registered():
    numbers = {int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")}
    assert numbers == set(range(1, 14)) and "pipeline" in QUERIES and set(ORACLES) <= set(QUERIES)
