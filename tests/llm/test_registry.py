"""Every operator has one query over its whole table."""

from cargoledger.llm import oracles, queries


def test_one_query_per_operator():
    numbers = sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES)
    assert numbers == list(range(1, 14))
    assert set(oracles.ORACLES) <= set(queries.QUERIES)
