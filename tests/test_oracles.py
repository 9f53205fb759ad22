import pytest
from oracle import both

from flowloom.operators import queries as general
from flowloom.plans import flow_queries, text_queries
from flowloom.sources import queries as sources
from flowloom.streaming import queries as streams

MODULES = [general, flow_queries, text_queries, sources, streams]
CASES = [(name, m) for m in MODULES for name in m.oracle_sql()]


@pytest.mark.parametrize("name,module", CASES, ids=[c[0] for c in CASES])
def test_matches_sql(spark, sf, name, module):
    got, want = both(spark, sf, module.queries()[name], module.oracle_sql()[name])
    assert got == want


def test_every_sql_has_a_query():
    for m in MODULES:
        assert set(m.oracle_sql()) <= set(m.queries())
