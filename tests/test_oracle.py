import sys, os
sys.path.insert(0, os.path.dirname(__file__))
import pytest
from oracle import connect, differences

from chatloom.plans.oracle import oracle_sql
from chatloom.plans.queries import queries


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, con, data, name):
    extra, missing, rows = differences(spark, con, data, queries()[name], oracle_sql()[name])
    assert not extra and not missing, (list(extra)[:3], list(missing)[:3])
    assert rows > 0 or name == "chat_avatars"  # the smallest tables may hold no chat photo


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_query_runs(spark, data, name):
    assert queries()[name](spark, data).count() > 0
