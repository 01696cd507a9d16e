import contextlib
import io

import pytest
from compare import connect, difference

import __spark_entry__ as entry
from riskweave.functions.accounts import key_pads
from riskweave.plans.catalog import QUERIES
from riskweave.plans.oracle import ORACLES
from riskweave.sources import derived

# These train a model in Python tasks.
TRAINED = {"fed_rounds", "local_baselines", "report"}


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_query_has_sql_but_training():
    assert set(QUERIES) - set(ORACLES) == TRAINED
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf_dir, name):
    """Equal to its SQL; no cross join, no Python per row and no key in the plan."""
    frames = []

    def run(session, folder):
        frames.append(QUERIES[name](session, folder))
        return frames[0]

    if name in ORACLES:
        assert difference(spark, con, run, ORACLES[name], sf_dir) is None
    else:
        assert run(spark, sf_dir).count() > 0
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        frames[0].explain(True)
    plan = out.getvalue()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert "EvalPython" not in plan and "InPandas" not in plan and "InArrow" not in plan
    for pad in key_pads(derived.TEST_KEY):
        assert pad.hex() not in plan.lower()


def test_entry_registers_every_query():
    assert set(QUERIES) <= set(entry.queries())
    assert set(ORACLES) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
