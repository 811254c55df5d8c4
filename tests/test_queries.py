"""Every query of the engine against its SQL, or that it runs and has rows."""

import pytest
from oracle import connect, difference

from graticule.plans import evaluation, frames, functions, matrices, pictures, regions, selection, shapes  # noqa: F401  (they add their queries)
from graticule.plans.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf, con, name):
    assert difference(con, QUERIES[name](spark, sf), SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_has_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).limit(1).count() == 1


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())


def test_neighbour_map_takes_all_its_rounds(spark, sf):
    from graticule import tables
    from graticule.operators import evaluation as operators

    want = {r["id"]: r["feat"] for r in operators.neighbour_map(tables.samples(spark, sf)).collect()}
    got = {r["id"]: r["feat"] for r in QUERIES["neighbour_map"](spark, sf).collect()}
    assert got.keys() == want.keys() and all(v == pytest.approx(want[k], abs=1e-4) for k, v in got.items())
