"""Every query of the catalogue against its SQL in DuckDB, on whole tables. A few queries run at a time."""

from concurrent.futures import Future, ThreadPoolExecutor

import pytest
from spectraframe.plans import queries

from .conftest import rows_of

AT_A_TIME = 6


@pytest.fixture(scope="module")
def results(spark, sf_dir, request):
    """The rows of each query that is to be tested."""
    names = [i.callspec.params["name"] for i in request.session.items if i.module is request.module and "name" in getattr(getattr(i, "callspec", None), "params", ())]
    with ThreadPoolExecutor(AT_A_TIME) as pool:
        found: dict[str, Future] = {n: pool.submit(lambda n=n: queries.QUERIES[n](spark, sf_dir).toPandas()) for n in names}
        yield found
        for f in found.values():
            f.cancel()


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(name, results, duck):
    got, want = results[name].result(), duck.execute(queries.SQL[name]).df()
    assert rows_of(got) == rows_of(want)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_without_sql(name, results):
    assert len(results[name].result()) > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(queries.SQL) <= set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
