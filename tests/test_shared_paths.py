"""Parts with numbers of seven digits, whose padded paths hold six: ten parts share each path."""

import duckdb
import pytest

from lodestone.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def shared(tmp_path_factory):
    """A folder of tables, and DuckDB over it."""
    where = tmp_path_factory.mktemp("shared-paths")
    con = duckdb.connect()
    con.execute(f"copy (select * replace (p_partkey + 999990 as p_partkey, 'same' as p_name) from '{SF}/part.parquet') to '{where}/part.parquet' (format parquet)")
    con.execute(f"copy (select * replace (l_partkey + 999990 as l_partkey) from '{SF}/lineitem.parquet') to '{where}/lineitem.parquet' (format parquet)")
    for name in ("part", "lineitem"):
        con.execute(f"create view {name} as select * from '{where}/{name}.parquet'")
    return str(where), con


def same(spark, shared, key):
    where, con = shared
    cursor = con.execute(ORACLES[key])
    names = [d[0] for d in cursor.description]
    want = sorted(cursor.fetchall())
    assert want and sorted(tuple(r) for r in QUERIES[key](spark, where).select(*names).collect()) == want


def test_symbols_are_told_by_number(spark, shared):
    same(spark, shared, "cmd_symbol_identity")


def test_states_of_files_that_share_a_path(spark, shared):
    same(spark, shared, "str_incremental")
