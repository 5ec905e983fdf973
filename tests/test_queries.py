"""Every query against its SQL, on the small tables."""

import glob
import math
import os

import duckdb
import pytest

from paperweave.plans import catalog


def rows_of(frame, columns):
    def plain(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return None
        return x if isinstance(x, (str, bool)) else round(float(x), 6)

    return sorted(repr(tuple(plain(r[c]) for c in columns)) for r in frame)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path).split('.')[0]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, sf_dir, duck, name):
    ours = catalog.QUERIES[name](spark, sf_dir)
    theirs = duck.sql(catalog.SQL[name])
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    expected = [dict(zip(theirs.columns, r, strict=True)) for r in theirs.fetchall()]
    assert rows_of([r.asDict() for r in ours.collect()], columns) == rows_of(expected, columns)


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_rows_in_any_order_give_the_same_result(spark, sf_dir):
    from paperweave.operators import stitching
    from paperweave.plans.fixtures import PAGES, view

    pages = view(spark, sf_dir, PAGES)
    first = sorted(map(tuple, stitching.voted(stitching.voting_runs(pages)).select("upload_group_id", "scan_index", "voted_po_no").collect()), key=str)
    again = sorted(map(tuple, stitching.voted(stitching.voting_runs(pages.orderBy("scan_index", "upload_group_id").repartition(7))).select("upload_group_id", "scan_index", "voted_po_no").collect()), key=str)
    assert first == again
