"""Every query of the reference's operators against its SQL in DuckDB, over whole tables of the smallest size."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from stemma.plans import registry, sources


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return con


def plain(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind == "f":
            df[c] = df[c].map(lambda v: "None" if v != v else f"{v:.9g}")
        else:
            df[c] = df[c].map(lambda v: "None" if v is None or v is pd.NaT else str(list(v)) if isinstance(v, list | np.ndarray) else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, sf, name):
    got = registry.QUERIES[name](spark, sf).toPandas()
    if name not in registry.ORACLE_SQL:
        assert len(got)
        return
    want = duck.sql(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    pd.testing.assert_frame_equal(plain(got), plain(want), check_dtype=False)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_streams_read_a_folder_of_part_files(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(2).write.parquet(str(tmp_path / "events.parquet"))
    for name in ("stream_daily_counts", "stream_latest"):
        query = sources.QUERIES[name]
        assert sorted(map(tuple, query(spark, str(tmp_path)).collect())) == sorted(map(tuple, query(spark, sf).collect()))


@pytest.fixture(scope="module")
def rounds(spark, tmp_path_factory):
    """Orders whose keys go through three rounds of preprint ids, with different rows under an id; and DuckDB over them."""
    at = str(tmp_path_factory.mktemp("rounds"))
    rows = [(k + 1_200_000 * i, k % 40, "FOP"[(k + i) % 3], 1.0, f"{1995 + (k + i) % 4}-05-06", ("1-URGENT", "2-HIGH")[(k + i) % 2]) for i in range(3) for k in range(60)]
    names = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, day string, o_orderpriority string"
    spark.createDataFrame(rows, names).selectExpr("*", "cast(day as timestamp) as o_orderdate").drop("day").coalesce(1).write.parquet(f"{at}/orders.parquet")
    con = duckdb.connect(config={"threads": 1})  # it takes ties, which the SQL leaves open, in the order of the table
    con.sql(f"create view orders as select * from read_parquet('{at}/orders.parquet/*.parquet')")
    return at, con


@pytest.mark.parametrize("name", ["hydrated", "key_forms", "records_added", "records_deduplicated", "records_round_trip", "library_references", "library_collection", "library_entities", "library_links", "library_thin_arxiv", "thin_arxiv", "task_refs", "published_form"])
def test_rounds_of_ids(spark, rounds, name):
    got, want = registry.QUERIES[name](spark, rounds[0]).toPandas(), rounds[1].sql(registry.ORACLE_SQL[name]).df()
    pd.testing.assert_frame_equal(plain(got), plain(want), check_dtype=False)


@pytest.mark.parametrize("name", ["task_refs", "published_form"])
def test_ties_go_to_the_lower_number(spark, tmp_path, name):
    """The SQL leaves open which of the records of one id and version stays; with order numbers after the versions it has one result, in any order of rows."""
    made = spark.range(0, 6000, 1, 4).selectExpr("id % 600 + 1200000 * (id div 600) as o_orderkey", "id % 40 as o_custkey", "'O' as o_orderstatus", "1.0D as o_totalprice", "make_timestamp(cast(1995 + (id % 7 + id div 600) % 3 as int), 5, 6, 0, 0, 0) as o_orderdate", "concat(id % 2, '-URGENT') as o_orderpriority")
    made.repartition(5, "o_orderkey").write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.sql(f"create view orders as select * from read_parquet('{tmp_path}/orders.parquet/*.parquet')")
    settled = registry.ORACLE_SQL[name].replace("order by arxiv_version desc)", "order by arxiv_version desc, k)")
    assert settled != registry.ORACLE_SQL[name]
    pd.testing.assert_frame_equal(plain(registry.QUERIES[name](spark, str(tmp_path)).toPandas()), plain(con.sql(settled).df()), check_dtype=False)
