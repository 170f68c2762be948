import math
import os

import duckdb
import pytest

from lectern.plans import stored  # noqa: F401
from lectern.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name in ORACLES:
        want = con.sql(ORACLES[name])
        assert sorted(want.columns) == cols
        at = [want.columns.index(c) for c in cols]
        assert rows == sorted((tuple(plain(r[k]) for k in at) for r in want.fetchall()), key=repr)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_priority_finds_a_genre_late_in_the_text(spark, tmp_path):
    rows = [(1, "x " * 200, "en", 400), (6, "x " * 200 + "sermon", "en", 400)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.priority for r in QUERIES["priority_rank"](spark, str(tmp_path)).collect()}
    assert got[6] == got[1] + 10
