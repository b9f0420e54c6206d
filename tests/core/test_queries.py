"""Every registered query of the core on the smallest tables, against its SQL where it has one."""

import collections
import os

import duckdb
import pytest

import __spark_entry__
from loomfold.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    made = duckdb.connect()
    made.sql("SET timezone = 'UTC'")
    for t in TABLES:
        made.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return made


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    found = registry.queries()[name](spark, SF)
    order = sorted(found.columns)
    rows = collections.Counter(tuple(r[c] for c in order) for r in found.collect())
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    want = con.sql(sql)
    assert order == sorted(want.columns)
    at = [want.columns.index(c) for c in order]
    assert rows == collections.Counter(tuple(r[i] for i in at) for r in want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_front_matter_of_odd_documents_is_as_in_sql(spark, tmp_path):
    texts = [None, "", " \n", "a", " \n a\n ", "a\r\n\r\nb", "a\n\x01\nb", "\x01", "\u00a0", "\u3000\na\u00a0", "\x0ba\x1f", "\x02a\n\x02", "\x02\x02", "---", "&amp;lt; & b"]
    rows = [(n, t, "src0", 5) for n, t in enumerate(texts)] + [(100 + n, t, s, 5) for t in ("", "a\n\nb") for n, s in enumerate([None, "", "ABC", "web crawl", " a", "ßx", "ŉa", "éa", "@a@b", 'a"b'], 20 * bool(t))]
    rows += [(200, "a", "src0", None), (None, "a", "src0", 5), (None, None, None, None), (2**63 - 1, "a", "src0", 2**63 - 1)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(registry.oracle_sql()["yaml_frontmatter"]).fetchall()
    found = registry.queries()["yaml_frontmatter"](spark, str(tmp_path))
    assert collections.Counter(map(tuple, found.collect())) == collections.Counter(want)
