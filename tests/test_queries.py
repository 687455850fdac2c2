"""Every query with SQL against DuckDB on the smallest tables, where those are there."""

import math
import os

import pytest

from spanloom.queries import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")

#: One or two of each module: the driver compares all of them at a larger size.
CHECKED = ["finditer_spans", "item_split", "feature_flags", "bio_decode", "span_nms", "section_reset", "cue_assertions", "final_score", "boundary_diag", "slue", "bm25_topk", "dense_codes", "reuse_components", "qa_overlap", "template_docs"]


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


def test_sql_has_its_query():
    assert set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", CHECKED)
def test_same_as_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    cur = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    want = sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in cur.fetchall())
    assert sorted(repr([plain(r[c]) for c in columns]) for r in df.collect()) == want


def test_sweep_of_phrases_that_overlap_themselves_equals_its_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    tables = {
        "documents": [(1, "bathe the the sea"), (2, "so the the the the end, a b a b a")], "benchmark": [(1, "the the best"), (2, "a b a")], "part": [(1, "the the"), (2, "a b a")],
    }
    schemas = {"documents": "doc_id long, text string", "benchmark": "item_id long, text string", "part": "p_partkey long, p_name string"}
    c = duckdb.connect()
    for name, rows in tables.items():
        spark.createDataFrame(rows, schemas[name]).write.parquet(f"{tmp_path}/{name}.parquet")
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    cur = c.execute(ORACLE_SQL["dictionary_sweep"])
    names = [d[0] for d in cur.description]
    df = QUERIES["dictionary_sweep"](spark, str(tmp_path))
    want = sorted(repr([r[names.index(k)] for k in sorted(names)]) for r in cur.fetchall())
    assert want and sorted(repr([r[k] for k in sorted(names)]) for r in df.collect()) == want
