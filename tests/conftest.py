import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from textloom.session import local_session

    s = local_session(8, 8, "textloom-tests")
    yield s
    s.stop()


@pytest.fixture(autouse=True)
def embeddings_view(request, monkeypatch):
    """`test_sql` of the corpus queries names two tables; op11's SQL reads `embeddings` too."""
    if request.node.name.startswith("test_sql["):
        import duckdb

        connect = duckdb.connect

        def connected(*args, **kwargs):
            con = connect(*args, **kwargs)
            con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF_SMALL}/embeddings.parquet'")
            return con

        monkeypatch.setattr(duckdb, "connect", connected)
