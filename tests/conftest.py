import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from loci.runtime import build_session, shared_dir  # noqa: E402

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", cores="4", shuffle_partitions=4, memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    # The tables here are tiny: compiling each plan would take most of the time.
    session.conf.set("spark.sql.codegen.wholeStage", "false")
    session.conf.set("spark.sql.codegen.factoryMode", "NO_CODEGEN")
    shared_dir(session)
    yield session


@pytest.fixture(scope="session")
def small():
    return f"{DATA}/sf0.001"


@pytest.fixture(scope="session")
def duck(small):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(small).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.fixture(scope="session")
def same_as_sql(spark, duck, small):
    """Compare a query with its SQL on the smallest tables."""

    def check(query, sql):
        df = query(spark, small)
        cols = sorted(df.columns)
        got = sorted(tuple(map(str, (r[c] for c in cols))) for r in df.collect())
        res = duck.execute(sql)
        names = [d[0] for d in res.description]
        assert sorted(names) == cols
        want = sorted(tuple(str(r[names.index(c)]) for c in cols) for r in res.fetchall())
        assert got == want

    return check
