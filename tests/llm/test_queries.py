"""The queries of this package against their SQL, on the smallest tables; the others run."""

import pytest

from loci.llm.oracles import ORACLES
from loci.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(name, same_as_sql):
    same_as_sql(QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(name, spark, small):
    df = QUERIES[name](spark, small)
    assert df.columns and df.collect() is not None


def test_found_columns(spark, small):
    want = {
        "p1_found": ["source_table", "record_id", "kind", "item_no"], "p2_found": ["memory_id_a", "memory_id_b"], "p3_found": ["id_a", "id_b"], "p4_found": ["trace_id", "memory_id"],
        "p6_found": ["memory_id", "term"], "p7_found": ["doc_id"], "p8_found": ["doc_id", "item_id"], "p9_found": ["doc_id"],
    }
    assert {n: QUERIES[n](spark, small).columns for n in want} == want


def test_redacted_covers_both_tables(spark, small):
    got = {r["source_table"]: r["n"] for r in QUERIES["p1_redacted"](spark, small).groupBy("source_table").count().withColumnRenamed("count", "n").collect()}
    assert got == {name: spark.read.parquet(f"{small}/{name}.parquet").count() for name in ("memories", "world_customers")}


def test_groups_hold_every_memory(spark, small):
    rows = spark.read.parquet(f"{small}/memories.parquet").where("id is not null")
    got = QUERIES["p3_groups"](spark, small).collect()
    assert len({r["id"] for r in got}) == rows.select("id").distinct().count()
    group = {r["id"]: r["group_id"] for r in got}
    same = rows.where("trim(content) <> ''").groupBy("content").agg({"id": "collect_set"}).collect()
    assert all(len({group[i] for i in r[1]}) == 1 for r in same)
