"""Every query that has SQL must equal it at the smallest scale."""

import duckdb
import pytest

from cairn.plans import repository_queries, snapshot_queries

QUERIES, ORACLE = {**snapshot_queries.QUERIES, **repository_queries.QUERIES}, {**snapshot_queries.ORACLE, **repository_queries.ORACLE}
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(repr(tuple(r[i] for i in order)) for r in data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name not in ORACLE:
        assert got[1] and all("False" not in r for r in got[1])
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    out = con.execute(ORACLE[name])
    assert got == rows([d[0] for d in out.description], out.fetchall())


def test_broken_chunk_layouts_are_found(spark):
    from cairn.operators.chunking import chunks, contiguity

    bad = spark.createDataFrame([("gap", 1, 0, 4), ("shift", 0, 1, 4), ("empty", 0, 0, 0), ("good", 0, 0, 4), ("good", 1, 4, 2)], "f string, sequence_number long, raw_offset long, raw_length long")
    assert {r.f: r.contiguous for r in contiguity(bad, ["f"]).collect()} == {"gap": False, "shift": False, "empty": False, "good": True}
    files = spark.createDataFrame([("e", b""), ("m", b"12345678"), ("t", b"123456789")], "f string, content binary")
    assert sorted((r.f, r.sequence_number, r.raw_length) for r in chunks(files, 4).collect()) == [("m", 0, 4), ("m", 1, 4), ("t", 0, 4), ("t", 1, 4), ("t", 2, 1)]
