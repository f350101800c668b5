"""Components of traders against union-find."""

import duckdb
from pareframe.plans import catalogue


def union_find(edges):
    up = {}

    def top(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        up[y] = x
    return {x: top(x) for x in up}


def found(spark, d):
    rows = [tuple(r) for r in catalogue.queries()["linked_traders"](spark, d).select("id", "component").collect()]
    assert len(rows) == len(dict(rows))
    return dict(rows)


def test_every_line_links(spark, tmp_path):
    # no line is R-flagged with 50 pieces
    lines = [(1, 0, "N", 1.0), (2, 0, "A", 50.0), (2, 1, "R", 49.0), (3, 1, "N", 50.0), (4, 2, "N", 7.0), (5, 3, "A", 2.0), (6, 3, "A", 2.0), (6, 3, "A", 2.0)]
    orders = [(1, 10), (2, 11), (3, 12), (4, 13), (5, 14), (6, 14), (7, 15)]
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_returnflag string, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    buyer = dict(orders)
    expected = union_find((-s - 1, buyer[o]) for o, s, _, _ in lines)
    assert len(set(expected.values())) == 3
    assert found(spark, str(tmp_path)) == expected


def test_given_tables(spark, sf_dir):
    edges = duckdb.sql(f"SELECT -l_suppkey - 1, o_custkey FROM '{sf_dir}/lineitem.parquet' JOIN '{sf_dir}/orders.parquet' ON o_orderkey = l_orderkey").fetchall()
    assert found(spark, sf_dir) == union_find(edges)
