"""The graph of customers and suppliers over all line items, against plain sets."""

from attesta.plans import domain, relational


def test_party_graph_grows_with_the_tables(spark, tmp_path):
    items = [(i, i * 7 % 40, "R" if i % 3 == 0 else "N") for i in range(300)]
    spark.createDataFrame([(i, i % 120) for i in range(300)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(items, "l_orderkey long, l_suppkey long, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    bought = {(2 * (i % 120), 2 * s + 1) for i, s, _ in items}
    edges = bought | {(2 * s + 1, 2 * (i % 120)) for i, s, r in items if r == "R"}
    assert {(x.a, x.b) for x in relational.parties(spark, str(tmp_path)).collect()} == edges
    assert len({n for e in edges for n in e}) == 160
    assert {(x.a, x.b) for x in relational.party_mutual_links(spark, str(tmp_path)).collect()} == {(a, b) for a, b in edges if a < b and (b, a) in edges}
    known, front = {0: 0}, {0}
    for depth in range(1, 5):
        front = {b for a, b in edges if a in front} - set(known)
        known |= dict.fromkeys(front, depth)
    assert {(x.root, x.node): x.depth for x in domain.party_reach(spark, str(tmp_path)).collect()} == {(0, n): d for n, d in known.items() if d}
