"""Graph steps that move no product of pairs and derive their edges once."""

from filinglens.operators import graph
from filinglens.plans.views import Tables

EDGE = "src_type string, src string, rel string, dst_type string, dst string, trade_id long, transaction_type string, transaction_date date"


def _edges(spark, rows):
    return spark.createDataFrame([(*r, *[None] * (8 - len(r))) for r in rows], EDGE)


def _plan(df):
    return df._jdf.queryExecution().toString()


def test_triangles_list_firms_once_per_circle(spark):
    staff = [("Lobbyist", p, "EMPLOYED_BY", "LobbyingFirm", f) for p, f in [("p", "f1"), ("p", "f2"), ("q", "f2"), ("q", "f3"), ("r", "f4")]]
    former = [("Lobbyist", p, "FORMERLY_AT", "Member", m) for p, m in [("p", "m"), ("q", "m"), ("p", "n")]]
    lobbied = [("LobbyingFirm", f, "LOBBIED", "Member", m) for f, m in [("f1", "m"), ("f4", "n"), ("f3", "o"), ("f3", "o")]]
    clients = [("LobbyingFirm", f, "LOBBIED_FOR", "Company", c) for f, c in [("f1", "A"), ("f2", "A"), ("f3", "A"), ("f4", "B"), ("f2", "B")]]
    trades = [("Member", m, "TRADED", "Company", c, i, "sale") for i, (m, c) in enumerate(
        [("m", "A"), ("n", "A"), ("n", "B"), ("o", "A"), ("o", "B"), ("m", "A"), ("z", "A")])]
    out = graph.suspicious_triangles(_edges(spark, staff + former + lobbied + clients + trades))
    reach = {(f, m) for _, p, _, _, f in staff for _, q, _, _, m in former if p == q} | {(f, m) for _, f, _, _, m in lobbied}
    serves = {(f, c) for _, f, _, _, c in clients}
    want = sorted((i, m, c, f) for _, m, _, _, c, i, _ in trades for f, n in reach if n == m and (f, c) in serves)
    assert sorted(tuple(r) for r in out.select("trade_id", "member", "ticker", "firm").collect()) == want
    assert "explode(_firms" in _plan(out)


def test_neighbourhood_reads_stored_edges(spark):
    rows = [("Member", "m", "SITS_ON", "Committee", "x"), ("Member", "n", "SITS_ON", "Committee", "x"),
            ("Member", "n", "TRADED", "Company", "A"), ("Member", "n", "TRADED", "Company", "A"), ("Member", "o", "TRADED", "Company", "A")]
    reached, inside = graph.neighbourhood(_edges(spark, rows), "Member:m", 2)
    assert {tuple(r) for r in reached.collect()} == {("Member:m", 0), ("Committee:x", 1), ("Member:n", 2)}
    assert inside.count() == 2 and inside.inputFiles() and all("neighbourhood-" in f for f in inside.inputFiles())


def test_mean_aggregate_is_a_plain_mean(spark):
    edges = _edges(spark, [("a", "1", "r", "b", "9"), ("a", "2", "r", "b", "9"), ("a", "2", "r", "b", "9"), ("a", "1", "s", "b", "9")])
    features = spark.createDataFrame([("a", "1", [1.0, 4.0]), ("a", "2", [2.0, 8.0]), ("b", "9", [10.0, 0.0])],
                                     "type string, id string, features array<double>")
    out = graph.mean_aggregate(features, edges)
    assert {r.id: r.features for r in out.collect()} == {"1": [1.0, 4.0], "2": [2.0, 8.0], "9": [12.5, 10.0]}
    assert "ObjectHashAggregate" not in _plan(out)


def test_edges_are_stored_once(spark, tmp_path):
    kept = []

    def keep(df):
        path = f"{tmp_path}/{len(kept)}"
        kept.append(path)
        df.write.parquet(path)
        return spark.read.parquet(path)

    spark.createDataFrame([(1, 0, "BUILDING", 5.0), (2, 1, "HOUSEHOLD", 6.0)], "c_custkey long, c_nationkey int, c_mktsegment string, c_acctbal double"
                          ).write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(1, "S")], "s_suppkey long, s_name string").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(1, "Brand#1", "n", "t", 3)], "p_partkey long, p_brand string, p_name string, p_type string, p_size int"
                          ).write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(7, 1, "F", 9.0, "2000-01-01", "1-URGENT")], "o_orderkey long, o_custkey long, o_orderstatus string, "
                          "o_totalprice double, o_orderdate string, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(7, 1, 1, 1, 45.0, 9.0, "R", 0.1, "2000-01-02")], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, "
                          "l_quantity double, l_extendedprice double, l_returnflag string, l_discount double, l_shipdate string"
                          ).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(0, "A"), (1, "B")], "n_nationkey int, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    t = Tables(spark, str(tmp_path))
    nodes, edges = graph.build_graph(t, keep)
    plain_nodes, plain_edges = graph.build_graph(t)
    row = lambda df, *c: sorted(map(tuple, df.select(*c).collect()))
    assert row(edges, *graph.EDGE_COLUMNS) == row(plain_edges, *graph.EDGE_COLUMNS) != []
    assert row(nodes, "type", "id") == row(plain_nodes, "type", "id")
    assert len(kept) == 1 and edges.inputFiles() and all(f"{tmp_path}/0/" in f for f in edges.inputFiles())


def test_merged_shuffle_partitions_stay_small(spark, tmp_path):
    Tables(spark, str(tmp_path))
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "4MB"
