"""Graph construction and patterns, signals, alerts and the screener."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import features as X
from ..operators import graph, screener, signals as sig
from ..session import Scratch
from . import stats
from .registry import R, S, TS, flat, query
from .catalog_joins import RISK_VIEWS

# ---------------------------------------------------------------- graph

EDGES = {
    "e_sits": """SELECT DISTINCT 'Member' AS src_type, member_bioguide_id AS src, 'SITS_ON' AS rel, 'Committee' AS dst_type,
        committee_code AS dst FROM assignments WHERE member_bioguide_id IN (SELECT bioguide_id FROM members)
        AND committee_code IN (SELECT system_code FROM committees)""",
    "e_traded": """SELECT 'Member' AS src_type, member_bioguide_id AS src, 'TRADED' AS rel, 'Company' AS dst_type, ticker AS dst,
        trade_id, transaction_type, transaction_date FROM trades WHERE ticker IS NOT NULL AND member_bioguide_id IN
        (SELECT bioguide_id FROM members)""",
    "e_bill": """SELECT 'Member' AS src_type, sponsor_bioguide_id AS src, 'SPONSORED' AS rel, 'Bill' AS dst_type, bill_id AS dst
        FROM bills WHERE sponsor_bioguide_id IN (SELECT bioguide_id FROM members)
        UNION SELECT 'Member', member_bioguide_id, 'COSPONSORED', 'Bill', bill_id FROM cosponsors
          WHERE member_bioguide_id IN (SELECT bioguide_id FROM members)
        UNION SELECT 'Bill', bill_id, 'REFERRED_TO', 'Committee', code FROM bill_committees""",
    "e_lobby": """SELECT 'LobbyingFirm' AS src_type, registrant_id AS src, 'LOBBIED_FOR' AS rel, 'Company' AS dst_type,
        matched_ticker AS dst, sum(amount) AS amount, count(*) AS filing_count, max(filing_year) AS year
        FROM filings f JOIN clients c ON f.client_id = c.client_id WHERE matched_ticker IS NOT NULL GROUP BY 2, 5""",
    "e_employed": """SELECT DISTINCT 'Lobbyist' AS src_type, name AS src, 'EMPLOYED_BY' AS rel, 'LobbyingFirm' AS dst_type,
        registrant_id AS dst FROM lobbyists""",
    "e_influence": """SELECT DISTINCT 'LobbyingFirm' AS src_type, registrant_id AS src, 'LOBBIED' AS rel, 'Member' AS dst_type,
        member_bioguide_id AS dst FROM lobbied WHERE member_bioguide_id IN (SELECT bioguide_id FROM members)
        UNION SELECT 'Lobbyist', name, 'FORMERLY_AT', 'Member', former_member_id FROM lobbyists
          WHERE is_former_congress AND former_member_id IN (SELECT bioguide_id FROM members)""",
    "e_donated": """SELECT 'Company' AS src_type, matched_ticker AS src, 'DONATED_TO' AS rel, 'Member' AS dst_type,
        member_bioguide_id AS dst, sum(cents / 100.0) AS total_amount, count(*) AS contribution_count
        FROM contributions c JOIN campaign_committees cc ON c.fec_committee_id = cc.fec_committee_id
        WHERE matched_ticker IS NOT NULL AND member_bioguide_id IS NOT NULL GROUP BY 2, 5""",
    "edges": """SELECT src_type, src, rel, dst_type, dst FROM e_sits UNION ALL SELECT src_type, src, rel, dst_type, dst FROM e_traded
        UNION ALL SELECT src_type, src, rel, dst_type, dst FROM e_bill UNION ALL SELECT src_type, src, rel, dst_type, dst FROM e_lobby
        UNION ALL SELECT src_type, src, rel, dst_type, dst FROM e_employed UNION ALL SELECT src_type, src, rel, dst_type, dst FROM e_influence
        UNION ALL SELECT src_type, src, rel, dst_type, dst FROM e_donated""",
    "companies": """SELECT ticker AS id, coalesce(arg_min(asset_name, trade_id), ticker) AS name FROM trades
        WHERE ticker IS NOT NULL AND member_bioguide_id IS NOT NULL GROUP BY 1""",
    "nodes": """SELECT 'Member' AS type, bioguide_id AS id FROM members UNION ALL SELECT 'Committee', system_code FROM committees
        UNION ALL SELECT 'Company', id FROM (SELECT id FROM companies UNION SELECT dst FROM e_lobby UNION SELECT src FROM e_donated)
        UNION ALL SELECT 'Bill', bill_id FROM bills UNION ALL SELECT 'LobbyingFirm', senate_id FROM registrants
        UNION ALL SELECT DISTINCT 'Lobbyist', src FROM e_employed""",
    "steps": """SELECT src_type || ':' || src AS a, dst_type || ':' || dst AS b, rel FROM edges
        UNION SELECT dst_type || ':' || dst, src_type || ':' || src, rel FROM edges""",
}
FIVE = "src_type, src, rel, dst_type, dst"


@query("g01_nodes", """SELECT 'Member' AS type, bioguide_id AS id, full_name AS name FROM members
    UNION ALL SELECT 'Committee', system_code, name FROM committees""")
def _(t):
    return graph.member_nodes(t.members).select("type", "id", "name").unionByName(
        graph.committee_nodes(t.committees).select("type", "id", "name"))


@query("g02_sits_on", f"SELECT {FIVE} FROM e_sits", EDGES)
def _(t):
    return graph.sits_on(t.assignments, t.members, t.committees).select(*graph.EDGE_COLUMNS)


@query("g03_traded", f"SELECT {FIVE}, trade_id FROM e_traded", EDGES)
def _(t):
    return graph.traded(t.trades, t.members).select(*graph.EDGE_COLUMNS, "trade_id")


@query("g03_company_nodes", "SELECT 'Company' AS type, id, name FROM companies", EDGES)
def _(t):
    return graph.company_nodes(t.trades)


@query("g04_bill_edges", f"SELECT {FIVE} FROM e_bill", EDGES)
def _(t):
    return graph.bill_edges(t.bills, t.cosponsors, t.members, t.committees).select(*graph.EDGE_COLUMNS)


@query("g04_hearing_on", """SELECT DISTINCT committee_code AS src, 'hr' || (hearing_id % 15000) || '-118' AS dst FROM hearings
    WHERE 'hr' || (hearing_id % 15000) || '-118' IN (SELECT bill_id FROM bills)""")
def _(t):
    listed = t.hearings.withColumn("related_bills", F.array(F.struct(
        F.lit(118).alias("congress"), F.lit("HR").alias("type"), (F.col("hearing_id") % 15000).cast("string").alias("number"))))
    return graph.hearing_edges(listed, t.bills).select("src", "dst")


@query("g05_lobby_edges", f"""SELECT {FIVE}, {R('amount')} AS amount, filing_count::DOUBLE AS filing_count, year::DOUBLE AS year FROM e_lobby
    UNION ALL SELECT {FIVE}, NULL, NULL, NULL FROM e_employed""", EDGES)
def _(t):
    df = graph.lobby_edges(t.filings, t.clients, t.registrants, t.lobbyists)
    df = df.withColumn("filing_count", F.col("filing_count").cast("double")).withColumn("year", F.col("year").cast("double"))
    return flat(df, *graph.EDGE_COLUMNS, "amount", "filing_count", "year")


@query("g06_donated_to", f"SELECT {FIVE}, {R('total_amount')} AS total_amount, contribution_count FROM e_donated", EDGES)
def _(t):
    c = t.contributions.withColumn("amount", F.col("cents") / 100.0)
    return flat(graph.donated_to(c, t.campaign_committees, t.members), *graph.EDGE_COLUMNS, "total_amount", "contribution_count")


def _edges(t):
    return graph.build_graph(t)[1]


def _stored(t):
    """(nodes, edges) with the edges written once, for queries that read them several times."""
    return graph.build_graph(t, Scratch(t.spark, "graph").keep)


def _paths_sql(source: str, target: str) -> str:
    """Shortest paths up to four steps, written out length by length."""
    parts = []
    for n in range(1, 5):
        joins = f"FROM steps s1 " + " ".join(f"JOIN steps s{i} ON s{i}.a = s{i - 1}.b" for i in range(2, n + 1))
        nodes = " || '>' || ".join(["s1.a", *[f"s{i}.b" for i in range(1, n + 1)]])
        rels = " || '>' || ".join(f"s{i}.rel" for i in range(1, n + 1))
        parts.append(f"SELECT {nodes} AS path, {rels} AS rels, {n} AS length {joins} WHERE s1.a = '{source}' AND s{n}.b = '{target}'")
    return f"""SELECT path, rels, length FROM (SELECT *, min(length) OVER () AS least FROM ({' UNION ALL '.join(parts)}))
        WHERE length = least"""


@query("g07_shortest_paths", _paths_sql("Member:7", "Company:Brand#7"), EDGES)
def _(t):
    df = graph.shortest_paths(_edges(t), "Member:7", "Company:Brand#7", 4, limit=None)
    return df.select(F.array_join("nodes", ">").alias("path"), F.array_join("rels", ">").alias("rels"), "length")


@query("g08_suspicious_triangles", """SELECT DISTINCT x.trade_id, x.src AS member, x.dst AS ticker, l.src AS firm
    FROM e_traded x JOIN e_lobby l ON l.dst = x.dst
    WHERE EXISTS (SELECT 1 FROM e_influence i WHERE i.rel = 'LOBBIED' AND i.src = l.src AND i.dst = x.src)
       OR EXISTS (SELECT 1 FROM e_employed p JOIN e_influence f ON f.rel = 'FORMERLY_AT' AND f.src = p.src
                  WHERE p.dst = l.src AND f.dst = x.src)""", EDGES)
def _(t):
    return graph.suspicious_triangles(_edges(t)).select("trade_id", "member", "ticker", "firm")


@query("g09_committee_overlap", f"""SELECT DISTINCT x.src AS member, x.dst AS ticker, x.transaction_type,
    {S('x.transaction_date')} AS transaction_date, s.dst AS committee, b.src AS bill, l.src AS firm
    FROM (SELECT DISTINCT src, dst, transaction_type, transaction_date FROM e_traded t
          WHERE src IN (SELECT src FROM e_sits) AND dst IN (SELECT dst FROM e_lobby)
            AND src IN (SELECT s2.src FROM e_sits s2 JOIN e_bill b2 ON b2.rel = 'REFERRED_TO' AND b2.dst = s2.dst)
          ORDER BY transaction_date DESC, src, dst, transaction_type LIMIT 50) x
    JOIN e_sits s ON s.src = x.src JOIN e_bill b ON b.rel = 'REFERRED_TO' AND b.dst = s.dst JOIN e_lobby l ON l.dst = x.dst
    ORDER BY transaction_date DESC, member, ticker, transaction_type, committee, bill, firm LIMIT 50""", EDGES)
def _(t):
    return flat(graph.committee_overlap(_edges(t), 50), "member", "ticker", "transaction_type", "transaction_date",
                "committee", "bill", "firm")


REACHED = {
    **EDGES,
    "reached": """SELECT a, min(distance) AS distance FROM (SELECT 'Member:7' AS a, 0 AS distance
        UNION ALL SELECT b, 1 FROM steps WHERE a = 'Member:7'
        UNION ALL SELECT s2.b, 2 FROM steps s1 JOIN steps s2 ON s2.a = s1.b WHERE s1.a = 'Member:7') GROUP BY a""",
}


@query("g10_neighbourhood_nodes", "SELECT a, CAST(distance AS INTEGER) AS distance FROM reached", REACHED)
def _(t):
    return graph.neighbourhood(_edges(t).select(*graph.EDGE_COLUMNS), "Member:7", 2)[0]


@query("g10_neighbourhood_edges", """SELECT rel, count(*) AS n FROM edges WHERE src_type || ':' || src IN (SELECT a FROM reached)
    AND dst_type || ':' || dst IN (SELECT a FROM reached) GROUP BY 1""", REACHED)
def _(t):
    return graph.neighbourhood(_edges(t).select(*graph.EDGE_COLUMNS), "Member:7", 2)[1].groupBy("rel").agg(F.count("*").alias("n"))


@query("g11_connections", """SELECT member, CAST(count(*) AS BIGINT) AS companies_traded,
    string_agg(ticker || ':' || n, ',' ORDER BY ticker) AS traded, CAST(sum(firms) AS BIGINT) AS lobbying_link_count,
    count(donations) AS donation_link_count, md5(coalesce(string_agg(links, ',' ORDER BY ticker), '')) AS links,
    coalesce(string_agg(ticker || ':' || donations, ',' ORDER BY ticker) FILTER (donations IS NOT NULL), '') AS donors FROM (
      SELECT x.member, x.ticker, x.n, coalesce(l.firms, 0) AS firms, l.links, d.contribution_count AS donations FROM (
        SELECT src AS member, dst AS ticker, count(*) AS n FROM e_traded GROUP BY 1, 2) x
      LEFT JOIN (SELECT dst, count(*) AS firms, string_agg(dst || ':' || src, ',' ORDER BY src) AS links FROM e_lobby GROUP BY 1) l ON l.dst = x.ticker
      LEFT JOIN e_donated d ON d.src = x.ticker AND d.dst = x.member) GROUP BY 1""", EDGES)
def _(t):
    df = graph.connections(_edges(t))
    traded = F.array_join(F.transform("traded_companies", lambda c: F.concat_ws(
        ":", c["ticker"], c["trade_count"].cast("string"))), ",")
    links = F.array_join(F.transform("lobbying_connections", lambda c: c["links"]), ",")
    donors = F.array_join(F.transform("donation_connections", lambda c: F.concat_ws(
        ":", c["ticker"], c["contribution_count"].cast("string"))), ",")
    return df.select("member", "companies_traded", traded.alias("traded"), "lobbying_link_count", "donation_link_count",
                     F.md5(links.cast("binary")).alias("links"), donors.alias("donors"))


@query("g11_company_firms", "SELECT DISTINCT dst AS ticker, src AS firm FROM e_lobby", EDGES)
def _(t):
    return graph.company_firms(_edges(t))


STATS_SQL = """SELECT 'node' AS kind, type, count(*) AS n FROM nodes GROUP BY 2
    UNION ALL SELECT 'edge', rel, count(*) FROM edges GROUP BY 2"""


@query("g12_graph_stats", STATS_SQL, EDGES)
def _(t):
    return graph.graph_stats(*graph.build_graph(t))


@query("g13_build_graph", f"SELECT {FIVE}, count(*) AS n FROM edges GROUP BY ALL", EDGES)
def _(t):
    return _edges(t).groupBy(*graph.EDGE_COLUMNS).agg(F.count("*").alias("n"))


FEATURES = {
    **EDGES,
    "degrees": """SELECT type, id, count(*) AS degree FROM (SELECT DISTINCT src_type AS type, src AS id, rel, dst_type, dst FROM edges
        UNION ALL SELECT DISTINCT dst_type, dst, rel, src_type, src FROM edges) GROUP BY 1, 2""",
}
VECTOR_SQL = """CASE WHEN n.type <> 'Member' THEN coalesce(d.degree, 0) || '' ELSE
    (chamber = 'house')::INT || ',' || (chamber = 'senate')::INT || ',' || coalesce((party IN ('Democratic','Democrat'))::INT, 0) || ',' ||
    coalesce((party = 'Republican')::INT, 0) || ',' || coalesce((party = 'Independent')::INT, 0) || ',' || in_office::INT || ',' ||
    CAST(round(coalesce(nominate_dim1, 0) * 1000000) AS BIGINT) || ',' || CAST(round(coalesce(nominate_dim2, 0) * 1000000) AS BIGINT) END"""


@query("g14_node_features", f"""SELECT n.type, n.id, {VECTOR_SQL} AS features FROM nodes n
    LEFT JOIN degrees d ON d.type = n.type AND d.id = n.id LEFT JOIN members m ON n.type = 'Member' AND m.bioguide_id = n.id""", FEATURES)
def _(t):
    df = graph.node_features(*_stored(t))
    scaled = F.transform("features", lambda v, i: F.round(F.when(i >= 6, v * 1000000).otherwise(v)).cast("long").cast("string"))
    return df.select("type", "id", F.array_join(scaled, ",").alias("features"))


@query("g15_edge_index", """SELECT src_type, rel, dst_type, count(*) AS n, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets
    FROM (SELECT DISTINCT * FROM edges) GROUP BY 1, 2, 3""", EDGES)
def _(t):
    df = graph.edge_index(*_stored(t))
    return df.groupBy("src_type", "rel", "dst_type").agg(
        F.count("*").alias("n"), F.count_distinct("src_idx").alias("sources"), F.count_distinct("dst_idx").alias("targets"))


@query("g15_node_index", """SELECT type, count(*) AS n, CAST(0 AS BIGINT) AS first, count(*) - 1 AS last, count(*) AS numbers
    FROM nodes GROUP BY 1""", EDGES)
def _(t):
    df = graph.node_index(graph.build_graph(t)[0])
    return df.groupBy("type").agg(
        F.count("*").alias("n"), F.min("idx").alias("first"), F.max("idx").alias("last"), F.count_distinct("idx").alias("numbers"))


@query("g16_mean_aggregate", f"""SELECT n.type, n.id, {R('coalesce(any_value(d.degree), 0) + coalesce(sum(m.v), 0)')} AS value
    FROM nodes n LEFT JOIN degrees d ON d.type = n.type AND d.id = n.id
    LEFT JOIN (SELECT dst_type, dst, src_type, rel, avg(coalesce(degree, 0)) AS v FROM (SELECT DISTINCT {FIVE} FROM edges) e
      JOIN degrees d ON d.type = e.src_type AND d.id = e.src GROUP BY 1, 2, 3, 4) m ON m.dst_type = n.type AND m.dst = n.id
    GROUP BY 1, 2""", FEATURES)
def _(t):
    keep = Scratch(t.spark, "graph").keep
    nodes, edges = graph.build_graph(t, keep)
    ends = graph.typed_edges(nodes, edges)
    degree = ends.select(F.explode(F.array(
        F.struct(F.col("src_type").alias("type"), F.col("src").alias("id")),
        F.struct(F.col("dst_type").alias("type"), F.col("dst").alias("id")))).alias("e")).groupBy("e.type", "e.id").agg(
        F.count("*").cast("double").alias("d"))
    features = nodes.select("type", "id").join(degree, ["type", "id"], "left").select(
        "type", "id", F.array(F.coalesce("d", F.lit(0.0))).alias("features"))
    return flat(graph.mean_aggregate(keep(features), edges, 1).select("type", "id", F.col("features")[0].alias("value")))


@query("g17_train_embeddings")
def _(t):
    nodes, edges = _stored(t)
    embeddings, score = graph.train_embeddings(edges, nodes, dim=8, iterations=5)
    return embeddings.groupBy("type").agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dim")).crossJoin(
        score.select((F.col("auc") >= 0).alias("scored")))


@query("j19_attach_embeddings", f"""SELECT t.trade_id, {R("coalesce(list_sum(m.embedding), 0)")} AS member_sum,
    {R("coalesce(list_sum(c.embedding), 0)")} AS company_sum, 128 AS width FROM trades t
    LEFT JOIN embeddings m ON CAST(m.vec_id AS VARCHAR) = t.member_bioguide_id
    LEFT JOIN embeddings c ON c.vec_id < 20 AND 'Brand#' || c.vec_id = t.ticker""")
def _(t):
    e = t.raw("embeddings")
    vectors = e.select(F.lit("Member").alias("type"), F.col("vec_id").cast("string").alias("id"), "embedding").unionByName(
        e.filter("vec_id < 20").select(F.lit("Company").alias("type"), F.concat(
            F.lit("Brand#"), F.col("vec_id").cast("string")).alias("id"), "embedding"))
    df = graph.attach_embeddings(t.trades, vectors, 64)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return flat(df.select("trade_id", total("member_embedding").alias("member_sum"), total("company_embedding").alias("company_sum"),
                          (F.size("member_embedding") + F.size("company_embedding")).alias("width")))


# ---------------------------------------------------------------- signals

SIGNAL_DAY = "2001-07-15 00:00:00"  # inside the trade and prediction dates


def _as_of():
    return F.lit(SIGNAL_DAY).cast("timestamp")


def _old_signals(t):
    """Earlier signals: some trades of the days before, one per fifth trade."""
    k = F.col("trade_id")
    kinds = F.element_at(F.array(*[F.lit(s) for s in ("trade_follow", "anomaly_alert", "sentiment_divergence")]), (k % 3 + 1).cast("int"))
    return t.trades.filter((k % 5 == 0) & F.col("ticker").isNotNull()).select(
        F.when(k % 35 == 0, "insider_cluster").otherwise(kinds).alias("signal_type"), "member_bioguide_id", "ticker",
        F.to_timestamp("transaction_date").alias("created_at"))


SIG = {
    "old_signals": """SELECT CASE WHEN trade_id % 35 = 0 THEN 'insider_cluster'
          ELSE ['trade_follow','anomaly_alert','sentiment_divergence'][trade_id % 3 + 1] END AS signal_type,
        member_bioguide_id, ticker, CAST(transaction_date AS TIMESTAMP) AS created_at FROM trades
        WHERE trade_id % 5 = 0 AND ticker IS NOT NULL""",
    "recent_old": f"SELECT * FROM old_signals WHERE created_at BETWEEN TIMESTAMP '{SIGNAL_DAY}' - INTERVAL 7 DAY AND TIMESTAMP '{SIGNAL_DAY}'",
    "mood": f"""SELECT member_bioguide_id, avg(sentiment_score) AS mood FROM (SELECT media_id, unnest(member_bioguide_ids) AS member_bioguide_id
          FROM media WHERE published_date BETWEEN DATE '2001-07-15' - 30 AND DATE '2001-07-15') m JOIN sentiment s ON s.media_id = m.media_id GROUP BY 1""",
    "week": "SELECT * FROM trades WHERE transaction_date BETWEEN DATE '2001-07-08' AND DATE '2001-07-15' AND ticker IS NOT NULL AND member_bioguide_id IS NOT NULL",
    "cand": f"""SELECT 'trade_follow' AS signal_type, t.member_bioguide_id, t.ticker,
          CASE WHEN predicted_label = 'profitable' THEN 'bullish' ELSE 'bearish' END AS direction, confidence,
          t.disclosure_date - t.transaction_date AS lag, 2 AS kinds, 0 AS cluster, prediction_id AS ord
        FROM predictions p JOIN trades t ON t.trade_id = p.trade_id WHERE prediction_type = 'profitability' AND confidence > 0.7::DOUBLE
          AND p.created_at BETWEEN TIMESTAMP '{SIGNAL_DAY}' - INTERVAL 7 DAY AND TIMESTAMP '{SIGNAL_DAY}'
        UNION ALL SELECT 'anomaly_alert', t.member_bioguide_id, t.ticker, 'neutral', confidence, NULL, 2, 0, prediction_id
        FROM predictions p JOIN trades t ON t.trade_id = p.trade_id WHERE prediction_type = 'anomaly' AND predicted_label = 'anomalous'
          AND p.created_at BETWEEN TIMESTAMP '{SIGNAL_DAY}' - INTERVAL 7 DAY AND TIMESTAMP '{SIGNAL_DAY}'
        UNION ALL SELECT 'sentiment_divergence', t.member_bioguide_id, t.ticker,
          CASE WHEN transaction_type = 'purchase' THEN 'bullish' ELSE 'bearish' END, least(abs(mood) * 2, 1), NULL, 2, 0, trade_id
        FROM week t JOIN mood m ON m.member_bioguide_id = t.member_bioguide_id
        WHERE (transaction_type = 'purchase' AND mood < -0.2::DOUBLE) OR (transaction_type <> 'purchase' AND mood > 0.2::DOUBLE)
        UNION ALL SELECT 'insider_cluster', NULL, ticker, CASE WHEN transaction_type = 'purchase' THEN 'bullish' ELSE 'bearish' END,
          least(n / 10.0::DOUBLE, 1), NULL, 1, n, ord FROM (
          SELECT ticker, transaction_type, count(DISTINCT member_bioguide_id) AS n,
            row_number() OVER (PARTITION BY ticker ORDER BY count(DISTINCT member_bioguide_id) DESC, transaction_type) AS ord
          FROM week GROUP BY 1, 2 HAVING count(DISTINCT member_bioguide_id) >= 3)""",
    "made": """SELECT *, round(least(CASE WHEN lag > 0 THEN (confidence + CASE WHEN lag < 7 THEN 0.1 ELSE 0 END::DOUBLE) * greatest(0.3::DOUBLE, 1 - lag / 45.0::DOUBLE)
            ELSE confidence + CASE WHEN lag < 7 THEN 0.1 ELSE 0 END::DOUBLE END + (kinds - 1) * 0.15::DOUBLE
            + CASE WHEN cluster >= 5 THEN 0.2 WHEN cluster >= 3 THEN 0.1 ELSE 0 END::DOUBLE, 1), 4) AS strength
        FROM (SELECT *, row_number() OVER (PARTITION BY signal_type, ticker, member_bioguide_id ORDER BY ord) AS rn FROM cand) c
        WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM recent_old o WHERE o.signal_type = c.signal_type AND o.ticker IS NOT DISTINCT FROM c.ticker
          AND (c.signal_type = 'insider_cluster' OR o.member_bioguide_id IS NOT DISTINCT FROM c.member_bioguide_id))""",
}
SIG_OUT = ["signal_type", "member_bioguide_id", "ticker", "direction", "strength", "confidence"]
SIG_SQL = f"""SELECT signal_type, member_bioguide_id, ticker, direction, {R('strength')} AS strength,
    {R('round(confidence, 4)')} AS confidence, {TS(f"TIMESTAMP '{SIGNAL_DAY}' + CASE signal_type WHEN 'trade_follow' THEN 7 WHEN 'anomaly_alert' THEN 21 WHEN 'sentiment_divergence' THEN 14 ELSE 10 END * INTERVAL 1 DAY")} AS expires_at FROM made"""


@query("n02_trade_follow", SIG_SQL + " WHERE signal_type = 'trade_follow'", SIG)
def _(t):
    return flat(sig.trade_follow(t.predictions, t.trades, _old_signals(t), _as_of()), *SIG_OUT, "expires_at")


@query("n03_anomaly_alerts", SIG_SQL + " WHERE signal_type = 'anomaly_alert'", SIG)
def _(t):
    return flat(sig.anomaly_alerts(t.predictions, t.trades, _old_signals(t), _as_of()), *SIG_OUT, "expires_at")


@query("n04_sentiment_divergence", SIG_SQL + " WHERE signal_type = 'sentiment_divergence'", SIG)
def _(t):
    return flat(sig.sentiment_divergence(t.trades, t.media, t.sentiment, _old_signals(t), _as_of()), *SIG_OUT, "expires_at")


@query("n05_insider_clusters", SIG_SQL.replace(" FROM made", ", cluster AS size, true AS named FROM made")
       + " WHERE signal_type = 'insider_cluster'", SIG)
def _(t):
    df = sig.insider_clusters(t.trades, _old_signals(t), _as_of())
    return flat(df.select(*SIG_OUT, "expires_at", F.col("evidence.cluster_size").alias("size"),
                          (F.size("evidence.members") == F.least("evidence.cluster_size", F.lit(10))).alias("named")))


@query("u03_generate_all", SIG_SQL, SIG)
def _(t):
    df = sig.generate_all(t.predictions, t.trades, t.media, t.sentiment, _old_signals(t), _as_of())
    return flat(df, *SIG_OUT, "expires_at")


@query("n06_suppress", f"""SELECT min(trade_id) AS trade_id, ticker, member_bioguide_id FROM trades t WHERE NOT EXISTS (
    SELECT 1 FROM recent_old o WHERE o.signal_type = 'trade_follow' AND o.ticker IS NOT DISTINCT FROM t.ticker
      AND o.member_bioguide_id IS NOT DISTINCT FROM t.member_bioguide_id) GROUP BY ticker, member_bioguide_id""", SIG)
def _(t):
    df = t.trades.select(F.lit("trade_follow").alias("signal_type"), "trade_id", "ticker", "member_bioguide_id")
    return sig.suppress(df, _old_signals(t), ["ticker", "member_bioguide_id"], _as_of(), ["trade_id"]).select(
        "trade_id", "ticker", "member_bioguide_id")


SCORE_VIEW = {"to_score": """SELECT signal_id, CASE WHEN signal_id % 3 = 0 THEN 'insider_cluster' ELSE 'trade_follow' END AS kind,
    strength + 0.0000123::DOUBLE AS conf, CAST(signal_id % 60 AS INTEGER) - 5 AS lag, 1 + (signal_id % 2 = 0)::INT + (signal_id % 5 = 0)::INT + (signal_id % 3 = 0)::INT AS kinds,
    CASE WHEN signal_id % 3 = 0 THEN signal_id % 8 END AS size FROM signals"""}


@query("n01_score_signals", f"""SELECT signal_id, {R('''round(least((conf + CASE WHEN lag < 7 THEN 0.1 ELSE 0 END::DOUBLE)
      * CASE WHEN lag > 0 THEN greatest(0.3::DOUBLE, 1 - lag / 45.0::DOUBLE) ELSE 1 END + greatest(kinds - 1, 0) * 0.15::DOUBLE
      + CASE WHEN size >= 5 THEN 0.2 WHEN size >= 3 THEN 0.1 ELSE 0 END::DOUBLE, 1), 4)''')} AS strength FROM to_score""", SCORE_VIEW)
def _(t):
    e = F.col("signal_id")
    df = t.signals.select(
        "signal_id", F.when(e % 3 == 0, "insider_cluster").otherwise("trade_follow").alias("signal_type"),
        (F.col("strength") + 0.0000123).alias("confidence"), (e % 60 - 5).cast("int").alias("disclosure_lag_days"),
        sig.evidence(trade_id=e, prediction_id=F.when(e % 2 == 0, e), anomaly_score=F.when(e % 5 == 0, 0.5),
                     cluster_size=F.when(e % 3 == 0, e % 8)).alias("evidence"))
    return flat(sig.score_signals(df), "signal_id", "strength")


# ---------------------------------------------------------------- alerts

MATCH = {"matches": """SELECT s.*, c.config_id, c.name AS config_name FROM signals s JOIN alert_configs c ON c.is_active
    AND (len(c.signal_types) = 0 OR list_contains(c.signal_types, s.signal_type)) AND s.strength >= c.min_strength
    AND (len(c.tickers) = 0 OR coalesce(list_contains(c.tickers, s.ticker), false))
    AND (len(c.members) = 0 OR coalesce(list_contains(c.members, s.member_bioguide_id), false)) WHERE s.is_active"""}


def _matches(t):
    return sig.match_alerts(t.signals.filter("is_active"), t.alert_configs)


@query("n07_match_alerts", "SELECT config_id, signal_id FROM matches", MATCH)
def _(t):
    return _matches(t).select("config_id", "signal_id")


@query("n08_rate_limit", """WITH RECURSIVE ordered AS (
      SELECT config_id, signal_id, created_at, row_number() OVER (PARTITION BY config_id ORDER BY created_at, signal_id) AS rn FROM matches),
    walk AS (
      SELECT config_id, signal_id, created_at, rn, [created_at] AS sent, true AS kept FROM ordered WHERE rn = 1
      UNION ALL
      SELECT o.config_id, o.signal_id, o.created_at, o.rn,
        CASE WHEN len(list_filter(w.sent, lambda x: x > o.created_at - INTERVAL 1 HOUR)) < 10
          THEN list_append(list_filter(w.sent, lambda x: x > o.created_at - INTERVAL 1 HOUR), o.created_at)
          ELSE list_filter(w.sent, lambda x: x > o.created_at - INTERVAL 1 HOUR) END,
        len(list_filter(w.sent, lambda x: x > o.created_at - INTERVAL 1 HOUR)) < 10
      FROM walk w JOIN ordered o ON o.config_id = w.config_id AND o.rn = w.rn + 1)
    SELECT config_id, signal_id FROM walk WHERE kept""", MATCH)
def _(t):
    return sig.rate_limit(_matches(t)).select("config_id", "signal_id")


@query("n09_alert_payloads", """SELECT config_id, signal_id, config_name, signal_type, ticker, direction FROM matches""", MATCH)
def _(t):
    df = sig.alert_payloads(_matches(t))
    field = lambda name: F.get_json_object("payload", f"$.{name}").alias(name)
    return df.select("config_id", "signal_id", "config_name", field("signal_type"), field("ticker"), field("direction"))


# ---------------------------------------------------------------- screener

NOW = "2024-01-25 00:00:00"  # signals before the 18th have expired


def _now():
    return F.lit(NOW).cast("timestamp")


def _fresh_predictions(t):
    """Predictions moved to the month before the signals."""
    shift = F.expr("make_dt_interval(datediff(date'2024-01-25', date'2001-08-01'))")
    return t.predictions.withColumn("created_at", F.col("created_at") + shift)


SHIFT = "CAST(DATE '2024-01-25' - DATE '2001-08-01' AS INTEGER) * INTERVAL 1 DAY"
SCREEN = {
    "live": f"""SELECT * FROM signals WHERE is_active AND direction = 'bullish' AND strength >= 0.3::DOUBLE AND ticker IS NOT NULL
        AND created_at <= TIMESTAMP '{NOW}' AND (expires_at IS NULL OR expires_at > TIMESTAMP '{NOW}')""",
    "scand": f"""SELECT ticker, avg(strength) AS avg_strength,
        max(least(greatest(1 - (epoch_us(TIMESTAMP '{NOW}') - epoch_us(created_at)) / 3.6e9 / 168.0::DOUBLE, 0), 1)) AS freshness,
        count(*) AS signal_count, least(count(*) / 5.0::DOUBLE, 1) AS count_bonus FROM live GROUP BY 1""",
    "sml": f"""SELECT t.ticker, coalesce(nullif(max(p.confidence), 0), 0.5::DOUBLE) AS ml_confidence FROM predictions p
        JOIN trades t ON t.trade_id = p.trade_id WHERE p.predicted_label IN ('buy', 'profitable') AND t.ticker IS NOT NULL
          AND p.created_at + {SHIFT} BETWEEN TIMESTAMP '{NOW}' - INTERVAL 30 DAY AND TIMESTAMP '{NOW}' GROUP BY 1""",
    "swin": """SELECT l.ticker, CASE WHEN count(*) < 5 THEN 0.5::DOUBLE ELSE count(*) FILTER (p.actual_return_5d > 0) / count(*) END AS best_win_rate
        FROM (SELECT DISTINCT ticker, member_bioguide_id FROM live WHERE member_bioguide_id IS NOT NULL) l
        JOIN trades t ON t.member_bioguide_id = l.member_bioguide_id JOIN predictions p ON p.trade_id = t.trade_id
        WHERE p.actual_return_5d IS NOT NULL GROUP BY 1""",
    "sscore": """SELECT c.*, coalesce(m.ml_confidence, 0.5::DOUBLE) AS ml, coalesce(w.best_win_rate, 0.5::DOUBLE) AS win,
        round(least(greatest(0.30::DOUBLE * avg_strength + 0.25::DOUBLE * coalesce(m.ml_confidence, 0.5::DOUBLE)
          + 0.20::DOUBLE * coalesce(w.best_win_rate, 0.5::DOUBLE) + 0.15::DOUBLE * freshness + 0.10::DOUBLE * count_bonus, 0), 1), 4) AS composite
        FROM scand c LEFT JOIN sml m ON m.ticker = c.ticker LEFT JOIN swin w ON w.ticker = c.ticker""",
    "slast": "SELECT ticker, arg_max(close, date) AS current_price FROM prices GROUP BY 1",
    "stop": """SELECT s.*, l.current_price, least(greatest(composite / sum(composite) OVER (), 0.10::DOUBLE), 0.40::DOUBLE) AS clamped
        FROM (SELECT * FROM sscore ORDER BY composite DESC, ticker LIMIT 5) s LEFT JOIN slast l ON l.ticker = s.ticker""",
    "sized": """SELECT *, clamped / sum(clamped) OVER () AS pct, round(3000.0::DOUBLE * (clamped / sum(clamped) OVER ()), 2) AS amount FROM stop""",
}


@query("n10_composite_score", f"SELECT ticker, {R('composite')} AS composite_score FROM sscore", SCREEN)
def _(t):
    return flat(screener.score_tickers(t.signals, _fresh_predictions(t), t.trades, _now()), "ticker", "composite_score")


@query("n11_freshness", f"SELECT ticker, {R('freshness')} AS freshness FROM scand", SCREEN)
def _(t):
    return flat(screener.freshness_score(screener.live_bullish(t.signals, _now()), _now()))


@query("n12_count_bonus", f"""SELECT signal_type, member_bioguide_id, {R('least(count(*) / 5.0::DOUBLE, 1)')} AS count_bonus
    FROM signals GROUP BY 1, 2""")
def _(t):
    return flat(t.signals.groupBy("signal_type", "member_bioguide_id").agg(X.count_bonus(F.count("*")).alias("count_bonus")))


@query("n13_allocate", f"""SELECT ticker, {R('least(greatest(composite / t, 0.10::DOUBLE), 0.40::DOUBLE) / w')} AS allocation_pct,
    {R('round(10000.0::DOUBLE * (least(greatest(composite / t, 0.10::DOUBLE), 0.40::DOUBLE) / w), 2)')} AS suggested_amount,
    CAST(CASE WHEN current_price > 0 THEN floor(round(10000.0::DOUBLE * (least(greatest(composite / t, 0.10::DOUBLE), 0.40::DOUBLE) / w), 2) / current_price)
         ELSE 0 END AS BIGINT) AS suggested_shares
    FROM (SELECT s.ticker, composite, l.current_price, sum(composite) OVER () AS t FROM sscore s LEFT JOIN slast l ON l.ticker = s.ticker)
    CROSS JOIN (SELECT sum(least(greatest(composite / t, 0.10::DOUBLE), 0.40::DOUBLE)) AS w FROM (
      SELECT composite, sum(composite) OVER () AS t FROM sscore))""", SCREEN)
def _(t):
    from ..operators.indicators import latest_close
    scored = screener.score_tickers(t.signals, _fresh_predictions(t), t.trades, _now()).join(
        latest_close(t.prices), "ticker", "left")
    return flat(screener.allocate(scored, 10000.0), "ticker", "allocation_pct", "suggested_amount", "suggested_shares")


@query("n14_candidates", f"""SELECT ticker, {R('avg_strength')} AS avg_strength, {R('freshness')} AS freshness, signal_count,
    {R('count_bonus')} AS count_bonus FROM scand""", SCREEN)
def _(t):
    return flat(screener.candidates(t.signals, _now()))


@query("n15_ml_confidence", f"SELECT ticker, {R('ml_confidence')} AS ml_confidence FROM sml", SCREEN)
def _(t):
    return flat(screener.ml_confidence(_fresh_predictions(t), t.trades, _now()))


@query("n16_signal_win_rate", f"SELECT ticker, {R('best_win_rate')} AS best_win_rate FROM swin", SCREEN)
def _(t):
    live = screener.live_bullish(t.signals, _now())
    return flat(screener.signal_win_rate(live, t.predictions, t.trades))


@query("n17_collect_evidence", """SELECT l.ticker, count(*) AS signal_count,
    coalesce(array_to_string(list_sort(list_distinct(list(member_bioguide_id) FILTER (member_bioguide_id IS NOT NULL))), ','), '') AS member_names,
    array_to_string(list_sort(list_distinct(list(signal_type))), ',') AS signal_types,
    arg_min(signal_type, signal_id) FILTER (strength = top) AS strongest_type
    FROM live l JOIN (SELECT ticker, max(strength) AS top FROM live GROUP BY 1) m ON m.ticker = l.ticker GROUP BY 1""", SCREEN)
def _(t):
    return flat(screener.collect_evidence(screener.live_bullish(t.signals, _now())),
                "ticker", "signal_count", "member_names", "signal_types", "strongest_type")


@query("k04_rank_recommendations", f"""SELECT ticker, {R('composite')} AS composite_score FROM sscore
    ORDER BY composite DESC, ticker LIMIT 5""", SCREEN)
def _(t):
    scored = screener.score_tickers(t.signals, _fresh_predictions(t), t.trades, _now())
    return flat(screener.rank_recommendations(scored, 5), "ticker", "composite_score")


def _recommend(t):
    return screener.recommend(t.signals, _fresh_predictions(t), t.trades, t.prices, _now())


@query("n18_recommend", f"""SELECT s.ticker, {R('composite')} AS composite_score, {R('pct')} AS allocation_pct, {R('amount')} AS suggested_amount,
    CAST(floor(amount / current_price) AS BIGINT) AS suggested_shares, {R('round(r.rsi_14, 2)')} AS rsi_14,
    {R('round(r.volatility_21d, 4)')} AS volatility_21d, {R('round(r.price_change_5d, 4)')} AS price_change_5d
    FROM sized s LEFT JOIN risk r ON r.ticker = s.ticker""", {**SCREEN, **RISK_VIEWS})
def _(t):
    return flat(_recommend(t), "ticker", "composite_score", "allocation_pct", "suggested_amount", "suggested_shares",
                "rsi_14", "volatility_21d", "price_change_5d")


@query("a26_screener_totals", f"""SELECT count(*) AS num_recommendations, {R('round(sum(amount), 2)')} AS total_investable,
    {R('round(3000 - sum(amount), 2)')} AS cash_remainder FROM sized""", SCREEN)
def _(t):
    return flat(stats.screener_totals(_recommend(t), 3000.0))
