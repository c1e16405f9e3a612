"""The property graph as node and edge tables, and its pattern queries.

nodes(type, id, name, ...); edges(src_type, src, rel, dst_type, dst, ...). Every
pattern is a chain of equi-joins of fixed depth on the edge table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import constants as K
from ..session import Scratch, durable

EDGE_COLUMNS = ["src_type", "src", "rel", "dst_type", "dst"]


def _edge(df: DataFrame, rel: tuple[str, str, str], src: Column, dst: Column, *extra: Column) -> DataFrame:
    return df.select(
        F.lit(rel[0]).alias("src_type"), src.alias("src"), F.lit(rel[1]).alias("rel"), F.lit(rel[2]).alias("dst_type"),
        dst.alias("dst"), *extra)


def _known(df: DataFrame, column: str, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(F.col(key).alias(column)), column, "left_semi")


def member_nodes(members: DataFrame) -> DataFrame:
    return members.select(
        F.lit("Member").alias("type"), F.col("bioguide_id").alias("id"), F.col("full_name").alias("name"), "chamber",
        "state", "party", "in_office", "nominate_dim1", "nominate_dim2")


def committee_nodes(committees: DataFrame) -> DataFrame:
    return committees.select(F.lit("Committee").alias("type"), F.col("system_code").alias("id"), "name", "chamber")


def sits_on(assignments: DataFrame, members: DataFrame, committees: DataFrame) -> DataFrame:
    """One edge per member and committee that both exist."""
    a = _known(assignments, "member_bioguide_id", members, "bioguide_id")
    a = _known(a, "committee_code", committees, "system_code")
    pairs = a.groupBy("member_bioguide_id", "committee_code").agg(
        F.max_by("role", F.struct("congress_number", "role")).alias("role"))
    return _edge(pairs, ("Member", "SITS_ON", "Committee"), F.col("member_bioguide_id"), F.col("committee_code"), F.col("role"))


def company_nodes(trades: DataFrame) -> DataFrame:
    """Companies of linked trades, named by their earliest trade."""
    linked = trades.filter("coalesce(ticker, '') <> '' and coalesce(member_bioguide_id, '') <> ''")
    return linked.groupBy(F.col("ticker").alias("id")).agg(
        F.min_by(F.coalesce("asset_name", "ticker"), "trade_id").alias("name")).select(
        F.lit("Company").alias("type"), "id", "name")


def traded(trades: DataFrame, members: DataFrame) -> DataFrame:
    """One edge per trade of a known member."""
    linked = trades.filter("coalesce(ticker, '') <> '' and coalesce(member_bioguide_id, '') <> ''")
    return _edge(
        _known(linked, "member_bioguide_id", members, "bioguide_id"), ("Member", "TRADED", "Company"),
        F.col("member_bioguide_id"), F.col("ticker"), F.col("trade_id"), F.col("transaction_type"),
        F.col("transaction_date"), F.col("amount_range_low"), F.col("amount_range_high"))


def bill_nodes(bills: DataFrame) -> DataFrame:
    return bills.select(F.lit("Bill").alias("type"), F.col("bill_id").alias("id"), F.substring("title", 1, 200).alias("name"))


def bill_edges(bills: DataFrame, cosponsors: DataFrame, members: DataFrame, committees: DataFrame) -> DataFrame:
    """SPONSORED, COSPONSORED and REFERRED_TO edges whose ends both exist."""
    sponsored = _edge(
        _known(bills.select("bill_id", F.col("sponsor_bioguide_id").alias("m")), "m", members, "bioguide_id"),
        ("Member", "SPONSORED", "Bill"), F.col("m"), F.col("bill_id"))
    co = _known(cosponsors.select("bill_id", F.col("member_bioguide_id").alias("m")), "m", members, "bioguide_id")
    co = _edge(_known(co, "bill_id", bills, "bill_id"), ("Member", "COSPONSORED", "Bill"), F.col("m"), F.col("bill_id"))
    referred = bills.select("bill_id", F.explode("committees.code").alias("c"))
    referred = _edge(_known(referred, "c", committees, "system_code"), ("Bill", "REFERRED_TO", "Committee"),
                     F.col("bill_id"), F.col("c"))
    return sponsored.unionByName(co).unionByName(referred).distinct()


def firm_nodes(registrants: DataFrame) -> DataFrame:
    return registrants.filter("senate_id is not null").select(
        F.lit("LobbyingFirm").alias("type"), F.col("senate_id").alias("id"), "name")


def lobby_edges(filings: DataFrame, clients: DataFrame, registrants: DataFrame, lobbyists: DataFrame) -> DataFrame:
    """LOBBIED_FOR with total amount, filings and last year; EMPLOYED_BY per lobbyist.

    Filings are summed per (firm, client) before the client's ticker is joined.
    """
    per_client = _known(filings, "registrant_id", registrants, "senate_id").groupBy("registrant_id", "client_id").agg(
        F.sum(F.coalesce("amount", F.lit(0.0))).alias("amount"), F.count("*").alias("n"), F.max("filing_year").alias("y"))
    named = clients.filter("coalesce(matched_ticker, '') <> ''").select("client_id", "matched_ticker")
    lobbied_for = per_client.join(named, "client_id").groupBy("registrant_id", "matched_ticker").agg(
        F.sum("amount").alias("amount"), F.sum("n").alias("filing_count"), F.max("y").alias("year"))
    lobbied_for = _edge(
        lobbied_for, ("LobbyingFirm", "LOBBIED_FOR", "Company"), F.col("registrant_id"), F.col("matched_ticker"),
        F.col("amount"), F.col("filing_count"), F.col("year"))
    employed = _known(lobbyists, "registrant_id", registrants, "senate_id").select("name", "registrant_id").distinct()
    employed = _edge(employed, ("Lobbyist", "EMPLOYED_BY", "LobbyingFirm"), F.col("name"), F.col("registrant_id"))
    return lobbied_for.unionByName(employed, allowMissingColumns=True)


def donated_to(contributions: DataFrame, committees: DataFrame, members: DataFrame) -> DataFrame:
    """Company to member: total amount and number of employee contributions."""
    per_committee = contributions.filter("matched_ticker is not null").groupBy("fec_committee_id", "matched_ticker").agg(
        F.sum(F.coalesce("amount", F.lit(0.0))).alias("amount"), F.count("*").alias("n"),
        F.min("contributor_employer").alias("employer"))
    owners = committees.filter("member_bioguide_id is not null").select("fec_committee_id", "member_bioguide_id")
    agg = per_committee.join(owners, "fec_committee_id").groupBy("matched_ticker", "member_bioguide_id").agg(
        F.sum("amount").alias("total_amount"), F.sum("n").alias("contribution_count"), F.min("employer").alias("employer_name"))
    return _edge(
        _known(agg, "member_bioguide_id", members, "bioguide_id"), ("Company", "DONATED_TO", "Member"),
        F.col("matched_ticker"), F.col("member_bioguide_id"), F.col("total_amount"), F.col("contribution_count"),
        F.col("employer_name"))


def influence_edges(lobbied: DataFrame, lobbyists: DataFrame, members: DataFrame) -> DataFrame:
    """LOBBIED (firm, member) and FORMERLY_AT (lobbyist, member) from given pairs."""
    pairs = _known(lobbied, "member_bioguide_id", members, "bioguide_id").select(
        "registrant_id", "member_bioguide_id").distinct()
    a = _edge(pairs, ("LobbyingFirm", "LOBBIED", "Member"), F.col("registrant_id"), F.col("member_bioguide_id"))
    staff = _known(lobbyists.filter("is_former_congress"), "former_member_id", members, "bioguide_id").select(
        "name", "former_member_id").distinct()
    return a.unionByName(_edge(staff, ("Lobbyist", "FORMERLY_AT", "Member"), F.col("name"), F.col("former_member_id")))


def hearing_edges(hearings: DataFrame, bills: DataFrame) -> DataFrame:
    """HEARING_ON (committee, bill) from the bills a hearing lists."""
    listed = hearings.filter("committee_code is not null").select("committee_code", F.explode("related_bills").alias("b"))
    ref = F.concat(F.lower("b.type"), F.col("b.number"), F.lit("-"), F.col("b.congress").cast("string"))
    pairs = _known(listed.select("committee_code", ref.alias("bill_id")), "bill_id", bills, "bill_id").distinct()
    return _edge(pairs, ("Committee", "HEARING_ON", "Bill"), F.col("committee_code"), F.col("bill_id"))


def build_graph(t, keep: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a set of domain tables; edges keep their attributes.

    ``keep`` stores a frame: with it the edges are written once, without their
    attributes, and neither the nodes nor later steps derive them again.
    """
    contributions = t.contributions.withColumn("amount", F.col("cents") / 100.0)
    edges = (
        sits_on(t.assignments, t.members, t.committees)
        .unionByName(traded(t.trades, t.members), allowMissingColumns=True)
        .unionByName(bill_edges(t.bills, t.cosponsors, t.members, t.committees), allowMissingColumns=True)
        .unionByName(lobby_edges(t.filings, t.clients, t.registrants, t.lobbyists), allowMissingColumns=True)
        .unionByName(influence_edges(t.lobbied, t.lobbyists, t.members), allowMissingColumns=True)
        .unionByName(donated_to(contributions, t.campaign_committees, t.members), allowMissingColumns=True))
    if keep:
        edges = keep(edges.select(*EDGE_COLUMNS))
    companies = company_nodes(t.trades)
    # companies that only lobbying or donations mention are nodes as well
    bare = edges.filter("src_type = 'Company'").select(F.col("src").alias("id")).union(
        edges.filter("dst_type = 'Company'").select("dst")).distinct().join(companies, "id", "left_anti")
    lobbyists = edges.filter("rel = 'EMPLOYED_BY'").select(F.col("src").alias("id")).distinct()
    typed = lambda df, kind: df.select(F.lit(kind).alias("type"), "id", F.col("id").alias("name"))
    nodes = (
        member_nodes(t.members).unionByName(committee_nodes(t.committees), allowMissingColumns=True)
        .unionByName(companies, allowMissingColumns=True).unionByName(typed(bare, "Company"), allowMissingColumns=True)
        .unionByName(bill_nodes(t.bills), allowMissingColumns=True)
        .unionByName(firm_nodes(t.registrants), allowMissingColumns=True)
        .unionByName(typed(lobbyists, "Lobbyist"), allowMissingColumns=True))
    return nodes, edges


# --- queries -----------------------------------------------------------------------


def node_key(kind: Column | str, node: Column | str) -> Column:
    kind = F.col(kind) if isinstance(kind, str) else kind
    node = F.col(node) if isinstance(node, str) else node
    return F.concat_ws(":", kind, node)


def both_ways(edges: DataFrame) -> DataFrame:
    """Distinct undirected steps (a, b, rel) between node keys."""
    a, b = node_key("src_type", "src"), node_key("dst_type", "dst")
    ends = F.array(F.struct(a.alias("a"), b.alias("b")), F.struct(b.alias("a"), a.alias("b")))
    return edges.select(F.explode(ends).alias("e"), "rel").select("e.a", "e.b", "rel").distinct()


def shortest_paths(edges: DataFrame, source: str, target: str, max_depth: int = 4, limit: int | None = 10) -> DataFrame:
    """All shortest undirected paths between two node keys, up to a depth.

    A level-by-level search: each round joins the frontier with the steps and
    drops nodes seen before, and stops at the first level that holds the target.
    Predecessor steps are kept per level and the paths are read backwards from
    the target, so only nodes that lie on a shortest path are expanded twice.
    """
    steps = durable(both_ways(edges))
    spark = edges.sparkSession
    frontier = spark.createDataFrame([(source,)], "a string")
    seen, levels = frontier.select("a"), []
    for _ in range(max_depth):
        moved = frontier.join(steps, "a").select("a", "rel", "b").distinct()
        fresh = durable(moved.join(seen.select(F.col("a").alias("b")), "b", "left_anti").select("a", "rel", "b"))
        levels.append(fresh)
        if fresh.filter(F.col("b") == target).limit(1).count():
            break
        frontier = fresh.select(F.col("b").alias("a")).distinct()
        seen = seen.union(frontier)
    else:
        levels = []
    path = spark.createDataFrame([(target,)], "head string").select(
        "head", F.array("head").alias("nodes"), F.array().cast("array<string>").alias("rels"))
    if not levels or source == target:
        path = path.filter("false")
    for level in reversed(levels):
        path = path.join(level, F.col("head") == F.col("b")).select(
            F.col("a").alias("head"), F.concat(F.array("a"), "nodes").alias("nodes"),
            F.concat(F.array("rel"), "rels").alias("rels"))
    out = path.select("nodes", "rels", F.size("rels").alias("length"))
    return out if limit is None else out.orderBy(
        "length", F.array_join("nodes", ">"), F.array_join("rels", ">")).limit(limit)


def neighbourhood(edges: DataFrame, source: str, depth: int = 2) -> tuple[DataFrame, DataFrame]:
    """(nodes with distance, edges among them) within a number of steps.

    The edges are written once; every step and the choice of the edges read that
    table. Only the nodes a step reaches are made distinct, not the edges.
    """
    edges = Scratch(edges.sparkSession, "neighbourhood").keep(edges)
    a, b = node_key("src_type", "src"), node_key("dst_type", "dst")
    steps = edges.select(a.alias("a"), b.alias("b")).union(edges.select(b, a))
    reached = edges.sparkSession.createDataFrame([(source, 0)], "a string, distance int")
    frontier = reached
    for d in range(1, depth + 1):
        moved = frontier.join(steps, "a").select(F.col("b").alias("a")).distinct()
        frontier = durable(moved.join(reached, "a", "left_anti").withColumn("distance", F.lit(d)))
        reached = reached.unionByName(frontier)
    keys = reached.select("a")
    inside = (
        edges.withColumn("_s", node_key("src_type", "src")).withColumn("_d", node_key("dst_type", "dst"))
        .join(keys.withColumnRenamed("a", "_s"), "_s", "left_semi")
        .join(keys.withColumnRenamed("a", "_d"), "_d", "left_semi").drop("_s", "_d"))
    return reached, inside


def _rel(edges: DataFrame, rel: str, src: str, dst: str, *extra: str) -> DataFrame:
    return edges.filter(F.col("rel") == rel).select(F.col("src").alias(src), F.col("dst").alias(dst), *extra)


FIRM_CHUNKS = 64  # a long list of firms is cut into as many rows


def suspicious_triangles(edges: DataFrame) -> DataFrame:
    """Trades in a company whose lobbying firm reaches the trading member.

    The firm lobbied the member, or employs someone who worked for the member.
    One person may tie many members to many firms. These pairs are never moved:
    members of the same people form a circle, a circle's firms are listed once
    per company, and a trade looks up the lists of its circle and company. Pairs
    that lobbying alone gives are as many as its edges and are joined as rows.
    """
    lobbied = _rel(edges, "LOBBIED", "firm", "member").distinct()
    staff = _rel(edges, "EMPLOYED_BY", "person", "firm").distinct()
    clients = _rel(edges, "LOBBIED_FOR", "firm", "ticker").distinct()
    trades = _rel(edges, "TRADED", "member", "ticker", "trade_id", "transaction_type", "transaction_date")
    circles = _rel(edges, "FORMERLY_AT", "person", "member").groupBy("member").agg(
        F.array_sort(F.collect_set("person")).alias("circle"))
    employers = circles.select("circle").distinct().select("circle", F.explode("circle").alias("person")).join(
        staff, "person").select("circle", "firm").distinct()
    listed = employers.join(clients, "firm").groupBy(
        "circle", "ticker", F.pmod(F.xxhash64("firm"), F.lit(FIRM_CHUNKS)).alias("_chunk")).agg(
        F.collect_list("firm").alias("_firms")).drop("_chunk")
    by_staff = trades.join(circles, "member").join(listed, ["circle", "ticker"]).select(
        *trades.columns, F.explode("_firms").alias("firm"))
    rest = lobbied.join(circles, "member", "left").join(employers, ["circle", "firm"], "left_anti").select("member", "firm")
    held = trades.select("member", "ticker").distinct()
    hits = rest.join(held, "member").join(clients, ["firm", "ticker"], "left_semi")
    return by_staff.unionByName(trades.join(hits, ["member", "ticker"]))


def _first(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The first n rows of each key; tasks keep only as many before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return df.withColumn("_r", rank).filter(F.col("_r") <= n).drop("_r")


def committee_overlap(edges: DataFrame, limit: int | None = 50) -> DataFrame:
    """Members trading a lobbied company while their committee has bills.

    Rows are distinct combinations of member, committee, bill, company, firm and
    trade type and date. With a limit the newest rows are returned without
    forming the product first: members, committees and companies are filtered
    by existence, and only the chosen trades are expanded.
    """
    seats = _rel(edges, "SITS_ON", "member", "committee").distinct()
    referred = _rel(edges, "REFERRED_TO", "bill", "committee").distinct()
    firms = _rel(edges, "LOBBIED_FOR", "firm", "ticker").distinct()
    trades = _rel(edges, "TRADED", "member", "ticker", "transaction_type", "transaction_date").distinct()
    busy = seats.join(referred.select("committee"), "committee", "left_semi")
    trades = trades.join(busy.select("member"), "member", "left_semi").join(firms.select("ticker"), "ticker", "left_semi")
    if limit is not None:
        # every kept trade yields at least one row, so this many trades suffice; a trade's rows are ordered by
        # committee, bill and firm, so no row past a committee's first bills or a company's first firms can be kept
        trades = trades.orderBy(F.desc("transaction_date"), "member", "ticker", "transaction_type").limit(limit)
        referred, firms = _first(referred, "committee", "bill", limit), _first(firms, "ticker", "firm", limit)
    out = trades.join(busy, "member").join(referred, "committee").join(firms, "ticker")
    if limit is not None:
        out = out.orderBy(
            F.desc("transaction_date"), "member", "ticker", "transaction_type", "committee", "bill", "firm").limit(limit)
    return out


def company_firms(edges: DataFrame) -> DataFrame:
    """Each company's lobbying firms, once: ticker and firm."""
    return _rel(edges, "LOBBIED_FOR", "firm", "ticker").select("ticker", "firm").distinct()


def connections(edges: DataFrame, members: Sequence[str] | None = None) -> DataFrame:
    """Per member: companies with trade counts, all lobbying links of these, donors among them.

    ``lobbying_connections`` holds per company its links, one ``ticker:firm`` for
    each of its firms in order, comma-joined. Members share companies: a company's
    links are put together once and looked up by the members, so the product of
    members and firms is never shuffled. It is written out in full all the same,
    member by member.
    """
    trades = _rel(edges, "TRADED", "member", "ticker")
    donors = _rel(edges, "DONATED_TO", "ticker", "member", "total_amount", "contribution_count")
    if members is not None:
        asked = F.col("member").isin(list(members))
        trades, donors = trades.filter(asked), donors.filter(asked)
    firms = company_firms(edges).groupBy("ticker").agg(
        F.count("*").alias("firms"), F.array_sort(F.collect_list("firm")).alias("names"))
    links = F.array_join(F.transform("names", lambda f: F.concat_ws(":", F.col("ticker"), f)), ",")
    shared = firms.select("ticker", links.alias("links")).groupBy().agg(
        F.map_from_entries(F.collect_list(F.struct("ticker", "links"))).alias("_links"))
    sized = trades.groupBy("member", "ticker").agg(F.count("*").alias("trade_count")).join(
        firms.select("ticker", "firms"), "ticker", "left").join(donors, ["member", "ticker"], "left")
    gift = F.when(F.col("contribution_count").isNotNull(), F.struct("ticker", "total_amount", "contribution_count"))
    lobbied = F.when(F.col("firms").isNotNull(), F.col("ticker"))
    out = sized.groupBy("member").agg(
        F.array_sort(F.collect_list(F.struct("ticker", "trade_count"))).alias("traded_companies"),
        F.array_sort(F.collect_list(gift)).alias("donation_connections"), F.array_sort(F.collect_list(lobbied)).alias("_lobbied"),
        F.count("*").alias("companies_traded"), F.coalesce(F.sum("firms"), F.lit(0)).alias("lobbying_link_count"),
        F.count("contribution_count").alias("donation_link_count"))
    return out.crossJoin(F.broadcast(shared)).withColumn("lobbying_connections", F.transform(
        "_lobbied", lambda c: F.struct(c.alias("ticker"), F.col("_links")[c].alias("links")))).drop("_lobbied", "_links")


def lobbying_connections(edges: DataFrame, members: Sequence[str]) -> DataFrame:
    """(member, ticker, firm) of the members asked for."""
    trades = _rel(edges, "TRADED", "member", "ticker").filter(F.col("member").isin(list(members))).distinct()
    return trades.join(company_firms(edges), "ticker").select("member", "ticker", "firm")


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Number of nodes per type and edges per relationship."""
    return nodes.groupBy(F.lit("node").alias("kind"), "type").agg(F.count("*").alias("n")).unionByName(
        edges.groupBy(F.lit("edge").alias("kind"), F.col("rel").alias("type")).agg(F.count("*").alias("n")))


# --- features ------------------------------------------------------------------------


def typed_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct edges of the declared types whose ends are nodes."""
    declared = F.lit(False)
    for s, r, d in K.EDGE_TYPES:
        declared = declared | ((F.col("src_type") == s) & (F.col("rel") == r) & (F.col("dst_type") == d))
    keys = nodes.select("type", "id").distinct()
    return (
        edges.select(*EDGE_COLUMNS).filter(declared).distinct()
        .join(keys.select(F.col("type").alias("src_type"), F.col("id").alias("src")), ["src_type", "src"], "left_semi")
        .join(keys.select(F.col("type").alias("dst_type"), F.col("id").alias("dst")), ["dst_type", "dst"], "left_semi"))


def node_features(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(type, id, features): one-hots and scores of members, degree of the rest."""
    ends = typed_edges(nodes, edges).select(F.explode(F.array(
        F.struct(F.col("src_type").alias("type"), F.col("src").alias("id")),
        F.struct(F.col("dst_type").alias("type"), F.col("dst").alias("id")))).alias("e"))
    degree = ends.groupBy("e.type", "e.id").agg(F.count("*").alias("degree"))
    one = lambda cond: F.coalesce(cond.cast("double"), F.lit(0.0))
    member = F.array(
        one(F.col("chamber") == "house"), one(F.col("chamber") == "senate"),
        one(F.col("party").isin("Democratic", "Democrat")), one(F.col("party") == "Republican"),
        one(F.col("party") == "Independent"), one(F.col("in_office")),
        F.coalesce("nominate_dim1", F.lit(0.0)), F.coalesce("nominate_dim2", F.lit(0.0)))
    rest = F.array(F.coalesce("degree", F.lit(0)).cast("double"))
    return nodes.join(degree, ["type", "id"], "left").select(
        "type", "id", F.when(F.col("type") == "Member", member).otherwise(rest).alias("features"))


def node_index(nodes: DataFrame) -> DataFrame:
    """(type, id, idx): dense 0-based numbers per type in id order.

    Nodes of a type are cut into hash buckets; numbers are ranks within a bucket
    on top of the bucket's start, so no task numbers a whole type.
    """
    keys = nodes.select("type", "id").distinct().withColumn("_b", F.pmod(F.xxhash64("id"), F.lit(256)))
    sizes = keys.groupBy("type", "_b").agg(F.count("*").alias("n"))
    start = F.coalesce(
        F.sum("n").over(Window.partitionBy("type").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("type", "_b", start.alias("_start"))
    rank = F.row_number().over(Window.partitionBy("type", "_b").orderBy("id")) - 1
    return keys.join(starts, ["type", "_b"]).select("type", "id", (F.col("_start") + rank).cast("long").alias("idx"))


def edge_index(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct typed edges with the dense numbers of their ends."""
    idx = node_index(nodes)
    side = lambda s: idx.select(
        F.col("type").alias(f"{s}_type"), F.col("id").alias(s), F.col("idx").alias(f"{s}_idx"))
    return typed_edges(nodes, edges).join(side("src"), ["src_type", "src"]).join(side("dst"), ["dst_type", "dst"])


def mean_aggregate(features: DataFrame, edges: DataFrame, hops: int = 1) -> DataFrame:
    """Mean of the sources' vectors per target and edge type, added up over types.

    ``features`` holds (type, id, features) of one length. Each place is a plain
    mean with map-side combine, one row an edge. A node keeps its own vector
    and adds the mean of each incoming edge type, once per hop.
    """
    pairs = edges.select(*EDGE_COLUMNS).distinct()
    nodes = features.select("type", "id")
    first = features.select(F.size("features")).first()
    each = lambda f: F.array(*[f(F.col("v")[i]) for i in range(first[0] if first else 0)]).cast("array<double>")
    current = features.select("type", "id", F.col("features").alias("v"))
    for _ in range(hops):
        src = current.select(F.col("type").alias("src_type"), F.col("id").alias("src"), "v")
        means = pairs.join(src, ["src_type", "src"]).groupBy(
            F.col("dst_type").alias("type"), F.col("dst").alias("id"), "src_type", "rel").agg(each(F.avg).alias("v"))
        means = means.select("type", "id", "v").join(nodes, ["type", "id"], "left_semi")
        current = current.unionByName(means).groupBy("type", "id").agg(each(F.sum).alias("v"))
    return current.select("type", "id", F.col("v").alias("features"))


def attach_embeddings(df: DataFrame, embeddings: DataFrame, dim: int) -> DataFrame:
    """Adds member_embedding and company_embedding; zeros when there is none.

    ``embeddings`` holds (type, id, embedding).
    """
    zeros = F.array_repeat(F.lit(0.0), dim)
    side = lambda kind, key, name: embeddings.filter(F.col("type") == kind).select(
        F.col("id").alias(key), F.col("embedding").cast("array<double>").alias(name))
    return (
        df.join(side("Member", "member_bioguide_id", "member_embedding"), "member_bioguide_id", "left")
        .join(side("Company", "ticker", "company_embedding"), "ticker", "left")
        .withColumn("member_embedding", F.coalesce("member_embedding", zeros))
        .withColumn("company_embedding", F.coalesce("company_embedding", zeros)))


def edge_split(edges: DataFrame, train_share: float = 0.8, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Distinct TRADED pairs split by a seeded hash into train and held-out."""
    pairs = _rel(edges, "TRADED", "member", "ticker").groupBy("member", "ticker").agg(F.count("*").alias("weight"))
    lot = F.pmod(F.xxhash64("member", "ticker", F.lit(seed)), F.lit(10000)) < int(train_share * 10000)
    return pairs.filter(lot), pairs.filter(~lot)


def train_embeddings(edges: DataFrame, nodes: DataFrame, dim: int = 64, seed: int = 42, iterations: int = 10):
    """(embeddings, held-out AUC): implicit matrix factorisation of member × company.

    Held-out pairs are ranked against as many seeded random pairs.
    """
    from pyspark.ml.recommendation import ALS

    from .metrics import auc

    idx = durable(node_index(nodes.filter(F.col("type").isin("Member", "Company"))))
    members = idx.filter("type = 'Member'").select(F.col("id").alias("member"), F.col("idx").cast("int").alias("m"))
    companies = idx.filter("type = 'Company'").select(F.col("id").alias("ticker"), F.col("idx").cast("int").alias("c"))
    number = lambda df: df.join(members, "member").join(companies, "ticker").select("m", "c", "weight")
    train, held = (durable(number(part)) for part in edge_split(edges, seed=seed))
    als = ALS(
        rank=dim, maxIter=iterations, implicitPrefs=True, userCol="m", itemCol="c", ratingCol="weight", seed=seed)
    model = als.fit(train)
    vectors = lambda kind, factors, key, column: factors.join(
        key, F.col("id") == F.col(column)).select(F.lit(kind).alias("type"), F.col(key.columns[0]).alias("key"), "features")
    embeddings = vectors("Member", model.userFactors, members, "m").unionByName(
        vectors("Company", model.itemFactors, companies, "c")).select(
        "type", F.col("key").alias("id"), F.col("features").alias("embedding"))
    n_m, n_c = members.count(), companies.count()
    draw = lambda salt, n: F.pmod(F.xxhash64("m", "c", F.lit(seed + salt)), F.lit(n)).cast("int")
    negative = held.select(draw(1, n_m).alias("m"), draw(2, n_c).alias("c"), F.lit(0).alias("y_true"))
    positive = held.select("m", "c", F.lit(1).alias("y_true"))
    uf = model.userFactors.select(F.col("id").alias("m"), F.col("features").alias("u"))
    vf = model.itemFactors.select(F.col("id").alias("c"), F.col("features").alias("v"))
    dot = F.aggregate(F.zip_with("u", "v", lambda a, b: (a * b).cast("double")), F.lit(0.0), lambda s, x: s + x)
    scored = positive.unionByName(negative).join(uf, "m", "left").join(vf, "c", "left").select(
        "y_true", F.coalesce(dot, F.lit(0.0)).alias("y_proba"))
    return embeddings, auc(durable(scored))
