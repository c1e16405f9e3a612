"""As-of, range and context joins, price windows and histories."""

from __future__ import annotations



from pyspark.sql import functions as F

from .. import constants as K
from ..functions import features as X
from ..operators import asof, dayrange, history, indicators
from .registry import R, S, flat, query
from .views import BENCH_TICKER, Tables

NUMBERED = {
    "numbered": "SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS rn FROM prices",
    "based": """SELECT t.*, n.adj_close AS base_price, n.date AS base_date, coalesce(n.rn, 0) AS rn
        FROM trades t ASOF LEFT JOIN numbered n ON t.ticker = n.ticker AND t.transaction_date >= n.date""",
}


def keyword_table(t: Tables):
    rows = [(p, w) for p, words in K.COMMITTEE_KEYWORDS.items() for w in words] + OWN_KEYWORDS
    return t.spark.createDataFrame(rows, "prefix string, keyword string")


# words that do occur in the driver's part names
OWN_KEYWORDS = [("HSAG", "ring"), ("HSBA", "gear"), ("HSED", "widget"), ("SSAF", "rod"), ("HSHM", "anvil")]
KEYWORDS_VIEW = {
    "keywords": "SELECT * FROM (VALUES " + ",".join(
        f"('{p}','{w}')" for p, w in
        [(p, w) for p, words in K.COMMITTEE_KEYWORDS.items() for w in words] + OWN_KEYWORDS
    ) + ") k(prefix, keyword)"
}


@query("j01_asof_price", f"""SELECT trade_id, ticker, {S('transaction_date')} AS transaction_date,
    {R('base_price')} AS base_price, {S('base_date')} AS base_date FROM based""", NUMBERED)
def _(t):
    return flat(asof.asof_price(t.trades, t.prices), "trade_id", "ticker", "transaction_date", "base_price", "base_date")


def _nth(k: int) -> str:
    return f"""SELECT b.trade_id, {R('b.base_price')} AS base_price, {R('f.adj_close')} AS price_future,
        {S('f.date')} AS future_date FROM based b
        LEFT JOIN numbered f ON b.ticker = f.ticker AND f.rn = b.rn + {k + 1}"""


for _h, _k in K.HORIZON_ROWS.items():
    @query(f"j02_nth_price_after_{_h}", _nth(_k), NUMBERED)
    def _(t, k=_k):
        return flat(asof.nth_price_after(t.trades, t.prices, k), "trade_id", "base_price", "price_future", "future_date")


def _capped(n: int) -> str:
    cap = int(n * 1.5)
    return f"""SELECT b.trade_id, {R(f'''CASE WHEN b.base_price <> 0 THEN
        (CASE WHEN f.date <= b.transaction_date + {cap} THEN f.adj_close
              WHEN c.date > b.transaction_date THEN c.adj_close END - b.base_price) / b.base_price END''')}
        AS actual_return_{n}d FROM based b
        LEFT JOIN numbered f ON b.ticker = f.ticker AND f.rn = b.rn + {n}
        ASOF LEFT JOIN prices c ON b.ticker = c.ticker AND b.transaction_date + {cap} >= c.date"""


for _n in (5, 21):
    @query(f"j03_forward_return_capped_{_n}d", _capped(_n), NUMBERED)
    def _(t, n=_n):
        return flat(asof.forward_return_capped(t.trades, t.prices, n), "trade_id", f"actual_return_{n}d")


@query("j04_backfill_returns", f"""SELECT p.prediction_id,
    {R('''coalesce(p.actual_return_5d, CASE WHEN b.base_price <> 0 AND f.date <= b.transaction_date + 8
          THEN (f.adj_close - b.base_price) / b.base_price END)''')} AS actual_return_5d,
    {R('''CASE WHEN p.actual_return_5d IS NULL AND b.base_price <> 0 AND g.date <= b.transaction_date + 32
          THEN (g.adj_close - b.base_price) / b.base_price END''')} AS actual_return_21d
    FROM predictions p LEFT JOIN based b ON p.trade_id = b.trade_id
    LEFT JOIN numbered f ON b.ticker = f.ticker AND f.rn = b.rn + 5
    LEFT JOIN numbered g ON b.ticker = g.ticker AND g.rn = b.rn + 21""", NUMBERED)
def _(t):
    p = t.predictions.withColumn("actual_return_21d", F.lit(None).cast("double"))
    return flat(asof.backfill_returns(p, t.trades, t.prices), "prediction_id", "actual_return_5d", "actual_return_21d")


HEARING_SQL = """SELECT t.trade_id, count(DISTINCT h.hearing_id) AS hearing_count,
    CAST(min(abs(t.transaction_date - h.hearing_date)) AS BIGINT) AS min_hearing_dist,
    count(DISTINCT h.hearing_id) FILTER (h.hearing_date BETWEEN t.transaction_date - 7 AND t.transaction_date - 1) AS before_7d,
    count(DISTINCT h.hearing_id) FILTER (h.hearing_date BETWEEN t.transaction_date + 1 AND t.transaction_date + 7) AS after_7d,
    count(DISTINCT h.hearing_id) FILTER (h.hearing_date BETWEEN t.transaction_date - 3 AND t.transaction_date - 1) AS before_3d
    FROM trades t JOIN assignments ca ON ca.member_bioguide_id = t.member_bioguide_id
    JOIN hearings h ON h.committee_code = ca.committee_code
      AND h.hearing_date BETWEEN t.transaction_date - 30 AND t.transaction_date + 30
    GROUP BY t.trade_id"""
SPONSOR_SQL = """SELECT t.trade_id, count(DISTINCT b.bill_id) AS sponsored_count,
    CAST(min(abs(t.transaction_date - coalesce(b.introduced_date, b.latest_action_date))) AS BIGINT) AS min_sponsored_dist
    FROM trades t JOIN bills b ON b.sponsor_bioguide_id = t.member_bioguide_id
     AND coalesce(b.introduced_date, b.latest_action_date) BETWEEN t.transaction_date - 90 AND t.transaction_date + 90
    GROUP BY t.trade_id"""
NEARBY_SQL = """SELECT t.trade_id, s.bill_count, s.min_bill_dist FROM trades t JOIN (
      SELECT d.day, CAST(sum(n) AS BIGINT) AS bill_count, CAST(min(abs(d.day - b.day)) AS BIGINT) AS min_bill_dist
      FROM (SELECT DISTINCT transaction_date AS day FROM trades) d
      JOIN (SELECT coalesce(introduced_date, latest_action_date) AS day, count(*) AS n FROM bills GROUP BY 1) b
        ON b.day BETWEEN d.day - 90 AND d.day + 90 GROUP BY d.day) s ON s.day = t.transaction_date"""


@query("j05_hearing_proximity", HEARING_SQL)
def _(t):
    return dayrange.hearing_proximity(t.trades, t.assignments, t.hearings).withColumn(
        "min_hearing_dist", F.col("min_hearing_dist").cast("long"))


@query("j05_hearing_proximity_same_congress", HEARING_SQL.replace(
    "GROUP BY", "WHERE ca.congress_number = (year(t.transaction_date) - 1789) // 2 + 1 + 12 GROUP BY"))
def _(t):
    # the driver's dates fall 12 sessions before the congress numbers of the view
    seats = t.assignments.withColumn("congress_number", F.col("congress_number") - 12)
    return dayrange.hearing_proximity(t.trades, seats, t.hearings, same_congress=True).withColumn(
        "min_hearing_dist", F.col("min_hearing_dist").cast("long"))


@query("j06_sponsored_bills", SPONSOR_SQL)
def _(t):
    return dayrange.sponsored_bills(t.trades, t.bills).withColumn(
        "min_sponsored_dist", F.col("min_sponsored_dist").cast("long"))


@query("j07_nearby_bills", NEARBY_SQL)
def _(t):
    return dayrange.nearby_bills(t.trades, t.bills).withColumn("min_bill_dist", F.col("min_bill_dist").cast("long"))


LEG_VIEWS = {
    "hp": HEARING_SQL, "sb": SPONSOR_SQL, "nb": NEARBY_SQL,
    "leg": """SELECT t.*, CAST(coalesce(min_hearing_dist, 999) AS DOUBLE) AS min_hearing_distance,
        CAST(coalesce(min_sponsored_dist, min_bill_dist, 999) AS DOUBLE) AS min_bill_distance,
        CASE WHEN sponsored_count IS NOT NULL OR bill_count IS NOT NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS has_related_bill,
        CAST(coalesce(hearing_count, 0) AS DOUBLE) AS nearby_hearing_count,
        CAST(coalesce(bill_count, 0) AS DOUBLE) AS nearby_bill_count,
        CAST(coalesce(sponsored_count, 0) AS DOUBLE) AS sponsored_bill_near_trade,
        CAST(coalesce(before_7d, 0) AS DOUBLE) AS hearings_before_7d,
        CAST(coalesce(after_7d, 0) AS DOUBLE) AS hearings_after_7d,
        CAST(coalesce(before_3d, 0) AS DOUBLE) AS hearings_before_3d,
        CASE WHEN disclosure_date IS NULL THEN 30.0
             ELSE greatest(disclosure_date - transaction_date, 0) END::DOUBLE AS disclosure_lag_days
        FROM trades t LEFT JOIN hp ON t.trade_id = hp.trade_id LEFT JOIN sb ON t.trade_id = sb.trade_id
        LEFT JOIN nb ON t.trade_id = nb.trade_id""",
}
LEG_COLUMNS = [
    "min_hearing_distance", "min_bill_distance", "has_related_bill", "nearby_hearing_count", "nearby_bill_count",
    "sponsored_bill_near_trade", "hearings_before_7d", "hearings_after_7d", "hearings_before_3d"]


def _leg(t):
    return dayrange.legislative_features(t.trades, t.assignments, t.hearings, t.bills)


@query("j08_legislative_features", f"SELECT trade_id, {', '.join(LEG_COLUMNS)} FROM leg", LEG_VIEWS)
def _(t):
    return flat(_leg(t), "trade_id", *LEG_COLUMNS)


TIMING_SQL = """least(greatest(
    least(greatest(1 - least(greatest(min_hearing_distance,0),30)/30.0::DOUBLE,0),1)*0.35::DOUBLE
    + least(greatest(1 - least(greatest(min_bill_distance,0),90)/90.0::DOUBLE,0),1)*0.25::DOUBLE
    + least(greatest(disclosure_lag_days,0),90)/90.0::DOUBLE*0.25::DOUBLE
    + CASE WHEN sponsored_bill_near_trade > 0 THEN 0.15::DOUBLE ELSE 0 END, 0), 1)"""


@query("f08_timing_score", f"SELECT trade_id, {R(TIMING_SQL)} AS timing_suspicion_score FROM leg", LEG_VIEWS)
def _(t):
    df = _leg(t).withColumn("disclosure_lag_days", X.disclosure_lag()).withColumn(
        "timing_suspicion_score", X.timing_score())
    return flat(df, "trade_id", "timing_suspicion_score")


CONTEXT_VIEWS = {
    **KEYWORDS_VIEW,
    "ctx_h": """SELECT trade_id, string_agg(hearing_id || ':' || dist || ':' || CASE WHEN dist < 0 THEN 'b' ELSE 'a' END,
          ',' ORDER BY hearing_date, hearing_id) AS hearings_text, CAST(min(abs(dist)) AS BIGINT) AS min_h
        FROM (SELECT DISTINCT t.trade_id, h.hearing_id, h.hearing_date, h.hearing_date - t.transaction_date AS dist
              FROM trades t JOIN assignments ca ON ca.member_bioguide_id = t.member_bioguide_id
              JOIN hearings h ON h.committee_code = ca.committee_code
                AND h.hearing_date BETWEEN t.transaction_date - 30 AND t.transaction_date + 30) GROUP BY 1""",
    "ctx_b": """SELECT trade_id, CAST(count(*) AS BIGINT) AS n_bills, CAST(min(abs(dist)) AS BIGINT) AS min_b,
          bool_or(is_sponsor) AS has_sponsored,
          CAST(sum(dist) AS BIGINT) AS sum_dist, min(bill_id) AS min_bill_id
        FROM (SELECT DISTINCT t.trade_id, b.bill_id, b.introduced_date - t.transaction_date AS dist,
                coalesce(b.sponsor_bioguide_id = t.member_bioguide_id, false) AS is_sponsor
              FROM trades t JOIN (SELECT DISTINCT member_bioguide_id, left(committee_code, 4) AS prefix FROM assignments) ca
                ON ca.member_bioguide_id = t.member_bioguide_id
              JOIN (SELECT DISTINCT bill_id, left(code, 4) AS prefix FROM bill_committees) bc ON bc.prefix = ca.prefix
              JOIN bills b ON b.bill_id = bc.bill_id
                AND b.introduced_date BETWEEN t.transaction_date - 90 AND t.transaction_date + 90) GROUP BY 1""",
    "ctx_v": """SELECT trade_id, string_agg(vote_date || ':' || position || ':' || question || ':' || result,
          ',' ORDER BY vote_date, position, question, result) AS votes_text
        FROM trades t JOIN votes v ON v.member_bioguide_id = t.member_bioguide_id
          AND v.vote_date BETWEEN t.transaction_date - 7 AND t.transaction_date + 7 GROUP BY 1""",
    "ctx_s": """SELECT trade_id, string_agg(committee_code, ',' ORDER BY committee_code) AS aligned
        FROM (SELECT DISTINCT t.trade_id, ca.committee_code FROM trades t
              JOIN assignments ca ON ca.member_bioguide_id = t.member_bioguide_id
              JOIN keywords k ON k.prefix = upper(left(ca.committee_code, 4))
                AND contains(lower(t.asset_name), k.keyword) WHERE t.ticker IS NOT NULL) GROUP BY 1""",
    "ctx": """SELECT t.trade_id, t.disclosure_date - t.transaction_date AS lag, min_h, min_b, n_bills,
          coalesce(has_sponsored, false) AS has_sponsored, hearings_text, votes_text, coalesce(aligned, '') AS aligned,
          s.member_bioguide_id IS NOT NULL AS seated, sum_dist, min_bill_id
        FROM trades t LEFT JOIN ctx_h ON t.trade_id = ctx_h.trade_id LEFT JOIN ctx_b ON t.trade_id = ctx_b.trade_id
        LEFT JOIN ctx_v ON t.trade_id = ctx_v.trade_id LEFT JOIN ctx_s ON t.trade_id = ctx_s.trade_id
        LEFT JOIN (SELECT DISTINCT member_bioguide_id FROM assignments) s
          ON s.member_bioguide_id = t.member_bioguide_id""",
}


def hearings_text():
    return F.array_join(F.transform("nearby_hearings", lambda h: F.concat_ws(
        ":", h["hearing_id"].cast("string"), h["distance_days"].cast("string"),
        F.when(h["before_trade"], "b").otherwise("a"))), ",")


def votes_text():
    return F.array_join(F.transform("nearby_votes", lambda v: F.concat_ws(
        ":", v["date"].cast("string"), v["position"], v["question"], v["result"])), ",")


@query("j09_context_hearings",
       "SELECT trade_id, hearings_text, CAST(min_h AS DOUBLE) AS min_hearing_distance_days FROM ctx", CONTEXT_VIEWS)
def _(t):
    df = dayrange.context_hearings(t.trades, t.assignments, t.hearings, 30)
    return df.select("trade_id", hearings_text().alias("hearings_text"),
                     F.col("min_hearing_distance_days").cast("double").alias("min_hearing_distance_days"))


BILL_FIGURES = {
    "n_bills": lambda: F.col("n_bills").cast("double"),
    "min_b": lambda: F.col("min_bill_distance_days").cast("double"),
    "sum_dist": lambda: F.col("sum_distance_days").cast("double"),
    "min_bill_id": lambda: F.col("first_bill_id"),
    "has_sponsored": lambda: F.coalesce("has_sponsored_bill", F.lit(False)),
}


@query("j10_context_bills",
       """SELECT trade_id, n_bills::DOUBLE AS n_bills, min_b::DOUBLE AS min_b, sum_dist::DOUBLE AS sum_dist,
       min_bill_id, has_sponsored FROM ctx""", CONTEXT_VIEWS)
def _(t):
    df = dayrange.context_bills(t.trades, t.assignments, t.bills, 90)
    return df.select("trade_id", *[c().alias(n) for n, c in BILL_FIGURES.items()])


@query("j11_context_votes", "SELECT trade_id, votes_text FROM ctx", CONTEXT_VIEWS)
def _(t):
    return dayrange.context_votes(t.trades, t.votes).select("trade_id", votes_text().alias("votes_text"))


SUSPICION_SQL = """CASE WHEN NOT seated THEN 0 ELSE least(
    CASE WHEN min_h <= 3 THEN 0.3 WHEN min_h <= 7 THEN 0.2 WHEN min_h <= 14 THEN 0.1 ELSE 0 END::DOUBLE
    + CASE WHEN min_b <= 7 THEN 0.2 WHEN min_b <= 30 THEN 0.1 ELSE 0 END::DOUBLE
    + CASE WHEN aligned <> '' THEN 0.2 ELSE 0 END::DOUBLE
    + CASE WHEN lag > 40 THEN 0.15 WHEN lag > 30 THEN 0.05 ELSE 0 END::DOUBLE
    + CASE WHEN has_sponsored THEN 0.15 ELSE 0 END::DOUBLE, 1) END"""


def _context(t):
    return dayrange.legislative_context(
        t.trades, t.assignments, t.hearings, t.bills, t.votes, keyword_table(t))


@query("j12_legislative_context", f"""SELECT trade_id, CAST(lag AS DOUBLE) AS disclosure_lag_days, hearings_text,
    min_h::DOUBLE AS min_h, n_bills::DOUBLE AS n_bills, min_b::DOUBLE AS min_b, has_sponsored, votes_text, aligned, {R(SUSPICION_SQL)} AS timing_suspicion_score
    FROM ctx""", {**CONTEXT_VIEWS})
def _(t):
    return _context(t).select(
        "trade_id", F.col("disclosure_lag_days").cast("double").alias("disclosure_lag_days"),
        hearings_text().alias("hearings_text"), F.col("min_hearing_distance_days").cast("double").alias("min_h"),
        BILL_FIGURES["n_bills"]().alias("n_bills"), BILL_FIGURES["min_b"]().alias("min_b"),
        BILL_FIGURES["has_sponsored"]().alias("has_sponsored"), votes_text().alias("votes_text"),
        F.array_join("aligned_committees", ",").alias("aligned"),
        F.round(F.col("timing_suspicion_score") + 1e-9, 6).alias("timing_suspicion_score"))


@query("f17_sector_alignment", """SELECT trade_id, aligned AS aligned_committees, aligned <> '' AS committee_sector_alignment
    FROM ctx""", CONTEXT_VIEWS)
def _(t):
    return flat(dayrange.sector_alignment(t.trades, t.assignments, keyword_table(t)),
                "trade_id", "aligned_committees", "committee_sector_alignment")


@query("f18_suspicion_score", f"SELECT trade_id, {R(SUSPICION_SQL)} AS timing_suspicion_score FROM ctx", CONTEXT_VIEWS)
def _(t):
    return flat(_context(t), "trade_id", "timing_suspicion_score")


@query("j13_committee_trades", f"""SELECT t.trade_id, t.member_bioguide_id, t.ticker, ca.role, ca.committee_name,
    {S('t.transaction_date')} AS transaction_date FROM trades t JOIN assignments ca
    ON t.member_bioguide_id = ca.member_bioguide_id AND ca.committee_code = 'hsba00'""")
def _(t):
    from .read_api import committee_trades
    return flat(committee_trades(t.trades, t.assignments, "hsba00"), "trade_id", "member_bioguide_id", "ticker",
                "role", "committee_name", "transaction_date")


@query("j14_trade_member", f"""SELECT t.trade_id, m.party, m.chamber AS member_chamber, t.chamber AS trade_chamber,
    {R("m.nominate_dim1")} AS nominate_dim1, CAST(m.first_elected AS DOUBLE) AS first_elected FROM trades t
    LEFT JOIN members m ON t.member_bioguide_id = m.bioguide_id""")
def _(t):
    from .dataset import trade_member
    df = trade_member(t.trades, t.members).withColumn("first_elected", F.col("first_elected").cast("double"))
    return flat(df, "trade_id", "party", "member_chamber", "trade_chamber",
                "nominate_dim1", "first_elected")


# ------------------------------------------------------------------ windows

IND_VIEWS = {
    "px": """SELECT ticker, date, adj_close AS price, volume::DOUBLE AS volume,
        adj_close - lag(adj_close) OVER w AS chg,
        (adj_close - lag(adj_close) OVER w) / lag(adj_close) OVER w AS ret
        FROM prices WINDOW w AS (PARTITION BY ticker ORDER BY date)""",
    "ind": """SELECT ticker, date, price,
        CASE WHEN count(*) OVER f2 < 2 THEN 0 ELSE (price - coalesce(lag(price,5) OVER w, first_value(price) OVER f30))
             / coalesce(lag(price,5) OVER w, first_value(price) OVER f30) END AS price_change_5d,
        CASE WHEN count(*) OVER f2 < 2 THEN 0 ELSE (price - coalesce(lag(price,21) OVER w, first_value(price) OVER f30))
             / coalesce(lag(price,21) OVER w, first_value(price) OVER f30) END AS price_change_21d,
        CASE WHEN count(ret) OVER f21 >= 2 THEN stddev_samp(ret) OVER f21 ELSE 0 END AS volatility_21d,
        CASE WHEN count(*) OVER f2 < 2 THEN 0 ELSE avg(volume) OVER f5 / avg(volume) OVER f21 END AS volume_ratio_5d,
        CASE WHEN count(*) OVER f2 < 2 THEN 50 WHEN sum(CASE WHEN chg < 0 THEN -chg ELSE 0 END) OVER f14 = 0 THEN 100
             ELSE 100 - 100 / (1 + sum(CASE WHEN chg > 0 THEN chg ELSE 0 END) OVER f14
                                   / sum(CASE WHEN chg < 0 THEN -chg ELSE 0 END) OVER f14) END AS rsi_14,
        CASE WHEN count(*) OVER f260 >= 26 THEN
             list_reduce(list(price) OVER f260, lambda a, p: a * (1 - 2.0::DOUBLE/13) + p * (2.0::DOUBLE/13))
           - list_reduce(list(price) OVER f260, lambda a, p: a * (1 - 2.0::DOUBLE/27) + p * (2.0::DOUBLE/27))
             ELSE 0 END AS macd_signal,
        list_reduce(list(price) OVER f260, lambda a, p: a * (1 - 2.0::DOUBLE/13) + p * (2.0::DOUBLE/13)) AS ema_12,
        CASE WHEN count(*) OVER f26 >= 26 AND stddev_samp(price) OVER f20 > 0 THEN
             (price - (avg(price) OVER f20 - 2 * stddev_samp(price) OVER f20)) / (4 * stddev_samp(price) OVER f20)
             ELSE 0.5 END AS bollinger_position,
        CASE WHEN count(*) OVER f200 < 200 THEN 0 WHEN avg(price) OVER f50 > avg(price) OVER f200 THEN 1 ELSE -1 END
             AS ma_cross_50_200,
        CASE WHEN count(*) OVER f200 >= 200 AND max(price) OVER f252 > min(price) OVER f252 THEN
             (price - min(price) OVER f252) / (max(price) OVER f252 - min(price) OVER f252) ELSE 0.5 END
             AS high_52w_position
        FROM px WINDOW w AS (PARTITION BY ticker ORDER BY date),
        """ + ",\n".join(
        f"f{n} AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        for n in (2, 5, 14, 20, 21, 26, 30, 50, 200, 252, 260)),
}


def _ind(id_, *names):
    @query(id_, f"SELECT ticker, {S('date')} AS date, {', '.join(f'{R(n)} AS {n}' for n in names)} FROM ind", IND_VIEWS)
    def _(t):
        return flat(indicators.indicators(t.prices, names))


_ind("w01_price_change", "price_change_5d", "price_change_21d")
_ind("w02_volatility", "volatility_21d")
_ind("w03_volume_ratio", "volume_ratio_5d")
_ind("w04_rsi", "rsi_14")
_ind("w06_macd", "macd_signal")
_ind("w07_bollinger", "bollinger_position")
_ind("w08_ma_cross", "ma_cross_50_200")
_ind("w09_range_position", "high_52w_position")


@query("w05_ema", f"SELECT ticker, {S('date')} AS date, {R('ema_12')} AS ema_12 FROM ind", IND_VIEWS)
def _(t):
    return flat(indicators.with_ema(indicators.prepare(t.prices), 12), "ticker", "date", "ema_12")


ATTACHED = f"""SELECT t.trade_id, {', '.join(
    f'{R(f"coalesce(i.{n}, {d})")} AS {n}' for n, d in indicators.DEFAULTS.items())}
    FROM trades t ASOF LEFT JOIN ind i ON t.ticker = i.ticker AND t.transaction_date > i.date"""


@query("w01_w09_attached_indicators", ATTACHED, IND_VIEWS)
def _(t):
    return flat(indicators.attach_indicators(t.trades, t.prices), "trade_id", *indicators.DEFAULTS)


REGIME_VIEWS = {
    "spy": f"""SELECT date, adj_close AS price, (adj_close - lag(adj_close) OVER (ORDER BY date))
        / lag(adj_close) OVER (ORDER BY date) AS ret FROM prices WHERE ticker = '{BENCH_TICKER}'""",
    "regime": """SELECT date, n, (price - p21) / p21 AS spy_return_21d,
        (price - CASE WHEN n >= 21 THEN p0 ELSE p21 END) / CASE WHEN n >= 21 THEN p0 ELSE p21 END AS spy_return_63d,
        CASE WHEN n >= 22 THEN sd ELSE 0 END AS spy_volatility_21d,
        CASE WHEN price > mean63 THEN 1 ELSE 0 END AS market_is_bull FROM (
        SELECT date, price, count(*) OVER f63 AS n, first_value(price) OVER f63 AS p0, avg(price) OVER f63 AS mean63,
          coalesce(lag(price, 20) OVER (ORDER BY date), first_value(price) OVER f63) AS p21,
          stddev_samp(ret) OVER f21 AS sd FROM spy WINDOW
          f63 AS (ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW),
          f21 AS (ORDER BY date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW))""",
}
REGIME_COLUMNS = ["spy_return_21d", "spy_return_63d", "spy_volatility_21d", "market_is_bull"]


@query("w10_market_regime", f"""SELECT t.trade_id, {', '.join(
    R(f'CASE WHEN r.n >= 5 THEN r.{c} ELSE 0 END') + f' AS {c}' for c in REGIME_COLUMNS)}
    FROM trades t ASOF LEFT JOIN regime r ON t.transaction_date > r.date""", REGIME_VIEWS)
def _(t):
    bench = t.prices.filter(F.col("ticker") == BENCH_TICKER)
    return flat(indicators.market_regime(t.trades, bench), "trade_id", *REGIME_COLUMNS)


SENT_COLUMNS = ["avg_sentiment_7d", "avg_sentiment_30d", "sentiment_momentum", "media_mention_count_7d",
                "media_mention_count_30d"]
DAILY_SENT = {
    "daily_sent": """SELECT m.published_date AS day, avg(s.sentiment_score) AS avg_score, count(*) AS n
        FROM media m JOIN sentiment s ON s.media_id = m.media_id WHERE m.published_date IS NOT NULL GROUP BY 1""",
    "sent_days": """SELECT d.day,
        coalesce(avg(s.avg_score) FILTER (s.day >= d.day - 7), 0) AS avg_sentiment_7d,
        coalesce(avg(s.avg_score), 0) AS avg_sentiment_30d,
        coalesce(avg(s.avg_score) FILTER (s.day >= d.day - 7), 0) - coalesce(avg(s.avg_score), 0) AS sentiment_momentum,
        coalesce(sum(s.n) FILTER (s.day >= d.day - 7), 0) AS media_mention_count_7d,
        coalesce(sum(s.n), 0) AS media_mention_count_30d
        FROM (SELECT DISTINCT transaction_date AS day FROM trades) d
        LEFT JOIN daily_sent s ON s.day >= d.day - 30 AND s.day < d.day GROUP BY d.day""",
}


@query("w11_sentiment_windows", f"""SELECT t.trade_id, {', '.join(f'{R("s." + c)} AS {c}' for c in SENT_COLUMNS)}
    FROM trades t JOIN sent_days s ON s.day = t.transaction_date""", DAILY_SENT)
def _(t):
    return flat(history.sentiment_windows(t.trades, history.daily_sentiment(t.media, t.sentiment)),
                "trade_id", *SENT_COLUMNS)


ROW_SENT = {
    "daily_rows": """SELECT m.published_date AS day, sum(s.sentiment_score) AS score, count(s.sentiment_score) AS scored,
        count(*) AS n FROM media m LEFT JOIN sentiment s ON s.media_id = m.media_id GROUP BY 1""",
    "row_days": """SELECT d.day,
        coalesce(sum(s.score) FILTER (s.day >= d.day - 7) / nullif(sum(s.scored) FILTER (s.day >= d.day - 7), 0), 0) AS avg_sentiment_7d,
        coalesce(sum(s.score) / nullif(sum(s.scored), 0), 0) AS avg_sentiment_30d,
        coalesce(sum(s.n) FILTER (s.day >= d.day - 7), 0) AS media_mention_count_7d,
        coalesce(sum(s.n), 0) AS media_mention_count_30d
        FROM (SELECT DISTINCT transaction_date AS day FROM trades) d
        LEFT JOIN daily_rows s ON s.day >= d.day - 30 AND s.day < d.day GROUP BY d.day""",
}


@query("w17_sentiment_by_row", f"""SELECT trade_id, {R('named * avg_sentiment_7d')} AS avg_sentiment_7d,
    {R('named * avg_sentiment_30d')} AS avg_sentiment_30d,
    {R('named * (avg_sentiment_7d - avg_sentiment_30d)')} AS sentiment_momentum,
    {R('named * media_mention_count_7d')} AS media_mention_count_7d,
    {R('named * media_mention_count_30d')} AS media_mention_count_30d
    FROM (SELECT t.trade_id, s.*, CASE WHEN t.member_bioguide_id IS NULL AND t.ticker IS NULL THEN 0 ELSE 1 END AS named
          FROM trades t JOIN row_days s ON s.day = t.transaction_date)""", ROW_SENT)
def _(t):
    return flat(history.sentiment_by_row(t.trades, t.media, t.sentiment), "trade_id", *SENT_COLUMNS)


HISTORY_VIEWS = {
    **NUMBERED,
    "outcomes": """SELECT b.trade_id, b.member_bioguide_id, b.transaction_date,
        (f.adj_close - b.base_price) / b.base_price AS ret,
        CASE WHEN f.adj_close IS NOT NULL THEN
          CASE WHEN (f.adj_close > b.base_price) = (b.transaction_type = 'purchase') THEN 1 ELSE 0 END END AS is_win
        FROM based b LEFT JOIN numbered f ON b.ticker = f.ticker AND f.rn = b.rn + 21
        WHERE b.base_price > 0 AND b.member_bioguide_id IS NOT NULL""",
    "hist": """SELECT trade_id, CASE WHEN n >= 3 THEN wins / n ELSE 0.5 END AS member_win_rate,
        CASE WHEN n >= 3 THEN n ELSE 0 END AS member_trade_count,
        CASE WHEN n >= 3 THEN rets / n ELSE 0 END AS member_avg_return FROM (
        SELECT trade_id, count(is_win) OVER w AS n, (sum(is_win) OVER w)::DOUBLE AS wins, sum(ret) OVER w AS rets
        FROM outcomes WINDOW w AS (PARTITION BY member_bioguide_id ORDER BY transaction_date, trade_id
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""",
}


@query("w12_member_history", f"""SELECT trade_id, {R('member_win_rate')} AS member_win_rate,
    {R('member_trade_count')} AS member_trade_count, {R('member_avg_return')} AS member_avg_return FROM hist""",
       HISTORY_VIEWS)
def _(t):
    return flat(history.member_history(t.trades, t.prices, 20))


CROSS_VIEWS = {
    "tt": """SELECT trade_id, ticker, transaction_date AS d, coalesce(member_bioguide_id, '') AS m,
        CASE WHEN transaction_type = 'purchase' THEN 1 WHEN transaction_type LIKE 'sale%' THEN -1 ELSE 0 END AS dir
        FROM trades WHERE ticker IS NOT NULL""",
    "cross_act": """SELECT a.trade_id,
        count(DISTINCT b.m) FILTER (b.d BETWEEN a.d - 7 AND a.d + 7 AND b.m <> a.m) AS cross_member_7d,
        count(DISTINCT b.m) FILTER (b.m <> a.m) AS cross_member_30d,
        count(DISTINCT b.m) FILTER (b.d BETWEEN a.d - 7 AND a.d + 7 AND b.m <> a.m AND b.dir = a.dir)
          AS cross_member_same_dir_7d
        FROM tt a JOIN tt b ON a.ticker = b.ticker AND b.d BETWEEN a.d - 30 AND a.d + 30 GROUP BY a.trade_id""",
}
CROSS_COLUMNS = ["cross_member_7d", "cross_member_30d", "cross_member_same_dir_7d"]


@query("w13_cross_member", f"""SELECT trade_id, {', '.join(f'{R(c)} AS {c}' for c in CROSS_COLUMNS)}
    FROM cross_act""", CROSS_VIEWS)
def _(t):
    return flat(history.cross_member(t.trades))


VELOCITY_VIEWS = {"velo": """SELECT trade_id, member_trades_30d, member_trades_90d,
    CASE WHEN member_trades_90d > 0 THEN least((member_trades_30d / 30.0::DOUBLE) / (member_trades_90d / 90.0::DOUBLE), 10)
         ELSE 1 END AS member_velocity_ratio FROM (
    SELECT trade_id, count(*) OVER (PARTITION BY member_bioguide_id ORDER BY transaction_date
        RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING) AS member_trades_30d,
      count(*) OVER (PARTITION BY member_bioguide_id ORDER BY transaction_date
        RANGE BETWEEN INTERVAL 90 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING) AS member_trades_90d
    FROM trades WHERE member_bioguide_id IS NOT NULL)"""}
VELOCITY_COLUMNS = ["member_trades_30d", "member_trades_90d", "member_velocity_ratio"]


@query("w14_member_velocity", f"SELECT trade_id, {', '.join(f'{R(c)} AS {c}' for c in VELOCITY_COLUMNS)} FROM velo",
       VELOCITY_VIEWS)
def _(t):
    return flat(history.member_velocity(t.trades))


@query("w15_sample_weights", f"""SELECT trade_id, {R('w / avg(w) OVER ()')} AS sample_weight FROM (
    SELECT trade_id, ln(1 + greatest((coalesce(amount_range_low,0) + coalesce(amount_range_high,0)) / 2, 1000)) AS w
    FROM trades)""")
def _(t):
    return flat(history.sample_weights(t.trades), "trade_id", "sample_weight")


@query("w16_market_features", f"""SELECT trade_id,
    {R('CASE WHEN n < 2 THEN 0 ELSE (p0 - p5) / p5 END')} AS price_change_5d,
    {R('CASE WHEN n < 2 THEN 0 ELSE (p0 - p21) / p21 END')} AS price_change_21d,
    {R('CASE WHEN len(rets) >= 2 THEN list_stddev_samp(rets) ELSE 0 END')} AS volatility_21d,
    {R('CASE WHEN n < 2 THEN 0 ELSE list_avg(v[1:5]) / list_avg(v[1:21]) END')} AS volume_ratio_5d,
    {R('''CASE WHEN n < 2 THEN 50 WHEN list_sum(losses) = 0 THEN 100
          ELSE 100 - 100 / (1 + list_sum(gains) / list_sum(losses)) END''')} AS rsi_14
    FROM (SELECT trade_id, n, p[1] AS p0, p[least(6, n)] AS p5, p[least(22, n)] AS p21, v,
        [(p[i] - p[i+1]) / p[i+1] for i in range(1, least(22, n))] AS rets,
        [greatest(p[i] - p[i+1], 0) for i in range(1, least(15, n))] AS gains,
        [greatest(p[i+1] - p[i], 0) for i in range(1, least(15, n))] AS losses
      FROM (SELECT t.trade_id, coalesce(len(k.p), 0) AS n, k.p, k.v FROM trades t LEFT JOIN (
          SELECT d.ticker, d.day, list(q.adj_close ORDER BY q.date DESC) AS p, list(q.volume ORDER BY q.date DESC) AS v
          FROM (SELECT DISTINCT ticker, transaction_date AS day FROM trades WHERE ticker IS NOT NULL) d
          JOIN prices q ON q.ticker = d.ticker AND q.date >= d.day - 60 AND q.date < d.day GROUP BY 1, 2) k
        ON k.ticker = t.ticker AND k.day = t.transaction_date))""")
def _(t):
    names = list(indicators.DEFAULTS)[:5]
    return flat(indicators.recent_market_features(t.trades, t.prices), "trade_id", *names)


RISK_VIEWS = {
    "last30": """SELECT ticker, date, close, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k
        FROM prices QUALIFY k <= 30""",
    "last_ret": """SELECT *, (close - lead(close) OVER (PARTITION BY ticker ORDER BY k))
        / lead(close) OVER (PARTITION BY ticker ORDER BY k) AS ret FROM last30""",
    "risk": """SELECT ticker, CASE WHEN count(*) >= 5 AND count(ret) >= 5 THEN stddev_pop(ret) * sqrt(252) END AS volatility_21d,
        CASE WHEN count(ret) >= 14 THEN CASE WHEN coalesce(sum(-ret) FILTER (k <= 14 AND ret < 0), 0) = 0 THEN 100 ELSE
          100 - 100 / (1 + coalesce(sum(ret) FILTER (k <= 14 AND ret > 0), 0) / sum(-ret) FILTER (k <= 14 AND ret < 0)) END END AS rsi_14,
        CASE WHEN count(*) >= 5 THEN (max(close) FILTER (k = 1) - max(close) FILTER (k = 5)) / max(close) FILTER (k = 5) END
          AS price_change_5d FROM last_ret GROUP BY ticker""",
}


@query("w18_risk_metrics", f"""SELECT ticker, {R('volatility_21d')} AS volatility_21d, {R('rsi_14')} AS rsi_14,
    {R('price_change_5d')} AS price_change_5d FROM risk""", RISK_VIEWS)
def _(t):
    return flat(indicators.risk_metrics(t.prices))


@query("w19_latest_close", f"""SELECT ticker, {R('arg_max(close, date)')} AS current_price, {S('max(date)')} AS price_date
    FROM prices GROUP BY ticker""")
def _(t):
    return flat(indicators.latest_close(t.prices))
