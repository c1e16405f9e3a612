"""Read queries, reports, set operations and metrics."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..operators import history, metrics
from . import read_api as api, stats
from .registry import R, S, TS, flat, query
from .views import AS_OF_DATE

D0, D1 = date(1997, 1, 1), date(1999, 12, 31)
BETWEEN = "BETWEEN DATE '1997-01-01' AND DATE '1999-12-31'"
TRADE_OUT = ["trade_id", "member_name", "ticker", "transaction_type", "transaction_date"]
TRADE_SQL = f"SELECT trade_id, member_name, ticker, transaction_type, {S('transaction_date')} AS transaction_date FROM trades"


@query("q01_list_trades", f"""{TRADE_SQL} WHERE member_name ILIKE '%family1%' AND chamber = 'house'
    AND transaction_type = 'purchase' AND transaction_date {BETWEEN}""")
def _(t):
    return flat(api.list_trades(t.trades, member_name="FAMILY1", chamber="House", transaction_type="Purchase",
                                date_from=D0, date_to=D1), *TRADE_OUT)


@query("k01_page", f"""{TRADE_SQL} WHERE filer_type = 'spouse' ORDER BY transaction_date DESC, trade_id
    LIMIT 50 OFFSET 100""")
def _(t):
    return flat(api.list_trades(t.trades, filer_type="spouse", limit=50, offset=100), *TRADE_OUT)


@query("q02_list_members", """SELECT bioguide_id, full_name, party, state FROM members
    WHERE chamber = 'senate' AND party = 'Republican' AND in_office""")
def _(t):
    return flat(api.list_members(t.members, chamber="Senate", party="Republican", in_office=True),
                "bioguide_id", "full_name", "party", "state")


@query("q03_lookup", "SELECT bioguide_id, full_name, chamber FROM members WHERE bioguide_id IN ('1','7','40','99')")
def _(t):
    return flat(api.lookup(t.members, "bioguide_id", ["1", "7", "40", "99"]), "bioguide_id", "full_name", "chamber")


@query("q04_member_trades", f"{TRADE_SQL} WHERE member_bioguide_id = '7'")
def _(t):
    return flat(api.member_trades(t.trades, "7"), *TRADE_OUT)


@query("q05_list_bills", f"""SELECT bill_id, title, policy_area, {S('introduced_date')} AS introduced_date FROM bills
    WHERE congress_number = 118 AND policy_area ILIKE '%health%' AND introduced_date {BETWEEN}""")
def _(t):
    return flat(api.list_bills(t.bills, congress=118, policy_area="HEALTH", date_from=D0, date_to=D1),
                "bill_id", "title", "policy_area", "introduced_date")


@query("q07_list_committees", "SELECT system_code, name FROM committees WHERE chamber = 'house' AND is_current")
def _(t):
    return flat(api.list_committees(t.committees, chamber="house"), "system_code", "name")


@query("q09_committee_hearings", f"""SELECT hearing_id, title, {S('hearing_date')} AS hearing_date FROM hearings
    WHERE committee_code = 'hsba00'""")
def _(t):
    return flat(api.committee_hearings(t.hearings, "hsba00"), "hearing_id", "title", "hearing_date")


@query("q10_list_media", f"""SELECT m.media_id, m.source_type, {S('m.published_date')} AS published_date,
    s.sentiment_label, {R('s.sentiment_score')} AS sentiment_score FROM media m
    LEFT JOIN sentiment s ON s.media_id = m.media_id
    WHERE m.published_date {BETWEEN} AND list_contains(m.tickers_mentioned, 'Brand#3')""")
def _(t):
    df = api.list_media(t.media, t.sentiment, date_from=D0, date_to=D1, ticker="Brand#3")
    return flat(df.select("media_id", "source_type", "published_date", "sentiment.sentiment_label",
                          "sentiment.sentiment_score"))


@query("q11_get_media", f"""SELECT m.media_id, m.title, coalesce(s.sentiment_label || ':' || {S('s.model_name')}, '')
    AS analyses FROM media m LEFT JOIN sentiment s ON s.media_id = m.media_id""")
def _(t):
    df = api.get_media(t.media, t.sentiment)
    text = F.array_join(F.transform("sentiment_analyses", lambda a: F.concat_ws(
        ":", a["sentiment_label"], a["model_name"])), ",")
    return df.select("media_id", "title", F.coalesce(text, F.lit("")).alias("analyses"))


@query("q12_member_media", f"""SELECT media_id, title, {S('published_date')} AS published_date FROM media
    WHERE list_contains(member_bioguide_ids, '21')""")
def _(t):
    return flat(api.member_media(t.media, "21"), "media_id", "title", "published_date")


@query("q13_list_predictions", f"""SELECT p.prediction_id, p.trade_id, p.predicted_label, {R('p.confidence')} AS confidence
    FROM predictions p JOIN trades t ON p.trade_id = t.trade_id
    WHERE t.ticker = 'Brand#3' AND p.prediction_type = 'profitability' AND t.transaction_date {BETWEEN}""")
def _(t):
    return flat(api.list_predictions(t.predictions, t.trades, ticker="Brand#3", prediction_type="profitability",
                                     date_from=D0, date_to=D1), "prediction_id", "trade_id", "predicted_label", "confidence")


@query("q14_trade_predictions", f"""SELECT prediction_id, prediction_type, {R('predicted_value')} AS predicted_value
    FROM predictions WHERE trade_id = 42""")
def _(t):
    return flat(api.trade_predictions(t.predictions, 42), "prediction_id", "prediction_type", "predicted_value")


@query("q15_model_performance", f"SELECT model_name, model_version, {R('auc')} AS auc FROM artifacts WHERE is_active")
def _(t):
    return flat(api.model_performance(t.artifacts), "model_name", "model_version", "auc")


@query("q16_list_signals", f"""SELECT signal_id, signal_type, ticker, {R('strength')} AS strength,
    {TS('created_at')} AS created_at FROM signals
    WHERE is_active AND signal_type = 'trade_follow' AND strength >= 0.3""")
def _(t):
    return flat(api.list_signals(t.signals, signal_type="trade_follow", min_strength=0.3),
                "signal_id", "signal_type", "ticker", "strength", "created_at")


@query("j16_unscored_trades", """SELECT t.trade_id FROM trades t WHERE t.ticker IS NOT NULL AND NOT EXISTS (
    SELECT 1 FROM predictions p WHERE p.trade_id = t.trade_id AND p.prediction_type = 'anomaly')""")
def _(t):
    scored = t.predictions.filter("prediction_type = 'anomaly'")
    return api.unscored_trades(t.trades, scored).select("trade_id")


@query("j17_unanalysed_media", """SELECT media_id FROM media WHERE content IS NOT NULL AND content <> ''
    AND media_id NOT IN (SELECT media_id FROM sentiment WHERE model_name = 'wordlist')""")
def _(t):
    return api.unanalysed_media(t.media, t.sentiment, "wordlist").select("media_id")


@query("j18_trading_members", """SELECT bioguide_id FROM members WHERE bioguide_id IN (
    SELECT member_bioguide_id FROM trades WHERE member_bioguide_id IS NOT NULL)""".replace("IN (", "IN ("))
def _(t):
    return api.trading_members(t.members, t.trades).select("bioguide_id")


# ---------------------------------------------------------------- aggregates


@query("a01_trade_totals", f"""SELECT count(*) AS total_trades, count(DISTINCT member_name) AS total_members,
    count(*) FILTER (disclosure_date BETWEEN DATE '{AS_OF_DATE}' - 7 AND DATE '{AS_OF_DATE}') AS recent_trades_7d FROM trades""")
def _(t):
    return stats.trade_totals(t.trades, AS_OF_DATE)


@query("a02_top_tickers", """SELECT ticker, count(*) AS count FROM trades WHERE ticker IS NOT NULL GROUP BY 1
    ORDER BY 2 DESC, 1 LIMIT 10""")
def _(t):
    return stats.top_tickers(t.trades)


@query("a03_top_members", "SELECT member_name, count(*) AS count FROM trades GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _(t):
    return stats.top_members(t.trades)


@query("a04_media_stats", f"""SELECT 'total_content' AS figure, '' AS key, count(*) AS n FROM media
    UNION ALL SELECT 'by_source_type', source_type, count(*) FROM media GROUP BY 2
    UNION ALL SELECT 'content_last_7_days', '', count(*) FILTER (published_date BETWEEN DATE '{AS_OF_DATE}' - 7 AND DATE '{AS_OF_DATE}') FROM media
    UNION ALL SELECT 'recent_sentiment', sentiment_label, count(*) FROM sentiment s JOIN media m ON s.media_id = m.media_id
      WHERE m.published_date BETWEEN DATE '{AS_OF_DATE}' - 7 AND DATE '{AS_OF_DATE}' GROUP BY 2""")
def _(t):
    return stats.media_stats(t.media, t.sentiment, AS_OF_DATE)


@query("a05_sentiment_timeline", f"""SELECT {S('m.published_date')} AS date, {R('round(avg(s.sentiment_score), 4)')} AS avg_score,
    count(*) AS count FROM media m JOIN sentiment s ON s.media_id = m.media_id
    WHERE list_contains(m.member_bioguide_ids, '21') AND m.published_date BETWEEN DATE '{AS_OF_DATE}' - 2400 AND DATE '{AS_OF_DATE}' GROUP BY m.published_date""")
def _(t):
    return flat(stats.sentiment_timeline(t.media, t.sentiment, "21", 2400, AS_OF_DATE))


@query("a06_prediction_stats", f"""SELECT prediction_type, count(*) AS n, {R('avg(confidence)')} AS avg_confidence
    FROM predictions GROUP BY ROLLUP (prediction_type)""")
def _(t):
    return flat(stats.prediction_stats(t.predictions))


@query("a07_accuracy_5d", f"""SELECT {R('''avg(CASE WHEN (predicted_label = 'profitable' AND actual_return_5d > 0)
      OR (predicted_label = 'unprofitable' AND actual_return_5d <= 0) THEN 1.0 ELSE 0.0 END)''')} AS accuracy_5d,
    count(*) AS n FROM predictions WHERE prediction_type = 'profitability' AND actual_return_5d IS NOT NULL""")
def _(t):
    return flat(stats.accuracy_5d(t.predictions))


LEADER_SQL = f"""SELECT t.member_name, t.member_bioguide_id, count(*) AS total_trades,
    count(*) FILTER (p.predicted_label = 'profitable') AS predicted_profitable,
    count(*) FILTER (p.actual_return_5d > 0) AS actual_profitable,
    {R('count(*) FILTER (p.actual_return_5d > 0) / count(*)')} AS accuracy, {R('avg(p.confidence)')} AS avg_confidence
    FROM predictions p JOIN trades t ON p.trade_id = t.trade_id WHERE p.prediction_type = 'profitability'
    GROUP BY 1, 2 HAVING count(*) >= 5"""


@query("a08_leaderboard", LEADER_SQL + " ORDER BY total_trades DESC, member_name, member_bioguide_id NULLS LAST LIMIT 20")
def _(t):
    return flat(stats.leaderboard(t.predictions, t.trades))


@query("a08_leaderboard_all", LEADER_SQL)
def _(t):
    return flat(stats.leaderboard(t.predictions, t.trades, None))


@query("a09_signal_stats", f"""SELECT signal_type, direction,
    CAST(grouping(signal_type) * 2 + grouping(direction) AS BIGINT) AS "grouping", count(*) AS n,
    {R('avg(strength)')} AS avg_strength FROM signals WHERE is_active
    GROUP BY GROUPING SETS ((signal_type), (direction), ())""")
def _(t):
    return flat(stats.signal_stats(t.signals))


@query("a10_strength_by_type", f"SELECT signal_type, {R('avg(strength)')} AS avg_strength, count(*) AS n FROM signals GROUP BY 1")
def _(t):
    return flat(stats.strength_by_type(t.signals))


@query("a11_committee_counts", "SELECT member_bioguide_id, count(*) AS committee_count FROM assignments GROUP BY 1")
def _(t):
    return stats.committee_counts(t.assignments)


@query("a12_ticker_popularity", f"""SELECT ticker, count(DISTINCT member_bioguide_id) AS ticker_total_members,
    count(*) AS ticker_total_trades,
    {R("avg(CASE WHEN transaction_type = 'purchase' THEN 1.0 ELSE 0.0 END)")} AS ticker_purchase_ratio
    FROM trades WHERE ticker IS NOT NULL GROUP BY 1""")
def _(t):
    return flat(history.ticker_popularity(t.trades))


@query("a12_ticker_popularity_point_in_time", f"""SELECT t.trade_id, CAST(f.members AS BIGINT) AS ticker_total_members,
    f.n AS ticker_total_trades, {R('CASE WHEN f.n > 0 THEN f.bought / f.n ELSE 0.5 END')} AS ticker_purchase_ratio
    FROM trades t JOIN (
      SELECT d.ticker, d.day, count(DISTINCT x.member_bioguide_id) AS members, count(x.trade_id) AS n,
        count(*) FILTER (x.transaction_type = 'purchase') AS bought
      FROM (SELECT DISTINCT ticker, transaction_date AS day FROM trades WHERE ticker IS NOT NULL) d
      LEFT JOIN trades x ON x.ticker = d.ticker AND x.transaction_date < d.day GROUP BY 1, 2) f
    ON f.ticker = t.ticker AND f.day = t.transaction_date""")
def _(t):
    return flat(history.ticker_popularity_before(t.trades))


@query("a13_lobby_counts", """SELECT matched_ticker AS ticker, count(DISTINCT filing_uuid) AS filing_count
    FROM clients c JOIN filings f ON f.client_id = c.client_id WHERE matched_ticker IS NOT NULL GROUP BY 1""")
def _(t):
    return stats.lobby_counts(t.clients, t.filings)


@query("a14_donor_counts", """SELECT cc.member_bioguide_id, c.matched_ticker AS ticker, count(*) AS contribution_count
    FROM contributions c JOIN campaign_committees cc ON c.fec_committee_id = cc.fec_committee_id
    WHERE c.matched_ticker IS NOT NULL AND cc.member_bioguide_id IS NOT NULL GROUP BY 1, 2""")
def _(t):
    return stats.donor_counts(t.contributions, t.campaign_committees)


@query("a15_trade_degree", """SELECT member_bioguide_id, count(DISTINCT ticker) AS degree FROM trades
    WHERE ticker IS NOT NULL AND member_bioguide_id IS NOT NULL GROUP BY 1""")
def _(t):
    return stats.trade_degree(t.trades)


@query("a16_daily_sentiment", f"""SELECT {S('published_date')} AS published_date, {R('avg(sentiment_score)')} AS avg_score,
    count(*) AS article_count FROM media m JOIN sentiment s ON s.media_id = m.media_id GROUP BY m.published_date""")
def _(t):
    return flat(history.daily_sentiment(t.media, t.sentiment))


@query("a17_freshness", f"""SELECT CASE WHEN n > 0 THEN 'ok' ELSE 'warning' END AS status, n AS recent_trades_7d
    FROM (SELECT count(*) FILTER (disclosure_date BETWEEN DATE '{AS_OF_DATE}' - 7 AND DATE '{AS_OF_DATE}') AS n FROM trades)""")
def _(t):
    return stats.freshness(t.trades, AS_OF_DATE, "disclosure_date")


@query("a18_assignments_by_congress", "SELECT congress_number, count(*) AS n FROM assignments GROUP BY 1")
def _(t):
    return stats.assignments_by_congress(t.assignments)


@query("a19_link_coverage", """SELECT count(member_bioguide_id) AS linked, count(*) - count(member_bioguide_id) AS unlinked
    FROM trades""")
def _(t):
    return stats.link_coverage(t.trades)


SCORED = {"scored": """SELECT CASE WHEN actual_return_5d > 0 THEN 1 ELSE 0 END AS y_true,
    CASE WHEN predicted_label = 'profitable' THEN 1 ELSE 0 END AS y_pred, predicted_value AS proba,
    actual_return_5d AS ret FROM predictions WHERE actual_return_5d IS NOT NULL"""}


def _scored(t):
    return t.predictions.filter("actual_return_5d is not null").select(
        (F.col("actual_return_5d") > 0).cast("int").alias("y_true"),
        (F.col("predicted_label") == "profitable").cast("int").alias("y_pred"),
        F.col("predicted_value").alias("proba"), F.col("predicted_value").alias("y_proba"),
        F.col("actual_return_5d").alias("ret"))


@query("a20_classifier_metrics", f"""SELECT {R('acc')} AS accuracy, {R('p')} AS precision, {R('r')} AS recall,
    {R('CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END')} AS f1 FROM (SELECT
      avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END) AS acc,
      coalesce(sum(y_true * y_pred) / nullif(sum(y_pred), 0), 0) AS p,
      coalesce(sum(y_true * y_pred) / nullif(sum(y_true), 0), 0) AS r FROM scored)""", SCORED)
def _(t):
    return flat(metrics.classifier_metrics(_scored(t)))


@query("a21_auc", f"""SELECT {R('(sum(CASE WHEN y_true = 1 THEN rk END) - p * (p + 1) / 2) / (p * n)')} AS auc FROM (
      SELECT y_true, rank() OVER (ORDER BY proba) + (count(*) OVER (PARTITION BY proba) - 1) / 2 AS rk,
        (sum(y_true) OVER ())::DOUBLE AS p, (count(*) OVER () - sum(y_true) OVER ())::DOUBLE AS n FROM scored)
    GROUP BY p, n""", SCORED)
def _(t):
    return flat(metrics.auc(_scored(t)))


@query("a22_regressor_metrics", f"""SELECT {R('avg(abs(ret - proba))')} AS mae, {R('sqrt(avg((ret - proba) ** 2))')} AS rmse,
    {R('1 - sum((ret - proba) ** 2) / (var_pop(ret) * count(*))')} AS r2 FROM scored""", SCORED)
def _(t):
    return flat(metrics.regressor_metrics(_scored(t).withColumn("y_true", F.col("ret")).withColumn(
        "y_pred", F.col("proba"))))


@query("a23_profit_metrics", f"""SELECT {R('sum(ret) FILTER (ret > 0) / abs(sum(ret) FILTER (ret <= 0))')} AS profit_factor,
    {R('count(*) FILTER (ret > 0) / count(*)')} AS win_rate, {R('avg(ret)')} AS avg_return,
    {R('count(*)')} AS trades_taken FROM scored WHERE proba >= 0.5::DOUBLE""", SCORED)
def _(t):
    return flat(metrics.profit_metrics(_scored(t)))


@query("a24_fold_summary", f"""SELECT prediction_type AS model, predicted_label AS metric, {R('avg(v)')} AS mean,
    {R('stddev_pop(v)')} AS std FROM (SELECT prediction_type, predicted_label, year(created_at) AS fold,
      avg(confidence) AS v FROM predictions GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def _(t):
    folds = t.predictions.groupBy(
        F.col("prediction_type").alias("model"), F.col("predicted_label").alias("metric"),
        F.year("created_at").alias("fold")).agg(F.avg("confidence").alias("value"))
    return flat(metrics.fold_summary(folds))


@query("a25_anomaly_summary", f"""SELECT {R("avg(CASE WHEN predicted_label = 'anomalous' THEN 1.0 ELSE 0.0 END)")} AS anomaly_rate,
    {R("count(*) FILTER (predicted_label = 'anomalous')")} AS anomaly_count, {R('avg(predicted_value)')} AS mean_score,
    {R('stddev_pop(predicted_value)')} AS std_score FROM predictions WHERE prediction_type = 'anomaly'""")
def _(t):
    df = t.predictions.filter("prediction_type = 'anomaly'").select(
        (F.col("predicted_label") == "anomalous").alias("anomalous"), F.col("predicted_value").alias("score"))
    return flat(metrics.anomaly_summary(df))


# ---------------------------------------------------------------- sets and top-k


@query("u04_unique_tickers", "SELECT DISTINCT ticker FROM trades WHERE ticker IS NOT NULL")
def _(t):
    return api.unique_tickers(t.trades)


@query("u05_known_tickers", "SELECT ticker FROM prices UNION SELECT ticker FROM trades WHERE ticker IS NOT NULL")
def _(t):
    return api.known_tickers(t.prices, t.trades)


@query("u06_tickers_without_sector", "SELECT DISTINCT ticker FROM trades WHERE ticker IS NOT NULL EXCEPT SELECT ticker FROM sectors")
def _(t):
    return api.tickers_without_sector(t.trades, t.sectors)


@query("k02_cap_oldest", f"""SELECT trade_id, {S('transaction_date')} AS transaction_date FROM trades
    ORDER BY trades.transaction_date, trade_id LIMIT 2000""")
def _(t):
    from .dataset import cap_oldest
    return flat(cap_oldest(t.trades, 2000), "trade_id", "transaction_date")
