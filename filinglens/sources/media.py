"""News, feeds, transcripts, posts and videos to the common media schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text as X

MEDIA_COLUMNS = [
    "source_type", "source_id", "title", "content", "summary", "url", "author", "published_date",
    "member_bioguide_ids", "tickers_mentioned", "raw_metadata",
]
TRANSCRIPT_SCHEMA = (
    "packageId string, title string, dateIssued string, category string, _full_text string, "
    "_summary struct<dateIssued string, committee string, congress string, description string>"
)
NEWS_A_SCHEMA = (
    "title string, description string, content string, url string, image string, publishedAt string, "
    "source struct<name string, url string>"
)
NEWS_B_SCHEMA = (
    "article_id string, title string, link string, description string, content string, pubDate string, "
    "source_id string, source_name string, creator array<string>, category array<string>, keywords array<string>, "
    "country array<string>, image_url string"
)
FEED_ITEM_SCHEMA = (
    "guid string, link string, title string, description string, pubDate string, updated string, "
    "category array<string>, feed_name string, feed_url string"
)
POST_SCHEMA = (
    "id string, text string, created_at string, screen_name string, bioguide_id string, "
    "public_metrics struct<retweet_count int, like_count int, reply_count int, quote_count int>"
)
VIDEO_SCHEMA = "`yt:videoId` string, title string, published string, author struct<name string, uri string>"


def _s(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c, F.lit(""))


def _or(*columns: Column | str) -> Column:
    """First non-empty text, else an empty one."""
    tries = [F.nullif(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in columns]
    return F.coalesce(*tries, F.lit(""))


def _media(df: DataFrame, source_type: str | Column, metadata: dict[str, Column], **columns: Column) -> DataFrame:
    none = F.array().cast("array<string>")
    meta = F.create_map(*[part for k, v in metadata.items() for part in (F.lit(k), v.cast("string"))])
    all_columns = {
        "summary": F.lit(None).cast("string"), "url": F.lit(None).cast("string"), "author": F.lit(None).cast("string"),
        "member_bioguide_ids": none, "tickers_mentioned": none, **columns,
        "source_type": F.lit(source_type) if isinstance(source_type, str) else source_type, "raw_metadata": meta,
    }
    return df.select(*[all_columns[c].alias(c) for c in MEDIA_COLUMNS])


def _members(c: str) -> Column:
    return F.when(_s(c) != "", F.array(F.col(c))).otherwise(F.array().cast("array<string>"))


def normalise_transcripts(raw: DataFrame) -> DataFrame:
    """Hearing transcripts; the text is a string or a {body} object."""
    body = F.get_json_object("_full_text", "$.body")
    text = F.when(F.col("_full_text").startswith("{"), body).otherwise(F.col("_full_text"))
    return _media(
        raw.filter("packageId <> '' and title <> ''"), "hearing_transcript",
        {"package_id": F.col("packageId"), "committee": _s("_summary.committee"), "congress": F.col("_summary.congress"),
         "category": _s("category")},
        source_id=F.col("packageId"), title=F.col("title"), content=X.strip_html(text),
        summary=_s("_summary.description"),
        url=F.concat(F.lit("https://www.govinfo.gov/app/details/"), F.col("packageId")),
        published_date=X.iso_date(_or("dateIssued", "_summary.dateIssued")))


def normalise_news_a(raw: DataFrame) -> DataFrame:
    """News of source A, identified by URL."""
    return _media(
        raw.filter("title <> '' and url <> ''"), "news_a",
        {"source_name": _s("source.name"), "source_url": _s("source.url"), "image": _s("image")},
        source_id=F.col("url"), title=F.col("title"), content=_or("description", "content"), url=F.col("url"),
        author=_s("source.name"), published_date=X.iso_date("publishedAt"))


def normalise_news_b(raw: DataFrame) -> DataFrame:
    """News of source B, identified by article id, else link."""
    joined = lambda c: F.array_join(F.coalesce(c, F.array().cast("array<string>")), ",")
    df = raw.withColumn("_id", _or("article_id", "link")).filter("title <> '' and _id <> ''")
    return _media(
        df, "news_b",
        {"source_id": _s("source_id"), "source_name": _s("source_name"), "categories": joined("category"),
         "keywords": joined("keywords"), "country": joined("country"), "image_url": _s("image_url")},
        source_id=F.col("_id"), title=F.col("title"), content=_or("description", "content"), url=_s("link"),
        author=F.array_join(F.coalesce("creator", F.array().cast("array<string>")), ", "),
        published_date=X.iso_date("pubDate"))


def _feed(raw: DataFrame) -> DataFrame:
    return raw.withColumn("_id", _or("guid", "link")).withColumn(
        "_published", X.rss_date(_or("pubDate", "updated"))).filter("title <> '' and _id <> ''")


def normalise_feed(raw: DataFrame) -> DataFrame:
    """Legislative activity feeds with their tags."""
    tags = F.array_join(F.coalesce("category", F.array().cast("array<string>")), ",")
    return _media(
        _feed(raw), "activity_feed", {"feed_name": _s("feed_name"), "tags": tags}, source_id=F.col("_id"),
        title=F.col("title"), content=X.strip_html("description"), url=_s("link"), published_date=F.col("_published"))


def normalise_press_releases(raw: DataFrame, feeds: DataFrame) -> DataFrame:
    """Members' press-release feeds, tagged through (feed_url, bioguide_id, member_name)."""
    owners = feeds.select("feed_url", "bioguide_id", "member_name")
    df = _feed(raw).join(owners, "feed_url", "left")
    return _media(
        df, "press_release", {"bioguide_id": _s("bioguide_id"), "member_name": _s("member_name")},
        source_id=F.col("_id"), title=F.col("title"), content=X.strip_html("description"), url=_s("link"),
        author=_s("member_name"), published_date=F.col("_published"), member_bioguide_ids=_members("bioguide_id"))


def normalise_posts(raw: DataFrame) -> DataFrame:
    """Social posts: the title is the first hundred characters."""
    short = F.when(F.length("text") > 100, F.concat(F.left("text", F.lit(100)), F.lit("..."))).otherwise(F.col("text"))
    counts = {c: F.coalesce(F.col(f"public_metrics.{c}"), F.lit(0))
              for c in ("retweet_count", "like_count", "reply_count", "quote_count")}
    return _media(
        raw.filter("id <> '' and text <> ''"), "post",
        {"tweet_id": F.col("id"), "screen_name": _s("screen_name"), "bioguide_id": _s("bioguide_id"), **counts},
        source_id=F.col("id"), title=short, content=F.col("text"), author=_s("screen_name"),
        published_date=X.iso_date("created_at"), member_bioguide_ids=_members("bioguide_id"))


def normalise_videos(raw: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Videos with transcript; segments (video_id, position, text) are joined in order."""
    spoken = transcripts.groupBy("video_id").agg(
        F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("position", "text"))), lambda s: s["text"]), " ").alias("transcript"))
    df = raw.filter("video_id <> ''").join(spoken, "video_id", "left")
    return _media(
        df, "video",
        {"channel_id": _s("channel_id"), "channel_name": _s("channel_name"), "has_transcript": _s("transcript") != ""},
        source_id=F.col("video_id"), title=_s("title"), content=_s("transcript"),
        url=F.concat(F.lit("https://www.youtube.com/watch?v="), F.col("video_id")), published_date=X.iso_date("published"))


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def _items(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.format("xml").option("rowTag", "item").schema(FEED_ITEM_SCHEMA).load(path)
    return df.withColumn("feed_url", F.coalesce("feed_url", F.element_at(F.split(F.input_file_name(), "/"), -1)))


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    return normalise_transcripts(_json(spark, path, TRANSCRIPT_SCHEMA))


def read_news_a(spark: SparkSession, path: str) -> DataFrame:
    return normalise_news_a(_json(spark, path, NEWS_A_SCHEMA))


def read_news_b(spark: SparkSession, path: str) -> DataFrame:
    return normalise_news_b(_json(spark, path, NEWS_B_SCHEMA))


def read_rss(spark: SparkSession, path: str) -> DataFrame:
    return normalise_feed(_items(spark, path))


def read_press_releases(spark: SparkSession, path: str, feeds: DataFrame) -> DataFrame:
    """Feed files; a feed is known by its file name unless items carry feed_url."""
    return normalise_press_releases(_items(spark, path), feeds)


def read_posts(spark: SparkSession, path: str) -> DataFrame:
    return normalise_posts(_json(spark, path, POST_SCHEMA))


def read_videos(spark: SparkSession, path: str, transcripts: DataFrame) -> DataFrame:
    raw = spark.read.format("xml").option("rowTag", "entry").schema(VIDEO_SCHEMA).load(path)
    raw = raw.select(
        F.col("`yt:videoId`").alias("video_id"), "title", "published", F.col("author.uri").alias("channel_id"),
        F.col("author.name").alias("channel_name"))
    return normalise_videos(raw, transcripts)
