"""Feed payloads -> postings. One landed payload per feed page; fetching is not done here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hiresift import schema as S
from hiresift.dims import DEFAULT, Dims
from hiresift.functions.text import is_relevant


def _text(col: Column, default: str = "") -> Column:
    return F.coalesce(col, F.lit(default))


def _amount(col: Column) -> Column:
    return F.coalesce(col.cast("double"), F.lit(0.0))


def _tagged(names: Column) -> Column:
    return F.coalesce(F.array_join(names, ", "), F.lit(""))


def _items(pages: DataFrame, postings: Column) -> DataFrame:
    """One row per posting: j, and of a page's further columns file and the posting's place on the page."""
    more = [F.col("file")] if "file" in pages.columns else []
    return pages.select(*more, F.posexplode(postings).alias("pos", "j"))


def _posting(item: DataFrame, prefix: str, source: str, **cols: Column) -> DataFrame:
    keep = ["file", "pos"] if "file" in item.columns else []
    cols = {"salary_min": F.lit(0.0), "salary_max": F.lit(0.0), "source": F.lit(source), **cols}
    cols["job_id"] = F.concat(F.lit(f"{prefix}_"), _text(cols["job_id"].cast("string")))
    return item.select(*keep, *[cols[f.name].cast(f.dataType).alias(f.name) for f in S.POSTING.fields])


def flatten_feed_a(pages: DataFrame, dims: Dims = DEFAULT) -> DataFrame:
    """pages: items array<struct>; the first element of a payload is a notice."""
    j = F.col("j")
    rows = _items(pages, F.slice("items", 2, F.greatest(F.size("items"), F.lit(1))))
    out = _posting(
        rows, "remoteok", "remoteok",
        job_id=j["id"], title=_text(j["position"]), company=_text(j["company"]),
        description=_text(j["description"]), location=_text(j["location"], "Remote"),
        job_type=F.lit("remote"), salary_min=_amount(j["salary_min"]),
        salary_max=_amount(j["salary_max"]), tags=_tagged(j["tags"]),
        apply_url=_text(j["apply_url"]), date_posted=_text(j["date"]),
    )
    return out.where(is_relevant(F.col("title"), F.col("tags"), F.col("description"), dims))


def flatten_feed_b(pages: DataFrame, dims: Dims = DEFAULT) -> DataFrame:
    """pages: data array<struct>; a flag tells remote from onsite, the date is a number."""
    j = F.col("j")
    out = _posting(
        _items(pages, F.col("data")), "arbeitnow", "arbeitnow",
        job_id=j["slug"], title=_text(j["title"]), company=_text(j["company_name"]),
        description=_text(j["description"]), location=_text(j["location"]),
        job_type=F.when(j["remote"], F.lit("remote")).otherwise(F.lit("onsite")),
        tags=_tagged(j["tags"]), apply_url=_text(j["url"]),
        date_posted=_text(j["created_at"].cast("string")),
    )
    return out.where(is_relevant(F.col("title"), F.col("tags"), F.col("description"), dims))


def flatten_feed_c(pages: DataFrame, dims: Dims = DEFAULT) -> DataFrame:
    """pages: results array<struct>; category names are the tags, the first location counts."""
    j = F.col("j")
    out = _posting(
        _items(pages, F.col("results")), "muse", "themuse",
        job_id=j["id"], title=_text(j["name"]), company=_text(j["company"]["name"]),
        description=_text(j["contents"]),
        location=_text(F.get(j["locations"], F.lit(0))["name"]),
        job_type=_text(j["type"]),
        tags=_tagged(F.transform(j["categories"], lambda c: _text(c["name"]))),
        apply_url=_text(j["refs"]["landing_page"]), date_posted=_text(j["publication_date"]),
    )
    return out.where(is_relevant(F.col("title"), F.col("tags"), F.col("description"), dims))


def flatten_feed_d(pages: DataFrame, dims: Dims = DEFAULT) -> DataFrame:
    """pages: results array<struct>; only the title decides whether a row is relevant."""
    j = F.col("j")
    out = _posting(
        _items(pages, F.col("results")), "adzuna", "adzuna",
        job_id=j["id"], title=_text(j["title"]), company=_text(j["company"]["display_name"]),
        description=_text(j["description"]), location=_text(j["location"]["display_name"]),
        job_type=_text(j["contract_time"]), salary_min=_amount(j["salary_min"]),
        salary_max=_amount(j["salary_max"]), tags=_text(j["category"]["label"]),
        apply_url=_text(j["redirect_url"]), date_posted=_text(j["created"]),
    )
    return out.where(is_relevant(F.col("title"), F.lit(""), F.lit(""), dims))


# Feed name -> (payload schema, flatten function), in arrival order.
FEEDS = {
    "a": (S.FEED_A, flatten_feed_a),
    "b": (S.FEED_B, flatten_feed_b),
    "c": (S.FEED_C, flatten_feed_c),
    "d": (S.FEED_D, flatten_feed_d),
}


def parse_payload(payloads: DataFrame, feed: str) -> DataFrame:
    """payloads: one JSON text per row in column ``payload`` -> the typed pages; a column ``file`` is kept."""
    keep = ["file"] if "file" in payloads.columns else []
    page = payloads.select(*keep, F.from_json("payload", FEEDS[feed][0]).alias("page"))
    return page.select(*keep, F.col("page").alias("items")) if feed == "a" else page.select(*keep, "page.*")


def flatten_feed(payloads: DataFrame, feed: str, dims: Dims = DEFAULT) -> DataFrame:
    """Postings of a feed's payloads; where they have a column ``file``, also file and pos, their place on the page."""
    return FEEDS[feed][1](parse_payload(payloads, feed), dims)


def feed_rejects(payloads: DataFrame, feed: str) -> DataFrame:
    """Payloads that ``flatten_feed`` gets no page from, all columns kept, with the reason.

    "not json": the text is null or broken; "no list": it is JSON but its list of postings is missing or of
    another kind. An empty list is a page without postings, and no reject.
    """
    return payloads.where(_listed(feed).isNull()).withColumn("reason", _reason())


def _listed(feed: str) -> Column:
    """The list of postings of a payload, null without one."""
    page = F.from_json("payload", FEEDS[feed][0])
    # a lone object would pass as a list of one
    return F.when(F.col("payload").rlike(r"^\s*\["), page) if feed == "a" else page[FEEDS[feed][0].names[0]]


def _reason() -> Column:
    return F.when(F.get_json_object("payload", "$").isNull(), F.lit("not json")).otherwise(F.lit("no list"))


def read_payloads(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """Landed files, one payload per line; with ``whole_files`` one per file, whose text may span lines."""
    return spark.read.text(path, wholetext=whole_files).withColumnRenamed("value", "payload")


def landed_payloads(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Stream of landed payload files, one payload each: payload, file, feed.

    Files lie anywhere below the path, in a folder ``feed=<name>`` of their feed; those of a feed count as arrived in the order of
    their paths.
    """
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    file = F.col("_metadata.file_path")
    return reader.text(path, wholetext=True, recursiveFileLookup=True).select(
        F.col("value").alias("payload"), file.alias("file"), F.regexp_extract(file, "/feed=([^/]*)/", 1).alias("feed"))


def arrivals(payloads: DataFrame, dims: Dims = DEFAULT) -> DataFrame:
    """Postings of the payloads of all feeds with their place in the order of arrival: feed_ord, file, pos."""
    return union_feeds({f: flatten_feed(payloads.where(F.col("feed") == f).drop("feed"), f, dims) for f in FEEDS})


def all_rejects(payloads: DataFrame) -> DataFrame:
    """Rejected payloads of all feeds: feed, file, payload, reason; those of a feed that is not known as well."""
    # in one pass: a payload is parsed as one of its own feed
    broken = F.lit(False)
    for feed in FEEDS:
        broken = F.when(F.col("feed") == feed, _listed(feed).isNull()).otherwise(broken)
    known = F.col("feed").isin(list(FEEDS))
    reason = F.when(~known, F.lit("no such feed")).otherwise(_reason())
    return payloads.where(~known | broken).select("feed", "file", "payload", reason.alias("reason"))


def union_feeds(postings: dict[str, DataFrame]) -> DataFrame:
    """All feeds in one frame; ``feed_ord`` keeps the fixed arrival order of the feeds."""
    out = None
    for order, feed in enumerate(FEEDS):
        if feed in postings:
            part = postings[feed].withColumn("feed_ord", F.lit(order))
            out = part if out is None else out.unionByName(part)
    return out
