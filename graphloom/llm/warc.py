"""Resolution of not-modified revisit records against the latest earlier full response.

A crawl's log holds full responses and, for pages that had not changed, revisit
records without a body ("304"). ``resolve_revisits`` gives each revisit the body
of the latest response for the same canonical URL captured before it, if the
validators agree, and merges the headers that a 304 may update.

As-of join without a per-URL task. What a revisit gets depends on its URL and time
alone, so the search is over distinct pairs of these, and responses of one pair are
one. Times are cut into ranges of about as many records each, however they
cluster. Within (url, range) the latest response is a window's last value; across
ranges one row per (url, range) with responses carries it on. So a URL with a
third of all records is spread over all ranges, a time at which very many
records lie is one row, and what meets in one task to carry a URL on is at most two
rows a range.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import materialize, table
from graphloom.llm.components import join_hot

#: Header fields that a 304 answer may send to update a stored response (RFC 9111 section 3.2, RFC 9110 section 15.4.5).
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]
#: Query parameters that name the visit and not the page.
TRACKING = "utm_[a-z]+|ref|fbclid|gclid"


def canonical_url(url: Column) -> Column:
    """Lower-case host without www., no scheme, port 80/443, fragment, tracking parameters, .html or closing slash. Null stays null."""
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    u = F.regexp_replace(u, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(u, "^([^/?]*)", 1)), "^www\\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(u, "^[^/?]*([^?]*)", 1), "(\\.html?|/+)$", "")
    query = F.regexp_extract(u, "\\?(.*)$", 1)
    query = F.regexp_replace(F.concat(F.lit("&"), query), f"&({TRACKING})=[^&]*", "")
    query = F.regexp_replace(F.regexp_replace(query, "^&+", ""), "&+$", "")
    return F.when(url.isNotNull(), F.concat(host, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query))))


def time_range(records: DataFrame, ranges: int, accuracy: int = 10_000) -> DataFrame:
    """records with a column range: which of about `ranges` parts of about as many rows ts lies in; equal times lie in one."""
    edges = records.agg(F.percentile_approx("ts", [i / ranges for i in range(1, ranges)], accuracy)).first()[0] if ranges > 1 else None
    inner = sorted({float(e) for e in edges or []})
    if not inner:
        return records.withColumn("range", F.lit(0))
    cut = Bucketizer(splits=[float("-inf"), *inner, float("inf")], inputCol="_ts", outputCol="_range")
    return cut.transform(records.withColumn("_ts", F.col("ts").cast("double"))).withColumn("range", F.col("_range").cast("int")).drop("_ts", "_range")


def resolve_revisits(records: DataFrame, ranges: int = 512, permitted: list[str] = PERMITTED) -> DataFrame:
    """One row per revisit: record_id, canonical, status, response_id, payload_digest, headers.

    records: record_id long, url string, ts long, kind 'response' or 'revisit',
    etag string, last_modified string, payload_digest string, headers
    map<string,string> with lower-case names. Other columns are ignored.

    status: 'resolved' (an entity tag, weakly compared, or without one on both
    sides the last-modified dates agree), 'mismatch' (a validator that both
    sides have differs), 'unvalidated' (no validator that both have),
    'no_response' (no earlier response, or a null url or ts). Of responses at
    one time the one with the largest record_id counts (null the least); a response
    at the revisit's own time is not earlier. Only resolved rows have response_id,
    payload_digest and headers: the response's fields, with the permitted ones
    of the revisit put over them. Repeated revisits each give a row; rows of another
    or a null kind are passed over; of an empty table there are none."""
    rec = records.select("record_id", canonical_url(F.col("url")).alias("canonical"), F.col("ts").cast("long").alias("ts"), "kind", "etag", "last_modified", "payload_digest", "headers")
    usable = F.col("canonical").isNotNull() & F.col("ts").isNotNull()
    revisits = rec.filter(F.col("kind") == "revisit")
    # a map can be neither ordered nor compared, so the headers travel as entries
    answer = F.struct(F.col("record_id").alias("r_id"), F.col("etag").alias("r_etag"), F.col("last_modified").alias("r_mod"), F.col("payload_digest").alias("r_digest"), F.map_entries("headers").alias("r_headers"))
    given = rec.filter(usable & (F.col("kind") == "response")).groupBy("canonical", "ts").agg(F.max(answer).alias("answer"))
    asked = revisits.filter(usable).groupBy("canonical", "ts").agg(F.count("*").alias("n"))
    points = given.withColumn("n", F.lit(0).cast("long")).unionByName(asked.withColumn("answer", F.lit(None).cast(given.schema["answer"].dataType)))
    points = time_range(materialize(points, "points"), ranges)
    # at one time the question comes before the answer
    here = Window.partitionBy("canonical", "range").orderBy("ts", F.col("n") == 0)
    near = points.withColumn("found", F.last("answer", ignorenulls=True).over(here.rowsBetween(Window.unboundedPreceding, -1))).filter("n > 0").select("canonical", "ts", "range", "n", "found")
    # the latest response of each (url, range), and of the ranges before any range
    last = points.filter("n = 0").groupBy("canonical", "range").agg(F.max_by("answer", "ts").alias("latest"))
    open_ = near.filter(F.col("found").isNull()).select("canonical", "range").distinct().withColumn("latest", F.lit(None).cast(last.schema["latest"].dataType))
    steps = Window.partitionBy("canonical").orderBy("range", F.col("latest").isNotNull())
    carried = (
        last.select("canonical", "range", "latest").unionByName(open_)
        .withColumn("before", F.last("latest", ignorenulls=True).over(steps.rowsBetween(Window.unboundedPreceding, -1)))
        .filter(F.col("latest").isNull() & F.col("before").isNotNull()).select("canonical", "range", "before")
    )
    found = near.join(carried, ["canonical", "range"], "left").select("canonical", "ts", "n", F.coalesce("found", "before").alias("found"))
    found = materialize(found, "found")
    total = found.agg(F.sum("n")).first()[0] or 1
    columns = ["record_id", "canonical", "etag", "last_modified", "headers", "found"]
    lost = revisits.filter(~usable).withColumn("found", F.lit(None).cast(given.schema["answer"].dataType))
    out = join_hot(revisits.filter(usable), found, ["canonical", "ts"], "n", total).select(columns).unionByName(lost.select(columns))
    weak = lambda c: F.regexp_replace(c, "^W/", "")
    tags = F.col("etag").isNotNull() & F.col("found.r_etag").isNotNull()
    dates = F.col("last_modified").isNotNull() & F.col("found.r_mod").isNotNull()
    status = (
        F.when(F.col("found").isNull(), "no_response")
        .when(tags, F.when(weak(F.col("etag")) == weak(F.col("found.r_etag")), "resolved").otherwise("mismatch"))
        .when(dates, F.when(F.col("last_modified") == F.col("found.r_mod"), "resolved").otherwise("mismatch"))
        .otherwise("unvalidated")
    )
    theirs = F.coalesce(F.map_from_entries("found.r_headers"), F.expr("cast(map() as map<string,string>)"))
    ours = F.map_filter(F.coalesce("headers", F.expr("cast(map() as map<string,string>)")), lambda k, v: k.isin(permitted))
    merged = F.map_concat(F.map_filter(theirs, lambda k, v: ~F.map_contains_key(ours, k)), ours)
    done = out.withColumn("status", status)
    resolved = F.col("status") == "resolved"
    return done.select("record_id", "canonical", "status", F.when(resolved, F.col("found.r_id")).alias("response_id"), F.when(resolved, F.col("found.r_digest")).alias("payload_digest"), F.when(resolved, merged).alias("headers"))


def records_of_pages(pages: DataFrame) -> DataFrame:
    """A crawl log with a capture for every page: of the front page of its host and language.

    Three captures in ten are full responses. Their times are page_id div 3, so
    captures tie, but for every 250th, whose clock runs far ahead. A capture's
    entity tag and date name one of two states; some captures lack either or both."""
    i = F.col("page_id")
    day = F.when(i % 3 != 0, F.concat(F.lit("day "), F.when(i % 5 == 0, "2").otherwise("1")))
    tag = F.when(i % 4 != 1, F.concat(F.when(i % 2 == 0, "W/").otherwise(""), F.when(i % 7 == 0, '"b"').otherwise('"a"')))
    full = (i * 37 + F.floor(i / 11)) % 10 < 3
    seen = F.concat(F.lit("at "), i.cast("string"))
    headers = F.when(full, F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("cache-control"), F.lit("no-store"), F.lit("date"), seen))
    again = F.create_map(F.lit("content-type"), F.lit("text/plain"), F.lit("date"), seen, F.lit("vary"), F.lit("accept"))
    return pages.select(
        i.alias("record_id"), F.regexp_replace("url", "/[0-9]+", "").alias("url"), (F.floor(i / 3) + F.when(i % 250 == 249, 10**12).otherwise(0)).cast("long").alias("ts"), F.when(full, "response").otherwise("revisit").alias("kind"),
        tag.alias("etag"), day.alias("last_modified"), F.when(full, F.md5(F.coalesce("html", F.lit("")).cast("binary"))).alias("payload_digest"), F.coalesce(headers, again).alias("headers"))


def op9_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each page that is a revisit: page_id, canonical, status, response_page, payload_digest, and the merged headers as 'name=value' lines in order."""
    out = resolve_revisits(records_of_pages(table(spark, sf_dir, "pages")))
    lines = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "\n")
    return out.select(F.col("record_id").alias("page_id"), "canonical", "status", F.col("response_id").alias("response_page"), "payload_digest", lines.alias("headers"))


SQL = {"op9_warc_revisits": r"""
with base as (
  select page_id, page_id // 3 + case when page_id % 250 = 249 then 1000000000000 else 0 end as ts, (page_id * 37 + page_id // 11) % 10 < 3 as answers, md5(coalesce(html, '')) as digest, 'at ' || page_id as seen,
    case when page_id % 3 != 0 then 'day ' || case when page_id % 5 = 0 then '2' else '1' end end as day, case when page_id % 4 != 1 then case when page_id % 7 = 0 then '"b"' else '"a"' end end as tag,
    url, regexp_replace(regexp_replace(trim(regexp_replace(url, '/[0-9]+', '', 'g'), ' '), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') as u from pages),
parts as (
  select *, regexp_replace(regexp_replace(lower(regexp_extract(u, '^([^/?]*)', 1)), '^www\.', ''), ':(80|443)$', '') as host,
    regexp_replace(regexp_extract(u, '^[^/?]*([^?]*)', 1), '(\.html?|/+)$', '') as path,
    regexp_replace(regexp_replace(regexp_replace('&' || regexp_extract(u, '\?(.*)$', 1), '&(utm_[a-z]+|ref|fbclid|gclid)=[^&]*', '', 'g'), '^&+', ''), '&+$', '') as query from base),
keyed as (
  select *, case when url is not null then host || path || case when query = '' then '' else '?' || query end end as canonical from parts),
given as (select canonical, ts, max(page_id) as response_page from keyed where answers group by 1, 2),
found as (
  select a.page_id, a.canonical, a.seen, a.tag, a.day, g.response_page from (select * from keyed where not answers) a asof left join given g on a.canonical = g.canonical and a.ts > g.ts),
judged as (
  select f.*, r.digest, case when f.response_page is null then 'no_response'
    when f.tag is not null and r.tag is not null then case when f.tag = r.tag then 'resolved' else 'mismatch' end
    when f.day is not null and r.day is not null then case when f.day = r.day then 'resolved' else 'mismatch' end else 'unvalidated' end as status
  from found f left join keyed r on f.response_page = r.page_id)
select page_id, canonical, status, case when status = 'resolved' then response_page end as response_page,
  case when status = 'resolved' then digest end as payload_digest,
  case when status = 'resolved' then 'cache-control=no-store' || chr(10) || 'content-type=text/html' || chr(10) || 'date=' || seen || chr(10) || 'vary=accept' end as headers
from judged
"""}
QUERIES = {"op9_warc_revisits": op9_warc_revisits}
