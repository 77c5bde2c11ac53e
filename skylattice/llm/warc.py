"""Not-modified revisits of web archives, resolved to the full responses that they stand for.

A revisit (a 304 kept as a record) has no body. It stands for the latest earlier full response of
the same canonical URL, if the validators agree: the entity tags, weakly compared, where both have
one, else equal Last-Modified. The revisit may then update the headers that a 304 is permitted to
(PERMITTED); all others stay those of the response.

The as-of join cuts each URL's history into slices of SLICE seconds: the last response of each
slice is found first, carried into the slices after it, and stands there as one more row. So a URL
that a third of all captures name is spread over its slices, and no slice waits for another.

Defined results: earlier means a smaller time, or the same time and a smaller record id; records
without URL or time stay unresolved ("no_response"); null headers count as none; a response that
repeats is as good as one; status is one of resolved, no_response, no_validator, mismatch; unless
resolved, response_id is -1 and payload and headers are empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import textkit as tk

PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
SLICE = 86_400
CANONICAL = (
    (r"#.*$", ""),
    (r"^([a-z]+://)(?:www\d*\.|m\.)", "$1"),
    (r"^(http://[^/?]*):80(?=[/?]|$)", "$1"),
    (r"^(https://[^/?]*):443(?=[/?]|$)", "$1"),
    (r"^https?://", ""),
    (r"([?&])(?:ref|utm_[a-z]+|sessionid)=[^&]*", "$1"),
    (r"[?&]+$", ""),
    (r"([?&])&+", "$1"),
    (r"/+$", ""),
)


def canonical_url(url: Column) -> Column:
    """Scheme, default port, www or m host prefix, fragment, tracking parameters and closing slashes go; the host is lower case."""
    host = F.regexp_extract(F.trim(url), r"^[A-Za-z]+://[^/?#]*", 0)
    url = F.concat(F.lower(host), F.substring(F.trim(url), F.length(host) + 1, F.length(F.trim(url))))
    for pattern, to in CANONICAL:
        url = F.regexp_replace(url, pattern, to)
    return url


def header(headers: Column, name: str) -> Column:
    return F.try_element_at(headers, F.lit(name))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row for each revisit of records (record_id, url, at seconds, kind response|revisit, headers, payload).

    payload names the stored body (a digest or a place in a file), never the body itself."""
    rows = tk.only(records, "record_id", "url", "at", "kind", "headers", "payload")
    rows = rows.withColumn("headers", F.coalesce("headers", F.create_map().cast("map<string,string>")))
    rows = rows.withColumns({"key": canonical_url(F.col("url")), "slice": F.floor(F.col("at") / SLICE)})
    full = F.struct("at", "record_id", "headers", "payload")
    order = F.struct("at", "record_id")
    known = F.col("key").isNotNull() & F.col("at").isNotNull()

    last = rows.where(known & (F.col("kind") == "response")).groupBy("key", "slice").agg(F.max_by(full, order).alias("last"))
    slices = rows.where(known).select("key", "slice").distinct().join(last, ["key", "slice"], "left")
    earlier = Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = slices.select("key", "slice", F.last("last", ignorenulls=True).over(earlier).alias("full")).where("full is not null")
    carried = carried.select("key", "slice", F.lit(None).cast("bigint").alias("at"), F.lit(None).cast("bigint").alias("record_id"), F.lit(None).cast("string").alias("url"), F.lit("carried").alias("kind"), F.lit(None).cast("map<string,string>").alias("headers"), "full")
    own = rows.where(known).select("key", "slice", "at", "record_id", "url", "kind", "headers", F.when(F.col("kind") == "response", full).alias("full"))
    so_far = Window.partitionBy("key", "slice").orderBy(F.col("at").asc_nulls_first(), F.col("record_id").asc_nulls_first(), "kind").rowsBetween(Window.unboundedPreceding, -1)
    joined = own.unionByName(carried).withColumn("full", F.last("full", ignorenulls=True).over(so_far))
    unknown = rows.where(~known).select("key", "slice", "at", "record_id", "url", "kind", "headers", F.lit(None).cast(joined.schema["full"].dataType).alias("full"))
    found = joined.unionByName(unknown).where("kind = 'revisit'")

    tags = [F.regexp_replace(header(h, "etag"), r"^W/", "") for h in (F.col("headers"), F.col("full.headers"))]
    dates = [header(h, "last-modified") for h in (F.col("headers"), F.col("full.headers"))]
    agree = F.when(tags[0].isNotNull() & tags[1].isNotNull(), tags[0] == tags[1]).otherwise(dates[0] == dates[1])
    status = F.when(F.col("full").isNull(), "no_response").when(agree.isNull(), "no_validator").when(agree, "resolved").otherwise("mismatch")
    ok = F.col("status") == "resolved"
    update = F.map_filter("headers", lambda k, v: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter("full.headers", lambda k, v: ~F.map_contains_key("permitted", k)), F.col("permitted"))
    found = found.withColumns({"status": status, "permitted": update}).withColumn("merged", F.when(ok, merged))
    return found.select(
        "record_id",
        F.col("key").alias("canonical_url"),
        "at",
        "status",
        F.when(ok, F.col("full.record_id")).otherwise(-1).alias("response_id"),
        F.when(ok, F.coalesce("full.payload", F.lit(""))).otherwise("").alias("payload"),
        F.when(ok, F.array_join(F.array_sort(F.transform(F.map_entries("merged"), lambda e: F.concat_ws(": ", e["key"], e["value"]))), "\n")).otherwise("").alias("headers"),
    )


#: Captures derived from a page: a response, revisits before and after it, one of which has changed validators.
CAPTURES = ((0, "response", 0), (1, "revisit", 4_000), (2, "revisit", 90_000), (3, "response", 200_000), (4, "revisit", 200_000), (5, "revisit", 460_000), (6, "revisit", -50))


def page_records(pages: DataFrame) -> DataFrame:
    """Archive records derived from pages: each page is captured len(CAPTURES) times from a time set by its id."""
    rows = tk.only(pages, "page_id", "url", "html")
    page = rows.select("page_id", "url", F.sha2(F.coalesce("html", F.lit("")), 256).alias("digest"))
    capture = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(kind).alias("kind"), F.lit(shift).cast("bigint").alias("shift")) for k, kind, shift in CAPTURES))).alias("c")
    page = page.select("page_id", "url", "digest", capture).select("page_id", "url", "digest", "c.*")
    version = F.when(F.col("k") >= 3, F.lit("b")).otherwise(F.lit("a"))
    version = F.when((F.col("k") == 5) & (F.col("page_id") % 3 == 0), F.lit("c")).otherwise(version)
    tag = F.when((F.col("page_id") + F.col("k")) % 5 != 4, F.concat(F.when(F.col("k") % 2 == 1, "W/").otherwise(""), F.lit('"'), F.substring("digest", 1, 16), version, F.lit('"')))
    date = F.when((F.col("page_id") + F.col("k")) % 7 != 6, F.concat(F.lit("day "), (F.col("page_id") % 1000 + F.when(F.col("k") >= 3, 2).otherwise(0)).cast("string")))
    names = ["etag", "last-modified", "date", "content-type", "content-length", "cache-control"]
    at = F.col("page_id") % 5000 * 600 + F.col("shift")
    response = F.col("kind") == "response"
    values = [tag, date, at.cast("string"), F.when(response, "text/html"), F.lit("0"), F.when(F.col("k") % 3 == 0, "no-cache").otherwise("max-age=60")]
    pairs = F.filter(F.array(*(F.struct(F.lit(n).alias("key"), v.alias("value")) for n, v in zip(names, values, strict=True))), lambda e: e["value"].isNotNull())
    url = F.when(F.col("k") % 2 == 1, F.concat("url", F.lit("#part"))).otherwise(F.col("url"))
    return page.select((F.col("page_id") * 8 + F.col("k")).alias("record_id"), url.alias("url"), at.alias("at"), "kind", F.map_from_entries(pairs).alias("headers"), F.concat(F.lit("sha256:"), "digest", version).alias("payload"))


def op2_not_modified_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve_revisits(page_records(tk.table(spark, sf_dir, "pages")))


def canonical_sql(url: str) -> str:
    host = f"regexp_extract(trim({url}, ' '), '^[A-Za-z]+://[^/?#]*', 0)"
    url = f"lower({host}) || substr(trim({url}, ' '), length({host}) + 1)"
    for pattern, to in CANONICAL:
        pattern = pattern.replace("(?=[/?]|$)", "([/?]|$)")
        to = (to + r"\2" if "([/?]|$)" in pattern else to).replace("$1", r"\1")
        url = f"regexp_replace({url}, '{pattern}', '{to}', 'g')"
    return url


ORACLE = f"""
with captures(k, kind, shift) as (values {", ".join(f"({k}, '{kind}', {shift})" for k, kind, shift in CAPTURES)}),
page as (select page_id, sha256(coalesce(html, '')) as digest, c.*, case when k % 2 = 1 then url || '#part' else url end as url,
  case when k = 5 and page_id % 3 = 0 then 'c' when k >= 3 then 'b' else 'a' end as version from pages, captures c),
records as (select page_id * 8 + k as record_id, {canonical_sql("url")} as key, page_id % 5000 * 600 + shift as ts, kind,
  'sha256:' || digest || version as payload,
  case when (page_id + k) % 5 != 4 then (case when k % 2 = 1 then 'W/' else '' end) || '"' || substr(digest, 1, 16) || version || '"' end as etag,
  case when (page_id + k) % 7 != 6 then 'day ' || (page_id % 1000 + case when k >= 3 then 2 else 0 end) end as modified,
  case when k % 3 = 0 then 'no-cache' else 'max-age=60' end as cache from page),
found as (select v.record_id, v.key, v.ts, v.etag, v.modified, v.cache, (
    select max(struct_pack(ts := r.ts, record_id := r.record_id, payload := r.payload, etag := r.etag, modified := r.modified)) from records r
    where r.kind = 'response' and r.key = v.key and (r.ts < v.ts or (r.ts = v.ts and r.record_id < v.record_id))) as f
  from records v where v.kind = 'revisit'),
judged as (select *, case when f is null then 'no_response'
    when (case when etag is not null and f.etag is not null then regexp_replace(etag, '^W/', '') = regexp_replace(f.etag, '^W/', '') else modified = f.modified end) is null then 'no_validator'
    when (case when etag is not null and f.etag is not null then regexp_replace(etag, '^W/', '') = regexp_replace(f.etag, '^W/', '') else modified = f.modified end) then 'resolved'
    else 'mismatch' end as status from found)
select record_id, key as canonical_url, ts as "at", status,
  case when status = 'resolved' then f.record_id else -1 end as response_id, case when status = 'resolved' then f.payload else '' end as payload,
  case when status = 'resolved' then concat_ws(chr(10), 'cache-control: ' || cache, 'content-length: 0', 'content-type: text/html', 'date: ' || ts,
    'etag: ' || coalesce(etag, f.etag), 'last-modified: ' || coalesce(modified, f.modified)) else '' end as headers
from judged
"""
