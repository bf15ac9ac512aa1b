"""Resolution of not-modified revisits in web archives.

A revisit record with status 304 holds no body; it stands for the latest earlier full response of the same
canonical URL, if the validators agree. The as-of join is a last-value window over the records of one URL. A URL
with very many captures is cut into spans of (time, record id) of even size; the last full response of each span is
handed to the next spans that need it, so that no task holds all captures of a URL.

Headers merge as a cache updates a stored response: what a 304 may change is taken from the revisit, all else
from the stored response. Header names are compared in lower case; of names that differ only by case the first counts.

Cases: every 304 revisit is returned. One without URL, time or record id matches nothing (`no_earlier_response`), and
such records answer nothing. Records of equal time are ordered by record id; only an earlier record can answer. A
missing validator on either side is not compared, null headers are none; if none can be compared, the revisit is not
resolved (`unvalidated`). A response without a body is no full response, one with an empty body is. Repeated rows are
resolved alike; of several bodies of one record the smallest is taken. Bodies are bytes of any length. Further columns
are not read, whatever their names. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, cut_points, piece_of, sortable

#: Header fields that a 304 response may change in the stored one (HTTP caching, "freshening").
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
VALIDATORS = ("etag", "last-modified")
#: Records of one span, and spans at most.
SPAN_ROWS, SPANS = 512, 4096
RECORD = "record_id long, url string, time timestamp, kind string, status int, headers map<string,string>, body binary"


def canonical_url(url: Column) -> Column:
    """Scheme-free, host in lower case without www. or default port, no fragment, no trailing slash, query fields sorted."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1)), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.array_join(F.array_sort(F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda x: x != "")), "&")
    return F.concat(host, path, F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)))


def strong(value: Column) -> Column:
    """An entity tag without its weakness mark."""
    return F.regexp_replace(F.trim(value), r"^W/", "")


def lower_names(headers: Column) -> Column:
    """The fields with their names in lower case; of names that differ only by case the first."""
    names = F.transform(F.map_keys(headers), lambda k: F.lower(k))
    return F.map_from_entries(F.filter(F.arrays_zip(names.alias("key"), F.map_values(headers).alias("value")), lambda x, i: F.array_position(names, x["key"]) == i + 1))


def resolve(records: DataFrame) -> DataFrame:
    """The 304 revisits of a record table (RECORD) with answered_by, outcome, merged headers, status and body."""
    full = (F.col("kind") == "response") & F.col("status").between(200, 299) & F.col("_has_body")
    revisit = (F.col("kind") == "revisit") & (F.col("status") == 304)
    canonical = canonical_url(F.col("url"))
    # bodies stay behind until it is known which are asked for
    headers = lower_names(F.coalesce("headers", F.create_map().cast("map<string,string>"))).alias("headers")
    slim = checkpoint(records.select("record_id", "url", "time", "kind", "status", headers, F.col("body").isNotNull().alias("_has_body"), canonical.alias("canonical")))
    known = F.col("canonical").isNotNull() & F.col("time").isNotNull() & F.col("record_id").isNotNull()
    rows = slim.filter(known).withColumn("_seen", F.when(full, F.struct("record_id", "time", "headers", "status")))
    # spans of time, alike for all URLs
    key = F.concat(sortable(F.unix_micros("time")), sortable(F.col("record_id")))
    span = piece_of(key, cut_points(rows, key, min(SPANS, -(-slim.count() // SPAN_ROWS))))
    rows = rows.withColumn("_span", span).withColumn("_order", F.struct("time", "record_id"))
    last = rows.filter(full).groupBy("canonical", "_span").agg(F.max("_order").alias("_last"))
    # what each span of a URL starts with: the last full response of its earlier spans; ids only, SPANS rows at most for a URL
    present = rows.select("canonical", "_span").distinct().join(last, ["canonical", "_span"], "left")
    before = Window.partitionBy("canonical").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    starts = present.withColumn("_from", F.last("_last", ignorenulls=True).over(before)).filter("_from is not null").select("canonical", F.col("_span").alias("_to"), "_from.*")
    handed = rows.filter(full).join(starts, ["canonical", "time", "record_id"]).dropDuplicates(["canonical", "_to"]).withColumn("_span", F.col("_to")).drop("_to").withColumn("_handed", F.lit(True))
    every = rows.withColumn("_handed", F.lit(False)).unionByName(handed)
    # rows of the very same time and id do not answer each other: the frame ends before the row's own order
    w = Window.partitionBy("canonical", "_span").orderBy("_order").rowsBetween(Window.unboundedPreceding, -1)
    asked = every.withColumn("_answer", F.last("_seen", ignorenulls=True).over(w)).filter(revisit & ~F.col("_handed"))

    header = lambda c, k: F.element_at(F.col(c), k)
    checks = []
    for v in VALIDATORS:
        mine, theirs = header("headers", v), header("_answer.headers", v)
        checks.append(F.when(mine.isNull() | theirs.isNull(), F.lit(None).cast("boolean")).otherwise(strong(mine) == strong(theirs)))
    tag, modified = checks
    agreed = F.coalesce(tag, modified)  # an entity tag, where both have one, decides alone
    outcome = F.when(F.col("_answer").isNull(), "no_earlier_response").when(agreed.isNull(), "unvalidated").when(agreed, "resolved").otherwise("validator_mismatch")
    rows = asked.withColumn("outcome", outcome)
    ok = F.col("outcome") == "resolved"
    fresh = F.map_filter("headers", lambda k, _: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter("_answer.headers", lambda k, _: ~F.array_contains(F.map_keys(fresh), k)), fresh)
    found = rows.select(
        "record_id", "url", "canonical", "time", "outcome",
        F.when(ok, F.col("_answer.record_id")).alias("answered_by"),
        F.when(ok, F.col("_answer.status")).alias("status"),
        F.when(ok, merged).alias("headers"),
        F.when(ok, F.col("_answer.time")).alias("_at"),
    )
    bodies = records.filter((F.col("kind") == "response") & F.col("body").isNotNull()).groupBy(F.col("record_id").alias("answered_by"), canonical.alias("canonical"), F.col("time").alias("_at")).agg(F.min(F.col("body").cast("binary")).alias("body"))
    answered = found.filter("answered_by is not null").join(bodies, ["answered_by", "canonical", "_at"]).select(*found.columns, "body")
    open_ = found.filter("answered_by is null").withColumn("body", F.lit(None).cast("binary"))
    lone = slim.filter(revisit & ~known).select("record_id", "url", "canonical", "time", F.lit("no_earlier_response").alias("outcome"))
    return answered.unionByName(open_).unionByName(lone, allowMissingColumns=True).drop("_at")


def header_text(headers: Column) -> Column:
    """Fields in the order of their names, one line each."""
    pairs = F.transform(F.array_sort(F.map_keys(headers)), lambda k: F.concat(k, F.lit(": "), F.element_at(headers, k)))
    return F.array_join(pairs, "\n")


def records_of_pages(pages: DataFrame) -> DataFrame:
    """Captures made of a page table, for want of archives: three for each page, and a fourth for every third.

    A full response at the time of the page's number; for every third page another one half a day later, with a new
    entity tag and body; a revisit a day later, which sends the latest tag, but a stale one for every seventh page,
    none for every fifth, and the first response's for every eleventh; and a revisit an hour before the page of its
    number, which only an earlier page of the same address can answer.
    """
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id") * 60)
    tag = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit(""))), F.lit('"'))
    stamp = lambda t: F.date_format(t, "yyyy-MM-dd HH:mm:ss")
    header = lambda **kv: F.map_filter(F.map_from_arrays(F.array(*[F.lit(k.replace("_", "-")) for k in kv]), F.array(*kv.values())), lambda _, v: v.isNotNull())
    base = pages.select("page_id", "url", F.col("html").cast("binary").alias("html"), at.alias("at"), tag.alias("tag"))
    number = lambda k: (F.col("page_id") * 4 + k).alias("record_id")
    no_body = F.lit(None).cast("binary").alias("body")

    def response(k: int, rows: DataFrame, time: Column, tag: Column, body: Column) -> DataFrame:
        return rows.select(number(k), "url", time.alias("time"), F.lit("response").alias("kind"), F.lit(200).alias("status"), header(etag=tag, last_modified=stamp(time), content_type=F.lit("text/html"), date=stamp(time)).alias("headers"), body.alias("body"))

    second, newer = F.concat(F.lit('"2'), F.substring("tag", 2, 99)), F.col("at") + F.expr("interval 12 hours")
    full = response(0, base, F.col("at"), F.col("tag"), F.col("html")).unionByName(response(3, base.filter("page_id % 3 = 0"), newer, second, F.concat("html", F.encode(F.lit("<!-- 2 -->"), "UTF-8"))))
    latest = F.when((F.col("page_id") % 3 == 0) & (F.col("page_id") % 11 != 0), second).otherwise(F.col("tag"))
    sent = F.when(F.col("page_id") % 7 == 0, F.lit('"stale"')).when(F.col("page_id") % 5 == 0, F.lit(None)).otherwise(F.concat(F.lit("W/"), latest))
    later = F.col("at") + F.expr("interval 1 day")
    again = base.select(number(1), "url", later.alias("time"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"), header(etag=sent, date=stamp(later), cache_control=F.lit("max-age=60"), content_type=F.lit("text/plain")).alias("headers"), no_body)
    sooner = F.col("at") - F.expr("interval 1 hour")
    early = base.select(number(2), F.concat("url", F.lit("#again")).alias("url"), sooner.alias("time"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"), header(last_modified=stamp(F.col("at"))).alias("headers"), no_body)
    return full.unionByName(again).unionByName(early)


def digest(resolved: DataFrame) -> DataFrame:
    return resolved.select("record_id", "canonical", "outcome", "answered_by", F.md5(header_text(F.col("headers"))).alias("headers_md5"), F.md5("body").alias("body_md5"))


DIGEST_SQL = r"""
with base as (
  select page_id, url, html, 1700000000 + page_id * 60 as ts, '"' || md5(coalesce(html, '')) || '"' as tag, '"2' || md5(coalesce(html, '')) || '"' as tag2 from pages
), rec as (
  select page_id * 4 as record_id, url, ts as t, 1 as full_response, tag as etag, ts as lm, cast(null as varchar) as cc, html as body from base
  union all
  select page_id * 4 + 3, url, ts + 43200, 1, tag2, ts + 43200, null, html || '<!-- 2 -->' from base where page_id % 3 = 0
  union all
  select page_id * 4 + 1, url, ts + 86400, 0, case when page_id % 7 = 0 then '"stale"' when page_id % 5 = 0 then null when page_id % 3 = 0 and page_id % 11 <> 0 then tag2 else tag end, null, 'max-age=60', null from base
  union all
  select page_id * 4 + 2, url || '#again', ts - 3600, 0, null, ts, null, null from base
), bare as (
  select *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') as b from rec
), parts as (
  select *, regexp_replace(regexp_replace(lower(regexp_extract(b, '^([^/?]*)', 1)), '^www\.', ''), ':(80|443)$', '')
            || regexp_replace(regexp_extract(b, '^[^/?]*([^?]*)', 1), '/+$', '') as front,
         array_to_string(list_sort(list_filter(string_split(regexp_extract(b, '\?(.*)$', 1), '&'), lambda x: x <> '')), '&') as q
  from bare
), canon as (
  select *, front || case when q = '' then '' else '?' || q end as canonical from parts
), answered as (
  select *, case when canonical is not null and t is not null then last_value(case when full_response = 1 and body is not null then record_id end ignore nulls)
              over (partition by canonical order by t, record_id rows between unbounded preceding and 1 preceding) end as a
  from canon
), judged as (
  select r.record_id, r.canonical, r.t, r.etag, r.lm, r.cc, f.record_id as a, f.etag as fe, f.lm as fl, f.t as ft, f.body as fb,
    case when f.record_id is null then 'no_earlier_response'
         when r.etag is not null then case when r.etag = f.etag then 'resolved' else 'validator_mismatch' end
         when r.lm is not null then case when r.lm = f.lm then 'resolved' else 'validator_mismatch' end
         else 'unvalidated' end as outcome
  from answered r left join canon f on f.record_id = r.a where r.full_response = 0
)
select record_id, canonical, outcome, case when outcome = 'resolved' then a end as answered_by,
  case when outcome = 'resolved' then md5(concat_ws(chr(10),
    case when cc is not null then 'cache-control: ' || cc end,
    'content-type: text/html',
    'date: ' || strftime(make_timestamp(cast(case when cc is not null then t else ft end as bigint) * 1000000), '%Y-%m-%d %H:%M:%S'),
    'etag: ' || case when etag is not null then 'W/' || etag else fe end,
    'last-modified: ' || strftime(make_timestamp(cast(coalesce(lm, fl) as bigint) * 1000000), '%Y-%m-%d %H:%M:%S'))) end as headers_md5,
  case when outcome = 'resolved' then md5(fb) end as body_md5
from judged
"""


#: What parts one record from the next in a file; it may also stand inside a body, where the record's length tells it.
BETWEEN = "\r\nWARC/1."


def parse_records(pieces: Iterator[bytes | None]) -> Iterator[tuple[dict[str, str], bytes] | None]:
    """Header fields (names in lower case) and block of each WARC record, from pieces of files cut at BETWEEN; None ends a file.

    One record is held at a time.
    """
    held: bytes | None = None
    wanted = 0
    for piece in pieces:
        if held is not None and piece is not None and len(held) < wanted:
            held += BETWEEN.encode() + piece  # the separator stood inside the block
            continue
        if held is not None:
            yield fields, held[start : start + size]
            held = None
        if piece is None:
            yield None
            continue
        end = piece.find(b"\r\n\r\n")
        lines = piece[: end if end >= 0 else len(piece)].decode("utf-8", "replace").split("\r\n")
        fields = dict((k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in lines[1:]))
        if end < 0 or "warc-type" not in fields:
            continue
        length = fields.get("content-length") or "0"
        size, start = int(length) if length.isdigit() else 0, end + 4
        held, wanted = piece, start + size
    if held is not None:
        yield fields, held[start : start + size]


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Response and revisit records of WARC files, plain or compressed, in the columns of RECORD; the id is a hash of the record's own id.

    Files are streamed record by record, and plain ones are split between tasks. Bodies stay bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces() -> Iterator[bytes | None]:
            last = None
            for batch in batches:
                for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if last is not None and name != last:
                        yield None
                    last = name
                    yield data

        rows, held = [], 0
        types = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.map_(pa.string(), pa.string()), pa.binary())
        out = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["rid", "url", "at", "kind", "status", "headers", "body"])
        for record in parse_records(pieces()):
            if record is None or record[0]["warc-type"] not in ("response", "revisit"):
                continue
            f, block = record
            head, _, body = block.partition(b"\r\n\r\n")
            lines = head.decode("latin-1").split("\r\n")
            status = lines[0].split(" ")[1] if lines[0].count(" ") else ""
            fields = [(k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in lines[1:]) if k]
            kind = f["warc-type"]
            rows.append((f.get("warc-record-id"), f.get("warc-target-uri"), f.get("warc-date"), kind, int(status) if status.isdigit() else None, list(dict(fields).items()), body if kind == "response" else None))
            held += len(body)
            if held > 16 << 20:
                yield out()
                rows, held = [], 0
        if rows:
            yield out()

    files = spark.read.option("lineSep", BETWEEN).text(path).select(F.input_file_name().alias("name"), F.col("value").cast("binary").alias("piece"))
    rows = files.mapInArrow(run, "rid string, url string, at string, kind string, status int, headers map<string,string>, body binary")
    return rows.select(F.xxhash64("rid").alias("record_id"), "url", F.try_to_timestamp("at").alias("time"), "kind", "status", "headers", "body")
