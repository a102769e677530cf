"""WARC archives written and read by Spark's text files, with records told from look-alikes by chains from each file's start.

Writing: one record per page; of pages with equal payloads of ``LEAST`` bytes only the one with the largest page_id holds the
payload, the others are revisit records that refer to it. A record is one row of text, and rows are separated by the two line
ends that close a record.

Reading: files are split by byte ranges. Rows are what lies between two magic lines, so some begin a record and others lie inside
a payload that quotes a record. Each row that could be a record names its successor's offset. Rows of one byte range are contracted
to where the chain leaves the range; over ranges the chains are followed from offset 0 by pointer jumping. Only reached
rows are records; what a payload quotes is joined to it again.

Rows: a null html counts as empty. A null page_id is smaller than any number; pages that share the largest page_id of equal
payloads are all responses, and repeated rows give repeated records with one record id. A null url is left out of the record; line
ends inside a url are percent-encoded. Extra columns are not read. What follows a broken or cut record in a file is not read.
Only narrow rows are shuffled; payloads of records that hold a magic line meet again by record.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from skyfence.llm.common import stored

MAGIC, END = "WARC/1.1\r\n", "\r\n\r\n"
#: Payloads of at least so many bytes are written once.
LEAST = 1000
#: Revisits of one response meet it under so many keys.
SALTS = 64
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _line(name: str, value: Column) -> Column:
    return F.when(value.isNull(), F.lit("")).otherwise(F.concat(F.lit(name + ": "), value, F.lit("\r\n")))


def _id(page_id: Column, url: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws("\n", F.coalesce(page_id, F.lit("-")), F.coalesce(url, F.lit("-")), digest).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"), F.lit(">"))


def write_archives(pages: DataFrame, path: str, least: int = LEAST, date: str = "2000-01-01T00:00:00Z") -> None:
    """One record per row of ``pages`` (page_id, url, html), one archive file per task, at ``path``."""
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.select("*", F.octet_length("html").alias("bytes"), F.sha1(F.col("html").cast("binary")).alias("digest"), F.xxhash64("html").alias("h"))
    same = ["digest", "bytes", "h"]
    # A url rides along, so that the response's id can be told without its row.
    groups = rows.where(F.col("bytes") >= least).groupBy(*same).agg(F.max(F.struct("page_id", "url")).alias("kept"), F.count("*").alias("n")).where("n > 1").drop("n")
    # Written first: Spark knows its size then, and pages need not be shuffled to meet a short table.
    rows = rows.join(stored(groups, "warc-copies"), same, "left")
    text = F.col("page_id").cast("string")
    revisit = F.col("kept.page_id").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("kept.page_id")))
    uri = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, "html"))
    record = F.concat(
        F.lit(MAGIC), F.lit("WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")), F.lit("\r\n"),
        _line("WARC-Record-ID", _id(text, F.col("url"), F.col("digest"))), F.lit(f"WARC-Date: {date}\r\n"),
        _line("WARC-Target-URI", uri), _line("WARC-Page-ID", F.url_encode(text)), _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _line("WARC-Profile", F.when(revisit, F.lit(PROFILE))), _line("WARC-Refers-To", F.when(revisit, _id(F.col("kept.page_id").cast("string"), F.col("kept.url"), F.col("digest")))),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(END), block)
    rows.select(record.alias("record")).write.option("lineSep", END).text(path)


def _scan(spark: SparkSession, path: str) -> DataFrame:
    """Rows between magic lines: file, block (byte range), place (order in a task), size of the file, value."""
    rows = spark.read.schema("value string").option("lineSep", MAGIC).text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), F.col("_metadata.file_size").alias("file_size"), "value")


def _fields(value: Column) -> dict[str, Column]:
    """What a row says of itself if it is a record; ``length`` is null where it cannot be one."""
    head = F.substring_index(value, END, 1)
    lines = F.concat(F.lit("\r\n"), head, F.lit("\r\n"))
    field = lambda name: F.nullif(F.regexp_extract(lines, rf"(?i)\r\n{name}:[ \t]*([^\r\n]*?)[ \t]*\r\n", 1), F.lit(""))
    ended = F.octet_length(head) < F.octet_length(value)
    block = F.octet_length(head) + len(END)
    length = F.when(ended & field("WARC-Type").isNotNull(), F.regexp_extract(lines, r"(?i)\r\nContent-Length:[ \t]*(\d{1,18})[ \t]*\r\n", 1).try_cast("bigint"))
    return {"head": block.cast("bigint"), "length": length, "record_type": field("WARC-Type"), "record_id": field("WARC-Record-ID"), "refers": field("WARC-Refers-To"),
            "url": field("WARC-Target-URI"), "page": F.url_decode(field("WARC-Page-ID"))}


def _payload(value: Column, head: Column, length: Column) -> Column:
    """Bytes behind the HTTP header of a record's block; the block itself where it has none."""
    block = F.substring(value.cast("binary"), head.cast("int") + 1, length.cast("int"))
    http = F.substring_index(block.cast("string"), END, 1)
    skip = F.when(F.startswith(http, F.lit("HTTP/")) & (F.octet_length(http) < length), F.octet_length(http) + len(END)).otherwise(0)
    return F.substring(block, skip + 1, F.octet_length(block) - skip)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """Narrow rows of the archives with their offsets, and the digest of what may be a whole record's payload."""
    rows = _scan(spark, path)
    fields = _fields(F.col("value"))
    rows = rows.select("*", F.octet_length("value").cast("bigint").alias("size"), *(c.alias(k) for k, c in fields.items()))
    whole = F.col("length").isNotNull() & (F.col("head") + F.col("length") <= F.col("size"))
    payload = _payload(F.col("value"), F.col("head"), F.col("length"))
    rows = rows.select(*[c for c in rows.columns if c != "value"], F.when(whole, F.sha1(payload)).alias("digest"), F.when(whole, F.octet_length(payload).cast("bigint")).alias("bytes"))
    rows = stored(rows, "warc-rows")
    step = F.col("size") + len(MAGIC)
    blocks = rows.groupBy("file", "block").agg(F.sum(step).alias("total"))
    before = F.coalesce(F.sum("total").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("file", "block", before.alias("before"))
    inside = F.coalesce(F.sum(step).over(Window.partitionBy("file", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("inside", inside).join(blocks, ["file", "block"])
    # The first row of a file lies before its first magic line and begins no record.
    rows = rows.withColumn("off", F.col("before") + F.col("inside") - len(MAGIC)).drop("before", "inside")
    succ = F.col("off") + len(MAGIC) + F.col("head") + F.col("length") + len(END)
    return stored(rows.withColumn("succ", F.when((F.col("off") >= 0) & (succ <= F.col("file_size")), succ)), "warc-pieces")


def following(off: np.ndarray, succ: np.ndarray) -> np.ndarray:
    """Index of each row's successor among the rows (sorted by offset); its own index where that is none of them."""
    to = np.searchsorted(off, succ)
    there = np.minimum(to, len(off) - 1)
    return np.where((to < len(off)) & (off[there] == succ), there, np.arange(len(off)))


def _sorted(rows: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    rows = rows.sort_by("off")
    return rows, rows.column("off").to_numpy(), rows.column("succ").to_numpy()


def _exits(key: tuple, rows: pa.Table) -> pa.Table:
    """Where the chain from each row leaves the byte range."""
    rows, off, succ = _sorted(rows)
    to = following(off, succ)
    while (to[to] != to).any():
        to = to[to]
    return pa.table({"file": rows.column("file"), "block": rows.column("block"), "off": pa.array(off), "succ": pa.array(succ), "leaves": pa.array(succ[to])})


def _reached(key: tuple, rows: pa.Table) -> pa.Table:
    """Rows of a byte range that its entries reach."""
    rows, off, succ = _sorted(rows)
    hit, to = rows.column("entry").to_numpy(zero_copy_only=False).astype(bool), following(off, succ)
    while True:
        more = hit.copy()
        more[to[hit]] = True
        if (more == hit).all() and (to[to] == to).all():
            break
        hit, to = more, to[to]
    hit = np.flatnonzero(hit)
    return pa.table({"file": rows.column("file").take(pa.array(hit)), "off": pa.array(off[hit])})


def reachable(pieces: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(file, off) of the rows that chains from offset 0 of their files reach, from candidates (file, block, off, succ)."""
    narrow = pieces.where("succ is not null").select("file", "block", "off", "succ")
    links = stored(narrow.groupBy("file", "block").applyInArrow(_exits, "file string, block bigint, off bigint, succ bigint, leaves bigint"), "warc-links")
    entries = links.select("file", F.col("leaves").alias("off")).distinct()
    jump = stored(links.join(entries, ["file", "off"], "left_semi").unionByName(links.where("off = 0")).select("file", "off", "leaves").distinct(), "warc-jumps")
    nodes = jump.select("file", "off")
    reached = jump.where("off = 0").select("file", "off")
    n = reached.count()
    for _ in range(most_rounds):
        further = jump.join(reached, ["file", "off"], "left_semi").select("file", F.col("leaves").alias("off")).join(nodes, ["file", "off"], "left_semi")
        reached = stored(reached.unionByName(further).distinct(), "warc-reached")
        before, n = n, reached.count()
        if n == before:
            break
        to = jump.select("file", F.col("off").alias("leaves"), F.col("leaves").alias("further"))
        jump = stored(jump.join(to, ["file", "leaves"], "left").select("file", "off", F.coalesce("further", "leaves").alias("leaves")), "warc-jumps")
    else:
        raise RuntimeError("chains of records did not end")
    marked = links.join(reached.withColumn("entry", F.lit(True)), ["file", "off"], "left").select("file", "block", "off", "succ", F.coalesce("entry", F.lit(False)).alias("entry"))
    return marked.groupBy("file", "block").applyInArrow(_reached, "file string, off bigint")


RECORD = ["file", "off", "record_type", "record_id", "refers", "url", "page", "bytes", "digest"]


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """file, off, record_type, record_id, refers, url, page, bytes, digest (and payload) of every record of the archives at ``path``.

    bytes and digest are those of the record's own payload, without HTTP header.
    """
    pieces = _pieces(spark, path)
    real = reachable(pieces).withColumn("real", F.lit(True))
    pieces = stored(pieces.join(real, ["file", "off"], "left").withColumn("real", F.coalesce("real", F.lit(False))), "warc-real")
    records = pieces.where("real")
    whole = F.col("digest").isNotNull()
    quoting = records.where(~whole)
    if payloads or quoting.limit(1).count():
        wanted = _owners(pieces)
        wanted = wanted if payloads else wanted.join(quoting.select("file", F.col("off").alias("owner")), ["file", "owner"], "left_semi")
        glued = _glued(spark, path, stored(wanted, "warc-wanted"))
        out = glued if payloads else records.where(whole).select(RECORD).unionByName(glued.select(RECORD))
        return out
    return records.select(RECORD)


def _owners(pieces: DataFrame) -> DataFrame:
    """file, block, place, size, off of every row inside a record, with the record's offset ``owner``."""
    start = F.when(F.col("real"), F.col("off"))
    blocks = pieces.groupBy("file", "block").agg(F.max(start).alias("last"))
    carried = F.max("last").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("file", "block", carried.alias("carried"))
    own = F.last(start, ignorenulls=True).over(Window.partitionBy("file", "block").orderBy("off").rowsBetween(Window.unboundedPreceding, 0))
    rows = pieces.select("file", "block", "place", "size", "off", own.alias("own")).join(blocks, ["file", "block"])
    rows = rows.select("file", "block", "place", "size", "off", F.coalesce("own", "carried").alias("owner"))
    ends = pieces.where("real").select("file", F.col("off").alias("owner"), "succ")
    return rows.join(ends, ["file", "owner"]).where("off < succ").drop("succ")


def _glued(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """Records put together from their rows, read again. Both readings must cut the files alike, which is checked."""
    rows = _scan(spark, path).select("file", "block", "place", F.octet_length("value").cast("bigint").alias("size"), "value").join(wanted, ["file", "block", "place", "size"])
    whole = rows.groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("off", "value"))).alias("parts"))
    expected = wanted.groupBy("file", "owner").agg(F.count("*").alias("n"))
    whole = expected.join(whole, ["file", "owner"], "left")
    value = F.when(F.size("parts") == F.col("n"), F.array_join(F.transform("parts", lambda p: p["value"]), MAGIC)).otherwise(F.raise_error(F.lit("the archives were split differently")))
    whole = whole.select("file", F.col("owner").alias("off"), value.alias("value"))
    whole = whole.select("file", "off", "value", *(c.alias(k) for k, c in _fields(F.col("value")).items()))
    payload = _payload(F.col("value"), F.col("head"), F.col("length"))
    return whole.withColumn("payload", payload).select(*RECORD[:7], F.octet_length("payload").cast("bigint").alias("bytes"), F.sha1("payload").alias("digest"), "payload")


def page_records(records: DataFrame, page_type: DataType) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record; revisits by the response they refer to."""
    revisit = F.col("record_type") == "revisit"
    salt = F.pmod(F.xxhash64("file", "off"), F.lit(SALTS))
    rows = records.select(F.col("page").cast(page_type).alias("page_id"), "record_type", F.when(revisit, F.col("refers")).alias("refers"), "bytes", "digest", "record_id", F.when(revisit, salt).alias("salt"))
    # A response may have any number of revisits: they meet it under salts, and only responses that are referred to are dealt out.
    named = rows.where("refers is not null").select("refers", "salt").distinct()
    responses = rows.where("record_type = 'response'").groupBy("record_id").agg(F.max("page_id").alias("refers_to"), F.max("bytes").alias("full_bytes"), F.max("digest").alias("full_digest"))
    responses = named.join(responses, named["refers"] == responses["record_id"]).drop("record_id")
    again = rows.where(revisit).join(responses, ["refers", "salt"], "left").select("page_id", F.col("full_bytes").alias("payload_bytes"), F.col("full_digest").alias("payload_digest"), "record_type", "refers_to")
    first = rows.where(~revisit).select("page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", F.lit(None).cast(page_type).alias("refers_to"))
    return first.unionByName(again)


#: The same in DuckDB's SQL; {pages}: a table with page_id and html.
RECORDS_SQL = f"""
with p as (select page_id, coalesce(html, '') as html, max(page_id) over (partition by coalesce(html, '')) as top from {{pages}}),
q as (select *, strlen(html) >= {LEAST} and top is not null and (page_id is null or page_id < top) as again from p)
select page_id, strlen(html)::bigint as payload_bytes, sha1(html) as payload_digest,
       case when again then 'revisit' else 'response' end as record_type, case when again then top end as refers_to from q
"""
