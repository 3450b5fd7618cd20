"""WARC archives: written by Spark's text writer, read back in splits with a verified chain of records.

**Writing.** One record per page: a response with an HTTP head and the html, or a revisit without the html if an equal payload has a smaller page
id. Files are plain WARC 1.1 and hold a task's rows each.

**Reading.** A file is cut at every magic ``WARC/1.``, by Spark's line reader with that as the line end, so files of any size are read
in splits. The magic may also be inside a payload. Each chunk is a candidate record, and its header gives the offset of its
successor. Offsets are running sums of the chunk sizes, by split and then over the splits. Records are those that the chain
from offset 0 reaches: in each round all candidates double their jump, and the reached ones take their jump along (pointer jumping), so a file of n
records takes log2 n rounds of joins. Everything else is the inside of a payload. A payload that was cut at a magic is put
together again from its chunks.

Defined: null html is an empty payload. A null page id is written empty and comes back null; it counts as the largest.
Repeated rows are records of their own, and among equal ids and payloads the first row is the response. Line ends in a url are percent-encoded,
a null url is written empty. No pages: no records. A chain that ends early or in a broken header ends there: what comes after it in the file isn't
reachable and isn't returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from valence.llm.common import fixed, row_of
from valence.session import removed_at_end, shared_dir, written

MAGIC = "WARC/1."
END = "\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
URN = "urn:valence:page:"


def base32_sha1(payload: Column) -> Column:
    """The SHA-1 of a binary in upper-case base 32: 160 bits are 32 letters, ten hex digits are eight."""
    digits = F.sha1(payload)
    eights = [F.lpad(F.conv(F.substring(digits, i, 10), 16, 32), 8, "0") for i in (1, 11, 21, 31)]
    return F.translate(F.concat(*eights), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> None:
    """Write a record per page below ``path``. Payloads of at least ``least`` bytes that repeat become revisits."""
    pages = fixed(pages, page_id, url, html)
    rows = pages.select(
        row_of(pages), F.col(page_id).cast("string").alias("page"),
        F.col(page_id).alias("id"), F.coalesce(F.col(url), F.lit("")).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"),
    )
    body = F.col("html").cast("binary")
    keyed = written(rows.select("row", "id", "page", F.length(body).alias("n"), F.sha2(body, 256).alias("sha")), "payloads")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row", "page"))
    groups = keyed.filter(F.col("n") >= least).groupBy("n", "sha").agg(first.alias("first"), F.count(F.lit(1)).alias("copies"))
    again = keyed.join(groups.filter("copies > 1"), ["n", "sha"]).filter(F.col("row") != F.col("first.row"))
    # Only revisits, so that this is small unless most of the pages repeat; Spark then shuffles it.
    again = written(again.select("row", F.col("first.page").alias("refers")), "revisits")
    both = rows.join(again.withColumn("again", F.lit(True)), "row", "left")
    digest = base32_sha1(body)
    status = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8"
    block = F.when(F.col("again"), F.lit(status + END)).otherwise(F.concat(F.lit(status + END), F.col("html")))
    address = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    head = F.concat(
        F.lit(MAGIC + "1\r\nWARC-Type: "), F.when(F.col("again"), "revisit").otherwise("response"),
        F.lit(f"\r\nWARC-Record-ID: <{URN}"), F.coalesce("page", F.lit("")), F.lit(">\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Target-URI: "), address,
        F.lit("\r\nWARC-Payload-Digest: sha1:"), digest,
        F.when(F.col("again"), F.concat(
            F.lit(f"\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <{URN}"),
            F.coalesce("refers", F.lit("")), F.lit(">"),
        )).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.length(block.cast("binary")).cast("string"), F.lit(END),
    )
    both.select(F.concat(head, block).alias("value")).write.option("lineSep", END).text(path)


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    """What is between two magics, with the file, the split and the order in it, and a digest.

    Split and order hold for this scan only; in another one the bytes are known by file and digest.
    """
    return spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("value").cast("binary").alias("bytes"), "value", F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("seq"),
        F.unhex(F.sha2(F.col("value").cast("binary"), 256)).alias("sha"),
    )


def _field(name: str) -> Column:
    found = F.regexp_extract("head", rf"(?im)^{name}:[ \t]*(.*?)[ \t]*\r?$", 1)
    return F.when(found != "", found)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Each place with a magic as a record: file, offset, its successor, its header, and its payload if that is in one chunk."""
    parts = F.split("value", END, 3)
    chunk = _chunks(spark, path).withColumn("parts", parts).withColumn("head", F.col("parts")[0])
    chunk = chunk.withColumn("length", F.expr("try_cast(regexp_extract(head, '(?im)^Content-Length:[ ]*([0-9]{1,18})', 1) AS BIGINT)"))
    headed = F.size("parts") > 1
    header = F.length(F.col("head").cast("binary")) + len(END) + len(MAGIC)
    http = F.when(F.size("parts") > 2, F.length(F.get("parts", F.lit(1)).cast("binary")) + len(END))
    inside = F.length("bytes") + len(MAGIC) >= header + F.col("length")
    # A payload that ends in this chunk; what comes after it is the end of the record.
    payload = F.substring("bytes", (header - len(MAGIC) + http + 1).cast("int"), (F.col("length") - http).cast("int"))
    page = F.regexp_extract("head", rf"(?im)^WARC-Record-ID:[ ]*<{URN}(-?[0-9]+)>", 1)
    refers = F.regexp_extract("head", rf"(?im)^WARC-Refers-To:[ ]*<{URN}(-?[0-9]+)>", 1)
    whole = headed & inside & http.isNotNull() & (F.col("length") >= http)
    read = written(
        chunk.select(
            "file", "split", "seq", "sha", (F.length("bytes") + len(MAGIC)).alias("size"),
            F.when(headed & F.col("length").isNotNull(), header + F.col("length") + len(END)).alias("ahead"),
            _field("WARC-Type").alias("record_type"), page.try_cast("bigint").alias("page_id"),
            refers.try_cast("bigint").alias("refers_to"), _field("WARC-Payload-Digest").alias("stated"),
            header.alias("header"), "length",
            F.when(whole, F.col("length") - http).alias("payload_bytes"), F.when(whole, base32_sha1(payload)).alias("payload_digest"),
        ),
        "chunks",
    )
    sums = read.groupBy("file", "split").agg(F.sum("size").alias("total"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("file", "split", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    here = Window.partitionBy("file", "split").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = read.withColumn("within", F.coalesce(F.sum("size").over(here), F.lit(0))).join(starts, ["file", "split"])
    # The first chunk of a file is what is before its first magic: nothing, in a WARC file. The magic of a chunk is before it.
    return placed.withColumn("offset", F.col("base") + F.col("within") - len(MAGIC)).withColumn("next", F.col("offset") + F.col("ahead"))


def reached(links: DataFrame) -> DataFrame:
    """file and offset of the records that the chain from offset 0 of each file reaches.

    ``links`` has file, offset and next. Pointer jumping: the jump of a candidate doubles each round.
    """
    places = links.select("file", F.col("offset").alias("next"))
    found = written(links.filter("offset = 0").select("file", "offset"), "reached")
    # A successor that is no candidate ends the chain.
    jump = written(links.select("file", "offset", "next").join(places, ["file", "next"], "left_semi"), "jumps")
    while True:
        # The next as many records of each chain: offsets only grow, so none of them was found before.
        ahead = written(found.join(jump, ["file", "offset"]).select("file", F.col("next").alias("offset")), "reached")
        if ahead.isEmpty():
            return found
        found = found.union(ahead)
        on = jump.select("file", F.col("offset").alias("next"), F.col("next").alias("later"))
        jump = written(jump.join(on, ["file", "next"]).select("file", "offset", F.col("later").alias("next")), "jumps")


def _owned(placed: DataFrame) -> DataFrame:
    """file, sha, offset and ``record``: the offset of the last record that begins at the chunk or before."""
    begun = F.when(F.col("real"), F.col("offset"))
    last = placed.groupBy("file", "split").agg(F.max(begun).alias("last"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    carry = last.select("file", "split", F.max("last").over(before).alias("carry"))
    here = Window.partitionBy("file", "split").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = placed.withColumn("mine", F.max(begun).over(here)).join(carry, ["file", "split"])
    return rows.select("file", "sha", "offset", F.coalesce("mine", "carry").alias("record"))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row per record: page_id, payload_bytes, payload_digest, record_type, refers_to, file, offset, stated (the digest in the header).

    Revisits have the payload of the record that they refer to. Digests are of what was read.
    """
    placed = written(candidates(spark, path), "candidates")
    chain = reached(placed.filter("offset >= 0").select("file", "offset", "next"))
    placed = written(placed.join(chain.withColumn("real", F.lit(True)), ["file", "offset"], "left"), "marked")
    records = placed.filter("real")
    cut = records.filter("payload_digest IS NULL AND length IS NOT NULL").select("file", F.col("offset").alias("record"), "header", "length")
    # The inside of a payload belongs to the last record before it.
    inner = written(_owned(placed).join(cut, ["file", "record"]), "inner")
    held = _chunks(spark, path).select("file", "sha", "bytes").join(inner.select("file", "sha"), ["file", "sha"], "left_semi")
    # Once each, and as a table, so that the join can split the chunks of a hot content.
    held = written(held.dropDuplicates(["file", "sha"]), "bytes")
    joined = inner.join(held, ["file", "sha"]).groupBy("file", "record", "header", "length").agg(
        F.array_sort(F.collect_list(F.struct("offset", F.concat(F.lit(MAGIC).cast("binary"), F.col("bytes")).alias("bytes")))).alias("chunks")
    )
    whole = F.aggregate("chunks", F.lit(b""), lambda a, c: F.concat(a, c["bytes"]))
    block = F.substring(whole, (F.col("header") + 1).cast("int"), F.col("length").cast("int"))
    block = joined.select("file", F.col("record").alias("offset"), block.alias("block"))
    ended = F.call_function("locate", F.lit("0D0A0D0A"), F.hex("block"))
    skip = F.floor((ended - 1) / 2) + len(END)
    pieced = block.withColumn("payload", F.substring("block", (skip + 1).cast("int"), F.length("block"))).select(
        "file", "offset", F.length("payload").cast("long").alias("bytes"), base32_sha1(F.col("payload")).alias("digest")
    )
    full = records.join(pieced, ["file", "offset"], "left").select(
        "file", "offset", "page_id", "record_type", "refers_to", "stated",
        F.coalesce(F.col("payload_bytes").cast("long"), "bytes").alias("payload_bytes"), F.coalesce("payload_digest", "digest").alias("payload_digest"),
    )
    full = written(full, "records")
    origin = full.filter("record_type = 'response'").select(
        F.coalesce("page_id", F.lit(-1)).alias("origin"), F.col("payload_bytes").alias("o_bytes"), F.col("payload_digest").alias("o_digest"),
        F.concat(F.lit("sha1:"), "payload_digest").alias("o_stated"),
    ).distinct()
    revisit = F.col("record_type") == "revisit"
    asked = F.when(revisit, F.coalesce("refers_to", F.lit(-1)))
    both = full.join(origin, (asked == F.col("origin")) & (F.col("stated") == F.col("o_stated")), "left")
    return both.select(
        "page_id", F.when(revisit, F.col("o_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("o_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type", F.when(revisit, F.col("refers_to")).alias("refers_to"), "file", "offset", "stated",
    )


def archived(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> DataFrame:
    """Write the pages as archives below the checkpoint folder, and read them back."""
    spark = pages.sparkSession
    path = shared_dir(spark, "warc")
    write_archives(pages, path, page_id, url, html, least)
    removed_at_end(spark, path)
    return read_archives(spark, path)
