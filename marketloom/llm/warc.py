"""WARC archives: writing with duplicate payloads as revisits, and reading by boundary-chain verification.

Archives are written by Spark's text writer: a record is one row, and the writer's line end is the two
line breaks that close a record. They are read by Spark's text reader with the format's magic as line
end, so large files are split over tasks. Every occurrence of the magic is a candidate record with a
successor, the offset after its header, content and closing line breaks. A payload may hold the magic
too, so candidates prove nothing: only those that the chain of successors reaches from the start of
the file are records. Pointer jumping follows all chains at once in a logarithmic number of joins.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom import session
from marketloom.llm.common import cut, pick, scanned_once, stored

MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


#: Rows of three or four columns that a join sends to every task; beyond it the join moves both sides.
SENT_ROWS = 500_000


def _small(rows: DataFrame) -> DataFrame:
    """Broadcast a computed table of known columns if it has few rows, so that payloads stay where they are."""
    return F.broadcast(rows) if rows.count() <= SENT_ROWS else rows


def base32_sha1(data: Column) -> Column:
    """SHA-1 as bare upper-case base32: five hexadecimal digits make four base-32 digits."""
    digest = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*groups)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _header(name: str, value: Column) -> Column:
    """A header line; nothing for a null value. Control characters cannot stand in a header."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), F.regexp_replace(value, r"[\x00-\x1F\x7F]", " "), F.lit("\r\n")), F.lit(""))


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", minimum_bytes: int = 0) -> None:
    """Write one record per row as archives in ``path``.

    Of rows with equal payloads of at least ``minimum_bytes`` bytes the one with the smallest id is a
    response and the others revisit it; all smaller ones are responses. Equal ids are ordered by their
    place in the table, null ids come last. A null payload is empty. A revisit has no content, but the digest and
    length of its payload, and names the response by its record id and key. A null url has no header.
    Further columns are ignored. ``pages`` must give the same rows in the same order when read again.
    """
    rows = pick(pages, key=(id_col, "long"), url=(url_col, "string"), payload=(payload_col, "string"))
    rows = rows.withColumn("row", F.monotonically_increasing_id()).withColumn("data", F.coalesce(F.encode("payload", "UTF-8"), F.lit(b""))).drop("payload")
    # row numbers of one plan are joined to its own rows: another plan may split the files otherwise
    rows = scanned_once(rows.withColumn("url", F.col("url").cast("binary"))).withColumn("url", F.col("url").cast("string"))
    rows = rows.withColumn("size", F.octet_length("data").cast("long")).withColumn("digest", base32_sha1(F.col("data")))
    place = F.struct(F.col("key").isNull().alias("none"), F.col("key").alias("key"), F.col("row").alias("row"))
    narrow = rows.select("key", "row", "size", "digest")
    firsts = narrow.where(F.col("size") >= minimum_bytes).groupBy("digest", "size").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    again = narrow.select("digest", "size", "row").join(firsts.where("n > 1"), ["digest", "size"]).where("row <> first.row")
    again = again.select("row", F.col("first.row").alias("first_row"), F.col("first.key").alias("first_key"))
    marked = rows.join(_small(cut(again)), "row", "left")
    revisit = F.col("first_row").isNotNull()

    def record_id(row: Column, key: Column) -> Column:
        h = F.concat(F.lpad(F.hex(F.xxhash64(key, row)), 16, "0"), F.lpad(F.hex(F.xxhash64(row, key)), 16, "0"))
        return F.concat(F.lit("<urn:uuid:"), F.lower(F.regexp_replace(h, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")), F.lit(">"))

    content = F.when(revisit, F.lit(b"")).otherwise(F.concat(F.lit(_HTTP.encode()), F.col("data")))
    head = F.concat(
        F.lit(MAGIC),
        _header("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _header("WARC-Record-ID", record_id(F.col("row"), F.col("key"))),
        F.lit("WARC-Date: 2024-01-01T00:00:00Z\r\n"),
        _header("WARC-Target-URI", F.col("url")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        _header("WARC-Profile", F.when(revisit, PROFILE)),
        _header("WARC-Refers-To", F.when(revisit, record_id(F.col("first_row"), F.col("first_key")))),
        _header("Record-Key", F.col("key").cast("string")),
        _header("Refers-To-Key", F.when(revisit, F.col("first_key").cast("string"))),
        _header("Payload-Length", F.col("size").cast("string")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        _header("Content-Length", F.octet_length(content).cast("string")),
        F.lit("\r\n"),
    )
    marked.select(F.concat(F.encode(head, "UTF-8"), content).cast("string").alias("value")).write.option("lineSep", END).text(path)


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    """What stands between occurrences of the magic, in file order: file, block, place (row in the block) and bytes."""
    read = spark.read.option("lineSep", MAGIC).text(path)
    chunks = read.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"),
        F.col("value").cast("binary").alias("chunk"),
    )
    # blocks and places are joined back to the chunks, so all uses need the blocks of one plan
    return scanned_once(chunks)


def _field(name: str) -> Column:
    return F.nullif(F.regexp_extract("head", rf"(?i)(?:^|\r\n){name}:[ \t]*([^\r]*)", 1), F.lit(""))


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives under ``path``, verified by the chain of their boundaries.

    Returns file string, start long (byte offset), kind string, record_id, uri, refers_to, key,
    refers_to_key, digest strings, payload_length long (as stated), payload binary (what follows the HTTP
    header of a response; empty for a revisit), payload_digest string and
    payload_bytes long (computed). A file that does not begin
    with a record gives none; behind a damaged record its chain ends. Files must not change while read.
    """
    chunks = _chunks(spark, path)
    ends = F.instr(F.decode("chunk", "ISO-8859-1"), END).cast("long")
    parsed = chunks.withColumn("head_bytes", ends)
    parsed = parsed.withColumn("head", F.decode(F.expr("substring(chunk, 1, cast(greatest(head_bytes, 1) as int) - 1)"), "UTF-8"))
    parsed = parsed.withColumn("length", F.when(F.col("head_bytes") > 0, F.expr(r"try_cast(regexp_extract(head, '(?i)(?:^|\r\n)Content-Length:[ \t]*([0-9]+)', 1) as long)")))
    parsed = parsed.withColumn("bytes", F.octet_length("chunk").cast("long") + len(MAGIC))
    parsed = parsed.withColumn("total", len(MAGIC) + F.col("head_bytes") - 1 + len(END) + F.col("length") + len(END))

    # what a candidate holds is worked out where it is read, so that joins move payloads only if they are asked for
    parsed = _payload(parsed.withColumn("content", _content()))

    narrow = stored(parsed.select("file", "block", "place", "bytes", "total"), "boundaries")
    per_block = narrow.groupBy("file", "block").agg(F.sum("bytes").alias("bytes"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    per_block = per_block.select("file", "block", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("file", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    # a chunk begins behind its magic, so the candidate stands before it; the first chunk has none
    offsets = narrow.withColumn("skip", F.coalesce(F.sum("bytes").over(inside), F.lit(0))).join(per_block, ["file", "block"])
    offsets = offsets.withColumn("start", F.col("base") + F.col("skip") - len(MAGIC))
    offsets = stored(offsets.select("file", "block", "place", "bytes", "start", "total"), "offsets")
    reached = reachable(offsets.where("start >= 0 and total is not null").select("file", "start", (F.col("start") + F.col("total")).alias("next")))

    begins = reached.select("file", "start", F.lit(True).alias("is_record"))
    flagged = offsets.join(begins, ["file", "start"], "left")
    order = Window.partitionBy("file").orderBy("start")
    owner = F.last(F.when(F.col("is_record"), F.struct("start", "total")), ignorenulls=True).over(order)
    flagged = flagged.withColumn("owner", owner).where("owner is not null").where("start < owner.start + owner.total")
    flagged = flagged.select("file", "block", "place", "start", "is_record", F.col("owner.start").alias("record"), (F.col("owner.total") > F.col("bytes")).alias("longer"))
    flagged = stored(flagged, "owners")
    where = ["file", "block", "place"]
    records = parsed.join(flagged.where("is_record"), where)
    kept = ["file", "record", "head", "length", "payload", "payload_digest", "payload_bytes"]
    single = records.where("not longer").select(kept)
    # a payload that holds the magic was cut there: join its chunks with the magic again
    spread = flagged.where("is_record and longer").select("file", "record").join(flagged, ["file", "record"])
    spread = _small(cut(spread.select(*where, "start", "record")))
    pieces = chunks.join(spread, where)
    joined = pieces.groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("start", "chunk"))).alias("parts"))
    magic = F.lit(MAGIC.encode())
    whole = F.aggregate(F.slice("parts", 2, F.greatest(F.size("parts") - 1, F.lit(0))), F.col("parts")[0]["chunk"], lambda done, part: F.concat(done, magic, part["chunk"]))
    joined = joined.select("file", "record", whole.alias("chunk"))
    several = records.where("longer").select("file", "record", "head", "head_bytes", "length").join(joined, ["file", "record"])
    both = single.unionByName(_payload(several.withColumn("content", _content())).select(kept))
    return both.select(
        "file",
        F.col("record").alias("start"),
        _field("WARC-Type").alias("kind"),
        _field("WARC-Record-ID").alias("record_id"),
        _field("WARC-Target-URI").alias("uri"),
        _field("WARC-Refers-To").alias("refers_to"),
        _field("Record-Key").cast("long").alias("key"),
        _field("Refers-To-Key").cast("long").alias("refers_to_key"),
        F.regexp_replace(_field("WARC-Payload-Digest"), "^sha1:", "").alias("digest"),
        _field("Payload-Length").cast("long").alias("payload_length"),
        "payload",
        "payload_digest",
        "payload_bytes",
    )


def _content() -> Column:
    """The content behind a candidate's header, as far as its chunk goes."""
    return F.expr(f"substring(chunk, cast(head_bytes as int) + {len(END)}, cast(length as int))")


def _payload(rows: DataFrame) -> DataFrame:
    """The payload of a content, behind its HTTP header, and its digest."""
    payload = F.expr(f"case when length = 0 then content else substring(content, instr(decode(content, 'ISO-8859-1'), '{_escaped(END)}') + {len(END)}) end")
    rows = rows.withColumn("payload", payload)
    return rows.withColumn("payload_digest", base32_sha1(F.col("payload"))).withColumn("payload_bytes", F.octet_length("payload").cast("long"))


def _escaped(text: str) -> str:
    return text.replace("\r", "\\r").replace("\n", "\\n")


def reachable(candidates: DataFrame) -> DataFrame:
    """Candidates (file, start, next) that the chain from offset 0 of their file visits, by pointer jumping.

    After round k the marked records are those less than 2**k steps from the start, and every pointer
    spans 2**k steps, so the number of rounds is the logarithm of the longest chain. A round joins each
    candidate with the one that its pointer names, which doubles the pointer and passes the mark on.
    """
    state = cut(candidates.select("file", "start", "next", (F.col("start") == 0).alias("marked")))
    known = None
    while True:
        now = state.agg(F.count_if("marked")).first()[0]
        if now == known:
            return state.where("marked").select("file", "start")
        known = now
        target = state.select("file", F.col("start").alias("next"), F.col("next").alias("after"), F.lit(True).alias("found"))
        own = F.struct("file", "start", F.col("after").alias("next"), "marked")
        passed = F.when(F.col("found") & F.col("marked"), F.struct("file", F.col("next").alias("start"), F.lit(None).cast("long").alias("next"), F.lit(True).alias("marked")))
        both = state.join(target, ["file", "next"], "left").select(F.explode(F.filter(F.array(own, passed), lambda x: x.isNotNull())).alias("x")).select("x.*")
        state = cut(both.groupBy("file", "start").agg(F.max("next").alias("next"), F.max("marked").alias("marked")))


def archive_folder(spark: SparkSession) -> str:
    """A new folder for archives in the shared scratch folder."""
    return f"{session.scratch_root(spark)}/llm/warc-{uuid.uuid4().hex}"
