"""Operator 3, WARC: write pages as WARC records and read archives by boundary chains.

Writing. A record is one string, and Spark's text sink with ``\\r\\n\\r\\n`` as line
separator puts the records one after the other, so archives are committed like any
other output. Of equal payloads of ``revisit_bytes`` or more, the one with the largest
id is stored; the others become ``revisit`` records that refer to it.

Reading. The text source splits files at the version magic, wherever it stands, into
pieces; files are read in blocks by many tasks, plain or compressed. Offsets and spans are
kept, payloads are not: they are read again at the end. A piece's offset is
the sum of what stands before it: within its block, then over the blocks of its file.
Each piece is a candidate record and says, by its header, where its successor starts.
Candidates whose successor is the very next one form runs; a run is entered at an
offset and left at its end. Pointer jumping over the runs from the start of each file
finds what can be reached in a number of rounds that is logarithmic in the runs of a
file; archives without magic inside payloads have one run a file and need no round.
Pieces that are not reached are part of the payload before them.

Everything here is DataFrame code; bytes that are not UTF-8 pass through unharmed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise

MAGIC = "WARC/1."
END = "\r\n\r\n"
#: Bits of the filter of repeated digests (2 MB).
FILTER_BITS = 1 << 24


def _header_text(c: Column) -> Column:
    """A value that fits on one header line and holds no magic, at which reading splits."""
    return F.replace(F.regexp_replace(c, r"[\r\n]", "%0A"), F.lit(MAGIC), F.lit("%57" + MAGIC[1:]))


def _repeated(large: DataFrame) -> DataFrame:
    """digest, kept (the largest id) of payloads that several rows hold."""
    kept = large.groupBy("digest").agg(F.max("id").alias("kept"), F.count("*").alias("n")).where("n > 1 and kept is not null")
    return materialise(kept.select("digest", "kept"), "warc-repeated")


def _may_repeat(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """rows with ``maybe``: false only if the digest is none of the repeated ones. They travel
    as a bitmap of ``FILTER_BITS`` hashes, so of a bounded size; the more there are, the more
    rows are true in vain, and what is true is joined exactly."""
    bit = lambda: F.pmod(F.xxhash64("digest"), F.lit(FILTER_BITS))
    marks = repeated.select(bit().alias("b")).groupBy(F.bitmap_bucket_number("b").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("bitmap"))
    joined = rows.withColumn("bucket", F.bitmap_bucket_number(bit())).join(F.broadcast(marks), "bucket", "left")
    at = F.bitmap_bit_position(bit())
    byte = F.conv(F.hex(F.substring(F.col("bitmap"), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return joined.withColumn("maybe", F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))).drop("bucket", "bitmap")


def to_records(pages: DataFrame, revisit_bytes: int = 1000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``value``: a WARC record for each row, without its end. A null payload is empty; a
    null id or url leaves its header out. Rows that repeat an id stay apart; if they are
    equal in a payload too, the copies that share the largest id are all responses. Other
    columns are not read; an empty table gives no record. Payloads move between tasks only
    if they are repeated."""
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1(F.col("payload").cast("binary")))
    large = F.octet_length("payload") >= revisit_bytes
    repeated = _repeated(rows.where(large).select("id", "digest"))
    split = _may_repeat(rows, repeated).withColumn("maybe", F.col("maybe") & large)
    apart = split.where(~F.col("maybe")).withColumn("kept", F.lit(None).cast("long"))
    joined = split.where("maybe").join(repeated, "digest", "left").select(apart.columns).unionByName(apart)
    again = F.col("kept").isNotNull() & ~F.col("id").eqNullSafe(F.col("kept"))
    body = F.when(again, F.lit("")).otherwise(F.col("payload"))
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise(F.lit(""))
    urn = lambda page: F.concat(F.lit("<urn:page:"), page.cast("string"), F.lit(":"), F.col("digest"), F.lit(">"))
    return joined.select(
        F.concat(
            F.lit(f"{MAGIC}1\r\nWARC-Type: "),
            F.when(again, F.lit("revisit")).otherwise(F.lit("response")),
            F.lit("\r\nWARC-Date: "),
            F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'"),
            F.lit("\r\n"),
            line("WARC-Record-ID", urn(F.col("id"))),
            line("WARC-Target-URI", _header_text(F.col("url"))),
            F.when(again, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), urn(F.col("kept")), F.lit("\r\n"))).otherwise(F.lit("")),
            F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
            F.concat(F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit(END)),
            body,
        ).alias("value")
    )


def write_archives(records: DataFrame, path: str, compression: str = "none") -> None:
    records.write.option("lineSep", END).option("compression", compression).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row per record that the chain from the start of its file reaches: file, header
    (string), payload (binary), broken (its end is not where its header says).

    A chain ends at a record whose header cannot be read or whose successor is no
    record; what follows in that file is not returned. Empty files give no rows."""
    n = len(MAGIC)
    raw = spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
        F.octet_length("value").alias("bytes"),
        "value",
    )
    header = F.substring_index("value", END, 1)
    length = _content_length(header)
    span = F.when(F.instr("value", END) > 0, n + F.octet_length(header) + len(END) + length + len(END))
    raw = raw.withColumn("size", (F.col("bytes") + n).cast("long")).withColumn("span", span)
    # a piece that is one record by its own header is told by its content, which a second scan
    # finds again however it is cut into blocks; others are few, and their bytes are kept here
    raw = raw.withColumn("one", F.coalesce(F.col("span") == F.col("size"), F.lit(False)))
    raw = raw.withColumn("key", F.array(F.xxhash64("value"), F.xxhash64(F.lit("second"), "value")))
    light = materialise(raw.select("file", "block", "row", "size", "span", "one", "key", F.when(~F.col("one"), F.col("value")).alias("value")), "warc-light")
    in_block = Window.partitionBy("file", "block").orderBy("row")
    blocks = light.groupBy("file", "block").agg(F.sum("size").alias("total"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "block", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    # a piece starts with its magic, which the source took off the piece before it; a file's
    # first piece is what stands before its first magic
    at = F.coalesce(F.sum("size").over(in_block.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = light.drop("value").withColumn("rel", at).join(blocks, ["file", "block"])
    placed = placed.select("file", "block", "row", "size", "span", "one", "key", (F.col("base") + F.col("rel") - n).alias("offset")).where("offset >= 0")
    placed = placed.withColumn("next", F.col("offset") + F.col("span"))
    # a run ends at a candidate whose successor is not the next piece of the block
    follows = F.coalesce(F.col("next") == F.lead("offset").over(in_block), F.lit(False))
    runs = placed.withColumn("follows", follows).withColumn("broke", (~F.coalesce(F.lag("follows").over(in_block), F.lit(False))).cast("int"))
    runs = runs.withColumn("run", F.sum("broke").over(in_block.rowsBetween(Window.unboundedPreceding, 0))).drop("broke", "follows")
    runs = materialise(runs, "warc-runs")
    links = materialise(runs.groupBy("file", "block", "run").agg(F.min("offset").alias("first"), F.max_by("next", "offset").alias("exit")), "warc-links")
    marked = runs.join(_reach(links, runs), ["file", "block", "run"], "left")
    marked = marked.withColumn("real", F.coalesce(F.col("offset") >= F.col("entry"), F.lit(False)))
    # a piece that is not real belongs to the last real one before it, maybe in an earlier block
    real = F.when(F.col("real"), F.col("offset"))
    last = marked.groupBy("file", "block").agg(F.max(real).alias("last"))
    carried = last.select("file", "block", F.max("last").over(before).alias("carried"))
    owners = marked.withColumn("own", F.max(real).over(in_block.rowsBetween(Window.unboundedPreceding, 0))).join(carried, ["file", "block"])
    owners = owners.select("file", "row", "one", "key", "offset", "real", F.when(~(F.col("real") & F.col("one")), F.coalesce("own", "carried")).alias("record"))
    # most archives have none of these, and then no payload moves
    odd = materialise(owners.where("record is not null or not real").select("file", "row", "one", "key", "offset", "record"), "warc-odd")
    first = light.withColumn("k", F.row_number().over(in_block)).where("block = 0 and k = 1")
    bad = materialise(odd.where("one").select("file", "key").unionByName(first.where("one").select("file", "key")).distinct(), "warc-bad")
    ones = raw.where("one").select("file", "key", "value")
    if not bad.head(1):
        single, parts_ = ones.select("file", "value"), odd.join(light.select("row", "value"), "row")
    else:
        # content that stands inside a payload, and maybe as a record too
        values = materialise(ones.join(bad, ["file", "key"], "left_semi").dropDuplicates(["file", "key"]), "warc-values")
        again = owners.where("real and one").select("file", "key").join(values, ["file", "key"])
        single = ones.join(bad, ["file", "key"], "left_anti").select("file", "value").unionByName(again.select("file", "value"))
        cut = odd.where("not one").join(light.select("row", "value"), "row")
        parts_ = cut.unionByName(odd.where("one").join(values, ["file", "key"]), allowMissingColumns=True)
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("offset", "value"))), lambda x: x["value"])
    several = parts_.where("record is not null").groupBy("file", "record").agg(F.array_join(pieces, MAGIC).alias("value"))
    return _split_records(single.unionByName(several.select("file", "value")))


def _content_length(header: Column) -> Column:
    return F.regexp_extract(F.concat(header, F.lit("\r\n")), r"(?i)\r\nContent-Length:[ \t]*(\d+)[ \t]*\r\n", 1).try_cast("long")


def _reach(links: DataFrame, runs: DataFrame) -> DataFrame:
    """file, block, run, entry: the runs that can be reached and the least offset at which
    they are entered."""
    keys = ["file", "block", "run"]
    starts = links.where("first = 0").select(*keys, F.lit(0).cast("long").alias("entry"))
    if not links.groupBy("file").count().where("count > 1").head(1):
        return starts
    # where a run's exit lands: the run that holds a candidate at that offset
    target = runs.select("file", F.col("offset").alias("exit"), F.col("block").alias("block_to"), F.col("run").alias("run_to"))
    jump = links.join(target, ["file", "exit"]).select(*keys, "block_to", "run_to", F.col("exit").alias("entry"))
    jump, reached = materialise(jump, "warc-jump"), materialise(starts, "warc-reached")
    left = links.groupBy("file").count().agg(F.max("count")).first()[0]
    while left > 0:
        new = reached.join(jump.withColumnRenamed("entry", "enter"), keys).select("file", F.col("block_to").alias("block"), F.col("run_to").alias("run"), F.col("enter").alias("entry"))
        reached = materialise(reached.unionByName(new).groupBy(*keys).agg(F.min("entry").alias("entry")), "warc-reached")
        left //= 2
        if left > 0:
            second = jump.select("file", F.col("block").alias("block_to"), F.col("run").alias("run_to"), F.col("block_to").alias("b2"), F.col("run_to").alias("r2"), F.col("entry").alias("e2"))
            jump = materialise(jump.join(second, ["file", "block_to", "run_to"]).select(*keys, F.col("b2").alias("block_to"), F.col("r2").alias("run_to"), F.col("e2").alias("entry")), "warc-jump")
    return reached


def _split_records(pieces: DataFrame) -> DataFrame:
    header = F.substring_index("value", END, 1)
    data = pieces.select("file", header.alias("header"), F.col("value").cast("binary").alias("data"))
    data = data.withColumn("length", _content_length(F.col("header"))).withColumn("skip", F.octet_length("header") + len(END))
    payload = F.substring(F.col("data"), F.col("skip") + 1, F.col("length").cast("int"))
    whole = F.octet_length("data") == F.col("skip") + F.col("length") + len(END)
    return data.select("file", F.concat(F.lit(MAGIC), F.col("header")).alias("header"), payload.alias("payload"), (~F.coalesce(whole, F.lit(False))).alias("broken"))


def field(header: Column, name: str) -> Column:
    """A header field's value, null if it is not there."""
    found = F.regexp_extract(F.concat(header, F.lit("\r\n")), rf"(?i)\r\n{name}:[ \t]*([^\r\n]*)", 1)
    return F.when(found != "", found)


def page_rows(records: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of archives that
    ``to_records`` made. All figures are those of payloads that were read; a revisit has those
    of the response that it refers to. Magic in a url comes back with its W as %57. A broken
    record, a revisit without its response, and a payload that is not what its header says are
    errors. Empty archives give no rows."""
    h = F.when(F.col("broken"), F.raise_error(F.concat(F.lit("broken WARC record in "), F.col("file")))).otherwise(F.col("header"))
    records = records.withColumn("header", h)
    h = F.col("header")
    page = lambda name: F.regexp_extract(field(h, name), r"<urn:page:(-?\d+):", 1).try_cast("long")
    again = field(h, "WARC-Type") == "revisit"
    said = F.regexp_replace(field(h, "WARC-Payload-Digest"), "^sha1:", "")
    own = F.sha1("payload")
    digest = F.when(again | (said == own), said).otherwise(F.raise_error(F.concat(F.lit("a WARC payload is not what its header says in "), F.col("file"))))
    rows = records.select(
        page("WARC-Record-ID").alias("page_id"),
        field(h, "WARC-Target-URI").alias("url"),
        F.when(~again, F.octet_length("payload").cast("long")).alias("own_bytes"),
        digest.alias("payload_digest"),
        field(h, "WARC-Type").alias("record_type"),
        F.when(again, page("WARC-Refers-To")).alias("refers_to"),
    )
    rows = materialise(rows, "warc-rows")
    told = rows.where("refers_to is not null")
    asked = told.select("refers_to", "payload_digest").distinct()
    responses = rows.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest", F.col("own_bytes").alias("their_bytes"))
    responses = responses.join(asked, ["refers_to", "payload_digest"], "left_semi").groupBy("refers_to", "payload_digest").agg(F.max("their_bytes").alias("their_bytes"))
    found = told.join(responses, ["refers_to", "payload_digest"], "left")
    theirs = F.coalesce("their_bytes", F.raise_error(F.lit("a WARC revisit without its response")).cast("long"))
    both = rows.where("refers_to is null").withColumn("payload_bytes", F.coalesce("own_bytes", F.raise_error(F.lit("a WARC revisit without its response")).cast("long"))).unionByName(found.withColumn("payload_bytes", theirs), allowMissingColumns=True)
    return both.select("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to")
