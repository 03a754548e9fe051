"""WARC archives: writing captures, reading records, and assembling transactions.

Writing makes a request, a response (or revisit) and a metadata record for each page and lets Spark's text writer put
them into archive files: a record ends with two line ends, which is the line separator given to the writer, so the files
are committed, and written anew when an executor is lost, like any other Spark output. Files hold a bounded number of
records. Reading takes files as bytes and walks their records by Content-Length, so payloads may contain anything;
gzipped archives (whole or by record) are unpacked on the way. A transaction is assembled by joining records on the
identifiers that all WARC-Concurrent-To headers name, in both directions, into one nested row per capture; a record that
reaches several captures is nested in each.

A file is read in one piece, which bounds memory by file size (2 GB at most, a limit of Spark's binary reader);
RECORDS_A_FILE keeps the files written here small. Payloads of any length are written and read whole.

Defined cases: a null html is an empty payload; null urls are written as the empty target, and line ends in urls as %0D
and %0A; bytes that are no whole record are read as a row of type broken, which no capture takes, and reading goes on
at the next record; equal payloads, empty ones
included, are revisits of the row of largest page_id, where rows that tie take the first by url, then by copy; null
page_ids come before all others and are kept as null; repeated rows are captures of their own; an empty table gives no
rows; a record that names no capture, or none that is in the archives, is a capture without a response.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _made, saved, shared_dir, table
from .components import components

RECORDS_A_FILE = 3000
DATE = "2024-01-01T00:00:00Z"
RECORD = "file string, number int, warc_type string, record_id string, concurrent_to array<string>, refers_to string, target_uri string, payload_digest string, http_head string, payload binary, headers map<string,string>"


def _uuid(*parts) -> Column:
    """A record identifier made from its row, the same in every attempt."""
    h = F.md5(F.concat_ws("\x1f", *[F.coalesce(F.col(p).cast("string"), F.lit("\x00")) if isinstance(p, str) else p for p in parts]))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def base32(hexadecimal: Column) -> Column:
    """Upper-case base32 of a SHA-1 in hex: ten hex digits at a time are eight digits to base 32."""
    parts = [F.lpad(F.conv(F.substring(hexadecimal, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def captures(pages: DataFrame) -> DataFrame:
    """(page_id, url, body, digest, capture, revisit_of, refers_to) for each row of pages.

    capture is the record identifier of the response or revisit; revisit_of that of the response it repeats. What
    refers to what is settled on digests; bodies are shuffled once, to meet the outcome.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("body"))
    content = F.concat(F.sha1("body"), F.sha2("body", 256)).alias("content")
    keys = ["page_id", "url", "content"]
    light = saved(rows.select("page_id", "url", content).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), "light")
    order = F.struct(F.col("page_id").isNotNull().alias("known"), "page_id")
    copies = light.select(*keys, F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy")).withColumn("capture", _uuid(F.lit("capture"), *keys, "copy"))
    # the largest page_id answers; of rows that tie there, the first by url and copy
    answer = copies.groupBy("content").agg(F.max(F.struct(order, F.struct(_reversed("url").alias("u"), (-F.col("copy")).alias("c")), "capture", "page_id")).alias("x"))
    answer = saved(answer.select("content", F.col("x.capture").alias("of"), F.col("x.page_id").alias("of_page")), "answers")
    settled = copies.join(answer, "content")
    again = F.col("capture") != F.col("of")
    settled = settled.select(*keys, F.struct("capture", F.when(again, F.col("of")).alias("revisit_of"), F.when(again, F.col("of_page")).alias("refers_to")).alias("x"))
    settled = saved(settled.groupBy(*keys).agg(F.collect_list("x").alias("x")), "settled").withColumnsRenamed({k: f"k_{k}" for k in keys})
    bodies = rows.select("*", content)
    if not light.filter("n > 1").isEmpty():  # equal rows: one of them carries all copies
        bodies = bodies.dropDuplicates(keys)
    same = F.col("page_id").eqNullSafe(F.col("k_page_id")) & (F.col("url") == F.col("k_url")) & (F.col("content") == F.col("k_content"))
    out = bodies.join(settled, same).select("page_id", "url", "body", base32(F.substring("content", 1, 40)).alias("digest"), F.explode("x").alias("x"))
    return out.select("page_id", "url", "body", "digest", "x.*")


def _reversed(text: str) -> Column:
    """Bytes of a text with their order turned round, so that the largest comes from the smallest text."""
    return F.concat(F.translate(F.hex(F.encode(text, "utf-8")), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("G"))


def _record(kind: Column | str, record_id: Column, fields: list[tuple[str, Column]], block: Column) -> Column:
    eol, kind = F.lit("\r\n"), F.lit(kind) if isinstance(kind, str) else kind
    head = [F.lit("WARC/1.1"), eol, F.lit("WARC-Type: "), kind, eol, F.lit("WARC-Record-ID: "), record_id, eol, F.lit(f"WARC-Date: {DATE}"), eol]
    for name, value in fields:
        head.append(F.when(value.isNull(), F.lit("")).otherwise(F.concat(F.lit(f"{name}: "), value, eol)))
    return F.concat(*head, F.lit("Content-Length: "), F.octet_length(block).cast("string"), eol, eol, block)


def write_archives(pages: DataFrame, path: str | None = None, gzip: bool = True) -> str:
    """Writes the captures of pages as WARC files and returns their folder."""
    if path is None:
        path = f"{shared_dir(pages.sparkSession)}/cladewright-warc-{uuid.uuid4().hex}"
        _made.append(path)
    c = captures(pages)
    # line ends would end a header: they are written as a URL writes them
    eol2, uri = "\r\n\r\n", F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    digest = F.concat(F.lit("sha1:"), F.col("digest"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("body").cast("string"), F.lit(eol2))
    first = F.col("revisit_of").isNull()
    answer = _record(
        F.when(first, "response").otherwise("revisit"), F.col("capture"),
        [("WARC-Target-URI", uri), ("WARC-Payload-Digest", digest), ("WARC-Refers-To", F.col("revisit_of")), ("WARC-Profile", F.when(~first, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))), ("Content-Type", F.lit("application/http; msgtype=response"))],
        F.when(first, F.concat(http, F.col("body"))).otherwise(http),
    )
    request_id = _uuid(F.lit("request"), "capture")
    request = _record("request", request_id, [("WARC-Target-URI", uri), ("WARC-Concurrent-To", F.col("capture")), ("Content-Type", F.lit("application/http; msgtype=request"))], F.concat(F.lit("GET "), uri, F.lit(" HTTP/1.1" + eol2)))
    note = F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("\r\npayload-bytes: "), F.octet_length("body").cast("string"), F.lit("\r\n"))
    # the metadata record names the request, which names the capture
    metadata = _record("metadata", _uuid(F.lit("metadata"), "capture"), [("WARC-Target-URI", uri), ("WARC-Concurrent-To", request_id), ("Content-Type", F.lit("application/warc-fields"))], note)
    records = c.select(F.explode(F.array(request, answer, metadata)).alias("value"))
    writer = records.write.option("lineSep", eol2).option("maxRecordsPerFile", RECORDS_A_FILE)
    (writer.option("compression", "gzip") if gzip else writer).text(path)
    return path


def unpacked(raw: bytes) -> bytes:
    """The bytes of a file, of all its gzip members if it is gzipped."""
    if raw[:2] != b"\x1f\x8b":
        return raw
    out = []
    while raw:
        d = zlib.decompressobj(31)
        out.append(d.decompress(raw) + d.flush())
        raw = d.unused_data
    return b"".join(out)


def records(raw: bytes):
    """Yields (headers as pairs, block) of each record.

    What is not a whole record (no header end, no length, or a length beyond the file) is given as (None, its bytes) up
    to the next line that starts with a version mark, where reading goes on.
    """
    at = 0
    while at < len(raw):
        if not raw.startswith(b"WARC/", at):
            start = at if raw.startswith(b"\r\nWARC/", at) else raw.find(b"\nWARC/", at)
            after = len(raw) if start < 0 else raw.find(b"WARC/", start)
            if raw[at:after].strip():
                yield None, raw[at:after]
            at = after
            continue
        end = raw.find(b"\r\n\r\n", at)
        size = None
        if end >= 0:
            lines = raw[at:end].decode("utf-8", "replace").split("\r\n")[1:]
            pairs = [(a.strip(), b.strip()) for a, _, b in (x.partition(":") for x in lines)]
            size = next((int(b) for a, b in pairs if a.lower() == "content-length" and b.isascii() and b.isdigit()), None)
        if size is None or end + 4 + size > len(raw):
            after = raw.find(b"\nWARC/", at)
            after = len(raw) if after < 0 else after + 1
            yield None, raw[at:after]
            at = after
            continue
        yield pairs, raw[end + 4 : end + 4 + size]
        at = end + 4 + size


def _parse_task(batches):
    import pyarrow as pa

    names = [x.split()[0] for x in RECORD.replace("map<string,string>", "map").split(", ")]
    types = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.map_(pa.string(), pa.string())]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
            rows, size = [], 0
            for number, (pairs, block) in enumerate(records(unpacked(content.as_py()))):
                broken = pairs is None
                pairs = [("WARC-Type", "broken")] if broken else pairs
                get = {a.lower(): b for a, b in pairs}
                head, payload = None, block
                if get.get("content-type", "").startswith("application/http"):
                    h, gap, payload = block.partition(b"\r\n\r\n")
                    head = (h + gap).decode("utf-8", "replace")
                concurrent = [b for a, b in pairs if a.lower() == "warc-concurrent-to"]
                rows.append((path.as_py(), number, get.get("warc-type"), get.get("warc-record-id"), concurrent, get.get("warc-refers-to"), get.get("warc-target-uri"), get.get("warc-payload-digest"), head, payload, list({a.lower(): b for a, b in pairs}.items())))
                size += len(block)
                if size > 4 << 20:
                    yield batch_of(rows)
                    rows, size = [], 0
            if rows:
                yield batch_of(rows)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record, and one of type broken for each stretch of bytes that is no whole record."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(_parse_task, RECORD)


def _reached(names: DataFrame, given: DataFrame) -> DataFrame:
    """(id, capture): given, and for all records that name one of these, directly or through others, its captures."""
    out = newest = saved(given.distinct(), "reached")
    while True:
        more = names.join(newest.withColumnRenamed("id", "to"), "to").select("id", "capture").distinct()
        newest = saved(more.join(out, ["id", "capture"], "left_anti"), "reached")
        if newest.isEmpty():
            return out
        out = out.unionByName(newest)


def captures_of(ends: DataFrame) -> DataFrame:
    """(id, capture) of requests and metadata, from record_id, answers and concurrent_to of all records.

    Those that name a response or are named by one, and those that name such records, belong to all captures so reached.
    What is left takes the captures of the records that name it; then what it names outside the archives; then itself.
    """
    answer = ends.filter("answers and record_id is not null").select(F.col("record_id").alias("answer")).distinct()
    other = ends.filter("not answers and record_id is not null").select("record_id").distinct()
    named = ends.filter("record_id is not null").select("answers", F.col("record_id").alias("id"), F.explode("concurrent_to").alias("to")).filter("id <> to").distinct()
    is_other = other.withColumnRenamed("record_id", "to")
    links = saved(named.filter("not answers").join(is_other, "to", "left_semi").select("id", "to"), "links")
    direct = named.filter("not answers").join(answer, F.col("to") == F.col("answer")).select("id", F.col("answer").alias("capture"))
    back = named.filter("answers").join(is_other, "to", "left_semi").select(F.col("to").alias("id"), F.col("id").alias("capture"))
    out = _reached(links, direct.unionByName(back))
    left = lambda: other.withColumnRenamed("record_id", "id").join(out, "id", "left_anti")
    rest = saved(left(), "rest")
    if rest.isEmpty():
        return out
    named_by = links.select(F.col("to").alias("id"), F.col("id").alias("to"))
    both = links.unionByName(named_by)

    def spread(edges):
        nonlocal out, rest
        while not rest.isEmpty():
            more = saved(rest.join(edges, "id").join(out.withColumnRenamed("id", "to"), "to").select("id", "capture").distinct(), "reached")
            if more.isEmpty():
                return
            out = out.unionByName(more)
            rest = saved(left(), "rest")

    spread(both)
    outside = named.filter("not answers").join(is_other, "to", "left_anti").join(rest, "id", "left_semi").select("id", F.col("to").alias("capture"))
    out = out.unionByName(_reached(links.join(rest, "id", "left_semi"), outside))
    rest = saved(left(), "rest")
    spread(both)
    # records that name nothing are captures of their own; a ring of records that name each other has the least as its own
    alone = rest.join(links.select("id").distinct(), "id", "left_anti").select("id", F.col("id").alias("capture"))
    out = out.unionByName(_reached(links.join(rest, "id", "left_semi"), alone))
    rest = saved(left(), "rest")
    if not rest.isEmpty():
        roots = components(links.join(rest, "id", "left_semi").select(F.xxhash64("id").alias("a"), F.xxhash64("to").alias("b")))
        ring = saved(rest.join(roots, F.xxhash64("id") == F.col("node")).select("id", "root"), "rings")
        out = out.unionByName(ring.join(ring.groupBy("root").agg(F.min("id").alias("capture")), "root").select("id", "capture"))
    return out


def assemble(found: DataFrame) -> DataFrame:
    """One row per capture: capture_id, target_uri, response (or revisit), requests and metadata as nested records.

    A record belongs to every response or revisit that its WARC-Concurrent-To headers name or whose own name it, and to
    those of the records that it names; see captures_of for records of which none of this holds.
    """
    answers = F.coalesce(F.col("warc_type").isin("response", "revisit", "resource"), F.lit(False))
    nested = F.struct("warc_type", "record_id", "refers_to", "target_uri", "payload_digest", "http_head", "payload", "headers")
    # requests and metadata are small: they are kept, and attached to what they name; payloads are shuffled once
    kept = found.filter(~F.coalesce(F.col("warc_type").isin("warcinfo", "broken"), F.lit(False)))
    own = F.coalesce("record_id", F.when(~answers, F.concat_ws("#", "file", "number")))  # records without an id are told apart by their place
    kept = saved(kept.select("record_id", own.alias("own"), answers.alias("answers"), "warc_type", "concurrent_to", F.when(~answers, nested).alias("record")), "others")
    reached = captures_of(kept.select(F.col("own").alias("record_id"), "answers", "concurrent_to"))
    others = kept.filter("not answers").select("record_id", "own", "warc_type", "record")
    side = others.join(reached, F.col("own") == F.col("id")).withColumn("side_id", F.when(F.col("record_id").isNotNull() | (F.col("capture") != F.col("own")), F.col("capture")))
    request = F.coalesce(F.col("warc_type") == "request", F.lit(False))
    more = lambda x, name: F.collect_list(F.when(x, F.col("record"))).alias(name)
    side = saved(side.groupBy("side_id").agg(more(request, "request"), more(~request, "metadata")), "side")
    main = found.filter(answers).select(F.col("record_id").alias("main_id"), nested.alias("response"))
    out = main.join(side, F.col("main_id") == F.col("side_id"), "full").withColumn("capture_id", F.coalesce("main_id", "side_id")).drop("main_id", "side_id")
    return out.withColumn("target_uri", F.coalesce("response.target_uri", F.get("request", F.lit(0))["target_uri"], F.get("metadata", F.lit(0))["target_uri"]))


def payload_facts(batches):
    """Digests recomputed from the payloads themselves, at the reading end."""
    import pyarrow as pa

    for batch in batches:
        payload = [p.as_py() or b"" for p in batch.column("payload")]
        digest = [base64.b32encode(hashlib.sha1(p).digest()).decode() for p in payload]
        keep = [batch.column(c) for c in batch.schema.names if c != "payload"]
        yield pa.RecordBatch.from_arrays([*keep, pa.array([len(p) for p in payload], pa.int64()), pa.array(digest)], [*[c for c in batch.schema.names if c != "payload"], "own_bytes", "own_digest"])


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round trip: what the assembled captures of the archives say of each page."""
    rows = assemble(read_records(spark, write_archives(table(spark, sf_dir, "pages"))))
    note = F.get("metadata", F.lit(0))["payload"].cast("string")
    flat = rows.select("capture_id", F.col("response.warc_type").alias("record_type"), F.col("response.refers_to").alias("to"), F.col("response.payload_digest").alias("stated"), F.nullif(F.regexp_extract(note, r"page-id: (\d*)\r\n", 1), F.lit("")).cast("long").alias("page_id"), F.coalesce(F.size("request"), F.lit(0)).alias("n_requests"), F.col("response.payload").alias("payload"))
    fields = "capture_id string, record_type string, to string, stated string, page_id long, n_requests int, own_bytes long, own_digest string"
    flat = saved(flat.mapInArrow(payload_facts, fields), "captures")
    # a revisit has no payload of its own: its size and digest are those of the response that it refers to
    target = flat.filter("record_type = 'response'").select(F.col("capture_id").alias("t"), F.col("page_id").alias("t_page"), F.col("own_bytes").alias("t_bytes"), F.col("own_digest").alias("t_digest"))
    again = F.coalesce(F.col("record_type") == "revisit", F.lit(False))
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    first = flat.filter(~again).select("page_id", "own_bytes", "own_digest", "record_type", F.lit(None).cast("long").alias("refers_to")).toDF(*names)
    later = flat.filter(again).join(target, F.col("to") == F.col("t"), "left")
    return first.unionByName(later.select("page_id", "t_bytes", "t_digest", "record_type", "t_page").toDF(*names))


#: DuckDB: base32 from the hex digest by bits.
OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT body, max(page_id) AS last FROM p GROUP BY body),
d AS (SELECT page_id, body, list_aggregate(list_transform(range(0, 8), lambda a: list_aggregate(list_transform([32768, 1024, 32, 1],
  lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, CAST(5 * a + 1 AS INTEGER), 5) AS BIGINT) // s) % 32 + 1 AS INTEGER), 1)), 'string_agg', '')), 'string_agg', '') AS digest FROM p)
SELECT d.page_id, CAST(strlen(d.body) AS BIGINT) AS payload_bytes, d.digest AS payload_digest,
  CASE WHEN d.page_id = m.last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN d.page_id <> m.last THEN m.last END AS refers_to
FROM d JOIN m ON d.body = m.body
"""
