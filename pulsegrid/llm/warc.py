"""WARC archives: writing, reading, and assembling captures (operator 9).

Every page becomes three WARC/1.1 records: a request, a response or (for a payload that
an earlier page has) an identical-payload revisit, and a metadata record. The request and
the metadata name the response in ``WARC-Concurrent-To``. Spark's own text writer stores
the records, so archives can lie in any store Spark reaches: a record's two closing line
ends are the writer's row separator. Reading parses whole files record by record with a
streaming reader, and ``assemble`` joins the three kinds through their identifiers into one
nested row per capture.

Defined cases: a null html is an empty payload; a null url is an empty target; payloads of
under ``min_revisit`` bytes are always responses; among equal payloads the smallest page_id
is the response (rows that repeat that id too); rows with a null page_id never are when
another has an id; every input row gives one capture, repeated rows included; an empty table gives no rows;
other columns, whatever their names, are not read. A long payload is held whole by the task that
writes or parses it, and a file of the archive by the one that parses it.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.storage import materialise, remove, scratch_path

CRLF = "\r\n"
#: A hot payload's rows are dealt over so many salts when its response is looked up.
SALTS = 32
RECORDS = "record_type string, record_id string, concurrent_to string, refers_to_record string, tag string, target_uri string, digest string, payload_bytes long, payload_digest string, page_id long, payload string"


def with_revisits(pages: DataFrame, *, min_revisit: int = 100) -> DataFrame:
    """Adds payload, digest, n_bytes, and for repeated payloads ``first_id``, the response's page_id."""
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("payload"))
    base = base.withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256)).withColumn("n_bytes", F.octet_length("payload").cast("long"))
    base = base.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    shared = base.filter(F.col("n_bytes") >= min_revisit).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"), F.collect_set("salt").alias("salts"))
    # a response is repeated only for the salts that its rows have
    shared = shared.filter("n > 1 AND first_id IS NOT NULL").select("digest", "first_id", F.explode("salts").alias("salt"))
    return base.join(shared, ["digest", "salt"], "left").drop("salt")


def write_archives(pages: DataFrame, path: str, *, date: str = "1970-01-01T00:00:00Z", min_revisit: int = 100, captures_per_file: int = 4096) -> None:
    """Writes every page as three records into gzip archives below ``path``."""
    rows = with_revisits(pages, min_revisit=min_revisit).withColumn("tag", F.expr("uuid()"))

    def name(role: str, *parts: str) -> F.Column:
        h = F.md5(F.concat_ws("|", F.lit(role), *(F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts)))
        return F.concat(F.lit("<urn:uuid:"), *[x for k, (a, n) in enumerate(((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) for x in ([F.lit("-")] if k else []) + [F.substring(h, a, n)]], F.lit(">"))

    uri = F.regexp_replace("url", r"[\r\n ]", "%20")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    # a response's name follows from its page and payload, so that revisits can give it without another lookup
    own = F.when(revisit, name("revisit", "tag")).otherwise(name("response", "page_id", "digest"))

    def record(kind: F.Column | str, rid: F.Column, headers: list[F.Column], kind_of_block: str, block: F.Column) -> F.Column:
        head = [F.lit("WARC/1.1" + CRLF + "WARC-Type: "), F.lit(kind) if isinstance(kind, str) else kind, F.lit(CRLF + "WARC-Record-ID: "), rid, F.lit(f"{CRLF}WARC-Date: {date}{CRLF}WARC-Target-URI: "), uri, F.lit(CRLF + "X-Capture-Tag: "), F.col("tag")]
        return F.concat(*head, *headers, F.lit(f"{CRLF}Content-Type: {kind_of_block}{CRLF}Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF + CRLF), block)

    together = [F.lit(CRLF + "WARC-Concurrent-To: "), own]
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n_bytes").cast("string"), F.lit(CRLF + CRLF))
    refers = F.when(revisit, F.concat(F.lit(f"{CRLF}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{CRLF}WARC-Refers-To: "), name("response", "first_id", "digest"))).otherwise(F.lit(""))
    main = record(F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")), own, [F.lit(CRLF + "WARC-Payload-Digest: sha256:"), F.col("digest"), refers], "application/http; msgtype=response", F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload"))))
    request = record("request", name("request", "tag"), together, "application/http; msgtype=request", F.concat(F.lit("GET "), uri, F.lit(" HTTP/1.1" + CRLF + CRLF)))
    fields = F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(CRLF + "payload-bytes: "), F.col("n_bytes").cast("string"), F.lit(CRLF))
    meta = record("metadata", name("metadata", "tag"), together, "application/warc-fields", fields)
    rows.select(F.concat_ws(CRLF * 2, request, main, meta).alias("value")).write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", captures_per_file).text(path)


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record of one archive."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers = {}
        while (line := stream.readline()).strip():
            key, _, value = line.decode().partition(":")
            headers[key.strip().lower()] = value.strip()
        block = stream.read(int(headers["content-length"]))
        if len(block) != int(headers["content-length"]):
            raise ValueError(f"truncated record {headers.get('warc-record-id')}")
        yield headers, block


def read_archives(spark, path: str, *, with_payload: bool = True) -> DataFrame:
    """One row per record (see ``RECORDS``); a payload's digest and size are taken from the bytes read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORDS.split(", ")]
        kinds = {"payload_bytes": pa.int64(), "page_id": pa.int64()}
        types = [kinds.get(n, pa.string()) for n in names]
        for batch in batches:
            for content in batch.column(0):
                rows, room = [], 0
                data = content.as_buffer()
                stream = gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2].to_pybytes() == b"\x1f\x8b" else io.BytesIO(data)
                for h, block in parse(io.BufferedReader(stream, 1 << 16)):
                    kind, payload, page = h["warc-type"], None, None
                    if kind in ("response", "revisit"):
                        payload = block.partition(b"\r\n\r\n")[2]
                    if kind == "metadata":
                        own = dict(x.split(b": ", 1) for x in block.split(b"\r\n") if b": " in x)
                        page = int(own[b"page-id"]) if own.get(b"page-id", b"").strip() else None
                        size = int(own[b"payload-bytes"])
                    else:
                        size = None if payload is None else len(payload)
                    digest = h.get("warc-payload-digest", "").removeprefix("sha256:") or None
                    read = hashlib.sha256(payload).hexdigest() if kind == "response" else None
                    if read and digest and read != digest:
                        raise ValueError(f"payload of {h['warc-record-id']} doesn't match its digest")
                    rows.append((kind, h["warc-record-id"], h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("x-capture-tag"), h.get("warc-target-uri"), digest, size, read, page, payload.decode() if with_payload and kind == "response" else None))
                    room += len(block)
                    if len(rows) >= 4096 or room > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                        rows, room = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(run, RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: request, response (or revisit) and metadata joined through concurrent-to.

    A revisit's ``refers_to`` is the page of the response that it names; ``read_bytes`` and ``read_digest`` are of the payload as
    read, a revisit's of that response's.
    """
    main = records.filter("record_type IN ('response', 'revisit')").select("record_id", "tag", F.struct("record_type", "record_id", "refers_to_record", "target_uri", "digest", "payload_bytes", "payload_digest", "payload").alias("response"))
    request = records.filter("record_type = 'request'").select(F.col("concurrent_to").alias("record_id"), "tag", F.struct(F.col("record_id").alias("request_id"), "target_uri").alias("request"))
    meta = records.filter("record_type = 'metadata'").select(F.col("concurrent_to").alias("record_id"), "tag", F.struct(F.col("record_id").alias("metadata_id"), "page_id", "payload_bytes").alias("metadata"))
    captures = main.join(request, ["record_id", "tag"], "left").join(meta, ["record_id", "tag"], "left")
    first = captures.filter("response.record_type = 'response'").select("*", F.lit(None).cast("long").alias("refers_to"), F.col("response.payload_bytes").alias("read_bytes"), F.col("response.payload_digest").alias("read_digest"))
    salted = F.pmod(F.xxhash64("tag"), F.lit(SALTS)).cast("int")
    again = captures.filter("response.record_type = 'revisit'").select("*", F.col("response.refers_to_record").alias("refers_to_record"), salted.alias("salt"))
    # what revisits name, at most SALTS rows a response: only these responses are looked up and repeated
    wanted = records.filter("record_type = 'revisit'").select("refers_to_record", salted.alias("salt")).distinct()
    responses = records.filter("record_type = 'response'").select(F.col("record_id").alias("refers_to_record"), "tag", "payload_bytes", "payload_digest").join(wanted.select("refers_to_record").distinct(), "refers_to_record", "left_semi")
    pages = records.filter("record_type = 'metadata'").select(F.col("concurrent_to").alias("refers_to_record"), "tag", "page_id")
    # a response's name is made of its page and payload: one row per name, also where rows repeat
    named = responses.join(pages, ["refers_to_record", "tag"], "left").groupBy("refers_to_record").agg(F.min("page_id").alias("refers_to"), F.min("payload_bytes").alias("read_bytes"), F.min("payload_digest").alias("read_digest"))
    again = again.join(wanted.join(named, "refers_to_record"), ["refers_to_record", "salt"], "left").drop("refers_to_record", "salt")
    return first.unionByName(again.select(*first.columns))


def round_trip(pages: DataFrame, *, path: str | None = None, with_payload: bool = True) -> DataFrame:
    """Writes archives in the shared folder (or ``path``), reads them back, and returns the assembled captures."""
    spark = pages.sparkSession
    own = path or scratch_path(spark, "warc")
    write_archives(pages, own)
    # the joins read the records several times: parse the archives once
    records = materialise(read_archives(spark, own, with_payload=with_payload), "records")
    if path is None:  # scratch archives, read whole by now
        remove(spark, own)
    return assemble(records)
