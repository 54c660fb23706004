"""WARC archives as a chunked record table.

Writing: each page becomes one record; a payload longer than `chunk` bytes becomes a first
segment and continuation records (WARC-Segment-Number, WARC-Segment-Origin-ID), so no record
in a file is longer than a chunk. Records are cut from the page's own buffer one at a time,
are a gzip member each, and go to files of at most `records_per_file` pages, named
part-*.warc.gz by task; a file appears under its name when it is whole, and a task that runs
again replaces its files. One warcinfo record, in a file of its own, is named by all others. Of
pages with equal payloads (SHA-256 and length) of `least` bytes or more, the one with the
smallest page_id is a response, the others revisit it without a payload and name its record.

Reading: every record of a page begins with its version line and the WARC-Warcinfo-ID, a
random id of this write, so Spark's line reader cuts the streams of gzip files at those bytes and
no task holds more than a chunk at a time. That gives the chunk table: a row for each record
identifier and chunk number. Records of one chunk are digested where they lie. The chunks
of longer ones are dealt by record, sorted by number and streamed through one running
SHA-256 each: a payload is never put together.

Cases: null html is an empty payload; a null url is an empty one, and control characters
in it become %20; rows that repeat page_id and payload are records of their own and of the
same type; a null page_id is carried as such and a revisit wherever a page with an id has
its payload; no pages give an archive without
records; other columns are not read. A record shorter than its Content-Length or with
another digest than it states fails the read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import staged

CHUNK, LEAST, RECORDS_PER_FILE = 1 << 16, 100, 1024
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def separator(archive: str) -> str:
    return f"WARC/1.1\r\nWARC-Warcinfo-ID: <urn:uuid:{archive}>\r\n"


def _records(pages: DataFrame, id_col: str, url_col: str, html_col: str, least: int) -> DataFrame:
    """page_id, url, payload, n, digest of every page; refers_to (page_id) and whether it is a revisit, whether page and payload are repeated."""
    url = F.regexp_replace(F.coalesce(F.col(f"`{url_col}`").cast("string"), F.lit("")), r"[\x00-\x20\x7f]", "%20")
    payload = F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).cast("binary")
    base = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), url.alias("url"), payload.alias("payload"))
    base = base.select("*", F.octet_length("payload").cast("long").alias("n"), F.sha2("payload", 256).alias("digest"))
    narrow = base.select("page_id", "n", F.unhex("digest").alias("d")).groupBy("page_id", "n", "d").agg(F.count("*").alias("rows"))
    narrow = staged(narrow, "payloads")
    firsts = narrow.where(F.col("n") >= least).groupBy("d", "n").agg(F.min("page_id").alias("first"), F.count("*").alias("pages")).where("pages > 1").drop("pages")
    marks = narrow.join(firsts, ["d", "n"], "left").withColumn("refers_to", F.expr("if(page_id <=> first, NULL, first)"))
    marks = marks.where("refers_to IS NOT NULL OR (rows > 1 AND page_id IS NOT NULL)")
    marks = staged(marks.select(F.col("page_id").alias("p"), F.lower(F.hex("d")).alias("h"), "refers_to", (F.col("rows") > 1).alias("repeated")), "marks")
    found = base.join(marks, base["page_id"].eqNullSafe(marks["p"]) & (base["digest"] == marks["h"]), "left").drop("p", "h")
    return found.withColumn("revisit", F.col("refers_to").isNotNull()).withColumn("repeated", F.coalesce("repeated", F.lit(False)) & F.col("page_id").isNotNull())


def _line(key: str, value: object) -> str:
    return f"{key}: {value}\r\n"


def _member(*parts) -> bytes:
    """One gzip member of the parts."""
    z = zlib.compressobj(wbits=31)
    return b"".join([*(z.compress(x) for x in parts), z.flush()])


def record_id(page_id: int | None, digest: str, copy: int, segment: int) -> str:
    return f"<urn:tidemark:page:{'' if page_id is None else page_id}:{digest[:32]}:{copy}:{segment}>"


def members(page_id, url, payload: pa.Buffer, digest: str, refers_to, copy: int, archive: str, date: str, chunk: int):
    """The gzip members of a page's records, cut from its buffer."""
    n, revisit = payload.size, refers_to is not None
    body = payload.slice(0, 0) if revisit else payload
    segments = max(1, -(-body.size // chunk))
    for k in range(1, segments + 1):
        part = body.slice((k - 1) * chunk, min(chunk, body.size - (k - 1) * chunk))
        http = _HTTP.encode() if k == 1 else b""
        head = separator(archive) + _line("WARC-Type", "continuation" if k > 1 else "revisit" if revisit else "response")
        head += _line("WARC-Record-ID", record_id(page_id, digest, copy, k)) + _line("WARC-Date", date) + _line("WARC-Target-URI", url)
        if segments > 1:
            head += _line("WARC-Segment-Number", k)
            if k > 1:
                head += _line("WARC-Segment-Origin-ID", record_id(page_id, digest, copy, 1))
            if k == segments:
                head += _line("WARC-Segment-Total-Length", n + len(_HTTP))
        if k == 1:
            head += _line("WARC-Payload-Digest", f"sha256:{digest}") + _line("WARC-Payload-Length", n) + _line("Content-Type", "application/http; msgtype=response")
        if revisit:
            head += _line("WARC-Refers-To", record_id(refers_to, digest, 0, 1)) + _line("WARC-Profile", _PROFILE)
        yield _member((head + _line("Content-Length", len(http) + part.size) + "\r\n").encode(), http, part, b"\r\n\r\n")


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", chunk: int = CHUNK, least: int = LEAST, records_per_file: int = RECORDS_PER_FILE) -> str:
    """Writes WARC 1.1 files below path and gives the archive's id."""
    archive, date = str(uuid.uuid4()), datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    r = _records(pages, id_col, url_col, html_col, least).select("page_id", "url", "payload", "digest", "refers_to", "repeated")
    # rows that repeat page and payload are numbered where they meet; all others are written where they lie
    rows = r.where("NOT repeated").union(r.where("repeated").repartition("page_id", "digest"))
    uri = path if "://" in path or path.startswith("/") else path.replace(":", "://", 1)

    def write(batches):
        where, folder = fs.FileSystem.from_uri(uri)
        task = TaskContext.get()
        out = draft = final = None
        written = files = nulls = 0
        copies: dict[tuple[int, str], int] = {}

        def close():
            out.close()
            where.move(draft, final)

        for b in batches:
            ids, urls, digests, refers, repeated = (b.column(i).to_pylist() for i in (0, 1, 3, 4, 5))
            for i in range(b.num_rows):
                if written % records_per_file == 0:
                    if out:
                        close()
                    name = f"part-{task.partitionId():06d}-{files:05d}"
                    draft, final = f"{folder}/_{name}.{task.taskAttemptId()}", f"{folder}/{name}.warc.gz"
                    out, files = where.open_output_stream(draft, compression=None), files + 1
                copy = 0
                if ids[i] is None:
                    copy, nulls = (task.partitionId() << 40) + nulls, nulls + 1
                elif repeated[i]:
                    copy = copies.get((ids[i], digests[i]), 0)
                    copies[ids[i], digests[i]] = copy + 1
                for member in members(ids[i], urls[i], b.column(2)[i].as_buffer(), digests[i], refers[i], copy, archive, date, chunk):
                    out.write(member)
                written += 1
        if out:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([files], pa.int64()), pa.array([written], pa.int64())], ["files", "pages"])

    info = b"software: tidemark\r\nformat: WARC File Format 1.1\r\n"
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{archive}>\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n"
    where, folder = fs.FileSystem.from_uri(uri)
    where.create_dir(folder, recursive=True)
    with where.open_output_stream(f"{folder}/warcinfo.warc.gz", compression=None) as out:
        out.write(_member(head.encode(), info, b"\r\n\r\n"))
    staged(rows.mapInArrow(write, "files long, pages long"), "written")
    return archive


def read_chunks(spark: SparkSession, path: str, archive: str) -> DataFrame:
    """record (what its chunks share), page_id, chunk_no (from 1), record_type, stated (digest), length, refers_to, data: one row a record of the files."""
    lines = spark.read.option("lineSep", separator(archive)).option("pathGlobFilter", "part-*.warc.gz").text(path).where("value <> ''")
    lines = lines.select("value", F.substring_index("value", "\r\n\r\n", 1).alias("head"))
    of = lambda key: F.regexp_extract("head", rf"(?m)^{key}: ([^\r]*)", 1)
    raw = lines.select(
        of("WARC-Type").alias("kind"), of("WARC-Record-ID").alias("id"), of("WARC-Payload-Digest").alias("stated"), of("WARC-Payload-Length").alias("length"),
        of("WARC-Refers-To").alias("refers"), of("Content-Length").cast("long").alias("size"), (F.octet_length("head") + 4).alias("skip"), F.col("value").cast("binary").alias("raw"),
    )
    whole = F.when(F.octet_length("raw") >= F.col("skip") + F.col("size"), F.expr("substring(raw, skip + 1, int(size))")).otherwise(F.raise_error(F.concat(F.lit("cut record "), "id")))
    part = lambda column, k: F.split(F.regexp_replace(column, "[<>]", ""), ":")[k]
    number = lambda column: F.when(column != "", column.cast("long"))
    first = F.col("kind") != "continuation"
    return raw.withColumn("block", whole).select(
        F.concat_ws(":", part("id", 3), part("id", 4), part("id", 5)).alias("record"), number(part("id", 3)).alias("page_id"), part("id", 6).cast("int").alias("chunk_no"),
        F.when(first, F.col("kind")).alias("record_type"), F.when(first, F.substring_index("stated", ":", -1)).alias("stated"), F.when(first, F.col("length").cast("long")).alias("length"),
        F.when(F.col("refers") != "", number(part("refers", 3))).alias("refers_to"),
        F.when(first, F.expr(f"substring(block, octet_length('{_HTTP}') + 1)")).otherwise(F.col("block")).alias("data"),
    )


def read_records(spark: SparkSession, path: str, archive: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: one row a page, digests computed from what was read."""
    chunks = read_chunks(spark, path, archive)
    size = F.octet_length("data").cast("long")
    short = chunks.where("record_type IS NOT NULL AND (record_type = 'revisit' OR length <= octet_length(data))")
    seen = F.when(F.col("record_type") == "revisit", F.col("stated")).otherwise(F.sha2("data", 256))
    checked = F.when(seen == F.col("stated"), seen).otherwise(F.raise_error(F.concat(F.lit("wrong digest in page "), F.col("page_id").cast("string"))))
    short = short.select("page_id", F.when(F.col("record_type") == "revisit", F.col("length")).otherwise(size).alias("payload_bytes"), checked.alias("payload_digest"), "record_type", "refers_to")

    def stream(batches):
        now, digest, total, head = None, None, 0, None

        def ended():
            if head["stated"] != digest.hexdigest() or head["length"] != total:
                raise ValueError(f"wrong digest in page {head['page_id']}")
            return head["page_id"], total, digest.hexdigest()

        for b in batches:
            out = []
            for i in range(b.num_rows):
                record = b.column(0)[i].as_py()
                if record != now:
                    if now is not None:
                        out.append(ended())
                    now, digest, total = record, hashlib.sha256(), 0
                    head = {"page_id": b.column(1)[i].as_py(), "stated": b.column(3)[i].as_py(), "length": b.column(4)[i].as_py()}
                data = b.column(5)[i].as_buffer()
                digest.update(data)
                total += len(data)
            yield _rows(out)
        if now is not None:
            yield _rows([ended()])

    def _rows(out):
        cols = list(zip(*out)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], ["page_id", "payload_bytes", "payload_digest"])

    long = chunks.where("record_type IS NULL OR (record_type = 'response' AND length > octet_length(data))").select("record", "page_id", "chunk_no", "stated", "length", "data")
    long = long.repartition("record").sortWithinPartitions("record", "chunk_no").mapInArrow(stream, "page_id long, payload_bytes long, payload_digest string")
    return short.unionByName(long.select("*", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to")))
