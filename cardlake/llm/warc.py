"""WARC archives: pages written as response and revisit records, read back with segmented
records put together.

Writing: the HTTP message of a response has chunked transfer framing; one that is longer
than a segment is written as a first record and continuation records that name its
identifier.  Records are rows of text files whose line separator is the end mark of a WARC
record, so Spark's own writer makes the archives, commits them per task and reaches any
store.  Record identifiers depend on the task and the row's place in it, so a repeated
task writes the same ones.

Reading: each archive is parsed as a stream in one task; a file holds at most
``RECORDS`` x ``SEGMENT`` bytes of blocks.  Whole records are decoded on the spot; only
segments are shuffled, grouped by origin identifier, ordered by segment number and checked
against the total length before the framing is decoded.
"""

from __future__ import annotations

import gzip
import io
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardlake.llm.joins import measured_broadcast
from cardlake.session import cut

#: bytes of a block per record, of a transfer chunk, and records per archive
SEGMENT = 32_768
CHUNK = 8_192
RECORDS = 8_192
#: bytes of the largest archive file that is read
LARGEST = 1 << 29
#: payloads of at least this many bytes are written once
REVISIT_BYTES = 1_000

_NUMBER = re.compile("-?[0-9]{1,18}|-?[1-8][0-9]{18}")

END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record(kind: str, rid: str, date: str, block: bytes, extra: Iterable[tuple[str, object]]) -> bytes:
    """A record without the two line ends that close it."""
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{rid}>"), ("WARC-Date", date),
            *((k, v) for k, v in extra if v is not None), ("Content-Length", len(block))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n").encode() + block


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """Chunked transfer framing of a payload."""
    parts = [b"%x\r\n%b\r\n" % (len(c), c) for i in range(0, len(payload), size) if (c := payload[i:i + size])]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; ValueError if the framing is broken."""
    parts, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if size < 0 or body[end + 2 + size:end + 4 + size] != b"\r\n":
            if size:
                raise ValueError("broken chunk")
            return b"".join(parts)  # trailers may follow the last chunk
        if not size:
            return b"".join(parts)
        parts.append(body[end + 2:end + 2 + size])
        at = end + 4 + size


def page_records(page_id: int | None, url: str | None, html: str | None, digest: str, original: int | None, rid: str,
                 date: str, segment: int = SEGMENT) -> Iterator[bytes]:
    """The records of one page: a revisit of ``original`` if that is given, else a response."""
    about = [("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else None),
             ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Page-ID", page_id),
             ("Content-Type", "application/http; msgtype=response")]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if original is not None:
        yield _record("revisit", rid, date, http, [*about, ("WARC-Profile", PROFILE), ("X-Refers-To-Page-ID", original)])
        return
    block = http + chunked((html or "").encode("utf-8", "surrogatepass"))
    if len(block) <= segment:
        yield _record("response", rid, date, block, about)
        return
    parts = [block[i:i + segment] for i in range(0, len(block), segment)]
    yield _record("response", rid, date, parts[0], [*about, ("WARC-Segment-Number", 1)])
    for k, part in enumerate(parts[1:], 2):
        last = k == len(parts)
        yield _record("continuation", f"{rid}-{k}", date, part, [
            ("WARC-Segment-Origin-ID", f"<{rid}>"), ("WARC-Segment-Number", k),
            ("WARC-Segment-Total-Length", len(block) if last else None)])


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   date: str = "2024-01-01T00:00:00Z", revisit_bytes: int = REVISIT_BYTES, segment: int = SEGMENT,
                   records: int = RECORDS) -> None:
    """Write one response or revisit record per row of ``pages`` to gzip archives in ``path``.

    Of rows with equal payloads (the page in UTF-8, null: empty) of at least
    ``revisit_bytes`` bytes those with the largest id are responses and the others revisit
    that id.  Null ids count as smallest; payloads all of whose ids are null are responses.
    A null url gives a record without target; control characters in it are escaped.
    Repeated rows give a record each, other columns are ignored, an empty table gives no
    records."""
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"),
                        F.sha1(payload).alias("digest"), F.octet_length(payload).alias("size"))
    large = F.col("size") >= revisit_bytes
    originals = cut(rows.where(large).groupBy("digest").agg(F.max("id").alias("original"), F.count(F.lit(1)).alias("n"))
                    .where("n > 1 and original is not null").select("digest", "original"))
    # without large copies, or with few kinds of them, no page moves
    rows = rows.join(measured_broadcast(originals, 80), "digest", "left").select(
        "id", "url", "html", "digest", F.when(large & ~F.col("id").eqNullSafe(F.col("original")), F.col("original")).alias("original"))
    run = uuid.uuid4()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, k = TaskContext.get().partitionId(), 0
        for b in batches:
            out, size = [], 0
            for row in zip(*(b.column(i) for i in range(b.num_columns)), strict=True):
                rid = f"urn:uuid:{uuid.uuid5(run, f'{task}/{k}')}"
                k += 1
                for r in page_records(*(v.as_py() for v in row), rid, date, segment):
                    out.append(r)
                    size += len(r)
                if size > 1 << 23:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    (rows.mapInArrow(build, "record binary").select(F.col("record").cast("string"))
     .write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", records).text(path))


class Damaged(ValueError):
    """An archive that cannot be read on; the message says why."""


def parse_archive(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(lower-cased headers, block) of each record of an archive; raises ``Damaged`` where it
    cannot be read on."""
    try:
        while line := stream.readline():
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                raise Damaged("not at the start of a record")
            head: dict[str, str] = {}
            while (line := stream.readline()).strip():
                name, _, value = line.decode("utf-8", "replace").partition(":")
                head[name.strip().lower()] = value.strip()
            if not line:
                raise Damaged("archive ends within a header")
            size = head.get("content-length", "")
            if not (size.isascii() and size.isdigit()):
                raise Damaged("record without a length")
            block = stream.read(int(size))
            if len(block) != int(size):
                raise Damaged("archive ends within a record")
            yield head, block
    except (EOFError, OSError, zlib.error) as e:
        raise Damaged("broken compression") from e


def http_payload(block: bytes) -> bytes:
    """Payload of an HTTP message, with chunked framing decoded."""
    head, _, body = block.partition(b"\r\n\r\n")
    chunks = any(x.lower().replace(b" ", b"") == b"transfer-encoding:chunked" for x in head.split(b"\r\n"))
    return unchunked(body) if chunks else body


def assemble(numbers: list[int], blocks: list[bytes], total: int | None) -> tuple[bytes | None, str | None]:
    """(payload, problem) of the segments of one record, in any order; equal repeats count once."""
    parts = dict(sorted(set(zip(numbers, blocks, strict=True))))
    if len(parts) != len(set(zip(numbers, blocks, strict=True))):
        return None, "contradicting segments"
    if total is None or list(parts) != list(range(1, len(parts) + 1)):
        return None, "missing segment"
    block = b"".join(parts.values())
    if len(block) != total:
        return None, "wrong total length"
    try:
        return http_payload(block), None
    except ValueError:
        return None, "broken framing"


def read_archives(spark: SparkSession, path: str, largest: int = LARGEST) -> DataFrame:
    """The records of all archives (gzip or plain, of any name that does not start with ``_``
    or ``.``) in ``path``: record_id, page_id,
    record_type, target_uri, payload_digest (as the record states it), refers_to,
    ``payload`` and ``problem``.

    Segments are put together by origin identifier and segment number; the payload is null
    and ``problem`` says why if one is missing, if two contradict each other, if the total
    length differs or the framing is broken.  Revisits have no payload of their own.
    Records of other types are left out; no archives give no rows.  What precedes the damage
    in an archive that cannot be read to its end is read (up to the buffer in which its
    compression breaks); the rest gives one row with a ``problem``, the archive's path as ``record_id`` and the type ``damaged``, and so does a
    record without an identifier or with a number that is none.  An archive is one row of its
    task; one of over ``largest`` bytes is not opened and gives such a row too."""
    fields = [("record_id", pa.string()), ("origin", pa.string()), ("number", pa.int64()), ("total", pa.int64()),
              ("page_id", pa.int64()), ("record_type", pa.string()), ("target_uri", pa.string()), ("payload_digest", pa.string()),
              ("refers_to", pa.int64()), ("block", pa.binary()), ("payload", pa.binary()), ("problem", pa.string())]
    spelled = {pa.string(): "string", pa.int64(): "bigint", pa.binary(): "binary"}

    def damaged(problem: str, rid: str | None) -> tuple:
        return (rid, *[None] * 4, "damaged", *[None] * 5, problem)

    def row(head: dict[str, str], block: bytes) -> tuple | None:
        kind = head.get("warc-type")
        if kind not in ("response", "revisit", "continuation"):
            return None
        number, digest = head.get("warc-segment-number"), head.get("warc-payload-digest")
        rid = head.get("warc-record-id")
        numbers = [head.get(k) or None for k in ("warc-segment-number", "warc-segment-total-length", "x-page-id", "x-refers-to-page-id")]
        if not rid or any(v is not None and not _NUMBER.fullmatch(v) for v in numbers):
            return damaged("record without an identifier" if not rid else "number that is none", rid)
        payload = problem = None
        if kind == "response" and not number:
            try:
                payload = http_payload(block)
            except ValueError:
                problem = "broken framing"
        whole = [int(v) if (v := head.get(k)) else None for k in ("warc-segment-total-length", "x-page-id", "x-refers-to-page-id")]
        return (rid, head.get("warc-segment-origin-id", rid) if number else None, int(number) if number else None, whole[0], whole[1],
                kind, head.get("warc-target-uri"), digest.rpartition(":")[2] if digest else None, whole[2],
                block if number else None, payload, problem)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(fields)], names=[n for n, _ in fields])

        for b in batches:
            for name, content in zip(b.column("path"), b.column("content"), strict=True):
                if not content.is_valid:
                    yield batch([damaged("archive too large", name.as_py())])
                    continue
                data = content.as_buffer()
                plain = io.BytesIO(data) if data.size else io.BytesIO()
                stream = gzip.GzipFile(fileobj=plain) if data.size > 1 and data[0] == 0x1F and data[1] == 0x8B else plain
                rows, size = [], 0
                try:
                    for head, block in parse_archive(io.BufferedReader(stream, 1 << 16)):
                        if r := row(head, block):
                            rows.append(r)
                            size += len(block)
                        if size > 1 << 23:
                            yield batch(rows)
                            rows, size = [], 0
                except Damaged as e:
                    rows.append(damaged(str(e), name.as_py()))
                if rows:
                    yield batch(rows)

    files = spark.read.format("binaryFile").load(path)
    small = files.where(F.col("length") <= largest).select("path", "content")
    large = files.where(F.col("length") > largest).select("path", F.lit(None).cast("binary").alias("content"))  # not opened
    files = small.unionAll(large)
    parsed = files.mapInArrow(parse, ", ".join(f"{n} {spelled[t]}" for n, t in fields))
    shown = ["record_id", "page_id", "record_type", "target_uri", "payload_digest", "refers_to", "payload", "problem"]

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [assemble([s["number"] for s in v.as_py()], [s["block"] for s in v.as_py()], t.as_py())
                   for v, t in zip(b.column("segments"), b.column("total"), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in shown[:-2]] + [
                pa.array([p for p, _ in got], pa.binary()), pa.array([e for _, e in got], pa.string())], names=shown)

    first = [F.max(F.when(F.col("number") == 1, F.col(c))).alias(c) for c in shown[1:-2]]
    segments = (parsed.where("origin is not null").groupBy(F.col("origin").alias("record_id"))
                .agg(*first, F.max("total").alias("total"), F.collect_list(F.struct("number", "block")).alias("segments")))
    types = dict(parsed.dtypes)
    joined = segments.mapInArrow(put_together, ", ".join(f"{c} {types[c]}" for c in shown))
    return parsed.where("origin is null").select(*shown).unionAll(joined)


def payload_table(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of read records;
    revisits have the length and digest of the response that they refer to."""
    narrow = cut(records.select(
        "page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"),
        "record_type", "refers_to", F.col("payload_digest").alias("stated")))
    shown = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    responses = narrow.where("record_type <> 'revisit'")
    targets = (responses.where("page_id is not null").groupBy("page_id", "payload_digest").agg(F.max("payload_bytes").alias("payload_bytes"))
               .withColumnsRenamed({"page_id": "refers_to", "payload_digest": "stated"}))
    revisits = narrow.where("record_type = 'revisit'").drop("payload_bytes", "payload_digest").join(targets, ["refers_to", "stated"], "left")
    return responses.select(*shown).unionAll(
        revisits.select("page_id", "payload_bytes", F.when(F.col("payload_bytes").isNotNull(), F.col("stated")).alias("payload_digest"),
                        "record_type", "refers_to"))
