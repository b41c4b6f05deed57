"""WARC archives: a writer that stores equal payloads once, and a reader that salvages damaged archives.

An archive is a sequence of gzip members, each one record; the reader takes
plain archives too.  Both sides go through Spark's own file sources, so
archives lie wherever Spark can write.

Writing: every record is made and compressed in its task, and runs of them are
put out by the text sink, whose line separator is set to an empty gzip member;
the file is then nothing but gzip members.

Salvaging: a member that does not decompress, fails its checksum or is cut
off, a header that cannot be read, a length that runs past the end and a digest
that does not match are failed checks.  The reader then searches for the next
place where a whole valid member (or, in a plain archive, a version line with a
whole record) starts, goes on from there, and logs the bytes between as a
quarantined gap.  Inside a member, whole or as far as it inflates, the search
is for the next version line with a whole record, and a gap beside records says
where in the member's content it lies.  In a member that does not decompress or
fails its checksum only records count that their own digest proves, and not one
that ends where the content does.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents, small_batches

#: Equal payloads of at least so many bytes are stored once.
REVISIT_BYTES = 100
#: Bytes of records, before compression, that one file holds at most, if it holds more than one: keeps an archive small enough to be read by one task.
FILE_BYTES = 128 << 20
#: Bytes of records that are put out as one piece.  Payloads of so many bytes or fewer are of one size class; each further class holds up to four times as many.
SMALL = 1 << 20
#: Compressed bytes that are inflated at a time.
PIECE = 1 << 14
GZIP = b"\x1f\x8b\x08"
DAMAGED = "member is damaged"
#: Fixed value: an empty gzip member.
EMPTY_MEMBER = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff\x03\x00" + bytes(8)
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
ENTRY = "archive string, start long, stop long, problem string, record_type string, record_id string, target string, refers_to string, payload_bytes long, payload_digest string, payload binary"


def record(rec_id: str, uri: str | None, payload: bytes, digest: str, refers: str | None) -> bytes:
    """One uncompressed record; refers makes it a revisit without payload."""
    block = b"" if refers is not None else HTTP + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{rec_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if uri is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri))
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"X-Payload-Length: {len(payload)}"]
    if refers is None:
        lines.append("Content-Type: application/http; msgtype=response")
    else:
        lines += [f"WARC-Refers-To: <urn:page:{refers}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def with_originals(rows: DataFrame, first: DataFrame, min_bytes: int) -> DataFrame:
    """Adds original: the smallest id with the same payload, null where that is the row itself or the payload is short.

    first holds the smallest id of each digest that occurs twice.  Short
    payloads meet nothing: each has a key of its own, so they are dealt out evenly.
    """
    alone = F.concat(F.lit("-"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    rows = rows.withColumn("meets", F.when(F.octet_length("payload") >= min_bytes, F.col("digest")).otherwise(alone))
    rows = rows.join(first, F.col("meets") == F.col("of"), "left")
    return rows.withColumn("original", F.when(F.col("first") != F.col("id"), F.col("first"))).drop("of", "first", "meets")


def write_archives(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = REVISIT_BYTES) -> None:
    """Writes one record for each row of pages into archives in the folder `path`.

    The payload is the html in UTF-8, empty for null.  Of rows with equal
    payloads of at least min_bytes bytes that with the smallest id is a
    response and the others refer to it; rows that share even that id are
    responses.  A null id or url is left out of the header.  An empty table
    writes archives without records.  Records are put out in pieces of about
    SMALL, so that a file's number of pieces bounds its bytes; payloads
    above that are written apart, by size class.  Ids are whole numbers.
    """
    small_batches(pages.sparkSession)
    scratch = Scratch(pages.sparkSession, "warc-digests")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    size = F.octet_length("payload")
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("size_class", F.when(size <= SMALL, 0).otherwise(F.ceil(F.log(size / SMALL) / F.log(F.lit(4.0)))).cast("int"))
    large = [r[0] for r in rows.where(size > SMALL).select("size_class").distinct().collect()]  # a few, as a text has less than 2 GiB
    first = rows.where(size >= min_bytes).groupBy(F.col("digest").alias("of")).agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    rows = with_originals(rows, scratch.keep(first, "digests"), min_bytes)

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in batches:
            for rec, uri, payload, digest, refers in zip(*(batch[c] for c in ("rec", "url", "payload", "digest", "refers")), strict=True):
                made = record(rec or "", uri, payload, digest, refers)
                held.append(gzip.compress(made, 6, mtime=0))
                size += len(made)
                if size >= SMALL:
                    yield pd.DataFrame({"value": [b"".join(held)]})
                    held, size = [], 0
        if held:
            yield pd.DataFrame({"value": [b"".join(held)]})

    columns = [F.col("id").cast("string").alias("rec"), F.col("url"), F.col("payload"), F.col("digest"), F.col("original").cast("string").alias("refers")]
    for c in [0, *sorted(large)]:
        most = max(1, FILE_BYTES // (2 * SMALL * 4**c))
        made = rows.where(F.col("size_class") == c).select(*columns).mapInPandas(pieces, "value binary").select(F.col("value").cast("string"))
        made.write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("maxRecordsPerFile", most).mode("append").text(path)


def parse(data: bytes, start: int = 0) -> tuple[dict, bytes, int]:
    """Header fields (lower-case names), block and end of the record at `start`; ValueError says which check failed."""
    if not (m := VERSION.match(data, start)):
        raise ValueError("no version line")
    if (stop := data.find(b"\r\n\r\n", m.end() - 2)) < 0:
        raise ValueError("header does not end")
    fields = {}
    for line in data[m.end() : stop].decode("utf-8", "replace").split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError("header line without a name")
        fields[name.strip().lower()] = value.strip()
    if not (size := fields.get("content-length", "")).isdecimal():
        raise ValueError("no length")
    block = data[stop + 4 : stop + 4 + int(size)]
    end = stop + 4 + int(size)
    if len(block) < int(size) or data[end : end + 4] != b"\r\n\r\n":
        raise ValueError("record does not end where its length says")
    digest = fields.get("warc-block-digest", "")
    if digest.startswith("sha256:") and digest[7:].lower() != hashlib.sha256(block).hexdigest():
        raise ValueError("block digest differs")
    return fields, block, end + 4


def inflate(data: bytes, start: int) -> tuple[bytes, int]:
    """Content and end of the gzip member at `start`; ValueError if it is damaged or cut off."""
    d = zlib.decompressobj(31)
    out, pos = [], start
    try:
        while not d.eof and pos < len(data):  # piece by piece, as what follows the member is copied
            out.append(d.decompress(data[pos : pos + PIECE]))
            pos += PIECE
    except zlib.error as e:
        raise ValueError(DAMAGED) from e
    if not d.eof:
        raise ValueError("member is cut off")
    return b"".join(out), min(pos, len(data)) - len(d.unused_data)


def remains(data: bytes, start: int) -> bytes:
    """What can be inflated of the damaged or cut member at `start`."""
    d = zlib.decompressobj(31)
    out, pos = [], start
    while not d.eof and pos < len(data):
        before = d.copy()
        try:
            out.append(d.decompress(data[pos : pos + PIECE]))
        except zlib.error:
            try:
                for i in range(pos, min(pos + PIECE, len(data))):
                    out.append(before.decompress(data[i : i + 1]))
            except zlib.error:
                break
        pos += PIECE
    return b"".join(out)


def members_records(content: bytes, failed: str | None) -> list[tuple[str | None, dict | None, bytes | None]]:
    """(problem, fields, block) of the records and gaps in a member's content, in order; failed says what is wrong with the member."""

    def read(pos: int) -> tuple[dict, bytes, int]:
        fields, block, end = parse(content, pos)
        if failed == DAMAGED and (end == len(content) or not fields.get("warc-block-digest", "").startswith("sha256:")):
            raise ValueError(failed)
        return fields, block, end

    found, pos = [], 0
    while pos < len(content):
        try:
            fields, block, pos = read(pos)
            found.append((None, fields, block))
        except ValueError as e:
            problem, stop = str(e), len(content)
            for m in VERSION.finditer(content, pos + 1):
                try:
                    read(m.start())
                except ValueError:
                    continue
                stop = m.start()
                break
            if failed and stop == len(content):
                problem = failed
            found.append(((problem, pos, stop), None, None))
            pos = stop
    if failed and (not found or found[-1][1]):
        found.append(((failed, pos, pos), None, None))
    alone = len(found) == 1
    return [(p and (p[0] if alone else f"{p[0]}, bytes {p[1]} to {p[2]} of the member's content"), fields, block) for p, fields, block in found]


def salvage(data: bytes) -> Iterator[tuple[int, int, str | None, dict | None, bytes | None]]:
    """(start, stop, problem, fields, block) of all records and gaps of an archive, in order and without overlap.

    A gap has a problem and no fields; it reaches from the place of the failed
    check to the next valid record, or to the end.  Records and gaps of one
    member have the member's bounds, if it is damaged those up to what follows.
    """
    view = memoryview(data)
    packed = data.startswith(GZIP) or not VERSION.search(data)

    def at(pos: int) -> tuple[int | None, list[tuple[str | None, dict | None, bytes | None]]]:
        """End of what starts here, None where that cannot be told, and its records and gaps."""
        if not packed:
            try:
                fields, block, end = parse(data, pos)
            except ValueError as e:
                return None, [(str(e), None, None)]
            return end, [(None, fields, block)]
        try:
            content, end = inflate(view, pos)
        except ValueError as e:
            return None, members_records(remains(view, pos), str(e))
        return end, members_records(content, None)

    def readable(pos: int) -> bool:
        end, found = at(pos)
        return any(fields for _, fields, _ in found) or (end is not None and not found)

    def starts(pos: int) -> Iterator[int]:
        while True:
            if packed:
                pos = data.find(GZIP, pos)
            else:
                pos = m.start() if (m := VERSION.search(data, pos)) else -1
            if pos < 0:
                return
            yield pos
            pos += 1

    pos = 0
    while pos < len(data):
        end, found = at(pos)
        if end is None:
            end = next(filter(readable, starts(pos + 1)), len(data))
        for entry in found:
            yield pos, end, *entry
        pos = end


def payload_of(block: bytes) -> bytes:
    """The body of a stored HTTP message."""
    head = block.find(b"\r\n\r\n")
    return block[head + 4 :] if head >= 0 else b""


def read_archives(spark: SparkSession, path: str, *, payloads: bool = True) -> DataFrame:
    """One row for each record and each quarantined gap of the archives in the folder `path`; columns as in ENTRY.

    Gaps have a problem and byte bounds only.  Responses have the length and
    digest of the payload as read; a response whose payload does not match the
    digest in its header is a gap.  Revisits have those of the payload they
    refer to, from their header, and no payload.  An archive is read as one
    piece by one task; empty members and files give no row.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"], strict=True):
                out, size = [], 0
                for start, stop, problem, fields, block in salvage(bytes(data)):
                    row = [name, start, stop, problem, *[None] * 7]
                    if fields is not None:
                        kind = fields.get("warc-type")
                        row[4:8] = kind, *(m[1] if (m := re.fullmatch(r"<urn:page:(.*)>", x or "")) else x for x in (fields.get("warc-record-id"), fields.get("warc-target-uri"), fields.get("warc-refers-to")))
                        declared = fields.get("warc-payload-digest", "").removeprefix("sha256:").lower()
                        if kind == "response":
                            payload = payload_of(block)
                            digest = hashlib.sha256(payload).hexdigest()
                            if re.fullmatch("[0-9a-f]{64}", declared) and declared != digest:
                                row[3:8] = "payload digest differs", *[None] * 4
                            else:
                                row[8:11] = len(payload), digest, payload if payloads else None
                                size += len(payload) * payloads
                        else:
                            length = fields.get("x-payload-length", "")
                            row[8:10] = int(length) if length.isdecimal() else None, declared or None
                    out.append(row)
                    if size > 8 << 20:
                        yield frame(out)
                        out, size = [], 0
                yield frame(out)

    columns = [c.split()[0] for c in ENTRY.split(", ")]

    def frame(rows: list) -> pd.DataFrame:
        df = pd.DataFrame(rows, columns=columns)
        return df.astype({"start": "int64", "stop": "int64", "payload_bytes": "Int64"})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, ENTRY)


class Lost(RuntimeError):
    """Fewer records came back than were written."""


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records read back from archives of all pages.  What was read is stored with its gap log; a record that is missing is an error."""
    scratch = Scratch(spark, "warc")
    pages = documents(spark, sf_dir, "pages")
    write_archives(pages, path := scratch.path("archives"))
    found = scratch.keep(read_archives(spark, path, payloads=False).drop("payload"), "entries")
    n, gaps = found.agg(F.count(F.when(F.col("problem").isNull(), 1)), F.count("problem")).first()
    if gaps or n != pages.count():
        where = [tuple(r) for r in found.where("problem IS NOT NULL").select("archive", "start", "stop", "problem").limit(20).collect()]
        raise Lost(f"{pages.count()} records were written and {n} read; {gaps} gaps, the first are {where}; all are in {found.scratch_path}")
    found = found.where("problem IS NULL")
    return found.select(F.col("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


OP4_SQL = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha256(coalesce(html, '')) AS d FROM pages),
q AS (SELECT *, octet_length(b) AS n, min(page_id) OVER (PARTITION BY d) AS f FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 100 AND f <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND f <> page_id THEN f END AS refers_to
FROM q
"""
