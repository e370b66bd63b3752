"""WARC archives: one gzip member per record, and a reader whose tasks each scan a byte range."""

import hashlib
import uuid
import zlib
from urllib.parse import urlsplit

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path, stored
from .common import batch_of, fields_of

LEAST_SHARED = 1000
RANGE_BYTES = 8 << 20
STEP_BYTES = 1 << 20
MAGIC = b"\x1f\x8b\x08"
DATE = "2024-01-01T00:00:00Z"


def filesystem(path):
    """The file system of a path or address, and the path inside it."""
    return fs.FileSystem.from_uri(path) if urlsplit(path).scheme else (fs.LocalFileSystem(), path)


def urn(page_id, digest):
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def record(page_id, url, payload, digest, kind, refers_to):
    """One record as a gzip member.  A revisit has the headers of the answer and no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if kind == "revisit" else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {urn(page_id, digest)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {'' if url is None else ' '.join(url.split())}", f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"Page-ID: {page_id}")
    if url is None:
        head.append("No-URI: 1")
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {urn(refers_to, digest)}", f"Refers-To-Page-ID: {refers_to}"]
    pack = zlib.compressobj(3, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def shared_payloads(pages, page_id="page_id", html="html", least=LEAST_SHARED):
    """The payload digests that occur under more than one page id, with the largest id: the records that others refer to."""
    body = F.coalesce(F.col(html), F.lit(""))
    narrow = pages.select(F.col(page_id).alias("id"), F.sha1(body.cast("binary")).alias("digest"), F.octet_length(body).alias("bytes"))
    groups = narrow.filter(F.col("bytes") >= least).groupBy("digest").agg(F.max("id").alias("top"), F.count(F.lit(1)).alias("n"))
    return stored(groups.filter("n > 1 and top is not null").select("digest", "top"), "shared")


def write_warc(pages, directory, page_id="page_id", url="url", html="html", least=LEAST_SHARED):
    """Write every page as a record below ``directory`` (one file per task) and return the stored list of files and sizes.

    Of equal payloads of ``least`` bytes or more the record with the largest page id is the response and the others are
    revisits of it; a row that repeats that id is a response too, and so are equal payloads that have no id at all.  A task
    writes under a name of its own attempt and only the files that committed tasks report are read, so a lost or repeated
    task leaves no doubt.
    """
    body = F.coalesce(F.col(html), F.lit("")).cast("binary")
    src = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), body.alias("payload"), F.sha1(body).alias("digest"))
    src = src.join(shared_payloads(pages, page_id, html, least), "digest", "left").select("page_id", "url", "payload", "digest", "top")
    fields = {"path": "string", "bytes": "long", "records": "long"}

    def run(batches):
        store, root = filesystem(directory)
        task = TaskContext.get()
        name = f"pages-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        out, n = None, 0
        try:
            for batch in batches:
                for page, address, payload, digest, top in zip(*(c.to_pylist() for c in batch.columns)):
                    if out is None:
                        store.create_dir(root, recursive=True)
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                    revisit = top is not None and page != top
                    out.write(record(page, address, payload, digest, "revisit" if revisit else "response", top))
                    n += 1
        finally:
            if out is not None:
                out.close()
        if out is not None:
            size = store.get_file_info(f"{root}/{name}").size
            yield batch_of({"path": [f"{directory}/{name}"], "bytes": [size], "records": [n]}, fields)

    return stored(src.mapInArrow(run, T.StructType(fields_of(fields))), "archives")


class Window:
    """Bytes of an open file from a moving start, read in steps."""

    def __init__(self, source, size):
        self.source, self.size, self.start, self.data = source, size, 0, b""

    def at(self, pos, need):
        """At least ``need`` bytes from ``pos`` (fewer at the end of the file)."""
        end = min(pos + need, self.size)
        if not self.start <= pos or end > self.start + len(self.data):
            self.data = self.source.read_at(min(max(need, STEP_BYTES), self.size - pos), pos)
            self.start = pos
        return memoryview(self.data)[pos - self.start:]


def member_at(window, pos):
    """The record in the gzip member at ``pos`` and the place after it, or None if no record begins there."""
    pack, got, feed = zlib.decompressobj(31), [], pos
    checked = False
    try:
        while not pack.eof and feed < window.size:
            chunk = window.at(feed, 65536)[:262144]
            got.append(pack.decompress(chunk))
            feed += len(chunk)
            if not checked and sum(map(len, got)) >= 7:
                if not b"".join(got).startswith(b"WARC/1."):
                    return None
                checked = True
    except zlib.error:
        return None
    if not pack.eof or not checked:
        return None
    head, _, rest = b"".join(got).partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    if not headers.get("content-length", "").isdigit():
        return None
    return (headers, rest[:int(headers["content-length"])]), feed - len(pack.unused_data)


def records_in(source, size, start, end):
    """(offset, headers, block) of the records that begin in [start, end).

    Until the first record is found the range is scanned for the gzip magic, and a candidate counts only if it decodes to a
    record's headers and to the member's check sum; from there on each member begins where the last one ended.
    """
    window, pos = Window(source, size), start
    while pos < end:
        view = bytes(window.at(pos, min(STEP_BYTES, end - pos) + len(MAGIC))[:min(STEP_BYTES, end - pos) + len(MAGIC) - 1])
        step = min(STEP_BYTES, end - pos)
        hit = view.find(MAGIC)
        if hit < 0:
            pos += step
            continue
        pos += hit
        if pos >= end:
            return
        found = member_at(window, pos)
        if found is None:
            pos += 1
            continue
        while found is not None:
            (headers, block), after = found
            yield pos, headers, block
            pos = after
            found = member_at(window, pos) if pos < end else None


READ = {
    "path": "string", "offset": "long", "record_type": "string", "record_id": "string", "url": "string", "page_id": "long",
    "refers_to": "long", "payload_bytes": "long", "payload_digest": "string", "payload": "binary",
}


def read_warc(archives, range_bytes=RANGE_BYTES, payload=True):
    """Every record of the files in ``archives`` (path, bytes), read by ranges of ``range_bytes``.

    A record belongs to the range in which its member begins.  Length and digest are those of the full payload: computed
    from the bytes for a response, and taken from the headers for a revisit, which has none.
    """
    spark = archives.sparkSession
    ranges = archives.select("path", F.col("bytes").alias("size"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(range_bytes).cast("long"))).alias("start"))
    n = max(1, ranges.count())
    fields = {k: v for k, v in READ.items() if payload or k != "payload"}

    def rows(headers, block):
        head, _, body = block.partition(b"\r\n\r\n")
        kind = headers["warc-type"]
        told = dict(x.split(": ", 1) for x in head.decode("latin-1").split("\r\n")[1:])
        number = lambda k: int(headers[k]) if k in headers else None
        full = kind != "revisit"
        return {
            "record_type": kind, "record_id": headers["warc-record-id"], "url": None if "no-uri" in headers else headers["warc-target-uri"],
            "page_id": number("page-id"), "refers_to": number("refers-to-page-id"),
            "payload_bytes": len(body) if full else int(told["Content-Length"]),
            "payload_digest": hashlib.sha1(body).hexdigest() if full else headers["warc-payload-digest"].removeprefix("sha1:"),
            "payload": body if full else None,
        }

    def run(batches):
        for batch in batches:
            for path, size, start in zip(*(c.to_pylist() for c in batch.columns)):
                store, inside = filesystem(path)
                out, held = {k: [] for k in fields}, 0
                with store.open_input_file(inside) as source:
                    for offset, headers, block in records_in(source, size, start, min(size, start + range_bytes)):
                        row = {"path": path, "offset": offset, **rows(headers, block)}
                        for k in fields:
                            out[k].append(row[k])
                        held += len(block)
                        if held > 16 << 20:
                            yield batch_of(out, fields)
                            out, held = {k: [] for k in fields}, 0
                if out["path"]:
                    yield batch_of(out, fields)

    return ranges.repartition(min(n, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))).mapInArrow(run, T.StructType(fields_of(fields)))


def round_trip(pages, page_id="page_id", url="url", html="html", directory=None):
    """Write the pages as archives in the shared folder, then read every record back.

    A null html is an empty payload; null ids and addresses come back null; repeated rows give a record each; an empty table
    writes no file and gives no rows.
    """
    where = directory or scratch_path(pages.sparkSession, "warc")
    return read_warc(write_warc(pages, where, page_id, url, html), payload=False)
