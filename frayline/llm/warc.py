"""WARC archives with a two-level capture index (operator 6).

* ``write_archive``: one gzip member per record; the first of equal payloads is a response, the others revisit it.
* ``write_index``: entries sorted by reversed-host URL key go to compressed blocks; each index file ends with its own
  sparse directory (first key and place of every block). Over the files there is a list of first keys, one per file.
* ``captures``: keys are dealt to index files by binary search in that list, then each task searches the file's
  directory, reads one block, searches it, and reads the record's byte range from the archive.

Files go to the shared folder through the filesystem its URI names. A file counts only if the written index lists it, so
files of failed or repeated attempts do no harm. The list of first keys has one row per index file, as many as the
index has partitions; nothing that grows with the rows is broadcast.

Rows: null html is an empty payload; a null or odd URL is its own key; null page ids never are what others refer to,
unless all ids of a payload are null (then all are responses); all rows with the smallest id of a payload are responses,
so repeated rows are; an empty table gives an empty archive and no rows. Payloads below ``min_bytes`` are all responses.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import zlib
from bisect import bisect_left, bisect_right
from collections import OrderedDict
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frayline.llm.common import batched, saved, shared_folder

BLOCK_ENTRIES = 1000
ARCHIVE_BYTES = 1 << 30
DATE = "2024-01-01T00:00:00Z"
_ENTRY = "key binary, file string, start long, length long"
_PART = "first_key binary, path string, entries long"
_CAPTURE = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def url_key(url: str | None) -> str:
    """Reversed host, then path and query: ``com,example)/path?query``."""
    try:
        parts = urlsplit((url or "").strip())
        host = (parts.hostname or "").rstrip(".")
        port = f":{parts.port}" if parts.port not in (None, 80, 443) else ""
    except ValueError:
        return url or ""
    if not host:
        return url or ""
    query = f"?{parts.query}" if parts.query else ""
    return f"{','.join(reversed(host.split('.')))}{port}){parts.path or '/'}{query}"


def entry_key(url: str | None, page_id: int | None) -> bytes:
    """URL key, then the page id in numeric order (nulls first)."""
    number = b"" if page_id is None else b"%020d" % (page_id + (1 << 63))
    return url_key(url).encode() + b"\x00" + number


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:frayline:page:{'' if page_id is None else page_id}>"


def _page(urn: str) -> int | None:
    number = urn.rstrip(">").rpartition(":")[2]
    return int(number) if number else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record. A revisit keeps the HTTP head, whose length field tells the full payload's size."""
    revisit = refers_to is not None
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block += b"" if revisit else payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127))))}" if not url.isascii() or not url.isprintable() or " " in url else f"WARC-Target-URI: {url}")
    if revisit:
        head += [f"WARC-Refers-To: {_urn(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(member: bytes) -> dict:
    """The fields of a record; payload is None for a revisit."""
    head, _, rest = gzip.decompress(member).partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    revisit = fields["WARC-Type"] == "revisit"
    return {
        "page_id": _page(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "payload_bytes": size if revisit else len(payload),
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:") if revisit else digest(payload),
        "record_type": fields["WARC-Type"], "refers_to": _page(fields["WARC-Refers-To"]) if revisit else None, "payload": None if revisit else payload,
    }


def _opened(folder: str):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    return system, path


def _task_name(prefix: str) -> str:
    from pyspark import TaskContext

    task = TaskContext.get()
    return f"{prefix}-{task.partitionId():06d}-{task.taskAttemptId()}"


def with_references(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``page_id, url, html`` and the page each row's payload repeats (null: it is a response)."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("_same", F.sha2("html", 256))
    alike = rows.filter(F.octet_length("html") >= min_bytes).groupBy("_same").agg(F.count("*").alias("n"), F.min("page_id").alias("_first"))
    repeated = saved(alike.filter("n > 1").select("_same", "_first"))
    own = rows.join(repeated, "_same", "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first"))
    return own.select("page_id", "url", "html", refers.alias("refers_to"))


def write_archive(pages: DataFrame, folder: str, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the records below ``folder``; returns one index entry per record, unsorted. Run it once (see ``saved``)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _opened(folder)
        name, out, number = _task_name("pages"), None, 0
        for batch in batches:
            keys, files, starts, lengths = [], [], [], []
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None or out.tell() >= archive_bytes:
                    if out is not None:
                        out.close()
                    file, number = f"{name}-{number}.warc.gz", number + 1
                    out = system.open_output_stream(f"{base}/{file}", compression=None)
                member = gzip.compress(record(page_id, url, html.encode(), refers_to), 6, mtime=0)
                for col, x in zip((keys, files, starts, lengths), (entry_key(url, page_id), file, out.tell(), len(member))):
                    col.append(x)
                out.write(member)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(files, pa.string()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64())], ["key", "file", "start", "length"])
        if out is not None:
            out.close()

    return with_references(batched(pages), min_bytes).mapInArrow(write, _ENTRY)


def write_index(entries: DataFrame, folder: str, block_entries: int = BLOCK_ENTRIES) -> DataFrame:
    """Sorted, compressed blocks with a directory per file; returns one row per index file. Run it once."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _opened(folder)
        path, directory, lines, n, out, first = f"{base}/{_task_name('index')}.idx", [], [], 0, None, None

        def flush() -> None:
            block = zlib.compress(b"\n".join(lines))
            directory.append([lines[0].split(b"\t", 1)[0].hex(), out.tell(), len(block)])
            out.write(block)
            lines.clear()

        for batch in batches:
            for key, file, start, length in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    out, first = system.open_output_stream(path, compression=None), key
                # keys are shown in hex, so that no byte of a URL can break a line; hex keeps their order
                lines.append(b"%s\t%s\t%d\t%d" % (key.hex().encode(), file.encode(), start, length))
                n += 1
                if len(lines) == block_entries:
                    flush()
        if out is not None:
            if lines:
                flush()
            tail = zlib.compress(json.dumps([[bytes.fromhex(k).decode(), a, b] for k, a, b in directory]).encode())
            out.write(tail + len(tail).to_bytes(8, "big"))
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([first], pa.binary()), pa.array([path]), pa.array([n])], ["first_key", "path", "entries"])

    # ties and repeated rows are spread too: the place of a record is part of the sort
    ordered = entries.repartitionByRange("key", "file", "start").sortWithinPartitions("key", "file", "start")
    return ordered.mapInArrow(write, _PART)


class _Reader:
    """Open files and the last block of one task."""

    def __init__(self, folder: str) -> None:
        self.system, self.base = _opened(folder)
        self.files: OrderedDict = OrderedDict()
        self.index, self.block_at, self.block = None, None, ([], [])

    def file(self, path: str):
        if path not in self.files:
            self.files[path] = self.system.open_input_file(path)
            if len(self.files) > 64:
                self.files.popitem(last=False)[1].close()
        self.files.move_to_end(path)
        return self.files[path]

    def directory(self, path: str) -> list:
        if self.index is None or self.index[0] != path:
            f = self.file(path)
            size = f.size()
            tail = int.from_bytes(f.read_at(8, size - 8), "big")
            blocks = json.loads(zlib.decompress(f.read_at(tail, size - 8 - tail)))
            self.index = (path, [x[0].encode() for x in blocks], blocks)
            self.block_at = None
        return self.index

    def entries(self, path: str, key: bytes) -> Iterator[list[bytes]]:
        """All entries of the key: search the directory, then blocks from the first that may hold it."""
        shown = key.hex().encode()
        _, firsts, blocks = self.directory(path)
        for b in range(max(0, bisect_left(firsts, shown) - 1), len(blocks)):
            if firsts[b] > shown:
                return
            if self.block_at != b:
                _, start, length = blocks[b]
                lines = zlib.decompress(self.file(path).read_at(length, start)).split(b"\n")
                self.block, self.block_at = ([x.split(b"\t", 1)[0] for x in lines], lines), b
            keys, lines = self.block
            for i in range(bisect_left(keys, shown), bisect_right(keys, shown)):
                yield lines[i].split(b"\t")[1:]

    def member(self, file: str, start: int, length: int) -> bytes:
        return self.file(f"{self.base}/{file}").read_at(length, start)


READ_BYTES = 4 << 20  # of compressed records a task reads back


def captures(keys: DataFrame, parts: DataFrame, folder: str, partitions: int | None = None) -> DataFrame:
    """Records of distinct ``keys`` (column key), read by ranges. A key's entries may run over several index files.

    ``partitions``: tasks that read. Without it Spark goes by the size of the keys, which says little about the records.
    """
    listed = sorted((bytes(r.first_key), r.path) for r in parts.collect())  # one row per index file
    firsts = [k for k, _ in listed]

    def files_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, paths = [], []
            for key in batch.column(0).to_pylist():
                for p in range(max(0, bisect_left(firsts, key) - 1), bisect_right(firsts, key)):
                    own.append(key)
                    paths.append(listed[p][1])
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), pa.array(paths, pa.string())], ["key", "path"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, kinds = _Reader(folder), [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        for batch in batches:
            found = []
            for key, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for file, start, length in reader.entries(path, key):
                    found.append(parsed(reader.member(file.decode(), int(start), int(length))))
                    if len(found) == 500:
                        yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in found], k) for n, k in zip(names, kinds)], names)
                        found = []
            yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in found], k) for n, k in zip(names, kinds)], names)

    dealt = keys.select("key").mapInArrow(files_of, "key binary, path string")
    # by range of keys, so that a busy index file is read by several tasks, each with its neighbouring blocks
    ranged = dealt.repartitionByRange(partitions, "path", "key") if partitions else dealt.repartitionByRange("path", "key")
    return ranged.sortWithinPartitions("path", "key").mapInArrow(read, _CAPTURE)


def archived(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """All pages written, indexed and read back through the index."""
    folder = shared_folder(pages.sparkSession)
    entries = saved(write_archive(pages, folder, min_bytes))
    parts = saved(write_index(entries, folder))
    stored = entries.agg(F.sum("length")).first()[0] or 0
    return captures(entries.select("key").distinct(), parts, folder, 1 + stored // READ_BYTES)
