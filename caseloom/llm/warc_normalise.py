"""WARC: archives written, monolithic gzip normalised to one member per record, read back by index.

Many tools gzip a whole WARC file as one stream, which no reader can enter in the middle.  ``normalise``
inflates such a file once, front to back, in pieces, and rewrites every record as its own gzip member; a
sidecar lists the offset and length of each.  Bodies are copied piece by piece, so neither a file nor a
record is ever held as a whole.  Files that are normalised already, and several streams in a row, are
read the same way.

Files go through ``pyarrow.fs`` to the folder given (any store it knows, or a shared mount), each under a
name of its own; the name reaches the result only from the attempt that succeeded, so a lost executor
or a second attempt leaves at most an unused file behind.

Payloads: of equal ones, the smallest page id is written as ``response`` and the others as ``revisit``
records that refer to it.  Equality is that of the SHA-256 of whole payloads.

Edge cases: null html is the empty payload, equal to other empty ones; rows that repeat the smallest id of a
group are all responses; a null id is never the smallest unless its group has no other; null addresses are left
out of the record; no rows give no archives and no records; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.llm.common import keep, read_table, text_bytes
from caseloom.llm.registry import query
from caseloom.session import fresh_path

PIECE = 1 << 18
ARCHIVE_BYTES = 256 << 20
LEVEL = 6
GZIP = 31  # window bits of a gzip stream
DATE = "2026-01-01T00:00:00Z"
SAME = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:caseloom:page:"


def open_folder(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    store, path = pyarrow.fs.FileSystem.from_uri(uri)
    store.create_dir(path, recursive=True)
    return store, path


def warc_header(fields: list[tuple[str, str]], size: int) -> bytes:
    lines = [f"{name}: {' '.join(value.split())}" for name, value in fields]
    return "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {size}", "", ""]).encode()


def page_record(page_id: int | None, url: str | None, payload: bytes, first: int | None, response: bool) -> bytes:
    """One record: the page's payload, or a pointer to the record that has an equal one."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    name = lambda i: f"<{URN}{'' if i is None else i}>"
    fields = [("WARC-Type", "response" if response else "revisit"), ("WARC-Record-ID", name(page_id)), ("WARC-Date", DATE)]
    if url:
        fields.append(("WARC-Target-URI", url))
    fields += [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if not response:
        fields += [("WARC-Profile", SAME), ("WARC-Refers-To", name(first))]
    block = http.encode() + (payload if response else b"")
    return warc_header(fields, len(block)) + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, folder: str, limit: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives, each one gzip stream, of ``page_id, url, html``: a table of their paths, kept."""
    same = F.sha2(F.coalesce("html", F.lit("")), 256)
    rows = pages.select("page_id", "url", "html", same.alias("same"))
    firsts = rows.groupBy("same").agg(F.min("page_id").alias("first"))
    marked = rows.join(firsts, "same").select(
        "page_id", "url", "html", "first", F.col("page_id").eqNullSafe(F.col("first")).alias("response")
    )

    def run(batches):
        store, root = open_folder(folder)
        out = stream = path = None
        written, paths = 0, []
        for batch in batches:
            ids, urls, firsts, responses = (batch.column(c).to_pylist() for c in ("page_id", "url", "first", "response"))
            for page_id, url, html, first, response in zip(ids, urls, text_bytes(batch.column("html")), firsts, responses):
                if out is None:
                    path = f"{root}/{uuid.uuid4().hex}.warc.gz"
                    out, stream, written = store.open_output_stream(path, compression=None), zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP), 0
                record = page_record(page_id, url, html or b"", first, response)
                out.write(stream.compress(record))
                written += len(record)
                if written >= limit:
                    out.write(stream.flush())
                    out.close()
                    paths.append(path)
                    out = None
        if out is not None:
            out.write(stream.flush())
            out.close()
            paths.append(path)
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], names=["path"])

    return keep(marked.mapInArrow(run, "path string"), "warc-archives")


class Inflated:
    """The plain bytes of a gzip file, whatever its members, in pieces."""

    def __init__(self, source):
        self.source, self.inflater = source, zlib.decompressobj(GZIP)
        self.buffer, self.raw = bytearray(), b""

    def _more(self) -> bool:
        if self.inflater.eof:
            self.raw = self.inflater.unused_data
            self.inflater = zlib.decompressobj(GZIP)
        if not self.raw:
            self.raw = self.source.read(PIECE)
            if not self.raw:
                return False
        self.buffer += self.inflater.decompress(self.raw, PIECE)
        self.raw = self.inflater.unconsumed_tail
        return True

    def head(self) -> bytes | None:
        """The bytes up to and with an empty line; none at the end of the file."""
        at = 0
        while (end := self.buffer.find(b"\r\n\r\n", max(0, at - 3))) < 0:
            at = len(self.buffer)
            if not self._more():
                if self.buffer.strip():
                    raise ValueError("the file ends inside a record")
                return None
        return self._take(end + 4)

    def _take(self, n: int) -> bytes:
        taken = bytes(self.buffer[:n])
        del self.buffer[:n]
        return taken

    def body(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.buffer and not self._more():
                raise ValueError("the file ends inside a record")
            piece = self._take(min(n, len(self.buffer)))
            n -= len(piece)
            if piece:
                yield piece


def fields_of(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name."""
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines if line)}


def normalise_file(source, target) -> Iterator[dict]:
    """Rewrite one gzip file with a member per record; yields the index entries in order."""
    plain, offset = Inflated(source), 0
    while (head := plain.head()) is not None:
        fields, member, size = fields_of(head), zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP), 0
        data = member.compress(head)
        target.write(data)
        size += len(data)
        for piece in plain.body(int(fields["content-length"])):
            data = member.compress(piece)
            target.write(data)
            size += len(data)
        end = b"".join(plain.body(4))
        if end != b"\r\n\r\n":
            raise ValueError(f"no end of record after {fields.get('warc-record-id')}")
        data = member.compress(end) + member.flush()
        target.write(data)
        size += len(data)
        yield {"offset": offset, "length": size, "type": fields.get("warc-type"), "id": fields.get("warc-record-id"),
               "uri": fields.get("warc-target-uri"), "digest": fields.get("warc-payload-digest")}
        offset += size


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Normalised copies of the files in ``path``: ``path, index_path, records``, kept.

    The sidecar has one JSON line per record.
    """

    def run(batches):
        store, root = open_folder(folder)
        for batch in batches:
            paths, indexes, counts = [], [], []
            for path in batch.column(0).to_pylist():
                name = f"{root}/{uuid.uuid4().hex}"
                n = 0
                with (
                    store.open_input_stream(path, compression=None) as source,
                    store.open_output_stream(f"{name}.warc.gz", compression=None) as target,
                    store.open_output_stream(f"{name}.idx", compression=None) as index,
                ):
                    for entry in normalise_file(source, target):
                        index.write(json.dumps(entry).encode() + b"\n")
                        n += 1
                paths.append(f"{name}.warc.gz")
                indexes.append(f"{name}.idx")
                counts.append(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(paths, pa.string()), pa.array(indexes, pa.string()), pa.array(counts, pa.int64())],
                names=["path", "index_path", "records"],
            )

    one_each = archives.select("path").repartition(max(1, archives.count()), "path")
    return keep(one_each.mapInArrow(run, "path string, index_path string, records long"), "warc-normalised")


def read_member(file, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """Fields and block of the record whose member stands there."""
    file.seek(offset)
    plain = zlib.decompress(file.read(length), GZIP)
    end = plain.index(b"\r\n\r\n") + 4
    fields = fields_of(plain[:end])
    return fields, plain[end : end + int(fields["content-length"])]


def _page(name: str | None) -> int | None:
    said = (name or "").strip("<>").removeprefix(URN)
    return int(said) if said else None


def read_records(files: DataFrame, folder: str) -> DataFrame:
    """The records of normalised archives, each found by its index entry.

    ``page_id, url, payload_bytes, payload_digest, record_type, refers_to``; of a response, bytes and digest are
    taken from the payload read; a revisit states them itself.
    """
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"

    def rows(store, path, index_path):
        with store.open_input_file(path) as file, store.open_input_stream(index_path, compression=None) as index:
            for line in _lines(index):
                entry = json.loads(line)
                fields, block = read_member(file, entry["offset"], entry["length"])
                head, _, payload = block.partition(b"\r\n\r\n")
                response = fields["warc-type"] == "response"
                stated = fields["warc-payload-digest"].partition(":")[2]
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode() if response else stated
                if digest != stated:
                    raise ValueError(f"{path} at {entry['offset']}: the payload is not the one that was written")
                size = len(payload) if response else int(fields_of(head)["content-length"])
                yield (_page(fields["warc-record-id"]), fields.get("warc-target-uri"), size, digest,
                       fields["warc-type"], _page(fields.get("warc-refers-to")))

    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def pack(found):
        columns = list(zip(*found)) if found else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)

    def run(batches):
        store, _ = open_folder(folder)
        for batch in batches:
            for path, index_path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = []
                for row in rows(store, path, index_path):
                    found.append(row)
                    if len(found) == 5000:
                        yield pack(found)
                        found = []
                yield pack(found)

    one_each = files.select("path", "index_path").repartition(max(1, files.count()), "path")
    return one_each.mapInArrow(run, schema)


def _lines(stream) -> Iterator[bytes]:
    rest = b""
    while data := stream.read(PIECE):
        *whole, rest = (rest + data).split(b"\n")
        yield from whole
    if rest:
        yield rest


@query("op4_warc_normalise")
def op4_warc_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``pages`` written to archives, normalised and read back."""
    folder = fresh_path(spark, "warc")
    archives = write_archives(read_table(spark, sf_dir, "pages"), folder)
    records = read_records(normalise(archives, folder), folder)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
