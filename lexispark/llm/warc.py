"""WARC files: normalising monolithic gzip, with a sidecar index of offsets.

A monolithic file is one gzip stream over many records, so no record can be reached without inflating all before
it. The normaliser inflates each file once, as a stream, and writes every record as a gzip member of its own; beside
the new file, FILE.idx holds one JSON line a record: offset, length, type, id, uri, date and content length. Memory
holds one record's header and a piece of its content, whatever the file's size. Each file is one task's work; a file is
written under a name of the attempt and renamed once whole, so that a task which runs again, or twice at once,
leaves the same result.

Files of one member a record, of several records a member, and without compression are read alike. An
empty file gives an empty one, an empty table no rows. Where a stream ends early or is damaged, the whole records before that place are kept and
`status` says what happened. Headers and contents may have any length. What is no record (a line that begins none, a header without the
content's length) is passed over up to the next line that is a record's first, and status says "malformed". Repeated records stay repeated;
records without an id or URI have nulls. A null path gives no row.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import IO

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .util import only, shared_dir

READ, LEVEL = 1 << 18, 6
INDEX_SCHEMA = "file string, offset long, length long, type string, id string, uri string, date string, content_length long"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + path)


class Inflated:
    """Bytes of a stream with gzip members undone; plain bytes pass through. `fault` tells how it ended if not well."""

    def __init__(self, raw: IO[bytes]) -> None:
        self.raw, self.buffer, self.at, self.fault, self.ended = raw, b"", 0, "", False
        first = raw.read(READ)
        self.z = zlib.decompressobj(31) if first[:2] == b"\x1f\x8b" else None
        self.rest = first
        self.open = bool(first)  # inside a member

    def _more(self) -> bool:
        while not self.ended:
            data = self.rest or self.raw.read(READ)
            self.rest = b""
            if not data:
                self.ended = True
                if self.z and self.open:
                    self.fault = self.fault or "truncated"
                return False
            if self.z is None:
                out = data
            else:
                if self.z.eof:
                    data = data.lstrip(b"\0") if not self.open else data  # padding between members
                    if not data:
                        continue
                    self.z, self.open = zlib.decompressobj(31), True
                try:
                    out = self.z.decompress(data, READ * 8)
                except zlib.error:
                    self.ended, self.fault = True, "damaged"
                    return False
                self.rest = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
                self.open = not self.z.eof
            if out:
                self.buffer = self.buffer[self.at :] + out
                self.at = 0
                return True
        return False

    def line(self) -> bytes | None:
        """Up to and with the next newline; None where the stream ends before it."""
        parts: list[bytes] = []
        while (end := self.buffer.find(b"\n", self.at)) < 0:
            parts.append(self.buffer[self.at :])
            self.at = len(self.buffer)
            if not self._more():
                self.buffer, self.at = b"".join(parts), 0  # as it was, for what comes after
                self.at = len(self.buffer)
                return None
        parts.append(self.buffer[self.at : end + 1])
        self.at = end + 1
        return b"".join(parts)

    def take(self, n: int) -> Iterator[bytes]:
        """The next n bytes in pieces; fewer where the stream ends."""
        while n:
            if self.at == len(self.buffer) and not self._more():
                return
            out = self.buffer[self.at : self.at + n]
            self.at += len(out)
            n -= len(out)
            yield out

    def over(self) -> bool:
        return self.at == len(self.buffer) and not self._more()


def header(source: Inflated) -> tuple[bytes, dict[str, str], bool] | str | None:
    """A record's header as it is written, its fields by lower-case name, and whether anything was passed over before it; None at the end, a
    text for a fault. Headers may have any length."""
    skipped = False
    while True:  # blank lines between records
        if source.over():
            return source.fault or ("malformed" if skipped else None)
        line = source.line()
        if line is None:
            return source.fault or "malformed"
        if _BEGIN.match(line):
            break
        skipped = skipped or bool(line.strip())
    raw, fields, name = [line], {}, ""
    while True:
        line = source.line()
        if line is None:
            return source.fault or "malformed"
        raw.append(line)
        if not line.strip():
            return b"".join(raw), fields, skipped
        text = line.decode("utf-8", "replace")
        if text[0] in " \t" and name:
            fields[name] += " " + text.strip()
        elif ":" in text:
            name, value = text.split(":", 1)
            name = name.strip().lower()
            fields[name] = value.strip()


_BEGIN = re.compile(rb"WARC/\d+\.\d+\s*$")


def normalise_stream(raw: IO[bytes], out: IO[bytes], level: int = LEVEL) -> tuple[list[dict], str]:
    """Writes every record of raw to out as a member; the index's rows, and "ok" or what went wrong."""
    source, rows, offset, status = Inflated(raw), [], 0, "ok"
    while True:
        got = header(source)
        if got is None or isinstance(got, str):
            return rows, got or status
        head, fields, skipped = got
        size = fields.get("content-length", "")
        if skipped:
            status = "malformed"
        if not size.isdecimal():
            status = "malformed"  # its end is not known: what follows is passed over up to the next record's first line
            continue
        z = zlib.compressobj(level, zlib.DEFLATED, 31)
        # a small record is held until it is whole; what is written of a large one that breaks off is cut away by its caller
        begun, left, length, held, n = offset, int(size), 0, [z.compress(head)], 0
        for piece in source.take(left):
            left -= len(piece)
            held.append(z.compress(piece))
            n += len(held[-1])
            if n > READ:
                length += out.write(b"".join(held))
                held, n = [], 0
        if left:
            return rows, (source.fault or "truncated") + (f" {begun}" if length else "")
        held.append(z.compress(b"\r\n\r\n") + z.flush())
        length += out.write(b"".join(held))
        offset += length
        rows.append({"offset": begun, "length": length, "type": fields.get("warc-type"), "id": fields.get("warc-record-id"), "uri": fields.get("warc-target-uri"), "date": fields.get("warc-date"), "content_length": int(size)})


def normalise_file(path: str, to: str, level: int = LEVEL) -> tuple[list[dict], str]:
    """Rewrites the file at path to `to` and the index to `to`.idx."""
    (source, a), (target, b) = opened(path), opened(to)
    target.create_dir(b.rsplit("/", 1)[0], recursive=True)
    mine = f"{b}.{uuid.uuid4().hex}.part"
    with source.open_input_stream(a, compression=None) as raw, target.open_output_stream(mine, compression=None) as out:
        rows, status = normalise_stream(raw, out, level)
    name, _, end = status.partition(" ")
    if end:  # a large record broke off after a part of it was written
        whole = f"{b}.{uuid.uuid4().hex}.part"
        with target.open_input_stream(mine, compression=None) as raw, target.open_output_stream(whole, compression=None) as out:
            left = int(end)
            while left:
                piece = raw.read(min(READ, left))
                out.write(piece)
                left -= len(piece)
        target.delete_file(mine)
        mine = whole
    index = f"{b}.idx.{uuid.uuid4().hex}.part"
    with target.open_output_stream(index, compression=None) as out:
        for r in rows:
            out.write(json.dumps(r, ensure_ascii=False).encode() + b"\n")
    target.move(mine, b)
    target.move(index, f"{b}.idx")
    return rows, name


def normalise(paths: DataFrame, to: str, level: int = LEVEL, path_col: str = "path") -> DataFrame:
    """(path, file, status, records) of every file; the new files lie below the folder `to`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                # equal names from different folders stay apart
                name = f"{to.rstrip('/')}/{hashlib.md5(path.encode()).hexdigest()[:12]}-{path.rsplit('/', 1)[-1]}"
                rows, status = normalise_file(path, name, level)
                yield pa.RecordBatch.from_pylist([{"path": path, "file": name, "status": status, "records": len(rows)}], pa.schema([("path", pa.string()), ("file", pa.string()), ("status", pa.string()), ("records", pa.int64())]))

    rows = only(paths, path=path_col).where("path is not null").distinct()
    return rows.repartition(max(1, rows.count()), "path").mapInArrow(run, "path string, file string, status string, records long")


def index(spark: SparkSession, files: DataFrame) -> DataFrame:
    """The sidecars' rows of normalised files (a column `file`), one a record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                system, path = opened(file)
                with system.open_input_stream(f"{path}.idx", compression=None) as f:
                    rows = [{"file": file} | json.loads(x) for x in f.read().splitlines()]
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string()), ("id", pa.string()), ("uri", pa.string()), ("date", pa.string()), ("content_length", pa.int64())]))

    return files.select("file").mapInArrow(run, INDEX_SCHEMA)


def fetch(entries: DataFrame) -> DataFrame:
    """entries (rows of the index) with `content`: each record's, read by its offset alone."""
    names = entries.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, stream = None, None
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part, out = batch.slice(i, 256), []
                for file, offset, length in zip(*(part.column(names.index(c)).to_pylist() for c in ("file", "offset", "length"))):
                    if file != at:
                        if stream:
                            stream.close()
                        system, path = opened(file)
                        at, stream = file, system.open_input_file(path)
                    raw = zlib.decompress(stream.read_at(length, offset), 31)
                    start = raw.index(b"\r\n\r\n") + 4
                    out.append(raw[start:-4])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], [*names, "content"])
        if stream:
            stream.close()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in entries.schema)
    return entries.mapInArrow(run, f"{schema}, content binary")


def write_monolithic(pages: DataFrame, to: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes each partition of pages as one WARC file of one gzip stream; (path, records) of every file.

    A record is a page's HTML as a resource; its id is page:ID. A null page has no record, a null URL no URI; pages
    without an id have the id page:."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, folder = opened(to)
        system.create_dir(folder, recursive=True)
        name = f"{folder.rstrip('/')}/part-{TaskContext.get().partitionId():05d}.warc.gz"
        mine, n = f"{name}.{uuid.uuid4().hex}.part", 0
        z = zlib.compressobj(1, zlib.DEFLATED, 31)
        with system.open_output_stream(mine, compression=None) as out:
            for batch in batches:
                for key, url, page in zip(*(c.to_pylist() for c in batch.columns)):
                    body = page.encode("utf-8", "replace")
                    uri = "" if url is None else "WARC-Target-URI: " + " ".join(url.split()) + "\r\n"
                    head = f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <page:{'' if key is None else key}>\r\n{uri}Content-Type: text/html\r\nContent-Length: {len(body)}\r\n\r\n"
                    out.write(z.compress(head.encode() + body + b"\r\n\r\n"))
                    n += 1
            out.write(z.flush())
        system.move(mine, name)
        yield pa.RecordBatch.from_pydict({"path": [f"{to.rstrip('/')}/{name.rsplit('/', 1)[-1]}"], "records": [n]})

    return only(pages, page_id=id_col, url=url_col, html=html_col).where("html is not null").mapInArrow(run, "path string, records long")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, n_bytes, digest) of every page that has HTML, as read back by offset from normalised files.

    pages are written as monolithic files, those normalised, and every record fetched through the sidecar index."""
    from .util import stored

    spark = pages.sparkSession
    made = stored(write_monolithic(pages, shared_dir(spark, "monolithic"), id_col, url_col, html_col), "made")
    done = stored(normalise(made, shared_dir(spark, "normalised")), "normalised-files")
    if bad := done.where("status <> 'ok'").select("path", "status").first():
        raise RuntimeError(f"{bad.path}: {bad.status}")
    found = fetch(index(spark, done.repartition(max(1, done.count()), "file")).select("file", "offset", "length", "id", "uri"))
    key = F.regexp_extract("id", "^<page:(.*)>$", 1)
    kind = pages.schema[id_col].dataType.simpleString()
    return found.select(F.when(key != "", key).cast(kind).alias("page_id"), F.col("uri").alias("url"), F.octet_length("content").cast("long").alias("n_bytes"), F.md5("content").alias("digest"))


ROUND_TRIP_SQL = "SELECT page_id, url, CAST(octet_length(encode(html)) AS BIGINT) AS n_bytes, md5(html) AS digest FROM pages WHERE html IS NOT NULL"
