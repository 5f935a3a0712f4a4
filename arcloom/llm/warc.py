"""WARC archives as a Spark data source: ``format("warc")`` for reading and writing.

Writing gives one archive of gzip members per task, a member per record, and beside it an index line per record
(offset, length, type, target). Archives are written under a name of their task and attempt and get their
final name at commit, so a repeated attempt leaves nothing behind.

Reading plans partitions of about ``split_bytes`` from the indexes; an archive without an index is one partition. Equality and
``IN`` predicates on ``record_type``, ``target_uri`` and ``record_id`` are taken over: the type and target of the index drop
records before a byte is read, and of the others the headers are parsed first, from as many bytes as needed. The
payload is decompressed only for records that all predicates leave, and only if the column is wanted (option ``payload``).

Records hold an HTTP response block. ``payload_length`` and ``payload_digest`` are those of the full payload: of a
revisit, which has none, from its headers.

Spark keeps the predicates of the first query with a loaded relation, so a frame of this source is good for one
query: call ``read`` again for the next.

Cases: a null payload is empty, that of a revisit is null; null targets and references are left out and read as null; header values keep no line
breaks. Records may repeat. A folder without archives is an empty table. Files go through ``pyarrow.fs``, so any folder that it
knows will do.
"""

from __future__ import annotations

import base64
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, WriterCommitMessage)

SCHEMA = ("record_id string, record_type string, target_uri string, refers_to string, payload_length long, payload_digest string, "
          "payload binary")
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
PUSHED = ("record_type", "target_uri", "record_id")
HEADERS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "refers_to": "WARC-Refers-To"}
SPLIT_BYTES = 32 << 20
HEAD_BYTES = 2048
BATCH_BYTES = 4 << 20
LEVEL = 1


def _folder(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if not path.startswith("file:/") or path.startswith("file://") else "file://" + path[5:])
    return fs.LocalFileSystem(), path


def _line(value: str) -> str:
    return value.replace("\r", " ").replace("\n", " ")


def make_record(row: dict) -> bytes:
    """One record, headers and block, ready for compression."""
    full = row["payload"] or b""
    payload = b"" if row["record_type"] == "revisit" else full
    digest = base64.b32encode(bytes.fromhex(row["payload_digest"])).decode() if row["payload_digest"] else ""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_length']}\r\n\r\n".encode() + payload
    lines = ["WARC/1.1"]
    lines += [f"{h}: {_line(row[c])}" for c, h in HEADERS.items() if row[c] is not None]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(lines: bytes) -> dict[str, str]:
    out = {}
    for line in lines.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        out[name.strip().lower()] = value.strip()
    return out


class Member:
    """A gzip member that is decompressed only as far as it is asked for."""

    def __init__(self, raw: bytes):
        self.zip, self.rest, self.text = zlib.decompressobj(31), raw, b""

    def more(self, size: int) -> bool:
        if self.zip.eof:
            return False
        got = self.zip.decompress(self.rest, size)
        self.rest = self.zip.unconsumed_tail
        self.text += got
        return bool(got) or not self.zip.eof and bool(self.rest)

    def until(self, mark: bytes, start: int) -> int:
        """Place of ``mark`` from ``start`` on."""
        while (at := self.text.find(mark, start)) < 0:
            if not self.more(HEAD_BYTES):
                raise ValueError("broken WARC record")
        return at

    def all(self) -> bytes:
        if not self.zip.eof:
            self.text += self.zip.decompress(self.rest)
            self.text += self.zip.flush()
        return self.text

    def unused(self) -> bytes:
        return self.zip.unused_data


def read_record(member: Member, wanted: list[tuple[str, tuple]], payload: bool) -> list | None:
    """Values in the order of ``COLUMNS``, or None if a predicate on the headers fails; headers are parsed first."""
    end = member.until(b"\r\n\r\n", 0)
    head = _fields(member.text[:end])
    values = {c: head.get(h.lower()) for c, h in HEADERS.items()}
    if any(values[c] not in allowed for c, allowed in wanted):
        return None
    start = end + 4
    stop = member.until(b"\r\n\r\n", start)
    http = _fields(member.text[start:stop])
    digest = head.get("warc-payload-digest", "").removeprefix("sha1:")
    body = None
    if payload and values["record_type"] != "revisit":
        block = start + int(head["content-length"])
        body = member.all()[stop + 4 : block]
    return [*[values[c] for c in COLUMNS[:4]], int(http.get("content-length") or 0), base64.b32decode(digest).hex() if digest else None, body]


@dataclass
class Written(WriterCommitMessage):
    names: list


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path = path
        self.run = uuid.uuid4().hex
        if overwrite:
            system, folder = _folder(path)
            if system.get_file_info(folder).type != fs.FileType.NotFound:
                system.delete_dir_contents(folder)

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, folder = _folder(self.path)
        system.create_dir(folder, recursive=True)
        context = TaskContext.get()
        name = f"part-{context.partitionId():05d}-{self.run}"
        part = f"{name}.attempt-{context.taskAttemptId()}"
        offset, any_rows, index = 0, False, []
        with system.open_output_stream(f"{folder}/_{part}.warc.gz", compression=None) as out:
            for batch in batches:
                for row in batch.to_pylist():
                    raw = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                    member = raw.compress(make_record(row)) + raw.flush()
                    out.write(member)
                    index.append(json.dumps([offset, len(member), row["record_type"], row["target_uri"]]))
                    offset += len(member)
        with system.open_output_stream(f"{folder}/_{part}.cdx", compression=None) as out:
            out.write("\n".join(index).encode())
        return Written([[f"_{part}", name]] if index else [])

    def commit(self, messages: list) -> None:
        system, folder = _folder(self.path)
        system.create_dir(folder, recursive=True)
        for message in messages:
            for made, name in message.names if message else []:
                system.move(f"{folder}/{made}.cdx", f"{folder}/{name}.cdx")
                system.move(f"{folder}/{made}.warc.gz", f"{folder}/{name}.warc.gz")

    def abort(self, messages: list) -> None:
        system, folder = _folder(self.path)
        for message in messages:
            for made, _ in message.names if message else []:
                system.delete_file(f"{folder}/{made}.cdx")
                system.delete_file(f"{folder}/{made}.warc.gz")


@dataclass
class Piece(InputPartition):
    """Records of one archive: those of the index lines from ``first`` to ``stop``; without an index, all."""

    name: str
    first: int = 0
    stop: int = -1


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() == "true"
        self.split = int(options.get("split_bytes", SPLIT_BYTES))
        self.wanted: list[tuple[str, tuple]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in PUSHED and isinstance(f, (EqualTo, EqualNullSafe)) and f.value is not None:
                self.wanted.append((column, (f.value,)))
            elif column in PUSHED and isinstance(f, In):
                self.wanted.append((column, tuple(f.value)))
            else:
                yield f

    def partitions(self) -> list[Piece]:
        system, folder = _folder(self.path)
        files = [i for i in system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
                 if i.base_name.endswith(".warc.gz") and not i.base_name.startswith("_")]
        indexed = {i.base_name for i in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if i.base_name.endswith(".cdx")}
        pieces = []
        for info in sorted(files, key=lambda i: i.base_name):
            name = info.base_name.removesuffix(".warc.gz")
            parts = max(1, -(-info.size // self.split)) if f"{name}.cdx" in indexed else 0
            pieces += [Piece(name, k, parts) for k in range(parts)] or [Piece(name)]
        return pieces

    def read(self, partition: Piece | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no archives
            return
        system, folder = _folder(self.path)
        rows, size = [], 0
        for member in self._members(system, folder, partition):
            row = read_record(member, self.wanted, self.payload)
            if row is not None:
                rows.append(row)
                size += HEAD_BYTES + len(row[-1] or b"")
            if size >= BATCH_BYTES:
                yield self._batch(rows)
                rows, size = [], 0
        if rows:
            yield self._batch(rows)

    def _members(self, system, folder: str, piece: Piece) -> Iterator[Member]:
        if piece.stop < 0:
            yield from self._unindexed(system, folder, piece)
            return
        with system.open_input_stream(f"{folder}/{piece.name}.cdx", compression=None) as f:
            lines = f.read().decode().split("\n")
        share = -(-len(lines) // piece.stop)
        known = {"record_type": 2, "target_uri": 3}
        with system.open_input_file(f"{folder}/{piece.name}.warc.gz") as f:
            for line in lines[piece.first * share : (piece.first + 1) * share]:
                entry = json.loads(line)
                if all(entry[known[c]] in allowed for c, allowed in self.wanted if c in known):
                    yield Member(f.read_at(entry[1], entry[0]))

    def _unindexed(self, system, folder: str, piece: Piece) -> Iterator[Member]:
        """All members in turn; the end of one is only known after it is decompressed."""
        with system.open_input_file(f"{folder}/{piece.name}.warc.gz") as f:
            raw = b""
            while True:
                if not raw:
                    raw = f.read(BATCH_BYTES)
                if not raw:
                    return
                member = Member(raw)
                while not member.zip.eof:
                    if not member.more(BATCH_BYTES) and not member.zip.eof:
                        more = f.read(BATCH_BYTES)
                        if not more:
                            raise ValueError("the archive ends inside a record")
                        member.rest = more
                raw = member.unused()
                yield member

    @staticmethod
    def _batch(rows: list) -> pa.RecordBatch:
        kinds = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], COLUMNS)


class WarcSource(DataSource):
    """Options: ``path``; for reading ``payload`` (false leaves payloads null and compressed) and ``split_bytes``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return Writer(self.options["path"], overwrite)


def register(spark) -> None:
    """Make ``format("warc")`` known to the session and let it take predicates."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read(spark, folder: str, payload: bool = True, split_bytes: int = SPLIT_BYTES):
    """A fresh frame of all records in a folder; filter it before use."""
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).option("split_bytes", split_bytes).load(folder)
