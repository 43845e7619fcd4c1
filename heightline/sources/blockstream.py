"""Block files as a Python data source, for batches and for streams.

A partition is a byte range of a file. Its task walks the record headers from the file's beginning, eight bytes each, and reads the
payloads of the records that begin in its range, so ranges need no index and no record is read twice. A stream's offset is a file and the place behind the last
whole record in it, with the text of a tip file beside them: more bytes, another file, or another tip start a batch, and
a record that is only half written waits. Files come in the order of their names.

Files are opened by pyarrow, by any URI that it knows, on the driver and on every executor.

    spark.dataSource.register(BlockFiles)
    spark.read.format("block_files").option("path", uri).load()
    spark.readStream.format("block_files").option("path", uri).option("tip", tip_uri).load()
"""

from __future__ import annotations

import hashlib
import posixpath
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from heightline.sources.blockfiles import AT_ONCE, MAGIC

SCHEMA = "file string, file_offset bigint, block_hash string, prev_hash string, time bigint, payload binary"
#: Bytes in one partition.
RANGE = 64 << 20
#: Payload bytes that leave a task at once, about.
BYTES_AT_ONCE = 16 << 20
NAME = re.compile(r"blk\d+\.dat$")


class Options:
    """path, key (hexadecimal), magic, range, tip, closed (whether the last file is whole too)."""

    def __init__(self, options):
        get = lambda name, default: options[name] if name in options else default
        self.path, self.tip = get("path", ""), get("tip", "")
        self.key = bytes.fromhex(get("key", ""))
        self.magic, self.range = int(get("magic", str(MAGIC))), int(get("range", str(RANGE)))
        self.closed = str(get("closed", "true")).lower() == "true"

    def files(self) -> list[tuple[str, int]]:
        """Names and sizes, in order."""
        store, root = fs.FileSystem.from_uri(self.path)
        found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return sorted((posixpath.basename(f.path), f.size) for f in found if f.is_file and NAME.search(f.path))

    def tip_text(self) -> str:
        if not self.tip:
            return ""
        store, path = fs.FileSystem.from_uri(self.tip)
        if store.get_file_info(path).type == fs.FileType.NotFound:
            return ""
        with store.open_input_stream(path) as file:
            return file.read().decode().strip()

    def open(self, name: str):
        store, root = fs.FileSystem.from_uri(self.path)
        return store.open_input_file(posixpath.join(root, name))

    def plain(self, data: bytes, at: int) -> bytes:
        """data, which lies at `at` in its file, without the key."""
        if not any(self.key):
            return data
        turned = at % len(self.key)
        mask = (self.key[turned:] + self.key[:turned]) * (len(data) // len(self.key) + 1)
        return (int.from_bytes(data, "little") ^ int.from_bytes(mask[: len(data)], "little")).to_bytes(len(data), "little")

    def headers(self, file, at: int, open_end: bool) -> Iterator[tuple[int, int]]:
        """Place and payload size of each record from `at` on. With open_end a record may be cut off by the end of the file."""
        size = file.size()
        while at + 8 <= size:
            head = self.plain(file.read_at(8, at), at)
            magic, length = struct.unpack("<II", head)
            if not any(head):
                return
            if magic != self.magic:
                raise ValueError(f"bad magic {magic:08x} at {at}")
            if at + 8 + length > size:
                if open_end:
                    return
                raise ValueError(f"short payload at {at}")
            yield at, length
            at += 8 + length


class Range(InputPartition):
    """Records of a file that begin in [start, stop); last: whether a record may be cut off."""

    def __init__(self, name: str, start: int, stop: int, last: bool):
        self.name, self.start, self.stop, self.last = name, start, stop, last


def ranges(name: str, start: int, stop: int, each: int, last: bool) -> list[Range]:
    return [Range(name, a, min(stop, a + each), last) for a in range(start, stop, each)]


def read_range(options: Options, part: Range) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    held = 0

    def batch():
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["file", "file_offset", "block_hash", "prev_hash", "time", "payload"])

    with options.open(part.name) as file:
        for at, size in options.headers(file, 0, part.last):
            if at >= part.stop:
                break
            if at >= part.start:
                p = options.plain(file.read_at(size, at + 8), at + 8)
                rows.append((part.name, at + 8, hashlib.sha256(hashlib.sha256(p[:80]).digest()).digest()[::-1].hex(), p[4:36][::-1].hex(), struct.unpack_from("<I", p, 68)[0], p))
                held += size
            if len(rows) == AT_ONCE or held >= BYTES_AT_ONCE:
                yield batch()
                rows.clear()
                held = 0
    if rows:
        yield batch()


class BatchReader(DataSourceReader):
    def __init__(self, options: Options):
        self.options = options

    def partitions(self) -> list[Range]:
        files = self.options.files()
        wanted = files if self.options.closed else files[:-1]
        return [r for i, (name, size) in enumerate(wanted) for r in ranges(name, 0, size, self.options.range, i == len(files) - 1)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return read_range(self.options, partition)


class StreamReader(DataSourceStreamReader):
    def __init__(self, options: Options):
        self.options = options
        self.seen = ("", 0)

    def initialOffset(self) -> dict:
        return {"file": "", "at": 0, "tip": ""}

    def latestOffset(self) -> dict:
        files = self.options.files()
        if files:
            name = files[-1][0]
            at = self.seen[1] if self.seen[0] == name else 0
            with self.options.open(name) as file:
                for at_, size in self.options.headers(file, at, True):
                    at = at_ + 8 + size
            self.seen = (name, at)
        return {"file": self.seen[0], "at": self.seen[1], "tip": self.options.tip_text()}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for name, size in self.options.files():
            if start["file"] <= name <= end["file"]:
                first = start["at"] if name == start["file"] else 0
                last = name == end["file"]
                out += ranges(name, first, end["at"] if last else size, self.options.range, last)
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return read_range(self.options, partition)


class BlockFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "block_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BatchReader:
        return BatchReader(Options(self.options))

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(Options(self.options))
