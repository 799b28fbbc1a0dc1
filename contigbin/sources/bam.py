"""BAM: a Python data source that reads a file in ranges of compressed bytes (SRC-16).

A BAM file is a chain of BGZF blocks. A task owns the blocks that start in its range of
bytes and the records that start in those blocks; it finds the first block by its
header and the next one behind it, and the first record by a run of records that make sense one
after another. Files are opened through pyarrow, so that paths may be of any store it knows.
"""

from __future__ import annotations

import struct
import zlib

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .store import open_store

SCHEMA = "file string, name string, contig string, start long, end long, flag int, quality int"
MAGIC = b"\x1f\x8b\x08\x04"
RANGE = 32 << 20
#: So many records in a row must make sense where a record is looked for (fewer at the end of the file).
CHAIN = 5
BASES = "=ACMGRSVTWYHKDBN"
#: Operations of a CIGAR: those that align bases to the contig, and what each takes of contig and read.
ALIGNED, OF_CONTIG, OF_READ = frozenset({0, 7, 8}), frozenset({0, 2, 3, 7, 8}), frozenset({0, 1, 4, 7, 8})


class _Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


def _files(path: str) -> list[tuple[str, int]]:
    """The .bam files of a path or folder, with their sizes."""
    from pyarrow import fs

    store, own = open_store(path)
    info = store.get_file_info(own)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(own, recursive=True))
    return sorted((x.path, x.size) for x in found if x.type == fs.FileType.File and (x.path.endswith(".bam") or x.path == own))


class Blocks:
    """Blocks of a BGZF file in order: (offset, data)."""

    def __init__(self, stream, size: int):
        self.stream, self.size = stream, size

    def length(self, at: int) -> int | None:
        """Bytes of the block at ``at``, or None if none starts there."""
        if at + 18 > self.size:
            return None
        self.stream.seek(at)
        head = self.stream.read(12)
        if head[:4] != MAGIC or len(head) < 12:
            return None
        extra, k = self.stream.read(struct.unpack_from("<H", head, 10)[0]), 0
        while k + 4 <= len(extra):
            tag, n = extra[k : k + 2], struct.unpack_from("<H", extra, k + 2)[0]
            if tag == b"BC" and n == 2:
                return struct.unpack_from("<H", extra, k + 4)[0] + 1
            k += 4 + n
        return None

    def data(self, at: int, length: int) -> bytes:
        self.stream.seek(at)
        raw = self.stream.read(length)
        return zlib.decompress(raw[12 + struct.unpack_from("<H", raw, 10)[0] : -8], -15)

    def first(self, start: int, end: int) -> int | None:
        """Offset of the first block that starts in start .. end - 1: a header whose block is followed by another or by the end."""
        at = start
        while at < end:
            self.stream.seek(at)
            window = self.stream.read(min(1 << 16, end - at) + len(MAGIC) - 1)
            k = window.find(MAGIC)
            while k >= 0:
                n = self.length(at + k)
                if n and (at + k + n == self.size or self.length(at + k + n)):
                    return at + k
                k = window.find(MAGIC, k + 1)
            at += 1 << 16
        return None


class Stream:
    """Decompressed bytes from a block on, read as far as is asked; knows in which block a byte lies."""

    def __init__(self, blocks: Blocks, at: int):
        self.blocks, self.next, self.data, self.starts = blocks, at, bytearray(), []

    def upto(self, n: int) -> bool:
        """Whether there are ``n`` bytes."""
        while len(self.data) < n and self.next < self.blocks.size:
            length = self.blocks.length(self.next)
            if length is None:
                raise ValueError(f"no BGZF block at byte {self.next}")
            self.starts.append((len(self.data), self.next))
            self.data += self.blocks.data(self.next, length)
            self.next += length
        return len(self.data) >= n

    def block_of(self, at: int) -> int:
        """File offset of the block that holds byte ``at``; drops what lies before that block's start from the list."""
        while len(self.starts) > 1 and self.starts[1][0] <= at:
            self.starts.pop(0)
        return self.starts[0][1]

    def forget(self, at: int) -> int:
        """Drop the bytes before ``at``; the new place of ``at``."""
        self.block_of(at)
        del self.data[:at]
        self.starts = [(max(0, k - at), offset) for k, offset in self.starts]
        return 0


def header(stream: Stream) -> tuple[list[tuple[str, int]], int]:
    """Contigs (name, length) and the place behind the header."""
    if not stream.upto(8) or stream.data[:4] != b"BAM\1":
        raise ValueError("not a BAM file")
    at = 8 + struct.unpack_from("<i", stream.data, 4)[0]
    stream.upto(at + 4)
    contigs, n = [], struct.unpack_from("<i", stream.data, at)[0]
    at += 4
    for _ in range(n):
        stream.upto(at + 4)
        size = struct.unpack_from("<i", stream.data, at)[0]
        stream.upto(at + 8 + size)
        contigs.append((stream.data[at + 4 : at + 3 + size].decode(), struct.unpack_from("<i", stream.data, at + 4 + size)[0]))
        at += 8 + size
    return contigs, at


def sensible(stream: Stream, at: int, contigs: list[tuple[str, int]], chain: int = CHAIN) -> bool:
    """Whether records that make sense start at ``at``, ``chain`` of them or as many as the file still has."""
    for _ in range(chain):
        if not stream.upto(at + 1):
            return True
        if not stream.upto(at + 36):
            return False
        size, contig, start, l_name, _, _, n_ops, _, l_seq, mate, mate_start, _ = struct.unpack_from("<iiiBBHHHiiii", stream.data, at)
        rest = size - 32 - l_name - 4 * n_ops - (l_seq + 1) // 2 - l_seq
        inside = lambda c, p: -1 <= c < len(contigs) and -1 <= p <= (contigs[c][1] if c >= 0 else 1 << 31)
        if size < 32 or l_name < 1 or l_seq < 0 or rest < 0 or not inside(contig, start) or not inside(mate, mate_start):
            return False
        if not stream.upto(at + 36 + l_name + 4 * n_ops):
            return False
        name, ops = stream.data[at + 36 : at + 36 + l_name], struct.unpack_from(f"<{n_ops}I", stream.data, at + 36 + l_name)
        if name[-1] != 0 or any(not 33 <= c <= 126 for c in name[:-1]) or any(op & 15 > 8 for op in ops):
            return False
        at += 4 + size
    return True


def aligned_bases(start: int, ops: tuple[int, ...], seq: bytes) -> list[tuple[int, int]]:
    """Half-open runs of contig positions to which an A, C, G or T of the read is aligned. A read without bases counts as all such."""
    runs, at, read = [], start, 0
    for op in ops:
        n, kind = op >> 4, op & 15
        if kind in ALIGNED:
            if not seq:
                runs.append((at, at + n))
            begin = None
            for k in range(n if seq else 0):
                code = seq[(read + k) >> 1] >> 4 if (read + k) % 2 == 0 else seq[(read + k) >> 1] & 15
                if BASES[code] in "ACGT":
                    begin = at + k if begin is None else begin
                elif begin is not None:
                    runs.append((begin, at + k))
                    begin = None
            if begin is not None:
                runs.append((begin, at + n))
        at += n if kind in OF_CONTIG else 0
        read += n if kind in OF_READ else 0
    merged = []
    for a, b in runs:
        if merged and merged[-1][1] == a:
            merged[-1] = (merged[-1][0], b)
        else:
            merged.append((a, b))
    return merged


class BamSource(DataSource):
    """``spark.read.format("bam").option("path", ..)``: a row for each run of aligned bases, an unmapped record as one row without a contig. Option ``range``: bytes a task."""

    @classmethod
    def name(cls):
        return "bam"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def partitions(self):
        size = int(self.options.get("range", RANGE))
        return [_Range(path, at, min(n, at + size)) for path, n in _files(self.options["path"]) for at in range(0, n, size)]

    def read(self, partition):
        store, path = open_store(self.options["path"])
        with store.open_input_file(partition.path) as file:
            blocks = Blocks(file, file.size())
            contigs, at = header(whole := Stream(blocks, 0))
            if partition.start:
                first = blocks.first(partition.start, partition.end)
                if first is None:
                    return
                behind = whole.block_of(at) if whole.upto(at + 1) else blocks.size
                if first <= behind:  # the header reaches into this range
                    if not behind < partition.end:
                        return
                    stream = whole
                else:
                    stream, at = Stream(blocks, first), 0
                    while not sensible(stream, at, contigs):
                        at += 1
            else:
                stream = whole
            while stream.upto(at + 4) and stream.block_of(at) < partition.end:
                size = struct.unpack_from("<i", stream.data, at)[0]
                if not stream.upto(at + 4 + size):
                    raise ValueError(f"{partition.path} ends inside a record")
                yield from self.rows(partition.path, contigs, bytes(stream.data[at : at + 4 + size]))
                at += 4 + size
                if at > 1 << 20:
                    at = stream.forget(at)

    def rows(self, path: str, contigs: list[tuple[str, int]], record: bytes):
        _, contig, start, l_name, quality, _, n_ops, flag, l_seq = struct.unpack_from("<iiiBBHHHi", record)
        name, at = record[36 : 35 + l_name].decode(), 36 + l_name
        ops = struct.unpack_from(f"<{n_ops}I", record, at)
        if contig < 0 or flag & 4:
            yield path, name, None, None, None, flag, quality
            return
        seq = record[at + 4 * n_ops : at + 4 * n_ops + (l_seq + 1) // 2]
        for a, b in aligned_bases(start, ops, seq):
            yield path, name, contigs[contig][0], a, b, flag, quality
