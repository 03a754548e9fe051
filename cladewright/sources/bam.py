"""Binary alignments (BAM) as a Spark data source that splits files at their compressed blocks.

A file is dealt out by ranges of bytes. A task looks for the first block that begins in its range and for the first record
that begins in it: the place from which records follow each other, each of which parses to its very last byte. It reads
the records whose first byte is in a block of its range, on into the next range for the last one. Tasks hold a few blocks
and one batch of records. Files are opened through pyarrow's file systems, so paths may be local or URIs.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cladewright.sources.matrices import named_reads

SPLIT_BYTES, BATCH = 64 << 20, 4096
#: Records in a row that must parse for a place to count as a record's start.
CHAIN = 8
_SCHEMA = "readName string, flag int, reference string, position long, quality int, CIGAR string, seq string, qual string, tags map<string,string>"
#: Fixed values of the format: operations of a CIGAR, codes of bases, and sizes and names of numbers in tags.
_OPERATIONS, _BASES = "MIDNSHP=X", "=ACMGRSVTWYHKDBN"
_NUMBERS = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
_HEAD = struct.Struct("<iiiBBHHHiiii")


class _Bad(ValueError):
    pass


# -- blocks ------------------------------------------------------------------------------------------------------------


def _opened(path: str):
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return system, name


def block_size(head: bytes) -> int | None:
    """The whole size of the block whose first bytes are given, or None where none begins there."""
    if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04":
        return None
    (extra,) = struct.unpack_from("<H", head, 10)
    at = 12
    while at + 6 <= min(12 + extra, len(head)):
        (length,) = struct.unpack_from("<H", head, at + 2)
        if head[at : at + 2] == b"BC" and length == 2:
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + length
    return None


def first_block(file, start: int, size: int) -> int:
    """Where the first block at or after start begins, or the size of the file."""
    at = start
    while at < size:
        file.seek(at)
        data = file.read(1 << 17)
        for m in re.finditer(rb"\x1f\x8b\x08\x04", data):
            place = at + m.start()
            file.seek(place)
            length = block_size(file.read(64))
            if length is None:
                continue
            file.seek(place + length)
            if place + length == size or block_size(file.read(64)) is not None:
                return place
        at += max(1, len(data) - 3)
    return size


class _Stream:
    """The bytes of a file's blocks from one of them on, and which block each byte comes from."""

    def __init__(self, file, size: int, offset: int):
        self.file, self.size, self.offset, self.data, self.starts = file, size, offset, b"", []

    def more(self) -> bool:
        """Takes up another block; False at the end of the file."""
        if self.offset >= self.size:
            return False
        self.file.seek(self.offset)
        length = block_size(self.file.read(64))
        if length is None:
            raise _Bad(f"no block at byte {self.offset}")
        self.file.seek(self.offset)
        raw = self.file.read(length)
        (extra,) = struct.unpack_from("<H", raw, 10)
        self.starts.append((len(self.data), self.offset))
        self.data += zlib.decompressobj(-15).decompress(raw[12 + extra : -8])
        self.offset += length
        return True

    def reach(self, end: int) -> bool:
        while len(self.data) < end:
            if not self.more():
                return False
        return True

    def block_of(self, at: int) -> int:
        return max((s for s in self.starts if s[0] <= at), key=lambda s: (s[0], s[1]))[1]

    def forget(self, at: int) -> None:
        """Drops the bytes before at."""
        last = max(k for k, s in enumerate(self.starts) if s[0] <= at)
        self.data, self.starts = self.data[at:], [(s - at, o) for s, o in self.starts[last:]]


# -- records -----------------------------------------------------------------------------------------------------------


def _tags(raw: bytes) -> dict[str, str]:
    """Tags as text; anything that does not end with the last byte is an error."""
    out, at = {}, 0
    while at < len(raw):
        if at + 3 > len(raw):
            raise _Bad("cut tag")
        name, kind = raw[at : at + 2].decode("latin-1"), chr(raw[at + 2])
        at += 3
        if kind == "A":
            value, at = raw[at : at + 1].decode("latin-1"), at + 1
        elif kind in "ZH":
            end = raw.find(b"\0", at)
            if end < 0:
                raise _Bad("open text")
            value, at = raw[at:end].decode("latin-1"), end + 1
        elif kind in _NUMBERS:
            n = struct.calcsize("<" + _NUMBERS[kind])
            if at + n > len(raw):
                raise _Bad("cut number")
            number = struct.unpack_from("<" + _NUMBERS[kind], raw, at)[0]
            value, at = f"{number:g}" if kind == "f" else str(number), at + n
        elif kind == "B" and at + 5 <= len(raw) and chr(raw[at]) in _NUMBERS:
            sub, (n,) = chr(raw[at]), struct.unpack_from("<i", raw, at + 1)
            end = at + 5 + n * struct.calcsize("<" + _NUMBERS[sub])
            if n < 0 or end > len(raw):
                raise _Bad("cut array")
            numbers = struct.unpack_from(f"<{n}{_NUMBERS[sub]}", raw, at + 5)
            value, at = ",".join([sub, *(f"{x:g}" if sub == "f" else str(x) for x in numbers)]), end
        else:
            raise _Bad(f"unknown type {kind}")
        out[name] = value
    if at != len(raw):
        raise _Bad("cut tag")
    return out


def parse_record(data: bytes, at: int, references: list[str]):
    """(row, end) of the record that begins at a place; _Bad where none does, None where the data ends before it does."""
    if at + _HEAD.size > len(data):
        return None
    size, ref, pos, name_length, quality, _, operations, flag, bases, next_ref, next_pos, _ = _HEAD.unpack_from(data, at)
    least = 32 + name_length + 4 * operations + (bases + 1) // 2 + bases
    if not (-1 <= ref < len(references) and -1 <= next_ref < len(references) and pos >= -1 and next_pos >= -1 and name_length > 0 and bases >= 0 and least <= size < 1 << 29):
        raise _Bad("no record")
    end = at + 4 + size
    name_end = at + 36 + name_length
    if name_end <= len(data) and (data[name_end - 1] != 0 or not re.fullmatch(rb"[!-~]*", data[at + 36 : name_end - 1])):
        raise _Bad("no name")
    if end > len(data):
        return None
    cigar = struct.unpack_from(f"<{operations}I", data, name_end)
    if any(c & 15 > 8 for c in cigar):
        raise _Bad("no operation")
    here = name_end + 4 * operations
    packed = data[here : here + (bases + 1) // 2]
    seq = "".join(_BASES[b >> 4] + _BASES[b & 15] for b in packed)[:bases]
    here += (bases + 1) // 2
    quals = data[here : here + bases]
    qual = None if not bases or quals[0] == 255 else bytes(min(q, 93) + 33 for q in quals).decode("ascii")
    text = "".join(f"{c >> 4}{_OPERATIONS[c & 15]}" for c in cigar) or None
    row = (data[at + 36 : name_end - 1].decode("ascii"), flag, None if ref < 0 else references[ref], pos + 1, quality, text, seq or None, qual, _tags(data[here + bases : end]))
    return row, end


def first_record(stream: _Stream, references: list[str]) -> int | None:
    """The first place of a stream at which CHAIN records, or all up to the end of the file, follow each other."""
    at = 0
    while stream.reach(at + 1):
        place, found, complete = at, 0, True
        try:
            while found < CHAIN:
                record = parse_record(stream.data, place, references)
                if record is None:
                    if stream.more():
                        continue
                    complete = place == len(stream.data)
                    break
                place, found = record[1], found + 1
        except _Bad:
            complete = False
        if complete and found:
            return at
        at += 1
    return None


# -- source ------------------------------------------------------------------------------------------------------------


class _Range(InputPartition):
    def __init__(self, path: str, start: int, end: int, skip: int | None, references: list[str]):
        self.path, self.start, self.end, self.skip, self.references = path, start, end, skip, references


class _Reader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def partitions(self):
        from pyarrow import fs

        system, name = _opened(self.path)
        info = system.get_file_info(name)
        files = [f for f in system.get_file_info(fs.FileSelector(name)) if f.base_name.endswith(".bam")] if info.type == fs.FileType.Directory else [info]
        prefix = self.path.split("://")[0] + "://" if "://" in self.path else ""
        out = []
        for f in sorted(files, key=lambda f: f.path):
            with system.open_input_file(f.path) as file:
                skip, references = self._header(file, f.size)
            for start in range(0, f.size, self.split):
                out.append(_Range(prefix + f.path, start, min(start + self.split, f.size), skip if start == 0 else None, references))
        return out

    @staticmethod
    def _header(file, size: int) -> tuple[int, list[str]]:
        """(bytes of the header, names of its references)."""
        stream = _Stream(file, size, 0)
        if not stream.reach(12) or stream.data[:4] != b"BAM\1":
            raise ValueError("not a BAM file")
        (text,) = struct.unpack_from("<i", stream.data, 4)
        stream.reach(12 + text)
        (n,) = struct.unpack_from("<i", stream.data, 8 + text)
        at, names = 12 + text, []
        for _ in range(n):
            stream.reach(at + 4)
            (length,) = struct.unpack_from("<i", stream.data, at)
            stream.reach(at + 8 + length)
            names.append(stream.data[at + 4 : at + 3 + length].decode("ascii"))
            at += 8 + length
        return at, names

    def read(self, partition: _Range) -> Iterator:
        import pyarrow as pa

        system, name = _opened(partition.path)
        with system.open_input_file(name) as file:
            size = file.size()
            offset = 0 if partition.skip is not None else first_block(file, partition.start, size)
            if offset >= partition.end:
                return
            stream = _Stream(file, size, offset)
            at = partition.skip if partition.skip is not None else first_record(stream, partition.references)
            rows = []
            while at is not None and stream.reach(at + 1) and stream.block_of(at) < partition.end:
                record = parse_record(stream.data, at, partition.references)
                if record is None:
                    if not stream.more():
                        raise ValueError(f"{partition.path} ends within a record")
                    continue
                rows.append(record[0])
                at = record[1]
                if len(rows) >= BATCH or at > 1 << 20:
                    if stream.reach(at + 1):
                        stream.forget(at)
                        at = 0
                if len(rows) >= BATCH:
                    yield self._batch(pa, rows)
                    rows = []
            if rows:
                yield self._batch(pa, rows)

    @staticmethod
    def _batch(pa, rows):
        kinds = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string())]
        names = [c.split()[0] for c in _SCHEMA.split(", ")]
        columns = [pa.array([list(v.items()) if isinstance(v, dict) else v for v in column], kind) for column, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=names)


class BamSource(DataSource):
    """Format cladewright_bam; options path (a file, or a folder of .bam files) and splitBytes."""

    @classmethod
    def name(cls) -> str:
        return "cladewright_bam"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], int(self.options.get("splitBytes", SPLIT_BYTES)))


def read_bam(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The reads of binary alignments, with the columns of read_sam(): names split into cell, UMI, reads and flag, and tags."""
    spark.dataSource.register(BamSource)
    rows = spark.read.format("cladewright_bam").option("splitBytes", str(split_bytes)).load(path)
    return named_reads(rows)


#: Tags of the corrected and of the raw cell barcode, and of the UMI.
CORRECTED, RAW, UMI = "CB", "CR", "UR"


def with_barcodes(reads: DataFrame) -> DataFrame:
    """reads with cellBC and UMI from their tags: the corrected barcodes if any read has one, else the raw ones.

    Reads without the tag that is used go.
    """
    cell, umi = (F.try_element_at("tags", F.lit(t)) for t in (CORRECTED, UMI))
    if reads.filter(cell.isNotNull()).isEmpty():
        cell = F.try_element_at("tags", F.lit(RAW))
    return reads.withColumns({"cellBC": cell, "UMI": umi}).filter("cellBC is not null")
