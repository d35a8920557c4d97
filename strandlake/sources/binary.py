"""Binary sequence and signal files.

``twobit``, ``nib`` and ``bigwig`` / ``bigbed`` are Python data sources. BigWig and BigBed partitions are
runs of the file's own index leaves, and filters on chrom, start and end leave out leaves before any
block is read. Register them with ``register(spark)``.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

# Signatures of the formats.
BIGWIG, BIGBED, TWOBIT, NIB, CHROM_TREE, RANGE_TREE = 0x888FFC26, 0x8789F2EB, 0x1A412743, 0x6BE93D3A, 0x78CA8C91, 0x2468ACE0
_CHUNK = 100_000


def _order(raw: bytes, signature: int) -> str:
    for order in "<>":
        if struct.unpack(order + "I", raw[:4])[0] == signature:
            return order
    raise ValueError("not a file of this format")


class BigFile:
    """Header, sequence names and index leaves of a BigWig or BigBed file."""

    def __init__(self, path: str, signature: int):
        self.path = path
        with open(path, "rb") as f:
            head = f.read(64)
            self.order = o = _order(head, signature)
            (_, _, self.n_zoom, tree, self.data, self.index, self.fields, _, _, self.total, self.buffer, _) = struct.unpack(o + "IHHQQQHHQQIQ", head)
            f.seek(64)
            self.zooms = [struct.unpack(o + "IIQQ", f.read(24)) for _ in range(self.n_zoom)]
            self.chroms = {i: (name, size) for name, i, size in self._names(f, tree)}

    def _names(self, f, at: int) -> Iterator[tuple[str, int, int]]:
        f.seek(at)
        _, _, key, _, _, _ = struct.unpack(self.order + "IIIIQQ", f.read(32))
        todo = [at + 32]
        while todo:
            f.seek(todo.pop())
            leaf, _, n = struct.unpack(self.order + "BBH", f.read(4))
            for _ in range(n):
                name = f.read(key).rstrip(b"\0").decode()
                if leaf:
                    yield (name, *struct.unpack(self.order + "II", f.read(8)))
                else:
                    todo.append(struct.unpack(self.order + "Q", f.read(8))[0])

    def leaves(self, chroms: set[int] | None, low: int, high: int) -> list[tuple[int, int]]:
        """(offset, size) of the data blocks that may hold rows of the chroms in [low, high)."""
        out, o = [], self.order
        with open(self.path, "rb") as f:
            todo = [self.index + 48]
            while todo:
                f.seek(todo.pop())
                leaf, _, n = struct.unpack(o + "BBH", f.read(4))
                for _ in range(n):
                    c1, s, c2, e = struct.unpack(o + "IIII", f.read(16))
                    at = struct.unpack(o + ("QQ" if leaf else "Q"), f.read(16 if leaf else 8))
                    meets = chroms is None or any(c1 <= c <= c2 and not (c1 == c2 and (e <= low or s >= high)) for c in chroms)
                    if meets:
                        (out if leaf else todo).append(at if leaf else at[0])
        return sorted(out)

    def block(self, f, offset: int, size: int) -> bytes:
        f.seek(offset)
        raw = f.read(size)
        return zlib.decompress(raw) if self.buffer else raw

    def wig_rows(self, raw: bytes) -> Iterator[tuple]:
        o = self.order
        c, start, _, step, span, kind, _, n = struct.unpack(o + "IIIIIBBH", raw[:24])
        name = self.chroms[c][0]
        if kind == 1:
            for s, e, v in struct.iter_unpack(o + "IIf", raw[24 : 24 + 12 * n]):
                yield name, s, e, v
        elif kind == 2:
            for s, v in struct.iter_unpack(o + "If", raw[24 : 24 + 8 * n]):
                yield name, s, s + span, v
        else:
            for i, (v,) in enumerate(struct.iter_unpack(o + "f", raw[24 : 24 + 4 * n])):
                yield name, start + i * step, start + i * step + span, v

    def bed_rows(self, raw: bytes) -> Iterator[tuple]:
        at = 0
        while at < len(raw):
            c, s, e = struct.unpack(self.order + "III", raw[at : at + 12])
            end = raw.index(b"\0", at + 12)
            rest = raw[at + 12 : end].decode()
            yield self.chroms[c][0], s, e, rest.split("\t") if rest else []
            at = end + 1


@dataclass
class Leaves(InputPartition):
    blocks: list

    def __post_init__(self) -> None:
        super().__init__(None)


class _BigReader(DataSourceReader):
    def __init__(self, options: dict, signature: int):
        self.path, self.signature = options["path"].removeprefix("file://"), signature
        self.per_task = int(options.get("blocksPerTask", "256"))
        self.chrom: str | None = None
        self.low, self.high = 0, 2**32

    def pushFilters(self, filters: Sequence[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) else None
            if isinstance(f, EqualTo) and name == "chrom":
                self.chrom = f.value
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)) and name == "end_pos":
                self.low = max(self.low, f.value)
            elif isinstance(f, (LessThan, LessThanOrEqual)) and name == "start_pos":
                self.high = min(self.high, f.value + 1)
            yield f  # Spark checks every row again: a block also holds rows beside the range

    def partitions(self) -> list[Leaves]:
        big = BigFile(self.path, self.signature)
        chroms = None if self.chrom is None else {i for i, (n, _) in big.chroms.items() if n == self.chrom}
        found = big.leaves(chroms, self.low, self.high) if chroms != set() else []
        return [Leaves(found[i : i + self.per_task]) for i in range(0, len(found), self.per_task)] or [Leaves([])]

    def read(self, partition: Leaves) -> Iterator[tuple]:
        if not partition.blocks:
            return
        big = BigFile(self.path, self.signature)
        rows = big.wig_rows if self.signature == BIGWIG else big.bed_rows
        with open(self.path, "rb") as f:
            for offset, size in partition.blocks:
                yield from rows(big.block(f, offset, size))


class BigWigSource(DataSource):
    """chrom, start_pos, end_pos, value."""

    @classmethod
    def name(cls) -> str:
        return "bigwig"

    def schema(self) -> str:
        return "chrom string, start_pos bigint, end_pos bigint, value float"

    def reader(self, schema) -> DataSourceReader:
        return _BigReader(self.options, BIGWIG)


class BigBedSource(DataSource):
    """chrom, start_pos, end_pos, rest (the other fields)."""

    @classmethod
    def name(cls) -> str:
        return "bigbed"

    def schema(self) -> str:
        return "chrom string, start_pos bigint, end_pos bigint, rest array<string>"

    def reader(self, schema) -> DataSourceReader:
        return _BigReader(self.options, BIGBED)


@dataclass
class Chunk(InputPartition):
    name: str
    low: int
    high: int

    def __post_init__(self) -> None:
        super().__init__(None)


class TwoBit:
    def __init__(self, path: str):
        self.path = path
        with open(path, "rb") as f:
            head = f.read(16)
            self.order = o = _order(head, TWOBIT)
            n = struct.unpack(o + "I", head[8:12])[0]
            self.at = {}
            for _ in range(n):
                name = f.read(f.read(1)[0]).decode()
                self.at[name] = struct.unpack(o + "I", f.read(4))[0]

    def _head(self, f, name: str):
        o = self.order
        f.seek(self.at[name])
        size = struct.unpack(o + "I", f.read(4))[0]
        runs = []
        for _ in range(2):
            k = struct.unpack(o + "I", f.read(4))[0]
            flat = np.frombuffer(f.read(8 * k), o + "u4")
            runs.append(np.stack([flat[:k], flat[:k] + flat[k:]], 1).astype("int64"))
        f.read(4)
        return size, runs[0], runs[1], f.tell()

    def sizes(self) -> dict[str, int]:
        with open(self.path, "rb") as f:
            return {n: self._head(f, n)[0] for n in self.at}

    def get(self, name: str, low: int, high: int, mask: bool = True) -> str:
        with open(self.path, "rb") as f:
            size, unknown, soft, at = self._head(f, name)
            low, high = max(low, 0), min(high, size)
            if low >= high:
                return ""
            f.seek(at + low // 4)
            raw = np.frombuffer(f.read((high + 3) // 4 - low // 4), "u1")
        codes = np.stack([(raw >> s) & 3 for s in (6, 4, 2, 0)], 1).ravel()[low % 4 : low % 4 + high - low]
        text = np.frombuffer(b"TCAG", "u1")[codes].copy()
        for runs, change in ((unknown, "n"), (soft if mask else soft[:0], "s")):
            for s, e in runs[(runs[:, 1] > low) & (runs[:, 0] < high)]:
                part = text[max(s - low, 0) : e - low]
                part[:] = ord("N") if change == "n" else part | 32
        return text.tobytes().decode()


class _TwoBitReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"].removeprefix("file://")
        self.chunk, self.mask = int(options.get("chunk", _CHUNK)), options.get("mask", "true") == "true"
        self.only: str | None = None

    def pushFilters(self, filters: Sequence[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("name",):
                self.only = f.value
            yield f

    def partitions(self) -> list[Chunk]:
        sizes = TwoBit(self.path).sizes()
        wanted = {n: s for n, s in sizes.items() if self.only in (None, n)}
        return [Chunk(n, a, min(a + self.chunk, s)) for n, s in wanted.items() for a in range(0, max(s, 1), self.chunk)] or [Chunk("", 0, 0)]

    def read(self, partition: Chunk) -> Iterator[tuple]:
        if partition.name:
            yield partition.name, partition.low, TwoBit(self.path).get(partition.name, partition.low, partition.high, self.mask)


class TwoBitSource(DataSource):
    """name, chunk_start, text: sequences in chunks; option ``mask`` keeps soft-masked letters lower-case."""

    @classmethod
    def name(cls) -> str:
        return "twobit"

    def schema(self) -> str:
        return "name string, chunk_start bigint, text string"

    def reader(self, schema) -> DataSourceReader:
        return _TwoBitReader(self.options)


def nib_text(path: str, low: int = 0, high: int | None = None) -> str:
    """Letters of a NIB file: two of 4 bits a byte, the high half first; the top bit is the soft mask."""
    with open(path, "rb") as f:
        head = f.read(8)
        size = struct.unpack(_order(head, NIB) + "I", head[4:])[0]
        high = size if high is None else min(high, size)
        f.seek(8 + low // 2)
        raw = np.frombuffer(f.read((high + 1) // 2 - low // 2), "u1")
    codes = np.stack([raw >> 4, raw & 15], 1).ravel()[low % 2 : low % 2 + high - low]
    return np.frombuffer(b"TCAGNXXXtcagnxxx", "u1")[codes].tobytes().decode()


class _NibReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.chunk = options["path"].removeprefix("file://"), int(options.get("chunk", _CHUNK))

    def partitions(self) -> list[Chunk]:
        with open(self.path, "rb") as f:
            head = f.read(8)
        size = struct.unpack(_order(head, NIB) + "I", head[4:])[0]
        return [Chunk(self.path, a, min(a + self.chunk, size)) for a in range(0, max(size, 1), self.chunk)]

    def read(self, partition: Chunk) -> Iterator[tuple]:
        yield partition.low, nib_text(self.path, partition.low, partition.high)


class NibSource(DataSource):
    """chunk_start, text."""

    @classmethod
    def name(cls) -> str:
        return "nib"

    def schema(self) -> str:
        return "chunk_start bigint, text string"

    def reader(self, schema) -> DataSourceReader:
        return _NibReader(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (BigWigSource, BigBedSource, TwoBitSource, NibSource):
        spark.dataSource.register(source)
