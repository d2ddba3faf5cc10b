"""Map extracts in their binary block format, as a data source that is read in many tasks.

A file is a row of blocks, each a length, a header and compressed data. A task takes a range of
bytes: it looks for the first block that begins in it, whose header shows it, and reads block after
block until one begins beyond. So no index is needed and the driver sees the file's size alone. Two
tables come from it: objects that have a tag, and the places of all nodes; ways are joined to their
nodes' places by id, as Spark joins any two tables.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from trackloom.sources import readers

OBJECTS = "kind string, id long, lon double, lat double, refs array<long>, tags map<string,string>"
PLACES = "id long, lon double, lat double"
SPLIT_BYTES = 64 << 20
MOST_BLOCK = 32 << 20
#: A data block's header begins so (its type, then the tag of its data's size).
HEADER = re.compile(rb"\x0a\x07OSMData(?:\x12.{0,64}?)?\x18", re.DOTALL)
UNIT = 1e-9


def varint(data, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        value |= (b & 127) << shift
        at += 1
        if b < 128:
            return value, at
        shift += 7


def fields(data) -> Iterator[tuple[int, object]]:
    """Number and value of each field of a message: a number, or bytes."""
    at, n = 0, len(data)
    while at < n:
        tag, at = varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(data, at)
        elif kind == 2:
            size, at = varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            size = {1: 8, 5: 4}[kind]
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


def packed(data) -> np.ndarray:
    """A packed list of numbers."""
    b = np.frombuffer(data, dtype=np.uint8)
    if not len(b):
        return np.zeros(0, dtype=np.int64)
    ends = np.flatnonzero(b < 128)
    begins = np.append(0, ends[:-1] + 1)
    place = np.arange(len(b)) - np.repeat(begins, ends - begins + 1)
    return np.add.reduceat((b & 127).astype(np.uint64) << (7 * place).astype(np.uint64), begins).astype(np.int64)


def signed(x: np.ndarray) -> np.ndarray:
    x = x.view(np.uint64)
    return (x >> np.uint64(1)).astype(np.int64) ^ -(x & np.uint64(1)).astype(np.int64)


def of_range(file, size: int, lo: int, hi: int) -> Iterator[bytes]:
    """The decompressed data blocks that begin at a byte of lo..hi."""
    at = begin_of(file, size, lo, hi)
    while at is not None and at < hi and at + 4 <= size:
        file.seek(at)
        n = int.from_bytes(file.read(4), "big")
        header = dict(fields(file.read(n)))
        length = header.get(3, 0)
        if header.get(1) == b"OSMData":
            blob = dict(fields(file.read(length)))
            yield bytes(blob[1]) if 1 in blob else zlib.decompress(blob[3])
        at += 4 + n + length


def begin_of(file, size: int, lo: int, hi: int) -> int | None:
    """Where the first block at or after lo begins, if one does before hi."""
    if lo == 0:
        return 0
    step, at = 1 << 20, lo
    while at < hi:
        file.seek(at)
        window = file.read(step + 256)
        for m in HEADER.finditer(window):
            begin = at + m.start() - 4
            if lo <= begin < hi and m.start() < step + 4 and _is_block(file, size, begin):
                return begin
        at += step
    return None


def _is_block(file, size: int, begin: int) -> bool:
    """A header as long as it says, and another after its data, or the file's end."""
    file.seek(begin)
    n = int.from_bytes(file.read(4), "big")
    if not 0 < n < 65536:
        return False
    try:
        header = dict(fields(file.read(n)))
    except (IndexError, KeyError):
        return False
    length = header.get(3, 0)
    following = begin + 4 + n + length if isinstance(length, int) else size + 1
    if header.get(1) != b"OSMData" or not 0 < length <= MOST_BLOCK or following > size:
        return False
    file.seek(following)
    after = file.read(13)
    return following == size or after[4:6] == b"\x0a\x07" and after[6:13] == b"OSMData"


class Group:
    """One group of a block's objects."""

    def __init__(self, block: bytes):
        self.strings, self.groups, self.unit, self.off = [], [], 100, [0, 0]
        for k, v in fields(block):
            if k == 1:
                self.strings = [bytes(s).decode("utf-8", "replace") for _, s in fields(v)]
            elif k == 2:
                self.groups.append(v)
            elif k == 17:
                self.unit = v
            elif k in (19, 20):
                self.off[k - 19] = _as_signed(v)

    def degrees(self, lat: np.ndarray, lon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (self.off[0] + self.unit * lat) * UNIT, (self.off[1] + self.unit * lon) * UNIT

    def nodes(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[dict] | None]]:
        """ids, lats, lons and tags of nodes; tags are none where no node of the lot has any."""
        for g in self.groups:
            single = []
            for k, v in fields(g):
                if k == 2:
                    f = dict(fields(v))
                    ids, lat, lon = (np.cumsum(signed(packed(f.get(n, b"")))) for n in (1, 8, 9))
                    yield ids, *self.degrees(lat, lon), self._dense_tags(packed(f.get(10, b"")), len(ids))
                elif k == 1:
                    f = dict(fields(v))
                    single.append((_zigzag(f.get(1, 0)), _zigzag(f.get(8, 0)), _zigzag(f.get(9, 0)), self._tags(f)))
            if single:
                ids, lat, lon, tags = zip(*single, strict=True)
                yield np.array(ids, dtype=np.int64), *self.degrees(np.array(lat), np.array(lon)), list(tags)

    def ways(self) -> Iterator[tuple[int, np.ndarray, dict]]:
        for g in self.groups:
            for k, v in fields(g):
                if k == 3:
                    f = dict(fields(v))
                    yield f.get(1, 0), np.cumsum(signed(packed(f.get(8, b"")))), self._tags(f)

    def _tags(self, f: dict) -> dict:
        return {self.strings[a]: self.strings[b] for a, b in zip(packed(f.get(2, b"")).tolist(), packed(f.get(3, b"")).tolist(), strict=False)}

    def _dense_tags(self, flat: np.ndarray, n: int) -> list[dict] | None:
        if not flat.any():
            return None
        out, at, values = [{} for _ in range(n)], 0, flat.tolist()
        k = 0
        while k < len(values):
            if values[k] == 0:
                at, k = at + 1, k + 1
            else:
                out[at][self.strings[values[k]]] = self.strings[values[k + 1]]
                k += 2
        return out


def _zigzag(v: int) -> int:
    return (v >> 1) ^ -(v & 1)


def _as_signed(v: int) -> int:
    return v - (1 << 64) if v >= 1 << 63 else v


class Range(InputPartition):
    def __init__(self, path: str, size: int, lo: int, hi: int):
        self.path, self.size, self.lo, self.hi = path, size, lo, hi


def _open(path: str):
    return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


class ExtractReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.key, self.split = options["path"], options.get("key"), int(options.get("splitbytes", SPLIT_BYTES))

    def partitions(self) -> list[InputPartition]:
        fs, path = _open(self.path)
        chosen = fs.get_file_info(pafs.FileSelector(path)) if fs.get_file_info(path).type == pafs.FileType.Directory else [fs.get_file_info(path)]
        return [Range(f.path, f.size, lo, min(f.size, lo + self.split)) for f in chosen if f.is_file for lo in range(0, f.size, self.split)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        fs, _ = _open(self.path)
        with fs.open_input_file(partition.path) as file:
            for data in of_range(file, partition.size, partition.lo, partition.hi):
                yield from (self.objects if self.key else self.places)(Group(data))

    def places(self, group: Group) -> Iterator[pa.RecordBatch]:
        for ids, lat, lon, _ in group.nodes():
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(lon), pa.array(lat)], names=["id", "lon", "lat"])

    def objects(self, group: Group) -> Iterator[pa.RecordBatch]:
        rows = [("node", int(i), float(x), float(y), None, t) for ids, lat, lon, tags in group.nodes() if tags for i, y, x, t in zip(ids, lat, lon, tags, strict=True) if self.key in t]
        rows += [("way", i, None, None, refs.tolist(), t) for i, refs, t in group.ways() if self.key in t]
        if rows:
            kinds = [pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.map_(pa.string(), pa.string())]
            columns = [pa.array([list(v.items()) for v in c] if pa.types.is_map(t) else c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["kind", "id", "lon", "lat", "refs", "tags"])


class ExtractSource(DataSource):
    """Options: path (a file or a folder of files), key (objects with this tag; without it, places of all nodes), splitBytes."""

    @classmethod
    def name(cls) -> str:
        return "map_extract"

    def schema(self) -> str:
        return OBJECTS if "key" in self.options else PLACES

    def reader(self, schema) -> ExtractReader:
        return ExtractReader(dict(self.options))


def scan(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> tuple[DataFrame, DataFrame]:
    """SRC1: stations and rail lines of extract files, as ``readers.map_extract`` makes them.

    A way's nodes that the files lack are left out of its line.
    """
    spark.dataSource.register(ExtractSource)
    read = lambda: spark.read.format("map_extract").option("splitBytes", split_bytes)
    c = F.col
    named = [c("id").cast("string").alias("osm_id"), c("tags")["railway"].alias("railway"), c("tags")["name"].alias("name"), F.to_json("tags").alias("tags_json")]
    objects = read().option("key", "railway").load(path)
    nodes = objects.where("kind = 'node'").select(*named, "lon", "lat")
    wanted = objects.where("kind = 'way'").where(c("tags")["railway"].isin("station", "halt", "rail"))
    steps = wanted.select(c("id").alias("way"), F.posexplode("refs").alias("pos", "ref"))
    at = read().load(path).select(c("id").alias("ref"), "lon", "lat")
    placed = steps.join(at, "ref").groupBy("way").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "lon", "lat"))), lambda x: F.struct(x["lon"].alias("lon"), x["lat"].alias("lat"))).alias("coords"))
    ways = wanted.select("id", *named).join(placed, c("id") == c("way")).drop("id", "way")
    return readers.map_extract(nodes, ways)
