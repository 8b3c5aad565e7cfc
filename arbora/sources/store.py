"""Spark data sources for little-endian int32 numbers: `arbora_numbers` (at, value) and `arbora_graph` (arc_id, src, dst, weight).

Reading takes a single file or a folder that the writer made. Partitions are ranges of places, read where they lie: a
graph's partition finds its first node by binary search in the offsets, then walks offsets and columns side by side, so
nothing is shuffled and no task holds more than CHUNK numbers of each. Each graph partition also checks its share of the
offsets, so that a fall is found wherever it is.

Writing (numbers only) makes a folder: each task writes its runs of neighbouring places as files of their own, and the
commit lists them in `_parts.json` once they cover all places from 0 without a gap or an overlap. What tries that failed
left behind isn't in the list and is never read. A folder that is there already is replaced with mode overwrite only.

Files are opened through Arrow's file systems, so a path must be one that all machines reach.
"""

from __future__ import annotations

import json
import uuid
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from arbora.operators.graph import to_csr
from arbora.plans.scan import indexed
from arbora.plans.shared import saved

from .binary import BadFile, tree_of

#: Numbers that a step reads or writes at once.
CHUNK = 1 << 16
#: Places in a partition, unless option `step` says otherwise.
STEP = 1 << 20
LIST = "_parts.json"


class Numbers:
    """The numbers of a file, or of a written folder, by place."""

    def __init__(self, path: str):
        self.fs, top = FileSystem.from_uri(path)
        self.path, info = path, self.fs.get_file_info(top)
        if info.type == FileType.NotFound:
            raise BadFile(f"{path}: no such file")
        if info.type == FileType.File:
            if info.size % 4:
                raise BadFile(f"{path}: {info.size} bytes aren't whole numbers")
            self.parts = [(0, info.size // 4, top)]
        else:
            self.parts = [(first, n, f"{top}/{name}") for first, n, name in _listed(self.fs, top)]
        self.firsts = [p[0] for p in self.parts]
        self.total = sum(p[1] for p in self.parts)
        self._open: tuple = (None, None)

    def read(self, first: int, count: int) -> np.ndarray:
        if first < 0 or first + count > self.total:
            raise BadFile(f"{self.path}: cut short")
        out = [np.zeros(0, np.int64)]
        while count:
            k = bisect_right(self.firsts, first) - 1
            start, n, name = self.parts[k]
            take = min(count, start + n - first)
            if self._open[0] != k:
                self._open = (k, self.fs.open_input_file(name))
            out.append(np.frombuffer(self._open[1].read_at(4 * take, 4 * (first - start)), "<i4").astype(np.int64))
            if len(out[-1]) != take:
                raise BadFile(f"{self.path}: cut short")
            first, count = first + take, count - take
        return np.concatenate(out)

    def one(self, at: int) -> int:
        return int(self.read(at, 1)[0])


def _listed(fs: FileSystem, top: str) -> list[list]:
    """(first place, count, name) of the files of a folder."""
    if fs.get_file_info(f"{top}/{LIST}").type == FileType.NotFound:
        raise BadFile(f"{top}: a folder without {LIST}")
    with fs.open_input_stream(f"{top}/{LIST}") as f:
        return json.loads(f.read())


@dataclass
class Range(InputPartition):
    first: int
    last: int
    share: tuple[int, int] = (0, 0)


def _ranges(total: int, step: int) -> list[Range]:
    return [Range(a, min(a + step, total)) for a in range(0, max(total, 1), step)]


class NumbersReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.step = options["path"], int(options.get("step", STEP))

    def partitions(self) -> list[Range]:
        return _ranges(Numbers(self.path).total, self.step)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        numbers = Numbers(self.path)
        for a in range(partition.first, partition.last, CHUNK):
            b = min(a + CHUNK, partition.last)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, b)), pa.array(numbers.read(a, b - a))], ["at", "value"])


class GraphReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.step = options["path"], int(options.get("step", STEP))

    def partitions(self) -> list[Range]:
        n, m, _ = sizes(self.path)
        ranges = _ranges(m, self.step)
        for i, r in enumerate(ranges):
            r.share = (n * i // len(ranges), n * (i + 1) // len(ranges))
        return ranges

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        numbers = Numbers(self.path)
        n, m, weighted = sizes(self.path, numbers)
        for _ in _offsets(numbers, *partition.share):
            pass
        if numbers.one(2) != 0 or numbers.one(2 + n) != m:
            raise BadFile(f"{self.path}: offsets don't go from 0 to {m}")
        low, high = 0, n  # the last node whose offset is at most first
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if numbers.one(2 + mid) <= partition.first else (low, mid)
        if partition.first == partition.last:
            return
        for node, own in _offsets(numbers, low, n):
            begin, end = max(int(own[0]), partition.first), min(int(own[-1]), partition.last)
            for a in range(begin, end, CHUNK):
                at = np.arange(a, min(a + CHUNK, end))
                dst = numbers.read(3 + n + a, len(at))
                if dst.min() < 0 or dst.max() >= n:
                    raise BadFile(f"{self.path}: a column isn't a node")
                weight = pa.array(numbers.read(3 + n + m + a, len(at))) if weighted else pa.nulls(len(at), pa.int64())
                src = node + np.searchsorted(own, at, side="right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(src), pa.array(dst), weight], ["arc_id", "src", "dst", "weight"])
            if own[-1] >= partition.last:
                return


def sizes(path: str, numbers: Numbers | None = None) -> tuple[int, int, bool]:
    """(nodes, arcs, whether there are weights) of a graph."""
    numbers = numbers or Numbers(path)
    n, m = numbers.read(0, 2).tolist()
    if n < 0 or m < 0 or numbers.total not in (3 + n + m, 3 + n + 2 * m):
        raise BadFile(f"{path}: {numbers.total} numbers don't hold a graph of {n} nodes and {m} arcs")
    return n, m, numbers.total > 3 + n + m


def _offsets(numbers: Numbers, first: int, last: int) -> Iterator[tuple[int, np.ndarray]]:
    """(node, offsets of it and those after it and of the one behind them), until last; they mustn't fall."""
    for node in range(first, last, CHUNK):
        own = numbers.read(2 + node, min(CHUNK, last - node) + 1)
        if (np.diff(own) < 0).any():
            raise BadFile(f"{numbers.path}: offsets fall")
        yield node, own


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[int, int, str]]


class NumbersWriter(DataSourceArrowWriter):
    """Takes (at, value) in any partitions; a task makes a file for each run of neighbouring places, in the order it gets them."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite

    def _folder(self) -> tuple[FileSystem, str]:
        return FileSystem.from_uri(self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, top = self._folder()
        fs.create_dir(top)
        files, out, after = [], None, None
        try:
            for batch in iterator:
                at, value = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("at", "value"))
                if len(value) and (value.min() < -(2**31) or value.max() >= 2**31):
                    raise BadFile(f"{self.path}: a number doesn't fit into 32 bits")
                for own in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at) != 1) + 1):
                    if not len(own):
                        continue
                    if out is None or int(at[own[0]]) != after:
                        if out:
                            out.close()
                        files.append([int(at[own[0]]), 0, f"part-{uuid.uuid4().hex}.bin"])
                        out = fs.open_output_stream(f"{top}/{files[-1][2]}")
                    out.write(value[own].astype("<i4").tobytes())
                    files[-1][1] += len(own)
                    after = int(at[own[-1]]) + 1
        finally:
            if out:
                out.close()
        return Written([tuple(f) for f in files])

    def commit(self, messages: list[Written | None]) -> None:
        fs, top = self._folder()
        files = sorted(f for m in messages if m for f in m.files)
        ends = [0, *(first + n for first, n, _ in files)]
        there = fs.get_file_info(f"{top}/{LIST}").type != FileType.NotFound
        if [f[0] for f in files] != ends[:-1] or there and not self.overwrite:
            self.abort(messages)
            raise BadFile(f"{self.path}: there already" if there and not self.overwrite else f"{self.path}: places have gaps or repeat")
        old = _listed(fs, top) if there else []
        fs.create_dir(top)
        with fs.open_output_stream(f"{top}/{LIST}.new") as f:
            f.write(json.dumps(files).encode())
        fs.move(f"{top}/{LIST}.new", f"{top}/{LIST}")
        for _, _, name in old:
            fs.delete_file(f"{top}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        fs, top = self._folder()
        for m in messages:
            for _, _, name in m.files if m else ():
                if fs.get_file_info(f"{top}/{name}").type != FileType.NotFound:
                    fs.delete_file(f"{top}/{name}")


class NumbersSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "arbora_numbers"

    def schema(self) -> str:
        return "at long, value long"

    def reader(self, schema) -> NumbersReader:
        return NumbersReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> NumbersWriter:
        return NumbersWriter(dict(self.options), overwrite)


class GraphSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "arbora_graph"

    def schema(self) -> str:
        return "arc_id long, src long, dst long, weight long"

    def reader(self, schema) -> GraphReader:
        return GraphReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes both formats known to the session, also for SQL's USING."""
    spark.dataSource.register(NumbersSource)
    spark.dataSource.register(GraphSource)


def write_numbers(rows: DataFrame, path: str, mode: str = "append") -> None:
    """rows: (at, value) with each place from 0 once. Ranges of places go to tasks, so each task makes one file."""
    register(rows.sparkSession)
    own = rows.select(F.col("at").cast("long").alias("at"), F.col("value").cast("long").alias("value"))
    own.repartitionByRange("at").sortWithinPartitions("at").write.format("arbora_numbers").mode(mode).save(path)


def write_graph(arcs: DataFrame, n: int, path: str, mode: str = "append") -> None:
    """arcs: (src, dst) or (src, dst, weight) on nodes 0..n-1, stored by source, then target."""
    spark = arcs.sparkSession
    extra = [c for c in ("weight",) if c in arcs.columns]
    own = saved(indexed(arcs.select("src", "dst", *extra), ["src", "dst", *extra], "at"), "numbered")
    m = own.count()
    rows = spark.createDataFrame([(0, n), (1, m), (2 + n, m)], "at long, value long")
    rows = rows.unionByName(to_csr(own, n).select((F.col("src") + 2).alias("at"), F.col("offset").cast("long").alias("value")))
    for k, c in enumerate(["dst", *extra]):
        rows = rows.unionByName(own.select((F.col("at") + 3 + n + k * m).cast("long").alias("at"), F.col(c).cast("long").alias("value")))
    write_numbers(rows, path, mode)


def read_graph(spark: SparkSession, path: str, step: int = STEP) -> DataFrame:
    """(arc_id, src, dst, weight): weight is null in a graph without weights."""
    register(spark)
    return spark.read.format("arbora_graph").option("step", step).load(path)


def write_tree(tree: DataFrame, queries: DataFrame, path: str, mode: str = "append") -> None:
    """tree on nodes 0..V-1; queries (qid, x, y) by qid from 0."""
    spark = tree.sparkSession
    v, q = tree.count(), queries.count()
    root = tree.where("parent is null").first()["node"]
    rows = spark.createDataFrame([(0, v), (1, root), (2 + v, q)], "at long, value long")
    rows = rows.unionByName(tree.select((F.col("node") + 2).alias("at"), F.coalesce("parent", F.lit(-1)).cast("long").alias("value")))
    both = F.explode(F.array(*[F.struct((2 * F.col("qid") + 3 + v + k).alias("at"), F.col(c).alias("value")) for k, c in enumerate("xy")])).alias("z")
    write_numbers(rows.unionByName(queries.select(both).select("z.at", "z.value")), path, mode)


def read_tree(spark: SparkSession, path: str, step: int = STEP) -> tuple[DataFrame, DataFrame]:
    """(tree, queries) of a test file."""
    register(spark)
    return tree_of(spark.read.format("arbora_numbers").option("step", step).load(path), Numbers(path).total)
