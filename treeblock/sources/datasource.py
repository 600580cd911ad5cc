"""The Python data source "treeblock": batch reads with range pruning, writes, and streamed blocks.

    spark.dataSource.register(TreeblockSource)
    spark.read.format("treeblock").option("mode", "array").option("array", "data").load("/shared/file")

Modes: files, blocks, nodes, arrays, events, checksums, array. The path is a file, a folder or a pattern on a file system
that all executors mount; for other stores read with frames.containers(). In mode array an array over an uncompressed
block is read by slices of its first axis, each a partition, and small arrays of several files share one; filters on i0,
i1, ... prune partitions and rows where spark.sql.python.filterPushdown.enabled is true, else Spark filters the rows of
all partitions.
Options of mode array: array (path in the tree), rows (of a partition), offset and strides (instead of the tree's).
"""

from __future__ import annotations

import glob
import json
import os
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from treeblock.sources import arrays as A
from treeblock.sources import frames as Fr
from treeblock.sources import layout as L
from treeblock.sources import treetext as T
from treeblock.sources.codecs import FormatError

MODES = {"files": Fr.FILES, "blocks": Fr.BLOCKS, "arrays": Fr.ARRAYS, "events": Fr.EVENTS, "checksums": "file string, block_index int, status string"}
#: Elements of a partition, unless rows says otherwise.
PARTITION = 4 << 20
#: Elements of a partition of several files, unless rows is given.
SHARED = 1 << 18
#: The worker module in which Spark pushes filters, if spark.sql.python.filterPushdown.enabled is true (default false).
PUSHING = "pyspark.sql.worker.data_source_pushdown_filters"


def listed(path: str) -> list[str]:
    if os.path.isdir(path):
        return sorted(p for p in glob.glob(os.path.join(glob.escape(path), "*")) if os.path.isfile(p) and not os.path.basename(p).startswith(("_", ".")))
    found = sorted(glob.glob(path))
    if not found:
        raise FileNotFoundError(path)
    return found


def beside(path: str):
    """Reader of external sources below a file's folder; links that leave it are refused."""
    folder = os.path.realpath(os.path.dirname(path))

    def read(uri: str) -> bytes:
        full = os.path.realpath(os.path.join(folder, A.safe_relative(uri)))
        if os.path.commonpath([full, folder]) != folder:
            raise FormatError("InvalidArgument", f"source {uri!r} leaves its folder")
        with open(full, "rb") as f:
            return f.read()

    return read


@dataclass
class Slice(InputPartition):
    file: str
    first: int = 0
    stop: int | None = None


@dataclass
class Slices(InputPartition):
    parts: list[Slice]


def shared(slices: list[Slice], sizes: list[int], most: int) -> list[Slices]:
    """Neighbours together while they have no more than most elements."""
    out: list[Slices] = []
    total = most + 1
    for part, size in zip(slices, sizes, strict=True):
        total += size
        if total > most:
            out.append(Slices([]))
            total = size
        out[-1].parts.append(part)
    return out or [Slices([])]


class TreeblockSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "treeblock"

    def _array(self, path: str):
        buf = Fr.open_local(path)
        found = L.scan(buf)
        return buf, found, Fr.find_array(Fr.tree_of(buf, found), self.options.get("array", "data"))

    def schema(self):
        mode = self.options.get("mode", "array" if "array" in self.options else "files")
        if mode == "nodes":
            from treeblock.operators.tree import NODES

            return NODES
        if mode != "array":
            return MODES[mode]
        _, _, a = self._array(listed(self.options["path"])[0])
        index = ", ".join(f"i{k} long" for k in range(max(1, len(a.shape))))
        return f"file string, {index}, value {A.spark_type(a.datatype)}"

    def reader(self, schema):
        # elsewhere pushFilters is never called, and Spark refuses a reader that has it while pushdown is off
        return PrunedReader(self) if PUSHING in sys.modules else TreeblockReader(self)

    def writer(self, schema, overwrite):
        return TreeblockWriter(self.options, schema)

    def streamReader(self, schema):
        return BlockStream(self)


class TreeblockReader(DataSourceReader):
    def __init__(self, source: TreeblockSource):
        self.options, self.source = source.options, source
        self.mode = self.options.get("mode", "array" if "array" in self.options else "files")
        self.low: dict[int, int] = {}
        self.high: dict[int, int] = {}

    def partitions(self):
        if self.mode != "array":
            return [Slices([Slice(path)]) for path in listed(self.options["path"])] or [Slices([])]
        out, sizes = [], []
        for path in listed(self.options["path"]):
            buf, found, a = self.source._array(path)
            if a.source_kind == "inline":
                n, width = (a.shape or [1])[0], max(1, int(np.prod(a.shape[1:], dtype=np.int64)))
            else:
                size = len(Fr.block_bytes(buf, found, a, beside(path))) if None in a.shape else 0
                shape = A.resolved_shape(a, size) or [1]
                n, width = shape[0], max(1, int(np.prod(shape[1:], dtype=np.int64)))
            lo, hi = max(0, self.low.get(0, 0)), min(n, self.high.get(0, n))
            step = int(self.options.get("rows", 0)) or max(1, PARTITION // width)
            if a.source_kind in ("block", "last") and found.blocks[a.source if a.source_kind == "block" else -1].compression:
                step = max(1, hi - lo)  # decompressed once
            new = [Slice(path, i, min(i + step, hi)) for i in range(lo, hi, step)]
            out += new
            sizes += [(x.stop - x.first) * width for x in new]
        return shared(out, sizes, 0 if "rows" in self.options else SHARED)

    def read(self, part: Slices) -> Iterator[pa.RecordBatch]:
        for one in part.parts:
            yield from self._read(one)

    def _read(self, part: Slice) -> Iterator[pa.RecordBatch]:
        if self.mode == "array":
            buf, found, a = self.source._array(part.file)
            data = None if a.source_kind == "inline" else self._bytes(buf, found, a, part.file)
            layout = {"offset": int(self.options["offset"])} if "offset" in self.options else {}
            if "strides" in self.options:
                layout["strides"] = json.loads(self.options["strides"])
            for batch in Fr.element_batches(part.file, a, data, part.first, part.stop, **layout):
                keep = np.ones(batch.num_rows, bool)
                for k in {*self.low, *self.high} - {0}:
                    at = batch.column(1 + k).to_numpy()
                    keep &= (at >= self.low.get(k, 0)) & (at < self.high.get(k, np.iinfo(np.int64).max))
                yield batch if keep.all() else batch.filter(pa.array(keep))
            return
        buf = bytes(Fr.open_local(part.file)) if self.mode in ("events",) else Fr.open_local(part.file)
        if self.mode == "nodes":
            from treeblock.operators.tree import _arrow

            yield pa.RecordBatch.from_pylist(T.rows(part.file, Fr.tree_of(buf, L.scan(buf))), schema=_arrow())
            return
        yield pa.RecordBatch.from_pylist(self._rows(part.file, buf), schema=_schema(self.mode))

    @staticmethod
    def _bytes(buf, found, a, path):
        """An uncompressed block is a view of the map: a slice reads its own pages only."""
        if a.source_kind in ("block", "last"):
            b = found.blocks[a.source if a.source_kind == "block" else -1]
            if not b.compression:
                return memoryview(buf)[b.data_pos : len(buf) if b.streamed else b.data_pos + b.used_size]
        return Fr.block_bytes(buf, found, a, beside(path))

    def _rows(self, path, buf):
        if self.mode == "files":
            return [Fr.file_row(path, buf)]
        if self.mode == "events":
            return Fr.event_rows(path, buf)
        x = L.scan(buf)
        if self.mode == "blocks":
            return [Fr.block_row(path, b) for b in x.blocks]
        root = Fr.tree_of(buf, x)
        if self.mode == "checksums":
            by = Fr.library(root)
            return [{"file": path, "block_index": b.index, "status": L.checksum_status(buf, b, by)} for b in x.blocks]
        return [Fr.array_row(path, p, A.parse(n)) for p, n in Fr.paths(root) if A.is_array(n)]


class PrunedReader(TreeblockReader):
    """The reader that takes filters."""

    def pushFilters(self, filters):
        """Ranges on index columns; Spark need not check these again. Others are left to it."""
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else ""
            if self.mode == "array" and name[:1] == "i" and name[1:].isdigit() and type(f) in (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual):
                k, v = int(name[1:]), int(f.value)
                if type(f) in (EqualTo, GreaterThan, GreaterThanOrEqual):
                    self.low[k] = max(self.low.get(k, v), v + (type(f) is GreaterThan))
                if type(f) in (EqualTo, LessThan, LessThanOrEqual):
                    stop = v + (type(f) is not LessThan)
                    self.high[k] = min(self.high.get(k, stop), stop)
            else:
                yield f


def _schema(mode: str) -> pa.Schema:
    """The Arrow schema of a mode, which executors build without a session."""
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64()), "map<string,string>": pa.map_(pa.string(), pa.string())}
    return pa.schema([(n, kinds[t]) for n, t in (f.split(" ", 1) for f in MODES[mode].split(", "))])


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class TreeblockWriter(DataSourceArrowWriter):
    """One container for each row: file (name), tree (YAML text), blocks (array of struct(data, compression,
    already_compressed, uncompressed_size, allocated_size); all but data may be missing). Options: checksums, index
    (true), padding, formatVersion, standardVersion, library. Files appear under their names when all tasks have
    ended; an aborted write leaves none."""

    def __init__(self, options, schema):
        self.options, self.id = dict(options), uuid.uuid4().hex

    def write(self, iterator):
        folder, names = self.options["path"], []
        os.makedirs(folder, exist_ok=True)
        flag = lambda k: self.options.get(k, "true").lower() != "false"
        for batch in iterator:
            # a row at a time: a batch of containers as Python objects would be held twice
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                pending = [
                    L.Pending(b["data"], b.get("compression") or "", bool(b.get("already_compressed")), b.get("uncompressed_size"), b.get("allocated_size")) for b in row.get("blocks") or []
                ]
                tree = row.get("tree")
                if tree is not None:
                    root = T.parse(tree)
                    if flag("library") and root is not None and root.kind == "mapping" and A.get(root, "asdf_library") is None:
                        root.entries.insert(0, (T.string("asdf_library"), T.of_value({"name": "treeblock", "version": "0.1.0"})))
                    tree = T.emit(root)
                content = L.pack(
                    tree, pending, flag("checksums"), flag("index"), int(self.options.get("padding", 0)), (), self.options.get("formatversion", L.FORMAT_VERSION), self.options.get("standardversion", L.STANDARD_VERSION)
                )
                name = os.path.basename(row["file"])
                with open(os.path.join(folder, f"_{self.id}-{name}"), "wb") as f:
                    f.write(content)
                names.append(name)
        return Written(names)

    def commit(self, messages):
        for m in messages:
            for name in m.names if m else []:
                os.replace(os.path.join(self.options["path"], f"_{self.id}-{name}"), os.path.join(self.options["path"], name))

    def abort(self, messages):
        for path in glob.glob(os.path.join(glob.escape(self.options["path"]), f"_{self.id}-*")):
            os.remove(path)


class BlockStream(DataSourceStreamReader):
    """Rows of a growing array: the last block is a streamed one, its first axis *. The offset counts whole rows; a
    row whose bytes have come in part waits for the rest. The driver only counts rows: executors read them, in slices."""

    def __init__(self, source: TreeblockSource):
        self.options, self.source = source.options, source

    def _array(self):
        path = self.options["path"]
        buf, found, a = self.source._array(path)
        data = TreeblockReader._bytes(buf, found, a, path)
        return a, data, A.resolved_shape(a, len(data))

    def initialOffset(self):
        return {"row": 0}

    def latestOffset(self):
        return {"row": self._array()[2][0]}

    def partitions(self, start, end):
        width = max(1, int(np.prod(self._array()[2][1:], dtype=np.int64)))
        step = int(self.options.get("rows", 0)) or max(1, PARTITION // width)
        return [Slice(self.options["path"], i, min(i + step, end["row"])) for i in range(start["row"], end["row"], step)]

    def read(self, part: Slice) -> Iterator[pa.RecordBatch]:
        a, data, _ = self._array()
        yield from Fr.element_batches(part.file, a, data, part.first, part.stop)
