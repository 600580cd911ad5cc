"""Frames of containers: files, blocks, nodes, arrays, elements, events, checksums.

Input: a frame (file string, content binary), as containers() reads it with Spark's own file reader, so that any store
that Spark reaches will do. Every function is one mapInArrow over it; a file is read by one task. Files that are not well formed
give no rows but one in files(), with the error's code.
"""

from __future__ import annotations

import mmap
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeblock.operators.tree import NODES, _arrow
from treeblock.sources import arrays as A
from treeblock.sources import layout as L
from treeblock.sources import treetext as T
from treeblock.sources.codecs import FormatError

FILES = "file string, format_version string, standard_version string, comments array<string>, tree_start long, tree_end long, block_count int, block_index_pos long, block_index_offsets array<long>, index_rejection string, error string"
BLOCKS = "file string, block_index int, header_pos long, data_pos long, header_size int, flags long, compression string, allocated_size long, used_size long, data_size long, checksum binary"
ARRAYS = "file string, node_path string, source_kind string, source_block int, source_uri string, shape array<long>, datatype string, byteorder string, offset long, strides array<long>, mask string"
EVENTS = "file string, seq int, type string, details map<string,string>"
#: Elements of an Arrow batch.
BATCH = 1 << 18


def containers(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")


def tree_of(buf, found: L.Layout) -> T.Node | None:
    if found.tree_start is None:
        return None
    return T.parse(bytes(buf[found.tree_start : found.tree_end]))


def paths(root: T.Node | None) -> Iterator[tuple[str, T.Node]]:
    """node_path and node of every node but aliases."""
    from treeblock.plans.paths import escape

    todo = [("/", root)] if root is not None else []
    while todo:
        path, node = todo.pop()
        if node.kind == "alias":
            continue
        yield path, node
        base = path if path != "/" else ""
        below = node.children() if node.kind in ("sequence", "mapping") else []
        todo += [(f"{base}/{escape(k) if k is not None else i}", c) for i, (k, c) in reversed(list(enumerate(below)))]


def library(root: T.Node | None) -> tuple[str, tuple[int, ...]] | None:
    """Name and version of the writer."""
    found = A.plain(A.get(root, "asdf_library")) if root is not None else None
    if not isinstance(found, dict) or not found.get("name"):
        return None
    numbers = []
    for part in str(found.get("version", "")).split(".")[:3]:
        digits = "".join(c for c in part if c.isdigit())
        numbers.append(int(digits) if digits else 0)
    return found["name"], tuple([*numbers, 0, 0, 0][:3])


def _mapped(df: DataFrame, schema: str, rows: Callable[[str, bytes], list[dict]]) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                if content.is_valid:
                    found = rows(name.as_py(), content.as_py())
                    yield pa.RecordBatch.from_pylist(found, schema=arrow)

    return df.select("file", "content").mapInArrow(run, schema)


def file_row(name: str, buf) -> dict:
    try:
        x = L.scan(buf)
    except FormatError as e:
        return {"file": name, "error": e.code}
    return {
        "file": name, "format_version": x.format_version, "standard_version": x.standard_version, "comments": x.comments, "tree_start": x.tree_start, "tree_end": x.tree_end,
        "block_count": len(x.blocks), "block_index_pos": x.index_pos, "block_index_offsets": x.index_offsets, "index_rejection": x.index_rejection, "error": None,
    }


def block_row(name: str, b: L.Block) -> dict:
    return {"file": name, "block_index": b.index, "header_pos": b.header_pos, "data_pos": b.data_pos, "header_size": b.header_size, "flags": b.flags, "compression": b.compression} | {
        "allocated_size": b.allocated_size, "used_size": b.used_size, "data_size": b.data_size, "checksum": b.checksum
    }


def array_row(name: str, path: str, a: A.Array) -> dict:
    kind = a.datatype if isinstance(a.datatype, str) else f"{a.datatype[0]}[{a.datatype[1]}]" if isinstance(a.datatype, tuple) else A.spark_type(a.datatype)
    return {
        "file": name, "node_path": path, "source_kind": a.source_kind, "source_block": a.source if a.source_kind in ("block", "last") else None, "source_uri": a.source if a.source_kind == "external" else None,
        "shape": a.shape, "datatype": kind, "byteorder": a.byteorder, "offset": a.offset, "strides": a.strides, "mask": None if a.mask is None else str(a.mask),
    }


def event_rows(name: str, buf) -> list[dict]:
    """The pull parser's stream: versions, comments, the index before the tree, the tree's own events, blocks, end.
    Where the tree is no YAML, only its own events are missing."""
    import yaml

    out: list[dict] = []
    add = lambda kind, **d: out.append({"file": name, "seq": len(out), "type": kind, "details": [(k, None if v is None else str(v)) for k, v in d.items()]})
    x = L.scan(buf)
    add("format_version", version=x.format_version)
    if x.standard_version is not None:
        add("standard_version", version=x.standard_version)
    for c in x.comments:
        add("comment", text=c)
    if x.index_offsets is not None and x.index_rejection is None:
        add("block_index", offsets=",".join(map(str, x.index_offsets)))
    if x.tree_start is not None:
        add("tree_start", pos=x.tree_start)
        own = []
        try:
            for e in yaml.parse(bytes(buf[x.tree_start : x.tree_end]), Loader=T.LOADER):
                own.append((type(e).__name__.removesuffix("Event"), {k: getattr(e, k, None) for k in ("anchor", "tag", "value") if getattr(e, k, None) is not None}))
                if isinstance(e, yaml.DocumentEndEvent):
                    break
        except yaml.YAMLError:
            own = []
        for kind, d in own:
            add("yaml", event=kind, **d)
        add("tree_end", pos=x.tree_end)
    for b in x.blocks:
        add("block", index=b.index, pos=b.header_pos, compression=b.compression, used_size=b.used_size, data_size=b.data_size)
    add("end")
    return out


def files(df: DataFrame) -> DataFrame:
    return _mapped(df, FILES, lambda name, buf: [file_row(name, buf)])


def _safe(fn: Callable[[str, bytes], list[dict]]) -> Callable[[str, bytes], list[dict]]:
    def run(name: str, buf: bytes) -> list[dict]:
        try:
            return fn(name, buf)
        except (FormatError, T.TreeError):
            return []

    return run


def blocks(df: DataFrame, payload: bool = False) -> DataFrame:
    """Blocks; with payload, also raw (stored bytes) and data (decompressed, null where that fails)."""

    def data(buf, b):
        try:
            return L.data_of(buf, b)
        except FormatError:
            return None

    def rows(name, buf):
        return [block_row(name, b) | ({"raw": L.raw_of(buf, b), "data": data(buf, b)} if payload else {}) for b in L.scan(buf).blocks]

    return _mapped(df, BLOCKS + (", raw binary, data binary" if payload else ""), _safe(rows))


def nodes(df: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _safe(lambda name, buf: T.rows(name, tree_of(buf, L.scan(buf))))
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                if content.is_valid:
                    yield pa.RecordBatch.from_pylist(rows(name.as_py(), content.as_py()), schema=_arrow())

    return df.select("file", "content").mapInArrow(run, NODES)


def arrays(df: DataFrame) -> DataFrame:
    def rows(name, buf):
        out = []
        for path, node in paths(tree_of(buf, L.scan(buf))):
            if A.is_array(node):
                try:
                    out.append(array_row(name, path, A.parse(node)))
                except (FormatError, ValueError, TypeError):
                    continue
        return out

    return _mapped(df, ARRAYS, _safe(rows))


def events(df: DataFrame) -> DataFrame:
    return _mapped(df, EVENTS, _safe(event_rows))


def checksums(df: DataFrame) -> DataFrame:
    """file, block_index, status: absent, valid or invalid."""

    def rows(name, buf):
        x = L.scan(buf)
        try:
            by = library(tree_of(buf, x))
        except T.TreeError:
            by = None
        return [{"file": name, "block_index": b.index, "status": L.checksum_status(buf, b, by)} for b in x.blocks]

    return _mapped(df, "file string, block_index int, status string", _safe(rows))


def find_array(root: T.Node | None, path: str) -> A.Array:
    from treeblock.plans.paths import Path

    node = root
    for step in Path.parse(path).steps:
        node = A.deref(node) if node is not None else None
        if node is None:
            break
        if node.kind == "mapping":
            node = next((v for k, v in node.entries if T.key_text(k) == (step.key if step.key is not None else str(step.index))), None)
        elif node.kind == "sequence" and step.index is not None and -len(node.entries) <= step.index < len(node.entries):
            node = node.entries[step.index]
        else:
            node = None
    if node is None:
        raise FormatError("NotFound", path)
    return A.parse(node)


def block_bytes(buf, found: L.Layout, a: A.Array, external: Callable[[str], bytes] | None = None) -> bytes:
    if a.source_kind == "external":
        uri = A.safe_relative(a.source)
        if external is None:
            raise FormatError("InvalidArgument", "no folder to look for an external source in")
        other = external(uri)
        return L.data_of(other, L.scan(other).blocks[0])
    at = len(found.blocks) - 1 if a.source_kind == "last" else a.source
    if not 0 <= at < len(found.blocks):
        raise FormatError("InvalidArgument", f"no block {at}")
    return L.data_of(buf, found.blocks[at])


def element_batches(name: str, a: A.Array, data: bytes | None, first: int = 0, stop: int | None = None, **layout) -> Iterator[pa.RecordBatch]:
    """file, i0, ..., value of an array's elements with i0 in first..stop, in row-major order."""
    if a.source_kind == "inline":
        flat, shape = A.decode_inline(a), list(a.shape)
        stop = shape[0] if stop is None else min(stop, shape[0])
        width = int(np.prod(shape[1:], dtype=np.int64))
        parts: Iterator = iter([(first, flat[first * width : stop * width])])
        inner = shape[1:]
    else:
        view = A.view(a, data, **layout)
        ucs4 = isinstance(a.datatype, tuple) and a.datatype[0] == "ucs4"
        shape = list(view.shape[:-1] if ucs4 else view.shape)
        if not shape:
            view, shape = view[None], [1]
        inner = shape[1:]
        stop = shape[0] if stop is None else min(stop, shape[0])
        width = max(1, int(np.prod(inner, dtype=np.int64)))
        step = max(1, BATCH // width)
        parts = ((i, A.values(view[i : min(i + step, stop)], a.datatype)) for i in range(first, stop, step))
    width = max(1, int(np.prod(inner, dtype=np.int64)))
    kind = _arrow_type(a.datatype)
    for begin, flat in parts:
        n = len(flat)
        at = np.arange(n, dtype=np.int64) + begin * width
        cols: dict = {"file": pa.array([name] * n, pa.string()) if n < 64 else pa.DictionaryArray.from_arrays(np.zeros(n, np.int32), pa.array([name])).cast(pa.string())}
        size = width
        for k, dim in enumerate([shape[0], *inner]):
            cols[f"i{k}"] = pa.array(at // size % max(dim, 1) if k else at // size)
            size //= inner[k] if k < len(inner) and inner[k] else 1
        cols["value"] = _arrow_values(flat, a.datatype, kind)
        yield pa.RecordBatch.from_pydict(cols)


def _arrow_type(datatype) -> pa.DataType:
    if isinstance(datatype, tuple):
        return pa.string()
    if isinstance(datatype, list):
        nest = lambda f: pa.list_(_arrow_type(f.datatype)) if f.shape else _arrow_type(f.datatype)
        return pa.struct([(f.name, nest(f)) for f in datatype])
    half = {"complex64": pa.float32(), "complex128": pa.float64()}.get(datatype)
    if half is not None:
        return pa.struct([("re", half), ("im", half)])
    signed = {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "float": pa.float32(), "double": pa.float64(), "boolean": pa.bool_(), "decimal(20,0)": pa.decimal128(20, 0)}
    return signed[A.SPARK[datatype]]


def _arrow_values(flat, datatype, kind: pa.DataType) -> pa.Array:
    if isinstance(datatype, str) and isinstance(flat, np.ndarray):
        if datatype == "uint64":
            return pa.array(flat).cast(pa.decimal128(20, 0))
        if datatype.startswith("complex"):
            return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat.real)), pa.array(np.ascontiguousarray(flat.imag))], ["re", "im"])
        return pa.array(flat).cast(kind)
    return pa.array(list(flat), kind)


def read_array(df: DataFrame, path: str, datatype, ndim: int, offset: int | None = None, strides: list[int] | None = None) -> DataFrame:
    """Elements (file, i0, ..., value) of the array at a path of every file. All are of one datatype and number of axes;
    files that lack the path have no rows. offset and strides override the tree's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                if content.is_valid:
                    buf = content.as_py()
                    found = L.scan(buf)
                    try:
                        a = find_array(tree_of(buf, found), path)
                    except FormatError as e:
                        if e.code == "NotFound":
                            continue
                        raise
                    if a.datatype != datatype or len(a.shape) != ndim:
                        raise FormatError("TypeMismatch", f"{path} of {name.as_py()} is {a.datatype} of {len(a.shape)} axes")
                    yield from element_batches(name.as_py(), a, None if a.source_kind == "inline" else block_bytes(buf, found, a), offset=offset, strides=strides)

    index = ", ".join(f"i{k} long" for k in range(max(ndim, 1)))
    return df.select("file", "content").mapInArrow(run, f"file string, {index}, value {A.spark_type(datatype)}")


def inlined(df: DataFrame) -> DataFrame:
    """file, tree (YAML text), skipped: trees whose arrays over blocks are written out in place; skipped names the paths
    that could not be."""

    def rows(name, buf):
        found = L.scan(buf)
        root, skipped = tree_of(buf, found), []
        for path, node in list(paths(root)):
            if A.is_array(node) and A.get(node, "source") is not None:
                try:
                    a = A.parse(node)
                    view = A.view(a, block_bytes(buf, found, a))
                    flat = A.values(view, a.datatype)
                    flat = flat.tolist() if isinstance(flat, np.ndarray) else flat
                    shape = A.resolved_shape(a, len(block_bytes(buf, found, a)))
                except (FormatError, ValueError):
                    skipped.append(path)
                    continue
                for n in reversed(shape[1:]):
                    flat = [flat[i : i + n] for i in range(0, len(flat), n)] if n else []
                gone = ("source", "byteorder", "offset", "strides", "data", "shape")
                node.entries = [(k, v) for k, v in node.entries if k.text not in gone]
                node.entries += [(T.string("shape"), T.of_value(shape)), (T.string("data"), T.of_value(_spelled(flat)))]
        return [{"file": name, "tree": None if root is None else T.emit(root), "skipped": skipped}]

    return _mapped(df, "file string, tree string, skipped array<string>", _safe(rows))


def _spelled(x):
    if isinstance(x, list):
        return [_spelled(v) for v in x]
    return repr(x).replace("j", "j") if isinstance(x, complex) else x


def recompressed(df: DataFrame, codec: str) -> DataFrame:
    """file, content: containers with every block stored by another codec; the tree stays byte for byte."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, out = batch.column(0).to_pylist(), []
            for content in batch.column(1):
                buf = content.as_py()
                x = L.scan(buf)
                tree = None if x.tree_start is None else bytes(buf[x.tree_start : x.tree_end]).decode()
                pending = [L.Pending(L.data_of(buf, b), "" if b.streamed else codec, streamed=b.streamed) for b in x.blocks]
                out.append(L.pack(tree, pending, comments=tuple(x.comments), format_version=x.format_version, standard_version=x.standard_version or L.STANDARD_VERSION))
            yield pa.RecordBatch.from_pydict({"file": pa.array(names, pa.string()), "content": pa.array(out, pa.binary())})

    return df.select("file", "content").mapInArrow(run, "file string, content binary")


def pack_rows(df: DataFrame, file: str, row: str, column: str, datatype: str = "float32", codec: str = "", name: str = "data", byteorder: str = "little") -> DataFrame:
    """file, content: one container for each value of file, with one 2-d array of its rows (in the order of row) of an
    array column. Gathers a file's rows in one task, as one file is written by one task."""

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("row").to_numpy(), kind="stable")
        lists = table.column("values").combine_chunks().take(pa.array(order))
        width = len(lists[0]) if len(lists) else 0
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        dtype = A.numpy_dtype(datatype, byteorder)
        data = flat.astype(dtype).tobytes()
        root = T.of_value({"asdf_library": {"name": "treeblock", "version": "0.1.0"}})
        root.entries.append((T.string(name), A.describe(0, [len(lists), width], datatype, byteorder)))
        content = L.pack(T.emit(root), [L.Pending(data, codec)])
        return pa.table({"file": pa.array([table.column("file")[0].as_py()], pa.string()), "content": pa.array([content], pa.binary())})

    rows = df.select(F.col(file).cast("string").alias("file"), F.col(row).alias("row"), F.col(column).alias("values"))
    return rows.groupBy("file").applyInArrow(run, "file string, content binary")


def open_local(path: str):
    """A memory map of a local file, or its bytes where it is empty."""
    with open(path, "rb") as f:
        try:
            return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        except ValueError:
            return b""
