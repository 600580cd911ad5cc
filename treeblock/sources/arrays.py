"""Arrays described in a tree: metadata, decoding to numpy, and description of new ones. A kernel of executors."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import PurePosixPath

import numpy as np

from treeblock.sources.codecs import FormatError
from treeblock.sources.treetext import Node, of_value, split_tag

#: Element types by numpy code, name of the array tag.
CODES = {"int8": "i1", "int16": "i2", "int32": "i4", "int64": "i8", "uint8": "u1", "uint16": "u2", "uint32": "u4", "uint64": "u8", "float16": "f2", "float32": "f4", "float64": "f8", "complex64": "c8", "complex128": "c16", "bool8": "u1"}
TAG = "core/ndarray"
#: Spark types of decoded elements.
SPARK = {"int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "uint8": "smallint", "uint16": "int", "uint32": "bigint", "uint64": "decimal(20,0)", "float16": "float", "float32": "float", "float64": "double", "bool8": "boolean", "complex64": "struct<re:float,im:float>", "complex128": "struct<re:double,im:double>"}
#: Elements that an inline array may nest and hold.
MAX_DEPTH = 64


@dataclass
class Field:
    name: str
    datatype: str | tuple | list
    byteorder: str | None = None
    shape: list[int] = field(default_factory=list)


@dataclass
class Array:
    source_kind: str  # block, last, external, inline
    source: int | str | Node | None
    shape: list[int | None]
    datatype: str | tuple | list  # a name, (kind, length), or fields
    byteorder: str
    offset: int = 0
    strides: list[int] | None = None
    mask: object = None


def deref(node: Node) -> Node:
    seen = set()
    while node.kind == "alias" and id(node) not in seen:
        seen.add(id(node))
        node = node.target
    return node


def get(node: Node, key: str) -> Node | None:
    node = deref(node)
    if node.kind != "mapping":
        return None
    return next((deref(v) for k, v in node.entries if k.text == key), None)


def plain(node: Node | None):
    """Python value of a node, scalars as text."""
    if node is None:
        return None
    node = deref(node)
    if node.kind == "scalar":
        return node.text
    if node.kind == "sequence":
        return [plain(x) for x in node.entries]
    return {k.text: plain(v) for k, v in node.entries}


def parse_datatype(node: Node) -> str | tuple | list:
    node = deref(node)
    if node.kind == "scalar":
        if node.text not in CODES:
            raise FormatError("InvalidArgument", f"unknown datatype {node.text!r}")
        return node.text
    parts = [deref(x) for x in node.entries] if node.kind == "sequence" else []
    if len(parts) == 2 and all(p.kind == "scalar" for p in parts) and parts[0].text in ("ascii", "ucs4"):
        return (parts[0].text, int(parts[1].text))
    if not parts:
        raise FormatError("InvalidArgument", "a datatype is a name, a kind with a length, or fields")
    out = []
    for i, p in enumerate(parts):
        if p.kind == "mapping":
            shape = [int(x) for x in plain(get(p, "shape")) or []]
            out.append(Field(plain(get(p, "name")) or f"f{i}", parse_datatype(get(p, "datatype")), plain(get(p, "byteorder")), shape))
        else:
            out.append(Field(f"f{i}", parse_datatype(p)))
    return out


def numpy_dtype(datatype, byteorder: str) -> np.dtype:
    order = ">" if byteorder == "big" else "<"
    if isinstance(datatype, str):
        return np.dtype(order + CODES[datatype])
    if isinstance(datatype, tuple):
        kind, n = datatype
        return np.dtype(f"S{n}") if kind == "ascii" else np.dtype((np.dtype(order + "u4"), (n,)))
    return np.dtype([(f.name, numpy_dtype(f.datatype, f.byteorder or byteorder), tuple(f.shape)) for f in datatype])


def inline_shape(node: Node) -> list[int]:
    out, node = [], deref(node)
    while node.kind == "sequence":
        if len(out) >= MAX_DEPTH:
            raise FormatError("OverLimit", "an inline array nests too deep")
        out.append(len(node.entries))
        if not node.entries:
            break
        node = deref(node.entries[0])
    return out


def inline_values(node: Node, shape: list[int]) -> list[Node]:
    out = [deref(node)]
    for n in shape:
        if any(x.kind != "sequence" or len(x.entries) != n for x in out):
            raise FormatError("InvalidArgument", "an inline array is ragged")
        out = [deref(c) for x in out for c in x.entries]
    return out


def infer(values: list[str | None]) -> str:
    """Element type of inline scalars: float64 with any float, bool8 for booleans, the narrowest integer; as the whole
    for integers that are all zero, bool8."""
    from treeblock.sources.scalars import number

    found = [number(v) for v in values if v is not None]
    if any(isinstance(x, str) for x in found):
        return "unknown"
    if any(isinstance(x, float) for x in found):
        return "float64"
    if all(isinstance(x, bool) for x in found) or not any(found):
        return "bool8"
    lo, hi = min(map(int, found)), max(map(int, found))
    for name, bits in (("int8", 8), ("int16", 16), ("int32", 32), ("int64", 64)):
        if lo < 0 and -(1 << (bits - 1)) <= lo and hi < 1 << (bits - 1):
            return name
        if lo >= 0 and hi < 1 << bits:
            return "u" + name
    return "unknown"


def parse(node: Node) -> Array:
    """The array that a node describes: a mapping with source or data, or a nested sequence alone."""
    node = deref(node)
    source = get(node, "source")
    data = node if node.kind == "sequence" else get(node, "data")
    if node.kind not in ("sequence", "mapping") or source is None and data is None:
        raise FormatError("InvalidArgument", "an array has a source or data")
    order = plain(get(node, "byteorder")) or ("big" if source is None else "little")
    kind = get(node, "datatype")
    shape_node = get(node, "shape")
    shape = [None if x == "*" else int(x) for x in plain(shape_node)] if shape_node is not None else None
    if source is not None:
        if kind is None or shape is None:
            raise FormatError("InvalidArgument", "an array with a source has a datatype and a shape")
        text = plain(source)
        number = int(text) if isinstance(text, str) and text.lstrip("-").isdigit() else None
        if number is not None and number < -1:
            raise FormatError("InvalidArgument", f"no source {number}")
        which = ("last", -1) if number == -1 else ("block", number) if number is not None else ("external", text)
        strides = get(node, "strides")
        return Array(*which, shape, parse_datatype(kind), order, int(plain(get(node, "offset")) or 0), [int(x) for x in plain(strides)] if strides is not None else None, plain(get(node, "mask")))
    found = inline_shape(data)
    if any(x is None for x in shape or []):
        raise FormatError("InvalidArgument", "an inline array has a whole shape")
    datatype = parse_datatype(kind) if kind is not None else infer([x.text for x in inline_values(data, found)])
    return Array("inline", data, shape if shape is not None else found, datatype, order, 0, None, plain(get(node, "mask")))


def resolved_shape(array: Array, nbytes: int) -> list[int]:
    """The shape, a leading * taken as what the bytes hold: whole rows only."""
    if None not in array.shape:
        return array.shape
    rest = array.shape[1:]
    if array.shape[0] is not None or None in rest:
        raise FormatError("InvalidArgument", "only the first axis can be *")
    row = numpy_dtype(array.datatype, array.byteorder).itemsize
    for n in rest:
        row *= n
    if not row:
        raise FormatError("OverLimit", "rows have no width")
    return [max(0, nbytes - array.offset) // row, *rest]


def view(array: Array, data: bytes, offset: int | None = None, strides: list[int] | None = None) -> np.ndarray:
    """The array over its block's bytes, without a copy. All checks come before any allocation."""
    dtype = numpy_dtype(array.datatype, array.byteorder)
    shape = resolved_shape(array, len(data))
    offset = array.offset if offset is None else offset
    strides = array.strides if strides is None else strides
    total = 1
    for n in shape:
        total *= n
    if not dtype.itemsize:
        raise FormatError("OverLimit", "elements have no width")
    if total > 1 << 62 or total * dtype.itemsize > len(data):
        raise FormatError("OverLimit", f"{total} elements over {len(data)} bytes")
    if not total:
        return np.zeros(shape, dtype)
    if strides is None:
        strides, step = [], dtype.itemsize
        for n in reversed(shape):
            strides.insert(0, step)
            step *= n
    if len(strides) != len(shape):
        raise FormatError("InvalidArgument", "a stride for each axis is needed")
    low = offset + sum((n - 1) * s for n, s in zip(shape, strides, strict=True) if s < 0)
    high = offset + sum((n - 1) * s for n, s in zip(shape, strides, strict=True) if s > 0) + dtype.itemsize
    if low < 0 or high > len(data):
        raise FormatError("UnexpectedEof", f"bytes {low} to {high} of {len(data)}")
    if dtype.subdtype is not None:  # code points of a string are an axis of their own
        base, inner = dtype.subdtype
        return np.ndarray([*shape, *inner], base, data, offset, [*strides, base.itemsize])
    return np.ndarray(shape, dtype, data, offset, strides)


def values(found: np.ndarray, datatype) -> np.ndarray | list:
    """Elements in row-major order, in native byte order; strings and records as Python objects."""
    if isinstance(datatype, str):
        flat = np.ascontiguousarray(found).reshape(-1)
        return flat != 0 if datatype == "bool8" else flat.astype(flat.dtype.newbyteorder("="))
    if isinstance(datatype, tuple):
        if datatype[0] == "ascii":
            return [bytes(x).split(b"\0")[0].decode("utf-8", "replace") for x in found.reshape(-1)]
        out = []
        for row in found.reshape(-1, datatype[1]):
            points = row.tolist()
            points = points[: points.index(0)] if 0 in points else points
            out.append("".join(chr(p) if p < 0x110000 and not 0xD800 <= p < 0xE000 else "�" for p in points))
        return out
    columns = {f.name: _field(found[f.name], f) for f in datatype}
    n = found.size
    return [{k: v[i] for k, v in columns.items()} for i in range(n)]


def _field(found: np.ndarray, f: Field) -> list:
    """Of a record field, a value for each element; sub-arrays as lists."""
    width = 1
    for n in f.shape:
        width *= n
    flat = values(found, f.datatype)
    flat = flat.tolist() if isinstance(flat, np.ndarray) else flat
    flat = [{"re": x.real, "im": x.imag} if isinstance(x, complex) else x for x in flat]
    return [flat[i : i + width] for i in range(0, len(flat), width)] if f.shape else flat


def decode_inline(array: Array) -> list:
    """Elements of an inline array; null is the type's zero."""
    from treeblock.sources.scalars import element

    nodes = inline_values(array.source, [n for n in array.shape])
    return [element(x.text, x.style, array.datatype) for x in nodes]


def safe_relative(uri: str) -> str:
    """The path of an external source, which stays below its file's folder."""
    path = PurePosixPath(uri.split("#")[0])
    if "://" in uri or ":" in uri.split("/")[0] or path.is_absolute() or ".." in path.parts or not path.parts:
        raise FormatError("InvalidArgument", f"source {uri!r} leaves its folder")
    return str(path)


def describe(source: int, shape: list[int], datatype: str, byteorder: str = "little") -> Node:
    """Tree node of a new array over a block."""
    from treeblock.functions.textfn import STANDARD_PREFIX

    node = of_value({"source": source, "datatype": datatype, "byteorder": byteorder, "shape": shape})
    node.tag = f"{STANDARD_PREFIX}{TAG}-1.1.0"
    return node


def is_array(node: Node) -> bool:
    return node.tag is not None and split_tag(node.tag)[0] == TAG


def spark_type(datatype) -> str:
    if isinstance(datatype, str):
        return SPARK[datatype]
    if isinstance(datatype, tuple):
        return "string"
    one = lambda f: ("array<" * len(f.shape[:1])) + spark_type(f.datatype) + (">" * len(f.shape[:1]))
    return "struct<" + ",".join(f"`{f.name}`:{one(f)}" for f in datatype) + ">"
