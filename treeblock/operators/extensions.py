"""Typed values by tag: a registry of extensions, and the built-in ones.

An extension has the tags that it reads, the first of which it writes, a Spark type, decode (a node to a value of that
type) and encode (a value to a node). The first extension registered for a tag counts; a tag has its version, its tag:
scheme may be missing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from treeblock.functions.textfn import STANDARD_PREFIX
from treeblock.sources import arrays as A
from treeblock.sources import treetext as T


@dataclass(frozen=True)
class Extension:
    tags: tuple[str, ...]
    type: str
    decode: Callable[[T.Node], object]
    encode: Callable[[object], T.Node] | None = None


_REGISTRY: list[Extension] = []


def register(extension: Extension) -> None:
    if extension not in _REGISTRY:
        _REGISTRY.append(extension)


def _bare(tag: str) -> str:
    return tag.removeprefix("tag:")


def find(tag: str) -> Extension | None:
    return next((x for x in _REGISTRY if any(_bare(t) == _bare(tag) for t in x.tags)), None)


def extension(tags: list[str], type: str, encode=None):
    """Decorator of a decode function."""

    def add(fn):
        register(Extension(tuple(tags), type, fn, encode))
        return fn

    return add


def decoded(nodes: DataFrame, tag: str, required: bool = True) -> DataFrame:
    """file, node_path, value, err of every node that has the tag, decoded on the executors. A node that does not decode
    has the error PARSE_FAILURE; with required, none are left out, else those."""
    found = find(tag)
    if found is None:
        raise KeyError(f"no extension reads {tag}")
    kinds = tuple(_bare(t) for t in found.tags)

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        by_path = {}
        root = T.from_rows(rows)
        from treeblock.sources.frames import paths

        for path, node in paths(root):
            if node.tag and _bare(node.tag) in kinds:
                try:
                    by_path[path] = (found.decode(node), "OK")
                except (ValueError, TypeError, KeyError, AttributeError):
                    by_path[path] = (None, "PARSE_FAILURE")
        keep = [(p, v, e) for p, (v, e) in by_path.items() if required or e == "OK"]
        return pa.table({"file": pa.array([rows[0]["file"]] * len(keep), pa.string()), "node_path": pa.array([p for p, *_ in keep], pa.string()), "value": pa.array([v for _, v, _ in keep], kind), "err": pa.array([e for *_, e in keep], pa.string())})

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    kind = to_arrow_type(StructType.fromDDL(f"x {found.type}")[0].dataType)
    return nodes.groupBy("file").applyInArrow(run, f"file string, node_path string, value {found.type}, err string")


def _text(node: T.Node, key: str, must: bool = False) -> str | None:
    found = A.plain(A.get(node, key))
    if must and not isinstance(found, str):
        raise ValueError(f"no {key}")
    return found if isinstance(found, str) else None


SOFTWARE = "struct<name:string,version:string,author:string,homepage:string>"
ENTRY = f"struct<description:string,time:string,software:array<{SOFTWARE}>>"
EXTENSION = f"struct<extension_class:string,package:{SOFTWARE}>"


@extension([f"{STANDARD_PREFIX}core/software-1.0.0"], SOFTWARE, lambda v: tagged(v, "core/software-1.0.0"))
def software(node: T.Node) -> dict:
    return {"name": _text(node, "name", True), "version": _text(node, "version", True), "author": _text(node, "author"), "homepage": _text(node, "homepage")}


def softwares(node: T.Node | None) -> list[dict]:
    """One or many; those that are no software are skipped."""
    out = []
    for x in ([] if node is None else node.entries if node.kind == "sequence" else [node]):
        try:
            out.append(software(A.deref(x)))
        except ValueError:
            continue
    return out


@extension([f"{STANDARD_PREFIX}core/history_entry-1.0.0"], ENTRY, lambda v: tagged(v, "core/history_entry-1.0.0"))
def history_entry(node: T.Node) -> dict:
    return {"description": _text(node, "description", True), "time": _text(node, "time"), "software": softwares(A.get(node, "software"))}


@extension([f"{STANDARD_PREFIX}core/extension_metadata-1.0.0"], EXTENSION, lambda v: tagged(v, "core/extension_metadata-1.0.0"))
def extension_metadata(node: T.Node) -> dict:
    package = A.get(node, "package") or A.get(node, "software")
    return {"extension_class": _text(node, "extension_class", True), "package": (softwares(package) or [None])[0]}


META = f"struct<library:{SOFTWARE},extensions:array<{EXTENSION}>,entries:array<{ENTRY}>>"


@extension([f"{STANDARD_PREFIX}core/asdf-1.1.0", f"{STANDARD_PREFIX}core/asdf-1.0.0"], META)
def meta(node: T.Node) -> dict:
    """Provenance of a file's root: history is a mapping of extensions and entries, or a list of entries alone."""
    history = A.get(node, "history")
    entries, extensions = (history, None) if history is not None and history.kind == "sequence" else (A.get(node, "history") and A.get(history, "entries"), history and A.get(history, "extensions"))

    def each(found, decode):
        out = []
        for x in found.entries if found is not None and found.kind == "sequence" else []:
            try:
                out.append(decode(A.deref(x)))
            except ValueError:
                continue
        return out

    return {"library": (softwares(A.get(node, "asdf_library")) or [None])[0], "extensions": each(extensions, extension_metadata), "entries": each(entries, history_entry)}


@extension([f"{STANDARD_PREFIX}core/datatype-1.0.0"], "string")
def datatype(node: T.Node) -> str:
    return A.spark_type(A.parse_datatype(node))


@extension([f"{STANDARD_PREFIX}core/ndarray-1.1.0", f"{STANDARD_PREFIX}core/ndarray-1.0.0"], "struct<source_kind:string,shape:array<bigint>,datatype:string,byteorder:string,offset:bigint,strides:array<bigint>>")
def ndarray(node: T.Node) -> dict:
    a = A.parse(node)
    return {"source_kind": a.source_kind, "shape": a.shape, "datatype": A.spark_type(a.datatype), "byteorder": a.byteorder, "offset": a.offset, "strides": a.strides}


@extension([f"{STANDARD_PREFIX}time/time-1.4.0", f"{STANDARD_PREFIX}time/time-1.3.0", f"{STANDARD_PREFIX}time/time-1.2.0", f"{STANDARD_PREFIX}time/time-1.1.0", f"{STANDARD_PREFIX}time/time-1.0.0"], "struct<value:string,format:string,base_format:string,scale:string,longitude:double,latitude:double,height:double>")
def time(node: T.Node) -> dict:
    """The parts of a time; timefn reads its value. A value alone has a format that its form tells."""
    import re

    from treeblock.functions import timefn
    from treeblock.sources.scalars import number

    node = A.deref(node)
    value = node if node.kind == "scalar" else A.get(node, "value")
    if value is None or value.kind != "scalar":
        raise ValueError("a time has a value")
    format_ = _text(node, "format") if node.kind == "mapping" else None
    is_string = value.style != "plain" or isinstance(number(value.text), str)
    if format_ is None:
        if not is_string:
            raise ValueError("a numeric time needs a format")
        format_ = next((n for n, p in timefn.SHAPES if re.match(p, value.text)), None)
    if format_ not in (*timefn.FORMATS, *timefn.OTHER):
        raise ValueError(f"unknown format {format_}")
    if format_ in ("jyear_str", "byear_str") and not (is_string and value.text[:1].lower() == format_[0]):
        raise ValueError(f"{format_} needs its letter")
    place = A.get(node, "location") if node.kind == "mapping" else None
    scale = _text(node, "scale") if node.kind == "mapping" else None
    at = lambda k: float(_text(place, k) or 0) if place is not None else 0.0
    return {"value": value.text, "format": format_, "base_format": _text(node, "base_format") if node.kind == "mapping" else None, "scale": scale if scale in timefn.SCALES else "utc", "longitude": at("longitude"), "latitude": at("latitude"), "height": at("height")}


def tagged(value: dict, tag: str) -> T.Node:
    node = T.of_value({k: v for k, v in value.items() if v is not None})
    node.tag = STANDARD_PREFIX + tag
    return node


def add_history(root: T.Node, description: str, software: list[dict] | None = None, time: str | None = None) -> T.Node:
    """Append a history entry to a file's root."""
    from treeblock.plans.paths import Path

    entry = tagged({"description": description, "time": time, "software": software}, "core/history_entry-1.0.0")
    history = A.get(root, "history")
    if history is not None and history.kind == "sequence":
        history.entries.append(entry)
        return root
    if history is None or A.get(history, "entries") is None:
        T.insert(root, Path.parse("history/entries"), [])
    A.get(A.get(root, "history"), "entries").entries.append(entry)
    return root
