"""A container's tree and blocks as text, within bounds whatever the file."""

from __future__ import annotations

import re

from treeblock.functions.textfn import PREVIEW
from treeblock.sources import layout as L
from treeblock.sources import treetext as T

#: Bounds: depth, nodes shown for each node of the tree, characters, aliases of one node that are opened.
DEPTH, VISITS, SIZE, REPEATS = 256, 64, 8 << 20, 1024


def preview(text: str) -> str:
    line = re.sub(r"[\x00-\x1f\x7f]+", " ", text.strip("".join(map(chr, [*range(32), 127]))))
    return line if len(line) <= PREVIEW else line[:PREVIEW] + "..."


def label(node: T.Node) -> str:
    return node.tag or node.kind


def tree(root: T.Node | None) -> str:
    if root is None:
        return "(no tree)\n"
    total, todo, seen = 0, [root], set()
    while todo:
        node = todo.pop()
        if id(node) not in seen:
            seen.add(id(node))
            total += 1
            todo += [c for _, c in node.children()] if node.kind in ("sequence", "mapping") else []
    left, size, opened, out = VISITS * total, 0, {}, []

    def write(line: str) -> bool:
        nonlocal left, size
        left, size = left - 1, size + len(line)
        if left < 0 or size > SIZE:
            out.append("(...)\n")
            return False
        out.append(line)
        return True

    def show(name: str, node: T.Node, lead: str, branch: str, above: tuple) -> bool:
        if node.kind == "alias":
            target = node.target
            if target in above:
                return write(f"{branch}{name} (cycle)\n")
            opened[id(target)] = opened.get(id(target), 0) + 1
            if opened[id(target)] > REPEATS:
                return write(f"{branch}{name} (...)\n")
            node = target
        if node.kind == "scalar":
            return write(f"{branch}{name} ({label(node)}): {preview(node.text or '')}\n")
        below = node.children()
        if not write(f"{branch}{name} ({label(node)}), {len(below)} {'entries' if node.kind == 'mapping' else 'elements'}\n"):
            return False
        if len(above) >= DEPTH:
            return write(f"{lead}└─(...)\n")
        for i, (key, child) in enumerate(below):
            last = i == len(below) - 1
            if not show(key if key is not None else f"[{i}]", child, lead + ("  " if last else "│ "), lead + ("└─" if last else "├─"), (*above, node)):
                return False
        return True

    show("root", root, "", "", ())
    return "".join(out)


def block(b: L.Block) -> str:
    flags = f"{b.flags:#010x}" + (" (streamed)" if b.streamed else "")
    return f"block {b.index} at {b.header_pos}: flags {flags}, compression {b.compression or 'none'!r}, allocated {b.allocated_size}, used {b.used_size}, data {b.data_size}, md5 {b.checksum.hex()}\n"


def info(buf, with_tree: bool = True, with_blocks: bool = True) -> str:
    x = L.scan(buf)
    out = ""
    if with_tree:
        out += tree(None if x.tree_start is None else T.parse(bytes(buf[x.tree_start : x.tree_end])))
    if with_blocks:
        out += "".join(block(b) for b in x.blocks)
    return out
