"""python -m treeblock info|dd|events|verify-checksums FILE ..."""

from __future__ import annotations

import argparse
import sys

from treeblock.plans import render
from treeblock.sources import frames, layout


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="treeblock")
    sub = p.add_subparsers(dest="verb", required=True)
    info = sub.add_parser("info", help="the tree and the blocks")
    info.add_argument("--no-tree", action="store_true")
    info.add_argument("--blocks", action="store_true")
    dd = sub.add_parser("dd", help="a block's bytes")
    dd.add_argument("--block", type=int)
    dd.add_argument("--array", help="path of an array in the tree")
    dd.add_argument("--raw", action="store_true", help="as stored")
    dd.add_argument("--output", default="-")
    dd.add_argument("--chunk", type=int, default=1 << 20)
    sub.add_parser("events", help="the parser's events")
    sub.add_parser("verify-checksums", help="every block's checksum; fails if one is wrong")
    for s in sub.choices.values():
        s.add_argument("file")
    a = p.parse_args(argv)
    try:
        buf = frames.open_local(a.file)
        return {"info": _info, "dd": _dd, "events": _events, "verify-checksums": _verify}[a.verb](a, buf)
    except (ValueError, OSError) as x:
        print(f"treeblock: {a.file}: {x}", file=sys.stderr)
        return 1


def _info(a, buf) -> int:
    print(render.info(buf, not a.no_tree, a.blocks), end="")
    return 0


def _dd(a, buf) -> int:
    found = layout.scan(buf)
    at = a.block or 0
    if a.array is not None:
        array = frames.find_array(frames.tree_of(buf, found), a.array)
        if array.source_kind not in ("block", "last"):
            raise ValueError(f"{a.array} is not over a block of this file")
        at = array.source
    block = found.blocks[at]
    data = layout.raw_of(buf, block) if a.raw else layout.data_of(buf, block)
    out = sys.stdout.buffer if a.output == "-" else open(a.output, "wb")
    for i in range(0, len(data), max(1, a.chunk)):
        out.write(data[i : i + max(1, a.chunk)])
    out.flush()
    if out is not sys.stdout.buffer:
        out.close()
    return 0


def _events(a, buf) -> int:
    for e in frames.event_rows(a.file, buf):
        print(e["type"], *(f"{k}={v}" for k, v in e["details"]))
    return 0


def _verify(a, buf) -> int:
    found = layout.scan(buf)
    by = frames.library(frames.tree_of(buf, found))
    bad = 0
    for b in found.blocks:
        status = layout.checksum_status(buf, b, by)
        bad += status == "invalid"
        print(f"block {b.index}: {status}")
    return int(bad > 0)


if __name__ == "__main__":
    sys.exit(main())
