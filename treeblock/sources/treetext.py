"""Trees in memory: from YAML events to nodes and back. A kernel of executors; nothing here knows Spark."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import yaml

from treeblock.functions.textfn import STANDARD_PREFIX, YAML_PREFIX
from treeblock.plans.paths import Path, escape

LOADER = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
DUMPER = getattr(yaml, "CSafeDumper", yaml.SafeDumper)
#: Spellings that a reader takes for something other than a string.
PLAIN_UNSAFE = re.compile(
    r"^(|~|null|Null|NULL|true|True|TRUE|false|False|FALSE|yes|Yes|YES|no|No|NO|on|On|ON|off|Off|OFF|y|Y|n|N|<<|=|[-+]?(\.[0-9]|[0-9]).*|[-+]?\.(inf|Inf|INF)|\.(nan|NaN|NAN))$", re.S
)


class TreeError(ValueError):
    """Text that is no tree."""


@dataclass(eq=False)
class Node:
    kind: str
    tag: str | None = None
    style: str | None = None
    text: str | None = None
    anchor: str | None = None
    entries: list = field(default_factory=list)  # of a sequence: nodes; of a mapping: (key node, node)
    target: Node | None = None  # of an alias

    def children(self) -> list[tuple[str | None, Node]]:
        return [(None, x) for x in self.entries] if self.kind == "sequence" else [(key_text(k), v) for k, v in self.entries]


STYLES = {None: "plain", "": "plain", "'": "single", '"': "double", "|": "literal", ">": "folded"}
UNSTYLES = {"plain": None, "single": "'", "double": '"', "literal": "|", "folded": ">"}


def key_text(node: Node) -> str:
    return node.text if node.kind == "scalar" and node.text is not None else emit(node, False).strip()


def parse(text: str | bytes) -> Node | None:
    """The first document's root; None where there is none."""
    anchors: dict[str, Node] = {}
    stack: list[Node] = []
    keys: list[Node | None] = []
    root: Node | None = None

    def place(node: Node) -> None:
        nonlocal root
        if not stack:
            root = node
        elif stack[-1].kind == "sequence":
            stack[-1].entries.append(node)
        elif keys[-1] is None:
            keys[-1] = node
        else:
            stack[-1].entries.append((keys[-1], node))
            keys[-1] = None

    try:
        for e in yaml.parse(text, Loader=LOADER):
            if isinstance(e, yaml.ScalarEvent):
                tag = e.tag if e.tag not in (None, "!") else None
                node = Node("scalar", tag, STYLES.get(e.style, "plain"), e.value, e.anchor)
                place(node)
            elif isinstance(e, yaml.AliasEvent):
                if e.anchor not in anchors:
                    raise TreeError(f"alias {e.anchor} before its anchor")
                place(Node("alias", target=anchors[e.anchor]))
                continue
            elif isinstance(e, (yaml.SequenceStartEvent, yaml.MappingStartEvent)):
                kind = "sequence" if isinstance(e, yaml.SequenceStartEvent) else "mapping"
                node = Node(kind, e.tag if e.tag not in (None, "!") else None, "flow" if e.flow_style else "block", None, e.anchor)
                place(node)
                stack.append(node)
                keys.append(None)
            elif isinstance(e, (yaml.SequenceEndEvent, yaml.MappingEndEvent)):
                stack.pop()
                keys.pop()
                continue
            elif isinstance(e, yaml.DocumentEndEvent):
                return root
            else:
                continue
            if e.anchor:
                anchors[e.anchor] = node
    except (yaml.YAMLError, UnicodeDecodeError, RecursionError) as x:
        raise TreeError(str(x)) from None
    return root


def split_tag(tag: str | None) -> tuple[str | None, str | None]:
    """Name and version of a tag: after its known prefix, at the last hyphen before a digit."""
    if tag is None:
        return None, None
    for prefix in (STANDARD_PREFIX, YAML_PREFIX):
        if tag.startswith(prefix):
            tag = tag[len(prefix) :]
            break
    m = re.fullmatch(r"(?s)(.*)-([0-9][^-]*)", tag)
    return (m[1], m[2]) if m else (tag, None)


def rows(file: str, root: Node | None) -> list[dict]:
    """Rows of the nodes frame, in parse order."""
    if root is None:
        return []
    out: list[dict] = []
    number: dict[int, int] = {}
    todo = [(root, None, 0, None, "/", 0)]
    pending = []
    while todo:
        node, parent, place, key, path, depth = todo.pop()
        number[id(node)] = own = len(out)
        name, version = split_tag(node.tag)
        below = node.children() if node.kind in ("sequence", "mapping") else []
        out.append(
            {"file": file, "node_id": own, "parent_id": parent, "ord": place, "key": key, "node_path": path, "depth": depth, "bfs": 0, "kind": node.kind, "style": node.style, "tag": node.tag}
            | {"tag_name": name, "tag_version": version, "anchor": node.anchor, "alias_of": None, "text": node.text, "size": len(below)}
        )
        if node.kind == "alias":
            pending.append((own, node.target))
        base = path if path != "/" else ""
        todo += [(c, own, i, k, f"{base}/{escape(k) if k is not None else i}", depth + 1) for i, (k, c) in reversed(list(enumerate(below)))]
    for own, target in pending:
        out[own]["alias_of"] = number.get(id(target))
    # breadth first: level by level, parents in order
    level, seen = [0], 0
    kids: dict[int, list[int]] = {}
    for r in out:
        if r["parent_id"] is not None:
            kids.setdefault(r["parent_id"], []).append(r["node_id"])
    while level:
        for x in level:
            out[x]["bfs"] = seen
            seen += 1
        level = [c for x in level for c in kids.get(x, [])]
    return out


def from_rows(table: list[dict]) -> Node | None:
    """The tree of a file's rows, as far as it hangs on the root; children in the order of ord."""
    nodes = {r["node_id"]: Node(r["kind"], r["tag"], r["style"], r["text"], r["anchor"]) for r in table}
    root = None
    for r in sorted(table, key=lambda r: (r["depth"], r["ord"], r["node_id"])):
        node = nodes[r["node_id"]]
        if r["alias_of"] is not None:
            node.target = nodes.get(r["alias_of"])
        parent = nodes.get(r["parent_id"])
        if r["parent_id"] is None:
            root = node
        elif parent is not None:
            parent.entries.append((Node("scalar", None, "plain", r["key"]), node) if parent.kind == "mapping" else node)
    return root


def of_value(value) -> Node:
    """A node for a Python value."""
    if isinstance(value, Node):
        return value
    if isinstance(value, dict):
        return Node("mapping", style="block", entries=[(string(str(k)), of_value(v)) for k, v in value.items()])
    if isinstance(value, (list, tuple)):
        return Node("sequence", style="flow" if all(not isinstance(v, (dict, list, tuple)) for v in value) else "block", entries=[of_value(v) for v in value])
    if value is None:
        return Node("scalar", style="plain", text="null")
    if isinstance(value, bool):
        return Node("scalar", style="plain", text="true" if value else "false")
    if isinstance(value, int):
        return Node("scalar", style="plain", text=str(value))
    if isinstance(value, float):
        return Node("scalar", style="plain", text=float_text(value))
    return string(str(value))


def string(text: str) -> Node:
    return Node("scalar", style="single" if PLAIN_UNSAFE.match(text) else "plain", text=text)


def float_text(x: float) -> str:
    """Shortest text that reads back, always with a point."""
    if x != x:
        return ".nan"
    if x in (float("inf"), float("-inf")):
        return ".inf" if x > 0 else "-.inf"
    out = repr(x)
    return out if "." in out or "e" not in out else out.replace("e", ".0e", 1)


def insert(root: Node, path: Path, value) -> Node:
    """Put a value at a path; returns the root."""
    new = of_value(value)
    if not path.steps:
        root.__dict__.update(new.__dict__)
        return root
    node = root
    for i, step in enumerate(path.steps):
        while node.kind == "alias":
            node = node.target
        last = i == len(path.steps) - 1
        if node.kind == "sequence" and step.index is not None:
            at = step.index if step.index >= 0 else len(node.entries) + step.index
            if not 0 <= at <= len(node.entries):
                raise IndexError(f"no element {step.index} in a sequence of {len(node.entries)}")
            if at == len(node.entries):
                node.entries.append(new if last else Node("mapping", style="block"))
            elif last:
                node.entries[at] = new
            node = node.entries[at]
            continue
        if node.kind != "mapping":
            node.kind, node.entries, node.text, node.tag, node.style = "mapping", [], None, None, "block"
        key = step.key if step.key is not None else str(step.index)
        found = next((j for j, (k, _) in enumerate(node.entries) if key_text(k) == key), None)
        if found is None:
            node.entries.append((string(key), new if last else Node("mapping", style="block")))
            found = len(node.entries) - 1
        elif last:
            node.entries[found] = (node.entries[found][0], new)
        node = node.entries[found][1]
    return root


def emit(root: Node, directives: bool = True) -> str:
    """YAML text of a tree; anchors are numbered in the order of the tree. A cycle cannot be written out."""
    named: dict[int, str] = {}
    todo, seen = [root], set()
    while todo:
        node = todo.pop()
        if node.kind == "alias":
            named.setdefault(id(node.target), "")
        if id(node) not in seen:
            seen.add(id(node))
            todo += [c for _, c in node.children()] if node.kind in ("sequence", "mapping") else []
    events: list = [yaml.StreamStartEvent(), yaml.DocumentStartEvent(explicit=directives, version=(1, 1) if directives else None, tags={"!": STANDARD_PREFIX} if directives else None)]
    count = 0

    def add(node: Node, open_: frozenset) -> None:
        nonlocal count
        if node.kind == "alias":
            if id(node.target) not in named or not named[id(node.target)]:
                raise TreeError("an alias stands before its anchor or within it")
            events.append(yaml.AliasEvent(named[id(node.target)]))
            return
        anchor = None
        if id(node) in named:
            count += 1
            anchor = named[id(node)] = f"id{count:03d}"
        if node.kind == "scalar":
            plain = node.style in (None, "plain")
            events.append(yaml.ScalarEvent(anchor, node.tag, (plain and node.tag is None, not plain and node.tag is None), node.text or "", UNSTYLES.get(node.style)))
        elif node.kind == "sequence":
            events.append(yaml.SequenceStartEvent(anchor, node.tag, node.tag is None, flow_style=node.style == "flow"))
            for x in node.entries:
                add(x, open_)
            events.append(yaml.SequenceEndEvent())
        else:
            events.append(yaml.MappingStartEvent(anchor, node.tag, node.tag is None, flow_style=node.style == "flow"))
            for k, v in node.entries:
                add(k, open_)
                add(v, open_)
            events.append(yaml.MappingEndEvent())

    add(root, frozenset())
    events += [yaml.DocumentEndEvent(explicit=directives), yaml.StreamEndEvent()]
    return yaml.emit(events, Dumper=DUMPER, allow_unicode=True, width=10_000)
