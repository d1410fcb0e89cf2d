"""A line-oriented markup: parsed whole or in pieces, written, and turned into and from JSON, XML and Markdown tables.

    @type label [head|head] name:value      a node; deeper indentation makes it a child
      cell | cell                           a row, where the node has heads
      > text                                a line of text
      |#TAG>                                text as it is, up to the line |#TAG
      name: value                           a member whose value has blanks or is long

Parsing never fails: a line that is none of these is a line of text of the node it stands in, or of a node of its own.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from hashlib import blake2b
from typing import Any
from xml.sax.saxutils import escape, unescape

_HEAD = re.compile(r"^@([A-Za-z_][\w.-]*)(?: +(.*))?$", re.S)
_PAIR = re.compile(r'([A-Za-z_][\w.-]*):("(?:[^"\\]|\\.)*"(?= |$)|[^ ]*)')
_MEMBER = re.compile(r"^([A-Za-z_][\w.-]*): (.*)$", re.S)
_OPEN = re.compile(r"^\|#(\w+)>$")


@dataclass
class Node:
    type: str
    label: str = ""
    attrs: dict[str, Any] = field(default_factory=dict)
    heads: list[str] = field(default_factory=list)
    rows: list[list[str]] = field(default_factory=list)
    lines: list[str] = field(default_factory=list)
    children: list[Node] = field(default_factory=list)

    @property
    def text(self) -> str:
        return "\n".join(self.lines)


def _value(text: str) -> Any:
    """true, false, null and numbers as such, quoted texts without their quotes, anything else as it is."""
    try:
        v = json.loads(text)
        return v if not isinstance(v, (dict, list)) and (isinstance(v, str) or json.dumps(v) == text) else text
    except (ValueError, RecursionError):
        return text


def _head(kind: str, rest: str) -> Node:
    node, rest = Node(kind), rest or ""
    if m := re.search(r"(?:^| )\[([^\]]*\|[^\]]*|[A-Za-z_]\w*)\](?= |$)", rest):
        node.heads, rest = [h.strip() for h in m[1].split("|")], rest[: m.start()] + " " + rest[m.end() :]
    first = _PAIR.search(rest)
    while first and first.start() and rest[first.start() - 1] != " ":
        first = _PAIR.search(rest, first.end())
    node.label = (rest[: first.start()] if first else rest).strip(" ")
    for m in _PAIR.finditer(rest, first.start() if first else len(rest)):
        node.attrs[m[1]] = _value(m[2])
    return node


class Parser:
    """Nodes of the top level, each when it is complete: feed pieces, then flush."""

    def __init__(self) -> None:
        self.rest, self.path, self.tag = "", [], ""  # path: (indentation, node) from the top

    def _line(self, raw: str) -> Iterator[Node]:
        indent, line = len(raw) - len(raw.lstrip(" ")), raw.strip(" ")
        if self.tag:
            if line == f"|#{self.tag}":
                self.tag = ""
            elif self.path:
                self.path[-1][1].lines.append(raw)
            return
        if m := _HEAD.match(line):
            node = _head(m[1], m[2])
            while self.path and self.path[-1][0] >= indent:
                done = self.path.pop()[1]
                if not self.path:
                    yield done
            if self.path:
                self.path[-1][1].children.append(node)
            self.path.append((indent, node))
            return
        if not self.path:
            if line:
                yield Node("text", lines=[raw])
            return
        while len(self.path) > 1 and line and self.path[-1][0] >= indent:
            self.path.pop()
        node = self.path[-1][1]
        if m := _OPEN.match(line):
            self.tag = m[1]
        elif line[:2] in ("> ", ">"):
            node.lines.append(line[2:])
        elif line.startswith("|> "):
            node.lines.append(line[3:])
        elif node.heads and " | " in line or node.heads and len(node.heads) == 1 and line:
            node.rows.append([c.strip(" ") for c in line.split(" | ")] if len(node.heads) > 1 else [line])
        elif m := _MEMBER.match(line):
            node.attrs[m[1]] = _value(m[2])
        elif line:
            node.lines.append(line)

    def feed(self, piece: str) -> list[Node]:
        *lines, self.rest = (self.rest + piece).split("\n")
        return [n for line in lines for n in self._line(line)]

    def flush(self) -> list[Node]:
        out = list(self._line(self.rest)) if self.rest else []
        if self.path:
            out.append(self.path[0][1])
        self.rest, self.path, self.tag = "", [], ""
        return out


def parse(text: str | None) -> list[Node]:
    p = Parser()
    return p.feed(text or "") + p.flush()


def _plain(v: Any) -> str:
    text = v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)
    if isinstance(v, str) and (_value(text) != text or not text or text.startswith('"') or text != text.strip() or "\n" in text):
        return json.dumps(text, ensure_ascii=False)
    return text


def write(nodes: Iterable[Node], depth: int = 0) -> str:
    """Nodes as text, which parses to equal nodes; texts whose lines look like markup stand between tags made of their hash."""
    out: list[str] = []
    for n in nodes:
        pad, inner = "  " * depth, "  " * (depth + 1)
        values = {k: _plain(v) for k, v in n.attrs.items()}
        short = {k: v for k, v in values.items() if len(v) < 50 and " " not in v}
        out.append(pad + " ".join([f"@{n.type}", *([n.label] if n.label else []), *([f"[{'|'.join(n.heads)}]"] if n.heads else []), *(f"{k}:{v}" for k, v in short.items())]))
        out += [f"{inner}{k}: {v}" for k, v in values.items() if k not in short]
        out += [inner + " | ".join(r) for r in n.rows]
        if any(x != x.strip() or not x or x[0] in "@>|#" or _MEMBER.match(x) for x in n.lines):
            tag = blake2b(n.text.encode("utf-8", "surrogatepass"), digest_size=4).hexdigest()
            out += [f"{inner}|#{tag}>", *n.lines, f"{inner}|#{tag}"]
        else:
            out += [f"{inner}> {x}" for x in n.lines]
        if n.children:
            out.append(write(n.children, depth + 1))
    return "\n".join(out)


# ---- other formats ----------------------------------------------------------------------------------------------


def from_json(value: Any, name: str = "object") -> list[Node]:
    """A JSON value as nodes: an object's plain members are attributes, texts of several lines are text, lists of equal plain objects are tables."""
    if isinstance(value, dict):
        node = Node("object", name)
        for k, v in value.items():
            if isinstance(v, (dict, list)) or not re.fullmatch(r"[A-Za-z_][\w.-]*", k):
                node.children += from_json(v, k)
            elif isinstance(v, str) and "\n" in v:
                node.children.append(Node("lines", k, lines=v.split("\n")))
            else:
                node.attrs[k] = v
        return [node]
    if isinstance(value, list):
        heads = list(value[0]) if value and isinstance(value[0], dict) else []
        plain = lambda v: not isinstance(v, (dict, list)) and " | " not in (t := json.dumps(v, ensure_ascii=False)) and len(t) < 200
        if len(value) > 1 and len(heads) > 1 and all(isinstance(r, dict) and list(r) == heads and all(map(plain, r.values())) for r in value) and all(re.fullmatch(r"\w+", h) for h in heads):
            return [Node("table", name, heads=heads, rows=[[json.dumps(r[h], ensure_ascii=False) for h in heads] for r in value])]
        node = Node("list", name)
        for v in value:
            node.children += from_json(v, "item")
        return [node]
    if isinstance(value, str) and "\n" in value:
        return [Node("lines", name, lines=value.split("\n"))]
    return [Node("value", name, {"value": value})]


def to_json(node: Node) -> Any:
    if node.type == "object":
        return node.attrs | {c.label: to_json(c) for c in node.children}
    if node.type == "list":
        return [to_json(c) for c in node.children]
    if node.type == "table":
        return [dict(zip(node.heads, map(json.loads, r))) for r in node.rows]
    return node.text if node.type == "lines" else node.attrs.get("value")


def json_round(text: str | None) -> tuple[bool | None, int]:
    """Whether a JSON text comes back equal through the markup, and the markup's length; None for what is no JSON object."""
    try:
        value = json.loads(text or "")
    except (ValueError, RecursionError):
        return None, 0
    if not isinstance(value, dict) or not all(map(_usable, _names(value))):
        return None, 0
    made = write(from_json(value))
    nodes = parse(made)
    return len(nodes) == 1 and to_json(nodes[0]) == value, len(made)


def _names(value: Any) -> Iterator[str]:
    if isinstance(value, dict):
        for k, v in value.items():
            yield k
            yield from _names(v)
    elif isinstance(value, list):
        for v in value:
            yield from _names(v)


def _usable(name: str) -> bool:
    """Whether a member's name can be a label: no blanks at its ends, no brackets, colons or line ends."""
    return bool(name) and name == name.strip() and not re.search(r"[\[\]:\n]", name)


def to_xml(members: dict[str, str | None], root: str = "call") -> str:
    """One level of XML; names that XML can't have are left out."""
    body = "".join(f"<{k}>{escape(v)}</{k}>" for k, v in members.items() if v is not None and re.fullmatch(r"[A-Za-z_][\w.-]*", k))
    return f"<{root}>{body}</{root}>"


def from_xml(text: str) -> dict[str, str]:
    """The elements of one level; no entities but XML's own five are known, so none expand."""
    body = re.sub(r"^\s*<[A-Za-z_][\w.-]*>(.*)</[A-Za-z_][\w.-]*>\s*$", r"\1", text, flags=re.S)
    return {m[1]: unescape(m[2], {"&quot;": '"', "&apos;": "'"}) for m in re.finditer(r"<([A-Za-z_][\w.-]*)>([^<]*)</\1>", body)}


def to_table(heads: list[str], rows: list[list[str]]) -> str:
    cell = lambda c: c.replace("\\", "\\\\").replace("|", "\\|").replace("\n", "<br>")
    return "\n".join(f"| {' | '.join(map(cell, r))} |" for r in [heads, ["---"] * len(heads), *rows])


def from_table(text: str) -> list[dict[str, str]]:
    """The rows of a Markdown table by its heads."""
    lines = [x.strip() for x in text.splitlines() if x.strip().startswith("|")]
    cells = [[re.sub(r"\\(.)", r"\1", c).replace("<br>", "\n") for c in (x.strip() for x in re.split(r"(?<!\\)(?:\\\\)*\|", line[1:].removesuffix("|")))] for line in lines]
    return [dict(zip(cells[0], r)) for r in cells[2:]] if len(cells) > 2 else []


def calls_in(text: str | None) -> list[tuple[str, dict[str, Any]]]:
    """Tool calls written in a text: @Tool nodes, and JSON objects with a name and an input."""
    found = []
    stack = parse(text)
    while stack:
        n = stack.pop(0)
        if n.type.lower() == "tool" and n.label:
            found.append((n.label, n.attrs))
        stack = n.children + stack
    for m in re.finditer(r"\{", text or ""):
        try:
            doc, _ = json.JSONDecoder().raw_decode(text[m.start() : m.start() + 20_000])
        except (ValueError, RecursionError):
            continue
        if isinstance(doc, dict) and isinstance(doc.get("name"), str) and isinstance(doc.get("input"), dict):
            found.append((doc["name"], doc["input"]))
    return found


# ---- skeletons --------------------------------------------------------------------------------------------------

Index = dict[tuple[str, str], str]
_SIGNATURE = re.compile(r"^[ \t]*(def|class)[ \t]+([A-Za-z_]\w*)(.*)$", re.M)


def skeleton(code: str | None) -> Index:
    """(kind, name) -> the rest of the signature, the first of each name."""
    out: Index = {}
    for m in _SIGNATURE.finditer(code or ""):
        out.setdefault((m[1], m[2]), m[3].strip(" "))
    return out


def difference(old: Index, new: Index) -> list[tuple[str, str, str, str]]:
    """(op, kind, name, signature): what makes new of old."""
    return [("remove", *k, "") for k in old if k not in new] + [("add" if k not in old else "update", *k, v) for k, v in new.items() if old.get(k) != v]


def applied(index: Index, changes: Iterable[tuple[str, str, str, str]]) -> Index:
    out = dict(index)
    for op, kind, name, signature in changes:
        if op == "remove":
            out.pop((kind, name), None)
        else:
            out[kind, name] = signature
    return out
