"""The head of an entry document: a strict subset of YAML. What is outside it is refused with its line, never guessed at."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_DEPTH = 8


class Refused(ValueError):
    def __init__(self, line: int, why: str):
        super().__init__(why)
        self.line = line


class _Reader:
    def __init__(self, lines: list[tuple[int, str]]):
        self.lines, self.at = lines, 0

    def peek(self) -> tuple[int, int, str] | None:
        """(line, indent, content) of the next line that says something."""
        while self.at < len(self.lines):
            n, raw = self.lines[self.at]
            body = raw.strip(" ")
            if body and not body.startswith("#"):
                if raw.lstrip(" ").startswith("\t"):
                    raise Refused(n, "tab indent")
                return n, len(raw) - len(raw.lstrip(" ")), body
            self.at += 1
        return None

    def mapping(self, indent: int, depth: int) -> dict:
        if depth > MAX_DEPTH:
            raise Refused(self.lines[min(self.at, len(self.lines) - 1)][0], "too deep")
        out: dict = {}
        while (p := self.peek()) and p[1] == indent:
            n, _, body = p
            refuse(n, body)
            key, rest = split_key(n, body)
            if key == "<<":
                raise Refused(n, "merge key")
            if key in out:
                raise Refused(n, f"duplicate key {key}")
            self.at += 1
            out[key] = self.value(n, rest, indent, depth)
        if p and p[1] > indent:
            raise Refused(p[0], "unexpected indent")
        return out

    def value(self, n: int, rest: str, indent: int, depth: int):
        rest = strip_comment(rest).strip()
        if re.fullmatch(r"[|>][+-]?", rest):
            return self.block(rest[0], indent)
        if rest:
            refuse(n, rest)
            if rest[0] in "[{":
                return flow(n, rest, depth + 1)
            if rest[0] in "\"'":
                return unquote(n, rest)
            return self.plain(rest, indent)
        p = self.peek()
        if p and (p[2] == "-" or p[2].startswith("- ")) and p[1] >= indent:
            return self.sequence(p[1], depth + 1)
        if p and p[1] > indent:
            return self.mapping(p[1], depth + 1)
        return ""

    def plain(self, rest: str, indent: int) -> str:
        """A bare scalar goes on over deeper lines that are neither keys nor items."""
        parts = [rest]
        while (p := self.peek()) and p[1] > indent and not p[2].startswith("- ") and not re.match(r"[^\s:]+:(\s|$)", p[2]):
            parts.append(strip_comment(p[2]).strip())
            self.at += 1
        return " ".join(parts)

    def sequence(self, indent: int, depth: int) -> list:
        if depth > MAX_DEPTH:
            raise Refused(self.lines[self.at][0], "too deep")
        out = []
        while (p := self.peek()) and p[1] == indent and (p[2] == "-" or p[2].startswith("- ")):
            n, _, body = p
            rest = body[1:].strip()
            if rest and rest[0] not in "\"'[{|>" and re.match(r"[^\s:]+:(\s|$)", rest):
                self.lines[self.at] = (n, " " * (indent + 2) + rest)
                out.append(self.mapping(indent + 2, depth + 1))
            else:
                self.at += 1
                out.append(self.value(n, rest, indent, depth))
        return out

    def block(self, style: str, indent: int) -> str:
        parts = []
        while self.at < len(self.lines):
            raw = self.lines[self.at][1]
            if raw.strip() and len(raw) - len(raw.lstrip(" ")) <= indent:
                break
            parts.append(raw.strip())
            self.at += 1
        return (" " if style == ">" else "\n").join(parts).strip()


def refuse(n: int, body: str) -> None:
    for mark, why in (("&", "anchor"), ("*", "alias"), ("%", "directive"), ("...", "document end"), ("!", "tag")):
        if body.startswith(mark):
            raise Refused(n, why)


def split_key(n: int, body: str) -> tuple[str, str]:
    if body[0] in "\"'":
        m = re.match(r"(\"[^\"]*\"|'[^']*')\s*:(?=\s|$)", body)
        if not m:
            raise Refused(n, "no key")
        return m[1][1:-1], body[m.end() :]
    m = re.match(r"(.*?):(?=\s|$)", body)
    if not m or not m[1].strip():
        raise Refused(n, "no key")
    return m[1].strip(), body[m.end() :]


def strip_comment(s: str) -> str:
    q = ""
    for i, c in enumerate(s):
        if q:
            q = "" if c == q else q
        elif c in "\"'" and not s[:i].strip():
            q = c
        elif c == "#" and (i == 0 or s[i - 1] in " \t"):
            return s[:i]
    return s


def unquote(n: int, s: str) -> str:
    if len(s) < 2 or s[-1] != s[0]:
        raise Refused(n, "open quote")
    return s[1:-1].replace("''", "'") if s[0] == "'" else re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), s[1:-1])


def flow(n: int, s: str, depth: int):
    if depth > MAX_DEPTH:
        raise Refused(n, "too deep")
    close = {"[": "]", "{": "}"}[s[0]]
    if s[-1] != close:
        raise Refused(n, "flow value over several lines")
    parts, level, last, q = [], 0, 1, ""
    for i, c in enumerate(s[1:-1], 1):
        if q:
            q = "" if c == q else q
        elif c in "\"'":
            q = c
        elif c in "[{":
            level += 1
        elif c in "]}":
            level -= 1
        elif c == "," and not level:
            parts.append(s[last:i].strip())
            last = i + 1
    parts.append(s[last:-1].strip())
    parts = [p for p in parts if p]

    def one(p: str):
        refuse(n, p)
        return flow(n, p, depth + 1) if p[0] in "[{" else unquote(n, p) if p[0] in "\"'" else p

    if s[0] == "[":
        return [one(p) for p in parts]
    out: dict = {}
    for p in parts:
        k, v = split_key(n, p if re.search(r":(\s|$)", p) else p + ": ")
        if k in out:
            raise Refused(n, f"duplicate key {k}")
        out[k] = one(v.strip()) if v.strip() else ""
    return out


def parse(text: str) -> dict:
    lines = text.split("\n")
    if not lines or lines[0].rstrip() != "---":
        raise Refused(1, "no frontmatter")
    end = next((i for i, line in enumerate(lines[1:], 1) if line.rstrip() == "---"), None)
    if end is None:
        raise Refused(len(lines), "frontmatter without an end")
    r = _Reader([(i + 1, lines[i].rstrip("\r").rstrip()) for i in range(1, end)])
    p = r.peek()
    if p is None:
        return {}
    out = r.mapping(p[1], 1)
    if rest := r.peek():
        raise Refused(rest[0], "unexpected indent")
    return out


def listed(x) -> list[str]:
    """A scalar is a list of one; mappings add nothing."""
    return [x] if isinstance(x, str) and x else [v for v in x if isinstance(v, str)] if isinstance(x, list) else []


def frontmatter(entries: DataFrame) -> DataFrame:
    """(root, ok, line, message, name, description, keys, declared, value as JSON). entries: root, text."""
    schema = pa.schema([("root", pa.string()), ("ok", pa.bool_()), ("line", pa.int64()), ("message", pa.string()), ("name", pa.string()), ("description", pa.string()), ("keys", pa.list_(pa.string())), ("declared", pa.list_(pa.string())), ("value", pa.string())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = []
            for root, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    v = parse(text or "")
                    scalar = {k: x for k, x in v.items() if isinstance(x, str)}
                    rows.append((root, True, None, None, scalar.get("name"), scalar.get("description"), sorted(v), listed(v.get("allowed-tools", "")), json.dumps(v, sort_keys=True, ensure_ascii=False)))
                except Refused as x:
                    rows.append((root, False, x.line, str(x), None, None, None, None, None))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return entries.select("root", F.col("text").cast("string")).mapInArrow(run, "root string, ok boolean, line long, message string, name string, description string, keys array<string>, declared array<string>, value string")
