"""Source text to flat events: calls, reads, writes, environment reads, shell commands and prose blocks, with byte spans and how each is reached.

Python goes through ``ast``; shell, JavaScript and TypeScript through small scanners for the shapes that rules ask about. A text
that can't be read gives one ``parse_error`` event, never nothing.
"""

from __future__ import annotations

import ast
import bisect
import hashlib
import re
from dataclasses import dataclass, field

FIELDS = ("kind", "recv", "callee", "shape", "inner", "info", "target_kind", "target", "start", "end", "line", "reach", "sha256", "text")
DEPTH = 10


@dataclass
class Event:
    kind: str
    start: int
    end: int
    line: int
    recv: str = ""
    callee: str = ""
    shape: str = "none"
    inner: list[str] = field(default_factory=list)
    info: str = ""
    target: tuple[str, str] | None = None
    reach: str = "present"
    text: str = ""


Fold = tuple[str, str]  # exact, tail, rooted or unknown, and its text
UNKNOWN: Fold = ("unknown", "")


def join(a: Fold, b: Fold, sep: str = "") -> Fold:
    """Two folded values side by side; with a separator they are path parts."""
    (ka, va), (kb, vb) = a, b
    if ka == "exact":
        left = va.rstrip("/") + sep if sep and va else va
        right = vb.lstrip("/") if sep and va else vb
        if kb == "exact":
            return "exact", left + right
        if kb == "tail":
            return b
        if kb == "rooted":
            return "rooted", left + right
        return ("rooted", left) if va else UNKNOWN
    if ka == "tail":
        if kb == "exact":
            return "tail", (va + sep + vb.lstrip("/") if sep and va else va + vb)
        return b if kb == "tail" else UNKNOWN
    if ka == "rooted":
        return a
    if kb == "exact" and sep:
        return "tail", vb
    return b if kb == "tail" and sep else UNKNOWN


# Python


#: Nodes with nothing below them that is looked for.
_LEAVES = {ast.Name, ast.Constant, ast.Pass, ast.Break, ast.Continue, ast.Import, ast.ImportFrom, ast.Global, ast.Nonlocal, ast.alias, *ast.expr_context.__subclasses__(), *ast.operator.__subclasses__(), *ast.unaryop.__subclasses__(), *ast.boolop.__subclasses__(), *ast.cmpop.__subclasses__()}


class _Python:
    WRITE_METHODS = {"write_text", "write_bytes", "mkdir", "unlink", "touch", "rmdir"}
    READ_METHODS = {"read_text", "read_bytes"}
    WRITE_FIRST = {("os", n) for n in ("remove", "unlink", "mkdir", "makedirs", "rmdir", "removedirs", "truncate", "chmod")} | {("shutil", "rmtree")}
    WRITE_SECOND = {("shutil", n) for n in ("copy", "copy2", "copyfile", "copytree", "move")} | {("os", n) for n in ("rename", "replace", "symlink", "link")}

    def __init__(self, text: str, entered: bool):
        self.entered = entered
        self.raw = text.encode("utf-8", "surrogatepass")
        self.starts = [0, *(m.end() for m in re.finditer(b"\n", self.raw))]
        tree = ast.parse(text)
        self.events: list[Event] = []
        self.inside: list[tuple[Event, str]] = []
        self.scope: dict[str, ast.expr | None] = {}
        self.calls: dict[str, set[str]] = {}
        self.defs: set[str] = set()
        self.blocked: set[str] = set()
        self.now = ""
        todo = [tree]  # statements alone: no expression holds one
        while todo:
            n = todo.pop()
            for below in ("body", "orelse", "finalbody", "handlers", "cases"):
                todo += getattr(n, below, ())
            if isinstance(n, ast.Assign):
                for t in n.targets:
                    if isinstance(t, ast.Name):
                        self.scope[t.id] = None if t.id in self.scope else n.value
            elif isinstance(n, (ast.AugAssign, ast.For)) and isinstance(n.target, ast.Name):
                self.scope[n.target.id] = None
        self.visit(tree)
        self._reach()

    def _reach(self) -> None:
        seen, front = set(), {""}
        while front:
            seen |= front
            front = {c for f in front for c in self.calls.get(f, ()) if c in self.defs} - seen
        stuck = bool(self.blocked & seen)
        for e, where in self.inside:
            e.reach = "present" if not self.entered else "observed" if where in seen else "unresolved" if stuck else "present"

    def span(self, n: ast.AST) -> tuple[int, int, int]:
        return self.starts[n.lineno - 1] + n.col_offset, self.starts[n.end_lineno - 1] + n.end_col_offset, n.lineno

    def add(self, e: Event) -> None:
        self.events.append(e)
        self.inside.append((e, self.now))

    def dotted(self, n: ast.expr) -> str | None:
        parts = []
        while isinstance(n, (ast.Attribute, ast.Call, ast.Await)):
            if isinstance(n, ast.Attribute):
                parts.append(n.attr)
                n = n.value
            elif isinstance(n, ast.Await):
                n = n.value
            else:
                n = n.func
        if isinstance(n, ast.Name):
            parts.append(n.id)
        return ".".join(reversed(parts)) if parts else None

    def fold(self, n: ast.expr | None, depth: int = 0) -> Fold:
        if n is None or depth > DEPTH:
            return UNKNOWN
        if isinstance(n, ast.Constant):
            return ("exact", n.value) if isinstance(n.value, str) else UNKNOWN
        if isinstance(n, ast.Name):
            return self.fold(self.scope.get(n.id), depth + 1)
        if isinstance(n, ast.BinOp) and isinstance(n.op, (ast.Add, ast.Div)):
            return join(self.fold(n.left, depth + 1), self.fold(n.right, depth + 1), "/" if isinstance(n.op, ast.Div) else "")
        if isinstance(n, ast.JoinedStr):
            out: Fold = ("exact", "")
            for v in n.values:
                part = self.fold(v.value, depth + 1) if isinstance(v, ast.FormattedValue) else self.fold(v, depth + 1)
                out = ("tail", part[1]) if out == UNKNOWN and part[0] in ("exact", "tail") else join(out, part)
            return out
        if isinstance(n, ast.Call):
            name = (self.dotted(n.func) or "").split(".")[-1]
            if name in ("home", "homedir"):
                return "exact", "~"
            if name in ("expanduser", "Path", "PurePath", "str") and n.args:
                return self.fold(n.args[0], depth + 1)
            if name in ("join", "joinpath", "resolve") and (n.args or isinstance(n.func, ast.Attribute)):
                parts = list(n.args)
                if name in ("joinpath", "resolve") and isinstance(n.func, ast.Attribute):
                    parts = [n.func.value, *parts]
                if not parts:
                    return UNKNOWN
                out = self.fold(parts[0], depth + 1)
                for p in parts[1:]:
                    out = join(out, self.fold(p, depth + 1), "/")
                return out
            if name in ("dirname", "abspath", "cwd", "realpath", "getcwd"):
                return "tail", ""
        return UNKNOWN

    def shape(self, n: ast.expr | None) -> str:
        if n is None:
            return "none"
        if isinstance(n, ast.Constant):
            return "string" if isinstance(n.value, str) and "{" not in n.value else "other"
        if isinstance(n, ast.List):
            return "list_literal" if n.elts and isinstance(n.elts[0], ast.Constant) and isinstance(n.elts[0].value, str) else "list_dynamic"
        kinds = ((ast.JoinedStr, "interp"), (ast.Name, "ident"), (ast.Attribute, "attr"), (ast.Call, "call"), (ast.Subscript, "subscript"), (ast.BinOp, "binop"))
        return next((s for k, s in kinds if isinstance(n, k)), "other")

    def visit(self, n: ast.AST) -> None:
        kind = n.__class__
        if kind is ast.Call:
            self.visit_Call(n)
        elif kind is ast.FunctionDef or kind is ast.AsyncFunctionDef:
            self.visit_def(n)
        elif kind not in _LEAVES:
            self.below(n)

    def below(self, n: ast.AST) -> None:
        for name in n._fields:
            v = getattr(n, name, None)
            if v.__class__ is list:
                for x in v:
                    if isinstance(x, ast.AST):
                        self.visit(x)
            elif isinstance(v, ast.AST):
                self.visit(v)

    def visit_def(self, n: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        for d in (*n.decorator_list, *n.args.defaults, *(x for x in n.args.kw_defaults if x)):
            self.visit(d)
        before, self.now = self.now, n.name
        self.defs.add(n.name)
        for x in n.body:
            self.visit(x)
        self.now = before

    def visit_Call(self, n: ast.Call) -> None:
        name = self.dotted(n.func)
        here = self.calls.setdefault(self.now, set())
        if name is None or isinstance(n.func, (ast.Subscript, ast.Call, ast.Lambda)):
            self.blocked.add(self.now)
        if name:
            recv, _, callee = name.rpartition(".")
            here.add(callee)
            first = n.args[0] if n.args else None
            s, e, line = self.span(n)
            inner = [d for x in ast.walk(first) if isinstance(x, ast.Call) and (d := self.dotted(x.func))] if isinstance(first, (ast.Call, ast.Attribute)) else []
            self.add(Event("call", s, e, line, recv, callee, self.shape(first), inner))
            self._sinks(n, recv, callee, first, s, e, line)
        self.below(n)

    def _sinks(self, n, recv, callee, first, s, e, line) -> None:
        last = recv.split(".")[-1]
        second = n.args[1] if len(n.args) > 1 else next((k.value for k in n.keywords if k.arg in ("mode", "dst")), None)

        def sink(kind: str, target: ast.expr | None) -> None:
            if target is not None:
                self.add(Event(kind, s, e, line, recv, callee, self.shape(target), target=self.fold(target)))

        if callee == "open" and recv in ("", "io", "codecs"):
            mode = second.value if isinstance(second, ast.Constant) and isinstance(second.value, str) else "r" if second is None else None
            sink("write" if mode and re.search("[wax+]", mode) else "read", first)
        elif callee in self.READ_METHODS and isinstance(n.func, ast.Attribute):
            sink("read", n.func.value)
        elif callee in self.WRITE_METHODS and isinstance(n.func, ast.Attribute) and last not in ("os", "shutil"):
            sink("write", n.func.value)
        elif (last, callee) in self.WRITE_FIRST:
            sink("write", first)
        elif (last, callee) in self.WRITE_SECOND:
            sink("write", second)
        elif (last, callee) in (("os", "getenv"), ("environ", "get")) and isinstance(first, ast.Constant) and isinstance(first.value, str):
            self.add(Event("env_read", s, e, line, recv, callee, "string", info=first.value))


# scanners for shell and JavaScript


class _Scanned:
    def __init__(self, text: str, entered: bool):
        self.text, self.entered = text, entered
        self.lines = [0, *(m.end() for m in re.finditer("\n", text))]
        self.events: list[Event] = []

    def add(self, kind: str, s: int, e: int, **kw) -> None:
        self.events.append(Event(kind, s, e, bisect.bisect_right(self.lines, s), **kw))

    def settle(self, bodies: list[tuple[int, int, str]], calls: list[tuple[int, str]], dynamic: list[int]) -> None:
        """Reach of every event, by the innermost function around it."""

        def around(at: int) -> str:
            best = None
            for s, e, n in bodies:
                if s <= at < e and (best is None or e - s < best[0]):
                    best = (e - s, n)
            return best[1] if best else ""

        names = {n for _, _, n in bodies}
        by: dict[str, set[str]] = {}
        for at, n in calls:
            by.setdefault(around(at), set()).add(n)
        seen, front = set(), {""}
        while front:
            seen |= front
            front = {c for f in front for c in by.get(f, ()) if c in names} - seen
        stuck = any(around(at) in seen for at in dynamic)
        for ev in self.events:
            ev.reach = "present" if not self.entered else "observed" if around(ev.start) in seen else "unresolved" if stuck else "present"


def _blank(text: str, spans: list[tuple[int, int]]) -> str:
    if not spans:
        return text
    out = list(text)
    for s, e in spans:
        for i in range(s, e):
            if out[i] != "\n":
                out[i] = " "
    return "".join(out)


_SH_TOKEN = re.compile(r"""(?P<space>[ \t]+|\\\n)|(?P<comment>(?:(?<=\s)|^)\#[^\n]*)|(?P<end>\n|;;?|&&|\|\||\||&(?!>)|[(){}](?=\s|$|;)|\$\(|\))|(?P<redirect>\d*(?:>>?\|?|<(?!<)|&>>?))|(?P<heredoc><<-?\s*['"]?\w+['"]?|<<<)|(?P<word>(?:"(?:\\.|[^"\\])*"|'[^']*'|\$\{[^}]*\}|\$\((?:[^()]|\([^()]*\))*\)|`[^`]*`|\\.|[^\s;|&<>()"'`\\])+)""", re.M | re.S)
_SH_SET = re.compile(r"(?m)^\s*(?:export\s+|local\s+|readonly\s+)?([A-Za-z_]\w*)=(\"[^\"\n]*\"|'[^'\n]*'|[^\s;|&]*)")
_SH_DEF = re.compile(r"(?m)^\s*(?:function\s+)?([A-Za-z_][\w-]*)\s*\(\)\s*\{")
_SH_WRAP = {"sudo", "env", "nohup", "time", "exec", "command", "then", "do", "else", "if", "while", "!"}


class _Shell(_Scanned):
    INTERPRETERS = {"sh", "bash", "zsh", "dash", "python", "python3", "node", "perl", "ruby"}

    def __init__(self, text: str, entered: bool):
        super().__init__(text, entered)
        self.vars: dict[str, str | None] = {}
        for m in _SH_SET.finditer(text):
            self.vars[m[1]] = None if m[1] in self.vars else m[2]
        bodies, calls, dynamic = [], [], []
        defs = list(_SH_DEF.finditer(text))
        for m in defs:
            end = text.find("\n}", m.end())
            bodies.append((m.end(), len(text) if end < 0 else end, m[1]))
        text = _blank(text, [(m.start(1), m.end() - 1) for m in defs])  # a definition is no call
        words: list[tuple[str, int, int]] = []
        redirects: list[tuple[str, str, int, int]] = []
        pipe: list[tuple[str, int, int]] = []
        pending, at = None, 0

        def flush(op: str) -> None:
            nonlocal words, redirects, pipe
            while words and (words[0][0] in _SH_WRAP or re.match(r"[A-Za-z_]\w*=", words[0][0])):
                words.pop(0)
            if words:
                calls.append((words[0][1], words[0][0]))
                self.command(words, dynamic)
                pipe.append((words[0][0], words[0][1], words[-1][2], len(words)))
            for r, w, s, e in redirects:
                if not w.strip("\"'").startswith("/dev/") or re.match(r"/dev/(tcp|udp)/", w.strip("\"'")):
                    self.add("write" if ">" in r else "read", s, e, callee=r.lstrip("0123456789"), shape=self.shape(w), target=self.fold(w))
                if re.match(r"/dev/(tcp|udp)/", w.strip("\"'")):
                    self.add("call", s, e, callee="/dev/tcp")
            words, redirects = [], []
            if op != "|":
                if len(pipe) > 1 and pipe[-1][0] in self.INTERPRETERS and pipe[-1][3] == 1:
                    self.add("pipeline", pipe[0][1], pipe[-1][2], callee=pipe[-1][0], inner=[p[0] for p in pipe[:-1]])
                pipe = []

        while at < len(text):
            m = _SH_TOKEN.match(text, at)
            if not m:
                at += 1
                continue
            at = m.end()
            if m["word"]:
                if pending is not None:
                    redirects.append((pending[0], m["word"], pending[1], m.end()))
                    pending = None
                else:
                    words.append((m["word"], m.start(), m.end()))
            elif m["redirect"]:
                pending = (m["redirect"], m.start())
            elif m["end"]:
                flush(m["end"])
        flush("\n")
        self.settle(bodies, calls, dynamic)

    def shape(self, w: str) -> str:
        if re.fullmatch(r'"?\$(\w+|\{\w+\})"?', w):
            return "expansion"
        return "interp" if "$" in w or "`" in w else "string"

    def fold(self, w: str, depth: int = 0) -> Fold:
        if depth > DEPTH:
            return UNKNOWN
        if w.startswith("'"):
            return "exact", w.strip("'")
        out: Fold = ("exact", "")
        for m in re.finditer(r"\$\{(\w+)(?::?[-=]([^}]*))?\}|\$\{[^}]*\}|\$(\w+)|\$\([^)]*\)|`[^`]*`|[^$`]+", w.replace('"', "")):
            name, default = m[1] or m[3], m[2]
            if m[0][0] not in "$`":
                part: Fold = ("exact", m[0])
            elif name == "HOME":
                part = ("exact", "~")
            elif name and self.vars.get(name) is not None:
                part = self.fold(self.vars[name], depth + 1)
            elif default is not None and name not in self.vars:
                part = ("exact", default)
            else:
                part = UNKNOWN
            out = ("tail", part[1].lstrip("/")) if out == UNKNOWN and part[0] in ("exact", "tail") else join(out, part)
        return out

    def command(self, words: list[tuple[str, int, int]], dynamic: list[int]) -> None:
        name, s, _ = words[0]
        e = words[-1][2]
        args = [w[0] for w in words[1:]]
        plain = [a for a in args if not a.startswith("-")]
        shape = self.shape(name)
        if shape == "expansion":
            dynamic.append(s)
        first = self.shape(args[0]) if args else "none"
        self.add("call", s, e, callee="$" if shape == "expansion" else name, shape=first, info=" ".join(args)[:200], inner=[shape])
        if name == "cat":
            for a in plain:
                self.add("read", s, e, callee=name, shape=self.shape(a), target=self.fold(a))
        elif name in ("source", ".") and plain:
            self.add("read", s, e, callee=name, shape=self.shape(plain[0]), target=self.fold(plain[0]))
        elif name in ("mkdir", "touch", "tee", "install", "rm"):
            for a in plain:
                self.add("write", s, e, callee=name, shape=self.shape(a), target=self.fold(a))
        elif name in ("cp", "mv", "ln", "rsync") and len(plain) > 1:
            self.add("write", s, e, callee=name, shape=self.shape(plain[-1]), target=self.fold(plain[-1]))


_JS_SKIP = re.compile(r"//[^\n]*|/\*.*?\*/", re.S)
_JS_STRING = re.compile(r""""(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`""", re.S)
_JS_CALL = re.compile(r"(?<![\w$.])(new\s+)?((?:await\s+)?(?:require\s*\(\s*['\"][\w:/-]+['\"]\s*\)|[\w$]+)(?:\s*\??\.\s*[\w$]+)*)\s*\(")


class _Script(_Scanned):
    WRITE = {f"{n}Sync" for n in ("writeFile", "appendFile", "mkdir", "rm", "rmdir", "unlink", "truncate", "chmod")} | {"writeFile", "appendFile", "createWriteStream"}
    WRITE_SECOND = {f"{n}Sync" for n in ("copyFile", "rename", "cp", "symlink")} | {"copyFile", "rename"}
    READ = {"readFileSync", "readFile", "createReadStream"}
    KEYWORDS = {"if", "for", "while", "switch", "catch", "function", "return", "typeof"}

    def __init__(self, text: str, entered: bool):
        super().__init__(text, entered)
        strings = [m.span() for m in _JS_STRING.finditer(text)]
        heads = [s for s, _ in strings]
        skip = [m.span() for m in _JS_SKIP.finditer(text) if not ((i := bisect.bisect_right(heads, m.start()) - 1) >= 0 and strings[i][1] > m.start())]
        self.code = _blank(text, skip)
        self.consts: dict[str, str | None] = {}
        for m in re.finditer(r"(?<![.\w$])([A-Za-z_$][\w$]*)\s*=(?![=>])\s*([^;\n]+)", self.code):
            self.consts[m[1]] = None if m[1] in self.consts else m[2].strip()
        bodies, calls, dynamic = [], [], []
        for m in re.finditer(r"function\s+([\w$]+)\s*\([^)]*\)[^{;]*\{|(?:const|let|var)\s+([\w$]+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|[\w$]+)[^={;\n]*=>\s*\{|(?m:^\s+)(?:async\s+)?([\w$]+)\s*\([^)]*\)\s*\{", self.code):
            name = m[1] or m[2] or m[3]
            if name not in self.KEYWORDS:
                bodies.append((m.end(), self.close(m.end() - 1, "{", "}"), name))
        for m in re.finditer(r"[\])]\s*\(", self.code):
            dynamic.append(m.start())
        inside = [(a, b) for a, b in strings]
        for m in _JS_CALL.finditer(self.code):
            i = bisect.bisect_right(heads, m.start(2)) - 1
            if i >= 0 and inside[i][0] <= m.start(2) < inside[i][1]:
                continue
            name = re.sub(r"\s+|^await\s+", "", m[2].replace("?.", ".")).removeprefix("await")
            if name in self.KEYWORDS or self.code[: m.start()].rstrip().endswith("function"):
                continue
            end = self.close(m.end() - 1, "(", ")")
            args = self.split(self.code[m.end() : end - 1])
            recv, _, callee = name.rpartition(".")
            calls.append((m.start(), callee))
            self.call(m.start(), end, recv, callee, args, bool(m[1]))
        for m in re.finditer(r"process\.env(?:\.([A-Za-z_]\w*)|\[\s*['\"](\w+)['\"]\s*\])(?!\s*=(?!=)|\w)", self.code):
            self.add("env_read", m.start(), m.end(), recv="process.env", shape="string", info=m[1] or m[2])
        for m in re.finditer(r"import\s+(?:(\{[^}]*\})\s+from\s+)?['\"](dotenv(?:/config)?)['\"]", self.code):
            if m[2] == "dotenv/config" or (m[1] and re.search(r"\bconfig\b", m[1])):
                self.add("import", m.start(), m.end(), callee="dotenv")
        self.settle(bodies, calls, dynamic)

    def close(self, at: int, a: str, b: str) -> int:
        depth = 0
        while at < len(self.code):
            c = self.code[at]
            if c in "\"'`" and (m := _JS_STRING.match(self.code, at)):
                at = m.end()
                continue
            depth += (c == a) - (c == b)
            at += 1
            if not depth:
                return at
        return at

    def split(self, args: str) -> list[str]:
        out, depth, at, last = [], 0, 0, 0
        while at < len(args):
            c = args[at]
            if c in "\"'`" and (m := _JS_STRING.match(args, at)):
                at = m.end()
                continue
            depth += (c in "([{") - (c in ")]}")
            if c == "," and not depth:
                out.append(args[last:at].strip())
                last = at + 1
            at += 1
        return out + ([args[last:].strip()] if args[last:].strip() else [])

    def shape(self, a: str | None) -> str:
        if a is None:
            return "none"
        if _JS_STRING.fullmatch(a):
            return "interp" if a[0] == "`" and "${" in a else "string"
        kinds = ((r"[\w$]+", "ident"), (r"\[\s*['\"].*\]", "list_literal"), (r"\[.*\]", "list_dynamic"), (r"[\w$.]+\(.*\)", "call"), (r"[\w$]+(\??\.[\w$]+)+", "attr"), (r"[\w$.]+\[.*\]", "subscript"), (r".*\+.*", "binop"))
        return next((s for x, s in kinds if re.fullmatch(x, a, re.S)), "other")

    def fold(self, a: str | None, depth: int = 0) -> Fold:
        if a is None or depth > DEPTH:
            return UNKNOWN
        a = a.strip()
        if _JS_STRING.fullmatch(a):
            if a[0] != "`" or "${" not in a:
                return "exact", a[1:-1]
            out: Fold = ("exact", "")
            for m in re.finditer(r"\$\{([^}]*)\}|[^$]+|\$", a[1:-1]):
                part = self.fold(m[1], depth + 1) if m[1] is not None else ("exact", m[0])
                out = ("tail", part[1].lstrip("/")) if out == UNKNOWN and part[0] in ("exact", "tail") else join(out, part)
            return out
        if re.fullmatch(r"[\w$]+", a):
            return self.fold(self.consts.get(a), depth + 1)
        if m := re.fullmatch(r"(?:[\w$]+\.)*(join|resolve|homedir|cwd|dirname)\s*\((.*)\)", a, re.S):
            if m[1] == "homedir":
                return "exact", "~"
            if m[1] in ("cwd", "dirname"):
                return "tail", ""
            parts = [self.fold(p, depth + 1) for p in self.split(m[2])]
            out = parts[0] if parts else UNKNOWN
            for p in parts[1:]:
                out = join(out, p, "/")
            return out
        if a in ("process.env.HOME", "os.homedir()"):
            return "exact", "~"
        parts = re.split(r"\s*\+\s*", a)
        if len(parts) > 1 and not re.search(r"[(\[]", a):
            out = self.fold(parts[0], depth + 1)
            for p in parts[1:]:
                out = join(out, self.fold(p, depth + 1))
            return out
        return UNKNOWN

    def call(self, s: int, e: int, recv: str, callee: str, args: list[str], new: bool) -> None:
        first = args[0] if args else None
        self.add("new" if new else "call", s, e, recv=recv, callee=callee, shape=self.shape(first), inner=re.findall(r"([\w$.]+)\s*\(", first or "")[:8])
        last = recv.split(".")[-1]
        if last in ("", "fs", "promises", "fsp") or recv.startswith("require("):
            for kind, names, n in (("write", self.WRITE, 0), ("write", self.WRITE_SECOND, 1), ("read", self.READ, 0)):
                if callee in names and len(args) > n:
                    self.add(kind, s, e, recv=recv, callee=callee, shape=self.shape(args[n]), target=self.fold(args[n]))


# Markdown


def markdown_blocks(text: str) -> list[Event]:
    """Fences (their content, without delimiters) and inline blocks; tables are neither."""
    out: list[Event] = []
    at, fence, start, line, first, block = 0, None, 0, 0, 0, None
    for n, raw in enumerate(re.findall(r"[^\n]*\n|[^\n]+", text), 1):
        m = re.match(r"\s{0,3}(`{3,}|~{3,})\s*([\w+-]*)", raw)
        if fence:
            if m and m[1][0] == fence[0][0] and len(m[1]) >= len(fence[0]) and not m[2]:
                out.append(Event("fence", start, at, line, info=fence[1].lower(), text=text[start:at]))
                fence = None
        elif m:
            if block is not None:
                out.append(Event("inline", block, at, first, text=text[block:at]))
                block = None
            fence, start, line = (m[1], m[2]), at + len(raw), n + 1
        elif not raw.strip() or raw.lstrip().startswith("|"):
            if block is not None:
                out.append(Event("inline", block, at, first, text=text[block:at]))
                block = None
        elif block is None:
            block, first = at, n
        at += len(raw)
    if fence and start < at:
        out.append(Event("fence", start, at, line, info=fence[1].lower(), text=text[start:at]))
    elif block is not None:
        out.append(Event("inline", block, at, first, text=text[block:at]))
    return out


def extract(language: str, text: str, entered: bool) -> list[tuple]:
    """Rows in the order of FIELDS, sorted by span; offsets are UTF-8 bytes."""
    try:
        if language == "python":
            events, by_char = _Python(text, entered).events, False
        elif language == "shell":
            events, by_char = _Shell(text, entered).events, True
        elif language in ("javascript", "typescript"):
            events, by_char = _Script(text, entered).events, True
        elif language == "markdown":
            events, by_char = markdown_blocks(text), True
        else:
            events, by_char = [], True
    except (SyntaxError, ValueError, RecursionError, MemoryError) as x:
        return [("parse_error", "", "", "none", [], type(x).__name__, None, None, 0, 0, getattr(x, "lineno", None) or 1, "unresolved", None, None)]
    raw = text.encode("utf-8", "surrogatepass")
    to_byte = None
    if by_char and len(raw) != len(text):
        to_byte = [0]
        for c in text:
            to_byte.append(to_byte[-1] + len(c.encode("utf-8", "surrogatepass")))
    out = []
    for e in sorted(events, key=lambda e: (e.start, e.end, e.kind)):
        s, t = (to_byte[e.start], to_byte[e.end]) if to_byte else (e.start, e.end)
        kind, value = e.target or (None, None)
        if kind in ("tail", "rooted") and not value:
            kind = "unknown"
        out.append((e.kind, e.recv, e.callee, e.shape, e.inner, e.info, kind, value, s, t, e.line, e.reach, hashlib.sha256(raw[s:t]).hexdigest(), e.text or None))
    return out
