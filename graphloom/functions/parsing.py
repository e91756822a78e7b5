"""Source files to entities and edges: Python by its syntax tree, other languages by a scanner of declarations.

A language other than Python is described by a table of declaration patterns and by how its comments, strings and
nesting look. The scanner blanks comments and strings, follows braces (or do/end) for scopes, and matches declarations
at their line's start; one scanner serves all of these languages.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.discovery import LANGUAGES


class Entity(NamedTuple):
    kind: str
    name: str
    qualified_name: str
    start_line: int
    end_line: int
    signature: str = ""
    docstring: str = ""
    raw_text: str = ""
    bases: tuple[str, ...] = ()
    complexity: int | None = None
    imports: tuple[str, ...] = ()
    parent: str | None = None


class Edge(NamedTuple):
    source: str
    target: str
    relationship: str


def module_name(path: str) -> str:
    """A path as a dotted name without its extension."""
    stem = path.rsplit(".", 1)[0] if "." in path.rsplit("/", 1)[-1] else path
    return stem.strip("/").replace("/", ".")


# ---- Python -------------------------------------------------------------------------------------------------------

_DECISIONS = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp, ast.Assert, ast.With, ast.AsyncWith)

# Calls to these never name a project's entity; limits of a raw text's bytes.
BLOCKED = {
    "python": """print len range str int float bool list dict set tuple type isinstance issubclass super getattr setattr hasattr delattr
        enumerate zip map filter sorted reversed any all min max sum abs round open format repr id hash iter next input vars dir callable
        classmethod staticmethod property object bytes bytearray memoryview frozenset complex hex oct bin ord chr ascii exec eval compile
        globals locals breakpoint exit quit help __import__ ValueError TypeError KeyError IndexError AttributeError RuntimeError Exception
        NotImplementedError StopIteration OSError IOError""",
    "typescript": """console Math JSON Object Array String Number Boolean Promise setTimeout setInterval clearTimeout clearInterval parseInt
        parseFloat require fetch alert confirm prompt Error TypeError RangeError SyntaxError ReferenceError Map Set WeakMap WeakSet Symbol
        Proxy Reflect RegExp Date Intl URL URLSearchParams TextEncoder TextDecoder atob btoa structuredClone queueMicrotask
        requestAnimationFrame cancelAnimationFrame addEventListener removeEventListener log warn error info debug trace assert""",
    "rust": """println eprintln print eprint format write writeln vec todo unimplemented unreachable assert assert_eq assert_ne panic dbg cfg
        include include_str include_bytes env concat stringify file line column module_path compile_error option_env matches Ok Err Some
        None Box Arc Rc Vec String HashMap HashSet BTreeMap BTreeSet""",
    "go": "append cap clear close complex copy delete imag len make max min new panic print println real recover",
    "swift": """print debugPrint dump fatalError precondition preconditionFailure assert assertionFailure abs min max stride zip type
        unsafeBitCast withUnsafePointer withUnsafeMutablePointer MemoryLayout Mirror Optional Result DispatchQueue NSLog""",
    "elixir": """if unless cond case with try rescue catch after for receive raise throw exit def defp defmodule defmacro defmacrop defguard
        defguardp defprotocol defimpl defstruct defexception defdelegate defoverridable use import alias require quote unquote
        unquote_splicing fn do end when and or not in is_atom is_binary is_bitstring is_boolean is_float is_function is_integer is_list
        is_map is_nil is_number is_pid is_port is_reference is_tuple put_in get_in update_in pop_in inspect to_string to_charlist to_atom
        spawn spawn_link spawn_monitor send self apply""",
}
BLOCKED = {k: frozenset(v.split()) for k, v in BLOCKED.items()}
BLOCKED["tsx"] = BLOCKED["jsx"] = BLOCKED["javascript"] = BLOCKED["typescript"]
RAW_BYTES, SMALL_BYTES = 2048, 512


def cut(text: str, limit: int) -> str:
    """The longest prefix of whole characters with no more than `limit` UTF-8 bytes."""
    return text.encode("utf-8", "replace")[:limit].decode("utf-8", "ignore")


def complexity(node: ast.AST) -> int:
    """One more than the places where control branches: a comprehension counts once, each further operand of and/or too."""
    n, todo = 1, [node]
    while todo:
        x = todo.pop()
        n += isinstance(x, _DECISIONS)
        if isinstance(x, ast.BoolOp):
            n += len(x.values) - 1
        # Decorators stand before a definition, not in it.
        own = getattr(x, "decorator_list", ()) if x is node else ()
        todo += [c for c in ast.iter_child_nodes(x) if not any(c is d for d in own)]
    return n


def _callee(call: ast.Call) -> str | None:
    f = call.func
    return f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None


def _recovered(source: str) -> ast.Module:
    """The syntax tree; a top-level statement that isn't Python is read as blank lines, and the rest goes on."""
    if "\0" in source:
        raise SyntaxError("a source has no NUL")
    lines = source.split("\n")
    for _ in range(len(lines) + 1):
        try:
            return ast.parse("\n".join(lines))
        except SyntaxError as e:
            at = min(max((e.lineno or 1) - 1, 0), len(lines) - 1)
            while at > 0 and (not lines[at].strip() or lines[at][0] in " \t)]}#"):
                at -= 1
            end = at + 1
            while end < len(lines) and (not lines[end].strip() or lines[end][0] in " \t)]}"):
                end += 1
            if not any(x.strip() for x in lines[at:end]):
                raise
            lines[at:end] = [""] * (end - at)
    raise ValueError("not Python")


_STRINGS = r"(?P<q>\"{3}|'{3}).*?(?P=q)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|#[^\n]*"


class _Python:
    """One file's entities and edges."""

    def __init__(self, source: str, path: str):
        tree = _recovered(source)
        self.lines = [line.encode("utf-8", "surrogatepass") for line in source.split("\n")]
        self.module = path.replace("/", ".").removesuffix(".py") if path.endswith(".py") else path
        self.entities = [Entity("file", path, self.module, 0, len(source.splitlines()), raw_text=f"file: {path}")]
        self.edges: list[Edge] = []
        self.walk(tree.body, self.module, False)

    def between(self, a: tuple[int, int], b: tuple[int, int]) -> str:
        """The source from (line, byte) to (line, byte)."""
        rows = self.lines[a[0] - 1 : b[0]]
        rows[-1] = rows[-1][: b[1]]
        rows[0] = rows[0][a[1] :]
        return b"\n".join(rows).decode("utf-8", "replace")

    def text(self, node: ast.AST) -> str:
        return self.between((node.lineno, node.col_offset), (node.end_lineno, node.end_col_offset))

    def docstring(self, body: list[ast.stmt]) -> str:
        """The first statement's string, passes aside, without its quotes."""
        for x in body:
            if isinstance(x, ast.Pass):
                continue
            if isinstance(x, ast.Expr) and isinstance(x.value, ast.Constant) and isinstance(x.value.value, str):
                text = self.text(x.value)
                for quote in ('"""', "'''"):
                    if text.startswith(quote) and text.endswith(quote) and len(text) >= 6:
                        return text[3:-3].strip()
                return text.strip("\"'").strip()
            break
        return ""

    def parameters(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> str:
        """The parameter list as it is written."""
        body = node.body[0]
        text = self.between((node.lineno, node.col_offset), (body.lineno, body.col_offset))
        written, text = text, re.sub(_STRINGS, lambda m: "_" * len(m[0]), text, flags=re.S)
        at, depth = text.index(node.name, text.index("def") + 3) + len(node.name), 0
        for k in range(at, len(text)):
            if text[k] in "([{":
                if not depth and text[k] == "(":
                    at = k
                depth += 1
            elif text[k] in ")]}":
                depth -= 1
                if not depth and text[k] == ")":
                    return written[at : k + 1]
        return "()"

    def add(self, kind: str, name: str, qualified_name: str, node: ast.AST, parent: str, **more) -> None:
        self.entities.append(Entity(kind, name, qualified_name, node.lineno - 1, node.end_lineno - 1, parent=parent, **more))

    def imported(self, node: ast.AST, name: str, target: str) -> None:
        qualified = f"{self.module}.import.{target}"
        self.add("import", name, qualified, node, self.module, imports=(target,))
        self.edges += [Edge(self.module, qualified, "contains"), Edge(self.module, target, "imports")]

    def walk(self, body: list[ast.stmt], scope: str, inside: bool) -> None:
        for node in body:
            if isinstance(node, ast.ClassDef):
                name = f"{scope}.{node.name}"
                bases = tuple(self.text(b) for b in node.bases if isinstance(b, ast.Name | ast.Attribute))
                self.add("class", node.name, name, node, scope, docstring=self.docstring(node.body), raw_text=cut(self.text(node), RAW_BYTES), bases=bases)
                self.edges += [Edge(scope, name, "contains"), *(Edge(name, b, "inherits") for b in bases)]
                self.walk(node.body, name, True)
            elif isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
                name = f"{scope}.{node.name}"
                signature = self.parameters(node) + (f" -> {self.text(node.returns)}" if node.returns else "")
                self.add("method" if inside else "function", node.name, name, node, scope, signature=signature, docstring=self.docstring(node.body), raw_text=cut(self.text(node), RAW_BYTES), complexity=complexity(node))
                calls = (_callee(x) for part in node.body for x in ast.walk(part) if isinstance(x, ast.Call))
                self.edges += [Edge(scope, name, "contains"), *(Edge(name, c, "calls") for c in dict.fromkeys(calls) if c and c not in BLOCKED["python"])]
            elif isinstance(node, ast.Import):
                for a in node.names:
                    if not a.asname:
                        self.imported(node, a.name, a.name)
            elif isinstance(node, ast.ImportFrom) and node.module != "__future__":
                # Renamed names have no node. After leading dots the first name stands for the module.
                names = [a.name for a in node.names if not a.asname and a.name != "*"]
                module = node.module
                if node.level:
                    module, names = (names or [""])[0], names[1:]
                for n in names:
                    self.imported(node, n, f"{module}.{n}")
            elif not inside and isinstance(node, ast.Assign | ast.AnnAssign):
                # The first plain name of two bytes or more on either side of one equals sign.
                sides = [node.targets[0], *([node.value] if len(node.targets) == 1 else [])] if isinstance(node, ast.Assign) else [node.target, node.value]
                for n in [x.id for x in sides if isinstance(x, ast.Name) and len(x.id.encode()) >= 2][:1]:
                    raw = cut(self.text(node), SMALL_BYTES)
                    constant = re.fullmatch("[A-Z][A-Z0-9_]*", n)
                    self.add("constant" if constant else "variable", n, f"{self.module}.{n}", node, self.module, signature=raw, raw_text=raw)
                    self.edges.append(Edge(scope, f"{self.module}.{n}", "contains"))
            elif isinstance(node, ast.TypeAlias):
                self.add("type_alias", node.name.id, f"{self.module}.{node.name.id}", node, self.module, raw_text=cut(self.text(node), SMALL_BYTES))


def python(source: str, path: str) -> tuple[list[Entity], list[Edge]]:
    found = _Python(source, path)
    return found.entities, found.edges


# ---- Other languages ----------------------------------------------------------------------------------------------


class Language(NamedTuple):
    comments: str  # pattern of comments and strings to blank
    declarations: tuple[tuple[str, str], ...]  # (kind, pattern with the groups name and bases, at a line's start)
    branches: str  # pattern of places where control branches
    opens: str = r"\{"
    closes: str = r"\}"


_C = r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'"
_MODS = r"(?:(?:export|default|declare|abstract|async|public|private|protected|static|readonly|override|final|open|internal|fileprivate|mutating|pub(?:\([^)]*\))?|unsafe|const(?=\s+fn)|extern)\s+)*"
_BRANCH = r"\b(?:if|for|while|case|catch|guard)\b|&&|\|\||\?(?![.?:])"

TS = Language(
    _C + r"|`(?:\\.|[^`\\])*`",
    (
        ("class", _MODS + r"(?:class|interface)\s+(?P<name>[\w$]+)(?:<[^{]*?>)?(?:\s+(?:extends|implements)\s+(?P<bases>[^{]+))?"),
        ("type_alias", _MODS + r"type\s+(?P<name>[\w$]+)\s*(?:<[^=]*>)?="),
        ("function", _MODS + r"function\s*\*?\s*(?P<name>[\w$]+)"),
        ("method", _MODS + r"(?:get\s+|set\s+)?(?P<name>(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b)[\w$]+)\s*(?:<[^(]*>)?\([^;{]*\)\s*(?::[^={;]+)?\{"),
        ("variable", _MODS + r"(?:const|let|var)\s+(?P<name>[\w$]+)"),
    ),
    _BRANCH,
)
#: Declarations of each language; kinds as they are for a top-level declaration, methods as they are in a class.
SCANNED: dict[str, Language] = {
    "typescript": TS,
    "tsx": TS,
    "javascript": TS,
    "jsx": TS,
    "rust": Language(
        r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\\n])'",
        (
            ("class", _MODS + r"(?:struct|enum|trait|union)\s+(?P<name>\w+)(?:<[^{;]*?>)?(?:\s*:\s*(?P<bases>[^{;]+))?"),
            ("impl", r"(?:unsafe\s+)?impl(?:<[^{]*?>)?\s+(?:(?P<bases>[\w:<>, ]+?)\s+for\s+)?(?P<name>\w+)"),
            ("module", _MODS + r"mod\s+(?P<name>\w+)\s*(?=\{)"),
            ("function", _MODS + r"fn\s+(?P<name>\w+)"),
            ("variable", _MODS + r"(?:const|static)\s+(?:mut\s+)?(?P<name>[A-Za-z_]\w+)\s*:"),
            ("type_alias", _MODS + r"type\s+(?P<name>\w+)"),
            ("import", _MODS + r"use\s+(?P<name>[^;]+);"),
        ),
        r"\b(?:if|for|while|loop)\b|=>|&&|\|\||\?(?=[;.)])",
    ),
    "go": Language(
        _C + r"|`[^`]*`",
        (
            ("class", r"type\s+(?P<name>\w+)\s+(?:struct|interface)\b"),
            ("type_alias", r"type\s+(?P<name>\w+)\s+=?\s*\w"),
            ("function", r"func\s+(?:\((?:\w+\s+)?\*?(?P<owner>\w+)[^)]*\)\s*)?(?P<name>\w+)"),
            ("constant", r"const\s+(?P<name>\w+)"),
            ("variable", r"var\s+(?P<name>\w+)"),
        ),
        r"\b(?:if|for|case|select)\b|&&|\|\|",
    ),
    "swift": Language(
        r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"",
        (
            ("class", _MODS + r"(?:class|struct|enum|protocol|actor|extension)\s+(?P<name>\w+)(?:<[^{]*?>)?(?:\s*:\s*(?P<bases>[^{]+))?"),
            ("function", _MODS + r"func\s+(?P<name>\w+)"),
            ("type_alias", _MODS + r"typealias\s+(?P<name>\w+)"),
            ("import", r"import[ \t]+(?:\w+[ \t]+)?(?P<name>[\w.]+)"),
            ("variable", _MODS + r"(?:let|var)\s+(?P<name>\w+)"),
        ),
        _BRANCH,
    ),
    "elixir": Language(
        r"#[^\n{]*|\"\"\".*?\"\"\"|\"(?:\\.|[^\"\\])*\"",
        (
            ("class", r"(?:defmodule|defprotocol)\s+(?P<name>[\w.]+)"),
            ("impl", r"defimpl\s+(?P<bases>[\w.]+)\s*,\s*for:\s*(?P<name>[\w.]+)"),
            ("function", r"defp?\s+(?P<name>\w+[?!]?)"),
            ("macro", r"defmacrop?\s+(?P<name>\w+[?!]?)"),
            ("import", r"(?:use|import|alias|require)\s+(?P<name>[A-Z][\w.]*)"),
            ("type_alias", r"@typep?\s+(?P<name>\w+)"),
            ("constant", r"@(?P<name>(?!doc\b|moduledoc\b|spec\b|type\b|typep\b|impl\b|callback\b|behaviour\b)\w+)\s+\S"),
        ),
        r"\b(?:if|unless|case|cond|for|rescue|with)\b|->|\band\b|\bor\b|&&|\|\|",
        r"\bdo\b(?!:)|\bfn\b",
        r"\bend\b",
    ),
    "bash": Language(
        r"(?<!\$)#[^\n]*|'[^']*'",
        (
            ("function", r"(?:function\s+(?P<name>[\w:-]+)|(?P<name2>[\w:-]+)\s*\(\s*\))"),
            ("import", r"(?:source|\.)\s+(?P<name>[^\s;]+)"),
            ("variable", r"(?:export\s+|readonly\s+|declare\s+(?:-\w+\s+)?|local\s+)?(?P<name>[A-Za-z_]\w*)="),
        ),
        r"\b(?:if|elif|for|while|until)\b|;;|&&|\|\|",
    ),
}


def blanked(source: str, pattern: str) -> str:
    """source with what the pattern finds turned to spaces, line breaks kept."""
    return re.sub(pattern, lambda m: re.sub(r"[^\n]", " ", m[0]), source, flags=re.S)


def _uses(path: str) -> list[str]:
    """The names of a use declaration: braces multiply, `self` is the path before them, `as` is left out."""
    path = re.sub(r"\s+as\s+\w+", "", path).strip()
    at = path.find("{")
    if at < 0:
        return [path]
    out, depth, item = [], 0, ""
    for ch in path[at + 1 : path.rfind("}")] + ",":
        depth += (ch == "{") - (ch == "}")
        if ch == "," and not depth:
            if item.strip():
                out += [path[:at].removesuffix("::") if n == "self" else path[:at] + n for n in _uses(item.strip())]
            item = ""
        else:
            item += ch
    return out


# Languages whose capital names are constants, and kinds that nothing contains.
UPPER = ("typescript", "tsx", "javascript", "jsx", "rust", "bash")
ALONE = {"rust": ("type_alias",), "swift": ("type_alias", "variable"), "elixir": ("type_alias", "constant")}
#: What may stand before an opening parenthesis without being called.
KEYWORDS = frozenset("if for while switch catch return function func fn def defp match guard sizeof typeof await async new else in is as where unless cond case with do super init constructor self".split())
CALL = re.compile(r"(?P<dot>(?:\.|::|\?\.)\s*)?(?P<name>[A-Za-z_$][\w$]*[?!]?)\s*(?:::)?(?:<[\w\s,:<>]*>)?\(")


def calls(body: str, language: str) -> list[tuple[str, bool]]:
    """(name, whether it stands alone) of what a blanked body calls, each once: the last name before a parenthesis.

    A name in front of `!` (a macro) isn't a call, nor is a declaration's own name.
    """
    found = {}
    for m in CALL.finditer(body):
        name = m["name"]
        if language == "rust" and name.endswith("!") or language != "elixir" and name[-1] in "?!":
            continue
        before = body[: m.start()].rstrip()
        if name in KEYWORDS and not m["dot"] or name in BLOCKED.get(language, ()) or re.search(r"\b(?:function|func|fn|defp?|defmacrop?)$", before):
            continue
        found.setdefault((name, not m["dot"]))
    return list(found)


def scanned(source: str, path: str, language: str) -> tuple[list[Entity], list[Edge]]:
    spec = SCANNED[language]
    clean, module = blanked(source, spec.comments), module_name(path)
    package = re.search(r"^package\s+(\w+)", clean, re.M) if language == "go" else None
    if package:
        module = ".".join([*module.split(".")[:-1], package[1]])
    lines = source.split("\n")
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line) + 1)
    entities = [Entity("file", path, module_name(path), 0, len(source.splitlines()), raw_text=f"file: {path}")]
    edges: list[Edge] = []
    if package:
        at = source.count("\n", 0, package.start())
        entities.append(Entity("module", package[1], module, at, at, package[0], raw_text=package[0], parent=module_name(path)))
        edges.append(Edge(module_name(path), module, "contains"))
    token = re.compile(rf"(?P<open_>{spec.opens})|(?P<close_>{spec.closes})")
    found = []
    for kind, pattern in spec.declarations:
        for m in re.finditer(rf"^[ \t]*(?:@\w+(?:\([^)]*\))?\s+)*{pattern}", clean, re.M):
            found.append((m.start() + len(m[0]) - len(m[0].lstrip()), kind, m))
    found.sort(key=lambda x: x[0])
    taken, scopes = set(), []  # scopes: (name, kind, depth)
    marks = sorted([(m.start(), 1 if m["open_"] else -1) for m in token.finditer(clean)])
    k = depth = 0
    for at, kind, m in found:
        line = clean.count("\n", 0, at)
        if line in taken:
            continue
        while k < len(marks) and marks[k][0] < at:
            depth += marks[k][1]
            k += 1
            while scopes and depth <= scopes[-1][2]:
                scopes.pop()
        groups = m.groupdict()
        name = (groups.get("name") or groups.get("name2") or "").strip()
        outer = scopes[-1] if scopes else None
        if not name or outer and outer[1] in ("function", "method") or depth > (outer[2] + 1 if outer else 0):
            continue  # what stands inside a function has no node
        bases = tuple(b.strip() for b in re.split(r"[,+]|\bimplements\b|\bextends\b", groups.get("bases") or "") if b.strip())
        held = outer and outer[1] in ("class", "impl")
        if kind == "method" and not held:
            continue
        taken.add(line)
        scope = outer[0] if outer else module
        # The declaration's end: where its first brace closes, or its line's end.
        level, end, opened = 0, starts[min(line + 1, len(starts) - 1)] - 1, False
        for p, d in marks[k:]:
            if not opened and p >= end and language != "elixir" and clean[m.end() : p].strip(" \t\n(){}:,<>-=>&*[]._'|?!" + "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"):
                break
            if not opened and (";" in clean[m.end() : p] or kind in ("variable", "constant", "import", "type_alias")):
                break
            level += d
            opened = True
            if level <= 0:
                end = p
                break
        last = clean.count("\n", 0, min(end, len(clean)))
        raw = source[at : max(end + 1, m.end())]
        owner = groups.get("owner")
        if owner:  # a receiver's type
            scope = f"{module}.{owner}"
        real = {"impl": "class", "macro": "function", "function": "method" if held or owner else "function"}.get(kind, kind)
        if real == "variable" and language in UPPER and re.fullmatch("[A-Z][A-Z0-9_]*", name):
            real = "constant"
        for one in _uses(name) if language == "rust" and kind == "import" else [name]:
            own = one if language == "elixir" and kind == "class" else f"{module}.import.{one}" if kind == "import" and language != "bash" else f"{scope}.{one}"
            if kind == "impl":
                own = f"{bases[0]}.{name}" if language == "elixir" and bases else f"{module}.{name}"
                edges.extend(Edge(name if language == "elixir" else own, b, "implements") for b in bases)
            if kind != "impl" or language == "elixir":
                body = blanked(raw, spec.comments)
                works = real in ("function", "method")
                entities.append(Entity(real, one, own, line, last, raw.split("\n")[0].rstrip(" {"), "", cut(raw, RAW_BYTES), () if kind == "impl" else bases, 1 + len(re.findall(spec.branches, body)) if works else None, (one,) if kind == "import" else (), scope))
                if works and language in BLOCKED:
                    # What a method's head calls itself is its declaration.
                    head = body.find("do" if language == "elixir" else "{")
                    for name_, alone in calls(body[head:] if head >= 0 else "", language):
                        edges.append(Edge(own, f"{module}.{name_}" if language == "go" and alone else name_, "calls"))
                if kind == "import":
                    if language != "bash":
                        edges.append(Edge(module, own, "contains"))
                    edges.append(Edge(module, one, "imports"))
                elif kind not in ALONE.get(language, ()):
                    edges.append(Edge(scope, own, "contains"))
                if kind == "class":
                    edges.extend(Edge(own, b, "inherits") for b in bases)
        if opened:
            scopes.append((own, kind, depth))
    if language in ("typescript", "tsx", "javascript", "jsx"):
        for m in re.finditer(r"""^\s*import\s+(?:[^'"]*?\sfrom\s+)?['"]([^'"]+)['"]""", source, re.M):
            line = source.count("\n", 0, m.end())
            own = f"{module}.import.{m[1]}"
            entities.append(Entity("import", m[1], own, line, line, imports=(m[1],), parent=module))
            edges += [Edge(module, own, "contains"), Edge(module, m[1], "imports")]
    if language == "go":
        _go_members(clean, source, module, entities, edges)
        for m in re.finditer(r"""^import\s+(?P<one>(?:[\w.]+\s+)?"[^"]+")|^import\s*\((?P<many>[^)]*)\)""", source, re.M):
            part = "one" if m["one"] else "many"
            for spec_ in re.finditer(r'(?:([\w.]+)\s+)?"([^"]+)"', m[part]):
                # An import is known by its own name here; its entity and both of its edges have that.
                name, line = spec_[1] or spec_[2].rsplit("/", 1)[-1], source.count("\n", 0, m.start(part) + spec_.start())
                own = f"{module_name(path)}.import.{name}"
                entities.append(Entity("import", name, own, line, line, spec_[0], imports=(spec_[2],), parent=module))
                edges += [Edge(module, own, "contains"), Edge(module, own, "imports")]
    return entities, edges


def _go_members(clean: str, source: str, module: str, entities: list[Entity], edges: list[Edge]) -> None:
    """Fields and embedded types of structs, methods and embedded types of interfaces."""
    for m in re.finditer(r"^type\s+(\w+)(?:\[[^\]]*\])?\s+(struct|interface)\s*\{", clean, re.M):
        own, level, end = f"{module}.{m[1]}", 1, m.end()
        while end < len(clean) and level:
            level += (clean[end] == "{") - (clean[end] == "}")
            end += 1
        at = m.end()
        for line in clean[m.end() : end - 1].split("\n"):
            row, text = source.count("\n", 0, at), line.strip()
            at += len(line) + 1
            if base := re.fullmatch(r"\*?(?:\w+\.)?(\w+)(?:\[[^\]]*\])?", text):
                edges.append(Edge(own, base[1], "inherits"))
            elif m[2] == "interface" and (method := re.match(r"(\w+)\s*\(", text)):
                entities.append(Entity("method", method[1], f"{own}.{method[1]}", row, row, text, raw_text=text, parent=own))
                edges.append(Edge(own, f"{own}.{method[1]}", "contains"))
            elif m[2] == "struct" and (fields := re.match(r"(\w+(?:\s*,\s*\w+)*)\s+\S", text)):
                for name in re.split(r"\s*,\s*", fields[1]):
                    entities.append(Entity("variable", name, f"{own}.{name}", row, row, text, raw_text=text, parent=own))
                    edges.append(Edge(own, f"{own}.{name}", "contains"))


def css(source: str, path: str) -> tuple[list[Entity], list[Edge]]:
    """Selectors of top-level rules and of at-rules' bodies, each once; keyframes, custom properties, imports."""
    clean, module = blanked(source, r"/\*.*?\*/"), module_name(path)
    entities, edges = [Entity("file", path, module, 0, len(source.splitlines()), raw_text=f"file: {path}")], []
    seen: set[str] = set()

    def add(kind: str, name: str, at: int, end: int) -> None:
        entities.append(Entity(kind, name, f"{module}.{name}", source.count("\n", 0, at), source.count("\n", 0, end), raw_text=cut(source[at:end], SMALL_BYTES), parent=module))
        edges.append(Edge(module, f"{module}.{name}", "contains"))

    def walk(lo: int, hi: int) -> None:
        at = lo
        for m in re.finditer(r"[;{]", clean[lo:hi]):
            p = lo + m.start()
            if p < at:
                continue
            head = clean[at:p].strip()
            if m[0] == ";":
                if i := re.match(r"@import\s+(?:url\()?\s*['\"]?([^'\")\s;]+)", head):
                    entities.append(Entity("import", i[1], f"{module}.import.{i[1]}", source.count("\n", 0, p), source.count("\n", 0, p), imports=(i[1],), parent=module))
                    edges.append(Edge(module, i[1], "imports"))
                at = p + 1
                continue
            level, end = 1, p + 1
            while end < hi and level:
                level += (clean[end] == "{") - (clean[end] == "}")
                end += 1
            if k := re.match(r"@(?:-\w+-)?keyframes\s+([\w-]+)", head):
                add("function", k[1], at + len(clean[at:p]) - len(clean[at:p].lstrip()), end)
            elif head.startswith("@"):
                walk(p + 1, end - 1)
            else:
                for s in re.findall(r"[.#][A-Za-z_-][\w-]*", re.sub(r"\[[^\]]*\]", "", head)):
                    if s not in seen:
                        seen.add(s)
                        add("class", s, at, end)
                own = re.sub(r"\{[^{}]*\}", "", clean[p + 1 : end - 1])
                for v in re.finditer(r"(?:^|[;\s])(--[\w-]+)\s*:", own):
                    add("variable", v[1], p, end)
            at = end

    walk(0, len(clean))
    return entities, edges


def parse(source: str, path: str) -> tuple[str, list[Entity], list[Edge]] | None:
    """(language, entities, edges), or nothing for an extension without a parser."""
    language = LANGUAGES.get(path.rsplit(".", 1)[-1].lower()) if "." in path else None
    if language is None:
        return None
    found = python(source, path) if language == "python" else css(source, path) if language == "css" else scanned(source, path, language)
    return language, *found


ENTITY = "file string, pos int, language string, kind string, name string, qualified_name string, start_line int, end_line int, signature string, docstring string, raw_text string, bases array<string>, imports array<string>, complexity int, parent string, error string"


def parse_files(files: DataFrame) -> DataFrame:
    """Files (path, content) as entities; a file that fails is a row with an error, one without a parser none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    found = parse(content, path)
                except (SyntaxError, ValueError, RecursionError) as e:
                    rows.append((path, 0, None, "error", None, None, 0, 0, None, None, None, None, None, None, None, type(e).__name__))
                    continue
                if found:
                    rows += [(path, k, found[0], e.kind, e.name, e.qualified_name, e.start_line, e.end_line, e.signature, e.docstring, e.raw_text, list(e.bases), list(e.imports), e.complexity, e.parent, None) for k, e in enumerate(found[1])]
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in ENTITY.split(", ")])

    return files.select("path", "content").mapInPandas(run, ENTITY)


def parse_edges(files: DataFrame) -> DataFrame:
    """Files (path, content) as edges between qualified names."""
    schema = "file string, pos int, language string, source_qualified_name string, target_qualified_name string, relationship string, weight double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    found = parse(content, path)
                except (SyntaxError, ValueError, RecursionError):
                    continue
                if found:
                    rows += [(path, k, found[0], *e, 1.0) for k, e in enumerate(found[2])]
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in schema.split(", ")])

    return files.select("path", "content").mapInPandas(run, schema)


#: One source of each language for a number and a name, as a format.
SAMPLES = {
    "py": 'import os\nfrom a.b import c\nfrom . import d, e\n\nLIMIT = 3\n\nclass K{n}(Base):\n    """Doc."""\n\n    def go(self, x):\n        if x and self:\n            return helper(x)\n\ndef {w}(y):\n    return K{n}(y)\n',
    "ts": "import {{ a }} from './m';\nexport interface I{n} {{ x: number }}\nexport class K{n} extends Base {{\n  go(x: number): void {{ if (x) {{ y(); }} }}\n}}\nexport function {w}() {{}}\nconst v{n} = 1;\n",
    "rs": "use std::{{fmt, io::{{self, Read}}}};\npub struct K{n} {{ x: i32 }}\ntrait T{n}: Clone {{}}\nimpl T{n} for K{n} {{\n    fn go(&self) {{ if true {{}} }}\n}}\npub fn {w}() -> i32 {{ 1 }}\nconst LIMIT: i32 = 3;\n",
    "go": 'package main\n\nimport "fmt"\n\ntype K{n} struct {{\n\tx int\n}}\n\nfunc (k K{n}) Go() {{\n\tif true {{\n\t}}\n}}\n\nfunc {w}() {{}}\n',
    "swift": "import UIKit\n\nclass K{n}: Base {{\n    var x = 1\n    func go() {{}}\n}}\n\nfunc {w}() {{}}\n",
    "ex": "defmodule K{n} do\n  use GenServer\n  @limit 3\n\n  def {w}(x) do\n    x\n  end\n\n  defp other(y), do: y\nend\n",
    "sh": "source ./lib.sh\nLIMIT=3\n{w}() {{\n  if [ $1 ]; then echo $2; fi\n}}\n",
    "css": "@import 'a.css';\n:root {{ --c{n}: red; }}\n.k{n}, #id{n} {{ color: var(--c{n}); }}\n@keyframes {w} {{ from {{ top: 0 }} }}\n@media print {{ .p{n} {{ top: 0 }} }}\n",
}


def samples(part: DataFrame) -> DataFrame:
    """A generated source file (path, content) for each part, the languages in turn."""
    kinds = list(SAMPLES)
    word = F.regexp_replace(F.lower("p_name"), "[^a-z]+", "_")
    number = F.col("p_partkey").cast("string")
    which = (F.col("p_partkey") % len(kinds)).cast("int")
    template = F.element_at(F.array(*[F.lit(SAMPLES[k].replace("{{", "\1").replace("}}", "\2")) for k in kinds]), which + 1)
    content = template
    for mark, value in (("{n}", number), ("{w}", word), ("\1", F.lit("{")), ("\2", F.lit("}"))):
        content = F.replace(content, F.lit(mark), value)
    return part.select(F.concat(F.lit("src/f"), number, F.lit("."), F.element_at(F.array(*[F.lit(k) for k in kinds]), which + 1)).alias("path"), content.alias("content"))
