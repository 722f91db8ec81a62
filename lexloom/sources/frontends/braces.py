"""Front end for languages with braces: TypeScript, JavaScript, Rust.

A tokeniser drops strings and comments (remembering documentation), then declarations are found by shape and scoped by
counting braces. It reads declarations, parameters, calls and imports; expressions are not modelled.
"""

from __future__ import annotations

import re

from ...functions.text import dedent, strip_line_doc
from ...schemas import RELATIONS

_DROPPED = r"""(?P<doc>/\*\*.*?\*/|(?:^[ \t]*//[/!][^\n]*\n?)+)|(?P<note>/\*.*?\*/|//[^\n]*)|(?P<text>"(?:\\.|[^"\\\n])*"|`(?:\\.|[^`\\])*`|%s)"""
#: A quote in Rust begins a character or a lifetime; only the first is a text.
_SKIP = {True: re.compile(_DROPPED % r"(?<!\w)'(?:\\[^'\n]+|[^'\\\n])'", re.S | re.M), False: re.compile(_DROPPED % r"(?<![\w&])'(?:\\.|[^'\\\n])*'", re.S | re.M)}
_NAME = r"[A-Za-z_$][\w$]*"
_GENERIC = r"\s*"  # generic arguments are blanks by then
_ANGLE = re.compile(r"(?<=[\w:])<|(?<=[=(,])\s*<(?=\s*[A-Z])|(?<=\basync)\s*<")
_SCRIPT = re.compile(
    rf"""(?P<import>\bimport\b(?P<what>[^;'"\n]*?)(?:from\s*)?\x00(?P<mod>\d+)\x00)
    |(?:\b(?:abstract\s+)?class\s+(?P<class>{_NAME}){_GENERIC}(?:\s+extends\s+(?P<ext>[\w$.]+){_GENERIC})?(?:\s+implements\s+(?P<impl>[\w$.,\s<>]+?))?\s*(?=\{{))
    |(?:\binterface\s+(?P<interface>{_NAME}))|(?:\btype\s+(?P<alias>{_NAME}){_GENERIC}\s*=)
    |(?:\bfunction\s*\*?\s*(?P<function>{_NAME}){_GENERIC}\s*(?=\())
    |(?:\b(?:const|let|var)\s+(?P<arrow>{_NAME})\s*(?::[^=;\n]+)?=\s*(?:async\s*)?(?=\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?::[^=\n]+)?=>))
    |(?:\b(?:const|let|var)\s+(?P<variable>{_NAME}))
    |(?P<decorator>@{_NAME}(?:\.{_NAME})*)
    |(?:\bthis\.(?P<attr>{_NAME})\s*=(?!=))""",
    re.X,
)
_METHOD = re.compile(rf"(?:^|[;{{}}\n])\s*(?:(?:public|private|protected|static|async|readonly|override|get|set)\s+)*(?P<name>#?{_NAME}){_GENERIC}\s*(?=\()", re.M)
_FIELD = re.compile(rf"^\s*(?:(?:public|private|protected|static|readonly)\s+)*(?P<name>{_NAME})[?!]?\s*(?::\s*(?P<type>[\w$.]+)[^=;\n(]*)?(?:=[^=>]|;)", re.M)
_RUST = re.compile(
    rf"""(?:\bfn\s+(?P<function>{_NAME}){_GENERIC}\s*(?=\())|(?:\bstruct\s+(?P<class>{_NAME}))|(?:\benum\s+(?P<enum>{_NAME}))|(?:\btrait\s+(?P<trait>{_NAME}))
    |(?:(?m:^)[ \t]*(?:unsafe[ ]+|default[ ]+)*impl\b{_GENERIC}(?:(?P<of>[\w:]+){_GENERIC}\s+for\s+)?(?P<impl>[\w:]+){_GENERIC}[^{{;]*(?=\{{))
    |(?:\b(?:const|static)\s+(?:mut\s+)?(?P<variable>{_NAME})\s*:)|(?:\btype\s+(?P<alias>{_NAME}){_GENERIC}\s*=)|(?:\blet\s+(?:mut\s+)?(?P<let>{_NAME}))
    |(?:\buse\s+(?P<use>[^;]+);)|(?:\bself\.(?P<attr>{_NAME})\s*=(?!=))""",
    re.X,
)
_CALL = re.compile(rf"(?<![\w$.])((?:{_NAME}(?:\.|::))*{_NAME})(!?)\s*(?:::\s+)?(?=\()")
_KEYWORDS = set("if for while switch catch return function typeof match fn new await async else loop super in of let const var class extends struct enum impl trait pub where Fn FnMut FnOnce".split())


def _without_generics(code: str) -> str:
    """The code with generic parameters and arguments as blanks, whatever they hold: bounds, arrows, lifetimes, other ones."""
    out = list(code)
    at = 0
    while m := _ANGLE.search(code, at):
        first, depth, end = m.end() - 1, 0, None
        for i in range(first, min(len(code), first + 600)):
            c = code[i]
            if c == "<":
                depth += 1
            elif c == ">" and code[i - 1] not in "-=":
                depth -= 1
                if not depth:
                    end = i
                    break
            elif c in ";{}" or code.startswith(("&&", "||"), i):
                break
        at = m.end()
        if end is not None:
            for i in range(first, end + 1):
                if out[i] != "\n":
                    out[i] = " "
            at = end + 1
    return "".join(out)


def _clean(text: str, rust: bool) -> tuple[str, list[str], list[tuple[int, str]]]:
    """The text with strings as \\x00number\\x00 and comments as blanks, the strings, and documentation by where it ends."""
    strings: list[str] = []
    docs: list[tuple[int, str]] = []

    def put(m: re.Match) -> str:
        raw = m[0]
        if m["text"] is not None:
            strings.append(raw[1:-1])
            return f"\x00{len(strings) - 1}\x00" + "\n" * raw.count("\n")
        if m["doc"] is not None:
            docs.append((text.count("\n", 0, m.end()), strip_line_doc(raw.strip())))
        return re.sub(r"[^\n]", " ", raw)

    return _SKIP[rust].sub(put, text), strings, docs


def _closing(text: str, at: int) -> int:
    """Where the bracket at ``at`` closes."""
    pairs, depth = {"(": ")", "{": "}", "[": "]"}, 0
    a, b = text[at], pairs[text[at]]
    for i in range(at, len(text)):
        depth += (text[i] == a) - (text[i] == b)
        if depth == 0:
            return i
    return len(text) - 1


def _params(raw: str) -> list[dict]:
    out, depth, part = [], 0, ""
    for c in raw + ",":
        depth += (c in "<([{") - (c in ">)]}")
        if c == "," and depth <= 0:
            p = re.sub(rf"^\s*(?:@\w+(?:\([^()]*\))?\s*)?(?:(?:public|private|protected|readonly|mut)\s+)*(?:\.\.\.)?", "", part).strip()
            if m := re.match(rf"(&?\s*(?:'\w+\s+)?(?:mut\s+)?{_NAME})\??\s*(?::\s*([^=]+?))?\s*(?:=\s*(.+))?$", p, re.S):
                name = re.sub(r"^&?\s*(?:'\w+\s+)?(?:mut\s+)?", "", m[1])
                if name not in ("self", "this"):
                    out.append({"name": name, "type_annotation": m[2].strip() if m[2] else None, "default": m[3].strip() if m[3] else None})
            depth, part = 0, ""
        else:
            part += c
    return out


def parse(text: str, path: str, language: str) -> dict[str, list[dict]]:
    rust = language == "rust"
    out: dict[str, list[dict]] = {k: [] for k in RELATIONS}
    code, strings, docs = _clean(text, rust)
    flat = _without_generics(code)
    lines = text.split("\n")
    line_of = lambda at: code.count("\n", 0, at) + 1
    doc_at = {line: t for line, t in docs}
    out["doc_texts"] = [{"file": path, "line": line, "text": t} for line, t in docs]
    first_doc = lambda line: next((doc_at[x].split("\n")[0] for x in (line - 1, line - 2) if x in doc_at), None)
    out["nesting"].append({"file": path, "node_id": 0, "parent_id": None, "depth": 0, "kind": "Module", "name": path, "line": 1})
    spans: list[tuple[int, int, str, str, int]] = []  # from, to, name, kind, node

    def scope(at: int) -> list[tuple[int, int, str, str, int]]:
        return sorted(s for s in spans if s[0] <= at <= s[1])

    def dotted(at: int) -> str | None:
        return ".".join(s[2] for s in scope(at)) or None

    def ident(name: str, kind: str, at: int, inner: str | None = None) -> None:
        out["identifiers"].append({"name": name, "entity_type": kind, "file": path, "line": line_of(at), "scope": inner or dotted(at)})

    def nest(kind: str, name: str, at: int) -> int:
        above = scope(at)
        out["nesting"].append({"file": path, "node_id": len(out["nesting"]), "parent_id": above[-1][4] if above else 0, "depth": len(above) + 1, "kind": kind, "name": name, "line": line_of(at)})
        return len(out["nesting"]) - 1

    classes: dict[str, dict] = {}

    def klass(name: str, at: int, bases: list[str], kind: str = "Class") -> dict:
        ident(name, kind, at)
        row = classes.setdefault(name, {"name": name, "bases": [], "methods": [], "attributes": [], "docstring_first_line": first_doc(line_of(at)), "file": path, "line": line_of(at)})
        row["bases"] += [b for b in bases if b]
        node, open_at = nest("Class", name, at), code.find("{", at)
        end = code.find(";", at)
        if open_at >= 0 and not (rust and 0 <= end < open_at):
            spans.append((open_at, _closing(code, open_at), name, "class", node))
        return row

    def function(name: str, at: int, paren: int, decorators: list[str]) -> None:
        above = scope(at)
        ident(name, "Function", at)
        close = _closing(code, paren)
        params = _params(code[paren + 1 : close])
        tail = re.match(r"\s*(?:->|:)\s*([^{;=]+?)\s*(?:where\b[^{]*)?(?=\{|;|=>|$)", code[close + 1 : close + 400]) if code[close + 1 : close + 400].lstrip()[:2] else None
        outer = ".".join(s[2] for s in above) or None
        method = bool(above) and above[-1][3] == "class"
        out["signatures"].append({"name": name, "params": params, "return_type": tail[1].strip() if tail else None, "decorators": decorators, "docstring_first_line": first_doc(line_of(at)), "file": path, "line": line_of(at), "scope": outer})
        inner = f"{outer}.{name}" if outer else name
        for p in params:
            ident(p["name"], "Parameter", paren, inner)
            if p["type_annotation"] and not rust and (m := re.match(r"[\w$.]+", p["type_annotation"])):
                ident(m[0], "TypeAnnotation", paren, inner)
        if method and above[-1][2] in classes and name not in classes[above[-1][2]]["methods"]:
            classes[above[-1][2]]["methods"].append(name)
        node = nest("Method" if method else "Function", name, at)
        body = re.compile(r"[^;{]*?\{").match(code, close + 1)
        if body:
            end = _closing(code, body.end() - 1)
            spans.append((body.end() - 1, end, name, "function", node))
            a, b = line_of(body.end()), line_of(end)
            out["bodies"].append({"entity_name": name, "scope": outer, "body_text": dedent("\n".join(lines[a : max(b - 1, a)])) if b > a else text.split("\n")[a - 1].strip(), "language": language, "file": path, "start_line": a, "end_line": b})

    seen: set[int] = set()
    pending: list[str] = []
    for m in (_RUST if rust else _SCRIPT).finditer(flat):
        g, at = m.groupdict(), m.start()
        seen.add(m.end())
        if rust:
            if g["function"]:
                function(g["function"], at, m.end(), [])
            elif g["class"] or g["enum"]:
                klass(g["class"] or g["enum"], at, [])
            elif g["trait"]:
                klass(g["trait"], at, [], "Interface")
            elif g["impl"]:
                name = g["impl"].split("::")[-1]
                row = classes.setdefault(name, {"name": name, "bases": [], "methods": [], "attributes": [], "docstring_first_line": None, "file": path, "line": line_of(at)})
                if g["of"]:
                    row["bases"].append(g["of"].split("::")[-1])
                spans.append((m.end(), _closing(code, m.end()), name, "class", nest("Class", name, at)))
            elif g["use"]:
                for module, symbol, alias in _flat_use(re.sub(r"\s+", " ", g["use"]).strip()):
                    out["imports"].append({"source_module": module, "imported_symbols": [symbol], "alias": alias, "file": path, "line": line_of(at)})
            elif g["alias"]:
                ident(g["alias"], "TypeAlias", at)
            elif g["variable"] or g["let"]:
                ident(g["variable"] or g["let"], "Variable", at)
            elif g["attr"]:
                ident(g["attr"], "Attribute", at)
            continue
        if g["import"]:
            what = (g["what"] or "").replace("type ", "").strip()
            star = re.search(rf"\*\s*as\s+({_NAME})", what)
            named = re.search(r"\{([^}]*)\}", what)
            default = re.match(rf"({_NAME})", what)
            symbols = ([default[1]] if default else []) + (["*"] if star else []) + ([x.split(" as ")[0].strip() for x in named[1].split(",") if x.strip()] if named else [])
            out["imports"].append({"source_module": strings[int(g["mod"])], "imported_symbols": symbols, "alias": star[1] if star else None, "file": path, "line": line_of(at)})
        elif g["class"]:
            row = klass(g["class"], at, [g["ext"], *(x.strip() for x in (g["impl"] or "").split(","))])
            lo, hi = spans[-1][0], spans[-1][1]
            row["attributes"] = list(dict.fromkeys([x["name"] for x in _FIELD.finditer(_top(code[lo + 1 : hi]))] + re.findall(rf"\bthis\.({_NAME})\s*=(?!=)", code[lo:hi])))
            for f in _FIELD.finditer(_top(code[lo + 1 : hi])):
                ident(f["name"], "Attribute", lo + 1 + f.start("name"), g["class"])
            for x in _METHOD.finditer(_top(flat[lo + 1 : hi])):
                if x["name"] not in _KEYWORDS:
                    seen.add(lo + 1 + x.end())
                    function(x["name"], lo + 1 + x.start("name"), lo + 1 + x.end(), [])
        elif g["interface"]:
            ident(g["interface"], "Interface", at)
        elif g["alias"]:
            ident(g["alias"], "TypeAlias", at)
        elif g["function"] or g["arrow"]:
            function(g["function"] or g["arrow"], at, m.end(), pending)
            pending = []
        elif g["variable"]:
            ident(g["variable"], "Variable", at)
        elif g["decorator"]:
            ident(g["decorator"][1:], "Decorator", at)
            pending = [*pending, g["decorator"][1:]]
        elif g["attr"]:
            ident(g["attr"], "Attribute", at)
    declared = seen
    for m in _CALL.finditer(flat):
        if m[1].split(".")[0] in _KEYWORDS or m.end() in declared or re.search(r"\b(?:fn|function)\s*\*?\s*$", code[max(0, m.start() - 12) : m.start()]):
            continue
        callee = m[1].split("::")[-1] + m[2] if rust else m[1]
        out["call_sites"].append({"caller_scope": dotted(m.start()), "callee": callee, "file": path, "line": line_of(m.start())})
    out["classes"] = list(classes.values())
    return out


def _top(body: str) -> str:
    """A class body with nested blocks blanked out."""
    out, depth = [], 0
    for c in body:
        if c == "}":
            depth -= 1
        out.append(c if depth == 0 or c == "\n" else " ")
        if c == "{":
            depth += 1
    return "".join(out)


def _flat_use(tree: str, prefix: str = "") -> list[tuple[str, str, str | None]]:
    """(module, symbol, alias) of each leaf of a use tree."""
    tree = tree.strip()
    if m := re.match(r"^(.*?)\{(.*)\}$", tree, re.S):
        parts, depth, part = [], 0, ""
        for c in m[2] + ",":
            depth += (c == "{") - (c == "}")
            if c == "," and depth == 0:
                parts.append(part)
                part = ""
            else:
                part += c
        return [x for p in parts if p.strip() for x in _flat_use(p, prefix + m[1])]
    full, _, alias = (prefix + tree).partition(" as ")
    module, _, symbol = full.strip().rpartition("::")
    return [(module, symbol, alias.strip() or None)]
