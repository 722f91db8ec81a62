"""Python front end on the interpreter's own syntax tree."""

from __future__ import annotations

import ast

from ...functions.text import dedent
from ...schemas import RELATIONS

FUNCTION = (ast.FunctionDef, ast.AsyncFunctionDef)


def _annotation_names(node: ast.AST | None) -> list[str]:
    """The type an annotation names: a subscript's outer type, a dotted name whole."""
    if node is None:
        return []
    if isinstance(node, ast.Subscript):
        return _annotation_names(node.value)
    if isinstance(node, ast.Name | ast.Attribute):
        return [ast.unparse(node)]
    if isinstance(node, ast.Constant) and isinstance(node.value, str):
        return [node.value]
    return []


class _Reader(ast.NodeVisitor):
    def __init__(self, text: str, path: str):
        self.lines, self.path = text.split("\n"), path
        self.out: dict[str, list[dict]] = {k: [] for k in RELATIONS}
        self.scope: list[str] = []
        self.stack = [0]
        self.nodes = 0
        self.inside: list[str] = []

    def ident(self, name: str, kind: str, line: int) -> None:
        self.out["identifiers"].append({"name": name, "entity_type": kind, "file": self.path, "line": line, "scope": ".".join(self.scope) or None})

    def doc(self, node: ast.AST, line: int) -> str | None:
        text = ast.get_docstring(node)
        if text:
            self.out["doc_texts"].append({"file": self.path, "line": line, "text": text})
            return text.split("\n")[0]
        return None

    def nest(self, kind: str, name: str, line: int) -> int:
        self.nodes += 1
        self.out["nesting"].append({"file": self.path, "node_id": self.nodes, "parent_id": self.stack[-1], "depth": len(self.stack), "kind": kind, "name": name, "line": line})
        return self.nodes

    def read(self, tree: ast.Module) -> None:
        self.out["nesting"].append({"file": self.path, "node_id": 0, "parent_id": None, "depth": 0, "kind": "Module", "name": self.path, "line": 1})
        self.doc(tree, 1)
        self.generic_visit(tree)

    def types(self, node: ast.AST | None, line: int) -> None:
        for name in _annotation_names(node):
            self.ident(name, "TypeAnnotation", line)

    def function(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        self.ident(node.name, "Function", node.lineno)
        a = node.args
        plain = [*a.posonlyargs, *a.args]
        defaults = dict(zip([x.arg for x in reversed(plain)], reversed(a.defaults), strict=False)) | {x.arg: d for x, d in zip(a.kwonlyargs, a.kw_defaults, strict=True) if d}
        every = [*plain, *([a.vararg] if a.vararg else []), *a.kwonlyargs, *([a.kwarg] if a.kwarg else [])]
        kept = [p for p in every if p.arg not in ("self", "cls")]
        decorators = [ast.unparse(x) for x in node.decorator_list]
        outer = ".".join(self.scope) or None
        at = self.nest("Method" if self.inside and self.inside[-1] == "class" else "Function", node.name, node.lineno)
        first = self.doc(node, node.lineno)
        self.out["signatures"].append(
            {
                "name": node.name, "params": [{"name": p.arg, "type_annotation": ast.unparse(p.annotation) if p.annotation else None, "default": ast.unparse(defaults[p.arg]) if p.arg in defaults else None} for p in kept],
                "return_type": ast.unparse(node.returns) if node.returns else None, "decorators": decorators, "docstring_first_line": first, "file": self.path, "line": node.lineno, "scope": outer,
            }
        )
        start, end = node.body[0].lineno, node.end_lineno
        self.out["bodies"].append({"entity_name": node.name, "scope": outer, "body_text": dedent("\n".join(self.lines[start - 1 : end])), "language": "python", "file": self.path, "start_line": start, "end_line": end})
        self.decorators(node)
        self.scope.append(node.name)
        for p in kept:
            self.ident(p.arg, "Parameter", p.lineno)
            self.types(p.annotation, p.lineno)
        self.types(node.returns, node.lineno)
        self.stack.append(at)
        self.inside.append("function")
        for x in [*a.defaults, *[d for d in a.kw_defaults if d], *node.body]:
            self.visit(x)
        self.inside.pop()
        self.stack.pop()
        self.scope.pop()

    visit_FunctionDef = visit_AsyncFunctionDef = function

    def decorators(self, node) -> None:
        for x in node.decorator_list:
            self.ident(ast.unparse(x.func if isinstance(x, ast.Call) else x), "Decorator", x.lineno)
            if isinstance(x, ast.Call):
                self.visit(x)

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        self.ident(node.name, "Class", node.lineno)
        at = self.nest("Class", node.name, node.lineno)
        first = self.doc(node, node.lineno)
        own = [x for x in ast.walk(node) if isinstance(x, ast.Attribute) and isinstance(x.value, ast.Name) and x.value.id == "self" and isinstance(x.ctx, ast.Store)]
        self.out["classes"].append(
            {
                "name": node.name, "bases": [ast.unparse(b) for b in node.bases] + [f"{k.arg}={ast.unparse(k.value)}" for k in node.keywords], "methods": [x.name for x in node.body if isinstance(x, FUNCTION)],
                "attributes": list(dict.fromkeys(x.attr for x in own)), "docstring_first_line": first, "file": self.path, "line": node.lineno,
            }
        )
        self.decorators(node)
        self.scope.append(node.name)
        self.stack.append(at)
        self.inside.append("class")
        for x in [*node.bases, *node.body]:
            self.visit(x)
        self.inside.pop()
        self.stack.pop()
        self.scope.pop()

    def target(self, t: ast.AST, line: int) -> None:
        if isinstance(t, ast.Name):
            self.ident(t.id, "Variable", line)
        elif isinstance(t, ast.Attribute) and isinstance(t.value, ast.Name) and t.value.id == "self":
            self.ident(t.attr, "Attribute", line)
        elif isinstance(t, ast.Tuple | ast.List):
            for x in t.elts:
                self.target(x, line)

    def visit_Assign(self, node: ast.Assign) -> None:
        for t in node.targets:
            self.target(t, node.lineno)
        self.visit(node.value)

    def visit_AnnAssign(self, node: ast.AnnAssign) -> None:
        self.target(node.target, node.lineno)
        self.types(node.annotation, node.lineno)
        if node.value:
            self.visit(node.value)

    def visit_Call(self, node: ast.Call) -> None:
        self.out["call_sites"].append({"caller_scope": ".".join(self.scope) or None, "callee": ast.unparse(node.func), "file": self.path, "line": node.lineno})
        self.generic_visit(node)

    def visit_Import(self, node: ast.Import) -> None:
        for x in node.names:
            self.out["imports"].append({"source_module": x.name, "imported_symbols": [], "alias": x.asname, "file": self.path, "line": node.lineno})

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        self.out["imports"].append({"source_module": node.module or "", "imported_symbols": [x.name for x in node.names], "alias": None, "file": self.path, "line": node.lineno})


#: Statements that are passed over in one file, at most, before what is left is given up.
MOST_ERRORS = 200


def tolerant(text: str) -> ast.Module:
    """The tree of what can be read: a line that the parser rejects becomes ``pass`` (an opening line one that opens), as long as that
    helps; where nothing does, what follows the line's top-level statement is left out."""
    lines = text.split("\n")
    tried: set[int] = set()
    for _ in range(MOST_ERRORS):
        try:
            return ast.parse("\n".join(lines))
        except (SyntaxError, ValueError) as e:
            at = min(max((getattr(e, "lineno", None) or 1) - 1, 0), len(lines) - 1)
            while at > 0 and (at in tried or not lines[at].strip()):
                at -= 1
            if at in tried:
                break
            tried.add(at)
            indent = lines[at][: len(lines[at]) - len(lines[at].lstrip())]
            lines[at] = indent + ("if 1:" if lines[at].rstrip().endswith(":") else "pass")
    keep = max((i for i in range(len(lines)) if i <= min(tried, default=0) and lines[i][:1].strip()), default=0)
    if not keep:
        raise SyntaxError("nothing of the file can be read")
    return ast.parse("\n".join(text.split("\n")[:keep]))


def parse(text: str, path: str) -> dict[str, list[dict]]:
    reader = _Reader(text, path)
    reader.read(tolerant(text))
    return reader.out
