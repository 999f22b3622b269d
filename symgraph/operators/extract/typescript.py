"""Declarations, imports and calls of TypeScript and JavaScript sources.

Only declarations count: functions, classes, interfaces, types, and methods of classes and
object literals. Functions and arrows bound to names, generators and abstract classes give
no symbol. A call belongs to the nearest function declaration, method or arrow (which has
no name) around it, else to the nearest class."""

from __future__ import annotations

from symgraph.operators.extract import lexer as L
from symgraph.operators.extract.scopes import enclosing, first_line, partners, significant, skip_angles

ANONYMOUS = "<anonymous>"
_MODIFIERS = frozenset("async static get set public private protected readonly override declare accessor".split())
_NAMES = frozenset(["id"]) | L.TS_CONTEXTUAL


def _named(t) -> bool:
    return t.cls in _NAMES


def extract(path: str, text: str) -> tuple[list[dict], list[dict]]:
    toks = significant(text, L.TS)
    pair = partners(toks)
    n = len(toks)
    symbols: dict[tuple, dict] = {}
    edges: list[dict] = []
    classes = _class_bodies(toks, pair)
    # a class whose end is lost goes on to the end: its whole methods are methods all the same
    around = enclosing(toks, dict.fromkeys(classes, n) | pair)
    scopes: dict[int, str] = {}  # opening brace and name of what calls may belong to
    arrows: dict[int, list[tuple[int, int]]] = {}  # by the bracket around them, arrows without braces
    heads: set[int] = set()  # parentheses that hold parameters

    def add(start: int, end: int, name: str, kind: str, exported: bool) -> None:
        key = (toks[start].line, f"{path}::{name}")
        old = symbols.get(key)
        if old:
            old["exported"] |= exported
            return
        symbols[key] = {"name": name, "kind": kind, "start_line": toks[start].line, "end_line": toks[end].end_line, "signature": first_line(text, toks[start].start) or name, "exported": exported}

    for i, t in enumerate(toks):
        prev = toks[i - 1].cls if i else ";"
        if t.cls == "function" and i + 1 < n:
            start = i - 1 if prev == "async" else i
            before = toks[start - 1].cls if start else ";"
            if _named(toks[i + 1]):
                params = _params(toks, i + 2)
                body = _body(toks, pair, params)
                if params is not None:
                    heads.add(params)
                if body is not None and (before in (";", "{", "}", "export", "default", ")", ":") or toks[start].newline) and before not in ("=", "(", ",", "=>", "return", "new"):
                    add(start, pair[body], toks[i + 1].text, "function", before == "export")
                    scopes[body] = toks[i + 1].text
            else:
                params = _params(toks, i + 1 + (toks[i + 1].cls == "*") + (i + 2 < n and toks[i + 1].cls == "*" and _named(toks[i + 2])))
                if params is not None:
                    heads.add(params)
        elif t.cls in ("class", "interface") and i + 1 < n and _named(toks[i + 1]) and prev not in ("abstract", "=", "(", ",", "=>", "return", "new", ".", ":") and (prev in (";", "{", "}", "export", "default", "declare", ")") or t.newline):
            j = i + 2
            while j < n and toks[j].cls != "{":
                j = skip_angles(toks, j) if toks[j].cls == "<" else j + 1
            if j in pair:
                add(i, pair[j], toks[i + 1].text, t.cls, prev == "export")
                if t.cls == "class":
                    scopes[j] = toks[i + 1].text
        elif t.cls == "type" and i + 2 < n and _named(toks[i + 1]) and toks[i + 2].cls in ("=", "<") and (prev in (";", "{", "}", "export", "declare") or t.newline):
            end = _statement_end(toks, pair, i)
            add(i, end, toks[i + 1].text, "type", prev == "export")
        elif t.cls == "import" and i + 1 < n and toks[i + 1].cls not in ("(", "."):
            j = i + 1
            while j < n and toks[j].cls not in ("str", ";"):
                j = pair.get(j, j) + 1
            if j < n and toks[j].cls == "str" and (j == i + 1 or toks[j - 1].cls == "from"):
                edges.append({"from": path, "to": toks[j].text.strip('"').strip("'"), "kind": "imports", "line": t.line})
        elif t.cls == "=>":
            if i + 1 < n and toks[i + 1].cls == "{" and i + 1 in pair:
                scopes[i + 1] = ANONYMOUS
            else:
                arrows.setdefault(around[i], []).append((i, _expression_end(toks, pair, i + 1)))
        if t.cls == "(" and i and i not in heads:
            m = _method(toks, pair, around, classes, i)
            if m is not None:
                start, name, body = m
                heads.add(i)
                if body is not None:
                    add(start, pair[body], name, "method", False)
                    scopes[body] = name
    for i, t in enumerate(toks):
        if t.cls != "(" or not i or i in heads:
            continue
        j = i - 1
        if toks[j].cls == ">":
            depth = 0
            while j > 0:
                depth += (toks[j].cls == ">") - (toks[j].cls == "<")
                if not depth:
                    break
                j -= 1
            j -= 1
        callee = toks[j]
        before = toks[j - 1].cls if j > 0 else ""
        if before == "?." or before == ".":
            if not (callee.cls in _NAMES or callee.cls in L.TS_KEYWORDS):
                continue
            k = j - 1
            if _after_new(toks, pair, k):
                continue
        elif not _named(callee) or before in ("new", "function", "#", "@"):
            continue
        owner = _owner(scopes, arrows, around, i)
        if owner:
            edges.append({"from": f"{path}::{owner}", "to": callee.text, "kind": "calls", "line": callee.line})
    return [symbols[k] for k in sorted(symbols)], edges


def _owner(scopes, arrows, around, i: int) -> str | None:
    at, inside = i, around[i]
    while True:
        if any(a < at <= b for a, b in arrows.get(inside, ())):
            return ANONYMOUS
        if inside < 0:
            return None
        if inside in scopes:
            return scopes[inside]
        at, inside = inside, around[inside]


def _after_new(toks, pair, k: int) -> bool:
    """Whether the member access that ends at k belongs to `new a.b.C(`."""
    while k > 0 and (toks[k].cls in (".",) or toks[k].cls in _NAMES):
        k -= 1
    return toks[k].cls == "new"


def _params(toks, i: int) -> int | None:
    if i < len(toks) and toks[i].cls == "<":
        i = skip_angles(toks, i)
    return i if i < len(toks) and toks[i].cls == "(" else None


def _body(toks, pair, params: int | None) -> int | None:
    """The brace that opens the body after the parameters and a return type, if there is one."""
    if params is None or params not in pair:
        return None
    i = pair[params] + 1
    n = len(toks)
    if i < n and toks[i].cls == "{":
        return i if i in pair else None
    if i >= n or toks[i].cls != ":":
        return None
    i += 1
    # a return type: a brace in it is part of the type where a type is expected
    expects = True
    while i < n:
        c = toks[i].cls
        if c == "{":
            if not expects:
                return i if i in pair else None
            if i not in pair:
                return None
            i = pair[i]
            expects = False
        elif c in ("(", "["):
            i = pair.get(i, n)
            expects = False
        elif c == "<":
            i = skip_angles(toks, i) - 1
            expects = False
        elif c in ("|", "&", "=>", "is", "keyof", "typeof", "readonly", "asserts"):
            expects = True
        elif c in (";", "}", ",", ")", "=") or (toks[i].newline and not expects):
            return None
        else:
            expects = c == "."
        i += 1
    return None


def _class_bodies(toks, pair) -> set[int]:
    out = set()
    for i, t in enumerate(toks):
        if t.cls == "class":
            j = i + 1
            while j < len(toks) and toks[j].cls not in ("{", ";"):
                j = skip_angles(toks, j) if toks[j].cls == "<" else pair.get(j, j) + 1
            if j < len(toks) and toks[j].cls == "{":
                out.add(j)
    return out


def _method(toks, pair, around, classes, i: int) -> tuple[int, str, int | None] | None:
    """(first token, name, body) if the parenthesis at i holds a method's parameters."""
    j = i - 1
    if toks[j].cls == ">":
        depth = 0
        while j > 0:
            depth += (toks[j].cls == ">") - (toks[j].cls == "<")
            if not depth:
                break
            j -= 1
        j -= 1
    if j < 0:
        return None
    if toks[j].cls == "?":
        j -= 1
    name = toks[j]
    if not (name.cls in _NAMES or (name.cls in L.TS_KEYWORDS and name.cls in ("delete", "default", "catch", "import", "new"))):
        return None
    start = j
    if start and toks[start - 1].cls == "*":
        start -= 1
    while start and toks[start - 1].cls in _MODIFIERS and toks[start - 1].cls not in (".",):
        start -= 1
    before = toks[start - 1].cls if start else ""
    body = _body(toks, pair, i)
    inside_class = around[start] in classes
    if inside_class and (before in ("{", "}", ";") or toks[start].newline) and before not in (".", "?."):
        return start, name.text, body
    if body is not None and before in ("{", ",") and toks[pair[i] + 1].cls in ("{", ":"):
        # in an object literal; a block statement can't begin like this but for a label
        return start, name.text, body
    return None


def _statement_end(toks, pair, i: int) -> int:
    n = len(toks)
    j = i + 1
    while j < n:
        c = toks[j].cls
        if c == ";":
            return j
        if c in ("(", "[", "{"):
            j = pair.get(j, n - 1)
            if j + 1 < n and toks[j + 1].newline and toks[j + 1].cls not in ("|", "&", ".", "[", ";", "=>", "extends", "?", ":"):
                return j
        elif c == "}":
            return j - 1
        elif toks[j].newline and j > i + 2 and c not in ("|", "&", "?", ":", "extends", ">", "=", "=>") and toks[j - 1].cls not in ("=", "|", "&", "?", ":", "<", ",", "=>", "keyof", "extends"):
            return j - 1
        j += 1
    return n - 1


def _expression_end(toks, pair, i: int) -> int:
    n = len(toks)
    while i < n:
        c = toks[i].cls
        if c in (")", "]", "}", ",", ";"):
            return i - 1
        i = pair.get(i, i) + 1
    return n - 1
