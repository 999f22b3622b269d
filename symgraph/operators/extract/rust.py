"""Declarations, implementations, imports and calls of Rust sources.

Token trees of macros are opaque: neither declarations nor calls in them count. A call is
a plain or scoped name, or a method, right before a parenthesis inside a function; patterns
(`Some(x) =>`, `let Ok(v) =`) and tuple declarations look alike and are told apart by
where they stand."""

from __future__ import annotations

from symgraph.operators.extract import lexer as L
from symgraph.operators.extract.scopes import enclosing, first_line, partners, significant, skip_angles

# fixed values: the keyword of a declaration and its kind
KINDS = {"fn": "function", "struct": "struct", "enum": "enum", "trait": "trait", "type": "type", "const": "constant", "static": "static", "mod": "module"}


def extract(path: str, text: str) -> tuple[list[dict], list[dict]]:
    toks = significant(text, L.RUST)
    pair = partners(toks)
    n = len(toks)
    cls = [t.cls for t in toks]
    opaque = _opaque(toks, pair)
    symbols: list[dict] = []
    edges: list[dict] = []
    bodies: dict[int, str] = {}  # opening brace and name of each function
    opening = {b: a for a, b in pair.items()}
    around = enclosing(toks, pair)
    skip: set[int] = set()  # parentheses that declare
    i = 0
    while i < n:
        if i in opaque:
            i = opaque[i] + 1
            continue
        c = cls[i]
        if c in KINDS and i + 1 < n and not (i and cls[i - 1] in ("*", "&", "<", ",", "->", "::")):
            name = i + 1 + (c == "static" and i + 1 < n and cls[i + 1] == "mut")
            if name < n and cls[name] == "id":
                end = _end(toks, pair, name, c)
                # an associated type of a trait has no value and is no alias
                if end < n and (c != "type" or any(cls[j] == "=" for j in range(name, end))):
                    start, public = _start(toks, pair, i)
                    symbols.append({"name": toks[name].text, "kind": KINDS[c], "start_line": toks[start].line, "end_line": toks[end].end_line, "signature": first_line(text, toks[start].start) or toks[name].text, "exported": public})
                    if c == "fn":
                        params = name + 1
                        if params < n and cls[params] == "<":
                            params = skip_angles(toks, params)
                        if params < n:
                            skip.add(params)
                        if cls[end] == "}":
                            bodies[opening[end]] = toks[name].text
                    elif c in ("struct", "enum"):
                        # no calls in a declaration
                        skip.update(j for j in range(name, end) if cls[j] == "(")
        elif c == "impl" and (i == 0 or cls[i - 1] in (";", "}", "{", "unsafe", "]", "id", "default")):
            edge = _implements(path, toks, i)
            if edge:
                edges.append(edge)
        elif c == "use" and (i == 0 or cls[i - 1] in (";", "}", "{", "pub", ")", "]")):
            end = next((j for j in range(i, n) if cls[j] == ";"), None)
            if end is not None:
                edges.append({"from": path, "to": text[toks[i + 1].start : toks[end].start].strip(), "kind": "imports", "line": toks[i].line})
        i += 1
    patterns = _patterns(toks, pair)
    hidden = [False] * n
    for a, b in opaque.items():
        hidden[a : b + 1] = [True] * (b + 1 - a)
    for i in range(1, n):
        if cls[i] != "(" or i in skip or i in patterns or hidden[i]:
            continue
        prev = toks[i - 1]
        if prev.cls not in ("id",) or (i > 1 and cls[i - 2] in ("fn", "struct", "enum", "->", "dyn", "impl")) or prev.text in ("Fn", "FnMut", "FnOnce"):
            continue
        at = around[i]
        while at >= 0 and at not in bodies:
            at = around[at]
        if at >= 0:
            edges.append({"from": f"{path}::{bodies[at]}", "to": prev.text, "kind": "calls", "line": prev.line})
    return symbols, edges


def _opaque(toks, pair) -> dict[int, int]:
    """First and last index of macro token trees and attributes."""
    out = {}
    for a, b in pair.items():
        before = toks[a - 1].cls if a else ""
        if (before == "!" and a > 1 and toks[a - 2].cls in ("id", "#")) or before == "#" or (before == "id" and a > 2 and toks[a - 2].cls == "!"):
            out[a] = b
    return out


def _end(toks, pair, i: int, c: str) -> int:
    """Last token of the declaration whose name is at i; len(toks) if it has no end."""
    n = len(toks)
    while i < n:
        k = toks[i].cls
        if k == ";":
            return i
        if k in ("(", "[", "{"):
            if i not in pair:
                return n
            if k == "{" and c not in ("const", "static", "type"):
                return pair[i]
            i = pair[i]
        elif k == "}":
            return n
        i += 1
    return n


def _start(toks, pair, i: int) -> tuple[int, bool]:
    """First token of the declaration whose keyword is at i, and whether it has a visibility."""
    close = {v: k for k, v in pair.items()}
    public = False
    while i > 0:
        p = toks[i - 1]
        if p.cls in ("async", "unsafe", "const", "extern") or (p.cls == "str" and i > 1 and toks[i - 2].cls == "extern"):
            i -= 1
        elif p.cls == "pub":
            public = True
            i -= 1
        elif p.cls == ")" and close.get(i - 1, 0) > 0 and toks[close[i - 1] - 1].cls == "pub":
            i = close[i - 1]
        else:
            break
    return i, public


def _implements(path: str, toks, i: int) -> dict | None:
    """`impl [<..>] Trait for Type[<..>]` with plain names."""
    i += 1
    if i < len(toks) and toks[i].cls == "<":
        i = skip_angles(toks, i)
    if i + 2 >= len(toks) or toks[i].cls != "id" or toks[i + 1].cls != "for" or toks[i + 2].cls != "id":
        return None
    after = toks[i + 3].cls if i + 3 < len(toks) else ""
    if after == "::":
        return None
    return {"from": f"{path}::{toks[i + 2].text}", "to": toks[i].text, "kind": "implements", "line": toks[i].line}


def _patterns(toks, pair) -> set[int]:
    """Opening brackets that belong to patterns: after let and for, and before the arrow of a match arm."""
    out: set[int] = set()
    n = len(toks)
    for i, t in enumerate(toks):
        if t.cls in ("let", "for"):
            j = i + 1
            while j < n and toks[j].cls not in ("=", "in", ";", "{", ":", "<"):
                if toks[j].cls in ("(", "[", "{") and j in pair:
                    out.update(k for k in range(j, pair[j]) if toks[k].cls == "(")
                    j = pair[j]
                j += 1
        elif t.cls == "match":
            j = i + 1
            while j < n and toks[j].cls != "{" and toks[j].cls != ";":
                j = pair.get(j, j) + 1
            if j < n and j in pair and toks[j].cls == "{":
                _arms(toks, pair, j, pair[j], out)
    return out


def _arms(toks, pair, a: int, b: int, out: set[int]) -> None:
    i, pattern = a + 1, True
    while i < b:
        c = toks[i].cls
        if pattern and c == "if":
            pattern = False
        elif c == "=>":
            pattern = False
            if toks[i + 1].cls == "{" and i + 1 in pair:
                i = pair[i + 1]
                pattern = True
        elif c == ",":
            pattern = True
        elif c in ("(", "[", "{") and i in pair:
            if pattern:
                out.update(k for k in range(i, pair[i]) if toks[k].cls == "(")
            i = pair[i]
        i += 1
