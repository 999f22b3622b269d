"""A text as significant tokens with their places, and the partner of each bracket."""

from __future__ import annotations

from typing import NamedTuple

from symgraph.operators.extract import lexer as L


class Tok(NamedTuple):
    text: str
    cls: str
    start: int
    line: int
    end_line: int
    newline: bool  # a line end lies right before it


def significant(text: str, family: str) -> list[Tok]:
    out, at, line, newline = [], L.body_start(text), 1, True
    line += text.count("\n", 0, at)
    for t in L.tokens(text, family):
        cls = L.classify(t, family)
        n = t.count("\n")
        if cls in ("", "nl", "#c"):
            newline = newline or n > 0
        else:
            out.append(Tok(t, cls, at, line, line + n, newline))
            newline = False
        line += n
        at += len(t)
    return out


def partners(toks: list[Tok]) -> dict[int, int]:
    """Index of the closing bracket for each opening one; brackets without partner are left out."""
    close = {"(": ")", "[": "]", "{": "}"}
    stack: list[int] = []
    out: dict[int, int] = {}
    for i, t in enumerate(toks):
        if t.cls in close:
            stack.append(i)
        elif t.cls in close.values():
            # an odd closing bracket is taken for the nearest opening one of its kind
            for j in range(len(stack) - 1, -1, -1):
                if close[toks[stack[j]].cls] == t.cls:
                    out[stack[j]] = i
                    del stack[j:]
                    break
    return out


def enclosing(toks: list[Tok], pair: dict[int, int]) -> list[int]:
    """For each token the innermost opening bracket around it, -1 for none. A bracket isn't in itself."""
    out, stack = [-1] * len(toks), []
    for i in range(len(toks)):
        while stack and pair[stack[-1]] <= i:
            stack.pop()
        out[i] = stack[-1] if stack else -1
        if i in pair:
            stack.append(i)
    return out


def first_line(text: str, start: int) -> str:
    end = text.find("\n", start)
    return text[start : len(text) if end < 0 else end].strip()


def skip_angles(toks: list[Tok], i: int) -> int:
    """Past the `<...>` that begins at i."""
    depth = 0
    while i < len(toks):
        c = toks[i].cls
        if c == "<":
            depth += 1
        elif c == ">":
            depth -= 1
            if depth <= 0:
                return i + 1
        elif c in (";", "{") and depth:
            return i
        i += 1
    return i
