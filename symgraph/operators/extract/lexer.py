"""Lexers for Rust and for TypeScript or JavaScript, as single regular expressions.

`tokens(text, family)` cuts a text into strings, white space and comments included,
in one pass of the matcher; joined they give the text back. `classify` tells what a
token is. All loops in the expressions are possessive, so time is linear and long
texts need no stack."""

from __future__ import annotations

import re
from functools import cache

RUST, TS = "rust", "typescript"

# fixed values: file extensions and the language each is read as
EXTENSIONS = {"rs": RUST, "ts": TS, "tsx": TS, "js": TS, "jsx": TS, "mts": TS, "cts": TS}

# fixed values: reserved words that can't be names
RUST_KEYWORDS = frozenset("as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while".split())
TS_KEYWORDS = frozenset("await break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with yield let".split())

_CONFLICT = r"(?m:^(?:<{7}|>{7}|\|{7})(?=[ \r\n]|\Z)[^\n]*|^={7}(?=\r?$))"


def _nested_comment(depth: int) -> str:
    inner = rf"|{_nested_comment(depth - 1)}" if depth else ""
    return rf"/\*(?:[^*/]++|\*(?!/)|/(?!\*){inner})*+\*/"


def _template(depth: int) -> str:
    inner = rf"|{_template(depth - 1)}" if depth else ""
    braces = r"\{(?:[^{}`'\"]++|\{[^{}]*+\}|'(?:[^'\\\n]|\\.)*+'|\"(?:[^\"\\\n]|\\.)*+\"" + inner + r")*+\}"
    return rf"`(?:[^`\\$]++|\\.|\${braces}|\$(?!\{{))*+`"


_NUMBER_RUST = r"(?:0x[\da-fA-F_]++|0[bo][\d_]++|\d[\d_]*+(?:\.(?![.\w])|\.\d[\d_]*+)?(?:[eE][+-]?[\d_]++)?)\w*+"
_NUMBER_TS = r"(?:0[xX][\da-fA-F_]++|0[bBoO][\d_]++|(?:\d[\d_]*+(?:\.[\d_]*+)?|\.\d[\d_]*+)(?:[eE][+-]?\d++)?)[\w$]*+"
_REGEX = r"(?:(?<=[=(,:;!&|?\[{+\-*%~^\n])|(?<=[=(,:;!&|?\[{+\-*%~^>] )|(?<=return ))/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/[a-z]*+"


@cache
def pattern(family: str) -> re.Pattern:
    if family == RUST:
        raw = "|".join(rf'(?:b|c)?r{"#" * n}".*?"{"#" * n}' for n in range(4))
        parts = [
            r"\s++", r"//[^\n]*+", _nested_comment(3), raw, r'[bc]?"[^"\\]*+(?:\\.[^"\\]*+)*+"',
            r"b?'(?:[^'\\\n]|\\(?:u\{[^}\n]*+\}|x[0-9a-fA-F]{2}|.))'", r"'(?:[^\W\d])\w*+", _NUMBER_RUST, r"r#\w++|[^\W\d]\w*+",
            _CONFLICT, r"<<=|\.\.=|\.\.\.|\.\.|::|->|=>|==|!=|<=|>=|\+=|-=|\*=|/=|%=|\^=|&=|\|=", r"/\*", r".",
        ]
    else:
        parts = [
            r"\s++", r"//[^\n]*+", r"/\*.*?\*/", _REGEX, _template(3), r'"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"', r"'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'", _NUMBER_TS, r"(?:[^\W\d]|\$)[\w$]*+",
            _CONFLICT, r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|\*\*|<<", r"/\*", r".",
        ]
    return re.compile("|".join(f"(?:{p})" for p in parts), re.DOTALL)


def family_of(path: str | None) -> str | None:
    """By the extension, case-sensitive; None for anything else."""
    return EXTENSIONS.get(path.rpartition(".")[2]) if path else None


def body_start(text: str) -> int:
    """Where the language begins: after a byte order mark and a shebang line."""
    at = 1 if text.startswith("﻿") else 0
    if text.startswith("#!", at) and not text.startswith("#![", at):
        end = text.find("\n", at)
        at = len(text) if end < 0 else end
    return at


def tokens(text: str, family: str) -> list[str]:
    return pattern(family).findall(text, body_start(text))


_NUM_RUST_OK = re.compile(r"(?:0x[\da-fA-F_]+|0[bo][\d_]+|\d[\d_]*(?:\.[\d_]*)?(?:[eE][+-]?[\d_]+)?)(?:[iu](?:8|16|32|64|128|size)|f32|f64)?\Z|0x[\da-fA-F_]+(?:[iu](?:8|16|32|64|128|size))?\Z")
_NUM_TS_OK = re.compile(r"(?:0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|\d[\d_]*(?:\.[\d_]*)?(?:[eE][+-]?\d+)?|\.\d[\d_]*(?:[eE][+-]?\d+)?)n?\Z")


def classify(tok: str, family: str) -> str:
    """'' for white space, 'nl' for white space or a comment over a line end, '#c' other comments, a
    keyword or operator itself, else: id, lt (lifetime), num, str, tpl, re, cm (conflict marker), err."""
    c = tok[0]
    if c.isspace():
        return "nl" if "\n" in tok or "\r" in tok else ""
    if tok.startswith("//"):
        return "#c"
    if tok.startswith("/*"):
        return "err" if len(tok) == 2 else "nl" if "\n" in tok else "#c"
    if len(tok) >= 7 and tok[:7] in ("<" * 7, ">" * 7, "=" * 7, "|" * 7):
        return "cm"
    if c.isdigit() or (c == "." and len(tok) > 1 and tok[1].isdigit()):
        return "num" if (_NUM_RUST_OK if family == RUST else _NUM_TS_OK).match(tok) else "err"
    if family == RUST:
        if c == '"' or (c in "bcr" and tok[-1] in "\"#" and '"' in tok):
            return "str" if len(tok) > 1 else "err"
        if c == "'" or tok.startswith("b'"):
            return "err" if len(tok) == 1 else "num" if tok[-1] == "'" else "lt"
        if c.isalpha() or c == "_":
            return tok if tok in RUST_KEYWORDS or tok == "_" else "id"
        return tok if c in "()[]{}<>=+-*/%^&|!?:;,.#@$~" else "err"
    if c in "\"'":
        return "str" if len(tok) > 1 else "err"
    if c == "`":
        return "tpl" if len(tok) > 1 else "err"
    if c == "/" and len(tok) > 2:
        return "re"
    if c.isalpha() or c in "_$":
        return tok if tok in TS_KEYWORDS else tok if tok in TS_CONTEXTUAL else "id"
    return tok if c in "()[]{}<>=+-*/%^&|!?:;,.#@~" else "err"


# fixed values: words with a meaning of their own in some places and names elsewhere
TS_CONTEXTUAL = frozenset("type of as from get set static async readonly declare namespace module abstract keyof infer is satisfies public private protected override interface implements unique asserts global accessor out using".split())
