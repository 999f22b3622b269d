"""Source files that do not parse: minimum-cost syntax repair by error-correcting chart parsing.

A text is lexed and its brackets are matched. Each bracket group is parsed at its own level
and stands in the level above as the class of what it can be. Parsing is by a chart: it
holds, for a rule and a place, every place where the rule can end and the least cost of
edits to get there. An edit inserts, deletes or
replaces one token and costs 1. A level is cut into statements or list elements first,
and equal segments are parsed once per worker, so that corpora of similar code cost
little. Cost 0 is tried first; where it fails, a single edit is, and then the least cost is
computed over all spans of the segment (leastcost.py). The cost of a text is the sum over its levels, plus the brackets that must be
inserted or deleted, plus tokens of no language; above zero it does not parse.

Where the edits lie tells the damage: conflict (at markers of a merge), truncation (edits at
the end, and none before the last bracket that is still open there), mismatch (many edits,
all over the text: one of another language), other.

Repairs are sought without a limit, so that every segment's cost is the least. A limited search
is a parameter, for where only zero or not is asked, which doesn't depend on it: `exact` says
whether every segment's least cost was found. A segment of more tokens or edits than are sought
then counts with the edits it needs at least, and so do segments after the first `searches`
that fail in one text.

Defined results: a null text isn't judged (cost null); an empty or blank one is valid;
a path without a source extension isn't looked at. The extension alone decides the
language; JSX is allowed in tsx and jsx only. Repeated rows are judged alike.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from functools import cache, lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgraph.llm import grammar as G
from symgraph.llm.leastcost import Costs
from symgraph.operators.extract import lexer as L
from symgraph.session import spread

class Search(NamedTuple):
    """How far repairs are sought in a limited search: edits within a segment, tokens of a segment that more than a
    single edit is sought in, and segments of one text; further ones count as one edit each. again: whether the
    chart is run until nothing changes where it has found no repair; else the cost is two at least."""

    budget: int
    tokens: int
    searches: int
    again: bool


#: To tell whether a text parses, whatever the cost.
SHALLOW = Search(2, 8, 12, False)
#: Share of a text's tokens edited, and edits at least, from which it is taken for another language.
MISMATCH_SHARE, MISMATCH_LEAST = 0.05, 8
#: Nodes and segments a worker keeps; beyond it the store starts anew (a cache only).
KEPT = 400_000

#: A token that stands for any token or group.
ANY = "any token"


class _All(frozenset):
    def __contains__(self, x) -> bool:
        return True

    def __and__(self, other):
        return True


CLOSE = {"(": ")", "[": "]", "{": "}"}
OPEN = {v: k for k, v in CLOSE.items()}


# ---- grammar: rules as nested tuples ("seq", ...), ("alt", ...), ("opt", x), ("rep", x), ("t", terminal), ("g", bracket, rule), ("n", rule)


def _compile(text: str) -> dict[str, tuple]:
    rules = {}
    for line in text.strip().split("\n"):
        name, _, body = line.partition(" = ")
        items, at = _alternatives(body.split(), 0)
        rules[name] = items
    return rules


def _alternatives(words: list[str], at: int) -> tuple[tuple, int]:
    alts, seq = [], []
    while at < len(words) and words[at] not in ("]]", ">>", ">>*"):
        w = words[at]
        if w == "/":
            alts.append(seq)
            seq = []
            at += 1
        elif w in ("[[", "<<"):
            inner, at = _alternatives(words, at + 1)
            seq.append(("opt", inner) if words[at] == "]]" else ("rep", inner) if words[at] == ">>*" else inner)
            at += 1
        else:
            if len(w) > 2 and w[0] in CLOSE and w[-1] == CLOSE[w[0]]:
                seq.append(("g", w[0], w[1:-1]))
            elif w[0].isupper() and w != "Self":
                seq.append(("n", w))
            else:
                seq.append(("t", w.strip("'") if len(w) > 2 else w))
            at += 1
    alts.append(seq)
    made = [s[0] if len(s) == 1 else ("seq", *s) for s in alts]
    return (made[0] if len(made) == 1 else ("alt", *made)), at


def _first(rules: dict[str, tuple]) -> tuple[dict[str, frozenset], dict[str, bool]]:
    """Of each rule the terminals (and brackets) it may begin with, and whether it may be empty."""
    first: dict[str, set] = {r: set() for r in rules}
    empty = dict.fromkeys(rules, False)

    def of(x: tuple) -> tuple[set, bool]:
        kind = x[0]
        if kind == "t":
            return {x[1]}, False
        if kind == "g":
            return {x[1]}, False
        if kind == "n":
            return first[x[1]], empty[x[1]]
        if kind in ("opt", "rep"):
            return of(x[1])[0], True
        if kind == "alt":
            parts = [of(y) for y in x[1:]]
            return set().union(*[p[0] for p in parts]), any(p[1] for p in parts)
        out: set = set()
        for y in x[1:]:
            f, e = of(y)
            out |= f
            if not e:
                return out, False
        return out, True

    changed = True
    while changed:
        changed = False
        for r, x in rules.items():
            f, e = of(x)
            if not f <= first[r] or e != empty[r]:
                first[r] |= f
                empty[r] = e
                changed = True
    return {r: frozenset(s) for r, s in first.items()}, empty


class Parser:
    """The chart parser of one family, with its shared nodes and segments."""

    def __init__(self, family: str):
        self.family = family
        rust = family == L.RUST
        self.rules = _compile(G.RUST if rust else G.TS)
        self.first, self.empty = _first(self.rules)
        self.look: dict[int, frozenset] = {}
        for x in self.rules.values():
            self._look_ahead(x)
        self.groups = G.RUST_GROUPS if rust else G.TS_GROUPS
        self.lists = G.RUST_LISTS if rust else G.TS_LISTS
        self.blocks = G.RUST_BLOCKS if rust else G.TS_BLOCKS
        self.terms: dict[str, frozenset] = {ANY: _All()}
        self.costs: dict[str, Costs] = {}
        self.far = 0
        self.reset()

    def reset(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.nodes: list[tuple] = []
        self.known: dict[tuple, int] = {}
        self.seg: dict[tuple, bool] = {}
        self.broken: dict[int, bool] = {}
        self.searches = 0
        self._repair.cache_clear()

    def _look_ahead(self, x: tuple) -> tuple[frozenset, bool]:
        """Notes for each part of a rule that can't be empty what it may begin with."""
        kind = x[0]
        if kind in ("t", "g"):
            out, empty = frozenset([x[1]]), False
        elif kind == "n":
            out, empty = self.first[x[1]], self.empty[x[1]]
        else:
            parts = [self._look_ahead(y) for y in x[1:]]
            if kind == "alt":
                out, empty = frozenset().union(*[f for f, _ in parts]), any(e for _, e in parts)
            elif kind == "seq":
                reach = next((i for i, (_, e) in enumerate(parts) if not e), len(parts))
                out, empty = frozenset().union(*[f for f, _ in parts[: reach + 1]]), reach == len(parts)
            else:
                out, empty = parts[0][0], True
        if not empty:
            self.look[id(x)] = out
        elif kind in ("opt", "rep") and not parts[0][1]:
            self.look[id(x)] = out
        return out, empty

    # -- tokens and nodes

    def terminals(self, tok: str) -> frozenset:
        """What a token may stand for: itself, and the classes it belongs to."""
        got = self.terms.get(tok)
        if got is None:
            out = {tok}
            if self.family == L.RUST:
                if tok in ("==", "!=", "<=", ">=", "/", "%", "^"):
                    out.add("bop")
                if len(tok) > 1 and tok[-1] == "=" and tok not in ("==", "!=", "<=", ">=", "..="):
                    out.add("aop")
            else:
                if tok in L.TS_KEYWORDS:
                    out.add("kw")
                    if tok in ("let", "yield", "await"):
                        out.add("ctx")
                if tok in L.TS_CONTEXTUAL:
                    out.add("ctx")
                if tok in ("++", "--"):
                    out.add("inc")
                if tok in ("==", "!=", "===", "!==", "<=", ">=", "&&", "||", "??", "**", "/", "%", "^", "<<"):
                    out.add("bop")
                if len(tok) > 1 and tok[-1] == "=" and tok not in ("==", "!=", "===", "!==", "<=", ">="):
                    out.add("aop")
            got = self.terms[tok] = frozenset(out)
        return got

    def node(self, bracket: str, content: tuple) -> int:
        """The class of a group: groups of one bracket whose contents can be the same rules are
        interchangeable for what surrounds them, and share one number."""
        key = (bracket, content)
        got = self.ids.get(key)
        if got is None:
            fit = frozenset(r for r in self.groups[bracket] if all(self.segment(x, y) for x, y in set(self.segments(r, content))))
            got = self.ids[key] = self.class_of(bracket, fit)
        return got

    def class_of(self, bracket: str, fit: frozenset) -> int:
        key = (bracket, fit)
        got = self.known.get(key)
        if got is None:
            got = self.known[key] = len(self.nodes)
            self.nodes.append(key)
            self.broken[got] = not fit
        return got

    def fits(self, node: int, rule: str) -> bool:
        """Whether the group's content can be `rule` without any edit at its level. A group that
        is nothing at all has been counted on its own and passes for anything."""
        return rule == "TT" or self.broken[node] or rule in self.nodes[node][1]

    def segment(self, rule: str, toks: tuple) -> bool:
        key = (rule, toks)
        got = self.seg.get(key)
        if got is None:
            got = self.seg[key] = self.parse(rule, toks, 0) == 0
        return got

    # -- cutting a level into segments

    def segments(self, rule: str, content: tuple) -> Iterator[tuple[str, tuple]]:
        if rule in self.lists:
            yield from self._elements(rule, content)
        elif rule in self.blocks:
            yield from self._statements(rule, content)
        else:
            yield rule, tuple(t for t in content if t != "nl")

    def _elements(self, rule: str, content: tuple) -> Iterator[tuple[str, tuple]]:
        toks = [t for t in content if t != "nl"]
        types = rule in ("Params", "TupFields", "Fields", "Variants", "FnPtrP", "TupT", "TTuple")
        if self.family == L.RUST and rule == "Array" and ";" in toks:
            yield "Array", tuple(toks)
            return
        depth, cur = 0, []
        bars = 0
        one = rule + "1"
        out = []
        angle = "<" in toks
        for i, t in enumerate(toks):
            if angle and (types or self._generic(toks, i)):
                if t == "<":
                    depth += 1
                elif t == ">" and depth:
                    depth -= 1
            elif angle and t == ">" and depth:
                depth -= 1
            if t == "|" and self.family == L.RUST and not types and rule in ("Args", "Tuple", "Array", "StructLit") and (bars or not cur or cur[-1] in ("move", ":", "=", "=>")):
                bars ^= 1
            if t == "," and not depth and not bars:
                out.append(tuple(cur))
                cur = []
            else:
                cur.append(t)
        if cur:
            out.append(tuple(cur))
        for s in out:
            if not s and rule not in ("Array", "ArrPat"):
                yield one, ("err",)
            else:
                yield one, s

    def _generic(self, toks: list, i: int) -> bool:
        """Whether a '<' in expressions opens type arguments: a turbofish in Rust; elsewhere, where
        its partner is followed by a parenthesis, or it begins type parameters."""
        if toks[i] != "<":
            return False
        if self.family == L.RUST:
            return i > 0 and toks[i - 1] in ("::", "id", "Self") and self._partner(toks, i) is not None and (toks[i - 1] == "::" or i > 1 and toks[i - 2] in ("as", "&", ":", "::"))
        end = self._partner(toks, i)
        return end is not None and end + 1 < len(toks) and (isinstance(toks[end + 1], int) or i > 1 and toks[i - 2] in (":", "as"))

    def _partner(self, toks: list, i: int) -> int | None:
        depth = 0
        for j in range(i, min(len(toks), i + 60)):
            t = toks[j]
            if t == "<":
                depth += 1
            elif t == ">":
                depth -= 1
                if not depth:
                    return j
            elif isinstance(t, str) and t in (";", "&&", "||", "==", "==="):
                return None
        return None

    def _statements(self, rule: str, content: tuple) -> Iterator[tuple[str, tuple]]:
        whole, tail = self.blocks[rule]
        cur: list = []
        n = len(content)
        rust = self.family == L.RUST
        if rule == "Match":
            yield "Match", tuple(t for t in content if t != "nl")
            return
        depth = 0
        for i, t in enumerate(content):
            if t == "nl":
                if not rust and cur and not depth and self._ends(cur, content, i, rule):
                    yield tail, tuple(cur)
                    cur = []
                continue
            cur.append(t)
            if rule == "TBody" and t == "<":
                depth += 1
            elif rule == "TBody" and t == ">" and depth:
                depth -= 1
            if (t == ";" or (t == "," and rule == "TBody")) and not depth:
                # what follows a do-while or an if may still belong to it
                nxt = content[i + 1] if i + 1 < n else None
                nxt = content[i + 2] if nxt == "nl" and i + 2 < n else nxt
                if nxt != "else" and not (cur[0] == "do" and "while" not in cur):
                    yield whole, tuple(cur)
                    cur = []
            elif isinstance(t, int) and self.nodes[t][0] == "{" and rule != "TBody":
                nxt = content[i + 1] if i + 1 < n else None
                line = nxt == "nl"
                nxt = content[i + 2] if line and i + 2 < n else nxt
                if isinstance(nxt, str) and nxt in self._starts() and (rust or not line) and not (cur[0] == "do" and len(cur) == 2):
                    if rule == "Class" or rust or cur[0] in self._block_starts():
                        yield whole, tuple(cur)
                        cur = []
        if cur or not content:
            yield tail, tuple(cur)

    @cache  # noqa: B019 - parsers live as long as their worker
    def _starts(self) -> frozenset:
        if self.family == L.RUST:
            return frozenset("fn pub struct enum impl trait use mod static let return loop match #".split())
        return frozenset("function class var const let switch try return throw export import break continue for async static get set".split())

    @cache  # noqa: B019
    def _block_starts(self) -> frozenset:
        return frozenset("function class if for while switch try export async interface enum else".split())

    def _ends(self, cur: list, content: tuple, i: int, rule: str) -> bool:
        """Whether a line end after cur may stand for a semicolon: the last token can end a statement and
        the next can't go on with it."""
        last = cur[-1]
        nxt = content[i + 1] if i + 1 < len(content) else None
        if nxt is None or isinstance(nxt, int):
            # a bracket goes on with an expression, but not after a whole member or block
            if isinstance(nxt, int) and rule in ("Class", "TBody") and not isinstance(last, str):
                return self.nodes[nxt][0] == "["
            return isinstance(nxt, int) and self.nodes[nxt][0] == "{" and isinstance(last, int) and self.nodes[last][0] == "{" and cur[0] not in ("class", "interface", "export", "function")
        if isinstance(last, str) and last not in ("id", "num", "str", "tpl", "re", "this", "super", "null", "true", "false", "return", "break", "continue", "++", "--", "debugger", "]") and last not in L.TS_CONTEXTUAL and not (rule == "TBody" and last in ("void", ">")) and last not in ("!", ">"):
            return False
        if last == ">" and rule != "TBody" and "type" not in cur:
            return False
        if last in ("async", "type", "declare", "abstract", "namespace", "get", "set", "static", "readonly", "of", "from", "as", "keyof", "is") and len(cur) < 3:
            return False
        if nxt in ("else", "catch", "finally", "in", "instanceof", "of", "as", "from", "satisfies", "extends", "implements", "is"):
            return False
        if nxt == "while" and cur[0] == "do" and "while" not in cur:
            return False
        if len(cur) > 1 and cur[-2] in ("if", "for", "while") and cur[0] != "do":
            return False
        if nxt in ("id", "num", "str", "re", "this", "super", "null", "true", "false", "++", "--", "@", "!", "#", "~") or nxt in L.TS_KEYWORDS or nxt in L.TS_CONTEXTUAL:
            return not (nxt == "!" and isinstance(last, str) and last == ">")
        return rule == "Class" and nxt == "*"

    # -- the chart

    def parse(self, rule: str, toks: tuple, budget: int, again: bool = True) -> int | None:
        """The cost at which `rule` covers all tokens, if it is within the budget: the least where less than the
        budget is known not to do."""
        n = len(toks)
        terms = [self.terminals(t) if isinstance(t, str) else None for t in toks]
        heads = [t if t is not None else frozenset(self.nodes[toks[i]][0]) for i, t in enumerate(terms)]
        chart: dict[tuple, dict[int, int]] = {}
        before: dict[tuple, dict[int, int]] = {}
        rules, first, empty, nodes, over, look = self.rules, self.first, self.empty, self.nodes, budget + 1, self.look

        def put(out: dict[int, int], end: int, cost: int) -> bool:
            if cost <= budget and cost < out.get(end, budget + 1):
                out[end] = cost
                return True
            return False

        def one(at: int, hit: bool) -> dict[int, int]:
            """Ends of a single token or group that is inserted, or kept or replaced."""
            return {at: 1, at + 1: 0 if hit else 1} if at < n else {at: 1}

        def rule_ends(name: str, at: int) -> dict[int, int]:
            key = (name, at)
            got = chart.get(key)
            if got is None:
                if not budget and not empty[name] and (at >= n or not (heads[at] & first[name])):
                    if at > self.far:
                        self.far = at
                    got = chart[key] = {}
                else:
                    # a rule met again at its own place has what the round before has found
                    chart[key] = before.get(key, {})
                    got = chart[key] = ends(rules[name], at)
            return got

        def ends(x: tuple, at: int) -> dict[int, int]:
            kind = x[0]
            if kind == "t":
                if not budget:
                    if at < n and terms[at] is not None and x[1] in terms[at]:
                        return {at + 1: 0}
                    if at > self.far:
                        self.far = at
                    return {}
                base = one(at, at < n and terms[at] is not None and x[1] in terms[at])
                skip = at
                while budget and skip < n and skip - at < budget:
                    # delete tokens before it
                    skip += 1
                    if skip < n and terms[skip] is not None and x[1] in terms[skip]:
                        put(base, skip + 1, skip - at)
                return base
            if kind == "n":
                return rule_ends(x[1], at)
            if kind == "g":
                if not budget:
                    if at < n and (toks[at] == ANY or (terms[at] is None and nodes[toks[at]][0] == x[1] and self.fits(toks[at], x[2]))):
                        return {at + 1: 0}
                    if at > self.far:
                        self.far = at
                    return {}
                base = one(at, at < n and terms[at] is None and nodes[toks[at]][0] == x[1] and self.fits(toks[at], x[2]))
                skip = at
                while budget and skip < n and skip - at < budget:
                    skip += 1
                    if skip < n and terms[skip] is None and nodes[toks[skip]][0] == x[1] and self.fits(toks[skip], x[2]):
                        put(base, skip + 1, skip - at)
                return base
            if kind == "seq":
                cur = {at: 0}
                for y in x[1:]:
                    if len(cur) == 1 and not budget:
                        (p,) = cur
                        cur = ends(y, p)
                    else:
                        nxt: dict[int, int] = {}
                        for p, c in cur.items():
                            for e, d in ends(y, p).items():
                                if c + d <= budget and c + d < nxt.get(e, over):
                                    nxt[e] = c + d
                        cur = nxt
                    if not cur:
                        return cur
                return cur
            if kind == "alt":
                out: dict[int, int] = {}
                for y in x[1:]:
                    if not budget and (f := look.get(id(y))) is not None and y[0] not in ("opt", "rep") and (at >= n or not heads[at] & f):
                        if at > self.far:
                            self.far = at
                        continue
                    for e, d in ends(y, at).items():
                        if d < out.get(e, over):
                            out[e] = d
                return out
            out = {at: 0}
            if not budget and (f := look.get(id(x))) is not None and (at >= n or not heads[at] & f):
                if at > self.far:
                    self.far = at
                return out
            if kind == "opt":
                for e, d in ends(x[1], at).items():
                    put(out, e, d)
                return out
            todo = [at]
            while todo:
                p = todo.pop()
                for e, d in ends(x[1], p).items():
                    if e > p and put(out, e, out[p] + d):
                        todo.append(e)
            return out

        while True:
            got = rule_ends(rule, 0)
            best = got.get(n)
            if budget:
                # tokens at the end that are deleted
                for e, c in got.items():
                    if e < n and c + n - e <= budget and (best is None or c + n - e < best):
                        best = c + n - e
            if not budget or best is not None or not again or chart == before:
                return best
            before, chart = chart, {}

    def least(self, rule: str, toks: tuple) -> int:
        """The least cost at which `rule` covers all tokens."""
        if rule not in self.costs:
            self.costs[rule] = Costs(self.rules, rule)
        terms = [self.terminals(t) if isinstance(t, str) else None for t in toks]

        def hit(x: tuple, at: int) -> bool:
            if x[0] == "t":
                return terms[at] is not None and x[1] in terms[at]
            return toks[at] == ANY or (terms[at] is None and self.nodes[toks[at]][0] == x[1] and self.fits(toks[at], x[2]))

        return self.costs[rule].cost(len(toks), hit)

    def repair(self, rule: str, toks: tuple, search: Search | None = None) -> tuple[int, int, bool]:
        """(least cost, place of the first edit, whether the cost is exact)."""
        if search is not None:
            if self.searches >= search.searches:
                return 1, 0, False
            self.searches += 1
        return self._repair(rule, toks, search)

    @lru_cache(maxsize=50_000)  # noqa: B019
    def _repair(self, rule: str, toks: tuple, search: Search | None) -> tuple[int, int, bool]:
        """The first edit can't lie behind the place that plain parsing reached, so a single one is sought up
        to there; of several the first is taken to lie there."""
        self.far = 0
        self.parse(rule, toks, 0)
        far = min(self.far, len(toks))
        for at in range(far, -1, -1):
            before, after = toks[:at], toks[at + 1 :]
            if at < len(toks) and (self.parse(rule, before + after, 0) == 0 or self.parse(rule, (*before, ANY, *after), 0) == 0):
                return 1, at, True
            if self.parse(rule, (*before, ANY, *toks[at:]), 0) == 0:
                return 1, at, True
        if search is None:
            return self.least(rule, toks), far, True
        if len(toks) > search.tokens:
            return 2, far, False
        for b in range(2, search.budget + 1):  # less than b is known not to do, if again is set
            got = self.parse(rule, toks, b, search.again)
            if got is not None:
                return got, far, True
        return search.budget + 1 if search.again else 2, far, False

    def placed(self, rule: str, content: tuple, at: list[int]) -> Iterator[tuple[str, tuple, list[int]]]:
        """The segments with the places of their tokens in the text, and that of what follows. at: the places
        of the content and of its end."""
        places = [i for t, i in zip(content, at, strict=False) if t != "nl"] + [at[-1]]
        begin, split = 0, rule in self.lists
        for r, seg in self.segments(rule, content):
            size = 0 if split and seg == ("err",) else len(seg)
            yield r, seg, places[begin : begin + size + 1]
            begin += size + (split and r != rule)

    def repairs_of(self, rule: str, content: tuple, at: list[int], search: Search | None, most: int | None = None) -> list[tuple[int, int, bool]] | None:
        """(place, cost, exact) of each segment that fails; None if they cost as much as `most`."""
        out, cost = [], 0
        for r, seg, places in self.placed(rule, content, at):
            if not self.segment(r, seg):
                c, first, exact = self.repair(r, seg, search)
                cost += c
                if most is not None and cost >= most:
                    return None
                out.append((places[min(first, len(places) - 1)], c, exact))
        return out

    def own_repairs(self, content: tuple, at: list[int], rules: list[str], search: Search | None) -> list[tuple[int, int, bool]]:
        """The repairs at the level of one group, for the rule that needs the fewest edits."""
        best = None
        for r in rules:
            got = self.repairs_of(r, content, at, search, None if best is None else sum(c for _, c, _ in best))
            best = best if got is None else got
        return best or [(at[0], 1, True)]


@cache
def parser(family: str, lenient: bool = False) -> Parser:
    sys.setrecursionlimit(100_000)
    return Parser(family)


# ---- JSX: elements become `jsx ( expressions )`

_JSX_NAME = re.compile(r"[^\W\d][\w$]*(?:[.:-][\w$-]+)*|")
_SPACE = re.compile(r"(?:\s+|//[^\n]*|/\*.*?\*/)*", re.DOTALL)
_JSX_AFTER = frozenset(["(", ",", "return", "=>", "=", "?", ":", "&&", "||", "??", "[", "{", ";", "}", "default", ""])


def lex_jsx(text: str, at: int, nested: bool) -> tuple[list[str], int]:
    """Classes of the tokens from `at`, to the end or (nested) to the brace that closes."""
    pat = L.pattern(L.TS)
    out: list[str] = []
    last, depth = "", 0
    n = len(text)
    while at < n:
        if text[at] == "<" and last in _JSX_AFTER and re.match(r"<(?:[^\W\d]|>)", text[at : at + 2]) and not re.match(r"<[\w$]+\s*(?:,|extends\b)", text[at : at + 80]):
            got = _element(text, at)
            if got is not None:
                inner, at = got
                out += ["jsx", "(", *inner, ")"]
                last = ")"
                continue
        m = pat.match(text, at)
        tok = m.group()
        c = classes(L.TS)[tok]
        at = m.end()
        if c == "{":
            depth += 1
        elif c == "}":
            if nested and not depth:
                return out, at - 1
            depth -= 1
        out.append(c)
        if c and c != "nl" and c != "#c":
            last = c
    return out, at


def _braces(text: str, at: int, inner: list[str]) -> int | None:
    """An expression container at `at`; its tokens are added to inner, with a comma."""
    toks, end = lex_jsx(text, at + 1, True)
    if end >= len(text):
        return None
    if any(t and t not in ("nl", "#c") for t in toks):
        inner += [*toks, ","]
    return end + 1


def _element(text: str, at: int) -> tuple[list[str], int] | None:
    """The element that begins at `at`: tokens of the expressions in it, and its end."""
    inner: list[str] = []
    open_names: list[str] = []
    n = len(text)
    while True:
        # an opening tag at `at`
        m = _JSX_NAME.match(text, at + 1)
        name, at = m.group(), m.end()
        while True:
            at = _SPACE.match(text, at).end()
            if at >= n:
                return None
            c = text[at]
            if c == ">":
                open_names.append(name)
                at += 1
                break
            if c == "/":
                if not text.startswith("/>", at):
                    return None
                at += 2
                break
            if c == "{":
                end = _braces(text, at, inner)
                if end is None:
                    return None
                at = end
                continue
            m = _JSX_NAME.match(text, at)
            if not m.group():
                return None
            at = _SPACE.match(text, m.end()).end()
            if at < n and text[at] == "=":
                at = _SPACE.match(text, at + 1).end()
                if at >= n:
                    return None
                if text[at] in "\"'":
                    end = text.find(text[at], at + 1)
                    if end < 0:
                        return None
                    at = end + 1
                elif text[at] == "{":
                    end = _braces(text, at, inner)
                    if end is None:
                        return None
                    at = end
                else:
                    return None
        # children, until all tags are closed or another opens
        opened = False
        while open_names:
            while at < n and text[at] not in "<{}>":
                at += 1
            if at >= n or text[at] in "}>":
                return None
            if text[at] == "{":
                end = _braces(text, at, inner)
                if end is None:
                    return None
                at = end
            elif text.startswith("</", at):
                m = _JSX_NAME.match(text, _SPACE.match(text, at + 2).end())
                end = _SPACE.match(text, m.end()).end()
                if m.group() != open_names.pop() or not text.startswith(">", end):
                    return None
                at = end + 1
            else:
                opened = True
                break
        if not opened:
            return inner, at


class _Classes(dict):
    def __init__(self, family: str):
        super().__init__()
        self.family = family

    def __missing__(self, tok: str) -> str:
        c = L.classify(tok, self.family)
        if self.family == L.RUST and (tok.startswith("///") and tok[3:4] != "/" or tok.startswith("/**") and len(tok) > 4 and tok[3] != "*"):
            c = "doc"  # documents what follows, and something must
        elif c == "#c":
            c = ""
        if c == "tpl" and "${" in tok:
            c = "tpl" if _template_ok(tok) else "err"
        if len(self) > KEPT:
            self.clear()
        self[tok] = c
        return c


@cache
def classes(family: str) -> _Classes:
    return _Classes(family)


def _template_ok(tok: str) -> bool:
    """Whether what a template embeds are expressions."""
    at = 0
    while (at := tok.find("${", at)) >= 0:
        if at and tok[at - 1] == "\\":
            at += 2
            continue
        toks, end = lex_jsx(tok, at + 2, True)
        cost = _judge_tokens([*["("], *toks, *[")"]], L.TS, SHALLOW)[0]
        if end >= len(tok) or cost:
            return False
        at = end
    return True


# ---- whole texts


def _judge_tokens(toks: list[str], family: str, search: Search | None = None) -> tuple[int, str, int, int | None, bool]:
    """(cost, damage, tokens, place of the first edit, whether the cost is exact)."""
    p = parser(family)
    if len(p.ids) > KEPT or len(p.seg) > KEPT:
        p.reset()
    p.searches = 0
    stack: list[tuple[str, list, list[int], int]] = []  # bracket, content and places around it, its own place
    cur: list = []
    at: list[int] = []
    edits: list[tuple[int, int, bool]] = []
    n = 0
    conflict = False
    rust = family == L.RUST
    doc = False  # a documentation comment waits for what it documents
    raw = 0  # brackets open since a macro's or an attribute's: what they enclose may be anything
    for c in toks:
        if not c:
            continue
        if c == "nl":
            if cur and cur[-1] != "nl" and not rust:
                cur.append("nl")
                at.append(n)
            continue
        if c == "doc":
            doc = True
            continue
        if doc and c in OPEN and not raw:
            edits.append((n, 1, True))
        doc = False
        if c in CLOSE:
            if raw or (rust and _token_tree(cur)):
                raw += 1
            stack.append((c, cur, at, n))
            cur, at = [], []
        elif c in OPEN:
            # a closing bracket without partner is deleted, or the open ones inside are closed
            if not stack or (stack[-1][0] != OPEN[c] and not any(s[0] == OPEN[c] for s in stack[-3:])):
                edits.append((n, 1, True))
            else:
                while stack[-1][0] != OPEN[c]:
                    edits.append((n, 1, True))
                    cur, at = _close(p, stack, cur, at, n, edits, rust, raw, search)
                    raw = max(0, raw - 1)
                cur, at = _close(p, stack, cur, at, n, edits, rust, raw, search)
                raw = max(0, raw - 1)
        elif c == "err" or c == "cm":
            edits.append((n, 1, True))
            conflict |= c == "cm"
        else:
            cur.append(c)
            at.append(n)
        n += 1
    if doc:
        edits.append((n, 1, True))
    # what is still open is the part in which a text that was cut off may be wrong
    tail = stack[-1][3] if stack else max(0, n - 1)
    while stack:
        edits.append((n, 1, True))
        cur, at = _close(p, stack, cur, at, n, edits, rust, raw, search)
        raw = max(0, raw - 1)
    if not rust:
        _end_before_else(p, cur)
    edits += p.repairs_of("Items" if rust else "Block", tuple(cur), [*at, n], search)
    cost = sum(c for _, c, _ in edits)
    if not cost:
        return 0, "none", n, None, True
    first, last = min(e[0] for e in edits), max(e[0] for e in edits)
    if conflict:
        damage = "conflict"
    elif last >= n - 1 and first >= tail:
        damage = "truncation"
    elif cost >= max(MISMATCH_LEAST, MISMATCH_SHARE * n) and last - first > n / 2:
        damage = "mismatch"
    else:
        damage = "other"
    return cost, damage, n, first, all(e[2] for e in edits)


def _end_before_else(p: Parser, cur: list) -> None:
    """A line end between a statement without semicolon and `else` stands for one."""
    for i in range(1, len(cur) - 1):
        last = cur[i - 1]
        if cur[i] == "nl" and cur[i + 1] == "else" and last != ";" and not (isinstance(last, int) and p.nodes[last][0] == "{"):
            cur[i] = ";"


def _token_tree(before: list) -> bool:
    """Whether a bracket after these tokens opens the token tree of a macro or an attribute."""
    return bool(before) and (before[-1] == "#" or (before[-1] == "!" and len(before) > 1 and before[-2] in ("id", "#")) or (before[-1] == "id" and len(before) > 2 and before[-2] == "!" and before[-3] == "id"))


def _close(p: Parser, stack: list, cur: list, at: list[int], end: int, edits: list, rust: bool, raw: int, search: Search | None) -> tuple[list, list[int]]:
    """Ends the innermost group at the place `end`; the content and places around it, with the group."""
    bracket, outer, around, begin = stack.pop()
    around.append(begin)
    if raw:
        outer.append(p.class_of(bracket, frozenset(["TT"])))
        return outer, around
    if not (bracket == "{" and not rust) and "nl" in cur:
        at = [i for t, i in zip(cur, at, strict=True) if t != "nl"]
        cur = [t for t in cur if t != "nl"]
    if not rust and "else" in cur:
        _end_before_else(p, cur)
    content = tuple(cur)
    node = p.node(bracket, content)
    if p.broken[node]:
        edits += p.own_repairs(content, [*at, end], p.groups[bracket], search)
    outer.append(node)
    return outer, around


def judge(path: str, text: str | None, search: Search | None = None) -> tuple:
    """(cost, damage, tokens, first_edit, exact) of a text by its path's extension; first_edit counts tokens
    from 0, and the number of tokens is the text's end."""
    if text is None:
        return None, None, None, None, None
    family = L.family_of(path)
    if path.endswith(("x",)):
        toks, _ = lex_jsx(text, L.body_start(text), False)
    else:
        toks = list(map(classes(family).__getitem__, L.tokens(text, family)))
    return _judge_tokens(toks, family, search)


_JUDGED = (("cost", pa.int32()), ("damage", pa.string()), ("n_tokens", pa.int32()), ("first_edit", pa.int32()), ("exact", pa.bool_()))


def repairs(docs: DataFrame, path: str = "path", text: str = "text", search: Search | None = None) -> DataFrame:
    """path, cost, damage, n_tokens, first_edit, exact of each row with a source extension; all but path are
    null where text is. search: None for least costs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [judge(p.as_py(), t.as_py(), search) for p, t in zip(batch.column(0), batch.column(1), strict=True)]
            cols = list(zip(*out, strict=True)) or [()] * len(_JUDGED)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, kind) for c, (_, kind) in zip(cols, _JUDGED, strict=True))], names=["path", *(name for name, _ in _JUDGED)])

    wanted = "\\.(" + "|".join(map(re.escape, L.EXTENSIONS)) + ")$"
    source = docs.filter(F.col(path).rlike(wanted)).select(F.col(path).alias("path"), F.col(text).alias("text"))
    return spread(source, "path").mapInArrow(run, "path string, cost int, damage string, n_tokens int, first_edit int, exact boolean")
