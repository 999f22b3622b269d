"""p1, p2, p7, p8, p9, p10 on small tables, against brute force where there is one."""

import base64
import importlib.util
import random

import pytest
from pyspark.sql import functions as F

from symgraph.llm import bpe, funcdocs, grammar, handwritten, leastcost, packing, spans, syntax
from symgraph.operators.extract import lexer as L

TOK = "/opt/tokenizers"
DOC = "doc_id bigint, repo_id string, path string, text string"


# ---- p8


def reference():
    tiktoken = pytest.importorskip("tiktoken")
    spec = importlib.util.spec_from_file_location("public_tok", f"{TOK}/__init__.py")
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    with open(f"{TOK}/byte_bpe_50k.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=mod.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = [None, "", " ", "\n\t  \n", "don't 'tis <|endoftext|>", "a" * 5000, "ab" * 3000 + "é" * 500, "日本語のテキスト mixed 123456789", "\x1c x　   y", "naïve é 😀".encode("utf-16", "surrogatepass").decode("utf-16"), "x\r\n\r\ny   z"]


def test_ids_equal_the_public_tokenizer_and_decode(spark):
    ref = reference()
    df = spark.createDataFrame([(i, "clash", t) for i, t in enumerate([*TEXTS, TEXTS[4]])], "doc_id bigint, ids string, text string")
    got = {r.doc_id: r.ids for r in bpe.encode_texts(df).collect()}
    assert got == {i: ref.encode_ordinary(t) if t else [] for i, t in enumerate([*TEXTS, TEXTS[4]])}
    assert {r.doc_id: r.n_tokens for r in bpe.count_tokens(df).collect()} == {k: len(v) for k, v in got.items()}
    back = {r.doc_id: r.text for r in bpe.decode_ids(bpe.encode_texts(df)).collect()}
    assert back == {i: t or "" for i, t in enumerate([*TEXTS, TEXTS[4]])}
    assert bpe.encode_texts(df.limit(0)).count() == 0


def test_random_strings_equal_the_public_tokenizer():
    ref, enc, rnd = reference(), bpe.encoder(f"{TOK}/byte_bpe_50k.tiktoken"), random.Random(5)
    for alphabet in ("ab ", "etaoin shrdlu", "0123456789.", "aé日\U0001f600 ", "\n\t x'{}();"):
        for _ in range(300):
            s = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 60)))
            assert [int.from_bytes(enc.encode(s)[i : i + 4], "little") for i in range(0, len(enc.encode(s)), 4)] == ref.encode_ordinary(s), s


def test_corpus_round_trip(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    back = bpe.decode_ids(bpe.encode_texts(docs)).withColumnRenamed("text", "back")
    assert docs.join(back, "doc_id").filter(F.coalesce("text", F.lit("")) != F.col("back")).count() == 0


# ---- p9


@pytest.mark.parametrize("shard", [500, 10**9])
def test_packing(spark, shard):
    rnd = random.Random(3)
    sizes = [rnd.choice([0, 1, 2, 3, 5, 8, 13, 21, 34, 55, 64, 90, 100]) for _ in range(400)] + [250, 100, 1000, 101]
    df = spark.createDataFrame([(i, n, "clash") for i, n in enumerate(sizes)] + [(9999, None, "x")], "doc_id bigint, n_tokens int, container string")
    out = packing.pack(df, capacity=100, shard_tokens=shard).toPandas()
    assert out.groupby("container").n_tokens.sum().max() <= 100
    assert out.groupby("doc_id").n_tokens.sum().to_dict() == {**dict(enumerate(sizes)), 9999: 0}
    # only items over the capacity are split, and their pieces are whole but for the last
    pieces = out.groupby("doc_id").piece.count()
    assert all(pieces[i] == max(1, -(-n // 100)) for i, n in enumerate(sizes))
    for _, g in out.sort_values("at").groupby("container"):
        g = g[g.n_tokens > 0]
        assert (g["at"].to_numpy()[1:] >= (g["at"] + g.n_tokens).to_numpy()[:-1]).all()
    if shard > 10**8:
        # no more containers than best fit, decreasing, by brute force
        gaps = []
        for n in sorted((n % 100 for n in sizes if n % 100), reverse=True):
            fits = [g for g in gaps if g >= n]
            if fits:
                gaps.remove(min(fits))
            gaps.append((min(fits) if fits else 100) - n)
        assert out.container.nunique() <= len(gaps) + sum(n // 100 for n in sizes)
    assert packing.pack(df.limit(0)).count() == 0


def test_tiers_change_the_packing():
    """Containers of a tier take windows of their own first, then shorter items, then their own again."""
    import numpy as np

    sizes = np.array([60, 30, 30, 30, 30, 30, 30, 10, 10, 10, 40])
    tiered, opened = packing.fill(sizes, 100, 3)
    assert (tiered, opened) == ([[60, 40], [30, 30, 10, 10, 10], [30, 30, 30], [30]], [0, 1, 1, 1]) and [30, 30, 30, 10] in packing.fill(sizes, 100, 1)[0]
    rnd = random.Random(6)
    many = np.array([min(4096, int(rnd.lognormvariate(6, 1.2)) + 1) for _ in range(20_000)])
    got = {t: packing.fill(many, 4096, t)[0] for t in (1, 3, 5)}
    for t, one in got.items():
        assert sorted(s for c in one for s in c) == sorted(many.tolist()) and max(map(sum, one)) <= 4096
        assert many.sum() / (len(one) * 4096) > 0.99
    assert sorted(map(sorted, got[1])) != sorted(map(sorted, got[5])) != sorted(map(sorted, got[3]))
    assert packing.tier_of(np.array([1, 256, 257, 512, 1024, 1025, 2048, 2049, 4096]), 4096, 5).tolist() == [4, 4, 3, 3, 2, 1, 1, 0, 0]


def test_items_of_one_id_and_of_no_length_are_spread(spark):
    df = spark.range(3000).selectExpr("7 AS doc_id", "0 AS n_tokens")
    out = packing.pack(df, capacity=100, shard_items=500).toPandas()
    assert len(out) == 3000 and (out.container // 2**32).nunique() == 6


def test_step_groups_are_balanced(spark):
    rnd = random.Random(4)
    df = spark.createDataFrame([(i, rnd.randint(1, 90)) for i in range(2000)], "doc_id bigint, n_tokens int")
    r = packing.fill_report(packing.pack(df, capacity=100), 100).first()
    assert r.filled > 0.97 and r.worst_group < 1.35


# ---- p10


def brute(docs, span):
    seen = {}
    for i, t in docs:
        for a in range(len(t or "") - span + 1):
            seen.setdefault(t[a : a + span], set()).add(i)
    pairs = {(a, b) for s in seen.values() for a in s for b in s if a < b}
    cover = {}
    for i, t in docs:
        c = [False] * len(t or "")
        for a in range(len(t or "") - span + 1):
            if len(seen[t[a : a + span]]) > 1:
                c[a : a + span] = [True] * span
        cover[i] = sum(c)
    return pairs, cover


@pytest.mark.parametrize("bucket", [50_000, 3])
def test_shared_spans(spark, bucket, monkeypatch):
    monkeypatch.setattr(spans, "BUCKET", bucket)
    monkeypatch.setattr(spans, "PAIR_BLOCK", 4)
    rnd = random.Random(1)
    word = lambda n: "".join(rnd.choice("abcd é日") for _ in range(n))
    shared, header = word(60), word(18)
    docs = [(i, word(rnd.randint(0, 120))) for i in range(20)]
    docs += [(30 + i, header + word(40)) for i in range(20)]
    docs += [(60 + i, word(rnd.randint(0, 50)) + shared[rnd.randint(0, 20) : rnd.randint(35, 60)] + word(30)) for i in range(20)]
    docs += [(100 + i, "same text for all of these copies, long enough") for i in range(15)]
    docs += [(200, "z" * 300), (201, "z" * 25), (202, word(30) * 3), (203, None), (204, "")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id bigint, text string, mz int, h string")
    pairs, cover = brute(docs, 20)
    assert {tuple(r) for r in spans.shared_pairs(df, span=20, k=8).collect()} == pairs
    assert {r.doc_id: r.shared_chars for r in spans.shared_share(df, span=20, k=8).collect()} == cover
    assert spans.shared_pairs(df.limit(0), span=20, k=8).count() == 0
    sets = {}
    for r in spans.shared_sets(df, span=20, k=8).collect():
        sets.setdefault((r.set_a, r.set_b, r.n), set()).add(r.doc)
    assert all(len(s) == k[2] for k, s in sets.items()) and {(a, b) for s in sets.values() for a in s for b in s if a < b} == pairs


def test_a_bucket_of_very_many_classes_is_never_gathered(spark, monkeypatch):
    """One passage between different neighbours in all texts: its bucket's strings must not meet in a task."""
    monkeypatch.setattr(spans, "BUCKET", 100)
    gathered = spark.sparkContext.accumulator(0)
    real = spans._shared

    def counted(chunk, span):
        most = {}
        for c in chunk:
            most[c[0]] = most.get(c[0], 0) + 1
        gathered.add(sum(1 for v in most.values() if v > 150))
        return real(chunk, span)

    monkeypatch.setattr(spans, "_shared", counted)
    rnd = random.Random(8)
    word = lambda n: "".join(rnd.choice("abcdefgh") for _ in range(n))
    passage = word(26)
    docs = [(i, word(14) + passage + word(14)) for i in range(800)] + [(9000 + i, word(60)) for i in range(50)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    r = spans.shared_sets(df, span=20, k=8).groupBy("set_a", "set_b").agg(F.count("*").alias("n"), F.max("n").alias("m")).orderBy(F.desc("n")).first()
    assert r.n == r.m == 800 and gathered.value == 0
    assert spans.shared_pairs(df, span=20, k=8).count() == 800 * 799 // 2


def test_long_texts_go_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(spans, "BLOCK", 50)
    rnd = random.Random(2)
    a = "".join(rnd.choice("abcdefgh") for _ in range(700))
    docs = [(1, a), (2, "x" * 90 + a[300:420] + "y" * 33), (3, a[:19])]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert {tuple(r) for r in spans.shared_pairs(df, span=20, k=8).collect()} == brute(docs, 20)[0]


# ---- p2

GOOD = {
    "rs": ["", "// only a comment", "fn f<'a, T: Clone + 'a>(x: &'a mut Vec<T>, (a, b): (u8, u8)) -> Result<(), Box<dyn Error>> where T: Send { let Some(y) = x.pop() else { return Ok(()) }; if let Ok(ref z) = y.get::<u8>(1) && z > 0 { 'l: loop { break 'l; } } for i in 0..=9 { v[i] += 1 << 2; } match x { A | B if y > 0 => vec![1; 3], Foo { a, .. } => { g(|a, b| a + b) } _ => (), } }",
           "#![allow(x)]\n#[derive(Debug)]\npub(crate) struct S<T = u8>(pub T, Vec<Vec<T>>);\nenum E { A = 1, B(u8), C { d: u8 } }\nimpl<T> Tr for S<T> { type X = u8; const Y: u8 = 1; fn f(&self) -> Self::X { self.0.await?; *p = -1; } }\nuse a::{self, b::*, c as d};\nmacro_rules! m { ($x:expr) => { $x + }; }\nm!{ any { thing ] in } }" .replace("] in }", "in }"),
           "static A: [u8; 2] = [0x1f, b'a'];\nconst F: fn(u8) -> u8 = |x| x;\nextern \"C\" { fn c(x: *const u8); }\nfn g() -> impl Fn(u8) -> u8 { move |x| { x as u8 } }\n\ntype T = <A as B>::C;", "/// of f\nfn f() {}\n//// no documentation\n", "﻿fn a() { let s = r#\"{ \" }\"#; let c = '{'; /* { /* nested */ */ }"],
    "ts": ["", "export function f<T extends object = {}>(a?: string, ...b: number[]): a is string { return a!; }\nconst g = async <T,>(x: Map<string, T[]>): Promise<void> => { await x?.y?.[0]?.(1); };\ntype A = { readonly [K in keyof B]?: B[K] } | null;\ninterface I<T> extends J<T>, K { m(): void; (x: number): string; [k: string]: any }\nabstract class C<T> extends D<T> implements I { static x = 1; #p?: number; constructor(private a: string) { super(a) } get v() { return this.#p } async *gen() { yield* x }\n  a = 1\n  b\n}\nenum E { A = 1, B }",
           "switch (x) { case 'a': f(1); break; default: y = 0x1f; }\ndo { i-- } while (i > 0)\nfor (const [k, v] of m) if (k) continue; else break\ntry { a() } catch { b() } finally { c() }\nlabel: for (;;) { break label }\nlet { a, b: { c = 1 }, ...r } = o, [d, , e = 2] = p\nconst re = /[/{]\\/(\"'`)/g.test(s), t = `a ${x ? `b ${y}` : '}'} c`\nx = y / 2 / z; z = a < b ? c : d > e\nexport default class { }\nexport * as ns from './x'\nimport type { T } from \"t\"\nvar f = function* g() {}, o = { async m() {}, get x() { return 1 }, [k]: 1, 'q': 2, ...s }",
           "if (a) b\nelse c", "if (a)\n  b()\nelse if (c)\n  d[1]\nelse\n  e()\n", "function f() {\n  if (a) return 1\n  else return 2\n}", "class A<in out T> {}\ninterface B<out T> {}\nlet out = using, using", "{ using x = f(); await using y = g() }",
           "!function(){var a=1;for(var i=0;i<9;i++)a^=i;return a}();(()=>{e.x=function(m){return m}})();"],
    "tsx": ["export const A = () => <div className=\"a\" {...p} onClick={() => f({ a: 1 })}>it's {x ? <b/> : null} text <></></div>;", "const x = <T,>(a: T) => a;"],
}
BAD = {
    "rs": ["fn f() {", "fn fn f() {}", "fn f() { let x = ; }", "<<<<<<< ours\nfn a() {}\n=======\nfn b() {}\n>>>>>>> theirs\n", "fn f() } {", "key = \"value\"\n[section]", "fn f() { foo(1) bar(2) }", "fn f( { }", "let x = 1;", "fn f() { \"open }", "fn f() {}\n/// of nothing", "fn f() { g();\n /** of nothing */ }"],
    "ts": ["function f( {", "const x = ;", "{ \"a\": 1, \"b\": [2] }", "a b c", "class A { x( }", "if (x { y() }", "const s = 'open\n';", "return <div>a</div>;", "pub fn f() -> u8 { 1 }", "foo() bar()", "x = `open ${"],
    "jsx": ["const a = <div>;", "const a = <div></span>;", "const a = <div>{x</div>;"],
}


@pytest.mark.parametrize("ext", sorted(GOOD))
def test_valid_sources_cost_nothing(ext):
    for t in GOOD[ext]:
        assert syntax.judge(f"a.{ext}", t)[0] == 0, t


@pytest.mark.parametrize("ext", sorted(BAD))
def test_broken_sources_cost_edits(ext):
    for t in BAD[ext]:
        assert syntax.judge(f"a.{ext}", t)[0] > 0, t


def test_kinds_of_damage():
    whole = "fn f(a: u8) -> u8 {\n    g(a);\n    a + 1\n}\n"
    assert syntax.judge("a.rs", whole * 20 + "fn h() { if a {")[1] == "truncation"
    assert syntax.judge("a.rs", whole + "<<<<<<< HEAD\n=======\n>>>>>>> b\n")[1] == "conflict"
    assert syntax.judge("a.rs", "\n".join("key_%d = value to be read = %d" % (i, i) for i in range(40)))[1] in ("mismatch", "other")
    assert syntax.judge("a.rs", whole.replace("g(a);", "g(a;"))[1] == "other"


def test_edit_places_tell_the_damage():
    assert syntax.judge("a.rs", "let y = ) + ( 2;")[1] == "other"
    whole = "fn f(a: u8) -> u8 {\n    g(a);\n    a + 1\n}\n"
    tokens = syntax.judge("a.rs", whole)[2]
    for cut in ("fn h() { if a { g(1, ", "fn h() { let x = ", "struct S { a: u8,", "fn h() { g(1); }\nfn", "fn h() { \"open"):
        cost, damage, n, first, _ = syntax.judge("a.rs", whole * 3 + cut)
        assert damage == "truncation" and first >= 3 * tokens and cost > 0, cut
    # an edit in the middle is where it is, and none is where nothing is wrong
    assert syntax.judge("a.rs", whole + "fn h() { g(1 2); }\n" + whole)[3] == tokens + 8
    assert syntax.judge("a.rs", whole)[3:] == (None, True)


def test_least_cost_of_small_edits():
    p = syntax.parser(L.RUST)
    for toks, cost in ((("let", "id", "=", "num", ";"), 0), (("let", "id", "num", ";"), 1), (("let", "id", "=", ";"), 1), (("let", "let", "id", "=", "num", ";"), 1)):
        p.searches = 0
        assert p.repair("Stmts", toks, syntax.SHALLOW)[0] == cost or (cost == 0 and p.segment("Stmts", toks))


@pytest.mark.parametrize("family", [L.RUST, L.TS])
def test_least_cost_equals_brute_force(family):
    """By the chart, against all ways to delete, replace or insert up to three tokens."""
    p, rule = syntax.parser(family), "Stmts" if family == L.RUST else "Seg"
    whole = lambda toks: p.parse(rule, toks, 0) == 0

    def brute(toks):
        seen = {toks}
        for cost in range(4):
            if any(map(whole, seen)):
                return cost
            seen = {x for s in seen for i in range(len(s) + 1) for x in (s[:i] + s[i + 1 :], (*s[:i], syntax.ANY, *s[i + 1 :]), (*s[:i], syntax.ANY, *s[i:]))}
        return None

    rnd, deep = random.Random(12), syntax.Search(3, 24, 10**9, True)
    words = ["id", "num", "=", ";", "let", "+", ".", "if", ":", "return"]
    met = set()
    for _ in range(120):
        toks = tuple(rnd.choice(words) for _ in range(rnd.randint(2, 6)))
        if whole(toks):
            continue
        cost, _, exact = p.repair(rule, toks, deep)
        want = brute(toks)
        assert cost == (want or 4) and exact == (want is not None), toks
        met.add(cost)
    assert {1, 2} <= met and max(met) > 2


def test_least_cost_has_no_limit():
    """Long segments, many edits in one, and many segments that fail."""
    judge = lambda t: syntax.judge("a.rs", t)[::4]
    assert judge("fn f() { let a = " + " + ".join(["1 2"] * 6) + "; }") == (6, True)
    assert judge("fn f() { let a = " + " + ".join(["1 2"] * 12) + "; }") == (12, True)
    assert judge("fn f() { let let a = = 1; }") == (2, True)
    assert judge("fn f() { " + "let let a = = 1; " * 40 + "}") == (80, True)


@pytest.mark.parametrize("family", [L.RUST, L.TS])
def test_least_cost_over_spans_equals_the_chart(family, monkeypatch):
    p, rule = syntax.parser(family), "Stmts" if family == L.RUST else "Seg"
    rnd, chart = random.Random(5), syntax.Search(3, 24, 10**9, True)
    words = ["id", "num", "=", ";", "let", "+", ".", "if", ":", "return", "<", ">", ","]
    met = set()
    for _ in range(30):
        toks = tuple(rnd.choice(words) for _ in range(rnd.randint(2, 8)))
        got = p.least(rule, toks)
        cost, _, exact = (0, 0, True) if p.segment(rule, toks) else p.repair(rule, toks, chart)
        assert got == cost if exact else got >= cost, toks
        met.add(got)
        with monkeypatch.context() as m:  # as long segments are done
            m.setattr(leastcost, "LONG", 0)
            m.setattr(leastcost, "FIRST", 1)
            m.setattr(leastcost, "IN_MEMORY", 0)
            assert p.least(rule, toks) == got, toks
    assert {1, 2, 3} <= met and max(met) > 3


def test_grammars_name_only_rules_they_have():
    for text in (grammar.RUST, grammar.TS):
        rules = syntax._compile(text)
        def walk(x):
            if x[0] == "n":
                assert x[1] in rules, x[1]
            for y in x[1:]:
                if isinstance(y, tuple):
                    walk(y)
        for r in rules.values():
            walk(r)


def test_repairs_of_a_table(spark):
    df = spark.createDataFrame([(1, "r", "a.rs", None), (2, "r", "b.rs", ""), (3, "r", "c.ts", "x = ;"), (4, "r", "d.md", "x = ;"), (5, "r", None, "x")], DOC)
    assert {(r.path, r.cost) for r in syntax.repairs(df).collect()} == {("a.rs", None), ("b.rs", 0), ("c.ts", 1)}


def test_deep_and_long_texts():
    assert syntax.judge("a.ts", "x = " + "(" * 2000 + "1" + ")" * 2000 + ";")[0] == 0
    assert syntax.judge("a.rs", "static A: [u8; 9] = [" + "1, " * 50_000 + "];")[0] == 0
    assert syntax.judge("a.ts", "(" * 5000)[0] > 0


# ---- p1


def test_not_handwritten(spark):
    own = "export function keep(a) {\n  if (a.b) {\n    return a.c(1);\n  }\n  return 'x';\n}\n"
    lib = "export function lib(q, r) {\n  while (q.next(r)) {\n    q.step -= r * 2;\n  }\n  return q;\n}\n"
    docs = [
        ("a", "a/src/own.ts", own), ("b", "b/src/own.ts", own), ("a", "a/src/vendors/mine.js", own.replace("keep", "mine")), ("a", "a/vendor/x/lib.js", lib), ("b", "b/src/util.js", "/* changed */ " + lib.replace("\n", "\n\n")), ("a", "a/src/g.ts", "// Code generated by t v1. DO NOT EDIT.\n" + own.replace("keep", "g")),
        ("a", "a/src/de.rs", "// Automatisch erzeugt aus a.xml, bitte nicht bearbeiten. (ab12)\nfn f() {}\n"), ("a", "a/src/order.rs", "/* do not edit the list order, it matters */\nuse a::b::{Cccc, Dddd};\nuse e::f::{Gggg, Hhhh};\n\ntype Kkkkk = HashMap<String, Lllll>;\n"),
        ("a", "a/src/talk.ts", "// this table was generated once; since then it is kept by hand\n" + own.replace("keep", "talk") + "// @generated is what others write\n"), ("a", "a/src/data.ts", "export default [" + "[1.5, -2, 'x'],\n" * 30 + "];"), ("a", "a/src/m.js", "!function(){" + "var a={b:1,c:2};for(var i=0;i<9;i++)a[i]^=1;" * 9 + "}();"),
        ("a", "a/src/num.js", "exports.A_0 = 0x1;\nexports.decodeB1 = function (r) { return r; };\nvar C2_x = 1;\nexports.D_3 = 4;\n"), ("a", "a/dist/o.js", own.replace("keep", "o")), ("a", "a/src/null.rs", None), ("a", "a/src/empty.rs", ""), ("b", "b/src/empty.rs", ""), ("b", "b/q.min.js", None),
    ]
    d = spark.createDataFrame([(i, *x) for i, x in enumerate(docs)], DOC)
    f = spark.createDataFrame([(p, "x") for _, p, _ in docs] * 2 + [(None, "x"), ("a/readme.md", "x")], "path string, h string")
    got = {r.path: r.reason for r in handwritten.not_handwritten(f, d).collect()}
    assert got == {"a/vendor/x/lib.js": "vendored", "b/src/util.js": "vendored", "a/src/g.ts": "generated", "a/src/de.rs": "generated", "a/src/data.ts": "data", "a/src/m.js": "minified", "a/src/num.js": "generated", "a/dist/o.js": "generated", "b/q.min.js": "generated"}
    assert handwritten.not_handwritten(f.limit(0), d.limit(0)).count() == 0


def test_merkle_of_equal_folders(spark):
    leaves = spark.createDataFrame([("a/v/x/1.rs", "a", 1, True), ("a/v/x/2.rs", "a", 2, False), ("b/w/y/9.rs", "b", 2, False), ("b/w/y/8.rs", "b", 1, False), ("b/w/z/7.rs", "b", 1, False), ("top.rs", "b", 5, False), (None, "b", 1, False)], "path string, repo_id string, h bigint, marked boolean")
    h = {r.node: r.h for r in handwritten.merkle(leaves.withColumn("long", F.lit(True))).collect()}
    assert h["a/v/x"] == h["b/w/y"] != h["b/w/z"] and h["a/v"] != h["b/w"] and set(h) == {"top.rs", "a", "a/v", "a/v/x", "a/v/x/1.rs", "a/v/x/2.rs", "b", "b/w", "b/w/y", "b/w/y/8.rs", "b/w/y/9.rs", "b/w/z", "b/w/z/7.rs"}
    # the same files at the same depths, but not in the same folders
    other = spark.createDataFrame([(f"{r}/{d}/{i}.rs", r, i, False) for r, split in (("p", "xxyy"), ("q", "xyyx")) for i, d in enumerate(split)], "path string, repo_id string, h bigint, marked boolean")
    h = {r.node: r.h for r in handwritten.merkle(other.withColumn("long", F.lit(True))).collect()}
    assert h["p"] != h["q"] and handwritten.merkle(other.withColumn("long", F.lit(True)).limit(0)).count() == 0


def test_only_the_shared_subtree_is_vendored(spark):
    """A marked copy below two projects' own files, a package five folders deep, and what many repositories hold."""
    row = lambda p, h, origin=False: (p, p.split("/")[0], h, 50, origin)
    shallow = [row("r1/src/own.rs", 1), row("r1/src/lib/v.rs", 2, True), row("r2/app/mine.rs", 3), row("r2/app/lib/v.rs", 2)]
    deep = [row(f"{r}/pkg/{p}", h, r == "r1" and h == 14) for r in ("r1", "r3") for p, h in (("a.rs", 10), ("x/b.rs", 11), ("x/y/c.rs", 12), ("x/y/z/d.rs", 13), ("x/y/z/w/e.rs", 14), ("x/y/z/w/v/f.rs", 15))]
    many = [row(f"s{i}/util/u{i}.rs", 20) for i in range(handwritten.UNRELATED)]
    few = [row(f"s{i}/util/few{i}.rs", 21) for i in range(handwritten.UNRELATED - 1)]
    leaves = spark.createDataFrame(shallow + deep + many + few, "path string, repo_id string, h bigint, n_tokens int, origin boolean").withColumn("marked", F.col("origin"))
    assert {r.path for r in handwritten.vendored(leaves).collect()} == {"r1/src/lib/v.rs", "r2/app/lib/v.rs"} | {r[0] for r in deep + many}


def test_whole_subtrees_are_vendored(spark):
    """A package in two repositories under neutral names, with a notice in one file only."""
    row = lambda p, h, origin=False, n=50: (p, p[0], h, n, origin)
    pkg = lambda at: [row(f"{at}/lib.rs", 1, at[0] == "a"), row(f"{at}/src/m.rs", 2), row(f"{at}/src/net/tcp/x.rs", 3), row(f"{at}/src/net/tcp/small.rs", 4, n=2)]
    # a marked file alone in its folder, above files that differ: only the file itself is a copy
    alone = [row("a/u/one.rs", 9, True), row("b/u/one.rs", 9), row("a/u/deep/p.rs", 21), row("b/u/deep/p.rs", 22), row("a/own.rs", 31), row("b/own.rs", 32)]
    # shared folders around a dependency folder are the projects' own
    own = [row(f"{r}/app/{x}", h) for r in "ab" for x, h in (("main.rs", 41), ("vendor/d.rs", 42))]
    leaves = spark.createDataFrame(pkg("a/pkg") + pkg("b/copy/of") + alone + own, "path string, repo_id string, h bigint, n_tokens int, origin boolean")
    leaves = leaves.withColumn("marked", F.col("origin") | handwritten.in_dependency_dir(F.col("path")))
    got = {r.path for r in handwritten.vendored(leaves).collect()}
    want = {r[0] for r in pkg("a/pkg") + pkg("b/copy/of")} | {"a/u/one.rs", "b/u/one.rs", "a/app/vendor/d.rs", "b/app/vendor/d.rs"}
    assert got == want


# ---- p7

SYM = "qualified_name string, short_name string, kind string, file_path string, start_line int, signature string, jsdoc string, synthesized_description string"


NAMES = ["merge_graph", "cut_tape", "read_old_orders"]
TRIVIAL = [None, "", "/** */", "///", "@param a\n@returns", "* `a` - the a", "Does {}.", "TODO: document", "n/a", "// eslint-disable-next-line", "@author team-1", "@since 1.0", "let x = {}(a);", "```\ncode here that says much\n```", "Sorry, I can't.", "<p></p>", "A function named {} with 2 parameters.", "2024-01-01", "description: \"\"", "Error: model timed out", "{{@inheritDoc}}"]
TELLING = ["/// Returns -1 once the lock is stale.", "/**\n * @deprecated\n * Falls back to the cache.\n */", '#[doc = "Écrit chaque dossier modifié"]', "キャッシュを更新して書き込みます", "@param a the stale lock to drop", "Liefert den Ordner nur dann."]


def test_trivial_and_telling_documentation(spark):
    """What stands over three different names is common; what is said of one name is not, however often the
    function is copied."""
    rows, docs = [], []
    for f, name in enumerate(NAMES):
        for i, d in enumerate(TRIVIAL):
            rows.append((f"p{f}::t{i}", name, "function", f"p{f}_{i}.rs", 1, f"fn {name}(a: u8)", d and d.format(name), None))
    for i, d in enumerate(TELLING):
        for copy in range(4):
            rows.append((f"g{i}_{copy}", NAMES[i % 3], "method", f"g{i}_{copy}.rs", 1, f"fn {NAMES[i % 3]}(a: u8)", None if copy % 2 else d, d))
    docs = [(i, "r", r[3], f"fn {r[1]}(a: u8) {{\n  g();\n}}\n") for i, r in enumerate(rows)]
    s = spark.createDataFrame([*rows, ("p::k", "K", "class", "p0_0.rs", 1, "class K", TELLING[0], None)], SYM)
    d = spark.createDataFrame(docs, DOC)
    assert {r.qualified_name for r in funcdocs.found(s, d).collect()} == {r[0] for r in rows if r[0][0] == "g"}
    # the texts decide which functions there are
    assert {r.qualified_name for r in funcdocs.found(s, d.filter("path LIKE 'g1%'")).collect()} == {f"g1_{c}" for c in range(4)}
    assert funcdocs.found(s, d.withColumn("text", F.lit("// fn merge_graph() {}"))).count() == 0
    assert funcdocs.found(s.limit(0), d.limit(0)).count() == 0


def test_a_comment_in_the_source_is_documentation(spark):
    """p7_pairs takes it where the symbol has none; notes that are no documentation comments stay out."""
    text = "/// Drops the stale lock of a shelf.\n#[inline]\nfn one() {\n  g();\n}\n// Keeps another lock in sync.\nfn two() {\n}\n"
    docs = spark.createDataFrame([(1, "r", "a.rs", text)], DOC)
    s = spark.createDataFrame([(f"a.rs::{n}", n, "function", "a.rs", line, f"fn {n}()", None, None) for n, line in (("one", 3), ("two", 7))], SYM)
    assert [(r.qualified_name, r.documentation, r.doc_source) for r in funcdocs.pairs(s, docs).collect()] == [("a.rs::one", "/// Drops the stale lock of a shelf.", "comment")]
    assert funcdocs.found(s, docs).count() == 0


def test_pairs_carry_code_and_comment(spark):
    rust = "/// Drops the stale lock.\npub(crate) fn one(a: u8) -> u8 {\n    if a > 0 { g(); }\n    a\n}\ntrait T { fn two(&self); }\n"
    ts = "class A {\n  /**\n   * Sorts by age.\n   */\n  async run(q = {}, r: { x: number }): Promise<void> {\n    other(q);\n    if (r) { x(); }\n  }\n}\n"
    docs = spark.createDataFrame([(1, "r", "a.rs", rust), (2, "r", "b.ts", ts), (3, "r", "c.ts", None), (4, "r", None, "x")], DOC)
    got = {(r.name, r.start_line, r.end_line, r.comment) for r in funcdocs.functions(funcdocs.structure(docs)).collect()}
    assert ("one", 2, 5, "/// Drops the stale lock.") in got and not any(g[0] in ("two", "other", "if") for g in got)
    assert {(g[0], g[1], g[2]) for g in got} == {("one", 2, 5), ("run", 5, 8)}
    s = spark.createDataFrame([("a.rs::one", "one", "function", "a.rs", 2, "fn one", "Drops the stale lock.", None), ("c.ts::z", "z", "function", "c.ts", 1, "z()", "Drops the stale lock.", None)], SYM)
    r = funcdocs.pairs(s, docs).collect()
    assert [(x.qualified_name, x.code.split("\n")[0], x.documentation, x.doc_source) for x in r] == [("a.rs::one", "pub(crate) fn one(a: u8) -> u8 {", "/// Drops the stale lock.", "comment")]
    assert funcdocs.documented(s, docs).count() == 1


def test_object_types_in_signatures_are_no_bodies(spark):
    ts = (
        "function one(a): { ok: boolean } {\n  g(a);\n  return { ok: true };\n}\nif (q) {\n  g(1);\n}\n"
        "function two<T extends { x: number; y: T }>(t: T): Promise<{ a: 1 } | { b: () => { c: 2 } }> {\n  return t;\n}\n"
        "class A {\n  run(q): { n: number;\n    m: string } {\n    if (q) { x(); }\n    return q;\n  }\n  abstract no(): { a: 1 };\n  last() {\n    return 1;\n  }\n}\n"
        "declare function none(): X\nexport const h = () => {\n  function inner() {\n    g();\n  }\n}\n"
    )
    docs = spark.createDataFrame([(1, "r", "b.ts", ts)], DOC)
    got = {(r.name, r.start_line, r.end_line) for r in funcdocs.functions(funcdocs.structure(docs)).collect()}
    line = {t: ts[: ts.index(t)].count("\n") + 1 for t in ("function one", "function two", "run(q)", "last()", "function inner")}
    want = {("one", line["function one"], line["function one"] + 3), ("two", line["function two"], line["function two"] + 2), ("run", line["run(q)"], line["run(q)"] + 4), ("last", line["last()"], line["last()"] + 2), ("inner", line["function inner"], line["function inner"] + 2)}
    assert {g for g in got if g[0] != "none"} == want
