"""Golden rows of the extractors, on texts of our own."""

from symgraph.operators.extract.run import edges_of, extract, extract_files, symbols_of


def syms(path, text):
    return [(s["name"], s["kind"], s["start_line"], s["end_line"], s["exported"]) for s in extract(path, text)[0]]


def edges(path, text):
    return [(e["from"].removeprefix(path + "::"), e["to"], e["kind"]) for e in extract(path, text)[1]]


RUST = """pub fn plus(a: i32, b: i32) -> i32 {
    a + b
}

fn twice(x: i32) -> i32 {
    plus(x, x)
}

pub const LIMIT: i32 = 7;
"""


def test_rust_module():
    assert syms("m.rs", RUST) == [("plus", "function", 1, 3, True), ("twice", "function", 5, 7, False), ("LIMIT", "constant", 9, 9, True)]
    assert edges("m.rs", RUST) == [("twice", "plus", "calls")]


def test_rust_trait_struct_impl_and_macro():
    text = """pub trait Speaker {
    fn speak(&self) -> String;
}

pub struct Loud {
    pub word: String,
}

impl Speaker for Loud {
    fn speak(&self) -> String {
        format!("{}", shout(&self.word))
    }
}
"""
    assert syms("t.rs", text) == [("Speaker", "trait", 1, 3, True), ("speak", "function", 2, 2, False), ("Loud", "struct", 5, 7, True), ("speak", "function", 10, 12, False)]
    assert edges("t.rs", text) == [("Loud", "Speaker", "implements")]


def test_rust_calls_patterns_uses_and_strings():
    text = """use std::io::{self, Read};
pub(crate) async fn run(v: Vec<u8>) -> Option<u8> {
    let Some(x) = v.first() else { return None };
    match make::thing(x) {
        Ok(y) if check(y) => Some(y),
        Err(_) => { let r = r#"fn no() { a() }"#; r.len(); None }
    }
}
enum E { A(u8), B { c: u8 } }
mod inner;
static mut S: u8 = 0;
trait T { type X; }
type Y = Box<dyn Fn(u8) -> u8>;
"""
    got = syms("c.rs", text)
    assert ("run", "function", 2, 8, True) in got and ("E", "enum", 9, 9, False) in got and ("inner", "module", 10, 10, False) in got and ("S", "static", 11, 11, False) in got
    assert not any(g[0] == "X" for g in got) and ("Y", "type", 13, 13, False) in got
    calls = [e for e in edges("c.rs", text) if e[2] == "calls"]
    assert [c[1] for c in calls] == ["first", "thing", "check", "Some", "len"]
    assert ("c.rs", "std::io::{self, Read}", "imports") in edges("c.rs", text)


def test_ts_functions():
    text = """export function plus(a: number, b: number): number {
  return a + b;
}

function twice(x: number) {
  return plus(x, x);
}
"""
    assert syms("f.ts", text) == [("plus", "function", 1, 3, True), ("twice", "function", 5, 7, False)]
    assert edges("f.ts", text) == [("twice", "plus", "calls")]
    assert extract("f.ts", text)[0][0]["signature"] == "function plus(a: number, b: number): number {"


def test_ts_class_and_interface():
    text = """export interface Speaker {
  speak(): string;
}

export class Loud implements Speaker {
  private word: string;
  speak(): string {
    return this.word;
  }
}
"""
    assert syms("c.ts", text) == [("Speaker", "interface", 1, 3, True), ("Loud", "class", 5, 9 + 1, True), ("speak", "method", 7, 9, False)]
    assert edges("c.ts", text) == []


def test_ts_imports_and_object_method():
    text = """import { plus } from './plus';
import Loud from "./loud";

export const tools = {
  greet(n: number) {
    return plus(n, 1);
  },
};
"""
    assert syms("i.ts", text) == [("greet", "method", 5, 7, False)]
    assert sorted(edges("i.ts", text)) == sorted([("greet", "plus", "calls"), ("i.ts", "./plus", "imports"), ("i.ts", "./loud", "imports")])


def test_ts_arrows_templates_and_generators():
    text = """const f = (x) => g(x);
function* gen() { h(); }
class A { m() { return [1].map((y) => k(y)); } get v() { return `${z(1)} } {`; } }
abstract class B {}
type T<X> = { a: X } | null;
"""
    assert syms("a.ts", text) == [("A", "class", 3, 3, False), ("m", "method", 3, 3, False), ("v", "method", 3, 3, False), ("T", "type", 5, 5, False)]
    got = edges("a.ts", text)
    assert ("<anonymous>", "g", "calls") in got and ("<anonymous>", "k", "calls") in got and ("m", "map", "calls") in got


def test_long_and_odd_texts_dont_crash():
    for path in ("x.rs", "x.ts", "x.tsx"):
        for text in ("", "﻿", "}" * 5000, "{" * 5000, "'" * 3000, "/*" * 2000, "fn f(" * 3000, "a(" * 3000 + ")" * 3000):
            extract(path, text)


def test_spark_wrapper(spark):
    df = spark.createDataFrame([("m.rs", RUST, "x"), ("n.rs", None, "x"), ("o.txt", "fn f() {}", "x"), ("p.rs", "", "x")], "path string, text string, symbols string")
    e = extract_files(df)
    assert {(r.qualified_name, r.ordinal) for r in symbols_of(e).collect()} == {("m.rs::plus", 0), ("m.rs::twice", 1), ("m.rs::LIMIT", 2)}
    assert [(r.from_qname, r.to_raw, r.line_no) for r in edges_of(e).collect()] == [("m.rs::twice", "plus", 6)]


def test_methods_of_a_class_that_never_ends():
    text = "class A {\n  one() {\n    f();\n  }\n\n  two(a) {\n    g();\n  }\n\n  three() {\n    h();\n"
    syms, _ = extract("a.ts", text)
    assert [(s["name"], s["kind"], s["start_line"], s["end_line"]) for s in syms] == [("one", "method", 2, 4), ("two", "method", 6, 8)]
