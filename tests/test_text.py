from pyspark.sql import functions as F

from symgraph.functions import text as X


def col(spark, expr, *rows, schema="x string"):
    return [r[0] for r in spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema).select(expr.alias("v")).collect()]


def test_short_names(spark):
    assert col(spark, X.short_name("x"), "a::b::c", "a.b.c", "plain", "a.b::c.d", "", None) == ["c", "c", "plain", "c.d", "", None]


def test_lines(spark):
    assert col(spark, X.lines("x"), "", "a", "a\n", "a\r\nb\n\n", "\n", None) == [[], ["a"], ["a"], ["a", "b", ""], [""], None]


def test_body_slice(spark):
    long = "\n".join(map(str, range(200)))
    got = col(spark, X.body_slice(X.lines("x"), "a", "b"), (long, 1, 200), ("a\nb\nc\n", 2, 9), ("a", 2, 3), (None, 1, 1), ("a\nb", 0, 1), schema="x string, a int, b int")
    assert got[0].split("\n")[59] == "59" and got[0].endswith("\n" + X.TRUNCATED) and len(got[0].split("\n")) == 61
    assert got[1:] == ["b\nc", None, None, None]


def test_rerank_parse(spark):
    assert col(spark, X.parse_rerank("x"), "yes", "Yes", "yes.", " no", "maybe", "", None) == [1.0, 1.0, 1.0, 0.0, None, None, None]


def test_clean_and_trim(spark):
    assert col(spark, X.clean_description("x"), 'Description: "Does it."', "  description:x ", '""', '"', None, " y　") == ["Does it.", "x", "", '"', None, "y"]
    assert col(spark, X.trim_quotes("x"), "\"'m'\"", "'m'", "m") == ["m", "m", "m"]
    assert col(spark, X.defang("x"), "a`b", None) == ["a_b", None]


def test_prompt_leaves_empty_sections_out(spark):
    none = F.array().cast("array<struct<neighbor: string, signature: string>>")
    one = F.array(F.struct(F.lit("p::y").alias("neighbor"), F.lit("fn y()").alias("signature")))
    got = col(spark, X.synthesis_prompt(F.col("x"), F.lit("fn x()"), F.lit(None), none, one), "p::x")[0]
    assert "Body" not in got and "Called by" not in got and got.endswith("\n\nSymbol: p::x\nSignature: fn x()\nCalls:\n- p::y: fn y()\n\nDescription:")


def test_dispatch(spark):
    assert col(spark, X.language_of("x"), "a.rs", "b.tsx", "c.RS", "d", "e.cts", None) == ["rust", "typescript", None, None, "typescript", None]
    assert col(spark, X.excluded("x"), "a/target/b.rs", "a/targets/b.rs", "x/.git/y") == [True, False, True]
    assert col(spark, X.tier("x"), (8.0,), (16.0,), (32.0,), (None,), schema="x double") == ["minimal", "balanced", "max", "balanced"]
