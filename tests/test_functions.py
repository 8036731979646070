from pyspark.sql import functions as F

from entspark.functions import calls as C
from entspark.functions import hashing as H
from entspark.functions import text as T


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_text(spark):
    cases = [
        (T.lines_of(F.lit("a\r\nb\n\n")), ["a", "b", ""]), (T.lines_of(F.lit("")), []), (T.first_line(F.lit("x\ny")), "x"), (T.estimate_tokens(F.lit("a b  c\td e f g h")), 10), (T.normalise_eol(F.lit("a\r\nb\rc")), "a\nb\nc"),
        (T.truncated(F.lit("abcdef"), 5), "ab..."), (T.truncated(F.lit("abcdef"), 2), "ab"), (T.truncated(F.lit("ab"), 5), "ab"), (T.utc_date(F.lit(86400)), "1970-01-02"), (T.dot_chains(F.lit("a.b(c.d) a.b")), ["a.b", "c.d"]),
        (T.references(F.lit("foo(Bar, x) # baz\n'qux' if value"), F.lit("foo")), ["Bar"]), (T.ref_type(F.lit("do(x)"), F.lit("do")), "calls"), (T.ref_type(F.lit("redo(x)\nfrom m import do"), F.lit("do")), "imports"), (T.ref_type(F.lit("redo(x)"), F.lit("do")), "typeref"),
        (T.extensions(F.lit("a/b.svelte.ts")), [".svelte.ts", ".ts"]), (T.extensions(F.lit("Makefile")), []), (T.file_stem(F.lit("a/b.py")), "b"), (T.base_type(F.lit(": &mut Vec<T>")), "Vec"), (T.entity_id(F.lit("f"), F.lit("t"), F.lit("n"), F.lit("p")), "f::p::n"),
        (T.param_count(F.lit("def f(a, b=(1, 2), c: Dict[a, b])")), 3), (T.param_count(F.lit("def f()")), 0), (T.is_test_entity(F.lit("test_x"), F.lit("a"), F.lit("")), True), (T.is_test_entity(F.lit("x"), F.lit("src/tests/a"), F.lit("#[test]")), True), (T.is_test_entity(F.lit("x"), F.lit("a"), F.lit("#[test]")), False),
        (H.content_hash(F.lit("abc"), "xxh3"), "78af5f94892f3950"), (H.content_hash(F.lit("abc")), "900150983cd24fb0d6963f7d28e17f72"), (T.default_similarity(F.lit("a b c d"), F.lit("a b c e")), 0.6), (T.default_similarity(F.lit("a b c d e"), F.lit("a b")), 0.0), (T.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>")), 0.0),
    ]
    row = spark.range(1).select(*(c.alias(str(k)) for k, (c, _) in enumerate(cases))).first()
    for k, (_, want) in enumerate(cases):
        assert row[k] == want, k


def test_structural_proxy(spark):
    a, b, c = (value(spark, H.structural_proxy(F.lit(t), F.lit(n))) for t, n in (("def f(x): return x  # c", "f"), ("def g(x):  return x", "g"), ("def g(x): return y", "g")))
    assert a == b != c


def test_params_and_calls():
    assert C.params("def f(self, a, b=1, *, c, d=2): pass", ".py") == C.Params(2, 4) and C.params("def f(*a): pass", ".py").variadic
    assert C.params("function f(a: number, b?: string, c = 2) {", ".ts") == C.Params(1, 3)
    assert C.params("fn f(&self, a: Vec<(u8, u8)>) {", ".rs") == C.Params(1, 1) and C.params("func (s *S) F(a, b int) {", ".go") == C.Params(2, 2)
    assert C.first_call("def g():\n    return f(1, k=2, *x)", "f", ".py") == (3, 1) and C.first_call("def g(): pass", "f", ".py") is None
    assert C.first_call("function g() {\n  f(1, [2, 3]);\n}", "f", ".js") == (2, 1)
    assert C.call_arguments("x = f(a, g(b, c))", "f") == 2 and C.param_count("def f(self, a):") == 2
