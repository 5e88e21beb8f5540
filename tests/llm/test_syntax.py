import ast
import warnings

import pytest

from fathomgrid.llm.sourcefiles import fault_rates, parsed
from fathomgrid.llm.syntax import parse

VALID = {
    "py": ["x = 1\n", "async def f(a, *, b: int = 1, **k) -> int:\n    return [i async for i in a if i]\n", "match x:\n    case [1, *_] if y:\n        pass\n", 'f"{x!r:>{w}} {f\'{y}\'}"\n', "with (open(a) as b, c):\n    ...\n", "x: int\nx, *y = z = 1, 2\n", '"""\n<<<<<<< HEAD\n"""\n'],
    "js": ["const f = async ({ a, b = 1 }, ...c) => { for await (const x of a) y(`t ${x + `n ${1}`}`) }\n", "a\nb\n", "export default class extends A { static #p = 1; get x() { return this.#p } }\n", "x = a / b / c; y = /[/]\\/x/g.test(s)\n", "label: for (;;) { break label }\n", "// only a note"],
    "ts": ["type A<T> = T extends string ? { [K in keyof T]?: T[K] } : readonly string[];\n", "export abstract class B<T extends object = {}> implements C { private constructor(readonly a: number, b?: string) { super(); } abstract m(): void; }\n", "const f = <T,>(x: T): x is T => x as unknown as T;\nfoo<Map<string, number[]>>(y!);\n", "enum E { A = 1, B }\ndeclare module 'm' { export const x: number }\n"],
    "go": ["package a\n\nimport (\n\t\"x\"\n)\n\ntype T[K comparable] struct {\n\tA, B int `json:\"a\"`\n\t*C\n}\n\nfunc (t *T[K]) F(a ...int) (x int, err error) {\n\tif v, ok := m[K{1}]; ok {\n\t\treturn v, nil\n\t}\n\tgo func() { ch <- 1 }()\n\tselect {\n\tcase x := <-ch:\n\t\t_ = x\n\t}\n\tfor i := range 10 {\n\t}\n\treturn\n}\n"],
    "java": ["package a.b;\n@X(y = {1, 2}) public sealed class A<T extends B & C> permits D { record P(int x) {} enum E { A(1) { void f() {} }, B; } int[] a = {1, 2}, b[]; <R> R f(Map<String, List<? super T>> m) throws X { var g = (Runnable & S) () -> h(); if (o instanceof P(int q) && q > 1 >> 2) {} return switch (x) { case 1, 2 -> a[0]; default -> { yield (int) 3L; } }; } }\n"],
    "rs": ["#![allow(x)]\nuse a::{b as c, d::*};\nimpl<'a, T: Fn(&str) -> u8 + 'a> X<'a, T> for Y where T: Z { const N: usize = 1; async fn f(&mut self, (a, b): (u8, [u8; 3])) -> Option<Vec<Vec<u8>>> { let Some(x) = y else { return None }; let s = S { a, ..Default::default() }; 'l: loop { break 'l } match x { 0..=9 | b'a' if x > 1 => {} S { a: ref q, .. } => (), _ => m!{ x } } a.0.1 as u32; v.iter().map(|x| x + 1).collect::<Vec<_>>()?; x } }\n", "/* /* nested */ */\n"],
    "php": ["<?php\nnamespace A\\B;\nuse function C\\{d, e};\n#[X(1)]\nfinal class F extends G implements H { use T; public function __construct(private readonly ?int $a = null, int|string ...$b) {} const X = 1; }\n$f = fn (int &$x): array => [...$a, 'k' => $x?->y['z']];\nforeach ($a as $k => [$b, $c]):\n echo match (true) { $k > 1 => 'a', default => throw new E };\nendforeach;\n$t = <<<T\n {$x}\n T;\n?>\n<b>if (x {</b>\n", "plain text\n"],
    "rb": ["# c\nclass A < B::C\n  attr_reader :a, :b\n  def self.f(a, b = 1, *c, d:, e: 2, **f, &g)\n    x = y if a&.b? && !c\n    puts \"a #{b ? 'c' : \"d\"}\", %w[a b], :s, /re[x]\\/x/i\n    h = { a: 1, 'b' => 2, c: }\n    z.each_with_object({}) do |(k, v), acc|\n      acc[k] ||= v\n    rescue E, F => e\n      retry\n    ensure\n      w\n    end\n    case a\n    when 1..2, Integer then b\n    else c\n    end\n    <<~T + 'x'\n      text\n    T\n  end\nend\n", "=begin\n<<<<<<< HEAD\n=end\nx = a ? b : c\n"],
}
INVALID = {
    "py": ["def f(:\n", "x = (1\n", "if x:\ny\n", "f() = 1\n", "<<<<<<< HEAD\nx = 1\n=======\nx = 2\n>>>>>>> b\n", "x = '\n", "f(a=1, b)\n", "try:\n    x\n", "x = 1 2\n", "9a = 1\n"],
    "js": ["function f( {", "let x: number = 1;", "a b", "const x = `a ${b`;", "interface A { x: number }", "x = {a: 1", "'abc\n", "}", "return return;"],
    "ts": ["const x: = 1;", "function f(a: number { }", "interface A { x: }", "class A { m( }"],
    "go": ["func f() {}\n", "package a\nfunc f() {\n\tx := map[string\n}\n", "package a\nx := 1\n", "package a\nfunc f() { if { } }\n", "package a\nvar s = \"a\n"],
    "java": ["public class A {", "class A { int f( { } }", "class A { void f() { x } }", "class A { void f() { int x = ; } }", "# text"],
    "rs": ["fn f() { let x = ; }", "fn f( {}", "struct A { a: u8", "fn f() { println!(\"a\" }", "let x = 1;", "fn f() { \"abc }"],
    "php": ["<?php $x = ;", "<?php function f( {", "<?php if ($x) {", "<?php $a = 'x", "<?php 1 = $x;", "<?php foo bar;"],
    "rb": ["def f\n  x\n", "class a\nend\n", "x = [1, 2\n", "if x\n", "puts 'a\n", "def f(a):\nend\n", "end\n", "a = {b: }c\n"],
}


@pytest.mark.parametrize("ext", sorted(VALID))
def test_valid(ext):
    for text in VALID[ext]:
        assert parse(f"a/b.{ext}", text).errors == (), text


@pytest.mark.parametrize("ext", sorted(INVALID))
def test_invalid(ext):
    for text in INVALID[ext]:
        assert not parse(f"a/b.{ext}", text).valid, text


@pytest.mark.parametrize("ext", sorted(VALID))
def test_marks_line_ends_and_empty_files(ext):
    text = VALID[ext][0]
    assert parse(f"x.{ext}", "﻿" + text.replace("\n", "\r\n")).valid
    assert parse(f"x.{ext}", "").valid and parse(f"x.{ext}", None).valid and parse(f"x.{ext}", " \n").valid


def test_every_fault_is_kept_and_the_first_comes_first():
    got = parse("a.py", "x = (\ny = 1\n")
    assert got.errors[0][0] <= got.errors[-1][0]
    assert len(parse("a.js", "a b\nlet x = 1;\nc d\n").errors) == 2
    assert parse("a.unknown", "(((").language is None and parse(None, "(").language is None
    assert parse("a.py", "(" * 3000 + ")" * 3000) is not None


def test_agrees_with_the_interpreter_on_its_own_library():
    warnings.simplefilter("ignore")
    import json, textwrap, typing  # noqa: E401

    for module in (json, textwrap, typing, ast):
        text = open(module.__file__, encoding="utf-8").read()
        assert parse("a.py", text).valid
        for cut in range(len(text) // 7, len(text), len(text) // 7 + 1):
            part = text[:cut]
            try:
                ast.parse(part)
                fine = True
            except SyntaxError:
                fine = False
            assert parse("a.py", part).valid == fine, part[-80:]


def test_table(spark):
    rows = [(1, "r", "a.py", "x = (", "go", None), (2, "r", "b.py", "x = 1", None, None), (2, "r", "b.py", "x = 1", None, None), (3, None, "c.go", None, None, None), (4, "r", None, "(", None, None), (5, "r", "d.txt", "(", None, None)]
    files = spark.createDataFrame(rows, "file_id long, repo_id string, file_path string, content string, language string, valid boolean")
    got = {r["file_id"]: (r["language"], r["valid"]) for r in parsed(files).collect()}
    assert got == {1: ("python", False), 2: ("python", True), 3: ("go", True), 4: (None, None), 5: (None, None)}
    nodes = spark.createDataFrame([("n1", "a.py"), ("n2", "a.py"), ("n3", None)], "id string, file_path string")
    rates = {(r["repo_id"], r["language"]): (r["n_files"], r["n_faulty"], r["n_nodes"], r["rate"]) for r in fault_rates(files, nodes).collect()}
    assert rates == {("r", "python"): (3, 1, 2, 0.333333), (None, "go"): (1, 0, 0, 0.0)}
    assert parsed(files.where("false")).count() == 0


def test_nesting_of_any_depth():
    for path, text in (("a.js", "x = {};\n"), ("a.py", "x = {}\n"), ("a.go", "package a\nvar x = {}\n"), ("a.rs", "fn f() {{ let x = {}; }}\n")):
        assert parse(path, text.format("(" * 3000 + "1" + ")" * 3000)).valid and not parse(path, text.format("(" * 3000 + "1" + ")" * 2999)).valid
