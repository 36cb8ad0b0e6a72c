"""The parsers against the languages' own parsers where Python has one, else against hand-made cases."""

import ast
import json
import random
from pathlib import Path

import pytest

from hunkmill.llm.parsing.languages import first_error
from hunkmill.llm.parsing.tables import Tables


def good(language, body):
    return first_error(language, body) is None


def python_takes(body):
    try:
        ast.parse(body)
        return True
    except (SyntaxError, ValueError):
        return False


def json_takes(body):
    def no(_):
        raise ValueError

    try:
        json.loads(body, parse_constant=no)
        return True
    except ValueError:
        return False


@pytest.mark.parametrize("name", ["json/decoder.py", "dataclasses.py", "typing.py", "asyncio/tasks.py", "enum.py", "argparse.py"])
def test_python_like_its_own_parser(name):
    body = Path(ast.__file__).with_name("x").parent.joinpath(name).read_text()
    assert good("python", body)
    rng = random.Random(name)
    lines = body.splitlines(keepends=True)
    wrong = 0
    for _ in range(60):
        start = rng.randrange(max(1, len(lines) - 60))
        part = "".join(lines[start : start + 60])
        at = rng.randrange(len(part))
        one = [part[:at], part[:at] + part[at + 1 :], part[:at] + rng.choice("()[]{}:,='\"\n if=lambda x") + part[at:], "<<<<<<< HEAD\n" + part][rng.randrange(4)]
        wrong += good("python", one) != python_takes(one)
    assert wrong <= 1  # what the compiler checks beyond the grammar, as in f(a=1, b) or a keyword as target


def test_json_like_its_own_parser():
    rng = random.Random(4)
    whole = json.dumps({"a": [1, -2.5e3, None, True, "x\\\"é\n"], "b": {"c": {}, "d": []}}, indent=1)
    for _ in range(500):
        at = rng.randrange(len(whole))
        one = [whole[:at], whole[:at] + whole[at + 1 :], whole[:at] + rng.choice('{}[],:"0a\n\t') + whole[at:]][rng.randrange(3)]
        assert good("json", one) == json_takes(one), one
    assert not good("json", "NaN") and not good("json", "{'a': 1}") and not good("json", "") and good("json", " 1 ")


JS_GOOD = [
    "if (x) /re'/.test(y);", "function f(){}\n/a'b/.test(c)", "var a = b / c / d;", "x = {}\n/ 2 / 1", "const f = async ({a, b = 2}, ...r) => { return a; };", "a\n++b", "for (const [k, v] of m) {}",
    "label: for (;;) { break label }", "export default class A extends B { static x = 1; #p; get y() { return this.#p; } }", "import a, {b as c} from 'd';", "let s = `a${b + `c${d}`}e`;", "x = a ? b : c => d",
    "function* g() { yield* h(); return 1 }", "({ return: 1, throw: 2 });", "if (a) { b() } else c()", "a = (b, c)", "[a, b] = [b, a]", "(a).b = 1", "do x(); while (y) z()", "try { a } catch { b } finally { c }",
]
JS_BAD = ["if (x", "let x = ;", "throw\nx", "1 = x", "return 1", "function f( { }", "a b", "x = {", "'abc", "`a${b", "class { }", "for (;;", "<<<<<<< HEAD\na", "a => {} b", "'x' = 2", "5++"]


@pytest.mark.parametrize("body", JS_GOOD)
def test_javascript_takes(body):
    assert good("javascript", body), first_error("javascript", body)


@pytest.mark.parametrize("body", JS_BAD)
def test_javascript_refuses(body):
    assert not good("javascript", body)


def test_java():
    head = "package a.b;\nimport static x.Y.*;\n"
    for body in (
        "class A<T extends B & C> { int[] x = {1, 2,}; <U> void f(U... u) throws E { for (var y : u) ; } }", "@X(a = {1}, b = \"c\") enum E { A(1) { }, B; E(int... i) {} }", "record R(int a, String b) implements S {}",
        "interface I { default int f() { return switch (x) { case 1, 2 -> 3; default -> { yield 4; } }; } }", "class A { Runnable r = () -> { }; Object o = (A & B) x -> x; int i = (int) -1; List<int[]> l = new ArrayList<>(); }",
        "sealed interface S permits A, B {}", "class A { String s = \"\"\"\n a \" b\n \"\"\"; { if (o instanceof A(var x) && x > 1) a[i]++; } }",
    ):
        assert good("java", head + body), (body, first_error("java", head + body))
        assert not good("java", head + body[:-1]) and not good("java", head + body + "}")


def test_a_rule_with_the_name_of_a_keyword_is_refused():
    with pytest.raises(ValueError):
        Tables("unit : package ;\npackage : package name ;\n")
