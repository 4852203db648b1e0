"""The C++ scanner against files whose constructs are known, as they were written by a generator."""

import random
import time

import pytest

from tessera.operators import cpp
from tessera.plans.cpp_shapes import SHAPES

NOISE = ["", " // class Ghost { int a;", " /* struct Ghost { */", "\n#define OPEN {\n", "\n#if 0\nclass Ghost {\n#endif\n", "\n#ifdef A\n#else\nclass Ghost {\n#endif\n"]
TYPES = ["int", "const char*", "std::vector<int>", "std::map<int, std::vector<double>>", "unsigned long", "ns::T&"]
VALUES = ["", " = 0", ' = "};"', " = '{'", ' = R"x(} class Ghost {)x"', "{}", "{1, {2}}", " = f(1, 2)", " = {1, 2}"]
BODIES = ["{ }", "{ if (a < b) { g(1); } }", '{ g(1); const char* s = "}"; }', "{ for (;;) { switch (a) { case 1: g(1); } } }", "{ auto l = [&](int i) { return g(i); }; }"]


class Writer:
    """Random nested scopes: the code, and a row for each construct."""

    def __init__(self, seed):
        self.rng, self.code, self.rows, self.n = random.Random(seed), [], [], 0

    def name(self):
        self.n += 1
        return f"n{self.n}"

    def line(self, text):
        self.code.append(text + self.rng.choice(NOISE) + "\n")

    def method(self, scope, kind, access):
        name, type_ = self.name(), self.rng.choice(TYPES)
        self.rows.append((kind, scope, name, access))
        head = f"{self.rng.choice(['', 'static ', 'template <class T, int N = (1 < 2)> ', '[[nodiscard]] '])}{type_} {name}(int a, int b = 2)"
        if kind == "method" and self.rng.random() < 0.4:
            self.line(head + self.rng.choice([";", " const;", " = delete;", " noexcept override;"]))
            return
        body = self.rng.choice(BODIES)
        if "g(" in body:
            self.rows.append(("call", f"{scope}::{name}".strip(":"), "g", ""))
        self.line(head + " " + body)

    def scope(self, outer, kind, deep):
        in_class = kind == "class"
        access = "private" if in_class else ""
        for _ in range(self.rng.randrange(1, 6)):
            what = self.rng.choice(["field", "method", "class", "access"] if in_class else ["function", "class", "namespace"])
            if what == "access":
                access = self.rng.choice(["public", "private", "protected"])
                self.line(f"{access}:")
            elif what == "field":
                name = self.name()
                self.rows.append(("field", outer, name, access))
                self.line(f"{self.rng.choice(TYPES)} {name}{self.rng.choice(VALUES)};")
            elif what in ("function", "method"):
                self.method(outer, what, access)
            elif deep:
                name = self.name()
                self.rows.append((what, outer, name, access))
                self.line(f"{what} {name}{self.rng.choice(['', ' : public B<T>']) if what == 'class' else ''} {{")
                self.scope(f"{outer}::{name}".strip(":"), what, deep - 1)
                self.line("};" if what == "class" else "}")


@pytest.mark.parametrize("seed", range(60))
def test_generated_files(seed):
    w = Writer(seed)
    w.scope("", "namespace", 4)
    got = [(kind, parent, name, access) for kind, parent, name, _, _, access, _ in cpp.constructs("".join(w.code))]
    assert sorted(got) == sorted(w.rows), "".join(w.code)


@pytest.mark.parametrize("shape", range(len(SHAPES)))
def test_shapes(shape):
    code, rows = SHAPES[shape]
    assert list(cpp.constructs(code.replace("@", "7"))) == [tuple(x.replace("@", "7") if isinstance(x, str) else x for x in r) for r in rows]


@pytest.mark.parametrize("code", ["", "\n", "}}}}", "{{{{", "class", "class {", "int f(", "(((", ">>>", '"', "R\"(", "/*", "#if\n#else", "#endif", "operator", "a::", "template <", "class A : {", "namespace {", "= ; {", ": ; ,", "class A { operator", "class A { x(", "x() : y{", "class A { ~"])
def test_broken_files(code):
    list(cpp.constructs(code))
    list(cpp.constructs("class A { int x; void f() { g(); } };" + code))


def test_linear_time():
    part = "namespace n { class A { int x = {1, 2}; void f(int a) { if (a < 1) { g(a); } } }; }\n" + "int t[] = {" + "1," * 500 + "};\n"
    times = []
    for n in (20, 200):
        start = time.perf_counter()
        assert sum(r[0] == "class" for r in cpp.constructs(part * n)) == n
        times.append(time.perf_counter() - start)
    assert times[1] < 30 * times[0] + 0.5


def test_null_and_empty_files(spark):
    df = spark.createDataFrame([("a", None), ("b", ""), (None, "int f() { return 1; }")], "path string, code string")
    assert [tuple(r) for r in cpp.cpp_constructs(df).collect()] == [(None, "function", "", "f", "", "int", "", 1)]
