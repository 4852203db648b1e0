"""C++ files of many shapes, one per part, and the constructs that each has (TGF13, TGF23)."""

from __future__ import annotations

from pyspark.sql import functions as F

#: (code, rows of kind, parent, name, detail, type, access, line); `@` stands for the part's key.
SHAPES = [
    ('#include "a@.h"\n#include <vector>\nnamespace outer { namespace inner {\nclass K@ : public Base {\n  int x;\n  double* y = 0;\n  void run(int a);\n};\n} }\nint outer::inner::K@::get(int b) {\n  return helper(b);\n}\n',
     [("include", "", "a@.h", "", "", "", 1), ("include", "", "vector", "system", "", "", 2), ("namespace", "", "outer", "", "", "", 3), ("namespace", "outer", "inner", "", "", "", 3), ("class", "outer::inner", "K@", "public Base", "", "", 4), ("field", "outer::inner::K@", "x", "int", "int", "private", 5), ("field", "outer::inner::K@", "y", "double*", "double*", "private", 6), ("method", "outer::inner::K@", "run", "int a", "void", "private", 7), ("function", "outer::inner::K@", "get", "int b", "int", "", 10), ("call", "outer::inner::K@::get", "helper", "", "", "", 11)]),
    ("struct A@ {\n  void f() { int v = 0; }\n  int y;\n  struct In {\n    int q;\n    struct Deep { char c; } d;\n  };\n  double z;\n};\n",
     [("class", "", "A@", "", "", "", 1), ("method", "A@", "f", "", "void", "public", 2), ("field", "A@", "y", "int", "int", "public", 3), ("class", "A@", "In", "", "", "public", 4), ("field", "A@::In", "q", "int", "int", "public", 5), ("class", "A@::In", "Deep", "", "", "public", 6), ("field", "A@::In::Deep", "c", "char", "char", "public", 6), ("field", "A@::In", "d", "Deep", "Deep", "public", 6), ("field", "A@", "z", "double", "double", "public", 8)]),
    ('/* class Ghost { */\n// struct Ghost {\nclass C@ {\n  const char* s = "}; class No {";\n  char c = \'}\';\n  const char* r = R"x(} " class No {)x";\n  int after@;\n};\n',
     [("class", "", "C@", "", "", "", 3), ("field", "C@", "s", "const char*", "const char*", "private", 4), ("field", "C@", "c", "char", "char", "private", 5), ("field", "C@", "r", "const char*", "const char*", "private", 6), ("field", "C@", "after@", "int", "int", "private", 7)]),
    ("template <typename T, class U = std::vector<int>>\nclass T@ : public B<T>, private virtual ns::D {\npublic:\n  std::map<int, std::vector<T>> m;\n  template <class V> V make(std::map<int, V> a, int b = 2) const { return V(a); }\nprotected:\n  std::function<void(int)> fn;\n};\ntemplate <> int T@<int, X>::size() const { return count<int>(1); }\n",
     [("class", "", "T@", "public B<T>, private virtual ns::D", "", "", 1), ("field", "T@", "m", "std::map<int, std::vector<T>>", "std::map<int, std::vector<T>>", "public", 4), ("method", "T@", "make", "std::map<int, V> a, int b = 2", "V", "public", 5), ("call", "T@::make", "V", "", "", "", 5), ("field", "T@", "fn", "std::function<void(int)>", "std::function<void(int)>", "protected", 7), ("function", "T@", "size", "", "int", "", 9), ("call", "T@::size", "count", "", "", "", 9)]),
    ("class D@ {\npublic:\n  D@() : a(1), b{2} { init(); }\n  virtual ~D@() = default;\n  bool operator==(const D@& o) const { return a == o.a; }\n  int operator()(int i) { return i; }\nprivate:\n  int a, *b;\n  unsigned bits : 3;\n  void (*callback)(int, char);\n};\n",
     [("class", "", "D@", "", "", "", 1), ("method", "D@", "D@", "", "", "public", 3), ("call", "D@::D@", "init", "", "", "", 3), ("method", "D@", "~D@", "", "", "public", 4), ("method", "D@", "operator==", "const D@& o", "bool", "public", 5), ("method", "D@", "operator()", "int i", "int", "public", 6), ("field", "D@", "a", "int", "int", "private", 8), ("field", "D@", "b", "int*", "int*", "private", 8), ("field", "D@", "bits", "unsigned", "unsigned", "private", 9), ("field", "D@", "callback", "void", "void", "private", 10)]),
    ("int f@(int n) {\n  if (n > 0) { return g(n); }\n  for (int i = 0; i < n; i++) { obj->run(i); std::max(i, n); }\n  Widget w(n);\n  auto l = [&](int q) { return new Widget(q); };\n  return l(n);\n}\n",
     [("function", "", "f@", "int n", "int", "", 1), ("call", "f@", "g", "", "", "", 2), ("call", "f@", "run", "obj", "", "", 3), ("call", "f@", "std::max", "", "", "", 3), ("call", "f@", "Widget", "", "new", "", 5), ("call", "f@", "l", "", "", "", 6)]),
    ("#ifdef FAST\nclass P@ : Q {\n#else\nclass P@ {\n#endif\n  int k;\n};\n#if 0\nclass Off {\n#else\nclass On@ { int i; };\n#endif\n",
     [("class", "", "P@", "Q", "", "", 2), ("field", "P@", "k", "int", "int", "private", 6), ("class", "", "On@", "", "", "", 11), ("field", "On@", "i", "int", "int", "private", 11)]),
    ('namespace { int hidden@() { return 1; } }\nextern "C" { int c@(void) { return hidden@(); } }\nnamespace a::b { enum class E { x, y }; static int t[] = {1, {2}}; struct S@ { int v; } s; }\n',
     [("function", "", "hidden@", "", "int", "", 1), ("function", "", "c@", "void", "int", "", 2), ("call", "c@", "hidden@", "", "", "", 2), ("namespace", "", "a::b", "", "", "", 3), ("class", "a::b", "S@", "", "", "", 3), ("field", "a::b::S@", "v", "int", "int", "public", 3)]),
    ("}\nint f@() { return 1; }\n}\nclass Open@ {\n  int x;\n  void g() { h(",
     [("function", "", "f@", "", "int", "", 2), ("class", "", "Open@", "", "", "", 4), ("field", "Open@", "x", "int", "int", "private", 5), ("method", "Open@", "g", "", "void", "private", 6), ("call", "Open@::g", "h", "", "", "", 6)]),
    ("class Q@ : public QObject {\n  Q_OBJECT\n  Q_PROPERTY(int n READ n)\npublic slots:\n  void go@();\npublic:\n  [[nodiscard]] auto size() const noexcept -> int { return n_.size(); }\n  int n_ = 1'000;\n  enum { one, two };\n  friend class Z;\n  using type = int;\n};\n",
     [("class", "", "Q@", "public QObject", "", "", 1), ("method", "Q@", "go@", "", "void", "public", 5), ("method", "Q@", "size", "", "auto", "public", 7), ("call", "Q@::size", "size", "n_", "", "", 7), ("field", "Q@", "n_", "int", "int", "public", 8)]),
]


def files(part):
    """path, language, code: a file per part, its shape by the key."""
    code = F.element_at(F.array(*(F.lit(c) for c, _ in SHAPES)), (F.col("p_partkey") % len(SHAPES) + 1).cast("int"))
    key = F.col("p_partkey").cast("string")
    return part.select(F.concat(F.lit("src/c"), key, F.lit(".cpp")).alias("path"), F.lit("cpp").alias("language"), F.replace(code, F.lit("@"), key).alias("code"))


def _row(row) -> str:
    return "[" + ", ".join("'" + str(x).replace("'", "''") + "'" for x in row) + "]"


#: The constructs as SQL: p_partkey and x, a list of a construct's columns.
ROWS_SQL = "(" + " UNION ALL ".join(f"SELECT p_partkey, unnest([{', '.join(map(_row, rows))}]) AS x FROM part WHERE p_partkey % {len(SHAPES)} = {i}" for i, (_, rows) in enumerate(SHAPES)) + ")"
_at = lambda i, name: f"replace(x[{i}], '@', p_partkey::VARCHAR) AS {name}"
CONSTRUCTS_SQL = f"SELECT 'src/c' || p_partkey || '.cpp' AS path, {', '.join(_at(i + 1, c) for i, c in enumerate(('kind', 'parent', 'name', 'detail', 'type', 'access')))}, x[7]::INT AS line FROM {ROWS_SQL}"
