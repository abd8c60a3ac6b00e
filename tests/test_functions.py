"""Golden values of the column functions."""

from pyspark.sql import functions as F

from twinscan.functions import languages, links, paths, text, tokens
from twinscan.functions.kernels import lcs_length, lcs_similarity
from twinscan.functions.similarity import combined_score, length_penalty, length_ratio
from twinscan.operators.tokenize import tokenize
from twinscan.schema import TOKENS


def toks(*pairs):
    rows = [f"named_struct('type', '{t}', 'text', '{x}', 'start', 0, 'end', 0)" for t, x in pairs]
    return F.expr(f"array({', '.join(rows)})").cast(TOKENS)


def test_language_and_links(values):
    names = ["a/Dockerfile", "x.PY", "b/.bashrc", "lib/MAKEFILE", "q.S", "p.unknown", "m.tar.gz", "r.Rmd"]
    got = values(**{f"c{i}": languages.detect_language(F.lit(n)) for i, n in enumerate(names)})
    assert list(got.values()) == ["dockerfile", "python", "python", "make", "asm", "python", "python", "r"]
    contents = ["#!/bin/sh\nls", "#!/usr/bin/env node\n", "<html>", "<a>b</a>", '{"a": 1}', "x = 1"]
    got = values(**{f"c{i}": languages.detect_language(F.lit("none"), F.lit(c)) for i, c in enumerate(contents)})
    assert list(got.values()) == ["bash", "javascript", "html", "xml", "json", "python"]
    assert values(a=languages.is_supported(F.lit("Makefile")), b=languages.is_supported(F.lit("a.MK"))) == {"a": False, "b": True}
    urls = {
        "https://github.com/u/r": ("https://github.com/u/r.git", None),
        "git@github.com:u/r.git": ("https://github.com/u/r.git", None),
        "u/r/": ("https://github.com/u/r.git", None),
        "https://github.com/u/r/tree": (None, None),
        "https://gitlab.com/g/s/r": (None, "https://gitlab.com/g/s/r.git"),
        "git@gitlab.example.com:g/r": (None, "https://gitlab.example.com/g/r.git"),
        "https://gitlab.example.com/g/r": (None, "https://gitlab.example.com/g/r.git"),
    }
    for url, (github, gitlab) in urls.items():
        got = values(a=links.normalize_repo_url(F.lit(url), "github"), b=links.normalize_repo_url(F.lit(url), "gitlab"))
        if github:
            assert got["a"] == github, url
        if gitlab:
            assert got["b"] == gitlab, url
    assert values(a=links.normalize_repo_url(F.lit("https://github.com/u/r/tree"), "github"))["a"] is None
    got = values(a=links.parse_s3_url(F.lit("s3://b/k/x.zip")), b=links.parse_s3_url(F.lit("s3://b")), c=links.repo_name(F.lit("https://h/u/r.git/")))
    assert got == {"a": {"bucket": "b", "key": "k/x.zip"}, "b": None, "c": "r"}


def test_paths(values):
    cases = {
        "/tmp/1b4e28ba-2fa1-11d2-883f-0016d3cca427/proj/src/a.py": "proj/src/a.py",
        "/tmp/.hidden/proj/a.py": "proj/a.py",
        "/data/work/app1/src/a.py": "app1/src/a.py",
        "/home/me/x.py": "//home/me/x.py",  # the root is a segment like any other
    }
    got = values(**{f"c{i}": paths.relative_path(F.lit(p)) for i, p in enumerate(cases)})
    assert list(got.values()) == list(cases.values())
    globs = [
        ("src/**/*.py", "src/a.py", True), ("src/**/*.py", "src/x/y/a.py", True), ("src/**/*.py", "a.py", False),
        ("*.md", "docs/a.md", False), ("READ?E*", "README.md", True), ("[!a]*", "abc", False), ("a.b", "axb", False),
        ("**/t", "t", True), (".*", ".git", True),
    ]
    got = values(**{f"c{i}": paths.glob_match(F.lit(p), F.lit(g)) for i, (g, p, _) in enumerate(globs)})
    assert list(got.values()) == [want for *_, want in globs]
    dirs = [
        ("src", "a/src/b", True), ("src/components", "x/src/components", False), ("src/components", "x/src/components/y", True),
        ("*.tmp", "a/b.tmp", True), ("a*b*c", "a1b2c", False), ("node", "node_modules", False),
    ]
    got = values(**{f"c{i}": paths.dir_pattern_match(F.lit(p), F.lit(g)) for i, (g, p, _) in enumerate(dirs)})
    assert list(got.values()) == [want for *_, want in dirs]


def test_text(values):
    body = F.lit("l0\nl1\nl2\nl3")
    got = values(
        a=text.code_block(body, F.lit(1), F.lit(3)),
        b=text.code_block(body, F.lit(-2), F.lit(99)),
        c=text.code_block(body, F.lit(3), F.lit(2)),
        d=text.strip(F.lit("\u00a0\t x y\u2003\n")),
        e=text.extract_imports(F.lit("import os, sys as s\nfrom a import b  # c\n x\nimport os")),
        f=text.decode_text(F.lit(b"caf\xe9\r\nx\ry").cast("binary")),
        g=text.decode_text(F.lit("é\r\n".encode()).cast("binary")),
    )
    assert got == {"a": "l1\nl2", "b": "l0\nl1\nl2\nl3", "c": "", "d": "x y", "e": ["os", "sys", "b"], "f": "café\nx\ny", "g": "é\n"}


def test_tokens_and_sequences(values):
    t = toks(
        ("function_definition", "def área(x, y):"), ("comment", "# no"), ("identifier", "abc"), ("integer", "3"),
        ("return_statement", "return a + b"), ("if_statement", "if x > 0:"), ("assignment", "x = a | b"),
        ("class_definition", "class VeryLongClassName(Base):"), ("binary_operator", "+"), ("boolean_operator", "and"),
        ("comparison_operator", "=="), ("unary_expression", "!"), ("call", "f(1)"), ("ERROR", "?"),
    )
    p = tokens.prepare_for_similarity(t)
    got = values(
        s=tokens.similarity_signature(t), st=tokens.structural_sequence(p), fl=tokens.logical_flow(p), op=tokens.operations(p),
        d=tokens.detokenize(toks(("a", "x"), ("b", ""), ("c", "y"))), e=F.size(tokens.signature_parts(F.array().cast(TOKENS))),
        trap=tokens.signature_parts(toks(("raise_statement", "a | b"))),
    )
    assert got["s"].split(" | ") == [
        "function_definition:def func(params):", "<VAR>", "<NUMBER>", "return_statement:return expr", "if_statement:if condition:",
        "assignment:var = expr", "class_definition:class VeryLongClassName(Base):", "binary_operator:+", "boolean_operator:and",
        "comparison_operator:==", "unary_expression:!", "call:func(args)",
    ]
    assert got["st"][:5] == ["FUNC_DEF", "VAR", "LITERAL", "RETURN", "CONDITIONAL"] and got["st"][6] == "CLASS_DEFINITION"
    assert got["fl"] == ["return_statement", "if_statement"]
    assert got["op"] == ["METHOD_CALL", "MATH_OP", "LOGIC_OP", "COMPARE_OP", "LOGIC_OP", "METHOD_CALL"]
    assert got["d"] == "x y" and got["e"] == 1 and got["trap"] == ["raise_statement:a", "b"]


def test_tokenize_families(values):
    got = values(
        h=tokenize(F.lit("if x > 1.5:  # note\n  s = 'a # b'"), "hash"),
        s=tokenize(F.lit("while (a && b) { f(x); } // c\n/* d */ i += 2;"), "slash"),
        m=tokenize(F.lit('<p class="x">Über 3</p><!-- c -->'), "markup"),
    )
    kinds = {k: [t["type"] for t in v] for k, v in got.items()}
    assert kinds["h"] == ["if_statement", "identifier", "comparison_operator", "float", "comment", "identifier", "assignment", "string"]
    assert kinds["s"] == ["while_statement", "identifier", "boolean_operator", "identifier", "call", "identifier", "comment", "comment", "identifier", "augmented_assignment", "integer"]
    assert kinds["m"] == ["start_tag", "attribute", "word", "integer", "end_tag", "comment"]
    assert got["h"][0]["text"] == "if x > 1.5:  # note" and got["h"][-1]["start"] == 1


# Collections and signs of a value, in order, among calls, indices, blocks, parameters and types that are none.
NESTED = {
    "python": (
        "x = [1, -2, (3, 4)]\nd = {'a': [1], 'b': {}}\nf(a[0], {1, 2})\nreturn (a, b)\ny = (a + b) * -c[1:2]\nz = foo(\n    [1],\n    -1,\n)\nif x in [1, 2]: pass\n",
        ["list:[1,-2,(3,4)]", "unary_operator:-", "tuple:(3,4)", "dictionary:{'a':[1],'b':{}}", "list:[1]", "dictionary:{}", "set:{1,2}", "tuple:(a,b)", "unary_operator:-", "list:[1]", "unary_operator:-", "list:[1,2]"],
    ),
    "javascript": (
        "const a = [1, 2].map((x, y) => { return x; });\nconst o = { k: [a[0]], m: {} };\nif (a) { b(); }\nfor (const q of [1]) { f({ z: -1 }); }\nimport { adj } from 'x';\nswitch (a) {\ncase 1: { break; }\n}\n",
        ["list:[1,2]", "dictionary:{k:[a[0]],m:{}}", "list:[a[0]]", "dictionary:{}", "dictionary:{z:-1}", "unary_operator:-"],
    ),
    "java": ("int[] a = {1, 2};\nint[] b = new int[] {3};\nvoid f(int x, int y) {\n  a[0] = -1;\n  run((p, q) -> p + q);\n}\n", ["list:{1,2}", "list:{3}", "unary_operator:-"]),
    "go": ("xs := []int{1, -2}\nm := map[string]int{\"a\": 1}\np := Point{1, 2}\nif x == y {\n  xs[0] = 2\n}\nfor i := range xs {\n}\n", ["list:{1,-2}", "unary_operator:-", "dictionary:{\"a\":1}", "list:{1,2}"]),
    "ruby": ("a = [1, -2]\nh = { 'k' => 1 }\nputs a[0]\n[1].each { |x| x }\nreturn [a, h]\n", ["list:[1,-2]", "unary_operator:-", "dictionary:{'k'=>1}", "list:[a,h]"]),
    "lua": ("local t = {1, 2}\nlocal d = {a = 1, [2] = {}}\nprint(t[1], -x)\n", ["list:{1,2}", "dictionary:{a=1,[2]={}}", "list:[2]", "dictionary:{}", "unary_operator:-"]),
    "php": ("$a = [1, 'k' => [2]];\nif ($x) { f(-$a[0]); }\n", ["list:[1,'k'=>[2]]", "list:[2]", "unary_operator:-"]),
    "c": ("int a[3] = {1, -2};\nint f(int x, int y) {\n  return -x + (y);\n}\n", ["list:{1,-2}", "unary_operator:-", "unary_operator:-"]),
    "rust": ("let v = [1, 2];\nlet t = (1, -2);\nfn f(a: u8) -> [u8] {\n  v[0]\n}\n", ["list:[1,2]", "tuple:(1,-2)", "unary_operator:-"]),
    "matlab": ("x = [1, -2];\ny = x(1);\nc = {1, 2};\n", ["list:[1,-2]", "unary_operator:-", "list:{1,2}"]),
    "swift": ("let d = [\"a\": 1]\nlet t = (1, 2)\nfunc f(a: Int, b: Int) -> Int {\n  return -a\n}\n", ["list:[\"a\":1]", "tuple:(1,2)", "unary_operator:-"]),
    "julia": ("a = [1 2]\nt = (1, 2)\nf(x) = a[end] - 1\n", ["list:[12]", "tuple:(1,2)"]),
}


def test_nesting_in_ten_languages(spark):
    from twinscan.operators.tokenize import tokenize_files

    rows = [(language, source) for language, (source, _) in NESTED.items()]
    made = tokenize_files(spark.createDataFrame(rows, "language string, content string")).select("language", "tokens", tokens.structural_sequence(F.col("tokens")).alias("shape"))
    kinds = ("list", "tuple", "dictionary", "set", "unary_operator")
    for r in made.collect():
        got = [f"{t.type}:{t.text}" for t in r.tokens if t.type in kinds]
        assert got == NESTED[r.language][1], r.language
        assert r["shape"].count("COLLECTION") == sum(not x.startswith("unary") for x in got)
        assert [t.start for t in r.tokens] == sorted(t.start for t in r.tokens)


def test_lcs_and_penalties(spark, values):
    import random

    rng = random.Random(3)

    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
            row = new
        return row[-1]

    for _ in range(200):
        a = [rng.choice("ABCD") for _ in range(rng.randrange(90))]
        b = [rng.choice("ABCD") for _ in range(rng.randrange(90))]
        assert lcs_length(a, b) == slow(a, b)

    def seq(s):
        return F.lit(list(s)) if s else F.array().cast("array<string>")

    got = values(
        a=lcs_similarity(seq("ABCD"), seq("BCEF")), b=lcs_similarity(seq("ABCBDAB"), seq("BDCABA")), c=lcs_similarity(seq(""), seq("")),
        d=lcs_similarity(seq("A"), seq("")), e=lcs_similarity(F.array_repeat(F.lit("x"), 50_000), F.array_repeat(F.lit("x"), 50_000)),
        f=lcs_similarity(F.array_repeat(F.lit("x"), 50_000), F.concat(F.lit(["y"]), F.array_repeat(F.lit("x"), 49_999))),
    )
    assert got == {"a": 0.5, "b": 4 / 7, "c": 1.0, "d": 0.0, "e": 1.0, "f": 49_999 / 50_000}
    r = length_ratio(F.lit(2), F.lit(5))
    got = values(a=length_penalty(r), b=length_penalty(r, "function"), c=length_ratio(F.lit(0), F.lit(0)), d=combined_score(F.lit(0.5), F.lit(1.0), F.lit(0.2)))
    assert got == {"a": 0.9, "b": 0.8, "c": 0.0, "d": 0.56}


SHAPES = {
    "python": ('def load(\n    path,\n    kind=(1, 2),\n):\n    """First\nline at column 0 {\n    """\n    rows = 1\n    return rows\n\n\nx = 1\n', [("load", 0, 8)]),
    "c": ("/* int old(void)\n{ */\nint main(void)\n{\n    if (a)\n    {\n        b();\n    }\n    return 0;\n}\n", [("main", 2, 9)]),
    "csharp": ("class A\n{\n    public static int Add(int a,\n        int b)\n    {\n        return a + b; // }\n    }\n}\n", [("Add", 2, 6)]),
    "java": ("class A {\n  public int add(\n      int a, int b)\n      throws IOException {\n    return a;\n  }\n}\n", [("add", 1, 5)]),
    "javascript": ("const t = `\nfunction no() {\n`;\nfunction yes(a,\n  b) {\n  return '}';\n}\n", [("yes", 3, 6)]),
    "go": ("func área(\n\ta int,\n) int {\n\treturn a\n}\n", [("área", 0, 4)]),
    "rust": ("pub fn total(\n    a: u8,\n) -> u8\n{\n    a\n}\n", [("total", 0, 5)]),
    "php": ("<?php\nfunction go_on($a)\n{\n    return '{';\n}\n", [("go_on", 1, 4)]),
}

# Blocks that end by a word, with indentation that says nothing or the wrong thing.
WORDED = {
    "ruby": (
        """class A
def first(x)
if x then 1 else 2 end
  [1].each do |y|
puts "end" if y # end
      while y > 1 do
y -= 1
end
end
x.class.begin(if: 1)
    end
  def self.second = 5
def third
case x
when 1 then 2
end
begin
1
rescue
2
end unless x
z = if x
1
else
2
end
end
end
def last; 1; end
=begin
def no
=end
""",
        [("first", 1, 10), ("second", 11, 11), ("third", 12, 26), ("last", 28, 28)],
    ),
    "lua": (
        """local function outer(a)
  local function inner(b)
for i = 1, 3 do print(i) end
if a then
return b
elseif b then return 1 else
while true do break end
end
end
    repeat
a = a - 1
until a == 0 -- end
--[[ end
end ]]
return function() return "end" end
end
function M.sub.run() return 1 end
function t:last()
end
""",
        [("outer", 0, 15), ("inner", 1, 8), ("run", 16, 16), ("last", 17, 18)],
    ),
    "julia": (
        """module M
function outer(x)
y = x[end] + sum(z for z in x)
@inbounds for i in 1:3
if i > 1
println("end")
end
end
function inner(a) return a[begin:end] end
map(x) do v
begin
v
end
end
#= end
end =#
end
f(x) = 1
function last(x)
let a = 1
while a < 3; a += 1; end
end
  end
end
""",
        [("outer", 1, 16), ("inner", 8, 8), ("last", 18, 22)],
    ),
    "matlab": (
        """function r = outer(a)
if a(end) > 1, r = 1; end
for i = 1:3
switch i
case 1
r = b{end};
end
end
% end
end
function helper()
while true
break
end
end
""",
        [("outer", 0, 9), ("helper", 10, 14)],
    ),
    "fortran": (
        """module m
contains
subroutine first(a)
integer :: a
if (a > (1)) then
do i = 1, 3
if (a == i) a = 2
end do
else if (a < 0) then
a = 1
endif
select case (a)
case (1)
end select
end subroutine first
recursive integer function second(n) result(r)
type(t) :: x
where (n > 1)
n = 2
end where
end function
end module m
""",
        [("first", 2, 14), ("second", 15, 20)],
    ),
    "pascal": (
        """unit U;
interface
procedure Outer(a: integer);
type T = class
procedure M;
end;
implementation
procedure Outer(a: integer);
var r: record x: integer; end;
  function Inner(b: integer): integer;
function Deep: integer; begin Deep := 1; end;
begin
if b > 1 then begin
{ end }
Inner := 1 // end
end;
case b of 1: begin end; end;
end;
procedure Later; forward;
begin
try
a := Inner(1);
finally
write('end');
end;
end;
procedure T.M;
begin
end;
begin
Outer(1);
end.
""",
        [("Outer", 7, 25), ("Inner", 9, 17), ("Deep", 10, 10), ("M", 26, 28)],
    ),
    "ada": (
        """package body P is
procedure Spec (X : Integer);
function Sum (X : Integer) return Integer is
   procedure Inner is
begin
if X > 1 then
loop
exit when X > 3;
end loop;
elsif X = 0 then
null; -- end
end if;
end Inner;
Y : Integer;
begin
for I in 1 .. 3 loop
begin
Inner;
exception
when others => null;
end;
end loop;
return Y;
end Sum;
procedure Copy is new Generic_Copy (Integer);
function Other return Integer
is
begin
return 1;
end Other;
end P;
""",
        [("Sum", 2, 23), ("Inner", 3, 12), ("Other", 25, 29)],
    ),
    "bash": ("run() {\nif true; then\necho \"}\"\nfi\n  inner() { echo; }\nfor i in 1 2; do echo ${i}; done\n}\nfunction other()\n{\necho # }\n}\n", [("run", 0, 6), ("inner", 4, 4), ("other", 7, 10)]),
}
# Functions without an end of their own: they go on to the next one.
OPEN_ENDED = "function a(x)\nif x\ny = 1;\nend\n\nfunction b()\nfor i = 1:2\nend\n"


def spans(spark, sources):
    from twinscan.operators.functions import extract_functions

    rows = [(i, language, source) for i, (language, source) in enumerate(sources)]
    found = extract_functions(spark.createDataFrame(rows, "file_id long, language string, content string")).collect()
    return [sorted(((r.function_name, r.start_line, r.end_line) for r in found if r.file_id == i), key=lambda x: x[1]) for i, _, _ in rows], found


def test_blocks_that_end_by_a_word(spark):
    got, _ = spans(spark, [(language, source) for language, (source, _) in WORDED.items()] + [("matlab", OPEN_ENDED)])
    for (language, (_, expected)), found in zip(WORDED.items(), got):
        assert found == expected, language
    assert got[-1] == [("a", 0, 4), ("b", 5, 7)]


def test_functions_of_real_shapes(spark):
    got, found = spans(spark, [(language, source) for language, (source, _) in SHAPES.items()])
    for i, (language, (source, expected)) in enumerate(SHAPES.items()):
        assert got[i] == expected, language
        start, end = got[i][0][1:]
        assert [r.code_block for r in found if r.file_id == i] == ["\n".join(source.split("\n")[start : end + 1])]


def test_comments_of_several_lines_are_no_code(spark):
    from twinscan.operators.tokenize import tokenize_files

    rows = [("a.c", "/* one\n if two = three\n*/\nx = 1;"), ("a.py", 'def f():\n    """doc\n    if x = y\n    """\n    return 1'), ("b.c", 's = "/*"; y = 2; /* z */'), ("q.sql", "-- all = 1\nselect 2"), ("f.f90", "! if a\nuntil = 1"), ("m.m", "% x = 1\n2")]
    found = {r.path: [(t.type, t.start) for t in r.tokens] for r in tokenize_files(spark.createDataFrame(rows, "path string, content string")).collect()}
    assert found["a.c"] == [("comment", 0), ("identifier", 3), ("assignment", 3), ("integer", 3)]
    assert [k for k, _ in found["a.py"]] == ["function_definition", "call", "string", "return_statement", "integer"] and found["a.py"][-1][1] == 4
    assert [k for k, _ in found["b.c"]] == ["identifier", "assignment", "string", "identifier", "assignment", "integer", "comment"]
    assert [k for k, _ in found["q.sql"]] == ["comment", "identifier", "integer"] and [k for k, _ in found["m.m"]] == ["comment", "integer"]
    assert [k for k, _ in found["f.f90"]] == ["comment", "while_statement", "assignment", "integer"]
