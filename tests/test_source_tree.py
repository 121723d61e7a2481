"""The lexer for languages with braces, and the scan that reads wanted files alone."""

import pytest

from defectloom.sources import source_tree as T

JS = [
    ('function f() { return "}}}"; } function g() { return 1 }', [("f", 1), ("g", 1)]),
    ("function f() { // if (a) { \n return 1 /* } if for while */ } function g() { if (x) { return 2 } }", [("f", 1), ("g", 2)]),
    ("function f() { return `a ${ x ? `}${'{'}` : '}' } } ` } function g() {}", [("f", 2), ("g", 1)]),
    ("function f() { return /[/}\"'`]{2}/.test(s) && a } function g() { return a / b / c }", [("f", 2), ("g", 1)]),
    ("function f() { const q = 4 / 2; const s = 'it\\'s } if'; return q / s } function g() {}", [("f", 1), ("g", 1)]),
    ("function f() { return 'open if (\n } function g() {}", [("f", 1), ("g", 1)]),
    ("function f() { x = \"\"\"\" } }\n } function g() {}", [("f", 1), ("g", 1)]),
    ("const f = (a, b) => { return a ?? '?' ; }", [("f", 3)]),
    ("function f() { return `never closed } ", [("f", 1)]),
    ("/* function no() { if */ function f(a) { for (;;) { } }", [("f", 2)]),
]
JAVA = [
    ('class A { String f() { return """\n } if "x" {\n"""; } int g(int a) { if (a > 0) { return \'}\' / a; } return a / 2; } }', [("f", 1), ("g", 2)]),
    ("class A { char f() { return '\\''; } // }}} while\n int g() { return 1; } }", [("f", 1), ("g", 1)]),
]


@pytest.mark.parametrize(("source", "expect", "language"), [(*x, k) for x, k in [*((x, "js") for x in JS), *((x, "ts") for x in JS[:6]), *((x, "java") for x in JAVA)]])
def test_braces_and_words_in_literals_and_comments(source, expect, language):
    code, both = T.lexed(source, language)
    assert len(code) == len(both) == len(source) and [c == "\n" for c in code] == [c == "\n" for c in source]
    got = T._brace_functions(code)
    assert [(f[0], f[1]) for f in got] == expect


def test_lines_of_code():
    js = '/* one\n two */\nlet a = 1; // three\n\n// four\nlet b = "// five";\nlet c = `\n six\n`;\n'
    assert T.measure("a.js", js)["loc"] == 5
    assert T.measure("A.java", "// x\nclass A {}\n/* */ int b;\n")["loc"] == 2
    assert T.measure("a.js", "")["loc"] == 0 and T.measure("a.py", "# x\ny = 1\n")["loc"] == 1


def test_a_long_text_takes_one_pass():
    import time

    began = time.perf_counter()
    T.lexed("if (a) { b(`x${'}'}`); } // }\n" * 40_000, "js")
    T.lexed("`${" * 20_000, "js")
    T.lexed("/" * 100_000 + "\n" + "'" * 100_000, "js")
    assert time.perf_counter() - began < 20


def test_only_wanted_files_are_read(spark, tmp_path):
    files = {"app/a.py": "x = 1\n", "app/b c+d%20.js": "let a = 1\n", "tests/t.py": "x", "node_modules/m/i.js": "x", "_p.py": "x", "n.md": "x", "build/b.js": "x"}
    for name, text in files.items():
        f = tmp_path / name
        f.parent.mkdir(exist_ok=True, parents=True)
        f.write_text(text)
    root = f"file://{tmp_path}"
    assert sorted(r["rel_path"] for r in T.scan_source_tree(spark, root).collect()) == ["app/a.py", "app/b c+d%20.js"]
    df = T.scan_static_metrics(spark, root)
    assert {r["path"]: r["loc"] for r in df.collect()} == {"app/a.py": 1, "app/b c+d%20.js": 1}
    plan, found = df._jdf.queryExecution().executedPlan(), []
    work = [plan]
    while work:
        p = work.pop()
        if "numFiles" in str(p.metrics().keys()):
            found.append(p.metrics().apply("numFiles").value())
        children = p.children()
        work += [children.apply(i) for i in range(children.size())]
        if p.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            work.append(p.executedPlan())
    assert found == [2]
