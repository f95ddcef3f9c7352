"""Sources outside Python that read cleanly, and those that do not, in each language."""

import random

import pytest

from plumbline.operators import detectors, lexical

CLEAN = {
    "go": ['package a\nfunc f() { s := "}" ; r := \'{\'; q := `raw " ( ` /* ] */ } // (', "var x = '\\''", 'var y = "\\""'],
    "rust": ['fn f<\'a>(x: &\'a str) -> char { let r = r#"a " ( "#; let m = "two\nlines ("; \'(\' }', "let c = '\\'';", "let u = '\\u{1F600}';"],
    "java": ['class A { String s = "\\"}"; char c = \'{\'; String t = """\n ( " [\n"""; } /* { */'],
    "cpp": ['#error don\'t (\nint f() { auto n = 1\'000\'000; auto r = R"x(a ) " { )x"; return \'"\'; }'],
    "javascript": ["const a = /[\"'(]/g, b = `x ${y(\"1\")} (`; f(a / b, 'c' /* ( */) // {", "x = {a: [1, (2)]}", "return /\\//.test(x)"],
    "typescript": ["type A = { b: Array<string[]>; c: () => void }"],
}
BROKEN = {
    "go": [("func f() {", "brackets"), ('s := "open', "string"), ("/* never", "string"), ("r := `never", "string")],
    "rust": [("fn f() { (] }", "brackets"), ('let s = "open', "string")],
    "java": [("class A { void f() { }", "brackets"), ("char c = 'x", "string"), ("/* /* */ */ )", "brackets")],
    "cpp": [("int f() { ) }", "brackets"), ('char* s = "x\n";', "string")],
    "javascript": [("f(`never", "string"), ("if (a { b ) }", "brackets"), ("}", "brackets"), ("}{", "brackets")],
    "typescript": [("let a: { b: [ }", "brackets")],
}


def files(spark, rows):
    return spark.createDataFrame(rows, "repo_id string, path string, language string, text string")


def reasons(df):
    return {(r.repo_id, r.path): r.reason for r in lexical.unclean(df).collect()}


def test_clean_and_broken_sources(spark):
    good = [("good", f"{k}/{i}", k, text) for k, texts in CLEAN.items() for i, text in enumerate(texts)]
    bad = [("bad", f"{k}/{i}", k, text) for k, texts in BROKEN.items() for i, (text, _) in enumerate(texts)]
    odd = [("odd", "null", "go", None), ("odd", "empty", "go", ""), ("odd", "other", "python", "(")]
    want = {("bad", f"{k}/{i}"): why for k, texts in BROKEN.items() for i, (_, why) in enumerate(texts)}
    got = reasons(files(spark, good + bad + odd))
    assert got.keys() == want.keys()
    assert all(want[k] in why for k, why in got.items())
    assert reasons(files(spark, [])) == {}


def test_brackets_against_a_stack(spark):
    """Random bracket texts, near-balanced and deeper than the rounds that are taken out in place."""
    rnd, pairs, texts = random.Random(3), {")": "(", "]": "[", "}": "{"}, []
    for i in range(300):
        stack, out = [], []
        for _ in range(rnd.randint(0, 90)):
            if stack and rnd.random() < (0.5 if i % 2 else 0.2):
                out.append({"(": ")", "[": "]", "{": "}"}[stack.pop()])
            else:
                stack.append(rnd.choice("([{"))
                out.append(stack[-1])
        out += [{"(": ")", "[": "]", "{": "}"}[b] for b in reversed(stack)]
        if i % 3 == 0 and out:
            out[rnd.randrange(len(out))] = rnd.choice("()[]{}")
        texts.append("".join(out))
    texts.append("(" * 3000 + ")" * 3000)

    def balanced(text):
        stack = []
        for b in text:
            if b in pairs:
                if not stack or stack.pop() != pairs[b]:
                    return False
            else:
                stack.append(b)
        return not stack

    got = reasons(files(spark, [("r", str(i), "java", text) for i, text in enumerate(texts)]))
    assert {k[1] for k in got} == {str(i) for i, text in enumerate(texts) if not balanced(text)}


@pytest.mark.parametrize("text", ['"' + "\\\\" * 40_000 + '"', "`" + "x\n" * 50_000 + "`", "/*" + "*" * 90_000 + "*/", "// " + "(" * 90_000])
def test_long_tokens(spark, text):
    assert reasons(files(spark, [("r", "a", "javascript", text), ("r", "b", "go", text.replace("\\\\", "ab"))])) == {}


def test_unparsed_sources_have_no_imports(spark):
    rows = [("r", "a.go", 'import "fmt"\nfunc f() {}'), ("r", "b.go", 'import "fmt"\nfunc f() {'), ("r", "c.py", "def ("), ("r", "d.py", "import os")]
    good, bad = detectors.extract_imports(spark.createDataFrame(rows, "repo_id string, path string, text string"))
    assert sorted((r.path, r.imports) for r in good.collect()) == [("a.go", ["fmt"]), ("d.py", ["os"])]
    assert sorted((r.path, r.reason) for r in bad.collect()) == [("b.go", "brackets do not close in order"), ("c.py", "not valid Python")]
