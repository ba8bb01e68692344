"""Native text expressions against plain Python on awkward strings."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from riskloom import fixed
from riskloom.functions import checks, lexing, text

PIECES = ["a", "Bc_9", "é", "ß", "日本", "_", "12", "3.5e-2", "0", " ", "  ", "\t", "\n", "\n\n",
          "\r\n", "\r", "#", "# c", "//", "/* x */", '"', "'", '"""', "'''", "\\", "\\\"", "(",
          ")", "=", "<STR>", "<", "\x00", "\x0b", "\x0c", "\x1c", "\x1f", "\x7f", "\x85", "\xa0",
          "\u2028", "\u2029", "\u3000", "def f():", "    return x", "\tpass", "٣"]


@pytest.fixture(scope="module")
def samples():
    rng = random.Random(7)
    out = ["", " ", "\n", "x", "a\n", "a\n\n", '"a\\"b"', "'''x\n'''", "1e5 x1 1.2.3", "a#b\n#c"]
    return out + ["".join(rng.choice(PIECES) for _ in range(rng.randint(1, 25)))
                  for _ in range(500)]


@pytest.fixture(scope="module")
def run(spark, samples):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, s string")

    def apply(expr):
        rows = df.select("i", expr.alias("o")).collect()
        return [o for _, o in sorted((r["i"], r["o"]) for r in rows)]
    return apply


def py_clean(s):
    return re.sub(r"[\x00-\x08\x0b-\x1f\x7f]", "", re.sub(r"\r\n?", "\n", s)).strip()


def py_no_comments(s):
    return "\n".join(filter(str.strip, re.sub(r"#[^\n]*", "", s).split("\n")))


def py_no_c_comments(s):
    return "\n".join(filter(str.strip, re.sub(r"//[^\n]*|/\*[\s\S]*?\*/", "", s).split("\n")))


# Literal patterns.
STRING = re.compile(r'("""[\s\S]*?"""|\'\'\'[\s\S]*?\'\'\'|"[^\n"\\]*(?:\\.[^\n"\\]*)*"'
                    r"|'[^\n'\\]*(?:\\.[^\n'\\]*)*')")


def py_mask(s):
    return re.sub(r"\b\d+(\.\d+)?([eE][+-]?\d+)?\b", "<NUM>", STRING.sub("<STR>", s))


def py_indent(s):
    def steps(line):
        blanks = itertools.takewhile(str.isspace, line)
        return sum({"\t": 4, " ": 1}.get(c, 0) for c in blanks) // 4
    return "\n".join("    " * steps(l) * bool(l.strip()) + l.lstrip() for l in s.splitlines())


def py_clean_code(s):
    return py_indent("\n".join(l for l in (x.split("#", 1)[0].rstrip() for x in s.splitlines())
                               if l))


def test_clean_text(run, samples):
    assert run(text.clean_text(F.col("s"))) == [py_clean(s) for s in samples]


def test_strip(run, samples):
    assert run(text.strip(F.col("s"))) == [s.strip() for s in samples]


def test_splitlines(run, samples):
    assert run(text.splitlines(F.col("s"))) == [s.splitlines() for s in samples]


def test_comments(run, samples):
    clean = text.clean_text(F.col("s"))
    assert run(text.strip_hash_comments(clean)) == [py_no_comments(py_clean(s)) for s in samples]
    assert run(text.strip_c_comments(clean)) == [py_no_c_comments(py_clean(s)) for s in samples]


def test_mask_literals(run, samples):
    assert run(text.mask_literals(text.clean_text(F.col("s")))) == [
        py_mask(py_clean(s)) for s in samples]


def test_mask_survives_many_escapes(spark):
    big = '"' + "\\n" * 20_000 + '" + 1'
    df = spark.createDataFrame([(big,)], "s string")
    assert df.select(text.mask_literals(F.col("s")).alias("o")).first()["o"] == "<STR> + <NUM>"


def test_corpus_tokens(run, samples):
    want = [re.findall(r"<[A-Z_]+>|\b\w+\b|[^\s\w]", py_clean(s)) for s in samples]
    assert run(text.corpus_tokens(text.clean_text(F.col("s")))) == want


def test_scan_and_display_tokens(run, samples):
    clean = text.clean_text(F.col("s"))
    assert run(text.scan_tokens(clean)) == [
        re.findall(r"[A-Za-z_][A-Za-z0-9_]*|\d+|[^\s\w]", py_clean(s)) for s in samples]
    assert run(text.display_tokens(clean)) == [
        re.findall(r"[A-Za-z_][A-Za-z0-9_]*", py_clean(s)) for s in samples]


def test_clean_code_and_indent(run, samples):
    assert run(text.normalise_indent(F.col("s"))) == [py_indent(s) for s in samples]
    assert run(text.clean_code(F.col("s"))) == [py_clean_code(s) for s in samples]


def test_contains_word(run, samples):
    for word in ("bc_9", "open(", "a", "shell=True", "x"):
        want = [re.search(rf"\b{re.escape(word.lower())}\b", s.lower()) is not None
                for s in samples]
        assert run(text.contains_word(F.lower("s"), word)) == want


def test_exact_lexing(spark):
    code = "def f(x):\n    return x + 1  # c\n"
    df = spark.createDataFrame([(code,), ("def (",), ("a `n b",)], "s string")
    model, shown = zip(*df.select(lexing.lex_model_tokens("s"), lexing.lex_shown_tokens("s"))
                       .collect())
    assert model[0] == ["def", "f", "(", "x", ")", ":", "<NL>", "<INDENT>", "return", "x", "+",
                        "<NUM>", "<NL>", "<DEDENT>"]
    assert shown[0] == ["def", "f", "x", "return", "x", "1"]
    assert model[1] == ["def", "("] and shown[2][0] == "a"


def test_paths(spark):
    paths = ["a/b.py", "venv/b.py", "A/Build/x.py", ".git/x.py", "src/.hidden.py", "__init__.py",
             "foo.egg-info/x.py", "build", "x.PY", ".py", "a.b.txt", "dir.py/", "..py"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    rows = df.select("p", text.path_kept(F.col("p"), fixed.IGNORED_DIRS).alias("kept"),
                     text.has_extension(F.col("p")).alias("ext"),
                     text.upload_path_kept(F.col("p"), fixed.UPLOAD_IGNORED_PARTS).alias("up"))
    got = {r["p"]: (r["kept"], r["ext"], r["up"]) for r in rows.collect()}
    assert [p for p in paths if not got[p][0]] == ["venv/b.py", "A/Build/x.py", ".git/x.py"]
    assert [p for p in paths if got[p][1]] == [
        "a/b.py", "venv/b.py", "A/Build/x.py", ".git/x.py", "src/.hidden.py", "__init__.py",
        "foo.egg-info/x.py", "x.PY"]
    assert not got["venv/b.py"][2] and got["x.PY"][2] and got["src/.hidden.py"][2]


def test_names_and_addresses(spark):
    df = spark.createDataFrame([("/proj/a.py", 3, "1.2.3.4, 5.6.7.8", "9.9.9.9"),
                                ("\\x\\y.py", 1, "", ""), ("/", 1, None, None)],
                               "p string, n int, f string, r string")
    got = df.select(text.display_name(F.col("p"), F.col("n")),
                    text.client_address(F.col("f"), F.col("r"))).collect()
    assert [tuple(r) for r in got] == [("proj", "1.2.3.4"), ("y.py", "127.0.0.1"),
                                       ("Upload Batch", "127.0.0.1")]


def test_password_rules(spark):
    df = spark.createDataFrame([("Weak1!",), ("ValidPass@2024",), ("alllowercase",),
                                ("NoDigits!!",), ("NoSpecial1",)], "v string")
    got = df.select(checks.first_failure(F.col("v")), checks.strength_label(
        checks.rules_met(F.col("v")))).collect()
    messages = [m for _, m in fixed.PASSWORD_RULES]
    assert [tuple(r) for r in got] == [
        (messages[0], "Strong"), (None, "Very Strong"), (messages[1], "Weak"),
        (messages[3], "Strong"), (messages[4], "Strong")]
