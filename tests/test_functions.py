"""Column functions on single values."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from arrears.functions import paths, scoring, text


@pytest.fixture(scope="module")
def apply(spark):
    """Evaluate a function on every input in one job."""
    def run(function, inputs):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string")
        return [r["o"] for r in df.select("i", function(F.col("v")).alias("o")).orderBy("i").collect()]
    return run


def test_paths(apply):
    assert apply(paths.normalize_repo_path, ["./a/b.py", ".github/x", "a//b/./c", "a\\b"]) == [
        "a/b.py", "github/x", "a/b/c", "a/b"]
    assert apply(paths.module_of, ["a/b/c.py", "c.py"]) == ["a/b", "."]
    assert apply(paths.python_module, ["a/b.py", "a/__init__.py", "__init__.py", "a/x.y.py"]) == [
        "a.b", "a", "__init__", "a.x.y"]
    assert apply(paths.extension, ["a/b.TAR.Gz", "Makefile", "a.b/c"]) == ["gz", None, None]
    assert apply(paths.stem, ["a/b.test.ts", ".env", "x"]) == ["b.test", ".env", "x"]


def test_skip_rules(apply):
    names = ["venv/a.py", "a/venv", "src/environment/x.py", "env.py", "a/build/b.py"]
    assert apply(paths.under_skip_dir, names) == [True, False, False, False, True]
    assert apply(paths.has_skip_part, names) == [True, True, False, False, True]
    assert apply(paths.mentions_skip_name, names) == [True, True, True, True, True]
    assert apply(paths.is_skipped_file, ["a/x.min.js", "my-yarn.lock.bak", "a_pb2.py", "b.py"]) == [
        True, True, True, False]
    assert apply(paths.is_test_path, ["tests/a.py", "a/Test_x.py", "a/b.spec.ts", "src/latest.py"]) == [
        True, True, True, False]
    assert apply(paths.is_source_path, ["a.py", "a.PY", "test_a.py", "a.rb"]) == [True, True, False, False]


def test_urls(apply):
    urls = ["https://github.com/o/r/", "http://github.com/o/r", "github.com/o/r", " o/r ",
            "https://gitlab.com/o/r", "name"]
    assert apply(paths.normalize_url, urls) == ["https://github.com/o/r"] * 4 + [
        "https://gitlab.com/o/r", "https://github.com/name"]
    assert apply(paths.repo_key, urls) == ["o/r"] * 4 + ["https:/", "name"]
    assert apply(paths.url_owner, urls)[0] == "o" and apply(paths.url_name, urls)[0] == "r"
    assert apply(paths.clean_path, ["/tmp/repos/job/a.py:12", "a.py:?", "a.py"]) == ["a.py"] * 3


def test_figures(apply):
    assert apply(text.hourly_figures, ["$50 per hour or $104k per year", "$208,000 annual", "$5/hr"]) == [
        [50.0, 50.0], [100.0], []]
    assert apply(text.million_figures, ["$4.88 million, 25m"]) == [[4_880_000.0]]
    assert apply(text.dollar_figures, ["$1,083.50 and $20 and $ 500"]) == [[1083.5]]
    assert apply(lambda c: text.percent_figures(c, 1, 50), ["0.5% 12 % 60%"]) == [[12.0]]
    assert apply(text.identifier_tokens, ["x = été + 1abc _y2 data"]) == [["x", "_y2", "data"]]


def test_version_specs(apply):
    assert apply(text.pip_issue, ["", "==1.*", ">=1", ">=1,==2", "==1", "latest"]) == [
        "unbounded_version", "wildcard_version", "range_pinned_version", None, None, "wildcard_version"]
    assert apply(text.npm_issue, ["^1", "*", "latest", ">=1", "1.0", "~2"]) == [
        "range_pinned_version", "wildcard_version", "wildcard_version", "range_pinned_version", None,
        "range_pinned_version"]


def test_texts(apply):
    assert apply(lambda c: text.money_text(c.cast("double")), ["1234567.5", "12"]) == ["$1,234,568", "$12"]
    assert apply(lambda c: text.percent_text(c.cast("double")), ["0.675"]) == ["68%"]
    assert apply(scoring.effort_minutes, ["10min", "2h", "soon", None]) == [10, 120, 30, 30]


def test_money_models(spark):
    one = spark.range(1)
    roi = one.select(*[c.alias(n) for n, c in scoring.roi_columns(F.lit(1000.0)).items()]).first()
    assert (roi["payback_months"], roi["three_year_roi_pct"]) == (30, 20)
    zero = one.select(*[c.alias(n) for n, c in scoring.roi_columns(F.lit(0.0)).items()]).first()
    assert (zero["payback_months"], zero["three_year_roi_pct"]) == (99, 0)
    cost = one.select(scoring.security_cost_columns(
        F.lit("CWE-89"), F.lit(9.5), F.lit(2.0), F.lit(100.0), F.lit(4_880_000.0), F.lit(0.046))
        ["total_security_cost"].alias("c")).first()["c"]
    assert cost == Decimal("1883.60")  # 200 + 0.046 * 0.5 * 4.88e6 * 1.5 * 0.01


def test_source_is_walked_once_per_rule_not_per_leaf():
    """Names' contexts, operators and constants are not visited; what the rules see stays the same."""
    import ast

    from arrears.operators import facts

    source = "class A:\n    def f(self, x=[]):\n        for _i in x:\n            (x + x).append(_b)\n            x += 1\n        return x\n        x = 'y'\n"
    tree = ast.parse(source)
    visited = [type(node) for node in facts._walk(tree)]
    assert len(visited) < len(list(ast.walk(tree))) * 0.7
    assert not {ast.Load, ast.Store, ast.Add} & set(visited)
    found = [(f["kind"], f.get("name"), f.get("line")) for f in facts._all_facts(source)]
    assert found == [
        ("words", None, None), ("class", "A", 1), ("function", "f", 2), ("after_jump", None, 7),
        ("in_loop", "accumulation_in_loop", 5), ("in_loop", "append_on_expression_in_loop", 4), ("name_load", "_b", None), ("file", None, None)]


def test_fingerprints_are_those_of_every_field():
    """Names and constants take a short way; the digest is the one of a plain walk over all fields."""
    import ast
    import hashlib

    from arrears.operators import facts

    def shape(item):
        if isinstance(item, ast.AST):
            return f"({type(item).__name__}" + "".join(shape(getattr(item, n, None)) for n in item._fields) + ")"
        if isinstance(item, list):
            return "[" + "".join(map(shape, item)) + ")"
        return f"{type(item).__name__} {item:x};" if type(item) is int else f"{type(item).__name__} {item!r};"

    for source in ("x = a + 12", "return f(*b, k=u'ü') if not c[1:2] else {**d, 'e': 1.5, 'g': None, 'h': True}", "pass",
                   "global g; del x; y: int = ...; match z:\n  case {'a': 1, **r}: ...", "async with a as b: yield\n\nlambda q, /, *r: (s := 2j)"):
        body = ast.parse(source.replace("; match", "\nmatch")).body
        assert facts._fingerprint(body) == hashlib.sha256(shape(body).encode()).hexdigest()
