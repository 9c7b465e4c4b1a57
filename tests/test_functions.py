import re

import pytest
from pyspark.sql import functions as F

from taproot.functions import globs, scalars


def values(spark, f, inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


def test_package_name(spark):
    cases = {
        "react": "react", "react/jsx-runtime": "react", "@scope/pkg/sub": "@scope/pkg", "npm:real@^2": "real", "npm:@s/real@^2": "@s/real",
        "./local": None, "/abs": None, "#internal": None, "node:fs": None, "fs": None, "fs/promises": None, "https://x.y/z": None, "@scope": None, "@/x": None, "a\\b": None, "": None, "x?raw": None, "npm:": None,
    }
    assert values(spark, scalars.package_name, cases) == list(cases.values())


def test_paths(spark):
    assert values(spark, scalars.normal_path, ["a/./b/../c", "../x", "a//b/", ""]) == ["a/b/c", "x", "a/b", ""]
    assert values(spark, scalars.popped_path, ["a/./b/../c", "../x", "a//b/", "", "a/../../../b"]) == ["a/c", "../x", "a/b", "", "../../b"]
    assert values(spark, scalars.binary_name, ["node_modules/.bin/tsc.cmd", "C:\\x\\eslint.exe", "jest"]) == ["tsc", "eslint", "jest"]
    assert values(spark, scalars.runtime_output, ["a.ts", "a.mts", "a.cts", "a.tsx", "a.js"]) == ["a.js", "a.mjs", "a.cjs", "a.js", "a.js"]
    assert values(spark, scalars.uri_path, ["a b/ü*~+.js"]) == ["a%20b/%C3%BC%2A~%2B.js"]
    assert values(spark, lambda c: scalars.wildcard_capture("./feat/*.js", c), ["./feat/a/b.js", "./other.js"]) == ["a/b", None]
    assert values(spark, scalars.test_path, ["src/a.test.ts", "tests/x.js", "src/test", "src/testing/a.ts", "a_test.js", "x/spec.tsx"]) == [True, True, True, False, True, True]


def test_line_and_column(spark):
    row = spark.range(1).select(scalars.line_and_column(F.lit("aé\nbc"), F.lit(5)).alias("x")).first().x
    assert (row.line, row.column) == (2, 2)


@pytest.mark.parametrize(
    "pattern,path,match",
    [("*.ts", "a/b.ts", True), ("/a/*.ts", "a/b.ts", True), ("/a/*.ts", "x/a/b.ts", False), ("dist/", "dist/x.js", True), ("dist/", "dist", False), ("a/**/b", "a/x/y/b", True), ("a/**", "a/x", True), ("f?o", "foo", True), ("[!a]b", "cb", True), ("[!a]b", "ab", False)],
)
def test_glob(pattern, path, match):
    assert bool(re.search(globs.glob_regex(pattern), path)) is match


def test_last_pattern_decides(spark):
    assert values(spark, lambda c: globs.ignored(c, ["*.js", "!keep.js", "# note"]), ["a.js", "keep.js", "b.ts"]) == [True, False, False]
