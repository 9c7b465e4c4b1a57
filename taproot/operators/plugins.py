"""Plugins as rule tables: detection, entries, edges between files, transforms, references in configurations.

A plugin only adds facts; rules are joined to files, none is executed.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taproot.functions import globs, scalars

#: The built-in plugins. Configuration files are stems with the endings that they may have.
BUILTIN = {
    "astro": {"label": "Astro", "packages": ["astro"], "configs": {"astro.config": "cjs cts js mjs mts ts"}, "entries": ["src/middleware.*", "src/pages/**/*.*"], "files": ["src/content.config.*", "src/content/**/*.*"], "conditions": ["browser", "node"], "gap": "plugin_astro_embedded_code"},
    "babel": {"label": "Babel", "packages": ["@babel/core"], "configs": {".babelrc": "- cjs js json", "babel.config": "cjs cts js mjs mts ts"}, "gap": "plugin_babel_dynamic_config"},
    "eslint": {"label": "ESLint", "packages": ["eslint"], "configs": {".eslintrc": "- cjs js json yaml yml", "eslint.config": "cjs cts js mjs mts ts"}, "conditions": ["node"], "gap": "plugin_eslint_dynamic_config"},
    "jest": {"label": "Jest", "packages": ["@jest/core", "jest"], "configs": {"jest.config": "cjs cts js json mjs mts ts"}, "entries": ["**/*.spec.*", "**/*.test.*", "**/__tests__/**/*.*", "test/**/*.*", "tests/**/*.*"], "conditions": ["node", "test"], "gap": "plugin_jest_dynamic_config"},
    "nest": {"label": "NestJS", "packages": ["@nestjs/common", "@nestjs/core"], "prefixes": ["@nestjs/"], "configs": {"nest-cli": "json"}, "entries": ["apps/*/src/main.*", "src/main.*"], "conditions": ["node"], "gap": "plugin_nest_dynamic_config"},
    "next": {
        "label": "Next.js", "packages": ["next"], "configs": {"next.config": "cjs js mjs ts"},
        "entries": ["app/**/default.*", "app/**/error.*", "app/**/global-error.*", "app/**/layout.*", "app/**/loading.*", "app/**/not-found.*", "app/**/page.*", "app/**/route.*", "app/**/template.*", "instrumentation.*", "middleware.*", "pages/**/*.*"],
        "files": ["next-env.d.ts"], "conditions": ["browser", "node", "react-server"], "gap": "plugin_next_dynamic_config",
    },
    "nuxt": {
        "label": "Nuxt", "packages": ["nuxt"], "configs": {"nuxt.config": "js mjs ts"},
        "entries": ["app.vue", "error.vue", "layouts/**/*.vue", "middleware/**/*.*", "modules/**/*.*", "pages/**/*.vue", "plugins/**/*.*", "server/api/**/*.*", "server/middleware/**/*.*", "server/plugins/**/*.*", "server/routes/**/*.*"],
        "files": ["app.config.*"], "conditions": ["browser", "node"], "gap": "plugin_nuxt_embedded_code",
    },
    "postcss": {"label": "PostCSS", "packages": ["postcss"], "configs": {".postcssrc": "- cjs js json yaml yml", "postcss.config": "cjs cts js mjs mts ts"}, "gap": "plugin_postcss_dynamic_config"},
    "storybook": {"label": "Storybook", "packages": ["storybook"], "prefixes": ["@storybook/"], "configs": {".storybook/main": "cjs js mjs ts"}, "entries": [".storybook/manager.*", ".storybook/preview.*", ".storybook/test-runner.*", "**/*.stories.*"], "files": ["**/*.mdx"], "conditions": ["browser", "development"], "gap": "plugin_storybook_dynamic_stories"},
    "sveltekit": {
        "label": "SvelteKit", "packages": ["@sveltejs/kit"], "configs": {"svelte.config": "cjs js mjs"},
        "entries": ["src/hooks.*", "src/params/**/*.*", "src/routes/**/+error.*", "src/routes/**/+layout.*", "src/routes/**/+page.*", "src/routes/**/+server.*", "src/service-worker.*"],
        "files": ["src/app.d.ts", "src/app.html"], "conditions": ["browser", "node"], "gap": "plugin_sveltekit_embedded_code",
    },
    "typescript-config": {"label": "TypeScript project configuration", "packages": ["typescript"], "configs": {"jsconfig.*": "json", "jsconfig": "json", "tsconfig.*": "json", "tsconfig": "json"}, "gap": "plugin_typescript_dynamic_extends"},
    "vite": {"label": "Vite", "packages": ["vite"], "configs": {"vite.config": "cjs cts js mjs mts ts"}, "files": ["index.html"], "conditions": ["browser", "development", "module"], "gap": "plugin_vite_html_entries"},
    "vitest": {"label": "Vitest", "packages": ["vitest"], "configs": {"vitest.config": "cjs cts js mjs mts ts"}, "entries": ["**/*.spec.*", "**/*.test.*"], "conditions": ["node", "test"], "gap": "plugin_vitest_dynamic_config"},
}

CAPABILITIES = ("entries", "project_files", "config_files", "file_edges", "dynamic_imports", "file_transforms", "references", "target_conditions", "diagnostics", "retains", "excludes", "open_world", "scripts")
MOST_EDGES = 256
RULES = "plugin string, label string, rule string, value string, other string, reason string"


def rows_of(name: str, spec: dict) -> list[tuple]:
    """A plugin's contract as rows (plugin, label, rule, value, other, reason)."""
    label = spec["label"]
    why = f"{label} static convention"
    configs = [stem if e == "-" else f"{stem}.{e}" for stem, endings in spec.get("configs", {}).items() for e in endings.split()]
    rows = [("package", p) for p in spec.get("packages", [])] + [("prefix", p) for p in spec.get("prefixes", [])] + [("config", c) for c in sorted(configs)]
    rows += [("entry", p) for p in spec.get("entries", [])] + [("project_file", p) for p in spec.get("files", [])] + [("condition", c) for c in spec.get("conditions", [])]
    rows += [("gap", spec["gap"])] if "gap" in spec else []
    return [(name, label, rule, value, None, why) for rule, value in rows] + [(name, label, r["rule"], r["value"], r.get("other"), r.get("reason", why)) for r in spec.get("rules", [])]


def builtin_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([r for n, spec in BUILTIN.items() for r in rows_of(n, spec)], RULES)


def validated(spec: dict) -> list[tuple]:
    """Rows of a declarative plugin read from JSON; one that breaks the contract is an error.

    Its id is lower case with dashes, its version has three numbers, patterns are
    relative and stay in the package, and each rule's kind is a known capability.
    """
    if not re.fullmatch(r"[a-z0-9]+(?:-[a-z0-9]+)*", spec.get("id", "")):
        raise ValueError("a plugin's id is lower case with dashes")
    if not re.fullmatch(r"\d+\.\d+\.\d+(?:[-+][0-9A-Za-z.-]+)?", spec.get("version", "")):
        raise ValueError("a plugin's version has three numbers")
    if unknown := set(spec.get("capabilities", [])) - set(CAPABILITIES):
        raise ValueError(f"unknown capabilities {sorted(unknown)}")
    rows = rows_of(spec["id"], {"label": spec.get("displayName", spec["id"]), **{k: spec[k] for k in ("packages", "prefixes", "configs", "entries", "files", "conditions", "gap", "rules") if k in spec}})
    for _, _, rule, value, other, _ in rows:
        if not safe_pattern(value) or (other is not None and not safe_pattern(other)):
            raise ValueError(f"unsafe {rule} pattern {value!r}")
    return sorted(set(rows), key=str)


def declared_rules(spark: SparkSession, texts: list[str]) -> DataFrame:
    """Rules of declarative plugins, given as the JSON texts of their contracts."""
    return spark.createDataFrame([r for t in texts for r in validated(json.loads(t))], RULES)


def safe_pattern(pattern: str) -> bool:
    """Whether a pattern is relative, stays in the package and has no empty part, control character or exclusion."""
    return bool(pattern) and not re.search(r"^[/!]|\\|(?:^|/)\.\.(?:/|$)|//|[\x00-\x1f\x7f]", pattern)


def wildcard(pattern: Column) -> Column:
    """A regular expression for ``*`` and ``?`` over a whole name, as a column."""
    quoted = F.regexp_replace(pattern, r"([.^$+()\[\]{}|\\])", r"\\$1")
    return F.concat(F.lit("(?s)^"), F.replace(F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))


def detected(packages: DataFrame, configs: DataFrame, rules: DataFrame) -> DataFrame:
    """(workspace, plugin, kind, value): the evidence for each plugin.

    ``packages(workspace, package)`` are declared ones, ``configs(workspace,
    path)`` configuration files.  Names meet rules by hash; scoped prefixes by the
    scope; configuration files by their literal name, or the few with wildcards.
    """
    names = rules.where("rule = 'package'").select("plugin", F.col("value").alias("package"))
    prefixes = rules.where("rule = 'prefix'").select("plugin", F.col("value").alias("scope"))
    by_name = packages.join(F.broadcast(names), "package").select("workspace", "plugin", F.lit("package").alias("kind"), F.col("package").alias("value"))
    by_scope = packages.withColumn("scope", F.regexp_extract("package", "^([^/]*/)", 1)).join(F.broadcast(prefixes), "scope").select("workspace", "plugin", F.lit("package"), "package")
    files = rules.where("rule = 'config'").select("plugin", F.col("value").alias("pattern"))
    literal = configs.join(F.broadcast(files.where(~F.col("pattern").rlike("[*?]"))), F.col("path") == F.col("pattern")).select("workspace", "plugin", F.lit("config_file"), "path")
    # A handful of rules with wildcards, and only configuration files: each pair is looked at.
    loose = configs.join(F.broadcast(files.where(F.col("pattern").rlike("[*?]")).withColumn("regex", wildcard(F.col("pattern")))), F.expr("path rlike regex")).select("workspace", "plugin", F.lit("config_file"), "path")
    return by_name.union(by_scope).union(literal).union(loose).distinct()


def _regexes(rules: DataFrame, kinds: list[str]) -> list[dict]:
    """Pattern rules of the given kinds; they come from configuration, so they are few."""
    rows = rules.where(F.col("rule").isin(*kinds)).distinct().collect()
    return [{"plugin": r.plugin, "label": r.label, "rule": r.rule, "value": r.value, "other": r.other, "reason": r.reason} for r in sorted(rows, key=str)]


def matches(files: DataFrame, rules: DataFrame, kinds: list[str], column: str = "value") -> DataFrame:
    """(workspace, path, relative, plugin, rule, value): which pattern rules each file fits, in one pass over the files.

    ``files(workspace, path, relative)``, relative to the workspace.
    """
    every = [r for r in _regexes(rules, kinds) if r[column]]
    if not every:
        return files.select("workspace", "path", "relative", *[F.lit(None).cast("string").alias(c) for c in ("plugin", "rule", "value")]).limit(0)
    hits = F.filter(F.array(*[F.when(F.col("relative").rlike(globs.glob_regex("/" + r[column])), F.struct(*[F.lit(r[c]).alias(c) for c in ("plugin", "rule", "value")])) for r in every]), lambda x: x.isNotNull())
    return files.select("workspace", "path", "relative", F.explode(hits).alias("m")).select("workspace", "path", "relative", "m.*")


def entries(files: DataFrame, found: DataFrame, rules: DataFrame) -> DataFrame:
    """(workspace, path, plugin): files that a detected plugin's entry patterns name."""
    have = found.select("workspace", "plugin").distinct()
    return matches(files, rules, ["entry"]).join(have, ["workspace", "plugin"]).select("workspace", "path", "plugin").distinct()


def edges(files: DataFrame, found: DataFrame, rules: DataFrame, most: int = MOST_EDGES) -> tuple[DataFrame, DataFrame]:
    """((src, dst, reason), diagnostics): edges between files of a workspace that fit the two patterns of a rule.

    More than ``most`` in all are none, and a blocking diagnostic.  The number is
    computed from counts, so what is over is never made.
    """
    have = found.select("workspace", "plugin").distinct()
    kinds = ["file_edge", "dynamic_import"]
    named = rules.where(F.col("rule").isin(*kinds)).select("plugin", "label", "rule", "value", "other", "reason")
    left = matches(files, rules, kinds).join(have, ["workspace", "plugin"]).select("workspace", "plugin", "rule", "value", F.col("path").alias("src"))
    right = matches(files, rules, kinds, "other").join(have, ["workspace", "plugin"]).select("workspace", "plugin", "rule", "value", F.col("path").alias("dst"))
    key = ["workspace", "plugin", "rule", "value"]
    total = left.groupBy(*key).count().join(right.groupBy(*key).agg(F.count("*").alias("m")), key).agg(F.sum(F.col("count") * F.col("m"))).first()[0] or 0
    blank = files.sparkSession.createDataFrame([], "path string, code string, message string, blocks boolean")
    if total > most:
        over = files.sparkSession.createDataFrame([(".", "plugin_pattern_limit_exceeded", f"Plugin edge expansion produced {total} edges, exceeding the configured limit of {most}", True)], blank.schema)
        return files.select(F.col("path").alias("src"), F.col("path").alias("dst"), F.lit("").alias("reason")).limit(0), over
    said = F.concat("label", F.when(F.col("rule") == "dynamic_import", " dynamic import: ").otherwise(": "), "reason")
    both = left.join(right, key).join(F.broadcast(named.withColumn("said", said).select("plugin", "rule", "value", "said")), ["plugin", "rule", "value"])
    return both.select("src", "dst", F.col("said").alias("reason")).distinct(), blank


def transforms(files: DataFrame, found: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((src, dst, reason), diagnostics): sources tied to the outputs beside them.

    A transform rule's value is the source pattern, ``other`` its output endings,
    comma-separated.  A source without any output blocks.
    """
    have = found.select("workspace", "plugin").distinct()
    named = rules.where("rule = 'file_transform'").select("plugin", "label", "value", "other", "reason")
    rows = matches(files, rules, ["file_transform"]).join(have, ["workspace", "plugin"]).join(F.broadcast(named), ["plugin", "value"])
    outs = rows.withColumn("dst", F.explode(F.transform(F.split("other", ","), lambda e: F.concat(F.regexp_replace(F.col("path"), r"\.[^./]*$", ""), F.lit("."), F.regexp_replace(e, r"^\.", "")))))
    there = outs.join(files.select(F.col("path").alias("dst")), "dst", "left_semi")
    made = there.where("path <> dst").select(F.col("path").alias("src"), "dst", F.concat("label", F.lit(" file transform: "), "reason").alias("reason")).distinct()
    lost = rows.join(there.select("plugin", "value", "path").distinct(), ["plugin", "value", "path"], "left_anti")
    return made, lost.select("path", F.lit("plugin_transform_output_missing").alias("code"), F.concat("label", F.lit(" file transform could not materialize a declared output for `"), "path", F.lit("`")).alias("message"), F.lit(True).alias("blocks")).distinct()


def config_references(configs: DataFrame, properties: list[str]) -> DataFrame:
    """(path, property, package): packages that JSON configurations name under the given properties, at any depth.

    Below such a property every string counts, and so do the keys of an object; a
    text that isn't JSON gives nothing.  ``configs(path, text)``.
    """
    wanted = set(properties)

    def walk(value, under: str | None):
        if isinstance(value, dict):
            for k, v in value.items():
                if under:
                    yield under, k
                yield from walk(v, k if k in wanted else under)
        elif isinstance(value, list):
            for v in value:
                yield from walk(v, under)
        elif isinstance(value, str) and under:
            yield under, value

    def run(batches):
        for batch in batches:
            out = []
            for p, t in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True):
                try:
                    out += [(p, *x) for x in walk(json.loads(t or ""), None)]
                except ValueError:
                    continue
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], ["path", "property", "value"])

    found = configs.select("path", "text").mapInArrow(run, "path string, property string, value string")
    return found.select("path", "property", scalars.package_name(F.col("value")).alias("package")).where("package is not null").distinct()


def conventional(profile: Column, path: Column) -> Column:
    """Whether a file, by its path in the package, is an entry of a profile by custom alone."""
    name = F.regexp_extract(path, "([^/]*)$", 1)

    def holds(starts: list[str], inside: list[str], names: list[str]) -> Column:
        tests = [F.startswith(path, F.lit(x)) for x in starts] + [F.contains(path, F.lit(x)) for x in inside] + [F.contains(name, F.lit(x)) for x in names]
        out = tests[0]
        for t in tests[1:]:
            out = out | t
        return out

    test = holds(["test/", "tests/"], ["/__tests__/"], [".test.", ".spec."])
    bench = holds(["benchmark/", "benchmarks/"], [], [".bench.", ".benchmark."])
    story = holds(["stories/", ".storybook/"], ["/.storybook/"], [".stories.", ".story."])
    example = holds(["example/", "examples/"], ["/examples/"], [])
    return F.when(profile == "test", test | bench).when(profile.isin("browser", "bundler"), story | example).when(profile.isin("node", "development"), example).otherwise(F.lit(False))
