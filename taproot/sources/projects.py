"""Project sources: files of a folder, exact universes, manifests, JSON with comments, shell scripts."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taproot.functions import globs, scalars
from taproot.operators import graph

#: Folders that a search for sources never enters, beside that of our own cache.
SKIPPED = ("node_modules", ".git", ".hg", ".svn", "target", "dist", "build", "coverage", ".next", ".nuxt", ".svelte-kit", ".turbo", ".cache", ".taproot")
MAX_FILES = 100_000


def source_files(spark: SparkSession, root: str, ignore: list[str] = (), limit: int = MAX_FILES) -> DataFrame:
    """(path, text) of the sources below ``root``; paths are relative, ignored ones are out.

    The filter on paths stands before any content is read.  More than ``limit``
    files are an error, never a cut.
    """
    base = root.rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(scalars.SOURCE_EXTENSIONS) + "}").load(root)
    path = F.regexp_replace("path", "^.*?" + re.escape(re.sub(r"^[a-z]+:/*", "", base)), "")
    out = files.withColumn("path", path).where(~F.col("path").rlike(r"(?:^|/)(?:" + "|".join(map(re.escape, SKIPPED)) + ")/"))
    if ignore:
        out = out.where(~globs.ignored(F.col("path"), list(ignore)))
    if out.select("path").limit(limit + 1).count() > limit:
        raise ValueError(f"more than {limit} source files")
    return out.select("path", F.decode("content", "UTF-8").alias("text"))


def universe(spark: SparkSession, manifest: str) -> tuple[DataFrame, DataFrame]:
    """(entries, files) of an exact-universe manifest: ``entry`` or ``entries``, and ``files``."""
    row = spark.read.schema("entry string, entries array<string>, files array<string>").json(manifest, multiLine=True)
    one = row.first()
    if (one.entry is None) == (not one.entries):
        raise ValueError("a manifest has either entry or entries")
    if missing := set(one.entries or [one.entry]) - set(one.files):
        raise ValueError(f"entries outside the universe: {sorted(missing)}")
    if len(set(one.files)) != len(one.files):
        raise ValueError("a file is listed twice")
    entries = row.select(F.explode(F.coalesce("entries", F.array("entry"))).alias("path"))
    return entries, row.select(F.explode("files").alias("path"))


def without_comments(text: str) -> str:
    """JSON from JSON with comments, trailing commas and a byte order mark."""
    text = text.removeprefix("\ufeff")
    plain = re.sub(r'("(?:[^"\\]|\\.)*")|//[^\n]*|/\*[\s\S]*?\*/', lambda m: m[1] or " ", text)
    return re.sub(r'("(?:[^"\\]|\\.)*")|,(?=\s*[}\]])', lambda m: m[1] or "", plain)


def conditional(value, conditions: set[str]) -> list[str]:
    """Targets of an ``exports`` value: the first key in its order that is active or ``default``."""
    if isinstance(value, str):
        return [value]
    if isinstance(value, list):
        return [t for v in value for t in conditional(v, conditions)]
    if isinstance(value, dict):
        return next((conditional(v, conditions) for k, v in value.items() if k in conditions or k == "default"), [])
    return []


def by_priority(value, priority: tuple[str, ...]) -> list[str]:
    """Targets of an entry: conditions in the profile's order of preference, then ``default``; of a list, all."""
    if isinstance(value, str):
        return [value]
    if isinstance(value, list):
        return list(dict.fromkeys(t for v in value for t in by_priority(v, priority)))
    if isinstance(value, dict):
        return next((by_priority(value[k], priority) for k in (*priority, "default") if k in value), [])
    return []


_SHELL = re.compile(r"""(?P<space>[ \t]+)|(?P<op>&&|\|\||[;|&\n])|(?P<comment>(?<![^\s;&|])\#[^\n]*)|(?P<single>'[^']*')|(?P<double>"(?:[^"\\]|\\.)*")|(?P<escape>\\.)|(?P<dynamic>\$\([^)]*\)|\$\{[^}]*\}|\$\w+|`[^`]*`)|(?P<plain>[^\s'"\\$`;&|]+|.)""", re.S)


def shell_words(script: str) -> list[list[tuple[str, bool]]]:
    """Commands of a script as (word, dynamic); quotes and escapes are resolved, expansions are dynamic."""
    commands, words, word, dynamic, open_word = [], [], "", False, False

    def close():
        nonlocal word, dynamic, open_word
        if open_word:
            words.append((word, dynamic))
        word, dynamic, open_word = "", False, False

    for m in _SHELL.finditer(script):
        kind, x = m.lastgroup, m[0]
        if kind == "space":
            close()
        elif kind == "op":
            close()
            if words:
                commands.append(words)
            words = []
        elif kind != "comment":
            open_word = True
            if kind == "single":
                word += x[1:-1]
            elif kind == "double":
                dynamic |= bool(re.search(r"(?<!\\)[$`]", x))
                word += re.sub(r'\\(["\\$`])', r"\1", x[1:-1])
            elif kind == "escape":
                word += x[1]
            else:
                dynamic |= kind == "dynamic"
                word += x
    close()
    return commands + [words] if words else commands


def script_references(script: str) -> list[tuple[str, str]]:
    """(kind, value) of what a package script runs: binaries, files, other scripts; ``unmodeled`` for the rest."""
    out = []
    for command in shell_words(script):
        words = list(command)
        while words and re.match(r"^[A-Za-z_]\w*=", words[0][0]) or words and words[0][0] in ("env", "cross-env"):
            words.pop(0)
        if not words:
            continue
        (name, dynamic), rest = words[0], [w for w, d in words[1:] if not d]
        plain = [w for w in rest if not w.startswith("-")]
        if dynamic:
            out.append(("unmodeled", name))
        elif name in ("node", "tsx", "ts-node") and plain:
            out.append(("file", re.sub(r"^(?:\./)+", "", plain[0])))
        elif name in ("npm", "pnpm", "yarn", "bun") and plain:
            run = plain[1:] if plain[0] in ("run", "run-script") else plain[:1] if name != "npm" or plain[0] in ("test", "start", "stop", "restart") else []
            out += [("script", w) for w in run[:1]]
        elif name in ("npx", "bunx") and plain:
            out.append(("binary", plain[0]))
        elif name in ("run-s", "run-p", "npm-run-all"):
            out += [("script", w) for w in plain]
        elif name in ("sh", "bash") and "-c" in rest and plain:
            out += script_references(plain[0])
        elif name not in ("cd", "echo", "rm", "cp", "mv", "mkdir", "true", "false", "exit", "test", "cat"):
            out.append(("binary", re.sub(r"\.(?:cmd|exe)$", "", re.split(r"[/\\]", name)[-1])))
    return out


def reachable_scripts(scripts: dict[str, str], roots: list[str] = ()) -> list[str]:
    """Scripts that the roots run, with their ``pre`` and ``post`` ones; without roots, all."""
    todo, seen = list(roots or scripts), set()
    while todo:
        name = todo.pop()
        if name in scripts and name not in seen:
            seen.add(name)
            todo += [f"pre{name}", f"post{name}"] + [v for k, v in script_references(scripts[name]) if k == "script"]
    return sorted(seen)


def script_table(scripts: DataFrame) -> DataFrame:
    """(root, name, kind, value): what each of ``scripts(root, name, body)`` runs."""

    def run(batches):
        for batch in batches:
            rows = [(r, n, *x) for r, n, b in zip(*(batch.column(c).to_pylist() for c in ("root", "name", "body")), strict=True) for x in script_references(b or "")]
            cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], ["root", "name", "kind", "value"])

    return scripts.select("root", "name", "body").mapInArrow(run, "root string, name string, kind string, value string").distinct()


def running_scripts(scripts: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, name): scripts that ``roots(root, name)`` run, with their pre and post ones; a workspace without roots runs all."""
    here = scripts.select("root", "name")
    calls = script_table(scripts).where("kind = 'script'").select("root", F.col("name").alias("src"), F.col("value").alias("dst"))
    around = here.select("root", F.col("name").alias("src"), F.explode(F.array(F.concat(F.lit("pre"), "name"), F.concat(F.lit("post"), "name"))).alias("dst"))
    edges = calls.union(around).join(here.withColumnRenamed("name", "dst"), ["root", "dst"], "left_semi").select(F.col("root").alias("profile"), "src", "dst")
    free = here.join(roots.select("root").distinct(), "root", "left_anti")
    start = roots.join(here, ["root", "name"], "left_semi").select("root", "name").union(free)
    return graph.reachable(edges, start.select(F.col("root").alias("profile"), F.col("name").alias("path"))).select(F.col("profile").alias("root"), F.col("path").alias("name"))
