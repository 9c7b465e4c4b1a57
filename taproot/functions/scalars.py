"""Scalar functions of the analysis, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Modules that the Node.js runtime provides.
NODE_BUILTINS = (
    "assert", "async_hooks", "buffer", "child_process", "cluster", "console", "constants", "crypto", "dgram",
    "diagnostics_channel", "dns", "domain", "events", "fs", "http", "http2", "https", "inspector", "module", "net",
    "os", "path", "perf_hooks", "process", "punycode", "querystring", "readline", "repl", "stream", "string_decoder",
    "sys", "timers", "tls", "trace_events", "tty", "url", "util", "v8", "vm", "wasi", "worker_threads", "zlib",
)

#: Confidence from least to most certain.
CONFIDENCE = ("incomplete", "low", "medium", "high")

#: Issue types, the names that configurations use for them, and what they are about.
ISSUE_NAMES = {
    "unusedFile": "files",
    "unusedFiles": "files",
    "unusedExport": "exports",
    "unusedDeclaration": "declarations",
    "unusedMember": "members",
    "unusedDependency": "dependencies",
    "unlistedDependency": "dependencies",
    "unusedWorkspace": "workspaces",
}

SOURCE_EXTENSIONS = ("js", "jsx", "mjs", "cjs", "ts", "tsx", "mts", "cts")


def _plain_package(s: Column) -> Column:
    bad = (s == "") | s.rlike(r"^[./#]") | F.startswith(s, F.lit("node:")) | F.contains(s, F.lit("\\")) | F.contains(s, F.lit("://"))
    name = F.regexp_extract(s, r"(?s)^(@[^/@:?#]+/[^/@:?#]+|[^/@:?#]+)(?:/.*)?$", 1)
    return F.when(~bad & (name != "") & ~name.isin(*NODE_BUILTINS), name)


def package_name(specifier: Column) -> Column:
    """The npm package that a bare import, a package subpath or an ``npm:`` alias names; else null."""
    s = F.trim(specifier)
    alias = F.regexp_extract(F.regexp_replace(s, r"^(?:npm: *)+", ""), r"(?s)^(@[^/]*/[^@]*|[^@]*)", 1)
    return _plain_package(F.when(F.startswith(s, F.lit("npm:")), alias).otherwise(s))


def npm_alias_target(requirement: Column) -> Column:
    """The real package of an alias requirement such as ``npm:@scope/real@^2``; null for others."""
    return F.when(F.startswith(requirement, F.lit("npm:")), package_name(requirement))


def binary_name(command: Column) -> Column:
    """The last path segment without ``.cmd`` or ``.exe``."""
    return F.regexp_replace(F.regexp_extract(command, r"(?s)([^/\\]*)$", 1), r"\.(?:cmd|exe)$", "")


def normal_path(path: Column) -> Column:
    """A relative path of its plain segments only: empty, ``.`` and ``..`` ones are dropped."""
    return F.array_join(F.filter(F.split(path, "/", -1), lambda x: ~x.isin("", ".", "..")), "/")


def popped_path(path: Column) -> Column:
    """Where a path leads: each ``..`` takes what is before it; those that leave the root stay in front."""
    parts = F.filter(F.split(path, "/", -1), lambda x: ~x.isin("", "."))
    none = F.expr("cast(array() as array<string>)")
    up = lambda acc: (F.size(acc) > 0) & (F.coalesce(F.get(acc, F.size(acc) - 1), F.lit("..")) != "..")
    kept = F.aggregate(parts, none, lambda acc, x: F.when((x == "..") & up(acc), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))))
    return F.array_join(kept, "/")


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)


def source_kind(path: Column) -> Column:
    e = extension(path)
    return F.when(e.isin("ts", "mts", "cts"), "typescript").when(e == "tsx", "tsx").when(e == "jsx", "jsx").otherwise("javascript")


def module_kind(path: Column) -> Column:
    return F.when(extension(path).isin("cjs", "cts"), "common_js").otherwise("module")


def line_count(text: Column) -> Column:
    """Lines of a text: one more than its line feeds."""
    return F.when(text == "", 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)


def byte_length(text: Column) -> Column:
    return F.octet_length(text)


def token_occurrences(text: Column, token: str) -> Column:
    """How often an identifier stands in a text with no identifier character on either side."""
    return F.size(F.filter(F.split(text, r"[^A-Za-z0-9_$]+", -1), lambda x: x == token))


def source_variants(path: Column) -> Column:
    """The path itself, then with each source extension, then an index file in it."""
    own = F.array(path)
    with_extension = F.transform(F.array(*[F.lit(e) for e in SOURCE_EXTENSIONS]), lambda e: F.concat(path, F.lit("."), e))
    index = F.transform(F.array(*[F.lit(e) for e in SOURCE_EXTENSIONS]), lambda e: F.concat(path, F.lit("/index."), e))
    return F.concat(own, with_extension, index)


def emitted_variants(path: Column) -> Column:
    """Source paths that a compiler may have emitted this path from."""
    stem = F.regexp_replace(path, r"\.(?:js|jsx|mjs|cjs)$", "")
    e = extension(path)
    return F.when(e == "mjs", F.array(F.concat(stem, F.lit(".mts")))).when(e == "cjs", F.array(F.concat(stem, F.lit(".cts")))).when(e.isin("js", "jsx"), F.transform(F.array(F.lit("ts"), F.lit("tsx")), lambda x: F.concat(stem, F.lit("."), x))).otherwise(F.expr("cast(array() as array<string>)"))


def runtime_output(path: Column) -> Column:
    """The path that a source runs as."""
    e = extension(path)
    new = F.when(e == "mts", "mjs").when(e == "cts", "cjs").when(e.isin("ts", "tsx", "jsx"), "js").otherwise(e)
    return F.concat(F.regexp_replace(path, r"[A-Za-z0-9]+$", ""), new)


def wildcard_capture(pattern: str, value: Column) -> Column:
    """What the one ``*`` of a pattern stands for; null if the value doesn't match."""
    before, _, after = pattern.partition("*")
    ok = F.startswith(value, F.lit(before)) & F.endswith(value, F.lit(after)) & (F.length(value) >= len(before) + len(after))
    return F.when(ok, value.substr(F.lit(len(before) + 1), F.length(value) - len(before) - len(after)))


def escape_scope(prefix: Column) -> Column:
    """What a dynamic load with this static prefix may reach: a directory, or (null) anything."""
    directory = F.regexp_extract(prefix, r"^\./(.*/)?", 1)
    return F.when(prefix.rlike(r"^\./.*/"), directory)


def relative_specifier(specifier: Column) -> Column:
    return specifier.isin(".", "..") | specifier.rlike(r"^(?:\./|\.\./|/)")


def confidence_rank(confidence: Column) -> Column:
    out = F.lit(None).cast("int")
    for i, name in enumerate(CONFIDENCE):
        out = F.when(confidence == name, i).otherwise(out)
    return out


def issue_name(issue_type: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, name in ISSUE_NAMES.items():
        out = F.when(issue_type == kind, name).otherwise(out)
    return out


def test_path(path: Column) -> Column:
    """Whether a path is of tests or stories, by a directory or by its file name."""
    end = r"(?:\.(?:js|jsx|mjs|cjs|ts|tsx|mts|cts))?$"
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    return p.rlike(r"(?:^|/)(?:__tests__|__mocks__|test|tests|e2e)(?:/|$)") | p.rlike(r"(?:^|/)(?:test|spec)" + end) | p.rlike(r"(?:\.test|\.spec|\.e2e-spec|\.stories|_test)" + end)


def content_digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def uri_path(path: Column) -> Column:
    """RFC 3986 percent-encoding that keeps unreserved characters and slashes."""
    out = F.url_encode(path)  # form encoding: mend what differs
    for encoded, plain in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        out = F.replace(out, F.lit(encoded), F.lit(plain))
    return out


def sanitized(text: Column) -> Column:
    """Without control and text-direction characters, which could rewrite a terminal's lines."""
    return F.regexp_replace(text, "[\\u0000-\\u001f\\u007f-\\u009f\\u200e\\u200f\\u202a-\\u202e\\u2066-\\u2069]", "\ufffd")


def line_and_column(text: Column, offset: Column) -> Column:
    """(line, column) of a byte offset, both from 1; the column counts characters."""
    head = F.decode(F.substring(F.encode(text, "UTF-8"), F.lit(1), offset), "UTF-8")
    line = F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1
    return F.struct(line.cast("long").alias("line"), (F.length(F.regexp_extract(head, r"([^\n]*)\z", 1)) + 1).cast("long").alias("column"))
