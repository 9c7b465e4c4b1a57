"""Module facts of JavaScript and TypeScript sources.

A lexer that knows strings, templates, comments and regular expressions, and a
reader of module syntax over its tokens.  What can't be read statically gives a
blocking diagnostic: missing coverage is never evidence that something is unused.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*[\s\S]*?\*/)|(?P<str>"(?:[^"\\\n]|\\[\s\S])*"|'(?:[^'\\\n]|\\[\s\S])*')
    |(?P<id>\#?[A-Za-z_$\u0080-\uffff][\w$]*)|(?P<num>\d[\w.]*)|(?P<pun>=>|\.\.\.|\?\.|[{}()\[\];,<>+\-*/%&|^!~?:=.@\\])|(?P<tick>`)|(?P<bad>[\s\S])""",
    re.X,
)
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_BEFORE_REGEX = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "do", "else", "await", "yield"}
_CONTROL = {"if", "for", "while", "switch", "with"}
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0", "\n": ""}
_DECLARED = {"function": "function", "class": "class", "const": "variable", "let": "variable", "var": "variable", "enum": "enum", "interface": "interface", "type": "type_alias", "namespace": "namespace"}


@dataclass
class Token:
    kind: str
    text: str
    start: int
    end: int


@dataclass
class Facts:
    imports: list = field(default_factory=list)
    exports: list = field(default_factory=list)
    bindings: list = field(default_factory=list)
    diagnostics: list = field(default_factory=list)
    symbols: list = field(default_factory=list)
    refs: list = field(default_factory=list)
    guards: list = field(default_factory=list)


def unquoted(s: str) -> str:
    def one(m):
        c = m[1]
        if c[0] in "xu" and len(c) > 1:
            return chr(int(c[1:].strip("{}"), 16))
        return _ESCAPES.get(c, c)

    return re.sub(r"\\(x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|u\{[0-9a-fA-F]+\}|[\s\S])", one, s)


def tokens(text: str) -> Iterator[Token]:
    """Tokens without space and comments; a template is one ``tpl`` token, its substitutions' tokens follow it."""
    i, last, n = 0, None, len(text)
    while i < n:
        m = _TOKEN.match(text, i)
        kind = m.lastgroup
        if kind == "skip":
            i = m.end()
            continue
        if kind == "bad":
            raise SyntaxError(f"unexpected character at {i}")
        if kind == "tick":
            j, parts, plain = i + 1, [], True
            while j < n and text[j] != "`":
                if text[j] == "\\":
                    j += 2
                elif text.startswith("${", j):
                    plain, depth, k = False, 1, j + 2
                    while k < n and depth:
                        if text[k] in "\"'`":  # skip a nested literal
                            q, k = text[k], k + 1
                            while k < n and text[k] != q:
                                k += 2 if text[k] == "\\" else 1
                        depth += {"{": 1, "}": -1}.get(text[k] if k < n else "", 0)
                        k += 1
                    parts.append((j + 2, k - 1))
                    j = k
                else:
                    j += 1
            if j >= n:
                raise SyntaxError("unterminated template")
            last = Token("tpl" if plain else "mixed", text[i + 1 : j], i, j + 1)
            yield last
            for a, b in parts:
                for t in tokens(text[a:b]):
                    yield Token("in_" + t.kind if t.kind == "mixed" else t.kind, t.text, t.start + a, t.end + a)
            i = j + 1
            continue
        if kind == "pun" and m[0] == "/" and (last is None or (last.kind == "pun" and last.text not in (")", "]", "}")) or last.text in _BEFORE_REGEX):
            if r := _REGEX.match(text, i):
                last = Token("regex", r[0], i, r.end())
                yield last
                i = r.end()
                continue
        last = Token(kind, m[0], i, m.end())
        yield last
        i = m.end()


class Reader:
    def __init__(self, text: str):
        self.text, self.t, self.out = text, list(tokens(text)), Facts()
        self.constants: dict[str, str] = {}

    def at(self, i: int) -> str:
        return self.t[i].text if 0 <= i < len(self.t) else ""

    def kind(self, i: int) -> str:
        return self.t[i].kind if 0 <= i < len(self.t) else ""

    def span(self, a: int, b: int) -> tuple[int, int]:
        start, end = self.t[a].start, self.t[min(b, len(self.t) - 1)].end
        return (start, end) if self.text.isascii() else (len(self.text[:start].encode()), len(self.text[:end].encode()))

    def constant(self, i: int, depth: int = 0) -> tuple[str | None, int]:
        """The value of a constant string expression at ``i`` and the first token after it."""
        value, j = "", i
        while depth < 32:
            k = self.kind(j)
            if k in ("str", "tpl"):
                value += unquoted(self.at(j)[1:-1] if k == "str" else self.at(j))
            elif k == "id" and self.at(j) in self.constants:
                value += self.constants[self.at(j)]
            else:
                return None, j
            if self.at(j + 1) != "+":
                return (value if len(value) <= 16384 else None), j + 1
            j += 2
        return None, j

    def load(self, i: int, first: int, kind: str, deferred: bool, code: str, ends: tuple[str, ...] = (")",)) -> None:
        value, j = self.constant(first)
        span = self.span(i, j)
        if value is None or self.at(j) not in ends:
            self.out.diagnostics.append((code, "error", *span, "the load has no constant specifier", True))
            return
        self.out.imports.append((value, kind, "deferred" if deferred else "module", False, *span))
        if deferred:
            self.out.diagnostics.append(("deferred_execution_region", "warning", *span, "the load runs in a region of unknown activation", True))

    def names(self, i: int) -> tuple[list[tuple[str, str, bool]], int]:
        """(name, alias, type_only) of a braced list at ``i``, and the token after it."""
        found, i = [], i + 1
        while i < len(self.t) and self.at(i) != "}":
            typed = self.at(i) == "type" and self.at(i + 1) not in (",", "}", "as")
            i += typed
            name = self.at(i).strip("\"'")
            i += 1
            alias = name
            if self.at(i) == "as":
                alias, i = self.at(i + 1).strip("\"'"), i + 2
            found.append((name, alias, typed))
            if self.at(i) == ",":
                i += 1
            elif self.at(i) != "}":
                raise SyntaxError("malformed list of names")
        return found, i + 1

    def static_import(self, i: int) -> int:
        j = i + 1
        if self.kind(j) == "str":
            self.out.imports.append((unquoted(self.at(j)[1:-1]), "side_effect", "module", False, *self.span(i, j)))
            return j + 1
        typed = self.at(j) == "type" and self.at(j + 1) not in ("from", ",")
        j += typed
        bound: list[tuple[str | None, str, str, bool]] = []
        listed = False
        if self.kind(j) == "id" and self.at(j) != "from" or self.at(j + 1) == "from":
            if self.at(j + 1) == "=":  # import x = require("y")
                return j + 2
            bound.append(("default", self.at(j), "default", typed))
            j += 1
            j += self.at(j) == ","
        if self.at(j) == "*":
            bound.append((None, self.at(j + 2), "namespace", typed))
            j += 3
        elif self.at(j) == "{":
            found, j = self.names(j)
            listed = True
            bound += [(n, a, "named", typed or t) for n, a, t in found]
        if self.at(j) != "from" or self.kind(j + 1) != "str":
            raise SyntaxError("malformed import")
        source = unquoted(self.at(j + 1)[1:-1])
        only_types = typed or (bool(bound) and listed and all(k == "named" and t for _, _, k, t in bound))
        self.out.imports.append((source, "static" if bound else "side_effect", "module", only_types, *self.span(i, j + 1)))
        self.out.bindings += [(source, n, a, k, t) for n, a, k, t in bound]
        return j + 2

    def export(self, i: int) -> int:
        j = i + 1
        typed = self.at(j) == "type" and self.at(j + 1) in ("{", "*")
        j += typed
        add = self.out.exports.append
        if self.at(j) == "*":
            name = None
            if self.at(j + 1) == "as":
                name, j = self.at(j + 2), j + 2
            if self.at(j + 1) != "from" or self.kind(j + 2) != "str":
                raise SyntaxError("malformed export")
            source = unquoted(self.at(j + 2)[1:-1])
            span = self.span(i, j + 2)
            add((name or "*", source, None, None, "namespace" if name else "star", typed, *span))
            self.out.imports.append((source, "re_export", "module", typed, *span))
            return j + 3
        if self.at(j) == "{":
            found, j = self.names(j)
            source = unquoted(self.at(j + 1)[1:-1]) if self.at(j) == "from" and self.kind(j + 1) == "str" else None
            span = self.span(i, j + 1 if source is not None else j - 1)
            for n, a, t in found:
                add((a, source, n if source is not None else None, None if source is not None else n, "re_export" if source is not None else "local", typed or t, *span))
            if source is not None:
                self.out.imports.append((source, "re_export", "module", typed or (bool(found) and all(t for _, _, t in found)), *span))
                return j + 2
            return j
        if self.at(j) == "default":
            k = j + 1
            k += self.at(k) == "async"
            k += self.at(k) == "abstract"
            local = None
            if self.at(k) in ("function", "class"):
                k += 1
                k += self.at(k) == "*"
                local = self.at(k) if self.kind(k) == "id" and self.at(k) != "extends" else None
            add(("default", None, None, local, "default", False, *self.span(i, j)))
            return j + 1
        while self.at(j) in ("declare", "abstract", "async"):
            j += 1
        word = self.at(j)
        if word == "const" and self.at(j + 1) == "enum":
            j, word = j + 1, "enum"
        if word in _DECLARED:
            k = j + 1 + (self.at(j + 1) == "*")
            types = word in ("interface", "type")
            if _DECLARED[word] != "variable":
                add((self.at(k), None, None, self.at(k), _DECLARED[word], types, *self.span(i, k)))
                return k + 1
            for name in self.declared(k):
                add((name, None, None, name, "variable", False, *self.span(i, k)))
            return j  # its initialisers are read on
        if self.at(j) == "=":
            add(("export=", None, None, None, "common_js", False, *self.span(i, j)))
            return j + 1
        raise SyntaxError("malformed export")

    def declared(self, i: int) -> list[str]:
        """Names that a variable declaration binds, destructured ones too."""
        found, depth, expect = [], 0, True
        while i < len(self.t):
            x = self.at(i)
            if x in ("{", "[", "("):
                depth += 1
            elif x in ("}", "]", ")"):
                depth -= 1
                if depth < 0:
                    break
            elif x == ";" and not depth:
                break
            elif x == "," and not depth:
                expect = True
            elif x == "=" and not depth:
                expect = False
            elif self.kind(i) == "id" and expect and self.at(i - 1) not in (".", ":") or (self.kind(i) == "id" and expect and depth and self.at(i - 1) == ":"):
                if depth and self.at(i + 1) == ":":
                    pass
                else:
                    found.append(x)
                    if not depth:
                        expect = False
            if not depth and i + 1 < len(self.t) and not expect and self.at(i + 1) in ("export", "import", "const", "let", "var", "function", "class"):
                break
            i += 1
        return found

    def read(self) -> Facts:
        stack: list[tuple[str, bool]] = []  # open brackets, and whether each starts a function's body
        parens: list[str] = []
        functions, arrow_ends = 0, []  # arrow_ends: depths at which an arrow's expression body is open
        closed = ""  # what stood before the bracket closed last
        i = 0
        while i < len(self.t):
            x, kind, before = self.at(i), self.kind(i), self.at(i - 1)
            deferred = functions > 0 or bool(arrow_ends)
            if kind == "pun":
                while arrow_ends and (x in (",", ";") and len(stack) == arrow_ends[-1] or x in ")]}" and len(stack) <= arrow_ends[-1]):
                    arrow_ends.pop()
                if x in "([":
                    stack.append((x, False))
                    parens.append(before)
                elif x == "{":
                    body = before == "=>" or (before == ")" and closed not in _CONTROL and closed != "catch")
                    stack.append((x, body))
                    functions += body
                elif x in ")]":
                    if not stack or stack[-1][0] != ("(" if x == ")" else "["):
                        raise SyntaxError("unbalanced brackets")
                    stack.pop()
                    closed = parens.pop()
                elif x == "}":
                    if not stack or stack[-1][0] != "{":
                        raise SyntaxError("unbalanced brackets")
                    functions -= stack.pop()[1]
                elif x == "=>" and self.at(i + 1) != "{":
                    arrow_ends.append(len(stack))
            elif kind == "id" and before not in (".", "?."):
                after = self.at(i + 1)
                if x == "import" and after == "(":
                    self.load(i, i + 2, "dynamic", deferred, "unsupported_dynamic_import", (")", ","))
                elif x == "import" and after == "." and self.at(i + 2) == "meta" and self.at(i + 4) == "resolve" and self.at(i + 5) == "(":
                    self.load(i, i + 6, "dynamic", deferred, "unsupported_import_meta_resolve")
                elif x == "import" and after not in (".", ":") and not stack:
                    i = self.static_import(i)
                    continue
                elif x == "export" and not stack and after not in (":", "=="):
                    i = self.export(i)
                    continue
                elif x == "require" and after == "(":
                    self.load(i, i + 2, "common_js_require", deferred, "unsupported_dynamic_require")
                elif x == "require" and after == "." and self.at(i + 2) == "resolve" and self.at(i + 3) == "(":
                    self.load(i, i + 4, "common_js_resolve", deferred, "unsupported_dynamic_require")
                elif x == "new" and after == "URL" and self.at(i + 2) == "(":
                    value, j = self.constant(i + 3)
                    if self.at(j) == "," and [self.at(j + k) for k in range(1, 6)] == ["import", ".", "meta", ".", "url"]:
                        self.load(i, i + 3, "dynamic", deferred, "unsupported_url", (",",))
                elif x == "new" and after in ("Worker", "SharedWorker") and self.at(i + 2) == "(" and self.at(i + 3) != "new":
                    self.load(i, i + 3, "dynamic", deferred, "unsupported_worker", (")", ","))
                elif x == "const" and self.kind(i + 1) == "id" and self.at(i + 2) == "=" and not deferred:
                    value, j = self.constant(i + 3)
                    if value is not None and self.at(j) not in (".", "(", "["):
                        self.constants[after] = value
                    if self.at(i + 3) == "require" and self.at(i + 4) == "(" and (source := self.constant(i + 5)[0]) is not None:
                        self.out.bindings.append((source, None, after, "common_js", False))
                elif x == "module" and after == "." and self.at(i + 2) == "exports" and not deferred:
                    if self.at(i + 3) == "." and self.at(i + 5) == "=":
                        self.out.exports.append((self.at(i + 4), None, None, None, "common_js", False, *self.span(i, i + 4)))
                    elif self.at(i + 3) == "=":
                        self.out.exports.append(("module.exports", None, None, None, "common_js", False, *self.span(i, i + 2)))
                        self.out.diagnostics.append(("unsupported_common_js_export", "warning", *self.span(i, i + 2), "the exported object is not read", False))
                elif x == "exports" and after == "." and self.at(i + 3) == "=" and not deferred:
                    self.out.exports.append((self.at(i + 2), None, None, None, "common_js", False, *self.span(i, i + 2)))
            i += 1
        if stack:
            raise SyntaxError("unbalanced brackets")
        self.scopes()
        return self.out

    def closing(self, i: int) -> int:
        """The token that closes the bracket opened at ``i``."""
        depth = 0
        for j in range(i, len(self.t)):
            if self.kind(j) == "pun":
                depth += self.at(j) in "([{" and self.at(j) != ""
                depth -= self.at(j) in ")]}"
                if not depth:
                    return j
        return len(self.t) - 1

    def body(self, i: int, name: int, word: str) -> int | None:
        """The last token of a declaration that runs, or is looked at, only when its name is; None if that isn't sure."""
        j = name + 1
        if word in ("function", "class", "enum", "interface", "namespace"):
            while j < len(self.t) and self.at(j) not in ("{", ";"):
                j = self.closing(j) + 1 if self.at(j) in ("(", "[") else j + 1
            if self.at(j) != "{":
                return None
            end = self.closing(j)
            inside = [self.at(k) for k in range(i, end) if self.kind(k) in ("id", "pun")]
            # what a class or a namespace does as it is declared is no use of its name
            return None if word in ("class", "enum", "namespace") and ({"static", "@", "extends", "=", "["} & set(inside) or word == "namespace") else end
        if word == "type":
            while j < len(self.t) and self.at(j) != ";":
                if self.at(j) in ("export", "import", "const", "let", "var", "function", "class", "type", "interface", "enum"):
                    return None
                j = self.closing(j) + 1 if self.at(j) in ("(", "[", "{") else j + 1
            return j if j < len(self.t) else None
        if word in ("const", "let", "var") and self.at(j) == "=":
            j += 1
            j += self.at(j) == "async"
            if self.at(j) == "function":
                while j < len(self.t) and self.at(j) != "{":
                    j = self.closing(j) + 1 if self.at(j) == "(" else j + 1
                end = self.closing(j)
                return end if self.at(end + 1) in (";", "") else None
            k = self.closing(j) + 1 if self.at(j) == "(" else j + 1
            if self.at(k) == "=>" and self.at(k + 1) == "{":
                end = self.closing(k + 1)
                return end if self.at(end + 1) in (";", "") else None
        return None

    def scopes(self) -> None:
        """Module-level symbols, and references to them.

        A reference inside a declaration that only its own name brings to life is
        owned by it; every other one counts as soon as the module runs.  A name
        inside a function may hide a symbol, and a key may look like one: both
        count as references, so what is reported dead surely is.
        """
        owner: dict[int, str] = {}
        named: dict[str, str] = {}
        skipped: set[int] = set()
        i = 0
        while i < len(self.t):
            x = self.at(i)
            if self.kind(i) == "pun" and x in "([{":
                i = self.closing(i) + 1
                continue
            if self.kind(i) != "id" or self.at(i - 1) in (".", "?."):
                i += 1
                continue
            if x == "import" and self.at(i + 1) not in ("(", "."):
                while i < len(self.t) and self.kind(i) != "str":
                    skipped.add(i)
                    i += 1
                continue
            if x == "export" and self.at(i + 1) in ("{", "*") or (x == "export" and self.at(i + 1) == "type" and self.at(i + 2) == "{"):
                j = self.closing(i + 1 + (self.at(i + 1) == "type")) if self.at(i + 1) != "*" else i + 1
                skipped.update(range(i, j + 1))
                i = j + 1
                continue
            word, j = x, i
            while self.at(j) in ("export", "default", "declare", "abstract", "async"):
                j += 1
            word = self.at(j)
            if word == "const" and self.at(j + 1) == "enum":
                j, word = j + 1, "enum"
            if word in _DECLARED and self.kind(j + 1) in ("id", "pun"):
                k = j + 1 + (self.at(j + 1) == "*")
                if _DECLARED[word] == "variable":
                    names = [n for n in self.declared(k)]
                    for n in names:
                        named.setdefault(n, "variable")
                    single = len(names) == 1 and self.at(k) == names[0]
                elif self.kind(k) == "id":
                    names, single = [self.at(k)], True
                    named[self.at(k)] = _DECLARED[word] if named.get(self.at(k)) != "variable" else "variable"
                else:
                    names, single = [], False
                if single:
                    skipped.add(k)
                    end = self.body(i, k, word)
                    if end is not None and named[names[0]] == _DECLARED[word]:
                        owner.update((t, names[0]) for t in range(i, end + 1))
                        i = end + 1
                        continue
                i = k
                continue
            i += 1
        for _, _, local, _, typed in self.out.bindings:
            named.setdefault(local, "import")
        at: dict[str, tuple[int, int]] = {}
        found = set()
        for i, t in enumerate(self.t):
            if t.kind == "id" and t.text in named:
                at.setdefault(t.text, (i, i))
                if i not in skipped and self.at(i - 1) not in (".", "?."):
                    by = owner.get(i)
                    found.add((by, t.text, "type" if by and named[by] in ("interface", "type_alias") else "runtime"))
            if t.kind == "id" and self.at(i - 1) not in (".", "?.") and self.at(i + 1) == "(" and t.text in ("eval", "with"):
                self.out.guards.append(("direct_eval" if t.text == "eval" else "with_statement",))
        if any(e[0] == "module.exports" for e in self.out.exports):
            self.out.guards.append(("opaque_common_js_exports",))
        self.out.symbols = [(n, k, *self.span(*at[n])) for n, k in named.items() if n in at]
        self.out.refs = sorted(found, key=str)


def read_facts(text: str) -> Facts:
    """The facts of one source; one that can't be read has a blocking ``parse_failure`` alone."""
    try:
        return Reader(text).read()
    except (SyntaxError, RecursionError, ValueError, IndexError) as e:
        return Facts(diagnostics=[("parse_failure", "error", 0, 0, str(e), True)])


#: The fields of each nested column.
FIELDS = {
    "imports": "specifier string, kind string, activation string, type_only boolean, start int, end int",
    "exports": "exported string, source string, imported string, local string, kind string, type_only boolean, start int, end int",
    "bindings": "source string, imported string, local string, kind string, type_only boolean",
    "diagnostics": "code string, severity string, start int, end int, message string, blocks boolean",
    "symbols": "name string, kind string, start int, end int",
    "refs": "owner string, name string, usage string",
    "guards": "kind string",
}


def _ddl() -> str:
    def nested(fields: str) -> str:
        return "array<struct<" + ", ".join("{}: {}".format(*f.split()) for f in fields.split(", ")) + ">>"

    return "path string, digest string, " + ", ".join(f"{n} {nested(f)}" for n, f in FIELDS.items())


def extracted(sources: DataFrame) -> DataFrame:
    """One row of nested facts for each row of ``sources(path, text)``.

    Batches go through Arrow; a source over 2 MiB is not read and blocks.  Null
    texts count as empty.
    """

    def run(batches):
        names = {n: [x.split()[0] for x in f.split(", ")] for n, f in FIELDS.items()}
        for batch in batches:
            rows = []
            for path, text, digest in zip(batch["path"], batch["text"], batch["digest"], strict=True):
                big = len(text.encode()) > 2 << 20
                facts = Facts(diagnostics=[("source_too_large", "error", 0, 0, "the source is over 2 MiB", True)]) if big else read_facts(text)
                rows.append([path, digest] + [[dict(zip(cols, r, strict=True)) for r in getattr(facts, n)] for n, cols in names.items()])
            yield pd.DataFrame(rows, columns=["path", "digest", *names])

    text = F.coalesce("text", F.lit(""))
    return sources.select("path", text.alias("text"), F.sha2(text.cast("binary"), 256).alias("digest")).mapInPandas(run, _ddl())


def table(facts: DataFrame, name: str) -> DataFrame:
    """A narrow table: path and the fields of one nested column."""
    return facts.select("path", F.explode(name).alias("x")).select("path", "x.*")
