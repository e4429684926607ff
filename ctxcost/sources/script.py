"""What a JavaScript or TypeScript file imports, re-exports and exports.

An approximation of a grammar: a tokenizer that knows comments, strings, templates and regular expressions, and
patterns over its tokens at any depth. Calls inside a template's substitutions aren't seen.
"""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.kinds import GRAPH_EXTENSIONS
from ..schema import MODULE

DEFAULT = "__default__"
Module = dict[str, Any]

_DECLINES = re.compile(r"\bimport\b|\bexport\s+default\b|\bexport\s*[*{]|\bfrom\s+['\"]|\brequire\s*\(|\bmodule\.exports\b|\bexports\.")
_SIMPLE = re.compile(r"^export\s+(?:async\s+)?(?:function\s*\*?|class|const|let|var|enum)\s+([A-Za-z_$][\w$]*)", re.M)
_TOKEN = re.compile(r"""(?P<skip>\s+|//[^\n]*|/\*[\s\S]*?(?:\*/|$))|(?P<id>[A-Za-z_$][\w$]*)|(?P<num>\d[\w.]*)|(?P<str>"(?:\\[\s\S]|[^"\\\n])*"|'(?:\\[\s\S]|[^'\\\n])*')|(?P<op>=>|===?|!==?|[<>]=|\.\.\.|[\s\S])""")
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
_BEFORE_REGEX = frozenset("return typeof case in of delete void throw new else do await yield instanceof".split())
_STATEMENTS = frozenset("const let var function class export import return if for while switch try throw type interface enum async".split())
_OPEN, _CLOSE = frozenset("([{"), frozenset(")]}")

Token = tuple[str, str]


def _template(text: str, at: int) -> tuple[int, bool]:
    """(end, whether it has substitutions) of the template literal at ``at``."""
    i, deep, plain = at + 1, 0, True
    while i < len(text):
        c = text[i]
        if c == "\\":
            i += 1
        elif deep == 0 and c == "`":
            return i + 1, not plain
        elif c == "`" and deep:
            i, _ = _template(text, i)
            continue
        elif deep == 0 and text.startswith("${", i):
            deep, plain, i = 1, False, i + 1
        elif deep and c in "{}":
            deep += 1 if c == "{" else -1
        i += 1
    return len(text), not plain


def tokens(text: str) -> list[Token]:
    """(kind, text): id, num, str (its content), tpl (with substitutions), re and op; and nl for line breaks."""
    out: list[Token] = []
    i, last = 0, None
    while i < len(text):
        if out and out[-1][0] != "nl":
            last = out[-1]
        if text[i] == "`":
            end, mixed = _template(text, i)
            out.append(("tpl", "") if mixed else ("str", text[i + 1 : end - 1]))
            i = end
            continue
        if text[i] == "/" and (last is None or last[0] == "op" and last[1] not in _CLOSE or last[0] == "id" and last[1] in _BEFORE_REGEX):
            m = _REGEX.match(text, i)
            if m:
                out.append(("re", m[0]))
                i = m.end()
                continue
        m = _TOKEN.match(text, i)
        assert m
        kind = m.lastgroup or "op"
        if kind == "skip":
            if "\n" in m[0] and out and out[-1][0] != "nl":
                out.append(("nl", ""))
        else:
            out.append((kind, m[0][1:-1] if kind == "str" else m[0]))
        i = m.end()
    return out


def fast_parse(text: str) -> Module | None:
    """Files that only declare exports, by one pattern; None if the file needs the tokenizer."""
    if _DECLINES.search(text):
        return None
    names = list(dict.fromkeys(_SIMPLE.findall(text)))
    if not names and re.search(r"\bexport\b", text):
        return None
    return {"imports": [], "reexports": [], "exported_names": names}


class _Parse:
    def __init__(self, text: str):
        self.all = tokens(text)
        self.t = [t for t in self.all if t[0] != "nl"]
        lines, self.line = 0, []
        for t in self.all:
            if t[0] == "nl":
                lines += 1
            else:
                self.line.append(lines)
        self.imports: list[dict[str, Any]] = []
        self.reexports: list[dict[str, Any]] = []
        self.names: dict[str, None] = {}

    def at(self, i: int) -> Token:
        return self.t[i] if 0 <= i < len(self.t) else ("end", "")

    def op(self, i: int, *texts: str) -> bool:
        kind, text = self.at(i)
        return kind == "op" and text in texts

    def word(self, i: int, *texts: str) -> bool:
        kind, text = self.at(i)
        return kind == "id" and (not texts or text in texts)

    def closing(self, i: int) -> int:
        """Index of the bracket that closes the one at ``i``."""
        deep = 0
        for j in range(i, len(self.t)):
            if self.at(j)[0] == "op":
                deep += (self.at(j)[1] in _OPEN) - (self.at(j)[1] in _CLOSE)
                if not deep:
                    return j
        return len(self.t)

    def opening(self, i: int) -> int:
        deep = 0
        for j in range(i, -1, -1):
            if self.at(j)[0] == "op":
                deep += (self.at(j)[1] in _CLOSE) - (self.at(j)[1] in _OPEN)
                if not deep:
                    return j
        return -1

    def entries(self, i: int) -> list[list[int]]:
        """Token indexes of each entry of the bracket at ``i``, parted by its commas."""
        end, out, deep = self.closing(i), [[]], 0
        for j in range(i + 1, end):
            if self.at(j)[0] == "op":
                deep += (self.at(j)[1] in _OPEN) - (self.at(j)[1] in _CLOSE)
            if deep == 0 and self.op(j, ","):
                out.append([])
            else:
                out[-1].append(j)
        return [e for e in out if e]

    def specifiers(self, i: int) -> list[tuple[str, str]]:
        """(name, name outside) of an import or export list."""
        out = []
        for e in self.entries(i):
            words = [self.at(j)[1] for j in e if self.at(j)[0] in ("id", "str")]
            if len(words) > 1 and words[0] == "type" and words[1] != "as":
                words = words[1:]
            if words:
                out.append((words[0], words[2] if len(words) > 2 and words[1] == "as" else words[0]))
        return out

    def run(self) -> Module:
        i = 0
        while i < len(self.t):
            after = i + 1
            if self.at(i)[0] == "id" and not self.op(i - 1, "."):
                text = self.at(i)[1]
                if text == "import":
                    after = self.dynamic(i) if self.op(i + 1, "(") else self.static(i)
                elif text == "export" and not self.op(i + 1, ":", "(", ",", "}"):
                    after = self.export(i)
                elif text == "require" and self.op(i + 1, "("):
                    self.call(i, False)
                elif text in ("module", "exports"):
                    self.assignment(i)
            i = after
        return {"imports": self.imports, "reexports": self.reexports, "exported_names": list(self.names)}

    def static(self, i: int) -> int:
        j = i + 1
        if self.op(j, "."):
            return j
        if self.word(j, "type") and not self.word(j + 1, "from") and not self.op(j + 1, ",", "="):
            j += 1
        names: list[str] = []
        space = clause = False
        while j < len(self.t) and not (self.word(j, "from") and self.at(j + 1)[0] == "str"):
            if self.at(j)[0] == "str" or self.op(j, ";"):
                return j + 1  # for its effects only
            if self.op(j, "="):
                end = self.closing(j + 2) if self.op(j + 2, "(") else j
                return end + 1
            if self.op(j, "*"):
                space = clause = True
                j += 3 if self.word(j + 1, "as") else 1
            elif self.op(j, "{"):
                names += [n for n, _ in self.specifiers(j)]
                clause = True
                j = self.closing(j) + 1
            else:
                if self.word(j):
                    names.append(DEFAULT)
                    clause = True
                j += 1
        if clause and self.at(j + 1)[0] == "str":
            self.imports.append({"source": self.at(j + 1)[1], "names": names, "namespace": space})
        return j + 2

    def export(self, i: int) -> int:
        j = i + 1
        if self.word(j, "default"):
            self.names[DEFAULT] = None
            return j + 1
        if self.word(j, "type") and self.op(j + 1, "{", "*"):
            j += 1
        if self.op(j, "*"):
            while j < len(self.t) and self.at(j)[0] != "str":
                j += 1
            self.reexports.append({"source": self.at(j)[1], "names": [], "star": True})
            return j + 1
        if self.op(j, "{"):
            found, end = self.specifiers(j), self.closing(j)
            if self.word(end + 1, "from") and self.at(end + 2)[0] == "str":
                self.reexports += [{"source": self.at(end + 2)[1], "names": [n], "star": False} for n, _ in found]
                end += 2
            self.names |= dict.fromkeys(o for _, o in found)
            return end + 1
        while self.word(j, "declare", "async"):
            j += 1
        if self.word(j, "const") and self.word(j + 1, "enum"):
            j += 1
        if self.word(j, "function", "class", "enum"):
            if self.word(j + 1):
                self.names[self.at(j + 1)[1]] = None
            return j + 1
        if self.word(j, "const", "let", "var"):
            return self.declarators(j + 1)
        return j

    def declarators(self, j: int) -> int:
        """Names of a declaration; its values are looked at by the main loop, so only the first token is passed."""
        first, deep, fresh = j, 0, True
        while j < len(self.t):
            if fresh and deep == 0 and self.word(j) and (self.op(j + 1, "=", ":", ",", ";", "!") or j + 1 == len(self.t) or self.line[j + 1] > self.line[j]):
                self.names[self.at(j)[1]] = None
            fresh = False
            if self.at(j)[0] == "op":
                deep += (self.at(j)[1] in _OPEN) - (self.at(j)[1] in _CLOSE)
                if deep < 0 or deep == 0 and self.op(j, ";"):
                    break
                fresh = deep == 0 and self.op(j, ",")
            elif deep == 0 and j > first and self.word(j, *_STATEMENTS) and self.line[j] > self.line[j - 1] and not self.op(j - 1, "=", "=>", ","):
                break
            j += 1
        return first

    def binding(self, i: int) -> tuple[str, list[str]]:
        """What a value at ``i`` is bound to by a declaration: ("", []), ("name", []) or ("pattern", its names)."""
        if not self.op(i - 1, "="):
            return "", []
        j = i - 2
        if self.op(j, "}"):
            start = self.opening(j)
            if self.word(start - 1, "const", "let", "var") or self.op(start - 1, ","):
                names = [self.at(e[0])[1] for e in self.entries(start) if self.at(e[0])[0] == "id" and (len(e) == 1 or self.op(e[1], ":", "="))]
                return "pattern", names
            return "", []
        while j > 0 and not self.op(j, ";", "{", "}", "(", ")", "=") and not self.word(j, "const", "let", "var"):
            j -= 1
        return ("name", []) if self.word(j, "const", "let", "var") else ("", [])

    def call(self, i: int, dynamic: bool) -> None:
        if self.at(i + 2)[0] != "str" or not self.op(i + 3, ")", ","):
            return
        end = self.closing(i + 1)
        kind, names = ("", []) if self.op(end + 1, ".", "(", "[", "?") else self.binding(i)
        if kind == "pattern":
            space = not names
        elif dynamic:
            names, space = [DEFAULT], False
        else:
            space = True
        self.imports.append({"source": self.at(i + 2)[1], "names": names, "namespace": space})

    def dynamic(self, i: int) -> int:
        self.call(i, True)
        return i + 1

    def assignment(self, i: int) -> None:
        j = i
        whole = False
        if self.word(i, "module"):
            if not (self.op(i + 1, ".") and self.word(i + 2, "exports")):
                return
            j, whole = i + 2, True
        if self.op(j + 1, ".") and self.word(j + 2) and self.op(j + 3, "="):
            self.names[self.at(j + 2)[1]] = None
        elif whole and self.op(j + 1, "="):
            if not self.op(j + 2, "{"):
                self.names[DEFAULT] = None
                return
            for e in self.entries(j + 2):
                kind, text = self.at(e[0])
                if kind == "id" and (len(e) == 1 or self.op(e[1], ":")) or kind == "str" and len(e) > 1 and self.op(e[1], ":"):
                    self.names[text] = None


def parse(text: str, extension: str) -> Module | None:
    """The module surface of a file, or None for an extension of another language."""
    if extension not in GRAPH_EXTENSIONS:
        return None
    return fast_parse(text) or _Parse(text).run()


@F.udf(MODULE, useArrow=True)
def _parse_udf(text: str | None) -> Module | None:
    return None if text is None else fast_parse(text) or _Parse(text).run()


def module(text: Column) -> Column:
    """The module surface of a text. Files that only declare exports don't leave the JVM; as for ``fast_parse``, one pattern tells them."""
    names = F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?m){_SIMPLE.pattern}"), F.lit(1)))
    fast = ~text.rlike(_DECLINES.pattern) & ((F.size(names) > 0) | ~text.rlike(r"\bexport\b"))
    none = [F.array().cast(MODULE[x].dataType).alias(x) for x in ("imports", "reexports")]
    return F.when(fast, F.struct(*none, names.alias("exported_names"))).otherwise(_parse_udf(F.when(~fast, text)))
