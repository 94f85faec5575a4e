"""Symbols and imports of source texts, by comment- and string-aware scanners.

One scanner a language masks comments and strings (length and lines stay), finds
declarations by pattern and their ends by brackets or indentation. Broken source
gives what can be recognised. Signature and parent stay empty.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterator

_C_STYLE = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
_MASKS = {
    "go": re.compile(_C_STYLE + r"|`[^`]*(?:`|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?", re.S),
    "typescript": re.compile(_C_STYLE + r"|`(?:\\.|[^`\\])*(?:`|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?", re.S),
    "python": re.compile(r"#[^\n]*|[rRbBuUfF]{0,2}(?:\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?)", re.S),
    "rust": re.compile(_C_STYLE + r"|r#*\".*?\"#*|\"(?:\\.|[^\"\\])*(?:\"|\Z)|'(?:\\.[^']*|[^'\\\n])'", re.S),
    "java": re.compile(_C_STYLE + r"|\"\"\".*?(?:\"\"\"|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?", re.S),
}
_MASKS["javascript"] = _MASKS["typescript"]


class Source:
    def __init__(self, text: str, language: str):
        self.text = text
        self.code = _MASKS[language].sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
        self.lines = [0, *(m.end() for m in re.finditer("\n", text))]

    def line(self, at: int) -> int:
        return bisect.bisect_right(self.lines, at)

    def closing(self, at: int) -> int:
        """Place of the bracket that closes the one at ``at``."""
        pairs, depth = {"(": ")", "[": "]", "{": "}"}, 0
        opening, shut = self.code[at], pairs[self.code[at]]
        for m in re.finditer(f"[{re.escape(opening)}{re.escape(shut)}]", self.code[at:]):
            depth += 1 if m[0] == opening else -1
            if not depth:
                return at + m.start()
        return len(self.code.rstrip()) - 1

    def block_end(self, at: int) -> int:
        """End of a declaration that starts before ``at``: of its block, or of its statement if none opens."""
        i, n = at, len(self.code)
        while i < n:
            c = self.code[i]
            if c in "([":
                i = self.closing(i)
            elif c == "{":
                return self.closing(i)
            elif c == ";":
                return i
            i += 1
        return max(at, len(self.code.rstrip()) - 1)

    def statement_end(self, at: int) -> int:
        """End of a statement that brackets may carry over lines."""
        i, n = at, len(self.code)
        last = at
        while i < n:
            c = self.code[i]
            if c in "([{":
                i = self.closing(i)
                last = i
            elif c in ";\n":
                break
            elif not c.isspace():
                last = i
            i += 1
        return last


Found = list[tuple[str, str, int, int]]


def _each(s: Source, pattern: str, kind: str, end: Callable[[re.Match], int], flags: int = re.M) -> Found:
    # a declaration begins where its pattern's named group does
    return [(m["name"], kind, s.line(m.start("def")), s.line(end(m))) for m in re.finditer(pattern, s.code, flags)]


def _go(s: Source) -> Found:
    block = lambda m: s.block_end(m.end() - 1)
    out = _each(s, r"^(?P<def>func[ \t]+(?P<name>\w+)\s*(?:\[[^\]]*\]\s*)?\()", "function", block)
    out += _each(s, r"^(?P<def>func[ \t]*\([^)]*\)\s*(?P<name>\w+)\s*\()", "method", block)

    def specs(keyword: str) -> Iterator[tuple[int, int]]:
        """Stretches of the specs of single and grouped declarations."""
        for m in re.finditer(rf"(?:^|[;{{}}])[ \t]*{keyword}\b[ \t]*", s.code, re.M):
            if s.code[m.end() : m.end() + 1] == "(":
                stop, at = s.closing(m.end()), m.end() + 1
                while at < stop:
                    gap = re.compile(r"[\s;]*").match(s.code, at).end()
                    if gap >= stop:
                        break
                    end = s.statement_end(gap)
                    yield gap, end
                    at = max(end + 1, gap + 1)
            else:
                yield m.end(), s.statement_end(m.end())

    for a, b in specs("type"):
        m = re.compile(r"(\w+)\s*(?:\[[^\]]*\]\s*)?(?!\s*=)(?=\S)").match(s.code, a)
        if m and not re.compile(r"\w+\s*=").match(s.code, a):
            out.append((m[1], "type", s.line(a), s.line(b)))
    for keyword, kind in (("var", "variable"), ("const", "constant")):
        for a, b in specs(keyword):
            m = re.compile(r"\w+(?:\s*,\s*\w+)*").match(s.code, a)
            for name in re.findall(r"\w+", m[0]) if m else []:
                out.append((name, kind, s.line(a), s.line(b)))
    out += _each(s, r"^(?P<def>package[ \t]+(?P<name>\w+))", "package", lambda m: m.end() - 1)
    return out


_NOT_EXPRESSION = r"(?<![=(,:?&|!\[.\w])"


def _script(typed: bool) -> Callable[[Source], Found]:
    def run(s: Source) -> Found:
        block = lambda m: s.block_end(m.end() - 1)
        stmt = lambda m: s.statement_end(m.end() - 1)
        out = []
        for m in re.finditer(r"(?P<def>(?:async\s+)?function\s+(?P<name>[\w$]+)\s*(?:<[^>(]*>\s*)?\()", s.code):
            before = s.code[: m.start("def")].rstrip()
            if not before or before[-1] not in "=(,:?&|!." and not re.search(r"\breturn$", before):
                out.append((m["name"], "function", s.line(m.start("def")), s.line(block(m))))
        arrow = r"(?P<def>\b(?:const|let)\s+(?P<name>[\w$]+)\s*(?::[^=;]+)?=\s*(?:async\s+)?(?:<[^>(]*>\s*)?(?:\([^()]*(?:\([^()]*\)[^()]*)*\)|[\w$]+)\s*(?::[^=;{]+)?=>)"
        out += _each(s, arrow, "function", stmt)
        abstract = r"(?<!abstract )" if typed else ""
        out += _each(s, rf"{abstract}(?P<def>\bclass\s+(?P<name>[\w$]+)[^{{;]*\{{)", "class", lambda m: s.closing(m.end() - 1))
        words = r"(?:(?:public|private|protected|static|async|readonly|override|get|set)\s+)*"
        method = rf"(?:^|[{{;}},])[ \t]*(?P<def>{words}\*?\s*(?P<name>[\w$]+)\s*(?:<[^>(]*>\s*)?\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?::[^{{;=]+)?\{{)"
        reserved = {"if", "for", "while", "switch", "catch", "function", "with", "return", "super"}
        out += [f for f in _each(s, method, "method", lambda m: s.closing(m.end() - 1)) if f[0] not in reserved]
        if typed:
            out += _each(s, r"(?P<def>\binterface\s+(?P<name>[\w$]+)[^{;]*\{)", "interface", lambda m: s.closing(m.end() - 1))
            out += _each(s, r"(?:^|[;{}]|export\s)[ \t]*(?P<def>type\s+(?P<name>[\w$]+)\s*(?:<[^=]*>\s*)?=)", "type", stmt)
        else:
            for m in re.finditer(r"\b(?:const|let)\s+", s.code):
                at, stop = m.end(), s.statement_end(m.end())
                while at <= stop:
                    name = re.compile(r"\s*(?P<name>[\w$]+)").match(s.code, at)
                    if not name:
                        break
                    i = name.end()
                    while i <= stop and s.code[i] != ",":
                        i = s.closing(i) + 1 if s.code[i] in "([{" else i + 1
                    end = len(s.code[: min(i, stop + 1)].rstrip()) - 1
                    out.append((name["name"], "variable", s.line(name.start("name")), s.line(end)))
                    at = i + 1
        return out

    return run


def _python(s: Source) -> Found:
    starts, depth = [], 0
    # a line that starts inside brackets, or behind a backslash, carries on
    for i, at in enumerate(s.lines):
        stop = s.lines[i + 1] if i + 1 < len(s.lines) else len(s.code)
        row = s.code[at:stop]
        carried = depth > 0 or (at > 1 and s.code[at - 2] == "\\")
        if row.strip() and not carried and s.text[at:stop].strip():
            starts.append((at, len(row) - len(row.lstrip(" \t"))))
        for c in row:
            depth = max(0, depth + (c in "([{") - (c in ")]}"))

    def logical_end(k: int) -> int:
        stop = starts[k + 1][0] if k + 1 < len(starts) else len(s.text)
        return max(starts[k][0], len(s.code[:stop].rstrip(" \t\r\n")) - 1, len(_no_comment(s, starts[k][0], stop)) + starts[k][0] - 1)

    def body_end(k: int) -> int:
        j = k
        while j + 1 < len(starts) and starts[j + 1][1] > starts[k][1]:
            j += 1
        return logical_end(j)

    functions, classes, variables = [], [], []
    for k, (at, indent) in enumerate(starts):
        head = at + indent
        if m := re.compile(r"(?:async\s+)?def\s+(\w+)").match(s.code, head):
            functions.append((m[1], "function", s.line(head), s.line(body_end(k))))
        elif m := re.compile(r"class\s+(\w+)").match(s.code, head):
            classes.append((m[1], "class", s.line(head), s.line(body_end(k))))
        elif m := re.compile(r"([^\W\d]\w*)\s*(?::[^=\n]+)?=(?!=)").match(s.code, head):
            variables.append((m[1], "variable", s.line(head), s.line(logical_end(k))))
    return functions + classes + variables


def _no_comment(s: Source, a: int, b: int) -> str:
    """The text from ``a`` to ``b`` up to its last code or string."""
    return re.sub(r"(?:\s|#[^\n]*)+\Z", "", s.text[a:b])


def _rust(s: Source) -> Found:
    block = lambda m: s.block_end(m.end() - 1)
    out = _each(s, r"(?P<def>(?:pub(?:\([^)]*\))?\s+)?(?:default\s+|const\s+|async\s+|unsafe\s+|extern\s+(?:\"[^\"]*\"\s+)?)*\bfn\s+(?P<name>\w+)\s*(?=[<(]))", "function", lambda m: s.block_end(m.end()))
    for word, kind in (("struct", "type"), ("enum", "type"), ("trait", "interface"), ("mod", "module"), ("type", "type")):
        out += _each(s, rf"(?:^|(?<=[;{{}}\]]))\s*(?P<def>(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?{word}\s+(?P<name>\w+))", kind, block)
    return out


def _java(s: Source) -> Found:
    body = lambda m: s.closing(m.end() - 1)
    words = r"(?:(?:public|private|protected|static|final|abstract|sealed|strictfp|synchronized|native|default)\s+)*"
    out = _each(s, rf"(?<![\w.])(?P<def>{words}class\s+(?P<name>\w+)[^{{;]*\{{)", "class", body)
    out += _each(s, rf"(?<![\w.@])(?P<def>{words}interface\s+(?P<name>\w+)[^{{;]*\{{)", "interface", body)
    method = rf"(?:^|[{{;}}])\s*(?P<def>(?:@\w+(?:\([^)]*\))?\s*)*{words}(?:<[^>(]*>\s*)?(?P<kind>[\w.]+(?:<[^;{{}}()=]*>)?(?:\[\])*)\s+(?P<name>\w+)\s*\([^)]*\)\s*(?:throws\s+[\w.,\s]+)?[{{;])"
    reserved = {"new", "return", "else", "throw", "case", "assert", "package", "import", "yield", "public", "private", "protected", "static", "final", "abstract", "sealed", "strictfp", "synchronized", "native", "default"}
    for m in re.finditer(method, s.code, re.M):
        if m["kind"] not in reserved and m["name"] not in ("if", "for", "while", "switch", "catch"):
            end = s.closing(m.end() - 1) if s.code[m.end() - 1] == "{" else m.end() - 1
            out.append((m["name"], "method", s.line(m.start("def")), s.line(end)))
    return out


SCANNERS: dict[str, Callable[[Source], Found]] = {"go": _go, "typescript": _script(True), "javascript": _script(False), "python": _python, "rust": _rust, "java": _java}


def _import_hits(s: Source, language: str) -> Iterator[tuple[str, int]]:
    if language == "go":
        for m in re.finditer(r"^[ \t]*import\b", s.code, re.M):
            # strings are blank in the masked code, so blanks are skipped in the text
            at = re.compile(r"[ \t]*").match(s.text, m.end()).end()
            stop = s.closing(at) if s.code[at : at + 1] == "(" else s.text.find("\n", at) if "\n" in s.text[at:] else len(s.text)
            for q in re.finditer(r"(?:^|[\s(;])(?:[\w.]+[ \t]+)?(\"[^\"\n]*\")", s.text[at:stop]):
                # quotes in a comment are no import: their place is blank in code, but so is the comment mark
                row = s.text[s.lines[s.line(at + q.start(1)) - 1] : at + q.start(1)]
                if "//" not in row:
                    yield q[1], at + q.start(1)
    elif language in ("typescript", "javascript"):
        for m in re.finditer(r"(?:^|[;}])[ \t]*import\b(?!\s*[.(])", s.code, re.M):
            q = re.compile(r"[^'\";]*(['\"])([^'\"\n]*)\1").match(s.text, m.end())
            if q and (re.search(r"\bfrom\s*$", s.text[m.end() : q.start(1)]) or not s.text[m.end() : q.start(1)].strip()):
                yield q[1] + q[2] + q[1], q.start(1)
    elif language == "python":
        for m in re.finditer(r"^[ \t]*(?:import[ \t]+(?P<names>[^\n;]+)|from[ \t]+(?P<mod>[A-Za-z_][\w.]*)[ \t]+import\b)|;[ \t]*import[ \t]+(?P<more>[^\n;]+)", s.code, re.M):
            if m["mod"]:
                if m["mod"] != "__future__":
                    yield m["mod"], m.start("mod")
                continue
            group = "names" if m["names"] else "more"
            at = m.start(group)
            for part in m[group].split(","):
                if re.fullmatch(r"\s*[A-Za-z_][\w.]*\s*", part):
                    yield part.strip(), at + len(part) - len(part.lstrip())
                at += len(part) + 1
    elif language == "rust":
        for m in re.finditer(r"(?:^|(?<=[;{}]))\s*(?:pub(?:\([^)]*\))?\s+)?use\s+([^;]+);", s.code, re.M):
            yield s.text[m.start(1) : m.end(1)].strip(), m.start(1)
    elif language == "java":
        for m in re.finditer(r"^[ \t]*import\s+(?:static\s+)?([\w.]+?)(?:\.\*)?\s*;", s.code, re.M):
            if "." in m[1]:
                yield m[1], m.start(1)


def symbols(text: str, language: str) -> list[dict]:
    """Symbols in the order of the language's kinds, then of the text."""
    found = SCANNERS[language](Source(text, language))
    return [{"ord": i, "name": n, "kind": k, "line": a, "end_line": max(a, b), "signature": "", "parent": ""} for i, (n, k, a, b) in enumerate(found)]


def imports(text: str, language: str) -> list[dict]:
    """Imports without quotes, each source once, at its first place."""
    s, seen = Source(text, language), {}
    for raw, at in _import_hits(s, language):
        source = raw.strip("\"'")
        if source and source not in seen:
            seen[source] = s.line(at)
    return [{"ord": i, "source": k, "line": v} for i, (k, v) in enumerate(seen.items())]


def parse(text: str, language: str) -> tuple[list[dict], list[dict]]:
    """(symbols, imports); ``ValueError`` for a language without a scanner."""
    if language not in SCANNERS:
        raise ValueError(f"unsupported language: {language}")
    return symbols(text, language), imports(text, language)
