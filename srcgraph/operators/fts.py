"""Full-text search over names and signatures, with a match language.

``compile_match`` turns a query into phrases and a boolean tree on the driver;
``match`` reads only the postings of the query's tokens and prefixes, groups
them by symbol and evaluates the tree as one column expression.

The language: terms side by side or with AND, OR and NOT; ``"phrases"`` and
``a + b``; ``prefix*``; ``^first``; ``name: x``, ``signature: x``,
``{name signature}: x``, ``-name: x``; ``NEAR(a b, 10)``; parentheses.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcgraph.functions import scalar as S
from srcgraph.schema import QuerySyntaxError

FIELDS = ("name", "signature")


def postings(symbols: DataFrame) -> DataFrame:
    """(token, field, pos, path, ord, kind): every token of every indexed field."""
    parts = [
        symbols.select(F.lit(f).alias("field"), F.posexplode(S.index_tokens(F.col(f))).alias("pos", "token"), "path", "ord", "kind")
        for f in FIELDS
    ]
    return parts[0].unionByName(parts[1]).select("token", "field", "pos", "path", "ord", "kind")


@dataclass(frozen=True)
class Phrase:
    tokens: tuple[str, ...]
    prefix: bool = False
    initial: bool = False


@dataclass(frozen=True)
class Near:
    phrases: tuple[Phrase, ...]
    gap: int
    fields: tuple[str, ...]


@dataclass(frozen=True)
class Op:
    kind: str
    left: object
    right: object


_LEX = re.compile(r'\s*(?:("(?:[^"]|"")*")|([A-Za-z0-9_\x1a\u0080-\U0010ffff]+)|([()+*:,^{}-]))')


def _lex(query: str) -> list[tuple[str, str]]:
    out, at = [], 0
    query = query.rstrip()
    while at < len(query):
        m = _LEX.match(query, at)
        if not m:
            raise QuerySyntaxError(f"syntax error near {query[at:].strip()[:1]!r}")
        at = m.end()
        if m[1] is not None:
            out.append(("string", m[1][1:-1].replace('""', '"')))
        elif m[2] is not None:
            out.append((m[2] if m[2] in ("AND", "OR", "NOT") else "string", m[2]))
            if m[2] not in ("AND", "OR", "NOT"):
                out[-1] = ("word", m[2])
        else:
            out.append((m[3], m[3]))
    return out


def _tokens(text: str) -> tuple[str, ...]:
    folded = S.fold_text(text)
    kept = "".join(c if unicodedata.category(c)[0] in "LN" or unicodedata.category(c) == "Co" else " " for c in folded)
    return tuple(kept.split())


class _Parser:
    def __init__(self, query: str):
        self.lex, self.at = _lex(query), 0
        if not self.lex:
            raise QuerySyntaxError("empty match expression")

    def peek(self, k: int = 0) -> str:
        return self.lex[self.at + k][0] if self.at + k < len(self.lex) else "end"

    def take(self, kind: str | None = None) -> str:
        if self.at >= len(self.lex) or kind and self.lex[self.at][0] != kind:
            raise QuerySyntaxError(f"syntax error near {self.lex[self.at][1] if self.at < len(self.lex) else ''!r}")
        self.at += 1
        return self.lex[self.at - 1][1]

    def parse(self) -> object:
        tree = self.either(FIELDS)
        if self.peek() != "end":
            raise QuerySyntaxError(f"syntax error near {self.lex[self.at][1]!r}")
        return tree

    # NOT binds tightest, then AND, then OR; terms side by side bind tighter than all
    def either(self, fields: tuple[str, ...]) -> object:
        left = self.both(fields)
        while self.peek() == "OR":
            self.take()
            left = Op("OR", left, self.both(fields))
        return left

    def both(self, fields: tuple[str, ...]) -> object:
        left = self.without(fields)
        while self.peek() == "AND":
            self.take()
            left = Op("AND", left, self.without(fields))
        return left

    def without(self, fields: tuple[str, ...]) -> object:
        left = self.side_by_side(fields)
        while self.peek() == "NOT":
            self.take()
            left = Op("NOT", left, self.side_by_side(fields))
        return left

    def side_by_side(self, fields: tuple[str, ...]) -> object:
        left = self.item(fields)
        while self.peek() in ("string", "word", "(", "^", "{", "-"):
            left = Op("AND", left, self.item(fields))
        return left

    def item(self, fields: tuple[str, ...]) -> object:
        narrowed = self.columns(fields)
        if narrowed is not None:
            fields = narrowed
        if self.peek() == "(":
            self.take()
            tree = self.either(fields)
            self.take(")")
            return tree
        if self.peek() == "word" and self.lex[self.at][1] == "NEAR" and self.peek(1) == "(":
            self.take(), self.take()
            phrases = []
            while self.peek() not in (",", ")"):
                phrases.append(self.phrase())
            gap = 10
            if self.peek() == ",":
                self.take()
                number = self.take("word")
                if not number.isdigit():
                    raise QuerySyntaxError(f"expected a number, got {number!r}")
                gap = int(number)
            self.take(")")
            if not phrases:
                raise QuerySyntaxError("NEAR of nothing")
            return Near(tuple(phrases), gap, fields)
        return Near((self.phrase(),), 0, fields)

    def columns(self, fields: tuple[str, ...]) -> tuple[str, ...] | None:
        start, minus = self.at, False
        if self.peek() == "-":
            self.take()
            minus = True
        names = []
        if self.peek() == "{":
            self.take()
            while self.peek() in ("word", "string"):
                names.append(self.take())
            self.take("}")
            self.take(":")
        elif self.peek() in ("word", "string") and self.peek(1) == ":":
            names.append(self.take())
            self.take(":")
        elif minus:
            # what is left of "a-b" is read as a column name
            raise QuerySyntaxError(f"no such column: {self.lex[self.at][1] if self.at < len(self.lex) else ''}")
        else:
            self.at = start
            return None
        for n in names:
            if n.lower() not in FIELDS:
                raise QuerySyntaxError(f"no such column: {n}")
        picked = {n.lower() for n in names}
        return tuple(f for f in fields if (f in picked) != minus)

    def phrase(self) -> Phrase:
        initial = self.peek() == "^"
        if initial:
            self.take()
        if self.peek() == "*":
            raise QuerySyntaxError("unknown special query")
        parts = [self.string()]
        while self.peek() == "+":
            self.take()
            parts.append(self.string())
        prefix = self.peek() == "*"
        if prefix:
            self.take()
        return Phrase(tuple(t for p in parts for t in _tokens(p)), prefix, initial)

    def string(self) -> str:
        if self.peek() not in ("string", "word"):
            raise QuerySyntaxError(f"syntax error near {self.lex[self.at][1] if self.at < len(self.lex) else ''!r}")
        return self.take()


def compile_match(query: str) -> object:
    """The tree of a match expression; ``QuerySyntaxError`` where it isn't one."""
    return _Parser(query).parse()


def _phrases(tree: object) -> list[Phrase]:
    return [*_phrases(tree.left), *_phrases(tree.right)] if isinstance(tree, Op) else list(tree.phrases)


def _is(hit: Column, phrase: Phrase, k: int) -> Column:
    token = phrase.tokens[k]
    return F.startswith(hit["token"], F.lit(token)) if phrase.prefix and k == len(phrase.tokens) - 1 else hit["token"] == token


def _places(phrase: Phrase, fields: tuple[str, ...]) -> Column:
    """Hits at which the phrase begins."""
    hits = F.col("hits")

    def follows(h: Column, k: int) -> Callable[[Column], Column]:
        return lambda g: _is(g, phrase, k) & (g["field"] == h["field"]) & (g["pos"] == h["pos"] + k)

    def begins(h: Column) -> Column:
        ok = _is(h, phrase, 0) & h["field"].isin(*fields)
        if phrase.initial:
            ok = ok & (h["pos"] == 0)
        for k in range(1, len(phrase.tokens)):
            ok = ok & F.exists(hits, follows(h, k))
        return ok

    return F.filter(hits, begins)


def _holds(tree: object) -> Column:
    if isinstance(tree, Op):
        left, right = _holds(tree.left), _holds(tree.right)
        return left | right if tree.kind == "OR" else left & (~right if tree.kind == "NOT" else right)
    live = [p for p in tree.phrases if p.tokens]
    if not live or not tree.fields:
        return F.lit(False)
    if len(live) == 1:
        return F.size(_places(live[0], tree.fields)) > 0
    # all phrases within one stretch of the field, at most ``gap`` tokens from the end of one to the start of the last
    def around(h: Column) -> Column:
        ok = F.lit(True)
        for p in live[1:]:
            reach = tree.gap + max(len(live[0].tokens), len(p.tokens))
            ok = ok & F.exists(_places(p, tree.fields), lambda g: (g["field"] == h["field"]) & (F.abs(g["pos"] - h["pos"]) <= reach))
        return ok

    return F.exists(_places(live[0], tree.fields), around)


def matched(post: DataFrame, query: str, kind: str | None = None) -> DataFrame:
    """(path, ord) of the symbols that match."""
    tree = compile_match(query)
    phrases = _phrases(tree)
    whole = sorted({t for p in phrases for k, t in enumerate(p.tokens) if not (p.prefix and k == len(p.tokens) - 1)})
    starts = sorted({p.tokens[-1] for p in phrases if p.prefix and p.tokens})
    wanted = [F.col("token").isin(*whole)] if whole else []
    wanted += [F.startswith(F.col("token"), F.lit(s)) for s in starts]
    read = post.where(reduce(lambda a, b: a | b, wanted) if wanted else F.lit(False))
    if kind is not None:
        read = read.where(F.col("kind") == kind)
    # a symbol has few tokens, so its list of hits is short however many symbols match
    hits = read.groupBy("path", "ord").agg(F.collect_list(F.struct("token", "field", "pos")).alias("hits"))
    return hits.where(_holds(tree)).select("path", "ord")


def search(symbols: DataFrame, post: DataFrame, query: str, kind: str | None = None, limit: int = 50) -> DataFrame:
    """The first ``limit`` matching symbols in (path, ord) order."""
    first = matched(post, query.strip(), kind).orderBy("path", "ord").limit(limit if limit > 0 else 50)
    return symbols.join(first, ["path", "ord"], "left_semi").orderBy("path", "ord")
