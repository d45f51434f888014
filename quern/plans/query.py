"""The query language: nodes, lexer and parser. Plain Python; a query is text of 512 bytes at most."""

from __future__ import annotations

from dataclasses import dataclass, replace
from enum import Enum

MAX_BYTES, MAX_DEPTH = 512, 12


class QuerySyntaxError(ValueError):
    """What is wrong with a query, and at which byte."""

    def __init__(self, message: str, position: int = 0):
        super().__init__(f"{message} (at {position})")
        self.position = position


class Occur(Enum):
    MUST, SHOULD, NOT = "+", "", "-"


# ---- nodes; str() is the text form


def _named(field: str | None, text: str) -> str:
    return f"{field}:{text}" if field else text


@dataclass(frozen=True)
class Term:
    text: str
    field: str | None = None
    boost: float = 1.0

    def __str__(self) -> str:
        return _named(self.field, self.text)


@dataclass(frozen=True)
class Phrase:
    words: tuple[str, ...]
    field: str | None = None
    offsets: tuple[int, ...] = ()
    boost: float = 1.0

    def __str__(self) -> str:
        return _named(self.field, '"' + " ".join(self.words) + '"')


@dataclass(frozen=True)
class Prefix:
    text: str
    field: str | None = None

    def __str__(self) -> str:
        return _named(self.field, self.text + "*")


@dataclass(frozen=True)
class Wildcard:
    text: str
    field: str | None = None

    def __str__(self) -> str:
        return _named(self.field, self.text)


@dataclass(frozen=True)
class Expanded:
    """What a prefix or wildcard stands for, once looked up."""

    terms: tuple[str, ...]
    source: str
    field: str | None = None
    truncated: bool = False

    def __str__(self) -> str:
        return _named(self.field, self.source)


@dataclass(frozen=True)
class MatchAll:
    def __str__(self) -> str:
        return "*"


@dataclass(frozen=True)
class MatchNone:
    def __str__(self) -> str:
        return "∅"


@dataclass(frozen=True)
class Clause:
    occur: Occur
    query: Node


@dataclass(frozen=True)
class Boolean:
    clauses: tuple[Clause, ...]
    least: int = 1

    def __str__(self) -> str:
        return "(" + " ".join(f"{c.occur.value}{c.query}" for c in self.clauses) + ")"


Node = Term | Phrase | Prefix | Wildcard | Expanded | MatchAll | MatchNone | Boolean


def in_field(node: Node, field: str) -> Node:
    if isinstance(node, Boolean):
        return replace(node, clauses=tuple(Clause(c.occur, in_field(c.query, field)) for c in node.clauses))
    return node if isinstance(node, MatchAll | MatchNone) else replace(node, field=field)


# ---- lexer


@dataclass(frozen=True)
class Token:
    kind: str  # word phrase : ( ) + - and or not end
    text: str
    at: int


_SPACE = " \t\n\r\v\f"


def lex(query: str) -> list[Token]:
    """Tokens with byte places. `: ( )` always stand alone; `+ - !` only where a token starts, so words may hold them."""
    raw = query.encode()
    if len(raw) > MAX_BYTES:
        raise QuerySyntaxError(f"a query has {MAX_BYTES} bytes at most", MAX_BYTES)
    text, out, i = raw.decode("latin-1"), [], 0  # a character a byte
    back = lambda s: s.encode("latin-1").decode(errors="replace")
    while i < len(text):
        c = text[i]
        if c in _SPACE:
            i += 1
        elif c in ":()+-!":
            out.append(Token("not" if c == "!" else c, c, i))
            i += 1
        elif c == '"':
            value, j = "", i + 1
            while j < len(text) and text[j] != '"':
                j += text[j] == "\\" and j + 1 < len(text)
                value += text[j]
                j += 1
            if j >= len(text):
                raise QuerySyntaxError("a phrase has no closing quote", i)
            out.append(Token("phrase", back(value), i))
            i = j + 1
        else:
            j = i
            while j < len(text) and text[j] not in _SPACE + ':()"':
                j += 1
            word = back(text[i:j])
            out.append(Token(word.lower() if word.lower() in ("and", "or", "not") else "word", word, i))
            i = j
    return [*out, Token("end", "", len(text))]


# ---- parser


class _Parser:
    def __init__(self, tokens: list[Token], default: Occur):
        self.tokens, self.k, self.default = tokens, 0, default

    @property
    def token(self) -> Token:
        return self.tokens[self.k]

    def take(self, *kinds: str) -> Token | None:
        t = self.token
        if t.kind not in kinds:
            return None
        self.k += t.kind != "end"
        return t

    def unexpected(self) -> QuerySyntaxError:
        t = self.token
        return QuerySyntaxError(f"unexpected {t.text or 'end of query'}", t.at)

    def boolean(self, depth: int) -> Node:
        if depth > MAX_DEPTH:
            raise QuerySyntaxError(f"groups are {MAX_DEPTH} deep at most", self.token.at)
        clauses: list[Clause] = []
        pending: Occur | None = None
        while self.token.kind not in ("end", ")"):
            if self.take("or"):
                pending = Occur.SHOULD
                self.turn(clauses, Occur.MUST, Occur.SHOULD)
            elif self.take("and"):
                pending = Occur.MUST
                self.turn(clauses, Occur.SHOULD, Occur.MUST)
            else:
                occur = pending or self.default
                if self.take("+"):
                    occur = Occur.MUST
                elif self.take("-", "not"):
                    occur = Occur.NOT
                clauses.append(Clause(occur, self.primary(depth)))
                pending = None
        if not clauses:
            raise QuerySyntaxError("a group is empty", self.token.at)
        if len(clauses) == 1 and clauses[0].occur is not Occur.NOT:
            return clauses[0].query
        return Boolean(tuple(clauses), 0 if any(c.occur is Occur.MUST for c in clauses) else 1)

    @staticmethod
    def turn(clauses: list[Clause], old: Occur, new: Occur) -> None:
        """AND tightens and OR relaxes the clause before it."""
        if clauses and clauses[-1].occur is old:
            clauses[-1] = Clause(new, clauses[-1].query)

    def primary(self, depth: int) -> Node:
        if self.token.kind in ("(", "phrase"):
            return self.operand(None, depth)
        t = self.take("word")
        if not t:
            raise self.unexpected()
        return self.operand(t.text, depth) if self.take(":") else leaf(t.text, None)

    def operand(self, field: str | None, depth: int) -> Node:
        if t := self.take("phrase"):
            return Phrase(tuple(t.text.split()), field)
        if t := self.take("("):
            group = self.boolean(depth + 1)
            if not self.take(")"):
                raise QuerySyntaxError("a parenthesis is not closed", t.at)
            return in_field(group, field) if field else group
        if t := self.take("word"):
            return leaf(t.text, field)
        raise self.unexpected()


def leaf(text: str, field: str | None) -> Node:
    stem = text.rstrip("*")
    if "?" in text or "*" in stem:
        return Wildcard(text, field)
    if stem != text:
        return Prefix(stem, field) if stem else MatchAll()
    return Term(text, field)


def parse(query: str, default_operator: str = "or") -> Node:
    """Blank queries match all. AND, OR, NOT (any case), + - !, "phrases", field:..., prefix*, wild?c*rds, groups."""
    p = _Parser(lex(query), Occur.MUST if default_operator.lower() == "and" else Occur.SHOULD)
    if p.token.kind == "end":
        return MatchAll()
    out = p.boolean(0)
    if p.token.kind == ")":
        raise QuerySyntaxError("a parenthesis is not opened", p.token.at)
    if p.token.kind != "end":
        raise p.unexpected()
    return out
