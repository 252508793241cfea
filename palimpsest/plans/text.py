"""Tokens of SQL text, and helpers to cut statements at top-level keywords."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from ..errors import SyntaxProblem

_TOKEN = re.compile(
    r"""(?P<space>\s+|--[^\n]*|/\*.*?\*/)
      |(?P<string>'(?:[^']|'')*'|\$\$.*?\$\$)
      |(?P<quoted>"(?:[^"]|"")*"|`(?:[^`]|``)*`|\[[A-Za-z_][\w ]*\])
      |(?P<number>\d+\.?\d*(?:[eE][+-]?\d+)?)
      |(?P<param>\$\d+|:[A-Za-z_]\w*|@[A-Za-z_]\w*)
      |(?P<word>[A-Za-z_][\w$]*)
      |(?P<op>::|->>|->|@>|<@|\|\||<=>|<>|!=|<=|>=|.)""",
    re.S | re.X,
)


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    start: int
    end: int
    depth: int

    @property
    def upper(self) -> str:
        return self.text.upper() if self.kind == "word" else self.text


def tokens(sql: str) -> list[Token]:
    """Tokens without space and comments; depth counts the parentheses around."""
    out, depth = [], 0
    for m in _TOKEN.finditer(sql):
        kind = m.lastgroup or "op"
        if kind == "space":
            continue
        if m.group() == ")":
            depth -= 1
        out.append(Token(kind, m.group(), m.start(), m.end(), depth))
        if m.group() == "(":
            depth += 1
    if depth:
        raise SyntaxProblem("unbalanced parentheses")
    return out


def statements(sql: str) -> list[str]:
    """Split a batch at semicolons outside strings and comments."""
    out, begin = [], 0
    for t in tokens(sql):
        if t.text == ";" and t.depth == 0:
            out.append(sql[begin : t.start].strip())
            begin = t.end
    out.append(sql[begin:].strip())
    return [s for s in out if s]


def name_of(token: Token | str) -> str:
    text = token if isinstance(token, str) else token.text
    if text[:1] in "\"`":
        return text[1:-1].replace(text[0] * 2, text[0])
    return text[1:-1] if text[:1] == "[" else text


class Cursor:
    """Reads tokens from left to right."""

    def __init__(self, sql: str):
        self.sql, self.all, self.at = sql, tokens(sql), 0
        while self.all and self.all[-1].text == ";":
            self.all.pop()

    @property
    def done(self) -> bool:
        return self.at >= len(self.all)

    def peek(self, ahead: int = 0) -> str:
        i = self.at + ahead
        return self.all[i].upper if i < len(self.all) else ""

    def take(self, *words: str) -> bool:
        """Step over the words if they come next."""
        if all(self.peek(i) == w for i, w in enumerate(words)):
            self.at += len(words)
            return True
        return False

    def expect(self, *words: str) -> None:
        if not self.take(*words):
            raise SyntaxProblem(f"expected {' '.join(words)} at: {self.rest()[:60]!r}")

    def next(self) -> Token:
        if self.done:
            raise SyntaxProblem("statement ends too early")
        self.at += 1
        return self.all[self.at - 1]

    def name(self) -> str:
        """A name, the last part of a qualified one."""
        t = self.next()
        if t.kind not in ("word", "quoted"):
            raise SyntaxProblem(f"expected a name, found {t.text!r}")
        while self.peek() == ".":
            self.next()
            t = self.next()
        return name_of(t)

    def rest(self) -> str:
        return "" if self.done else self.sql[self.all[self.at].start : self.all[-1].end]

    def until(self, stops: Iterable[Sequence[str]]) -> str:
        """Text up to the first of the stop phrases at this depth, or to the end."""
        stops = [tuple(s) for s in stops]
        begin = self.at
        base = self.all[begin].depth if begin < len(self.all) else 0
        cases = 0
        while not self.done:
            t = self.all[self.at]
            if t.depth < base:
                break
            if t.depth == base:
                if t.upper == "CASE":
                    cases += 1
                elif t.upper == "END" and cases:
                    cases -= 1
                elif not cases and self.at > begin - 1 and any(all(self.peek(i) == w for i, w in enumerate(s)) for s in stops):
                    break
            self.at += 1
        return "" if self.at == begin else self.sql[self.all[begin].start : self.all[self.at - 1].end]

    def group(self) -> str:
        """What the parentheses that begin here hold."""
        open_ = self.next()
        if open_.text != "(":
            raise SyntaxProblem(f"expected ( at {open_.text!r}")
        begin = open_.end
        while not (self.peek() == ")" and self.all[self.at].depth == open_.depth):
            self.next()
        return self.sql[begin : self.next().start].strip()


def split_top(text: str, separator: str = ",") -> list[str]:
    out, begin = [], 0
    for t in tokens(text):
        if t.depth == 0 and t.upper == separator:
            out.append(text[begin : t.start].strip())
            begin = t.end
    out.append(text[begin:].strip())
    return [x for x in out if x]
