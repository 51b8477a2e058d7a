"""Tokens for the hand-written parsers."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..functions.scalar import QueryError

_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


@dataclass(frozen=True)
class Token:
    kind: str  # name, quoted, string, int, float, param, symbol, end
    text: str
    at: int


def unescape(body: str) -> str:
    return re.sub(r"\\(u[0-9a-fA-F]{4}|.)", lambda m: chr(int(m[1][1:], 16)) if len(m[1]) > 1 else _ESCAPES.get(m[1], m[1]), body, flags=re.S)


class Cursor:
    """A token list with a place in it."""

    def __init__(self, tokens: list[Token], text: str):
        self.tokens, self.at, self.text = tokens, 0, text

    @property
    def now(self) -> Token:
        return self.tokens[self.at]

    def ahead(self, n: int = 1) -> Token:
        return self.tokens[min(self.at + n, len(self.tokens) - 1)]

    def step(self) -> Token:
        t = self.now
        self.at = min(self.at + 1, len(self.tokens) - 1)
        return t

    def is_word(self, *words: str) -> bool:
        return self.now.kind == "name" and self.now.text.upper() in words

    def word(self, *words: str) -> bool:
        """Take the words, all in a row, if they are next."""
        for k, w in enumerate(words):
            t = self.ahead(k) if k else self.now
            if t.kind != "name" or t.text.upper() != w:
                return False
        self.at += len(words)
        return True

    def is_sym(self, *symbols: str) -> bool:
        return self.now.kind == "symbol" and self.now.text in symbols

    def sym(self, symbol: str) -> bool:
        if self.is_sym(symbol):
            self.step()
            return True
        return False

    def need(self, symbol: str) -> None:
        if not self.sym(symbol):
            self.fail(f"expected {symbol!r}")

    def need_word(self, word: str) -> None:
        if not self.word(word):
            self.fail(f"expected {word}")

    def name(self) -> str:
        if self.now.kind not in ("name", "quoted"):
            self.fail("expected a name")
        return self.step().text

    def end(self) -> bool:
        return self.now.kind == "end"

    def fail(self, why: str):
        line = self.text.count("\n", 0, self.now.at) + 1
        raise QueryError(f"{why} at line {line}, near {self.text[self.now.at : self.now.at + 20]!r}")


def tokens(text: str, pattern: re.Pattern) -> Cursor:
    """``pattern`` has the named groups skip, string, float, int, name, quoted, param, symbol and others."""
    out, at = [], 0
    while at < len(text):
        m = pattern.match(text, at)
        if not m or m.end() == at:
            raise QueryError(f"unexpected {text[at]!r} at position {at}")
        kind = m.lastgroup
        if kind == "string":
            out.append(Token(kind, unescape(m[0][1:-1]), at))
        elif kind == "quoted":
            out.append(Token(kind, m[0][1:-1], at))
        elif kind != "skip":
            out.append(Token(kind, m[0], at))
        at = m.end()
    out.append(Token("end", "", len(text)))
    return Cursor(out, text)
