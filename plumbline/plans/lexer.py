"""Tokens of the canonical grammar."""

from __future__ import annotations

import re
from dataclasses import dataclass

from plumbline.errors import GrammarError

_TOKEN = re.compile(
    r"""(?P<space>\s+)
      | (?P<hex>0[xX][0-9A-Fa-f]+)
      | (?P<number>(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)
      | (?P<string>'(?:[^']|'')*')
      | (?P<quoted>"(?:[^"]|"")+")
      | (?P<word>[^\W0-9]\w*)
      | (?P<cast>::)
      | (?P<sign>\|\||<=|>=|<>|!=|[-+*/=<>(),.;])""",
    re.VERBOSE,
)


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    start: int
    end: int

    @property
    def upper(self) -> str:
        return self.text.upper() if self.kind == "word" else ""


def tokens(text: str) -> list[Token]:
    """All tokens and an end mark. Whatever fits no token is an error."""
    out: list[Token] = []
    at = 0
    while at < len(text):
        found = _TOKEN.match(text, at)
        if found is None:
            raise GrammarError(f"unsupported text at {text[at : at + 20]!r}")
        kind = found.lastgroup or ""
        if kind != "space":
            if kind in ("number", "hex") and found.end() < len(text) and (text[found.end()].isalnum() or text[found.end()] == "_"):
                raise GrammarError(f"a name can't begin with a digit: {text[at : found.end() + 10]!r}")
            if kind == "string" and out and out[-1].kind == "string":
                raise GrammarError("two strings in a row")
            out.append(Token(kind, found.group(), at, found.end()))
        at = found.end()
    out.append(Token("end", "", len(text), len(text)))
    return out


def unquoted(text: str) -> str:
    """A name without its quotes."""
    return text[1:-1].replace('""', '"') if text[:1] == '"' else text
