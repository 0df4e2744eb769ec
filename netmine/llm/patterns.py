"""A small reader of regular expressions, enough to derive what every match contains.

Nodes: ("literal", code point), ("set", members or None if they are not listed), ("group", nodes),
("either", [nodes, ...]), ("repeat", (least, most or None, nodes)), ("at",) for anchors.  Read are
literals, escapes, sets, groups `(...)`, `(?:...)`, `(?i:...)`, alternatives, quantifiers (lazy and
possessive ones alike), anchors and the dot; anything else raises ValueError.
"""

from __future__ import annotations

_PLAIN = {"n": "\n", "t": "\t", "r": "\r", "f": "\f", "v": "\v", "a": "\a", "0": "\0"}


class _Reader:
    def __init__(self, text: str):
        self.text, self.at = text, 0

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def take(self) -> str:
        c = self.peek()
        if not c:
            raise ValueError(f"{self.text!r} ends too early")
        self.at += 1
        return c

    def fail(self, why: str):
        raise ValueError(f"{why} at {self.at} of {self.text!r}")

    def alternatives(self) -> list:
        branches = [self.sequence()]
        while self.peek() == "|":
            self.take()
            branches.append(self.sequence())
        return branches[0] if len(branches) == 1 else [("either", branches)]

    def sequence(self) -> list:
        out = []
        while self.peek() not in ("", "|", ")"):
            node = self.atom()
            while self.peek() in ("*", "+", "?", "{") and self.peek():
                bounds = self.bounds()
                if bounds is None:
                    break
                node = ("repeat", (*bounds, [node]))
                if self.peek() in ("?", "+"):
                    self.take()
            out.append(node)
        return out

    def bounds(self) -> tuple[int, int | None] | None:
        c = self.peek()
        if c != "{":
            self.take()
            return {"*": (0, None), "+": (1, None), "?": (0, 1)}[c]
        end = self.text.find("}", self.at)
        low, comma, high = self.text[self.at + 1 : end].partition(",") if end > 0 else ("", "", "")
        if comma and not low and high.isdigit():
            self.fail("a quantifier without a lower bound")
        if not low.isdigit() or high and not high.isdigit():
            return None  # a brace that is no quantifier stands for itself
        self.at = end + 1
        return int(low), int(high) if high else None if comma else int(low)

    def atom(self):
        c = self.take()
        if c == "(":
            if self.peek() == "?":
                self.take()
                flags = ""
                while self.peek() in ("i", "s", "m", "-") and self.peek():
                    flags += self.take()
                if self.take() != ":":
                    self.fail("a group that is not read")
            nodes = self.alternatives()
            if self.take() != ")":
                self.fail("a group left open")
            return ("group", nodes)
        if c == "[":
            return self.members()
        if c == "\\":
            return self.escape()
        if c == ".":
            return ("set", None)
        return ("at",) if c in "^$" else ("literal", ord(c))

    def code(self) -> str | None:
        """The character of an escape, None for a class of characters."""
        c = self.take()
        if c in "xu":
            n = 2 if c == "x" else 4
            digits = self.text[self.at : self.at + n]
            self.at += n
            return chr(int(digits, 16))
        if c in "dDwWsS":
            return None
        if c in _PLAIN:
            return _PLAIN[c]
        if c.isalnum():
            self.fail("an escape that is not read")
        return c

    def escape(self):
        if self.peek() in ("b", "B", "A", "Z") and self.peek():
            self.take()
            return ("at",)
        c = self.code()
        return ("set", None) if c is None else ("literal", ord(c))

    def members(self):
        listed: set[int] | None = set()
        if self.peek() == "^":
            self.take()
            listed = None
        first = True
        while first or self.peek() != "]":
            first = False
            c = self.take()
            low = self.code() if c == "\\" else c
            if self.peek() == "-" and self.text[self.at + 1 : self.at + 2] not in ("", "]") and low is not None:
                self.take()
                c = self.take()
                high = self.code() if c == "\\" else c
                if listed is not None and high is not None and ord(high) - ord(low) < 64:
                    listed |= set(range(ord(low), ord(high) + 1))
                else:
                    listed = None
            elif low is None:
                listed = None
            elif listed is not None:
                listed.add(ord(low))
        self.take()
        return ("set", listed)


def parse(pattern: str) -> list:
    reader = _Reader(pattern)
    nodes = reader.alternatives()
    if reader.at < len(pattern):
        reader.fail("an unbalanced bracket")
    return nodes
