"""Regular expressions: the byte-mode, always caseless dialect of the command line, on Java's engine.

A pattern is parsed into a tree and written anew. What Java lacks is put into terms it has: a call of another group becomes
a copy of it, alternatives that share group numbers get numbers of their own and their references try each, a
conditional asks an empty group set beside the one in question, and ``\\K`` becomes a group that ends there, whose length moves
the start of the match. Names become numbers. A call of a group from within itself, and verbs, are errors.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.errors import IllegalArgumentException

#: POSIX classes and their Java names, fixed values.
_POSIX = {
    "alpha": r"\p{Alpha}", "digit": r"\p{Digit}", "alnum": r"\p{Alnum}", "upper": r"\p{Upper}", "lower": r"\p{Lower}", "punct": r"\p{Punct}",
    "space": r"\s", "blank": r"\p{Blank}", "cntrl": r"\p{Cntrl}", "graph": r"\p{Graph}", "print": r"\p{Print}", "xdigit": r"\p{XDigit}", "word": r"\w",
}
_QUANTIFIER = re.compile(r"(?:[*+?]|\{\d+(?:,\d*)?\})[?+]?")
_NUMBER, _NAME = r"[+-]?\d+", r"[A-Za-z_]\w*"
#: Matches nothing, like a reference to a group that is not set.
_NEVER = "(?!)"


class UnsupportedPattern(ValueError):
    """The pattern is wrong, or uses a construct that cannot be put into Java's terms."""


# ---------------------------------------------------------------- the tree


@dataclass
class Text:
    """Written as it is."""

    java: str


@dataclass
class Group:
    """``head``: what opens it in Java; ``number``: of a capturing one. ``shared``: its alternatives number their groups alike."""

    head: str
    branches: list[list] = field(default_factory=list)
    number: int | None = None
    shared: bool = False


@dataclass
class Reference:
    target: int | str


@dataclass
class Call:
    target: int | str


@dataclass
class Condition:
    """``test``: a group's number or name, or a lookaround Group; None: never."""

    test: object
    branches: list[list]


@dataclass
class Keep:
    """Where the match is said to begin."""


# ---------------------------------------------------------------- parsing


class _Parser:
    def __init__(self, pattern: str):
        self.pattern, self.at, self.groups = pattern, 0, 0
        self.names: dict[str, int] = {}

    def fail(self, what: str) -> UnsupportedPattern:
        return UnsupportedPattern(f"syntax error in the pattern {self.pattern!r} at offset {min(self.at, len(self.pattern))}: {what}")

    def refuse(self, what: str) -> UnsupportedPattern:
        return UnsupportedPattern(f"{what} is not supported in {self.pattern!r}, at offset {self.at}")

    def take(self, expression: str) -> re.Match | None:
        found = re.compile(expression).match(self.pattern, self.at)
        if found:
            self.at = found.end()
        return found

    def whole(self) -> list[list]:
        branches = self.branches()
        if self.at < len(self.pattern):
            raise self.fail("unmatched )")
        return branches

    def branches(self, shared: bool = False) -> list[list]:
        first, most, out = self.groups, self.groups, [[]]
        while self.at < len(self.pattern) and self.pattern[self.at] != ")":
            if self.take(r"\|"):
                out.append([])
                most = max(most, self.groups)
                self.groups = first if shared else self.groups
                continue
            node = self.item()
            if node is not None:
                quantifier = self.take(_QUANTIFIER.pattern)
                out[-1].append((node, quantifier[0] if quantifier else ""))
        self.groups = max(most, self.groups)
        return out

    def item(self):
        c = self.pattern[self.at]
        if c == "\\":
            return self.escape()
        if c == "[":
            end = _class_end(self.pattern, self.at)
            if end > len(self.pattern):
                self.at = len(self.pattern)
                raise self.fail("missing ]")
            inner, self.at = self.pattern[self.at + 1 : end - 1], end
            return Text("[" + _java_class(inner) + "]")
        if c == "(":
            return self.group()
        self.at += 1
        if c == "{" and not re.match(r"\{\d+(?:,\d*)?\}", self.pattern[self.at - 1 :]):
            return Text(r"\{")
        return Text(c)

    def escape(self):
        if m := self.take(r"\\Q(.*?)(?:\\E|$)"):
            return Group("(?:", [[(Text(re.sub(r"(\W)", r"\\\1", c)), "") for c in m[1]]]) if m[1] else None
        if self.take(r"\\E"):
            return None
        if self.take(r"\\K"):
            return Keep()
        if self.take(r"\\N(?!\{)"):
            return Text(r"[^\n]")
        if m := self.take(rf"\\g(?:<({_NAME}|{_NUMBER})>|'({_NAME}|{_NUMBER})')"):
            return self.call(m[1] or m[2])
        if m := self.take(rf"\\g(?:\{{({_NAME}|{_NUMBER})\}}|({_NUMBER}))|\\k(?:<({_NAME})>|'({_NAME})'|\{{({_NAME})\}})"):
            return Reference(self.place(next(x for x in m.groups() if x)))
        if m := self.take(r"\\([1-9]\d?)"):
            n = int(m[1])
            if n < 10 or n <= self.pattern.count("("):
                return Reference(n)
            self.at = m.start()
        if m := self.take(r"\\(0[0-7]{0,2}|[1-7][0-7]{1,2})"):
            return Text(rf"\x{{{int(m[1], 8):x}}}")
        if self.at + 1 >= len(self.pattern):
            raise self.fail("\\ at the end")
        m = self.take(r"(?s)\\x\{[0-9A-Fa-f]+\}|\\[pP]\{\^?\w+\}|\\c.|\\.")
        return Text(m[0])

    def place(self, name: str) -> int | str:
        """A group's number or name; signed numbers count from here."""
        if re.fullmatch(_NUMBER, name):
            return self.groups + int(name) + (name[0] == "-") if name[0] in "+-" else int(name)
        return name

    def call(self, name: str) -> Call:
        return Call(self.place(name))

    def group(self):
        if self.take(r"\(\?#"):
            if not self.take(r"[^)]*\)"):
                self.at = len(self.pattern)
                raise self.fail("missing ) after a comment")
            return None
        if self.take(r"\(\*"):
            raise self.refuse("a verb")
        if self.take(r"\(\?(?:R|0)\)"):
            raise self.refuse("recursion")
        if m := self.take(rf"\(\?(?:P>|&)({_NAME})\)|\(\?({_NUMBER})\)"):
            return self.call(m[1] or m[2])
        if m := self.take(rf"\(\?P=({_NAME})\)"):
            return Reference(m[1])
        if m := self.take(r"\(\?[a-zA-Z-]*\)"):
            return Text(m[0])
        if self.take(r"\(\?(?=\()"):
            return self.condition()
        if self.take(r"\(\?\|"):
            node = Group("(?:", shared=True)
        elif m := self.take(rf"\(\?(?:P?<({_NAME})>|'({_NAME})')"):
            self.groups += 1
            self.names.setdefault(m[1] or m[2], self.groups)
            node = Group("(", number=self.groups)
        elif m := self.take(r"\(\?(?:[:=!>]|<[=!]|[a-zA-Z-]*:)"):
            node = Group(m[0])
        elif self.pattern.startswith("(?", self.at):
            raise self.fail("unknown group")
        else:
            self.at += 1
            self.groups += 1
            node = Group("(", number=self.groups)
        node.branches = self.branches(node.shared)
        self.close()
        return node

    def close(self) -> None:
        if not self.take(r"\)"):
            raise self.fail("missing )")

    def condition(self) -> Condition:
        if m := self.take(rf"\((?:({_NUMBER})|<({_NAME})>|'({_NAME})')\)"):
            test = self.place(m[1] or m[2] or m[3])
        elif self.take(r"\(DEFINE\)"):
            test = None
        elif re.match(r"\((?:R\d*|R&\w+)\)", self.pattern[self.at :]):
            raise self.refuse("a condition on recursion")
        elif m := self.take(rf"\(({_NAME})\)"):
            test = m[1]
        elif re.match(r"\(\?<?[=!]", self.pattern[self.at :]):
            test = self.group()
        else:
            raise self.fail("unknown condition")
        branches = self.branches()
        if len(branches) > 2:
            raise self.fail("more than two branches of a condition")
        self.close()
        return Condition(test, branches)


def _class_end(pattern: str, at: int) -> int:
    """Behind the class that opens at ``at``: a first ``]`` is a member, ``[:name:]`` and escapes are whole."""
    k = at + 1
    if pattern[k : k + 1] == "^":
        k += 1
    if pattern[k : k + 1] == "]":
        k += 1
    while k < len(pattern) and pattern[k] != "]":
        named = re.match(r"\[:\^?\w+:\]", pattern[k:])
        k += len(named[0]) if named else 2 if pattern[k] == "\\" else 1
    return k + 1


def _java_class(inner: str) -> str:
    """A bracketed class as Java reads it: ``[``, ``]`` and ``&`` are plain characters within it."""
    out, k = "", 0
    if inner[:1] == "^":
        out, k = "^", 1
    while k < len(inner):
        if inner[k] == "\\":
            out += inner[k : k + 2]
            k += 2
        elif m := re.match(r"\[:(\^?)(\w+):\]", inner[k:]):
            if m[2] not in _POSIX:
                raise UnsupportedPattern(f"unknown class {m[0]}")
            out += _POSIX[m[2]] if not m[1] else "[^" + _POSIX[m[2]] + "]"
            k += len(m[0])
        else:
            out += "\\" + inner[k] if inner[k] in "[]&" else inner[k]
            k += 1
    return out


# ---------------------------------------------------------------- writing


class _Writer:
    """Java's groups are numbered as they are written; references are filled in at the end, when all are known."""

    def __init__(self, parser: _Parser, branches: list[list]):
        self.parser, self.written, self.keeps = parser, 0, []
        self.groups: dict[int, list[Group]] = {}
        self.asked: set[int] = set()
        self.set_: dict[int, list[int]] = {}
        self.marks: dict[int, list[int]] = {}
        self._look(branches)
        self.fills: list[tuple[str, int, list[dict[int, int]]]] = []
        self.java = self._top(branches)
        for k, (kind, number, scopes) in enumerate(self.fills):
            self.java = self.java.replace(f"\0{k}\0", self._filled(kind, number, scopes))

    def _look(self, branches: list[list]) -> None:
        for node in (n for b in branches for n, _ in b):
            if isinstance(node, Group):
                if node.number is not None:
                    self.groups.setdefault(node.number, []).append(node)
                self._look(node.branches)
            elif isinstance(node, Condition):
                if isinstance(node.test, Group):
                    self._look(node.test.branches)
                elif node.test is not None:
                    self.asked.add(self._number(node.test))
                self._look(node.branches)

    def _number(self, target: int | str) -> int:
        number = self.parser.names.get(target) if isinstance(target, str) else target
        if number is None or not 1 <= number <= self.parser.groups:
            raise UnsupportedPattern(f"there is no group {target} in {self.parser.pattern!r}, which ends at offset {len(self.parser.pattern)}")
        return number

    def _filled(self, kind: str, number: int, scopes: list[dict[int, int]]) -> str:
        for scope in scopes:
            if number in scope:
                return f"(?:\\{scope[number]})"
        places = (self.set_ if kind == "text" else self.marks).get(number, [])
        if not places:
            return _NEVER
        return "(?:" + "|".join(f"\\{p}" for p in places) + ")"

    def _top(self, branches: list[list]) -> str:
        out = []
        for b in branches:
            last = max((k for k, (n, _) in enumerate(b) if isinstance(n, Keep)), default=None)
            if last is None:
                out.append(self._sequence(b, [], ()))
                continue
            self.written += 1
            self.keeps.append(self.written)
            kept = self._sequence([x for x in b[:last] if not isinstance(x[0], Keep)], [], ())
            out.append(f"({kept})" + self._sequence(b[last + 1 :], [], ()))
        return "|".join(out)

    def _sequence(self, items: list, scopes: list[dict[int, int]], within: tuple[int, ...]) -> str:
        return "".join(self._item(node, scopes, within, quantifier) + quantifier for node, quantifier in items)

    def _branches(self, branches: list[list], scopes: list[dict[int, int]], within: tuple[int, ...]) -> str:
        return "|".join(self._sequence(b, scopes, within) for b in branches)

    def _fill(self, kind: str, number: int, scopes: list[dict[int, int]]) -> str:
        self.fills.append((kind, number, scopes))
        return f"\0{len(self.fills) - 1}\0"

    def _item(self, node, scopes: list[dict[int, int]], within: tuple[int, ...], quantifier: str) -> str:
        if isinstance(node, Text):
            return node.java
        if isinstance(node, Keep):
            raise UnsupportedPattern(f"\\K within a group is not supported in {self.parser.pattern!r}")
        if isinstance(node, Reference):
            return self._fill("text", self._number(node.target), scopes)
        if isinstance(node, Call):
            number = self._number(node.target)
            if number in within:
                raise UnsupportedPattern(f"recursion is not supported in {self.parser.pattern!r}")
            # A copy, which is not entered again once it has matched; its groups are its own.
            body = self.groups[number][0]
            return "(?>" + self._branches(body.branches, [{}, *scopes], (*within, number)) + ")"
        if isinstance(node, Condition):
            yes, no = [*node.branches, [], []][:2]
            if node.test is None:
                return "(?:)"
            if isinstance(node.test, Group):
                test = node.test.head + self._branches(node.test.branches, scopes, within) + ")"
                opposite = {"(?=": "(?!", "(?!": "(?=", "(?<=": "(?<!", "(?<!": "(?<="}[node.test.head]
                negated = opposite + self._branches(node.test.branches, [{}, *scopes], within) + ")"
            else:
                mark = self._fill("mark", self._number(node.test), [])
                test, negated = mark, f"(?!{mark})"
            return f"(?:{test}{self._sequence(yes, scopes, within)}|{negated}{self._sequence(no, scopes, within)})"
        if node.number is None:
            return node.head + self._branches(node.branches, scopes, within) + ")"
        self.written += 1
        if scopes:
            scopes[0][node.number] = self.written
        else:
            self.set_.setdefault(node.number, []).append(self.written)
        inner = "(" + self._branches(node.branches, scopes, (*within, node.number)) + ")"
        if node.number in self.asked and not scopes:
            self.written += 1
            self.marks.setdefault(node.number, []).append(self.written)
            return f"(?:{inner}())"
        return inner


# ---------------------------------------------------------------- for Spark


@dataclass(frozen=True)
class Translation:
    """``java``: for Spark; ``keeps``: the groups, at most one of which is set, whose length moves the start of a match."""

    java: str
    keeps: tuple[int, ...]


def _compiled(java: str, pattern: str) -> str:
    """Compiled once on the driver, where a session runs, so that a bad pattern is an error here and not in tasks."""
    context = SparkContext._active_spark_context
    if context is not None:
        try:
            context._jvm.java.util.regex.Pattern.compile(java)
        except (IllegalArgumentException, Py4JJavaError) as e:
            said = re.sub(r"(?s)\n.*", "", str(e))
            at = re.search(r" near index (\d+)", said)
            place = max(0, int(at[1]) - java.index(")") - 1) if at else 0
            raise UnsupportedPattern(f"syntax error in the pattern {pattern!r} at offset {place}: {said[: at.start()] if at else said}") from None
    return java


def translated(pattern: str, case_sensitive: bool = False) -> Translation:
    """The pattern for Spark: ``.`` and ``$`` know only the newline, and letters match in either case unless asked."""
    parser = _Parser(pattern)
    writer = _Writer(parser, parser.whole())
    return Translation(_compiled(("(?d)" if case_sensitive else "(?id)") + writer.java, pattern), tuple(writer.keeps))


def java_pattern(pattern: str, case_sensitive: bool = False) -> str:
    return translated(pattern, case_sensitive).java
