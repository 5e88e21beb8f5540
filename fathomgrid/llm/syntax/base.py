"""Tokens, and a parser with precedence climbing and panic-mode recovery, for all languages."""

from __future__ import annotations

import re
from collections.abc import Callable

OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, {")": "(", "]": "[", "}": "{"}


class Fault(Exception):
    """A syntax error at a line."""

    def __init__(self, line: int, cause: str):
        super().__init__(cause)
        self.line, self.cause = line, cause


class Tokens:
    """Kinds: id, num, str, op, nl, end and those of single languages. space: white space stands before; fresh: a line end does."""

    def __init__(self) -> None:
        self.kind: list[str] = []
        self.text: list[str] = []
        self.line: list[int] = []
        self.space: list[bool] = []
        self.fresh: list[bool] = []
        self.faults: list[Fault] = []

    def add(self, kind: str, text: str, line: int, space: bool = False, fresh: bool = False) -> None:
        self.kind.append(kind)
        self.text.append(text)
        self.line.append(line)
        self.space.append(space)
        self.fresh.append(fresh)


class Lexer:
    """One compiled pattern per language; what a pattern can't express is read by a handler from the place of its group."""

    pattern: re.Pattern
    #: Groups that become tokens as they are.
    plain = frozenset(("id", "num", "str", "op"))

    def __init__(self, text: str):
        self.s, self.at, self.line, self.out = text, 0, 1, Tokens()
        self.space = self.fresh = False

    def fault(self, cause: str) -> None:
        self.out.faults.append(Fault(self.line, cause))

    def emit(self, kind: str, text: str) -> None:
        self.out.add(kind, text, self.line, self.space, self.fresh)
        self.space = self.fresh = False

    def newline(self) -> None:
        """A line end outside of strings and comments."""

    def run(self) -> Tokens:
        s, n, match, plain = self.s, len(self.s), self.pattern.match, self.plain
        own = type(self).emit is not Lexer.emit
        out = self.out
        kinds, texts, lines_of, spaces, freshs = out.kind.append, out.text.append, out.line.append, out.space.append, out.fresh.append
        while self.at < n:
            at = self.at
            if s[at] == " ":
                self.space = True
                at += 1
                while at < n and s[at] == " ":
                    at += 1
                self.at = at
                if at == n:
                    break
            m = match(s, at)
            if m is None:
                self.fault(f"stray character {s[at]!r}")
                self.at += 1
                continue
            group = m.lastgroup
            if group in plain:
                text = m.group()
                if own:
                    self.emit(group, text)
                else:
                    kinds(group)
                    texts(text)
                    lines_of(self.line)
                    spaces(self.space)
                    freshs(self.fresh)
                    self.space = self.fresh = False
                self.at = at = m.end()
                if group == "str":
                    self.line += text.count("\n")
                elif group == "num" and at < n and (s[at].isalnum() or s[at] == "_"):
                    self.fault("invalid number")
            elif group == "ws":
                self.space = True
                self.at = m.end()
            elif group == "nl":
                self.newline()
                self.line += 1
                self.fresh = self.space = True
                self.at = m.end()
            elif group == "comment":
                text = m.group()
                self.at = m.end()
                lines = text.count("\n")
                if lines:
                    self.newline()
                    self.line += lines
                    self.fresh = True
                self.space = True
            else:
                getattr(self, "on_" + group)(m)
        self.finish()
        return self.out

    def finish(self) -> None:
        self.out.add("end", "", self.line, True, True)

    def on_open_comment(self, m: re.Match) -> None:
        self.fault("comment never closed")
        self.at = len(self.s)

    def on_open_string(self, m: re.Match) -> None:
        self.fault("string never closed")
        end = self.s.find("\n", self.at)
        self.emit("str", "")
        self.at = len(self.s) if end < 0 else end


class Parser:
    """Statements by recursive descent, expressions by precedence climbing. A fault is stored and parsing goes on behind the next place where a statement may begin."""

    #: Binary operators: (strength, whether it binds to the right).
    binary: dict[str, tuple[int, bool]] = {}
    prefix: frozenset[str] = frozenset()
    #: Texts that end a skipped statement.
    sync = frozenset((";", "}"))

    def __init__(self, tokens: Tokens):
        self.tokens = tokens
        self.k, self.t, self.line_of, self.space, self.fresh = tokens.kind, tokens.text, tokens.line, tokens.space, tokens.fresh
        #: Texts of operators and words; of all else nothing, so that no string is taken for one.
        self.w = [t if k == "op" or k == "id" else "" for k, t in zip(self.k, self.t)]
        self.i = 0
        self.errors: list[Fault] = list(tokens.faults)
        self.pair: dict[int, int] = {}
        stack: list[int] = []
        for i, (k, t) in enumerate(zip(self.k, self.t)):
            if k == "op":
                if t in OPEN:
                    stack.append(i)
                elif t in CLOSE and stack and self.t[stack[-1]] == CLOSE[t]:
                    self.pair[stack.pop()] = i

    # reading

    def is_(self, *texts: str) -> bool:
        return self.w[self.i] in texts

    def peek(self, n: int = 1) -> str:
        return self.w[min(self.i + n, len(self.w) - 1)]

    def accept(self, *texts: str) -> bool:
        if self.w[self.i] in texts:
            self.i += 1
            return True
        return False

    def expect(self, text: str) -> None:
        if not self.accept(text):
            self.fail(f"expected {text!r}")

    def kind(self, *kinds: str) -> bool:
        return self.k[self.i] in kinds

    def fail(self, cause: str) -> None:
        found = self.t[self.i][:20] if self.k[self.i] != "end" else "end of file"
        raise Fault(self.line_of[self.i], f"{cause}, found {found!r}")

    def attempt(self, rule: Callable[[], object]) -> bool:
        """Whether a rule fits here; where it doesn't, nothing is read."""
        start = self.i
        try:
            rule()
            return True
        except Fault:
            self.i = start
            return False

    def name(self) -> str:
        if self.k[self.i] != "id" or self.t[self.i] in self.reserved:
            self.fail("expected a name")
        self.i += 1
        return self.t[self.i - 1]

    reserved: frozenset[str] = frozenset()

    def commas(self, rule: Callable[[], object], close: str, trailing: bool = True) -> None:
        """rule {',' rule} [','] up to and with `close`."""
        while not self.accept(close):
            rule()
            if not self.accept(","):
                self.expect(close)
                return
            if not trailing and self.is_(close):
                self.fail("expected another item")

    # recovery

    def program(self) -> list[Fault]:
        while not self.kind("end"):
            self.guarded(self.statement)
        return self.errors

    def guarded(self, rule: Callable[[], object]) -> None:
        start = self.i
        try:
            rule()
        except Fault as fault:
            self.errors.append(fault)
            self.recover(start)

    def recover(self, start: int) -> None:
        """Skip to behind the next place where a statement may begin."""
        self.i = max(self.i, start)
        moved = self.i > start
        while not self.kind("end"):
            if self.is_("{", "(", "[") and self.i in self.pair:
                self.i = self.pair[self.i] + 1
                moved = True
                continue
            stop = self.is_(*self.sync)
            self.i += 1
            if stop:
                return
            if self.fresh[self.i] and moved:
                return
            moved = True

    def block_until(self, close: str) -> None:
        """Statements up to and with `close`, each guarded."""
        while not self.is_(close):
            if self.kind("end"):
                self.fail(f"expected {close!r}")
            self.guarded(self.statement)
        self.i += 1

    def statement(self) -> None:
        raise NotImplementedError

    # expressions

    def expression(self, least: int = 0) -> None:
        self.unary()
        while True:
            op = self.operator()
            if op is None:
                return
            power, right = self.binary[op]
            if power < least:
                return
            self.take_operator(op)
            self.operand(op, power if right else power + 1)

    def operator(self) -> str | None:
        """The binary operator here, if any."""
        t = self.w[self.i]
        return t if t in self.binary else None

    def take_operator(self, op: str) -> None:
        self.i += 1

    def operand(self, op: str, least: int) -> None:
        self.expression(least)

    def unary(self) -> None:
        while self.is_(*self.prefix):
            self.i += 1
        self.postfix()

    def postfix(self) -> None:
        raise NotImplementedError


def levels(*rows: str, right: str = "") -> dict[str, tuple[int, bool]]:
    """Operators by rising strength, one row per strength; those in `right` bind to the right."""
    r = right.split()
    return {op: (i, op in r) for i, row in enumerate(rows, 1) for op in row.split()}
