"""Python."""

from __future__ import annotations

import re

from fathomgrid.llm.syntax.base import Fault, Lexer, Parser, levels

KEYWORDS = frozenset("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split())
_NUMBER = r"0[xX](?:_?[\da-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:(?:\d(?:_?\d)*)?\.\d(?:_?\d)*|\d(?:_?\d)*\.?)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?"


class PythonLexer(Lexer):
    pattern = re.compile(
        r"(?P<ws>[ \t\f]+|\\\r?\n)|(?P<comment>#[^\r\n]*)|(?P<nl>\r\n|\n|\r)"
        r"|(?P<format>(?:[fFtT][rR]?|[rR][fFtT])(?:\"\"\"|'''|\"|'))"
        r"|(?P<str>(?:[rR][bBfFtT]?|[bBfFtT][rR]?|[uU])?(?:\"\"\"(?:[^\\\"]|\\(?s:.)|\"(?!\"\"))*\"\"\"|'''(?:[^\\']|\\(?s:.)|'(?!''))*'''|\"(?!\"\")(?:[^\\\"\r\n]|\\(?s:.))*\"|'(?!'')(?:[^\\'\r\n]|\\(?s:.))*'))"
        r"|(?P<open_long>(?:[rR][bBfFtT]?|[bBfFtT][rR]?|[uU])?(?:\"\"\"|'''))|(?P<open_string>(?:[rR][bBfFtT]?|[bBfFtT][rR]?|[uU])?[\"'])"
        r"|(?P<num>" + _NUMBER + r")|(?P<id>[^\W\d]\w*)|(?P<op>\*\*=?|//=?|>>=?|<<=?|\.\.\.|!=|->|:=|[-+*/%@&|^<>=]=|[-+*/%@&|^~<>()\[\]{},:;.=])"
    )

    def __init__(self, text: str):
        super().__init__(text)
        self.depth, self.indents, self.begun = 0, [0], False

    def on_format(self, m: re.Match) -> None:
        end = self.format_end(m.end(), re.sub("[^\"']", "", m.group()))
        if end < 0:
            self.fault("string never closed")
            end = len(self.s)
        text = self.s[self.at : end]
        self.emit("str", text)
        self.line += text.count("\n")
        self.at = end

    def format_end(self, at: int, quote: str) -> int:
        """The place behind a formatted string, whose fields may hold strings with the same quotes; -1 if it isn't closed."""
        s, n, one = self.s, len(self.s), len(quote) == 1
        while at < n:
            c = s[at]
            if s.startswith(quote, at):
                return at + len(quote)
            if c == "\\":
                at += 2
            elif c in "\r\n" and one:
                return -1
            elif c == "{" and not s.startswith("{{", at):
                depth, at = 1, at + 1
                while at < n and depth:
                    c = s[at]
                    if c in "\"'":
                        inner = c * 3 if s.startswith(c * 3, at) and c * 3 != quote else c
                        if one and inner == quote and self.format_end(at + 1, inner) < 0:
                            return at + 1  # the field is broken; the string ends here
                        at = self.format_end(at + len(inner), inner)
                        if at < 0:
                            return -1
                        continue
                    if c in "\r\n" and one:
                        return -1
                    depth += (c in "{[(") - (c in "}])")
                    at += 1
            else:
                at += 2 if s.startswith("{{", at) else 1
        return -1

    def on_open_long(self, m: re.Match) -> None:
        self.fault("string never closed")
        self.at = len(self.s)

    def emit(self, kind: str, text: str) -> None:
        if not self.begun and not self.depth:
            self.begun = True
            start = self.s.rfind("\n", 0, self.at) + 1
            lead = self.s[start : self.at]
            width = len(lead.expandtabs(8)) if lead.isspace() else 0
            if width > self.indents[-1]:
                self.indents.append(width)
                self.out.add("indent", "", self.line)
            while width < self.indents[-1]:
                self.indents.pop()
                self.out.add("dedent", "", self.line)
            if width != self.indents[-1]:
                self.fault("unindent fits no outer level")
                self.indents.append(width)
        if kind == "op":
            self.depth += (text in "([{") - (text in ")]}")
            self.depth = max(0, self.depth)
        super().emit(kind, text)

    def newline(self) -> None:
        if self.begun and not self.depth:
            self.out.add("nl", "", self.line)
            self.begun = False

    def finish(self) -> None:
        if self.begun:
            self.out.add("nl", "", self.line)
        for _ in self.indents[1:]:
            self.out.add("dedent", "", self.line)
        super().finish()


class PythonParser(Parser):
    reserved = KEYWORDS
    binary = levels("or", "and", "not-in in is is-not < > == >= <= !=", "|", "^", "&", "<< >>", "+ -", "* / // % @")
    AUGMENTED = frozenset("+= -= *= /= //= %= @= &= |= ^= >>= <<= **=".split())

    def recover(self, start: int) -> None:
        self.i = max(self.i, start)
        while not self.kind("nl", "end"):
            self.i += 1
        if self.kind("nl"):
            self.i += 1
        depth = 0
        while self.kind("indent") or depth and not self.kind("end"):
            depth += self.kind("indent") - self.kind("dedent")
            self.i += 1
        if self.i == start and not self.kind("end"):
            self.i += 1

    def statement(self) -> None:
        t = self.t[self.i] if self.kind("id", "op") else ""
        rule = getattr(self, f"s_{t}", None) if self.kind("id") else None
        if self.kind("indent"):
            self.fail("unexpected indent")
        if self.kind("dedent"):
            self.fail("unexpected unindent")
        if t == "@":
            while self.accept("@"):
                self.named()
                self.line_end()
            if not self.is_("def", "class", "async"):
                self.fail("expected a definition")
            return self.statement()
        if t == "match" and self.attempt(self.s_match_head):
            return self.cases()
        if t == "async":
            self.i += 1
            if not self.is_("def", "for", "with"):
                self.fail("expected def, for or with")
            return self.statement()
        if rule and t in ("if", "while", "for", "try", "with", "def", "class"):
            return rule()
        self.simple()
        while self.accept(";"):
            if self.kind("nl"):
                break
            self.simple()
        self.line_end()

    def line_end(self) -> None:
        if not self.kind("nl"):
            self.fail("expected the end of the line")
        self.i += 1

    def suite(self) -> None:
        self.expect(":")
        if not self.kind("nl"):
            self.simple()
            while self.accept(";") and not self.kind("nl"):
                self.simple()
            return self.line_end()
        self.i += 1
        if not self.kind("indent"):
            self.fail("expected an indented block")
        self.i += 1
        while not self.kind("dedent", "end"):
            self.guarded(self.statement)
        if self.kind("dedent"):
            self.i += 1

    def s_if(self) -> None:
        self.i += 1
        self.named()
        self.suite()
        if self.is_("elif"):
            return self.s_if()
        if self.accept("else"):
            self.suite()

    def s_while(self) -> None:
        self.i += 1
        self.named()
        self.suite()
        if self.accept("else"):
            self.suite()

    def s_for(self) -> None:
        self.i += 1
        start = self.i
        self.targets()
        self.target_at(start)
        self.expect("in")
        self.stars()
        self.suite()
        if self.accept("else"):
            self.suite()

    def s_try(self) -> None:
        self.i += 1
        self.suite()
        some = bare = False
        while self.is_("except"):
            if bare:
                self.fail("default except must be last")
            some = True
            self.i += 1
            self.accept("*")
            if self.is_(":"):
                bare = True
            else:
                self.test()
                while self.accept(","):
                    self.test()
                if self.accept("as"):
                    self.name()
            self.suite()
        if some and self.accept("else"):
            self.suite()
        if self.accept("finally"):
            return self.suite()
        if not some:
            self.fail("expected except or finally")

    def s_with(self) -> None:
        self.i += 1

        def item() -> None:
            self.test()
            if self.accept("as"):
                start = self.i
                self.expression(4)
                self.target_at(start)

        def several() -> None:
            self.expect("(")
            self.commas(item, ")")
            if not self.is_(":"):
                self.fail("expected ':'")

        if not (self.is_("(") and self.attempt(several)):
            item()
            while self.accept(","):
                item()
        self.suite()

    def s_def(self) -> None:
        self.i += 1
        self.name()
        self.type_parameters()
        self.expect("(")
        self.parameters(")", True)
        if self.accept("->"):
            self.stars()
        self.suite()

    def type_parameters(self) -> None:
        def one() -> None:
            self.accept("*") or self.accept("**")
            self.name()
            if self.accept(":"):
                self.test()
            if self.accept("="):
                self.test()

        if self.accept("["):
            self.commas(one, "]")

    def parameters(self, close: str, typed: bool) -> None:
        """Parameters up to and with `close`."""
        default = star = False
        while not self.accept(close):
            if self.accept("**"):
                self.name()
                if typed and self.accept(":"):
                    self.test()
                self.accept(",")
                return self.expect(close)
            if self.accept("*"):
                star = True
                if not self.is_(","):
                    self.name()
                    if typed and self.accept(":"):
                        self.accept("*")
                        self.test()
                elif self.peek() == close:
                    self.fail("expected a named parameter")
            elif not self.accept("/"):
                self.name()
                if typed and self.accept(":"):
                    self.test()
                if self.accept("="):
                    self.test()
                    default = True
                elif default and not star:
                    self.fail("parameter without a default follows one with it")
            if not self.accept(","):
                return self.expect(close)

    def s_class(self) -> None:
        self.i += 1
        self.name()
        self.type_parameters()
        if self.accept("("):
            self.arguments()
        self.suite()

    def s_match_head(self) -> None:
        self.i += 1
        self.stars()
        self.expect(":")
        if not self.kind("nl") or self.k[self.i + 1] != "indent" or self.t[self.i + 2] != "case":
            self.fail("expected cases")
        self.i += 2

    def cases(self) -> None:
        while not self.kind("dedent", "end"):
            self.expect("case")
            depth = 0
            while not (self.is_(":") and not depth):
                if self.kind("nl", "end"):
                    self.fail("expected ':'")
                if self.is_("if") and not depth:
                    self.i += 1
                    self.named()
                    break
                depth += self.is_("(", "[", "{") - self.is_(")", "]", "}")
                self.i += 1
            self.suite()
        if self.kind("dedent"):
            self.i += 1

    def simple(self) -> None:
        t = self.t[self.i] if self.kind("id") else ""
        if t in ("pass", "break", "continue"):
            self.i += 1
        elif t == "return":
            self.i += 1
            if not self.kind("nl") and not self.is_(";"):
                self.stars()
        elif t == "raise":
            self.i += 1
            if not self.kind("nl") and not self.is_(";"):
                self.test()
                if self.accept("from"):
                    self.test()
        elif t in ("global", "nonlocal"):
            self.i += 1
            self.name()
            while self.accept(","):
                self.name()
        elif t == "del":
            self.i += 1
            self.targets()
        elif t == "assert":
            self.i += 1
            self.test()
            if self.accept(","):
                self.test()
        elif t == "import":
            self.i += 1
            self.module()
            while self.accept(","):
                self.module()
        elif t == "from":
            self.s_from()
        elif t == "type" and self.k[self.i + 1] == "id" and self.t[self.i + 1] not in KEYWORDS:
            self.i += 1
            self.name()
            self.type_parameters()
            self.expect("=")
            self.test()
        else:
            self.assignment()

    def dotted(self) -> None:
        self.name()
        while self.accept("."):
            self.name()

    def module(self) -> None:
        self.dotted()
        if self.accept("as"):
            self.name()

    def s_from(self) -> None:
        self.i += 1
        dots = False
        while self.accept(".", "..."):
            dots = True
        if not (dots and self.is_("import")):
            self.dotted()
        self.expect("import")
        if self.accept("*"):
            return

        def one() -> None:
            self.name()
            if self.accept("as"):
                self.name()

        if self.accept("("):
            if self.is_(")"):
                self.fail("expected a name")
            return self.commas(one, ")")
        one()
        while self.accept(","):
            one()

    def assignment(self) -> None:
        start = self.i
        self.stars()
        if self.is_(":"):
            self.target_at(start)
            self.i += 1
            self.test()
            if self.accept("="):
                self.stars()
        elif self.is_(*self.AUGMENTED):
            self.target_at(start)
            self.i += 1
            self.stars()
        else:
            while self.is_("="):
                self.target_at(start)
                self.i += 1
                start = self.i
                self.stars()

    def target_at(self, start: int) -> None:
        """Whether what was read from `start` on can be assigned to: names, members, and sequences of them."""
        depth, last, call = 0, "", False
        for j in range(start, self.i):
            k, t = self.k[j], self.t[j]
            if k == "op" and t in "([{":
                if not depth:
                    call = t == "(" and last in ("operand", "close") or t == "{"
                depth += 1
            elif k == "op" and t in ")]}":
                depth -= 1
                last = "close" if not depth else last
                if not depth:
                    last = "call" if call else "close"
            elif not depth:
                if k in ("num", "str") or k == "op" and t not in (".", ",", "*") or k == "id" and t in KEYWORDS:
                    raise Fault(self.line_of[j], "cannot assign to this")
                if last == "call" and k == "op" and t == ",":
                    raise Fault(self.line_of[j], "cannot assign to a call")
                last = "operand" if k == "id" else t
            if depth and last == "call":
                last = ""
        if last == "call":
            raise Fault(self.line_of[start], "cannot assign to a call")

    def stars(self) -> None:
        """Expressions with commas, starred or not; a lone yield."""
        if self.is_("yield"):
            return self.s_yield()
        self.star()
        while self.accept(","):
            if self.starts():
                self.star()
            else:
                return

    def starts(self) -> bool:
        return self.kind("num", "str") or (self.kind("id") and (self.t[self.i] not in KEYWORDS or self.is_("not", "lambda", "await", "None", "True", "False"))) or self.is_("(", "[", "{", "-", "+", "~", "...", "*")

    def star(self) -> None:
        if self.accept("*"):
            return self.expression(4)
        self.named()

    def targets(self) -> None:
        while True:
            self.accept("*")
            self.expression(4)
            if not self.accept(",") or not self.starts():
                return

    def s_yield(self) -> None:
        self.i += 1
        if self.accept("from"):
            return self.test()
        if self.starts():
            self.stars()

    def named(self) -> None:
        if self.kind("id") and self.peek() == ":=" and self.t[self.i] not in KEYWORDS:
            self.i += 2
        self.test()

    def test(self) -> None:
        if self.accept("lambda"):
            self.parameters(":", False)
            return self.test()
        self.expression(1)
        if self.accept("if"):
            self.expression(1)
            self.expect("else")
            self.test()

    def operator(self) -> str | None:
        if self.is_("not") and self.peek() == "in":
            return "not-in"
        if self.is_("is") and self.peek() == "not":
            return "is-not"
        return super().operator()

    def take_operator(self, op: str) -> None:
        self.i += 1 + ("-" in op and len(op) > 2)

    def expression(self, least: int = 0) -> None:
        if self.is_("not") and least <= 3:
            self.i += 1
            self.expression(3)
            while (op := self.operator()) and self.binary[op][0] >= max(least, 1) and self.binary[op][0] < 3:
                self.take_operator(op)
                self.expression(self.binary[op][0] + 1)
            return
        super().expression(least)

    def unary(self) -> None:
        if self.accept("-", "+", "~"):
            return self.unary()
        self.accept("await")
        self.atom()
        while True:
            if self.accept("."):
                self.name()
            elif self.accept("("):
                self.arguments()
            elif self.accept("["):
                self.subscript()
            else:
                break
        if self.accept("**"):
            self.unary()

    def arguments(self) -> None:
        keyword = double = False
        while not self.accept(")"):
            if self.accept("**"):
                self.test()
                keyword = double = True
            elif self.accept("*"):
                if double:
                    self.fail("iterable argument follows keyword arguments")
                self.test()
            elif self.kind("id") and self.peek() == "=" and self.t[self.i] not in KEYWORDS:
                self.i += 2
                self.test()
                keyword = True
            else:
                start = self.i
                self.named()
                if self.is_("for", "async"):
                    self.comprehension()
                    if not self.is_(")") and not (self.is_(",") and self.peek() == ")") or start and self.t[start - 1] == ",":
                        self.fail("a generator must be in brackets")
                elif keyword:
                    self.fail("positional argument follows keyword argument")
            if not self.accept(","):
                return self.expect(")")

    def subscript(self) -> None:
        def one() -> None:
            if self.accept("*"):
                return self.expression(4)
            if not self.is_(":"):
                self.named()
            for _ in range(2):
                if self.accept(":") and not self.is_(":", "]", ","):
                    self.test()

        if self.is_("]"):
            self.fail("expected an index")
        self.commas(one, "]")

    def comprehension(self) -> None:
        while self.is_("for", "async"):
            self.accept("async")
            self.expect("for")
            start = self.i
            self.targets()
            self.target_at(start)
            self.expect("in")
            self.expression(1)
            while self.accept("if"):
                if self.is_("lambda"):
                    self.test()
                else:
                    self.named_or()

    def named_or(self) -> None:
        if self.kind("id") and self.peek() == ":=":
            self.i += 2
        self.expression(1)

    def atom(self) -> None:
        if self.kind("str"):
            while self.kind("str"):
                self.i += 1
        elif self.kind("num") or self.accept("..."):
            self.i += self.kind("num")
        elif self.accept("("):
            if self.accept(")"):
                return
            if self.is_("yield"):
                self.s_yield()
            else:
                self.star()
                if self.is_("for", "async"):
                    self.comprehension()
                while self.accept(","):
                    if self.is_(")"):
                        break
                    self.star()
            self.expect(")")
        elif self.accept("["):
            if self.accept("]"):
                return
            self.star()
            if self.is_("for", "async"):
                self.comprehension()
                return self.expect("]")
            while self.accept(","):
                if self.is_("]"):
                    break
                self.star()
            self.expect("]")
        elif self.accept("{"):
            self.braces()
        elif self.kind("id") and (self.t[self.i] not in KEYWORDS or self.is_("None", "True", "False")):
            self.i += 1
        else:
            self.fail("expected an expression")

    def braces(self) -> None:
        kind = ""
        while not self.accept("}"):
            if self.accept("**"):
                self.expression(4)
                this = "map"
            elif self.accept("*"):
                self.expression(4)
                this = "set"
            else:
                self.named()
                this = "set"
                if self.accept(":"):
                    self.test()
                    this = "map"
                if self.is_("for", "async") and not kind:
                    self.comprehension()
                    return self.expect("}")
            if kind and kind != this:
                self.fail("a key without a value, or a value without a key")
            kind = this
            if not self.accept(","):
                return self.expect("}")
