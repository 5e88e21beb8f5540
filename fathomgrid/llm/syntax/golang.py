"""Go."""

from __future__ import annotations

import re

from fathomgrid.llm.syntax.base import Lexer, Parser, levels

KEYWORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
_ENDS = frozenset(("break", "continue", "fallthrough", "return"))


class GoLexer(Lexer):
    pattern = re.compile(
        r"(?P<ws>[ \t\r\f]+)|(?P<nl>\n)|(?P<comment>//[^\n]*|/\*(?s:.*?)\*/)|(?P<open_comment>/\*)"
        r"|(?P<str>\"(?:[^\\\"\n]|\\.)*\"|`[^`]*`|'(?:[^\\'\n]|\\(?:[0-7]{3}|x[\da-fA-F]{2}|u[\da-fA-F]{4}|U[\da-fA-F]{8}|.))')|(?P<open_raw>`)|(?P<open_string>[\"'])"
        r"|(?P<num>(?:0[xX][\da-fA-F_]*(?:\.[\da-fA-F_]*)?(?:[pP][+-]?\d+)?|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*(?:\.(?!\.)[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?)i?)"
        r"|(?P<id>[^\W\d]\w*)|(?P<op>&\^=|<<=|>>=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^|[-+*/%&|^<>=!()\[\]{},;.:~])"
    )

    def on_open_raw(self, m: re.Match) -> None:
        self.fault("string never closed")
        self.at = len(self.s)

    def newline(self) -> None:
        """A line that ends with an operand or a closing bracket ends a statement."""
        if self.out.kind:
            k, t = self.out.kind[-1], self.out.text[-1]
            if k in ("str", "num") or k == "id" and (t not in KEYWORDS or t in _ENDS) or k == "op" and t in (")", "]", "}", "++", "--"):
                self.out.add("op", ";", self.line, True, False)

    def finish(self) -> None:
        self.newline()
        super().finish()


class GoParser(Parser):
    reserved = KEYWORDS
    binary = levels("||", "&&", "== != < <= > >=", "+ - | ^", "* / % << >> & &^")
    prefix = frozenset("+ - ! ^ * & <-".split())
    ASSIGN = frozenset("= := += -= *= /= %= &= |= ^= <<= >>= &^=".split())
    no_literal = False

    def program(self):
        def head() -> None:
            self.expect("package")
            self.name()
            self.end()

        if not self.kind("end"):
            self.guarded(head)
        declared = False
        while not self.kind("end"):
            if self.accept(";"):
                continue
            if self.is_("import"):
                if declared:
                    self.guarded(lambda: self.fail("imports must come first"))
                    continue
                self.guarded(self.imports)
            else:
                declared = True
                self.guarded(self.top)
        return self.errors

    def end(self) -> None:
        if not (self.accept(";") or self.is_("}", ")") or self.kind("end")):
            self.fail("expected the end of the statement")

    def group(self, one) -> None:
        """One of a kind, or several in brackets."""
        self.i += 1
        if self.accept("("):
            while not self.accept(")"):
                one()
                self.end()
        else:
            one()
        self.end()

    def imports(self) -> None:
        def one() -> None:
            if self.kind("id") or self.is_("."):
                self.i += 1
            if not self.kind("str"):
                self.fail("expected a path")
            self.i += 1

        self.group(one)

    def top(self) -> None:
        if self.is_("func"):
            self.i += 1
            if self.accept("("):
                self.parameters()
            self.name()
            self.type_parameters()
            self.signature()
            if self.accept("{"):
                self.body()
            return self.end()
        if not self.is_("var", "const", "type"):
            self.fail("expected a declaration")
        return self.declaration()

    def body(self) -> None:
        before, self.no_literal = self.no_literal, False
        self.block_until("}")
        self.no_literal = before

    def declaration(self) -> None:
        def variable() -> None:
            self.names()
            if not self.is_("=", ";", ")") and not self.kind("end"):
                self.type()
            if self.accept("="):
                self.expressions()

        def kind() -> None:
            self.name()
            if self.is_("[") and self.peek() != "]" and self.attempt(self.type_parameters):
                pass
            self.accept("=")
            self.type()

        self.group(kind if self.is_("type") else variable)

    def names(self) -> None:
        self.name()
        while self.accept(","):
            self.name()

    def type_parameters(self) -> None:
        def one() -> None:
            self.names()
            self.constraint()

        if self.accept("["):
            if self.kind("num"):
                self.fail("expected a name")
            self.commas(one, "]")

    def constraint(self) -> None:
        self.accept("~")
        self.type()
        while self.accept("|"):
            self.accept("~")
            self.type()

    def signature(self) -> None:
        self.expect("(")
        self.parameters()
        if self.accept("("):
            self.parameters()
        elif self.type_starts():
            self.type()

    def parameters(self) -> None:
        def one() -> None:
            if self.accept("..."):
                return self.type()
            self.type()
            if not self.is_(",", ")"):
                self.accept("...")
                self.type()

        self.commas(one, ")")

    def type_starts(self) -> bool:
        return self.kind("id") and (self.t[self.i] not in KEYWORDS or self.is_("map", "chan", "func", "struct", "interface")) or self.is_("*", "[", "(", "<-")

    def type(self) -> None:
        if self.accept("*"):
            self.type()
        elif self.accept("("):
            self.type()
            self.expect(")")
        elif self.accept("["):
            if not self.accept("]"):
                if not self.accept("..."):
                    self.free(self.expression)
                self.expect("]")
            self.type()
        elif self.accept("map"):
            self.expect("[")
            self.type()
            self.expect("]")
            self.type()
        elif self.accept("<-"):
            self.expect("chan")
            self.type()
        elif self.accept("chan"):
            self.accept("<-")
            self.type()
        elif self.accept("func"):
            self.signature()
        elif self.accept("struct"):
            self.expect("{")
            while not self.accept("}"):
                self.field()
                self.end()
        elif self.accept("interface"):
            self.expect("{")
            while not self.accept("}"):
                if self.kind("id") and self.peek() == "(":
                    self.i += 1
                    self.signature()
                else:
                    self.constraint()
                self.end()
        else:
            self.name()
            if self.accept("."):
                self.name()
            if self.is_("[") and self.peek() != "]" and not self.space[self.i]:
                self.attempt(self.type_arguments)

    def type_arguments(self) -> None:
        self.expect("[")
        if self.is_("]"):
            self.fail("expected a type")
        self.commas(self.type, "]")

    def field(self) -> None:
        if self.is_("*") or self.kind("id") and (self.peek() in (".", ";", "}") or self.k[self.i + 1] == "str"):
            self.accept("*")
            self.type()
        else:
            self.names()
            self.type()
        if self.kind("str"):
            self.i += 1

    # statements

    def statement(self) -> None:
        if self.accept(";"):
            return
        if self.accept("{"):
            self.body()
            return self.end()
        rule = getattr(self, "s_" + self.t[self.i], None) if self.kind("id") else None
        if rule:
            rule()
        elif self.is_("var", "const", "type"):
            return self.declaration()
        elif self.kind("id") and self.peek() == ":" and self.t[self.i] not in KEYWORDS:
            self.i += 2
            return None if self.is_("}") else self.statement()
        else:
            self.simple()
        return self.end()

    def simple(self) -> None:
        self.expressions()
        if self.accept("++", "--"):
            return
        if self.accept("<-"):
            return self.expression()
        if self.is_(*self.ASSIGN):
            self.i += 1
            if self.accept("range"):
                return self.expression()
            self.expressions()

    def expressions(self) -> None:
        self.expression()
        while self.accept(","):
            self.expression()

    def free(self, rule) -> None:
        before, self.no_literal = self.no_literal, False
        rule()
        self.no_literal = before

    def header(self) -> None:
        """[simple ;] [simple], where '{' begins the block."""
        self.no_literal = True
        if not self.is_("{", ";"):
            self.simple()
        if self.accept(";") and not self.is_("{"):
            self.simple()
        self.no_literal = False

    def s_if(self) -> None:
        self.i += 1
        if self.is_("{"):
            self.fail("expected a condition")
        self.header()
        self.expect("{")
        self.body()
        if self.accept("else"):
            if self.is_("if"):
                return self.s_if()
            self.expect("{")
            self.body()

    def s_for(self) -> None:
        self.i += 1
        self.no_literal = True
        if self.accept("range"):
            self.expression()
        elif not self.is_("{"):
            if not self.is_(";"):
                self.simple()
            if self.accept(";"):
                if not self.is_(";"):
                    self.expression()
                self.expect(";")
                if not self.is_("{"):
                    self.simple()
        self.no_literal = False
        self.expect("{")
        self.body()

    def cases(self, rule) -> None:
        self.expect("{")
        while not self.accept("}"):
            if self.accept("case"):
                rule()
            else:
                self.expect("default")
            self.expect(":")
            while not self.is_("case", "default", "}"):
                if self.kind("end"):
                    self.fail("expected '}'")
                self.guarded(self.statement)

    def s_switch(self) -> None:
        self.i += 1
        self.header()

        def one() -> None:
            self.type_or_expression()
            while self.accept(","):
                self.type_or_expression()

        self.free(lambda: self.cases(one))

    def type_or_expression(self) -> None:
        start = self.i
        if self.attempt(self.expression) and self.is_(",", ":"):
            return
        self.i = start
        self.type()

    def s_select(self) -> None:
        self.i += 1
        self.free(lambda: self.cases(self.simple))

    def s_return(self) -> None:
        self.i += 1
        if not self.is_(";", "}"):
            self.expressions()

    def jump(self) -> None:
        self.i += 1
        if self.kind("id") and self.t[self.i] not in KEYWORDS:
            self.i += 1

    def s_break(self) -> None:
        self.jump()

    def s_continue(self) -> None:
        self.jump()

    def s_fallthrough(self) -> None:
        self.jump()

    def s_goto(self) -> None:
        self.i += 1
        self.name()

    def s_go(self) -> None:
        self.i += 1
        self.expression()
        if self.t[self.i - 1] != ")":
            self.fail("expected a call")

    def s_defer(self) -> None:
        self.s_go()

    # expressions

    def postfix(self) -> None:
        literal = False
        if self.kind("num", "str"):
            self.i += 1
        elif self.accept("("):
            self.free(self.type_or_expression_in)
            self.expect(")")
        elif self.is_("func"):
            self.i += 1
            self.signature()
            if self.accept("{"):
                self.body()
        elif self.is_("[", "map", "chan", "struct", "interface"):
            self.type()
            literal = True
        elif self.kind("id") and self.t[self.i] not in KEYWORDS:
            self.i += 1
            literal = not self.no_literal
        else:
            self.fail("expected an expression")
        while True:
            if self.accept("."):
                if self.accept("("):
                    if not self.accept("type"):
                        self.type()
                    self.expect(")")
                else:
                    self.name()
            elif self.accept("("):

                def one() -> None:
                    self.type_or_expression_in()
                    self.accept("...")

                self.free(lambda: self.commas(one, ")"))
                literal = False
            elif self.is_("["):
                self.free(self.index)
            elif self.is_("{") and literal:
                self.literal()
                literal = False
            else:
                return

    def type_or_expression_in(self) -> None:
        start = self.i
        if self.attempt(self.expression) and self.is_(",", ")", "...", "]"):
            return
        self.i = start
        if self.is_("[", "map", "chan", "func", "struct", "interface", "*"):
            self.type()
        else:
            self.expression()

    def index(self) -> None:
        self.expect("[")
        if self.is_("]"):
            self.fail("expected an index")
        if not self.is_(":"):
            self.type_or_expression_in()
        while self.accept(",") and not self.is_("]"):
            self.type()
        for _ in range(2):
            if self.accept(":") and not self.is_("]", ":"):
                self.expression()
        self.expect("]")

    def literal(self) -> None:
        self.expect("{")

        def value() -> None:
            self.literal() if self.is_("{") else self.expression()

        def one() -> None:
            value()
            if self.accept(":"):
                value()

        self.free(lambda: self.commas(one, "}"))
