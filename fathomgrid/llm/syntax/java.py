"""Java."""

from __future__ import annotations

import re

from fathomgrid.llm.syntax.base import Lexer, Parser, levels

PRIMITIVE = frozenset("boolean byte char short int long float double".split())
MODIFIERS = frozenset("public protected private static final abstract native synchronized transient volatile strictfp default sealed non-sealed".split())
KEYWORDS = PRIMITIVE | frozenset("abstract assert break case catch class const continue default do else enum extends final finally for goto if implements import instanceof interface native new package private protected public return static strictfp super switch synchronized this throw throws transient try void volatile while true false null".split())


class JavaLexer(Lexer):
    pattern = re.compile(
        r"(?P<ws>[ \t\f]+)|(?P<nl>\r\n|\n|\r)|(?P<comment>//[^\r\n]*|/\*(?s:.*?)\*/)|(?P<open_comment>/\*)"
        r"|(?P<str>\"\"\"(?:[^\\\"]|\\(?s:.)|\"(?!\"\"))*\"\"\"|\"(?!\"\")(?:[^\\\"\r\n]|\\.)*\"|'(?:[^\\'\r\n]|\\(?:u+[\da-fA-F]{4}|[0-7]{1,3}|.))')|(?P<open_string>\"|')"
        r"|(?P<num>(?:0[xX][\da-fA-F_]+(?:\.[\da-fA-F_]*)?(?:[pP][+-]?\d+)?|0[bB][01_]+|(?:\d[\d_]*(?:\.(?:\d[\d_]*|(?![\w.])))?|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?)[lLfFdD]?)"
        r"|(?P<id>[A-Za-z_$ª-￿][\w$]*)|(?P<op>>>>=|<<=|>>=|\.\.\.|->|::|\+\+|--|==|!=|<=|>=|&&|\|\||\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|[-+*/%&|^~<>=!?:;,.@(){}\[\]])"
    )


class JavaParser(Parser):
    reserved = KEYWORDS
    binary = levels("||", "&&", "|", "^", "&", "== !=", "< > <= >= instanceof", "<< >> >>>", "+ -", "* / %")
    ASSIGN = frozenset("= += -= *= /= %= &= |= ^= <<= >>= >>>=".split())

    def program(self):
        while not self.kind("end"):
            self.guarded(self.top)
        return self.errors

    def top(self) -> None:
        if self.accept(";"):
            return
        if self.is_("package") or self.is_("@") and self.attempt(lambda: (self.annotations(), self.is_("package") or self.fail("no package"))):
            self.expect("package")
            self.dotted()
            return self.expect(";")
        if self.accept("import"):
            self.accept("static")
            self.name()
            while self.accept("."):
                if self.accept("*"):
                    break
                self.name()
            return self.expect(";")
        self.member()
        return None

    def dotted(self) -> None:
        self.name()
        while self.accept("."):
            self.name()

    def annotations(self) -> None:
        while self.is_("@") and self.peek() != "interface":
            self.i += 1
            self.dotted()
            if self.accept("("):
                def one() -> None:
                    if self.kind("id") and self.peek() == "=":
                        self.i += 2
                    self.element()

                self.commas(one, ")", False)

    def element(self) -> None:
        if self.is_("@"):
            self.annotations()
        elif self.accept("{"):
            self.commas(self.element, "}")
        else:
            self.ternary()

    def modifiers(self) -> None:
        while True:
            if self.is_("@") and self.peek() != "interface":
                self.annotations()
            elif self.is_("non") and self.peek() == "-":
                self.i += 3
            elif self.is_(*MODIFIERS) and not (self.is_("default") and self.peek() in (":", "->")) and not (self.is_("sealed") and self.peek() in ("=", ".", "(")):
                self.i += 1
            else:
                return

    def type_declaration(self) -> bool:
        if self.accept("class"):
            self.name()
            self.type_parameters()
            if self.accept("extends"):
                self.type()
            self.listed("implements")
            self.listed("permits")
            self.members()
        elif self.accept("interface"):
            self.name()
            self.type_parameters()
            self.listed("extends")
            self.listed("permits")
            self.members()
        elif self.is_("@") and self.peek() == "interface":
            self.i += 2
            self.name()
            self.members()
        elif self.is_("enum") and self.k[self.i + 1] == "id":
            self.i += 1
            self.name()
            self.listed("implements")
            self.enum_body()
        elif self.is_("record") and self.k[self.i + 1] == "id" and self.peek(2) in ("(", "<"):
            self.i += 1
            self.name()
            self.type_parameters()
            self.expect("(")
            self.commas(self.parameter, ")", False)
            self.listed("implements")
            self.members()
        else:
            return False
        return True

    def listed(self, word: str) -> None:
        if self.accept(word):
            self.type()
            while self.accept(","):
                self.type()

    def enum_body(self) -> None:
        self.expect("{")
        while not self.is_(";", "}"):
            self.annotations()
            self.name()
            if self.accept("("):
                self.commas(self.expression, ")", False)
            if self.is_("{"):
                self.members()
            if not self.accept(","):
                break
        if self.accept(";"):
            while not self.is_("}"):
                if self.kind("end"):
                    self.fail("expected '}'")
                self.guarded(self.member)
        self.expect("}")

    def members(self) -> None:
        self.expect("{")
        while not self.accept("}"):
            if self.kind("end"):
                self.fail("expected '}'")
            self.guarded(self.member)

    def member(self) -> None:
        if self.accept(";"):
            return
        if self.is_("{") or self.is_("static") and self.peek() == "{":
            self.accept("static")
            return self.block()
        self.modifiers()
        if self.type_declaration():
            return
        self.type_parameters()
        self.annotations()
        if self.kind("id") and self.peek() == "(":
            self.name()
            return self.method()
        if self.kind("id") and self.peek() == "{" and self.t[self.i] not in KEYWORDS:
            self.name()
            return self.block()
        if not self.accept("void"):
            self.type()
        self.name()
        if self.is_("("):
            return self.method()
        self.variables()
        self.expect(";")

    def method(self) -> None:
        self.expect("(")
        self.commas(self.parameter, ")", False)
        self.dimensions()
        self.listed("throws")
        if self.accept("default"):
            self.element()
        if not self.accept(";"):
            self.block()

    def parameter(self) -> None:
        self.modifiers()
        self.type()
        self.annotations()
        self.accept("...")
        if self.accept("this"):
            return
        self.name()
        if self.accept("."):
            self.expect("this")
        self.dimensions()

    def dimensions(self) -> None:
        while self.is_("[") and self.peek() == "]":
            self.i += 2

    def variables(self) -> None:
        while True:
            self.dimensions()
            if self.accept("="):
                self.initializer()
            if not self.accept(","):
                return
            self.name()

    def initializer(self) -> None:
        if self.accept("{"):
            return self.commas(self.initializer, "}")
        self.expression()

    def type_parameters(self) -> None:
        def one() -> None:
            self.annotations()
            self.name()
            if self.accept("extends"):
                self.type()
                while self.accept("&"):
                    self.type()

        if self.accept("<"):
            self.commas(one, ">", False)

    def type(self) -> None:
        self.annotations()
        if self.is_(*PRIMITIVE):
            self.i += 1
        else:
            while True:
                self.annotations()
                self.name()
                if self.is_("<"):
                    self.type_arguments()
                if not (self.is_(".") and self.k[self.i + 1] == "id" and self.peek() not in KEYWORDS):
                    break
                self.i += 1
        self.dimensions()

    def type_arguments(self) -> None:
        self.expect("<")
        if self.accept(">"):
            return

        def one() -> None:
            self.annotations()
            if self.accept("?"):
                if self.accept("extends", "super"):
                    self.type()
            else:
                self.type()

        self.commas(one, ">", False)

    # statements

    def block(self) -> None:
        self.expect("{")
        self.block_until("}")

    def statement(self) -> None:
        if self.is_("{"):
            return self.block()
        if self.accept(";"):
            return None
        if self.kind("id"):
            if self.peek() == ":" and self.t[self.i] not in KEYWORDS:
                self.i += 2
                return self.statement()
            rule = getattr(self, "s_" + self.t[self.i], None)
            if rule and rule() is not False:
                return None
        if self.is_("@", "final", "abstract", "static", "class", "interface", "enum", "strictfp") or self.is_("record") and self.k[self.i + 1] == "id" and self.peek(2) in ("(", "<"):
            self.modifiers()
            if self.type_declaration():
                return None
            self.type()
            self.name()
            self.variables()
            return self.expect(";")
        if self.attempt(self.local):
            self.variables()
            return self.expect(";")
        start = self.i
        self.expression()
        if not self.is_statement(start):
            self.fail("not a statement")
        return self.expect(";")

    def is_statement(self, start: int) -> bool:
        """Assignments, calls, creations and steps."""
        span = range(start, self.i)
        return self.t[self.i - 1] in (")", "++", "--", "}") or self.t[start] in ("++", "--", "new") or any(self.k[j] == "op" and self.t[j] in self.ASSIGN for j in span)

    def local(self) -> None:
        self.type()
        self.name()
        if not self.is_("=", ";", ",", ":", "["):
            self.fail("no declaration")

    def condition(self) -> None:
        self.expect("(")
        self.expression()
        self.expect(")")

    def s_if(self) -> None:
        self.i += 1
        self.condition()
        self.statement()
        if self.accept("else"):
            self.statement()

    def s_while(self) -> None:
        self.i += 1
        self.condition()
        self.statement()

    def s_do(self) -> None:
        self.i += 1
        self.statement()
        self.expect("while")
        self.condition()
        self.expect(";")

    def s_for(self) -> None:
        self.i += 1
        self.expect("(")

        def declared() -> None:
            self.modifiers()
            self.local()

        if not self.is_(";"):
            if self.attempt(declared):
                if self.accept(":"):
                    self.expression()
                    self.expect(")")
                    return self.statement()
                self.variables()
            else:
                self.several()
        self.expect(";")
        if not self.is_(";"):
            self.expression()
        self.expect(";")
        if not self.is_(")"):
            self.several()
        self.expect(")")
        return self.statement()

    def several(self) -> None:
        self.expression()
        while self.accept(","):
            self.expression()

    def s_return(self) -> None:
        self.i += 1
        if not self.is_(";"):
            self.expression()
        self.expect(";")

    def s_throw(self) -> None:
        self.i += 1
        self.expression()
        self.expect(";")

    def s_assert(self) -> None:
        self.i += 1
        self.expression()
        if self.accept(":"):
            self.expression()
        self.expect(";")

    def jump(self) -> None:
        self.i += 1
        if not self.is_(";"):
            self.name()
        self.expect(";")

    def s_break(self) -> None:
        self.jump()

    def s_continue(self) -> None:
        self.jump()

    def s_yield(self) -> bool | None:
        if self.peek() in ("=", ".", "[", "++", "--"):
            return False
        self.i += 1
        self.expression()
        return self.expect(";")

    def s_synchronized(self) -> None:
        self.i += 1
        self.condition()
        self.block()

    def s_try(self) -> None:
        self.i += 1
        some = False
        if self.accept("("):
            some = True

            def resource() -> None:
                self.modifiers()
                if self.attempt(self.local):
                    self.expect("=")
                self.expression()

            while not self.accept(")"):
                resource()
                if not self.is_(")"):
                    self.expect(";")
        self.block()
        while self.accept("catch"):
            some = True
            self.expect("(")
            self.modifiers()
            self.type()
            while self.accept("|"):
                self.type()
            self.name()
            self.expect(")")
            self.block()
        if self.accept("finally"):
            some = True
            self.block()
        if not some:
            self.fail("expected catch or finally")

    def s_switch(self) -> None:
        self.switch()

    def switch(self) -> None:
        self.i += 1
        self.condition()
        self.expect("{")
        while not self.accept("}"):
            if self.accept("case"):
                self.label()
                while self.accept(","):
                    self.label()
                if self.accept("when"):
                    self.expression()
            else:
                self.expect("default")
            if self.accept("->"):
                self.statement() if self.is_("{", "throw") else (self.expression(), self.expect(";"))
                continue
            self.expect(":")
            while not self.is_("case", "default", "}"):
                if self.kind("end"):
                    self.fail("expected '}'")
                self.guarded(self.statement)

    def label(self) -> None:
        if self.accept("default"):
            return
        if not self.attempt(self.pattern_label):
            self.ternary()

    def pattern_label(self) -> None:
        self.pattern()
        if not self.is_("->", ":", ",", "when"):
            self.fail("no pattern")

    def pattern(self) -> None:
        self.modifiers()
        self.type()
        if self.accept("("):
            self.commas(self.pattern, ")", False)
            if self.kind("id") and not self.is_("when"):
                self.name()
        else:
            self.name()

    # expressions

    def operator(self) -> str | None:
        if self.is_(">"):
            n = 1
            while n < 3 and self.peek(n) == ">" and not self.space[self.i + n]:
                n += 1
            return None if self.peek(n) in (">=", "=") and not self.space[self.i + n] else ">" * n
        return super().operator()

    def take_operator(self, op: str) -> None:
        self.i += len(op) if set(op) == {">"} else 1

    def operand(self, op: str, least: int) -> None:
        if op == "instanceof":
            self.modifiers()
            if not self.attempt(self.pattern):
                self.type()
            return
        super().expression(least)

    def expression(self, least: int = 0) -> None:
        if least:
            return super().expression(least)
        if self.lambda_():
            return None
        self.ternary()
        if self.is_(*self.ASSIGN):
            self.i += 1
            self.expression()
        return None

    def ternary(self) -> None:
        super().expression(1)
        if self.accept("?"):
            self.expression()
            self.expect(":")
            if not self.lambda_():
                self.ternary()

    def lambda_(self) -> bool:
        i = self.i
        if self.kind("id") and self.peek() == "->" and self.t[i] not in KEYWORDS:
            self.i += 2
        elif self.is_("(") and i in self.pair and self.t[self.pair[i] + 1] == "->":
            self.i += 1

            def one() -> None:
                if self.kind("id") and self.peek() in (",", ")"):
                    self.name()
                else:
                    self.parameter()

            self.commas(one, ")", False)
            self.expect("->")
        else:
            return False
        self.block() if self.is_("{") else self.expression()
        return True

    def unary(self) -> None:
        if self.accept("+", "-", "!", "~", "++", "--"):
            return self.unary()
        if self.is_("(") and self.attempt(self.cast):
            if not self.lambda_():
                self.unary()
            return None
        self.postfix()
        while self.accept("++", "--"):
            pass
        return None

    def cast(self) -> None:
        self.expect("(")
        primitive = self.is_(*PRIMITIVE)
        self.type()
        while self.accept("&"):
            self.type()
        primitive = primitive and self.t[self.i - 1] in PRIMITIVE
        self.expect(")")
        if not (primitive or self.kind("str", "num") or self.is_("(", "!", "~") or self.kind("id") and (self.t[self.i] not in KEYWORDS - PRIMITIVE or self.is_("new", "this", "super", "null", "true", "false", "switch"))) or self.is_("instanceof"):
            self.fail("no cast")

    def arguments(self) -> None:
        self.commas(self.expression, ")", False)

    def postfix(self) -> None:
        if self.kind("str", "num"):
            self.i += 1
        elif self.accept("("):
            self.expression()
            self.expect(")")
        elif self.accept("new"):
            self.creation()
        elif self.is_("switch"):
            self.switch()
        elif self.is_("this", "super", "null", "true", "false"):
            self.i += 1
            if self.accept("("):
                self.arguments()
        elif self.is_("void") or self.is_(*PRIMITIVE):
            self.i += 1
            self.dimensions()
            if not self.is_("::") and not (self.is_(".") and self.peek() == "class"):
                self.fail("expected '.class'")
        elif self.kind("id") and self.t[self.i] not in KEYWORDS:
            if not self.attempt(self.reference):
                self.i += 1
                if self.accept("("):
                    self.arguments()
        else:
            self.fail("expected an expression")
        while True:
            if self.accept("."):
                if self.accept("new"):
                    self.creation()
                elif self.accept("class", "this"):
                    pass
                else:
                    if self.is_("<"):
                        self.type_arguments()
                    if not self.accept("super"):
                        self.name()
                    if self.accept("("):
                        self.arguments()
            elif self.accept("["):
                self.expression()
                self.expect("]")
            elif self.accept("::"):
                if self.is_("<"):
                    self.type_arguments()
                if not self.accept("new"):
                    self.name()
            else:
                return

    def reference(self) -> None:
        """A type before '::' or '.class' that isn't an expression by itself."""
        self.type()
        if not (self.t[self.i - 1] in (">", "]")):
            self.fail("no type")
        if not self.is_("::") and not (self.is_(".") and self.peek() == "class"):
            self.fail("no type")

    def creation(self) -> None:
        self.annotations()
        if self.is_("<"):
            self.type_arguments()
        if self.is_(*PRIMITIVE):
            self.i += 1
        else:
            while True:
                self.name()
                if self.is_("<"):
                    self.type_arguments()
                if not self.accept("."):
                    break
        if self.is_("["):
            sized = False
            while self.accept("["):
                if not self.accept("]"):
                    sized = True
                    self.expression()
                    self.expect("]")
            if not sized:
                if not self.is_("{"):
                    self.fail("expected a size or values")
                self.initializer()
            return
        self.expect("(")
        self.arguments()
        if self.is_("{"):
            self.members()
