"""Rust."""

from __future__ import annotations

import re

from fathomgrid.llm.syntax.base import Lexer, Parser, levels

KEYWORDS = frozenset("as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while".split())
_PATHS = frozenset(("self", "Self", "super", "crate"))


class RustLexer(Lexer):
    pattern = re.compile(
        r"(?P<ws>[ \t\r\f]+)|(?P<nl>\n)|(?P<comment>//[^\n]*|\A#!(?!\[)[^\n]*)|(?P<nested>/\*)"
        r"|(?P<raw>(?:br|cr|r)(?P<hashes>#*)\")|(?P<str>[bc]?\"(?:[^\\\"]|\\(?s:.))*\"|b?'(?:[^\\'\n]|\\(?:u\{[\da-fA-F_]+\}|x[\da-fA-F]{2}|.))')|(?P<lifetime>'(?:r#)?[A-Za-z_]\w*)|(?P<open_text>[bc]?\")|(?P<open_string>')"
        r"|(?P<num>(?:0x[\da-fA-F_]+|0b[01_]+|0o[0-7_]+|\d[\d_]*(?:\.\d[\d_]*|\.(?![.\w]))?(?:[eE][+-]?[\d_]+)?)(?:[iu](?:8|16|32|64|128|size)|f(?:32|64))?)"
        r"|(?P<id>(?:r#)?[^\W\d]\w*)|(?P<op><<=|>>=|\.\.\.|\.\.=|->|=>|::|\.\.|&&|\|\||==|!=|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|[-+*/%&|^~<>=!?:;,.@#$(){}\[\]])"
    )
    plain = Lexer.plain | {"lifetime"}

    def on_nested(self, m: re.Match) -> None:
        depth, at = 0, self.at
        for m in re.compile(r"/\*|\*/").finditer(self.s, self.at):
            depth += 1 if m.group() == "/*" else -1
            if not depth:
                at = m.end()
                break
        else:
            self.fault("comment never closed")
            at = len(self.s)
        self.line += self.s.count("\n", self.at, at)
        self.space = True
        self.at = at

    def on_open_text(self, m: re.Match) -> None:
        self.fault("string never closed")
        self.at = len(self.s)

    def _raw(self, m: re.Match) -> None:
        close = '"' + m.group("hashes")
        end = self.s.find(close, m.end())
        if end < 0:
            self.fault("string never closed")
            end = len(self.s)
        self.emit("str", "raw")
        self.line += self.s.count("\n", self.at, end)
        self.at = end + len(close)

    on_raw = on_hashes = _raw


class RustParser(Parser):
    reserved = KEYWORDS
    binary = levels(".. ..=", "||", "&&", "== != < > <= >=", "|", "^", "&", "<< >>", "+ -", "* / %")
    ASSIGN = frozenset("= += -= *= /= %= &= |= ^= <<= >>=".split())
    ITEMS = frozenset("use mod fn struct enum trait impl const static type extern union macro_rules pub".split())
    no_struct = False

    def program(self):
        while not self.kind("end"):
            self.guarded(self.item)
        return self.errors

    def attributes(self) -> None:
        while self.is_("#"):
            self.i += 1
            self.accept("!")
            if not self.is_("["):
                self.fail("expected '['")
            self.tree()

    def tree(self) -> None:
        """A balanced run of tokens in brackets."""
        end = self.pair.get(self.i)
        if end is None:
            self.fail("bracket never closed")
        open_ = [self.i]
        for j in range(self.i + 1, end + 1):
            if self.k[j] == "op":
                if self.t[j] in "([{":
                    open_.append(j)
                elif self.t[j] in ")]}":
                    if self.pair.get(open_.pop()) != j:
                        self.i = j
                        self.fail("bracket closes another")
        self.i = end + 1

    def visibility(self) -> None:
        if self.accept("pub") and self.is_("(") and self.peek() in ("crate", "super", "self", "in"):
            self.tree()

    def item(self) -> None:
        self.attributes()
        if self.kind("end"):
            return None
        self.visibility()
        if self.is_("macro_rules") and self.peek() == "!":
            self.i += 2
            self.name()
            brace = self.is_("{")
            self.tree()
            return None if brace else self.expect(";")
        while self.is_("const", "async", "unsafe", "extern", "default", "safe") and (self.peek() in ("fn", "unsafe", "extern", "async", "impl", "trait", "const") or self.is_("extern") and self.k[self.i + 1] == "str" and self.peek(2) in ("fn", "{") or self.is_("unsafe") and self.peek() == "extern"):
            string = self.is_("extern")
            self.i += 1
            if string and self.kind("str"):
                self.i += 1
                if self.is_("{"):
                    return self.items()
        rule = getattr(self, "i_" + self.t[self.i], None) if self.kind("id") else None
        if rule:
            return rule()
        if self.kind("id") and self.peek() in ("!", "::") and self.t[self.i] not in KEYWORDS - _PATHS:
            self.path()
            self.expect("!")
            brace = self.is_("{")
            if not self.is_("(", "[", "{"):
                self.fail("expected a bracket")
            self.tree()
            return None if brace else self.expect(";")
        return self.fail("expected an item")

    def items(self) -> None:
        self.expect("{")
        while not self.accept("}"):
            if self.kind("end"):
                self.fail("expected '}'")
            self.guarded(self.item)

    def i_use(self) -> None:
        self.i += 1
        self.use_tree()
        self.expect(";")

    def use_tree(self) -> None:
        self.accept("::")
        while True:
            if self.accept("*"):
                return
            if self.accept("{"):
                return self.commas(self.use_tree, "}")
            if not (self.kind("id") and (self.t[self.i] not in KEYWORDS or self.is_(*_PATHS))):
                self.fail("expected a path")
            self.i += 1
            if not self.accept("::"):
                break
        if self.accept("as"):
            self.name()

    def i_mod(self) -> None:
        self.i += 1
        self.name()
        if not self.accept(";"):
            self.items()

    def i_extern(self) -> None:
        self.i += 1
        if self.accept("crate"):
            self.name() if not self.accept("self") else None
            if self.accept("as"):
                self.name()
            return self.expect(";")
        if self.kind("str"):
            self.i += 1
        return self.items()

    def i_fn(self) -> None:
        self.i += 1
        self.name()
        self.generics()
        self.expect("(")

        def one() -> None:
            self.attributes()
            if self.accept("..."):
                return
            start = self.i
            while self.accept("&", "mut") or self.kind("lifetime"):
                self.i += self.kind("lifetime")
            if self.accept("self"):
                if self.accept(":"):
                    self.type()
                return
            self.i = start
            self.pattern(False)
            self.expect(":")
            self.type()

        self.commas(one, ")")
        if self.accept("->"):
            self.type()
        self.where()
        if not self.accept(";"):
            self.block()

    def generics(self) -> None:
        def one() -> None:
            self.attributes()
            if self.kind("lifetime"):
                self.i += 1
                if self.accept(":"):
                    self.bounds()
            elif self.accept("const"):
                self.name()
                self.expect(":")
                self.type()
                if self.accept("="):
                    self.generic_argument()
            else:
                self.name()
                if self.accept(":"):
                    self.bounds()
                if self.accept("="):
                    self.type()

        if self.accept("<"):
            self.commas(one, ">")

    def bounds(self) -> None:
        while self.kind("lifetime") or self.is_("?", "for", "(", "~", "::", "async", "dyn", "impl", "const") or self.kind("id") and (self.t[self.i] not in KEYWORDS or self.is_(*_PATHS)):
            if self.kind("lifetime"):
                self.i += 1
            elif self.accept("("):
                self.bounds()
                self.expect(")")
            else:
                self.accept("~")
                self.accept("const", "async")
                self.accept("?")
                if self.accept("for"):
                    self.generics()
                self.type_path()
            if not self.accept("+"):
                return

    def where(self) -> None:
        if self.accept("where"):
            while not self.is_("{", ";", "="):
                if self.accept("for"):
                    self.generics()
                if self.kind("lifetime"):
                    self.i += 1
                else:
                    self.type()
                self.expect(":")
                self.bounds()
                if not self.accept(","):
                    return

    def i_struct(self) -> None:
        self.i += 1
        self.name()
        self.generics()
        self.where()
        if self.accept("("):
            self.tuple_fields()
            self.where()
            return self.expect(";")
        if self.accept(";"):
            return None
        return self.fields()

    def i_union(self) -> None:
        self.i_struct()

    def tuple_fields(self) -> None:
        def one() -> None:
            self.attributes()
            self.visibility()
            self.type()

        self.commas(one, ")")

    def fields(self) -> None:
        def one() -> None:
            self.attributes()
            self.visibility()
            self.name()
            self.expect(":")
            self.type()

        self.expect("{")
        self.commas(one, "}")

    def i_enum(self) -> None:
        self.i += 1
        self.name()
        self.generics()
        self.where()
        self.expect("{")

        def one() -> None:
            self.attributes()
            self.visibility()
            self.name()
            if self.accept("("):
                self.tuple_fields()
            elif self.is_("{"):
                self.fields()
            if self.accept("="):
                self.whole()

        self.commas(one, "}")

    def i_trait(self) -> None:
        self.i += 1
        self.name()
        self.generics()
        if self.accept(":"):
            self.bounds()
        self.where()
        self.items()

    def i_impl(self) -> None:
        self.i += 1
        if self.is_("<"):
            self.generics()
        self.accept("const")
        self.accept("!")
        self.type()
        if self.accept("for"):
            self.type()
        self.where()
        self.items()

    def i_const(self) -> None:
        self.i += 1
        self.accept("mut")
        self.name()
        self.generics()
        if self.accept(":"):
            self.type()
        if self.accept("="):
            self.whole()
        self.expect(";")

    def i_static(self) -> None:
        self.i_const()

    def i_type(self) -> None:
        self.i += 1
        self.name()
        self.generics()
        if self.accept(":"):
            self.bounds()
        self.where()
        if self.accept("="):
            self.type()
        self.where()
        self.expect(";")

    # types

    def type(self) -> None:
        if self.accept("&&", "&"):
            if self.kind("lifetime"):
                self.i += 1
            self.accept("mut")
            self.type()
        elif self.accept("*"):
            if not self.accept("const", "mut"):
                self.fail("expected const or mut")
            self.type()
        elif self.accept("("):
            self.commas(self.type, ")")
        elif self.accept("["):
            self.type()
            if self.accept(";"):
                self.whole()
            self.expect("]")
        elif self.accept("!", "_"):
            pass
        elif self.is_("dyn", "impl") and self.peek() not in ("::",):
            self.i += 1
            self.bounds()
        elif self.is_("fn", "unsafe", "extern", "for"):
            if self.accept("for"):
                self.generics()
            self.accept("unsafe")
            if self.accept("extern") and self.kind("str"):
                self.i += 1
            if not self.accept("fn"):
                return self.type()

            def one() -> None:
                if self.accept("..."):
                    return
                if self.kind("id") and self.peek() == ":":
                    self.i += 2
                self.type()

            self.expect("(")
            self.commas(one, ")")
            if self.accept("->"):
                self.type()
        else:
            self.type_path()
        return None

    def type_path(self) -> None:
        if self.accept("<"):
            self.type()
            if self.accept("as"):
                self.type()
            self.expect(">")
            self.expect("::")
        else:
            self.accept("::")
        while True:
            if not (self.kind("id") and (self.t[self.i] not in KEYWORDS or self.is_(*_PATHS))):
                self.fail("expected a type")
            self.i += 1
            if self.is_("::") and self.peek() == "<":
                self.i += 1
            if self.is_("<"):
                self.generic_arguments()
            elif self.accept("("):
                self.commas(self.type, ")")
                if self.accept("->"):
                    self.type()
            if not self.accept("::"):
                break
        if self.is_("!") and self.peek() in ("(", "[", "{"):
            self.i += 1
            self.tree()

    def generic_arguments(self) -> None:
        self.expect("<")
        self.commas(self.generic_argument, ">")

    def generic_argument(self) -> None:
        if self.kind("lifetime", "num", "str"):
            self.i += 1
        elif self.accept("-"):
            self.i += 1
        elif self.is_("{"):
            self.block()
        elif self.is_("true", "false"):
            self.i += 1
        else:
            self.type()
            if self.accept("="):
                self.generic_argument()
            elif self.accept(":"):
                self.bounds()

    # patterns

    def pattern(self, alternatives: bool = True) -> None:
        self.accept("|")
        self.one_pattern()
        while alternatives and self.accept("|"):
            self.one_pattern()

    def one_pattern(self) -> None:
        if self.accept("&&", "&"):
            self.accept("mut")
            return self.one_pattern()
        if self.accept("("):
            return self.commas(self.pattern, ")")
        if self.accept("["):
            return self.commas(self.pattern, "]")
        if self.accept("_", ".."):
            if self.t[self.i - 1] == ".." and (self.kind("num", "str")):
                self.i += 1
            return None
        if self.accept("..="):
            return self.bound()
        if self.accept("ref"):
            self.accept("mut")
            self.name()
            return self.one_pattern() if self.accept("@") else None
        if self.accept("mut"):
            self.name()
            return self.one_pattern() if self.accept("@") else None
        self.bound()
        if self.accept("@"):
            return self.one_pattern()
        if self.accept("..=", "...", ".."):
            if self.kind("num", "str") or self.is_("-") or self.kind("id") and not self.is_("if"):
                self.bound()
            return None
        if self.accept("("):
            return self.commas(self.pattern, ")")
        if self.accept("{"):

            def one() -> None:
                self.attributes()
                if self.accept(".."):
                    return
                self.accept("ref")
                self.accept("mut")
                if self.kind("num"):
                    self.i += 1
                else:
                    self.name()
                if self.accept(":"):
                    self.pattern()

            return self.commas(one, "}")
        return None

    def bound(self) -> None:
        if self.accept("-"):
            if not self.kind("num"):
                self.fail("expected a number")
        if self.kind("num", "str"):
            self.i += 1
        elif self.is_("true", "false"):
            self.i += 1
        elif self.is_("const") and self.peek() == "{":
            self.i += 1
            self.block()
        else:
            self.path()
            if self.is_("!") and self.peek() in ("(", "[", "{"):
                self.i += 1
                self.tree()

    def path(self) -> None:
        """A path as in expressions, where type arguments need '::'."""
        if self.is_("<"):
            self.i += 1
            self.type()
            if self.accept("as"):
                self.type()
            self.expect(">")
            self.expect("::")
        else:
            self.accept("::")
        while True:
            if not (self.kind("id") and (self.t[self.i] not in KEYWORDS or self.is_(*_PATHS))):
                self.fail("expected a name")
            self.i += 1
            if not self.accept("::"):
                return
            if self.is_("<"):
                self.generic_arguments()
                if not self.accept("::"):
                    return

    # statements

    def block(self) -> None:
        before, self.no_struct = self.no_struct, False
        self.expect("{")
        self.block_until("}")
        self.no_struct = before

    def statement(self) -> None:
        if self.accept(";"):
            return
        self.attributes()
        if self.is_("}"):
            return
        if self.accept("let"):
            self.pattern()
            if self.accept(":"):
                self.type()
            if self.accept("="):
                self.whole()
                if self.accept("else"):
                    self.block()
            return self.expect(";")
        if self.is_(*self.ITEMS) and not (self.is_("union", "macro_rules") and self.k[self.i + 1] != "id" and self.peek() != "!") and not (self.is_("const") and self.peek() == "{") and not (self.is_("union") and self.k[self.i + 1] != "id") or self.is_("unsafe", "async") and self.peek() in ("fn", "impl", "trait", "extern", "unsafe"):
            return self.item()
        closed = self.block_like()
        if closed and not self.is_(".", "?"):
            self.accept(";")
            return
        if closed:
            self.suffixes()
            self.rest_of_expression()
        else:
            macro = self.kind("id") and self.peek() == "!" and self.peek(2) == "{"
            self.whole()
            if macro and self.t[self.i - 1] == "}":
                self.accept(";")
                return
        if not self.is_("}"):
            self.expect(";")

    def rest_of_expression(self) -> None:
        while (op := self.operator()) is not None:
            self.i += 1
            super().expression(self.binary[op][0] + 1)
        if self.is_(*self.ASSIGN):
            self.i += 1
            self.whole()

    def block_like(self) -> bool:
        """An expression that ends with a block, if one stands here."""
        if self.kind("lifetime") and self.peek() == ":":
            self.i += 2
        if self.is_("{"):
            self.block()
        elif self.is_("unsafe", "const") and self.peek() == "{" or self.is_("async") and (self.peek() == "{" or self.peek() == "move" and self.peek(2) == "{"):
            self.i += 1
            self.accept("move")
            self.block()
        elif self.accept("loop"):
            self.block()
        elif self.accept("while"):
            self.condition()
            self.block()
        elif self.accept("for"):
            self.pattern()
            self.expect("in")
            self.condition()
            self.block()
        elif self.accept("if"):
            self.condition()
            self.block()
            if self.accept("else"):
                if not self.is_("if", "{"):
                    self.fail("expected a block")
                self.block_like()
        elif self.accept("match"):
            self.condition()
            self.expect("{")
            while not self.accept("}"):
                if self.kind("end"):
                    self.fail("expected '}'")
                self.guarded(self.arm)
        else:
            return False
        return True

    def condition(self) -> None:
        before, self.no_struct = self.no_struct, True
        self.whole()
        self.no_struct = before

    def arm(self) -> None:
        self.attributes()
        self.pattern()
        if self.accept("if"):
            before, self.no_struct = self.no_struct, False
            self.whole()
            self.no_struct = before
        self.expect("=>")
        before, self.no_struct = self.no_struct, False
        braces = self.is_("{")
        self.whole()
        self.no_struct = before
        if not self.accept(",") and not self.is_("}") and not (braces and self.t[self.i - 1] == "}"):
            self.fail("expected ','")

    # expressions

    def whole(self) -> None:
        if self.accept("let"):
            self.pattern()
            self.expect("=")
            super().expression(4)
            while self.accept("&&"):
                if self.is_("let"):
                    return self.whole()
                super().expression(4)
            return None
        if self.is_("return", "break", "continue"):
            kind = self.t[self.i]
            self.i += 1
            if kind != "return" and self.kind("lifetime"):
                self.i += 1
            if kind != "continue" and not self.is_(";", "}", ")", "]", ",", "=>") and not (self.is_("{") and self.no_struct) and not self.kind("end"):
                self.whole()
            return None
        if self.accept("yield"):
            return self.whole()
        super().expression(1)
        if self.is_(*self.ASSIGN):
            self.i += 1
            self.whole()
        return None

    def expression(self, least: int = 0) -> None:
        super().expression(max(least, 1))

    def operator(self) -> str | None:
        if self.is_(">", "<") and self.peek() == self.t[self.i] and not self.space[self.i + 1]:
            return self.t[self.i] * 2
        return super().operator()

    def take_operator(self, op: str) -> None:
        self.i += 2 if op in (">>", "<<") else 1

    def operand(self, op: str, least: int) -> None:
        if op in ("..", "..="):
            if self.is_(")", "]", "}", ",", ";", "=>") or self.is_("{") and self.no_struct or self.kind("end"):
                return
            return super().expression(least)
        if op == "&&" and self.is_("let"):
            return self.whole()
        if self.is_("return", "break", "continue") or self.is_("|", "||", "move"):
            return self.whole()
        return super().expression(least)

    def unary(self) -> None:
        if self.is_("..", "..="):
            self.i += 1
            if not self.is_(")", "]", "}", ",", ";", "=>") and not (self.is_("{") and self.no_struct):
                super().expression(2)
            return
        while self.is_("-", "!", "*", "&", "&&"):
            amp = self.is_("&", "&&")
            self.i += 1
            if amp:
                if self.is_("raw") and self.peek() in ("const", "mut"):
                    self.i += 2
                self.accept("mut")
        self.postfix()
        while self.accept("as"):
            self.type()

    def postfix(self) -> None:
        self.primary()
        self.suffixes()

    def suffixes(self) -> None:
        while True:
            if self.accept("?"):
                continue
            if self.accept("."):
                if self.kind("num") or self.accept("await"):
                    self.i += self.kind("num")
                    continue
                if not (self.kind("id") and self.t[self.i] not in KEYWORDS):
                    self.fail("expected a name")
                self.i += 1
                if self.accept("::"):
                    self.generic_arguments()
            elif self.accept("("):
                self.inside(lambda: self.commas(self.whole, ")"))
            elif self.accept("["):
                self.inside(self.whole)
                self.expect("]")
            else:
                return

    def inside(self, rule) -> None:
        before, self.no_struct = self.no_struct, False
        rule()
        self.no_struct = before

    def primary(self) -> None:
        if self.kind("str", "num"):
            self.i += 1
        elif self.is_("true", "false"):
            self.i += 1
        elif self.accept("("):
            self.inside(lambda: self.commas(self.whole, ")"))
        elif self.accept("["):

            def values() -> None:
                if self.accept("]"):
                    return
                self.whole()
                if self.accept(";"):
                    self.whole()
                    return self.expect("]")
                if self.accept(","):
                    return self.commas(self.whole, "]")
                return self.expect("]")

            self.inside(values)
        elif self.is_("|", "||", "move", "static") or self.is_("async") and self.peek() in ("|", "||", "move") and not self.peek(2) == "{":
            self.closure()
        elif self.is_("return", "break", "continue"):
            self.whole()
        elif self.block_like():
            pass
        elif self.accept("_"):
            pass
        else:
            self.path()
            if self.is_("!") and self.peek() in ("(", "[", "{"):
                self.i += 1
                self.tree()
            elif self.is_("{") and not self.no_struct:
                self.i += 1

                def one() -> None:
                    self.attributes()
                    if self.accept(".."):
                        if not self.is_("}"):
                            self.whole()
                        return
                    if self.kind("num"):
                        self.i += 1
                    else:
                        self.name()
                    if self.accept(":"):
                        self.whole()

                self.inside(lambda: self.commas(one, "}"))

    def closure(self) -> None:
        self.accept("static")
        self.accept("async")
        self.accept("move")
        if not self.accept("||"):
            self.expect("|")

            def one() -> None:
                self.pattern(False)
                if self.accept(":"):
                    self.type()

            self.commas(one, "|")
        if self.accept("->"):
            self.type()
            return self.block()
        return self.whole()
