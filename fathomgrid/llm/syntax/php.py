"""PHP."""

from __future__ import annotations

import re

from fathomgrid.llm.syntax.base import Lexer, Parser, levels

KEYWORDS = frozenset("abstract and array as break callable case catch class clone const continue declare default do echo else elseif empty enddeclare endfor endforeach endif endswitch endwhile extends final finally fn for foreach function global goto if implements include include_once instanceof insteadof interface isset list match namespace new or print private protected public readonly require require_once return static switch throw trait try unset use var while xor yield".split())
_CASTS = "int|integer|float|double|real|string|binary|bool|boolean|array|object|unset"


class PhpLexer(Lexer):
    """Text outside of the marks is HTML and becomes one token."""

    pattern = re.compile(
        r"(?P<ws>[ \t\f\v]+)|(?P<nl>\r\n|\n|\r)|(?P<close>\?>(?:\r?\n)?)|(?P<comment>(?://|#(?!\[))(?:(?!\?>)[^\r\n])*|/\*(?s:.*?)\*/)|(?P<open_comment>/\*)"
        r"|(?P<heredoc><<<[ \t]*(?P<mark>[\"']?)(?P<label>[A-Za-z_]\w*)(?P=mark)\r?\n)"
        r"|(?P<str>[bB]?\"(?:[^\\\"]|\\(?s:.))*\"|[bB]?'(?:[^\\']|\\(?s:.))*'|`(?:[^\\`]|\\(?s:.))*`)|(?P<open_text>[\"'`])"
        r"|(?P<num>0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*(?:\.\d[\d_]*|\.(?![.\w=]))?|\.\d[\d_]*)(?:[eE][+-]?\d+)?)"
        r"|(?P<var>\$+[A-Za-z_\x80-￿]\w*)|(?P<id>\\?[A-Za-z_\x80-￿]\w*(?:\\[A-Za-z_\x80-￿]\w*)*)|(?P<cast>\([ \t]*(?i:" + _CASTS + r")[ \t]*\))"
        r"|(?P<op>#\[|<=>|\*\*=|\.\.\.|<<=|>>=|===|!==|\?\?=|\?->|->|=>|::|\+\+|--|==|!=|<>|<=|>=|&&|\|\||\?\?|\+=|-=|\*=|/=|\.=|%=|&=|\|=|\^=|<<|>>|\*\*|[-+*/%.&|^~<>=!?:;,@$(){}\[\]\\])"
    )
    plain = Lexer.plain | {"var", "cast"}

    def run(self):
        self.html()
        return super().run()

    def html(self) -> None:
        m = re.compile(r"<\?(?:php(?=\s|$)|=)").search(self.s, self.at)
        end = m.start() if m else len(self.s)
        if end > self.at or not m:
            self.emit("html", "")
        self.line += self.s.count("\n", self.at, end)
        self.at = m.end() if m else end
        if m and m.group() == "<?=":
            self.emit("id", "echo")

    def on_close(self, m: re.Match) -> None:
        self.emit("op", ";")
        self.out.text[-1] = ";"
        self.line += m.group().count("\n")
        self.at = m.end()
        self.html()

    def on_open_text(self, m: re.Match) -> None:
        self.fault("string never closed")
        self.at = len(self.s)

    def on_heredoc(self, m: re.Match) -> None:
        end = re.compile(r"^[ \t]*" + m.group("label") + r"\b", re.M).search(self.s, m.end())
        if not end:
            self.fault("string never closed")
        stop = end.end() if end else len(self.s)
        self.emit("str", "text")
        self.line += self.s.count("\n", self.at, stop)
        self.at = stop


class PhpParser(Parser):
    reserved = KEYWORDS
    binary = levels("or", "xor", "and", "??", "||", "&&", "|", "^", "&", "== != === !== <> <=>", "< <= > >=", ".", "<< >>", "+ -", "* / %", "instanceof", "**", right="?? **")
    ASSIGN = frozenset("= += -= *= /= .= %= **= ??= &= |= ^= <<= >>=".split())
    MODIFIERS = frozenset("public private protected static abstract final readonly var".split())

    def end(self) -> None:
        if self.kind("html", "end") and self.kind("html"):
            return
        self.expect(";")

    def low(self) -> str:
        return self.t[self.i].lower() if self.kind("id") else ""

    def word(self, *words: str) -> bool:
        """Keywords are the same in either case."""
        if self.low() in words:
            self.i += 1
            return True
        return False

    def statement(self) -> None:
        if self.kind("html"):
            self.i += 1
            return None
        if self.accept("{"):
            return self.block_until("}")
        if self.accept(";"):
            return None
        self.attributes()
        t = self.low()
        rule = getattr(self, "s_" + t, None)
        if rule and rule() is not False:
            return None
        if self.kind("id") and self.peek() == ":" and t not in KEYWORDS and self.peek() != "::":
            self.i += 2
            return None
        self.expression()
        return self.end()

    def attributes(self) -> None:
        while self.accept("#["):
            def one() -> None:
                self.name()
                if self.accept("("):
                    self.arguments()

            self.commas(one, "]")

    def name(self) -> str:
        if not self.kind("id") or self.low() in KEYWORDS:
            self.fail("expected a name")
        self.i += 1
        return self.t[self.i - 1]

    def variable(self) -> None:
        if not self.kind("var"):
            self.fail("expected a variable")
        self.i += 1

    def condition(self) -> None:
        self.expect("(")
        self.expression()
        self.expect(")")

    def body(self, *ends: str) -> None:
        """A statement, or statements between ':' and an end word, which is left."""
        if self.accept(":"):
            while self.low() not in ends:
                if self.kind("end"):
                    self.fail(f"expected {ends[0]!r}")
                self.guarded(self.statement)
        else:
            self.statement()

    def s_if(self) -> None:
        self.i += 1
        self.condition()
        if self.is_(":"):
            self.body("elseif", "else", "endif")
            while self.word("elseif"):
                self.condition()
                self.body("elseif", "else", "endif")
            if self.word("else"):
                if self.low() == "if":
                    return self.s_if()
                self.body("endif")
            if not self.word("endif"):
                self.fail("expected endif")
            return self.end()
        self.statement()
        while self.word("elseif"):
            self.condition()
            self.statement()
        if self.word("else"):
            self.statement()
        return None

    def looped(self, end: str) -> None:
        if self.is_(":"):
            self.body(end)
            self.i += 1
            return self.end()
        return self.statement()

    def s_while(self) -> None:
        self.i += 1
        self.condition()
        self.looped("endwhile")

    def s_do(self) -> None:
        self.i += 1
        self.statement()
        if not self.word("while"):
            self.fail("expected while")
        self.condition()
        self.end()

    def s_for(self) -> None:
        self.i += 1
        self.expect("(")
        for close in (";", ";", ")"):
            if not self.is_(close):
                self.expression()
                while self.accept(","):
                    self.expression()
            self.expect(close)
        self.looped("endfor")

    def s_foreach(self) -> None:
        self.i += 1
        self.expect("(")
        self.expression()
        if not self.word("as"):
            self.fail("expected as")
        self.accept("&")
        self.expression()
        if self.accept("=>"):
            self.accept("&")
            self.expression()
        self.expect(")")
        self.looped("endforeach")

    def s_switch(self) -> None:
        self.i += 1
        self.condition()
        alternative = self.accept(":")
        if not alternative:
            self.expect("{")
        while not (self.low() == "endswitch" if alternative else self.is_("}")):
            if self.kind("html"):
                self.i += 1
                continue
            if self.word("case"):
                self.expression()
            elif not self.word("default"):
                self.fail("expected case")
            if not self.accept(":", ";"):
                self.fail("expected ':'")
            while self.low() not in ("case", "default", "endswitch") and not self.is_("}"):
                if self.kind("end"):
                    self.fail("expected '}'")
                self.guarded(self.statement)
        self.i += 1
        if alternative:
            self.end()

    def s_break(self) -> None:
        self.i += 1
        if self.kind("num"):
            self.i += 1
        self.end()

    def s_continue(self) -> None:
        self.s_break()

    def s_return(self) -> None:
        self.i += 1
        if not self.is_(";") and not self.kind("html"):
            self.expression()
        self.end()

    def s_echo(self) -> None:
        self.i += 1
        self.expression()
        while self.accept(","):
            self.expression()
        self.end()

    def s_global(self) -> None:
        self.i += 1
        self.variable()
        while self.accept(","):
            self.variable()
        self.end()

    def s_static(self) -> bool | None:
        if self.k[self.i + 1] != "var":
            return False
        self.i += 1
        while True:
            self.variable()
            if self.accept("="):
                self.expression()
            if not self.accept(","):
                return self.end()

    def s_unset(self) -> None:
        self.i += 1
        self.expect("(")
        self.commas(self.expression, ")")
        self.end()

    def s_declare(self) -> None:
        self.i += 1
        self.expect("(")

        def one() -> None:
            self.name()
            self.expect("=")
            self.expression()

        self.commas(one, ")", False)
        if self.is_("{"):
            return self.statement()
        return self.end()

    def s_namespace(self) -> bool | None:
        if self.peek() == "\\":
            return False
        self.i += 1
        if self.kind("id"):
            self.name()
        if self.accept("{"):
            return self.block_until("}")
        return self.end()

    def s_use(self) -> None:
        self.i += 1
        self.word("function", "const")

        def one() -> None:
            self.word("function", "const")
            self.name()
            if self.accept("\\"):
                self.expect("{")
                return self.commas(one, "}")
            if self.word("as"):
                self.name()
            return None

        one()
        while self.accept(","):
            one()
        self.end()

    def s_const(self) -> None:
        self.i += 1
        while True:
            self.i += self.kind("id")
            if self.kind("id"):
                self.i += 1
            self.expect("=")
            self.expression()
            if not self.accept(","):
                return self.end()

    def s_goto(self) -> None:
        self.i += 1
        self.name()
        self.end()

    def s_throw(self) -> None:
        self.expression()
        self.end()

    def s_try(self) -> None:
        self.i += 1
        self.expect("{")
        self.block_until("}")
        some = False
        while self.word("catch"):
            some = True
            self.expect("(")
            self.name()
            while self.accept("|"):
                self.name()
            if self.kind("var"):
                self.i += 1
            self.expect(")")
            self.expect("{")
            self.block_until("}")
        if self.word("finally"):
            some = True
            self.expect("{")
            self.block_until("}")
        if not some:
            self.fail("expected catch or finally")

    def s_function(self) -> bool | None:
        if self.peek() == "(" or self.peek() == "&" and self.peek(2) == "(":
            return False
        self.i += 1
        self.accept("&")
        self.name()
        self.signature()
        self.expect("{")
        return self.block_until("}")

    def signature(self) -> None:
        self.expect("(")
        self.commas(self.parameter, ")")
        if self.accept(":"):
            self.type()

    def parameter(self) -> None:
        self.attributes()
        while self.low() in self.MODIFIERS:
            self.i += 1
        if not self.kind("var") and not self.is_("&", "..."):
            self.type()
        self.accept("&")
        self.accept("...")
        self.variable()
        if self.accept("="):
            self.expression()

    def type(self) -> None:
        self.accept("?")
        while True:
            if self.accept("("):
                self.type()
                self.expect(")")
            elif self.kind("id") and (self.low() not in KEYWORDS or self.low() in ("array", "callable", "static")):
                self.i += 1
            else:
                self.fail("expected a type")
            if self.is_("&") and (self.k[self.i + 1] == "var" or self.peek() in ("...", "&")):
                return
            if not self.accept("|", "&"):
                return

    def class_like(self) -> bool | None:
        while self.low() in ("abstract", "final", "readonly"):
            self.i += 1
        if self.low() not in ("class", "interface", "trait", "enum"):
            self.fail("expected a class")
        self.i += 1
        self.name()
        if self.accept(":"):
            self.type()
        return self.class_tail()

    def class_tail(self) -> None:
        for word in ("extends", "implements"):
            if self.word(word):
                self.name()
                while self.accept(","):
                    self.name()
        self.expect("{")
        while not self.accept("}"):
            if self.kind("end"):
                self.fail("expected '}'")
            self.guarded(self.member)

    s_class = s_interface = s_trait = s_abstract = s_final = class_like

    def s_enum(self) -> bool | None:
        return self.class_like() if self.k[self.i + 1] == "id" else False

    def s_readonly(self) -> bool | None:
        return self.class_like() if self.k[self.i + 1] == "id" else False

    def member(self) -> None:
        self.attributes()
        if self.word("use"):
            self.name()
            while self.accept(","):
                self.name()
            if self.accept("{"):
                while not self.accept("}"):
                    if self.kind("end"):
                        self.fail("expected '}'")
                    self.i += 1
                return None
            return self.end()
        if self.word("case"):
            self.i += self.kind("id")
            if self.accept("="):
                self.expression()
            return self.end()
        while self.low() in self.MODIFIERS:
            self.i += 1
        if self.low() == "const":
            return self.s_const()
        if self.word("function"):
            self.accept("&")
            if not self.kind("id"):
                self.fail("expected a name")
            self.i += 1
            self.signature()
            if self.accept("{"):
                return self.block_until("}")
            return self.end()
        if not self.kind("var"):
            self.type()
        while True:
            self.variable()
            if self.accept("="):
                self.expression()
            if self.is_("{"):
                self.i = self.pair.get(self.i, self.i) + 1
                return None
            if not self.accept(","):
                return self.end()

    # expressions

    def expression(self, least: int = 0) -> None:
        self.unary()
        while True:
            if self.is_(*self.ASSIGN):
                last = self.i - 1
                if not (self.k[last] == "var" or self.t[last] in ("]", "}", ")") or self.k[last] == "id" and self.t[last - 1] in ("->", "?->", "::")):
                    self.fail("cannot assign to this")
                self.i += 1
                self.accept("&")
                self.expression(4)
                continue
            if self.is_("?") and least <= 4:
                self.i += 1
                if not self.accept(":"):
                    self.expression(4)
                    self.expect(":")
                self.expression(5)
                continue
            op = self.t[self.i].lower() if self.kind("op", "id") else ""
            if op not in self.binary or self.binary[op][0] < least:
                return
            power, right = self.binary[op]
            self.i += 1
            self.expression(power if right else power + 1)

    def unary(self) -> None:
        while self.is_("!", "-", "+", "~", "@", "&", "++", "--") or self.kind("cast") or self.low() in ("new", "clone", "print", "yield", "throw", "include", "include_once", "require", "require_once"):
            t = self.low()
            if t == "new":
                break
            self.i += 1
            if t == "yield":
                if self.is_(";", ")", ",", "]"):
                    return None
                self.word("from")
                self.expression(4)
                if self.accept("=>"):
                    self.expression(4)
                return None
            if t in ("print", "throw", "include", "include_once", "require", "require_once"):
                return self.expression(4)
        self.postfix()
        if self.is_("++", "--"):
            self.i += 1
        return None

    def arguments(self) -> None:
        def one() -> None:
            if self.accept("...") and self.is_(")"):
                return
            if self.kind("id") and self.peek() == ":":
                self.i += 2
            self.expression()

        self.commas(one, ")")

    def items(self, close: str) -> None:
        while not self.accept(close):
            if self.accept(","):
                continue
            self.accept("...")
            self.accept("&")
            self.expression()
            if self.accept("=>"):
                self.accept("&")
                self.expression()
            if not self.is_(close):
                self.expect(",")

    def postfix(self) -> None:
        self.primary()
        while True:
            if self.accept("->", "?->"):
                if self.accept("{"):
                    self.expression()
                    self.expect("}")
                elif self.kind("id", "var"):
                    self.i += 1
                else:
                    self.fail("expected a name")
            elif self.accept("::"):
                if self.accept("{"):
                    self.expression()
                    self.expect("}")
                elif self.kind("id", "var"):
                    self.i += 1
                else:
                    self.fail("expected a name")
            elif self.accept("["):
                if not self.accept("]"):
                    self.expression()
                    self.expect("]")
            elif self.accept("("):
                self.arguments()
            else:
                return

    def primary(self) -> None:
        t = self.low()
        if self.kind("str", "num", "var"):
            self.i += 1
        elif self.accept("("):
            self.expression()
            self.expect(")")
        elif self.accept("["):
            self.items("]")
        elif self.accept("$"):
            if self.accept("{"):
                self.expression()
                self.expect("}")
            else:
                self.primary()
        elif self.is_("#["):
            self.attributes()
            self.primary()
        elif t in ("array", "list") and self.peek() == "(":
            self.i += 2
            self.items(")")
        elif t in ("isset", "empty"):
            self.i += 1
            self.expect("(")
            self.commas(self.expression, ")")
        elif t in ("exit", "die"):
            self.i += 1
        elif t == "new":
            self.i += 1
            self.attributes()
            if self.low() == "class" or self.low() == "readonly":
                self.word("readonly")
                self.i += 1
                if self.accept("("):
                    self.arguments()
                return self.class_tail()
            if self.accept("("):
                self.expression()
                self.expect(")")
            elif self.kind("var"):
                self.i += 1
                while self.is_("->", "::", "["):
                    if self.accept("["):
                        self.expression()
                        self.expect("]")
                    else:
                        self.i += 2
            elif self.kind("id") and (self.low() not in KEYWORDS or self.low() == "static"):
                self.i += 1
            else:
                self.fail("expected a class")
            if self.accept("("):
                self.arguments()
        elif t == "static" and self.peek() == "::":
            self.i += 1
        elif t in ("function", "fn", "static"):
            self.word("static")
            arrow = self.low() == "fn"
            if not self.word("function", "fn"):
                self.fail("expected a function")
            self.accept("&")
            self.expect("(")
            self.commas(self.parameter, ")")
            if self.word("use"):
                self.expect("(")

                def one() -> None:
                    self.accept("&")
                    self.variable()

                self.commas(one, ")")
            if self.accept(":"):
                self.type()
            if arrow:
                self.expect("=>")
                return self.expression(4)
            self.expect("{")
            return self.block_until("}")
        elif t == "match" and self.peek() == "(":
            self.i += 1
            self.condition()
            self.expect("{")

            def arm() -> None:
                if not self.word("default"):
                    self.expression()
                    while self.accept(",") and not self.is_("=>"):
                        self.expression()
                self.expect("=>")
                self.expression()

            self.commas(arm, "}")
        elif self.kind("id") and t not in KEYWORDS:
            self.i += 1
        else:
            self.fail("expected an expression")
        return None
