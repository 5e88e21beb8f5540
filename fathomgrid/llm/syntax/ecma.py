"""JavaScript and TypeScript."""

from __future__ import annotations

import re

from fathomgrid.llm.syntax.base import Lexer, Parser, levels

RESERVED = frozenset("break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with".split())
_BEFORE_DIVISION = frozenset(") ] }".split())
_BEFORE_REGEX = frozenset("return typeof case in of delete void throw new else do instanceof yield await".split())


class EcmaLexer(Lexer):
    pattern = re.compile(
        r"(?P<ws>[ \t\v\f\u00a0\ufeff]+)|(?P<nl>\r\n|[\n\r\u2028\u2029])|(?P<comment>//[^\r\n]*|/\*(?s:.*?)\*/|\A#![^\r\n]*)|(?P<open_comment>/\*)"
        r"|(?P<str>\"(?:[^\\\"\r\n]|\\(?:\r\n|(?s:.)))*\"|'(?:[^\\'\r\n]|\\(?:\r\n|(?s:.)))*')|(?P<template>`)|(?P<open_string>[\"'])"
        r"|(?P<num>0[xX][\da-fA-F_]+n?|0[bB][01_]+n?|0[oO][0-7_]+n?|(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?n?)"
        r"|(?P<id>#?[A-Za-z_$\u00aa-\uffff](?:[\w$])*)|(?P<slash>/=?)"
        r"|(?P<op>>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|%=|&=|\|=|\^=|\*\*|[{}()\[\];,<>+\-*%&|^!~?:=.@])"
    )

    def on_slash(self, m: re.Match) -> None:
        k, t = (self.out.kind[-1], self.out.text[-1]) if self.out.kind else ("", "")
        divides = k in ("num", "str") or k == "id" and t not in _BEFORE_REGEX or k == "op" and t in _BEFORE_DIVISION
        if not divides:
            r = re.compile(r"/(?:[^\\/\[\r\n]|\\[^\r\n]|\[(?:[^\]\\\r\n]|\\[^\r\n])*\])+/[A-Za-z]*").match(self.s, self.at)
            if r:
                self.emit("str", r.group())
                self.at = r.end()
                return
        self.emit("op", m.group())
        self.at = m.end()

    def on_template(self, m: re.Match) -> None:
        """A template string; what its fields hold is read as tokens of their own and must be an expression."""
        s, n, at = self.s, len(self.s), self.at + 1
        fields: list[tuple[int, int]] = []
        while at < n and s[at] != "`":
            if s[at] == "\\":
                at += 2
            elif s.startswith("${", at):
                end = self.field_end(at + 2)
                if end < 0:
                    at = n
                    break
                fields.append((at + 2, end))
                at = end + 1
            else:
                at += 1
        if at >= n:
            self.fault("template never closed")
            self.emit("str", "")
            self.at = n
            return
        whole = s[self.at : at + 1]
        self.emit("template", whole)
        for a, b in fields:
            inner = type(self)(s[a:b])
            inner.line = self.line + s.count("\n", self.at, a)
            got = inner.run()
            self.out.faults += got.faults
            self.emit("field", "")
            for j in range(len(got.kind) - 1):
                self.out.add(got.kind[j], got.text[j], got.line[j], got.space[j], got.fresh[j])
            self.emit("field_end", "")
        self.line += whole.count("\n")
        self.at = at + 1

    def field_end(self, at: int) -> int:
        depth, s, n = 1, self.s, len(self.s)
        while at < n:
            c = s[at]
            if c in "\"'":
                m = self.pattern.match(s, at)
                at = m.end() if m and m.lastgroup == "str" else at + 1
                continue
            if c == "`":
                at += 1
                while at < n and s[at] != "`":
                    if s.startswith("${", at):
                        at = self.field_end(at + 2)
                        if at < 0:
                            return -1
                    at += 2 if s[at : at + 1] == "\\" else 1
            depth += (c == "{") - (c == "}")
            if not depth:
                return at
            at += 1
        return -1


class EcmaParser(Parser):
    typed = False
    reserved = RESERVED
    binary = levels("??", "||", "&&", "|", "^", "&", "== != === !==", "< > <= >= instanceof in", "<< >> >>>", "+ -", "* / %", "**", right="**")
    prefix = frozenset("! ~ + - typeof void delete await".split())
    ASSIGN = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
    MODIFIERS = frozenset("public private protected static readonly abstract override declare async accessor".split())

    def __init__(self, tokens):
        super().__init__(tokens)
        self.no_in = False

    def operator(self) -> str | None:
        if self.no_in and self.is_("in"):
            return None
        op = super().operator()
        if op == ">":  # the lexer leaves >> and >>> apart for the sake of types
            n = 1
            while n < 3 and self.peek(n) == ">" and not self.space[self.i + n]:
                n += 1
            op = ">" * n
        return op

    def take_operator(self, op: str) -> None:
        self.i += len(op) if set(op) == {">"} else 1

    # statements

    def end(self) -> None:
        """A semicolon, or a place where one may be left out."""
        if self.accept(";") or self.is_("}") or self.kind("end", "field_end") or self.fresh[self.i]:
            return
        self.fail("expected ';'")

    def statement(self) -> None:
        if self.kind("op"):
            if self.accept("{"):
                return self.block_until("}")
            if self.accept(";"):
                return None
            if self.is_("@"):
                self.decorators()
                return self.statement()
        if self.kind("id"):
            rule = getattr(self, "s_" + self.t[self.i], None)
            if rule and rule() is not False:
                return None
            if self.peek() == ":" and self.t[self.i] not in RESERVED:
                self.i += 2
                return self.statement()
        self.sequence()
        self.end()
        return None

    def decorators(self) -> None:
        while self.accept("@"):
            self.member()

    def sequence(self) -> None:
        self.assign()
        while self.accept(","):
            self.assign()

    def parenthesized(self) -> None:
        self.expect("(")
        self.sequence()
        self.expect(")")

    def declaration(self, loop: bool = False) -> None:
        self.i += 1
        while True:
            self.binding()
            if self.typed:
                self.accept("!")
                self.annotation()
            if self.accept("="):
                self.assign()
            if not self.accept(","):
                break
        if not loop:
            self.end()

    def s_var(self) -> None:
        self.declaration()


    def s_const(self) -> bool | None:
        if self.typed and self.peek() == "enum":
            self.i += 1
            return self.s_enum()
        return self.declaration()

    def s_let(self) -> bool | None:
        if self.k[self.i + 1] == "id" and self.peek() not in ("in", "of", "instanceof") or self.peek() in ("[", "{"):
            return self.declaration()
        return False

    def binding(self) -> None:
        if self.accept("["):
            while not self.accept("]"):
                if self.accept(","):
                    continue
                self.accept("...")
                self.binding()
                if self.accept("="):
                    self.assign()
                if not self.accept(","):
                    self.expect("]")
                    return
        elif self.accept("{"):
            self.commas(self.bound_property, "}")
        else:
            self.name()

    def bound_property(self) -> None:
        if self.accept("..."):
            return self.binding()
        if self.accept("["):
            self.assign()
            self.expect("]")
            self.expect(":")
            self.binding()
        else:
            plain = self.kind("id") and self.t[self.i] not in RESERVED
            self.key()
            if self.accept(":"):
                self.binding()
            elif not plain:
                self.fail("expected ':'")
        if self.accept("="):
            self.assign()
        return None

    def s_function(self) -> None:
        self.i += 1
        self.accept("*")
        self.name()
        self.function()

    def s_async(self) -> bool | None:
        if self.peek() == "function" and not self.fresh[self.i + 1]:
            self.i += 1
            return self.s_function()
        return False

    def function(self, body: bool = True) -> None:
        """Type parameters, parameters, result and body."""
        if self.typed:
            self.type_parameters()
        self.expect("(")
        self.parameters()
        if self.typed and self.accept(":"):
            self.result()
        if self.accept("{"):
            before, self.no_in = self.no_in, False
            self.block_until("}")
            self.no_in = before
        elif self.typed:
            self.end()
        else:
            self.fail("expected '{'")

    def parameters(self) -> None:
        def one() -> None:
            if self.typed:
                self.decorators()
                while self.is_(*self.MODIFIERS) and self.k[self.i + 1] == "id":
                    self.i += 1
                if self.is_("this") and self.peek() == ":":
                    self.i += 1
                    return self.annotation()
            rest = self.accept("...")
            self.binding()
            if self.typed:
                self.accept("?")
                self.annotation()
            if not rest and self.accept("="):
                self.assign()
            return None

        self.commas(one, ")")

    def s_class(self) -> None:
        self.i += 1
        if self.kind("id") and not self.is_("extends", "implements"):
            self.name()
        self.class_tail()

    def s_abstract(self) -> bool | None:
        if self.typed and self.peek() == "class":
            self.i += 1
            return self.s_class()
        return False

    def class_tail(self) -> None:
        if self.typed:
            self.type_parameters()
        if self.accept("extends"):
            self.member()
            if self.typed and self.is_("<"):
                self.type_arguments()
        if self.typed and self.accept("implements"):
            self.type()
            while self.accept(","):
                self.type()
        self.expect("{")
        while not self.accept("}"):
            if self.kind("end"):
                self.fail("expected '}'")
            self.guarded(self.class_member)

    def class_member(self) -> None:
        if self.accept(";"):
            return
        self.decorators()
        if self.is_("static") and self.peek() == "{":
            self.i += 2
            return self.block_until("}")
        while self.is_(*(self.MODIFIERS if self.typed else ("static", "async", "accessor"))) and self.peek() not in ("(", "=", ";", "}", ":", "?", "!", ",", "<"):
            self.i += 1
        if self.is_("get", "set") and self.peek() not in ("(", "=", ";", "}", ":", "?", "!", "<"):
            self.i += 1
        self.accept("*")
        if self.typed and self.is_("[") and self.k[self.i + 1] == "id" and self.peek(2) == ":":
            self.index_signature()
            return self.end()
        self.key()
        if self.typed:
            self.accept("?", "!")
        if self.is_("(") or self.typed and self.is_("<"):
            return self.function()
        if self.typed:
            self.annotation()
        if self.accept("="):
            self.assign()
        return self.end()

    def key(self) -> None:
        if self.accept("["):
            self.assign()
            self.expect("]")
        elif self.kind("id", "str", "num"):
            self.i += 1
        else:
            self.fail("expected a name")

    def s_if(self) -> None:
        self.i += 1
        self.parenthesized()
        self.statement()
        if self.accept("else"):
            self.statement()

    def s_while(self) -> None:
        self.i += 1
        self.parenthesized()
        self.statement()

    def s_do(self) -> None:
        self.i += 1
        self.statement()
        self.expect("while")
        self.parenthesized()
        self.accept(";")

    def s_for(self) -> None:
        self.i += 1
        self.accept("await")
        self.expect("(")
        self.no_in = True
        if self.is_("var", "const", "let"):
            self.declaration(loop=True)
        elif not self.is_(";"):
            self.sequence()
        self.no_in = False
        if self.accept("of", "in"):
            self.sequence()
        else:
            self.expect(";")
            if not self.is_(";"):
                self.sequence()
            self.expect(";")
            if not self.is_(")"):
                self.sequence()
        self.expect(")")
        self.statement()

    def jump(self) -> None:
        self.i += 1
        if self.kind("id") and not self.fresh[self.i] and self.t[self.i] not in RESERVED:
            self.i += 1
        self.end()

    def s_break(self) -> None:
        self.jump()

    def s_continue(self) -> None:
        self.jump()

    def s_debugger(self) -> None:
        self.jump()

    def s_return(self) -> None:
        self.i += 1
        if not self.fresh[self.i] and not self.is_(";", "}"):
            self.sequence()
        self.end()

    def s_throw(self) -> None:
        self.i += 1
        if self.fresh[self.i]:
            self.fail("expected an expression")
        self.sequence()
        self.end()

    def s_try(self) -> None:
        self.i += 1
        self.expect("{")
        self.block_until("}")
        some = False
        if self.accept("catch"):
            some = True
            if self.accept("("):
                self.binding()
                if self.typed:
                    self.annotation()
                self.expect(")")
            self.expect("{")
            self.block_until("}")
        if self.accept("finally"):
            some = True
            self.expect("{")
            self.block_until("}")
        if not some:
            self.fail("expected catch or finally")

    def s_switch(self) -> None:
        self.i += 1
        self.parenthesized()
        self.expect("{")
        while not self.accept("}"):
            if self.accept("case"):
                self.sequence()
            else:
                self.expect("default")
            self.expect(":")
            while not self.is_("case", "default", "}"):
                if self.kind("end"):
                    self.fail("expected '}'")
                self.guarded(self.statement)

    def s_import(self) -> bool | None:
        if self.peek() in ("(", "."):
            return False
        self.i += 1
        if self.kind("str"):
            self.i += 1
            return self.end()
        if self.typed and self.is_("type") and (self.peek() in ("{", "*") or self.k[self.i + 1] == "id" and self.peek() != "from"):
            self.i += 1
        more = True
        if self.kind("id"):
            self.name()
            if self.typed and self.accept("="):
                self.sequence()
                return self.end()
            more = self.accept(",")
        if more:
            if self.accept("*"):
                self.expect("as")
                self.name()
            else:
                self.expect("{")
                self.commas(self.specifier, "}")
        return self.source()

    def source(self) -> None:
        self.expect("from")
        if not self.kind("str"):
            self.fail("expected a module")
        self.i += 1
        if self.accept("with", "assert"):
            self.object()
        self.end()

    def specifier(self) -> None:
        if self.typed and self.is_("type") and self.k[self.i + 1] == "id" and self.peek() != "as":
            self.i += 1
        self.key()
        if self.accept("as"):
            self.key()

    def s_export(self) -> None:
        self.i += 1
        if self.accept("default"):
            if self.is_("function", "class", "abstract") or self.is_("async") and self.peek() == "function":
                self.accept("async", "abstract")
                named = self.k[self.i + 1] == "id"
                if self.is_("class") or named:
                    return self.statement()
                self.i += 1
                self.accept("*")
                return self.s_anonymous()
            if self.typed and self.is_("interface"):
                return self.statement()
            self.assign()
            return self.end()
        if self.accept("*"):
            if self.accept("as"):
                self.key()
            return self.source()
        if self.typed and self.accept("="):
            self.sequence()
            return self.end()
        if self.typed and self.is_("type") and self.peek() in ("{", "*"):
            self.i += 1
            return self.s_export_list()
        if self.is_("{"):
            return self.s_export_list()
        if not (self.is_("var", "let", "const", "function", "class", "async", "@", "import") or self.typed and self.is_("interface", "type", "enum", "abstract", "declare", "namespace", "module")):
            self.fail("expected a declaration")
        return self.statement()

    def s_anonymous(self) -> None:
        if self.kind("id"):
            self.name()
        self.function()

    def s_export_list(self) -> None:
        if self.accept("*"):
            return self.source()
        self.expect("{")
        self.commas(self.specifier, "}")
        return self.source() if self.is_("from") else self.end()

    # TypeScript's own statements

    def s_interface(self) -> bool | None:
        if not self.typed or self.k[self.i + 1] != "id" or self.fresh[self.i + 1]:
            return False
        self.i += 1
        self.name()
        self.type_parameters()
        if self.accept("extends"):
            self.type()
            while self.accept(","):
                self.type()
        self.expect("{")
        return self.type_members()

    def s_type(self) -> bool | None:
        if not self.typed or self.k[self.i + 1] != "id" or self.fresh[self.i + 1]:
            return False
        self.i += 1
        self.name()
        self.type_parameters()
        self.expect("=")
        self.type()
        return self.end()

    def s_enum(self) -> bool | None:
        if not self.typed:
            return False
        self.i += 1
        self.name()
        self.expect("{")

        def one() -> None:
            self.key()
            if self.accept("="):
                self.assign()

        return self.commas(one, "}")

    def s_declare(self) -> bool | None:
        if not self.typed or self.k[self.i + 1] != "id" or self.fresh[self.i + 1]:
            return False
        self.i += 1
        if self.accept("global"):
            self.expect("{")
            return self.block_until("}")
        return self.statement()

    def s_namespace(self) -> bool | None:
        if not self.typed or self.k[self.i + 1] not in ("id", "str") or self.fresh[self.i + 1]:
            return False
        self.i += 1
        if self.kind("str"):
            self.i += 1
        else:
            self.name()
            while self.accept("."):
                self.name()
        if self.accept("{"):
            return self.block_until("}")
        return self.end()

    s_module = s_namespace

    # types

    def annotation(self) -> None:
        if self.accept(":"):
            self.type()

    def result(self) -> None:
        if self.is_("asserts") and self.k[self.i + 1] == "id" and not self.fresh[self.i + 1]:
            self.i += 1
        if self.kind("id") and self.peek() == "is" and not self.fresh[self.i + 1]:
            self.i += 2
        self.type()

    def type_parameters(self) -> None:
        def one() -> None:
            while self.is_("const", "in", "out") and self.k[self.i + 1] == "id":
                self.i += 1
            self.name()
            if self.accept("extends"):
                self.type()
            if self.accept("="):
                self.type()

        if self.accept("<"):
            self.commas(one, ">")

    def type_arguments(self) -> None:
        self.expect("<")
        self.commas(self.type, ">")

    def type(self) -> None:
        self.union()
        if self.is_("extends") and not self.fresh[self.i] and not getattr(self, "no_condition", False):
            self.i += 1
            self.union()
            self.expect("?")
            self.type()
            self.expect(":")
            self.type()

    def union(self) -> None:
        self.accept("|", "&")
        self.one_type()
        while self.accept("|", "&"):
            self.one_type()

    def one_type(self) -> None:
        while self.is_("keyof", "unique", "readonly", "infer") and (self.k[self.i + 1] in ("id", "str") or self.peek() in ("(", "[", "{")):
            self.i += 1
        if self.accept("new") or self.is_("abstract") and self.peek() == "new":
            self.accept("new")
            self.accept("new")
            self.function_type()
        elif self.is_("<"):
            self.function_type()
        elif self.is_("("):
            if not self.attempt(self.function_type):
                self.i += 1
                self.type()
                self.expect(")")
        elif self.accept("{"):
            self.type_members()
        elif self.accept("["):

            def item() -> None:
                self.accept("...")
                if self.kind("id") and self.peek() in (":", "?") and not (self.peek() == "?" and self.peek(2) != ":"):
                    self.i += 1
                    self.accept("?")
                    self.expect(":")
                self.type()
                self.accept("?")

            self.commas(item, "]")
        elif self.kind("str", "num"):
            self.i += 1
        elif self.kind("template"):
            self.i += 1
            while self.kind("field"):
                self.i += 1
                self.type()
                if not self.kind("field_end"):
                    self.fail("expected the end of the field")
                self.i += 1
        elif self.accept("-"):
            if not self.kind("num"):
                self.fail("expected a number")
            self.i += 1
        elif self.accept("typeof"):
            if self.accept("import"):
                self.parenthesized()
            else:
                self.i += self.kind("id")
            while self.accept("."):
                self.key()
            if self.is_("<") and not self.fresh[self.i]:
                self.type_arguments()
        elif self.accept("import"):
            self.parenthesized()
            while self.accept("."):
                self.key()
            if self.is_("<"):
                self.type_arguments()
        elif self.kind("id") and (self.t[self.i] not in RESERVED or self.is_("void", "null", "this", "true", "false", "undefined")):
            self.i += 1
            while self.accept("."):
                self.key()
            if self.is_("<") and not self.fresh[self.i]:
                self.type_arguments()
        else:
            self.fail("expected a type")
        while self.is_("[") and not self.fresh[self.i]:
            self.i += 1
            if not self.accept("]"):
                self.type()
                self.expect("]")

    def function_type(self) -> None:
        self.type_parameters()
        self.expect("(")
        self.parameters()
        self.expect("=>")
        self.result()

    def index_signature(self) -> None:
        self.expect("[")
        self.name()
        if self.accept("in"):
            self.type()
            if self.accept("as"):
                self.type()
        else:
            self.expect(":")
            self.type()
        self.expect("]")
        if self.accept("-", "+"):
            self.expect("?")
        self.accept("?")
        self.annotation()

    def type_members(self) -> None:
        while not self.accept("}"):
            if self.accept("-", "+"):
                self.expect("readonly")
            while self.is_("readonly", "get", "set", "new") and self.peek() not in (":", "?", ";", ",", "}", "("):
                self.i += 1
            if self.is_("[") and self.k[self.i + 1] == "id" and self.peek(2) in (":", "in"):
                self.index_signature()
            else:
                if not self.is_("(", "<"):
                    self.key()
                    self.accept("?")
                if self.is_("(", "<"):
                    self.type_parameters()
                    self.expect("(")
                    self.parameters()
                    if self.accept(":"):
                        self.result()
                else:
                    self.annotation()
            if not self.accept(";", ",") and not self.is_("}") and not self.fresh[self.i]:
                self.fail("expected ';'")

    # expressions

    def assign(self) -> None:
        if self.is_("yield"):
            self.i += 1
            star = self.accept("*")
            if star or not self.fresh[self.i] and not self.is_(")", "]", "}", ",", ";", ":") and not self.kind("end"):
                self.assign()
            return
        if self.arrow():
            return
        start = self.i
        self.expression(1)
        if self.accept("?"):
            before, self.no_in = self.no_in, False
            self.assign()
            self.no_in = before
            self.expect(":")
            self.assign()
        elif self.is_(*self.ASSIGN) or self.is_("/="):
            last = self.i - 1
            if self.k[last] not in ("id",) and self.t[last] not in ("]", "}", ")", "!") or self.k[last] == "id" and self.t[last] in RESERVED and self.t[last - 1] != "." or self.t[last] == ")" and self.t[start] != "(":
                self.fail("cannot assign to this")
            self.i += 1
            self.assign()

    def arrow(self) -> bool:
        """An arrow function, if one stands here."""
        i = self.i
        if self.is_("async") and not self.fresh[i + 1] and (self.k[i + 1] == "id" and self.peek(2) == "=>" or self.peek() in ("(", "<")):
            self.i += 1
            if self.arrow():
                return True
            self.i = i
            return False
        if self.kind("id") and self.peek() == "=>" and self.t[i] not in RESERVED:
            self.i += 2
        elif self.is_("(") and i in self.pair:
            after = self.t[self.pair[i] + 1]
            if after == "=>":
                self.i += 1
                self.parameters()
                self.expect("=>")
            elif not (self.typed and after == ":" and self.attempt(self.typed_head)):
                return False
        elif not (self.typed and self.is_("<") and self.attempt(self.typed_head)):
            return False
        if self.accept("{"):
            before, self.no_in = self.no_in, False
            self.block_until("}")
            self.no_in = before
        else:
            self.assign()
        return True

    def typed_head(self) -> None:
        self.type_parameters()
        self.expect("(")
        self.parameters()
        if self.accept(":"):
            self.no_condition = True
            try:
                self.result()
            finally:
                self.no_condition = False
        self.expect("=>")

    def operand(self, op: str, least: int) -> None:
        self.expression(least)

    def expression(self, least: int = 0) -> None:
        self.unary()
        while True:
            if self.typed and self.is_("as", "satisfies") and not self.fresh[self.i]:
                self.i += 1
                if not self.accept("const"):
                    self.type()
                continue
            op = self.operator()
            if op is None or self.binary[op][0] < least:
                return
            power, right = self.binary[op]
            self.take_operator(op)
            self.expression(power if right else power + 1)

    def unary(self) -> None:
        while self.is_(*self.prefix):
            self.i += 1
        if self.accept("++", "--"):
            return self.unary()
        if self.typed and self.is_("<"):
            self.type_arguments()
            return self.unary()
        self.postfix()
        if self.is_("++", "--") and not self.fresh[self.i]:
            self.i += 1
        return None

    def postfix(self) -> None:
        self.member(calls=True)

    def arguments(self) -> None:
        def one() -> None:
            self.accept("...")
            self.assign()

        before, self.no_in = self.no_in, False
        self.commas(one, ")")
        self.no_in = before

    def member(self, calls: bool = True) -> None:
        if self.accept("new"):
            if self.accept("."):
                self.expect("target")
            else:
                self.member(calls=False)
                if self.typed and self.is_("<"):
                    self.attempt(self.type_arguments)
                if self.accept("("):
                    self.arguments()
        else:
            self.primary()
        while True:
            if self.accept("."):
                self.key_name()
            elif self.accept("?."):
                if self.accept("("):
                    self.arguments()
                elif self.accept("["):
                    self.sequence()
                    self.expect("]")
                else:
                    self.key_name()
            elif self.accept("["):
                before, self.no_in = self.no_in, False
                self.sequence()
                self.no_in = before
                self.expect("]")
            elif calls and self.accept("("):
                self.arguments()
            elif self.kind("template"):
                self.primary()
            elif self.typed and self.is_("!") and not self.fresh[self.i]:
                self.i += 1
            elif self.typed and calls and self.is_("<") and self.attempt(self.generic_call):
                continue
            else:
                return

    def generic_call(self) -> None:
        self.type_arguments()
        if not self.kind("template"):
            self.expect("(")
            self.arguments()

    def key_name(self) -> None:
        if not self.kind("id"):
            self.fail("expected a name")
        self.i += 1

    def primary(self) -> None:
        if self.kind("str", "num"):
            self.i += 1
        elif self.kind("template"):
            self.i += 1
            while self.kind("field"):
                self.i += 1
                self.sequence()
                if not self.kind("field_end"):
                    self.fail("expected the end of the field")
                self.i += 1
        elif self.accept("("):
            before, self.no_in = self.no_in, False
            self.sequence()
            self.no_in = before
            self.expect(")")
        elif self.accept("["):
            before, self.no_in = self.no_in, False
            while not self.accept("]"):
                if self.accept(","):
                    continue
                self.accept("...")
                self.assign()
                if not self.is_("]"):
                    self.expect(",")
            self.no_in = before
        elif self.is_("{"):
            self.object()
        elif self.is_("@"):
            self.decorators()
            self.primary()
        elif self.kind("id"):
            t = self.t[self.i]
            if t == "function" or t == "async" and self.peek() == "function" and not self.fresh[self.i + 1]:
                self.accept("async")
                self.i += 1
                self.accept("*")
                if self.kind("id"):
                    self.name()
                self.function()
            elif t == "class":
                self.s_class()
            elif t == "import":
                self.i += 1
                if self.accept("."):
                    self.key_name()
                elif not self.is_("("):
                    self.fail("expected '('")
            elif t == "super":
                self.i += 1
                if not self.is_("(", ".", "["):
                    self.fail("expected '.'")
            elif t in RESERVED and t not in ("this", "null", "true", "false"):
                self.fail("expected an expression")
            else:
                self.i += 1
        else:
            self.fail("expected an expression")

    def object(self) -> None:
        self.expect("{")
        before, self.no_in = self.no_in, False
        self.commas(self.object_member, "}")
        self.no_in = before

    def object_member(self) -> None:
        if self.accept("..."):
            return self.assign()
        plain = self.kind("id") and self.t[self.i] not in RESERVED
        if self.is_("async", "get", "set") and self.peek() not in (",", ":", "(", "}", "=") or self.is_("async") and self.peek() == "*":
            self.i += 1
            plain = False
        if self.accept("*"):
            plain = False
        self.key()
        if self.is_("(") or self.typed and self.is_("<"):
            return self.function()
        if self.accept(":"):
            return self.assign()
        if not plain:
            self.fail("expected ':'")
        if self.accept("="):
            self.assign()
        return None


