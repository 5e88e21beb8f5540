"""Ruby."""

from __future__ import annotations

import re

from fathomgrid.llm.syntax.base import Lexer, Parser, levels

KEYWORDS = frozenset("alias and begin BEGIN break case class def defined? do else elsif end END ensure false for if in module next nil not or redo rescue retry return self super then true undef unless until when while yield __FILE__ __LINE__ __method__ __ENCODING__".split())
#: Keywords after which a value may follow, so that '/', '[', '<<' and the like begin one.
_VALUE_NEXT = frozenset("and begin case do else elsif ensure if in not or rescue return then unless until when while yield puts p raise require".split())
_BRACKETS = {"(": ")", "[": "]", "{": "}", "<": ">"}


class RubyLexer(Lexer):
    pattern = re.compile(
        r"(?P<ws>[ \t\f\r\v]+|\\\r?\n)|(?P<block_comment>^=begin\b)|(?P<stop>^__END__\r?$)|(?P<nl>\n)|(?P<comment>#[^\n]*)"
        r"|(?P<heredoc><<[~-]?(?P<mark>[\"'`]?)(?P<label>[A-Za-z_]\w*)(?P=mark))|(?P<percent>%(?:[qQwWiIrsx])?[^\w\s])|(?P<slash>/)"
        r"|(?P<quoted>:?[\"'`])|(?P<label_key>[A-Za-z_\x80-￿]\w*[?!]?:(?!:))|(?P<symbol>:(?:[A-Za-z_\x80-￿]\w*[?!=]?(?![=~>])|[A-Za-z_]\w*[?!]?|\[\]=?|<=>|===?|=~|![=~]?|\*\*|[-+]@?|<<|>>|<=|>=|[*/%<>&|^~]))"
        r"|(?P<char>\?(?:\\.|[^\s\\])(?!\w))|(?P<num>0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO]?[0-7_]+(?!\d)|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?r?i?)"
        r"|(?P<var>@@?[A-Za-z_]\w*|\$(?:[A-Za-z_]\w*|\d+|-\w|[!@&~`'+*$?:\"<>,./\;=]))|(?P<id>[A-Za-z_\x80-￿]\w*(?:[?!](?![=~])|[?!](?==[=~>]))?)"
        r"|(?P<op>\*\*=|<=>|===|\.\.\.|<<=|>>=|&&=|\|\|=|&\.|=>|->|::|\*\*|==|!=|=~|!~|<=|>=|&&|\|\||\.\.|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|[-+*/%&|^~<>=!?:;,.(){}\[\]])",
        re.M,
    )
    plain = Lexer.plain | {"var"}

    def __init__(self, text: str):
        super().__init__(text)
        self.pending: list[tuple[str, bool]] = []

    def value_next(self) -> bool:
        """Whether a value may begin here, rather than an operator stand."""
        if not self.out.kind:
            return True
        k, t = self.out.kind[-1], self.out.text[-1]
        if k == "nl" or k == "label" or k == "op" and t not in (")", "]", "}"):
            return True
        if k == "id" and self.out.text[-2:-1] != ["."]:
            if t in _VALUE_NEXT:
                return True
            after = self.s[self.at + 1 : self.at + 2]
            return self.space and t not in KEYWORDS and bool(after) and not after.isspace() and after != "=" and t[0].islower()
        return False

    def newline(self) -> None:
        if self.pending:
            at = self.at + 1
            for label, squiggly in self.pending:
                m = re.compile(rf"^{'[ \t]*' if squiggly else ''}{label}\r?$", re.M).search(self.s, at)
                if not m:
                    self.fault("string never closed")
                    at = len(self.s)
                    break
                at = m.end()
            self.pending = []
            self.line += self.s.count("\n", self.at + 1, at)
            self.resume = at
        if self.out.kind and self.out.kind[-1] != "nl":
            self.out.add("nl", "\n", self.line, True, False)

    def run(self):
        self.resume = None
        s, n, match = self.s, len(self.s), self.pattern.match
        while self.at < n:
            m = match(s, self.at)
            if m is None:
                self.fault(f"stray character {s[self.at]!r}")
                self.at += 1
                continue
            group, text = m.lastgroup, m.group()
            if group == "ws":
                self.space = True
                self.line += text.count("\n")
                self.at = m.end()
            elif group == "nl":
                self.newline()
                self.line += 1
                self.at = m.end() if self.resume is None else self.resume
                self.resume = None
                self.space = True
            elif group == "comment":
                self.at = m.end()
            elif group == "stop":
                break
            elif group in self.plain:
                self.emit(group, text)
                self.at = m.end()
                if group == "num" and self.at < n and (s[self.at].isalnum() or s[self.at] == "_"):
                    self.fault("invalid number")
            else:
                getattr(self, "on_" + group)(m)
        self.newline()
        self.finish()
        return self.out

    def take(self, kind: str, text: str, end: int) -> None:
        lines = self.s.count("\n", self.at, end)
        self.emit(kind, text)
        self.line += lines
        self.at = end

    def on_block_comment(self, m: re.Match) -> None:
        end = re.compile(r"^=end\b[^\n]*", re.M).search(self.s, m.end())
        if not end:
            self.fault("comment never closed")
        stop = end.end() if end else len(self.s)
        self.line += self.s.count("\n", self.at, stop)
        self.at = stop

    def operator(self) -> None:
        """Read as an operator what stands where no value may begin."""
        m = re.compile(r"<<=?|%=?|/=?|\?|:").match(self.s, self.at)
        self.take("op", m.group(), m.end())

    def on_heredoc(self, m: re.Match) -> None:
        text = m.group()
        if text[2] in "~-" and (self.value_next() or self.space) or text[2] not in "~-" and self.value_next() and m.group("label")[0].isupper():
            self.pending.append((m.group("label"), text[2] in "~-"))
            self.take("str", "text", m.end())
        else:
            self.operator()

    def on_percent(self, m: re.Match) -> None:
        if not self.value_next() or m.group() == "%=":
            return self.operator()
        kind, open_ = m.group()[1:-1] or "Q", m.group()[-1]
        end = self.string_end(m.end(), _BRACKETS.get(open_, open_), open_ if open_ in _BRACKETS else "", kind in "QWIrx")
        return self.closed("str", end)

    def on_slash(self, m: re.Match) -> None:
        if not self.value_next():
            return self.operator()
        end = self.string_end(m.end(), "/", "", True)
        if end > 0:
            end = re.compile(r"[a-z]*").match(self.s, end).end()
        return self.closed("str", end)

    def on_quoted(self, m: re.Match) -> None:
        quote = m.group()[-1]
        if m.group()[0] == ":" and self.out.kind and not self.value_next() and not self.space:
            return self.operator()
        end = self.string_end(m.end(), quote, "", quote != "'")
        if end > 0 and self.s.startswith(":", end) and not self.s.startswith("::", end) and m.group()[0] != ":" and self.out.kind and self.out.text[-1] in ("{", ",", "(") :
            self.take("label", "text", end + 1)
            return None
        return self.closed("str", end)

    def closed(self, kind: str, end: int) -> None:
        if end < 0:
            self.fault("string never closed")
            end = len(self.s)
        self.take(kind, "text", end)

    def string_end(self, at: int, close: str, nest: str, fields: bool) -> int:
        s, n, depth = self.s, len(self.s), 0
        while at < n:
            c = s[at]
            if c == "\\":
                at += 2
            elif c == close:
                if not depth:
                    return at + 1
                depth -= 1
                at += 1
            elif nest and c == nest:
                depth += 1
                at += 1
            elif fields and c == "#" and s.startswith("#{", at):
                inner, at = 1, at + 2
                while at < n and inner:
                    if s[at] in "\"'`":
                        at = self.string_end(at + 1, s[at], "", s[at] != "'")
                        if at < 0:
                            return -1
                        continue
                    inner += (s[at] == "{") - (s[at] == "}")
                    at += 1
            else:
                at += 1
        return -1

    def on_label_key(self, m: re.Match) -> None:
        t = m.group()[:-1]
        after = self.s[m.end() : m.end() + 1]
        last = self.out.text[-1] if self.out.kind else ""
        if last == "?" or last == "." or after and not (after.isspace() or after in "\"'[{(,:)}|&*-@$") and not after.isalnum() or t in ("puts",) or self.ternary_open():
            self.take("id", t, m.end() - 1)
        else:
            self.take("label", t, m.end())

    def ternary_open(self) -> bool:
        """Whether a '?' on this line still waits for its ':'."""
        n = 0
        for k, t in zip(reversed(self.out.kind), reversed(self.out.text)):
            if k == "nl" or k == "op" and t in ("{", ",", "("):
                break
            if k == "op":
                n += (t == "?") - (t == ":")
        return n > 0

    def on_symbol(self, m: re.Match) -> None:
        if not self.value_next() and not self.space or self.ternary_open() and self.out.text[-1] != "?" and self.s[self.at - 1 : self.at].isspace() is False:
            return self.take("op", ":", self.at + 1)
        return self.take("str", m.group(), m.end())

    def on_char(self, m: re.Match) -> None:
        if self.value_next():
            self.take("str", m.group(), m.end())
        else:
            self.operator()


class RubyParser(Parser):
    reserved = KEYWORDS
    binary = levels(".. ...", "||", "&&", "<=> == === != =~ !~", "< <= > >=", "| ^", "&", "<< >>", "+ -", "* / %", "**", right="**")
    ASSIGN = frozenset("= += -= *= /= %= **= ||= &&= |= &= ^= <<= >>=".split())
    sync = frozenset((";",))
    no_do = False

    def program(self):
        self.skip()
        while not self.kind("end"):
            self.guarded(self.full)
        return self.errors

    def skip(self) -> None:
        while self.kind("nl") or self.accept(";"):
            self.i += self.kind("nl")

    def lines(self) -> None:
        while self.kind("nl"):
            self.i += 1

    def recover(self, start: int) -> None:
        self.i = max(self.i, start)
        while not self.kind("nl", "end"):
            self.i += 1
        self.skip()
        if self.i == start and not self.kind("end"):
            self.i += 1

    def full(self) -> None:
        """A statement with its end."""
        self.statement()
        if not (self.kind("nl", "end") or self.is_(";")):
            self.fail("expected the end of the statement")
        self.skip()

    def body(self, *ends: str) -> None:
        """Statements up to one of the words, which is left."""
        self.skip()
        while not self.is_(*ends):
            if self.kind("end"):
                self.fail(f"expected {ends[-1]!r}")
            start = self.i
            try:
                self.statement()
                if not (self.kind("nl") or self.is_(";", *ends)):
                    self.fail("expected the end of the statement")
            except Exception as fault:
                if not hasattr(fault, "cause"):
                    raise
                if self.kind("end"):
                    raise
                self.errors.append(fault)
                self.recover(start)
            self.skip()

    def statement(self) -> None:
        self.outer()
        while self.is_("if", "unless", "while", "until", "rescue"):
            self.i += 1
            self.outer()

    def outer(self) -> None:
        self.inner_not()
        while self.is_("and", "or"):
            self.i += 1
            self.lines()
            self.inner_not()

    def inner_not(self) -> None:
        if self.accept("not"):
            return self.inner_not()
        start = self.i
        self.expression_statement()
        if self.is_(",") and self.t[start] not in ("return", "break", "next", "yield") and self.assignable(start):
            while self.accept(","):
                if self.is_("="):
                    break
                self.accept("*")
                self.expression()
            if not self.is_("="):
                self.fail("expected '='")
            self.i += 1
            self.lines()
            self.values()
        elif self.is_("=>", "in") and self.t[start] != "for":
            self.i += 1
            self.pattern()
        return None

    def assignable(self, start: int) -> bool:
        return self.k[start] in ("id", "var") or self.t[start] in ("*", "(")

    def expression_statement(self) -> None:
        if self.is_("*") and self.k[self.i + 1] in ("id", "var"):
            self.i += 1
        self.expression()

    def values(self) -> None:
        while True:
            self.accept("*")
            self.expression()
            if not self.accept(","):
                return
            self.lines()

    # expressions

    def expression(self, least: int = 0) -> None:
        start = self.i
        super().expression(least)
        if least:
            return
        if self.is_("?"):
            self.i += 1
            self.lines()
            self.expression()
            self.lines()
            if self.kind("label"):
                self.fail("expected ':'")
            self.expect(":")
            self.lines()
            self.expression()
        elif self.is_(*self.ASSIGN):
            last = self.i - 1
            if self.k[last] in ("num", "str") or self.t[last] in (")", "}") or self.k[last] == "id" and self.t[last] in KEYWORDS and self.t[last - 1] != "." or self.t[start] in ("!", "-"):
                self.fail("cannot assign to this")
            self.i += 1
            self.lines()
            self.values()
            if self.is_("rescue"):
                self.i += 1
                self.expression()

    def operator(self) -> str | None:
        t = self.t[self.i]
        if self.kind("op") and t in self.binary:
            return t
        if self.kind("nl"):  # a line that begins with '.' or '&&' goes on
            j = self.i
            while self.k[j] == "nl":
                j += 1
            if self.k[j] == "op" and self.t[j] in ("&&", "||"):
                self.i = j
                return self.t[j]
        return None

    def operand(self, op: str, least: int) -> None:
        if op in ("..", "...") and (self.kind("nl", "end") or self.is_(")", "]", "then", ",")):
            return
        self.lines()
        if self.is_("not"):
            self.fail("expected an expression")
        if op in ("||", "&&") and self.is_("raise", "return", "break", "next"):
            return self.expression()
        self.expression(least)
        if self.is_("=") and op in ("||", "&&"):
            self.i += 1
            self.expression()

    def unary(self) -> None:
        if self.is_("!", "-", "+", "~", "&", "*", "**", "..", "..."):
            self.i += 1
            return self.unary()
        if self.accept("defined?"):
            return self.unary()
        return self.postfix()

    def postfix(self) -> None:
        self.primary()
        while True:
            if self.kind("nl"):
                j = self.i
                while self.k[j] == "nl":
                    j += 1
                if self.k[j] == "op" and self.t[j] in (".", "&."):
                    self.i = j
                else:
                    return
            if self.accept(".", "&."):
                self.lines()
                if self.is_("("):
                    self.arguments()
                else:
                    if self.kind("label"):
                        self.fail("expected a method")
                    if not self.kind("id") and not self.is_("+", "-", "*", "/", "==", "<=>", "<<", "!", "[", "%", "<", ">"):
                        self.fail("expected a method")
                    self.i += 1
                    self.call()
            elif self.accept("::"):
                if not self.kind("id"):
                    self.fail("expected a name")
                self.i += 1
                self.call()
            elif self.is_("[") and not self.space[self.i]:
                self.i += 1
                self.listed("]")
            elif self.is_("{") and self.callable_here():
                self.braces()
            elif self.is_("do") and not self.no_do:
                self.do_block()
            else:
                return

    def callable_here(self) -> bool:
        last = self.i - 1
        return self.t[last] == ")" or self.k[last] == "id" and (self.t[last] not in KEYWORDS or self.t[last] in ("super",) or self.t[last - 1] == ".")

    def call(self) -> None:
        """Arguments after a method's name, in brackets or without."""
        if self.is_("(") and not self.space[self.i]:
            return self.arguments()
        if self.command_starts():
            return self.command()
        return None

    def arguments(self) -> None:
        self.expect("(")
        before, self.no_do = self.no_do, False
        self.listed(")")
        self.no_do = before

    def argument(self) -> None:
        self.lines()
        if self.accept("*", "**", "&"):
            if self.is_(")", ",", "]"):
                return
        if self.kind("label"):
            self.i += 1
            self.lines()
            if self.is_(",", ")", "]", "}"):
                return
            self.no_command_expression()
            return
        self.no_command_expression()
        self.lines_before("=>")
        if self.accept("=>"):
            self.lines()
            self.expression()

    def no_command_expression(self) -> None:
        if self.accept("not"):
            pass
        self.expression()

    def lines_before(self, *texts: str) -> None:
        j = self.i
        while self.k[j] == "nl":
            j += 1
        if j > self.i and self.t[j] in texts and self.k[j] == "op":
            self.i = j

    def listed(self, close: str) -> None:
        self.lines()
        while not self.accept(close):
            self.argument()
            self.lines()
            if not self.accept(","):
                if self.is_("for", "if", "unless") and close == ")":
                    self.i += 1
                    self.outer()
                self.expect(close)
                return
            self.lines()

    def command_starts(self) -> bool:
        """Whether arguments without brackets begin here."""
        i = self.i
        if self.fresh[i] or not self.space[i]:
            return False
        k, t = self.k[i], self.t[i]
        if k in ("str", "num", "var", "label"):
            return True
        if k == "id":
            return t not in KEYWORDS or t in ("nil", "true", "false", "self", "not", "defined?", "super", "__FILE__", "__method__", "__LINE__", "case", "yield", "def", "begin") or t == "if" and False
        if k == "op":
            tight = not self.space[i + 1] and self.k[i + 1] != "nl"
            if t in ("[", "->", "!", "::", "~"):
                return t != "!" or tight
            if t in ("*", "&", "-", "**", ":") and tight:
                return True
            if t == "(":
                return True
        return False

    def command(self) -> None:
        while True:
            self.argument()
            if not self.accept(","):
                return
            self.lines()

    def braces(self) -> None:
        self.expect("{")
        before, self.no_do = self.no_do, False
        self.block_parameters()
        self.body("}")
        self.no_do = before
        self.expect("}")

    def do_block(self) -> None:
        self.expect("do")
        before, self.no_do = self.no_do, False
        self.lines()
        self.block_parameters()
        self.rescued()
        self.no_do = before

    def block_parameters(self) -> None:
        if self.accept("||"):
            return
        if self.accept("|"):
            self.parameters("|")

    def parameters(self, close: str) -> None:
        self.lines()
        while not self.accept(close):
            if self.accept("("):
                self.parameters(")")
            elif self.accept(";"):
                continue
            elif self.accept("*", "**", "&", "..."):
                if self.kind("id"):
                    self.i += 1
            elif self.kind("label"):
                self.i += 1
                if not self.is_(",", close) and not self.kind("nl"):
                    self.expression(2 if close != "|" else 7)
            else:
                self.name()
                if self.accept("="):
                    self.expression(0 if close != "|" else 7)
            self.lines() if close == ")" else None
            if not self.accept(","):
                if self.accept(";"):
                    continue
                self.expect(close)
                return
            self.lines()

    def rescued(self) -> None:
        """A body with rescue, else and ensure, up to and with 'end'."""
        self.body("rescue", "else", "ensure", "end")
        while self.accept("rescue"):
            while not (self.kind("nl") or self.is_("then", ";")):
                if self.accept("=>"):
                    self.i += 1
                    break
                self.accept("*")
                self.expression(2)
                if not self.accept(","):
                    if self.is_("=>"):
                        continue
                    break
                self.lines()
            self.accept("then")
            self.body("rescue", "else", "ensure", "end")
        if self.accept("else"):
            self.body("ensure", "end")
        if self.accept("ensure"):
            self.body("end")
        self.expect("end")

    def condition(self) -> None:
        before, self.no_do = self.no_do, True
        self.outer()
        self.no_do = before

    def then(self) -> None:
        if not (self.kind("nl") or self.is_("then", ";")):
            self.fail("expected the end of the line")
        self.skip()
        self.accept("then")

    def primary(self) -> None:
        before = self.no_do
        if self.kind("str"):
            self.i += 1
            while self.kind("str") and self.space[self.i]:
                self.i += 1
        elif self.kind("num", "var"):
            self.i += 1
        elif self.accept("("):
            self.no_do = False
            self.body(")")
            self.no_do = before
            self.expect(")")
        elif self.accept("["):
            self.no_do = False
            self.listed("]")
            self.no_do = before
        elif self.accept("{"):
            self.no_do = False
            self.hash()
            self.no_do = before
        elif self.accept("->"):
            if self.accept("("):
                self.parameters(")")
            elif self.kind("id"):
                self.name()
                while self.accept(","):
                    self.name()
            if self.is_("{"):
                self.i += 1
                self.body("}")
                self.expect("}")
            else:
                self.do_block()
        elif self.accept("::"):
            self.name()
        elif self.kind("id"):
            rule = getattr(self, "p_" + self.t[self.i].rstrip("?!"), None) if self.t[self.i] in KEYWORDS else None
            if rule:
                self.no_do = False if self.t[self.i] not in ("yield", "super", "not", "return", "break", "next") else before
                rule()
                self.no_do = before
            elif self.t[self.i] in KEYWORDS:
                self.fail("expected an expression")
            else:
                self.i += 1
                self.call()
        else:
            self.fail("expected an expression")

    def hash(self) -> None:
        self.lines()
        while not self.accept("}"):
            if self.accept("**"):
                self.expression()
            elif self.kind("label"):
                self.i += 1
                self.lines()
                if not self.is_(",", "}"):
                    self.expression()
            else:
                self.expression()
                self.lines()
                self.expect("=>")
                self.lines()
                self.expression()
            self.lines()
            if not self.accept(","):
                self.expect("}")
                return
            self.lines()

    def p_nil(self) -> None:
        self.i += 1

    p_true = p_false = p_self = p___FILE__ = p___LINE__ = p___method__ = p___ENCODING__ = p_redo = p_retry = p_nil

    def p_not(self) -> None:
        self.i += 1
        self.expression()

    def p_super(self) -> None:
        self.i += 1
        self.call()

    p_yield = p_super

    def p_return(self) -> None:
        self.i += 1
        if not (self.kind("nl", "end") or self.is_("if", "unless", "while", "until", ";", "}", ")", "end", "and", "or")):
            self.values()

    p_break = p_next = p_return

    def p_if(self) -> None:
        self.i += 1
        self.condition()
        self.then()
        self.body("elsif", "else", "end")
        while self.accept("elsif"):
            self.condition()
            self.then()
            self.body("elsif", "else", "end")
        if self.accept("else"):
            self.body("end")
        self.expect("end")

    def p_unless(self) -> None:
        self.i += 1
        self.condition()
        self.then()
        self.body("else", "end")
        if self.accept("else"):
            self.body("end")
        self.expect("end")

    def p_while(self) -> None:
        self.i += 1
        self.condition()
        if not (self.kind("nl") or self.is_("do", ";")):
            self.fail("expected the end of the line")
        self.accept("do")
        self.body("end")
        self.expect("end")

    p_until = p_while

    def p_for(self) -> None:
        self.i += 1
        while True:
            self.name()
            if not self.accept(","):
                break
        self.expect("in")
        self.condition()
        self.accept("do")
        self.body("end")
        self.expect("end")

    def p_case(self) -> None:
        self.i += 1
        if not self.kind("nl"):
            self.outer()
        self.skip()
        if not self.is_("when", "in"):
            self.fail("expected when")
        while self.is_("when", "in"):
            if self.accept("in"):
                self.pattern()
            else:
                self.i += 1
                while True:
                    self.accept("*")
                    self.lines()
                    self.expression()
                    if not self.accept(","):
                        break
                    self.lines()
            self.then()
            self.body("when", "in", "else", "end")
        if self.accept("else"):
            self.body("end")
        self.expect("end")

    def pattern(self) -> None:
        """Patterns are read as runs of tokens with balanced brackets."""
        some = False
        while not (self.kind("nl", "end") or self.is_("then", ";", ")", "}", "and", "or") or self.is_("if", "unless") and some):
            if self.is_("(", "[", "{"):
                if self.i not in self.pair:
                    self.fail("bracket never closed")
                self.i = self.pair[self.i]
            self.i += 1
            some = True
        if not some:
            self.fail("expected a pattern")
        if self.accept("if", "unless"):
            self.expression()

    def p_begin(self) -> None:
        self.i += 1
        self.rescued()

    def p_def(self) -> None:
        self.i += 1
        if self.is_("self") or self.kind("id") and self.peek() == "." and not self.space[self.i + 1]:
            if self.peek() == ".":
                self.i += 2
        if self.kind("label"):
            self.fail("expected a method's name")
        if self.kind("id"):
            self.i += 1
            if self.is_("=") and not self.space[self.i] and self.peek() == "(":
                self.i += 1
        elif self.is_("["):
            self.i += 1
            self.expect("]")
            self.accept("=")
        elif self.kind("op") and not self.is_("(", ")", "{", "}", ";", ",", ".", ":"):
            self.i += 1
            if self.is_("@"):
                self.i += 1
        else:
            self.fail("expected a method's name")
        if self.accept("("):
            self.parameters(")")
        elif not self.kind("nl") and not self.is_(";", "="):
            self.bare_parameters()
        if self.accept("="):
            self.lines()
            return self.statement()
        if not (self.kind("nl") or self.is_(";")) and self.t[self.i - 1] != ")":
            self.fail("expected the end of the line")
        if self.is_(":") or self.kind("label"):
            self.fail("expected the end of the line")
        return self.rescued()

    def bare_parameters(self) -> None:
        while True:
            if self.accept("*", "**", "&"):
                self.name()
            elif self.kind("label"):
                self.i += 1
                if not self.kind("nl") and not self.is_(","):
                    self.expression(2)
            else:
                self.name()
                if self.accept("="):
                    self.expression()
            if not self.accept(","):
                return

    def constant(self) -> None:
        self.accept("::")
        while True:
            if not self.kind("id") or not self.t[self.i][0].isupper():
                self.fail("expected a constant")
            self.i += 1
            if not self.accept("::"):
                return

    def p_class(self) -> None:
        self.i += 1
        if self.accept("<<"):
            self.expression()
        else:
            self.constant()
            if self.accept("<"):
                self.expression()
        if not (self.kind("nl") or self.is_(";")):
            self.fail("expected the end of the line")
        self.rescued()

    def p_module(self) -> None:
        self.i += 1
        self.constant()
        if not (self.kind("nl") or self.is_(";")):
            self.fail("expected the end of the line")
        self.rescued()

    def p_alias(self) -> None:
        self.i += 3

    def p_undef(self) -> None:
        self.i += 2

    def p_BEGIN(self) -> None:
        self.i += 1
        self.braces()

    p_END = p_BEGIN
