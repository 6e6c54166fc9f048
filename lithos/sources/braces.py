"""Tokens of languages with braces, and the complexity of their statements (SCL-04, SCL-05).

There is no grammar: a lexer knows strings, templates, comments, regular
expressions and markup inside scripts, brackets are matched, and control
statements are followed by their keywords, so that braces themselves carry no meaning.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

WORD = re.compile(r"[^\W\d][\w$]*|[$#][\w$]*")
NUMBER = re.compile(r"\d[\w.]*|\.\d[\w.]*")
OPERATOR = re.compile(r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|=>|->|::|==|!=|<=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|.", re.S)
OPEN, CLOSE = {"(": ")", "[": "]", "{": "}", "${": "}"}, {")", "]", "}"}
#: Words after which a slash begins a regular expression and a smaller-than sign markup.
BEFORE_VALUE = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "do", "else", "yield", "await", "default", "extends"}


@dataclass
class Tokens:
    """Texts, kinds (w: word, n: number, s: string, p: part of a template, o: the rest), lines, places and bracket partners."""

    source: str
    text: list[str] = field(default_factory=list)
    kind: list[str] = field(default_factory=list)
    line: list[int] = field(default_factory=list)
    start: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)
    last: list[int] = field(default_factory=list)
    match: dict[int, int] = field(default_factory=dict)

    def at(self, i: int) -> str:
        return self.text[i] if 0 <= i < len(self.text) else ""

    def words(self, i: int) -> bool:
        return 0 <= i < len(self.kind) and self.kind[i] == "w"

    def after(self, i: int) -> int:
        """The place after the bracket that opens at i."""
        return self.match.get(i, len(self.text) - 1) + 1


class Lexer:
    def __init__(self, source: str, script: bool, markup: bool):
        self.s, self.script, self.markup = source, script, markup
        self.out, self.pos, self.row = Tokens(source), 0, 1

    def add(self, kind: str, start: int, end: int) -> None:
        piece = self.s[start:end]
        o = self.out
        o.text.append(piece)
        o.kind.append(kind)
        o.line.append(self.row)
        o.start.append(start)
        o.end.append(end)
        self.row += piece.count("\n")
        o.last.append(self.row)
        self.pos = end

    def value_next(self) -> bool:
        """Whether a value, not an operator, comes next."""
        o = self.out
        if not o.text:
            return True
        if o.kind[-1] == "w":
            return o.text[-1] in BEFORE_VALUE
        return o.kind[-1] == "o" and o.text[-1] not in (")", "]", "}")

    def quoted(self, quote: str) -> int:
        k = self.pos + 1
        while k < len(self.s) and self.s[k] != quote and self.s[k] != "\n":
            k += 2 if self.s[k] == "\\" else 1
        return min(k + 1, len(self.s))

    def run(self, until: str | None = None) -> None:
        """Tokens up to the bracket ``until`` that closes what the caller opened, or to the end."""
        s, deep = self.s, 0
        while self.pos < len(s):
            c = s[self.pos]
            if c.isspace():
                self.row += c == "\n"
                self.pos += 1
            elif s.startswith("//", self.pos):
                e = s.find("\n", self.pos)
                self.pos = len(s) if e < 0 else e
            elif s.startswith("/*", self.pos):
                e = s.find("*/", self.pos + 2)
                e = len(s) if e < 0 else e + 2
                self.row += s.count("\n", self.pos, e)
                self.pos = e
            elif s.startswith('"""', self.pos) and not self.script:
                e = s.find('"""', self.pos + 3)
                self.add("s", self.pos, len(s) if e < 0 else e + 3)
            elif c in "\"'":
                self.add("s", self.pos, self.quoted(c))
            elif c == "`" and self.script:
                self.template()
            elif m := NUMBER.match(s, self.pos):
                self.add("n", self.pos, m.end())
            elif m := WORD.match(s, self.pos):
                self.add("w", self.pos, m.end())
            elif c == "/" and self.script and self.value_next() and (e := self.pattern()):
                self.add("s", self.pos, e)
            elif c == "<" and self.markup and self.value_next() and re.match(r"<(>|[A-Za-z][\w.:-]*(?!\s*(,|extends\b)))", s[self.pos : self.pos + 200]):
                self.element()
            else:
                if until and c == until and deep == 0:
                    return
                deep += (c in OPEN) - (c in CLOSE)
                self.add("o", self.pos, OPERATOR.match(s, self.pos).end())

    def pattern(self) -> int:
        k, inside = self.pos + 1, False
        while k < len(self.s) and self.s[k] != "\n":
            c = self.s[k]
            if c == "\\":
                k += 1
            elif c == "/" and not inside:
                return re.compile(r"/\w*").match(self.s, k).end()
            else:
                inside = c == "[" or inside and c != "]"
            k += 1
        return 0

    def template(self) -> None:
        k = self.pos + 1
        while k < len(self.s) and self.s[k] != "`":
            if self.s[k] == "\\":
                k += 2
            elif self.s.startswith("${", k):
                if k > self.pos:
                    self.add("p", self.pos, k)
                self.inner("${")
                k = self.pos
            else:
                k += 1
        self.add("p", self.pos, min(k + 1, len(self.s)))

    def inner(self, opening: str) -> None:
        """An expression in braces inside a template or markup."""
        self.add("o", self.pos, self.pos + len(opening))
        self.run("}")
        if self.pos < len(self.s):
            self.add("o", self.pos, self.pos + 1)

    def element(self) -> None:
        """Markup: its words are dropped, expressions in braces are kept."""
        s = self.s
        self.add("p", self.pos, re.compile(r"<[\w.:-]*").match(s, self.pos).end())
        while self.pos < len(s) and s[self.pos] != ">":  # attributes
            if s[self.pos] == "{":
                self.inner("{")
            elif s[self.pos] in "\"'":
                e = s.find(s[self.pos], self.pos + 1)
                self.skip(len(s) if e < 0 else e + 1)
            elif s.startswith("/>", self.pos):
                self.skip(self.pos + 2)
                return
            else:
                self.skip(self.pos + 1)
        self.skip(self.pos + 1)
        while self.pos < len(s):  # children
            if s[self.pos] == "{":
                self.inner("{")
            elif s.startswith("</", self.pos):
                e = s.find(">", self.pos)
                self.skip(len(s) if e < 0 else e + 1)
                return
            elif s[self.pos] == "<":
                self.element()
            else:
                self.skip(self.pos + 1)

    def skip(self, end: int) -> None:
        self.row += self.s.count("\n", self.pos, end)
        self.pos = end


def tokens(source: str, script: bool = True, markup: bool = False) -> Tokens:
    lexer = Lexer(source, script, markup)
    lexer.run()
    out, stack = lexer.out, []
    for i, (t, k) in enumerate(zip(out.text, out.kind, strict=True)):
        if k != "o":
            continue
        if t in OPEN:
            stack.append(i)
        elif t in CLOSE:
            while stack and OPEN[out.text[stack[-1]]] != t:
                stack.pop()
            if stack:
                out.match[stack.pop()] = i
    return out


#: Tokens that go on from the line before, or to the next one.
GOES_ON = {".", "?.", "(", "[", "{", ",", "=", "=>", "->", "?", ":", "&&", "||", "??", "+", "-", "*", "/", "%", "==", "===", "!=", "!==", "<", ">", "<=", ">=", "&", "|", "^", "+=", "-=", "as", "instanceof", "in", "of", "extends", "implements"}


def expression_end(t: Tokens, i: int, stops: tuple[str, ...] = (";",)) -> int:
    """The place of the token that ends an expression: a stop, a closing bracket, ``else``, or one that begins a new line."""
    first = i
    while i < len(t.text):
        x = t.text[i]
        if t.kind[i] == "o":
            if x in stops or x in CLOSE:
                return i
        elif x == "else" and t.words(i):
            return i
        if i > first and t.line[i] > t.last[i - 1] and x not in GOES_ON and t.text[i - 1] not in GOES_ON and t.kind[i] != "p":
            return i
        i = t.after(i) if t.kind[i] == "o" and x in OPEN else i + 1
    return i


def control(t: Tokens, i: int) -> str:
    """The control statement that begins at i, or none."""
    x = t.text[i]
    if t.kind[i] != "w" or t.at(i - 1) in (".", "?."):
        return ""
    follows = t.at(i + 1)
    if x in ("if", "while", "switch") and follows == "(" or x == "for" and follows in ("(", "await") or x == "try" and follows in ("{", "(") or x == "do" and follows not in (":", ",", ")", "(", "="):
        return x
    return ""


def statement_end(t: Tokens, i: int) -> int:
    """The place after the statement that begins at i."""
    if t.at(i) == "{":
        return t.after(i)
    what = control(t, i) if i < len(t.text) else ""
    if what == "if":
        i = statement_end(t, t.after(i + 1))
        return statement_end(t, i + 1) if t.at(i) == "else" else i
    if what in ("for", "while"):
        return statement_end(t, t.after(i + 1 + (t.at(i + 1) == "await")))
    if what == "do":
        i = statement_end(t, i + 1)
        i = t.after(i + 1) if t.at(i) == "while" else i
        return i + (t.at(i) == ";")
    if what == "try":
        i = t.after(i + 1) if t.at(i + 1) == "{" else t.after(t.after(i + 1))
        while t.at(i) == "catch":
            i = t.after(t.after(i + 1)) if t.at(i + 1) == "(" else t.after(i + 1)
        return t.after(i + 1) if t.at(i) == "finally" else i
    if what == "switch":
        return t.after(t.after(i + 1))
    i = expression_end(t, i)
    return i + (t.at(i) == ";")


@dataclass(frozen=True)
class Style:
    """What differs between languages (UDF-02): operators that branch, whether else nests, whether a case counts its nesting."""

    operators: frozenset = frozenset({"&&", "||", "??"})
    else_nests: bool = True
    case_nests: bool = True


SCRIPT, JAVA = Style(), Style(frozenset({"&&", "||"}), False, False)
#: Tokens after a question mark that is no choice between two values.
NO_CHOICE = {":", ",", ")", "=", ";", ">", "extends", "super", "]", "&", "}", "|"}


def complexity(t: Tokens, begin: int, end: int, style: Style = SCRIPT) -> tuple[int, int, int]:
    """Cyclomatic and cognitive complexity and nesting depth of the tokens from begin to end."""
    cyc, cog, deepest = 1, 0, 0
    todo = [(begin, end, 0)]

    def branch(nest: int) -> None:
        nonlocal cyc, cog
        cyc, cog = cyc + 1, cog + 1 + nest

    def inside(a: int, e: int, depth: int) -> None:
        nonlocal deepest
        deepest = max(deepest, depth)
        todo.append((a, e, depth))

    while todo:
        i, stop, depth = todo.pop()
        while i < stop:
            what = control(t, i)
            if not what:
                x = t.text[i]
                if t.kind[i] == "o" and x in style.operators:
                    cyc, cog = cyc + 1, cog + 1
                elif t.kind[i] == "o" and x == "?" and t.at(i + 1) not in NO_CHOICE:
                    branch(depth)
                elif t.kind[i] == "w" and x == "case" and t.at(i - 1) not in (".", "?.") and t.at(i + 1) not in (":", ",", "=", "("):
                    branch(depth if style.case_nests else 0)
                i += 1
                continue
            after = statement_end(t, i)
            if what == "if":
                branch(depth)
                then = t.after(i + 1)
                other = statement_end(t, then)
                inside(i + 1, other, depth + 1)
                if t.at(other) == "else":
                    inside(other + 1, after, depth + 1 + style.else_nests)
            elif what == "try":
                body = i + 1 if t.at(i + 1) == "{" else t.after(i + 1)
                k = t.after(body)
                inside(i + 1, k, depth + 1)
                while t.at(k) == "catch":
                    branch(depth + 1)
                    e = t.after(t.after(k + 1)) if t.at(k + 1) == "(" else t.after(k + 1)
                    inside(k + 1, e, depth + 2)
                    k = e
                inside(k, after, depth + 1)
            else:
                if what != "switch":
                    branch(depth)
                inside(i + 1, after, depth + 1) if what != "do" else do_body(t, i, after, depth, inside)
            i = max(after, i + 1)
    return cyc, cog, deepest


def do_body(t: Tokens, i: int, after: int, depth: int, inside) -> None:
    """A do statement's body and, after its ``while``, the condition."""
    e = statement_end(t, i + 1)
    inside(i + 1, e, depth + 1)
    if t.at(e) == "while":
        inside(e + 1, after, depth + 1)


def parted(t: Tokens, begin: int, end: int) -> list[tuple[int, int]]:
    """The parts between commas outside brackets of any kind, angle brackets of types included; empty ones drop out."""
    out, at, i, angle = [], begin, begin, 0
    while i < end:
        x = t.text[i]
        if x == "<" and t.words(i - 1):
            angle += 1
        elif angle and t.kind[i] == "o" and x and set(x) == {">"}:
            angle = max(0, angle - len(x))
        elif x == "," and not angle:
            out.append((at, i))
            at = i + 1
        i = t.after(i) if t.kind[i] == "o" and x in OPEN else i + 1
    out.append((at, end))
    return [(a, e) for a, e in out if a < e]


def lines_of_code(text: str) -> int:
    """SCL-02: lines outside blank ones and comments that begin a line; code behind a block comment's end counts."""
    n, block = 0, False
    for line in (x.strip() for x in re.split(r"\r?\n", text)):
        if block and line:
            _, ended, line = line.partition("*/")
            block, line = not ended, line.strip()
        if not line or line.startswith("//"):
            continue
        if line.startswith("/*"):
            _, ended, tail = line[2:].partition("*/")
            block = not ended
            n += bool(tail.strip())
        else:
            n += 1
    return n
