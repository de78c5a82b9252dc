"""Structured text: tokens, statements and declarations. A reader with a token of lookahead, for a unit's code at a time."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

_FORMS = {
    "space": r"\s+",
    "skip": r"//[^\n]*|\{[^}]*\}",
    "open": r"\(\*",
    "string": r"""'(?:[^'$]|\$.)*'|"(?:[^"$]|\$.)*\"""",
    "literal": r"(?i:(?:D|DT|TOD|LD|LDT|LTOD|DATE|DATE_AND_TIME|TIME_OF_DAY)\#[\d:.-]+)|(?:[^\W\d]\w*|\d+)\#[-+]?\w+(?:\.\w+)?(?:\#\w+)?|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][-+]?\d+)?",
    "address": r"%(?:\*|(?i:[A-Za-z]+)\*?(?:\d+(?:\.\d+)*)?)",
    "name": r"[^\W\d]\w*",
    "mark": r":=|=>|<>|<=|>=|\*\*|\.\.|[-+*/=<>&^.,;:()\[\]]",
}
_TOKEN = re.compile("|".join(f"(?P<{k}>{form})" for k, form in _FORMS.items()), re.S)
#: The same without groups, for findall(): what is frequent first, comments that hold no other one as a whole, then what has
#: no end or is no token.
_TEXT = re.compile("|".join([r"[^\W\d]\w*+(?!\#)", _FORMS["space"], r"[,;)\[\]]", _FORMS["skip"], r"\(\*(?:[^*(]++|\*(?!\))|\((?!\*))*+\*\)", *list(_FORMS.values())[2:], r"""['"][^\n]*|."""]), re.S)
_BLOCK = re.compile(r"\(\*|\*\)")
#: Words that end a block of statements.
ENDS = frozenset("END_IF END_CASE END_FOR END_WHILE END_REPEAT ELSIF ELSE UNTIL END_PROGRAM END_FUNCTION END_FUNCTION_BLOCK END_METHOD END_ACTION END_PROPERTY END_VAR".split())
RESERVED = ENDS | frozenset("IF THEN CASE OF FOR TO BY DO WHILE REPEAT EXIT CONTINUE RETURN AND OR XOR NOT MOD VAR".split())
#: Operators by how tightly they bind.
BINDS = {"OR": 1, "OR_ELSE": 1, "XOR": 2, "AND": 3, "&": 3, "AND_THEN": 3, "=": 4, "<>": 4, "<": 5, ">": 5, "<=": 5, ">=": 5, "+": 6, "-": 6, "*": 7, "/": 7, "MOD": 7, "**": 8}


class Token(NamedTuple):
    kind: str
    text: str
    line: int
    #: Whether space or a comment stands before it.
    spaced: bool
    #: Its text in capitals, if it is a name or mark.
    word: str


#: (kind, word, line breaks) of short texts that tokens() met, numbers and strings left out; at most _MOST of them.
_KNOWN: dict[str, tuple[str, str, int]] = {}
_MOST = 20_000


def _kind(text: str) -> tuple[str, str, int]:
    if "0" <= text[0] <= "9":
        return "literal", "", 0
    m = _TOKEN.match(text)
    kind = m.lastgroup if m else "string" if text[0] in "'\"" else "other"
    found = ("skip" if kind in ("space", "open") else kind, text.upper() if kind in ("name", "mark") else "", text.count("\n"))
    if kind in ("space", "name", "mark") and len(text) < 64:
        if len(_KNOWN) >= _MOST:
            _KNOWN.clear()
        _KNOWN[text] = found
    return found


def _texts(code: str) -> list[str]:
    """The texts that code is made of, all of it; a comment with others in it, or without an end, is one."""
    out = _TEXT.findall(code)
    if "(*" not in code or "(*" not in out:
        return out
    out, at = [], 0
    while at < len(code):
        end = _TEXT.match(code, at).end()
        if code[at:end] == "(*":
            depth = 1
            while depth and (b := _BLOCK.search(code, end)):
                depth, end = depth + (1 if b[0] == "(*" else -1), b.end()
            end = len(code) if depth else end
        out.append(code[at:end])
        at = end
    return out


def tokens(code: str) -> list[Token]:
    """Tokens without space, pragmas and comments, which may be nested; a character of no token is one of kind other, a string
    or comment without an end goes on to the end of its line or of the text."""
    out, line, spaced, known, new = [], 1, False, _KNOWN.get, tuple.__new__
    for text in _texts(code):
        kind, word, lines = known(text) or _kind(text)
        if kind == "skip":
            spaced = True
        else:
            out.append(new(Token, (kind, text, line, spaced, word)))
            spaced = False
        line += lines
    return out


def joined(ts: list[Token]) -> str:
    """Tokens as text, with one space where the code has any."""
    return "".join([ts[0].text, *[" " + t.text if t.spaced else t.text for t in ts[1:]]]) if ts else ""


def strip_comments(code: str) -> str:
    """Code without comments and pragmas; strings and line numbers stay."""
    out, at = [], 0
    while at < len(code):
        m = _TOKEN.match(code, at)
        end = m.end() if m else at + 1
        if m and m.lastgroup == "open":
            depth = 1
            while depth and (b := _BLOCK.search(code, end)):
                depth, end = depth + (1 if b[0] == "(*" else -1), b.end()
            end = len(code) if depth else end
        gone = m and m.lastgroup in ("skip", "open")
        out.append("\n" * code.count("\n", at, end) if gone else code[at:end])
        at = end
    return "".join(out)


@dataclass(slots=True, eq=False)
class Expr:
    """kind: an operator (in capitals), not, negative, group, literal, path, call, list, fields, or other."""

    kind: str
    #: Its tokens lie from begin to end in all of them.
    all: list[Token]
    begin: int
    end: int
    parts: tuple[Expr, ...] = ()
    args: tuple[Arg, ...] = ()

    @property
    def text(self) -> str:
        return self.all[self.begin].text if self.end - self.begin == 1 else joined(self.all[self.begin : self.end])

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Expr) and self.kind == other.kind and [(t.kind, t.text) for t in self.all[self.begin : self.end]] == [(t.kind, t.text) for t in other.all[other.begin : other.end]]


class Arg(NamedTuple):
    name: str | None
    #: ":=", "=>", or empty for an argument by its place.
    how: str
    value: Expr


@dataclass
class Statement:
    #: assign, call, if, case, for, while, repeat, or jump (exit, continue, return).
    kind: str
    line: int = field(default=0, compare=False)
    target: str = ""
    #: Of assignments := S= R= REF=.
    how: str = ""
    value: Expr | None = None
    #: Branches of (guard or None, labels of a CASE, statements); without either it is an ELSE; loops have one.
    branches: list[tuple[Expr | None, tuple[str, ...], list[Statement]]] = field(default_factory=list)
    #: start, end and step of a FOR.
    bounds: tuple[Expr | None, ...] = ()


class Reader:
    """Reads tokens from left to right. What isn't structured text is noted in problems and skipped up to a semicolon, so that
    the rest of the code counts."""

    def __init__(self, code: str) -> None:
        self.ts, self.at, self.problems = tokens(code), 0, []
        #: The tokens' words, and what word() finds behind the last one.
        self.words = [*[t[4] for t in self.ts], "", ""]

    def word(self, ahead: int = 0) -> str:
        return self.words[self.at + ahead]

    def more(self) -> bool:
        return self.at < len(self.ts)

    def line(self) -> int:
        return self.ts[min(self.at, len(self.ts) - 1)].line if self.ts else 1

    def take(self, *words: str) -> bool:
        if (word := self.words[self.at]) and word in words:
            self.at += 1
            return True
        return False

    def need(self, *words: str) -> None:
        if not self.take(*words):
            raise ValueError(f"{' or '.join(words)} expected in line {self.line()}")

    def made(self, kind: str, begin: int, parts: tuple[Expr, ...] = (), args: tuple[Arg, ...] = ()) -> Expr:
        return Expr(kind, self.ts, begin, self.at, parts, args)

    # expressions

    def expression(self, least: int = 1) -> Expr:
        begin = self.at
        left = self.unary()
        while (bind := BINDS.get(self.words[self.at], 0)) >= least:
            op = {"&": "AND", "AND_THEN": "AND", "OR_ELSE": "OR"}.get(word := self.words[self.at], word)
            self.at += 1
            right = self.expression(bind + 1)
            left = self.made(op, begin, (left, right))
        return left

    def unary(self) -> Expr:
        begin, word = self.at, self.words[self.at]
        if word == "NOT":
            # NOT goes with the comparison behind it
            self.at += 1
            x = self.expression(4)
            return self.made("not", begin, (x,))
        if word == "-" or word == "+":
            self.at += 1
            x = self.unary()
            return self.made("negative", begin, (x,))
        return self.primary()

    def primary(self) -> Expr:
        begin = self.at
        if begin >= len(self.ts):
            raise ValueError("operand expected at the end")
        t = self.ts[begin]
        kind, word = t.kind, t.word
        if kind == "name" and word not in RESERVED or kind == "address":
            self.at += 1
            return self.trail(begin, Expr("path", self.ts, begin, self.at))
        if kind == "string" or kind == "literal":
            self.at += 1
            return Expr("literal", self.ts, begin, self.at)
        if word == "(":
            self.at += 1
            if self.words[self.at + 1] == ":=" and self.ts[self.at].kind == "name":
                args = self.arguments(")")
                return self.made("fields", begin, args=args)
            x = self.expression()
            self.need(")")
            return self.trail(begin, self.made("group", begin, (x,)))
        if word == "[":
            self.at += 1
            parts = []
            while not self.take("]"):
                parts.append(self.expression())
                if parts[-1].kind == "literal" and self.take("("):  # so many times the same
                    parts += [a.value for a in self.arguments(")")]
                self.take(",") or self.word() == "]" or self.need(",", "]")
            return self.made("list", begin, tuple(parts))
        raise ValueError(f"operand expected before {t.text!r} in line {t.line}")

    def trail(self, begin: int, x: Expr) -> Expr:
        """What follows a name: members, indices, dereferences, calls."""
        while True:
            word = self.words[self.at]
            if word == "." and self.at + 1 < len(self.ts) and self.ts[self.at + 1].kind in ("name", "literal", "address"):
                self.at += 2
                x = self.made("path", begin, (x,))
            elif word == "^":
                self.at += 1
                x = self.made("path", begin, (x,))
            elif word == "[":
                self.at += 1
                parts = [x]
                while not self.take("]"):
                    parts.append(self.expression())
                    self.take(",") or self.word() == "]" or self.need(",", "]")
                x = self.made("path", begin, tuple(parts))
            elif word == "(" and x.kind in ("path", "call"):
                self.at += 1
                args = self.arguments(")")
                x = self.made("call", begin, (x,), args)
            else:
                return x

    def arguments(self, end: str) -> tuple[Arg, ...]:
        out = []
        while not self.take(end):
            name, how = None, ""
            if (after := self.words[self.at + 1]) in (":=", "=>") and self.ts[self.at].kind == "name":
                name, how = self.ts[self.at].text, after
                self.at += 2
            empty = self.words[self.at] in (",", end)
            out.append(Arg(name, how, self.made("literal", self.at) if empty else self.expression()))
            self.take(",") or self.words[self.at] == end or self.need(",", end)
        return tuple(out)

    # statements

    def block(self, labels: bool = False) -> list[Statement]:
        """Statements up to a word that ends a block, or to the next label of a CASE."""
        out: list[Statement] = []
        while self.more() and self.word() not in ENDS and not (labels and self.labels_ahead()):
            begin = self.at
            try:
                out += self.statement()
            except (ValueError, RecursionError) as e:
                self.problems.append((self.ts[begin].line, str(e)))
                while self.more() and self.word() not in ENDS and not self.take(";"):
                    self.at += 1
        return out

    def close(self, word: str) -> None:
        """The end of a block; where it is missing, what the block has counts all the same."""
        if not self.take(word):
            self.problems.append((self.line(), f"{word} expected"))

    def up_to(self, *ends: str) -> Expr:
        """An expression before one of these words; anything else there is taken as it stands."""
        begin = self.at
        try:
            x = self.expression()
            if self.word() in ends or not self.more():
                return x
        except (ValueError, RecursionError):
            pass
        self.at = begin
        while self.more() and (self.word() == ":=" or self.word() not in (*ends, ";")) and self.word() not in ENDS:
            self.at += 1
        if self.at == begin or self.more() and self.word() not in ends and ";" not in ends:
            raise ValueError(f"{' or '.join(ends)} expected in line {self.line()}")
        self.problems.append((self.ts[begin].line, "no expression"))
        return self.made("other", begin)

    def labels_ahead(self) -> bool:
        i = self.at
        while i < len(self.ts) and (self.ts[i].kind in ("name", "literal", "string") and self.ts[i].word not in RESERVED or self.ts[i].text in (".", ",", "..", "-", "+")):
            i += 1
        return i > self.at and i < len(self.ts) and self.ts[i].text == ":"

    def statement(self) -> list[Statement]:
        line, word = self.line(), self.word()
        if self.take(";"):
            return []
        if self.take("IF"):
            s = Statement("if", line)
            guard: Expr | None = self.up_to("THEN")
            self.need("THEN")
            while True:
                s.branches.append((guard, (), self.block()))
                if guard is not None and self.take("ELSIF"):
                    guard = self.up_to("THEN")
                    self.need("THEN")
                elif guard is not None and self.take("ELSE"):
                    guard = None
                else:
                    break
            self.close("END_IF")
        elif self.take("CASE"):
            s = Statement("case", line, value=self.up_to("OF"))
            self.need("OF")
            while self.labels_ahead():
                labels = []
                while True:
                    first = self.expression().text
                    labels.append(f"{first}..{self.expression().text}" if self.take("..") else first)
                    if not self.take(","):
                        break
                self.need(":")
                s.branches.append((None, tuple(labels), self.block(labels=True)))
            if self.take("ELSE"):
                s.branches.append((None, (), self.block()))
            self.close("END_CASE")
        elif self.take("FOR"):
            name = self.primary()
            self.need(":=")
            start, end = self.up_to("TO"), self.take("TO") and self.up_to("BY", "DO")
            step = self.up_to("DO") if self.take("BY") else None
            self.need("DO")
            s = Statement("for", line, name.text, bounds=(start, end or None, step), branches=[(None, (), self.block())])
            self.close("END_FOR")
        elif self.take("WHILE"):
            guard = self.up_to("DO")
            self.need("DO")
            s = Statement("while", line, branches=[(guard, (), self.block())])
            self.close("END_WHILE")
        elif self.take("REPEAT"):
            body = self.block()
            self.need("UNTIL")
            s = Statement("repeat", line, branches=[(self.up_to("END_REPEAT", ";"), (), body)])
            self.take(";")
            self.close("END_REPEAT")
        elif word in ("EXIT", "CONTINUE", "RETURN"):
            self.at += 1
            s = Statement("jump", line, word)
        else:
            return self.simple(line)
        self.take(";")
        return [s]

    def simple(self, line: int) -> list[Statement]:
        """Assignments, also several in a chain, and calls."""
        targets = [self.primary()]
        how = self.word() if self.word() == ":=" else f"{self.word()}=" if self.word() in ("S", "R", "REF") and self.word(1) == "=" else ""
        if how:
            self.at += 1 + (how != ":=")
            while True:
                value = self.up_to(";", ":=")
                if value.kind == "other" or not self.take(":="):
                    break
                targets.append(value)
            found = [Statement("assign", line, t.text, how, value) for t in reversed(targets)]
        elif targets[0].kind == "call":
            found = [Statement("call", line, targets[0].parts[0].text, value=targets[0])]
        else:
            raise ValueError(f"no statement in line {line}")
        if not self.take(";") and self.more() and self.word() not in ENDS:
            raise ValueError(f"; expected in line {self.line()}")
        return found


def parse(code: str) -> tuple[list[Statement], list[tuple[int, str]]]:
    """The statements of a unit's code, and (line, what) of what couldn't be read."""
    r = Reader(code)
    out = r.block()
    while r.more():  # an end that nothing began
        r.problems.append((r.line(), f"{r.word()} ends nothing"))
        r.at += 1
        r.take(";")
        out += r.block()
    return out, r.problems


def show(statements: list[Statement], indent: str = "") -> str:
    """Statements as code, a statement or part of one a line."""
    inner, out = indent + "  ", []
    body = lambda b: show(b, inner)
    for s in statements:
        if s.kind == "assign":
            out.append(f"{s.target} {s.how} {s.value.text};")
        elif s.kind == "call":
            out.append(f"{s.value.text};")
        elif s.kind == "jump":
            out.append(f"{s.target};")
        elif s.kind == "if":
            for i, (guard, _, b) in enumerate(s.branches):
                out.append((("IF " if not i else "ELSIF ") + f"{guard.text} THEN" if guard else "ELSE") + "\n" + body(b))
            out.append("END_IF")
        elif s.kind == "case":
            out.append(f"CASE {s.value.text} OF")
            out += [(f"{', '.join(labels)}:" if labels else "ELSE") + "\n" + body(b) for _, labels, b in s.branches]
            out.append("END_CASE")
        elif s.kind == "for":
            start, end, step = s.bounds
            out.append(f"FOR {s.target} := {start.text} TO {end.text}" + (f" BY {step.text}" if step else "") + " DO\n" + body(s.branches[0][2]))
            out.append("END_FOR")
        elif s.kind == "while":
            out.append(f"WHILE {s.branches[0][0].text} DO\n" + body(s.branches[0][2]))
            out.append("END_WHILE")
        else:
            out.append("REPEAT\n" + body(s.branches[0][2]))
            out.append(f"UNTIL {s.branches[0][0].text} END_REPEAT")
    return "".join(f"{indent}{x.rstrip(chr(10))}\n" for x in out)


def label_guard(selector: Expr, labels: tuple[str, ...]) -> str:
    s = selector.text if selector.kind in ("path", "call", "literal", "group") else f"({selector.text})"
    one = lambda x: f"{s} = {x}" if ".." not in x else f"{s} >= {x.split('..')[0]} AND {s} <= {x.split('..')[1]}"
    return " OR ".join(map(one, labels))


def guarded(statements: list[Statement], guards: tuple[str, ...] = ()) -> Iterator[tuple[Statement, tuple[str, ...]]]:
    """Every statement with what must hold for it to be reached: the conditions of the branches and loops around it, those of
    earlier branches negated. A REPEAT asks nothing, as it runs once at least; a FOR asks for its variable to be within
    its bounds, in the order of a step's sign, where the step is a number."""
    for s in statements:
        yield s, guards
        before: list[str] = []
        for guard, labels, body in s.branches:
            if s.kind == "case":
                own = label_guard(s.value, labels) if labels else None
                held = guards + ((own,) if own else tuple(f"NOT ({b})" for b in before))
                before.append(own or "")
            elif s.kind == "for":
                start, end, step = s.bounds
                low, high = (end, start) if step and step.kind == "negative" and step.text.startswith("-") else (start, end)
                known = high is not None and low is not None and (step is None or step.kind in ("literal", "negative"))
                held = guards + ((f"{s.target} >= {low.text} AND {s.target} <= {high.text}",) if known else ())
            elif s.kind == "repeat":
                held = guards
            else:
                held = guards + tuple(f"NOT ({b})" for b in before) + ((guard.text,) if guard else ())
                before.append(guard.text if guard else "")
            yield from guarded(body, held)


def each(statements: list[Statement]) -> Iterator[Statement]:
    """Every statement, in the order of guarded()."""
    for s in statements:
        yield s
        for _, _, body in s.branches:
            yield from each(body)


def expressions(s: Statement) -> Iterator[Expr]:
    """The expressions of a statement itself, its branches' statements left out."""
    yield from (x for x in (s.value, *s.bounds, *(g for g, _, _ in s.branches)) if x is not None)


def within(x: Expr) -> Iterator[Expr]:
    yield x
    for part in (*x.parts, *(a.value for a in x.args)):
        yield from within(part)


# declarations


@dataclass(frozen=True)
class Declaration:
    name: str
    type: str
    init: str | None
    address: str | None
    #: VAR, VAR_INPUT, ...; STRUCT for members of a structure.
    section: str


def declarations(header: str) -> list[Declaration]:
    """The variables of declaration text, a row per name: arrays, pointers, structures and strings with their initial values.
    Headings of units and unreadable parts are skipped. Text without VAR counts as one section."""
    r, out, section = Reader(header), [], "VAR"
    while r.more():
        if r.word() in ("PROGRAM", "FUNCTION", "FUNCTION_BLOCK", "METHOD", "INTERFACE", "PROPERTY", "ACTION") and r.word(1) not in (":", ","):
            while r.more() and not r.word().startswith("VAR") and not r.take(";"):
                r.at += 1
        elif r.word().startswith("VAR") and r.word(1) not in (":", ","):
            section = r.word()
            r.at += 1
        elif r.word() in ("CONSTANT", "RETAIN", "PERSISTENT", "NON_RETAIN") and r.word(1) not in (":", ","):
            r.at += 1
        elif r.word().startswith("END_"):
            r.at += 1
        elif not r.take(";"):
            begin = r.at
            try:
                out += _declared(r, section)
            except (ValueError, RecursionError) as e:
                r.problems.append((r.ts[begin].line, str(e)))
                while r.more() and not r.take(";") and not r.word().startswith("END_VAR"):
                    r.at += 1
    return out


def _declared(r: Reader, section: str) -> list[Declaration]:
    names, address = [], None
    while True:
        if not r.more() or r.ts[r.at].kind != "name":
            raise ValueError(f"name expected in line {r.line()}")
        names.append(r.ts[r.at].text)
        r.at += 1
        if r.take("AT"):
            if not r.more():
                raise ValueError("address expected at the end")
            address = r.ts[r.at].text
            r.at += 1
        if not r.take(","):
            break
    r.need(":")
    begin = r.at
    _type(r)
    kind = joined(r.ts[begin : r.at])
    init = r.expression().text if r.take(":=", "REF=") else None
    if r.more():
        r.need(";")
    return [Declaration(n, kind, init, address, section) for n in names]


def _type(r: Reader) -> None:
    if r.take("ARRAY"):
        r.need("[")
        while not r.take("]"):
            r.take(",", "..", "*") or r.expression()
        r.need("OF")
        _type(r)
    elif r.take("POINTER", "REFERENCE"):
        r.need("TO")
        _type(r)
    elif r.take("STRUCT"):
        while not r.take("END_STRUCT"):
            r.take(";") or _declared(r, "STRUCT")
    elif r.take("("):  # an enumeration
        while not r.take(")"):
            r.primary()
            r.take(":=") and r.expression()
            r.take(",") or r.word() == ")" or r.need(",", ")")
    else:
        if not r.more() or r.ts[r.at].kind != "name":
            raise ValueError(f"type expected in line {r.line()}")
        r.at += 1
        while r.take("."):
            r.at += 1
        if r.take("(", "["):  # a length or a range
            while not r.take(")", "]"):
                r.take(",", "..") or r.expression()
