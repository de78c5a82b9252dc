"""Structured text: what single expressions get wrong, generated programs read back, printed and read again."""

import sys

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewell.functions import logic
from tracewell.functions import structured_text as reader


def found(code):
    return [(a.target, a.value, a.conditions) for a in logic.assignments(code)]


def test_strings_calls_and_targets():
    assert found("x := 'a;b';") == [("x", "'a;b'", [])]
    assert found("x := 'it$'s (* no comment *)'; // y := 1;\ny := \"w;\";") == [("x", "'it$'s (* no comment *)'", []), ("y", '"w;"', [])]
    assert found("arr[i+1] := 5;\np^.x := 2; m[1, 2].q := w.3; a := b := c;") == [("arr[i+1]", "5", []), ("p^.x", "2", []), ("m[1, 2].q", "w.3", []), ("b", "c", []), ("a", "c", [])]
    assert logic.calls("t(IN := f(g(a), b), Q => x);") == [("t", 0, {"IN": "f(g(a), b)"}, {"Q": "x"})]
    assert logic.calls("t(IN := NOT (a AND (b OR c)), PT := T#1s);\nfbs[2].Start(1, 'x;)', Q=>);\nt(IN := );") == [("t", 0, {"IN": "NOT (a AND (b OR c))", "PT": "T#1s"}, {}), ("fbs[2].Start", 0, {}, {"Q": ""}), ("t", 1, {"IN": ""}, {})]
    assert logic.call_statements("fbs[2].Start(1, 'x;)');")[0].placed == ["1", "'x;)'"]
    assert logic.called_functions("x := f(g(a), 1) + h(2); t(IN := f(b)); IF k(x) THEN ; END_IF") == ["f", "g", "h", "k"]


def test_guards_of_branches_and_loops():
    assert found("CASE s OF 1: x := TRUE; 2, 3: y := 1; 4..6: IF q THEN z := 2; END_IF ELSE w := 0; END_CASE") == [("x", "TRUE", ["s = 1"]), ("y", "1", ["s = 2 OR s = 3"]), ("z", "2", ["s >= 4 AND s <= 6", "q"]), ("w", "0", ["NOT (s = 1)", "NOT (s = 2 OR s = 3)", "NOT (s >= 4 AND s <= 6)"])]
    assert found("CASE a + b OF Mode.Run: x := 1; -1: y := 2; END_CASE") == [("x", "1", ["(a + b) = Mode.Run"]), ("y", "2", ["(a + b) = -1"])]
    assert found("WHILE a DO z := 1; END_WHILE") == [("z", "1", ["a"])]
    assert found("REPEAT z := 1; UNTIL a > 3 END_REPEAT; y := 2;") == [("z", "1", []), ("y", "2", [])]
    assert found("FOR i := 5 TO n BY -1 DO z := i; END_FOR") == [("i", "5", []), ("z", "i", ["i >= n AND i <= 5"])]
    assert found("FOR i := 1 TO n BY k DO z := i; END_FOR") == [("i", "1", []), ("z", "i", [])]
    assert found("IF a THEN x S= b; ELSE x R= c; END_IF") == [("x", "TRUE", ["a", "b"]), ("x", "FALSE", ["NOT (a)", "c"])]


def test_what_cannot_be_read_is_noted_and_skipped():
    code = "x := 1;\n?? y;\nIF a ? b THEN z := 2; END_IF\nEND_WHILE\nw := 3 ? 4;\nIF open THEN v := 5;"
    assert found(code) == [("x", "1", []), ("z", "2", ["a ? b"]), ("w", "3 ? 4", []), ("v", "5", ["open"])]
    assert {line for line, _ in reader.parse(code)[1]} == {2, 3, 4, 5, 6}
    assert found("x := 'no end;\ny := 2; z := 3;") == [("x", "'no end; y := 2", []), ("z", "3", [])]
    assert found("(* (* nested *) x := 1; *) y := 2; (* no end x := 3;") == [("y", "2", [])]
    deep = "(" * 5000 + "a" + ")" * 5000
    assert found(f"x := {deep}; y := 1;") == [("x", deep, []), ("y", "1", [])]
    with pytest.raises(ValueError):
        logic.parse(deep)
    many = "x := " + " AND ".join(f"a{i}" for i in range(20_000)) + ";"
    assert len(found(many)) == 1 and len(found("y := 1;\n" * 20_000)) == 20_000


def test_boolean_trees_with_other_operands():
    assert logic.parse("f(a, b) > 3 AND NOT (x + 1=y[2]) OR q.r^") == ("or", [("and", [("tok", "f(a, b) > 3"), ("not", ("tok", "x + 1 = y[2]"))]), ("tok", "q.r^")])
    assert logic.parse("a OR b OR (c OR d)") == ("or", [("tok", "a"), ("tok", "b"), ("or", [("tok", "c"), ("tok", "d")])])
    assert logic.parse("BOOL#TRUE AND x") == ("and", [("const", True), ("tok", "x")])
    for bad in ("", "a b", "a AND", "(a", "a)", "NOT", "a ? b"):
        with pytest.raises(ValueError):
            logic.parse(bad)


def test_declarations():
    header = """FUNCTION_BLOCK Foo EXTENDS Bar
    VAR_INPUT a, b : BOOL := TRUE; (* x : INT; *) {attribute 'q'} t AT %IX0.1 : TIME; END_VAR
    VAR CONSTANT n : ARRAY[1..3, 0..1] OF INT := [1, 2(0), 3]; s : STRING[80] := 'a;b'; p : POINTER TO ARRAY[0..1] OF Lib.Kind; END_VAR
    VAR RETAIN q : STRUCT x : INT := 1; y : STRING; END_STRUCT := (x := 2, y := 'z;'); e : (Red := 1, Green) := Green; ?? broken; r : INT(0..10) := 3; f : Fb := (PT := T#1s); END_VAR"""
    assert [(d.name, d.type, d.init, d.address, d.section) for d in reader.declarations(header)] == [
        ("a", "BOOL", "TRUE", None, "VAR_INPUT"),
        ("b", "BOOL", "TRUE", None, "VAR_INPUT"),
        ("t", "TIME", None, "%IX0.1", "VAR_INPUT"),
        ("n", "ARRAY[1..3, 0..1] OF INT", "[1, 2(0), 3]", None, "VAR"),
        ("s", "STRING[80]", "'a;b'", None, "VAR"),
        ("p", "POINTER TO ARRAY[0..1] OF Lib.Kind", None, None, "VAR"),
        ("q", "STRUCT x : INT := 1; y : STRING; END_STRUCT", "(x := 2, y := 'z;')", None, "VAR"),
        ("e", "(Red := 1, Green)", "Green", None, "VAR"),
        ("r", "INT(0..10)", "3", None, "VAR"),
        ("f", "Fb", "(PT := T#1s)", None, "VAR"),
    ]
    assert logic.parse_declaration("") == [] and logic.parse_declaration("VAR x") == []


values = st.sampled_from(["'a;b'", "f(g(a), b)", "NOT (a AND (b OR c))", "x + 1", "t.Q", "T#1s500ms", "arr[i+1]", "16#FF", "TRUE", "-y ** 2", "\"END_IF\""])
conditions = st.sampled_from(["a", "NOT b", "a AND (b OR c)", "x > 3", "f(a, 'THEN') = 'DO;'", "t.Q", "arr[i] <> 0"])
targets = st.sampled_from(["x", "y.z", "arr[i+1]", "p^.q", "Endwert", "IFx", "m[1, 2]"])
labels = st.lists(st.sampled_from(["1", "2", "3..5", "Mode.Run", "-1"]), min_size=1, max_size=2)
gaps = st.sampled_from([" ", "\n", "  \t", " (* x := 1; END_IF *) ", " // ELSE y := 2;\n", "\n{pragma}\n"])


def statements(inner):
    body = st.lists(inner, max_size=3)
    return st.one_of(
        st.tuples(st.just("if"), st.lists(st.tuples(conditions, body), min_size=1, max_size=3), st.none() | body),
        st.tuples(st.just("case"), st.lists(st.tuples(labels, body), min_size=1, max_size=3), st.none() | body),
        st.tuples(st.just("while"), conditions, body),
        st.tuples(st.just("repeat"), conditions, body),
        st.tuples(st.just("for"), st.sampled_from([("0", "9", None), ("9", "n", "-1")]), body),
    )


simple = st.one_of(st.tuples(st.just("assign"), targets, values), st.tuples(st.just("call"), st.sampled_from(["t", "fb.Start"]), values))
programs = st.lists(st.recursive(simple, statements, max_leaves=12), max_size=5)


def written(program, gap):
    """The program's text, with something between all words."""
    out = []
    for s in program:
        kind = s[0]
        if kind == "assign":
            out += [s[1], ":=", s[2], ";"]
        elif kind == "call":
            out += [s[1] + "(IN := " + s[2] + ", Q => y)", ";"]
        elif kind == "if":
            for i, (c, b) in enumerate(s[1]):
                out += ["ELSIF" if i else "IF", c, "THEN", *written(b, gap)]
            out += ["ELSE", *written(s[2], gap)] if s[2] is not None else []
            out += ["END_IF"]
        elif kind == "case":
            out += ["CASE", "s", "OF"]
            for ls, b in s[1]:
                out += [", ".join(ls), ":", *written(b, gap)]
            out += ["ELSE", *written(s[2], gap)] if s[2] is not None else []
            out += ["END_CASE", ";"]
        elif kind == "while":
            out += ["WHILE", s[1], "DO", *written(s[2], gap), "END_WHILE"]
        elif kind == "repeat":
            out += ["REPEAT", *written(s[2], gap), "UNTIL", s[1], "END_REPEAT", ";"]
        else:
            a, b, step = s[1]
            out += ["FOR", "i", ":=", a, "TO", b, *(["BY", step] if step else []), "DO", *written(s[2], gap), "END_FOR"]
    return out


def expected(program, held=()):
    for s in program:
        if s[0] == "assign":
            yield s[1], s[2], list(held)
        elif s[0] in ("if", "case"):
            before = []
            for c, b in s[1]:
                own = c if s[0] == "if" else " OR ".join(f"s >= {x.split('..')[0]} AND s <= {x.split('..')[1]}" if ".." in x else f"s = {x}" for x in c)
                yield from expected(b, (*held, *(before if s[0] == "if" else []), own))
                before.append(f"NOT ({own})")
            yield from expected(s[2] or [], (*held, *before))
        elif s[0] == "while":
            yield from expected(s[2], (*held, s[1]))
        elif s[0] == "repeat":
            yield from expected(s[2], held)
        elif s[0] == "for":
            yield "i", s[1][0], list(held)
            yield from expected(s[2], (*held, "i >= 0 AND i <= 9" if s[1][2] is None else "i >= n AND i <= 9"))


@settings(max_examples=250, deadline=None)
@given(programs, gaps)
def test_generated_programs(program, gap):
    code = gap.join(written(program, gap))
    tree, problems = reader.parse(code)
    assert not problems
    assert found(code) == list(expected(program))
    again, problems = reader.parse(reader.show(tree))
    assert not problems and again == tree
    assert reader.show(again) == reader.show(tree)


def calls_a_token(read, text):
    """Python's and C's calls while text is read, for each of its tokens, after a text that is nearly the same."""
    n = 0

    def seen(frame, event, arg):
        nonlocal n
        n += event in ("call", "c_call")

    read(text)
    sys.setprofile(seen)
    try:
        read(text + " ")
    finally:
        sys.setprofile(None)
    return n / len(reader.tokens(text))


def test_code_is_read_in_few_calls():
    code = "t(a := NOT (x AND (y OR z7)), q => arr[7]);\nIF go THEN // t(a := 1);\nfbs[1]('a;b', f(g(1, 12), 2)); t.Start(); END_IF\nCASE s OF 1: t(last); END_CASE"
    assert calls_a_token(logic.call_statements, code) < 15  # it was 32


def test_pieces_of_text():
    """What has no end, is nested or looks like the start of another kind."""
    pieces = lambda text: [(t.kind, t.text, t.line, t.spaced) for t in reader.tokens(text)]
    assert pieces("a(* ( * (**) ) *)b(***)c(*)d") == [("name", "a", 1, False), ("name", "b", 1, True), ("name", "c", 1, True)]
    assert pieces("(* it's\n*)x 'no end\ny") == [("name", "x", 2, True), ("string", "'no end", 2, True), ("name", "y", 3, True)]
    assert pieces("abc#\nD#2020-01-01 t#1s 16#FF %x %IX0.1 {p} {") == [("name", "abc", 1, False), ("other", "#", 1, False), ("literal", "D#2020-01-01", 2, True), ("literal", "t#1s", 2, True), ("literal", "16#FF", 2, True), ("address", "%x", 2, True), ("address", "%IX0.1", 2, True), ("other", "{", 2, True)]
    assert reader._MOST > 100 and not reader.tokens("") and len({t.text for n in range(3) for t in reader.tokens(" ".join(f"n{n}_{i}" for i in range(reader._MOST)))}) == 3 * reader._MOST and len(reader._KNOWN) <= reader._MOST


def test_declarations_are_read_in_few_calls():
    header = "VAR_INPUT a : ARRAY[1..7, 0..1] OF INT := [7(0), 12]; (* x : INT; *) s : STRING[7] := 'a;7'; END_VAR\nVAR p : POINTER TO Kind; r AT %MW7 : INT(0..7) := 7; END_VAR"
    assert calls_a_token(logic.parse_declaration, header) < 13  # it was 24
