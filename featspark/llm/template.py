"""A small sandboxed template language: text, ``{{ expression }}``, ``{# comment #}``, ``{% set x = e %}``,
``{% for x in e %}``, ``{% if e %}`` with ``elif`` and ``else``, ``{% generation %}``; each block ends with
``{% end... %}``. A minus inside a tag, as in ``{%-`` or ``-}}``, takes the white space away on its side.

Source is parsed to a syntax tree, constants are folded, and the tree becomes Python closures. Names
reach only the given variables, keys of mappings and places of lists, so a template cannot touch Python
objects. What is not there is false in a condition; to write it or to use it otherwise is an error. Expressions:
strings, integers, names, ``a.b``, ``a['b']``, ``a[0]``, ``not and or``, ``== != in``, ``is defined``, ``+``,
``a if c else b``, parentheses and filters ``a | upper``. Inside a loop ``loop`` has index, index0, first,
last and length. A variable set inside a loop ends with the round.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

QUOTED = r""" "(?:[^"\\]|\\.)*+"|'(?:[^'\\]|\\.)*+' """.strip()
TAG = re.compile(rf"\{{%(-?)((?:{QUOTED}|(?!-?%\}}).)*+)(-?)%\}}|\{{\{{(-?)((?:{QUOTED}|(?!-?\}}\}}).)*+)(-?)\}}\}}|\{{#(-?).*?(-?)#\}}", re.S)
LEXEME = re.compile(r"""\s*(?:("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(\d+)|([A-Za-z_]\w*)|(==|!=|[()\[\].|+]))""", re.S)
ESCAPES = {"n": "\n", "t": "\t"}


class TemplateError(ValueError):
    """The source is not a template, or it asks for what is not there."""


class _Absent:
    """The value of a name, key or place that is not there."""

    def __init__(self, what: Any):
        self.what = what

    def __bool__(self) -> bool:
        return False

    def __iter__(self):
        raise TemplateError(f"{self.what!r} is not defined")


@dataclass(frozen=True)
class Node:
    """A part of the syntax tree: its kind, its value and the parts below it."""

    kind: str
    value: Any = None
    below: tuple = ()


@dataclass
class Output:
    """What a run writes: pieces of text, their length so far, and the generated spans."""

    pieces: list[str] = field(default_factory=list)
    length: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)

    def write(self, text: str) -> None:
        self.pieces.append(text)
        self.length += len(text)


class _Expression:
    """Recursive descent over the lexemes of one expression."""

    def __init__(self, source: str):
        self.items, at = [], 0
        while source[at:].strip():
            m = LEXEME.match(source, at)
            if not m:
                raise TemplateError(f"unexpected {source[at:]!r}")
            kind = ("text", "int", "name", "op")[m.lastindex - 1]
            self.items.append((kind, m[m.lastindex]))
            at = m.end()
        self.at = 0

    def take(self, *values: str) -> str | None:
        if self.at < len(self.items) and self.items[self.at][0] in ("op", "name") and self.items[self.at][1] in values:
            self.at += 1
            return values[values.index(self.items[self.at - 1][1])]
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} is missing")

    def whole(self) -> Node:
        node = self.choice()
        if self.at < len(self.items):
            raise TemplateError(f"unexpected {self.items[self.at][1]!r}")
        return node

    def choice(self) -> Node:
        node = self.binary(0)
        if self.take("if"):
            test = self.binary(0)
            other = self.choice() if self.take("else") else Node("constant", "")
            node = Node("if", None, (test, node, other))
        return node

    LEVELS = (("or",), ("and",), ("==", "!=", "in"), ("+",))

    def binary(self, level: int) -> Node:
        if level == 2 and self.take("not"):
            return Node("not", None, (self.binary(2),))
        if level == len(self.LEVELS):
            return self.piped()
        node = self.binary(level + 1)
        while op := self.take(*self.LEVELS[level]):
            node = Node("binary", op, (node, self.binary(level + 1)))
        if level == 2 and self.take("is"):
            absent = bool(self.take("not"))
            self.need("defined")
            node = Node("defined", None, (node,))
            node = Node("not", None, (node,)) if absent else node
        return node

    def piped(self) -> Node:
        node = self.atom()
        while True:
            if self.take("."):
                node = Node("key", None, (node, Node("constant", self.name())))
            elif self.take("["):
                node = Node("key", None, (node, self.choice()))
                self.need("]")
            elif self.take("|"):
                node = Node("filter", self.name(), (node,))
            else:
                return node

    def name(self) -> str:
        if self.at >= len(self.items) or self.items[self.at][0] != "name":
            raise TemplateError("a name is missing")
        self.at += 1
        return self.items[self.at - 1][1]

    def atom(self) -> Node:
        if self.take("("):
            node = self.choice()
            self.need(")")
            return node
        if self.at >= len(self.items):
            raise TemplateError("an expression is missing")
        kind, value = self.items[self.at]
        self.at += 1
        if kind == "text":
            return Node("constant", re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "int":
            return Node("constant", int(value))
        if kind == "name":
            return Node("constant", value == "true") if value in ("true", "false") else Node("name", value)
        raise TemplateError(f"unexpected {value!r}")


def parse(source: str) -> Node:
    """The syntax tree of a template."""
    frames: list[tuple[str, Any, list]] = [("root", None, [])]
    at, trim = 0, False

    def text(piece: str, left: bool, right: bool) -> None:
        piece = piece.lstrip() if left else piece
        piece = piece.rstrip() if right else piece
        if piece:
            frames[-1][2].append(Node("write", None, (Node("constant", piece),)))

    for m in TAG.finditer(source):
        text(source[at:m.start()], trim, "-" in (m[1], m[4], m[7]))
        at, trim = m.end(), "-" in (m[3], m[6], m[8])
        if m[7] is not None:
            continue
        if m[5] is not None:
            frames[-1][2].append(Node("write", None, (_Expression(m[5]).whole(),)))
            continue
        word, _, rest = m[2].strip().partition(" ")
        if word == "set":
            name, middle, of = rest.partition("=")
            if not middle or not name.strip().isidentifier():
                raise TemplateError(f"bad variable {rest!r}")
            frames[-1][2].append(Node("set", name.strip(), (_Expression(of).whole(),)))
        elif word == "for":
            name, middle, of = rest.strip().partition(" in ")
            if not middle or not name.strip().isidentifier():
                raise TemplateError(f"bad loop {rest!r}")
            frames.append(("for", (name.strip(), _Expression(of).whole()), []))
        elif word == "if":
            frames.append(("if", _Expression(rest).whole(), []))
        elif word in ("elif", "else") and frames[-1][0] in ("if", "elif"):
            frames.append((word, _Expression(rest).whole() if word == "elif" else Node("constant", True), []))
        elif word == "generation":
            frames.append(("generation", None, []))
        elif word == "endif" and frames[-1][0] in ("if", "elif", "else"):
            cases = []
            while True:
                kind, test, body = frames.pop()
                cases.append(Node("case", None, (test, Node("block", None, tuple(body)))))
                if kind == "if":
                    break
            frames[-1][2].append(Node("choose", None, tuple(reversed(cases))))
        elif word in ("endfor", "endgeneration") and frames[-1][0] == word[3:]:
            kind, value, body = frames.pop()
            block = Node("block", None, tuple(body))
            frames[-1][2].append(Node("for", value[0], (value[1], block)) if kind == "for" else Node("generation", None, (block,)))
        else:
            raise TemplateError(f"unexpected tag {m[2].strip()!r}")
    if len(frames) > 1:
        raise TemplateError(f"{frames[-1][0]!r} is not ended")
    text(source[at:], trim, False)
    return Node("block", None, tuple(frames[0][2]))


def _text(value: Any) -> str:
    if isinstance(value, _Absent):
        raise TemplateError(f"{value.what!r} is not defined")
    return "" if value is None else str(value)


def _binary(op: str, a: Any, b: Any) -> Any:
    if op == "==":
        return a == b
    if op == "!=":
        return a != b
    if op == "in":
        return bool(b) and a in b
    return a + b if isinstance(a, int) and isinstance(b, int) else _text(a) + _text(b)


def fold(node: Node, filters: dict[str, Callable]) -> Node:
    """The tree with constant parts computed, settled choices taken and neighbouring text joined."""
    below = tuple(fold(x, filters) for x in node.below)
    fixed = bool(below) and all(x.kind == "constant" for x in below)
    if node.kind == "filter" and node.value not in filters:
        raise TemplateError(f"no filter {node.value!r}")
    if fixed and node.kind == "not":
        return Node("constant", not below[0].value)
    if node.kind == "binary" and node.value in ("and", "or"):
        if below[0].kind == "constant":
            return below[1] if bool(below[0].value) == (node.value == "and") else below[0]
    elif fixed and node.kind == "binary":
        return Node("constant", _binary(node.value, below[0].value, below[1].value))
    if node.kind == "if" and below[0].kind == "constant":
        return below[1] if below[0].value else below[2]
    if fixed and node.kind == "filter":
        return Node("constant", filters[node.value](_text(below[0].value)))
    if node.kind == "choose":
        cases = []
        for case in below:
            test = case.below[0]
            if test.kind != "constant" or test.value:
                cases.append(case)
            if test.kind == "constant" and test.value:
                break
        if not cases:
            return Node("block")
        return cases[0].below[1] if cases[0].below[0].kind == "constant" else Node("choose", None, tuple(cases))
    if node.kind == "block":
        out: list[Node] = []
        for x in (y for part in below for y in (part.below if part.kind == "block" else (part,))):
            if out and x.kind == out[-1].kind == "write" and x.below[0].kind == out[-1].below[0].kind == "constant":
                out[-1] = Node("write", None, (Node("constant", _text(out[-1].below[0].value) + _text(x.below[0].value)),))
            else:
                out.append(x)
        return Node("block", None, tuple(out))
    return Node(node.kind, node.value, below)


def _value(node: Node, filters: dict[str, Callable]) -> Callable[[dict], Any]:
    parts = [_value(x, filters) for x in node.below]
    v = node.value
    if node.kind == "constant":
        return lambda env: v
    if node.kind == "name":
        return lambda env: env[v] if v in env else _Absent(v)
    if node.kind == "key":
        def key(env, a=parts[0], b=parts[1]):
            got, at = a(env), b(env)
            if isinstance(got, dict) and at in got or isinstance(got, (list, tuple)) and type(at) is int and -len(got) <= at < len(got):
                return got[at]
            if isinstance(got, _Absent):
                raise TemplateError(f"{got.what!r} is not defined")
            return _Absent(at)
        return key
    if node.kind == "defined":
        return lambda env: not isinstance(parts[0](env), _Absent)
    if node.kind == "if":
        return lambda env: parts[1](env) if parts[0](env) else parts[2](env)
    if node.kind == "not":
        return lambda env: not parts[0](env)
    if node.kind == "filter":
        return lambda env, f=filters[v]: f(_text(parts[0](env)))
    if v == "and":
        return lambda env: parts[0](env) and parts[1](env)
    if v == "or":
        return lambda env: parts[0](env) or parts[1](env)
    return lambda env: _binary(v, parts[0](env), parts[1](env))


def _action(node: Node, filters: dict[str, Callable]) -> Callable[[dict, Output], None]:
    if node.kind == "write":
        if node.below[0].kind == "constant":
            text = _text(node.below[0].value)
            return lambda env, out: out.write(text)
        value = _value(node.below[0], filters)
        return lambda env, out: out.write(_text(value(env)))
    if node.kind == "block":
        steps = [_action(x, filters) for x in node.below]

        def block(env, out):
            for step in steps:
                step(env, out)
        return block
    if node.kind == "set":
        given = _value(node.below[0], filters)

        def put(env, out, name=node.value):
            env[name] = given(env)
        return put
    if node.kind == "choose":
        cases = [(_value(x.below[0], filters), _action(x.below[1], filters)) for x in node.below]

        def choose(env, out):
            for test, body in cases:
                if test(env):
                    return body(env, out)
        return choose
    if node.kind == "generation":
        body = _action(node.below[0], filters)

        def generation(env, out):
            begin = out.length
            body(env, out)
            out.spans.append((begin, out.length))
        return generation
    items, body, name = _value(node.below[0], filters), _action(node.below[1], filters), node.value

    def loop(env, out):
        held = items(env)
        rows = [] if held is None else list(held)
        for i, row in enumerate(rows):
            body({**env, name: row, "loop": {"index": i + 1, "index0": i, "first": i == 0, "last": i == len(rows) - 1, "length": len(rows)}}, out)
    return loop


def compile_template(source: str, filters: dict[str, Callable[[str], str]] | None = None) -> Callable[[dict], tuple[str, list[tuple[int, int]]]]:
    """The function from variables to the text and the spans (code points) under ``generation``."""
    known = {"trim": str.strip, "upper": str.upper, "lower": str.lower, **(filters or {})}
    run = _action(fold(parse(source), known), known)

    def render(variables: dict) -> tuple[str, list[tuple[int, int]]]:
        out = Output()
        run(dict(variables), out)
        return "".join(out.pieces), out.spans

    return render
