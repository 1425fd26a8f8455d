"""A compiler for chat templates: source to tokens to a syntax tree, constants folded, then closures.

The language has text, ``{{ expression }}``, ``{# comment #}`` and the statements ``for``, ``if`` / ``elif`` /
``else``, ``set`` and ``generation``, each with its end; a ``-`` beside a delimiter takes the white space
there. Expressions are literals, names, fields, ``~``, ``+``, comparisons, ``in``, ``not``, ``and``, ``or``,
``a if b else c`` and filters.

It is a sandbox. There are no calls and no attributes of Python objects: a dot or bracket reads a
declared field of a message or of ``loop``. A template has one loop, over ``messages``, at its top, so
its work is linear in its input, and messages can be rendered one at a time. Unknown names, fields and
filters are errors when the template is compiled, not when it runs.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field

LOOP_FIELDS = ("first", "last", "index", "index0")


class TemplateError(ValueError):
    pass


# Reversible escapes. No "<|" is left in an escaped text: between "<" and "|" one backslash more is put.


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text) if "|" in text else text


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text) if "|" in text else text


def header(text: str) -> str:
    """A text for one line: line ends and backslashes are spelt, then as ``escape``."""
    return escape(text.replace("\\", "\\\\").replace("\n", "\\n"))


def unheader(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(text))


FILTERS: dict[str, Callable[[str], str]] = {
    "escape": escape,
    "header": header,
    "trim": str.strip,
    "upper": str.upper,
    "lower": str.lower,
}


# The syntax tree.


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Field:
    name: str
    field: str


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Not:
    value: object


@dataclass(frozen=True)
class Choice:
    test: object
    yes: object
    no: object


@dataclass(frozen=True)
class Filter:
    name: str
    value: object


@dataclass(frozen=True)
class Output:
    value: object


@dataclass(frozen=True)
class Set:
    name: str
    value: object


@dataclass(frozen=True)
class If:
    test: object
    yes: tuple
    no: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


@dataclass(frozen=True)
class For:
    name: str
    over: str
    body: tuple


def _add(a, b):
    if type(a) is not type(b):
        raise TemplateError("+ takes two texts or two numbers")
    return a + b


def _text(value: object) -> str:
    return "" if value is None else str(value)


_BINARY: dict[str, Callable[[object, object], object]] = {
    "~": lambda a, b: _text(a) + _text(b),
    "+": _add,
    "==": operator.eq,
    "!=": operator.ne,
    "in": lambda a, b: _text(a) in _text(b),
    "not in": lambda a, b: _text(a) not in _text(b),
}

_PIECE = re.compile(r"(\{#-?.*?-?#\}|\{\{-?.*?-?\}\}|\{%-?.*?-?%\})", re.S)
_TOKEN = re.compile(r"""\s*(?:('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(\d+)|([A-Za-z_]\w*)|(==|!=|[~+|.()\[\]=]))""", re.S)
_SPELT = {"n": "\n", "t": "\t", "r": "\r"}


def _tokens(source: str) -> list[tuple[str, object]]:
    found, at = [], 0
    source = source.rstrip()
    while at < len(source):
        match = _TOKEN.match(source, at)
        if not match:
            raise TemplateError(f"cannot read {source[at:]!r}")
        quoted, number, name, sign = match.groups()
        if quoted is not None:
            found.append(("text", re.sub(r"\\(.)", lambda m: _SPELT.get(m[1], m[1]), quoted[1:-1], flags=re.S)))
        elif number is not None:
            found.append(("number", int(number)))
        else:
            found.append(("name", name) if name is not None else ("sign", sign))
        at = match.end()
    return found


class _Expression:
    """Recursive descent over the tokens of one delimiter."""

    def __init__(self, source: str):
        self.tokens, self.at = _tokens(source), 0

    def peek(self) -> tuple[str, object]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", None)

    def take(self, value: str) -> bool:
        if self.peek() in (("name", value), ("sign", value)):
            self.at += 1
            return True
        return False

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} expected, {self.peek()[1]!r} found")

    def name(self) -> str:
        kind, value = self.peek()
        if kind != "name":
            raise TemplateError(f"a name expected, {value!r} found")
        self.at += 1
        return str(value)

    def end(self) -> None:
        if self.peek()[0] != "end":
            raise TemplateError(f"unexpected {self.peek()[1]!r}")

    def whole(self):
        found = self.choice()
        self.end()
        return found

    def choice(self):
        value = self.either()
        if self.take("if"):
            test = self.either()
            self.need("else")
            return Choice(test, value, self.choice())
        return value

    def either(self):
        value = self.both()
        while self.take("or"):
            value = Choice(value, value, self.both())
        return value

    def both(self):
        value = self.negated()
        while self.take("and"):
            value = Choice(value, self.negated(), value)
        return value

    def negated(self):
        return Not(self.negated()) if self.take("not") else self.compared()

    def compared(self):
        value = self.joined()
        for op in ("==", "!=", "in"):
            if self.take(op):
                return Binary(op, value, self.joined())
        if self.take("not"):
            self.need("in")
            return Binary("not in", value, self.joined())
        return value

    def joined(self):
        value = self.filtered()
        while True:
            for op in ("~", "+"):
                if self.take(op):
                    value = Binary(op, value, self.filtered())
                    break
            else:
                return value

    def filtered(self):
        value = self.atom()
        while self.take("|"):
            name = self.name()
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            value = Filter(name, value)
        return value

    def atom(self):
        kind, value = self.peek()
        if kind in ("text", "number"):
            self.at += 1
            return Const(value)
        if self.take("("):
            found = self.choice()
            self.need(")")
            return found
        name = self.name()
        if name in ("true", "false", "none"):
            return Const({"true": True, "false": False, "none": None}[name])
        if self.take("."):
            return Field(name, self.name())
        if self.take("["):
            kind, key = self.peek()
            if kind != "text":
                raise TemplateError("a field is named by a text")
            self.at += 1
            self.need("]")
            return Field(name, str(key))
        return Name(name)


def parse(source: str) -> tuple:
    """The syntax tree: a tuple of nodes."""
    pieces = _PIECE.split(source)
    for i in range(1, len(pieces), 2):
        if pieces[i][2] == "-":
            pieces[i - 1] = pieces[i - 1].rstrip()
        if pieces[i][-3] == "-":
            pieces[i + 1] = pieces[i + 1].lstrip()
    position = 0

    def block(ends: tuple[str, ...]) -> tuple[tuple, str, _Expression | None]:
        nonlocal position
        nodes = []
        while position < len(pieces):
            piece, inside = pieces[position], position % 2
            position += 1
            if not inside:
                if piece:
                    nodes.append(Output(Const(piece)))
                continue
            body = piece[2:-2].strip("-")
            if piece.startswith("{#"):
                continue
            if piece.startswith("{{"):
                nodes.append(Output(_Expression(body).whole()))
                continue
            words = _Expression(body)
            word = words.name()
            if word in ends:
                return tuple(nodes), word, words
            nodes.append(statement(word, words))
        if ends:
            raise TemplateError(f"{ends[-1]!r} is missing")
        return tuple(nodes), "", None

    def statement(word: str, words: _Expression):
        if word == "set":
            name = words.name()
            words.need("=")
            return Set(name, words.whole())
        if word == "generation":
            words.end()
            body, _, end = block(("endgeneration",))
            end.end()
            return Generation(body)
        if word == "for":
            name = words.name()
            words.need("in")
            over = words.name()
            words.end()
            body, _, end = block(("endfor",))
            end.end()
            return For(name, over, body)
        if word == "if":
            test = words.whole()
            yes, mark, rest = block(("elif", "else", "endif"))
            if mark == "elif":
                return If(test, yes, (statement("if", rest),))
            rest.end()
            no = ()
            if mark == "else":
                no, _, rest = block(("endif",))
                rest.end()
            return If(test, yes, no)
        raise TemplateError(f"no statement {word!r}")

    return block(())[0]


class _Folding:
    """The tree with its constants worked out; checks names and fields on the way."""

    def __init__(self):
        self.changing: set[str] = set()  # names set in the loop whose value may differ from turn to turn

    def value(self, node, known: Mapping[str, object], objects: Mapping[str, tuple[str, ...]]):
        """``known`` names stand for their value, or for themselves if they get one when the template runs."""
        if isinstance(node, Const):
            return node
        if isinstance(node, Name):
            if node.name not in known:
                raise TemplateError(f"no name {node.name!r}")
            return known[node.name]
        if isinstance(node, Field):
            if node.field not in objects.get(node.name, ()):
                raise TemplateError(f"no field {node.field!r} of {node.name!r}")
            return node
        if isinstance(node, Not):
            inner = self.value(node.value, known, objects)
            return Const(not inner.value) if isinstance(inner, Const) else Not(inner)
        if isinstance(node, Filter):
            inner = self.value(node.value, known, objects)
            return Const(FILTERS[node.name](_text(inner.value))) if isinstance(inner, Const) else Filter(node.name, inner)
        if isinstance(node, Choice):
            test, yes, no = (self.value(x, known, objects) for x in (node.test, node.yes, node.no))
            return (yes if test.value else no) if isinstance(test, Const) else Choice(test, yes, no)
        left, right = self.value(node.left, known, objects), self.value(node.right, known, objects)
        if isinstance(left, Const) and isinstance(right, Const):
            return Const(_BINARY[node.op](left.value, right.value))
        if node.op == "~" and isinstance(left, Binary) and left.op == "~" and isinstance(left.right, Const) and isinstance(right, Const):
            return Binary("~", left.left, Const(_text(left.right.value) + _text(right.value)))
        return Binary(node.op, left, right)

    def body(self, nodes: tuple, known: dict, objects: Mapping[str, tuple[str, ...]], marked: bool = False, branch: bool = False) -> tuple:
        out: list = []
        for node in nodes:
            if isinstance(node, Output):
                value = self.value(node.value, known, objects)
                if isinstance(value, Const):
                    value = Const(_text(value.value))
                    if not value.value:
                        continue
                    if out and isinstance(out[-1], Output) and isinstance(out[-1].value, Const):
                        value = Const(out.pop().value.value + value.value)
                out.append(Output(value))
            elif isinstance(node, Set):
                value = self.value(node.value, known, objects)
                if isinstance(value, Const) and node.name not in self.changing:
                    known[node.name] = value
                else:  # known when the template runs
                    if branch and node.name not in known:
                        raise TemplateError(f"{node.name!r} has no value outside a branch")
                    known[node.name] = Name(node.name)
                    out.append(Set(node.name, value))
            elif isinstance(node, If):
                test = self.value(node.test, known, objects)
                if isinstance(test, Const):
                    out.extend(self.body(node.yes if test.value else node.no, known, objects, marked, branch))
                else:
                    sides = [self.body(x, known, objects, marked, True) for x in (node.yes, node.no)]
                    out.append(If(test, *sides))
            elif isinstance(node, Generation):
                if marked:
                    raise TemplateError("generation within generation")
                out.append(Generation(self.body(node.body, known, objects, True, branch)))
            else:
                raise TemplateError("the loop over messages stands once, at the top of a template")
        return tuple(out)


def _assigned(nodes: tuple, branch: bool = False) -> Iterator[tuple[str, bool]]:
    """The names that nodes set, and whether within a branch."""
    for node in nodes:
        if isinstance(node, Set):
            yield node.name, branch
        elif isinstance(node, If):
            yield from _assigned(node.yes + node.no, True)
        elif isinstance(node, Generation):
            yield from _assigned(node.body, branch)


class Sink:
    """What is written, and the stretches under generation marks, in characters."""

    def __init__(self):
        self.parts: list[str] = []
        self.length = 0
        self.spans: list[tuple[int, int]] = []

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.length += len(text)


def _value_closure(node) -> Callable[[dict], object]:
    if isinstance(node, Const):
        constant = node.value
        return lambda env: constant
    if isinstance(node, Name):
        name = node.name
        return lambda env: env[name]
    if isinstance(node, Field):
        name, key = node.name, node.field
        return lambda env: env[name][key]
    if isinstance(node, Not):
        inner = _value_closure(node.value)
        return lambda env: not inner(env)
    if isinstance(node, Filter):
        function, inner = FILTERS[node.name], _value_closure(node.value)
        return lambda env: function(_text(inner(env)))
    if isinstance(node, Choice):
        test, yes, no = _value_closure(node.test), _value_closure(node.yes), _value_closure(node.no)
        return lambda env: yes(env) if test(env) else no(env)
    function, left, right = _BINARY[node.op], _value_closure(node.left), _value_closure(node.right)
    return lambda env: function(left(env), right(env))


def _body_closure(nodes: tuple) -> Callable[[dict, Sink], None]:
    steps = tuple(_node_closure(x) for x in nodes)

    def run(env: dict, sink: Sink) -> None:
        for step in steps:
            step(env, sink)

    return run


def _node_closure(node) -> Callable[[dict, Sink], None]:
    if isinstance(node, Output):
        if isinstance(node.value, Const):
            constant = node.value.value
            return lambda env, sink: sink.write(constant)
        value = _value_closure(node.value)
        return lambda env, sink: sink.write(_text(value(env)))
    if isinstance(node, Set):
        name, held = node.name, _value_closure(node.value)

        def assign(env, sink):
            env[name] = held(env)

        return assign
    if isinstance(node, If):
        test, yes, no = _value_closure(node.test), _body_closure(node.yes), _body_closure(node.no)
        return lambda env, sink: yes(env, sink) if test(env) else no(env, sink)
    body = _body_closure(node.body)

    def generate(env, sink):
        start = sink.length
        body(env, sink)
        sink.spans.append((start, sink.length))

    return generate


@dataclass(frozen=True)
class Template:
    """A compiled template: constant text before and after the messages, and a closure for each message."""

    before: str
    after: str
    name: str
    tree: tuple = field(repr=False)
    run: Callable[[dict, Sink], None] = field(repr=False)

    def message(self, message: Mapping[str, str], index0: int, last: bool) -> tuple[str, list[tuple[int, int]]]:
        """The output of one message, with the constant text around the first and the last."""
        sink = Sink()
        if index0 == 0:
            sink.write(self.before)
        loop = {"first": index0 == 0, "last": last, "index": index0 + 1, "index0": index0}
        self.run({self.name: message, "loop": loop}, sink)
        if last:
            sink.write(self.after)
        return "".join(sink.parts), sink.spans


def compile_template(source: str, fields: tuple[str, ...] = ("role", "text"), **constants: object) -> Template:
    """``fields`` are what a message has; ``constants`` are names the template may use, folded into it."""
    folding, known = _Folding(), {name: Const(value) for name, value in constants.items()}
    nodes = parse(source)
    loops = [i for i, node in enumerate(nodes) if isinstance(node, For)]
    if len(loops) != 1 or nodes[loops[0]].over != "messages":
        raise TemplateError("one loop over messages is needed")
    loop = nodes[loops[0]]
    if loop.name == "loop" or loop.name in known:
        raise TemplateError(f"the name {loop.name!r} is taken")

    def constant(part: tuple) -> str:
        found = folding.body(part, known, {})
        if any(not isinstance(x, Output) for x in found):
            raise TemplateError("generation stands within the loop")
        return "".join(x.value.value for x in found)

    before = constant(nodes[: loops[0]])
    objects = {loop.name: tuple(fields), "loop": LOOP_FIELDS}
    assigned = list(_assigned(loop.body))
    names = [name for name, _ in assigned]
    folding.changing = {name for name, branch in assigned if branch or names.count(name) > 1 or name in known}
    # a name that has a value before the loop has it again for each message
    again = tuple(Set(name, known[name]) for name in sorted(folding.changing & known.keys()))
    tree = folding.body(again + loop.body, dict(known), objects)
    return Template(before, constant(nodes[loops[0] + 1 :]), loop.name, tree, _body_closure(tree))
