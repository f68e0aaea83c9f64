"""A small sandboxed template language for chats, compiled to Python closures.

    {{ expression }}   {% for x in xs %}..{% endfor %}   {% if a %}..{% elif b %}..{% else %}..{% endif %}
    {% set x = expression %}   {% generation %}..{% endgeneration %}

Expressions have strings, integers, names, .key and [index], ~ (joins), + - , == != < > <= >= in, not,
and, or, parentheses and filters (trim, upper, lower, length, escape). Nothing else can be reached:
names that begin with _ are refused, values are only strings, numbers, lists and dicts, and filters
come from a fixed table. What {% generation %} encloses is reported as spans of code points.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable
from dataclasses import dataclass

_PARTS = re.compile(r"(\{\{.*?\}\}|\{%.*?%\})", re.S)
_TOKEN = re.compile(r"""\s*(?:(?P<string>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[|.~+\-<>()\[\],=]))""", re.S)
_STRING_ESCAPES = {"n": "\n", "t": "\t", "\\": "\\", "'": "'", '"': '"'}
_COMPARE = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, ">": operator.gt, "<=": operator.le,
            ">=": operator.ge, "in": lambda a, b: a in b}


class TemplateError(ValueError):
    pass


@dataclass(frozen=True)
class Node:
    kind: str
    value: object = None
    parts: tuple = ()


class _Expression:
    """Recursive descent over one expression's tokens."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.strip()
        while at < len(source):
            if not (m := _TOKEN.match(source, at)):
                raise TemplateError(f"can't read {source[at:at + 20]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] != "string" else None

    def take(self, *wanted: str) -> str | None:
        if (found := self.peek()) is not None and found in wanted:
            self.at += 1
            return found
        return None

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise TemplateError(f"expected {wanted!r}")

    def name(self) -> str:
        kind, text = self.tokens[self.at] if self.at < len(self.tokens) else (None, "")
        if kind != "name" or text.startswith("_"):
            raise TemplateError(f"no name: {text!r}")
        self.at += 1
        return text

    def whole(self) -> Node:
        node = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"left over: {self.tokens[self.at][1]!r}")
        return node

    def either(self) -> Node:
        node = self.both()
        while self.take("or"):
            node = Node("or", parts=(node, self.both()))
        return node

    def both(self) -> Node:
        node = self.negated()
        while self.take("and"):
            node = Node("and", parts=(node, self.negated()))
        return node

    def negated(self) -> Node:
        return Node("not", parts=(self.negated(),)) if self.take("not") else self.compared()

    def compared(self) -> Node:
        node = self.joined()
        while sign := self.take(*_COMPARE):
            node = Node("compare", sign, (node, self.joined()))
        return node

    def joined(self) -> Node:
        node = self.filtered()
        while sign := self.take("~", "+", "-"):
            node = Node("join" if sign == "~" else sign, parts=(node, self.filtered()))
        return node

    def filtered(self) -> Node:
        node = self.reached()
        while self.take("|"):
            node = Node("filter", self.name(), (node,))
        return node

    def reached(self) -> Node:
        node = self.atom()
        while sign := self.take(".", "["):
            if sign == ".":
                node = Node("get", parts=(node, Node("const", self.name())))
            else:
                node = Node("get", parts=(node, self.either()))
                self.need("]")
        return node

    def atom(self) -> Node:
        if self.take("("):
            node = self.either()
            self.need(")")
            return node
        kind, text = self.tokens[self.at] if self.at < len(self.tokens) else (None, "")
        if kind == "string":
            self.at += 1
            return Node("const", re.sub(r"\\(.)", lambda m: _STRING_ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S))
        if kind == "int":
            self.at += 1
            return Node("const", int(text))
        return Node("name", self.name())


def parse(source: str) -> Node:
    """The syntax tree of a template."""
    pieces = [p for p in _PARTS.split(source) if p]
    at = 0

    def block(ends: tuple[str, ...]) -> tuple[Node, str]:
        nonlocal at
        found = []
        while at < len(pieces):
            piece = pieces[at]
            at += 1
            if piece.startswith("{{"):
                found.append(Node("print", parts=(_Expression(piece[2:-2]).whole(),)))
                continue
            if not piece.startswith("{%"):
                found.append(Node("print", parts=(Node("const", piece),)))
                continue
            statement = piece[2:-2].strip()
            word, _, rest = statement.partition(" ")
            if word in ends:
                return Node("block", parts=tuple(found)), statement
            if word == "for":
                names = _Expression(rest)
                loop = names.name()
                names.need("in")
                over, (body, _) = names.whole(), block(("endfor",))
                found.append(Node("for", loop, (over, body)))
            elif word == "if":
                found.append(branch(rest))
            elif word == "set":
                names = _Expression(rest)
                name = names.name()
                names.need("=")
                found.append(Node("set", name, (names.whole(),)))
            elif word == "generation":
                found.append(Node("generation", parts=(block(("endgeneration",))[0],)))
            else:
                raise TemplateError(f"unknown statement {statement!r}")
        if ends:
            raise TemplateError(f"no {ends[-1]}")
        return Node("block", parts=tuple(found)), ""

    def branch(condition: str) -> Node:
        body, end = block(("elif", "else", "endif"))
        other = Node("block")
        if end.startswith("elif"):
            other = branch(end[4:])
        elif end == "else":
            other, _ = block(("endif",))
        return Node("if", parts=(_Expression(condition).whole(), body, other))

    return block(())[0]


class Compiler:
    """Folds constants, then turns nodes into closures. filters: name -> function of one value."""

    def __init__(self, filters: dict[str, Callable]):
        self.filters = {"trim": str.strip, "upper": str.upper, "lower": str.lower, "length": len} | filters

    def fold(self, node: Node) -> Node:
        parts = tuple(map(self.fold, node.parts))
        node = Node(node.kind, node.value, parts)
        constant = all(p.kind == "const" for p in parts)
        if node.kind == "filter" and node.value not in self.filters:
            raise TemplateError(f"unknown filter {node.value!r}")
        if parts and constant and node.kind in ("join", "+", "-", "compare", "not", "and", "or", "filter", "get"):
            return Node("const", self.expression(node)({}))
        if node.kind == "if" and parts[0].kind == "const":
            return parts[1] if parts[0].value else parts[2]
        if node.kind == "block":
            flat: list[Node] = []
            for p in (q for x in parts for q in (x.parts if x.kind == "block" else (x,))):
                text = p.kind == "print" and p.parts[0].kind == "const"
                if text and flat and flat[-1].kind == "print" and flat[-1].parts[0].kind == "const":
                    joined = str(flat[-1].parts[0].value) + str(p.parts[0].value)
                    flat[-1] = Node("print", parts=(Node("const", joined),))
                else:
                    flat.append(p)
            return Node("block", parts=tuple(flat))
        return node

    def expression(self, node: Node) -> Callable[[dict], object]:
        f = [self.expression(p) for p in node.parts]
        match node.kind:
            case "const":
                return lambda env, v=node.value: v
            case "name":
                return lambda env, k=node.value: env.get(k, "")
            case "get":
                return lambda env: _reach(f[0](env), f[1](env))
            case "join":
                return lambda env: str(f[0](env)) + str(f[1](env))
            case "+":
                return lambda env: f[0](env) + f[1](env)
            case "-":
                return lambda env: f[0](env) - f[1](env)
            case "compare":
                return lambda env, op=_COMPARE[node.value]: op(f[0](env), f[1](env))
            case "not":
                return lambda env: not f[0](env)
            case "and":
                return lambda env: f[0](env) and f[1](env)
            case "or":
                return lambda env: f[0](env) or f[1](env)
            case "filter":
                return lambda env, g=self.filters[node.value]: g(f[0](env))
        raise TemplateError(node.kind)

    def statement(self, node: Node) -> Callable[[dict, Output], None]:
        match node.kind:
            case "block":
                steps = [self.statement(p) for p in node.parts]

                def run(env, out):
                    for step in steps:
                        step(env, out)
                return run
            case "print" if node.parts[0].kind == "const":
                return lambda env, out, text=str(node.parts[0].value): out.put(text)
            case "print":
                value = self.expression(node.parts[0])
                return lambda env, out: out.put(str(value(env)))
            case "set":
                value = self.expression(node.parts[0])
                return lambda env, out, k=node.value: env.__setitem__(k, value(env))
            case "if":
                test, then, other = self.expression(node.parts[0]), self.statement(node.parts[1]), self.statement(node.parts[2])
                return lambda env, out: (then if test(env) else other)(env, out)
            case "for":
                over, body = self.expression(node.parts[0]), self.statement(node.parts[1])

                def loop(env, out, k=node.value):
                    items = over(env)
                    for i, item in enumerate(items):
                        body(env | {k: item, "loop": {"index": i + 1, "first": i == 0, "last": i == len(items) - 1}}, out)
                return loop
            case "generation":
                body = self.statement(node.parts[0])

                def marked(env, out):
                    start = out.length
                    body(env, out)
                    out.spans.append((start, out.length))
                return marked
        raise TemplateError(node.kind)


def _reach(holder: object, key: object) -> object:
    if isinstance(holder, dict):
        return holder.get(key, "")
    if isinstance(holder, (list, str)) and isinstance(key, int):
        return holder[key] if -len(holder) <= key < len(holder) else ""
    raise TemplateError(f"{type(holder).__name__} has no {key!r}")


class Output:
    """What a template has printed so far, and the spans of its generations."""

    def __init__(self):
        self.parts, self.length, self.spans = [], 0, []

    def put(self, text: str) -> None:
        self.parts.append(text)
        self.length += len(text)


class Template:
    """controls: the strings that mark turns. In `| escape` each one that a text contains gets a
    backslash after its first character, and backslashes are doubled; unescape() takes that back."""

    def __init__(self, source: str, controls: tuple[str, ...]):
        longest = sorted(controls, key=len, reverse=True)
        self._controls = re.compile("|".join([r"\\", *map(re.escape, longest)]))
        compiler = Compiler({"escape": self.escape})
        self.tree = compiler.fold(parse(source))
        self._run = compiler.statement(self.tree)

    def escape(self, text: str) -> str:
        return self._controls.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(\\?)", r"\1", text) if "\\" in text else text

    def render(self, **values: object) -> tuple[str, list[tuple[int, int]]]:
        out = Output()
        self._run(dict(values), out)
        return "".join(out.parts), out.spans
