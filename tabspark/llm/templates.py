"""A small, closed template language, compiled to Python closures.

    {{ expression }}    {% set name = expression %}    {% if e %} {% elif e %} {% else %} {% endif %}
    {% for x in e %} {% endfor %}    {% generation %} {% endgeneration %}

Expressions have texts, whole numbers, true, false, none, names, ``a.b`` (an entry of a mapping),
``== != and or not``, ``+`` (texts), ``a if c else b``, parentheses and filters ``e | name`` out of a
given set. There is no call, no index, no attribute of a Python object and no import, so a template
reaches nothing but the values it is given. In a loop, ``loop.first``, ``loop.last`` and ``loop.index``
are known; a loop takes its rows one by one, so a conversation of any length is never held whole.

``compile_template`` parses to a syntax tree of tuples, folds what is constant, and builds a closure
for every node. Rendering yields (text, generated): pieces in order, and whether each stands in a
generation block.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

Filters = dict[str, Callable[[str], str]]
Scope = dict[str, object]
Piece = tuple[str, bool]

_TAG = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
_TOKEN = re.compile(r"\s*(?:(?P<text>'(?:[^'\\]|\\.)*')|(?P<number>\d+)|(?P<word>[A-Za-z_]\w*)|(?P<sign>==|!=|[+|().]))", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "'": "'", "\\": "\\"}
_VALUES = {"true": True, "false": False, "none": None}
_RESERVED = {"and", "or", "not", "if", "else", "in"}


class TemplateError(ValueError):
    pass


class _Expression:
    """Recursive descent over the tokens of one tag."""

    def __init__(self, source: str, filters: Filters):
        self.filters, self.tokens, at = filters, [], 0
        while at < len(source.rstrip()):
            found = _TOKEN.match(source, at)
            if not found:
                raise TemplateError(f"Unreadable from here: {source[at:]!r}")
            self.tokens.append((found.lastgroup, found[found.lastgroup]))
            at = found.end()
        self.at = 0

    def take(self, *wanted: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] != "text" and self.tokens[self.at][1] in wanted:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise TemplateError(f"{wanted!r} is missing")

    def name(self) -> str:
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
        if kind != "word" or value in _RESERVED or value in _VALUES:
            raise TemplateError(f"A name is expected, not {value!r}")
        self.at += 1
        return value

    def whole(self) -> tuple:
        tree = self.choice()
        if self.at < len(self.tokens):
            raise TemplateError(f"Not expected: {self.tokens[self.at][1]!r}")
        return tree

    def choice(self) -> tuple:
        tree = self.chain(("or",), lambda: self.chain(("and",), self.inverse))
        if self.take("if"):
            test = self.chain(("or",), lambda: self.chain(("and",), self.inverse))
            self.need("else")
            return ("choice", test, tree, self.choice())
        return tree

    def chain(self, signs: tuple[str, ...], lower: Callable[[], tuple]) -> tuple:
        tree = lower()
        while sign := self.take(*signs):
            tree = (sign, tree, lower())
        return tree

    def inverse(self) -> tuple:
        return ("not", self.inverse()) if self.take("not") else self.chain(("==", "!="), lambda: self.chain(("+",), self.filtered))

    def filtered(self) -> tuple:
        tree = self.plain()
        while True:
            if self.take("|"):
                name = self.name()
                if name not in self.filters:
                    raise TemplateError(f"There is no filter {name!r}")
                tree = ("filter", name, tree)
            elif self.take("."):
                tree = ("entry", tree, self.name())
            else:
                return tree

    def plain(self) -> tuple:
        if self.take("("):
            tree = self.choice()
            self.need(")")
            return tree
        if self.at >= len(self.tokens):
            raise TemplateError("An expression ends too early")
        kind, value = self.tokens[self.at]
        if kind in ("text", "number") or value in _VALUES:
            self.at += 1
            if kind == "text":
                return ("value", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[0]), value[1:-1], flags=re.S))
            return ("value", int(value) if kind == "number" else _VALUES[value])
        return ("name", self.name())


def parse(source: str, filters: Filters) -> tuple:
    """The syntax tree of a template."""
    items, at = [], 0
    for tag in _TAG.finditer(source):
        if tag.start() > at:
            items.append(("raw", source[at : tag.start()]))
        items.append(("show", tag[1]) if tag[1] is not None else ("tag", *(tag[2].strip().split(None, 1) + [""])[:2]))
        at = tag.end()
    if at < len(source):
        items.append(("raw", source[at:]))
    tree, rest, end = _block(items, 0, (), filters)
    return tree


def _block(items: list[tuple], at: int, ends: tuple[str, ...], filters: Filters) -> tuple[tuple, int, tuple]:
    nodes: list[tuple] = []
    while at < len(items):
        kind, *x = items[at]
        at += 1
        if kind == "raw":
            nodes.append(("show", ("value", x[0])))
        elif kind == "show":
            nodes.append(("show", _Expression(x[0], filters).whole()))
        elif x[0] in ends:
            return ("block", nodes), at, tuple(x)
        elif x[0] == "set":
            tag = _Expression(x[1].replace("=", " ", 1) if "=" in x[1] else x[1], filters)
            nodes.append(("set", tag.name(), tag.whole()))
        elif x[0] == "for":
            tag = _Expression(x[1], filters)
            name = tag.name()
            tag.need("in")
            rows = tag.whole()
            body, at, _ = _block(items, at, ("endfor",), filters)
            nodes.append(("for", name, rows, body))
        elif x[0] == "generation":
            body, at, _ = _block(items, at, ("endgeneration",), filters)
            nodes.append(("generation", body))
        elif x[0] == "if":
            arms, test, otherwise = [], _Expression(x[1], filters).whole(), ("block", [])
            while True:
                body, at, end = _block(items, at, ("elif", "else", "endif"), filters)
                if test is None:
                    otherwise = body
                else:
                    arms.append((test, body))
                if end[0] == "endif":
                    break
                test = _Expression(end[1], filters).whole() if end[0] == "elif" else None
            nodes.append(("if", arms, otherwise))
        else:
            raise TemplateError(f"There is no tag {x[0]!r} here")
    if ends:
        raise TemplateError(f"{ends[-1]!r} is missing")
    return ("block", nodes), at, ()


def fold(tree: tuple, filters: Filters) -> tuple:
    """Work out what is constant, drop arms that are never taken, and join neighbouring texts."""
    kind = tree[0]
    if kind in ("value", "name"):
        return tree
    if kind == "entry":
        return ("entry", fold(tree[1], filters), tree[2])
    if kind == "filter":
        inner = fold(tree[2], filters)
        return ("value", filters[tree[1]](_text(inner[1]))) if inner[0] == "value" else ("filter", tree[1], inner)
    if kind in ("not", "and", "or", "==", "!=", "+", "choice"):
        parts = [fold(t, filters) for t in tree[1:]]
        if all(p[0] == "value" for p in parts):
            return ("value", _value((kind, *parts), filters)({}))
        if parts[0][0] == "value" and kind in ("and", "or", "choice"):
            if kind == "choice":
                return parts[1] if parts[0][1] else parts[2]
            return parts[1] if bool(parts[0][1]) == (kind == "and") else parts[0]
        return (kind, *parts)
    if kind == "show":
        return ("show", fold(tree[1], filters))
    if kind == "set":
        return ("set", tree[1], fold(tree[2], filters))
    if kind == "for":
        return ("for", tree[1], fold(tree[2], filters), fold(tree[3], filters))
    if kind == "generation":
        return ("generation", fold(tree[1], filters))
    if kind == "if":
        arms = []
        for test, body in tree[1]:
            test = fold(test, filters)
            if test[0] == "value":
                if test[1]:
                    return ("if", arms, fold(body, filters)) if arms else fold(body, filters)
                continue
            arms.append((test, fold(body, filters)))
        rest = fold(tree[2], filters)
        return ("if", arms, rest) if arms else rest
    nodes: list[tuple] = []
    for node in (fold(t, filters) for t in tree[1]):
        for n in node[1] if node[0] == "block" else [node]:
            if n[0] == "show" and n[1][0] == "value" and nodes and nodes[-1][0] == "show" and nodes[-1][1][0] == "value":
                nodes[-1] = ("show", ("value", _text(nodes[-1][1][1]) + _text(n[1][1])))
            else:
                nodes.append(n)
    return ("block", nodes)


def _text(x: object) -> str:
    return "" if x is None else ("true" if x else "false") if isinstance(x, bool) else str(x)


def _value(tree: tuple, filters: Filters) -> Callable[[Scope], object]:
    kind = tree[0]
    if kind == "value":
        return lambda scope, x=tree[1]: x
    if kind == "name":
        return lambda scope, x=tree[1]: scope.get(x)
    if kind == "filter":
        run, inner = filters[tree[1]], _value(tree[2], filters)
        return lambda scope: run(_text(inner(scope)))
    if kind == "entry":
        inner, key = _value(tree[1], filters), tree[2]

        def entry(scope: Scope) -> object:
            held = inner(scope)
            return held.get(key) if type(held) is dict else None

        return entry
    parts = [_value(t, filters) for t in tree[1:]]
    a, b = parts[0], parts[-1]
    if kind == "not":
        return lambda scope: not a(scope)
    if kind == "and":
        return lambda scope: a(scope) and b(scope)
    if kind == "or":
        return lambda scope: a(scope) or b(scope)
    if kind == "==":
        return lambda scope: a(scope) == b(scope)
    if kind == "!=":
        return lambda scope: a(scope) != b(scope)
    if kind == "+":
        return lambda scope: _text(a(scope)) + _text(b(scope))
    chosen = parts[1]
    return lambda scope: chosen(scope) if a(scope) else b(scope)


Run = Callable[[Scope, bool], Iterator[Piece]]


def _run(tree: tuple, filters: Filters) -> Run:
    kind = tree[0]
    if kind == "show":
        value = _value(tree[1], filters)

        def show(scope: Scope, generated: bool) -> Iterator[Piece]:
            if text := _text(value(scope)):
                yield text, generated

        return show
    if kind == "set":
        name, value = tree[1], _value(tree[2], filters)

        def assign(scope: Scope, generated: bool) -> Iterator[Piece]:
            scope[name] = value(scope)
            yield from ()

        return assign
    if kind == "generation":
        body = _run(tree[1], filters)
        return lambda scope, generated: body(scope, True)
    if kind == "if":
        arms = [(_value(t, filters), _run(b, filters)) for t, b in tree[1]]
        rest = _run(tree[2], filters)

        def branch(scope: Scope, generated: bool) -> Iterator[Piece]:
            return next((b for t, b in arms if t(scope)), rest)(scope, generated)

        return branch
    if kind == "for":
        name, rows, body = tree[1], _value(tree[2], filters), _run(tree[3], filters)

        def loop(scope: Scope, generated: bool) -> Iterator[Piece]:
            source: Iterable = rows(scope) or ()
            inner, index, end = dict(scope), 0, object()
            coming = iter(source if not isinstance(source, (str, dict)) else ())
            now = next(coming, end)
            while now is not end:
                after = next(coming, end)
                index += 1
                inner[name] = now
                inner["loop"] = {"index": index, "first": index == 1, "last": after is end}
                yield from body(inner, generated)
                now = after

        return loop
    nodes = [_run(t, filters) for t in tree[1]]

    def block(scope: Scope, generated: bool) -> Iterator[Piece]:
        for node in nodes:
            yield from node(scope, generated)

    return block


def compile_template(source: str, filters: Filters) -> Callable[[Scope], Iterator[Piece]]:
    run = _run(fold(parse(source, filters), filters), filters)
    return lambda scope: run(dict(scope), False)
