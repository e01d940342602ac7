"""A small template language for conversations, compiled to Python closures.

    {{ expression | filter }}   {% for m in messages %} ... {% endfor %}   {% set x = expression %}
    {% if e %} ... {% elif e %} ... {% else %} ... {% endif %}   {% generation %} ... {% endgeneration %}   {# note #}

Expressions: strings, integers, true, false, none, names, ``m.field`` and ``m['field']`` of mappings,
``loop.first/last/index/index0``, ``not and or``, ``== != < <= > >= in``, ``+ - ~``, parentheses and
the filters of FILTERS. The sandbox is the language itself: there are no calls, no attributes of
Python objects, no imports, and the generated closures touch nothing but mappings and filters.

Compiling: lexer, recursive-descent parser to a syntax tree, constant folding (constant operands and
filters, branches never taken, neighbouring literal text), then a closure for each node. Rendering
is a generator of (text, under the generation mask); ``messages`` may be any iterator, consumed once
with one message of lookahead, so an arbitrarily long conversation renders in bounded memory.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any


class TemplateError(ValueError):
    """The template can't be parsed, or an expression has no value."""


# -- control strings -------------------------------------------------------------------------

#: Strings that mark structure in common chat formats; inside texts they are broken up.
CONTROL = ("<|turn|>", "<|text|>", "<|end|>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "<unk>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]")
_CONTROL = re.compile("|".join(re.escape(x) for x in sorted(CONTROL, key=len, reverse=True)))
_BACK = re.compile(r"\\(\\?)")


def escape(text: str) -> str:
    """text without any control string: backslashes are doubled, and a single one is put after the
    first character of each control string."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    """The inverse of escape."""
    return _BACK.sub(r"\1", text)


FILTERS: dict[str, Callable[[Any], Any]] = {
    "escape": lambda x: escape(_text(x)), "trim": lambda x: _text(x).strip(), "upper": lambda x: _text(x).upper(), "lower": lambda x: _text(x).lower(), "length": lambda x: _length(x), "string": lambda x: _text(x),
}


def _length(x: Any) -> int:
    if not isinstance(x, (str, dict, list, tuple)):
        raise TemplateError(f"{x!r} has no length")
    return len(x)


def _text(x: Any) -> str:
    return "" if x is None else ("true" if x else "false") if isinstance(x, bool) else str(x)


# -- syntax tree -----------------------------------------------------------------------------


@dataclass
class Const:
    value: Any


@dataclass
class Name:
    name: str


@dataclass
class Get:
    of: Any
    key: str


@dataclass
class Op:
    op: str
    args: list[Any]


@dataclass
class Filter:
    name: str
    of: Any


@dataclass
class Out:
    expr: Any


@dataclass
class For:
    name: str
    over: Any
    body: list[Any]


@dataclass
class If:
    cases: list[tuple[Any, list[Any]]] = field(default_factory=list)  # the condition of else is Const(True)


@dataclass
class Set:
    name: str
    expr: Any


@dataclass
class Generation:
    body: list[Any]


_LEX = re.compile(r"(\{\{-?.*?-?\}\}|\{%-?.*?-?%\}|\{#.*?#\})", re.S)
_TOKEN = re.compile(r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[<>=+\-~|.()\[\]]))")
_ESC = {"n": "\n", "t": "\t", "r": "\r"}
_ORDER = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "in": lambda a, b: a in b, "+": lambda a, b: a + b, "-": lambda a, b: a - b, "~": lambda a, b: _text(a) + _text(b)}


class _Expr:
    """Recursive descent over the tokens of one tag."""

    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text.rstrip()):
            if not (m := _TOKEN.match(text, at)):
                raise TemplateError(f"unexpected {text[at:].strip()[:10]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> str:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] != "str" else ""

    def take(self, *wanted: str) -> str:
        if (got := self.peek()) in wanted and got:
            self.at += 1
            return got
        return ""

    def need(self, kind: str) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != kind:
            raise TemplateError(f"a {kind} is missing")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def done(self, x: Any) -> Any:
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return x

    def expr(self) -> Any:
        x = self.both()
        while self.take("or"):
            x = Op("or", [x, self.both()])
        return x

    def both(self) -> Any:
        x = self.negated()
        while self.take("and"):
            x = Op("and", [x, self.negated()])
        return x

    def negated(self) -> Any:
        return Op("not", [self.negated()]) if self.take("not") else self.compared()

    def compared(self) -> Any:
        x = self.summed()
        while op := self.take("==", "!=", "<", "<=", ">", ">=", "in"):
            x = Op(op, [x, self.summed()])
        return x

    def summed(self) -> Any:
        x = self.filtered()
        while op := self.take("+", "-", "~"):
            x = Op(op, [x, self.filtered()])
        return x

    def filtered(self) -> Any:
        x = self.atom()
        while True:
            if self.take("|"):
                name = self.need("name")
                if name not in FILTERS:
                    raise TemplateError(f"unknown filter {name!r}")
                x = Filter(name, x)
            elif self.take("."):
                x = Get(x, self.need("name"))
            elif self.take("["):
                x = Get(x, _string(self.need("str")))
                if not self.take("]"):
                    raise TemplateError("] is missing")
            else:
                return x

    def atom(self) -> Any:
        if self.take("("):
            x = self.expr()
            if not self.take(")"):
                raise TemplateError(") is missing")
            return x
        if self.at >= len(self.tokens):
            raise TemplateError("an expression is missing")
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == "str":
            return Const(_string(text))
        if kind == "int":
            return Const(int(text))
        if kind == "name":
            return Const({"true": True, "false": False, "none": None}[text]) if text in ("true", "false", "none") else Name(text)
        raise TemplateError(f"unexpected {text!r}")


def _string(quoted: str) -> str:
    return re.sub(r"\\(.)", lambda m: _ESC.get(m[1], m[1]), quoted[1:-1], flags=re.S)


def parse(source: str) -> list[Any]:
    """The syntax tree of a template."""
    root: list[Any] = []
    open_: list[tuple[str, Any, list[Any]]] = [("", None, root)]
    trim = False
    for part in _LEX.split(source):
        body = open_[-1][2]
        if not _LEX.fullmatch(part):
            text = part.lstrip() if trim else part
            trim = False
            if text:
                body.append(Out(Const(text)))
            continue
        if part.startswith("{#"):
            continue
        if part[2] == "-" and body and isinstance(body[-1], Out) and isinstance(body[-1].expr, Const):
            body[-1] = Out(Const(_text(body[-1].expr.value).rstrip()))
        trim = part[-3] == "-"
        inner = part[2:-2].removeprefix("-").removesuffix("-")
        e = _Expr(inner)
        if part.startswith("{{"):
            body.append(Out(e.done(e.expr())))
            continue
        word = e.need("name")
        if word == "for":
            name = e.need("name")
            if not e.take("in"):
                raise TemplateError("in is missing")
            node = For(name, e.done(e.expr()), [])
            body.append(node)
            open_.append(("for", node, node.body))
        elif word == "if":
            node = If([(e.done(e.expr()), [])])
            body.append(node)
            open_.append(("if", node, node.cases[-1][1]))
        elif word in ("elif", "else") and open_[-1][0] == "if":
            node = open_.pop()[1]
            node.cases.append((e.done(e.expr()) if word == "elif" else e.done(Const(True)), []))
            open_.append(("if", node, node.cases[-1][1]))
        elif word == "generation":
            node = Generation([])
            body.append(e.done(node))
            open_.append(("generation", node, node.body))
        elif word == "set":
            name = e.need("name")
            if not e.take("="):
                raise TemplateError("= is missing")
            body.append(Set(name, e.done(e.expr())))
        elif word in ("endfor", "endif", "endgeneration") and open_[-1][0] == word[3:]:
            e.done(open_.pop())
        else:
            raise TemplateError(f"unexpected {word!r}")
    if len(open_) > 1:
        raise TemplateError(f"{open_[-1][0]} isn't closed")
    return root


# -- constant folding ------------------------------------------------------------------------


def fold(x: Any) -> Any:
    """The same tree with constant parts worked out."""
    if isinstance(x, list):
        out: list[Any] = []
        for y in map(fold, x):
            if isinstance(y, If) and y.cases and isinstance(y.cases[0][0], Const):
                out += y.cases[0][1]  # the first branch is taken whatever the messages
            elif isinstance(y, Out) and isinstance(y.expr, Const) and out and isinstance(out[-1], Out) and isinstance(out[-1].expr, Const):
                out[-1] = Out(Const(_text(out[-1].expr.value) + _text(y.expr.value)))
            elif not (isinstance(y, If) and not y.cases):
                out.append(y)
        return out
    if isinstance(x, Op):
        args = [fold(a) for a in x.args]
        if all(isinstance(a, Const) for a in args):
            return Const(_apply(x.op, *(a.value for a in args)))
        return Op(x.op, args)
    if isinstance(x, Filter):
        of = fold(x.of)
        return Const(FILTERS[x.name](of.value)) if isinstance(of, Const) else Filter(x.name, of)
    if isinstance(x, Get):
        return Get(fold(x.of), x.key)
    if isinstance(x, Out):
        return Out(fold(x.expr))
    if isinstance(x, Set):
        return Set(x.name, fold(x.expr))
    if isinstance(x, For):
        return For(x.name, fold(x.over), fold(x.body))
    if isinstance(x, Generation):
        return Generation(fold(x.body))
    if isinstance(x, If):
        cases: list[tuple[Any, list[Any]]] = []
        for cond, body in x.cases:
            c = fold(cond)
            if isinstance(c, Const) and not c.value:
                continue
            cases.append((c, fold(body)))
            if isinstance(c, Const):
                break
        return If(cases)
    return x


def _apply(op: str, *v: Any) -> Any:
    if op == "not":
        return not v[0]
    if op in ("and", "or"):
        return (v[0] and v[1]) if op == "and" else (v[0] or v[1])
    try:
        return _ORDER[op](*v)
    except TypeError as e:
        raise TemplateError(str(e)) from None


# -- closures --------------------------------------------------------------------------------

Env = dict[str, Any]
Piece = tuple[str, bool]


def _value(x: Any) -> Callable[[Env], Any]:
    if isinstance(x, Const):
        v = x.value
        return lambda env: v
    if isinstance(x, Name):
        name = x.name

        def look(env: Env) -> Any:
            if name not in env:
                raise TemplateError(f"unknown name {name!r}")
            return env[name]

        return look
    if isinstance(x, Get):
        of, key = _value(x.of), x.key

        def get(env: Env) -> Any:
            m = of(env)
            if not isinstance(m, dict):
                raise TemplateError(f"{key!r} is asked of something that has no fields")
            return m.get(key)

        return get
    if isinstance(x, Filter):
        f, of = FILTERS[x.name], _value(x.of)
        return lambda env: f(of(env))
    op, args = x.op, [_value(a) for a in x.args]
    if op == "not":
        return lambda env: not args[0](env)
    if op == "and":
        return lambda env: args[0](env) and args[1](env)
    if op == "or":
        return lambda env: args[0](env) or args[1](env)
    return lambda env: _apply(op, args[0](env), args[1](env))


def _items(x: Any) -> Iterator[Any]:
    if isinstance(x, str) or not isinstance(x, Iterable):
        raise TemplateError(f"{x!r} can't be looped over")
    return iter(x)


def _body(nodes: list[Any], masked: bool) -> Callable[[Env], Iterator[Piece]]:
    steps = [_step(n, masked) for n in nodes]

    def run(env: Env) -> Iterator[Piece]:
        for s in steps:
            yield from s(env)

    return run


def _step(x: Any, masked: bool) -> Callable[[Env], Iterable[Piece]]:
    if isinstance(x, Out):
        if isinstance(x.expr, Const):
            fixed = ((_text(x.expr.value), masked),)
            return lambda env: fixed
        value = _value(x.expr)
        return lambda env: ((_text(value(env)), masked),)
    if isinstance(x, Set):
        name, value = x.name, _value(x.expr)

        def put(env: Env) -> Iterable[Piece]:
            env[name] = value(env)
            return ()

        return put
    if isinstance(x, Generation):
        return _body(x.body, True)
    if isinstance(x, If):
        cases = [(_value(c), _body(b, masked)) for c, b in x.cases]

        def branch(env: Env) -> Iterable[Piece]:
            for cond, body in cases:
                if cond(env):
                    return body(env)
            return ()

        return branch
    name, over, body = x.name, _value(x.over), _body(x.body, masked)

    def loop(env: Env) -> Iterator[Piece]:
        items, nothing = _items(over(env)), object()
        item, i = next(items, nothing), 0
        inner = dict(env)
        while item is not nothing:
            following = next(items, nothing)
            inner[name], inner["loop"] = item, {"first": i == 0, "last": following is nothing, "index": i + 1, "index0": i}
            yield from body(inner)
            item, i = following, i + 1

    return loop


class Template:
    """A compiled template."""

    def __init__(self, source: str):
        self.source = source
        self.tree = fold(parse(source))
        self._run = _body(self.tree, False)

    def __reduce__(self):
        return Template, (self.source,)

    def pieces(self, messages: Iterable[dict[str, Any]], **names: Any) -> Iterator[Piece]:
        """The rendered text in order, each piece with whether it is under the generation mask."""
        return self._run({"messages": messages, **names})

    def render(self, messages: Iterable[dict[str, Any]], **names: Any) -> tuple[str, list[tuple[int, int]]]:
        """The whole text, and the spans of code points under the mask."""
        out, spans, at = [], [], 0
        for text, masked in self.pieces(messages, **names):
            out.append(text)
            if masked and text:
                spans.append((at, at + len(text)))
            at += len(text)
        return "".join(out), spans
