"""A small sandboxed template language, compiled to Python closures.

Text with ``{{ expression }}``, ``{# comment #}`` and the statements ``for``,
``if / elif / else``, ``set`` and ``generation`` (marks what the model is to
learn). Expressions have literals, names, fields of mappings, ``+ ~ == != < >
<= >= in not and or`` and the filters given to the compiler; nothing else can
be named or called. A template is parsed into a tree of tuples, constants are
folded, and each node becomes a closure. Rendering yields ``(text, marked)``
parts while it consumes what it loops over, so a long conversation is never
held whole.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Iterable, Iterator
from typing import Any

_TAG = re.compile(r"\{%-?(.*?)-?%\}|\{\{-?(.*?)-?\}\}|\{#.*?#\}", re.S)
_TOKEN = re.compile(r"\s*(?:(\d+)|(\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*')|([A-Za-z_]\w*)|(==|!=|<=|>=|[-+~<>()\[\].|,]))")
_ESCAPED = {"n": "\n", "t": "\t", "r": "\r"}
_COMPARE: dict[str, Callable[[Any, Any], Any]] = {
    "==": operator.eq, "!=": operator.ne, "<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge,
    "in": lambda a, b: a in b,
}
_NAMED = {"true": True, "false": False, "none": None}


class TemplateError(ValueError):
    """The template is not in the language."""


def _text(value: Any) -> str:
    return "" if value is None else str(value)


class _Expression:
    """Recursive descent over one expression's tokens, to a tree of tuples."""

    def __init__(self, source: str):
        self.tokens: list[tuple[str, str]] = []
        at, source = 0, source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"unexpected {source[at:at + 10]!r}")
            self.tokens.append((("int", "str", "name", "op")[m.lastindex - 1], m[m.lastindex]))
            at = m.end()
        self.at = 0

    def whole(self) -> tuple:
        tree = self._or()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return tree

    def _take(self, *values: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][1] in values and self.tokens[self.at][0] != "str":
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def _need(self, kind: str) -> str:
        if self.at < len(self.tokens) and kind in self.tokens[self.at]:
            self.at += 1
            return self.tokens[self.at - 1][1]
        raise TemplateError(f"{kind} expected")

    def _or(self) -> tuple:
        left = self._and()
        while self._take("or"):
            left = ("or", left, self._and())
        return left

    def _and(self) -> tuple:
        left = self._not()
        while self._take("and"):
            left = ("and", left, self._not())
        return left

    def _not(self) -> tuple:
        if self._take("not"):
            return ("not", self._not())
        left = self._sum()
        if op := self._take(*_COMPARE):
            return ("compare", op, left, self._sum())
        return left

    def _sum(self) -> tuple:
        left = self._filtered()
        while op := self._take("+", "~"):
            left = ("join" if op == "~" else "add", left, self._filtered())
        return left

    def _filtered(self) -> tuple:
        tree = self._primary()
        while op := self._take(".", "[", "|"):
            if op == "[":
                tree = ("field", tree, self._or())
                self._need("]")
            else:
                tree = ("field" if op == "." else "filter", tree, ("value", self._need("name")))
        return tree

    def _primary(self) -> tuple:
        if self.at >= len(self.tokens):
            raise TemplateError("an expression ends early")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "int":
            return ("value", int(value))
        if kind == "str":
            return ("value", re.sub(r"\\(.)", lambda m: _ESCAPED.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "name":
            return ("value", _NAMED[value]) if value in _NAMED else ("name", value)
        if value == "(":
            tree = self._or()
            self._need(")")
            return tree
        raise TemplateError(f"unexpected {value!r}")


def parse(source: str) -> tuple:
    """The template as a tree: ``("block", parts)``."""
    stack: list[tuple[str, Any, list]] = [("block", None, [])]
    at = 0
    trim = False
    for m in [*_TAG.finditer(source), None]:
        text = source[at : m.start() if m else len(source)]
        text = text.lstrip() if trim else text
        if m and m[0][2] == "-":
            text = text.rstrip()
        if text:
            stack[-1][2].append(("out", ("value", text)))
        if not m:
            break
        at, trim = m.end(), m[0][-3] == "-"
        if m[2] is not None:
            stack[-1][2].append(("out", _Expression(m[2]).whole()))
        elif m[1] is not None:
            _statement(m[1].strip(), stack)
    if len(stack) != 1:
        raise TemplateError(f"{stack[-1][0]} is not ended")
    return ("block", stack[0][2])


def _statement(source: str, stack: list[tuple[str, Any, list]]) -> None:
    word, _, rest = source.partition(" ")
    if word == "for" and (m := re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)):
        stack.append(("for", (m[1], _Expression(m[2]).whole()), []))
    elif word == "if":
        stack.append(("if", [(_Expression(rest).whole(), None)], []))
    elif word in ("elif", "else") and stack[-1][0] == "if":
        _, branches, body = stack.pop()
        branches = [*branches[:-1], (branches[-1][0], body)]
        stack.append(("if", [*branches, (_Expression(rest).whole() if word == "elif" else ("value", True), None)], []))
    elif word == "set" and (m := re.fullmatch(r"\s*([A-Za-z_]\w*)\s*=\s*(.+)", rest, re.S)):
        stack[-1][2].append(("set", m[1], _Expression(m[2]).whole()))
    elif word == "generation":
        stack.append(("generation", None, []))
    elif word.startswith("end") and stack[-1][0] == word[3:]:
        kind, head, body = stack.pop()
        if kind == "if":
            node = ("if", [*head[:-1], (head[-1][0], body)])
            node = ("if", [(c, ("block", b)) for c, b in node[1]])
        elif kind == "for":
            node = ("for", head[0], head[1], ("block", body))
        else:
            node = ("generation", ("block", body))
        stack[-1][2].append(node)
    else:
        raise TemplateError(f"unexpected statement {source!r}")


def fold(tree: tuple, filters: dict[str, Callable[[str], Any]]) -> tuple:
    """The tree with constant expressions evaluated, dead branches gone and texts joined."""
    kind = tree[0]
    if kind in ("value", "name"):
        return tree
    if kind == "block":
        parts: list[tuple] = []
        for part in (fold(x, filters) for x in tree[1]):
            flat = part[1] if part[0] == "block" else [part]
            for x in flat:
                if x[0] == "out" and x[1][0] == "value" and parts and parts[-1][0] == "out" and parts[-1][1][0] == "value":
                    parts[-1] = ("out", ("value", _text(parts[-1][1][1]) + _text(x[1][1])))
                else:
                    parts.append(x)
        return ("block", parts)
    if kind == "if":
        branches = []
        for test, body in tree[1]:
            test = fold(test, filters)
            if test[0] == "value" and not test[1]:
                continue
            branches.append((test, fold(body, filters)))
            if test[0] == "value":
                break
        if not branches or branches[0][0][0] == "value":
            return branches[0][1] if branches else ("block", [])
        return ("if", branches)
    done = tuple(fold(x, filters) if isinstance(x, tuple) else x for x in tree)
    if kind in ("or", "and", "not", "compare", "add", "join", "field", "filter") and all(
        x[0] == "value" for x in done[1:] if isinstance(x, tuple)
    ):
        return ("value", _evaluator(done, filters)({}))
    return done


def _evaluator(tree: tuple, filters: dict[str, Callable[[str], Any]]) -> Callable[[dict], Any]:
    kind = tree[0]
    if kind == "value":
        return lambda env, value=tree[1]: value
    if kind == "name":
        return lambda env, name=tree[1]: env.get(name)
    if kind == "filter":
        if tree[2][1] not in filters:
            raise TemplateError(f"no filter {tree[2][1]!r}")
        own, one = filters[tree[2][1]], _evaluator(tree[1], filters)
        return lambda env: own(one(env))
    parts = [_evaluator(x, filters) for x in tree[1:] if isinstance(x, tuple)]
    one, two = parts[0], parts[-1]
    if kind == "compare":
        test = _COMPARE[tree[1]]
        return lambda env: test(one(env), two(env))
    if kind == "field":

        def field(env: dict) -> Any:
            holder = one(env)
            return holder.get(two(env)) if isinstance(holder, dict) else None  # fields of mappings only

        return field
    return {
        "or": lambda env: one(env) or two(env),
        "and": lambda env: one(env) and two(env),
        "not": lambda env: not one(env),
        "add": lambda env: one(env) + two(env),
        "join": lambda env: _text(one(env)) + _text(two(env)),
    }[kind]


Part = tuple[str, bool]


def _renderer(tree: tuple, filters: dict[str, Callable[[str], Any]]) -> Callable[[dict, bool], Iterator[Part]]:
    kind = tree[0]
    if kind == "out":
        value = _evaluator(tree[1], filters)

        def out(env: dict, marked: bool) -> Iterator[Part]:
            yield _text(value(env)), marked

        return out
    if kind == "block":
        parts = [_renderer(x, filters) for x in tree[1]]

        def block(env: dict, marked: bool) -> Iterator[Part]:
            for part in parts:
                yield from part(env, marked)

        return block
    if kind == "if":
        branches = [(_evaluator(test, filters), _renderer(body, filters)) for test, body in tree[1]]

        def choose(env: dict, marked: bool) -> Iterator[Part]:
            for test, body in branches:
                if test(env):
                    yield from body(env, marked)
                    return

        return choose
    if kind == "set":
        name, value = tree[1], _evaluator(tree[2], filters)

        def assign(env: dict, marked: bool) -> Iterator[Part]:
            env[name] = value(env)
            yield from ()

        return assign
    if kind == "generation":
        body = _renderer(tree[1], filters)
        return lambda env, marked: body(env, True)
    name, items, body = tree[1], _evaluator(tree[2], filters), _renderer(tree[3], filters)

    def loop(env: dict, marked: bool) -> Iterator[Part]:
        rest = iter(items(env) or ())
        item = next(rest, loop)
        index = 0
        while item is not loop:
            ahead = next(rest, loop)
            index += 1
            env[name] = item
            env["loop"] = {"index": index, "index0": index - 1, "first": index == 1, "last": ahead is loop}
            yield from body(env, marked)
            item = ahead

    return loop


def compile_template(source: str, filters: dict[str, Callable[[str], Any]]) -> Callable[[Iterable[dict]], Iterator[Part]]:
    """A function from messages to ``(text, marked)`` parts in order."""
    run = _renderer(fold(parse(source), filters), filters)
    return lambda messages, **more: run({"messages": messages, **more}, False)
