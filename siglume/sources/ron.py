"""The text form of scores: a small reader and writer of the object notation with named and positional fields."""

from __future__ import annotations

import re

TOKEN = re.compile(r'\s*(?://[^\n]*\n\s*)*(?:(?P<str>"(?:[^"\\]|\\.)*")|(?P<num>[-+]?[0-9][0-9_]*(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?)|(?P<name>[A-Za-z_][A-Za-z0-9_]*)|(?P<sign>[()\[\]{}:,]))')


class RonError(ValueError):
    pass


def _tokens(text: str):
    at = 0
    text = text.rstrip() + "\n"
    while text[at:].strip():
        m = TOKEN.match(text, at)
        if not m:
            if re.fullmatch(r"(\s|//[^\n]*\n)*", text[at:]):
                return
            raise RonError(f"can't read {text[at : at + 20]!r}")
        yield m.lastgroup, m.group(m.lastgroup)
        at = m.end()


def loads(text: str):
    """Structs become dicts (a name before the bracket under ``"$"``), tuples and lists lists, enums their name."""
    todo = list(_tokens(text))
    at = 0

    def peek(k=0):
        return todo[at + k] if at + k < len(todo) else (None, None)

    def take(want=None):
        nonlocal at
        got = peek()
        if got[0] is None or want and got[1] != want:
            raise RonError(f"{want or 'a value'} is due, not {got[1]!r}")
        at += 1
        return got

    def many(end, item):
        out = []
        while peek()[1] != end or peek()[0] != "sign":
            out.append(item())
            if peek() == ("sign", ","):
                take()
            elif peek() != ("sign", end):
                raise RonError(f"{end} or a comma is due, not {peek()[1]!r}")
        take(end)
        return out

    def pair(stop=":"):
        key = value() if stop == "=" else take()[1]
        take(":")
        return key, value()

    def body():
        if peek()[0] == "name" and peek(1) == ("sign", ":"):
            rows = many(")", pair)
            if len(dict(rows)) < len(rows):
                raise RonError("a field stands twice")
            return dict(rows)
        return many(")", value)

    def value():
        kind, text = take()
        if kind == "str":
            return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), text[1:-1])
        if kind == "num":
            text = text.replace("_", "")
            return float(text) if re.search(r"[.eE]", text) else int(text)
        if kind == "name":
            if text in ("true", "false"):
                return text == "true"
            if text == "None":
                return None
            if peek() != ("sign", "("):
                return text
            take()
            got = body()
            if text == "Some":
                return got[0]
            return {"$": text} | (got if isinstance(got, dict) else {"values": got})
        if text == "(":
            return body()
        if text == "[":
            return many("]", value)
        if text == "{":
            return dict(many("}", lambda: pair("=")))
        raise RonError(f"a value is due, not {text!r}")

    out = value()
    if at < len(todo):
        raise RonError("something follows the value")
    return out


class Name(str):
    """A bare name, such as a variant without fields."""


def dumps(v) -> str:
    if isinstance(v, Name):
        return str(v)
    if isinstance(v, bool):
        return str(v).lower()
    if v is None:
        return "None"
    if isinstance(v, str):
        return '"' + v.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\t", "\\t") + '"'
    if isinstance(v, dict) and set(v) == {"$", "values"}:
        return v["$"] + "(" + ", ".join(map(dumps, v["values"])) + ")"
    if isinstance(v, dict):
        return v.get("$", "") + "(" + ", ".join(f"{k}: {dumps(x)}" for k, x in v.items() if k != "$") + ")"
    if isinstance(v, tuple):
        return "(" + ", ".join(map(dumps, v)) + ")"
    if isinstance(v, list):
        return "[" + ", ".join(map(dumps, v)) + "]"
    return repr(v)
