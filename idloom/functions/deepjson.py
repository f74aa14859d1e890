"""JSON parsing at any depth.

The standard parser recurses and gives up on deep nesting. What it refuses for that reason alone is parsed here with an
explicit stack, so depth costs memory but loses no record.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa

_BLANK = re.compile(r"[ \t\n\r]*")
_ATOM = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?|true|false|null")
_string = json.JSONDecoder().parse_string


def _refuse(_):
    raise ValueError


def loads_deep(text: str, number=None):
    """The value of a JSON text; ValueError where it is not complete JSON. ``number`` makes numbers of their spelling."""
    make = number or (lambda t: int(t) if t.lstrip("-").isdigit() else float(t))
    root: list = []
    stack: list = [root]  # open containers
    keys: list = [None]  # the key that waits for a value in each of them
    at, n = _BLANK.match(text).end(), len(text)
    need = True  # a value must follow
    while True:
        if need:
            if at >= n:
                raise ValueError("incomplete")
            c = text[at]
            if c in "{[":
                x = {} if c == "{" else []
                _put(stack[-1], keys[-1], x)
                stack.append(x)
                keys.append(None)
                at = _BLANK.match(text, at + 1).end()
                if at < n and text[at] == ("}" if c == "{" else "]"):
                    need = False
                elif c == "{":
                    at, keys[-1] = _key(text, at)
                continue
            if c == '"':
                x, at = _string(text, at + 1, True)
            else:
                m = _ATOM.match(text, at)
                if not m:
                    raise ValueError("no value")
                t, at = m.group(), m.end()
                x = {"true": True, "false": False, "null": None}[t] if t in ("true", "false", "null") else make(t)
            _put(stack[-1], keys[-1], x)
            need = False
        at = _BLANK.match(text, at).end()
        if len(stack) == 1:
            if at != n:
                raise ValueError("trailing text")
            return root[0]
        c = text[at] if at < n else ""
        if c == ("}" if isinstance(stack[-1], dict) else "]"):
            stack.pop()
            keys.pop()
            at += 1
        elif c == ",":
            at = _BLANK.match(text, at + 1).end()
            if isinstance(stack[-1], dict):
                at, keys[-1] = _key(text, at)
            need = True
        else:
            raise ValueError("no separator")


def _put(to, key, x) -> None:
    if isinstance(to, dict):
        to[key] = x
    else:
        to.append(x)


def _key(text: str, at: int) -> tuple[int, str]:
    if at >= len(text) or text[at] != '"':
        raise ValueError("no key")
    k, at = _string(text, at + 1, True)
    at = _BLANK.match(text, at).end()
    if at >= len(text) or text[at] != ":":
        raise ValueError("no colon")
    return _BLANK.match(text, at + 1).end(), k


def loads(text: str, number=None):
    """``json.loads`` without its depth limit and without NaN and Infinity; ValueError where the text is no JSON."""
    try:
        return json.loads(text, parse_constant=_refuse, parse_float=number, parse_int=number) if number else json.loads(text, parse_constant=_refuse)
    except RecursionError:
        return loads_deep(text, number)


def text_array(values: list) -> pa.Array:
    """Text as Arrow; lone surrogates, which no UTF-8 text can hold, become U+FFFD."""
    try:
        return pa.array(values, pa.string())
    except UnicodeEncodeError:
        return pa.array([v if v is None or v.isascii() else v.encode("utf-16", "surrogatepass").decode("utf-16", "replace") for v in values], pa.string())
