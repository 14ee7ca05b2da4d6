"""A token-frugal text notation of JSON-like values: indented keys, and lists of like records as tables."""

from __future__ import annotations

import json
import math
import re


class ToonError(ValueError):
    """Text that is not of the notation; the message says in which line."""


_KEY = re.compile(r"[A-Za-z_][A-Za-z0-9_.-]*")
_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?")
_HEAD = re.compile(r'^(?P<key>"(?:[^"\\]|\\.)*"|[^\[\]{}:"]*)(?:\[(?P<n>\d+)(?P<d>[,\t|]?)\](?:\{(?P<f>.*)\})?)?:(?: (?P<rest>.*))?$')


def _scalar(v) -> bool:
    return v is None or isinstance(v, (bool, int, float, str))


def _number(x: float) -> str:
    if not math.isfinite(x):
        return f'"{x}"'
    if x == 0:
        return "0"
    if x == int(x) and abs(x) < 1e21:
        return str(int(x))
    s = repr(x)
    if "e" in s and 1e-6 <= abs(x) < 1e21:
        s = format(x, "f").rstrip("0")
    return s


def _text(s: str, delimiter: str) -> str:
    plain = s and s == s.strip() and s not in ("true", "false", "null") and not _NUMBER.fullmatch(s)
    if plain and not re.search(r'[:"\\\[\]{}\n\r\t]', s) and delimiter not in s and not s.startswith(("-", "#")):
        return s
    return json.dumps(s, ensure_ascii=False)


def _put(v, delimiter: str) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, int):
        return str(v)
    return _number(v) if isinstance(v, float) else _text(v, delimiter)


def _name(k: str) -> str:
    return k if _KEY.fullmatch(k) else json.dumps(k, ensure_ascii=False)


def encode(value, delimiter: str = ",") -> str:
    """Keys sorted, two spaces a level; a top-level list goes under ``items``."""
    if isinstance(value, list):
        value = {"items": value}
    if not isinstance(value, dict):
        return _put(value, delimiter)
    out: list[str] = []
    _object(value, 0, delimiter, out)
    return "\n".join(out)


def _object(v: dict, depth: int, d: str, out: list[str], lead: str | None = None) -> None:
    pad = "  " * depth
    for i, k in enumerate(sorted(v)):
        start = lead if lead is not None and i == 0 else pad
        _field(start, _name(k), v[k], depth, d, out)


def _field(start: str, key: str, x, depth: int, d: str, out: list[str]) -> None:
    if _scalar(x):
        out.append(f"{start}{key}: {_put(x, d)}")
    elif isinstance(x, dict):
        out.append(f"{start}{key}:")
        _object(x, depth + 1, d, out)
    else:
        _list(start, key, x, depth, d, out)


def _list(start: str, key: str, x: list, depth: int, d: str, out: list[str]) -> None:
    mark = f"[{len(x)}{'' if d == ',' else d}]"
    pad = "  " * (depth + 1)
    if all(_scalar(i) for i in x):
        out.append(f"{start}{key}{mark}:" + (" " + d.join(_put(i, d) for i in x) if x else ""))
    elif all(isinstance(i, dict) and i and i.keys() == x[0].keys() and all(_scalar(c) for c in i.values()) for i in x):
        names = sorted(x[0])
        out.append(f"{start}{key}{mark}{{{d.join(_name(n) for n in names)}}}:")
        out.extend(pad + d.join(_put(i[n], d) for n in names) for i in x)
    else:
        out.append(f"{start}{key}{mark}:")
        for i in x:
            if _scalar(i):
                out.append(f"{pad}- {_put(i, d)}")
            elif isinstance(i, dict) and i:
                _object(i, depth + 2, d, out, f"{pad}- ")
            elif isinstance(i, dict):
                out.append(f"{pad}-")
            else:
                _list(f"{pad}- ", "", i, depth + 1, d, out)


class _Lines:
    def __init__(self, text: str):
        rows = text.replace("\r\n", "\n").split("\n")
        while rows and not rows[0].strip():
            rows.pop(0)
        while rows and not rows[-1].strip():
            rows.pop()
        if rows and rows[0].strip().startswith("```"):
            rows = rows[1:-1] if rows[-1].strip() == "```" else rows[1:]
        self.rows: list[tuple[int, int, str]] = []
        unit = 0
        for n, r in enumerate(rows, 1):
            if not r.strip():
                continue
            space = len(r) - len(r.lstrip(" "))
            if r[space] == "\t":
                raise ToonError(f"line {n}: a tab indents")
            unit = unit or space
            if space and space % unit:
                raise ToonError(f"line {n}: {space} spaces are no multiple of {unit}")
            self.rows.append((n, space // unit if unit else 0, r[space:].rstrip()))
        self.at = 0

    def peek(self):
        return self.rows[self.at] if self.at < len(self.rows) else None


def decode(text: str, strict: bool = False):
    """The value of a text; ``strict`` holds lists to their declared lengths."""
    lines = _Lines(text)
    if not lines.rows:
        return {}
    _, _, first = lines.rows[0]
    if len(lines.rows) == 1 and not _HEAD.match(first):
        return _value(first, 1)
    m = _HEAD.match(first)
    if m and not m["key"] and m["n"] is not None:
        lines.at = 1
        return _items(m, 0, lines, strict, 1)
    out = _fields(lines, 0, strict)
    if lines.peek():
        raise ToonError(f"line {lines.peek()[0]}: indented without a key above")
    return out


def _value(s: str, n: int):
    s = s.strip()
    if s.startswith('"'):
        try:
            return json.loads(s)
        except ValueError:
            raise ToonError(f"line {n}: a quote does not end") from None
    if s in ("true", "false", "null"):
        return {"true": True, "false": False, "null": None}[s]
    if _NUMBER.fullmatch(s):
        return float(s) if any(c in s for c in ".eE") else int(s)
    return s


def _cells(s: str, d: str, n: int) -> list:
    out, at, quoted, start = [], 0, False, 0
    while at < len(s):
        c = s[at]
        if quoted and c == "\\":
            at += 1
        elif c == '"':
            quoted = not quoted
        elif c == d and not quoted:
            out.append(_value(s[start:at], n))
            start = at + 1
        at += 1
    return [*out, _value(s[start:], n)]


def _key(s: str) -> str:
    return json.loads(s) if s.startswith('"') else s.strip()


def _fields(lines: _Lines, depth: int, strict: bool, first: tuple[int, str] | None = None) -> dict:
    out: dict = {}
    while True:
        if first:
            n, s = first
            first = None
        else:
            row = lines.peek()
            if not row or row[1] < depth:
                return out
            if row[1] > depth:
                raise ToonError(f"line {row[0]}: too far in")
            n, _, s = row
            lines.at += 1
        m = _HEAD.match(s)
        if not m or (not m["key"] and m["n"] is None):
            raise ToonError(f"line {n}: no key")
        key = _key(m["key"])
        if key in out:
            raise ToonError(f"line {n}: {key!r} twice")
        if m["n"] is not None:
            out[key] = _items(m, depth, lines, strict, n)
        elif m["rest"] is not None:
            out[key] = _value(m["rest"], n)
        else:
            out[key] = _fields(lines, depth + 1, strict)


def _items(m: re.Match, depth: int, lines: _Lines, strict: bool, n: int) -> list:
    d, count, out = m["d"] or ",", int(m["n"]), []
    if m["rest"] is not None:
        out = _cells(m["rest"], d, n)
    elif m["f"] is not None:
        names = [_key(str(x)) if isinstance(x, str) else str(x) for x in _cells(m["f"], d, n)]
        while (row := lines.peek()) and row[1] == depth + 1:
            lines.at += 1
            cells = _cells(row[2], d, row[0])
            if len(cells) != len(names):
                raise ToonError(f"line {row[0]}: {len(cells)} cells of {len(names)}")
            out.append(dict(zip(names, cells, strict=True)))
    else:
        while (row := lines.peek()) and row[1] == depth + 1 and (row[2] == "-" or row[2].startswith("- ")):
            lines.at += 1
            s = row[2][2:]
            h = _HEAD.match(s) if s else None
            if not s:
                out.append({})
            elif h and not h["key"] and h["n"] is not None:
                out.append(_items(h, depth + 1, lines, strict, row[0]))
            elif h and h["key"] and not s.startswith('"') or (h and h["key"]):
                out.append(_fields(lines, depth + 2, strict, (row[0], s)))
            else:
                out.append(_value(s, row[0]))
    if strict and len(out) != count:
        raise ToonError(f"line {n}: {len(out)} items, {count} declared")
    return out
