"""Strict TOML into dataclasses: unknown fields, widths and kinds are refused with their key path."""

from __future__ import annotations

import dataclasses
import datetime as dt
import tomllib
import types
import typing


class ConfigError(ValueError):
    """A document that does not fit; ``problems`` lists every one as ``path: what``."""

    def __init__(self, problems: list[str]):
        super().__init__("; ".join(problems))
        self.problems = problems


def parse(data: bytes | str) -> dict:
    if isinstance(data, bytes):
        try:
            data = data.decode("utf-8-sig")
        except UnicodeDecodeError as e:
            raise ConfigError([f"byte {e.start}: not UTF-8"]) from e
    try:
        tree = tomllib.loads(data.removeprefix("﻿"))
    except tomllib.TOMLDecodeError as e:
        raise ConfigError([str(e)]) from e
    wide: list[str] = []
    _check_numbers(tree, "", wide)
    if wide:
        raise ConfigError(wide)
    return tree


def _check_numbers(v, path: str, out: list[str]) -> None:
    if isinstance(v, dict):
        for k, x in v.items():
            _check_numbers(x, f"{path}.{k}" if path else k, out)
    elif isinstance(v, list):
        for i, x in enumerate(v):
            _check_numbers(x, f"{path}[{i}]", out)
    elif isinstance(v, int) and not isinstance(v, bool) and not -(2**63) <= v < 2**63:
        out.append(f"{path}: {v} is beyond 64 bits")


def bind(tree: dict, kind, unknown: bool = False):
    """``tree`` as an instance of the dataclass ``kind``; ``unknown`` fields are refused unless allowed."""
    out: list[str] = []
    got = _bind(tree, kind, "", unknown, out)
    if out:
        raise ConfigError(out)
    return got


def _bind(v, kind, path: str, unknown: bool, out: list[str]):
    origin = typing.get_origin(kind)
    if origin in (typing.Union, types.UnionType):
        kind = next(a for a in typing.get_args(kind) if a is not type(None))
        origin = typing.get_origin(kind)
    if kind in (typing.Any, object):
        return v
    if dataclasses.is_dataclass(kind):
        if not isinstance(v, dict):
            out.append(f"{path}: a table is wanted")
            return None
        hints, values = typing.get_type_hints(kind), {}
        names = {f.metadata.get("key", f.name): f for f in dataclasses.fields(kind)}
        for k, x in v.items():
            where = f"{path}.{k}" if path else k
            if k in names:
                values[names[k].name] = _bind(x, hints[names[k].name], where, unknown, out)
            elif not unknown:
                out.append(f"{where}: unknown field")
        for k, f in names.items():
            if k not in v and f.default is dataclasses.MISSING and f.default_factory is dataclasses.MISSING:
                out.append(f"{path}.{k}".lstrip(".") + ": missing")
        return None if out else kind(**values)
    if origin is list:
        if not isinstance(v, list):
            out.append(f"{path}: an array is wanted")
            return None
        return [_bind(x, typing.get_args(kind)[0], f"{path}[{i}]", unknown, out) for i, x in enumerate(v)]
    if origin is dict:
        return {k: _bind(x, typing.get_args(kind)[1], f"{path}.{k}", unknown, out) for k, x in v.items()} if isinstance(v, dict) else out.append(f"{path}: a table is wanted")
    if kind is float and isinstance(v, int) and not isinstance(v, bool):
        if abs(v) > 2**53:
            out.append(f"{path}: {v} is not exact as a float")
        return float(v)
    if kind is dt.datetime and isinstance(v, dt.datetime):
        return v if v.tzinfo else v.replace(tzinfo=dt.UTC)
    if kind is dt.datetime and type(v) is dt.date:
        return dt.datetime(v.year, v.month, v.day, tzinfo=dt.UTC)
    if type(v) is not kind:
        out.append(f"{path}: {kind.__name__} is wanted, not {type(v).__name__}")
        return None
    return v
