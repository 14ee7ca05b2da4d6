"""JSON inside free text: find, judge and decode, never repair."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PAIRS = {"{": "}", "[": "]"}


def scan(text: str) -> tuple[list[tuple[str, int, int]], bool]:
    """Balanced top-level values as (text, first byte, end byte), and whether one is cut off or mismatched.

    Quotes count inside a value only; a value whose brackets do not match ends the scan of
    that value and the search goes on after its opening bracket.
    """
    found, broken, at = [], False, 0
    while at < len(text):
        if text[at] not in _PAIRS:
            at += 1
            continue
        stack, k, quoted = [], at, False
        while k < len(text):
            c = text[k]
            if quoted:
                if c == "\\":
                    k += 1
                elif c == '"':
                    quoted = False
            elif c == '"':
                quoted = True
            elif c in _PAIRS:
                stack.append(_PAIRS[c])
            elif c in "}]":
                if c != stack.pop():
                    stack = None
                    break
                if not stack:
                    break
            k += 1
        if stack == [] and k < len(text):
            a = len(text[:at].encode())
            value = text[at : k + 1]
            found.append((value, a, a + len(value.encode())))
            at = k + 1
        else:
            broken = True
            at += 1
    return found, broken


def _loads(text: str):
    def refuse(x):
        raise ValueError(x)

    return json.loads(text, parse_constant=refuse)


def _matches(value, schema: dict, strict: bool) -> bool:
    """``schema`` maps field names to Python types; a float field takes an integer."""
    if not isinstance(value, dict) or (strict and set(value) - set(schema)):
        return False
    for name, kind in schema.items():
        if name in value and value[name] is not None:
            v = value[name]
            if isinstance(v, bool) != (kind is bool) or not isinstance(v, (int, float) if kind is float else kind):
                return False
    return any(name in value for name in schema) or not strict


def decode(text: str | None, schema: dict, strict: bool = False) -> str | None:
    """The whole text if it decodes, else the first candidate that does, as JSON; None if none."""
    text = text or ""
    for part in [text.strip(), *(v for v, _, _ in scan(text)[0])]:
        try:
            value = _loads(part)
        except ValueError:
            continue
        if _matches(value, schema, strict):
            return json.dumps(value)
    return None


def decode_one(text: str | None, schema: dict) -> tuple[str, str | None]:
    """(status, JSON): ``ok``, ``truncated``, ``ambiguous`` or ``no_json``; a list of one counts as its item."""
    text = text or ""
    found, broken = scan(text)
    good = []
    for part, _, _ in found:
        try:
            value = _loads(part)
        except ValueError:
            continue
        if isinstance(value, list) and len(value) == 1:
            value = value[0]
        if _matches(value, schema, True):
            good.append(json.dumps(value))
    if broken:
        return "truncated", None
    if len(good) > 1:
        return "ambiguous", None
    return ("ok", good[0]) if good else ("no_json", None)


def candidates(df: DataFrame, text: str) -> DataFrame:
    """One row for each balanced value in each text: its row's columns, json, start, end, valid."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            got = pdf[text].map(lambda t: scan(t or "")[0])
            rows = pdf.loc[pdf.index.repeat(got.map(len))].reset_index(drop=True)
            flat = [v for vs in got for v in vs]
            rows["json"], rows["start"], rows["end"] = [v[0] for v in flat], [v[1] for v in flat], [v[2] for v in flat]
            yield rows

    found = df.mapInPandas(run, f"{kinds}, json string, start long, end long")
    return found.withColumn("valid", F.try_parse_json("json").isNotNull())


def decoded(text: Column, schema: dict, strict: bool = False) -> Column:
    """JSON text of the first value that fits ``schema``; use ``from_json`` on it."""

    @F.pandas_udf("string")
    def run(t: pd.Series) -> pd.Series:
        return t.map(lambda x: decode(x, schema, strict))

    return run(text)


def judged(text: Column, schema: dict) -> Column:
    """Struct of status and json."""

    @F.pandas_udf("status string, json string")
    def run(t: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(t.map(lambda x: decode_one(x, schema)).tolist(), columns=["status", "json"])

    return run(text)
