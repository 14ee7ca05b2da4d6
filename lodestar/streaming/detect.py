"""Any step kernel as a keyed stateful operator on a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def detect(stream: DataFrame, by: list[str], order: list[str], kernel, value: str, at: str | None = None) -> DataFrame:
    """``stream`` with the kernel's outputs, in append mode; state is one flat row a key.

    Rows of a micro-batch are put in ``order`` (an arrival number) before they are
    stepped; the kernel's own rule decides on late ones, so there is no watermark. A
    batch of a key comes in pieces when it is large, each sorted only once all are
    there: order within a micro-batch costs its memory for that key.
    """
    extra = T._parse_datatype_string(kernel.out)
    names = [f.name for f in extra.fields]
    plain = stream.drop(*names)
    schema = T.StructType([*plain.schema.fields, *extra.fields])

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(parts)).sort_values(order, kind="stable")
        now = state.get if state.exists else kernel.start()
        out = []
        for x, t in zip(pdf[value], pdf[at] if at else [None] * len(pdf), strict=True):
            now, got = kernel.step(tuple(now), None if pd.isna(x) else x, t)
            out.append(got if got is not None else (None,) * len(names))
        state.update(tuple(now))
        for i, n in enumerate(names):
            pdf[n] = pd.Series([o[i] for o in out], index=pdf.index, dtype=object)
        yield pdf

    return plain.groupBy(*by).applyInPandasWithState(run, schema, T._parse_datatype_string(kernel.fields), "append", GroupStateTimeout.NoTimeout)
