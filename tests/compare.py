"""Rows of a Spark result and of a DuckDB result in one comparable form."""

import pandas as pd


def _plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return None
    if hasattr(v, "tolist") and not isinstance(v, (str, bytes)):
        v = v.tolist()
    if isinstance(v, float) and v == int(v):
        return int(v)
    return str(v) if isinstance(v, (pd.Timestamp, list)) else v


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted((tuple(_plain(v) for v in r) for r in frame[columns].itertuples(index=False)), key=repr)
