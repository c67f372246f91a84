"""Report files from small aggregates."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame

#: Rows a report has at most unless the caller says otherwise; larger tables are written by Spark.
MOST_ROWS = 10000


def _rows(df: DataFrame, most: int) -> list[dict]:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report has at most {most} rows")
    return [r.asDict(recursive=True) for r in rows]


def write_json(tables: dict[str, DataFrame], path: str, most: int = MOST_ROWS) -> None:
    Path(path).write_text(json.dumps({k: _rows(v, most) for k, v in tables.items()}, indent=2, default=str, ensure_ascii=False))


def write_markdown(tables: dict[str, DataFrame], path: str, most: int = MOST_ROWS) -> None:
    out = []
    for title, df in tables.items():
        out += [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        out += ["| " + " | ".join(str(r[c]) for c in df.columns) + " |" for r in _rows(df, most)] + [""]
    Path(path).write_text("\n".join(out))
