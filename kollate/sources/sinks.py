"""Writing of tables and small reports."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, functions as F

#: Rows a report may have; larger results are tables, not reports.
REPORT_ROWS = 1000


def write_table(df: DataFrame, path: str, compression: str = "zstd", by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite").option("compression", compression)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """A small result as one CSV file with a header in the folder ``path``; one of more than REPORT_ROWS rows is written as it lies, in
    as many files as it has partitions."""
    small = len(df.select(F.lit(1)).limit(REPORT_ROWS + 1).collect()) <= REPORT_ROWS
    (df.coalesce(1) if small else df).write.mode("overwrite").csv(path, header=True)


def markdown(df: DataFrame, title: str = "", note: str = "") -> str:
    """A small result as a Markdown table; one of more than REPORT_ROWS rows raises."""
    rows = df.limit(REPORT_ROWS + 1).collect()
    if len(rows) > REPORT_ROWS:
        raise ValueError(f"a report has {REPORT_ROWS} rows at most")
    show = lambda v: "" if v is None else str(v).replace("|", "\\|")
    lines = [f"## {title}", ""] if title else []
    lines += ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    lines += ["| " + " | ".join(map(show, r)) + " |" for r in rows]
    return "\n".join(lines + (["", note] if note else [])) + "\n"


def write_report(df: DataFrame, stem: str, title: str = "", note: str = "") -> None:
    """The same as <stem>.md and <stem>.csv on the driver's disk."""
    Path(f"{stem}.md").write_text(markdown(df, title, note))
    df.limit(REPORT_ROWS).toPandas().to_csv(f"{stem}.csv", index=False)
