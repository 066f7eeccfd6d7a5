"""Small results as Markdown and LaTeX, at the driver's edge."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: A report is a table to be read; more rows than this are refused.
MOST_ROWS = 1000


def _cells(rows: DataFrame) -> tuple[list[str], list[list[str]]]:
    got = rows.limit(MOST_ROWS + 1).collect()
    if len(got) > MOST_ROWS:
        raise ValueError(f"a report has at most {MOST_ROWS} rows")
    return rows.columns, [["" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v) for v in r] for r in got]


def markdown(rows: DataFrame) -> str:
    head, body = _cells(rows)
    return "\n".join(f"| {' | '.join(x)} |" for x in [head, ["---"] * len(head), *body])


def latex(rows: DataFrame) -> str:
    head, body = _cells(rows)
    lines = " \\\\\n".join(" & ".join(x.replace("&", r"\&").replace("_", r"\_") for x in line) for line in [head, *body])
    return f"\\begin{{tabular}}{{{'l' * len(head)}}}\n{lines} \\\\\n\\end{{tabular}}"
