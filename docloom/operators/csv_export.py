"""CSV text, cell by cell as columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.labels import display_label
from ..functions.semantics import text_of
from .documents import flatten


@dataclass(frozen=True)
class CsvColumn:
    """One column: where it comes from and how it is shown."""

    key: str
    label: str | None = None
    transform: Callable[[Column, T.DataType], Column] | None = None
    default: str = ""


def cell(text: Column, delimiter: str = ",", quote: str = '"', prevent_injection: bool = True) -> Column:
    """A cell: line breaks become blanks, formulas get an apostrophe, and what needs quotes is quoted."""
    text = F.regexp_replace(text, r"\r\n|\r|\n", " ")
    if prevent_injection:
        text = F.when(F.substring(text, 1, 1).isin("=", "+", "-", "@", "\t", "\r"), F.concat(F.lit("'"), text)).otherwise(text)
    quoted = F.concat(F.lit(quote), F.replace(text, F.lit(quote), F.lit(quote * 2)), F.lit(quote))
    return F.when(F.contains(text, F.lit(delimiter)) | F.contains(text, F.lit(quote)), quoted).otherwise(text)


def _plain(text: str, delimiter: str, quote: str) -> str:
    text = text.replace("\r\n", " ").replace("\r", " ").replace("\n", " ")
    return quote + text.replace(quote, quote * 2) + quote if delimiter in text or quote in text else text


@dataclass
class Csv:
    """Lines of a table in CSV, and its header line."""

    lines: DataFrame
    header: str | None
    columns: list[str]
    line_break: str = "\n"

    def text(self, order: list[str]) -> str:
        """The whole as one string, for small tables; no rows give no text."""
        rows = [r["line"] for r in self.lines.orderBy(*order).select("line").collect()]
        if not rows:
            return ""
        return self.line_break.join([*([self.header] if self.header is not None else []), *rows])

    def write(self, path: str, **options) -> None:
        """One text file a partition, each with the header first, so that nothing passes through one task."""
        lines = self.lines.select("line")
        if self.header is not None:
            first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0  # the low bits count a partition's rows
            lines = lines.select(F.when(first, F.concat(F.lit(self.header + self.line_break), "line")).otherwise(F.col("line")).alias("line"))
        lines.write.options(lineSep=self.line_break, **options).text(path)


def to_csv(df: DataFrame, columns: list[CsvColumn | str] | None = None, keep: list[str] = (), delimiter: str = ",", quote: str = '"', header: bool = True, humanize_headers: bool = False, prevent_injection: bool = True, flat: bool = True, line_break: str = "\n") -> Csv:
    """CSV of the rows; without ``columns`` all of the flattened table, in order.

    The lines stay a table, ``keep..., line``.
    """
    held = df.select(*[F.col(f"`{k}`").alias(f"__keep_{k}") for k in keep], *[F.col(f"`{c}`") for c in df.columns])
    table = flatten(held).df if flat else held
    names = [c for c in table.columns if not c.startswith("__keep_")]
    chosen = [CsvColumn(c) if isinstance(c, str) else c for c in (columns or names)]
    cells = []
    for c in chosen:
        if c.key in table.columns:
            kind = table.schema[c.key].dataType
            col = F.col(f"`{c.key}`")
            text = c.transform(col, kind).cast("string") if c.transform else text_of(col, kind)
            text = F.coalesce(text, F.lit("" if c.transform else c.default))
        else:
            text = F.lit(c.default)
        cells.append(cell(text, delimiter, quote, prevent_injection))
    lines = table.select(*[F.col(f"`__keep_{k}`").alias(k) for k in keep], F.concat_ws(delimiter, *cells).alias("line"))
    labels = [c.label or (display_label(c.key) if humanize_headers else c.key) for c in chosen]
    return Csv(lines, delimiter.join(_plain(x, delimiter, quote) for x in labels) if header else None, [c.key for c in chosen], line_break)
