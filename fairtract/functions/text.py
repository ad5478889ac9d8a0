"""Column expressions over page and message text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text limit and marker of a cut page.
PAGE_LIMIT = 12_000
CUT_MARK = "\n\n[Content truncated.]"

# White space as browsers define it: Unicode white space without U+0085, plus U+FEFF.
# One negated class is several times faster than a list of characters.
_UNICODE_SPACE = r"[\s&&[^\x85]]"
_SPACE = rf"(?:{_UNICODE_SPACE}|\x{{FEFF}})"


def trim_all(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)\A{_SPACE}+|{_SPACE}+\z", "")


def strip_html(html: Column) -> Column:
    """Visible text of a page: scripts, styles and tags out, white space collapsed."""
    text = html
    for block in ("script", "style"):
        text = F.regexp_replace(text, rf"(?is)<{block}(?![A-Za-z0-9_]).*?</{block}>", " ")
    text = F.replace(F.regexp_replace(text, "<[^>]+>", " "), F.lit("\ufeff"), F.lit(" "))
    return F.btrim(F.regexp_replace(text, f"(?U){_UNICODE_SPACE}+", " "), F.lit(" "))


def truncate_text(c: Column, limit: int = PAGE_LIMIT, mark: str = CUT_MARK) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit(mark))).otherwise(c)


def unwrap_fence(c: Column) -> Column:
    """Content of the first fenced block that starts a line, else the trimmed text."""
    # Fixed value: what counts as a fenced block.
    fence = rf"(?mU)^```(?:markdown|md)?{_SPACE}*\n?((?s:.*?))\n?```{_SPACE}*$"
    text = trim_all(c)
    return F.when(text.rlike(fence), trim_all(F.regexp_extract(text, fence, 1))).otherwise(text)
