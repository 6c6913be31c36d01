"""Snippets, highlighting and display forms."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

MARK = ('<mark class="highlight">', "</mark>")


def escape_html(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def _escaped(term: str) -> str:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        term = term.replace(raw, safe)
    return term


def highlight(text: Column, terms: list[str]) -> Column:
    """Escaped text with the terms marked, ignoring case, in the casing of the query.

    One pass per alternative at each place, longest first, so that no mark is searched
    for terms: the pass puts guard characters, which become marks at the end.
    """
    out = escape_html(F.coalesce(text, F.lit("")))
    own = sorted({t for t in terms if t}, key=lambda t: (-len(t), t))
    if not own:
        return out
    any_ = "|".join(re.escape(_escaped(t)) for t in own)
    out = F.regexp_replace(out, f"(?i)({any_})", "\u0001$1\u0002")
    for t in own:
        safe = _escaped(t)
        out = F.regexp_replace(out, f"(?i)\u0001{re.escape(safe)}\u0002", MARK[0].replace("$", r"\$") + re.sub(r"([\\$])", r"\\\1", safe) + MARK[1])
    return out


def snippet(text: Column, terms: list[str], most: int = 150, mark: bool = True) -> Column:
    """Half of most characters on either side of where the first term (in query order) that occurs begins, with ellipses; the head if none does. Marked unless told not to."""
    text = F.coalesce(text, F.lit(""))
    low = F.lower(text)
    at = F.coalesce(*(F.nullif(F.locate(t.lower(), low), F.lit(0)) for t in terms if t), F.lit(0)) - 1
    n, half = F.length(text), most // 2
    start, end = F.greatest(at - half, F.lit(0)), F.least(at + half, n)
    around = F.concat(F.when(start > 0, "...").otherwise(""), F.substring(text, start + 1, end - start), F.when(end < n, "...").otherwise(""))
    out = F.when(at < 0, F.substring(text, F.lit(1), F.lit(most))).otherwise(around)
    return highlight(out, terms) if mark else out


def money(c: Column) -> Column:
    """12000 as 12k (half to even), small amounts as they are."""
    return F.when(c >= 1000, F.concat(F.bround(c / 1000, 0).cast("bigint").cast("string"), F.lit("k"))).otherwise(c.cast("bigint").cast("string"))


def salary_text(low: Column, high: Column, open_: str = "面议") -> Column:
    ok = (low > 0) & (high > 0)
    return F.when(ok, F.concat(F.floor(low / 1000).cast("string"), F.lit("k-"), F.floor(high / 1000).cast("string"), F.lit("k"))).otherwise(open_)


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.format_string("%.2f%%", 100.0 * part / whole)).otherwise("0.00%")


def grouped(c: Column) -> Column:
    return F.format_number(c, 0)


# The headings of job descriptions, and the numbers and marks of items.
HEADERS = (
    "岗位职责", "任职资格", "任职要求", "职位描述", "岗位要求",
    "工作职责", "工作内容", "职位要求", "资格要求", "招聘要求",
    "岗位介绍", "福利待遇", "薪资福利", "公司介绍", "公司简介",
    "职位信息", "岗位信息", "工作职责描述", "主要职责",
)
ITEM_NUMBERS, ITEM_MARKS = "0-9一二三四五六七八九十", ".、)）"


def description_lines(text: Column, headers: tuple[str, ...] = HEADERS) -> Column:
    """Array of (kind, line): headings, numbered items and paragraphs of a description. Numbers and headings after a sentence or a space begin lines."""
    head = "|".join(headers)
    after = r"(?<=[。！？\s])"
    begins = rf"{after}(?=[0-9]+[{ITEM_MARKS}])|{after}(?=(?:{head})[：:])"
    lines = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), begins, "\n"), r"\r\n?|\n")
    lines = F.filter(F.transform(lines, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")

    def kind(x: Column) -> Column:
        return F.when(x.rlike(f"^(?:{head})"), "head").when(x.rlike(f"^[{ITEM_NUMBERS}]+[{ITEM_MARKS}]"), "item").otherwise("para")

    return F.transform(lines, lambda x: F.struct(kind(x).alias("kind"), x.alias("line")))
