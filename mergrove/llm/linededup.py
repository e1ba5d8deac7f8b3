"""Line dedup by site-relative frequency.

A line is boilerplate of its host when the share of the host's pages that hold it exceeds a ratio.  Such lines
go from every page of the host.  All of it is built-in expressions: distinct lines of a page are counted by
(host, line hash) with map-side partial sums, and what comes back to the pages is one short list a host
(no more than lines-per-page / ratio entries), never a join on lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Blanks around a line do not count: a line's content is what is left when these go from its ends.
BLANKS = " \t\r\x0b\f"

_UNSEEN = r"(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>"
_BREAKS = r"(?i)</?(?:p|div|li|ul|ol|nav|h[1-6]|br|title|article|table|tr|td|footer|header|body|html|head|section|aside)\b[^>]*>"
_TAGS = r"<[^>]*>"
#: The entities that HTML text must escape, the ampersand last.
_ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def host_of(url: Column) -> Column:
    """The lower-case host of an absolute URL, without user and port; empty where there is none."""
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit(""))


def page_text(html: Column) -> Column:
    """The visible text of a page, one line for each block element."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(html, _UNSEEN, ""), _BREAKS, "\n"), _TAGS, "")
    for name, char in _ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def content(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def lines(text: Column) -> Column:
    """The contents of a text's lines, blank ones left out."""
    return F.filter(F.transform(F.split(text, "\n"), content), lambda x: x != "")


def boilerplate(pages: DataFrame, max_ratio: float) -> DataFrame:
    """``(host, drop)``: for each host of ``pages(host, text)`` that has any, the hashes of its boilerplate lines."""
    total = pages.groupBy("host").agg(F.count("*").alias("total"))
    held = (
        pages.select("host", F.explode(F.array_distinct(F.transform(lines(F.col("text")), lambda x: F.xxhash64(x)))).alias("line"))
        .groupBy("host", "line").agg(F.count("*").alias("n"))
        .where(F.col("n") > 1)
    )
    return (
        held.join(total, "host").where(F.col("n") > F.lit(max_ratio) * F.col("total"))
        .groupBy("host").agg(F.collect_set("line").alias("drop"))
    )


def line_dedup(docs: DataFrame, host_col: str, text_col: str = "text", max_ratio: float = 0.1) -> DataFrame:
    """The rows and columns of ``docs``; from each text the boilerplate lines of its host are gone.

    A line goes if more than ``max_ratio`` of the host's pages hold it, and more than one: what a single page has is not
    shared.  Lines are compared by 64 bits of a hash, within their host.  Blank
    lines and the line ends that are left stay as they are; a text without boilerplate is returned unchanged.
    Rows with a null host form one host; null texts stay null yet count as pages; repeated rows count each;
    other columns, clashing names included, pass through; an empty table gives an empty one.
    """
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    host, text = F.col(f"c{names.index(host_col)}"), F.col(f"c{names.index(text_col)}")
    found = written(boilerplate(plain.select(F.coalesce(host.cast("string"), F.lit("")).alias("host"), text.alias("text")), max_ratio), "boilerplate")
    joined = plain.join(found, F.coalesce(host.cast("string"), F.lit("")) == found.host, "left")
    kept = F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(F.col("drop"), F.xxhash64(content(x))))
    cleaned = F.when(F.col("drop").isNull(), text).otherwise(F.array_join(kept, "\n"))
    return joined.select(*[(cleaned if n == text_col and i == names.index(text_col) else F.col(f"c{i}")).alias(f"o{i}") for i, n in enumerate(names)]).toDF(*names)
