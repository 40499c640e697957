"""Site-relative line deduplication: a line on more than a share of a host's pages is boilerplate and goes.

DataFrame functions only.  A page's distinct lines are found within its row; the counts per host and line are reduced
before they are shuffled.  A host can have at most (mean lines of a page) / ratio boilerplate lines, so its list of them
is short whatever the host's size.  If a count proves that all lists together are small they go to the pages; otherwise
pages meet them by a join on the host, which Spark splits where a host is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Lines on more than this share of a host's pages go, unless they are on one page only.
RATIO = 0.2
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
# What has no text, and which tags end a line.
_UNSEEN = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->"
_BREAKS = r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)\b[^>]*>"
_TAGS = r"<[^>]*>"
_EDGE = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"


def host_of(url: Column) -> Column:
    """The host of a URL in lower case; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), _HOST, 1))


def lines_of(text: Column, html: bool) -> Column:
    """The lines of a text, without white space around them and without blank ones; block tags end lines of HTML."""
    text = F.coalesce(text, F.lit(""))
    if html:
        for pattern, by in ((_UNSEEN, ""), (_BREAKS, "\n"), (_TAGS, "")):
            text = F.regexp_replace(text, pattern, by)
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, _EDGE, "")), lambda x: x != "")


def line_dedup(pages: DataFrame, key: str = "page_id", url: str = "url", text: str = "html", html: bool = True, ratio: float = RATIO) -> DataFrame:
    """One row per page: key, host, n_lines, n_dropped, text (the kept lines, joined by newlines).

    Lines are what newlines (and in HTML block tags) separate, without white space around them; blank ones do not count.
    Null texts have no lines, null URLs the host ''.  Every page counts once towards its host's total and once
    for each line it holds, however often; repeated rows and rows with null keys are pages of their own.  A line that only one of a
    host's pages holds stays, whatever its share.  Other columns are ignored, and an empty table gives an empty result.
    """
    rows = pages.select(F.col(key), host_of(F.col(url)).alias("host"), lines_of(F.col(text), html).alias("lines"))
    totals = rows.groupBy("host").agg(F.count("*").alias("pages"))
    counts = rows.select("host", F.explode(F.array_distinct("lines")).alias("line")).groupBy("host", "line").agg(F.count("*").alias("n"))
    frequent = counts.where(F.col("n") > 1).join(totals, "host").where(F.col("n") > F.lit(ratio) * F.col("pages"))
    frequent = common.cut(frequent.select("host", "line"))
    lists = frequent.groupBy("host").agg(F.collect_set("line").alias("drop"))
    size = frequent.agg(F.coalesce(F.sum(F.octet_length("host") + F.octet_length("line") + 32), F.lit(0)).alias("n")).first().n
    if size <= common.BROADCAST_BYTES:
        lists = F.broadcast(lists)
    marked = rows.join(lists, "host", "left").withColumn("drop", F.coalesce("drop", F.array().cast("array<string>")))
    kept = F.filter("lines", lambda x: ~F.array_contains(F.col("drop"), x))
    return marked.select(key, "host", F.size("lines").cast("long").alias("n_lines"), kept.alias("kept")).select(
        key, "host", "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_dropped"), F.array_join("kept", "\n").alias("text")
    )
