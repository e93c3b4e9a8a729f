"""Blocks of web pages by expressions alone: headings and paragraphs with their order, titles, identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DROPPED = r"(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>|<nav.*?</nav>|<footer.*?</footer>|<div class=\"ad\">.*?</div>"


def plain(fragment: Column) -> Column:
    """Text of a fragment: tags become blanks, the common references are decoded, blanks collapse."""
    out = F.regexp_replace(fragment, "<[^>]*>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(out, "\\s+", " "))


def blocks(pages: DataFrame) -> DataFrame:
    """(page_id, pos, kind, text): one row per heading or paragraph start of the article, in page order."""
    body = F.regexp_replace(F.regexp_replace("html", DROPPED, " "), "(?s)<head>.*?</head>", " ")
    parts = F.split(F.regexp_replace(body, "<(h[1-6]|p)(?=[ >])", "\u001e$1|"), "\u001e")
    rows = pages.select("page_id", F.posexplode(parts).alias("pos", "part")).where("pos > 0")
    kind = F.regexp_extract("part", "^(h[1-6]|p)\\|", 1)
    return rows.select("page_id", "pos", kind.alias("kind"), plain(F.regexp_replace("part", "^(h[1-6]|p)\\|[^>]*>", "")).alias("text")).where("text <> ''")


def title(html: Column) -> Column:
    return plain(F.regexp_extract(html, "(?s)<title>(.*?)</title>", 1))


def host(url: Column) -> Column:
    return F.regexp_extract(url, "^[a-z]+://([^/?#]+)", 1)
