"""Stored payloads as tables: keyed JSON files, appended logs, word positions, and what a payload looks like."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Signs of a page that asks for a login.
LOGIN_MARKERS = ("登录", "login", "captcha", "验证码", "无权", "购买")
# The first bytes of files of two formats.
PDF, CAJ = "%PDF-", ("CAJViewer", "CAJ\0", "HZKJ")


def keyed_json(spark: SparkSession, path: str, record: str) -> DataFrame:
    """(key, fields of ``record``) of files that hold one JSON object of records each; other files give no rows."""
    d = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string, struct<{record}>>")).alias("key", "r"))
    return d.select("key", "r.*")


def append_lines(rows: DataFrame, path: str) -> None:
    """Appends the rows as lines of JSON."""
    rows.write.mode("append").json(path)


def document_kind(content: Column, content_type: Column | None = None) -> Column:
    """pdf, caj, login or page for HTML, and unknown, by the first bytes of a binary column."""
    head = F.lower(F.decode(F.substring(content, 1, 1024), "ISO-8859-1"))
    start = F.decode(F.substring(content, 1, 16), "ISO-8859-1")
    page = head.contains("<html") | head.contains("<!doctype")
    html = page if content_type is None else page | F.coalesce(content_type, F.lit("")).contains("text/html")
    text = F.lower(F.substring(content, 1, 8192).cast("string"))
    login = F.lit(False)
    for marker in LOGIN_MARKERS:
        login = login | text.contains(marker)
    caj = F.lit(False)
    for sign in CAJ:
        caj = caj | start.startswith(sign)
    return F.when(content.isNull(), "unknown").when(start.startswith(PDF), "pdf").when(caj & ~page, "caj").when(html & login, "login").when(html, "page").otherwise("unknown")


def text_of_positions(positions: Column) -> Column:
    """Text of a map from word to its places: by place, then word."""
    placed = F.flatten(F.transform(F.map_entries(positions), lambda e: F.transform(e["value"], lambda i: F.struct(i.alias("i"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(placed), lambda x: x["w"]), " ")
