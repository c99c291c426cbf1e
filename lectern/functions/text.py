"""Text expressions: tokens, keywords, normalised text, ids, links, citations. Built-in column expressions but for ``unescaped``."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# What a token is made of, and the range of the ideographs that are cut into pairs.
LATIN = "[a-z0-9][a-z0-9._/+\\-]*"
IDEOGRAPHS = "[\\x{4e00}-\\x{9fff}]+"
# What a token of a memory is made of, words that don't count there, and what its edges lose.
MEMORY_LATIN = "[a-z0-9][a-z0-9._/-]+"
MEMORY_STOP_WORDS = "的 了 和 是 我 你 在 要 有 就 都 也 及 与 或 把 给 请 这 那 一个 当前 进行 可以".split()
MEMORY_EDGES = "。；;，, "
# The pattern of a cited id, of a bare id, of a link, of a year, of arXiv ids.
CITATION = "\\[(paper:[^\\]]+)\\]"
PAPER_ID = "paper:[A-Za-z0-9_:\\-.]+"
LINK = "https?://[^\\s<>\\]\\[\"']+"
YEAR = "(?:19|20)\\d{2}"
ARXIV_ID = "^\\d{4}\\.\\d{4,5}(v\\d+)?$"
# Signs of text that was decoded wrongly.
MOJIBAKE = "[ÃÂäåæç]"


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def pairs(run: Column) -> Column:
    """Overlapping pairs of characters; a single character is itself."""
    n = F.char_length(run)
    return F.when(n == 1, F.array(run)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(run, i, F.lit(2))))


def tokens(text: Column) -> Column:
    """Latin tokens in lower case in order, then pairs of each ideograph run; none for null."""
    t = F.lower(text_or_empty(text))
    return F.concat(F.regexp_extract_all(t, F.lit(LATIN), 0), F.flatten(F.transform(F.regexp_extract_all(t, F.lit(IDEOGRAPHS), 0), pairs)))


def keywords(text: Column, n: int = 20) -> Column:
    """The first n distinct tokens in the order they are first seen."""
    return F.slice(F.array_distinct(tokens(text)), 1, n)


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text_or_empty(text), "\\s+", " "))


def plain_html(html: Column) -> Column:
    """Text of a page: tags are blanks, runs of blanks are one."""
    return collapsed(F.regexp_replace(text_or_empty(html), "<[^>]+>", " "))


def token_estimate(text: Column, per: int = 4) -> Column:
    return F.greatest(F.lit(1), F.floor(F.char_length(text_or_empty(text)) / per)).cast("long")


def cited(text: Column) -> Column:
    """Ids cited as [paper:…], in order."""
    return F.regexp_extract_all(text_or_empty(text), F.lit(CITATION), 1)


def once(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of two token arrays; 0 where both are empty."""
    def share(x: Column) -> Column:
        n = F.size(x["a"]) + F.size(x["b"]) - F.size(F.array_intersect(x["a"], x["b"]))
        return F.when(n == 0, 0.0).otherwise((F.size(x["a"]) + F.size(x["b"]) - n) / n)

    return once(F.struct(F.array_distinct(a).alias("a"), F.array_distinct(b).alias("b")), share)


def decay(then: Column, now: Column, half_life_days: float) -> Column:
    """0.5 ** (age / half life); 1 for the future, 0 for no date."""
    age = F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(then)) / F.lit(8.64e10))
    return F.when(then.isNull(), 0.0).otherwise(F.exp(-F.lit(0.6931471805599453) * age / F.lit(float(max(half_life_days, 1.0)))))


def memory_tokens(text: Column) -> Column:
    """The distinct tokens that memories are compared by: no single characters, no stop words."""
    t = text_or_empty(text)
    runs = F.flatten(F.transform(F.regexp_extract_all(t, F.lit("[\\x{4e00}-\\x{9fff}]{2,}"), 0), pairs))
    return F.array_except(F.concat(F.regexp_extract_all(F.lower(t), F.lit(MEMORY_LATIN), 0), runs), F.array(*[F.lit(w) for w in MEMORY_STOP_WORDS]))


def normalised_memory(text: Column) -> Column:
    """What makes two memories the same: lower case, single blanks, no separators at the edges."""
    return F.btrim(collapsed(F.lower(F.trim(text_or_empty(text)))), F.lit(MEMORY_EDGES))


def paper_id(source: Column, value: Column) -> Column:
    return F.concat_ws(":", F.lit("paper"), source, F.translate(F.trim(value), "/: ", "___"))


def safe_filename(name: Column, default: str = "paper.pdf") -> Column:
    """Letters, digits and ._- of any script; each other character is one underscore."""
    safe = F.regexp_replace(F.trim(text_or_empty(name)), "[^\\p{L}\\p{N}._-]", "_")
    return F.when(safe == "", default).otherwise(safe)


def safe_name(name: Column, default: str = "institution_document", keep: str = "A-Za-z0-9._-", longest: int = 120) -> Column:
    """Runs of characters outside ``keep`` are one underscore; dots and underscores at the edges go."""
    safe = F.left(F.btrim(F.regexp_replace(text_or_empty(name), f"[^{keep}]+", "_"), F.lit("._")), F.lit(longest))
    return F.when(safe == "", default).otherwise(safe)


@F.pandas_udf(StringType())
def unescaped(text: pd.Series) -> pd.Series:
    """HTML entities as characters; Spark has no function that knows them all."""
    return text.map(html.unescape, na_action="ignore")


def html_text(page: Column) -> Column:
    """Text of marked-up text with entities resolved first, then tags taken out."""
    return plain_html(unescaped(page))


def arxiv_id(value: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(F.trim(value), "^arXiv:", ""), "/"), -1)


def is_arxiv_id(value: Column) -> Column:
    return F.coalesce(arxiv_id(value).rlike(ARXIV_ID), F.lit(False))


def first_match(text: Column, pattern: str, group: int = 0) -> Column:
    """The first match, or an empty string."""
    return F.regexp_extract(text_or_empty(text), pattern, group)


def first_paper_id(text: Column) -> Column:
    return first_match(text, PAPER_ID)


def first_link(text: Column) -> Column:
    return F.rtrim(first_match(text, LINK), F.lit("。；，,)）"))


def first_year(text: Column) -> Column:
    return first_match(text, YEAR)


def repaired(text: Column) -> Column:
    """Text whose UTF-8 bytes were read as Latin-1, put right where all of it can be."""
    t = collapsed(text)
    again = F.try_validate_utf8(F.encode(t, "ISO-8859-1").cast("string"))
    narrow = ~t.rlike("[^\\x{00}-\\x{ff}]")
    return F.when(t.rlike(MOJIBAKE) & narrow, F.coalesce(F.nullif(F.when(narrow, again), F.lit("")), t)).otherwise(t)


def sentences(text: Column) -> Column:
    """Parts between sentence ends, without these."""
    return F.filter(F.transform(F.split(text_or_empty(text), "[。！？.!?]"), lambda x: F.trim(x)), lambda x: x != "")


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text_or_empty(text), "\n\n"), lambda x: F.trim(x)), lambda x: x != "")


def fitted(text: Column, token_budget: Column | int, mark: str = "\n\n[中间上下文已按预算压缩]\n\n") -> Column:
    """Texts over about three characters a token keep a third of the room at the head and the rest at the tail."""
    budget = token_budget if isinstance(token_budget, Column) else F.lit(token_budget)
    chars = F.greatest(F.lit(300), budget * 3).cast("int")
    head = F.greatest(F.lit(120), F.floor(chars / 3)).cast("int")
    tail = F.greatest(F.lit(120), chars - head - 42).cast("int")
    return F.when(F.char_length(text) <= chars, text).otherwise(F.concat(F.left(text, head), F.lit(mark), F.right(text, tail)))


def citation(style: Column, authors: Column, title: Column, source: Column, published: Column) -> Column:
    """A reference in APA, GB/T 7714 or else IEEE form, with the first author."""
    first = F.coalesce(F.get(authors, F.lit(0)), F.lit("Unknown Author"))
    title, source = F.coalesce(title, F.lit("Untitled")), F.coalesce(source, F.lit("local"))
    year = F.left(F.coalesce(F.nullif(published, F.lit("")), F.lit("n.d.")), F.lit(4))
    return (
        F.when(style == "APA", F.format_string("%s (%s). %s. %s.", first, year, title, source))
        .when(style == "GB/T 7714", F.format_string("%s. %s[J]. %s, %s.", first, title, source, year))
        .otherwise(F.format_string('%s, "%s," %s, %s.', first, title, source, year))
    )


def json_object(text: Column) -> Column:
    """The object in a text, from its first brace to its last, as a variant; null where that is none."""
    found = F.nullif(F.regexp_extract(text_or_empty(text), "(?s)\\{.*\\}", 0), F.lit(""))
    value = F.try_parse_json(found)
    return F.when(F.schema_of_variant(value).startswith("OBJECT"), value)


def masked(secret: Column) -> Column:
    n = F.char_length(secret)
    return F.when(F.coalesce(n, F.lit(0)) == 0, "").when(n <= 8, "*" * 8).otherwise(F.concat(F.left(secret, F.lit(4)), F.lit("..."), F.right(secret, F.lit(4))))


def clamped(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def parsed_time(value: Column, default: Column | None = None) -> Column:
    """ISO dates and times, UTC where they say no zone; ``default`` (or null) for others. Bare years and months are none."""
    iso = F.when(value.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}"), value.try_cast("timestamp"))
    return iso if default is None else F.coalesce(iso, default)


def recency(then: Column, now: Column, days: float = 90.0) -> Column:
    """exp(-age / days), 1 for the future."""
    return F.exp(-F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(then)) / F.lit(8.64e10)) / F.lit(days))


def expired(status: Column, expires: Column, now: Column) -> Column:
    """``status``, but expired once an active session's time has come; unreadable times never come."""
    return F.when((status == "active") & (parsed_time(expires) <= now), "expired").otherwise(status)
