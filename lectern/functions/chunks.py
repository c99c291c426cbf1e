"""Chunks of texts: fixed slices as an expression, paragraphs as a batched function, and a table of chunks of papers."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import collapsed, keywords, once, tokens

# The least size of a chunk, and the usual size and overlap.
LEAST, SIZE, OVERLAP = 200, 900, 120
_END = re.compile("[。！？.!?]")


def limits(size: int = SIZE, overlap: int = OVERLAP) -> tuple[int, int]:
    size = max(LEAST, size)
    return size, min(max(overlap, 0), size - 1)


def fixed_chunks(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Slices of the collapsed text, ``size`` characters each and ``overlap`` shared with the one before; none for blanks.

    The text is cut once into steps without overlap and each slice put together from the steps it covers, so the work
    grows with the text's length and not with its square.
    """
    size, overlap = limits(size, overlap)
    step = max(size - overlap, 1)
    cover = -(-size // step)

    def slices(steps: Column) -> Column:
        at = F.when(F.size(steps) > 0, F.sequence(F.lit(1), F.size(steps))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.trim(F.left(F.array_join(F.slice(steps, i, cover), ""), F.lit(size))))

    return F.filter(once(F.regexp_extract_all(collapsed(text), F.lit(f"(?s).{{1,{step}}}"), 0), slices), lambda c: c != "")


def paragraph_pieces(text: str, size: int, overlap: int) -> list[str]:
    """Whole paragraphs, sentences filled up to ``size``, or slices of over-long sentences, in order."""
    out = []
    for paragraph in filter(None, (" ".join(p.split()) for p in text.split("\n\n"))):
        if len(paragraph) <= size:
            out.append(paragraph)
            continue
        held = ""
        for s in filter(None, (x.strip() for x in _END.split(paragraph))):
            if len(held) + len(s) + 1 <= size:
                held = f"{held} {s}" if held else s
                continue
            out += [held] * bool(held)
            held = s if len(s) <= size else ""
            if len(s) > size:
                out += filter(None, (s[i:i + size].strip() for i in range(0, len(s), max(size - overlap, 1))))
        out += [held] * bool(held)
    return out


def with_overlap(pieces: list[str], overlap: int) -> list[str]:
    """Each piece after the end of the chunk before it, which may itself begin with such an end."""
    out: list[str] = []
    for p in pieces:
        out.append(f"{out[-1][-overlap:]} {p}" if out and overlap and len(out[-1]) > overlap else p)
    return out


def paragraph_chunks(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Chunks that mind paragraphs and sentences; each begins with the end of the one before. None for blanks.

    A chunk depends on the chunk before it, so this is a fold over one text, in Arrow batches.
    """
    size, overlap = limits(size, overlap)

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: with_overlap(paragraph_pieces(t or "", size, overlap), overlap))

    return cut(F.coalesce(text, F.lit("")))


def build_chunks(papers: DataFrame, strategy: str = "paragraph", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of ``papers`` (tenant_id, user_id, paper_id, title, abstract, full_text, published_at).

    A paper without text has its title as its one chunk. Token counts have repeats; keywords are the first twenty tokens.
    """
    part = [F.nullif(F.coalesce(F.col(c), F.lit("")), F.lit("")) for c in ("title", "abstract", "full_text")]
    cut = fixed_chunks if strategy == "fixed" else paragraph_chunks
    keys = ["tenant_id", "user_id", "paper_id"]
    d = papers.select(*keys, F.coalesce("published_at", F.lit("")).alias("published_at"), part[0].alias("title"), cut(F.concat_ws("\n", *part), size, overlap).alias("chunks"))
    d = d.withColumn("chunks", F.when((F.size("chunks") == 0) & F.col("title").isNotNull(), F.array("title")).otherwise(F.col("chunks")))
    d = d.select(*keys, "published_at", F.posexplode("chunks").alias("chunk_index", "content"))
    d = d.withColumn("tokens", tokens(F.col("content")))
    return d.select(
        F.sha2(F.concat_ws(":", *keys, F.col("chunk_index").cast("string"), "content"), 256).alias("chunk_id"), *keys, F.col("chunk_index").cast("long").alias("chunk_index"),
        F.sha2("content", 256).alias("content_hash"), "content", F.size("tokens").cast("long").alias("token_count"), F.slice(F.array_distinct("tokens"), 1, 20).alias("keywords"), "published_at",
    )
