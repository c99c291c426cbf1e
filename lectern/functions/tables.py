"""Table functions for SQL, used in lateral joins: tokens, paragraph chunks, close names.

``tokenize`` is a SQL function of built-in expressions and stays in the engine; the other two are table functions in Python,
whose rows travel in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lectern.functions.chunks import OVERLAP, SIZE, limits, paragraph_pieces, with_overlap
from lectern.functions.text import IDEOGRAPHS, LATIN
from lectern.operators.fuzzy import Bags


class ChunkParagraphs:
    def eval(self, text: str | None, size: int | None = None, overlap: int | None = None) -> Iterator[tuple[int, str]]:
        size, overlap = limits(SIZE if size is None else size, OVERLAP if overlap is None else overlap)
        yield from enumerate(with_overlap(paragraph_pieces(text or "", size, overlap), overlap))


class CloseMatches:
    """The index of the last pool is kept, so rows that share a pool share it."""

    def __init__(self):
        self.pool, self.bags = None, None

    def eval(self, word: str | None, pool: list[str] | None, most: int | None = None, cutoff: float | None = None) -> Iterator[tuple[int, str, float]]:
        if word is None or not pool:
            return
        if pool != self.pool:
            self.pool, self.bags = pool, Bags(sorted({x for x in pool if x is not None}))
        found, _ = self.bags.nearest(word, 3 if most is None else most, 0.6 if cutoff is None else float(cutoff))
        for rank, (ratio, name) in enumerate(found, 1):
            yield rank, name, ratio


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def register(spark: SparkSession) -> None:
    """``tokenize(text)``: (place, token); ``chunk_paragraphs(text[, size[, overlap]])``: (chunk_index, chunk);
    ``close_matches(word, pool[, most[, cutoff]])``: (rank, name, ratio). Null texts, words and pools have no rows."""
    pair = "transform(sequence(1, greatest(char_length(run) - 1, 1)), i -> substring(run, i, 2))"
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION tokenize(text STRING) RETURNS TABLE (place INT, token STRING) RETURN
SELECT posexplode(concat(regexp_extract_all(lower(text), {_quoted(LATIN)}, 0),
  flatten(transform(regexp_extract_all(lower(text), {_quoted(IDEOGRAPHS)}, 0), run -> if(char_length(run) = 1, array(run), {pair})))))""")
    spark.udtf.register("chunk_paragraphs", F.udtf(ChunkParagraphs, returnType="chunk_index int, chunk string", useArrow=True))
    spark.udtf.register("close_matches", F.udtf(CloseMatches, returnType="rank int, name string, ratio double", useArrow=True))
