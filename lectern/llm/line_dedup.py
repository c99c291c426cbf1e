"""Line dedup by winnowing, with DataFrame functions alone.

Lines are compared with white space collapsed; blank lines are left out of the comparison and stay where they are.
Hashes of ``gram`` lines are winnowed: of every ``window`` of them in a row the least (the last one, of equals) selects
its position, so equal runs of ``gram + window - 1`` lines select the same position in them, and about two of every
``window + 1`` positions are selected. A run of one or two lines counts as well if it has over ``long_words`` words; it
selects itself. Positions are kept where their fingerprint was selected more than once in all documents. The windows that
selected such a position, which lie on both sides of it, are compared as wholes with all others of its fingerprint; there is
no walk outward from a position, but as each line of a match has a window of its own here, the union of equal windows is the
longest equal run, the same as such a walk would find. Of equal runs the first, in the order (id, hash of the text, line), stays; of the others every line
is deleted that isn't also a line of that first run.

The first of each run is found by pre-aggregated minima; joining these to the positions is the only step a frequent
line can be hot in, and Spark splits such joins. Runs are never paired.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import table, written

BLANKS = "[\\x09-\\x0D\\x20]+"


def _plain(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, BLANKS, " "))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _numbers(n: Column) -> Column:
    """0 .. n - 1, and none where n is under 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once: an expression named inside a lambda would be worked out for each item."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _full(lines: Column) -> Column:
    """Numbers of the lines that aren't blank."""
    return F.filter(F.transform(lines, lambda x, i: F.when(_plain(x) != "", i)), lambda i: i.isNotNull())


def repeated_runs(docs: DataFrame, gram: int = 2, window: int = 2, long_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, mark, ranges): for each document that has some, the lines (lo, hi) to delete, counted over lines that aren't
    blank. ``mark`` is the hash of the whole text."""
    run = gram + window - 1
    d = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("mark"), _lines(F.col(f"`{text_col}`").cast("string")).alias("lines"))
    words = lambda x: F.char_length(x) - F.char_length(F.replace(x, F.lit(" "), F.lit(""))) + 1
    d = d.select("id", "mark", F.transform(F.filter(F.transform("lines", _plain), lambda x: x != ""), lambda x: F.struct(F.xxhash64(x).alias("h"), words(x).alias("n"))).alias("x"))
    d = written(d.dropDuplicates(["id", "mark"]), "lines").select("id", "mark", F.col("x.h").alias("h"), F.col("x.n").alias("n"))
    d = d.where((F.size("h") >= run) | F.exists("n", lambda n: n > long_words) | (F.size("h") == 2))
    grams = F.transform(_numbers(F.size("h") - (gram - 1)), lambda i: F.xxhash64(F.slice("h", i + 1, gram)))

    def selected(g: Column, s: Column) -> Column:
        """Of the window that begins at gram s: the least hash, and of equals the last, with its place p."""
        least = F.array_min(F.transform(F.sequence(F.lit(0), F.lit(window - 1)), lambda k: F.struct(F.get(g, s + k).alias("f"), (-k).alias("k"))))
        return _once(least, lambda m: F.struct(m["f"].alias("f"), (s - m["k"]).alias("p")))

    d = d.withColumn("m", _once(grams, lambda g: F.transform(_numbers(F.size("h") - (run - 1)), lambda s: selected(g, s))))

    def found(s: Column, length: int, f: Column, fresh: Column) -> Column:
        return F.struct(s.alias("s"), F.lit(length).alias("length"), f.alias("f"), fresh.alias("fresh"), F.xxhash64(F.slice("h", s + 1, length), F.lit(length)).alias("whole"))

    def long_runs(length: int) -> Column:
        total = lambda s: sum((F.get("n", s + i) for i in range(1, length)), F.get("n", s))
        some = F.filter(_numbers(F.size("h") - (length - 1)), lambda s: total(s) > long_words)
        return F.transform(some, lambda s: found(s, length, F.xxhash64(F.slice("h", s + 1, length), F.lit(-length)), F.lit(True)))

    # a position that the window before has selected as well isn't a new one
    usual = F.transform("m", lambda m, s: found(s, run, m["f"], (s == 0) | (F.get("m", s - 1)["p"] != m["p"])))
    w = d.select("id", "mark", F.explode(F.concat(usual, *[long_runs(i) for i in range(1, min(run, 3))])).alias("w"))
    w = written(w.select("id", "mark", "w.*"), "windows")
    often = w.where("fresh").groupBy("f").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("f")
    at = w.drop("fresh").join(often, "f", "left_semi")
    first = at.groupBy("f", "length", "whole").agg(F.min(F.struct("id", "mark", "s")).alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1").drop("times")
    later = at.join(first, ["f", "length", "whole"]).where(~F.struct("id", "mark", "s").eqNullSafe(F.col("first")))
    own = F.col("first.id").eqNullSafe(F.col("id")) & (F.col("first.mark") == F.col("mark"))
    later = later.select("id", "mark", F.when(own, F.greatest(F.col("s"), F.col("first.s") + F.col("length"))).otherwise(F.col("s")).alias("lo"), (F.col("s") + F.col("length") - 1).alias("hi"))
    return later.where("lo <= hi").groupBy("id", "mark").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))


def drop_repeated_lines(docs: DataFrame, gram: int = 2, window: int = 2, long_words: int = 50, id_col: str = "doc_id", text_col: str = "text", counts: bool = True, emptied: bool = True) -> DataFrame:
    """``docs`` with ``text_col`` cut, one row for each row; with ``counts`` also n_lines and n_removed (lines that aren't blank).

    Null text stays null and has no lines. Empty texts stay as they are, and so do texts of fewer lines than a run and of
    few words. Rows equal in id and text are one document, cut alike. A null id sorts before all others. Lines of any
    length and texts of any number of lines are taken whole. An empty table gives an empty table. Other columns pass
    through; with ``counts``, columns named n_lines or n_removed are replaced. Without ``emptied``, rows that lose all
    their lines go: all they said stands in earlier documents.
    """
    found = repeated_runs(docs, gram, window, long_words, id_col, text_col).select(F.col("id").alias("__id"), F.col("mark").alias("__mark"), F.col("ranges").alias("__ranges"))
    text = F.col(f"`{text_col}`").cast("string")
    d = docs.join(found, F.col(f"`{id_col}`").eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__mark")), "left")
    gone = F.array_distinct(F.flatten(F.transform("__ranges", lambda x: F.sequence(x["lo"], x["hi"]))))
    cut = _once(F.struct(_lines(text).alias("lines"), gone.alias("gone")), lambda x: _once(_full(x["lines"]), lambda full: F.array_join(
        F.transform(F.array_except(_numbers(F.size(x["lines"])), F.transform(x["gone"], lambda j: F.get(full, j))), lambda i: F.get(x["lines"], i)), "\n")))
    whole = F.col("__ranges").isNull()
    out = {text_col: F.when(whole, F.col(f"`{text_col}`")).otherwise(cut)}
    if counts:
        out |= {"n_lines": F.size(_full(_lines(text))).cast("long"), "n_removed": F.when(whole, F.lit(0)).otherwise(F.size(gone)).cast("long")}
    if not emptied:
        d = d.where(whole | (F.size(_full(_lines(text))) > F.size(gone)))
    return d.withColumns(out).drop("__id", "__mark", "__ranges")


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents without later repeats of runs of three lines, or of over fifty words, as a digest."""
    out = drop_repeated_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.md5(F.coalesce("text", F.lit(""))).alias("kept_md5"))


OP7_SQL = r"""
WITH a AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, raw, i, trim(regexp_replace(raw, '[\x09-\x0D\x20]+', ' ', 'g'), ' ') AS line
      FROM (SELECT doc_id, unnest(ls) AS raw, unnest(range(1, len(ls) + 1)) AS i FROM a)),
n AS (SELECT doc_id, i, line, length(line) - length(replace(line, ' ', '')) + 1 AS words, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS j FROM l WHERE line <> ''),
w AS (SELECT a.doc_id, a.j, 3 AS k, md5(a.line || chr(10) || b.line || chr(10) || c.line) AS h
      FROM n a JOIN n b ON a.doc_id = b.doc_id AND b.j = a.j + 1 JOIN n c ON a.doc_id = c.doc_id AND c.j = a.j + 2
      UNION ALL SELECT doc_id, j, 1, md5(line) FROM n WHERE words > 50
      UNION ALL SELECT a.doc_id, a.j, 2, md5(a.line || chr(10) || b.line) FROM n a JOIN n b ON a.doc_id = b.doc_id AND b.j = a.j + 1 WHERE a.words + b.words > 50),
r AS (SELECT doc_id, CASE WHEN doc_id = first_value(doc_id) OVER p THEN greatest(j, first_value(j) OVER p + k) ELSE j END AS lo, j + k - 1 AS hi, row_number() OVER p AS nth
      FROM w WINDOW p AS (PARTITION BY k, h ORDER BY doc_id, j)),
g AS (SELECT DISTINCT n.doc_id, n.i FROM n JOIN r ON n.doc_id = r.doc_id AND r.nth > 1 AND n.j BETWEEN r.lo AND r.hi),
k AS (SELECT doc_id, string_agg(raw, chr(10) ORDER BY i) AS kept FROM l ANTI JOIN g USING (doc_id, i) GROUP BY doc_id),
c AS (SELECT doc_id, count(*) AS n_lines FROM n GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_removed FROM g GROUP BY doc_id)
SELECT a.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, md5(coalesce(kept, '')) AS kept_md5
FROM a LEFT JOIN k USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)
"""
