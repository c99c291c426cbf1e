"""Which filters do what, in every order: masks of failed filters, their histograms, and products with incidence matrices.

A text fails some of k filters, and the set of these is a mask of k bits. What a sequence of filters keeps, removes or
removes twice depends on how many texts have each mask, and on nothing else. So texts are read once; the histograms of the
masks (all texts, good ones, toxic ones) are the rows of a matrix of 2**k columns for each part of the table; and integer
matrices of 2**k rows and k! * k columns, one column for each step of each order, give all outcomes in one product:
32 by 600 for five filters.

One filter looks at the whole table: a text is a repeat if it stands under a smaller id. All other filters are the same
for equal texts, so only (digest, least id) has to be found, by a minimum that is taken before rows move.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import table, words, written

REPEATS = "E"
OUTCOMES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def text_filters(text: Column) -> dict[str, Column]:
    """The failure conditions of single texts (not null)."""
    w = words(text)
    n = F.size(w)
    return {
        "A": n < 100,
        "B": 100 * F.size(F.array_distinct(w)) < 80 * n,
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 10 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def orders(names: list[str]) -> list[str]:
    return ["".join(x) for x in permutations(names)]


def incidence(names: list[str]) -> dict[str, np.ndarray]:
    """For masks (rows; bit i: filter i fails) and steps of orders (columns, order by order): 0 or 1 of each outcome."""
    masks = np.arange(2 ** len(names))[:, None]
    own, before = [], []
    for order in orders(names):
        bits = [1 << names.index(x) for x in order]
        own += bits
        before += [sum(bits[:i]) for i in range(len(bits))]
    own, before = np.array(own), np.array(before)
    fails, gone = (masks & own) != 0, (masks & before) != 0
    out = {"kept": ~gone & ~fails, "removed": ~gone & fails, "redundant": gone & fails, "unique_fails": masks == own}
    return {k: v.astype(np.int64) for k, v in out.items()}


def mask_histograms(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", filters=text_filters, repeats: str | None = REPEATS) -> tuple[DataFrame, list[str]]:
    """((part, mask, n, good, toxic), names of the filters by bit).

    Null texts are empty, a null part is the empty string. A row fails ``repeats`` if an equal text stands under a smaller
    id, whatever else either fails; rows under the same id aren't repeats of each other, and rows with a null id neither
    are nor have repeats. A text is good (toxic) if any label of its id says 1; other labels, null ids among them, don't count.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    own = filters(text)
    mask = sum((F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(own.values())), F.lit(0))
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), mask.alias("mask"), F.unhex(F.sha2(text, 256)).alias("digest"))
    d, names = written(d, "masks"), [*own]
    is_one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(c)
    marks = labels.select(F.col(f"`{id_col}`").cast("long").alias("id"), "quality", "toxic").where("id IS NOT NULL").groupBy("id").agg(is_one("quality"), is_one("toxic"))
    d = d.join(marks, "id", "left")
    if repeats:
        firsts = d.where("id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
        d = d.join(firsts, ["id", "digest"], "left")
        d = d.withColumn("mask", F.col("mask") + F.when(F.col("id").isNotNull() & F.col("first").isNull(), F.lit(1 << len(names))).otherwise(F.lit(0)))
        names = [*names, repeats]
    ones = lambda c: F.count(F.when(F.col(c), 1))
    return d.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), ones("quality").alias("good"), ones("toxic").alias("toxic")), names


def filter_audit(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """(part, filter_order, step, and OUTCOMES) for each part of ``docs`` and each step of each order of the filters.

    ``shapley`` is what the step's filter removes, summed over all orders at whatever step it stands. Options are those of
    ``mask_histograms``, whose docstring has the rules for nulls and repeated rows; ``filters`` may name any filters of
    single texts, though orders grow as their factorial. An empty table has no parts and so no rows; texts of any length are
    looked at whole; columns that aren't named don't matter.
    """
    counts, names = mask_histograms(docs, labels, **how)
    size = 2 ** len(names)
    rows = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # at most 2 ** k cells
    sets, matrices = orders(names), incidence(names)
    steps = len(names)
    letter = np.array([names.index(x) for o in sets for x in o])

    def multiply(batches):
        for b in batches:
            for part, cells in zip(b["part"], b["cells"].to_pylist()):
                h = np.zeros((3, size), np.int64)
                for c in cells:
                    h[:, c["mask"]] = c["n"], c["good"], c["toxic"]
                got = {k: h[0] @ m for k, m in matrices.items()}
                got["good_lost"], got["toxic_lost"] = h[1] @ matrices["removed"], h[2] @ matrices["removed"]
                total = np.zeros(steps, np.int64)
                np.add.at(total, letter, got["removed"])
                got["shapley"] = total[letter]
                n = len(letter)
                yield pa.record_batch({
                    "part": pa.array([part.as_py()] * n, pa.string()), "filter_order": pa.array([o for o in sets for _ in range(steps)], pa.string()),
                    "step": pa.array([i + 1 for _ in sets for i in range(steps)], pa.int32()), **{k: pa.array(got[k], pa.int64()) for k in OUTCOMES},
                })

    return rows.mapInArrow(multiply, "part string, filter_order string, step int, " + ", ".join(f"{k} long" for k in OUTCOMES))


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    """Five filters in all 120 orders, for each language."""
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP11_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
f AS (SELECT d.doc_id, part, len(ws) < 100 AS A, 100 * len(list_distinct(ws)) < 80 * len(ws) AS B, 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 10 * length(t) AS C,
  regexp_matches(t, '[#$%&*|]') AS D, coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false) AS E FROM d),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
h AS (SELECT part, A, B, C, D, E, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
o(s) AS (SELECT '' UNION ALL SELECT s || x FROM o, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(x) WHERE length(s) < 5 AND strpos(s, x) = 0),
p AS (SELECT s, k AS step, substr(s, k, 1) AS own, left(s, k - 1) AS ahead FROM o, range(1, 6) r(k) WHERE length(s) = 5),
c AS (SELECT h.*, concat(CASE WHEN A THEN 'A' ELSE '' END, CASE WHEN B THEN 'B' ELSE '' END, CASE WHEN C THEN 'C' ELSE '' END, CASE WHEN D THEN 'D' ELSE '' END, CASE WHEN E THEN 'E' ELSE '' END) AS fails FROM h),
x AS (SELECT part, s, step, own, n, good, toxic, strpos(fails, own) > 0 AS failing, fails = own AS alone, translate(ahead, fails, '') <> ahead AS gone FROM c, p),
r AS (SELECT part, s, step, own, CAST(coalesce(sum(n) FILTER (WHERE NOT gone AND NOT failing), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (WHERE NOT gone AND failing), 0) AS BIGINT) AS removed,
  CAST(coalesce(sum(n) FILTER (WHERE gone AND failing), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (WHERE alone), 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(sum(good) FILTER (WHERE NOT gone AND failing), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (WHERE NOT gone AND failing), 0) AS BIGINT) AS toxic_lost
  FROM x GROUP BY part, s, step, own)
SELECT part, s AS filter_order, CAST(step AS INT) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r
"""
