"""A Merkle manifest of a table: every row is a leaf, groups of rows are trees, and the trees' roots make one tree more.

Rows get gapless positions inside their group by ranges of the order, so no group meets in one task. ``FANOUT ** BLOCK_LEVELS``
neighbouring nodes form a block, one row with an ordered array; built-in higher-order functions collapse its levels
(``sequence`` over the runs, ``slice`` for a run, ``transform`` to hash each, ``aggregate`` over the levels), and the blocks'
roots are the nodes of the next round, until one node a group is left. A second walk goes down the stored blocks and gives
every leaf its siblings, level by level. A round has 1/512 of the rows of the round before; nothing but the largest number
of nodes of a group comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import lower_ascii, numbered, shuffle_partitions, table, written

FANOUT = 8
BLOCK_LEVELS = 3
BLOCK = FANOUT ** BLOCK_LEVELS
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
PATH = "array<struct<before:string,after:string>>"


def leaf_digest(*values: Column) -> Column:
    """SHA-256 of the values, each as its length in UTF-8 bytes, a colon and itself; null is a hyphen."""
    parts = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.sha2(F.concat(*parts), 256)


def _levels_needed(n: Column) -> Column:
    """How often runs must collapse until one of ``n`` nodes is left, at most as often as a block can."""
    return F.size(F.filter(F.array(*[F.lit(FANOUT ** k).cast("long") for k in range(BLOCK_LEVELS)]), lambda x: x < n))


def _collapsed(nodes: Column, levels: Column) -> Column:
    """All levels of a block, its nodes first: array of arrays of digests."""

    def up(done: Column, _: Column) -> Column:
        last = F.element_at(done, -1)
        runs = F.sequence(F.lit(0), F.floor((F.size(last) - 1) / FANOUT).cast("int"))
        return F.concat(done, F.array(F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(last, i * FANOUT + 1, FANOUT), ""), 256))))

    steps = F.slice(F.array(*[F.lit(k) for k in range(BLOCK_LEVELS)]), 1, levels)
    return F.aggregate(steps, F.array(nodes), up)


def _siblings(levels: Column, at: Column) -> Column:
    """For the node at place ``at`` of a block: what stands before and after it, or its ancestor, in the run of each level."""

    def of(k: Column) -> Column:
        place = F.floor(at / F.pow(F.lit(float(FANOUT)), k)).cast("int")
        off = F.pmod(place, F.lit(FANOUT))
        level, start = F.element_at(levels, k + 1), place - off + 1
        return F.struct(F.array_join(F.slice(level, start, off), "").alias("before"), F.array_join(F.slice(level, start + off + 1, FANOUT - 1 - off), "").alias("after"))

    return F.transform(F.slice(F.array(*[F.lit(k) for k in range(BLOCK_LEVELS)]), 1, F.size(levels) - 1), of)


def ranked(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds ``pos``, from 0 inside each ``grp`` by ``order``, and ``n``, the rows of the group. Equal rows get any of their places."""
    ties = df.withColumn("__tie", F.monotonically_increasing_id())
    ranges = ties.repartitionByRange(shuffle_partitions(df.sparkSession), "grp", *order, "__tie").withColumn("__range", F.spark_partition_id())
    ranges = written(ranges, name)
    d = numbered(ranges, ["grp"], [*map(F.col, order), F.col("__tie")], F.col("__range"), "pos")
    return d.join(ranges.groupBy("grp").agg(F.count(F.lit(1)).alias("n")), "grp").drop("__tie", "__range")


def _up(nodes: DataFrame, name: str) -> tuple[list[DataFrame], DataFrame]:
    """Stored blocks of each round, and (grp, node) with the root of each group. ``nodes``: grp, pos, n, node, and what leaves carry."""
    rounds = []
    while True:
        carried = [c for c in nodes.columns if c not in ("grp", "n")]
        blocks = nodes.groupBy("grp", F.floor(F.col("pos") / BLOCK).alias("block")).agg(F.sort_array(F.collect_list(F.struct("pos", *[c for c in carried if c != "pos"]))).alias("items"), F.max("n").alias("n"))
        rounds.append(written(blocks.withColumn("levels", _collapsed(F.col("items.node"), _levels_needed(F.col("n")))), name))
        nodes = rounds[-1].select("grp", F.col("block").alias("pos"), F.ceil(F.col("n") / BLOCK).alias("n"), F.element_at(F.element_at("levels", -1), 1).alias("node"))
        if (nodes.agg(F.max("n")).first()[0] or 1) == 1:
            return rounds, nodes.select("grp", "node")


def _down(rounds: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The leaves with ``path``, from their own run to what ``tops`` (grp, path, and more columns) say of their root."""
    more = [c for c in tops.columns if c not in ("grp", "path")]
    at = tops.withColumn("pos", F.lit(0).cast("long"))
    for blocks in reversed(rounds):
        d = blocks.join(at.withColumnRenamed("pos", "block"), ["grp", "block"])
        own = lambda x, i: F.struct(*[x[f].alias(f) for f in blocks.schema["items"].dataType.elementType.names], F.concat(_siblings(F.col("levels"), i), F.col("path")).alias("path"))
        at = d.select("grp", *more, F.explode(F.transform("items", own)).alias("x")).select("grp", *more, "x.*")
    return at


def folded(node: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, node, lambda acc, s: F.sha2(F.concat(s.before, acc, s.after), 256))


def merkle_manifest(df: DataFrame, id_col: str = "doc_id", fields: list[str] = FIELDS, group_col: str = "lang", more: dict[str, Column] | None = None) -> DataFrame:
    """(id, grp, leaf, subroot, root, path) for each row, and the columns of ``more``, worked out from the row itself.

    A leaf is ``leaf_digest`` of ``fields``. Inside a group rows ascend by id, nulls first, then by leaf; rows equal in both
    are interchangeable. ``grp`` is empty for a null group and else 1 before its name, so that null comes first and the empty
    name next; the groups' roots ascend by it bytewise. A lone leaf is its group's root, and a lone group's root the root.
    ``path`` has a pair of strings a level, the digests before and after in the run. Texts of any length are hashed whole, and
    aren't moved; an empty table has an empty manifest; columns that aren't named don't matter.
    """
    spark, group = df.sparkSession, F.col(f"`{group_col}`").cast("string")
    leaves = df.select(
        F.coalesce(F.concat(F.lit("1"), group), F.lit("")).alias("grp"), F.col(f"`{id_col}`").alias("id"), leaf_digest(*[F.col(f"`{c}`") for c in fields]).alias("node"),
        *[c.alias(f"more_{k}") for k, c in (more or {}).items()],
    )
    rounds, subroots = _up(ranked(written(leaves, "leaves"), ["id", "node"], "leaf_ranges"), "leaf_blocks")
    groups = ranked(subroots.select(F.lit("").alias("grp"), F.col("grp").alias("name"), "node"), ["name"], "group_ranges")
    upper, root = _up(groups, "group_blocks")
    tops = root.select("grp", F.expr(f"CAST(array() AS {PATH})").alias("path"), F.col("node").alias("root"))
    tops = _down(upper, tops).select(F.col("name").alias("grp"), "path", F.col("node").alias("subroot"), "root")
    d = _down(rounds, written(tops, "group_paths"))
    return d.select("id", "grp", F.col("node").alias("leaf"), "subroot", "root", "path", *[F.col(f"more_{k}").alias(k) for k in (more or {})])


def op13_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, and whether a third of them, tampered with, still verify."""
    docs = table(spark, sf_dir, "documents")
    fields = [F.col(c) for c in FIELDS]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, leaf_digest(*fields[:-1], lower_ascii(F.col("text"))))
    d = merkle_manifest(docs, more={"tampered": tampered})
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s.before, s.after)), ""), 256)
    d = d.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof.alias("proof_sha256"), folded(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root"))
    return d.withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql(levels: int) -> str:
    """DuckDB SQL for groups, and numbers of groups, of up to FANOUT ** levels.

    Level by level, a node's run gives its parent; ``done`` keeps nodes of finished trees as they are. Rows then take the
    siblings of their ancestor at each level, and the hash of what these hold.
    """
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode(CAST({c} AS VARCHAR))) || ':' || {c} END"
    ahead = " || ".join(field(c) for c in FIELDS[:-1])
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    # CRC-32 as DuckDB lacks it: the reflected polynomial, eight steps a byte of the decimal id
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    out = [f"""WITH RECURSIVE crc(doc_id, s, i, b, c) AS (
  SELECT DISTINCT doc_id, CAST(doc_id AS VARCHAR), 0, 8, CAST(4294967295 AS BIGINT) FROM documents WHERE doc_id IS NOT NULL
  UNION ALL SELECT doc_id, s, CASE WHEN b = 8 THEN i + 1 ELSE i END, CASE WHEN b = 8 THEN 1 ELSE b + 1 END,
    (SELECT {step} FROM (SELECT CASE WHEN b = 8 THEN xor(crc.c, CAST(ascii(substr(s, i + 1, 1)) AS BIGINT)) ELSE crc.c END AS c) x)
  FROM crc WHERE b < 8 OR i < length(s)),
crcs AS (SELECT doc_id, xor(c, 4294967295) % 3 = 0 AS bad FROM crc WHERE b = 8 AND i = length(s)),
leaf AS (SELECT doc_id, coalesce('1' || lang, '') AS grp, sha256({ahead} || {field("text")}) AS h,
  CASE WHEN doc_id IN (SELECT doc_id FROM crcs WHERE bad) THEN sha256({ahead} || {field(f"translate(text, '{upper}', '{upper.lower()}')")}) ELSE sha256({ahead} || {field("text")}) END AS alt FROM documents),
a0 AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, h) - 1 AS p FROM leaf),
n0 AS (SELECT grp, p, h FROM a0)"""]

    def tree(n: str, first: str) -> str:
        for k in range(levels):
            out.append(f"""{n}{k + 1} AS (SELECT grp, CASE WHEN c = 1 THEN 0 ELSE p // {FANOUT} END AS p, CASE WHEN max(c) = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY p)) END AS h
  FROM (SELECT *, count(*) OVER (PARTITION BY grp) AS c FROM {first if k == 0 else n + str(k)}) GROUP BY grp, c, CASE WHEN c = 1 THEN 0 ELSE p // {FANOUT} END)""")
        return f"{n}{levels}"

    def walk(rows: str, n: str, a: str, grp: str) -> str:
        for k in range(levels):
            last = rows if k == 0 else f"{a}{k}"
            base = f"{n}{k}"
            out.append(f"""{a}{k + 1} AS MATERIALIZED (SELECT r.* EXCLUDE (p, proof, f), CASE WHEN s.c = 1 THEN r.p ELSE r.p // {FANOUT} END AS p,
    CASE WHEN s.c = 1 THEN r.proof ELSE r.proof || array_to_string(list_transform(list_filter(s.run, lambda x: x.p <> r.p), lambda x: x.h), '') END AS proof,
    CASE WHEN s.c = 1 THEN r.f ELSE sha256(array_to_string(list_transform(s.run, lambda x: CASE WHEN x.p = r.p THEN r.f ELSE x.h END), '')) END AS f
  FROM {last} r JOIN (SELECT grp, p // {FANOUT} AS q, any_value(c) AS c, list({{'p': p, 'h': h}} ORDER BY p) AS run
    FROM (SELECT *, count(*) OVER (PARTITION BY grp) AS c FROM {base}) GROUP BY grp, p // {FANOUT}) s ON s.grp = r.{grp} AND s.q = r.p // {FANOUT})""")
        return f"{a}{levels}"

    sub = tree("n", "n0")
    out.append(f"m0 AS (SELECT '' AS grp, row_number() OVER (ORDER BY grp) - 1 AS p, h, grp AS name FROM {sub})")
    root = tree("m", "m0")
    out.append("w0 AS (SELECT doc_id, grp, h, p, '' AS proof, alt AS f FROM a0)")
    low = walk("w0", "n", "w", "grp")
    out.append(f"v0 AS (SELECT w.* EXCLUDE (p), m0.p AS p, '' AS top, m0.h AS subroot FROM {low} w JOIN m0 ON m0.name = w.grp)")
    high = walk("v0", "m", "v", "top")
    return ",\n".join(out) + f"\nSELECT doc_id, v.h AS leaf, subroot, r.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = r.h AS verified FROM {high} v, {root} r"


OP13_SQL = _sql(6)
