"""Exact token counts of a public tokenizer, for texts of any length.

Texts of up to ``CHUNK`` characters are counted by words: a blank ends every run, so what stands between blanks is encoded
by itself, and once for all its places in a batch of texts. Longer texts are cut into chunks that overlap, and chunks, not
texts, are dealt to tasks. Each chunk reports how many tokens it has and which *anchors* lie in its overlaps; two neighbours
are spliced at an anchor that both report, and the count of the text is what the chunks have between their splices. Where
two neighbours share no anchor, the text is cut again with overlaps four times as wide, and at last whole.

An anchor is a token with equal id and equal place in both encodings, of whole characters, after which the text can't change
what stands before (neither it nor the next character joins with others when Unicode is composed). That proves the splice, for
a tokenizer whose words are runs of one class of characters (blanks, letters, single digits, others) or a short fixed start,
and whose tokens come from ranked merges with a mark at word ends:

- The left chunk began at the text's start or at a proven splice, so its scan of words is the text's up to the anchor. After
  the anchor both chunks go on alike, since the run that the anchor stands in ends at the same character for both, and the
  id says whether it ended with the anchor.
- Inside a word, a sequence of tokens is the one that merging gives if and only if merging any two neighbours by themselves
  gives these two back: the first merge over a boundary would happen among the two alone as well. All neighbours of the
  spliced sequence stand side by side in one of the chunks, since the anchor is in both.
- Special strings have no proper beginning that is an end of theirs, and are shorter than the overlap, so one of two neighbours
  has them whole, and no token inside one is an anchor.

Whether a tokenizer file is of this kind is checked when it is loaded; any other is refused.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import U, Words, pieces
from .shared import WORD_SPLIT, table, written

CHUNK = 32_768
OVERLAP = 512
KNOWN_WORDS = 1_000_000
LIMIT = 2048
TOKENIZER = "word_bpe_49k.json"
# The words of the tokenizer file.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def tokenizer_path(name: str) -> str:
    """A file's place on this machine; a name with a slash is a path already."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class WordCounts:
    """Tokens of single words; remembers up to ``KNOWN_WORDS`` of them from one batch to the next."""

    def __init__(self, tokenizer):
        self.tokenizer, self.keys, self.counts = tokenizer, np.zeros(0, U), np.zeros(0, np.int64)

    def of_texts(self, texts: pa.Array) -> np.ndarray:
        w = Words(texts)
        keys, at, back = np.unique(w.hashes(), return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inner = place < len(self.keys)
        known[inner] = self.keys[place[inner]] == keys[inner]
        counts = np.zeros(len(keys), np.int64)
        counts[known] = self.counts[place[known]]
        new = at[~known]
        if len(new):
            counts[~known] = self._encoded([bytes(w.raw[a:b]).decode() for a, b in zip(w.starts[new], w.ends[new])])
            if len(self.keys) + len(new) > KNOWN_WORDS:
                self.keys, self.counts = keys[:KNOWN_WORDS], counts[:KNOWN_WORDS]
            else:
                self.keys, self.counts = np.insert(self.keys, place[~known], keys[~known]), np.insert(self.counts, place[~known], counts[~known])
        total = np.concatenate([[0], np.cumsum(counts[back])])
        return total[w.first[1:]] - total[w.first[:-1]]

    def _encoded(self, new: list[str], together: int = 256) -> np.ndarray:
        """Words side by side with a blank between them; a token belongs to the word in which it starts."""
        groups = [new[i:i + together] for i in range(0, len(new), together)]
        out = [np.zeros(0, np.int64)]
        for words, e in zip(groups, self.tokenizer.encode_batch([" ".join(g) for g in groups], add_special_tokens=False)):
            starts = np.cumsum([0, *[len(x) + 1 for x in words]])
            of = np.searchsorted(starts, [a for a, _ in e.offsets], side="right") - 1
            out.append(np.bincount(of, minlength=len(words)))
        return np.concatenate(out)


@lru_cache(4)
def _loaded(name: str):
    """The tokenizer, its counter of words, and whether its chunks can be spliced."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    path = tokenizer_path(name)
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    if not _spliceable(path):
        raise ValueError(f"no proof that encodings of words and chunks can be put together for {name}")
    return t, WordCounts(t)


def _spliceable(path: str) -> bool:
    """Whether the proof above holds for the tokenizer."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, norm, pre = spec["model"], spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    steps = [x["type"] for x in norm.get("normalizers", [])]
    split = (pre.get("pretokenizers") or [{}])[0]
    made = {c for token in model["vocab"] for c in (token.removesuffix("</w>"),) if len(c) == 1} | {c + "</w>" for token in model["vocab"] for c in (token.removesuffix("</w>"),) if len(c) == 1}
    for pair in model["merges"]:
        a, b = pair if isinstance(pair, list) else pair.split(" ")
        if a not in made or b not in made:
            return False  # a merge that stands before those that make its parts
        made.add(a + b)
    special = [x["content"] for x in spec["added_tokens"]]
    return (
        model["type"] == "BPE" and not model.get("dropout") and not model.get("ignore_merges") and model.get("end_of_word_suffix") == "</w>" and not model.get("continuing_subword_prefix")
        and steps == ["NFC", "Replace", "Lowercase"] and split.get("type") == "Split" and split["pattern"].get("Regex") == WORD_PATTERN and spec.get("post_processor") is None
        and not any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] for x in spec["added_tokens"])
        and all(len(x) < OVERLAP // 2 and not any(x.startswith(y[i:]) for y in special for i in range(1, len(y))) for x in special)
    )


@lru_cache(1)
def _joining() -> frozenset[str]:
    """Characters that compose with one before them."""
    seconds = {chr(c) for c in [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]}  # Hangul vowels and ends
    for c in range(0x110000):
        parts = unicodedata.decomposition(chr(c))
        if parts and parts[0] != "<":
            first, *rest = parts.split(" ")
            seconds |= {chr(int(x, 16)) for x in rest}
            if unicodedata.combining(chr(int(first, 16))):
                seconds.add(chr(c))
    return frozenset(seconds)


def stays_apart(s: str) -> bool:
    """Whether no character of ``s`` is moved or taken up by composition with what stands before it."""
    return s.isascii() or all(c < "̀" or not (unicodedata.combining(c) or c in _joining() or unicodedata.decomposition(c)[:1] not in ("", "<")) for c in s)


def anchors(text: str, ids: list[int], spans: list[tuple[int, int]], lo: int, hi: int):
    """(start, end, id, index) of the anchors whose tokens lie in ``text[lo:hi]``."""
    first = bisect_left(spans, lo, key=lambda s: s[0])
    for i in range(max(first, 0), len(ids)):
        a, b = spans[i]
        if b > hi:
            break
        whole = a < b and (i == 0 or spans[i - 1][1] <= a) and (i + 1 == len(ids) or spans[i + 1][0] >= b)
        if a >= lo and whole and stays_apart(text[a:b + 1]):
            yield a, b, ids[i], i


COUNTED = "id long, n_bytes long, n_tokens long, digest binary"
ANCHOR = "digest binary, chunk int, left boolean, start long, stop long, token long, at long, n_chunks int, n_tokens long"


def _whole_counts(texts: DataFrame, name: str, chunk: int) -> DataFrame:
    """Rows of ``COUNTED``; texts over ``chunk`` characters have a digest, and no count yet."""

    def count(batches):
        _, counter = _loaded(name)
        for whole in batches:
            for b in pieces(whole, "text"):
                yield pa.record_batch({"id": b["id"], "n_bytes": b["n_bytes"], "n_tokens": pa.array(counter.of_texts(b["text"]), pa.int64()), "digest": b["digest"]})

    long = F.length("text") > chunk
    d = texts.select("id", F.when(~long, F.col("text")).alias("text"), "n_bytes", F.when(long, F.unhex(F.sha2("text", 256))).alias("digest"))
    return d.mapInArrow(count, COUNTED)


def _chunks(texts: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(digest, chunk, n_chunks, piece): piece k begins at k * chunk and reaches ``overlap`` characters into the next."""

    def cut(batches):
        for b in batches:
            for digest, text in zip(b["digest"], b["text"]):
                text = text.as_py()
                n = max(1, -(-(len(text) - overlap) // chunk))
                for k in range(n):
                    yield pa.record_batch({
                        "digest": pa.array([digest.as_py()], pa.binary()), "chunk": pa.array([k], pa.int32()), "n_chunks": pa.array([n], pa.int32()),
                        "piece": pa.array([text[k * chunk:(k + 1) * chunk + overlap] if k + 1 < n else text[k * chunk:]], pa.string()),
                    })

    d = texts.select("digest", "text").mapInArrow(cut, "digest binary, chunk int, n_chunks int, piece string")
    return d.repartition("digest", "chunk")


def _with_places(piece: str, name: str, chunk: int, overlap: int) -> tuple[list[int], list[tuple[int, int]], list[int], int]:
    """Ids, spans and numbers of the tokens around both overlaps, and how many tokens the piece has.

    What lies between the first blank after the left overlap and the last one before the right is counted by words."""
    tokenizer, counter = _loaded(name)
    blank = re.compile(WORD_SPLIT)
    first = blank.search(piece, min(overlap, len(piece)))
    lo = first.start() if first else 0
    hi = max((m.end() for m in blank.finditer(piece, max(lo, chunk - 2048), max(lo, min(chunk, len(piece))))), default=lo) if first else 0
    if hi <= lo:
        lo = hi = 0
    parts = [(tokenizer.encode(piece[a:b], add_special_tokens=False), a) for a, b in ((0, lo), (hi, len(piece)))]
    inside = int(counter.of_texts(pa.array([piece[lo:hi]]))[0])
    head = len(parts[0][0].ids)
    ids = [x for e, _ in parts for x in e.ids]
    spans = [(a + at, b + at) for e, at in parts for a, b in e.offsets]
    return ids, spans, [*range(head), *range(head + inside, len(ids) + inside)], len(ids) + inside


def _anchor_rows(pieces: DataFrame, name: str, chunk: int, overlap: int) -> DataFrame:
    """Rows of ``ANCHOR``: each chunk's anchors at its left and right boundary, and one row (boundary -1) with its number of tokens.

    Boundary k lies between chunks k and k + 1; places count from its start."""

    def encode(batches):
        for b in batches:
            for digest, k, n, piece in zip(*(b[c].to_pylist() for c in ("digest", "chunk", "n_chunks", "piece"))):
                ids, spans, places, total = _with_places(piece, name, chunk, overlap) if n > 1 else ([], [], [], len(_loaded(name)[0].encode(piece, add_special_tokens=False).ids))
                rows = [(k, None, 0, 0, 0, 0)]
                if k > 0:
                    rows += [(k - 1, False, a, z, t, places[i]) for a, z, t, i in anchors(piece, ids, spans, 0, overlap)]
                if k + 1 < n:
                    rows += [(k, True, a - chunk, z - chunk, t, places[i]) for a, z, t, i in anchors(piece, ids, spans, chunk, chunk + overlap)]
                where, left, start, stop, token, at = zip(*rows)
                m = len(rows)
                yield pa.record_batch({
                    "digest": pa.array([digest] * m, pa.binary()), "chunk": pa.array(where, pa.int32()), "left": pa.array(left, pa.bool_()), "start": pa.array(start, pa.int64()), "stop": pa.array(stop, pa.int64()),
                    "token": pa.array(token, pa.int64()), "at": pa.array(at, pa.int64()), "n_chunks": pa.array([n] * m, pa.int32()), "n_tokens": pa.array([total] * m, pa.int64()),
                })

    return pieces.mapInArrow(encode, ANCHOR)


def spliced_counts(texts: DataFrame, name: str = TOKENIZER, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(digest, n_tokens, rounds) of distinct long ``texts`` (digest, text): chunks, splices, and wider overlaps where splices fail."""
    done, pending, rounds = None, written(texts, "long_texts"), 0
    while not pending.isEmpty():
        rounds += 1
        rows = written(_anchor_rows(_chunks(pending, chunk, overlap), name, chunk, overlap), "anchors")
        # anchors of both sides, joined by a sum on the way: of each boundary the first is taken
        met = rows.where("left IS NOT NULL").groupBy("digest", "chunk", "start", "stop", "token").agg(
            F.max(F.when(F.col("left"), F.col("at"))).alias("a"), F.max(F.when(~F.col("left"), F.col("at"))).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
        splice = met.groupBy("digest", "chunk").agg(F.min(F.struct("start", "stop", "a", "b")).alias("s"))
        ends = rows.where("left IS NULL").select("digest", F.when(F.col("chunk") + 1 == F.col("n_chunks"), F.col("n_tokens")).otherwise(0).alias("n"), "n_chunks", F.lit(0).alias("found"))
        parts = ends.unionByName(splice.select("digest", (F.col("s.a") - F.col("s.b")).alias("n"), F.lit(0).alias("n_chunks"), F.lit(1).alias("found")))
        counted = parts.groupBy("digest").agg(F.sum("n").alias("n_tokens"), F.sum("found").alias("found"), F.max("n_chunks").alias("n_chunks"))
        counted = written(counted.where("found + 1 = n_chunks").select("digest", "n_tokens", F.lit(rounds).alias("rounds")), "spliced")
        done = counted if done is None else done.unionByName(counted)
        pending = written(pending.join(counted, "digest", "left_anti"), "long_texts")
        overlap *= 4
        chunk = max(chunk, 4 * overlap)
    return done if done is not None else pending.select("digest", F.lit(0).cast("long").alias("n_tokens"), F.lit(0).alias("rounds"))


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, chunk: int = CHUNK, overlap: int = OVERLAP, limit: int = LIMIT) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for each row, as the tokenizer's library counts without special tokens added.

    ``tokenizer`` is a file of the public tokenizers by name, or a path that every executor has. Null texts are empty and have
    no tokens; ids may be null or stand more than once, each row is counted. Equal long texts are encoded once. An empty
    table gives an empty table; columns that aren't named don't matter. Special strings inside texts are one token each.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    counted = written(_whole_counts(d, tokenizer, chunk), "token_counts")
    texts = d.where(F.length("text") > chunk).select(F.unhex(F.sha2("text", 256)).alias("digest"), "text").groupBy("digest").agg(F.first("text").alias("text"))
    long = spliced_counts(texts, tokenizer, chunk, overlap).select("digest", F.col("n_tokens").alias("spliced"))
    out = counted.where("digest IS NULL").select("id", "n_bytes", "n_tokens").unionByName(
        counted.where("digest IS NOT NULL").join(long, "digest").select("id", "n_bytes", F.col("spliced").alias("n_tokens")))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op12_token_counts(spark, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    return token_counts(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
