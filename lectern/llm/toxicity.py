"""Toxicity: gradient-boosted trees over dense text features, calibrated by isotonic regression.

Lexicon densities come from two lexicons: a fixed list, and words and word beginnings learned from labelled rows, with
the log of how much oftener they stand in toxic texts as weight. For rows that the trees are fitted on, the weights are
those of the other folds, so that trees don't see a word's weight which the row itself has raised. Other features are
hits near a second-person word, capitals, punctuation and its bursts, words that signs disguise, digits and lengths.
Texts are cut and counted in Arrow batches with numpy, whole. Trees are fitted on four of five of the labelled rows (by
a hash of the id), the calibration on the rest. Fitting takes at most about ``fit_rows`` labelled rows, chosen by a hash
of the id, and a lexicon of at most ``LEXICON_SIZE`` entries; all other steps cover all rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .blocks import U
from .shared import table, written

# Common insults of four languages, and second-person words.
LEXICON = (
    "asshole bastard bitch clown coward cretin crap damn disgusting dumb dumbass fool filth filthy garbage hate idiot idiots "
    "imbecile jerk kill liar loser losers moron morons nasty pathetic pig rat scum shit slut stupid sucker trash ugly vermin "
    "vile worthless "
    "abschaum arschloch bloed dreck dumm dummkopf idioten lügner mistkerl schwein scheiße versager widerlich wertlos "
    "abruti connard crétin débile dégoûtant imbécile merde minable ordure pourriture salaud stupide "
    "asqueroso basura cabrón escoria estúpido gilipollas idiota inútil mierda patético perdedor tonto"
).split()
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine ihr euch sie tu toi te ton ta vous votre tú ti tus usted ustedes".split()
# Signs that stand for letters in obfuscated words.
SIGNS, LETTERS = b"013457@$!", b"oieastasi"

#: Entries of the learned lexicon, the folds that its weights are crossed over, and the bytes of word beginnings.
LEXICON_SIZE, FOLDS, BEGINNINGS = 50_000, 4, (4, 5, 6)
LEAST_DOCS, LEAST_TIMES = 3, 4.0
#: Bytes of text that are taken at once.
PIECE = 1_000_000
FEATURES = (
    "fixed", "learned", "learned_sum", "learned_max", "begun", "begun_sum", "begun_max", "near", "second", "capitals", "shouted", "punctuation", "bursts",
    "obfuscated", "digits", "words", "word_length",
)
_ALPHA, _SIGN, _LOOSE, _PUNCT, _DIGIT, _LOUD, _UPPER, _BLANK = (1 << i for i in range(8))


def _classes() -> np.ndarray:
    c = np.zeros(256, np.uint8)
    c[128:] |= _ALPHA
    for x in range(33, 127):
        s = chr(x)
        c[x] |= _ALPHA * s.isalpha() | _UPPER * s.isupper() | _DIGIT * s.isdigit() | _PUNCT * (not s.isalnum()) | _SIGN * (x in SIGNS) | _LOOSE * (s in ".*_-") | _LOUD * (s in "!?*#$%&")
    c[[32, *range(9, 14)]] |= _BLANK
    return c


_CLASS = _classes()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, np.uint8)
_LETTER[np.frombuffer(SIGNS, np.uint8)] = np.frombuffer(LETTERS, np.uint8)


class Marks:
    """The letters-only words of a column of texts, with disguises undone, and counts of signs by text."""

    def __init__(self, column: pa.ChunkedArray | pa.Array):
        w = B.Words(column)
        self.n = n = len(w.counts)
        # a blank after each text and two more around all, so that neighbours are of the same text
        raw = np.full(len(w.raw) + n + 4, 32, np.uint8)
        at = w.offsets + np.arange(n + 1) + 2
        if len(w.raw):
            mine = np.ones(len(raw), bool)
            mine[[0, 1, -1, -2]] = False
            mine[at[1:] - 1] = False
            raw[mine] = w.raw
        low, c = _LOWER[raw], _CLASS[raw]

        def per_text(places: np.ndarray) -> np.ndarray:
            return np.diff(np.searchsorted(places, at)).astype(float)

        wide = np.flatnonzero(raw == 0xC3) + 1  # capitals of Latin-1
        wide = wide[(raw[wide] >= 0x80) & (raw[wide] <= 0x9E)]
        low[wide] += 32
        c[wide] |= _UPPER
        upper = np.flatnonzero(c & _UPPER)
        self.chars = np.maximum(np.diff(w.offsets) - per_text(np.flatnonzero((raw & 0xC0) == 0x80)), 1)
        self.capitals, self.digits, self.punctuation = per_text(upper), per_text(np.flatnonzero(c & _DIGIT)), per_text(np.flatnonzero(c & _PUNCT))
        loud = np.flatnonzero(c & _LOUD)
        self.bursts = per_text(loud[(c[loud - 1] & _LOUD > 0) & (c[loud - 2] & _LOUD == 0)])
        size = w.ends - w.starts
        text = w.text_of_word()
        shift = text + 2
        shout = (np.searchsorted(upper, w.ends + shift) - np.searchsorted(upper, w.starts + shift)) >= 0.7 * size
        self.shouted = np.bincount(text, weights=shout & (size > 2), minlength=n)
        self.words = w.counts.astype(float)
        # a sign is a letter inside a word, or before it
        i = np.flatnonzero(c & _SIGN)
        b, a = c[i - 1], c[i + 1]
        body = _ALPHA | _SIGN
        solid = i[(a & body > 0) & ((b & body > 0) | (b & _BLANK > 0)) & ((a & _ALPHA > 0) | (b & _ALPHA > 0) | ((a & _SIGN > 0) & (b & _SIGN > 0)))]
        # . * _ - between single letters are nothing
        i = np.flatnonzero(c & _LOOSE)
        two = c[i - 2], c[np.minimum(i + 2, len(c) - 1)]
        apart = i[(c[i - 1] & c[i + 1] & _ALPHA > 0) & (two[0] & (_LOOSE | _BLANK) > 0) & (two[1] & (_LOOSE | _BLANK | _PUNCT) > 0) & ((two[0] | two[1]) & _LOOSE > 0)]
        low[solid] = _LETTER[low[solid]]
        letter = c & _ALPHA > 0
        letter[solid] = True
        plain = low
        if len(apart):
            keep = np.ones(len(low), bool)
            keep[apart] = False
            plain, letter = low[keep], letter[keep]
        turn = np.flatnonzero(letter[1:] != letter[:-1]) + 1
        self.plain, self.starts, self.ends = plain, turn[::2], turn[1::2]
        gone = np.searchsorted(apart, at)
        self.of = np.searchsorted(at - gone, self.starts, "right") - 1
        signs = np.sort(np.concatenate([solid - np.searchsorted(apart, solid), apart - np.arange(len(apart))]))
        self.disguised = np.searchsorted(signs, self.ends) > np.searchsorted(signs, self.starts)
        self.hash, self._prefix = B.span_hashes(plain, self.starts, self.ends), {}

    def beginnings(self, size: int) -> np.ndarray:
        """Hashes of the first ``size`` bytes of the words; 0 for shorter words."""
        if size not in self._prefix:
            long = self.ends - self.starts > size
            h = np.zeros(len(self.starts), U)
            h[long] = B.mix(B.span_hashes(self.plain, self.starts[long], self.starts[long] + size), size)
            self._prefix[size] = h
        return self._prefix[size]


def _hashes(words) -> np.ndarray:
    m = Marks(pa.array(list(words), pa.large_string()))
    return np.unique(m.hash)


def _among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h


def features_of(m: Marks, keys: np.ndarray, weights: np.ndarray, part: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """FEATURES of each text. ``keys`` are sorted; ``weights`` is [key], or [fold, key] with each text's fold in ``part``."""
    n = np.maximum(np.bincount(m.of, minlength=m.n), 1).astype(float)

    def weight(h: np.ndarray) -> np.ndarray:
        if not len(keys) or not len(h):
            return np.zeros(len(h))
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return np.where((keys[at] == h) & (h != 0), weights[at] if part is None else weights[part[m.of], at], 0.0)

    def total(x: np.ndarray) -> np.ndarray:
        return np.bincount(m.of, weights=x, minlength=m.n)

    def top(x: np.ndarray) -> np.ndarray:
        out = np.zeros(m.n)
        np.maximum.at(out, m.of, x)
        return out

    fixed = _among(m.hash, _FIXED)
    word, begun = weight(m.hash), np.max([weight(m.beginnings(s)) for s in BEGINNINGS], 0)
    second = _among(m.hash, _SECOND)
    hit = fixed | (word > 1) | (begun > 2)
    # a second-person word at most four words away in the same text
    seen = np.concatenate([[0], np.cumsum(second)])
    first = np.searchsorted(m.of, m.of)
    last = np.searchsorted(m.of, m.of, "right")
    at = np.arange(len(m.of))
    near = hit & (seen[np.minimum(at + 5, last)] > seen[np.maximum(at - 4, first)])
    return {
        "fixed": total(fixed) / n, "learned": total(word) / n, "learned_sum": np.log1p(total(word)), "learned_max": top(word), "begun": total(begun) / n,
        "begun_sum": np.log1p(total(begun)), "begun_max": top(begun), "near": total(near) / n, "second": total(second) / n, "capitals": m.capitals / m.chars,
        "shouted": m.shouted / np.maximum(m.words, 1), "punctuation": m.punctuation / m.chars, "bursts": m.bursts / n, "obfuscated": total(m.disguised) / n,
        "digits": m.digits / m.chars, "words": np.log1p(m.words), "word_length": m.chars / np.maximum(m.words, 1),
    }


_FIXED, _SECOND = _hashes(LEXICON), _hashes(SECOND_PERSON)


def fold(id_: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; 0 for null."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % n, F.lit(0)).cast("int")


class LearnedLexicon:
    """Words and beginnings that stand oftener in toxic texts, with a weight for all rows and one for each fold left out.

    Document counts are summed by Spark; what reaches the driver is at most LEXICON_SIZE entries of 2 FOLDS counts.
    """

    def __init__(self, rows: DataFrame):
        """``rows``: text, label (0 or 1), part (0 to FOLDS - 1)."""
        names = [f"{k}{i}" for k in ("t", "c") for i in range(FOLDS)]

        def count(batches):
            for b in (x for batch in batches for x in B.pieces(batch, "text", PIECE)):
                m = Marks(b["text"])
                slot = np.where(b["label"].to_numpy(zero_copy_only=False) > 0, 0, FOLDS) + b["part"].to_numpy(zero_copy_only=False)
                h, of = np.concatenate([m.hash, *(m.beginnings(s) for s in BEGINNINGS)]), np.tile(m.of, 1 + len(BEGINNINGS))
                h, of = h[h != 0], of[h != 0]
                _, one = np.unique(h ^ B.mix(of.astype(U), 9), return_index=True)  # once a text
                keys, index = np.unique(h[one], return_inverse=True)
                n = np.zeros((len(keys), 2 * FOLDS), np.int64)
                np.add.at(n, (index, slot[of[one]]), 1)
                yield pa.record_batch({"key": keys.view(np.int64)} | {c: n[:, i] for i, c in enumerate(names)})

        many = rows.groupBy("label", "part").agg(F.count(F.lit(1)).alias("n")).collect()
        size = np.zeros((2, FOLDS))
        for r in many:
            size[0 if r["label"] > 0 else 1, r["part"]] = r["n"]
        counts = rows.select("text", "label", "part").mapInArrow(count, "key long, " + ", ".join(f"{c} long" for c in names)).groupBy("key").agg(*[F.sum(c).alias(c) for c in names])
        t, c = (sum((F.col(f"{k}{i}") for i in range(1, FOLDS)), F.col(f"{k}0")) for k in ("t", "c"))
        share = F.log((t + 0.5) / F.lit(size[0].sum() + 1.0)) - F.log((c + 0.5) / F.lit(size[1].sum() + 1.0))
        best = counts.withColumn("w", t * share).where((t >= LEAST_DOCS) & (share >= float(np.log(LEAST_TIMES))))
        found = best.orderBy(F.desc("w"), "key").limit(LEXICON_SIZE).toPandas()
        keys = found["key"].to_numpy(np.int64).view(U)
        order = np.argsort(keys)
        n = found[names].to_numpy(np.float64)[order].reshape(-1, 2, FOLDS)
        self.keys = keys[order]
        self.whole = self._weights(n.sum(2), size.sum(1))
        self.crossed = np.stack([self._weights(n.sum(2) - n[:, :, i], size.sum(1) - size[:, i]) for i in range(FOLDS)]) if len(keys) else np.zeros((FOLDS, 0))

    @staticmethod
    def _weights(n: np.ndarray, size: np.ndarray) -> np.ndarray:
        w = np.log((n[:, 0] + 0.5) / (size[0] + 1)) - np.log((n[:, 1] + 0.5) / (size[1] + 1))
        return np.where((n[:, 0] >= LEAST_DOCS) & (w >= np.log(LEAST_TIMES)), np.minimum(w, 6.0), 0.0).astype(np.float32)


def featured(rows: DataFrame, lexicon: LearnedLexicon, keep: str) -> DataFrame:
    """Columns ``keep`` (a schema) and FEATURES of ``rows.text``; of a row with ``part``, under the weights without it."""
    keys, whole, crossed = lexicon.keys, lexicon.whole, lexicon.crossed
    names = [x.split()[0] for x in keep.split(", ")]

    def make(batches):
        for b in (x for batch in batches for x in B.pieces(batch, "text", PIECE)):
            m = Marks(b["text"])
            out = features_of(m, keys, crossed, b["part"].to_numpy(zero_copy_only=False)) if "part" in names else features_of(m, keys, whole)
            yield pa.record_batch({k: b[k] for k in names} | {k: out[k] for k in FEATURES})

    return rows.select(*names, "text").mapInArrow(make, keep + ", " + ", ".join(f"{k} double" for k in FEATURES))


class ToxicityModel:
    """Lexicon, trees and calibration; a constant where labels hold one class or none."""

    def __init__(self, rows: DataFrame, trees: int = 12, depth: int = 4, seed: int = 7):
        """``rows``: id, text, label."""
        part = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(FOLDS)).cast("int")
        rows = written(rows.select("id", F.coalesce("text", F.lit("")).alias("text"), F.col("label").cast("int").alias("label"), part.alias("part")), "labelled")
        n, mean = rows.agg(F.count(F.lit(1)), F.avg("label")).first()
        self.constant, self.trees = float(mean or 0.0), None
        if not n or mean in (0.0, 1.0):
            return
        self.lexicon = LearnedLexicon(rows)
        self.assemble = VectorAssembler(inputCols=list(FEATURES), outputCol="__vector")
        data = written(featured(rows, self.lexicon, "id long, label int, part int"), "fitted")
        data = self.assemble.transform(data.withColumn("__part", F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(5)))).select("__part", "__vector", F.col("label").cast("double").alias("label"))
        fit, rest = data.where("__part > 0"), data.where("__part = 0")
        if fit.agg(F.countDistinct("label")).first()[0] < 2 or rest.agg(F.countDistinct("label")).first()[0] < 2:
            fit = rest = data  # too few labels to keep some apart
        self.trees = GBTClassifier(featuresCol="__vector", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=0.3, seed=seed).fit(fit)
        self.steps = IsotonicRegression(featuresCol="__x", labelCol="label", predictionCol="score").fit(self._raw(rest))

    def _raw(self, d: DataFrame) -> DataFrame:
        return self.trees.transform(d).withColumn("__x", vector_to_array("probability")[1])

    def score(self, rows: DataFrame, keep: str) -> DataFrame:
        """Columns ``keep`` (a schema) of ``rows`` with ``score`` in 0 to 1, from ``rows.text``."""
        names = [x.split()[0] for x in keep.split(", ")]
        if self.trees is None:
            return rows.select(*names, F.lit(self.constant).alias("score"))
        out = self.steps.transform(self._raw(self.assemble.transform(featured(rows, self.lexicon, keep))))
        # calibration is a step function; a thousandth of the trees' own score keeps the order inside a step
        calm = F.least(F.greatest(F.col("score"), F.lit(0.0)), F.lit(1.0))
        return out.select(*names, (calm * 0.999 + F.col("__x") * 0.001).alias("score"))


def toxicity_scores(docs: DataFrame, labels: DataFrame, holdout: int = 5, fit_rows: int = 50_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, mark, held_out, score, predicted): one row for each row of ``docs``; ``mark`` is a hash of the text.

    Learns from ``labels`` (doc_id, toxic) whose id is not in fold 0 of ``holdout``, at most about ``fit_rows`` of them.
    Null and empty texts are scored by their features, all zero. Null labels and labels other than 0 and 1 don't
    count; repeated labels count as one, the largest. A null id is held out. Equal rows get equal scores. Without
    labels of both classes the score is the share of label 1, or 0. Texts are read whole. An empty table gives an
    empty table; other columns don't matter.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("mark"), text.alias("text"))
    rows = rows.withColumn("held_out", fold(F.col("id"), holdout) == 0)
    known = labels.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.when(F.col("toxic").isin(0, 1), F.col("toxic"))).alias("label")).where("label is not null")
    n = known.count()
    if n > fit_rows:
        known = known.where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1_000_000)) < fit_rows * 1_000_000 // n)
    # at most about fit_rows ids and labels, so they go to the texts, and no text is shuffled
    model = ToxicityModel(rows.where("not held_out").join(F.broadcast(known), "id"))
    return model.score(rows, "id long, mark long, held_out boolean").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are predicted not toxic, columns as they were.

    Rows with null id or null text are judged like others (a null text has no words and stays unless a model of one
    class says all is toxic). Equal rows go or stay together. Of rows with one id, each is judged by its own text. An
    empty table stays empty. Columns of any name pass through.
    """
    bad = toxicity_scores(docs, labels).where("predicted = 1").select("id", "mark").distinct()
    on = docs["doc_id"].cast("long").eqNullSafe(bad["id"]) & (F.xxhash64(docs["text"].cast("string")) == bad["mark"])
    return docs.join(bad, on, "left_anti")


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    """Calibrated toxicity of all documents."""
    out = toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select(F.col("id").alias("doc_id"), "held_out", "score", "predicted")
