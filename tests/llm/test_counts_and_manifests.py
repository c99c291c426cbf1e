"""Filter audits, token counts and Merkle manifests against plain Python, on rows of every kind."""

import hashlib
import random
import re
import zlib
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from lectern.llm import filter_audit, merkle, token_counts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, id string, part string, leaf string, digest string"
SIGNS = ["ab", "Cd", "EF", "g#", "h", "i", "é", "🙂"]


def row(i, text, lang="en", source="s", n=1):
    return (i, text, lang, source, n, "x", "y", "z", "w")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = [row(None, None, None, None, None), row(None, "A b"), row(3, None), row(4, ""), row(5, "same text"), row(5, "same text"), row(6, "same text", None), row(2, "same text", ""), row(9, "\t \n"), row(10, "x " * 3000, "de")]
    out += [row(100 + i, " ".join(rng.choice(SIGNS) + str(rng.randrange(rng.choice([3, 400]))) for _ in range(rng.randrange(1, 220))), rng.choice(["en", "en", "fr", None])) for i in range(700)]
    return out + [row(2000 + i, "copy of a text\nof TWO lines", "en") for i in range(300)]


def words(t):
    return [w for w in re.split("[\x20\x09-\x0d]+", t or "") if w]


def test_audit_against_plain_python(spark, rows):
    labels = [(r[0], i % 2, i % 5 == 0 and 1 or None) for i, r in enumerate(rows) if i % 3] + [(None, 1, 1), (5, 1, 1), (5, 0, 0)]
    got = filter_audit.filter_audit(spark.createDataFrame(rows, SCHEMA).repartition(5), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    marked = lambda k: {x[0] for x in labels if x[0] is not None and x[k] == 1}
    good, toxic = marked(1), marked(2)
    least, docs, want = {}, [], {}
    for r in rows:
        if r[0] is not None:
            least[r[1] or ""] = min(least.get(r[1] or "", r[0]), r[0])
    for r in rows:
        t, w = r[1] or "", words(r[1])
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": r[0] is not None and r[0] > least[t]}
        docs.append((r[2] or "", {k for k, v in fails.items() if v}, r[0]))
    for part in {d[0] for d in docs}:
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            for i, x in enumerate(order):
                mine = [d for d in docs if d[0] == part]
                gone = [d for d in mine if d[1] & set(order[:i])]
                here = [d for d in mine if x in d[1] and not d[1] & set(order[:i])]
                shapley[x] += len(here)
                want[part, "".join(order), i + 1] = [len(mine) - len(gone) - len(here), len(here), sum(x in d[1] for d in gone), sum(d[1] == {x} for d in mine), sum(d[2] in good for d in here), sum(d[2] in toxic for d in here)]
        for (p, order, step), v in want.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    assert {(r.part, r.filter_order, r.step): [r[c] for c in filter_audit.OUTCOMES] for r in got.collect()} == want
    assert filter_audit.filter_audit(spark.createDataFrame([], SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0


def test_audit_of_other_filters_without_repeats(spark):
    docs = spark.createDataFrame([(1, "a", "en"), (2, "a", "en"), (3, "b", "en")], "doc_id long, text string, lang string")
    d = filter_audit.filter_audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"), filters=lambda t: {"x": t == "a", "y": t < "c"}, repeats=None)
    assert sorted((r.filter_order, r.step, r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in d.collect()) == [("xy", 1, 1, 2, 0, 0, 2), ("xy", 2, 0, 1, 2, 1, 4), ("yx", 1, 0, 3, 0, 1, 4), ("yx", 2, 0, 0, 2, 0, 2)]


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes):
    """Root, and for each node its siblings, level by level."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for i in range(len(nodes)):
            a = at[i] // 8 * 8
            paths[i].append((level[a:at[i]], level[at[i] + 1:a + 8]))
            at[i] //= 8
        level = [H(*level[i:i + 8]) for i in range(0, len(level), 8)]
    return level[0] if level else None, paths


def manifest(rows):
    leaf = lambda r, t: H(*map(field, (r[0], r[3], r[2], r[4], t)))
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = {g: sorted((r for r in rows if r[2] == g), key=lambda r: (r[0] is not None, r[0], leaf(r, r[1]))) for g in langs}
    trees = {g: tree([leaf(r, r[1]) for r in d]) for g, d in groups.items()}
    root, tops = tree([trees[g][0] for g in langs])
    for g, top in zip(langs, tops):
        for r, path in zip(groups[g], trees[g][1]):
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None
            f = leaf(r, r[1].translate(low) if bad else r[1])
            for a, b in path + top:
                f = H(*a, f, *b)
            yield r[0], leaf(r, r[1]), trees[g][0], root, H(*[x for a, b in path + top for x in a + b]), f, f == root


@pytest.mark.parametrize("n", [0, 1, 2, 9, 30, 1010])
def test_manifest_against_plain_python(spark, rows, n, tmp_path):
    spark.createDataFrame(rows[:n], SCHEMA).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in merkle.op13_merkle_manifest(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(manifest(rows[:n]), key=repr) and (n < 1000 or {x[-1] for x in got} == {True, False})


def test_manifest_of_many_groups_and_of_other_columns(spark):
    d = spark.createDataFrame([(i, f"g{i % 700}", "v") for i in range(1500)], "k int, g string, v string")
    m = merkle.merkle_manifest(d, "k", ["v", "k"], "g", {"same": F.col("v")}).cache()
    assert m.count() == 1500 and m.select("subroot").distinct().count() == 700 and m.select("root").distinct().count() == 1
    assert m.where(merkle.folded(F.col("leaf"), F.col("path")) != F.col("root")).isEmpty() and m.where("same <> 'v'").isEmpty()


KINDS = {
    "words": ["the", "Haus's", "can't", "12345", "...'s", "naïve", "<|endoftext|>", "<|EndOfText|>", "点云检索", "étude", "🙂🙃", "--", "don't've", " ", "\n", " "],
    "letters": list("abcdefgehtin"), "one": ["a"], "marks": list("̧̣́ͅ"), "hangul": list("각"), "ideographs": [chr(0x4e00 + i) for i in range(200)],
    "signs": list(".,'!s<|>-"), "special": ["<|endoftext|>", "<|", "|>", "endoftext", "<|start<|endoftext|>"], "people": list("🙂👩🏽‍💻"), "blanks": [" ", "\t"],
}


def long_texts(rng, size):
    out = {k: "a" + "".join(rng.choice(v) + (" " if k == "words" else "") for _ in range(size)) for k, v in KINDS.items()}
    out["mixed"] = "".join("".join(rng.choice(KINDS[k]) for _ in range(30)) for k in (rng.choice(list(KINDS)) for _ in range(size // 15)))
    return out


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_counts.tokenizer_path(token_counts.TOKENIZER))


@pytest.mark.parametrize("chunk, overlap", [(100, 20), (64, 40), (300, 64)])
def test_spliced_counts_are_those_of_whole_texts(spark, tokenizer, chunk, overlap):
    texts = [t for seed in range(3) for t in long_texts(random.Random(seed), 500).values()] + [None, "", "<|endoftext|>", "short one"]
    d = spark.createDataFrame([(i % 5 or None, t, "x") for i, t in enumerate(texts * 2)], "doc_id long, text string, digest string").repartition(3)
    got = token_counts.token_counts(d, chunk=chunk, overlap=overlap).collect()
    n = lambda t: len(tokenizer.encode(t or "", add_special_tokens=False).ids)
    assert sorted(((r.id, r.n_bytes, r.n_tokens, r.over_limit) for r in got), key=repr) == sorted(((i % 5 or None, len((t or "").encode()), n(t), n(t) > 2048) for i, t in enumerate(texts * 2)), key=repr)


def test_overlaps_widen_until_chunks_meet(spark, tokenizer):
    texts = {k: t for k, t in long_texts(random.Random(7), 400).items() if k in ("words", "blanks", "marks")}
    d = spark.createDataFrame([(F_sha(t), t) for t in texts.values()], "digest binary, text string")
    rounds = {r.digest.hex(): (r.rounds, r.n_tokens) for r in token_counts.spliced_counts(d, chunk=100, overlap=30).collect()}
    got = {k: rounds[hashlib.sha256(t.encode()).hexdigest()] for k, t in texts.items()}
    assert {k: n for k, (_, n) in got.items()} == {k: len(tokenizer.encode(t, add_special_tokens=False).ids) for k, t in texts.items()}
    assert got["words"][0] <= 2 and got["marks"][0] > 1 and got["blanks"][0] > 1


def F_sha(t):
    return bytearray(hashlib.sha256(t.encode()).digest())


def test_a_text_of_a_million_characters(spark, tokenizer):
    text = " ".join(long_texts(random.Random(9), 4000)["words"] for _ in range(40))[:1_200_000] + "Z" * 90_000
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert token_counts.token_counts(d).first().n_tokens == len(tokenizer.encode(text, add_special_tokens=False).ids)


def test_counts_of_documents_and_of_none(spark, tokenizer):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r.doc_id: r.n_tokens for r in token_counts.op12_token_counts(spark, sf).collect()} == {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) for i, t in texts.items()}
    assert token_counts.token_counts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_other_kinds_of_tokenizers_are_refused():
    assert token_counts._spliceable(token_counts.tokenizer_path("word_bpe_49k.json")) and not token_counts._spliceable(token_counts.tokenizer_path("byte_bpe_50k.json"))
