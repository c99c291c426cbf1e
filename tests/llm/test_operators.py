"""The dealt operators against brute force, on awkward rows and on the small tables."""

import base64
import hashlib
import math
import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.llm import decontaminate, packing, ppm, topk, toxicity, warc
from lectern.llm import blocks as B
from lectern.llm import registry
from lectern.llm.jaccard_join import jaccard_components, near_duplicates_dropped
from lectern.llm.kd_sharding import shard_documents
from lectern.llm.line_dedup import drop_repeated_lines
from lectern.llm.substring_dedup import remove_repeated_passages
from tests.test_catalog import SF, same

AWKWARD = [(1, "one two three four five six"), (2, None), (3, ""), (4, "one two three four five six"), (4, "one two three four five six"), (None, "a b"), (5, "word " * 5000), (6, "line\n\nline\n"), (7, "É ünï 😀")]
DOCS = "doc_id long, text string, id string, rank int, block string"


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in AWKWARD], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL, key=lambda x: int(x[2:].split("_")[0])))
def test_query_agrees_with_sql(spark, name):
    same(spark, name, registry.QUERIES, registry.ORACLE_SQL)


LABELS, BENCH = [(1, 1), (4, 0), (5, None)], [(1, "one two three four five six"), (2, None), (3, "")]


@pytest.fixture(scope="module")
def side(spark):
    return spark.createDataFrame(LABELS, "doc_id long, toxic int"), spark.createDataFrame(BENCH, "item_id long, text string")


def rows_of(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def test_awkward_documents_in_each_operator(spark, awkward, side):
    words = lambda t: len((t or "").split())
    keep = lambda t, n: hashlib.sha256((" ".join((t or "").split()) if not n else "").encode()).hexdigest()
    removed = [5000 if words(t) == 5000 else 0 for _, t in AWKWARD]
    d = remove_repeated_passages(awkward, 35).withColumn("sha", F.sha2("kept", 256))
    assert rows_of(d, "id", "n_words", "n_removed", "sha") == sorted(((i, words(t), n, keep(t, n)) for (i, t), n in zip(AWKWARD, removed)), key=repr)
    size = lambda t: len((t or "").encode())
    d = shard_documents(awkward, 3)
    assert rows_of(d, "id", "size", "text_crc32") == sorted(((i, size(t) + 1, zlib.crc32((t or "").encode())) for i, t in AWKWARD), key=repr)
    assert rows_of(d.groupBy("shard").agg(F.max("slot").alias("m"), (F.count(F.lit(1)) - 1).alias("n")).where("m <> n"), "m") == []
    d = ppm.lm_scores(awkward)
    assert rows_of(d, "id", "held_out", "n_tokens") == sorted(((i, i is not None and zlib.crc32(str(i).encode()) % 7 == 2, words(t) + 1) for i, t in AWKWARD), key=repr)
    assert len({r.score for r in d.where("id = 4 or id = 1").collect()}) == 1
    d = drop_repeated_lines(awkward.withColumn("n_lines", F.lit("mine")), counts=False)
    assert rows_of(d, "doc_id", "text", "id", "n_lines") == sorted(((i, t, "x", "mine") for i, t in AWKWARD), key=repr)
    group = {1: 1, 4: 1}
    d = jaccard_components(awkward)
    assert rows_of(d, "id", "n_shingles", "component_id") == sorted(((i, {"one two three four five six": 2, "line\n\nline\n": 1, "a b": 1}.get(t, 0 if not words(t) else 1), group.get(i, i)) for i, t in AWKWARD), key=repr)
    assert rows_of(near_duplicates_dropped(awkward), "doc_id", "id", "rank") == sorted(((i, "x", 1) for i, t in AWKWARD if i != 4), key=repr)
    d = decontaminate.benchmark_leaks(awkward, side[1])
    assert rows_of(d, "id", "item_ids") == sorted(((i, [1] if i in (1, 4) else []) for i, _ in AWKWARD), key=repr)
    assert rows_of(decontaminate.without_leaks(awkward, side[1]), "doc_id", "block") == sorted(((i, "y") for i, _ in AWKWARD if i not in (1, 4)), key=repr)
    d = packing.packed(awkward)
    assert rows_of(d, "id", "n_tokens", "padding") == sorted(((i, words(t) + 1, 0) for i, t in AWKWARD), key=repr)
    d = toxicity.toxicity_scores(awkward, side[0])
    assert rows_of(d, "id", "held_out") == sorted(((i, i is None or zlib.crc32(str(i).encode()) % 5 == 0) for i, _ in AWKWARD), key=repr)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in d.collect()) and len({r.score for r in d.where("id = 1 or id = 4").collect()}) == 1
    assert toxicity.without_toxic(awkward, side[0]).columns == awkward.columns


def test_empty_documents_in_each_operator(spark, empty, side):
    for f in (
        lambda d: toxicity.toxicity_scores(d, side[0]), lambda d: toxicity.without_toxic(d, side[0]), ppm.lm_scores, lambda d: shard_documents(d, 3), drop_repeated_lines, jaccard_components,
        near_duplicates_dropped, lambda d: decontaminate.benchmark_leaks(d, side[1]), lambda d: decontaminate.without_leaks(d, side[1]), packing.packed, remove_repeated_passages,
    ):
        assert f(empty).count() == 0


def test_unlike_long_words_of_one_structure_are_unlike(spark):
    a = "a"
    for _ in range(11):
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    fill = " ".join(f"f{i}" for i in range(20))
    docs = spark.createDataFrame([(0, f"{a} {fill}"), (1, f"{b} {fill}"), (2, a), (3, b)], "doc_id long, text string")
    assert rows_of(remove_repeated_passages(docs, 5), "id", "n_removed") == [(0, 20), (1, 20), (2, 0), (3, 0)]
    assert rows_of(jaccard_components(docs), "id", "component_id") == [(0, 0), (1, 0 if 15 * 100 >= 75 * 17 else 1), (2, 2), (3, 3)]
    known = {r.id: r.n_known for r in ppm.lm_scores(docs.where("doc_id > 1"), folds=10 ** 9, held=zlib.crc32(b"3") % 10 ** 9).collect()}
    assert known == {2: 2, 3: 1}


def test_items_in_several_blocks_leak_as_in_one(spark, monkeypatch):
    rng = np.random.default_rng(2)
    items = [(i, " ".join(f"w{x}" for x in rng.integers(0, 200, 12))) for i in range(9)]
    docs = [(i, " ".join(f"w{x}" for x in rng.integers(0, 200, 40)) + " " + items[i % 9][1] * (i % 3 > 0)) for i in range(30)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = rows_of(decontaminate.benchmark_leaks(d, b), "id", "item_ids")
    monkeypatch.setattr(decontaminate, "ITEM_ROWS", 4)
    assert rows_of(decontaminate.benchmark_leaks(d, b), "id", "item_ids") == whole and sum(map(len, (x for _, x in whole))) >= 20


def test_features_of_toxicity_by_hand():
    text = "You are an 1d10t! i.d.i.o.t, STUPID 42 well-known"
    m = toxicity.Marks(pa.array([text, "", None, "idiot", "you"]))
    words = [bytes(m.plain[a:b]).decode() for a, b in zip(m.starts, m.ends)]
    assert words == ["you", "are", "an", "idiot", "idiot", "stupid", "well", "known", "idiot", "you"] and m.of.tolist() == [0] * 8 + [3, 4]
    assert m.disguised.tolist() == [False, False, False, True, True] + [False] * 5
    f = toxicity.features_of(m, np.zeros(0, np.uint64), np.zeros(0))
    assert f["fixed"].tolist() == [3 / 8, 0, 0, 1, 0] and f["near"].tolist() == [2 / 8, 0, 0, 0, 0] and f["second"].tolist() == [1 / 8, 0, 0, 0, 1]
    assert f["capitals"][0] == 7 / len(text) and f["digits"][0] == 5 / len(text) and f["words"].tolist() == [math.log1p(n) for n in (8, 0, 0, 1, 1)]
    keys = np.unique(toxicity._hashes(["stupid", "known"]))
    crossed = np.array([[1.0, 1.0], [0.0, 0.0]])
    assert toxicity.features_of(m, keys, crossed, np.array([0, 0, 0, 0, 0]))["learned"][0] == 2 / 8 and toxicity.features_of(m, keys, crossed, np.array([1, 0, 0, 0, 0]))["learned"][0] == 0


def test_toxicity_without_both_classes_is_a_constant(spark, awkward):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.toxicity_scores(awkward, none).collect()} == {0.0}


def test_toxicity_holds_on_rows_kept_apart(spark):
    r = registry.QUERIES["op3_toxicity"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").collect()
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in r)
    assert np.mean([x.predicted == x.toxic for x in r]) > 0.9
    pos, neg = [x.score for x in r if x.toxic == 1], [x.score for x in r if x.toxic == 0]
    assert np.mean([(p > n) + (p == n) / 2 for p in pos for n in neg]) > 0.85


def brute_ppm(train: list[bytes], text: bytes) -> float:
    """One byte at a time, from counts in dictionaries and sets of excluded bytes."""
    counts: dict = {}
    for t in train:
        padded = b"\n" * 4 + t
        for i in range(4, len(padded)):
            for k in range(5):
                c = counts.setdefault(padded[i - k:i], {})
                c[padded[i]] = c.get(padded[i], 0) + 1
    total, padded = 0.0, b"\n" * 4 + text
    for i in range(4, len(padded)):
        gone, s = set(), padded[i]
        for k in range(4, -1, -1):
            c = {b: n for b, n in counts.get(padded[i - k:i], {}).items() if b not in gone}
            if not c:
                continue
            escapes = 0 if k == 0 and len(counts[b""]) == 256 else len(c)
            if s in c:
                total += math.log10(c[s] / (sum(c.values()) + escapes))
                break
            total += math.log10(escapes / (sum(c.values()) + escapes))
            gone |= set(c)
        else:
            total -= math.log10(256 - len(gone))
    return total


def test_ppm_against_brute_force(spark):
    texts = {i: t for i, t in enumerate(["the cat sat", "The hat", "", None, "a cat  and\ta hat", "zzz ü", "the cat the cat"] * 3)}
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    tokens = {i: (t or "").lower().split() for i, t in texts.items()}
    coded = {i: " ".join(w).encode() + b"\n" for i, w in tokens.items()}
    train = [i for i in texts if not held(i)]
    assert len(train) < len(texts)
    count: dict = {}
    for i in train:
        for w in [*tokens[i], "\n"]:
            count[w] = count.get(w, 0) + 1
    n = sum(count.values())
    rows = ppm.lm_scores(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        every = [*tokens[r.id], "\n"]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.id), len(every), sum(w in count for w in every), n)
        assert r.base_score == pytest.approx(sum(math.log10((count.get(w, 0) + 1) / (n + len(count) + 1)) for w in every), abs=1e-9)
        assert r.score == pytest.approx(brute_ppm([coded[i] for i in train], coded[r.id]), rel=1e-5, abs=1e-5)


def test_ppm_probabilities_sum_to_one():
    train = np.frombuffer(b"abracadabra\n", np.uint8)
    strings = [int.from_bytes((b"\n" * 4 + train.tobytes())[i:i + 5], "big") for i in range(len(train))]
    low = np.zeros((256, 256))
    for s in strings:
        low[(s >> 8) & 255, s & 255] += 1
    ctx = int.from_bytes(b"cabr", "big")
    every = np.array([ctx << 8 | b for b in range(256)], np.uint64)
    keys, counts = np.unique(np.array(strings, np.uint64), return_counts=True)
    union = np.union1d(keys, every)
    p = ppm.log_probabilities(union, np.array([dict(zip(keys, counts)).get(k, 0) for k in union]), low)
    assert (10 ** p[np.isin(union, every)]).sum() == pytest.approx(1)


def test_top_k_with_ties_copies_and_bad_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 5) / 8]) for i in range(400)] + [(i, [0.5] * 5) for i in range(400, 3000)]
    bad = [(3000, None), (3001, [1.0, None, 0.0, 0.0, 0.0]), (3002, [float("nan")] * 5), (3003, [float("inf")] * 5), (None, [0.1] * 5)]
    v = topk.whole_vectors(spark.createDataFrame([(i, x, 7, 1) for i, x in rows + bad], "vec_id long, embedding array<float>, score int, part int"))
    got: dict = {}
    for r in topk.top_k(v, v.where("vec_id % 100 = 0"), 10).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    x = {i: np.floor(1024 * np.array(e)).astype(int) for i, e in rows}
    for q in range(0, 3000, 100):
        want = sorted(((i, int(x[q] @ x[i])) for i in x if i != q), key=lambda p: (-p[1], p[0]))[:10]
        assert got[q] == want
    assert topk.top_k(v.limit(0), v.limit(0), 10).count() == 0
    assert topk.top_k(v.where("vec_id < 3"), v.where("vec_id = 0"), 10).count() == 2


@pytest.mark.parametrize("scale", [1.0, 3e5, 2e6, 1e12])
def test_top_k_is_exact_for_large_components_and_repeated_ids(spark, scale):
    rng = np.random.default_rng(9)
    rows = [(i // 2, [float(x) for x in rng.standard_normal(int(rng.integers(2, 5))) * scale]) for i in range(300)]
    rows += [(0, rows[0][1]), (7, rows[5][1])]
    v = topk.whole_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got: dict = {}
    for r in topk.top_k(v, v.where("vec_id % 50 = 0"), 4).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    held = lambda n: max(-(1 << 63), min((1 << 63) - 1, n))
    x = [(i, [int(math.floor(1024 * c)) for c in e]) for i, e in rows]
    want: dict = {}
    for i, q in x:
        if i % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, c)), j) for j, c in x if j != i)[:4]
            want.setdefault(i, []).extend((n, j, held(-s)) for n, (s, j) in enumerate(best, 1))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_near_duplicates_of_copies_in_any_order(spark):
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(60)]
    near = [*base[:-1], "other"]
    texts = {i: " ".join(base if i % 3 else near) for i in range(100, 160)} | {i: f"lone text of {i} with words enough" for i in range(160, 170)}
    first = {k: min(i for i in texts if texts[i] == k) for k in texts.values()}
    want = {i: (first[t], 100 if i < 160 else i) for i, t in texts.items()}
    for order in (sorted(texts, reverse=True), *(rng.permutation(list(texts)).tolist() for _ in range(2))):
        docs = spark.createDataFrame(spark.sparkContext.parallelize([(i, texts[i]) for i in order], 7), "doc_id long, text string")
        got = {r.id: (r.class_id, r.component_id) for r in jaccard_components(docs).collect()}
        assert got == want


@pytest.mark.parametrize("version", [1, 2])
def test_archives_round_trip(spark, version):
    pages = [(1, "http://a/ b", "x\r\n\r\ny\n"), (2, None, "x\r\n\r\ny\n"), (3, "u", None), (4, "u", ""), (5, "u", "é" * 30000), (5, "u", "other"), (None, "u", "z")]
    out = warc.convert_pages(spark.createDataFrame([(*p, "k") for p in pages], "page_id long, url string, html string, key string"), version=version).collect()
    sha = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    want = []
    for k, _, h in pages:
        keys = [p[0] for p in pages if (p[2] or "") == (h or "") and p[0] is not None]
        top = max(keys, default=None)
        want.append((k, len((h or "").encode()), sha(h), "response" if k == top else "revisit", None if k == top else top))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out), key=repr) == sorted(want, key=repr)
    assert len({r.record_id for r in out}) == len(out)
    assert warc.convert_pages(spark.createDataFrame([], "page_id long, url string, html string, kind string")).count() == 0


def test_archive_headers_that_lie_are_errors():
    good = warc.arc_preamble(2) + warc.arc_record(7, "http://a", b"data", 2)
    assert [r["block"][-4:] for r in warc.parse_arc(good)][1:] == [b"data"]
    for bad in (good[:-3], good[len(warc.arc_preamble(2)):], good.replace(b"Archive-length\n", b"Length Archive-length\n", 1)):
        with pytest.raises(ValueError):
            list(warc.parse_arc(bad))


@pytest.mark.parametrize("version", [1, 2])
def test_archives_of_images_and_dns_answers(spark, tmp_path, version):
    extra = "" if version == 1 else "200 - - 0 x.arc "
    image = b"HTTP/1.1 200 OK\r\nContent-Type: image/png\r\n\r\n\x89PNG\xff\xfe\r\n\r\n\x00"
    records = [("http://a/1.png", "20010101000000", image), ("http://a/2.png", "20020101000000", image), ("dns:a", "20010101000000", b"a. 1 IN A 1.2.3.4\n"), ("dns:b", "20010101000000", b"b. 1 IN A 5.6.7.8\n")]
    arc = warc.arc_preamble(version) + b"".join(f"{u} 0.0.0.0 {d} text/x {extra}{len(b)}\n".encode() + b + b"\n" for u, d, b in records)
    found = warc.arc_records(spark.createDataFrame([(arc,), (warc.gzip.compress(arc[:-1]),), (None,)], "content binary"))
    assert found.count() == 10
    one = warc.arc_records(spark.createDataFrame([(arc,)], "content binary"))
    warc.write_warc(one, f"file://{tmp_path}/w")
    out = sorted(((r.record_type, r.url, r.payload_bytes, r.date[:4]) for r in warc.read_warc_rows(spark, f"file://{tmp_path}/w").collect()), key=repr)
    assert out == sorted([("warcinfo", None, None, "2000"), ("revisit", "http://a/1.png", 11, "2001"), ("response", "http://a/2.png", 11, "2002"), ("resource", "dns:a", 18, "2001"), ("resource", "dns:b", 18, "2001")], key=repr)
    assert len({r.record_id for r in warc.read_warc_rows(spark, f"file://{tmp_path}/w").collect()}) == 5


def test_equal_pages_and_equal_archives_have_records_of_their_own(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "x")] * 3 + [(2, "u", "x"), (None, "u", "x")], "page_id long, url string, html string").repartition(5)
    assert pages.rdd.getNumPartitions() == 5
    out = warc.convert_pages(pages)
    assert rows_of(out, "page_id", "record_type", "refers_to") == sorted([(1, "revisit", 2)] * 3 + [(2, "response", None), (None, "revisit", 2)], key=repr)
    assert out.select("record_id").distinct().count() == 5
    archive = warc.arc_preamble() + warc.arc_record(7, "http://a/", b"same") + warc.arc_record(None, "http://b/", b"same")
    twice = warc.written(warc.arc_records(spark.createDataFrame([(bytearray(archive),)] * 2, "content binary").repartition(2)), "twice")
    warc.write_warc(twice, f"file://{tmp_path}/w")
    back = warc.read_warc_rows(spark, f"file://{tmp_path}/w").where("record_type <> 'warcinfo'")
    assert rows_of(back, "page_id", "record_type") == sorted([(7, "response")] * 2 + [(None, "revisit")] * 2, key=repr) and back.select("record_id").distinct().count() == 4


def test_leaks_are_found_and_clean_texts_left(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    got = {r.doc_id: set(r.item_ids) for r in registry.QUERIES["op9_decontamination"](spark, sf).collect()}
    want = {d: {i for i, t in items.items() if x and t in x} for d, x in texts.items()}
    assert got == want


def test_paraphrase_with_its_answer_is_a_leak(spark):
    item = "what is the name of the long river that flows through the old city of bridges answer the silver danube"
    near = "filler text here " * 20 + "tell me the name of the long river which flows through the old city of bridges answer the silver danube" + " more filler" * 30
    far = "the of is that through the old the name answer " * 10
    out = decontaminate.benchmark_leaks(spark.createDataFrame([(1, near), (2, far)], "doc_id long, text string"), spark.createDataFrame([(9, item)], "item_id long, text string"))
    assert {r.id: r.item_ids for r in out.collect()} == {1: [9], 2: []}


def brute_leak(item: list[str], words: list[str]) -> bool:
    """Whether 0.8 of the item, or 0.65 with its last three words, stand in order in one and a half times its length."""
    def longest(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    width = len(item) + (len(item) + 1) // 2
    for i in range(len(words)):
        x = words[i:i + width]
        if sum(w in item for w in x) * 100 >= 65 * len(item):
            share = longest(item, x) / len(item)
            if share >= 0.8 or (share >= 0.65 and longest(item[-3:], x) == len(item[-3:])):
                return True
    return False


def test_leaks_of_any_length_are_found_where_the_fit_is_a_sample(spark):
    rng = np.random.default_rng(21)
    weight = 1 / np.arange(1, 2001)
    draw = lambda n: [f"w{x}" for x in rng.choice(2000, n, p=weight / weight.sum())]
    items = {i: draw(n) for i, n in enumerate([4, 6, 6, 8, 8, 10, 12, 15, 18, 25, 40, 59, 70, 130])}
    docs = {}
    for i, item in items.items():
        for kind in ("verbatim", "fifth", "answer"):
            for _ in range(2):
                x = list(item)
                share, free = {"verbatim": (0, 0), "fifth": (0.2, len(x)), "answer": (0.35, len(x) - 3)}[kind]
                for at in rng.permutation(free)[: int(share * len(x) + 1e-9)]:
                    x[at] = f"new{rng.integers(10 ** 9)}"
                text, at = draw(int(rng.integers(200, 500))), int(rng.integers(0, 200))
                docs[len(docs)] = (i, text[:at] + x + text[at:])
    d = spark.createDataFrame([(k, " ".join(x)) for k, (_, x) in docs.items()], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in items.items()], "item_id long, text string")
    got = {r.id: set(r.item_ids) for r in decontaminate.benchmark_leaks(d, bench, fit_bytes=40_000).collect()}
    for k, (i, x) in docs.items():
        want = {j for j, item in items.items() if brute_leak(item, x)}
        assert i in want and want <= got[k]


def planted_passages(rng, items):
    """(item, words) of documents with an item verbatim, with a fifth of it replaced, or spread over up to three times its length."""
    word = lambda: f"w{rng.integers(1500)}"
    for i, item in items.items():
        for kind in ("verbatim", "fifth", "wide"):
            x = [f"new{rng.integers(10 ** 9)}" if kind == "fifth" and j % 5 == 4 else w for j, w in enumerate(item)]
            x = [y for w in x for y in (w, *[word() for _ in range(int(rng.integers(0, 4)) if kind == "wide" else 0)])]
            at = int(rng.integers(0, 150))
            filler = [word() for _ in range(int(rng.integers(160, 400)))]
            yield kind, i, filler[:at] + x + filler[at:]


def test_the_cosine_proposes_and_the_checks_decide(spark):
    rng = np.random.default_rng(5)
    items = {i: [f"w{x}" for x in rng.integers(0, 1500, n)] for i, n in enumerate([6, 9, 14, 20, 33, 47, 64, 90] * 3)}
    planted = list(planted_passages(rng, items))
    d = spark.createDataFrame([(k, " ".join(x)) for k, (_, _, x) in enumerate(planted)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in items.items()], "item_id long, text string")
    pairs = lambda **how: {(r.id, i) for r in decontaminate.benchmark_leaks(d, bench, fit_bytes=60_000, **how).collect() for i in r.item_ids}
    got, every = pairs(), pairs(cosine=-2.0)
    assert pairs(cosine=2.0) == set()
    assert got <= every and len(got) >= 0.95 * len(every)
    for kind in ("verbatim", "fifth", "wide"):
        own = {(k, i) for k, (what, i, _) in enumerate(planted) if what == kind}
        assert len(own & every) >= 0.9 * len(own) and len(own & got) >= 0.9 * len(own & every)
    assert all((k, i) in got for k, (what, i, _) in enumerate(planted) if what == "verbatim")


def test_the_latent_space_is_fitted_on_all_passages(spark, monkeypatch):
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.4, n) % 5000) for n in (0, 1, 31, 32, 33, 64, 200, 500, 90)]
    d = spark.createDataFrame([(x,) for x in texts], "text string").repartition(4)
    idf, n = decontaminate.passage_frequencies(d)
    rows = []
    for x in texts:
        w = B.Words(pa.array([x], pa.large_string()), lower=True)
        f = decontaminate.features(w.hashes())
        rows += [np.bincount(f[i:i + 32], minlength=decontaminate.FEATURES) * idf for i in range(0, len(f), 32)]
    a = np.array(rows)
    assert n == len(a) < decontaminate.RANK
    start = rng.standard_normal((decontaminate.FEATURES, 5)).astype(np.float32)
    assert np.allclose(decontaminate._gram_product(d, idf, start), a.T @ (a @ start), rtol=1e-3, atol=1e-2)
    v = np.divide(a, idf, where=idf > 0, out=np.zeros_like(a)) @ decontaminate.latent_space(d, idf)
    assert np.allclose(v @ v.T, np.eye(n), atol=0.01)  # fewer passages than dimensions: whitened, they are orthogonal
    stored, names = decontaminate.written, []
    monkeypatch.setattr(decontaminate, "written", lambda df, name: names.append(name) or stored(df, name))
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string")
    decontaminate.benchmark_leaks(docs, spark.createDataFrame([(1, texts[4])], "item_id long, text string")).collect()
    assert "sample" not in names


def test_boundaries_are_optimal():
    rng = np.random.default_rng(5)
    for _ in range(20):
        lengths = np.unique(rng.integers(1, 40, rng.integers(1, 9)))
        rows = rng.integers(1, 6, len(lengths))
        k = int(rng.integers(1, 5))
        pad = lambda edges: sum(n * (min(e for e in edges if e >= x) - x) for x, n in zip(lengths, rows))
        best = min(pad((*c, lengths[-1])) for j in range(k) for c in combinations(lengths[:-1], min(j, len(lengths) - 1)))
        edges = packing.optimal_boundaries(lengths, rows, lengths * rows, k)
        assert len(edges) <= k and pad(edges) == best


def test_padding_is_the_least_where_many_lengths_are_long(spark):
    lengths = np.random.default_rng(6).integers(1, 20_000, 1500)
    docs = spark.createDataFrame([(i, "", int(n)) for i, n in enumerate(lengths)], "doc_id long, text string, rank long")
    u, rows = (x.tolist() for x in np.unique(lengths, return_counts=True))
    count, total = np.cumsum([0, *rows]), np.cumsum([0, *(x * n for x, n in zip(u, rows))])
    row = [0, *([1 << 60] * len(u))]  # least padding of the first j lengths, for one bucket more each time
    for _ in range(7):
        row = [0, *(min(row[j], int(min(np.array(row[:j]) + u[j - 1] * (count[j] - count[:j]) - (total[j] - total[:j])))) for j in range(1, len(u) + 1))]
    assert sum(r.padding for r in packing.packed(docs, 7, length=F.col("rank")).collect()) == row[-1]
    u, rows = np.array(u), np.array(rows)
    wide = packing.optimal_boundaries(u << 44, rows, (u << 44) * rows, 7)  # sums that 64 bits can't hold
    assert [x >> 44 for x in wide] == packing.optimal_boundaries(u, rows, u * rows, 7)


def test_batches_hold_the_budget(spark):
    out = registry.QUERIES["op10_packing"](spark, SF).collect()
    assert len(out) == spark.read.parquet(f"{SF}/documents.parquet").count()
    batches: dict = {}
    for r in out:
        assert r.boundary - r.n_tokens == r.padding >= 0
        batches.setdefault((r.bucket, r.batch), []).append(r)
    for rows in batches.values():
        assert sorted(r.position for r in rows) == list(range(len(rows)))
        assert len(rows) == 1 or len(rows) * rows[0].boundary <= 65_536


def test_shards_keep_equal_texts_together(spark):
    out = registry.QUERIES["op2_kd_sharding"](spark, SF).collect()
    assert len({(r.text_crc32, r.size) for r in out}) == len({(r.text_crc32, r.size, r.shard) for r in out})
    for s in {r.shard for r in out}:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {(r.doc_id, r.size, r.text_crc32) for r in out} == {(i, len(t) + 1, zlib.crc32(t)) for i, t in texts.items()}


@pytest.mark.parametrize("ids", [(0, 2000), (-(1 << 63), (1 << 63) - 1)])
def test_shards_are_boxes_of_near_equal_bytes(spark, ids):
    rng = np.random.default_rng(4)
    span = (ids[1] - ids[0]) // 2000
    rows = [(ids[0] + i * span, "x" * int(rng.integers(1, 400)), "hot" if i % 3 else f"s{i % 7}", "en") for i in range(2000)] + [(ids[1], "last", "hot", "en"), (None, "none", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    out = {(r.id, r.text_crc32): r for r in shard_documents(docs, 6).collect()}
    assert len(out) == len(rows)
    total, biggest = sum(r.size for r in out.values()), {}
    for r in out.values():
        biggest[r.text_crc32] = biggest.get(r.text_crc32, 0) + r.size
    load = [sum(r.size for r in out.values() if r.shard == s) for s in range(6)]
    assert max(abs(x - total / 6) for x in load) <= total / 6 * 0.02 + 3 * max(biggest.values())


def brute_lines(docs: list[tuple[int, str]]) -> dict[int, str | None]:
    """Texts without later repeats of runs of three lines or over fifty words; None where nothing is left of some lines."""
    plain = {i: [(n, " ".join(x.split())) for n, x in enumerate(t.split("\n")) if x.split()] for i, t in docs}
    first: dict = {}
    gone: dict = {i: set() for i in plain}
    for i in sorted(plain):
        for j in range(len(plain[i])):
            for k in (1, 2, 3):
                run = tuple(x for _, x in plain[i][j:j + k])
                if len(run) == k and (k == 3 or sum(len(x.split()) for x in run) > 50):
                    at = first.setdefault(run, (i, j))
                    if at != (i, j):
                        gone[i] |= {plain[i][x][0] for x in range(max(j, at[1] + k) if at[0] == i else j, j + k)}
    out = {}
    for i, t in docs:
        out[i] = "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[i])
        if gone[i] and len(gone[i]) == len(plain[i]):
            out[i] = None
    return out


def brute_groups(texts: dict[int, str]) -> set[int]:
    """The least id of each group of linked texts."""
    sets = {i: {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if (w := t.lower().split()) else set() for i, t in texts.items()}
    root = {i: i for i in texts}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root[a], root[b]))
                root = {i: x if r == y else r for i, r in root.items()}
    return {i for i in texts if root[i] == i}


def test_pipeline_against_plain_python(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(12)
    draw = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 900, n))
    insults = ["idiot", "scum", "moron", "trash"]
    docs = {i: draw(int(rng.integers(30, 80))) for i in range(400)}
    toxic = set(range(0, 400, 7))
    for i in toxic:
        w = docs[i].split()
        for k in range(0, len(w), 9):
            w[k] = insults[(i + k) % 4]
        docs[i] = " ".join(w)
    item = [draw(20) for _ in range(4)]
    shared, passage = "\n".join(draw(8) for _ in range(4)), draw(60)
    for n, i in enumerate(x for x in range(400) if x not in toxic):
        if n % 20 == 0:
            docs[i] = f"{docs[i]}\n{shared}\n{draw(5)}"
        elif n % 20 == 1:
            docs[i] = f"{draw(9)}\n{passage}"
        elif n % 20 == 2:
            docs[i] = f"{docs[i]} {item[n % 4]} {draw(6)}"
        elif n % 20 == 3:
            w = item[n % 4].split()
            w[3], w[9] = "new1", "new2"
            docs[i] = f"{draw(30)} {' '.join(w)} {draw(30)}"
    clean = [i for i in range(400) if i not in toxic]
    for n, i in enumerate(clean[-60:]):  # near copies of one text, and one of its copies whole
        w = docs[clean[5]].split()
        w[n % 5] = f"x{n}"
        docs[i] = " ".join(w)
    docs[clean[-1]] = docs[clean[6]] = draw(70)
    d = spark.createDataFrame(spark.sparkContext.parallelize([(i, docs[i], "en", "s", len(docs[i])) for i in rng.permutation(400).tolist()], 7), "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(400)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(item)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    seen, kept = d, {}
    for name, stage in corpus_pipeline.STAGES:
        seen = stage(spark, seen, str(tmp_path))
        assert name == "packing" or seen.columns == d.columns
        kept[name] = {r.doc_id: r for r in seen.collect()}
        seen = spark.createDataFrame(list(kept[name].values()), seen.schema)
    assert set(kept["toxicity"]) == set(clean)
    lines = {i: t for i, t in brute_lines([(i, docs[i]) for i in clean]).items() if t is not None}
    assert {i: r.text for i, r in kept["line_dedup"].items()} == lines and len(lines) < len(clean)
    assert set(kept["near_duplicates"]) == brute_groups(lines) and len(kept["near_duplicates"]) < len(lines) - 40
    left = {i for i in kept["near_duplicates"] if not any(brute_leak(x.split(), lines[i].split()) for x in item)}
    assert set(kept["decontamination"]) == left and len(left) < len(kept["near_duplicates"])
    assert {i: r.n_tokens for i, r in kept["packing"].items()} == {i: len(lines[i].split()) + 1 for i in left}
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == left


def test_pipeline_stages_take_awkward_and_empty_tables(spark, awkward, empty, side, tmp_path):
    import corpus_pipeline

    side[0].write.parquet(f"{tmp_path}/labels.parquet")
    side[1].write.parquet(f"{tmp_path}/benchmark.parquet")
    left = {"toxicity": {1, 2, 3, 4, None, 5, 6, 7}, "line_dedup": {1, 2, 3, 4, None, 5, 6, 7}, "near_duplicates": {1, 2, 3, None, 5, 6, 7}, "decontamination": {2, 3, None, 5, 6, 7}, "packing": {1, 2, 3, 4, None, 5, 6, 7}}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, awkward, str(tmp_path))
        if name != "toxicity":  # two labelled texts that are equal say nothing
            assert {r.doc_id for r in out.select("doc_id").collect()} == left[name]
        assert stage(spark, empty, str(tmp_path)).count() == 0
        assert name == "packing" or out.columns == awkward.columns


def test_documents_of_over_a_million_characters(spark, side):
    rng = np.random.default_rng(12)
    long = " ".join(f"w{x}" for x in rng.integers(0, 10 ** 6, 180_000))
    assert len(long) > 1_200_000
    d = spark.createDataFrame([(1, long), (2, long), (3, "short text of six words here")], "doc_id long, text string").repartition(3)
    assert rows_of(remove_repeated_passages(d, 35), "id", "n_words", "n_removed") == [(1, 180_000, 180_000), (2, 180_000, 180_000), (3, 6, 0)]
    assert rows_of(jaccard_components(d), "id", "component_id") == [(1, 1), (2, 1), (3, 3)]
    assert rows_of(drop_repeated_lines(d), "doc_id", "n_lines", "n_removed") == [(1, 1, 0), (2, 1, 1), (3, 1, 0)]
    assert rows_of(ppm.lm_scores(d), "id", "n_tokens") == [(1, 180_001), (2, 180_001), (3, 7)]
    item = " ".join(long.split(" ")[170_000:170_030])
    leaks = decontaminate.benchmark_leaks(d, spark.createDataFrame([(9, item)], "item_id long, text string"))
    assert rows_of(leaks, "id", "item_ids") == [(1, [9]), (2, [9]), (3, [])]
    assert rows_of(packing.packed(d), "id", "n_tokens") == [(1, 180_001), (2, 180_001), (3, 7)]
    assert rows_of(shard_documents(d, 2), "id", "size") == [(1, len(long) + 1), (2, len(long) + 1), (3, 29)]
    scores = {r.id: r.score for r in toxicity.toxicity_scores(d, side[0]).collect()}
    assert len(scores) == 3 and scores[1] == scores[2]
