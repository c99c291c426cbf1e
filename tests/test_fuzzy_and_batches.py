"""Close names and greedy batches against plain Python, with groups of every size."""

import random
import re
from difflib import get_close_matches

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern import catalog_live
from lectern.operators.batches import RangeMap, batch_numbers, batched
from lectern.operators.fuzzy import Bags, close_names

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("block", [40, 4096])
def test_close_names_are_those_of_the_whole_pool(spark, block):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdeaab") for _ in range(rng.randrange(0, 12)))
    unknown = [(rng.randrange(5), word()) for _ in range(200)] + [(None, "a"), (1, None), (1, "x" * 300)]
    pool = [(rng.randrange(4), word()) for _ in range(1500)] + [(None, "a"), (1, None), (1, "x" * 290 + "y")]
    got = close_names(spark.createDataFrame(unknown, "doc int, ref string").repartition(5), spark.createDataFrame(pool, "doc int, ref string").repartition(3), block=block).collect()
    names = {g: sorted({s for h, s in pool if h == g and s is not None}) for g in range(5)}
    want = {(g, s): get_close_matches(s, names[g], n=3) for g, s in unknown if g is not None and s is not None}
    assert {(r.doc, r.ref): r.suggested for r in got} == want and len(got) == len(want)
    assert sum(r.looked for r in got) < 0.7 * sum(len(names[g]) for g, _ in want)


def test_a_bound_is_never_below_the_ratio():
    from difflib import SequenceMatcher

    rng = random.Random(3)
    names = ["".join(rng.choice("abcab é") for _ in range(rng.randrange(9))) for _ in range(60)]
    bags = Bags(names)
    for x in names:
        assert all(b >= SequenceMatcher(None, y, x).ratio() for b, y in zip(bags.bounds(x), names))


def test_the_ratio_is_that_of_difflib():
    from difflib import SequenceMatcher

    from lectern.operators.fuzzy import ratio

    rng = random.Random(4)
    word = lambda most: "".join(rng.choice("abcab é") for _ in range(rng.randrange(most)))
    for a, b in [(word(14), word(14)) for _ in range(4000)] + [(word(400), word(400)) for _ in range(40)] + [("", ""), ("", "a")]:
        assert ratio(a, b) == SequenceMatcher(None, a, b).ratio()


def test_suggestions_of_conversations_by_hand(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    said = {}
    for r in rows:
        said.setdefault(r.conv_id, {}).setdefault(r.role, set()).update(w for w in re.split(r"[\W_]+", (r.text or "").lower()) if w)
    want = {(c, w): " ".join(get_close_matches(w, sorted(x.get("assistant", ())), n=3)) for c, x in said.items() for w in x.get("user", set()) - x.get("assistant", set())}
    assert {(r.conv_id, r.word): r.suggested for r in catalog_live.citation_suggestions(spark, SF).collect()} == want and len(want) > 100


def test_maps_of_ranges():
    rng = random.Random(2)
    for _ in range(500):
        budget, tokens = rng.randrange(1, 30), [rng.choice([0, 0, 1, 2, 5, 9, 40]) for _ in range(rng.randrange(1, 12))]
        m = RangeMap.of(np.array(tokens), budget)
        for start in [None, *range(budget + 12)]:
            fill, begun = start, 0
            for t in tokens:
                fill, begun = (t, begun + 1) if fill is None or fill + t > budget else (fill + t, begun)
            assert m.after(start, budget) == (begun, fill)


def plain(rows, budget):
    out = {}
    for g in {r[0] for r in rows}:
        now, used, n = [], 0, 0
        for _, i, t in sorted((r for r in rows if r[0] == g), key=lambda r: r[1]):
            if now and used + max(t or 0, 0) > budget:
                out[g, n], now, used, n = now, [], 0, n + 1
            now.append(str(i))
            used += max(t or 0, 0)
        out[g, n] = now
    return out


def test_batches_of_one_large_group_over_many_ranges(spark):
    rng = random.Random(5)
    rows = [("a" if i < 1500 else rng.choice(["a", "b", None, ""]), i, rng.choice([0, 1, 3, 7, 100, 2000, 5000, None, -4])) for i in range(2000)]
    d = spark.createDataFrame(rows, "g string, id long, t long").repartition(7)
    assert {(r.g, r.batch): r.ids for r in batched(d, ["g"], "id", "id", F.col("t")).collect()} == plain(rows, 4000)
    numbered = batch_numbers(d, ["g"], ["id"], F.col("t"), ranges=37).collect()
    want = {int(i): n for (_, n), ids in plain(rows, 4000).items() for i in ids}
    assert {r.id: r.batch for r in numbered} == want and len(numbered) == 2000
    every = batch_numbers(d, [], ["id"], F.col("t"), 500, ranges=5).collect()
    assert {r.id: r.batch for r in every} == {int(i): n for (_, n), ids in plain([(0, i, t) for _, i, t in rows], 500).items() for i in ids}


def test_batches_of_equal_rows_and_of_none(spark):
    d = spark.createDataFrame([("a", 1, 6)] * 50, "g string, id long, t long")
    assert sorted(len(r.ids) for r in batched(d, ["g"], "id", "id", F.col("t"), 20).collect()) == [2] + [3] * 16
    assert batched(d.where("t > 6"), ["g"], "id", "id", F.col("t")).count() == 0


def test_one_key_is_numbered_over_many_ranges(spark):
    from lectern.operators.relational import head_and_tail, numbered

    rng = random.Random(8)
    rows = [("hot" if i < 1500 else rng.choice("abc"), rng.choice([None, *range(50)]), i) for i in range(2000)]
    d = spark.createDataFrame(rows, "k string, o int, i int").repartition(5)
    got = numbered(d, ["k"], "o", "n", total="all").collect()
    for k in "hot", "a", "b", "c":
        own = sorted((r.n, r.o) for r in got if r.k == k)
        assert [n for n, _ in own] == list(range(1, len(own) + 1)) and [o for _, o in own] == sorted((o for _, o in own), key=lambda o: (o is not None, o))
        assert {r["all"] for r in got if r.k == k} == {len(own)}
    assert sorted(r.i for r in got) == list(range(2000))
    parts = head_and_tail(d, ["k"], "i", 2, 3).where("k = 'hot'").collect()
    assert {r.i for r in parts if r.part == "head"} == {0, 1} and {r.i for r in parts if r.part == "tail"} == {i for i, (k, _, _) in enumerate(rows) if k == "hot" and sum(x[0] == "hot" for x in rows[i + 1:]) < 3}
