import random
from collections import Counter, defaultdict

from larch.llm import mixing
from tests.llm.conftest import words


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be")) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in full]
        left = total - sum(full.values())
        over = [s for s in rest if w[s] * left > most * sizes[s] * sum(w[x] for x in rest)]
        if not over:
            return full | {s: w[s] * left / sum(w[x] for x in rest) for s in rest}
        full |= {s: most * sizes[s] for s in over}


def test_mix(spark, documents):
    rng = random.Random(1)
    rows = [(i, "w " * rng.choice([1, 5, 20, 50, 300]), f"s{int(rng.random() ** 2 * 9)}") for i in range(3000)]
    big = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for table, close in ((big, 0.01), (documents, 0.6)):
        got = mixing.mix_sources(table).collect()
        have = table.collect()
        assert len(got) == len(have)
        sizes, taken, target = defaultdict(int), defaultdict(int), {}
        for r in have:
            sizes[r["source"]] += len(words(r["text"]))
        want = brute_targets(sizes)
        for r in got:
            assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 * (1 + want[r["source"]])
            assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
            taken[r["source"]] += r["taken"]
        for s, t in want.items():
            assert abs(taken[s] - t) <= close * t + 1


def test_reruns_agree_under_other_partitions(spark):
    rows = [(i, "w " * (i % 37 + 1), f"s{i % 5}") for i in range(2000)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    a = sorted(tuple(r) for r in mixing.mix_sources(table, leaf_rows=100).collect())
    b = sorted(tuple(r) for r in mixing.mix_sources(table.repartition(7), leaf_rows=100).collect())
    assert a == b


def test_meeting_keeps_words_and_expectation():
    size, p = [3, 7, 11, 2, 30], [0.3, 0.5, 0.9, 0.2, 0.4]
    sums = [0.0] * 5
    for seed in range(4000):
        out = mixing.meet(size, p, [random.Random(seed * 5 + i).getrandbits(63) for i in range(5)], 1)
        assert abs(sum(s * x for s, x in zip(size, out, strict=True)) - sum(s * x for s, x in zip(size, p, strict=True))) < 1e-6
        assert sum(0 < x < 1 for x in out) <= 1
        sums = [a + b for a, b in zip(sums, out, strict=True)]
    assert all(abs(a / 4000 - b) < 0.04 for a, b in zip(sums, p, strict=True))


def test_takes_against_brute_force(spark, documents):
    """Copies are the ratio rounded down or up, and a source's words come as near to its target as its last documents allow."""
    rows = [(i, "w " * n, s) for i, (n, s) in enumerate([(3, "a"), (50, "a"), (700, "a"), (9, "b"), (2000, "b"), (31, "b"), (120, "b"), (64, "c"), (400, "c"), (0, "c"), (5, None)])]
    for table in (spark.createDataFrame(rows, "doc_id long, text string, source string"), documents):
        by = defaultdict(list)
        for r in mixing.mix_sources(table).collect():
            by[r["source"]].append(r)
        for got in by.values():
            target, total = got[0]["target"], got[0]["source_size"]
            ratio = min(3.0, target / total) if total else 0.0
            assert all(r["copies"] in (int(ratio + 1e-9), -int(-(ratio - 1e-9) // 1)) if r["size"] else r["copies"] == 0 for r in got)
            if len(got) <= mixing.OPEN and 0 < ratio < 3:
                sizes = [r["size"] for r in got]
                best = min(abs(sum(n * (int(ratio) + (k >> i & 1)) for i, n in enumerate(sizes)) - target) for k in range(1 << len(sizes)))
                classes = [n.bit_length() for n in sizes if n]
                if len(set(classes)) == len(classes):  # no two of them met
                    assert abs(sum(r["taken"] for r in got) - target) <= max(best, mixing.NEAR * target) + 1e-6


def test_root_keeps_chances_where_it_can():
    """With many subsets near the target, documents are drawn about as often as their fractions say."""
    size, p = [512 + 32 * i for i in range(10)], [0.1, 0.9, 0.3, 0.7, 0.5, 0.5, 0.2, 0.8, 0.4, 0.6]
    sums = [0.0] * 10
    for seed in range(600):
        out = mixing.settle(size, p, [random.Random(seed * 10 + i).getrandbits(63) for i in range(10)], 1e6)
        assert set(out) <= {0.0, 1.0}
        sums = [a + b for a, b in zip(sums, out, strict=True)]
    assert all(abs(a / 600 - b) < 0.12 for a, b in zip(sums, p, strict=True))


def test_large_ids_beside_nulls(spark):
    big = 2**53
    rows = [(big + 1, "a b c", "s"), (None, "d e", "s"), (big + 3, "f g h i", "s"), (big + 5, "j", "t")]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), leaf_rows=1)
    assert sorted((r["doc_id"] or 0, r["size"]) for r in got.collect()) == [(0, 2), (big + 1, 3), (big + 3, 4), (big + 5, 1)]


def test_repeat(spark, documents, nothing):
    out = mixing.repeat(documents)
    assert out.schema == documents.schema
    assert mixing.mix_sources(nothing).count() == 0 and mixing.repeat(nothing).count() == 0
    # The rows that come out are those that went in, in all columns, as often as the mix says for their source.
    have, got = Counter(tuple(r) for r in documents.collect()), Counter(tuple(r) for r in out.collect())
    assert set(got) <= set(have)
    taken, size = defaultdict(int), defaultdict(int)
    for r in mixing.mix_sources(documents).collect():
        taken[r["source"]] += r["taken"]
    for r, n in got.items():
        size[r[2]] += n * len(words(r[1]))
    assert {s: n for s, n in size.items() if n} == {s: n for s, n in taken.items() if n}
    # One id and text in two sources: each comes out with its own source.
    text = "x " * 100
    rows = [(1, text, "a", {"k": 1}), (1, text, "b", {"k": 2})] + [(i, "y " * 100, s, None) for i in range(2, 40) for s in ("a", "b")]
    twice = spark.createDataFrame(rows, "doc_id long, text string, source string, more map<string,int>")
    got = Counter((r["doc_id"], r["source"]) for r in mixing.repeat(twice).collect())
    want = defaultdict(int)
    for r in mixing.mix_sources(twice).collect():
        want[r["source"]] += r["copies"]
    assert {s: sum(n for (_, x), n in got.items() if x == s) for s in "ab"} == want
    assert got[(1, "a")] in (1, 2) and got[(1, "b")] in (0, 1)
