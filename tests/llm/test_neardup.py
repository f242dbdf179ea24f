import random
from collections import Counter

import numpy as np

from larch.llm import neardup
from tests.llm.conftest import words


def roots(rows):
    """(size of the set, name of the class) of each row."""
    sets = []
    for _, t in rows:
        w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    has = {}
    for k, x in enumerate(sets):
        for y in x:
            has.setdefault(y, []).append(k)
    up = list(range(len(rows)))

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for k, x in enumerate(sets):
        if rows[k][0] is not None:
            for j, n in Counter(j for y in x for j in has[y] if j < k and rows[j][0] is not None).items():
                if 100 * n >= 75 * (len(x) + len(sets[j]) - n):
                    up[find(k)] = find(j)
    return [(len(x), find(k)) for k, x in enumerate(sets)]


def brute(rows):
    found, low = roots(rows), {}
    for (i, _), (_, c) in zip(rows, found, strict=True):
        if i is not None:
            low[c] = min(low.get(c, i), i)
    return sorted(((i, n, None if i is None else low[c], i is None or low[c] == i) for (i, _), (n, c) in zip(rows, found, strict=True)), key=str)


def near_copies(rng, n=160):
    vocabulary = [f"W{i}" for i in range(400)]
    bases = [rng.choices(vocabulary, k=rng.randrange(3, 120)) for _ in range(12)]
    rows = []
    for i in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 4, 6])):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((i, " ".join(w) if rng.random() < 0.5 else "\n".join(w).lower()))
    return rows


def test_classes_against_brute_force(spark, documents):
    rng = random.Random(3)
    rows = near_copies(rng)
    rows += [(None, rows[0][1]), (None, None), (7, "a b"), (8, None), (9, ""), (3, rows[9][1]), (3, rows[9][1]), (4, "a B"), (500, " ")]
    for table in (spark.createDataFrame(rows, "doc_id long, text string"), documents):
        have = [(r["doc_id"], r["text"]) for r in table.collect()]
        got = sorted((tuple(r) for r in neardup.near_duplicates(table).collect()), key=str)
        assert got == brute(have)


def test_blocks_change_nothing(spark, monkeypatch):
    rows = near_copies(random.Random(4), 80)
    monkeypatch.setattr(neardup, "BLOCK", 7)
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 300)
    monkeypatch.setattr(neardup, "BROADCAST_IDS", 0)
    monkeypatch.setattr(neardup, "HOT", 3)
    got = sorted((tuple(r) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == brute(rows)


def test_one_of_each_class_stays(documents):
    kept = neardup.keep_one(documents)
    assert kept.schema == documents.schema
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    found = dict(zip(rows, roots(rows), strict=True))
    have = [(r["doc_id"], r["text"]) for r in kept.collect()]
    alone = lambda x: x[0] is None or found[x][0] == 0
    assert Counter(x for x in have if alone(x)) == Counter(x for x in rows if alone(x))
    assert Counter(found[x][1] for x in have if not alone(x)) == Counter({found[x][1] for x in rows if not alone(x)})


def test_empty_table(nothing):
    assert neardup.near_duplicates(nothing).count() == 0
    assert neardup.keep_one(nothing).count() == 0


def test_bound_keeps_true_pairs():
    rng = np.random.default_rng(0)
    match = rng.random((100_000, neardup.HASHES)) < 0.75
    for n, least in neardup.least_matches():
        assert (match[:, :n].sum(axis=1) >= least).all()


def test_strays_among_many_copies(spark):
    """Nodes that share buckets with a large component, some of them linked to it only through members that are not its hub."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(120):
        w = list(base)
        for k in range(i // 6):  # drifts away: neighbours are alike, the ends are not
            w[k * 5 % 100] = f"x{k}"
        w[rng.randrange(100)] = f"y{i}"
        rows.append((i, " ".join(w)))
    rows += [(200 + i, " ".join([f"z{i}{k}" for k in range(40)] + base[:60])) for i in range(10)]
    got = sorted((tuple(r) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == brute(rows)


def test_long_texts(spark):
    """Texts over a step's bytes, near copies of each other, in one table with short ones."""
    rng = random.Random(2)
    long_ = [f"w{rng.randrange(10**6)}" for _ in range(400_000)]
    other = long_[:-20_000] + [f"v{rng.randrange(10**6)}" for _ in range(20_000)]
    rows = [(1, " ".join(long_)), (2, " ".join(other)), (3, "a b c d e f"), (4, "A b c d e f"), (5, None)]
    got = sorted((tuple(r) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert [r[2] for r in got] == [1, 1, 3, 3, 5]
