import zlib
from collections import Counter, defaultdict

import pytest

from larch.llm import sharding


def laws(rows, have, shards):
    assert len(rows) == len(have)
    counts = Counter(r["shard"] for r in rows)
    assert max(counts.values()) - min(counts.get(s, 0) for s in range(shards)) <= 1
    assert set(counts) <= set(range(shards))
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    size = lambda t: 16 + len((t or "").encode())
    want = Counter((r["doc_id"], size(r["text"]), zlib.crc32((r["text"] or "").encode())) for r in have)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want


@pytest.mark.parametrize("shards", [3, 40])
def test_laws(documents, shards):
    laws(sharding.shard_rows(documents, shards).collect(), documents.collect(), shards)


def test_groups_stay_together_and_hot_groups_are_cut_least(spark):
    rows = [(i, "same") for i in range(400)] + [(1000 + i, f"pair {i // 2}") for i in range(300)] + [(5000 + i, f"alone {i}") for i in range(300)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.shard_rows(table, 10).collect()
    laws(got, table.collect(), 10)
    text = dict(rows)
    where = defaultdict(set)
    for r in got:
        where[text[r["doc_id"]]].add(r["shard"])
    assert len(where["same"]) <= 6  # 400 rows, 100 a shard
    assert sum(len(where[f"pair {i}"]) > 1 for i in range(150)) <= 10


def test_all_rows_linked(spark):
    table = spark.createDataFrame([(i, f"t{i % 5}") for i in range(103)], "doc_id long, text string")
    laws(sharding.shard_rows(table, 10).collect(), table.collect(), 10)


def test_reruns_agree(documents):
    a, b = (sorted((tuple(r) for r in sharding.shard_rows(x, 7).collect()), key=str) for x in (documents, documents.repartition(5)))
    assert a == b


def test_empty(nothing):
    assert sharding.shard_rows(nothing).count() == 0


def brute_cells(groups, room, shards, rounds):
    """The cells after the given rounds, by loops: the line of groups, then cells that move to their group's fullest shard."""
    step = max(1, min(room, -(-sum(n for _, n in groups) // shards)))
    cells, at = Counter(), 0
    for g, n in sorted(groups):
        for k in range(at, at + n):
            if k // step < shards:
                cells[g, k // step] += 1
        at += n
    for _ in range(rounds):
        load, ahead, after = Counter(), Counter(), Counter()
        for (_, s), n in cells.items():
            load[s] += n
        best = {g: min((-n, s) for (x, s), n in cells.items() if x == g)[1] for g, _ in cells}
        for (g, s), n in sorted(cells.items()):
            to = best[g]
            go = 0 if s == to else max(0, min(n, max(0, room - load[to]) - ahead[to]))
            ahead[to] += n if s != to else 0
            after[g, to] += go
            after[g, s] += n - go
        cells = +after
    return cells


@pytest.mark.parametrize("rounds", [0, 1, 4])
def test_propagation_against_brute_force(spark, rng, monkeypatch, rounds):
    monkeypatch.setattr(sharding, "BUCKETS", 1)  # one bucket: groups stand in the order of their names
    for room, shards in ((30, 9), (12, 40), (1, 3)):
        groups = [(f"g{i:03}", rng.choice([2, 2, 3, 5, 9, 40])) for i in range(25)]
        table = spark.createDataFrame(groups, "g string, n long")
        got = {(r["g"], r["shard"]): r["n"] for r in sharding.shards_of_groups(table, room, shards, rounds).collect()}
        assert got == dict(brute_cells(groups, room, shards, rounds))
        loads = Counter()
        for (_, s), n in got.items():
            loads[s] += n
        assert max(loads.values()) <= room


def test_long_texts(spark, rng):
    long_ = "".join(rng.choice("ab \n") for _ in range(3_000_000))
    table = spark.createDataFrame([(1, long_), (2, "x"), (3, long_), (4, None), (5, long_ + "c"), (6, "x")], "doc_id long, text string")
    got = sharding.shard_rows(table, 3).collect()
    laws(got, table.collect(), 3)
    where = {r["doc_id"]: r["shard"] for r in got}
    assert where[1] == where[3] and where[2] == where[6]
