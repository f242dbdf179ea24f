import random

import numpy as np
import pandas as pd
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from larch.functions.similarity import indel, indel_ratio
from larch.operators import claims, identity, keeplist, lookup, protection, ranking, requirements, series, vectors
from larch.plans import scenarios
from larch.sources import schemas

TASKS = [
    ("t1", "Kappa task", 1, True, ("Trader",), [("o1", "giveItem", 2, True, ("shared_item", "Shared", "S")), ("o2", "visit", 1, False, None)], 0),
    ("t2", "Side task", 5, False, ("Trader",), [("o3", "giveItem", 3, True, ("shared_item", "Shared", "S")), ("o4", "giveItem", 100, False, ("rub", "Roubles", "RUB"))], 1),
    ("t3", "Empty", 5, False, ("Other",), None, 2),
]
STATIONS = [("s1", "Lavatory", [("l1", 1, [(1, ("shared_item", "Shared", "S")), (4, ("tape", "Tape", "T"))]), ("l2", 2, None)], 0)]


@pytest.fixture
def catalogue(spark):
    return spark.createDataFrame(TASKS, schemas.TASK + ", pos bigint"), spark.createDataFrame(STATIONS, schemas.STATION + ", pos bigint")


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "id string")


def test_requirements(spark, catalogue):
    tasks, stations = catalogue
    none, have = ids(spark), spark.createDataFrame([("shared_item", 1)], "item_id string, have int")
    for only, total, names in ((True, 2, ["Trader — Kappa task"]), (False, 5, ["Trader — Kappa task", "Trader — Side task"])):
        row = requirements.outstanding(requirements.task_needs(tasks, none, only), have).collect()
        assert [(r["item_id"], r["total_needed"], r["fir_needed"], r["have"], r["remaining"]) for r in row] == [("shared_item", total, total, 1, total - 1)]
        assert [s["name"] for s in row[0]["sources"]] == names
    view, by_task, by_level = scenarios.tasks_view(tasks, stations, ids(spark, "t1"), none, have, False)
    rows = {r["item_id"]: r for r in view.collect()}
    assert rows["shared_item"]["total_needed"] == 4 and rows["shared_item"]["fir_needed"] == 3 and rows["tape"]["remaining"] == 4
    assert [r["source_id"] for r in by_task.collect()] == ["t1", "t2"] and [len(r["items"]) for r in by_level.collect()] == [2]
    assert [r["item_id"] for r in requirements.search(view, "TAP").collect()] == ["tape"]
    traders = requirements.tasks_by_trader(tasks, "", ids(spark, "t1")).collect()
    assert [(r["trader"], r["n"], r["n_done"]) for r in traders] == [("Other", 1, 0), ("Trader", 2, 1)]
    assert [r["n"] for r in requirements.tasks_by_trader(tasks, "side").collect()] == [1]
    assert [len(r["levels"]) for r in requirements.open_levels(stations, "lav", ["l1"]).collect()] == [1]
    assert requirements.open_levels(stations, "lav", ["l1", "l2"]).count() == 0


ITEMS = [("i1", "Red Key", "RK", 0), ("i2", "red key", "Key2", 1), ("i3", "Bandage", "Band", 2), ("i4", "Long rope", "Rope", 3)]
ENTRIES = "category_id string, pos long, id string, name string, aliases array<string>, acquired boolean, source string, tdev_id string"


def test_index_and_cascade(spark):
    index = lookup.name_index(spark.createDataFrame(ITEMS, "id string, name string, shortName string, pos long"))
    got = {r["key"]: r["item_id"] for r in index.collect()}
    assert got == {"red key": "i2", "rk": "i1", "key2": "i2", "bandage": "i3", "band": "i3", "long rope": "i4", "rope": "i4"}
    rows = [
        ("c", 0, "e1", "BANDAGE", [], False, None, None), ("c", 1, "e2", "gone", [], False, None, "i4"), ("c", 2, "e3", "gone too", ["rk", "Rope"], False, None, "zz"),
        ("c", 3, "e4", "both", ["Rope", "Bandage"], False, None, None), ("c", 4, "e5", "Long ropes", [], True, None, None), ("c", 5, "e6", "nothing", ["RK"], False, None, None), ("c", 6, "e7", "band", [], False, None, None),
    ]
    entries = spark.createDataFrame(rows, ENTRIES)
    near = lambda a, b: lookup.fuzzy_lookup(a, b, 90.0, indel_ratio)
    out = lookup.resolve(entries, index, near)
    assert {r["id"]: (r["item_id"], r["how"]) for r in out.collect()} == {
        "e1": ("i3", "exact"), "e2": ("i4", "id"), "e3": ("i4", "alias"), "e4": (None, None), "e5": ("i4", "fuzzy"), "e6": (None, None), "e7": ("i3", "exact"),
    }
    assert {r["item_id"]: r["id"] for r in lookup.mapped(out).collect()} == {"i3": "e7", "i4": "e5"}
    assert [r["id"] for r in lookup.unmapped(out).collect()] == ["e4", "e6"]
    assert {r["id"]: r["item_id"] for r in lookup.first_alias_hit(entries, index).collect()} == {"e1": "i3", "e3": "i1", "e4": "i4", "e6": "i1", "e7": "i3"}
    labels = spark.createDataFrame([("a", "bandge", 1, 2), ("b", "rope", 1, 1), ("c", "zzzz", 1, 2)], "id string, text string, fw int, fh int")
    items = spark.createDataFrame([("i3", "Bandage", "Band", 2, 1, 0), ("i4", "Long rope", "Rope", 1, 1, 1)], "item_id string, name string, shortName string, width int, height int, pos long")
    assert {r["id"]: r["item_id"] for r in lookup.match_labels(labels, items, 78.0, indel_ratio).collect()} == {"a": "i3", "b": "i4"}


def test_labels_meet_names_once(spark, monkeypatch):
    """Copies of labels and names are compared once, in a grid of many blocks; ids, ties and orientations as in plain loops."""
    monkeypatch.setattr(lookup, "LABEL_BLOCK", 3)
    rng = random.Random(7)
    texts, words = ["Bolt", "bolt", "nut", "long bolt", "", None], ["Bolt", "bolt", "Nut", "long nut", "ring", "", None]
    labels = [(rng.choice([k, k % 40, None]), rng.choice(texts), rng.choice([1, 1, 2, 3, None]), rng.choice([1, 2])) for k in range(300)]
    items = [(f"i{k}", rng.choice(words), rng.choice(words), rng.choice([1, 1, 2, None]), rng.choice([1, 2, 3]), rng.choice([k, k, 5])) for k in range(200)]
    calls = spark.sparkContext.accumulator(0)

    @F.pandas_udf("double")
    def near(a: pd.Series, b: pd.Series) -> pd.Series:
        calls.add(len(a))
        return pd.Series([None if x is None else indel(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    low = lambda x: None if x is None else x.lower()
    want, pairs, places = {}, set(), {(pos, i) for i, _, _, _, _, pos in items}
    assert len(places) == len(items)
    for label, text, fw, fh in labels:
        q = low(text)
        for side, size in enumerate(dict.fromkeys([(fw, fh), (fh, fw)])):
            for item, name, short, w, h, pos in items:
                if None in (q, *size, w, h) or size != (w, h):
                    continue
                for k, key in enumerate(dict.fromkeys(x for x in (low(short), low(name)) if x)):
                    pairs.add((q, fw, fh, side, key))
                    score = indel(q, key)
                    if score >= 60:
                        want[label] = min(want.get(label, (1,)), (-score, side, pos, k, item, key))
    df = lookup.match_labels(spark.createDataFrame(labels, "id long, text string, fw int, fh int").coalesce(1), spark.createDataFrame(items, "item_id string, name string, shortName string, width int, height int, pos long"), 60.0, near)
    got = {r["id"]: (r["item_id"], r["key"], r["score"]) for r in df.collect()}
    assert 0 < calls.value <= 2 * len(pairs)  # the filter may be computed apart from the column
    assert len(want) > 80 and got == {label: (item, key, -score) for label, (score, _, _, _, item, key) in want.items()}


def test_labels_spread(spark, monkeypatch):
    """One file of labels of one footprint is compared in many tasks."""
    monkeypatch.setattr(lookup, "LABEL_BLOCK", 10)
    names = [f"name {k}" for k in range(100)]
    labels = spark.createDataFrame([(k, n, 1, 1) for k, n in enumerate(names)], "id long, text string, fw int, fh int").coalesce(1)
    items = spark.createDataFrame([(k, n, n, 1, 1, k) for k, n in enumerate(names)], "item_id long, name string, shortName string, width int, height int, pos long").coalesce(1)
    tasks = spark.sparkContext.accumulator(0)

    @F.pandas_udf("double")
    def near(a: pd.Series, b: pd.Series) -> pd.Series:
        tasks.add(1 << 64 * TaskContext.get().partitionId())
        return (a == b) * 100.0

    got = lookup.match_labels(labels, items, 50.0, near).collect()
    assert sorted((r["id"], r["item_id"]) for r in got) == [(k, k) for k in range(100)]
    assert sum(tasks.value >> 64 * k & (1 << 64) - 1 > 0 for k in range(100)) >= 3


def test_protection(spark):
    kept = spark.createDataFrame([("a", "collector", False), ("b", "manual", False), ("c", "collector", True)], "item_id string, category_id string, acquired boolean")
    needs = spark.createDataFrame(
        [("a", "A", "", "task", "t", "T — x", 5, True, True, 0), ("d", "D", "", "task", "t", "T — x", 2, True, True, 1), ("e", "E", "", "task", "t", "T — x", 2, True, True, 2), ("e", "E", "", "hideout", "h", "L1", 1, False, True, 3)],
        requirements.NEED,
    )
    out = protection.protected(kept, requirements.outstanding(needs))
    assert {r["item_id"]: (r["reason"], r["fir_only"]) for r in out.collect()} == {
        "a": ("On keep list", True), "b": ("On keep list", False), "d": ("Needed: T — x (×2)", True), "e": ("Needed: T — x (×3) +1 more", False),
    }
    seen = spark.createDataFrame([(i, f) for i in "ad" for f in (True, False, None)] + [("b", False), ("zz", None)], "item_id string, fir boolean")
    got = sorted(((r["item_id"], r["fir"], r["keep"]) for r in protection.verdicts(seen, seen.select("item_id").distinct(), out).collect()), key=str)
    assert [k for _, _, k in got] == [f is not False or i == "b" for i, f, _ in got[:-1]] + [False]


def merge(spark, rows, names):
    entries = spark.createDataFrame([("collector", k, *r) for k, r in enumerate(rows)], ENTRIES)
    out = keeplist.merge_names(entries, names)
    return {r["name"]: r for r in out.collect()}, keeplist.summary(out).first()


def test_merge(spark):
    got, s = merge(spark, [("e1", "Old Wiki Item", [], False, "wiki", None)], [])
    assert got["Old Wiki Item"]["status"] == "removed" and s["removed"] == ["Old Wiki Item"] and s["total"] == 0
    got, s = merge(spark, [("e1", "Mine", [], True, "custom", None)], [])
    assert got["Mine"]["status"] == "kept" and s["total"] == 1
    got, s = merge(spark, [("e1", "Press pass (NoiceGuy)", [], True, "wiki", None)], ["Press pass (issued for NoiceGuy)"])
    row = got["Press pass (issued for NoiceGuy)"]
    assert (row["id"], row["acquired"], row["aliases"], s["total"]) == ("e1", True, ["Press pass (NoiceGuy)"], 1)
    got, s = merge(spark, [], ["Brand New Item"])
    assert s["added"] == ["Brand New Item"] and got["Brand New Item"]["source"] == "wiki" and len(got["Brand New Item"]["id"]) == 8
    got, s = merge(spark, [("e1", "a thing", [], False, "custom", None)], ["A Thing"])
    assert got["a thing"]["source"] == "wiki"  # an exact name makes a custom entry a listed one
    with pytest.raises(ValueError):
        scenarios.sync(spark.createDataFrame([], ENTRIES), ["x"])


def test_list_edits(spark):
    entries = spark.createDataFrame([("c", 0, "e1", "A", [], False, "wiki", None), ("c", 1, "e2", "B", [], True, "wiki", "")], ENTRIES)
    assert {r["id"]: r["acquired"] for r in keeplist.toggle(entries, "e1").collect()} == {"e1": True, "e2": True}
    rows = {r["id"]: (r["acquired"], r["updated"]) for r in keeplist.acquire(entries, ids(spark, "e1", "e2", "zz")).collect()}
    assert rows == {"e1": (True, True), "e2": (True, False)}
    assert [r["pos"] for r in keeplist.add_custom(entries, "c", "New", ["n"]).filter("source = 'custom'").collect()] == [2]
    assert keeplist.remove(entries, "e9").count() == 2 and keeplist.remove(entries, "e1").count() == 1
    assert keeplist.restart(entries).filter("acquired").count() == 0
    index = spark.createDataFrame([("b", "i2", 0)], "key string, item_id string, ord long")
    assert {r["id"]: r["tdev_id"] for r in keeplist.backfill_ids(entries, index).collect()} == {"e1": None, "e2": "i2"}
    progress = spark.createDataFrame([(["b", "a"], [], {})], schemas.PROGRESS)
    once = keeplist.set_completed(progress, "completed_tasks", "c", True)
    assert keeplist.set_completed(once, "completed_tasks", "c", True).first()[0] == ["a", "b", "c"]
    assert keeplist.set_completed(once, "completed_tasks", "b", False).first()[0] == ["a", "c"]


def test_exact_map_and_gate(spark):
    items = spark.createDataFrame([(111, "item-a", 0), (111, "item-b", 1), (222, "item-c", 2), (333, "d", 3), (444, "e", 4), (555, "f", 5), (666, "g", 6), (777, "h", 7)], "hash long, item_id string, pos long")
    index = spark.createDataFrame([(111, 1), (222, 2), (333, 3), (444, 3), (555, 4), (666, 4), (777, 4)], "hash long, file_number long")
    assert {r["file_number"]: r["item_id"] for r in identity.exact_map(items, index).collect()} == {2: "item-c", 4: "h"}
    assert tuple(identity.probe(items, index).first()) == (7, 7)
    assert {r["items"]: r["hashes"] for r in identity.collisions(items).collect()} == {1: 6, 2: 1}
    seen = "key long, item_id string, score double, preset boolean, unknown boolean"

    def verdict(n, agree, size, **weak):
        exact = spark.createDataFrame([(i, "x") for i in range(n)], "key long, item_id string")
        visual = spark.createDataFrame([(i, "x" if i < agree else "y", weak.get("score", 0.9), weak.get("preset"), weak.get("unknown")) for i in range(n)], seen)
        return tuple(identity.gate(exact, visual, size).first())

    assert verdict(100, 90, 2000) == (0.9, 100, 0.05, False)
    assert verdict(10, 10, 1000)[1:] == (10, 0.01, False)
    assert not verdict(60, 60, 100000)[3] and verdict(60, 60, 1000)[3]
    assert verdict(60, 60, 1000, score=0.5)[1] == verdict(60, 60, 1000, unknown=True)[1] == verdict(60, 60, 1000, preset=True)[1] == 0
    assert verdict(0, 0, 0) == (0.0, 0, 0.0, False)


def test_score(spark):
    truth = spark.createDataFrame([("a", 0, 0, "x"), ("a", 0, 1, "y"), ("a", 1, 0, "z"), ("b", 0, 0, "x")], "image string, row int, col int, item_id string")
    found = spark.createDataFrame([("a", 0, 0, "x"), ("a", 0, 1, "q"), ("a", 5, 5, "x"), ("b", 0, 0, "x")], "image string, row int, col int, item_id string")
    got = {r["image"]: tuple(r)[1:] for r in identity.score(truth, found).collect()}
    assert got["a"] == (3, 1, 1, 1, 1, 1 / 3, 1 / 3, 1 / 3) and got["b"][:5] == (1, 1, 0, 0, 0) and got[None][:5] == (4, 2, 1, 1, 1)


def test_ranking(spark):
    scores = spark.createDataFrame([("c", "x", 0.9), ("c", "x", 0.88), ("c", "y", 0.5), ("d", "x", 0.3)], "cell string, item_id string, score double")
    got = {r["cell"]: (r["item_id"], r["score"], round(r["margin"], 6)) for r in ranking.best_with_margin(scores, "cell").collect()}
    assert got == {"c": ("x", 0.9, 0.4), "d": ("x", 0.3, 0.3)}
    rng, rows, want = random.Random(0), [], []
    for u in range(20):
        balance = 3
        for i in range(60):
            d = rng.randrange(-4, 4)
            balance = max(0, balance + d)
            rows.append((u, i, d))
            want.append((u, i, balance))
    out = ranking.clamped_balance(spark.createDataFrame(rows, "u long, i long, d long"), "u", [F.col("i")], "d", F.lit(3))
    assert sorted((r["u"], r["i"], r["balance"]) for r in out.collect()) == want
    rows = spark.createDataFrame([(0, 1, 0, False), (0, 0, 1, True), (0, 0, 0, False), (1, 0, 0, False)], "panel int, row int, col int, keep boolean")
    assert [r["number"] for r in ranking.reading_order(rows).orderBy("keep", "place").collect()] == ["1", "2", "3", "K"]
    cells = spark.createDataFrame([("f", 0, 0, True), ("f", 0, 1, False), ("f", 1, 0, True)], "frame string, row int, col int, occupied boolean")
    assert [(r["done"], r["total"]) for r in ranking.running_share(cells, "frame", ["row", "col"], "occupied").orderBy("row", "col").collect()] == [(1, 2), (1, 2), (2, 2)]
    known = spark.createDataFrame([("a", 1.0, "x"), ("b", 1.0, "x"), ("c", 1.0, "x")], "f string, mtime double, v string")
    files = spark.createDataFrame([("a", 1.5, "n"), ("b", 2.0, "n"), ("d", 1.0, "n")], "f string, mtime double, v string")
    fresh = ranking.changed_files(files, known, "f", "mtime")
    assert {r["f"]: r["v"] for r in ranking.upsert(known, files, fresh, "f").collect()} == {"a": "x", "b": "n", "d": "n"}


def test_vectors(spark):
    rng = np.random.default_rng(0)
    t, m, c = rng.random((30, 48)) * 200, (rng.random((30, 48)) < 0.7).astype(float), rng.random((20, 48)) * 200
    unit, counts = vectors.finalise(t, m)
    got = vectors.masked_ncc(c, unit, m, counts)
    for i in range(20):
        for j in range(30):
            k = m[j] > 0
            assert abs(got[i, j] - np.corrcoef(c[i][k], t[j][k])[0, 1]) < 1e-6
    assert vectors.pair_correlation(c[0], m[0], c[0], m[0]) == pytest.approx(1) and vectors.pair_correlation(c[0], np.zeros(48), c[0], m[0]) == -1
    cells = spark.createDataFrame([(str(i), 1, 1, x.tolist()) for i, x in enumerate(c)], "cell_id string, w int, h int, vec array<double>")
    templates = spark.createDataFrame([(1, 1, j, f"i{j % 7}", t[j].tolist(), m[j].tolist()) for j in range(30)] + [(2, 1, 99, "big", [0.0] * 96, [1.0] * 96)], "w int, h int, template long, item_id string, vec array<double>, mask array<double>")
    out = vectors.score_cells(cells, templates).collect()
    assert len(out) == 600 and max(abs(r["score"] - got[int(r["cell_id"]), r["template"]]) for r in out) < 1e-9
    top = vectors.score_cells(cells, templates, top=3).collect()
    assert {(r["cell_id"], r["template"]) for r in top} == {(str(i), j) for i in range(20) for j in np.argsort(-got[i])[:3]}


def test_blocks_of_templates(spark, monkeypatch):
    monkeypatch.setattr(vectors, "GROUP_CELLS", 5)
    monkeypatch.setattr(vectors, "GROUP_TEMPLATES", 8)
    test_vectors(spark)


def test_shift_rescue_and_rerank(spark):
    scores = spark.createDataFrame([("c", 1, 0.5), ("c", 2, 0.6)], "cell_id string, template long, score double")
    moved = spark.createDataFrame([("c", 1, 0.9), ("c", 1, 0.2), ("c", 2, 0.1)], "cell_id string, template long, score double")
    assert {r["template"]: r["score"] for r in vectors.shift_rescue(scores, moved).collect()} == {1: 0.9, 2: 0.6}
    rng = np.random.default_rng(1)
    rows = [(i, 0, (rng.random(64) * 9).tolist()) for i in range(40)]
    rows += [(100, 0, rows[7][2]), (101, 5, rows[3][2])]
    df = spark.createDataFrame(rows, "id long, b int, vec array<double>").withColumn("mask", F.array_repeat(F.lit(1.0), 64)).withColumn("pool", vectors.pooled(F.col("vec"), 4))
    got = {r["id"]: (r["match_id"], round(r["score"], 6)) for r in vectors.shortlist_rerank(df.filter("id >= 100"), df.filter("id < 100"), "b").collect()}
    assert got == {100: (7, 1.0), 101: (None, -1.0)}


def test_rerank_of_a_table_in_itself(spark, monkeypatch):
    from larch.plans import catalogue

    rng = np.random.default_rng(3)
    vec = {i: (rng.random(64) * 9).tolist() for i in range(1, 130)}
    vec[100] = [x + 0.01 for x in vec[60]]  # the match of a query is a query as well, and not of its residue
    emb = spark.createDataFrame(list(vec.items()), "vec_id long, embedding array<double>")
    monkeypatch.setattr(catalogue, "load", lambda *_: emb)
    got = {r["id"]: (r["match_id"], r["score"]) for r in catalogue.q19_shortlist_rerank(spark, "").collect()}
    assert set(got) == {20, 40, 60, 80, 100, 120} and got[60][0] == 100 and got[100][0] == 60
    assert got[60][1] > 0.999 and all(m != i for i, (m, _) in got.items())


def test_periods(spark):
    rng = np.random.default_rng(2)
    for pitch in (52.5, 63.0):
        x = rng.random(900)
        x[np.rint(np.arange(11, 900, pitch)).astype(int)] += 30
        period, strength = series.period_of(x)
        assert abs(period - pitch) < 1 and strength > 1.6
    assert series.period_of(np.zeros(1000)) == (None, 0.0) and series.period_of(np.ones(20)) == (None, 0.0)
    y = np.ones(1200) * 0.1
    y[7:600:40] += 10
    y[615:1200:40] += 10
    spans = series.spans_of(y, 40)
    assert len(spans) == 2 and spans[0][0] == 0 and abs(spans[0][1] - 600) <= 80
    rows = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(y[:600])], "s string, pos long, value double")
    assert series.dominant_lag(series.autocorrelation(rows, "s", 24, 60), "s").first()["lag"] == 40
    assert series.phase(rows, "s", 40).first()["phase"] == 7
    assert abs(series.dominant_period(rows, "s", 24, 200).first()["period"] - 40) < 0.5
    coarse = spark.createDataFrame([("s", 40.25, 8)], "s string, period double, phase long")
    best = series.refine(rows, "s", coarse).first()
    assert best["period"] == 40.0 and round(best["origin"]) == 7


def slow_claim(cells, scores):
    """The rule again, by sets of cells."""
    full = {(r, c) for r, c, o in cells if o}
    rows, cols = max(r for r, _, _ in cells) + 1, max(c for _, c, _ in cells) + 1
    taken, out = set(), []
    for r, c in sorted(full):
        if (r, c) in taken:
            continue
        best = None
        for s in sorted((s for s in scores if s[0] == (r, c)), key=lambda s: (-s[1] * s[2], -s[1])):
            box = {(r + i, c + j) for i in range(s[2]) for j in range(s[1])}
            if r + s[2] > rows or c + s[1] > cols or box & taken or (len(box) > 1 and len(box & full) < 0.72 * len(box)):
                continue
            value = s[4] + (s[1] * s[2] - 1) * 0.012
            if best is None or value > best[0]:
                best = (value, s, box)
        if best and best[1][4] >= claims.least_score(*best[1][1:3]) and best[1][5] >= 0.04:
            taken |= best[2]
            out.append((r, c, *best[1][1:4]))
    return out


def test_claims(spark):
    rng = random.Random(4)
    cells = [(r, c, rng.random() < 0.8) for r in range(8) for c in range(9)]
    scores = [((r, c), w, h, f"i{rng.randrange(5)}", rng.random(), rng.random() * 0.3) for r, c, _ in cells for w, h in ((1, 1), (2, 1), (1, 2), (2, 2)) if rng.random() < 0.7]
    a = spark.createDataFrame([("f", 0, *x) for x in cells], "frame_id string, panel int, row int, col int, occupied boolean")
    b = spark.createDataFrame([("f", 0, *s[0], *s[1:], False, False, False) for s in scores], "frame_id string, panel int, row int, col int, w int, h int, item_id string, score double, margin double, cached boolean, exact boolean, rotated boolean")
    got = [(r["row"], r["col"], r["w"], r["h"], r["item_id"]) for r in claims.claim(a, b).collect()]
    assert got == slow_claim(cells, scores) and len(got) > 10


def test_labels_in_claims():
    import pandas as pd

    cells = pd.DataFrame([(0, 0, True), (0, 1, True)], columns=["row", "col", "occupied"])
    scores = pd.DataFrame([(0, 0, 2, 1, "ncc", 0.6, 0.01, False, False, False)], columns=["row", "col", "w", "h", "item_id", "score", "margin", "cached", "exact", "rotated"])
    label = lambda w, item, score, text="long text", inside=True: pd.DataFrame([(0, 0, w, 1, item, score, text, inside)], columns=["row", "col", "w", "h", "item_id", "score", "text", "contained"])
    run = lambda labels, mode="full": [(r[2], r[4], r[8]) for r in claims.claim_panel(cells, scores, labels, mode)]
    assert run(None) == []  # ambiguous
    assert run(label(2, "ncc", 80)) == [(2, "ncc", "label+score")] == run(label(2, "ncc", 80), "agree")
    assert run(label(2, "other", 80)) == [] and run(label(2, "other", 85)) == [(2, "other", "label")]
    assert run(label(2, "other", 85, inside=False)) == [] == run(label(2, "other", 85), "agree") == run(label(2, "other", 95, "Li"))
    assert run(label(1, "single", 90)) == [(1, "single", "label")]
    scores["exact"] = True
    scores["score"] = 0.8
    assert run(None) == [(2, "ncc", "exact")] and run(label(2, "other", 90)) == [(2, "ncc", "exact")]


def test_spans_of_flat_series(spark):
    """Series without any span, of whatever key type, give no rows and no error."""
    flat = [(k, i, 1.0) for k in ("a", "b") for i in range(200)]
    assert series.phase_spans(spark.createDataFrame(flat, "k string, pos long, value double"), "k", 24).collect() == []
    assert series.phase_spans(spark.createDataFrame([(1, 0, 1.0)], "k long, pos long, value double"), "k", 24).collect() == []
