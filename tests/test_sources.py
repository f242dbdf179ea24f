import json
import threading
import time

import pytest

from larch.functions import pricing
from larch.operators import identity
from larch.plans import scenarios
from larch.sources import html, schemas, snapshots, stores
from larch.sources.background import BackgroundTable
from larch.streaming import polling


def put(tmp_path, name, value):
    at = tmp_path / name
    at.write_text(value if isinstance(value, str) else json.dumps(value))
    return str(at)


def test_snapshots(spark, tmp_path):
    doc = {"timestamp": 5.0, "items": [{"id": "a", "name": "A", "shortName": "s", "basePrice": 10, "types": ["gun"], "sellFor": [{"vendor": {"name": "T"}, "priceRUB": 7}]}, {"id": "b"}]}
    items = snapshots.items(spark, put(tmp_path, "prices.json", doc))
    rows = items.orderBy("pos").collect()
    assert [(r["id"], r["pos"], r["snapshot_ts"]) for r in rows] == [("a", 0, 5.0), ("b", 1, 5.0)]
    assert items.select(pricing.best_offer("sellFor").alias("o")).first()["o"]["price"] == 7
    doc = {"timestamp": 1.0, "tasks": [{"id": "t", "name": "T", "trader": {"name": "X"}, "objectives": [{"id": "o", "type": "giveItem", "count": 2, "foundInRaid": True, "item": {"id": "a", "name": "A", "shortName": "s"}}]}], "hideoutStations": None}
    tasks, stations = snapshots.catalogue(spark, put(tmp_path, "tasks.json", doc))
    assert tasks.count() == 1 and stations.count() == 0
    bad, _ = snapshots.catalogue(spark, put(tmp_path, "bad.json", {"errors": [{"message": "no"}], "tasks": []}))
    with pytest.raises(Exception, match="catalogue: no"):
        bad.collect()
    assert snapshots.progress(spark, str(tmp_path / "missing.json")).count() == 1
    p = snapshots.progress(spark, put(tmp_path, "progress.json", {"completed_tasks": ["t"], "have": {"a": 1}}))
    assert [r["id"] for r in snapshots.completed(p, "completed_tasks").collect()] == ["t"] and snapshots.have(p).first()["have"] == 1
    keep = {"categories": [{"id": "c", "label": "C", "items": [{"id": "e", "name": "N", "aliases": ["x"], "acquired": True}]}]}
    assert [(r["category_id"], r["pos"], r["name"]) for r in snapshots.keep_entries(spark, put(tmp_path, "keep.json", keep)).collect()] == [("c", 0, "N")]
    view, _, _ = scenarios.tasks_view(tasks, stations, snapshots.completed(p, "completed_hideout"), snapshots.completed(p, "completed_hideout"), snapshots.have(p), False)
    assert [(r["item_id"], r["remaining"]) for r in view.collect()] == [("a", 1)]


def test_icons_and_releases(spark, tmp_path):
    folder = tmp_path / "icons"
    folder.mkdir()
    (folder / "1.png").write_bytes(b"abc")
    (folder / "note.txt").write_bytes(b"abc")
    put(folder, "index.json", {"-5": 1, "7": 2})
    files = snapshots.icon_files(spark, str(folder)).collect()
    assert [(r["filename"], r["length"]) for r in files] == [("1.png", 3)] and abs(files[0]["mtime"] - time.time()) < 600
    assert {r["hash"]: r["file_number"] for r in snapshots.icon_index(spark, str(folder / "index.json")).collect()} == {-5: 1, 7: 2}
    assert snapshots.first_folder(spark, None, str(tmp_path / "no"), str(folder)) == str(folder)
    assert snapshots.associations(spark, str(tmp_path / "none.json")).count() == 0
    got = snapshots.associations(spark, put(tmp_path, "map.json", {"1.png": {"item_id": "a", "score": 0.9}})).first()
    assert (got["filename"], got["item_id"], got["score"]) == ("1.png", "a", 0.9)
    doc = {"tag_name": "v1.2", "html_url": "u", "assets": [{"name": "x"}, {"name": "app.exe", "browser_download_url": "d"}]}
    assert tuple(snapshots.release(spark, put(tmp_path, "r.json", doc), "app.exe").first()) == ("v1.2", "u", "d")


def test_stores(spark, tmp_path):
    at = str(tmp_path / "t")
    assert snapshots.templates(spark, at) is None
    df = spark.createDataFrame([(1, 1, 0, "a", [0.0], [1.0]), (1, 2, 1, "b", [0.0], [1.0])], "w int, h int, template long, item_id string, vec array<float>, mask array<float>")
    stores.save_templates(df, at)
    stores.save_templates(df.limit(1), at)
    assert snapshots.templates(spark, at).count() == 1 and snapshots.templates(spark, at, 5) is None
    exact = spark.createDataFrame([(i, "x") for i in range(60)], "key long, item_id string")
    seen = exact.selectExpr("key", "item_id", "0.9D as score", "false as preset", "false as unknown")
    assert stores.status(spark, str(tmp_path / "s")).count() == 0
    stores.save_status(exact, seen, 1000, "item", 5.0, str(tmp_path / "s"))
    assert tuple(stores.status(spark, str(tmp_path / "s")).first()) == ("item", True, 1.0, 60, 0.06, 5.0)
    stores.emit_truth(spark.createDataFrame([(0, 0, 1, 1, "a", False)], "col int, row int, w int, h int, item_id string, rotated boolean"), str(tmp_path / "truth"))
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        stores.emit_truth(spark.createDataFrame([(0, 0, 1, 1, "a", False)], "col int, row int, w int, h int, item_id string, rotated boolean"), str(tmp_path / "truth"))
    for k in range(5):
        (tmp_path / "ring" / f"b{k}").mkdir(parents=True)
    assert stores.ring(spark, str(tmp_path / "ring")) == ["b1", "b0"] and len(list((tmp_path / "ring").iterdir())) == 3


def test_read_through(spark, tmp_path):
    at, calls = str(tmp_path / "cache"), []

    def fetch():
        calls.append(1)
        if len(calls) == 3:
            raise OSError("down")
        return spark.createDataFrame([(len(calls),)], "n long")

    read = lambda now, **k: stores.read_through(spark, at, now, 10.0, fetch, **k)
    assert read(0.0, allow_fetch=False) is None
    assert read(0.0).first()["n"] == 1 and read(9.9).first()["n"] == 1 and len(calls) == 1
    assert read(50.0, allow_fetch=False).first()["n"] == 1
    assert read(10.0).first()["n"] == 2
    assert read(99.0, stale_if_error=True).first()["n"] == 2
    assert read(99.0).first()["n"] == 4


def test_background_build(spark, tmp_path):
    go, calls = threading.Event(), []

    def build(note):
        calls.append(1)
        note(1, 3)
        assert go.wait(60)
        if len(calls) == 2:
            raise OSError("down")
        return spark.createDataFrame([(len(calls),)], "n long")

    table = BackgroundTable(spark, str(tmp_path / "b"), build)
    assert table.get() is None and table.progress() == {"running": False, "done": 0, "total": 0, "error": None}
    assert table.start() and not table.start() and table.get() is None
    go.set()
    table.wait()
    assert table.get().first()["n"] == 1 and table.progress() == {"running": False, "done": 3, "total": 3, "error": None} and len(calls) == 1
    assert table.start()
    table.wait()
    assert table.progress()["error"] == "down" and table.get().first()["n"] == 1
    assert BackgroundTable(spark, str(tmp_path / "b"), build).get().first()["n"] == 1


TABLE = "<table><tr><th>Prestige level</th><th>Min PMC level</th><th>Quests</th><th>Objectives</th><th>Skills</th><th>Hideout</th><th>Items to hand in</th></tr>{}</table>"


def level(n):
    return f"<tr><td>Prestige {n}</td><td>{15 + n - 1}</td><td>q<br>r</td><td>o</td><td>s</td><td>h</td><td>500,000 <b>roubles</b></td></tr>"


def test_html(spark):
    nested = "<p>x</p><table><tr><td>a <table><tr><td>no</td></tr></table> b</td><td>c&amp;d</table><table><tr><td>2</table>"
    assert html.parse_tables(nested) == [[["a b", "c&d"]], [["2"]]] and html.parse_tables(None) == []
    pages = spark.createDataFrame([(1, TABLE.format("".join(map(level, range(1, 7))))), (2, "")], "k long, h string")
    got = html.levels(html.tables(pages, "k", "h"), "k").orderBy("level").collect()
    assert len(got) == 6 and (got[0]["pmc_level"], got[0]["quests"], got[0]["items"]) == ("15", "q r", "500,000 roubles")
    few = spark.createDataFrame([(1, TABLE.format("".join(map(level, range(1, 4)))))], "k long, h string")
    with pytest.raises(Exception, match="only 3 levels"):
        html.levels(html.tables(few, "k", "h"), "k").collect()
    rows = "<tr><th>Pic</th><th>Item name</th></tr>" + "".join(f"<tr><td>p</td><td>Item {i}</td></tr>" for i in range(20)) + "<tr><td>extra</td><td>p</td><td>Item 20</td></tr><tr><td>only</td></tr>"
    page = spark.createDataFrame([(1, f"<table>{rows}</table>")], "k long, h string")
    names = html.named_column(html.tables(page, "k", "h"), "k", "item name", 20).orderBy("row").collect()
    assert [r["name"] for r in names] == [f"Item {i}" for i in range(21)]
    with pytest.raises(Exception, match="only 21 names"):
        html.named_column(html.tables(page, "k", "h"), "k", "item name", 22).collect()
    lists = spark.createDataFrame([(1, "<ul><li>a <a href='x'>b</a></li><li> </li><li>c</li></ul>"), (2, None)], "k long, h string")
    assert [(r["place"], r["item"]) for r in html.list_items(lists, "k", "h").collect()] == [(0, "a b"), (2, "c")]


def test_streaming(spark, tmp_path):
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    df = spark.createDataFrame([(1.0, 1, "x"), (2.0, 1, None)], polling.RESULTS)
    df.write.parquet(source)
    work = lambda b: b.withColumn("seen", b["ts"] + 1)
    for _ in range(2):  # a second run finds nothing new
        polling.scan_files(spark, source, polling.RESULTS, work, out, check).awaitTermination(60)
    df.write.mode("append").parquet(source)
    polling.scan_files(spark, source, polling.RESULTS, work, out, check).awaitTermination(60)
    rows = spark.read.parquet(out)
    assert rows.count() == 4
    assert [r["ts"] for r in polling.latest(rows.drop("batch"), 0.5).collect()] == [1.0, 1.0] and polling.latest(rows, 1.0).count() == 0
    ran = []
    assert polling.upkeep(10.0, None, 5, lambda: ran.append(1)) and not polling.upkeep(10.0, 6.0, 5, lambda: ran.append(1)) and ran == [1]


def test_schema_struct():
    assert schemas.struct("a string, b array<struct<x:int,y:int>>") == "struct<a:string,b:array<struct<x:int,y:int>>>"
    assert identity.STRONG > identity.PRESET


def test_malformed_tables():
    parse = html.parse_tables
    assert parse("<table><td>out</td><tr><td>a<td>b</td></tr><tr></tr><tr><td>c</table>") == [[["b"], [], ["c"]]]
    assert parse("<table><tr><td>lost</td><tr><td>x</td></tr></table><table><tr><td>open</td></tr>") == [[["x"]]]
    assert parse("</table><table></table>") == [[]]
