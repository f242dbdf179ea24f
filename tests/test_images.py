import numpy as np
import pytest

from larch.functions import predicates
from larch.operators import association, images, panels, scans

BACK, LINE = (40, 40, 42), (90, 90, 90)


def frame(height=90, width=90):
    return np.full((height, width, 3), BACK, np.uint8)


def grid(cell=63.0, x=0.0, y=0.0):
    return {"cell_w": cell, "cell_h": cell, "origin_x": x, "origin_y": y}


def test_corner_mark():
    def mark(rows=None, cols=None, g=None, height=90):
        f = frame(height)
        if rows:
            f[rows[0] : rows[1], cols[0] : cols[1]] = 200
        return images.corner_mark(f, g or grid(), 0, 0, 1, 1)

    assert mark((2, 6), (50, 55)) is True
    assert mark() is False
    assert mark((2, 6), (45, 46)) is None  # touches the window's left edge
    assert mark((0, 18), (46, 63)) is None  # too much
    assert mark((2, 4), (50, 52)) is None  # too little
    assert mark(g=grid(x=1000.0)) is None


def test_pixels():
    x = np.zeros((4, 4, 4), np.uint8)
    x[:, :, :3], x[:2, :, 3] = 200, 255
    out = images.on_background(x, (10, 20, 30))
    assert out[0, 0].tolist() == [200] * 3 and out[3, 0].tolist() == [10, 20, 30]
    assert images.foreground(x).sum() == 8 and images.foreground(x[:, :, :3]).sum() == 0
    y = np.arange(16, dtype=np.uint8).reshape(4, 4)
    assert images.resize_area(y, 2, 2).tolist() == [[2, 4], [10, 12]]
    assert images.resize_nearest(y, 2, 2).tolist() == [[0, 2], [8, 10]]
    assert np.allclose(images.resize_area(np.ones((5, 7)) * 3.5, 3, 4), 3.5)
    b = images.blank(np.full((64, 64, 3), 9, np.uint8))
    assert (b[:13] == images.BACKGROUND).all() and (b[46:, 46:] == images.BACKGROUND).all() and (b[20, 20] == 9).all()
    half = images.blank(np.full((32, 32, 3), 9, np.uint8), 32)
    assert (half[:6] == images.BACKGROUND).all() and (half[6, 0] == 9).all()
    p = images.pooled(np.random.default_rng(0).integers(0, 255, (40, 40, 3)).astype(np.uint8))
    assert abs(np.linalg.norm(p) - 1) < 1e-9 and abs(p.sum()) < 1e-9
    assert len(list(images.rotations(y, 2, 1))) == 3 and len(list(images.rotations(y, 1, 1))) == 1
    assert images.template(x[:, :, :3], 1, 1, (1, 2, 3)) is None  # nothing stands out
    assert images.tint("red") != images.tint(None) == images.tint("unknown")
    assert images.cell_block(frame(), grid(), 2, 0, 1, 1) is None
    assert images.is_empty(frame(), grid(), 0, 0) and images.is_empty(frame(), grid(), 5, 5)
    f = frame()
    f[20:40, 20:40] = 180
    assert not images.is_empty(f, grid(), 0, 0)


def icon(rng, w, h, px=63):
    """A patterned picture with a transparent border."""
    small = rng.integers(30, 200, (6 * h, 6 * w, 3))
    x = np.kron(small, np.ones((px // 6, px // 6, 1))).astype(np.uint8)
    x = images.resize_area(x, w * px, h * px)
    a = np.full((h * px, w * px, 1), 255, np.uint8)
    a[:4], a[-4:], a[:, :4], a[:, -4:] = 0, 0, 0, 0
    return np.concatenate([x, a], axis=2)


def stash(rng, placed, cols=8, rows=7, px=63, x0=20, y0=15):
    f = np.full((y0 + rows * px + 40, x0 + cols * px + 40, 3), images.BACKGROUND, np.uint8)
    f[:, :] = np.clip(f + rng.integers(-1, 2, f.shape), 0, 255)
    for c, r, picture in placed:
        h, w = picture.shape[:2]
        f[y0 + r * px : y0 + r * px + h, x0 + c * px : x0 + c * px + w] = images.on_background(picture, images.NEUTRAL)
    for k in range(cols + 1):
        f[y0 : y0 + rows * px + 1, x0 + k * px] = 110
    for k in range(rows + 1):
        f[y0 + k * px, x0 : x0 + cols * px + 1] = 110
    return f


def row(key, f):
    return (key, f.shape[0], f.shape[1], f.shape[2], f.tobytes())


FRAMES = "frame_id string, height int, width int, channels int, data binary"


def test_grid_and_panels(spark):
    rng = np.random.default_rng(0)
    f = stash(rng, [])
    found = panels.detect_grid(f)
    assert abs(found["cell_w"] - 63) < 0.3 and abs(found["cell_h"] - 63) < 0.3 and abs(found["origin_x"] % 63 - 20) < 1.5 and panels.plausible(found)
    got = panels.detect_panels(f)
    assert len(got) == 1 and abs(got[0]["cell_w"] - 63) < 0.3
    out = panels.resolve_panels(spark.createDataFrame([row("a", f), row("b", frame(300, 300))], FRAMES)).collect()
    assert {(r["frame_id"], r["src"]) for r in out} == {("a", "panels"), ("b", "fallback")}


def test_panel_overlaps():
    def p(x0, y0, x1, y1, s=2.0):
        return {"x0": x0, "y0": y0, "x1": x1, "y1": y1, "strength": s, "origin_x": float(x0 + 10), "origin_y": float(y0 + 10), "cell_w": 20.0, "cell_h": 20.0}

    assert len(panels.drop_contained([p(0, 0, 100, 100, 3), p(10, 10, 50, 50), p(80, 0, 200, 100)])) == 2
    a, b = panels.trim([p(0, 0, 100, 100), p(80, 0, 200, 100)])
    assert a["x1"] == 88 and b["x0"] == 88 and a["x1"] <= b["x0"]
    a, b = panels.trim([p(0, 0, 100, 100), p(0, 90, 100, 200)])
    assert a["y1"] == 98 == b["y0"]
    assert not panels.large_enough(p(0, 0, 30, 100))


@pytest.mark.parametrize("shifts", [0, 1])
def test_scan_finds_what_was_placed(spark, shifts):
    rng = np.random.default_rng(1)
    pictures = {"one": (icon(rng, 1, 1), 1, 1), "two": (icon(rng, 1, 1), 1, 1), "wide": (icon(rng, 2, 1), 2, 1), "rare": (icon(rng, 1, 1), 1, 1)}
    items = spark.createDataFrame(
        [(k, k, w, h, None, (x.shape[0], x.shape[1], 4, x.tobytes())) for k, (x, w, h) in pictures.items()],
        "item_id string, name string, width int, height int, colour string, image struct<height:int,width:int,channels:int,data:binary>",
    )
    templates = images.build_templates(items, slot=32)
    assert templates.count() == 3 + 3  # the wide one in both turns as well
    f = stash(rng, [(1, 1, pictures["one"][0]), (3, 2, pictures["wide"][0]), (6, 4, pictures["two"][0])])
    frames = spark.createDataFrame([row("f", f)], FRAMES)
    at = spark.createDataFrame([("f", 0, 63.0, 63.0, 20.0, 15.0, 3.0, 0, 0, f.shape[1], f.shape[0], "panels")], panels.PANELS)
    got = {(r["col"], r["row"]): (r["item_id"], r["w"], r["h"], r["rotated"], r["px"], r["fir"]) for r in scans.scan(frames, at, templates, 32, shifts).collect()}
    assert {k: v[:5] for k, v in got.items()} == {(1, 1): ("one", 1, 1, False, 83), (3, 2): ("wide", 2, 1, False, 209), (6, 4): ("two", 1, 1, False, 398)}


def test_template_sources_and_descriptors(spark):
    rng = np.random.default_rng(2)
    x = icon(rng, 1, 1)
    pic = "item_id string, height int, width int, channels int, data binary"
    base = spark.createDataFrame([("a", 63, 63, 4, x.tobytes()), ("b", 63, 63, 3, x[:, :, :3].tobytes())], pic)
    other = spark.createDataFrame([("b", 63, 63, 3, x[:, :, :3].tobytes())], pic)
    items = spark.createDataFrame([("a", "A", 1, 1, None), ("b", "B", 1, 1, None), ("c", "C", 1, 1, None)], "item_id string, name string, width int, height int, colour string")
    out = images.choose_source(items, base, other)
    assert {r["item_id"]: r["image"]["channels"] for r in out.collect()} == {"a": 4, "b": 3}
    d = images.describe(out.selectExpr("1L as id", "item_id", "name", "image")).first()
    assert (d["w"], d["h"], len(d["pool"]), len(d["vec"])) == (1, 1, 256, 64 * 64)


def test_association(spark):
    rng = np.random.default_rng(3)
    a, b, wide = icon(rng, 1, 1), icon(rng, 1, 1), icon(rng, 2, 1)
    pic = lambda x: (x.shape[0], x.shape[1], x.shape[2], x.tobytes())
    image = "image struct<height:int,width:int,channels:int,data:binary>"
    refs = spark.createDataFrame([(1, "a", "A", pic(a)), (2, "b", "B", pic(b)), (3, "w", "W", pic(wide))], f"id long, item_id string, name string, {image}")
    files = spark.createDataFrame([("1.png", 5.0, pic(a)), ("2.png", 5.0, pic(wide)), ("3.png", 5.0, pic(icon(rng, 1, 1))), ("4.png", 5.0, pic(icon(rng, 3, 1))), ("5.png", 5.0, pic(b))], f"filename string, mtime double, {image}")
    known = spark.createDataFrame([("5.png", "old", "Old", 0.9, 5.5, False, False, 1, 1, False), ("9.png", "gone", "Gone", 0.9, 5.0, False, False, 1, 1, False)], association.ROW)
    exact = spark.createDataFrame([("3.png", "x")], "filename string, item_id string")
    out = association.associate(files, refs, known, exact)
    got = {r["filename"]: (r["item_id"], r["unknown"], r["exact"], r["W"]) for r in out.collect()}
    assert got == {"1.png": ("a", False, False, 1), "2.png": ("w", False, False, 2), "3.png": ("x", False, True, 1), "4.png": (None, True, False, 3), "5.png": ("old", False, False, 1)}
    assert {r["kind"]: r["n"] for r in association.counters(out).collect()} == {"strong": 3, "exact": 1, "unknown": 1}
    items = spark.createDataFrame([("a", "A", None), ("w", "W", "red"), ("x", "X", None)], "id string, name string, colour string")
    made = association.icon_templates(out, files, items, 32)
    assert {(r["item_id"], r["source"], r["w"], r["h"]) for r in made.collect()} == {("a", "cache", 1, 1), ("w", "cache", 2, 1), ("w", "cache", 1, 2), ("x", "cache-exact", 1, 1)}
    assert tuple(association.summary(made).first()) == (3, 5)
    full = association.icon_templates(out, files, items)
    small = images.at_pitch(full, 32)
    assert small.count() == 5 and len(small.filter("item_id = 'w' and w = 2").first()["vec"]) == 2 * 32 * 32 * 3


def test_small_reports(spark):
    levels = spark.createDataFrame([(1,), (2,)], "level int")
    assert association.next_level(levels, 1).first()["level"] == 2 and association.next_level(levels, 2).count() == 0
    stations = spark.createDataFrame([("s", [("a",), ("b",)])], "name string, levels array<struct<id:string>>")
    assert tuple(association.sections_done(stations, spark.createDataFrame([("a",), ("a",)], "id string")).first()) == ("s", 1, 2)
    assert tuple(association.score_summary(spark.createDataFrame([(50.0,), (70.0,)], "score double")).first()) == (2, 50.0, 70.0, 60.0)


def test_predicates(spark):
    rows = spark.createDataFrame([(["gun", "x"], "red", "T"), (["mods"], None, "Q"), (None, "odd", None), ([], "", "T")], "types array<string>, colour string, trader string")
    got = rows.select(predicates.is_target("types").alias("t"), predicates.tint_of("colour").alias("c"), predicates.badge_of("trader", {"T": (1, 2, 3)}).alias("b")).collect()
    assert [r["t"] for r in got] == [False, True, True, True]
    assert [r["c"] for r in got] == [[29, 32, 49]] + [[54, 54, 53]] * 3
    assert [r["b"] for r in got] == [[1, 2, 3], [180, 120, 20], [180, 120, 20], [1, 2, 3]]
    shapes = spark.createDataFrame([(1, 2, "s", "n"), (2, 2, "n", "n"), (1, 1, "", None)], "w int, h int, s string, n string").select(predicates.footprints("w", "h").alias("f"), predicates.names_of("s", "n").alias("n")).collect()
    assert [len(r["f"]) for r in shapes] == [2, 1, 1] and [r["n"] for r in shapes] == [["s", "n"], ["n"], []]
    active = spark.createDataFrame([(True, True), (False, False), (None, True)], "done boolean, req boolean").select(predicates.is_active("done", "req", True).alias("a"), predicates.is_active("done", "req", False).alias("b")).collect()
    assert [tuple(r) for r in active] == [(False, False), (False, True), (True, True)]
