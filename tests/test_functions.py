from pyspark.sql import functions as F

from larch.functions import geometry, hashing, pricing, similarity, text, versions


def one(spark, schema, rows, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_list_price_and_fee(spark):
    pairs = [(0, 1), (1, 1), (420, 419), (421, 420), (999, 420), (1000, 420), (1419, 420), (1420, 1420), (25000, 24420), (100419, 99420), (100420, 100420)]
    assert [r[0] for r in one(spark, "t long", [(t,) for t, _ in pairs], pricing.list_price("t"))] == [p for _, p in pairs]
    fees = [(0, 100, 0), (None, 5, 0), (1000, 1000, 60), (10000, 20420, 1137), (10000, 45420, 3510), (50000, 45420, 2875)]
    assert [r[0] for r in one(spark, "b long, p long", [f[:2] for f in fees], pricing.listing_fee("b", "p"))] == [f[2] for f in fees]


def test_recommendation(spark):
    rows = [(10000, 45800, 0, 20000), (10000, 45800, 0, 35000), (10000, 0, 31000, 20000), (10000, 0, 0, 20000), (10000, 45800, 1, 0), (10000, None, None, 1)]
    got = one(spark, "b long, l long, a long, t long", rows, pricing.recommendation("b", "l", "a", F.lit("x"), "t").alias("r"))
    got = [(r[0]["flea_list"], r[0]["flea_net"], r[0]["recommend"], r[0]["reason"]) for r in got]
    assert got == [
        (45420, 41910, "flea", "+21,910 over trader after fees"), (45420, 41910, "trader", "Flea net 41,910 not 10k+ above trader"), (30420, 28483, "trader", "Flea net 28,483 not 10k+ above trader"),
        (None, None, "trader", "No flea data"), (None, None, "trader", "No trader data"), (None, None, "trader", "No flea data"),
    ]


def test_best_offer(spark):
    schema = "o array<struct<vendor:struct<name:string>,priceRUB:bigint>>"
    offer = lambda *x: [((n,), p) for n, p in x]
    rows = [(offer(("Flea Market", 900), ("A", 500), ("B", 500)),), ([],), (None,), (offer(("A", None), ("B", 0)),), (offer(("A", 1), ("B", 3), ("C", 2)),)]
    got = [(r[0]["name"], r[0]["price"]) for r in one(spark, schema, rows, pricing.best_offer("o"))]
    assert got == [("A", 500), (None, 0), (None, 0), (None, 0), ("B", 3)]


def test_versions(spark):
    rows = ["0.3.1", "v0.3.1", "V0.3.1", "0.3", "v0.3.0-beta1", "garbage", "", None]
    got = [r[0] for r in one(spark, "v string", [(x,) for x in rows], versions.version("v"))]
    assert got == [[0, 3, 1]] * 3 + [[0, 3], [0, 3, 0], None, None, None]
    pairs = [("0.4.0", "0.3.1", True), ("0.3.1", "0.3.1", False), ("0.3.0", "0.3.1", False), ("v0.4.0", "0.3.1", True), ("0.4", "0.3.1", True), ("0.3", "0.3.1", False), ("x", "0.3", False), ("1.0", None, False), ("1.0.0", "1", False)]
    assert [r[0] for r in one(spark, "a string, b string", [p[:2] for p in pairs], versions.is_newer("a", "b"))] == [p[2] for p in pairs]


def wrap(x):
    x &= 0xFFFFFFFF
    return x - 2**32 if x >= 2**31 else x


def slow_hash(s):
    halves = [5381, 5381]
    for i, c in enumerate(s):
        halves[i % 2] = wrap(wrap(halves[i % 2] * 33) ^ ord(c))
    return wrap(halves[0] + halves[1] * 1566083941)


def test_hashes(spark):
    texts = ["", "a", "ab", "abc", "Hello", "test-item-id-123", "5c0e3f8386f7745e5f0c8bcf", "x" * 37, "ñé漢"]
    got = one(spark, "s string", [(t,) for t in texts], hashing.string_hash("s"), hashing.item_hash("s"))
    assert got == [(slow_hash(t), wrap(17 ^ (slow_hash(t) ^ 0))) for t in texts]
    numbers = [0, 1, -1, 2**31, 2**31 - 1, -(2**31), 2**32, -(2**32) - 5, 5381 * 1566083941]
    assert [r[0] for r in one(spark, "n long", [(n,) for n in numbers], hashing.int32("n"))] == [wrap(n) for n in numbers]
    assert one(spark, "n int", [(0,), (30,)], hashing.magazine_salt("n")) == [(92,), (212,)]


def test_tokens_and_text(spark):
    benelli, pmag = "Benelli M3 Super 90 charging handle", "PMAG 30 GEN M3 magazine"
    rows = [("gen m3", benelli), ("pmag 30 gen m3", pmag), ("", benelli), ("   ", benelli), ("benel m3", benelli), ("eli m3", benelli), (None, benelli)]
    assert [r[0] for r in one(spark, "a string, b string", rows, text.tokens_contained("a", "b"))] == [False, True, False, False, True, False, False]
    rows = [("  |~ Salewa\n kit ",), ("#12",), ("ñandú",), ("--",)]
    assert [r[0] for r in one(spark, "a string", rows, text.clean_label("a"))] == ["Salewa  kit", "#12", "ñandú", ""]
    assert one(spark, "a string", [("Level 12 of 5",), ("none",)], text.first_integer("a")) == [(12,), (None,)]
    assert one(spark, "m map<string,string>", [({"The Items": "x", "other": "y"},), ({},)], text.field_like("m", "item")) == [("x",), (None,)]
    assert one(spark, "h long, n long", [(1, 3), (5, 0), (9, 3), (1, 200)], text.percent_done("h", "n")) == [(33,), (0,), (100,), (1,)]
    assert one(spark, "m double", [(59.4,), (90.0,)], text.age_label("m")) == [("59m",), ("2h",)]
    assert one(spark, "i array<struct<count:int,name:string,fir:boolean>>", [([(2, "a", True), (1, "b", False)],)], text.item_list("i")) == [("2× a (FIR) · 1× b",)]
    assert one(spark, "q string", [("1",), ("0",), ("False",)], text.is_on("q")) == [(True,), (False,), (False,)]
    assert one(spark, "f string, t long, n int", [("A — B", 4, 3), (None, 2, 1)], text.needed_reason("f", "t", "n")) == [("Needed: A — B (×4) +2 more",), ("Needed: tasks (×2)",)]


def test_similarity(spark):
    assert similarity.lcs("abcdef", "acf") == 3 and similarity.lcs("", "a") == 0
    assert similarity.indel("kitten", "sitting") == 200 * 4 / 13
    old, new, other = (similarity.plain(x) for x in ("Press pass (NoiceGuy)", "Press pass (issued for NoiceGuy)", "Golden rooster figurine"))
    assert similarity.token_set(old, new) == 100 and similarity.token_set(new, other) < 45
    assert similarity.weighted("abc", "abc") == 100 and similarity.weighted("", "abc") == 0
    got = one(spark, "a string, b string", [("ab", "ab"), ("ab", None)], similarity.indel_ratio(F.col("a"), F.col("b")), similarity.token_set_ratio(F.col("a"), F.col("b")))
    assert got == [(100.0, 100.0), (None, None)]


def test_geometry(spark):
    assert one(spark, "p int", [(64,), (127,), (1,), (190,)], geometry.slot_size("p")) == [(1,), (2,), (1,), (3,)]
    assert one(spark, "p double", [(10.0,), (52.5,), (99.0,)], geometry.slot_pixels("p")) == [(16,), (52,), (64,)]
    grid = "g struct<cell_w:double,cell_h:double,origin_x:double,origin_y:double,strength:double>"
    rows = [((52.5, 52.5, 0.5, 0.0, None),), ((52.5, 60.0, 0.0, 0.0, None),), ((52.5, 52.5, 0.0, 0.0, 1.5),), ((10.0, 10.0, 0.0, 0.0, 5.0),), (None,)]
    assert [r[0] for r in one(spark, grid, rows, geometry.valid_grid(F.col("g")))] == [True, False, False, False, False]
    r = one(spark, grid, rows[:1], geometry.cell_rect(F.col("g"), F.lit(1), F.lit(1), F.lit(2), F.lit(1)))[0][0]
    assert tuple(r) == (53, 52, 158, 105)
    region = "r struct<x0:int,y0:int,x1:int,y1:int>"
    rows = [((10, 20, 60, 50),), ((300, 0, 400, 10),), ((190, 90, 250, 150),), ((-5, -5, 0, 9),)]
    got = [r[0] and tuple(r[0]) for r in one(spark, region, rows, geometry.crop(F.col("r"), F.lit(100), F.lit(200)))]
    assert got == [(10, 20, 60, 50), None, (190, 90, 200, 100), None]
    assert one(spark, "w int, h int", [(1, 1), (1, 2), (2, 2)], geometry.least_score("w", "h")) == [(0.35,), (0.4,), (0.5,)]
    assert one(spark, "p double", [(45.0,), (30.0,), (20.0,)], geometry.label_mode("p")) == [("full",), ("agree",), ("off",)]
