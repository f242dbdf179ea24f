import hashlib
import random

import numpy as np

from larch.llm import secrets


FILLER = ["the", "house", "verification", "internationalisation", "of", "Zusammenarbeitsvertrag", "market", "river", "cloud"]


def held_out(rng, n):
    """(doc_id, text, value, is_secret): made by other rules than the built-in findings, half of them false positives."""
    rows = []
    pick = lambda alphabet, k: "".join(rng.choice(alphabet) for _ in range(k))
    for i in range(n):
        filler = " ".join(rng.choice(FILLER) for _ in range(20))
        kind = i % 10
        if kind < 3:
            value = pick("0123456789abcdef", 40)
            text = f'{filler} {rng.choice(["token", "secret", "api_key"])} = "{value}" {filler}'
        elif kind == 3:
            value = pick("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789", 24)
            text = f"{filler}\nDB_PASSWORD={value}\n{filler}"
        elif kind == 4:
            value = rng.choice(["Tr0ub4dor&", "hunter2x!", "s3cr3tPw"]) + pick("0123456789!$", 3)
            text = f"{filler} passwd: '{value}' {filler}"
        elif kind == 5:
            value = pick("0123456789abcdef", 40)
            text = f"{filler} commit {value}\n{filler}"
        elif kind == 6:
            value = f"src/main/java/org/apache/Commons{rng.randrange(9)}Util{rng.randrange(9)}Helper{rng.randrange(9)}Class{rng.randrange(9)}"
            text = f"{filler} in {value}.java {filler}"
        elif kind == 7:
            value = str(rng.randrange(10**15, 10**16))
            text = f"{filler} number {value} {filler}"
        elif kind == 8:
            value = f"/home/user/projects/backend/test_connection_pool_{rng.randrange(100)}"
            text = f"{filler} see {value} {filler}"
        else:
            value = rng.choice(["verification", "internationalisation", "cloudmarket"])
            text = f"{filler} the secret: {value} {filler}"
        rows.append((i, text, value, kind < 5))
    return rows


def test_held_out_precision_and_recall_beat_the_rules(spark):
    """Paths, hashes of commits and numbers among the findings; the rules alone report all they can't rule out."""
    rows = held_out(random.Random(1), 400)
    table = spark.createDataFrame([(i, t, "web", "en") for i, t, *_ in rows], "doc_id long, text string, source string, lang string")
    found = secrets.scan(table).collect()
    want = {(i, hashlib.sha256(v.encode()).hexdigest()) for i, _, v, y in rows if y}

    def measured(got):
        got = {(r["doc_id"], r["digest"]) for r in got}
        return len(got & want) / len(got), len(got & want) / len(want)

    precision, recall = measured([r for r in found if r["score"] >= secrets.THRESHOLD])
    rules, _ = measured([r for r in found if r["label"] != 0])
    print("precision, recall, rules' precision", precision, recall, rules)
    assert precision >= 0.95 and recall >= 0.95 and rules < precision - 0.05


def test_features_see_dictionary_path_and_neighbours(spark):
    docs = spark.createDataFrame([("zorblat quimfex " * 3, "a/b/c.txt")], "text string, path string")
    words = secrets.dictionary(docs)
    cover, longest = words.cover(["zorblatQuimfex99", "xaxexixoxuxaxexix", "strengthslengthss", "a1b2"])
    assert cover.tolist() == [14 / 16, 0, 0, 0] and longest.tolist()[0] == 7 / 16
    judge = secrets.Judge([], words, secrets.built_in(400))
    key = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    score = lambda *f: float(judge.vote([f])[0])
    assert score("a", 'token = "', key, '"') >= 0.5 > score("a", "commit ", key, " by")
    used = {int(f) for t in judge.forest.trees for f in t[0] if f >= 0}
    assert {secrets.FEATURES[f] for f in used} >= {"length", "transitions", "coverage", "separators", "near_most", "near_least"}


def test_labelled_findings_of_the_caller_and_their_directories(spark):
    docs = spark.createDataFrame([(1, "id 9f86d081884c7d659a2feaa0c55ad015 x", "ids/a.txt")], "doc_id long, text string, path string")
    rng = random.Random(4)
    hexa = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(32))
    known = [("ids/f.txt", "id ", hexa(), " x", 0) for _ in range(300)] + [("keys/f.txt", "id ", hexa(), " x", 1) for _ in range(300)]
    judge = secrets.train(docs, labelled=known)
    key = "9f86d081884c7d659a2feaa0c55ad015"
    assert judge.vote([("keys/g.txt", "id ", key, " x")])[0] > judge.vote([("ids/g.txt", "id ", key, " x")])[0]
    assert judge._odds(judge.places, "keys", None) > 3 and judge._odds(judge.places, "ids", None) < -3


def test_reruns_agree_and_long_texts(spark):
    rows = [(i, t, "s", "en") for i, t, *_ in held_out(random.Random(2), 40)]
    rows += [(900, "w" * 3_000_000 + ' token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b" ' + "ab1 " * 500_000, "s", "en"), (None, rows[0][1], None, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    a = sorted(map(str, secrets.scan(table).collect()))
    assert a == sorted(map(str, secrets.scan(table.repartition(5)).collect()))
    assert any("doc_id=900, start=3000010, length=40" in x for x in a) and any("doc_id=None" in x for x in a)


def test_redaction(spark, documents, nothing):
    judge = secrets.train(documents)
    secret = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    table = documents.unionByName(spark.createDataFrame([(900, f'x token = "{secret}" y', "s", "en", 0, 1, 1, "x", None)], documents.schema))
    out = secrets.redact(table, judge)
    assert out.schema == table.schema
    after = sorted(map(repr, out.collect()))
    hit = [r for r in out.collect() if r["doc_id"] == 900]
    assert hit[0]["text"] == 'x token = "[SECRET]" y' and hit[0]["n_chars"] == 22
    assert sorted(map(repr, documents.collect())) == [r for r in after if "doc_id=900" not in r]
    assert secrets.scan(nothing).count() == 0 and secrets.redact(nothing).count() == 0


def test_forest_learns():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((600, 5))
    y = ((x[:, 1] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    forest = secrets.Forest(trees=30).fit(x[:400], y[:400])
    assert ((forest.vote(x[400:]) > 0.5) == y[400:]).mean() > 0.85


def test_assigned_values_of_any_length_and_characters(spark):
    judge = secrets.train(spark.createDataFrame([r[:2] for r in held_out(random.Random(2), 150)], "doc_id long, text string"))
    rows = [
        (1, 'x password = "hunter2xyz9" y', 'x password = "[SECRET]" y'), (2, "passwd: 'Tr0ub4dor&3'", "passwd: '[SECRET]'"),
        (3, "api_key = 'a1.b2!c3@d4%e5:f6'", "api_key = '[SECRET]'"), (4, "the secret: everything is fine", "the secret: everything is fine"),
        (5, 'secret = "ab 9f86d081884c7d659a2feaa0c55ad015a3bf4f1b cd"', 'secret = "[SECRET]"'),
    ]
    out = secrets.redact(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), judge)
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {i: want for i, _, want in rows}
