import random

import numpy as np

from larch.llm import scoring


def texts(rng, n):
    out = []
    for _ in range(n):
        a = rng.randrange(4)
        out.append(" ".join(f"{'abcd'[a]}{(i * 7 + a) % 11}" for i in range(rng.randrange(5, 80))))
    return out


def test_gradients_against_differences():
    rng = np.random.default_rng(0)
    net = scoring.Network(np.ones(scoring.CODES))
    net.p = {k: v.astype(np.float64) + rng.standard_normal(v.shape) * 0.1 for k, v in net.p.items()}
    code, around = rng.integers(0, scoring.CODES, 40), rng.integers(0, scoring.CODES + 1, (2 * scoring.HALF, 40))
    for k, g in net.gradients(around, code).items():
        v, at, e = net.p[k], np.unravel_index(np.argmax(np.abs(g)), g.shape), 1e-4
        v[at] += e
        a = -net.forward(around, code)[0].mean()
        v[at] -= 2 * e
        b = -net.forward(around, code)[0].mean()
        v[at] += e
        assert abs((a - b) / (2 * e) - g[at]) < 1e-4 * (1 + abs(g[at]))


def test_probabilities_sum_to_one():
    net = scoring.Network(np.random.default_rng(1).random(scoring.CODES) * 100)
    around = np.tile(np.arange(2 * scoring.HALF)[:, None], (1, scoring.CODES))
    assert abs(np.exp(net.forward(around, np.arange(scoring.CODES))[0].astype(float)).sum() - 1) < 1e-3


def test_training_improves_on_held_out_texts_and_tells_order(spark):
    rng = random.Random(1)
    train = spark.createDataFrame(list(enumerate(texts(rng, 1500))), "doc_id long, text string")
    held = texts(rng, 60)
    mixed = [" ".join(rng.sample(t.split(), len(t.split()))) for t in held]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(held)] + [(1000 + i, t) for i, t in enumerate(mixed)], "doc_id long, text string")
    codes, counts = scoring.corpus_codes(train)
    mean = lambda m: {r["doc_id"]: r["mean_log_prob"] for r in scoring.score(rows, m).collect()}
    plain, model = mean((scoring.Network(counts), codes)), mean(scoring.train(train, 2))
    avg = lambda x, of: np.mean([x[i] for i in of])
    assert avg(model, range(60)) > avg(plain, range(60)) + 0.3
    assert avg(model, range(60)) > avg(model, range(1000, 1060)) + 0.05


def test_frames(documents, nothing):
    got = scoring.score(documents).collect()
    assert len(got) == documents.count()
    for r in got:
        assert (r["n_words"] == 0) == (r["mean_log_prob"] is None)
        assert r["n_words"] > 0 or r["log_prob"] == 0
    assert scoring.score(nothing).count() == 0


def test_counts_cover_all_words(documents):
    from tests.llm.conftest import words

    _, counts = scoring.corpus_codes(documents)
    assert counts.sum() == sum(len(words(r["text"])) for r in documents.collect())


def test_words_of_shared_codes_are_told_apart(spark):
    # More words than codes, so that most share one; scores of single words must be a distribution over all of them.
    many = [f"v{i}" for i in range(scoring.OWN + 2000)]
    text = lambda i: " ".join([many[i]] * (1 + (len(many) - i) // 500))
    docs = spark.createDataFrame([(i, text(i)) for i in range(len(many))], "doc_id long, text string")
    single = spark.createDataFrame([(i, w) for i, w in enumerate(many)] + [(-1, "neverseenword")], "doc_id long, text string")
    results = []
    for known in (scoring.OWN, scoring.OWN + 700, scoring.KNOWN):  # counts by join, by both, held in the tasks
        codes, counts = scoring.corpus_codes(docs, known)
        assert (codes.table is None) == (known == scoring.KNOWN)
        got = {r["doc_id"]: r["log_prob"] for r in scoring.score(single, (scoring.Network(counts), codes)).collect()}
        total = sum(np.exp(p) for i, p in got.items() if i >= 0)
        assert 0.8 < total <= 1 + 1e-3  # the rest is unseen words' and the padding of unused codes
        assert got[scoring.OWN + 10] > got[len(many) - 1] + 0.5  # more often in the corpus, likelier
        assert got[-1] < got[len(many) - 1]
        results.append(got)
    for other in results[1:]:
        assert max(abs(results[0][i] - other[i]) for i in results[0]) < 1e-6


def direct(net, counts, known, h, all_counts):
    """Score of one text word by word, in plain double precision: code by its six neighbours, word by its share of the code."""
    code = known(h).tolist() if len(h) else []
    padded, total = [scoring.CODES] * scoring.HALF + code + [scoring.CODES] * scoring.HALF, 0.0
    p = {k: v.astype(float) for k, v in net.p.items()}
    soft = lambda z, at: z[at] - np.log(np.exp(z).sum())
    for i, c in enumerate(code):
        near = padded[i : i + scoring.HALF] + padded[i + scoring.HALF + 1 : i + 2 * scoring.HALF + 1]
        state = np.tanh(sum(p["emb"][x] * p["place"][k] for k, x in enumerate(near)) @ p["hidden"] + p["hidden_b"])
        total += soft(state @ p["high"] + p["high_b"], c // scoring.SIDE)
        total += soft((state * p["gate"][c // scoring.SIDE]) @ p["low"] + p["low_b"][c // scoring.SIDE], c % scoring.SIDE)
        if c >= scoring.OWN:
            total += np.log(all_counts.get(int(h[i]), scoring.UNSEEN)) - np.log(counts[c] + scoring.UNSEEN)
    return total


def test_scores_against_a_direct_sum(spark, documents):
    """Every row's score, with seen and unseen words, in codes of their own and shared ones, and a text over a step's bytes."""
    from collections import Counter

    import pyarrow as pa

    from larch.llm.words import Words, buffers

    rng = random.Random(8)
    text = " ".join(f"v{rng.randrange(9000)}" for _ in range(20_000))
    train = documents.select("doc_id", "text").unionByName(spark.createDataFrame([(901, text)], "doc_id long, text string"))
    net, codes = scoring.train(train)
    hashes = lambda t: Words(*buffers(pa.array([t], pa.string()))).hashes()
    counted = Counter(int(x) for r in train.collect() for x in hashes(r["text"]))
    counts = np.zeros(scoring.CODES)
    for x, n in counted.items():
        counts[codes(np.array([x], dtype=np.uint64))[0]] += n
    rows = [(1, text[:2000]), (2, "never seen these v1 v2"), (3, ""), (4, None), (5, "w1"), (6, text[500:900] + " new")]
    got = {r["doc_id"]: r for r in scoring.score(spark.createDataFrame(rows, "doc_id long, text string"), (net, codes)).collect()}
    for i, t in rows:
        want = direct(net, counts, codes, hashes(t), counted)
        assert abs(got[i]["log_prob"] - want) < 1e-3 * (1 + abs(want))
    long_ = " ".join([text] * 30)  # its words far from the edges score as in any other copy
    table = spark.createDataFrame([(7, long_), (8, text), (9, text + " " + text)], "doc_id long, text string")
    got = {r["doc_id"]: r["log_prob"] for r in scoring.score(table, (net, codes)).collect()}
    assert abs(got[7] - (got[8] + 29 * (got[9] - got[8]))) < 1e-3 * abs(got[7])
