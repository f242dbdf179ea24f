import random
from collections import Counter, defaultdict

import pytest
import sentencepiece
from pyspark.sql import functions as F

from larch.llm import pieces, quality, secrets
from tests.llm import test_quality
from tests.llm.conftest import words
from tests.llm.test_mixing import brute_targets
from tests.llm.test_neardup import roots

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, documents, nothing):
    docs = documents.drop("tie")
    docs.sparkSession.conf.set("spark.sql.shuffle.partitions", "4")
    sizes = [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.cut(stage(spark, docs, ""))
        sizes.append(docs.count())
        if k + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == documents.drop("tie").columns
    assert sizes[1] < sizes[0] and sizes[2] <= sizes[1] and sizes[3] == sizes[2] and sizes[5] == sizes[4]
    assert docs.columns == ["doc_id", "n_tokens", "ids"]
    empty = nothing.drop("tie")
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, "")
    assert empty.count() == 0


def corpus(rng):
    """(doc_id, text, lang, source, n_chars): clean texts, near copies, repeats, junk and secrets."""
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    plain = [" ".join(f"w{rng.randrange(3000)}" for _ in range(rng.randrange(10, 150))) for _ in range(120)]
    texts = plain + [t + " tail" for t in plain[:25]] + plain[:10] + [t + " " + t for t in plain[30:40]] + ["too short", "", None]
    texts += [f'{t}\n token = "{key()}" {t[:20]}' for t in plain[40:60]]
    passage = " ".join(f"p{i}" for i in range(150))
    texts += [f"{passage} {' '.join(f'q{i}' for i in range(1600))} {passage}"]
    rows = [(i, t, "en", ["a", "b", "c", None][rng.randrange(4)], len(t or "")) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


def test_run_against_brute_force(spark, tmp_path, rng):
    """Plain loops for the rules, the classes, the masks and the library's ids; the mix, which is random, by its laws."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    have = corpus(rng)
    spark.createDataFrame(have, schema).write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter((r["doc_id"], r["n_tokens"], tuple(r["ids"])) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())

    def passes(text):
        n, *_, repeat, longest = test_quality.brute(text)
        return n >= 10 and 100 * repeat <= 20 * n and longest <= max(quality.LONGEST_WORDS, quality.LONGEST_SHARE * n)

    kept = [r for r in have if passes(r[1])]
    assert 130 < len(kept) < len(have) - 10
    low = {}
    for r, (_, c) in zip(kept, roots([r[:2] for r in kept]), strict=True):
        low[c] = min(low.get(c, r), r, key=lambda x: x[0])
    kept = sorted(low.values())

    judge = secrets.train(spark.createDataFrame(kept, schema))
    clean = []
    for i, text, lang, source, _ in kept:
        found = secrets.judged([f"{source or '_'}/{lang}/{i}"], [text], judge)[0]
        hidden = {k for start, value, score, _ in found if score >= secrets.THRESHOLD for k in range(start, start + len(value))}
        out = "".join("[SECRET]" if k in hidden and k - 1 not in hidden else "" if k in hidden else c for k, c in enumerate(text))
        assert ("token" in text) == (out != text)
        clean.append((i, out, source))

    sizes = defaultdict(int)
    for _, text, source in clean:
        sizes[source] += len(words(text))
    want, taken = brute_targets(sizes), defaultdict(int)
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    left = dict(got)
    for i, text, source in clean:
        ids = library.encode(text)
        n, ratio = left.pop((i, len(ids), tuple(ids)), 0), min(3.0, want[source] / sizes[source])
        assert int(ratio + 1e-9) <= n <= -int(-(ratio - 1e-9) // 1)
        taken[source] += n * len(words(text))
    assert not left  # nothing else came out
    assert all(abs(taken[s] - want[s]) <= 0.02 * want[s] for s in want)
    spark.createDataFrame(have, schema).limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").agg(F.count(F.lit(1))).first()[0] == 0
