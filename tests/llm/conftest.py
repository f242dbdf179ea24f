import random
import re

import pytest
from pyspark.sql import functions as F

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORDS.findall(text or "")


@pytest.fixture
def rng():
    return random.Random(5)


@pytest.fixture
def documents(spark, rng):
    """Rows with null ids and texts, empty and repeated ones, copies, ties and clashing extra columns."""
    base = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(120):
        parts = []
        for _ in range(rng.randrange(0, 4)):
            a = rng.randrange(0, 40)
            parts.append(" ".join(base[a : a + rng.randrange(1, 50)] * rng.randrange(1, 3)))
            if rng.random() < 0.3:
                parts.append("x " * rng.randrange(0, 30))
            parts.append(" ".join(rng.choice(base) for _ in range(rng.randrange(0, 30))))
        texts.append("\n".join(parts))
    rows = [(i, t) for i, t in enumerate(texts)] + [(200 + i, t) for i, t in enumerate(texts[:10])]
    rows += [(None, texts[0]), (None, None), (300, None), (301, ""), (302, " \n\t"), (303, "a B"), (3, texts[20]), (3, texts[20]), (304, "ÄÖ ñ 漢字 🙂 \x0b z")]
    rows = [(i, t, ["src1", "src0", None, "zz"][k % 4], "en", len(t or ""), k) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, tie int").withColumn("_d", F.lit(1)).withColumn("_n", F.lit("x")).withColumn("key", F.lit(None).cast("int"))


@pytest.fixture
def nothing(documents):
    return documents.limit(0)
