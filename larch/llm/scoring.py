"""Document scores by masked pseudo-likelihood.

A network with a window of three words on both sides predicts every word of a text with that word
masked out; a document's score is the sum of the conditional log-probabilities of its words.

Words and codes: counts of all words of the corpus (one grouped count) give the most frequent ones a
code each; the rest share hash codes.  A code is (high, low) of 64 x 64, and the network predicts the
high part and then the low part given it, so the distribution over all codes is exact and costs two
softmaxes of 64.  Within a shared code a word has its share of the code's count in the corpus, so what is
scored is the word and not its code: P(word) = P(code) x count(word) / (count(code) + UNSEEN).  Words that
the corpus doesn't have share the rest, UNSEEN / (count(code) + UNSEEN), as one event a code.  Counts of the
KNOWN most frequent words travel with the tasks; all others are joined by hash from the table of counts,
which is as long as the vocabulary.

Training covers every word of the table.  Each task starts from the same network, whose biases are
the corpus' own frequencies, passes once over its words in numpy (Adagrad), and gives out the weighted
change of all parameters in chunks; a reduction tree sums the chunks, and the network moves by their
mean.  So what is gathered grows with the input (a change of about 0.6 MB a task, and the counts),
while the driver holds one network and the KNOWN words, both of fixed size.

Defined cases: a null or empty text has no words and a log-probability of 0 (mean null); one word
alone is predicted from padding only; a null doc_id is carried through; repeated rows are scored each
on its own; very long texts are scored whole; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larch.llm.common import cut, drop
from larch.llm.words import Words, buffers, pieces

SIDE, HALF = 64, 3
CODES = SIDE * SIDE
#: Codes shared by hash (a power of two); the others belong to one word each.
SHARED = 512
OWN = CODES - SHARED
#: Words whose counts are held in every task (16 bytes each), and the count that unseen words of a code share.
KNOWN, UNSEEN = 1 << 17, 0.5
#: Logarithms of counts are added as whole numbers of 1 / GRID, so that their order doesn't matter.
GRID = 2.0**32
WIDTH = 16
RATE, BATCH = 0.05, 4_096
CHUNK, FAN_IN = 4_096, 64
_PAD = CODES
_ONES = np.ones(SIDE, np.float32)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch, column="text"):
            h, n = np.unique(Words(*buffers(piece.column(1))).hashes(), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])


class Codes:
    """Codes of word hashes: rank by count for the frequent ones, shared codes for the rest; and the word within its code.

    words and n: the most frequent words and their counts; counts: of each code; table: h and n of the words
    beyond these (None if there are none), for the driver only.
    """

    def __init__(self, words: np.ndarray, n: np.ndarray, counts: np.ndarray, table: DataFrame | None = None):
        frequent = words[:OWN]
        code = np.arange(len(frequent))
        order = np.argsort(frequent)
        self.hashes, self.code = frequent[order], code[order].astype(np.int64)
        order = np.argsort(words)
        self.known, self.log_n = words[order], np.log(n[order].astype(float))
        self.log_code, self.table, self.complete = np.log(counts + UNSEEN), table, table is None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"table": None}

    def __call__(self, h: np.ndarray) -> np.ndarray:
        rest = OWN + (h % np.uint64(SHARED)).astype(np.int64)
        if not len(self.hashes):
            return rest
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.code[at], rest)

    def within(self, h: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log-probability of each word within its code, whether log(count) is still to be added from the table)."""
        shared = np.flatnonzero(code >= OWN)
        log, left = np.zeros(len(h)), np.zeros(len(h), dtype=bool)
        x = h[shared]
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, x), len(self.known) - 1)
            hit = self.known[at] == x
            value = np.where(hit, self.log_n[at], np.log(UNSEEN) if self.complete else 0.0)
        else:
            hit, value = np.zeros(len(x), dtype=bool), np.full(len(x), np.log(UNSEEN) if self.complete else 0.0)
        log[shared] = value - self.log_code[code[shared]]
        left[shared] = ~hit & (not self.complete)
        return log, left


def corpus_codes(docs: DataFrame, known: int = KNOWN) -> tuple[Codes, np.ndarray]:
    """The codes, and the corpus' count of each code, over all words of docs; known: see KNOWN, OWN at least."""
    counts = cut(docs.select("doc_id", "text").mapInArrow(_counted, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")))
    # How many words there are by power of two of their count tells how rare a word can be among the first ones;
    # so few rows are sorted and sent, from however many tasks.
    level, seen = 0, 0
    for r in sorted(counts.groupBy(F.length(F.bin("n")).alias("level")).count().collect(), key=lambda r: -r["level"]):
        level, seen = r["level"], seen + r["count"]
        if seen >= known:
            break
    top = counts.filter(F.length(F.bin("n")) >= level).orderBy(F.desc("n"), "h").limit(known).toArrow()
    h, n = (top.column(c).to_numpy() for c in ("h", "n"))
    total = np.zeros(CODES)
    total[: min(len(n), OWN)] = n[:OWN]
    share = F.col("h").bitwiseAND(F.lit(SHARED - 1))  # as the unsigned hash modulo SHARED
    after = lambda k: (F.col("n") < int(n[k - 1])) | ((F.col("n") == int(n[k - 1])) & (F.col("h") > int(h[k - 1])))
    if len(n) >= OWN:
        for r in counts.filter(after(OWN)).groupBy(share.cast("int").alias("k")).agg(F.sum("n").alias("n")).collect():
            total[OWN + r["k"]] = r["n"]
    table = counts.filter(after(known)) if len(n) == known else None
    if table is None:
        drop(counts)
    return Codes(h.view(np.uint64), n, total, table), total


class Network:
    """Parameters by name; forward and one training step.  All float32."""

    def __init__(self, counts: np.ndarray, seed: int = 0):
        rng = np.random.default_rng(seed)
        small = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        part = np.log((counts + 0.5) / (counts + 0.5).sum()).reshape(SIDE, SIDE)
        high = np.log(np.exp(part).sum(axis=1))
        self.p = {
            "emb": small(CODES + 1, WIDTH), "place": np.ones((2 * HALF, WIDTH), np.float32) / np.float32(np.sqrt(2 * HALF)),
            "hidden": (np.eye(WIDTH) + small(WIDTH, WIDTH)).astype(np.float32), "hidden_b": np.zeros(WIDTH, np.float32),
            "high": small(WIDTH, SIDE) * 0, "high_b": high.astype(np.float32),
            "gate": np.ones((SIDE, WIDTH), np.float32) + small(SIDE, WIDTH), "low": small(WIDTH, SIDE) * 0, "low_b": (part - high[:, None]).astype(np.float32),
        }

    def forward(self, around: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, dict]:
        """Log-probability of each code given the 2 x HALF codes around it; and what training needs."""
        p = self.p
        high, low = code >> 6, code & 63
        rows = np.arange(len(code))
        c = np.zeros((len(code), WIDTH), np.float32)
        for k in range(2 * HALF):
            x = p["emb"].take(around[k], axis=0)
            x *= p["place"][k]
            c += x
        h = np.tanh(c @ p["hidden"] + p["hidden_b"])
        zh = h @ p["high"]
        zh += p["high_b"]
        np.clip(zh, -60, 60, out=zh)
        picked = zh[rows, high]
        eh = np.exp(zh, out=zh)
        sh = eh @ _ONES
        g = h * p["gate"].take(high, axis=0)
        zl = g @ p["low"]
        zl += p["low_b"].take(high, axis=0)
        np.clip(zl, -60, 60, out=zl)
        picked = picked + zl[rows, low]
        el = np.exp(zl, out=zl)
        sl = el @ _ONES
        return picked - np.log(sh) - np.log(sl), {"c": c, "h": h, "g": g, "eh": eh, "sh": sh, "el": el, "sl": sl, "high": high, "low": low, "rows": rows}

    def gradients(self, around: np.ndarray, code: np.ndarray) -> dict[str, np.ndarray]:
        """Mean gradients of the negative log-probability."""
        p, n = self.p, np.float32(1 / len(code))
        _, f = self.forward(around, code)
        dh, dl = f["eh"], f["el"]
        dh *= (n / f["sh"])[:, None]
        dl *= (n / f["sl"])[:, None]
        dh[f["rows"], f["high"]] -= n
        dl[f["rows"], f["low"]] -= n
        one = np.zeros((len(code), SIDE), np.float32)
        one[f["rows"], f["high"]] = 1
        dg = dl @ p["low"].T
        back = (dh @ p["high"].T + dg * p["gate"].take(f["high"], axis=0)) * (1 - f["h"] * f["h"])
        dc = back @ p["hidden"].T
        out = {"high": f["h"].T @ dh, "high_b": dh.sum(axis=0), "low": f["g"].T @ dl, "low_b": one.T @ dl, "gate": one.T @ (dg * f["h"]), "hidden": f["c"].T @ back, "hidden_b": back.sum(axis=0)}
        place, across = np.zeros_like(p["place"]), np.ascontiguousarray(dc.T)
        flat, step = around.reshape(-1), np.empty((WIDTH, 2 * HALF, len(code)), np.float32)
        for k in range(2 * HALF):
            place[k] = np.einsum("ij,ij->j", dc, p["emb"].take(around[k], axis=0))
            step[:, k] = across * p["place"][k][:, None]
        emb = np.empty_like(p["emb"])
        for d in range(WIDTH):
            emb[:, d] = np.bincount(flat, weights=step[d].reshape(-1), minlength=CODES + 1)
        return out | {"place": place, "emb": emb}

    def flat(self) -> np.ndarray:
        return np.concatenate([x.reshape(-1) for x in self.p.values()])

    def load(self, flat: np.ndarray) -> Network:
        at = 0
        for k, x in self.p.items():
            self.p[k] = flat[at : at + x.size].reshape(x.shape).astype(np.float32)
            at += x.size
        return self


def _sequence(piece: pa.RecordBatch, codes: Codes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes with HALF pads before, between and after texts, places of the real ones, first word of each text, hashes)."""
    words = Words(*buffers(piece.column(1)))
    h = words.hashes()
    code = codes(h)
    text = np.repeat(np.arange(len(words.counts)), words.counts)
    place = np.arange(len(code)) + HALF * (text + 1)
    full = np.full(len(code) + HALF * (len(words.counts) + 1), _PAD, dtype=np.int64)
    full[place] = code
    return full, place, words.first, h


_AROUND = np.array([*range(-HALF, 0), *range(1, HALF + 1)])


def _trained(network: Network, codes: Codes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Network.__new__(Network)
        own.p = {k: v.copy() for k, v in network.p.items()}
        start, power, seen = network.flat(), {k: np.full(v.shape, 1e-4, np.float32) for k, v in own.p.items()}, 0
        for batch in batches:
            for piece in pieces(batch):
                full, place, *_ = _sequence(piece, codes)
                # Every word once, in an order that mixes the piece's texts.
                place = place[np.random.default_rng(len(place)).permutation(len(place))]
                for lo in range(0, len(place), BATCH):
                    at = place[lo : lo + BATCH]
                    grads = own.gradients(full[at[None, :] + _AROUND[:, None]], full[at])
                    for k, g in grads.items():
                        power[k] += g * g
                        own.p[k] -= RATE * g / np.sqrt(power[k])
                seen += len(place)
        if seen:
            change = (own.flat() - start).astype(np.float64) * seen
            context = TaskContext.get()
            task = context.partitionId() if context else 0
            parts = [change[i : i + CHUNK] for i in range(0, len(change), CHUNK)]
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary())
            rows = [(k, task, seen, x.astype("<f4").tobytes()) for k, x in enumerate(parts)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["part", "task", "n", "change"])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums changes by (part, task) of rows sorted by these; one sum is held at a time."""
    key, total, n = None, None, 0

    def close() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int64()), pa.array([n], pa.int64()), pa.array([total.astype("<f4").tobytes()], pa.binary())], names=["part", "task", "n", "change"])

    for batch in batches:
        for part, task, weight, change in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            x = np.frombuffer(change, "<f4").astype(np.float64)
            if (part, task) != key:
                if key:
                    yield close()
                key, total, n = (part, task), np.zeros(len(x)), 0
            total, n = total + x, n + weight
    if key:
        yield close()


def train(docs: DataFrame, rounds: int = 1) -> tuple[Network, Codes]:
    """The network after `rounds` passes over all words of docs (text)."""
    rows = docs.select("doc_id", "text")
    codes, counts = corpus_codes(rows)
    network = Network(counts)
    for _ in range(rounds):
        changes = cut(rows.mapInArrow(_trained(network, codes), "part int, task long, n long, change binary"))
        tasks = changes.select("task").distinct().count()
        while tasks:
            grouped = changes.withColumn("was", F.col("task")).withColumn("task", F.floor(F.col("task") / FAN_IN))
            after = cut(grouped.repartition("part", "task").sortWithinPartitions("part", "task", "was").select("part", "task", "n", "change").mapInArrow(_summed, "part int, task long, n long, change binary"))
            drop(changes)
            changes, most = after, after.agg(F.max("task")).first()[0]
            if not most:
                break
        got = sorted((r["part"], r["n"], r["change"]) for r in changes.collect())  # one network
        drop(changes)
        if got:
            network.load(network.flat() + np.concatenate([np.frombuffer(c, "<f4") / n for _, n, c in got]))
    return network, codes


def _scored(network: Network, codes: Codes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        row = (context.partitionId() if context else 0) << 36
        for batch in batches:
            for piece in pieces(batch):
                full, place, first, h = _sequence(piece, codes)
                within, left = codes.within(h, full[place])
                log = np.zeros(len(place) + 1)
                for lo in range(0, len(place), BATCH):
                    at = place[lo : lo + BATCH]
                    log[lo + 1 : lo + 1 + len(at)] = network.forward(full[at[None, :] + _AROUND[:, None]], full[at])[0]
                log[1:] += within
                n = np.diff(first)
                total = np.diff(np.cumsum(log)[first])
                ends = np.concatenate([[0], np.cumsum(left)])[first]
                rest = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(h[left].view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(row + np.arange(len(n))), piece.column(0).cast(pa.int64()), pa.array(n.astype(np.int64)), pa.array(total), rest], names=["row", "doc_id", "n_words", "log_prob", "rest"])
                row += len(n)

    return run


def score(docs: DataFrame, model: tuple[Network, Codes] | None = None) -> DataFrame:
    """doc_id, n_words, log_prob and mean_log_prob of each row of docs (doc_id, text)."""
    network, codes = model or train(docs)
    out = docs.select("doc_id", "text").mapInArrow(_scored(network, codes), "row long, doc_id long, n_words long, log_prob double, rest array<long>")
    if codes.table is not None:
        # The rare words of the texts meet their counts; rows are numbered by task, so they are written before they are used twice.
        out = cut(out)
        rare = out.select("row", F.explode("rest").alias("h")).join(codes.table, "h", "left")
        log_n = F.round(F.log(F.coalesce(F.col("n").cast("double"), F.lit(UNSEEN))) * GRID).cast("long")
        added = rare.groupBy("row").agg((F.sum(log_n) / GRID).alias("added"))
        out = out.drop("rest").join(added, "row", "left").withColumn("log_prob", F.col("log_prob") + F.coalesce("added", F.lit(0.0)))
    mean = F.when(F.col("n_words") > 0, F.col("log_prob") / F.col("n_words"))
    return out.select("doc_id", "n_words", "log_prob", mean.alias("mean_log_prob"))
