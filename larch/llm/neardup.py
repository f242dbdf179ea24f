"""MinHash near-dedup with sequential Bayesian verification.

Documents are sets of distinct 5-word shingles (lower-case A-Z).  Equal sets collapse first, on a
128-bit digest of the set, into one node each.  Banded minhashes put nodes into buckets.  Of two
nodes of a bucket, signatures are compared in batches, and the pair is dropped as soon as the
posterior chance of a similarity of at least 0.75 is below MISS; what survives is verified exactly on
the full sets.  Connected components of the verified links give the classes.

Pairs are never written out.  First every node of a bucket meets the bucket's smallest node only,
which links most copies.  Components follow.  Then, in the buckets that still hold several components,
the strays (all nodes but those of the bucket's largest component) meet all nodes of other components:
strays and nodes travel with their texts to a grid of blocks bounded in nodes and in shingles, where they
are compared, each pair in the first band it shares only, and the links that join components come out.
A node travels once per block of strays, so one stray among a million copies costs one more trip of each.
So no link between different texts is lost to a cap, and what travels is nodes, not pairs.

Chance: with b = 50 bands of r = 5 rows a pair at exactly 0.75 shares no bucket with probability
(1 - 0.75^5)^50 = 1.3e-6, and less when more similar; MISS is spent on top, once a batch.

Defined cases: a null or empty text, or one without words, has an empty set and links with nothing;
under five words the whole sequence is the one shingle; a null doc_id takes no part (component_id
null, kept true); rows that repeat a doc_id are nodes of their own; very long texts are handled
whole; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larch.llm.common import cut, drop
from larch.llm.words import Words, buffers, mix, pieces, windows

SHINGLE = 5
#: Link at NUMERATOR / 100 or more.
NUMERATOR = 75
BANDS, ROWS = 50, 5
HASHES = BANDS * ROWS
#: Hashes compared at once, and the chance of dropping a true pair at one comparison.
BATCH, MISS = 25, 1e-9

#: Nodes and shingles of a block, and rows of ids that may be broadcast (16 bytes each).
BLOCK, BLOCK_SHINGLES = 1_024, 4 << 20
BROADCAST_IDS = 1_000_000
#: Edges from which a node's edges are spread over all tasks, and the most nodes for which they are.
HOT, HOT_MOST = 100_000, 100_000

_SETS = "doc_id long, f long, n_shingles long, fa long, fb long, bands binary"
_LINKS = "ad long, ak int, bd long, bk int"


def _multipliers() -> np.ndarray:
    return (mix(np.arange(HASHES, dtype=np.uint64), 21) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def shingle_sets(words: Words) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the shingles of each text."""
    h, first = words.hashes(), words.first.tolist()
    whole = windows(h, SHINGLE)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= SHINGLE:
            x = np.sort(whole[a : b - SHINGLE + 1])
            out.append(x[np.append(True, x[1:] != x[:-1])])
        elif b > a:
            out.append(mix(windows(h[a:b], b - a), 100 + b - a))
        else:
            out.append(h[:0])
    return out


def signature(shingles: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """Minhashes (uint32) of one set, a bounded slice at a time."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    sig = np.full(len(multipliers), 2**32 - 1, dtype=np.uint32)
    for at in range(0, len(x), 2_048):
        np.minimum(sig, (multipliers[:, None] * x[None, at : at + 2_048]).min(axis=1), out=sig)
    return sig


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def band_hashes(sig: np.ndarray) -> np.ndarray:
    """(nodes, BANDS) hashes of the bands of signatures."""
    rows = sig.astype(np.uint64).reshape(len(sig), BANDS, ROWS)
    h = np.zeros((len(sig), BANDS), dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        h = mix(h ^ rows[:, :, k], 41 + k)
    return h


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    multipliers = _multipliers()
    for batch in batches:
        for piece in pieces(batch):
            sets = shingle_sets(Words(*buffers(piece.column(2)), lower=True))
            fa = np.array([mix(x, 31).sum() if len(x) else 0 for x in sets], dtype=np.uint64)
            fb = np.array([mix(x, 32).sum() if len(x) else 0 for x in sets], dtype=np.uint64)
            bands = band_hashes(np.stack([signature(x, multipliers) for x in sets])) if sets else []
            bands = [h.tobytes() if len(x) else None for x, h in zip(sets, bands, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), piece.column(1), pa.array([len(x) for x in sets], pa.int64()), pa.array(_signed(fa)), pa.array(_signed(fb)), pa.array(bands, pa.binary())],
                names=["doc_id", "f", "n_shingles", "fa", "fb", "bands"],
            )


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(band hash, its number, node, size of its set) for each band of each node."""
    for batch in batches:
        n = batch.num_rows
        if n:
            h = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u8")
            at = pa.array(np.repeat(np.arange(n), BANDS))
            yield pa.RecordBatch.from_arrays([pa.array(_signed(h)), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), n)), *(batch.column(i).take(at) for i in (0, 1, 3))], names=["band", "b", "d", "k", "n"])


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, text) with the signature, 16 bits a hash, and as many bits of each band's hash behind it."""
    multipliers = _multipliers()
    for batch in batches:
        for piece in pieces(batch):
            sets = shingle_sets(Words(*buffers(piece.column(2)), lower=True))
            sig = [signature(x, multipliers) for x in sets]
            bands = band_hashes(np.stack(sig)).astype("<u2") if sets else []
            sig = [x.astype("<u2").tobytes() + b.tobytes() for x, b in zip(sig, bands, strict=True)]
            yield pa.RecordBatch.from_arrays([*(piece.column(i) for i in range(3)), pa.array(sig, pa.binary()), pa.array([len(x) for x in sets], pa.int64())], names=["d", "k", "text", "sig", "n"])


def least_matches(batch: int = BATCH, hashes: int = HASHES, miss: float = MISS, t: float = NUMERATOR / 100) -> list[tuple[int, int]]:
    """(compared, fewest matches) by batch: with fewer, P(similarity >= t | matches) < miss under a uniform prior.

    The posterior after m matches of n is Beta(m + 1, n - m + 1); its tail above t is P(Bin(n + 1, t) <= m).
    """
    out = []
    for n in range(batch, hashes + 1, batch):
        tail, m = 0.0, -1
        while tail < miss:
            m += 1
            tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append((n, m))
    return out


def links_of(sig: np.ndarray, n: np.ndarray, comp: np.ndarray, side: np.ndarray, name: np.ndarray, band: int, sets) -> list[tuple[int, int]]:
    """Links between components of one group: pairs of a left (side 0) and a right (1; 3 if it is a stray too) node.

    sig: uint16 signatures and band hashes; n: set sizes; name: numbers in the order of the nodes; band: the
    group's band, -1 for none; sets(i): the set of node i.  Two strays meet twice in a grid, and count once.  A pair
    that shares an earlier band (its rows and its hash) is left to that one.  Links that join no more are not looked for.
    """
    bounds = least_matches()
    sig, hashed = sig[:, :HASHES], sig[:, HASHES:]
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side != 0)
    root = {int(c): int(c) for c in np.unique(comp)}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    open_: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    step = max(1, 65_536 // max(1, len(right)))
    for lo in range(0, len(left), step):
        i, j = (x.reshape(-1) for x in np.meshgrid(left[lo : lo + step], right, indexing="ij"))
        both = (side[j] == 3) & (name[i] >= name[j])
        ok = (comp[i] != comp[j]) & ~both & (100 * np.minimum(n[i], n[j]) >= NUMERATOR * np.maximum(n[i], n[j]))
        i, j = i[ok], j[ok]
        hits, done = np.zeros(len(i), dtype=np.int64), 0
        for upto, least in bounds:
            hits += (sig[i, done:upto] == sig[j, done:upto]).sum(axis=1)
            ok = hits >= least
            i, j, hits, done = i[ok], j[ok], hits[ok], upto
        if band > 0 and len(i):
            same = (sig[i, : band * ROWS] == sig[j, : band * ROWS]).reshape(len(i), band, ROWS)
            ok = ~(same.all(axis=2) & (hashed[i, :band] == hashed[j, :band])).any(axis=1)
            i, j, hits = i[ok], j[ok], hits[ok]
        open_.append((i, j, hits))
    i, j, hits = (np.concatenate([x[k] for x in open_]) if open_ else np.zeros(0, np.int64) for k in range(3))
    found = []
    for at in np.argsort(-hits, kind="stable").tolist():
        x, y = int(i[at]), int(j[at])
        a, b = find(int(comp[x])), find(int(comp[y]))
        if a != b and linked(sets(x), sets(y)):
            root[a] = b
            found.append((x, y))
    return found


def linked(p: np.ndarray, q: np.ndarray) -> bool:
    """Whether two sets (sorted distinct hashes) are at least NUMERATOR / 100 alike, exactly."""
    small, large = (p, q) if len(p) <= len(q) else (q, p)
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * both >= NUMERATOR * (len(p) + len(q) - both)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, b, side, d, k, c, n, sig, text) sorted by key to links; one group is held at a time."""
    key, held = None, []

    def close() -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        n, comp, side = (t[c].to_numpy() for c in ("n", "c", "side"))
        sig = np.frombuffer(b"".join(t["sig"].to_pylist()), "<u2").reshape(len(n), HASHES + BANDS)
        order = np.lexsort((t["k"].to_numpy(), t["d"].to_numpy()))
        node = np.stack((t["d"].to_numpy(), t["k"].to_numpy()))[:, order]
        name = np.empty(len(n), dtype=np.int64)
        name[order] = np.cumsum(np.append(True, (node[:, 1:] != node[:, :-1]).any(axis=0)))
        texts, made = t["text"], {}

        def sets(i: int) -> np.ndarray:
            if i not in made:
                made[i] = shingle_sets(Words(*buffers(pa.array([texts[i].as_py()])), lower=True))[0]
            return made[i]

        got = links_of(sig, n, comp, side, name, int(t["b"][0].as_py()), sets)
        d, k = t["d"].combine_chunks(), t["k"].combine_chunks()
        a, b = (pa.array([g[x] for g in got], pa.int64()) for x in (0, 1))
        yield pa.RecordBatch.from_arrays([d.take(a), k.take(a), d.take(b), k.take(b)], names=["ad", "ak", "bd", "bk"])

    for batch in batches:
        keys = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if hi > lo:
                if keys[lo] != key:
                    if held:
                        yield from close()
                    key, held = keys[lo], []
                held.append(batch.slice(lo, hi - lo))
    if held:
        yield from close()


def _least_of(edges: DataFrame, least: DataFrame) -> DataFrame:
    """edges (u, v) with the m of their u from least (x, m, n edges of x).

    Nodes of very many edges are met by broadcast, so that no task gets all edges of one of them.  They have HOT edges
    or more and a share of 1 / HOT_MOST or more of all edges, so there are HOT_MOST of them at most.
    """
    total, most = least.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    bound = max(HOT, -(-total // HOT_MOST))
    if most < bound:
        return edges.join(least, F.col("u") == F.col("x")).select("u", "v", "m")
    hot = F.broadcast(least.filter(F.col("n") >= bound))
    met = edges.join(hot, F.col("u") == F.col("x"), "left_anti").join(least, F.col("u") == F.col("x"))
    return met.select("u", "v", "m").unionByName(edges.join(hot, F.col("u") == F.col("x")).select("u", "v", "m"))


def components(links: DataFrame) -> DataFrame:
    """(d, k, cd, ck): each node of a link, and the smallest node of its component.

    Alternating large-star and small-star steps over the edges, each two groupings by node; the edge
    list never grows, and a star is never gathered: only its minimum is, and it comes back by _least_of().
    """
    node = lambda p: F.struct(F.col(f"{p}d").alias("d"), F.col(f"{p}k").alias("k"))
    edges = cut(links.select(node("a").alias("u"), node("b").alias("v")).filter("u <> v").distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy(F.col("u").alias("x")).agg(F.least(F.min("v"), F.min("u")).alias("m"), F.count(F.lit(1)).alias("n")))
        # Large-star: every larger neighbour of u goes to the smallest around u; then the same for the smaller ones.
        large = cut(_least_of(both.filter("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # every edge now runs from a node to a smaller one
        floor = cut(large.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")))
        small = _least_of(large, floor).select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
        after = cut(small.select(F.col("e.u").alias("u"), F.col("e.m").alias("v")).filter("u <> v").distinct())
        for x in (edges, least, large, floor):
            drop(x)
        edges = after
        # Done when only stars are left: every node has one smaller neighbour, which has none itself.
        ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up + down > 1").isEmpty():
            break
    roots = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), "v").distinct())
    return roots.select(F.col("u.d").alias("d"), F.col("u.k").alias("k"), F.col("v.d").alias("cd"), F.col("v.k").alias("ck"))


def _meet(groups: DataFrame, held: DataFrame) -> DataFrame:
    """Links found in groups (key, b, side, d, k, c); held has the nodes' texts and signatures."""
    rows = groups.join(held, ["d", "k"]).select("key", "b", "side", "d", "k", "c", "n", "sig", "text")
    return cut(rows.repartition("key").sortWithinPartitions("key").mapInArrow(_links, _LINKS))


def _blocks(nodes: Column, shingles: Column) -> Column:
    """Number of blocks that so many nodes with so many shingles are dealt to."""
    return F.ceil(F.greatest(nodes / BLOCK, shingles / BLOCK_SHINGLES, F.lit(1))).cast("int")


def _name(d: str, k: str) -> Column:
    return F.xxhash64(d, k)


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, f (hash of the text), n_shingles, cd, cf for each row of docs (doc_id, text).

    (cd, cf) names the class: the (doc_id, f) of one of its rows, the smallest of all; null for an empty set.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("f"), "text")
    sets = cut(rows.mapInArrow(_sets, _SETS))
    # Nodes: one by set; its smallest (doc_id, hash of the text) stands for it, and k tells nodes of one doc_id apart.
    keys = ["n_shingles", "fa", "fb"]
    owners = sets.filter("n_shingles > 0 and doc_id is not null").groupBy(*keys).agg(F.min(F.struct("doc_id", "f")).alias("o"))
    owners = owners.select(*keys, F.col("o.doc_id").alias("d"), F.col("o.f").alias("f"))
    owners = cut(owners.withColumn("k", (F.row_number().over(Window.partitionBy("d").orderBy("f", *keys)) - 1).cast("int")))
    own = sets.select(F.col("doc_id").alias("d"), "f", "n_shingles", "bands").join(owners.select("d", "f", "k"), ["d", "f"])
    nodes = own.groupBy("d", "k").agg(F.first("bands").alias("bands"), F.max("n_shingles").alias("n"))
    bands = nodes.mapInArrow(_bands, "band long, b int, d long, k int, n long")
    size = F.count(F.lit(1)).alias("m")
    bands = cut(bands)
    buckets = cut(bands.groupBy("band").agg(size, F.min(F.struct("d", "k")).alias("hub")).filter("m > 1"))
    members = cut(bands.join(buckets, "band").select("band", "b", "d", "k", "n", F.col("hub.d").alias("hd"), F.col("hub.k").alias("hk")))
    drop(bands)
    drop(buckets)
    # Texts and signatures of nodes that share a bucket with another.
    needed = members.select("d", "k").distinct().join(owners.select("d", "k", "f"), ["d", "k"])
    needed = cut(needed)
    few = needed.count() <= BROADCAST_IDS
    texts = rows.withColumnRenamed("doc_id", "d").join(F.broadcast(needed) if few else needed, ["d", "f"]).select("d", "k", "text")
    held = cut(texts.mapInArrow(_signatures, "d long, k int, text string, sig binary, n long").dropDuplicates(["d", "k"]))
    # First meeting: each node with the smallest of its buckets, the hub, which is copied to each block.
    star = members.filter("not (d = hd and k = hk)").select("hd", "hk", "d", "k", "n").distinct()
    blocks = star.groupBy("hd", "hk").agg(_blocks(F.count(F.lit(1)), F.sum("n")).alias("nb"))
    star = star.join(blocks, ["hd", "hk"]).withColumn("at", F.pmod(_name("d", "k"), F.col("nb")).cast("int"))
    hubs = blocks.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select("hd", "hk", "at", F.lit(0).alias("side"), F.col("hd").alias("d"), F.col("hk").alias("k"))
    groups = star.select("hd", "hk", "at", F.lit(1).alias("side"), "d", "k").unionByName(hubs)
    links = _meet(groups.select(F.xxhash64("hd", "hk", "at").alias("key"), F.lit(-1).alias("b"), "side", "d", "k", _name("d", "k").alias("c")), held)
    labels = cut(components(links))
    # Second meeting: in buckets of several components, the strays with all nodes of other components.
    own = labels.select(F.col("d").alias("xd"), F.col("k").alias("xk"), _name("cd", "ck").alias("xc"))
    labelled = members.join(own, (F.col("d") == F.col("xd")) & (F.col("k") == F.col("xk")), "left").select("band", "b", "d", "k", "n", F.coalesce("xc", _name("d", "k")).alias("c"))
    kinds = labelled.groupBy("band", "c").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("s")).groupBy("band").agg(F.count(F.lit(1)).alias("kinds"), F.max(F.struct("m", "c", "s")).alias("main"), F.sum("m").alias("m"), F.sum("s").alias("s")).filter("kinds > 1")
    kinds = kinds.select("band", F.col("main.c").alias("mc"), _blocks(F.col("m") - F.col("main.m"), F.col("s") - F.col("main.s")).alias("nl"), _blocks(F.col("m"), F.col("s")).alias("nr"))
    mixed = labelled.join(kinds, "band").withColumn("stray", F.col("c") != F.col("mc"))
    deal = lambda n, salt: F.pmod(F.xxhash64("d", "k", F.lit(salt)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = mixed.filter("stray").withColumn("i", deal("nl", 1)).withColumn("j", each("nr")).withColumn("side", F.lit(0))
    right = mixed.withColumn("j", deal("nr", 2)).withColumn("i", each("nl")).withColumn("side", F.when(F.col("stray"), 3).otherwise(1))
    groups = left.select("band", "i", "j", "b", "side", "d", "k", "c").unionByName(right.select("band", "i", "j", "b", "side", "d", "k", "c"))
    groups = groups.select(F.xxhash64("band", "i", "j").alias("key"), "b", "side", "d", "k", "c")
    more = _meet(groups, held)
    if not more.isEmpty():
        labels = cut(components(links.unionByName(more)))
    drop(members)
    drop(held)
    named = owners.join(labels.select("d", "k", "cd", "ck"), ["d", "k"], "left").select(*keys, F.coalesce("cd", "d").alias("cd"), F.coalesce("ck", "k").alias("ck"))
    roots = owners.select(F.col("d").alias("rd"), F.col("k").alias("rk"), F.col("f").alias("cf"))
    named = cut(named.join(roots, (F.col("cd") == F.col("rd")) & (F.col("ck") == F.col("rk"))).select(*keys, "cd", "cf"))
    return sets.select("doc_id", "f", *keys).join(named, keys, "left").select("doc_id", "f", "n_shingles", "cd", "cf")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text)."""
    found = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("cd", "doc_id"))
    return classes(docs).select("doc_id", "n_shingles", found.alias("component_id"), F.coalesce(F.col("doc_id") == found, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, less those that are in a class with a smaller row.

    Rows equal in doc_id and text are one document; rows without words or doc_id all stay.
    """
    alone = F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
    first = classes(docs).filter(alone | ((F.col("doc_id") == F.col("cd")) & (F.col("f") == F.col("cf"))))
    first = first.select(F.col("doc_id").alias("_d"), F.col("f").alias("_f"), alone.alias("_alone")).distinct()
    # The row travels as one struct, so its columns' names clash with none here.
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_h"), F.struct(*docs.columns).alias("_r"))
    rows = rows.join(first, F.col("_id").eqNullSafe(F.col("_d")) & (F.col("_h") == F.col("_f")))
    rows = rows.withColumn("_row", F.when(F.col("_alone"), F.monotonically_increasing_id()).otherwise(0))
    return rows.dropDuplicates(["_d", "_f", "_row"]).select("_r.*")
