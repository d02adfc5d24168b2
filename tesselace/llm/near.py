"""Near-duplicates by Order MinHash with banded alignment.

A text is the sequence of its five-word shingles, each labelled with its number of occurrence, so that labels are
distinct. For each of `sketches` hash functions the `picks` least labels, in text order, make one sketch; texts that
share a sketch meet in a bucket. What is wanted are classes, so only texts of different classes are compared: in each
of the first rounds every bucket compares its members with one leader (first the one that meets most texts, then any),
and links join classes at once. At last all pairs of a bucket that are still in different classes are compared; at
least one of a pair is outside the largest class of the bucket, so a group of copies that the leaders have joined is not
compared with itself. No bucket and no pair is left out by size.

Lengths and bits of min-hash keep pairs from alignment that cannot be alike: 128 bits a text against a leader, 1024 bits
at last. At a similarity of 0.8 a tenth of the bits differs on average; 3.5 standard deviations more are allowed.

The similarity of two texts is L / (n + m - L), L the longest common subsequence of their labelled shingles, found in
the band that any similarity of 0.8 or more keeps to. Classes are components of the links (0.8 or more), by alternating
large-star and small-star steps on distributed edges. Equal texts are one node throughout.

Null text counts as empty; texts without a word are alike only if equal. Texts of one to four words have one shingle.
A doc_id with several texts is several documents of that id, and null is no id in common: what makes a class is its
root text, not its id. The class id is the least doc_id of the class, null where none of its rows has one.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, by_size, discard, materialise, release, small_batches, texts_of

WORD = re.compile(r"\w+")
SHINGLE = 5
NEAR = 0.8
BITS = 1024
_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_POSITION = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)
_MOST = np.uint64(2**64 - 1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _C1
    x = (x ^ (x >> np.uint64(27))) * _C2
    return x ^ (x >> np.uint64(31))


def node_of(text: Column) -> Column:
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 32))


class Words(dict):
    """Hashes of words, kept while they are few."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 100_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def labels_of(texts: list[list[str]], known: Words) -> tuple[np.ndarray, np.ndarray]:
    """Labelled shingles of many word lists, one after the other in text order, and their numbers."""
    size = np.array([len(w) for w in texts], np.int64)
    n = int(size.sum())
    words = np.fromiter(map(known.__getitem__, chain.from_iterable(texts)), np.uint64, n)
    end = np.cumsum(size)
    doc = np.repeat(np.arange(len(texts)), size)
    labels = np.zeros(n, np.uint64)
    if n >= SHINGLE:
        labels[: n - SHINGLE + 1] = mix(sum(words[i : n - SHINGLE + 1 + i] * _POSITION[i] for i in range(SHINGLE)))
    keep = np.arange(n) + SHINGLE <= end[doc]
    for d in np.flatnonzero((size > 0) & (size < SHINGLE)):
        at = end[d] - size[d]
        labels[at] = mix((words[at : end[d]] * _POSITION[: size[d]]).sum(keepdims=True))[0]
        keep[at] = True
    labels, doc = labels[keep], doc[keep]
    told = labels + doc.astype(np.uint64) * _POSITION[2]  # apart in different texts
    ordered = np.sort(told)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if len(twice):
        some = np.flatnonzero(twice[np.minimum(np.searchsorted(twice, told), len(twice) - 1)] == told)
        order = some[np.argsort(told[some], kind="stable")]
        same = np.r_[False, told[order][1:] == told[order][:-1]]
        at = np.arange(len(order))
        occurrence = (at - np.maximum.accumulate(np.where(same, 0, at))).astype(np.uint64)
        labels[order] = np.where(occurrence > 0, mix(labels[order] + occurrence * _POSITION[1]), labels[order])
    return labels, np.bincount(doc, minlength=len(texts))


def order_min_hash(labels: np.ndarray, count: np.ndarray, seeds: np.ndarray, picks: int) -> np.ndarray:
    """One sketch a text and seed: the least labels under it, in text order."""
    doc = np.repeat(np.arange(len(count)), count)
    first = np.cumsum(count) - count
    wanted = np.minimum(picks, count)
    share = 4.0 * picks / np.maximum(count, 1)
    low = np.where(share >= 1, _MOST, (np.minimum(share, 0.5) * 2.0**64).astype(np.uint64))[doc]
    out = np.zeros((len(count), len(seeds)), np.uint64)
    for k, seed in enumerate(seeds):
        ranks = mix(labels ^ seed)
        at = np.flatnonzero(ranks <= low)
        at = at[np.lexsort((ranks[at], doc[at]))]
        n = np.bincount(doc[at], minlength=len(count))
        begin = np.cumsum(n) - n
        places = np.full((len(count), picks), len(labels), np.int64)
        for i in range(picks):
            has = np.flatnonzero((wanted > i) & (n > i))
            places[has, i] = at[begin[has] + i]
        for d in np.flatnonzero(n < wanted):  # fewer than wanted were below the limit
            places[d, : wanted[d]] = first[d] + np.argsort(ranks[first[d] : first[d] + count[d]], kind="stable")[: wanted[d]]
        places.sort(axis=1)
        got = np.full(len(count), seed)
        for i in range(picks):
            has = np.flatnonzero(places[:, i] < len(labels))
            got[has] = mix(got[has] * _C1 + labels[places[has, i]])
        out[:, k] = got
    return out


def profiles(labels: np.ndarray, count: np.ndarray) -> np.ndarray:
    """1024 bits a text as 16 int64: eight one-permutation min-hashes of the labels, one bit a bin of 128; empty bins borrow from the next."""
    first = np.repeat(np.arange(len(count)) * 128, count)
    bins, out = np.arange(128), []
    for k in range(BITS // 128):
        turned = labels * (mix(_POSITION[:1] + np.uint64(k))[0] | np.uint64(1))
        place = first + (turned >> np.uint64(57)).astype(np.int64)
        least = np.full(len(count) * 128, _MOST)
        np.minimum.at(least, place, turned << np.uint64(7) >> np.uint64(7))
        least = least.reshape(-1, 128)
        at = np.where(least != _MOST, bins, 256)
        at = np.minimum.accumulate(np.concatenate([at, at + 128], 1)[:, ::-1], 1)[:, ::-1][:, :128]
        bits = mix(np.take_along_axis(least, at % 128, 1) + (at - bins).astype(np.uint64) * _POSITION[3]) >> np.uint64(40) & np.uint64(1)
        out.append(np.packbits(bits.astype(np.uint8), axis=1).view(np.int64).reshape(-1, 2))
    return np.concatenate(out, 1)


def alike(a: str, b: str, bits: int) -> Column:
    """So few of the first bits of both profiles differ as for a similarity of NEAR or more (3.5 standard deviations over
    the mean of that; a short text fills few bins, whose bits are fewer than they seem); lengths fit."""
    words = range(bits // 64)
    differ = sum((F.bit_count(F.get(f"profile_{a}", F.lit(k)).bitwiseXOR(F.get(f"profile_{b}", F.lit(k)))) for k in words), F.lit(0))
    low, high = F.least(f"n_{a}", f"n_{b}"), F.greatest(f"n_{a}", f"n_{b}")
    mean = (1 - NEAR) / 2
    most = bits * mean + 3.5 * (bits * mean * (1 - mean)) ** 0.5 / F.sqrt(1 - F.exp(-low / 128))
    return (low >= high * NEAR) & (differ <= most)


def aligned(x: np.ndarray, y: np.ndarray) -> float:
    """Similarity of two texts from their labels; exact where it is NEAR or more, else less than that."""
    both = len(x) + len(y)
    if not len(x) or not len(y):
        return float(not both)
    order = np.argsort(y)
    at = np.minimum(np.searchsorted(y, x, sorter=order), len(y) - 1)
    j = order[at]
    i = np.flatnonzero(y[j] == x)
    j = j[i]
    band = int((1 - 2 * NEAR / (1 + NEAR)) * both) + 1  # so many labels at most are on one side only
    j = j[np.abs(i - j) <= band]
    n = len(j)
    if n < (NEAR - 1e-9) * (both - n) or not n:
        return n / (both - n)
    if (np.diff(j) <= 0).any():
        tails: list[int] = []
        for k in j.tolist():
            t = bisect_left(tails, k)
            if t == len(tails):
                tails.append(k)
            else:
                tails[t] = k
        n = len(tails)
    return n / (both - n)


def similarity(a: list[str], b: list[str]) -> float:
    """Of two word lists."""
    labels, count = labels_of([a, b], Words())
    return aligned(labels[: count[0]], labels[count[0] :])


def sketch_rows(docs: DataFrame, sketches: int, picks: int, seed: int) -> DataFrame:
    """doc_id, node, n_shingles, the sketches and the profile of every row."""
    seeds = mix(np.arange(1, sketches + 1, dtype=np.uint64) * _POSITION[0] + np.uint64(seed))

    def rows(it):
        known = Words()
        for batch in by_size(it, 500_000):
            nodes, place, distinct = [], {}, []
            for t in texts_of(batch):
                node = hashlib.sha256(t.encode()).digest()[:16]
                nodes.append(node)
                if node not in place:
                    place[node] = len(distinct)
                    distinct.append(WORD.findall(t.lower()))
            labels, count = labels_of(distinct, known)
            got = order_min_hash(labels, count, seeds, picks).view(np.int64)
            bits = profiles(labels, count)
            got, bits = ([x[d] if count[d] else x[d][:0] for d in range(len(count))] for x in (got, bits))
            at = [place[n] for n in nodes]
            cols = [pa.array(nodes), pa.array(count[at], pa.int32()), *(pa.array([x[d] for d in at], pa.list_(pa.int64())) for x in (got, bits))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], ["doc_id", "node", "n", "sketches", "profile"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, "doc_id long, node binary, n int, sketches array<long>, profile array<long>")


def measured(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of pairs (a, b, root_a, root_b) that are linked, with their similarity."""

    def rows(it):
        known = Words()
        last: dict[bytes, np.ndarray] = {}
        for batch in batches(it, 200):
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            wanted = {}
            for node, column in ((a, "text_a"), (b, "text_b")):
                for k, x in enumerate(node):
                    if x not in last:
                        wanted.setdefault(x, (column, k))
            labels, count = labels_of([WORD.findall(batch.column(c)[k].as_py().lower()) for c, k in wanted.values()], known)
            have = last | dict(zip(wanted, np.split(labels, np.cumsum(count)[:-1]), strict=True)) if wanted else last
            found = [aligned(have[x], have[y]) for x, y in zip(a, b, strict=True)]
            last = {a[-1]: have[a[-1]]}  # pairs come in order of a
            yield batch.select(["a", "b", "root_a", "root_b"]).append_column("similarity", pa.array(found, pa.float64())).filter(pa.array([x >= NEAR - 1e-12 for x in found], pa.bool_()))

    of = lambda c: texts.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}"))
    joined = pairs.join(of("b"), "b").join(of("a"), "a")
    return joined.select("a", "b", "root_a", "root_b", "text_a", "text_b").mapInArrow(rows, "a binary, b binary, root_a binary, root_b binary, similarity double")


def near_links(rows: DataFrame, docs: DataFrame, rounds: int = 3, broadcast_rows: int = 500_000) -> tuple[list[DataFrame], DataFrame | None]:
    """Tables of links (a, b, similarity) found between different texts, and (node, root) of every text that has one."""
    nodes = rows.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sketches").alias("sketches"), F.first(F.slice("profile", 1, 2)).alias("profile"))
    member = nodes.select("node", "n", "profile", "doc_id", F.explode(F.array_distinct("sketches")).alias("bucket"))
    sizes = member.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    met = materialise(member.join(sizes, "bucket"), "near-members")
    # the more texts a text meets, the more central it is: the source of a group of copies comes before the copies
    involved = materialise(met.groupBy("node").agg((-F.sum("size")).alias("order"), F.first("doc_id").alias("doc_id")), "near-involved")
    ids = involved.select("doc_id").distinct()
    ids = F.broadcast(ids) if ids.count() <= broadcast_rows else ids
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.join(ids, "doc_id", "left_semi").unionByName(texts.where("doc_id is null")).withColumn("node", node_of(F.col("text")))
    named = involved.select(F.col("doc_id").alias("id"), F.col("node").alias("wanted"))
    texts = texts.join(named, texts["doc_id"].eqNullSafe(named["id"]) & (texts["node"] == named["wanted"]), "left_semi")
    texts = materialise(texts.select("node", "text").dropDuplicates(["node"]), "near-texts")
    members = met.join(involved.select("node", "order"), "node").select("bucket", "node", "n", "profile", "order")
    links: list[DataFrame] = []
    classes: DataFrame | None = None
    columns = ("node", "n", "profile", "root")
    side = lambda c: [F.col(k).alias(k if k == "bucket" else f"{k}_{c}") for k in ("bucket", *columns)]
    last = False
    for round_ in range(rounds + 1):
        last = last or round_ == rounds
        if classes is None:
            state = members.withColumn("root", F.col("node"))
        else:
            state = members.join(classes, "node", "left").withColumn("root", F.coalesce("root", "node"))
            state = materialise(state, "near-state")
        if last:
            shares = state.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("share"))
            most = shares.groupBy("bucket").agg(F.count(F.lit(1)).alias("kinds"), F.max(F.struct("share", "root"))["root"].alias("main")).where("kinds > 1").select("bucket", "main")
            open_ = state.drop("profile").join(most, "bucket")
            whole = rows.join(open_.select("node").distinct(), "node", "left_semi").groupBy("node").agg(*(F.first(c).alias(c) for c in ("profile", "sketches")))
            open_ = materialise(open_.join(whole, "node"), "near-open")
            x = open_.where("root != main").select(*side("x"), "main", F.col("sketches").alias("sketches_x"))
            y = open_.select(*side("y"), F.col("sketches").alias("sketches_y"))
            once = F.get(F.array_intersect("sketches_x", "sketches_y"), F.lit(0)) == F.col("bucket")  # of the buckets that a pair shares, one counts
            both = x.join(y, "bucket").where(F.expr("root_x != root_y and (root_y = main or node_x < node_y)") & alike("x", "y", BITS) & once)
        else:
            first = F.col("order") if not round_ else F.xxhash64("bucket", "node", F.lit(round_))
            lead = state.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min(F.struct(first.alias("first"), *columns)).alias("lead"))
            lead = lead.where("low != high").select("bucket", *(F.col(f"lead.{k}").alias(f"{k}_y") for k in columns))
            both = state.select(*side("x")).join(lead, "bucket").where(F.expr("root_x != root_y") & alike("x", "y", 128))
        turned = F.col("node_x") < F.col("node_y")
        pick = lambda k, p, q: F.when(turned, F.col(f"{k}_{p}")).otherwise(F.col(f"{k}_{q}"))
        pairs = both.select(pick("node", "x", "y").alias("a"), pick("node", "y", "x").alias("b"), pick("root", "x", "y").alias("root_a"), pick("root", "y", "x").alias("root_b")).distinct()
        new = materialise(measured(pairs, texts), "near-links")
        if classes is not None:
            discard(state)
        if last:
            discard(open_)
        del both, pairs
        release(docs.sparkSession)
        if new.isEmpty():
            discard(new)
            if last:
                break
            last = True
            continue
        links.append(new)
        joined = components(new.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")))
        if classes is None:
            classes = joined
        else:
            renamed = joined.select(F.col("node").alias("old"), F.col("root").alias("new"))
            moved = classes.join(renamed, classes["root"] == renamed["old"], "left").select("node", F.coalesce("new", "root").alias("root"))
            grown = materialise(moved.unionByName(joined.join(classes, "node", "left_anti")), "near-roots")
            classes = grown
        if last:
            break
    for done in (met, involved, texts):
        discard(done)
    return links, classes


def components(edges: DataFrame, most: int = 100) -> DataFrame:
    """(node, root) for every node of an edge (a, b); root is the least node it is connected with."""
    edges = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "component-edges")
    before = None
    for _ in range(most):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        done, edges = edges, materialise(small, "component-edges")
        discard(done)
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now
    raise RuntimeError("components did not settle")


def near_classes(docs: DataFrame, sketches: int = 16, picks: int = 3, seed: int = 7) -> DataFrame:
    """doc_id, class_id, node (of the text) and root (of the class) for every row; rows of one class are near-duplicates by some chain of links."""
    small_batches(docs.sparkSession)
    rows = materialise(sketch_rows(docs, sketches, picks, seed), "near-rows")
    named = rows.groupBy("node").agg(F.min("doc_id").alias("least"))
    links, roots = near_links(rows, docs)
    for done in links:
        discard(done)
    joined = named.withColumn("root", F.col("node")) if roots is None else named.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes = joined.groupBy("root").agg(F.min("least").alias("class_id"))
    by_node = materialise(joined.join(classes, "root").select("node", "class_id", "root"), "near-classes")
    release(docs.sparkSession)
    return rows.select("doc_id", "node").join(by_node, "node").select("doc_id", "class_id", "node", "root")


def keep_one(docs: DataFrame, broadcast_rows: int = 300_000, **options) -> DataFrame:
    """One row of docs of each class: that of the least doc_id (and least node; null is the last), once if it is repeated."""
    classes = materialise(near_classes(docs, **options), "near-keep")
    rows = classes.groupBy("root", "doc_id", "node").agg(F.count(F.lit(1)).alias("n"))
    least = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node", "n")).alias("k"))
    least = least.select(F.col("k.doc_id").alias("__id"), F.col("k.node").alias("__kept"), F.col("k.n").alias("__n"))
    keyed = docs.withColumn("__node", node_of(F.col("text")))
    test = keyed["doc_id"].cast("long").eqNullSafe(F.col("__id")) & (keyed["__node"] == F.col("__kept"))
    kept = keyed.join(least, test)
    once = kept.where("__n = 1").unionByName(kept.where("__n > 1").dropDuplicates(["__id", "__kept"]))
    return once.select(*docs.columns)
