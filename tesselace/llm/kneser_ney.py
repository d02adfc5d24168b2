"""Quality classifier: interpolated modified Kneser-Ney trigrams, trained on trusted text.

Trusted documents are those labelled 1. By hash of doc_id one half of them is for training and the other half sets the
thresholds; all rows of both are used, whatever the size of the input, unless a caller asks for fewer (`train_rows`).
Trigrams are counted in shards of their context and then of the pair that ends them; context sums, continuation counts
and discounts are windows in those shards. Both shards of a trigram share its middle word, so large inputs are worked
off in `slices` of those words, one after the other, to hold less on disk at once. The model is stored as additive
parts: log P of a token is the sum of one part for its word, one for its bigram and one for its trigram, 0 where that
was not seen, so a document's score is a sum over its n-grams' parts.

Words outside the vocabulary (`words` entries at most) share the unknown token, whose probability in any context is
split among the unknown words seen. The `head` most frequent n-grams are broadcast (12 bytes each, pairs 8). What the head has
no room for is dealt to shards by ranges of the keys, in slices of the shards. Both the model and the n-grams asked for
travel packed, thousands in a row: sorted keys as compressed differences, which are small within a range. A shard answers with one sum for each document of a batch.
A Bloom filter of bounded size keeps n-grams from that shuffle that cannot be in the model (the fewer, the larger the
model is).

A document's log-perplexity is drawn to its language's median by `prior` tokens, so that a few words decide nothing.
The threshold of a language is the quantile `share` of that figure over all its held-out trusted documents (over all
languages for one with fewer than 30 of them or beyond the `languages` most frequent).

Null text counts as empty: no words, perplexity of the median, kept. Null lang is a language of its own. Repeated
rows each have a row. Without trusted rows every document is kept. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import batches, by_size, cutoff_of, discard, materialise, most_frequent, release, small_batches, texts_of

MARKS = frozenset(".,;:!?")
UNKNOWN, BEGIN, END = 0, 1, 2
BITS = 17
MASK = (1 << BITS) - 1
MASK2 = (1 << 2 * BITS) - 1
ALL = "\x00all"  # stands for all languages together
TRIGRAM = 1 << 3 * BITS  # marks trigram keys; bigram keys are below it


def tokens(text: str) -> list[str]:
    """What stands between white space, without one closing mark."""
    return [w[:-1] if w[-1] in MARKS and len(w) > 1 else w for w in text.split()]


def streams_of(texts: list[str], words: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' ids in one array, each text as BEGIN BEGIN its words END, and the length of each."""
    split = [tokens(t) for t in texts]
    size = np.fromiter(map(len, split), np.int64, len(split)) + 3
    end = np.cumsum(size)
    full, inner = np.full(int(size.sum()), BEGIN, np.int64), np.ones(int(size.sum()), bool)
    inner[end - size] = inner[end - size + 1] = inner[end - 1] = False
    full[end - 1] = END
    full[inner] = np.fromiter(map(words.get, chain.from_iterable(split), repeat(UNKNOWN)), np.int64, len(full) - 3 * len(split))
    return full, size


def bloom_bits(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    x = keys.astype(np.uint64)
    a = x * np.uint64(0x9E3779B97F4A7C15)
    b = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    shift = np.uint64(64 - bits)
    return (a >> shift).astype(np.int64), (b >> shift).astype(np.int64)


def packed(keys: np.ndarray, *columns: np.ndarray) -> bytes:
    """Sorted keys and what goes with them: differences and columns, byte by byte of the numbers, compressed."""
    planes = [x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes() for x in (np.diff(keys, prepend=0), *columns)]
    return len(keys).to_bytes(4, "little") + pa.compress(b"".join(planes), "zstd", asbytes=True)


def unpacked(blob: bytes, *types: str) -> list[np.ndarray]:
    """What packed was given; types: of the columns."""
    n, kinds, at = int.from_bytes(blob[:4], "little"), [np.dtype("<i8"), *map(np.dtype, types)], 0
    raw = np.frombuffer(pa.decompress(blob[4:], n * sum(k.itemsize for k in kinds), "zstd"), np.uint8)
    out = []
    for kind in kinds:
        out.append(np.ascontiguousarray(raw[at : at + n * kind.itemsize].reshape(kind.itemsize, n).T).view(kind).ravel())
        at += n * kind.itemsize
    return [np.cumsum(out[0]), *out[1:]]


def dealt(keys: np.ndarray, borders: np.ndarray, slices: int = 1, mine: int = 0) -> list[tuple[int, np.ndarray]]:
    """(shard, places of its keys, in the order of keys) for each shard of a slice that has any; a shard begins at each border."""
    order = np.argsort(keys, kind="stable")
    cuts = np.r_[0, np.searchsorted(keys[order], borders), len(keys)]
    return [(k, order[cuts[k] : cuts[k + 1]]) for k in np.flatnonzero(np.diff(cuts)).tolist() if k % slices == mine]


def borders_of(keys: DataFrame, shards: int, each: int = 64) -> np.ndarray:
    """Keys at which shards of about the same number of keys begin, found from some of them that a hash chooses: by the keys alone, however they are dealt."""
    every = max(1, keys.count() // (shards * each))
    some = np.sort(keys.where(F.pmod(F.xxhash64("key"), F.lit(every)) == 0).select("key").toArrow().column("key").to_numpy())
    return np.unique(some[len(some) * np.arange(1, shards) // shards]) if len(some) else np.zeros(0, np.int64)


class Lookup:
    """Keys (long) with values; what is not there counts 0. Keys below 2^34, which those of pairs are, take four bytes."""

    def __init__(self, parts: DataFrame, slice_rows: int = 500_000):
        """parts are fetched in slices of their keys, so that the driver holds little besides the sorted arrays."""
        n, short = parts.agg(F.count(F.lit(1)), F.count(F.when(F.col("key") <= MASK2, 1))).first()
        slices = max(1, -(-n // slice_rows))
        cuts = [int(x) for x in parts.approxQuantile("key", [k / slices for k in range(1, slices)], 0.01)] if slices > 1 else []
        self.short, self.long, self.values = np.zeros(short, np.uint32), np.full(n - short + 1, 2**62, np.int64), np.zeros(n + 1, np.float32)
        self.starts, at = np.zeros(5, np.int64), 0  # of the short keys with the same upper bits
        for low, high in zip([-1, *cuts], [*cuts, 2**62], strict=True):
            table = parts.where((F.col("key") > low) & (F.col("key") <= high)).select("key", F.col("value").cast("float").alias("value")).toArrow()
            keys, stop = table.column("key").to_numpy(), at + table.num_rows
            order = np.argsort(keys)
            keys, middle = keys[order], min(max(at, short), stop)
            self.short[at:middle] = keys[: middle - at] & 0xFFFFFFFF
            self.long[middle - short : stop - short] = keys[middle - at :]
            self.starts += np.searchsorted(keys[: middle - at], np.arange(5) << 32)
            np.take(table.column("value").to_numpy(), order, out=self.values[at:stop])
            at = stop
            del table, keys, order
        pa.default_memory_pool().release_unused()

    @property
    def keys(self) -> np.ndarray:
        return self.keys_of(0, len(self.values))

    def keys_of(self, low: int, high: int) -> np.ndarray:
        n = len(self.short)
        upper = np.searchsorted(self.starts, np.arange(low, min(high, n)), side="right") - 1
        return np.concatenate((upper << 32 | self.short[low:high], self.long[max(0, low - n) : max(0, high - n)]))

    def __getstate__(self, rows: int = 1 << 19) -> tuple:
        """Packed: a broadcast lies on the disk of the driver and of each executor."""
        pieces = ((a, min(a + rows, len(self.values))) for a in range(0, len(self.values), rows))
        return len(self.short), len(self.values), self.starts, [packed(self.keys_of(a, b), self.values[a:b]) for a, b in pieces]

    def __setstate__(self, state: tuple) -> None:
        n, size, self.starts, blobs = state
        self.short, self.long, self.values, at = np.empty(n, np.uint32), np.empty(size - n, np.int64), np.empty(size, np.float32), 0
        for blob in blobs:
            keys, values = unpacked(blob, "<f4")
            stop, middle = at + len(keys), min(max(at, n), at + len(keys))
            self.short[at:middle] = keys[: middle - at] & 0xFFFFFFFF
            self.long[max(0, at - n) : max(0, stop - n)] = keys[middle - at :]
            self.values[at:stop] = values
            at = stop

    def __call__(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, there = np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        upper = np.clip(wanted >> 32, 0, 4)
        for k in np.flatnonzero(np.bincount(upper, minlength=5)).tolist():
            mine = np.flatnonzero(upper == k)
            low, high = (self.starts[k], self.starts[k + 1]) if k < 4 else (len(self.short), len(self.values))
            if low < high:
                keys, asked = (self.short[low:high], wanted[mine].astype(np.uint32)) if k < 4 else (self.long, wanted[mine])
                place = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
                at[mine], there[mine] = low + place, keys[place] == asked
        return np.where(there, self.values[at], 0), there


class Model:
    """What every task needs: the words' parts, the most frequent n-grams' parts and a filter for all others; bounded in size."""

    def __init__(self, words: dict[str, int], part: np.ndarray, head: Lookup, bloom: np.ndarray | None, bits: int):
        self.words, self.part, self.head, self.bloom, self.bits = words, part, head, bloom, bits if bloom is None else (8 * len(bloom)).bit_length() - 1

    def __getstate__(self) -> dict:
        filled = None if self.bloom is None else (len(self.bloom), pa.compress(self.bloom, "zstd", asbytes=True))
        return self.__dict__ | {"bloom": filled}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        if self.bloom is not None:
            n, filled = self.bloom
            self.bloom = np.frombuffer(pa.decompress(filled, n, "zstd"), np.uint8)

    def local(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Tokens of each text, the local part of its score and its n-grams that have to be joined."""
        full, size = streams_of(texts, self.words)
        end = np.cumsum(size)
        doc = np.repeat(np.arange(len(size)), size)
        inner = np.ones(len(full), bool)
        inner[end - size] = False  # a pair ends at every place but the first, a triple also not at the second
        pair = (full[:-1] << BITS | full[1:])[inner[1:]]
        whose = doc[inner]
        third = inner.copy()
        third[end - size + 1] = False
        at = np.flatnonzero(third)
        triple = full[at - 2] << 2 * BITS | full[at - 1] << BITS | full[at] | TRIGRAM
        value = self.part[0][full] * third
        context = inner.copy()
        context[end - 1] = False
        value += self.part[1][full] * context
        score = np.bincount(doc, value, len(size))
        rest = [np.zeros(0, np.int64)] * len(size)
        left = []
        for keys, owner in ((pair, whose), (triple, doc[at])):
            order = np.argsort(keys)  # lookups in order stay in the processor's cache
            keys, owner = keys[order], owner[order]
            got, there = self.head(keys)
            score += np.bincount(owner, got, len(size))
            if self.bloom is not None:
                k, o = keys[~there], owner[~there]
                hit = np.ones(len(k), bool)
                for b in bloom_bits(k, self.bits):
                    hit &= (self.bloom[b >> 3] >> (b & 7) & 1).astype(bool)
                left.append((k[hit], o[hit]))
        if left:
            k, o = (np.concatenate(x) for x in zip(*left, strict=True))
            order = np.argsort(o, kind="stable")
            rest = np.split(k[order], np.cumsum(np.bincount(o, minlength=len(size)))[:-1])
        return size - 2, score, rest


def discounts(counts: dict[int, int]) -> tuple[float, float, float]:
    """Chen and Goodman's D1, D2, D3+ from the numbers of n-grams seen once to four times."""
    n1, n2, n3, n4 = (counts.get(k, 0) for k in (1, 2, 3, 4))
    if not (n1 and n2 and n3):
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(x, 0.05), k) for x, k in zip(d, (0.95, 1.9, 2.9), strict=True))


def taken(c: np.ndarray, d) -> np.ndarray:
    """What discounting takes from counts."""
    return np.select([c == 1, c == 2], [d[0], d[1]], d[2])


def trusted_rows(labels: DataFrame, train_rows: int | None = None) -> DataFrame:
    """(doc_id, held) of all trusted rows: one half is for training, the other is held out. With train_rows, so many at most are for training."""
    trusted = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1
    if train_rows is None:
        return trusted.select("doc_id", held.alias("held"))
    learn = trusted.where(~held).orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(train_rows)
    return learn.select("doc_id", F.lit(False).alias("held")).unionByName(trusted.where(held).select("doc_id", F.lit(True).alias("held")))


def train(texts: DataFrame, words: int, head: int, bits: int, slices: int = 4, slice_tokens: int = 2_000_000) -> tuple[Model, DataFrame | None] | None:
    """The broadcast part of the model, and the n-gram parts (key, value) that it has no room for; texts of slice_tokens tokens or fewer are one slice."""
    spark = texts.sparkSession

    def vocabulary(it):
        seen: Counter = Counter()

        def told():
            batch = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "c"])
            seen.clear()
            return batch

        for batch in by_size(it, 4_000_000):
            for t in texts_of(batch):
                seen.update(tokens(t))
            if len(seen) > 500_000:
                yield told()
        yield told()

    counted = materialise(texts.select("text").mapInArrow(vocabulary, "word string, c long").groupBy("word").agg(F.sum("c").alias("c")), "kn-words")
    n_types, n_tokens = counted.agg(F.count(F.lit(1)), F.sum("c")).first()
    if not n_types:
        return None
    slices = slices if n_tokens > slice_tokens else 1
    top = most_frequent(counted.where("c > 1 and length(word) <= 64"), "c", min(words, MASK - 2)).toArrow().to_pylist()
    discard(counted)
    index = {r["word"]: i for i, r in enumerate(sorted(top, key=lambda r: (-r["c"], r["word"])), 3)}
    shared = spark.sparkContext.broadcast(index)

    def encoded(it):
        for batch in by_size(it, 4_000_000):
            full, size = streams_of(texts_of(batch), shared.value)
            packed, end = memoryview(full.astype("<u4")).cast("B"), 4 * np.cumsum(size)
            yield pa.RecordBatch.from_arrays([pa.array([bytes(packed[a:b]) for a, b in zip((end - 4 * size).tolist(), end.tolist(), strict=True)], pa.binary())], ["ids"])

    def triples(mine: int):
        def rows(it):
            held: list[np.ndarray] = []

            def told():
                k, n = np.unique(np.concatenate(held), return_counts=True)
                held.clear()
                return pa.RecordBatch.from_arrays([pa.array(k), pa.array(n, pa.int64()), pa.array(k >> BITS & MASK2)], ["key", "c", "context"])

            for batch in batches(it, 100):
                full = np.frombuffer(b"".join(batch.column("ids").to_pylist()), "<u4").astype(np.int64)
                ours = full[2:] != BEGIN  # nothing reaches from one document into the next
                if slices > 1:
                    ours &= full[1:-1] % slices == mine
                held.append((full[:-2] << 2 * BITS | full[1:-1] << BITS | full[2:] | TRIGRAM)[ours])
                if sum(map(len, held)) > 4_000_000:
                    yield told()
            if held:
                yield told()

        return rows

    streams = materialise(texts.select("text").mapInArrow(encoded, "ids binary"), "kn-streams")
    # one shuffle by context and one by the pair that ends a trigram; everything else is a window inside them
    context, pair = Window.partitionBy("context"), Window.partitionBy("pair")
    number = lambda test, place: F.sum(F.when(test, 1 << place * BITS).otherwise(0).cast("long")).over(context)

    def slice_of(mine: int) -> DataFrame:
        tri = streams.mapInArrow(triples(mine), "key long, c long, context long").repartition("context").groupBy("context", "key").agg(F.sum("c").alias("c"))
        tri = tri.select(
            "key",
            "c",
            F.sum("c").over(context).alias("total"),
            # how many trigrams of the context occur once, twice and more often, and whether this is its first: one number, since rows of few columns are small when shuffled
            (number(F.col("c") == 1, 0) + number(F.col("c") == 2, 1) + number(F.col("c") > 2, 2) + F.when(F.col("key") == F.min("key").over(context), TRIGRAM).otherwise(0)).alias("numbers"),
        )
        tri = tri.repartition(F.expr(f"key & {MASK2}")).withColumn("pair", F.expr(f"key & {MASK2}")).withColumns({"left": F.count(F.lit(1)).over(pair), "raw": F.sum("c").over(pair), "leads": F.col("key") == F.min("key").over(pair)})
        return materialise(tri.drop("pair"), "kn-trigrams")

    sliced = []
    for mine in range(slices):
        sliced.append(slice_of(mine))
        release(spark)
    tri = reduce(DataFrame.unionByName, sliced)
    discard(streams)
    release(spark)
    few = lambda df, c: {r[0]: r[1] for r in df.where(f"{c} <= 4").groupBy(c).agg(F.count(F.lit(1))).collect()}
    bi = tri.where("leads").select(F.expr(f"cast(key & {MASK} as int)").alias("w"), F.expr(f"cast(shiftright(key, {BITS}) & {MASK} as int)").alias("v"), "left")
    ends = bi.groupBy("w").agg(F.count(F.lit(1)).alias("c")).toArrow()
    starts = bi.groupBy("v").agg(F.sum("left").alias("total"), *(F.sum(F.when(F.col("left") == k, 1).otherwise(0)).alias(f"n{k}") for k in (1, 2)), F.count(F.lit(1)).alias("n")).toArrow()
    size = len(index) + 3
    c1 = np.zeros(size)
    c1[ends["w"].to_numpy()] = ends["c"].to_numpy()
    d3, d2, d1 = discounts(few(tri, "c")), discounts(few(bi, "left")), discounts(Counter(c1.astype(int).tolist()))
    off = np.where(c1 == 0, 0, taken(c1, d1))
    spoken = np.log((c1 - off) / c1.sum() + off.sum() / c1.sum() / size)
    log1 = spoken.copy()
    log1[UNKNOWN] -= np.log(max(1, n_types - len(index)))  # in any context an unknown word is one of so many
    total2, gamma2 = np.ones(size), np.zeros(size)
    v, n1, n2 = (starts[c].to_numpy() for c in ("v", "n1", "n2"))
    total2[v] = starts["total"].to_numpy()
    gamma2[v] = np.log((d2[0] * n1 + d2[1] * n2 + d2[2] * (starts["n"].to_numpy() - n1 - n2)) / total2[v])
    orders = spark.sparkContext.broadcast((spoken, total2, gamma2))

    def parts_of(of_pairs: bool):
        def rows(it):
            spoken, total2, gamma2 = orders.value
            for batch in batches(it, 100_000):
                key, c, total, numbers, left, raw = (batch.column(k).to_numpy() for k in ("key", "c", "total", "numbers", "left", "raw"))
                n1, n2, n3, opens = numbers & MASK, numbers >> BITS & MASK, numbers >> 2 * BITS & MASK, numbers >= TRIGRAM
                leads = batch.column("leads").to_numpy(zero_copy_only=False)
                v, w = key >> BITS & MASK, key & MASK
                p2 = (left - taken(left, d2)) / total2[v] + np.exp(gamma2[v] + spoken[w])
                gamma3 = (d3[0] * n1 + d3[1] * n2 + d3[2] * n3) / total
                if of_pairs:
                    keys, n = ((key & MASK2)[leads], (key >> BITS & MASK2)[opens]), (raw[leads], total[opens])
                    value = (np.log(p2) - spoken[w] - gamma2[v])[leads], np.log(gamma3)[opens]
                else:
                    keys, n, value = (key,), (c,), (np.log((c - taken(c, d3)) / total + gamma3 * p2) - np.log(p2) - np.log(gamma3),)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), t) for x, t in ((keys, pa.int64()), (n, pa.int64()), (value, pa.float32()))], ["key", "c", "value"])

        return rows

    made = "key long, c long, value float"
    pairs = tri.where(f"leads or numbers >= {TRIGRAM}").mapInArrow(parts_of(True), made).groupBy("key").agg(F.max("c").alias("c"), F.sum("value").cast("float").alias("value"))
    parts = materialise(tri.mapInArrow(parts_of(False), made).unionByName(pairs), "kn-parts")
    for done in sliced:
        discard(done)
    del tri, bi, pairs, sliced, done  # else their shuffle files stay
    release(spark)
    cutoff = cutoff_of(parts, "c", head)
    if cutoff is None:
        frequent, tail = parts, None
    else:
        inside = in_head(parts, cutoff, head)
        frequent, tail = parts.where(inside), parts.where(~inside).select("key", "value")
    model = Model(index, np.stack([log1, gamma2]), Lookup(frequent), None if tail is None else bloom_of(tail.select("key"), bits), bits)
    for done in (shared, orders):
        done.destroy()  # what was computed with them is written
    if tail is None:
        discard(parts)
    else:
        tail._written = parts._written  # whoever has scored with it can delete it
    release(spark)
    return model, tail


def in_head(parts: DataFrame, cutoff: int, head: int) -> Column:
    """Whether an n-gram is among `head` frequent ones: all beyond the cutoff and, in the room that is left, some at it, pairs first, since documents ask for more of them."""
    pair = F.col("key") <= MASK2
    above, pairs, triples = (x or 0 for x in parts.agg(*(F.sum(t.cast("long")) for t in (F.col("c") > cutoff, (F.col("c") == cutoff) & pair, (F.col("c") == cutoff) & ~pair))).first())
    test, left = F.col("c") > cutoff, head - above
    for kind, n in ((pair, pairs), (~pair, triples)):
        # a hash chooses; its numbers vary by a square root
        share = 1.0 if n <= left else max(0.0, left - 5 * left**0.5) / n
        test |= (F.col("c") == cutoff) & kind & (F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int(share * (1 << 30)))
        left = max(0, left - n)
    return test


def bloom_of(keys: DataFrame, bits: int) -> np.ndarray:
    """A filter of 2^bits bits; of 12 to 24 bits a key where that is less. Each task fills its own, and they are united block by block."""
    bits = min(bits, max(16, (12 * keys.count()).bit_length()))
    step = min(1 << 17, 1 << bits - 3)

    def filled(it):
        """The bits that a task's keys set in each block of the filter, packed: few of them are set by one task."""
        own = np.zeros(1 << bits - 3, np.uint8)
        for batch in batches(it, 100_000):
            at = np.concatenate(bloom_bits(batch.column("key").to_numpy(), bits))
            byte, bit = at >> 3, at & 7
            for k in range(8):
                own[byte[bit == k]] |= np.uint8(1 << k)
        for at in range(0, len(own), step):
            if own[at : at + step].any():
                places = np.flatnonzero(np.unpackbits(own[at : at + step], bitorder="little"))
                yield pa.RecordBatch.from_arrays([pa.array([at // step], pa.int64()), pa.array([packed(places)], pa.binary())], ["block", "bits"])

    def united(it):
        made: dict[int, np.ndarray] = {}
        for batch in it:
            for block, blob in zip(batch.column("block").to_pylist(), batch.column("bits").to_pylist(), strict=True):
                own = np.zeros(8 * step, bool)
                own[unpacked(blob)[0]] = True
                made[block] = np.packbits(own, bitorder="little") | made.get(block, np.uint8(0))
        for block, own in made.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([own.tobytes()], pa.binary())], ["block", "bits"])

    bloom = np.zeros(1 << bits - 3, np.uint8)
    for r in keys.mapInArrow(filled, "block long, bits binary").repartition("block").mapInArrow(united, "block long, bits binary").collect():
        bloom[r.block * step : (r.block + 1) * step] = np.frombuffer(r.bits, np.uint8)
    return bloom


def score_documents(docs: DataFrame, model: Model | Broadcast, tail: DataFrame | None, slices: int = 4, shard_rows: int = 1_000_000) -> DataFrame:
    """doc_id, lang, digest (of the text), n_tokens and log_prob of every row; shards of about shard_rows n-grams of the tail. A broadcast model is destroyed after use."""
    spark = docs.sparkSession
    shared = model if isinstance(model, Broadcast) else spark.sparkContext.broadcast(model)
    borders = np.zeros(0, np.int64) if tail is None else borders_of(tail, max(slices, -(-tail.count() // shard_rows)))
    documents = "row long, doc_id long, lang string, digest long, n_tokens long, log_prob double"
    fields = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("lang", pa.string()), ("digest", pa.int64()), ("n_tokens", pa.int64()), ("log_prob", pa.float64()), ("shard", pa.int64()), ("asked", pa.binary())])

    def rows(it):
        """The documents, and for each shard one row with what a batch of them asks for; its `row` is that of the batch's first."""
        mine, number = shared.value, TaskContext.get().partitionId() << 33
        for batch in by_size(it, 1_500_000):
            n, score, rest = mine.local(texts_of(batch))
            known = {"row": range(number, number + len(n)), "n_tokens": n, "log_prob": score} | {c: batch.column(c) for c in ("doc_id", "lang", "digest")}
            yield pa.RecordBatch.from_arrays([pa.array(known[f.name], f.type) if f.name in known else pa.nulls(len(n), f.type) for f in fields], schema=fields)
            key, whose = np.concatenate(rest), np.repeat(np.arange(len(n), dtype=np.int32), [len(x) for x in rest])
            asked = [(k, packed(key[at], whose[at])) for k, at in dealt(key, borders)]
            if asked:
                known = {"row": [number] * len(asked), "shard": [k for k, _ in asked], "asked": [x for _, x in asked]}
                yield pa.RecordBatch.from_arrays([pa.array(known[f.name], f.type) if f.name in known else pa.nulls(len(asked), f.type) for f in fields], schema=fields)
            number += len(n)

    columns = ("doc_id", "lang", "digest", "n_tokens")
    local = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", F.xxhash64("text").alias("digest")).mapInArrow(rows, documents + ", shard long, asked binary")
    if tail is None:
        scored = materialise(local.select(*columns, "log_prob"), "kn-scored")
        shared.destroy()
        return scored
    local = materialise(local, "kn-local")
    shared.destroy()
    release(spark)

    def sent(mine: int):
        def of(it):
            held: list[tuple[np.ndarray, np.ndarray]] = []

            def told():
                key, value = (np.concatenate(x) for x in zip(*held, strict=True))
                held.clear()
                out = [(k, packed(key[at], value[at])) for k, at in dealt(key, borders, slices, mine)]
                return pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int64()), pa.array([x for _, x in out], pa.binary())], ["shard", "parts"])

            for batch in batches(it, 100_000):
                held.append((batch.column("key").to_numpy(), batch.column("value").to_numpy()))
                if sum(len(k) for k, _ in held) > 2_000_000:
                    yield told()
            if held:
                yield told()

        return of

    def answered(parts: pa.Table, asked: pa.Table) -> pa.Table:
        out = []
        if parts.num_rows and asked.num_rows:
            keys, values = (np.concatenate(x) for x in zip(*(unpacked(b, "<f4") for b in parts.column("parts").to_pylist()), strict=True))
            order = np.argsort(keys)
            keys, values = keys[order], values[order]
            for first, blob in zip(asked.column("row").to_pylist(), asked.column("asked"), strict=True):
                key, whose = unpacked(blob.as_py(), "<i4")
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                there = keys[at] == key
                docs_, place = np.unique(whose[there], return_inverse=True)
                if len(docs_):
                    out.append((first, packed(docs_.astype(np.int64), np.bincount(place, values[at[there]]))))
        return pa.table({"row": pa.array([k for k, _ in out], pa.int64()), "shard": pa.array([parts.column("shard")[0].as_py() if out else 0] * len(out), pa.int64()), "sums": pa.array([x for _, x in out], pa.binary())})

    def united(table: pa.Table) -> pa.Table:
        """The sums of one batch's documents, added up in the order of the shards."""
        got = [unpacked(b, "<f8") for b in table.sort_by("shard").column("sums").to_pylist()]
        docs_, place = np.unique(np.concatenate([d for d, _ in got]), return_inverse=True)
        return pa.table({"row": pa.array(docs_ + table.column("row")[0].as_py(), pa.int64()), "more": pa.array(np.bincount(place, np.concatenate([x for _, x in got])), pa.float64())})

    met = []
    for mine in range(slices):  # one after the other, to hold less on disk at once
        parts = tail.mapInArrow(sent(mine), "shard long, parts binary")
        asked = local.where(f"shard is not null and shard % {slices} = {mine}").select("shard", "row", "asked")
        met.append(materialise(parts.groupBy("shard").cogroup(asked.groupBy("shard")).applyInArrow(answered, "row long, shard long, sums binary"), "kn-met"))
        del parts, asked
        release(spark)
    more = reduce(DataFrame.unionByName, met).groupBy("row").applyInArrow(united, "row long, more double")
    done = materialise(local.where("shard is null").join(more, "row", "left").select(*columns, (F.col("log_prob") + F.coalesce("more", F.lit(0.0))).alias("log_prob")), "kn-scored")
    for x in (local, *met):
        discard(x)
    return done


def quantiles(df: DataFrame, key: str, value: Column, share: float, least: int, most: int) -> DataFrame:
    """(key, quantile, n) of keys with `least` rows or more, the most frequent `most` of them.

    Values are counted in bins of 0.0001: exact to that width, the same however the rows are dealt, and no group is gathered."""
    bins = df.select(key, F.floor(value * 10_000).cast("long").alias("bin")).groupBy(key, "bin").agg(F.count(F.lit(1)).alias("n"))
    before, whole = Window.partitionBy(key).orderBy("bin"), Window.partitionBy(key)
    run = bins.select(key, "bin", F.sum("n").over(before).alias("run"), F.sum("n").over(whole).alias("n"))
    found = run.where(F.col("run") >= F.ceil(F.col("n") * share)).groupBy(key).agg((F.min("bin") / 10_000).alias("quantile"), F.first("n").alias("n"))
    return most_frequent(found.where(F.col("n") >= least), "n", most)


def classify(docs: DataFrame, labels: DataFrame, train_rows: int | None = None, words: int = 65_536, head: int = 1 << 23, bloom_bits_: int = 28, prior: float = 30.0, share: float = 0.995, languages: int = 10_000, broadcast_rows: int = 500_000, broadcast_ids: int = 4_000_000) -> DataFrame:
    """doc_id, lang, digest (of the text), n_tokens, perplexity, threshold and kept for every row of docs."""
    spark = docs.sparkSession
    small_batches(spark)
    chosen = materialise(trusted_rows(labels, train_rows), "kn-chosen")
    learn = chosen.where("not held").select("doc_id")
    learn = F.broadcast(learn) if learn.count() <= broadcast_ids else learn  # ids alone: the other way shuffles texts
    trained = train(docs.join(learn, "doc_id", "left_semi"), words, head, bloom_bits_)
    if trained is None:
        none = F.lit(None).cast("double")
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", F.xxhash64("text").alias("digest"), F.lit(0).cast("long").alias("n_tokens"), none.alias("perplexity"), none.alias("threshold"), F.lit(True).alias("kept"))
    model, tail = spark.sparkContext.broadcast(trained[0]), trained[1]
    del trained  # the driver needs no copy of its own beside the broadcast
    release(spark)
    scored = score_documents(docs, model, tail).withColumn("lang_", F.coalesce("lang", F.lit("")))
    if tail is not None:
        discard(tail)
    del model, tail
    release(spark)
    held = chosen.where("held")
    held = F.broadcast(held) if held.count() <= broadcast_rows else held
    held = scored.join(held, "doc_id", "left_semi").where("n_tokens > 1")
    both = held.unionByName(held.withColumn("lang_", F.lit(ALL)))
    loss = -F.col("log_prob") / F.col("n_tokens")
    middle = {r["lang_"]: r["quantile"] for r in quantiles(both, "lang_", loss, 0.5, 30, languages).collect()}
    overall = quantiles(held.withColumn("lang_", F.lit(ALL)), "lang_", loss, 0.5, 1, languages).collect()
    middle[ALL] = overall[0]["quantile"] if overall else 0.0
    medians = F.broadcast(spark.createDataFrame(sorted(middle.items()), "lang_ string, median double"))
    with_median = lambda df: df.join(medians, "lang_", "left").withColumn("median", F.coalesce("median", F.lit(middle[ALL])))
    shrunk = (prior * F.col("median") - F.col("log_prob")) / (prior + F.col("n_tokens"))
    high = quantiles(with_median(held), "lang_", shrunk, share, 30, languages).select("lang_", F.col("quantile").alias("limit"))
    top = quantiles(with_median(held).withColumn("lang_", F.lit(ALL)), "lang_", shrunk, share, 1, languages).collect()
    judged = with_median(scored).join(F.broadcast(high), "lang_", "left").withColumn("loss", shrunk)
    limit = F.coalesce("limit", F.lit(top[0]["quantile"] if top else None).cast("double")) + 0.0001
    return judged.select(
        "doc_id",
        "lang",
        "digest",
        (F.col("n_tokens") - 1).alias("n_tokens"),
        F.exp("loss").alias("perplexity"),
        F.exp(limit).alias("threshold"),
        F.coalesce((F.col("loss") < limit) | (F.col("n_tokens") <= 1), F.lit(True)).alias("kept"),
    )


def keep_documents(docs: DataFrame, labels: DataFrame, broadcast_rows: int = 500_000, **options) -> DataFrame:
    """Rows of docs that are kept. A verdict belongs to (doc_id, text): equal rows share it."""
    judged = classify(docs, labels, **options)
    out = materialise(judged.where(~F.col("kept")).select(F.col("doc_id").alias("__id"), F.col("digest").alias("__rejected")).distinct(), "kn-rejected")
    out = F.broadcast(out) if out.count() <= broadcast_rows else out
    same = docs["doc_id"].cast("long").eqNullSafe(out["__id"]) & (F.xxhash64(docs["text"]) == out["__rejected"])
    return docs.join(out, same, "left_anti")
