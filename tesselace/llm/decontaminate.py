"""Benchmark decontamination by latent semantic retrieval.

1. One pass over the documents keeps, for each, where the benchmark's terms stand (terms in more than `common_items`
   of the different items are function words and left out, but for the `LEAST` rarest of an item or part), and counts document frequencies.
2. A randomised SVD of the TF-IDF matrix of all passages (windows of 2 * stride words, and the benchmark's items,
   weighted so that theirs is twice the documents' energy): every task adds up its share of A^T A Omega; a Nystroem step gives the
   right singular vectors. Only the (terms x rank) sketch leaves the tasks; terms are bounded by the benchmark.
3. Windows and items are compared by cosine in the latent space, where a window must also hold `energy_share` of the
   item (its component along the item); the items are a stated query set, compared in blocks. An item of more than
   `LONGEST` words, which no window holds, is cut into parts of at most a window; each part is a query for the item.
4. Candidates are checked on the words: the longest common subsequence with the item must cover `covered` of it, and
   of the answer (the text after the last question mark, else the last sentence) half of the words must be there.

Null text has no passage. A document with several rows is reported once for an item, with its best values; rows without
id are reported under null. Items
with null or empty text match nothing; an empty benchmark or table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, discard, materialise, small_batches, summed_blobs, texts_of

WORD = re.compile(r"\w+")
STRIDE = 24
CHUNK = 64
LEAST = 6
LONGEST = 3 * STRIDE
BLOCK = 512
RESULT = "doc_id long, digest long, item_id long, cosine double, lcs double, answer double"


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def answer_of(text: str) -> list[str]:
    after = text.rpartition("?")[2] if "?" in text else ""
    if words := words_of(after):
        return words
    sentences = [w for s in re.split(r"[.!\n]+", text) if len(w := words_of(s)) >= 3]
    return sentences[-1] if sentences else words_of(text)


def lcs_length(a: list[str], b: list[str]) -> int:
    """Longest common subsequence, one bit a word of a."""
    places: dict[str, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        if m := places.get(w):
            u = v & m
            v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def parts_of(words: list[str]) -> list[list[str]]:
    """The item itself, or equal parts of at most a window where it is longer than LONGEST."""
    n = -(-len(words) // (2 * STRIDE)) if len(words) > LONGEST else 1
    cuts = [len(words) * k // n for k in range(n + 1)]
    return [words[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


class Vocabulary:
    """The benchmark's items and content terms; bounded by the benchmark."""

    def __init__(self, items: list[tuple[int, str]], common_items: float):
        self.items = [(i, words_of(t), answer_of(t)) for i, t in items if t and words_of(t)]
        self.parts = [(k, part) for k, (_, words, _) in enumerate(self.items) for part in parts_of(words)]
        texts = {tuple(words) for _, words, _ in self.items}
        seen = Counter(w for words in texts for w in set(words))
        most = max(3, common_items * len(texts))
        chosen = {w for w, n in seen.items() if n <= most}
        for part in {tuple(part) for _, part in self.parts}:
            chosen.update(sorted(set(part), key=lambda w: (seen[w], w))[:LEAST])
        self.index = {w: k for k, w in enumerate(sorted(chosen))}

    def counts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(part, term, number), in order of the parts; each part has a term."""
        found = [(r, self.index[w], n) for r, (_, words) in enumerate(self.parts) for w, n in Counter(words).items() if w in self.index]
        return tuple(np.array(x) for x in zip(*found, strict=True))


def flat_lists(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, position, term) of every hit of a batch."""
    where, which = batch.column("position"), batch.column("term")
    size = np.diff(where.offsets.to_numpy())
    return np.repeat(np.arange(len(size)), size), where.flatten().to_numpy(zero_copy_only=False).astype(np.int64), which.flatten().to_numpy(zero_copy_only=False)


def segment_sums(rows: np.ndarray, term: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Sums of rows[term] over segments that begin at start; the j-th members of all segments are added at once."""
    size = np.diff(np.r_[start, len(term)])
    order = np.argsort(-size, kind="stable")
    begin, longest = start[order], size[order]
    total = rows[term[begin]]
    for j in range(1, int(longest[0]) if len(longest) else 0):
        n = np.searchsorted(-longest, -j, side="left")
        total[:n] += rows[term[begin[:n] + j]]
    out = np.empty_like(total)
    out[order] = total
    return out


def windows(doc: np.ndarray, position: np.ndarray, term: np.ndarray, rows: np.ndarray):
    """Sums of `rows` (one a term) over two adjacent blocks of STRIDE words.

    Returns (document, first block, vectors), a window for each block that holds a term."""
    if not len(doc):
        return np.zeros(0, int), np.zeros(0, int), np.zeros((0, rows.shape[1]), rows.dtype)
    block = position // STRIDE
    start = np.flatnonzero(np.r_[True, (np.diff(doc) != 0) | (np.diff(block) != 0)])
    sums = segment_sums(rows, term, start)
    d, b = doc[start], block[start]
    pair = np.flatnonzero((d[1:] == d[:-1]) & (b[1:] == b[:-1] + 1))
    both = sums.copy()
    both[pair] += sums[pair + 1]
    return d, b, both


def find_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, item_id, cosine, lcs (share of the item) and answer (share of the answer) of every document that holds an item."""
    found = leaks_of_texts(docs, benchmark, **options)
    return found.groupBy("doc_id", "item_id").agg(*(F.max(c).alias(c) for c in ("cosine", "lcs", "answer")))


def leaks_of_texts(docs: DataFrame, benchmark: DataFrame, cosine: float = 0.5, energy_share: float = 0.35, covered: float = 0.6, rank: int = 128, common_items: float = 0.05, broadcast_rows: int = 500_000, seed: int = 1) -> DataFrame:
    """As find_leaks, for each different text (digest) of an id."""
    spark = docs.sparkSession
    small_batches(spark)
    vocabulary = Vocabulary([(r.item_id, r.text) for r in benchmark.select("item_id", "text").collect()], common_items)
    index = vocabulary.index
    if not index:
        return spark.createDataFrame([], RESULT)
    n_terms = len(index)
    terms = spark.sparkContext.broadcast(index)

    def hits(it):
        get = terms.value.get
        for batch in batches(it, 500):
            at, which = [], []
            for t in texts_of(batch):
                ids = np.array([get(w, -1) for w in WORD.findall(t.lower())], np.int32)
                p = np.flatnonzero(ids >= 0).astype(np.int32)
                at.append(p)
                which.append(ids[p])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), pa.array(at, pa.list_(pa.int32())), pa.array(which, pa.list_(pa.int32()))], ["doc_id", "digest", "position", "term"])

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("digest"), "text")
    found = keyed.mapInArrow(hits, "doc_id long, digest long, position array<int>, term array<int>")
    found = materialise(found, "leak-hits")
    n_docs, n_parts = found.count(), found.rdd.getNumPartitions()

    def frequencies(it):
        total = np.zeros(n_terms, np.int64)
        for batch in it:
            doc, _, term = flat_lists(batch)
            total += np.bincount(np.unique(doc * n_terms + term) % n_terms, minlength=n_terms)
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([0], pa.int32()), pa.array([total.tobytes()])], ["part", "chunk", "blob"])

    blobs = "part long, chunk int, blob binary"
    from_task = F.spark_partition_id().cast("long")
    df = np.frombuffer(summed_blobs(found.select("position", "term").mapInArrow(frequencies, blobs).withColumn("part", from_task), "<i8", n_parts).get(0, np.zeros(n_terms, np.int64).tobytes()), "<i8")
    idf = np.maximum(np.log((n_docs + 1) / (df + 0.5)), 0.2)
    part, term, number = vocabulary.counts()
    share = number * idf[term]
    begin = np.flatnonzero(np.r_[True, np.diff(part) != 0])
    of_parts = lambda x: np.concatenate([np.add.reduceat(share[a:b, None] * x[term[a:b]], begin[i : i + BLOCK] - a) for i, a, b in zip(range(0, len(begin), BLOCK), begin[::BLOCK], [*begin[::BLOCK][1:], len(part)], strict=True)])
    k = min(rank, n_terms)
    omega = np.random.default_rng(seed).standard_normal((n_terms, k))
    tested = (omega * idf[:, None]).astype(np.float32)
    n_chunks = -(-n_terms // CHUNK)

    def sketch(it):
        """The tasks' shares of TF^T (TF D Omega), and the energy of their rows."""
        out, energy = np.zeros((k, n_chunks * CHUNK), np.float64), 0.0
        for batch in batches(it, 1000):
            doc, position, flat = flat_lists(batch)
            if not len(flat):
                continue
            passage = doc * 2**32 + position // (2 * STRIDE)
            head = np.r_[True, np.diff(passage) != 0]
            y = np.ascontiguousarray(segment_sums(tested, flat, np.flatnonzero(head)).T)
            row = np.cumsum(head) - 1
            for c in range(k):
                out[c, :n_terms] += np.bincount(flat, y[c][row], n_terms)
            energy += float((idf[flat] ** 2).sum())
        out = np.ascontiguousarray(out.T)
        parts = [out[c * CHUNK : (c + 1) * CHUNK].tobytes() for c in range(n_chunks)] + [np.array([energy]).tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array([0] * len(parts), pa.int64()), pa.array(range(len(parts)), pa.int32()), pa.array(parts)], ["part", "chunk", "blob"])

    got = summed_blobs(found.select("position", "term").mapInArrow(sketch, blobs).withColumn("part", from_task), "<f8", n_parts)
    total = np.concatenate([np.frombuffer(got[c], "<f8") for c in range(n_chunks)]).reshape(-1, k)[:n_terms] if got else np.zeros((n_terms, k))
    energy = float(np.frombuffer(got[n_chunks], "<f8")[0]) if got else 0.0
    weight = 2 * max(1.0, energy) / (share**2).sum()
    asked_for = of_parts(omega)
    back = np.stack([np.bincount(term, share * asked_for[part, c], n_terms) for c in range(k)], 1)
    basis = right_vectors(omega, idf[:, None] * total + weight * back)
    latent = of_parts(basis)
    lengths = np.maximum(np.linalg.norm(latent, axis=1), 1e-12)
    latent /= lengths[:, None]
    rows = (idf[:, None] * basis).astype(np.float32)
    model = spark.sparkContext.broadcast((rows, latent.T.astype(np.float32), lengths.astype(np.float32)))

    def search(it):
        rows, targets, lengths = model.value
        for batch in batches(it, 500):
            d, b, v = windows(*flat_lists(batch), rows)
            norm = np.linalg.norm(v, axis=1)
            use = np.flatnonzero(norm >= energy_share * lengths.min())  # what a window lacks of length it lacks of every item
            found = [(use[:0], use[:0], norm[:0])]
            for i, j in product(range(0, len(use), 8192), range(0, len(lengths), BLOCK)):
                some = use[i : i + 8192]
                dot = v[some] @ targets[:, j : j + BLOCK]
                near, item = np.nonzero((dot >= cosine * norm[some, None]) & (dot >= energy_share * lengths[j : j + BLOCK]))
                found.append((some[near], item + j, dot[near, item] / norm[some][near]))
            near, item, value = (np.concatenate(x) for x in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(pa.array(d[near])) for c in ("doc_id", "digest")), pa.array(item, pa.int32()), pa.array(b[near], pa.int32()), pa.array(value, pa.float64())],
                ["doc_id", "digest", "item", "block", "cosine"],
            )

    candidates = found.mapInArrow(search, "doc_id long, digest long, item int, block int, cosine double").distinct()
    listed = materialise(candidates.groupBy("doc_id", "digest").agg(F.collect_list(F.struct("item", "block", "cosine")).alias("candidates")), "leak-candidates")
    discard(found)
    wanted = listed.select(F.col("doc_id").alias("id"), F.col("digest").alias("same"), "candidates")
    at = lambda df: df["doc_id"].eqNullSafe(wanted["id"]) & (df["digest"] == wanted["same"])
    if listed.count() <= broadcast_rows:
        keyed = keyed.join(F.broadcast(wanted.select("id", "same")), at(keyed), "left_semi")
    checked = keyed.join(wanted, at(keyed))
    asked = spark.sparkContext.broadcast((vocabulary.items, [k for k, _ in vocabulary.parts]))

    def verify(it):
        items, part_of = asked.value
        for batch in batches(it, 500):
            out = []
            for doc, digest, text, found in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "digest", "text", "candidates")), strict=True):
                words = words_of(text or "")
                best: dict[int, tuple] = {}
                for x in found:
                    item, want, answer = items[part_of[x["item"]]]
                    reach = len(want)
                    there = words[max(0, x["block"] * STRIDE - reach) : (x["block"] + 2) * STRIDE + reach]
                    share = lcs_length(want, there) / len(want)
                    have = Counter(there)
                    told = sum(min(n, have[w]) for w, n in Counter(answer).items()) / len(answer)
                    if share >= covered and told >= 0.5:
                        best[item] = max(best.get(item, (0, 0, 0)), (share, told, x["cosine"]))
                out += [(doc, digest, i, c, s, a) for i, (s, a, c) in best.items()]
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (*[pa.int64()] * 3, *[pa.float64()] * 3), strict=True)], ["doc_id", "digest", "item_id", "cosine", "lcs", "answer"])

    return checked.select("doc_id", "digest", "text", "candidates").mapInArrow(verify, RESULT)


def right_vectors(omega: np.ndarray, product: np.ndarray) -> np.ndarray:
    """Right singular vectors of A from Omega and A^T A Omega (Nystroem)."""
    core = omega.T @ product
    core = (core + core.T) / 2
    shift = 1e-10 * max(np.trace(core), 1e-300)
    values, vectors = np.linalg.eigh(core + shift * np.eye(len(core)))
    keep = values > 1e-12 * values.max()
    factor = product @ (vectors[:, keep] / np.sqrt(values[keep]))
    u, s, _ = np.linalg.svd(factor, full_matrices=False)
    return u[:, s > 1e-9 * s.max()]


def drop_leaks(docs: DataFrame, benchmark: DataFrame, broadcast_rows: int = 500_000, **options) -> DataFrame:
    """Rows of docs whose text holds no item."""
    leaks = leaks_of_texts(docs, benchmark, **options).select(F.col("doc_id").alias("__leak"), F.col("digest").alias("__same")).distinct()
    leaks = materialise(leaks, "leaks")
    leaks = F.broadcast(leaks) if leaks.count() <= broadcast_rows else leaks
    return docs.join(leaks, docs["doc_id"].cast("long").eqNullSafe(leaks["__leak"]) & (F.xxhash64(docs["text"]) == leaks["__same"]), "left_anti")
