"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Learning uses a bounded sample: at most `sample_rows` labelled rows of the training fold, the first by hash of
doc_id, with near copies (equal least five-word shingle hash) counted once, as toxic if one of them is. It yields a lexicon (words whose
document frequency differs between the classes by likelihood ratio), the trees and the calibration. Every whole
text is then scored where it lies, without a shuffle.

Null text counts as empty and is scored. A doc_id with several labels counts as toxic if one of them is 1; null
labels are left out. Without labelled rows of both classes every score is the share of toxic labels, 0 if there
are none. An empty table gives an empty result; other columns of the input are not touched.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, bucket_of, materialise, small_batches, texts_of

#: Words that count as insults before anything is learned.
SEEDS = frozenset("idiot idiots moron morons stupid scum trash loser losers pathetic worthless disgusting clown dumb bastard imbecile imbécil idiota estúpido abruti connard crétin débile dummkopf arschloch trottel abschaum vollidiot".split())
#: Second-person words.
SECOND = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch sie tú ti usted ustedes vosotros".split())
WORD = re.compile(r"\w+")
ODD = re.compile(r"[^\W\d_]+(?:[0-9@$*!]+[^\W\d_]+)+")
PLAIN = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": None})
STRETCHED = re.compile(r"([^\W\d_])\1{2,}")
FEATURES = ("lexicon_share", "lexicon_log", "lexicon_kinds", "weight_share", "near_second", "second_share", "capitals", "exclamations", "questions", "punctuation", "digits", "obfuscated", "stretched", "hidden_lexicon", "log_words")
REACH = 5


def features(text: str, lexicon: dict[str, float]) -> list[float]:
    low = text.lower()
    words = WORD.findall(low)
    n = max(1, len(words))
    hits = [i for i, w in enumerate(words) if w in lexicon]
    second = [i for i, w in enumerate(words) if w in SECOND]
    near = 0
    if hits and second:
        at = np.searchsorted(second, hits)
        padded = np.array([-(10**9), *second, 10**9])
        near = int((np.minimum(np.array(hits) - padded[at], padded[at + 1] - np.array(hits)) <= REACH).sum())
    seen = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    size = max(1, len(text))
    odd = ODD.findall(text)
    hidden = sum(w.lower().translate(PLAIN) in lexicon for w in odd) if odd else 0
    stretched = STRETCHED.findall(low)
    marks = int(seen[33:48].sum() + seen[58:65].sum() + seen[91:97].sum() + seen[123:127].sum())
    return [
        len(hits) / n,
        np.log1p(len(hits)),
        float(len({words[i] for i in hits})),
        sum(lexicon[words[i]] for i in hits) / n,
        near / n,
        len(second) / n,
        int(seen[65:91].sum()) / size,
        int(seen[33]) / n,
        int(seen[63]) / n,
        marks / size,
        int(seen[48:58].sum()) / size,
        len(odd) / n,
        len(stretched) / n,
        hidden / n,
        np.log1p(len(words)),
    ]


class Trees:
    """Logistic gradient boosting over binned features."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, least: float = 5.0):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        codes = self._codes(x)
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(p / (1 - p)))
        margin, self.trees = np.full(len(y), self.start), []
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-margin))
            tree = self._grow(codes, q - y, q * (1 - q), np.arange(len(y)), self.depth)
            self.trees.append(tree)
            margin += self.rate * self._apply(tree, codes)
        return self

    def _codes(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="right") for e, c in zip(self.edges, x.T, strict=True)], 1)

    def _grow(self, codes, g, h, rows, depth):
        gain_of = lambda a, b: a * a / (b + 1.0)
        gs, hs = g[rows].sum(), h[rows].sum()
        best = (1e-6, None, None)
        for f in range(codes.shape[1]) if depth else ():
            c = codes[rows, f]
            left_g = np.cumsum(np.bincount(c, g[rows], self.bins))[:-1]
            left_h = np.cumsum(np.bincount(c, h[rows], self.bins))[:-1]
            gains = gain_of(left_g, left_h) + gain_of(gs - left_g, hs - left_h) - gain_of(gs, hs)
            gains[(left_h < self.least / 4) | (hs - left_h < self.least / 4)] = 0
            k = int(gains.argmax())
            if gains[k] > best[0]:
                best = (gains[k], f, k)
        if best[1] is None:
            return float(-gs / (hs + 1.0))
        _, f, k = best
        low = codes[rows, f] <= k
        return (f, k, self._grow(codes, g, h, rows[low], depth - 1), self._grow(codes, g, h, rows[~low], depth - 1))

    def _apply(self, tree, codes) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(codes), tree)
        f, k, left, right = tree
        return np.where(codes[:, f] <= k, self._apply(left, codes), self._apply(right, codes))

    def margin(self, x: np.ndarray) -> np.ndarray:
        codes = self._codes(x)
        return self.start + self.rate * sum((self._apply(t, codes) for t in self.trees), np.zeros(len(x)))


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing least-squares fit (pool adjacent violators)."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for a, b in zip(x[order], y[order], strict=True):
        blocks.append([b, 1.0, a, a])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v, w, _, high = blocks.pop()
            u, n, low, _ = blocks[-1]
            blocks[-1] = [(u * n + v * w) / (n + w), n + w, low, high]
    return np.array([k for b in blocks for k in (b[2], b[3])]), np.array([b[0] for b in blocks for _ in (0, 1)])


class Scorer:
    """Lexicon, trees and calibration; picklable, a few hundred kilobytes at most."""

    def __init__(self, lexicon: dict[str, float], trees: Trees | None, knots, prior: float):
        self.lexicon, self.trees, self.knots, self.prior = lexicon, trees, knots, prior

    def __call__(self, texts: list[str]) -> np.ndarray:
        if not texts or self.trees is None:
            return np.full(len(texts), self.prior)
        margin = self.trees.margin(np.array([features(t, self.lexicon) for t in texts]))
        if self.knots is None:
            return 1 / (1 + np.exp(-margin))
        return np.clip(np.interp(margin, *self.knots), 0, 1)


def _signed_words(it):
    for batch in batches(it, 500):
        sig, words = [], []
        for t in texts_of(batch):
            w = WORD.findall(t.lower())
            sig.append(min((hash_of(" ".join(w[i : i + 5])) for i in range(max(1, len(w) - 4))), default=0))
            words.append(sorted(set(w)))
        yield pa.RecordBatch.from_arrays([pa.array(sig, pa.int64()), batch.column("toxic"), pa.array(words, pa.list_(pa.string()))], ["sig", "toxic", "words"])


def hash_of(s: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(s) - 2**63


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, lexicon_words: int = 2_000, least_ratio: float = 25.0) -> Scorer:
    """Learn from rows whose crc32(doc_id as text) mod 3 is not 1; at most sample_rows of them."""
    spark = docs.sparkSession
    small_batches(spark)
    chosen = (
        labels.where(F.col("toxic").isin(0, 1) & (bucket_of(F.col("doc_id"), 3) != 1))
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"))
        .limit(sample_rows)
    )
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic")
    signed = sample.select("text", "toxic").mapInArrow(_signed_words, "sig long, toxic int, words array<string>")
    once = materialise(signed.groupBy("sig").agg(F.max("toxic").alias("toxic"), F.min("words").alias("words")), "toxic-words")
    counts = once.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.sum("toxic").alias("bad"), F.count(F.lit(1)).alias("n"))
    sizes = once.groupBy("toxic").count().collect()
    bad, good = (sum(r["count"] for r in sizes if r.toxic == k) for k in (1, 0))
    if not bad or not good:
        return Scorer({}, None, None, bad / max(1, bad + good))
    p = bad / (bad + good)
    a, n = F.col("bad"), F.col("n")
    odds = F.log((a + 0.5) / (bad + 1)) - F.log((n - a + 0.5) / (good + 1))
    ratio = 2 * (a * F.log((a + 1e-9) / (n * p)) + (n - a) * F.log((n - a + 1e-9) / (n * (1 - p))))
    learned = counts.where((a >= 3) & (odds > 1.5) & (ratio > least_ratio)).select("word", odds.alias("w"), ratio.alias("r")).orderBy(F.desc("r"), "word").limit(lexicon_words).collect()
    lexicon = dict.fromkeys(SEEDS, 3.0) | {r.word: float(r.w) for r in learned}

    def rows(it):
        for batch in batches(it, 500):
            x = [features(t, lexicon) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "toxic", "x"])

    got = sample.mapInArrow(rows, "doc_id long, toxic int, x array<double>").toPandas().sort_values(["doc_id", "toxic"], kind="stable")
    x, y = np.array(got.x.tolist()), got.toxic.to_numpy().astype(float)
    import zlib

    apart = np.array([zlib.crc32(str(d).encode()) // 3 % 4 == 0 for d in got.doc_id])
    enough = all(min(y[k].sum(), (1 - y[k]).sum()) >= 5 for k in (apart, ~apart))
    if not enough:
        return Scorer(lexicon, Trees().fit(x, y), None, p)
    trees = Trees().fit(x[~apart], y[~apart])
    return Scorer(lexicon, trees, isotonic(trees.margin(x[apart]), y[apart]), p)


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **options) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    scorer = docs.sparkSession.sparkContext.broadcast(train(docs, labels, **options))

    def score(it):
        for batch in batches(it, 500):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scorer.value(texts_of(batch)), pa.float64())], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score, "doc_id long, score double")
    return scored.select(
        "doc_id",
        F.coalesce(bucket_of(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
