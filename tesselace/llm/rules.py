"""Quality rules: statistics of whole texts and a decision list learned from labels.

Sequential covering: a rule grows threshold conditions by information gain on two thirds of a bounded labelled
sample, drops conditions from the end while that helps on the other third, and is kept if it is precise there;
rows that it covers are taken out and the next rule is grown. Rules reject; a row that no rule covers is kept.
The list is emitted as one ordered Spark conditional expression over the statistics.

Words are runs without space, tab, \\n, \\v, \\f or \\r. Null text counts as empty: no words, so base_failed.
Repeated rows each have a row. Without labels of both classes the list is empty. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, small_batches, texts_of

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\v\f\r"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_capitals", "n_exclaims", "n_digits", "longest_run")
SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)
WINDOW = 5
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def repeated_words(words: list[bytes]) -> tuple[int, int, int]:
    """Words inside windows found twice or more; distinct words; the longest run of one word."""
    n = len(words)
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.uint64)
    change = np.flatnonzero(ids[1:] != ids[:-1]) if n > 1 else np.array([], int)
    run = int(np.diff(np.concatenate([[-1], change, [n - 1]])).max()) if n else 0
    if n <= WINDOW or len(seen) == n:
        return 0, len(seen), run
    sums = sum((ids[k : n - WINDOW + 1 + k] + np.uint64(1)) * _MIX[k] for k in range(WINDOW))
    ordered = np.sort(sums)
    if not (ordered[1:] == ordered[:-1]).any():
        return 0, len(seen), run
    ids_list = ids.tolist()
    at: dict[tuple, list[int]] = {}
    for i in range(n - WINDOW + 1):  # exact: the sums only tell that there may be a repeat
        at.setdefault(tuple(ids_list[i : i + WINDOW]), []).append(i)
    covered = np.zeros(n + 1, np.int64)
    for places in at.values():
        if len(places) > 1:
            np.add.at(covered, places, 1)
            np.add.at(covered, np.array(places) + WINDOW, -1)
    return int((np.cumsum(covered[:n]) > 0).sum()), len(seen), run


def statistics(text: str) -> tuple[int, ...]:
    raw = text.encode()
    words = raw.split()
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    repeats, distinct, run = repeated_words(words)
    lines = [x for x in raw.split(b"\n") if x.strip()] if b"\n" in raw else [raw] if words else []
    return (
        len(words),
        len(text) - int(sum(seen[c] for c in SPACES)),
        int(sum(seen[c] for c in SYMBOLS)),
        len(lines) - len(set(lines)),
        repeats,
        len(lines),
        distinct,
        int(seen[65:91].sum()),
        int(seen[33]),
        int(seen[48:58].sum()),
        run,
    )


def document_statistics(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)

    def rows(it):
        for batch in batches(it, 500):
            x = np.array([statistics(t) for t in texts_of(batch)], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c) for c in x.T)], ["doc_id", *COUNTS])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, SCHEMA)


#: What conditions test: numerator and denominator, from COUNTS.
RATIOS = {
    "symbols_per_word": ("n_symbols", "n_words"),
    "chars_per_word": ("word_chars", "n_words"),
    "duplicate_lines": ("n_dup_lines", "n_lines"),
    "repeated_words": ("n_repeat_words", "n_words"),
    "distinct_words": ("n_distinct", "sqrt(n_words)"),  # a plain share falls with the length of any text
    "capitals": ("n_capitals", "word_chars"),
    "exclamations": ("n_exclaims", "n_words"),
    "digits": ("n_digits", "word_chars"),
    "longest_run": ("longest_run", "n_words"),
}


def ratio_column(name: str) -> Column:
    top, bottom = RATIOS[name]
    return F.col(top).cast("double") / F.greatest(F.expr(bottom), F.lit(1))


Condition = tuple[str, str, float]


def covers(rule: list[Condition], x: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), bool)
    for name, sign, at in rule:
        out &= x[name] >= at if sign == ">=" else x[name] <= at
    return out


def _grow(x, bad, longest: int, cuts: int) -> list[Condition]:
    rule, inside = [], np.ones(len(bad), bool)
    while len(rule) < longest and (~bad & inside).any():
        p0, n0 = (bad & inside).sum(), (~bad & inside).sum()
        best = (1e-9, None)
        for name, v in x.items():
            for at in np.unique(np.quantile(v[inside & bad], np.linspace(0, 1, cuts))):
                for sign in (">=", "<="):
                    hit = inside & (v >= at if sign == ">=" else v <= at)
                    p, n = (bad & hit).sum(), (~bad & hit).sum()
                    if p:
                        gain = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
                        if gain > best[0]:
                            best = (gain, (name, sign, float(at)))
        if best[1] is None:
            break
        rule.append(best[1])
        inside &= covers([best[1]], x)
    return rule


def learn_list(x: dict[str, np.ndarray], bad: np.ndarray, fold: np.ndarray, precision: float = 0.85, rules: int = 12, longest: int = 3, cuts: int = 24) -> list[list[Condition]]:
    """Rules for `bad` rows; fold: True for rows that only prune and judge."""
    out, left = [], np.ones(len(bad), bool)
    while len(out) < rules:
        g, h = left & ~fold, left & fold
        if (bad & g).sum() < 4 or (bad & h).sum() < 2:
            break
        take = lambda k: {c: v[k] for c, v in x.items()}
        rule = _grow(take(g), bad[g], longest, cuts)

        def worth(r, k=h):
            hit = covers(r, x) & k
            p, n = (bad & hit).sum(), (~bad & hit).sum()
            return (p - n) / (p + n) if p + n else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        hit = covers(rule, x) & left if rule else np.zeros(len(bad), bool)
        judged = hit & fold
        if (bad & judged).sum() < 3 or (bad & hit).sum() < 8 or (bad & judged).sum() < precision * judged.sum() or (bad & hit).sum() < precision * hit.sum():
            break
        out.append(rule)
        left &= ~hit
    return out


def list_expression(rules: list[list[Condition]]) -> Column:
    """True where no rule rejects: when(rule 1, false).when(rule 2, false) ... otherwise(true)."""
    chain = F
    for rule in rules:
        test = F.lit(True)
        for name, sign, at in rule:
            test = test & (ratio_column(name) >= at if sign == ">=" else ratio_column(name) <= at)
        chain = chain.when(test, F.lit(False))
    return chain.otherwise(F.lit(True)) if rules else F.lit(True)


def train(stats: DataFrame, labels: DataFrame, sample_rows: int = 20_000) -> list[list[Condition]]:
    """The decision list, from at most sample_rows labelled rows (the first by hash of doc_id)."""
    chosen = (
        labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality")).orderBy(F.xxhash64("doc_id")).limit(sample_rows)
    )
    got = stats.join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", *(ratio_column(n).alias(n) for n in RATIOS)).toPandas().sort_values("doc_id", kind="stable")
    if got.empty:
        return []
    x = {n: got[n].to_numpy() for n in RATIOS}
    fold = (got.doc_id.to_numpy() * np.int64(2654435761) >> np.int64(7)) % 3 == 0
    return learn_list(x, (got.quality == 0).to_numpy(), fold)


def judge_documents(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000) -> DataFrame:
    """doc_id, the statistics, base_failed and kept for every row of docs."""
    bounded = labels.where(F.col("quality").isin(0, 1)).select("doc_id").distinct().orderBy(F.xxhash64("doc_id")).limit(sample_rows)
    rules = train(document_statistics(docs.join(F.broadcast(bounded), "doc_id", "left_semi")), labels, sample_rows)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    stats = document_statistics(docs)
    return stats.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & list_expression(rules))
