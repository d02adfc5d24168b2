"""Brute-force twins of the toxicity features and trees, and of the search for personal data; odd input for all operators."""

import collections
import math
import random
import re

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def naive_features(text, lexicon, tox):
    words = re.findall(r"\w+", text.lower())
    n, size = max(1, len(words)), max(1, len(text))
    hits = [i for i, w in enumerate(words) if w in lexicon]
    second = [i for i, w in enumerate(words) if w in tox.SECOND]
    near = sum(any(abs(i - j) <= 5 for j in second) for i in hits)
    odd = [w for w in re.findall(r"[^\W\d_]+(?:[0-9@$*!]+[^\W\d_]+)+", text)]
    plain = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": ""}
    hidden = sum("".join(plain.get(c, c) for c in w.lower()) in lexicon for w in odd)
    stretched = len(re.findall(r"([^\W\d_])\1{2,}", text.lower()))
    marks = sum(33 <= ord(c) < 127 and not c.isalnum() for c in text)
    return [
        len(hits) / n, math.log1p(len(hits)), len({words[i] for i in hits}), sum(lexicon[words[i]] for i in hits) / n, near / n, len(second) / n,
        sum("A" <= c <= "Z" for c in text) / size, text.count("!") / n, text.count("?") / n, marks / size, sum(c in "0123456789" for c in text) / size,
        len(odd) / n, stretched / n, hidden / n, math.log1p(len(words)),
    ]


def test_features_are_those_of_plain_loops(spark):
    from tesselace.llm import toxicity as tox

    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    texts += ["", "YOU IDIOT!!! 1d10t y0u are sooo st*pid", "you\nyou idiot " * 50, "ça é tu connard ??? __a__b", "w " * 5000 + "moron you"]
    lexicon = dict.fromkeys(tox.SEEDS, 3.0) | {"the": 1.5, "de": 2.0}
    for t in texts:
        assert tox.features(t, lexicon) == pytest.approx(naive_features(t, lexicon, tox))


def test_trees_walk_row_by_row():
    from tesselace.llm.toxicity import Trees, isotonic

    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    trees = Trees(rounds=20).fit(x, y)

    def walk(tree, row):
        while isinstance(tree, tuple):
            f, k, low, high = tree
            tree = low if int((trees.edges[f] <= row[f]).sum()) <= k else high
        return tree

    want = [trees.start + trees.rate * sum(walk(t, r) for t in trees.trees) for r in x]
    assert np.allclose(trees.margin(x), want) and ((trees.margin(x) > 0) == y).mean() > 0.95
    for _ in range(20):
        z, v = np.sort(rng.normal(size=8)), rng.integers(0, 2, 8).astype(float)
        knots, fit = isotonic(z, v)
        got = np.interp(z, knots, fit)
        best = [max(min(v[a : b + 1].mean() for b in range(i, 8)) for a in range(i + 1)) for i in range(8)]  # the min-max form of the least squares fit
        assert np.allclose(got, best)


def test_lexicon_counts_copies_once(spark):
    """Copies of one insult do not outweigh; which of them comes first does not matter."""
    from tesselace.llm.toxicity import train

    rng = random.Random(2)
    words = [f"w{k}" for k in range(400)]
    rows, marks = [], []
    for k in range(400):
        bad = k % 2
        rows.append((k, " ".join(rng.choices(words, k=30) + (["zzrude"] if bad else []))))
        marks.append((k, 1, bad))
    copies = [(1000 + k, "the same words copied over and over qqcopy") for k in range(300)]
    docs = spark.createDataFrame(rows + copies, "doc_id long, text string")
    labels = spark.createDataFrame(marks + [(i, 1, 1) for i, _ in copies], "doc_id long, quality int, toxic int")
    a = train(docs, labels).lexicon
    b = train(docs.orderBy(F.desc("doc_id")).coalesce(1), labels.orderBy(F.desc("doc_id"))).lexicon
    assert a == b and "zzrude" in a and "qqcopy" not in a


FOUND = [
    regex.compile(r"(?<![\w.%+-])[\w.%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    regex.compile(r"(?<![\d.])(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?:\.(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}(?!\.?\d)"),
    regex.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    regex.compile(r"(?<![\d-])\d{4} \d{4} \d{4} \d{4}(?![\d -])"),
]


def test_personal_data_by_plain_search(spark):
    """Whatever a plain search finds is gone from the result, and what stands between entities is as it was."""
    from tesselace.llm.pii import replace_entities

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    before = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = replace_entities(docs, "a key").collect()
    n = 0
    for r in rows:
        text, new = before[r.doc_id], r.text or ""
        if not r.n_entities:
            assert text == new
        for pattern in FOUND:
            for m in pattern.finditer(text):
                n += 1
                assert m[0] not in new
        words, made = text.split(), new.split()
        if len(words) == len(made):
            assert sum(a != b for a, b in zip(words, made)) <= 6 * r.n_entities
    assert n > 20
    again = {r.doc_id: r.text for r in replace_entities(docs.repartition(5), "a key").collect()}
    assert again == {r.doc_id: r.text for r in rows}
    other = {r.doc_id: r.text for r in replace_entities(docs, "another key").collect()}
    assert all(other[r.doc_id] != r.text for r in rows if r.n_entities > 3)


def test_names_without_title_and_scripts(spark):
    from tesselace.llm.pii import replace_entities

    text = "Mr. John Smith came. Smith said that John was well; SMITHSON and Johnny not. Contact Jane Doe. Frau Müller; Müller's car. Mrs. 王 小明 and 小明. Mr. Παπαδόπουλος."
    rows = [(1, text, "x", 3), (2, "Smith alone stays", "y", 4), (3, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kinds string, N_Entities int")
    got = {r.doc_id: r for r in replace_entities(docs, "k").collect()}
    new = got[1].text
    for secret in ("John ", "Smith ", "Müller", "王", "小明", "Παπαδόπουλος"):
        assert secret not in new
    assert "SMITHSON and Johnny not. Contact Jane Doe. Frau " in new and got[2].text == "Smith alone stays" and got[3].text is None
    given, family = re.match(r"Mr\. (\w+) (\w+) came\. ", new).groups()
    assert f"came. {family} said that {given} was well" in new
    german = re.search(r"Frau (\w+); (\w+)'s car", new).groups()
    assert german[0] == german[1]
    han = re.search(r"Mrs\. (\S+) (\S+) and (\S+)\. Mr\. (\S+)\.", new).groups()
    assert han[1] == han[2] and all("一" <= c <= "鿿" for c in han[0] + han[1]) and all("Ͱ" <= c <= "Ͽ" for c in han[3])
    assert got[1].n_entities == 8 and got[1].kinds == ["name"] * 8 and got[2].n_entities == 0


def test_leaks_without_id_and_texts_apart(spark):
    from tesselace.llm.decontaminate import drop_leaks, find_leaks

    rng = random.Random(3)
    words = [f"t{k}" for k in range(500)]
    items = [(k, " ".join(rng.choices(words, k=n))) for k, n in enumerate((20, 40, 120, 300, 600, 1000))]
    fill = lambda: " ".join(rng.choices(words, k=80))
    rows = [(None, f"{fill()} {t} {fill()}", "a", 0) for _, t in items] + [(None, fill(), "b", 0), (7, fill(), "c", 0), (7, f"{fill()} {items[1][1]}", "d", 0), (8, "", "e", 0), (8, None, "f", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string, lcs int")
    bench = spark.createDataFrame([*items, (90, None), (91, "")], "item_id long, text string").withColumn("doc_id", F.lit(1))
    assert {(r.doc_id, r.item_id) for r in find_leaks(docs, bench).collect()} == {*((None, k) for k, _ in items), (7, 1)}
    kept = drop_leaks(docs, bench)
    assert sorted(r.item_id for r in kept.collect()) == ["b", "c", "e", "f"] and kept.columns == docs.columns
    assert drop_leaks(docs, bench.limit(0)).count() == len(rows) and find_leaks(docs.limit(0), bench).count() == 0


def test_items_of_all_lengths_are_found(spark):
    """Verbatim items of 20 to 1,000 words are found, and of those with three in ten words replaced whatever a plain
    check of the whole document against the item accepts."""
    from tesselace.llm.decontaminate import answer_of, find_leaks, lcs_length, words_of

    def accepted(item, text):
        want, there, answer = words_of(item), words_of(text), answer_of(item)
        have = collections.Counter(there)
        told = sum(min(n, have[w]) for w, n in collections.Counter(answer).items()) / len(answer)
        return lcs_length(want, there) >= 0.6 * len(want) and told >= 0.5

    rng = random.Random(4)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    vocabulary = sorted({w for r in docs.limit(200).collect() for w in (r.text or "").split()})
    items = [(k, rng.choices(vocabulary, k=n)) for k, n in enumerate([20, 30, 48, 60, 80, 100, 150, 200, 300, 400, 600, 1000] * 3)]
    fill = lambda: " ".join(rng.choices(vocabulary, k=rng.randint(0, 120)))
    exact = [(10**6 + k, f"{fill()} {' '.join(w)} {fill()}") for k, w in items]
    rough = [(2 * 10**6 + k, f"{fill()} {' '.join(rng.choice(vocabulary) if rng.random() < 0.3 else x for x in w)} {fill()}") for k, w in items]
    whole = docs.unionByName(spark.createDataFrame(exact + rough, "doc_id long, text string"))
    found = {(r.doc_id, r.item_id) for r in find_leaks(whole, spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")).collect()}
    assert all((10**6 + k, k) in found for k, _ in items)
    wanted = [k for (k, w), (_, text) in zip(items, rough) if accepted(" ".join(w), text)]
    assert len(wanted) > 25 and all((2 * 10**6 + k, k) in found for k in wanted)
    assert not [d for d, _ in found if d < 10**6]


def test_pipeline_of_odd_rows(spark):
    import corpus_pipeline as p

    rows = [(1, None, "en", None, None), (2, "", None, "s", 0), (None, "no id at all here", "en", "s", 17), (3, "same words " * 40, "en", "s", 440), (3, "same words " * 40, "en", "s", 440), (4, "x " * 50_000, "xx", "s", 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({"kept": F.lit(1), "node": F.lit("n"), "item_id": F.lit(2)})
    for name, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    left = [(r.doc_id, (r.text or "")[:4]) for r in docs.collect()]
    assert left.count((3, "same")) == 1 and (None, "no i") in left and any(i in (1, 2) for i, _ in left)
    last = p.STAGES[-1][1](spark, docs, SF)
    assert last.where("not decoded").count() == 0 and last.where("size(pieces) != n_pieces").count() == 0


def test_queries_with_sql_agree(spark):
    import duckdb

    from tesselace.llm import queries as q

    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for name, sql in q.oracle_sql().items():
        got, want = q.queries()[name](spark, SF).toPandas(), c.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        rows = lambda f: sorted(tuple(map(float, r)) for r in f[sorted(f.columns)].itertuples(index=False))
        assert rows(got) == rows(want), name


def test_lattices_that_forget_are_the_same():
    """Segmentations do not depend on what was laid out before or dropped since."""
    from tesselace.llm.pieces import Lattices, loaded, mix, sample_texts
    from tesselace.llm.queries import TOKENIZERS

    rng = random.Random(6)
    model = loaded(f"{TOKENIZERS}/piece_bpe_32k.model")
    letters = "abcdefghij éß王\U0001f600"
    texts = [" ".join("".join(rng.choices(letters, k=rng.randint(1, 9))) for _ in range(40)) for _ in range(30)]
    keys = mix(np.arange(30, dtype=np.uint64))
    out = lambda lattices, a, b: [(s, live.tolist(), ids.tolist(), logp.tolist()) for s, live, logp, _, _, ids, _ in sample_texts(model, texts[a:b], keys[a:b], 3, lattices)]
    kept = Lattices(model, [])
    for a in range(0, 30, 5):
        assert out(kept, a, a + 5) == out(None, a, a + 5)
        kept.forget(10**9 if a != 15 else 0)
        assert (len(kept.index) > 0) == (a != 15) and kept.seen.size == len(kept.index)
    assert out(kept, 0, 30) == out(None, 0, 30)


def test_ngrams_fetched_in_slices(spark):
    from tesselace.llm.kneser_ney import Lookup

    rng = random.Random(7)
    rows = {rng.randrange(2**52): rng.random() for _ in range(500)}
    got = Lookup(spark.createDataFrame(list(rows.items()), "key long, value double"), slice_rows=60)
    wanted = np.array([*rows, 5, 2**52 + 1])
    value, there = got(wanted)
    assert (np.diff(got.keys) > 0).all() and there.tolist() == [True] * len(rows) + [False, False]
    assert np.allclose(value, [*rows.values(), 0, 0])


def test_lattices_grow_in_place():
    """New units are put behind those that are there; the arrays are copied now and then, not for every batch."""
    from tesselace.llm.pieces import Lattices, loaded

    model, rng = loaded("/opt/tokenizers/piece_bpe_32k.model"), random.Random(9)
    units = list(dict.fromkeys(" " + "".join(rng.choices("abcdeé\U0001f600", k=rng.randint(1, 20))) for _ in range(400)))
    kept, at_once, copies = Lattices(model, []), Lattices(model, units), set()
    held = []
    for k in range(0, len(units), 4):
        kept.numbers(units[k : k + 4])
        held.append(kept.piece.base)
        copies.add(id(held[-1]))
    assert len(copies) < 25 < len(held)
    for name in ("first", "last", "begin", "code", "width", *Lattices.EDGES):
        assert np.allclose(getattr(kept, name), getattr(at_once, name), rtol=0, atol=1e-9), name
