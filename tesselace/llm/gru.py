"""Language-model scoring: a gated recurrent model in numpy with a class-factored softmax.

Counts: every training document's tokens are counted, exactly and distributed. The most frequent tokens (`head_words`
at most, of at most 256 bytes, so that their table is bounded) are broadcast with their counts; other tokens meet their
counts in a join, and none of those is frequent.

Model: the most frequent tokens of the head are the recurrent model's vocabulary, in classes by rank, frequent tokens in small ones;
all others are one unknown token that is spelled by smoothed counts of those others, so that the probabilities of
all tokens add up. A start on few rows at the driver is followed by truncated back-propagation over all training
documents, whatever the size of the input: hashes of id and text deal them into shards of about `shard_tokens` tokens,
each is learned in the order of those hashes, and the shards' weights are averaged by tokens, summed in order. The
weights thus depend on the rows alone, not on partitions or machines. Scoring reads whole documents: documents of a
batch run side by side, with the state carried through each of them.

Words are runs without space, tab, \\n, \\v, \\f or \\r, with A-Z in lower case; each document has one end token. Null
and empty texts consist of that token. Repeated rows each have a row. Without training rows the counts are zero and
the score is the base score. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import chain, pairwise, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, bucket_of, by_size, materialise, most_frequent, small_batches, summed_blobs, texts_of

END = b"\x00end"  # holds no word: it is marked by a byte that is put before words that begin with it
SMOOTH = 0.1
BLOCK = 1024
CHUNK = 16_384


def tokens(text: str) -> list[bytes]:
    words = text.encode().lower().split()
    if "\x00" in text:
        words = [b"\x00" + w if w.startswith(b"\x00") else w for w in words]
    words.append(END)
    return words


def tokens_of(texts: list[str]) -> list[bytes]:
    """Those of texts one after another; an end follows each text's."""
    if any("\x00" in t for t in texts):
        return list(chain.from_iterable(map(tokens, texts)))
    return b"".join(part for t in texts for part in (t.encode(), b" ", END, b" ")).lower().split()


class Room:
    """Arrays by name that are used again: new ones of many rows come from the system page by page each time."""

    def __init__(self, dtype):
        self.dtype, self.held = dtype, {}

    def __call__(self, name: str, *shape: int) -> np.ndarray:
        size = math.prod(shape)
        if name not in self.held or self.held[name].size < size:
            self.held[name] = np.empty(size, self.dtype)
        return self.held[name][:size].reshape(shape)


class Gru:
    """Weights of the recurrent model; classes * members tokens, of which 0 is unknown and 1 the end.

    sizes: the classes' numbers of tokens, which follow one another; `members` each by default."""

    NAMES = ("embed", "w", "u", "b", "out_class", "bias_class", "out_word", "bias_word")

    def __init__(self, classes: int, members: int, hidden: int = 32, embed: int = 24, seed: int = 5, sizes: np.ndarray | None = None):
        rng = np.random.default_rng(seed)
        normal = lambda *s, scale=0.1: rng.normal(0, scale, s).astype(np.float32)
        sizes = np.full(classes, members) if sizes is None else np.asarray(sizes)
        self.classes, self.hidden, size = classes, hidden, int(sizes.sum())
        self.starts = np.r_[0, np.cumsum(sizes)]
        self.class_of = np.repeat(np.arange(classes), sizes).astype(np.int16)
        self.embed = normal(size, embed)
        self.w, self.u, self.b = normal(embed, 3 * hidden, scale=0.2), normal(hidden, 3 * hidden, scale=0.15), np.zeros(3 * hidden, np.float32)
        self.out_class, self.bias_class = normal(hidden, classes, scale=0.05), np.zeros(classes, np.float32)
        self.out_word, self.bias_word = normal(size, hidden, scale=0.05), np.zeros(size, np.float32)

    def start_from(self, counts: np.ndarray) -> Gru:
        """Biases that give the unigram distribution."""
        p = counts + 0.5
        mass = np.add.reduceat(p, self.starts[:-1])
        self.bias_class = np.log(mass / p.sum()).astype(np.float32)
        self.bias_word = np.log(p / mass[self.class_of]).astype(np.float32)
        return self

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).ravel() for n in self.NAMES])

    def load(self, flat: np.ndarray) -> Gru:
        at = 0
        for n in self.NAMES:
            old = getattr(self, n)
            setattr(self, n, flat[at : at + old.size].reshape(old.shape).astype(np.float32))
            at += old.size
        return self

    def parts(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        """Views of an array that holds all weights, by name."""
        sizes = [getattr(self, n).size for n in self.NAMES]
        return {n: x.reshape(getattr(self, n).shape) for n, x in zip(self.NAMES, np.split(flat, np.cumsum(sizes)[:-1]), strict=True)}

    def output(self, h: np.ndarray, y: np.ndarray, grad: dict | None = None, room: Room | None = None, order: np.ndarray | None = None):
        """log P of y given the states h; with grad, adds gradients of -sum log P and returns those of h too.

        A bias is a factor of its column's exponentials, which the sums and products take in; so are the rows' sums.
        order: that of y, where it is known."""
        room = Room(h.dtype) if room is None else room
        order = self.sorted(y) if order is None else order
        h, y = np.take(h, order, 0, out=room("h", *h.shape), mode="clip"), y.take(order)
        c = self.class_of.take(y).astype(np.int64)
        rows, z, logp, dh = len(y), room("z", len(y)), np.empty(len(y), h.dtype), None
        exps = room("exps", min(BLOCK, rows), self.classes)
        factor = np.exp(self.bias_class)
        if grad is not None:
            back, dh, total, bias = np.ascontiguousarray((self.out_class * factor).T), room("dh", *h.shape), np.zeros_like(self.out_class), np.zeros_like(factor)
        for at in range(0, rows, BLOCK):  # blocks that stay in the processor's cache
            hb, cb, zb = h[at : at + BLOCK], c[at : at + BLOCK], z[at : at + BLOCK]
            e = np.matmul(hb, self.out_class, out=exps[: len(cb)])
            own, i = e.reshape(-1), np.arange(0, e.size, self.classes) + cb
            logp[at : at + BLOCK] = own.take(i)
            np.exp(e, out=e)  # a bounded state has small logits
            np.matmul(e, factor, out=zb)
            if grad is not None:
                own[i] -= zb / factor.take(cb)
                inverse = 1 / zb
                total += (hb * inverse[:, None]).T @ e
                bias += inverse @ e
                np.matmul(e, back, out=dh[at : at + BLOCK])
        logp += self.bias_class.take(c)
        logp -= np.log(z)
        if grad is not None:
            dh /= z[:, None]
            total *= factor
            bias *= factor
            grad["out_class"] += total
            grad["bias_class"] += bias
            back = room("back", *h.shape)
        cuts = np.searchsorted(c, np.arange(self.classes + 1))
        sizes, factor = np.diff(self.starts), np.exp(self.bias_word)
        some = np.flatnonzero((np.diff(cuts) > 0) & (sizes > 1))
        place = (np.arange(rows) - cuts.take(c)) * sizes.take(c) + y - self.starts.take(c)
        single = sizes.take(c) == 1
        z[single] = factor.take(y[single])  # a token that is its class is certain
        own_factor, own_word = factor.take(y), room("own", rows)
        own_word.fill(0)
        if grad is not None:
            back.fill(0)
            scaled = self.out_word * factor[:, None]
        longest = int(max((np.diff(cuts) * sizes)[some], default=0))
        exps = room("word_exps", longest)
        for a, b, first, stop in zip(cuts[some].tolist(), cuts[some + 1].tolist(), self.starts[some].tolist(), self.starts[some + 1].tolist(), strict=True):
            hk, zk, i = h[a:b], z[a:b], place[a:b]
            own = exps[: (b - a) * (stop - first)]
            e = np.matmul(hk, self.out_word[first:stop].T, out=own.reshape(b - a, stop - first))
            own_word[a:b] = own.take(i)
            np.exp(e, out=e)
            np.matmul(e, factor[first:stop], out=zk)
            if grad is not None:
                own[i] -= zk / own_factor[a:b]
                inverse, scale = 1 / zk, factor[first:stop]
                total = e.T @ (hk * inverse[:, None])
                total *= scale[:, None]
                grad["out_word"][first:stop] += total
                grad["bias_word"][first:stop] += (inverse @ e) * scale
                np.matmul(e, scaled[first:stop], out=back[a:b])
        logp += own_word
        logp += self.bias_word.take(y)
        logp -= np.log(z)
        if not np.isfinite(logp).all():
            raise FloatingPointError("logits out of range")
        out = np.empty_like(logp)
        out[order] = logp
        if grad is None:
            return out, None
        back /= z[:, None]
        dh += back
        back[order] = dh
        return out, back

    def sorted(self, y: np.ndarray) -> np.ndarray:
        return np.argsort(y.astype(np.int16) if len(self.class_of) < 2**15 else y, kind="stable")

    def gates(self, weights: np.ndarray) -> np.ndarray:
        """(gate, row, state): the gates' columns apart, so that each gate's values lie side by side, and as `step`
        takes them: negative for the first two, double for the new state."""
        apart = weights.reshape(-1, 3, self.hidden).transpose(1, 0, 2)
        return np.ascontiguousarray(apart * np.array([-1, -1, 2], weights.dtype)[:, None, None])

    def step(self, a: np.ndarray, h: np.ndarray, u: np.ndarray, g: np.ndarray) -> np.ndarray:
        """The states after h: a, by gates, is that of the input and becomes the gates' values; g becomes h's part."""
        np.matmul(h, u, out=g)
        zr, new = a[:2], a[2]
        zr += g[:2]
        np.exp(zr, out=zr)  # infinite where a gate is shut, of which the inverse is 0
        zr += 1
        np.divide(1, zr, out=zr)
        new += zr[1] * g[2]
        np.exp(new, out=new)  # tanh by exp, which takes half as long
        new += 1
        np.divide(-2, new, out=new)
        new += 1
        out = h - new
        out *= zr[0]
        out += new
        return out

    def window(self, y: np.ndarray, h: np.ndarray, room: Room | None = None, grad: dict | None = None):
        """Loss gradients of one window (steps, lanes) that starts with states h; returns (log P, gradients, last states).

        grad: arrays of zeros that take the gradients."""
        n, (steps, lanes) = self.hidden, y.shape
        room = Room(self.embed.dtype) if room is None else room
        grad = self.parts(np.zeros(sum(getattr(self, k).size for k in self.NAMES), self.embed.dtype)) if grad is None else grad
        flat, size = y.ravel(), y.size
        order, u = self.sorted(flat), self.gates(self.u)
        token = flat.take(order)
        fresh = np.r_[True, token[1:] != token[:-1]]
        first, which = np.flatnonzero(fresh), np.empty((steps, lanes), np.int64)
        which.reshape(-1)[order] = np.cumsum(fresh) - 1
        table = np.matmul(self.embed.take(token[first], 0), self.gates(self.w))  # of the distinct tokens
        table += self.gates(self.b)
        a, g, carried = room("a", 3, steps, lanes, n), room("g", 3, lanes, n), room("carried", steps, lanes, n)
        on, ends = (y != 1).astype(a.dtype)[:, :, None], (y == 1).any(1).tolist()
        states = room("states", steps, lanes, n)
        with np.errstate(over="ignore"):
            for t in range(steps):
                states[t] = h
                for k in range(3):
                    np.take(table[k], which[t], 0, out=a[k, t], mode="clip")
                h = self.step(a[:, t], h, u, g)
                carried[t] = g[2]
                if ends[t]:
                    h *= on[t]
        logp, dh_out = self.output(states.reshape(-1, n), flat, grad, room, order)
        dh_out = dh_out.reshape(steps, lanes, n)
        by_gate = lambda weights: weights.reshape(-1, 3, n).transpose(1, 2, 0)
        dh, slope, d, parts = np.zeros_like(h), room("slope", 2, lanes, n), room("d", 4, lanes, n), room("parts", 3, lanes, n)
        from_u, from_w = np.ascontiguousarray(by_gate(self.u)[[2, 0, 1]]), np.ascontiguousarray(by_gate(self.w))
        dx, ones, inputs = room("dx", steps, lanes, self.embed.shape[1]), np.ones(lanes, a.dtype), room("inputs", 3, lanes, self.embed.shape[1])
        du, dw, db = np.zeros((3, n, n), a.dtype), np.zeros((3, self.embed.shape[1], n), a.dtype), np.zeros((3, n), a.dtype)
        for t in reversed(range(steps)):  # what a step needs stays in the processor's cache
            zr, new, dg, da = a[:2, t], a[2, t], d[:3], d[1:]  # the new state's part of h, update, reset, new state
            if ends[t]:
                dh *= on[t]
            np.subtract(1, zr, out=slope)
            slope *= zr
            slope[1] *= 0.5  # what is carried is double
            np.subtract(states[t], new, out=d[1])
            d[1] *= dh
            d[1] *= slope[0]
            through = dh * zr[0]
            dh -= through
            np.multiply(new, new, out=d[3])
            np.subtract(1, d[3], out=d[3])
            d[3] *= dh
            np.multiply(d[3], carried[t], out=d[2])
            d[2] *= slope[1]
            np.multiply(d[3], zr[1], out=d[0])
            du += np.matmul(states[t].T, dg)
            dw += np.matmul(self.embed.take(y[t], 0).T, da)
            db += np.matmul(ones, da)
            np.matmul(da, from_w, out=inputs)
            np.add(inputs[0], inputs[1], out=dx[t])
            dx[t] += inputs[2]
            np.matmul(dg, from_u, out=parts)
            np.add(parts[0], parts[1], out=dh)
            dh += parts[2]
            dh += through
            dh += dh_out[t]
        grad["u"] += du[[1, 2, 0]].transpose(1, 0, 2).reshape(n, -1)
        grad["w"] += dw.transpose(1, 0, 2).reshape(-1, 3 * n)
        grad["b"] += db.ravel()
        dx, many = dx.reshape(size, -1), np.diff(first, append=size) > 1
        once, token = first[~many], token[first]
        grad["embed"][token[~many]] += dx.take(order[once], 0)
        if many.any():
            rest = np.ones(size, bool)
            rest[once] = False
            grad["embed"][token[many]] += np.add.reduceat(dx.take(order[rest], 0), first[many] - np.cumsum(~many)[many], axis=0)
        return float(logp.sum()), grad, h

    def train(self, stream: np.ndarray, lanes: int = 256, steps: int = 32, rate: float = 0.01, state: dict | None = None) -> dict:
        """Adam over a stream of documents (each ends with token 1), cut into lanes; end tokens fill the last lane.

        Its sums of gradients and of their squares are kept without the factors 0.1 and 0.01."""
        flat = self.flat()
        for k, part in self.parts(flat).items():
            setattr(self, k, part)
        state = state or {"t": 0, "m": np.zeros_like(flat), "v": np.zeros_like(flat)}
        room, slopes = Room(flat.dtype), np.empty_like(flat)
        grad, spare = self.parts(slopes), np.empty(min(CHUNK, len(flat)), flat.dtype)
        lanes = max(1, min(lanes, len(stream) // (4 * steps)))
        long = -(-len(stream) // lanes)
        y = np.ascontiguousarray(np.concatenate([stream, np.ones(long * lanes - len(stream), stream.dtype)]).reshape(lanes, long).T)
        h = np.zeros((lanes, self.hidden), np.float32)
        for start in range(0, long, steps):
            some = y[start : start + steps]
            slopes.fill(0)
            _, _, h = self.window(some, h, room, grad)
            state["t"] += 1
            t, scale = state["t"], 1.0 / some.size
            scale *= min(1.0, 1.0 / max(scale * float(np.sqrt(slopes @ slopes)), 1e-9))
            root = 0.1 / float(np.sqrt(1 - 0.99**t))
            pace = 0.1 * rate / (1 - 0.9**t) / root
            for at in range(0, len(flat), CHUNK):  # chunks that stay in the processor's cache
                g, m, v = (x[at : at + CHUNK] for x in (slopes, state["m"], state["v"]))
                change = spare[: len(g)]
                g *= scale
                m *= 0.9
                m += g
                g *= g
                v *= 0.99
                v += g
                np.sqrt(v, out=change)
                change += 1e-7 / root
                np.divide(m, change, out=change)
                change *= pace
                flat[at : at + CHUNK] -= change
        return state

    def score(self, documents: list[np.ndarray], rows: int = 32_768, lanes: int = 512) -> np.ndarray:
        """log P (natural) of whole documents; the states of `lanes` documents of like length run side by side."""
        result = np.zeros(len(documents))
        if not documents:
            return result
        room, u, n = Room(self.embed.dtype), self.gates(self.u), self.hidden
        table = np.matmul(self.embed, self.gates(self.w))
        table += self.gates(self.b)
        size = np.array([len(x) for x in documents])
        order = np.argsort(-size, kind="stable")
        flat = np.concatenate([documents[i] for i in order])
        size = size[order]
        begin = np.cumsum(size) - size
        rows = max(rows, lanes)
        states, wanted, whose, waiting = np.empty((rows, n), table.dtype), np.empty(rows, flat.dtype), np.empty(rows, np.int64), 0

        def settle():
            nonlocal waiting
            if waiting:
                logp, _ = self.output(states[:waiting], wanted[:waiting], room=room)
                result[:] += np.bincount(whose[:waiting], logp, len(result))
            waiting = 0

        with np.errstate(over="ignore"):
            for at in range(0, len(order), lanes):
                own, mine = size[at : at + lanes], order[at : at + lanes]
                live = np.searchsorted(-own, -np.arange(own[0]), side="left").tolist()  # documents longer than t
                h, place = np.zeros((len(own), n), table.dtype), begin[at : at + lanes].copy()
                for k in live:
                    if waiting + k > rows:
                        settle()
                    h, stop = h[:k], waiting + k
                    y = flat.take(place[:k], out=wanted[waiting:stop], mode="clip")
                    states[waiting:stop], whose[waiting:stop] = h, mine[:k]
                    waiting = stop
                    place += 1
                    a = np.take(table, y, 1, out=room("a", 3, k, n), mode="clip")
                    h = self.step(a, h, u, room("g", 3, k, n))
        settle()
        return result


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c) over all rows."""

    def rows(it):
        seen: Counter = Counter()

        def told():
            batch = pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "c"])
            seen.clear()
            return batch

        for batch in batches(it, 500):
            for t in texts_of(batch):
                seen.update(tokens(t))
            if len(seen) > 1_000_000:
                yield told()
        yield told()

    return docs.select("text").mapInArrow(rows, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def class_sizes(counts: np.ndarray, classes: int) -> np.ndarray:
    """Sizes of classes that follow one another over tokens by rank, about as the inverse root of their frequency:
    that makes the softmax inside a class shortest on average. counts: of the tokens."""
    weight = np.cumsum(np.sqrt(np.maximum(counts, 0.5)))
    cuts = np.searchsorted(weight, weight[-1] * np.arange(1, classes) / classes)
    cuts = np.minimum(np.maximum.accumulate(np.maximum(cuts - np.arange(classes - 1), 1)) + np.arange(classes - 1), len(counts) - np.arange(classes - 1, 0, -1))
    return np.diff(np.r_[0, cuts, len(counts)])


def score_documents(docs: DataFrame, head_words: int = 131_072, classes: int = 90, start_rows: int = 400, shard_tokens: int = 2_000_000, seed: int = 5, learned: bool = True) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row; logarithms to base 10.

    Without `learned` no model is trained and there is no column score: all others come from counts alone."""
    spark = docs.sparkSession
    small_batches(spark, 4000)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("fold", F.coalesce(bucket_of(F.col("doc_id"), 10), F.lit(1)).cast("long"))
    counts = materialise(count_words(rows.where("fold != 0")), "gru-counts")
    total = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
    n_all, v_all = int(total[0] or 0), int(total[1])
    top = most_frequent(counts.where(F.length("word") <= 256), "c", head_words).toArrow().to_pydict()
    ranked = sorted(zip(top["word"], top["c"], strict=True), key=lambda x: (-x[1], x[0]))
    ends = sum(c for w, c in ranked if w == END)
    ranked = [x for x in ranked if x[0] != END]
    members = classes
    chosen = ranked[: classes * members - 2]
    inside = sum(c for _, c in chosen) + ends
    n_other, v_other = n_all - inside, v_all - len(chosen) - bool(ends)
    head = {w: (c, 0) for w, c in ranked} | {w: (c, k) for k, (w, c) in enumerate(chosen, 2)} | {END: (ends, 1)}
    words = list(head)
    place = {w: i for i, w in enumerate(words)}
    head_count = np.array([head[w][0] for w in words], np.float64)
    head_token = np.array([head[w][1] for w in words], np.int32)
    unigram = np.zeros(classes * members)
    unigram[0], unigram[1] = n_other, ends
    unigram[2 : len(chosen) + 2] = [c for _, c in chosen]
    model = Gru(classes, members, seed=seed, sizes=class_sizes(unigram, classes)).start_from(unigram)
    shared = spark.sparkContext.broadcast((place, head_count, head_token))
    wide = np.dtype("<u2" if len(unigram) < 2**16 else "<u4")

    def encoded(it):
        place, head_count, head_token = shared.value
        get, end = place.get, place[END]
        # the last entry is that of -1, a word outside the head
        token_of, log_of, known_of = (np.append(x, x.dtype.type(0)) for x in (head_token.astype(wide), np.log10(head_count + SMOOTH), (head_count > 0).astype(np.int64)))
        part, number = TaskContext.get().partitionId() << 33, 0
        for batch in by_size(it, 4_000_000):
            words = tokens_of(texts_of(batch))
            at = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
            stop = np.flatnonzero(at == end) + 1
            start = np.r_[0, stop[:-1]]
            token, log = token_of.take(at), log_of.take(at)
            sums = lambda x: np.add.reduceat(x, start)
            unknown, missed = token == 0, np.flatnonzero(at < 0)
            known, base, other, other_sum = sums(known_of.take(at)), sums(log), sums(unknown.astype(np.int64)), sums(log * unknown)
            cuts = np.searchsorted(missed, np.r_[start, len(at)])
            out, rare, rare_n, bounds = [words[i] for i in missed.tolist()], [], [], [0]
            for a, b in pairwise(cuts.tolist()):
                if a < b:
                    found = Counter(out[a:b])
                    rare += found
                    rare_n += found.values()
                bounds.append(len(rare))
            lists = lambda x, kind: pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(x, kind))
            ends = np.r_[0, stop] * wide.itemsize
            blobs = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(token)])
            keys = pa.array(range(part + number, part + number + len(start)), pa.int64())
            number += len(start)
            yield pa.RecordBatch.from_arrays(
                [keys, *(batch.column(c) for c in ("doc_id", "fold", "place")), blobs, *(pa.array(x, pa.int64()) for x in (stop - start, known, other, np.diff(cuts))), *(pa.array(x, pa.float64()) for x in (base, other_sum)), lists(rare, pa.binary()), lists(rare_n, pa.int64())],
                ["key", "doc_id", "fold", "place", "tokens", "n_tokens", "known", "n_other", "n_rare", "base", "other_sum", "rare", "rare_n"],
            )

    schema = "key long, doc_id long, fold long, place long, tokens binary, n_tokens long, known long, n_other long, n_rare long, base double, other_sum double, rare array<binary>, rare_n array<long>"
    made = materialise(rows.withColumn("place", F.xxhash64("text", "doc_id", F.lit(seed))).mapInArrow(encoded, schema), "gru-encoded")
    read = lambda blob: np.frombuffer(blob, wide).astype(np.int64)
    learn = made.where("fold != 0")

    if n_all and learned:
        few = learn.where("n_tokens < 4000").orderBy("place", "doc_id").limit(start_rows).select("tokens").collect()
        if few:
            model.train(np.concatenate([read(r.tokens) for r in few]), lanes=64, steps=16)
        started = spark.sparkContext.broadcast(model)
        shards = -(-n_all // shard_tokens)  # by the data alone, so that the weights do not depend on partitions

        def trained(it):
            from copy import deepcopy

            mine, state, held, waiting, seen, shard = None, None, [], 0, 0, None

            def learn_held():
                nonlocal state, seen, waiting
                stream = np.concatenate(held)
                state = mine.train(stream, state=state)
                seen += len(stream)
                waiting = 0
                held.clear()

            def told():
                if held:
                    learn_held()
                flat = mine.flat().astype(np.float64) * seen
                cut = 65_536
                parts = [flat[i : i + cut].tobytes() for i in range(0, len(flat), cut)] + [np.array([float(seen)]).tobytes()]
                numbers = [*range(len(parts) - 1), -1]
                return pa.RecordBatch.from_arrays([pa.array([shard] * len(parts), pa.int64()), pa.array(numbers, pa.int32()), pa.array(parts, pa.binary())], ["part", "chunk", "blob"])

            for batch in it:
                for own, blob in zip(batch.column("shard").to_pylist(), batch.column("tokens").to_pylist(), strict=True):
                    if own != shard:
                        if shard is not None:
                            yield told()
                        mine, state, seen, shard = deepcopy(started.value), None, 0, own
                    held.append(read(blob))
                    waiting += len(held[-1])
                    if waiting >= 1_000_000:
                        learn_held()
            if shard is not None:
                yield told()

        dealt = learn.select(F.pmod("place", F.lit(shards)).alias("shard"), "place", "doc_id", "tokens").repartition("shard").sortWithinPartitions("shard", "place", "doc_id")
        sums = summed_blobs(dealt.select("shard", "tokens").mapInArrow(trained, "part long, chunk int, blob binary"), "<f8", shards)
        if sums:
            flat = np.concatenate([np.frombuffer(sums[k], "<f8") for k in sorted(k for k in sums if k >= 0)])
            model.load(flat / np.frombuffer(sums[-1], "<f8")[0])
    final = spark.sparkContext.broadcast(model)
    log_all = float(np.log10(n_all + SMOOTH * (v_all + 1)))
    log_other = float(np.log10(n_other + SMOOTH * (v_other + 1)))
    passed = ("key", "doc_id", "fold", "n_tokens", "known", "n_other", "n_rare", "base", "other_sum")

    def scores(it):
        mine = final.value
        for batch in it:
            blobs = batch.column("tokens").to_pylist()
            start = total = 0
            for stop, blob in enumerate([*blobs, b""], 1):
                total += len(blob)
                if stop > len(blobs) or total > 4_000_000:
                    stop = min(stop, len(blobs))
                    some = batch.slice(start, stop - start)
                    gru = mine.score([read(x) for x in blobs[start:stop]]) / np.log(10.0)
                    yield pa.RecordBatch.from_arrays([*(some.column(c) for c in passed), pa.array(gru, pa.float64())], [*passed, "gru"])
                    start, total = stop, 0

    scored = made.select(*passed, "tokens").mapInArrow(scores, "key long, doc_id long, fold long, n_tokens long, known long, n_other long, n_rare long, base double, other_sum double, gru double")
    rare = made.select("key", F.explode(F.arrays_zip("rare", "rare_n")).alias("r")).select("key", F.col("r.rare").alias("word"), F.col("r.rare_n").alias("n"))
    met = rare.join(counts, "word").select("key", "n", "c")
    sums = met.groupBy("key").agg(F.sum(F.col("n") * (F.log10(F.col("c") + SMOOTH) - float(np.log10(SMOOTH)))).alias("rare_sum"), F.sum("n").alias("rare_known"))
    rare_sum = F.col("n_rare") * float(np.log10(SMOOTH)) + F.coalesce("rare_sum", F.lit(0.0))
    base = F.col("base") + rare_sum - F.col("n_tokens") * log_all
    score = F.col("gru") + F.col("other_sum") + rare_sum - F.col("n_other") * log_other
    columns = [
        "doc_id",
        (F.col("fold") == 0).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        base.alias("base_score"),
    ]
    if not learned:
        return made.select(*passed).join(sums, "key", "left").select(*columns)
    return scored.join(sums, "key", "left").select(*columns, (score if n_all else base).alias("score"))
