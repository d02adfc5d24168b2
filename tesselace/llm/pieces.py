"""SentencePiece encoding and decoding: distinct sampled segmentations without replacement.

A text's lattice is a row of small lattices, one for each unit (a run of spaces with the word after it; a line
break). A piece's weight is a Zipf-Mandelbrot probability of its rank in the vocabulary. Gumbel top-k: the space of
segmentations is searched by A* over regions, each a set {keep to a segmentation found for some units, leave it at one
of a range of units, rest free} whose best perturbed log-probability is a Gumbel variable truncated by that of the
region it was cut from. Popping the best region gives the next segmentation; what is left of the region is cut into
leaving it earlier, later, or there by yet another path, and what leaves the new segmentation is a region too.
Segmentations of one row are thus distinct and drawn without replacement; the inclusion score of each is
log(1 - exp(-exp(log_prob - kappa))), kappa the value of the best region that is left. All random numbers are hashes
of (seed, doc_id, sample, unit, step), so they do not depend on partitions or batches.

Decoding turns ids into bytes and those into text; every sample is decoded and compared with its text.

Null and empty texts have one segmentation, of no pieces. Characters outside the vocabulary, and a literal U+2581,
are byte pieces. A text with fewer segmentations than samples has fewer rows; regions of less than 1e-12 of the
probability of the units before them count as empty, for that is the rounding error of their sums. Rows of a null doc_id share a seed.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_left
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_size, small_batches, texts_of

UNIT = re.compile(" *+[^ \n▁]++|▁|\n| +(?=[\n▁]|\\Z)")  # what is most frequent is tried first
SPACE, LITERAL = 0x2581, 0x110001
LEAST = 1e-12
PLAIN = 16  # characters of a unit whose weights do not leave the range of doubles
_ALL = 2**64 - 1
_C1, _C2, _C3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
SCHEMA = "doc_id long, sample int, n_pieces long, log_prob double, perturbed double, log_inclusion double, ids_crc32 long, decoded boolean"


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _C1
    x = (x ^ (x >> np.uint64(27))) * _C2
    return x ^ (x >> np.uint64(31))


def uniform(x: np.ndarray) -> np.ndarray:
    return ((mix(x) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices starts[0] .. starts[0] + counts[0] - 1, starts[1] .. and so on."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


class Model:
    """Pieces of a SentencePiece model file, with weights."""

    def __init__(self, path: str, offset: float = 100.0):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        usable = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        weight = -np.log(np.arange(n) + offset)
        weight -= np.log(np.exp(weight).sum())
        self.weight, self.byte_weight = weight, float(weight[-1])
        self.byte_id = np.zeros(256, np.int32)
        self.bytes = [b""] * n
        for i in range(n):
            if sp.is_byte(i):
                b = int(sp.id_to_piece(i)[1:-1], 16)
                self.byte_id[b], self.bytes[i] = i, bytes([b])
        self.single = np.full(LITERAL + 1, -1, np.int32)
        prefixes: dict[int, int] = {}
        code = mix(np.arange(LITERAL + 1, dtype=np.uint64) + _C3)
        self.code = code
        for i in usable:
            piece = sp.id_to_piece(i)
            self.bytes[i] = piece.replace("▁", " ").encode()
            if len(piece) == 1:
                self.single[ord(piece)] = i
            h = 0
            for k, c in enumerate(piece):
                h = (h * 0x9E3779B97F4A7C15 + int(code[ord(c)])) % 2**64
                if k == len(piece) - 1:
                    prefixes[h] = i
                else:
                    prefixes.setdefault(h, -1)
        self.bits = (2 * len(prefixes)).bit_length()  # an open table, about a third of it taken
        self.keys, self.ids = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -2, np.int32)
        for k in sorted(prefixes):
            at = k * 0x9E3779B97F4A7C15 % 2**64 >> 64 - self.bits
            while self.ids[at] != -2:
                at = (at + 1) % len(self.ids)
            self.keys[at], self.ids[at] = k, prefixes[k]
        self.starts = np.zeros(LITERAL + 1, bool)  # characters that a longer piece begins with
        for i in usable:
            if len(piece := sp.id_to_piece(i)) > 1:
                self.starts[ord(piece[0])] = True
        self.table = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.length = np.array([len(b) for b in self.bytes])
        self.at = np.cumsum(self.length) - self.length

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece of each hash of a run of characters; -1 where only longer pieces begin so, -2 where none does."""
        at = (h * _C3 >> np.uint64(64 - self.bits)).astype(np.int64)
        out = self.ids[at]
        rest = np.flatnonzero((out != -2) & (self.keys[at] != h))
        while len(rest):
            at[rest] = (at[rest] + 1) % len(self.ids)
            out[rest] = self.ids[at[rest]]
            rest = rest[(out[rest] != -2) & (self.keys[at[rest]] != h[rest])]
        return out

    def decode_bytes(self, ids: np.ndarray) -> np.ndarray:
        return self.table[ragged(self.at[ids], self.length[ids])]

    def decode(self, ids) -> str:
        """The text of a segmentation (without the space that encoding puts in front)."""
        return self.decode_bytes(np.asarray(ids, np.int64)).tobytes().decode()[1:]


class Numbers(dict):
    """Numbers of units; new ones are noted."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, unit: str) -> int:
        n = self[unit] = len(self)
        self.new.append(unit)
        return n


class Lattices:
    """Lattices of distinct units: states are (unit, place), edges are pieces, with conditional probabilities."""

    EDGES = ("piece", "logp", "cumulative", "step")

    def __init__(self, model: Model, units: list[str]):
        self.model, self.index = model, Numbers()
        self.room: dict[str, np.ndarray] = {}
        self.first = self.last = self.begin = np.zeros(0, np.int32)
        self.code = self.width = np.zeros(0, np.int32)
        self.seen = np.zeros(0, np.int64)
        self.piece, self.logp, self.cumulative, self.step = np.zeros(0, np.int32), np.zeros(0), np.zeros(0), np.zeros(0, np.uint8)
        self.numbers(units)

    def numbers(self, units: list[str]) -> np.ndarray:
        """The units' numbers; those that are new are laid out."""
        out = np.fromiter(map(self.index.__getitem__, units), np.int32, len(units))
        if self.index.new:
            self.add(self.index.new)
            self.index.new = []
        seen = np.bincount(out, minlength=len(self.index))
        seen[: len(self.seen)] += self.seen
        self.seen = seen
        return out

    def forget(self, most: int) -> None:
        """Drop the units that were met once, or all if that leaves more than so many edges."""
        kept = np.flatnonzero(self.seen > 1)
        edges = np.append(self.begin, len(self.piece))
        low, high = edges[self.first[kept]].astype(np.int64), edges[self.last[kept] + 1].astype(np.int64)
        if (high - low).sum() > most:
            self.__init__(self.model, [])
            return
        units = list(self.index)
        states, sizes = self.first[kept].astype(np.int64), (self.last - self.first + 1)[kept].astype(np.int64)
        places = states - kept
        index = Numbers()
        index.update(zip([units[k] for k in kept.tolist()], range(len(kept)), strict=True))
        at, counts = ragged(low, high - low), high - low
        new_edges, new_states = np.cumsum(counts) - counts, np.cumsum(sizes) - sizes
        piece = self.piece[at]
        odd = np.flatnonzero(piece < 0)
        piece[odd] += np.repeat(places - (new_states - np.arange(len(kept))), counts)[odd].astype(np.int32)
        every = ragged(states, sizes)
        begin = (self.begin[every] + np.repeat(new_edges - low, sizes)).astype(np.int32)
        code = ragged(places, sizes - 1)
        self.room = {}
        self.index, self.seen, self.piece, self.begin = index, self.seen[kept], piece, begin
        self.first, self.last = new_states.astype(np.int32), (new_states + sizes - 1).astype(np.int32)
        self.code, self.width = self.code[code], self.width[code]
        self.logp, self.cumulative, self.step = self.logp[at], self.cumulative[at], self.step[at]

    def add(self, units: list[str]) -> None:
        had, states, edges, places = self.__dict__.copy(), len(self.begin), len(self.piece), len(self.code)
        self.build(units)
        self.piece = np.where(self.piece < 0, self.piece - places, self.piece).astype(np.int32)
        for name, offset in (("first", states), ("last", states), ("begin", edges), ("code", 0), ("width", 0), *((n, 0) for n in self.EDGES)):
            new = getattr(self, name)
            setattr(self, name, self.joined(name, had[name], new + offset if offset else new))

    def joined(self, name: str, old: np.ndarray, new: np.ndarray) -> np.ndarray:
        """old followed by new, in an array with room for more, so that old is seldom copied."""
        n, stop = len(old), len(old) + len(new)
        room = self.room.get(name)
        if room is None or old.base is not room or len(room) < stop:
            room = self.room[name] = np.empty(stop + stop // 2, old.dtype)
            room[:n] = old
        room[n:stop] = new
        return room[:stop]

    def build(self, units: list[str]) -> None:
        model = self.model
        code = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        code = np.where(code == SPACE, LITERAL, np.where(code == 32, SPACE, code))
        size = np.array([len(u) for u in units], np.int64)
        stop = np.cumsum(size)
        unit = np.repeat(np.arange(len(units)), size)
        self.first = stop - size + np.arange(len(units))  # first state of each unit; its last is the end
        self.last = self.first + size
        state = np.arange(len(code)) + unit
        n_states = len(code) + len(units)
        found: list[tuple[np.ndarray, np.ndarray, int]] = []  # start place, piece or -1, length
        everywhere = np.arange(len(code))
        found.append((everywhere, model.single[code], 1))
        live = everywhere[model.starts[code] & (everywhere + 2 <= stop[unit])]
        h = model.code[code[live]]
        length = 1
        while len(live):
            length += 1
            h = h * _C3 + model.code[code[live + length - 1]]
            piece = model.find(h)
            ok = piece != -2
            live, h, piece = live[ok], h[ok], piece[ok]
            hit = piece >= 0
            found.append((live[hit], piece[hit], length))
            longer = live + length + 1 <= stop[unit[live]]
            live, h = live[longer], h[longer]
        count = np.zeros(n_states, np.int64)
        for place, _, _ in found:
            count[state[place]] += 1
        self.begin = np.cumsum(count) - count
        n = int(count.sum())
        self.piece, self.step, weight = np.empty(n, np.int32), np.empty(n, np.uint8), np.empty(n)
        cursor = self.begin.copy()
        width = np.where(code < 0x80, 1, np.where(code < 0x800, 2, np.where((code < 0x10000) | (code == LITERAL), 3, 4)))
        for place, piece, length in reversed(found):  # the longest, which are likely, come first
            s = state[place]
            e = cursor[s]
            cursor[s] += 1
            self.piece[e] = np.where(piece >= 0, piece, -1 - place)  # -1 - place: bytes of the character there
            self.step[e] = length
            weight[e] = np.where(piece >= 0, model.weight[piece], width[place] * model.byte_weight)
        self.code = np.where(code == LITERAL, SPACE, code).astype(np.int32)
        self.width = width.astype(np.int32)
        # what leads from each state to its unit's end: in short units as plain numbers, a factor of e^9 for each character
        # keeping them in range; in long ones as logarithms
        away = np.zeros(n_states, np.int64)
        away[state] = stop[unit] - everywhere
        in_long = np.repeat(size > PLAIN, size)
        start = np.repeat(np.arange(n_states), count)
        target = start + self.step

        def levels(states: np.ndarray):
            """The states by their distance from the end, with their edges and where each one's begin."""
            far = away[states]
            order = states[np.argsort(far.astype(np.int16) if size.max(initial=0) < 2**15 else far, kind="stable")]
            cuts = np.searchsorted(away[order], np.arange(1, int(far.max(initial=0)) + 2))
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a < b:
                    some = order[a:b]
                    yield some, ragged(self.begin[some], count[some]), np.cumsum(count[some]) - count[some]

        weigh = np.exp(np.minimum(weight + 9.0 * self.step, 600.0))
        ahead = np.ones(n_states)
        for some, e, at in levels(state[~in_long]):
            ahead[some] = np.add.reduceat(weigh[e] * ahead[target[e]], at)
        share = weigh
        share *= ahead[target]
        share /= ahead[start]
        if in_long.any():
            beta = np.zeros(n_states)
            for some, e, at in levels(state[in_long]):
                x = weight[e] + beta[target[e]]
                top = np.maximum.reduceat(x, at)
                beta[some] = top + np.log(np.add.reduceat(np.exp(x - np.repeat(top, count[some])), at))
            odd = np.zeros(n_states, bool)
            odd[state[in_long]] = True
            odd = np.flatnonzero(odd[start])
            logs = np.minimum(weight[odd] + beta[target[odd]] - beta[start[odd]], 0.0)
            share[odd] = np.exp(logs)
        np.minimum(share, 1.0, out=share)
        with np.errstate(divide="ignore"):
            self.logp = np.log(share)
        if in_long.any():
            self.logp[odd] = logs
        total = np.cumsum(share)
        before = np.r_[0.0, total][self.begin]
        self.cumulative = total - before[start]
        ends = self.begin[count > 0] + count[count > 0] - 1
        self.cumulative[ends] = 1.0

    def paths(self, unit: np.ndarray, key: np.ndarray):
        """One random segmentation of each unit: log-probability, number of edges, edges in order."""
        now, end = self.first[unit], self.last[unit]
        logp, n = np.zeros(len(unit)), np.zeros(len(unit), np.int32)
        act, steps, j = np.arange(len(unit), dtype=np.int32), [], 0
        key = mix(key)
        while len(act):
            e = self.begin[now]
            u = ((key * np.uint64(pow(0xD1342543DE82EF95, j + 1, 2**64)) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
            more = np.flatnonzero(u > self.cumulative[e])
            while len(more):
                e[more] += 1
                more = more[u[more] > self.cumulative[e[more]]]
            logp[act] += self.logp[e]
            j += 1
            n[act] = j
            steps.append((act, e))
            now = now + self.step[e]
            on = np.flatnonzero(now < end)
            act, now, end, key = act[on], now[on], end[on], key[on]
        at = np.cumsum(n, dtype=np.int32) - n
        edges = np.empty(int(n.sum()), np.int32)
        for j, (act, e) in enumerate(steps):
            edges[at[act] + j] = e
        return logp, n, edges

    def other_path(self, unit: int, taken: list[list[int]], key: int):
        """A random segmentation of one unit that is none of those taken; None if there is none (what is left of an edge
        below 1e-13 is taken for rounding)."""
        s, end, logp, edges, left = int(self.first[unit]), int(self.last[unit]), 0.0, [], []
        for path in taken:
            total, rest = 0.0, []
            for x in reversed(self.logp[path].tolist()):
                total += x
                rest.append(math.exp(total))
            left.append((path, rest[::-1]))
        while s != end:
            j, low = len(edges), int(self.begin[s])
            logs = self.logp[low : int(self.begin[s + 1])].tolist()
            weights, total = [], 0.0
            for e, x in enumerate(logs, low):
                w = math.exp(x)
                for path, rest in left:
                    if path[j] == e:
                        w -= rest[j]
                if w > 1e-13:
                    total += w
                weights.append(total)
            if total <= 0.0:
                return None
            k = min(bisect_left(weights, uniform_of(key + (j + 1) * int(_C3)) * total), len(logs) - 1)
            left = [x for x in left if x[0][j] == low + k]
            edges.append(low + k)
            logp += logs[k]
            s += int(self.step[low + k])
        return logp, len(edges), np.array(edges, np.int32)

    def every(self, unit: int) -> list[tuple[float, int, list[int]]]:
        """All segmentations of one unit: log-probability, hash, edges."""
        out, todo = [], [(int(self.first[unit]), 0.0, 0, [])]
        while todo:
            s, lp, name, edges = todo.pop()
            if s == self.last[unit]:
                out.append((lp, name, edges))
                continue
            e = int(self.begin[s])
            while True:
                todo.append((s + int(self.step[e]), lp + float(self.logp[e]), (name * int(_C1) + int(self.step[e])) % 2**64, [*edges, e]))
                if self.cumulative[e] >= 1.0:
                    break
                e += 1
        return out

    def ids(self, edges: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of edges, and their numbers for runs of `per` edges."""
        piece = self.piece[edges].astype(np.int64)
        odd = np.flatnonzero(piece < 0)
        if not len(odd):
            return piece, per
        count = np.ones(len(piece), np.int64)
        place = -1 - piece[odd]
        count[odd] = self.width[place]
        out = np.repeat(piece, count)
        at = np.cumsum(count) - count
        raw = np.frombuffer(np.array(self.code[place], np.uint32).tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)
        out[ragged(at[odd], count[odd])] = self.model.byte_id[raw]
        ends = np.r_[0, np.cumsum(count)]
        stop = np.cumsum(per)
        return out, ends[stop] - ends[stop - per]


def mixed(x: int) -> int:
    """mix of one number."""
    x &= _ALL
    x = (x ^ x >> 30) * int(_C1) & _ALL
    x = (x ^ x >> 27) * int(_C2) & _ALL
    return x ^ x >> 31


def uniform_of(x: int) -> float:
    return ((mixed(x) >> 11) + 0.5) * 2.0**-53


def truncated(phi: float, top: float, key: int) -> float:
    """A Gumbel variable of location phi, given that it is below top."""
    if phi == -math.inf:
        return phi
    a, b = -top, math.log(-math.log(uniform_of(key))) - phi
    low, high = min(a, b), max(a, b)
    return -(high + math.log1p(math.exp(low - high)))


class Leaf:
    """One segmentation of a text: for each unit its log-probability, number of edges and edges."""

    def __init__(self, logp: np.ndarray, n: np.ndarray, edges: np.ndarray, top: float):
        self.n, self.edges, self.top = n, edges, top
        self.fall = np.zeros(len(logp) + 1)  # minus the log-probability of the units before each
        np.cumsum(-logp, out=self.fall[1:])
        self.stop = np.zeros(len(n) + 1, np.int64)
        np.cumsum(n, out=self.stop[1:])

    def mass(self, lo: int, hi: int) -> float:
        """log of the probability of keeping to this segmentation up to unit lo and leaving it before unit hi; what is
        below 1e-12 of the former is taken for rounding: nothing."""
        left = -math.expm1(self.fall[lo] - self.fall[hi])
        return -self.fall[lo] + math.log(left) if left > LEAST else -math.inf

    def departure(self, lo: int, hi: int, u: float) -> int:
        """The unit at which it is left, drawn by probability."""
        y = math.log1p(u * math.expm1(self.fall[lo] - self.fall[hi]))
        return min(lo + int(np.searchsorted(self.fall[lo + 1 : hi + 1], self.fall[lo] - y)), hi - 1)

    def path(self, t: int) -> list[int]:
        return self.edges[self.stop[t] : self.stop[t + 1]].tolist()


def sample_texts(model: Model, texts: list[str], keys: np.ndarray, k: int, lattices: Lattices | None = None):
    """lattices: kept from one call to the next, so that a unit is laid out once. Yields (sample, documents, log_prob,
    perturbed, kappa, ids, ids per document) for each sample of a batch; no text is empty.

    A region is (value, leaf, lo, hi, taken): all segmentations that keep to a leaf up to a unit in lo .. hi - 1 and leave
    it there; with `taken`, those that leave it at lo by none of the paths taken. The value is that of its best."""
    lattices = lattices or Lattices(model, [])
    split = [UNIT.findall(" " + t) for t in texts]
    per = np.array([len(x) for x in split], np.int64)
    unit = lattices.numbers(list(chain.from_iterable(split)))
    del split
    ends = np.cumsum(per)
    begin = ends - per
    place = np.arange(len(unit)) - np.repeat(begin, per)
    token_key = mix(np.repeat(keys, per) + place.astype(np.uint64) * _C3)
    salt = lambda s, t=0: (s * 1_000_003 + t) * 0x9E3779B97F4A7C15 & _ALL
    key_of = [int(x) for x in keys]

    def cut_up(logp, n, edges, sizes, tops) -> list[Leaf]:
        """Leaves of consecutive runs of units."""
        units = np.r_[0, np.cumsum(sizes)]
        stops = np.r_[0, np.cumsum(n, dtype=np.int64)][units].tolist()
        units = units.tolist()
        return [(logp[a:b], n[a:b], edges[c:d], top) for a, b, c, d, top in zip(units, units[1:], stops, stops[1:], tops, strict=False)]

    tops = [-math.log(-math.log(uniform_of(x + salt(1, 1)))) for x in key_of]
    first = [Leaf(*x) for x in cut_up(*lattices.paths(unit, mix(token_key + np.uint64(salt(1)))), per, tops)]
    found: list[list[Leaf | None]] = [first]
    regions = [[(truncated(x.mass(0, int(m)), x.top, key + salt(1, 2)), x, 0, int(m), None)] for x, m, key in zip(first, per, key_of, strict=True)]
    for s in range(2, k + 1):
        turns: list[tuple] = []
        for d, mine in enumerate(regions):
            tries = 0
            while mine:
                value, leaf, lo, hi, taken = mine.pop(max(range(len(mine)), key=lambda i: mine[i][0]))
                if value == -math.inf:
                    mine.clear()
                    break
                tries += 1
                own = key_of[d] + salt(s, 100 * tries)
                t = lo if taken else leaf.departure(lo, hi, uniform_of(own + 1))
                if not taken:
                    mine += [(truncated(leaf.mass(a, b), value, own + 2 + (a > lo)), leaf, a, b, None) for a, b in ((lo, t), (t + 1, hi)) if a < b]
                taken = taken or ([leaf.path(t)], math.exp(leaf.fall[t] - leaf.fall[t + 1]))
                at = int(begin[d]) + t
                got = lattices.other_path(int(unit[at]), taken[0], int(token_key[at]) + salt(s, 10 + tries))
                if got is None:  # nothing but the taken ones is there
                    continue
                used = taken[1] + math.exp(got[0])
                if 1 - used > LEAST:
                    mine.append((truncated(math.log(1 - used) - leaf.fall[t], value, own + 4), leaf, t, t + 1, ([*taken[0], got[2].tolist()], used)))
                turns.append((d, value, leaf, t, got))
                break
        late = ragged(np.array([begin[d] + t + 1 for d, _, _, t, _ in turns], np.int64), np.array([per[d] - t - 1 for d, _, _, t, _ in turns], np.int64)) if turns else np.zeros(0, np.int64)
        parts = cut_up(*lattices.paths(unit[late], mix(token_key[late] + np.uint64(salt(s)))), [int(per[d]) - t - 1 for d, _, _, t, _ in turns], [x[1] for x in turns])
        made: list[Leaf | None] = [None] * len(texts)
        for (d, value, leaf, t, (logp, n, edges)), (late_logp, late_n, late_edges, _) in zip(turns, parts, strict=True):
            before = -np.diff(leaf.fall[: t + 1])
            new = Leaf(np.concatenate([before, [logp], late_logp]), np.concatenate([leaf.n[:t], [n], late_n]), np.concatenate([leaf.edges[: leaf.stop[t]], edges, late_edges]), value)
            made[d] = new
            if t + 1 < per[d]:
                regions[d].append((truncated(new.mass(t + 1, int(per[d])), value, key_of[d] + salt(s, 3)), new, t + 1, int(per[d]), None))
        found.append(made)
    kappa = np.array([max((r[0] for r in mine), default=-math.inf) for mine in regions])
    for s, leaves in enumerate(found, 1):
        live = [d for d, x in enumerate(leaves) if x is not None]
        mine = [leaves[d] for d in live]
        if not mine:
            break
        ids, count = lattices.ids(np.concatenate([x.edges for x in mine]), np.array([len(x.edges) for x in mine]))
        yield s, np.array(live), -np.array([x.fall[-1] for x in mine]), np.array([x.top for x in mine]), kappa[live], ids, count


@lru_cache(2)
def loaded(path: str) -> Model:
    return Model(path)


def inclusion(x: np.ndarray) -> np.ndarray:
    """log(1 - exp(-exp(x)))."""
    with np.errstate(over="ignore", divide="ignore"):
        return np.where(x < -30, x, np.log(-np.expm1(-np.exp(np.minimum(x, 50)))))


def sample_segmentations(docs: DataFrame, model_path: str, samples: int = 3, seed: int = 11, with_pieces: bool = True) -> DataFrame:
    """A row for each document and sample: n_pieces, log_prob, perturbed, log_inclusion, ids_crc32 (of the ids as
    little-endian 32-bit numbers), decoded (the ids give the text again) and, unless they are not wanted, the pieces."""
    small_batches(docs.sparkSession)
    schema = SCHEMA + (", pieces array<int>" if with_pieces else "")
    fields = ["doc_id", "sample", "n_pieces", "log_prob", "perturbed", "log_inclusion", "ids_crc32", "decoded", "pieces"][: 9 if with_pieces else 8]

    def rows(it):
        model = loaded(model_path)
        lattices = Lattices(model, [])
        for batch in by_size(it, 500_000):
            if len(lattices.piece) > 1_500_000:
                lattices.forget(1_200_000)
            doc_ids, texts = batch.column("doc_id").to_pylist(), texts_of(batch)
            empty = [i for i, t in enumerate(texts) if not t]
            full = [i for i, t in enumerate(texts) if t]
            if empty:
                n = len(empty)
                cols = [[doc_ids[i] for i in empty], [1] * n, [0] * n, [0.0] * n, [None] * n, [0.0] * n, [0] * n, [True] * n, [[]] * n]
                yield pa.RecordBatch.from_arrays([pa.array(c, _TYPES[f]) for f, c in zip(fields, cols, strict=False)], fields)
            if not full:
                continue
            keys = mix(np.array([(doc_ids[i] or 0) % 2**64 for i in full], np.uint64) + np.uint64(seed))
            raw = [(" " + texts[i]).encode("utf-8", "surrogatepass") for i in full]
            size = np.array([len(r) for r in raw])
            for s, live, logp, top, kappa, ids, count in sample_texts(model, [texts[i] for i in full], keys, samples, lattices):
                made = model.decode_bytes(ids)
                ends = np.cumsum(count)
                made_size = np.add.reduceat(model.length[ids], ends - count) if len(ids) else np.zeros(0, int)
                stops = np.cumsum(made_size)
                same = [a == size[i] and made[b - a : b].tobytes() == raw[i] for a, b, i in zip(made_size, stops, live, strict=True)]
                packed = ids.astype("<i4")
                view = memoryview(packed).cast("B") if len(packed) else b""
                cols = [
                    [doc_ids[full[i]] for i in live],
                    [s] * len(live),
                    count,
                    logp,
                    top,
                    inclusion(logp - kappa),
                    [zlib.crc32(view[4 * (b - a) : 4 * b]) for a, b in zip(count.tolist(), ends.tolist(), strict=True)],
                    same,
                ]
                made_columns = [pa.array(c, _TYPES[f]) for f, c in zip(fields, cols, strict=False)]
                if with_pieces:
                    made_columns.append(pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(packed)))
                yield pa.RecordBatch.from_arrays(made_columns, fields)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, schema)


_TYPES = {"doc_id": pa.int64(), "sample": pa.int32(), "n_pieces": pa.int64(), "log_prob": pa.float64(), "perturbed": pa.float64(), "log_inclusion": pa.float64(), "ids_crc32": pa.int64(), "decoded": pa.bool_(), "pieces": pa.list_(pa.int32())}
