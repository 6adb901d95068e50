"""LM scoring by online logistic context mixing.

A text is read as its tokens: lower-case words, each closed by a space byte, then an end byte.
Bytes are written in Huffman codes and their bits are predicted one by one; several hashed
contexts each give a bit count, their log-odds are mixed by weights that two gates choose, and
the mixed odds are refined by an adaptive probability map.

*Head* (a token's first byte): contexts reach across words.  They are the state, the last word
and the last two words.  The
state is the class of the latest of the ``ANCHORS`` most frequent words of all learned texts (counted
over the whole of them);
classes merge anchors that follow each other, by mutual information (Brown et al., 1992).  Head
bits are learned online, text after text in each partition: predict, then adjust weights and
map, then count, all in all texts.  Partitions add their counts
and maps and average their weights.

*Rest* of a token: contexts are its last two bytes with the state, its last four and its whole
beginning, each with and without the state.  A rest depends on the state and the token alone, so it is priced once for
each pair of them that occurs.  Counts over beginnings grow with the corpus and are never
gathered: pairs are dealt by their first bytes, and each task counts the beginnings of its own.
Weights are learned online, each token predicted without one occurrence of itself, at all of
its bytes.

The bits add up to the log-probability of the text, so probabilities over all token sequences
sum to one.  What goes to the driver is bounded: tables of fixed size (``HEAD_BITS``,
``REST_BITS``, 13 and 20 MB), weights and maps of some 20 kB for each of the square root of the
tasks, codes, and the prices of at most ``heavy`` frequent pairs by their 64-bit hash (20 bytes
each), looked up where the text is read; the rest meet their document in one join.

Null text counts as empty: just the end.  Rows with a null ``doc_id`` are scored and not
learned from.  Repeated rows are each learned from and scored.  Ties between anchors go by
bytes.  A very long text is one row throughout.  Without training text all counts are zero and
the codes alone price a text.  An empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cached_property
from itertools import count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import copies, release, settle, tidy

END, SPACE = b"\n", 0x20
ANCHORS, STATES = 64, 5  # state 0: no anchor yet
#: Slots of each context's table, as powers of two.
HEAD_BITS = (12, 19, 20)
REST_BITS = (19, 20, 20)
GATES, MAP_STEPS = 14, 33
NEAR = 4  # bytes of a beginning that the fixed tables know
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_SALT = np.arange(1, 9, dtype=np.uint64) * _B


def _mix(h: np.ndarray) -> np.ndarray:
    h = h * _A
    return h ^ (h >> np.uint64(31))


class Code:
    """Huffman codes of bytes, one for each row of counts: few bits for frequent bytes, and every byte has some."""

    def __init__(self, counts: np.ndarray):
        self.size = np.zeros(counts.shape, np.uint8)
        self.code = np.zeros(counts.shape, np.uint64)
        for r, row in enumerate(counts):
            if not row.any():
                self.size[r], self.code[r] = 8, np.arange(256, dtype=np.uint64)
                continue
            heap = [(float(c) + 0.01, s, (s,)) for s, c in enumerate(row)]
            heapq.heapify(heap)
            while len(heap) > 1:
                (a, i, x), (b, j, y) = heapq.heappop(heap), heapq.heappop(heap)
                for bit, members in ((0, x), (1, y)):
                    for m in members:
                        self.code[r, m] |= np.uint64(bit) << np.uint64(self.size[r, m])
                        self.size[r, m] += 1
                heapq.heappush(heap, (a + b, min(i, j), x + y))

    @cached_property
    def paths(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nodes and bits of the first row's codes, one after another, and where each begins."""
        size = self.size[0].astype(np.int64)
        begin = np.cumsum(size) - size
        symbol = np.repeat(np.arange(256), size)
        step = np.arange(len(symbol)) - begin[symbol]
        code, left = self.code[0][symbol], (size[symbol] - step).astype(np.uint64)
        bit = (code >> (left - np.uint64(1))) & np.uint64(1)
        return (np.uint64(1) << step.astype(np.uint64)) | (code >> left), bit.astype(np.float32), begin

    def longest_first(self, rows: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The order of places by falling length of their codes."""
        return np.argsort(255 - self.size[rows, symbols], kind="stable")

    def steps(self, rows: np.ndarray, symbols: np.ndarray) -> Iterator[tuple[np.ndarray | slice, np.ndarray, np.ndarray]]:
        """Bit after bit: places (of those with a bit left), their nodes in the code, and bits.

        Where the longest codes come first, places are slices: those with a bit left come first.
        """
        size, code = self.size[rows, symbols], self.code[rows, symbols]
        node = np.ones(len(symbols), np.uint64)
        if not (size[1:] > size[:-1]).any():
            left = len(size) - np.searchsorted(size[::-1], np.arange(1, 2 + int(size.max(initial=0))))
            for k, (n, then) in enumerate(zip(left, left[1:]), 1):
                bit = (code[:n] >> (size[:n] - np.uint8(k)).astype(np.uint64)) & np.uint64(1)
                yield slice(0, n), node, bit.astype(np.float32)
                node = node[:then] * np.uint64(2) + bit[:then]
            return
        at = np.arange(len(symbols))
        while len(at):
            bit = (code >> (size - 1).astype(np.uint64)) & np.uint64(1)
            yield at, node, bit.astype(np.float32)
            more = np.flatnonzero(size > 1)
            node = node[more] * np.uint64(2) + bit[more]
            at, size, code = at[more], size[more] - 1, code[more]


def slot(context: np.ndarray, node: np.ndarray, bits: int) -> np.ndarray:
    s = node * _B
    s ^= context
    s *= _A
    s >>= np.uint64(64 - bits)
    return s.view(np.int64)  # below 2 ** 63


def part_of(at: np.ndarray | slice, some: np.ndarray) -> np.ndarray:
    """The places that ``some`` of the places ``at`` are."""
    return some if isinstance(at, slice) else at[some]


def empty_tables(bits: tuple[int, ...]) -> list[np.ndarray]:
    return [np.zeros((2, 1 << b), np.float32) for b in bits]


def paired(tables: list[np.ndarray]) -> list[np.ndarray]:
    """The same tables with both counts of a slot side by side in memory: one miss of the cache for both."""
    return [np.ascontiguousarray(t.T).T for t in tables]


def counts_at(table: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of zeros and of ones in slots ``s``."""
    if table.flags.c_contiguous:
        return table[0].take(s), table[1].take(s)
    both = table.T.view(np.complex64)[:, 0].take(s)
    return both.real, both.imag


def count_up(table: np.ndarray, s: np.ndarray, one: np.ndarray, weight: np.ndarray | np.float32) -> None:
    if table.flags.c_contiguous:
        np.add.at(table.reshape(-1), s + one * table.shape[1], weight)
    else:
        np.add.at(table.T.reshape(-1), 2 * s + one, weight)


class Mixer:
    """Gated weights and the adaptive map."""

    def __init__(self, inputs: int):
        self.inputs = inputs + 1
        self.w = np.full((2, GATES * GATES, self.inputs), 0.6 / inputs, np.float32)
        self.w[:, :, -1] = 0.0
        self.grad = np.full(self.w.shape, 1e-3)
        self.map = np.zeros((2, GATES, MAP_STEPS))  # ones, all

    @staticmethod
    def odds(zero: np.ndarray, one: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds of counts, and the exponent of their sum (0, 1, 2-3, 4-7, ...)."""
        n = zero + one
        x = np.log((one + np.float32(0.02)) / (zero + np.float32(0.02)))
        return x, np.clip((n.view(np.int32) >> 23) - 126, 0, GATES - 1)  # the float's own exponent

    def mixed(self, x: list[np.ndarray], g1: np.ndarray, g2: np.ndarray) -> np.ndarray:
        wide = np.zeros((2, GATES * GATES, 4 if self.inputs <= 4 else 8), np.float32)  # rows of 16 or 32 bytes are taken fastest
        wide[:, :, : self.inputs] = self.w
        a = wide[0].take(g1, 0)
        a += wide[1].take(g2, 0)
        z = a[:, self.inputs - 1] * np.float32(0.3)
        for i, v in enumerate(x):
            z += a[:, i] * v
        return np.clip(z, -16, 16, out=z)

    @staticmethod
    def place(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = (z + np.float32(16)) * np.float32((MAP_STEPS - 1) / 32)
        low = np.minimum(at.astype(np.int32), MAP_STEPS - 2)
        return low, at - low.astype(np.float32)

    def adjust(self, x, g1, g2, bit, weight, seen: float, rate: float = 0.2) -> None:
        """One online step (Adagrad) over a batch of weights that sum to about one, and the map's, for ``seen`` items."""
        z = self.mixed(x, g1, g2)
        err = (1 / (1 + np.exp(-z)) - bit) * weight
        for side, g in enumerate((g1, g2)):
            d = np.stack([*(np.bincount(g, err * v, GATES * GATES) for v in x), np.bincount(g, err, GATES * GATES) * 0.3], 1)
            self.grad[side] += d * d
            self.w[side] -= rate * d / np.sqrt(self.grad[side])
        low, part = self.place(z)
        at, w = (g1 // GATES * MAP_STEPS + low) * 2 + bit.astype(np.int64), weight * np.float32(seen)
        whole, up = (np.bincount(at, v, 2 * GATES * MAP_STEPS).reshape(GATES, MAP_STEPS, 2) for v in (w, w * part))
        for d in (whole - up, np.roll(up, 1, 1)):  # ``low`` is never the last step
            self.map[0] += d[:, :, 1]
            self.map[1] += d.sum(2)

    def log2(self, x, g1, g2, bit) -> np.ndarray:
        """log2 probability of each bit."""
        centre = 1 / (1 + np.exp(-np.linspace(-16, 16, MAP_STEPS)))
        refined = ((self.map[0] + 20 * centre) / (self.map[1] + 20)).reshape(-1).astype(np.float32)
        z = self.mixed(x, g1, g2)
        low, part = self.place(z)
        at = g1 // GATES * MAP_STEPS + low
        half, up = np.float32(0.5), refined.take(at)
        p = half / (1 + np.exp(-z)) + half * (up + (refined.take(at + 1) - up) * part)
        return np.log(np.clip(np.abs(1 - bit - p), np.float32(1e-7), 1)) * np.float32(1 / math.log(2))


# ---------------------------------------------------------------- tokens in their texts


class Vocabulary(defaultdict):
    """Numbers of tokens in the order they come, with what contexts need of them; emptied when it gets large."""

    def __init__(self, groups: dict[bytes, int], most: int = 300_000):
        super().__init__()
        self.groups, self.most = groups, most
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.default_factory = count().__next__
        self.words: list[bytes] = []
        self.hash, self.first, self.group = array("Q"), array("B"), array("B")

    def catch_up(self) -> None:
        """Note what is new since the last time."""
        new = list(islice(reversed(self), len(self) - len(self.words)))[::-1]
        self.words += new
        self.hash.extend([xxhash.xxh64_intdigest(w, 42) for w in new])  # as Spark's xxhash64
        self.first.extend([w[0] for w in new])
        self.group.extend([self.groups.get(w, 0) for w in new])


def split(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """How many words each text has, and the words; an empty one stands where a text has white space at an edge, or nothing."""
    flat = texts.cast(pa.binary()).fill_null(b"").view(pa.string())  # bytes as they are: only ASCII is looked at
    lists = pc.ascii_split_whitespace(pc.ascii_lower(flat))
    return np.diff(lists.offsets.to_numpy()), lists.flatten().view(pa.binary())


def numbered(texts: pa.Array, known: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all tokens of some texts, each text closed by its end, and how many tokens each has.

    A word is looked up once for all texts.
    """
    size, words = split(texts)
    words = words.dictionary_encode()
    local, named = words.indices.to_numpy(), words.dictionary.to_numpy(zero_copy_only=False)
    empty = pc.index(words.dictionary, pa.scalar(b"", pa.binary())).as_py()
    if empty >= 0:  # beside white space at the edges of a text
        none = local == empty
        size = size - np.bincount(np.repeat(np.arange(len(size)), size)[none], minlength=len(size))
        local, named[empty] = local[~none], END
    ids = np.full(len(local) + len(size), known[END], np.int64)
    inner = np.ones(len(ids), bool)
    inner[np.cumsum(size + 1) - 1] = False
    ids[inner] = np.fromiter(map(known.__getitem__, named), np.int64, len(named))[local]
    known.catch_up()
    return ids, size.astype(np.int64) + 1


class Texts:
    """Flat tokens of some texts: numbers, texts, states and the two tokens before."""

    def __init__(self, texts: list[bytes | None], known: Vocabulary, may_empty: bool = True):
        if may_empty and len(known) > known.most:
            known.reset()
        self.note(*numbered(pa.array(texts, pa.binary()), known), known)

    @classmethod
    def of(cls, ids: np.ndarray, size: np.ndarray, known: Vocabulary) -> Texts:
        t = cls.__new__(cls)
        t.note(ids, size, known)
        return t

    def note(self, ids: np.ndarray, size: np.ndarray, known: Vocabulary) -> None:
        self.ids, self.size, self.known = ids, size, known
        self.doc = np.repeat(np.arange(len(size)), size)
        starts = np.cumsum(self.size) - self.size  # every text has its end, so no two begin in one place
        before = lambda x: np.concatenate([x[:0], x[-1:], x[:-1]])
        self.one = before(np.frombuffer(known.hash, np.uint64).take(self.ids))
        self.one[starts] = 0  # for no token
        self.two = before(self.one)
        self.two[starts] = 0
        self.first = np.frombuffer(known.first, np.uint8).take(self.ids)
        # The class of the latest anchor before: what came since the text began.
        group = before(np.frombuffer(known.group, np.uint8).take(self.ids))
        group[starts] = 0
        new = group > 0
        new[starts] = True
        since = np.flatnonzero(new)
        self.state = np.repeat(group[since].astype(np.int64), np.diff(since, append=len(group)))


def heads(t: Texts) -> list[np.ndarray]:
    """Hashed contexts of each token's first byte."""
    s = t.state.astype(np.uint64) + np.uint64(1)
    return [_mix(c + salt) for c, salt in zip((s, t.one, _mix(t.one) + t.two), _SALT)]


def head_gates(sure: list[np.ndarray], state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (sure[2] * GATES + sure[1]).astype(np.int64, copy=False), state * GATES + sure[0]


def odds_at(table: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if len(s) <= table.shape[1]:
        return Mixer.odds(*counts_at(table, s))
    x, sure = Mixer.odds(table[0], table[1])  # a slot's odds are worked out once
    return x.take(s), sure.take(s)


def learn_heads(t: Texts, code: Code, tables: list[np.ndarray], m: Mixer) -> None:
    n, order = max(1, len(t.ids)), code.longest_first(np.zeros_like(t.state), t.first)
    contexts, state = [c[order] for c in heads(t)], t.state[order]
    m.map *= 0.97
    for at, node, bit in code.steps(np.zeros_like(state), t.first[order]):
        slots = [slot(c[at], node, b) for c, b in zip(contexts, HEAD_BITS)]
        x, sure = zip(*(odds_at(a, s) for a, s in zip(tables, slots)))
        m.adjust(list(x), *head_gates(sure, state[at]), bit, np.full(len(bit), 1 / n, np.float32), n)
        one = bit.astype(np.int64)
        for a, s in zip(tables, slots):
            count_up(a, s, one, np.float32(1))


class Prices:
    """Fixed tables with odds and exponents worked out once, in one word: an exponent is the last four bits of its odds."""

    def __init__(self, tables: list[np.ndarray], bits: tuple[int, ...]):
        self.bits, self.tables = bits, []
        for t in tables:
            x, sure = Mixer.odds(t[0], t[1])
            self.tables.append((x.view(np.int32) + 8 & -16) | sure)

    def __call__(self, contexts, at, node) -> tuple[list[np.ndarray], list[np.ndarray]]:
        x, sure = [], []
        for c, b, t in zip(contexts, self.bits, self.tables):
            got = t.take(slot(c[at], node, b))
            x.append((got & -16).view(np.float32))
            sure.append((got & 15).astype(np.int64))
        return x, sure


def price_heads(t: Texts, code: Code, prices: Prices, m: Mixer, block: int = 8_000) -> np.ndarray:
    """log2 probability of each token's first byte: all bits of a block of tokens at once."""
    contexts, out = heads(t), np.zeros(len(t.ids))
    nodes, bits, begin = code.paths
    for k in range(0, len(out), block):
        first = t.first[k : k + block]
        size = code.size[0][first].astype(np.int64)
        starts = np.cumsum(size) - size
        token = np.repeat(np.arange(k, k + len(first)), size)
        step = np.repeat(begin[first] - starts, size)
        step += np.arange(len(step))
        x, sure = prices(contexts, token, nodes.take(step))
        p = m.log2(x, *head_gates(sure, t.state.take(token)), bits.take(step))
        out[k : k + block] = np.add.reduceat(p, starts, dtype=np.float64)  # every code has a bit
    return out


# ---------------------------------------------------------------- rests of tokens


def closed(tokens: list[bytes] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of tokens, each word closed by a space, and how many each has."""
    tokens = tokens if isinstance(tokens, pa.Array) else pa.array(tokens, pa.binary())
    bare, space = pa.scalar(b"", pa.binary()), pa.scalar(b" ", pa.binary())
    x = pc.binary_join_element_wise(tokens, pc.if_else(pc.equal(tokens, pa.scalar(END, pa.binary())), bare, space), bare)
    if not len(x):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64)
    to = np.frombuffer(x.buffers()[1], np.int32)[: len(x) + 1].astype(np.int64)
    return np.frombuffer(x.buffers()[2], np.uint8)[: to[-1]], np.diff(to)


class Rests:
    """Flat bytes after the first of (state, token) pairs, with their contexts; by falling length of codes, if given the ``code``."""

    def __init__(self, tokens: list[bytes] | pa.Array, state: np.ndarray, depth: np.ndarray, code: Code | None = None):
        x, size = closed(tokens)
        token = np.repeat(np.arange(len(size)), size)
        self.starts = np.cumsum(size) - size
        place = np.arange(len(x)) - self.starts[token]
        keep = np.flatnonzero(place > 0)
        if code is not None:
            keep = keep[code.longest_first(x[keep - 1], x[keep])]
        self.bytes, self.places, self.keep, self.tokens = x, place, keep, token
        self.token, self.place = token[keep], place[keep]
        self.before, self.symbol = x[keep - 1].astype(np.int64), x[keep]
        self.state = state[self.token].astype(np.uint64) + np.uint64(1)
        self.far = self.place >= depth[self.token]

    @cached_property
    def contexts(self) -> list[np.ndarray]:
        v = np.concatenate([np.zeros(4, np.uint64), self.bytes.astype(np.uint64) + np.uint64(1)])
        b1, b2, b3, b4 = (v[self.keep + (4 - k)] * (self.place >= k) for k in (1, 2, 3, 4))
        two = _mix(b1) + b2
        four = _mix(_mix(two) + b3) + b4
        return [_mix(c + salt) for c, salt in zip((_mix(two) + self.state, four, _mix(four) + self.state), _SALT)]

    @cached_property
    def own(self) -> list[np.ndarray]:
        """The whole beginning, without and with the state."""
        powers = np.cumprod(np.full(int(self.places.max(initial=0)) + 1, _A | np.uint64(1), np.uint64))
        run = np.concatenate([[np.uint64(0)], np.cumsum((self.bytes.astype(np.uint64) + np.uint64(1)) * powers[self.places], dtype=np.uint64)])
        w = run[self.keep] - run[self.starts[self.token]] + self.place.astype(np.uint64)
        return [_mix(w + _SALT[6]), _mix(_mix(w) + self.state + _SALT[7])]


class Beginnings:
    """Bit counts of the whole beginnings of one task's tokens, in tables as large as they need."""

    def __init__(self, bits_in_all: int):
        self.bits = min(23, max(10, math.ceil(math.log2(max(1, bits_in_all)))))
        self.tables = paired(empty_tables((self.bits, self.bits)))

    def add(self, r: Rests, code: Code, weight: np.ndarray) -> None:
        for at, node, bit in code.steps(r.before, r.symbol):
            far = np.flatnonzero(r.far[at])
            there, node, one = part_of(at, far), node[far], bit[far].astype(np.int64)
            w = weight[r.token[there]]
            for a, c in zip(self.tables, r.own):
                count_up(a, slot(c[there], node, self.bits), one, w)

    def counts(self, r: Rests, at, node) -> list[tuple[np.ndarray, np.ndarray]]:
        s = [slot(c[at], node, self.bits) for c in r.own]
        return [counts_at(a, k) for a, k in zip(self.tables, s)]


def rest_gates(sure) -> tuple[np.ndarray, np.ndarray]:
    first, second = sure[4] * GATES + sure[3], sure[1] * GATES + np.minimum(GATES - 1, sure[0] // 2 + 7 * (sure[4] > 0))
    return first.astype(np.int64, copy=False), second.astype(np.int64, copy=False)


def rest_odds(r: Rests, at, node, bit, fixed: list[np.ndarray], own: Beginnings, less: np.ndarray):
    """Odds of the five inputs and the gates, with ``less`` occurrences of the token itself left out.

    Near its start a token's beginning is the last four bytes, which the fixed tables know.
    """
    pairs = [[*counts_at(a, s)] for a, s in zip(fixed, (slot(c[at], node, b) for c, b in zip(r.contexts, REST_BITS)))]
    n = less[r.token[at]]
    n1 = n * bit
    n0 = n - n1
    for p in pairs:
        p[0], p[1] = np.maximum(p[0] - n0, 0), np.maximum(p[1] - n1, 0)
    x, sure = map(list, zip(*(Mixer.odds(*p) for p in pairs)))
    far = np.flatnonzero(r.far[at])
    for near, (zero, one) in zip((1, 2), own.counts(r, part_of(at, far), node[far])):
        a, e = x[near].copy(), sure[near].copy()
        a[far], e[far] = Mixer.odds(np.maximum(zero - n0[far], 0), np.maximum(one - n1[far], 0))
        x.append(a), sure.append(e)
    return x, *rest_gates(sure)


def price_rests(r: Rests, code: Code, prices: Prices, own: Beginnings, m: Mixer, n: int) -> np.ndarray:
    """log2 probability of each token's rest."""
    out = np.zeros(n)
    for at, node, bit in code.steps(r.before, r.symbol):
        x, sure = prices(r.contexts, at, node)
        far = np.flatnonzero(r.far[at])
        for near, counts in zip((1, 2), own.counts(r, part_of(at, far), node[far])):
            a, e = x[near].copy(), sure[near].copy()
            a[far], e[far] = Mixer.odds(*counts)
            x.append(a), sure.append(e)
        out += np.bincount(r.token[at], m.log2(x, *rest_gates(sure), bit), n)
    return out


# ---------------------------------------------------------------- learning over the corpus


def classes(follows: np.ndarray, groups: int) -> np.ndarray:
    """Class (1 to ``groups``) of each anchor: merged two by two so that the classes of neighbours tell most of each other."""
    a = follows + follows.T + 1e-3
    parts = [[i] for i in range(len(a))]
    total = a.sum()

    def worth(x, row, col):
        return x / total * np.log2(np.maximum(x, 1e-12) * total / np.maximum(row * col, 1e-12))

    while len(parts) > groups:
        row = a.sum(1)
        q = worth(a, row[:, None], row[None, :])
        own = q.sum(1) * 2 - q.diagonal()
        best = (math.inf, 0, 1)
        for i in range(len(a)):
            for j in range(i):
                joint, r = a[i] + a[j], row[i] + row[j]
                others = np.ones(len(a), bool)
                others[[i, j]] = False
                inside = a[i, i] + a[j, j] + 2 * a[i, j]
                gain = 2 * worth(joint[others], r, row[others]).sum() + worth(np.array([inside]), r, r)[0]
                loss = own[i] + own[j] - 2 * q[i, j] - gain
                best = min(best, (float(loss), j, i))
        _, i, j = best
        a[i] += a[j]
        a[:, i] += a[:, j]
        a = np.delete(np.delete(a, j, 0), j, 1)
        parts[i] += parts.pop(j)
    out = np.zeros(sum(map(len, parts)), np.int64)
    for k, p in enumerate(parts):
        out[p] = k + 1
    return out


def _frequent(most: int):
    """Words of a task's texts, with counts that are short by at most one in ``most`` of all (Misra and Gries, 1982)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for b in batches:
            each = split(b.column("text"))[1].value_counts()
            n = each.field("counts").to_numpy().copy()
            empty = pc.index(each.field("values"), pa.scalar(b"", pa.binary())).as_py()
            if empty >= 0:
                n[empty] = 0
            if len(n) > 8 * most:
                n -= min(n.max(), np.partition(n, -1 - most)[-1 - most])
            some = np.flatnonzero(n > 0)
            held.update(dict(zip(each.field("values").take(pa.array(some)).to_pylist(), n[some].tolist())))
            if len(held) > 8 * most:
                least = sorted(held.values(), reverse=True)[most]
                held = Counter({w: c - least for w, c in held.items() if c > least})
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["w", "n"])

    return run


def _anchors(words: list[bytes]):
    """How often each of ``words`` is the next of them after another, and (``b`` null) how often it occurs."""
    index = pa.array(words, pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(words)
        n, alone = np.zeros(k * k, np.int64), np.zeros(k, np.int64)
        for b in batches:
            size, tokens = split(b.column("text"))
            x = pc.index_in(tokens, value_set=index).fill_null(-1).to_numpy()
            at = np.flatnonzero(x >= 0)
            x, doc = x[at].astype(np.int64), np.repeat(np.arange(len(size)), size)[at]
            n += np.bincount((x[:-1] * k + x[1:])[doc[1:] == doc[:-1]], minlength=k * k)
            alone += np.bincount(x, minlength=k)
        at = np.flatnonzero(n)
        a, c = [words[i // k] for i in at.tolist()], [words[i % k] for i in at.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(a + words, pa.binary()), pa.array(c + [None] * k, pa.binary()), pa.array(np.concatenate([n[at], alone]))], names=["a", "b", "n"])

    return run


PASS = "state int, token binary, c long, c_all long, k long, at binary, n binary, w binary, m binary"


def _read_corpus(groups: dict[bytes, int], code: Code):
    """One pass over all texts: pairs with their counts, and what heads teach (as ``_sparse`` and ``_one_mixer``)."""
    kinds = [pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
    names = [x.split()[0] for x in PASS.split(", ")]

    def row(**given) -> pa.RecordBatch:
        n = len(next(iter(given.values())))
        return pa.RecordBatch.from_arrays([pa.array(given[x], k) if x in given else pa.nulls(n, k) for x, k in zip(names, kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held = Vocabulary(groups, 400_000), [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        tables, m, used = paired(empty_tables(HEAD_BITS)), Mixer(len(HEAD_BITS)), False

        def out() -> Iterator[pa.RecordBatch]:
            n = max(map(len, held))
            c, more = (np.pad(h, (0, n - len(h))) for h in held)
            at = np.flatnonzero(c + more)
            for k in range(0, len(at), 50_000):
                i = at[k : k + 50_000]
                yield row(state=(i & 7).astype(np.int32), token=[known.words[j] for j in (i >> 3).tolist()], c=c[i], c_all=c[i] + more[i])
            held[0], held[1] = np.zeros(0, np.int64), np.zeros(0, np.int64)

        for b in batches:
            if len(known) > known.most:
                yield from out()
                known.reset()
            ids, size = numbered(b.column("text"), known)
            learned = np.array(b.column("learned").to_pylist(), bool)
            end = np.concatenate([[0], np.cumsum(size)])
            for i in (0, 1):
                if 8 * len(known) > len(held[i]):
                    held[i] = np.pad(held[i], (0, 16 * len(known) - len(held[i])))
            for k in range(0, b.num_rows, 100):
                part, own = size[k : k + 100], learned[k : k + 100]
                tokens, of_learned = ids[end[k] : end[k + len(part)]], np.repeat(own, part)
                for i, mine, own in ((0, of_learned, own), (1, ~of_learned, ~own)):
                    t = Texts.of(tokens[mine], part[own], known)
                    np.add.at(held[i], (t.ids << 3) | t.state, 1)
                    if not i and len(t.ids):
                        learn_heads(t, code, tables, m)
                        used = True
        yield from out()
        if used:
            for piece in _sparse(tables):
                yield row(**{x: piece.column(x) for x in ("k", "at", "n")})
            yield row(w=[m.w.astype(np.float64).tobytes()], m=[m.map.tobytes()])

    return run


def _sparse(tables: list[np.ndarray], chunk: int = 1 << 12) -> Iterator[pa.RecordBatch]:
    """Used slots of tables in pieces ``k`` of ``chunk`` counts."""
    base = 0
    for t in tables:
        flat = t.reshape(-1)
        for k in range(0, len(flat), chunk):
            part = flat[k : k + chunk]
            at = np.flatnonzero(part)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([base + k // chunk], pa.int64()), pa.array([at.astype(np.uint16).tobytes()], pa.binary()), pa.array([part[at].astype(np.float32).tobytes()], pa.binary())], names=["k", "at", "n"])
        base += -(-len(flat) // chunk)


def _gather(pieces: DataFrame, bits: tuple[int, ...], chunk: int = 1 << 12) -> list[np.ndarray]:
    """The sums of all tasks' ``_sparse`` tables: added up by slot, then as large as the tables are."""

    def add_up(table: pa.Table) -> pa.Table:
        total = np.zeros(chunk)
        for at, x in zip(table.column("at"), table.column("n")):
            total[np.frombuffer(at.as_buffer(), np.uint16)] += np.frombuffer(x.as_buffer(), np.float32)
        return pa.table({"k": pa.array(table.column("k").to_pylist()[:1], pa.int64()), "n": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    out = [np.zeros((2, 1 << b), np.float32) for b in bits]
    first = np.cumsum([0, *(-(-2 * (1 << b) // chunk) for b in bits)])
    for r in pieces.groupBy("k").applyInArrow(add_up, "k long, n binary").toLocalIterator():
        i = int(np.searchsorted(first, r["k"], "right")) - 1
        k, flat = r["k"] - int(first[i]), out[i].reshape(-1)
        n = np.frombuffer(r["n"], np.float32)[: len(flat) - k * chunk]
        flat[k * chunk : k * chunk + len(n)] = n
    return out


def _mixer(rows: DataFrame, inputs: int, tasks: int) -> Mixer:
    """The mean of the tasks' weights and the sum of their maps (``w, m``), added up in two levels."""
    shape = Mixer(inputs)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, m, n = np.zeros(shape.w.size), np.zeros(shape.map.size), 0
        for b in batches:
            for x, y, k in zip(*(b.column(c).to_pylist() for c in ("w", "m", "n"))):
                w, m, n = w + np.frombuffer(x), m + np.frombuffer(y), n + k
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary()), pa.array([m.tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["w", "m", "n"])

    got = rows.repartition(max(1, math.isqrt(tasks))).mapInArrow(add_up, "w binary, m binary, n long").collect()
    out = Mixer(inputs)
    if got:
        out.w = (sum(np.frombuffer(r["w"]) for r in got) / sum(r["n"] for r in got)).reshape(out.w.shape).astype(np.float32)
        out.map = sum(np.frombuffer(r["m"]) for r in got).reshape(out.map.shape)
    return out


def _one_mixer(m: Mixer) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([m.w.astype(np.float64).tobytes()], pa.binary()), pa.array([m.map.tobytes()], pa.binary()), pa.array([1], pa.int64())], names=["w", "m", "n"])


class Model:
    """Prices of pairs ``pairs`` (state, token, c of the token, c_all, log2), the head's model, and totals."""

    def __init__(self, pairs, groups, n, v, heavy, head):
        self.pairs, self.groups, self.n, self.v, self.heavy, self.head = pairs, groups, n, v, heavy, head


def _dealt(pairs: DataFrame, most: int) -> DataFrame:
    """Pairs with the bytes (``deal``) that bring together all that begin alike, and how many bytes those are (``depth``).

    Four bytes; more where over ``most`` pairs agree in them.  What agrees in 64 bytes is spread by hash.
    """
    known = pairs.withColumns({"depth": F.lit(NEAR), "deal": F.substring("token", 1, NEAR)})
    depth = NEAR
    while True:
        heavy = known.where(F.col("depth") == depth).groupBy("deal").agg(F.count("*").alias("n")).where(F.col("n") > most).select("deal", F.lit(True).alias("split"))
        if depth >= 64 or heavy.isEmpty():
            break
        deeper = F.coalesce("split", F.lit(False))
        known = known.join(heavy, "deal", "left").withColumns({"depth": F.when(deeper, 2 * depth).otherwise(F.col("depth")), "deal": F.when(deeper, F.substring("token", 1, 2 * depth)).otherwise(F.col("deal"))}).drop("split")
        depth *= 2
    if depth >= 64:
        known = known.withColumn("deal", F.when(F.col("depth") == 64, F.concat("deal", F.substring(F.unhex(F.sha1("token")), 1, 1))).otherwise(F.col("deal")))
    return known


def regrouped(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The rows of batches in batches of at least ``rows``, but for the last: small ones spend their time on calls."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= rows:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


@tidy
def _rated(pairs: DataFrame, code: Code, task_pairs: int) -> DataFrame:
    """``pairs`` with ``log2``, the price of each token's rest."""
    sc = pairs.sparkSession.sparkContext
    rows, v = pairs.agg(F.count("*"), F.coalesce(F.sum((F.col("c") > 0).cast("long")), F.lit(0))).first()
    tasks = max(1, math.ceil(rows / task_pairs))

    def some(b: pa.RecordBatch, k: int, n: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        p = b.slice(k, n)
        return p.column("token"), p.column("state").to_numpy().astype(np.int64), p.column("c").to_numpy().astype(np.float32), (p.column("depth").to_numpy() if "depth" in b.schema.names else np.full(p.num_rows, 1 << 30))

    def count_bits(batches):
        acc, used = paired(empty_tables(REST_BITS)), False
        for b in regrouped(batches, 5_000):
            for k in range(0, b.num_rows, 5_000):
                token, state, c, depth = some(b, k, 5_000)
                r = Rests(token, state, depth, code)
                for at, node, bit in code.steps(r.before, r.symbol):
                    w, one = c[r.token[at]], bit.astype(np.int64)
                    for a, x, size in zip(acc, r.contexts, REST_BITS):
                        count_up(a, slot(x[at], node, size), one, w)
                used = True
        if used:
            yield from _sparse(acc)

    learned = pairs.where("c > 0").select("state", "token", "c").repartition(max(1, math.ceil(v / (2 * task_pairs))))
    fixed = sc.broadcast(_gather(learned.mapInArrow(count_bits, "k long, at binary, n binary"), REST_BITS))

    def whole(batches) -> Iterator[tuple[list[pa.RecordBatch], Beginnings]]:
        """One task's rows, and the counts of their beginnings."""
        held = list(regrouped(batches, 10_000))
        bits = sum(int(b.column("token").nbytes) * 5 for b in held)
        own = Beginnings(bits // 2)
        for b in held:
            for k in range(0, b.num_rows, 5_000):
                token, state, c, depth = some(b, k, 5_000)
                own.add(Rests(token, state, depth, code), code, c.astype(np.float32))
        return held, own

    def learn(batches):
        held, own = whole(batches)
        m, used = Mixer(5), False
        for b in held:
            for k in range(0, b.num_rows, 10_000):
                token, state, c, depth = some(b, k, 10_000)
                pick = np.flatnonzero(c > 0)
                if not len(pick):
                    continue
                r = Rests(token.take(pa.array(pick)), state[pick], depth[pick], code)
                share, used = (c[pick] / c[pick].sum()).astype(np.float32), True
                m.map *= 0.97
                for at, node, bit in code.steps(r.before, r.symbol):
                    x, g1, g2 = rest_odds(r, at, node, bit, fixed.value, own, np.ones(len(pick), np.float32))
                    m.adjust(x, g1, g2, bit, share[r.token[at]], len(pick))
        if used:
            yield _one_mixer(m)

    dealt = settle(_dealt(pairs, task_pairs)).repartition(tasks, "deal")
    mixer = sc.broadcast(_mixer(dealt.mapInArrow(learn, "w binary, m binary, n long"), 5, tasks))

    def rate(batches):
        held, own = whole(batches)
        prices = Prices(fixed.value, REST_BITS)
        for b in held:
            for k in range(0, b.num_rows, 5_000):
                token, state, _, depth = some(b, k, 5_000)
                p = price_rests(Rests(token, state, depth, code), code, prices, own, mixer.value, len(token))
                s = b.slice(k, 5_000)
                yield pa.RecordBatch.from_arrays([*(s.column(x) for x in ("state", "token", "c_token", "c_all")), pa.array(p)], names=["state", "token", "c_token", "c_all", "log2"])

    out = settle(dealt.mapInArrow(rate, "state int, token binary, c_token long, c_all long, log2 double"))
    fixed.unpersist()
    mixer.unpersist()
    return out


def _heavy(rated: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted hash, count of the token, log2) of the most frequent pairs, at most ``most``.

    Pairs are taken by steps of their count (16 to a doubling), whole steps only: none, if the
    highest step alone holds more.
    """
    step = F.floor(F.log2(F.col("c_all").cast("double")) * 16)
    least, total = None, 0
    for r in rated.where("c_all > 0").groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():  # at most 1,024 steps
        total += r["count"]
        if total > most:
            break
        least = r["step"]
    chosen = rated.where(F.col("c_all") > 0).where(step >= least) if least is not None else rated.limit(0)
    t = chosen.select(F.xxhash64("token").alias("h"), "state", "c_token", "log2").toArrow()
    key = pair_hash(t.column("h").to_numpy().view(np.uint64), t.column("state").to_numpy())
    order = np.argsort(key)
    return key[order], t.column("c_token").to_numpy()[order], t.column("log2").to_numpy()[order].astype(np.float32)


def pair_hash(token: np.ndarray, state: np.ndarray) -> np.ndarray:
    return _mix(token + (state.astype(np.uint64) + np.uint64(1)) * _B)


def fit(docs: DataFrame, learned: Column, heavy: int = 500_000, task_pairs: int = 100_000) -> Model:
    """Learn from rows of ``docs`` where ``learned`` holds; price the rests of the tokens of all rows."""
    sc = docs.sparkSession.sparkContext
    since = copies()
    text = docs.select("text", F.coalesce(learned, F.lit(False)).alias("learned"))
    learning = text.where("learned").select("text")
    # Any word that makes up one in ANCHORS * 64 of all tokens is among a task's frequent ones; the counts that decide are exact.
    likely = learning.mapInArrow(_frequent(64 * ANCHORS), "w binary, n long").groupBy("w").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "w").limit(3 * ANCHORS)
    words = sorted(bytes(r["w"]) for r in likely.collect())
    seen = settle(learning.mapInArrow(_anchors(words), "a binary, b binary, n long").groupBy("a", "b").agg(F.sum("n").alias("n")))
    first = np.zeros((1, 256))
    for r in seen.where("b is null").groupBy(F.substring("a", 1, 1).alias("a")).agg(F.sum("n").alias("n")).collect():  # at most 256
        first[0, r["a"][0]] += r["n"]
    often = seen.where("b is null and n > 0").select(F.col("a").alias("w"), "n").orderBy(F.desc("n"), "w").limit(ANCHORS)
    anchors = {bytes(r["w"]): i for i, r in enumerate(often.collect())}
    follows = np.zeros((len(anchors), len(anchors)))
    inside = seen.join(F.broadcast(often.select(F.col("w").alias("a"))), "a").join(F.broadcast(often.select(F.col("w").alias("b"))), "b")  # ANCHORS rows each
    for r in inside.collect():  # at most ANCHORS squared
        follows[anchors[bytes(r["a"])], anchors[bytes(r["b"])]] = r["n"]
    kind = classes(follows, STATES - 1) if anchors else []
    groups = {w: int(kind[i]) for w, i in anchors.items()}

    first[0, END[0]] += 1 + first.sum() / 256
    head_code = Code(first)  # frequent words tell well enough which bytes are to be short
    read = settle(text.mapInArrow(_read_corpus(groups, head_code), PASS))
    counted = read.where("token is not null").groupBy("state", "token").agg(F.sum("c").alias("c"), F.sum("c_all").alias("c_all"))
    by_token = Window.partitionBy("token")  # nine rows at most
    pairs = settle(counted.withColumns({"c_token": F.sum("c").over(by_token), "least": F.min("state").over(by_token) == F.col("state")}))
    n, v = pairs.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when((F.col("c_token") > 0) & F.col("least"), 1))).first()
    tables = _gather(read.where("k is not null").select("k", "at", "n"), HEAD_BITS)
    mixers = read.where("w is not null").select("w", "m", F.lit(1).cast("long").alias("n"))
    head = (head_code, tables, _mixer(mixers, len(HEAD_BITS), mixers.count()))

    def bigrams(batches):
        count = np.zeros(256 * 256)
        for b in batches:
            x, size = closed(b.column("token"))
            x, w = x.astype(np.int64), np.repeat(b.column("c").to_numpy().astype(float), size)
            inner = np.ones(len(x), bool)
            inner[np.cumsum(size) - size] = False
            inner = np.flatnonzero(inner)
            count += np.bincount(x[inner - 1] * 256 + x[inner], w[inner], len(count))
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(count[at])], names=["k", "n"])

    table = np.zeros(256 * 256)
    for r in pairs.where("c > 0").select("token", "c").mapInArrow(bigrams, "k long, n double").groupBy("k").agg(F.sum("n").alias("n")).collect():  # at most 256 * 256
        table[r["k"]] = r["n"]
    rated = _rated(pairs, Code(table.reshape(-1, 256)), task_pairs)
    release(since, rated)
    return Model(rated, groups, n, v, _heavy(rated, heavy), sc.broadcast(head))


def score(docs: DataFrame, model: Model, held_out: Column) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte``."""
    heavy = docs.sparkSession.sparkContext.broadcast(model.heavy)
    head, groups = model.head, model.groups
    every = math.log10(model.n + model.v + 1)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["state", "token", "row", "tf", "doc_id", "held_out", "n_tokens", "n_bytes", "n_known", "base", "score"]
        kinds = [pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        code, tables, mixer = head.value
        prices, known = Prices(tables, HEAD_BITS), Vocabulary(groups)
        key, seen, log2 = heavy.value
        price, base, size = np.full(1 << 16, np.nan, np.float32), np.zeros(1 << 16), np.zeros(0, np.int64)
        for whole in batches:
            if len(known) > known.most:
                known.reset()
                price[:], size = np.nan, np.zeros(0, np.int64)
            ids, tokens = numbered(whole.column("text"), known)
            end = np.concatenate([[0], np.cumsum(tokens)])
            while len(price) < 8 * len(known):
                price, base = np.concatenate([price, np.full(len(price), np.nan, np.float32)]), np.concatenate([base, np.zeros(len(base))])
            size = np.concatenate([size, np.fromiter(map(len, known.words[len(size) :]), np.int64)])
            for k in range(0, whole.num_rows, 100):
                b = whole.slice(k, 100)
                t = Texts.of(ids[end[k] : end[k + b.num_rows]], tokens[k : k + b.num_rows], known)
                # Not a number: not looked up yet; infinite: not heavy.
                pair = (t.ids << 3) | t.state
                at = price[pair]
                if np.isnan(at).any():
                    new = np.unique(pair[np.isnan(at)])
                    h = pair_hash(np.frombuffer(known.hash, np.uint64)[new >> 3], new & 7)
                    i = np.minimum(np.searchsorted(key, h), max(0, len(key) - 1))
                    hit = key[i] == h if len(key) else np.zeros(len(h), bool)
                    price[new] = np.where(hit, log2[i] if len(key) else 0, np.inf)
                    base[new] = np.log10(np.where(hit, seen[i] if len(key) else 0, 0) + 1.0)
                    at = price[pair]
                is_heavy = np.isfinite(at)
                n = b.num_rows
                total = np.bincount(t.doc, price_heads(t, code, prices, mixer), n)
                here = np.flatnonzero(is_heavy)
                total += np.bincount(t.doc[here], at[here], n)
                c = base[pair[here]]
                row = np.array(b.column("row").to_pylist(), np.int64)
                own = [pa.nulls(n, kinds[0]), pa.array([b" %d" % r for r in row.tolist()], kinds[1]), pa.array(row), pa.nulls(n, kinds[3]), b.column("doc_id"), b.column("held_out"), pa.array(t.size)]
                own += [pa.array(np.bincount(t.doc, size[t.ids] + 1, n).astype(np.int64) - 1), pa.array(np.bincount(t.doc[here], c > 0, n).astype(np.int64)), pa.array(np.bincount(t.doc[here], c, n)), pa.array(total)]
                # A token with a space is none: the row's own line matches nothing in the join.
                yield pa.RecordBatch.from_arrays([x.cast(y) for x, y in zip(own, kinds)], names=names)
                rest = np.flatnonzero(~is_heavy)
                line, tf = np.unique((t.doc[rest].astype(np.int64) << 32) | pair[rest], return_counts=True)
                p = line & 0xFFFFFFFF
                lines = [pa.array((p & 7).astype(np.int32)), pa.array([known.words[i] for i in (p >> 3).tolist()], kinds[1]), pa.array(row[line >> 32]), pa.array(tf.astype(np.int64))]
                yield pa.RecordBatch.from_arrays([*lines, *(pa.nulls(len(line), y) for y in kinds[4:])], names=names)

    schema = "state int, token binary, row long, tf long, doc_id long, held_out boolean, n_tokens long, n_bytes long, n_known long, base double, score double"
    lines = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text").mapInArrow(read, schema)
    j = lines.join(model.pairs.select("state", "token", "c_token", "log2"), ["state", "token"], "left")
    total = lambda own, each: F.sum(F.coalesce(F.col(own), each, F.lit(0)))
    tf = F.col("tf")
    out = j.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("held_out").alias("held_out"),
        F.max("n_tokens").alias("n_tokens"),
        total("n_known", F.when(F.col("c_token") > 0, tf)).cast("long").alias("n_known"),
        F.lit(int(model.n)).cast("long").alias("train_tokens"),
        total("base", tf * F.log10(F.col("c_token") + F.lit(1.0))).alias("base"),
        total("score", tf * F.col("log2")).alias("bits"),
        F.max("n_bytes").alias("n_bytes"),
    )
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", (F.col("base") - F.col("n_tokens") * every).alias("base_score"), (F.col("bits") * math.log10(2)).alias("score"), (-F.col("bits") / F.col("n_bytes")).alias("bits_per_byte"))
