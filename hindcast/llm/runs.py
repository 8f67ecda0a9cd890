"""Runs of words (stretches that repeat one period) by grammar-compressed detection.

The texts that a task holds at a time share one grammar. In each Re-Pair round the adjacent pairs of symbols are counted
inside the documents; pairs that occur at least twice and are more frequent than the pairs they overlap become
nonterminals, so that all pairs which do not compete are replaced in the same round. When no pair occurs twice, what is
left of each document is joined pairwise, so that each document ends as one nonterminal.

A run is contained in the expansion of some lowest nonterminal and crosses the boundary between its two parts. The runs
crossing a boundary are computed once for each nonterminal, at one place of its expansion, and translated to all other
places where the nonterminal was formed. A run of four periods has two of them on one side of the boundary: every
period that fits is tested there by one comparison of fingerprints, and the run's ends follow by bisection. Pieces that
end where their nonterminal ends are parts of a run of a larger one and are merged into it.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from hindcast.llm.common import map_texts

#: Moduli and bases of the two fingerprints; 62 bits together.
PRIMES = ((2147483647, 1000003939), (2147483629, 1999999973))
#: Periods that are tested at a time.
CHUNK = 1 << 21
NONE = np.zeros(0, dtype=np.int64)


class Fingerprints:
    """Equality of stretches of ``ids`` by polynomial fingerprints of its prefixes."""

    def __init__(self, ids: np.ndarray, n_words: int, seed: int = 13) -> None:
        rng = np.random.default_rng(seed)
        self.sums, self.powers = [], []
        for prime, base in PRIMES:
            value = rng.integers(1, prime, n_words, dtype=np.int64)
            power = np.ones(len(ids) + 1, dtype=np.int64)
            done, step = 1, base
            while done < len(power):
                n = min(done, len(power) - done)
                power[done:done + n] = power[:n] * step % prime
                done, step = done * 2, step * step % prime
            sums = np.zeros(len(ids) + 1, dtype=np.int64)
            np.cumsum(value[ids] * power[:-1] % prime, out=sums[1:])
            self.sums.append(sums % prime)
            self.powers.append(power)

    def same(self, x: np.ndarray, apart: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the ``n`` words from ``x`` equal those from ``x + apart``."""
        out = np.ones(len(x), dtype=bool)
        for (prime, _), s, power in zip(PRIMES, self.sums, self.powers, strict=True):
            y = x + apart
            out &= (s[x + n] - s[x]) % prime * power[apart] % prime == (s[y + n] - s[y]) % prime
        return out

    def reach(self, x: np.ndarray, apart: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """How many words from ``x`` on (``back``: up to ``x``) equal those ``apart`` further on, at most ``most``."""
        low, high = np.zeros(len(x), dtype=np.int64), most.copy()
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_] + 1) >> 1
            fits = self.same(x[open_] - mid if back else x[open_], apart[open_], mid)
            low[open_[fits]] = mid[fits]
            high[open_[~fits]] = mid[~fits] - 1
        return low


def _first(sorted_keys: np.ndarray) -> np.ndarray:
    """Mask of the first of each stretch of equal keys."""
    out = np.ones(len(sorted_keys), dtype=bool)
    out[1:] = sorted_keys[1:] != sorted_keys[:-1]
    return out


def crossing(ids: np.ndarray, prints: Fingerprints, start: np.ndarray, mid: np.ndarray, end: np.ndarray, shortest: int,
             times: int) -> tuple[np.ndarray, ...]:
    """Runs inside ``[start, end)`` with two periods next to ``mid``: number of the span, first word, end and period."""
    found: list[tuple[np.ndarray, ...]] = []
    spans = np.flatnonzero(end - start >= shortest)
    for right in (True, False):
        room = np.minimum((end[spans] - mid[spans] if right else mid[spans] - start[spans]) // 2,
                          (end[spans] - start[spans]) // times)
        which, room = spans[room > 0], room[room > 0]
        bounds = np.concatenate([[0], np.cumsum(room)])
        at = 0
        while at < len(which):
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + CHUNK, side="right")) - 1)
            own = np.repeat(np.arange(at, to), room[at:to])
            q = np.arange(bounds[at], bounds[to]) - bounds[own] + 1
            m = mid[which[own]]
            x = m if right else m - 2 * q
            fits = np.flatnonzero(ids[x] == ids[x + q])
            own, q, x = own[fits], q[fits], x[fits]
            fits = np.flatnonzero(ids[x + q - 1] == ids[x + 2 * q - 1])
            own, q, x = own[fits], q[fits], x[fits]
            fits = prints.same(x, q, q)
            own, q = which[own[fits]], q[fits]
            at = to
            while len(own):  # the smallest period of each boundary, then those whose two periods its run does not hold
                head = _first(own)
                w, p, m = own[head], q[head], mid[own[head]]
                x = m if right else m - p
                i = x - prints.reach(x, p, x - start[w], back=True)
                j = x + p + prints.reach(x, p, end[w] - x - p, back=False)
                long = j - i >= np.maximum(shortest, times * p)
                found.append((w[long], i[long], j[long], p[long]))
                group = np.cumsum(head) - 1
                left = ~head & ((mid[own] + 2 * q > j[group]) if right else (mid[own] - 2 * q < i[group]))
                own, q = own[left], q[left]
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (NONE,) * 4


class Grammar:
    """The symbols of all documents between two rounds: where each begins, whether another one of its document follows,
    and whether the pair with that one may occur twice (pairs that occur once do so until one of their symbols changes)."""

    def __init__(self, ids: np.ndarray, doc: np.ndarray, n_symbols: int) -> None:
        self.symbol, self.n = ids.copy(), n_symbols
        self.start = np.arange(len(ids), dtype=np.int64)
        self.size = len(ids)
        self.joined = np.zeros(len(ids), dtype=bool)
        self.joined[:-1] = doc[1:] == doc[:-1]
        self.open = self.joined.copy()

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the pairs that this round replaces, and the number of the pair at each."""
        at = np.flatnonzero(self.open)
        key = self.symbol[at] * self.n + self.symbol[np.minimum(at + 1, len(self.symbol) - 1)]
        mixed = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        bits = max(12, len(key).bit_length() + 1)
        bucket = (mixed >> np.uint64(64 - bits)).astype(np.int64)
        several = np.flatnonzero((np.bincount(bucket, minlength=1 << bits) > 1)[bucket])
        _, pair, count = np.unique(key[several], return_inverse=True, return_counts=True)
        several, pair = several[count[pair] > 1], pair[count[pair] > 1]
        at = at[several]
        self.open = np.zeros(len(self.symbol), dtype=bool)
        self.open[at] = True
        if not len(at):
            return NONE, NONE
        rank = np.frexp(count[pair])[1].astype(np.uint64) << np.uint64(57) | (mixed[several] ^ (mixed[several] << np.uint64(21))) >> np.uint64(7)
        weight = np.zeros(len(self.symbol) + 2, dtype=np.uint64)
        weight[at + 1] = rank
        # equal pairs in a row overlap: of such a block every second pair goes, if the block outranks its neighbours
        new = np.ones(len(at), dtype=bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (pair[1:] != pair[:-1])
        first = np.flatnonzero(new)
        block = np.cumsum(new) - 1
        last = np.append(first[1:], len(at)) - 1
        wins = (rank[first] > weight[at[first]]) & (rank[first] > weight[at[last] + 2])
        chosen = wins[block] & ((at - at[first[block]]) % 2 == 0)
        chosen &= (np.bincount(pair[chosen], minlength=len(count)) > 1)[pair]
        return at[chosen], np.unique(pair[chosen], return_inverse=True)[1]

    def leftover(self) -> tuple[np.ndarray, np.ndarray]:
        """Every second pair of each document, each a nonterminal of its own."""
        n = len(self.symbol)
        first = np.flatnonzero(~np.append(False, self.joined[:-1]))
        place = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
        at = np.flatnonzero(self.joined & (place % 2 == 0))
        return at, np.arange(len(at))

    def spans(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin, boundary and end of the pairs at the positions."""
        ends = np.append(self.start, self.size)
        return ends[at], ends[at + 1], ends[at + 2]

    def replace(self, at: np.ndarray, rule: np.ndarray) -> None:
        self.symbol[at] = self.n + rule
        self.n += int(rule.max()) + 1
        self.joined[at] = self.joined[at + 1]
        self.open[at] = True
        self.open[at[at > 0] - 1] = True
        stays = np.ones(len(self.symbol), dtype=bool)
        stays[at + 1] = False
        before = np.append(False, stays)[at]  # a dropped symbol in front: its pair is that of the symbol before it
        self.open[at[~before & (at > 1)] - 2] = True
        self.symbol, self.joined, self.start = self.symbol[stays], self.joined[stays], self.start[stays]
        self.open = self.open[stays] & self.joined


def runs_of(ids: np.ndarray, doc: np.ndarray, n_words: int, shortest: int = 6, times: int = 4) -> tuple[np.ndarray, ...]:
    """Begin, end and period of all runs in the word ids of documents (``doc``: ascending), by begin, then period."""
    if len(ids) < shortest:
        return NONE, NONE, NONE
    prints, grammar = Fingerprints(ids, n_words), Grammar(ids, doc, n_words)
    pieces: list[tuple[np.ndarray, ...]] = []
    compress = True
    while True:
        at, rule = grammar.pairs() if compress else grammar.leftover()
        if not len(at):
            if compress:
                compress = False
                continue
            break
        order = np.argsort(rule, kind="stable")
        first = np.flatnonzero(_first(rule[order]))
        begin, mid, end = grammar.spans(at)
        one = order[first]
        which, i, j, q = crossing(ids, prints, begin[one], mid[one], end[one], shortest, times)
        if len(which):  # the nonterminal's other places
            n = np.diff(np.append(first, len(order)))[which]
            run = np.repeat(np.arange(len(which)), n)
            nth = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
            move = begin[order[first[which[run]] + nth]] - begin[one[which[run]]]
            pieces.append((i[run] + move, j[run] + move, q[run]))
        grammar.replace(at, rule)
    if not pieces:
        return NONE, NONE, NONE
    i, j, q = (np.concatenate(c) for c in zip(*pieces, strict=True))
    order = np.lexsort((-j, i, q))
    i, j, q = i[order], j[order], q[order]
    far = j + (np.cumsum(_first(q)) - 1) * (len(ids) + 1)
    top = np.maximum.accumulate(far)
    whole = np.ones(len(i), dtype=bool)
    whole[1:] = far[1:] > top[:-1]
    i, j, q = i[whole], j[whole], q[whole]
    order = np.lexsort((q, i))
    return i[order], j[order], q[order]


RUNS = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("runs", T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]), False)),
    T.StructField("collapsed", T.StringType())])


def find_runs(df: DataFrame, text_col: str = "text", shortest: int = 6, times: int = 4) -> DataFrame:
    """``df`` with ``n_words``, ``runs`` (first word, length and period of each run, by first word, then period) and
    ``collapsed``: the words without those that a run holds after its first period, joined by one space.

    Words are parted by ASCII white space and numbered from 0. A run has at least ``shortest`` words and ``times`` of its
    smallest period, and no neighbouring word extends it. Null, empty and blank texts have no words, no runs and collapse
    to the empty text; whole texts of any length are taken, one longer than a slice alone. Repeated rows are treated
    like any other. Columns of ``df`` named like an added one are replaced. One pass without a shuffle. Stretches are
    compared by fingerprints of 62 bits.
    """
    if times < 4:
        raise ValueError("runs of fewer than four periods may have less than two on either side of a boundary")

    def make():
        def work(_, texts):
            docs = [t.encode().split() for t in texts]
            coded = pa.array(list(chain.from_iterable(docs)), pa.binary()).dictionary_encode()
            ids = coded.indices.to_numpy().astype(np.int64)
            sizes = np.array([len(d) for d in docs], dtype=np.int64)
            begin = np.cumsum(sizes) - sizes
            i, j, q = runs_of(ids, np.repeat(np.arange(len(docs)), sizes), len(coded.dictionary), shortest, times)
            own = np.searchsorted(begin + sizes, i, side="right") if len(i) else NONE
            drop = np.zeros(len(ids) + 1, dtype=np.int64)
            np.add.at(drop, i + q, 1)
            np.add.at(drop, j, -1)
            stays = np.cumsum(drop[:-1]) == 0
            runs: list[list] = [[] for _ in docs]
            for d, a, n, p in zip(own.tolist(), (i - begin[own]).tolist(), (j - i).tolist(), q.tolist(), strict=True):
                runs[d].append({"start": a, "length": n, "period": p})
            collapsed = []
            for words, a, r in zip(docs, begin.tolist(), runs, strict=True):
                if r:
                    words = [words[k] for k in np.flatnonzero(stays[a:a + len(words)])]
                collapsed.append(b" ".join(words).decode())
            return [sizes.tolist(), runs, collapsed]

        return work

    return map_texts(df, text_col, df.columns, RUNS, make)
