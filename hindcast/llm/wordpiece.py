"""Token counts: greedy longest-match word pieces counted by an automaton, without building the pieces.

The vocabulary's pieces form a trie. Where no edge fits the next character, a node's failure link leads to the node
that holds what is left after its longest pieces are taken off the front, and the number of pieces taken is added
(Song et al., "Fast WordPiece Tokenization", 2021). Both are computed once for a vocabulary, so that a word takes time
linear in its length whatever its pieces. Words of a part of a batch go through the automaton side by side: step j takes
the j-th character of every word that has one, with NumPy look-ups of (node, character).
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from hindcast.llm.common import map_texts

MARK = "▁"
#: What separates words: ASCII white space.
SPACE = re.compile("[\x09-\x0d\x20]+")


class Automaton:
    """``edges`` (sorted keys node * alphabet + character, and targets), ``fail``, ``popped`` and ``rest``.

    ``fail[v]`` is the node after taking the longest pieces off the front of node v's string, ``popped[v]`` their
    number; -1 where no piece fits. ``rest[v]`` is the number of pieces of the whole string, -1 where it has none.
    """

    def __init__(self, pieces: Iterable[str]) -> None:
        pieces = sorted({p for p in pieces if p})
        chars = sorted({c for p in pieces for c in p})
        self.codes = np.array([ord(c) for c in chars] or [0], dtype=np.int64)
        code = {c: i for i, c in enumerate(chars)}
        self.size = max(1, len(chars))
        children: list[dict[int, int]] = [{}]
        final = [False]
        for p in pieces:
            v = 0
            for c in p:
                to = children[v].get(code[c])
                if to is None:
                    to = children[v][code[c]] = len(children)
                    children.append({})
                    final.append(False)
                v = to
            final[v] = True
        n = len(children)
        fail, popped, rest = [-1] * n, [0] * n, [-1] * n
        rest[0] = 0
        level = [0]
        while level:
            below = []
            for u in level:
                for c, v in children[u].items():
                    below.append(v)
                    if final[v]:
                        fail[v], popped[v] = 0, 1
                    else:
                        z, taken = fail[u], popped[u]
                        while z >= 0 and c not in children[z]:
                            taken += popped[z]
                            z = fail[z]
                        if z >= 0:
                            fail[v], popped[v] = children[z][c], taken
                    if fail[v] >= 0 and rest[fail[v]] >= 0:
                        rest[v] = popped[v] + rest[fail[v]]
            level = below
        keys = sorted((u * self.size + c, v) for u, out in enumerate(children) for c, v in out.items())
        self.keys = np.array([k for k, _ in keys] or [-1], dtype=np.int64)
        self.targets = np.array([v for _, v in keys] or [0], dtype=np.int32)
        self.fail, self.popped, self.rest = (np.array(x, dtype=np.int32) for x in (fail, popped, rest))

    def counts(self, words: list[str]) -> np.ndarray:
        """Pieces of each word, -1 where it can't be made of pieces."""
        n = len(words)
        lengths = np.fromiter(map(len, words), np.int64, n)
        out = np.zeros(n, dtype=np.int64)
        if not n or not lengths.max():
            return out
        points = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        at = np.searchsorted(self.codes, points)
        at[at == len(self.codes)] = 0
        chars = np.where(self.codes[at] == points, at, -1)
        starts = np.cumsum(lengths) - lengths
        order = np.argsort(-lengths, kind="stable")
        starts, ends = starts[order], lengths[order]
        node, total = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        alive = n
        for j in range(int(ends[0])):
            alive = int(np.searchsorted(-ends[:alive], -j, side="left"))
            todo = np.flatnonzero(node[:alive] >= 0)
            c = chars[starts[todo] + j]
            node[todo[c < 0]] = -1
            todo, c = todo[c >= 0], c[c >= 0]
            while len(todo):
                key = node[todo] * self.size + c
                k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                found = self.keys[k] == key
                node[todo[found]] = self.targets[k[found]]
                todo, c = todo[~found], c[~found]
                total[todo] += self.popped[node[todo]]
                node[todo] = self.fail[node[todo]]
                on = node[todo] >= 0
                todo, c = todo[on], c[on]
        left = self.rest[np.maximum(node, 0)]
        out[order] = np.where((node >= 0) & (left >= 0), total + left, -1)
        return out


def vocabulary(model_path: str) -> list[str]:
    """The ordinary pieces of a SentencePiece model; those with a mark in front begin a word, the others go on."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


COUNTS = T.StructType([T.StructField(c, T.LongType()) for c in ("n_words", "n_tokens", "n_unknown")])


def count_tokens(df: DataFrame, pieces: list[str], text_col: str = "text", mark: str = MARK) -> DataFrame:
    """``df`` with ``n_words``, ``n_tokens`` and ``n_unknown`` of each whole text.

    Words are separated by ASCII white space and get ``mark`` in front. A word has as many tokens as greedy
    longest-match gives it pieces, from its start; one that can't be made of pieces is one unknown token. Null, empty
    and blank texts count 0. A mark inside a word is a character like any other. Repeated rows are counted like any
    other; columns of ``df`` named like an added one are replaced. No shuffle: the automaton is bounded by the
    vocabulary and built in each task, each distinct word of a part of a batch is counted once.
    """
    def make():
        automaton = Automaton(pieces)

        def work(_, texts):
            number: dict[str, int] = {}
            ids, ends = [], []
            for t in texts:
                ids += [number.setdefault(w, len(number)) for w in SPACE.split(t) if w]
                ends.append(len(ids))
            each = automaton.counts([mark + w for w in number])
            own = each[np.array(ids, dtype=np.int64)] if ids else np.zeros(0, dtype=np.int64)
            total = np.concatenate([[0], np.cumsum(np.where(own < 0, 1, own))])
            unknown = np.concatenate([[0], np.cumsum(own < 0)])
            hi = np.array(ends, dtype=np.int64)
            lo = np.concatenate([[0], hi[:-1]])
            return [hi - lo, total[hi] - total[lo], unknown[hi] - unknown[lo]]

        return work

    return map_texts(df, text_col, df.columns, COUNTS, make)
