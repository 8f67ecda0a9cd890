"""Line-first quality rules: failing lines go, then documents that lost too much text.

Rules of a line (blank lines are left as they are): *navigation*, a row of link labels between bars or arrows;
*punctuation*, a longer line with too many symbols or none of the marks that end or part a sentence; *boilerplate*, a short
line with a stock phrase. A document is kept if the base rules hold for its whole text and the failing lines hold at
most ``max_lost`` of its word characters.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hindcast.llm.common import map_texts

SYMBOLS = b"#*$%&|<>"
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"

#: Phrases of lines that belong to a site, not to a text.
PHRASES = ("all rights reserved", "privacy policy", "terms of use", "terms of service", "cookie policy", "use cookies",
           "enable javascript", "skip to content", "skip to main", "back to top", "powered by", "lorem ipsum",
           "sign up for", "subscribe to our", "follow us on", "share this")


@dataclass(frozen=True)
class Rules:
    min_words: int = 10
    max_repeat_percent: int = 20
    window: int = 5
    bars: int = 3
    bar_words: float = 4.0
    symbols_per_word: float = 0.5
    unmarked_words: int = 30
    phrase_words: int = 25
    phrases: tuple[str, ...] = PHRASES
    max_lost: float = 0.5


class LineCheck:
    def __init__(self, rules: Rules) -> None:
        self.rules = rules
        self.bar = re.compile(r"[|»›·•]| > ")
        self.phrase = re.compile("|".join(map(re.escape, rules.phrases)) or "(?!)")
        self.mark = re.compile(r"[.!?,;:…。！？]")

    def fails(self, line: str, raw: bytes, n_words: int) -> str | None:
        """The rule that a line with words fails."""
        r = self.rules
        bars = len(self.bar.findall(line))
        if bars >= r.bars and n_words <= r.bar_words * (bars + 1):
            return "navigation"
        if n_words >= 2 and len(raw) - len(raw.translate(None, SYMBOLS)) > r.symbols_per_word * n_words:
            return "punctuation"
        if n_words >= r.unmarked_words and not self.mark.search(line):
            return "punctuation"
        if n_words <= r.phrase_words and self.phrase.search(line.lower()):
            return "boilerplate"
        return None


def repeated_words(docs: list[list[bytes]], window: int, rng_seed: int = 7) -> list[int]:
    """For each list of words, those in windows of ``window`` words that occur at least twice in it.

    Windows are compared by 64-bit sums of random numbers of their words, and those with equal sums word by word.
    """
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for d in docs for w in d], dtype=np.int64)
    out = [0] * len(docs)
    if len(ids) < window + 1:
        return out
    sizes = np.array([len(d) for d in docs], dtype=np.int64)
    doc = np.repeat(np.arange(len(docs), dtype=np.int64), sizes)
    values = np.random.default_rng(rng_seed).integers(0, 2**64, (window, len(number)), dtype=np.uint64)
    last = len(ids) - window + 1
    sums = sum(values[j][ids[j:last + j]] for j in range(window))
    own = np.flatnonzero(doc[:last] == doc[window - 1:])
    if not len(own):
        return out
    order = own[np.lexsort((sums[own], doc[own]))]
    same = (sums[order[1:]] == sums[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    pairs = np.flatnonzero(same)
    for j in range(window):
        pairs = pairs[ids[order[pairs] + j] == ids[order[pairs + 1] + j]]
    starts = np.unique(np.concatenate([order[pairs], order[pairs + 1]]))
    hit = np.zeros(len(ids), dtype=bool)
    for j in range(window):
        hit[starts + j] = True
    per_doc = np.bincount(doc[hit], minlength=len(docs))
    return per_doc.tolist()


MEASURES = T.StructType([
    *[T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
    T.StructField("base_failed", T.BooleanType()),
    *[T.StructField(c, T.LongType()) for c in ("n_navigation", "n_punctuation", "n_boilerplate", "lost_chars")],
    T.StructField("kept", T.BooleanType()), T.StructField("cleaned", T.StringType())])


def measure(df: DataFrame, text_col: str = "text", rules: Rules = Rules(), keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``df`` (all by default) with the measures of each whole text, the lines that failed each
    rule, ``lost_chars`` (characters in words of those lines), ``kept`` and ``cleaned`` (the text without those lines).

    Words are parted by ASCII white space. A null or empty text has no words, fails the base rules and cleans to the
    empty text. Repeated rows are measured like any other. Columns of ``df`` named like an added one are replaced. One
    pass without a shuffle.
    """
    def make():
        check = LineCheck(rules)
        code = {"navigation": 0, "punctuation": 1, "boilerplate": 2}

        def work(_, texts):
            raws = [t.encode() for t in texts]
            docs = [r.split() for r in raws]
            repeats = repeated_words(docs, rules.window)
            cols: list[list] = [[] for _ in MEASURES.fields]
            for text, raw, words, rep in zip(texts, raws, docs, repeats, strict=True):
                n = len(words)
                chars = len(raw.translate(None, SPACES).decode())
                seen: set[str] = set()
                dup, failed, lost, left = 0, [0, 0, 0], 0, []
                for line in text.split("\n"):
                    own = line.encode()
                    k = len(own.split())
                    if k:
                        dup += line in seen
                        seen.add(line)
                        if (why := check.fails(line, own, k)) is not None:
                            failed[code[why]] += 1
                            lost += len(own.translate(None, SPACES).decode())
                            continue
                    left.append(line)
                bad = n < rules.min_words or 100 * rep > rules.max_repeat_percent * n
                values = [n, chars, len(raw) - len(raw.translate(None, SYMBOLS)), dup, rep, bad, *failed, lost,
                          not bad and lost <= rules.max_lost * chars, "\n".join(left)]
                for c, v in zip(cols, values, strict=True):
                    c.append(v)
            return cols

        return work

    return map_texts(df, text_col, df.columns if keep is None else keep, MEASURES, make)


def clean(df: DataFrame, text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """The documents that are kept, with their failing lines removed; columns as in ``df``, whatever their names."""
    whole = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__doc"), F.col(f"`{text_col}`").alias("text"))
    out = measure(whole, "text", rules, keep=["__doc"]).filter("kept")
    return out.select(*[F.col("cleaned").alias(c) if c == text_col else F.col("__doc")[c].alias(c) for c in df.columns])
