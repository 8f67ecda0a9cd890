"""Benchmark decontamination by a positional inverted index.

The index has one row per document: for each indexed word its posting, the sorted positions. Windows of the test items
are looked up from their rarest word: its postings, found by one join on the word, give the candidate starts, and the
postings of the other words, less their offsets in the window, are intersected with these in the order of their
rarity. Only words of the test items are indexed, and of these only runs long enough to hold a window, so the index
grows with what can match, not with the text.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hindcast.llm.common import lower_ascii, map_texts
from hindcast.session import stored

#: Bytes of words and what parts them: A-Z in lower case, then a-z, 0-9 and all bytes of other characters are kept.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: More distinct words of test items than this are not sent to the tasks; all words are indexed then.
MAX_TERMS = 2_000_000

POSTING = T.StructType([T.StructField("term", T.StringType()), T.StructField("positions", T.ArrayType(T.IntegerType()))])
INDEX = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("postings", T.ArrayType(POSTING))])


def words(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(WORD), 0)


def windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = 10) -> DataFrame:
    """The distinct windows of ``size`` words of all items (``words``), each with the ``items`` that hold it.

    An item with fewer words, but not none, is one window; null and empty texts have none.
    """
    listed = items.select(F.col(id_col).alias("item"), words(F.col(text_col)).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (size - 1), F.lit(1)))
    return (listed.select("item", "w", F.explode(starts).alias("s"))
            .select("item", F.slice("w", F.col("s"), F.lit(size)).alias("words"))
            .groupBy("words").agg(F.collect_set("item").alias("items")))


def build_index(docs: DataFrame, keys: list[str], text_col: str = "text", terms: frozenset[str] | None = None,
                min_run: int = 1) -> DataFrame:
    """The index, written to the shared folder: ``row`` (one for each row of ``docs``), ``keys``, ``n_words`` and
    ``postings``.

    With ``terms`` only these words are indexed, and only where at least ``min_run`` of them stand next to each other.
    Null and empty texts have no words; repeated rows are rows of their own. A key named like an index column fails.
    """
    if clash := {"row", *INDEX.names} & set(keys):
        raise ValueError(f"key columns named {sorted(clash)}")
    kept = None if terms is None else frozenset(t.encode() for t in terms)

    def make():
        def work(_, texts):
            counts, postings = [], []
            for text in texts:
                found = text.encode().translate(FOLD).split()
                counts.append(len(found))
                if kept is None:
                    at = range(len(found))
                else:
                    flag = np.fromiter(map(kept.__contains__, found), bool, len(found))
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], flag, [False]]).astype(np.int8)))
                    begin, end = edge[::2], edge[1::2]
                    at = [i for b, e in zip(begin, end) if e - b >= min_run for i in range(b, e)]
                own: dict[bytes, list[int]] = {}
                for i in at:
                    own.setdefault(found[i], []).append(int(i))
                postings.append([{"term": w.decode(), "positions": p} for w, p in own.items()])
            return [counts, postings]

        return work

    frame = docs.select(F.monotonically_increasing_id().alias("row"), *keys, text_col) if text_col not in keys else \
        docs.select(F.monotonically_increasing_id().alias("row"), *keys)
    return stored(map_texts(frame, text_col, ["row", *keys], INDEX, make))


def _probes(index: DataFrame, wins: DataFrame) -> DataFrame:
    """For each word that is the rarest of some window, those windows, with their words from the rarest on."""
    postings = index.select(F.explode("postings").alias("p")).select("p.term", F.size("p.positions").alias("n"))
    frequency = postings.groupBy("term").agg(F.sum("n").alias("n"))
    each = wins.select("words", "items", F.posexplode("words").alias("offset", "term"))
    ranked = each.join(frequency, "term").groupBy("words").agg(
        F.first("items").alias("items"), F.sort_array(F.collect_list(F.struct("n", "offset", "term"))).alias("terms"))
    full = ranked.filter(F.size("terms") == F.size("words"))
    window = F.struct(F.size("words").alias("size"), F.col("terms"), F.col("items"))
    return full.groupBy(F.col("terms")[0]["term"].alias("term")).agg(F.collect_list(window).alias("windows"))


def _with_candidates(index: DataFrame, wins: DataFrame, found: Column) -> DataFrame:
    """``row``, ``postings`` as a map and the candidates that ``found`` makes of each posting and its windows."""
    postings = index.select("row", F.explode("postings").alias("p")).select("row", "p.term", "p.positions")
    hits = postings.join(_probes(index, wins), "term").select("row", found.alias("c")).filter(F.size("c") > 0)
    per_row = hits.groupBy("row").agg(F.flatten(F.collect_list("c")).alias("c"))
    lists = index.select("row", F.map_from_entries("postings").alias("lists"))
    return per_row.join(lists, "row")


def phrase_matches(index: DataFrame, wins: DataFrame) -> DataFrame:
    """``row`` and ``hits`` (array of start, size and items): every occurrence of every window.

    Rows without any are left out. The index must hold all words of the windows, in runs of the smallest window.
    """
    starts = F.flatten(F.transform("windows", lambda w: F.transform(
        F.filter("positions", lambda p: p >= w["terms"][0]["offset"]),
        lambda p: F.struct((p - w["terms"][0]["offset"]).alias("start"), w.alias("window")))))
    inside = lambda c, lists: F.forall(c["window"]["terms"], lambda t: F.array_contains(
        lists[t["term"]], c["start"] + t["offset"]))
    cand = _with_candidates(index, wins, starts)
    hits = F.transform(F.filter("c", lambda c: inside(c, F.col("lists"))), lambda c: F.struct(
        c["start"].alias("start"), c["window"]["size"].alias("size"), c["window"]["items"].alias("items")))
    return cand.select("row", hits.alias("hits")).filter(F.size("hits") > 0)


def proximity_matches(index: DataFrame, wins: DataFrame, slop: int) -> DataFrame:
    """``row`` and ``hits`` (array of position and items): places of a window's rarest word around which all its words
    stand, in any order, at most ``slop`` words away. The index must be built with ``min_run`` 1."""
    places = F.flatten(F.transform("windows", lambda w: F.transform("positions", lambda p: F.struct(
        p.alias("position"), w.alias("window")))))
    near = lambda c, lists: F.forall(c["window"]["terms"], lambda t: F.exists(
        lists[t["term"]], lambda q: F.abs(q - c["position"]) <= slop))
    cand = _with_candidates(index, wins, places)
    hits = F.transform(F.filter("c", lambda c: near(c, F.col("lists"))), lambda c: F.struct(
        c["position"].alias("position"), c["window"]["items"].alias("items")))
    return cand.select("row", hits.alias("hits")).filter(F.size("hits") > 0)


def contamination(docs: DataFrame, items: DataFrame, keys: list[str], text_col: str = "text",
                  item_id: str = "item_id", item_text: str = "text", size: int = 10) -> DataFrame:
    """One row for each row of ``docs``: ``keys``, ``n_words``, ``n_hit`` (words inside any occurrence of a window),
    ``items`` (sorted as strings) and ``contaminated``.

    Null texts have no words. Empty tables of documents give no rows, empty tables of items no hits. Repeated rows are
    judged each on its own.
    """
    wins = windows(items, item_id, item_text, size)
    terms = wins.select(F.explode("words").alias("term")).distinct()
    listed = [r.term for r in terms.limit(MAX_TERMS + 1).collect()]
    smallest = wins.agg(F.min(F.size("words"))).first()[0] or 1
    fits = len(listed) <= MAX_TERMS
    index = build_index(docs, keys, text_col, frozenset(listed) if fits else None, smallest if fits else 1)
    covered = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(
        h["start"], h["start"] + h["size"] - 1))))
    names = F.sort_array(F.array_distinct(F.flatten(F.transform("hits", lambda h: h["items"].cast("array<string>")))))
    hits = phrase_matches(index, wins).select("row", F.size(covered).cast("long").alias("n_hit"), names.alias("items"))
    out = index.select("row", *keys, "n_words").join(hits, "row", "left")
    return out.select(*keys, "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
                      F.coalesce("items", F.array().cast("array<string>")).alias("items"),
                      F.col("n_hit").isNotNull().alias("contaminated"))


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", text_col: str = "text",
                  size: int = 10) -> DataFrame:
    """The documents without those that hold a window of an item; rows without a key are judged together.

    Columns as in ``docs``. If rows share a key, all go when one of them is contaminated.
    """
    bad = contamination(docs, items, [key], text_col, size=size).filter("contaminated").select(
        F.col(key).alias("__bad")).distinct()
    return docs.join(bad, F.col(f"`{key}`").eqNullSafe(F.col("__bad")), "left_anti")
