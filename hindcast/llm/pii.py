"""Personal data: base patterns, and terms that reveal what they protect.

The entities to protect are the values that the base patterns find. A term discloses an entity as far as knowing the term
tells the entity: with counts over the distinct texts of the whole corpus (terms are known by 64-bit hashes), the pointwise mutual information of term and entity
as a share of the entity's information content (Sánchez and Batet, "C-sanitized", 2016). It is 1 for a term that stands with
that entity alone and 0 for one that is independent of it. One text in common is evidence enough: most entities have no more.
Terms over ``Limits.generalise`` are replaced by their class, those over ``Limits.remove`` go, wherever they stand in a text
with that entity.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hindcast.llm.common import attach, left_small, map_texts, right_small, text_slices
from hindcast.session import stored

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
TERM = re.compile(r"[^\W\d_]{3,}")
#: Bits of the filter that tells the counting tasks which terms are wanted: 16 MB, whatever the number of terms.
FILTER_BITS = 27
#: Words and counts that a task remembers before it starts anew.
TASK_TERMS = 200_000


@dataclass(frozen=True)
class Limits:
    generalise: float = 0.6
    remove: float = 0.9


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end()))
            done = found.end()
        at = text.find("@", max(done, at + 1))
    return out


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base patterns, leftmost and non-overlapping for each kind, by start and kind."""
    spans = [(s, 0, e) for s, e in emails(text)]
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                spans.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                spans.append((m.start(), 2, m.end()))
        for m in PHONE.finditer(text):
            if 9 <= len(DIGIT.findall(m.group())) <= 15:
                spans.append((m.start(), 3, m.end()))
    return [(s, KINDS[k], e) for s, k, e in sorted(spans)]


def entity(kind: str, value: str) -> str:
    """What two mentions of the same thing have in common."""
    return f"{kind}:{value.lower() if kind in ('email', 'ip') else ''.join(DIGIT.findall(value))}"


def terms_outside(text: str, spans: list[tuple[int, str, int]]) -> Iterator[tuple[str, int, int]]:
    """(term, start, end) of the terms of a text that are not inside any span."""
    inside, k = sorted((s, e) for s, _, e in spans), 0
    for m in TERM.finditer(text):
        s, e = m.span()
        while k < len(inside) and inside[k][1] <= s:
            k += 1
        if k == len(inside) or inside[k][0] >= e:
            yield m.group().lower(), s, e


def term_hash(term: str) -> int:
    """64 bits, signed: what a term is known by in counts and joins."""
    from xxhash import xxh3_64_intdigest
    h = xxh3_64_intdigest(term)
    return h - (1 << 64) if h >> 63 else h


SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("end", T.IntegerType())])
NEAR = T.StructType([T.StructField("term", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
FOUND = T.StructType([T.StructField("spans", T.ArrayType(SPAN)), T.StructField("near", T.ArrayType(NEAR)),
                      T.StructField("entities", T.ArrayType(T.LongType()))])


def _found(docs: DataFrame) -> DataFrame:
    def make():
        def work(_, texts):
            spans, near, mentioned = [], [], []
            for text in texts:
                own = base_spans(text)
                spans.append([{"start": s, "kind": k, "end": e} for s, k, e in own])
                near.append([{"term": term_hash(t), "start": s, "end": e} for t, s, e in terms_outside(text, own)] if own else [])
                mentioned.append([term_hash(x) for x in {entity(k, text[s:e]) for s, k, e in own}])
            return [spans, near, mentioned]

        return work

    return stored(map_texts(docs, "text", ["id", "th"], FOUND, make))


def _filter(terms: DataFrame) -> np.ndarray:
    """A bit for the top ``FILTER_BITS`` bits of each of the ``terms``, in words of 64; the driver gets the words with any."""
    place = F.call_function("shiftrightunsigned", F.col("term"), F.lit(64 - FILTER_BITS))
    word, bit = F.call_function("shiftright", place, F.lit(6)), F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))
    found = terms.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), dtype=np.int64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return out


def _text_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``term`` and ``n``, the distinct texts that hold it, for all ``terms`` (and some others that share a bit of the filter); the null
    term counts all texts with a term.

    Each of m copies of a text counts 1 / m, so that texts need no shuffle to be counted once.
    """
    wanted = docs.sparkSession.sparkContext.broadcast(_filter(terms))
    schema = T.StructType([T.StructField("term", T.LongType()), T.StructField("n", T.DoubleType())])
    copies = stored(docs.groupBy("th").agg(F.count("*").alias("m")).filter("m > 1"))
    counted = left_small(docs.select("th", "text"), copies, "th").select("text", (1 / F.coalesce("m", F.lit(1))).alias("share"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, known, counts, every = wanted.value, {}, {}, 0.0

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([None, *counts], pa.int64()), pa.array([every, *counts.values()], pa.float64())], names=["term", "n"])

        def look(word: str) -> int | None:
            h = term_hash(word)
            place = (h & 0xFFFFFFFFFFFFFFFF) >> (64 - FILTER_BITS)
            known[word] = out = h if int(bits[place >> 6]) >> (place & 63) & 1 else None
            return out

        for batch in batches:
            for part in text_slices(batch, "text"):
                for text, share in zip(part.column("text").to_pylist(), part.column("share").to_pylist(), strict=True):
                    own = set(map(str.lower, TERM.findall(text or "")))
                    every += share if own else 0
                    for word in own:
                        h = known[word] if word in known else look(word)
                        if h is not None:
                            counts[h] = counts.get(h, 0.0) + share
                if len(known) > TASK_TERMS:
                    known = {}
                if len(counts) > TASK_TERMS:
                    yield rows()
                    counts, every = {}, 0.0
        yield rows()

    return counted.mapInArrow(run, schema).groupBy("term").agg(F.round(F.sum("n")).cast("long").alias("n"))


def disclosures(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """``entity``, ``term`` and ``share``, the part of the entity's information that the term gives away.

    ``pairs`` has each ``entity``, ``term`` and ``th`` of a text once, and a row with a null term for each entity of a text.
    """
    both = stored(pairs.groupBy("entity", "term").agg(F.count("*").alias("both")))
    counts = stored(_text_counts(docs, both.select("term").filter("term IS NOT NULL").distinct()))
    alone = both.filter("term IS NULL").select("entity", F.col("both").alias("n_entity"))
    total = F.lit(counts.filter("term IS NULL").agg(F.max("n")).first()[0] or 1)
    joined = both.filter("term IS NOT NULL").join(alone, "entity").join(counts.withColumnRenamed("n", "n_term"), "term")
    pmi = F.log2(F.col("both") * total / (F.col("n_term") * F.col("n_entity")))
    return joined.select("entity", "term", F.greatest(F.lit(0.0), pmi / F.greatest(F.log2(total / F.col("n_entity")), F.lit(1e-9))).alias("share"))


def find(docs: DataFrame, key: str = "doc_id", text_col: str = "text", limits: Limits = Limits()) -> DataFrame:
    """One row for each row of ``docs``: ``key``, ``spans`` (start, kind, end; base kinds) and ``terms`` (start, end, share).

    Positions are code points, ends exclusive. Null and empty texts have no spans. Copies of a text get the same spans; rows
    that share key and text are one document. Null keys are keys like any other; other columns are not read; an
    empty table gives none.
    """
    frame = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text_col}`").alias("text")).withColumn("th", F.xxhash64("text"))
    found = _found(frame)
    with_entity = found.filter(F.size("entities") > 0)
    words = F.concat(F.array_distinct(F.transform("near", lambda x: x["term"])), F.array(F.lit(None).cast("long")))
    texts = with_entity.select("th", "entities", words.alias("words")).dropDuplicates(["th"])
    pairs = stored(texts.select("th", F.explode("entities").alias("entity"), "words").select("th", "entity", F.explode("words").alias("term")))
    telling = disclosures(pairs, frame).filter(F.col("share") >= limits.generalise)
    shares = pairs.join(telling, ["entity", "term"]).groupBy("th", "term").agg(F.max("share").alias("share"))
    told = F.map_from_entries(F.collect_list(F.struct("term", "share")))
    per_text = stored(shares.groupBy("th").agg(told.alias("told")))
    spot = right_small(with_entity.select("id", "th", "near"), per_text, "th")
    kept = F.filter(F.transform("near", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.col("told")[x["term"]].alias("share"))),
                    lambda x: x["share"].isNotNull())
    per_doc = stored(spot.select("id", "th", F.sort_array(kept).alias("terms")).filter(F.size("terms") > 0).dropDuplicates(["id", "th"]))
    out = attach(found.select("id", "th", "spans"), per_doc, ["id", "th"])
    empty = F.array().cast("array<struct<start:int,end:int,share:double>>")
    return out.select(F.col("id").alias(key), F.col("th").alias("text_hash"), "spans", F.coalesce("terms", empty).alias("terms"))


def sanitise(docs: DataFrame, key: str = "doc_id", text_col: str = "text", limits: Limits = Limits()) -> DataFrame:
    """``docs`` with what ``find`` reports taken out of the text: base spans become their kind in brackets, terms are replaced by
    their class or go. Overlapping spans become one, named after the first. Columns as in ``docs``; null texts stay null."""
    spans = find(docs, key, text_col, limits).dropDuplicates([key, "text_hash"]).select(
        F.col(key).alias("__key"), F.col("text_hash").alias("__th"), F.col("spans").alias("__spans"), F.col("terms").alias("__terms"))
    rows = docs.withColumns({"__key": F.col(f"`{key}`"), "__th": F.xxhash64(F.col(f"`{text_col}`"))})
    placed = attach(rows, spans.filter((F.size("__spans") > 0) | (F.size("__terms") > 0)), ["__key", "__th"])
    keep, schema = docs.columns, docs.schema
    placed = placed.select(*[F.col(f"`{c}`") for c in keep], "__spans", "__terms")

    def cut(text: str, spans: list[dict], terms: list[dict]) -> str:
        marks = [(s["start"], s["end"], f"[{s['kind'].upper()}]") for s in spans or []]
        for t in terms or []:
            word = text[t["start"]:t["end"]]
            name = "" if t["share"] >= limits.remove else "[NAME]" if word[:1].isupper() else "[WORD]"
            marks.append((t["start"], t["end"], name))
        out, at = [], 0
        for start, end, name in sorted(marks):
            if start >= at:
                out += [text[at:start], name]
            at = max(at, end)
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, text_col):
                rows = zip(*(part.column(c).to_pylist() for c in (text_col, "__spans", "__terms")), strict=True)
                texts = [None if t is None else cut(t, s, x) if s or x else t for t, s, x in rows]
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == text_col else part.column(c) for c in keep], names=keep)

    return placed.mapInArrow(run, schema)
