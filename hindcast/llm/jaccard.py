"""Exact Jaccard join of word shingles by a token-group matrix.

Documents that are alike form groups, a group stores the union of its members' tokens, and a document opens a group
only if its overlap with that union is large enough for a link with some member. The steps:

1. Sets. A text's distinct shingles, as 64-bit hashes. Equal sets are one class, which one document stands for.
2. Groups. Documents that agree in a min-hash are compared with the smallest document among them; true links make
   clusters, and documents without one that resemble the same smallest document make a family. Clusters and families are
   cut into groups of about ``GROUP`` documents.
3. Matrix. Any two linked sets share a token among the first ``n - ceil(t * n) + 1`` of each, in any common order of
   tokens. The order puts frequent tokens last. (token, group) holds these tokens of all members; a document
   meets the groups that share one early enough for the overlap that a link needs, and the groups of its own family.
4. Bound and open. |set ∩ union| >= t * |set| must hold. The bound is taken first on hashed rows of the matrix: at most
   (1 - t) * |set| of the set's columns may be missing from the union's. The texts of what is left meet, the bound is taken on
   the tokens, and the members of qualifying groups are compared exactly.

Links inside a cluster change no component, so they are not looked for: copies of a text, however many, cost one
comparison each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type as to_arrow

from hindcast.llm.common import left_small, map_texts, right_small, text_slices, within
from hindcast.llm.graph import components
from hindcast.session import stored

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Members of a group, on average.
GROUP = 64
#: Min-hashes of a set; the first ``ROUNDS`` of them pick the documents to compare.
SKETCH, ROUNDS = 16, 6
#: Shared tokens, of which the order puts the more frequent later. The bound is on the list that is sent to tasks: it changes the
#: number of candidates, never the result.
COMMON_TOKENS, COMMON_FROM = 400_000, 2
#: Agreement of sketches, in percent, from which documents belong to one family.
FAMILY_PERCENT = 30
#: 64-bit words of a set's row in the token-group matrix, whose columns are tokens by hash.
WORDS = 32
SEEDS = np.random.default_rng(11).integers(1, 2**63, SKETCH, dtype=np.uint64) | np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose results look random."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def token_sets(texts: list[str], size: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its ``size``-word shingles.

    Words are parted by ASCII white space, A-Z in lower case. Fewer words are one shingle, none give an empty set.
    """
    import xxhash
    docs = [t.encode().translate(LOWER).split() for t in texts]
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for d in docs for w in d], dtype=np.int64)
    words = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in number), np.uint64, len(number))
    flat = words[ids] if len(ids) else np.zeros(0, np.uint64)
    factor = [np.uint64(pow(0x9E3779B97F4A7C15, j, 2**64)) for j in range(size)]
    last = max(0, len(flat) - size + 1)
    sums = np.zeros(last, np.uint64)
    for j in range(size):
        sums += flat[j:last + j] * factor[size - 1 - j]
    sums = mixed(sums)
    out, at = [], 0
    for d in docs:
        n = len(d)
        if n >= size:
            out.append(np.unique(sums[at:at + n - size + 1]))
        elif n:
            short = np.full(1, n, np.uint64)
            for h in flat[at:at + n]:
                short = short * factor[1] + h
            out.append(mixed(short))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def common_tokens(docs: DataFrame, text_col: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted tokens that several sets hold within parts of batches, at most ``COMMON_TOKENS``, and a class of frequency (the
    doublings of the number of such sets)."""
    schema = T.StructType([T.StructField("token", T.LongType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, text_col, 4 << 20):
                sets = {s.tobytes(): s for s in token_sets(list({t or "" for t in part.column(text_col).to_pylist()}), size)}
                tokens, n = np.unique(np.concatenate([*sets.values(), np.zeros(0, np.uint64)]), return_counts=True)
                more = n > 1
                yield pa.RecordBatch.from_arrays([pa.array(tokens[more].view(np.int64)), pa.array(n[more].astype(np.int64))],
                                                 names=["token", "n"])

    counted = docs.select(text_col).mapInArrow(run, schema).groupBy("token").agg(F.sum("n").alias("n"))
    top = counted.filter(F.col("n") >= COMMON_FROM).orderBy(F.desc("n"), "token").limit(COMMON_TOKENS).toArrow()
    tokens = top.column("token").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], np.log2(top.column("n").to_numpy().astype(np.float64)[order]).astype(np.int8)


SETS = T.StructType([T.StructField("n", T.LongType()), T.StructField("sum", T.LongType()), T.StructField("xor", T.LongType()),
                     T.StructField("sketch", T.ArrayType(T.LongType())), T.StructField("prefix", T.ArrayType(T.LongType())),
                     T.StructField("bits", T.ArrayType(T.LongType()))])


def _sets(docs: DataFrame, text_col: str, size: int, percent: int, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def make():
        last, classes = shared.value

        def work(_, texts):
            cols: list[list] = [[] for _ in SETS.fields]
            for s in token_sets(texts, size):
                n = len(s)
                if not n:
                    row = [0, 0, 0, [], [], []]
                else:
                    k = np.searchsorted(last, s)
                    k = np.minimum(k, max(0, len(last) - 1))
                    own = np.where(last[k] == s, classes[k], 0) if len(last) else np.zeros(n, np.int8)
                    first = s[np.argsort(own, kind="stable")][:n - (percent * n + 99) // 100 + 1]
                    sketch = np.concatenate([mixed(s[k:k + 4096] * SEEDS[:, None]).min(axis=1, keepdims=True) for k in range(0, n, 4096)], axis=1)
                    bits = np.zeros(64 * WORDS, np.uint8)
                    bits[(s % np.uint64(64 * WORDS)).astype(np.int64)] = 1
                    row = [n, s.sum().astype(np.int64), np.bitwise_xor.reduce(mixed(s ^ SEEDS[0])).astype(np.int64),
                           sketch.min(axis=1).view(np.int64), first.view(np.int64), np.packbits(bits).view(np.int64)]
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            return cols

        return work

    return map_texts(docs, text_col, ["id"], SETS, make)


#: Documents that ask one copy of a group.
ASKS = 1024


def _ask(groups: DataFrame, asks: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) between the documents ``a`` of ``asks`` (g, a) and members ``b`` of the groups ``g`` (g, b) that they ask.

    A group is opened only if the document's overlap with the union of the members' sets allows a link. Of a group named
    ``linked...`` the first linked member is returned, of others all. Groups must be small. One that many documents ask is copied for every ``ASKS`` of them. Texts
    are shuffled once, next to the group.
    """
    copies = asks.groupBy("g").agg(F.ceil(F.count("*") / ASKS).alias("m"))
    asking = asks.join(copies, "g").select(F.col("a").alias("id"), "g", F.pmod(F.xxhash64("a"), "m").alias("copy"), F.lit(1).alias("side"))
    asked = groups.join(copies, "g").select(F.col("b").alias("id"), "g", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("copy"),
                                            F.lit(0).alias("side"))
    wanted = stored(asking.unionByName(asked.withColumn("copy", F.col("copy").cast("long"))))
    texts = right_small(within(docs, wanted.select("id").distinct(), "id"), wanted, "id")
    placed = texts.select("g", "copy", "side", "id", "text").repartition("g", "copy").sortWithinPartitions("g", "copy", "side")
    key = docs.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, members, union = None, [], np.zeros(0, np.uint64)
        for batch in batches:
            for part in text_slices(batch, "text"):
                links: list[tuple] = []
                sets = token_sets([t or "" for t in part.column("text").to_pylist()], size)
                rows = zip(*(part.column(c).to_pylist() for c in ("g", "copy", "side", "id")), sets, strict=True)
                for g, copy, side, own, tokens in rows:
                    if (g, copy) != now:
                        now, members, union = (g, copy), [], None
                    if side == 0:
                        members.append((own, tokens))
                        continue
                    if union is None:
                        union = members[0][1] if len(members) == 1 else np.unique(np.concatenate([t for _, t in members]))
                    if shared(tokens, union) * 100 < percent * len(tokens):
                        continue
                    for b, t in members:
                        if b == own:
                            continue
                        low, high = sorted((len(tokens), len(t)))
                        if low * 100 >= percent * high:
                            both = shared(tokens, t)
                            if both * 100 >= percent * (low + high - both):
                                links.append((own, b))
                                if str(g).startswith("linked"):
                                    break
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], to_arrow(key)), pa.array([y for _, y in links], to_arrow(key))],
                                                 names=["a", "b"])

    return placed.mapInArrow(run, T.StructType([T.StructField("a", key), T.StructField("b", key)]))


def shared(s: np.ndarray, t: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    small, large = (s, t) if len(s) <= len(t) else (t, s)
    if not len(small):
        return 0
    k = np.minimum(np.searchsorted(large, small), len(large) - 1)
    return int((large[k] == small).sum())


def _star_links(reps: DataFrame, docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links between documents that agree in a min-hash and the smallest of those that do, where the whole sketches let
    one expect a link; and the ``family`` of documents that at least resemble such a smallest one."""
    each = reps.select("id", F.posexplode(F.slice("sketch", 1, ROUNDS)).alias("k", "h"))
    pivot = each.groupBy("k", "h").agg(F.min("id").alias("b"), F.count("*").alias("m")).filter("m > 1").select("k", "h", "b")
    pairs = each.join(pivot, ["k", "h"]).filter("id > b").select(F.col("id").alias("a"), "b").distinct()
    side = lambda c: reps.select(F.col("id").alias(c), F.col("sketch").alias(f"s{c}"))
    agree = F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda x, y: x + y)
    alike = stored(pairs.join(side("a"), "a").join(side("b"), "b").withColumn("agree", agree).filter(
        F.col("agree") * 100 >= SKETCH * FAMILY_PERCENT).select("a", "b", "agree"))
    likely = alike.filter(F.col("agree") * 100 >= SKETCH * (percent - 20))
    groups = likely.select(F.col("b").alias("g"), "b").distinct()
    links = stored(_ask(groups, likely.select(F.col("b").alias("g"), "a"), docs, size, percent))
    return links, alike.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("family"))


def _groups(reps: DataFrame, clusters: DataFrame, families: DataFrame) -> DataFrame:
    """``id``, ``n`` and the group of each document: ``single`` (no link known yet), ``gc`` (its cluster, or the family of a
    single one), ``gb`` (a block of the cluster or family, about ``GROUP`` documents) and ``m``, the blocks."""
    named = left_small(left_small(reps, clusters, "id"), families, "id").select(
        "id", "n", F.col("cluster").isNull().alias("single"), F.coalesce("cluster", "family", "id").alias("gc"))
    sizes = named.groupBy("single", "gc").agg(F.count("*").alias("size")).filter("size > 1")
    out = left_small(named.withColumn("k", F.struct("single", "gc")), sizes.select(F.struct("single", "gc").alias("k"), "size"), "k")
    m = F.ceil(F.coalesce("size", F.lit(1)) / GROUP)
    return stored(out.select("id", "n", "single", "gc", F.pmod(F.xxhash64("id"), m).alias("gb"), F.coalesce("size", F.lit(1)).alias("size")))


def _opened_links(sets: DataFrame, grouped: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Links between documents of different groups, and between the single ones of a family."""
    key = F.xxhash64("single", "gc")
    other = grouped.filter("NOT single OR gc <> id").select("id", key.alias("group"))
    rows = left_small(sets.select("id", "prefix"), other, "id").select(
        "id", F.coalesce("group", F.xxhash64(F.lit(True), "id")).alias("group"), F.posexplode("prefix").alias("pos", "token"))
    several = rows.groupBy("token").agg(F.min("group").alias("low"), F.max("group").alias("high")).filter("low < high").select("token")
    met_tokens = stored(within(rows, stored(several), "token").select("id", "pos", "token"))
    own = met_tokens.join(grouped, "id").withColumn("rest", F.col("n") - F.col("pos"))
    asked = [F.col(c).alias(f"h{c[1:]}") for c in ("gc", "gb")]
    matrix = own.groupBy("token", F.col("single").alias("hs"), *asked).agg(
        F.min("n").alias("low"), F.max("n").alias("high"), F.max("rest").alias("room"))
    # at the first token that two linked sets share, each has the whole overlap still before it
    enough = F.least("rest", "room") * (100 + percent) >= percent * (F.col("n") + F.col("low"))
    fits = (F.col("n") * 100 >= percent * F.col("low")) & (F.col("high") * 100 >= percent * F.col("n"))
    turn = F.struct("single", "gc") > F.struct("hs", "hc")
    met = own.join(matrix, (own.token == matrix.token) & turn & fits & enough).select(F.col("id").alias("a"), "n", "hs", "hc", "hb")
    single = grouped.filter("single AND size > 1")
    blocks = single.select(F.col("gc").alias("hc"), F.col("gb").alias("hb")).distinct()
    inside = single.join(blocks, (F.col("gc") == F.col("hc")) & (F.col("hb") <= F.col("gb"))).select(
        F.col("id").alias("a"), "n", F.lit(True).alias("hs"), "hc", "hb")
    met = stored(met.unionByName(inside).distinct())
    members = grouped.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("single").alias("hs"), *asked)
    names = ["hs", "hc", "hb"]
    groups = members.join(met.select(*names).distinct(), names)
    # the matrix's row of a group: the union of its members' rows
    union = groups.join(sets.select(F.col("id").alias("b"), "bits"), "b").groupBy(*names).agg(
        F.min("n_b").alias("low"), F.array(*[F.bit_or(F.get("bits", F.lit(i))) for i in range(WORDS)]).alias("union"))
    asked = met.join(sets.select(F.col("id").alias("a"), "bits"), "a").join(union, names)
    lacking = F.aggregate(F.zip_with("bits", "union", lambda x, u: F.bit_count(x.bitwiseAND(F.bitwise_not(u)))), F.lit(0), lambda x, y: x + y)
    least = F.greatest(F.col("low") * 100, percent * F.col("n"))
    bound = lacking * (100 * (100 + percent)) <= F.col("n") * (100 * (100 + percent)) - percent * (100 * F.col("n") + least)
    open_ = stored(asked.filter(bound).select("a", *names))
    name = F.concat_ws("|", F.when(F.col("hs"), "single").otherwise("linked"), F.col("hc").cast("string"), F.col("hb").cast("string")).alias("g")
    return _ask(groups.join(open_.select(*names).distinct(), names).select(name, "b"), open_.select(name, "a"), docs, size, percent)


def similar_components(docs: DataFrame, key: str = "doc_id", text_col: str = "text", size: int = 5,
                       percent: int = 80) -> DataFrame:
    """One row for each row of ``docs``: ``key``, ``n_shingles`` and ``component_id``, the smallest key that links lead to.

    Two documents are linked if 100 * |intersection| >= percent * |union| of their shingle sets. Null, empty and blank
    texts have an empty set and no links. Rows with a null key are counted but have a null component. Rows that share a
    key are one document with the links of all of them. Other columns are not read; an empty table gives none.
    """
    frame = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    sets = stored(_sets(frame, "text", size, percent, common_tokens(frame, "text", size)))
    known = sets.filter("id IS NOT NULL AND n > 0")
    same = known.groupBy("n", "sum", "xor").agg(F.min("id").alias("rep"))
    same_sets = stored(known.select("id", "n", "sum", "xor").join(same, ["n", "sum", "xor"]).distinct())
    classes = same_sets.select("id", "n", "rep")
    own = classes.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("b"))
    reps = stored(known.join(classes.filter("id = rep").select("id").distinct(), "id", "left_semi").select("id", "n", "sketch"))
    with_key = frame.filter("id IS NOT NULL")
    stars, families = _star_links(reps, with_key, size, percent)
    clusters = stored(components(stars).withColumnRenamed("component", "cluster"))
    own_set = F.struct("id", "n", "sum", "xor").alias("own_set")
    copies = same_sets.filter("id <> rep").select(own_set)
    leading = within(known.select("*", own_set), copies, "own_set", anti=True)
    grouped = _groups(reps.select("id", "n"), clusters, stored(families))
    opened = stored(_opened_links(leading, grouped, with_key, size, percent))
    tied = classes.join(own.filter("a < b").select("id", "a"), "id").filter("a < rep").select("a", F.col("rep").alias("b"))
    links = stars.unionByName(opened).unionByName(tied)
    found = components(links)
    placed = own.join(found, own.a == found.id, "left").select(own.id.alias("id"), F.coalesce("component", "a").alias("component_id"))
    return sets.select("id", F.col("n").alias("n_shingles")).join(placed, "id", "left").select(
        F.col("id").alias(key), "n_shingles", F.coalesce("component_id", "id").alias("component_id"))


def keep_one(docs: DataFrame, key: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """The documents whose key is the smallest of their component; rows with a null key stay. Columns as in ``docs``."""
    rest = similar_components(docs, key, text_col, size, percent).filter(F.col(key) != F.col("component_id"))
    gone = rest.select(F.col(key).alias("__gone")).distinct()
    return docs.join(gone, F.col(f"`{key}`") == F.col("__gone"), "left_anti")
