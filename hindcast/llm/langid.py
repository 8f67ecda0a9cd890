"""Language of web pages by Bayesian evidence fusion.

log P(language | page) = log P(text | language) + log P(declared | language) + log P(suffix | language)
                         + log P(language | host) + constant

* The text likelihood is that of a naive Bayes model of byte trigrams, fitted on labelled documents.
* Declared is the markup's language attribute, suffix the country domain or the language folder of the address. Their
  likelihoods are smoothed counts over all pages, in which a page counts for each language by its text posterior.
* The prior of a host is smoothed by that of its domain, and this by that of all pages; a page is left out of the counts of
  its own host and domain, so that its text counts once.
"""

from __future__ import annotations

import html
import re
from urllib.parse import urlsplit

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hindcast.llm.common import map_texts
from hindcast.session import stored

BUCKETS = 1 << 16
#: Labelled documents of each language that the text model is fitted on.
TRAIN_DOCS = 2000
#: Parts that a language's documents are ranked in before the best of all parts are.
LANES = 256
#: Weight of a trigram's log likelihood: trigrams overlap, so three share one letter's evidence.
TEMPER = 1 / 3
#: Pages that a domain's prior counts as in a host's, and all pages' in a domain's.
HOST_PSEUDO = 5.0
EVIDENCE_PSEUDO = 1.0

DROPPED = re.compile(r"(?is)<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b.*?(?:</\1\s*>|\Z)|<[^>]*>?")
ROOT = re.compile(r"(?is)<html\b([^>]*)>")
LANG = re.compile(r"""(?is)(?<![\w-])(?:xml:)?lang\s*=\s*["']?\s*([A-Za-z]{2,3})""")
META = re.compile(r"""(?is)<meta\b[^>]*http-equiv\s*=\s*["']?content-language["']?[^>]*content\s*=\s*["']?\s*([A-Za-z]{2,3})""")
FOLDER = re.compile(r"^/([a-z]{2})(?:[-_][A-Za-z]{2})?(?:/|$)")


def visible(page: str) -> str:
    return html.unescape(DROPPED.sub(" ", page))


def declared(page: str) -> str | None:
    root = ROOT.search(page)
    found = (LANG.search(root.group(1)) if root else None) or META.search(page)
    return found.group(1).lower() if found else None


def address(url: str) -> tuple[str | None, str | None, str | None]:
    """(host, domain, suffix): the last two labels of the host; its country domain or else the address's language folder."""
    try:
        parts = urlsplit(url)
        host = (parts.hostname or "").rstrip(".").lower()
    except ValueError:
        return None, None, None
    labels = host.split(".")
    top = labels[-1] if len(labels) > 1 and len(labels[-1]) == 2 and labels[-1].isalpha() else None
    folder = FOLDER.match(parts.path)
    return host or None, ".".join(labels[-2:]) or None, f".{top}" if top else f"/{folder.group(1)}" if folder else None


def trigrams(text: str) -> np.ndarray:
    """Bucket of each three bytes of the lower-case text, its letters only, words parted by one space."""
    data = np.frombuffer((" " + " ".join(re.findall(r"[^\W\d_]+", text.lower())) + " ").encode(), np.uint8).astype(np.uint32)
    x = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]
    return (x * np.uint32(2654435761)) >> np.uint32(16)


def fit_text_model(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
                   per_language: int = TRAIN_DOCS) -> tuple[list[str], np.ndarray]:
    """Languages and log probabilities (language, bucket), from the ``per_language`` documents of each language whose ids
    have the smallest hashes. The model's size does not depend on the documents'.

    Rows without a text or a language teach nothing; an empty text counts as a document without trigrams. Ties of hashes go
    to the smaller id; rows that repeat an id take a place each, and all of them are read. Without a labelled document there
    are no languages. Each of ``LANES`` lanes of a language gives its smallest hashes, and only these meet.
    """
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col), F.col(lang_col), F.xxhash64(id_col).alias("__hash")).withColumn("__lane", F.pmod(F.xxhash64("__hash"), F.lit(LANES)))
    for by in ([lang_col, "__lane"], [lang_col]):
        rank = F.row_number().over(Window.partitionBy(*by).orderBy("__hash", id_col))
        rows = rows.withColumn("__rank", rank).filter(F.col("__rank") <= per_language)
    picked = rows.select(id_col, lang_col)
    sample = docs.select(id_col, lang_col, text_col).join(picked, [id_col, lang_col], "left_semi")
    schema = T.StructType([T.StructField("bucket", T.ArrayType(T.IntegerType())), T.StructField("n", T.ArrayType(T.LongType()))])

    def work(_, texts):
        counted = [np.unique(trigrams(t), return_counts=True) for t in texts]
        return [[b.astype(np.int32) for b, _ in counted], [n.astype(np.int64) for _, n in counted]]

    each = map_texts(sample, text_col, [lang_col], schema, lambda: work).select(lang_col, F.explode(F.arrays_zip("bucket", "n")).alias("x"))
    rows = each.groupBy(F.col(lang_col).alias("lang"), F.col("x.bucket").alias("bucket")).agg(F.sum("x.n").alias("n")).toArrow().to_pydict()
    languages = sorted(set(rows["lang"]))
    counts = np.full((len(languages), BUCKETS), 0.5)
    number = {c: i for i, c in enumerate(languages)}
    counts[np.array([number[c] for c in rows["lang"]], dtype=np.int64), np.array(rows["bucket"], dtype=np.int64)] += rows["n"]
    return languages, np.log(counts / counts.sum(axis=1, keepdims=True)) if languages else counts


EVIDENCE = T.StructType([T.StructField("likelihood", T.ArrayType(T.DoubleType())), T.StructField("declared", T.StringType())])


def _evidence(pages: DataFrame, model: np.ndarray) -> DataFrame:
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def make():
        def work(_, texts):
            table = shared.value
            scores = [TEMPER * table[:, trigrams(visible(t))].sum(axis=1) if t else np.zeros(len(table)) for t in texts]
            return [[s - s.max() if len(s) else s for s in scores], [declared(t) for t in texts]]

        return work

    return map_texts(pages, "html", ["id", "url"], EVIDENCE, make)


PLACE = T.StructType([T.StructField(c, T.StringType()) for c in ("host", "domain", "suffix")])


def identify(pages: DataFrame, languages: list[str], model: np.ndarray, key: str = "page_id", url_col: str = "url",
             html_col: str = "html") -> DataFrame:
    """One row for each row of ``pages``: ``key``, ``lang``, ``probability``, ``text_lang`` (by the text alone, null without
    text), ``declared``, ``suffix`` and ``host``.

    Missing evidence (no text, no attribute, no address, null columns) leaves the others to decide; ties go to the first
    language by name. A language that the model does not know can be declared, which counts as one more value. Repeated
    rows count like any other. Other columns are not read; an empty table gives none. The counts are grouped sums, so a host
    with very many pages is added up in its tasks first. A model without languages gives null languages and probabilities.
    """
    k = len(languages)
    frame = pages.select(F.col(f"`{key}`").alias("id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html"))
    found = map_texts(_evidence(frame, model), "url", ["id", "likelihood", "declared"], PLACE,
                      lambda: lambda _, urls: list(zip(*[address(u) for u in urls])) or [[], [], []])
    if not languages:
        none = [F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("probability"), F.lit(None).cast("string").alias("text_lang")]
        return found.select(F.col("id").alias(key), *none, "declared", "suffix", "host")
    each = F.transform("likelihood", lambda x: F.exp(x))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    found = stored(found.withColumn("e", each).withColumn("posterior", F.transform("e", lambda x: x / total("e"))).drop("e"))
    mass = [F.sum(F.get("posterior", F.lit(i))).alias(f"m{i}") for i in range(k)]
    masses = F.array(*[f"m{i}" for i in range(k)])
    whole = found.agg(*mass).select(masses.alias("whole")).first()
    prior = [(x or 0.0) + 1.0 for x in (whole.whole or [0.0] * k)]
    prior = [x / sum(prior) for x in prior]

    def counted(by: str) -> DataFrame:
        return found.filter(F.col(by).isNotNull()).groupBy(by).agg(*mass).select(by, masses.alias(f"{by}_mass"))

    def likelihood(by: str) -> DataFrame:
        """Log P(value | language), smoothed."""
        table = counted(by)
        sums = table.agg(*[F.sum(F.get(f"{by}_mass", F.lit(i))).alias(f"s{i}") for i in range(k)], F.count("*").alias("values")).first()
        logs = [F.log((F.get(f"{by}_mass", F.lit(i)) + EVIDENCE_PSEUDO) / ((sums[f"s{i}"] or 0.0) + EVIDENCE_PSEUDO * (sums["values"] + 1)))
                for i in range(k)]
        return table.select(by, F.array(*logs).alias(f"{by}_log"))

    out = found.join(likelihood("declared"), "declared", "left").join(likelihood("suffix"), "suffix", "left")
    out = out.join(counted("host"), "host", "left").join(counted("domain"), "domain", "left")
    zero = F.array(*[F.lit(0.0)] * k)

    def others(by: str, i: int) -> Column:
        """Mass of the other pages of the group."""
        return F.greatest(F.lit(0.0), F.get(F.coalesce(f"{by}_mass", zero), F.lit(i)) - F.when(F.col(by).isNull(), 0.0).otherwise(
            F.get("posterior", F.lit(i))))

    domain = [others("domain", i) for i in range(k)]
    host = [others("host", i) for i in range(k)]
    add = lambda cols: sum(cols[1:], cols[0])
    by_domain = [(domain[i] + HOST_PSEUDO * prior[i]) / (add(domain) + HOST_PSEUDO) for i in range(k)]
    by_host = [(host[i] + HOST_PSEUDO * by_domain[i]) / (add(host) + HOST_PSEUDO) for i in range(k)]
    score = F.array(*[F.get("likelihood", F.lit(i)) + F.get(F.coalesce("declared_log", zero), F.lit(i))
                      + F.get(F.coalesce("suffix_log", zero), F.lit(i)) + F.log(by_host[i]) for i in range(k)])
    scored = out.withColumn("score", score).withColumn("best", F.array_max("score"))
    names = F.array(*[F.lit(x) for x in languages])
    pick = lambda a: F.get(names, (F.array_position(a, F.array_max(a)) - 1).cast("int"))
    certain = F.lit(1.0) / F.aggregate("score", F.lit(0.0), lambda x, s: x + F.exp(s - F.col("best")))
    said = F.array_max("likelihood") > F.array_min("likelihood")
    return scored.select(F.col("id").alias(key), pick(F.col("score")).alias("lang"), certain.alias("probability"),
                         F.when(said, pick(F.col("likelihood"))).alias("text_lang"), "declared", "suffix", "host")
