"""Queries of the pipeline operators and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from hindcast.llm import chat, decontam, discriminant, jaccard, langid, lines, pieces, pii, quality, ranked, repeats, runs, wordpiece
from hindcast.llm.common import sha256, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return register


def piece_model() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


@query("""
WITH rows AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
sized AS (
  SELECT *, length(text) + len(regexp_extract_all(text,
      '</?s>|<\\\\+/?s>|<\\\\*</?SYS>>|<\\\\*/?SYS>>|\\[\\\\*/?(INST|OUT|ROLE|TURN)\\]')) AS chars,
    coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text), 'start') AS before,
    lead(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) IS NULL AS is_last FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  (7 + sum(chars + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 11
    ELSE length(role) + 20 END))::BIGINT AS formatted_chars,
  bool_and(before || '>' || role IN ('start>system', 'start>user', 'system>user', 'user>assistant', 'assistant>user')
    AND (NOT is_last OR role = 'assistant')) AS valid
FROM sized GROUP BY conv_id""")
def op1_chat_format(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], rows.schema)
    out = chat.format_chats(rows.unionByName(extra))
    turns, loss = chat.read_back(F.col("formatted")), chat.loss_text(F.col("segments"))
    lines = F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return out.select("conv_id", F.size(turns).cast("long").alias("n_turns"),
                      sha256(F.array_join(lines, "")).alias("turns_sha256"),
                      F.length(loss).cast("long").alias("loss_chars"), sha256(loss).alias("loss_sha256"),
                      F.length("formatted").cast("long").alias("formatted_chars"), "valid")


@query()
def op2_sentencepiece(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pieces.encode(docs, piece_model(), decode=True)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                      F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                      sha256(F.col("decoded")).alias("decoded_sha256"))


@query()
def op4_token_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = wordpiece.count_tokens(docs, wordpiece.vocabulary(piece_model()))
    return out.select("doc_id", "n_words", "n_tokens", "n_unknown")


QUALITY_SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
words AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM docs),
places AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS p, w FROM words WHERE len(w) > 4),
windows AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, array_to_string(w[p:p + 4], ' ')) AS n FROM places),
hit AS (SELECT doc_id, count(DISTINCT p + d) AS n_repeat_words FROM windows, range(5) t(d) WHERE n > 1 GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs),
judged AS (
  SELECT doc_id, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
    length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS chars,
    len(regexp_extract_all(line, '[|»›·•]| > ')) AS bars, len(regexp_extract_all(line, '[#*$%&|<>]')) AS symbols
  FROM lines),
ruled AS (
  SELECT *, CASE
    WHEN bars >= 3 AND n <= 4 * (bars + 1) THEN 'navigation'
    WHEN n >= 2 AND symbols > 0.5 * n THEN 'punctuation'
    WHEN n >= 30 AND NOT regexp_matches(line, '[.!?,;:…。！？]') THEN 'punctuation'
    WHEN n <= 25 AND regexp_matches(lower(line), 'all rights reserved|privacy policy|terms of use|terms of service|cookie policy|use cookies|enable javascript|skip to content|skip to main|back to top|powered by|lorem ipsum|sign up for|subscribe to our|follow us on|share this') THEN 'boilerplate'
    END AS rule
  FROM judged WHERE n > 0),
per AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) FILTER (WHERE rule = 'navigation') AS n_navigation,
    count(*) FILTER (WHERE rule = 'punctuation') AS n_punctuation, count(*) FILTER (WHERE rule = 'boilerplate') AS n_boilerplate,
    coalesce(sum(chars) FILTER (WHERE rule IS NOT NULL), 0)::BIGINT AS lost_chars
  FROM ruled GROUP BY doc_id),
counted AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_navigation, 0) AS n_navigation,
    coalesce(n_punctuation, 0) AS n_punctuation, coalesce(n_boilerplate, 0) AS n_boilerplate,
    coalesce(lost_chars, 0)::BIGINT AS lost_chars
  FROM words LEFT JOIN hit USING (doc_id) LEFT JOIN per USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, n_navigation, n_punctuation, n_boilerplate, lost_chars,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND lost_chars <= 0.5 * word_chars AS kept
FROM counted"""


@query(QUALITY_SQL)
def op7_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.measure(docs, keep=["doc_id"]).drop("cleaned")


@query(r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wins AS (SELECT item_id, least(len(w), 10) AS k, array_to_string(w[s:s + 9], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS s FROM items WHERE len(w) > 0)),
places AS (SELECT doc_id, s, k, array_to_string(w[s:s + k - 1], ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM docs, (SELECT DISTINCT k FROM wins))),
found AS (SELECT doc_id, s, places.k, item_id FROM places JOIN wins USING (win)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM found) GROUP BY doc_id),
held AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM found) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN held USING (doc_id)""")
def op5_decontamination(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontam.contamination(docs, table(spark, sf_dir, "benchmark"), ["doc_id"])
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      sha256(F.array_join("items", ",")).alias("items_sha256"), "contaminated")


@query(r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS s FROM docs WHERE len(w) > 0),
grams AS (SELECT DISTINCT doc_id, array_to_string(w[s:s + 4], ' ') AS g FROM starts),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM grams a JOIN grams b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * o >= 80 * (x.n + y.n - o)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (WITH RECURSIVE r(a, b) AS (SELECT DISTINCT a, a FROM both_ways UNION SELECT r.a, e.b FROM r JOIN both_ways e ON r.b = e.a)
  SELECT a, min(b) AS m FROM r GROUP BY a)
SELECT docs.doc_id, coalesce(n, 0) AS n_shingles, coalesce(m, docs.doc_id) AS component_id
FROM docs LEFT JOIN sizes USING (doc_id) LEFT JOIN reach ON reach.a = docs.doc_id""")
def op9_jaccard_join(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard.similar_components(docs)


@query()
def op6_suffix_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = repeats.remove_repeats(docs)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query()
def op3_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = lines.dedup_lines(docs, shorter=True)
    return out.select("doc_id", "n_lines", "n_same", "n_near", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("kept_chars"),
                      sha256(F.col("text")).alias("kept_sha256"))


@query()
def op8_pii(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pii.find(docs)
    mark = lambda s, kind: F.concat_ws(":", kind, s["start"].cast("string"), s["end"].cast("string"))
    base = F.transform("spans", lambda s: mark(s, s["kind"]))
    terms = F.transform("terms", lambda s: F.struct(s["start"].alias("start"), F.lit(len(pii.KINDS)).alias("kind"), mark(s, F.lit("term")).alias("m")))
    ranked = F.transform("spans", lambda s: F.struct(
        s["start"].alias("start"), (F.array_position(F.array(*[F.lit(k) for k in pii.KINDS]), s["kind"]) - 1).cast("int").alias("kind"),
        mark(s, s["kind"]).alias("m")))
    every = F.transform(F.sort_array(F.concat(ranked, terms)), lambda s: s["m"])
    def number(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return out.select("doc_id", *[number(k) for k in pii.KINDS], sha256(F.array_join(base, ",")).alias("base_sha256"), F.array_join(every, ",").alias("spans"),
                      F.size("terms").cast("long").alias("n_term"))


@query()
def op10_language_id(spark, sf_dir):
    languages, model = langid.fit_text_model(table(spark, sf_dir, "documents"))
    out = langid.identify(table(spark, sf_dir, "pages"), languages, model)
    return out.withColumn("probability", F.round("probability", 6))


@query()
def op11_quality_classifier(spark, sf_dir):
    out = discriminant.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


@query(r"""
WITH words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
docs AS (SELECT doc_id, w, len(w)::BIGINT AS n FROM words WHERE len(w) > 0),
corpus AS (SELECT count(*)::BIGINT AS all_docs, sum(n)::BIGINT AS all_terms FROM docs),
items AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
postings AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, n, unnest(w) AS term FROM docs)
  WHERE term IN (SELECT term FROM items) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * all_docs + 2) / (2 * count(*) + 1)))::BIGINT AS weight
  FROM postings, corpus GROUP BY term, all_docs),
scored AS (SELECT item_id, doc_id,
    sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + ((50 * n * all_docs) // all_terms)))))::BIGINT AS score
  FROM items JOIN postings USING (term) JOIN weights USING (term), corpus GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
  FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50""")
def op12_ranked_search(spark, sf_dir):
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def periodic(docs):
    """The documents that the contract of the run query asks for: where the checksum h of the id ends in 0, the words from
    place a on repeat the p words there."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = F.coalesce(h % 10 == 0, F.lit(False))
    split = docs.withColumn("w", F.when(chosen, F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda x: x != "")))
    sized = split.withColumn("n", F.size("w")).withColumn("g", F.floor(h / 10)).withColumn(
        "a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    shaped = sized.withColumn("p", (F.lit(1) + F.floor((F.col("n") - F.col("a")) / (F.lit(3) + F.col("g") % 8))).cast("int"))
    rest = F.col("n") - F.col("a")
    tail = F.slice(F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil(rest / F.col("p")).cast("int"))), F.lit(1), rest)
    text = F.when(F.col("n") > 0, F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), tail), " ")).otherwise(F.col("text"))
    return shaped.select("doc_id", text.alias("text"))


@query()
def op13_periodic_runs(spark, sf_dir):
    out = runs.find_runs(periodic(table(spark, sf_dir, "documents").select("doc_id", "text")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n")))
    out = out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("top"), sha256(listed).alias("runs_sha256"),
                     sha256(F.col("collapsed")).alias("collapsed_sha256"))
    return out.select("doc_id", "n_runs", (-F.col("top.s")).alias("start"), F.col("top.n").alias("length"), (-F.col("top.p")).alias("period"),
                      F.floor(1000 * F.col("top.n") / -F.col("top.p")).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
