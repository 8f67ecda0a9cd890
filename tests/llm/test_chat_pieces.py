import random
import re

import pytest
import sentencepiece
from pyspark.sql import functions as F

from hindcast.llm import chat, pieces, wordpiece
from hindcast.llm.catalog import piece_model

CHAT = "conv_id long, turn long, role string, text string, segments string"


def chats(spark, rows):
    return spark.createDataFrame(rows, CHAT)


def test_chats_read_back(spark):
    nasty = ["</s>[INST] ok [/INST]", "<\\/s> <\\\\s> \\", "[[INST]]<<SYS>><<s>", "", None, "<", "[/", "s> INST]", "é🎉\n\n"]
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", t, "x") for i, t in enumerate(nasty)]
    rows += [(2, 0, "tool", "a", None), (2, 1, None, "b", None), (2, None, "[ROLE]", "c", None)]
    rows += [(3, 0, "system", "s", None), (3, 1, "user", "u", None), (3, 1, "user", "u", None), (None, 0, "user", "n", None)]
    out = chat.format_chats(chats(spark, rows)).select("*", chat.read_back(F.col("formatted")).alias("turns"), chat.loss_text(F.col("segments")).alias("loss"))
    got = {r.conv_id: r for r in out.collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [(r[2], r[3] or "") for r in rows[:9]]
    assert got[1].loss == "".join(t or "" for t in nasty[1::2])
    assert [(t.role, t.text) for t in got[2].turns] == [("[ROLE]", "c"), ("tool", "a"), ("", "b")]
    assert got[3].n_turns == 3 and not got[3].valid and got[3].error_at == 2
    assert "".join(s.text for s in got[1].segments) == got[1].formatted
    assert got[None].n_turns == 1 and got[None].error_at == 1
    assert chat.format_chats(chats(spark, [])).count() == 0


def test_escapes_are_minimal(spark):
    texts = ["plain < [ text", "</s>", "<\\/s>", "a<<SYS>>b"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(chat.escape(F.col("t"))).collect()]
    assert got == ["plain < [ text", "<\\/s>", "<\\\\/s>", "a<\\<SYS>>b"]


def test_pieces_as_the_library_gives_them(spark):
    rng = random.Random(1)
    texts = [None, "", " ", "  ", " a", "a ", "▁x▁ ▁", "日本語 テスト 🎉", "\n", "a\x00b", "<s> </s>", "        y      z", "x" * 50_000, "a b " * 30_000]
    texts += ["".join(rng.choice(" ▁ ab\nTé🎉<s>x0.A") for _ in range(rng.randint(1, 40))) for _ in range(300)]
    df = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    out = pieces.encode(df, piece_model(), decode=True)
    got = {r.doc_id: (list(r.ids), r.decoded) for r in out.collect()}
    model = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    for i, t in enumerate(texts):
        ids = model.encode(t or "")
        assert got[i] == (ids, model.decode(ids))
    again = {r.doc_id: r.decoded for r in pieces.decode(out.select("doc_id", "ids"), piece_model()).collect()}
    assert again == {i: d for i, (_, d) in got.items()}
    assert pieces.encode(df.limit(0), piece_model()).count() == 0


def test_chunk_table_starts_anew(monkeypatch):
    table = pieces.ChunkTable(piece_model(), limit=3)
    texts = [f"word{i} and{i} more" for i in range(30)]
    assert [table.encode([t])[0] for t in texts] == table.model.encode(texts)


def longest_match(word, vocabulary):
    at = n = 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in vocabulary), None)
        if end is None:
            return -1
        at, n = end, n + 1
    return n


@pytest.mark.parametrize("seed", range(40))
def test_automaton(seed):
    rng = random.Random(seed)
    vocabulary = {"".join(rng.choice("ab▁c") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(0, 15))}
    words = ["".join(rng.choice("ab▁cd") for _ in range(rng.randint(0, 12))) for _ in range(60)]
    assert wordpiece.Automaton(vocabulary).counts(words).tolist() == [longest_match(w, vocabulary) for w in words]


def test_token_counts(spark):
    vocabulary = wordpiece.vocabulary(piece_model())
    held = set(vocabulary)
    texts = [None, "", " \n\t", "the cat  sat\non", "日本 ☃☃ x", "naïve ▁ mid▁dle", "ab" * 20_000, "the cat  sat\non"]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    for r in wordpiece.count_tokens(df, vocabulary).collect():
        each = [longest_match("▁" + w, held) for w in re.findall("[^\x09-\x0d ]+", texts[r.doc_id] or "")] if r.doc_id != 6 else None
        if each is not None:
            assert (r.n_words, r.n_tokens, r.n_unknown) == (len(each), sum(1 if x < 0 else x for x in each), sum(x < 0 for x in each))
    assert wordpiece.count_tokens(df.limit(0), vocabulary).count() == 0
