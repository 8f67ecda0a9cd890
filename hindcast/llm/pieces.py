"""SentencePiece encoding and decoding by a table of distinct chunks.

The model marks spaces, and none of its pieces holds a mark behind another character, so no merge crosses the border
between a word and the mark that follows it. A text is therefore cut into chunks (marks, then what is not a mark), each
distinct chunk is segmented once, and the ids are put back in the order of the chunks. The library segments the chunks;
the border rule is checked against the vocabulary when a model is loaded.
"""

from __future__ import annotations

import re
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from hindcast.llm.common import map_texts

MARK = "▁"
#: Distinct chunks that a task remembers; when there are more, the table starts anew, which changes no result.
TABLE_CHUNKS = 400_000


class ChunkTable:
    """Ids of distinct chunks, segmented on first sight."""

    def __init__(self, model_path: str, limit: int = TABLE_CHUNKS) -> None:
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        if self.model.encode(" a", out_type=str)[0] == MARK + "a" or self.model.encode("a", out_type=str)[0] != MARK + "a":
            raise ValueError("the model must add a mark in front of a text and keep all spaces")
        if any(re.search(f"[^{MARK}]{MARK}", self.model.id_to_piece(i)) for i in range(self.model.get_piece_size())):
            raise ValueError("a piece crosses a mark, so chunks can't be segmented apart")
        self.limit, self.ids = limit, {}
        self.chunk = re.compile(f"{MARK}+[^{MARK}]*")
        self.lone = [self.model.piece_to_id(MARK)]

    def segment(self, chunks: set[str]) -> None:
        """Adds the chunks that the table lacks. A chunk's first mark is the one that the library adds itself."""
        if len(self.ids) > self.limit:
            self.ids = {}
        new = [c for c in chunks if c not in self.ids]
        self.ids.update(zip(new, self.model.encode([c[1:] for c in new], num_threads=1), strict=True))
        if MARK in chunks:
            self.ids[MARK] = self.lone

    def encode(self, texts: list[str]) -> list[list[int]]:
        cut = [self.chunk.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        self.segment(set(chain.from_iterable(cut)))
        get = self.ids.__getitem__
        return [list(chain.from_iterable(map(get, chunks))) for chunks in cut]


IDS = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType(), False))])
DECODED = T.StructType([T.StructField("decoded", T.StringType())])


def encode(df: DataFrame, model_path: str, text_col: str = "text", decode: bool = False) -> DataFrame:
    """``df`` with ``ids``, the ids of each whole text as the library gives them, without begin and end; with
    ``decode`` also with ``decoded``, the text that the library makes of these ids.

    Null and empty texts have no ids and decode to the empty text. Repeated rows are encoded like any other. Columns of
    ``df`` named like an added one are replaced. No shuffle; each task has a table of its own, bounded by
    ``TABLE_CHUNKS`` and by the distinct chunks of the 2 MB of text, or one longer text, that it takes at a time.
    """
    def make():
        table = ChunkTable(model_path)

        def work(_, texts):
            ids = table.encode(texts)
            return [ids, table.model.decode(ids)] if decode else [ids]

        return work

    added = T.StructType(IDS.fields + DECODED.fields) if decode else IDS
    return map_texts(df, text_col, df.columns, added, make)


def decode(df: DataFrame, model_path: str, ids_col: str = "ids") -> DataFrame:
    """``df`` with ``decoded``, the library's text of each row's ids; null ids give the empty text."""
    import pyarrow as pa
    keep = [c for c in df.columns if c != "decoded"]
    schema = T.StructType([f for f in df.schema.fields if f.name in keep] + DECODED.fields)

    def run(batches):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        for b in batches:
            for part in (b.slice(i, 256) for i in range(0, b.num_rows, 256)):
                texts = model.decode([x or [] for x in part.column(ids_col).to_pylist()])
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(texts, pa.string())],
                                                 names=[*keep, "decoded"])

    return df.mapInArrow(run, schema)
