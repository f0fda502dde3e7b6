"""SentencePiece encoding through a table of distinct chunks, and decoding.

With this kind of model no piece runs from a letter into a whitespace marker, so a text falls apart into chunks
(a run of markers and what follows up to the next marker) that are segmented independently.  Each distinct chunk
is segmented once by the library and kept in the task's table; a document's ids are the table's entries joined
by position.  The table is emptied when it holds TABLE_ROWS chunks, which bounds memory and changes no result.

A model that has pieces with a marker after another character, or a normalizer that is not the identity with a
dummy prefix, has no such chunks: ``check_model`` refuses it.

Defined results: a null or empty text has only the end id, and decodes to the empty text.  Null ids are kept.
Repeated rows are encoded alike.  Columns other than id and text are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
TABLE_ROWS = 150_000
#: Characters of text that are turned into one output batch.
BLOCK_CHARS = 1_000_000
_CHUNK = re.compile(" +[^ ]*")


@lru_cache(maxsize=2)
def _processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def check_model(path: str) -> None:
    """Raises ValueError if texts can't be split at markers under this model."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    spec = model.normalizer_spec
    if spec.precompiled_charsmap or spec.normalization_rule_tsv or not spec.add_dummy_prefix or spec.remove_extra_whitespaces or not spec.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("the normalizer changes more than spaces")
    for p in model.pieces:
        if MARK in p.piece.lstrip(MARK) or p.type == 4:
            raise ValueError(f"the piece {p.piece!r} runs over a chunk's end")


def chunks_of(text: str) -> list[str]:
    """The chunks without their first marker."""
    text = text.replace(MARK, " ")
    words = text.split(" ")
    return [c[1:] for c in _CHUNK.findall(" " + text)] if "" in words else words


class ChunkTable:
    def __init__(self, path: str):
        self.sp, self.ids = _processor(path), {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian 32-bit integers, without an end id."""
        split = [chunks_of(t) if t else [] for t in texts]
        if len(self.ids) > TABLE_ROWS:
            self.ids = {}
        known = self.ids
        new = list({c for s in split for c in s if c not in known})
        for c, ids in zip(new, self.sp.encode(new, num_threads=1), strict=True):
            known[c] = np.array(ids, "<i4").tobytes()
        if "" in known and not known[""]:  # a marker alone; the library adds none before nothing
            known[""] = np.array([self.sp.piece_to_id(MARK)], "<i4").tobytes()
        get = known.__getitem__
        return [b"".join(map(get, s)) for s in split]


def blocks(batches: Iterator[pa.RecordBatch], text_at: int = 1, limit: int = BLOCK_CHARS) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of consecutive rows with about that many characters; a null text is empty."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(text_at), strict=True):
            t = t.as_py() or ""
            ids.append(i)
            texts.append(t)
            size += len(t) + 64
            if size >= limit:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts
    pa.default_memory_pool().release_unused()  # workers are used again by other stages


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: bool = True, decode: bool = True) -> DataFrame:
    """id, ids (array of int) and, with decode, decoded (what the library's decode() makes of the ids)."""
    check_model(model_path)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, ids array<int>" + ", decoded string" * decode

    def run(batches):
        table = ChunkTable(model_path)
        end = np.array([table.sp.eos_id()] if end_id else [], "<i4").tobytes()
        for keys, texts in blocks(batches):
            coded = [c + end for c in table.encode(texts)]
            offsets = np.zeros(len(coded) + 1, "<i4")
            np.cumsum([len(c) // 4 for c in coded], out=offsets[1:])
            flat = np.frombuffer(b"".join(coded), "<i4")
            out = [pa.array(keys, like), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))]
            if decode:
                out.append(pa.array([table.sp.decode(np.frombuffer(c, "<i4").tolist()) if c else "" for c in coded], pa.string()))
            yield pa.RecordBatch.from_arrays(out, names=names)

    from pyspark.sql.pandas.types import to_arrow_type

    like, names = to_arrow_type(docs.schema[id_col].dataType), ["id", "ids"] + ["decoded"] * decode
    out = docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
    return out.withColumnRenamed("id", id_col)
