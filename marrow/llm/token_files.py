"""Token ids as files: frequency-ranked, byte-aligned variable-length codes with separate control bytes.

The commonest id of the corpus has rank 0.  A rank takes 1 to 4 bytes; the lengths of four ranks stand in one
control byte (two bits each, the first in the lowest), and control and data bytes are kept apart, so that numpy
decodes a block by one table lookup of lengths and a gather.

The format: under one folder, ``vocabulary`` is a Parquet table (rank, id, count) and ``blocks`` holds Parquet
files of blocks (part, seq, offset, doc_ids, lens, control, data).  Parts and, within a part, blocks are in
ascending order of document id (null ids first, copies of an id by their text's hash); ``offset`` is the number
of ids before the block in its part and ``lens`` the number of ids of each document.  Parquet is only the
container: it gives atomic commits, and any store that Spark reaches can hold it.

Texts are tokenized once.  They are dealt to parts by range of id, and each task tokenizes the distinct words of
a block and joins their ids by position: a byte-level BPE of this kind splits every text before a space, and on
both sides of a newline, that has no white space on either side.  Counts of all documents make the ranks; they and
the sizes of parts (one row for each) are all that the driver receives.

Defined results: a null or empty text has the end id only; a null id sorts first, and rows that repeat an id are
documents of their own.  A text is one entry of one block, however long: a task holds a block and the longest text.
An empty table makes empty files.  Columns other than id and text are ignored, whatever their names.  A tokenizer of another kind is refused.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from marrow.llm.common import saved

#: Bytes of text in a block of the files, and distinct words that are tokenized in one string.
BLOCK_BYTES, JOINED = 16_000_000, 200
#: Texts with white space beside a space or a newline, or a space or a newline at an end.
_WHITE = r"\t\x{0b}\f\r\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_ODD = rf"\A[ \n]|[ \n]\z|[ \n][ \n{_WHITE}]|[{_WHITE}][ \n]"
_LENGTHS = np.array([[(c >> (2 * k) & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def check_tokenizer(path: str) -> None:
    """Raises ValueError if the file is of another kind than the one whose splits this module relies on."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    before, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    kind = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    if spec.get("normalizer") is not None or not kind or model.get("type", "BPE") != "BPE" or model.get("dropout"):
        raise ValueError(f"{path} is no byte-level BPE that splits texts at spaces")
    if any(t.get("lstrip") or t.get("rstrip") or t.get("normalized") for t in spec.get("added_tokens", ())):
        raise ValueError(f"{path} has added tokens that take white space with them")


class WordTable:
    """Tokenizes a block of texts through the table of its distinct words."""

    def __init__(self, path: str):
        self.tok = _tokenizer(path)
        vocab = self.tok.get_vocab(with_added_tokens=False)
        self.size = max(self.tok.get_vocab_size(), max(vocab.values(), default=0) + 1)
        self.spaced = np.zeros(self.size, bool)
        self.spaced[[i for t, i in vocab.items() if t[0] == "Ġ"]] = True
        self.newline = np.array(self._one("\n"), "<u4")

    def _one(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def _encoded(self, groups: list[list[str]], after_space: bool) -> Iterator[tuple[list[str], object]]:
        for at in range(0, len(groups), 32):  # the library's results are much larger than the ids in them
            some = groups[at : at + 32]
            joined = [" " + " ".join(g) if after_space else "\n".join(g) for g in some]
            yield from zip(some, self.tok.encode_batch_fast(joined, add_special_tokens=False), strict=True)

    def _distinct(self, words: list[str], after_space: bool) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Runs of ids, and the number of each word's: many words go in one string, in which an id that starts with a space starts a word, or the id of a newline ends one."""
        runs, sizes = [], []
        groups = [words[i : i + JOINED] for i in range(0, len(words), JOINED)]
        for group, enc in self._encoded(groups, after_space):
            ids = np.array(enc.ids, "<u4")
            marks = self.spaced[ids] if after_space else ids == self.newline[0]
            at = np.flatnonzero(marks)
            size = np.diff(np.append(at, len(ids))) if after_space else np.diff(np.concatenate([[-1], at, [len(ids)]])) - 1
            run = ids if after_space else ids[~marks]
            if len(size) != len(group):  # a word that itself holds such an id
                each = [np.array(self._one(" " * after_space + w), "<u4") for w in group]
                run, size = np.concatenate(each), np.array([len(x) for x in each])
            runs.append(run)
            sizes.append(size)
        return runs, sizes

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and the number of ids of each text."""
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False) | (pc.binary_length(texts).to_numpy() == 0)
        if odd.any():  # these are tokenized whole
            whole = self.tok.encode_batch_fast(texts.filter(pa.array(odd)).to_pylist(), add_special_tokens=False)
            whole = [np.array(e.ids, "<u4") for e in whole]
            if odd.all():
                return np.concatenate(whole), np.array([len(x) for x in whole])
            flat, counts = self.encode(texts.filter(pa.array(~odd)))
            plain, lens = np.split(flat, np.cumsum(counts)[:-1]), np.zeros(len(texts), np.int64)
            order, w, q = [], 0, 0
            for k, o in enumerate(odd.tolist()):
                part, w, q = (whole[w], w + 1, q) if o else (plain[q], w, q + 1)
                order.append(part)
                lens[k] = len(part)
            return np.concatenate(order), lens
        words = pc.split_pattern(pc.replace_substring(texts, "\n", " \n "), " ")
        bounds = words.offsets.to_numpy()
        coded = words.flatten().dictionary_encode()
        code, names = coded.indices.to_numpy().astype(np.int32), coded.dictionary
        n = len(names)
        nl = pc.index(names, pa.scalar("\n", names.type)).as_py()
        bare = np.zeros(len(code), bool)  # words with no space before them: at a text's and at a line's start
        bare[bounds[:-1] - bounds[0]] = True
        bare[1:] |= code[:-1] == nl
        code[bare] += n
        if nl >= 0:
            code[(code == nl) | (code == nl + n)] = nl
        used = np.flatnonzero(np.bincount(code, minlength=2 * n))
        used = used[used != nl]
        first = np.searchsorted(used, n)
        spaced, bare_ones = self._distinct(names.take(pa.array(used[:first])).to_pylist(), True), self._distinct(names.take(pa.array(used[first:] - n)).to_pylist(), False)
        runs, sizes = spaced[0] + bare_ones[0], spaced[1] + bare_ones[1]
        if nl >= 0:
            used, runs, sizes = np.append(used, nl), [*runs, self.newline], [*sizes, [len(self.newline)]]
        length, start = np.zeros(2 * n + 1, np.int32), np.zeros(2 * n + 1, np.int32)
        length[used] = np.concatenate(sizes)
        start[used] = np.cumsum(length[used]) - length[used]
        size = length[code]
        ends = np.cumsum(size, dtype=np.int32)
        at = np.repeat(start[code] - (ends - size), size)
        at += np.arange(ends[-1], dtype=np.int32)
        counts = np.add.reduceat(size, bounds[:-1] - bounds[0])
        return np.concatenate(runs)[at], counts


def _slices(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """The batches cut and joined to runs of rows of about that many bytes of text (column 1)."""
    held, size = [], 0
    for batch in batches:
        sizes = np.cumsum(pc.binary_length(batch.column(1)).to_numpy().astype(np.int64) + 16)
        at = 0
        while at < len(batch):
            before = sizes[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(sizes, before + limit - size, "right")))
            held.append(batch.slice(at, to - at))
            size += int(sizes[to - 1] - before)
            at = to
            if size >= limit or at < len(batch):
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    pa.default_memory_pool().release_unused()  # workers are used again by other stages


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of the ranks."""
    extra = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    padded[: len(ranks)] = extra
    four = padded.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    raw = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)
    return control.astype(np.uint8).tobytes(), raw[np.arange(4, dtype=np.uint8) <= extra[:, None]].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n ranks."""
    lengths = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    raw = np.zeros((n, 4), np.uint8)
    raw[np.arange(4, dtype=np.uint8) < lengths[:, None]] = np.frombuffer(data, np.uint8)
    return raw.view("<u4").ravel()


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Tokenizes docs and writes the files under path."""
    check_tokenizer(tokenizer_path)
    like, kind = to_arrow_type(docs.schema[id_col].dataType), docs.schema[id_col].dataType.simpleString()
    names = ["part", "seq", "offset", "doc_ids", "lens", "ids"]

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, part, offset, seq = WordTable(tokenizer_path), TaskContext.get().partitionId(), 0, 0
        width = max(table.size, end_id + 1)
        counts, narrow = np.zeros(width, np.int64), np.dtype("<u2" if width <= 65536 else "<u4")
        row = lambda *v: pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(v, [pa.int32(), pa.int64(), pa.int64(), pa.list_(like), pa.list_(pa.int64()), pa.binary()], strict=True)], names=names)
        for block in _slices(batches, BLOCK_BYTES):
            ids, lens = table.encode(block.column(1))
            ids = np.insert(ids.astype(narrow), np.cumsum(lens), narrow.type(end_id))
            counts += np.bincount(ids, minlength=width)
            yield row(part, seq, offset, block.column(0).to_pylist(), (lens + 1).tolist(), ids.tobytes())
            offset, seq = offset + len(ids), seq + 1
        if seq:  # the part's counts, and its size as offset
            yield row(part, -1, offset, None, counts.tolist(), None)

    dealt = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    dealt = dealt.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie", "text").select("id", "text")
    staged = saved(dealt.mapInArrow(tokenize, f"part int, seq long, offset long, doc_ids array<{kind}>, lens array<long>, ids binary"), "ids")

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum((row.values.to_numpy() for batch in batches for row in batch.column(0)), 0)
        if not np.isscalar(total):
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.int64()))], names=["n"])

    counts = staged.filter("seq = -1").select("lens").mapInArrow(add_up, "n array<long>")  # one row for each task
    counts = counts.select(F.posexplode("n").alias("id", "n")).groupBy("id").agg(F.sum("n").alias("n")).filter("n > 0")
    ranked = sorted(((-r["n"], r["id"]) for r in counts.collect()))  # as many rows as the vocabulary has ids
    spark = docs.sparkSession
    spark.createDataFrame([(k, i, -n) for k, (n, i) in enumerate(ranked)], "rank int, id int, count long").coalesce(1).write.parquet(f"{path}/vocabulary")
    rank_of = np.zeros(1 + max((i for _, i in ranked), default=0), "<u4")
    rank_of[[i for _, i in ranked]] = np.arange(len(ranked))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                lens = np.array(batch.column(4)[k].as_py(), np.int64)
                raw = batch.column(5)[k].as_py()
                control, data = pack(rank_of[np.frombuffer(raw, "<u2" if len(raw) == 2 * lens.sum() else "<u4")])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(k, 1) for c in range(5)), pa.array([control], pa.binary()), pa.array([data], pa.binary())], names=[*names[:5], "control", "data"])

    staged.filter("seq >= 0").mapInArrow(encode, f"part int, seq long, offset long, doc_ids array<{kind}>, lens array<long>, control binary, data binary").write.parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (little-endian unsigned 32-bit integers) of every document."""
    stored = spark.read.parquet(f"{path}/blocks")
    last = stored.groupBy("part").agg(F.max(F.col("offset") + F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).collect()
    base, total = {}, 0  # one row for each part
    for r in sorted(last):
        base[r["part"]], total = total, total + r["n"]
    vocabulary = spark.read.parquet(f"{path}/vocabulary").orderBy("rank").collect()
    id_of = np.array([r["id"] for r in vocabulary] or [0], "<u4")
    element = stored.schema["doc_ids"].dataType.elementType
    like = to_arrow_type(element)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                part, _, offset, keys, lens, control, data = (batch.column(c)[k].as_py() for c in range(7))
                ids = id_of[unpack(control, data, sum(lens))].astype("<u4").tobytes()
                ends = np.cumsum(lens)
                starts = ends - lens
                cut = [ids[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(keys, like), pa.array(starts + offset + base[part]), pa.array(lens, pa.int64()), pa.array(cut, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    columns = stored.select("part", "seq", "offset", "doc_ids", "lens", "control", "data")
    return columns.mapInArrow(decode, f"doc_id {element.simpleString()}, start long, n_tokens long, ids binary")
