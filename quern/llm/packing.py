"""Concatenate and cut: documents' token ids become one stream, cut into equal windows.

Pass 1 tokenizes each partition once and notes where each document starts within
its partition; pass 2 adds the prefix sum of the partitions' totals, which gives
each document its place in the whole stream, and cuts it at multiples of the
sequence length. Boundary records say which pieces continue a document. Only one
number per partition crosses between partitions, no tokens.

Null texts are empty: such a document is its end token alone. Ties and repeated
rows each get pieces of their own. An empty table gives no rows. Only the id and
text columns are read, so other columns don't matter.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import by_bytes, keep, materialize, scratch, small, text_or_empty

LENGTH = 1024
END = 0
#: The splitting rule of byte-level vocabularies (fixed value).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A run of white space that the fast splitter's stack may not hold; such texts go to the tokenizer itself.
LONG_RUN = re.compile(r"\s{512}")


def byte_ranks(model: dict) -> dict[bytes, int] | None:
    """Ids of a byte-level vocabulary by the bytes of its entries, if they rank the merges; else None."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    of = {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
    ids = model["vocab"]
    singles = sorted(i for x, i in ids.items() if len(x) == 1 and x in of)
    order = [ids.get(m, -1) for m in merged]
    if len(singles) != 256 or singles[-1] > min(order, default=0) or order != sorted(set(order)) or len(ids) < 256 + len(order):
        return None
    return {bytes(of[c] for c in x): i for x, i in ids.items() if (len(x) == 1 or i >= order[0]) and of.keys() >= set(x)}


class WordTokens:
    """Ids of texts, as little-endian bytes of ``dtype``: those of the tokenizer as its file describes it.

    Byte-level vocabularies whose ids rank their merges are also loaded into tiktoken,
    which finds the same ids sooner. Texts that hold an added token (such as an
    end-of-text string) or a very long run of white space go to the tokenizer itself.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        self.fast = self._fast(described)
        added = [re.escape(x["content"]) for x in described.get("added_tokens") or []]
        self.added = re.compile("|".join(added)) if added else None

    @staticmethod
    def _fast(x: dict):
        model, before = x["model"], x.get("pre_tokenizer") or {}
        plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        whole = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True) and not x.get("normalizer")
        simple = not any(t.get(k) for t in x.get("added_tokens") or [] for k in ("single_word", "lstrip", "rstrip", "normalized"))
        ranks = byte_ranks(model) if plain and whole and simple else None
        if ranks is None:
            return None
        import tiktoken

        return tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        if self.fast is None or self.added and self.added.search(text) or LONG_RUN.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype(self.dtype).tobytes()

    def __call__(self, texts: list[str]) -> list[bytes]:
        return [self.encode(t) for t in texts]


def word_tokens(path: str) -> WordTokens:
    """The worker's own, so it is loaded once."""
    return keep(("tokens", path), lambda: WordTokens(path))


def tokenize(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, part, start_in_part, tokens, ids): ids with the end token, as bytes; in the order of the partition."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, at = word_tokens(tokenizer), TaskContext.get().partitionId(), 0
        end = np.array([END], dtype=encode.dtype).tobytes()
        for batch, texts in by_bytes(batches, "text"):
            ids = [x + end for x in encode(texts)]
            n = np.array([len(x) for x in ids], dtype=np.int64) // encode.dtype.itemsize
            start = at + np.cumsum(n) - n
            at += int(n.sum())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.full(len(n), part, dtype=np.int32)), pa.array(start), pa.array(n), pa.array(ids, pa.binary())],
                ["doc_id", "part", "start_in_part", "tokens", "ids"],
            )

    rows = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(F.col(text)).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, part int, start_in_part long, tokens long, ids binary")


def partition_starts(tokens: DataFrame, block: int = 1024) -> DataFrame:
    """(part, base): the tokens in all partitions before this one, summed within blocks of partitions, then over blocks."""
    totals = tokens.groupBy("part").agg(F.max(F.col("start_in_part") + F.col("tokens")).alias("total"))
    totals = totals.withColumn("block", F.expr(f"part div {block}"))
    within = Window.partitionBy("block").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    totals = totals.withColumn("inside", F.sum("total").over(within) - F.col("total"))
    blocks = totals.groupBy("block").agg(F.sum("total").alias("words"))
    over = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    blocks = blocks.withColumn("before", F.sum("words").over(over) - F.col("words"))
    return totals.join(blocks, "block").select("part", (F.col("inside") + F.col("before")).alias("base"))


def cut(tokens: DataFrame, wide: bool, length: int = LENGTH, keep_ids: bool = False) -> DataFrame:
    """Pieces of placed token rows (with ``base``), as :func:`pack` gives them."""
    kind = tokens.schema["doc_id"].dataType.simpleString()
    dtype = np.dtype("<u4" if wide else "<u2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in by_bytes(batches, "ids", 4 << 20):
            place = (batch.column("base").to_numpy() + batch.column("start_in_part").to_numpy()).tolist()
            row, start, size, crc, ids = [], [], [], [], []
            for i, (g, raw) in enumerate(zip(place, texts, strict=True)):
                x = np.frombuffer(raw, dtype).astype("<u4")
                a = 0
                while a < len(x):
                    b = min(len(x), a + length - (g + a) % length)
                    piece = x[a:b].tobytes()
                    row.append(i), start.append(a), size.append(b - a), crc.append(zlib.crc32(piece))
                    if keep_ids:
                        ids.append(x[a:b].tolist())
                    a = b
            r, s, n = np.array(row, dtype=np.int64), np.array(start, dtype=np.int64), np.array(size, dtype=np.int64)
            g = np.array(place, dtype=np.int64)[r] + s
            doc_tokens = batch.column("tokens").to_numpy()[r]
            columns = [batch.column("doc_id").take(pa.array(r)), s, n, np.array(crc, dtype=np.int64), doc_tokens, g // length, g % length, s > 0, s + n < doc_tokens]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "continues", "continued"]
            if keep_ids:
                columns, names = [*columns, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)

    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, continues boolean, continued boolean"
    return tokens.mapInArrow(run, schema + ", ids array<int>" * keep_ids)


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, keep_ids: bool = False) -> DataFrame:
    """A row per piece of a document: where it lies in the document and in which sequence.

    ``continues`` and ``continued`` are the boundary records: the piece begins, or
    ends, within its document. All sequences but the last are full.
    """
    wide = word_tokens(tokenizer).dtype.itemsize > 2
    with scratch():
        # Pieces that carry their ids are as large as the tokens, so these stay instead of being copied.
        tokens = materialize(tokenize(docs, tokenizer), "pack-tokens", stays=keep_ids)
        starts = materialize(partition_starts(tokens), "pack-starts", stays=keep_ids)
        pieces = cut(tokens.join(small(starts, 2_000_000), "part"), wide, length, keep_ids)
        return pieces if keep_ids else materialize(pieces, "pack", stays=True)
