"""Token counts: batch encoding in an Arrow function that returns lengths only.

Texts are taken in batches of about equal bytes and cut at safe boundaries, so that a text's length is the sum
over its parts.  For tokenizers that drop white space and split words, numbers and marks apart, as ``RULES`` has
it, ASCII white space is such a boundary; parts of over ``LONG`` characters are cut further beside ASCII digits,
which are tokens of their own, and between a mark that composes with nothing and a letter.  What is left is one
word of the tokenizer, however long, or a run of marks.  A batch encodes its distinct parts once, whatever
their number of occurrences; parts seen in earlier batches come from a cache of bounded size, and no part of
the sum is ever estimated.  Tokenizers of other rules, and SentencePiece models, get whole texts.

A null text is empty and has no token.  Rows are independent of one another: repeated rows repeat their count,
an empty table gives an empty one, and further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from densika.llm.wordbytes import pieces, tidy

CACHED = 400_000  # parts of up to 40 bytes kept by a worker
BYTES = 4 << 20
LONG = 4096
#: Normaliser and splitting of the tokenizers for which the boundaries hold.
RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
WHITE = r"[\x20\x09-\x0D]"
#: Special strings hold neither digits nor these marks.
BETWEEN = re.compile(r"(?<=[0-9])(?=[^\W_])|(?<=[^\W_])(?=[0-9])|(?<=[.,;:!?\u3001\u3002\uff0c\uff01\uff1a\uff1b\uff1f])(?=[^\W_])")


class Lengths:
    """Numbers of tokens of texts, with a worker's cache."""

    def __init__(self, path: str):
        self.cache: dict[str, int] = {}
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.parts_add_up, self._encode = False, lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
            return
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(path)
        made.no_truncation()
        made.no_padding()
        told = json.loads(made.to_str())
        marks = [t["content"] for t in told["added_tokens"]]
        apart = not any(re.search(WHITE, m) or BETWEEN.search(m) for m in marks) and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in told["added_tokens"])
        self.parts_add_up = apart and not told["post_processor"] and all(told[k] == v for k, v in RULES.items())
        self._encode = lambda texts: [len(x.ids) for x in made.encode_batch_fast(texts, add_special_tokens=False)]

    def of_whole(self, texts: list[str]) -> np.ndarray:
        return np.array([n for lo in range(0, len(texts), 200) for n in self._encode(texts[lo : lo + 200])], np.int64)

    def of_parts(self, parts: list[str]) -> np.ndarray:
        """Of parts without white space."""
        cache = self.cache
        out = np.fromiter((cache.get(p, -1) for p in parts), np.int64, len(parts))
        new = np.flatnonzero(out < 0)
        pieces_ = [[parts[i]] if len(parts[i]) <= LONG else BETWEEN.split(parts[i]) for i in new]
        flat = [x for some in pieces_ for x in some]
        sums = np.zeros(len(flat) + 1, np.int64)
        np.cumsum([n for lo in range(0, len(flat), 20_000) for n in self._encode(flat[lo : lo + 20_000])], out=sums[1:])
        out[new] = np.diff(sums[np.cumsum([0] + [len(x) for x in pieces_])])
        if len(cache) + len(new) > CACHED:
            cache.clear()
        cache.update((parts[i], int(out[i])) for i in new[:CACHED] if len(parts[i]) <= 40)
        return out


_state: dict[str, Lengths] = {}
_SPACED = np.arange(256, dtype=np.uint8)
_SPACED[9:14] = 32


def _spaced(texts: pa.Array) -> pa.Array:
    """Texts without nulls, with a space for each character of ASCII white space: one look-up a byte."""
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    chars = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(at - at[0]), pa.py_buffer(_SPACED[chars]))


def token_counts(texts: pa.Array, path: str) -> np.ndarray:
    if path not in _state:
        _state[path] = Lengths(path)
    lengths = _state[path]
    texts = pc.fill_null(texts, "")
    if not lengths.parts_add_up:
        return lengths.of_whole(texts.to_pylist())
    split = pc.split_pattern(_spaced(texts), " ")
    if isinstance(split, pa.ChunkedArray):
        split = split.combine_chunks()
    offsets = np.asarray(split.offsets)
    coded = split.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    known = lengths.of_parts(coded.dictionary.to_pylist())
    sums = np.zeros(len(coded) + 1, np.int64)
    np.cumsum(known[np.asarray(coded.indices)], out=sums[1:])
    return np.diff(sums[offsets - offsets[0]])


def count_tokens(docs: DataFrame, path: str, bytes_per_batch: int = BYTES) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of every row; ``path`` names the tokenizer's file on every executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", bytes_per_batch):
            text = batch.column("text")
            size = pc.fill_null(pc.binary_length(text), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), size, pa.array(token_counts(text, path))], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, n_bytes long, n_tokens long")


def op7(docs: DataFrame, path: str | None = None, limit: int = 2048) -> DataFrame:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return count_tokens(docs, path).withColumn("over_limit", F.col("n_tokens") > limit)
