"""Packing by power-of-two decomposition.

A document's ids (its text's, then the end id 0) are cut into pieces of `max_length` and then one piece for each binary
digit of what is left, longest first. Each piece is a sequence of its own and its length is a power of two, so no
sequence crosses documents and none needs padding; equal lengths form a bucket to batch from. Nothing is shuffled.

Edge cases: a null or empty text is the end id alone; long texts are read whole; repeated rows are packed one by one,
each in sequences of its own, as sequence ids come from the row and not from doc_id; documents of equal length need no
order among them; an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silvan.llm.common import table

MAX_LENGTH = 1024
END = 0
_END = END.to_bytes(4, "little")
VOCABULARY = "byte_bpe_50k.json"
#: The pieces that byte-level vocabularies of this kind are cut into before merging: a fixed value.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Runs of white space from this length are left to the tokenizer itself.
_LONG_SPACE = re.compile(r"\s{500}")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _bytes_of_characters() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others, in order, as characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def ids_follow_merges(model: dict) -> bool:
    """Whether a merge that comes first makes the smaller id, and no merge makes one below those of single characters."""
    vocab = model["vocab"]
    made = [vocab.get("".join(m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
    single = [i for word, i in vocab.items() if len(word) == 1]
    return None not in made and all(a < b for a, b in zip(made, made[1:])) and (not made or not single or max(single) < made[0])


class Encoder:
    """Ids of whole texts, as the tokenizer gives them.

    Where the ids of a byte-level vocabulary follow the order of its merges, which is checked, a second, faster engine gives
    the same ids; texts that hold a special token or a very long run of white space, which that engine is slow at, go to the
    tokenizer itself, and so do all texts of any other vocabulary. Both ways give the same ids at every length.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok, self.fast = Tokenizer.from_file(path), None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        cut = spec["pre_tokenizer"] or {}
        plain = cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space") and not spec["normalizer"]
        if plain and spec["model"]["type"] == "BPE" and not spec["model"].get("ignore_merges") and ids_follow_merges(spec["model"]):
            import tiktoken

            byte = _bytes_of_characters()
            ranks = {bytes(byte[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in self.special}
            self.fast = tiktoken.Encoding("fast", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, texts: list[str | None], special: bool = True) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text. special: the name of a special token in a text gives its id, else it is ordinary text."""
        for text in texts:
            if not text:
                yield b""
            elif self.fast is None or special and any(t in text for t in self.special) or _LONG_SPACE.search(text):
                self.tok.encode_special_tokens = not special
                ids = self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids
                self.tok.encode_special_tokens = False
                yield np.asarray(ids, "<u4").tobytes()
            else:
                yield self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()


_held: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker and vocabulary."""
    if path not in _held:
        _held[path] = Encoder(path)
    return _held[path]


def cuts(n: int, longest: int = MAX_LENGTH) -> list[int]:
    """Lengths of the pieces of n ids: whole ones, then the binary digits of the rest."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest length must be a power of two")
    rest = n % longest
    return [longest] * (n // longest) + [1 << k for k in reversed(range(rest.bit_length())) if rest >> k & 1]


def pack_documents(docs: DataFrame, vocabulary: str | None = None, max_length: int = MAX_LENGTH) -> DataFrame:
    """One row per piece: doc_id, start, length (its bucket), ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""
    path = vocabulary or vocabulary_path()
    cuts(1, max_length)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            rows, ids, start, length, total = [], [], [], [], []
            for i, raw in enumerate(encode(batch.column("text").to_pylist())):
                raw += _END
                at, n_ids = 0, len(raw) // 4
                for n in cuts(n_ids, max_length):
                    rows.append(i)
                    ids.append(raw[4 * at : 4 * (at + n)])
                    start.append(at)
                    length.append(n)
                    total.append(n_ids)
                    at += n
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(rows, pa.int32())), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary()), pa.array(total, pa.int64())],
                ["doc_id", "start", "length", "ids", "doc_tokens"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(pack, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long")
    # One row for each sequence; a partition's rows keep their order when a task runs again.
    return out.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))


def batches_of(packed: DataFrame, length: int) -> DataFrame:
    """The sequences of one bucket; numpy.frombuffer(ids, "<u4") gives a sequence's ids."""
    return packed.filter(F.col("length") == length).select("sequence_id", "doc_id", "start", "ids")


def op5_packing(spark, sf_dir):
    packed = pack_documents(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES = {"op5_packing": op5_packing}
SQL: dict[str, str] = {}
