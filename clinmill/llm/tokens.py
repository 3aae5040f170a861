"""Lengths of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import IntegerType

#: A rank file of byte-level merges (``tiktoken``) or a JSON file of the ``tokenizers`` library; any other may be given.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of the public rank files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def vocabulary(spark: SparkSession, path: str = TOKENIZER):
    """The vocabulary file as a broadcast (of the size of the file, which
    doesn't grow with the data), so that executors need no copy of it."""
    return spark.sparkContext.broadcast(Path(path).read_text(encoding="utf-8"))


def load(text: str):
    """The tokenizer of a vocabulary file's text: a JSON document, else ranks."""
    if text.lstrip().startswith("{"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(text)
        t.encode_special_tokens = True
        t.no_truncation()
        t.no_padding()
        return t
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in text.splitlines() if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def counts(tokenizer, texts: list[str]) -> list[int]:
    if hasattr(tokenizer, "encode_ordinary"):
        return [len(tokenizer.encode_ordinary(t)) for t in texts]
    return [len(e.ids) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def with_token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = TOKENIZER, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, kept columns, jetons) of all rows with a text; whole texts are encoded."""
    vocab = vocabulary(df.sparkSession, path)
    given = df.select(key, *keep, text).where(f"{text} is not null and {key} is not null")
    schema = given.drop(text).schema.add("jetons", IntegerType())
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(vocab.value)
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            n: list[int] = []
            for at in range(0, len(texts), 512):
                n += counts(tokenizer, texts[at : at + 512])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int32())], names=names)

    return given.mapInArrow(run, schema)
