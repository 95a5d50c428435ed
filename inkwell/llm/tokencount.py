"""Token counts by the whole-token shortcut.

Before the job, ``bpe.prove`` encodes every vocabulary string alone and keeps those that give one
token. A pre-token is merged on its own, so a pre-token equal to such a string is one token wherever
it stands and is counted directly; only the rest goes through the merges (a task remembers a bounded
number of short ones). Strings of added tokens count as one token each, as in the library.

Row by row in the scan's splits: no shuffle, and nothing but the tokenizer file and the proof
(about 2 MB at any input size) is sent to tasks. Long texts are read in blocks. Null and empty texts
have no bytes and no tokens; repeated rows get the same counts each; an empty table gives an empty
result. Rows with a null id keep it. Columns other than id and text are not read."""

from __future__ import annotations

from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import bpe
from inkwell.llm.common import table

TOKENIZER = "byte_bpe_50k.json"
#: Tokens over which a text is reported as too long.
LIMIT = 512


def counter(proof: bpe.Proof):
    """A function from a text to its number of tokens."""
    pieces = bpe.Pieces(proof)
    size = bpe.Remembered(dict.fromkeys(proof.whole, 1), lambda piece: len(pieces.merge(piece))).__getitem__

    def count(text: str) -> int:
        return sum(1 if added else sum(map(size, pieces.split(part))) for part, added in pieces.stretches(text))

    return count


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = LIMIT) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row, with the byte-level BPE file at ``path``."""
    proof = bpe.prove(path)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(proof)
        for batch in batches:
            tokens = [count(x.as_py()) if x.is_valid else 0 for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(tokens, pa.int64())],
                                             names=["id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"),
                       F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col))
    return rows.mapInArrow(task, "id long, n_bytes long, n_tokens long").withColumn(
        "over_limit", F.col("n_tokens") > limit)


def op12_whole_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER)).withColumnRenamed(
        "id", "doc_id")
