"""Operator 9: byte-pair encoding and decoding of whole documents.

Method: a backtracking encoder over Aho-Corasick token matches with a table of pairs that may stand side by side (see
wordbpe); decoding copies the pieces from one buffer by a table of offsets. One narrow pass over the documents, no shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm import common, wordbpe

#: The real outputs that a caller may keep beside the digests.
OUTPUTS = {"ids": ("array<int>", pa.list_(pa.int32())), "decoded": ("string", pa.string())}


def bpe_round_trip(docs: DataFrame, path: str, keep: tuple[str, ...] = ("ids", "decoded"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every whole text with the vocabulary file at path and decodes the ids again.

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256 and the outputs named in keep, one row for each row of docs. A
    null text counts as empty: no ids, an empty decoded text. Repeated rows and null ids stay as they are; other columns
    of docs are left out, so their names can't clash. Texts are taken some 256 kB at a time, a longer one alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = wordbpe.load(path)
        for batch in batches:
            for part in common.slices(batch, 1, 1 << 18):
                each = bpe.encode_all([text or "" for text in part.column(1).to_pylist()])
                ids, n = np.concatenate(each), np.array([len(x) for x in each])
                ends = np.cumsum(n)
                decoded = bpe.pieces.joined(ids, ends)
                kept = {"ids": lambda: common.lists(ids, ends, pa.int32()), "decoded": lambda: pa.array([bytes(x) for x in decoded], pa.binary()).cast(pa.string())}  # noqa: B023
                digests = [pa.array([hashlib.sha256(x).hexdigest() for x in texts]) for texts in (bpe.decimals.joined(ids, ends), decoded)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), *digests, *(kept[k]() for k in keep)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *keep])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = ", ".join([f"doc_id {kind}", "n_tokens long", "ids_sha256 string", "decoded_sha256 string", *(f"{k} {OUTPUTS[k][0]}" for k in keep)])
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
