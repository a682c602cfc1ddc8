"""Sizes of texts in tokens of a public byte-pair vocabulary."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pandas as pd
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from ..tables import fingerprint

#: Folder of the vocabulary files, and the file whose tokens are counted.
FOLDER = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: the pattern that parts a text before the merges of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def _encoding(ranks: bytes) -> tiktoken.Encoding:
    pairs = (line.split() for line in ranks.splitlines() if line)
    return tiktoken.Encoding("counted", pat_str=PATTERN, mergeable_ranks={base64.b64decode(t): int(n) for t, n in pairs}, special_tokens={})


def document_sizes(documents: DataFrame, folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, t1, t2, n_tokens) of every document with a text that is not empty, whole texts counted; t1, t2 are the text's fingerprint.

    Rows stored twice come out once; a null doc_id, a null and an empty text give no row. ``source``
    is as stored. The vocabulary is read here and sent to the tasks, so only this machine needs it.
    """
    ranks = documents.sparkSession.sparkContext.broadcast(Path(folder, vocabulary).read_bytes())

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = _encoding(ranks.value)
        for b in batches:
            sizes = [len(encoding.encode_ordinary(t.encode("utf-8", "replace").decode())) for t in b["text"]]
            yield b.drop(columns="text").assign(n_tokens=sizes)

    rows = documents.where("doc_id is not null and text is not null and text <> ''").select("doc_id", "source", *fingerprint("text", "t"), "text")
    sized = rows.mapInPandas(count, "doc_id long, source string, t1 long, t2 long, n_tokens long")
    return cut_lineage(sized.dropDuplicates(["doc_id"]))
