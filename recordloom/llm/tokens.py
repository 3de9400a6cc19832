"""Token ids of texts, cut into pieces of bounded length."""

from __future__ import annotations

import base64
import functools
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters on which both readers of the vocabulary were tested to agree; other texts, and those
#: that may hold a special token's string, go to the tokenizers library itself.
_PLAIN = re.compile("[^\x00-\x1b\x20-\x84\x86-ɏ‐-‧]|<\\|")

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, ids array<int>"


@functools.lru_cache(maxsize=2)
def encoder(path: str, ranks: str | None, pattern: str | None):
    """A function from a text to its ids, without special tokens added; one per worker process."""
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    if not ranks:
        return lambda text: slow.encode(text, add_special_tokens=False).ids
    import tiktoken

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return lambda text: slow.encode(text, add_special_tokens=False).ids if _PLAIN.search(text) else fast.encode_ordinary(text)


def token_pieces(docs: DataFrame, tokenizer: str, ranks: str | None = None, pattern: str | None = None, end_id: int = 2, limit: int = 1024, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``limit`` ids of every text, ``end_id`` at its end.

    Only a document of more than ``limit`` ids is cut: into pieces of ``limit``, the first of which takes
    what is over. ``ranks`` names the same vocabulary as a rank file, read by a faster library for
    texts on which the two agree. A null text is empty (one piece, the end id). Null doc_ids stay null.
    Output per piece: doc_id, piece, start, length, ids_crc32 (of the ids as little-endian 32-bit
    integers), ids (null unless ``with_ids``).
    """

    def tasks(batches):
        encode = encoder(tokenizer, ranks, pattern)
        for batch in batches:
            out: dict = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array([*encode(text.as_py() or ""), end_id], "<u4")
                bounds = [0, *range(len(ids) % limit or limit, len(ids) + 1, limit)]
                for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
                    out["doc_id"].append(doc)
                    out["piece"].append(k)
                    out["start"].append(a)
                    out["length"].append(b - a)
                    out["ids_crc32"].append(zlib.crc32(ids[a:b].tobytes()))
                    out["ids"].append(ids[a:b].astype(np.int32) if with_ids else None)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(out.values(), kinds)], names=list(out))

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(tasks, PIECES)
