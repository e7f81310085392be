"""Byte-level BPE by a local rank file: encoding in pieces cut at safe boundaries, decoding to raw bytes."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import free_name, whole

MAX_RANK_BYTES = 64 << 20
PIECE = 32_768
RESULT = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"

# A match of the split pattern never holds white space after another character, and never both letters and digits; of a run
# of white space only the last character can join what follows. So text may be cut before white space that follows
# something else, between a letter and a digit, and before the last character of a run of white space.
# The classes are those of the library's regular expressions: Unicode's White_Space, and of letters and digits only ASCII's.
_BLANK = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SAFE = re.compile(rf"(?<=[^{_BLANK}])(?=[{_BLANK}])|(?<=[{_BLANK}])(?=[{_BLANK}][^{_BLANK}])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")


def read_ranks(path: str) -> bytes:
    """The rank file, read once by the driver and broadcast; files over 64 MB are refused."""
    if Path(path).stat().st_size > MAX_RANK_BYTES:
        raise ValueError(f"rank file over {MAX_RANK_BYTES} bytes")
    return Path(path).read_bytes()


@lru_cache(maxsize=4)
def encoding(ranks: bytes, pattern: str):
    import tiktoken

    table = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in ranks.splitlines() if line)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """Cuts a text at the first safe boundary after each ``size`` characters; a match without boundary stays whole."""
    start, n = 0, len(text)
    while n - start > size:
        found = _SAFE.search(text, start + size)
        stop = found.start() if found else n
        yield text[start:stop]
        start = stop
    yield text[start:]


def encode(enc, text: str, size: int = PIECE) -> list[int]:
    """Ids of the whole text, as the library gives them for it."""
    if len(text) <= size:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for piece in pieces(text, size):
        ids.extend(_encode_piece(enc, piece, size))
    return ids


def _encode_piece(enc, piece: str, size: int) -> list[int]:
    """Ids of a piece; runs of white space too long for the pattern's engine are matches of their own and go around it."""
    ids: list[int] = []
    at = 0
    for run in re.finditer(rf"[{_BLANK}]{{{size + 1},}}", piece):
        stop = run.end() if run.end() == len(piece) else run.end() - 1
        ids.extend(enc.encode_ordinary(piece[at:run.start()]))
        ids.extend(enc._encode_single_piece(piece[run.start():stop]))
        at = stop
    ids.extend(enc.encode_ordinary(piece[at:]))
    return ids


def decode(enc, ids: list[int]) -> bytes:
    """The raw bytes of the ids; a single id may be part of a character."""
    return enc.decode_bytes(ids)


def encode_column(spark: SparkSession, ranks_path: str, pattern: str) -> Callable:
    """A column function: text to array of ids. Null gives an empty array."""
    ranks = spark.sparkContext.broadcast(read_ranks(ranks_path))

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        enc = encoding(ranks.value, pattern)
        return pd.Series([encode(enc, t or "") for t in texts])

    return ids


def decode_column(spark: SparkSession, ranks_path: str, pattern: str) -> Callable:
    """A column function: array of ids to bytes. Null gives empty bytes."""
    ranks = spark.sparkContext.broadcast(read_ranks(ranks_path))

    @F.pandas_udf("binary")
    def raw(ids: pd.Series) -> pd.Series:
        enc = encoding(ranks.value, pattern)
        return pd.Series([decode(enc, [] if i is None else [int(x) for x in i]) for i in ids])

    return raw


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Every row with the number of ids of its text, a digest of the ids and one of the bytes they decode to.

    Ids are digested as decimal numbers joined by commas. A null or empty text has no ids. Rows are independent: repeated
    rows give repeated results, and extra columns are dropped.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    @F.pandas_udf(RESULT)
    def digests(texts: pd.Series) -> pd.DataFrame:
        enc = encoding(ranks.value, pattern)
        out = []
        for text in texts:
            ids = encode(enc, text)
            out.append((len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decode(enc, ids)).hexdigest()))
        return pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    got = free_name(docs, "_bpe")
    return docs.select("doc_id", digests(whole()).alias(got)).select("doc_id", F.col(f"{got}.*"))
