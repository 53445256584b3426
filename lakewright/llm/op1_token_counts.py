"""Token counts by the whole-token shortcut.

Offline, before any text is read, every vocabulary string is split and merged from
its bytes; those that are one pre-token and end in one token form the shortcut table. A
pre-token in the table counts 1 without merging; only the rest are merged, and
their counts are remembered in a table that is emptied at a fixed size.

Null and empty texts have 0 bytes and 0 tokens. Rows are independent: repeated
rows give repeated results, and an empty table gives an empty result. Further columns
are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .tokens import Codec, codec, default_path, merged

#: Remembered counts of pre-tokens outside the shortcut table (about 40 MB).
REMEMBERED = 200_000


def whole_tokens(vocab: Iterable[bytes], merges: dict[tuple[bytes, bytes], int], split: regex.Pattern) -> dict[str, int]:
    """Vocabulary strings proved to be one pre-token and one token: the split leaves
    them whole, and merging their bytes by rank, with no look at the vocabulary,
    ends in one token. Strings that merges do not reach are left out."""
    out = {}
    for raw in vocab:
        try:
            s = raw.decode("utf-8")
        except UnicodeDecodeError:
            continue
        m = split.match(s)
        if m and m.end() == len(s) and len(merged([raw[i: i + 1] for i in range(len(raw))], merges)) == 1:
            out[s] = 1
    return out


class Counts(dict):
    """Pre-token -> number of tokens."""

    def __init__(self, c: Codec):
        super().__init__(whole_tokens(c.ranks, c.merges, c.split))
        self.codec, self.limit = c, len(self) + REMEMBERED
        self.whole = dict(self)

    def __missing__(self, word: str) -> int:
        n = len(self.codec.unsplit(word))
        if len(self) >= self.limit:
            self.clear()
            self.update(self.whole)
        if len(word) <= 128:
            self[word] = n
        return n

    def of(self, text: str | None) -> int:
        if not text:
            return 0
        find, get = self.codec.split.findall, self.__getitem__
        return sum(1 if sid is not None else sum(map(get, find(part))) for part, sid in self.codec.segments(text))


_counts: dict[str, Counts] = {}


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, n_bytes, n_tokens) of every row of df, in one pass without a shuffle."""
    path = path or default_path()
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _counts:
            _counts[path] = Counts(codec(path))
        of = _counts[path].of
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([of(x.as_py()) for x in b.column(1)], pa.int64())], names=[id_col, "n_bytes", "n_tokens"])

    n_bytes: Column = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long")
    return df.select(F.col(id_col), F.col(text_col), n_bytes.alias("n_bytes")).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts(table(spark, sf_dir, "documents"))
    return out.withColumn("over_limit", F.col("n_tokens") > 1024)
