"""What several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Longest piece of text turned into one numpy array; longer batches are worked off in several such pieces.
CHARS_AT_ONCE = 4_000_000


def arrow_rows(function: Callable[[dict], dict], types: dict[str, pa.DataType]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow body out of a function from columns (lists) to columns (lists)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = function(batch.to_pydict())
                yield pa.RecordBatch.from_arrays([pa.array(out[name], kind) for name, kind in types.items()], names=list(types))

    return run


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the texts in one array, and the offsets at which each text begins (one more than texts)."""
    lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    joined = "".join(texts).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(joined, np.uint32), offsets


def pieces(texts: list[str], most: int = CHARS_AT_ONCE) -> Iterator[list[str]]:
    """The texts in order, in groups of at most `most` characters (a longer single text is a group of its own)."""
    group: list[str] = []
    size = 0
    for text in texts:
        if group and size + len(text) > most:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text)
    if group:
        yield group


def mix64(values: np.ndarray) -> np.ndarray:
    """A fixed bijective scrambling of unsigned 64-bit integers (splitmix64's finaliser)."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def total_of(df: DataFrame, column: str, size: int) -> np.ndarray:
    """The elementwise sum of all of a column's sparse rows (slot, n); at most `size` rows come to the driver."""
    out = np.zeros(size, np.float64)
    for row in df.groupBy("slot").sum(column).toLocalIterator():
        out[row[0]] = row[1]
    return out


def sampled(df: DataFrame, id: str, most: int, total: int) -> DataFrame:
    """About `most` of the `total` rows, those with the smallest hashes of their id, the same ones at every run.

    Each partition gives its own share of them, so what comes to the driver doesn't grow with the partitions. The number is
    binomial: it passes `most` by five standard deviations less than once in a million.
    """
    if total <= most:
        return df
    least = max(1.0, most - 5 * most**0.5)
    return df.filter(F.pmod(F.xxhash64(F.lit(1), id), F.lit(1 << 40)) < int(least / total * (1 << 40)))
