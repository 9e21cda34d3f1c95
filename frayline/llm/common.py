"""Small helpers shared by the training-data operators: shared storage, word hashes, byte classes."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from frayline.session import checkpoint_dir


def shared_folder(spark: SparkSession) -> str:
    """A new folder name below ``spark.checkpoint.dir``, which driver and executors share.

    Where that is unset, a local session (tests) gets a temporary folder; a cluster gets an error.
    """
    root = checkpoint_dir(spark)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='frayline-')}"
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/frayline-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared folder and read back: cuts lineage, survives lost executors.

    The files stay until the folder's owner clears it, like those of ``checkpoint()``.
    """
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """``name`` with underscores before it until no column of ``df`` has it, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    name = f"__{name}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def sampled(share: float, *columns: str) -> Column:
    """True for about ``share`` of all values of ``columns``: a hash of 62 bits, so no share above 0 becomes none."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 2) < F.lit(int(share * 2**62)).cast("long")


ARROW_ROWS = 1000


def batched(df: DataFrame) -> DataFrame:
    """``df``, after seeing to it that Python workers get batches of at most ``ARROW_ROWS`` rows in this session.

    Texts are long, and every running task holds a few batches in the JVM and in its worker. Spark's own bound in bytes
    (``maxBytesPerBatch``) still cuts batches of very long texts shorter.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= ARROW_ROWS:
        conf.set(key, str(ARROW_ROWS))
    return df


# which bytes of UTF-8 text make words: all but ASCII white space (space, 9 to 13), or ASCII letters and digits and all
# bytes of other characters
UNSPACED = np.ones(256, dtype=bool)
UNSPACED[[32, *range(9, 14)]] = False
ALPHANUMERIC = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD1B54A32D192ED03)


def mixed(h: np.ndarray) -> np.ndarray:
    """Bit mixer for 64-bit values (a bijection)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Powers:
    """Powers of an odd base modulo 2**64, grown to the longest word seen."""

    def __init__(self) -> None:
        self._table = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if n > len(self._table):
            size = max(n, 2 * len(self._table), 64)
            with np.errstate(over="ignore"):
                self._table = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _BASE)]), dtype=np.uint64)
        return self._table


_POWERS = Powers()


def word_bounds(data: np.ndarray, letters: np.ndarray = UNSPACED) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the words of UTF-8 ``data``: the longest runs of ``letters``."""
    inside = np.empty(len(data) + 2, dtype=bool)
    inside[0] = inside[-1] = False
    inside[1:-1] = letters[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every word: a polynomial over its bytes, then mixed."""
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    sizes = ends - starts
    place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    letters = data[np.repeat(starts, sizes) + place].astype(np.uint64) + np.uint64(1)
    powers = _POWERS.upto(int(sizes.max()))
    sums = np.add.reduceat(letters * powers[place], np.cumsum(sizes) - sizes)
    return mixed(sums + sizes.astype(np.uint64) * _STEP)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` consecutive words (none if there are fewer)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    h = words[:n].copy()
    for j in range(1, size):
        h *= _STEP
        h += words[j : n + j]
    return mixed(h)
