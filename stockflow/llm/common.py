"""Helpers shared by the training-data operators: tables, shared files, vectorised text.

Text is handled as UTF-8 bytes straight out of Arrow buffers, in blocks of whole texts of
about a megabyte, so memory does not depend on how many rows a batch holds.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import hashlib
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BLOCK_BYTES = 1 << 20
SHORT_SPAN = 64  # bytes; a longer span is hashed alone, the others side by side

#: Lower-cases A-Z and nothing else.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
LOWER_TABLE = np.frombuffer(LOWER, np.uint8)

_SHIPPED: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Give the package to the executors' Python, once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="package-")) / "stockflow_package.zip"
    with zipfile.ZipFile(target, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)


def shared_path(spark: SparkSession, purpose: str) -> str:
    """A fresh path in the folder every executor can reach (``spark.checkpoint.dir``).

    Only in local mode, as in tests, is one made up where the session names none: on a cluster
    each executor would write to a disk of its own.
    """
    base = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="stockflow-")
        spark.conf.set(CHECKPOINT_DIR, base)
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def written(df: DataFrame, purpose: str, shuffles_go: bool = False) -> DataFrame:
    """``df`` as a written table: computed once, and read again after a lost executor.

    With ``shuffles_go`` the shuffle files of the write go when it ends; else they stay on the
    executors' disks until the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = shared_path(spark, purpose)
    with _shuffles_going(spark) if shuffles_go else contextlib.nullcontext():
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def _shuffles_going(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLES_GO)
        else:
            spark.conf.set(SHUFFLES_GO, before)


def dropped(df: DataFrame) -> None:
    """Delete a written table that nothing reads any more."""
    spark = df.sparkSession
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        place = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(folder))
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def give_back() -> None:
    """Return freed memory to the system; drop tables of powers that a long text made large."""
    if len(_POWERS.get("up", ())) > BLOCK_BYTES + 1:
        _POWERS.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU library has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def frees(task: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """A task that gives memory back when it ends: its worker lives on through later stages."""

    @functools.wraps(task)
    def run(*args: object, **options: object) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(*args, **options)
        finally:
            give_back()

    return run


def text_key(column: str | Column) -> Column:
    """16 bytes that stand for a text; null and empty are one."""
    digest = F.sha2(F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")), 256)
    return F.unhex(F.substring(digest, 1, 32))


def id_crc(column: str = "doc_id") -> Column:
    """crc32 of the id written as text, a null id as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the offsets of its rows; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat, offsets if len(column) else np.zeros(1, np.int64)


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer text is a block of its own."""
    n, start = len(offsets) - 1, 0
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        end = min(n, max(end, start + 1))
        yield start, end
        start = end


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of each block of a text column."""
    flat, offsets = utf8(column)
    for start, end in blocks(offsets, limit):
        part = offsets[start : end + 1]
        yield start, end, flat[part[0] : part[-1]], part - part[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}
_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**j and base**-j modulo 2**64 for j below n."""
    have = len(_POWERS.get("up", ()))
    if have < n:
        size = max(n, BLOCK_BYTES + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums from which ``neighbour_hashes`` takes the hash of strings of ``data``."""
    return code_sums(_CODES[data])


def code_sums(codes: np.ndarray) -> np.ndarray:
    """The same for strings of units that have hashes of their own, such as words."""
    up, _ = _powers(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * up[: len(codes)], out=sums[1:])
    return sums


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, whatever its place.

    Spans of up to 64 bytes take in eight bytes at a time, by steps that no sum of bytes
    undoes and that keep spans of up to eight bytes apart for certain; longer ones are BLAKE2b.
    """
    sizes = np.asarray(ends - starts, np.int64)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eights = np.lib.stride_tricks.sliding_window_view(padded, 8)
    out = mix(sizes.astype(np.uint64) + np.uint64(_BASE))
    live = np.flatnonzero((sizes > 0) & (sizes <= SHORT_SPAN))
    for done in range(0, SHORT_SPAN, 8):
        live = live[sizes[live] > done]
        if not len(live):
            break
        taken = eights[starts[live] + done].view("<u8").ravel()
        kept = np.minimum(sizes[live] - done, 8).astype(np.uint64)
        taken &= np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * kept)
        out[live] = mix(mix(out[live] ^ taken) + np.uint64(_BASE))
    for i in np.flatnonzero(sizes > SHORT_SPAN).tolist():
        out[i] = strong_hash(data[starts[i] : ends[i]])
    return out


def strong_hash(data: bytes | np.ndarray) -> int:
    """64 bits of BLAKE2b."""
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little")


def neighbour_hashes(sums: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit polynomial hash of the ``width`` bytes from every place on.

    Equal strings have equal hashes. Unequal ones may too (long strings built for it do), so
    these hashes only bring strings together, and never decide that they are equal.
    """
    _, down = _powers(len(sums))
    hashes = sums[width:] - sums[:-width]
    hashes *= down[: len(hashes)]
    hashes += np.uint64(width)
    return mix(hashes)


def word_spans(is_word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of word bytes, which never cross texts, and each text's first word.

    ``firsts`` has one more entry than there are texts: text d has words firsts[d]:firsts[d+1].
    """
    n = len(is_word)
    edge = np.zeros(n + 1, bool)
    edge[offsets[:-1][offsets[:-1] < n]] = True
    before = np.zeros(n, bool)
    before[1:] = is_word[:-1]
    starts = np.flatnonzero(is_word & (~before | edge[:n]))
    after = np.zeros(n, bool)
    after[:-1] = is_word[1:]
    ends = np.flatnonzero(is_word & (~after | edge[1:])) + 1
    if n:
        last = offsets[-1]
        assert not len(ends) or ends[-1] <= last
    return starts, ends, np.searchsorted(starts, offsets)
