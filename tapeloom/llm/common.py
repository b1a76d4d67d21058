"""Helpers shared by the training-data operators: table reading, shared stashes, byte-level words."""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a batch handled at once in Python; keeps a worker's memory bounded whatever the session's Arrow batch size.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one where the session names none, which only local mode may do (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = jvm_dir.get() if jvm_dir.isDefined() else None
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        found = _OWN.setdefault("folder", "file://" + tempfile.mkdtemp(prefix="tapeloom-"))
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def stash(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes df as a table in the shared folder and reads it again, so that lost executors cost nothing.

    The shuffle files of the job are no use any more; a collection lets Spark's cleaner drop them now and not at some later
    time, which bounds the disk that a chain of steps takes.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out.stash_path = path
    return out


def unstash(df: DataFrame) -> None:
    """Deletes a stash after its last reader."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.stash_path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Ids that may be broadcast: 8 bytes each, so 16 MB.
BROADCAST_IDS = 2_000_000


def restrict(df: DataFrame, ids: DataFrame, column: str, keep: bool) -> DataFrame:
    """The rows of df whose id is (keep) or isn't among ids, a frame of one column of that name.

    Up to BROADCAST_IDS ids travel to the rows, so that texts aren't shuffled; more are joined by shuffle.
    """
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return df.join(ids, column, "left_semi" if keep else "left_anti")


def checked_broadcast(df: DataFrame, most: int) -> DataFrame:
    """df, a stash of narrow rows, marked for broadcast if it has no more than `most`; else as it is, for a join by shuffle."""
    return F.broadcast(df) if df.count() <= most else df


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES):
    """Cuts a batch into pieces of about so many bytes of text, one row at least."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a string column as one byte array, and the n + 1 offsets of the rows (nulls are empty)."""
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    else:
        column = column.cast(pa.string())
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift, multiply)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_RNG = np.random.default_rng(20240229)
_BYTE_CODE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def inverse_odd(x: int) -> int:
    return pow(x, -1, 1 << 64)


_INV = np.uint64(inverse_odd(int(_BASE)))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0, base ** 1, ...; kept up to the usual size of a slice."""
    known = _POWERS.get(int(base))
    if known is None or len(known) < n:
        known = np.full(max(n, SLICE_BYTES), base, dtype=np.uint64)
        known[0] = 1
        known = np.multiply.accumulate(known)
        if n <= 2 * SLICE_BYTES:
            _POWERS[int(base)] = known
    return known[:n]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def words(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts joined in data, A-Z lower-cased: runs of bytes that gaps doesn't mark, by default [^\\x20\\x09-\\x0D]+.

    Gives each word's 64-bit hash, first byte, end byte, and for each text the index of its first word (n + 1 values).
    Words never cross texts.
    """
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, np.zeros(len(offsets), np.int64)
    gap = gaps[data]
    start = ~gap
    start[1:] &= gap[:-1]
    end = ~gap
    end[:-1] &= gap[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    edge = inner[~gap[inner] & ~gap[inner - 1]]
    start[edge] = True
    end[edge - 1] = True
    first, last = np.flatnonzero(start), np.flatnonzero(end) + 1
    code = _BYTE_CODE[_LOWER[data]]
    code *= powers(_BASE, n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(code, out=total[1:])
    h = _mix((total[last] - total[first]) * powers(_INV, n)[first] + (last - first).astype(np.uint64))
    return h, first, last, np.searchsorted(first, offsets)


def shingles(h: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k-word shingles within each text; a text of fewer words, but not none, gives its whole sequence as one.

    Returns the hashes, repeats included, and the number of the text each belongs to, in no order.
    """
    count = np.diff(bounds)
    owner_of_word = np.repeat(np.arange(len(count)), count)
    n = len(h)
    full = np.zeros(n, np.uint64)
    step = np.uint64(0xA24BAED4963EE407)
    for j in range(k):
        part = np.zeros(n, np.uint64)
        part[: max(n - j, 0)] = h[j:]
        full = full * step + part
    full = _mix(full)
    place = np.arange(n) - np.repeat(bounds[:-1], count)
    keep = place + k <= np.repeat(count, count)
    few = np.flatnonzero((count > 0) & (count < k))
    whole = count[few].astype(np.uint64)
    for j in range(k - 1):
        more = count[few] > j
        whole[more] = whole[more] * step + h[bounds[few[more]] + j]
    return np.concatenate([full[keep], _mix(whole)]), np.concatenate([owner_of_word[keep], few])


def labelled(docs: DataFrame, labels: DataFrame, target: str, mod: int, bound: int) -> DataFrame:
    """(doc_id, text, label) of at most bound labelled rows whose crc32(doc_id as text) mod `mod` isn't 0, in an order by hash.

    Only these rows' labels are ever read. Rows without an id or label are left out; of repeated ids, among the labels as
    among the documents, one is taken (the largest label, the least text), so that no more than `bound` rows come out.
    """
    ok = labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod != 0))
    picked = ok.groupBy("doc_id").agg(F.max(target).cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    found = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # bound rows at most
    joined = found.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "label")
    if found.groupBy("doc_id").count().where("count > 1").isEmpty():
        return joined
    return joined.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))


def held_out(mod: int, rest: int, id_col: str = "doc_id"):
    """Whether crc32(id as text) mod `mod` is rest; false for a row without an id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % mod == rest, F.lit(False))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Weights of a logistic model by Newton's method; the last is the intercept, which isn't penalised."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge * len(x))
    penalty[-1] = 1e-9
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return w
