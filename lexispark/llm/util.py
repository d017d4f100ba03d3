"""Helpers that the operators share: text batches as arrays, ragged arrays, the shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that one numpy step works on, unless a single text is longer.
STEP_CHARS = 1 << 19


def scratch(spark: SparkSession) -> str:
    """The folder of this application's tables, below the one that spark.checkpoint.dir names.

    Where that is unset, a temporary folder is set on a single machine; a cluster without a shared folder is an error."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lexispark-")
        sc.setCheckpointDir(base)
    if base.startswith("/"):
        base = "file://" + base
    return f"{base.rstrip('/')}/lexispark-{sc.applicationId}"


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder's address below scratch()."""
    return f"{scratch(spark)}/{what}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, whatever file system it lies on; none is no error."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Deletes all tables that the operators have written for this application, once their results are no longer read."""
    remove(spark, scratch(spark))


def stored(df: DataFrame, what: str) -> DataFrame:
    """df written once to the shared folder and reread: its lineage ends there and executors may be lost."""
    return stored_at(df, what)[0]


def stored_at(df: DataFrame, what: str) -> tuple[DataFrame, str]:
    """stored(), and the folder, for who can tell when it is no longer read."""
    path = shared_dir(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under the operator's own names; whatever else df has cannot clash."""
    return df.select(*[F.col(f"`{v}`").alias(k) for k, v in columns.items()])


def free(df: DataFrame, name: str) -> str:
    """name, or name with as many underscores as no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def steps(texts: list[str | None] | list[int | None], most: int = STEP_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts (or their lengths) that hold about the same number of characters, at most `most` unless one text is longer."""
    start, n = 0, 0
    for i, t in enumerate(texts):
        k = (t if isinstance(t, int) else len(t)) if t else 0
        if n and n + k > most:
            yield start, i
            start, n = i, 0
        n += k
    if start < len(texts):
        yield start, len(texts)


def codes(texts: list[str], between: str = "\0") -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each followed by `between`, and where each text starts (one entry more than texts)."""
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter((len(t) for t in texts), np.int64, len(texts)) + len(between), out=starts[1:])
    joined = between.join([*texts, ""])
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4"), starts


_WORD = np.fromiter(map(str.isalnum, map(chr, range(0x110000))), bool, 0x110000)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> np.ndarray:
    """Powers of an odd constant modulo 2**64."""
    out = np.empty(max(n, 1), np.uint64)
    out[0] = 1
    if n > 1:
        out[1:] = _ODD
        np.multiply.accumulate(out, out=out)
    return out


_POWERS = powers(4096)


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of letters and digits of the lower-cased texts.

    Returns the code points, each word's start and end in them, its 64-bit hash and the number of its text. Beside
    these it takes a few bytes a character: letters are hashed STEP_CHARS at a time, in long words too."""
    cp, starts = codes([t.lower() for t in texts])
    inside = _WORD[cp]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    a, b = edge[0::2], edge[1::2]
    if not len(a):
        e = np.zeros(0, np.int64)
        return cp, e, e, np.zeros(0, np.uint64), e
    h = np.zeros(len(a), np.uint64)
    for low in range(0, len(cp), STEP_CHARS):
        high = min(low + STEP_CHARS, len(cp))
        u, v = np.searchsorted(b, low, "right"), np.searchsorted(a, high, "left")  # words that reach into this range
        if u == v:
            continue
        first, last = np.maximum(a[u:v], low), np.minimum(b[u:v], high)
        size = last - first
        at = ragged(first, size)
        place = at - np.repeat(a[u:v], size)
        value = (cp[at].astype(np.uint64) + np.uint64(1)) * _POWERS[place & 4095]
        far = np.flatnonzero(place > 4095)
        value[far] *= mix(place[far] >> 12) | np.uint64(1)
        h[u:v] += np.add.reduceat(value, np.cumsum(size) - size)
    return cp, a, b, mix(h), np.searchsorted(starts, a, "right") - 1


def ragged(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All indices first[i] .. first[i]+size[i]-1, one range after another."""
    total = int(size.sum())
    ends = np.cumsum(size)
    return np.arange(total) - np.repeat(ends - size, size) + np.repeat(first, size)


def runs(key: np.ndarray) -> np.ndarray:
    """Where each run of equal numbers starts, and the end."""
    return np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])) if len(key) else np.zeros(1, np.int64)


def sums(values: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sum of each of the consecutive runs whose lengths are in size; 0 for an empty run."""
    out = np.zeros((len(size), *values.shape[1:]), values.dtype)
    full = size > 0
    if full.any():
        first = np.cumsum(size) - size
        out[full] = np.add.reduceat(values, first[full], axis=0)
    return out


def streamed(batches: Iterator[pa.RecordBatch], least: int, most: int) -> Iterator[tuple[pa.Table, bool]]:
    """Rows sorted by their first column, `least` or more at a time, each key's together; and whether they are the rows of one key that has over
    `most` of them, which come as they are read."""
    held: list[pa.RecordBatch] = []
    n, hot = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        if hot is not None:
            same = int(np.searchsorted(key, hot, "right"))
            if same:
                yield pa.Table.from_batches([batch.slice(0, same)]), True
            if same == len(key):
                continue
            batch, key, hot = batch.slice(same), key[same:], None
        held.append(batch)
        n += len(key)
        if n < least:
            continue
        whole = pa.Table.from_batches(held).combine_chunks()
        key = whole.column(0).to_numpy()
        last = int(np.searchsorted(key, key[-1], "left"))
        if last:
            yield whole.slice(0, last), False
        rest = whole.slice(last)
        held, n = rest.to_batches(), len(rest)
        if n > most:
            yield rest, True
            held, n, hot = [], 0, key[-1]
    if held:
        yield pa.Table.from_batches(held).combine_chunks(), False


def compared(fanned: DataFrame, compare: Callable[[pa.Table], pa.Table], schema: str, least: int = 1 << 17, most: int = 1 << 18) -> DataFrame:
    """What compare() makes of the rows of each key, in a table in the shared folder.

    fanned has key (a long) first and node last, both without nulls. A task sorts its rows by them and hands on `least` of them or more at a
    time, whole keys together, so it holds no more than `most` rows of one key. Rows of a key that has more are written as they come;
    they are then spread over blocks of most / 2, and compare() gets every two blocks, so that all rows of the key meet, in
    tasks of bounded size."""
    types = {f.name: f.dataType.simpleString() for f in fanned.schema}
    names = schema_names(schema)
    hot_names = [f"hot_{c}" for c in fanned.columns]

    def run(batches: Iterator[pa.RecordBatch], limit: int = most) -> Iterator[pa.RecordBatch]:
        kinds = None
        for part, hot in streamed(batches, least, limit):
            kinds = kinds or {f"hot_{c}": part.schema.field(c).type for c in part.schema.names}
            if hot:
                out = pa.Table.from_arrays(part.columns, names=hot_names)
                for c, t in zip(names, compare(part.slice(0, 0)).schema.types if len(part) else ()):
                    out = out.append_column(c, pa.nulls(len(part), t))
                out = out.select([*names, *hot_names])
            else:
                out = compare(part)
                for c in hot_names:
                    out = out.append_column(c, pa.nulls(len(out), kinds[c]))
            yield from out.to_batches(1 << 16)

    wide = schema + "".join(f", hot_{c} {t}" for c, t in types.items())
    found = stored(fanned.repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, wide), "compared")
    hot = found.where("hot_key is not null").select(*[F.col(f"hot_{c}").alias(c) for c in fanned.columns])
    blocks = hot.groupBy("key").agg(F.ceil(F.count("*") * 2 / most).cast("int").alias("n")).withColumnRenamed("key", "of_key")
    if blocks.isEmpty():
        return found.select(*names)
    placed = hot.join(F.broadcast(blocks) if blocks.count() < 1 << 16 else blocks, F.col("key") == F.col("of_key")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))
    pairs = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    again = pairs.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), *[c for c in fanned.columns if c != "key"])
    whole = stored(again.repartition("key").sortWithinPartitions("key", "node").mapInArrow(lambda b: run(b, 1 << 40), wide), "compared")
    return found.where("hot_key is null").select(*names).unionByName(whole.select(*names))


def schema_names(schema: str) -> list[str]:
    """Names of a schema that is a list of plain columns."""
    return [c.split()[0] for c in schema.split(",")]
