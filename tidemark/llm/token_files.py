"""Token ids in raw binary shards with a minimal perfect hash index from document key to place.

Layout below one folder, written and read by Spark only, so that it may be in any store:

* ``data/kind=ids/shard=S/*``: ids of the shard's documents in ascending key order, little-endian unsigned 16-bit, from
  byte 0 on; then a footer (number of ids of each document, u32; number of documents, u64) and a final newline.
* ``data/kind=keys/shard=S/*``: keys of the shard's documents (i64), a null flag for each (u8), and a final newline.
* ``index/bucket=B/*``: one minimal perfect hash function: number of keys (u32), number of groups (u32), a seed for
  each group (u32), then for each slot fingerprint (u64), shard, document number in the shard, copies of the key,
  number of ids of the first copy (u32 each), its first id in the shard and in the corpus (u64 each); and a newline.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.anchors import mix
from tidemark.llm.bpe import gathered, of_texts, units_of, words_of
from tidemark.llm.common import range_bounds, release_memory, slices
from tidemark.session import fresh_path

END = 0
_PER_BUCKET = 4096  # keys of one hash function, on average
_PER_GROUP = 4
_SLOT = np.dtype([("print", "<u8"), ("shard", "<u4"), ("place", "<u4"), ("copies", "<u4"), ("n", "<u4"), ("first", "<u8"), ("start", "<u8")])
_NULL = -(1 << 63)
_AT_ONCE = 2 << 20  # bytes of text encoded together


@dataclass(frozen=True)
class TokenStore:
    spark: SparkSession
    path: str
    n_buckets: int


def _hash(key: np.ndarray, seed) -> np.ndarray:
    return mix(key.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * (np.asarray(seed, np.uint64) + np.uint64(1)))


_BUCKET, _GROUP, _PRINT, _PLACE = 1, 2, 3, 16  # seeds


def build_hash(keys: np.ndarray) -> np.ndarray:
    """Seeds of a minimal perfect hash function of distinct ``keys``: hash and displace, largest groups first."""
    n = len(keys)
    n_groups = -(-n // _PER_GROUP)
    group = (_hash(keys, _GROUP) % np.uint64(n_groups)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    first = np.searchsorted(group[order], np.arange(n_groups + 1))
    seeds, taken = np.zeros(n_groups, np.uint32), np.zeros(n, bool)
    for g in np.argsort(-np.diff(first), kind="stable"):
        own = keys[order[first[g] : first[g + 1]]]
        if not len(own):
            break
        seed, step = 0, 64
        while True:  # many seeds at a time; each places the whole group or none of it
            tried = np.arange(seed, seed + step)
            slot = (_hash(own[:, None], tried[None, :] + _PLACE) % np.uint64(n)).astype(np.int64)
            free = ~taken[slot].any(axis=0)
            if len(own) > 1:
                ordered = np.sort(slot, axis=0)
                free &= (ordered[1:] != ordered[:-1]).all(axis=0)
            if free.any():
                at = int(np.argmax(free))
                seeds[g] = seed + at
                taken[slot[:, at]] = True
                break
            seed += step
            step = min(step * 2, 4096)
    return seeds


def slots(keys: np.ndarray, seeds: np.ndarray, n: int) -> np.ndarray:
    group = (_hash(keys, _GROUP) % np.uint64(len(seeds))).astype(np.int64)
    return (_hash(keys, seeds[group].astype(np.uint64) + np.uint64(_PLACE)) % np.uint64(n)).astype(np.int64)


def _write(df: DataFrame, part: str, path: str) -> None:
    df.select(part, F.col("body").cast("string").alias("value")).write.partitionBy(part).text(path)


def write_tokens(docs: DataFrame, spec: str, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = 8 << 20, path: str | None = None) -> TokenStore:
    """Encode whole texts (null: empty), append id 0 to each, and write shards and index; ``spec``: see ``bpe``.

    Shards are ranges of the key, in ascending order, of about ``shard_bytes``; rows that repeat a key are all
    kept, next to each other, ordered by their ids; a row without key is kept too, before all others. Each
    word is encoded once per task by the tokenizers library; ids travel to their shard once.
    """
    spark = docs.sparkSession
    path = path or fresh_path(spark, "tokens")
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL)).alias("key"), F.col(id_col).isNull().alias("none"), F.col(text_col).alias("text"))
    cuts = np.array(range_bounds(rows.select("key", F.octet_length("text").alias("w")), "key", "w", shard_bytes), np.int64)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(spec)
        for batch in batches:
            for at, to in slices(batch.column(2), _AT_ONCE):
                part = batch.slice(at, to - at)
                units, place, first = units_of(part.column(2))
                seen, word, unit_words = words.distinct(units)
                ids = [words.encode_u2(w) for w in seen]
                length = np.fromiter(map(len, ids), np.int64, len(ids)) // 2
                flat = np.frombuffer(b"".join(ids), "<u2")
                del units, seen, ids
                flat, ends = gathered(flat, (np.cumsum(length) - length)[word], length[word])
                n_ids = np.diff(np.concatenate([[0], ends])[np.concatenate([[0], unit_words])])
                flat, border = of_texts(place, first, (flat, n_ids))
                # the end id after each text's ids
                flat = np.insert(flat, border[1:], END)
                border = (border + np.arange(len(border))) * 2
                bodies = pa.Array.from_buffers(pa.binary(), len(border) - 1, [None, pa.py_buffer(border.astype(np.int32)), pa.py_buffer(flat.astype("<u2"))])
                shard = np.searchsorted(cuts, np.asarray(part.column(0)), "right")
                yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), part.column(0), part.column(1), bodies], names=["shard", "key", "none", "ids"])
                release_memory()

    def shape(group: pa.Table) -> pa.Table:
        group = group.sort_by([("none", "descending"), ("key", "ascending"), ("ids", "ascending")])
        bodies = group.column("ids").to_pylist()
        lengths = np.array([len(b) // 2 for b in bodies], "<u4")
        payload = b"".join([*bodies, lengths.tobytes(), np.array([len(bodies)], "<u8").tobytes()])
        keys = np.asarray(group.column("key")).astype("<i8").tobytes() + np.asarray(group.column("none")).astype("u1").tobytes()
        release_memory()
        return pa.table({"shard": [group.column("shard")[0].as_py()] * 2, "kind": ["ids", "keys"], "body": pa.array([payload, keys], pa.binary())})

    if len(words_of(spec).pieces()) > 1 << 16:
        raise ValueError("ids are stored in 16 bits")
    encoded = rows.mapInArrow(encode, "shard long, key long, none boolean, ids binary")
    shaped = encoded.groupBy("shard").applyInArrow(shape, "shard long, kind string, body binary")
    shaped.select("kind", "shard", F.col("body").cast("string").alias("value")).write.partitionBy("kind", "shard").text(f"{path}/data")
    for kind in ("ids", "keys"):  # the folders are there even if the input was empty
        spark.createDataFrame([], "value string").write.mode("append").text(f"{path}/data/kind={kind}")
    store = TokenStore(spark, path, 0)
    return _write_index(store)


def _shards(store: TokenStore, kind: str) -> DataFrame:
    files = store.spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(f"{store.path}/data/kind={kind}")
    shard = F.regexp_extract("path", r"/shard=(\d+)/", 1)
    return files.filter("length > 0").filter(shard != "").select(shard.cast("long").alias("shard"), "content")


def _footer(content: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a shard file, and the number of ids of each of its documents."""
    n = int(np.frombuffer(content, "<u8", 1, len(content) - 9)[0])
    lengths = np.frombuffer(content, "<u4", n, len(content) - 9 - 4 * n)
    return np.frombuffer(content, "<u2", int(lengths.sum())), lengths


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for shard, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids, lengths = _footer(content.as_py())
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64()), "n": pa.array([len(ids)], pa.int64()), "docs": pa.array([len(lengths)], pa.int64()), "lengths": pa.array([lengths.tobytes()], pa.binary())})


def _write_index(store: TokenStore) -> TokenStore:
    """Hash functions over the keys of the written shards; one task per bucket of about 4,096 keys."""
    spark = store.spark
    counts = _shards(store, "ids").mapInArrow(_counts, "shard long, n long, docs long, lengths binary")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    starts = counts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    total = counts.agg(F.sum("docs").alias("n")).first()["n"] or 0
    n_buckets = max(-(-total // _PER_BUCKET), 1)

    def entries(left: pa.Table, right: pa.Table) -> pa.Table:
        content = right.column("content")[0].as_py()
        n = left.column("docs")[0].as_py()
        keys = np.frombuffer(content, "<i8", n)
        lengths = np.frombuffer(left.column("lengths")[0].as_py(), "<u4").astype(np.int64)
        first = np.cumsum(lengths) - lengths
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        at = np.flatnonzero(new)
        bucket = (_hash(keys[at], _BUCKET) % np.uint64(n_buckets)).astype(np.int64)
        shard, start = left.column("shard")[0].as_py(), left.column("start")[0].as_py()
        return pa.table({"bucket": bucket, "key": keys[at], "shard": np.full(len(at), shard, np.int64), "place": at, "copies": np.diff(at, append=n), "first": first[at], "n": lengths[at], "start": start + first[at]})

    def hashed(group: pa.Table) -> pa.Table:
        keys = np.asarray(group.column("key"))
        seeds = build_hash(keys)
        slot = np.zeros(len(keys), _SLOT)
        at = slots(keys, seeds, len(keys))
        slot["print"][at] = _hash(keys, _PRINT)
        for name in ("shard", "place", "copies", "n", "first", "start"):
            slot[name][at] = np.asarray(group.column(name))
        body = np.array([len(keys), len(seeds)], "<u4").tobytes() + seeds.astype("<u4").tobytes() + slot.tobytes()
        return pa.table({"bucket": [group.column("bucket")[0].as_py()], "body": pa.array([body], pa.binary())})

    found = starts.groupBy("shard").cogroup(_shards(store, "keys").groupBy("shard")).applyInArrow(entries, "bucket long, key long, shard long, place long, copies long, first long, n long, start long")
    _write(found.groupBy("bucket").applyInArrow(hashed, "bucket long, body binary"), "bucket", f"{store.path}/index")
    spark.createDataFrame([], "value string").write.mode("append").text(f"{store.path}/index")
    return TokenStore(spark, store.path, n_buckets)


def lookup(store: TokenStore, keys: DataFrame) -> DataFrame:
    """Place of each key of ``keys`` (its first column) that is in the store: key, shard, place, copies, n, first, start.

    A key costs one hash for the bucket, one for the group, one for the slot, and one fingerprint comparison;
    a key that is not in the store fails the comparison but for one case in 2^64. Keys are asked once however
    often they are repeated. ``place``: documents before it in its shard; ``first`` and
    ``start``: ids before it in its shard and in the corpus; ``n``: its ids.
    """
    asked = keys.select(F.coalesce(F.col(keys.columns[0]).cast("long"), F.lit(_NULL)).alias("key")).distinct()
    n_buckets = store.n_buckets

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = np.asarray(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array((_hash(key, _BUCKET) % np.uint64(n_buckets)).astype(np.int64)), batch.column(0)], names=["bucket", "key"])

    def find(left: pa.Table, right: pa.Table) -> pa.Table:
        if not right.num_rows or not left.num_rows:
            return _FOUND.empty_table()
        body = right.column("content")[0].as_py()
        n, n_groups = np.frombuffer(body, "<u4", 2).tolist()
        seeds = np.frombuffer(body, "<u4", n_groups, 8)
        slot = np.frombuffer(body, _SLOT, n, 8 + 4 * n_groups)
        key = np.asarray(left.column("key"))
        got = slot[slots(key, seeds, n)]
        hit = got["print"] == _hash(key, _PRINT)
        return pa.table([pa.array(key[hit]), *(pa.array(got[name][hit].astype(np.int64)) for name in _FOUND.names[1:])], schema=_FOUND)

    index = store.spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(f"{store.path}/index")
    bucket = F.regexp_extract("path", r"/bucket=(\d+)/", 1)
    index = index.filter("length > 0").filter(bucket != "").select(bucket.cast("long").alias("bucket"), "content")
    return asked.mapInArrow(deal, "bucket long, key long").groupBy("bucket").cogroup(index.groupBy("bucket")).applyInArrow(find, "key long, shard long, place long, copies long, n long, first long, start long")


_FOUND = pa.schema([(name, pa.int64()) for name in ("key", "shard", "place", "copies", "n", "first", "start")])


def read_tokens(store: TokenStore, keys: DataFrame, with_ids: bool = False) -> DataFrame:
    """Documents of ``keys`` (its first column) read back from the files through the index.

    Returns one row per document found (all rows of a repeated key): the key, start (ids of all documents before
    it), n_tokens (end id included), ids_crc32 (of its ids as little-endian unsigned 32-bit integers) and, if
    asked for, ids array<int>. Keys that are not in the store give no row. The shards are scanned where they lie;
    places and documents meet by (shard, place), so no payload is shuffled.
    """
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids, lengths = _footer(content.as_py())
                end = np.cumsum(lengths.astype(np.int64))
                wide = ids.astype("<u4")
                spans = list(zip((end - lengths).tolist(), end.tolist()))
                columns = [pa.array(np.full(len(end), shard, np.int64)), pa.array(np.arange(len(end))), pa.array(end - lengths), pa.array(lengths.astype(np.int64)), pa.array([crc32(wide[a:b]) for a, b in spans], pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], end]).astype(np.int32)), pa.array(wide.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=["shard", "place", "first", "n_tokens", "ids_crc32", "ids"][: len(columns)])
            release_memory()

    ids = ", ids array<int>" if with_ids else ""
    read = _shards(store, "ids").mapInArrow(scan, f"shard long, place long, first long, n_tokens long, ids_crc32 long{ids}")
    name = keys.columns[0]
    found = lookup(store, keys)
    # copies of a key lie side by side, from the place of the first one on
    places = found.select("key", "shard", F.col("first").alias("head"), "start", F.explode(F.sequence("place", F.col("place") + F.col("copies") - 1)).alias("place"))
    out = places.join(read, ["shard", "place"]).select("key", (F.col("start") + F.col("first") - F.col("head")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))
    return out.withColumn("key", F.when(F.col("key") != _NULL, F.col("key"))).withColumnRenamed("key", name)
