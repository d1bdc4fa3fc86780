"""Removal of byte strings that an earlier document holds, by merged Burrows-Wheeler transforms."""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import anchors
from tidemark.llm.anchors import WINDOW
from tidemark.llm.common import dump, load, packed, release_memory, unpacked, utf8_bytes
from tidemark.llm.merged_bwt import merge, transform
from tidemark.session import checkpointed

_BLOCK = 4 << 20
_MESSAGE = "block long, kind int, bucket int, body binary"


class _Block:
    """A block's documents and its distinct (anchor, region) pairs, dealt to buckets by anchor."""

    def __init__(self, body: bytes, n_buckets: int):
        rows = unpacked(body)
        self.ids = rows.column(0)
        self.data, self.start, self.end = utf8_bytes(rows.column(1))
        known = np.asarray(self.ids.is_valid())
        ids = np.asarray(pa.compute.fill_null(self.ids, 0)).astype(np.int64)
        first, count, anchor, region, doc = anchors.find(self.data, self.start, self.end)
        keep = known[doc]
        first, count, anchor, region, doc = (x[keep] for x in (first, count, anchor, region, doc))
        order = anchors.order_by(anchor, region, ids[doc])
        bucket = ((anchor >> np.uint64(40)) * np.uint64(n_buckets) >> np.uint64(24)).astype(np.int64)  # in the order of anchors
        self.first, self.count, self.anchor, self.region, self.bucket = (x[order] for x in (first, count, anchor, region, bucket))
        self.doc_id = ids[doc[order]]
        new = np.ones(len(order), bool)
        new[1:] = (self.region[1:] != self.region[:-1]) | (self.anchor[1:] != self.anchor[:-1])
        self.head = np.flatnonzero(new)  # one per pair: its occurrence in the least document
        self.pair = np.cumsum(new) - 1
        buckets = self.bucket[self.head]
        at = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1]])) if len(buckets) else np.zeros(0, int)
        self.parts = {int(buckets[a]): (a, b) for a, b in zip(at, [*at[1:], len(buckets)])}

    @cached_property
    def raw(self) -> bytes:
        return self.data.tobytes()

    def asked(self):
        for bucket, (a, b) in self.parts.items():
            head = self.head[a:b]
            base = int(self.doc_id[head].min())
            gap = (self.doc_id[head] - base).astype(np.uint64)
            gap = gap.astype(np.min_scalar_type(gap.max()))
            low = self.anchor[head].view(np.uint8).reshape(-1, 8)[:, :5]
            yield bucket, dump(np.ascontiguousarray(low), self.region[head], base, gap)

    def answered(self, answers: pa.Table):
        """Least document of each pair, and how its windows are to be searched (0 not, 1 merged, 2 one by one)."""
        least, need = self.doc_id[self.head].copy(), np.zeros(len(self.head), np.uint8)
        for kind, bucket, body in zip(*(answers.column(c).to_pylist() for c in ("kind", "bucket", "body"))):
            if kind == 0:
                at, low, how = load(body)
                a = self.parts[bucket][0] + at
                least[a], need[a] = low, how
        return least, need

    def searched(self, need: np.ndarray, n_merges: int):
        """Strings of the pairs to be searched: per merge bucket the pairs in string order, and the strings."""
        pairs = np.flatnonzero(need == 1)
        group = self.bucket[self.head[pairs]] % n_merges
        for g in np.unique(group):
            own = pairs[group == g]
            first = self.first[self.head[own]]
            last = first + self.count[self.head[own]] + WINDOW - 1
            strings = [self.raw[a:b] for a, b in zip(first.tolist(), last.tolist())]
            order = sorted(range(len(strings)), key=strings.__getitem__)
            yield int(g), own[order], [strings[i] for i in order]

    def windows(self, need: np.ndarray, n_merges: int):
        """Single windows of the pairs of hot anchors: per merge bucket digests (least document first), documents, places."""
        pairs = np.flatnonzero(need == 2)
        if not len(pairs):
            return
        first, count = self.first[self.head[pairs]], self.count[self.head[pairs]]
        pair = np.repeat(pairs, count)
        offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        at = np.repeat(first, count) + offset
        digest = np.frombuffer(b"".join([xxhash.xxh3_128_digest(self.raw[a : a + WINDOW]) for a in at.tolist()]), np.uint64).reshape(-1, 2)
        doc = self.doc_id[self.head[pair]]
        order = np.lexsort((doc, digest[:, 1], digest[:, 0]))
        digest, doc, pair, offset = digest[order], doc[order], pair[order], offset[order]
        group = (digest[:, 0] % np.uint64(n_merges)).astype(np.int64)
        for g in np.unique(group):
            own = group == g
            yield int(g), digest[own], doc[own], pair[own], offset[own]


def _rows(rows, schema: pa.Schema) -> pa.Table:
    rows = list(rows)
    return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


_SENT = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("block", pa.int64()), ("body", pa.binary())])
_BACK = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int32()), ("body", pa.binary())])


def _answer(sent: pa.Table, hot: int) -> pa.Table:
    """All pairs of a bucket's anchors: the least document of each region, and which anchors differ in region."""
    bodies = [load(b) for b in sent.column("body").to_pylist()]
    sizes = [len(b[1]) for b in bodies]
    anchor = np.zeros((sum(sizes), 8), np.uint8)
    anchor[:, :5] = np.concatenate([b[0] for b in bodies])
    anchor = anchor.view(np.uint64).ravel()
    region = np.concatenate([b[1] for b in bodies])
    doc = np.concatenate([b[2] + b[3].astype(np.int64) for b in bodies])
    order = anchors.order_by(anchor, region, doc)
    a, r, d = anchor[order], region[order], doc[order]
    new_anchor = np.concatenate([[True], a[1:] != a[:-1]])
    new_region = new_anchor | np.concatenate([[True], r[1:] != r[:-1]])
    of_anchor, of_region = np.cumsum(new_anchor) - 1, np.cumsum(new_region) - 1
    least = d[new_region]
    start = np.flatnonzero(new_anchor[new_region])
    several = np.maximum.reduceat(least, start) > np.minimum.reduceat(least, start)
    n_regions = np.diff(start, append=len(least))
    how = np.where(several, np.where(n_regions > hot, 2, 1), 0).astype(np.uint8)
    need = np.where(new_region, how[of_anchor], 0).astype(np.uint8)
    least = least[of_region]
    told = (need > 0) | (least < d)
    back_least, back_need, back_told = np.empty_like(least), np.empty_like(need), np.empty_like(told)
    back_least[order], back_need[order], back_told[order] = least, need, told
    out, at, bucket = [], 0, sent.column("bucket")[0].as_py()
    for block, n in zip(sent.column("block").to_pylist(), sizes):
        here = np.flatnonzero(back_told[at : at + n])
        if len(here):
            out.append((block, 0, bucket, dump(here.astype(np.uint32), back_least[at + here], back_need[at + here])))
        at += n
    return _rows(out, _BACK)


def _merged(sent: pa.Table) -> pa.Table:
    """Windows that a smaller document holds: merged transforms for strings, sorted digests for single windows."""
    bucket = sent.column("bucket")[0].as_py()
    rows = list(zip(sent.column("kind").to_pylist(), sent.column("block").to_pylist(), sent.column("body").to_pylist()))
    out = []
    if shards := [(block, *load(body)) for kind, block, body in rows if kind == 1]:
        interval, onward, whole = merge([s[1] for s in shards], WINDOW)
        doc, count = np.concatenate([s[2] for s in shards]), np.concatenate([s[3] for s in shards])
        row, seen = whole.astype(np.int32), np.full((len(doc), int(count.max())), -1, np.int32)
        for offset in range(seen.shape[1]):
            has = count > offset
            seen[has, offset] = interval[row[has]]
            row = onward[row]
        least = np.full(max(int(interval.max()), 0) + 1, np.iinfo(np.int64).max)
        valid = seen >= 0
        np.minimum.at(least, seen[valid], np.broadcast_to(doc[:, None], seen.shape)[valid])
        hit = valid & (least[np.maximum(seen, 0)] < doc[:, None])
        mask = (hit.astype(np.uint32) << np.arange(seen.shape[1], dtype=np.uint32)).sum(axis=1, dtype=np.uint32)
        at = 0
        for block, _, own, _ in shards:
            out.append((block, 1, bucket, dump(mask[at : at + len(own)])))
            at += len(own)
    if single := [(block, *load(body)) for kind, block, body in rows if kind == 2]:
        digest, doc = np.concatenate([s[1] for s in single]), np.concatenate([s[2] for s in single])
        order = np.lexsort((doc, digest[:, 1], digest[:, 0]))
        same = digest[order]
        new = np.concatenate([[True], (same[1:] != same[:-1]).any(axis=1)])
        least = np.empty_like(doc)
        least[order] = doc[order][new][np.cumsum(new) - 1]
        at = 0
        for block, own, _ in single:
            out.append((block, 2, bucket, dump(np.packbits(least[at : at + len(own)] < doc[at : at + len(own)]))))
            at += len(own)
    release_memory()
    return _rows(out, _BACK)


def _first_of(digest: np.ndarray) -> np.ndarray:
    return np.concatenate([[True], (digest[1:] != digest[:-1]).any(axis=1)])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = 4096) -> DataFrame:
    """Remove each byte covered by a 50-byte string that also starts in a document with a smaller id.

    Returns one row per input row: ``id_col``, n_bytes long, spans array<struct<start, stop>> (maximal removed
    runs, in bytes), kept binary (remaining bytes). Strings are judged on the input; matches do not cross
    documents; a null text is empty; texts under 50 bytes stay whole. A row without id stays whole and removes
    nothing; rows that repeat an id do not remove each other's text. Other columns are ignored.

    1. Blocks of documents find their regions (``anchors``): every window of 50 bytes is in one, and windows can only
       be equal if their regions have the same anchor. Each block sends its distinct (anchor, region) pairs to buckets by anchor;
       the answer names the least document of each region. A later document's equal region is removed at once.
    2. Distinct regions under one anchor, one copy of each, go to merge buckets as shard BWTs, one shard per block;
       the merge yields the intervals of suffixes with 50 bytes in common, and the least document of each.
    3. An anchor with over ``hot`` distinct regions would overload its bucket; its windows are dealt out one by one by
       their 128-bit digests instead. The result is the same.
    """
    blocks = packed(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), "text", _BLOCK)
    n_buckets = max(blocks.count(), 1)
    n_merges = max(n_buckets // 4, 1)

    def ask(batches):
        for batch in batches:
            for number, body in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                for bucket, message in _Block(body, n_buckets).asked():
                    yield from _rows([(bucket, 0, number, message)], _SENT).to_batches()

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for number, body in zip(left.column("block").to_pylist(), left.column("body").to_pylist()):
            block = _Block(body, n_buckets)
            least, need = block.answered(right)
            for bucket, pairs, strings in block.searched(need, n_merges):
                head = block.head[pairs]
                out.append((bucket, 1, number, dump(transform(strings), block.doc_id[head], block.count[head])))
            for bucket, digest, doc, _, _ in block.windows(need, n_merges):
                new = _first_of(digest)
                out.append((bucket, 2, number, dump(digest[new], doc[new])))
        release_memory()
        return _rows(out, _SENT)

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [_cut(_Block(body, n_buckets), right, n_merges) for body in left.column("body").to_pylist()]
        release_memory()
        return pa.concat_tables(out) if out else _CUT.empty_table()

    sent_type = "bucket int, kind int, block long, body binary"
    answers = checkpointed(blocks.mapInArrow(ask, sent_type).groupBy("bucket").applyInArrow(lambda t: _answer(t, hot), _MESSAGE))
    grouped = blocks.groupBy("block")
    sent = grouped.cogroup(answers.groupBy("block")).applyInArrow(search, sent_type)
    masks = checkpointed(sent.groupBy("bucket").applyInArrow(_merged, _MESSAGE))
    replies = answers.union(masks)
    out = grouped.cogroup(replies.groupBy("block")).applyInArrow(cut, "id long, n_bytes long, spans array<struct<start: long, stop: long>>, kept binary")
    return out.withColumnRenamed("id", id_col)


_SPAN = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
_CUT = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(_SPAN)), ("kept", pa.binary())])


def _cut(block: _Block, replies: pa.Table, n_merges: int) -> pa.Table:
    n = len(block.data)
    least, need = block.answered(replies)
    depth = np.zeros(n + 1, np.int32)
    later = block.doc_id > least[block.pair]
    np.add.at(depth, block.first[later], 1)
    np.add.at(depth, (block.first + block.count + WINDOW - 1)[later], -1)
    masks = {(k, b): body for k, b, body in zip(*(replies.column(c).to_pylist() for c in ("kind", "bucket", "body"))) if k}
    bits = np.zeros(len(block.head), np.uint32)
    for bucket, pairs, _ in block.searched(need, n_merges) if any(k == 1 for k, _ in masks) else ():
        bits[pairs] = load(masks[1, bucket])[0]
    for bucket, digest, _, pair, offset in block.windows(need, n_merges):
        new = _first_of(digest)
        hit = np.unpackbits(load(masks[2, bucket])[0], count=int(new.sum())).astype(bool)[np.cumsum(new) - 1]
        # a window whose digest is in a smaller document of this block is hit as well
        doc = block.doc_id[block.head[pair]]
        hit |= doc > doc[new][np.cumsum(new) - 1]
        np.bitwise_or.at(bits, pair[hit], np.uint32(1) << offset[hit].astype(np.uint32))
    own = np.flatnonzero((bits[block.pair] > 0) & ~later)
    for offset in range(anchors.RUN):
        at = block.first[own[(bits[block.pair[own]] >> np.uint32(offset)) & np.uint32(1) > 0]] + offset
        np.add.at(depth, at, 1)
        np.add.at(depth, at + WINDOW, -1)
    gone = np.cumsum(depth[:-1]) > 0
    edge = np.zeros(n + 1, bool)
    edge[block.start], edge[block.end] = True, True
    before = np.concatenate([[False], gone[:-1]])
    starts = np.flatnonzero(gone & (~before | edge[:-1]))
    after = np.concatenate([gone[1:], [False]])
    stops = np.flatnonzero(gone & (~after | edge[1:])) + 1
    doc = np.searchsorted(block.end, starts, "right")
    per = np.bincount(doc, minlength=len(block.start))
    spans = pa.StructArray.from_arrays([pa.array(starts - block.start[doc]), pa.array(stops - block.start[doc])], fields=list(_SPAN))
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]).astype(np.int32)), spans)
    kept = block.data[~gone]
    size = np.concatenate([[0], np.cumsum(~gone)])
    ends = size[block.end]
    kept_bytes = pa.Array.from_buffers(pa.binary(), len(block.start), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32).tobytes()), pa.py_buffer(kept.tobytes())])
    return pa.table([block.ids.combine_chunks() if isinstance(block.ids, pa.ChunkedArray) else block.ids, pa.array(block.end - block.start), lists, kept_bytes], schema=_CUT)
