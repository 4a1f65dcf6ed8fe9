"""Exact removal of long strings that an earlier document has, by blockwise suffix sorting over a cover.

A byte goes if a string of ``length`` bytes covers it that also starts in a document with a smaller id.
Sorting every suffix of a corpus would shuffle several times its size. So a cover of sample positions stands
in: the leftmost-hash positions ("anchors") of all windows, chosen by content, so that any two equal windows
have an anchor at the same distance from their start. That is the property that a difference cover has for
two positions, at a third of its density, since it is needed for equal strings only. Then

1. batches of documents name each anchor by two hashes: K of the anchor's own ``K_BYTES`` bytes, and S of all
   bytes of the windows that hold it. Equal names within a batch are one entry. Entries go to buckets by K,
   and one bucket at a time is sorted. An S seen in an earlier document settles all windows of the anchor.
2. where a K has several S, the windows around it differ in part. Only there one context of each S is sent
   to its bucket; suffixes and (reversed) prefixes of contexts are sorted, and their ranks and common prefix
   lengths, the cover-sample ranks, resolve every window: a window is the bytes before the anchor and the
   rank of the suffix at the anchor.
3. batches mark what their anchors' answers cover.

Texts travel to batches by a hash of the id; a passage that very many documents share is an entry a batch,
never a row a document. No step holds more than a batch or a bucket, both of bounded size, apart from a K
that has very many different contexts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellprobe.llm.io import integral, shared_dir, written

LENGTH = 50
K_BYTES = 20
#: Text bytes of a batch, and entries of a bucket, aimed at.
BATCH_BYTES, BUCKET_ENTRIES = 12 << 20, 500_000
_BLOCK = 1 << 18
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_NO_ID = np.int64(2**63 - 1)

_ENTRY = np.dtype([("k", "<u8"), ("s", "<u8"), ("doc", "<i8")])
_NAME = np.dtype([("k", "<u8"), ("s", "<u8")])
_SUBSCRIBER = np.dtype([("k", "<u8"), ("s", "<u8"), ("batch", "<i4")])
_RUN = np.dtype([("k", "<u8"), ("s", "<u8"), ("from", "u1"), ("to", "u1"), ("doc", "<i8")])


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    n = _BLOCK + 8 * LENGTH
    inverse = pow(_BASE, -1, 1 << 64)
    up = np.full(n, _U(_BASE))
    down = np.full(n, _U(inverse))
    up[0] = down[0] = _U(1)
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(29))


def _sliding(x: np.ndarray, n: int, f) -> np.ndarray:
    """f (minimum or maximum) over each n consecutive elements."""
    width = 1
    while 2 * width <= n:
        x = f(x[:-width], x[width:])
        width *= 2
    return f(x[: len(x) - (n - width)], x[n - width :]) if n > width else x


class Anchors:
    """Finds anchors in a buffer of documents laid end to end."""

    def __init__(self, length: int = LENGTH, k_bytes: int = K_BYTES):
        self.length, self.k = length, min(k_bytes, length)
        self.spread = self.length - self.k + 1  # how many anchors' places a window has
        self.up, self.down = _powers()

    def find(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(position, document number, K, S) of every anchor; offsets: starts of the documents and the end."""
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, _U))]
        for a in range(0, len(data), _BLOCK):
            b = min(len(data), a + _BLOCK)
            out.append(self._block(data, offsets, a, b))
        return tuple(map(np.concatenate, zip(*out, strict=True)))

    def _block(self, data: np.ndarray, offsets: np.ndarray, a: int, b: int):
        n, k, w = self.length, self.k, self.spread
        lo, hi = max(0, a - w), min(len(data), b + 2 * n)
        x = data[lo:hi]
        sums = np.zeros(len(x) + 1, _U)
        np.cumsum(x * self.down[: len(x)], out=sums[1:])
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, _U))
        if len(x) < n:
            return none
        name = _mixed((sums[k:] - sums[:-k]) * self.up[: len(x) - k + 1]) | _U(1)
        least = _sliding(name, w, np.minimum)  # of the window that starts there
        # No window reaches beyond its document.
        first = int(np.searchsorted(offsets, lo, "right"))
        for end in offsets[first : int(np.searchsorted(offsets, hi, "right"))]:
            least[max(0, end - n + 1 - lo) : max(0, end - lo)] = 0
        padded = np.concatenate([np.zeros(w - 1, _U), least, np.zeros(w - 1, _U)])
        chosen = np.flatnonzero(name == _sliding(padded, w, np.maximum)[: len(name)])
        chosen = chosen[(chosen + lo >= a) & (chosen + lo < b)]
        if not len(chosen):
            return none
        at = chosen + lo
        doc = np.searchsorted(offsets, at, "right") - 1
        left = np.maximum(at - (w - 1), offsets[doc])
        right = np.minimum(at + n, offsets[doc + 1])
        i, j = left - lo, right - lo
        clip = ((at - left) * 256 + (right - at)).astype(_U)
        s = _mixed((sums[j] - sums[i]) * self.up[i] + clip * _U(0xD6E8FEB86659FD93))
        return at, doc, name[chosen], s


def _buffer(texts: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one array of bytes, and their offsets; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], texts.type)
    texts = texts.fill_null("").cast(pa.large_string())
    starts = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[starts[0] : starts[-1]]
    return data, starts - starts[0]


def _ids(column) -> np.ndarray:
    return column.fill_null(int(_NO_ID)).to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.combine_chunks().fill_null(int(_NO_ID)).to_numpy(zero_copy_only=False)


def _joined(blobs, dtype: np.dtype) -> np.ndarray:
    parts = [np.frombuffer(b.as_buffer(), dtype) for b in blobs]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def _spread(keys: np.ndarray, rows: np.ndarray) -> tuple[list[int], list[bytes]]:
    """Rows grouped by key, as blobs."""
    if not len(keys):
        return [], []
    order = np.argsort(keys, kind="stable")
    keys, rows = keys[order], rows[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    ends = np.append(starts[1:], len(keys))
    return keys[starts].tolist(), [rows[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]


def _bucket(k: np.ndarray, buckets: int) -> np.ndarray:
    return (_mixed(k * _U(0x94D049BB133111EB)) % _U(buckets)).astype(np.int64)


def _earliest(k: np.ndarray, s: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Indices of the entry with the least doc of each (k, s), sorted by them."""
    order = np.lexsort((doc, s, k))
    k, s = k[order], s[order]
    return order[np.concatenate([[True], (k[1:] != k[:-1]) | (s[1:] != s[:-1])])] if len(order) else order


def _lookup(have: np.ndarray, k: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each (k, s): its first and past-the-last index in ``have``, which is sorted by (s, k)."""
    first = np.searchsorted(have["s"], s, "left")
    last = np.searchsorted(have["s"], s, "right")
    # Equal s nearly always means equal k; where it does not, narrow down.
    for i in np.flatnonzero((last > first) & ((have["k"][np.minimum(first, len(have) - 1)] != k) | (have["k"][np.maximum(last - 1, 0)] != k))) if len(have) else ():
        span = have["k"][first[i] : last[i]]
        first[i], last[i] = first[i] + np.searchsorted(span, k[i], "left"), first[i] + np.searchsorted(span, k[i], "right")
    return first, last


def resolve(k: np.ndarray, doc: np.ndarray, left: np.ndarray, right: np.ndarray, contexts: np.ndarray, length: int, spread: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """By distance t of the window's start before the anchor: (entries, least doc of an equal window, t).

    contexts: a row of ``spread - 1 + length`` bytes an entry, the anchor at ``spread - 1``; left and right:
    how many bytes of it are the document's before and from the anchor on.
    """

    def ranked(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order of entries by (k, row), and the common prefix with the entry before, -1 across ks."""
        width = -(-rows.shape[1] // 8) * 8
        words = np.zeros((len(rows), width), np.uint8)
        words[:, : rows.shape[1]] = rows
        words = words.view(">u8").astype(_U)
        order = np.lexsort((*words.T[::-1], k))
        sorted_rows, ks = rows[order], k[order]
        differ = sorted_rows[1:] != sorted_rows[:-1]
        common = np.where(differ.any(1), differ.argmax(1), rows.shape[1]) if rows.shape[1] else np.zeros(len(rows) - 1, np.int64)
        return order, np.concatenate([[-1], np.where(ks[1:] == ks[:-1], common, -1)])

    anchor = spread - 1
    right_order, right_common = ranked(contexts[:, anchor:])
    left_order, left_common = ranked(contexts[:, :anchor][:, ::-1])
    out, n = [], len(k)
    suffix, prefix = np.empty(n, np.int64), np.empty(n, np.int64)
    for t in range(spread):
        ok = np.flatnonzero((left >= t) & (right >= length - t))
        if not len(ok):
            continue
        suffix[right_order] = np.cumsum(right_common < length - t)
        prefix[left_order] = np.cumsum(left_common < t)
        pair = prefix[ok] * (n + 1) + suffix[ok]
        order = np.argsort(pair, kind="stable")
        pair = pair[order]
        starts = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        least = np.minimum.reduceat(doc[ok][order], starts)
        sizes = np.diff(np.append(starts, len(pair)))
        found = np.empty(len(ok), np.int64)
        found[order] = np.repeat(least, sizes)
        earlier = found < doc[ok]
        out.append((ok[earlier], found[earlier], t))
    return out


def _runs(entries: np.ndarray, found: list[tuple[np.ndarray, np.ndarray, int]]) -> np.ndarray:
    """Answers as runs of t with the same least doc, by entry."""
    if not found:
        return np.zeros(0, _RUN)
    who = np.concatenate([x[0] for x in found])
    doc = np.concatenate([x[1] for x in found])
    t = np.concatenate([np.full(len(x[0]), x[2]) for x in found])
    order = np.lexsort((t, who))
    who, doc, t = who[order], doc[order], t[order]
    if not len(who):
        return np.zeros(0, _RUN)
    new = np.concatenate([[True], (who[1:] != who[:-1]) | (doc[1:] != doc[:-1]) | (t[1:] != t[:-1] + 1)])
    starts = np.flatnonzero(new)
    out = np.zeros(len(starts), _RUN)
    out["k"], out["s"] = entries["k"][who[starts]], entries["s"][who[starts]]
    out["from"], out["to"], out["doc"] = t[starts], t[np.append(starts[1:], len(t)) - 1], doc[starts]
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, k_bytes: int = K_BYTES, with_text: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256[, kept binary]) of every row.

    Null text counts as empty, with the digest of nothing. A null id comes after all others, and rows that share
    an id, or have none, take nothing from each other. Texts under ``length`` bytes lose nothing. An empty
    table gives no rows; other columns are not read. Ids that are not integers raise TypeError. Long texts are read whole.
    """
    spark = docs.sparkSession
    integral(docs, id_col)
    shared_dir(spark)
    finder = {"length": length, "k_bytes": k_bytes}
    whole = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    total = whole.agg(F.sum(F.octet_length("text")).alias("n"), F.count(F.lit(1)).alias("rows")).first()
    n_bytes = total["n"] or 0
    batches = max(1, -(-(n_bytes + 64 * total["rows"]) // BATCH_BYTES))
    buckets = max(1, -(-2 * n_bytes // ((length - k_bytes + 2) * BUCKET_ENTRIES)))
    dealt = whole.withColumn("key", F.pmod(F.xxhash64("id", F.lit("batch")), F.lit(batches)).cast("int"))

    def entries(table: pa.Table) -> pa.Table:
        """Step 1, a batch: its different names, with the least doc of each."""
        find, ids = Anchors(**finder), _ids(table["id"])
        data, offsets = _buffer(table["text"])
        _, doc, k, s = find.find(data, offsets)
        doc = ids[doc]
        first = _earliest(k, s, doc)
        rows = np.zeros(len(first), _ENTRY)
        rows["k"], rows["s"], rows["doc"] = k[first], s[first], doc[first]
        keys, blobs = _spread(_bucket(rows["k"], buckets), rows)
        batch = table["key"][0].as_py() if len(table) else 0
        return pa.table({"key": pa.array(keys, pa.int32()), "batch": pa.array([batch] * len(keys), pa.int32()), "blob": pa.array(blobs, pa.binary())})

    def settle(table: pa.Table) -> pa.Table:
        """Step 1, a bucket: answers (kind 0) and requests for contexts (1) by batch, subscriptions (2) by bucket."""
        rows = _joined(table["blob"], _ENTRY)
        if not len(rows):
            return pa.table({"kind": pa.array([], pa.int32()), "key": pa.array([], pa.int32()), "blob": pa.array([], pa.binary())})
        sizes = [len(b.as_buffer()) // _ENTRY.itemsize for b in table["blob"]]
        batch = np.repeat(table["batch"].to_numpy(), sizes)
        order = np.lexsort((rows["doc"], rows["s"], rows["k"]))
        rows, batch = rows[order], batch[order]
        new_k = np.concatenate([[True], rows["k"][1:] != rows["k"][:-1]])
        new_s = new_k | np.concatenate([[True], rows["s"][1:] != rows["s"][:-1]])
        starts = np.flatnonzero(new_s)
        least = np.repeat(rows["doc"][starts], np.diff(np.append(starts, len(rows))))
        of_k = np.cumsum(new_k) - 1
        contested = (np.bincount(of_k[starts])[of_k]) > 1
        known = np.flatnonzero(least < rows["doc"])
        answers = rows[known].copy()
        answers["doc"] = least[known]
        names = np.zeros(len(rows), _NAME)
        names["k"], names["s"] = rows["k"], rows["s"]
        owners, subscribers = np.flatnonzero(contested & new_s), np.flatnonzero(contested)
        sub = np.zeros(len(subscribers), _SUBSCRIBER)
        sub["k"], sub["s"], sub["batch"] = rows["k"][subscribers], rows["s"][subscribers], batch[subscribers]
        out = {"kind": [], "key": [], "blob": []}
        bucket = table["key"][0].as_py()
        for kind, keys, part in ((0, batch[known], answers), (1, batch[owners], names[owners]), (2, np.full(len(sub), bucket), sub)):
            keys, blobs = _spread(keys, part)
            out["kind"] += [kind] * len(keys)
            out["key"] += keys
            out["blob"] += blobs
        return pa.table({"kind": pa.array(out["kind"], pa.int32()), "key": pa.array(out["key"], pa.int32()), "blob": pa.array(out["blob"], pa.binary())})

    width = length - k_bytes + length  # bytes before the anchor, and from it on
    context = np.dtype([("k", "<u8"), ("s", "<u8"), ("doc", "<i8"), ("left", "u1"), ("right", "u1"), ("bytes", "u1", (width,))])

    def contexts(table: pa.Table, wanted: pa.Table) -> pa.Table:
        """Step 2, a batch: the context of each requested name, from its first document."""
        want = _joined(wanted["blob"], _NAME)
        want = want[np.lexsort((want["k"], want["s"]))]
        empty = pa.table({"key": pa.array([], pa.int32()), "blob": pa.array([], pa.binary())})
        if not len(want) or not len(table):
            return empty
        find, ids = Anchors(**finder), _ids(table["id"])
        data, offsets = _buffer(table["text"])
        at, doc, k, s = find.find(data, offsets)
        first, last = _lookup(want, k, s)
        hit = np.flatnonzero(last > first)
        own = hit[_earliest(k[hit], s[hit], ids[doc[hit]])]
        rows = np.zeros(len(own), context)
        before = find.spread - 1
        start, end = offsets[doc[own]], offsets[doc[own] + 1]
        rows["k"], rows["s"], rows["doc"] = k[own], s[own], ids[doc[own]]
        rows["left"], rows["right"] = np.minimum(at[own] - start, before), np.minimum(end - at[own], length)
        places = at[own][:, None] + np.arange(-before, length)[None, :]
        inside = (places >= start[:, None]) & (places < end[:, None])
        rows["bytes"] = np.where(inside, data[np.clip(places, 0, len(data) - 1)], 0)
        keys, blobs = _spread(_bucket(rows["k"], buckets), rows)
        return pa.table({"key": pa.array(keys, pa.int32()), "blob": pa.array(blobs, pa.binary())})

    def fine(table: pa.Table, subscribers: pa.Table) -> pa.Table:
        """Step 2, a bucket: runs of windows with an earlier equal, sent to every batch that has the name."""
        rows, subs = _joined(table["blob"], context), _joined(subscribers["blob"], _SUBSCRIBER)
        rows = rows[np.lexsort((rows["s"], rows["k"]))]
        runs = _runs(rows, resolve(rows["k"], rows["doc"], rows["left"], rows["right"], rows["bytes"], length, length - k_bytes + 1)) if len(rows) else np.zeros(0, _RUN)
        runs = runs[np.lexsort((runs["from"], runs["k"], runs["s"]))]
        first, last = _lookup(runs, subs["k"], subs["s"])
        n = last - first
        take = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        keys, blobs = _spread(np.repeat(subs["batch"], n), runs[take])
        return pa.table({"key": pa.array(keys, pa.int32()), "blob": pa.array(blobs, pa.binary())})

    def marked(table: pa.Table, answers: pa.Table) -> pa.Table:
        """Step 3, a batch."""
        find, ids = Anchors(**finder), _ids(table["id"])
        data, offsets = _buffer(table["text"])
        at, doc, k, s = find.find(data, offsets)
        kinds = answers["kind"].to_numpy()
        whole_ = _joined([b for b, kind in zip(answers["blob"], kinds, strict=True) if kind == 0], _ENTRY)
        runs = _joined([b for b, kind in zip(answers["blob"], kinds, strict=True) if kind == 1], _RUN)
        whole_ = whole_[np.lexsort((whole_["k"], whole_["s"]))]
        runs = runs[np.lexsort((runs["from"], runs["k"], runs["s"]))]
        own = ids[doc] if len(doc) else np.zeros(0, np.int64)
        # The earliest document with the name: the batch's own, or the one told.
        order = np.lexsort((own, s, k))
        new = np.concatenate([[True], (k[order][1:] != k[order][:-1]) | (s[order][1:] != s[order][:-1])]) if len(order) else np.zeros(0, bool)
        starts = np.flatnonzero(new)
        least = np.empty(len(order), np.int64)
        least[order] = np.repeat(own[order][starts], np.diff(np.append(starts, len(order))))
        first, last = _lookup(whole_, k, s)
        told = np.flatnonzero(last > first)
        least[told] = np.minimum(least[told], whole_["doc"][first[told]])
        delta = np.zeros(len(data) + 1, np.int32)
        start, end = offsets[doc], offsets[doc + 1]

        def cover(which: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
            """Windows that start at low to high, both included."""
            low, high = np.maximum(low, start[which]), np.minimum(high, end[which] - length)
            ok = low <= high
            np.add.at(delta, low[ok], 1)
            np.add.at(delta, high[ok] + length, -1)

        seen = np.flatnonzero(least < own)
        cover(seen, at[seen] - (find.spread - 1), at[seen])
        open_ = np.flatnonzero(least >= own)
        first, last = _lookup(runs, k[open_], s[open_])
        n = last - first
        which = np.repeat(open_, n)
        take = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        earlier = runs["doc"][take] < own[which]
        which, take = which[earlier], take[earlier]
        cover(which, at[which] - runs["to"][take], at[which] - runs["from"][take])
        gone = np.cumsum(delta, out=delta)[:-1] > 0
        out = {"id": [], "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
        for i in range(len(ids)):
            a, b = offsets[i], offsets[i + 1]
            own_gone = gone[a:b]
            kept = data[a:b][~own_gone].tobytes()
            out["n_bytes"].append(int(b - a))
            out["n_removed"].append(int(own_gone.sum()))
            out["n_spans"].append(int(own_gone[:1].sum() + (own_gone[1:] & ~own_gone[:-1]).sum()))
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            out["kept"].append(kept if with_text else None)
        out["id"] = table["id"]
        out["kept"] = pa.array(out["kept"], pa.binary())
        return pa.table(out)

    named = dealt.groupBy("key").applyInArrow(entries, "key int, batch int, blob binary")
    settled, _ = written(named.groupBy("key").applyInArrow(settle, "kind int, key int, blob binary"))
    asked = settled.where("kind = 1").groupBy("key")
    sent = dealt.groupBy("key").cogroup(asked).applyInArrow(contexts, "key int, blob binary")
    resolved, _ = written(sent.groupBy("key").cogroup(settled.where("kind = 2").groupBy("key")).applyInArrow(fine, "key int, blob binary"))
    answers = settled.where("kind = 0").select("kind", "key", "blob").union(resolved.select(F.lit(1).alias("kind"), "key", "blob"))
    schema = "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"
    out = dealt.groupBy("key").cogroup(answers.groupBy("key")).applyInArrow(marked, schema)
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else []))
