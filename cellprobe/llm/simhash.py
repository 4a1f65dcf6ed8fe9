"""SimHash fingerprints of documents and the groups that they form.

Fingerprints that differ in at most two bits are linked. A fingerprint is cut into two halves, so that of
two linked ones some half differs in at most one bit; every half is indexed under each variant with one bit
left out, and equal variants make candidates. Documents with the same fingerprint are one entry from the
start. Buckets of an index key are compared a sorted run at a time; of the links found, a run passes on only
those that join what it had not joined yet, never all pairs. A run longer than ``long_run`` is not compared
pairwise at all: its members are indexed again under all variants that leave out two bits in total, and
members that share such a variant are within two bits by construction, so each is linked to the least.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellprobe.llm.components import components
from cellprobe.llm.io import cut, fresh

SEED = 42
#: White space between words becomes a blank.
_ONE_SPACE = bytes.maketrans(b"\t\n\v\f\r", b"     ")


def shingle_hashes(text: str | None, words: int = 3) -> np.ndarray:
    """64-bit hashes of the shingles of ``words`` words in their order, repeats included; none if there is no word."""
    import xxhash

    data = (text or "").encode("utf-8", "surrogatepass").lower().translate(_ONE_SPACE)
    parts = [w for w in data.split(b" ") if w]
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    digest = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return np.array([digest(joined, SEED)], np.uint64)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = np.concatenate([[0], gaps + 1])[: len(parts) - words + 1].tolist()
    ends = np.concatenate([gaps, [len(joined)]])[words - 1 :].tolist()
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)], np.uint64)


def fingerprint(text: str | None, words: int = 3) -> int:
    """Unsigned 64-bit SimHash of the shingles of ``words`` words, repeats included; 0 if there is no word."""
    hashes = shingle_hashes(text, words)
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        block = hashes[i : i + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, f bigint): the fingerprint of every whole text as a signed number; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), words) for t in batch.column(1)), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=[id_col, "f"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, f bigint")


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, f) for the 64 variants of each fingerprint: number of half and bit, then the half without that bit."""
    for batch in batches:
        for at in range(0, len(batch), 2000):
            f = batch.column(0).slice(at, 2000).to_numpy(zero_copy_only=False).view(np.uint64)
            keys = []
            for half in (0, 1):
                part = (f >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
                for bit in range(32):
                    low = part & np.uint64((1 << bit) - 1)
                    keys.append(np.uint64((half * 32 + bit) << 31) | low | (part >> np.uint64(bit + 1)) << np.uint64(bit))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.tile(f.view(np.int64), 64))], names=["key", "f"])


class _Forest:
    """Union by least label within one task's batch; tells which links join something new."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _compare(distance: int, long_run: int):
    """Links within the runs of equal keys of a stream sorted by key; long runs are passed on, (key, f) with kind 1."""

    def links(key: np.ndarray, f: np.ndarray) -> pa.RecordBatch | None:
        bounds = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        sizes = np.diff(bounds)
        size = np.repeat(sizes, sizes)
        late = size > long_run
        keep = (size > 1) & ~late
        k, x = key[keep], f[keep]
        forest, found, lag = _Forest(), [], 1
        while len(k) > lag:
            same = np.flatnonzero(k[lag:] == k[:-lag])
            if not len(same):
                break
            near = same[np.bitwise_count((x[same] ^ x[same + lag]).view(np.uint64)) <= distance]
            found += [e for e in set(zip(x[near].tolist(), x[near + lag].tolist(), strict=True)) if e[0] != e[1] and forest.join(*e)]
            lag += 1
        kind = np.concatenate([np.zeros(len(found), np.int32), np.ones(int(late.sum()), np.int32)])
        if not len(kind):
            return None
        a = np.concatenate([np.array([e[0] for e in found], np.int64), key[late]])
        b = np.concatenate([np.array([e[1] for e in found], np.int64), f[late]])
        return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(a), pa.array(b)], names=["kind", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, f = np.zeros(0, np.int64), np.zeros(0, np.int64)
        passing = None  # the key of a run that is already known to be long
        for batch in batches:
            key = np.concatenate([key, batch.column(0).to_numpy(zero_copy_only=False)])
            f = np.concatenate([f, batch.column(1).to_numpy(zero_copy_only=False)])
            if passing is not None:
                n = int(np.searchsorted(key, passing, "right"))
                if n:
                    yield pa.RecordBatch.from_arrays([pa.array(np.ones(n, np.int32)), pa.array(key[:n]), pa.array(f[:n])], names=["kind", "a", "b"])
                key, f = key[n:], f[n:]
                if not len(key):
                    continue
                passing = None
            end = int(np.searchsorted(key, key[-1], "left")) if len(key) else 0
            if end and (out := links(key[:end], f[:end])):
                yield out
            key, f = key[end:], f[end:]
            if len(key) > long_run:
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(key), np.int32)), pa.array(key), pa.array(f)], names=["kind", "a", "b"])
                passing, key, f = int(key[0]), key[:0], f[:0]
        if len(key) and (out := links(key, f)):
            yield out

    return run


def _masks(half: int, bit: int) -> list[int]:
    """What two linked members of the index key (half, bit) may differ in, as masks of at most two bits.

    Either that bit and one bit of the other half, or two bits of the other half. A key says that the rest of
    its half is equal.
    """
    own, other = 1 << (32 * half + bit), [1 << (32 * (1 - half) + i) for i in range(32)]
    return [own | o for o in other] + [other[i] | other[j] for i in range(32) for j in range(i)]


def _all_variants(distance: int):
    """(f, m, v) for the members of long runs: each mask m of what may differ, and the fingerprint without it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = [np.array([m for m in _masks(k // 32, k % 32)] if distance == 2 else [1 << b for b in range(64)], np.uint64) for k in range(64)]
        for batch in batches:
            key = batch.column(0).to_numpy(zero_copy_only=False) >> 31
            f = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            for number in np.unique(key):
                own = f[key == number]
                for at in range(0, len(own), 500):
                    m, x = masks[number], own[at : at + 500]
                    v = (x[:, None] & ~m[None, :]).ravel()
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(x, len(m)).view(np.int64)), pa.array(np.tile(m, len(x)).view(np.int64)), pa.array(v.view(np.int64))], names=["f", "m", "v"])

    return run


def near_links(distinct: DataFrame, distance: int = 2, long_run: int = 1024) -> DataFrame:
    """Links (a, b) among distinct fingerprints f (bigint), enough to join all that are linked at ``distance`` or less.

    ``distance`` may be 1 or 2: with two halves, some half then differs in at most one bit.
    """
    if distance not in (1, 2):
        raise ValueError("two halves with one free bit cover distances 1 and 2")
    keys = distinct.select("f").mapInArrow(_index, "key bigint, f bigint")
    found = cut(keys.repartition("key").sortWithinPartitions("key").mapInArrow(_compare(distance, long_run), "kind int, a bigint, b bigint"))
    long = found.where("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("f"))
    if long.isEmpty():
        return found.select("a", "b")
    variants = long.mapInArrow(_all_variants(distance), "f bigint, m bigint, v bigint")
    least = variants.groupBy("m", "v").agg(F.min("f").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    stars = variants.join(least, ["m", "v"]).where("f <> a").select("a", F.col("f").alias("b"))
    return found.where("kind = 0").select("a", "b").union(stars.distinct())


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, distance: int = 2, long_run: int = 1024) -> DataFrame:
    """(id, f, component): each row's fingerprint and the least id reachable from it over links.

    Texts that are null, empty or white space have fingerprint 0 and are linked like any other. Repeated rows
    stay; rows with a null id get the least id of their group, and null if it has none. An empty table gives
    no rows. Other columns of ``docs`` are not read.
    """
    prints = cut(fingerprints(docs, id_col, text_col, words))
    reps = cut(prints.groupBy("f").agg(F.min(id_col).alias("_least")))
    parts = cut(components(near_links(reps, distance, long_run)))
    # Only fingerprints with a partner get rows here; the rest are their own component.
    known = reps.join(parts.withColumnRenamed("node", "f"), "f", "left").withColumn("component", F.coalesce("component", "f"))
    least = known.groupBy("component").agg(F.min("_least").alias("component_id"))
    by_print = cut(known.join(least, "component").select("f", "component_id"))
    return prints.join(by_print, "f").select(id_col, "f", "component_id")


def simhash_groups(docs: DataFrame, **options) -> DataFrame:
    """``groups`` with the fingerprint as 16 lowercase hex digits."""
    id_col = options.get("id_col", "doc_id")
    return groups(docs, **options).select(id_col, F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` with one document of each group: the one with the least id. Rows with a null id stay.

    Repeated rows of the kept id stay as well: they are one document's.
    """
    name = fresh(docs, "_kept")
    kept = groups(docs, id_col=id_col, **options).where(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias(name)).distinct()
    named = docs.where(F.col(id_col).isNotNull()).join(kept, F.col(id_col) == F.col(name), "left_semi")
    return named.unionByName(docs.where(F.col(id_col).isNull()))
