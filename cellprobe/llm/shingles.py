"""Near duplicates among documents: those whose sets of shingles have a Jaccard similarity of a given least.

Documents with equal sets are one entry. Two sets of similarity t or more share a member among the first
n - ceil(t n) + 1 of either, in any order that is the same for all; so these are the index, and every link has
an index key in common. Members that a sample finds often come last in the order, the others by hash. Sizes and
places in the order rule out most candidates, and the whole sets verify the rest. Shingles are told by 64 bits of hash,
and so are sets.

A run of one index key of up to ``long_run`` entries is compared pair by pair. Of a longer one, each entry is first
compared with a few neighbours; then all pairs that the links so far do not connect are compared as well. A sketch of
each set, a bit for a member or two, rules out most candidates that are not similar enough and no other. Of the rest each
entry is first verified with one partner, and of the other candidates only those that are not connected by then. Sets
travel in rounds, so that what is under way at a time stays a share of all sets, however many candidates there are.

With ``bits``, documents whose SimHashes differ in at most so many bits are linked as well, as in ``simhash``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellprobe.llm.components import components
from cellprobe.llm.io import cut, drop, fresh, written
from cellprobe.llm.simhash import fingerprint, near_links, shingle_hashes

EPS = 1e-9
#: Texts, and their most frequent shingles, from which the order is made; any order finds the same links.
SAMPLE, FREQUENT = 20_000, 20_000
#: Bytes of sets under way in a round: this and half of all sets that have a candidate. Pairs in a batch of Python's.
ROUND_BYTES, BATCH = 64 << 20, {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


def _set(text: str | None, words: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, words))


def _named(words: int, prints: bool):
    """(id, text) to (id, e, f, text): e tells the set of shingles, f is the SimHash, or null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            e = np.fromiter((xxhash.xxh64_intdigest(_set(t.as_py(), words).tobytes()) for t in batch.column(1)), np.uint64, len(batch))
            f = pa.array(np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), np.uint64, len(batch)).view(np.int64)) if prints else pa.nulls(len(batch), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(e.view(np.int64)), f, batch.column(1)], names=["id", "e", "f", "text"])

    return run


def _members(words: int):
    """(e, text) to (h): every shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(1):
                yield pa.RecordBatch.from_arrays([pa.array(_set(t.as_py(), words).view(np.int64))], names=["h"])

    return run


def _index(words: int, similarity: float, frequent: dict[int, int]):
    """(e, text) to (key, e, n, place) for the first members of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = np.array(sorted(frequent), np.uint64)
        counts = np.array([frequent[int(h)] for h in late], np.int64)
        for batch in batches:
            parts = []
            for e, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = _set(t.as_py(), words)
                n = len(s)
                rank = np.zeros(n, np.int64)
                if len(late):
                    at = np.minimum(np.searchsorted(late, s), len(late) - 1)
                    rank = np.where(late[at] == s, counts[at], 0)
                first = s[np.argsort(rank, kind="stable")][: n - math.ceil(similarity * n - EPS) + 1]
                parts.append((first, e, n))
            if parts:
                sizes = [len(p[0]) for p in parts]
                key = np.concatenate([p[0] for p in parts]).view(np.int64)
                place = np.concatenate([np.arange(k, dtype=np.int32) for k in sizes])
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.repeat(np.array([p[1] for p in parts], np.int64), sizes)), pa.array(np.repeat(np.array([p[2] for p in parts], np.int32), sizes)), pa.array(place)], names=["key", "e", "n", "place"])

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for e, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = _set(t.as_py(), words).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([e], pa.int64()), pa.array([s], pa.binary()), pa.array([len(s)], pa.int64())], names=["e", "s", "size"])

    return run


def _sketches(words: int):
    """(e, text) to (e, n, sketch): the size of the set, and which places have an odd number of its members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, sketches = [], []
            for t in batch.column(1):
                s = _set(t.as_py(), words)
                places = 1 << max(6, (len(s) - 1).bit_length())
                odd = np.bincount((s & np.uint64(places - 1)).astype(np.int64), minlength=places).astype(np.uint8) & 1
                sizes.append(len(s))
                sketches.append(np.packbits(odd, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary())], names=["e", "n", "sketch"])

    return run


def _differing(a: bytes, b: bytes) -> int:
    """Places in which two sketches differ: no more than there are members of one set only. The larger is folded to the other's places."""
    small, large = sorted((a, b), key=len)
    x, places = int.from_bytes(large, "little"), 8 * len(large)
    while places > 8 * len(small):
        places //= 2
        x = x >> places ^ x & (1 << places) - 1
    return (x ^ int.from_bytes(small, "little")).bit_count()


def _with_room(pairs: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """Of pairs (a, b) those whose sizes and sketches allow the similarity; all that have it are among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, *both = (batch.column(c).to_pylist() for c in ("n", "sketch_a", "sketch_b"))
            keep = [_differing(a, b) <= (1 - similarity) / (1 + similarity) * k + EPS for k, a, b in zip(n, *both, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    of = lambda side: sketches.select(F.col("e").alias(side), F.col("n").alias(f"n_{side}"), F.col("sketch").alias(f"sketch_{side}"))
    met = pairs.join(of("a"), "a").join(of("b"), "b").where(F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b") - EPS)
    met = met.select("a", "b", (F.col("n_a") + F.col("n_b")).alias("n"), "sketch_a", "sketch_b")
    return met.mapInArrow(run, "a bigint, b bigint")


def _candidates(similarity: float, long_run: int | None):
    """Pairs in the runs of equal keys of a stream sorted by (key, n, e).

    With ``long_run``, rows (0, a, b) are pairs and rows (1, key, e, n, place) pass a long run on, of which only some
    pairs were made. Without it, rows have a column ``part``, and all pairs of unequal parts are made.
    """
    names = ["key", "e", "n", "place"] + ([] if long_run else ["part"])

    def rows(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        none = pa.nulls(len(a), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(np.zeros(len(a), np.int32)), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), none, none], names=["kind", "a", "b", "n", "place"])

    def possible(r: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether what follows the key in either order leaves room for the similarity, if it is the first common member."""
        n, m = r["n"][i].astype(np.int64), r["n"][j].astype(np.int64)
        most = np.minimum(n - r["place"][i], m - r["place"][j])
        return (most >= similarity / (1 + similarity) * (n + m) - EPS) & (r["e"][i] != r["e"][j])

    def pairs(r: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, n = r["key"], r["n"]
        bounds = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        sizes = np.diff(bounds)
        size, first = np.repeat(sizes, sizes), np.repeat(bounds[:-1], sizes)
        long = size > long_run if long_run else np.zeros(len(key), bool)
        live, lag = np.flatnonzero(size > 1), 1
        while len(live):
            live = live[live + lag < len(key)]
            live = live[(key[live] == key[live + lag]) & (n[live] >= similarity * n[live + lag] - EPS) & (~long[live] | (lag <= 4))]
            at = live[possible(r, live, live + lag)]
            if not long_run:
                at = at[r["part"][at] != r["part"][at + lag]]
            if len(at):
                yield rows(r["e"][at], r["e"][at + lag])
            lag += 1
        if long.any():
            late = np.flatnonzero(long)
            for k in range(4):  # with those of the middle size: a large group's origin is mostly there
                to = first[late] + np.minimum(size[late] // 2 + k, size[late] - 1)
                fits = possible(r, late, to)
                yield rows(r["e"][late[fits]], r["e"][to[fits]])
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(late), np.int32)), pa.array(key[late]), pa.array(r["e"][late]), pa.array(n[late]), pa.array(r["place"][late])], names=["kind", "a", "b", "n", "place"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        for batch in batches:
            r = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}
            if not len(r["key"]):
                continue
            end = int(np.searchsorted(r["key"], r["key"][-1], "left"))
            if end or (held and held[-1]["key"][-1] != r["key"][0]):
                held.append({c: v[:end] for c, v in r.items()})
                yield from pairs({c: np.concatenate([h[c] for h in held]) for c in names})
                held = []
            held.append({c: v[end:] for c, v in r.items()})
        if held:
            yield from pairs({c: np.concatenate([h[c] for h in held]) for c in names})

    return run


def _verified(pairs: DataFrame, entries: DataFrame, words: int, similarity: float) -> DataFrame:
    """Of pairs (a, b), as many whose whole sets have the similarity as connect all that have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                a, b = (np.frombuffer(x.as_py(), np.uint64) for x in (a, b))
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(both >= similarity * (len(a) + len(b) - both) - EPS)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    spark = entries.sparkSession
    met, met_path = written(pairs.distinct(), hashes=True)
    ends = lambda of: of.select(F.col("a").alias("e")).union(of.select("b")).distinct()
    own = entries.select("e", "text")
    sketches, sketches_path = written(own.join(ends(met), "e", "left_semi").mapInArrow(_sketches(words), "e bigint, n bigint, sketch binary"), hashes=True)
    pairs, pairs_path = written(_with_room(met, sketches, similarity), hashes=True)
    for p in (met_path, sketches_path):
        drop(spark, p)
    wanted = ends(pairs)
    sets, path = written(own.join(wanted, "e", "left_semi").mapInArrow(_sets(words), "e bigint, s binary, size bigint"), hashes=True)
    number, total = sets.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()

    def verified(pairs: DataFrame) -> DataFrame:
        moved = total + 2 * pairs.count() * total // max(number, 1)
        rounds = max(1, -(-moved // (total // 2 + ROUND_BYTES)))
        out = None
        for r in range(rounds):
            turn = lambda c: F.pmod(F.xxhash64(F.lit(0), c), F.lit(rounds)) == r  # noqa: B023, E731
            own = pairs.where(turn("a"))
            of_a = sets.where(turn("e")).select(F.col("e").alias("a"), F.col("s").alias("s_a"))
            of_b = sets.join(own.select(F.col("b").alias("e")).distinct(), "e", "left_semi").select(F.col("e").alias("b"), F.col("s").alias("s_b"))
            found = cut(own.join(of_a, "a").join(of_b, "b").select("a", "b", "s_a", "s_b").mapInArrow(run, "a bigint, b bigint"), BATCH)
            out = found if out is None else out.union(found)
        return out

    one = pairs.groupBy("a").agg(F.min("b").alias("b")).union(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    one = cut(one.distinct())
    links = verified(one)
    parts = components(links)
    of = lambda side: parts.select(F.col("node").alias(side), F.col("component").alias(f"part_{side}"))
    apart = pairs.join(one, ["a", "b"], "left_anti").join(of("a"), "a", "left").join(of("b"), "b", "left")
    rest = cut(apart.where("coalesce(part_a, a) <> coalesce(part_b, b)").select("a", "b"))
    links = links if rest.isEmpty() else links.union(verified(rest))
    for p in (path, pairs_path):
        drop(spark, p)
    return links


def jaccard_links(entries: DataFrame, words: int = 5, similarity: float = 0.8, long_run: int = 256) -> DataFrame:
    """Links (a, b) among entries (e bigint, text), enough to join all whose sets have the similarity or more."""
    count = entries.count()
    part = entries.select("e", "text").where(F.pmod("e", F.lit(max(1, count // SAMPLE))) == 0)
    often = part.mapInArrow(_members(words), "h bigint").groupBy("h").count().where("count > 2").orderBy(F.desc("count"), "h").limit(FREQUENT).collect()
    frequent = {r.h & (1 << 64) - 1: r["count"] for r in often}
    index = entries.select("e", "text").mapInArrow(_index(words, similarity, frequent), "key bigint, e bigint, n int, place int")
    found = cut(index.repartition("key").sortWithinPartitions("key", "n", "e").mapInArrow(_candidates(similarity, long_run), "kind int, a bigint, b bigint, n int, place int"))
    links = _verified(found.where("kind = 0").select("a", "b"), entries, words, similarity)
    long = found.where("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("e"), "n", "place")
    if long.isEmpty():
        return links
    parts = components(links).select(F.col("node").alias("e"), F.col("component").alias("part"))
    apart = long.join(parts, "e", "left").select("key", "e", "n", "place", F.coalesce("part", "e").alias("part"))
    rest = apart.repartition("key").sortWithinPartitions("key", "n", "e").mapInArrow(_candidates(similarity, None), "kind int, a bigint, b bigint, n int, place int")
    return links.union(_verified(rest.select("a", "b"), entries, words, similarity))


def _print_links(entries: DataFrame, bits: int) -> DataFrame:
    """Links (a, b) among entries (e, fs) that join all whose SimHashes are equal or differ in at most ``bits`` bits."""
    prints = entries.select(F.explode("fs").alias("f"), "e")
    reps = cut(prints.groupBy("f").agg(F.min("e").alias("least")))
    equal = prints.join(reps, "f").where("e <> least").select(F.col("least").alias("a"), F.col("e").alias("b"))
    of = lambda side: reps.select(F.col("f").alias(f"f_{side}"), F.col("least").alias(side))
    near = near_links(reps, bits).select(F.col("a").alias("f_a"), F.col("b").alias("f_b"))
    return cut(equal.union(near.join(of("a"), "f_a").join(of("b"), "f_b").select("a", "b")))


def jaccard_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, long_run: int = 256, bits: int | None = None) -> DataFrame:
    """``docs`` with one document of each connected group: the one with the least id. Rows with a null id stay.

    Repeated rows of the kept id stay as well: they are one document's. A text of up to ``words`` words is one
    shingle; texts without a word (null, empty, white space) are equal. An empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    named = docs.select(id_col, text_col).mapInArrow(_named(words, bits is not None), f"id {kind}, e bigint, f bigint, text string")
    entries, path = written(named.groupBy("e").agg(F.min("id").alias("least"), F.collect_set("f").alias("fs"), F.first("text").alias("text")))
    links = jaccard_links(entries, words, similarity, long_run)
    if bits is not None:
        links = links.union(_print_links(entries, bits))
    parts = cut(components(links)).withColumnRenamed("node", "e")
    known = entries.select("e", "least").join(parts, "e", "left").withColumn("component", F.coalesce("component", "e"))
    name = fresh(docs, "_kept")
    kept = cut(known.groupBy("component").agg(F.min("least").alias(name)).where(F.col(name).isNotNull()).select(name).distinct())
    drop(docs.sparkSession, path)
    named_rows = docs.where(F.col(id_col).isNotNull()).join(kept, F.col(id_col) == F.col(name), "left_semi")
    return named_rows.unionByName(docs.where(F.col(id_col).isNull()))
