"""SimHash, lines, substrings, top-k, URLs, images, components, pipeline."""

import hashlib
import itertools
import random
from collections import defaultdict

import numpy as np
import pytest
from odd_rows import ODD

from cellprobe.llm import lines, media, shingles, simhash, substrings, topk, urls
from cellprobe.llm.components import components


def grouped(n, links):
    """Least reachable number of each of n nodes."""
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(1, 2), (2, 3), (3, 1), (5, 4), (4, 4), (2, 1)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 60)]])
def test_components(spark, edges):
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    want = grouped(70, edges)
    assert got == {x: want[x] for x in nodes}


def test_shuffle_files_go_with_their_step(spark):
    """A checkpoint's plan was made before the step began, and its shuffle files stayed until some garbage collection."""
    import time

    from cellprobe.llm.io import cut

    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        found = disk.getAllFiles()
        return {n for n in (found.apply(i).getName() for i in range(found.size())) if n.startswith("shuffle_")}

    before = files()
    kept = cut(spark.range(1000).selectExpr("id % 10 AS k").groupBy("k").count().join(spark.range(5).selectExpr("id AS k"), "k"))
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before and kept.count() == 5


# --- SimHash ------------------------------------------------------------------------------------------


def plain_fingerprint(text, k=3):
    import re

    import xxhash

    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_and_groups(spark, documents, empty):
    extra = spark.createDataFrame([r[:2] for r in ODD if r[0] != 5 and r[0] is not None], "doc_id long, text string").selectExpr("doc_id + 100000 AS doc_id", "text")
    docs = documents.select("doc_id", "text").unionByName(extra)
    rows = docs.collect()
    prints = [plain_fingerprint(r.text) for r in rows]
    links = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if (prints[i] ^ prints[j]).bit_count() <= 2]
    least = defaultdict(lambda: 1 << 60)
    for g, r in zip(grouped(len(rows), links), rows, strict=True):
        least[g] = min(least[g], r.doc_id)
    want = sorted((r.doc_id, f"{p:016x}", least[g]) for r, p, g in zip(rows, prints, grouped(len(rows), links), strict=True))
    assert sorted(map(tuple, simhash.simhash_groups(docs).collect())) == want
    assert simhash.simhash_groups(empty).count() == 0


@pytest.mark.parametrize(("distance", "long_run"), [(2, 1024), (2, 4), (1, 4)])
def test_no_link_is_lost(spark, distance, long_run):
    rng = random.Random(3)
    prints = []
    for _ in range(120):
        x = rng.choice([0, 0xFFFF0000FFFF0000, 0x123456789ABCDEF0])
        for _ in range(rng.randint(0, 5)):
            x ^= 1 << rng.randrange(64)
        prints.append(x - (1 << 64) if x >> 63 else x)
    prints = sorted(set(prints))
    links = [(i, j) for i, j in itertools.combinations(range(len(prints)), 2) if ((prints[i] ^ prints[j]) & (1 << 64) - 1).bit_count() <= distance]
    found = dict(map(tuple, components(simhash.near_links(spark.createDataFrame([(p,) for p in prints], "f long"), distance, long_run)).collect()))
    assert [found.get(p, p) for p in prints] == [prints[g] for g in grouped(len(prints), links)]


def test_near_dedup_keeps_columns(odd):
    out = simhash.near_dedup(odd)
    assert out.columns == odd.columns
    kept = sorted((r.doc_id or 0) for r in out.collect())
    assert kept == [0, 1, 1, 2, 4, 5, 7]  # 3 and 6 have no word, as 2; the null id stays


# --- shingles -----------------------------------------------------------------------------------------


@pytest.mark.parametrize("long_run", [256, 5])
def test_jaccard_dedup_against_brute_force(spark, empty, long_run):
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(3000)}"
    notice = [word() for _ in range(40)]  # in many texts that are otherwise different
    texts = [None, "", " \t", "one two", "One  two", "one two three"]
    for _ in range(40):
        base = [word() for _ in range(rng.randint(30, 300))] + (notice if rng.random() < 0.5 else [])
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 3)):
            copy = list(base)
            for _ in range(max(1, int(len(base) * rng.uniform(0.002, 0.03)))):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    centre = [word() for _ in range(150)]
    for _ in range(60):  # a group of which most are only similar to some others
        copy = list(centre)
        for _ in range(rng.randint(1, 4)):
            copy[rng.randrange(150)] = word()
        texts.append(" ".join(copy))
    rng.shuffle(texts)
    rows = list(enumerate(texts)) + [(None, texts[0]), (3, texts[3])]

    def members(text):
        w = (text or "").lower().split()
        return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [members(t) for t in texts]
    alike = lambda a, b: 1.0 if a == b else len(a & b) / len(a | b)
    scored = [(i, j, alike(sets[i], sets[j])) for i, j in itertools.combinations(range(len(sets)), 2)]
    assert sum(0.8 <= s < 0.95 for *_, s in scored) > 100 and sum(0.7 < s < 0.8 for *_, s in scored) > 100
    groups = grouped(len(sets), [(i, j) for i, j, s in scored if s >= 0.8])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [r.doc_id for r in shingles.jaccard_dedup(df, long_run=long_run).collect()]
    want = sorted(set(groups)) + [3] * (groups[3] == 3)
    assert kept.count(None) == 1 and sorted(x for x in kept if x is not None) == sorted(want)
    assert shingles.jaccard_dedup(empty).count() == 0


def test_near_dedup_stage_takes_near_copies(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(9)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    copy = [*base[:60], "other", *base[61:130], "words", *base[131:]]
    rows = [(1, " ".join(base)), (2, " ".join(copy)), (3, " ".join(reversed(base)))]
    out = corpus_pipeline.near_dedup_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in out.collect()) == [1, 3]


def test_near_dedup_stage_links_near_simhashes(spark):
    """Texts within two bits of SimHash go though they share few shingles in order: their sets of five words differ."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    part, other = "a b c d e f g h i j k l m", "n o p q r s t u v w x y z"
    rows = [(1, " ".join([part] * 40)), (2, " ".join([part] * 40 + [other])), (3, other)]
    prints = [plain_fingerprint(t) for _, t in rows]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for _, t in rows]
    assert (prints[0] ^ prints[1]).bit_count() <= 2 and len(sets[0] & sets[1]) < 0.8 * len(sets[0] | sets[1])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, df, "").collect()) == [1, 3]
    assert sorted(r.doc_id for r in shingles.jaccard_dedup(df).collect()) == [1, 2, 3]


def test_jaccard_sets_travel_in_rounds(spark, monkeypatch):
    """A group of near copies has pairs by the square of its size; sets went along with each."""
    monkeypatch.setattr(shingles, "ROUND_BYTES", 1000)
    rng = random.Random(5)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    texts = [" ".join([*base[:i], "x", *base[i + 1 :]]) for i in range(0, 200, 4)]
    entries = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "e long, text string")
    links = shingles.jaccard_links(entries).collect()
    assert len({min(r) for r in links} | {max(r) for r in links}) == 50 and len(links) < 50 * 49 / 8
    assert set(dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect())).values()) == {0}


def test_shingle_sketches_rule_out_no_similar_sets(spark, monkeypatch):
    """Whole sets went along with every candidate; now only with those whose sketches leave room."""
    rng, texts = random.Random(6), []
    for n in (1, 3, 40, 66, 130, 300, 520):
        for _ in range(3):
            base = [f"w{rng.randrange(5000)}" for _ in range(n)]
            texts.append(" ".join(base))
            for share in (0.005, 0.02, 0.03, 0.1):
                texts.append(" ".join(w if rng.random() > share else "other" for w in base) + " end" * rng.randrange(n // 8 + 1))
    sets = [set(shingles._set(t, 5).tolist()) for t in texts]
    pairs = list(itertools.combinations(range(len(texts)), 2))
    similar = {(i, j) for i, j in pairs if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9}
    entries = spark.createDataFrame(list(enumerate(texts)), "e long, text string")
    sketches = entries.mapInArrow(shingles._sketches(5), "e bigint, n bigint, sketch binary").cache()
    met = spark.createDataFrame(pairs, "a long, b long")
    room = {tuple(r) for r in shingles._with_room(met, sketches, 0.8).collect()}
    assert len(similar) > 30 and similar <= room and len(room) < 2 * len(similar)
    travelled = []
    monkeypatch.setattr(shingles, "written", lambda df, *a, f=shingles.written, **b: travelled.append(df.columns) or f(df, *a, **b))
    links = {tuple(r) for r in shingles._verified(met, entries, 5, 0.8).collect()}
    assert links <= similar and travelled.index(["e", "n", "sketch"]) < travelled.index(["e", "s", "size"])
    both = [dict(map(tuple, components(spark.createDataFrame(sorted(x), "a long, b long")).collect())) for x in (links, similar)]
    assert both[0] == both[1]


# --- lines --------------------------------------------------------------------------------------------


def normal(line):
    import regex

    return regex.sub(r"[^\p{L}\p{N}]+", " ", line.lower()).strip(" ")


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def plain_line_removal(docs, similarity=0.8):
    """(id, line) of the lines that go, by comparing all pairs."""
    places = defaultdict(list)
    for i, text in docs:
        for n, line in enumerate((text or "").split("\n")):
            if normal(line):
                places[normal(line)].append((i, n))
    lines_ = list(places)

    def units(x):
        return x.split(" ") if x.count(" ") >= 4 else list(x) if len(x) >= 20 else None

    parts = [units(x) for x in lines_]
    close = lambda a, b: a and b and edits(a, b) <= int((1 - similarity) * max(len(a), len(b)) + 1e-9)
    links = [(i, j) for i, j in itertools.combinations(range(len(lines_)), 2) if close(parts[i], parts[j])]
    groups = defaultdict(list)
    for g, x in zip(grouped(len(lines_), links), lines_, strict=True):
        groups[g] += places[x]
    return {p for g in groups.values() for p in g} - {min(g) for g in groups.values()}


@pytest.mark.parametrize("run", [32, 3])
def test_lines_against_brute_force(spark, monkeypatch, run):
    monkeypatch.setattr(lines, "RUN", run)
    rng = random.Random(4)
    pool = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta"]) + str(rng.randint(0, 40)) for _ in range(rng.randint(4, 60))) for _ in range(30)]
    docs = []
    for i in range(60):
        own = []
        for _ in range(rng.randint(0, 6)):
            line = rng.choice(pool)
            if rng.random() < 0.4:
                w = line.split()
                w[rng.randrange(len(w))] += "x"
                line = " ".join(w)
            own.append(rng.choice([line, line.upper() + "!", "", "short line"]))
        docs.append((i, "\n".join(own)))
    want = plain_line_removal(docs)
    got = set(map(tuple, lines.removed_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()))
    assert got <= want and len(got) >= 0.97 * len(want) > 50


def test_line_recall_by_characters(spark, documents):
    """Of all pairs of real lines with an edit similarity of 0.8 in characters, nine in ten end in one group."""
    from pyspark.sql import functions as F

    found = lines._lines(documents, "doc_id", "text", 5, 20).select("id", "line", "k1", "k2")
    raw = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "raw")).select("doc_id", F.trim(lines._normal("raw")).alias("norm")).where("length(norm) BETWEEN 1 AND 400").select("norm").distinct().cache()
    a, b = raw.select(F.col("norm").alias("a")), raw.select(F.col("norm").alias("b"))
    longer = F.greatest(F.length("a"), F.length("b"))
    near = (F.col("a") < F.col("b")) & (F.least(F.length("a"), F.length("b")) >= 0.8 * longer)
    pairs = [tuple(r) for r in a.repartition(8).crossJoin(F.broadcast(b)).where(near).withColumn("most", F.floor(0.2 * longer + 1e-9).cast("int")).where("levenshtein(a, b, most) >= 0").selectExpr("xxhash64(a)", "xxhash64(b)").collect()]
    entries, _ = lines.written(lines._entries(lines._lines(documents, "doc_id", "text", 5, 20)))
    group = dict(map(tuple, components(lines._links(documents, "doc_id", "text", entries, 5, 20, 0.8, 24)).collect()))
    joined = sum(x in group and group[x] == group.get(y) for x, y in pairs)
    assert found.count() and len(pairs) > 20 and joined >= 0.9 * len(pairs)


def test_edit_similarity_at_its_bound(spark):
    rows = [(n + d, "a" * (n - n // 5 - d) + "b" * (n // 5 + d), "a" * n) for n in (50, 100, 200, 1000) for d in (0, 1)]
    coded = spark.createDataFrame([(k * 2 + i, r[1 + i]) for k, r in enumerate(rows) for i in (0, 1)], "k1 long, code string")
    pairs = spark.createDataFrame([(k * 2, k * 2 + 1) for k in range(len(rows))], "a long, b long")
    assert sorted(r.a for r in lines._verified(pairs, coded, 0.8).collect()) == [0, 4, 8, 12]


@pytest.mark.parametrize("run", [32, 3])
def test_lines_with_changed_words(spark, monkeypatch, run):
    monkeypatch.setattr(lines, "RUN", run)
    rng = random.Random(6)
    word = lambda: "".join(rng.choice(["an", "the", "or", "is", "ti", "re", "wha", "en"]) for _ in range(rng.randint(1, 4)))
    docs, at = [], 0
    for n in (8, 10, 12, 15, 20, 30):
        for _ in range(25):
            base = [word() for _ in range(n)]
            changed = list(base)
            changed[rng.randrange(n)] += "x"
            docs += [(at, " ".join(base)), (at + 1, " ".join(changed))]
            at += 2
    centre = [word() for _ in range(40)]
    group = [(1000 + i, " ".join([*centre[:i], "other", *centre[i + 1 :]])) for i in range(40)]
    df = spark.createDataFrame(docs + group, "doc_id long, text string")
    found = {r.id for r in lines.removed_lines(df).collect()}
    assert not {i for i in found if i < 1000 and i % 2 == 0}
    assert len([i for i in found if i < 1000]) >= 0.95 * len(docs) / 2
    assert {i for i in found if i >= 1000} == set(range(1001, 1040))


def test_lines_odd_rows(spark, odd, empty):
    out = lines.line_dedup(odd)
    assert out.columns == odd.columns and out.count() == len(ODD)
    by_id = {r.doc_id: r for r in out.collect()}
    # The null id comes first; both rows of id 1 repeat it.
    assert by_id[None].text and by_id[1].text == "" and by_id[2].text is None and by_id[3].text == "" and by_id[5].text == ODD[6][1]
    assert lines.line_digest(empty).count() == 0
    clashing = odd.selectExpr("doc_id", "text", "id AS ID_", "1 AS _gone", "2 AS _key", "3 AS Line", "4 AS K1", "5 AS _text", "6 AS _row")
    renamed = clashing.withColumnRenamed("ID_", "ID").withColumn("n_lines_removed", clashing._gone + 6)
    got = lines.line_dedup(renamed)
    assert got.columns == renamed.columns and {r.n_lines_removed for r in got.collect()} == {7} and {r._gone for r in got.collect()} == {1}
    many = spark.createDataFrame([(1, "\n".join(f"line number {i} of a text" for i in range(3000))), (2, "\n".join(f"line number {i} of a text" for i in range(3000)))], "doc_id long, text string")
    assert {r.doc_id: r.text == "" for r in lines.line_dedup(many).collect()}[2]


def test_lines_of_a_common_feature(spark, monkeypatch):
    """Pairs that share one feature only, which a long run shares: two were asked for, and of longer runs the least entry."""
    monkeypatch.setattr(lines, "RUN", 8)
    monkeypatch.setattr(lines, "PART", 5)
    rng = random.Random(7)
    rows = []
    for e in range(60):  # 30 pairs of like SimHashes, in one run; the other features of all differ
        if e % 2 == 0:
            sim, bits = rng.getrandbits(63), rng.getrandbits(63) | 1
        rows.append((e, 0, sim ^ (e % 2) * (1 << rng.randrange(63)), bits, 50, [1, *(1000 + e * 5 + i for i in range(5))]))
    entries = spark.createDataFrame(rows, "k1 long, k2 long, sim long, bits long, len int, blocks array<long>")
    want = {(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if (a[2] ^ b[2]).bit_count() <= 24 and (a[3] & b[3]).bit_count() >= lines.LEAST_SHARE * min(a[3].bit_count(), b[3].bit_count())}
    pairs, long, path = lines._candidates(entries, 0.8, 24)
    first = {tuple(r) for r in pairs.collect()}
    rest = {tuple(r) for r in lines._unconnected(long, pairs.where("a = 0"), 0.8, 24).collect()}
    assert first <= want and {(e, e + 1) for e in range(0, 60, 2)} <= want
    joined = {x for r in first if 0 in r for x in r} | {0}
    assert rest == {(a, b) for a, b in want if not (a in joined and b in joined)}


def test_sketches_rule_out_no_similar_lines(spark):
    """Of the lines of a long run all close pairs were verified; now those that can't be similar are left out, and no other."""
    from pyspark.sql import functions as F

    rng, texts = random.Random(8), []
    for n in (5, 6, 9, 12, 20, 33, 60):
        for _ in range(4):
            base = ["w" + str(rng.randrange(500)) for _ in range(n)]
            texts.append(base)
            for _ in range(4):
                own = list(base)
                for _ in range(n // 5):
                    at = rng.randrange(len(own))
                    own[at : at + 1] = rng.choice([[], ["new"], ["new", own[at]]])
                texts.append(own)
    docs = spark.createDataFrame([(i, " ".join(ws)) for i, ws in enumerate(texts)], "doc_id long, text string")
    entries = lines._entries(lines._lines(docs, "doc_id", "text", 5, 20)).cache()
    coded = lines._coded(docs, "doc_id", "text", entries, entries.select("k1"), 5, 20).cache()
    pairs = coded.alias("a").join(coded.alias("b"), F.col("a.k1") < F.col("b.k1"))
    longer = "greatest(length(a.code), length(b.code))"
    rows = pairs.select("a.k1", F.col("b.k1").alias("k2"), F.expr(f"levenshtein(a.code, b.code) <= floor({longer} - 0.8D * {longer} + 1e-9D)").alias("similar"), lines._room(0.8).alias("room")).collect()
    assert sum(r.similar for r in rows) > 100 and all(r.room for r in rows if r.similar)
    assert sum(r.room for r in rows if not r.similar) < 0.02 * len(rows)
    long = coded.selectExpr("k1 AS e", "1L AS key", "0L AS sim", "1L AS bits", "50 AS len", "128L AS n")
    got = {tuple(r) for r in lines._unconnected(long, spark.createDataFrame([], "a long, b long"), 0.8, 24, coded=coded).collect()}
    assert got == {(r.k1, r.k2) for r in rows if r.room}


def test_long_runs_make_links_only(spark):
    """The join of a long run made all pairs that sketches leave, which were verified after it; it makes links only."""
    rng, texts = random.Random(9), []
    for n in (5, 8, 14, 30, 90):
        for _ in range(3):
            base = ["w" + str(rng.randrange(40)) for _ in range(n)]
            for edited in (0, n // 5, n // 5, n // 5 + 1, n // 4 + 1):
                texts.append([f"new{rng.randrange(9)}" if i in set(rng.sample(range(n), edited)) else w for i, w in enumerate(base)])
    docs = spark.createDataFrame([(i, " ".join(ws)) for i, ws in enumerate(texts)], "doc_id long, text string")
    entries = lines._entries(lines._lines(docs, "doc_id", "text", 5, 20)).cache()
    coded = lines._coded(docs, "doc_id", "text", entries, entries.select("k1"), 5, 20).cache()
    long = coded.selectExpr("k1 AS e", "explode(array(1L, 2L)) AS key", "0L AS sim", "1L AS bits", "50 AS len", "128L AS n")
    none = spark.createDataFrame([], "a long, b long")
    got = {tuple(r) for r in lines._unconnected(long, none, 0.8, 24, coded=coded, verify=True).collect()}
    code = dict(map(tuple, coded.select("k1", "code").collect()))
    pairs = [(a, b) for a, b in itertools.combinations(sorted(code), 2)]
    assert got == {(a, b) for a, b in pairs if edits(code[a], code[b]) <= int(0.2 * max(len(code[a]), len(code[b])) + 1e-9)}
    met = {tuple(r) for r in lines._unconnected(long, none, 0.8, 24, coded=coded).collect()}
    assert 20 < len(got) < len(met)
    part = spark.createDataFrame([(a, b) for a, b in got], "a long, b long")
    assert lines._unconnected(long, part, 0.8, 24, coded=coded, verify=True).count() == 0


# --- substrings ---------------------------------------------------------------------------------------


def plain_removal(rows, length=50):
    key = lambda i: 2**63 - 1 if i is None else i
    first, out = {}, []
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            first[w] = min(first.get(w, 2**64), key(i))
    for i, b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < key(i):
                gone[p : p + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), sum(g and (not j or not gone[j - 1]) for j, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("sizes", [(12 << 20, 500_000), (1500, 40)])
def test_substrings(spark, monkeypatch, sizes):
    monkeypatch.setattr(substrings, "BATCH_BYTES", sizes[0])
    monkeypatch.setattr(substrings, "BUCKET_ENTRIES", sizes[1])
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcdefgh é\n") for _ in range(n))
    shared = [text(rng.randint(45, 200)) for _ in range(10)]
    rows = []
    for i in range(90):
        parts = []
        for _ in range(rng.randint(0, 6)):
            s = rng.choice(shared)
            parts.append(rng.choice([text(rng.randint(0, 80)), s, s[rng.randint(0, 30) :], s[: -rng.randint(1, 30)], s[:60] + "Z" + s[61:], "a" * rng.randint(40, 160)]))
        rows.append((rng.choice([i, i // 2]), "".join(parts)))
    rows += [(None, shared[0]), (None, shared[0]), (3, None), (4, ""), (1000, shared[1] * 3), (1001, shared[2][:49]), (1002, shared[2][:50])]
    got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(tuple, got), key=repr) == plain_removal(rows)


def test_substrings_odd_rows(odd, empty):
    rows = substrings.remove_repeats(odd.where("doc_id is null or doc_id <> 5"), with_text=True).collect()
    assert len(rows) == len(ODD) - 1 and {r.n_removed for r in rows if r.doc_id == 1} == {0}
    assert next(r for r in rows if r.doc_id is None).n_removed == len(ODD[0][1]) and next(r.kept for r in rows if r.doc_id is None) == b""
    assert substrings.remove_repeats(empty).count() == 0


# --- top-k --------------------------------------------------------------------------------------------


@pytest.mark.parametrize("sizes", [{}, {"shard_rows": 60, "query_block": 3}])
def test_topk(spark, sizes):
    rng = np.random.default_rng(6)
    rows = [(int(i), [float(x) for x in rng.integers(-3, 4, 5) / 4]) for i in range(-150, 250)]  # many ties
    rows += [(100, rows[250][1]), (100, [0.5] * 5), (7, [2.0] * 5), (7, [3.0] * 5), (300, [0.0] * 5), (1100, [1.0]), (1200, [])]  # ids of several rows
    rows += [(i, [0.25, 0.5, 0.25, 0.0, 0.0]) for i in range(2000, 2150)]  # one vector of many rows
    odd = [(700, None), (800, [1.0, None, 0.0, 0.0, 0.0]), (900, [float("nan")] * 5), (1000, [float("inf")] * 5), (None, [1.0] * 5)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").selectExpr("*", "1 AS _id", "2 AS rank", "3 AS _row")
    ints = [(i, np.pad(np.floor(1024 * np.array(v)).astype(int), (0, 5 - len(v)))) for i, v in rows]
    want = []
    for n, (q, x) in enumerate(ints):
        if q % 100 == 0:
            best = sorted((-int(x @ v), i) for m, (i, v) in enumerate(ints) if m != n)[:10]
            want += [(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)]
    assert sorted(map(tuple, topk.top_k(df, **sizes).collect())) == sorted(want)
    assert topk.top_k(df.limit(0)).count() == 0


def test_topk_oracle_takes_repeated_ids(spark):
    import duckdb
    import pandas as pd

    rows = [(0, [1.0, 2.0]), (1, [2.0, 1.0]), (1, [3.0, 0.0]), (0, [0.5, 0.5]), (None, [1.0, 1.0]), (2, None)]
    embeddings = pd.DataFrame({"vec_id": pd.array([r[0] for r in rows], "Int64"), "embedding": [r[1] for r in rows]})
    want = duckdb.connect().register("embeddings", embeddings).execute(topk.ORACLE).fetchall()
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == sorted(want) and len(want) == 6


def test_topk_huge_components(spark):
    df = spark.createDataFrame([(0, [1e6, 1.0]), (1, [3e38, 1.0]), (2, [1e13, 5.0])], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk.top_k(df, k=2).collect()]
    assert [(r[2], r[3]) for r in sorted(got)] == [(1, 2**63 - 1), (2, 1024**2 * (10**19 + 5))] or sorted(got)[0][3] == 2**63 - 1


# --- URLs ---------------------------------------------------------------------------------------------

URLS = ["http://example.com/en/x", "https://WWW.Example.COM/en/", "http://a.www.example.com/en/1", "http://foo.net/es/1?x#y", "http://net/fr/", "http://xnet/fr/", "http://spam-farm.example.org/en", "ftp://a.org/ads/x", "http://a.org/loads/x", "http://a.org/tracking", "http://a.org/tracking-x", "no scheme", "", None, "http://", "http://com", "http://com/", "http://a.org/EN/", "://b.com/x", "http://a.com:80/x", "http://example.com/EN/x", "http://a.org/banner/q/r.gif", "http://a.org/banner/q.gifs", "http://x://y.com/"]


def test_urls(spark):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(0, URLS[0]), (None, URLS[1])]
    df = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 AS host", "2 AS _row")
    got = urls.judge(df).collect()
    assert len(got) == len(rows)
    rules = [(v, *r.partition("/")[::2], r) for v, r in urls.HOST_RULES]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    texts = dict(rows[: len(URLS)]) | {None: URLS[1]}
    for r in got:
        import re

        url = texts[r.page_id] or ""
        rest = url.partition("://")[2] if "://" in url else ""
        host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
        host = host.translate(lower)
        fits = [(len(text), text, v) for v, h, p, text in rules if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        want = max(fits, default=None)
        assert (r.host, r.path, r.rule) == (host, path, want and want[1]), url
        assert r.verdict == (want[2] if want else "block" if r.pattern else "allow")
    verdicts = {u: next(r.verdict for r in got if r.page_id == i) for i, u in enumerate(URLS)}
    blocked = {"http://example.com/en/x", "http://foo.net/es/1?x#y", "http://net/fr/", "http://spam-farm.example.org/en", "ftp://a.org/ads/x", "http://a.org/tracking", "http://a.org/banner/q/r.gif"}
    assert {u for u, v in verdicts.items() if v == "block"} == blocked
    assert urls.judge(df.limit(0)).count() == 0


def test_rule_without_a_whole_token(spark):
    df = spark.createDataFrame([(1, "http://a.org/xads"), (2, "http://a.org/y")], "page_id long, url string")
    assert [r.verdict for r in urls.judge(df, [urls.pattern_rule("block", "ads")]).orderBy("page_id").collect()] == ["block", "allow"]


def test_urls_run_no_python(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    plan = urls.judge(df)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow")) and "html" not in plan


# --- images -------------------------------------------------------------------------------------------


def test_media(spark):
    rng = np.random.default_rng(1)

    def picture(h=120, w=140):
        x = np.kron(rng.integers(0, 256, (h // 4 + 1, w // 4 + 1)).astype(float), np.ones((4, 4)))[:h, :w]
        return np.clip(media._box(x, 1) / 9, 0, 255).astype(np.uint8)

    base = [picture() for _ in range(8)]
    edited = base[5].copy()
    edited[40:80, 50:90] = 7
    rows = [(i, media.encode(b)) for i, b in enumerate(base)]
    rows += [(100, media.encode(base[0][20:100, 30:130])), (101, media.encode(np.minimum(base[1].astype(int) + 30, 255))), (102, media.encode(np.rot90(base[2]))), (103, rows[3][1]), (104, None), (105, b"junk"), (None, rows[4][1]), (106, media.encode(np.zeros((3, 3)))), (107, media.encode(edited)), (3, rows[3][1])]
    df = spark.createDataFrame(rows, "id long, image binary").selectExpr("*", "1 AS pixels")
    got = media.copy_classes(df).collect()
    assert len(got) == len(rows)
    classes = {r.id: r.class_id for r in got}
    assert classes == {**{i: i for i in range(8)}, 100: 0, 101: 1, 102: 2, 103: 3, 104: 104, 105: 105, None: 4, 106: 106, 107: 5}
    assert media.copy_classes(df.limit(0)).count() == 0


def test_no_image_link_is_lost_in_long_runs(spark, monkeypatch):
    """Corners of one descriptor on all images: a corner met the first four and the next four of its run only."""
    monkeypatch.setattr(media, "PART", 20)
    rng, rows, places = np.random.default_rng(4), [], {}
    for i in range(48):
        like = {11: 3, 40: 22, 41: 22, 30: 29}.get(i)
        own = places[like] + 9 if like is not None else rng.integers(0, 4000, (8, 2))
        places[i] = own
        f = np.zeros(8, media._FEATURE)
        f["x"], f["y"] = own[:, 0], own[:, 1]
        f["d"] = np.arange(8) << 34 | 5  # the low half of all is equal
        f["d"][5:] += np.uint64(i // 2 % 3) << np.uint64(50)
        rows.append((i, f.tobytes()))
    entries = spark.createDataFrame(rows, "id long, corners binary")
    whole = dict(map(tuple, components(media.image_links(entries, all_pairs=10**6)).collect()))
    assert whole[11] == 3 and whole[40] == whole[41] == 22 and whole[30] == 29 and len(whole) == 7
    for all_pairs in (4, 16, 64):
        assert dict(map(tuple, components(media.image_links(entries, all_pairs=all_pairs)).collect())) == whole


def test_png():
    import struct
    import zlib

    grey = np.arange(48, dtype=np.uint8).reshape(6, 8)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + b"0000"
    raw = b"".join(bytes([2 if y else 1]) + bytes((int(v) - int(grey[y - 1, x] if y else grey[y, x - 1] if x else 0)) & 255 for x, v in enumerate(line)) for y, line in enumerate(grey))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 8, 6, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    assert (media.decode(png) == grey).all() and (media.decode(media.encode(grey)) == grey).all()


# --- pipeline -----------------------------------------------------------------------------------------


def test_pipeline(spark, odd, vocabulary):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    whole = docs.unionByName(spark.createDataFrame([(90001, None, "en", "s", 0), (90002, "12 34 !!", "en", "s", 8)], docs.schema))
    stages = dict(corpus_pipeline.STAGES)
    assert len(stages) in (4, 5)
    kept = whole
    for name, stage in list(stages.items())[:-1]:
        kept = stage(spark, kept, "").cache()
        assert kept.schema.names == docs.schema.names, name
        if name == "language ID":
            assert {r.doc_id for r in whole.select("doc_id").collect()} - {r.doc_id for r in kept.select("doc_id").collect()} == {90001, 90002}
    assert {r.doc_id for r in corpus_pipeline.packing(spark, kept, "").select("doc_id").collect()} == {r.doc_id for r in kept.select("doc_id").collect()}
    assert all(r.n_chars == len(r.text) for r in kept.collect())
    for stage in stages.values():
        stage(spark, docs.limit(0), "").collect()


def plain_pipeline(docs, vocabulary):
    """(id, text) that is to reach packing, stage by stage over all pairs. Texts of one language all pass the first."""
    from cellprobe.llm.secrets import guess_cost, spans

    kept = [(i, t) for i, t in docs if t and any(map(str.isalpha, t))]
    gone = plain_line_removal(kept)
    kept = [(i, t, "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone)) for i, t in kept]
    kept = [(i, new) for i, old, new in kept if new == old or new.strip()]
    sets = []
    for _, t in kept:
        w = t.lower().split()
        sets.append({tuple(w[n : n + 5]) for n in range(max(1, len(w) - 4))})
    links = [(a, b) for a, b in itertools.combinations(range(len(kept)), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9]
    kept = [kept[n] for n, g in enumerate(grouped(len(kept), links)) if n == g]
    cost, out = guess_cost(vocabulary), []
    for i, t in kept:
        for a, _, b in reversed(spans(t, cost, 40.0)):
            t = t[:a] + "<SECRET>" + t[b:]
        out.append((i, t))
    return out


def test_pipeline_against_brute_force(spark, vocabulary, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from tokenizers import Tokenizer

    rng = random.Random(8)
    word = lambda: "".join(rng.choice(["la", "re", "mi", "ton", "es", "qui", "ver", "dor"]) for _ in range(rng.randint(1, 4)))
    sentence = lambda n: " ".join(word() for _ in range(n))
    shared = sentence(12)
    docs = [(i, "\n".join(sentence(rng.randint(6, 30)) for _ in range(rng.randint(1, 5)))) for i in range(30)]
    docs += [(100, shared + "\n" + sentence(20)), (101, sentence(15) + "\n" + shared.upper()), (102, None), (103, "12 34"), (104, ""), (105, docs[3][1])]
    docs += [(106, "\n".join(x + " end" for x in docs[4][1].split("\n"))), (107, "password = hunter2hunter and " + sentence(9)), (108, sentence(5000))]
    long = [sentence(40) for _ in range(2)]
    docs += [(110, long[0] + "\n" + long[1]), (111, " ".join(long[0].split()[:20]) + "\n" + " ".join(long[0].split()[20:]) + " " + long[1])]
    rows = [(i, t, "xx", "s", len(t or "")) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    want = dict(plain_pipeline(docs, vocabulary))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == set(want)
    encode = Tokenizer.from_file(vocabulary).encode
    lengths = defaultdict(int)
    for r in got:
        lengths[r.doc_id] += r.length
    assert lengths == {i: len(encode(t, add_special_tokens=False).ids) + 1 for i, t in want.items()}
    by_sequence = defaultdict(list)
    for r in got:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for own in by_sequence.values():
        assert [a for a, _ in sorted(own)] == [sum(n for _, n in sorted(own)[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 4096


def test_stages_bear_odd_rows(spark, odd):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    clashing = odd.selectExpr("doc_id", "text", "lang", "1 AS _found", "2 AS _removed", "3 AS n_lines_removed", "4 AS _kept", "5 AS E", "6 AS ID")
    docs = clashing
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        assert {(r._found, r._removed, r.n_lines_removed, r._kept) for r in out.collect()} <= {(1, 2, 3, 4)}
        docs = out
    assert None in {r.doc_id for r in docs.collect()}
    assert corpus_pipeline.packing(spark, clashing, "").count() >= len(ODD)
