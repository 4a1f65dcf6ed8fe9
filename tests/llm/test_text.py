"""Language ID, BPE, packing, secrets."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from odd_rows import ODD
from tokenizers import Tokenizer

from cellprobe.llm import langid, secrets
from cellprobe.llm.bpe import bpe_decode, bpe_digest, bpe_encode, encoder
from cellprobe.llm.packing import pack, plan


# --- language ID --------------------------------------------------------------------------------------


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs)
    found = langid.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(found) > 200 and sum(r.lang_pred == r.lang for r in found) >= 0.98 * len(found)
    assert all(0 <= r.score <= 1 for r in found)


def test_language_held_out_split(odd):
    got = {(r.doc_id, r.held_out) for r in odd.select("doc_id", langid.held_out().alias("held_out")).collect()}
    assert got == {(i, i is not None and zlib.crc32(str(i).encode()) % 4 == 2) for i in {r[0] for r in ODD}}


def test_language_odd_rows(odd, empty):
    model = langid.fit({"en": ["the cat and the dog " * 20], "fr": ["le chat et le chien " * 20]})
    rows = langid.predict(odd, model).collect()
    assert len(rows) == len(ODD)
    by_text = {r.doc_id: r for r in rows if r.doc_id in (2, 3, 4, 6)}
    assert all(r.lang_pred == "und" and r.score == 0 for r in by_text.values())
    assert langid.predict(empty, langid.train(empty)).count() == 0
    assert {r.lang_pred for r in langid.predict(odd, langid.fit({})).collect()} == {"und"}


def test_ppm_probabilities_sum_to_one():
    model = langid.fit({"a": ["abracadabra abra"], "b": ["banana band"]})
    p = np.exp2(-model.bits.reshape(-1, model.size, 2).astype(float))
    assert np.allclose(p.sum(1), 1, atol=1e-3)


def test_ppm_equals_plain_ppm():
    """Code lengths against a direct walk down the orders with escapes and exclusions."""
    train, text = "the cat sat on the mat with the hat", "the bat ate that"
    model = langid.fit({"x": [train], "y": ["completely other words"]})
    sym = lambda t: [0, 0, 0, *model.symbol[np.frombuffer(t.encode(), np.uint8)].tolist()]
    seen = sym(train)
    counts = defaultdict(Counter)
    for i in range(3, len(seen)):
        for k in range(4):
            counts[tuple(seen[i - k : i])][seen[i]] += 1
    alphabet = range(1, model.size)
    base = {a: (1 / 256 if a < model.size - 1 else 1 - (model.size - 2) / 256) for a in alphabet}
    base[model.size - 1] = int((model.symbol == model.size - 1).sum()) / 256

    def prob(context, a):
        c = counts.get(tuple(context))
        shorter = (lambda s: prob(context[1:], s)) if context else (lambda s: base[s])
        if not c:
            return shorter(a)
        n, d = sum(c.values()), len(c)
        rest = sum(shorter(s) for s in alphabet if s not in c)
        escape = d / (n + d) if rest > 0 else 0
        return c[a] / n * (1 - escape) if a in c else escape * shorter(a) / rest

    s = sym(text)
    want = -sum(np.log2(prob(s[i - 3 : i], s[i])) for i in range(3, len(s)))
    assert model.code_lengths(text.encode())[0] == pytest.approx(want, rel=1e-3)


# --- BPE ----------------------------------------------------------------------------------------------

WORDS = st.text(st.sampled_from("abcdehinorstTHE' 0123é漢ß😀<|>!?.\n\u0085Σİ"), max_size=40)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=30), WORDS, WORDS.map(lambda s: s + "<|endoftext|>" + s)))
def test_bpe_is_the_library(text):
    from public_tokenizers import path

    enc, lib = encoder(path("word_bpe_49k.json")), _library(path("word_bpe_49k.json"))
    text = text.encode("utf-8", "ignore").decode()
    want = lib.encode(text, add_special_tokens=False).ids
    ids, shown = enc.encode_and_decode(text)
    assert np.frombuffer(ids, "<u4").tolist() == want and ids == enc.encode_bytes(text)
    assert shown.decode() == lib.decode(want, skip_special_tokens=False) == enc.decode_bytes(ids).decode()


_LIBRARIES = {}


def _library(path):
    return _LIBRARIES.setdefault(path, Tokenizer.from_file(path))


def test_bpe_on_documents(documents, vocabulary):
    lib = _library(vocabulary)
    texts = {r.doc_id: r.text or "" for r in documents.collect()}
    for r in bpe_digest(documents, vocabulary).collect():
        ids = lib.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_small_tables_change_nothing(vocabulary, monkeypatch):
    from cellprobe.llm.bpe import Encoder

    monkeypatch.setattr(Encoder, "PREFIXES", 8)
    monkeypatch.setattr(Encoder, "REMEMBERED", 3)
    monkeypatch.setattr(Encoder, "PAIRS", 5)
    small, lib = Encoder(vocabulary), _library(vocabulary)
    for text in ("supercalifragilistic expialidocious words", "a" * 100, "un deux trois quatre cinq"):
        assert np.frombuffer(small.encode_bytes(text), "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids


def test_bpe_odd_rows(odd, empty, vocabulary):
    rows = bpe_digest(odd, vocabulary).collect()
    assert len(rows) == len(ODD) and {r.n_tokens for r in rows if r.doc_id in (2, 3)} == {0}
    assert next(r.ids_sha256 for r in rows if r.doc_id == 2) == hashlib.sha256(b"").hexdigest()
    assert bpe_digest(empty, vocabulary).count() == 0
    back = bpe_decode(bpe_encode(odd.where("doc_id = 1"), vocabulary), vocabulary).first().text
    assert back.startswith("plain</w> words</w>")


# --- packing ------------------------------------------------------------------------------------------


@given(st.integers(1, 60).flatmap(lambda cap: st.tuples(st.just(cap), st.dictionaries(st.integers(1, cap), st.integers(1, 25), max_size=25))))
def test_plan_is_gapless_and_complete(case):
    capacity, counts = case
    bins, seen = defaultdict(list), Counter()
    for length, rank, number, first, offset in plan(counts, capacity):
        assert rank == seen[length]
        seen[length] += number
        for j in range(number):
            bins[first + j].append((offset, length))
    assert dict(seen) == counts
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    plain = []  # best fit, one document at a time
    for length in sorted((x for x, n in counts.items() for _ in range(n)), reverse=True):
        fit = [i for i, left in enumerate(plain) if left >= length]
        if fit:
            plain[min(fit, key=plain.__getitem__)] -= length
        else:
            plain.append(capacity - length)
    assert len(bins) == len(plain)


def test_packing(documents, odd, empty, vocabulary):
    lib = _library(vocabulary)
    for docs in (documents, odd):
        texts = Counter(r.text or "" for r in docs.collect())
        want = Counter()
        for text, n in texts.items():
            ids = [*lib.encode(text, add_special_tokens=False).ids, 1]
            for piece, at in enumerate(range(0, len(ids), 4096)):
                part = np.array(ids[at : at + 4096], "<u4")
                want[piece, at, len(part), zlib.crc32(part.tobytes())] += n
        rows = pack(docs, vocabulary).collect()
        assert Counter((r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
        spans = defaultdict(list)
        for r in rows:
            spans[r.sequence_id].append((r.offset, r.length))
        for s in spans.values():
            at = 0
            for offset, length in sorted(s):
                assert offset == at
                at += length
            assert at <= 4096
        assert len(spans) <= 1.05 * sum(r.length for r in rows) / 4096 + 1
    assert pack(empty, vocabulary).count() == 0


# --- secrets ------------------------------------------------------------------------------------------


def _base(text):
    """The patterns as given, run plainly."""
    either = lambda w: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
    names = "|".join([either("password"), either("passwd"), either("secret"), either("token"), either("api") + "_?" + either("key")])
    out = [(m.start(), 0, m.end()) for m in re.finditer(rf"""({names})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return sorted(out)


PARTS = st.sampled_from(["password", "PASSWORD=", "ſecret: abcdef", "to\u212aen=abcdef", "Api_Key : 'abcdefg'", "token=", " ", "abc123", "f" * 30, "AKIA", "Q" * 16, "é", "secret:x", "apikey=\"1234567\"", "\n"])


@given(st.lists(PARTS, max_size=14).map("".join))
def test_base_spans(text):
    assert secrets.base_spans(text) == _base(text)


def test_scan(documents, odd, empty, vocabulary):
    for docs in (documents, odd):
        texts = {r.doc_id: r.text or "" for r in docs.collect()}
        for r in secrets.scan(docs, vocabulary).collect():
            base = _base(texts[r.doc_id])
            assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == i for _, k, _ in base) for i in range(3))
            assert r.base_sha256 == hashlib.sha256(secrets.shown(base).encode()).hexdigest()
            assert set(secrets.shown(base).split(",")) <= set(r.spans.split(",")) | {""}
    assert secrets.scan(empty, vocabulary).count() == 0


def test_guess_costs(vocabulary):
    cost = secrets.guess_cost(vocabulary)
    for weak in ("password", "qwertyuiop", "19871224", "abcabcabc", "aaaaaaaaaaaa"):
        assert cost.bits(weak) < 30 < cost.bits("xK9#mQ2$vL8!")
    found = secrets.spans("The password is xK9#mQ2$vL8! and the pass is something. password hunter", cost, 40.0)
    assert [(k, a) for a, k, _ in found] == [(3, 16)]


def test_letters_are_costed(vocabulary):
    cost = secrets.guess_cost(vocabulary)
    for text, start in (("pwd=xkqzvjwpmhgtrbnd", 4), ("passphrase: QhWdkLpoZmvbnTyR", 12), ("private_key = KJhgfdSaPoIuYtReWqZx", 14), ("passphrase=correct-horse-battery-staple", 11), ("the pwd is xkqzvjwpmhgtrbnd", 11)):
        assert secrets.spans(text, cost, 40.0) == [(start, 3, len(text))], text
    for text in ("a pass through-out the state", "the pwd is state-of-the-art, or so", "authorization requirements", "pwd: something"):
        assert secrets.spans(text, cost, 40.0) == [], text


def test_long_values_are_one_value(vocabulary):
    cost = secrets.guess_cost(vocabulary)
    for n in (100, 300, 520, 20_000):
        assert cost.bits("=" * n) < 25 and secrets.spans("bearer " + "-" * n, cost, 40.0) == []
    assert secrets.spans("bearer " + "-" * 300 + "xK9#mQ2$vL8w", cost, 40.0) == [(7, 3, 319)]
    for text in ("aaaa", "abababa", "xabcabcabcy", "aab", "abcdefghabcdefgh", "abcdefghiabcdefghi"):
        want = {(m.start(), m.start() + len(m[1])) for m in re.finditer(r"(?=((.{1,8}?)\2+))", text) if len(m[1]) >= 3}
        assert {(a, b) for a, b, _, kind in cost.segments(text) if kind == "repeat"} == want


@settings(max_examples=60)
@given(st.text(st.sampled_from("ab12qwert!"), min_size=1, max_size=9))
def test_least_cost_is_least(text):
    from public_tokenizers import path

    cost = secrets.guess_cost(path("word_bpe_49k.json"))
    each, known = cost.brute(text), {}
    for a, b, bits, _ in cost.segments(text):
        known[a, b] = min(known.get((a, b), 1e9), bits)

    def least(i):
        if i == len(text):
            return 0.0
        return min(min(cost.SEGMENT_BITS + (j - i) * each, cost.SEGMENT_BITS + known.get((i, j), 1e9)) + least(j) for j in range(i + 1, len(text) + 1))

    assert cost.bits(text) == pytest.approx(least(0))


def test_redact(spark, odd, vocabulary):
    docs = spark.createDataFrame([(1, 'x token = "abcdef123" y'), (2, None), (3, "fine")], "doc_id long, text string")
    assert [r.text for r in secrets.redact(docs, vocabulary).orderBy("doc_id").collect()] == ['x <SECRET>" y', None, "fine"]
    assert secrets.redact(odd, vocabulary).columns == odd.columns



def test_long_words_in_linear_time(vocabulary):
    import random
    import time

    from tokenizers import Tokenizer

    from cellprobe.llm.bpe import encoder

    enc, library = encoder(vocabulary), Tokenizer.from_file(vocabulary)
    rng = random.Random(3)
    for word in ("a" * 5000, "x1" * 2000, "é" * 700, "".join(rng.choice("abcdefgh") for _ in range(4000)), "q" * 48, "q" * 49, "q" * 47):
        want = library.encode(word, add_special_tokens=False).ids
        assert enc.encode_bytes(word) == b"".join(i.to_bytes(4, "little") for i in want)
    began = time.process_time()
    enc.encode_bytes("a" * 500_000)
    assert time.process_time() - began < 30 and len(enc.prefixes) < 1000


def test_library_encoder_against_library(vocabulary):
    import random

    from tokenizers import Tokenizer

    from cellprobe.llm.bpe import encoder, library_encoder

    rng, library = random.Random(2), Tokenizer.from_file(vocabulary)
    pool = "".join(map(chr, range(256))) + " aé's\u0152\u03a3\u0130\u00bd\u212a "
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["x<|endoftext|>y", None, "", "\x1c\x1d a\x85b\xa0c", "it's we'LL 'S", "a" * 50_000, "word " * 300_000]
    want = [b"".join(i.to_bytes(4, "little") for i in library.encode(t or "", add_special_tokens=False).ids) for t in texts]
    assert list(library_encoder(vocabulary).encode_all(texts)) == want
    assert [encoder(vocabulary).encode_bytes(t) for t in texts] == want


def test_packing_keeps_a_small_table(vocabulary):
    """Packing left tables of up to 600,000 words and 500,000 prefixes in a worker, which the next stage's memory paid for."""
    from cellprobe.llm import bpe

    enc = bpe.LibraryEncoder(vocabulary)
    list(enc.encode_all(" ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}{chr(97 + i // 17576 % 26)}q" for i in range(at, at + 100_000)) for at in range(0, 456_976, 100_000)))
    assert 0 < len(enc.ids) + len(enc.ids.older) <= enc.REMEMBERED and not hasattr(enc, "prefixes")
