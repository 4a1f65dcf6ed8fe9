"""BPE encoding by a dynamic program over prefixes.

Every prefix of a word has one last token in its BPE encoding. An automaton over the vocabulary, whose
states are the longest suffix read that starts some token, lists the tokens that end at each position; the
one that is compatible with the last token of the prefix before it is stored, and following the
back-pointers from the end of the word yields the ids. Two tokens are compatible if undoing their merges in
falling rank meets no merge across their border that BPE would have made earlier.

Entries of short prefixes, which many words share, and encodings of words that are not long are remembered per Python
worker in tables of bounded size (``Encoder.PREFIXES``, ``Encoder.REMEMBERED``).
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import struct
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Code points of this offset stand for a byte symbol that ends a word.
_FINAL = 0x10000
_ENCODERS: dict[str, "Encoder"] = {}
_LIBRARY_ENCODERS: dict[str, "LibraryEncoder"] = {}


def _byte_symbols() -> list[str]:
    """The printable stand-in of each byte value: printable Latin-1 stands for itself, the rest follows from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class _Memo(dict):
    """A key's value, computed on first use. Holds ``most`` entries at most: of two generations, the older one goes
    when the younger one is full, and what is asked for again moves to the younger. Strings of over ``longest``
    characters are not kept."""

    def __init__(self, make, most: int, longest: int | None = None):
        super().__init__()
        self.make, self.half, self.older, self.longest = make, max(1, most // 2), {}, longest

    def __missing__(self, key):
        if self.longest and len(key) > self.longest:
            return self.make(key)
        if len(self) >= self.half:
            self.older = self.copy()
            self.clear()
        out = self.older.get(key)
        if out is None:
            out = self.make(key)
        self[key] = out
        return out


def _in_latin(pattern: str) -> str:
    """``pattern`` for the standard module, which is faster: its classes spelt out for the characters of Latin-1."""
    import regex

    for name in (r"\s", r"\p{L}", r"\p{N}"):
        own = "".join(f"\\x{c:02x}" for c in range(256) if regex.match(name, chr(c)))
        pattern = pattern.replace(f"[{name}]", f"[{own}]").replace(name, own)
    return pattern


class Splitter:
    """Splits texts into words as the normalizer and the pre-tokenizer of a ``tokenizers`` file prescribe."""

    #: Ranges in which all Unicode versions of the last years agree on letters, digits and case; texts beyond go through the library's own splitter.
    AGREED = r"[\x00-\u052F\u1E00-\u1FFF\u2010-\u205F\u20A0-\u20BF\u2100-\u214F\u2190-\u23FF\u2500-\u27BF\u3000-\u3029\u3041-\u3096\u30A1-\u30FA\u4E00-\u9FEF\uAC00-\uD7A3\uFF00-\uFFEF\U0001F300-\U0001F64F]*+"

    def _read(self, path: str) -> dict:
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path = path
        self.specials: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(split).findall
        self.latin_words = re.compile(_in_latin(split)).findall
        self.agreed = regex.compile(self.AGREED).fullmatch
        self.symbols = _byte_symbols()
        return spec

    def shown_bytes(self, word: str) -> str:
        """The word's bytes by their stand-ins."""
        return word if word.isascii() and word.isprintable() else "".join(map(self.symbols.__getitem__, word.encode()))

    def split(self, text: str) -> list[str]:
        """Words of a text without special tokens: NFC, lower case, then the file's own pattern."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            pass
        else:  # always NFC, and Latin-1 when lowered
            return self.latin_words(text.lower())
        if not self.agreed(text):
            return self._library_split(text)
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        text = text.replace("Σ", "σ")  # each character is lowered by itself, without a final form
        return self.words(text.lower())

    @functools.cached_property
    def _library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _library_split(self, text: str) -> list[str]:
        text = self._library.normalizer.normalize_str(text)
        return [text[a:b] for _, (a, b) in self._library.pre_tokenizer.pre_tokenize_str(text)]

    def _parts(self, text: str) -> Iterator[tuple[list[str], str | None]]:
        """Words up to each special token, and that token."""
        start = 0
        if self.special and "<|" in text:
            for m in self.special.finditer(text):
                yield self.split(text[start : m.start()]), m.group()
                start = m.end()
        yield self.split(text[start:]), None


class Encoder(Splitter):
    """Encodes and decodes as a ``tokenizers`` BPE file with word-end suffix and byte-level symbols prescribes."""

    REMEMBERED = 600_000
    PREFIXES = 500_000
    PAIRS = 400_000
    #: Prefixes of up to so many symbols are shared among words, and words of up to so many characters are remembered.
    SHARED, LONGEST = 48, 200
    def __init__(self, path: str):
        model = self._read(path)["model"]
        self.suffix = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.text_of = {i: t.encode() for t, i in [*self.vocab.items(), *self.specials.items()]}
        size = 1 + max(self.vocab.values())
        self.rank, self.left, self.right = [-1] * size, list(range(size)), list(range(size))
        self.merged: dict[int, int] = {}
        for r, (a, b) in enumerate(model["merges"]):
            a, b, t = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.rank[t], self.left[t], self.right[t] = r, a, b
            self.merged[a << 20 | b] = r
        self.fits = _Memo(lambda key: self._compatible(key >> 20, key & 0xFFFFF, size), self.PAIRS)
        # A token that BPE itself never makes of its own text takes no part.
        self.token_of = {self._key(t): i for t, i in self.vocab.items() if self.rank[i] < 0 or self._compatible(self.left[i], self.right[i], self.rank[i])}
        self.starts = {key[:n] for key in self.token_of for n in range(1, len(key) + 1)}
        self.state = _Memo(self._state, 2 * len(self.starts))
        #: By prefix of a short word: its automaton state, its last token, and the entry of the prefix before that token.
        self.prefixes: dict[str, tuple] = {}
        self.packed = [i.to_bytes(4, "little") for i in range(size)]
        self.ids = _Memo(self._word_bytes, self.REMEMBERED, self.LONGEST)
        self.shown = _Memo(lambda w: self.decode_bytes(self.ids[w]), self.REMEMBERED, self.LONGEST)

    def _key(self, token: str) -> str:
        if token.endswith(self.suffix) and len(token) > len(self.suffix):
            body = token[: -len(self.suffix)]
            return body[:-1] + chr(ord(body[-1]) + _FINAL)
        return token

    def _compatible(self, a: int, b: int, limit: int) -> bool:
        """Whether BPE, were it to end with tokens a and b side by side, makes no merge of rank under ``limit`` across them."""
        rank, left, right, merged = self.rank, self.left, self.right, self.merged
        while True:
            r = merged.get(a << 20 | b)
            if r is not None and r < limit:
                return False
            ra, rb = rank[a], rank[b]
            if ra < 0 and rb < 0:
                return True
            # The later of the two merges is undone first; of equal ones the right one was made later.
            if ra > rb:
                limit, a = ra, right[a]
            else:
                limit, b = rb + 1, left[b]

    def _state(self, read: str) -> tuple[str, tuple[tuple[int, int], ...]]:
        """The longest suffix of ``read`` that starts a token, and the (length, token) that end with it, longest first."""
        while read and read not in self.starts:
            read = read[1:]
        found = ((len(read) - i, self.token_of.get(read[i:])) for i in range(len(read)))
        return read, tuple((n, t) for n, t in found if t is not None)

    def _entry(self, symbol: str, now: str, at: int, entry_of, word: str) -> tuple:
        """The entry of the prefix that ends with ``symbol`` at position ``at``, after state ``now``; ``entry_of`` has those before by length."""
        now, ends = self.state[now + symbol]
        for length, token in ends:
            before = entry_of(at + 1 - length) if length <= at else None
            if before is None or self.fits[before[1] << 20 | token]:
                return now, token, before
        raise ValueError(f"no token ends at {at} of {word!r}")

    def word_ids(self, word: str) -> list[int]:
        """Ids of one word of the pre-tokenizer. Time and memory grow with its length."""
        s = self.shown_bytes(word)
        last = len(s) - 1
        if len(self.prefixes) + last > self.PREFIXES:
            self.prefixes.clear()
        if last >= self.SHARED:  # entries of its own: prefixes as keys would take the square of its length
            path: list[tuple] = [("", -1, None)]
            for i in range(last):
                path.append(self._entry(s[i], path[i][0], i, path.__getitem__, word))
            entry = self._entry(chr(ord(s[last]) + _FINAL), path[last][0], last, path.__getitem__, word)
        else:
            known, fits, state = self.prefixes, self.fits, self.state
            # The longest prefix that is known, with entries for all shorter ones.
            have = last
            entry = known.get(s[:have])
            while have and entry is None:
                have -= 1
                entry = known.get(s[:have])
            now = entry[0] if have else ""
            for i in range(have, last + 1):
                now, ends = state[now + (s[i] if i < last else chr(ord(s[i]) + _FINAL))]
                for length, token in ends:
                    before = known[s[: i + 1 - length]] if length <= i else None
                    if before is None or fits[before[1] << 20 | token]:
                        break
                else:
                    raise ValueError(f"no token ends at {i} of {word!r}")
                entry = (now, token, before)
                if i < last:
                    known[s[: i + 1]] = entry
        out = []
        while entry:
            out.append(entry[1])
            entry = entry[2]
        out.reverse()
        return out

    def _word_bytes(self, word: str) -> bytes:
        return b"".join(map(self.packed.__getitem__, self.word_ids(word)))

    def encode_bytes(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; nothing for null."""
        out = []
        for words, special in self._parts(text or ""):
            out.extend(map(self.ids.__getitem__, words))
            if special:
                out.append(self.specials[special].to_bytes(4, "little"))
        return b"".join(out)

    def decode_bytes(self, ids: bytes) -> bytes:
        """The text of ids, special tokens included: there is no decoder in the file, so tokens are joined by a space."""
        return b" ".join([self.text_of[int.from_bytes(ids[i : i + 4], "little")] for i in range(0, len(ids), 4)])

    def encode_and_decode(self, text: str | None) -> tuple[bytes, bytes]:
        """Both at once: what a word's ids decode to is remembered with them."""
        ids, shown = [], []
        for words, special in self._parts(text or ""):
            ids.extend(map(self.ids.__getitem__, words))
            shown.extend(map(self.shown.__getitem__, words))
            if special:
                ids.append(self.specials[special].to_bytes(4, "little"))
                shown.append(special.encode())
        return b"".join(ids), b" ".join(shown)


class LibraryEncoder(Splitter):
    """Encodes with the library's own model, a word once while it is remembered."""

    REMEMBERED, LONGEST = 300_000, 200
    #: Texts of so many characters are encoded together.
    TOGETHER = 1 << 21

    def __init__(self, path: str):
        self._read(path)
        self.tokenize = self._library.model.tokenize
        self.ids = _Memo(self._word_bytes, self.REMEMBERED, self.LONGEST)

    def _word_bytes(self, word: str) -> bytes:
        ids = [t.id for t in self.tokenize(self.shown_bytes(word))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _together(self, texts: list[str]) -> Iterator[bytes]:
        split = [list(self._parts(t)) for t in texts]
        # Each different word of these texts is looked up once: a small table is read far faster than the large one.
        different: set[str] = set()
        for parts in split:
            for words, _ in parts:
                different.update(words)
        of = {w: self.ids[w] for w in different}
        for parts in split:
            yield b"".join([b"".join(map(of.__getitem__, words)) + (self.specials[s].to_bytes(4, "little") if s else b"") for words, s in parts])

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; nothing for null."""
        held, size = [], 0
        for text in texts:
            held.append(text or "")
            size += len(held[-1])
            if size >= self.TOGETHER:
                yield from self._together(held)
                held, size = [], 0
        yield from self._together(held)


def library_encoder(path: str) -> LibraryEncoder:
    """The worker's library encoder of a file."""
    if path not in _LIBRARY_ENCODERS:
        _LIBRARY_ENCODERS[path] = LibraryEncoder(path)
    return _LIBRARY_ENCODERS[path]


def encoder(path: str) -> Encoder:
    """The worker's encoder of a file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def bpe_digest(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every whole text; one row per input row, no shuffle.

    Null text counts as empty: no tokens, digests of nothing. Repeated rows and null ids are kept as they are;
    other columns of the input are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            counts, ids_sha, text_sha = [], [], []
            for text in batch.column(1):
                ids, shown = enc.encode_and_decode(text.as_py())
                counts.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(shown).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def bpe_encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ids themselves: (id, ids array<int>) per row; null text gives an empty array."""
    import numpy as np

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            ids = [np.frombuffer(enc.encode_bytes(t.as_py()), np.int32) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def bpe_decode(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Texts of id arrays: (id, text) per row; a null array gives null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            texts = [None if (v := x.as_py()) is None else b" ".join(enc.text_of[i] for i in v).decode() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, text string")
