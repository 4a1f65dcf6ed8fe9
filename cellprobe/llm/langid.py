"""Language identification by prediction by partial matching.

Per language a variable-order tree of byte contexts (orders 0 to 3) gives each next byte a probability:
counts of the longest known context first, and an escape (method C, seen bytes excluded) to the next
shorter one. The statistics are frozen after training, so the code length of a byte in a context is a
fixed number; all of them are laid out in one table, and the code length of a text in every language is a
sum of looked-up rows. The language with the shortest code wins.

Bounds of training, both parameters of ``train``: ``sample_rows`` labelled rows a language and ``max_rows`` in all, each
with its whole text. Prediction reads whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDER = 3
UNKNOWN = "und"
#: Bytes whose lengths are summed at a time.
_BLOCK = 1 << 18


@dataclass(frozen=True)
class Model:
    languages: list[str]
    #: Symbol of each byte value; 0 stands before the start of a text, ASCII letters are folded.
    symbol: np.ndarray
    #: Node of the longest known context, by the last three symbols.
    node: np.ndarray
    #: Bits of a symbol by node and language: row node * size + symbol.
    bits: np.ndarray
    size: int

    def code_lengths(self, data: bytes) -> np.ndarray:
        """Bits that ``data`` takes in each language."""
        total = np.zeros(len(self.languages))
        a = self.size
        s = np.zeros(len(data) + ORDER, np.int32)
        s[ORDER:] = self.symbol[np.frombuffer(data, np.uint8)]
        for i in range(0, len(data), _BLOCK):
            x = s[i : i + _BLOCK + ORDER]
            row = self.node[(x[:-3] * a + x[1:-2]) * a + x[2:-1]] * a + x[3:]
            total += np.ones(len(row), np.float32) @ self.bits[row]
        return total

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language, its posterior under equal priors, and bits a byte; ``und`` for null or no letter."""
        if not text or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, 0.0
        if not self.languages:
            return UNKNOWN, 0.0, 0.0
        data = text.encode("utf-8", "surrogatepass")
        bits = self.code_lengths(data)
        best = int(np.argmin(bits))
        share = float(1 / np.exp2(np.maximum(bits[best] - bits, -1000)).sum())
        return self.languages[best], share, float(bits[best] / len(data))


def _symbols(texts: list[bytes]) -> tuple[np.ndarray, int, int]:
    """Byte value -> symbol, number of symbols, and how many byte values share the last symbol, 'any other'."""
    seen = np.zeros(256, bool)
    for t in texts:
        seen[np.frombuffer(t, np.uint8)] = True
    fold = np.arange(256)
    fold[65:91] += 32
    kept = sorted({int(fold[b]) for b in np.flatnonzero(seen)})
    number = {b: i + 1 for i, b in enumerate(kept)}
    symbol = np.array([number.get(int(fold[b]), len(kept) + 1) for b in range(256)], np.int32)
    return symbol, len(kept) + 2, max(1, int((symbol == len(kept) + 1).sum()))


def fit(texts: dict[str, list[str]]) -> Model:
    """A model of texts by language; languages in alphabetical order, which also breaks ties."""
    languages = sorted(texts)
    if not languages:
        return Model([], np.zeros(256, np.int32), np.zeros(1, np.int32), np.zeros((1, 0), np.float32), 1)
    raw = {lang: [t.encode("utf-8", "surrogatepass") for t in texts[lang]] for lang in languages}
    symbol, a, others = _symbols([t for ts in raw.values() for t in ts])
    codes = []
    for lang in languages:
        grams = []
        for t in raw[lang]:
            s = np.zeros(len(t) + ORDER, np.int64)
            s[ORDER:] = symbol[np.frombuffer(t, np.uint8)]
            grams.append(((s[:-3] * a + s[1:-2]) * a + s[2:-1]) * a + s[3:])
        codes.append(np.unique(np.concatenate(grams), return_counts=True) if grams else (np.zeros(0, np.int64), np.zeros(0, np.int64)))

    def contexts(k: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By language: contexts of order k, next symbols, counts."""
        out = []
        for code, count in codes:
            u, back = np.unique(code % a ** (k + 1), return_inverse=True)
            out.append((u // a, u % a, np.bincount(back, count, len(u))))
        return out

    # Order -1: every byte value alike; symbol 0 never follows anything.
    base = np.full(a, 1 / 256)
    base[0], base[-1] = 1e-9, others / 256
    probs = np.repeat(base[None, None, :], len(languages), 1)  # nodes of the last order x languages x symbols
    tables, first, lookup = [], 0, np.zeros(1, np.int64)  # lookup: context of the last order -> its node
    for k in range(ORDER + 1):
        per = contexts(k)
        every, back = np.unique(np.concatenate([c for c, _, _ in per]), return_inverse=True)
        parent = probs[lookup[every % a ** (k - 1)]] if k > 1 else np.repeat(probs[:1], len(every), 0)
        now = parent.copy()
        for j, (c, x, n) in enumerate(per):
            at = np.searchsorted(every, c)
            ok = (at < len(every)) & (every[np.minimum(at, len(every) - 1)] == c) if len(every) else np.zeros(len(c), bool)
            counts = np.zeros((len(every), a))
            counts[at[ok], x[ok]] = n[ok]
            total, kinds = counts.sum(1), (counts > 0).sum(1)
            rest = np.where(counts > 0, 0, parent[:, j])
            left = rest.sum(1)
            escape = np.where(left > 0, kinds / np.maximum(total + kinds, 1), 0)
            own = counts / np.maximum(total, 1)[:, None] * (1 - escape)[:, None] + rest / np.maximum(left, 1e-300)[:, None] * escape[:, None]
            now[:, j] = np.where((total > 0)[:, None], own, parent[:, j])
        grown = lookup[np.arange(a**k) % a ** (k - 1)] if k > 1 else np.zeros(a**k, np.int64)
        if k == 0:
            probs, lookup, first = now, np.zeros(1, np.int64), len(now)
            tables.append(now)
            continue
        if k == 1:
            grown = np.zeros(a, np.int64)
        grown[every] = first + np.arange(len(every))
        tables.append(now)
        first += len(now)
        probs, lookup = np.concatenate(tables), grown
    bits = -np.log2(np.maximum(np.concatenate(tables), 1e-12)).astype(np.float32)
    return Model(languages, symbol, lookup.astype(np.int32), np.ascontiguousarray(bits.transpose(0, 2, 1).reshape(-1, len(languages))), a)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that no training may see; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = 400, max_rows: int = 20_000) -> Model:
    """Fit on a bounded sample of the labelled rows that are not held out.

    A row is sampled by a hash of its id, at a rate by language that makes about ``sample_rows`` rows, or an equal
    share of ``max_rows`` where there are many languages; rows with null id, text or language take no part. The
    driver gets whole texts, of about ``max_rows`` rows at most.
    """
    rows = docs.where(F.col(id_col).isNotNull() & ~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}
    if not counts:
        return fit({})
    spread, each = 1 << 30, max(1, min(sample_rows, max_rows // len(counts)))
    rate = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(spread, spread * each // n))])
    chosen = F.pmod(F.xxhash64(F.lit("sample"), F.col(id_col)), F.lit(spread)) < rate[F.col(lang_col)]
    sample = rows.where(chosen).select(lang_col, id_col, text_col)
    texts: dict[str, list[str]] = {}
    for lang, _, text in sorted(map(tuple, sample.collect())):
        texts.setdefault(lang, []).append(text)
    return fit(texts)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, lang_pred, score, bits_per_byte) for every row, from its whole text alone; no shuffle.

    Null texts, empty ones and those without a letter get ``und`` and score 0; repeated rows and null ids stay.
    Other columns of ``docs`` are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the rows it was trained on, not by the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            found = [m.predict(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], pa.float64())], names=[id_col, "held_out", "lang_pred", "score", "bits_per_byte"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, held_out(id_col).alias("held_out"), text_col).mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double, bits_per_byte double")


def predictor(model: Model):
    """A function from a text column to struct (lang_pred, score, bits_per_byte), as ``predict`` finds them.

    Null, empty and letterless texts get ``und``, 0 and 0; every text is read whole.
    """
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("lang_pred string, score double, bits_per_byte double")
    def found(texts: pa.Array) -> pa.Array:
        rows = [model.predict(t.as_py()) for t in texts]
        columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.float64()))]
        return pa.StructArray.from_arrays(columns, names=["lang_pred", "score", "bits_per_byte"])

    return found
