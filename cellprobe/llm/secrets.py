"""Secret scans: fixed patterns, and guess costs of the values that stand in a credential context.

A value's guess cost is the least sum, over its segmentations, of the bits of its segments: words (of a
frequency-ranked vocabulary, plain or with usual substitutions), dates, repeats, walks on the keyboard, and
brute-force spans. A dynamic program over end positions finds it. A value of at least ``min_bits`` bits that
follows a credential name is a secret of kind ``guess``. Matches of the fixed patterns always count.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("assign", "access", "hex", "guess")

# --- Fixed values -------------------------------------------------------------------------------------
#: Patterns by kind, in the order in which kinds are listed.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24
#: Names after which a value counts as a credential, beyond those of ASSIGN, and what may stand between.
CONTEXT = r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|auth(?:orization)?|bearer)["']?(?:\x20*[:=]\x20*|\x20+is\x20+|\x20+)["']?([!-~]{8,})"""
CONTEXT_HINTS = ("pass", "pwd", "secret", "token", "api", "key", "credential", "auth", "bearer")
KEYBOARD_ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
SUBSTITUTIONS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
DATES = (
    r"(?=((?:19|20)\d\d(?:([-/._]?)(?:0[1-9]|1[0-2])\2(?:0[1-9]|[12]\d|3[01]))?))",
    r"(?=((?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d))",
)
# ------------------------------------------------------------------------------------------------------

_LEET = str.maketrans(SUBSTITUTIONS)
_WORDS: dict[str, "GuessCost"] = {}


class GuessCost:
    """Least bits of a value under the segment kinds above."""

    SEGMENT_BITS = 2.0  # which kind of segment comes next
    LONGEST_UNIT = 8  # of a repeat

    def __init__(self, ranks: dict[str, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks), default=0)
        self.next_to = {}
        for y, row in enumerate(KEYBOARD_ROWS):
            for x, key in enumerate(row):
                near = {row[x + d] for d in (-1, 1) if 0 <= x + d < len(row)}
                for dy in (-1, 1):
                    if 0 <= y + dy < len(KEYBOARD_ROWS):
                        other = KEYBOARD_ROWS[y + dy]
                        near |= {other[x + d] for d in ((0, 1) if dy < 0 else (0, -1)) if 0 <= x + d < len(other)}
                self.next_to[key] = near

    @staticmethod
    def brute(s: str) -> float:
        """Bits a character of an alphabet of the classes that occur."""
        kinds = 26 * bool(re.search("[a-z]", s)) + 26 * bool(re.search("[A-Z]", s)) + 10 * bool(re.search("[0-9]", s)) + 33 * bool(re.search("[^A-Za-z0-9]", s))
        return math.log2(max(kinds, 2))

    def segments(self, s: str) -> Iterator[tuple[int, int, float, str]]:
        """(start, end, bits, kind) of every word, date, repeat and walk in s."""
        low, n = s.lower(), len(s)
        plain = low.translate(_LEET)
        for i in range(n):
            for j in range(i + 3, min(n, i + self.longest) + 1):
                for form, extra in ((low[i:j], 0.0), (plain[i:j], 2.0)):
                    rank = self.ranks.get(form)
                    if rank is not None and (not extra or form != low[i:j]):
                        case = 0.0 if s[i:j] == low[i:j] else 1.0 if s[i:j].istitle() or s[i:j].isupper() else float(j - i)
                        yield i, j, math.log2(rank + 2) + extra + case, "word"
        for date in DATES:
            for m in re.finditer(date, s):
                yield m.start(), m.end(1), math.log2(366 * 120), "date"
        # The shortest unit that is repeated at i, as often as it goes; same[u] counts the characters from i on that
        # equal those u later, so that long repeats take no longer.
        same = [0] * (self.LONGEST_UNIT + 1)
        for i in range(n - 1, -1, -1):
            unit = 0
            for u in range(self.LONGEST_UNIT, 0, -1):
                same[u] = same[u] + 1 if i + u < n and s[i] == s[i + u] else 0
                if same[u] >= u:
                    unit = u
            if unit and (whole := unit * (same[unit] // unit + 1)) >= 3:
                yield i, i + whole, unit * self.brute(s[i : i + unit]) + math.log2(whole), "repeat"
        i = 0
        while i < n:
            j = i + 1
            while j < n and low[j] in self.next_to.get(low[j - 1], ()):
                j += 1
            if j - i >= 4:
                yield i, j, math.log2(len(self.next_to)) + math.log2(4) * (j - i - 1) / 2, "walk"
            i = max(j - 1, i + 1)

    def bits(self, s: str) -> float:
        n, each = len(s), self.brute(s)
        ending: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for i, j, bits, _ in self.segments(s):
            ending[j].append((i, bits))
        best = [0.0] * (n + 1)  # best[j]: least bits of s[:j]
        span = [0.0] * (n + 1)  # of those whose last segment is a brute-force span
        for j in range(1, n + 1):
            span[j] = min(best[j - 1] + self.SEGMENT_BITS, span[j - 1] if j > 1 else math.inf) + each
            best[j] = min([span[j], *(best[i] + self.SEGMENT_BITS + bits for i, bits in ending[j])])
        return best[n]


def guess_cost(vocabulary: str) -> GuessCost:
    """The worker's costs with words and ranks of a BPE vocabulary file: a token's id follows its frequency rank."""
    if vocabulary not in _WORDS:
        with open(vocabulary, encoding="utf-8") as f:
            model = json.load(f)["model"]
        end = model.get("end_of_word_suffix") or ""
        words = sorted((i, t[: -len(end)]) for t, i in model["vocab"].items() if end and t.endswith(end) and t[: -len(end)].isalpha() and t.isascii() and len(t) - len(end) >= 3)
        _WORDS[vocabulary] = GuessCost({w: r for r, (_, w) in enumerate(words)})
    return _WORDS[vocabulary]


_FOLDED = re.ASCII | re.IGNORECASE
_ASSIGN, _CONTEXT = re.compile(ASSIGN, _FOLDED), re.compile(rf"(?<![A-Za-z0-9]){CONTEXT}", _FOLDED)
# Greedy runs: one under the least length fails from each of its starts, so the length can stand in the pattern.
_ACCESS, _HEX = re.compile(ACCESS), re.compile(f"[0-9a-f]{{{MIN_HEX},}}")
_JOINED, _JOINT = re.compile(r"[A-Za-z]+(?:[-'/][A-Za-z]+)*"), re.compile("[-'/]")
_SET = re.compile("[:=]")
_LETTERS = ("password", "passwd", "secret", "token", "apikey", "api_key")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns' matches, sorted."""
    low = text.lower()
    out = []
    if any(w in low for w in _LETTERS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def spans(text: str | None, cost: GuessCost, min_bits: float) -> list[tuple[int, int, int]]:
    """Base spans and, by the method, values in a credential context that no base span touches."""
    if not text:
        return []
    out = base_spans(text)
    low = text.lower()
    starts = [a for a, _, _ in out]
    ends = list(itertools.accumulate((b for _, _, b in out), max))  # the furthest end of the spans so far
    guessed = []
    if any(w in low for w in CONTEXT_HINTS):
        for m in _CONTEXT.finditer(text):
            value = m[1].rstrip(".,;:!?)]}\"'")
            start, end = m.start(1), m.start(1) + len(value)
            before = bisect.bisect_left(starts, end)
            if len(value) < 8 or (before and ends[before - 1] > start):
                continue
            # Where only blanks or "is" come before, joined words can be prose: they cost what the costliest of them does.
            prose = _JOINED.fullmatch(value) and not _SET.search(text, m.start(), start)
            if max(map(cost.bits, _JOINT.split(value) if prose else [value])) >= min_bits:
                guessed.append((start, 3, end))
    return sorted(out + guessed)


def shown(found: list[tuple[int, int, int]]) -> str:
    """kind:start:end, comma-joined, in code points with the end exclusive."""
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def scan(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", min_bits: float = 40.0) -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans, n_guess) of every whole text; no shuffle.

    Null text counts as empty: no spans, the digest of nothing. Repeated rows and null ids stay; other
    columns of ``docs`` are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost = guess_cost(vocabulary)
        for batch in batches:
            found = [spans(t.as_py(), cost, min_bits) for t in batch.column(1)]
            counts = [pa.array([sum(k == kind for _, k, _ in f) for f in found], pa.int64()) for kind in range(4)]
            base = [hashlib.sha256(shown([s for s in f if s[1] < 3]).encode()).hexdigest() for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts[:3], pa.array(base, pa.string()), pa.array(list(map(shown, found)), pa.string()), counts[3]], names=[id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_guess bigint")


def redact(docs: DataFrame, vocabulary: str, text_col: str = "text", min_bits: float = 40.0, mark: str = "<SECRET>") -> DataFrame:
    """``docs`` with every span replaced by ``mark``; overlapping spans become one mark, other columns stay.

    Null and empty texts stay as they are; rows are judged one by one, so repeated rows fare alike, and the work on a
    text grows with its length. An empty table gives no rows.
    """
    from pyspark.sql import functions as F
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("string")
    def cleaned(texts: pa.Array) -> pa.Array:
        cost, out = guess_cost(vocabulary), []
        for t in texts:
            t = t.as_py()
            found = spans(t, cost, min_bits)
            if found:
                parts, at = [], 0
                for a, _, b in found:
                    if a >= at:
                        parts += [t[at:a], mark]
                    at = max(at, b)
                t = "".join([*parts, t[at:]])
            out.append(t)
        return pa.array(out, pa.string())

    return docs.withColumn(text_col, cleaned(F.col(text_col)))
