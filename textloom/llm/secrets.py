"""Secret scans: fixed patterns, and a randomness test battery for tokens that no pattern names.

For a candidate token the encoding is inferred from its characters. Two questions are asked of it. Is it random: a
chi-squared test of alphabet uniformity, a runs test about the alphabet's middle and a lag-one serial correlation, all
under the inferred alphabet, give a p-value (Bonferroni over the three). Is it not text: character
coincidences, changes between digits, capitals and small letters (in tokens of letters: capitals side by side), and the
membership of the whole token in a small alphabet (in tokens of letters: rare ones) give a p-value under a model of ordinary words. Evidence grows with length by itself. Over all candidates of a
document the second p-values go through a Benjamini-Hochberg step whose weights come from the length and the first ones.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.batches import id_and_text, map_rows, quoted, strings

KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}(?![A-Za-z0-9+/_=-])")

_SEGMENTS = re.compile(r"(?:[a-z][a-z_-]+/)*")

# Inferred encodings, the smallest alphabet that holds a token first, in its own order.
_DIGITS, _SMALL, _CAPITAL = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = (
    ("hex", _DIGITS + "abcdef"),
    ("HEX", _DIGITS + "ABCDEF"),
    ("small", _SMALL),
    ("CAPITAL", _CAPITAL),
    ("base32", _CAPITAL + "234567"),
    ("base36", _DIGITS + _SMALL),
    ("BASE36", _DIGITS + _CAPITAL),
    ("letters", _CAPITAL + _SMALL),
    ("base62", _CAPITAL + _SMALL + _DIGITS),
    ("base64", _CAPITAL + _SMALL + _DIGITS + "+/"),
    ("base64url", _CAPITAL + _SMALL + _DIGITS + "-_"),
)
_ALPHABETS = tuple((name, {c: k for k, c in enumerate(letters)}) for name, letters in ENCODINGS)

#: Ordinary words: chance that two characters agree, that neighbours differ in class, that letters of words run together
#: are neighbouring capitals, that one is one of the six rarest, and that one is in [0-9a-f].
TEXT_COINCIDENCE, TEXT_CHANGE, TEXT_CAPITALS, TEXT_RARE, TEXT_HEX = 0.066, 0.08, 0.06, 0.05, 0.36


def _normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _chi_tail(x: float, df: int) -> float:
    """Upper tail of chi-squared (Wilson and Hilferty's cube root)."""
    return _normal_tail(((x / df) ** (1 / 3) - 1 + 2 / (9 * df)) / math.sqrt(2 / (9 * df)))


def _binomial_tail(k: int, n: int, p: float) -> float:
    """P(at least k of n)."""
    return min(1.0, sum(math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log1p(-p)) for j in range(k, n + 1)))


def infer_encoding(token: str) -> tuple[str, dict[str, int]] | None:
    """The first encoding whose alphabet holds every character."""
    held = set(token)
    return next(((name, letters) for name, letters in _ALPHABETS if held <= letters.keys()), None)


def randomness(token: str, letters: dict[str, int]) -> float:
    """P-value of the hypothesis that the token is random over ``letters``; small means: not random."""
    n, k = len(token), len(letters)
    at = [letters[c] for c in token]
    counts = Counter(at)
    uniform = _chi_tail(sum(v * v for v in counts.values()) * k / n - n, k - 1)
    high = [2 * x >= k for x in at]
    ups = sum(high)
    if 0 < ups < n:
        mean = 2 * ups * (n - ups) / n + 1
        spread = math.sqrt(max(1e-9, (mean - 1) * (mean - 2) / (n - 1)))
        runs = 2 * _normal_tail(abs(1 + sum(a != b for a, b in zip(high, high[1:], strict=False)) - mean) / spread)
    else:
        runs = 2.0 ** (1 - n)
    mid = sum(at) / n
    power = sum((x - mid) ** 2 for x in at)
    serial = 2 * _normal_tail(abs(sum((a - mid) * (b - mid) for a, b in zip(at, at[1:], strict=False)) / power + 1 / n) * math.sqrt(n)) if power else 0.0
    return min(1.0, 3 * min(uniform, runs, serial))


def wordlikeness(token: str, name: str) -> float:
    """P-value of the hypothesis that the token is made of ordinary words; small means: not text."""
    n = len(token)
    pairs = n * (n - 1) / 2
    seen = sum(v * (v - 1) / 2 for v in Counter(token.lower()).values())
    # Coincidences of n characters: their spread is that of pairs plus that of shared characters.
    spread = math.sqrt(pairs * TEXT_COINCIDENCE * (1 - TEXT_COINCIDENCE) + n**3 * 0.0008)
    few = _normal_tail((TEXT_COINCIDENCE * pairs - seen) / spread)
    kinds = [0 if c.isdigit() else 1 if c.isupper() else 2 if c.islower() else 3 for c in token]
    if name == "letters":
        # Words run together change case at each one, but seldom have capitals side by side.
        changes = _binomial_tail(sum(a == b == 1 for a, b in zip(kinds, kinds[1:], strict=False)), n - 1, TEXT_CAPITALS)
    else:
        changes = _binomial_tail(sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)), n - 1, TEXT_CHANGE)
    member = TEXT_HEX**n if name in ("hex", "HEX") else 1.0
    if name in ("small", "CAPITAL", "letters"):
        member = _binomial_tail(sum(c in "jkqvxz" for c in token.lower()), n, TEXT_RARE)
    # Fisher's sum of three independent p-values has 6 degrees of freedom.
    half = -(math.log(max(few, 1e-300)) + math.log(max(changes, 1e-300)) + math.log(max(member, 1e-300)))
    return math.exp(-half) * (1 + half + half * half / 2)


def candidates(text: str) -> list[tuple[int, int, str]]:
    """Spans and tokens of 16 or more characters of an encoding; leading small-letter path segments don't belong to them, padding only to the span."""
    found = []
    for match in _CANDIDATE.finditer(text):
        start = _SEGMENTS.match(text, match.start(), match.end()).end()
        token = text[start : match.end()].rstrip("=")
        if len(token) >= 16:
            found.append((start, match.end(), token))
    return found


def random_spans(text: str, base: list[tuple[int, int, int]] = (), rate: float = 1e-4, alpha: float = 0.03) -> list[tuple[int, int]]:
    """Spans of tokens taken for random, none of which touches a ``base`` span; ``rate`` bounds the false discoveries.

    The family is all other candidates of the text. Their p-values under ordinary words go through a Benjamini-Hochberg
    step with weights: a token's length over the mean one, times how far the battery lets it be random. A battery p-value
    of ``alpha`` or more keeps the whole weight; below, the weight falls with its fourth power. Weights' mean is one at most.
    """
    family: list[tuple[float, int, float, int, int]] = []
    for start, end, token in candidates(text):
        if any(start < b and a < end for a, _, b in base):
            continue
        found = infer_encoding(token)
        if found is None or token.isdigit():
            family.append((1.0, len(token), 0.0, start, end))
        else:
            family.append((wordlikeness(token, found[0]), len(token), min(1.0, randomness(token, found[1]) / alpha) ** 4, start, end))
    if not family or min(f[0] for f in family) > rate:
        return []
    mean = sum(f[1] for f in family) / len(family)
    ranked = sorted((p * mean / (size * free) if free else math.inf, start, end) for p, size, free, start, end in family)
    last = max((k for k, f in enumerate(ranked, 1) if f[0] <= rate * k / len(ranked)), default=0)
    return sorted((start, end) for _, start, end in ranked[:last])


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Pattern matches as (start, kind's place, end), in that order."""
    spans = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(spans)


def all_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Base spans and the random tokens that touch none of them."""
    extra = [(s, 3, e) for s, e in random_spans(text, base)]
    return sorted(base + extra) if extra else base


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets of every whole text: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random``.

    Spans are kind:start:end in code points, end exclusive, by start and then kind, comma-joined. Null and empty texts
    have none (an empty ``spans``). Very long texts are scanned whole. Null ids and repeated rows are kept; other columns
    are ignored, whatever their names; an empty table gives no rows.
    """

    def start():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for text in strings(batch.column(1)):
                base = base_spans(text)
                spans = all_spans(text, base)
                number = Counter(k for _, k, _ in spans)
                rows.append((number[0], number[1], number[2], hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans), number[3]))
            names = ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"]
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=["doc_id", *names])

        return work

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long"
    return map_rows(id_and_text(docs, id_col, text_col), schema, start)


def redact(text: str, mark: str = "[SECRET]") -> str:
    """The text with every span, overlapping ones as one, replaced by ``mark``."""
    out, at = [], 0
    for start, _, end in all_spans(text, base_spans(text)):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]]) if out else text


def redact_secrets(docs: DataFrame, text_col: str = "text", size_col: str = "n_chars", mark: str = "[SECRET]") -> DataFrame:
    """The same rows and columns, with each secret in ``text_col`` replaced by ``mark`` and ``size_col`` counted anew.

    Rows without secrets stay as they are; null texts stay null, with their count; empty texts stay empty. A missing
    ``size_col`` is ignored. Null ids, repeated rows and columns of any other name stay; an empty table stays empty.
    """

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: redact(t, mark), na_action="ignore")

    out = docs.withColumn(text_col, clean(F.col(quoted(text_col))))
    if size_col in docs.columns:
        kind = docs.schema[size_col].dataType
        out = out.withColumn(size_col, F.coalesce(F.length(quoted(text_col)).cast(kind), F.col(quoted(size_col))))
    return out
