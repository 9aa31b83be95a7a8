"""Document quality from a linear-chain conditional random field over lines.

Every line gets features of its own and of its neighbours: shares of character classes, length, words, repetition within
the line and within the document. The field labels lines good or bad; forward-backward marginals of good, weighted by line
length, make the document's raw quality, which a logistic step calibrates. Lines take their document's label in training,
so boilerplate that occurs under both labels stays undecided and leaves the choice to its neighbours.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.batches import fold, id_and_text, map_rows, quoted, slices, smallest_hashes, strings, unused

#: Labelled documents of each label that training takes: those of the smallest id hashes.
SAMPLE = 1500
#: Lines of a training chain; longer documents make several chains. Scoring takes whole documents as one chain.
CHAIN = 48
#: Training chains of a document at most, spread evenly over longer ones; labelled documents of each label that calibrate.
CHAINS, CALIBRATION = 4, 500
#: Lines whose features are made at a time, and places of padded chains.
LINES, CELLS = 20_000, 200_000
_LOW, _UP, _DIGIT, _SPACE, _STOP, _SYMBOL = range(6)


def _class_table() -> np.ndarray:
    table = np.full(0x10000, _SYMBOL, np.uint8)
    for c in range(0x10000):
        s = chr(c)
        if s.isupper():
            table[c] = _UP
        elif s.isalpha():
            table[c] = _LOW
        elif s.isdigit():
            table[c] = _DIGIT
        elif s.isspace():
            table[c] = _SPACE
    for s in ".,;:?'\"()-’“”«»¿¡…–":
        table[ord(s)] = _STOP
    return table


_CLASSES = _class_table()
#: Own features that neighbours see too.
_SEEN = slice(0, 9)


def _own_features(lines: list[str], again: np.ndarray) -> np.ndarray:
    """One row for each line: what the line alone shows, and whether it stood before in its text."""
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    codes = np.frombuffer("\n".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = _CLASSES[np.minimum(codes, 0xFFFF)]
    own_line = np.repeat(np.arange(len(lines)), sizes + 1)[: len(codes)]
    counts = np.bincount(own_line * 6 + kinds, minlength=len(lines) * 6).reshape(-1, 6).astype(float)
    counts[:-1, _SPACE] -= 1  # the line breaks themselves
    full = np.maximum(sizes, 1)
    letters = np.maximum(counts[:, _LOW] + counts[:, _UP], 1)
    words, repeat, distinct = np.zeros((3, len(lines)))
    for k, line in enumerate(lines):
        w = line.split()
        n = len(w)
        words[k] = n
        if n > 1:
            repeat[k] = sum(map(operator.eq, w, w[1:])) / (n - 1)
            distinct[k] = 1 - len(set(w)) / n
    symbol, upper = counts[:, _SYMBOL] / full, counts[:, _UP] / letters
    return np.column_stack(
        [
            symbol, np.minimum(symbol * 10, 1), upper, upper > 0.5, repeat, repeat > 0.3, distinct, again & (words > 0), sizes == 0,
            counts[:, _DIGIT] / full, counts[:, _STOP] / full, counts[:, _SPACE] / full,
            np.log1p(sizes) / 5, np.log1p(words) / 4, sizes / (words + 1) / 10, distinct > 0.6, words == 1,
        ]
    )


class Lines:
    """A text's lines, with features of some of them at a time; an empty text is one empty line."""

    def __init__(self, text: str) -> None:
        self.lines = text.split("\n")
        self.sizes = np.fromiter(map(len, self.lines), np.int64, len(self.lines))
        seen: set[str] = set()
        self.again = np.zeros(len(self.lines), bool)
        for k, line in enumerate(self.lines):
            self.again[k] = line in seen
            seen.add(line)

    def features(self, low: int, high: int) -> np.ndarray:
        """Rows of the lines from ``low`` to before ``high``: their own features, the neighbours' and the text's edges."""
        first, last, n = max(0, low - 1), min(len(self.lines), high + 1), high - low
        own = _own_features(self.lines[first:last], self.again[first:last])
        near = np.zeros((n + 2, own.shape[1]))
        near[1 - (low - first) : 1 - (low - first) + len(own)] = own
        edge = np.zeros((n, 3))
        edge[:, 0], edge[:, 1] = np.arange(low, high) == 0, np.arange(low, high) == len(self.lines) - 1
        edge[:, 2] = 1  # bias
        return np.concatenate([near[1:-1], near[:-2, _SEEN], near[2:, _SEEN], edge], axis=1)

    def pulls(self, weights: np.ndarray) -> np.ndarray:
        """Score of good over bad of every line."""
        return np.concatenate([self.features(at, min(at + LINES, len(self.lines))) @ weights for at in range(0, len(self.lines), LINES)])

    def chains(self) -> list[np.ndarray]:
        """Features of training chains: all of the text's, or ``CHAINS`` spread evenly over it."""
        starts = range(0, len(self.lines), CHAIN)
        taken = starts if len(starts) <= CHAINS else [starts[k * len(starts) // CHAINS] for k in range(CHAINS)]
        return [self.features(at, min(at + CHAIN, len(self.lines))) for at in taken]


@dataclass
class Field:
    """Weights for good over bad, log transition scores [from, to], and the calibration."""

    weights: np.ndarray
    moves: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def marginals(self, pulls: list[np.ndarray]) -> list[np.ndarray]:
        """P(good) of every line of every chain from its lines' scores; chains of like length go together, so padding is bounded."""
        order = sorted(range(len(pulls)), key=lambda k: -len(pulls[k]))
        out: list[np.ndarray] = [None] * len(pulls)
        at = 0
        while at < len(order):
            longest = len(pulls[order[at]])
            some = order[at : at + max(1, CELLS // longest)]
            unary = np.zeros((len(some), longest, 2))
            lengths = np.array([len(pulls[k]) for k in some])
            for row, k in enumerate(some):
                unary[row, : lengths[row], 1] = pulls[k]
            good, *_ = _forward_backward(unary, lengths, self.moves)
            for row, k in enumerate(some):
                out[k] = good[row, : lengths[row]]
            at += len(some)
        return out

    def raw(self, texts: list[str]) -> np.ndarray:
        """Length-weighted mean of P(good) of each text; if all lines are empty they weigh alike."""
        sizes, pulls = [], []
        for text in texts:
            lines = Lines(text)
            sizes.append(lines.sizes)
            pulls.append(lines.pulls(self.weights))
        return np.array([np.average(p, weights=s if s.any() else None) for p, s in zip(self.marginals(pulls), sizes, strict=True)])

    def scores(self, texts: list[str]) -> np.ndarray:
        p = np.clip(self.raw(texts), 1e-4, 1 - 1e-4)
        return 1 / (1 + np.exp(-(self.slope * np.log(p / (1 - p)) + self.shift)))


def _soft(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


def _forward_backward(unary: np.ndarray, lengths: np.ndarray, moves: np.ndarray):
    """P(good) of each place, P(pair of labels) summed over places, of chains sorted by falling length."""
    chains, steps, _ = unary.shape
    ahead, behind = unary.copy(), np.zeros_like(unary)
    live = [int(np.searchsorted(-lengths, -t, side="left")) for t in range(steps)]  # chains longer than t
    for t in range(1, steps):
        n = live[t]
        for y in (0, 1):
            ahead[:n, t, y] += _soft(ahead[:n, t - 1, 0] + moves[0, y], ahead[:n, t - 1, 1] + moves[1, y])
    for t in range(steps - 2, -1, -1):
        n = live[t + 1]
        after = unary[:n, t + 1] + behind[:n, t + 1]
        for y in (0, 1):
            behind[:n, t, y] = _soft(moves[y, 0] + after[:, 0], moves[y, 1] + after[:, 1])
    both = ahead + behind
    good = 1 / (1 + np.exp(np.clip(both[:, :, 0] - both[:, :, 1], -500, 500)))
    return good, ahead, behind, live


def fit_field(chains: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, rounds: int = 120, ridge: float = 1e-3) -> Field:
    """Maximum likelihood of chains whose lines all carry the chain's label, by Adam; ``weights`` are the chains'."""
    width = chains[0].shape[1]
    order = np.argsort([-len(c) for c in chains], kind="stable")
    lengths = np.array([len(chains[k]) for k in order])
    y, w = labels[order].astype(float), (weights / weights.sum())[order] / lengths
    x = np.zeros((len(chains), lengths.max(), width))
    for row, k in enumerate(order):
        x[row, : lengths[row]] = chains[k]
    mask = np.arange(x.shape[1]) < lengths[:, None]
    theta, moves = np.zeros(width), np.zeros((2, 2))
    first, second = np.zeros(width + 4), np.zeros(width + 4)
    for step in range(1, rounds + 1):
        unary = np.zeros((*x.shape[:2], 2))
        unary[:, :, 1] = x @ theta
        good, ahead, behind, live = _forward_backward(unary, lengths, moves)
        pull = np.where(mask, (good - y[:, None]) * w[:, None], 0.0)
        grad = np.einsum("ct,ctf->f", pull, x) + ridge * theta
        pair = np.zeros((2, 2))
        total = _soft(*np.moveaxis((ahead + behind)[:, 0], 1, 0))
        for t in range(1, x.shape[1]):
            n = live[t]
            for a in (0, 1):
                for b in (0, 1):
                    joint = np.exp(ahead[:n, t - 1, a] + moves[a, b] + unary[:n, t, b] + behind[:n, t, b] - total[:n])
                    pair[a, b] += (w[:n] * (joint - (y[:n] == a) * (a == b))).sum()
        flat = np.r_[grad, (pair + ridge * moves).ravel()]
        first, second = 0.9 * first + 0.1 * flat, 0.99 * second + 0.01 * flat**2
        move = 0.15 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
        theta, moves = theta - move[:width], moves - move[width:].reshape(2, 2)
    return Field(theta, moves)


def calibrate(field: Field, raw: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> None:
    """Fit slope and shift of the logistic step by Newton's method with a little shrinkage."""
    p = np.clip(raw, 1e-4, 1 - 1e-4)
    x = np.column_stack([np.log(p / (1 - p)), np.ones(len(p))])
    beta = np.array([1.0, 0.0])
    for _ in range(25):
        q = 1 / (1 + np.exp(-x @ beta))
        grad = x.T @ (weights * (q - labels)) + 1e-2 * (beta - [1.0, 0.0])
        beta = beta - np.linalg.solve((x * (weights * q * (1 - q))[:, None]).T @ x + 1e-2 * np.eye(2), grad)
    field.slope, field.shift = float(max(beta[0], 0.05)), float(beta[1])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Field:
    """A field from a bounded sample of labelled documents (doc_id, text) and labels (doc_id, label of 0 or 1).

    The documents of the next hashes, up to ``CALIBRATION`` of each label, calibrate it. Texts stay on the executors: the
    driver gets features of a bounded number of lines, and one figure for each text. An id that repeats counts with its
    first text in order.
    """
    spark = docs.sparkSession
    known = labels.where("label in (0, 1)").distinct()
    sizes = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    chosen: list[tuple[int, int, bool, bool]] = []
    for y in sizes:
        ids = smallest_hashes(known.where(F.col("label") == y), sample + CALIBRATION, "doc_id")
        cut = max(len(ids) * 3 // 4, len(ids) - CALIBRATION)
        chosen += [(k, y, at < cut or len(ids) < 8, at >= cut or len(ids) < 8) for at, (k,) in enumerate(ids)]
    wanted = F.broadcast(spark.createDataFrame(chosen, "doc_id long, label int, learn boolean, check boolean"))  # bounded by the sample
    rows = docs.join(wanted, "doc_id").groupBy("doc_id", "label", "learn", "check").agg(F.min("text").alias("text"))

    def learn(batches):
        for part in slices(batches, 1):
            for label, text in zip(part.column(0).to_pylist(), strings(part.column(1)), strict=True):
                made = Lines(text).chains()
                flat = [pa.array(c.astype(np.float32).ravel()) for c in made]
                yield pa.RecordBatch.from_arrays([pa.array([label] * len(made), pa.int32()), pa.array([1 / len(made)] * len(made)), pa.array([f.to_numpy() for f in flat], pa.list_(pa.float32()))], names=["label", "share", "x"])

    width = Lines("").features(0, 1).shape[1]
    chains, y, share = [], [], []
    for r in rows.where("learn").select("label", "text").mapInArrow(learn, "label int, share double, x array<float>").toArrow().to_batches():
        for label, part, x in zip(r.column(0).to_pylist(), r.column(1).to_pylist(), r.column(2), strict=True):
            chains.append(x.values.to_numpy().reshape(-1, width).astype(float))
            y.append(label)
            share.append(part)
    if len(set(y)) < 2:  # nothing to tell apart
        sure = 1.0 if not y or y[0] else -1.0
        return Field(np.r_[np.zeros(width - 1), 3.0 * sure], np.zeros((2, 2)))
    y, share = np.array(y), np.array(share)

    def weights(labels: np.ndarray, share: np.ndarray) -> np.ndarray:
        """Each label weighs as much as it does among all labelled rows."""
        per = np.where(labels == 1, sizes[1] / max(1e-9, share[labels == 1].sum()), sizes[0] / max(1e-9, share[labels == 0].sum())) * share
        return per / per.mean()

    order = np.lexsort((*[np.array([c.sum() for c in chains])], y))  # alike in every run, however tasks end
    field = fit_field([chains[k] for k in order], y[order], weights(y, share)[order])
    held = spark.sparkContext.broadcast(field)

    def check(batches):
        for part in slices(batches, 1):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(held.value.raw(strings(part.column(1))), pa.float64())], names=["label", "raw"])

    found = rows.where("check").select("label", "text").mapInArrow(check, "label int, raw double").toArrow()
    labels_, raw = found["label"].to_numpy(), found["raw"].to_numpy()
    if len(set(labels_.tolist())) == 2:
        calibrate(field, raw, labels_, weights(labels_, np.ones(len(raw))))
    return field


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, held_out: tuple[int, int] = (4, 2), sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row.

    ``labels`` has doc_id and quality; only ids whose crc32 modulo ``held_out[0]`` isn't ``held_out[1]`` are learned
    from. ``predicted`` is 1 if ``score`` is at least ``threshold``. Null and empty texts are one empty line; very long texts
    are scored whole, some lines at a time; null ids aren't held out; equal texts score alike and repeated rows are kept;
    other columns are ignored, whatever their names. Without labels of both kinds every text scores alike; an empty table
    gives no rows.
    """
    rows = id_and_text(docs, id_col, text_col)
    rows = rows.withColumn("held_out", F.coalesce(fold("doc_id", held_out[0]) == held_out[1], F.lit(False)))
    held = docs.sparkSession.sparkContext.broadcast(_learned(rows, labels, held_out, sample))

    def start():
        field = held.value

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            score = field.scores(strings(batch.column(1)))
            return pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

        return work

    return map_rows(rows.select("doc_id", "text", "held_out"), "doc_id long, held_out boolean, score double, predicted int", start)


def _learned(rows: DataFrame, labels: DataFrame, held_out: tuple[int, int], sample: int) -> Field:
    known = labels.selectExpr("cast(doc_id as long) doc_id", "cast(quality as int) label").where(fold("doc_id", held_out[0]) != held_out[1])
    return fit(rows.select("doc_id", "text"), known, sample)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, held_out: tuple[int, int] = (4, 2), sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, all columns kept, whose text scores at least ``threshold``.

    Null and empty texts count as one empty line, and a score equal to the threshold is enough. Null ids and repeated rows
    are judged like any other; columns of any name stay; an empty table stays empty.
    """
    rows = id_and_text(docs, id_col, text_col)
    held = docs.sparkSession.sparkContext.broadcast(_learned(rows, labels, held_out, sample))

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        out = []
        for part in slices(iter([pa.RecordBatch.from_arrays([texts], names=["t"])]), 0):
            out.append(held.value.scores(strings(part.column(0))))
        return pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    name = unused(docs, "quality_score")
    return docs.withColumn(name, score(F.col(quoted(text_col)).cast("string"))).where(F.col(name) >= threshold).drop(name)
