"""SimHash near-duplicates by a binary trie joined with itself.

Fingerprints within three bits agree on at least one of four 16-bit blocks, so each is dealt to four groups, one a block,
with the agreed block moved to the top. A group's sorted fingerprints are a binary trie: a node is a range that shares a
prefix. The self-join walks node pairs together, adds up differing bits and drops a pair as soon as they exceed the
budget. Groups above a size are dealt again by four blocks of the bits not yet agreed, which loses no pair either. As
only components are wanted, a group emits a spanning forest of its links, and node pairs that lie in one component
already are dropped; so dense groups stay near-linear.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from textloom.llm.batches import drop_stored, id_and_text, map_rows, quoted, slices, stored, strings, unused

BITS, BLOCKS = 64, 4
#: Groups of more fingerprints are dealt again, up to this many times.
GROUP_LIMIT, DEALS = 8192, 4
#: Node pairs walked, and fingerprint pairs compared, at a time.
FRONTIER = 100_000
_WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(ord("A"), ord("Z") + 1)})
_HASHES = 1 << 16


def fingerprint(text: str, size: int = 3, seed: int = 42) -> int:
    """SimHash of a text's word shingles, repeats included; fewer words are one shingle, none give zero."""
    words = _WORDS(text.translate(_LOWER) if not text.isascii() else text.lower())
    if not words:
        return 0
    hashed = xxhash.xxh64_intdigest
    if len(words) <= size:
        shingles = [" ".join(words)]
    else:
        shingles = list(map(" ".join, zip(*(words[k:] for k in range(size)))))  # noqa: B905  the shortest ends it
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(shingles), _HASHES):
        h = np.fromiter((hashed(s, seed) for s in shingles[at : at + _HASHES]), np.uint64)
        ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(shingles)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` for every row; ``fp`` is the fingerprint as a signed long. Null texts count as empty."""

    def start():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = np.array([fingerprint(t) for t in strings(batch.column(1))], np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["doc_id", "fp"])

        return work

    return map_rows(id_and_text(docs, id_col, text_col), "doc_id long, fp long", start)


class _Forest:
    """Union-find over array positions with vectorised reads."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def roots(self, at: np.ndarray) -> np.ndarray:
        out = self.parent[at]
        while (up := self.parent[out]).tobytes() != out.tobytes():
            out = up
        return out

    def flatten(self) -> np.ndarray:
        while (up := self.parent[self.parent]).tobytes() != self.parent.tobytes():
            self.parent = up
        return self.parent

    def link(self, a: np.ndarray, b: np.ndarray) -> bool:
        """Join the pairs; tells if any two components became one."""
        changed = False
        while True:
            ra, rb = self.roots(a), self.roots(b)
            apart = ra != rb
            if not apart.any():
                return changed
            changed = True
            a, b = a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])


def _pairs(lo1, hi1, lo2, hi2):
    """All positions of range one with all of range two, for many pairs of ranges."""
    n1, n2 = hi1 - lo1, hi2 - lo2
    total = n1 * n2
    which = np.repeat(np.arange(len(total)), total)
    rank = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
    return lo1[which] + rank // n2[which], lo2[which] + rank % n2[which]


def trie_forest(values: np.ndarray, prefix: int, budget: int = 3, frontier: int = FRONTIER) -> np.ndarray:
    """Component root of every value, where values linked share their top ``prefix`` bits and differ in ``budget`` or fewer.

    ``values`` are sorted distinct unsigned 64-bit integers; roots are positions in it.
    """
    n = len(values)
    forest = _Forest(n)
    if n < 2:
        return forest.parent
    tops = values >> np.uint64(BITS - prefix) if prefix else np.zeros(n, np.uint64)
    cuts = np.flatnonzero(tops[1:] != tops[:-1]) + 1
    lo, hi = np.r_[0, cuts], np.r_[cuts, n]
    full = hi - lo > 1
    lo, hi = lo[full], hi[full]
    # A stack of frontiers: node pairs of one depth, with the bits they differ in so far.
    stack = [(prefix, lo[k : k + frontier], hi[k : k + frontier], lo[k : k + frontier], hi[k : k + frontier], np.zeros(len(lo[k : k + frontier]), np.int8)) for k in range(0, len(lo), frontier)]
    changes, stale = np.zeros(n, np.int64), True
    while stack:
        depth, lo1, hi1, lo2, hi2, diff = stack.pop()
        if stale:
            label = forest.flatten()
            changes, stale = np.r_[0, np.cumsum(label[1:] != label[:-1])], False
        label = forest.parent
        done = (changes[lo1] == changes[hi1 - 1]) & (changes[lo2] == changes[hi2 - 1]) & (label[lo1] == label[lo2])
        small = ~done & ((hi1 - lo1) * (hi2 - lo2) <= 16)
        if small.any():
            a, b = _pairs(lo1[small], hi1[small], lo2[small], hi2[small])
            near = (a < b) & (np.bitwise_count(values[a] ^ values[b]) <= budget)
            stale |= forest.link(a[near], b[near])
        rest = ~done & ~small
        if not rest.any():
            continue
        lo1, hi1, lo2, hi2, diff = lo1[rest], hi1[rest], lo2[rest], hi2[rest], diff[rest]
        bit = np.uint64(1) << np.uint64(BITS - 1 - depth)
        keep = ~np.uint64((int(bit) << 1) - 1)

        def split(at, keep=keep, bit=bit):
            return np.searchsorted(values, (values[at] & keep) | bit)

        mid1, mid2 = np.clip(split(lo1), lo1, hi1), np.clip(split(lo2), lo2, hi2)
        own = lo1 == lo2
        sides = (
            (lo1, mid1, lo2, mid2, diff, np.ones_like(own)),
            (mid1, hi1, mid2, hi2, diff, np.ones_like(own)),
            (lo1, mid1, mid2, hi2, diff + 1, np.ones_like(own)),
            (mid1, hi1, lo2, mid2, diff + 1, ~own),
        )
        for a, b, c, d, e, ok in sides:
            ok = ok & (b > a) & (d > c) & (e <= budget) & ~((a == c) & (b - a < 2))
            for k in range(0, int(ok.sum()), frontier):
                stack.append((depth + 1, *(x[ok][k : k + frontier] for x in (a, b, c, d, e))))
    return forest.flatten()


def _original(rotated: np.ndarray, path: int, prefix: int) -> np.ndarray:
    """Undo the moves of ``_dealt``; ``path`` holds one block number a deal, the first in the lowest two bits."""
    steps, done = [], 0
    while done < prefix:
        width, starts = _cut(done)
        block = path & 3
        path >>= 2
        steps.append((done, starts[block], width[block]))
        done += width[block]
    for top, start, width in reversed(steps):
        rotated = _moved(rotated, top, start, width, back=True)
    return rotated


def _cut(prefix: int) -> tuple[list[int], list[int]]:
    """Widths and starts of the four blocks of the bits below ``prefix``."""
    width = [(BITS - prefix) // BLOCKS] * BLOCKS  # equal widths; the bits left over belong to no block
    return width, [prefix + k * width[0] for k in range(BLOCKS)]


def _moved(v: np.ndarray, top: int, start: int, width: int, back: bool = False) -> np.ndarray:
    """Move ``width`` bits from ``start`` to ``top`` (or back), shifting what stands between."""
    if start == top:
        return v
    full = (1 << BITS) - 1
    span = ((1 << (start + width - top)) - 1) << (BITS - start - width)
    between = start - top
    held = v & np.uint64(span)
    if back:
        out = (held >> np.uint64(between)) | (held << np.uint64(width))
    else:
        out = (held << np.uint64(between)) | (held >> np.uint64(width))
    return (v & np.uint64(full ^ span)) | (out & np.uint64(span))


def _dealt(rows: DataFrame, prefix: int, level: int) -> tuple[DataFrame, int]:
    """Each row (path, bits) once for each of the four blocks below ``prefix``, that block moved up behind it."""
    width, starts = _cut(prefix)

    def moved(k: int) -> str:
        start = starts[k]
        if start == prefix:
            return "bits"
        span = ((1 << (start + width[k] - prefix)) - 1) << (BITS - start - width[k])
        signed = span - (1 << 64) if span >> 63 else span
        held, between = f"(bits & {signed}L)", start - prefix
        return f"(bits & ~({signed}L)) | ((shiftleft({held}, {between}) | shiftrightunsigned({held}, {width[k]})) & {signed}L)"

    each = ", ".join(f"struct(cast(path + {k << 2 * level} as int) path, {moved(k)} bits)" for k in range(BLOCKS))
    return rows.selectExpr(f"inline(array({each}))"), prefix + width[0]


def _forests(rows: DataFrame, prefix: int, budget: int) -> DataFrame:
    """Links ``a, b`` of a spanning forest of every group (path, top bits); one task holds a group at a time."""
    key = F.shiftrightunsigned("bits", BITS - prefix)
    held = rows.withColumn("top", key).repartition("path", "top").sortWithinPartitions("path", "top").select("path", "bits")

    def solve(path: int, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
        values = np.unique(bits.view(np.uint64))
        roots = trie_forest(values, prefix, budget)
        at = np.flatnonzero(roots != np.arange(len(values)))
        if len(at):
            ends = [_original(values[x], path, prefix).view(np.int64) for x in (at, roots[at])]
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(*ends)), pa.array(np.minimum(*ends))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def release(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal waiting, size
            path, bits = (np.concatenate(x) for x in zip(*waiting, strict=True))
            top = bits.view(np.uint64) >> np.uint64(BITS - prefix)
            end = len(path)
            if not last:  # the last group may go on
                end = int(np.flatnonzero((path != path[-1]) | (top != top[-1]))[-1]) + 1 if (path != path[-1]).any() or (top != top[-1]).any() else 0
            for p in np.unique(path[:end]):
                yield from solve(int(p), bits[:end][path[:end] == p])
            waiting, size = ([(path[end:], bits[end:])], 0) if end < len(path) else ([], 0)

        for batch in batches:
            if batch.num_rows:
                waiting.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
                size += batch.num_rows
                if size >= 200_000:
                    yield from release(last=False)
        if waiting:
            yield from release(last=True)

    return held.mapInArrow(run, "a long, b long")


def links(fps: DataFrame, budget: int = 3, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """Links between distinct fingerprints (column ``fp``) whose components are those of all pairs within ``budget``.

    The last deal needs no limit: its groups agree on 43 bits, so that one holds at most 2**21 fingerprints (16 MB).
    """
    if budget >= BLOCKS:
        raise ValueError("four blocks find pairs that differ in up to three bits")
    rows, prefix = _dealt(fps.selectExpr("cast(0 as int) path", "fp bits"), 0, 0)
    parts = []
    for level in range(1, DEALS + 1):
        if level == DEALS:
            parts.append(_forests(rows, prefix, budget))
            break
        keyed = rows.withColumn("top", F.shiftrightunsigned("bits", BITS - prefix))
        hot = keyed.groupBy("path", "top").count().where(F.col("count") > group_limit).select("path", "top")
        hot, _ = stored(hot)
        if hot.isEmpty():
            parts.append(_forests(rows, prefix, budget))
            break
        parts.append(_forests(keyed.join(hot, ["path", "top"], "left_anti").select("path", "bits"), prefix, budget))
        rows, prefix = _dealt(keyed.join(hot, ["path", "top"], "left_semi").select("path", "bits"), prefix, level)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def components(edges: DataFrame) -> tuple[DataFrame, str]:
    """``node, root`` for every node of ``edges`` (a, b), and the path it is read from: one root for all of a component.

    Large-star and small-star steps alternate until nothing moves. Each step is aggregations and joins on the node; a
    centre with many neighbours is only ever a partial minimum and one side of a join. Every round is written to the
    shared folder.
    """
    spark = edges.sparkSession
    state, path = stored(edges.where("a <> b").selectExpr("greatest(a, b) a", "least(a, b) b").distinct())
    mark = _mark(state)
    while mark[0]:
        both = state.unionByName(state.selectExpr("b a", "a b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).selectExpr("a", "least(a, m) m")
        large = both.where("b > a").join(least, "a").selectExpr("b a", "m b").where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").selectExpr("inline(array(struct(b a, m b), struct(a, m b)))").where("a <> b").distinct()
        after, after_path = stored(small)
        changed = _mark(after)
        drop_stored(spark, path)
        state, path = after, after_path
        if changed == mark:
            break
        mark = changed
    return state.selectExpr("a node", "b root").unionByName(state.selectExpr("b node", "b root").distinct()), path


def _mark(state: DataFrame) -> tuple:
    """A digest of an edge set, to tell whether a round changed it."""
    return tuple(state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def near_duplicates(docs: DataFrame, budget: int = 3, group_limit: int = GROUP_LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row.

    ``fingerprint`` is 16 lowercase hex digits; ``component_id`` is the smallest id reachable over links of ``budget`` or
    fewer differing bits, the row's own included. Null and empty texts have fingerprint zero, linked like any other; very
    long texts are shingled whole. Rows with a null id get the smallest id of the others (null if there is none). Repeated
    rows are all kept; other columns are ignored, whatever their names; an empty table gives no rows.
    """
    spark = docs.sparkSession
    signs, _ = stored(fingerprints(docs, id_col, text_col))
    fps, fps_path = stored(signs.groupBy("fp").agg(F.min("doc_id").alias("least")))
    edges, edges_path = stored(links(fps.select("fp"), budget, group_limit))
    roots, roots_path = components(edges)
    linked = fps.join(roots, fps.fp == roots.node).select("fp", "root", "least")
    least = linked.groupBy("root").agg(F.min("least").alias("least"))
    classes = linked.select("fp", "root").join(least, "root").select("fp", F.col("least").alias("reached"))
    classes = fps.join(classes, "fp", "left").select("fp", F.coalesce("reached", "least").alias("component_id"))
    # Stored, so that the last join stands alone and AQE can split the partition of a fingerprint that many rows share.
    classes, _ = stored(classes)
    drop_stored(spark, fps_path, edges_path, roots_path)
    return signs.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each near-duplicate group: that of its smallest id, all columns kept.

    Rows with a null id all stay. An id that repeats is judged row by row, each by its own text; of rows with the smallest
    id of one group the one whose text, and then whose other columns' hash, is first stays. Null and empty texts are one
    group. Columns may have any name; an empty table stays empty.
    """
    found = near_duplicates(docs, id_col=id_col, text_col=text_col).where("doc_id is not null")
    ids, _ = stored(found.groupBy("doc_id").agg(F.min("component_id").alias("least"), F.count("*").alias("rows")))
    # The ids that go grow with the corpus: they are never broadcast, at no size.
    name, key = unused(docs, "gone_id"), F.col(quoted(id_col)).cast("long")
    gone = ids.where("least < doc_id or rows > 1").select(F.col("doc_id").alias(name))
    out = docs.join(gone.hint("merge"), key == F.col(name), "left_anti")
    if ids.where("rows > 1").isEmpty():
        return out
    again = docs.join(ids.where("rows > 1").select(F.col("doc_id").alias(name)).hint("merge"), key == F.col(name), "left_semi")
    sign, place = unused(docs, "own_sign"), unused(docs, "own_place")
    first = found.where("doc_id = component_id").select(F.col("doc_id").alias(name), F.col("fingerprint").alias(sign)).distinct()
    signed = again.withColumn(sign, _signed(F.col(quoted(text_col)).cast("string")))
    signed = signed.join(first.withColumnRenamed(sign, place), (key == F.col(name)) & (F.col(sign) == F.col(place)), "left_semi")
    order = Window.partitionBy(key).orderBy(F.col(quoted(text_col)), F.xxhash64(*(F.col(quoted(c)) for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind)))
    return out.unionByName(signed.withColumn(place, F.row_number().over(order)).where(F.col(place) == 1).drop(place, sign))


@F.arrow_udf(StringType())
def _signed(texts: pa.Array) -> pa.Array:
    """Fingerprints as hex digits."""
    out: list[str] = []
    for part in slices(iter([pa.RecordBatch.from_arrays([texts], names=["t"])]), 0):
        out += [f"{fingerprint(t):016x}" for t in strings(part.column(0))]
    return pa.array(out, pa.string())
