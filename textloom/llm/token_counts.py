"""Token counts by byte-pair merging with a heap and a linked list.

The lowest-ranked adjacent pair is popped and merged until no ranked pair is left; the count is the number of initial
symbols minus the merges, so no token identifiers are made.
"""

from __future__ import annotations

import functools
import heapq
import json

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from textloom.llm.batches import id_and_text, map_rows, strings

# The split pattern of byte-level vocabularies; white space is Unicode's White_Space.
_SPACE = r"\t-\r \x85\xa0  -     　"
SPLIT_PATTERN = (
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+"
    rf"|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)
#: Pieces longer than this are merged afresh each time, and the cache is emptied at its limit.
CACHED_PIECE = 48
CACHE_LIMIT = 600_000


def byte_symbols() -> dict[int, str]:
    """The printable character that byte-level vocabularies use for each byte."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class MergeCounter(dict):
    """Counts tokens of a byte-level vocabulary file; as a dict, caches the count of each piece."""

    def __init__(self, path: str) -> None:
        super().__init__()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        splitter = spec.get("pre_tokenizer") or {}
        if spec["model"]["type"] != "BPE" or splitter.get("type") != "ByteLevel" or spec.get("normalizer"):
            raise ValueError("only byte-level BPE vocabularies without a normalizer are supported")
        if splitter.get("add_prefix_space") or not splitter.get("use_regex", True):
            raise ValueError("the vocabulary must split by pattern and without a prefix space")
        number: dict[str, int] = {}
        self._byte = [number.setdefault(s, len(number)) for _, s in sorted(byte_symbols().items())]
        self._ranks: dict[int, int] = {}
        self._made: list[int] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            ids = [number.setdefault(s, len(number)) for s in (left, right, left + right)]
            self._ranks.setdefault(ids[0] << 17 | ids[1], rank)
            self._made.append(ids[2])
        if len(number) >= 1 << 17:
            raise ValueError("vocabularies of up to 131,071 symbols are supported")
        special = [t["content"] for t in spec.get("added_tokens", [])]
        self._special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self._pieces = regex.compile(SPLIT_PATTERN).findall

    def merged(self, piece: bytes) -> int:
        """Symbols left of one piece: its bytes minus the merges made."""
        symbol = [self._byte[b] for b in piece]
        count = len(symbol)
        ranks, made_by = self._ranks, self._made
        # An agenda entry is rank and position in one number: lowest rank first, then leftmost.
        agenda = [r << 40 | at for at in range(count - 1) if (r := ranks.get(symbol[at] << 17 | symbol[at + 1])) is not None]
        if not agenda:
            return count
        before, after = list(range(-1, count - 1)), [*range(1, count), -1]
        heapq.heapify(agenda)
        pop, push, get = heapq.heappop, heapq.heappush, ranks.get
        while agenda:
            entry = pop(agenda)
            at, rank = entry & 0xFFFFFFFFFF, entry >> 40
            left, right = symbol[at], after[at]
            if left < 0 or right < 0 or get(left << 17 | symbol[right]) != rank:
                continue  # one of its sides has merged meanwhile
            symbol[at] = made = made_by[rank]
            symbol[right] = -1
            after[at] = nxt = after[right]
            count -= 1
            if nxt >= 0:
                before[nxt] = at
                if (r := get(made << 17 | symbol[nxt])) is not None:
                    push(agenda, r << 40 | at)
            if (prev := before[at]) >= 0 and (r := get(symbol[prev] << 17 | made)) is not None:
                push(agenda, r << 40 | prev)
        return count

    def __missing__(self, piece: str) -> int:
        count = self.merged(piece.encode())
        if len(piece) <= CACHED_PIECE:
            if len(self) >= CACHE_LIMIT:
                self.clear()
            self[piece] = count
        return count

    def count(self, text: str) -> int:
        """Tokens of a whole text; special strings in it are one token each."""
        if self._special is None or not self._special.search(text):
            return sum(map(self.__getitem__, self._pieces(text)))
        parts = self._special.split(text)
        return len(parts) - 1 + sum(sum(map(self.__getitem__, self._pieces(p))) for p in parts)


@functools.cache
def counter_of(path: str) -> MergeCounter:
    """One counter for each vocabulary and Python worker, so that its cache serves later tasks too."""
    return MergeCounter(path)


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bytes and tokens of every whole text: ``doc_id, n_bytes, n_tokens, over_limit``.

    Null and empty texts have 0 bytes and 0 tokens; very long texts are counted whole; null ids and repeated rows are kept
    as they are; other columns are ignored, whatever their names; an empty table gives no rows. ``vocabulary`` is the path
    of a byte-level BPE ``.json`` file, present on every machine.
    """

    def start():
        counter = counter_of(vocabulary)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = strings(batch.column(1))
            tokens = [counter.count(t) for t in texts]
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

        return work

    return map_rows(id_and_text(docs, id_col, text_col), "doc_id long, n_bytes long, n_tokens long, over_limit boolean", start)
