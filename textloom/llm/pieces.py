"""Piece encoding and decoding for merge-type SentencePiece vocabularies.

A score-ordered agenda of adjacent symbol pairs: the best pair (highest score, then leftmost) is merged until none is in
the vocabulary. Characters left without a piece fall back to their bytes. In every Arrow batch, the segments not met before
are encoded by the sentencepiece library too, and all ids decoded; a row that differs is marked and is the library's.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import itertools
import re

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2 as model_proto

from textloom.llm.batches import id_and_text, map_rows, strings

SPACE = "▁"
#: Segments longer than this are encoded afresh each time, and the cache is emptied at its limit.
CACHED_SEGMENT = 48
CACHE_LIMIT = 500_000
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6


class PieceCodec(dict):
    """Encoder and decoder of one model file; as a dict, caches the packed ids of each segment."""

    def __init__(self, path: str) -> None:
        super().__init__()
        model = model_proto.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        norm = model.normalizer_spec
        kinds = {p.type for p in model.pieces}
        if model.trainer_spec.model_type != 2 or kinds & {_USER, _UNUSED}:
            raise ValueError("only merge-type vocabularies of plain, control and byte pieces are supported")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only the identity normalisation with escaped, kept white space is supported")
        self._prefix = norm.add_dummy_prefix
        pieces = {p.piece: k for k, p in enumerate(model.pieces) if p.type == _NORMAL}
        self._size = len(model.pieces)
        self._number = dict(pieces)
        for p in pieces:
            for c in p:
                self._number.setdefault(c, len(self._number) + self._size)
        order = {score: k for k, score in enumerate(sorted({model.pieces[k].score for k in pieces.values()}, reverse=True))}
        #: For each symbol, what may follow it: rank by score and piece made, in one number. The last is for the dead.
        self._dead = len(self._number) + self._size
        self._follow: list[dict[int, int]] = [{} for _ in range(self._dead + 1)]
        for p, k in pieces.items():
            for cut in range(1, len(p)):
                left, right = self._number.get(p[:cut]), self._number.get(p[cut:])
                if left is not None and right is not None:
                    self._follow[left][right] = order[model.pieces[k].score] << 20 | k
        #: Segments encoded since the last check against the library.
        self.fresh: dict[str, bytes] = {}
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self._bytes = {int(p.piece[3:5], 16): k for k, p in enumerate(model.pieces) if p.type == _BYTE}
        self.unknown = next(k for k, p in enumerate(model.pieces) if p.type == _UNKNOWN)
        self.begin, self.end = model.trainer_spec.bos_id, model.trainer_spec.eos_id
        self._begin, self._end = (np.array([k], "<u4").tobytes() for k in (self.begin, self.end))
        # Where no piece holds a space after another character, nothing merges across such a place.
        whole = any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces)
        self._segments = (lambda t: [t] if t else []) if whole else re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+").findall
        self._starts_space = [p.type == _NORMAL and p.piece.startswith(SPACE) for p in model.pieces]
        unknown = model.trainer_spec.unk_surface.encode()
        self._out = [
            b"" if p.type == _CONTROL else unknown if p.type == _UNKNOWN else bytes([int(p.piece[3:5], 16)]) if p.type == _BYTE else p.piece.replace(SPACE, " ").encode()
            for p in model.pieces
        ]
        self._is_byte = [p.type == _BYTE for p in model.pieces]

    def merged(self, segment: str) -> list[int]:
        """Ids of one segment."""
        number, follow, dead = self._number.get, self._follow, self._dead
        # Behind the last place stands a dead symbol, which is also what precedes the first.
        symbol = [number(c, dead) for c in segment]
        n = len(symbol)
        symbol.append(dead)
        bits, gone = n.bit_length(), {}
        # An agenda entry is rank by score and place in one number: best score first, then leftmost.
        agenda = [v >> 20 << bits | at for at in range(n - 1) if (v := follow[symbol[at]].get(symbol[at + 1])) is not None]
        if agenda:
            mask = (1 << bits) - 1
            before, after = [n, *range(n)], list(range(1, n + 1))
            heapq.heapify(agenda)
            pop, push = heapq.heappop, heapq.heappush
            while agenda:
                entry = pop(agenda)
                at = entry & mask
                right = after[at]
                value = follow[symbol[at]].get(symbol[right], -1)
                if value >> 20 != entry >> bits:
                    continue  # one of its sides has merged meanwhile
                symbol[at] = made = value & 0xFFFFF
                symbol[right] = dead
                after[at] = nxt = after[right]
                before[nxt] = at
                gone[right] = True
                if (v := follow[made].get(symbol[nxt])) is not None:
                    push(agenda, v >> 20 << bits | at)
                prev = before[at]
                if (v := follow[symbol[prev]].get(made)) is not None:
                    push(agenda, v >> 20 << bits | prev)
        ids: list[int] = []
        for at, c in enumerate(segment):
            if (s := symbol[at]) < self._size:
                ids.append(s)
            elif at not in gone:  # a character without a piece of its own
                if self._bytes:
                    ids.extend([self._bytes[b] for b in c.encode()])
                elif not ids or ids[-1] != self.unknown:
                    ids.append(self.unknown)
        return ids

    def __missing__(self, segment: str) -> bytes:
        packed = self.fresh[segment] = np.array(self.merged(segment), "<u4").tobytes()
        if len(segment) <= CACHED_SEGMENT:
            if len(self) >= CACHE_LIMIT:
                self.clear()
            self[segment] = packed
        return packed

    def segments(self, text: str) -> list[str]:
        """Parts of a text between which nothing can merge."""
        plain = text.replace(" ", SPACE)
        return self._segments(SPACE + plain if self._prefix and plain else plain)

    def wrong(self) -> set[str]:
        """The segments met since the last call that the library encodes otherwise."""
        fresh, self.fresh = self.fresh, {}
        given = list(fresh)
        # The library puts one space before each text itself, but none before an empty one.
        found = self.library.encode([s[self._prefix :].replace(SPACE, " ") for s in given], num_threads=1)
        if self._prefix and SPACE in fresh:
            found[given.index(SPACE)] = [self.library.piece_to_id(SPACE)]
        if np.array(list(itertools.chain.from_iterable(found)), "<u4").tobytes() == b"".join(fresh.values()):
            if all(4 * len(ids) == len(own) for ids, own in zip(found, fresh.values(), strict=True)):
                return set()
        return {s for s, ids in zip(given, found, strict=True) if np.array(ids, "<u4").tobytes() != fresh[s]}

    def packed(self, text: str) -> bytes:
        """Ids of a text, with begin and end ids, as little-endian unsigned 32-bit integers."""
        return b"".join([self._begin, *map(self.__getitem__, self.segments(text)), self._end])

    def encode(self, text: str) -> list[int]:
        """Ids of a text, with begin and end ids."""
        return np.frombuffer(self.packed(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """Text of ids: controls vanish, runs of byte pieces are UTF-8, the first piece loses its leading space."""
        out = self._out
        if self.begin in ids[1:-1] or self.end in ids[1:-1]:
            return self._decode_broken(ids)
        raw = b"".join([out[i] for i in ids])
        if self._prefix:
            first = next((i for i in ids if out[i]), None)
            if first is not None and self._starts_space[first]:
                raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return self._decode_broken(ids)

    def _decode_broken(self, ids: list[int]) -> str:
        """Byte runs that aren't UTF-8: each byte outside a whole character gives U+FFFD."""
        text, run = [], bytearray()

        def flush() -> None:
            at = 0
            while at < len(run):
                for size in (1, 2, 3, 4):
                    try:
                        text.append(bytes(run[at : at + size]).decode())
                        at += size
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    text.append("�")
                    at += 1
            run.clear()

        seen = False
        for i in ids:
            if self._is_byte[i]:
                run += self._out[i]
                seen = True
                continue
            flush()
            piece = self._out[i].decode()
            if piece and not seen and self._prefix and self._starts_space[i]:
                piece = piece[1:]
            seen |= bool(self._out[i])
            text.append(piece)
        flush()
        return "".join(text)


@functools.cache
def codec_of(path: str) -> PieceCodec:
    """One codec for each model and Python worker, so that its cache serves later tasks too."""
    return PieceCodec(path)


def encode_texts(docs: DataFrame, model: str, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every whole text: ``doc_id, n_tokens, ids_sha256, decoded_sha256, verified``.

    Ids have the begin and end ids; null and empty texts are just these two. ``verified`` tells that the sentencepiece
    library encodes all the row's segments, and decodes its ids, alike; where it does not, the row is the library's.
    ``with_ids`` adds ``ids`` and ``decoded``. Very long texts are encoded whole. Null ids and repeated rows are kept; other
    columns are ignored, whatever their names; an empty table gives no rows. ``model`` is a path present on every machine.
    """

    def start():
        codec, wrong = codec_of(model), set()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = strings(batch.column(1))
            packed = [codec.packed(t) for t in texts]
            ids = [np.frombuffer(p, "<u4").tolist() for p in packed]
            wrong.update(codec.wrong())
            right = [not wrong or wrong.isdisjoint(codec.segments(t)) for t in texts]
            for k in (k for k, same in enumerate(right) if not same):
                ids[k] = codec.library.encode(texts[k], add_bos=True, add_eos=True)
                packed[k] = np.array(ids[k], "<u4").tobytes()
            decoded, theirs = [codec.decode(i) for i in ids], codec.library.decode(ids, num_threads=1)
            right = [same and own == other for same, own, other in zip(right, decoded, theirs, strict=True)]
            decoded = theirs
            arrays = [
                batch.column(0),
                pa.array([len(i) for i in ids], pa.int64()),
                pa.array([hashlib.sha256(p).hexdigest() for p in packed]),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decoded]),
                pa.array(right, pa.bool_()),
            ]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "verified"]
            if with_ids:
                arrays += [pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                names += ["ids", "decoded"]
            return pa.RecordBatch.from_arrays(arrays, names=names)

        return work

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, verified boolean"
    return map_rows(id_and_text(docs, id_col, text_col), schema + ", ids array<int>, decoded string" * with_ids, start)
