"""SentencePiece encoding and decoding by suffix-array matching.

White space is escaped as in SentencePiece (a space in front, spaces as
``\\u2581``) and the text falls into units: spaces with the word behind them, or
a line feed.  No piece crosses a unit, so units are encoded apart and each
distinct one only once a worker.

A batch of new units is one array of characters.  Its suffixes are sorted as
far as the longest piece, every piece of the vocabulary finds its occurrences
by two binary searches, and the occurrences are the edges of a lattice.  Edges
are sorted by where they end and relaxed in that order: an edge settles its end
if the piece before it is settled and the two pieces stand side by side when
merges are made on their own text.  A row of pieces is what merging gives
exactly when each two neighbours are, so the one edge that settles the end of
the text leads back through the whole encoding.  All units advance together,
one character at a time.

Characters outside the vocabulary become byte pieces.

Defined results: null and empty texts have no ids; a text that holds
``\\u2581`` decodes to a space there; repeated rows are encoded alike; an empty
table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arrayq.llm.shared import arrow_map
from arrayq.llm.spans import mix

SPACE = "▁"
CACHE_UNITS = 200_000
#: Pairs of pieces of which a worker remembers whether they stand (9 bytes each); a power of two.
PAIR_PLACES = 1 << 21
#: Characters of new units that are indexed together.
INDEX_CHARS = 1 << 20
_RUN_BYTES = 2 << 20
_UNIT = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")
_PER_KEY = 4  # characters in a 64-bit sort key


def model_path(name: str = "piece_bpe_32k.model") -> str:
    """Where a public vocabulary file lies."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


class Codec:
    """Encodes and decodes with a BPE vocabulary: pieces by falling score, bytes for the rest."""

    def __init__(self, vocabulary: Sequence[tuple[str, float, str]], most: int = CACHE_UNITS) -> None:
        """``vocabulary``: for each id its piece, its score and its kind (``piece``, ``byte`` or ``control``)."""
        self.most = most
        self.ids = {p: i for i, (p, _, kind) in enumerate(vocabulary) if kind == "piece"}
        self.score = {p: vocabulary[i][1] for p, i in self.ids.items()}
        self.byte_ids = {int(p[1:-1], 16): i for i, (p, _, kind) in enumerate(vocabulary) if kind == "byte"}
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.ids):
            raise ValueError("pieces with inner spaces or line feeds would cross units")
        letters = sorted({c for p in self.ids for c in p})
        if any(c not in self.ids for c in letters):
            raise ValueError("every character of a piece must be a piece")
        if len(self.byte_ids) != 256:
            raise ValueError("a vocabulary without byte pieces is not supported")
        self.text = [p.encode() if kind == "piece" else bytes([int(p[1:-1], 16)]) if kind == "byte" else b"" for p, _, kind in vocabulary]
        self.size = len(vocabulary)
        self.names = [p for p, _, _ in vocabulary]
        # characters as small codes: 0 ends a unit, the last stands for all that no piece has
        self.code_of = np.full(0x110000, len(letters) + 1, np.uint16)
        self.code_of[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.unknown = len(letters) + 1
        names = sorted(self.ids)
        self.longest = max(map(len, names))
        self.n_keys = -(-self.longest // _PER_KEY)
        self.piece_ids = np.array([self.ids[p] for p in names])
        self.piece_sizes = np.array([len(p) for p in names])
        codes = np.zeros((len(names), self.n_keys * _PER_KEY), np.uint16)
        for k, p in enumerate(names):
            codes[k, : len(p)] = self.code_of[[ord(c) for c in p]]
        self.piece_keys = self._packed(codes.reshape(len(names), self.n_keys, _PER_KEY))
        used = np.arange(self.n_keys * _PER_KEY)[None] < self.piece_sizes[:, None]
        self.piece_masks = self._packed((used * np.uint16(0xFFFF)).astype(np.uint16).reshape(len(names), self.n_keys, _PER_KEY))
        # a table of fixed size: a key that meets another's place takes it
        self.pairs = np.full(PAIR_PLACES, -1, np.int64)
        self.stands = np.zeros(PAIR_PLACES, bool)
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @staticmethod
    def _packed(codes: np.ndarray) -> np.ndarray:
        out = np.zeros(codes.shape[:-1], np.uint64)
        for j in range(_PER_KEY):
            out = (out << np.uint64(16)) | codes[..., j].astype(np.uint64)
        return out

    def merged(self, text: str) -> list[str]:
        """What merging makes of a short text: the best-scored pair of neighbours first, the leftmost of equals."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = -np.inf, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and s > best:
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _valid(self, keys: np.ndarray) -> np.ndarray:
        """Whether pieces stand side by side; a key is (previous id + 1) * size + id, with 0 for the start of a run."""
        place = (mix(keys.astype(np.uint64)) & np.uint64(PAIR_PLACES - 1)).astype(np.int64)
        out = self.stands[place]
        missed = np.flatnonzero(self.pairs[place] != keys)
        if len(missed):
            new, first, back = np.unique(keys[missed], return_index=True, return_inverse=True)
            found = np.array([self._stands(key) for key in new.tolist()], bool)
            out[missed] = found[back]
            at = place[missed[first]]
            self.pairs[at], self.stands[at] = new, found
        return out

    def _stands(self, key: int) -> bool:
        before, own = divmod(key, self.size)
        pair = [self.names[own]] if not before else [self.names[before - 1], self.names[own]]
        return self.merged("".join(pair)) == pair

    def _edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All occurrences of all pieces: start, length, id."""
        n = len(codes)
        padded = np.concatenate((codes, np.zeros(self.n_keys * _PER_KEY, np.uint16)))
        keys = [self._packed(np.lib.stride_tricks.sliding_window_view(padded, _PER_KEY)[k * _PER_KEY : k * _PER_KEY + n]) for k in range(self.n_keys)]
        order = np.lexsort(keys[::-1])
        sorted_keys = np.stack([k[order] for k in keys], 1)
        low = self._search(sorted_keys, "left")
        high = self._search(sorted_keys, "right")
        times = high - low
        which = np.repeat(np.arange(len(times)), times)
        within = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
        return order[low[which] + within], self.piece_sizes[which], self.piece_ids[which]

    def _search(self, sorted_keys: np.ndarray, side: str) -> np.ndarray:
        """For every piece the first suffix that does not sort before it (left), or the first that sorts after all that begin with it (right)."""
        lo = np.zeros(len(self.piece_ids), np.int64)
        hi = np.full(len(self.piece_ids), len(sorted_keys), np.int64)
        for _ in range(int(len(sorted_keys)).bit_length()):
            active = lo < hi
            mid = np.minimum((lo + hi) >> 1, len(sorted_keys) - 1)
            seen = sorted_keys[mid] & self.piece_masks
            less, equal = np.zeros(len(lo), bool), np.ones(len(lo), bool)
            for k in range(self.n_keys):
                less |= equal & (seen[:, k] < self.piece_keys[:, k])
                equal &= seen[:, k] == self.piece_keys[:, k]
            right = active & (less | equal if side == "right" else less)
            lo, hi = np.where(right, mid + 1, lo), np.where(active & ~right, mid, hi)
        return lo

    def _learn(self, units: list[str]) -> None:
        """Encodes new units and puts them into the cache."""
        i = 0
        while i < len(units):
            some, size = [], 0
            while i < len(units) and (not some or size + len(units[i]) < INDEX_CHARS):
                some.append(units[i])
                size += len(units[i]) + 1
                i += 1
            self._learn_batch(some)

    def _learn_batch(self, units: list[str]) -> None:
        points = np.frombuffer("\0".join([*units, ""]).encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(u) + 1 for u in units])
        codes = self.code_of[points]
        codes[ends - 1] = 0
        plain = (codes != 0) & (codes != self.unknown)
        n = len(codes)
        # runs of known characters; an edge's place in its run tells when it is relaxed
        opens = plain & ~np.concatenate(([False], plain[:-1]))
        closes = np.flatnonzero(plain & ~np.concatenate((plain[1:], [False]))) + 1
        run_start = np.maximum.accumulate(np.where(opens, np.arange(n), 0))
        start, length, piece = self._edges(codes)
        end_in_run = start + length - run_start[start]
        order = np.argsort(end_in_run, kind="stable")
        start, length, piece, end_in_run = start[order], length[order], piece[order], end_in_run[order]
        last, last_size = np.full(n + 1, -1, np.int64), np.zeros(n + 1, np.int64)
        bounds = np.flatnonzero(np.concatenate(([True], end_in_run[1:] != end_in_run[:-1], [True]))) if len(start) else np.zeros(1, int)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            s, k, p = start[a:b], length[a:b], piece[a:b]
            at_start = s == run_start[s]
            open_ = at_start | (last[s] >= 0)
            s, k, p, at_start = s[open_], k[open_], p[open_], at_start[open_]
            fits = self._valid(np.where(at_start, 0, last[s] + 1) * self.size + p)
            last[s[fits] + k[fits]], last_size[s[fits] + k[fits]] = p[fits], k[fits]
        # back from the end of every run
        places, found = [], []
        at = closes
        while len(at):
            if (last[at] < 0).any():
                raise AssertionError("an end without an edge")
            begin = at - last_size[at]
            places.append(begin)
            found.append(last[at])
            at = begin[begin > run_start[begin]]
        odd = np.flatnonzero(codes == self.unknown)
        places.append(odd)
        found.append(np.full(len(odd), -1))
        place, ids = np.concatenate(places), np.concatenate(found)
        order = np.argsort(place, kind="stable")
        place, ids = place[order], ids[order]
        cuts = np.searchsorted(place, np.concatenate(([0], ends)))
        flat = ids.astype("<i4").tobytes()
        has_odd = np.add.reduceat(codes == self.unknown, np.concatenate(([0], ends[:-1]))) > 0
        for u, a, b, odd_here in zip(units, cuts[:-1].tolist(), cuts[1:].tolist(), has_odd.tolist(), strict=True):
            if not odd_here:
                self.cache[u] = flat[4 * a : 4 * b]
                continue
            out: list[int] = []
            for at_, i in zip(place[a:b].tolist(), ids[a:b].tolist(), strict=True):
                out += [i] if i >= 0 else [self.byte_ids[x] for x in chr(points[at_]).encode()]
            self.cache[u] = np.array(out, "<i4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        split = [_UNIT.findall((SPACE + t).replace(" ", SPACE)) if t else [] for t in texts]
        if len(self.cache) > self.most:
            self.cache, self.older = {}, self.cache
        unknown = set().union(*split) - self.cache.keys()
        again = unknown & self.older.keys()
        self.cache |= {u: self.older[u] for u in again}
        unknown -= again
        self._learn(sorted(unknown))
        get = self.cache.__getitem__
        return [b"".join(map(get, units)) for units in split]

    def decode(self, ids: bytes) -> str:
        """The text of ids in the form that :meth:`encode` returns; bytes that are no UTF-8 become U+FFFD."""
        text = b"".join(map(self.text.__getitem__, np.frombuffer(ids, "<i4").tolist())).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


@lru_cache(2)
def load(path: str, most: int = CACHE_UNITS) -> Codec:
    """The codec of a SentencePiece BPE model file."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    kind = lambda i: "byte" if model.is_byte(i) else "control" if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) else "piece"
    return Codec([(model.id_to_piece(i), model.get_score(i), kind(i)) for i in range(model.get_piece_size())], most)


def _runs(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(sizes, (sizes[i - 1] if i else 0) + _RUN_BYTES, "right")))
        yield i, [t or "" for t in texts.slice(i, j - i).to_pylist()]
        i = j


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids, n_ids, ids_crc32 and whether decoding gives the text back."""
    path = path or model_path()
    narrow = docs.select("doc_id", F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load(path)
        for batch in batches:
            for first, texts in _runs(batch.column(1)):
                ids = codec.encode(texts)
                same = [codec.decode(x) == t for x, t in zip(ids, texts, strict=True)]
                n = np.array([len(x) // 4 for x in ids], np.int64)
                at = pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32())
                flat = pa.Array.from_buffers(pa.int32(), int(n.sum()), [None, pa.py_buffer(b"".join(ids))])
                crc = pa.array([zlib.crc32(x) for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.ListArray.from_arrays(at, flat), pa.array(n), crc, pa.array(same)], ["doc_id", "ids", "n_ids", "ids_crc32", "round_trip"])

    return arrow_map(narrow, run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, ids array<int>, n_ids long, ids_crc32 long, round_trip boolean")


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text from ``encoded(doc_id, ids)``."""
    path = path or model_path()
    narrow = encoded.select("doc_id", F.col("ids").cast("array<int>").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load(path)
        for batch in batches:
            made = [codec.decode(np.array(x or [], "<i4").tobytes()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], ["doc_id", "text"])

    return arrow_map(narrow, run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, text string")
