"""Best-fit packing by exact-complement hashing.

Tokenised documents, each closed by an end id, fill sequences of at most
``capacity`` tokens.  Only longer ones are cut.  Planning works on the counts of
pieces by length, which are at most ``capacity`` numbers however large the
corpus is: for each length the missing complement is looked up among single
lengths, then sums of two, then sums of three, and every combination that fills
the gap exactly is consumed as often as the counts allow.  What is left goes
best fit: the longest pieces first, each into the open sequence with the
smallest gap that takes it.  A plan is a short list of runs (length, ranks from
and to, first sequence, offset), so each piece finds its place from its length
and its rank among pieces of that length.

Ranks come from salted groups: a length gets as many salts as its share of all
pieces asks for (at most ``SALTS`` and one a length in all), so no task ranks
more than about one in ``SALTS`` of the pieces.

Defined results: null and empty texts are one end id; repeated rows are packed
once each; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arrayq.llm.shared import arrow_map, materialise
from arrayq.llm.spans import SPACE, Texts, slices

CAPACITY = 4096
END_ID = 1
SALTS = 1024
#: Distinct words in each of the two generations of a worker's cache, unless told otherwise: more cost memory and save time, with the same result.
CACHE_WORDS = 120_000
_BATCH_BYTES = 2 << 20


#: Kinds of bytes: white space, letters and digits of ASCII, its other signs but the apostrophe, all else.  Letters and digits share no token with a sign beside them.
_SPACE, _ALNUM, _MARK, _OTHER = 0, 2, 3, 4
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[33:127] = [_ALNUM if chr(b).isalnum() else _OTHER if chr(b) == "'" else _MARK for b in range(33, 127)]
_KIND[SPACE] = _SPACE
#: At the end of a word they are tokens of their own.
_MARKS = bytes(np.flatnonzero(_KIND == _MARK).tolist())
#: The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on; spaces stay, as they part words here.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_LEVEL = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _SHOWN) if b != 32}


def _small_letters(word: bytes) -> bool:
    """Whether a word with bytes beyond ASCII is letters only, composed and in lower case."""
    if word.isascii():
        return False
    text = word.decode()
    return text.isalpha() and text.lower() == text and unicodedata.is_normalized("NFC", text)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where a public vocabulary file lies."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


class WordEncoder:
    """Token ids of texts as little-endian 32-bit bytes, by way of a word cache.

    The tokenizer lower-cases, drops white space and lets no token span it, nor
    the border between a letter or digit of ASCII and a sign other than the
    apostrophe.  So a text's ids are those of the words between these borders,
    one after another.  A run of texts is cut in one pass over its bytes, each
    distinct word is looked up once, and Arrow puts the ids side by side.

    Names of added tokens (``<|endoftext|>``) count as the tokenizer reads them:
    before lower-casing, and as one word.
    """

    def __init__(self, path: str, most: int = CACHE_WORDS) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.bar, *more = self.tokenizer.encode("|", add_special_tokens=False).ids
        assert not more, "the bar must be one token"
        added = self.tokenizer.get_added_tokens_decoder().values()
        assert not any(t.normalized or t.single_word or t.lstrip or t.rstrip for t in added), "added tokens must stand for their letters alone"
        self.added = sorted((t.content.encode() for t in added), key=len, reverse=True)
        self.added_name = re.compile(b"|".join(map(re.escape, self.added)))
        borders = [self._begins(_KIND[np.frombuffer(name, np.uint8)], np.array([0, len(name)])).sum() - 1 for name in self.added]
        assert all(n and name.lower().split() == [name] for n, name in zip(borders, self.added, strict=True)), "no other word may read like an added token"
        # the model alone, on words of bytes that are shown; a word's last token is one that closes words
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.closes[[i for name, i in vocabulary.items() if suffix and name.endswith(suffix)]] = True
        # does the model see a word of small letters as its bytes?
        sample = [w.encode() for w in ("a", "plain", "words", "qxzjvkw", "é", "größe", "señal", "日本語")]
        self.plain = bool(suffix) and self._letters(sample) == [self._alone(w) for w in sample]
        self.cache: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        signs = "".join(f"a{chr(m)}b {chr(m)}1" for m in _MARKS).encode()
        assert self.encode([signs]) == [self._alone(signs)], "letters and digits must share no token with signs"
        self.cache = {}

    def _alone(self, word: bytes) -> bytes:
        return np.array(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids, "<u4").tobytes()

    def _letters(self, words: list[bytes]) -> list[bytes]:
        """The ids of words of small letters, by the model alone."""
        out: list[bytes] = []
        for i in range(0, len(words), 1000):
            some = words[i : i + 1000]
            line = b" ".join(some).decode("latin-1").translate(_BYTE_LEVEL)
            ids = np.array(self.model.encode_batch_fast([line], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.closes[ids]) + 1
            assert len(ends) == len(some)
            flat = ids.tobytes()
            out += [flat[a:b] for a, b in pairwise([0, *(ends * 4).tolist()])]
        return out

    def _learn(self, words: list[bytes]) -> None:
        """Puts the ids of ``words`` into the cache; words with other characters than letters go through the whole tokenizer in one line, bars between."""
        if self.plain:
            letters = [w for w in words if w.isalpha() or _small_letters(w)]
            self.cache.update(zip(letters, self._letters(letters), strict=True))
            words = list(set(words).difference(letters))
        plain = [w for w in words if b"|" not in w]
        for i in range(0, len(plain), 1000):
            some = plain[i : i + 1000]
            line = b" | ".join([*some, b""]).decode()
            ids = np.array(self.tokenizer.encode_batch_fast([line], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(ids == self.bar)
            assert len(ends) == len(some)
            flat, at = ids.tobytes(), 0
            for w, end in zip(some, (ends * 4).tolist(), strict=True):
                self.cache[w] = flat[at:end]
                at = end + 4
        self.cache |= {w: self._alone(w) for w in words if b"|" in w}

    def _missing(self, words: list[bytes]) -> list[bytes]:
        """Words that neither generation has; those of the older one move to the newer."""
        cache, older = self.cache, self.older
        cache |= {w: older[w] for w in words if w in older}
        return [w for w in words if w not in cache]

    def _known(self, words: list[bytes]) -> list[bytes]:
        """The ids of each of ``words``, which differ."""
        if len(self.cache) > self.most:
            self.cache, self.older = {}, self.cache
        found = list(map(self.cache.get, words))
        unknown = self._missing([w for w, ids in zip(words, found, strict=True) if ids is None])
        tailed = []
        for w in unknown:
            if w[-1] in _MARKS:
                head = w.rstrip(_MARKS)
                if head.isalnum() or _small_letters(head):
                    tailed.append((w, head, w[len(head) :]))
        parts = {x for _, *both in tailed for x in both}
        self._learn(self._missing(list(parts.union(unknown).difference(w for w, _, _ in tailed))))
        cache = self.cache
        cache |= {w: cache[head] + cache[tail] for w, head, tail in tailed}
        return [cache[w] if ids is None else ids for w, ids in zip(words, found, strict=True)]

    @staticmethod
    def _begins(kind: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where words begin in texts that lie at ``at``, by the kinds of their bytes."""
        out = np.ones(len(kind), bool)
        out[1:] = (kind[:-1] == _SPACE) | ((kind[1:] ^ kind[:-1]) == (_ALNUM ^ _MARK))
        out[at[:-1][at[:-1] < len(kind)]] = True
        return out & (kind != _SPACE)

    def encoded(self, texts: Texts) -> tuple[np.ndarray, pa.Buffer]:
        """The ids of all texts in one buffer, and where in it each text's begin (one more at the end)."""
        kind = _KIND[texts.data]
        begins, inside = self._begins(kind, texts.at), kind != _SPACE
        raw = texts.data.tobytes()
        if any(name in raw for name in self.added):
            for a, b in pairwise(texts.at.tolist()):
                for name in self.added_name.finditer(raw, a, b):
                    first, end = name.span()
                    begins[first:end] = False
                    begins[first] = True
                    if end < b:
                        begins[end] = inside[end]
        # without white space, each word ends where the next begins
        kept = Texts(texts.data[inside], texts.at).lowered().data
        bounds = pa.py_buffer(np.append(np.flatnonzero(begins[inside]), len(kept)))
        words_at = np.searchsorted(np.flatnonzero(begins), texts.at)
        words = pa.Array.from_buffers(pa.large_binary(), int(words_at[-1]), [None, bounds, pa.py_buffer(kept)]).dictionary_encode()
        if not len(words):
            return np.zeros(len(texts.at), np.int64), pa.py_buffer(b"")
        ids = pa.array(self._known(_distinct(words.dictionary)), pa.large_binary()).take(words.indices)
        return np.frombuffer(ids.buffers()[1], np.int64)[ids.offset :][words_at], ids.buffers()[2] or pa.py_buffer(b"")

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text (UTF-8)."""
        at = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))
        offsets, ids = self.encoded(Texts(np.frombuffer(b"".join(texts), np.uint8), at))
        held = memoryview(ids)
        return [held[a:b].tobytes() for a, b in pairwise(offsets.tolist())]


def _distinct(words: pa.Array) -> list[bytes]:
    """Some words, which hold no spaces, as a list."""
    rows = pa.LargeListArray.from_arrays(pa.array([0, len(words)], pa.int64()), words)
    return pc.binary_join(rows, pa.scalar(b" ", words.type))[0].as_py().split(b" ")


@lru_cache(2)
def _encoder(path: str, most: int) -> WordEncoder:
    return WordEncoder(path, most)


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, cache_words: int = CACHE_WORDS) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32."""
    path = path or tokenizer_path()
    narrow = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    end = int(end_id).to_bytes(4, "little")
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, cache_words)
        for batch in batches:
            for part in slices(batch.column(1), _BATCH_BYTES):
                rows: list[tuple] = []
                offsets, held = encoder.encoded(part)
                with memoryview(held) as ids:
                    for i, (a, b) in enumerate(pairwise(offsets.tolist()), part.first):
                        n = (b - a) // 4 + 1
                        for k, at in enumerate(range(0, n, capacity)):
                            own = min(capacity, n - at)
                            crc = zlib.crc32(ids[a + 4 * at : min(b, a + 4 * (at + own))])
                            rows.append((i, k, at, own, zlib.crc32(end, crc) if at + own == n else crc))
                at, *rest = zip(*rows, strict=True)
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *(pa.array(x, k) for x, k in zip(rest, kinds, strict=True))], names)

    kind = narrow.schema["doc_id"].dataType.simpleString()
    return arrow_map(narrow, run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


Bin = tuple[tuple[int, ...], int]  # the lengths in a sequence, and how many sequences are filled so


def _exact(counts: np.ndarray, capacity: int) -> list[Bin]:
    """Consumes, from the longest length down, combinations of two to four pieces that fill a sequence exactly."""
    filled: list[Bin] = []

    def take(*lengths: int) -> None:
        need = {x: lengths.count(x) for x in lengths}
        times = min(int(counts[x]) // k for x, k in need.items())
        for x, k in need.items():
            counts[x] -= k * times
        filled.append((lengths, times))

    def pair(gap: int, used: tuple[int, ...]) -> tuple[int, int] | None:
        """Two available lengths whose sum is ``gap``, the longer as long as possible."""
        low = (gap + 1) // 2
        longer = np.arange(min(gap - 1, capacity), low - 1, -1)
        shorter = gap - longer
        have = lambda x: counts[x] - sum(x == u for u in used)
        hit = np.flatnonzero((have(longer) > 0) & (have(shorter) > (longer == shorter)))
        return (int(longer[hit[0]]), int(shorter[hit[0]])) if len(hit) else None

    for length in range(capacity, 0, -1):
        if counts[length] and length == capacity:
            take(length)
        while counts[length]:
            gap = capacity - length
            free = lambda x, used: counts[x] - used.count(x) > 0
            if gap and free(gap, (length,)):
                take(length, gap)
                continue
            if found := pair(gap, (length,)):
                take(length, *found)
                continue
            third = None
            for x in np.flatnonzero(counts[: gap - 1])[::-1] if gap > 2 else ():
                if 3 * x < gap:
                    break
                if free(int(x), (length,)) and (rest := pair(gap - int(x), (length, int(x)))):
                    third = (int(x), *rest)
                    break
            if not third:
                break
            take(length, *third)
    return filled


def _best_fit(counts: np.ndarray, capacity: int) -> list[Bin]:
    """Longest first, each into the open sequence with the smallest gap that takes it; equal sequences are handled at once."""
    open_bins: dict[int, list[Bin]] = {}
    gaps: list[int] = []
    for length in range(capacity, 0, -1):
        left = int(counts[length])
        counts[length] = 0
        while left:
            # gaps only ever shrink, and lengths fall, so all open gaps are looked at in rising order
            skipped, gap = [], None
            while gaps:
                g = heappop(gaps)
                if g not in open_bins:
                    continue
                skipped.append(g)
                if g >= length:
                    gap = g
                    break
            for g in skipped:
                heappush(gaps, g)
            lengths, times = open_bins[gap].pop() if gap is not None else ((), left)
            if gap is not None and not open_bins[gap]:
                del open_bins[gap]
            room = gap if gap is not None else capacity
            # a sequence that took a piece is the best fit for the next of the same length, until it is full
            each = min(left, room // length)
            used = min(times, left // each)
            if used < times and gap is not None:
                if gap not in open_bins:
                    heappush(gaps, gap)
                open_bins.setdefault(gap, []).append((lengths, times - used))
            left -= used * each
            rest = room - each * length
            if rest not in open_bins:
                heappush(gaps, rest)
            open_bins.setdefault(rest, []).append((lengths + (length,) * each, used))
    return [b for bins in open_bins.values() for b in bins]


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, rank from, rank to, first sequence, offset) for ``counts[length]`` pieces of each length.

    The number of runs is bounded by the capacity: every step uses up a length
    or a kind of open sequence.
    """
    counts = np.array(counts, np.int64)
    bins = [*_exact(counts, capacity), *_best_fit(counts, capacity)]
    ranks, sequence, runs = np.zeros(capacity + 1, np.int64), 0, []
    for lengths, times in bins:
        offset = 0
        for x in lengths:
            runs.append((x, int(ranks[x]), int(ranks[x]) + times, sequence, offset))
            ranks[x] += times
            offset += x
        sequence += times
    return runs


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, cache_words: int = CACHE_WORDS) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return place(materialise(pieces(docs, path, capacity, end_id, cache_words), "packing-pieces"), capacity)


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Gives each row of ``cut(length, ...)`` a sequence_id and an offset."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():  # at most ``capacity`` rows
        counts[length] = n
    total = max(1, int(counts.sum()))
    salts = [max(1, -(-int(n) * SALTS // total)) for n in counts]
    salt = F.pmod(F.xxhash64("doc_id", "piece"), F.element_at(F.lit(salts), (F.col("length") + 1).cast("int")))
    salted = cut.withColumn("_salt", salt)
    before: dict[tuple[int, int], int] = {}
    sizes = {(x, s): n for x, s, n in salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity + SALTS rows
    done: dict[int, int] = {}
    for x, s in sorted(sizes):
        before[x, s] = done.get(x, 0)
        done[x] = done.get(x, 0) + sizes[x, s]
    runs = np.array(sorted(plan(counts, capacity)), np.int64).reshape(-1, 5)
    base = np.full((capacity + 1, max(salts)), 0, np.int64)
    for (x, s), n in before.items():
        base[x, s] = n
    # one number orders runs by length and rank
    width = total + 1
    keys = runs[:, 0] * width + runs[:, 1]
    ranked = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece")))
    names = [*cut.columns, "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = lambda name: batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False).astype(np.int64)
            length = get("length")
            rank = base[length, get("_salt")] + get("_rank") - 1
            at = np.searchsorted(keys, length * width + rank, "right") - 1
            kept = [batch.column(batch.schema.get_field_index(c)) for c in names[:-2]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(runs[at, 3] + rank - runs[at, 1]), pa.array(runs[at, 4])], names)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema)
    return arrow_map(ranked, run, f"{schema}, sequence_id long, offset long")
