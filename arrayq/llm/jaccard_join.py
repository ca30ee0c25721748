"""N-gram Jaccard self-join in the metric space of Jaccard distance.

Texts become sets of word shingles; two link when their Jaccard distance is at
most ``r = 1 - percent / 100``.  Equal sets are one node.

*Outliers.*  A partner of a set of ``n`` shingles misses at most ``P - 1`` of
them, ``P = n - ceil(n * percent / 100) + 1``; so a set with ``P`` shingles that
no other set holds is farther than ``r`` from all others.  That needs counts
only, no pairs: a fixed share of all shingles (by their hash) is dealt into
buckets, where one look tells which stand alone.  What is left, mostly copies,
is counted once more, over all shingles of the sets that are left.

*First regions.*  Whole documents make poor first pivots: almost all of them are
at distance 1 from each other, where no window can prune.  So the first regions
are those of prefix filtering: the pivots are single shingles, in one order
(those in few sets first), a set's nearest pivot is its first shingle in that
order, and it is replicated as far as a partner's nearest pivot can lie, to its
first ``P`` shingles.

*Within a region* documents are pivots: first the most central member, the one
that meets the most others in its regions.  Its exact distance to the members
links some of them; what lies in a region's largest component needs no comparison
with each other.  What stays outside is paired with the other members, within
triangle-inequality windows: on set size (the distance to the set of all
shingles), on the exact distances to the pivot, on the places of the shared
shingle in both orders (what can still be shared behind it), and on the counts
of shingles by hash class, whose differences add up to at most the symmetric
difference.  Regions with many left members first take further pivots, again
and again.  Every pair that passes is checked on the full sets, so the result
is exact.

Nothing is collected to the driver but single counts.  A block of texts asks a
bucket for each of its shingles once, so a passage or a text that a third of all
documents share costs a bucket one entry a block.

Defined results: null and empty texts have no shingles and link with nothing;
with fewer words than a shingle has, the whole sequence is one; repeated rows
are equal sets; an empty table gives an empty table; extra columns are ignored
by :func:`near_groups` and kept by :func:`near_dedup`, where rows with a null
id stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arrayq.llm.components import components
from arrayq.llm.shared import arrow_map, discard, materialise
from arrayq.llm.spans import Texts, mix, slices, windows

WORDS = 5
PERCENT = 80
#: Bytes of text whose shingles go to a bucket, and the most buckets; a task takes several.
BUCKET_BYTES = 16 << 20
MOST_BUCKETS = 1 << 20
BUCKETS_PER_TASK = 4
#: Shingles and texts that a block asks about together, and the most of both; larger corpora have more buckets and so larger blocks.
BLOCK, BLOCK_MOST, BLOCK_TEXTS = 1 << 20, 1 << 24, (1 << 16) - 1
#: Shingles a hash class holds on average, at most about twice as many; and the fewest classes.
PER_CLASS = 2
MIN_CLASSES = 16
#: Further pivots that large regions take before their left members are paired, unless a round leaves more than that share of the work.
PIVOT_ROUNDS = 6
PROGRESS = 0.75
#: Comparisons (left members times all members) above which a region takes a further pivot.
REGION = 1024
#: Ids that may be broadcast (16 MB).
BROADCAST_IDS = 2_000_000
_KEY = ["n", "s1", "s2"]
_NOBODY = BLOCK_TEXTS


def prefix_size(n: np.ndarray, percent: int) -> np.ndarray:
    """In how many of ``n`` shingles, in the common order, a partner's first shingle can lie."""
    return np.where(n > 0, n + (-n * percent) // 100 + 1, 0)


def _own(part: Texts, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts' distinct shingles, ascending, and their bounds."""
    low = part.lowered()
    starts, ends, at = low.words()
    hashes = low.hashes(starts, ends)
    rolled = windows(hashes, words)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= words:
            own = np.sort(rolled[a : b - words + 1])
            out.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
        else:
            out.append(mix(windows(hashes[a:b], b - a) + np.uint64(b - a)) if b > a else rolled[:0])
    return np.concatenate([*out, rolled[:0]]), np.concatenate(([0], np.cumsum([len(x) for x in out], dtype=np.int64)))


def _set_hashes(total: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that tell sets apart."""
    out = []
    for salted in (total, total * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1)):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(salted), dtype=np.uint64)))
        out.append(sums[bounds[1:]] - sums[bounds[:-1]])
    return out[0], out[1]


def _buckets(docs: DataFrame) -> int:
    """A power of two, by the measured bytes of all texts."""
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    return min(MOST_BUCKETS, 1 << max(0, (size // BUCKET_BYTES).bit_length()))


def _wire(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


class _Block:
    """Some texts' counted shingles; :meth:`requests` asks the buckets about them."""

    def __init__(self, n_buckets: int) -> None:
        self.bits = np.uint64(n_buckets.bit_length() - 1)
        self.keys: list[np.ndarray] = []
        self.owners: list[np.ndarray] = []
        self.rows: list[np.ndarray] = []
        self.need: list[np.ndarray] = []
        self.sets: set[tuple[int, int]] = set()
        self.n_rows = self.n_keys = 0

    def add(self, rows: np.ndarray, sets: list[tuple[int, int]], need: np.ndarray, counted: np.ndarray, owner: np.ndarray) -> None:
        """Of equal sets one asks.  A key is a bucket (top bits) and 32 bits; sets that meet there by chance are only kept longer."""
        new = np.array([s not in self.sets and not self.sets.add(s) for s in sets], bool) & (need > 0)
        number = np.cumsum(new) - 1 + self.n_rows
        mine = new[owner]
        counted, owner = counted[mine], owner[mine]
        top = (counted >> (np.uint64(64) - self.bits)) << np.uint64(32) if self.bits else np.zeros(len(counted), np.uint64)
        self.keys.append(top | (counted & np.uint64(0xFFFFFFFF)))
        self.owners.append(number[owner])
        self.rows.append(rows[new])
        self.need.append(need[new])
        self.n_rows += int(new.sum())
        self.n_keys += len(counted)

    def requests(self) -> pa.RecordBatch | None:
        """For each bucket the keys, those of one text with its number; and a row for the block itself: texts, and how many keys of each may be shared."""
        if not self.n_rows:
            return None
        keys, owners = np.concatenate(self.keys), np.concatenate(self.owners)
        rows, need = np.concatenate(self.rows), np.concatenate(self.need)
        order = np.argsort(keys, kind="stable")
        keys, owners = keys[order], owners[order]
        first = np.concatenate(([True], keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, bool)
        once = first & np.concatenate((first[1:], [True])) if len(keys) else first
        spare = np.bincount(owners[once], minlength=len(rows)) - need
        owners, keys = np.where(once, owners, _NOBODY)[first].astype(np.uint16), keys[first]
        bucket = (keys >> np.uint64(32)).astype(np.int64)
        order = np.lexsort((owners, bucket))  # neighbours' numbers are close, which compresses
        owners, keys, bucket = owners[order], keys[order].astype(np.uint32), bucket[order]
        found, at = np.unique(bucket, return_index=True)
        cuts = [*at.tolist(), len(keys)]
        n = len(found)
        name = int(rows[0])
        texts = pa.ListArray.from_arrays(pa.array([0] * (n + 1) + [len(rows)], pa.int32()), pa.array(rows))
        spares = pa.ListArray.from_arrays(pa.array([0] * (n + 1) + [len(rows)], pa.int32()), pa.array(spare))
        return pa.RecordBatch.from_arrays([
            pa.array([name] * (n + 1), pa.int64()), pa.array([*found.tolist(), -1], pa.int32()),
            pa.array([*(_wire(owners[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)), b""], pa.binary()),
            pa.array([*(_wire(keys[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)), b""], pa.binary()),
            texts, spares,
        ], ["block", "bucket", "owners", "keys", "texts", "spare"])


def _requests(docs: DataFrame, words: int, percent: int, n_buckets: int) -> DataFrame:
    """One table of two kinds of rows: a row for each text (``bucket`` null), and the blocks' requests."""
    narrow = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    # twice what a partner may miss, and a tenth more
    share = np.uint64(min(1 << 16, (1 << 16) * (2 * (100 - percent) + 10) // 100))
    most = min(BLOCK_MOST, max(BLOCK, 16 * n_buckets))
    id_type = narrow.schema["doc_id"].dataType.simpleString()
    blob = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("owners", pa.binary()), ("keys", pa.binary()), ("texts", pa.list_(pa.int64())), ("spare", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, schema = _Block(n_buckets), None

        def closed() -> Iterator[pa.RecordBatch]:
            made = block.requests()
            if made is not None:
                empty = [pa.nulls(made.num_rows, schema.field(k).type) for k in range(5)]
                yield pa.RecordBatch.from_arrays([*empty, *made.columns], schema=schema)

        for batch in batches:
            if schema is None:
                schema = pa.schema([("row", pa.int64()), ("doc_id", batch.schema.field(0).type), ("n", pa.int32()), ("s1", pa.int64()), ("s2", pa.int64()), *blob])
            numbers = batch.column(2).to_numpy(zero_copy_only=False)
            for part in slices(batch.column(1)):
                rows = numbers[part.first : part.first + len(part)]
                total, bounds = _own(part, words)
                n = np.diff(bounds)
                s1, s2 = _set_hashes(total, bounds)
                own = [pa.array(rows), batch.column(0).slice(part.first, len(part)), pa.array(n.astype(np.int32)), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64))]
                yield pa.RecordBatch.from_arrays([*own, *(pa.nulls(len(part), f.type) for f in blob)], schema=schema)
                counted = ((total >> np.uint64(32)) & np.uint64(0xFFFF)) < share
                owner = np.repeat(np.arange(len(n)), n)
                sets = list(zip(s1.tolist(), s2.tolist(), strict=True))
                need = prefix_size(n, percent)
                for i in range(0, len(part), BLOCK_TEXTS // 2):  # more texts than that only if they are tiny
                    j = min(len(part), i + BLOCK_TEXTS // 2)
                    mine = np.zeros(len(total), bool)
                    mine[bounds[i] : bounds[j]] = counted[bounds[i] : bounds[j]]
                    if block.n_rows and (block.n_rows + j - i >= BLOCK_TEXTS or block.n_keys + int(mine.sum()) > most):
                        yield from closed()
                        block = _Block(n_buckets)
                    block.add(rows[i:j], sets[i:j], need[i:j], total[mine], owner[mine] - i)
        yield from closed()

    schema = f"row long, doc_id {id_type}, n int, s1 long, s2 long, block long, bucket int, owners binary, keys binary, texts array<long>, spare array<long>"
    return materialise(arrow_map(narrow, run, schema), "jaccard-requests")


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What buckets say: for each block the texts with shared keys, and how many."""
    blocks, keys, owners, sizes = [], [], [], []
    for batch in batches:
        for block, bucket, own, key in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            key = np.frombuffer(key, np.uint32).astype(np.uint64) | np.uint64(bucket << 32)
            blocks.append(block)
            keys.append(key)
            owners.append(np.frombuffer(own, np.uint16))
            sizes.append(len(key))
    if not blocks:
        return
    all_keys = np.concatenate(keys)
    del keys
    order = np.argsort(all_keys)
    same = all_keys[order[1:]] == all_keys[order[:-1]]
    shared = np.zeros(len(all_keys), bool)
    shared[order[1:][same]] = True
    shared[order[:-1][same]] = True
    names, answers, at = [], [], 0
    for block, own, size in zip(blocks, owners, sizes, strict=True):
        hit = own[shared[at : at + size]]
        at += size
        hit = hit[hit != _NOBODY]
        if len(hit):
            names.append(block)
            answers.append(_wire(hit))
    for i in range(0, len(names), 256):
        yield pa.RecordBatch.from_arrays([pa.array(names[i : i + 256], pa.int64()), pa.array(answers[i : i + 256], pa.binary())], ["block", "owners"])


def _left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From blocks' own rows and all answers, the texts with too many shared keys to be outliers."""
    found: dict[int, list[bytes]] = {}
    own: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for block, owners, texts, spare in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if texts is None:
                found.setdefault(block, []).append(owners)
            else:
                own[block] = np.array(texts, np.int64), np.array(spare, np.int64)
    for block, (texts, spare) in own.items():
        hits = np.frombuffer(b"".join(found.get(block, [])), np.uint16)
        yield pa.RecordBatch.from_arrays([pa.array(texts[spare < np.bincount(hits, minlength=len(texts))])], ["row"])


def _apart(x: pa.Buffer, y: pa.Buffer) -> int:
    """Least possible size of a symmetric difference, from counts by hash class; the finer counts are folded to the coarser."""
    a, b = np.frombuffer(x, np.uint8).astype(np.int64), np.frombuffer(y, np.uint8).astype(np.int64)
    while len(a) > len(b):
        a = a[: len(a) // 2] + a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] + b[len(b) // 2 :]
    return int(np.abs(a - b).sum())


def _named(pivot: str) -> list[Column]:
    return [F.col("p.node").alias(pivot), F.col("p.n").alias(f"{pivot}_n"), F.col("p.at").alias(f"{pivot}_at")]


class _Join:
    """The state of one join: nodes that are no outliers, and the exact results of the pairs checked so far."""

    def __init__(self, docs: DataFrame, words: int, percent: int) -> None:
        if words < 1 or not 1 <= percent <= 100:
            raise ValueError("shingles have a word at least, and 1 <= percent <= 100")
        self.docs, self.words, self.percent = docs, words, percent
        n_buckets = _buckets(docs)
        requests = _requests(docs, words, percent, n_buckets)
        self.held = [requests]
        asked = requests.where("bucket >= 0").select("block", "bucket", "owners", "keys").repartition(max(1, n_buckets // BUCKETS_PER_TASK), "bucket")
        told = arrow_map(asked, _answer, "block long, owners binary")
        both = told.selectExpr("block", "owners", "cast(null as array<long>) texts", "cast(null as array<long>) spare").unionByName(requests.where("bucket = -1").selectExpr("block", "cast(null as binary) owners", "texts", "spare"))
        left = materialise(arrow_map(both.repartition("block"), _left, "row long"), "jaccard-left")
        self.rows = requests.where("row is not null").select("row", "doc_id", *_KEY)
        full = self.rows.where("n > 0")
        self.groups = self.keep(full.groupBy(*_KEY).agg(F.min(F.struct("row", "doc_id")).alias("head"), F.min("doc_id").alias("least")).select(*_KEY, F.col("head.row").alias("node"), F.col("head.doc_id").alias("doc_id"), "least"), "jaccard-groups")
        few = left.count() <= BROADCAST_IDS
        keys = full.join(F.broadcast(left) if few else left, "row", "left_semi").select(*_KEY).distinct()
        wanted = materialise(self.groups.join(keys, _KEY).select("node", "doc_id", *_KEY), "jaccard-wanted")
        self.sets = self._sets(wanted)
        discard(left, wanted)
        self.links: DataFrame | None = None

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        """A written table that goes with the join."""
        out = materialise(df, label)
        self.held.append(out)
        return out

    def close(self) -> None:
        discard(*self.held)
        self.held = []

    def _sets(self, wanted: DataFrame) -> DataFrame:
        """(node, n, classes, shingles) of the wanted nodes, from the texts of their first rows; ``classes`` counts shingles by hash class."""
        total = wanted.count()
        few = total <= BROADCAST_IDS
        ids = wanted.select(F.col("doc_id").alias("_wanted")).distinct()
        narrow = self.docs.select("doc_id", F.col("text").cast("string").alias("text"))
        narrow = narrow.join(F.broadcast(ids) if few else ids, narrow["doc_id"].eqNullSafe(ids["_wanted"]), "left_semi")
        words = self.words

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch.column(0)):
                    total, bounds = _own(part, words)
                    n = np.diff(bounds)
                    s1, s2 = _set_hashes(total, bounds)
                    owner = np.repeat(np.arange(len(n)), n)
                    n_classes = 1 << np.ceil(np.log2(np.maximum(n / PER_CLASS, MIN_CLASSES))).astype(np.int64)
                    class_at = np.concatenate(([0], np.cumsum(n_classes)))
                    classes = np.bincount(class_at[owner] + (total & (n_classes[owner] - 1).astype(np.uint64)).astype(np.int64), minlength=class_at[-1])
                    packed = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(class_at.astype(np.int32).tobytes()), pa.py_buffer(np.minimum(classes, 255).astype(np.uint8).tobytes())])
                    shingles = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(total.view(np.int64)))
                    yield pa.RecordBatch.from_arrays([pa.array(n.astype(np.int32)), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), packed, shingles], [*_KEY, "classes", "shingles"])

        made = arrow_map(narrow.select("text"), run, "n int, s1 long, s2 long, classes binary, shingles array<long>")
        nodes = wanted.select("node", *_KEY)
        out = materialise(made.join(F.broadcast(nodes) if few else nodes, _KEY).select("node", "n", "classes", "shingles"), "jaccard-sets")
        if out.count() > total:  # rows that repeat an id and its text
            first, out = out, materialise(out.dropDuplicates(["node"]), "jaccard-sets")
            discard(first)
        self.held.append(out)
        return out

    def _near(self, n1: Column, at1: Column, n2: Column, at2: Column) -> Column:
        """Whether sets of these sizes can link if a shingle at these places is the first they share."""
        behind = F.least(n1 - at1, n2 - at2).cast("long")
        return (F.least(n1, n2).cast("long") * 100 >= F.greatest(n1, n2).cast("long") * self.percent) & (behind * (100 + self.percent) >= (n1 + n2).cast("long") * self.percent)

    def _members(self) -> DataFrame:
        """First regions: (token, c, node, n, at) of all replicas that are not alone in theirs; c is a region's size."""
        every = self.sets.select("node", "n", F.explode("shingles").alias("token"))
        # written, so that the join shuffles both sides anew and can split a hot shingle
        shared = materialise(every.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "jaccard-shared")
        held = materialise(every.join(shared, "token"), "jaccard-held")
        discard(shared)
        own = F.col("n") + F.floor((-F.col("n") * self.percent) / F.lit(100)).cast("int") + 1
        alone = F.col("n") - F.col("_held")
        left = held.groupBy("node").agg(F.max("n").alias("n"), F.count(F.lit(1)).cast("int").alias("_held")).where(alone < own)
        # shingles of one set only come first in the order and make no region
        left = materialise(left.select("node", alone.alias("_alone"), own.alias("_own")), "jaccard-nodes")
        rank = F.row_number().over(Window.partitionBy("node").orderBy("df", "token")) - 1
        replicas = held.join(left, "node").withColumn("at", F.col("_alone") + rank).where("at < _own").select("token", "node", "n", "at")
        replicas = materialise(replicas, "jaccard-replicas")
        discard(held, left)
        sizes = materialise(replicas.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "jaccard-regions")
        out = self.keep(replicas.join(sizes, "token"), "jaccard-members")
        discard(sizes)
        self.held.append(replicas)
        self.replicas = replicas
        return out

    def check(self, pairs: DataFrame, likely: bool) -> DataFrame:
        """Exact intersections of distinct pairs (a, b): a, b, shared, n1, n2.  Without ``likely`` those go first whose class counts are too far apart."""
        if not likely:
            pairs = self._close(pairs)
        side = lambda end, more: self.sets.select(F.col("node").alias(end), *more)
        with_a = pairs.select("a", "b").join(side("a", [F.col("n").alias("n1"), F.col("shingles").alias("x")]), "a")
        with_b = with_a.join(side("b", [F.col("n").alias("n2"), F.col("shingles").alias("y")]), "b")
        return self.keep(with_b.select("a", "b", "n1", "n2", F.size(F.array_intersect("x", "y")).alias("shared")), "jaccard-checked")

    def _close(self, pairs: DataFrame) -> DataFrame:
        side = self.sets.select("node", "n", "classes")
        both = pairs.join(side.select(F.col("node").alias("a"), F.col("n").alias("n1"), F.col("classes").alias("c1")), "a").join(side.select(F.col("node").alias("b"), F.col("n").alias("n2"), F.col("classes").alias("c2")), "b")
        percent = self.percent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n1, n2, c1, c2 = (batch.column(k) for k in (2, 3, 4, 5))
                sizes = n1.to_numpy(zero_copy_only=False).astype(np.int64) + n2.to_numpy(zero_copy_only=False)
                apart = np.array([_apart(x.as_buffer(), y.as_buffer()) for x, y in zip(c1, c2, strict=True)], np.int64)
                # |x ^ y| = n1 + n2 - 2 |x & y|, and |x & y| >= percent / (100 + percent) * (n1 + n2)
                yield batch.select([0, 1]).filter(pa.array(apart * (100 + percent) <= sizes * (100 - percent)))

        return self.keep(arrow_map(both.select("a", "b", "n1", "n2", "c1", "c2"), run, "a long, b long"), "jaccard-likely")

    def linked(self, checked: DataFrame) -> DataFrame:
        shared, union = F.col("shared"), F.col("n1") + F.col("n2") - F.col("shared")
        return checked.where(shared.cast("long") * 100 >= union.cast("long") * self.percent).select("a", "b")

    def joined(self, checked: DataFrame) -> DataFrame:
        """Adds the links in ``checked``; (node, comp) of all linked nodes."""
        found = self.linked(checked)
        self.links = found if self.links is None else self.links.unionByName(found)
        out = components(self.links)
        self.held.append(out)
        return out

    def run(self) -> DataFrame:
        """(node, comp) of all nodes in a component of more than one node."""
        members = self._members()
        # the more others a document meets in its regions, the fewer shingles of its own it has
        central = members.groupBy("node").agg(F.sum("c").alias("meets"))
        members = self.keep(members.join(central, "node"), "jaccard-members")
        best = F.max(F.struct("meets", "node", "n", "at")).alias("p")
        heads = members.groupBy("token").agg(best).select("token", *_named("pivot"))
        members = self.keep(members.join(heads, "token"), "jaccard-members")
        apart = (F.col("node") != F.col("pivot")) & self._near(F.col("n"), F.col("at"), F.col("pivot_n"), F.col("pivot_at"))
        checked: DataFrame | None = None
        work = float("inf")
        for step in range(1 + PIVOT_ROUNDS):
            stars = members.where(apart).select(F.greatest("node", "pivot").alias("a"), F.least("node", "pivot").alias("b")).distinct()
            if checked is not None:
                stars = stars.join(checked.select("a", "b"), ["a", "b"], "left_anti")
            found = self.check(stars, likely=checked is None)
            checked = found if checked is None else checked.unionByName(found)
            comps = self.joined(found)
            # pivots are done, as they have met everyone
            members = self.keep(members.where("node <> pivot").drop("comp").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "jaccard-members")
            # a region's largest component needs no pairs among its own
            by_comp = members.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("k"), best)
            main = by_comp.groupBy("token").agg(F.max(F.struct("k", "comp"))["comp"].alias("main"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("token", "main")
            left = by_comp.join(main, "token").where("comp <> main").groupBy("token", "main").agg(F.sum("k").alias("left"), F.max("p").alias("p"))
            open_regions = self.keep(left.select("token", "main", "left", *_named("_next")), "jaccard-open")
            if not open_regions.head(1):
                return comps
            members = self.keep(members.drop("main", "left", "_next", "_next_n", "_next_at").join(open_regions, "token"), "jaccard-members")
            large = F.col("left") * F.col("c") > REGION
            before, work = work, members.where(large).agg(F.sum("left")).first()[0] or 0
            if step == PIVOT_ROUNDS or not work or work > PROGRESS * before:
                break
            # small regions keep their pivot and wait; large ones take the most central member that is left
            for end in ("", "_n", "_at"):
                members = members.withColumn(f"pivot{end}", F.when(large, F.col(f"_next{end}")).otherwise(F.col(f"pivot{end}")))
        return self._pair(members, checked, comps)

    def _pair(self, members: DataFrame, checked: DataFrame, comps: DataFrame) -> DataFrame:
        """Pairs what lies outside its region's pivot component with all other members, checks, and closes the components."""
        distance = checked.select(F.col("a").alias("_a"), F.col("b").alias("_b"), (1 - F.col("shared") / (F.col("n1") + F.col("n2") - F.col("shared"))).alias("d"))
        members = members.withColumn("_a", F.greatest("node", "pivot")).withColumn("_b", F.least("node", "pivot")).join(distance, ["_a", "_b"], "left")
        # what stands before the region's shingle: two documents pair in the region of the first shingle they share
        prefix = self.replicas.join(members.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("at", "token"))).alias("_p"))
        before = F.transform(F.filter("_p", lambda p: p["at"] < F.col("at")), lambda p: p["token"]).alias("before")
        members = self.keep(members.join(prefix, "node").select("token", "node", "n", "at", "comp", "main", "d", before), "jaccard-members")
        x, y = members.where("comp <> main").alias("x"), members.alias("y")
        r = 1 - self.percent / 100 + 1e-9
        window = F.coalesce(F.abs(F.col("x.d") - F.col("y.d")) <= r, F.lit(True))
        once = (F.col("y.comp") == F.col("y.main")) | (F.col("x.node") < F.col("y.node"))
        pairs = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.comp") != F.col("y.comp")) & once & self._near(F.col("x.n"), F.col("x.at"), F.col("y.n"), F.col("y.at")) & window & ~F.arrays_overlap("x.before", "y.before"))
        pairs = pairs.select(F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b")).distinct()
        more = self.check(pairs.join(checked.select("a", "b"), ["a", "b"], "left_anti"), likely=False)
        return self.joined(more) if self.linked(more).head(1) else comps


def near_groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id that links reach) for each row of ``docs``."""
    join = _Join(docs, words, percent)
    comps = join.groups.join(join.run(), "node")
    least = comps.groupBy("comp").agg(F.min("least").alias("component_id"))
    linked = comps.join(least, "comp").select("node", "component_id")
    named = materialise(join.groups.join(linked, "node", "left").select(*_KEY, F.coalesce("component_id", "least").alias("component_id")), "jaccard-named")
    out = join.rows.where("n > 0").join(named, _KEY).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
    none = join.rows.where("n = 0").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    out = materialise(out.unionByName(none), "jaccard-result")
    discard(named)
    join.close()
    return out


def near_dedup(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One document of each group, the one with the least id, with all its columns."""
    groups = near_groups(docs, words, percent)
    gone = materialise(groups.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("_gone")).distinct(), "jaccard-gone")
    discard(groups)
    few = gone.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, docs["doc_id"] == gone["_gone"], "left_anti")
