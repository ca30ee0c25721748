"""Quality rules: cross-document line frequency.

Each text is split at line feeds; a line's hash is taken over its lower-cased
words, so case and spacing do not matter.  Across documents the distinct
contents that hold a line are counted for each host.  Lines above
``max_line_docs`` and above one in ``LINE_SHARE`` of the host's contents are
boilerplate: their words are taken off the documents that
hold them, and a document with less than ``min_left_percent`` of its words left
is depleted and rejected; :func:`quality_filter` removes those lines from the
texts it keeps and leaves the other lines, empty ones too, in their order.  Exact copies of a text count once, so a page that
was merely crawled often does not condemn its own lines.

Base rules come first: documents of fewer than ``MIN_WORDS`` words, or with
more than half of their words in repeated three-word windows, fail.

Defined results: null and empty texts have no words and fail the base rules;
a null host is a host of its own; repeated rows each get a row; an empty table
gives an empty table; extra columns are ignored by :func:`judge` and kept by
:func:`quality_filter`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arrayq.llm.shared import arrow_map, materialise
from arrayq.llm.spans import Texts, mix, sequences, slices, windows

MIN_WORDS = 50
MAX_LINE_DOCS = 40
#: A line in at most one of so many of its host's distinct contents is no boilerplate either.
LINE_SHARE = 500
#: Verdicts that may be broadcast, and the places in them (about 16 MB each).
BROADCAST_VERDICTS, BROADCAST_PLACES = 300_000, 4_000_000
MIN_LEFT_PERCENT = 40
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, content long, lines array<long>, line_words array<long>"
_PLACES = ", line_places array<array<int>>"


def _per_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of ``flags`` between successive bounds."""
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[at[1:]] - total[at[:-1]]


def _in_repeats(rolled: np.ndarray, owner: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Marks the words in three-word windows that occur twice or more in their own text."""
    covered = np.zeros(len(owner), bool)
    inside = np.flatnonzero(owner[: len(rolled)] == owner[2 : 2 + len(rolled)]) if len(rolled) else np.zeros(0, int)
    keys = mix(rolled[inside] + mix(owner[inside].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice = inside[np.concatenate((order[1:][same], order[:-1][same]))]
    for j in range(3):
        covered[twice + j] = True
    return covered


def _distinct(owner: np.ndarray, keys: np.ndarray, n: int, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each text its distinct keys: bounds, keys, summed weights; the order that sorts by key, and where each key begins in it."""
    order = np.lexsort((keys, owner))
    owner, keys, weights = owner[order], keys[order], weights[order]
    first = np.concatenate(([True], (owner[1:] != owner[:-1]) | (keys[1:] != keys[:-1]))) if len(owner) else np.zeros(0, bool)
    heads = np.flatnonzero(first)
    sums = np.add.reduceat(weights, heads) if len(heads) else weights
    return np.concatenate(([0], np.cumsum(np.bincount(owner[heads], minlength=n)))), keys[heads], sums, order, heads


def _profile(part: Texts) -> list[pa.Array]:
    """For each text the counts, a content hash, and its distinct lines with the words they hold in all and the places where they stand."""
    n = len(part)
    starts, ends, at = part.words()
    owner = np.repeat(np.arange(n), np.diff(at))
    folded = part.lowered().hashes(starts, ends)
    points = np.concatenate(([0], np.cumsum((part.data & 0xC0) != 0x80)))
    covered = _in_repeats(windows(part.hashes(starts, ends), 3), owner, at)
    feeds = np.flatnonzero(part.data == 10)
    from_ = np.sort(np.concatenate((part.at[:-1], feeds + 1)), kind="stable")
    line_owner = np.sort(np.concatenate((np.arange(n), np.searchsorted(part.at, feeds, "right") - 1)), kind="stable")
    last = np.concatenate((line_owner[1:] != line_owner[:-1], [True]))
    to = np.where(last, part.at[line_owner + 1], np.concatenate((from_[1:] - 1, [0])))
    from_ = np.minimum(from_, to)  # a text may end in a line feed
    w0, w1 = np.searchsorted(starts, from_), np.searchsorted(starts, to)
    full = w1 > w0
    places = (np.arange(len(line_owner)) - np.searchsorted(line_owner, line_owner))[full]
    from_, to, w0, w1, line_owner = from_[full], to[full], w0[full], w1[full], line_owner[full]
    raw_at, *_ = _distinct(line_owner, part.hashes(from_, to), n, w1 - w0)
    lines_at, lines, line_words, order, heads = _distinct(line_owner, sequences(folded, w0, w1), n, w1 - w0)
    return [
        *(pa.array(x.astype(np.int64)) for x in (np.diff(at), _per_text(points[ends] - points[starts], at), _per_text(_SYMBOL[part.data], part.at), np.bincount(line_owner, minlength=n) - np.diff(raw_at), _per_text(covered, at))),
        pa.array(sequences(folded, at[:-1], at[1:]).view(np.int64)),
        pa.ListArray.from_arrays(pa.array(lines_at, pa.int32()), pa.array(lines.view(np.int64))),
        pa.ListArray.from_arrays(pa.array(lines_at, pa.int32()), pa.array(line_words.astype(np.int64))),
        pa.ListArray.from_arrays(pa.array(lines_at, pa.int32()), pa.ListArray.from_arrays(pa.array(np.append(heads, len(order)), pa.int32()), pa.array(places[order].astype(np.int32)))),
    ]


def _profiles(docs: DataFrame, host: str, places: bool = False) -> DataFrame:
    schema = _SCHEMA + _PLACES if places else _SCHEMA
    narrow = docs.select("doc_id", F.col("text").cast("string").alias("text"), _host(host).alias("host"), F.monotonically_increasing_id().alias("row"), _row_key(host).alias("row_key"))
    kept = ("doc_id", "host", "row", "row_key")
    names = [*kept, *(x.split()[0] for x in schema.split(", "))]
    id_type = narrow.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1)):
                own = batch.slice(part.first, len(part))
                yield pa.RecordBatch.from_arrays([*(own.column(own.schema.get_field_index(c)) for c in kept), *_profile(part)][: len(names)], names)

    return materialise(arrow_map(narrow, run, f"doc_id {id_type}, host string, row long, row_key long, {schema}"), "quality-profiles")


def _host(host: str) -> Column:
    return F.coalesce(F.concat(F.lit("h"), F.col(host).cast("string")), F.lit(""))


def _row_key(host: str) -> Column:
    """Rows with equal id, text and host have the same verdict."""
    return F.xxhash64("doc_id", "text", _host(host))


def judge(docs: DataFrame, host: str = "source", max_line_docs: int = MAX_LINE_DOCS, min_left_percent: int = MIN_LEFT_PERCENT) -> DataFrame:
    """A row for each document: doc_id, the base counts, words on boilerplate lines, base_failed, kept."""
    return _judged(_profiles(docs, host), max_line_docs, min_left_percent)


def _judged(profiles: DataFrame, max_line_docs: int, min_left_percent: int, *more: str) -> DataFrame:
    """Verdicts; profiles with places also give ``boilerplate``, the places of the lines to remove."""
    placed = "line_places" in profiles.columns
    lines = profiles.select("host", "content", "row", F.posexplode(F.arrays_zip("lines", "line_words")).alias("at", "l")).select("host", "content", "row", "at", F.col("l.lines").alias("line"), F.col("l.line_words").alias("words"))
    once = lines.select("host", "line", "content").distinct()
    often = once.groupBy("host", "line").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") > max_line_docs)
    # contents are told apart first, so a host with most of them is counted from many partial counts
    hosts = profiles.where(F.size("lines") > 0).select("host", "content").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("contents"))
    common = often.join(hosts.where(F.col("contents") > max_line_docs), "host").where(F.col("docs") * LINE_SHARE > F.col("contents")).select("host", "line")
    taken = lines.join(common, ["host", "line"]).groupBy("row").agg(F.sum("words").alias("taken"), *([F.collect_list("at").alias("ats")] if placed else []))
    joined = profiles.drop("lines", "line_words", "content", "host").join(taken, "row", "left")
    n, taken_words = F.col("n_words"), F.coalesce(F.col("taken"), F.lit(0)).cast("long")
    failed = (n < MIN_WORDS) | (F.col("n_repeat_words") * 100 > n * 50)
    kept = ~failed & ((n - taken_words) * 100 >= n * min_left_percent)
    boilerplate = [F.array_sort(F.flatten(F.transform("ats", lambda i: F.get("line_places", i)))).alias("boilerplate")] if placed else []
    return joined.select("doc_id", *more, *_COUNTS, failed.alias("base_failed"), kept.alias("kept"), taken_words.alias("n_boilerplate_words"), *boilerplate)


def _without(text: Column, places: Column) -> Column:
    """``text`` without the lines at ``places``; the outer ``transform`` splits it once only."""

    def left(lines: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), places)
        return F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")

    return F.get(F.transform(F.array(F.split(text, "\n", -1)), left), F.lit(0))


def quality_filter(docs: DataFrame, host: str = "source", max_line_docs: int = MAX_LINE_DOCS, min_left_percent: int = MIN_LEFT_PERCENT) -> DataFrame:
    """The documents that are kept, with all their columns, and ``text`` without boilerplate lines."""
    judged = _judged(_profiles(docs, host, places=True), max_line_docs, min_left_percent, "row_key")
    touched = judged.where(~F.col("kept") | F.col("boilerplate").isNotNull()).select("row_key", "kept", F.when(F.col("kept"), F.col("boilerplate")).alias("places"))
    verdicts = materialise(touched.distinct(), "quality-verdicts")
    total, places = verdicts.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.greatest(F.size("places"), F.lit(0))), F.lit(0))).first()
    found = verdicts.select(F.col("row_key").alias("_row_key"), F.struct("kept", "places").alias("_verdict"))
    # the document's own columns stay in a struct, so none of their names can clash
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), _row_key(host).alias("_row_key"))
    few = total <= BROADCAST_VERDICTS and places <= BROADCAST_PLACES
    found = packed.join(F.broadcast(found) if few else found, "_row_key", "left").where(F.coalesce(F.col("_verdict.kept"), F.lit(True)))
    text = F.col("_doc.text").cast("string")
    cleaned = F.when(F.col("_verdict.places").isNotNull(), _without(text, F.col("_verdict.places"))).otherwise(text)
    return found.select(*[cleaned.alias(c) if c == "text" else F.col(f"_doc.`{c}`").alias(c) for c in docs.columns])


#: The query's rows in plain SQL (lines compared as strings instead of hashes).
ORACLE_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)
), rep AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + j) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS j) GROUP BY doc_id
), line AS (
  SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS raw FROM d
), words AS (
  SELECT doc_id, host, text, raw, regexp_extract_all(raw, '[^\x20\x09-\x0D]+') AS lw FROM line
), full_lines AS (
  SELECT doc_id, host, text, raw, len(lw) AS n,
         translate(array_to_string(lw, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM words WHERE len(lw) > 0
), dup AS (
  SELECT doc_id, count(*) - count(DISTINCT raw) AS n FROM full_lines GROUP BY doc_id
), content AS (
  SELECT doc_id, translate(array_to_string(w, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM d
), hosts AS (
  SELECT host, count(DISTINCT body) AS contents FROM full_lines JOIN content USING (doc_id) GROUP BY host
), common AS (
  SELECT host, norm FROM (SELECT host, norm, count(DISTINCT body) AS docs FROM full_lines JOIN content USING (doc_id) GROUP BY host, norm) JOIN hosts USING (host)
  WHERE docs > {MAX_LINE_DOCS} AND docs * {LINE_SHARE} > contents
), taken AS (
  SELECT doc_id, sum(n) AS n FROM full_lines JOIN common USING (host, norm) GROUP BY doc_id
), base AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
         CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(taken.n, 0) AS BIGINT) AS n_boilerplate_words
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN taken USING (doc_id)
)
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words)
         AND 100 * (n_words - n_boilerplate_words) >= {MIN_LEFT_PERCENT} * n_words AS kept
FROM base
"""
