import collections
import hashlib
import random
import re

import pytest

from arrayq.llm import exact_dedup, jaccard_join
from arrayq.llm.components import components
from tests.llm.corpus import documents, frame

SPACES = r"[\x20\x09-\x0D]+"


@pytest.mark.parametrize("bits", [256, 1 << 26])
def test_exact_groups(spark, bits):
    docs = documents()
    got = exact_dedup.exact_groups(frame(spark), 400 if bits < 1000 else 16, max_bits=bits).collect()
    groups = collections.defaultdict(list)
    for r in docs:
        groups[re.sub(SPACES, " ", r[1] or "")].append(r[0])
    assert len(got) == len(docs)
    for text, ids in groups.items():
        digest = hashlib.sha256(text.encode()).hexdigest()
        own = [r for r in got if r.text_sha256 == digest]
        keep = min((i for i in ids if i is not None), default=None)
        assert len(own) == len(ids) and {r.keep_id for r in own} == {keep} and {r.group_size for r in own} == {len(ids)}
        assert sum(r.kept for r in own) == 1


@pytest.mark.parametrize(("per_row", "bits"), [(16, 1 << 26), (400, 4096)])
def test_exact_dedup_keeps_one_row_of_each_text_and_all_columns(spark, per_row, bits):
    """With one filter, and range by range."""
    docs = frame(spark)
    kept = exact_dedup.exact_dedup(docs, per_row, bits)
    texts = [re.sub(SPACES, " ", r.text or "") for r in kept.collect()]
    assert kept.columns == docs.columns and len(texts) == len(set(texts)) == len({re.sub(SPACES, " ", r[1] or "") for r in documents()})


def test_empty_table(spark):
    empty = frame(spark, []).limit(0)
    assert exact_dedup.exact_groups(empty).count() == 0 and exact_dedup.exact_dedup(empty).count() == 0
    assert jaccard_join.near_groups(empty).count() == 0 and jaccard_join.near_dedup(empty).count() == 0


def brute(rows, words, percent):
    """component by row number, from all pairs."""
    sets = []
    for r in rows:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        sets.append({tuple(w[j : j + words]) for j in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return sorted((repr(r[0]), len(sets[i]), repr(least.get(root(i)))) for i, r in enumerate(rows))


def family(rng, size, length, edits):
    """Copies of one text, each with some words of its own."""
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(length)]
    out = []
    for _ in range(size):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(length)] = f"e{rng.randint(0, 10**9)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize(("words", "percent"), [(3, 90), (5, 80), (1, 50)])
def test_near_groups_on_awkward_rows(spark, words, percent):
    got = jaccard_join.near_groups(frame(spark), words, percent).collect()
    assert sorted((repr(r.doc_id), r.n_shingles, repr(r.component_id)) for r in got) == brute(documents(), words, percent)


@pytest.mark.parametrize(("region", "progress", "bucket", "block"), [(1024, 0.75, 1 << 24, 1 << 20), (4, 2.0, 256, 100)])
def test_near_groups_in_large_regions(spark, monkeypatch, region, progress, bucket, block):
    """Families whose members are just within or beyond the threshold, and a passage that all documents share; with many buckets and blocks, too."""
    for name, value in (("REGION", region), ("PROGRESS", progress), ("BUCKET_BYTES", bucket), ("BLOCK", block), ("BLOCK_MOST", block)):
        monkeypatch.setattr(jaccard_join, name, value)
    rng = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(40))
    texts = family(rng, 60, 60, 4) + family(rng, 40, 120, 6) + [f"{passage} " + " ".join(f"u{k}x{i}" for i in range(rng.randint(1, 30))) for k in range(60)] + [passage] * 20
    rows = [(i, t, "en", "s", len(t), 7, True, 9) for i, t in enumerate(texts)]
    got = jaccard_join.near_groups(frame(spark, rows), 3, 90).collect()
    want = brute(rows, 3, 90)
    assert sorted((repr(r.doc_id), r.n_shingles, repr(r.component_id)) for r in got) == want
    assert len({w[2] for w in want}) < len(want) - 50


def test_near_dedup_keeps_one_of_each_group(spark):
    docs = frame(spark)
    kept = jaccard_join.near_dedup(docs, 3, 90)
    want = {w[2] for w in brute(documents(), 3, 90)} - {"None"}
    assert kept.columns == docs.columns and {repr(r.doc_id) for r in kept.collect()} - {"None"} == want


@pytest.mark.parametrize("local", [0, 1000])
def test_components_of_chains_and_stars(spark, local):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(60)] + [(100, 101 + k) for k in range(50)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(links, "a long, b long"), local).collect()}
    assert {got[i] for i in range(61)} == {0} and {got[i] for i in range(100, 151)} == {100}
    for a, b in links:
        assert a == b or got[a] == got[b] <= min(a, b)
