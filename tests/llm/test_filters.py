import random
import re
from collections import Counter, defaultdict

import duckdb
import pandas as pd
import pytest

import corpus_pipeline
from arrayq.llm import language_id, quality, toxicity, url_filter
from tests.llm.corpus import documents, frame, prose


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def base_counts(text):
    text = text or ""
    w = words(text)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_quality_against_brute_force(spark):
    rows = documents()
    rng = random.Random(2)
    rows += [(200 + k, f"Shared  Banner line of the HOST\n{prose(rng, 'en', 60 if k % 2 else 3)}\nshared banner line of the host", "en", "h", 1, 7, True, 9) for k in range(12)]
    got = quality.judge(frame(spark, rows), max_line_docs=8).collect()
    lower = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s)
    holders = defaultdict(set)
    for r in rows:
        for line in (r[1] or "").split("\n"):
            if words(line):
                holders[r[3], " ".join(words(lower(line)))].add(" ".join(words(lower(r[1]))))
    want = []
    for r in rows:
        n, *rest = base_counts(r[1])
        taken = sum(len(words(x)) for x in (r[1] or "").split("\n") if words(x) and len(holders[r[3], " ".join(words(lower(x)))]) > 8)
        failed = n < 50 or 100 * rest[3] > 50 * n
        want.append((repr(r[0]), n, *rest, taken, failed, not failed and 100 * (n - taken) >= quality.MIN_LEFT_PERCENT * n))
    assert sorted((repr(g.doc_id), g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words, g.n_boilerplate_words, g.base_failed, g.kept) for g in got) == sorted(want)
    assert any(w[6] for w in want)


def test_quality_filter_keeps_columns_and_kept_rows(spark):
    docs = frame(spark)
    kept = quality.quality_filter(docs)
    good = {repr(r.doc_id) for r in quality.judge(docs).where("kept").collect()}
    assert kept.columns == docs.columns and {repr(r.doc_id) for r in kept.collect()} == good


def test_quality_filter_removes_boilerplate_lines(spark):
    rng = random.Random(5)
    bodies = [prose(rng, "en", 60) for _ in range(12)]
    rows = [(k, f"Shared  Banner\n\n{b}\nshared banner\n", "en", "h", None, 7, True, 9) for k, b in enumerate(bodies)]
    rows += [(20, f"shared banner\n{bodies[0]}", "en", "other", None, 7, True, 9), (21, f"é\r\n\n{bodies[1]}\n\n", "en", "h", None, 7, True, 9)]
    rows += [rows[0]]
    got = quality.quality_filter(frame(spark, rows), max_line_docs=8).collect()
    want = [(k, f"\n{b}\n") for k, b in enumerate(bodies)] + [r[:2] for r in rows[12:14]] + [(0, f"\n{bodies[0]}\n")]
    assert sorted((r.doc_id, r.text) for r in got) == sorted(want)
    banner = [(k, f"Shared Banner\n{prose(rng, 'en', 60)}", "en", "h", 1, 7, True, 9) for k in range(quality.MAX_LINE_DOCS + 1)]
    staged = corpus_pipeline.quality_rules(spark, frame(spark, banner), "").collect()
    assert {(r.doc_id, r.text, r.n_chars) for r in staged} == {(r[0], r[1][14:], len(r[1]) - 14) for r in banner}


def test_empty_tables(spark):
    empty = frame(spark, []).limit(0)
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert quality.judge(empty).count() == 0 and quality.quality_filter(empty).count() == 0
    assert language_id.identify(empty).count() == 0 and language_id.language_filter(empty).count() == 0
    assert toxicity.judge(empty, labels).count() == 0
    assert url_filter.judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_language_held_out_accuracy_and_defined_cases(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, lang, rng.randint(20, 60)), lang, "s", 1, 7, True, 9) for i in range(400) for lang in [rng.choice(["en", "de"])]]
    rows += [(1000, None, None, "s", 1, 7, True, 9), (1001, "123 !!", "en", "s", 1, 7, True, 9), (1002, "", "en", "s", 1, 7, True, 9), (1003, prose(rng, "de", 5000), None, "s", 1, 7, True, 9)]
    got = {r.doc_id: r for r in language_id.identify(frame(spark, rows)).collect()}
    truth = {r[0]: r[2] for r in rows}
    held = [i for i in range(400) if got[i].held_out]
    assert 60 < len(held) < 140 and sum(got[i].lang_pred == truth[i] for i in held) >= 0.97 * len(held)
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1003].lang_pred == "de"
    assert all(0 <= r.score <= 1 for r in got.values()) and all(got[i].score > 0.4 for i in held)
    kept = language_id.language_filter(frame(spark, rows))
    assert {1000, 1001, 1002}.isdisjoint({r.doc_id for r in kept.collect()}) and kept.columns == frame(spark, rows).columns


def test_language_without_labels_is_unknown(spark):
    rows = [(i, "some text", None, "s", 1, 7, True, 9) for i in range(5)]
    assert {r.lang_pred for r in language_id.identify(frame(spark, rows)).collect()} == {"und"}


def test_toxicity_held_out_and_located(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(600):
        text, bad = prose(rng, "en", rng.randint(30, 90)), i % 3 == 0
        if bad:
            lines = text.split("\n")
            lines[rng.randrange(len(lines))] = f"you are a {rng.choice(['grukk', 'Blarg', 'snorfle,'])} indeed."
            text = "\n".join(lines)
        rows.append((i, text, "en", "s", 1, 7, True, 9))
        labels.append((i, int(bad), 1))
    rows += [(1000, None, "en", "s", 1, 7, True, 9), (1001, "", "en", "s", 1, 7, True, 9)]
    marks = spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    docs = frame(spark, rows)
    got = {r.doc_id: r for r in toxicity.judge(docs, marks).collect()}
    held = [r for r in got.values() if r.held_out and r.doc_id < 1000]
    assert 120 < len(held) < 280 and sum(r.predicted == (r.doc_id % 3 == 0) for r in held) >= 0.95 * len(held)
    assert got[1000].score == got[1001].score == 0.0
    texts = {r[0]: r[1] for r in rows}
    for r in held[:60]:
        if r.predicted and r.doc_id % 3 == 0:
            assert re.search("grukk|blarg|snorfle", texts[r.doc_id].encode()[r.worst_start : r.worst_end].decode().lower())
    model = toxicity.fit(docs, marks)
    spans = toxicity.locate(model, "All is well here. You are a grukk indeed. And so on.")
    assert len(spans) == 1 and spans[0][0] == 18


def test_toxicity_with_one_kind_of_label(spark):
    marks = spark.createDataFrame([(i, 0) for i in range(20)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.judge(frame(spark), marks).collect()} == {0.0}


URLS = [
    ("https://Shop.EXAMPLE.com/en/71?x=1", "shop.example.com", "/en/71", "example.com/en/7", "allow"), ("http://a.com/en/9#t", "a.com", "/en/9", "com/en/", "block"), ("x://b.net/de/", "b.net", "/de/", "net/de/", "block"),
    ("x://w.example.net/de/85.html", "w.example.net", "/de/85.html", "example.net/de/8", "block"), ("x://notcom/en/1", "notcom", "/en/1", None, None), ("x://c.com?q=/en/", "c.com", "", None, None),
    ("no scheme", "", "", None, "allow"), (None, "", "", None, "allow"), ("a://", "", "", None, "allow"), ("x://É.org/es/é", "É.org", "/es/é", "org/es/", "block"), ("x://com/en/2", "com", "/en/2", "com/en/", "block"),
]


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u[0], "x", "y") for i, u in enumerate(URLS)], "page_id long, url string, host string, bad string")
    for r in url_filter.judge_urls(pages).collect():
        _, host, path, rule, verdict = URLS[r.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule) and verdict in (None, r.verdict)


def brute_verdicts(urls):
    """The method in plain Python, for urls that no rule decides."""
    rules = url_filter.RULES

    def split(u):
        rest = u.split("://", 1)[1]
        host = re.match("[^/?#]*", rest)[0]
        return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match("[^?#]*", rest[len(host) :])[0]

    def rule(host, path):
        best = None
        for verdict, r in rules:
            own, _, p = r.partition("/")
            if (host == own or host.endswith("." + own)) and path.startswith("/" + p) and (best is None or len(r) > len(best[1])):
                best = (verdict, r)
        return best

    def kind(s):
        stem = re.sub(r"\.[A-Za-z]{1,5}$", "", s)
        return "{n}" if re.fullmatch("[0-9]+", stem) else "{h}" if re.fullmatch("[0-9a-fA-F-]{8,}", stem) else "{x}" if re.search("[0-9]", stem) else stem or s

    rows = []
    for u in urls:
        host, path = split(u)
        parts = [s for s in path.split("/") if s]
        r = rule(host, path)
        rows.append((host, [kind(x) for x in parts], None if r is None else r[0] == "block"))
    marks = [r[2] for r in rows if r[2] is not None]
    prior = (sum(marks) + 1) / (len(marks) + 2)
    bad = set()

    def labels(group):
        known = [rows[i][2] for i in group if rows[i][2] is not None]
        return len(known), sum(known)

    def judged(m, n):
        return m >= url_filter.MIN_LABELLED and 100 * m >= n * url_filter.MIN_LABELLED_PERCENT

    def children(group, depth):
        """Rows by what follows their first ``depth`` classes; words among too many are one wildcard."""
        at = lambda i: rows[i][1][depth] if depth < len(rows[i][1]) else ""
        fixed = ("", "{n}", "{h}", "{x}")
        wide = len({at(i) for i in group} - set(fixed)) > url_filter.MAX_CHILDREN
        found = defaultdict(list)
        for i in group:
            found["*" if wide and at(i) not in fixed else at(i)].append(i)
        return found

    def grow(below, depth):
        """Judges the template that ends here and follows what goes on, alike branches together."""
        ends = below.pop("", [])
        m, b = labels(ends)
        if ends and judged(m, len(ends)) and (b + url_filter.SMOOTHING * prior) / (m + url_filter.SMOOTHING) >= url_filter.MIN_PURITY:
            bad.update(ends)
        alike = defaultdict(list)
        for t, group in below.items():
            m, b = labels(group)
            nxt = children(group, depth + 1)
            if judged(m, len(group)):
                alike[tuple(sorted(nxt))].append((b / m, t, m, b, nxt))
            elif m >= url_filter.MIN_LABELLED:
                grow(nxt, depth + 1)
        for members in alike.values():
            pools, last = [], None
            for p, _, m, b, nxt in sorted(members, key=lambda x: x[:2]):
                pooled = 0 if last is None else (b + last[2]) / (m + last[1])
                if last is None or (p - last[0]) ** 2 > url_filter.MERGE_Z2 * pooled * (1 - pooled) * (1 / m + 1 / last[1]):
                    pools.append(defaultdict(list))
                for u, group in nxt.items():
                    pools[-1][u] += group
                last = (p, m, b)
            for pool in pools:
                grow(pool, depth + 1)

    hosts = defaultdict(list)
    for i, r in enumerate(rows):
        hosts[r[0]].append(i)
    for group in hosts.values():
        grow(children(group, 0), 0)
    return ["block" if r[2] or (r[2] is None and i in bad) else "allow" for i, r in enumerate(rows)]


def test_url_templates_against_brute_force(spark):
    rng = random.Random(8)
    urls = []
    for host in ("a.com", "b.com", "x.example.com", "c.net", "d.org", "e.io"):
        for lang, n in (("en", 60), ("fr", 12), ("de", 20), ("es", 9)):
            urls += [f"https://{host}/{lang}/{rng.randint(0, 999)}{rng.choice(['', '.html', '/', '?a=b'])}" for _ in range(n)]
        urls += [f"https://{host}/{lang}/{rng.choice(['news', 'shop'])}/{rng.getrandbits(40):010x}" for lang in ("en", "fr") for _ in range(10)]
        urls += [f"https://{host}/tag-{k}x/p{k}" for k in range(5)] + [f"https://{host}/{w}/y" for w in ("".join(rng.choice("abcdef") for _ in range(6)) for _ in range(50))]
        # paths that differ late only, alike branches below the first level, and paths that share a template but no rule
        for first, n in (("en", 24), ("en.html", 4)):
            for tail, number in (("good", 7), ("bad", 8)):
                urls += [f"https://{host}/{first}/{number}{k}/a/b/c/{tail}/{w}/.x/{rng.randint(0, 9)}" for k in range(n) for w in ("p", "q")]
        urls += [f"https://{host}/en/{'y/' * 12}{k}" for k in range(8)] + [f"https://{host}/{{n}}/*/{'y/' * 40}{k}" for k in range(8)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = [r.verdict for r in url_filter.judge_urls(pages).orderBy("page_id").collect()]
    assert got == brute_verdicts(urls)
    late = {u.split("/")[8]: v for u, v in zip(urls, got, strict=True) if "x.example.com/en.html/" in u}
    assert late == {"good": "allow", "bad": "block"}, "a segment far down the path decides"
    shown = pd.DataFrame({"page_id": range(len(urls)), "url": urls})
    sql = dict(duckdb.connect().register("pages", shown).execute(f"SELECT page_id, verdict FROM ({url_filter.ORACLE_SQL})").fetchall())
    for i, u in enumerate(urls):
        if len([x for x in u.split("?")[0].split("/")[3:] if x]) <= url_filter.SQL_LEVELS:
            assert sql[i] == got[i], u
    ruled = {r.page_id for r in url_filter.judge_urls(pages).where("rule is null and verdict = 'block'").collect()}
    assert ruled, "templates decide some urls that rules do not"


@pytest.mark.parametrize("n", [0, 1])
def test_url_filter_needs_evidence(spark, n):
    pages = spark.createDataFrame([(i, f"https://q.io/en/{i}") for i in range(n)], "page_id long, url string")
    assert all(r.verdict == "allow" for r in url_filter.judge_urls(pages).collect())


def test_url_rules_have_the_words_of_the_contract(spark):
    words = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    pages = spark.createDataFrame([(k, f"x://w.{rule}1") for k, rule in enumerate(words)], "page_id long, url string")
    assert {r.rule: r.verdict for r in url_filter.judge_urls(pages).collect()} == words
