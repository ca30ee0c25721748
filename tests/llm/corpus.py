"""Small tables with the awkward rows that every operator must handle."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, kept boolean, _row long"

_SYLLABLES = {"en": ["the", "ing", "tion", "er", "st", "wh"], "de": ["ein", "sch", "ung", "lich", "ver", "ge"]}


def prose(rng, lang, n):
    words = []
    for _ in range(n):
        words.append("".join(rng.choice(_SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) + rng.choice(["", "", "", ",", "."]))
    lines, i = [], 0
    while i < n:
        k = rng.randint(5, 20)
        lines.append(" ".join(words[i : i + k]))
        i += k
    return "\n".join(lines)


def documents(n=40, seed=3):
    """Prose in two languages, copies, near copies, nulls, empty and long texts, repeated rows, odd characters."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(["en", "de"])
        rows.append([i, prose(rng, lang, rng.randint(3, 120)), lang, f"s{i % 3}"])
    rows += [[100, rows[3][1], "en", "s0"], [101, rows[3][1].replace(" ", "  "), "en", "s1"], [102, None, None, None], [103, "", "en", "s1"], [104, " \n\t ", None, "s2"]]
    base = rows[5][1].split(" ")
    for k in range(4):
        words = list(base)
        words[(7 * k) % len(words)] = f"edit{k}"
        rows.append([110 + k, " ".join(words), "en", "s0"])
    rows += [[120, prose(rng, "en", 4000), "en", "s1"], [121, "x" * 30000, "en", "s2"], [122, "日本語 のテキスト 😀 ▁ \u0085 é é <|endoftext|> it's", "en", "s2"], [123, "123 456 !!", "en", "s0"], [124, "A\r\nb\x00c\x0bd", "en", "s0"]]
    rows += [list(rows[8]), list(rows[8]), [None, "a row without an id at all", "en", None]]
    return [(*r, len(r[1]) if r[1] is not None else None, 7, True, 9) for r in rows]


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA).repartition(3)
