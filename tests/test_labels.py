"""Labels and titles in blocks, against all pairs."""

import difflib
import random
import re
import time

from lakeloom.operators import parsing


def score(label, title):
    a, b = (re.sub(r"[^\w]|_", "", x or "").lower() for x in (label, title))
    short, long = sorted((len(a), len(b)))
    if short == 0:
        return 0.0
    if a == b:
        return 1.0
    if a in b or b in a:
        return 0.9 + 0.1 * short / long
    if short < 4:
        return 0.0
    size = sum(m.size for m in difflib.SequenceMatcher(None, a, b).get_matching_blocks())
    of_a, of_both = size / len(a), 2 * size / (len(a) + len(b))
    return 0.8 + 0.15 * of_a + 0.05 * of_both if of_a >= 0.8 else of_both


def all_pairs(labels, titles):
    out = set()
    for answer, label in labels:
        best = {}
        for other, url, title in titles:
            if other == answer:
                best[url] = max(best.get(url, 0.0), score(label, title))
        ranked = sorted((-s, u) for u, s in best.items())
        if ranked and -ranked[0][0] >= 0.72 and (len(ranked) == 1 or ranked[1][0] - ranked[0][0] >= 0.08):
            out.add((answer, label, ranked[0][1]))
    return out


def test_matches_equal_all_pairs(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(("er", "ing", "th", "on", "é", "規則", "a", "x")) for _ in range(rng.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(rng.randint(0, n)))
    titles = [(rng.randint(1, 3), f"u{rng.randint(1, 90)}", rng.choice([text(4), text(9), text(30), None])) for _ in range(120)]

    def changed(t):
        t = list(t or "")
        for _ in range(rng.randint(0, 5)):
            if t:
                t[rng.randrange(len(t))] = rng.choice(["", "q", "er", "-", "A"])
        return "".join(t)

    labels = sorted({(a, changed(t)) for a, _, t in titles} | {(a, text(5)) for a in (1, 2, 4) for _ in range(20)} | {(2, "")})
    want = all_pairs(labels, titles)
    got = parsing.match_labels(spark.createDataFrame(labels, "answer long, label string"), spark.createDataFrame(titles, "answer long, url string, title string"), block=16)
    assert {tuple(r) for r in got.collect()} == want and len(want) > 20


def test_one_answer_of_many_titles(spark):
    """2.2 million pairs, too many for difflib on each."""
    rng = random.Random(4)
    titles = [(1, f"u{i}", " ".join("".join(rng.choice(("er", "ing", "th", "on", "ea", "ou")) for _ in range(rng.randint(1, 4))) for _ in range(10))) for i in range(1500)]
    labels = [(1, t.partition(" ")[2]) for _, _, t in titles]
    start = time.monotonic()
    got = parsing.match_labels(spark.createDataFrame(labels, "answer long, label string"), spark.createDataFrame(titles, "answer long, url string, title string")).collect()
    assert len(got) > 1000 and time.monotonic() - start < 60
