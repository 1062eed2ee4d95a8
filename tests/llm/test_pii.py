import random
import re

import numpy as np

from lakeloom.llm import pii

PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def brute(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            luhn = lambda: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0  # noqa: B023,E731
            ok = k == 0
            ok |= k == 1 and all(int(x) <= 255 for x in m[0].split("."))
            ok |= k == 2 and 16 <= len(digits) <= 19 and luhn()
            ok |= k == 3 and 8 <= len(digits) <= 15
            if ok:
                out.append((k, *m.span()))
    return out


def test_base_equals_plain_patterns():
    rng = random.Random(3)
    for alphabet in ("a@.b1", "12. 3-+()", "0123456789 -", "+1 (5)-", "ab@c.d@ \n", "é@a.b1"):
        for _ in range(3000):
            t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
            assert pii.base_spans(t) == brute(t), repr(t)


def test_long_numbers_and_letters_that_change_length():
    for t in ("0" * 5000 + ".1.1.1", "9" * 5000 + ".1.1.1", "1.2.3." + "0" * 9000 + "7", "1" * 9000, "+" + "1" * 9000):
        assert [(k, s, e) for k, s, e in pii.base_spans(t)] == [(1, 0, len(t))] * (t[0] != "9" and t.count(".") == 3)
    text = "İ write to maria.lopez@example.com or MARIA.LOPEZ there"
    base = pii.base_spans(text)
    assert any(text[s:e] == "MARIA.LOPEZ" for s, e, k in pii.tokens(text, base) if k == pii.NONE)


def test_the_field_runs_on_documents_without_base_spans():
    weights = np.zeros((pii.FEATURES, 5))
    weights[0, 0] = 9.0  # a token with an @
    model = pii.SkipChain(weights, np.zeros((5, 5)))
    assert model.added(["write to me@home now"], [[]]) == [[(0, 9, 16)]]


def test_messages_equal_enumeration_on_a_tree():
    rng = np.random.default_rng(0)
    unary, chain = rng.normal(size=(3, 5)), rng.normal(size=(5, 5))
    left, hub_of, hub = np.array([0]), np.array([1, 2]), np.array([0, 0])
    joint = np.zeros((5, 5, 5))
    for a in range(5):
        for b in range(5):
            for c in range(5):
                total = sum(np.exp(pii.SKIP * ((b == h) + (c == h))) for h in range(5))
                joint[a, b, c] = np.exp(unary[0, a] + unary[1, b] + unary[2, c] + chain[a, b]) * total
    joint /= joint.sum()
    got = np.exp(pii.beliefs(unary, left, hub_of, hub, chain, rounds=10))
    for axis in range(3):
        want = joint.sum(axis=tuple(k for k in range(3) if k != axis))
        assert np.allclose(got[axis], want, atol=1e-6)


def test_edges_and_consistency(spark):
    rows = [
        (1, "call +1 (974) 555-3436 now. Later: (974) 555-3436 again", "x"),
        (2, None, "x"),
        (3, "", "x"),
        (None, "mail ab@c.de", "x"),
        (5, "nothing here " * 5000, "x"),
        (1, "call +1 (974) 555-3436 now. Later: (974) 555-3436 again", "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pii_spans string")
    model = pii.train(spark.createDataFrame([(i, f"ring +1 (97{i % 10}) 555-34{i % 90 + 10} or mail u{i}@m.com from 10.0.0.{i} at {i}") for i in range(200)], "doc_id long, text string"))
    got = pii.find_pii(docs, model).collect()
    assert len(got) == 6 and got[1].pii_spans == [] and got[2].pii_spans == [] and got[4].pii_spans == []
    first = [(s.kind, s.start, s.end, s.base) for s in got[0].pii_spans]
    assert ("phone", 5, 22, True) in first and first[1][0] == "phone" and not first[1][3]
    assert got[0].pii_spans == got[5].pii_spans
    assert [(s.kind, s.start, s.end) for s in got[3].pii_spans] == [("email", 5, 12)]
    clean = pii.redact(docs.select("doc_id", "text"), model).collect()
    assert pii.redact(docs.select("text", "doc_id").limit(0), model).count() == 0
    odd = spark.createDataFrame([("a@b.de 1.1.1.1@b.de", 1, None)], "text string, kind int, start string")
    assert pii.redact(odd, model).collect()[0][1:] == (1, None)
    assert "555" not in clean[0].text and clean[1].text is None and clean[4].text == rows[4][1]
    assert pii.find_pii(docs.limit(0), model).count() == 0
    assert pii.train(docs.where("doc_id = 3")).weights.shape == (pii.FEATURES, 5)
