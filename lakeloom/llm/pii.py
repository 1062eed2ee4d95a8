"""Personal data by patterns and a skip-chain conditional random field.

Base spans come from four patterns and always stay.  The field labels the candidate tokens of a document (runs without
white space that hold a digit or an @, and tokens that spell out the letters before the @ of a found address) as
email, ip, card, phone or none:

* unary potentials: a log-linear model of a token's shape, its neighbours' shapes, and, for tokens inside base spans,
  what the patterns say;
* chain potentials between neighbouring candidates with at most `REACH` characters between them;
* skip potentials: tokens of one document with the same letters and digits, or the same last `TAIL` digits, however
  far apart, hang on one hub variable that favours equal labels.  A hub keeps the number of messages in proportion to
  the tokens, where all pairs of similar tokens would be quadratic.

Loopy sum-product messages go a fixed number of rounds.  A token of no base span whose belief in a kind reaches
`BELIEF` becomes a span of that kind.  So "(974) 555-3436" is found where "+1 (974) 555-3436" stands elsewhere in the
document.

The unary model and the chain potentials are fitted on a bounded sample, `SAMPLE` documents of least hash, with the base
spans as labels; features don't tell whether a pattern matched.

Scale: one pass with no shuffle but the sample's; documents go whole to one row of one task; what is broadcast is a
matrix of fixed size.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import least_hashed, map_arrow, slices, written

KINDS = ("email", "ip", "card", "phone")
NONE = len(KINDS)
SAMPLE = 3000
REACH, TAIL, ROUNDS, BELIEF = 3, 7, 6, 0.9
#: Log potentials: of equal labels on a hub, and of what the patterns say about a token.
SKIP, CLAMP = 4.0, 12.0

# The contract's patterns.  Look-behinds and possessive repeats change no match; they keep time linear.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(r"(?<![^\s])[^\s0-9@]*+[0-9@][^\s]*+")
_RUN = re.compile(r"[^\s]++")


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the patterns, by kind, then start."""
    out = []
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and _LOCAL.match(text, start - 1):
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((0, start, m.end()))
            last = m.end()
        else:
            last = max(last, at)  # what stands before a failed @ can't begin a later match
        at = text.find("@", max(last, at + 1))
    if _DIGIT.search(text):
        if "." in text:
            out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p) <= 3 and int(p or "0") <= 255 for p in (p.lstrip("0") for p in m[0].split(".")))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and _luhn(digits):
                    out.append((2, m.start(), m.end()))
        if "+" in text:
            out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def tokens(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, label) of candidate tokens in order; label is the base kind or NONE.

    Base spans are tokens as they are; of the rest, stretches between them, stripped of surrounding punctuation.
    """
    taken = sorted((s, e, k) for k, s, e in base)
    clear, at = [], 0
    for s, e, k in taken:
        if s >= at:
            clear.append((s, e, k))
            at = e
    out = list(clear)
    names = {text[s:e].split("@")[0].lower() for s, e, k in clear if k == 0}
    names = {n for n in names if len(n) >= 5 and not n.isdigit()}
    spots = [m.span() for m in _TOKEN.finditer(text)]
    if names:
        spots += [m.span() for m in _RUN.finditer(text) if m[0].lower() in names]
    # neighbouring number groups belong together, as in "(974) 555-3436"
    joined: list[list[int]] = []
    for s, e in sorted(set(spots)):
        if joined and s - joined[-1][1] == 1 and re.fullmatch(r"[-+().0-9]+", text[s:e]) and re.fullmatch(r"[-+().0-9]+", text[joined[-1][0] : joined[-1][1]].replace(" ", "")):
            joined[-1][1] = e
        else:
            joined.append([s, e])
    i = 0
    for s, e in joined:
        while i < len(clear) and clear[i][1] <= s:
            i += 1
        j, gaps = i, []
        while j < len(clear) and clear[j][0] < e:
            gaps.append((s, clear[j][0]))
            s = max(s, clear[j][1])
            j += 1
        for a, b in [*gaps, (s, e)]:
            while a < b and not (text[a].isalnum() or text[a] in "+("):
                a += 1
            while a < b and not text[b - 1].isalnum():
                b -= 1
            if b - a >= 3 and (_DIGIT.search(text, a, b) or "@" in text[a:b] or text[a:b].lower() in names):
                out.append((a, b, NONE))
    return sorted(out)


def _shape(t: str) -> list[int]:
    """Numbers of the features of a token."""
    digits = sum("0" <= c <= "9" for c in t)
    letters = sum(c.isalpha() for c in t)
    other = set(c for c in t if not c.isalnum())
    yes = [
        "@" in other, t[0] == "+", "(" in other, "-" in other, " " in other, t.count(".") == 1, t.count(".") == 2, t.count(".") == 3, t.count(".") > 3,
        not letters, not digits, letters > digits > 0, digits > letters > 0, "." in t.partition("@")[2], "_" in other, ":" in other or "/" in other,
        digits < 4, 4 <= digits < 8, 8 <= digits < 12, 12 <= digits < 16, 16 <= digits < 20, digits >= 20, len(t) < 8, len(t) > 24,
    ]
    return [k for k, v in enumerate(yes) if v]


WIDTH = 24
FEATURES = 3 * WIDTH + 1


def graph(text: str, base: list[tuple[int, int, int]]):
    """Tokens, their feature numbers, chain edges (left token of each), and hub of each (token, hub) edge."""
    toks = tokens(text, base)
    shapes = [_shape(text[s:e]) for s, e, _ in toks]
    x, chain, hubs = [], [], []
    keys: dict[str, int] = {}
    for k, (s, e, _) in enumerate(toks):
        f = [3 * WIDTH, *shapes[k]]
        if k and s - toks[k - 1][1] <= REACH:
            f += [WIDTH + i for i in shapes[k - 1]]
            chain.append(k - 1)
        if k + 1 < len(toks) and toks[k + 1][0] - e <= REACH:
            f += [2 * WIDTH + i for i in shapes[k + 1]]
        x.append(f)
        t = text[s:e].lower()
        digits = "".join(c for c in t if "0" <= c <= "9")
        same = ["=" + "".join(c for c in t.partition("@")[0] if c.isalnum())]
        if len(digits) >= TAIL:
            same.append("#" + digits[-TAIL:])
        for key in same:
            if len(key) > 4:
                hubs.append((k, keys.setdefault(key, len(keys))))
    return toks, x, chain, hubs


def beliefs(unary: np.ndarray, left: np.ndarray, hub_of: np.ndarray, hub: np.ndarray, chain: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Beliefs of tokens after rounds of messages, in logarithms.

    unary: (tokens, labels); left: chain edges run from token left[i] to left[i] + 1 with log potentials `chain`; token
    hub_of[i] hangs on hub[i], whose potential favours equal labels.
    """
    n, labels = unary.shape
    norm = lambda m: m - np.logaddexp.reduce(m, axis=1, keepdims=True)
    right, down = np.zeros((len(left), labels)), np.zeros((len(left), labels))
    up, back = np.zeros((len(hub), labels)), np.zeros((len(hub), labels))
    hubs = int(hub.max()) + 1 if len(hub) else 0
    skip = SKIP * np.eye(labels)

    def total():
        b = unary.copy()
        np.add.at(b, left + 1, right)
        np.add.at(b, left, down)
        np.add.at(b, hub_of, back)
        return b

    for _ in range(rounds):
        b = total()
        if len(left):
            right, down = (
                norm(np.logaddexp.reduce((b[left] - down)[:, :, None] + chain[None], axis=1)),
                norm(np.logaddexp.reduce((b[left + 1] - right)[:, None, :] + chain[None], axis=2)),
            )
        if len(hub):
            up = norm(np.logaddexp.reduce((b[hub_of] - back)[:, :, None] + skip[None], axis=1))
            sums = np.zeros((hubs, labels))
            np.add.at(sums, hub, up)
            back = norm(np.logaddexp.reduce((sums[hub] - up)[:, :, None] + skip[None], axis=1))
    return norm(total())


class SkipChain:
    """Weights of the unary model and chain potentials."""

    def __init__(self, weights: np.ndarray, chain: np.ndarray):
        self.weights, self.chain = weights, chain

    def added(self, texts: list[str], bases: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
        """Spans that the field adds to each text."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        toks, x, left, hub_of, hub, owner, labels = [], [], [], [], [], [], []
        at = hubs = 0
        for d, (text, base) in enumerate(zip(texts, bases, strict=True)):
            t, f, c, h = graph(text, base)
            toks += t
            x += f
            left += [at + i for i in c]
            hub_of += [at + i for i, _ in h]
            hub += [hubs + i for _, i in h]
            owner += [d] * len(t)
            labels += [k for *_, k in t]
            at += len(t)
            hubs += max((i for _, i in h), default=-1) + 1
        if not toks or all(k != NONE for k in labels):
            return out
        unary = np.array([self.weights[f].sum(axis=0) for f in x])
        known = np.array(labels)
        clamped = np.flatnonzero(known != NONE)
        unary[clamped] = 0.0
        unary[clamped, known[clamped]] = CLAMP
        b = np.exp(beliefs(unary, *(np.array(v, np.int64) for v in (left, hub_of, hub)), self.chain))
        for k in np.flatnonzero((known == NONE) & (b[:, :NONE].max(axis=1) >= BELIEF)):
            s, e, _ = toks[k]
            out[owner[k]].append((int(b[k, :NONE].argmax()), s, e))
        return out


def train(docs: DataFrame, sample: int = SAMPLE, steps: int = 200) -> SkipChain:
    """Fits on the `sample` documents of least hash that hold a digit or an @; without any, tokens stay unlabelled."""
    rows = docs.select("doc_id", "text").where(F.col("text").rlike("[0-9@]"))
    chosen = least_hashed(rows, F.xxhash64("doc_id", "text"), sample, "text").select("text")

    def run(batches):
        for batch in batches:
            x, y, pairs = [], [], np.zeros((NONE + 1) ** 2)
            for text in batch.column("text").to_pylist():
                toks, f, chain, _ = graph(text, base_spans(text))
                x += f
                y += [k for *_, k in toks]
                for i in chain:
                    pairs[toks[i][2] * (NONE + 1) + toks[i + 1][2]] += 1
            # rows of equal features and label are one
            seen: dict[tuple, int] = {}
            for f, k in zip(x, y, strict=True):
                seen[(*f, -1 - k)] = seen.get((*f, -1 - k), 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([list(s) for s in seen], pa.list_(pa.int32())), pa.array([float(n) for n in seen.values()])], names=["f", "n"])
            yield pa.RecordBatch.from_arrays([pa.array([[-100, i] for i in range(len(pairs))], pa.list_(pa.int32())), pa.array(pairs)], names=["f", "n"])

    # at most a few rows a token of the sample; most are equal
    rows = map_arrow(written(chosen, "pii-sample"), run, "f array<int>, n double").groupBy("f").agg(F.sum("n").alias("n")).orderBy("f").toPandas()
    pairs, x, y, n = np.ones((NONE + 1) ** 2), [], [], []
    for f, count in zip(rows["f"], rows["n"], strict=True):
        if f[0] == -100:
            pairs[f[1]] += count
        else:
            x.append(np.array(f[:-1]))
            y.append(-1 - f[-1])
            n.append(count)
    pairs = pairs.reshape(NONE + 1, NONE + 1)
    weights = np.zeros((FEATURES, NONE + 1))
    weights[-1, NONE] = 1.0
    if x:
        dense = np.zeros((len(x), FEATURES))
        for k, f in enumerate(x):
            dense[k, f] = 1
        n, goal = np.array(n), np.eye(NONE + 1)[y]
        momentum = np.zeros_like(weights)
        for _ in range(steps):
            z = dense @ weights
            p = np.exp(z - np.logaddexp.reduce(z, axis=1, keepdims=True))
            grad = dense.T @ ((p - goal) * n[:, None]) / n.sum() + 1e-3 * weights
            momentum = 0.9 * momentum + grad
            weights = weights - 0.5 * momentum
    # the chain's potentials: how much oftener two labels are neighbours than by chance, halved as features see neighbours too
    chain = 0.5 * np.log(pairs * pairs.sum() / np.outer(pairs.sum(axis=1), pairs.sum(axis=0)))
    return SkipChain(weights, np.clip(chain, -3, 3))


def find_pii(docs: DataFrame, model: SkipChain) -> DataFrame:
    """docs with pii_spans (array of kind, start, end, base) added, replacing a column of that name.

    Offsets count code points, ends are exclusive; order is by kind, then start.  Null and empty texts have none.
    Repeated rows give equal rows; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.drop("pii_spans")
    span = T.StructType().add("kind", "string").add("start", "long").add("end", "long").add("base", "boolean")
    schema = T.StructType([*rows.schema.fields, T.StructField("pii_spans", T.ArrayType(span))])
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [t or "" for t in part.column("text").to_pylist()]
                bases = [base_spans(t) for t in texts]
                more = shared.value.added(texts, bases)
                spans = [sorted([(*s, True) for s in b] + [(*s, False) for s in a]) for b, a in zip(bases, more, strict=True)]
                listed = [[{"kind": KINDS[k], "start": s, "end": e, "base": base} for k, s, e, base in x] for x in spans]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(listed, arrow)], names=[*part.schema.names, "pii_spans"])

    return map_arrow(rows, run, schema)


def redact(docs: DataFrame, model: SkipChain) -> DataFrame:
    """docs with every span of text replaced by its kind in brackets; overlapping spans become one, by the first kind.

    Null and empty texts stay as they are, repeated rows give equal rows, an empty table gives an empty one.  Columns of
    any name but text pass through unchanged.
    """

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").to_pylist()
                known = [t or "" for t in texts]
                bases = [base_spans(t) for t in known]
                more = model_of.value.added(known, bases)
                out = []
                for t, b, a in zip(texts, bases, more, strict=True):
                    spans, pieces, at = sorted((s, e, k) for k, s, e in b + a), [], 0
                    for s, e, k in spans:
                        if s >= at:
                            pieces += [t[at:s], f"[{KINDS[k]}]"]
                        at = max(at, e)
                    out.append("".join([*pieces, t[at:]]) if spans else t)
                i = part.schema.get_field_index("text")
                yield part.set_column(i, "text", pa.array(out, part.schema.field("text").type))

    model_of = docs.sparkSession.sparkContext.broadcast(model)
    return map_arrow(docs, run, docs.schema)


def op1_pii(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_pii(docs, train(docs)).select("doc_id", "pii_spans")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("pii_spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii_spans")).alias("spans"), F.size(F.filter("pii_spans", lambda s: ~s["base"])).cast("long").alias("n_added"))
