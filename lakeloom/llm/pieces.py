"""SentencePiece encoding and decoding of whole texts by vectorised merge rounds.

A text is cut where no piece can reach across: before a run of blanks, and around characters that no piece holds.
The distinct words of a batch that are not in the worker's memory go through merge rounds together: flat arrays of
symbols, the rank of each neighbouring pair, the least rank of each word, all leftmost merges at once, compaction,
until no pair of any word is left.  A text is then a gather of its words' ids.

Exactness.  The library merges one pair at a time, the best score first, the leftmost on ties.  Merging several
occurrences of a word's best pair in one round gives the same unless a merge creates a pair that would come before
the next occurrence; a word in which that is so merges only its leftmost occurrence in that round.

Scale: one pass, no shuffle.  A worker's memory of words is emptied at `MEMORY` words.  The vocabulary's file must lie
at the same path on every machine; it is read once a worker.
"""

from __future__ import annotations

import hashlib
import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_arrow, slices

BLANK = "▁"
MEMORY = 150_000
NONE = np.int64(1) << 40
#: Symbols of characters without a piece of their own are their code point above this.
CHAR = 1 << 21


class PieceModel:
    """Vocabulary arrays, encode(texts) and decode(ids).  Byte-pair models with byte fallback and a dummy blank."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) for i in range(n)]
        names = [sp.id_to_piece(i) for i in range(n)]
        self.bos, self.eos, self.size = sp.bos_id(), sp.eos_id(), n
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        ids = {p: i for i, p in enumerate(names) if not special[i]}
        scores = np.array([sp.get_score(i) for i in range(n)])
        rank = np.unique(-scores, return_inverse=True)[1]
        symbol = lambda p: ids[p] if p in ids else CHAR + ord(p) if len(p) == 1 else None
        pairs = {}
        for p, i in ids.items():
            for k in range(1, len(p)):
                a, b = symbol(p[:k]), symbol(p[k:])
                if a is not None and b is not None:
                    pairs[(a << 22) | b] = i
        keys = np.array(sorted(pairs), np.int64)
        merged = np.array([pairs[k] for k in keys], np.int64)
        # A hash table with a bounded number of probes, as sorted search is slow on millions of pairs.
        bits = 19
        while True:
            table, room = np.full((1 << bits) + 16, -1, np.int64), np.full(len(keys), -1, np.int64)
            slot, left = self._slot(keys, bits), np.arange(len(keys))
            for probe in range(16):
                at = slot[left] + probe
                free = table[at] < 0
                table[at[free]] = keys[left[free]]
                won = free & (table[at] == keys[left])
                room[left[won]] = at[won]
                left = left[~won]
            if not len(left):
                break
            bits += 1
        self._bits, self._keys = bits, table
        self._probes = int((room - slot).max()) + 1
        self._merged, self._rank = np.zeros(len(table), np.int64), np.full(len(table), NONE)
        self._merged[room], self._rank[room] = merged, rank[merged]
        letters = {c for p in ids for c in p}
        self._char = np.arange(0x110000, dtype=np.int64) + CHAR
        for c in letters:
            if c in ids:
                self._char[ord(c)] = ids[c]
        # Blanks end a word unless some piece goes on after one; the commonest characters of no piece are words.
        whole = any(re.search(f"[^{BLANK}]{BLANK}", p) for p in ids)
        alone = "".join(re.escape(c) for c in "\n\t" if c not in letters)
        self._words = re.compile("(?s).+") if whole else re.compile(f"[{alone}]|{BLANK}*[^{BLANK}{alone}]+|{BLANK}+" if alone else f"{BLANK}*[^{BLANK}]+|{BLANK}+")
        plain = [b"" if sp.is_control(i) else bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(names)]
        self._plain_at = np.concatenate([[0], np.cumsum([len(p) for p in plain])])
        self._plain = np.frombuffer(b"".join(plain), np.uint8)
        self._blank_first = np.array([p.startswith(BLANK) for p in names])
        self._control = np.array([sp.is_control(i) for i in range(n)])
        self._forget()

    def _forget(self):
        self._known, self._start, self._count, self._ids = {}, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    @staticmethod
    def _slot(keys, bits):
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)

    def _pairs(self, a, b):
        """Rank (NONE: no piece) and piece of each pair of symbols."""
        keys = (a << 22) | b
        rank, piece, left, slot = np.full(len(keys), NONE), np.zeros(len(keys), np.int64), np.arange(len(keys)), self._slot(keys, self._bits)
        for probe in range(self._probes):
            at = slot[left] + probe
            hit = self._keys[at] == keys[left]
            rank[left[hit]], piece[left[hit]] = self._rank[at[hit]], self._merged[at[hit]]
            left = left[~hit & (self._keys[at] >= 0)]
            if not len(left):
                break
        return rank, piece

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All words' symbols after merging, flat, and the number of each word."""
        sizes = np.array([len(w) for w in words], np.int64)
        sym = self._char[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)]
        word = np.repeat(np.arange(len(words)), sizes)
        done_sym, done_word = [], []
        rank, piece = self._new_pairs(sym, word, np.arange(len(sym)))
        while len(sym):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            best = np.minimum.reduceat(rank, first)
            lengths = np.diff(np.append(first, len(sym)))
            live = np.repeat(best < NONE, lengths)
            if not live.all():  # compaction: words without a pair are ready
                done_sym.append(sym[~live])
                done_word.append(word[~live])
                sym, word, rank, piece = sym[live], word[live], rank[live], piece[live]
                lengths, best = lengths[best < NONE], best[best < NONE]
                if not len(sym):
                    break
            now = np.repeat(best, lengths)
            at = np.flatnonzero(rank == now)
            # of overlapping occurrences every other one, from the left
            starts = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (word[at[1:]] != word[at[:-1]])])
            order = np.arange(len(at))
            at = at[(order - np.maximum.accumulate(np.where(starts, order, 0))) % 2 == 0]
            at = self._safe(at, sym, word, piece, now)
            sym[at] = piece[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            moved = np.cumsum(keep) - 1
            sym, word, rank, piece = sym[keep], word[keep], rank[keep], piece[keep]
            changed = moved[at]
            changed = np.unique(np.concatenate([changed, changed[changed > 0] - 1]))
            rank[changed], piece[changed] = self._new_pairs(sym, word, changed)
        if not done_sym:
            return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return sym[order], np.bincount(word, minlength=len(words))

    def _new_pairs(self, sym, word, at):
        """Rank and piece of the pairs that begin at these places (NONE where a word ends)."""
        rank, piece = np.full(len(at), NONE), np.zeros(len(at), np.int64)
        inside = np.flatnonzero(at + 1 < len(sym))
        inside = inside[word[at[inside]] == word[at[inside] + 1]]
        rank[inside], piece[inside] = self._pairs(sym[at[inside]], sym[at[inside] + 1])
        return rank, piece

    def _safe(self, at, sym, word, piece, now):
        """Without the merges that might come too early: of their words only the leftmost merge stays."""
        w = word[at]
        leftmost = np.concatenate([[True], w[1:] != w[:-1]])
        if leftmost.all():
            return at
        several = np.isin(w, w[~leftmost])
        some = at[several]
        made = piece[some]
        bad = np.zeros(len(some), bool)
        n = len(sym)

        def check(i, a, b):
            if len(i):
                bad[i] |= self._pairs(a, b)[0] <= now[some[i]]

        i = np.flatnonzero((some > 0) & (word[np.maximum(some - 1, 0)] == word[some]))
        check(i, sym[some[i] - 1], made[i])
        i = np.flatnonzero(some + 2 < n)
        i = i[word[some[i] + 2] == word[some[i]]]
        check(i, made[i], sym[some[i] + 2])
        i = np.flatnonzero((some[1:] == some[:-1] + 2) & (word[some[1:]] == word[some[:-1]]))
        check(i, made[i], made[i + 1])
        return at[leftmost | ~np.isin(w, word[some[bad]])]

    def _learn(self, words: list[str]):
        sym, counts = self.merge(words)
        strange = sym >= CHAR
        if strange.any():  # characters of no piece become the ids of their bytes
            owner = np.repeat(np.arange(len(words)), counts)
            # A lone surrogate has no UTF-8 form; it counts as U+FFFD, as a string of Spark can't hold one.
            spelled = [chr(c).encode("utf-8") if not 0xD800 <= c < 0xE000 else b"\xef\xbf\xbd" for c in (sym[strange] - CHAR).tolist()]
            width = np.ones(len(sym), np.int64)
            width[strange] = [len(x) for x in spelled]
            out = np.repeat(sym, width)
            out[np.repeat(strange, width)] = self.byte_ids[np.frombuffer(b"".join(spelled), np.uint8)]
            sym, counts = out, np.bincount(owner, weights=width, minlength=len(words)).astype(np.int64)
        at = len(self._ids)
        self._start = np.concatenate([self._start, at + np.cumsum(counts) - counts])
        self._count = np.concatenate([self._count, counts])
        self._ids = np.concatenate([self._ids, sym.astype(np.int32)])
        for w in words:
            self._known[w] = len(self._known)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids with begin and end, and each text's place in them (one more than texts)."""
        split = [self._words.findall(BLANK + t.replace(" ", BLANK)) if t else [] for t in texts]
        if len(self._known) > MEMORY:
            self._forget()
        known = self._known
        new = [w for w in dict.fromkeys(w for words in split for w in words) if w not in known]
        if new:
            self._learn(new)
        each = np.array([len(w) for w in split], np.int64)
        which = np.fromiter((known[w] for words in split for w in words), np.int64, int(each.sum()))
        counts = self._count[which]
        ends = np.concatenate([[0], np.cumsum(counts)])
        bounds = ends[np.concatenate([[0], np.cumsum(each)])]
        total = int(ends[-1])
        body = self._ids[np.arange(total) + np.repeat(self._start[which] - ends[:-1], counts)]
        off = bounds + 2 * np.arange(len(texts) + 1)
        out = np.empty(total + 2 * len(texts), np.int32)
        inner = np.ones(len(out), bool)
        inner[off[:-1]] = inner[off[1:] - 1] = False
        out[off[:-1]], out[off[1:] - 1] = self.bos, self.eos
        out[inner] = body
        return out, off

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: blanks for marks, bytes put together, the first blank dropped."""
        ids = ids[~self._control[ids]]
        if not len(ids):
            return ""
        start, size = self._plain_at[ids], self._plain_at[ids + 1] - self._plain_at[ids]
        ends = np.cumsum(size)
        data = self._plain[np.arange(int(ends[-1])) + np.repeat(start - ends + size, size)]
        return data[int(self._blank_first[ids[0]]) :].tobytes().decode("utf-8", "replace")


@cache
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_documents(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """docs with token_ids (array<int>, begin and end ids included), n_tokens, ids_sha256 and decoded_sha256 added.

    The digest of the decoded text is that of decode(token_ids).  Null text encodes as the empty one: begin and end.
    Repeated rows give equal rows; an empty table gives an empty one.  Columns with the added names are replaced.
    """
    mine = ("token_ids", "n_tokens", "ids_sha256", "decoded_sha256")
    rows = docs.drop(*mine)
    added = T.StructType().add("token_ids", T.ArrayType(T.IntegerType())).add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    schema = T.StructType(rows.schema.fields + added.fields)

    def run(batches):
        model = piece_model(path)
        for batch in batches:
            for part in slices(batch, text):
                texts = [x or "" for x in part.column(text).to_pylist()]
                ids, off = model.encode(texts)
                each = [ids[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns,
                        pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids)),
                        pa.array(np.diff(off)),
                        pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in each], pa.string()),
                        pa.array([hashlib.sha256(model.decode(x).encode()).hexdigest() for x in each], pa.string()),
                    ],
                    names=[*part.schema.names, *mine],
                )

    return map_arrow(rows, run, schema)


def decode_documents(encoded: DataFrame, path: str, ids: str = "token_ids", to: str = "text") -> DataFrame:
    """encoded with the decoded text of its ids added as column `to` (replaced if there; null ids: null)."""
    rows = encoded.drop(to)

    def run(batches):
        model = piece_model(path)
        for batch in batches:
            lists = batch.column(ids).to_pylist()
            texts = [None if x is None else model.decode(np.array(x, np.int32)) for x in lists]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, to])

    return map_arrow(rows, run, T.StructType([*rows.schema.fields, T.StructField(to, T.StringType())]))


def op6_pieces(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_documents(docs, default_path()).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
