"""Byte-pair encoding and decoding of whole texts by speculation and verification.

For words not seen before, greedy longest match proposes tokens.  A proposal is the exact encoding if
each token encodes itself and no merge could have crossed any two neighbours; all neighbours of a
batch are tested at once with numpy, by undoing merges on both sides of the seam from the latest to
the earliest.  Only words that fail are merged exactly.  Words live in a bounded cache per worker.

Spark splits the table; each row is encoded where it is, without a shuffle.

Nulls and edge cases: a null text is an empty one (no tokens); repeated rows get equal results; special
strings in a text become their ids, as the library does; extra columns are passed on or dropped by the
caller.  The vocabulary file is a parameter, read on each worker by its path.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.llm.common import frugal

CACHE_WORDS = 1_000_000
_NONE = np.int64(1) << 40


def _byte_letters() -> list[str]:
    """The printable letter of each byte: printable bytes stand for themselves, others follow from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    extra = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(extra)) for b in range(256)]


class Vocabulary:
    """Tokens as merges of earlier tokens; ids grow in the order of merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        ids = spec["model"]["vocab"]
        suffix = spec["model"]["end_of_word_suffix"] or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = [""] * (max([*ids.values(), *self.special.values()]) + 1)
        for name, i in [*ids.items(), *self.special.items()]:
            self.names[i] = name
        letters = _byte_letters()
        self.table = {b: letters[b] for b in range(256)}
        self.mid = {c: ids[c] for c in letters}
        self.end = {c: ids[c + suffix] for c in letters}
        n = len(self.names)
        self.left, self.right = np.arange(n), np.arange(n)
        text = {i: c for c, i in self.mid.items()} | {i: c for c, i in self.end.items()}
        last = set(self.end.values())
        keys, made = [], []
        self.rank: dict[tuple[int, int], int] = {}
        for a, b in merges:
            x, y, z = ids[a], ids[b], ids[a + b]
            if z <= max(x, y):
                raise ValueError("ids must grow in the order of merges")
            self.left[z], self.right[z] = x, y
            text[z] = text[x] + text[y]
            if y in last:
                last.add(z)
            (self.end if z in last else self.mid)[text[z]] = z
            keys.append(x << 32 | y)
            made.append(z)
            self.rank[x, y] = z
        order = np.argsort(keys)
        self.pair_keys, self.pair_made = np.array(keys)[order], np.array(made)[order]
        self.reach: dict[str, int] = {}
        for piece in self.mid:
            self.reach[piece[:2]] = max(len(piece), self.reach.get(piece[:2], 1))
        whole = np.arange(n)
        inner = self.left != whole
        self.sound = np.ones(n, dtype=bool)
        fits = np.ones(n, dtype=bool)
        fits[inner] = self.compatible(self.left[inner], self.right[inner], whole[inner])
        for z in made:  # parts come before wholes
            self.sound[z] = fits[z] and self.sound[self.left[z]] and self.sound[self.right[z]]
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def compatible(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """Whether no merge crosses the seam between tokens a and b (before the merge ``until``).

        Merges run in the order of their ids, so the symbols that met at the seam are found by undoing
        the later of the two.  A crossing merge wins if it comes before the merge that took its left
        symbol away and not after the one that took its right symbol away.
        """
        a, b = a.astype(np.int64), b.astype(np.int64)
        fine = np.ones(len(a), dtype=bool)
        limit_a = np.full(len(a), _NONE) if until is None else until.astype(np.int64)
        limit_b = limit_a.copy() if until is None else limit_a - 1
        at = np.arange(len(a))
        while len(at):
            keys = a << np.int64(32) | b
            place = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
            made = np.where(self.pair_keys[place] == keys, self.pair_made[place], _NONE)
            crossed = (made < limit_a) & (made <= limit_b) & (made < _NONE)
            fine[at[crossed]] = False
            whole_a, whole_b = self.left[a] == a, self.left[b] == b
            go = ~crossed & ~(whole_a & whole_b)
            undo_a = (~whole_a & (a > b)) | whole_b
            limit_a = np.where(undo_a, a, limit_a)
            limit_b = np.where(undo_a, limit_b, b)
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
            at, a, b, limit_a, limit_b = at[go], a[go], b[go], limit_a[go], limit_b[go]
        return fine

    def greedy(self, word: str) -> list[int]:
        """Longest match from the left; no token that begins with two letters is longer than their reach."""
        out, at, n = [], 0, len(word)
        end, mid, reach = self.end, self.mid, self.reach
        while at < n:
            token = end.get(word[at:])
            if token is not None:
                out.append(token)
                break
            stop = min(n - 1, at + reach.get(word[at : at + 2], 1))
            while stop > at + 1 and (token := mid.get(word[at:stop])) is None:
                stop -= 1
            out.append(mid[word[at]] if token is None else token)
            at = max(stop, at + 1)
        return out

    def merged(self, word: str) -> list[int]:
        """Exact merging: the earliest merge first, the leftmost of equals."""
        symbols = [self.mid[c] for c in word[:-1]] + [self.end[word[-1]]]
        return self._scanned(symbols) if len(symbols) <= 48 else self._queued(symbols)

    def _scanned(self, symbols: list[int]) -> list[int]:
        rank, no = self.rank.get, len(self.names)
        ranks = [rank(p, no) for p in zip(symbols, symbols[1:], strict=False)]
        while ranks and (made := min(ranks)) < no:
            i = ranks.index(made)
            symbols[i : i + 2] = [made]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((symbols[i - 1], made), no)
            if i < len(ranks):
                ranks[i] = rank((made, symbols[i + 1]), no)
        return symbols

    def _queued(self, symbols: list[int]) -> list[int]:
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(self.rank[p], i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)) if p in self.rank]
        heapq.heapify(heap)
        while heap:
            made, i = heapq.heappop(heap)
            j = after[i] if symbols[i] >= 0 else n
            if j >= n or self.rank.get((symbols[i], symbols[j])) != made:
                continue
            symbols[i], symbols[j] = made, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (symbols[x], symbols[y]) in self.rank:
                    heapq.heappush(heap, (self.rank[symbols[x], symbols[y]], x))
        return [s for s in symbols if s >= 0]

    def encode_words(self, words: list[str]) -> tuple[list[int], np.ndarray]:
        """Token counts and all tokens: speculate, verify, and merge exactly where the proof fails."""
        found = [self.greedy(w) for w in words]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(words)), sizes)
        same = owner[1:] == owner[:-1]
        fits = self.compatible(flat[:-1][same], flat[1:][same])
        for i in np.union1d(owner[1:][same][~fits], owner[~self.sound[flat]]).tolist():
            found[i] = self.merged(words[i])
        return [len(f) for f in found], np.fromiter(chain.from_iterable(found), np.int64)

    def pieces(self, text: str) -> list[str]:
        """Normalised words of a text in order; a special string is marked by a leading space.

        White space is left as it is: words hold none, so what it is replaced by makes no difference.
        """
        out: list[str] = []
        for k, part in enumerate(self.specials.split(text) if self.specials else [text]):
            if k % 2:
                out.append(" " + part)
            elif part:
                # lower case letter by letter, without rules for the end of words
                out += self.words.findall(unicodedata.normalize("NFC", part).replace("\u03a3", "\u03c3").lower())
        return out


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder:
    """Encodes texts word by word with a bounded cache of packed ids."""

    def __init__(self, path: str):
        self.vocab = vocabulary(path)
        self.ids: dict[str, bytes] = {}

    def learn(self, pieces: set[str]) -> None:
        if len(self.ids) > CACHE_WORDS:
            self.ids.clear()
        new = [p for p in pieces if p not in self.ids]
        words = [p for p in new if p[0] != " "]
        if words:
            sizes, flat = self.vocab.encode_words([w.encode().decode("latin-1").translate(self.vocab.table) for w in words])
            packed, at = flat.astype("<u4").tobytes(), 0
            for word, size in zip(words, sizes, strict=True):
                self.ids[word] = packed[at : at + 4 * size]
                at += 4 * size
        for p in new:
            if p[0] == " ":
                self.ids[p] = np.array([self.vocab.special[p[1:]]], "<u4").tobytes()

    def encode(self, texts: list[str | None]) -> Iterator[tuple[bytes, str]]:
        """Packed ids and decoded text of each; the vocabulary has no decoder, so tokens are joined by spaces."""
        pieces = [self.vocab.pieces(text or "") for text in texts]
        self.learn(set().union(*pieces))
        for own in pieces:
            ids = b"".join([self.ids[p] for p in own])
            yield ids, " ".join([self.vocab.names[i] for i in np.frombuffer(ids, "<u4").tolist()])


def _task(path: str, real: bool) -> Callable:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                few = batch.slice(at, 200)
                rows = list(encoder.encode(few["text"].to_pylist()))
                kept = [c for c in few.schema.names if c != "text"]
                columns = {c: few[c] for c in kept} | {
                    "n_tokens": pa.array([len(i) // 4 for i, _ in rows], pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(i).hexdigest() for i, _ in rows]),
                    "decoded_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for _, t in rows]),
                }
                if real:
                    columns |= {"ids": pa.array([np.frombuffer(i, "<u4").astype(np.int32) for i, _ in rows], pa.list_(pa.int32())), "decoded": pa.array([t for _, t in rows], pa.string())}
                yield pa.record_batch(list(columns.values()), list(columns))

    return task


def encoded(docs: DataFrame, path: str, real: bool = False) -> DataFrame:
    """The other columns of ``docs`` with n_tokens, ids_sha256 and decoded_sha256; ``real`` adds ids and decoded text.

    Columns of ``docs`` that bear the name of a result are replaced.
    """
    results = ["n_tokens long", "ids_sha256 string", "decoded_sha256 string", *(["ids array<int>", "decoded string"] if real else [])]
    names = {r.split(" ")[0] for r in results}
    source = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in names))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields if f.name != "text"), *results])
    return source.mapInArrow(frugal(_task(path, real)), schema)
