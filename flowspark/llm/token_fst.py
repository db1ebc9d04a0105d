"""Token counts of whole texts by a compiled finite-state transducer.

The automaton of a piece vocabulary reads characters.  A state holds, for every place at which a piece
could still be under way, the last token of the text before it and the number of tokens since; the
transition on a character picks the one piece that ends there and keeps what precedes it, and is
annotated with the change of the token count.  States and transitions are compiled when first met
and kept in dense arrays.

A batch of texts is one sequence of symbols, cut into chunks that run side by side.  A chunk's map of
entry state to exit state and count is constant behind its first word boundary, so all chunks start
there at once; a prefix scan hands exit states on, and then the heads run from their entry states,
in further rounds where a chunk has no boundary at all.

Rows are counted where they are, without a shuffle.  Nulls and edge cases: a null text is empty and has
no tokens; characters outside the vocabulary count their UTF-8 bytes; repeated rows get equal
results; other columns are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.llm.common import longs, slices

SPACE = "▁"
CHUNK = 256
MAX_CELLS = 1 << 26
_NEVER = 1 << 30
_START = -1  # a token that joins with nothing after it
_STAY, _RESET, _UNKNOWN = 0, 1, 2  # symbols; unknown characters of 1 to 4 bytes follow from _UNKNOWN on
_FIRST = _UNKNOWN + 4


class Transducer:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.piece = {model.id_to_piece(i): i for i in plain}
        order = sorted({model.get_score(i) for i in plain}, reverse=True)
        place = {score: k for k, score in enumerate(order)}
        self.rank = {p: place[model.get_score(i)] for p, i in self.piece.items()}
        self.text = {i: p for p, i in self.piece.items()}
        if any(SPACE in p.lstrip(SPACE) for p in self.piece):
            raise ValueError("pieces must not span words")
        if any(c not in self.piece for p in self.piece for c in p):
            raise ValueError("each character of a piece must be a piece")
        self.begun = {p[:k] for p in self.piece for k in range(1, len(p))}
        self.past: dict[int, tuple[bool, list, list, list]] = {}
        self.apart: dict[int, bool] = {}
        self.reset_tables()

    def reset_tables(self) -> None:
        self.columns: dict[str, int] = {}
        self.column_of = np.full(0x110000, -1, dtype=np.int32)
        self.states: dict[tuple, int] = {}
        self.live: list[tuple] = []
        self.next = np.full((1024, 128), -1, dtype=np.int32)  # state << 5 | change + 16
        self.start = self.state((("", _START, 0),))

    def state(self, live: tuple) -> int:
        if live not in self.states:
            self.states[live] = s = len(self.live)
            self.live.append(live)
            if s >= len(self.next):
                self.next = np.concatenate([self.next, np.full_like(self.next, -1)])
            self.next[s, _STAY] = s << 5 | 16
            self.next[s, _RESET : _FIRST] = np.arange(5) + 16
        return self.states[live]

    def history(self, token: int) -> tuple[bool, list, list, list]:
        """Exact merging of a token's characters, best score first and leftmost of equals: does it give the token,
        the ranks of its merges, and the symbols at its left and right edge before each merge and at the end."""
        if token not in self.past:
            symbols = list(self.text[token])
            ranks, lefts, rights = [], [symbols[0]], [symbols[-1]]
            while True:
                found = [self.rank.get(a + b, _NEVER) for a, b in zip(symbols, symbols[1:], strict=False)]
                if not found or (best := min(found)) == _NEVER:
                    break
                k = found.index(best)
                symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
                ranks.append(best)
                lefts.append(symbols[0])
                rights.append(symbols[-1])
            self.past[token] = (len(symbols) == 1, [*ranks, _NEVER], lefts, rights)
        return self.past[token]

    def ends(self, before: int, token: int) -> bool:
        """Whether ``token`` follows ``before`` in an encoding.

        Both are merged side by side, the better merge first; they stay apart if the symbols that meet
        at the seam never make the best merge.
        """
        sound, own, lefts, _ = self.history(token)
        if not sound or before == _START:
            return sound
        key = before << 32 | token
        if (known := self.apart.get(key)) is None:
            _, other, _, rights = self.history(before)
            i = j = 0
            while True:
                seam = self.rank.get(rights[i] + lefts[j], _NEVER)
                if seam < other[i] and seam <= own[j]:
                    known = False
                    break
                if other[i] == own[j] == _NEVER:
                    known = True
                    break
                if other[i] <= own[j]:
                    i += 1
                else:
                    j += 1
            self.apart[key] = known
        return known

    def compile(self, state: int, column: int, char: str) -> None:
        live = self.live[state]
        if char == SPACE and live[0][0].strip(SPACE):
            live = self.live[self.start]
        if char == SPACE and not live[0][0] and live[-1][1] != _START and not self.text[live[-1][1]].endswith(SPACE):
            live = self.live[self.start]
        step, token = next((r + 1, self.piece[u + char]) for u, t, r in live if u + char in self.piece and self.ends(t, self.piece[u + char]))
        onward = tuple((u + char, t, r - step) for u, t, r in live if u + char in self.begun)
        target = self.state((*onward, ("", token, 0)))
        self.next[state, column] = target << 5 | step + 16

    def symbols(self, codes: np.ndarray) -> np.ndarray:
        """The column of each character; -1 (a reset) stands before each text."""
        if len(self.next) * self.next.shape[1] > MAX_CELLS or len(self.apart) > 2_000_000:
            self.reset_tables()
            self.apart.clear()
        found = np.where(codes < 0, _RESET, self.column_of[np.maximum(codes, 0)])
        for code in np.unique(codes[found < 0]).tolist():
            char = chr(code)
            if char in self.piece:
                column = _FIRST + len(self.columns)
                self.columns[char] = column
                if column >= self.next.shape[1]:
                    self.next = np.concatenate([self.next, np.full_like(self.next, -1)], axis=1)
            else:
                column = _UNKNOWN + (1 if code < 0x80 else 2 if code < 0x800 else 3 if code < 0x10000 else 4) - 1
            self.column_of[code] = column
        self.chars = {c: k for k, c in self.columns.items()}
        return np.where(codes < 0, _RESET, self.column_of[np.maximum(codes, 0)])

    def run(self, symbols: np.ndarray, states: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The last ``sizes`` symbols of each row from its state, side by side: exit states and the change at each symbol.

        Rows are sorted by size, longest first, and begin one after another.
        """
        width = symbols.shape[1]
        order = np.argsort(-sizes, kind="stable")
        columns = np.ascontiguousarray(symbols[order].T)
        changes = np.full(columns.shape, 16, dtype=np.int8)
        states = states[order].astype(np.int64)
        begun = np.searchsorted(-sizes[order], -(width - np.arange(width)), "right")
        for k in range(width):
            n = begun[k]
            if not n:
                continue
            own, at = columns[k, :n], states[:n]
            after = self.next.ravel().take(at * self.next.shape[1] + own)
            if after.min() < 0:
                missing = np.flatnonzero(after < 0)
                for s, c in set(zip(at[missing].tolist(), own[missing].tolist(), strict=True)):
                    self.compile(s, c, self.chars[c])
                after = self.next.ravel().take(at * self.next.shape[1] + own)
            changes[k, :n] = after & 31
            states[:n] = after >> 5
        back = np.argsort(order, kind="stable")
        return states[back], (changes - 16).T[back]

    def changes(self, symbols: np.ndarray) -> np.ndarray:
        """The change of the count at each symbol of a sequence that begins with a reset."""
        n = len(symbols)
        if not n:
            return np.zeros(0, dtype=np.int8)
        space = self.columns.get(SPACE, -9)
        certain = (symbols == _RESET) | ((symbols >= _UNKNOWN) & (symbols < _FIRST))
        certain[1:] |= (symbols[1:] == space) & (symbols[:-1] != space)
        rows = -(-n // CHUNK)
        padded = np.full(rows * CHUNK, _STAY, dtype=np.int32)
        padded[:n] = symbols
        certain = np.concatenate([certain, np.zeros(rows * CHUNK - n, dtype=bool)]).reshape(rows, CHUNK)
        padded = padded.reshape(rows, CHUNK)
        fixed = certain.any(axis=1)
        first = np.where(fixed, certain.argmax(axis=1), CHUNK)
        exits, out = self.run(padded, np.full(rows, self.start), CHUNK - first)
        # scan: a chunk whose map is constant gives its exit state whatever comes in
        entry = np.full(rows, -1)
        entry[0] = self.start
        entry[1:][fixed[:-1]] = exits[:-1][fixed[:-1]]
        todo = np.ones(rows, dtype=bool)
        while todo.any():
            ready = np.flatnonzero(todo & (entry >= 0))
            width = max(1, int(first[ready].max()))
            # heads end where tails begin: put them flush right
            source = np.arange(width) - (width - first[ready][:, None])
            head = np.where(source >= 0, np.take_along_axis(padded[ready], np.maximum(source, 0), axis=1), _STAY)
            states, heads = self.run(head, entry[ready], first[ready])
            at, k = np.nonzero(source >= 0)
            out[ready[at], source[at, k]] += heads[at, k]
            todo[ready] = False
            open_ends = ~fixed[ready] & (ready + 1 < rows)
            entry[ready[open_ends] + 1] = states[open_ends]
        return out.ravel()[:n]


@lru_cache(maxsize=1)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def _task(path: str, limit: int) -> Callable:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for batch in batches:
            for part in slices(batch["text"]):
                heads = part.starts[part.ends > part.starts]
                text = part.data.tobytes().decode("utf-8").replace(" ", SPACE)
                codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
                # each text that is not empty begins with a reset and a space
                letters = np.zeros(len(part.data) + 1, dtype=np.int64)
                np.cumsum((part.data & 0xC0) != 0x80, out=letters[1:])
                codes = np.insert(codes, np.repeat(letters[heads], 2), np.tile([-1, ord(SPACE)], len(heads)))
                sums = np.zeros(len(codes) + 1, dtype=np.int64)
                np.cumsum(machine.changes(machine.symbols(codes)), out=sums[1:], dtype=np.int64)
                filled = part.ends > part.starts
                before = 2 * (np.cumsum(filled) - filled)
                start = letters[part.starts] + before
                tokens = np.where(filled, sums[np.minimum(letters[part.ends] + before + 2, len(codes))] - sums[start], 0)
                yield pa.record_batch(
                    [batch["doc_id"].slice(part.first, part.rows), longs(part.ends - part.starts), longs(tokens), pa.array(tokens > limit)],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    return task


def counted(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens and whether that is over ``limit``."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_task(path, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
