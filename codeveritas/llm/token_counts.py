"""Token counts by finite-state compilation of a word-end BPE tokenizer.

Two deterministic transducers whose transitions carry what they emit:

* the splitter reads character classes and marks where a token of the pre-tokenizer starts.  Texts
  of a block are one line, cut into chunks of equal length; each chunk's map from every entry state
  to its exit state is built for all chunks at once, the maps are composed by a parallel prefix
  scan, and a second pass from the now known entry states reads off the marks;
* the speller reads the bytes of a word.  Its state is what decides the rest of the encoding: the
  deepest prefix of a vocabulary token that ends here, the last tokens of the encodings of the
  prefixes that end at and within it, and their counts relative to here.  A transition finds the
  one token that can end at the new byte (it must not merge with the last token before it) and
  carries the change of the number of tokens.  States are made when first reached and shared by
  all words, so the automaton stops growing while the vocabulary of the corpus still grows.

Normalisation (NFC, white space, lower case) and special strings follow the tokenizer file: special
strings are found in the raw text, cut it, and count one token each.

Defined results: null is empty, with no tokens; no begin, end or padding tokens; no truncation;
repeated rows and null ids keep a row each; other columns are carried, clashing ones replaced.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import blocks
from .qgrams import mix
from .text_stats import _INVERSE, _STEP, powers

LIMIT = 2048
CHUNK = 64
WORD_END = "</w>"

#: Distinct words a task remembers with their counts, and transitions of the speller.
REMEMBERED = 2_000_000

#: Character classes and states of the splitter (fixed values).
SPACE, LETTER, NUMBER, OTHER, QUOTE, ONE, R, V, L, E = range(10)
OPEN, WORD, MARKS, QUOTED, QUOTED_R, QUOTED_V, QUOTED_L = range(7)
STARTS, STARTED_BEFORE = 1, 2

#: Lower case that str.lower() gives otherwise: no final sigma; newer letters (fixed values).
LOWER_APART = {0x03A3: 0x03C3, 0xA7CB: 0x0264, 0xA7DC: 0x019B}


def _splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next state and emission by (state, class), for the pattern
    's|'t|'re|'ve|'m|'ll|'d|[L]+|[N]|[^ space L N]+ with its first alternative first."""
    go = np.zeros((7, 10), np.uint8)
    emit = np.zeros((7, 10), np.uint8)
    letters = (LETTER, ONE, R, V, L, E)
    begin = {**{c: WORD for c in letters}, NUMBER: OPEN, OTHER: MARKS, QUOTE: QUOTED, SPACE: OPEN}
    for c, target in begin.items():
        for state in (OPEN, WORD, MARKS, QUOTED, QUOTED_R, QUOTED_V, QUOTED_L):
            go[state, c] = target
            emit[state, c] = 0 if c == SPACE else STARTS
    for c in letters:
        emit[WORD, c] = 0
    for state in (MARKS, QUOTED):
        for c in (OTHER, QUOTE):
            go[state, c], emit[state, c] = MARKS, 0
    go[QUOTED, ONE], emit[QUOTED, ONE] = OPEN, 0
    for c, state, closing in ((R, QUOTED_R, E), (V, QUOTED_V, E), (L, QUOTED_L, L)):
        go[QUOTED, c], emit[QUOTED, c] = state, 0
        go[state], emit[state] = go[WORD], emit[WORD] | STARTED_BEFORE
        go[state, closing], emit[state, closing] = OPEN, 0
    return go, emit


GO, EMIT = _splitter()


@functools.lru_cache(1)
def classes() -> np.ndarray:
    """The class of every code point."""
    import regex

    out = np.full(0x110000, OTHER, np.uint8)
    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((SPACE, r"\s"), (LETTER, r"\p{L}"), (NUMBER, r"\p{N}")):
        out[[ord(c) for c in regex.findall(pattern, everything)]] = kind
    for chars, kind in (("'", QUOTE), ("stmd", ONE), ("r", R), ("v", V), ("l", L), ("e", E)):
        out[[ord(c) for c in chars]] = kind
    return out


def compose(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """State maps applied one after the other, row by row."""
    return np.take_along_axis(then, first.astype(np.int64), axis=1)


def prefix_maps(maps: np.ndarray) -> np.ndarray:
    """Inclusive scan of state maps by doubling; composition is associative."""
    maps = maps.copy()
    reach = 1
    while reach < len(maps):
        maps[reach:] = compose(maps[:-reach], maps[reach:])
        reach *= 2
    return maps


def emissions(kinds: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """What the splitter emits at each character of a line that starts in OPEN."""
    n = len(kinds)
    grid = np.full(-(-max(n, 1) // chunk) * chunk, SPACE, np.uint8)
    grid[:n] = kinds
    grid = grid.reshape(-1, chunk)
    flat = np.ascontiguousarray(grid.T)
    table, wide = GO.ravel(), GO.shape[1]
    maps = np.broadcast_to(np.arange(GO.shape[0], dtype=np.uint8), (len(grid), GO.shape[0])).copy()
    for k in range(chunk):
        maps = table[maps * np.uint8(wide) + flat[k][:, None]]
    exits = prefix_maps(maps)[:, OPEN]
    state = np.concatenate((np.zeros(1, np.uint8), exits[:-1]))
    out = np.empty_like(flat)
    emitted = EMIT.ravel()
    for k in range(chunk):
        at = state * np.uint8(wide) + flat[k]
        out[k] = emitted[at]
        state = table[at]
    return out.T.ravel()[:n]


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 bytes for
    themselves, the others from U+0100 on in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Speller:
    """The lazily determinised transducer from the bytes of a word to its number of tokens.

    Symbols are bytes, and byte + 256 for the last one of a word.
    """

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        letters = byte_letters()

        def symbols(token: str) -> tuple[int, ...]:
            end = token.endswith(WORD_END) and token != WORD_END
            body = [letters[c] for c in (token[: -len(WORD_END)] if end else token)]
            if end:
                body[-1] += 256
            return tuple(body)

        spelled = {token: symbols(token) for token in vocab}
        self.ids = {s: vocab[t] for t, s in spelled.items()}
        self.symbols = {i: s for s, i in self.ids.items()}
        self.ranks = {}
        for rank, (a, b) in enumerate(merges):
            self.ranks.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        # Trie of all tokens; its nodes are the prefixes that may still become a token.
        self.child: list[dict[int, int]] = [{}]
        self.depth, self.token = [0], [-1]
        for s, i in self.ids.items():
            node = 0
            for x in s:
                node = self.child[node].setdefault(x, len(self.child))
                if node == len(self.child):
                    self.child.append({})
                    self.depth.append(0)
                    self.token.append(-1)
            self.token[node] = i
        self._link()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.clear()

    def _link(self) -> None:
        """Depths and suffix links, breadth first."""
        self.fail = [0] * len(self.child)
        queue = [0]
        for node in queue:
            for x, nxt in self.child[node].items():
                self.depth[nxt] = self.depth[node] + 1
                if node:
                    back = self.fail[node]
                    while back and x not in self.child[back]:
                        back = self.fail[back]
                    self.fail[nxt] = self.child[back].get(x, 0)
                queue.append(nxt)

    def clear(self) -> None:
        """Forgets states; the start state has no symbol and no token behind it."""
        self.states = [(0, (-1,), (0,))]
        self.numbers = {self.states[0]: 0}
        self.moves: dict[int, tuple[int, int]] = {}

    def encode(self, s: tuple[int, ...]) -> list[int]:
        """Merges by rank, the definition of the encoding; for strings of one or two tokens."""
        out = [self.ids[(x,)] for x in s]
        while len(out) > 1:
            best = min(((self.ranks.get(p, (1 << 60, 0)), k) for k, p in enumerate(zip(out, out[1:]))))
            if best[0][0] == 1 << 60:
                break
            out[best[1] : best[1] + 2] = [best[0][1]]
        return out

    def adjacent(self, left: int, right: int) -> bool:
        """Whether an encoding may have these tokens side by side (left -1: right comes first)."""
        key = (left, right)
        if key not in self.pairs:
            want = [right] if left < 0 else [left, right]
            self.pairs[key] = self.encode(sum((self.symbols[t] for t in want), ())) == want
        return self.pairs[key]

    def move(self, state: int, x: int) -> tuple[int, int]:
        """The next state and the change of the number of tokens."""
        node, last, counts = self.states[state]
        while node and x not in self.child[node]:
            node = self.fail[node]
        node = self.child[node].get(x, 0)
        # Tokens that end here: those at this node and along its suffix links.
        at = node
        while True:
            if (token := self.token[at]) >= 0:
                back = self.depth[at]
                if back <= len(last) and self.adjacent(last[-back], token):
                    break
            if not at:
                raise ValueError("a symbol is not in the vocabulary")
            at = self.fail[at]
        change = counts[-back] + 1
        keep = self.depth[node] + 1
        last = (*last, token)[-keep:]
        counts = (*(c - change for c in counts), 0)[-keep:]
        key = (node, last, counts)
        number = self.numbers.get(key)
        if number is None:
            number = self.numbers[key] = len(self.states)
            self.states.append(key)
        self.moves[state << 9 | x] = move = (number, change)
        return move

    def count(self, word: bytes) -> int:
        if len(self.moves) > REMEMBERED:
            self.clear()
        state = total = 0
        moves = self.moves
        for x in word[:-1]:
            found = moves.get(state << 9 | x) or self.move(state, x)
            state = found[0]
            total += found[1]
        x = word[-1] + 256
        return total + (moves.get(state << 9 | x) or self.move(state, x))[1]


class Counter:
    """Counts tokens of texts as the tokenizer of a file does."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.speller = Speller(model["vocab"], [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]])
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.words: dict[str, int] = {}

    @staticmethod
    def normalise(text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).translate(LOWER_APART)
        return text.lower()

    def counts(self, texts: list[str]) -> np.ndarray:
        pieces, owner = [], []
        total = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            parts = [text]
            if self.special and "<|" in text:
                parts = self.special.split(text)
                total[i] += len(parts) - 1
            for p in parts:
                pieces.append(self.normalise(p))
                owner.append(i)
        line = " ".join(pieces) + " "
        points = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = classes()[points]
        marks = emissions(kinds)
        starts = (marks & STARTS) > 0
        starts[:-1] |= (marks[1:] & STARTED_BEFORE) > 0
        begin = np.flatnonzero(starts)
        if not len(begin):
            return total
        breaks = np.flatnonzero(starts | (kinds == SPACE))
        end = breaks[np.searchsorted(breaks, begin, side="right")]
        with np.errstate(over="ignore"):
            terms = mix(points.astype(np.uint64) * _STEP + np.uint64(1)) * powers(len(points), _STEP)
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)))
            ids = (sums[end] - sums[begin]) * powers(len(points), _INVERSE)[begin] + (end - begin).astype(np.uint64)
        _, first, inverse = np.unique(ids, return_index=True, return_inverse=True)
        if len(self.words) > REMEMBERED:
            self.words.clear()
        known, count = self.words, self.speller.count
        each = np.empty(len(first), np.int64)
        for k, (a, b) in enumerate(zip(begin[first].tolist(), end[first].tolist())):
            word = line[a:b]
            n = known.get(word)
            if n is None:
                n = known[word] = count(word.encode("utf-8", "surrogatepass"))
            each[k] = n
        sizes = np.array([len(p) + 1 for p in pieces], np.int64)
        piece = np.searchsorted(np.cumsum(sizes), begin, side="right")
        np.add.at(total, np.array(owner)[piece], each[inverse])
        return total


@functools.lru_cache(2)
def counter(path: str) -> Counter:
    """One a worker process and tokenizer file."""
    return Counter(path)


def count_tokens(docs: DataFrame, path: str, text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """`docs` with n_bytes, n_tokens and over_limit; one narrow map.

    `path` is the tokenizer file's place on every executor.
    """
    new = ["n_bytes", "n_tokens", "over_limit"]
    kept = [c for c in docs.columns if c not in new]
    rows = docs.select(
        *[F.col(f"`{c}`").cast("string").alias(c) if c == text_col else F.col(f"`{c}`") for c in kept],
        F.lit(0).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_tokens"), F.lit(False).alias("over_limit"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(path)
        for batch, texts in blocks(batches, text_col):
            n = tokens.counts([t.decode() for t in texts])
            columns = [batch.column(i) for i in range(batch.num_columns - 3)]
            columns += [pa.array([len(t) for t in texts], pa.int64()), pa.array(n), pa.array(n > limit)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return rows.mapInArrow(run, rows.schema)
