"""Token counts with a compiled finite-state transducer.

The tokenizer file is compiled into a deterministic transducer in two layers:

* The *scanner* has seven states and ten character classes. Its transitions are annotated
  with word boundaries. A chunk of text is a map from entry state to exit state; the chunks
  of a batch are stepped through side by side, their maps are composed by a parallel prefix
  scan, and a second pass from the known entry states emits the boundaries. Chunks may be cut
  anywhere, inside words too, so a long text costs the same per character as short ones.
* A word leads the scanner from its start state back to it, so a whole word is one composed
  transition whose emission is the number of tokens (or the token ids) the merges give it.
  These composed transitions are compiled when first met and kept per worker, up to a bound.

Special strings inside a text are tokens of their own, as the library has it by default.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillspark.llm.common import batches, per_process

CHUNK = 256
KEPT_WORDS = 300_000

# Character classes; the single letters are those of the contractions 's 't 'm 'd 're 've 'll.
SPACE, LETTER, NUMBER, OTHER, QUOTE, STMD, R, V, EL, E, NEW = range(11)
#: NEW: characters this Python's Unicode tables do not know; texts that hold one go to the library whole.
# Scanner states: between words, in letters, in marks, after a first quote, after 'r, 'v and 'l.
OUT, WORD, MARKS, QUOTED, QUOTED_R, QUOTED_V, QUOTED_L = range(7)
STATES, CLASSES = 7, 11
#: Emissions of a transition: a word begins here; one began at the character before.
HERE, BEFORE = 1, 2


def scanner() -> tuple[np.ndarray, np.ndarray]:
    """Next state and emission, each indexed by ``class * STATES + state``."""
    follow = np.zeros((CLASSES, STATES), np.uint8)
    emit = np.zeros((CLASSES, STATES), np.uint8)
    letters = (LETTER, STMD, R, V, EL, E)
    fresh = {SPACE: OUT, NUMBER: OUT, OTHER: MARKS, QUOTE: QUOTED} | dict.fromkeys(letters, WORD) | {NEW: MARKS}
    for state in range(STATES):
        for kind, target in fresh.items():
            follow[kind, state], emit[kind, state] = target, HERE * (kind != SPACE)
    emit[list(letters), WORD] = 0
    for state in (MARKS, QUOTED):
        follow[[OTHER, QUOTE], state], emit[[OTHER, QUOTE], state] = MARKS, 0
    for kind, target in ((STMD, OUT), (R, QUOTED_R), (V, QUOTED_V), (EL, QUOTED_L)):
        follow[kind, QUOTED], emit[kind, QUOTED] = target, 0
    for state, closing in ((QUOTED_R, E), (QUOTED_V, E), (QUOTED_L, EL)):
        emit[list(letters), state] = 0
        emit[:, state] |= BEFORE
        follow[closing, state], emit[closing, state] = OUT, 0
    return follow.ravel(), emit.ravel()


def character_classes() -> np.ndarray:
    kinds = np.full(0x110000, OTHER, np.uint8)
    for code in range(0x110000):
        general = unicodedata.category(chr(code))
        if general == "Cn":
            kinds[code] = NEW
        elif general[0] in "LNZ":
            kinds[code] = {"L": LETTER, "N": NUMBER, "Z": SPACE}[general[0]]
    kinds[[9, 10, 11, 12, 13, 0x85]] = SPACE
    for kind, members in ((QUOTE, "'"), (STMD, "stmd"), (R, "r"), (V, "v"), (EL, "l"), (E, "e")):
        kinds[[ord(c) for c in members]] = kind
    return kinds


class Emissions(dict):
    """Word to emission; missing words are compiled, and kept while there is room."""

    def __init__(self, compile_word, room: int):
        super().__init__()
        self.compile_word, self.room = compile_word, room

    def __missing__(self, word: str):
        value = self.compile_word(word)
        if self.room > 0:
            self.room -= 1
            self[word] = value
        return value


class Transducer:
    """The compiled form of a tokenizer file of lower-cased words with end-of-word merges."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.specials = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")")
        self.follow, self.emit = scanner()
        self.kinds = character_classes()
        # The byte alphabet of byte-level vocabularies: printable bytes stand for themselves.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        odd = [b for b in range(256) if b not in plain]
        self.byte_letters = {b: b for b in plain} | {b: 256 + k for k, b in enumerate(odd)}
        self.merge = tokenizer.model.tokenize
        self.library = tokenizer
        self.counts = Emissions(lambda word: len(self._tokens(word)), KEPT_WORDS)
        self.ids = Emissions(lambda word: np.array([t.id for t in self._tokens(word)], "<u4").tobytes(), KEPT_WORDS)

    def _tokens(self, word: str) -> list:
        return self.merge(word.encode().decode("latin-1").translate(self.byte_letters))

    def normal(self, text: str) -> str:
        text = text if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def segments(self, texts: list[str]) -> tuple[list[str], list[int], list[int | None]]:
        """Normal texts between special strings, the text each belongs to, and the special id behind each."""
        parts, owner, behind = [], [], []
        for i, text in enumerate(texts):
            pieces = self.special.split(text) if "<|" in text else [text]
            for k in range(0, len(pieces), 2):
                parts.append(self.normal(pieces[k]))
                owner.append(i)
                behind.append(self.specials[pieces[k + 1]] if k + 1 < len(pieces) else None)
        return parts, owner, behind

    def words(self, parts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """All words of ``parts`` in order, the part each belongs to, and the parts with new characters."""
        whole = "\n".join([*parts, ""])
        codes = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        if not len(codes):
            return [], np.zeros(0, np.int64), np.zeros(0, np.int64)
        kinds = self.kinds[codes]
        begins, ends = boundaries(kinds, self.follow, self.emit)
        starts = np.cumsum([0, *[len(p) + 1 for p in parts]])
        owner = np.searchsorted(starts, begins, "right") - 1
        new = np.unique(np.searchsorted(starts, np.flatnonzero(kinds == NEW), "right") - 1)
        return [whole[a:b] for a, b in zip(begins.tolist(), ends.tolist())], owner, new

    def token_counts(self, texts: list[str]) -> np.ndarray:
        parts, owner, behind = self.segments(texts)
        words, part, new = self.words(parts)
        emitted = np.fromiter(map(self.counts.__getitem__, words), np.int64, len(words))
        per_part = np.bincount(part, emitted, len(parts)).astype(np.int64) + [b is not None for b in behind]
        total = np.bincount(owner, per_part, len(texts)).astype(np.int64)
        for i in {owner[k] for k in new}:
            total[i] = len(self.library.encode(texts[i], add_special_tokens=False).ids)
        return total

    def token_ids(self, texts: list[str]) -> list[bytes]:
        """Per text its token ids as little-endian unsigned 32-bit numbers."""
        parts, owner, behind = self.segments(texts)
        words, part, new = self.words(parts)
        edges = np.searchsorted(part, np.arange(len(parts) + 1)).tolist()
        found: list[list[bytes]] = [[] for _ in texts]
        for k, i in enumerate(owner):
            found[i].extend(map(self.ids.__getitem__, words[edges[k]:edges[k + 1]]))
            if behind[k] is not None:
                found[i].append(np.array([behind[k]], "<u4").tobytes())
        for i in {owner[k] for k in new}:
            found[i] = [np.array(self.library.encode(texts[i], add_special_tokens=False).ids, "<u4").tobytes()]
        return [b"".join(x) for x in found]


def boundaries(kinds: np.ndarray, follow: np.ndarray, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of every word in a text given as character classes."""
    n = len(kinds)
    rows = -(-n // CHUNK)
    grid = np.full(rows * CHUNK, SPACE, np.uint8)
    grid[:n] = kinds
    steps = np.ascontiguousarray(grid.reshape(rows, CHUNK).T) * np.uint8(STATES)
    # The state map of every chunk: the exit state for each entry state.
    maps = np.tile(np.arange(STATES, dtype=np.uint8), (rows, 1))
    for step in steps:
        maps = follow[step[:, None] + maps]
    # Prefix scan: after the round of width w, row i holds the composition of its last 2w chunks.
    width = 1
    while width < rows:
        maps[width:] = np.take_along_axis(maps[width:], maps[:-width].copy(), 1)
        width *= 2
    state = np.concatenate([[np.uint8(OUT)], maps[:-1, OUT]]).astype(np.uint8)
    emitted = np.empty((CHUNK, rows), np.uint8)
    for k, step in enumerate(steps):
        at = step + state
        emitted[k] = emit[at]
        state = follow[at]
    flags = np.ascontiguousarray(emitted.T).ravel()
    begin = (flags & HERE).astype(bool)
    begin[:-1] |= (flags[1:] & BEFORE).astype(bool)
    filled = grid != SPACE
    last = filled.copy()
    last[:-1] &= begin[1:] | ~filled[1:]
    return np.flatnonzero(begin), np.flatnonzero(last) + 1


def transducer(path: str) -> Transducer:
    return per_process("transducer", path, lambda: Transducer(path))


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row of ``docs``.

    One narrow pass without a shuffle. A null text counts as empty (0 bytes, 0 tokens); null
    ids and repeated rows come back as they are, one result per row; other columns are
    neither read nor returned. An empty table gives an empty result.
    """

    def count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = transducer(path)
        for batch, texts in batches(source):
            n = compiled.token_counts(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    narrow = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].alias("text"))
    return narrow.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
