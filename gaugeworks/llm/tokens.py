"""Token ids of whole texts with a public tokenizer, each distinct word encoded once.

The tokenizer of ``VOCABULARY`` drops white space and never joins characters
across it, so a text's ids are those of its words, one after another.  A worker
remembers the ids of the words it has met in a hash table of numpy arrays; only
new words go to the library.  Plain words (Latin letters, digits, signs) go to
the library's model in pieces, split as its pre-tokenizer splits them; all
others go through the whole tokenizer, and so do texts that may hold the name of
a special token.  The tests hold all ways against the library.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa

from .words import Words, utf8

VOCABULARY = "word_bpe_49k.json"
#: Words that a worker remembers at most, about 60 bytes each; then it starts anew.
REMEMBERED = 900_000
#: Signs and letters that NFC leaves alone and whose lower case is among them again.
_PLAIN = re.compile(r"[\x21-\x7e¡-¬®-įı-ſ]+\Z")
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Memory:
    """Ids by word: open addressing on the word's hash, confirmed by its first bytes and length."""

    def __init__(self, bits: int = 16):
        self.clear(bits)

    def clear(self, bits: int = 16) -> None:
        self.mask = (1 << bits) - 1
        self.keys = np.zeros(1 << bits, dtype=np.uint64)
        self.entry = np.full(1 << bits, -1, dtype=np.int32)
        self.count = 0
        # no more than half of the slots are taken
        self.start = np.zeros(1 << (bits - 1), dtype=np.int32)
        self.size = np.zeros(1 << (bits - 1), dtype=np.int32)
        self.check = np.zeros(1 << (bits - 1), dtype=np.uint64)
        self.hits = np.zeros(1 << (bits - 1), dtype=np.uint8)  # 2: more than once
        self.pool = np.zeros(1 << bits, dtype=np.uint32)
        self.used = 0

    def find(self, keys: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Entry of each word, -1 where it is not known."""
        out = np.full(len(keys), -1, dtype=np.int32)
        rows = np.arange(len(keys))
        at = (keys & np.uint64(self.mask)).astype(np.int64)
        while len(rows):
            here = self.keys[at]
            own = here == keys[rows]
            hit = rows[own]
            found = self.entry[at[own]]
            out[hit] = np.where(self.check[found] == check[hit], found, -1)
            on = ~own & (self.entry[at] >= 0)
            rows, at = rows[on], (at[on] + 1) & self.mask
        return out

    def add(self, keys: np.ndarray, check: np.ndarray, ids: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Remember new, distinct words; returns their entries."""
        while 2 * (self.count + len(keys)) > self.mask:
            self._grow()
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool) // 2 + len(ids), dtype=np.uint32)])
        entries = np.arange(self.count, self.count + len(keys), dtype=np.int32)
        self.pool[self.used : self.used + len(ids)] = ids
        self.start[entries] = self.used + np.cumsum(size) - size
        self.size[entries], self.check[entries] = size, check
        self.used += len(ids)
        self.count += len(keys)
        self._place(keys, entries)
        return entries

    def _place(self, keys: np.ndarray, entries: np.ndarray) -> None:
        rows = np.arange(len(keys))
        at = (keys & np.uint64(self.mask)).astype(np.int64)
        while len(rows):
            free = self.entry[at] < 0
            self.keys[at[free]] = keys[rows[free]]
            self.entry[at[free]] = entries[rows[free]]
            lost = self.entry[at] != entries[rows]
            rows, at = rows[lost], (at[lost] + 1) & self.mask

    def shrink(self, least: int = 2) -> None:
        """Forget the words that were met in fewer than ``least`` (1 or 2) calls."""
        slots = np.flatnonzero(self.entry >= 0)
        slots = slots[self.hits[self.entry[slots]] >= least]
        keys, entries = self.keys[slots], self.entry[slots]
        size = self.size[entries].astype(np.int64)
        ends = np.cumsum(size)
        ids = self.pool[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[entries] - ends + size, size)]
        check = self.check[entries]
        self.clear()
        self.add(keys, check, ids, size)

    def _grow(self) -> None:
        kept = np.flatnonzero(self.entry >= 0)
        keys, entries = self.keys[kept], self.entry[kept]
        size = 2 * (self.mask + 1)
        self.mask = size - 1
        self.keys, self.entry = np.zeros(size, dtype=np.uint64), np.full(size, -1, dtype=np.int32)
        self.start, self.size, self.check, self.hits = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size, self.check, self.hits))
        self._place(keys, entries)


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.bare = Tokenizer(self.whole.model)
        self.split = regex.compile(_PIECES).findall
        # the byte alphabet of the pre-tokenizer: one printable character for each byte
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.alphabet = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0xA1, 0x180)}
        self.memory = Memory()

    @staticmethod
    def _marks(words: Words) -> tuple[np.ndarray, np.ndarray]:
        keys = np.where(words.hashes == 0, np.uint64(1), words.hashes)
        return keys, words.lead ^ ((words.ends - words.starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def _learn(self, listed: list[str], keys: np.ndarray, check: np.ndarray) -> None:
        """Remember words that are not known; the words are distinct."""
        single, parts = [], []  # words that are one piece, words that are several
        for k, w in enumerate(listed):
            if w.isascii() and w.isalpha():
                single.append((k, w.lower()))
            elif _PLAIN.match(w):
                p = self.split(w.lower())
                if len(p) == 1:
                    single.append((k, p[0]))
                else:
                    parts.append((k, p))
            else:
                ids = self.whole.encode(w, add_special_tokens=False).ids
                self.memory.add(keys[k : k + 1], check[k : k + 1], np.array(ids, dtype=np.uint32), np.array([len(ids)]))
        if single:
            self._add([w for _, w in single], *(x[[k for k, _ in single]] for x in (keys, check)))
        if parts:
            flat = [x for _, p in parts for x in p]
            found, memory = self._known(flat), self.memory
            size, start = memory.size[found].astype(np.int64), memory.start[found].astype(np.int64)
            ends = np.cumsum(size)
            ids = memory.pool[np.arange(ends[-1]) + np.repeat(start - ends + size, size)]
            last = np.cumsum([len(p) for _, p in parts]) - 1
            which = [k for k, _ in parts]
            memory.add(keys[which], check[which], ids, np.diff(np.concatenate([[0], ends[last]])))

    def _known(self, pieces: list[str]) -> np.ndarray:
        """Entries of pieces, each a word of its own; new ones are encoded."""
        keys, check = self._marks(Words(pa.array(pieces)))
        missing = np.flatnonzero(self.memory.find(keys, check) < 0)
        if len(missing):
            _, first = np.unique(keys[missing], return_index=True)
            new = missing[first]
            self._add([pieces[k] for k in new], keys[new], check[new])
        return self.memory.find(keys, check)

    def _add(self, pieces: list[str], keys: np.ndarray, check: np.ndarray) -> None:
        spelled = [x if x.isascii() else x.translate(self.alphabet) for x in pieces]
        got = [e.ids for k in range(0, len(spelled), 4096) for e in self.bare.encode_batch_fast(spelled[k : k + 4096], add_special_tokens=False)]
        size = np.fromiter(map(len, got), dtype=np.int64, count=len(got))
        self.memory.add(keys, check, np.fromiter((i for ids in got for i in ids), dtype=np.uint32, count=int(size.sum())), size)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a string column, row after row, and row offsets into them; nulls count as empty."""
        raw, at = utf8(column)
        marks = np.flatnonzero((raw[:-1] == ord("<")) & (raw[1:] == ord("|"))) if len(raw) > 1 else np.zeros(0, np.int64)
        special = np.unique(np.searchsorted(at, marks, side="right") - 1)
        words = Words(column)
        keys, check = self._marks(words)
        if self.memory.count > REMEMBERED:
            self.memory.shrink()
            if self.memory.count > REMEMBERED // 2:
                self.memory.clear()
        found = self.memory.find(keys, check)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            _, first = np.unique(keys[missing], return_index=True)
            new = missing[first]
            data = raw.tobytes()
            listed = [data[a:b].decode() for a, b in zip(words.starts[new].tolist(), words.ends[new].tolist(), strict=True)]
            self._learn_new(listed, keys[new], check[new])
            found[missing] = self.memory.find(keys[missing], check[missing])
        self.memory.hits[found] = np.minimum(self.memory.hits[found] + 1, 2)
        size = self.memory.size[found].astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(size)])
        ids = self.memory.pool[np.arange(ends[-1]) + np.repeat(self.memory.start[found] - ends[:-1], size)]
        rows = ends[words.rows]
        return self._special(column, special, ids, rows) if len(special) else (ids, rows)

    def rest(self) -> None:
        """Keep the frequent words only: a worker that goes on to other work should not hold the others."""
        self.memory.shrink()

    def _learn_new(self, listed: list[str], keys: np.ndarray, check: np.ndarray) -> None:
        # pieces first: a piece may be one of the new words as well
        order = sorted(range(len(listed)), key=lambda k: not (listed[k].isascii() and listed[k].isalpha()))
        plain = sum(listed[k].isascii() and listed[k].isalpha() for k in order)
        for part in (order[:plain], order[plain:]):
            if part:
                rest = [k for k, e in zip(part, self.memory.find(keys[part], check[part]).tolist(), strict=True) if e < 0]
                if rest:
                    self._learn([listed[k] for k in rest], keys[rest], check[rest])

    def _special(self, column: pa.Array, special: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts, at = [], 0
        size = np.diff(rows)
        for i in special.tolist():
            own = np.array(self.whole.encode(column[i].as_py(), add_special_tokens=False).ids, dtype=np.uint32)
            parts += [ids[rows[at] : rows[i]], own]
            size[i], at = len(own), i + 1
        parts.append(ids[rows[at] :])
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(size)])


def with_end(ids: np.ndarray, rows: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with the id ``end`` after each row."""
    return np.insert(ids, rows[1:], end).astype(np.uint32), rows + np.arange(len(rows))
