"""Language identification by a convolutional network over bytes, in numpy.

A text's UTF-8 bytes are cut into windows of ``WINDOW`` bytes, all of them, the
last one padded with spaces.  Bytes are embedded, convolved with filters two to
four bytes wide, max-pooled over the window and classified with a softmax.  A
text's score for a language is the mean over its windows, weighted by their
bytes.

For prediction the trained filters become tables: what two neighbouring bytes
contribute to each filter is one row of a 65,536-row table, so a filter of any
width here costs at most two lookups a byte.

A softmax names some language for anything, so a second model decides whether a
text is in a learned language at all: how usual its letters and their neighbours
are in the languages that the network finds likeliest in each window.  What is
usual is measured for each language on its training documents, each under the
counts of the others, so the limit follows from the language and not from the
number of languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import mapped
from .words import slices, utf8

WINDOW, WIDTHS, FILTERS, EMBED = 256, (2, 3, 4), 16, 8
#: Documents of each language that training reads at most (about), whole texts, and passes.
PER_LANGUAGE, PASSES, FOLDS = 200, 8, 5
#: Whether a text is in a learned language is decided by ``Usual`` alone, so no score is too small: those of
#: texts that mix languages are small, and the least possible one depends on the number of languages.
LEAST_SCORE = 0.0
#: Bytes of a piece that is refused or not, hashed values of a gram, languages a window is compared with (the
#: likeliest ones), documents a language needs to be judged by, and spreads that a piece may lie above the usual.
PIECE, GRAMS, NEAR, FEW, REACH = 64, 1 << 16, 4, 5, 4.0
#: Added to each gram's count; units of a bit.
_PRIOR, _UNIT = 0.1, 256
_LETTER = regex.compile(r"\p{L}")


# A-Z lowered, digits alike, other ASCII blank; bytes of other scripts stay
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[:128] = 32
_PLAIN[65:91] = _PLAIN[97:123] = np.arange(97, 123)
_PLAIN[48:58] = 48


@dataclass
class Usual:
    """For each language how many bits more than usual a gram costs (in ``_UNIT``), and the spread of pieces.

    Languages of fewer than ``FEW`` documents are not ``judged``.
    """

    excess: np.ndarray  # (languages, GRAMS)
    spread: np.ndarray
    judged: np.ndarray

    def refused(self, windows: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Letters in refused pieces and in all pieces of each window; ``p`` are its languages' probabilities."""
        near = np.argsort(-np.where(self.judged, p, -1), axis=1, kind="stable")[:, :NEAR]
        gram, counts = grams(windows)
        least = None  # a text may mix languages word by word
        for k in range(near.shape[1]):
            value = np.take(self.excess.ravel(), near[:, k, None] * GRAMS + gram)
            least = value if least is None else np.minimum(least, value, out=least)
        n = _by_piece(counts)
        over = _by_piece(np.where(counts, least, 0)) / _UNIT > REACH * self.spread[near].max(axis=1)[:, None] * np.sqrt(n)
        return (n * over).sum(axis=1), n.sum(axis=1)


@dataclass
class Network:
    """Weights; ``languages`` in the order of the output."""

    languages: list[str]
    embed: np.ndarray
    filters: list[np.ndarray]  # a (width * EMBED, FILTERS) matrix for each width
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    usual: Usual | None = None

    def tables(self) -> list[list[tuple[int, np.ndarray]]]:
        """For each width, (byte place, rows by byte pair or byte) of which the filter values are the sum."""
        tables = []
        for width, w in zip(WIDTHS, self.filters, strict=True):
            each = [self.embed @ w[k * EMBED : (k + 1) * EMBED] for k in range(width)]
            parts = []
            for k in range(0, width - 1, 2):  # row: first byte + 256 * second byte
                parts.append((k, (each[k + 1][:, None, :] + each[k][None, :, :]).reshape(65536, -1).astype(np.float32)))
            if width % 2:
                parts.append((width - 1, each[-1].astype(np.float32)))
            tables.append(parts)
        return tables


def grams(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each byte with its two neighbours, and whether it counts: a letter that no digit stands next to."""
    b = _PLAIN[windows]
    wide = b.astype(np.uint32)
    code = ((wide[:, :-2] << 16 | wide[:, 1:-1] << 8 | wide[:, 2:]) * np.uint32(2654435761)) >> np.uint32(16)
    return code.astype(np.int64), (b[:, 1:-1] > 96) & (b[:, :-2] != 48) & (b[:, 2:] != 48)


def _by_piece(values: np.ndarray) -> np.ndarray:
    """Sums over the pieces of each window, from one value for each gram."""
    return np.add.reduceat(values, np.arange(0, values.shape[1], PIECE), axis=1, dtype=np.int64)


def usual(windows: np.ndarray, labels: np.ndarray, docs: np.ndarray, languages: int) -> Usual:
    """Learn from windows, their languages and the documents they come from."""
    excess = np.full((languages, GRAMS), np.iinfo(np.int16).max, dtype=np.int16)
    spread, judged = np.ones(languages), np.zeros(languages, dtype=bool)
    for k in range(languages):
        mine = np.flatnonzero(labels == k)
        own = np.unique(docs[mine], return_inverse=True)[1]
        if not len(mine) or own.max() + 1 < FEW:
            continue
        gram, counts = grams(windows[mine])
        total = np.bincount(gram[counts], minlength=GRAMS)
        # each document under the counts of the others
        owner = np.repeat(own, counts.sum(axis=1))
        _, at, held = np.unique(owner * GRAMS + gram[counts], return_inverse=True, return_counts=True)
        others = total.sum() - np.bincount(owner, minlength=own.max() + 1)
        cost = np.zeros(gram.shape)
        cost[counts] = np.log2(others[owner] + _PRIOR * GRAMS) - np.log2(total[gram[counts]] - held[at] + _PRIOR)
        n = _by_piece(counts)
        some = n >= 8
        if not some.any():
            continue
        mean = np.add.reduceat(cost, np.arange(0, cost.shape[1], PIECE), axis=1)[some] / n[some]
        middle = np.median(mean)
        spread[k] = max(1.0, np.quantile((mean - middle) * np.sqrt(n[some]), 0.9))
        excess[k] = np.rint((np.log2(total.sum() + _PRIOR * GRAMS) - np.log2(total + _PRIOR) - middle) * _UNIT)
        judged[k] = True
    return Usual(excess, spread, judged)


def pooled(windows: np.ndarray, tables: list, bias: np.ndarray) -> np.ndarray:
    """Max-pooled filter values of byte windows (n x WINDOW)."""
    n, size = windows.shape
    pairs = windows[:, :-1].astype(np.int32) + windows[:, 1:].astype(np.int32) * 256
    out = []
    for width, parts in zip(WIDTHS, tables, strict=True):
        count = size - width + 1
        total = None
        for at, rows in parts:
            index = pairs if len(rows) == 65536 else windows
            value = np.take(rows, index[:, at : at + count], axis=0)
            total = value if total is None else np.add(total, value, out=total)
        out.append(total.max(axis=1))
    return np.maximum(np.concatenate(out, axis=1) + bias, 0)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(windows: np.ndarray, labels: np.ndarray, languages: list[str], passes: int = PASSES, seed: int = 7) -> Network:
    """Train on byte windows (n x WINDOW) with Adam."""
    rng = np.random.default_rng(seed)
    width_in = [w * EMBED for w in WIDTHS]
    p = [rng.normal(0, 0.5, (256, EMBED)), *(rng.normal(0, 1 / np.sqrt(k), (k, FILTERS)) for k in width_in)]
    p += [np.zeros(FILTERS * len(WIDTHS)), rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(languages))), np.zeros(len(languages))]
    p = [x.astype(np.float32) for x in p]
    m, v = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    # languages weigh alike however many windows they have
    weight = (len(labels) / (len(languages) * np.bincount(labels, minlength=len(languages)).clip(1)))[labels]
    step, size = 0, 32
    for turn in range(passes):
        order = rng.permutation(len(labels))
        for lo in range(0, len(order), size):
            pick = order[lo : lo + size]
            x, y = windows[pick], labels[pick]
            e = p[0][x]
            cols, peaks, hidden = [], [], []
            for k, width in enumerate(WIDTHS):
                c = np.lib.stride_tricks.sliding_window_view(e, width, axis=1).transpose(0, 1, 3, 2).reshape(len(x), -1, width * EMBED)
                z = c @ p[1 + k]
                top = z.argmax(axis=1)
                cols.append(c)
                peaks.append(top)
                hidden.append(np.take_along_axis(z, top[:, None, :], axis=1)[:, 0])
            a = np.concatenate(hidden, axis=1) + p[-3]
            h = np.maximum(a, 0)
            g = softmax(h @ p[-2] + p[-1])
            g[np.arange(len(y)), y] -= 1
            g *= (weight[pick] / len(y))[:, None].astype(np.float32)
            grad = [np.zeros_like(q) for q in p]
            grad[-2], grad[-1] = h.T @ g, g.sum(axis=0)
            d = (g @ p[-2].T) * (a > 0)
            grad[-3] = d.sum(axis=0)
            rows = np.arange(len(x))[:, None]
            for k, width in enumerate(WIDTHS):
                dk, top = d[:, k * FILTERS : (k + 1) * FILTERS], peaks[k]
                seen = cols[k][rows, top]  # (batch, filter, width * EMBED)
                grad[1 + k] = np.einsum("bf,bfk->kf", dk, seen)
                back = (dk[:, :, None] * p[1 + k].T[None]).reshape(len(x), FILTERS, width, EMBED)
                for j in range(width):
                    np.add.at(grad[0], x[rows, top + j], back[:, :, j])
            step += 1
            rate = 0.01 * (1 - step / (passes * (len(order) / size + 1))) + 1e-4
            for q, gq, mq, vq in zip(p, grad, m, v, strict=True):
                mq += 0.1 * (gq - mq)
                vq += 0.01 * (gq * gq - vq)
                q -= (rate * mq / (1 - 0.9**step) / (np.sqrt(vq / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return Network(languages, p[0], p[1 : 1 + len(WIDTHS)], p[-3], p[-2], p[-1])


def cut(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of the rows ``raw[at[i]:at[i+1]]``: bytes (n x WINDOW), row numbers, byte counts."""
    size = np.diff(at)
    count = -(-size // WINDOW)
    owner = np.repeat(np.arange(len(size)), count)
    first = np.repeat(np.cumsum(count) - count, count)
    start = (np.arange(len(owner)) - first) * WINDOW
    used = np.minimum(size[owner] - start, WINDOW)
    padded = np.concatenate([raw, np.full(WINDOW, 32, dtype=np.uint8)])
    view = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)
    windows = view[at[owner] + start].copy()
    windows[np.arange(WINDOW)[None, :] >= used[:, None]] = 32
    return windows, owner, used


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(id_col.cast("string").cast("binary")) % folds


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Network | None:
    """Learn from labelled documents outside fold 0; None if there are none.

    A hash of the id draws about ``per_language`` documents of each language,
    whose texts are read whole; every language is learned.
    """
    labelled = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l")).where((fold(F.col("i"), FOLDS) != 0) & F.col("l").isNotNull() & (F.length("t") > 0))
    counts = {r["l"]: r["n"] for r in labelled.groupBy("l").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    share = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, min(1.0, per_language / n))))
    drawn = labelled.where((F.pmod(F.xxhash64("i"), F.lit(1 << 30)) / (1 << 30)) < F.coalesce(share[F.col("l")], F.lit(0.0)))
    rows = sorted(drawn.select("l", "i", "t").collect(), key=lambda r: (r["l"], str(r["i"]), r["t"]))
    if not rows:
        return None
    languages = sorted(counts)
    number = {k: i for i, k in enumerate(languages)}
    windows, owner, _ = cut(*utf8(pa.array([r["t"] for r in rows], pa.large_string())))
    labels = np.array([number[r["l"]] for r in rows])[owner]
    network = fit(windows, labels, languages)
    network.usual = usual(windows, labels, owner, len(languages))
    return network


def identified(docs: DataFrame, network: Network | None, id_col: str = "doc_id", text_col: str = "text", refuse: bool = False) -> DataFrame:
    """(doc_id, lang_pred, score) of each row: ``und`` and 0 for null texts and those without a letter (Unicode category L).

    All others get the likeliest of the learned languages, of equally likely ones
    the first in the alphabet.  With ``refuse``, texts that have more than half of
    their letters in pieces that no language explains are ``und`` too; those for
    which the best language is not judged (of too few documents) are not refused.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = network.tables() if network else None
        for whole in batches:
            for part in slices(whole, "text"):
                n = part.num_rows
                letter = np.array([t is not None and _LETTER.search(t) is not None for t in part.column("text").to_pylist()], dtype=bool)
                names, score = np.full(n, "und", dtype=object), np.zeros(n)
                if network and letter.any():
                    raw, at = utf8(part.column("text"))
                    windows, owner, used = cut(raw, at)
                    p, strange = np.empty((len(windows), len(network.languages))), np.zeros((2, len(windows)))
                    judge = network.usual if refuse and network.usual is not None and network.usual.judged.any() else None
                    for lo in range(0, len(windows), 64):
                        some = windows[lo : lo + 64]
                        p[lo : lo + 64] = softmax(pooled(some, tables, network.bias) @ network.out + network.out_bias)
                        if judge:
                            strange[:, lo : lo + 64] = judge.refused(some, p[lo : lo + 64])
                    total = np.zeros((n, p.shape[1]))
                    for k in range(p.shape[1]):
                        total[:, k] = np.bincount(owner, weights=p[:, k] * used, minlength=n)
                    total /= np.maximum(np.diff(at), 1)[:, None]
                    best = total.argmax(axis=1)
                    if judge:
                        refused, of = (np.bincount(owner, weights=x, minlength=n) for x in strange)
                        letter &= (2 * refused <= of) | ~judge.judged[best]
                    names = np.where(letter, np.array(network.languages, dtype=object)[best], "und")
                    score = np.where(letter, np.clip(total[np.arange(n), best], 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return mapped(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, f"doc_id {id_type}, lang_pred string, score double")


def languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each row.

    Trains on rows whose language is not null and whose fold (crc32 of the id as
    text, modulo 5) is not 0; fold 0 is held out.  Predictions see the text
    alone and name a learned language for every text with a letter, ``und`` for
    others.  Rows with a null id are scored, held_out null; repeated rows are
    scored each.  Without any labelled
    row all predictions are ``und``.  An empty table gives an empty result; other
    columns are not read.
    """
    found = identified(docs, train(docs, id_col, text_col, lang_col), id_col, text_col)
    return found.select("doc_id", (fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "lang_pred", "score")
