"""Toxicity by boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of two lexicons, how close their words stand
to a second person, their peak within fifty words, capitals, punctuation and
obfuscated spellings.  One lexicon is fixed; the other is learned from labelled
documents as log odds of words and of four-byte word beginnings, counted over
all of them by Spark.  A training document's own label is taken out of the
counts before its features are made, so the trees see words as they will see
those of a new text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import trees
from .arrow import mapped
from .langid import fold
from .store import Scratch, by_ids, looked_up, one_text
from .words import Words, mix, slices, utf8

FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.3
#: Labelled documents that the trees are fitted on at most (about).
FIT_ROWS = 20_000
#: Bytes of labelled texts that the lexicon counts at most (about), drawn by a hash of the id; this bounds what reaches the driver and the tasks.
LEARN_BYTES = 2 << 30
#: Documents with label 1 that a learned entry needs.
SUPPORT = 3

# Insults, and second persons.
INSULTS = "idiot moron stupid loser pathetic scum trash worthless disgusting clown dumb fool jerk imbecile cretin ugly filthy garbage bastard bitch asshole shit fuck crap freak creep vermin retard pig coward liar idiota estupido imbecil basura asqueroso connard salaud imbécile débile ordure dummkopf arschloch depp trottel abschaum".split()
SECOND = "you your yours yourself u ur youre du dich dir dein deine deinen ihr euch tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros eres".split()

_MARKS = [c for c in range(33, 127) if not chr(c).isalnum()]
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[_MARKS] = 32
#: As above, but signs that stand for letters become those letters, and a star stays.
_UNMASKED = _PLAIN.copy()
for _a, _b in zip("013457@$!|+", "oieastasiit", strict=True):
    _UNMASKED[ord(_a)] = ord(_b)
_UNMASKED[ord("*")] = ord("*")
_UPPER, _LOWER, _PUNCT, _EXCLAIM, _HIGH = (np.zeros(256, dtype=bool) for _ in range(5))
_UPPER[65:91] = _LOWER[97:123] = True
_PUNCT[_MARKS] = True
_EXCLAIM[[33, 63]] = True
_HIGH[128:] = True
_SALT = np.uint64(0x51ED270B0A1F3D27)
FEATURES = 16


def _column(raw: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(raw.tobytes())])


def _hashes(listed: list[str]) -> np.ndarray:
    return np.unique(Words(pa.array(listed)).hashes)


def _starred(listed: list[str]) -> list[str]:
    """Spellings with one inner letter, or all inner ones, replaced by stars."""
    out = []
    for w in listed:
        out += [w[:k] + "*" + w[k + 1 :] for k in range(1, len(w) - 1)]
        out.append(w[0] + "*" * (len(w) - 2) + w[-1])
    return out


INSULT_KEYS, SECOND_KEYS, STAR_KEYS = _hashes(INSULTS), _hashes(SECOND), _hashes(_starred(INSULTS))


def _in(values: np.ndarray, listed: np.ndarray) -> np.ndarray:
    at = np.searchsorted(listed, values)
    return listed[np.minimum(at, len(listed) - 1)] == values if len(listed) else np.zeros(len(values), dtype=bool)


def _beginnings(words: Words) -> np.ndarray:
    return mix((words.lead & np.uint64(0xFFFFFFFF)) + _SALT)


@dataclass
class Lexicon:
    """Sorted keys and their log odds: as counted, and less one document of label 0 or 1."""

    keys: np.ndarray
    odds: np.ndarray  # (3, entries): all documents, less one of label 0, less one of label 1

    def weights(self, values: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Log odds above zero of each value; ``own`` chooses the row of ``odds``."""
        if not len(self.keys):
            return np.zeros(len(values))
        at = np.minimum(np.searchsorted(self.keys, values), len(self.keys) - 1)
        return np.where(self.keys[at] == values, np.maximum(self.odds[own, at], 0), 0)


def _per_row(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.float64)])
    return total[at[1:]] - total[at[:-1]]


def _peak(weight: np.ndarray, rows: np.ndarray, width: int = 50) -> np.ndarray:
    """Largest sum of weights within ``width`` words of each row."""
    peak = np.zeros(len(rows) - 1)
    hit = np.flatnonzero(weight)
    if len(hit):
        total = np.concatenate([[0], np.cumsum(weight)])
        owner = np.searchsorted(rows, hit, side="right") - 1
        np.maximum.at(peak, owner, total[np.minimum(hit + width, rows[owner + 1])] - total[hit])
    return peak


def features(column: pa.Array, lexicon: Lexicon, own: np.ndarray) -> np.ndarray:
    """(rows x FEATURES); own[i]: 0 for a text outside the counts, else 1 + its label."""
    raw, at = utf8(column)
    plain, bare = Words(_column(_PLAIN[raw], at)), Words(_column(_UNMASKED[raw], at))
    rows = plain.rows
    n_words = np.maximum(np.diff(rows), 1)
    size = np.maximum(np.diff(at), 1)
    which = np.repeat(own, np.diff(rows))
    learned = np.maximum(lexicon.weights(plain.hashes, which), lexicon.weights(_beginnings(plain), which))
    strong = learned >= 3
    insult, second = _in(plain.hashes, INSULT_KEYS), _in(plain.hashes, SECOND_KEYS)
    # second persons within five words of a listed or strong word of the same row
    seen = np.concatenate([[0], np.cumsum(second)])
    hit = np.flatnonzero(insult | strong)
    owner = np.searchsorted(rows, hit, side="right") - 1
    near = seen[np.minimum(hit + 6, rows[owner + 1])] - seen[np.maximum(hit - 5, rows[owner])] > 0
    close = np.bincount(owner, weights=near, minlength=len(rows) - 1)
    masked = _in(bare.hashes, STAR_KEYS).astype(float)
    hidden = _per_row(_in(bare.hashes, INSULT_KEYS), bare.rows) + _per_row(masked, bare.rows)
    upper, letters = _per_row(_UPPER[raw], at), _per_row(_UPPER[raw] | _LOWER[raw] | _HIGH[raw], at)
    listed = _per_row(insult, rows)
    return np.stack(
        [
            listed / n_words,
            np.log1p(listed),
            _per_row(learned, rows) / n_words,
            np.log1p(_per_row(learned, rows)),
            _per_row(strong, rows) / n_words,
            np.log1p(_per_row(strong, rows)),
            _peak(learned, rows),
            _peak(insult.astype(float), rows),
            close / n_words,
            _per_row(second, rows) / n_words,
            upper / np.maximum(letters, 1),
            _per_row(_PUNCT[raw], at) / size,
            _per_row(_EXCLAIM[raw], at) / size,
            np.maximum(hidden - listed, 0) / n_words,
            _per_row(masked, bare.rows),
            np.log1p(np.diff(rows)),
        ],
        axis=1,
    )


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of label 0 and 1 that hold a word or a beginning, summed over a batch."""
    for whole in batches:
        for part in slices(whole, "text"):
            raw, at = utf8(part.column("text"))
            words = Words(_column(_PLAIN[raw], at))
            label = part.column("toxic").to_numpy(zero_copy_only=False)
            owner = np.tile(np.repeat(np.arange(part.num_rows), np.diff(words.rows)), 2)
            keys = np.concatenate([words.hashes, _beginnings(words)])
            order = np.lexsort((owner, keys))
            keys, owner = keys[order], owner[order]
            new = np.ones(len(keys), dtype=bool)
            new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
            keys, owner = keys[new], owner[new]
            values, index = np.unique(keys, return_inverse=True)
            toxic = np.bincount(index, weights=label[owner], minlength=len(values)).astype(np.int64)
            clean = np.bincount(index, minlength=len(values)) - toxic
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(toxic), pa.array(clean)], names=["key", "toxic", "clean"])


def _odds(t: np.ndarray, c: np.ndarray, n_toxic: float, n_clean: float) -> np.ndarray:
    t, c, n_toxic, n_clean = np.maximum(t, 0), np.maximum(c, 0), max(n_toxic, 1), max(n_clean, 1)
    return np.log((t + 0.1) / (n_toxic - t + 0.9).clip(0.1)) - np.log((c + 0.5) / (n_clean - c + 0.5).clip(0.1))


def lexicon(labelled: DataFrame, n_toxic: int, n_clean: int) -> Lexicon:
    """Learn log odds from (text, toxic); keeps every entry well above chance, about 32 bytes each, on the driver: bound what is given."""
    counts = mapped(labelled.select("text", "toxic"), _counted, "key long, toxic long, clean long").groupBy("key").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    t, c = F.col("t") + 0.1, F.col("c") + 0.5
    odds = F.log(t / (n_toxic - F.col("t") + 0.9)) - F.log(c / (n_clean - F.col("c") + 0.5))
    good = counts.where((F.col("t") >= SUPPORT) & (odds - 2 * F.sqrt(1 / t + 1 / c) > 0.5))
    kept = good.toPandas()
    keys = kept["key"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(keys)
    tt, cc = kept["t"].to_numpy(dtype=float)[order], kept["c"].to_numpy(dtype=float)[order]
    return Lexicon(keys[order], np.stack([_odds(tt, cc, n_toxic, n_clean), _odds(tt, cc - 1, n_toxic, n_clean - 1), _odds(tt - 1, cc, n_toxic - 1, n_clean)]))


@dataclass
class Model:
    lexicon: Lexicon
    boosted: trees.Boosted


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learn from labelled documents outside the held-out fold, from about ``LEARN_BYTES`` of their texts at most."""
    scratch = Scratch(docs.sparkSession, "toxic")
    marks = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(fold(F.col("doc_id"), FOLDS) != HELD_OUT)
    marks = scratch.table(marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "labels")
    texts = one_text(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), scratch)
    labelled = looked_up(texts, marks, "doc_id")

    def measured(rows: DataFrame) -> dict[int, tuple[int, int]]:
        return {r["toxic"]: (r["n"], r["b"]) for r in rows.groupBy("toxic").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).collect()}

    total = measured(labelled)
    known = min(1.0, LEARN_BYTES / max(sum(b for _, b in total.values()), 1))
    if known < 1:
        marks = scratch.table(marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < known * (1 << 30)), "known")
        labelled = looked_up(texts, marks, "doc_id")
        total = measured(labelled)
    n_clean, n_toxic = (total.get(k, (0, 0))[0] for k in (0, 1))
    if not n_clean or not n_toxic:
        base = float(n_toxic > 0) if n_clean + n_toxic else 0.0
        return Model(Lexicon(np.zeros(0, np.uint64), np.zeros((3, 0))), trees.Boosted(steps=(np.array([0.0]), np.array([base]))))
    words = lexicon(labelled, n_toxic, n_clean)
    share = known * min(1.0, FIT_ROWS / (n_clean + n_toxic))
    drawn = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30))
    drawn = looked_up(by_ids(texts, drawn.select("doc_id"), "left_semi"), marks, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text"):
                y = part.column("toxic").to_numpy(zero_copy_only=False)
                x = features(part.column("text"), words, 1 + y)
                rows = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), FEATURES).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(y), rows], names=["doc_id", "toxic", "x"])

    id_type = docs.schema[id_col].dataType.simpleString()
    got = mapped(drawn.select("doc_id", "text", "toxic"), run, f"doc_id {id_type}, toxic int, x array<double>").withColumn("held", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4)) == 0).toPandas()
    got = got.sort_values("doc_id", kind="stable")
    x = np.stack(got["x"].to_numpy()) if len(got) else np.zeros((0, FEATURES))
    return Model(words, trees.fit(x, got["toxic"].to_numpy(), got["held"].to_numpy()))


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text"):
                x = features(part.column("text"), model.lexicon, np.zeros(part.num_rows, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(model.boosted.score(x))], names=["doc_id", "score"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return mapped(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, f"doc_id {id_type}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row.

    Labels are read outside the fold crc32(id as text) modulo 4 = 2, which is
    held out; a document with several labels has the largest, labels other than
    0 and 1 and those of no document are left out; of rows that share an id one
    text, the least, is learned from, so repeated rows count once.  Every row is
    scored.  Null texts are scored as empty ones, equal texts alike.  Without labels
    all scores are 0; with labels of one value they are that value.  Rows with a
    null id are scored, held_out null.  An empty table gives an empty result;
    other columns are not read.
    """
    model = train(docs, labels, id_col, text_col, label_col)
    return scored(docs, model, id_col, text_col).select(
        "doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
