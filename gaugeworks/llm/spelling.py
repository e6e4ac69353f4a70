"""Spelling variants: words one edit apart, by a positional q-gram index.

Plan
----
1. Words are counted in tasks, a table of partial counts a task, and summed.
2. Pairs of lengths (m, m) and (m - 1, m) are searched by their longer length
   m, with grams of q = min((m - 1) div 2, 5) letters.  One edit spoils q grams
   at most, so at least T = m - 2q + 1 >= 2 positional grams agree: in place
   for equal lengths, in place or one further right in the longer word else.
3. Hence the first q + 1 grams of the longer and the first q of the shorter
   word, both ordered by how many words hold them and rarest first, share one.
   Words are listed under these alone: the postings of the index.  A posting
   list is split into blocks of about ``BLOCK`` words where it is longer, and
   the blocks meet in pairs, so no task holds a long list.
4. Within a list (or two blocks of one) the words' other grams are indexed by
   place, a word's postings are merged by a heap, and those words that occur
   T - 1 times or more are verified letter by letter.

Words without a partner on a list are never sent to it, and nothing is
collected or broadcast but counted tables (``store.looked_up``).
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from heapq import heapify, heappop, heapreplace
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import mapped
from .store import Scratch, looked_up

LEAST_LETTERS, LEAST_COUNT, TIMES = 6, 5, 5
#: Longest gram; words of one block of a posting list, about; words a task counts before it emits them.
LONGEST_GRAM, BLOCK, HELD = 5, 2000, 200_000
#: Words of a posting list that are verified at once, without merging their postings.
FEW = 8


def word_counts(docs: DataFrame, letters: int = LEAST_LETTERS, spoil: int | None = None) -> DataFrame:
    """(word, n) over all of ``docs`` (doc_id, text): runs `[A-Za-z\\u00C0-\\u00FF]+`, A-Z lowered, of ``letters`` or more.

    With ``spoil``, a run loses the letter h % length if ``spoil`` divides h, the
    crc32 of its id in decimal digits, a colon and the lowered run: known
    misspellings, the same in each run.  A missing id counts as no digits there; a
    null text has no words.  Rows that share an id are counted each.
    """
    runs_of = re.compile("[a-zÀ-ÿ]{%d,}" % letters).findall

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return made

        for batch in batches:
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.large_binary()).to_pylist(), strict=True):
                if not text:
                    continue
                runs = runs_of(text.lower().decode("utf-8", "replace"))  # of bytes: lowers A-Z alone
                if spoil is None:
                    held.update(runs)
                else:
                    lead = zlib.crc32(b"%s:" % (b"" if key is None else str(key).encode()))
                    for word, n in Counter(runs).items():
                        h = zlib.crc32(word.encode(), lead)
                        if h % spoil == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < letters:
                                continue
                        held[word] += n
                if len(held) > HELD:
                    yield out()
        yield out()

    return mapped(docs.select("doc_id", "text"), run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def one_edit(x: str, y: str) -> bool:
    """Whether x and y differ by exactly one inserted, deleted or replaced code point."""
    if len(x) > len(y):
        x, y = y, x
    if len(y) - len(x) > 1 or x == y:
        return False
    i = 0
    while i < len(x) and x[i] == y[i]:
        i += 1
    return x[i + (len(x) == len(y)) :] == y[i + 1 :]


def gram_size(longer: int) -> int:
    return min((longer - 1) // 2, LONGEST_GRAM)


def linked(longer: int, key: tuple[str, int], words: list[tuple[str, int]], crossed: bool) -> Iterator[tuple[str, str]]:
    """Pairs one edit apart of one posting list: ``words`` (word, block) that hold gram ``key``.

    The indexed words are those of length ``longer``; each word queries them.  With ``crossed``, words of one
    block are not compared: another task does.
    """
    q = gram_size(longer)
    least = longer - 2 * q  # T without the list's own gram
    words = sorted(set(words))
    if len(words) <= FEW:  # merging postings of so few words is dearer than reading them
        for i, (word, block) in enumerate(words):
            for other, at in words[i + 1 :]:
                if longer in (len(word), len(other)) and not (crossed and at == block) and one_edit(word, other):
                    yield word, other
        return
    index: dict[tuple[str, int], list[int]] = {}
    for i, (word, _) in enumerate(words):
        if len(word) == longer:
            for p in range(longer - q + 1):
                index.setdefault((word[p : p + q], p), []).append(i)
    index.pop(key, None)
    for i, (word, block) in enumerate(words):
        same = len(word) == longer
        lists, heap = [], []
        for p in range(len(word) - q + 1):
            for s in (p,) if same else (p, p + 1):
                at = index.get((word[p : p + q], s))
                if at is not None:
                    first = bisect_right(at, i) if same else 0  # equal lengths meet once a pair
                    if first < len(at):
                        heap.append(at[first] << _LISTS | len(lists))
                        lists.append((at, first))
        for j, times in merged(heap, lists):
            if times >= least and not (crossed and words[j][1] == block) and one_edit(word, words[j][0]):
                yield min(word, words[j][0]), max(word, words[j][0])


#: Bits for the number of a posting list beside an entry on the heap; more lists than that need longer words than ``2 ** 39`` letters.
_LISTS = 40


def merged(heap: list[int], lists: list[tuple[list[int], int]]) -> Iterator[tuple[int, int]]:
    """(entry, how many lists hold it), ascending: ascending lists, each from a place on, merged by a heap of entries and list numbers."""
    heapify(heap)
    places = [first for _, first in lists]
    now, times, mask = -1, 0, (1 << _LISTS) - 1
    while heap:
        j, k = heap[0] >> _LISTS, heap[0] & mask
        if j == now:
            times += 1
        else:
            if times:
                yield now, times
            now, times = j, 1
        places[k] += 1
        at = lists[k][0]
        if places[k] < len(at):
            heapreplace(heap, at[places[k]] << _LISTS | k)
        else:
            heappop(heap)
    if times:
        yield now, times


def near_words(vocabulary: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b), a < b in code-point order, of all words of a written table (word) that are one edit apart.

    Words shorter than three letters have no gram that survives an edit and are not paired.
    """
    size = f"least((m - 1) div 2, {LONGEST_GRAM})"
    grams = (
        vocabulary.select("word", F.length("word").alias("size"))
        .where("size >= 3")
        .select("word", "size", F.explode(F.expr("array(size, size + 1)")).alias("m"))
        .select("word", "size", "m", F.expr(f"cast({size} as int)").alias("q"))
        .select("word", "size", "m", "q", F.explode(F.expr("transform(sequence(0, size - q), p -> struct(substring(word, p + 1, q) as g, p as p))")).alias("t"))
        .select("word", "size", "m", "q", "t.g", "t.p")
    )
    often = scratch.table(grams.groupBy("m", "g").agg(F.count("*").alias("c")).where("c > 1"), "grams")
    # a gram that only one word holds may still be among the rarest, so the join keeps it
    first = (
        looked_up(grams, often, ["m", "g"], "left")
        .groupBy("word", "size", "m", "q")
        .agg(F.sort_array(F.collect_list(F.struct(F.coalesce("c", F.lit(1)).alias("c"), "g", "p"))).alias("t"))
        .select("word", "m", (F.col("size") == F.col("m")).alias("long"), F.explode(F.expr("slice(t, 1, if(size = m, q + 1, q))")).alias("t"))
    )
    entries = scratch.table(
        first.select("word", "m", "long", "t.g", F.explode(F.expr("if(long, array(t.p), array(t.p, t.p + 1))")).alias("p")).distinct(), "entries"
    )
    lists = scratch.table(
        entries.groupBy("m", "g", "p").agg(F.count("*").alias("n"), F.max("long").alias("any")).where("n > 1 and any").select("m", "g", "p", F.ceil(F.col("n") / BLOCK).cast("int").alias("k")),
        "lists",
    )
    dealt = (
        looked_up(entries, lists, ["m", "g", "p"])
        .withColumn("b", F.expr("cast(pmod(xxhash64(word), k) as int)"))
        .withColumn("o", F.explode(F.expr("sequence(0, k - 1)")))
        .select("m", "g", "p", F.least("b", "o").alias("b1"), F.greatest("b", "o").alias("b2"), "word", "b")
    )
    key = ["m", "g", "p", "b1", "b2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        held: list[tuple[str, str]] = []

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([x[i] for x in held], pa.string()) for i in (0, 1)], ["a", "b"])
            held.clear()
            return made

        for (m, g, p, b1, b2), same in groupby(rows(), key=lambda r: r[:5]):
            held += linked(m, (g, p), [(r[5], r[6]) for r in same], b1 < b2)
            if len(held) > HELD:
                yield out()
        yield out()

    sent = dealt.repartition(*key).sortWithinPartitions(*key)
    return scratch.table(mapped(sent, run, "a string, b string").distinct(), "pairs")


def variants(counts: DataFrame, times: int = TIMES) -> DataFrame:
    """Each word of ``counts`` (word, n; one row a word) with its form and root.

    Returns word, form, root, n, n_near, form_n.  ``form`` is the near word (one
    edit away) of largest n, of equals the first in code-point order, if it has
    ``times`` the word's n or more; ``root`` follows forms to the last one.
    """
    if times < 2:
        raise ValueError("forms must be at least twice as frequent, else chains may not end")
    scratch = Scratch(counts.sparkSession, "spelling")
    words = scratch.table(counts.select("word", "n"), "words")
    pairs = near_words(words, scratch)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("other")))
    best = (
        both.join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
        .groupBy("word")
        .agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    )
    fits = F.expr(f"-best.less >= {times} * n")
    known = scratch.table(
        words.join(best, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("best.other")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n")
        ),
        "known",
    )
    roots = scratch.table(known.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:  # each round doubles the steps followed; forms grow more frequent by ``times``, so chains end
        up = roots.select(F.col("word").alias("root"), F.col("root").alias("above"))
        after = scratch.table(roots.join(up, "root", "left").select("word", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "roots")
        scratch.drop(roots)
        roots = after
        if roots.where("moved").isEmpty():
            break
        roots = roots.drop("moved")
        roots._scratch_path = after._scratch_path
    return known.join(roots.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, letters: int = LEAST_LETTERS, least: int = LEAST_COUNT, times: int = TIMES, spoil: int | None = None) -> DataFrame:
    """``variants`` of the words of ``docs`` (doc_id, text) with ``letters`` or more that occur ``least`` times or more.

    Null and empty texts and an empty table give no words; other columns are not read.
    """
    return variants(word_counts(docs, letters, spoil).where(F.col("n") >= least), times)
