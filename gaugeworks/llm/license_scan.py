"""License statements in documents, by MinHash bands over overlapping windows.

Words are runs of letters and digits, A-Z lowered; shingles are five words.
Templates are classed by their shingle count, classes doubling in size.  For a
class of up to ``u`` shingles a document is cut into windows of ``3u/2``
shingles, one every ``u/2``, so any run of ``u`` shingles lies whole in one of
them.  A template of which a window holds the wanted share has a Jaccard
similarity with it above a bound that follows from these sizes; the class has as
many bands of one MinHash as make the chance to miss all of them less than one
in a million at that bound.  Templates that share a band value with a window are
then verified: the share of the template's distinct shingles found in the window
and its neighbours on both sides.

All of it happens within a row: documents are neither shuffled nor compared.
The minima of larger windows are built from those of smaller ones.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import mapped
from .license_texts import TEXTS
from .words import Words, odd_constants, slices, utf8

WIDTH, CONTAINMENT, MISS = 5, 0.8, 1e-6

# Names of licenses as statements give them, and their notices and texts.
NAMES = {
    "MIT": ["MIT License"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU GPL v2"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU GPL v3"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3"],
    "MPL-2.0": ["Mozilla Public License, version 2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License"],
    "BSD-3-Clause": ["BSD 3-Clause License"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
}
PHRASES = ["Licensed under the {}", "Licensed under {}", "Released under the {}", "Distributed under the {}", "Available under the {}", "under the terms of the {}"]
_GNU = "This {} you can redistribute it and/or modify it under the terms of the {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
NOTICES = {
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "BSD-2-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "BSD-3-Clause": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "GPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "GPL-2.0": [_GNU.format("program is free software;", "GNU General Public License", "2")],
    "LGPL-2.1": [_GNU.format("library is free software;", "GNU Lesser General Public License", "2.1")],
    "LGPL-3.0": [_GNU.format(f"{what} is free software:", "GNU Lesser General Public License", "3") for what in ("program", "library")],
    "AGPL-3.0": [_GNU.format("program is free software:", "GNU Affero General Public License", "3")],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
}


def templates() -> list[tuple[str, str]]:
    """(license, text) of the built-in templates: each phrase with each name, the notices, whole texts of short licenses."""
    out = [(k, p.format(n)) for k, names in NAMES.items() for n in names for p in PHRASES]
    return out + [(k, t) for known in (NOTICES, TEXTS) for k, texts in known.items() for t in texts]


_SPLIT = np.arange(256, dtype=np.uint8)
_SPLIT[[c for c in range(128) if not chr(c).isalnum()]] = 32


def _shingles(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    raw, at = utf8(column)
    plain = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(_SPLIT[raw].tobytes())])
    return Words(plain).grams(width)


@dataclass
class SizeClass:
    """Templates of at most ``most`` shingles; band b has the multiplier ``salts[b]``."""

    most: int
    bands: int
    members: list[int]
    values: list[np.ndarray]  # for each band the members' minima, in members' order
    filters: np.ndarray  # (bands, 65536): whether a member's minimum ends in these bits


def classes(sets: list[np.ndarray], containment: float) -> list[SizeClass]:
    out = []
    sizes = np.array([len(s) for s in sets])
    most = 1
    while most < 2 * max(sizes.max(initial=0), 1):
        members = np.flatnonzero((sizes > most // 2) & (sizes <= most))
        if len(members):
            least = int(sizes[members].min())
            held = math.ceil(containment * least - 1e-9)
            bound = held / (most + most // 2 + least - held)
            bands = math.ceil(math.log(MISS) / math.log(1 - bound)) if bound < 1 else 1
            salts = odd_constants(bands, 31)
            values = [np.array([_value(sets[m], salts[b]).min() for m in members], dtype=np.uint64) for b in range(bands)]
            filters = np.zeros((bands, 65536), dtype=bool)
            for b, v in enumerate(values):
                filters[b, (v & np.uint64(0xFFFF)).astype(np.int64)] = True
            out.append(SizeClass(most, bands, members.tolist(), values, filters))
        most *= 2
    return out


def _value(hashes: np.ndarray, salt: np.uint64) -> np.ndarray:
    x = (hashes ^ salt) * salt
    return x ^ (x >> np.uint64(29))


def _halved(starts: np.ndarray, owner: np.ndarray, row_first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which blocks begin a block of twice the size, and their owners."""
    keep = (np.arange(len(starts)) - row_first[owner]) % 2 == 0
    return np.flatnonzero(keep), owner[keep]


def _matches(hashes: np.ndarray, rows: np.ndarray, found: list[SizeClass], sets: list[np.ndarray], containment: float) -> dict[tuple[int, int], tuple[float, np.ndarray]]:
    """Best share found of each (row, template), and the template's shingles found there."""
    best: dict[tuple[int, int], tuple[float, np.ndarray]] = {}
    if not len(hashes) or not found:
        return best
    # block layouts of every class, small to large: which smaller blocks begin a larger one
    owner = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    starts, block = np.arange(len(hashes)), 1
    layouts = []
    for c in found:
        steps = []
        while block < c.most // 2:
            row_first = np.searchsorted(owner, np.arange(len(rows) - 1))
            keep, owner = _halved(starts, owner, row_first)
            steps.append(keep)
            starts = starts[keep]
            block *= 2
        # a window is three blocks of a row; a single shingle is a window of its own
        joined = [np.flatnonzero(owner[k:] == owner[:-k]) for k in (1, 2) if c.most > 1]
        layouts.append((steps, starts, owner, joined))
    candidates: set[tuple[int, int, int]] = set()
    for b, salt in enumerate(odd_constants(max(c.bands for c in found), 31)):
        least = _value(hashes, salt)
        for k, (c, (steps, starts, owner, joined)) in enumerate(zip(found, layouts, strict=True)):
            for keep in steps:
                least = np.minimum.reduceat(least, keep)
            if b >= c.bands:
                continue
            window = least.copy()
            for step, at in enumerate(joined, 1):
                window[at] = np.minimum(window[at], least[at + step])
            hit = np.flatnonzero(c.filters[b][(window & np.uint64(0xFFFF)).astype(np.int64)])
            for m, v in zip(c.members, c.values[b], strict=True):
                for w in hit[window[hit] == v]:
                    candidates.add((k, int(w), m))
    for k, w, m in candidates:
        _, starts, owner, _ = layouts[k]
        row, wide = owner[w], found[k].most + found[k].most // 2
        lo, hi = max(starts[w] - wide, rows[row]), min(starts[w] + 2 * wide, rows[row + 1])
        there = np.isin(sets[m], hashes[lo:hi])
        share = float(there.mean())
        if share >= containment and share > best.get((int(row), m), (0.0, None))[0]:
            best[int(row), m] = share, sets[m][there]
    return best


def _named(best: dict[tuple[int, int], tuple[float, np.ndarray]], names: list[str]) -> dict[tuple[int, str], float]:
    """Best share of each (row, license), without those whose found shingles another license explains, by more of them or by a better match."""
    out: dict[tuple[int, str], float] = {}
    by_row: dict[int, list[tuple[int, float, np.ndarray]]] = {}
    for (row, m), (share, there) in best.items():
        by_row.setdefault(row, []).append((m, share, there))
    for row, found in by_row.items():
        for m, share, there in found:
            if not any(names[o] != names[m] and (len(t) > len(there) or s > share) and np.isin(there, t).all() for o, s, t in found):
                out[row, names[m]] = max(out.get((row, names[m]), 0.0), share)
    return out


def licenses(
    docs: DataFrame,
    known: list[tuple[str, str]] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    containment: float = CONTAINMENT,
    width: int = WIDTH,
) -> DataFrame:
    """(doc_id, license, containment) of each row and license found in it.

    ``known`` lists (license, template text); the built-in ones by default.  A
    license is found when ``containment`` or more of the distinct shingles of one
    of its templates stand close together in the text; the best share is given.
    Where all that was found of a template belongs to a longer or better match of
    another license (a neighbouring version's statement, say, or a text with one
    clause more), only that one is given.
    Templates of fewer than five words have no shingles and are never found, nor
    is anything in null, empty or shorter texts.  Rows with a null id are
    scanned; repeated rows are found each.  An empty table gives an empty result;
    other columns are not read.
    """
    named = known if known is not None else templates()
    texts = pa.array([t for _, t in named], pa.string())
    every, at = _shingles(texts, width)
    sets = [np.unique(every[at[i] : at[i + 1]]) for i in range(len(named))]
    found = classes(sets, containment) if named else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text", 1 << 20):
                best = _named(_matches(*_shingles(part.column("text"), width), found, sets, containment), [n for n, _ in named])
                keys = sorted(best)
                ids = part.column("doc_id").take(pa.array([r for r, _ in keys], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([n for _, n in keys], pa.string()), pa.array([best[k] for k in keys], pa.float64())], names=["doc_id", "license", "containment"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return mapped(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, f"doc_id {id_type}, license string, containment double")
