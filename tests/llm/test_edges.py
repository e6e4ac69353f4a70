"""Crowded groups, shared ids, repeated rows, clashing columns, very long texts, ties and empty tables."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from test_dedup import Union, covered, shingles

import corpus_pipeline
from gaugeworks.llm import decontaminate, embed_dedup, langid, near_dedup, packing, suffix_dedup, toxicity


def test_crowds_count_every_link(spark):
    """Groups of near copies of several spreads, some wholly within a ball, some on the threshold."""
    rng = np.random.default_rng(5)
    rows, labels = [], []
    for g, (n, spread) in enumerate([(150, 0.08), (120, 0.16), (90, 0.21), (60, 0.26), (60, 0.3), (200, 0.0)]):
        centre = rng.normal(size=64)
        centre /= np.linalg.norm(centre)
        noise = rng.normal(size=(n, 64)) / 8
        rows += list((centre + spread * noise) * rng.uniform(0.1, 9, size=(n, 1)))
        labels += [g % 2] * n
    rows += list(rng.normal(size=(300, 64)))
    labels += [k % 2 for k in range(300)]
    x = np.float32(rows)
    table = [(k, [float(v) for v in x[k]], labels[k], "c", 0.5) for k in range(len(x))]
    got = {r.vec_id: r for r in embed_dedup.near_vectors(spark.createDataFrame(table, "vec_id long, embedding array<float>, label int, entry string, size double")).collect()}
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = (u @ u.T >= 0.93) & np.equal.outer(labels, labels) & ~np.eye(len(u), dtype=bool)
    groups = Union(range(len(u)))
    for a, b in zip(*np.nonzero(np.triu(near)), strict=True):
        groups.join(int(a), int(b))
    found, wanted = sum(r.n_links for r in got.values()), int(near.sum())
    assert 0.999 * wanted <= found <= wanted and all(got[k].n_links <= near[k].sum() for k in got)
    assert {k: r.component_id for k, r in got.items()} == {k: groups.find(k) for k in got}


def test_recall_just_above_the_threshold(spark):
    rng = np.random.default_rng(9)
    a = rng.normal(size=(1500, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    off = rng.normal(size=a.shape)
    off -= (off * a).sum(axis=1, keepdims=True) * a
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    c = rng.uniform(0.9302, 0.94, size=(len(a), 1))
    rows = np.concatenate([a, c * a + np.sqrt(1 - c * c) * off])
    table = [(k, v.tolist(), 1) for k, v in enumerate(rows)]
    got = embed_dedup.near_vectors(spark.createDataFrame(table, "vec_id long, embedding array<double>, label int"))
    assert got.where("n_links = 1").count() >= 0.998 * len(rows)


def test_repeated_rows_repeat_no_passage(spark):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(900)]

    def some(n):
        return " ".join(rng.choices(words, k=n))

    texts = []
    for k in range(12):
        shared = some(48)
        texts += [(2 * k, f"{some(40)} {shared} {some(30)}"), (2 * k + 1, f"{some(20)} {shared} {some(50)}")]
    docs = spark.createDataFrame(texts + texts[::2], "doc_id long, text string")
    assert suffix_dedup.repeated_spans(docs).count() == 0
    passage = some(55)
    more = [(100, f"b {passage} {some(9)}"), (100, f"a {some(70)}"), (101, f"{passage} x"), (101, f"{passage} x"), (102, "y " * 20_000 + passage + " z" * 300)]
    docs = spark.createDataFrame(texts + more, "doc_id long, text string")
    _, seen, gone, _ = covered([*texts, more[1], more[2], more[4]])  # of rows that share an id the least text counts
    got_seen, got_gone = {}, {}
    for r in suffix_dedup.repeated_spans(docs).collect():
        got_seen.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
        if r.removed:
            got_gone.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    assert (got_seen, got_gone) == (seen, gone)


def test_rows_that_share_an_id_are_one_document(spark):
    t, u = " ".join(f"t{k}" for k in range(60)), " ".join(f"u{k}" for k in range(60))
    rows = [(1, t), (1, u), (2, t + " a"), (3, u + " b"), (4, "z " * 30_000), (5, "z " * 30_000 + "y"), (5, "z " * 30_000 + "y")]
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {}
    for r in out:
        got.setdefault(r.doc_id, set()).add((r.n_shingles, r.component_id, r.kept))
    assert len(out) == len(rows) and all(len(v) == 1 for v in got.values())
    parents = {i: next(iter(v))[1] for i, v in got.items()}
    assert sorted(parents[k] for k in (1, 2, 3)) in ([1, 1, 2], [1, 1, 3]) and parents[1] == 1  # doc 1 has one of its texts
    assert len(shingles("z " * 30_000)) == 1


def test_a_footer_that_many_added_hides_no_link(spark):
    rng = random.Random(12)
    words = [f"w{k}" for k in range(5000)]
    base, footer = rng.choices(words, k=120), rng.choices(words, k=40)
    texts = []
    for k in range(60):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = rng.choice(words)
        texts.append((k, " ".join(w + (footer if k % 2 else []) + rng.choices(words, k=rng.randrange(6)))))
    sets = {i: shingles(t) for i, t in texts}
    groups = Union(sets)
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                groups.join(a, b)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == {i: groups.find(i) for i in sets}


def test_rounds_go_on_while_items_fit(spark):
    rng = np.random.default_rng(3)
    docs = [(int(i % 50), "a " * int(n)) for i, n in enumerate(rng.integers(900, 3600, 900))]
    docs += [(7, "a " * 1500)] * 300 + [(8, "b " * 9_000), (None, "c"), (9, None), (9, "")]
    frame = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, number string")
    few = packing.packed(frame, items=150).toPandas()
    one = packing.packed(frame).toPandas()
    for got in (few, one):
        assert len(got) == sum(-(-(len((t or "").split()) + 1) // 4096) for _, t in docs)
        for _, s in got.groupby("sequence_id"):
            s = s.sort_values("offset")
            assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= 4096
    sizes = np.sort(few.groupby("sequence_id").length.sum().to_numpy())
    assert sizes[0] + sizes[1] > 4096 - packing.SLACK  # no two sequences fit together
    assert abs(few.sequence_id.nunique() - one.sequence_id.nunique()) <= 0.03 * len(sizes)


def test_letters_are_of_category_l(spark):
    docs = [(k, "the cat and the dog and the house", "en") for k in range(40)] + [(50, "½ ²", None), (51, "日本", None), (52, "Ⅳ 12", None), (53, "ª", None)]
    df = spark.createDataFrame([(i, t, g, 1.0) for i, t, g in docs], "doc_id long, text string, lang string, score double")
    got = {r.doc_id: r.lang_pred for r in langid.languages(df).collect()}
    assert got[50] == got[52] == "und" and got[1] == "en"


def test_every_language_is_learned(spark):
    docs = [(k, " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26 % 12)}" for _ in range(9)), f"l{k % 300:03d}") for k in range(900)]
    net = langid.train(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    assert net.languages == sorted({g for k, _, g in docs if zlib.crc32(str(k).encode()) % 5}) and len(net.languages) > 290


def test_prediction_is_the_plain_forward_pass(spark):
    """Whole query against embedding, convolution, maximum and softmax written out window by window."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    net = langid.train(docs)
    got = {r.doc_id: r for r in langid.languages(docs).collect()}
    for r in docs.orderBy("doc_id").limit(25).collect():
        raw, total = (r.text or "").encode(), np.zeros(len(net.languages))
        for at in range(0, len(raw), langid.WINDOW):
            piece = raw[at : at + langid.WINDOW]
            e = net.embed[np.frombuffer(piece.ljust(langid.WINDOW), dtype=np.uint8)]
            top = [(np.stack([e[k : k + w].ravel() for k in range(langid.WINDOW - w + 1)]) @ f).max(axis=0) for w, f in zip(langid.WIDTHS, net.filters, strict=True)]
            z = np.maximum(np.concatenate(top) + net.bias, 0) @ net.out + net.out_bias
            p = np.exp(z - z.max())
            total += p / p.sum() * len(piece)
        own = got[r.doc_id]
        assert own.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        if own.lang_pred != "und" or any(c.isalpha() for c in r.text or ""):
            assert own.lang_pred == net.languages[int(total.argmax())] and abs(own.score - total.max() / max(len(raw), 1)) < 1e-3


def plain_odds(texts, labels):
    """Log odds of words by hand, from sets of words."""
    n = [sum(y == k for y in labels) for k in (0, 1)]
    out = {}
    for w in {w for t in texts for w in t.lower().split()}:
        c, t = (sum(w in x.lower().split() for x, y in zip(texts, labels, strict=True) if y == k) for k in (0, 1))
        out[w] = (t, np.log((t + 0.1) / max(n[1] - t + 0.9, 0.1)) - np.log((c + 0.5) / max(n[0] - c + 0.5, 0.1)))
    return out


def test_lexicon_counts_documents_once(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choices(["alpha", "beta", "gamma", "delta"], k=6) + (["vile"] * 3 if k % 3 == 0 else [])) for k in range(90)]
    labels = [int(k % 3 == 0) for k in range(90)]
    docs = spark.createDataFrame([(k, t, 9) for k, t in enumerate(texts)] * 4, "doc_id long, text string, toxic int")
    marks = spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int")
    model = toxicity.train(docs, marks)
    learned = [k for k in range(90) if zlib.crc32(str(k).encode()) % 4 != 2]
    want = plain_odds([texts[k] for k in learned], [labels[k] for k in learned])
    key = toxicity._hashes(["vile"])[0]
    assert np.isclose(model.lexicon.odds[0][model.lexicon.keys.tolist().index(key)], want["vile"][1])
    assert toxicity.toxicity(docs, marks).count() == 360


def test_trees_are_the_plain_walk():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(int)
    held = rng.random(600) < 0.25
    from gaugeworks.llm import trees

    model = trees.fit(x, y, held)
    for i in range(0, 600, 37):
        total = model.start
        for feature, value, leaf in model.trees:
            node = 0
            while feature[node] >= 0:
                node = 2 * node + (2 if x[i, feature[node]] > value[node] else 1)
            total += leaf[node]
        assert np.isclose(total, model.raw(x[i : i + 1])[0])
    assert ((model.score(x) >= 0.5) == y).mean() > 0.95


def test_features_by_hand():
    import pyarrow as pa

    none = toxicity.Lexicon(np.zeros(0, np.uint64), np.zeros((3, 0)))
    texts = ["You are an IDIOT!!", "", None, "id1ot and f*ck, you", "calm words"]
    f = toxicity.features(pa.array(texts), none, np.zeros(5, dtype=np.int64))
    assert np.allclose(f[0, [0, 1, 8, 9]], [1 / 4, np.log(2), 1 / 4, 1 / 4])
    assert np.isclose(f[0, 10], 6 / 13) and np.isclose(f[0, 11], 2 / 18) and np.isclose(f[0, 12], 2 / 18)
    assert f[3, 13] > 0 and f[3, 14] == 1 and f[4, :9].sum() == 0 and np.isfinite(f).all()


@pytest.mark.parametrize("name", ["language_id", "near_duplicates", "suffix_array", "decontamination", "best_fit"])
def test_stages_of_empty_tables_and_further_columns(spark, name):
    schema = "doc_id long, text string, lang string, source string, n_chars long, places string, component_id long, sequence_id string"
    stage = dict(corpus_pipeline.STAGES)[name]
    none = spark.createDataFrame([], schema)
    out = stage(spark, none, "/root/testdata/sf0.001")
    assert out.count() == 0 and (name == "best_fit" or out.columns == none.columns)
    rows = [(1, "the house and the dog " * 30, "en", "a", 1, "p", 7, "s"), (None, "words of no document", "en", None, None, None, None, None), (2, None, None, None, 0, None, None, None)]
    out = stage(spark, spark.createDataFrame(rows, schema), "/root/testdata/sf0.001")
    assert out.count() >= 1 and (name == "best_fit" or out.columns == none.columns)


def test_a_text_in_two_rows_is_one_document(spark):
    """Neither row is as large as the item's class asks, both together hold it."""
    item = [f"w{k}" for k in range(24)]
    parts = [(1, " ".join(item[:14])), (1, " ".join(item[10:])), (2, " ".join(item)), (3, " ".join(item[:14])), (4, " ".join(item[:14])), (4, None), (None, " ".join(item))]
    docs, items = spark.createDataFrame(parts, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    got = {tuple(r)[:4] for r in decontaminate.contaminated(docs, items).collect()}
    assert got == {(1, 7, 20, 20), (2, 7, 20, 20)}
    assert got == {tuple(r)[:4] for r in decontaminate.contaminated(docs.where("doc_id < 3"), items).collect()}


def test_every_text_with_a_letter_gets_a_learned_language(spark):
    """Only the pipeline refuses texts in no learned language."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    odd = [(10**6, "Съешь же ещё этих мягких французских булок, да выпей чаю"), (10**6 + 1, "zxqj vkwp qqzx jjkv xzqw pvkj " * 9), (10**6 + 2, "x"), (10**6 + 3, "12 34 !"), (10**6 + 4, None)]
    every = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string").selectExpr("*", "cast(null as string) as lang"))
    learned = {r.lang for r in docs.collect() if r.lang}
    got = {r.doc_id: r for r in langid.languages(every).collect()}
    assert all(got[10**6 + k].lang_pred in learned and 0 < got[10**6 + k].score <= 1 for k in range(3))
    assert got[10**6 + 3].lang_pred == got[10**6 + 4].lang_pred == "und" and got[10**6 + 3].score == 0
    refused = {r.doc_id: r.lang_pred for r in langid.identified(every, langid.train(every), refuse=True).collect()}
    assert refused[10**6] == refused[10**6 + 1] == "und"
