"""Leaks against brute force and planted cases."""

import random

import numpy as np
import pyarrow as pa

from toolsentry.llm import decontaminate as dec


def made(rng, n, names):
    return " ".join(rng.choice(names) for _ in range(n))


def corpus():
    rng = random.Random(12)
    common = ["the", "of", "and", "la", "é", "in", "to"]
    rare = ["".join(rng.choice(["th", "er", "on", "ñe", "ing", "est"]) for _ in range(rng.randint(2, 5))) for _ in range(4000)]
    names = common * 300 + rare
    items = [(i, made(rng, rng.randint(12, 60), names) + ".\n" + made(rng, 5, names)) for i in range(60)]
    docs, leaked = [], set()
    for i in range(400):
        words = made(rng, rng.choice([5, 40, 300, 1500]), names).split()
        if i % 5 == 0:
            item = rng.choice(items)
            parts = item[1].upper().split() if i % 10 else item[1].split()
            if i % 15 == 0:  # a paraphrase: one word in eight changed, one left out
                parts = [rng.choice(names) if j % 8 == 3 else w for j, w in enumerate(parts)][1:]
            at = rng.randint(0, len(words))
            words[at:at] = parts
            leaked.add((i, item[0]))
        docs.append((i, " ".join(words)))
    return docs, items, leaked


def test_planted_leaks_are_found_and_others_are_not(spark):
    docs, items, leaked = corpus()
    frame = spark.createDataFrame([(t, i, "x") for i, t in [*docs, (900, None), (901, ""), (None, items[0][1])]], "text string, doc_id long, item_id string").repartition(4)
    asked = spark.createDataFrame([*items, (800, None), (801, " .. "), (None, "of the")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in dec.leaks(frame, asked).collect()}
    assert len(got & leaked) >= 0.98 * len(leaked) and not got - leaked
    kept = [r.doc_id for r in dec.decontaminated(frame, asked).collect()]
    assert sorted(map(str, kept)) == sorted(str(i) for i in [*(i for i, _ in docs), 900, 901, None] if i not in {d for d, _ in got})


def test_candidates_recall_against_all_windows(spark):
    """Of all pairs that an exact cosine of whole windows finds, the latent one finds nine in ten or more."""
    docs, items, _ = corpus()
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    asked = spark.createDataFrame(items, "item_id long, text string")
    weight = dec.weights(frame)
    space = dec.latent_space(asked, weight)
    rows = asked.collect()
    _, directions = dec.prepared(rows, space)
    texts = pa.array([t for _, t in docs], pa.large_string())
    hashes, places = dec.hashed_words(texts)
    found, want = set(), set()
    for text, first, size, latent in dec.windows(hashes, places, space, dec.weighted_axes(space), dec.COSINE):
        found |= {(int(first[a]), int(size[a]), int(i)) for a, i in np.argwhere(latent @ directions.T >= dec.COSINE)}
    row, bucket, value = dec.vectors(pa.array([r.text for r in rows], pa.large_string()), weight)
    dense = np.zeros((len(rows), dec.FEATURES), np.float32)
    dense[row, bucket] = value
    for t in range(len(docs)):
        for scale in dec.SCALES:
            for s in range(0, places[t + 1] - places[t], 8 * max(1, scale // 2)):
                e = min(s + 8 * scale, places[t + 1] - places[t])
                own, tf = np.unique(dec.bucket_of(hashes[places[t] + s:places[t] + e]), return_counts=True)
                x = tf * weight[own]
                for i in np.flatnonzero(dense[:, own] @ x >= dec.COSINE * np.linalg.norm(x)):
                    want.add((t, int(i)))
    starts = np.searchsorted(places, [f for f, _, _ in found], "right") - 1
    got = set(zip(starts.tolist(), (i for _, _, i in found)))
    assert len(want & got) >= 0.9 * len(want) and len(want) > 60


def test_common_subsequence():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.randrange(4) for _ in range(rng.randint(0, 12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert dec.common(a, b) == table[-1][-1]


def test_singular_vectors_equal_dense_ones(spark):
    _, items, _ = corpus()
    asked = spark.createDataFrame(items, "item_id long, text string").repartition(3)
    weight = np.linspace(1, 2, dec.FEATURES)
    space = dec.latent_space(asked, weight, rank=20)
    row, bucket, value = dec.vectors(pa.array([t for _, t in items], pa.large_string()), weight)
    dense = np.zeros((len(items), dec.FEATURES))
    dense[row, bucket] = value
    want = np.linalg.svd(dense[:, space.buckets], compute_uv=False)[:20]
    got = np.sort(np.linalg.norm(dense[:, space.buckets] @ space.axes, axis=0))[::-1]
    assert np.allclose(got, want, rtol=0.02)


def test_empty_tables(spark):
    docs, items = "doc_id long, text string", "item_id long, text string"
    some = spark.createDataFrame([(1, "a b c")], docs)
    assert dec.leaks(some, spark.createDataFrame([], items)).collect() == []
    assert dec.leaks(spark.createDataFrame([], docs), spark.createDataFrame([(1, "a b c")], items)).collect() == []


def spans(texts):
    hashes, places = dec.hashed_words(pa.array(texts, pa.large_string()))
    every = np.unique(dec.bucket_of(hashes))
    space = dec.Space(np.ones(dec.FEATURES), every, np.ones((len(every), 1), np.float32))
    found = {t: set() for t in range(len(texts))}
    for text, first, size, _ in dec.windows(hashes, places, space, dec.weighted_axes(space), dec.COSINE):
        for t, a, n in zip(text.tolist(), first.tolist(), size.tolist()):
            found[t].add((a - int(places[t]), n))
    return [found[t] for t in range(len(texts))]


def test_windows_do_not_depend_on_neighbours():
    """Every word of every text is in a window, and a text alone has the windows it has among others."""
    texts = [" ".join(f"w{t}x{i}" for i in range(n)) for t, n in enumerate([40, 8, 16, 7, 0, 1, 100, 9])]
    together = spans(texts)
    for text, found in zip(texts, together):
        n = len(text.split())
        assert {w for a, size in found for w in range(a, a + size)} == set(range(n))
        assert found == (spans([text])[0] if n else set())
        assert not n or any(a + size == n and size >= min(n, 57) for a, size in found)


def test_every_item_of_a_large_benchmark_keeps_its_energy(spark):
    """Verbatim copies of thousands of items are found, all of them."""
    rng = random.Random(5)
    names = [f"w{i}" for i in range(30000)]
    items = [(i, made(rng, rng.randint(16, 59), names)) for i in range(3000)]
    docs = [(i, " ".join([made(rng, rng.randint(0, 90), names), items[i * 7][1], made(rng, rng.randint(0, 90), names)])) for i in range(400)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    asked = spark.createDataFrame(items, "item_id long, text string")
    rows = asked.limit(600).collect()
    weight = dec.weights(frame)
    for first in range(0, len(rows), dec.RANK):
        some = rows[first:first + dec.RANK]
        space = dec.latent_space(spark.createDataFrame(some), weight)
        row, bucket, value = dec.vectors(pa.array([r.text for r in some], pa.large_string()), weight)
        kept = np.zeros((len(some), space.axes.shape[1]))
        np.add.at(kept, row, space.axes[np.searchsorted(space.buckets, bucket)] * value[:, None])
        assert (np.linalg.norm(kept, axis=1) >= 0.95).all()
    assert {(r.doc_id, r.item_id) for r in dec.leaks(frame, asked).collect()} >= {(i, i * 7) for i in range(400)}


def test_items_of_every_length_are_found(spark):
    """Verbatim copies, from three words to many passages, each beside texts and at places of its own."""
    rng = random.Random(9)
    names = [f"w{i}é" for i in range(20000)]
    sizes = [3, 4, 5, 7, 8, 9, 12, 16, 17, 31, 33, 64, 65, 100, 129, 530, 700, 1500]
    items = [(i, made(rng, n, names)) for i, n in enumerate(sizes)]
    docs = [(i * 10 + k, " ".join([made(rng, rng.randint(0, 70), names), text, made(rng, rng.randint(0, 70), names)])) for i, text in items for k in range(8)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in dec.leaks(frame, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(i * 10 + k, i) for i, _ in items for k in range(8)}


def test_recall_against_windows_at_every_word_and_length(spark):
    """Of all pairs that an exact cosine and the common subsequence of any window confirm, at every word and from half to twice
    the item's length, 95 in 100 or more are found."""
    rng = random.Random(21)
    names = ["the", "of", "and", "la", "é", "in", "to"] * 60 + [f"r{i}" for i in range(1500)]
    items = [(i, made(rng, rng.choice([4, 6, 10, 14, 20, 30, 45]), names) + ".\n" + made(rng, 4, names)) for i in range(50)]
    docs = []
    for i in range(120):
        parts = [rng.choice(names) if rng.random() < (i % 4) / 10 else w for w in rng.choice(items)[1].split()]
        docs.append((i, " ".join([made(rng, rng.randint(0, 50), names), *parts, made(rng, rng.randint(0, 50), names)])))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    asked = spark.createDataFrame(items, "item_id long, text string")
    weight = dec.weights(frame)
    rows = asked.collect()
    own = dec.items_of(rows)
    row, bucket, value = dec.vectors(pa.array([r.text for r in rows], pa.large_string()), weight)
    dense = np.zeros((len(rows), dec.FEATURES), np.float32)
    dense[row, bucket] = value
    hashes, places = dec.hashed_words(pa.array([t for _, t in docs], pa.large_string()))
    want = set()
    for t in range(len(docs)):
        text = hashes[places[t]:places[t + 1]]
        at = dec.bucket_of(text)
        products = np.concatenate([np.zeros((1, len(rows))), np.cumsum((dense[:, at] * weight[at]).T, axis=0)])
        for a in range(len(text)):
            tf, energy = {}, 0.0
            for b in range(a + 1, min(len(text), a + 100) + 1):
                n = tf.get(at[b - 1], 0)
                tf[at[b - 1]] = n + 1
                energy += (2 * n + 1) * weight[at[b - 1]] ** 2
                for i in np.flatnonzero(products[b] - products[a] >= dec.COSINE * energy**0.5):
                    size = len(own[i].words)
                    if (t, i) not in want and size <= 2 * (b - a) <= 4 * size:
                        near = text[a:b].tolist()
                        if dec.common(own[i].words, near) >= dec.LCS_SHARE * size and dec.common(own[i].answer, near) >= dec.ANSWER_SHARE * len(own[i].answer):
                            want.add((t, int(i)))
    got = {(r.doc_id, r.item_id) for r in dec.leaks(frame, asked).collect()}
    print(len(want), len(want & got), len(got - want), sorted(want - got)[:20])
    assert len(want & got) >= 0.95 * len(want) and len(want) > 90


def test_long_clean_documents_on_an_item_s_topic_stay(spark):
    """Half of a long document's words are an item's, in any order: no stretch of it is a copy, however long it is."""
    rng = random.Random(17)
    names = [f"w{i}" for i in range(20000)]
    items = [(i, made(rng, n, names) + ".\n" + made(rng, 5, names)) for i, n in enumerate([25, 30, 40, 55, 90])]
    docs = []
    for i, text in items:
        own = text.replace(".", "").split()
        docs += [(i * 2, " ".join(rng.choice(own) if rng.random() < 0.5 else rng.choice(names) for _ in range(6000)))]
        docs += [(i * 2 + 1, docs[-1][1] + " " + text + " " + made(rng, 40, names))]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = dec.leaks(frame, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(i * 2 + 1, i) for i, _ in items}
    for r in got:
        size = len(items[r.item_id][1].split())
        assert r.n_words <= dec.SPAN * size and r.first_word <= 6000 + size and r.first_word + r.n_words >= 6000
        assert r.lcs_share >= 0.7


def test_spans_that_cannot_hold_enough_are_not_compared(monkeypatch):
    """Spans with many words of an item, but the same ones again and again, need no common subsequence."""
    asked = dec.Item(1, list(range(10, 30)), [28, 29])
    compared = []
    common = dec.common
    monkeypatch.setattr(dec, "common", lambda a, b: compared.append(a) or common(a, b))
    again = np.array([10, 11, 12, 13] * 50, np.uint64)
    assert list(dec.confirmed(asked, again, 0.6, 0.5)) == [] and not compared
    # 12 of 20 words are just enough, in a span that begins at the first of them
    enough = np.array([*range(10, 20), 28, 29, *[7] * 28], np.uint64)
    assert next(dec.confirmed(asked, enough, 0.6, 0.5)) == (0.6, 1.0, 0, 40) and compared
