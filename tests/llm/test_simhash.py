"""Fingerprints, links and groups against brute force."""

import random
import re

import pytest
import xxhash

from toolsentry.llm import simhash
from toolsentry.llm.components import components


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(docs):
    prints = {i: plain_print(t) for i, t in docs}
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted((i, f"{prints[i]:016x}", find(i)) for i in prints)


def test_groups_equal_brute_force(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abÉdeÑ") for _ in range(rng.randint(1, 5)))
    docs = [(i, " ".join(word() for _ in range(rng.choice([1, 2, 3, 5, 1500])))) for i in range(30)]
    for i in range(40):
        parts = docs[rng.randrange(30)][1].split()
        parts[rng.randrange(len(parts))] = word()
        docs.append((100 + i, "\t ".join(parts).upper()))
    docs += [(200, None), (201, ""), (202, " \n"), (203, "one two"), (204, "ONE  TWO"), (-5, "one two")]
    frame = spark.createDataFrame([(t, i, "x") for i, t in docs], "text string, doc_id long, bits string").repartition(4)
    got = sorted(tuple(r) for r in simhash.simhash_groups(frame).collect())
    assert got == groups(docs)
    assert len({g for _, _, g in got}) < len(got) - 5


def test_every_pair_within_two_bits_agrees_under_a_mask():
    kept = [m % (1 << 64) for m in simhash.masks()]
    for i in range(64):
        for j in range(64):
            assert any(not m & (1 << i | 1 << j) for m in kept)


def test_links_equal_all_pairs(spark):
    rng = random.Random(9)
    prints = {rng.getrandbits(64) for _ in range(50)}
    for p in list(prints):
        for _ in range(6):
            prints.add(p ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(p,) for p in signed], "bits long")).collect()}
    near = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) % (1 << 64)).bit_count() <= 2}
    assert found <= near

    def closure(pairs):
        root = {p: p for p in signed}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            root[find(b)] = find(a)
        return {frozenset(q for q in signed if find(q) == find(p)) for p in signed}

    assert closure(found) == closure(near)


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (201, 200), (200, 201)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{100 + i: 100 for i in range(1, 30)}, 201: 200}


@pytest.mark.parametrize("rows", [[], [(None, "x y")]])
def test_no_documents(spark, rows):
    assert simhash.simhash_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect() == []
