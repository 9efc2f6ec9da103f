"""License scans, token counts and document fingerprints against brute force."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

from toolsentry.llm import license_scan as licences
from toolsentry.llm import minhash
from toolsentry.llm.license_scan import license_scan, scan
from toolsentry.llm.token_counts import attributed, token_counts
from toolsentry.llm.tokenizing import ids_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_scan(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, labels = [], set()
    for phrase, label in licences.BASE_PHRASES.items():
        parts = phrase.split()
        for i in range(len(words)):
            if words[i:i + len(parts)] == parts:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_base_columns_equal_brute_force(spark):
    rng = random.Random(1)
    bits = ["GNU", "general", "Public", "license", "APACHE", "License", "cc", "BY", "MIT", "É", "by ", ",", "-", "\n", "x", "cc-by", "\x00", "License,"]
    docs = [(i, "".join(rng.choice(bits) + rng.choice([" ", "", "  ", "\t"]) for _ in range(rng.randint(0, 80)))) for i in range(300)]
    docs += [(1000, None), (1001, ""), (1002, "gnu general public license apache license mit license cc by"), (1003, "MIT License " * 5000), (None, "mit license"), (1002, "cc by")]
    frame = spark.createDataFrame([(t, i, 1) for i, t in docs], "text string, doc_id long, n_words long").repartition(3)
    got = licences.license_scan(frame).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((i, *plain_scan(t))) for i, t in docs if i is not None)


@pytest.mark.parametrize(("line", "labels", "permissive"), [
    ("SPDX-License-Identifier: MIT", "mit", True),
    ("SPDX-License-Identifier: MIT OR GPL-3.0-only", "gpl,mit", True),
    ("SPDX-License-Identifier: MIT AND GPL-3.0-only", "gpl,mit", False),
    ("SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0+ WITH Classpath-exception-2.0", "apache,gpl,mit", False),
    ("SPDX-License-Identifier: GPL-2.0-only OR MIT AND BSD-3-Clause", "bsd,gpl,mit", True),
    ("SPDX-License-Identifier: MIT, as the file says", "mit", True),
    ("SPDX-License-Identifier: AND MIT", "", None),
    ("SPDX-License-Identifier: (MIT", "", None),
    ("SPDX-License-Identifier:", "", None),
    ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc", None),
    ("nothing", "", None),
])
def test_expressions(line, labels, permissive):
    row = licences.scan(f"first\n{line}\nlast".encode())
    assert row[5] == labels and row[8] is permissive and (row[6] > 0) == bool(labels) and 0 <= row[6] <= 1


def test_yard_orders_by_precedence():
    assert licences.postfix("a or b and c with d".split()) == "a b c d with and or".split()
    assert licences.postfix("( a or b ) and c".split()) == "a b or c and".split()
    assert licences.postfix([]) is None and licences.postfix(["(", ")"]) is None


def plain_counts(fields, rule):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    data = "\n".join(f or "" for f in fields).encode()
    owner, sections = [], []
    for number, field in enumerate(fields):
        lines = (field or "").encode().split(b"\n")
        lines = [x + b"\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] or len(lines) == 1 else [])
        for section, line in enumerate(lines):
            owner += [len(sections)] * len(line)
            sections.append((number, section))
        if number + 1 < len(fields):
            owner.append(len(sections) - 1)
    counts, at = np.zeros(len(sections)), 0
    vocabulary = {i: t for t, i in tokenizer.get_vocab().items()}
    for i in tokenizer.encode(data.decode(), add_special_tokens=False).ids:
        size = len(vocabulary[i])  # one printable character stands for each byte
        held = np.bincount(owner[at:at + size], minlength=len(sections))
        if rule == "first":
            counts[owner[at]] += 1
        elif rule == "most":
            counts[int(np.argmax(held))] += 1
        else:
            counts += held / size
        at += size
    return {(f, s): round(float(c), 9) for (f, s), c in zip(sections, counts)}


@pytest.mark.parametrize("rule", ["first", "most", "split"])
def test_counts_equal_brute_force(spark, rule):
    rng = random.Random(4)
    bits = ["word ", "é", "\n", "\n\n", " ", "漢字", "!!\n", "12", "the end", "🙂", "  \n "]
    made = lambda: "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))
    docs = [(i, rng.choice([None, "", made()]), made()) for i in range(60)] + [(90, None, None), (91, "", ""), (92, "a\n", "\n"), (93, "x", "line\n" * 3000)]
    frame = spark.createDataFrame([*docs, (None, "a", "b")], "doc_id long, title string, text string").repartition(3)
    got = token_counts(frame, ("title", "text"), rule).collect()
    for doc_id, *fields in docs:
        own = {(("title", "text").index(r.field), r.section): round(r.n_tokens, 9) for r in got if r.doc_id == doc_id}
        assert own == plain_counts(fields, rule), (doc_id, fields)
    rows = {(r.doc_id, r.field, r.section): (r.start_char, r.end_char) for r in got}
    for doc_id, *fields in docs:
        for name, text in zip(("title", "text"), fields):
            own = sorted((s, *span) for (i, f, s), span in rows.items() if (i, f) == (doc_id, name))
            assert "".join((text or "")[a:b] for _, a, b in own) == (text or "")
            assert [s for s, *_ in own] == list(range(len(own)))


def test_crossing_tokens():
    starts, sizes = np.array([0, 2, 5]), np.array([2, 3, 1])
    for rule, want in (("first", [2, 1]), ("most", [1, 2]), ("split", [4 / 3, 5 / 3])):
        counts, crossing = attributed(starts, sizes, np.array([0, 3]), rule)
        assert np.allclose(counts, want) and crossing.tolist() == [1, 1]


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def resemblance(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("parts", [1, 4])
def test_fingerprints_follow_resemblance(spark, parts):
    rng = random.Random(6)
    names = [f"w{i}é" for i in range(400)]
    body = lambda n: " ".join(rng.choice(names) for _ in range(n))
    docs = {i * 3: body(rng.choice([3, 40, 300, 900])) for i in range(70)}
    docs |= {500: "", 501: None, 502: " \n", 503: "one", 504: "one", 505: docs[3], -4: "a b c"}
    frame = spark.createDataFrame([(t, i, 1) for i, t in [*docs.items(), (None, "zzz")]], "text string, doc_id long, part long").repartition(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {r.doc_id: r for r in minhash.document_fingerprints(frame).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    order = sorted(docs)
    texts = [docs[i] or "" for i in order]
    errors = []
    for i, text, following in zip(order, texts, [*texts[1:], texts[0]]):
        changed = minhash.edited(text, following)
        row = got[i]
        assert row.n_chars == len(text) and row.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        errors += [row.near_edited - resemblance(text, changed), row.near_next - resemblance(text, following)]
        if text == following:
            assert row.near_next == 1
    assert len(got) == len(docs) and max(map(abs, errors)) < 0.15 and abs(np.mean(errors)) < 0.02
    assert got[505].fingerprint == got[3].fingerprint and got[500].fingerprint == got[501].fingerprint == ""


def test_repeated_rows_and_empty_tables(spark):
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "c")] * 2, "doc_id long, text string")
    assert minhash.document_fingerprints(twice).count() == 6
    none = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.document_fingerprints(none).collect() == [] and licences.license_scan(none).collect() == [] and token_counts(none).collect() == []


@pytest.mark.parametrize(("text", "labels", "expressions", "permissive"), [
    ("/* spdx-license-identifier: mit */ x; /* spdx-license-identifier: gpl-3.0-only */", "gpl,mit", "mit; gpl-3.0-only", False),
    ("SPDX-License-Identifier: MIT SPDX-License-Identifier: Apache-2.0 OR ISC x\nSPDX-License-Identifier: 0BSD", "0bsd,apache,isc,mit", "mit; apache-2.0 isc or; 0bsd", True),
    ("License-Expression: AND License-Expression: (MIT) ", "mit", "mit", True),
    ("SPDX-License-Identifier: MIT AND SPDX-License-Identifier: MIT", "mit", "mit", True),
])
def test_every_tag_of_a_line_is_read(text, labels, expressions, permissive):
    row = licences.scan(text.encode())
    assert (row[5], row[7], row[8]) == (labels, expressions, permissive)


@pytest.mark.parametrize("run", [" " * 1_000_000, "\n" * 1_000_000, "a" * 200_000, " \n\t" * 300_000, " " * 400_000])
def test_very_long_runs_have_the_librarys_ids(run):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    text = f"x{run}y <|endoftext|> z"
    assert ids_of(text, special=True).tolist() == library.encode(text, add_special_tokens=False).ids


def test_tags_need_a_separator_and_operands_a_letter_or_digit(spark):
    texts = [
        "The license expression is a short line", "SPDX license identifier must be present", "license expression ... mit license",
        "SPDX-License-Identifier:: MIT", "license-expression = \"Apache-2.0 or ...\"", "spdx-license-identifier: ... and mit", "SPDX-License-Identifier: :.: (MIT)",
    ]
    got = {r.doc_id: (r.labels, r.expressions) for r in license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: ("", ""), 1: ("", ""), 2: ("mit", ""), 3: ("mit", "mit"), 4: ("", ""), 5: ("", ""), 6: ("mit", "mit")}


@given(st.lists(st.sampled_from(["SPDX-License-Identifier", "license expression", ":", "::", ".", "-", "+", " ", "mit", "MIT License", "or", "and", "(", ")", "\n", "="]), max_size=14))
def test_no_label_is_ever_empty(parts):
    labels = scan("".join(parts).encode())[5]
    assert labels == "" or all(re.search("[a-z0-9]", label) for label in labels.split(","))
