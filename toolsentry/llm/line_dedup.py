"""Line deduplication by an exact set-similarity join, in DataFrame functions only.

A line's tokens are its five-word shingles (a shorter line is one token). Tokens are put in one order, rare ones
first: rarity is counted in a fixed number of hash buckets over all lines, and in classes. Two token sets with a Jaccard similarity of 4/5 or
more share a token among the first ``n - ceil(4n/5) + 1`` of each (prefix filter), have similar sizes (length filter), and
the places of the shared token leave room for enough other ones (positional filter). What passes is verified on all tokens.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from toolsentry.llm.tables import landed, text_key, texts

SHINGLE = 5
BUCKETS = 1 << 16
WIDEST = (1 << 16) - 1
#: Sets that share a token are listed pair by pair up to so many; each set then has that many pairs at most for a token.
FEW = 32
#: Sets of fewer tokens are similar enough only if they are equal.
LEAST_TOKENS = 4


def _tokens(line: str) -> Column:
    """Hashes of a line's distinct shingles; empty for a line without words. Words are bound to a name once:
    plans that move or repeat the expression don't split the line again for every shingle."""
    # single blanks are split without a pattern, which is most of the time of a line; what else is white space is looked for by its bytes
    held = [F.contains(F.col(line), F.lit(c)) for c in ("\t", "\x0b", "\f", "\r", "  ")]
    odd = reduce(Column.__or__, held) | F.startswith(F.col(line), F.lit(" ")) | F.endswith(F.col(line), F.lit(" "))
    words = F.when(odd, F.filter(F.split(F.col(line), r"\s+"), lambda w: w != "")).otherwise(F.split(F.col(line), " "))

    def of_words(w: Column) -> Column:
        # the last words begin no shingle; what is hashed for them is sliced off
        begun = F.transform(w, lambda word, i: F.xxhash64(word, *[F.get(w, i + j) for j in range(1, SHINGLE)]))
        each = F.slice(begun, F.lit(1), F.size(w) - (SHINGLE - 1))
        short = F.when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))
        return F.array_distinct(F.when(F.size(w) < SHINGLE, short).otherwise(each))

    return F.get(F.transform(F.array(words), of_words), F.lit(0))


def _bucket(token: Column) -> Column:
    return token.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def tokenized(keyed: DataFrame) -> DataFrame:
    """``(doc_id, key, line_no, tokens)`` of every line that has words; lines are numbered from 0."""
    # the outer form: a filter that the plan would infer for the inner one splits every text twice
    lines = keyed.select("doc_id", "key", F.posexplode_outer(F.split("text", "\n")).alias("line_no", "line"))
    return lines.filter(F.rlike("line", F.lit(r"\S"))).select("doc_id", "key", "line_no", _tokens("line").alias("tokens"))


def rarity(lines: DataFrame) -> Column:
    """How frequent the tokens of each bucket are among all lines, in 16 classes of the logarithm against the mean.

    A table of ``BUCKETS`` classes: its size is fixed, so it is part of the plan.
    """
    counts = lines.select(F.explode_outer("tokens").alias("t")).groupBy(_bucket(F.col("t")).alias("bucket")).agg(F.count("*").alias("n"))
    counts = landed(counts, "rarity")
    mean = counts.agg(F.sum("n")).first()[0]
    level = F.least(F.lit(15), F.greatest(F.lit(0), F.floor(F.log2(F.col("n") * BUCKETS / F.lit(float(mean or 1)))) + 1))
    table = ["0"] * BUCKETS
    for row in counts.select("bucket", level.cast("int").alias("level")).filter("level > 0").collect():
        table[row["bucket"]] = str(row["level"])
    # spelled as one string: the optimizer makes one array of it, and the plan has no expression for each bucket
    return F.split(F.lit(",".join(table)), ",").cast("array<bigint>")


def ordered_sets(lines: DataFrame) -> DataFrame:
    """``(doc_id, line_no, key, signature, n, prefix)``: each line's set by its signature, size and first tokens."""
    levels = rarity(lines)
    rank = F.transform("tokens", lambda t: F.shiftleft(F.get(levels, _bucket(t)), 58).bitwiseOR(F.shiftrightunsigned(t, 6)))
    ranked = lines.select("doc_id", "line_no", "key", F.sort_array(rank).alias("ranked"))
    n = F.size("ranked")
    first = F.slice("ranked", F.lit(1), n - F.floor((4 * n + 4) / 5).cast("int") + 1)
    prefix = F.when(n >= LEAST_TOKENS, F.transform(first, lambda t: F.hash(t)))
    return ranked.select("doc_id", "line_no", "key", F.xxhash64("ranked", n).alias("signature"), n.alias("n"), prefix.alias("prefix"))


def shared_entries(sets: DataFrame) -> DataFrame:
    """``(token, doc, signature, entry, lead, lead_entry, n)``: the index without tokens that one set alone has in its prefix.

    An entry packs a set's size and the token's place in it. Sizes and places beyond ``WIDEST`` are not told apart, and
    the filters let such pairs pass. The lead of a token is the set of the smallest document that has it.
    """
    entries = sets.filter("prefix is not null").select(F.col("first.doc_id").alias("doc"), "signature", "n", F.posexplode_outer("prefix").alias("at", "token"))
    size, place = (F.least(F.col(c), F.lit(WIDEST)).cast("int") for c in ("n", "at"))
    index = entries.select("token", "doc", "signature", F.shiftleft(size, 16).bitwiseOR(place).alias("entry"))
    # one shuffle finds both: nine of ten entries have a token of their own and go no further
    same = Window.partitionBy("token")
    counted = index.withColumns({"first": F.min(F.struct("doc", "signature", "entry")).over(same), "n": F.count("*").over(same)}).filter("n > 1")
    return counted.select("token", "doc", "signature", "entry", F.col("first.signature").alias("lead"), F.col("first.entry").alias("lead_entry"), "n")


def _may_be_similar(entry_a: Column, entry_b: Column) -> Column:
    """The length and positional filters, for two sets that share a token."""
    (n_a, at_a), (n_b, at_b) = ((F.shiftrightunsigned(e, 16), e.bitwiseAND(F.lit(WIDEST))) for e in (entry_a, entry_b))
    most = F.least(at_a, at_b) + F.least(n_a - at_a, n_b - at_b)
    enough = (5 * F.least(n_a, n_b) >= 4 * F.greatest(n_a, n_b)) & (9 * most >= 4 * (n_a + n_b))
    return enough | (n_a == WIDEST) | (n_b == WIDEST)


def lead_pairs(index: DataFrame) -> DataFrame:
    """``(a, b)``: every set with the leads of its tokens: no more pairs than entries."""
    met = index.filter((F.col("signature") != F.col("lead")) & _may_be_similar(F.col("lead_entry"), F.col("entry")))
    return met.select(F.col("lead").alias("a"), F.col("signature").alias("b")).distinct()


def other_pairs(index: DataFrame) -> DataFrame:
    """``(a, b)``: every set with the other sets that may come before it, of tokens in up to ``FEW`` prefixes."""
    some = index.filter(F.col("n") <= FEW)
    later = some.select(F.col("token").alias("token_b"), F.col("doc").alias("doc_b"), F.col("signature").alias("b"), F.col("entry").alias("entry_b"))
    others = some.filter(F.col("signature") != F.col("lead")).select(
        F.col("token").alias("token_a"), F.col("doc").alias("doc_a"), F.col("signature").alias("a"), F.col("entry").alias("entry_a"))
    before = (F.col("token_a") == F.col("token_b")) & (F.col("doc_a") <= F.col("doc_b")) & (F.col("a") != F.col("b"))
    return others.join(later, before & _may_be_similar(F.col("entry_a"), F.col("entry_b"))).select("a", "b").distinct()


def token_sets(keyed: DataFrame, firsts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(signature, tokens, first)`` of the wanted signatures: lines are looked up by the places of their first occurrences."""
    chosen = firsts.join(wanted, "signature").select("signature", "first.*")
    # each document's lines to look at, with their signatures: the texts move, the tokens made of them don't move back
    by_doc = chosen.groupBy("doc_id", "key").agg(F.map_from_entries(F.collect_set(F.struct("line_no", "signature"))).alias("wanted"))
    lines = keyed.join(by_doc, ["doc_id", "key"]).select("doc_id", "key", "wanted", F.posexplode_outer(F.split("text", "\n")).alias("line_no", "line"))
    shown = lines.filter(F.map_contains_key("wanted", F.col("line_no")))
    # repeated documents give a line twice, which changes nothing below
    return shown.select(F.element_at("wanted", F.col("line_no")).alias("signature"), _tokens("line").alias("tokens"), F.struct("doc_id", "line_no", "key").alias("first"))


def _similar() -> Column:
    """Jaccard of four fifths or more, on all tokens."""
    return 9 * F.size(F.array_intersect("tokens_a", "tokens_b")) >= 4 * (F.size("tokens_a") + F.size("tokens_b"))


def beaten_sets(known: DataFrame, pairs: DataFrame) -> DataFrame:
    """``signature`` of every set of the pairs that is similar to the other one and comes after it."""
    both = pairs
    for side in ("a", "b"):
        both = both.join(known.select(F.col("signature").alias(side), F.col("tokens").alias(f"tokens_{side}"), F.col("first").alias(f"first_{side}")), side)
    # of two similar sets, the one that comes first stays
    return both.filter(_similar()).select(F.when(F.col("first_a") < F.col("first_b"), F.col("b")).otherwise(F.col("a")).alias("signature")).distinct()


def beaten_among_many(known: DataFrame, many: DataFrame, beaten: DataFrame) -> DataFrame:
    """``signature`` of the sets with an earlier similar one behind a token of more than ``FEW`` prefixes.

    Near copies of one line that differ from each other by a little more than the threshold are in no list of pairs: a semi
    join asks of each set whether there is such an earlier one, and verifies within its condition. Two sets meet at the first frequent
    token they share only.
    """
    tokens = many.groupBy("signature").agg(F.sort_array(F.collect_set("token")).alias("many"))
    rows = landed(many.select("token", "signature", "entry").join(known, "signature").join(tokens, "signature"), "frequent")
    a, b = (rows.select(*[F.col(c).alias(f"{c}_{side}") for c in rows.columns]) for side in "ab")
    b = b.join(beaten.select(F.col("signature").alias("signature_b")), "signature_b", "left_anti")
    earlier = (F.col("token_a") == F.col("token_b")) & (F.col("first_a") < F.col("first_b")) & _may_be_similar(F.col("entry_a"), F.col("entry_b"))
    meet = F.array_min(F.array_intersect("many_a", "many_b")) == F.col("token_a")
    return b.join(a, earlier & meet & _similar(), "left_semi").select(F.col("signature_b").alias("signature")).distinct()


def later_lines(keyed: DataFrame) -> DataFrame:
    """``(doc_id, key, line_no)`` of lines with an equal or similar line before them, by ``doc_id``, then line number.

    Similarity is judged on the input: a line that is removed itself removes later ones all the same. Every set is compared
    with the leads of its tokens first; in a group of near copies the lead beats most, and only those it does not beat are
    compared with others.
    """
    occurrences = landed(ordered_sets(tokenized(keyed)), "lines")
    place = F.struct("doc_id", "line_no", "key")
    sets = occurrences.groupBy("signature").agg(F.min(place).alias("first"), F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    firsts = occurrences.groupBy("signature").agg(F.min(place).alias("first"))
    index = landed(shared_entries(sets), "index")
    leads, others = landed(lead_pairs(index), "leads"), landed(other_pairs(index), "pairs")
    many = index.filter(F.col("n") > FEW)
    ends = [pairs.select(F.col(side).alias("signature")) for pairs in (leads, others) for side in ("a", "b")]
    # the texts move once, for all sets that are compared at all
    known = landed(token_sets(keyed, firsts, reduce(DataFrame.union, ends, many.select("signature")).distinct()), "sets")
    by_leads = landed(beaten_sets(known, leads), "beaten")
    unbeaten = others.join(by_leads.withColumnRenamed("signature", "b"), "b", "left_anti")
    beaten = by_leads.union(beaten_sets(known, unbeaten)).union(beaten_among_many(known, many, by_leads)).distinct()
    marked = firsts.join(beaten.withColumn("beaten", F.lit(True)), "signature", "left")
    later = occurrences.select("doc_id", "line_no", "key", "signature").join(marked, "signature")
    return later.filter(F.coalesce("beaten", F.lit(False)) | (place != F.col("first"))).select("doc_id", "key", "line_no")


def line_dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with their own columns and ``n_lines``, ``n_removed``: every line goes that has an equal or similar line before it.

    Lines end at a line feed; words are separated by white space and compared unchanged. Lines without words stay. A
    text whose lines all go is empty, its document stays. Null texts stay null and count no lines. Rows without
    ``doc_id`` pass unchanged, repeated rows are one document.
    """
    own = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    keyed = texts(docs).select("doc_id", text_key().alias("key"), "text")
    gone = later_lines(keyed).groupBy("doc_id", "key").agg(F.collect_set("line_no").alias("gone"))
    # the columns of the documents travel as one, so none of their names can meet one of ours
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("key"),
        F.col("text").alias("text"), F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"))
    matched = rows.join(gone, ["doc_id", "key"], "left")
    lines = F.split(F.col("text"), "\n")
    kept = F.array_join(F.filter(lines, lambda line, i: ~F.array_contains(F.col("gone"), i)), "\n")
    return matched.select(
        *[F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("text") if c == "text" else F.col(f"row.`{c}`") for c in own],
        F.coalesce(F.size(lines), F.lit(0)).alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).alias("n_removed"),
    )
