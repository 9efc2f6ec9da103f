"""Shards of nearly equal bytes by a k-d tree over the documents' metadata, in DataFrame functions.

All documents are one cell that is due to become so many shards. A cell is split along the metadata dimension in which
it is widest, at the place that leaves each side the bytes its shards should hold (the weighted median where both get as
many), until every cell is one shard. Splits are found by histograms over all documents: sizes are summed in buckets of
the split dimension, the bucket that holds the wanted place is divided again, until it is a small part of a shard.
Documents of equal coordinates are ordered by a hash of their ids, so a hot value is split like any other.

The tree has one split less than there are shards and lives on the driver; a document's shard is one expression over its
own columns, so whole rows are dealt to shards without a join or a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from toolsentry.llm.tables import landed

SHARDS = 16
BUCKETS = 4096
#: A split is exact enough once the documents around it hold this part of a shard.
FINE = 1 / 1024
#: Documents of a shard that are numbered together.
NUMBERED_TOGETHER = 20_000
_LAST_TIE = (1 << 62) - 1


@dataclass
class Cell:
    """A part of the documents, due to become ``shards`` shards from ``first`` on; once split, it has two sides.

    Rows beyond (``place``, ``tie``) in the order of (the dimension, the hash of the id) are on the right.
    """

    first: int
    shards: int
    dimension: int = -1
    place: float = 0.0
    tie: int = 0
    sides: tuple[Cell, Cell] | None = None

    def split(self, dimension: int, place: float, tie: int) -> None:
        left = self.shards // 2
        self.dimension, self.place, self.tie = dimension, place, tie
        self.sides = Cell(self.first, left), Cell(self.first + left, self.shards - left)

    def leaves(self) -> Iterator[Cell]:
        if self.sides is None:
            yield self
        else:
            for side in self.sides:
                yield from side.leaves()

    def decide(self, leaf: Callable[[Cell], Column]) -> Column:
        """What ``leaf`` says about the cell a row lies in, as nested conditions."""
        if self.sides is None:
            return leaf(self)
        own = F.col(f"d{self.dimension}")
        beyond = (own > F.lit(self.place)) | ((own == F.lit(self.place)) & (F.col("tie") > F.lit(self.tie)))
        left, right = (side.decide(leaf) for side in self.sides)
        return F.when(beyond, right).otherwise(left)


@dataclass
class Search:
    """Where the split of a cell is looked for: among values of its dimension, or among the hashes of rows at ``place``."""

    cell: Cell
    wanted: float
    small: float
    dimension: int
    low: float
    high: float
    #: bytes before ``low``
    before: int = 0
    place: float | None = None

    def value(self) -> Column:
        """What is divided: a row's coordinate or hash, null outside of what is left of the search."""
        own = F.col(f"d{self.dimension}") if self.place is None else F.col("tie")
        inside = (own >= F.lit(self.low)) & (own <= F.lit(self.high))
        if self.place is not None:
            inside &= F.col(f"d{self.dimension}") == F.lit(self.place)
        return F.when(inside, own.cast("double"))

    def narrow(self, sums: list) -> bool:
        """Go on in the bucket that holds the wanted place, or split the cell there; says whether it is split."""
        before = self.before
        for row in sums:
            if before + row.bytes >= self.wanted:
                break
            before += row.bytes
        single = row.low == row.high
        if row.bytes <= self.small or (single and self.place is not None):
            after = before + row.bytes - self.wanted < self.wanted - before
            if self.place is None:
                # before the least value means after no hash of it
                self.cell.split(self.dimension, row.high if after else row.low, _LAST_TIE if after else -1)
            else:
                self.cell.split(self.dimension, self.place, row.last if after else row.first - 1)
            return True
        if single:
            self.place, self.low, self.high = row.low, 0.0, float(_LAST_TIE)
        else:
            self.low, self.high = row.low, row.high
        self.before = before
        return False


def metadata(docs: DataFrame) -> list[Column]:
    """The dimensions: language, source, size and id, as numbers; missing columns are no dimensions, null is below all values."""
    kinds = dict(docs.dtypes)
    named = [F.coalesce(F.crc32(F.col(c).cast("string")).cast("double"), F.lit(-1.0)) for c in ("lang", "source") if c in kinds]
    return [*named, F.log2(text_size().cast("double")), F.coalesce(F.col("doc_id").cast("double"), F.lit(-1.0))]


def text_size() -> Column:
    """UTF-8 bytes of the text (null: none) plus one."""
    return F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint") + 1


def text_crc32() -> Column:
    return F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))


def points(docs: DataFrame, *more: str | Column) -> DataFrame:
    """What the tree needs of each document: its size, its coordinates ``d0, d1 ...`` and a hash of its id that orders
    documents of equal coordinates (equal rows stay together). The text stays where it is."""
    tie = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text_crc32()).bitwiseAND(F.lit(_LAST_TIE))
    at = [column.alias(f"d{i}") for i, column in enumerate(metadata(docs))]
    return docs.select(*more, text_size().alias("size"), tie.alias("tie"), *at)


def dimensions(rows: DataFrame) -> list[str]:
    """The coordinates' columns, which ``points`` puts last."""
    return rows.columns[rows.columns.index("tie") + 1:]


def even_weight(rows: DataFrame, shards: int) -> float:
    """The bytes of a shard if larger documents count as one: they get a shard of their own, all others share the rest.

    Fewer documents than shards can be larger than that, so the largest ``shards`` decide it.
    """
    total = rows.agg(F.sum("size")).first()[0] or 0
    rest = shards
    for row in rows.select("size").orderBy(F.col("size").desc()).limit(shards).collect():
        if row["size"] * rest <= total:
            break
        total, rest = total - row["size"], rest - 1
    return max(1.0, total / rest) if rest else 1.0


def _extent(rows: DataFrame, root: Cell) -> dict[int, tuple]:
    """Bytes, least and largest coordinates of every cell that is not empty."""
    names = dimensions(rows)
    cells = rows.groupBy(root.decide(lambda c: F.lit(c.first)).alias("cell")).agg(
        F.sum("weight").alias("bytes"), F.array(*map(F.min, names)).alias("least"), F.array(*map(F.max, names)).alias("most"))
    return {r.cell: (r.bytes, r.least, r.most) for r in cells.collect()}


def kd_tree(rows: DataFrame, shards: int = SHARDS) -> Cell:
    """The tree over ``points``: rows are read a few times for each level, and only sums in buckets leave the executors."""
    root = Cell(0, shards)
    if shards < 2:
        return root
    level = even_weight(rows, shards)
    rows = rows.withColumn("weight", F.least(F.col("size").cast("double"), F.lit(level))).select("weight", "tie", *dimensions(rows))
    extents = _extent(rows, root)
    spans = [(z - a) or 1.0 for a, z in zip(*extents[0][1:])] if extents else []
    while extents:
        searches = {}
        for cell in root.leaves():
            if cell.shards > 1 and cell.first in extents:
                total, least, most = extents[cell.first]
                widest = max(range(len(spans)), key=lambda d: ((most[d] - least[d]) / spans[d], -d))
                part = total / cell.shards
                searches[cell.first] = Search(cell, part * (cell.shards // 2), part * FINE, widest, least[widest], most[widest])
        if not searches:
            break
        while searches:
            value = root.decide(lambda c: searches[c.first].value() if c.first in searches else F.lit(None).cast("double"))
            low, wide = (root.decide(lambda c: F.lit(f(searches[c.first]) if c.first in searches else 1.0))
                         for f in (lambda s: s.low, lambda s: (s.high - s.low) / BUCKETS or 1.0))
            cell = root.decide(lambda c: F.lit(c.first)).alias("cell")
            bucket = F.floor((F.col("value") - F.col("start")) / F.col("wide")).alias("bucket")
            sought = rows.select(cell, value.alias("value"), low.alias("start"), wide.alias("wide"), "weight", "tie").filter("value is not null")
            # at most BUCKETS + 1 rows for each cell, whatever the number of documents
            sums = sought.groupBy("cell", bucket).agg(
                F.sum("weight").alias("bytes"), F.min("value").alias("low"), F.max("value").alias("high"), F.min("tie").alias("first"), F.max("tie").alias("last"))
            found: dict[int, list] = {}
            for row in sorted(sums.collect(), key=lambda r: r.low):
                found.setdefault(row.cell, []).append(row)
            searches = {first: search for first, search in searches.items() if not search.narrow(found[first])}
        extents = _extent(rows, root)
    return root


def with_shard(rows: DataFrame, tree: Cell) -> DataFrame:
    """The rows of ``points`` with the shard the tree puts them in."""
    return rows.withColumn("shard", tree.decide(lambda c: F.lit(c.first)))


def shard_count(docs: DataFrame, target_bytes: int) -> int:
    """How many shards bring each to the target bytes at most, as far as single documents allow."""
    total = docs.agg(F.sum(text_size())).first()[0] or 0
    return max(1, -(-total // target_bytes))


def sharded(docs: DataFrame, tree: Cell) -> DataFrame:
    """Whole rows of ``docs`` with their ``shard``, without a shuffle; a column of that name is replaced."""
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "shard"]).alias("row")
    return with_shard(points(docs, own), tree).select("row.*", "shard")


def numbered(rows: DataFrame) -> DataFrame:
    """Rows with their ``slot``, gapless from 0 in each ``shard``: counts of parts of a shard are summed, not its rows."""
    most = rows.groupBy("shard").count().agg(F.max("count")).first()[0] or 0
    parts = max(64, -(-most // NUMBERED_TOGETHER))
    parted = rows.withColumn("part", F.pmod("tie", F.lit(parts)))
    counts = parted.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = counts.selectExpr("shard", "part", "sum(n) over (partition by shard order by part) - n as before")
    place = parted.selectExpr("*", "row_number() over (partition by shard, part order by tie, doc_id, text_crc32) - 1 as place")
    return place.join(before, ["shard", "part"]).withColumn("slot", F.col("before") + F.col("place")).drop("part", "before", "place")


def shard_list(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)`` of every row of ``docs``, by the law of equal bytes.

    Sizes of shards differ by about a thousandth and a document; one that alone is larger than a shard has a shard for
    itself. Null texts have a size of 1, null metadata lies below all values, rows without ``doc_id`` are sharded too,
    repeated rows each have a slot (in one shard). With fewer rows than shards some shards are empty.
    ``grown_shard`` belongs to another law and is null. Columns other than text and metadata are not read.
    """
    rows = landed(points(docs, F.col("doc_id").cast("bigint").alias("doc_id"), text_crc32().alias("text_crc32")), "points")
    found = numbered(with_shard(rows, kd_tree(rows, shards)))
    return found.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
