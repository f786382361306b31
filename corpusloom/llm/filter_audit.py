"""Filter interaction audit: what each of several filters removes in every order, from decision diagrams.

1. A document's failures make a mask, one bit a filter, from its whole text; the last
   filter fails a text that some smaller id has too, wherever it stands.
2. Documents are counted by part and mask: at most 32 rows a part, however large it is.
3. Of each part's masks a decision diagram is built: a level a filter, a node a set of
   documents that only later filters tell apart, with their counts, and equal nodes made
   once. The orders are visited so that each differs from the last by one swap of
   neighbours, and such a swap rebuilds the nodes of two levels only.
4. In each order the path on which all filters pass gives the steps: its nodes count what
   is kept, and the branches that leave it what is removed.

Equal texts are found by their SHA-256 digests, counted by digest and part before
anything is joined, so a group of copies of any size is a few rows. Rows without an id
meet no label and are dealt out by digest.

Defined cases: a null text is empty; a null part is the empty string; a null id is larger
than any other, so such a row fails as a copy if its text has an id; repeated rows of one
id count each and are no copies of each other; several labels of an id count by their
largest, null as 0; labels without a document are not read; only the named columns are
read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import tables
from corpusloom.llm.registry import query

#: Names of the filters; the last is the one on copies.
FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, CAPITALS_PERCENT = 200, 50, 3
SALTS = 1024

Counts = tuple[int, ...]


def text_failures(text: str) -> dict[str, Column]:
    """The conditions of the filters that read one text alone."""
    words = F.col("words")
    return {
        "A": F.size(words) < MIN_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < DISTINCT_PERCENT * F.size(words),
        "C": 100 * F.octet_length(F.regexp_replace(text, "[^A-Z]+", "")) > CAPITALS_PERCENT * F.length(text),
        "D": F.col(text).rlike("[#$%&*|]"),
    }


def _bits(failures: dict[str, Column]) -> Column:
    return reduce(Column.__add__, [F.when(fails, 1 << FILTERS.index(name)).otherwise(0) for name, fails in failures.items()])


def failure_masks(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", label_id: str = "doc_id",
    good_col: str = "quality", toxic_col: str = "toxic",
) -> DataFrame:
    """``part, mask, n, good, toxic``: documents of each part by the filters they fail."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(part_col, F.lit("")).alias("part"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.expr(r"filter(split(text, '[\\x20\\x09-\\x0D]+'), w -> w <> '')"))
    rows = rows.select(
        "id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), _bits(text_failures("text")).cast("int").alias("mask")
    )
    # Rows of one id and text are one row with a count.
    rows = rows.groupBy("id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    salt = F.when(F.col("id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(SALTS))).otherwise(F.lit(-1).cast("long"))
    one = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c)
    marks = labels.select(F.col(label_id).alias("id"), F.col(good_col).alias("good"), F.col(toxic_col).alias("toxic")).where("id is not null")
    marks = marks.groupBy("id").agg(one("good"), one("toxic")).withColumn("salt", F.lit(-1).cast("long"))
    rows = rows.withColumn("salt", salt).join(marks, ["id", "salt"], "left")
    counts = ["n", *[(F.coalesce(c, F.lit(0)) * F.col("n")).alias(c) for c in ("good", "toxic")]]
    rows = rows.select(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("value")).alias("id"), "part", "digest", "mask", *counts)
    # Of each digest and part: all counts, and those of its smallest id.
    mine = F.struct("id", "n", "good", "toxic")
    copies = rows.groupBy("digest", "part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")], F.min(mine).alias("least"))
    first = copies.groupBy("digest").agg(F.min("least.id").alias("first"))
    copies = copies.join(first, "digest")
    passing = [F.when(F.col("least.id") == F.col("first"), F.col(f"least.{c}")).otherwise(0) for c in ("n", "good", "toxic")]
    copy = 1 << (len(FILTERS) - 1)
    both = F.array(
        F.struct(F.col("mask").alias("mask"), *[p.alias(c) for c, p in zip(("n", "good", "toxic"), passing)]),
        F.struct((F.col("mask") + copy).alias("mask"), *[(F.col(c) - p).alias(c) for c, p in zip(("n", "good", "toxic"), passing)]),
    )
    masks = copies.select("part", F.explode(both).alias("m")).select("part", "m.*").where("n > 0")
    return masks.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


class Diagram:
    """A decision diagram over ``size`` filters whose nodes carry counts.

    A node is ``(pass, fail)``, two numbers of nodes a level down; a leaf is its counts.
    Equal nodes of a level are one. The filters' order may change by swaps of neighbours.
    """

    def __init__(self, counts: dict[int, Counts], size: int) -> None:
        self.order = list(range(size))
        self._width = len(next(iter(counts.values()), ()))
        leaves: dict[Counts, int] = {}
        now = [leaves.setdefault(counts.get(mask, (0,) * self._width), len(leaves)) for mask in range(1 << size)]
        self._leaves = list(leaves)
        self._levels: list[list[tuple[int, int]]] = []
        # From the last filter, whose bit is the highest, to the first.
        for level in reversed(range(size)):
            half = 1 << level
            made: dict[tuple[int, int], int] = {}
            now = [made.setdefault((now[m], now[m | half]), len(made)) for m in range(half)]
            self._levels.insert(0, list(made))
        self._sums = [self._weigh(level) for level in range(size)]

    def _below(self, level: int) -> list[Counts]:
        return self._sums[level + 1] if level + 1 < len(self._levels) else self._leaves

    def _weigh(self, level: int) -> list[Counts]:
        sums = list(self._leaves)
        for at in reversed(range(level, len(self._levels))):
            sums = [tuple(a + b for a, b in zip(sums[p], sums[f])) for p, f in self._levels[at]]
        return sums

    def swap(self, level: int) -> None:
        """Exchanges the filters of ``level`` and the one after it: nodes above and below stay as they are."""
        upper, lower = self._levels[level], self._levels[level + 1]
        made: dict[tuple[int, int], int] = {}
        node = lambda p, f: made.setdefault((p, f), len(made))
        # A node's four grandchildren, with the middle two exchanged.
        self._levels[level] = [(node(lower[p][0], lower[f][0]), node(lower[p][1], lower[f][1])) for p, f in upper]
        self._levels[level + 1] = list(made)
        below = self._below(level + 1)
        self._sums[level + 1] = [tuple(a + b for a, b in zip(below[p], below[f])) for p, f in made]
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def steps(self) -> Iterator[tuple[int, Counts, Counts]]:
        """Along the path on which all filters pass: the filter, the counts it keeps, the counts it removes."""
        node = 0
        for level, name in enumerate(self.order):
            passed, failed = self._levels[level][node]
            below = self._below(level)
            yield name, below[passed], below[failed]
            node = passed

    def nodes(self) -> int:
        return sum(map(len, self._levels)) + len(self._leaves)


def neighbour_swaps(size: int) -> Iterator[int]:
    """Levels to swap, one after the other, that lead once through all orders of ``size`` filters.

    The last filter walks through each order of the others, there and back by turns.
    """
    if size < 2:
        return
    inner = neighbour_swaps(size - 1)
    down = True
    while True:
        yield from (range(size - 2, -1, -1) if down else range(size - 1))
        level = next(inner, None)
        if level is None:
            return
        # Where the walker stands first, the others are one place further.
        yield level + 1 if down else level
        down = not down


def audit(masks: dict[int, Counts], filters: Sequence[str] = FILTERS) -> list[tuple]:
    """``(filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)`` of every order and step.

    ``masks``: counts (all, good, toxic) by the mask of failed filters.
    """
    size = len(filters)
    fails = [sum(c[0] for m, c in masks.items() if m >> i & 1) for i in range(size)]
    alone = [masks.get(1 << i, (0,))[0] for i in range(size)]
    diagram = Diagram(masks, size)
    rows, shares = [], [0] * size

    def take() -> None:
        order = "".join(filters[i] for i in diagram.order)
        for step, (i, kept, removed) in enumerate(diagram.steps(), 1):
            shares[i] += removed[0]
            rows.append((order, step, kept[0], removed[0], fails[i] - removed[0], alone[i], removed[1], removed[2], i))

    take()
    for level in neighbour_swaps(size):
        diagram.swap(level)
        take()
    return [(*row[:-1], shares[row[-1]]) for row in rows]


_COLUMNS = ("filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def _audit_part(masks: pd.DataFrame) -> pd.DataFrame:
    counts = {int(r.mask): (int(r.n), int(r.good), int(r.toxic)) for r in masks.itertuples()}
    out = pd.DataFrame(audit(counts), columns=list(_COLUMNS))
    out.insert(0, "part", masks["part"].iloc[0])
    return out


def audit_parts(masks: DataFrame) -> DataFrame:
    """One row per part, order of the filters, and step, from ``failure_masks``; a part is at most 32 rows here."""
    tables.on_executors(masks.sparkSession)
    shape = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in _COLUMNS[2:])
    return masks.groupBy("part").applyInPandas(_audit_part, shape)


_ORACLE = r"""
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
firsts AS (SELECT text, min(doc_id) AS first FROM w GROUP BY text),
marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b,
    100 * length(regexp_replace(w.text, '[^A-Z]+', '', 'g')) > 3 * length(w.text) AS c, regexp_matches(w.text, '[#$%&*|]') AS d,
    CASE WHEN w.doc_id IS NULL THEN first IS NOT NULL ELSE first < w.doc_id END AS e, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM w JOIN firsts ON w.text = firsts.text LEFT JOIN marks ON w.doc_id = marks.doc_id),
m AS (
  SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic
  FROM f GROUP BY ALL),
names AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS name, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (
  SELECT p.name || q.name || r.name || s.name || t.name AS filter_order, [p.bit, q.bit, r.bit, s.bit, t.bit] AS bits
  FROM names p, names q, names r, names s, names t
  WHERE len(list_distinct([p.name, q.name, r.name, s.name, t.name])) = 5),
steps AS (
  SELECT filter_order, step, bits[step] AS own, list_sum(bits[1:step])::INT - bits[step] AS before
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
sums AS (
  SELECT part, filter_order, step, own,
    sum(CASE WHEN mask & (own | before) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & before = 0 AND mask & own <> 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & before <> 0 AND mask & own <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & before = 0 AND mask & own <> 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & before = 0 AND mask & own <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM m, steps GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM sums
"""


@query("op13_filter_audit", _ORACLE)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_parts(failure_masks(tables.read(spark, sf_dir, "documents"), tables.read(spark, sf_dir, "labels")))
