"""N-gram Jaccard join: documents whose sets of word shingles are alike, by adaptive multi-match prefixes.

Shingles have one order for all documents: those seen often come last, the rest
by hash. If two sets of n and m shingles have a Jaccard similarity of at least
t, their first n - ceil(t n) + l and m - ceil(t m) + l shingles share l at
least. A longer prefix (larger l) reads longer lists but asks more of each
candidate; each document takes the l of least estimated cost, from the lengths
of its own lists.

1. ``frequent_shingles``: counts of the commonest shingles. They only shape the
   order, which may be any; results do not depend on them.
2. Each set is a node, named by a digest of it, so copies are one node.
3. Prefix shingles that several nodes have make lists. In each, every node is
   paired with the list's hub, the node with the largest share of its prefix in
   lists, and those pairs are verified: a group of copies is joined through the
   copy with the fewest edits, without the pairs among its members.
4. What is left is exact: nodes of one list that are not yet connected are
   paired, counted over the shared prefix shingles, and verified if they share
   as many as their l asks for.

Every pair is first tested by parity sketches: bit i of a node's sketch is the
parity of the number of its shingles that hash to i, so two sets differ in at
least as many shingles as their sketches do in bits. The test drops no pair
that is similar enough, and groups just below the threshold seldom pass it.
5. Connected components over all verified links.

Similarity is exact on whole sets in every verification; no list, partner or
candidate is cut. Links between two nodes that are already connected are not
all listed: they would change no class.

Defined cases: null and empty texts and texts without words have an empty set
and link with nothing; a text of fewer words than a shingle has its whole word
sequence as its one shingle; equal sets link; a null id counts as the largest;
rows with equal id are each a document; only the id and text columns are read,
so other columns may have any name; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import tables
from corpusloom.llm.components import components
from corpusloom.llm.registry import query
from corpusloom.llm.words import PLAIN, by_text, mix, sequence_hashes, window_hashes, words_of

#: Longest extension of a prefix.
MAX_MATCHES = 4
#: Shingles whose counts shape the order: so many at most, 16 bytes each.
FREQUENT = 1 << 17
#: Shingles among which a task counts at a time; those seen fewer than three times there count as rare.
COUNT_BLOCK = 2 << 20
#: 64-bit words of a parity sketch.
SKETCH = 8
#: Cost of verifying a candidate, in list entries read.
VERIFY_COST = 50
_LAST = (1 << 63) - 1


def shingle_sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Text numbers and shingle hashes of all texts' sets, sorted by both; and the number of texts."""
    words = words_of(column, PLAIN, fold=True)
    hashes, counts, first = words.hashes(), words.counts(), words.first()[:-1]
    full = window_hashes(hashes, width)
    valid = words.text[: len(full)] == words.text[width - 1 :] if len(full) else np.zeros(0, dtype=bool)
    short = np.flatnonzero((counts > 0) & (counts < width))
    text = np.concatenate([words.text[: len(full)][valid], short])
    shingles = np.concatenate([full[valid], sequence_hashes(hashes, first[short], first[short] + counts[short])])
    order = by_text(text, shingles)
    text, shingles = text[order], shingles[order]
    new = np.ones(len(text), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (shingles[1:] != shingles[:-1])
    return text[new], shingles[new], words.n_texts


def _nodes(text: np.ndarray, shingles: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Set size and digest of each text."""
    size = np.bincount(text, minlength=n)
    sums = np.zeros(len(text) + 1, dtype=np.uint64)
    np.cumsum(mix(shingles ^ np.uint64(0xA0761D6478BD642F)), out=sums[1:])
    ends = np.cumsum(size)
    return size, mix(sums[ends] - sums[ends - size] + size.astype(np.uint64)).view(np.int64)


def _sketches(text: np.ndarray, shingles: np.ndarray, n: int) -> np.ndarray:
    """The parity sketch of each text, a row of 64-bit words."""
    bits = 64 * SKETCH
    place = (mix(shingles ^ np.uint64(0xE7037ED1A0B428DB)) % np.uint64(bits)).astype(np.int64)
    odd = (np.bincount(text * bits + place, minlength=n * bits) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(n, bits), axis=1).view(np.int64)


def _members(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tables.slices(batches, "text"):
            for low in range(0, batch.num_rows, 4096):
                part = batch.slice(low, 4096)
                text, shingles, n = shingle_sets(part.column("text"), width)
                size, node = _nodes(text, shingles, n)
                words = [pa.array(np.ascontiguousarray(w)) for w in _sketches(text, shingles, n).T]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("owner"), part.column("text_hash"), pa.array(size, pa.int64()), pa.array(node), *words],
                    ["id", "owner", "text_hash", "n", "node", *_WORDS],
                )

    return run


_WORDS = [f"sketch_{i}" for i in range(SKETCH)]


def _counted(width: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def often() -> pa.RecordBatch:
            shingles, counts = np.unique(np.concatenate(held), return_counts=True)
            some = counts >= 3
            return pa.RecordBatch.from_arrays([pa.array(shingles[some].view(np.int64)), pa.array(counts[some])], ["shingle", "n"])

        for batch in tables.slices(batches, "text"):
            held.append(shingle_sets(batch.column("text"), width)[1])
            if sum(map(len, held)) >= block:
                yield often()
                held.clear()
        if held:
            yield often()

    return run


def frequent_shingles(texts: DataFrame, width: int, limit: int = FREQUENT, block: int = COUNT_BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """The commonest shingles and lower bounds of their counts; ``limit`` of them at most."""
    counts = texts.select("text").mapInArrow(_counted(width, block), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "shingle").limit(limit).toArrow()
    shingles, n = top.column("shingle").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(shingles)
    return shingles[order], n[order]


def _prefixes(width: int, percent: int, most: int, frequent: np.ndarray, seen: np.ndarray):
    """Prefix shingles of each set with the smallest l whose prefix has them; copies in a slice once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tables.slices(batches, "text"):
            text, shingles, n_texts = shingle_sets(batch.column("text"), width)
            size, node = _nodes(text, shingles, n_texts)
            alone = np.zeros(n_texts, dtype=bool)
            alone[np.unique(node, return_index=True)[1]] = True
            text, shingles = text[alone[text]], shingles[alone[text]]
            often = np.zeros(len(shingles), dtype=np.int64)
            if len(frequent):
                at = np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)
                often = np.where(frequent[at] == shingles, seen[at], 0)
            order = by_text(text, often, shingles)
            text, shingles = text[order], shingles[order]
            own = np.bincount(text, minlength=n_texts)
            place = np.arange(len(text)) - (np.cumsum(own) - own)[text]
            need = (percent * size + 99) // 100
            level = np.maximum(1, place - (size - need)[text] + 1)
            chosen = level <= np.minimum(most, need)[text]
            text = text[chosen]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(shingles[chosen].view(np.int64)), pa.array(node[text]), pa.array(size[text].astype(np.int32)),
                    pa.array(level[chosen].astype(np.int32)),
                ],
                ["shingle", "node", "n", "level"],
            )

    return run


def _alike(width: int, percent: int):
    """Keeps the pairs whose whole sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tables.slices(batches, "text_a", tables.SLICE_BYTES // 2):
            keys, sizes = [], []
            for side in ("text_a", "text_b"):
                text, shingles, n = shingle_sets(batch.column(side), width)
                keys.append(mix(shingles + text.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
                sizes.append(np.bincount(text, minlength=n))
            both = np.bincount(text[np.isin(keys[1], keys[0])], minlength=n)
            union = sizes[0] + sizes[1] - both
            linked = pa.array((both > 0) & (100 * both >= percent * union))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(linked), batch.column("b").filter(linked)], ["a", "b"])

    return run


def _possible(a: str, b: str, percent: int) -> F.Column:
    """Whether sets of these sizes and sketches can be similar enough; ``a`` and ``b`` are patterns of column names."""
    n, m = F.col(a.format("n")), F.col(b.format("n"))
    differ = sum(F.bit_count(F.col(a.format(w)).bitwiseXOR(F.col(b.format(w)))) for w in _WORDS)
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * differ <= (100 - percent) * (n + m))


def _classes(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Every document as ``id, owner, text_hash, n, node``, and ``node, class, name`` of the nodes that have shingles."""
    tables.on_executors(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).select(
        "id", F.coalesce("id", F.lit(_LAST)).alias("owner"), F.xxhash64("text").alias("text_hash"), "text"
    )
    members = tables.store(
        rows.mapInArrow(_members(width), f"id long, owner long, text_hash long, n long, node long, {', '.join(f'{w} long' for w in _WORDS)}"),
        "members",
    )
    # One text stands for each node; a repeated (id, text) is one row of texts.
    stands = members.where("n > 0").groupBy("node").agg(F.min(F.struct("owner", "text_hash")).alias("d"))
    sketches = tables.store(members.where("n > 0").groupBy("node").agg(F.min("n").alias("n"), *[F.min(w).alias(w) for w in _WORDS]), "sketches")

    def sketched(pairs: DataFrame) -> DataFrame:
        for side in ("a", "b"):
            pairs = pairs.join(sketches.select(F.col("node").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("n", *_WORDS)]), side)
        return pairs.where(_possible("{}_a", "{}_b", percent)).select("a", "b")
    texts = rows.select("owner", "text_hash", "text").dropDuplicates(["owner", "text_hash"])

    def verified(pairs: DataFrame) -> DataFrame:
        for side in ("a", "b"):
            key = stands.select(F.col("node").alias(side), F.col("d.owner").alias(f"owner_{side}"), F.col("d.text_hash").alias(f"hash_{side}"))
            pairs = pairs.join(key, side)
        for side in ("a", "b"):
            text = texts.select(F.col("owner").alias(f"owner_{side}"), F.col("text_hash").alias(f"hash_{side}"), F.col("text").alias(f"text_{side}"))
            pairs = pairs.join(text, [f"owner_{side}", f"hash_{side}"])
        return pairs.select("a", "b", "text_a", "text_b").mapInArrow(_alike(width, percent), "a long, b long")

    frequent, seen = frequent_shingles(rows, width)
    index = rows.select("text").mapInArrow(
        _prefixes(width, percent, most, frequent, seen), "shingle long, node long, n int, level int"
    )
    shared = index.groupBy("shingle").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("shingle")
    lists = tables.store(index.join(shared, "shingle").dropDuplicates(["shingle", "node"]), "prefix-lists")
    central = lists.groupBy("node").agg((-F.count("*") / F.max("n")).alias("order"))
    hubs = lists.join(central, "node").groupBy("shingle").agg(F.min(F.struct("order", "node")).alias("first"))
    lists = tables.store(lists.join(hubs.select("shingle", F.col("first.node").alias("hub")), "shingle"), "hub-lists")
    pairs = lists.where("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    checked = tables.store(sketched(pairs), "hub-pairs")
    links = tables.store(verified(checked), "hub-links")
    class_of = tables.store(components(links), "hub-classes")

    # Lists that still hold nodes of several classes.
    open_lists = lists.join(class_of, "node", "left").withColumn("class", F.coalesce("component", "node")).drop("component")
    per_list = open_lists.groupBy("shingle").agg(
        F.min("class").alias("low"), F.max("class").alias("high"), F.max(F.when(F.col("node") == F.col("hub"), F.col("class"))).alias("main"),
        *[F.sum((F.col("level") <= i).cast("long")).alias(f"entries_{i}") for i in range(1, most + 1)],
    ).where("low < high").drop("low", "high")
    entries = tables.store(open_lists.drop("hub").join(per_list, "shingle"), "open-lists")
    cost = entries.groupBy("node").agg(
        *[F.sum(F.when(F.col("level") <= i, F.col(f"entries_{i}")).otherwise(0)).alias(f"c{i}") for i in range(1, most + 1)]
    )
    # Entries read, and at most a candidate for every l of them.
    choices = F.array_min(
        F.array(*[F.struct((F.col(f"c{i}") * (1 + VERIFY_COST / i)).alias("cost"), F.lit(i).alias("l")) for i in range(1, most + 1)])
    )
    chosen = cost.select("node", choices["l"].alias("l"))
    entries = (
        entries.join(chosen, "node")
        .join(sketches.drop("n"), "node")
        .select("shingle", "node", "n", "level", "class", "l", (F.col("class") == F.col("main")).alias("is_main"), *_WORDS)
    )
    # Each unordered pair once: one side is outside the list's main class.
    x, y = entries.where("not is_main").alias("x"), entries.alias("y")
    pairs = (
        x.join(y, F.expr("x.shingle = y.shingle and x.class <> y.class and (y.is_main or x.node < y.node)"))
        .where(_possible("x.{}", "y.{}", percent))
        .select(
            F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"),
            # The probing side is the larger set, by node if equal.
            F.expr("if((x.n, x.node) > (y.n, y.node), x.l, y.l)").alias("l"), F.greatest("x.level", "y.level").alias("level"),
            F.least(F.least("x.n", "y.n"), F.lit(most)).alias("n"),
        )
        .where("level <= l")
    )
    need = F.least("l", F.expr(f"int(({percent} * n + 99) / 100)"))
    pairs = pairs.groupBy("a", "b").agg(F.count("*").alias("shared"), F.max("l").alias("l"), F.max("n").alias("n")).where(F.col("shared") >= need)
    rest = tables.store(pairs.select("a", "b").join(checked, ["a", "b"], "left_anti"), "rest-pairs")
    class_of = components(links.union(verified(rest)))

    nodes = members.where("n > 0").groupBy("node").agg(F.min("owner").alias("least"))
    named = nodes.join(class_of, "node", "left").withColumn("class", F.coalesce("component", "node"))
    names = named.groupBy("class").agg(F.min("least").alias("name"))
    return members, tables.store(named.select("node", "class").join(names, "class"), "class-names")


def similar_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, most: int = MAX_MATCHES,
) -> DataFrame:
    """One row per document: ``id_col, n_shingles, component_id``; links have a Jaccard similarity of ``percent`` or more."""
    members, names = _classes(docs, id_col, text_col, width, percent, most)
    name = F.when(F.col("n") > 0, F.col("name")).otherwise(F.col("owner"))
    return members.join(names, "node", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(name < _LAST, name).alias("component_id")
    )


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The documents, all columns, that are alone or the first of their class, by id and then by a hash of the text."""
    members, names = _classes(docs, id_col, text_col, width, percent, MAX_MATCHES)
    rows = members.where("n > 0").join(names, "node").select("class", "owner", "text_hash")
    first = rows.groupBy("class").agg(F.min(F.struct("owner", "text_hash")).alias("first"))
    gone = rows.join(first, "class").where((F.col("owner") != F.col("first.owner")) | (F.col("text_hash") != F.col("first.text_hash")))
    gone = gone.select("owner", "text_hash").distinct()
    # The documents' own columns travel as one, so that they may have any name.
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("owner"),
        F.xxhash64(text_col).alias("text_hash"),
    )
    kept = keyed.join(gone, ["owner", "text_hash"], "left_anti")
    repeated = rows.groupBy("owner", "text_hash").count().where("count > 1").select("owner", "text_hash")
    if not repeated.isEmpty():
        # Rows that repeat both id and text: one of them stays.
        once = kept.join(repeated, ["owner", "text_hash"], "left_semi").dropDuplicates(["owner", "text_hash"])
        kept = kept.join(repeated, ["owner", "text_hash"], "left_anti").unionByName(once)
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


@query("op9_ngram_jaccard_join")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(tables.read(spark, sf_dir, "documents"), width=4, percent=85)
