"""Line dedup: fuzzy equal lines of all documents, by blocks of SimHashes and edit similarity. DataFrame operations alone.

1. A line is normalised: lower case, its runs of ASCII letters, digits and
   characters beyond ASCII joined by one space. Lines with equal normal forms are one node, named by a 64-bit hash.
2. A node's SimHash is made of blocks. Features of the line are dealt to the blocks by
   hash, and the first two of a block vote on it: a bit is set where both set it. A
   changed word spoils the blocks of its own features only, so by the pigeonhole
   principle lines agree in some blocks as long as their differences do not reach
   nearly all. Features are words in lines of ``WORDS_FROM`` characters or more, where
   short words count with the two after them and come last, and runs of characters in
   shorter ones; lengths where both occur have both. Below 15 characters, lines also
   have what is left without one character, or two.
3. Nodes that agree in two blocks are candidates, and so are short lines with an equal
   key. Those that agree in a block meet: in a group of at most ``GROUP`` nodes all pairs
   are looked at; in a larger one, of a common word or a template, all meet the first
   node. What is alike of these is connected first. Nodes in several larger groups also meet
   by the keys of every two of these blocks that several classes have, so a pair whose
   common groups are all large is found there, in the same way.
4. Edit similarity alone decides on a candidate: 1 - distance / length of the longer
   one, on normal forms, at least ``SIMILARITY``. Candidates that are connected through
   others by then are not compared. Of the groups of two blocks that are still too large,
   all pairs of nodes that are not connected yet are compared (``rest_links``); a connected
   class takes part by one line and its members' distances from it, and its members only
   where those leave a doubt. Nothing that agrees in two blocks is left out.
5. Of each connected group of lines the first occurrence stays, by document id
   and line number; the others go.

A group's pairs grow with its rows; with the square of its classes only where more than ``GROUP`` lines agree in two blocks
and are not alike.

Defined cases: a null text has no lines, an empty text one empty line; lines
with an empty normal form always stay; a null id counts as the largest; rows
of equal id and text are one document, and each of them keeps the same lines;
lines whose names are equal by chance (told by a second hash) meet only their equals;
only the id and text columns are read, others pass through ``drop_lines``; an
empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import tables
from corpusloom.llm.components import components
from corpusloom.llm.registry import query

SIMILARITY = 0.8
#: Lengths of lines, in characters, whose features are words; shorter words than ``LONG_WORD`` come last.
WORDS_FROM, LONG_WORD = 80, 6
#: Width of runs of characters, and the lengths of lines that have them: from, below.
RUNS = ((4, 12, 48), (5, 38, 120))
#: Lines of fewer characters have a key for every way to leave out as many characters as edits are allowed.
LEFT_OUT = 15
#: Blocks that features are dealt to.
BLOCKS = 8
#: Blocks that candidates agree in.
AGREE = 2
#: Nodes of a key that are all compared with each other.
GROUP = 16
#: Classes or members of a large group that one side of a block of comparisons has.
SIDE = 256
#: Bits of a print for each block.
_PRINT = 7
_LAST = (1 << 63) - 1
#: The low bits of a key: its kind (0: left out) and block.
_LOW = 63


# ---------------------------------------------------------------- lines and keys


def normal_form(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), r"[^a-z0-9\u0080-\x{10FFFF}]+", " "))


def _lines(docs: DataFrame) -> DataFrame:
    """``owner, text_hash, at, norm`` of every line whose normal form is not empty."""
    plain = F.regexp_replace(F.lower("text"), r"[^a-z0-9\u0080-\x{10FFFF}\n]+", " ")
    lines = docs.select("owner", "text_hash", F.posexplode(F.split(plain, "\n")).alias("at", "line"))
    return lines.select("owner", "text_hash", "at", F.trim("line").alias("norm")).where("norm <> ''")


def _rank(h: Column, later: bool) -> Column:
    """A hash as a rank: block in the top bits, then whether it votes only if others do not."""
    rest = F.shiftrightunsigned(h, 1)
    flag = F.lit(1 << 59)
    return rest.bitwiseOR(flag) if later else rest.bitwiseAND(F.lit(_LAST ^ (1 << 59)))


def word_ranks(words: Column) -> Column:
    """A rank for each word; short ones are hashed with the two after them. Give it a column."""
    in_context = lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))
    return F.transform(words, lambda w, i: F.when(F.length(w) < LONG_WORD, _rank(in_context(w, i), True)).otherwise(_rank(F.xxhash64(w), False)))


def run_ranks(norm: Column, width: int) -> Column:
    """A rank for each run of ``width`` characters."""
    at = F.sequence(F.lit(1), F.length(norm) - (width - 1))
    return F.transform(at, lambda i: _rank(F.xxhash64(F.substring(norm, i, F.lit(width))), False))


def _block(rank: Column) -> Column:
    return F.shiftright(rank, 60)


def voters(ranks: Column) -> Column:
    """Of sorted distinct ranks the first two of each block. Give it a column."""
    return F.filter(ranks, lambda x, i: (i < 2) | (_block(x) != _block(F.get(ranks, i - 2))))


def votes(two: Column, kind: int) -> Column:
    """A key for each block that has voters: their vote, its kind and its number. Give it a column."""

    def key(x: Column, i: Column) -> Column:
        after = F.get(two, i + 1)
        vote = F.when(_block(after) == _block(x), x.bitwiseAND(after)).otherwise(x)
        return F.xxhash64(vote, F.lit(kind)).bitwiseAND(F.lit(~_LOW)).bitwiseOR(_block(x) + 16 * kind)

    first = lambda x, i: (i == 0) | (_block(x) != _block(F.get(two, i - 1)))
    marked = F.transform(two, lambda x, i: F.when(first(x, i), key(x, i)))
    return F.filter(marked, lambda k: k.isNotNull())


def print_of(keys: Column) -> Column:
    """Some bits of each block side by side; 0 is a block without a vote."""

    def add(have: Column, k: Column) -> Column:
        small = F.shiftrightunsigned(k, 8) % ((1 << _PRINT) - 1) + 1
        return have.bitwiseOR(F.call_function("shiftleft", small, (k.bitwiseAND(F.lit(15)) * _PRINT).cast("int")))

    return F.aggregate(keys, F.lit(0).cast("long"), add)


def _agreeing(a: Column, b: Column) -> Column:
    """How many blocks two prints agree in."""
    differ = a.bitwiseXOR(b)
    fields = [F.lit(((1 << _PRINT) - 1) << (_PRINT * i)) for i in range(BLOCKS)]
    return reduce(Column.__add__, [F.when((differ.bitwiseAND(f) == 0) & (a.bitwiseAND(f) != 0), 1).otherwise(0) for f in fields])


def _without(norm: Column) -> Column:
    """A key for the line and for each way to leave out one character, or two if the edits allowed are two."""
    n = F.length(norm)
    one = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(norm, F.lit(1), i - 1), F.substring(norm, i + 1, n)))
    two = F.transform(
        F.sequence(F.lit(1), n - 1),
        lambda i: F.transform(
            F.sequence(i + 1, n),
            lambda j: F.concat(F.substring(norm, F.lit(1), i - 1), F.substring(norm, i + 1, j - i - 1), F.substring(norm, j + 1, n)),
        ),
    )
    none = F.array().cast("array<string>")
    left = F.concat(F.array(norm), F.when(n >= 5, one).otherwise(none), F.when(n >= 10, F.flatten(two)).otherwise(none))
    return F.transform(F.array_distinct(left), lambda x: F.xxhash64(x, F.lit(1)).bitwiseAND(F.lit(~_LOW)))


def keyed_nodes(lines: DataFrame) -> DataFrame:
    """``key, node, print, chars`` for each key of each node; ``print`` is that of the key's kind."""
    none = F.array().cast("array<long>")
    chars = F.col("chars")
    rows = lines.select(F.xxhash64("norm").alias("node"), "norm", F.length("norm").alias("chars"))
    rows = rows.withColumn("words", F.when(chars >= WORDS_FROM, F.split("norm", " "))).withColumn("ranks_1", word_ranks(F.col("words")))
    for number, (width, low, high) in enumerate(RUNS, 2):
        rows = rows.withColumn(f"ranks_{number}", F.when((chars >= low) & (chars < high), run_ranks(F.col("norm"), width)))
    kinds = range(1, len(RUNS) + 2)
    rows = rows.select(
        "node", "chars", F.when((chars >= 4) & (chars < LEFT_OUT), _without(F.col("norm"))).alias("keys_0"),
        *[F.sort_array(F.array_distinct(f"ranks_{k}")).alias(f"ranks_{k}") for k in kinds],
    )
    rows = rows.select("node", "chars", "keys_0", *[voters(F.col(f"ranks_{k}")).alias(f"two_{k}") for k in kinds])
    rows = rows.select(
        "node", "chars", "keys_0", *[votes(F.col(f"two_{k}"), k).alias(f"keys_{k}") for k in kinds]
    )
    keys = F.concat(*[F.coalesce(f"keys_{k}", none) for k in (0, *kinds)])
    prints = F.array(F.lit(0).cast("long"), *[print_of(F.coalesce(f"keys_{k}", none)) for k in kinds])
    rows = rows.select("node", F.struct(keys.alias("keys"), prints.alias("prints"), "chars").alias("of"))
    # A line that is repeated very often is one row of each task.
    nodes = rows.groupBy("node").agg(F.min("of").alias("of"))
    exploded = nodes.select(F.explode("of.keys").alias("key"), "node", "of.prints", "of.chars")
    kind = F.shiftright("key", 4).bitwiseAND(F.lit(3)).cast("int")
    return exploded.select("key", "node", F.get("prints", kind).alias("print"), "chars")


# ---------------------------------------------------------------- candidates


def groups(rows: DataFrame) -> DataFrame:
    """``rows`` of keys that several nodes have, with the first node of the key (``hub``), its print and length, and their number ``n``."""
    by_key = rows.repartition("key")
    first = F.min(F.struct("node", "print", "chars")).alias("hub")
    hubs = by_key.groupBy("key").agg(first, F.count("*").alias("n")).where("n > 1")
    return by_key.join(hubs, "key").select("key", "node", "print", "chars", "n", F.col("hub.node").alias("hub"), "hub.print", "hub.chars").toDF(
        "key", "node", "print", "chars", "n", "hub", "hub_print", "hub_chars"
    )


def _possible(key: str, a: tuple[str, str], b: tuple[str, str], similarity: float) -> Column:
    """Whether nodes with these prints and lengths can be candidates. Lengths drop no pair that is alike."""
    longer = F.greatest(a[1], b[1])
    near = F.abs(F.col(a[1]) - F.col(b[1])) <= (1 - similarity) * longer + 1e-9
    left_out = F.col(key).bitwiseAND(F.lit(48)) == 0
    return near & (left_out | (_agreeing(F.col(a[0]), F.col(b[0])) >= AGREE))


def pairs_of(found: DataFrame, similarity: float) -> DataFrame:
    """``a, b`` of the candidates of ``groups``, once for each key: the smaller node, the larger. Of large groups those with the first node."""
    with_hub = found.where("node <> hub").where(_possible("key", ("print", "chars"), ("hub_print", "hub_chars"), similarity))
    small = found.where(f"n > 2 AND n <= {GROUP} AND node <> hub").select("key", "node", "print", "chars")
    x, y = small.toDF("key", "a", "pa", "ca"), small.toDF("key", "b", "pb", "cb")
    others = x.join(y, "key").where("a < b").where(_possible("key", ("pa", "ca"), ("pb", "cb"), similarity))
    return with_hub.select(F.col("hub").alias("a"), F.col("node").alias("b")).unionByName(others.select("a", "b"))


def shared_keys(found: DataFrame, classes: DataFrame) -> DataFrame:
    """``key, node, print, chars``: a key for every two large groups that nodes of several classes are in by blocks of one kind.

    Nodes of one class that are in the same large groups are one set, and keys that only
    one class has are dropped before sets become nodes again: copies give one row for each two groups, not one for each copy.
    """
    large = found.where(f"n > {GROUP} AND key & 48 <> 0").join(classes, "node", "left")
    large = large.select("key", "node", "print", "chars", F.coalesce("component", "node").alias("class"))
    mixed = large.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low < high").select("key")
    kind = F.expr("key & 48").alias("kind")
    # A node has at most as many keys of a kind as there are blocks.
    of_node = large.join(mixed, "key").groupBy("node", kind, "print", "chars", "class").agg(F.sort_array(F.collect_set("key")).alias("keys"))
    of_node = tables.store(of_node.where("size(keys) > 1"), "line-shared", clean=True)
    sets = of_node.groupBy("class", "kind", "keys").agg(F.min("node").alias("set"))
    two = F.flatten(F.transform("keys", lambda k, i: F.transform(F.slice(F.col("keys"), 1, i), lambda before: F.xxhash64(before, k))))
    key = F.col("two").bitwiseAND(F.lit(~_LOW)).bitwiseOR(F.col("kind"))
    of_set = sets.withColumn("two", F.explode(two)).select(key.alias("key"), "set", "kind", "class").repartition("key")
    mixed = of_set.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low < high").select("key")
    named = of_node.join(sets, ["class", "kind", "keys"]).select("set", "kind", "node", "print", "chars")
    return of_set.join(mixed, "key").select("key", "set", "kind").join(named, ["set", "kind"]).select("key", "node", "print", "chars")


def _most(similarity: float, length: Column) -> Column:
    """The edits that lines may differ by, the longer one of this length."""
    return F.floor((1 - similarity) * length + 1e-9).cast("int")


def _alike() -> Column:
    """Whether the edit distance of ``norm_a`` and ``norm_b`` is small enough; far lengths are not compared.

    Most differ in words at the same places, which bounds their distance from above,
    or are a few characters apart, which a narrow band finds with less work.
    """
    words = "split(norm_a, ' '), split(norm_b, ' ')"
    replaced = f"zip_with({words}, (x, y) -> if(x = y, 0, greatest(length(x), length(y))))"
    return F.expr(
        f"""abs(length(norm_a) - length(norm_b)) <= most AND CASE
          WHEN coalesce(aggregate({replaced}, 0, (s, d) -> s + d) <= most, false) THEN true
          WHEN levenshtein(norm_a, norm_b, least(most, 16)) >= 0 THEN true
          WHEN most <= 16 THEN false
          WHEN levenshtein(norm_a, norm_b, least(most, 64)) >= 0 THEN true
          WHEN most <= 64 THEN false
          ELSE levenshtein(norm_a, norm_b, most) >= 0 END"""
    )


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    # Few bytes can be much work: these parts are not put together by their size.
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for side in ("a", "b"):
        pairs = pairs.repartition(parts, side).join(texts.select(F.col("node").alias(side), F.col("norm").alias(f"norm_{side}")).hint("merge"), side)
    most = _most(similarity, F.greatest(F.length("norm_a"), F.length("norm_b")))
    return pairs.withColumn("most", most).where(_alike()).select("a", "b")


def _apart(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Those of ``rows`` (a, b, ...) whose nodes are not connected."""
    for side in ("a", "b"):
        rows = rows.join(classes.select(F.col("node").alias(side), F.col("component").alias(f"{side}_class")), side, "left")
    return rows.where("a <> b and coalesce(a_class, a) <> coalesce(b_class, b)").drop("a_class", "b_class")


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``node, norm``: the normal form of one line of each name in ``wanted`` (owner, text_hash, at, node). Texts move once, by document."""
    of_doc = wanted.groupBy("owner", "text_hash").agg(F.collect_list(F.struct("at", "node")).alias("wanted"))
    found = docs.join(of_doc, ["owner", "text_hash"]).select(F.split("text", "\n").alias("lines"), "wanted")
    pick = F.transform("wanted", lambda w: F.struct(w["node"].alias("node"), F.get(F.col("lines"), w["at"]).alias("line")))
    return found.select(F.inline(pick)).select("node", normal_form(F.col("line")).alias("norm")).dropDuplicates(["node"])


def _crossed(x: DataFrame, y: DataFrame) -> DataFrame:
    """Rows of ``x`` and ``y`` of one key. Every two parts (``part`` of ``parts``) meet by themselves, so that no task has a whole group."""
    x = x.withColumn("part_y", F.explode(F.sequence(F.col("part"), F.col("parts") - 1))).withColumnRenamed("part", "part_x").drop("parts")
    y = y.withColumn("part_x", F.explode(F.sequence(F.lit(0), F.col("part")))).withColumnRenamed("part", "part_y").drop("parts")
    return x.join(y, ["key", "part_x", "part_y"])


def rest_links(rest: DataFrame, classes: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """``a, b``: the alike nodes of each group (``key, node``) that are in different classes; all pairs of a group's classes are compared.

    A class is compared by the line that it is named by first. No member is alike one of
    another class where the distance of the two classes' lines is more than the
    members' distances from theirs and the edits allowed together. Members of the other classes are compared by
    themselves. Nodes that share several groups are compared in the one of the smallest key.
    """
    rows = rest.join(classes, "node", "left").select("key", "node", F.coalesce("component", "node").alias("class"))
    several = rows.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low < high").select("key")
    rows = rows.join(several, "key")
    sizes = rows.groupBy("key", "class").agg(F.count("*").alias("n"))
    rows = rows.join(sizes, ["key", "class"])
    # A class's line is compared with each member once, not in each group.
    of_node = rows.groupBy("node", "class").agg(F.sort_array(F.collect_set("key")).alias("keys"), F.max("n").alias("most_n"))
    of_node = of_node.join(texts, "node").join(texts.select(F.col("node").alias("class"), F.col("norm").alias("head")), "class")
    # Far from the class's line, a member has no distance, and its class no radius.
    apart = "CASE WHEN levenshtein(norm, head, 8) >= 0 THEN levenshtein(norm, head, 8) ELSE levenshtein(norm, head, 32) END"
    distance = F.when((F.col("most_n") == 1) | (F.col("node") == F.col("class")), 0).otherwise(F.expr(apart))
    of_node = tables.store(of_node.select("node", "norm", "head", "keys", distance.alias("distance")), "line-members", clean=True)
    rows = rows.join(of_node, "node").withColumn("parts", F.ceil(F.col("n") / SIDE).cast("int"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    length = F.length("norm")
    single, far = F.count("*") == 1, F.min("distance") < 0
    heads = rows.groupBy("key", "class").agg(
        # A node that is the only one of its class stands for itself.
        F.struct(F.when(single, F.min("norm")).otherwise(F.min("head")).alias("norm"), F.when(single, F.min("keys")).alias("keys")).alias("head"),
        F.when(single, 0).when(~far, F.max("distance")).alias("radius"),
        F.max(length).alias("longest"), F.min(length).alias("shortest"), F.max("parts").alias("member_parts"), F.count("*").alias("n"),
    )
    number = heads.groupBy("key").agg(F.ceil(F.count("*") / SIDE).cast("int").alias("parts"))
    heads = heads.join(number, "key").withColumn("part", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int"))
    sides = [
        heads.select("key", "part", "parts", *[
            F.col(c).alias(f"{c.split('.')[-1]}_{side}") for c in ("class", "head.norm", "head.keys", "radius", "longest", "shortest", "member_parts", "n")
        ])
        for side in ("x", "y")
    ]
    met = _crossed(*sides).where("part_x < part_y or class_x < class_y")
    most = _most(similarity, F.greatest("longest_x", "longest_y"))
    met = met.where(F.greatest("shortest_x", "shortest_y") - F.least("longest_x", "longest_y") <= most)
    # Two single nodes meet once.
    met = met.where("n_x > 1 or n_y > 1 or key = array_min(array_intersect(keys_x, keys_y))")
    met = met.withColumn("bound", most + F.col("radius_x") + F.col("radius_y"))
    met = met.where("bound is null or levenshtein(norm_x, norm_y, bound) >= 0")
    met = met.select("key", "class_x", "class_y", "member_parts_x", "member_parts_y")
    met = met.withColumn("part_x", F.explode(F.sequence(F.lit(0), F.col("member_parts_x") - 1)))
    met = met.withColumn("part_y", F.explode(F.sequence(F.lit(0), F.col("member_parts_y") - 1)))
    for side, name in (("x", "a"), ("y", "b")):
        members = rows.select("key", F.col("class").alias(f"class_{side}"), F.col("part").alias(f"part_{side}"), F.col("node").alias(name), F.col("norm").alias(f"norm_{name}"), F.col("keys").alias(f"keys_{name}"))
        met = met.join(members, ["key", f"class_{side}", f"part_{side}"])
    met = met.where("key = array_min(array_intersect(keys_a, keys_b))")
    met = met.withColumn("most", _most(similarity, F.greatest(F.length("norm_a"), F.length("norm_b"))))
    return met.where(_alike()).select("a", "b")


def alike_lines(docs: DataFrame, nodes: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``node, component`` of the connected groups of alike lines; ``nodes`` has the first place of each."""
    found = tables.store(groups(keyed_nodes(_lines(docs))), "line-groups", clean=True)
    # Nodes of two large groups may meet by both of them later.
    large = found.where(f"n > {GROUP} AND key & 48 <> 0").groupBy("node", F.expr("key & 48")).agg(F.count("*").alias("n")).where("n > 1")
    pairs = pairs_of(found, similarity).groupBy("a", "b").agg(F.count("*").alias("keys"))
    pairs = tables.store(pairs, "line-pairs", clean=True)
    left_out = found.where(f"key & 48 = 0 AND n > {GROUP}").select("key", "node")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).union(left_out.select("node")).union(large.select("node")).distinct()
    texts = _texts(docs, nodes.join(wanted, "node", "left_semi").select("node", "first.*"))
    texts = tables.store(texts, "line-texts", clean=True)
    # Each node and the one it met by most keys: these pairs connect most of what is alike.
    nearest = pairs.groupBy("b").agg(F.max(F.struct("keys", "a")).alias("best")).select("best.a", "b")
    links = tables.store(_verified(nearest, texts, similarity), "line-links", clean=True)
    classes = tables.store(components(links), "line-classes")
    by_two = tables.store(groups(shared_keys(found, classes)), "line-groups", clean=True)
    rest = by_two.where(f"n > {GROUP}").select("key", "node").unionByName(left_out)
    pairs = pairs.select("a", "b").union(pairs_of(by_two, similarity)).distinct()
    more = tables.store(_verified(_apart(pairs, classes), texts, similarity), "line-links", clean=True)
    if not more.isEmpty():
        links = links.union(more)
        classes = tables.store(components(links), "line-classes")
    if rest.isEmpty():
        return classes
    more = tables.store(rest_links(rest, classes, texts, similarity), "line-links", clean=True)
    return classes if more.isEmpty() else tables.store(components(links.union(more)), "line-classes")


# ---------------------------------------------------------------- the operator


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("owner"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text")
    )


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``owner, text_hash, dropped``: the numbers of the lines that go, for documents that lose any; ``owner`` is the id, null the largest."""
    docs = _keyed(docs, id_col, text_col)
    named = _lines(docs).select("owner", "text_hash", "at", F.xxhash64("norm").alias("node"), F.xxhash64("norm", F.lit(1)).alias("check"))
    lines = tables.store(named, "lines")
    here = F.struct("owner", "text_hash", "at")
    nodes = lines.groupBy("node").agg(F.min(here).alias("first"), F.count("*").alias("n"), F.min("check").alias("low"), F.max("check").alias("high"))
    nodes = tables.store(nodes, "line-nodes", clean=True)
    mixed = nodes.where("low < high").select("node")
    classes = alike_lines(docs, nodes, similarity)
    # Lines that are alone take no further part.
    of_class = nodes.where("low = high").join(classes, "node", "left").where("n > 1 or component is not null")
    of_class = of_class.select("node", "first", F.coalesce("component", "node").alias("class"))
    kept = of_class.groupBy("class").agg(F.min("first").alias("kept"))
    kept = of_class.join(kept, "class").select("node", "kept")
    found = lines.select("owner", "text_hash", "at", "node").join(kept, "node")
    alone = lines.join(mixed, "node")
    alone = alone.join(alone.groupBy("node", "check").agg(F.min(here).alias("kept")), ["node", "check"])
    found = found.select("owner", "text_hash", "at", "kept").union(alone.select("owner", "text_hash", "at", "kept"))
    gone = found.where((F.col("kept.owner") != F.col("owner")) | (F.col("kept.text_hash") != F.col("text_hash")) | (F.col("kept.at") != F.col("at")))
    return tables.store(gone.groupBy("owner", "text_hash").agg(F.sort_array(F.collect_set("at")).alias("dropped")), "dropped-lines", clean=True)


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The documents, all columns, without repeated lines; those that lose every line with letters or digits go."""
    gone = repeated_lines(docs, id_col, text_col, similarity)
    text = F.col(f"row.{text_col}")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("owner"),
        F.xxhash64(text_col).alias("text_hash"),
    ).join(gone, ["owner", "text_hash"], "left")
    left = F.filter(F.split(text, "\n"), lambda line, i: ~F.array_contains(F.col("dropped"), i))
    rows = rows.withColumn("left", F.when(F.col("dropped").isNotNull(), F.array_join(left, "\n")))
    rows = rows.where("left is null").unionByName(rows.where(F.col("left").rlike(r"[A-Za-z0-9\u0080-\x{10FFFF}]")))
    return rows.select(*[(F.coalesce("left", text) if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


@query("op1_line_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: number of lines, of dropped lines, and the dropped lines' numbers."""
    docs = tables.read(spark, sf_dir, "documents")
    gone = repeated_lines(docs)
    rows = docs.select(
        "doc_id", F.coalesce(F.col("doc_id"), F.lit(_LAST)).alias("owner"), F.xxhash64("text").alias("text_hash"),
        F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"),
    )
    return rows.join(gone, ["owner", "text_hash"], "left").select(
        "doc_id", "n_lines", F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped_lines"),
    )
