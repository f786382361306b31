from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from corpusloom.llm import line_dedup, tables


def normal(line):
    return re.sub("[^a-z0-9\u0080-\U0010ffff]+", " ", line.lower()).strip(" ")


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def hashes(spark, items):
    df = spark.createDataFrame([(x,) for x in items], "w string")
    return {r["w"]: r["h"] for r in df.select("w", F.xxhash64("w").alias("h")).collect()}


def expected(spark, docs):
    """All pairs of normal forms."""
    lines = [(1 << 63 if i is None else i, t, at, normal(line)) for i, t in docs for at, line in enumerate(t.split("\n") if t is not None else [])]
    norms = sorted({n for *_, n in lines if n})
    parent = {n: n for n in norms}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(norms):
        for b in norms[:i]:
            most = int(0.2 * max(len(a), len(b)) + 1e-9)
            if find(a) != find(b) and abs(len(a) - len(b)) <= most and distance(a, b) <= most:
                parent[find(a)] = find(b)
    text_hash = hashes(spark, {t for _, t in docs if t is not None})
    first = {}
    for i, t, at, n in lines:
        if n:
            first[find(n)] = min(first.get(find(n), (i, text_hash[t], at)), (i, text_hash[t], at))
    gone = {}
    for i, t, at, n in lines:
        if n and first[find(n)] != (i, text_hash[t], at):
            gone.setdefault((i, t), set()).add(at)
    return gone


BASE = "the quick brown fox jumps over the lazy dog while seven wizards quietly make toxic brew for the evil queen and jack".split()


def fuzzy_docs():
    rng = random.Random(2)
    docs = []
    for i in range(60):
        lines = []
        for _ in range(rng.randrange(4)):
            words = [*BASE, *(f"w{k}" for k in range(25))]
            for _ in range(rng.randrange(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(["red", "blue", "green"])
            lines.append(" ".join(words))
        lines += [rng.choice(["Short line.", "short  LINE", "other!", "", "...", "a b", "b a", "é È", "12,3"]) for _ in range(2)]
        docs.append((i * 3 % 61, "\n".join(lines)))
    docs += [(None, docs[0][1]), (None, None), (200, ""), (201, "\n\n"), (5, docs[7][1]), (5, "fresh text\n" + docs[9][1]), (202, "x " * 3000 + "\n" + "y " * 5)]
    docs += [(203, " ".join(f"long{k}" for k in range(400))), (204, " ".join(f"long{k}" for k in range(1, 401)))]
    return docs


def check(spark, df, docs, gone_rows):
    want = expected(spark, docs)
    by_hash = hashes(spark, {t for _, t in docs if t is not None})
    got = {(r["owner"], r["text_hash"]): set(r["dropped"]) for r in gone_rows}
    clip = lambda i: min(i, line_dedup._LAST)
    assert got == {(clip(i), by_hash[t]): at for (i, t), at in want.items()}
    return want


def test_equals_brute_force(spark):
    docs = fuzzy_docs()
    df = spark.createDataFrame([(i, t, 1, "k", 2, None, 3) for i, t in docs], "doc_id long, text string, at int, node string, owner int, dropped int, `left` int")
    want = check(spark, df, docs, line_dedup.repeated_lines(df).collect())
    kept = line_dedup.drop_lines(df).collect()
    assert kept and list(kept[0].asDict()) == df.columns
    rest = []
    for i, t in docs:
        own = want.get((1 << 63 if i is None else i, t), set())
        text = t if not own else "\n".join(line for at, line in enumerate(t.split("\n")) if at not in own)
        if not own or normal(text):
            rest.append((i, text))
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=repr) == sorted(rest, key=repr)


def test_query_equals_brute_force(spark, tmp_path):
    """On whole documents of the given table, few enough for all pairs."""
    docs = [tuple(r) for r in tables.read(spark, "/root/testdata/sf0.001", "documents").where("n_chars < 1200").select("doc_id", "text").collect()][:60]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    want = check(spark, df, docs, line_dedup.repeated_lines(df).collect())
    rows = line_dedup.op1(spark, str(tmp_path)).collect()
    text = dict(docs)
    assert len(rows) == len(docs)
    for r in rows:
        assert r["n_lines"] == text[r["doc_id"]].count("\n") + 1
        assert set(r["dropped_lines"]) == want.get((r["doc_id"], text[r["doc_id"]]), set()) and r["n_dropped"] == len(r["dropped_lines"])


def test_normal_forms(spark):
    """The forms of lines, from whole texts and by themselves, are those of the plain rule."""
    texts = ["Ab, c!\n\n--\nD  É\u00a0x\r\n", None, "", "ab c", "\n\u4e2d\u6587 AB\n" + "q" * 9, "\t a\n b \n"]
    df = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "owner long, text_hash long, text string")
    got = sorted((r["owner"], r["at"], r["norm"]) for r in line_dedup._lines(df).collect())
    assert got == [(i, at, normal(line)) for i, t in enumerate(texts) for at, line in enumerate((t or "").split("\n")) if normal(line)]
    lines = spark.createDataFrame([(x,) for t in texts if t for x in t.split("\n")], "x string")
    assert all(r["n"] == normal(r["x"]) for r in lines.select("x", line_dedup.normal_form(F.col("x")).alias("n")).collect())


def test_blocks_are_votes_of_their_first_two_features(spark):
    """By a plain recomputation; another feature changes its own block only."""
    rng = random.Random(1)
    rows = [(sorted({rng.randrange(1 << 63) for _ in range(rng.choice([1, 2, 5, 40]))}),) for _ in range(30)]
    rows += [(sorted({*rows[-1][0], (3 << 60) + 5}),)]
    df = spark.createDataFrame(rows, "ranks array<long>").select("ranks", line_dedup.voters(F.col("ranks")).alias("two"))
    df = df.select("ranks", line_dedup.votes(F.col("two"), 2).alias("keys")).select("*", line_dedup.print_of(F.col("keys")).alias("print"))
    got = df.collect()
    vote = {}
    for ranks, keys, _ in got:
        own = {b: [r for r in sorted(ranks) if r >> 60 == b][:2] for b in range(8)}
        assert [k & 15 for k in keys] == [b for b in range(8) if own[b]] and all(k >> 4 & 3 == 2 for k in keys)
        for k in keys:
            two = own[k & 15]
            # Equal votes, and only those, have equal keys.
            assert vote.setdefault(k, two[0] & two[-1]) == two[0] & two[-1]
    for _, keys, prints in got:
        fields = [prints >> 7 * b & 127 for b in range(8)]
        assert [b for b in range(8) if fields[b]] == [k & 15 for k in keys]
    before, after = (dict((k & 15, k) for k in r["keys"]) for r in got[-2:])
    assert {b for b in range(8) if before.get(b) != after.get(b)} <= {3}


def pairs_looked_at(spark, docs, monkeypatch):
    seen = []
    real = line_dedup._verified
    monkeypatch.setattr(line_dedup, "_verified", lambda pairs, texts, s: seen.append(pairs.count()) or real(pairs, texts, s))
    rows = line_dedup.repeated_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    return sum(seen), {r["owner"]: set(r["dropped"]) for r in rows}


def test_a_template_gives_no_square_of_pairs(spark, monkeypatch):
    """Lines that share most words but are not alike, and copies among them that are."""
    rng = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randrange(4, 10)))
    common = [word() for _ in range(20)]
    docs = []
    for i in range(1000):
        own = [word() for _ in range(14)]
        docs.append((i, " ".join(x for pair in zip(common, own + [""] * 6) for x in pair if x)))
    for i in range(0, 100, 10):
        docs.append((2000 + i, docs[i][1] + " more"))
    n, gone = pairs_looked_at(spark, docs, monkeypatch)
    assert gone == {2000 + i: {0} for i in range(0, 100, 10)} and n < 20_000


def test_a_large_group_of_copies_is_linked_through_its_first(spark, monkeypatch):
    docs = [(i, f"one and the same sentence with a number in it that nobody reads to the end {i}") for i in range(400)]
    docs += [(1000 + i, f"quite another sentence, also with a number in it, which some read to the end {i}") for i in range(300)]
    n, gone = pairs_looked_at(spark, docs, monkeypatch)
    assert gone == {i: {0} for i in [*range(1, 400), *range(1001, 1300)]} and n < 30_000


def test_many_short_lines_that_meet(spark):
    """All that is left of many short lines is equal; groups are larger than any that all pairs are looked at of."""
    docs = [(0, "\n".join(f"{a}{b}23456789" for a in "abcdefg" for b in "hijklmn"))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r["owner"]: set(r["dropped"]) for r in line_dedup.repeated_lines(df).collect()} == without_bits(spark, docs)


def test_names_that_are_equal_by_chance_meet_only_their_equals(spark, monkeypatch):
    """Names of four bits: most lines share theirs with others."""
    docs = [(i, f"line of its own {i * 7919}") for i in range(60)] + [(100 + i, f"line of its own {i * 7919}") for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    real = tables.store

    def narrow(df, name, clean=False):
        return real(df.withColumn("node", F.col("node").bitwiseAND(F.lit(15))) if name == "lines" else df, name, clean)

    monkeypatch.setattr(line_dedup.tables, "store", narrow)
    monkeypatch.setattr(line_dedup, "alike_lines", lambda docs, nodes, s: spark.createDataFrame([(1, 1), (2, 1)], "node long, component long"))
    gone = {r["owner"] for r in line_dedup.repeated_lines(df).collect()}
    assert gone == set(range(100, 160))


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.drop_lines(df).count() == 0


def without_bits(spark, docs):
    """The classes of all pairs by edit similarity alone: the lines that go, by id."""
    lines = [(i, at, normal(line)) for i, text in docs for at, line in enumerate(text.split("\n"))]
    norms = sorted({n for *_, n in lines if n})
    parent = {n: n for n in norms}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(norms):
        for b in norms[:i]:
            most = int(0.2 * max(len(a), len(b)) + 1e-9)
            if abs(len(a) - len(b)) <= most and distance(a, b) <= most:
                parent[find(a)] = find(b)
    first, gone = {}, {}
    for i, at, n in sorted(lines):
        if n and first.setdefault(find(n), (i, at)) != (i, at):
            gone.setdefault(i, set()).add(at)
    return gone


def test_edit_similarity_decides_at_every_length(spark):
    """Pairs of lines far apart in SimHash bits: a mistyped letter, a changed word, words in and out."""
    rng = random.Random(11)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randrange(3, 10)))
    docs = [(0, "abcd\nabcde\nqrstuvwxyz\nqrstuvwx\nvwxyzklmnopqrs\nvwyzklmmopqrs")]
    for n in (2, 3, 5, 8, 12, 15, 20, 30, 45, 60):
        for _ in range(3):
            line = [word() for _ in range(n)]
            changed, typed = list(line), list(line)
            changed[rng.randrange(n)] = word()
            for at in rng.sample(range(n), max(1, n // 8)):
                typed[at] = typed[at][:1] + "0" + typed[at][2:]
            longer = line + ["more"] * (n >= 8)
            docs.append((len(docs), "\n".join(" ".join(x) for x in (line, changed, typed, longer))))
    want = without_bits(spark, docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r["owner"]: set(r["dropped"]) for r in line_dedup.repeated_lines(df).collect()} == want
    assert sum(map(len, want.values())) > 60


def links_by_blocks(spark, docs):
    """The alike pairs of nodes among all that agree in one block or more: ``(a, b, whether in two of a kind, or in a key of what is left of short lines)``."""
    df = line_dedup._keyed(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text")
    lines = line_dedup._lines(df)
    keys = {}
    for r in line_dedup.keyed_nodes(lines).collect():
        keys.setdefault(r["node"], set()).add(r["key"])
    names, pairs = sorted(keys), {}
    for i, b in enumerate(names):
        for a in names[:i]:
            kinds = [k >> 4 & 3 for k in keys[a] & keys[b]]
            if kinds:
                pairs[a, b] = 0 in kinds or any(kinds.count(kind) > 1 for kind in (1, 2, 3))
    texts = lines.select(F.xxhash64("norm").alias("node"), "norm").distinct()
    found = line_dedup._verified(spark.createDataFrame(list(pairs), "a long, b long"), texts, line_dedup.SIMILARITY).collect()
    return [(a, b, pairs[a, b]) for a, b in found]


def classes_of(spark, docs):
    df = line_dedup._keyed(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text")
    lines = line_dedup._lines(df).select(F.xxhash64("norm").alias("node"), F.struct("owner", "text_hash", "at").alias("first"))
    nodes = lines.groupBy("node").agg(F.min("first").alias("first"))
    return {r["node"]: r["component"] for r in line_dedup.alike_lines(df, nodes).collect()}


def test_no_link_of_large_groups_is_left_out(spark, monkeypatch):
    """Lines of a template with more or fewer words changed: most pairs agree in blocks that many lines have, some by no other block.

    Short lines that share what is left of them come in one large group; copies with other numbers are large classes that meet
    other large classes. Sides of few rows make many parts.
    """
    monkeypatch.setattr(line_dedup, "SIDE", 5, raising=False)
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randrange(4, 10)))
    common = [word() for _ in range(20)]
    texts = []
    for _ in range(150):
        own = [word() for _ in range(12)]
        texts.append(" ".join(x for pair in zip(common, own + [""] * 8) for x in pair if x))
        for n in (4, 5):
            changed = list(own)
            for at in rng.sample(range(12), n):
                changed[at] = word()
            texts.append(" ".join(x for pair in zip(common, changed + [""] * 8) for x in pair if x))
    own, other = [word() for _ in range(12)], [word() for _ in range(12)]
    for words in (own, other):
        texts += [" ".join([*common, *words, str(i)]) for i in range(60)]
    texts += [f"{a}{b}234567" for a in "abcdefg" for b in "hijklmn"] + [f"{a}234567" for a in "opqrstuvwxyz"]
    docs = list(enumerate(texts))
    links, got = links_by_blocks(spark, docs), classes_of(spark, docs)
    assert sum(two for _, _, two in links) > 300
    assert not [(a, b) for a, b, two in links if two and (a not in got or got[a] != got.get(b))]
    # What is connected is so by alike lines; of lines that agree in one block some are found as well.
    some = {n: n for n in got}

    def find(x):
        while some[x] != x:
            x = some[x]
        return x

    for a, b, _ in links:
        if a in got and b in got:
            low, high = sorted((find(a), find(b)))
            some[high] = low
    assert all(find(n) == find(component) for n, component in got.items())


def test_copies_that_are_one_class_give_no_keys_of_two_groups(spark, monkeypatch):
    """Large groups that one class has are not compared again."""
    line = "one and the same sentence with a number in it that nobody reads to the end"
    docs = [(i, f"{line} {i}") for i in range(40)]
    kept = {}
    real = tables.store

    def seen(df, name, clean=False):
        kept.setdefault(name, []).append(real(df, name, clean))
        return kept[name][-1]

    monkeypatch.setattr(line_dedup.tables, "store", seen)
    assert len(set(classes_of(spark, docs).values())) == 1
    assert [found.isEmpty() for found in kept["line-groups"]] == [False, True]
