"""Exact, near and line dedup against brute force."""

import os
import random
import time

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import components, exact_dedup, lines, simhash

SCHEMA = "doc_id long, text string, id string, row int, lang string"


def frame(spark, texts):
    """Rows with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "x", 1, None) for i, t in texts], SCHEMA)


def root(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def test_exact_groups(spark):
    texts = [(1, "Abc"), (2, "aBC"), (3, "abc"), (4, ""), (5, None), (6, "É"), (7, "é"), (8, "x" * 300_000), (9, "x" * 300_000), (10, "abc "), (3, "abc")]
    got = {r.id: r for r in exact_dedup.exact_dedup(frame(spark, texts)).collect()}
    assert len(got) == 10
    assert exact_dedup.exact_dedup(frame(spark, texts)).count() == 11
    assert [got[i].keep_id for i in range(1, 11)] == [3, 3, 3, 5, 5, 6, 7, 9, 9, 10]
    assert got[1].group_size == 4 and got[3].kept and not got[2].kept
    kept = exact_dedup.keep_first(frame(spark, texts))
    assert kept.columns == ["doc_id", "text", "id", "row", "lang"]
    assert sorted(r.doc_id for r in kept.collect()) == [3, 5, 6, 7, 9, 10]


def test_exact_empty_and_null_ids(spark):
    assert exact_dedup.exact_dedup(frame(spark, [])).count() == 0
    got = exact_dedup.exact_dedup(frame(spark, [(None, "a"), (None, "a"), (1, "b")])).collect()
    assert sorted((r.id is None, r.group_size, r.kept) for r in got) == [(False, 1, True), (True, 2, True), (True, 2, True)]
    kept = exact_dedup.keep_first(frame(spark, [(None, "a"), (None, "a"), (1, "b"), (1, "c"), (1, "c"), (2, "C"), (2, "C")]))
    assert sorted(map(str, [(r.doc_id, r.text) for r in kept.collect()])) == sorted(map(str, [(None, "a"), (1, "b"), (2, "C")]))


def test_exact_dedup_agrees_with_its_sql_on_repeated_rows(spark):
    import duckdb

    from tidemark.llm import queries

    rows = [(1, "a"), (1, "a"), (2, "A"), (3, "b"), (4, None), (5, "")]
    c = duckdb.connect()
    c.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = sorted(c.sql(queries.ORACLE["op6_exact_dedup"]).fetchall())
    got = exact_dedup.exact_dedup(frame(spark, rows)).select("id", "keep_id", "group_size", "kept", "text_sha256")
    assert sorted(map(tuple, got.collect())) == want


def test_hot_keys(spark):
    """A third of the rows with one text, one fingerprint and one hub of links: the same result as for few."""
    texts = [(i, "the same text again and again" if i % 3 else f"text number {i} of many with words {i * i}") for i in range(600)]
    got = exact_dedup.exact_dedup(frame(spark, texts)).collect()
    assert len(got) == 600 and {r.group_size for r in got} == {1, 400} and sum(r.kept for r in got) == 201
    groups = simhash.near_groups(frame(spark, texts)).collect()
    assert len(groups) == 600 and {r.component_id for r in groups if r.id % 3} == {1}
    links = [(0, i) for i in range(1, 500)] + [(i, i + 1) for i in range(500, 520)]
    labels = {r.node: r.component for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert labels == {i: 0 if i < 500 else 500 for i in range(521)}


def fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_groups_match_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(500)]
    texts = []
    for i in range(0, 300, 3):
        base = rng.choices(words, k=rng.choice([1, 2, 3, 40, 200]))
        near = list(base)
        near[rng.randrange(len(near))] = "changed"
        texts += [(i, " ".join(base)), (i + 1, " ".join(near)), (i + 2, "  ".join(base).upper())]
    texts += [(900, None), (901, ""), (902, " \t\n"), (903, "a b c " * 9000)]
    fps = {i: fingerprint(t) for i, t in texts}
    parent = {i: i for i in fps}
    ids = list(fps)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if bin(fps[a] ^ fps[b]).count("1") <= 3:
                ra, rb = root(parent, a), root(parent, b)
                parent[max(ra, rb)] = min(ra, rb)
    got = {r.id: r for r in simhash.near_groups(frame(spark, texts)).collect()}
    assert {i: r.fp % 2**64 for i, r in got.items()} == fps
    assert {i: r.component_id for i, r in got.items()} == {i: root(parent, i) for i in fps}
    kept = simhash.keep_representatives(frame(spark, texts))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({root(parent, i) for i in fps})
    assert simhash.near_groups(frame(spark, [])).count() == 0


@pytest.mark.parametrize(("distance", "cell"), [(1, 4096), (3, 8), (4, 4096), (5, 4096)])
def test_anchors_lose_no_link(spark, distance, cell):
    rng = np.random.default_rng(distance)
    base = rng.integers(0, 2**64, size=40, dtype=np.uint64)
    near = [int(x) ^ sum(1 << int(b) for b in rng.choice(64, size=distance, replace=False)) for x in np.repeat(base, 6)]
    fps = sorted({*map(int, base), *near, 0, 2**64 - 1})
    df = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in fps], "fp long")
    links = simhash.near_links(df, distance, cell).collect()
    assert all(bin((r.a ^ r.b) % 2**64).count("1") <= distance for r in links)
    parent = {x: x for x in fps}
    brute = dict(parent)
    for r in links:
        a, b = root(parent, r.a % 2**64), root(parent, r.b % 2**64)
        parent[max(a, b)] = min(a, b)
    for k, a in enumerate(fps):
        for b in fps[k + 1 :]:
            if bin(a ^ b).count("1") <= distance:
                ra, rb = root(brute, a), root(brute, b)
                brute[max(ra, rb)] = min(ra, rb)
    assert {x: root(parent, x) for x in fps} == {x: root(brute, x) for x in fps}


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, None)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = {x: x for a, b in links if b is not None for x in (a, b)}
    for a, b in links:
        if b is not None:
            ra, rb = root(parent, a), root(parent, b)
            parent[max(ra, rb)] = min(ra, rb)
    assert all(root(parent, x) == c for x, c in got.items())
    assert all(x in got for a, b in links if b is not None and a != b for x in (a, b))
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_marks_of_many_links_do_not_overflow(spark):
    rows = spark.range(2000).select(F.col("id").alias("a"), F.col("id").alias("b")).where(F.xxhash64("a", "b") > 0)
    mark = components._mark(rows)
    assert mark[0] > 900 and mark == components._mark(rows.orderBy(F.desc("a")))
    assert mark != components._mark(rows.withColumn("b", F.col("b") + (F.col("a") == rows.first().a).cast("int")))


def test_fuzzy_lines(spark):
    rng = random.Random(2)
    line = " ".join(f"word{rng.randrange(900)}" for _ in range(400))
    near = line.replace(line.split()[30], "other", 1)
    docs = [(1, f"{line}\nshort one"), (2, f"{near}\nshort one"), (3, f"** {line.upper()} **"), (4, "quite another line with many words\n\nquite another line with many words"), (5, None), (6, "")]
    groups = lines.line_groups(frame(spark, docs)).collect()
    assert sorted((r.id, r.line_no) for r in groups if r.kept) == [(1, 0), (4, 0)]
    assert len({r.group for r in groups}) == 2 and len(groups) == 5
    left = {r.doc_id: r.text for r in lines.dedup_lines(frame(spark, docs)).collect()}
    assert left == {1: f"{line}\nshort one", 2: "short one", 3: "", 4: "quite another line with many words\n", 5: None, 6: ""}
    assert lines.line_groups(frame(spark, [])).count() == 0


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_fuzzy_lines_find_what_brute_force_finds(spark):
    """Lines with words replaced up to the edits that 0.8 allows, at exactly 0.8 too, are all linked, and nothing else is."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randrange(2, 10)))
    texts = []
    for n in [6, 9, 14, 20, 30] * 12:
        line = [word() for _ in range(n)]
        near, budget = list(line), int(len(" ".join(line)) * 0.2)
        for k in rng.sample(range(n), n):
            new = word()
            if max(len(new), len(near[k])) <= budget:
                budget -= max(len(new), len(near[k]))
                near[k] = new
        texts += [" ".join(line), " ".join(near)]
    texts += ["abcd efgh ijkl mnop qrst uvwx yzab cdef ghij klmn op", "abcd efgh ijkl mnop qrst uvwx yzab cdef 1234 5678 90"]
    got = lines.line_groups(frame(spark, list(enumerate(texts)))).collect()
    group = {r.id: r.group for r in got}
    parent = {i: i for i in range(len(texts))}
    links = 0
    for i, a in enumerate(texts):
        for j in range(i):
            b = texts[j]
            if 5 * abs(len(a) - len(b)) <= max(len(a), len(b)) and 5 * edits(a, b) <= max(len(a), len(b)):
                links += 1
                x, y = root(parent, i), root(parent, j)
                parent[max(x, y)] = min(x, y)
    assert links >= 60
    assert len(set(group.values())) == len({root(parent, i) for i in parent})
    assert all((group[i] == group[j]) == (root(parent, i) == root(parent, j)) for i in parent for j in range(i))


def test_short_lines_group_by_equality(spark):
    docs = [(1, "All rights reserved.\nquite another line with many words"), (2, "all rights reserved\nall rights deserved"), (3, "** All Rights Reserved **\n\nword")]
    groups = lines.line_groups(frame(spark, docs), exact_words=1).collect()
    assert sorted((r.id, r.line_no, r.kept) for r in groups) == [(1, 0, True), (1, 1, True), (2, 0, False), (2, 1, True), (3, 0, False), (3, 2, True)]
    left = {r.doc_id: r.text for r in lines.dedup_lines(frame(spark, docs), exact_words=1).collect()}
    assert left == {1: docs[0][1], 2: "all rights deserved", 3: "\nword"}


def test_crowded_blocks_lose_no_pair(spark):
    """Lines that share their longest words, more than a cell holds, are in one block; every two similar ones are linked."""
    rng = random.Random(5)
    word = lambda low, high: "".join(rng.choices("abcdefghijklmnopqrst", k=rng.randrange(low, high)))
    common = " ".join(word(16, 17) for _ in range(12))
    texts = []
    for _ in range(lines.CELL):
        own = [word(5, 8) for _ in range(22)]
        texts += [f"{common} {' '.join(own)}", f"{common} {' '.join(w[:2] + rng.choice('123') + w[3:] for w in own)}"]
    groups = {r.id: r.group for r in lines.line_groups(frame(spark, list(enumerate(texts)))).collect()}
    assert all(groups[i] == groups[i + 1] for i in range(0, len(texts), 2))
    apart = all(edits(texts[0], texts[i]) > 0.2 * max(len(texts[0]), len(texts[i])) for i in range(2, len(texts), 2))
    assert apart and len(set(groups.values())) > lines.CELL // 2


def test_letters_and_fewer_letters_reject_no_link(spark):
    """_verified agrees with the edit distance on pairs about the limit, of lines with other letters too."""
    rng = random.Random(6)
    texts = []
    for k in range(120):
        letters = rng.choice(["etano ", "abcdefghijklmnopqrstuvwxyz  ", "éèàñß eatno", "xyz 1"])
        a = rng.choices(letters, k=rng.randrange(10, 80))
        b = list(a)
        for _ in range(int(len(a) * 0.2) + rng.randrange(-2, 9)):
            at = rng.randrange(len(b))
            b[at : at + rng.randrange(2)] = rng.choices(letters, k=rng.randrange(2))
        texts += ["".join(a), "".join(b)]
    rows = spark.createDataFrame(list(enumerate(texts)), "key long, norm string")
    pairs = spark.createDataFrame([(i, i + 1) for i in range(0, len(texts), 2)], "a long, b long")
    near = {r.a for r in lines._verified(pairs, rows, lines.SIMILARITY).collect()}
    right = {i for i in range(0, len(texts), 2) if edits(texts[i], texts[i + 1]) <= int(max(len(texts[i]), len(texts[i + 1])) * 0.2 + 1e-9)}
    assert near == right and 20 < len(right) < 110


def test_pairs_far_apart_are_refused_before_their_words_are_compared(spark, monkeypatch):
    """_verified with unlike agrees with the edit distance, and hands few of many lines that are far apart to the later steps."""
    rng = random.Random(7)
    near = ["".join(rng.choices("abcdefghijklmnopqrst ", k=60)) for _ in range(20)]
    far = ["".join(rng.sample("abcdefghijklmnopqrst  " * 3, 66)) for _ in range(200)]
    texts = [t for a in near for t in (a, a[:20] + "xyz" + a[24:])] + far
    rows = spark.createDataFrame(list(enumerate(texts)), "key long, norm string")
    pairs = spark.createDataFrame([(i, i + 1) for i in range(0, len(texts), 2)], "a long, b long")
    judged, written = [], lines.written
    monkeypatch.setattr(lines, "written", lambda df, *a: (table := written(df, *a), "near" in df.columns and judged.append(table.count()))[0])
    got = {r.a for r in lines._verified(pairs, rows, lines.SIMILARITY, unlike=True).collect()}
    right = {i for i in range(0, len(texts), 2) if 5 * edits(texts[i], texts[i + 1]) <= max(len(texts[i]), len(texts[i + 1]))}
    assert got == right and len(right) >= 20
    assert judged[0] < 60


def test_repeats_and_crowds_do_not_fill_the_disk(spark, monkeypatch):
    """Blocks are made once a line, tables and shuffle files go, and pairs that their letters refuse are not written."""
    rng = random.Random(9)
    word = lambda letters, low, high: "".join(rng.choices(letters, k=rng.randrange(low, high)))
    common = " ".join(word("abcdefghijklm", 16, 17) for _ in range(8))
    crowd = [f"{common} {' '.join(word(c, 5, 8) for _ in range(22))}" for c in "abcdefghijklmnopqrst"]
    near = [[word("abcdefghijklmnopqrst", 4, 9) for _ in range(14)] for _ in range(6)]
    texts = [t for w in near for t in (" ".join(w), " ".join([*w[:5], "other", *w[6:]]))] + crowd
    docs = frame(spark, [(i, "\n".join(texts)) for i in range(8)]).repartition(4)
    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()

    def shuffled():
        files = env.blockManager().diskBlockManager().getAllFiles().iterator()
        return {f.getName() for f in iter(lambda: files.next() if files.hasNext() else None, None) if f.getName().endswith(".data")}

    tables, written, here, pairs = {}, lines.written, [], []

    def told(df, *a):
        table = written(df, *a)
        tables[",".join(sorted(df.columns))] = (table.inputFiles()[0].removeprefix("file://"), table.count(), table.distinct().count())
        pairs.extend([table.count()] if df.columns == ["a", "b"] else [])
        here.append({k for k, (path, *_) in tables.items() if os.path.exists(path)})
        return table

    monkeypatch.setattr(lines, "written", told)
    for name, value in {"SLICE": 4, "SHARE": 1000, "BROADCAST_ROWS": 0}.items():
        monkeypatch.setattr(lines, name, value, raising=False)
    before = shuffled()
    found = lines.line_groups(docs)
    for _ in range(100):
        if not (left := shuffled() - before):
            break
        time.sleep(0.1)
    monkeypatch.undo()
    rows = found.collect()
    group = {r.line_no: r.group for r in rows}
    assert len(rows) == 8 * len(texts) and sum(r.kept for r in rows) == len(set(group.values())) == len(texts) - 6
    assert all(group[i] == group[i + 1] for i in range(0, 12, 2))
    posts = tables["bucket,key,length"]
    assert posts[1] == posts[2] <= 22 * len(texts)
    assert max(pairs) < len(crowd)
    assert all("bucket,key,length" not in x for x in here if "bucket,component,key" in x)
    assert not left


def test_packed_letters_bound_as_counted_ones(spark):
    """_within_letters is the bound by counts of each letter, also of other letters and of more than are counted."""
    rng = random.Random(10)
    texts = ["e" * 3000 + "xyz", "e" * 9000 + "xy", "é" * 40, "", "a" * 2730 + "b" * 700, "b" * 2730 + "a" * 700]
    texts += ["".join(rng.choices(rng.choice(["etano ", "abcdefghijklmnopqrstuvwxyz  ", "éèàñß eatno"]), k=rng.randrange(10, 60))) for _ in range(60)]

    def counts(t):
        own = [t.count(c) for c in lines.COUNTED]
        return [min(n, lines.MOST_COUNTED) for n in [*own, len(t) - sum(own)]]

    letters = lines._letters(spark.createDataFrame(list(enumerate(texts)), "key int, norm string"))
    one, other = (letters.select(*(F.col(x).alias(p + x) for x in letters.columns)) for p in ("", "other_"))
    got = {(r.key, r.other_key) for r in one.crossJoin(other).where(lines._within_letters("", "other_", lines.SIMILARITY)).collect()}
    want = set()
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            more = sum(max(0, m - n) for m, n in zip(counts(a), counts(b), strict=True))
            if more + max(0, len(b) - len(a)) <= int(max(len(a), len(b)) * 0.2 + 1e-9):
                want.add((i, j))
    assert got == want and len(texts) < len(want) < len(texts) ** 2 // 2
