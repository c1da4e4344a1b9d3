"""Substring, exact, near-duplicate and suffix deduplication against plain versions."""

import random
import re

import cases
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from hydroloom.llm import exact, simhash, substring, suffix
from hydroloom.llm.components import components


@pytest.mark.parametrize("limit", [0, 1_000_000])
def test_exact_groups(spark, monkeypatch, limit):
    monkeypatch.setattr(exact, "BROADCAST_ROWS", limit)
    rows = [r[:2] for r in cases.documents()] + [(100 + i, "Hot Text") for i in range(200)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    cases.same(exact.exact_groups(frame), cases.exact_groups(rows))


def test_exact_groups_of_nothing(spark):
    assert exact.exact_groups(cases.frame(spark, [])).count() == 0


def test_filters_merge_without_loss():
    random.seed(2)
    parts, want = [], {}
    for _ in range(5):
        values = np.array([random.choice([7, 9, 1 << 63, random.getrandbits(64)]) for _ in range(300)], np.uint64)
        for v in values.tolist():
            want[v] = want.get(v, 0) + 1
        own, counts = np.unique(values, return_counts=True)
        packed = exact.pack_filter(own, counts, 4)
        for block, runs, remainders, n in zip(*packed.values(), strict=True):
            parts.append((exact.unpack_block(block, runs, remainders, 4), np.frombuffer(n, np.int64)))
    values, counts = exact.merge_blocks(parts)
    assert dict(zip(values.tolist(), counts.tolist(), strict=True)) == want


def plain_sentences(text):
    """Sentences as lists of (word, piece of text), by loops over words."""
    out, own = [], []
    for piece in re.findall(r"\s*\S+\s*", text or ""):
        word = piece.strip()
        own.append((word.lower(), piece))
        if re.search(r"[.!?][\"')\]}”’»]*$", word) or "\n" in piece:
            out.append(own)
            own = []
    out += [own] if own else []
    units = []
    for sentence in out:
        if len(sentence) <= 16:
            units.append(sentence)
            continue
        marks = [xxhash.xxh3_64_intdigest(w) for w, _ in sentence]
        cuts = {max(range(i, i + 10), key=lambda k: (-marks[k], k)) + 1 for i in range(len(sentence) - 9)}
        edges = sorted(cuts | {0, len(sentence)})
        units += [sentence[a:b] for a, b in zip(edges, edges[1:])]
    return units


def plain_spans(units):
    def words(a, b):
        return sum(len(u) for u in units[a:b])

    found = set()
    for a in range(len(units)):
        ends = [b for b in range(a + 2, len(units) + 1) if words(a, b) >= 12]
        found |= {(a, ends[0])} if ends else set()
    for b in range(len(units) + 1):
        begins = [a for a in range(b - 1) if words(a, b) >= 12]
        found |= {(begins[-1], b)} if begins else set()
    return found


def plain_dedup(rows):
    """Every row's kept text: spans by their words, first places by id, hash of the text and position."""
    first, cut = {}, {}
    order = sorted({r[:2] for r in rows}, key=lambda r: (r[0] is not None, r[0] or 0, xxhash.xxh32_intdigest(r[1] or "")))
    for row in order:
        units = plain_sentences(row[1])
        gone = set()
        for a, b in sorted(plain_spans(units)):
            name = tuple(w for u in units[a:b] for w, _ in u)
            if first.setdefault(name, (row, a)) != (row, a):
                gone |= set(range(a, b))
        kept = "".join(p for k, u in enumerate(units) if k not in gone for _, p in u)
        cut[row] = (len(units), len(gone), kept if gone else row[1] or "")
    return [(r[0], *cut[r[:2]]) for r in rows]


def test_sentence_spans(spark, monkeypatch):
    p, q = (" ".join(f"{w}{i}." if i % 5 == 4 else f"{w}{i}" for i in range(30)) for w in "pq")
    rows = cases.documents() + [(r, t, None, None, 0, 0, "", 0) for r, t in ((1, p), (None, p), (None, "unlike " * 5), (7, q), (7, p), (7, "so"))]
    for slices in (2000, 3):
        monkeypatch.setattr(substring, "SLICE_DOCS", slices)
        cases.same(substring.dedup(cases.frame(spark, rows).coalesce(2)), plain_dedup(rows))
    got = plain_dedup(rows)
    assert ("miller" not in got[9][3] and got[9][3].startswith("Before.")) and (7, 6, 0, q) in got  # nothing unique goes with a shared id
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    cases.same(substring.dedup(spark.createDataFrame(docs, "doc_id long, text string")), plain_dedup(docs))
    assert substring.dedup(cases.frame(spark, [])).count() == 0


def test_long_sentences_are_deduplicated(spark):
    random.seed(14)
    words = [f"Word{i}" for i in range(5000)]
    passages = [random.choices(words, k=51) for _ in range(200)]
    rows, alone = [], " ".join(random.choices(words, k=80))
    for k, passage in enumerate(passages):
        for at in random.sample(range(1, 50), k % 3):  # sentences end inside of some
            passage[at] += "."
        for copy in range(2):
            around = [random.choices(words, k=random.randint(0, 30)) for _ in range(2)]
            rows.append((2 * k + copy, " ".join([*around[0], *passage, *around[1]])))
    rows += [(1000, alone), (1001, alone), (1002, "  ".join(alone.upper().split()))]
    got = {r["doc_id"]: r for r in substring.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for doc_id, text in rows[:-3]:
        assert "".join(substring.pieces_of(text)) == text
        assert (got[doc_id]["n_removed"] > 0) == (doc_id % 2 == 1)
    assert got[1000]["text"] == alone and got[1001]["text"] == got[1002]["text"] == ""


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_and_components(spark):
    rows = [r for r in cases.documents() if r[0] is not None]
    marks = {r[0]: plain_fingerprint(r[1]) for r in rows}
    ids = sorted(marks)
    links = [(a, b) for a in ids for b in ids if a < b and bin(marks[a] ^ marks[b]).count("1") <= 2]
    want = cases.components(ids, links)
    cases.same(simhash.near_duplicates(cases.frame(spark, rows)), [(r[0], f"{marks[r[0]]:016x}", want[r[0]]) for r in rows])
    assert simhash.near_duplicates(cases.frame(spark)).filter("component_id is null and doc_id is not null").count() == 0
    assert simhash.near_duplicates(cases.frame(spark, [])).count() == 0


def test_large_cells_lose_no_link(spark):
    random.seed(4)
    base, points = random.getrandbits(64), set()
    for _ in range(500):
        value = base
        for bit in random.sample(range(20), random.randint(0, 6)):
            value ^= 1 << bit * 3
        points.add(simhash.signed(value))
    unsigned = {p: p % (1 << 64) for p in points}
    ids = sorted(points)
    want = cases.components(ids, [(a, b) for a in ids for b in ids if a < b and bin(unsigned[a] ^ unsigned[b]).count("1") <= 2])
    found = components(simhash.links(spark.createDataFrame([(p,) for p in ids], "fp long"), 2, 5))
    got = {p: p for p in ids} | {r["u"]: r["v"] for r in found.collect()}
    assert got == want


def test_manhattan_distance_is_a_lower_bound(spark):
    random.seed(6)
    pairs = [(simhash.signed(random.getrandbits(64)), simhash.signed(random.getrandbits(64))) for _ in range(200)]
    frame = spark.createDataFrame(pairs, "a long, b long")
    row = frame.select(
        F.bit_count(simhash.embedding(F.col("a")).bitwiseXOR(simhash.embedding(F.col("b")))).alias("low"),
        F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).alias("high"), "a", "b",
    )
    for r in row.collect():
        counts = [[bin((v % (1 << 64)) >> 2 * s & 3).count("1") for s in range(32)] for v in (r["a"], r["b"])]
        assert r["low"] == sum(abs(x - y) for x, y in zip(*counts, strict=True)) <= r["high"]


def test_similar_groups(spark):
    random.seed(8)
    words = [f"w{i}" for i in range(3000)]
    rows, want = [], {}
    for group in range(6):
        base = random.choices(words, k=300)
        for copy in range(150 if group == 0 else 3):  # the first group fills large cells
            own = list(base)
            for at in random.sample(range(300), 3 if copy else 0):
                own[at] = random.choice(words)
            doc_id = len(rows)
            rows.append((doc_id, " ".join(own)))
            want.setdefault(group, []).append(doc_id)
    rows += [(900, None), (901, "lonely words here")]
    got = dict(tuple(r) for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    for ids in want.values():
        assert {got[i] for i in ids} == {min(ids)}
    assert got[900] == 900 and got[901] == 901


def plain_similar(rows):
    sets = {}
    for doc_id, text in rows:
        words = (text or "").encode().lower().split()
        sets[doc_id] = {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b]))]
    return cases.components(ids, links), links


@pytest.mark.parametrize("cell", [2, 64])
def test_similar_groups_lose_no_link(spark, monkeypatch, cell):
    monkeypatch.setattr(simhash, "CELL", cell)
    random.seed(12)
    words = [f"w{i}" for i in range(4000)]
    rows = []
    for group in range(60):
        base = random.choices(words, k=random.randint(60, 200))
        own, size = list(base), len(base)
        if group % 3 == 0:
            own += random.choices(words, k=size * 23 // 100)
        elif group % 3 == 1:
            own = own[: size * 82 // 100]
        else:
            for at in range(10, size - 10, 60):
                own[at] = "other"
        rows += [(2 * group, " ".join(base)), (2 * group + 1, " ".join(own))]
    want, links = plain_similar(rows)
    assert len(links) >= 50
    cases.same(simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")), list(want.items()))


def test_least_cells_is_a_bound(spark):
    random.seed(31)
    made = []
    for _ in range(3000):
        both, left, right = random.randint(1, 60), random.randint(0, 14), random.randint(0, 14)
        order = list(range(both + left + right))
        random.shuffle(order)
        a, b = sorted(order[: both + left]), sorted(order[:both] + order[both + left :])
        first = len(set(a[: len(a) // 5 + 1]) & set(b[: len(b) // 5 + 1]))
        if 9 * both >= 4 * (len(a) + len(b)):
            made.append((len(a), len(b), first))
    made.append((0, 0, 1))
    rows = spark.createDataFrame(made, "nu long, nv long, found long").withColumn("least", simhash.least_cells("nu", "nv")).collect()
    assert len(rows) > 500 and all(1 <= r["least"] <= r["found"] for r in rows)
    assert max(r["least"] for r in rows) > 4 and any(r["least"] == r["found"] for r in rows)


@pytest.mark.parametrize(("cell", "tile", "dense"), [(2, 512, 0), (2, 4, 1000), (2, 4, 1), (6, 512, 1000), (64, 512, 2)])
def test_open_cells_of_many_documents(spark, monkeypatch, cell, tile, dense):
    # Texts around one passage; the grid's groups are left out, so the exact step has all the work.
    for name, value in (("CELL", cell), ("TILE", tile), ("DENSE", dense)):
        monkeypatch.setattr(simhash, name, value)
    random.seed(5)
    words = [f"w{i}" for i in range(500)]
    passage = random.choices(words, k=40)
    rows = []
    for doc_id in range(90):
        own = passage + random.choices(words, k=random.choice((2, 4, 8, 40)))
        rows.append((doc_id, " ".join(own[random.choice((0, 0, 3)) :])))
    want, links = plain_similar(rows)
    assert 5 < len(set(want.values())) < 80
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = simhash.missing_links(docs, docs.select("doc_id", F.col("doc_id").alias("label")), simhash.wide_fingerprints(docs))
    assert cases.components(range(90), [tuple(r) for r in found.collect()]) == want


def test_points_of_many_dense_cells_are_sent_once(spark, monkeypatch):
    # 1-6 share three cells, 7-9 one with them; 20 and 21 another. Twelve rows in tiles become nine and the others stay.
    monkeypatch.setattr(simhash, "TILE", 100)
    cells = {1: range(1, 7), 2: range(1, 7), 3: range(1, 7), 4: (6, 7, 8, 9), 5: (20, 21)}
    rows = [(cell, len(ids), i, 100 + i) for cell, ids in cells.items() for i in ids]
    crowd = spark.createDataFrame(rows, "cell long, n long, doc_id long, label long")
    got = {tuple(r) for r in simhash._crowds(crowd).collect()}
    assert got == {(1, 9, i, 100 + i) for i in range(1, 10)} | {(20, 2, i, 100 + i) for i in (20, 21)}
    # A chain of cells that share one document each: together they would make more rows.
    monkeypatch.setattr(simhash, "TILE", 2)
    chain = [(cell, 3, 2 * cell + k, 0) for cell in range(1, 9) for k in range(3)]
    assert {tuple(r) for r in simhash._crowds(spark.createDataFrame(chain, crowd.schema)).collect()} == set(chain)


def test_few_sets_are_sent(spark, monkeypatch):
    # Long texts with a passage in common: pairs of them share cells, but too few for similar sets.
    random.seed(6)
    words = [f"w{i}" for i in range(5000)]
    passage = random.choices(words, k=120)
    rows = [(i, " ".join(passage + random.choices(words, k=2500 + i))) for i in range(40)]
    sent = []
    monkeypatch.setattr(simhash, "_sets_of", lambda docs, ids, real=simhash._sets_of: sent.append(ids.distinct().count()) or real(docs, ids))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = simhash.missing_links(docs, docs.select("doc_id", F.col("doc_id").alias("label")), simhash.wide_fingerprints(docs))
    assert found.count() == 0 and sent == [0]


@pytest.mark.parametrize("most", [2, 2_000_000])
def test_order_of_common_shingles(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "COMMON_ROWS", most)
    rows = [(i, "a b c d e" + (" f" if i < 8 else "") + (" g" if i < 6 else "")) for i in range(10)]
    names, counts = simhash.common_shingles(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(counts.tolist()) == ([8, 10] if most == 2 else [6, 8, 10]) and names.tolist() == sorted(names.tolist())


@pytest.mark.parametrize("cell", [1, 64])
def test_texts_without_words_are_linked(spark, monkeypatch, cell):
    # Each in a group of its own, as where other texts come first in all cells of the grid.
    monkeypatch.setattr(simhash, "CELL", cell)
    rows = [(1, ""), (2, " "), (3, None), (4, "\n\t"), (5, "one word"), (6, "another")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", F.col("doc_id").alias("label"))
    marks = simhash.wide_fingerprints(docs)
    found = [tuple(r) for r in simhash.missing_links(docs, labels, marks).collect()]
    assert cases.components(range(1, 7), found) == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 6}


def test_merged_transforms():
    random.seed(5)
    base = bytes(random.choices(b"ab \0", k=700))
    strings = []
    for _ in range(14):
        at = random.randint(0, 400)
        own = bytearray(base[at : at + random.randint(200, 500)])
        if random.random() < 0.6:
            own[random.randrange(len(own))] = 99
        strings.append(bytes(own))
    strings = list(dict.fromkeys([*strings, b"xyz" * 150]))
    windows = [s[i : i + 200] for s in strings for i in range(len(s) - 199)]
    for own, found in zip(strings, suffix.repeated_windows(strings), strict=True):
        assert found.tolist() == [windows.count(own[i : i + 200]) > 1 for i in range(len(own) - 199)]


@pytest.mark.parametrize("hot", [2, 2000])
def test_repeated_bytes(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix, "HOT_SEGMENTS", hot)
    rows = [r[:2] for r in cases.documents()]
    rows += [(60 + i, cases.PROSE[i : i + 230] + f" tail {i}") for i in range(12)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    cases.same(suffix.remove_repeats(frame), cases.without_repeats(rows))


def test_repeated_bytes_of_nothing(spark):
    assert suffix.remove_repeats(cases.frame(spark, [])).count() == 0


def test_similarities_of_sets():
    random.seed(9)
    sets = [np.unique(np.array(random.choices(range(300), k=random.randint(1, 200)), np.int64)) for _ in range(30)]
    sets += [np.zeros(0, np.int64), np.arange(5), np.arange(5)]
    got = simhash.jaccard(sets)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if i == j:  # a set with itself is not looked at
                continue
            union = len(set(a) | set(b))
            assert got[i, j] == pytest.approx(len(set(a) & set(b)) / union if union else 1.0)
