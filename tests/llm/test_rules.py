"""Quality rules against plain counts and a plain minimum covariance determinant."""

import collections
import itertools
import random
import re

import cases
import numpy as np

from hydroloom.llm import rules


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [line for line in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    doubled = sum(line in lines[:i] for i, line in enumerate(lines))
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), symbols, doubled, len(covered), failed


def test_counts_equal_plain_ones(spark):
    rows = cases.documents() + [(60, "a\x0bb\x0cc \x1c \x85 d\r\n\r\n e#*$%&|<>", "en", "s", 0, 0, "", 0), (61, "x y z x y z x", None, None, 0, 0, "", 0)]
    got = [tuple(r)[:7] for r in rules.judge(cases.frame(spark, rows)).collect()]
    assert sorted(got, key=cases.key) == sorted([(r[0], *plain_counts(r[1])) for r in rows], key=cases.key)
    assert rules.judge(cases.frame(spark, [])).count() == 0
    assert rules.judge(cases.frame(spark, rows).drop("lang", "source")).count() == len(rows)


def test_many_kinds_of_words_do_not_overflow():
    random.seed(1)
    codes = np.array([random.randrange(50) for _ in range(400)])
    assert rules.words_covered(codes, 50) == rules.words_covered(codes, 2**40)


def plain_shape(points, floors):
    """Exhaustive search for the half with the smallest determinant, then the reweighting step."""
    p, n = points.shape[1], len(points)
    half = min(n, (n + p + 1) // 2)
    best = min(
        (np.linalg.det(np.cov(points[list(own)].T, bias=True) * rules.consistency(half / n, p) + floors), own)
        for own in itertools.combinations(range(n), half)
    )[1]
    inner = points[list(best)]
    for share in (half / n, None):
        center, cov = inner.mean(axis=0), np.cov(inner.T, bias=True) * rules.consistency(share or rules.TRIM, p) + floors
        away = points - center
        far = np.einsum("ij,jk,ik->i", away, np.linalg.inv(cov), away)
        inner = points[far <= rules.chi2_quantile(rules.TRIM, p)]
    return far


def test_shapes_equal_an_exhaustive_search(spark):
    random.seed(3)
    rows, plain = [], {}
    floors = np.diag([(f * rules.UNIT) ** 2 for f in rules.FLOORS.values()])
    for source in ("a", None):
        points = np.array([[random.gauss(400, 150) for _ in rules.STATS] for _ in range(11)]).round()
        points[:3] += 4000
        plain[source] = plain_shape(points, floors)
        rows += [("en", source, k, *map(int, p)) for k, p in enumerate(points)]
    schema = "lang string, source string, k int, " + ", ".join(f"{v} long" for v in rules.VECTOR)
    frame = spark.createDataFrame(rows, schema)
    shapes = rules.robust_shapes(frame)
    for r in rules.placed(frame, shapes).collect():
        assert abs(r["distance"] - plain[r["source"]][r["k"]]) <= 1e-6 * max(1, r["distance"])


def test_outliers_of_a_language_and_source_go(spark):
    random.seed(5)
    vocabulary = ["".join(random.choices("abcdefgh", k=random.randint(2, 9))) for _ in range(3000)]
    rows = []
    for k in range(300):
        words = random.choices(vocabulary, k=random.randint(60, 400))
        if k % 10 == 0:  # symbols at two words of five; in the second source that is what all rows look like
            words = [w + "#$" * (i % 5 < 2) for i, w in enumerate(words)]
        rows.append((k, " ".join(words), "en", "one", 0, 0, "", 0))
        rows.append((1000 + k, " ".join(w + "#$" * (i % 5 < 2) for i, w in enumerate(words)), "en", "two", 0, 0, "", 0))
    kept = {r["doc_id"]: r["kept"] for r in rules.judge(cases.frame(spark, rows)).collect()}
    assert all(kept[k] == (k % 10 != 0) for k in range(300)) and all(kept[1000 + k] for k in range(300) if k % 10)
