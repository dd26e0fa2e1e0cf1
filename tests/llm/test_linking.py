"""Linking in hard lists: hubs, chains, mutually unlike rows, groups of copies, near misses; against brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import lines, minhash

WORDS = [f"{a}{b}" for a in "ka lo mi ne su ra to vi pe dro".split() for b in "ban dur fel gos hin ster mu".split()]


def families(seed, width):
    r = random.Random(seed)
    texts = []
    for f in range(4):
        base = [r.choice(WORDS) + str(r.randrange(50)) for _ in range(60)]
        texts.append(" ".join(base))
        for _ in range(25):  # near copies and near misses: some words are replaced, dropped, or a common passage is added
            w = list(base)
            for _ in range(r.randrange(1, 9 if width == 2 else 4)):
                w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
            if r.random() < 0.4:
                at = r.randrange(50)
                del w[at : at + r.randrange(1, 12)]
            if r.random() < 0.4:
                w += [f"tail{f}x{i}" for i in range(r.randrange(5, 18))]
            texts.append(" ".join(w))
    passage = [f"pass{i}" for i in range(40)]
    texts += [" ".join(passage + [f"own{j}x{i}" for i in range(r.randrange(20, 120))]) for j in range(60)]  # alike in the passage alone
    texts += [texts[3]] * 20
    return texts


@pytest.mark.parametrize(("width", "seed"), [(2, 1), (2, 2), (5, 3)])
def test_families(spark, width, seed):
    texts = families(seed, width)
    sets = [{tuple(w[i : i + width]) for i in range(len(w) - width + 1)} for w in (t.split() for t in texts)]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), width).collect()
    assert {g["doc_id"]: g["component_id"] for g in got} == {i: find(i) for i in range(len(texts))}


def test_ids_shared_by_texts(spark):
    base = " ".join(f"w{i}" for i in range(80))
    rows = [(1, base), (1, "quite another text of some words"), (2, base + " more"), (3, "quite another text of some words too")]
    got = {(g["doc_id"], g["n_shingles"]): g["component_id"] for g in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {(1, 79): 1, (2, 80): 1, (1, 5): 1, (3, 6): 1}


def test_lines_that_share_keys_but_are_unlike(spark):
    r = random.Random(7)
    start = " ".join(WORDS[:12])
    texts = [start + " " + " ".join(r.choice(WORDS) + str(r.randrange(99)) for _ in range(30)) for _ in range(60)]
    texts += [t + " end" for t in texts[:20]]
    got = {g["doc_id"]: g["n_removed"] for g in lines.op10_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert [got[i] for i in range(80)] == [0] * 60 + [1] * 20


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_chains_of_short_lines_are_whole(spark):
    """Lines of up to 14 characters share a key with all that are similar: chains beside a leader lose no link."""
    r = random.Random(5)
    texts = []
    for _ in range(6):
        now = "".join(r.choice("abcdefgh") for _ in range(10))
        for _ in range(25):
            at = r.randrange(len(now))
            now = now[:at] + r.choice("abcdefghijkl") + now[at + 1 :]
            texts.append(now)
    r.shuffle(texts)
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        if distance(texts[a], texts[b]) <= 2:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {g["doc_id"]: g["n_removed"] for g in lines.op10_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert got == {i: int(find(i) != i) for i in range(len(texts))}


def test_similar_lines_of_unlike_words(spark):
    """One letter of most words differs: similar lines, however far apart their SimHashes are."""
    r = random.Random(9)
    rows = []
    for i in range(20):
        words = ["".join(r.choice("abcdefghijklmnopqrst") for _ in range(14)) for _ in range(30)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(w[:7] + "z" + w[8:] if n < 18 else w for n, w in enumerate(words)))]
    got = {g["doc_id"]: g["n_removed"] for g in lines.op10_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all(got[2 * i] == 0 for i in range(20))
    assert sum(got[2 * i + 1] for i in range(20)) >= 17


def test_rows_that_share_one_key_meet(spark):
    """A list of rows that are unlike their leaders: every two of them are compared."""
    from tessera.llm.common import Scratch
    from tessera.llm.link import all_pairs, elections

    postings = spark.createDataFrame([(1, i, i % 7) for i in range(40)], "key bigint, id bigint, weight int").selectExpr("*", "id AS facts")
    seen = lambda pairs: pairs.filter("abs(lead_facts - id_facts) = 20").selectExpr("lead", "id", "true AS near")
    given, left = elections(postings, seen, Scratch(spark))
    met = all_pairs(left, postings.select("id"), lambda x, y: F.abs(F.col(f"{x}id") - F.col(f"{y}id")) == 20)
    pairs = {tuple(sorted((p["lead"], p["id"]))) for g in given for p in g.collect()} | {tuple(p) for p in met.collect()}
    assert pairs == {(i, i + 20) for i in range(20)}
