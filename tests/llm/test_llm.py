"""Each operator against a brute-force version, on rows with nulls, empties, ties, repeats and clashing names."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import ann, bpe, chat, fingerprint, lines, minhash, mixing, quality, repeats, toxicity
from tessera.llm.queries import tokenizer_path

sha = lambda b: hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()
WORDS = [f"{a}{b}" for a in "ka lo mi ne su ra to vi".split() for b in "ban dur fel gos hin".split()]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, line string, key string, id int"


def prose(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(1)
    base = [prose(r, 60) for _ in range(6)]
    texts = [*base, base[0], base[0] + " end", base[1].upper(), base[2] + "\n" + base[3], None, "", " \t\n", "one", "ONE", prose(r, 3000), "ñandú über 漢字 " * 9, base[4] + "\n" + base[4].replace(WORDS[0], "other"), "aaaa" * 60, base[5][:150] + prose(r, 30) + base[5][100:]]
    out = [(i * 3, t, "en", "s" + str(i % 3) if i % 5 else None, len(t or ""), "x", "y", i) for i, t in enumerate(texts)]
    return [*out, out[1], (1000, base[0], None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append(r.asDict())
    return out


def distinct(rows):
    return sorted({(r[0], r[1]) for r in rows}, key=lambda r: r[0])


def test_empty_tables(spark, docs):
    none, labels = docs.limit(0), spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    talk = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert chat.op2_chat(talk).count() == 1  # conversation -1
    assert ann.op5_nearest(spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")).count() == 0
    assert quality.op3_quality(none, labels).count() == 0 and toxicity.op7_toxicity(none, labels).count() == 0
    assert bpe.op6_bpe(none, tokenizer_path()).count() == 0
    for op in (fingerprint.op1_fingerprints, minhash.op4_minhash, mixing.op8_mixing, repeats.op9_repeats, lines.op10_lines):
        assert op(none).count() == 0


def test_fingerprints(docs, rows):
    got = by_id(fingerprint.op1_fingerprints(docs))
    order = sorted(((r[0], r[1] or "") for r in rows))
    for i, (d, t) in enumerate(order):
        m, n = len(t) // 2, order[(i + 1) % len(order)][1]
        assert sha(t[: len(t) - m] + n[:m]) in {g["edited_sha256"] for g in got[d]}
        assert all(g["n_chars"] == len(t) and 0 <= g["near_edited"] <= 1 for g in got[d])
    assert got[0][0]["fingerprint"] == got[18][0]["fingerprint"] != got[21][0]["fingerprint"]


def test_fingerprints_add_and_subtract(spark):
    df = spark.createDataFrame([(1, "a b\nc d"), (2, "c d\na b"), (3, "a b"), (4, "c d")], "doc_id bigint, text string")
    got = {r["doc_id"]: bytes(r["state"]) for r in fingerprint.fingerprints(df).collect()}
    assert got[1] == got[2] == fingerprint.combine(got[3], got[4]) and fingerprint.combine(got[1], got[4], -1) == got[3]


def test_chat(spark):
    rows = [(1, 0, "user", "hi <|im_end|> & &lt;|"), (1, 1, "assistant", "ok"), (1, 1, "assistant", "ok"), (1, None, "sys\ntem", None), (None, 0, None, "x"), (2, 3000, "assistant", "späť"), (2, 0, "assistant", "")]
    got = {r["conv_id"]: r for r in chat.op2_chat(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("turns", F.lit(1))).collect()}
    turns = {c: sorted(((r[1] if r[1] is not None else -1), r[2] or "", r[3] or "") for r in rows if r[0] == c) for c in (1, 2, None)}
    turns[-1] = [(0, "user", s := "<|im_end|><|im_start|>assistant ok"), (1, "assistant", s)]
    for c, t in turns.items():
        said = "".join(x for _, role, x in t if role == "assistant")
        assert (got[c]["n_turns"], got[c]["turns_sha256"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(t), sha("".join(f"{a}\n{b}\n" for _, a, b in t)), len(said), sha(said))


def test_layouts(spark):
    rows = ['{"messages":[{"role":"user","content":"a"},{"role":"assistant","content":"b"}]}', '{"conversations":[{"from":"human","value":"a"},{"from":"gpt","value":"b"}]}', '{"prompt":"a","completion":"b"}', '{"instruction":"a","input":"","output":"b"}', '{"other":1}', "no json", None]
    got = chat.records_to_turns(spark.createDataFrame([(r,) for r in rows], "raw string"), "raw").collect()
    assert [r["layout"] for r in got] == ["messages", "conversations", "prompt_completion", "instruction_input_output", None, None, None]
    assert all([tuple(t) for t in r["turns"]] == [("user", "a"), ("assistant", "b")] for r in got[:4])


def test_rows_of_several_layouts(spark):
    rows = ['{"conv_id": 1, "turn": 0, "role": "user", "text": "a"}', '{"session_id": 2, "index": 5, "role": null, "content": "b"}', '{"text": null, "turn": null, "role": "user", "conv_id": null}', '{"conv_id": 3, "text": "no role"}', "[1]", None]
    records = spark.createDataFrame([(r,) for r in rows], "raw string").select(F.try_parse_json("raw").alias("record"))
    got = [tuple(r) for r in chat.rows_to_turns(records, "record").collect()]
    assert got == [("row_per_turn", 1, 0, "user", "a"), ("row_per_message", 2, 5, None, "b"), ("row_per_turn", None, None, "user", None), *[(None,) * 5] * 3]
    table = spark.createDataFrame([("s1", 1, "user", "x"), ("s1", 0, "user", "y" * 200_000)], "session_id string, index int, role string, content string")
    got = chat.gather_turns(table).collect()
    assert [(r["conv_id"], [len(t["text"]) for t in r["turns"]]) for r in got] == [("s1", [200_000, 1])]
    with pytest.raises(ValueError):
        chat.gather_turns(table.drop("role"))


@pytest.fixture(scope="module")
def judged(spark):
    r = random.Random(2)
    out = []
    for i in range(300):
        bad, toxic = i % 4 == 0, i % 5 == 0
        t = " ".join(w.upper() + "!!" if bad else w for w in prose(r, 40).split())
        out.append((i, t + (" you zorgwak" if toxic else ""), int(not bad), int(toxic)))
    df = spark.createDataFrame(out, "doc_id bigint, text string, quality int, toxic int")
    more = spark.createDataFrame([(1000, None), (1001, ""), (1000, None)], "doc_id bigint, text string")
    return df.select("doc_id", "text", F.lit(0).alias("score"), F.lit("z").alias("label")).unionByName(more, allowMissingColumns=True), df.select("doc_id", "quality", "toxic").unionByName(spark.createDataFrame([(None, 1, 0), (5, None, None)], "doc_id bigint, quality int, toxic int"))


@pytest.mark.parametrize(("op", "truth", "folds", "out"), [(quality.op3_quality, lambda i: int(i % 4 > 0), 5, 0), (toxicity.op7_toxicity, lambda i: int(i % 5 == 0), 3, 1)])
def test_classifiers_hold_out(judged, op, truth, folds, out):
    got = by_id(op(*judged))
    assert len(got) == 302 and len(got[1000]) == 2 and 0 <= got[1001][0]["score"] <= 1
    assert all(g[0]["held_out"] == (zlib.crc32(str(i).encode()) % folds == out) for i, g in got.items())
    held = [(g[0]["predicted"], truth(i)) for i, g in got.items() if i < 300 and g[0]["held_out"]]
    assert sum(a == b for a, b in held) / len(held) > 0.95


def sets(rows, width):
    out = {}
    for d, t in distinct(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out[d] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    return out


@pytest.mark.parametrize("width", [2, 5])
def test_minhash(spark, rows, width):
    r = random.Random(5)
    family = []
    for i in range(40):  # a chain of edits: neighbours are near, the ends are not
        base = family[-1][1].split() if family else prose(r, 80).split()
        base[r.randrange(80)] = f"new{i}"
        family.append((2000 + i, " ".join(base), None, None, None, None, None, None))
    rows = [*rows, *family]
    s = sets(rows, width)
    root = {d: d for d in s}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(s), 2):
        if s[a] and s[b] and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = by_id(minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), width))
    assert {d: (g[0]["n_shingles"], g[0]["component_id"]) for d, g in got.items()} == {d: (len(s[d]), find(d)) for d in s}


def test_nearest(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(700, 8))
    x[100:200] = x[7]
    x[300] = 0
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(900, None, 0), (901, [1.0, None] + [0.0] * 6, 0), (902, [float("nan")] * 8, 0), (None, [1.0] * 8, 0)]
    got = {}
    for q in ann.op5_nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).collect():
        got.setdefault(q["query_id"], []).append((q["rank"], q["vec_id"], q["score"]))
    hit = 0
    for q in [i for i in range(0, 700, 50) if i != 300]:
        sims = x @ x[q] / np.maximum(np.linalg.norm(x, axis=1) * np.linalg.norm(x[q]), 1e-300)
        best = sorted((i for i in range(700) if i not in (q, 300)), key=lambda i: (-round(sims[i], 12), i))[:5]
        mine = sorted(got[q])
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5] and all(abs(sims[i] - s) < 1e-12 for _, i, s in mine)
        hit += len(set(best) & {m[1] for m in mine})
        if q == 100:
            assert [m[1] for m in mine] == best
    assert hit / (5 * 13) >= 0.9 and set(got) == set(range(0, 700, 50)) - {300}


def test_bpe(docs, rows):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path())
    got = by_id(bpe.op6_bpe(docs, tokenizer_path()))
    for d, t in distinct(rows):
        e = whole.encode(t or "", add_special_tokens=False)
        g = got[d][0]
        assert (g["n_tokens"], g["ids_sha256"], g["decoded_sha256"]) == (len(e.ids), sha(" ".join(map(str, e.ids))), sha(whole.decode(e.ids, skip_special_tokens=False)))
    own = bpe.Encoder(bpe.load(tokenizer_path()))
    for t in ("<|endoftext|>x<|startoftext|>", "ab" * 400, "don't 12 ΑΣ İ ﬁ 😀😀 \x85\x1c"):
        assert np.frombuffer(own.encode(t), np.int32).tolist() == whole.encode(t, add_special_tokens=False).ids


def test_mixing(docs, rows):
    got = [r.asDict() for r in mixing.op8_mixing(docs).collect()]
    assert len(got) == len(rows) and sorted(r["taken"] for r in got) == sorted(r["taken"] for r in mixing.op8_mixing(docs).collect())
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = sum(size(r[1]) for r in rows)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    sums = {}
    for r in got:
        s = sums.setdefault((r["source_size"], r["target"]), [0, 0])
        s[0] += r["taken"]
        s[1] += r["size"]
    alike = {k: s[1] // k[0] for k, s in sums.items()}  # sources of one size and target
    assert all(s[1] == n * k[0] and abs(s[0] - n * k[1]) <= 2 * n * mixing.BLOCK_WORDS for (k, s), n in zip(sums.items(), alike.values(), strict=True))
    assert sum(n * k[1] for k, n in alike.items()) == pytest.approx(1.5 * total)
    # Targets by filling: weights 5, 2, 1 by code point, null last; the excess of full sources reshared by weight.
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + size(r[1])
    names = sorted(sizes, key=lambda x: (x is None, x))
    weight, want, full, left = dict(zip(names, itertools.cycle((5, 2, 1)))), {}, set(), 1.5 * total
    while True:
        open_weight = sum(w for n, w in weight.items() if n not in full)
        want = {n: 2 * sizes[n] if n in full else left * weight[n] / open_weight for n in names}
        over = {n for n in names if n not in full and want[n] > 2 * sizes[n]}
        if not over:
            break
        full |= over
        left = 1.5 * total - sum(2 * sizes[n] for n in full)
    assert {(r["source_size"], round(r["target"], 6)) for r in got} == {(sizes[n], round(want[n], 6)) for n in names}
    shards = [r.asDict() for r in mixing.mix(docs).collect()]
    assert sum(size(r["text"]) for r in shards) == sum(r["taken"] for r in got) and len({(r["shard"], r["place"]) for r in shards}) == max(r["shard"] * mixing.SHARD_SLOTS + r["place"] for r in shards) + 1
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and sum(size(r["text"]) for r in mixed.collect()) == sum(r["taken"] for r in got)


def test_repeats(docs, rows):
    seen, want = set(), {}
    for d, t in distinct(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(b[p : p + 100])
        runs = sum(1 for i in range(len(b)) if gone[i] and (not i or not gone[i - 1]))
        want[d] = (len(b), sum(gone), runs, sha(bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    got = by_id(repeats.op9_repeats(docs))
    assert {d: tuple(g[0][c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) for d, g in got.items()} == want
    assert sum(len(g) for g in got.values()) == len(rows)


def test_repeats_of_hot_anchors(docs, monkeypatch):
    plain = by_id(repeats.op9_repeats(docs))
    monkeypatch.setattr(repeats, "MOST_REGIONS", 1)
    assert by_id(repeats.op9_repeats(docs)) == plain


def test_repeats_of_long_texts_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 700)
    r = random.Random(11)
    base = prose(r, 400)
    texts = [base, prose(r, 50) + base[300:2000] + prose(r, 20), base[1500:] + base[:900]]
    seen, want = set(), []
    for t in texts:
        b, gone = t.encode(), set()
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone.update(range(p, p + 100))
            seen.add(b[p : p + 100])
        want.append(len(gone))
    got = by_id(repeats.op9_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")))
    assert [got[i][0]["n_removed"] for i in range(3)] == want


def test_repeats_with_null_ids(spark):
    a, b = prose(random.Random(12), 60), prose(random.Random(13), 60)
    got = repeats.op9_repeats(spark.createDataFrame([(None, a), (None, b), (None, a), (1, a + b)], "doc_id bigint, text string")).collect()
    assert sorted((g["doc_id"] or 0, g["n_removed"] > 0) for g in got) == [(0, False), (0, False), (0, False), (1, True)]


def test_run_index():
    r = random.Random(9)
    base = bytes(r.choice(b"abc") for _ in range(150))
    texts = [base, base, b"x" + base[:120], base[30:] + b"zz" * 20, bytes(r.choice(b"abc") for _ in range(180))]
    seen = set()
    for t, got in zip(texts, repeats.repeated_windows(texts), strict=True):
        windows = [t[p : p + 100] for p in range(len(t) - 99)]
        assert got.tolist() == [p for p, w in enumerate(windows) if w in seen or w in windows[:p]]
        seen.update(windows)


def test_lines(docs, rows):
    norm = lambda x: re.sub(r"[\W\d_]+", " ", x.lower()).strip()

    def far(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    first = {}
    for d, t in distinct(rows):
        for i, x in enumerate((t or "").split("\n")):
            first.setdefault(norm(x), (d, i)) if norm(x) else None
    spark = docs.sparkSession
    code = {r[0]: r[1] for r in spark.createDataFrame([(k,) for k in first], "x string").select("x", lines.simhash(F.split("x", " "))).collect()}
    keyed = spark.createDataFrame([(i, 0, 0, 0, k) for i, k in enumerate(first)], "doc bigint, version bigint, copy bigint, line int, text string")
    assert {list(first)[r["doc"]]: r["code"] for r in lines.coded(keyed).filter("kind = 0").collect()} == code
    for k, c in code.items():  # SimHash itself
        h = [r[0] for r in spark.createDataFrame([(w,) for w in k.split(" ")], "w string").select(F.xxhash64("w")).collect()] if len(k) < 40 else None
        if h:
            assert c & (2**64 - 1) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    root = {k: k for k in first}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(first, 2):
        if len(a) + len(b) < 4000 and far(a, b) <= int(max(len(a), len(b)) * (1 - lines.SIMILARITY) + 1e-9):
            x, y = sorted((find(a), find(b)), key=first.get)
            root[y] = x
    got = by_id(lines.op10_lines(docs))
    for d, t in distinct(rows):
        kept = [x for i, x in enumerate((t or "").split("\n")) if not norm(x) or first[find(norm(x))] == (d, i)]
        assert got[d][0]["kept_sha256"] == sha("\n".join(kept)), d
    assert lines.deduplicated(docs).columns == docs.columns


def test_mix_draws_counts_for_each_shard(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 64)
    monkeypatch.setattr(mixing, "SLOT_CHUNK", 100)
    targets = spark.createDataFrame([("a", 0, 64000, 5.0, 64000.0), ("b", 1, 30000, 2.0, 32000.0), ("c", 2, 900, 1.0, 1800.0)], "source string, number int, source_size bigint, weight double, target double")
    got = mixing.slots(targets).collect()
    want = {0: 1000, 1: round(32000 * 469 / 30000), 2: 30}
    assert {n: sum(r["number"] == n for r in got) for n in want} == want
    assert len({(r["shard"], r["place"]) for r in got}) == len(got) and len({(r["number"], r["block"], r["epoch"]) for r in got}) == len(got)
    shares = [sum(r["number"] == 0 for r in got if r["shard"] == s) / 64 for s in range(len(got) // 64)]
    assert 0.03 < np.std(shares) < 0.09 and abs(np.mean(shares) - 1000 / len(got)) < 0.02  # binomial: 0.058


def test_quality_against_plain_numpy(spark, judged):
    """Voting by a full decomposition and all cosines."""
    docs, labels = judged
    got = by_id(quality.op3_quality(docs, labels))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    known = {r["doc_id"]: r["quality"] for r in labels.collect() if r["quality"] is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5}
    import pyarrow as pa

    counts = lambda ids: quality.term_counts(pa.array([texts[i] for i in ids])).astype(np.float64)
    fit_on = sorted(known)
    c = counts(fit_on)
    idf = np.log((1 + len(fit_on)) / (1 + (c > 0).sum(axis=0))) + 0.2
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    a = unit(np.log1p(c) * idf)
    axes = np.linalg.svd(a, full_matrices=False)[2][: quality.RANK].T
    y = np.array([known[i] for i in fit_on], float)
    ids = sorted(texts)
    near = unit((np.log1p(counts(ids)) * idf) @ axes) @ unit(a @ axes).T
    best = np.argsort(-near, axis=1)[:, : quality.NEIGHBOURS]
    votes = np.maximum(np.take_along_axis(near, best, 1), 0) ** quality.POWER
    want = ((votes * y[best]).sum(1) + quality.PRIOR * y.mean()) / (votes.sum(1) + quality.PRIOR)
    apart = np.abs(np.array([got[i][0]["score"] for i in ids]) - want)
    assert np.quantile(apart, 0.9) < 0.02 and apart.max() < 0.2  # the operator's axes are found by iteration, in single precision


def test_toxicity_against_plain_numpy(spark, judged):
    """Counts, ratios and the regression by Newton steps on the same features."""
    docs, labels = judged
    got = by_id(toxicity.op7_toxicity(docs, labels))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    known = {r["doc_id"]: r["toxic"] for r in labels.collect() if r["toxic"] is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1}
    ids, sets = sorted(known), {i: set(toxicity.own_buckets(t).tolist()) for i, t in texts.items()}
    y = np.array([known[i] for i in ids], float)
    n, ones = len(ids), y.sum()
    toxic, clean = ({b: sum(b in sets[i] for i in ids if known[i] == k) for b in set().union(*sets.values())} for k in (1, 0))
    ratio = {b: np.log((toxic[b] + 3 * ones / n) / (ones + 3)) - np.log((clean[b] + 3 * (1 - ones / n)) / (n - ones + 3)) for b in toxic if toxic[b] + clean[b]}
    chosen = sorted(ratio, key=lambda b: (-abs(ratio[b]) * np.sqrt(toxic[b] + clean[b]), b))[: toxicity.FEATURES]
    row = lambda i: [ratio[b] * (b in sets[i]) for b in chosen] + [1.0]
    x = np.array([row(i) for i in ids])
    w = np.where(y == 1, 3.0, 1.0)
    w /= w.sum()
    # Plain gradient steps in double precision; the ridge doesn't hold the intercept.
    k, theta, last = len(chosen), np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    rate = 1 / (0.25 * 1.05 * np.linalg.norm(np.sqrt(w)[:, None] * x, 2) ** 2 + 1e-3)
    for step in range(toxicity.STEPS):
        ahead = theta + step / (step + 3) * (theta - last)
        grad = x.T @ (w * (1 / (1 + np.exp(-x @ ahead)) - y)) + 1e-3 * np.append(ahead[:k], 0)
        last, theta = theta, ahead - rate * grad
    for i in texts:
        assert abs(got[i][0]["score"] - 1 / (1 + np.exp(-np.dot(row(i), theta)))) < 0.01, i
