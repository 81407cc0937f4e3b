"""SimHash at anchors, hard negatives and spelling variants against brute force: nulls, empties, ties, repeats, extra columns."""

import collections
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("quillgrid.llm")

from quillgrid.llm import hard_negatives, simhash, variants  # noqa: E402
from quillgrid.sources.scratch import Scratch  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCUMENTS = "doc_id long, text string, id string, print string, key string, word string, anchor long"


def frame(spark, texts):
    """texts: (doc_id, text) pairs; the other columns have names that operators use themselves."""
    return spark.createDataFrame([(i, t, "x", "y", "z", "w", 1) for i, t in texts], DOCUMENTS)


def smallest_reachable(nodes, linked):
    """Per node the smallest one over links; nodes: id -> value."""
    parent = {i: i for i in nodes}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in nodes:
        for b in nodes:
            if a < b and linked(nodes[a], nodes[b]):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return {i: top(i) for i in nodes}


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(31)
    base = [f"w{x}" for x in rng.integers(0, 900, 400)]
    found = [(i, " ".join(f"w{x}" for x in rng.integers(0, 900, int(rng.integers(1, 80))))) for i in range(30)]
    for i in range(30, 60):
        words = list(base)
        for place in rng.integers(0, 400, int(rng.integers(0, 12))):
            words[place] = f"new{i}"
        found.append((i, " ".join(words)))
    found += [(70, None), (71, ""), (72, " \n\t"), (73, "Two WORDS"), (74, "two \x0b words"), (75, "É\xa0É one two É\xa0É ONE two")]
    found += [(80, found[3][1]), (80, found[4][1]), (81, found[4][1].upper()), (None, found[5][1])]
    return found


def test_fingerprints_follow_the_rule(spark, texts):
    """The hashes come from Spark's own XXH64 here."""
    shingles = []
    for n, (_, text) in enumerate(texts):
        words = WORD.findall((text or "").translate(LOWER))
        found = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
        shingles += [(n, s) for s in found]
    hashed = spark.createDataFrame(shingles, "n int, s string").select("n", F.xxhash64("s").alias("h")).collect()
    counts, sizes = collections.defaultdict(lambda: [0] * 64), collections.Counter()
    for r in hashed:
        sizes[r["n"]] += 1
        for bit in range(64):
            counts[r["n"]][bit] += (r["h"] % 2**64) >> bit & 1
    prints = {n: sum((2 * counts[n][b] > sizes[n]) << b for b in range(64)) for n in range(len(texts))}
    found = simhash.simhash_duplicates(frame(spark, texts)).collect()
    expected = collections.Counter((i, f"{prints[n]:016x}") for n, (i, _) in enumerate(texts))
    assert collections.Counter((r["doc_id"], r["fingerprint"]) for r in found) == expected
    sets = collections.defaultdict(list)
    for n, (i, _) in enumerate(texts):
        if i is not None:
            sets[i].append(prints[n])
    truth = smallest_reachable(sets, lambda a, b: any((x ^ y).bit_count() <= 3 for x in a for y in b))
    assert {(r["doc_id"], r["component_id"]) for r in found} == set(truth.items()) | {(None, None)}
    assert len(set(truth.values())) < len(truth) - 5
    assert simhash.simhash_duplicates(frame(spark, [])).count() == 0


def test_long_texts_are_counted_in_pieces(monkeypatch):
    text = " ".join(f"w{x}" for x in np.random.default_rng(4).integers(0, 50, 3000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "PIECE", 7)
    assert simhash.fingerprint(text) == whole


def test_anchors_cover_and_meet():
    rng = np.random.default_rng(5)
    words = np.concatenate([rng.integers(0, 1 << 32, 300), [0, 1, (1 << 32) - 1, 1 << 31]])
    steps = simhash.STEPS[simhash.syndromes(words)]
    homes = words ^ steps[:, 0]
    assert (np.bitwise_count(steps[:, 0]) <= 1).all() and not simhash.syndromes(homes).any()
    assert (np.bitwise_count(steps[steps >= 0]) <= 2).all()
    for bit in range(32):
        near = words ^ (1 << bit)
        copies = near[:, None] ^ simhash.STEPS[simhash.syndromes(near)]
        reached = (copies == homes[:, None]) & (simhash.STEPS[simhash.syndromes(near)] >= 0)
        assert reached.any(axis=1).all()


@pytest.mark.parametrize("rows_per_block", [2048, 12])
def test_links_in_large_groups(spark, monkeypatch, rows_per_block):
    """A dense cluster, a loose one whose members link through others only, pairs at distances 0 to 5, all at the same anchors."""
    monkeypatch.setattr(simhash, "ROWS_PER_BLOCK", rows_per_block)
    rng = np.random.default_rng(6)

    def flipped(value, n):
        for bit in rng.choice(64, n, replace=False).tolist():
            value ^= 1 << bit
        return value

    prints = [int(x) for x in rng.integers(0, 2**63, 60)]
    for n in range(6):
        prints += [flipped(p, n) for p in prints[:10]]
    centre = prints[0]
    prints += [flipped(centre, int(rng.integers(1, 8))) for _ in range(150)]
    low = prints[1] & 0xFFFFFFFF
    prints += [low | int(x) << 32 for x in rng.integers(0, 2**31, 60)]  # one anchor, far apart
    prints += [0, 1, 2**64 - 1, 2**63]
    nodes = dict(enumerate(prints))
    rows = [(i, p - 2**64 if p >= 2**63 else p) for i, p in nodes.items()]
    with Scratch(spark, "test") as scratch:
        printed = spark.createDataFrame(rows, "id long, print long")
        found = printed.join(simhash.print_components(printed, scratch), "print").collect()
    truth = smallest_reachable(nodes, lambda a, b: (a ^ b).bit_count() <= 3)
    assert {r["id"]: r["component"] for r in found} == truth


def test_copies_at_anchors_are_not_broadcast(spark):
    """The classes are small enough to broadcast, their copies at the anchors are not."""
    rng = np.random.default_rng(12)
    prints = [int(x) for x in rng.integers(-(2**63), 2**63, 2000)]
    prints = sorted({*prints, *(p ^ 1 << n for n, p in enumerate(prints[:50])), 0, 1, 7, -1})
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    with Scratch(spark, "test") as scratch:
        classes = scratch.written(spark.createDataFrame(list(enumerate(prints)), "id long, print long"))
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "512k")
        try:
            placed = simhash.in_blocks(simhash.anchor_rows(classes), ["anchor"])
            found = placed.collect()
            plan = placed._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "isFinalPlan=true" in plan and "SortMergeJoin" in plan and "BroadcastExchange" not in plan
    at = collections.defaultdict(list)
    for i, p in enumerate(prints):
        for half in range(2):
            word = p >> 32 * half & 0xFFFFFFFF
            steps = simhash.STEPS[simhash.syndromes(np.array([word]))[0]]
            for n, step in enumerate(steps[steps >= 0].tolist()):
                at[word ^ step | half << 32].append((i, n == 0))
    assert sum(map(len, at.values())) > 30 * len(prints)
    met = {(a, i, home) for a, rows in at.items() if len(rows) > 1 and any(h for _, h in rows) for i, home in rows}
    assert len(found) == len(met) > 300 and {(r["anchor"], r["id"], r["home"]) for r in found} == met


VECTORS = "vec_id long, embedding array<double>, label int, row long, bucket int, low string, windows string, id string"


def brute_negatives(rows, modulus):
    kept = {}
    for i, e, label in rows:
        if i is not None and label is not None and e is not None and all(x is not None and math.isfinite(x) for x in e):
            kept[(i, label, tuple(math.floor(256 * x) for x in e))] = None
    found = collections.Counter()
    for a, la, ea in kept:
        if a % modulus:
            continue

        def score(e, own=ea):
            return sum(x * y for x, y in zip(own, e, strict=False))

        others = sorted((-score(e), i, label) for i, label, e in kept if i != a)
        for s, p, _ in [o for o in others if o[2] == la][:5]:
            inside = [o for o in others if o[2] != la and 50 * -s <= 100 * -o[0] <= 95 * -s]
            found.update((a, p, n + 1, o[1], -s, -o[0]) for n, o in enumerate(inside[:3]))
    return found


@pytest.mark.parametrize("rows_per_bucket", [8192, 25])
def test_hard_negatives(spark, monkeypatch, rows_per_bucket):
    monkeypatch.setattr(hard_negatives, "ROWS_PER_BUCKET", rows_per_bucket)
    monkeypatch.setattr(hard_negatives, "ANCHORS_PER_BLOCK", 10)
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(6, 8))
    rows = []
    for i in range(180):
        vector = (centres[i % 6] + rng.normal(size=8) * 0.4) * rng.choice([0.01, 0.2, 1, 3])
        rows.append((i, vector.tolist(), int(rng.integers(0, 3))))
    rows += [(200, rows[5][1], 1), (210, rows[5][1], 1), (220, rows[5][1], 2), (225, rows[5][1], 0)]  # ties
    rows += [(5, rows[5][1], rows[5][2]), (10, rows[11][1], 1), (10, rows[11][1], 1)]  # repeated rows, one id with two vectors
    rows += [(230, [0.0] * 8, 1), (231, [0.0] * 8, 2), (240, [], 0), (241, [1.0, 2.0], 0), (242, [-1.0, 2.0, 0.5], 1)]
    rows += [(None, [1.0] * 8, 1), (300, None, 1), (310, [1.0] * 8, None), (320, [1.0, None], 1), (330, [float("nan")] * 8, 1)]
    rows += [(340, [float("inf")] * 8, 1), (350, [float("-inf")] * 8, 1)]
    rows += [(360, [1e6] * 8, 0), (370, [9e5] * 8, 1), (380, [1e6, -1e6] * 4, 0), (390, [7e5] * 8, 2)]
    table = spark.createDataFrame([(*r, 1, 2, "l", "w", "i") for r in rows], VECTORS)
    found = hard_negatives.hard_negatives(table, F.col("id") % 10 == 0)
    columns = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    assert collections.Counter(tuple(r[c] for c in columns) for r in found.collect()) == brute_negatives(rows, 10)
    assert hard_negatives.hard_negatives(table.limit(0), F.col("id") % 10 == 0).count() == 0
    assert hard_negatives.hard_negatives(table, F.col("id") == -1).count() == 0


def test_products_beyond_doubles_are_exact(spark):
    """Sums past 2 ** 53, and past 64 bits, which count as the largest number of 64 bits."""
    rows = [(0, [3e6 + 1, 7.0], 0), (1, [3e6 + 2, 5.0], 0), (2, [2e6 + 3, 1.0], 1), (3, [1e200, 1.0], 1)]
    found = hard_negatives.hard_negatives(
        spark.createDataFrame([(*r, 1, 2, "l", "w", "i") for r in rows], VECTORS), F.col("id") == 0
    ).collect()
    positive = 256 * 256 * ((3 * 10**6 + 1) * (3 * 10**6 + 2) + 35)
    negative = 256 * 256 * ((3 * 10**6 + 1) * (2 * 10**6 + 3) + 7)
    assert [(r["positive_id"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in found] == [(1, 2, positive, negative)]


def test_candidates_hold_every_row_that_reaches_the_limit():
    rng = np.random.default_rng(9)
    rows = np.floor(rng.normal(size=(400, 6)) * 100).astype(np.int64)
    rows[0] = 0
    bucket = hard_negatives.Bucket(np.arange(400), np.zeros(400), rows, rows.astype(float))
    pruned = 0
    for anchor in rows[:60]:
        products = rows @ anchor
        for low in (1, int(products.max() * 0.5) + 1, int(products.max() * 0.95) + 1, int(products.max())):
            at = bucket.candidates(anchor.astype(float), low)
            if at is not None:
                pruned += 400 - len(at)
                assert set(np.flatnonzero(products >= low)) <= set(at.tolist())
    assert pruned > 20000


def brute_variants(texts):
    counts = collections.Counter()
    for i, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            mark = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            at = mark % len(run)
            counts[run if mark % 31 else run[:at] + run[at + 1 :]] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    rows = {}
    for w, n in words.items():
        others = sorted((-words[o], o) for o in words if near(w, o))
        form = others[0][1] if others and -others[0][0] >= 10 * n else None
        rows[w] = (form, n, len(others), words[form] if form else None)

    def root(w):
        return root(rows[w][0]) if rows[w][0] else w

    return {(w, form, root(w), n, n_near, form_n) for w, (form, n, n_near, form_n) in rows.items()}


def test_spelling_variants(spark):
    rng = np.random.default_rng(10)
    bases = ["elephant", "elefant", "électrique", "zzzzzzzz", "mississippi", "×÷ÿabcdef", "aaaaaaab", "repeated"]
    texts = []
    for i in range(120):
        words = []
        for base in bases:
            times = int(rng.integers(1, 40)) if base in ("elephant", "repeated") else int(rng.integers(0, 5))
            words += [base] * times
        for base in bases:
            at = int(rng.integers(0, len(base)))
            letter = rng.choice(["a", "z", "é", "", "bb"])
            words += [base[:at] + str(letter) + base[at + 1 :]] * int(rng.integers(0, 3))
        rng.shuffle(words)
        texts.append((i, " 1".join(words)))
    chain = ["chainword"] * 1000 + ["chainwordx"] * 100 + ["chainwordxy"] * 10 + ["chainwordxyz"]
    texts += [(1000, " ".join(chain)), (1001, "chainwordxyz"), (1000, " ".join(chain)), (1002, None), (1003, ""), (1004, "12 中文 short")]
    texts += [(None, "Elephant ÉLECTRIQUE électrique"), (1005, "q" * 3000 + "r" * 20000), (1006, "q" * 3000 + "r" * 20000 + " " + "q" * 3001 + "r" * 20000)]
    texts += [(1007, "q" * 3001 + "r" * 20000 + " " + "q" * 3000 + "s" + "r" * 19999)]
    found = variants.spelling_variants(frame(spark, texts)).collect()
    rows = [(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in found]
    truth = brute_variants(texts)
    assert len(rows) == len(truth) and set(rows) == truth
    assert max(sum(r[2] == s[2] for s in truth) for r in truth) > 3 and any(r[1] and r[1] != r[2] for r in truth)
    assert variants.spelling_variants(frame(spark, [])).count() == 0


def test_neighbourhoods_are_whole_and_without_repeats():
    """Every two reduced words that are one edit apart are found from exactly one of them."""
    rng = np.random.default_rng(11)
    texts = sorted({"".join(rng.choice(list("abcdé"), int(rng.integers(1, 5)))) for _ in range(250)})
    points, bounds = variants.letters(pa.array(texts))
    for symbols in (2, 3, 7):
        words = variants.Reduced(points, bounds, symbols)
        reduced = [tuple(words.symbols[lo:hi].tolist()) for lo, hi in zip(bounds, bounds[1:], strict=False)]
        rows = [(o, k, same) for at in range(0, len(points), 50) for owners, keys, same in words.neighbours(at, min(at + 50, len(points)))
                for o, k in zip(owners.tolist(), keys.tolist(), strict=True)]
        assert len(rows) == len(set(rows))
        of_key = collections.defaultdict(set)
        for word, key in zip(reduced, words.own().tolist(), strict=True):
            of_key[key].add(word)
        assert all(len(found) == 1 for found in of_key.values())
        found = collections.Counter((reduced[o], w, same) for o, k, same in rows for w in of_key.get(k, ()))
        edits = set()
        for own in set(reduced):
            edits |= {(own, own[:i] + own[i + 1 :]) for i in range(len(own))}
            edits |= {(own, own[:i] + (s,) + own[i + 1 :]) for i in range(len(own)) for s in range(own[i] + 1, symbols)}
        times = collections.Counter(reduced)
        expected = {(a, b, False): times[a] for a, b in edits if b in times} | {(a, a, True): n for a, n in times.items()}
        assert found == expected
