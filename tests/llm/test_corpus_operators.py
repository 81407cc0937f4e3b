"""Corpus operators against brute force on small frames: nulls, empties, ties, repeats, extra columns, no rows."""

import collections
import hashlib
import math
import re
import time
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("quillgrid.llm")

from quillgrid.llm import katz, near_duplicates, suffixes, toxicity  # noqa: E402
from quillgrid.llm.chat_tree import prefix_trees, read_back  # noqa: E402
from quillgrid.llm.fingerprints import fingerprint_edits  # noqa: E402
from quillgrid.llm.mixing import Level, mixed_documents, mixture_table, plan_mixture  # noqa: E402
from quillgrid.llm.one_bit_search import nearest  # noqa: E402
from quillgrid.llm.pair_index_bpe import encode_documents  # noqa: E402
from quillgrid.llm.parameters import remainder, toxicity_model  # noqa: E402
from quillgrid.llm.queries import CONTROL_TEXT, URL_RULES  # noqa: E402
from quillgrid.llm.toxicity import maximal_segments, toxic_documents  # noqa: E402
from quillgrid.llm.url_filter import judge_urls  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, key string, place string"


def words_of(text):
    return WORD.findall((text or "").translate(LOWER))


def prose(rng, n, vocabulary=4000):
    return " ".join(f"w{int(x)}" for x in rng.integers(0, vocabulary, n))


def frame(spark, texts):
    """texts: (doc_id, text) pairs; the other columns have names that operators use themselves."""
    rows = [(i, t, None if n % 5 == 0 else "en", f"src{n % 3}", len(t or ""), "x", "y", "z") for n, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(8)
    base, passage = prose(rng, 300), prose(rng, 70)
    texts = [(i, prose(rng, int(rng.integers(1, 200)))) for i in range(40)]
    for i in range(40, 60):
        parts = base.split()
        for place in rng.integers(0, 300, int(rng.integers(0, 14))):
            parts[place] = "changed"
        texts.append((i, " ".join(parts)))
    texts += [(60, base), (61, base.upper()), (62, None), (63, ""), (64, " \n\t"), (65, "Few words"), (66, "few  WORDS")]
    texts += [(70 + i, f"{prose(rng, 40)}\n{passage}. {prose(rng, 30)}") for i in range(4)]
    texts += [(80, texts[3][1]), (80, texts[3][1]), (None, base), (81, prose(rng, 6000) + " é中")]
    return texts


def test_fingerprints(spark, corpus):
    keyed = [(i, t) for i, t in corpus if i is not None]
    keyed = sorted(keyed, key=lambda r: (r[0], (r[1] or "").encode()))
    found = fingerprint_edits(frame(spark, corpus)).filter("doc_id is not null").orderBy("doc_id", "n_chars").collect()
    assert len(found) == len(keyed)
    by_key = collections.defaultdict(set)
    for n, (i, text) in enumerate(keyed):
        text, following = text or "", keyed[(n + 1) % len(keyed)][1] or ""
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + following[:quarter]
        by_key[i].add((len(text), hashlib.sha256(edited.encode()).hexdigest()))
    assert {(r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in found} == {(i, *v) for i, vs in by_key.items() for v in vs}
    texts = {i: t or "" for i, t in keyed}
    prints = {}
    for r in found:
        assert prints.setdefault(texts[r["doc_id"]], r["fingerprint"]) == r["fingerprint"]
        assert 0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1
    assert len(set(prints.values())) == len(prints)
    assert fingerprint_edits(frame(spark, [])).count() == 0


def test_sparse_keys_find_their_neighbour(spark):
    texts = [(k, f"text {k} of some length") for k in (-(1 << 50), -5, 0, 255, 256, 1 << 20, 1 << 40, (1 << 62) + 7)]
    found = {r["doc_id"]: r["edited_sha256"] for r in fingerprint_edits(frame(spark, texts)).collect()}
    for n, (i, text) in enumerate(texts):
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + texts[(n + 1) % len(texts)][1][:quarter]
        assert found[i] == hashlib.sha256(edited.encode()).hexdigest()


def test_mixture_keeps_to_its_budget(spark, corpus):
    docs = frame(spark, corpus)
    levels = [Level("lang", F.col("lang"), {"en": 3}), Level("source", F.col("source"), {"src0": 5})]
    total = sum(len(words_of(t)) for _, t in corpus)
    mixture = plan_mixture(docs, levels, (1, 2), 2, 3)
    taken = mixture_table(mixture).agg(F.sum("tokens_taken")).first()[0]
    assert total // 2 - 8 <= taken <= total // 2
    assert mixed_documents(docs, levels, mixture).columns == docs.columns
    whole = mixture_table(plan_mixture(docs, levels, (1, 1), 1, 3))
    assert whole.agg(F.sum("tokens_taken")).first()[0] == total
    assert mixture_table(plan_mixture(frame(spark, []), levels, (1, 2), 2, 3)).count() == 0


def brute_katz(texts, taught):
    tokens = [[*words_of(t), None] for _, t in texts]
    ones, twos = collections.Counter(), collections.Counter()
    for w, use in zip(tokens, taught, strict=True):
        if use:
            ones.update(w)
            twos.update(zip(["<s>", *w[:-1]], w, strict=True))
    total = sum(ones.values())
    contexts = dict(ones) | {"<s>": sum(taught)}

    def kept(counts):
        n = collections.Counter(counts.values())
        tail = 6 * n[6] / n[1] if n[1] else 1
        ratios = [((r + 1) * n[r + 1] / n[r] / r - tail) / (1 - tail) for r in range(1, 6)] if all(n[r] for r in range(1, 7)) and tail != 1 else [2]
        if not all(0 < x < 1 for x in ratios):
            ratios = [(r - 0.5) / r for r in range(1, 6)]
        return lambda c: ratios[c - 1] * c if c <= 5 else c - 0.01

    one, two = kept(ones), kept(twos)
    unknown = 1 - sum(map(one, ones.values())) / total
    word = lambda w: one(ones[w]) / total if w in ones else unknown
    freed, covered = collections.Counter(), collections.Counter()
    for (h, w), c in twos.items():
        freed[h] += (c - two(c)) / contexts[h]
        covered[h] += word(w)
    weight = {h: freed[h] / (1 - covered[h]) for h in freed}
    for h in list(weight)[:20]:  # the probabilities of a context add up to one
        seen = sum(two(c) / contexts[h] for (g, _), c in twos.items() if g == h)
        assert math.isclose(seen + weight[h] * (1 - covered[h]), 1, rel_tol=1e-9)
    pair = lambda h, w: two(twos[h, w]) / contexts[h] if twos[h, w] else weight.get(h, 1) * word(w)
    return [
        (len(w), sum(x in ones for x in w), total, sum(math.log10((ones[x] + 1) / (total + len(ones) + 1)) for x in w),
         sum(math.log10(pair(h, x)) for h, x in zip(["<s>", *w[:-1]], w, strict=True)))
        for w in tokens
    ]


def test_katz_equals_brute_force(spark, corpus, monkeypatch):
    texts = [(i, t) for i, t in corpus if i is not None and i != 80]
    taught = [zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in texts]
    monkeypatch.setattr(katz, "RANGE_BYTES", 4000)
    found = katz.katz_scores(frame(spark, texts), remainder("id", 7) != 2).collect()
    found = {r["doc_id"]: r for r in found}
    for (i, _), use, (n, known, total, base, score) in zip(texts, taught, brute_katz(texts, taught), strict=True):
        r = found[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (not use, n, known, total)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and math.isclose(r["score"], score, rel_tol=1e-9)
    assert katz.katz_scores(frame(spark, []), F.lit(True)).count() == 0
    untaught = katz.katz_scores(frame(spark, [(1, "a b")]), F.lit(False)).first()
    assert (untaught["score"], untaught["train_tokens"], untaught["n_known"]) == (0.0, 0, 0)


def test_url_verdicts(spark):
    urls = ["http://a.ORG/x", "https://example.org/es/1", "https://www.example.org/en/12", "s://badexample.org/es/", "http://h.com/fr/#x",
            "http://h.com/de/?q", "http://h.com/es/", "no scheme", None, "", "http://org", "x://com/de/y", "http://a.net?x://b.org/"]
    pages = spark.createDataFrame([(n, u, "host") for n, u in enumerate([*urls, urls[0]])], "page_id long, url string, verdict string")
    rows = {r["page_id"]: r for r in judge_urls(pages, URL_RULES, steps=5).collect()}
    rules = [rows[n]["rule"] for n in range(len(urls))]
    assert rules == ["org/", "example.org/es/", "example.org/en/1", "org/", "com/fr/", "com/de/", None, None, None, None, None, "com/de/", None]
    assert (rows[0]["host"], rows[0]["path"]) == ("a.org", "/x") and (rows[8]["host"], rows[8]["path"]) == ("", "")
    assert rows[13]["rule"] == "org/" and {r["verdict"] for r in rows.values()} <= {"allow", "block"}
    assert judge_urls(pages.limit(0), URL_RULES, steps=2).count() == 0


def test_nearest_recall_and_ties(spark):
    rng = np.random.default_rng(4)
    vectors = rng.standard_normal((600, 24))
    vectors[100:140] = vectors[100]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(700, None), (701, [0.0] * 24), (702, [float("nan")] * 24), (703, [1.0]), (None, [1.0] * 24), (5, rows[5][1])]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = collections.defaultdict(list)
    for r in nearest(data, F.col("id") % 20 == 0).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append(r["vec_id"])
    hits = 0
    for q in range(0, 600, 20):
        scores = vectors @ vectors[q]
        order = [i for i in np.lexsort((np.arange(600), -scores)) if i != q][:20]
        hits += len(set(order) & set(found[q]))
    assert set(found) == set(range(0, 600, 20)) and hits >= 0.99 * 30 * 20
    assert nearest(data.limit(0), F.lit(True)).count() == 0


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "a\\h#</turn>\n"), (2, 0, "user", "hi"), (2, 1, "assistant", "other"), (3, 0, "user", "hi"),
            (4, 0, None, None), (4, None, "user: ###", "first"), (4, 0, "assistant", CONTROL_TEXT), (5, 1, "assistant", "é" * 5000), (None, 0, "user", "x")]
    rows += [(9, n, "assistant" if n % 2 else "user", f"turn {n}") for n in range(200)]
    data = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    packs = prefix_trees(data)
    found = {r["conv_id"]: r for r in read_back(packs).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        r = found[conv]
        assert (r["n_turns"], r["loss_chars"]) == (len(turns), len(loss))
        assert r["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert len(found) == 7
    for node in packs.filter("kind = 'node'").collect():
        assert node["position"] == sum(a["end"] - a["start"] for a in node["attends"])
    assert read_back(prefix_trees(data.limit(0))).count() == 0


def test_bpe_equals_the_library(spark, corpus):
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    path = public.path("word_bpe_49k.json")
    known = tokenizers.Tokenizer.from_file(path)
    odd = ["", None, "it's IT'S ΑΣ ſẞﬁ", "aaaaaaa", "x<|endoftext|>y", "\x00\x85\u200b 😀", unicodedata.normalize("NFD", "Ünïcode"), "z" * 9000]
    texts = [*corpus, *((200 + n, t) for n, t in enumerate(odd))]
    found = encode_documents(frame(spark, texts), path).collect()
    rows = sorted((r["doc_id"] or -1, r["ids"], r["decoded"]) for r in found)
    ids = [known.encode(t or "", add_special_tokens=False).ids for _, t in texts]
    assert rows == sorted((i or -1, x, known.decode(x, skip_special_tokens=False)) for (i, _), x in zip(texts, ids, strict=True))
    assert encode_documents(frame(spark, []), path).count() == 0


def test_toxic_documents(spark):
    rng = np.random.default_rng(1)
    texts, labels = [], []
    for i in range(600):
        parts = prose(rng, int(rng.integers(20, 120)), 800).split()
        toxic = i % 6 == 0
        for place in rng.integers(0, len(parts), 4 if toxic else 0):
            parts[place] = ["vile", "rotten", "foul"][int(rng.integers(0, 3))]
        texts.append((i, " ".join(parts)))
        labels.append((i, None, int(toxic)))
    docs, marks = frame(spark, [*texts, (700, None), (701, "")]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = {r["doc_id"]: r for r in toxic_documents(docs, toxicity_model(docs, marks)).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((found[i]["score"] >= 0.5) == (i % 6 == 0) for i in held) >= 0.95 * len(held)
    assert len(found) == 602 and found[700]["score"] < 0.5
    hit = next(found[i] for i in held if found[i]["passages"])
    text, passage = dict(texts)[hit["doc_id"]], hit["passages"][0]
    assert re.search("vile|rotten|foul", text[passage["start"] : passage["end"]])
    none = toxic_documents(docs, toxicity_model(docs, marks.limit(0))).select("score").distinct().collect()
    assert len(none) == 1 and none[0][0] < 0.5


def test_thinned_classes_keep_their_share(spark):
    # Texts that nothing tells apart: the score is the share of all labels, not of the drawn rows.
    texts = [(i, "same words " * (i + 1)) for i in range(880)]
    marks = spark.createDataFrame([(i, int(i % 11 == 0)) for i, _ in texts], "doc_id long, toxic int")
    for train_rows in (10_000, 80, 40):
        model = toxicity.fit_toxicity(frame(spark, texts), marks, F.lit(True), F.col("key") % 4 == 0, train_rows)
        assert model.lexicon is None and math.isclose(model.score(np.zeros(1))[0], 1 / 11, rel_tol=1e-6)
    # The curve of a thinned class crosses one half where that of all rows does.
    rng = np.random.default_rng(4)
    toxic = np.repeat([0.0, 1.0], [40_000, 4_000])
    evidence = rng.normal(2 * toxic, 1)
    kept = (toxic > 0) | (rng.random(len(toxic)) < 0.1)
    whole, thinned = toxicity.fitted_curve(evidence, toxic), toxicity.fitted_curve(evidence[kept], toxic[kept], (10, 1))
    assert math.isclose(-whole[1] / whole[0], -thinned[1] / thinned[0], abs_tol=0.1)


def test_maximal_segments_are_the_best():
    rng = np.random.default_rng(2)
    for _ in range(200):
        at = np.flatnonzero(rng.random(60) < 0.2)
        odds = rng.random(len(at)) * 2 + 0.1
        scores = np.full(60, -0.2)
        scores[at] = odds
        best = max((scores[i : j + 1].sum() for i in range(60) for j in range(i, 60)), default=0)
        found = maximal_segments(at, odds)
        assert not len(at) or math.isclose(max(s for _, _, s in found), best)
        assert all(a[1] < b[0] for a, b in zip(found, found[1:], strict=False))


def brute_segments(scores):
    """Ruzzo and Tompa by definition: the greatest segment, then those on both sides of it."""
    best = max(((scores[i : j + 1].sum(), i, j) for i in range(len(scores)) for j in range(i, len(scores))), default=(0, 0, 0))
    if best[0] <= 0:
        return []
    _, i, j = best
    right = [(a + j + 1, b + j + 1) for a, b in brute_segments(scores[j + 1 :])]
    return [*brute_segments(scores[:i]), (i, j), *right]


def test_all_maximal_segments():
    rng = np.random.default_rng(23)
    for _ in range(60):
        at = np.flatnonzero(rng.random(30) < rng.choice([0.1, 0.4]))
        odds = rng.random(len(at)) * 2 + 0.1
        scores = np.full(30, -0.2)
        scores[at] = odds
        assert [(a, b) for a, b, _ in maximal_segments(at, odds)] == brute_segments(scores)


def test_segments_are_found_in_linear_time():
    lone = np.arange(100_000) * 50
    for odds in (np.full(100_000, 1.0), np.linspace(5, 1, 100_000), np.linspace(1, 12, 100_000)):
        started = time.perf_counter()
        maximal_segments(lone, odds)
        assert time.perf_counter() - started < 2


def repeated_words(texts):
    places = collections.defaultdict(set)
    for n, (i, text) in enumerate(texts):
        w = words_of(text)
        for p in range(len(w) - 49):
            places[tuple(w[p : p + 50])].add((n, i, p))
    cover = collections.defaultdict(set)
    for found in places.values():
        if len(found) > 1:
            for _, i, p in found:
                cover[i].update(range(p, p + 50))
    return cover


def test_repeated_passages(spark, corpus):
    texts = [(i, t) for i, t in corpus if i is not None]
    found = collections.defaultdict(set)
    for r in suffixes.repeated_passages(frame(spark, corpus)).filter("kind = 'repeat'").collect():
        found[r["doc_id"]].update(range(r["first_word"], r["stop_word"]))
    truth = repeated_words(texts)
    assert found == truth
    variants = set(range(40, 62))
    docs = frame(spark, corpus)
    left = suffixes.without_copies(docs)
    assert left.columns == docs.columns
    rest = [(r["doc_id"], r["text"]) for r in left.filter("doc_id is not null and doc_id <> 80").collect()]
    assert not set(repeated_words(rest)) - variants
    clean = {i: t for i, t in texts if i not in truth}
    assert {i: t for i, t in rest if i in clean} == clean
    assert suffixes.repeated_passages(frame(spark, [])).count() == 0


def windows_of(texts):
    """How often each 50 words stand."""
    return collections.Counter(tuple(w[p : p + 50]) for w in (words_of(t) for _, t in texts) for p in range(len(w) - 49))


def test_each_repeated_passage_still_stands(spark, corpus):
    rng = np.random.default_rng(5)
    passage, long, before, after = prose(rng, 60), prose(rng, 200), prose(rng, 60), prose(rng, 60)
    texts = [(1, f"{prose(rng, 30)} {passage} {prose(rng, 30)}")]
    texts += [(i, f"{prose(rng, 9)} {before} {passage} {after}") for i in (2, 3)]
    texts += [(4, f"{prose(rng, 30)} {long}")] + [(i, f"{before} {long} {prose(rng, 30)}") for i in (5, 6)]
    texts += [(100 + i, t) for i, t in corpus if i is not None and i != 80]
    left = suffixes.without_copies(frame(spark, texts))
    stands = windows_of([(r["doc_id"], r["text"]) for r in left.collect()])
    repeated = {w: n for w, n in windows_of(texts).items() if n > 1}
    assert repeated and all(stands[w] for w in repeated)
    # Words that no other shared passage comes near stand only once.
    inner = [w for w in windows_of([(0, " ".join(long.split()[50:150]))])]
    assert {stands[w] for w in inner} == {1} and {repeated[w] for w in inner} == {3}


def test_rows_that_share_an_id_keep_their_own_words(spark):
    """Cuts and near-duplicates go by row: a text is not cut, nor dropped, for what another of its id holds."""
    rng = np.random.default_rng(21)
    passage, own, other = prose(rng, 80), prose(rng, 100), prose(rng, 120)
    texts = [(1, f"{passage} {prose(rng, 30)}"), (2, f"{prose(rng, 20)} {passage}"), (2, own), (3, other), (3, other), (None, passage)]
    left = collections.Counter((r["doc_id"], r["text"]) for r in suffixes.without_copies(frame(spark, texts)).collect())
    assert left[(2, own)] == 1 and left[(3, other)] == 2 and left[(1, texts[0][1])] == 1 and left[(None, passage)] == 1
    assert (2, texts[1][1]) not in left and sum(left.values()) == 6
    texts += [(4, own + " more"), (5, other), (6, None), (6, ""), (None, None)]
    schema = "doc_id long, text string, gone string, row long, document string, `key` string"
    docs = spark.createDataFrame([(i, t, "a", n, "d", "k") for n, (i, t) in enumerate(texts)], schema)
    kept = near_duplicates.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    kept = collections.Counter((r["doc_id"], r["text"]) for r in kept.collect())
    expected = [*texts[:3], (3, other), (None, passage), (6, None), (6, ""), (None, None)]
    assert kept == collections.Counter(expected)
    assert near_duplicates.without_near_duplicates(docs.limit(0)).count() == 0 == suffixes.without_copies(docs.limit(0)).count()


def test_long_runs_and_partition_ends_are_decided_by_the_second_sort(spark, monkeypatch):
    rng = np.random.default_rng(22)
    passage = prose(rng, 75)
    texts = [(i, f"{prose(rng, int(rng.integers(0, 40)))} {passage} {prose(rng, 12)}") for i in range(300)]
    truth = repeated_words(texts)
    rows = [r for r in suffixes.suffixes(frame(spark, texts), "doc_id", "text").orderBy(*suffixes.SUFFIX_ORDER).toArrow().to_batches(500)]
    for together in (20, 1 << 14):
        monkeypatch.setattr(suffixes, "TOGETHER", together)
        out = pa.Table.from_batches(suffixes.shared_windows(iter(rows))).to_pylist()
        rest = collections.defaultdict(set)
        for r in out:
            if r["window"] is not None:
                rest[(r["anchor"], r["window"])].add((r["id"], r["place"], r["repeats"]))
        found = collections.defaultdict(set)
        for places in rest.values():
            for i, p, known in places:
                if len(places) == 1 and not known:
                    continue
                found[i].update(range(p % suffixes.APART, p % suffixes.APART + 50))
        for r in out:
            for bit in range(25) if r["window"] is None else ():
                if r["repeats"] >> bit & 1:
                    found[r["id"]].update(range(r["place"] % suffixes.APART + bit, r["place"] % suffixes.APART + bit + 50))
        assert found == truth
        assert (len(rest) > 20) == (together == 20)


def test_every_repeat_among_variants_is_found(spark, corpus):
    texts = [(n, t) for n, (_, t) in enumerate(corpus)]
    rng = np.random.default_rng(3)
    parts = prose(rng, 200).split()
    for i in range(200, 320):
        variant = list(parts)
        for place in rng.integers(0, 200, 5):
            variant[place] = f"edit{int(rng.integers(0, 3))}"
        texts.append((i, " ".join(variant)))
    # One word over and over, and windows that repeat within their own text.
    texts += [(400, "same " * 120), (401, f"{' '.join(parts[:70])} {' '.join(parts[:70])}")]
    found = collections.defaultdict(set)
    for r in suffixes.repeated_passages(frame(spark, texts)).filter("kind = 'repeat'").collect():
        found[r["doc_id"]].update(range(r["first_word"], r["stop_word"]))
    assert found == repeated_words(texts)
    left = [(r["doc_id"], r["text"]) for r in suffixes.without_copies(frame(spark, texts)).collect()]
    stands = windows_of(left)
    assert all(stands[w] for w, n in windows_of(texts).items() if n > 1)


def test_near_duplicates(spark, corpus):
    sets = {}
    for i, text in corpus:
        if i is not None:
            w = words_of(text)
            sets[i] = {tuple(w[p : p + 5]) for p in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def top(i):
        return i if parent[i] == i else top(parent[i])

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
    docs = frame(spark, corpus)
    found = near_duplicates.near_duplicates(docs).collect()
    assert len(found) == len(corpus)
    for r in found:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), top(r["doc_id"]))
    left = near_duplicates.without_near_duplicates(docs)
    assert left.columns == docs.columns
    kept = [r["doc_id"] for r in left.filter("doc_id is not null").collect()]
    assert sorted(kept) == sorted(i for i in sets if top(i) == i)
    assert near_duplicates.near_duplicates(frame(spark, [])).count() == 0


def brute_components(sets):
    """The smallest id that each id reaches over linked sets; an id may have several."""
    parent = {i: i for i, _ in sets}

    def top(i):
        return i if parent[i] == i else top(parent[i])

    for n, (i, x) in enumerate(sets):
        for j, y in sets[:n]:
            both = len(x & y)
            if both and 100 * both >= 75 * len(x | y):
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
    return {i: top(i) for i in parent}


def test_one_group_of_many_variants(spark, monkeypatch):
    """Similarities on both sides of the threshold, blocks smaller than the group, ids with sets of different sizes."""
    monkeypatch.setattr(near_duplicates, "ROWS_PER_BLOCK", 50)
    rng = np.random.default_rng(14)
    base, texts = prose(rng, 120).split(), []
    for i in range(220):
        words = list(base)
        for place in rng.integers(0, len(base), int(rng.integers(1, 5))):
            words[place] = f"v{i}x{int(rng.integers(0, 3))}"
        texts.append((i, " ".join(words)))
    long, short = prose(rng, 900), prose(rng, 30)
    texts += [(300, long), (300, short), (301, long + " more"), (302, short + " more"), (303, prose(rng, 900))]
    sets = [(i, {tuple(words_of(t)[p : p + 5]) for p in range(len(words_of(t)) - 4)}) for i, t in texts]
    truth = brute_components(sets)
    assert 10 < len(set(truth.values())) < 200
    found = near_duplicates.near_duplicates(frame(spark, texts)).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == truth


def test_bitmaps_bound_the_intersection():
    rng = np.random.default_rng(15)
    for size in (1, 20, 400, 9000):
        a, b = (np.unique(rng.integers(0, size, size)).astype(np.uint64) for _ in range(2))
        bits = near_duplicates.bitmaps(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        most = near_duplicates.most_common(bits[0], len(a), bits[1:], np.array([len(b)]))[0]
        both = len(np.intersect1d(a, b))
        assert both <= most <= (min(len(a), len(b)) if size > 4096 else both + 0.2 * size)
    assert not near_duplicates.bitmaps(np.zeros(0, np.uint64), np.array([0, 0])).any()
