"""Brute force, planted cases and defined results of the corpus operators."""

import math
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexloom.llm import decontaminate, divergence_rules, extendible, host_reputation, jaccard_join, mixing, quality_nbsvm, queries, token_spans, toxicity_fm, wrappers
from lexloom.llm import features as ft
from lexloom.llm.store import fold, labelled_sample

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i} the of and" for i in range(4000))
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def prose(rng, n, words=40):
    common = "the of and to in is that for it as was with be by on".split()
    return " ".join(rng.choice(common) if rng.random() < 0.45 else f"word{rng.integers(words * 40)}" for _ in range(n)) + "."


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(3)
    rows = [(i, prose(rng, int(rng.integers(55, 120))), "en", "s", 0) for i in range(60)]
    base = rows[5][1]
    rows += [(100, base, "en", "s", 0), (101, base.replace("the", "thy", 1), "en", "s", 0), (102, "", "en", "s", 0), (103, None, None, None, None), (104, "three words only", "fr", "s", 0), (105, "Three WORDS only", "fr", "s", 0), (106, LONG, "en", "s", 0), (107, "x " * 300, "en", "s", 0), (None, "no id here", "en", "s", 0), (100, base, "en", "s", 0)]
    return spark.createDataFrame(rows, DOCS)


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = WORDS.findall(lower(t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = list(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_jaccard_components_equal_brute_force(spark, docs):
    got = jaccard_join.component_ids(docs).collect()
    assert len(got) == docs.count()
    want = brute_components([(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] is not None])
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == want
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted({c for _, c in want.values()})


def test_jaccard_on_shared_passages_and_chains(spark):
    rng = np.random.default_rng(8)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"{prose(rng, 70)} {passage}") for i in range(70)]
    words = [f"c{i}" for i in range(120)]
    for k in range(12):  # each is near its neighbours, the ends are far apart
        rows.append((200 + k, " ".join(words[k * 5 : k * 5 + 60])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.component_ids(df).collect()}
    assert got == brute_components(rows)


def test_near_duplicates_keep_each_text_of_an_id(spark):
    rng = np.random.default_rng(5)
    a, b, c = (prose(rng, 60) for _ in range(3))
    rows = [(5, a), (5, b), (7, a), (7, a), (9, c), (9, c + " x"), (2, c), (None, a), (4, None), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("a.b", F.lit(1)).withColumn("component_id", F.lit("mine")).withColumn("_key", F.lit("k"))
    kept = jaccard_join.keep_one(df)
    assert kept.columns == df.columns
    got = sorted((r["doc_id"] or -1, r["text"] or "") for r in kept.collect())
    assert got == sorted([(5, a), (5, b), (2, c), (-1, a), (4, ""), (4, "")])
    found = Counter((r["doc_id"], r["component_id"]) for r in jaccard_join.component_ids(df).collect())
    assert found == {(5, 5): 2, (7, 5): 2, (9, 2): 2, (2, 2): 1, (None, None): 1, (4, 4): 2}
    with pytest.raises(ValueError):
        jaccard_join.component_ids(df.withColumn("doc_id", F.lit("a")))


def test_jaccard_tiles_of_families(spark):
    """Two families of near copies that share a passage, beside texts with that passage alone, under a small heat limit."""
    rng = np.random.default_rng(9)
    passage = " ".join(f"p{i}" for i in range(40))
    rows = []
    for f in range(2):
        words = f"{prose(rng, 100)} {passage}".split()
        for k in range(25):
            w = list(words)
            w[int(rng.integers(90))] = f"edit{f}x{k}"
            rows.append((1000 * f + k, " ".join(w)))
    rows += [(5000 + i, f"{prose(rng, 60)} {passage}") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    members, _, comps = jaccard_join.join(df, hot_pairs=50)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in members.join(comps, "c", "left").select("doc_id", "n_shingles", F.coalesce("comp", "c").alias("component_id")).collect()}
    assert got == brute_components(rows)


def test_jaccard_empty_table(spark):
    assert jaccard_join.component_ids(spark.createDataFrame([], DOCS)).count() == 0


def test_bitmaps_bound_the_difference():
    rng = np.random.default_rng(1)
    for n, m, k in ((10, 12, 6), (500, 40, 30), (900, 1000, 800)):
        x = np.sort(rng.integers(0, 2**63, n, dtype=np.uint64))
        y = np.sort(np.concatenate([x[:k], rng.integers(0, 2**63, m - k, dtype=np.uint64)]))
        assert jaccard_join.differing_bits(jaccard_join.bitmap(x), jaccard_join.bitmap(y)) <= n + m - 2 * k
        assert jaccard_join.overlap(x.view(np.int64), y.view(np.int64)) == k


def brute_rules(text):
    w = WORDS.findall(text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    count, at = Counter(zip(w, w[1:], w[2:], strict=False)), set()
    for i, g in enumerate(zip(w, w[1:], w[2:], strict=False)):
        if count[g] > 1:
            at |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(at)


def test_rules_count_as_brute_force_and_reject_junk(spark, docs):
    rng = np.random.default_rng(4)
    odd = [(300, "\n".join(["a line é ü"] * 30 + ["other"]), "en", "s", 0), (301, " ".join(w + "###" for w in prose(rng, 200).split()), "en", "s", 0), (302, prose(rng, 300).upper().replace(" ", "!! "), "en", "s", 0), (303, "\n\n \n", "en", "s", 0)]
    both = docs.unionByName(spark.createDataFrame(odd, DOCS)).withColumn("kept", F.lit("mine"))
    got = divergence_rules.apply_rules(both).collect()
    assert len(got) == both.count()
    for r in got:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_rules(r["text"]), r["doc_id"]
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert all(kept[i] for i in range(60))
    assert not any(kept[i] for i in (102, 103, 104, 107, 300, 301, 302, 303))


def brute_distance(p, q):
    kl = lambda a, b: sum(x * math.log2(x / y) for x, y in zip(a, b, strict=True) if x > 0)
    m = [(x + y) / 2 for x, y in zip(p, q, strict=True)]
    return math.sqrt(max(0.0, kl(p, m) / 2 + kl(q, m) / 2))


def histograms(text, common):
    """Shares of the classes of characters, and of the common words (the last one: all others)."""
    classes, bins = [0] * 8, [0] * (len(common) + 1)
    for c in text:
        classes[0 if c.islower() or ord(c) > 127 else 1 if c.isupper() else 2 if c.isdigit() else 4 if c == "\n" else 3 if c in " \t" else 5 if c in ".,;:!?'\"-()" else 6] += 1
    for w in WORDS.findall(lower(text)):
        w = w[:-1] if len(w) > 1 and w[-1] in ".,;:?\"'()" else w
        bins[common.index(w) if w in common else -1] += 1
    return [[x / max(1, sum(h)) for x in h] for h in (classes, bins)]


def test_divergence_verdicts_equal_brute_force(spark, docs):
    rng = np.random.default_rng(4)
    odd = [(300, prose(rng, 300).upper().replace(" ", "!! "), "en", "s", 0), (301, " ".join(f"z{i}" for i in range(90)), "fr", "s", 0), (302, "der die und in den " * 2 + " ".join(f"q{i}" for i in range(60)), "de", "s", 0)]
    rows = [r for r in docs.collect() if r["doc_id"] != 106] + odd
    common = sorted({w for ws in divergence_rules.COMMON_WORDS.values() for w in ws})
    own = {}
    for _, t, lang, *_ in rows:
        n, _, _, _, repeated = brute_rules(t)
        if n >= 50 and 2 * repeated <= n and lang:
            own.setdefault(lang, []).append([[math.sqrt(x) for x in h] for h in histograms(t, common)])
    references = {}
    for lang, hs in own.items():
        mean = [[(sum(h[k][i] for h in hs) / len(hs)) ** 2 for i in range(len(hs[0][k]))] for k in (0, 1)]
        references[lang] = [[x / sum(m) for x in m] for m in mean]
    both = spark.createDataFrame(rows, DOCS)
    checked = 0
    for r in divergence_rules.apply_rules(both).collect():
        n, _, _, _, repeated = brute_rules(r["text"])
        if n < 50 or 2 * repeated > n:
            assert not r["kept"] and r["base_failed"]
            continue
        h, checked = histograms(r["text"], common), checked + 1
        room = 0.14 + 0.7 / math.sqrt(n), 0.40 + 1.6 / math.sqrt(n)
        far = {x: (brute_distance(h[0], q[0]), brute_distance(h[1], q[1])) for x, q in references.items()}
        near = min(sorted(far), key=lambda x: max(far[x][0] / room[0], far[x][1] / room[1]))
        assert (r["char_distance"], r["word_distance"]) == pytest.approx(far[near], abs=1e-6), r["doc_id"]
        assert r["kept"] == all(x <= y for x, y in zip(far[near], room, strict=True))
    assert checked > 50


def test_rules_on_an_empty_table(spark):
    assert divergence_rules.apply_rules(spark.createDataFrame([], DOCS)).count() == 0


def brute_hits(text, items, n=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    w = word.findall(lower(text or ""))
    hit, ids = set(), set()
    for i, t in items:
        v = word.findall(lower(t or ""))
        k = min(n, len(v))
        wins = {tuple(v[a : a + k]) for a in range(len(v) - k + 1)} if k else set()
        for a in range(len(w) - k + 1 if k else 0):
            if tuple(w[a : a + k]) in wins:
                hit |= set(range(a, a + k))
                ids.add(str(i))
    return len(w), len(hit), sorted(ids)


@pytest.mark.parametrize("block", [1 << 25, 60])
def test_decontamination_equals_brute_force(spark, block):
    item = "Alpha beta, gamma delta epsilon zeta eta theta iota kappa lambda mu"
    items = [(1, item), (2, "Short one"), (3, None), (4, "!!"), (12, item), (5, "naïve Überraschung")]
    rows = [(1, f"before {item.upper()} after"), (2, "alpha beta gamma delta epsilon zeta eta theta iota"), (3, "a short, one; and naïve-Überraschung"), (4, ""), (5, None), (6, f"{item} {item}"), (6, f"{item} {item}")]
    d, b = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.digest(decontaminate.find_hits(d, b, block_bytes=block)).collect()
    assert len(got) == len(rows)
    for r in got:
        n, hit, ids = brute_hits(r["text"], items)
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"], r["items_sha256"]) == (n, hit, len(ids), hit > 0, decontaminate.sha256_of(ids))
    assert sorted(r["doc_id"] for r in decontaminate.remove_documents(d, b).collect()) == [2, 4, 5]
    assert decontaminate.remove_spans(d, b).where("doc_id = 1").first()["text"] == "before  after"


def labelled(spark, kind):
    rng = np.random.default_rng(9)
    rows, labels = [], []
    for i in range(300):
        bad = i % 4 == 0
        t = prose(rng, int(rng.integers(30, 200)))
        if bad and kind == "quality":
            t = t.upper().replace(" ", "!! ")
        if bad and kind == "toxic":
            t += " you insultword and " + prose(rng, 20)
        rows.append((i, t))
        labels.append((i, int(not bad) if kind == "quality" else 1, int(bad) if kind == "toxic" else 0))
    rows += [(1000, ""), (1001, None)]
    labels += [(5, None, None), (None, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("module", "label", "n", "held"), [(quality_nbsvm, "quality", 5, 0), (toxicity_fm, "toxic", 3, 1)])
def test_classifiers_hold_out(spark, module, label, n, held):
    d, labels = labelled(spark, label)
    model = module.train(d, labels, fold("doc_id", n) != held)
    got = module.score(d, model).join(labels.where("quality is not null"), "doc_id").where(fold("doc_id", n) == held).collect()
    assert len(got) > 30
    assert np.mean([r["predicted"] == r[label] for r in got]) > 0.95
    every = module.score(d, model).collect()
    assert len(every) == 302
    assert all(0 <= r["score"] <= 1 for r in every)


@pytest.mark.parametrize("module", [quality_nbsvm, toxicity_fm])
def test_classifiers_without_labels(spark, module):
    d, labels = labelled(spark, "quality")
    model = module.train(d, labels.limit(0), F.lit(True))
    assert {round(r["score"], 3) for r in module.score(d, model).collect()} == {0.5}


def test_factorization_learns_a_parity():
    """Both terms are as frequent in both classes, so no additive model can do better than chance."""
    rng = np.random.default_rng(2)
    samples = []
    for _ in range(600):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        samples.append((prose(rng, 20) + " aaaa" * a + " bbbb" * b, int(a == b)))
    m = toxicity_fm.fit(samples, 0.5, rounds=40)
    at = {x: m.score(ft.of_text(x, ft.terms, toxicity_fm.SLOTS)) for x in ("", "aaaa", "bbbb", "aaaa bbbb")}
    assert min(at["aaaa bbbb"], at[""]) > 0.7 > 0.3 > max(at["aaaa"], at["bbbb"])


def test_factorization_scores_equal_all_pairs_summed(spark):
    d, labels = labelled(spark, "toxic")
    m = toxicity_fm.train(d, labels, F.lit(True))
    d = d.unionByName(spark.createDataFrame([(2000, LONG + " insultword")], "doc_id long, text string")).withColumn("score", F.lit("mine")).withColumn("a.b", F.lit(1))
    got = toxicity_fm.score(d.unionByName(d.where("doc_id = 3")), m).collect()
    assert len(got) == 304 and len({r["score"] for r in got if r["doc_id"] == 3}) == 1
    for r in got:
        at = [k for k in (m.index[x] for x in ft.of_text(r["text"], ft.terms, toxicity_fm.SLOTS)) if k >= 0]
        z = m.bias + sum(float(m.linear[i]) for i in at) + sum(float(m.factors[i].astype(float) @ m.factors[j]) for n, i in enumerate(at) for j in at[:n])
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-4)
    assert toxicity_fm.score(d.limit(0), m).count() == 0


def test_dual_descent_equals_brute_force():
    rng = np.random.default_rng(5)
    rows = [np.sort(rng.choice(12, 5, replace=False)) for _ in range(40)]
    y = np.where([(3 in x) ^ (rng.random() < 0.1) for x in rows], 1, -1)
    r = quality_nbsvm.log_count_ratios(rows, y, 12)
    counts = [1 + sum(k in x for x, z in zip(rows, y, strict=True) if z == s) for s in (1, -1) for k in range(12)]
    p, q = np.array(counts[:12], float), np.array(counts[12:], float)
    assert r == pytest.approx(np.log(p / p.sum()) - np.log(q / q.sum()))
    x = np.zeros((40, 13))
    for i, at in enumerate(rows):
        x[i, at] = r[at] / np.linalg.norm(r[at])
    x[:, 12] = 1  # the bias
    gram = (x @ x.T) * np.outer(y, y)
    alpha, step = np.zeros(40), 1 / np.linalg.eigvalsh(gram).max()
    for _ in range(20_000):
        alpha = np.clip(alpha - step * (gram @ alpha - 1), 0, 1)
    w, bias = quality_nbsvm.dual_descent(rows, y, r, np.ones(40), rounds=3000)
    want = (alpha * y) @ x
    assert np.append(w, bias) == pytest.approx(want, abs=0.02)
    primal = lambda v: (v @ v) / 2 + np.maximum(0, 1 - y * (x @ v)).sum()
    assert primal(np.append(w, bias)) == pytest.approx(primal(want), rel=1e-3)


def test_quality_scores_by_hand(spark):
    d, labels = labelled(spark, "quality")
    m = quality_nbsvm.train(d, labels, F.lit(True))
    d = d.unionByName(spark.createDataFrame([(2000, LONG)], "doc_id long, text string")).withColumn("predicted", F.lit("mine")).withColumn("a.b", F.lit(1))
    for r in quality_nbsvm.score(d.unionByName(d.where("doc_id = 3")), m).collect():
        at = ft.of_text(r["text"], ft.shapes, quality_nbsvm.SLOTS)
        z = m.bias + (sum(map(float, m.product[at])) / np.sqrt(sum(map(float, m.square[at]))) if len(at) else 0)
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-(m.slope * z + m.offset))), abs=1e-4)
        assert r["predicted"] == int(r["score"] >= 0.3)


def test_labelled_samples_are_bounded(spark):
    docs = spark.createDataFrame([(i % 10, f"text {i % 20} {'x' * 100}") for i in range(200)] + [(11, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, quality int")
    whole = labelled_sample(docs, labels, "quality", F.lit(True), 100)
    assert len(whole) == 11 and ("", 1) in whole
    assert len(labelled_sample(docs, labels, "quality", F.lit(True), 2)) == 4
    few = labelled_sample(docs, labels, "quality", F.lit(True), 100, most_bytes=500)
    assert 2 <= len(few) <= 7 and set(few) <= set(whole)


def brute_directory(sizes, limit):
    """hash -> (prefix bits, one hash that exceeds the limit), splitting from the root on."""
    out, queue = {}, [("", sizes)]
    while queue:
        bits, part = queue.pop()
        if sum(part.values()) <= limit or len(part) == 1:
            out |= {h: (bits, sum(part.values()) > limit) for h in part}
            continue
        for b in "01":
            half = {h: n for h, n in part.items() if format(h, "062b")[len(bits)] == b}
            if half:
                queue.append((bits + b, half))
    return out


@pytest.mark.parametrize("limit", [1000, 20_000, 10**9])
def test_extendible_shards_equal_brute_force(spark, limit):
    rows = [(i, "x" * int(50 + i % 200)) for i in range(1000)] + [(5000, "y" * 40_000), (5001, None), (None, "null key")] + [(7, "z" * 900)] * 30 + [(8, "q" * limit)] * (limit < 10**6)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("mine") for c in ("shard_id", "shard", "_h", "_row", "a.b")})
    hashes = {r["doc_id"]: r["h"] for r in df.select("doc_id", extendible.hash_of("doc_id").alias("h")).collect()}
    sizes: Counter = Counter()
    for i, t in rows:
        sizes[hashes[i]] += len(t or "")
    want = brute_directory(sizes, limit)
    got = extendible.shard(df, limit=limit).collect()
    assert len(got) == len(rows) and set(got[0].asDict()) == {*df.columns, "depth", "n_bytes"}
    held: Counter = Counter()
    for r in got:
        bits, whole = want[hashes[r["doc_id"]]]
        own, _, chunk = r["shard_id"].partition("-")
        assert r["n_bytes"] == len(r["text"] or "") and bool(chunk) == whole and r["shard"] == r["_h"] == "mine"
        assert own.startswith(bits) if whole else own == bits and r["depth"] == len(bits)
        held[r["shard_id"]] += r["n_bytes"]
    count = Counter(r["shard_id"] for r in got)
    assert all(b <= limit or count[s] == 1 for s, b in held.items())
    assert extendible.shard(df.limit(0)).count() == 0


def test_host_and_path(spark):
    urls = [("http://A.Ex.ORG/fr/1?x#y",), (None,), ("nothing",), ("x://h?q",), ("x://h",), ("ftp://u#f/a",)]
    got = spark.createDataFrame(urls, "url string").select(host_reputation.url_host(F.col("url")), host_reputation.url_path(F.col("url"))).collect()
    assert [tuple(r) for r in got] == [("a.ex.org", "/fr/1"), ("", ""), ("", ""), ("h", ""), ("h", ""), ("u", "")]


def test_reputation_blocks_bad_hosts_and_obeys_rules(spark):
    pages, labels = [], []
    for i in range(120):
        host = ("bad.example.org", "good.example.org", "few.other.org")[i % 3 if i < 110 else 1]
        if host == "few.other.org" and i > 6:
            host = "good.example.org"
        pages.append((i, f"http://{host}/x/{i}"))
        labels.append((i, int(host != "bad.example.org"), 0))
    pages += [(900, "http://www.example.net/en/1"), (901, "http://www.example.net/xx/1"), (902, "http://bad.example.org/fr/1"), (903, None), (904, "http://Unknown.example.org/a")]
    got = {r["page_id"]: r for r in host_reputation.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert len(got) == len(pages)
    assert got[0]["verdict"] == "block" and got[1]["verdict"] == "allow"
    assert [(got[i]["rule"], got[i]["verdict"]) for i in (900, 901, 902)] == [("example.net/en/", "allow"), ("net/", "block"), ("org/fr/", "allow")]
    assert got[903]["verdict"] == "allow" and got[904]["verdict"] == "allow"


def crossing_by_hand(text, ids, lengths, bounds, rule):
    """Tokens of each section, character by character."""
    byte_char = [i for i, c in enumerate(text) for _ in c.encode()]
    section = lambda c: next(k for k, e in enumerate(bounds) if c < e)
    out, at = [0.0] * len(bounds), 0
    for i in ids:
        own = sorted(set(byte_char[at : at + lengths[i]]))
        at += lengths[i]
        if rule == "share":
            for c in own:
                out[section(c)] += 1 / len(own)
        else:
            out[section(own[0] if rule == "start" else own[-1])] += 1
    return out


@pytest.mark.skipif(not Path(token_spans.RANKS).exists(), reason="no tokenizer")
@pytest.mark.parametrize("rule", token_spans.RULES)
def test_token_spans_equal_brute_force(spark, rule):
    bpe, lengths = token_spans.encoder(Path(token_spans.RANKS).read_bytes())
    texts = ["one line\nand two\n\n  indented \u00e9\n", "", None, "no break", "\n\n\n", "a \n\n b\n \u65e5\u672c\n\n\n\t x", "y" * 50_000, "one line\nand two\n\n  indented \u00e9\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("a.b", F.lit(1)).withColumn("section", F.lit("mine"))
    got = token_spans.count_sections(df, rule).collect()
    for i, t in enumerate(texts):
        own = sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["section"])
        ids = bpe.encode_ordinary(t or "")
        bounds = [r["end_char"] for r in own]
        assert bounds[-1] == len(t or "") and [r["start_char"] for r in own] == [0, *bounds[:-1]]
        assert "".join((t or "")[r["start_char"] : r["end_char"]] for r in own) == (t or "")
        assert all(r["doc_tokens"] == len(ids) for r in own)
        assert [r["n_tokens"] for r in own] == pytest.approx(crossing_by_hand(t or "", ids, lengths, bounds, rule))
    assert token_spans.count_sections(df.limit(0), rule).count() == 0


@pytest.mark.skipif(not Path(token_spans.RANKS).exists(), reason="no tokenizer")
def test_tokens_of_named_fields(spark):
    bpe, _ = token_spans.encoder(Path(token_spans.RANKS).read_bytes())
    df = spark.createDataFrame([(1, "A title", None, "the body"), (2, None, "", "")], "doc_id long, `my.title` string, empty string, body string")
    got = {(r["doc_id"], r["field"]): r for r in token_spans.count_fields(df, ["my.title", "empty", "body"]).collect()}
    assert [got[1, f]["end_char"] for f in ("my.title", "empty", "body")] == [8, 9, 17]
    assert sum(got[1, f]["n_tokens"] for f in ("my.title", "empty", "body")) == len(bpe.encode_ordinary("A title\n\nthe body"))
    assert got[2, "body"]["n_tokens"] == 0
    with pytest.raises(ValueError):
        token_spans.count_sections(df.withColumn("text", F.lit("")), "middle")


def dense_rates(t, p, goal, ridge):
    """Accelerated projected gradient over all rates at once."""
    w, r = t / t.sum(), np.ones(len(t))
    y, a = r.copy(), 1.0
    step = 1 / (np.linalg.eigvalsh((p * w[:, None]).T @ p).max() + ridge)
    for _ in range(200_000):
        new = np.maximum(0, y - step * (p @ ((y * w) @ p - goal) + ridge * (y - 1)))
        a = 1.0 if ((y - new) * (new - r)).sum() > 0 else a
        b = (1 + np.sqrt(1 + 4 * a * a)) / 2
        y = new + (a - 1) / b * (new - r)
        if np.abs(new - r).max() < 1e-13:
            return new
        r, a = new, b
    return r


@pytest.mark.parametrize(("shape", "targets", "missed"), [([2, 0.5, 0.5], (0.7, 0.15, 0.15), False), ([20, 0.1, 0.1], (0.1, 0.8, 0.1), True)])
def test_rates_equal_a_dense_solver(spark, shape, targets, missed):
    rng = np.random.default_rng(6)
    p = rng.dirichlet(shape, 300)
    n = rng.integers(0, 500, 300)
    table = spark.createDataFrame([(i, int(n[i]), *map(float, p[i])) for i in range(300)], "doc_id long, n_tokens long, p_clean double, p_toxic double, p_low double")
    goal = dict(zip(mixing.DOMAINS, targets, strict=True))
    fit = mixing.solve(table, goal, ridge=1e-3)
    r = np.array([x["rate"] for x in mixing.with_rates(table, fit).orderBy("doc_id").collect()])
    assert fit.converged and (r >= 0).all()
    assert np.abs(r - dense_rates(n.astype(float), p, np.array(targets), 1e-3)).max() < 1e-5
    assert list(fit.totals.values()) == pytest.approx(((r * n) @ p / n.sum()).tolist())
    assert bool(fit.missed) == missed


def test_mixing_from_texts_to_rows(spark):
    docs, labels = labelled(spark, "toxic")
    docs = docs.withColumn("rate", F.lit("mine")).withColumn("a.b", F.lit(1)).unionByName(docs.where("doc_id = 7").withColumn("rate", F.lit("mine")).withColumn("a.b", F.lit(1)))
    rates, fit = mixing.fit_rates(docs, labels, {"clean": 0.8, "toxic": 0.2})
    rows = rates.collect()
    assert fit.converged and not fit.missed and len(rows) == docs.count()
    assert len({r["rate"] for r in rows if r["doc_id"] == 7}) == 1
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (1000, 1001)} == {0}
    out = mixing.resample(docs, labels, {"clean": 0.8, "toxic": 0.2})
    assert out.columns == docs.columns
    drawn = dict(out.groupBy("doc_id").count().collect())
    assert all(r["rate"] - 1 < drawn.get(r["doc_id"], 0) / (2 if r["doc_id"] == 7 else 1) < r["rate"] + 1 for r in rows)
    assert mixing.document_rates(docs.limit(0), labels).count() == 0
    with pytest.raises(ValueError):
        mixing.solve(rates, {"clean": -1.0})


def test_wrappers_find_the_article(spark):
    page = '<html><head><title>T</title><script>var a="</p>";</script></head><body><nav><ul><li>m<li>n</ul></nav><div class="ad">buy</div><article><h1>Head &amp; tail</h1><p>One <b>b</b>old.<br>two<p>Three<div class="comments"><p>me too</div></article><aside>s</aside><footer>f</footer>'
    rows = [(1, "http://a.org/1", page), (2, "http://a.org/2", page.replace("One", "Other")), (3, "http://a.org/3", None), (4, "http://b.org/1", ""), (5, None, "<p>a</p><p>b&nbsp;c</p>"), (6, "http://c.org", "<div id=cookie-notice>ok</div><p>plain  text")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("mine"))
    got = {r["page_id"]: r["text"] for r in wrappers.extract(df).collect()}
    assert got == {1: "Head & tail One bold. two Three", 2: "Head & tail Other bold. two Three", 3: "", 4: "", 5: "a b c", 6: "plain text"}


def test_wrappers_infer_groups_options_and_slots():
    a = wrappers.skeleton("<ul><li>x</li><li>y</li></ul><h1>t1</h1><p>same</p>")
    b = wrappers.skeleton("<ul><li>z</li></ul><h1>t2</h1><h2>sub</h2><p>same</p>")
    w = wrappers.Wrapper()
    w.add(a, 1)
    w.add(b, 1)
    assert [x[0] for x in w.nodes] == ["+", "#", "?", "#"]
    assert w.nodes[1][2] is None and w.nodes[3][2] == "same"


def read_host(spark, pages):
    rows = [(i, f"http://host.org/{i}", html) for i, html in enumerate(pages)]
    got = wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    return [r["text"] for r in sorted(got)]


def test_wrappers_keep_texts_of_few_or_equal_pages(spark):
    pages = ["<p>all rights</p><h1>t1</h1><div>one</div>", "<p>all rights</p><h1>t2</h1><div>two</div>", "<p>all rights</p><h1>t3</h1><div>three</div><blockquote>Q</blockquote>"]
    assert read_host(spark, pages) == ["t1 one", "t2 two", "t3 three Q"]
    assert read_host(spark, pages[:1] * 4) == ["all rights t1 one"] * 4
    assert read_host(spark, pages[:1] * 3 + pages[1:2]) == ["all rights t1 one"] * 3 + ["all rights t2 two"]


def read_all(pages):
    w = wrappers.Wrapper()
    for html in pages:
        w.add(wrappers.skeleton(html), 1)
    return [wrappers.read(html, w.table()) for html in pages]


PROBES = [
    ('<main><div class="side-by-side"><p>Body</p></div></main>', "Body"),
    ('<article><section class="discussion"><p>D</p></section></article>', "D"),
    ('<article><p>see <a class="related">this</a> now</p></article>', "see this now"),
    ('<header>top</header><article><header><h1>T</h1></header><p>x <label>l</label></p><ul class="comment-list"><li>c</ul></article>', "T x l"),
    ('<div class="article-header">A</div><div class="site-header">s</div><p>b<form><p>f</form>', "A b"),
    ('<div role="banner">s</div><div id="reader-comments"><p>c</div><p>b', "b"),
    ("<p>one</div></section><p>two", "one two"),
    ("<div>" * 20_000 + "<p>deep" + "</div>" * 20_000 + "</x>" * 20_000, "deep"),
]


@pytest.mark.parametrize(("html", "want"), PROBES)
def test_parts_are_named_by_whole_words(html, want):
    assert wrappers.read(html, None) == want


def accepts(nodes):
    """The wrapper as a regular expression over the paths of lines."""
    return "".join(f"(?:{re.escape(x[1])},)" if x[0] == "#" else f"(?:{accepts(x[1])}){x[0]}" for x in nodes)


def paths_of(html):
    return "".join(f"{wrappers.content_of(x)[0]}," for x in wrappers.lines(html) if wrappers.content_of(x)[0] is not None)


def test_wrappers_match_their_pages_and_their_template_equals_brute_force():
    """Hosts of random pages: lines of a few kinds, some of them the same on each page, others of the page's own."""
    rng = np.random.default_rng(3)
    for _ in range(30):
        kinds = ["h1", "p", "div", "h2", "h3", "section"]
        fixed = {k: f"template {k}" for k in kinds if rng.random() < 0.4}
        pages = []
        for i in range(int(rng.integers(3, 9))):
            body = [(k, f"own {i} {n} {rng.integers(10**9)}") for n in range(int(rng.integers(1, 12))) for k in [kinds[rng.integers(6)]]]
            body += [(k, t) for k, t in fixed.items()]
            order = rng.permutation(len(body)) if rng.random() < 0.5 else sorted(range(len(body)), key=lambda x: body[x][0])
            pages.append("".join(f"<{body[j][0]}>{body[j][1]}</{body[j][0]}>" for j in order))
        w = wrappers.Wrapper()
        for html in pages:
            w.add(wrappers.skeleton(html), 1)
        rule = re.compile(accepts(w.nodes))
        for i, html in enumerate(pages):
            assert len(w.nodes) <= 200 and rule.fullmatch(paths_of(html)), (w.nodes, html)
            got = wrappers.read(html, w.table())
            own = re.findall(r"own \d+ \d+ \d+", html)
            assert re.findall(r"own \d+ \d+ \d+", got) == own
        if all(sorted(p.count(f"<{k}>") for k in kinds) == sorted(pages[0].count(f"<{k}>") for k in kinds) for p in pages):
            assert "template" not in got


def test_wrappers_decide_where_names_say_nothing(spark):
    """Neutral names: only what the alignment finds equal on pages that differ tells the template."""
    pages = [f'<div class="c1">Start</div><div class="c2">Home and more</div><div class="c3"><b>Story {i}</b></div><div class="c3">Text {i * i}.</div><div class="c4">All rights</div>' for i in range(5)]
    rows = [(i, "http://n.org/x", html) for i, html in enumerate(pages)] + [(9, "http://alone.org/", pages[0]), (10, "http://n.org/x", pages[0])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("mine") for c in ("_host", "_row", "n_chars", "a.b")})
    got = wrappers.extract(df)
    assert set(got.columns) == {*df.columns, "text"}
    texts = {r["page_id"]: (r["text"], r["n_chars"], r["a.b"], r["_host"]) for r in got.collect()}
    want = {i: f"Story {i} Text {i * i}." for i in range(5)} | {10: "Story 0 Text 0."}
    assert all(texts[i] == (t, len(t), "mine", "mine") for i, t in want.items())
    assert texts[9][0] == "Start Home and more Story 0 Text 0. All rights"
    assert wrappers.extract(df.limit(0)).count() == 0


def test_wrappers_read_pages_of_mixed_templates():
    assert read_all(["<article><p>in</p></article><div>out</div>", "<div><p>one</p></div>", "<div>two</div>"]) == ["in", "one", "two"]


def test_wrappers_compare_whole_texts():
    lead = "The same long lead of every report that this host has ever put on a page of its own: "
    assert read_all([f"<h1>t{i}</h1><p>{lead}{i}</p>" for i in range(4)]) == [f"t{i} {lead}{i}" for i in range(4)]
    assert read_all([f"<h1>t{i}</h1><p>{' ' * 500}{lead}</p>" for i in range(4)]) == [f"t{i}" for i in range(4)]


def test_wrappers_merge_long_streams():
    long = "".join(f"<x{k}>same{k}</x{k}>" for k in range(3000))
    assert read_all([f"{long}<h6>t{i}</h6>" for i in range(4)]) == [f"t{i}" for i in range(4)]


def test_wrappers_find_the_template_inside_the_article(spark):
    body = "<nav>menu</nav><article><h1>t{i}</h1><p>See <b>one {i}</b>.</p>{more}<p>Read our terms of use, which hold for all texts.</p><div>Share</div></article>"
    pages = [body.format(i=i, more="<p>more</p>" * (i % 2) + f"<h2>s{i}</h2>") for i in range(5)]
    want = [f"t{i} See one {i}.{' more' * (i % 2)} s{i}" for i in range(5)]
    assert read_all(pages) == want
    assert read_host(spark, pages) == want
    parts = [wrappers.Wrapper() for _ in range(3)]
    for i, html in enumerate(pages):
        parts[i % 3].add(wrappers.skeleton(html), 1)
    for w in parts[1:]:
        parts[0].add(w.nodes, w.pages)
    assert [wrappers.read(html, parts[0].table()) for html in pages] == want


def test_spans_of_several_blocks_are_cut_in_order(spark):
    items = [(i, " ".join(f"{c}{k}" for k in range(10))) for i, c in enumerate("abcdef")]
    b = spark.createDataFrame(items, "item_id long, text string")
    d = spark.createDataFrame([(1, f"x {items[i][1]} y {items[j][1]} z") for i in range(6) for j in range(6) if i != j], "doc_id long, text string")
    assert len([x for x in decontaminate.blocks(b, 40) if x]) > 1
    for r in decontaminate.find_hits(d, b, block_bytes=40).collect():
        assert r["hit_words"] == [*range(1, 11), *range(12, 22)]
    assert {r["text"] for r in decontaminate.remove_spans(d, b, block_bytes=40).collect()} == {"x  y  z"}


def in_duckdb(sql, **tables):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for name, df in tables.items():
        c.register(name, pa.Table.from_pandas(df.toPandas()) if df.count() else df.toArrow())
    got = c.execute(sql)
    names = [x[0] for x in got.description]
    return sorted((tuple(sorted(zip(names, r, strict=True))) for r in got.fetchall()), key=str)


def of_spark(df):
    return sorted((tuple(sorted(r.asDict().items())) for r in df.collect()), key=str)


def test_reputation_equals_its_sql_where_all_levels_block(spark):
    rng = np.random.default_rng(1)
    pages, labels = [(9000, None), (9001, "no scheme"), (9002, "x://"), (9003, "http://example.net/en/1")], []
    hosts = {"a.bad.org": 0.02, "b.bad.org": 0.05, "c.bad.org": 0.0, "x.fine.org": 0.97, "y.fine.org": 0.9, "q.shop.co.uk": 0.1, "r.shop.co.uk": 0.0, "s.other.co.uk": 0.95, "k.junk": 0.0, "m.more.junk": 0.02, "n.more.junk": 0.01, "z.new.junk": None, "d.bad.org": None, "deep.d.bad.org": None, "w.co.uk": None, "lone": 0.5}
    for h, (host, good) in enumerate(hosts.items()):
        for i in range(60):
            n = h * 100 + i
            pages.append((n, f"http://{host.upper() if i % 2 else host}/p/{n}.html?x=1"))
            if good is not None and i < 40:
                labels.append((n, int(rng.random() < good), int(rng.random() < 0.02)))
    labels += [(None, 1, 0), (5, None, 1)]
    p = spark.createDataFrame(pages, "page_id long, url string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    clash = p.withColumns({c: F.lit("mine") for c in ("_row", "domain", "suffix", "_host", "_b", "rule", "a.b")})
    judged = host_reputation.judge(clash, lab)
    assert set(judged.columns) == {*clash.columns, "host", "path", "verdict", "reputation", "upper"}
    assert judged.where("domain = 'mine' and suffix = 'mine' and _b = 'mine'").count() == len(pages)
    got = judged.select("page_id", "host", "path", "rule", "verdict")
    assert of_spark(got) == in_duckdb(queries.OP4_SQL, pages=p, labels=lab)
    verdicts = {r["host"]: r["verdict"] for r in got.where("rule is null").collect()}
    assert {h: verdicts[h] for h in ("a.bad.org", "d.bad.org", "z.new.junk", "x.fine.org", "s.other.co.uk", "lone")} == {"a.bad.org": "block", "d.bad.org": "block", "z.new.junk": "block", "x.fine.org": "allow", "s.other.co.uk": "allow", "lone": "allow"}
    assert {verdicts[h] for h in ("q.shop.co.uk", "r.shop.co.uk")} == {"block"}
    assert host_reputation.judge(p.limit(0), lab.limit(0)).count() == 0


def test_decontamination_equals_its_sql(spark):
    item = "Alpha beta, gamma delta epsilon zeta eta theta iota kappa lambda mu"
    items = [(1, item), (2, "Short one"), (3, None), (4, "!!"), (12, item), (5, "na\u00efve \u00dcberraschung")]
    rows = [(1, f"before {item.upper()} after"), (2, "alpha beta gamma delta epsilon zeta eta theta iota"), (3, "a short, one; and na\u00efve-\u00dcberraschung"), (4, ""), (5, None), (6, f"{item} {item}"), (7, LONG + " short one " + LONG)]
    d, b = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    clash = d.withColumns({c: F.lit("mine") for c in ("n_words", "_row", "_d", "a.b")})
    for some in (b, b.limit(0)):
        found = decontaminate.digest(decontaminate.find_hits(clash, some)).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
        assert of_spark(found) == in_duckdb(queries.OP6_SQL, documents=d, benchmark=some)
    assert decontaminate.find_hits(clash.limit(0), b).count() == 0
    assert set(decontaminate.find_hits(clash, b, block_bytes=60).columns) == {*clash.columns, "hit_words", "item_ids"}


def test_built_blocks_are_bounded():
    items = [(i, " ".join(f"w{(i * 7919 + k * 104729) % 50021}" for k in range(100))) for i in range(500)]
    assert decontaminate.Windows(items).n_bytes < 8 * sum(len(t) for _, t in items)
