"""Near-dedup of texts and vectors, and decontamination, against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from spanloom.llm.common import Scratch, components, hash_fraction
from spanloom.llm.decontaminate import _keyed, _windows, decontaminate, drop_contaminated, window_hits
from spanloom.llm.minhash import MinHashParams, exact_links, least_matches, minhash_dedup
from spanloom.llm.vectordedup import embedding_dedup, principal_axes, tile_pairs


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def roots(nodes, links):
    """Smallest reachable node by repeated merging."""
    root = {x: x for x in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    return root


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def noisy_texts(seed=4):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([30, 80, 160]))]
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 1, 3])):
            near = list(base)
            for _ in range(rng.choice([0, 1, 2, 6])):
                near[rng.randrange(len(near))] = rng.choice(vocabulary)
            texts.append(rng.choice([" ", "\n"]).join(near).upper() if rng.random() < 0.3 else " ".join(near))
    return texts


@pytest.mark.parametrize("block", [512, 3])
def test_minhash_equals_brute_force(spark, block):
    texts = [*noisy_texts(), "", None, "  \n", "one two", "ONE two", "one  two", "a b c d e", "a b c d e", "b c d e a", "word " * 3000]
    rows = [(100 + i, t, "c", i) for i, t in enumerate(texts)]
    sets = {i: shingles(t) for i, t, _, _ in rows}
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = roots(sets, links)
    df = spark.createDataFrame(rows, "doc_id bigint, text string, component string, kept int").repartition(3)
    got = {r["doc_id"]: r for r in minhash_dedup(df, params=MinHashParams(block=block)).collect()}
    assert len(links) > 10 and got.keys() == sets.keys()
    for i, r in got.items():
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[i]), want[i], want[i] == i)


def test_minhash_of_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a b c"), (1, "x y z"), (None, "a b c"), (None, "q"), (3, "x y z"), (2, None)], "doc_id bigint, text string")
    got = [(str(r["doc_id"]), r["n_shingles"], r["component_id"], r["kept"]) for r in minhash_dedup(df).collect()]
    assert len(got) == 6 and ("None", 1, None, True) in got and ("2", 0, 2, True) in got and ("3", 1, 1, False) in got and ("None", 1, 1, False) in got
    assert minhash_dedup(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="missing"):
        minhash_dedup(df.drop("text"))


def swapping(n):
    """Two texts of 2**n letters a and b whose weak hashes are equal from 2**10 on: each letter of one is the other's other."""
    t = "a"
    for _ in range(n):
        t += t.translate({97: 98, 98: 97})
    return t, t.translate({97: 98, 98: 97})


@pytest.mark.parametrize("n", [9, 10, 12, 13])
def test_words_whose_weak_hashes_meet_are_told_apart(spark, n):
    import pyarrow as pa

    from spanloom.llm.textbytes import WordHashes, byte_view, content_hash, hash_spans, word_spans

    a, b = swapping(n)
    np.seterr(over="ignore")
    data, at = byte_view(pa.array([f"{a} {b} {a} x", f"{b} {a}", b], pa.large_string()))
    starts, ends, _ = word_spans(data, at, "space")
    weak = hash_spans(data, starts, ends)
    assert (weak[0] == weak[1]) == (n >= 10)
    hashes = WordHashes(room=100)
    for _ in range(2):
        assert hashes(data, starts, ends).tolist() == [content_hash(w.encode()) for w in (a, b, a, "x", b, a, b)]
    tail = " one two three four five six seven eight"
    df = spark.createDataFrame([(1, a), (2, b), (3, a), (4, a + tail), (5, b + tail)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash_dedup(df).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}


def test_remembered_words_are_forgotten_in_time():
    import pyarrow as pa

    from spanloom.llm.textbytes import WordHashes, byte_view, content_hash, word_spans

    np.seterr(over="ignore")
    hashes = WordHashes(room=50)
    for k in range(6):
        words = [f"w{i * 7 % 90}" + "x" * (i % 80) for i in range(k * 20, k * 20 + (40 if k < 5 else 80))]
        data, at = byte_view(pa.array([" ".join(words)], pa.large_string()))
        starts, ends, _ = word_spans(data, at, "space")
        assert hashes(data, starts, ends).tolist() == [content_hash(w.encode()) for w in words]


def test_a_class_of_very_many_copies_is_whole(spark):
    rows = [(i, "the same words in every one of these rows") for i in range(3000)] + [(5000 + i, None) for i in range(300)] + [(None, "the same words in every one of these rows")] * 3
    got = minhash_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(got) == len(rows) and sum(r["component_id"] == 0 for r in got) == 3003
    assert all(r["component_id"] == r["doc_id"] and r["kept"] for r in got if r["n_shingles"] == 0)


def test_pruning_bounds_follow_the_posterior():
    p = MinHashParams()
    bounds = least_matches(p)
    assert [n for n, _ in bounds] == [20, 40, 60, 80, 100, 120]
    rng = np.random.default_rng(0)
    for n, m in bounds:
        sample = rng.beta(m + 1, n - m + 1, 200_000)
        below = rng.beta(m, n - m + 2, 200_000)
        assert (sample >= 0.85).mean() > p.miss / 2 and (below >= 0.85).mean() < p.miss * 2


@pytest.mark.parametrize("p", [MinHashParams(), MinHashParams(percent=80, bands=32, rows=5)])
def test_bands_and_cuts_together_miss_less_than_one_in_a_thousand(p):
    share, alive, done = p.percent / 100, np.ones(1), 0
    for n, least in least_matches(p):
        step = np.ones(1)
        for _ in range(n - done):
            step = np.convolve(step, [1 - share, share])
        alive, done = np.convolve(alive, step), n
        alive[:least] = 0
    assert 1 - alive.sum() + (1 - share**p.rows) ** p.bands < 1e-3


def test_exact_links_span_the_same_components():
    rng = random.Random(2)
    sets = [np.array(sorted(rng.sample(range(60), 40)), np.uint64) for _ in range(20)] + [np.arange(40, dtype=np.uint64), np.arange(1, 41, dtype=np.uint64)]
    p = MinHashParams(percent=60)
    links = [(i, j) for i, j in combinations(range(len(sets)), 2) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 60 * len(np.union1d(sets[i], sets[j]))]
    assert roots(range(22), list(exact_links(sets, 0, p))) == roots(range(22), links)
    across = [(i, j) for i, j in links if (i < 9) != (j < 9)]
    assert roots(range(22), list(exact_links(sets, 9, p))) == roots(range(22), across)


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(8)
    links = [(i, i + 1) for i in range(1, 200)] + [(i, i + 1) for i in range(1000, 3000)] + [(500, x) for x in range(501, 560)] + [(rng.randrange(700, 900), rng.randrange(700, 900)) for _ in range(150)] + [(950, 950)]
    rng.shuffle(links)
    want = roots({x for link in links for x in link}, links)
    df = spark.createDataFrame([*links, (None, 3), (4, None)], "a bigint, b bigint")
    got = {r["node"]: r["component"] for r in components(df, Scratch(spark)).collect()}
    assert got == {k: v for k, v in want.items() if k != 950}


def test_bounded_samples_are_stable(spark):
    df = spark.range(5000)
    a = {r["id"] for r in hash_fraction(df, df["id"], 200).collect()}
    assert a == {r["id"] for r in hash_fraction(df.repartition(7), df["id"], 200).collect()} and 120 < len(a) < 300
    assert hash_fraction(df, df["id"], 5000).count() == 5000


def vectors(seed=3, n=260, d=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(14, d)) * np.linspace(3, 0.4, d)
    x = centres[rng.integers(0, 14, n)] + rng.normal(size=(n, d)) * rng.choice([0.01, 0.3, 1.0], (n, 1))
    x[5] = x[9] = x[40]
    x[70] = 3 * x[71]
    return x


def brute(rows, threshold):
    ok = {i: np.array(v, float) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v) and any(v)}
    links = [
        (a, b) for a, b in combinations(ok, 2)
        if len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / (np.linalg.norm(ok[a]) * np.linalg.norm(ok[b])) >= threshold
    ]
    count = dict.fromkeys((i for i, _ in rows), 0)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    return count, roots(count, links)


@pytest.mark.parametrize("block_rows", [6144, 60])
@pytest.mark.parametrize("threshold", [0.9, 0.99])
def test_vector_links_equal_brute_force(spark, monkeypatch, block_rows, threshold):
    monkeypatch.setattr("spanloom.llm.vectordedup.BLOCK_ROWS", block_rows)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors())]
    rows += [(900, None), (901, [0.0] * 12), (902, [1.0] * 11 + [float("nan")]), (903, [1.0] * 11 + [None]), (904, [float("inf")] * 12), (905, []), (906, [1.0, 2.0]), (907, [1.0, 2.0]), (908, [2.0, 4.1])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id bigint, embedding array<double>, label int, rep string")
    count, root = brute(rows, threshold)
    got = {r["vec_id"]: r for r in embedding_dedup(df, threshold=threshold).collect()}
    assert sum(count.values()) > 300 and got.keys() == count.keys()
    for i, r in got.items():
        assert (r["n_links"], r["component_id"], r["kept"]) == (count[i], root[i], root[i] == i), i


def test_vectors_none_or_all_alike(spark):
    schema = "vec_id bigint, embedding array<float>"
    assert embedding_dedup(spark.createDataFrame([], schema)).count() == 0
    same = embedding_dedup(spark.createDataFrame([(i, [1.0, 0.5]) for i in range(1, 51)] + [(None, [1.0, 0.5])], schema)).collect()
    assert len(same) == 51 and {(r["n_links"], r["component_id"]) for r in same if r["vec_id"]} == {(49, 1)}


def test_many_vectors_of_one_first_coordinate(spark, monkeypatch):
    """Half of all vectors share the leading coordinate: their range is cut into blocks, and no link is lost."""
    from spanloom.llm import vectordedup

    monkeypatch.setattr(vectordedup, "BLOCK_ROWS", 25)
    rng = np.random.default_rng(4)
    flat = np.column_stack([np.zeros(90), rng.normal(size=(90, 3))])
    wide = np.column_stack([rng.choice([-9.0, 9.0], 90), rng.normal(size=(90, 3))])
    x = np.concatenate([flat, wide])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = [(i, j) for i, j in combinations(range(180), 2) if unit[i] @ unit[j] >= 0.9]
    want = roots(range(180), links)
    degree = Counter(i for link in links for i in link)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup(df).collect()}
    assert got == {i: (degree[i], want[i]) for i in range(180)} and len(links) > 50


def test_no_pair_at_the_threshold_is_lost_to_the_bounds():
    x = vectors(6, 200, 16)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = x @ principal_axes(x)
    want = {(i, j) for i, j in combinations(range(200), 2) if x[i] @ x[j] >= 0.9}
    got = {(int(i), int(j)) for a, b in tile_pairs(z, z, 0.9, True) for i, j in zip(a, b, strict=True)}
    assert want <= got


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination(docs, items, width):
    windows = {}
    for item, text in items:
        w = WORD.findall(lower(text or ""))
        for i in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + width]), set()).add(item)
    out = []
    for doc, text in docs:
        w = WORD.findall(lower(text or ""))
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        out.append((doc, len(w), len(hit), sorted(map(str, found)), bool(hit)))
    return out


@pytest.mark.parametrize("limit", [100_000, 0])
def test_decontamination_equals_brute_force(spark, limit):
    rng = random.Random(12)
    words = ["der", "die", "das", "Ärger", "x1", "été", "the", "of", "queen", "Kelvin", "K", "rare"]
    make = lambda n: " ".join(rng.choice(words) + rng.choice(["", ",", "."]) for _ in range(n))
    items = [(i, make(rng.choice([3, 5, 8]))) for i in range(12)] + [(50, None), (51, ""), (52, "..."), (53, "the of the of the of"), (54, "the of the of the of"), (10, "a second text of item ten")]
    docs = [(i, make(rng.choice([0, 2, 40, 300]))) for i in range(25)]
    docs += [(100 + i, make(6) + "; " + (items[i][1] or "").upper().replace(" ", "--") + " " + make(4)) for i in range(14)]
    docs += [(200, None), (201, ""), (202, "the of " * 500), (203, "!!!")]
    want = {d: x for d, *x in contamination(docs, items, 5)}
    table = spark.createDataFrame([(d, t, "w", 3) for d, t in docs], "doc_id bigint, text string, word string, n int")
    bench = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id bigint, text string, window string")
    got = decontaminate(table, bench, width=5, broadcast_rows=limit).collect()
    assert len(got) == len(docs) and sum(r["contaminated"] for r in got) > 10
    for r in got:
        assert [r["n_words"], r["n_hit"], r["items"], r["contaminated"]] == want[r["doc_id"]], r["doc_id"]
        assert r["n_items"] == len(r["items"])


@pytest.mark.parametrize("limit", [100_000, 0])
def test_rows_that_share_an_id_have_their_own_hits(spark, limit):
    leak = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    long = " ".join(f"w{i}" for i in range(5000))
    docs = [(1, f"so {leak}"), (1, "harmless words"), (1, f"{leak} and {leak}"), (None, leak), (None, "harmless too"), (None, "harmless too"), (1, f"so {leak}"), (2, f"{long} {leak} {long}"), (3, None)]
    table = spark.createDataFrame([(d, t, "h", None, 1) for d, t in docs], "doc_id bigint, text string, hit_id string, digest binary, row int")
    bench = spark.createDataFrame([(7, leak)], "item_id bigint, text string")
    got = decontaminate(table, bench, broadcast_rows=limit).collect()
    hand = contamination(docs, [(7, leak)], 10)
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["items"]) for r in got) == sorted((str(d), n, h, i) for d, n, h, i, _ in hand)
    left = drop_contaminated(table, bench, broadcast_rows=limit)
    assert left.columns == table.columns
    assert sorted(str((r["doc_id"], r["text"])) for r in left.collect()) == sorted(str((d, t)) for d, t in docs if leak not in (t or ""))


@pytest.mark.parametrize("core", [1, 7, 64])
def test_windows_across_blocks_are_found(spark, core):
    rng = random.Random(core)
    words = ["aa", "bb", "cc", "dd"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([3, 64, 130, 200])))) for i in range(12)]
    items = [(i, " ".join(rng.choice(words) for _ in range(6))) for i in range(6)]
    table = _keyed(spark.createDataFrame(docs, "doc_id bigint, text string"), "doc_id", "text")
    windows = _windows(spark.createDataFrame(items, "item_id bigint, text string"), "item_id", "text", 6)
    got = sorted((r["doc"], r["start"]) for r in window_hits(table, windows, Scratch(spark), 1000, 6, core).distinct().collect())
    wanted = {tuple(t.split()) for _, t in items}
    assert got == sorted((d, i) for d, t in docs for w in [t.split()] for i in range(len(w) - 5) if tuple(w[i : i + 6]) in wanted)


def test_nothing_contaminates_without_items(spark):
    docs = spark.createDataFrame([(1, "a b c"), (None, "a b c")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert {(r["n_words"], r["n_hit"]) for r in decontaminate(docs, none).collect()} == {(3, 0)}
    some = spark.createDataFrame([(9, "b c")], "item_id bigint, text string")
    assert [r["n_hit"] for r in decontaminate(docs, some).collect()] == [2, 2]
    assert decontaminate(docs.limit(0), some).count() == 0
