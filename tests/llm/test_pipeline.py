"""The pipeline: each stage on its own input, and the guard around the whole."""

from __future__ import annotations

import random
import re
import zlib
from itertools import combinations

import pytest

import corpus_pipeline as cp
from spanloom.llm.bpe import default_tokenizer, encoder_of
from spanloom.llm.secrets import base_spans

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents of every kind that a stage decides on, their labels and a benchmark."""
    clean = [f"story number {i} goes on with words like w{i} and x{i * 7} then y{i * 3} ends quietly here" for i in range(60)]
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("aeioustnrl") for _ in range(6))
    toxic = [f"{word()} {word()} {word()} grobnak {word()} {word()} grobnak {word()} {word()} {word()} {i}" for i in range(40)]
    leak = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    rows = list(enumerate(clean + toxic))
    rows += [(200, clean[0]), (201, clean[0].upper()), (202, f"before {leak} after"), (203, "password=abcdef1234 is in the middle of it"), (204, None), (205, ""), (206, "unlabelled grobnak appears and another grobnak again"), (None, "a row without id but text of its own kind")]
    rows += [(300, "several words that stay " * 700)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(60 <= i < 100)) for i in range(100)], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, leak), (2, None)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows


def read(spark, path):
    return spark.read.parquet(f"{path}/documents.parquet")


def test_stages_are_named_in_order():
    assert [n for n, _ in cp.STAGES] == ["toxicity", "minhash_near_dedup", "decontamination", "secrets", "packing"]


def test_toxic_documents_go(spark, tables):
    path, rows = tables
    out = cp.drop_toxic(spark, read(spark, path), path)
    kept = {r["doc_id"] for r in out.collect()}
    assert out.columns == COLUMNS and {i for i, _ in rows} - kept == {*range(60, 100), 206}


def test_one_of_each_group_of_near_copies_stays(spark, tables):
    path, rows = tables
    out = cp.drop_near_copies(spark, read(spark, path), path)
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    linked = {b for a, b in combinations(sorted(x for x in sets if x is not None), 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    assert out.columns == COLUMNS and linked == {200, 201}
    assert sorted(str(r["doc_id"]) for r in out.collect()) == sorted(str(i) for i, _ in rows if i not in linked)


def test_near_copies_from_eighty_on_go(spark, tables):
    path, _ = tables
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(8)) for _ in range(6000)]
    rows, sets = [], {}
    for g in range(40):
        # A changed word costs five shingles of 105: one change is a Jaccard index of 100 / 110, two of 95 / 115, three of 90 / 120.
        own = words[150 * g : 150 * g + 109]
        for i, changed in enumerate([[], [20, 60]] if g % 2 else [[], [20, 50, 80]]):
            rows.append((2 * g + i, " ".join("changed" + str(g) if k in changed else w for k, w in enumerate(own))))
    for i, t in rows:
        w = t.split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    share = {b: len(sets[b - 1] & sets[b]) / len(sets[b - 1] | sets[b]) for b in range(1, 80, 2)}
    linked = {b for b, j in share.items() if j >= 0.8}
    assert len(linked) == 20 and all(0.8 <= share[b] < 0.85 for b in linked)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    assert {i for i, _ in rows} - {r["doc_id"] for r in cp.drop_near_copies(spark, docs, path).collect()} == linked


def test_null_and_repeated_ids_are_rows_of_their_own(spark, tables):
    path, _ = tables
    leak = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    text = lambda i: " ".join(f"word{i}x{k}" for k in range(12))
    rows = [(7, text(1)), (7, text(2)), (7, text(3)), (7, text(1)), (None, text(4)), (None, text(5)), (None, text(4)), (None, text(2)), (None, leak), (7, f"so {leak}"), (8, None), (8, None), (None, ""), (None, " ")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)
    got = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    near = cp.drop_near_copies(spark, docs, path)
    assert near.columns == COLUMNS
    assert got(near) == sorted([(7, text(1)), (7, text(2)), (7, text(3)), (None, text(4)), (None, text(5)), (7, f"so {leak}"), (8, None), (8, None), (None, ""), (None, " ")], key=str)
    clean = cp.drop_contaminated(spark, docs, path)
    assert clean.columns == COLUMNS and got(clean) == sorted([(i, t) for i, t in rows if leak not in (t or "")], key=str)


def test_columns_of_any_name_stay(spark, tables):
    """Names that the stages use inside, and one that needs quoting, as columns of documents."""
    path, rows = tables
    more = ["y", "i", "hit_id", "toxicity_score", "row_key", "row", "digest", "component_id", "kept", "a.b", "doc", "key"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), *range(len(more))) for i, t in rows], SCHEMA + "".join(f", `{m}` int" for m in more))
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, path)
        plain = stage(spark, read(spark, path), path)
        assert out.columns == docs.columns, name
        got = out.collect()
        assert all(tuple(r)[5:] == tuple(range(len(more))) for r in got), name
        assert sorted(str(tuple(r)[:5]) for r in got) == sorted(str(tuple(r)) for r in plain.collect()), name
    assert sum(r["length"] for r in cp.pack(spark, docs, path).collect()) == sum(r["length"] for r in cp.pack(spark, read(spark, path), path).collect())


def test_a_contaminated_row_without_id_takes_no_other_along(spark, tables):
    path, _ = tables
    leak = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    rows = [(None, leak), *[(None, f"harmless {i} words") for i in range(5)], (4, leak), (4, "harmless under the same id")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    assert sorted(r["text"] for r in cp.drop_contaminated(spark, docs, path).collect()) == sorted(t for _, t in rows if t != leak)


def test_contaminated_documents_go(spark, tables):
    path, rows = tables
    out = cp.drop_contaminated(spark, read(spark, path), path)
    assert out.columns == COLUMNS and {i for i, _ in rows} - {r["doc_id"] for r in out.collect()} == {202} and out.count() == len(rows) - 1


def test_secrets_are_replaced_and_documents_stay(spark, tables):
    path, rows = tables
    out = cp.redact_secrets(spark, read(spark, path), path)
    got = {r["doc_id"]: r for r in out.collect()}
    assert out.columns == COLUMNS and len(got) == len(rows)
    for i, t in rows:
        want = t
        for s, _, e in reversed(base_spans(t or "")):
            want = want[:s] + "[SECRET]" + want[e:]
        assert got[i]["text"] == want
        assert got[i]["n_chars"] == (None if t is None else len(want))
    assert got[203]["text"] == "[SECRET] is in the middle of it"


def test_all_that_is_left_is_packed(spark, tables):
    path, rows = tables
    pieces = cp.pack(spark, read(spark, path), path).collect()
    e, end = encoder_of(default_tokenizer()), b"\x01\0\0\0"
    ids = {i: e.encode(t) + end for i, t in rows}
    assert sum(p["length"] for p in pieces) == sum(len(x) // 4 for x in ids.values())
    for p in pieces:
        raw = ids[p["doc_id"]]
        assert p["ids_crc32"] == zlib.crc32(raw[4 * p["start"] : 4 * (p["start"] + p["length"])]) and p["doc_tokens"] * 4 == len(raw)


def test_the_whole_run_equals_its_stages(spark, tables):
    path, rows = tables
    out = {r["doc_id"] for r in cp.run(spark, path).collect()}
    assert out == {i for i, _ in rows} - {*range(60, 100), 206, 200, 201, 202}


def test_empty_tables_pass_through(spark, tables):
    path, _ = tables
    docs = read(spark, path).limit(0)
    for name, stage in cp.STAGES:
        assert stage(spark, docs, path).count() == 0, name


def test_entries_are_registered():
    import __spark_entry__ as e

    names = e.queries()
    assert "pipeline" in names and [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
    assert set(e.oracle_sql()) <= set(names)
