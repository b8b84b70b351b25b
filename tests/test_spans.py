"""Spans and strategies on single texts: tiling, budgets, hygiene, overlap, rules."""

from __future__ import annotations

import time

import pytest

from spanloom.charsets import CLOSERS, OPENERS, SENTENCE_CLOSERS, SENTENCE_END, SNAP_CLOSERS, WS
from spanloom.functions.counters import chars_for_tokens, count_chars, get_counter
from spanloom.operators import spans as sp
from spanloom.operators.strategies import Families, splitter

GRID = [("recursive", 89, 17), ("recursive", 60, 15), ("sentence", 110, 20), ("token", 97, 15), ("semantic", 120, 0), ("markdown", 131, 17)]


def tiles_by_hand(text):
    """One pass over the characters."""
    out, start, i = [], 0, 0
    while i < len(text):
        if text[i] == "\n":
            if i > start:
                out.append((start, i))
            out.append((i, i + 1))
            start = i = i + 1
        elif text[i] in SENTENCE_END:
            i += 1
            while i < len(text) and text[i] in SENTENCE_CLOSERS:
                i += 1
            out.append((start, i))
            start = i
        else:
            i += 1
    if start < len(text):
        out.append((start, len(text)))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_sentences_tile_the_text(random_text, seed):
    text = random_text(seed)
    assert sp.sentence_spans(text) == tiles_by_hand(text)


@pytest.mark.parametrize("text,first", [("你好。再见。", "你好。"), ("他说：「走！」然后", "他说：「走！」"), ("版本3.14.1发布", "版本3.14.1发布"), ("真的？！", "真的？"), ("半．全", "半．")])
def test_sentence_ends(text, first):
    s, e = sp.sentence_spans(text)[0]
    assert text[s:e] == first


@pytest.mark.parametrize("seed", range(8))
@pytest.mark.parametrize("strategy,most,overlap", GRID)
def test_chunks_cover_the_text_in_order(random_text, seed, strategy, most, overlap):
    text = random_text(seed)
    pieces = splitter(strategy, max_chars=most, overlap_chars=overlap, **({"min_chars": 20} if strategy == "semantic" else {}))(text)
    at = 0
    for i, p in enumerate(pieces):
        assert p.end > p.start
        n = p.meta["overlap_chars"]
        assert p.start + n == at and n >= 0
        if i:
            assert p.start > pieces[i - 1].start
        at = p.end
    assert at == len(text)


@pytest.mark.parametrize("seed", range(8))
@pytest.mark.parametrize("most,overlap", [(73, 11), (131, 17), (200, 50)])
def test_budget_is_kept_but_for_closers_taken_in(random_text, seed, most, overlap):
    for p in splitter("recursive", max_chars=most, overlap_chars=overlap)(random_text(seed)):
        assert p.end - p.start <= most + 2


@pytest.mark.parametrize("seed", range(8))
def test_no_chunk_ends_on_an_opener(random_text, seed):
    text = random_text(seed)
    pieces = splitter("recursive", max_chars=60, overlap_chars=0)(text)
    for p in pieces[:-1]:
        body = text[p.start : p.end].rstrip(WS)
        assert len(body) < 2 or body[-1] not in OPENERS


def test_opener_goes_right_and_closer_left():
    text = "甲乙丙「丁戊」己"
    assert [text[s:e] for s, e in sp.clean_boundaries(text, [(0, 4), (4, 8)])] == ["甲乙丙", "「丁戊」己"]
    assert [text[s:e] for s, e in sp.clean_boundaries(text, [(0, 6), (6, 8)])] == ["甲乙丙「丁戊」", "己"]


def test_a_left_span_of_an_opener_alone_is_not_emptied():
    text = "「　甲乙"
    assert all(e > s for s, e in sp.clean_boundaries(text, [(0, 2), (2, 4)]))


@pytest.mark.parametrize("seed", range(6))
def test_overlap_starts_on_a_sentence_where_one_begins_inside(random_text, seed):
    text = random_text(seed)
    for p in splitter("recursive", max_chars=120, overlap_chars=30)(text)[1:]:
        own = p.start + p.meta["overlap_chars"]
        inner = [k for k in range(max(0, own - 30) + 1, own) if text[:k].rstrip(SNAP_CLOSERS)[-1:] and text[:k].rstrip(SNAP_CLOSERS)[-1] in SENTENCE_END]
        if inner and p.meta["overlap_chars"] and p.end - inner[-1] <= 120:
            assert p.start >= inner[-1]


def test_degenerate_texts():
    for strategy in ("recursive", "sentence", "token", "markdown", "semantic", "parent-child"):
        assert splitter(strategy)("") == [] if strategy != "semantic" else True
        assert len(splitter(strategy)("短文本。")) == 1
    text = "\n\n\n"
    assert splitter("recursive")(text)[-1].end == 3
    ones = splitter("recursive", max_chars=1, overlap_chars=0)("一二三四五")
    assert [(p.start, p.end) for p in ones] == [(i, i + 1) for i in range(5)]


def test_whole_text_offsets_count_code_points():
    text = "a😀b。" * 40
    for p in splitter("recursive", max_chars=30, overlap_chars=0)(text):
        assert len(text[p.start : p.end]) == p.end - p.start


@pytest.mark.parametrize("params", [{"max_chars": 0}, {"max_chars": 10, "overlap_chars": 10}, {"max_chars": 10, "overlap_chars": -1}])
def test_sizes_are_checked(params):
    with pytest.raises(ValueError, match=r"max_chars|overlap_chars"):
        splitter("recursive", **params)


def test_unknown_names_list_the_known():
    with pytest.raises(ValueError, match="recursive.*sentence"):
        splitter("nonsense")
    with pytest.raises(ValueError, match="char.*tiktoken"):
        get_counter("nonsense")


def test_markdown_sections_and_fences():
    text = "前言\n# 一\n甲\n## 二\n```\n# 不是标题\n```\n乙\n# 三 ##\n丙"
    found = sp.sections(text)
    assert [path for path, _, _ in found] == [(), ("一",), ("一", "二"), ("三",)]
    assert "".join(text[s:e] for _, s, e in found) == text
    assert [p for p, _, _ in sp.sections("~~~\n# a\n")] == [()]


def test_markdown_rules_and_headings():
    text = "# 一\n" + "甲乙丙丁。" * 20 + "\n# 二\n戊。"
    pieces = splitter("markdown", max_chars=60, overlap_chars=10, explain=True)(text)
    assert pieces[0].meta["headings"] == ["一"] and pieces[-1].meta["headings"] == ["二"]
    cut = text.index("# 二")
    assert [p.meta["end_rule"] for p in pieces if p.end == cut] == ["heading"]
    assert pieces[-1].meta["end_rule"] == "text_end"


@pytest.mark.parametrize("text,end,rule", [
    ("甲。乙", 2, "sentence"), ("甲\n\n乙", 3, "paragraph"), ("甲。\n乙", 3, "paragraph"), ("甲\n乙", 2, "newline"), ("甲，乙", 2, "clause"), ("甲乙", 1, "budget"),
    ("甲乙", 2, "text_end"), ("甲乙", 0, "start"), ("甲。　　乙", 4, "sentence"), ("甲\r\n乙", 3, "paragraph"), ("甲．乙", 2, "budget"),
])
def test_end_rules(text, end, rule):
    assert sp.end_rule(text, end) == rule


@pytest.mark.parametrize("seed", range(4))
def test_rules_chain(random_text, seed):
    pieces = splitter("recursive", max_chars=97, overlap_chars=13, explain=True)(random_text(seed))
    assert pieces[0].meta["start_rule"] == "text_start" and pieces[-1].meta["end_rule"] == "text_end"
    for a, b in zip(pieces, pieces[1:], strict=False):
        assert b.meta["start_rule"] == a.meta["end_rule"]


def test_semantic_cuts_where_topics_change():
    topic = lambda texts: [[float("猫" in t), float("狗" in t), float("云" in t)] for t in texts]
    text = "猫在睡觉。猫醒了。狗在叫。狗跑了。云很白。"
    pieces = splitter("semantic", embed_fn=topic, min_chars=1, max_chars=100)(text)
    assert [text[p.start : p.end] for p in pieces] == ["猫在睡觉。猫醒了。", "狗在叫。狗跑了。", "云很白。"]
    assert [p.meta["end_rule"] for p in pieces] == ["semantic_drop", "semantic_drop", "text_end"]
    with pytest.raises(ValueError, match="vectors"):
        splitter("semantic", embed_fn=lambda texts: [])(text)


def test_families_link_both_ways(random_text):
    text = random_text(3, 4000)
    parents, children = Families(400, 100, 10).split(text)
    assert [c for p in parents for c in p.meta["child_seqs"]] == list(range(len(children)))
    for n, p in enumerate(parents):
        own = [children[c] for c in p.meta["child_seqs"]]
        assert all(c.meta["parent_seq"] == n and p.start <= c.start and c.end <= p.end for c in own)
        assert own[0].start == p.start and own[-1].end == p.end
    for bad in ({"parent_max": 100, "child_max": 100}, {"parent_max": 100, "child_max": 200}, {"child_overlap": 150}):
        with pytest.raises(ValueError, match="child"):
            Families(**bad)


def test_counters():
    assert count_chars("春夏秋冬") == 4 and count_chars("") == 0 and count_chars("你好 hello！") == 7
    assert count_chars("abcdefghij") < 6
    assert get_counter("CHAR") is count_chars
    assert chars_for_tokens("", 5, count_chars) == 0 and chars_for_tokens("春夏秋冬", 2, count_chars) == 2
    assert chars_for_tokens("abc", 2, lambda t: 0) == 3


def test_token_budget_holds_for_summed_counts(random_text):
    text = random_text(11)
    for s, e in sp.packed(sp.token_atoms(text, count_chars, 50), 50):
        assert sum(count_chars(text[a + s : b + s]) for a, b in sp.sentence_spans(text[s:e])) <= 60


def test_closers_do_not_start_a_chunk_when_moving_is_allowed(random_text):
    text = "甲乙丙，丁戊己。" * 30
    for p in splitter("recursive", max_chars=11, overlap_chars=0)(text)[1:]:
        assert text[p.start] not in CLOSERS


def test_time_grows_in_proportion():
    """Four times the text in well under the square of the time; hostile headings do not blow up."""
    split = splitter("recursive", max_chars=400, overlap_chars=50)
    unit = "甲乙丙丁，戊己庚辛。\n" * 2000

    def took(text):
        t = time.perf_counter()
        split(text)
        return time.perf_counter() - t

    took(unit)
    small, large = min(took(unit) for _ in range(3)), took(unit * 4)
    assert large < 10 * small + 0.2
    t = time.perf_counter()
    sp.sections("#" * 100_000 + "\n" + "# " + "#" * 100_000 + "x\n")
    assert time.perf_counter() - t < 1
