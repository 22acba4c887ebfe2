import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm.byte_bpe import DEFAULT_RANKS, Encoder, merge_many, merge_one
from ledgerloom.llm.packing import best_fit_decreasing, lower_bound
from ledgerloom.llm.stuffing import Languages, measure
from ledgerloom.llm.topn import merge_runs

OWN = Encoder(DEFAULT_RANKS) if os.path.exists(DEFAULT_RANKS) else None


@pytest.mark.skipif(OWN is None, reason="no vocabulary here")
@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=70), min_size=1, max_size=60))
def test_trees_side_by_side_and_one_by_one(words):
    got = merge_many(words, OWN.table)
    assert got == [merge_one(w, OWN.table) for w in words]
    by_id = {v: k for k, v in OWN.table.ranks.items()}
    assert [b"".join(by_id[i] for i in ids) for ids in got] == words


@pytest.mark.skipif(OWN is None, reason="no vocabulary here")
@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=80)), max_size=8))
def test_ids_give_the_text_back(texts):
    ids, counts = OWN.encode(texts)
    by_id = {v: k for k, v in OWN.table.ranks.items()}
    at = 0
    for t, n in zip(texts, counts.tolist()):
        assert b"".join(by_id[i] for i in ids[at : at + n].tolist()).decode() == (t or "")
        at += n
    assert OWN.count(texts).tolist() == counts.tolist()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=80))
def test_packing_holds(sizes):
    sizes = np.array(sizes)
    box = best_fit_decreasing(sizes, 50)
    used = np.bincount(box, weights=sizes)
    assert used.max() <= 50 and lower_bound(sizes, 50) <= len(used)
    assert set(box.tolist()) == set(range(len(used)))


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=400))
def test_shares_are_shares(text):
    page, chunks = measure(text * 3, Languages({}))
    assert all(0.0 <= x <= 1.0 for x in page[2:9])
    assert all(0.0 <= x <= 1.0 for c in chunks for x in c[3:9]) and all(c[1] > 0 for c in chunks)


ROW = st.tuples(st.sampled_from("abc"), st.sampled_from([0.0, 0.5, 1.0]), st.sampled_from("pqrs"))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(ROW, max_size=12), max_size=5), st.integers(1, 3))
def test_merged_runs_are_the_sorted_whole(runs, n):
    order = lambda rows: sorted(rows, key=lambda r: (r[0], -r[1], r[2]))
    blocks = [[tuple(map(list, zip(*order(r)[i : i + 4]))) for i in range(0, len(r), 4)] for r in runs]
    want, seen = [], {}
    for g, s, i in order([r for run in runs for r in run]):
        taken = seen.setdefault(g, [])
        if len(taken) < n and i not in taken:
            taken.append(i)
            want.append((g, len(taken), s, i))
    assert list(merge_runs(blocks, n)) == want
