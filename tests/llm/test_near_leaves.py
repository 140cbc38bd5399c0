"""Leaves of near_dedup against brute force, and what they cost."""

import numpy as np
import pytest

from stateweave.llm import near_dedup


def family(r, members, tokens):
    """Edited copies of one set: most pairs are 0.6 to 0.85 alike, so that few are linked."""
    base = r.integers(0, 2**63, tokens).astype(np.uint64)
    return [np.unique(np.concatenate([base[r.random(tokens) < r.uniform(0.8, 0.97)], r.integers(0, 2**63, r.integers(1, tokens // 8)).astype(np.uint64)])) for _ in range(members)]


def groups_by_hand(ids, parts, sets, percent):
    """The least id of each member's group over all pairs; members of one part are a group already."""
    group = np.unique(parts, return_inverse=True)[1]
    for i in range(len(ids)):
        for j in range(i):
            if group[i] != group[j] and near_dedup.similar(sets[i], sets[j], percent):
                group[group == group[j]] = group[i]
    return {int(i): int(ids[group == g].min()) for i, g in zip(ids, group, strict=True)}


@pytest.mark.parametrize("common", [1, 16, 10**9])
def test_leaf_links_are_those_of_all_pairs(monkeypatch, common):
    """Whether hashes are bits, looked up, or both; sets of under and over 400 hashes."""
    monkeypatch.setattr(near_dedup, "COMMON", common)
    r = np.random.default_rng(4)
    sets = [*family(r, 40, 60), *family(r, 30, 600), *family(r, 20, 24), np.array([7], np.uint64), np.array([7, 9], np.uint64)]
    sets = [sets[k] for k in r.permutation(len(sets))]
    ids = r.permutation(500)[: len(sets)]
    parts = np.where(r.random(len(ids)) < 0.2, ids[r.integers(0, len(ids), len(ids))], ids)
    for percent in (80, 85):
        want = {i: least for i, least in groups_by_hand(ids, parts, sets, percent).items() if i != least}
        assert dict(near_dedup.link_leaf(ids, parts, sets, percent)) == want and len(want) > 20


def test_edited_copies_are_not_compared_pair_by_pair(monkeypatch):
    """1,700 short copies of one text took a task 20 seconds, a call for each of half a million pairs."""
    sets = family(np.random.default_rng(5), 400, 60)
    ids, calls, similar = np.arange(len(sets)), [], near_dedup.similar
    want = groups_by_hand(ids, ids, sets, 85)
    monkeypatch.setattr(near_dedup, "similar", lambda *a: calls.append(1) or similar(*a))
    assert dict(near_dedup.link_leaf(ids, ids, sets, 85)) == {i: least for i, least in want.items() if i != least}
    assert len(calls) <= 10 * len(sets)
