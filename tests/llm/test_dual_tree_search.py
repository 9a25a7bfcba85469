"""The dual-tree search against scoring every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from varve.llm import dual_tree_search as dts
from varve.llm.dual_tree_search import Rows, TopK, added, count_terms, dual_tree_top_k, halved_order, item_branches, search_shard, term_lists, term_weights

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOC_KIND = "doc_id long, text string, n string, terms string, item string, score string, rank string"
ITEM_KIND = "item_id long, text string, doc_id string, size string, block string"


def terms_of(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def by_hand(docs, items, k):
    counted = [(i, Counter(terms_of(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n_docs, n_terms = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        scores = []
        for doc, c in counted:
            m = 25 + (75 * sum(c.values()) * n_docs) // n_terms
            s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, q in Counter(terms_of(text)).items() if c[t])
            if s > 0:
                scores.append((-s, doc is None, doc or 0, doc))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scores, key=lambda x: x[:3])[:k])]
    return sorted(out, key=repr)


def made(seed, n, words, most):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)]
    return [(i, " ".join(vocabulary[min(int(rng.expovariate(6 / words)), words - 1)] for _ in range(rng.randrange(most)))) for i in range(n)]


def answer(spark, docs, items, **options):
    frame = spark.createDataFrame([(*d, *["x"] * 5) for d in docs], DOC_KIND).repartition(3)
    asked = spark.createDataFrame([(*i, *["x"] * 3) for i in items], ITEM_KIND)
    return sorted((tuple(r) for r in dual_tree_top_k(frame, asked, **options).collect()), key=repr)


@pytest.mark.parametrize("sizes", [(16, 8, 8192, 256), (2, 2, 40, 5), (1, 3, 7, 2)])
def test_matches_scoring_everything(spark, sizes, monkeypatch):
    """Also with trees of many levels, many shards a task, and branches of few items (tasks read the sizes from the module's copy in the driver's closure)."""
    leaf, fan, shard, branch = sizes
    for name, value in zip(("LEAF", "FAN", "SHARD", "BRANCH"), (leaf, fan, shard, branch)):
        monkeypatch.setattr(dts, name, value)
    docs, items = made(1, 300, 90, 60), made(2, 25, 90, 14)
    # The search itself, in this process and so with the sizes above, one shard after the other.
    texts, asked = pa.array([t for _, t in docs]), pa.array([t for _, t in items])
    vocabulary = pa.array(sorted({t for _, text in items for t in terms_of(text)}), pa.large_string())
    n, row, term, tf = count_terms(texts, vocabulary)
    n_docs, n_terms, df = int((n > 0).sum()), int(n.sum()), np.bincount(term, minlength=len(vocabulary))
    _, item, qterm, qtf = count_terms(asked, vocabulary)
    worth = term_weights(df, n_docs)[qterm] * qtf
    weights = Rows(np.searchsorted(item, np.arange(len(items) + 1)), qterm, worth)
    values = Rows(np.searchsorted(row, np.arange(len(docs) + 1)), term, added(tf, n[row], n_docs, n_terms))
    best, scored = TopK(len(items), 4), 0
    for at in range(0, len(docs), shard):
        mine = np.arange(at, min(at + shard, len(docs)))
        scored += search_shard(item_branches(weights, len(vocabulary)), values.take(mine), mine, np.zeros(len(mine), bool), len(vocabulary), best)
    i, r = np.nonzero(best.score)
    assert sorted(zip(i.tolist(), (r + 1).tolist(), best.id[i, r].tolist(), best.score[i, r].tolist()), key=repr) == by_hand(docs, items, 4)
    assert scored <= len(items) * len(docs)
    assert answer(spark, docs, items, k=4) == by_hand(docs, items, 4)


def test_odd_rows_ties_and_blocks(spark):
    rng = random.Random(3)
    long = " ".join(f"t{rng.randrange(50)}" for _ in range(500_000)) + " needle " + "y" * 1_500_000
    docs = [(1, "a b"), (2, "A, B!"), (2, "A, B!"), (None, "a b"), (None, "a b"), (None, None), (3, None), (4, ""), (5, " %%\n"), (6, long), (7, "é a_b É"), (-9, "a b"), (8, "needle")]
    items = [(1, "b"), (1, "b"), (1, "a"), (2, None), (3, ""), (4, "unknown"), (None, "needle t1"), (5, "é É x" + "y" * 1_500_000), (6, "a a b b b"), (7, "y" * 1_500_000)]
    for options in ({"k": 3}, {"k": 10}, {"k": 3, "block_bytes": 1 << 20}):
        assert answer(spark, docs, items, **options) == by_hand(docs, [i for i in items if i[1] is not None], options["k"])


def test_empty_tables(spark):
    assert answer(spark, [], [(1, "a")]) == [] == answer(spark, [(1, "a")], []) == answer(spark, [(1, None), (2, "")], [(1, "a")]) == answer(spark, [(1, "a")], [(1, "b"), (2, "-")])


def test_terms_in_parts(monkeypatch):
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab9é -\x00ÄZ") for _ in range(rng.randrange(90))) for _ in range(60)] + [None, "", "-", "x" * 300]
    want = [(i, t) for i, text in enumerate(texts) for t in terms_of(text)]
    for piece in (1 << 20, 64, 5, 1):
        monkeypatch.setattr(dts, "PIECE", piece)
        got = [(r, t) for rows, terms in term_lists(pa.array(["zero", *texts])[1:]) for r, t in zip(rows.tolist(), terms.to_pylist())]
        assert got == want, piece


def test_bounds_prune_whole_batches():
    """Items about one topic each: most pairs are never scored."""
    rng = np.random.default_rng(5)
    topic = rng.integers(0, 40, 4000)
    rows = [np.unique(np.concatenate([t * 20 + rng.integers(0, 20, 12), rng.integers(800, 900, 5)])) for t in topic]
    docs = Rows(np.concatenate([[0], np.cumsum([len(r) for r in rows])]), np.concatenate(rows), rng.integers(1, 1000, sum(len(r) for r in rows)))
    asked = [np.unique(t * 20 + rng.integers(0, 20, 8)) for t in range(40)]
    weights = Rows(np.concatenate([[0], np.cumsum([len(r) for r in asked])]), np.concatenate(asked), rng.integers(1, 9000, sum(len(r) for r in asked)))
    best = TopK(40, 10)
    scored = search_shard(item_branches(weights, 900), docs, np.arange(4000), np.zeros(4000, bool), 900, best)
    every = weights.dense(900, np.int64) @ docs.dense(900, np.int64).T
    assert (best.score == -np.sort(-every, axis=1)[:, :10]).all()
    assert scored < 0.15 * 40 * 4000


def test_large_numbers_stay_exact():
    """Sums beyond 2**53 are computed in 64-bit integers; the length norm beyond 2**63 in Python's."""
    weights = Rows(np.array([0, 2]), np.array([0, 1]), np.array([9_000_000_000_001, 3]))
    assert item_branches(weights, 2)[0].weights.dtype == np.int64
    best = TopK(1, 2)
    docs = Rows(np.array([0, 1, 3]), np.array([0, 0, 1]), np.array([999_999, 999_999, 1]))
    search_shard(item_branches(weights, 2), docs, np.array([5, 6]), np.zeros(2, bool), 2, best)
    assert best.score.tolist() == [[9_000_000_000_001 * 999_999 + 3, 9_000_000_000_001 * 999_999]] and best.id.tolist() == [[6, 5]]
    n, n_docs, n_terms = 10**9, 10**12, 10**15
    assert added(np.array([7]), np.array([n]), n_docs, n_terms).tolist() == [10**9 * 7 // (7000 + 8 * (25 + 75 * n * n_docs // n_terms))]


def test_order_keeps_every_row():
    rng = np.random.default_rng(6)
    first = np.concatenate([[0], np.cumsum(rng.integers(0, 6, 77))])
    rows = Rows(first, rng.integers(0, 30, first[-1]), rng.integers(1, 9, first[-1]))
    for leaf in (1, 2, 16, 100):
        assert sorted(halved_order(rows, 30, leaf).tolist()) == list(range(77))
    assert len(halved_order(Rows(np.array([0]), first[:0], first[:0]), 30, 4)) == 0
