"""Conversation trie, vector codes and neighbour search against plain loops."""

import hashlib
import math
import zlib
from collections import defaultdict

import numpy as np
import pytest

from foliant.llm import ball_codes, nn_descent, prefix_trie

TURNS = "conv_id bigint, turn bigint, role string, text string, key string, v int"


def trie_truth(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest(), (role or "", text or "")))
    own = {c: [t[-1] for t in sorted(x)] for c, x in own.items()}
    members = defaultdict(list)
    ends = defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:])
        for d in range(len(whole) + 1):
            members[whole[:d]].append(c)
        ends[whole].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out = []
    for node, who in members.items():
        leaves = saved = 0
        stack = [node]
        while stack:
            n = stack.pop()
            leaves += not children[n]
            saved += (len(members[n]) - 1) * (len(n[-1][1]) if n else 0)
            stack += children[n]
        digest = hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()
        out.append((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), len(children[node]), leaves, saved, digest))
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_trie_against_plain_loops(spark, monkeypatch, small):
    if small:  # running sums over several chunks, tours over many blocks and rounds of pointer jumping
        monkeypatch.setattr(prefix_trie, "CHUNK", 7)
        monkeypatch.setattr(prefix_trie, "NODE_BLOCK", 5)
    rng = np.random.default_rng(3)
    rows = []
    for c in [*range(0, 40), *range(100, 130), *range(205, 215), -3, -150, -100, 10**12, 10**12 + 7]:
        for t in range(int(rng.integers(1, 9))):
            rows.append((c, t, ["user", "bot", None][int(rng.integers(3))], ["hi", "", None, "déjà \U0001f600", "x" * 50][int(rng.integers(5))]))
    rows += [(300, t, "user", f"turn {t % 3}") for t in range(60)]  # one long conversation
    rows += [(301, None, "a", "b"), (301, 2, "a", "c"), (301, 2, "a", "c"), (301, 2, "b", "c"), (None, 1, "a", "b"), (302, 0, "user", "y" * 200_000)]
    frame = spark.createDataFrame([(*r, "k", 1) for r in rows], TURNS).repartition(5)
    got = sorted(tuple(r) for r in prefix_trie.conversation_trie(frame).collect())
    assert got == trie_truth(rows)


def test_trie_without_conversations(spark):
    assert prefix_trie.conversation_trie(spark.createDataFrame([], TURNS)).count() == 0
    assert prefix_trie.conversation_trie(spark.createDataFrame([(None, 1, "a", "b", "k", 1)], TURNS)).count() == 0


def test_list_ranks_of_a_long_list(spark):
    order = np.random.default_rng(1).permutation(300)
    rows = [(int(a), int(b), 2) for a, b in zip(order, order[1:])] + [(int(order[-1]), None, 5)]
    got = {r["head"]: r["rest"] for r in prefix_trie.list_ranks(spark.createDataFrame(rows, "head bigint, out bigint, length bigint")).collect()}
    assert got == {int(h): 5 + 2 * (299 - k) for k, h in enumerate(order)}


def codes_truth(rows, parts=4, entries=256, rounds=4):
    kept = [(i, label, [math.floor(1024 * x) for x in v]) for i, v, label in rows if v is not None and None not in v and np.isfinite(v).all()]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    if not kept:
        return []
    wide = len(kept[0][2]) // parts
    cut = [[r[2][k * wide : (k + 1) * wide] for k in range(parts)] for r in kept]
    books = [[list(c[k]) for c in cut[:entries]] for k in range(parts)]
    for turn in range(rounds + 1):
        codes = [[min((sum((a - b) ** 2 for a, b in zip(c[k], e)), n) for n, e in enumerate(books[k])) for k in range(parts)] for c in cut]
        if turn < rounds:
            for k in range(parts):
                for n in range(len(books[k])):
                    own = [c[k] for c, code in zip(cut, codes) if code[k][1] == n]
                    if own:
                        books[k][n] = [sum(x) // len(own) for x in zip(*own)]
    errors = [sum(d for d, _ in code) for code in codes]
    by_label = defaultdict(int)
    for (_, label, _), e in zip(kept, errors):
        by_label[label] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(
        ((i, "".join(f"{n:02x}" for _, n in code), e, by_label[label], digest) for (i, label, _), code, e in zip(kept, codes, errors)),
        key=lambda r: (r[0] is None, r[0] or 0, r[1]),
    )


def coded(frame):
    rows = ball_codes.compress(frame).collect()
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def test_codes_against_plain_k_means(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(9, 12))
    rows = [(int(i), [float(x) for x in centres[i % 9] + rng.normal(size=12) * 0.2], [None, 1, 2][i % 3]) for i in rng.permutation(600)]
    rows += [(k, rows[0][1], 1) for k in range(1000, 1040)]  # copies
    rows += [(k, [float(x) for x in rng.integers(-1, 2, 12)], 2) for k in range(2000, 2060)]  # many ties
    rows += [(3000, None, 1), (3001, [None] + [0.0] * 11, 1), (3002, [math.nan] * 12, 1), (3003, [math.inf] + [0.0] * 11, 2), (3004, [0.0] * 12, None), (None, [0.5] * 12, 1)]
    frame = spark.createDataFrame([(*r, "c", 7) for r in rows], "vec_id bigint, embedding array<double>, label int, codes string, part int").repartition(4)
    assert coded(frame) == codes_truth(rows)


def test_few_and_no_vectors(spark):
    schema = "vec_id bigint, embedding array<float>, label int"
    few = [(2, [1.0, 2.0, 3.0, 4.0], 1), (1, [1.0, 2.0, 3.0, 4.0], None), (5, [-1.0, 0.0, 0.25, 0.0], 1)]
    assert coded(spark.createDataFrame(few, schema)) == codes_truth(few)
    assert coded(spark.createDataFrame([], schema)) == [] == coded(spark.createDataFrame([(1, None, 1)], schema))
    with pytest.raises(ValueError):
        ball_codes.compress(spark.createDataFrame([(1, [1.0, 2.0], 1)], schema))


def test_rings_lose_no_entry():
    rng = np.random.default_rng(2)
    for spread in (1, 3, 40, 1 << 26):
        x, centres = rng.integers(-spread, spread + 1, (700, 5)), rng.integers(-spread, spread + 1, (60, 5))
        want = nearest = [min((int(((p.astype(object) - c) ** 2).sum()), n) for n, c in enumerate(centres.astype(object))) for p in x]
        for home in (np.array([n for _, n in nearest]), rng.integers(0, 60, 700)):
            best, least = ball_codes.reassigned(x, centres, home)
            assert list(zip(least.tolist(), best.tolist())) == want
        best, least = ball_codes.nearest(x, centres)
        assert list(zip(least.tolist(), best.tolist())) == want


def search_truth(rows, queries, top=5):
    good = {}
    for i, v in sorted((r for r in rows if r[0] is not None and r[1] is not None and None not in r[1]), key=lambda r: r[0]):
        x = np.array(v, float)
        if np.isfinite(x).all() and x.any():
            good[i] = x
    out = {}
    for q in queries:
        if q in good:
            a = good[q]
            near = sorted((-float(a @ b) / (math.sqrt(a @ a) * math.sqrt(b @ b)), i) for i, b in good.items() if i != q and len(a) == len(b))
            out[q] = [(i, -s) for s, i in near[:top]]
    return out


def found(frame, graph=None, **kw):
    out = defaultdict(list)
    for r in sorted(nn_descent.greedy_search(graph or nn_descent.build_graph(frame), frame.where("vec_id % 50 = 0"), **kw).collect(), key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(out[r["query_id"]]) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


def recall(got, want):
    assert {q for q, near in want.items() if near} == set(got)
    assert all(len(got[q]) == len(near) for q, near in want.items())
    return sum(len({i for i, _ in got[q]} & {i for i, _ in near}) for q, near in want.items()) / max(1, sum(map(len, want.values())))


def test_search_recall_and_copies(spark):
    rng = np.random.default_rng(8)
    rows = [(k, [float(np.float32(x)) for x in rng.normal(size=24)]) for k in range(2500)]
    rows += [(k, rows[100][1]) for k in range(2500, 3100)]  # one vector has many copies
    rows += [(4000, None), (4050, [0.0] * 24), (4100, [None] * 24), (4150, [math.nan] * 24), (None, rows[0][1]), (4200, [1.0, 2.0]), (4201, [2.0, 4.0])]
    frame = spark.createDataFrame([(*r, "n", 1) for r in rows], "vec_id bigint, embedding array<float>, node string, block int").repartition(6)
    want = search_truth(rows, range(0, 5000, 50))
    got = found(frame)
    assert recall(got, want) >= 0.95
    assert [i for i, _ in got[100]] == [2500, 2501, 2502, 2503, 2504] and [i for i, _ in got[2500]][:3] == [100, 2501, 2502]
    exact = {(q, i): s for q, near in search_truth(rows, got, top=4000).items() for i, s in near}
    assert all(abs(exact[q, i] - s) < 1e-12 for q, near in got.items() for i, s in near)
    assert got[4200] == [(4201, pytest.approx(1.0))]


def test_search_recall_of_vectors_that_are_all_near(spark):
    """Cosines that differ behind the third digit: one direction with little noise, and groups as large as many lists."""
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(2, 24))
    for x in (centres[:1] + 0.05 * rng.normal(size=(1500, 24)), centres[np.arange(1500) % 2] + 0.001 * rng.normal(size=(1500, 24))):
        rows = [(k, [float(np.float32(c)) for c in v]) for k, v in enumerate(x)]
        frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(4)
        assert recall(found(frame), search_truth(rows, range(0, 1500, 50))) >= 0.95


def test_search_of_vectors_outside_the_index(spark):
    rng = np.random.default_rng(6)
    rows = [(k, [float(np.float32(x)) for x in rng.normal(size=8)]) for k in range(1, 900) if k % 50]
    asked = [(k, [float(np.float32(x)) for x in rng.normal(size=8)]) for k in range(0, 900, 50)]
    schema = "vec_id bigint, embedding array<float>"
    got = found(spark.createDataFrame(asked, schema), nn_descent.build_graph(spark.createDataFrame(rows, schema)))
    want = {q: near for q, near in search_truth(rows + asked, [q for q, _ in asked], top=900).items()}
    want = {q: [(i, s) for i, s in near if i % 50][:5] for q, near in want.items()}
    assert recall(got, want) >= 0.9


def test_search_of_few_and_no_vectors(spark):
    schema = "vec_id bigint, embedding array<float>"
    few = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [-1.0, 0.0]), (50, [0.0, 1.0])]
    got, want = found(spark.createDataFrame(few, schema)), search_truth(few, [0, 50])
    assert {q: [i for i, _ in near] for q, near in got.items()} == {q: [i for i, _ in near] for q, near in want.items()}
    assert found(spark.createDataFrame([], schema)) == {} == found(spark.createDataFrame([(0, [1.0])], schema))
