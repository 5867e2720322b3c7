"""Deduplication operators against brute force over all pairs."""

import itertools
import re

import numpy as np
import pytest
import xxhash

from foliant.llm import embeddings, lines, ngram_join
from foliant.llm.components import components

SF = "/root/testdata/sf0.001"


def union(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text, k=5):
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", text.encode().lower()) if w]
    if not words:
        return set()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


def jaccard_truth(rows):
    sets = {i: shingles(t or "") for i, t in rows}
    links = [
        (a, b)
        for a, b in itertools.combinations(sets, 2)
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    ]
    comp = union(sets, links)
    return {i: (len(sets[i]), comp[i]) for i in sets}


def edited_family(rng, words, copies, edits):
    base = [f"w{k}" for k in rng.integers(0, 10**6, words)]
    for _ in range(copies):
        own = list(base)
        for at in rng.integers(0, words, rng.integers(0, edits + 1)):
            own[at] = f"x{rng.integers(0, 10**6)}"
        yield " ".join(own)


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_components_of_near_copies(spark, seed):
    rng = np.random.default_rng(seed)
    passage = " ".join(f"p{k}" for k in range(60))
    texts = list(edited_family(rng, 60, 40, 4)) + list(edited_family(rng, 150, 25, 10)) + list(edited_family(rng, 12, 15, 1))
    texts += [passage + " " + " ".join(f"q{k}" for k in rng.integers(0, 10**6, n)) for n in (10, 11, 12, 15, 20, 25, 40, 80, 81, 200)]
    texts += [None, "", " \n\t", "Two Words", "two  words", "one", "x y z v w", "X y z v w", "é È", "é è"]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    docs = spark.createDataFrame([(int(i), t, "s") for i, t in rows], "doc_id bigint, text string, node string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(docs).collect()}
    assert got == jaccard_truth([(int(i), t) for i, t in rows])


def test_jaccard_components_of_the_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = jaccard_truth([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(docs).collect()}
    assert got == want
    kept = {r["doc_id"] for r in ngram_join.one_of_each_group(docs).collect()}
    assert kept == {i for i, (_, c) in want.items() if c == i}


def test_texts_that_share_an_id_keep_their_own_groups(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(60)) for x in "ab")
    rows = [(5, a), (5, b), (2, a + " more"), (3, b + " more"), (7, "something else that is long enough to have shingles"), (7, a)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r["doc_id"], r["component_id"]) for r in ngram_join.jaccard_components(docs).collect())
    assert got == [(2, 2), (3, 3), (5, 2), (5, 3), (7, 2), (7, 7)]
    kept = sorted((r["doc_id"], r["text"][:6]) for r in ngram_join.one_of_each_group(docs).collect())
    assert kept == [(2, "a0 a1 "), (3, "b0 b1 "), (7, "someth")]


def test_one_of_each_group_keeps_what_belongs_to_none(spark):
    a, alone = " ".join(f"a{k}" for k in range(40)), " ".join(f"z{k}" for k in range(40))
    rows = [(5, a, 1), (5, alone, 2), (2, a + " x", 3), (2, a + " x", 4), (None, a, 5), (None, a, 6), (9, None, 7), (9, None, 8), (10, " ", 9), (11, a, 10)]
    docs = spark.createDataFrame([(*r, "g") for r in rows], "doc_id bigint, text string, n int, node string")
    got = ngram_join.one_of_each_group(docs)
    assert got.columns == docs.columns
    kept = sorted(r["n"] for r in got.collect())
    assert kept in ([2, 3, 5, 6, 7, 8, 9], [2, 4, 5, 6, 7, 8, 9])
    assert ngram_join.one_of_each_group(docs.limit(0)).count() == 0


def test_prefix_bound_holds():
    for n in range(1, 60):
        for m in range(n, 80):
            for common in range(1, n + 1):
                if 100 * common >= 75 * (n + m - common):
                    assert n - ngram_join.prefix_length(n, 75) + 1 <= common


def test_parity_bits_bound_the_difference():
    rng = np.random.default_rng(7)
    for n in (0, 1, 20, 300):
        x = rng.integers(0, 2**63, n, dtype=np.uint64)
        y = np.concatenate([x[n // 5 :], rng.integers(0, 2**63, n // 4, dtype=np.uint64)])
        apart = sum(int(np.uint64(a ^ b)).bit_count() for a, b in zip(ngram_join.parity_bits(x).view("<u8"), ngram_join.parity_bits(y).view("<u8")))
        assert apart <= len(np.setxor1d(x, y))


def near(a, b, most):
    """Whether the edit distance is at most ``most``: the usual table, only as far from its diagonal as that."""
    if abs(len(a) - len(b)) > most:
        return False
    far = most + 1
    row = [j if j <= most else far for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        low, high = max(1, i - most), min(len(b), i + most)
        new = [far] * (len(b) + 1)
        if i <= most:
            new[0] = i
        for j in range(low, high + 1):
            new[j] = min(row[j - 1] + (x != b[j - 1]), row[j] + 1, new[j - 1] + 1)
        row = new
        if min(row[max(0, low - 1) : high + 1]) > most:
            return False
    return row[-1] <= most


def similar_pairs(bodies, percent):
    """All pairs of similar texts, by edit similarity alone. An edit changes at most four counts of character pairs and six of
    triples, which rules out most pairs of texts without a table."""
    order = sorted(range(len(bodies)), key=lambda k: len(bodies[k]))
    counts = {q: np.zeros((len(bodies), 1024), np.int16) for q in (2, 3)}
    for k, text in enumerate(bodies):
        for q in counts:
            np.add.at(counts[q][k], [xxhash.xxh32_intdigest(text[i : i + q].encode()) % 1024 for i in range(len(text) - q + 1)], 1)
    for at, k in enumerate(order):
        others = [m for m in order[:at] if 100 * len(bodies[m]) >= percent * len(bodies[k])]
        if others:
            most = len(bodies[k]) * (100 - percent) // 100
            close = np.array(others)
            for q, table in counts.items():
                close = close[np.abs(table[close] - table[k]).sum(1, dtype=np.int64) <= 2 * q * most]
            for m in close:
                if near(bodies[m], bodies[k], most):
                    yield int(m), k


def lines_truth(rows, percent=85):
    """doc_id -> text without the lines that are not the first of their group."""
    place = {}
    for i, text in sorted((r for r in rows if r[0] is not None and r[1] is not None)):
        for k, line in enumerate(text.split("\n")):
            words = tuple(re.findall(r"[^\W_]+", line.lower()))
            if words:
                place[i, k] = words
    forms = sorted(set(place.values()))
    links = [(forms[a], forms[b]) for a, b in similar_pairs([" ".join(f) for f in forms], percent)]
    comp = union(forms, links)
    seen, out = set(), {}
    for i, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        if text is None:
            out[i] = None
            continue
        left = []
        for k, line in enumerate(text.split("\n")):
            group = comp.get(place.get((i, k)))
            if group is None or group not in seen:
                left.append(line)
            seen.add(group)
        out[i] = "\n".join(left)
    return out


def test_lines_against_brute_force(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"word{k}" for k in range(400)]
    base = [" ".join(rng.choice(vocabulary, n)) for n in (3, 6, 12, 40, 80, 120, 160)]
    rows = []
    for i in range(60):
        text = []
        for line in rng.choice(base, 3):
            words = line.split()
            if rng.random() < 0.6 and len(words) > 8:
                words[rng.integers(len(words))] += "s"
            text.append(" ".join(words).capitalize() + ("." if rng.random() < 0.5 else " !"))
        text.append(" ".join(rng.choice(vocabulary, 9)))
        rows.append((i, "\n".join(text)))
    rows += [(100, None), (101, ""), (102, "\n\n---\n***\n---"), (103, "Page 1"), (104, "page, 1"), (105, "page 2"), (106, "x\n" * 50)]
    docs = spark.createDataFrame([(i, t, 0, "g") for i, t in rows], "doc_id bigint, text string, n_dropped int, gone string")
    got = lines.dedup_lines(docs)
    assert set(got.columns) == {"doc_id", "text", "gone", "n_lines", "n_dropped"}
    found = {r["doc_id"]: r for r in got.collect()}
    want = lines_truth(rows)
    assert {i: r["text"] for i, r in found.items()} == want
    dropped = {i: 0 if t is None else len(t.split("\n")) for i, t in rows}
    assert all(r["n_lines"] == dropped[i] for i, r in found.items())
    assert found[106]["n_dropped"] == 49
    # At least one pair was found that is not equal.
    forms = {tuple(re.findall(r"[^\W_]+", line.lower())) for _, t in rows if t for line in t.split("\n")}
    left = sum(len([x for x in t.split("\n") if re.search(r"[^\W_]", x)]) for t in want.values() if t)
    assert left < len(forms - {()})


def test_lines_with_repeated_and_missing_ids(spark):
    rows = [(1, "same line here now ok\nother"), (1, "same line here now ok\nother"), (None, "same line here now ok"), (2, "SAME line: here, now ok\nnew")]
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got.collect()) == [
        (0, "same line here now ok"),
        (1, "same line here now ok\nother"),
        (1, "same line here now ok\nother"),
        (2, "new"),
    ]


def vectors_truth(rows, threshold):
    ok = {}
    for k, (i, v, label) in enumerate(rows):
        if i is not None and label is not None and v is not None and None not in v:
            x = np.array(v, float)
            if np.isfinite(x).all() and x.any():
                ok[k] = x / np.linalg.norm(x)
    links = [
        (a, b)
        for a, b in itertools.combinations(ok, 2)
        if rows[a][2] == rows[b][2] and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] >= threshold
    ]
    n = {k: sum(k in p for p in links) for k in range(len(rows))}
    comp = union([rows[k][0] for k in ok], [(rows[a][0], rows[b][0]) for a, b in links])
    return sorted((i, n[k], comp.get(i, i)) for k, (i, _, _) in enumerate(rows))


def test_vectors_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(5)
    rows = []
    for c in range(12):
        centre = rng.normal(size=24)
        for _ in range(25):
            v = centre + rng.normal(size=24) * rng.choice([0.01, 0.12, 0.25])
            rows.append((len(rows), [float(np.float32(x)) for x in v], int(c % 3)))
    rows += [(len(rows) + k, rows[k % 4][1], rows[k % 4][2]) for k in range(40)]
    zero, bad = [0.0] * 24, [float("nan")] + [1.0] * 23
    rows += [(900, zero, 1), (901, None, 1), (902, bad, 1), (903, [None] + [1.0] * 23, 1), (904, rows[0][1], None), (905, [1.0, 2.0], 0), (906, [2.0, 4.0], 0)]
    rows += [(907, [], 0), (908, [float("inf")] * 24, 0), (909, [-0.0] * 23 + [1.0], 2), (910, [0.0] * 23 + [1.0], 2)]
    frame = spark.createDataFrame([(*r, "c") for r in rows], "vec_id bigint, embedding array<float>, label int, node string")
    got = embeddings.near_duplicates(frame, 0.98).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == vectors_truth(rows, 0.98)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_vectors_that_share_an_id_keep_their_own_links(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (4, [1.0, 0.01], 1), (3, [0.01, 1.0], 1), (1, [5.0, 5.0], 2)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(frame).collect())
    assert got == [(1, 0, 1), (1, 1, 1), (1, 1, 1), (3, 1, 1), (4, 1, 1)]


def test_vectors_empty_and_without_ids(spark):
    schema = "vec_id bigint, embedding array<float>, label int"
    assert embeddings.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    assert [tuple(r) for r in embeddings.near_duplicates(spark.createDataFrame([(None, [1.0], 1)], schema)).collect()] == [(None, 0, None, True)]


def test_close_pairs_stop_early_and_lose_nothing():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 40)) * np.linspace(3, 0.1, 40)
    x = np.concatenate([x, x[:50] + rng.normal(size=(50, 40)) * 0.02])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    i, j = embeddings.close_pairs(x, x, 0.98, step=64)
    assert set(zip(i.tolist(), j.tolist())) == set(zip(*[k.tolist() for k in np.nonzero(x @ x.T >= 0.98)]))


def test_components_of_chains_stars_and_loops(spark):
    rng = np.random.default_rng(4)
    chain = [(k, k + 1) for k in range(200, 260)]
    star = [(500, k) for k in range(501, 600)]
    loose = [(int(a), int(b)) for a, b in rng.integers(1000, 1200, (120, 2))]
    links = chain + star + loose + [(7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    assert got == union({n for p in real for n in p}, real)
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
