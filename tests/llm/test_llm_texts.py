"""Classifiers, fingerprints, tokens, packing, mixing and URL rules on small inputs."""

import hashlib
import itertools
import math
import pathlib
import re
import unicodedata
import zlib

import numpy as np
import pandas as pd
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from foliant.llm import mixing, order_minhash, packing, quality, queries, tokens, toxicity, urls
from foliant.llm.batches import Words, run_hashes
from foliant.llm.training import held_out_quality

WORD_BPE = str(public_tokenizers.path("word_bpe_49k.json"))
ODD = [
    None, "", " ", "\n\n", "Hello, World. It's 3.14!! ok...", "a" * 5000, "I\u0307stanbul J\u030cx Ý ﬁ e\u0301\u0302", "don't we'll THEY'RE",
    "x<|endoftext|>y", "x <|ENDOFTEXT|> y", "tab\tand\u00a0space\u2003em\u0085nel\x1cfs", "日本語 текст عربى 😀👍🏽", "a,b .c d. e, F. é. É,", "no\x00nul", "ΣΑΣ. ς",
]


def words_of(text):
    return [w for w in re.split(rb"[\x20\x09-\x0D]+", (text or "").encode().lower()) if w]


def test_word_hashes_follow_words():
    texts = [(t or "").encode() for t in ODD] + [b"x" * 300 + b" y"]
    w = Words(texts)
    flat = [x for t in texts for x in words_of(t.decode())]
    assert len(w.hashes) == len(flat) and w.first[-1] == len(flat)
    assert len(set(w.hashes.tolist())) == len(set(flat))
    assert len({(a, b) for a, b in zip(flat, w.hashes.tolist())}) == len(set(flat))


# --- classifiers ---


def test_noisy_or_and_sentences():
    texts = [b"You idiot. Fine day!\nBye", b"", b"...", "é à".encode()]
    s = toxicity.Sentences(texts)
    assert s.count == 6 and sorted(s.owner.tolist()) == [0, 0, 0, 1, 2, 3]
    found = {s.joined[a:b].decode() for a, b in zip(s.start, s.end)}
    assert {"You idiot", "Fine day", "Bye", "é à"} <= found
    p = np.array([0.5, 0.2, 0.0, 0.1, 0.0, 1.0])
    assert np.allclose(toxicity.noisy_or(p, np.array([0, 0, 1, 2, 3, 3]), 4), [0.6, 0.0, 0.1, 1.0])


def test_toxicity_is_learnt_from_document_labels(spark):
    rng = np.random.default_rng(1)
    clean = [f"word{k}" for k in range(300)]
    rows = []
    for i in range(600):
        sentences = [" ".join(rng.choice(clean, 6)) for _ in range(5)]
        toxic = int(rng.random() < 0.3)
        if toxic:
            at = rng.integers(5)
            sentences[at] += " " + str(rng.choice(["vilefoo", "vilebar", "vilebaz"])) + f"{rng.integers(40)}"
        rows.append((i, ". ".join(sentences), toxic, "x"))
    docs = spark.createDataFrame([(i, t, s) for i, t, _, s in rows], "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y, _ in rows] + [(None, 1), (3, None), (5000, 1)], "doc_id bigint, toxic int")
    weights = toxicity.train(docs, labels, toxicity.learnable)
    got = toxicity.score(docs, weights).toPandas().merge(pd.DataFrame(rows, columns=["doc_id", "t", "y", "s"]), on="doc_id")
    held = got[[zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]]
    assert len(held) > 100 and held_out_quality(held)["accuracy"] > 0.95
    caught = got[(got.y == 1) & (got.predicted == 1)]
    assert all(any("vile" in s for s in found) for found in caught.offending)
    left = {r["doc_id"] for r in toxicity.clean_documents(docs, weights).collect()}
    assert left == set(got[got.score < 0.7].doc_id)


def plain_toxicity(text, weights):
    """Score and offending sentences of one text, word by word."""
    lower = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    clean, found = 1.0, []
    pieces = [p for p in re.split(rb"[\n\r!.?]", lower) if re.search(rb"[0-9a-z\x80-\xff]", p)] or [b""]
    for piece in pieces:
        z = weights[-1]
        for word in re.findall(rb"[0-9a-z\x80-\xff]+", piece):
            for size in (None, *(n for n in (3, 4, 5, 6) if n < len(word))):
                part = np.frombuffer(word[:size], np.uint8)
                h = int(run_hashes(part, np.array([0]), np.array([len(part)]))[0]) + (size or 0)
                z += weights[(h % 2**64) >> 46]
        p = 1 / (1 + math.exp(-max(-30, min(30, z))))
        clean *= 1 - p
        if p >= 0.5:
            found.append(piece)
    return 1 - clean, len(found)


def test_toxicity_scores_against_a_plain_loop(spark):
    rng = np.random.default_rng(4)
    weights = rng.normal(size=toxicity.WEIGHTS + 1) * 0.7
    weights[-1] = -2.0
    texts = [t for t in ODD if t is None or "\x1c" not in t] + ["A bad day. A good day!\nBad", "word " * 60_000, "One. " * 30_000] + [" ".join(f"w{k}." for k in rng.integers(0, 50, 30))]
    rows = [(i, t, 0.5, "z") for i, t in enumerate(texts)] + [(1, "A bad day.", 0.5, "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score double, predicted string")
    got = sorted((r["doc_id"], r["score"], len(r["offending"]), r["predicted"]) for r in toxicity.score(docs, weights).collect())
    want = sorted((i, *plain_toxicity(t, weights)) for i, t, *_ in rows)
    assert len(got) == len(want)
    for (i, score, n, predicted), (j, truth, m) in zip(got, want):
        assert (i, n, predicted) == (j, m, int(score >= 0.7)) and abs(score - truth) < 1e-9
    assert toxicity.score(docs.limit(0), weights).count() == 0
    kept = toxicity.clean_documents(docs, weights)
    assert kept.columns == docs.columns and kept.count() == sum(score < 0.7 for _, score, _ in want)


def test_hinge_loss_reaches_its_minimum():
    rng = np.random.default_rng(2)
    rows = [np.sort(rng.choice(50, 10, replace=False)) for _ in range(80)]
    values = [rng.normal(size=10) for _ in rows]
    sign = np.where(rng.random(80) < 0.5, 1.0, -1.0)

    def loss(w):
        margins = np.array([s * (w[r] @ v + w[-1]) for r, v, s in zip(rows, values, sign)])
        return w @ w / 2 + np.maximum(0, 1 - margins).sum()

    best = quality.dual_descent(rows, values, sign, rounds=400)
    assert all(loss(best) <= loss(best + step) + 1e-3 for step in rng.normal(size=(40, len(best))) * 0.01)


def test_indicators_are_presence_of_grams():
    one, two, none, again = quality.indicators([b"the the cat", b"cat the", b"", b"the the cat"])
    assert len(none) == 0 and (one == again).all() and len(np.intersect1d(one, two)) > 0 and len(np.unique(one)) == len(one)


@pytest.mark.parametrize("name,label,floor", [("op1_toxicity", "toxic", 0.8), ("op2_quality", "quality", 0.99)])
def test_held_out_accuracy(spark, name, label, floor):
    folder = "/root/testdata/sf0.01"
    got = queries.QUERIES[name](spark, folder).toPandas()
    labels = pd.read_parquet(f"{folder}/labels.parquet")
    assert len(got) == 1000 and got.score.between(0, 1).all()
    held = got.merge(labels.assign(y=labels[label]), on="doc_id").query("held_out")
    assert held_out_quality(held)["area"] > floor


def test_classifiers_without_labels_or_documents(spark):
    docs = spark.createDataFrame([(1, None), (1, None), (2, ""), (None, "x y")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, toxic int, quality int")
    for model in (toxicity, quality):
        weights = model.train(docs, none, model.learnable)
        assert model.score(docs, weights).count() == 4
        assert model.score(docs.limit(0), weights).count() == 0
        assert all(0 <= r["score"] <= 1 for r in model.score(docs, weights).collect())


# --- fingerprints ---


def plain_fingerprint(text):
    """Positions chosen by sorting all values, instead of by repeated minima."""
    full = order_minhash.numbered_kmers(text)
    short = (full >> np.uint64(32)).astype(np.uint32)
    out = []
    for k in range(order_minhash.SKETCHES):
        v = short * order_minhash._FACTOR[k] + order_minhash._SHIFT[k]
        two = sorted(sorted(range(len(v)), key=lambda i: (int(v[i]), i))[:2])
        a, b = full[two[0]], full[two[-1]]
        mixed = order_minhash.mix(np.array([a]) * np.uint64(3) + order_minhash.mix(np.array([b])) + order_minhash._NUMBER[k])
        out.append(max(1, int(mixed[0] >> np.uint64(32))))
    return np.array(out, np.uint32)


def test_fingerprints_take_the_two_smallest_kmers_in_text_order(monkeypatch):
    monkeypatch.setattr(order_minhash, "_CHUNK", 50)
    for text in ["a", "short", "abcdefgh", "abcdefghi", "the cat sat on the mat " * 12, "é😀" * 40]:
        assert (order_minhash.fingerprint(text) == plain_fingerprint(text)).all()
    assert len(set(order_minhash.numbered_kmers("abcdefgh" * 3).tolist())) == 17  # repeats have numbers of their own


def test_order_fingerprints_against_a_plain_loop(spark):
    texts = ["alpha beta gamma delta " * 20, "", None, "é" * 9, "alpha beta gamma delta " * 19 + "omega", "x", "longer text " * 200, "alpha beta gamma delta " * 20]
    rows = [(i * 7 % 31, t, i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, bucket int").repartition(3)
    got = {r["doc_id"]: r for r in order_minhash.order_fingerprints(docs, partitions=4).collect()}
    order = sorted(((i, t or "") for i, t, _ in rows), reverse=True)
    for (i, text), (_, following) in zip(order, order[1:] + order[:1]):
        half = len(text) // 2
        other = text[: len(text) - half] + following[:half]
        marks = [order_minhash.fingerprint(t) for t in (text, other, following)]
        r = got.pop(i)
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(other.encode()).hexdigest()
        assert r["near_edited"] == float((marks[0] == marks[1]).mean()) and r["near_next"] == float((marks[0] == marks[2]).mean())
        assert r["fingerprint"] == marks[0].astype(">u4").tobytes().hex()
    assert not got


def test_order_fingerprints_follow_edits():
    rng = np.random.default_rng(8)
    text = " ".join(f"w{k}" for k in rng.integers(0, 5000, 400))
    near = [order_minhash.likeness(order_minhash.fingerprint(text), order_minhash.fingerprint(text[:n] + text[n:][::-1])) for n in (2000, 1000, 0)]
    assert near[0] > near[1] > near[2] and near[2] < 0.05


def test_order_fingerprints_with_odd_ids(spark):
    schema = "doc_id bigint, text string"
    assert order_minhash.order_fingerprints(spark.createDataFrame([], schema)).count() == 0
    assert order_minhash.order_fingerprints(spark.createDataFrame([(None, "a"), (None, "b")], schema)).count() == 2
    rows = [(1, "one"), (1, "one"), (1, None), (None, "none"), (2, "two")]
    got = order_minhash.order_fingerprints(spark.createDataFrame(rows, schema), partitions=3).collect()
    assert sorted((r["doc_id"] or 0, r["n_chars"]) for r in got) == [(0, 4), (1, 0), (1, 3), (1, 3), (2, 3)]


# --- tokens and packing ---


def library_ids(text):
    return Tokenizer.from_file(WORD_BPE).encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_the_library(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_WORDS", 50)
    sample = pd.read_parquet("/root/testdata/sf0.001/documents.parquet").text.tolist()[:60] + [t or "" for t in ODD]
    sample += [unicodedata.normalize("NFD", t or "") for t in ODD]
    enc, lib = tokens.Encoder(WORD_BPE), Tokenizer.from_file(WORD_BPE)
    assert enc.by_word
    for t in sample:
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, t[:80]


def test_other_tokenizers_go_to_their_libraries():
    piece = str(public_tokenizers.path("piece_bpe_32k.model"))
    import sentencepiece

    text = "Hello wörld. 12"
    assert np.frombuffer(tokens.Encoder(piece).encode(text), "<u4").tolist() == sentencepiece.SentencePieceProcessor(model_file=piece).encode(text)
    byte = str(public_tokenizers.path("byte_bpe_50k.json"))
    enc = tokens.Encoder(byte)
    assert not enc.by_word and len(enc.encode("a <|endoftext|> b")) == 4 * len(Tokenizer.from_file(byte).encode("a <|endoftext|> b", add_special_tokens=False).ids)


def test_counts_come_from_the_cache_when_it_has_them(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, "Hello, World. It's 3.14!! ok..."), (None, "no id"), (None, "no id either")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, n_tokens int")
    cache = f"file://{tmp_path}/cache"
    first = tokens.count_tokens(docs, WORD_BPE, cache, limit=5)
    want = sorted((i if i is not None else -1, len((t or "").encode()), len(library_ids(t)), len(library_ids(t)) > 5) for i, t in rows)
    seen = sorted((r[0] if r[0] is not None else -1, *r[1:]) for r in first.collect())
    assert seen == want
    stored = spark.read.parquet(cache).count()
    assert stored == len({t or "" for _, t in rows})
    # A wrong stored count shows that the second run reads the cache; a new text is appended.
    spark.createDataFrame([(tokens.tokenizer_version(WORD_BPE), hashlib.sha256(b"planted").hexdigest(), 99)], "version string, digest string, n_tokens bigint").write.mode("append").parquet(cache)
    more = spark.createDataFrame([(1, "planted"), (2, "quite new text"), (3, None)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.count_tokens(more, WORD_BPE, cache).collect()}
    assert got == {1: 99, 2: len(library_ids("quite new text")), 3: 0}
    assert spark.read.parquet(cache).count() == stored + 2
    assert tokens.count_tokens(docs.limit(0), WORD_BPE, cache).count() == 0


def test_fullest_combination_is_the_best():
    rng = np.random.default_rng(6)
    for _ in range(60):
        counts = {int(n): int(rng.integers(1, 3)) for n in rng.integers(1, 40, 6)}
        room = int(rng.integers(1, 90))
        items = [n for n, c in counts.items() for _ in range(c)]
        best = max(sum(c) for k in range(len(items) + 1) for c in itertools.combinations(items, k) if sum(c) <= room)
        chosen = packing.fullest(counts, sorted(counts, reverse=True), room)
        assert sum(chosen) == best and all(chosen.count(n) <= counts[n] for n in chosen)


def check_packing(rows, docs, capacity):
    by_doc, by_bin = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_bin.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_bin.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    for i, text in docs:
        ids = np.array([*library_ids(text), 1], "<u4")
        parts = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [p["piece"] for p in parts] == list(range(-(-len(ids) // capacity)))
        for p in parts:
            own = ids[p["start"] : p["start"] + p["length"]]
            assert len(own) == p["length"] and (p["length"] == capacity or p is parts[-1]) and zlib.crc32(own.tobytes()) == p["ids_crc32"]
    return len(by_bin)


@pytest.mark.parametrize("capacity", [16, 64])
def test_packing_is_whole_and_tight(spark, capacity):
    rng = np.random.default_rng(capacity)
    texts = [" ".join(["cat"] * int(n)) for n in rng.integers(0, 2 * capacity, 150)] + [None, "", "cat"] * 20
    docs = [(i, t) for i, t in enumerate(texts)]
    got = packing.pack(spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id bigint, text string, rank int"), WORD_BPE, capacity).collect()
    bins = check_packing(got, docs, capacity)
    assert bins <= -(-sum(r["length"] for r in got) // capacity) + 1


def test_packing_of_repeated_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b")] * 5 + [(None, "c")], "doc_id bigint, text string")
    got = packing.pack(docs, WORD_BPE, 4).collect()
    assert len(got) == 6 and len({(r["sequence_id"], r["offset"]) for r in got}) == 6
    assert packing.pack(docs.limit(0), WORD_BPE, 4).count() == 0


# --- mixing ---


def test_water_filling_by_rounds(spark):
    rng = np.random.default_rng(12)
    for n in (1, 2, 7, 20):
        sizes = rng.integers(1, 10 ** int(rng.integers(1, 6)), n)
        rows = [(f"s{k:02d}", int(s), k % 3 + 1) for k, s in enumerate(sizes)]
        frame = spark.createDataFrame(rows, "source string, size bigint, weight bigint")
        got = {r["source"]: r["target"] for r in mixing.water_fill(frame, 3).collect()}
        total, clamped, target = sum(s for _, s, _ in rows), set(), {}
        while True:
            free = total - sum(3 * s for k, s, _ in rows if k in clamped)
            weight = sum(w for k, _, w in rows if k not in clamped)
            target = {k: 3.0 * s if k in clamped else free * w / weight for k, s, w in rows}
            above = {k for k, s, _ in rows if k not in clamped and target[k] > 3 * s}
            if not above:
                break
            clamped |= above
        assert all(abs(got[k] - target[k]) < 1e-6 * max(1, target[k]) for k in target)


def test_mix_is_near_its_targets_and_repeats(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "w " * int(rng.integers(0, 60)), str(rng.choice(["a", "b", "c"], p=[0.9, 0.07, 0.03])), 5) for i in range(900)]
    rows += [(1000, None, None, 5), (1001, "one two", None, 5), (1001, "one two", None, 5), (1002, "", "empty", 5), (None, "x y z", "a", 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, size int")
    got = mixing.mix_sources(docs).toPandas()
    assert len(got) == len(rows)
    again = mixing.mix_sources(docs.repartition(5)).toPandas()
    key = ["doc_id", "size", "taken"]
    assert got.sort_values(key)[key].reset_index(drop=True).equals(again.sort_values(key)[key].reset_index(drop=True))
    assert (got.taken <= 3 * got["size"]).all() and (got["size"] == 0).sum() >= 2
    for (size, target), part in got.groupby(["source_size", "target"]):
        assert part["size"].sum() == size and abs(part.taken.sum() - target) <= part["size"].max()
    mixed = mixing.mixed_documents(docs).toPandas()
    assert list(mixed.columns) == docs.columns
    assert mixed.text.fillna("").str.split().str.len().sum() == got.taken.sum()
    assert mixing.mix_sources(docs.limit(0)).count() == 0 and mixing.mixed_documents(docs.limit(0)).count() == 0


def test_rows_that_share_an_id_are_mixed_apart(spark):
    rows = [(None, " ".join(["w"] * 10), "a")] * 50 + [(7, f"x y {k}", "a") for k in range(30)] + [(k, " ".join(["v"] * 100), "b") for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3)
    got = mixing.mix_sources(docs).toPandas()
    for (size, target), part in got.groupby(["source_size", "target"]):
        assert part["size"].sum() == size and abs(part.taken.sum() - target) <= part["size"].max()
    mixed = mixing.mixed_documents(docs).toPandas()
    assert mixed.text.str.split().str.len().sum() == got.taken.sum()


# --- URLs ---


def plain_verdict(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0].translate({k: k + 32 for k in range(65, 91)})
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    fit = [(len(h + p), h.count("."), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best[3] if best else None, best[2] if best else "allow"


def test_url_rules(spark):
    rules = [*queries.URL_RULES, ("a.b.org", "", "block"), ("b.org", "/x", "allow"), ("b.org", "/x", "block"), (None, "/", "block"), ("", "/", "block")]
    given = [
        None, "", "no scheme/de/", "http://example.org/es/1", "https://WWW.Example.ORG/en/12?q#f", "http://example.org", "http://notexample.org/es/",
        "http://x.com/de/", "http://x.com/fr/a://b", "http://com/de/", "http://a.b.org", "http://b.org/xyz", "ftp://b.org?/x", "http://b.org#/x",
        "http://u@h.org:80/", "://org/", "http://..org/", "http://" + "a." * 3000 + "org/" + "p/" * 5000, "http://É.org/é", "http://example.org/en/1",
    ]
    docs = spark.createDataFrame([(i, u, "r", "v") for i, u in enumerate(given * 2)], "page_id bigint, url string, rule string, prefix string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = urls.judge_urls(docs, table).collect()
    known = [r for r in rules if r[0]]
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == plain_verdict(given[r["page_id"] % len(given)], known), r["url"]
    assert len(got) == 2 * len(given)
    none = urls.judge_urls(docs, table.limit(0), default="block")
    assert {(r["rule"], r["verdict"]) for r in none.collect()} == {(None, "block")}
    assert urls.judge_urls(docs.limit(0), table).count() == 0


def test_no_operator_names_a_machine_folder():
    for f in pathlib.Path(queries.__file__).parent.glob("*.py"):
        assert "tempfile" not in f.read_text() and "localCheckpoint" not in f.read_text()
