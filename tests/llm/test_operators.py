"""The corpus operators against brute force, and on rows that are null, empty, long, repeated or oddly named."""

import hashlib
import random
import re
import struct

import numpy as np
import pytest

from cairn.llm import decontam, fingerprint, langid, license, minhash, packing, quality, sentencepiece, toxicity, warc

MODEL, RANKS = "/opt/tokenizers/piece_bpe_32k.model", "/opt/tokenizers/byte_bpe_50k.tiktoken"
SF = "/root/testdata/sf0.001"
EDGE = [None, "", " \n\t", "...", "word", "Two words", "a b c", "a b c d", "A B C D", "e f g h i j k l m n o p q r s t", "e f g h i j k l m n o p q r s t", "日本語 テキスト é́ \x00 😀", "x" * 5000, "long text " * 4000, "MIT License and the Apache License, Version 2.0; CC BY 4.0", "MIT\nlicense MIT license"]


@pytest.fixture(scope="module")
def edge(spark):
    rows = [(i, t, "en" if i % 2 else None, "s", 1.0, 7) for i, t in enumerate(EDGE)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double, component_id int").repartition(3)


@pytest.fixture(scope="module")
def empty(edge):
    return edge.limit(0)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def words(text, pattern):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(pattern, low)


def test_near_duplicates_equal_brute_force(spark, edge, empty, docs):
    rng = random.Random(3)
    base = [f"w{rng.randrange(50)}" for _ in range(60)]
    rows = [(1000 + k, " ".join(w if rng.random() > k / 900 else f"x{rng.randrange(9)}" for w in base)) for k in range(60)]
    table = spark.createDataFrame(rows, "doc_id long, text string").unionByName(edge.select("doc_id", "text")).unionByName(docs.select((docs.doc_id + 5000).alias("doc_id"), "text"))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(table, width=4).collect()}
    sets = {}
    for r in table.collect():
        w = words(r.text, r"[^\x20\x09-\x0D]+")
        sets[r.doc_id] = {tuple(w[i : i + 4]) for i in range(max(len(w) - 3, 1))} if w else set()
    comp = {i: i for i in sets}

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and (k := len(sets[a] & sets[b])) and 100 * k >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                comp[y] = x
    assert got == {i: (len(sets[i]), find(i), find(i) == i) for i in ids}
    assert minhash.near_duplicates(empty).count() == 0


def test_language(edge, empty, docs):
    model = langid.learn(docs)
    out = langid.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang_pred == r.lang for r in out) / len(out) > 0.95 and all(0 <= r.score <= 1 for r in out)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(edge, model).collect()}
    assert len(got) == len(EDGE) and all(got[i] == ("und", 0.0) for i in range(4))
    assert langid.predict(empty, model).count() == 0 and langid.learn(empty) == []
    assert {r.lang_pred for r in langid.predict(edge, []).collect()} == {"und"}


def test_near_duplicates_of_null_and_repeated_ids(spark, tmp_path):
    a, b = "a b c d e f g h i j k l", "p q r s t u v w x y z 1 2 3 4 5 6 7 8 9"
    rows = [(None, a), (None, a), (None, None), (5, a), (5, b), (5, b), (7, b), (9, a), (3, None), (3, ""), (2, a)]
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect())
    assert got == sorted([("None", 8, "None", True), ("None", 8, "None", True), ("None", 0, "None", True), ("5", 16, "5", True), ("7", 16, "5", False), ("9", 8, "2", False), ("2", 8, "2", True), ("3", 0, "3", True)])


def test_classes_beside_one_hub_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SIDE", 3)
    rng = random.Random(12)
    rows = []
    for hub in (1, 2):
        for k in range(40):
            n, lost = rng.randrange(8, 14), rng.randrange(3)
            comp = rng.choice([0, 0, 0, 100 + rng.randrange(9)])
            rows.append((hub, 10 * k + hub, comp, rng.random() / 2, n, lost, [rng.getrandbits(62) & rng.getrandbits(62) & 0xFFFF for _ in range(minhash.WORDS)], 0))
    full = spark.createDataFrame(rows, "hub long, rep long, comp long, far double, n long, lost long, bits array<bigint>, main long")
    got = sorted(map(tuple, minhash._blocks(full, 80).collect()))
    want = set()
    for h, r, c, f, n, lost, bits, _ in rows:
        for h2, r2, c2, f2, n2, lost2, bits2, _ in rows:
            most = sum((x & y).bit_count() for x, y in zip(bits, bits2, strict=True)) + min(lost, lost2)
            if h == h2 and c != 0 and c != c2 and abs(f - f2) <= 0.2 + 1e-9 and 180 * most >= 80 * (n + n2):
                want.add((min(r, r2), max(r, r2)))
    assert got == sorted(want) and want


def language_vector(text):
    """The bundle of a text, letter by letter; None without a letter."""
    s = [ord(c.lower()[0]) + 1 if c.isalpha() else 0 for c in text]
    s = [0, *(x for i, x in enumerate(s) if x or i and s[i - 1]), 0]
    s = s[:-1] if len(s) > 2 and s[-2] == 0 else s
    sign = {x: 1 - 2 * langid.letter_bits(np.array([x]))[0].astype(int) for x in set(s)}
    v = sum((np.roll(sign[a], 2) * np.roll(sign[b], 1) * sign[c] for a, b, c in zip(s, s[1:], s[2:], strict=False) if b), np.zeros(langid.DIMENSIONS, int))
    return v if any(s) else None


def test_language_equals_brute_force(spark, monkeypatch):
    texts = {0: "Hola, señor! ¿Qué tal", 1: "", 2: "a1b", 3: "der Hund und die Katze", 4: "ДА нет", 5: "日本語 テキスト", 6: "the dog and the cat", 7: "  x ", 8: None, 9: "Der hund", 10: "the The THE cat", 11: "нет да", 12: "señor hola"}
    langs = {0: "es", 3: "de", 4: "ru", 5: "ja", 6: "en", 9: "de"}
    table = spark.createDataFrame([(i, t, langs.get(i)) for i, t in texts.items()], "doc_id long, text string, lang string").repartition(3)
    proto = {}
    for i, lang in langs.items():
        proto[lang] = proto.get(lang, 0) + language_vector(texts[i])
    model = langid.learn(table)
    assert len(model) == 1 and model[0][0] == sorted(proto)
    for name, row in zip(*model[0], strict=True):
        assert np.allclose(row, proto[name] / np.linalg.norm(proto[name]), atol=1e-6)

    def check(model):
        for r in langid.predict(table, model).collect():
            v = language_vector(texts[r.doc_id] or "")
            if v is None:
                assert (r.lang_pred, r.score, r.n_letters) == ("und", 0.0, 0)
                continue
            cos = {k: p @ v / np.linalg.norm(p) / np.linalg.norm(v) for k, p in proto.items()}
            assert abs(r.score - max(max(cos.values()), 0)) < 1e-5 and cos[r.lang_pred] > max(cos.values()) - 1e-5
            assert r.n_letters == sum(c.isalpha() for c in texts[r.doc_id])

    check(model)
    monkeypatch.setattr(langid, "BLOCK", 2)  # more languages than one pass compares: none is left out
    blocks = langid.learn(table)
    assert [n for n, _ in blocks] == [["de", "en"], ["es", "ja"], ["ru"]]
    check(blocks)


def test_every_letter_has_its_own_vector():
    letters = sorted({ord(chr(c).lower()[0]) + 1 for c in [*range(0x41, 0x24F), *range(0x370, 0x52F), *range(0x4E00, 0x5E00)] if chr(c).isalpha()})
    bits = langid.letter_bits(np.array(letters)).astype(np.float32) * 2 - 1
    dots = bits @ bits.T / langid.DIMENSIONS - np.eye(len(letters))
    assert np.abs(dots).max() < 0.25


def test_licenses_equal_brute_force(edge, empty, docs):
    phrases = {("gnu", "general", "public", "license"): "gpl", ("apache", "license"): "apache", ("cc", "by"): "cc-by", ("mit", "license"): "mit"}
    for table in (edge, docs):
        texts = {r.doc_id: r.text for r in table.collect()}
        for r in license.licenses(table).collect():
            w = words(texts[r.doc_id], r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
            at = [(i, label) for i in range(len(w)) for p, label in phrases.items() if tuple(w[i : i + len(p)]) == p]
            base = sorted({x for _, x in at})
            assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(base))
            assert set(base) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
    found = {r.doc_id: r.labels for r in license.licenses(edge).collect()}
    assert found[14] == "apache,apache-2.0,cc-by,cc-by-4.0,mit" and license.licenses(empty).count() == 0


def plain_labels(text):
    """(labels, best priority) by trying every rule on every text and settling overlaps one by one."""
    w = words(text, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    norm = " " + " ".join(w) + " "
    found = []
    for i, label, _, pattern, priority in license.rules():
        for m in re.finditer(pattern, norm):
            s = norm[: m.start()].count(" ") - 1
            found.append((-priority, s, -(s + m[0].count(" ") + 1), i, label))
    kept = []
    for p, s, e, i, label in sorted(found):
        if not any((s2 <= s and e2 <= e) or (p2 < p and s2 < -e and s < -e2) for p2, s2, e2, _, _ in kept):
            kept.append((p, s, e, i, label))
    return {x[4] for x in kept}, max((-x[0] for x in kept), default=0)


def test_license_rules_equal_plain_resolution(spark, docs):
    rng = random.Random(8)
    parts = ["copyright 2020 foo", "all rights reserved", "BSD 3-Clause", "licensed under the", "MIT License", "GPL v3 or later", "GNU General Public License version 2", "Apache 2.0", "as is without warranty of any kind", "public domain", "CC BY-SA 4.0", "the", "x", "Redistribution and use in source and binary forms, with or without modification, are permitted", "0BSD", "under the terms of the", "Mozilla Public License", "SPDX-License-Identifier: MIT", "neither the name of X nor Y may be used to endorse or promote products", "Copyright (c) all rights reserved"]
    rows = [(i, " ".join(rng.choice(parts) for _ in range(rng.randrange(1, 14)))) for i in range(400)]
    rows += [(1000, "Copyright 2020 Foo, BSD 3-Clause, all rights reserved"), (1001, "copyright x under GPL v3 all rights reserved"), (1002, "MIT License " * 300), (1003, None)]
    for table in (spark.createDataFrame(rows, "doc_id long, text string"), docs):
        texts = {r.doc_id: r.text or "" for r in table.collect()}
        for r in license.licenses(table).collect():
            labels, best = plain_labels(texts[r.doc_id])
            base = {x for x in r.base_labels.split(",") if x}
            assert {x for x in r.labels.split(",") if x} == labels | base, texts[r.doc_id]
            assert abs(r.score - max(0.5 if base else 0, best / 100)) < 1e-9
    got = {r.doc_id: r.labels.split(",") for r in license.licenses(spark.createDataFrame(rows[-4:], "doc_id long, text string")).collect()}
    assert got[1000] == ["bsd-3-clause", "proprietary"] and got[1001] == ["gpl-3.0", "proprietary"] and got[1002] == ["mit"]
    assert len(license.written()) > 400 and len({x[3] for x in license.rules()}) > 400


def test_viterbi_equals_brute_force():
    pieces = [("<unk>", 0.0, 2), *((f"<0x{i:02X}>", 0.0, 6) for i in range(256))] + [(p, s, 1) for p, s in [("▁", -3.0), ("a", -2.0), ("b", -2.1), ("ab", -2.5), ("ba", -3.3), ("aba", -4.0), ("▁a", -2.2), ("▁ab", -4.1), ("bab", -2.9)]]
    auto = sentencepiece.Automaton(pieces)
    score = {p: s for p, s, k in pieces if k == 1}
    rng = random.Random(1)
    texts = ["▁" * rng.randrange(3) + "".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))) for _ in range(200)]
    ids, off = auto.solve(texts)
    for k, t in enumerate(texts):
        best = [0.0] + [-1e9] * len(t)
        for i in range(1, len(t) + 1):
            best[i] = max([best[i - 1] + auto.unknown] + [best[j] + score[t[j:i]] for j in range(i) if t[j:i] in score])
        own = ids[off[k] : off[k + 1]]
        spelt = "".join(pieces[i][0] if i >= 0 else chr(-1 - i) for i in own)
        total = sum(pieces[i][1] if i >= 0 else auto.unknown for i in own)
        assert spelt == t and abs(total - best[-1]) < 1e-9


def test_sentencepiece_round_trip(edge, empty, docs):
    for table in (edge, docs):
        texts = {r.doc_id: r.text or "" for r in table.collect()}
        for r in sentencepiece.encode(table, MODEL).collect():
            assert r.exact and bytes(r.decoded).decode() == texts[r.doc_id] and r.n_ids == len(r.ids)
    assert sentencepiece.encode(empty, MODEL).count() == 0


def test_packing(edge, empty, docs):
    tool = packing.encoder(RANKS, packing.PATTERN)[0]
    for table in (edge, docs.select("doc_id", "text")):
        parts: dict[int, list] = {}
        for r in packing.pack(table, RANKS, 256).collect():
            ids = np.frombuffer(r.ids, "<i4")
            assert len(ids) == 256 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens and r.position_starts == r.cu_seqlens[:-1]
            assert packing.positions(np.array(r.cu_seqlens), 256)[r.cu_seqlens[:-1]].max() == 0
            for k, (d, o) in enumerate(zip(r.doc_ids, r.doc_offsets, strict=True)):
                parts.setdefault(d, []).append((o, ids[r.cu_seqlens[k] : r.cu_seqlens[k + 1]].tolist()))
        for r in table.collect():
            assert [x for _, p in sorted(parts[r.doc_id]) for x in p] == [*tool.encode_ordinary(r.text or ""), 50256]
    assert packing.pack(empty, RANKS).count() == 0


def test_packing_keeps_rows_without_id(spark):
    rows = [(None, "a b"), (None, "a b"), (-1, "c"), (4, None), (4, "d e f"), (4, "d e f")]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), RANKS, 16).collect()
    tool = packing.encoder(RANKS, packing.PATTERN)[0]
    got = sorted(str((d, np.frombuffer(r.ids, "<i4")[r.cu_seqlens[k] : r.cu_seqlens[k + 1]].tolist())) for r in out for k, d in enumerate(r.doc_ids))
    assert got == sorted(str((d, [*tool.encode_ordinary(t or ""), 50256])) for d, t in rows)


def test_best_fit_equals_naive():
    rng = np.random.default_rng(2)
    for _ in range(30):
        sizes = rng.integers(1, 65, 80)
        rows, free = np.zeros(80, int), []
        for i in np.argsort(-sizes, kind="stable"):
            fit = [(c, k) for k, c in enumerate(free) if c >= sizes[i]]
            k = min(fit)[1] if fit else len(free)
            free += [64] * (not fit)
            free[k] -= sizes[i]
        got = packing.best_fit(sizes, 64)
        used = np.bincount(got, weights=sizes)
        assert used.max() <= 64 and sorted(64 - used) == sorted(free)


def test_quality_and_toxicity_on_held_out_rows(spark, edge, empty):
    rng = random.Random(5)
    common = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(900):
        w = [rng.choice(common) for _ in range(rng.randrange(20, 80))]
        bad, rude = i % 3 == 0, i % 5 == 0
        w = [x.upper() + "!!" for x in w] if bad else w
        for _ in range(3 * rude):
            w[rng.randrange(len(w))] = rng.choice(["vile", "oaf", "dolt"])
        rows.append((i, " ".join(w), "score"))
        labels.append((i, int(not bad), int(rude)))
    d = spark.createDataFrame(rows, "doc_id long, text string, score string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    truth = {i: (q, t) for i, q, t in labels}
    for f, k in ((quality.quality, 0), (toxicity.toxicity, 1)):
        out = [r for r in f(d, lab).collect() if r.held_out]
        assert sum(r.predicted == truth[r.doc_id][k] for r in out) / len(out) > 0.97
        assert f(d.limit(0), lab).count() == 0
        assert {r.score for r in f(d, lab.limit(0)).collect()} == {0.5}
    for r in quality.quality(edge, lab).collect() + toxicity.toxicity(edge, lab).collect():
        assert 0 <= r.score <= 1


def test_quality_equals_plain_ftrl():
    import pyarrow as pa

    from cairn.llm.textbytes import column_bytes

    rng = random.Random(2)
    texts = [" ".join(rng.choice(["aa", "Bb", "C3", "dd!", "??", "ee"]) for _ in range(rng.randrange(9))) for _ in range(60)]
    y = [rng.randrange(2) for _ in texts]
    w = quality.ftrl(iter(pa.table({"text": texts, "y": y}).to_batches()))["w"]
    cell, value, at = quality.features(*column_bytes(pa.array(texts)))
    rows = [[*zip(cell[at[i] : at[i + 1]].tolist(), value[at[i] : at[i + 1]].astype(np.float32).tolist(), strict=True), (quality.CELLS, 1.0)] for i in range(len(texts))]
    assert all(abs(sum(v * v for _, v in r[:-1]) - 1) < 1e-6 for r in rows if len(r) > 1)
    z, n = {}, {}

    def weight(i):
        zi = z.get(i, 0.0)
        return 0.0 if abs(zi) <= quality.L1 else -(zi - (1 if zi > 0 else -1) * quality.L1) / ((quality.BETA + n.get(i, 0.0) ** 0.5) / quality.ALPHA + quality.L2)

    order = np.random.Generator(np.random.PCG64(5))
    for _ in range(quality.EPOCHS):
        for k in order.permutation(len(rows)):
            used = {i: weight(i) for i, _ in rows[k]}
            p = 1 / (1 + np.exp(-sum(used[i] * v for i, v in rows[k])))
            for i, v in rows[k]:
                g = (p - y[k]) * v
                sigma = ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / quality.ALPHA
                z[i] = z.get(i, 0.0) + g - sigma * used[i]
                n[i] = n.get(i, 0.0) + g * g
    assert np.allclose(w[list(z)], [weight(i) for i in z], atol=1e-5) and np.count_nonzero(w) <= len(z)
    got = quality.dots(w.astype(float), *column_bytes(pa.array(texts)))
    assert np.allclose(got, [1 / (1 + np.exp(-sum(float(w[i]) * v for i, v in r))) for r in rows], atol=1e-6)


def plain_kneser_ney(texts, y):
    """(vocabulary, p(c, v, w)) by dictionaries, w None being an unseen word and v "" the start."""
    grams = {c: {} for c in (0, 1)}
    for text, c in zip(texts, y, strict=True):
        w = ["", *text.lower().split()]
        for i in range(1, len(w)):
            grams[c].setdefault((w[i - 1], w[i]), set()).add(w[i - 2] if i > 1 else None)
    vocabulary = sorted({x for c in grams for g in grams[c] for x in g} | {""})
    count = {c: {g: len(u) for g, u in grams[c].items()} for c in grams}
    apart = {c: {w: sum(1 for g in count[c] if g[1] == w) for w in vocabulary} for c in grams}

    def shares(counts, least):
        """What each class takes off and leaves, equal for both."""
        left = lambda c, d: sum(min(n, d) for n in counts[c]) / sum(counts[c]) if sum(counts[c]) else 1.0
        goal = max(left(0, least), left(1, least))
        off = {}
        for c in (0, 1):
            low, high = least, max([*counts[0], *counts[1], 0]) + least
            while high - low > 1e-10 and left(c, least) < goal:
                low, high = ((low + high) / 2, high) if left(c, (low + high) / 2) < goal else (low, (low + high) / 2)
            off[c] = least if left(c, least) >= goal else high
        return off, goal

    every = sum(sum(a.values()) for a in apart.values())
    shared = {w: (apart[0][w] + apart[1][w] + 1) / (every + len(vocabulary) + 1) for w in vocabulary} | {None: 1 / (every + len(vocabulary) + 1)}
    off, spare = shares([list(apart[c].values()) for c in (0, 1)], toxicity.DISCOUNT)
    uni = lambda c, w: (max(apart[c].get(w, 0) - off[c], 0) / max(sum(apart[c].values()), 1) if w is not None else 0) + spare * shared[w]
    contexts = {v: shares([[n for g, n in count[c].items() if g[0] == v] for c in (0, 1)], toxicity.PAIR_DISCOUNT) for v in vocabulary}

    def p(c, v, w):
        if v not in contexts:
            return uni(c, w)
        away, left = contexts[v]
        seen = sum(n for g, n in count[c].items() if g[0] == v)
        return max(count[c].get((v, w), 0) - away[c], 0) / max(seen, 1) + left * uni(c, w)

    return vocabulary, p


def test_toxicity_models_sum_to_one_and_equal_plain_ones(monkeypatch):
    import pyarrow as pa

    from cairn.llm.textbytes import column_bytes

    monkeypatch.setattr(toxicity, "DISCOUNT", 1.5)
    monkeypatch.setattr(toxicity, "PAIR_DISCOUNT", 0.8)
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefghij"[: 10 - 3 * (k % 3 == 0)]) for _ in range(rng.randrange(1, 30))) for k in range(40)]
    y = np.array([int(k % 3 == 0) for k in range(40)])
    w, b, first = toxicity.words(*column_bytes(pa.array(texts)))
    before = np.concatenate([[np.uint64(1)], w[:-1]])
    before[first[:-1]] = 1
    model = toxicity.estimate(w, b, before, np.repeat(y, np.diff(first)))
    assert len(model["pair"]) > 20
    vocabulary, p = plain_kneser_ney(texts, y.tolist())
    got = toxicity.probabilities(model, w, b, first)
    k = 0
    for text in texts:
        v = ""
        for x in text.split():
            assert np.allclose(got[k], [p(0, v, x), p(1, v, x)], atol=1e-8)
            k, v = k + 1, x
    for v in [*vocabulary, "unseen"]:
        for c in (0, 1):
            assert abs(sum(p(c, v, x) for x in [*vocabulary, None]) - 1) < 1e-8
    n = np.diff(first)
    r = np.log(got[:, 1]) - np.log(got[:, 0])
    x = toxicity.evidence(got, first)
    for i in range(len(texts)):
        own = r[first[i] : first[i + 1]]
        worst = [max(own[a : a + z].mean() for a in range(len(own) - z + 1)) if len(own) >= z else own.mean() for z in toxicity.WINDOWS]
        assert np.allclose(x[i], [own.mean(), *worst, np.log1p(n[i])])


def test_rows_without_id_and_repeated_ids_are_scored_alike(spark):
    rows = [(None, "a b"), (None, "a b"), (4, "a b"), (4, "c"), (4, "c"), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(4, 1, 1), (4, 0, 0), (8, 0, 0), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    for f in (quality.quality, toxicity.toxicity):
        one, two = (sorted(map(str, f(d, labels).collect())) for d in (docs, docs.repartition(1)))
        assert one == two and len(one) == 6
        assert all(not r.held_out for r in f(docs, labels).collect() if r.doc_id is None)
    assert {(r.doc_id, r.held_out) for r in langid.language(docs.selectExpr("*", "'x' as lang")).collect()} >= {(None, False)}


def test_warc_round_trip(spark, tmp_path):
    rows = [(3, "u", "same"), (1, None, "same"), (2, "u\r\nx", None), (7, "u", ""), (5, "u", "é\r\n\r\nWARC/1.1\r\n" * 3), (9, "u", "y" * 3_000_000)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, payload_bytes int")
    got = {r.page_id: r for r in warc.archive(pages, str(tmp_path / "w")).collect()}
    for i, _, html in rows:
        body = (html or "").encode()
        import base64

        assert (got[i].payload_bytes, got[i].payload_digest) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {1: ("response", None), 3: ("revisit", 1), 2: ("response", None), 7: ("revisit", 2), 5: ("response", None), 9: ("response", None)}
    back = {r.page_id: r.payload for r in warc.read(spark, str(tmp_path / "w")).where("record_type = 'response' and payload_bytes < 100").collect()}
    assert bytes(back[5]).decode() == rows[4][2] and set(back) == {1, 2, 5}
    plan = warc.read(spark, str(tmp_path / "w"), payload=False).where("page_id = 5")
    assert [r.payload for r in plan.collect()] == [None]
    assert warc.archive(pages.limit(0), str(tmp_path / "e")).count() == 0


def test_fingerprints(spark, edge, empty, docs, monkeypatch):
    """Every column against plain Python on whole tables, in one bucket and in many."""
    import xxhash

    def h(value, seed):
        # Spark's xxhash64 chains its columns through the seed
        return xxhash.xxh64_intdigest(value, seed)

    def long_hash(x, seed):
        return h(struct.pack("<q", x), seed)

    def plain(text):
        w = [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if x] or [text]
        best = [None] * fingerprint.SAMPLES
        for x in set(w):
            term = h(x.encode(), 42)
            signed = term - (1 << 64) if term >> 63 else term
            log_weight = float(np.log(w.count(x)))
            for k in range(fingerprint.SAMPLES):
                z = h(struct.pack("<i", k), long_hash(signed, 42))
                unit = lambda shift, bits: ((z >> shift & (1 << bits) - 1) + 0.5) / (1 << bits)  # noqa: E731, B023
                r, b, c = -np.log(unit(56, 8) * unit(48, 8)), unit(40, 8), -np.log(unit(20, 20) * unit(0, 20))
                t = int(np.floor(log_weight / r + b))
                name = (term & 0xFFFFFFFF) + t * 2654435761 & 0xFFFFFFFF
                value = int((np.log(c) - r * (t - b + 1) + 100) * 16777216) << 32 | name
                best[k] = value if best[k] is None else min(best[k], value)
        return "".join(f"{x & 0xFFFFFFFF:08X}" for x in best)

    def mark(text):
        x = h(text.encode(), 42)
        return x - (1 << 64) if x >> 63 else x

    odd = spark.createDataFrame([(None, "a b"), (None, "c"), (7, "x y z"), (7, "p q"), (7, "x y z"), (3, None)], "doc_id long, text string")
    for table, size in ((edge, 4 << 20), (docs, 4 << 20), (docs, 30_000), (odd, 10)):
        monkeypatch.setattr(fingerprint, "BUCKET_BYTES", size)
        monkeypatch.setattr(fingerprint, "ROOT_BYTES", 0)
        rows = sorted(((r.doc_id if r.doc_id is not None else -(1 << 63), mark(r.text or ""), r.text or "", r.doc_id) for r in table.collect()), key=lambda r: r[:3], reverse=True)
        want, prints = [], {}
        for k, (_, _, t, i) in enumerate(rows):
            n, half = rows[(k + 1) % len(rows)][2], len(t) // 2
            edited = t[: len(t) - half] + n[:half]
            f, g, e = (prints.setdefault(x, plain(x)) for x in (t, n, edited))
            same = lambda x, y: sum(x[j : j + 8] == y[j : j + 8] for j in range(0, len(x), 8)) / fingerprint.SAMPLES
            want.append((str(i), len(t), hashlib.sha256(edited.encode()).hexdigest(), f, e, same(f, e), same(f, g)))
        got = [(str(r.doc_id), *tuple(r)[1:]) for r in fingerprint.fingerprints(table).collect()]
        assert [x[:3] for x in sorted(got)] == [x[:3] for x in sorted(want)]
        close = sum(a == b for a, b in zip(sorted(got), sorted(want), strict=True))
        assert close >= 0.99 * len(want)  # a logarithm's last bit may turn a sample
    assert fingerprint.fingerprints(empty).count() == 0


def test_collision_rate_is_generalised_jaccard(spark):
    rng = random.Random(8)
    errors = []
    pairs = []
    for k in range(60):
        a = [f"t{rng.randrange(40)}" for _ in range(120)]
        b = [x if rng.random() > 0.3 else f"t{rng.randrange(40)}" for x in a]
        pairs.append((a, b))
    rows = [(2 * k + 1 - s, " ".join(p[s])) for k, p in enumerate(pairs) for s in (0, 1)]
    out = {r.doc_id: r.near_next for r in fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, (a, b) in enumerate(pairs):
        terms = set(a) | set(b)
        want = sum(min(a.count(t), b.count(t)) for t in terms) / sum(max(a.count(t), b.count(t)) for t in terms)
        errors.append(out[2 * k + 1] - want)
    assert abs(np.mean(errors)) < 0.04 and np.std(errors) < 0.13


def test_decontamination_against_brute_force(spark, edge, empty, docs):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = {r.item_id: words(r.text, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+") for r in bench.collect()}
    want = set()
    for r in docs.collect():
        body = " " + " ".join(words(r.text, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")) + " "
        want |= {(r.doc_id, i) for i, w in items.items() if " " + " ".join(w) + " " in body}
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(docs, bench).collect()}
    assert want and len(want & got) / len(want) >= 0.9
    assert len({d for d, _ in got} - {d for d, _ in want}) <= 2
    assert decontam.leaks(empty, bench).count() == 0 and decontam.leaks(edge, bench.limit(0)).count() == 0
    assert decontam.leaks(edge, bench).count() == 0


def pairs_by_rule(docs, items):
    """(doc, item) that count by the longest common subsequence around some passage, without any search."""
    want = set()
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    texts = {d: words(text, pattern) for d, text in docs}
    sets = [set(w) for w in texts.values()]
    for i, t in items:
        x, y = (words(z, pattern) for z in (t, decontam.answer_of(t)))
        idf = {v: np.log((len(docs) + 1) / (sum(v in s for s in sets) + 1)) + 0.3 for v in x}
        for d, w in texts.items():
            for b in range(0, max(len(w) - decontam.PASSAGE, 0) + decontam.STRIDE, decontam.STRIDE):
                near = w[max(b - len(x), 0) : b + decontam.PASSAGE + len(x)]
                masks: dict[str, int] = {}
                for k, v in enumerate(near):
                    masks[v] = masks.get(v, 0) | 1 << k
                lcs = decontam.common(x, masks, len(near)) / len(x)
                shared = sum(idf[v] for v in idf if v in masks)
                told = shared >= decontam.NATS + np.log(len(docs) + 1) and shared >= decontam.TOLD * sum(idf.values())
                if lcs >= 0.8 or lcs >= 0.6 and (told or decontam.common(y, masks, len(near)) / len(y) >= 0.6):
                    want.add((d, i))
    return want


def test_decontamination_finds_reordered_and_reworded_items(spark, docs):
    rng = random.Random(13)
    vocabulary = [f"r{k}" for k in range(4000)]
    usual = ["the", "of", "and", "to", "a", "in"]
    sentence = lambda: " ".join(rng.choice(usual) if rng.random() < 0.4 else rng.choice(vocabulary) for _ in range(rng.randrange(9, 14)))
    items = [(i, f"{sentence()}. {sentence()}. {sentence()}.") for i in range(60)]
    noise = lambda n: " ".join(rng.choice(usual) if rng.random() < 0.4 else rng.choice(vocabulary) for _ in range(n))

    def reworded(text, share):
        return " ".join(w if rng.random() > share else rng.choice(vocabulary) for w in text.split())

    rows, kinds = [], {}
    for i, text in items:
        parts = text.split(". ")
        for kind, copy in enumerate((text, reworded(text, 0.2), ". ".join([parts[1], parts[0], parts[2]]), reworded(". ".join([parts[1], parts[0], parts[2]]), 0.1))):
            kinds[len(rows)] = kind, i
            rows.append((len(rows), f"{noise(rng.randrange(200))} {copy} {noise(rng.randrange(200))}"))
    rows += [(1000 + k, noise(300)) for k in range(300)]
    got = {(r.doc_id, r.item_id): r for r in decontam.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    for kind in range(4):
        of = [(d, i) for d, (k, i) in kinds.items() if k == kind]
        assert sum(x in got for x in of) >= 0.9 * len(of), kind
    assert set(got) <= {(d, i) for d, (_, i) in kinds.items()}
    assert sum(r.cosine >= decontam.COSINE for r in got.values()) >= 0.9 * len(got)  # the latent search alone


def test_decontamination_of_odd_rows(spark):
    item = "one two three four five six seven eight nine ten"
    bench = spark.createDataFrame([(1, item), (1, "alpha beta gamma delta epsilon zeta eta theta iota"), (2, "cat"), (None, item + " eleven"), (3, None), (4, "?!")], "item_id long, text string")
    rows = [(None, f"x {item} y", "s"), (5, f"x {item} y", "s"), (5, "the cat sat", None), (6, None, None), (7, "alpha beta gamma delta epsilon zeta eta theta iota", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, cosine string")
    got = sorted(str((r.doc_id, r.item_id, r.lcs >= 0.9)) for r in decontam.leaks(docs, bench).collect())
    assert got == sorted(map(str, [(None, 1, True), (5, 1, True), (7, 1, True), (None, None, True), (5, None, True)]))
    left = decontam.without_leaks(docs, bench)
    assert left.columns == docs.columns and sorted(map(str, map(tuple, left.collect()))) == sorted(map(str, [rows[2], rows[3]]))


def test_decontamination_finds_items_of_common_words(spark):
    rng = random.Random(6)
    usual, rare = [f"u{k}" for k in range(150)], [f"r{k}" for k in range(3000)]
    items = [(i, " ".join([*rng.sample(usual, 22 + i % 4), *rng.sample(rare, i % 4)])) for i in range(30)]
    bodies = [[rng.choice(usual) if rng.random() < 0.8 else rng.choice(rare) for _ in range(rng.randrange(20, 260))] for _ in range(240)]
    for k, body in enumerate(bodies[:90]):
        body[(at := rng.randrange(len(body))) : at] = items[k % 29][1].split()
    for body in bodies[100:220]:
        body[(at := rng.randrange(len(body))) : at] = items[29][1].split()  # a hot item
    docs = [(k, " ".join(b)) for k, b in enumerate(bodies)]
    want = pairs_by_rule(docs, items)
    assert {(k, k % 29) for k in range(90)} | {(k, 29) for k in range(100, 220)} <= want
    got = decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.where("lcs >= 0.6").collect()} == want and got.where("lcs < 0.6").isEmpty()


def test_decontamination_finds_paraphrases(spark):
    rng = random.Random(7)
    usual, rare = ["the", "of", "and", "to", "a"], [f"r{k}" for k in range(400)]
    items = [(i, " ".join(rng.choice(usual) if rng.random() < 0.6 else rng.choice(rare) for _ in range(rng.randrange(20, 60)))) for i in range(20)]
    docs = []
    for k in range(160):
        copy = [w if w in usual or rng.random() < 0.4 else f"x{rng.randrange(99)}" for w in items[k % 20][1].split()]
        docs.append((k, " ".join([*(f"y{rng.randrange(99)}" for _ in range(rng.randrange(90))), *copy, *(f"z{rng.randrange(99)}" for _ in range(rng.randrange(90)))])))
    want = pairs_by_rule(docs, items)
    got = decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert len(want) > 80 and {(r.doc_id, r.item_id) for r in got.where("lcs >= 0.6").collect()} == want


def test_lcs_by_bits():
    rng = random.Random(4)
    for _ in range(100):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 30))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        masks: dict[int, int] = {}
        for k, w in enumerate(b):
            masks[w] = masks.get(w, 0) | 1 << k
        assert decontam.common(a, masks, len(b)) == t[-1][-1]


def test_pipeline_stages(spark, docs):
    import corpus_pipeline as p

    odd = spark.createDataFrame([(None, "a b c d e f"), (7, "a b c d e f"), (8, "a b c d e f"), (8, "a b c d e f"), (9, None)], "doc_id long, text string")
    assert sorted(map(str, (r.doc_id for r in p.near_dedup(spark, odd, SF).collect()))) == ["7", "9", "None"]
    out = docs
    for k, (name, stage) in enumerate(p.STAGES):
        before, columns = out.count(), out.columns
        out = stage(spark, out, SF).cache()
        assert 0 < out.count() <= before, name
        assert out.columns == columns or k == len(p.STAGES) - 1
        empty = stage(spark, docs.limit(0), SF)
        assert empty.count() == 0
    assert out.where("not exact").count() == 0
    assert struct.calcsize("i") == 4


def test_language_stage_drops_unlike_texts(spark, docs):
    import corpus_pipeline as p

    rng = random.Random(9)
    sets = ["abcdefghijklmnopqrstuvwxyz", "bcdfghjklmnpqrstvwxz", "αβγδεζηθικλμνξοπρστυφχψω", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "".join(chr(0x4E00 + i) for i in range(3000))]
    odd = [(10_000 + k, " ".join("".join(rng.choice(sets[k % 5]) for _ in range(rng.randrange(2, 9))) for _ in range(150))) for k in range(100)]
    table = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(*r, None) for r in odd], "doc_id long, text string, lang string"))
    left = {r.doc_id for r in p.by_language(spark, table, SF).collect()}
    assert left == {r.doc_id for r in docs.collect() if re.search(r"[^\W\d_]", r.text or "")}


def test_license_rules_fire_on_their_bare_phrases(spark):
    def bare(tree):
        """The shortest text of a parsed pattern, by its first choices."""
        out = ""
        for op, arg in tree:
            name = str(op)
            if name in ("LITERAL", "IN", "ANY"):
                out += "x" if arg is None else chr(arg) if name == "LITERAL" else chr(arg[0][1])
            elif name in ("SUBPATTERN", "BRANCH"):
                out += bare(arg[3] if name == "SUBPATTERN" else arg[1][0])
            elif "REPEAT" in name:
                out += bare(arg[2]) * arg[0]
        return out

    phrases = [(label, bare(re._parser.parse(pattern))) for _, label, _, pattern, _ in license.rules()]
    phrases += [("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"), ("zlib", "altered source versions must be plainly marked as such")]
    phrases += [("bsd-3-clause", "BSD 3-Clause"), ("0bsd", "0BSD"), ("0bsd", "zero clause BSD"), ("mit-0", "MIT-0"), ("cecill-2.1", "CeCILL 2.1"), ("apache-2.0", "Apache 2.0")]
    phrases += [("public-domain", "placed in the public domain"), ("gpl", "redistribute it and/or modify it under the terms of the GNU General Public License")]
    rows = [(k, x) for k, (_, x) in enumerate(phrases)]
    found = {r.doc_id: r.labels for r in license.licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [x for k, x in enumerate(phrases) if not found[k]] == []
    assert [x for k, x in enumerate(phrases) if k >= len(phrases) - 10 and x[0] not in found[k].split(",")] == []


def test_warc_keeps_pages_without_page_id(spark, tmp_path):
    rows = [(None, "u", "same"), (None, "v", "same"), (4, "w", "same"), (6, "w", "same"), (None, None, None)]
    out = warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "w")).collect()
    assert sorted((str(r.page_id), r.payload_bytes, r.record_type, r.refers_to) for r in out) == [("4", 4, "response", None), ("6", 4, "revisit", 4), ("None", 0, "response", None), ("None", 4, "response", None), ("None", 4, "response", None)]


def test_warc_reads_foreign_records(spark, tmp_path):
    record = lambda kind, length, block: f"WARC/1.0\r\nWARC-Type: {kind}\r\n{length}\r\n{block}\r\n\r\n".encode()
    http = "HTTP/1.1 200 OK\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(
        record("warcinfo", "", "software: x") + record("response", f"Content-Length: {len(http) + 3}\r\n", http + "abc") + b"WARC/1.0\r\nX-Odd: \xff\xfe\r\nWARC-Type: response\r\n\r\n" + (http + "no length\r\n\r\nmore").encode() + b"\r\n\r\n" + record("metadata", "Content-Length: 1\r\n", "m")
    )
    got = [(r.record_type, r.payload and bytes(r.payload)) for r in warc.read(spark, str(tmp_path)).collect()]
    assert got == [("warcinfo", None), ("response", b"abc"), ("response", b"no length\r\n\r\nmore"), ("metadata", None)]


def test_warc_without_broadcast_is_the_same(spark, tmp_path, monkeypatch):
    rows = [(k, "u", f"page {k % 7}") for k in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    one = sorted(map(tuple, warc.archive(pages, str(tmp_path / "a")).collect()))
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", 0)
    assert one == sorted(map(tuple, warc.archive(pages, str(tmp_path / "b")).collect())) and len(one) == 60


def test_licenses_and_pieces_of_rows_without_id_and_repeated_ids(spark):
    rows = [(None, "MIT License"), (None, "MIT License"), (3, "GPL v3"), (3, "BSD 3-Clause"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = sorted(str((r.doc_id, r.labels)) for r in license.licenses(docs).collect())
    assert got == sorted(map(str, [(None, "mit"), (None, "mit"), (3, "gpl-3.0"), (3, "bsd-3-clause"), (3, "")]))
    got = sorted(str((r.doc_id, bytes(r.decoded).decode(), r.exact)) for r in sentencepiece.encode(docs, MODEL).collect())
    assert got == sorted(str((d, t or "", True)) for d, t in rows)


def test_decontamination_space_is_that_of_all_items():
    """The latent space is that of an exact SVD of every item, whatever the documents; up to its rank it holds all of them."""
    random = np.random.Generator(np.random.PCG64(4))
    for n in (40, 400):
        it = decontam.Items(list(range(n)), [" ".join(f"w{k}" for k in random.zipf(1.3, 30) % 900) for _ in range(n)])
        idf = random.random(len(it.vocabulary)) * 5 + 0.3
        it.count(np.ones(len(it.vocabulary)), 10)
        a = np.zeros((n, decontam.FEATURES))
        for i, t in enumerate(it.terms):
            np.add.at(a[i], it.feature[t], idf[t])
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        space = decontam.latent_space(it, idf).astype(float)
        values = np.linalg.svd(a, compute_uv=False)[: decontam.LATENT]
        assert np.linalg.norm(a @ space) ** 2 >= 0.9999 * (values**2).sum()
        norms = np.linalg.norm(space, axis=0)
        assert np.allclose(norms[norms > 0], 1, atol=1e-4) and (n > decontam.LATENT or np.allclose(a @ space @ space.T, a, atol=1e-4))


def test_labelled_models_use_every_row(spark, monkeypatch):
    """No bound on rows or bytes: rows far beyond a part count, parts are averaged, and counts in buckets equal plain ones."""
    from cairn.llm import labelled

    rng = random.Random(8)
    docs = [(i, " ".join(rng.choice("abcdefghijklmnop"[: 16 - 2 * (i % 3 == 0)]) for _ in range(rng.randrange(0, 160)))) for i in range(300)]
    docs += [(1000 + i, f"only {'vile' if i % 2 else 'kind'} w{i}") for i in range(40)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    lab = spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i, _ in docs], "doc_id long, quality int, toxic int")

    monkeypatch.setattr(quality, "PART_ROWS", 50)
    rows = labelled.training_rows(d, lab, "quality", 4, 2)
    texts = sorted(r.text for r in rows.collect())

    def trainer(batches):
        own = [x for b in batches for x in b.column(b.schema.get_field_index("text")).to_pylist()]
        return {"w": np.array([len(own), sum(map(len, own))], dtype=np.float32)}

    parts = labelled.parts_of(rows, 50)
    got = labelled.fit(rows, trainer, 50)["w"] * parts
    assert parts > 3 and np.allclose(got, [len(texts), sum(map(len, texts))], rtol=1e-5)
    assert quality.train(d, lab)["w"].any()

    monkeypatch.setattr(toxicity, "BUCKET_BYTES", 1000)
    monkeypatch.setattr(toxicity, "HELD_WORDS", 100)
    rows = labelled.training_rows(d, lab, "toxic", 3, 1)
    model = toxicity.fitted(rows)
    own = rows.where(~toxicity._late()).orderBy("doc_id").collect()
    import pyarrow as pa

    from cairn.llm.textbytes import column_bytes

    w, b, first = toxicity.words(*column_bytes(pa.array([r.text for r in own])))
    before = np.concatenate([[np.uint64(1)], w[:-1]])
    before[first[:-1][np.diff(first) > 0]] = 1
    plain = toxicity.estimate(w, b, before, np.repeat([r.y for r in own], np.diff(first)))
    assert len(plain["pair"]) > 20 and len(model["word"]) < len(plain["word"])
    assert np.array_equal(model["pair"], plain["pair"]) and np.allclose(model["over"], plain["over"])
    w, b, first = toxicity.words(*column_bytes(pa.array([t for _, t in docs])))
    assert np.allclose(*(toxicity.evidence(toxicity.probabilities(m, w, b, first), first) for m in (model, plain)))
