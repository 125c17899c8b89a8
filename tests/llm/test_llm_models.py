"""Language identification, toxicity and quality: held-out accuracy and brute-force checks."""
from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from vintage.llm import langid, quality, toxicity
from vintage.llm.queries import QUERIES

SF2 = "/root/testdata/sf0.01"


def brute_kn(texts, order):
    """Interpolated Kneser-Ney by dictionaries: p(char | context)."""
    top = Counter()
    for t in texts:
        s = " " * (order - 1) + t
        top.update(s[i:i + order] for i in range(len(s) - order + 1))
    counts = {order: top}
    for n in range(order - 1, 0, -1):
        left = defaultdict(set)
        for g in {h[-n - 1:] for h in counts[n + 1]}:
            left[g[1:]].add(g[0])
        counts[n] = Counter({g: len(x) for g, x in left.items()})
    disc = {}
    for n, c in counts.items():
        n1, n2 = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        disc[n] = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    alphabet = {g for g in counts[1]}

    def p(g, n):
        if n == 0:
            return 1 / (len(alphabet) + 1)
        own = {h: v for h, v in counts[n].items() if h[:-1] == g[-n:-1]}
        total = sum(own.values())
        low = p(g, n - 1)
        if not total:
            return low
        return max(own.get(g[-n:], 0) - disc[n], 0) / total + disc[n] * len(own) / total * low

    return p


def models_of(texts_by_lang, order):
    langs = sorted(texts_by_lang)
    floor = langid.floor_of(len(set("".join(t for x in texts_by_lang.values() for t in x)) | {" "}))
    models = []
    for k in langs:
        c = Counter()
        for t in texts_by_lang[k]:
            s = " " * (order - 1) + t
            c.update(s[i:i + order] for i in range(len(s) - order + 1))
        grams = np.array([[ord(x) for x in g] for g in c], np.uint32)
        models.append(langid.fit_language(grams, np.array(list(c.values())), order, floor))
    return langid.CharModels(langs, order, models, floor)


def test_kneser_ney_equals_dictionaries():
    texts = {"a": ["abra cadabra abba", "cab bad dab"]}
    order = 3
    m, p = models_of(texts, order), brute_kn(texts["a"], order)
    for t in ["abracab", "zab", "dddd a", "q"]:
        s = " " * (order - 1) + t
        want = -np.mean([np.log(p(s[i:i + order], order)) for i in range(len(t))])
        got = m.cross_entropies([np.array([ord(c) for c in t], np.uint32)])[0, 0]
        assert got == pytest.approx(want, rel=1e-5)


def test_two_languages_keep_their_own_probabilities():
    texts = {"a": ["abra cadabra abba"], "b": ["xyz zyx yx", "abx"]}
    m = models_of(texts, 3)
    for k, lang in enumerate(m.langs):
        # the floor counts the characters of all languages
        alone = models_of({lang: texts[lang]}, 3)
        alone.floor = m.floor
        t = np.array([ord(c) for c in ("abra" if lang == "a" else "zyx")], np.uint32)
        assert m.cross_entropies([t])[0, k] <= m.cross_entropies([t])[0, 1 - k]


def test_blocks_do_not_change_scores(monkeypatch):
    m = models_of({"a": ["abra cadabra abba"], "b": ["xyz zyx yx"]}, 4)
    texts = [np.array([ord(c) for c in s], np.uint32) for s in ("abra xyz " * 30, "a", "zyx" * 50)]
    whole = m.cross_entropies(texts)
    monkeypatch.setattr(langid, "_BLOCK", 7)
    assert np.allclose(m.cross_entropies(texts), whole)


def test_letters():
    assert "".join(map(chr, langid.letters_of("Ab, 1c!\nÉ"))) == "ab c é"
    assert len(langid.letters_of("12 !?")) == 0 and len(langid.letters_of("")) == 0


def test_sorted_hashes_find():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2 ** 63, 5000, dtype=np.uint64) * np.uint64(2))
    s = langid.SortedHashes(keys)
    probe = np.concatenate([keys, keys + np.uint64(1)])
    row = s.find(probe)
    assert (row[:len(keys)] == np.arange(len(keys))).all() and (row[len(keys):] == -1).all()


def test_representatives():
    rng = np.random.default_rng(2)
    for h in (np.zeros(0, np.uint64), np.array([7], np.uint64), rng.integers(0, 50, 3000, dtype=np.uint64),
              rng.integers(0, 900, 5000, dtype=np.uint64) * langid._MULT):
        at, of = langid._representatives(h)
        assert len(of) == len(h) and (h[at][of] == h).all()


def test_language_held_out(spark, documents):
    out = QUERIES["op2_language_id"](spark, SF2)
    j = out.join(documents.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(j) > 100
    assert np.mean([r.lang == r.lang_pred for r in j]) > 0.97
    assert all(0 <= r.score <= 1 for r in j)
    assert np.mean([r.accepted for r in j]) > 0.99  # clean documents stay


def test_language_edge_cases(edge_docs, no_docs, documents):
    m = langid.train(documents.select("doc_id", "text", "lang"))
    got = langid.identify(edge_docs, m).collect()
    assert len(got) == edge_docs.count()
    for r in got:
        if r.doc_id in (3, 4, 5, 9):
            assert (r.lang_pred, r.score, r.accepted) == ("und", 0.0, False)
        assert r.held_out == (r.doc_id is not None and __import__("zlib").crc32(str(r.doc_id).encode()) % 5 == 0)
    assert {r.lang_pred for r in got if r.doc_id == 7} == {"fr"}
    assert langid.identify(no_docs, m).count() == 0
    noise = edge_docs.sparkSession.createDataFrame([(1, "ЖЩЮ ъыь эюя цчш " * 40, "x")], "doc_id long, text string, lang string")
    assert langid.drop_rejected(noise, m).count() == 0  # an unknown language goes
    assert langid.drop_rejected(edge_docs, m).columns == edge_docs.columns


def test_language_models_from_tasks_equal_dictionaries(spark):
    texts = {"a": ["abra cadabra abba", "cab bad dab"], "b": ["xyz zyx yx", "abx"]}
    rows = [(k, t) for k in texts for t in texts[k]]
    learn = spark.createDataFrame(rows, "lang string, text string")
    chars = learn.select("text").mapInArrow(langid._alphabet, "code long").distinct().count()
    assert chars == len(set("".join(t for _, t in rows)))
    floor, want = langid.floor_of(chars), models_of(texts, 3)
    got = {(r.lang, r.level): r for r in learn.groupBy("lang").applyInArrow(langid._fit_task(3, floor), (
        "lang string, level int, keys binary, logp binary, contexts binary, logw binary")).collect()}
    assert floor == want.floor and len(got) == 6
    for k, lang in enumerate(want.langs):
        for n in range(3):
            r, m = got[lang, n], want.models[k]
            assert (np.frombuffer(r.keys, np.uint64) == m.grams[n].keys).all()
            assert np.allclose(np.frombuffer(r.logp, np.float32), m.logp[n])
            assert (np.frombuffer(r.contexts, np.uint64) == m.contexts[n].keys).all()
            assert np.allclose(np.frombuffer(r.logw, np.float32), m.logw[n])


def test_rejection_follows_its_rate():
    rng = np.random.default_rng(3)
    zs = rng.exponential(1.0, 200_000)
    for rate in (0.3, 0.1, 0.01, 1e-3):
        assert np.mean(zs > langid._tail_bound(zs, rate)) == pytest.approx(rate, rel=0.15)
    bounds = [langid._tail_bound(zs[:300], r) for r in (0.2, 0.05, 1e-3, 1e-5)]
    assert bounds == sorted(bounds) and langid._tail_bound(zs, 0) == np.inf


def test_text_of_no_known_language_goes(spark, documents):
    docs = documents.select("doc_id", "text", "lang")
    m = langid.train(docs)
    rng = np.random.default_rng(0)
    letters = "abcdefghijklmnopqrstuvwxyz"
    some = [r.text for r in docs.filter("lang = 'en'").orderBy("doc_id").limit(20).collect()]
    junk = ["dzieci bawily sie wczoraj w ogrodzie a ich rodzice pili kawe i rozmawiali o pogodzie oraz pracy " * 2,
            "lapset leikkivat eilen puutarhassa samalla kun heidan vanhempansa joivat kahvia ja puhuivat saasta " * 2,
            "cocuklar dun bahcede oynarken anne babalari iceride kahve icip hava durumu hakkinda konusuyorlardi " * 2,
            "asdfgh qwerty zxcvbn asdf hjkl qwer uiop zxcv bnm asdfg hjkl qwert yuiop zxcvb nm asd fgh jkl qwe rty",
            "".join(rng.choice(list(letters + " "), 400)), "".join(rng.permutation(list(some[0][:400])))]
    clean = some + ["the", "hello there", "a b"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(junk + clean)], "doc_id long, text string")
    assert {r.doc_id for r in langid.drop_rejected(d, m).collect()} == set(range(len(junk), len(junk) + len(clean)))
    assert langid.drop_rejected(docs.filter("lang is not null"), m).count() == docs.filter("lang is not null").count()
    tight = langid.train(docs, reject_rate=0.2)
    assert (tight.z < m.z).all()
    gone = 1 - langid.drop_rejected(docs, tight).count() / docs.count()
    assert 0.03 < gone < 0.35  # about the rate that was asked for


def test_language_without_labels(no_docs, edge_docs):
    m = langid.train(no_docs)
    assert {r.lang_pred for r in langid.identify(edge_docs, m).collect()} == {"und"}


def test_toxicity_held_out(spark):
    out = QUERIES["op3_toxicity"](spark, SF2)
    labels = spark.read.parquet(f"{SF2}/labels.parquet")
    j = out.join(labels, "doc_id").collect()
    held = [r for r in j if r.held_out]
    assert len(held) > 50
    assert np.mean([r.predicted == r.toxic for r in held]) > 0.95
    assert np.mean([r.predicted == r.toxic for r in j]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in j)


def test_noisy_or_and_offending_sentences():
    texts = [f"this is a fine day number {i} here. we like the sun and rain." for i in range(60)]
    bad = [f"this is a fine day number {i} here. you are such a zork today friend. we like rain and sun." for i in range(30)]
    w, b = toxicity.fit(texts + bad, np.array([0] * 60 + [1] * 30), 1 / 3)
    s = toxicity.SentenceScorer(w, b)
    assert min(map(s.score, bad)) > 0.5 > max(map(s.score, texts))
    assert [x for x, _ in s.offending(bad[0])] == ["you are such a zork today friend."]
    p = [1 / (1 + np.exp(-s._logit(ws))) for _, _, ws in toxicity.sentences(bad[0])]
    assert s.score(bad[0]) == pytest.approx(1 - np.prod([1 - x for x in p]))


def brute_noisy_or(texts, y, share, steps, rate=1.0, l1=0.1):
    """The same descent with a gradient by finite differences of the stated loss, feature by feature."""
    docs = [[[list(toxicity.word_features(w)) for w in ws] for _, _, ws in toxicity.sentences(t)] for t in texts]
    feats = sorted({int(f) for d in docs for s in d for w in s for f in w})
    weight = [share / np.mean(y) / len(y) if v else (1 - share) / (1 - np.mean(y)) / len(y) for v in y]

    def loss(w, b):
        total = 0.0
        for d, v, k in zip(docs, y, weight):
            none = 1.0
            for s in d:
                z = b + sum(w[int(f)] for fs in s for f in fs)
                none *= 1 - 1 / (1 + np.exp(-z))
            total -= k * np.log(1 - none if v else none)
        return total

    w, b, g2, gb2 = {f: 0.0 for f in feats}, -5.0, {f: 1e-8 for f in feats}, 1e-8
    cut = l1 * max(k for k, v in zip(weight, y) if v)
    for _ in range(steps):
        e, g = 1e-5, {}
        for f in feats:
            g[f] = (loss({**w, f: w[f] + e}, b) - loss({**w, f: w[f] - e}, b)) / (2 * e)
        gb = (loss(w, b + e) - loss(w, b - e)) / (2 * e)
        for f in feats:
            g2[f] += g[f] ** 2
            step = rate / np.sqrt(g2[f])
            w[f] = max(w[f] - step * g[f] - step * cut, 0)
        gb2 += gb ** 2
        b -= rate * gb / np.sqrt(gb2)
    return w, b


def test_noisy_or_training_equals_finite_differences():
    texts = ["we like the sun today friends. you are such a zork friends.", "we like the sun today friends. the rain is fine today.",
             "the rain is fine today. we like such a day friends.", "such a zork you are today. the sun is fine."]
    y = np.array([1, 0, 0, 1])
    w, b = toxicity.fit(texts, y, 0.4, steps=4)
    want, want_b = brute_noisy_or(texts, y, 0.4, 4)
    assert b == pytest.approx(want_b, rel=1e-3)
    assert any(v > 0.1 for v in want.values())
    for f, v in want.items():
        assert w[f] == pytest.approx(v, rel=1e-3, abs=1e-3)
    assert np.count_nonzero(w) == sum(v > 0 for v in want.values())


def test_toxicity_query_equals_brute_force_noisy_or(spark, documents):
    labels = spark.read.parquet(f"{SF2}/labels.parquet")
    scorer = toxicity.train(documents, labels)
    weights, bias = np.asarray(scorer.weights, float), scorer.bias
    texts = {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}
    got = QUERIES["op3_toxicity"](spark, SF2).collect()
    assert len(got) == documents.count()
    for r in got:
        none = 1.0
        for _, _, ws in toxicity.sentences(texts[r.doc_id] or ""):
            z = bias + sum(float(weights[f]) for w in ws for f in toxicity.word_features(w))
            none *= 1 - 1 / (1 + np.exp(-z))
        assert r.score == pytest.approx(1 - none, abs=1e-6) and r.predicted == int(r.score >= 0.3)


def test_toxicity_edge_cases(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(1, 0), (1, 1), (3, None), (7, 1), (8, 0), (None, 1)], "doc_id long, toxic int")
    scorer = toxicity.train(edge_docs, labels)
    got = toxicity.scores(edge_docs, scorer).collect()
    assert len(got) == edge_docs.count()
    assert {r.score for r in got if r.doc_id in (3, 4, 5)} == {0.0}
    assert toxicity.scores(no_docs, scorer).count() == 0
    none = toxicity.train(no_docs, labels.limit(0))
    assert {r.score for r in toxicity.scores(edge_docs, none).collect()} == {0.0}


def test_em_finds_accuracies():
    rng = np.random.default_rng(5)
    n, right_bad = 20_000, np.linspace(0.3, 0.8, len(quality.LABELLERS))
    good = rng.random(n) < 0.8
    v = np.where(good[:, None], rng.random((n, len(right_bad))) < 0.95, rng.random((n, len(right_bad))) > right_bad)
    votes = ["".join("1" if x else "0" for x in r) for r in v]
    c = Counter(votes)
    m = quality.estimate(list(c), np.array(list(c.values()), float))
    assert m.prior == pytest.approx(0.8, abs=0.03)
    assert np.allclose(m.right_bad, right_bad, atol=0.06) and np.allclose(m.right_good, 0.95, atol=0.03)


def test_em_equals_enumeration_by_document():
    """EM over patterns against EM over single documents, with products of probabilities in place of matrices."""
    rng = np.random.default_rng(8)
    k = len(quality.LABELLERS)
    votes = ["".join(rng.choice(list("10-"), k, p=[0.5, 0.2, 0.3])) for _ in range(60)] + ["1" * k] * 40
    c = Counter(votes)
    m = quality.estimate(list(c), np.array(list(c.values()), float), steps=12)
    tg, tb, prior = [0.99] * k, [0.3] * k, 0.8
    for _ in range(12):
        post = []
        for v in votes:
            pg, pb = prior, 1 - prior
            for j, x in enumerate(v):
                if x != "-":
                    pg *= tg[j] if x == "1" else 1 - tg[j]
                    pb *= 1 - tb[j] if x == "1" else tb[j]
            post.append(pg / (pg + pb))
        for j in range(k):
            said = [(p, v[j]) for p, v in zip(post, votes) if v[j] != "-"]
            right_good = sum(p for p, x in said if x == "1") + 9.9
            right_bad = sum(1 - p for p, x in said if x == "0") + 3
            tg[j] = min(max(right_good / (sum(p for p, _ in said) + 10), 0.02), 0.999)
            tb[j] = min(max(right_bad / (sum(1 - p for p, _ in said) + 10), 0.02), 0.999)
        prior = min(max((sum(post) + 8) / (len(votes) + 10), 0.01), 0.99)
    assert m.prior == pytest.approx(prior, abs=1e-9)
    assert np.allclose(m.right_good, tg) and np.allclose(m.right_bad, tb)
    assert all(m.posterior[v] == pytest.approx(p, abs=1e-9) for v, p in zip(votes, post))


def test_quality_against_labels(spark):
    out = QUERIES["op7_quality"](spark, SF2)
    labels = spark.read.parquet(f"{SF2}/labels.parquet")
    j = out.join(labels, "doc_id").collect()
    good = [r for r in j if r.quality == 1]
    bad = [r for r in j if r.quality == 0]
    assert np.mean([r.predicted for r in good]) > 0.98  # clean documents are kept
    assert np.mean([r.predicted for r in bad]) < 0.2


def test_quality_edge_cases(edge_docs, no_docs):
    model, scorer = quality.train(edge_docs)
    got = quality.scores(edge_docs, scorer).collect()
    assert len(got) == edge_docs.count() and all(0 <= r.score <= 1 for r in got)
    model, scorer = quality.train(no_docs)
    assert quality.scores(no_docs, scorer).count() == 0
    assert quality.votes(quality.measures("")) and len(quality.votes(quality.measures("a b"))) == len(quality.LABELLERS)
