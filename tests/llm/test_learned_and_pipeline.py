"""The quality classifier, language ID, and the stages of the pipeline."""

import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from chargeloom.llm import langid, quality, simhash, similar
from chargeloom.llm.queries import op8_quality, op9_langid

WORDS = {
    "en": "the of and house river walking nation thing with which water under".split(),
    "de": "der die und häuser fluss gehen nation dinge mit welche wasser unter".split(),
    "ru": "дом река люди время слово вода под который быть это год день".split(),
}


def document(rng, lang, many, junk=False):
    words = [rng.choice(WORDS[lang]) + (rng.choice(["ing", "heit", ""]) if lang != "ru" else "") for _ in range(many)]
    if junk:
        words = [w.upper() + "!!" for w in words]
    lines = [" ".join(words[i : i + 12]) + "." for i in range(0, len(words), 12)]
    return "\n".join(lines)


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder, rng = str(tmp_path_factory.mktemp("corpus")), random.Random(7)
    docs, labels = [], []
    for i in range(900):
        lang = rng.choice(["en", "en", "de", "ru"])
        junk = rng.random() < 0.25
        docs.append((i, document(rng, lang, rng.randrange(20, 120), junk), lang, "s", 0))
        if i % 2:
            labels.append((i, int(not junk), 0))
    docs += [(2000, None, "en", "s", 0), (2001, "", "de", None, None), (2002, "123 ... !!", "en", "s", 0), (None, "the house", None, "s", 0), (2003, "the river " * 30_000, "en", "s", 0)]
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    docs += [(3000, document(rng, "en", 60), "en", "s", 0), (3001, document(rng, "en", 80) + "\n" + passage, "en", "s", 0)]
    docs += [(3002, docs[-2][1], "en", "s", 0), (3000, docs[-2][1], "en", "s", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([*labels, (1, None, 0), (None, 1, 0), (99999, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, docs, labels


def held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 4 == 2


def test_quality_on_held_out_rows(spark, corpus):
    folder, docs, labels = corpus
    rows = op8_quality(spark, folder).collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert all(r.held_out == held_out(r.doc_id) for r in rows)
    got = {r.doc_id: r.predicted for r in rows}
    unseen = [(i, q) for i, q, _ in labels if held_out(i)]
    assert np.mean([got[i] == q for i, q in unseen]) > 0.95
    again = {(r.doc_id, r.score) for r in op8_quality(spark, folder).collect()}
    assert again == {(r.doc_id, r.score) for r in rows}


def test_quality_without_labels_or_negatives(spark, corpus):
    folder, _, _ = corpus
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    flat = quality.score_quality(docs, labels.limit(0)).select("score").distinct().collect()
    assert len(flat) == 1
    assert quality.score_quality(docs.limit(0), labels).count() == 0
    only = quality.train(docs, labels.filter("quality = 1"))
    assert 0.55 < only.prior < 0.95


def test_prior_and_risk():
    rng = np.random.default_rng(1)
    make = lambda n, m: rng.normal(m, 1, (n, quality._FEATURES))
    positives, unlabelled = make(1500, 1.0), np.concatenate([make(1200, 1.0), make(1800, -1.0)])
    prior = quality.estimate_prior(positives, unlabelled)
    assert abs(prior - 0.4) < 0.08
    model = quality.fit(positives, unlabelled, 0.4)
    assert (model.score(make(500, 1.0)) > 0.5).mean() > 0.95 and (model.score(make(500, -1.0)) > 0.5).mean() < 0.05
    assert quality.features(b"") == [0.0] * quality._SHARES and quality.features(b" \n") == [0.0] * quality._SHARES


def test_risk_and_gradient_by_plain_computation():
    """Both parts of the risk against sums written out, and the gradient against differences, on either side of zero."""
    rng = np.random.default_rng(2)
    n = quality._FEATURES
    weights = [rng.normal(0, 0.3, (n, 3)), rng.normal(0, 0.3, 3), rng.normal(0, 1, 3), rng.normal(0, 1, 1)]
    p, u = rng.normal(0.5, 1, (7, n)), rng.normal(-0.5, 1, (9, n))
    loss = lambda f: np.log1p(np.exp(-f))
    margin = lambda ws, x: np.tanh(x @ ws[0] + ws[1]) @ ws[2] + ws[3][0]
    for prior in (0.3, 0.99, 5.0):
        parts = lambda ws: (prior * loss(margin(ws, p)).mean(), loss(-margin(ws, u)).mean() - prior * loss(-margin(ws, p)).mean())
        positive, negative, grads = quality.risk(weights, p, u, prior)
        assert (positive, negative) == pytest.approx(parts(weights))
        aim = (lambda ws: sum(parts(ws))) if negative >= 0 else (lambda ws: -parts(ws)[1])
        for i, g in enumerate(grads):
            for at in [tuple(rng.integers(0, k) for k in g.shape) for _ in range(5)]:
                moved = [[w.copy() for w in weights] for _ in range(2)]
                moved[0][i][at] += 1e-6
                moved[1][i][at] -= 1e-6
                assert g[at] == pytest.approx((aim(moved[0]) - aim(moved[1])) / 2e-6, abs=1e-6)


def test_one_repeated_id_does_not_fill_the_sample(spark, corpus):
    folder, docs, labels = corpus
    hot = spark.createDataFrame([(5, f"text {i}") for i in range(5000)], "doc_id long, text string")
    table = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").union(hot)
    seen = []
    real, quality.fit = quality.fit, lambda p, u, prior: seen.append((len(p), len(u)))
    try:
        quality.train(table, spark.read.parquet(f"{folder}/labels.parquet"), prior=0.5, max_positives=50, max_unlabelled=100)
    finally:
        quality.fit = real
    assert seen[0][0] <= 50 and 90 <= seen[0][1] <= 100


def test_odd_columns_and_texts(spark, corpus):
    """Clashing columns are replaced, others stay; very long and empty texts have a score."""
    folder, _, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model, labels = quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet")), spark.read.parquet(f"{folder}/labels.parquet")
    odd = docs.limit(3).selectExpr("*", "1 as score", "'x' as predicted", "2 as language", "3 as _language", "4 as spans")
    assert set(quality.score_quality(odd, labels).columns) == set(odd.columns)
    found = langid.identify_languages(odd)
    assert set(found.columns) == set(odd.columns) and {r.spans for r in found.collect()} == {4}
    assert corpus_pipeline.keep_language(spark, odd, folder).columns == odd.columns
    import pyarrow as pa

    assert quality.feature_rows(pa.array(["", None, "the river " * 200_000, "a"])).shape == (4, quality._FEATURES)
    assert np.isfinite(model.score(quality.feature_rows(pa.array(["", "x" * 3_000_000])))).all()


def test_what_stands_for_a_number_is_no_letter(spark, corpus):
    odd = ["½ ² Ⅷ ① 五 x", "½ ² Ⅷ ①", "٣ ४ 12 _", "ª"]
    assert [langid.words_of(t) for t in odd] == [["五", "x"], [], [], ["ª"]]
    rows = spark.createDataFrame([(i, t, None) for i, t in enumerate(odd)], "doc_id long, text string, lang string").union(spark.read.parquet(f"{corpus[0]}/documents.parquet").select("doc_id", "text", "lang"))
    got = {r.text: r.language for r in langid.identify_languages(rows).collect() if r.text in odd}
    assert [got[t].lang == "und" for t in odd] == [False, True, True, False] and got[odd[1]].score == 0


def test_sparse_scores_are_the_plain_sums(spark, corpus):
    model = langid.train(spark.read.parquet(f"{corpus[0]}/documents.parquet"))
    table = {}
    for i, key in enumerate(model.keys.tolist()):
        for e in range(model.first[i], model.first[i + 1]):
            table[key, int(model.language[e])] = model.gain[e]
    for word in ("the", "häuser", "река", "qqq"):
        sums = []
        for j in range(len(model.languages)):
            allowed = model.scripts.get(langid.script(word[0]))
            keys = [sum(ord(c) << 21 * k for k, c in enumerate(reversed(g))) for g in langid.grams(word)]
            sums.append(sum(model.unseen[j] + table.get((k, j), 0.0) for k in keys) if allowed is None or allowed[j] else -np.inf)
        want = np.maximum(np.array(sums) - np.logaddexp.reduce(sums), -6.0)
        assert model.posteriors([word])[0] == pytest.approx(want)


def test_languages_on_held_out_rows(spark, corpus):
    folder, docs, _ = corpus
    rows = {r.doc_id: r for r in op9_langid(spark, folder).collect()}
    assert all(r.held_out == held_out(i) and 0 <= r.score <= 1 for i, r in rows.items())
    unseen = [(i, lang) for i, t, lang, *_ in docs if held_out(i) and t and i < 900]
    assert np.mean([rows[i].lang_pred == lang for i, lang in unseen]) > 0.98
    assert {rows[i].lang_pred for i in (2000, 2001, 2002)} == {"und"} and rows[2000].score == 0


def test_spans_of_mixed_text(spark, corpus):
    model = langid.train(spark.read.parquet(f"{corpus[0]}/documents.parquet"))
    assert model.languages == ["de", "en", "ru"]
    words = WORDS["en"] * 2 + WORDS["ru"] * 2 + WORDS["de"] * 2
    lang, score, spans = langid.label(model, words, next(model.scores([words])))
    assert [s[2] for s in spans] == ["en", "ru", "de"] and spans[1][:2] == (24, 48) and 0 < score < 0.6
    none = langid.train(spark.read.parquet(f"{corpus[0]}/documents.parquet").limit(0))
    assert langid.label(none, ["a"], np.zeros((1, 0)))[0] == "und"


def brute_viterbi(scores, penalty):
    best = None
    n, k = scores.shape
    for code in range(k**n):
        path = [code // k**t % k for t in range(n)]
        total = sum(scores[t, s] for t, s in enumerate(path)) - penalty * sum(a != b for a, b in zip(path, path[1:]))
        best = total if best is None else max(best, total)
    return best


def test_viterbi_is_optimal():
    rng = np.random.default_rng(3)
    for _ in range(120):
        scores, penalty = -rng.exponential(2, (int(rng.integers(1, 8)), int(rng.integers(1, 4)))), float(rng.choice([0.0, 0.5, 2.0, 6.0]))
        path = langid.viterbi(scores, penalty)
        total = scores[np.arange(len(path)), path].sum() - penalty * (np.diff(path) != 0).sum()
        assert total == pytest.approx(brute_viterbi(scores, penalty))


def test_word_scores_do_not_depend_on_the_cache(spark, corpus, monkeypatch):
    model = langid.train(spark.read.parquet(f"{corpus[0]}/documents.parquet"))
    words = [WORDS["en"], WORDS["de"], WORDS["en"] + WORDS["ru"]]
    want = [model.posteriors(w).astype(np.float32) for w in words]
    for limit in (1, 13, 1000):
        monkeypatch.setattr(langid, "_CACHED", limit)
        langid._kept.clear()
        for _ in range(2):
            assert all(np.allclose(a, b) for a, b in zip(model.scores(words), want))


def test_stages(spark, corpus, tmp_path):
    folder, docs, labels = corpus
    table, kept = spark.read.parquet(f"{folder}/documents.parquet"), []
    columns = table.columns
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, table, folder)
        assert n == 4 or out.columns == columns, name
        out.write.parquet(f"{tmp_path}/{n}")
        table = spark.read.parquet(f"{tmp_path}/{n}")
        kept.append([r.doc_id for r in table.select("doc_id").collect()])
    known = {i: q for i, q, _ in labels}
    assert np.mean([(i in set(kept[0])) == bool(q) for i, q in known.items()]) > 0.95
    assert not {2000, 2001, 2002} & set(kept[1])
    assert len(set(kept[1])) > 0.97 * len(set(kept[0]) - {2000, 2001, 2002})
    # Equal texts and a repeated row leave one row; what has no id stays.
    assert 3000 in kept[2] and 3002 not in kept[2] and kept[2].count(3000) == 1 and len(kept[2]) == len(set(kept[2]))
    assert set(kept[2]) - set(kept[3]) == {3001}
    assert sorted(map(str, kept[4])) == sorted(map(str, kept[3]))
    # Texts without words all have fingerprint zero; the pipeline's run gives the same rows.
    assert sorted(str(r.doc_id) for r in corpus_pipeline.run(spark, folder).collect()) == sorted(map(str, kept[4]))


def test_stages_on_an_empty_table(spark, corpus):
    folder = corpus[0]
    none = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0


def changed(rng, words, places):
    words = list(words)
    for i in places:
        words[i] = f"new{rng.randrange(10**9)}"
    return words


def test_near_copies_leave_the_stage(spark):
    rng = random.Random(11)
    text = [f"w{rng.randrange(5000)}" for _ in range(120)]
    other = [f"w{rng.randrange(5000)}" for _ in range(120)]
    rows = [(10, text), (11, changed(rng, text, [30, 90])), (12, changed(rng, text, [20, 50, 80, 110])), (13, [w.upper() for w in text]), (20, other), (21, other[:60]), (30, other[:9]), (31, changed(rng, other[:9], [4]))]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    # 106 of 126 five-word shingles are common to 10 and 11, 96 of 136 to 10 and 12.
    assert kept == {10, 12, 20, 21, 30, 31}


def test_near_copies_against_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    texts = {}
    line = [f"c{i}" for i in range(30)]
    for base in range(12):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.choice([3, 8, 40, 120]))] + (line if base % 3 == 0 else [])
        for _ in range(12):
            texts[len(texts)] = " ".join(changed(rng, words, rng.sample(range(len(words)), rng.choice([0, 0, 1, 2, 3]))))
    texts |= {200: None, 201: " \n", 202: "", 203: "Слово ДОМ река", 204: "слово дом  река"}
    sets = {}
    for i, t in texts.items():
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    want = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and want[i] != want[j]:
                low, high = sorted((want[i], want[j]))
                want = {k: low if v == high else v for k, v in want.items()}
    want = {i: c for i, c in want.items() if list(want.values()).count(c) > 1}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    # With no pair a row every block is confirmed in place, also in sub-blocks of a few texts.
    for few, block, options in ((0, 3, {}), (500_000, 2048, {}), (500_000, 2048, {"pairs_a_row": 0}), (0, 3, {"pairs_a_row": 0, "block_bytes": 2000})):
        monkeypatch.setattr(similar, "MAX_BROADCAST_IDS", few)
        assert {r.doc_id: r.component for r in similar.near_copies(docs, block=block, **options).collect()} == want


def test_crowded_blocks_list_few_pairs(spark):
    rng = random.Random(9)
    rows = [(7, rng.choice([0, 1, 3]), i, i) for i in range(90)] + [(8, 0, 100, 100), (8, 1, 101, 101)]
    found = simhash.block_pairs(spark.createDataFrame(rows, "key long, fp long, id long, label long"), 3).collect()
    assert sorted(tuple(r) for r in found if r.crowded is None) == [(100, 101, None)]
    assert {tuple(r) for r in found if r.crowded is not None} == {(None, None, 7)}


def test_spanning_pairs_join_all_similar_texts():
    rng = np.random.default_rng(4)
    base = [np.arange(60, dtype=np.uint64), np.arange(1000, 1060, dtype=np.uint64)]
    sets = [np.unique(np.concatenate([rng.permutation(base[i > 9 and i % 2])[: 60 - int(k)], rng.integers(100, 140, int(k), dtype=np.uint64)])) for i, k in enumerate(rng.integers(0, 16, 80))]
    near = [[5 * len(np.intersect1d(x, y)) >= 4 * len(np.union1d(x, y)) for y in sets] for x in sets]
    labels = np.where(np.arange(80) < 10, 0, np.arange(80))

    def joined(pairs):
        named = labels.copy()
        for a, b in pairs:
            named[named == max(named[a], named[b])] = min(named[a], named[b])
        return named.tolist()

    found = similar.spanning_pairs(np.zeros(80, np.uint64), labels, sets, 18, similar.SIMILARITY)
    assert all(near[a][b] for a, b in found) and len(found) < 80
    assert joined(found) == joined([(a, b) for a in range(80) for b in range(80) if near[a][b]])
    assert 2 < len(set(joined(found))) < 60


def test_stages_tell_rows_apart_without_ids(spark, tmp_path):
    rng = random.Random(3)
    text = [" ".join(f"w{rng.randrange(5000)}" for _ in range(40)) for _ in range(5)]
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, f"{text[0]} {passage}"), (None, text[1]), (7, f"{text[2]} {passage}"), (7, text[3]), (8, text[4])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {tuple(r) for r in corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path)).collect()} == {rows[1], rows[3], rows[4]}
    # An exact copy without an id goes, two texts that share an id both stay, a row repeated in full leaves one.
    docs = spark.createDataFrame([(7, text[0]), (7, text[1]), (None, text[1]), (None, text[2]), (9, text[3]), (9, text[3])], "doc_id long, text string").repartition(3)
    got = sorted((str(r.doc_id), r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path)).collect())
    assert got == sorted([("7", text[0]), ("7", text[1]), ("None", text[2]), ("9", text[3])])


def test_features_of_long_texts_are_those_of_any(monkeypatch):
    """Slices change no feature, and a text of 60 MB takes few times its size."""
    import pyarrow as pa

    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcXYZ.é 1"), rng.integers(1, 9))) for _ in range(3000)]
    texts = [" ".join(words), "\n".join(words[:500]), "x" * 9000, "", " \n ", "A b. C\n\nA b. C"]
    whole = quality.feature_rows(pa.array(texts))
    monkeypatch.setattr(quality, "_SLICE", 700)
    assert np.abs(quality.feature_rows(pa.array(texts)) - whole).max() < 1e-12
    plain = texts[0].encode().split()
    assert whole[0][12] == pytest.approx(len(set(plain)) / len(plain)) and whole[0][15] == pytest.approx(len(set(zip(plain, plain[1:]))) / (len(plain) - 1))
    assert whole[0][14] == pytest.approx(sum(a == b for a, b in zip(plain, plain[1:])) / len(plain)) and whole[0][18] == pytest.approx(np.std([len(w) for w in plain]) / 10)


def test_the_labelled_sample_is_bounded_over_all_languages(spark, monkeypatch):
    """Many languages share the bound, with joins that shuffle; what each one shows is learned all the same."""
    rows = spark.range(6000).selectExpr("id as doc_id", "concat('l', lpad(id % 600, 3, '0')) as lang", "repeat(concat(translate(lpad(id % 600, 3, '0'), '0123456789', 'abcdefghij'), ' '), 5) as text")
    whole = langid.train(rows, max_docs=50)
    monkeypatch.setattr(langid, "MAX_SAMPLE", 1200)
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 100)
    model = langid.train(rows, max_docs=50)
    assert model.languages == whole.languages and len(model.languages) == 600
    # Two documents a language, five words each: every language's one word was seen ten times.
    assert len(model.keys) == len(whole.keys)
    got = rows.filter("doc_id < 600").select("lang", langid.labeller(model)("text").alias("found")).collect()
    assert len(got) == 600 and all(r.found.lang == r.lang for r in got)
