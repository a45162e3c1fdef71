import numpy as np
import pytest
from pyspark.sql import functions as F

from dupforge.llm import language, toxicity

LARGE = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def crf(spark):
    docs = spark.read.parquet(f"{LARGE}/documents.parquet")
    return language.train(docs.filter(language.fold(F.col("doc_id"), 5) != 0))


def test_marginals_are_those_of_all_labellings():
    rng = np.random.default_rng(0)
    e, t = rng.standard_normal((4, 2, 3)), rng.standard_normal((3, 3))
    lengths = np.array([4, 2])
    got, pairs = language.marginals(e, lengths, t)
    total = np.zeros((3, 3))
    for s, n in enumerate(lengths):
        weights = {}
        for path in np.ndindex(*[3] * n):
            weights[path] = np.exp(sum(e[i, s, y] for i, y in enumerate(path)) + sum(t[a, b] for a, b in zip(path, path[1:], strict=False)))
        z = sum(weights.values())
        for i in range(n):
            assert np.allclose(got[i, s], [sum(w for p, w in weights.items() if p[i] == y) / z for y in range(3)])
        for p, w in weights.items():
            for a, b in zip(p, p[1:], strict=False):
                total[a, b] += w / z
    assert np.allclose(pairs, total)


def test_held_out_language(spark, crf, odd, empty):
    docs = spark.read.parquet(f"{LARGE}/documents.parquet").select("doc_id", "text", "lang")
    held = docs.filter(language.fold(F.col("doc_id"), 5) == 0)
    got = language.predict(held, crf).join(held, "doc_id").select("lang", "lang_pred").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.99 * len(got)
    out = {r["doc_id"]: r for r in language.predict(odd, crf).collect()}
    assert [out[k]["lang_pred"] for k in (1, 2, 3)] == ["und"] * 3 and out[1]["score"] == 0 and out[10]["lang_pred"] in crf.labels
    assert language.predict(empty, crf).count() == 0
    none = language.train(empty)
    assert none.labels == [] and language.predict(odd, none).filter("lang_pred <> 'und'").count() == 0


def test_switching(spark, crf):
    docs = {r["lang"]: r["text"] for r in spark.read.parquet(f"{LARGE}/documents.parquet").filter("n_chars between 600 and 900").orderBy("doc_id").collect()}
    cut = {k: " ".join(v.split()[:30]) for k, v in docs.items()}
    text = f"{cut['de']} {cut['es']}"
    r = language.label_words(spark.createDataFrame([(1, text)], "doc_id long, text string"), crf).first()
    n, labels = len(language.LETTERS.findall(cut["de"])), r["labels"]
    assert sum(x == "de" for x in labels[:n]) > 0.8 * n and sum(x == "es" for x in labels[n:]) > 0.8 * (len(labels) - n)


def test_held_out_toxicity(spark, odd, empty):
    docs, labels = spark.read.parquet(f"{LARGE}/documents.parquet"), spark.read.parquet(f"{LARGE}/labels.parquet")
    held = language.fold(F.col("doc_id"), 4) == 2
    model = toxicity.train(docs, labels.filter(~held))
    some = docs.join(labels.filter(held), "doc_id")
    got = toxicity.score(some.select("doc_id", "text"), model).join(labels, "doc_id").collect()
    p, y = np.array([r["score"] for r in got]), np.array([r["toxic"] for r in got]) == 1
    hit = (p >= toxicity.CUT) & y
    assert hit.sum() >= 0.85 * y.sum() and hit.sum() >= 0.8 * (p >= toxicity.CUT).sum()
    out = toxicity.score(odd, model).collect()
    assert len(out) == odd.count() and all(0 <= r["score"] <= 1 for r in out)
    assert len({r["score"] for r in out if r["doc_id"] in (1, 2, 3)}) == 1
    assert toxicity.score(empty, model).count() == 0
    assert toxicity.train(docs, labels.limit(0)) is None and toxicity.score(odd, None).filter("score <> 0").count() == 0


def test_pieces_of_a_long_text_pool_as_the_whole(monkeypatch):
    model = toxicity.fit(["good words here now"] * 20 + ["bad evil words there"] * 20, [0] * 20 + [1] * 20, epochs=2)
    texts = ["", "one", "one two", " ".join(f"w{k} bad evil" for k in range(60)), "x " * 7]
    whole = toxicity.Scorer(model).probabilities(texts)
    monkeypatch.setattr(toxicity, "AT_ONCE", 7)
    assert np.allclose(toxicity.Scorer(model).probabilities(texts), whole)
    for t, p in zip(texts, whole, strict=True):
        assert np.allclose(toxicity.Scorer(model).probabilities([t]), p)


def plain_probability(model, text):
    """The network by its definition, window by window."""
    words = toxicity.WORDS.findall(text.lower())
    vectors = [sum(model.embedding[f & (toxicity.BUCKETS - 1)].astype(float) for f in toxicity.features(w)) for w in words]
    vectors += [np.zeros(toxicity.DIM)] * toxicity.PADDING
    hidden = []
    for f in model.filters:
        width = len(f)
        windows = [sum(vectors[s + k] @ f[k] for k in range(width)) for s in range(max(len(words) - width + 1, 1))]
        hidden.append(np.max(windows, axis=0))
    z = np.maximum(np.concatenate(hidden) + model.bias, 0) @ model.output + model.offset
    return 1 / (1 + np.exp(-z))


def test_forward_pass_is_that_of_the_definition():
    model = toxicity.fit(["good words here now"] * 20 + ["bad evil words there"] * 20, [0] * 20 + [1] * 20, epochs=2)
    texts = ["", "one", "one two", "bad evil words and more of them", "É same é über " * 9, "x y z w bad"]
    assert np.allclose(toxicity.Scorer(model).probabilities(texts), [plain_probability(model, t) for t in texts], atol=1e-5)


def test_gradients_are_those_of_differences(monkeypatch):
    monkeypatch.setattr(toxicity, "BUCKETS", 64)
    model = toxicity.new_model(3)
    model.embedding, model.filters = model.embedding.astype(float) * 8, [f.astype(float) for f in model.filters]
    model.bias += 0.05
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 12, n) for n in (5, 1, 9, 0, 2)]
    lists = [rng.integers(0, 64, 3) for _ in range(12)]
    y, weight = np.array([1.0, 0, 1, 0, 0]), np.array([1.0, 0.5, 2, 1, 1])
    loss = lambda: toxicity.gradients(model, docs, lists, y, weight)[0]
    _, g = toxicity.gradients(model, docs, lists, y, weight)

    def difference(array, at):
        was = array[at]
        array[at] = was + 1e-6
        up = loss()
        array[at] = was - 1e-6
        down = loss()
        array[at] = was
        return (up - down) / 2e-6

    for f, d in zip(model.filters, g["filters"], strict=True):
        for _ in range(20):
            at = tuple(rng.integers(0, n) for n in f.shape)
            assert abs(difference(f, at) - d[at]) < 1e-6
    for name in ("bias", "output"):
        for k in range(len(g[name])):
            assert abs(difference(getattr(model, name), k) - g[name][k]) < 1e-6
    of_buckets = np.zeros(model.embedding.shape)
    for w, d in g["words"]:
        np.add.at(of_buckets, lists[w], d[None])
    for at in ((int(b), int(k)) for b in lists[0] for k in range(0, toxicity.DIM, 3)):
        assert abs(difference(model.embedding, at) - of_buckets[at]) < 1e-6


def test_clusters_are_languages(spark):
    """lang is looked at here only: it isn't given to the model."""
    docs, labels = spark.read.parquet(f"{LARGE}/documents.parquet"), spark.read.parquet(f"{LARGE}/labels.parquet")
    model = toxicity.train(docs, labels.filter(language.fold(F.col("doc_id"), 4) != 2))
    rows = docs.filter("lang is not null and n_chars > 200").orderBy("doc_id").limit(1500).collect()
    _, found = toxicity.Scorer(model).judged([r["text"] for r in rows])
    langs = np.array([r["lang"] for r in rows])
    most = sum(max((langs[found == c] == x).sum() for x in {*langs}) for c in {*found.tolist()})
    assert len({*found.tolist()}) >= len({*langs}) and most >= 0.97 * len(rows)


def test_repeated_rows_are_learnt_from_once(spark):
    rows = [(k, "bad evil word" if k % 2 else "good kind word", "en") for k in range(40)] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int")
    seen = {}
    for module, args in ((toxicity, (docs, labels)), (language, (docs,))):
        fit = module.fit
        module.fit = lambda texts, *a, m=module, f=fit: seen.setdefault(m.__name__, len(texts)) and f(texts, *a)
        module.train(*args)
        module.fit = fit
    # rows that repeat count each where rows are chosen, so they may take the place of others, but each is learnt from once
    assert seen[toxicity.__name__] == 40 and 2 <= seen[language.__name__] <= 40


def test_every_labelled_row_is_learnt_from(spark, monkeypatch):
    """Rows beyond 2,000 of a label, and long texts."""
    rows = [(k, f"bad evil word {k}" if k % 2 else f"good kind word {k}") for k in range(4200)]
    rows += [(5000 + k, ("curse " if k % 2 else "bless ") * 4000) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[0] % 2) for r in rows], "doc_id long, toxic int")
    seen, fit = [], toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda data, *y: seen.append(len(data)) or fit(data, *y, epochs=2))
    model = toxicity.train(docs, labels)
    assert seen == [len(rows)]
    curse, bless = toxicity.Scorer(model).scores(["curse curse", "bless bless"])
    assert curse >= toxicity.CUT > bless
    words = [h & (toxicity.BUCKETS - 1) for w in ("curse", "bless") for h in toxicity.features(w)]
    assert (model.embedding[words] != toxicity.new_model().embedding[words]).any(1).all()


def test_blocks_in_a_table_are_fitted_as_those_on_the_driver(spark, monkeypatch):
    docs, labels = spark.read.parquet(f"{LARGE}/documents.parquet"), spark.read.parquet(f"{LARGE}/labels.parquet").filter("doc_id % 9 = 0")
    monkeypatch.setattr(toxicity, "BLOCK_ROWS", 64)
    models, fit = [], toxicity.fit

    def both(data):
        assert isinstance(data, toxicity.There)
        blocks = [toxicity.Block.of(r.asDict()) for r in data.table.collect()]
        assert len(blocks) > 4 and sum(len(b.y) for b in blocks) == len(data) == docs.join(labels, "doc_id").count()
        models.extend(fit(d, epochs=2) for d in (data, toxicity.Here(blocks[::-1])))

    monkeypatch.setattr(toxicity, "fit", both)
    toxicity.train(docs, labels)
    there, here = models
    for name in ("embedding", "bias", "output", "languages"):
        assert (getattr(there, name) == getattr(here, name)).all()
    assert there.thresholds == here.thresholds and all((a == b).all() for a, b in zip(there.filters, here.filters, strict=True))
    assert (there.embedding != toxicity.new_model().embedding).any()


def test_thresholds_are_the_best_of_all_scores():
    rng = np.random.default_rng(2)
    for _ in range(20):
        y = rng.integers(0, 2, 60)
        y[0] = 1
        p = np.rint(np.clip(0.3 * y + 0.7 * rng.random(60), 0.03, 0.97) * toxicity.STEPS).astype(int)
        counts = np.zeros((toxicity.STEPS + 1, 2), int)
        np.add.at(counts, (p, y), 1)
        t = toxicity.best_threshold(counts[:, 1], counts.sum(1))
        f1 = lambda t: 2 * ((p / toxicity.STEPS >= t) & (y == 1)).sum() / ((p / toxicity.STEPS >= t).sum() + y.sum())  # noqa: B023, E731
        assert np.isclose(f1(t), max(f1(x / toxicity.STEPS) for x in p))
        none = toxicity.thresholds({0: counts * [1, 0]})
        assert toxicity.thresholds({0: counts, -1: counts * 0}) == {-1: t, 0: t} and none == {-1: toxicity.CUT}


def test_gradients_of_a_long_text_in_pieces(monkeypatch):
    model, rng = toxicity.new_model(3), np.random.default_rng(0)
    docs = [rng.integers(0, 40, n) for n in (5, 1, 90, 0, 2, 30)]
    lists = toxicity.Lists.of([rng.integers(0, 64, 3) for _ in range(40)])
    whole = toxicity.forward(model, docs, lists)
    for size in (1, 4, 7):
        monkeypatch.setattr(toxicity, "AT_ONCE", size)
        parts = toxicity.forward(model, docs, lists)
        assert (parts[3] == whole[3]).all() and np.allclose(parts[4], whole[4], atol=1e-6)


def test_texts_are_shuffled_once_and_only_those_learnt_from(spark, monkeypatch):
    """Rows that repeat, ids with several texts, and a labelled text in a fifth of the rows; bytes as Spark counts them."""
    rng = np.random.default_rng(4)
    rows = [(k, rng.bytes(1000).hex()) for k in range(3000)]
    rows += rows[:50] * 3 + [(7, "another"), (7, None), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 10 == 0)) for k in range(0, 3000, 5)] + [(7, 1), (7, 0), (9000, 1)], "doc_id long, toxic int")
    core = spark.sparkContext._jsc.sc()

    def shuffled():
        core.listenerBus().waitUntilEmpty(30_000)
        gateway = spark.sparkContext._gateway
        stages = core.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))

    blocks = []
    monkeypatch.setattr(toxicity, "BLOCK_ROWS", 64)
    monkeypatch.setattr(toxicity, "fit", lambda data: blocks.extend(r.asDict() for r in data.table.collect()) or blocks.append((len(data), data.hits)))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        was = shuffled()
        toxicity.train(docs, labels)
        wrote = shuffled() - was
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    toxic = [(k, y) for k, y in [(k, int(k % 10 == 0)) for k in range(0, 3000, 5)] + [(7, 1), (7, 0)]]
    texts = {(k, t or "") for k, t in rows}
    learnt = sorted((y, t) for k, y in toxic for i, t in texts if i == k)
    assert blocks.pop() == (len(learnt), sum(y for y, _ in learnt))
    packed = [toxicity.Block.of(b) for b in blocks]
    words = {y: sum(int(b.docs.sizes[b.y == y].sum()) for b in packed) for y in (0, 1)}
    assert words == {y: sum(len(toxicity.WORDS.findall(t)) for z, t in learnt if z == y) for y in (0, 1)}
    assert len(packed) > 5 and max(len(b.y) for b in packed) < 2 * 64
    # random digits don't pack; twice, or with all others, it would be over two times what is learnt from
    assert wrote < 1.5 * sum(len(t) for _, t in learnt)


def test_words_hashed_together_are_hashed_as_one_by_one():
    rng = np.random.default_rng(0)
    words = ["", "a", "abc", "abcd", "abcdefgh", "abcdefghi", "É", "日本語", "é" * 40, "x" * 32, "x" * 33, "x" * 500]
    words += ["".join(chr(c) for c in rng.choice([97, 98, 99, 95, 48, 233, 26085, 128512], rng.integers(0, 12))) for _ in range(500)]
    for some in (words, words[:1], words[6:8], []):
        for one, many in ((toxicity.grams, toxicity.grams_of), (toxicity.features, toxicity.features_of)):
            got, lists = many(some), [one(w) for w in some]
            assert got.sizes.tolist() == [*map(len, lists)] and got.flat.tolist() == [x for found in lists for x in found]
