import json
import math

import pytest
from pyspark.sql import functions as F

from bipole.functions import columns as C
from bipole.operators import classify, generate, pools, represent, similarity, structured, train
from bipole.operators.backends import BackendFactory, fit_context, inline_refs
from bipole.plans.catalog import ScriptedBackend


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def pool(spark, rows):
    return spark.createDataFrame(rows, "pos bigint, side string, text string")


def test_labels(spark):
    frame = lambda xs, t: spark.createDataFrame([(x,) for x in xs], f"label {t}")
    assert pools.resolve_labels(frame([0, 1, 1], "int")) == (0, 1)
    assert pools.resolve_labels(frame(["negative", "positive"], "string")) == ("negative", "positive")
    assert pools.resolve_labels(frame(["spam", "ham"], "string"), pos_label="spam") == ("ham", "spam")
    for bad in ([1], [1, 2, 3], [1, None]):
        with pytest.raises(ValueError):
            pools.resolve_labels(frame(bad, "int"))
    with pytest.raises(ValueError):
        pools.resolve_labels(frame(["spam", "ham"], "string"))


def test_ngrams_and_jaccard(spark):
    for text in ("", "a", "abc", "abcd", "aaaa", "a😀bc", "映画はとても"):
        want = {text} if len(text) <= 3 else {text[i : i + 3] for i in range(len(text) - 2)}
        assert set(value(spark, C.char_ngrams(F.lit(text)))) == want
        assert len(similarity.grams(text)) == len(want)
    assert value(spark, C.jaccard(C.char_ngrams(F.lit("aaaa")), C.char_ngrams(F.lit("aaaaa")))) == 1.0


def test_near_and_verbatim_both_ways(spark):
    a = spark.createDataFrame([(1, "great customer service in town!"), (2, "mountain hiking trip"), (3, "x"), (4, None)], "id bigint, text string")
    b = spark.createDataFrame([(7, "great customer service in town"), (8, "apple pie recipe")], "pos bigint, text string")
    for limit in (1 << 20, 0):
        assert [r["id"] for r in similarity.near_duplicates(a, b, "id", "pos", limit=limit).collect()] == [1]
        assert [r["id"] for r in similarity.verbatim_spans(a, b, "id", limit=limit).collect()] == [1]
        near = similarity.nearest(a.withColumnRenamed("id", "query_id"), b, 2, limit=limit).orderBy("query_id", "rank").collect()
        assert [(r["query_id"], r["pos"], r["rank"]) for r in near] == [(1, 7, 1), (1, 8, 2), (2, 7, 1), (2, 8, 2), (3, 7, 1), (3, 8, 2)]


def test_budget_balance_and_diversity(spark):
    p = pool(spark, [(0, "positive", "h" * 400), (1, "positive", "a"), (2, "positive", "b"), (3, "positive", "c")])
    assert [r["pos"] for r in pools.trim_to_budget(p, 10).orderBy("rank").collect()] == [1, 2, 3]
    assert {r["pos"] for r in pools.budget_select(p, 10, k=2).collect()} <= {1, 2, 3}
    with pytest.raises(ValueError):
        pools.budget_select(p, 0)
    both = pool(spark, [(i, "positive" if i < 4 else "negative", f"t{i}") for i in range(5)])
    assert sorted(r["side"] for r in pools.balance(both).collect()) == ["negative", "positive"]
    assert pools.balance(p).count() == 0
    texts = pool(spark, [(0, "positive", "apple pie recipe"), (1, "positive", "apple pie recipes"), (2, "positive", "mountain hiking trip")])
    assert [r["pos"] for r in similarity.diverse(texts, 2).orderBy("pos").collect()] == [0, 2]


def test_parse_and_calibrate(spark):
    for raw, label, conf, p in (("The label is positive.", "positive", 1.0, 1.0), ("negative", "negative", 1.0, 0.0), ("", "positive", 0.5, 0.5), ("negative or positive", "negative", 0.5, 0.5)):
        got = value(spark, C.parsed_label(F.lit(raw)))
        assert (got["label"], got["confidence"]) == (label, conf)
        assert value(spark, C.completion_probability(C.parsed_label(F.lit(raw)))) == p
    assert value(spark, C.predicted(F.lit(0.5), 1, 0)) == 0
    assert value(spark, C.calibrated(F.lit(0.5), C.softmax_positive(F.lit(10.0), F.lit(0.0)))) < 0.5


class Fixed:
    def score_choices(self, prompt, choices):
        return [10.0, 0.0] if prompt.endswith("Text: \nLabel:") else [0.0, 0.0]


def test_classifier(spark, tmp_path):
    df = spark.createDataFrame([(i, ("good " if i % 2 else "bad ") + str(i), i % 2) for i in range(10)], "pos bigint, text string, label int")
    asked = spark.createDataFrame([(1, "good x"), (2, "bad x")], "query_id bigint, text string")
    fixed = classify.PromptClassifier(BackendFactory(Fixed)).fit(df)
    assert all(r["p_positive"] < 0.5 for r in fixed.predict_proba(asked).collect())
    for selector in (None, similarity.NearestSelector()):
        model = classify.PromptClassifier(BackendFactory("lexical"), selector, max_exemplars=2).fit(df)
        assert {r["query_id"]: r["prediction"] for r in model.predict(asked).collect()} == {1: 1, 2: 0}
        model.save(f"file://{tmp_path}/m")
        again = classify.PromptClassifier.load(spark, f"file://{tmp_path}/m", BackendFactory("lexical"))
        assert {r["query_id"]: r["prediction"] for r in again.predict(asked).collect()} == {1: 1, 2: 0}
    with pytest.raises(ValueError):
        classify.PromptClassifier(BackendFactory("lexical"), context_limit=4).fit(df)
    trained = train.TrainedClassifier(class_weight="balanced").fit(df)
    assert {r["query_id"]: r["prediction"] for r in trained.predict(asked).collect()} == {1: 1, 2: 0}
    weights = {r["label"]: r["weight"] for r in pools.class_weights(spark.createDataFrame([(0,), (0,), (0,), (1,)], "label int"), "label").collect()}
    assert math.isclose(weights[0], 4 / 6) and math.isclose(weights[1], 2)


def test_stream(spark, tmp_path):
    from bipole.streaming.classify import classify_stream

    df = spark.createDataFrame([(i, ("good " if i % 2 else "bad ") + str(i), i % 2) for i in range(6)], "pos bigint, text string, label int")
    model = classify.PromptClassifier(BackendFactory("lexical")).fit(df)
    spark.createDataFrame([(1, "good x"), (2, "bad x")], "query_id bigint, text string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("query_id bigint, text string").parquet(f"{tmp_path}/in")
    classify_stream(stream, model, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert {r["query_id"]: r["prediction"] for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {1: 1, 2: 0}


def test_generation(spark):
    df = spark.createDataFrame([(i, f"text {i}", int(i < 2)) for i in range(6)], "pos bigint, text string, label int")
    out = generate.OverSampler(BackendFactory(ScriptedBackend)).fit_resample(df).where("is_generated").collect()
    assert len(out) == 2 and all(r["label"] == 1 for r in out) and {r["pos"] for r in out} == {6, 7}
    synth = generate.SyntheticSampler(BackendFactory(ScriptedBackend), n_synthesized=4).fit_resample(df)
    assert synth.where("is_generated").count() == 4
    with pytest.raises(ValueError):
        generate.SyntheticSampler(BackendFactory(ScriptedBackend)).fit_resample(df)
    told = spark.createDataFrame([(0, 0, "text 1"), (0, 1, "new"), (1, 0, "new"), (1, 1, "newer")], "batch bigint, item bigint, text string")
    assert [r["text"] for r in generate.accept(told, df, None, 5).collect()] == ["new", "newer"]
    assert len(generate.accept(told, df, None, 3, deduplicate=False).collect()) == 3
    assert "Negative" not in generate.user_message(["a"], None, 2) and "(none)" in generate.user_message([], [], 1)


def test_structured_and_schema():
    good = {"style_features": [], "content_features": ["x"], "synthetic_texts": [{"text": "t", "generalized_from": []}]}

    class Replies:
        def __init__(self, *replies):
            self.replies = list(replies)

        def complete(self, prompt, **options):
            return self.replies.pop(0)

    for raw in (json.dumps(good), f"```json\n{json.dumps(good)}\n```", f"Sure: {json.dumps(good)} ok"):
        assert structured.complete_structured(Replies("no", raw), "s", "u", structured.SYNTHETIC) == good
    with pytest.raises(ValueError):
        structured.complete_structured(Replies("{}", "{}"), "s", "u", structured.SYNTHETIC)
    assert inline_refs({"$defs": {"A": {"type": "string"}}, "items": {"$ref": "#/$defs/A"}}) == {"items": {"type": "string"}}
    assert fit_context([100, 1, 2, 3, 4, 5], 5, 1) == [100, 3, 4, 5]
    with pytest.raises(ValueError):
        BackendFactory("unknown")


def test_representatives_and_metrics(spark):
    v = spark.createDataFrame([(i, [0.1 * i + 0.1, 0.0]) for i in range(3)] + [(i, [10.0, 10.0 + 0.1 * i]) for i in range(3, 6)], "pos bigint, embedding array<double>")
    assert {p // 3 for p in represent.kmeans_representatives(v, 2)} == {0, 1}
    assert len(set(represent.vote_k(v, 3, k=2))) == 3 and represent.vote_k(v, 9) == list(range(6))
    p = spark.createDataFrame([("positive", "positive", 0.9), ("positive", "negative", 0.2), ("negative", "negative", 0.4)], "truth string, prediction string, p_positive double")
    m = classify.metrics(p, "positive").first()
    assert (m["n"], m["precision_positive"], m["recall_positive"]) == (3, 1.0, 0.5)
    assert {(r["truth"], r["prediction"]): r["n"] for r in classify.confusion(p, ["positive", "negative"]).collect()}[("negative", "positive")] == 0


def test_nearest_vectors_in_blocks(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.integers(-2, 3, (57, 4)))]
    pool = spark.createDataFrame(rows, "pos bigint, embedding array<double>")
    queries = pool.withColumnRenamed("pos", "query_id")
    whole = sorted(map(tuple, represent.nearest_vectors(queries, pool, 5).collect()))
    assert len(whole) == 57 * 5
    for limit in (10, 19, 57):
        assert sorted(map(tuple, represent.nearest_vectors(queries, pool, 5, limit=limit).collect())) == whole


def test_samplers_choose_by_method(spark):
    xs = [0.0, 0.1, 0.2, 5.0, 5.1, 9.0]
    rows = [(10 * s + i, side, f"{side} {i:02d}", [x, 1.0]) for s, side in enumerate(("positive", "negative")) for i, x in enumerate(xs)]
    both = spark.createDataFrame(rows, "pos bigint, side string, text string, embedding array<double>").cache()
    for method in ("random", "kmeans", "votek"):
        sampler = generate._Sampler(BackendFactory("lexical"), method=method, seed=3)
        own, want = 3 * 1_000_003, {}
        for side in ("positive", "negative"):
            want[side] = [r["text"] for r in generate.sample_group(both.where(F.col("side") == side), 9, method, own).orderBy("pos").collect()]
        got = sampler._examples(both, 9, 0)
        assert got == (want["positive"], want["negative"]) and got[0]


class Vowels:
    """A test double of an embedding model."""

    def __call__(self, texts):
        return [[float(t.count(v)) for v in "aeiou"] for t in texts]


def test_similarity_functions(spark):
    close = represent.cosine_similarity_fn(lambda name: Vowels(), "vowels")
    assert close("banana", "papaya") == pytest.approx(1) and close("banana", "xyz") == 0 and close("ae", "a") == pytest.approx(0.5**0.5)
    p = pool(spark, [(i, s, t) for i, (s, t) in enumerate([("positive", "banana"), ("positive", "pepper"), ("positive", "papaya"), ("negative", "kiwi"), ("negative", "apple"), ("negative", "plum")])])
    asked = spark.createDataFrame([(7, "mango apart"), (8, None)], "query_id bigint, text string")
    for limit in (1 << 20, 1):
        near = similarity.nearest_by(asked, p, 3, close, limit=limit).orderBy("rank").collect()
        assert [(r["query_id"], r["pos"], r["rank"]) for r in near] == [(7, 0, 1), (7, 2, 2), (7, 4, 3)]
    got = similarity.NearestSelector(close).select(p, 1, asked).collect()
    assert sorted((r["side"], r["text"]) for r in got) == [("negative", "apple"), ("positive", "banana")]
    far = similarity.DiversitySelector(close).select(p, 2).collect()
    assert sorted((r["side"], r["pos"]) for r in far) == [("negative", 3), ("negative", 4), ("positive", 0), ("positive", 1)]  # apple and plum tie


def test_diverse_against_brute_force(spark):
    import random

    rng = random.Random(9)
    rows = [(i, rng.choice(["positive", "negative"]), "".join(rng.choice("abc ") for _ in range(rng.randrange(1, 30)))) for i in range(60)]
    sim = lambda a, b: len(a & b) / len(a | b)
    sets = {i: set(similarity.grams(t).tolist()) for i, _, t in rows}
    for k in (0, 1, 4, 100):
        want = set()
        for side in ("positive", "negative"):
            left, chosen = [i for i, s, _ in rows if s == side], []
            while left and len(chosen) < k:
                at = min(left, key=lambda i: (max([sim(sets[i], sets[j]) for j in chosen], default=0), i))
                chosen.append(at)
                left.remove(at)
            want |= set(chosen)
        assert {r["pos"] for r in similarity.diverse(pool(spark, rows), min(k, 12)).collect()} == want or k == 100
    assert similarity.diverse(pool(spark, rows[:3]), 9).count() == 3


def test_vote_k_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    x = rng.standard_normal((80, 3))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "pos bigint, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for n, k in ((10, 5), (30, 3), (79, 10), (80, 2)):
        order = [[j for j in np.lexsort((np.arange(80), -np.round(u @ u[i], 12))) if j != i][:k] for i in range(80)]
        tally, chosen = {i: sum(i in o for o in order) for i in range(80)}, []
        while len(chosen) < n:
            at = min((p for p in tally if p not in chosen), key=lambda p: (-tally[p], p))
            chosen.append(at)
            tally.update({p: 0 for p in order[at]})
        assert represent.vote_k(frame, n, k) == (chosen if n < 80 else list(range(80)))


class Counting(ScriptedBackend):
    made = 0

    def __init__(self):
        type(self).made += 1

    def count_tokens(self, text):
        return len(text.split())


def test_capabilities_and_tokens_of_the_backend(spark):
    import copy

    factory = BackendFactory(Counting)
    assert factory.can("count_tokens") and not factory.can("score_choices") and Counting.made == 0
    assert copy.deepcopy(factory) is factory
    model = classify.PromptClassifier(factory, context_limit=60)
    assert model.copy(context_limit=50).backend is factory and model.copy(context_limit=50).context_limit == 50
    rows = spark.createDataFrame([(i, "w " * (i + 1), i % 2) for i in range(8)], "pos bigint, text string, label int")
    assert model.fit(rows).budget_ == (60 - (8 + 8)) // 2  # words, as the backend counts


def test_saved_classifier_keeps_its_parts(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"text number {i} {'good' if i % 2 else 'bad'}", i % 2) for i in range(12)], "pos bigint, text string, label int")
    asked = spark.createDataFrame([(1, "text good"), (2, "text bad")], "query_id bigint, text string")
    model = classify.PromptClassifier(BackendFactory("lexical"), max_exemplars=3).fit(rows)
    model.save(f"file://{tmp_path}/static")
    back = classify.PromptClassifier.load(spark, f"file://{tmp_path}/static", BackendFactory("lexical"))
    assert sorted(back.exemplars_.collect()) == sorted(model.exemplars_.collect()) and sorted(back.predict_proba(asked).collect()) == sorted(model.predict_proba(asked).collect())
    classify.PromptClassifier(BackendFactory("lexical"), similarity.NearestSelector(), max_exemplars=2).fit(rows).save(f"file://{tmp_path}/near")
    assert isinstance(classify.PromptClassifier.load(spark, f"file://{tmp_path}/near", BackendFactory("lexical")).selector, similarity.NearestSelector)
    custom = pools.CustomSelector(lambda pool, k, queries: similarity.NearestSelector().select(pool, k, queries), query_aware=True)
    classify.PromptClassifier(BackendFactory("lexical"), custom, max_exemplars=2).fit(rows).save(f"file://{tmp_path}/custom")
    with pytest.raises(ValueError, match="CustomSelector"):
        classify.PromptClassifier.load(spark, f"file://{tmp_path}/custom", BackendFactory("lexical"))
    assert classify.PromptClassifier.load(spark, f"file://{tmp_path}/custom", BackendFactory("lexical"), custom).predict(asked).count() == 2


class FakeLlama:
    """Logits that depend on the last two tokens alone; counts the tokens that it evaluates."""

    def __init__(self):
        self.past, self.scores, self.evaluated = [], {}, 0

    def tokenize(self, raw, add_bos=True):
        return ([1] if add_bos else []) + [2 + b for b in raw]

    def reset(self):
        self.past = []

    def eval(self, tokens):
        for t in tokens:
            self.past.append(t)
            self.evaluated += 1
            last = (self.past[-2] if len(self.past) > 1 else 0, t)
            self.scores[len(self.past) - 1] = [math.sin(last[0] * 7 + last[1] * 3 + v) for v in range(300)]

    def save_state(self):
        return list(self.past), dict(self.scores)

    def load_state(self, state):
        self.past, self.scores = list(state[0]), dict(state[1])


def test_shared_prefix_scores_as_each_by_itself():
    from bipole.operators.backends import LlamaBackend

    one = object.__new__(LlamaBackend)
    one.model, one.n_ctx = FakeLlama(), 400
    prefix, queries, choices = "p" * 200, ["a", "bcd", "e" * 300, ""], [" positive", " negative", "x"]
    with pytest.warns(UserWarning, match="cut to"):
        want = [one.score_choices(prefix + q, choices) for q in queries]
        apart, one.model.evaluated = one.model.evaluated, 0
        got = one.score_choices_batch(prefix, queries, choices)
    assert [pytest.approx(w) for w in want] == got and one.model.evaluated < 0.75 * apart
    with pytest.warns(UserWarning):
        assert fit_context([1, 2, 3], 3, 2) == [3]


def test_training_sends_no_text_by_label(spark):
    rows = spark.createDataFrame([(i, f"text {i}", i % 2) for i in range(8)], "pos bigint, text string, label int").repartition(4)
    seen = []
    fit = train.Pipeline.fit
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    train.Pipeline.fit = lambda self, df: seen.append(df._jdf.queryExecution().executedPlan().toString()) or fit(self, df)
    try:
        train.TrainedClassifier(class_weight="balanced", epochs=1).fit(rows)
    finally:
        train.Pipeline.fit = fit
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in seen[0] and "SortMergeJoin" not in seen[0]


def test_few_queries_in_a_large_pool(spark):
    import random

    rng = random.Random(4)
    told = lambda n: ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))) for _ in range(n)]
    p = pool(spark, [(i, "positive", t) for i, t in enumerate(told(300))] + [(999, "positive", None)]).repartition(5)
    asked = spark.createDataFrame([*enumerate(told(9)), (50, None), (51, "映画")], "query_id bigint, text string")
    for k in (1, 4, 400):
        want = sorted(similarity.nearest(asked, p, k).collect())
        few = similarity.nearest(asked, p, k, limit=1500)  # the queries fit, the pool doesn't
        assert sorted(few.collect()) == want and len(want) == 10 * min(k, 300)
        assert "Generate" not in few._jdf.queryExecution().toString()
    assert similarity.nearest(asked.limit(0), p, 2, limit=1500).count() == 0


def test_few_texts_in_many_sources(spark):
    sources = [f"source {i} says {'lorem ipsum dolor'[i % 5:]} and number {i * i} goes on" for i in range(60)] + [None, "", "short"]
    texts = [(1, "x" + sources[7][3:23]), (2, sources[9][3:22] + "!"), (3, None), (4, "映画はとても" * 4), (5, "zz " + sources[40] + " zz"), (6, "short"), (1, "second text under the key one")]
    some, many = spark.createDataFrame(texts, "key bigint, text string"), spark.createDataFrame([(s,) for s in sources], "text string").repartition(4)
    want = sorted(similarity.verbatim_spans(some, many, "key").collect(), key=str)
    few = similarity.verbatim_spans(some, many, "key", limit=700)
    assert sorted(few.collect(), key=str) == want and {r["key"] for r in want} == {1, 5}
    assert "Generate" not in few._jdf.queryExecution().toString()


def test_budget_gathers_what_could_be_taken(spark):
    import random

    rng = random.Random(2)
    rows = [(i, rng.choice(["positive", "negative"]), "x" * rng.choice([0, 3, 4, 11, 40, 90])) for i in range(400)]
    for budget, k in ((1, None), (7, None), (40, None), (40, 3), (200, 500)):
        for order in (None, F.md5(F.col("pos").cast("string"))):
            want = set()
            for side in ("positive", "negative"):
                left, n = budget, 0
                own = [r for r in rows if r[1] == side]
                for pos, _, text in own if order is None else sorted(own, key=lambda r: __import__("hashlib").md5(str(r[0]).encode()).hexdigest()):
                    if len(text) // 4 + 1 <= left and (k is None or n < k):
                        want.add((side, pos, n))
                        left, n = left - len(text) // 4 - 1, n + 1
            got = pools.trim_to_budget(pool(spark, rows), budget, order, k=k)
            assert {(r["side"], r["pos"], r["rank"]) for r in got.collect()} == want
    # half of the rows cost the same: the fold isn't given more of them than could be taken
    given = pools.trim_to_budget(pool(spark, [(i, "positive", "abcd") for i in range(5000)]), 20)
    gathered = given._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" in gathered and given.count() == 10
