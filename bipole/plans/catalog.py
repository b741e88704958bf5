"""The registered queries and their SQL, by name. Every query reads its whole tables."""

from __future__ import annotations

import hashlib
import json
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bipole.functions import columns as C
from bipole.operators import classify, generate, pools, represent, similarity, train
from bipole.operators.backends import BackendFactory
from bipole.operators.structured import HARD_POSITIVE, SYNTHETIC
from bipole.sources.tables import labelled_documents, table

BUDGET, CONTEXT, SEED, K = 6000, 100_000, 0, 5

# ---- SQL that several queries share
_POOL = """pool as (select d.doc_id pos, case when l.toxic = (select max(toxic) from labels) then 'positive' else 'negative' end side, d.text, (length(d.text) // 4 + 1)::bigint c
  from documents d join labels l using (doc_id)),
keyed as (select *, md5('0:' || side || ':' || pos) k from pool)"""
_CLASS_BUDGET = f"(select ({CONTEXT} - (max(c) + 3)) // 2 from pool)"


def _fold(budget: str, order: str) -> str:
    return f"""queue as (select side, pos, c, row_number() over (partition by side order by {order}) n from keyed where c <= {budget}),
fold as (select side, pos, n, c t, true taken from queue where n = 1
  union all select q.side, q.pos, q.n, case when f.t + q.c <= {budget} then f.t + q.c else f.t end, f.t + q.c <= {budget} from fold f join queue q on q.side = f.side and q.n = f.n + 1),
taken as (select side, pos, row_number() over (partition by side order by n) - 1 rank from fold where taken)"""


_BALANCED = """even as (select * from (select k.*, row_number() over (partition by k.side order by k.k, k.pos) r from keyed k join taken t on t.pos = k.pos and t.side = k.side)
  where r <= (select case when count(*) = 2 then min(n) else 0 end from (select side, count(*) n from taken group by side)))"""


def _grams(name: str, source: str, key: str) -> str:
    return f"""{name}_chars as (select {key} id, text t, regexp_extract_all(text, '(?s).') cs from {source} where text is not null),
{name} as (select id, unnest(case when len(cs) <= 3 then [t] else list_distinct(list_transform(range(1, len(cs) - 1), lambda i: cs[i] || cs[i + 1] || cs[i + 2])) end) g from {name}_chars),
{name}_n as (select id, count(*) n from {name} group by id)"""


_NEAR = f"""{_grams("q", "documents", "doc_id")}, {_grams("p", "benchmark", "item_id")},
shared as (select q.id qid, p.id pid, count(*) c from q join p on q.g = p.g group by all),
alike as (select qid, pid, c / (x.n + y.n - c)::double s from shared join q_n x on x.id = qid join p_n y on y.id = pid)"""
_SCORED = f"""with recursive {_POOL}, {_fold(_CLASS_BUDGET, "k, pos")}, {_BALANCED},
asked as (select * from pool where pos not in (select pos from even)),
{_grams("q", "asked", "pos")}, {_grams("p", "even", "pos")},
shared as (select q.id qid, p.id pid, count(*) c from q join p on q.g = p.g group by all),
means as (select qid, e.side, sum(shared.c / (x.n + y.n - shared.c)::double) s from shared join q_n x on x.id = qid join p_n y on y.id = pid join even e on e.pos = pid group by all),
sizes as (select side, count(*) n from even group by side),
scored as (select a.pos query_id, a.side truth, 1e-6 + coalesce(max(case when m.side = 'positive' then m.s end), 0) / (select n from sizes where side = 'positive') p,
  1e-6 + coalesce(max(case when m.side = 'negative' then m.s end), 0) / (select n from sizes where side = 'negative') n from asked a left join means m on m.qid = a.pos group by a.pos, a.side),
proba as (select query_id, truth, p / (p + n) p_positive from scored),
guessed as (select *, case when p_positive > 1 - p_positive then 'positive' else 'negative' end prediction from proba)"""


# ---- the pool and the fitted classifier
def _pool(spark, d: str) -> DataFrame:
    return pools.make_pool(labelled_documents(spark, d))


def _classifier(spark, d: str) -> tuple[classify.PromptClassifier, DataFrame]:
    """Fitted on all labelled documents, with those that aren't exemplars as queries."""
    model = classify.PromptClassifier(BackendFactory("lexical"), context_limit=CONTEXT, seed=SEED).fit(labelled_documents(spark, d))
    asked = model.pool_.join(model.exemplars_.select("pos"), "pos", "left_anti")
    return model, asked.select(F.col("pos").alias("query_id"), "text", F.col("side").alias("truth"))


def _predictions(spark, d: str) -> DataFrame:
    model, asked = _classifier(spark, d)
    p = model.predict_proba(asked)
    # the lexical scores' last digits depend on the order of sums
    p = p.select("query_id", F.round("p_positive", 9).alias("p_positive"))
    return p.select("query_id", "p_positive", C.predicted(F.col("p_positive"), C.POSITIVE, C.NEGATIVE).alias("prediction")).join(asked.select("query_id", "truth"), "query_id")


# ---- queries
def label_resolution(spark, d):
    neg, pos = pools.resolve_labels(table(spark, d, "labels"), "toxic")
    return spark.createDataFrame([(neg, pos)], "negative int, positive int")


def pool_sizes(spark, d):
    return _pool(spark, d).groupBy("side").agg(F.count(F.lit(1)).alias("n"))


def token_count(spark, d):
    return table(spark, d, "documents").select("doc_id", C.token_count(F.col("text")).alias("n_tokens"))


def char_ngrams_count(spark, d):
    return table(spark, d, "documents").select("doc_id", similarity.gram_count("text").alias("n_grams"))


def ngram_jaccard_pairs(spark, d):
    return similarity.all_pairs(table(spark, d, "benchmark"), "item_id").select("a", "b", F.round("similarity", 6).alias("similarity"))


def near_duplicates(spark, d):
    found = similarity.near_duplicates(table(spark, d, "documents"), table(spark, d, "benchmark"), "doc_id", "item_id")
    return found.select("doc_id", F.round("best_similarity", 6).alias("best_similarity"))


def verbatim_span_docs(spark, d):
    return similarity.verbatim_spans(table(spark, d, "documents"), table(spark, d, "benchmark"), "doc_id").select("doc_id")


def random_select_k(spark, d):
    return pools.random_select(_pool(spark, d), K, SEED).select("side", "pos")


def budget_select(spark, d):
    return pools.budget_select(_pool(spark, d), BUDGET, seed=SEED).select("side", "pos", F.col("rank").cast("bigint").alias("rank"))


def trim_to_budget(spark, d):
    return pools.trim_to_budget(_pool(spark, d), BUDGET).select("side", "pos", F.col("rank").cast("bigint").alias("rank"))


def class_balance(spark, d):
    return pools.balance(_pool(spark, d), SEED).select("side", "pos")


def estimate_count(spark, d):
    return pools.estimate_count(_pool(spark, d), BUDGET)


def nearest_topk_lexical(spark, d):
    near = similarity.nearest(table(spark, d, "documents").withColumnRenamed("doc_id", "query_id"), table(spark, d, "benchmark").withColumnRenamed("item_id", "pos"), K)
    return near.select("query_id", "pos", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("bigint").alias("rank"))


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("pos"), "embedding")


def nearest_topk_cosine(spark, d):
    v = _vectors(spark, d)
    return represent.nearest_vectors(v.withColumnRenamed("pos", "query_id"), v, K).select("query_id", "pos", F.round("cosine", 6).alias("cosine"), F.col("rank").cast("bigint").alias("rank"))


def votek_votes(spark, d):
    v = _vectors(spark, d)
    return represent.votes(represent.nearest_vectors(v.withColumnRenamed("pos", "query_id"), v, 10), v)


def exemplar_prefix(spark, d):
    chosen = pools.balance(pools.budget_select(_pool(spark, d), BUDGET, seed=SEED).select("pos", "side", "text"), SEED)
    return classify.prefix_of(chosen)


def query_suffix(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", C.query_suffix(F.col("text")).alias("suffix"))


def parse_label(spark, d):
    reply = F.concat(F.when(F.col("turn") % 4 == 0, "The label is positive. ").when(F.col("turn") % 4 == 1, "NEGATIVE, not positive: ").when(F.col("turn") % 4 == 2, "negative ").otherwise(""), F.col("text"))
    rows = table(spark, d, "conversations").select("conv_id", "turn", C.parsed_label(reply).alias("x"))
    return rows.select("conv_id", "turn", F.col("x.label").alias("label"), F.col("x.confidence").alias("confidence"), C.completion_probability(F.col("x")).alias("p_positive"))


def softmax_calibrate(spark, d):
    p = C.softmax_positive(F.col("value") / 100, F.lit(0.25))
    return table(spark, d, "events").select("event_id", F.round(p, 9).alias("p_positive"), F.round(C.calibrated(p, F.lit(0.7)), 9).alias("p_calibrated"))


def classify_static(spark, d):
    return _predictions(spark, d).select("query_id", F.round("p_positive", 6).alias("p_positive"))


def predict_label(spark, d):
    return _predictions(spark, d).select("query_id", "prediction")


def classification_metrics(spark, d):
    m = classify.metrics(_predictions(spark, d), C.POSITIVE)
    return m.select("n", *[F.round(c, 6).alias(c) for c in m.columns[1:]])


def confusion_matrix(spark, d):
    return classify.confusion(_predictions(spark, d), [C.POSITIVE, C.NEGATIVE])


def _dynamic_sql() -> str:
    side = lambda name: f"(select qid, avg(s) s from near where side = '{name}' and r <= {K} group by qid)"
    return f"""with {_POOL}, {_grams("q", "benchmark", "item_id")}, {_grams("p", "pool", "pos")},
shared as (select q.id qid, p.id pid, count(*) hits from q join p on q.g = p.g group by all),
alike as (select q_n.id qid, pool.pos, pool.side, coalesce(hits / (q_n.n + p_n.n - hits)::double, 0) s from q_n cross join pool join p_n on p_n.id = pool.pos left join shared on shared.qid = q_n.id and pid = pool.pos),
near as (select *, row_number() over (partition by qid, side order by s desc, pos) r from alike)
select x.qid query_id, round((1e-6 + x.s) / (2e-6 + x.s + y.s), 6) p_positive from {side("positive")} x join {side("negative")} y using (qid)"""


def _votek_sql(n: int, k: int) -> str:
    steps = [f"{_KNN}, t0 as (select vec_id pos, count(p) votes from embeddings left join (select p from ranked where r <= {k}) on p = vec_id group by vec_id)"]
    for i in range(n):
        steps.append(f"c{i} as (select pos from t{i} order by votes desc, pos limit 1)")
        steps.append(f"t{i + 1} as (select pos, case when pos in (select p from ranked where r <= {k} and q = (select pos from c{i})) then 0 else votes end votes from t{i} where pos <> (select pos from c{i}))")
    return "with " + ", ".join(steps) + " " + " union all ".join(f"select {i} rank, pos from c{i}" for i in range(n))


def _diversity_sql(k: int) -> str:
    steps = [f"{_POOL}, {_grams('p', 'pool', 'pos')}, d0 as (select side, pos, 0.0::double s from pool), c0 as (select side, min(pos) pos from pool group by side)"]
    for i in range(k - 1):
        steps.append(f"h{i} as (select c.side, a.id pos, count(*) n from c{i} c join p b on b.id = c.pos join p a on a.g = b.g group by all)")
        steps.append(f"d{i + 1} as (select d.side, d.pos, greatest(d.s, coalesce(h.n / (x.n + y.n - h.n)::double, 0)) s from d{i} d join c{i} c on c.side = d.side and c.pos <> d.pos join p_n x on x.id = d.pos join p_n y on y.id = c.pos left join h{i} h on h.side = d.side and h.pos = d.pos)")
        steps.append(f"c{i + 1} as (select side, pos from (select *, row_number() over (partition by side order by s, pos) r from d{i + 1}) where r = 1)")
    return "with " + ", ".join(steps) + " " + " union all ".join(f"select side, pos from c{i}" for i in range(k))


def _generated_sql(kind, target: int, both: bool) -> str:
    """The prompts of one round, the replies of ScriptedBackend to them, and the first texts that are wanted."""
    budget = (100_000 - generate.TEMPLATE_TOKENS - 1024) // (2 if both else 1)
    system = generate.system_message(kind).replace("'", "''")
    shown = "'Positive examples:' || chr(10) || coalesce(p, '(none)')" + (" || chr(10) || chr(10) || 'Negative examples:' || chr(10) || coalesce(n, '(none)')" if both else "")
    return f"""with recursive {_POOL},
offered as (select batch, side, pos, text, c, md5(batch || ':' || side || ':' || pos) k from pool, range({math.ceil(target / 3)}) b(batch) where c <= {budget}{"" if both else " and side = 'positive'"}),
queue as (select *, row_number() over (partition by batch, side order by k, pos) i from offered),
fold as (select batch, side, pos, i, c t, 1 held, true took from queue where i = 1
  union all select q.batch, q.side, q.pos, q.i, case when f.t + q.c <= {budget} and held < 5 then f.t + q.c else f.t end, case when f.t + q.c <= {budget} and held < 5 then held + 1 else held end, f.t + q.c <= {budget} and held < 5
  from fold f join queue q on q.batch = f.batch and q.side = f.side and q.i = f.i + 1),
taken as (select q.*, row_number() over (partition by batch, side order by k, pos) r from queue q semi join (select batch, side, pos from fold where took) f using (batch, side, pos)),
least as (select batch, case when count(*) = 2 then min(n) else 0 end most from (select batch, side, count(*) n from taken group by all) group by batch),
chosen as (select batch, side, text, row_number() over (partition by batch, side order by pos) i from taken join least using (batch) where {"r <= most" if both else "true"}),
lists as (select batch, string_agg(i || '. ' || text, chr(10) order by i) filter (side = 'positive') p, string_agg(i || '. ' || text, chr(10) order by i) filter (side = 'negative') n from chosen group by batch),
replies as (select batch, md5('{system}' || chr(10) || chr(10) || {shown} || chr(10) || chr(10) || 'Count: 3' || chr(10) || chr(10) || 'JSON:' || chr(10)) k from lists),
texts as (select row_number() over (order by batch, item) n, 'generated ' || k[1:8] || ' ' || item text from replies, range(3) i(item))
select d.doc_id pos, d.text, l.toxic label, false is_generated from documents d join labels l using (doc_id)
union all select (select max(pos) from pool) + n, text, (select max(toxic) from labels), true from texts where n <= {target}"""


def classify_dynamic(spark, d):
    """Every benchmark text, with the exemplars nearest to it."""
    model = classify.PromptClassifier(BackendFactory("lexical"), similarity.NearestSelector(), max_exemplars=K, context_limit=CONTEXT).fit(labelled_documents(spark, d))
    return model.predict_proba(table(spark, d, "benchmark").withColumnRenamed("item_id", "query_id")).select("query_id", F.round("p_positive", 6).alias("p_positive"))


def threshold_label(spark, d):
    return table(spark, d, "events").select("event_id", C.threshold_label(F.col("value") / 100).alias("label")).where("label is not null")


def _scored_events(spark, d):
    return threshold_label(spark, d).select(F.col("event_id").alias("pos"), F.col("label").alias("side"))


def sample_pools(spark, d):
    return pools.sample_pools(_scored_events(spark, d), 50, SEED)


def sample_eval_set(spark, d):
    return pools.sample_eval(_scored_events(spark, d), 50, 201, SEED)


def balanced_class_weight(spark, d):
    return pools.class_weights(table(spark, d, "labels"), "quality").select("quality", F.round("weight", 9).alias("weight"))


def accept_generated(spark, d):
    told = table(spark, d, "conversations").select(F.col("conv_id").alias("batch"), F.col("turn").alias("item"), "text")
    return generate.accept(told, table(spark, d, "documents"), None, None, positives=table(spark, d, "benchmark")).select("batch", "item")


def extract_json(spark, d):
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Here:\n```json\n"), "props", F.lit("\n```\nDone {x}"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("I say "), "props", F.lit(" as asked."))).otherwise(F.lit("no reply"))
    return table(spark, d, "events").select("event_id", C.extract_json(raw).alias("json"))


def numbered_list(spark, d):
    told = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("xs"))
    return told.select("conv_id", C.numbered(F.transform("xs", lambda x: x["text"])).alias("listing"))


def votek_select(spark, d):
    return spark.createDataFrame([(i, p) for i, p in enumerate(represent.vote_k(_vectors(spark, d), 10))], "rank int, pos bigint")


def kmeans_select(spark, d):
    return spark.createDataFrame([(i, p) for i, p in enumerate(represent.kmeans_representatives(_vectors(spark, d), 10))], "rank int, pos bigint")


def diversity_select(spark, d):
    return similarity.diverse(_pool(spark, d), K).select("side", "pos")


def train_classifier(spark, d):
    rows = labelled_documents(spark, d)
    return train.TrainedClassifier(class_weight="balanced").fit(rows).predict(rows.withColumnRenamed("pos", "query_id"))


class ScriptedBackend:
    """Replies that depend on the prompt alone, for queries and tests without a model."""

    def complete(self, prompt: str, *, temperature: float = 0.0, max_tokens: int = 0, stop=None) -> str:
        key = hashlib.md5(prompt.encode()).hexdigest()
        texts = [f"generated {key[:8]} {i}" for i in range(3)]
        if "hard_positives" in prompt:
            return json.dumps({"positive_features": [key[:4]], "negative_features": [], "boundary_features": [{"feature": key[4:8], "importance": 0.5}], "hard_positives": [{"text": t, "positive_evidence": [], "confusing_evidence": []} for t in texts]})
        return "```json\n" + json.dumps({"style_features": [key[:4]], "content_features": [], "synthetic_texts": [{"text": t, "generalized_from": []} for t in texts]}) + "\n```"


def oversample(spark, d):
    return generate.OverSampler(BackendFactory(ScriptedBackend), n_synthesized=12, max_examples=5).fit_resample(labelled_documents(spark, d))


def synthesize(spark, d):
    return generate.SyntheticSampler(BackendFactory(ScriptedBackend), n_synthesized=10, max_examples=5).fit_resample(labelled_documents(spark, d))


_ALL = [
    label_resolution, pool_sizes, token_count, char_ngrams_count, ngram_jaccard_pairs, near_duplicates, verbatim_span_docs, random_select_k, budget_select, trim_to_budget, class_balance, estimate_count, nearest_topk_lexical, nearest_topk_cosine,
    votek_votes, exemplar_prefix, query_suffix, parse_label, softmax_calibrate, classify_static, predict_label, classification_metrics, confusion_matrix, classify_dynamic, threshold_label, sample_pools, sample_eval_set, balanced_class_weight, accept_generated, extract_json, numbered_list,
    votek_select, kmeans_select, diversity_select, train_classifier, oversample, synthesize,
]


def queries() -> dict:
    return {q.__name__: q for q in _ALL}


_KNN = "near as (select a.vec_id q, b.vec_id p, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 12) s from embeddings a join embeddings b on a.vec_id <> b.vec_id), ranked as (select *, row_number() over (partition by q order by s desc, p) r from near)"
_EVENTS = "e as (select event_id pos, case when value / 100 <= 0.1 then 'positive' when value / 100 >= 0.5 then 'negative' end side from events), r as (select *, row_number() over (partition by side order by md5('0:' || side || ':' || pos), pos) n from e where side is not null)"
_REPLY = "(select conv_id, turn, lower(case turn % 4 when 0 then 'The label is positive. ' when 1 then 'NEGATIVE, not positive: ' when 2 then 'negative ' else '' end || text) r from conversations)"
_RATIO = lambda a, b: f"round(coalesce(({a})::double / nullif({b}, 0), 0), 6)"


def oracle_sql() -> dict[str, str]:
    return {
        "label_resolution": "select min(toxic) negative, max(toxic) positive from labels",
        "pool_sizes": f"with {_POOL} select side, count(*) n from pool group by side",
        "token_count": "select doc_id, (length(text) // 4 + 1)::bigint n_tokens from documents",
        "char_ngrams_count": f"with {_grams('q', 'documents', 'doc_id')} select id doc_id, n n_grams from q_n",
        "ngram_jaccard_pairs": f"with {_grams('q', 'benchmark', 'item_id')}, shared as (select a.id a, b.id b, count(*) c from q a join q b on a.g = b.g and a.id < b.id group by all) select x.id a, y.id b, round(case when (select text from benchmark where item_id = x.id) = (select text from benchmark where item_id = y.id) then 1 else coalesce(c / (x.n + y.n - c)::double, 0) end, 6) similarity from q_n x join q_n y on x.id < y.id left join shared on a = x.id and b = y.id",
        "near_duplicates": f"with {_NEAR} select qid doc_id, round(max(s), 6) best_similarity from alike where s >= {C.NEAR} group by qid",
        "verbatim_span_docs": f"with spans as (select distinct substr(text, i, {C.MIN_SPAN}) s from (select text, unnest(range(1, length(text) - {C.MIN_SPAN - 2})) i from benchmark where length(text) >= {C.MIN_SPAN})) select doc_id from documents d where exists (select 1 from spans where contains(d.text, s))",
        "random_select_k": f"with {_POOL} select side, pos from (select *, row_number() over (partition by side order by k, pos) r from keyed) where r <= {K}",
        "budget_select": f"with recursive {_POOL}, {_fold(str(BUDGET), 'k, pos')} select side, pos, rank from taken",
        "trim_to_budget": f"with recursive {_POOL}, {_fold(str(BUDGET), 'pos')} select side, pos, rank from taken",
        "class_balance": f"with {_POOL} select side, pos from (select *, row_number() over (partition by side order by k, pos) r from keyed) where r <= (select case when count(*) = 2 then min(n) else 0 end from (select side, count(*) n from pool group by side))",
        "estimate_count": f"with {_POOL} select side, greatest(1, floor({BUDGET} / avg(c)))::bigint n from (select *, row_number() over (partition by side order by pos) r from pool) where r <= 20 group by side",
        "nearest_topk_lexical": f"with {_NEAR}, grid as (select q_n.id query_id, p_n.id pos, coalesce(s, 0) s from q_n cross join p_n left join alike on qid = q_n.id and pid = p_n.id) select query_id, pos, round(s, 6) similarity, rank from (select *, row_number() over (partition by query_id order by s desc, pos) rank from grid) where rank <= {K}",
        "nearest_topk_cosine": f"with {_KNN} select q query_id, p pos, round(s, 6) cosine, r rank from ranked where r <= {K}",
        "votek_votes": f"with {_KNN} select vec_id pos, count(p) votes from embeddings left join (select p from ranked where r <= 10) on p = vec_id group by vec_id",
        "exemplar_prefix": f"with recursive {_POOL}, {_fold(str(BUDGET), 'k, pos')}, {_BALANCED}, placed as (select *, row_number() over (partition by side order by pos) i from even) select coalesce(string_agg('Text: ' || text || chr(10) || 'Label: ' || side || chr(10) || chr(10), '' order by i, side desc), '') prefix from placed",
        "query_suffix": "select conv_id, turn, 'Text: ' || text || chr(10) || 'Label:' suffix from conversations",
        "parse_label": f"select conv_id, turn, label, confidence, case when label = 'positive' then confidence else 1 - confidence end p_positive from (select conv_id, turn, case when n > 0 and (p = 0 or n < p) then 'negative' else 'positive' end label, (case when (p > 0) <> (n > 0) then 1 else 0.5 end)::double confidence from (select conv_id, turn, instr(r, 'positive') p, instr(r, 'negative') n from {_REPLY}))",
        "softmax_calibrate": "select event_id, round(p, 9) p_positive, round((p / 0.7::double) / (p / 0.7::double + (1 - p) / (1 - 0.7::double)), 9) p_calibrated from (select event_id, exp(value / 100 - greatest(value / 100, 0.25)) / (exp(value / 100 - greatest(value / 100, 0.25)) + exp(0.25 - greatest(value / 100, 0.25))) p from events)",
        "classify_static": f"{_SCORED} select query_id, round(p_positive, 6) p_positive from guessed",
        "predict_label": f"{_SCORED} select query_id, prediction from guessed",
        "classification_metrics": f"{_SCORED}, m as (select count(*) n, count(*) filter (truth = 'positive' and prediction = 'positive') tp, count(*) filter (truth <> 'positive' and prediction = 'positive') fp, count(*) filter (truth = 'positive' and prediction <> 'positive') fn, count(*) filter (truth <> 'positive' and prediction <> 'positive') tn, avg(greatest(p_positive, 1 - p_positive)) c from guessed) select n, {_RATIO('tp + tn', 'n')} accuracy, {_RATIO('tp', 'tp + fp')} precision_positive, {_RATIO('tp', 'tp + fn')} recall_positive, {_RATIO('2 * tp', '2 * tp + fp + fn')} f1_positive, {_RATIO('tn', 'tn + fn')} precision_negative, {_RATIO('tn', 'tn + fp')} recall_negative, {_RATIO('2 * tn', '2 * tn + fp + fn')} f1_negative, round(coalesce(c, 0), 6) mean_confidence from m",
        "confusion_matrix": f"{_SCORED} select t.s truth, g.s prediction, (select count(*) from guessed where truth = t.s and prediction = g.s) n from (values ('positive'), ('negative')) t(s) cross join (values ('positive'), ('negative')) g(s)",
        "classify_dynamic": _dynamic_sql(),
        "votek_select": _votek_sql(10, 10),
        "oversample": _generated_sql(HARD_POSITIVE, 12, True),
        "synthesize": _generated_sql(SYNTHETIC, 10, False),
        "diversity_select": _diversity_sql(K),
        "threshold_label": "select pos event_id, side label from (select event_id pos, case when value / 100 <= 0.1 then 'positive' when value / 100 >= 0.5 then 'negative' end side from events) where side is not null",
        "sample_pools": f"with {_EVENTS} select pos, side from r where n <= 50",
        "sample_eval_set": f"with {_EVENTS} select pos, side from r where n > 50 and n <= 50 + case when side = 'positive' then 100 else 101 end",
        "balanced_class_weight": "select quality, round((select count(*) from labels) / ((select count(distinct quality) from labels) * count(*))::double, 9) weight from labels group by quality",
        "accept_generated": f"with spans as (select distinct substr(text, i, {C.MIN_SPAN}) s from (select text, unnest(range(1, length(text) - {C.MIN_SPAN - 2})) i from benchmark where length(text) >= {C.MIN_SPAN})), firsts as (select *, row_number() over (partition by text order by conv_id, turn) r from conversations where text is not null) select conv_id batch, turn item from firsts f where r = 1 and text not in (select text from documents) and not exists (select 1 from spans where contains(f.text, s))",
        "extract_json": "select event_id, case event_id % 3 when 2 then 'no reply' else trim(props) end json from events",
        "numbered_list": "select conv_id, string_agg(i || '. ' || text, chr(10) order by i) listing from (select *, row_number() over (partition by conv_id order by turn, text) i from conversations) group by conv_id",
    }
