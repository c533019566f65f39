"""Queries: model paths (inputs, prompts, normalisers, answers, fallback),
batch scoring, valence and the ensemble."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonemill.functions import models as M
from tonemill.functions import valence as V
from tonemill.functions.numeric import py_round
from tonemill.functions.rules import to_percent
from tonemill.operators import ensemble, registry, scoring, valence
from tonemill.operators.labeling import with_rules_struct
from tonemill.plans.fixtures import (
    DEMO_VALENCE,
    demo_answer_sql,
    demo_classifier,
    demo_classifier_sql,
    demo_responder,
    demo_valence_rules,
    demo_valence_sql,
    failing_classifier,
    failing_classifier_sql,
    responses_table,
    review_view,
    review_view_sql,
)
from tonemill.plans.registry import query
from tonemill.session import scratch_path
from tonemill.plans.sql import (
    VALENCE_TOKEN_SQL,
    binary_sql,
    pct,
    plain_answer_sql,
    py_round_sql,
    q,
    rules_ctes,
    scored_answer_sql,
    ternary_sql,
    valence_ctes,
    valence_rules_sql,
    vote_sql,
)
from tonemill.sources.tables import load_table


def docs(spark, sf_dir):
    return load_table(spark, sf_dir, "documents")


_IN512 = "substring(coalesce(text, 'nan'), 1, 512)"
_IN500 = "substring(coalesce(text, 'nan'), 1, 500)"
_USER = f"({q(M.CHAT_USER_PREFIX)} || {_IN500})"
_PLAIN = f"({q(M.PLAIN_PROMPT_PREFIX)} || {_IN500})"


# --- T13, T16: model input and prompts -----------------------------------------
@query("model_input", f"SELECT doc_id, {_IN512} AS model_input FROM documents")
def q_model_input(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", M.model_input("text").alias("model_input"))


@query("build_prompts", f"SELECT doc_id, {q(M.CHAT_SYSTEM_PROMPT)} AS system_prompt, {_USER} AS user_prompt, "
                        f"{_PLAIN} AS plain_prompt FROM documents")
def q_build_prompts(spark, sf_dir):
    msgs = M.chat_messages("text")
    return docs(spark, sf_dir).select(
        "doc_id",
        msgs.getItem(0).getField("content").alias("system_prompt"),
        msgs.getItem(1).getField("content").alias("user_prompt"),
        M.plain_prompt("text").alias("plain_prompt"),
    )


# --- T14, T15: classifier output normalisation (raw scores, no fallback) -------
_LBL, _SCR = demo_classifier_sql(_IN512)


def _raw_scores(spark, sf_dir):
    return scoring.score_texts(docs(spark, sf_dir).select("doc_id", "text"), demo_classifier).select(
        "doc_id", "model_label", "model_score")


def _norm_sql(fn):
    lab, conf = fn("model_label", "model_score")
    return (f"WITH s AS (SELECT doc_id, {_LBL} AS model_label, {_SCR} AS model_score FROM documents) "
            f"SELECT doc_id, model_label, model_score, {lab} AS label, {pct(conf)} AS confidence FROM s")


def _norm_query(fn):
    def run(spark, sf_dir):
        res = fn(F.col("model_label"), F.col("model_score"))
        return _raw_scores(spark, sf_dir).withColumns(
            {"label": res.getField("label"), "confidence": to_percent(res.getField("confidence"))})
    return run


query("normalise_binary", _norm_sql(binary_sql))(_norm_query(M.normalise_binary))
query("normalise_ternary", _norm_sql(ternary_sql))(_norm_query(M.normalise_ternary))


# --- U3 + T20: classifier labeling with the rules fallback ----------------------
def _scorer_sql(src_sql: str, norm_sql, raw=(_LBL, _SCR)) -> str:
    lab, conf = norm_sql("m_label", "m_score")
    return (f"WITH src AS ({src_sql}), s AS (SELECT *, {raw[0]} AS m_label, {raw[1]} AS m_score FROM src), "
            f"n AS (SELECT *, {lab} AS n_label, {conf} AS n_conf FROM s), {rules_ctes('n').strip()} "
            f"SELECT doc_id, coalesce(n_label, r_label) AS label, {pct('coalesce(n_conf, r_conf)')} AS confidence "
            f"FROM r")


@query("label_with_scorer", _scorer_sql("SELECT doc_id, text FROM documents", ternary_sql))
def q_label_with_scorer(spark, sf_dir):
    out = scoring.label_with_scorer(docs(spark, sf_dir).select("doc_id", "text"), demo_classifier, "ternary")
    return out.select("doc_id", "label", "confidence")


@query("label_with_scorer_inplace", _scorer_sql("SELECT doc_id, text FROM documents", ternary_sql))
def q_label_with_scorer_inplace(spark, sf_dir):
    out = scoring.label_with_scorer(docs(spark, sf_dir).select("doc_id", "text"), demo_classifier, "ternary",
                                    distinct=False)
    return out.select("doc_id", "label", "confidence")


@query("label_with_fallback", _scorer_sql(review_view_sql(), binary_sql, failing_classifier_sql(_IN512)))
def q_label_with_fallback(spark, sf_dir):
    # The model raises on some inputs, has no label or no score for others.
    out = scoring.label_with_scorer(review_view(spark, sf_dir), failing_classifier, "binary")
    return out.select("doc_id", "label", "confidence")


@query("label_with_loaded_model", _scorer_sql(review_view_sql(), ternary_sql))
def q_label_with_loaded_model(spark, sf_dir):
    # The model is built once in every Python worker.
    model = scoring.load_once(lambda: demo_classifier)
    out = scoring.label_with_scorer(review_view(spark, sf_dir), model, "ternary")
    return out.select("doc_id", "label", "confidence")


# --- U3, U4 with a stored answer table: the second run asks the model nothing ----
@query("label_with_stored_scores", _scorer_sql(f"{review_view_sql()} UNION ALL SELECT doc_id, text, lang, source, n_chars FROM documents",
                                               ternary_sql))
def q_label_with_stored_scores(spark, sf_dir):
    answers = scratch_path(spark, "scores")
    reviews, plain = review_view(spark, sf_dir).select("doc_id", "text"), docs(spark, sf_dir).select("doc_id", "text")
    scoring.label_with_scorer(reviews, demo_classifier, answers=answers, batches=2)  # fills the table
    out = scoring.label_with_scorer(reviews.unionByName(plain), demo_classifier, answers=answers)
    return out.select("doc_id", "label", "confidence")


@query("label_sources", f"""WITH rv AS ({review_view_sql()}), s AS (SELECT *, {failing_classifier_sql(_IN512)[0]} AS m_label,
{failing_classifier_sql(_IN512)[1]} AS m_score FROM rv), n AS (SELECT {binary_sql('m_label', 'm_score')[0]} AS n_label FROM s)
SELECT CASE WHEN n_label IS NULL THEN 'rules' ELSE 'model' END AS source_of_label, count(*) AS documents FROM n GROUP BY ALL""")
def q_label_sources(spark, sf_dir):
    out = scoring.label_with_scorer(review_view(spark, sf_dir), failing_classifier, "binary", source_col="source_of_label")
    return out.groupBy("source_of_label").agg(F.count(F.lit(1)).alias("documents"))


# --- T17-T19, U4: answers ------------------------------------------------------


def _responses_sql() -> str:
    return f"SELECT doc_id, {demo_answer_sql('text')} AS response FROM documents"


def _parse_sql(fn) -> str:
    lab, conf = fn("response")
    return f"WITH a AS ({_responses_sql()}) SELECT doc_id, response, {lab} AS label, {pct(conf)} AS confidence FROM a"


def _parse_query(fn):
    def run(spark, sf_dir):
        res = fn(F.col("response"))
        return responses_table(spark, sf_dir).withColumns(
            {"label": res.getField("label"), "confidence": to_percent(res.getField("confidence"))})
    return run


query("parse_scored_answer", _parse_sql(scored_answer_sql))(_parse_query(M.parse_scored_answer))
query("parse_plain_answer", _parse_sql(plain_answer_sql))(_parse_query(M.parse_plain_answer))


def _answers_sql(src_sql: str, answer_expr: str, parse) -> str:
    lab, conf = parse("response")
    return (f"WITH src AS ({src_sql}), a AS (SELECT *, {answer_expr} AS response FROM src), "
            f"p AS (SELECT *, {lab} AS a_label, {conf} AS a_conf FROM a), {rules_ctes('p').strip()} "
            f"SELECT doc_id, coalesce(a_label, r_label) AS label, {pct('coalesce(a_conf, r_conf)')} AS confidence "
            f"FROM r")


@query("label_with_responses",
       _answers_sql("SELECT doc_id, text FROM documents", demo_answer_sql("text"), scored_answer_sql))
def q_label_with_responses(spark, sf_dir):
    out = scoring.label_with_responses(docs(spark, sf_dir).select("doc_id", "text"), "doc_id",
                                       responses_table(spark, sf_dir), "scored")
    return out.select("doc_id", "label", "confidence")


@query("label_with_stored_answers", _answers_sql(review_view_sql(), demo_answer_sql(_USER), scored_answer_sql))
def q_label_with_stored_answers(spark, sf_dir):
    answers = scratch_path(spark, "answers")
    reviews = review_view(spark, sf_dir)
    scoring.respond(reviews, demo_responder, "chat", answers=answers, batches=3)
    out = scoring.label_with_llm(reviews, demo_responder, "chat", answers=answers)
    return out.select("doc_id", "label", "confidence")


@query("label_with_repeated_answers", _answers_sql(
    f"SELECT doc_id, text FROM documents", f"least({demo_answer_sql('text')}, 'Negative 75 ' || (doc_id % 7))", scored_answer_sql))
def q_label_with_repeated_answers(spark, sf_dir):
    # Two answers for every document: the smallest text counts.
    first = responses_table(spark, sf_dir)
    second = docs(spark, sf_dir).select("doc_id", F.concat(F.lit("Negative 75 "), (F.col("doc_id") % 7).cast("string")).alias("response"))
    out = scoring.label_with_responses(docs(spark, sf_dir).select("doc_id", "text"), "doc_id", first.unionByName(second), "scored")
    return out.select("doc_id", "label", "confidence")


@query("label_with_llm", _answers_sql(review_view_sql(), demo_answer_sql(_USER), scored_answer_sql))
def q_label_with_llm(spark, sf_dir):
    out = scoring.label_with_llm(review_view(spark, sf_dir), demo_responder, "chat")
    return out.select("doc_id", "label", "confidence")


@query("label_with_llm_plain", _answers_sql(review_view_sql(), demo_answer_sql(_PLAIN), plain_answer_sql))
def q_label_with_llm_plain(spark, sf_dir):
    out = scoring.label_with_llm(review_view(spark, sf_dir), demo_responder, "plain")
    return out.select("doc_id", "label", "confidence")


# --- T11, T12: valence -----------------------------------------------------------
_VAL = valence_ctes("documents", "doc_id", demo_valence_sql()).strip()


@query("valence_compound", f"WITH {_VAL} SELECT doc_id, v_compound AS compound FROM v")
def q_valence_compound(spark, sf_dir):
    return valence.valence_compound(docs(spark, sf_dir).select("doc_id", "text"), DEMO_VALENCE).select(
        "doc_id", "compound")


@query("valence_compound_arrow", f"WITH {_VAL} SELECT doc_id, v_compound AS compound FROM v")
def q_valence_compound_arrow(spark, sf_dir):
    out = valence.valence_compound(docs(spark, sf_dir).select("doc_id", "text"), DEMO_VALENCE, strategy="arrow")
    return out.select("doc_id", "compound")


@query("valence_compound_join", f"WITH {_VAL} SELECT doc_id, v_compound AS compound FROM v")
def q_valence_compound_join(spark, sf_dir):
    out = valence.valence_compound(docs(spark, sf_dir).select("doc_id", "text"), DEMO_VALENCE, strategy="join")
    return out.select("doc_id", "compound")


# A lexicon of every word of the corpus, valences of five decimals.
_WORDS = "SELECT DISTINCT unnest(regexp_extract_all(lower(coalesce(text, 'nan')), " + q(VALENCE_TOKEN_SQL) + ", 0)) AS token FROM documents"
_COUNTED = " + ".join(f"(length(token) - length(replace(token, '{c}', ''))) * {k}" for c, k in (("e", 104729), ("n", 15485863), ("a", 32452843)))
_WORD_VALENCE = f"((length(token) * 7919 + {_COUNTED}) % 600001 - 300000)"
_CORPUS_VAL = valence_ctes("documents", "doc_id", f"(SELECT token, CAST({_WORD_VALENCE} AS DOUBLE) / CAST(100000.0 AS DOUBLE) AS valence "
                                                  f"FROM ({_WORDS})) AS lex").strip()


def corpus_lexicon(spark, sf_dir):
    words = docs(spark, sf_dir).select(F.explode(V.valence_tokens("text")).alias("token")).distinct()
    return words.select("token", (F.expr(_WORD_VALENCE).cast("double") / F.lit(100000.0)).alias("valence"))


@query("valence_corpus_arrow", f"WITH {_CORPUS_VAL} SELECT doc_id, v_compound AS compound FROM v")
def q_valence_corpus_arrow(spark, sf_dir):
    out = valence.valence_compound(docs(spark, sf_dir).select("doc_id", "text"), corpus_lexicon(spark, sf_dir),
                                   over="join")
    return out.select("doc_id", "compound")


@query("valence_corpus_join", f"WITH {_CORPUS_VAL} SELECT doc_id, v_compound AS compound FROM v")
def q_valence_corpus_join(spark, sf_dir):
    out = valence.valence_compound(docs(spark, sf_dir).select("doc_id", "text"), corpus_lexicon(spark, sf_dir),
                                   strategy="join")
    return out.select("doc_id", "compound")


@query("label_valence", f"WITH {_VAL} SELECT doc_id, v_compound AS compound, v_label AS label, "
                        f"{pct('v_conf')} AS confidence FROM v")
def q_label_valence(spark, sf_dir):
    out = valence.label_valence(docs(spark, sf_dir).select("doc_id", "text"), DEMO_VALENCE)
    return out.select("doc_id", "compound", "label", "confidence")


# --- O1, A6-A9: votes and the ensemble ------------------------------------------
_REV = f"rv AS ({review_view_sql()})"
_ENS_BASE = (f"{_REV}, {valence_ctes('rv', 'doc_id', demo_valence_sql()).strip()}, "
             f"{rules_ctes('v').strip()}, s AS (SELECT *, {_LBL} AS m_label, {_SCR} AS m_score FROM r), "
             f"n AS (SELECT *, {ternary_sql('m_label', 'm_score')[0]} AS n_label, "
             f"{ternary_sql('m_label', 'm_score')[1]} AS n_conf FROM s), "
             f"votes AS (SELECT doc_id, 'rules' AS model, 0 AS ord, r_label AS label, r_conf AS conf FROM n "
             f"UNION ALL SELECT doc_id, 'valence', 1, v_label, v_conf FROM n "
             f"UNION ALL SELECT doc_id, 'classifier', 2, coalesce(n_label, r_label), coalesce(n_conf, r_conf) FROM n)")


def _votes(spark, sf_dir):
    # All three labelers on one scan of the review view, then one row per vote.
    rv = review_view(spark, sf_dir).select("doc_id", "text")
    staged = with_rules_struct(rv, "text", out="r")
    staged = valence.with_valence_struct(staged, DEMO_VALENCE, out="v")
    staged = scoring.with_scorer_struct(staged, demo_classifier, "ternary", out="c", fallback_col="r")
    return ensemble.votes_from_results(staged, "doc_id", [("rules", "r"), ("valence", "v"), ("classifier", "c")])


_GAPS = (f"{_ENS_BASE}, given AS (SELECT doc_id, ord, label, conf FROM votes WHERE ord < 2 UNION ALL "
         f"SELECT doc_id, 2, n_label, n_conf FROM n WHERE n_label IS NOT NULL)")


@query("vote_with_gaps", f"WITH {_GAPS} SELECT form, doc_id, e_label AS label, {pct('e_conf')} AS confidence "
                         f"FROM {vote_sql('given', 'doc_id')} e, (VALUES ('wide'), ('long')) f(form)")
def q_vote_with_gaps(spark, sf_dir):
    # The classifier has no vote where it gave no result; both forms of the vote.
    staged = with_rules_struct(review_view(spark, sf_dir).select("doc_id", "text"), "text", out="r")
    staged = scoring.score_texts(valence.with_valence_struct(staged, DEMO_VALENCE, out="v"), demo_classifier)
    staged = staged.withColumn("c", M.normalise_ternary("model_label", "model_score"))
    wide = staged.select("doc_id", ensemble.ensemble_vote(F.col("r"), F.col("v"), F.col("c")).alias("e")).select("doc_id", "e.*")
    long = ensemble.ensemble_vote_long(ensemble.votes_from_results(staged, "doc_id", [("rules", "r"), ("valence", "v"), ("classifier", "c")]), "doc_id")
    both = wide.select(F.lit("wide").alias("form"), "*").unionByName(long.select(F.lit("long").alias("form"), "*"))
    return both.select("form", "doc_id", "label", to_percent(F.col("confidence")).alias("confidence"))


@query("votes_long", f"WITH {_ENS_BASE} SELECT doc_id, model, ord, label, {py_round_sql("conf", 9)} AS confidence "
                     f"FROM votes")
def q_votes_long(spark, sf_dir):
    rv = review_view(spark, sf_dir).select("doc_id", "text")
    rules = with_rules_struct(rv, "text", out="r")
    labeled = [
        ("rules", rules.select("doc_id", "r.*")),
        ("valence", valence.with_valence_struct(rv, DEMO_VALENCE, out="v").select("doc_id", "v.*")),
        ("classifier", scoring.with_scorer_struct(rules, demo_classifier, "ternary", out="c", fallback_col="r").select("doc_id", "c.*")),
    ]
    v = ensemble.votes_long("doc_id", labeled)
    return v.withColumn("ord", F.col("ord").cast("int")).withColumn("confidence", py_round("confidence", 9))


@query("ensemble_vote", f"WITH {_ENS_BASE} SELECT doc_id, e_label AS label, {pct('e_conf')} AS confidence "
                        f"FROM {vote_sql('votes', 'doc_id')} e")
def q_ensemble_vote(spark, sf_dir):
    out = ensemble.ensemble_vote_long(_votes(spark, sf_dir), "doc_id")
    return out.select("doc_id", "label", to_percent(F.col("confidence")).alias("confidence"))


@query("label_ensemble", f"WITH {_ENS_BASE} SELECT doc_id, e_label AS label, {pct('e_conf')} AS confidence "
                         f"FROM {vote_sql('votes', 'doc_id')} e")
def q_label_ensemble(spark, sf_dir):
    out = ensemble.label_ensemble(review_view(spark, sf_dir).select("doc_id", "text"),
                                  valence_lexicon=DEMO_VALENCE, classifier=demo_classifier)
    return out.select("doc_id", "label", "confidence")


@query("label_ensemble_join", f"WITH {_ENS_BASE} SELECT doc_id, e_label AS label, {pct('e_conf')} AS confidence "
                              f"FROM {vote_sql('votes', 'doc_id')} e")
def q_label_ensemble_join(spark, sf_dir):
    out = ensemble.label_ensemble(review_view(spark, sf_dir).select("doc_id", "text"), valence_lexicon=DEMO_VALENCE,
                                  valence_strategy="join", classifier=demo_classifier)
    return out.select("doc_id", "label", "confidence")


_ENS_FREE = (f"{_REV}, {valence_ctes('rv', 'doc_id', demo_valence_sql()).strip()}, {rules_ctes('v').strip()}, "
             f"votes AS (SELECT doc_id, 0 AS ord, r_label AS label, r_conf AS conf FROM r "
             f"UNION ALL SELECT doc_id, 1, v_label, v_conf FROM r)")


@query("label_ensemble_free", f"WITH {_ENS_FREE} SELECT doc_id, e_label AS label, {pct('e_conf')} AS confidence "
                              f"FROM {vote_sql('votes', 'doc_id')} e")
def q_label_ensemble_free(spark, sf_dir):
    out = ensemble.label_ensemble(review_view(spark, sf_dir).select("doc_id", "text"), valence_lexicon=DEMO_VALENCE)
    return out.select("doc_id", "label", "confidence")


_ENS_RULES_ONLY = (f"{_REV}, {rules_ctes('rv').strip()}, "
                   f"votes AS (SELECT doc_id, 0 AS ord, r_label AS label, r_conf AS conf FROM r "
                   f"UNION ALL SELECT doc_id, 1, r_label, r_conf FROM r)")


# --- U1, U2, U5: the registry ----------------------------------------------------
@query("label_dataset", f"WITH {_ENS_RULES_ONLY} SELECT doc_id, e_label AS label, {pct('e_conf')} AS confidence "
                        f"FROM {vote_sql('votes', 'doc_id')} e")
def q_label_dataset(spark, sf_dir):
    # The ensemble without a valence lexicon: the rules vote twice.
    out = registry.label_dataset(review_view(spark, sf_dir).select("doc_id", "text"), "Ensemble (Hybrid)")
    return out.select("doc_id", "label", "confidence")


@query("label_dataset_gemini", _answers_sql(review_view_sql(), demo_answer_sql(_PLAIN), plain_answer_sql))
def q_label_dataset_gemini(spark, sf_dir):
    out = registry.label_dataset(review_view(spark, sf_dir), "Google Gemini Pro", api_key="demo",
                                 responder=demo_responder)
    return out.select("doc_id", "label", "confidence")




# Every registry entry through the dispatcher, with its resources.
def _dataset_query(model, **resources):
    def run(spark, sf_dir):
        out = registry.label_dataset(review_view(spark, sf_dir).select("doc_id", "text"), model, **resources)
        return out.select("doc_id", "label", "confidence")
    return run


_VAL_REV = (f"WITH {_REV}, {valence_ctes('rv', 'doc_id', demo_valence_sql()).strip()} "
            f"SELECT doc_id, v_label AS label, {pct('v_conf')} AS confidence FROM v")

query("label_dataset_vader", _VAL_REV)(_dataset_query("VADER (Social Media)", valence_lexicon=DEMO_VALENCE))
query("label_dataset_distilbert", _scorer_sql(review_view_sql(), binary_sql))(
    _dataset_query("DistilBERT (AI)", classifier=demo_classifier))
query("label_dataset_roberta", _scorer_sql(review_view_sql(), ternary_sql))(
    _dataset_query("RoBERTa (Best Free)", classifier=demo_classifier))
query("label_dataset_openai", _answers_sql(review_view_sql(), demo_answer_sql(_USER), scored_answer_sql))(
    _dataset_query("OpenAI GPT-3.5", api_key="demo", responder=demo_responder))
query("label_dataset_ensemble_full", f"WITH {_ENS_BASE} SELECT doc_id, e_label AS label, {pct('e_conf')} AS confidence "
                                     f"FROM {vote_sql('votes', 'doc_id')} e")(
    _dataset_query("Ensemble (Hybrid)", valence_lexicon=DEMO_VALENCE, classifier=demo_classifier))


@query("valence_rules", valence_rules_sql("documents", "doc_id", DEMO_VALENCE, demo_valence_rules()))
def q_valence_rules(spark, sf_dir):
    out = valence.valence_compound(docs(spark, sf_dir).select("doc_id", "text"), DEMO_VALENCE,
                                   rules=demo_valence_rules())
    return out.select("doc_id", "compound")


@query("valence_rules_join", valence_rules_sql("documents", "doc_id", DEMO_VALENCE, demo_valence_rules()))
def q_valence_rules_join(spark, sf_dir):
    out = valence.valence_compound(docs(spark, sf_dir).select("doc_id", "text"), DEMO_VALENCE, strategy="join", rules=demo_valence_rules())
    return out.select("doc_id", "compound")


@query("valence_rules_arrow", valence_rules_sql("documents", "doc_id", DEMO_VALENCE, demo_valence_rules()))
def q_valence_rules_arrow(spark, sf_dir):
    out = valence.valence_compound(docs(spark, sf_dir).select("doc_id", "text"), DEMO_VALENCE, strategy="arrow",
                                   rules=demo_valence_rules())
    return out.select("doc_id", "compound")
