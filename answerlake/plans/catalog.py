"""Named queries over the test tables: ``name -> fn(spark, sf_dir) -> DataFrame``.

Every query reads whole tables.  Output columns are aliased and typed
(BIGINT for integers, DOUBLE rounded to 6 places for scores) so that they
line up with the SQL oracle in ``plans/oracle.py``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerlake.functions.text import is_blank
from answerlake.operators import retrieval as R
from answerlake.operators.chunking import pack_greedy, pack_prefix, pack_stats, with_token_counts
from answerlake.plans import corpus as C

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}


def query(name: str):
    def register(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        return fn
    return register


def r6(col) -> F.Column:
    return F.round(F.col(col) if isinstance(col, str) else col, 6)


def big(col) -> F.Column:
    return (F.col(col) if isinstance(col, str) else col).cast("bigint")


# ------------------------------------------------------------ paragraphs ----

@query("paragraphs")
def q_paragraphs(spark, sf):
    p = C.raw_paragraphs(spark, sf)
    return p.select(big("doc_id").alias("doc_id"), big("para_idx").alias("para_idx"),
                    big(F.length("text")).alias("n_chars"), "text")


@query("paragraph_counts")
def q_paragraph_counts(spark, sf):
    p = C.paragraphs(spark, sf)
    return (p.groupBy("source")
            .agg(F.count_distinct("doc_id").alias("n_docs"),
                 F.count("*").alias("n_paragraphs"),
                 big(F.sum(is_blank("text").cast("int"))).alias("n_blank")))


@query("normalize_text")
def q_normalize_text(spark, sf):
    p = C.paragraphs(spark, sf)
    return p.select(big("doc_id").alias("doc_id"), big("para_idx").alias("para_idx"), "text",
                    big(is_blank("text").cast("int")).alias("is_blank"))


# -------------------------------------------------------------- chunking ----

def _chunk_rows(df: DataFrame) -> DataFrame:
    return df.select(big("doc_id").alias("doc_id"), big("para_idx").alias("para_idx"),
                     big("piece_idx").alias("piece_idx"), big(F.length("text")).alias("n_chars"), "text")


@query("chunk_chars")
def q_chunk_chars(spark, sf):
    return _chunk_rows(C.char_chunks(spark, sf, C.CHUNK_CHARS))


@query("chunk_chars_drop_exact")
def q_chunk_chars_drop_exact(spark, sf):
    return _chunk_rows(C.char_chunks(spark, sf, C.CHUNK_CHARS, drop_exact=True))


def _token_paragraphs(spark, sf) -> DataFrame:
    return with_token_counts(C.paragraphs(spark, sf))


@query("chunk_tokens_greedy")
def q_chunk_tokens_greedy(spark, sf):
    packs = pack_greedy(_token_paragraphs(spark, sf), C.PACK_TOKENS)
    return pack_stats(packs).select(big("doc_id").alias("doc_id"), big("pack_id").alias("pack_id"),
                                     big("n_paragraphs").alias("n_paragraphs"), "n_tokens")


@query("chunk_tokens_prefix")
def q_chunk_tokens_prefix(spark, sf):
    p = pack_prefix(_token_paragraphs(spark, sf), C.PACK_TOKENS)
    return pack_stats(p).select(big("doc_id").alias("doc_id"), big("pack_id").alias("pack_id"),
                                big("n_paragraphs").alias("n_paragraphs"), "n_tokens")


# ---------------------------------------------------------------- tf-idf ----

@query("token_stats")
def q_token_stats(spark, sf):
    from answerlake.functions.text import terms
    ch = with_token_counts(C.char_chunks(spark, sf))
    return ch.select(big("doc_id").alias("doc_id"), big("para_idx").alias("para_idx"),
                     big("piece_idx").alias("piece_idx"), "n_tokens",
                     big(F.size(terms("text"))).alias("n_terms_total"),
                     big(F.size(F.array_distinct(terms("text")))).alias("n_terms_distinct"))


@query("tfidf_idf")
def q_tfidf_idf(spark, sf):
    idf = C.chunk_index(spark, sf).idf
    return idf.select("term", big("df").alias("df"), r6("idf").alias("idf"))


@query("tfidf_postings")
def q_tfidf_postings(spark, sf):
    post = C.chunk_index(spark, sf).postings
    return post.select(big("doc_id").alias("doc_id"), big("para_idx").alias("para_idx"),
                       big("piece_idx").alias("piece_idx"), "term", big("tf").alias("tf"),
                       r6("weight").alias("weight"))


# ------------------------------------------------------------- retrieval ----

def _top1(spark, sf, allow_zero: bool) -> DataFrame:
    ix = C.paragraph_index(spark, sf)
    best = C.score_top1(C.question_vectors(spark, sf, ix.idf), ix, ["item_id"], C.PARA_KEYS)
    qs = C.questions(spark, sf).select("item_id")
    if allow_zero:
        # Literal variant: with no term overlap the first paragraph of the
        # corpus wins with score 0 (unless its text is empty).
        first = ix.units.agg(F.min(F.struct(*[F.col(k) for k in C.PARA_KEYS]))).scalar()
        zero = (qs.join(best.select("item_id"), "item_id", "left_anti")
                .select("item_id", *[first.getField(k).alias(k) for k in C.PARA_KEYS],
                        F.lit(0.0).alias("score")))
        best = best.unionByName(zero)
    return top1_answers(qs, best, stored_paragraphs(ix.units))


def top1_answers(qs: DataFrame, best: DataFrame, paras: DataFrame) -> DataFrame:
    """One answer row per question: its best paragraph with text and file, or
    the fixed response where there is none."""
    hits = (best.join(paras, list(C.PARA_KEYS))
            .filter(F.col("retrieved_text") != F.lit("")))
    out = R.with_fallback(qs, hits, ["item_id"])
    return out.select(big("item_id").alias("item_id"), big("doc_id").alias("doc_id"),
                      big("para_idx").alias("para_idx"), r6("score").alias("score"),
                      "filename", "retrieved_text", "response")


@query("retrieve_top1")
def q_retrieve_top1(spark, sf):
    return _top1(spark, sf, allow_zero=False)


@query("retrieve_top1_allow_zero")
def q_retrieve_top1_allow_zero(spark, sf):
    return _top1(spark, sf, allow_zero=True)


def threshold_hits(spark, sf, ix=None) -> DataFrame:
    ix = ix or C.chunk_index(spark, sf)
    return C.score_threshold(C.question_vectors(spark, sf, ix.idf), ix, C.CHUNK_KEYS, C.THRESHOLD)


@query("retrieve_threshold")
def q_retrieve_threshold(spark, sf):
    hits = threshold_hits(spark, sf)
    return hits.select(big("item_id").alias("item_id"), big("doc_id").alias("doc_id"),
                       big("para_idx").alias("para_idx"), big("piece_idx").alias("piece_idx"),
                       r6("score").alias("score"))


@query("pruned_threshold")
def q_pruned_threshold(spark, sf):
    """The same rows from posting blocks: only those whose bounds reach the threshold are scored."""
    from answerlake.operators.pruned import Search
    hits = Search(C.chunk_blocks(spark, sf), C.questions(spark, sf), ["item_id"]).above(C.THRESHOLD)
    return hits.select(big("item_id").alias("item_id"), big("doc_id").alias("doc_id"),
                       big("para_idx").alias("para_idx"), big("piece_idx").alias("piece_idx"),
                       r6("score").alias("score"))


@query("retrieve_best_per_pack")
def q_retrieve_best_per_pack(spark, sf):
    p = _token_paragraphs(spark, sf)
    packs = pack_greedy(p, C.PACK_TOKENS).select("doc_id", "para_idx", "pack_id")
    ix = C.paragraph_index(spark, sf)
    qv = C.question_vectors(spark, sf, ix.idf)
    best = C.score_group_best(qv, ix, packs, ["doc_id", "pack_id"], ["para_idx"])
    return best.select(big("item_id").alias("item_id"), big("doc_id").alias("doc_id"),
                       big("pack_id").alias("pack_id"), big("para_idx").alias("para_idx"),
                       r6("score").alias("score"))


# ----------------------------------------------------------------- dense ----

def dense_questions(spark, sf) -> DataFrame:
    """Question vectors: the stored vector of each question id stands in for
    the embedding model (newlines become spaces first; missing ones are
    skipped, P9)."""
    from answerlake.sources.tables import table
    q = C.questions(spark, sf).withColumn("text", F.translate("text", "\n", " "))
    emb = table(spark, sf, "embeddings").filter(F.col("embedding").isNotNull())
    return q.join(emb.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("qvec")), "item_id")


def _dense(spark, sf, farthest: bool) -> DataFrame:
    from answerlake.sources.tables import table
    emb = table(spark, sf, "embeddings").select("vec_id", "embedding")
    d = R.dense_topk_candidates(dense_questions(spark, sf), emb, C.TOP_K, q_key="item_id", q_vec="qvec",
                                farthest=farthest)
    top = R.dense_topk(d, C.TOP_K, q_key="item_id", farthest=farthest)
    return top.select(big("item_id").alias("item_id"), big("vec_id").alias("vec_id"),
                      big("rank").alias("rank"), r6("distance").alias("distance"))


@query("dense_topk_nearest")
def q_dense_topk_nearest(spark, sf):
    return _dense(spark, sf, farthest=False)


@query("dense_topk_farthest")
def q_dense_topk_farthest(spark, sf):
    return _dense(spark, sf, farthest=True)


def _dense_pruned(spark, sf, farthest: bool) -> DataFrame:
    """The same rows from vectors grouped around pivots: only groups whose bounds can matter are met."""
    from answerlake.operators.pivots import Groups
    from answerlake.sources.tables import table
    groups = Groups(table(spark, sf, "embeddings").select("vec_id", "embedding"))
    asked = dense_questions(spark, sf).select("item_id", "qvec")
    top = groups.topk(asked, C.TOP_K, q_key="item_id", farthest=farthest)
    return top.select(big("item_id").alias("item_id"), big("vec_id").alias("vec_id"),
                      big("rank").alias("rank"), r6("distance").alias("distance"))


@query("dense_pruned_nearest")
def q_dense_pruned_nearest(spark, sf):
    return _dense_pruned(spark, sf, farthest=False)


@query("dense_pruned_farthest")
def q_dense_pruned_farthest(spark, sf):
    return _dense_pruned(spark, sf, farthest=True)


@query("embed_join_filter")
def q_embed_join_filter(spark, sf):
    q = dense_questions(spark, sf)
    return q.select(big("item_id").alias("item_id"), big(F.length("text")).alias("n_chars"),
                    big(F.size("qvec")).alias("dim"))


# ----------------------------------------------------------------- votes ----

def order_votes(spark, sf) -> DataFrame:
    """Test role: ``orders`` as vote records; priority = category, status F/O =
    the two candidates, P = no vote."""
    from answerlake.sources.inline import CANDIDATES
    from answerlake.sources.tables import table
    o = table(spark, sf, "orders").select("o_orderpriority", "o_orderstatus")
    vote = (F.when(F.col("o_orderstatus") == "F", F.lit(CANDIDATES[0]))
            .when(F.col("o_orderstatus") == "O", F.lit(CANDIDATES[1])))
    return o.select(F.col("o_orderpriority").alias("category"), vote.alias("vote"))


@query("vote_counts")
def q_vote_counts(spark, sf):
    from answerlake.operators.votes import vote_counts
    return vote_counts(order_votes(spark, sf))


@query("vote_pivot")
def q_vote_pivot(spark, sf):
    from answerlake.operators.votes import vote_pivot
    return vote_pivot(order_votes(spark, sf))


@query("vote_percent")
def q_vote_percent(spark, sf):
    from answerlake.operators.votes import percent_label, vote_percent, vote_pivot
    from answerlake.sources.inline import CANDIDATES
    p = vote_percent(vote_pivot(order_votes(spark, sf)))
    return p.select("category", *[f"{c}_pct" for c in CANDIDATES],
                    *[percent_label(f"{c}_pct").alias(f"{c}_label") for c in CANDIDATES])


@query("top_categories")
def q_top_categories(spark, sf):
    from answerlake.operators.votes import total_label, vote_pivot
    p = vote_pivot(order_votes(spark, sf))
    return p.select("category", "total", total_label("total").alias("label")).orderBy("total", "category")


# ------------------------------------------------------------ engagement ----

def _events(spark, sf) -> DataFrame:
    from answerlake.operators.engagement import engagement_events
    from answerlake.sources.tables import table
    return engagement_events(table(spark, sf, "events"))


def _milestones(spark, sf) -> DataFrame:
    from answerlake.operators.engagement import milestone_events, milestones
    from answerlake.sources.inline import badge_rules
    return milestones(milestone_events(_events(spark, sf)), badge_rules(spark))


@query("milestones")
def q_milestones(spark, sf):
    m = _milestones(spark, sf)
    return m.select(big("user_id").alias("user_id"), big("badge_id").alias("badge_id"),
                    big("event_id").alias("event_id"))


def _badges_earned(spark, sf) -> DataFrame:
    from answerlake.operators.engagement import award_once, streak_badges, streaks, vote_days
    m = _milestones(spark, sf).select("user_id", "badge_id", F.to_date("ts").alias("earned_day"))
    votes = _events(spark, sf).filter(F.col("kind") == "vote")
    s = streak_badges(streaks(vote_days(votes))).select("user_id", "badge_id", "earned_day")
    return award_once(m.unionByName(s), "earned_day")


@query("badges_earned")
def q_badges_earned(spark, sf):
    b = _badges_earned(spark, sf)
    return b.select(big("user_id").alias("user_id"), big("badge_id").alias("badge_id"),
                    F.date_format("earned_day", "yyyy-MM-dd").alias("earned_day"))


@query("badge_names")
def q_badge_names(spark, sf):
    from pyspark.sql import Window
    from answerlake.sources.inline import badges
    b = _badges_earned(spark, sf).join(F.broadcast(badges(spark)), "badge_id")
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("earned_day", "badge_id")) - 1
    return b.select(big("user_id").alias("user_id"), big("badge_id").alias("badge_id"), "name",
                    F.when(pos % 2 == 0, F.lit("left")).otherwise(F.lit("right")).alias("list_side"))


@query("vote_streaks")
def q_vote_streaks(spark, sf):
    from answerlake.operators.engagement import streaks, vote_days
    votes = _events(spark, sf).filter(F.col("kind") == "vote")
    s = streaks(vote_days(votes))
    return s.select(big("user_id").alias("user_id"),
                    F.date_format("start_day", "yyyy-MM-dd").alias("start_day"),
                    F.date_format("end_day", "yyyy-MM-dd").alias("end_day"), big("length").alias("length"))


@query("session_counters")
def q_session_counters(spark, sf):
    from answerlake.operators.engagement import props_k
    from answerlake.sources.inline import EVENT_KINDS, lit_map
    from answerlake.sources.tables import table
    ev = table(spark, sf, "events")
    kind = F.element_at(lit_map(EVENT_KINDS), F.col("event_type"))
    # an answer and its key agree where their parities do
    right = F.pmod(props_k(), F.lit(2)) == F.pmod(F.floor("value"), F.lit(2))
    return ev.groupBy(big("user_id").alias("user_id")).agg(
        F.count_if(kind == "question").alias("n_questions"),
        F.count_if(kind == "vote").alias("n_votes"),
        F.count_if(kind == "topic_click").alias("n_topic_clicks"),
        F.count_if((kind == "quiz_answer") & right).alias("n_correct"),
        F.count_if((kind == "quiz_answer") & ~right).alias("n_incorrect"),
        F.count_if(F.col("event_type") == "error").alias("n_failed_asks"))


@query("quiz_score")
def q_quiz_score(spark, sf):
    from answerlake.operators.engagement import quiz_correct
    e = _events(spark, sf).filter(F.col("kind") == "quiz_answer")
    corr = quiz_correct(F.col("answer"), F.col("answer_key"))
    return e.groupBy("user_id").agg(big(F.count_if(corr)).alias("correct"),
                                    big(F.count_if(~corr)).alias("incorrect")) \
        .select(big("user_id").alias("user_id"), "correct", "incorrect")


def first_votes(spark, sf) -> DataFrame:
    """Votes matched to the voter's latest question; the first vote per
    question counts (later ones are ignored, as the disabled buttons do)."""
    from answerlake.operators.engagement import latest_before, props_k, slot_a_candidate
    from answerlake.operators.votes import first_per_key
    from answerlake.sources.inline import CANDIDATES
    e = _events(spark, sf)
    qs = e.filter(F.col("kind") == "question").select("user_id", "ts", "event_id")
    votes = e.filter(F.col("kind") == "vote").select("user_id", "ts", "event_id", "k")
    matched = latest_before(qs, votes, "user_id", "event_id", out="question_id",
                            carry=["k"]).filter(F.col("question_id").isNotNull())
    first = first_per_key(matched, ["question_id"], ["ts", "event_id"])
    slot = F.when(F.pmod(F.col("k"), F.lit(2)) == 0, F.lit("A")).otherwise(F.lit("B"))
    a = slot_a_candidate("question_id")
    other = F.when(a == F.lit(CANDIDATES[0]), F.lit(CANDIDATES[1])).otherwise(F.lit(CANDIDATES[0]))
    return first.select("question_id", "user_id", F.col("event_id").alias("vote_id"), slot.alias("slot"),
                        F.when(slot == "A", a).otherwise(other).alias("candidate"))


@query("first_vote_per_question")
def q_first_vote_per_question(spark, sf):
    f = first_votes(spark, sf)
    return f.select(big("question_id").alias("question_id"), big("user_id").alias("user_id"),
                    big("vote_id").alias("vote_id"), "slot", "candidate")


@query("vote_tally_winner")
def q_vote_tally_winner(spark, sf):
    from answerlake.operators.votes import winner
    from answerlake.sources.inline import CANDIDATES, DISPLAY_NAMES
    a, b = CANDIDATES
    f = first_votes(spark, sf)
    t = f.groupBy("user_id").agg(F.count_if(F.col("candidate") == a).alias(a),
                                 F.count_if(F.col("candidate") == b).alias(b))
    return t.select(big("user_id").alias("user_id"), big(a).alias(a), big(b).alias(b),
                    winner(F.col(a), F.col(b), DISPLAY_NAMES[a], DISPLAY_NAMES[b]).alias("winner"))


@query("answer_summary")
def q_answer_summary(spark, sf):
    from answerlake.operators.votes import display_name
    e = _events(spark, sf).filter(F.col("kind") == "question")
    f = first_votes(spark, sf).select("question_id", F.col("candidate").alias("picked"))
    out = e.select(F.col("event_id").alias("question_id"), "user_id").join(f, "question_id", "left")
    return out.select(big("question_id").alias("question_id"), big("user_id").alias("user_id"), "picked",
                      display_name(F.col("picked")).alias("picked_name"))


@query("blind_assignment")
def q_blind_assignment(spark, sf):
    from answerlake.operators.engagement import blind_assignment
    a = blind_assignment(C.questions(spark, sf), "item_id")
    return a.select(big("item_id").alias("item_id"), "slot", "candidate")


SAMPLE_SEED = "debate"


@query("sample_questions")
def q_sample_questions(spark, sf):
    from answerlake.operators.engagement import sample_n
    s = sample_n(C.questions(spark, sf), 3, SAMPLE_SEED, "item_id")
    return s.select(big("item_id").alias("item_id"), "text")


@query("candidate_prompts")
def q_candidate_prompts(spark, sf):
    from answerlake.operators.engagement import blind_assignment
    from answerlake.operators.prompts import candidate_prompts
    from answerlake.sources.inline import templates
    qs = C.questions(spark, sf)
    p = candidate_prompts(qs, blind_assignment(qs, "item_id"), templates(spark), "item_id")
    return p.select(big("item_id").alias("item_id"), "slot", "candidate", "prompt")


@query("debate_day_first")
def q_debate_day_first(spark, sf):
    """Declared only: one eligible debate per day, the day resetting at 13:00."""
    e = _events(spark, sf).filter(F.col("kind") == "vote")
    day = F.window(F.col("ts"), "1 day", "1 day", "13 hours").getField("start")
    first = e.groupBy("user_id", day.alias("day_start")).agg(
        F.min(F.struct("ts", "event_id")).getField("event_id").alias("first_vote_id"),
        F.count("*").alias("n_votes"))
    return first.select(big("user_id").alias("user_id"),
                        F.date_format("day_start", "yyyy-MM-dd HH:mm:ss").alias("day_start"),
                        big("first_vote_id").alias("first_vote_id"), big("n_votes").alias("n_votes"))


# --------------------------------------------------------------- prompts ----

def chunk_hits_with_text(spark, sf) -> DataFrame:
    """Threshold hits with their chunk text and file name."""
    ix = C.chunk_index(spark, sf)
    hits = threshold_hits(spark, sf, ix)
    chunks = C.filename(ix.units).select(*C.CHUNK_KEYS, "text", "filename")
    return hits.join(chunks, list(C.CHUNK_KEYS))


def _context_prompts(spark, sf) -> DataFrame:
    from answerlake.operators.prompts import assemble_prompts, budgeted_contexts
    # counts and heads both read the hits: score once
    from answerlake.session import stored
    hits = stored(chunk_hits_with_text(spark, sf), "context-hits")
    ctx = budgeted_contexts(hits, "item_id", list(C.CHUNK_KEYS))
    return assemble_prompts(C.questions(spark, sf), ctx, "item_id")


@query("context_prompts")
def q_context_prompts(spark, sf):
    p = _context_prompts(spark, sf)
    return p.select(big("item_id").alias("item_id"),
                    big(F.coalesce("n_contexts", F.lit(0))).alias("n_contexts"),
                    big("prompt_tokens").alias("prompt_tokens"), big("truncated").alias("truncated"),
                    "prompt", "response")


@query("prompt_budget")
def q_prompt_budget(spark, sf):
    """Endpoint variant: the single top-1 paragraph as context, budget 2000."""
    from answerlake.functions.text import token_count
    from answerlake.operators.prompts import assemble_prompts
    top = _top1(spark, sf, allow_zero=False).filter(F.col("response").isNull())
    ctx = top.select("item_id", F.lit(1).alias("n_contexts"), token_count("retrieved_text").alias("context_tokens"),
                     F.array("retrieved_text").alias("contexts"), F.array("filename").alias("filenames"))
    p = assemble_prompts(C.questions(spark, sf), ctx, "item_id")
    return p.select(big("item_id").alias("item_id"), big("prompt_tokens").alias("prompt_tokens"),
                    big("truncated").alias("truncated"), big(token_count("prompt")).alias("final_tokens"),
                    "response")


@query("contexts_json")
def q_contexts_json(spark, sf):
    """each retrieved context and its file as JSON text (as at the
    sink), parsed back; per-question checks use partial aggregates only."""
    hits = chunk_hits_with_text(spark, sf)
    j = hits.withColumn("_json", F.to_json(F.array("text", "filename")))
    back = F.from_json("_json", "array<string>")
    per = j.select("item_id", *C.CHUNK_KEYS, F.element_at(back, 1).alias("_ctx"), F.element_at(back, 2).alias("_file"))
    pos = F.struct(*[F.col(k) for k in C.CHUNK_KEYS])
    agg = per.groupBy("item_id").agg(F.count("*").alias("n_contexts"),
                                     F.min_by("_ctx", pos).alias("first_context"),
                                     F.max_by("_file", pos).alias("last_filename"))
    return agg.select(big("item_id").alias("item_id"), big("n_contexts").alias("n_contexts"),
                      "first_context", "last_filename")


# -------------------------------------------------------------- payloads ----

def _turns(spark, sf) -> DataFrame:
    from answerlake.sources.tables import table
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")


@query("chat_requests")
def q_chat_requests(spark, sf):
    from answerlake.functions.payloads import chat_request, parse_chat_request
    from answerlake.sources.inline import SYSTEM_CHAT
    u = _turns(spark, sf).filter(F.col("role") == "user")
    body = chat_request(F.lit(SYSTEM_CHAT), F.col("text"))
    back = parse_chat_request(body)
    return u.select(big("conv_id").alias("conv_id"), big("turn").alias("turn"),
                    back.getField("model").alias("model"),
                    big(F.size(back.getField("messages"))).alias("n_messages"),
                    F.element_at(back.getField("messages"), 2).getField("content").alias("user_content"),
                    big(back.getField("max_tokens")).alias("max_tokens"),
                    back.getField("temperature").alias("temperature"))


@query("chat_response_parse")
def q_chat_response_parse(spark, sf):
    """F8 + P25: assistant turns wrapped as completion responses (padded
    content); system turns stand in for malformed bodies."""
    from answerlake.functions.payloads import chat_response_body, response_content
    t = _turns(spark, sf).filter(F.col("role").isin("assistant", "system"))
    padded = F.concat(F.lit("  "), F.col("text"), F.lit("\n"))
    body = F.when(F.col("role") == "assistant",
                  chat_response_body(padded, F.concat(F.lit("resp-"), F.col("conv_id").cast("string"))))\
        .otherwise(F.col("text"))
    content = response_content(body)
    return t.select(big("conv_id").alias("conv_id"), big("turn").alias("turn"), content.alias("content"),
                    F.when(content.isNull(), F.lit("unparseable")).otherwise(F.lit("ok")).alias("status"))


@query("embedding_parse")
def q_embedding_parse(spark, sf):
    from answerlake.functions.payloads import embedding_body, embedding_vector
    from answerlake.sources.tables import table
    e = table(spark, sf, "embeddings").filter(F.col("embedding").isNotNull())
    v = embedding_vector(embedding_body(F.col("embedding")))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))
    return e.select(big("vec_id").alias("vec_id"), big(F.size(v)).alias("dim"),
                    r6(norm).alias("norm"), r6(F.element_at(v, 1)).alias("first"))


def page_messages(spark, sf) -> DataFrame:
    """Answer texts with a cited link, built from ``pages``: the page title,
    then its URL twice (only the first occurrence is the reference)."""
    from answerlake.sources.tables import table
    p = table(spark, sf, "pages").select("page_id", "url", "html")
    title = F.regexp_extract("html", r"<title>([^<]*)</title>", 1)
    msg = F.concat(title, F.lit(" "), F.col("url"), F.lit(" see also "), F.col("url"), F.lit(" "))
    return p.select("page_id", "url", msg.alias("message"))


@query("reference_extract")
def q_reference_extract(spark, sf):
    from answerlake.functions.payloads import extract_reference
    m = page_messages(spark, sf)
    text, ref = extract_reference(F.col("message"))
    return m.select(big("page_id").alias("page_id"), text.alias("text"), ref.alias("reference"))


@query("source_basename")
def q_source_basename(spark, sf):
    """Base name of a source path, and the full path kept as is."""
    from answerlake.sources.tables import table
    p = table(spark, sf, "pages").select("page_id", "url")
    return p.select(big("page_id").alias("page_id"), F.element_at(F.split("url", "/"), -1).alias("basename"),
                    F.col("url").alias("source"))


def quiz_messages(spark, sf) -> DataFrame:
    """Trivia generator output stand-ins from user turns: question text and an
    answer that may or may not be one of the candidates."""
    u = _turns(spark, sf).filter(F.col("role") == "user")
    n = F.length("text") % 3
    ans = F.when(n == 0, F.lit("Trump")).when(n == 1, F.lit("biden")).otherwise(F.lit("nobody"))
    return u.select("conv_id", "turn", F.concat(F.lit("Question: "), F.col("text"), F.lit(" Answer: "), ans)
                    .alias("message"))


QUIZ_FALLBACK = ("Generating Question, Please Wait", "trump")  # fixed values


@query("quiz_parse")
def q_quiz_parse(spark, sf):
    from answerlake.functions.payloads import parse_quiz
    from answerlake.sources.inline import CANDIDATES
    m = quiz_messages(spark, sf)
    q, a = parse_quiz(F.col("message"), CANDIDATES)
    ok = q.isNotNull()
    return m.select(big("conv_id").alias("conv_id"), big("turn").alias("turn"),
                    F.coalesce(q, F.lit(QUIZ_FALLBACK[0])).alias("question"),
                    F.coalesce(a, F.lit(QUIZ_FALLBACK[1])).alias("answer"),
                    big(ok.cast("int")).alias("parsed"))


# ------------------------------------------------------------------ logs ----

def qa_pairs(spark, sf) -> DataFrame:
    """Each user turn with the assistant turn that follows it."""
    t = _turns(spark, sf)
    q = t.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("query"))
    a = t.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response"))
    sys_ = t.filter(F.col("role") == "system").groupBy("conv_id").agg(
        F.min_by("text", "turn").alias("context"))
    return q.join(a, ["conv_id", "turn"], "left").join(sys_, "conv_id", "left")


@query("log_rows")
def q_log_rows(spark, sf):
    """K1 columns (Query, Retrieved Text, Response, Filename)."""
    from answerlake.operators.retrieval import NO_HIT_FILENAME
    p = qa_pairs(spark, sf)
    return p.select(big("conv_id").alias("conv_id"), big("turn").alias("turn"),
                    F.col("query").alias("Query"), F.col("context").alias("Retrieved Text"),
                    F.col("response").alias("Response"),
                    F.when(F.col("context").isNull(), F.lit(NO_HIT_FILENAME))
                    .otherwise(F.concat(F.lit("conversation/"), F.col("conv_id").cast("string")))
                    .alias("Filename"))


@query("latest_question")
def q_latest_question(spark, sf):
    """Latest question by id, per conversation (not global)."""
    u = _turns(spark, sf).filter(F.col("role") == "user")
    last = u.groupBy("conv_id").agg(F.max_by(F.struct("turn", "text"), "turn").alias("_l"))
    return last.select(big("conv_id").alias("conv_id"), big("_l.turn").alias("turn"),
                       F.col("_l.text").alias("query"))


@query("response_rows")
def q_response_rows(spark, sf):
    """K4 + P17: response records with the fixed candidate id and vote flag;
    the faithfulness column carries the offline support proxy."""
    from answerlake.operators.evaluate import context_support
    p = qa_pairs(spark, sf).filter(F.col("response").isNotNull())
    key = ["conv_id", "turn"]
    sup = context_support(p.select(*key, F.col("response").alias("answer")),
                          p.select(*key, F.col("query").alias("context")), key)
    out = p.join(sup, key)
    return out.select(big("conv_id").alias("query_id"), big("turn").alias("turn"),
                      F.lit(1).cast("bigint").alias("candidate_id"), F.col("response"),
                      F.lit(0).cast("bigint").alias("user_voted"),
                      F.lit(None).cast("double").alias("answer_relevancy"),
                      r6(F.col("support").cast("double")).alias("faithfulness"))


@query("sentinel_filter")
def q_sentinel_filter(spark, sf):
    """Drop sentinel and empty questions, and empty responses."""
    from answerlake.sources.inline import SENTINELS
    p = qa_pairs(spark, sf)
    keep = (~F.lower("query").isin(*SENTINELS)) & (F.col("query") != "") \
        & (F.coalesce(F.col("response"), F.lit("")) != "")
    return p.filter(keep).select(big("conv_id").alias("conv_id"), big("turn").alias("turn"))


# -------------------------------------------------------- classification ----

CENTROID_MIN_SCORE = 0.2


@query("classify_centroid")
def q_classify_centroid(spark, sf):
    from answerlake.operators.classify import centroids, classify_centroid
    from answerlake.sources.tables import table
    e = table(spark, sf, "embeddings").filter(F.col("embedding").isNotNull()).select("vec_id", "embedding", "label")
    out = classify_centroid(e, centroids(e), min_score=CENTROID_MIN_SCORE)
    return out.select(big("vec_id").alias("vec_id"), "category", r6("score").alias("score"))


@query("classify_terms")
def q_classify_terms(spark, sf):
    from answerlake.operators.classify import classify_terms
    from answerlake.sources.inline import taxonomy
    out = classify_terms(C.questions(spark, sf), taxonomy(spark, with_other=False), "item_id")
    return out.select(big("item_id").alias("item_id"), "category", r6("score").alias("score"))


def model_labels(spark, sf) -> DataFrame:
    """Stand-in for model-assigned labels: the first word of each assistant
    turn, capitalised (free text, so some fall outside the taxonomy)."""
    t = _turns(spark, sf).filter(F.col("role") == "assistant")
    w = F.regexp_extract("text", r"\p{L}+", 0)
    label = F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 20)))
    return t.select("conv_id", "turn", label.alias("category"))


@query("offtaxonomy_labels")
def q_offtaxonomy_labels(spark, sf):
    from answerlake.operators.classify import offtaxonomy
    from answerlake.sources.inline import taxonomy
    out = offtaxonomy(model_labels(spark, sf), taxonomy(spark))
    return out.select("category", big("n").alias("n"))


@query("alias_labels")
def q_alias_labels(spark, sf):
    """Off-list labels of the model mapped by an alias table, then counted.  Test role: an
    off-list label's alias is the taxonomy label at its length."""
    from answerlake.operators.classify import alias_labels, offtaxonomy
    from answerlake.sources.inline import TAXONOMY, taxonomy
    labelled = model_labels(spark, sf)
    at = (F.length("category") % len(TAXONOMY)).cast("int")
    aliases = offtaxonomy(labelled, taxonomy(spark)).select(
        F.concat(F.lit(" "), F.lower("category")).alias("alias"), F.get(F.array(*[F.lit(t) for t in TAXONOMY]), at).alias("label"))
    out = alias_labels(labelled.select("category"), aliases)
    return out.groupBy("category").agg(F.count("*").alias("n")).select("category", big("n").alias("n"))


def _length_label(texts):
    """Deterministic stand-in for a classifying model; it fails on some texts."""
    from answerlake.sources.inline import TAXONOMY

    def one(text: str) -> str:
        if len(text) % 10 == 0:
            raise ValueError("no label")
        return TAXONOMY[len(text) % len(TAXONOMY)]
    return texts.map(one)


@query("classify_hook")
def q_classify_hook(spark, sf):
    """H1 + P25: labels of a user's model, NULL and its error where it fails."""
    from answerlake.operators.classify import classify_with
    out = classify_with(C.questions(spark, sf), _length_label)
    return out.select(big("item_id").alias("item_id"), "category", F.col("category_error").alias("error"))


@query("token_hook")
def q_token_hook(spark, sf):
    """H4: a user's token counter beside the built-in one."""
    from answerlake.functions.text import token_count
    from answerlake.operators.classify import token_udf
    words = token_udf(lambda t: len(t.split(" ")))
    return C.questions(spark, sf).select(big("item_id").alias("item_id"), words("text").alias("n_own"), big(token_count("text")).alias("n_tokens"))


@query("stub_category")
def q_stub_category(spark, sf):
    from answerlake.operators.classify import stub_category
    out = stub_category(C.questions(spark, sf))
    return out.select(big("item_id").alias("item_id"), F.col("text").alias("Questions"), "Category")


# ------------------------------------------------------------ evaluation ----

@query("context_support")
def q_context_support(spark, sf):
    """Offline proxy: share of answer terms found in the question's context."""
    from answerlake.operators.evaluate import context_support
    p = qa_pairs(spark, sf).filter(F.col("response").isNotNull() & F.col("context").isNotNull())
    key = ["conv_id", "turn"]
    s = context_support(p.select(*key, F.col("response").alias("answer")), p.select(*key, "context"), key)
    return s.select(big("conv_id").alias("conv_id"), big("turn").alias("turn"), big("n_terms").alias("n_terms"),
                    big("n_supported").alias("n_supported"), r6("support").alias("support"))


@query("faithfulness_avg")
def q_faithfulness_avg(spark, sf):
    """Judge verdicts (``labels.quality`` as supported) averaged per source."""
    from answerlake.operators.evaluate import faithfulness
    from answerlake.sources.tables import table
    v = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("supported")) \
        .join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    f = faithfulness(v, ["source"])
    return f.select("source", big("n_claims").alias("n_claims"), r6("faithfulness").alias("faithfulness"))


@query("relevancy_avg")
def q_relevancy_avg(spark, sf):
    """Mean cosine of each label's vectors to the label centroid (an
    equi-join on the label: every vector meets only its own centroid)."""
    from answerlake.operators.classify import centroids
    from answerlake.operators.evaluate import answer_relevancy
    from answerlake.operators.retrieval import cosine_distance
    from answerlake.sources.tables import table
    e = table(spark, sf, "embeddings").filter(F.col("embedding").isNotNull()).select("vec_id", "embedding", "label")
    # one centroid row per label: AQE broadcasts it from its measured size
    own = e.join(centroids(e), "label") \
        .select("label", "vec_id", cosine_distance(F.col("centroid"), F.col("embedding")).alias("distance"))
    r = answer_relevancy(own, "label")
    return r.select(big("label").alias("label"), big("n_generated").alias("n_generated"),
                    r6("answer_relevancy").alias("answer_relevancy"))


@query("score_by_day")
def q_score_by_day(spark, sf):
    from answerlake.operators.evaluate import score_by_day
    from answerlake.sources.tables import table
    s = score_by_day(table(spark, sf, "events"), "ts", ["value"])
    return s.select("day", big("n").alias("n"), r6("avg_value").alias("avg_value"))


EVAL_WEIGHTS = {"simple": 0.5, "reasoning": 0.25, "multi_context": 0.25}  # fixed values


@query("eval_set_mix")
def q_eval_set_mix(spark, sf):
    from answerlake.operators.evaluate import eval_mix
    p = C.paragraphs(spark, sf).filter(~is_blank("text"))
    m = eval_mix(p, 10, EVAL_WEIGHTS, SAMPLE_SEED, ["doc_id", "para_idx"])
    return m.select(big("doc_id").alias("doc_id"), big("para_idx").alias("para_idx"),
                    big("rank").alias("rank"), "evolution")


#: The rarity rule of multi-context pairs: terms that occur in at most so many texts.
EVAL_MAX_DF = 2


@query("eval_multi_context_pairs")
def q_eval_multi_context_pairs(spark, sf):
    from answerlake.operators.evaluate import rare_term_pairs
    ix = C.chunk_index(spark, sf)
    p = rare_term_pairs(ix.terms, ix.idf, list(C.CHUNK_KEYS), max_df=EVAL_MAX_DF)
    return p.select(*[big(F.col(f"{s}.{k}")).alias(f"{s}_{k}") for s in ("a", "b") for k in C.CHUNK_KEYS],
                    big("n_shared").alias("n_shared"))


@query("suggested_sample")
def q_suggested_sample(spark, sf):
    """S5 + G9: questions as a quoted list (one per line, trailing commas),
    parsed back and sampled three at a time."""
    from answerlake.operators.engagement import sample_n
    from answerlake.sources.files import QUOTED_LINE
    lines = C.questions(spark, sf).select(
        "item_id", F.concat(F.lit('"'), F.translate("text", "\n", " "), F.lit('",')).alias("value"))
    parsed = lines.select("item_id", F.regexp_extract("value", QUOTED_LINE, 1).alias("text"))
    return sample_n(parsed, 3, SAMPLE_SEED, "item_id").select(big("item_id").alias("item_id"), "text")


# ------------------------------------------------- sinks and round trips ----

@query("index_roundtrip")
def q_index_roundtrip(spark, sf):
    """K5 + S7: the chunk index is written, read back and served."""
    from answerlake.session import shared_path
    from answerlake.sinks.writers import write_index
    from answerlake.sources.tables import read_index
    post = C.chunk_index(spark, sf).postings
    path = shared_path(spark, "index")
    write_index(post, path)
    back = read_index(spark, path)
    return back.select(big("doc_id").alias("doc_id"), big("para_idx").alias("para_idx"),
                       big("piece_idx").alias("piece_idx"), "term", big("tf").alias("tf"),
                       r6("weight").alias("weight"))


@query("roundtrip_tsv")
def q_roundtrip_tsv(spark, sf):
    """K1: log rows appended as TSV with a header, read back."""
    from answerlake.session import shared_path
    from answerlake.sinks.writers import append_log_tsv, read_log_tsv
    rows = q_log_rows(spark, sf)
    path = shared_path(spark, "log-tsv")
    append_log_tsv(rows, path)
    back = read_log_tsv(spark, path)
    return back.select(big("conv_id").alias("conv_id"), big("turn").alias("turn"),
                       *[F.col(f"`{c}`") for c in ("Query", "Retrieved Text", "Response", "Filename")])


def quoted_votes(spark, sf) -> DataFrame:
    """Vote records whose prompt holds doubled quotes and a comma, as in the
    original mock vote file."""
    from answerlake.operators.engagement import slot_a_candidate
    qs = C.questions(spark, sf)
    return qs.select("item_id", F.concat(F.lit('"'), F.col("text"), F.lit('",')).alias("prompt"),
                     slot_a_candidate("item_id").alias("vote"))


@query("roundtrip_csv_quotes")
def q_roundtrip_csv_quotes(spark, sf):
    """K2/K6 + S3/S4 + F17: CSV rewritten with an extra column, read back."""
    from answerlake.session import shared_path
    from answerlake.sinks.writers import out_name, rewrite_csv
    from answerlake.sources.files import read_csv_first_column
    src = quoted_votes(spark, sf).select("prompt", "item_id", "vote")
    path = out_name(shared_path(spark, "votes") + ".csv")
    rewrite_csv(src.withColumn("Category", F.lit("Test")), path)
    back = read_csv_first_column(spark, path, out="prompt")
    return back.select(big("item_id").alias("item_id"), "prompt", "vote", "Category")


@query("scan_txt_dir")
def q_scan_txt_dir(spark, sf):
    """Documents written as .txt files per source folder, scanned back
    whole-file; checked by characters and files' line totals per source."""
    from answerlake.session import shared_path
    from answerlake.sources.files import scan_text_dir
    path = shared_path(spark, "corpus")
    C.documents(spark, sf).select("source", "text").write.partitionBy("source").text(path)
    files = scan_text_dir(spark, path).withColumn("source", F.regexp_extract("path", r"source=([^/]+)/", 1))
    return files.groupBy("source").agg(big(F.sum(F.length("text"))).alias("n_chars"),
                                       big(F.sum(F.size(F.split("text", "\n")) - 1)).alias("n_lines"))


@query("scan_paragraphs")
def q_scan_paragraphs(spark, sf):
    """S1 + S2 + P1: documents written as text files in folders, read recursively by byte ranges, part by part."""
    from answerlake.session import shared_path
    from answerlake.sources.split_text import read_paragraphs
    path = shared_path(spark, "corpus")
    C.documents(spark, sf).select("source", "text").write.partitionBy("source").text(path)
    parts = read_paragraphs(spark, path, breaks=1, recursive=True).filter("text <> ''")
    return parts.groupBy(F.regexp_extract("path", r"source=([^/]+)/", 1).alias("source")).agg(
        big(F.count("*")).alias("n_parts"), big(F.sum(F.length("text"))).alias("n_chars"), big(F.sum(F.ascii("text"))).alias("first_letters"))


# ------------------------------------------------------------- streaming ----

def _vote_candidate(ev: DataFrame) -> DataFrame:
    """Candidate of a vote event: slot from ``props.k`` parity, slot A's
    candidate from the blind draw on the event id."""
    from answerlake.operators.engagement import props_k, slot_a_candidate
    from answerlake.sources.inline import CANDIDATES
    slot_a = (F.pmod(props_k(), F.lit(2)) == 0)
    a = slot_a_candidate("event_id")
    other = F.when(a == F.lit(CANDIDATES[0]), F.lit(CANDIDATES[1])).otherwise(F.lit(CANDIDATES[0]))
    return ev.withColumn("candidate", F.when(slot_a, a).otherwise(other))


@query("stream_scoreboard")
def q_stream_scoreboard(spark, sf):
    from answerlake.streaming.live import latest_epoch, run_to_table, scoreboard, stream_table
    ev = stream_table(spark, sf, "events").filter(F.col("event_type") == "purchase")
    out = run_to_table(spark, scoreboard(_vote_candidate(ev)), "scoreboard", mode="complete")
    return latest_epoch(out).select("candidate", big("votes").alias("votes"))


@query("stream_first_vote")
def q_stream_first_vote(spark, sf):
    """ST2: the first vote of each user on each question number, by event time."""
    from answerlake.operators.engagement import props_k
    from answerlake.streaming.live import first_rows, run_to_table, stream_table
    keys, order = ["user_id", "question_k"], ["ts", "event_id"]
    ev = stream_table(spark, sf, "events").filter(F.col("event_type") == "purchase") \
        .select("user_id", "ts", "event_id", props_k().alias("question_k"))
    seen = run_to_table(spark, ev, "first-vote", batch_fn=lambda batch: first_rows(batch, keys, order, 1))
    return first_rows(seen, keys, order, 1).select(
        big("user_id").alias("user_id"), big("question_k").alias("question_k"), big("event_id").alias("vote_id"))


@query("stream_milestones")
def q_stream_milestones(spark, sf):
    from answerlake.operators.engagement import engagement_events, milestone_events, milestones
    from answerlake.sources.inline import badge_rules
    from answerlake.streaming.live import first_rows, run_to_table, stream_table
    rules = badge_rules(spark)
    top = rules.agg(F.max("n").alias("n")).first()["n"]
    ev = milestone_events(engagement_events(stream_table(spark, sf, "events")))
    # what a later batch can still need of a batch: its first ``top`` rows of each user and kind
    seen = run_to_table(spark, ev, "milestones",
                        batch_fn=lambda batch: first_rows(batch, ["user_id", "kind"], ["ts", "event_id"], top))
    return milestones(seen, rules).select(big("user_id").alias("user_id"), big("badge_id").alias("badge_id"),
                                          big("event_id").alias("event_id"))


@query("stream_milestones_state")
def q_stream_milestones_state(spark, sf):
    """ST3: the same awards from state that is kept between batches."""
    from answerlake.operators.engagement import engagement_events, milestone_events, milestones
    from answerlake.sources.inline import badge_rules
    from answerlake.streaming.live import stream_table
    from answerlake.streaming.stateful import first_events
    rules = badge_rules(spark)
    top = rules.agg(F.max("n").alias("n")).first()["n"]
    first = first_events(spark, milestone_events(engagement_events(stream_table(spark, sf, "events"))), top)
    return milestones(first, rules).select(big("user_id").alias("user_id"), big("badge_id").alias("badge_id"), big("event_id").alias("event_id"))


@query("stream_answer")
def q_stream_answer(spark, sf):
    """ST4: questions arrive as a stream and are answered in each micro-batch
    from the stored paragraph blocks (top-1, and the fixed answer where
    nothing is found)."""
    from answerlake.streaming.live import run_to_table, stream_table
    ix = C.paragraph_blocks(spark, sf)
    return run_to_table(spark, stream_table(spark, sf, "benchmark"), "answers", batch_fn=lambda batch: served(ix, batch)).drop("epoch")


def stored_paragraphs(texts: DataFrame) -> DataFrame:
    return C.filename(texts).select(*C.PARA_KEYS, "filename", F.col("text").alias("retrieved_text"))


def served(ix, questions: DataFrame) -> DataFrame:
    """One answer row per question from published blocks."""
    from answerlake.operators.pruned import Search
    best = Search(ix, questions, ["item_id"]).top1()
    return top1_answers(questions.select("item_id"), best, stored_paragraphs(ix.texts))


@query("serve_top1")
def q_serve_top1(spark, sf):
    """A stored index serves: only blocks whose bounds can matter are scored."""
    return served(C.paragraph_blocks(spark, sf), C.questions(spark, sf))


@query("answer_log")
def q_answer_log(spark, sf):
    """G1 + G2 + P21 + K7: per question both candidates' responses with their
    references, then the vote: picked candidate and the picked slot's
    reference (NULL until voted).  Test roles: the two responses of question
    ``q`` are the page messages ``2q`` (slot A) and ``2q+1`` (slot B); the
    vote is a reproducible md5 draw, a quarter of the questions stay unvoted."""
    from answerlake.functions.payloads import extract_reference
    from answerlake.operators.engagement import blind_assignment
    qs = C.questions(spark, sf).select("item_id", F.col("text").alias("question"))
    msgs = page_messages(spark, sf)
    text, ref = extract_reference(F.col("message"))
    resp = msgs.select("page_id", text.alias("response"), ref.alias("reference"))
    slot = lambda s: resp.select((F.col("page_id") - s).alias("_k"),
                                 F.col("response").alias(f"response_{'ab'[s]}"),
                                 F.col("reference").alias(f"reference_{'ab'[s]}"))
    log = (qs.withColumn("_k", F.col("item_id") * 2)
           .join(slot(0), "_k", "left")
           .join(slot(1), "_k", "left").drop("_k"))
    h = F.md5(F.concat(F.col("item_id").cast("string"), F.lit("vote")))
    voted_slot = (F.when(F.substring(h, 1, 1).isin(*"0123"), F.lit(None))
                  .when(F.substring(h, 32, 1).isin(*"01234567"), F.lit("A")).otherwise(F.lit("B")))
    assign = blind_assignment(qs, "item_id")
    log = log.withColumn("slot", voted_slot).join(assign, ["item_id", "slot"], "left")
    picked_ref = F.when(F.col("slot") == "A", F.col("reference_a")).when(F.col("slot") == "B", F.col("reference_b"))
    return log.select(big("item_id").alias("item_id"), "response_a", "reference_a", "response_b", "reference_b",
                      F.col("candidate").alias("picked"), picked_ref.alias("picked_reference"))


# ------------------------------------------- records, requests, dense path ----

TRUNCATE_AT = 100


@query("truncate_tokens")
def q_truncate_tokens(spark, sf):
    """C4: each document cut to its first tokens."""
    from answerlake.functions.text import token_count, truncate_tokens
    d = C.documents(spark, sf)
    cut = truncate_tokens("text", TRUNCATE_AT)
    return d.select(big("doc_id").alias("doc_id"), big(token_count("text")).alias("n_tokens"), cut.alias("text"))


@query("question_rows")
def q_question_rows(spark, sf):
    """K3 + F15: two inserts of question rows, read back with the count that each insert reported."""
    from answerlake.session import shared_path
    from answerlake.sinks.writers import append_questions
    qs, path = C.questions(spark, sf), shared_path(spark, "questions")
    counts = {0: append_questions(qs, path), 1: append_questions(qs.filter(F.col("item_id") % 2 == 0), path, session_id=1)}
    back = spark.read.parquet(path)
    inserted = F.when(F.col("session_id") == 0, F.lit(counts[0])).otherwise(F.lit(counts[1]))
    return back.select(big("session_id").alias("session_id"), "query", big(inserted).alias("inserted"),
                       F.col("timestamp").isNotNull().alias("has_time"))


@query("context_rows")
def q_context_rows(spark, sf):
    """Every retrieved text of a question as a row of its own, none left out."""
    hits = chunk_hits_with_text(spark, sf)
    return hits.select(big("item_id").alias("item_id"), *[big(k).alias(k) for k in C.CHUNK_KEYS], "text", "filename")


def request_bodies(spark, sf) -> DataFrame:
    """(item_id, variant, body): the built prompts as request bodies."""
    from answerlake.functions.payloads import request_body
    from answerlake.operators.engagement import blind_assignment
    from answerlake.operators.prompts import candidate_prompts
    from answerlake.sources.inline import SYSTEM_CATEGORISE, SYSTEM_ENDPOINT, templates
    qs = C.questions(spark, sf)
    endpoint = _context_prompts(spark, sf).select("item_id", F.lit("endpoint").alias("variant"),
                                                  request_body("endpoint", F.col("prompt"), F.lit(SYSTEM_ENDPOINT)).alias("body"))
    label = qs.select("item_id", F.lit("categorise").alias("variant"),
                      request_body("categorise", F.col("text"), F.lit(SYSTEM_CATEGORISE)).alias("body"))
    both = candidate_prompts(qs, blind_assignment(qs, "item_id"), templates(spark), "item_id")
    answer = both.select("item_id", F.concat(F.lit("candidate "), F.col("slot")).alias("variant"), request_body("candidate", F.col("prompt")).alias("body"))
    return endpoint.unionByName(label).unionByName(answer).filter(F.col("body").isNotNull())


@query("request_bodies")
def q_request_bodies(spark, sf):
    """endpoint, categoriser and both candidates' requests of every question, parsed back."""
    from answerlake.functions.payloads import parse_chat_request
    r = request_bodies(spark, sf).withColumn("r", parse_chat_request(F.col("body")))
    messages = F.col("r.messages")
    return r.select(big("item_id").alias("item_id"), "variant", F.col("r.model").alias("model"), big(F.size(messages)).alias("n_messages"),
                    big(F.length(messages[0]["content"])).alias("first_length"), F.element_at(messages, -1)["content"].alias("user_content"),
                    big("r.max_tokens").alias("max_tokens"), F.col("r.temperature").alias("temperature"), F.col("r.top_p").alias("top_p"))


def _stub_completion(bodies):
    """Deterministic stand-in for a chat model: answers with the end of what it was asked."""
    import json

    def one(body: str) -> str:
        asked = json.loads(body)["messages"][-1]["content"]
        return json.dumps({"choices": [{"message": {"role": "assistant", "content": f"  Answer: {asked[-40:]}\n"}}]})
    return bodies.map(one)


@query("completion_records")
def q_completion_records(spark, sf):
    """H3 + F7 + F8 + K4: built prompts become request bodies, a model answers them, the answers become records."""
    from answerlake.functions.payloads import request_body, response_content
    from answerlake.operators.classify import complete_with
    from answerlake.session import shared_path
    from answerlake.sinks.writers import append_rows
    from answerlake.sources.inline import SYSTEM_ENDPOINT
    prompts = _context_prompts(spark, sf)
    asked = prompts.filter("prompt IS NOT NULL").select("item_id", request_body("endpoint", F.col("prompt"), F.lit(SYSTEM_ENDPOINT)).alias("body"))
    answered = complete_with(asked, _stub_completion, prompt_col="body", out_col="reply")
    records = answered.select(big("item_id").alias("query_id"), F.lit(1).cast("bigint").alias("candidate_id"), response_content(F.col("reply")).alias("response"),
                              F.col("reply_error").alias("error"), F.lit(0).cast("bigint").alias("user_voted"))
    path = shared_path(spark, "completion-records")
    append_rows(records, path)
    return spark.read.parquet(path)


@query("debate_summary")
def q_debate_summary(spark, sf):
    """Every question with the name of the picked candidate (none picked
    shows as the second name, as on the page), and the winner of all votes."""
    from answerlake.operators.votes import display_name, winner
    from answerlake.sources.inline import CANDIDATES, DISPLAY_NAMES
    a, b = CANDIDATES
    log = q_answer_log(spark, sf)
    tally = log.agg(F.count_if(F.col("picked") == a).alias("a"), F.count_if(F.col("picked") == b).alias("b"))
    best = tally.select(winner(F.col("a"), F.col("b"), DISPLAY_NAMES[a], DISPLAY_NAMES[b])).scalar()
    qs = C.questions(spark, sf).select("item_id", F.col("text").alias("question"))
    return qs.join(log.select("item_id", "picked"), "item_id").select(
        big("item_id").alias("item_id"), "question", display_name(F.col("picked"), literal=True).alias("picked_name"), best.alias("winner"))


STUB_LETTERS = "etaoinsr"
DENSE_BUDGET = 4096


def stub_embedding(texts):
    """Deterministic stand-in for an embedding model: counts of eight letters."""
    return texts.map(lambda t: [float(t.count(c)) for c in STUB_LETTERS])


def embedded_chunks(spark, sf) -> DataFrame:
    """The dense variant's chunks with vectors from the embedding hook; newlines are spaces to the model."""
    from answerlake.operators.classify import embed_with
    ch = C.filename(C.char_chunks(spark, sf, C.DENSE_CHUNK_CHARS)).select(*C.CHUNK_KEYS, F.translate("text", "\n", " ").alias("text"), "filename")
    return embed_with(ch, stub_embedding)


@query("embed_chunks")
def q_embed_chunks(spark, sf):
    """V5 + H2: the corpus in chunks of the dense variant, embedded."""
    e = embedded_chunks(spark, sf)
    return e.select(*[big(k).alias(k) for k in C.CHUNK_KEYS], F.array_join("embedding", ",").alias("embedding"), "embedding_error")


@query("dense_context_prompts")
def q_dense_context_prompts(spark, sf):
    """The dense variant end to end: chunks and questions embedded, the
    nearest chunks with their texts and files, prompt within its budget, and
    the fixed response where nothing is found."""
    from answerlake.functions.text import token_count
    from answerlake.operators.classify import embed_with
    from answerlake.operators.prompts import assemble_prompts, collect_contexts
    from answerlake.session import shared_path
    path = shared_path(spark, "chunk-vectors")
    ident = F.format_string("%020d/%010d/%010d", *[F.col(k).cast("long") for k in C.CHUNK_KEYS])
    embedded_chunks(spark, sf).withColumn("vec_id", ident).write.parquet(path)
    chunks = spark.read.parquet(path)
    qs = C.questions(spark, sf)
    asked = embed_with(qs.select("item_id", F.translate("text", "\n", " ").alias("text")), stub_embedding, out_col="qvec").select("item_id", "qvec")
    near = R.dense_topk(R.dense_topk_candidates(asked, chunks.select("vec_id", "embedding"), C.TOP_K, q_key="item_id", q_vec="qvec"), C.TOP_K, q_key="item_id")
    # at most TOP_K texts of each question
    hits = near.join(chunks.select("vec_id", "text", "filename"), "vec_id")
    lists = collect_contexts(hits, "item_id", ["rank"])
    sizes = hits.groupBy("item_id").agg(F.count("*").alias("n_contexts"), F.sum(token_count("text")).alias("context_tokens"))
    p = assemble_prompts(qs, sizes.join(lists, "item_id"), "item_id", budget=DENSE_BUDGET)
    return p.select(big("item_id").alias("item_id"), big(F.coalesce("n_contexts", F.lit(0))).alias("n_contexts"),
                    F.array_join("filenames", ",").alias("filenames"), "prompt", "response")


@query("eval_multi_context_rows")
def q_eval_multi_context_rows(spark, sf):
    """Evaluation rows over two contexts, with both texts and files."""
    from answerlake.operators.evaluate import rare_term_pairs
    ix = C.chunk_index(spark, sf)
    pairs = rare_term_pairs(ix.terms, ix.idf, list(C.CHUNK_KEYS), max_df=EVAL_MAX_DF)
    texts = C.filename(ix.units).select(F.struct(*C.CHUNK_KEYS).alias("key"), "text", "filename")
    side = lambda s: texts.select(F.col("key").alias(s), F.col("text").alias(f"text_{s}"), F.col("filename").alias(f"file_{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.select(F.lit("multi_context").alias("evolution"), "text_a", "file_a", "text_b", "file_b", big("n_shared").alias("n_shared"))


#: Jaccard coefficient from which two chunks belong together.
SIMILAR = 0.4


def _similar_chunks(spark, sf):
    from answerlake.operators.similar import similar_texts
    terms = C.chunk_index(spark, sf).forward.select(*C.CHUNK_KEYS, F.col("items.term").alias("terms"))
    return similar_texts(terms, list(C.CHUNK_KEYS), SIMILAR)


@query("similar_chunks")
def q_similar_chunks(spark, sf):
    """Pairs of chunks with similar term sets, one chunk of each class of equal sets."""
    pairs = _similar_chunks(spark, sf).pairs
    return pairs.select(*[big(F.col(f"{s}.{k}")).alias(f"{s}_{k}") for s in ("a", "b") for k in C.CHUNK_KEYS],
                        "n_shared", r6("similarity").alias("similarity"))


@query("similar_classes")
def q_similar_classes(spark, sf):
    """The representative of every chunk and the size of its class."""
    members = _similar_chunks(spark, sf).members
    return members.select(*[big(F.col(f"rep.{k}")).alias(f"rep_{k}") for k in C.CHUNK_KEYS], *[big(k).alias(k) for k in C.CHUNK_KEYS], big("size").alias("size"))


EVAL_ROWS = 10


@query("eval_test_set")
def q_eval_test_set(spark, sf):
    """Evaluation rows by quota; a multi_context row holds two similar chunks, the others one."""
    from answerlake.operators.evaluate import quotas
    index, n = C.chunk_index(spark, sf), quotas(EVAL_ROWS, EVAL_WEIGHTS)
    draw = lambda *cols: F.md5(F.concat_ws("|", F.lit(SAMPLE_SEED), *[c.cast("string") for c in cols]))
    key = F.struct(*[F.col(k) for k in C.CHUNK_KEYS])
    # Top-n by hash: the limits are the sampling feature.
    single = (index.units.filter(~is_blank("text")).select(key.alias("a"), draw(*[F.col(k) for k in C.CHUNK_KEYS]).alias("h"))
              .orderBy("h", "a").limit(n["simple"] + n["reasoning"]))
    from pyspark.sql import Window
    place = F.row_number().over(Window.orderBy("h", "a"))
    single = single.select("a", F.lit(None).cast(single.schema["a"].dataType).alias("b"), place.alias("rank"),
                           F.when(place <= n["simple"], F.lit("simple")).otherwise(F.lit("reasoning")).alias("evolution"))
    pairs = _similar_chunks(spark, sf).pairs
    both = pairs.select("a", "b", draw(*[F.col(f"{s}.{k}") for s in "ab" for k in C.CHUNK_KEYS]).alias("h")).orderBy("h", "a", "b").limit(n["multi_context"])
    both = both.select("a", "b", (F.row_number().over(Window.orderBy("h", "a", "b")) + n["simple"] + n["reasoning"]).alias("rank"), F.lit("multi_context").alias("evolution"))
    texts = C.filename(index.units).select(key.alias("key"), "text", "filename")
    side = lambda s: texts.select(F.col("key").alias(s), F.col("text").alias(f"text_{s}"), F.col("filename").alias(f"file_{s}"))
    rows = single.unionByName(both).join(side("a"), "a").join(side("b"), "b", "left")
    return rows.select(big("rank").alias("rank"), "evolution", "text_a", "file_a", "text_b", "file_b")


def _letter_counts(c) -> F.Column:
    return F.array(*[(F.length(c) - F.length(F.replace(c, F.lit(x)))).cast("double") for x in STUB_LETTERS])


@query("answer_scores")
def q_answer_scores(spark, sf):
    """Faithfulness and relevancy of each answer.  Its sentences are the
    claims, judged by the offline stand-in, and also stand in for the questions
    a model would generate from it; vectors come from the stub embedding."""
    from answerlake.operators.evaluate import answer_relevancy, claim_verdicts, claims, faithfulness
    key = ["conv_id", "turn"]
    p = qa_pairs(spark, sf).filter(F.col("response").isNotNull())
    parts = claims(p.select(*key, F.col("response").alias("answer")), key)
    context = p.select(*key, F.coalesce("context", F.col("query")).alias("context"))
    faith = faithfulness(claim_verdicts(parts, context, key), key)
    near = parts.join(p.select(*key, "query"), key).select(
        *key, R.cosine_distance(_letter_counts(F.col("query")), _letter_counts(F.col("text"))).alias("distance"))
    return faith.join(answer_relevancy(near, key), key).select(
        big("conv_id").alias("conv_id"), big("turn").alias("turn"), big("n_claims").alias("n_claims"),
        r6("faithfulness").alias("faithfulness"), r6("answer_relevancy").alias("answer_relevancy"))


@query("response_records")
def q_response_records(spark, sf):
    """K4 + F10: whole response records - contexts and file names as JSON
    lists, fixed candidate and vote flag, relevancy left open - appended in two
    inserts and read back."""
    from answerlake.session import shared_path
    from answerlake.sinks.writers import append_rows
    names = F.when(F.col("context").isNotNull(), F.array(F.concat(F.lit("conversation/"), F.col("conv_id").cast("string"))))
    none = F.array().cast("array<string>")
    rows = qa_pairs(spark, sf).filter(F.col("response").isNotNull()).select(
        big("conv_id").alias("query_id"), big("turn").alias("turn"), F.lit(1).cast("bigint").alias("candidate_id"), "response",
        F.to_json(F.when(F.col("context").isNotNull(), F.array("context")).otherwise(none)).alias("contexts"),
        F.to_json(F.coalesce(names, none)).alias("filenames"), F.lit(0).cast("bigint").alias("user_voted"),
        F.lit(None).cast("double").alias("answer_relevancy"))
    path = shared_path(spark, "responses")
    append_rows(rows.filter(F.col("turn") % 4 == 1), path)
    append_rows(rows.filter(F.col("turn") % 4 != 1), path)
    back = spark.read.parquet(path)
    texts = lambda c: F.array_join(F.from_json(c, "array<string>"), "\n")
    return back.select(*[c for c in back.columns if c not in ("contexts", "filenames")],
                       texts("contexts").alias("contexts"), texts("filenames").alias("filenames"))
