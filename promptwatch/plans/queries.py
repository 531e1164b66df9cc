"""One named query per operator, bound to the benchmark tables.

Every query reads whole tables and grows with them; column names and types are those of
the SQL in :mod:`promptwatch.plans.oracles`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from promptwatch.functions import amplification as A
from promptwatch.functions import cost as C
from promptwatch.functions import entropy as E
from promptwatch.functions import fingerprints as FP
from promptwatch.functions import policy as PO
from promptwatch.functions import rules as R
from promptwatch.functions import text as T
from promptwatch.functions import verdicts as V
from promptwatch.operators import anchored, correlation, gate, reputation, similarity
from promptwatch.operators.prefix import previous_in_key
from promptwatch.operators.proof import with_proofs
from promptwatch.operators.ranking import global_rank
from promptwatch.params import DAY_US, HOUR_US, Params
from promptwatch.plans import protect as P
from promptwatch.plans import rollups as U
from promptwatch.plans import training as M
from promptwatch.sources import bindings as B
from promptwatch.sources import control as CT
from promptwatch.sources import requests as RQ
from promptwatch.sources.workspace import materialize, workspace_path
from promptwatch.streaming import stateful as ST
from promptwatch.streaming.run import keep_newest, newest, run_available, run_totals, split_late

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: Parameters under which the benchmark tables give rich answers.
DENSE = replace(Params(), correlation_window_s=3600)
DAY_WINDOW = replace(Params(), correlation_window_s=86400, campaign_ttl_s=86400)
QUOTA = replace(Params(), quota_limit=3, quota_window_s=86400)
SQL_ROUNDING = replace(Params(), rounding="half_up")


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def csv_list(flags: Column) -> Column:
    return F.array_join(flags, ",")


# -- stateless signals over the prompt table --------------------------------------------

def _forms(spark: SparkSession, sf: str) -> DataFrame:
    return C.with_text_forms(B.prompts(spark, sf))


def _cost(spark: SparkSession, sf: str) -> DataFrame:
    return C.with_cost_signals(_forms(spark, sf))


def _amp(spark: SparkSession, sf: str) -> DataFrame:
    return A.with_amplification(_cost(spark, sf))


@query
def normalize_leet(spark, sf):
    p = B.prompts(spark, sf)
    return p.select("prompt_id", F.md5(T.normalize_leet(F.lower("prompt"))).alias("norm_md5"))


@query
def has_instruction_verb(spark, sf):
    return _forms(spark, sf).select("prompt_id", C.has_instruction_verb("_norm").alias("has_instruction"))


@query
def max_number(spark, sf):
    return _forms(spark, sf).select("prompt_id", F.col("_biggest").alias("biggest"))


@query
def encoding_score(spark, sf):
    return _forms(spark, sf).select("prompt_id", C.encoding_score(F.col("prompt"), F.col("_long_run")).alias("encoding_score"))


@query
def expansion_factor(spark, sf):
    return _forms(spark, sf).select("prompt_id", F.round(C.expansion_factor("_norm", F.col("_biggest")), 4).alias("expansion_factor"))


@query
def obfuscation_score(spark, sf):
    return B.prompts(spark, sf).select("prompt_id", F.round(C.obfuscation_score(F.col("prompt")), 4).alias("obfuscation_score"))


@query
def shannon_entropy(spark, sf):
    return B.prompts(spark, sf).select("prompt_id", F.round(E.shannon_entropy(F.col("prompt")), 4).alias("entropy"))


@query
def entropy_by_key(spark, sf):
    e = E.entropy_by_key(B.prompts(spark, sf), "prompt", "prompt_id")
    return e.select("prompt_id", F.round("entropy", 4).alias("entropy"))


@query
def entropy_score(spark, sf):
    p = F.col("prompt")
    return B.prompts(spark, sf).select(
        "prompt_id", F.round(E.entropy_score(F.length(p), E.shannon_entropy(p)), 3).alias("entropy_score")
    )


@query
def char_histogram(spark, sf):
    return E.char_histogram(B.prompts(spark, sf), "prompt")


@query
def input_tokens(spark, sf):
    return B.prompts(spark, sf).select("prompt_id", C.input_tokens(T.word_count(F.col("prompt"))).alias("input_tokens"))


@query
def predicted_tokens(spark, sf):
    f = _forms(spark, sf)
    tokens = C.input_tokens(F.col("_words"))
    return f.select("prompt_id", C.predicted_tokens(tokens, C.expansion_factor("_norm", F.col("_biggest"))).alias("predicted_tokens"))


@query
def cost_score(spark, sf):
    return _cost(spark, sf).select("prompt_id", "cost_score")


@query
def cost_band(spark, sf):
    banded = _cost(spark, sf).select(C.cost_band(F.col("cost_score")).alias("band"))
    return banded.groupBy("band").agg(F.count("*").alias("n"))


@query
def cost_features(spark, sf):
    f = _cost(spark, sf).withColumn("f", C.cost_features())
    return f.select("prompt_id", *[F.round(F.get("f", i), 3).alias(n) for i, n in enumerate(C.FEATURES)])


@query
def cost_analyze(spark, sf):
    c = _cost(spark, sf).select("prompt_id", C.cost_result().alias("c"))
    return c.select(
        "prompt_id", "c.cost_score", "c.predicted_tokens", "c.input_tokens",
        F.round("c.breakdown.encoding_score", 1).alias("encoding_score"),
        F.round("c.expansion_factor", 1).alias("expansion_factor"), "c.scoring_method",
    )


@query
def recursive_pattern_flag(spark, sf):
    return _forms(spark, sf).select("prompt_id", R.phrase_flag("_lower", R.AMPLIFICATION_RULES["RECURSIVE_PATTERN"]).alias("hit"))


@query
def self_replication_flag(spark, sf):
    return _forms(spark, sf).select("prompt_id", R.phrase_flag("_lower", R.AMPLIFICATION_RULES["SELF_REPLICATION"]).alias("hit"))


@query
def explicit_multiplier(spark, sf):
    f = _forms(spark, sf)
    m = A.explicit_multiplier(F.col("_lower"), F.col("_words"), F.col("_biggest"))
    return f.select("prompt_id", F.round(m, 3).alias("multiplier"))


@query
def amplification_detect(spark, sf):
    return _amp(spark, sf).select(
        "prompt_id", F.round(F.log10("multiplier"), 6).alias("log_multiplier"), csv_list(F.col("amp_flags")).alias("flags"),
        "recursive_detected", F.col("amp_input_tokens").alias("input_tokens"),
    )


@query
def amplification_false_positives(spark, sf):
    """Documents the bare-number rule alone would block."""
    faithful = _amp(spark, sf).select("prompt_id", F.col("recursive_detected").alias("faithful"))
    f = A.with_amplification(_cost(spark, sf), replace(Params(), bare_numbers=False))
    strict = f.select("prompt_id", F.col("recursive_detected").alias("strict"))
    both = faithful.join(strict, "prompt_id").filter(F.col("prompt_id").startswith("d"))
    return both.agg(
        F.count("*").alias("documents"), F.count_if("faithful").alias("blocked"),
        F.count_if("strict").alias("blocked_without_bare_numbers"),
    )


def _flag_query(flag: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        p = B.prompts(spark, sf).withColumn("_lower", T.fold_case(F.col("prompt")))
        return p.select("prompt_id", R.detectors()[flag]("_lower", "prompt").alias("hit"))

    return run


for _name, _flag in {
    "flag_jailbreak": "JAILBREAK_ATTEMPT", "flag_role_injection": "ROLE_INJECTION",
    "flag_ignore_instructions": "IGNORE_INSTRUCTIONS", "flag_system_override": "SYSTEM_OVERRIDE_ATTEMPT",
    "flag_hidden_unicode": "HIDDEN_UNICODE_PAYLOAD", "flag_whitespace_stuffing": "WHITESPACE_STUFFING",
    "flag_html_comment": "HTML_COMMENT_INJECTION", "flag_base64_injection": "BASE64_INJECTION",
    "flag_prompt_leaking": "PROMPT_LEAKING_ATTEMPT", "flag_context_manipulation": "CONTEXT_MANIPULATION",
}.items():
    QUERIES[_name] = _flag_query(_flag)


@query
def flag_html_comment_pages(spark, sf):
    pages = B.spread(B.table(spark, sf, "pages").select("page_id", "html"))
    return pages.select("page_id", R.html_comment("html").alias("hit"))


@query
def rule_flags(spark, sf):
    f = R.with_rule_flags(_forms(spark, sf))
    return f.select("prompt_id", csv_list(F.col("rule_flags")).alias("rule_flags"), "rule_score")


@query
def rule_score(spark, sf):
    return R.with_rule_flags(_forms(spark, sf)).groupBy("rule_score").agg(F.count("*").alias("n"))


@query
def rank_first_n_matches(spark, sf):
    return B.prompts(spark, sf).select("prompt_id", T.first_words(F.col("prompt"), 6).alias("words"))


@query
def prompt_hash(spark, sf):
    return B.prompts(spark, sf).select("prompt_id", FP.prompt_hash(F.col("prompt")).alias("prompt_hash"))


@query
def prompt_pattern(spark, sf):
    return B.prompts(spark, sf).select("prompt_id", FP.prompt_pattern(F.col("prompt")).alias("prompt_pattern"))


@query
def campaign_id(spark, sf):
    h = FP.prompt_hash(F.col("prompt"))
    return B.prompts(spark, sf).select("prompt_id", FP.campaign_id(h).alias("campaign_id"))


# -- verdicts over the request log -------------------------------------------------------

@query
def ext_verdict_normalize(spark, sf):
    v = B.verdicts(spark, sf).withColumn("v", V.ext_normalize(V.ext_parse(F.col("ext_json"))))
    return v.select(
        "request_id", F.col("v.flagged").alias("flagged"),
        csv_list(F.array_sort(F.map_keys("v.categories"))).alias("categories"),
        F.array_max(F.map_values("v.category_scores")).alias("max_score"),
    )


@query
def ext_flags(spark, sf):
    v = V.with_ext_signals(B.verdicts(spark, sf))
    return v.select("request_id", csv_list(F.col("ext_flags")).alias("ext_flags"))


@query
def ext_score(spark, sf):
    v = V.with_ext_signals(B.verdicts(spark, sf))
    return v.select("request_id", "ext_score")


@query
def external_verdict_join(spark, sf):
    """Verdicts keyed by prompt fingerprint, one per prompt; prompts without one still pass."""
    requests = B.requests(spark, sf).withColumn("prompt_hash", FP.prompt_hash(F.col("prompt")))
    verdicts = B.verdicts(spark, sf).join(requests.select("request_id", "prompt_hash"), "request_id")
    first = verdicts.groupBy("prompt_hash").agg(F.min_by("ext_json", "request_id").alias("ext_json"))
    joined = V.with_ext_signals(V.join_verdicts(requests.drop("prompt"), first, "prompt_hash"))
    return joined.groupBy("ext_status", "ext_score").agg(F.count("*").alias("n"))


def _risk(spark: SparkSession, sf: str) -> DataFrame:
    return P.with_signals(protection_requests(spark, sf))


@query
def risk_merge(spark, sf):
    return _risk(spark, sf).select(
        "request_id", csv_list(F.col("risk_flags")).alias("risk_flags"), "risk_score", "is_suspicious"
    )


@query
def risk_band(spark, sf):
    band = V.risk_band(F.col("risk_score"), F.col("is_suspicious"))
    return _risk(spark, sf).groupBy(band.alias("band")).agg(F.count("*").alias("n"))


@query
def flag_union(spark, sf):
    """The distinct flags of the log and how many requests carry each."""
    # an inner explode would have its filter on the flags pushed below the exchange, with every signal once more inlined
    flags = _risk(spark, sf).select(F.posexplode_outer("risk_flags").alias("place", "flag")).where("place is not null")
    return flags.groupBy("flag").agg(F.count("*").alias("n"))


@query
def defender_parse(spark, sf):
    d = V.with_defender(B.verdicts(spark, sf))
    return d.select(
        "request_id", "defender_risk", F.col("defender_confidence").alias("confidence"),
        F.col("defender_reason").alias("reason"), csv_list(F.col("defender_threats")).alias("threats"),
    )


@query
def defender_band(spark, sf):
    d = V.with_defender(B.verdicts(spark, sf))
    return d.groupBy(V.defender_band(F.col("defender_risk")).alias("band")).agg(F.count("*").alias("n"))


@query
def defender_verdict_join(spark, sf):
    joined = V.join_verdicts(B.requests(spark, sf), B.verdicts(spark, sf), "request_id")
    d = V.with_defender(joined)
    return d.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.avg("defender_risk"), 4).alias("avg_risk"))


# -- similarity ---------------------------------------------------------------------------

CATEGORIES = [
    "JAILBREAK_ATTEMPT", "ROLE_INJECTION", "IGNORE_INSTRUCTIONS",
    "SYSTEM_OVERRIDE_ATTEMPT", "PROMPT_LEAKING_ATTEMPT", "CONTEXT_MANIPULATION",
]


def _bank_and_prompts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The five lowest ids of labels 0..5 are the exemplars; the other vectors are prompts."""
    vectors = B.typed_embeddings(spark, sf)
    ranked = vectors.filter(F.col("label") < len(CATEGORIES)).select("vec_id", "label")
    first = ranked.withColumn("_r", F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))).filter("_r <= 5")
    ids = F.broadcast(first.select("vec_id"))  # five per category: thirty rows
    bank = vectors.join(ids, "vec_id", "left_semi").withColumn("category", B.pick(CATEGORIES, F.col("label")))
    return bank, vectors.join(ids, "vec_id", "left_anti")


@query
def unit_normalize(spark, sf):
    v = similarity.unit_normalize(F.transform("embedding", lambda x: x * 3.0))
    return B.typed_embeddings(spark, sf).select(
        "vec_id", F.round(F.get(v, 0), 5).alias("x0"),
        F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x), 5).alias("norm2"),
    )


@query
def semantic_match(spark, sf):
    bank, prompts = _bank_and_prompts(spark, sf)
    m = similarity.semantic_match(prompts, bank, params=replace(Params(), similarity_threshold=0.30))
    return m.select("vec_id", F.explode("semantic_matches").alias("m")).select(
        "vec_id", "m.category", F.round("m.similarity", 3).alias("similarity")
    )


@query
def best_similarity(spark, sf):
    bank, prompts = _bank_and_prompts(spark, sf)
    m = similarity.semantic_match(prompts, bank)
    return m.select("vec_id", F.round("max_similarity", 3).alias("max_similarity"))


@query
def semantic_score(spark, sf):
    bank, prompts = _bank_and_prompts(spark, sf)
    m = similarity.semantic_match(prompts, bank, params=replace(Params(), similarity_threshold=0.30))
    return m.select("vec_id", V.semantic_score(F.col("semantic_flags"), F.col("max_similarity")).alias("semantic_score"))


# -- campaigns and anchored windows -------------------------------------------------------

@query
def campaign_exact(spark, sf):
    c = correlation.campaign_exact(B.typed_events(spark, sf), key="event_type", params=DENSE)
    return c.select("request_id", "exact_count", F.when(
        F.col("exact_count") >= 3, correlation.exact_confidence(F.col("exact_count"))
    ).otherwise(0.0).alias("confidence"))


@query
def campaign_fuzzy(spark, sf):
    c = correlation.campaign_fuzzy(B.typed_events(spark, sf), key="event_type", params=DENSE)
    return c.select("request_id", "fuzzy_count", F.when(
        F.col("fuzzy_count") >= 4, correlation.fuzzy_confidence(F.col("fuzzy_count"))
    ).otherwise(0.0).alias("confidence"))


@query
def distributed_attack(spark, sf):
    c = correlation.campaign_exact(B.typed_events(spark, sf), key="event_type", params=DENSE)
    return c.select("request_id", F.col("ip_count"), (F.col("ip_count") >= 3).alias("distributed"))


def _sightings(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprints, written once because several branches read them."""
    return materialize(B.spread(B.requests(spark, sf)).select(
        "request_id", "ts_us", "user_id", "client_ip",
        FP.prompt_hash(F.col("prompt")).alias("prompt_hash"), FP.prompt_pattern(F.col("prompt")).alias("prompt_pattern"),
    ))


@query
def correlation_check(spark, sf):
    c = correlation.correlation_check(_sightings(spark, sf), params=DAY_WINDOW)
    return c.select("request_id", "campaign_detected", "campaign_id", "confidence", "distributed")


@query
def anchored_window(spark, sf):
    r = B.requests(spark, sf).select("request_id", "user_id", "ts_us")
    return anchored.anchored_window(r, ["user_id"], "ts_us", DAY_US, "request_id").select(
        "request_id", "window_start", "window_index"
    )


@query
def quota_check(spark, sf):
    r = B.requests(spark, sf).select("request_id", "user_id", "ts_us")
    return anchored.quota_check(r, params=QUOTA).select("request_id", "quota_used", "quota_allowed")


def _campaign_log(spark: SparkSession, sf: str) -> DataFrame:
    c = correlation.correlation_check(_sightings(spark, sf), params=DAY_WINDOW)
    return anchored.campaign_log(c, params=DAY_WINDOW)


@query
def campaign_log(spark, sf):
    return _campaign_log(spark, sf)


@query
def campaign_topk(spark, sf):
    return anchored.active_campaigns(_campaign_log(spark, sf))


# -- blacklist and auth -------------------------------------------------------------------

def _control_from_events(spark: SparkSession, sf: str) -> DataFrame:
    """A control log as large as the event table: errors ban the user, signups lift the ban."""
    e = B.table(spark, sf, "events").filter(F.col("event_type").isin("error", "signup"))
    return e.select(
        F.lit("user").alias("kind"), F.col("user_id").cast("string").alias("key"),
        F.when(F.col("event_type") == "error", "add").otherwise("remove").alias("action"),
        F.concat(F.lit("value "), F.col("value").cast("int").cast("string")).alias("reason"),
        F.lit("auto").alias("triggered_by"), F.col("event_id").alias("seq"), B.micros(F.col("ts")).alias("ts_us"),
    )


@query
def blacklist_current(spark, sf):
    return CT.blacklist_current(_control_from_events(spark, sf))


@query
def blacklist_gate(spark, sf):
    gated = CT.blacklist_gate(B.requests(spark, sf), _control_from_events(spark, sf))
    return gated.select("request_id", "deny_reason")


@query
def blacklist_reason(spark, sf):
    gated = CT.blacklist_gate(B.requests(spark, sf), B.control_log(spark))
    return gated.groupBy("deny_reason").agg(F.count("*").alias("n"))


def auth_rows(requests: DataFrame, control: DataFrame, params: Params) -> DataFrame:
    """Blacklist, then quota: ``allowed``, ``reason`` and the quota position."""
    gated = CT.blacklist_gate(requests, control).select("request_id", "user_id", "ts_us", "deny_reason")
    open_rows = anchored.quota_check(gated.filter(F.col("deny_reason").isNull()), params=params)
    banned = gated.filter(F.col("deny_reason").isNotNull()).select(
        "*", F.lit(None).cast("int").alias("quota_used"), F.lit(False).alias("quota_allowed")
    )
    return open_rows.unionByName(banned).select(
        "request_id", F.col("quota_allowed").alias("allowed"),
        F.coalesce("deny_reason", F.when(~F.col("quota_allowed"), "quota exceeded")).alias("reason"),
        F.when(F.col("quota_allowed"), F.col("quota_used")).alias("quota_used"),
        F.lit(params.quota_limit).alias("quota_limit"),
    )


@query
def auth_check(spark, sf):
    return auth_rows(B.requests(spark, sf), B.control_log(spark), QUOTA)


# -- reputation ---------------------------------------------------------------------------

def _outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return as_outcomes(B.table(spark, sf, "events"))


def as_outcomes(events: DataFrame) -> DataFrame:
    """Errors are abuses, everything else a success whose cost is ``event_id % 100``."""
    return events.select(
        F.col("event_id").alias("request_id"), B.micros(F.col("ts")).alias("ts_us"),
        F.col("user_id").cast("string").alias("user_id"),
        F.when(F.col("event_type") == "error", "abuse").otherwise("success").alias("kind"),
        (F.col("event_id") % 100).cast("double").alias("cost"),
    )


def _folded(spark: SparkSession, sf: str) -> DataFrame:
    return reputation.reputation_fold(_outcomes(spark, sf), params=SQL_ROUNDING)


@query
def reputation_fold(spark, sf):
    return _folded(spark, sf).select(
        "request_id", F.round("trust_read", 3).alias("trust_read"), F.round("trust_score", 6).alias("trust_score"),
        "total_requests", "abuse_count",
    )


@query
def reputation_as_of(spark, sf):
    return _folded(spark, sf).select("request_id", "user_id", F.round("trust_read", 3).alias("trust_read"),
                                     PO.trust_tier(F.col("trust_read")).alias("tier"))


@query
def avg_cost_running(spark, sf):
    return _folded(spark, sf).select("request_id", F.round("avg_cost_score", 2).alias("avg_cost_score"))


@query
def blacklist_candidates(spark, sf):
    return reputation.blacklist_candidates(_folded(spark, sf))


def _board(spark: SparkSession, sf: str) -> DataFrame:
    states = reputation.latest_state(_folded(spark, sf))
    now = B.table(spark, sf, "events").agg(F.max(B.micros(F.col("ts")))).first()[0]
    banned = CT.blacklist_current(_control_from_events(spark, sf))
    return reputation.reputation_board(states, banned, now, params=SQL_ROUNDING)


@query
def reputation_board(spark, sf):
    return _board(spark, sf).select(
        "user_id", "trust_score", "tier", "abuse_count", "total_requests", "avg_cost_score", "last_seen_us",
        "is_blacklisted", "blacklist_reason",
    )


@query
def board_sort(spark, sf):
    """The order of the board as a column."""
    return reputation.board_sort(_board(spark, sf)).select("position", "user_id", "is_blacklisted", "trust_score")


@query
def board_reasons(spark, sf):
    """Why, by whom and since when users are blacklisted."""
    listed = _board(spark, sf).filter("is_blacklisted")
    return listed.select("user_id", F.col("blacklist_reason").alias("reason"), "triggered_by", "blacklisted_us")


@query
def reputation_kpis(spark, sf):
    return U.reputation_kpis(_board(spark, sf))


@query
def user_filter(spark, sf):
    return U.user_filter(_board(spark, sf), "1").select("user_id", "tier")


@query
def last_seen_format(spark, sf):
    return _board(spark, sf).select("user_id", U.last_seen_format(F.col("last_seen_us")).alias("last_seen"))


@query
def src_requests(spark, sf):
    """The user defaulting of the source: views carry no user, clicks an empty one."""
    e = B.table(spark, sf, "events")
    given = F.when(F.col("event_type") == "click", "").when(F.col("event_type") != "view", F.col("user_id").cast("string"))
    ip = F.concat(F.lit("10.0.0."), (F.col("user_id") % 7).cast("string"))
    return e.select(F.col("event_id").alias("request_id"), RQ.default_user(given, ip).alias("user_id"))


@query
def known_users(spark, sf):
    return RQ.known_users(B.requests(spark, sf))


@query
def reputation_snapshot(spark, sf):
    """States exported as JSON and imported again."""
    states = reputation.latest_state(_folded(spark, sf)).select(
        "user_id", F.round("trust_score", 6).alias("trust_score"), "total_requests", "abuse_count", "avg_cost_score"
    )
    back = RQ.reputation_from_json(RQ.reputation_to_json(states))
    return back.select("user_id", "trust_score", "total_requests", "abuse_count", "avg_cost_score")


@query
def reputation_reset(spark, sf):
    """Signups reset the user; the trust every later event reads starts over."""
    events = _outcomes(spark, sf).join(
        B.table(spark, sf, "events").select(F.col("event_id").alias("request_id"), "event_type"), "request_id"
    )
    kind = F.when(F.col("event_type") == "signup", "reset").otherwise(F.col("kind"))
    folded = reputation.reputation_fold(events.withColumn("kind", kind), params=SQL_ROUNDING)
    return folded.select("request_id", F.round("trust_read", 3).alias("trust_read"), "total_requests", "abuse_count")


@query
def inactivity_gap(spark, sf):
    """Hours since the user's previous request, without gathering a user in one task."""
    r = B.requests(spark, sf).select("request_id", "user_id", "ts_us")
    gaps = previous_in_key(r, ["user_id"], "ts_us", "request_id", HOUR_US)
    return gaps.select("request_id", F.round((F.col("ts_us") - F.col("previous_us")) / HOUR_US, 4).alias("hours"))


# -- policy tables --------------------------------------------------------------------------

def _scores(spark: SparkSession, sf: str) -> DataFrame:
    e = B.table(spark, sf, "events")
    i = F.col("event_id")
    return e.select(
        i.alias("request_id"), ((i * 7919) % 1001 / 1000.0).alias("trust"), (i % 101).cast("int").alias("cost"),
        ((i * 31) % 101).cast("int").alias("risk"), "value", B.micros(F.col("ts")).alias("ts_us"),
    )


@query
def trust_tier(spark, sf):
    return _scores(spark, sf).groupBy(PO.trust_tier(F.col("trust")).alias("tier")).agg(F.count("*").alias("n"))


@query
def trust_decay(spark, sf):
    s = _scores(spark, sf)
    now = F.col("ts_us") + F.col("cost") * HOUR_US
    return s.select("request_id", F.round(PO.trust_decay(F.col("trust"), F.col("ts_us"), now, SQL_ROUNDING), 3).alias("trust"))


@query
def risk_tier(spark, sf):
    return _scores(spark, sf).groupBy(PO.risk_tier(F.col("risk")).alias("tier")).agg(F.count("*").alias("n"))


@query
def trust_multiplier(spark, sf):
    return _scores(spark, sf).select("request_id", PO.trust_multiplier(F.col("trust")).alias("multiplier"))


@query
def token_budget(spark, sf):
    return _scores(spark, sf).select("request_id", PO.token_budget(F.col("risk"), F.col("trust")).alias("tokens"))


@query
def challenge_required(spark, sf):
    return _scores(spark, sf).select("request_id", PO.challenge_required(F.col("trust"), F.col("cost")).alias("required"))


@query
def proof_audit(spark, sf):
    e = B.table(spark, sf, "events")
    audit = PO.proof_audit(
        F.col("event_id").cast("string"), F.round("value", 0).cast("int").cast("string"),
        F.col("event_id") % 600, replace(Params(), proof_prefix="0"),
    )
    a = e.select(F.col("event_id").alias("request_id"), audit.alias("a"))
    return a.select("request_id", "a.verified", "a.reason")


@query
def proof_submissions(spark, sf):
    """Submissions as they arrive: absent, broken, with an unknown token, too late, wrong or right."""
    i = F.col("event_id")
    token = F.concat(F.lit("t"), i.cast("string"))
    nonce = F.round("value", 0).cast("int").cast("string")
    sent = (
        F.when(i % 5 == 0, None).when(i % 5 == 1, F.concat(F.lit("nonce "), nonce))
        .when(i % 5 == 2, F.concat(F.lit('{"jwt":"'), token, F.lit('","nonce":"'), nonce, F.lit('"} more')))
        .otherwise(F.concat(F.lit('{"jwt":"'), token, F.lit('","nonce":'), nonce, F.lit("}")))
    )
    e = B.table(spark, sf, "events")
    requests = e.select(i.alias("request_id"), B.micros(F.col("ts")).alias("ts_us"), sent.alias("challenge_response"))
    challenges = e.filter(i % 7 != 0).select(
        token.alias("jwt"), i.cast("string").alias("challenge"), (B.micros(F.col("ts")) - (i % 600) * 1_000_000).alias("issued_us")
    )
    return with_proofs(requests, challenges, replace(Params(), proof_prefix="0")).select("request_id", "proof", "proof_reason")


# -- gate, report and roll-ups ----------------------------------------------------------------

GATE = replace(Params(), rounding="half_up", correlation_window_s=86400)


def protection_requests(spark: SparkSession, sf: str) -> DataFrame:
    return B.spread(B.judged_requests(spark, sf))


def protection_reports(spark: SparkSession, sf: str) -> DataFrame:
    return P.protect(protection_requests(spark, sf), B.control_log(spark), GATE)


#: A cost model with weights of our own, under which the probe prompts reach every cost band.
STEEP_MODEL = M.CostModel(list(C.FEATURES), [0.0] * 4, [1.0] * 4, [0.06, 0.05, 0.05, 0.03], -1.5, 0, 0)


def evidence_reports(spark: SparkSession, sf: str) -> DataFrame:
    """Reports on all the evidence there is: vectors, verdicts, submissions' outcomes and a cost model.

    A request takes the vector whose place among the prompts' vectors is its id modulo their number.
    """
    bank, vectors = _bank_and_prompts(spark, sf)
    matched = similarity.semantic_match(vectors, bank, params=replace(Params(), similarity_threshold=0.30))
    placed = materialize(global_rank(matched, [F.asc("vec_id")]).select("position", "semantic_flags", "semantic_matches", "max_similarity"))
    many = placed.count()
    i = F.col("request_id")
    requests = B.judged_requests(spark, sf).withColumns({"proof": (i % 3 - 1).cast("int"), "position": i % many + 1})
    return P.protect(requests.join(placed, "position").drop("position"), B.control_log(spark), GATE, model=STEEP_MODEL)


_REPORTS: dict[tuple[str, str], DataFrame] = {}


def report_log(spark: SparkSession, sf: str) -> DataFrame:
    """The report table as the log keeps it: written once per session, read by every roll-up."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _REPORTS:
        _REPORTS[key] = materialize(protection_reports(spark, sf))
    return _REPORTS[key]


def _gate_requests(spark: SparkSession, events: DataFrame) -> DataFrame:
    """Requests with costs and proofs that reach every exit, past the blacklist."""
    i = F.col("event_id")
    return CT.blacklist_gate(events.select(
        i.alias("request_id"), B.micros(F.col("ts")).alias("ts_us"), F.col("user_id").cast("string").alias("user_id"),
        F.concat(F.lit("10.0.0."), (F.col("user_id") % 7).cast("string")).alias("client_ip"),
        (F.col("event_type") == "error").alias("risk_block"),
        ((F.col("event_type") == "purchase") & (i % 3 == 0)).alias("recursive_detected"),
        (i % 101).cast("int").alias("cost_score"), (i % 3 - 1).cast("int").alias("proof"),
        F.when(i % 11 == 0, 0.7).otherwise(0.1).alias("defender_risk"),
    ), B.control_log(spark))


def _gate_columns(g: DataFrame) -> DataFrame:
    return g.select(
        "request_id", "exit", "auth_tier", "quota_used", F.round("trust_read", 3).alias("trust_read"),
        F.round("trust_after", 6).alias("trust_after"), "candidate",
    )


@query
def request_gate(spark, sf):
    """The cascade alone, with costs and proofs that reach every exit."""
    return _gate_columns(gate.request_gate(_gate_requests(spark, B.table(spark, sf, "events")), GATE))


def _report_columns(r: DataFrame) -> DataFrame:
    b = F.col("detection_breakdown")
    return r.select(
        "request_id", "user_id", "cost_score", csv_list(F.col("risk_flags")).alias("risk_flags"), "risk_score",
        F.round("trust_score", 3).alias("trust_score"), "tokens_allocated", "campaign_detected", "campaign_id",
        "recursive_detected", "challenge_triggered", "defender_risk", "blocked", "block_reason", "status",
        b["entropy"].alias("entropy_band"), b["risk"].alias("risk_band"),
        b["reputation"].alias("reputation_band"), b["defender"].alias("defender_band"),
    )


@query
def protection_report(spark, sf):
    return _report_columns(protection_reports(spark, sf))


@query
def protection_report_evidence(spark, sf):
    """Every exit and every band, with the semantic detector, a cost model and proofs."""
    return _report_columns(evidence_reports(spark, sf))


@query
def detector_comparison_evidence(spark, sf):
    """The three detectors, none of them silent."""
    return U.detector_comparison(evidence_reports(spark, sf))


@query
def protection_report_repeated_ids(spark, sf):
    """The pipeline on a log whose request ids repeat: one report for every row, with its own exit."""
    requests = protection_requests(spark, sf).withColumn("request_id", F.col("request_id") % 1000)
    return P.protect(requests, B.control_log(spark), GATE).select(
        "request_id", "user_id", "cost_score", "risk_score", "exit", "blocked", "status",
    )


@query
def block_reason(spark, sf):
    return report_log(spark, sf).groupBy("exit", "block_reason").agg(F.count("*").alias("n"))


@query
def metrics_counters(spark, sf):
    return U.metrics_counters(report_log(spark, sf))


@query
def block_rate(spark, sf):
    return U.block_rate(U.metrics_counters(report_log(spark, sf))).select("block_rate")


@query
def threat_level_band(spark, sf):
    return U.threat_level(U.metrics_counters(report_log(spark, sf))).select("block_rate", "band", "delta", "alarm")


@query
def metrics_long(spark, sf):
    return U.metrics_long(U.metrics_counters(report_log(spark, sf)))


@query
def history_kpis(spark, sf):
    return U.history_kpis(report_log(spark, sf))


@query
def detector_comparison(spark, sf):
    return U.detector_comparison(report_log(spark, sf))


@query
def flag_counts(spark, sf):
    return U.flag_counts(report_log(spark, sf))


@query
def layer_state(spark, sf):
    return U.layer_state(report_log(spark, sf)).groupBy("layer", "title", "state").agg(F.count("*").alias("n"))


@query
def layer_detail(spark, sf):
    return U.layer_state(report_log(spark, sf)).select("request_id", "layer", "detail")


@query
def status_label(spark, sf):
    return U.status_label(report_log(spark, sf)).select("request_id", "label", "prompt", "risk_score")


@query
def request_label(spark, sf):
    return U.request_label(report_log(spark, sf))


@query
def history_topk(spark, sf):
    return U.request_history(report_log(spark, sf)).select("request_id", "ts_us", "user_id", "status")


@query
def flatten_history(spark, sf):
    log = RQ.log_entries(report_log(spark, sf))
    return U.flatten_history(log).select(F.col("report.request_id").alias("request_id"), "user_id", "prompt")


@query
def blocked_filter(spark, sf):
    return U.blocked_filter(report_log(spark, sf)).select("request_id", "user_id", "block_reason")


@query
def sink_request_log(spark, sf):
    """Reports appended to the log by day, read back and counted."""
    path = workspace_path(spark)
    RQ.write_request_log(report_log(spark, sf), path)
    log = RQ.read_request_log(spark, path)
    return log.groupBy("date").agg(F.count("*").alias("n"), F.count_if("report.blocked").alias("blocked"))


# -- the cost model -----------------------------------------------------------------------------

def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with their toxicity label, and requests labelled by the rule score of their prompt."""
    docs = B.table(spark, sf, "documents").select("doc_id", F.col("text").alias("prompt"))
    labels = B.table(spark, sf, "labels").select("doc_id", F.col("toxic").alias("label"))
    documents = docs.join(labels, "doc_id").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("row_id"), "prompt", "label")
    requests = B.requests(spark, sf)
    risky = (F.col("request_id") % len(B.PROBE_PROMPTS)).between(8, 26).cast("int")
    asked = requests.select(F.concat(F.lit("r"), F.col("request_id").cast("string")).alias("row_id"), "prompt", risky.alias("label"))
    return M.dataset_union(documents, asked)


@query
def label_counts(spark, sf):
    return M.label_counts(_labelled(spark, sf))


@query
def stratified_split(spark, sf):
    s = M.stratified_split(_labelled(spark, sf).select("row_id", "label"), "row_id")
    return s.select("row_id", "label", "split")


@query
def classification_metrics(spark, sf):
    """Evaluates the fallback scorer (a cost above 5 counts as risky)."""
    f = M.extract_features(B.spread(_labelled(spark, sf)))
    scored = f.select("label", (F.col("cost_score") > 5).cast("int").alias("prediction"))
    m = M.classification_metrics(scored)
    return m.select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "accuracy")], "support")


def _trained(spark: SparkSession, sf: str):
    data = _labelled(spark, sf)
    features = materialize(M.extract_features(B.spread(M.stratified_split(data, "row_id"))).select(
        "row_id", "label", "split", *C.FEATURES
    ))
    return M.train_cost_model(features.filter("split = 'train'")), features


@query
def train_cost_model(spark, sf):
    model, features = _trained(spark, sf)
    m = M.classification_metrics(M.score(model, features.filter("split = 'test'")))
    return m.select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "accuracy")], "support")


@query
def feature_weights(spark, sf):
    model, _ = _trained(spark, sf)
    return M.feature_weights(spark, model).select("feature", F.round("weight", 4).alias("weight"))


@query
def cost_score_ml(spark, sf):
    model, features = _trained(spark, sf)
    return M.score(model, features).select("row_id", "label", "cost_score", "scoring_method")


# -- streams: the event table as files in order of arrival, run until everything is processed -----------

def _arriving(spark: SparkSession, sf: str, make) -> DataFrame:
    """What ``make`` gives for the arriving events, with event time and watermark, up to the heartbeat."""
    events, end = B.arrivals(spark, sf)
    return ST.before(ST.with_event_time(make(events), "1 hour"), end)


def _arriving_sightings(spark: SparkSession, sf: str) -> DataFrame:
    def sightings(events):
        return B.as_requests(events).withColumns({
            "prompt_hash": FP.prompt_hash(F.col("prompt")), "prompt_pattern": FP.prompt_pattern(F.col("prompt")),
        }).drop("prompt")

    return _arriving(spark, sf, sightings)


@query
def stream_signals(spark, sf):
    out = run_available(ST.stream_signals(B.as_requests(B.event_stream(spark, sf))))
    return out.select("request_id", "cost_score", csv_list(F.col("rule_flags")).alias("rule_flags"), "recursive_detected")


@query
def stream_quota(spark, sf):
    requests = _arriving(spark, sf, lambda e: B.as_requests(e).drop("prompt", "client_ip"))
    return run_available(ST.stream_quota(requests, QUOTA)).select("request_id", "quota_used", "quota_allowed")


def _trust_columns(out: DataFrame) -> DataFrame:
    return out.select(
        "request_id", F.round("trust_read", 3).alias("trust_read"), F.round("trust_score", 6).alias("trust_score"),
        "total_requests", "abuse_count",
    )


@query
def stream_reputation(spark, sf):
    return _trust_columns(run_available(ST.stream_reputation(_arriving(spark, sf, as_outcomes), SQL_ROUNDING)))


@query
def stream_reputation_resumed(spark, sf):
    """The stream again from a snapshot: the states at the middle of the log, then only what comes after."""
    outcomes = _outcomes(spark, sf)
    low, high = outcomes.agg(F.min("ts_us"), F.max("ts_us")).first()
    middle = (low + high) // 2
    earlier = reputation.reputation_fold(outcomes.filter(F.col("ts_us") < middle), params=SQL_ROUNDING)
    path = workspace_path(spark)
    RQ.save_snapshot(reputation.latest_state(earlier), path)
    known = ST.trust_state(RQ.load_snapshot(spark, path, middle, SQL_ROUNDING.reputation_ttl_s * 1_000_000))
    later = _arriving(spark, sf, as_outcomes).filter(F.col("event_time") >= F.timestamp_micros(F.lit(middle)))
    return _trust_columns(run_available(ST.stream_reputation(later, SQL_ROUNDING, known)))


@query
def stream_correlation(spark, sf):
    out = run_available(ST.stream_correlation(_arriving_sightings(spark, sf), DAY_WINDOW))
    return out.select("request_id", "track", "senders", "addresses")


@query
def stream_campaigns(spark, sf):
    out = run_available(ST.stream_campaigns(_arriving_sightings(spark, sf), DAY_WINDOW))
    return out.select("request_id", "campaign_detected", "campaign_id", "confidence", "distributed")


@query
def stream_campaign_log(spark, sf):
    """Every sighting counts as a detection here: one campaign per prompt and day."""
    return run_available(ST.stream_campaign_log(_arriving_sightings(spark, sf), DAY_WINDOW))


@query
def stream_gate(spark, sf):
    """The cascade of ``request_gate`` as its requests arrive."""
    requests = _arriving(spark, sf, lambda events: _gate_requests(spark, events))
    return _gate_columns(run_available(ST.stream_gate(requests, GATE)))


@query
def stream_request_log(spark, sf):
    """The newest requests of the log that a stream of them keeps."""
    events, end = B.arrivals(spark, sf)
    folder = workspace_path(spark)
    requests = B.as_requests(events).drop("prompt").filter(F.col("ts_us") < end)
    keep_newest(requests, folder, Params.log_kept, ["ts_us", "request_id"])
    return newest(spark, folder).select("request_id", "ts_us", "user_id")


@query
def late_data(spark, sf):
    """Events behind the watermark, by the trigger that brought them."""
    events, end = B.arrivals(spark, sf, stragglers=True)
    folder = workspace_path(spark)
    split_late(events.select(F.col("event_id").alias("request_id"), B.micros(F.col("ts")).alias("ts_us")), folder, B.DELAY_US)
    late = spark.read.schema("request_id bigint, ts_us bigint, watermark_us bigint, trigger int").parquet(f"{folder}/late")
    return late.select("request_id", "watermark_us", "trigger")


@query
def stream_metrics(spark, sf):
    kinds = B.event_stream(spark, sf).select(
        F.when(F.col("event_type") == "error", "risk").when(F.col("event_type") == "signup", "auth").otherwise("allowed").alias("exit")
    )
    return run_totals(ST.stream_metrics(kinds.withColumn("blocked", F.col("exit") != "allowed")))
