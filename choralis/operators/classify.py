"""A transparent rule score for accounts, with its reasons, and the mapping of an external scorer's answers."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from choralis.config import Config, Thresholds
from choralis.functions.exact import clamp, label, percent, round3
from choralis.functions.signals import BIO_POINTERS, text_signals
from choralis.operators.answers import AnswerCache, key_of



def requests(features: DataFrame, graph: DataFrame, accounts: DataFrame, posts: DataFrame, replies: DataFrame, similar: DataFrame, patterns: DataFrame) -> DataFrame:
    """One row for each account: what a scorer is told about it."""
    text = replies.select("conv_id", "pos", "reply_id", "account_id", "text")
    rep = text.withColumnsRenamed({"reply_id": "representative", "text": "reply_text"}).select("conv_id", "representative", "reply_text")
    near = similar.select("conv_id", F.col("reply_id").alias("representative"), "account_id", F.posexplode("first_neighbours").alias("k", "pos"))
    near = near.join(text.select("conv_id", "pos", F.col("account_id").alias("other"), "text"), ["conv_id", "pos"]).where(F.col("other") != F.col("account_id"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("k", "text"))), lambda x: x["text"])
    near = near.groupBy("conv_id", "representative").agg(F.slice(F.array_distinct(listed), 1, 4).alias("neighbour_texts"))
    own = text.groupBy("conv_id", "account_id").agg(F.sort_array(F.collect_list(F.struct("pos", "reply_id", "text"))).alias("own"))
    rank = features.select("conv_id", "account_id", F.posexplode("pattern_ranks").alias("k", "rank"))
    known = patterns.select("conv_id", "rank", "account_count", F.col("text").alias("phrase"))
    by = rank.join(known, ["conv_id", "rank"]).groupBy("conv_id", "account_id").agg(
        F.transform(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("account_count")).alias("n"), "k", "phrase"))), 1, 3), lambda x: x["phrase"]).alias("phrases"),
        F.max("account_count").alias("phrase_accounts"),
    )
    none = F.array().cast("array<string>")
    out = features.join(graph.drop("first_seconds", "first_pos"), ["conv_id", "account_id"]).join(accounts.drop("first_pos"), ["conv_id", "account_id"])
    out = out.join(posts.select("conv_id", "kind", F.col("text").alias("post_text")), "conv_id").join(rep, ["conv_id", "representative"])
    out = out.join(near, ["conv_id", "representative"], "left").join(own, ["conv_id", "account_id"]).join(by, ["conv_id", "account_id"], "left")
    texts = F.transform("own", lambda x: x["text"])
    parent = F.when(F.col("kind") != "feed", F.col("post_text"))
    return out.select(
        *[c for c in out.columns if c not in ("own", "post_text", "phrases", "phrase_accounts", "neighbour_texts")],
        F.coalesce("phrases", none).alias("phrases"),
        F.coalesce("phrase_accounts", F.lit(0)).alias("phrase_accounts"),
        F.coalesce("neighbour_texts", none).alias("neighbour_texts"),
        F.transform(F.filter("own", lambda x: x["reply_id"] != F.col("representative")), lambda x: x["text"]).alias("other_texts"),
        text_signals(texts, parent).alias("signals"),
    )


def _n(name: str) -> Column:
    return F.size(F.col(f"signals.{name}"))


def _joined(name: str) -> Column:
    return F.array_join(F.col(f"signals.{name}"), ", ")


def _strong_adult() -> Column:
    return F.exists("signals.adult", lambda x: ~x.isin(BIO_POINTERS))


def _pointed() -> Column:
    return (F.col("signals.mentions") > 0) | (_n("messaging") > 0)


def _spam_rules() -> list[tuple[Column, Column, Column]]:
    """(condition, weight, wording) of the spam rules, in their order."""
    # Bounds, weights and wordings.
    s, lit = lambda x: F.col(f"signals.{x}"), F.lit
    linked = s("links") > 0
    return [
        (_n("messaging") > 0, lit(0.45), F.concat(lit("Points people to an off-platform contact ("), _joined("messaging"), lit(")"))),
        (
            _n("crypto") >= 2,
            F.when(linked, 0.45).otherwise(0.25),
            F.concat(lit("Wallet, giveaway or token language ("), _joined("crypto"), lit(")"), F.when(linked, " with a link").otherwise("")),
        ),
        (_n("urgency") > 0, F.when(_n("urgency") >= 2, 0.2).otherwise(0.08), F.concat(lit("Pressure language ("), _joined("urgency"), lit(")"))),
        (_n("shortened") > 0, lit(0.15), F.concat(lit("Link shortener hides the destination ("), _joined("shortened"), lit(")"))),
        (F.coalesce(s("parent_overlap") < 0.05, lit(False)) & linked, lit(0.2), lit("Off-topic reply carrying a link")),
        (s("thread_hook"), lit(0.12), lit('Thread-bait hook (🧵, 👇, "1/10", "so you don\'t have to")')),
        ((s("emojis") >= 3) & (s("emoji_density") >= 0.12), lit(0.08), F.concat(lit("Dense emoji styling ("), s("emojis").cast("string"), lit(" emojis)"))),
        (s("uppercase_ratio") >= 0.5, lit(0.05), lit("Mostly upper-case text")),
        (_strong_adult(), lit(0.7), F.concat(lit("Adult or dating lure ("), _joined("adult"), lit(")"))),
        ((_n("adult") > 0) & ~_strong_adult(), lit(0.1), lit("Points readers to a bio or profile link")),
        (
            _n("money") > 0,
            F.when(_pointed() & (_n("money") >= 2), 0.7).when(_pointed(), 0.5).otherwise(0.2),
            F.concat(lit("Profit or recovery claim ("), _joined("money"), lit(")"), F.when(_pointed(), " pointing to another account or contact").otherwise("")),
        ),
        (_n("job") > 0, F.when((_n("job") >= 2) | (_n("messaging") > 0), 0.45).otherwise(0.2), F.concat(lit("Job-scam language ("), _joined("job"), lit(")"))),
        (_n("follow") > 0, F.when(_n("follow") >= 2, 0.7).otherwise(0.45), F.concat(lit("Follower farming ("), _joined("follow"), lit(")"))),
        (s("generic_praise"), lit(0.3), lit("Generic praise that could sit under any post")),
    ]


def _total(rules: list[tuple[Column, Column, Column | None]]) -> Column:
    out = F.lit(0.0)
    for when, weight, _ in rules:
        out = out + F.when(F.coalesce(when, F.lit(False)), weight).otherwise(0.0)
    return out


def _wordings(rules: list[tuple[Column, Column, Column | None]]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(when, F.lit(False)), text) for when, _, text in rules if text is not None]))


def spam_floor() -> Column:
    return F.least(F.lit(0.95), _total(_spam_rules()))


def _behaviour_rules() -> list[tuple[Column, Column, Column | None]]:
    # Bounds, weights and wordings.
    c, lit = F.col, F.lit
    skew = (c("following") >= 5 * F.greatest(lit(1), c("followers"))) & (c("following") >= 200) & c("followers").isNotNull()
    yes = lit(True)
    return [
        (yes, 0.28 * clamp((c("max_sim") - 0.25) / 0.7), None),
        (c("max_sim") >= 0.5, lit(0.0), F.concat(percent(c("max_sim")), lit(" text similarity with another reply"))),
        (c("near_duplicate"), lit(0.10), lit("Near-duplicate of another reply in this conversation")),
        (c("in_burst"), lit(0.10), F.concat(c("within60").cast("string"), lit(" similar replies posted within 60 seconds"))),
        (
            (c("reply_count") > 1) & (c("self_similarity") >= 0.8),
            lit(0.10),
            F.concat(lit("Posted the same reply "), c("reply_count").cast("string"), lit(" times ("), percent(c("self_similarity")), lit(" self-similarity)")),
        ),
        (c("phrase_accounts") >= 3, lit(0.06), F.concat(lit("Uses a stock phrase shared by "), c("phrase_accounts").cast("string"), lit(" accounts"))),
        (c("regularity") >= 0.85, lit(0.05), F.concat(lit("Similar replies arrive at evenly spaced intervals ("), percent(c("regularity")), lit(" regularity)"))),
        (yes, 0.05 * clamp((1 - c("lex")) / 0.4), None),
        (c("lex") < 0.75, lit(0.0), F.concat(lit("Low lexical variation ("), percent(c("lex")), lit(")"))),
        (c("account_age_days").isNotNull(), 0.12 * clamp(1 - c("account_age_days") / 365.0), None),
        (c("account_age_days") < 180, lit(0.0), F.concat(lit("Account is "), c("account_age_days").cast("string"), lit(" days old"))),
        (skew, lit(0.05), F.concat(lit("Follows "), c("following").cast("string"), lit(" accounts but has "), c("followers").cast("string"), lit(" followers"))),
        (c("posts_per_day").isNotNull(), 0.07 * clamp((c("posts_per_day") - 15) / 45), None),
        (c("posts_per_day") >= 25, lit(0.0), F.format_string("Posts about %.0f times per day", c("posts_per_day"))),
    ]


def _counter_rules() -> list[tuple[Column, Column, Column | None]]:
    # Bounds, weights and wordings.
    c, lit = F.col, F.lit
    age = c("account_age_days")
    return [
        (age >= 1500, lit(0.25), F.format_string("Account history spans %.1f years", age / 365.0)),
        ((age >= 730) & (age < 1500), lit(0.12), lit("Account is more than two years old")),
        (c("max_sim") < 0.35, lit(0.15), lit("Reply language is distinct from every other reply")),
        (c("within60") == 0, lit(0.0), lit("No similar replies posted around the same time")),
        ((c("lex") >= 0.9) & (c("max_sim") < 0.5), lit(0.0), F.concat(lit("Varied vocabulary ("), percent(c("lex")), lit(" lexical diversity)"))),
        ((c("followers") >= c("following")) & (age >= 365), lit(0.0), F.concat(lit("Established audience ("), c("followers").cast("string"), lit(" followers)"))),
    ]


def category(name: Column) -> Column:
    """The kind of posting; name is the label."""
    s = lambda x: F.col(f"signals.{x}")
    job = (_n("job") >= 2) | ((_n("job") > 0) & (_n("messaging") > 0))
    scam = (_n("messaging") > 0) | (_n("crypto") >= 2) | _strong_adult() | ((_n("money") > 0) & _pointed()) | job
    return (
        F.when(scam & (name != "human_like"), "scam")
        .when(_n("milestones") > 0, "milestone")
        .when((_n("promotions") >= 2) | ((_n("promotions") > 0) & ((_n("ai_style") >= 2) | (s("hashtags") >= 3))), "ai_ad")
        .when((_n("ai_style") >= 3) & s("substantive"), "ai_useful")
        .when(_n("ai_style") >= 3, "ai_low_value")
        .when(name == "human_like", "personal")
        .when(_n("follow") > 0, "follow_farming")
        .when(s("generic_praise"), "generic_comment")
        .when(s("thread_hook"), "engagement_bait")
        .otherwise(category_of_label(name))
    )


def category_of_label(name: Column) -> Column:
    return F.when(name == "human_like", "personal").when(name == "uncertain", "mixed").otherwise("automated")


def coordination_likelihood() -> Column:
    n, best = F.col("coordinated"), F.col("max_score")
    alone = round3(F.least(F.lit(0.2), 0.05 + 0.03 * F.col("within60")))
    return F.when(n == 0, alone).otherwise(round3(clamp(best * (0.45 + 0.55 * (1 - F.exp(-n / 2.5))))))


def summary(automation: Column, coordination: Column, has_metadata: Column, t: Thresholds) -> Column:
    # The wordings.
    first = (
        F.when(automation < t.human, "Signals are consistent with individual human activity")
        .when(automation < t.automation, "Signals are mixed")
        .otherwise("Signals suggest automated behavior")
    )
    second = F.when(coordination >= 0.65, ", with strong coordination with other accounts.").when(coordination >= 0.4, ", with some coordination with other accounts.").otherwise(".")
    third = F.when(has_metadata, "").otherwise(" Account metadata was unavailable, so only text, timing and graph signals were used.")
    return F.concat(first, second, third, F.lit(" Local heuristic; behavioral patterns are not proof of automation."))


def heuristic(asked: DataFrame, config: Config) -> DataFrame:
    """asked with automation, coordination, confidence, label, category, signals for and against, and a summary."""
    t = config.thresholds
    behaviour, counter, spam = _behaviour_rules(), _counter_rules(), _spam_rules()
    raw = 0.05 + _total(behaviour)
    raw = F.when(F.col("has_metadata"), raw).otherwise(raw / 0.76)
    raw = raw * (1 - F.least(F.lit(0.5), _total(counter)))
    out = asked.withColumn("automation", round3(clamp(F.greatest(raw, spam_floor()), 0.01, 0.97))).withColumn("coordination", coordination_likelihood())
    out = out.withColumn("signals_for", F.concat(_wordings(behaviour), _wordings(spam))).withColumn("signals_against", _wordings(counter))
    evidence = F.size("signals_for") + F.size("signals_against")
    confidence = round3(clamp(0.35 + F.abs(F.col("automation") - 0.5) * 0.7 + F.least(F.lit(0.12), evidence * 0.02), 0.0, 0.85))
    n = F.col("coordinated")
    shared = [
        (n > 0, None, F.concat(F.lit("Coordinated text and timing with "), n.cast("string"), F.lit(" other account"), F.when(n == 1, "").otherwise("s"), F.lit(" (strongest link "), percent(F.col("max_score")), F.lit(")"))),
        (F.col("component_size") >= 3, None, F.concat(F.lit("Member of a "), F.col("component_size").cast("string"), F.lit("-account group averaging "), percent(F.col("component_similarity")), F.lit(" text similarity"))),
    ]
    out = out.withColumn("confidence", confidence).withColumn("label", label(F.col("automation"), t.human, t.automation))
    out = out.withColumn("coordination_signals", _wordings(shared)).withColumn("category", category(F.col("label")))
    return out.withColumn("summary", summary(F.col("automation"), F.col("coordination"), F.col("has_metadata"), t)).withColumn("source", F.lit("LOCAL_HEURISTIC"))


# -- external scorers

ANSWER = "label string, automation double, coordination double, confidence double, signals_for array<string>, signals_against array<string>, coordination_signals array<string>, summary string, category string"
LABELS = ("human_like", "uncertain", "automation_like")
#: Spam types of the typed answers, their weights and wordings.
SPAM_TYPES = {
    "reply_phishing": (1.0, "reply-guy phishing: fake support pointing to a DM, Telegram or WhatsApp contact"),
    "airdrop_scam": (1.0, "airdrop or giveaway scam asking people to connect a wallet or click a link"),
    "investment_scam": (1.0, "investment scam: profit testimonials, trading mentors or signal groups"),
    "recovery_scam": (1.0, "recovery scam: a third party offering to get lost funds or hacked accounts back"),
    "job_scam": (1.0, "job scam: work-from-home riches, #Interested comment harvesting or a move to WhatsApp"),
    "adult_spam": (1.0, "adult or dating lure pointing to a bio or link"),
    "affiliate_spam": (1.0, "off-topic affiliate or dropshipping link spam"),
    "engagement_bait": (0.85, "copypasta engagement bait built from growth-hack templates"),
    "follow_farming": (0.85, "follower farming: follow-for-follow or selling followers"),
    "generic_ai_comment": (0.8, "generic comment that could sit under any post, typical of AI comment tools and engagement pods"),
}
YES_NO = (
    "coordination", "repetition", "timing", "individuality", "sharedPattern", "aiGenerated", "engagementBait", "contentFarm",
    "tooLittleText", "promotional", "informative", "milestone",
)
QUESTIONS = {"automation": ("automated", "human"), "spamType": ("none", *SPAM_TYPES), **{q: ("yes", "no") for q in YES_NO}}


class BadAnswer(ValueError):
    """A scorer's answer that breaks its contract."""


def _number(node: object, name: str) -> float:
    value = node.get(name) if isinstance(node, dict) else None
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        raise BadAnswer(f"answer lacks a numeric {name}")
    if not math.isfinite(value) or not 0 <= value <= 1:
        raise BadAnswer(f"{name} must lie in [0, 1]")
    return float(value)


def parse_answer(answer: str) -> dict:
    """The plain contract: known label, three probabilities, lists of strings, a summary that isn't blank."""
    try:
        tree = json.loads(answer)
    except ValueError as e:
        raise BadAnswer("answer is no JSON") from e
    if not isinstance(tree, dict):
        raise BadAnswer("answer must be an object")
    told = tree.get("summary")
    if not isinstance(told, str) or not told.strip():
        raise BadAnswer("answer lacks a summary")
    if tree.get("classification") not in LABELS:
        raise BadAnswer("unknown classification")
    out = {"label": tree["classification"], "summary": told, "category": None}
    for name, field in (("automation", "automationLikelihood"), ("coordination", "coordinationLikelihood"), ("confidence", "confidence")):
        out[name] = _number(tree, field)
    for name, field in (("signals_for", "signalsForAutomation"), ("signals_against", "signalsAgainstAutomation"), ("coordination_signals", "coordinationSignals")):
        values = tree.get(field)
        if values is not None and not (isinstance(values, list) and all(isinstance(x, str) for x in values)):
            raise BadAnswer(f"{field} must be a list of strings")
        out[name] = values or []
    return out


def _choice(answers: dict, name: str, kinds: tuple[str, ...]) -> tuple[str, dict[str, float]]:
    node = answers.get(name)
    if not isinstance(node, dict) or node.get("type") != "choice" or node.get("choice") not in kinds:
        raise BadAnswer(f"{name} must be a choice among {len(kinds)}")
    p = {k: _number(node.get("probabilities"), k) for k in kinds}
    if abs(sum(p.values()) - 1) > 0.01:
        raise BadAnswer(f"{name}'s probabilities must sum to one")
    return node["choice"], p


def _yes(answers: dict, name: str) -> float:
    node = answers.get(name)
    if not isinstance(node, dict) or node.get("type") != "noul":
        raise BadAnswer(f"{name} must be a probability answer")
    return _number(node, "noul")


def _told(text: str, p: float) -> str:
    return f"{text} ({math.floor(p * 100 + 0.5)}%)"


def typed_category(spam: str | None, p: dict[str, float], name: str) -> str:
    if spam:
        return {"engagement_bait": "engagement_bait", "follow_farming": "follow_farming", "generic_ai_comment": "generic_comment"}.get(spam, "scam")
    if p["tooLittleText"] >= 0.6:
        return "too_little_text"
    if p["milestone"] >= 0.6:
        return "milestone"
    if p["promotional"] >= 0.6:
        return "ai_ad"
    if p["aiGenerated"] >= 0.5:
        return "ai_useful" if p["informative"] >= 0.5 else "ai_low_value"
    if max(p["engagementBait"], p["contentFarm"]) >= 0.6:
        return "engagement_bait" if p["engagementBait"] >= p["contentFarm"] else "content_farm"
    return {"human_like": "personal", "uncertain": "mixed"}.get(name, "automated")


def map_typed_answers(answer: str, t: Thresholds = Thresholds(), who: str = "Scorer") -> dict:
    """The typed contract: a choice of automated or human, twelve probabilities and a choice of spam type."""
    try:
        tree = json.loads(answer)
    except ValueError as e:
        raise BadAnswer("answer is no JSON") from e
    answers = tree.get("answers") if isinstance(tree, dict) else None
    if not isinstance(answers, dict):
        raise BadAnswer("answers are missing")
    _, auto = _choice(answers, "automation", QUESTIONS["automation"])
    confidence = _number(answers["automation"], "confidence")
    p = {q: _yes(answers, q) for q in YES_NO}
    chosen, spam = _choice(answers, "spamType", QUESTIONS["spamType"])
    named = chosen if chosen != "none" and spam[chosen] >= 0.5 else None
    signs = [_told(f"{who}: {SPAM_TYPES[named][1]}", spam[named])] if named else []
    for q, text in (("aiGenerated", "text likely written by an AI model"), ("engagementBait", "engagement farming, spam or scam content"), ("contentFarm", "content-farm or aggregator posting")):
        if p[q] >= 0.6:
            signs.append(_told(f"{who}: {text}", p[q]))
    for q, text in (("repetition", "templated or near-duplicate language"), ("timing", "timing patterns consistent with automation")):
        if p[q] >= 0.75:
            signs.append(f"{who} identifies {text}")
    against = [f"{who} identifies varied, context-specific contributions"] if p["individuality"] >= 0.75 else []
    likely = max(auto["automated"], 0.85 * max(p["aiGenerated"], p["engagementBait"], p["contentFarm"]))
    if p["tooLittleText"] >= 0.6:
        likely = 0.5 + (likely - 0.5) * (1 - p["tooLittleText"])
        confidence = min(confidence, 1 - p["tooLittleText"])
        against.append(_told(f"{who}: too little text to judge authorship", p["tooLittleText"]))
    likely = max(likely, min(1.0, sum(spam[k] * w for k, (w, _) in SPAM_TYPES.items())))
    likely = math.floor(likely * 1000 + 0.5) / 1000
    name = "human_like" if likely < t.human else "uncertain" if likely < t.automation else "automation_like"
    told = (
        f"{who} estimates {likely * 100:.0f}% automation likelihood and {p['coordination'] * 100:.0f}% coordination likelihood. "
        "This summary is assembled from typed decisions; these are experimental signals, not proof of identity."
    )
    return {
        "label": name, "automation": likely, "coordination": p["coordination"], "confidence": confidence, "signals_for": signs, "signals_against": against,
        "coordination_signals": [f"{who} identifies shared text and timing or graph patterns"] if p["sharedPattern"] >= 0.75 else [],
        "summary": told, "category": typed_category(named, p, name),
    }


def mapped_answers(rows: DataFrame, answer: str, t: Thresholds = Thresholds()) -> DataFrame:
    """rows without the column `answer`, with the label, automation, coordination, confidence and category of the typed answers
    in it: nulls where one breaks the contract."""
    names = ("label", "automation", "coordination", "confidence", "category")
    held = [f for f in rows.schema.fields if f.name != answer]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for a in frame[answer]:
                try:
                    out.append(map_typed_answers(a, t))
                except (BadAnswer, TypeError):
                    out.append({})
            yield frame.drop(columns=[answer]).assign(**{n: pd.Series([x.get(n) for x in out], index=frame.index, dtype=object) for n in names})

    new = [T.StructField(n, T.StringType() if n in ("label", "category") else T.DoubleType()) for n in names]
    return rows.mapInPandas(run, T.StructType([*held, *new]))


def scored(asked: DataFrame, config: Config, scorer: Callable[[str], str] | None = None, parse: Callable[[str], dict] = parse_answer, who: str = "Scorer", cache: AnswerCache | None = None) -> DataFrame:
    """The heuristic where no scorer is given; else its answers, each distinct request asked once, in
    config.scorer_partitions tasks at a time, and not at all where the cache has its answer. A failure or a bad answer
    falls back to the heuristic, held at uncertain."""
    local = heuristic(asked, config)
    if scorer is None:
        return local
    t = config.thresholds
    sent = F.to_json(F.struct("kind", "username", "account_age_days", "followers", "following", "total_posts", "reply_text", "neighbour_texts", "other_texts", "phrases", "signals", "max_sim", "within60", "coordinated", "max_score"))
    local = local.withColumn("payload", sent).withColumn("key", key_of("payload"))

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            names, out = [f.split()[0] for f in ANSWER.split(", ")], []
            for payload in rows["payload"]:
                try:
                    out.append({"payload": payload, "reason": None, **parse(scorer(payload))})
                except Exception as e:  # whatever an external scorer does wrong marks its row, it doesn't end the job
                    out.append({"payload": payload, "reason": str(e) or type(e).__name__})
            yield pd.DataFrame({n: pd.Series([x.get(n) for x in out], dtype=object) for n in ("payload", "reason", *names)})

    def asked_all(payloads: DataFrame) -> DataFrame:
        return payloads.repartition(config.scorer_partitions, "payload").mapInPandas(ask, f"payload string, reason string, {ANSWER}")

    if cache is None:
        got = asked_all(local.select("payload").distinct()).withColumn("key", key_of("payload"))
    else:
        got = cache.by_key(local, asked_all, ANSWER)
    names = [f.split()[0] for f in ANSWER.split(", ")]
    both = local.join(got.select("key", "reason", *[F.col(n).alias(f"got_{n}") for n in names]), "key")
    ok = F.col("reason").isNull()
    fallback = {
        "label": F.lit("uncertain"),
        "confidence": F.least(F.lit(0.3), "confidence"),
        "signals_for": F.concat(F.array(F.concat(F.lit(f"{who} unavailable ("), "reason", F.lit("); local heuristic shown for reference only"))), "signals_for"),
        "summary": F.lit(f"{who} did not return a valid classification, so this account is marked uncertain."),
        "category": F.lit(None).cast("string"),
    }
    cols = {n: F.when(ok, F.col(f"got_{n}")).otherwise(fallback.get(n, F.col(n))) for n in names}
    cols["label"] = F.when(ok, label(F.col("got_automation"), t.human, t.automation)).otherwise("uncertain")
    cols["source"] = F.when(ok, who.upper()).otherwise("HEURISTIC_FALLBACK")
    return both.withColumns(cols).drop("payload", "key", "reason", *[f"got_{n}" for n in names])


def relabelled(automation: Column, source: Column, sensitivity: float, t: Thresholds = Thresholds()) -> Column:
    """The label at another sensitivity (0 to 100, 50: as configured); fallbacks stay uncertain."""
    at = t.at(sensitivity)
    return F.when(source == "HEURISTIC_FALLBACK", "uncertain").otherwise(label(automation, at.human, at.automation))
