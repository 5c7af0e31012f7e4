"""Normalisation of model answers (G01-G06, S22, P15, N06, K23, K24, A15): JSON text to rows with known values and bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numbers import clamp_int, snap

#: What fields may hold.
LEVELS = ["Low", "Medium", "High"]
DEMAND = ["0–50", "50–100", "100–500", "500–1K", "1K–5K", "5K+"]
TRAFFIC = ["Unknown", "0–100", "100–500", "500–1K", "1K–5K", "5K+"]
SIGNAL_STATES, SUMMARY_STATES = ["pass", "warn", "info"], ["fail", "warn", "pass", "info"]
#: Weights of priorities.
WEIGHTS = {"High": 3, "Medium": 2}
#: Scores of signals that an answer leaves out.
SIGNAL_SCORES = {"indexability": 50, "contentCoverage": 50, "authority": 35, "localRelevance": 40, "aiAnswerReadiness": 35}
PROFILE = {"searchPresence": 35, "contentReach": 35, "brandDiscoverability": 30, "aiAnswerReadiness": 25}
#: Phases of a roadmap, and the lists whose first actions fill one that is empty.
PHASES = [
    ("First 30 days", "Fix the highest-risk foundations", "A stable technical and conversion foundation.", "technicalPriorities", "conversionPriorities"),
    ("Days 31–60", "Expand qualified visibility and content coverage", "Broader discovery for valuable commercial topics.", "contentPriorities", "conversionPriorities"),
    ("Days 61–90", "Build authority, conversion and repeatable measurement", "Stronger trust, authority and measurable lead growth.", "authorityPriorities", "contentPriorities"),
]
ROADMAP_LISTS = ["observations", "competitorPatterns", "technicalPriorities", "contentPriorities", "authorityPriorities", "conversionPriorities", "measurementPlan", "risks"]

_ITEM = "struct<title:string,detail:string,priority:string,evidence:string,action:string>"
_STATED = "struct<status:string,title:string,detail:string,action:string>"
_KEYWORD = "struct<keyword:string,intent:string,demandRange:string,competition:string,opportunity:string>"
_PAGE, _CHANNEL, _TYPE = "struct<title:string,path:string>", "struct<channel:string,range:string>", "struct<type:string,reason:string>"
_PHASE = "struct<period:string,objective:string,tasks:array<string>,kpis:array<string>,outcome:string>"
_PLAN = "struct<phase:string,focus:string,tasks:array<string>,outcome:string>"
SCHEMAS = {
    "keywords": f"struct<primaryIntent:string,opportunityScore:string,demandSignal:string,confidence:string,keywords:array<{_KEYWORD}>,entities:array<string>,recommendedPages:array<{_PAGE}>,contentOutline:array<string>>",
    "visibility": f"struct<searchReadinessScore:string,visibilityLevel:string,confidence:string,indexabilitySignal:string,contentCoverage:string,authoritySignal:string,localSignal:string,strengths:array<{_STATED}>,gaps:array<{_STATED}>,opportunities:array<{_STATED}>,signalScores:map<string,string>>",
    "traffic": f"struct<monthlyRange:string,confidence:string,trafficMaturity:string,channelMix:array<{_CHANNEL}>,engagementBands:map<string,string>,signals:array<{_STATED}>,recommendations:array<{_STATED}>,visibilityProfile:map<string,string>,aiVisibility:struct<level:string,evidence:string,nextAction:string>>",
    "roadmap": "struct<confidence:string,businessSummary:string,marketContext:string," + "".join(f"{k}:array<{_ITEM}>," for k in ROADMAP_LISTS) + f"roadmap:array<{_PHASE}>>",
    "summary": f"struct<confidence:string,critical:array<{_STATED}>,quickWins:array<{_STATED}>,content:array<{_STATED}>,plan:array<{_PLAN}>>",
    "schema": f"struct<siteIntent:string,priorityRecommendations:array<{_TYPE}>,recommendations:array<{_TYPE}>,preferredType:string>",
}


def salvage(text: Column) -> Column:
    """What stands between the outermost braces."""
    return F.regexp_extract(F.coalesce(text, F.lit("")), r"(\{[\s\S]*\})", 1)


def parse(answers: DataFrame, report: str, text: str = "text") -> DataFrame:
    """answers with `answer`; one that does not parse is null."""
    return answers.withColumn("answer", F.from_json(salvage(F.col(text)), SCHEMAS[report]))


def said(c: Column, fallback: str = "") -> Column:
    """A trimmed text; the fallback stands for one that is missing, not for an empty one."""
    return F.coalesce(F.regexp_replace(c, r"^\s+|\s+$", ""), F.lit(fallback))


def _list(c: Column, kind: str) -> Column:
    return F.coalesce(c, F.array().cast(f"array<{kind}>"))


def texts(c: Column, n: int) -> Column:
    return F.slice(F.filter(F.transform(_list(c, "string"), lambda x: said(x)), lambda x: x != ""), 1, n)


def items(c: Column, n: int = 12) -> Column:
    """Entries with a title or a detail, at most n."""
    made = F.transform(_list(c, _ITEM), lambda x: F.struct(said(x["title"]).alias("title"), said(x["detail"]).alias("detail"), said(x["priority"], "Medium").alias("priority"), said(x["evidence"]).alias("evidence"), said(x["action"]).alias("action")))
    return F.slice(F.filter(made, lambda x: (x["title"] != "") | (x["detail"] != "")), 1, n)


def stated(c: Column, states: list[str], n: int) -> Column:
    """Entries with a title or a detail, at most n; a status that is not among the states is info."""
    made = F.transform(_list(c, _STATED), lambda x: F.struct(F.when(x["status"].isin(states), x["status"]).otherwise("info").alias("status"), said(x["title"]).alias("title"), said(x["detail"]).alias("detail"), said(x["action"]).alias("action")))
    return F.slice(F.filter(made, lambda x: (x["title"] != "") | (x["detail"] != "")), 1, n)


def confidence(c: Column) -> Column:
    return F.when(F.lower(c) == "medium", "Medium").otherwise("Low")


def demand_range(c: Column) -> Column:
    plain = F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit("-"), F.lit("–")), r"\s+", "")
    return F.when(plain.isin(DEMAND), plain).otherwise("Unknown")


def _scores(c: Column, defaults: dict[str, int]) -> Column:
    return F.struct(*[clamp_int(F.try_element_at(c, F.lit(k)), v).alias(k) for k, v in defaults.items()])


def _others(answers: DataFrame, made: list[Column], names: list[str]) -> DataFrame:
    """answers without `answer`, with what was made of it; a column of the same name gives way."""
    return answers.select(*[F.col(f"`{c}`") for c in answers.columns if c not in ("answer", *names)], *[c.alias(n) for c, n in zip(made, names, strict=True)])


def keywords(answers: DataFrame, seed: str = "seed", n: int = 40) -> DataFrame:
    """Rows with a keyword, at most n; an answer without any gives one row for its seed."""
    made = F.transform(
        F.slice(F.filter(_list(F.col("answer.keywords"), _KEYWORD), lambda x: said(x["keyword"]) != ""), 1, n),
        lambda x: F.struct(said(x["keyword"]).alias("keyword"), said(x["intent"], "Mixed").alias("intent"), demand_range(x["demandRange"]).alias("demand_range"), snap(x["competition"], LEVELS, "Medium").alias("competition"), clamp_int(x["opportunity"], 50).alias("opportunity")),
    )
    one = F.array(F.struct(F.col(seed).alias("keyword"), said(F.col("answer.primaryIntent"), "Mixed").alias("intent"), F.lit("Unknown").alias("demand_range"), F.lit("Medium").alias("competition"), clamp_int(F.col("answer.opportunityScore"), 50).alias("opportunity")))
    return answers.select(seed, F.inline(F.when(F.size(made) > 0, made).otherwise(one)))


def keyword_report(answers: DataFrame) -> DataFrame:
    """What is said of the whole report."""
    a = F.col("answer")
    pages = F.transform(_list(a["recommendedPages"], _PAGE), lambda x: F.struct(said(x["title"]).alias("title"), said(x["path"]).alias("path")))
    made = [said(a["primaryIntent"], "Mixed"), clamp_int(a["opportunityScore"], 50), snap(a["demandSignal"], LEVELS, "Medium"), snap(a["confidence"], ["Low", "Medium"], "Low"), texts(a["entities"], 30), F.slice(F.filter(pages, lambda x: (x["title"] != "") | (x["path"] != "")), 1, 15), texts(a["contentOutline"], 30)]
    return _others(answers, made, ["primary_intent", "opportunity_score", "demand_signal", "confidence", "entities", "recommended_pages", "content_outline"])


def visibility(answers: DataFrame, page_rank: Column | None = None) -> DataFrame:
    """G02, K20, K24; page_rank, where it is known, gives the default of the authority score."""
    a = F.col("answer")
    scores = _scores(a["signalScores"], SIGNAL_SCORES)
    if page_rank is not None:
        own = F.least(F.lit(100), F.floor(page_rank * 20 + 0.5)).cast("int")
        authority = F.when(F.try_element_at(a["signalScores"], F.lit("authority")).try_cast("double").isNull(), own)
        scores = scores.withField("authority", F.coalesce(authority, scores["authority"]))
    fields = {"indexabilitySignal": "Not enough evidence", "contentCoverage": "Not enough evidence", "authoritySignal": "Unverified", "localSignal": "Not assessed"}
    made = [clamp_int(a["searchReadinessScore"], 50), said(a["visibilityLevel"], "Developing"), confidence(a["confidence"]), *[said(a[k], v) for k, v in fields.items()], *[stated(a[k], SIGNAL_STATES, 15) for k in ("strengths", "gaps", "opportunities")], scores]
    return _others(answers, made, ["search_readiness_score", "visibility_level", "confidence", "indexability_signal", "content_coverage", "authority_signal", "local_signal", "strengths", "gaps", "opportunities", "signal_scores"])


def traffic(answers: DataFrame) -> DataFrame:
    """G03."""
    a = F.col("answer")
    channels = F.transform(_list(a["channelMix"], _CHANNEL), lambda x: F.struct(said(x["channel"]).alias("channel"), said(x["range"]).alias("range")))
    ai = a["aiVisibility"]
    seen = F.struct(said(ai["level"], "Limited").alias("level"), said(ai["evidence"], "Public evidence is limited.").alias("evidence"), said(ai["nextAction"], "Connect verified analytics and improve useful, attributable content evidence.").alias("next_action"))
    month = said(a["monthlyRange"])
    made = [F.when(month.isin(TRAFFIC), month).otherwise("Unknown"), confidence(a["confidence"]), said(a["trafficMaturity"], "Not enough evidence"), F.slice(F.filter(channels, lambda x: x["channel"] != ""), 1, 10), F.coalesce(a["engagementBands"], F.create_map().cast("map<string,string>")), stated(a["signals"], SIGNAL_STATES, 12), stated(a["recommendations"], SIGNAL_STATES, 12), _scores(a["visibilityProfile"], PROFILE), seen]
    return _others(answers, made, ["monthly_range", "confidence", "traffic_maturity", "channel_mix", "engagement_bands", "signals", "recommendations", "visibility_profile", "ai_visibility"])


def phases(c: Column) -> Column:
    """Phases with a period, an objective or tasks, at most 6."""
    made = F.transform(_list(c, _PHASE), lambda p: F.struct(said(p["period"]).alias("period"), said(p["objective"]).alias("objective"), texts(p["tasks"], 12).alias("tasks"), texts(p["kpis"], 8).alias("kpis"), said(p["outcome"]).alias("outcome")))
    return F.slice(F.filter(made, lambda p: (p["period"] != "") | (p["objective"] != "") | (F.size(p["tasks"]) > 0)), 1, 6)


def roadmap(answers: DataFrame) -> DataFrame:
    """G04."""
    a = F.col("answer")
    return _others(answers, [confidence(a["confidence"]), said(a["businessSummary"]), said(a["marketContext"]), *[items(a[k]) for k in ROADMAP_LISTS], phases(a["roadmap"])], ["confidence", "businessSummary", "marketContext", *ROADMAP_LISTS, "roadmap"])


def three_phases(roadmaps: DataFrame) -> DataFrame:
    """Three phases of a normalised roadmap; one without tasks and objective is made of the first five entries of two lists."""
    made = []
    for k, (period, objective, outcome, one, two) in enumerate(PHASES):
        given = F.get("roadmap", F.lit(k))
        actions = F.filter(F.transform(F.slice(F.concat(one, two), 1, 5), lambda x: F.when(x["action"] != "", x["action"]).otherwise(x["title"])), lambda x: x != "")
        filled = F.struct(F.lit(period).alias("period"), F.lit(objective).alias("objective"), actions.alias("tasks"), F.array().cast("array<string>").alias("kpis"), F.lit(outcome).alias("outcome"))
        made.append(F.when((F.size(given["tasks"]) > 0) | (given["objective"] != ""), given).otherwise(filled))
    return roadmaps.withColumn("phases", F.array(*made))


def summary(answers: DataFrame) -> DataFrame:
    """G05."""
    a = F.col("answer")
    plan = F.transform(_list(a["plan"], _PLAN), lambda p: F.struct(said(p["phase"]).alias("phase"), said(p["focus"]).alias("focus"), texts(p["tasks"], 12).alias("tasks"), said(p["outcome"]).alias("outcome")))
    kept = F.slice(F.filter(plan, lambda p: (p["phase"] != "") | (p["focus"] != "") | (F.size(p["tasks"]) > 0)), 1, 8)
    return _others(answers, [confidence(a["confidence"]), *[stated(a[k], SUMMARY_STATES, 12) for k in ("critical", "quickWins", "content")], kept], ["confidence", "critical", "quick_wins", "content", "plan"])


def schema_recommendations(answers: DataFrame, n: int = 20) -> DataFrame:
    """Type and reason are required; an answer without any gives WebPage."""
    rows = F.transform(_list(F.coalesce("answer.priorityRecommendations", "answer.recommendations"), _TYPE), lambda x: F.struct(said(x["type"]).alias("type"), said(x["reason"]).alias("reason")))
    rows = F.slice(F.filter(rows, lambda x: (x["type"] != "") & (x["reason"] != "")), 1, n)
    one = F.array(F.struct(F.lit("WebPage").alias("type"), F.lit("WebPage is a safe general type for a standard page.").alias("reason")))
    return answers.select(*[F.col(f"`{c}`") for c in answers.columns if c not in ("answer", "type", "reason")], F.inline(F.when(F.size(rows) > 0, rows).otherwise(one)))


def workload(rows: DataFrame, by: str = "workstream") -> DataFrame:
    """Weights of priorities by workstream."""
    weight = F.lit(1)
    for p, w in WEIGHTS.items():
        weight = F.when(F.col("priority") == p, w).otherwise(weight)
    return rows.groupBy(by).agg(F.sum(weight).alias("load"), F.count("*").alias("items"))


def status_histogram(rows: DataFrame) -> DataFrame:
    """A19."""
    return rows.agg(*[F.count_if(F.col("status") == s).alias(s) for s in SUMMARY_STATES])
