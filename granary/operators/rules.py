"""Keyword and pattern rules over texts, facility search and verification."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Keywords of each category, in their order.
KEYWORDS = {
    "HOUSING": [
        "housing", "shelter", "rent", "eviction", "transitional housing", "rental assistance", "emergency housing", "motel voucher",
        "affordable housing"
    ],
    "FOOD": ["food", "hungry", "groceries", "food bank", "food pantry", "meals", "snap", "wic", "nutrition", "hot meals"],
    "DOMESTIC_VIOLENCE": ["domestic violence", "dv", "abuse", "safe house", "safety plan", "restraining order", "intimate partner"],
    "HOMELESSNESS": ["homeless", "unhoused", "sleeping outside", "day shelter", "drop in", "outreach", "encampment"],
    "MENTAL_HEALTH": [
        "mental health", "counseling", "therapy", "psychiatry", "crisis", "depression", "anxiety", "suicide", "behavioral health"
    ],
    "SUBSTANCE_USE": ["substance", "addiction", "detox", "rehab", "treatment", "recovery", "alcohol", "drugs", "sober"],
    "LEGAL": ["legal", "lawyer", "attorney", "court", "immigration", "tenant rights", "legal aid", "custody"],
    "EMPLOYMENT": ["job", "employment", "work", "resume", "job training", "unemployment", "career", "hire"],
    "TRANSPORTATION": ["transportation", "bus", "ride", "gas", "medical transport", "bus pass"],
    "CHILDCARE": ["childcare", "daycare", "child care", "head start", "after school", "babysitting"],
    "HEALTHCARE": ["healthcare", "medical", "doctor", "clinic", "dental", "vision", "prescription", "medicaid", "fqhc"],
    "FINANCIAL": ["financial", "money", "utility", "electric", "gas bill", "emergency funds", "benefits", "assistance"],
    "EDUCATION": ["education", "ged", "esl", "english", "vocational", "school", "literacy"],
    "LGBTQ": ["lgbtq", "gay", "lesbian", "transgender", "queer", "pride", "gender affirming"],
}
# Tag patterns in their order.
TAGS = {
    "walk.?in|walk in": "Walk-In", "no appointment": "Walk-In", "24.?hour|24 hour|overnight": "24-Hour", "emergency": "Emergency",
    "children|kids|family": "Children", "spanish|español|bilingual": "Bilingual-Spanish", "veteran|military": "Veterans",
    "disab": "Disability", "senior|elderly|older": "Seniors", "no id|without id": "No-ID-Required",
    "lgbtq|transgender|queer": "LGBTQ-Affirming", "rental": "Rental-Assistance", "utility": "Utility-Assistance",
    "eviction": "Eviction-Prevention", "food bank|pantry": "Food-Bank", "hot meal|meal program": "Hot-Meals", "snap|ebt": "SNAP-Enrollment",
    "crisis line|hotline": "Crisis-Line", "detox|withdrawal": "Detox", "sober living|recovery": "Recovery",
    "free|no cost|no charge": "Free-Service", "sliding scale|income": "Sliding-Scale", "referral only": "Referral-Required",
    "women only|women.s": "Women-Only", "men only|men.s": "Men-Only", "single": "Single-Adults", "couple": "Couples",
}
# Which category wins of a pair.
CONFLICTS = {
    ("HOUSING", "DOMESTIC_VIOLENCE"): "DOMESTIC_VIOLENCE", ("HOUSING", "HOMELESSNESS"): "HOMELESSNESS",
    ("MENTAL_HEALTH", "SUBSTANCE_USE"): "MENTAL_HEALTH", ("HEALTHCARE", "MENTAL_HEALTH"): "MENTAL_HEALTH",
    ("FINANCIAL", "HOUSING"): "HOUSING"
}


def lowered(df: DataFrame, text: str) -> DataFrame:
    """Adds __low. It is a column of its own below its many uses, so each text is lower-cased once."""
    return df.withColumn("__low", F.lower(F.coalesce(F.col(text), F.lit(""))))


def _trie(words: Iterable[str]) -> str:
    """A regular expression of these words that takes the longest one, with common beginnings told apart once."""
    tree: dict = {}
    for word in words:
        at = tree
        for c in word:
            at = at.setdefault(c, {})
        at[""] = {}

    def text(node: dict) -> str:
        parts = [re.escape(c) + text(child) for c, child in sorted(node.items()) if c]
        if not parts:
            return ""
        one = parts[0] if len(parts) == 1 and "" not in node else f"(?:{'|'.join(parts)})"
        return one + "?" if "" in node else one

    return text(tree)


def terms(text: Column, words: list[str], word_boundary: bool = False) -> Column:
    """The longest of the words that starts at each place of a text, as a distinct array: one pass over the text, however many words there are."""
    edge = r"\b" if word_boundary else ""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"{edge}(?=({_trie(words)}){edge})"), F.lit(1)))


def has_word(found: Column, word: str, words: list[str], word_boundary: bool = False) -> Column:
    """Whether a word occurs, of the terms found among the words: itself or as the beginning of a longer one."""
    longer = [w for w in words if w.startswith(word) and w != word and not (word_boundary and w[len(word)].isalnum())]
    return F.arrays_overlap(found, F.array(*(F.lit(w) for w in (word, *longer)))) if longer else F.array_contains(found, word)


#: All plain words of keywords and tags, and the alternatives of tags that are patterns.
_TAG_PARTS = [part for pattern in TAGS for part in pattern.split("|")]
_PLAIN = [part for part in _TAG_PARTS if part.replace(" ", "").isalnum()]
WORDS = list(dict.fromkeys([w for words in KEYWORDS.values() for w in words] + _PLAIN))


def with_terms(df: DataFrame, text: str, word_boundary: bool = False) -> DataFrame:
    """Adds __low and __terms, from which keyword_hits and modifier_tags both read; a text is searched once for all of their words."""
    return lowered(df, text).withColumn("__terms", terms(F.col("__low"), WORDS, word_boundary))


def classify(df: DataFrame, text: str) -> DataFrame:
    """hits, primary_category, confidence, matched_keywords and sub_tags of each text in one pass over it."""
    return modifier_tags(categorize(keyword_hits(with_terms(df, text), text)), text).drop("__low", "__terms")


def keyword_hits(df: DataFrame, text: str, word_boundary: bool = False) -> DataFrame:
    """Adds hits: array of (category, n, ordinal, keywords) of the categories that occur; one pass over the text, no join."""
    rows = df if "__terms" in df.columns else with_terms(df, text, word_boundary)

    def found(word: str) -> Column:
        return has_word(F.col("__terms"), word, WORDS, word_boundary)

    cats = []
    for i, (cat, words) in enumerate(KEYWORDS.items()):
        have = F.array_compact(F.array(*(F.when(found(w), F.lit(w)) for w in words)))
        cats.append(F.struct(F.lit(cat).alias("category"), F.lit(i).alias("ordinal"), have.alias("keywords")))
    hits = F.filter(F.array(*cats), lambda x: F.size(x["keywords"]) > 0)
    one = lambda x: F.struct(
        (-F.size(x["keywords"])).alias("minus_n"), x["ordinal"].alias("ordinal"), x["category"].alias("category"),
        x["keywords"].alias("keywords")
    )
    some = F.size("__terms") > 0  # most texts end here
    none = F.array().cast("array<struct<minus_n:int,ordinal:int,category:string,keywords:array<string>>>")
    out = rows.withColumn("hits", F.when(some, F.transform(hits, one)).otherwise(none))
    return out if "__terms" in df.columns else out.drop("__low", "__terms")


def hit_rows(hit: DataFrame) -> DataFrame:
    """One row a category that occurs: df's columns, category, n. An inner explode would have its emptiness test pushed below the search, and that
    searched each text once a word."""
    rows = hit.withColumn("__hit", F.explode_outer("hits")).where("__hit IS NOT NULL")
    return rows.withColumns({"category": F.col("__hit.category"), "n": -F.col("__hit.minus_n")}).drop("__hit", "hits")


def categorize(hit: DataFrame) -> DataFrame:
    """primary_category and confidence of rows with hits: most hits first, then the order of categories."""
    one, two = F.get("__best", F.lit(0))["category"], F.get("__best", F.lit(1))["category"]
    winner = F.create_map(*(F.lit(x) for pair, w in CONFLICTS.items() for x in ("|".join(sorted(pair)), w)))
    n = F.size("hits")
    known = F.coalesce(winner[F.concat_ws("|", F.least(one, two), F.greatest(one, two))], one)
    out = hit.withColumn("__best", F.array_sort("hits")).withColumns({
        "primary_category": F.when(n == 0, "GENERAL").when(n == 1, one).otherwise(known),
        "confidence": F.when(n == 0, "LOW").when(n == 1, "HIGH").otherwise("MEDIUM"),
        "matched_keywords": F.array_sort(F.flatten(F.transform("hits", lambda x: x["keywords"]))),
    })
    return out.drop("__best")


def _tagged(pattern: str) -> Column:
    """Whether one of a pattern's alternatives occurs: plain ones are among the terms, the others are searched for."""
    parts = pattern.split("|")
    other = [p for p in parts if p not in _PLAIN]
    tests = [has_word(F.col("__terms"), p, WORDS) for p in parts if p in _PLAIN] + ([F.col("__low").rlike("|".join(other))] if other else [])
    return functools.reduce(Column.__or__, tests)


def modifier_tags(df: DataFrame, text: str) -> DataFrame:
    """Sorted distinct tags; rows that hit LGBTQ keywords without it as primary category get its tag as well."""
    tags = F.array_compact(F.array(*(F.when(_tagged(p), F.lit(t)) for p, t in TAGS.items())))
    rows = df if "__terms" in df.columns else with_terms(df, text)
    out = rows.withColumn("sub_tags", tags)
    out = out if "__terms" in df.columns else out.drop("__low", "__terms")
    tags = F.col("sub_tags")
    if "hits" in df.columns and "primary_category" in df.columns:
        also = F.exists("hits", lambda x: x["category"] == "LGBTQ") & (F.col("primary_category") != "LGBTQ")
        tags = F.when(also, F.array_union(tags, F.array(F.lit("LGBTQ-Affirming")))).otherwise(tags)
    return out.withColumn("sub_tags", F.array_sort(F.array_distinct(tags)))


def search(facilities: DataFrame, requests: DataFrame, n: int = 3) -> DataFrame:
    """The first n facilities of each request's category and place that meet all needs: walk-in first, then by name.

    Facilities of one category, place and set of tags meet the same needs, so the first n of each such group are enough. They meet each distinct
    set of needs once, and the first n of these go to the requests: the pairs grow with the distinct sets, not with requests times facilities."""
    order = [F.desc("WalkInAvailable"), "FacilityName", "FacilityID"]

    def first(rows: DataFrame, *keys: str) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)

    place = ["category", "zip"]
    f = facilities.select(
        F.col("PrimaryCategory").alias("category"), F.col("ZipCode").alias("zip"), "FacilityID", "FacilityName", "WalkInAvailable",
        F.array_sort(F.array_distinct(F.split("SubCategories", r"\|"))).alias("tags")
    )
    wanted = F.array_sort(F.array_distinct(F.filter(F.split("needs", r"\|"), lambda x: x != "")))
    r = requests.select("request_id", *place, wanted.alias("wanted"))
    met = first(f, *place, "tags").drop("rank").join(r.select(*place, "wanted").distinct(), place)
    best = first(met.where(F.size(F.array_except("wanted", "tags")) == 0), *place, "wanted").drop("rank", "tags")
    return first(r.join(best, [*place, "wanted"]), "request_id").select("request_id", "rank", "FacilityID", "FacilityName", "WalkInAvailable")


def stale(facilities: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    return facilities.withColumn("is_stale", F.datediff(F.lit(as_of).cast("date"), F.col("LastVerifiedDate")) > days)


def contact_lookup(facilities: DataFrame, name: str) -> DataFrame:
    return facilities.where(F.lower("FacilityName").contains(name.lower())).select("FacilityID", "FacilityName", "Phone", "Hours", "ZipCode")


def eligibility(facilities: DataFrame, name: str) -> DataFrame:
    return facilities.where(F.lower("FacilityName").contains(name.lower())).select(
        "FacilityID", "FacilityName", "EligibilityCriteria", "WalkInAvailable"
    )


#: Sources from the most to the least trusted (fixed values).
SOURCE_RANK = ("official", "directory", "social")


def discrepancies(facilities: DataFrame, observations: DataFrame, fields: tuple[str, ...] = ("Phone", "Hours")) -> DataFrame:
    """Each facility's fields against what sources report; the best source speaks."""
    known = facilities.select("FacilityID", *fields).unpivot(["FacilityID"], list(fields), "field", "known_value")
    rank = F.when(F.col("source_kind") == SOURCE_RANK[0], 1).when(F.col("source_kind") == SOURCE_RANK[1], 2).otherwise(3)
    w = Window.partitionBy("FacilityID", "field").orderBy("rank", F.desc("retrieved"), "source_url")
    best = observations.withColumn("rank", rank).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    closed = observations.where("reports_closed").groupBy("FacilityID").agg(F.count_distinct("source_url").alias("closed_sources"))
    j = known.join(
        best.select("FacilityID", "field", "found_value", "source_url", "rank"), ["FacilityID", "field"], "left"
    ).join(closed, "FacilityID", "left")
    status = F.when(F.coalesce("closed_sources", F.lit(0)) >= 2, "CLOSED").when(F.col("found_value").isNull(), "UNVERIFIABLE").when(
        F.trim("found_value") == F.trim("known_value"), "VERIFIED"
    ).otherwise("NEEDS UPDATE")
    confidence = F.when(F.col("rank") == 1, "HIGH").when(F.col("rank") == 2, "MEDIUM").otherwise("LOW")
    return j.select("FacilityID", "field", "known_value", "found_value", "source_url", status.alias("status"), confidence.alias("confidence"))


def report_order(df: DataFrame) -> DataFrame:
    s = F.col("status")
    return df.orderBy(F.when(s == "VERIFIED", 1).when(s == "NEEDS UPDATE", 2).when(s == "CLOSED", 3).otherwise(4), "FacilityID", "field")


def verification_summary(found: DataFrame) -> DataFrame:
    total = found.agg(F.count("*").alias("total"))
    return found.groupBy("status").agg(F.count("*").alias("fields")).join(F.broadcast(total)).select(
        "status", "fields", F.round(100.0 * F.col("fields") / F.col("total"), 1).alias("pct")
    )
