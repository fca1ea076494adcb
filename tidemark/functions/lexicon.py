"""Lexicon scan and measurement rules for toxicity: domain, false-positive risk, coded suspicion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as T

#: Category -> term -> (case-insensitive pattern, risk of an innocent sense).
LEXICON = {
    "dehumanisation": {
        "madoadoa": (r"madoa\s?doa", "low"),
        "kwekwe": (r"\bkwekwe\b", "medium"),
        "sangari": (r"\bsangari\b", "low"),
        "madimoni": (r"\bmadimoni\b", "medium"),
        "mende": (r"\bmende\b", "high"),
        "nyoka": (r"\bnyoka\b", "high"),
        "fumigate": (r"\bfumigat\w+|\bfukiza", "medium"),
    },
    "expulsion": {
        "rudi_kwao": (r"\b(wa)?rudi\w*\s+kwao\b", "medium"),
        "fukuza": (r"\b(tu|wa)?fukuz\w+", "high"),
        "waondoke": (r"\bwaondoke\b", "medium"),
    },
    "veiled_threat": {
        "watajua_hawajui": (r"watajua\s+hawajui", "low"),
        "kimeumana": (r"\bkimeumana\b", "medium"),
    },
    "othering": {
        "watu_wa_kule": (r"watu\s+wa\s+kule", "medium"),
        "wabara": (r"\bwabara\b|watu\s+wa\s+bara", "medium"),
        "41_vs_1": (r"\b41\s*(vs\.?|versus|against)\s*1\b", "low"),
        "uthamaki": (r"\buthamaki\b", "medium"),
    },
}
#: Words that place a text at home or elsewhere. A deployment passes its own, with its country's names, to domain().
HOME_WORDS = (
    r"\b(ruto|raila|gachagua|kasongo|kindiki|murkomen|matiangi|sifuna|wantam|tutam|iebc|ncic|"
    r"nairobi|kisumu|mombasa|nakuru|eldoret|kakamega|bungoma|luo|luos|kikuyu|kikuyus|kalenjin|kalenjins|luhya|luhyas|"
    r"kamba|kisii|meru|somali|gusii|abagusii|murima|wamunyoro|odm|uda|dcp|githeri|mbogi)\b"
)
OTHER_WORDS = (
    r"\b(america|american|americans|trump|biden|congress|whitehouse|white\s+house|mamdani|zohran|remigrat\w*|"
    r"sweden|swedish|belgium|belgian|colorado|canada|canadian|ndaa|zionican|france|french|germany|german)\b"
)
#: Least menace, and least excess over ordinary criticism, by risk.
MENACE = {"low": 0.45, "medium": 0.55, "high": 0.65}
MARGIN = {"low": -0.05, "medium": 0.0, "high": 0.10}
FLAG_AT = 0.28

TERMS = [(term, pattern) for terms in LEXICON.values() for term, (pattern, _) in terms.items()]
#: A literal that every match of a term's pattern holds.
PART_OF = {
    "madoadoa": "madoa",
    "kwekwe": "kwekwe",
    "sangari": "sangari",
    "madimoni": "madimoni",
    "mende": "mende",
    "nyoka": "nyoka",
    "fumigate": "fu",
    "rudi_kwao": "kwao",
    "fukuza": "fukuz",
    "waondoke": "waondoke",
    "watajua_hawajui": "hawajui",
    "kimeumana": "kimeumana",
    "watu_wa_kule": "kule",
    "wabara": "bara",
    "41_vs_1": "41",
    "uthamaki": "uthamaki",
}
CATEGORY_OF = {term: category for category, terms in LEXICON.items() for term in terms}
RISK_OF = {term: risk for terms in LEXICON.values() for term, (_, risk) in terms.items()}


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def hits(text: Column) -> Column:
    """Lexicon terms that the text has, in the lexicon's order."""
    return T.scan(text, [(t, p, PART_OF[t]) for t, p in TERMS])


def categories(terms: Column) -> Column:
    return F.array_distinct(F.transform(terms, lambda t: _lookup(CATEGORY_OF, t)))


def domain(text: Column, home: str = HOME_WORDS, elsewhere: str = OTHER_WORDS) -> Column:
    """home if any of its words is there, else offdomain if one of the others' is, else ambiguous."""
    own, other = (F.coalesce(text.rlike(f"(?iU){p}"), F.lit(False)) for p in (home, elsewhere))
    return F.when(own, "home").when(other, "offdomain").otherwise("ambiguous")


def least_risk(terms: Column) -> Column:
    """The lowest risk among known terms; null without any."""
    rank = {t: {"low": "0", "medium": "1", "high": "2"}[r] for t, r in RISK_OF.items()}
    lowest = F.array_min(F.transform(terms, lambda t: _lookup(rank, t)))
    return F.when(lowest == "0", "low").when(lowest == "1", "medium").when(lowest == "2", "high")


def coded_suspect(terms: Column, menace: list[Column], criticism: Column) -> Column:
    """Whether a lexicon hit comes with enough menace for its risk. Without any menace score: no."""
    risk, top = least_risk(terms), F.greatest(*menace)
    bar, margin = (F.element_at(F.create_map(*[F.lit(x) for kv in t.items() for x in kv]), risk) for t in (MENACE, MARGIN))
    return F.coalesce((top >= bar) & (top >= F.coalesce(criticism, F.lit(0.0)) + margin), F.lit(False))


def with_measures(scored: DataFrame, home: str = HOME_WORDS, elsewhere: str = OTHER_WORDS) -> DataFrame:
    """scored posts with domain, in_scope, lexicon terms and categories, coded_suspect, explicit_toxic."""
    menace = [F.col(c) for c in ("dehumanisation_score", "violence_call_score", "othering_score")]
    out = scored.withColumn("domain", domain(F.col("text"), home, elsewhere)).withColumn("in_scope", F.col("domain") != "offdomain")
    out = out.withColumn("lexicon_hits", hits(F.col("text"))).withColumn("lexicon_categories", categories(F.col("lexicon_hits")))
    out = out.withColumn("coded_suspect", coded_suspect(F.col("lexicon_hits"), menace, F.col("political_criticism_score")))
    toxic = (F.coalesce(F.col("label"), F.lit("neither")) != "neither") | F.coalesce(F.col("hate_flag"), F.lit(False))
    out = out.withColumn("explicit_toxic", toxic & F.col("in_scope")).withColumn("coded_suspect_in_scope", F.col("coded_suspect") & F.col("in_scope"))
    return out.withColumn("flagged", F.coalesce(F.col("hate_flag"), F.lit(False)) | F.col("coded_suspect"))


def label_of(scores: list[tuple[str, Column]]) -> Column:
    """The name with the largest score (the first of equals)."""
    values = F.array(*[c for _, c in scores])
    return F.element_at(F.array(*[F.lit(n) for n, _ in scores]), F.array_position(values, F.array_max(values)).cast("int"))


def stale(measured: DataFrame, columns: tuple[str, ...] = ("domain", "coded_suspect", "explicit_toxic")) -> DataFrame:
    """Rows in which some measure column is missing or null: those to measure again."""
    there = [c for c in columns if c in measured.columns]
    if len(there) < len(columns):
        return measured
    missing = F.lit(False)
    for c in there:
        missing = missing | F.col(c).isNull()
    return measured.where(missing)
