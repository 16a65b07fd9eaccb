"""Question and answer text as column expressions: tokens, ids, numbers, directions, verdicts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop words of keyword seeding, schema nouns included.
STOPWORDS = """
a an the this that these those it its their they them his her he she we our
all any each every some other another
am are be been being can could did do does had has have is may might must shall should was were will would
what which who whom whose when where why how howmany howmuch
about above across after against along among around at before behind below beneath beside between beyond by
down during except for from in into near of off on onto out over past since through to toward under until up
upon with within without
not no yes please tell give list show find get me like want need related relating
claim claims policy policies coverage coverages endorsement endorsements fraud flag flags insurance
investigator investigators policyholder holder status type premium deductible amount annual risk score
number numbers id ids
""".split()
# Id pattern, threshold words, verdict phrases, answer-type hints.
ID_PATTERN = r"\b((?:POL|CLM|PH|END|FRD|INV)-\d{3,})\b"
CLAIM_PATTERN = r"CLM-\d{3,}"
ABOVE = ["over", "above", "more", "exceeds", "exceeding", "greater", "higher"]
BELOW = ["under", "below", "less", "lower"]
UNKNOWN_PHRASES = ["not determinable", "cannot determine", "unable to determine", "no information", "does not contain", "does not provide", "does not mention", "would indicate whether", "cannot confirm", "no evidence", "no indication", "not mentioned"]
NO_PHRASES = ["not flagged", "not fraudulent", "is not fraud", "isn't fraud", "no fraud", "not considered fraud", "not marked as fraud", "no fraud flag", "not fraud", "not related to fraud", "unrelated to fraud", "no relation to fraud"]
LABEL_HINTS = {
    "Coverage": ["coverage", "coverages", "covers"],
    "FraudFlag": ["fraud", "flag", "flagged"],
    "Investigator": ["investigat", "handled by", "assigned"],
    "Endorsement": ["endorsement", "endorsements"],
    "Policy": ["policy", "policies"],
    "Claim": ["claim", "claims"],
    "Policyholder": ["policyholder", "holder", "held by"],
}
# The numeric property that a question word focuses on, in order of precedence.
FOCUS = [
    ("premium", [("premium", "Policy")]),
    ("deductible", [("deductible", "Policy"), ("deductible", "Coverage")]),
    ("amount", [("amount", "Claim")]),
    ("limit", [("limit", "Coverage")]),
    ("risk", [("risk_score", "Policyholder")]),
    ("confidence", [("confidence", "FraudFlag")]),
]
FOCUS_BY_LABEL = [(["claim", "claims"], [("amount", "Claim")]), (["coverage", "coverages"], [("limit", "Coverage")])]
NUMERIC_PROPS = [("amount", "Claim"), ("limit", "Coverage"), ("premium", "Policy"), ("deductible", "Policy"), ("risk_score", "Policyholder"), ("confidence", "FraudFlag")]


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _any_of(text: Column, phrases: list[str]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(text, F.lit(p))
    return out


def words(text: Column) -> Column:
    """All runs of ASCII letters, lower-case."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-zA-Z]+"), F.lit(0))


def query_tokens(text: Column) -> Column:
    """Words without stop words; repeats stay."""
    return F.filter(words(text), lambda w: ~w.isin(STOPWORDS))


def seed_ids(text: Column) -> Column:
    """Entity ids that a question names, in order, once each."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(ID_PATTERN), F.lit(1)))


def claim_ids(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(CLAIM_PATTERN), F.lit(0)))


def value_tokens(text: Column) -> Column:
    """Query tokens that are no part of an id named."""
    ids = F.transform(seed_ids(text), F.lower)
    return F.filter(query_tokens(text), lambda t: ~F.exists(ids, lambda i: F.contains(i, t)))


def numeric_tokens(text: Column) -> Column:
    """Whole numbers, as ``$1,000`` or ``1000``; digits of decimals and ids count too."""
    raw = F.regexp_extract_all(text, F.lit(r"\$?\d[\d,]*"), F.lit(0))
    return F.transform(raw, lambda s: F.expr("bigint(0)") + F.regexp_replace(s, "[$,]", "").try_cast("bigint"))


def direction(text: Column, substring: bool = False) -> Column:
    """1 above, -1 below, 0 none; whole words, or anywhere in words with ``substring``."""
    low = F.lower(text)
    if substring:
        up, down = _any_of(low, ABOVE), _any_of(low, BELOW)
    else:
        found = words(text)
        up, down = F.arrays_overlap(found, _strings(ABOVE)), F.arrays_overlap(found, _strings(BELOW))
    return F.when(up, 1).when(down, -1).otherwise(0)


def singular(word: Column) -> Column:
    """A light plural strip: -ies, -es, -s."""
    n = F.length(word)
    return (
        F.when(word.endswith("ies") & (n > 4), F.concat(F.expr("''"), word.substr(F.lit(1), n - 3), F.lit("y")))
        .when(word.endswith("es") & (n > 4), word.substr(F.lit(1), n - 2))
        .when(word.endswith("s") & (n > 3) & ~word.endswith("ss") & ~word.endswith("is"), word.substr(F.lit(1), n - 1))
        .otherwise(word)
    )


def focus(text: Column) -> Column:
    """``array<struct<prop, label>>`` that thresholds apply to; null if the question names none."""
    found = words(text)

    def pairs(ps: list[tuple[str, str]]) -> Column:
        return F.array(*[F.struct(F.lit(p).alias("prop"), F.lit(lab).alias("label")) for p, lab in ps])

    out = F.when(F.lit(False), pairs(NUMERIC_PROPS))
    for w, ps in FOCUS:
        out = out.when(F.array_contains(found, w), pairs(ps))
    for ws, ps in FOCUS_BY_LABEL:
        out = out.when(F.arrays_overlap(found, _strings(ws)), pairs(ps))
    return out


def label_hints(text: Column) -> Column:
    """Labels that a question asks about."""
    low = F.lower(text)
    return F.array_compact(F.array(*[F.when(_any_of(low, ps), F.lit(lab)) for lab, ps in LABEL_HINTS.items()]))


def token_count(text: Column) -> Column:
    """A quarter of the characters, 1 at least; 0 for nothing."""
    n = F.length(F.coalesce(text, F.lit("")))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / 4).cast("int")))


def verdict(text: Column) -> Column:
    """YES, NO or UNKNOWN; absence is looked for first, then denial, then any mention of fraud."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(_any_of(low, UNKNOWN_PHRASES), "UNKNOWN").when(_any_of(low, NO_PHRASES), "NO").when(F.contains(low, F.lit("fraud")), "YES").otherwise("UNKNOWN")


def verdict_for(text: Column, claim: Column) -> Column:
    """The verdict of the sentences that name a claim; UNKNOWN without any."""
    sentences = F.filter(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+"), lambda s: F.contains(F.lower(s), F.lower(claim)))
    return F.when(F.size(sentences) == 0, "UNKNOWN").otherwise(verdict(F.array_join(sentences, " ")))


def judged(truth: Column, said: Column) -> Column:
    return F.when(said == "UNKNOWN", "no-verdict").when((said == "YES") == truth, "correct").otherwise("wrong")


def savings(before: Column, after: Column) -> Column:
    """Percent of tokens saved, two places, never below 0."""
    return F.when(F.coalesce(before, F.lit(0)) == 0, 0.0).otherwise(F.greatest(F.round((1 - after / before) * 100, 2), F.lit(0.0)))


def number(cell: Column) -> Column:
    """A number in a cell with ``$ , %``; null where there is none."""
    s = F.regexp_replace(F.trim(cell), "[$,%]", "")
    return F.when(F.lower(s).isin("", "nan", "none", "?"), F.lit(None)).otherwise(s.try_cast("double"))


def native_number(cell: Column) -> Column:
    """Only plain decimals count as numbers; null otherwise."""
    s = F.regexp_replace(F.trim(cell), "[$,]", "")
    return F.when(s.rlike(r"^-?\d+(\.\d+)?$"), s.try_cast("double"))


def padded(number_: Column, width: int) -> Column:
    """Zero-padded to a width that longer numbers keep exceeding."""
    s = number_.cast("string")
    return F.lpad(s, F.greatest(F.length(s), F.lit(width)), F.lit("0"))


def policy_id(cell: Column, row: Column, width: int = 4) -> Column:
    clean = F.trim(F.regexp_replace(F.coalesce(cell, F.lit("")), r"[^\p{L}\p{N} _-]", " "))
    return F.concat(F.lit("POL-"), padded(F.when(clean.rlike(r"^\d+$"), clean).otherwise(row.cast("string")), width))


def plain_number(x: Column) -> Column:
    """A double as text, without an exponent: 54036.0, 0.92; null for null."""
    whole = F.concat(F.format_string("%d", x.cast("bigint")), F.lit(".0"))
    return F.when((x == F.floor(x)) & (F.abs(x) < 1e18), whole).when(x.isNotNull(), F.regexp_replace(F.format_string("%.6f", x), "(\\.\\d+?)0+$", "$1"))


def whole(x: Column) -> Column:
    """A number rounded to an integer, halves to the even one; 0 for none."""
    return F.coalesce(F.bround(x.cast("double")).cast("bigint"), F.lit(0))
