"""Entity types: normalisation, classes and the rules that reject or change findings."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT
from .text import col

# Entity vocabularies and word lists of the data model.
STRUCTURED = ["EMAIL_ADDRESS", "URL", "PHONE_NUMBER", "FAX_NUMBER", "US_BANK_NUMBER", "US_DRIVER_LICENSE", "CUSTOMER_IDENTIFIER", "FACE"]
LLM_CONTEXT = ["LEGAL_PARTY_NAME", "FINANCIAL_PENALTY_AMOUNT", "JURISDICTION_STATE"]
SOURCES = ["Presidio", "LLM", "Vision"]
SOURCE_BONUS = {("PERSON", "Presidio"): 0.08, ("STREET_ADDRESS", "Presidio"): 0.08, ("ORGANIZATION", "LLM"): 0.08}
CAPABILITY = [
    "CUSTOMER_IDENTIFIER", "EMAIL_ADDRESS", "FAX_NUMBER", "JURISDICTION_STATE", "LEGAL_PARTY_NAME", "ORGANIZATION", "PERSON",
    "PHONE_NUMBER", "SECURITY_CODE", "STREET_ADDRESS", "URL", "US_BANK_NUMBER", "US_DRIVER_LICENSE",
]
LABEL_ALIASES = {
    "ACCOUNT": "CUSTOMER_IDENTIFIER", "ACCOUNT_NUMBER": "CUSTOMER_IDENTIFIER", "ADDRESS": "STREET_ADDRESS", "CITY": "STREET_ADDRESS",
    "COMPANY": "ORGANIZATION", "COUNTRY": "STREET_ADDRESS", "EMAIL": "EMAIL_ADDRESS", "FAX": "FAX_NUMBER", "FULL_NAME": "PERSON",
    "LOCATION": "STREET_ADDRESS", "MOBILE": "PHONE_NUMBER", "MOBILE_PHONE": "PHONE_NUMBER", "NAME": "PERSON", "PHONE": "PHONE_NUMBER",
    "STATE": "JURISDICTION_STATE", "USERNAME": "CUSTOMER_IDENTIFIER", "WEBSITE": "URL", "ZIPCODE": "STREET_ADDRESS", "ZIP_CODE": "STREET_ADDRESS",
}
CATEGORY_ALIASES = {
    "NAME": "PERSON", "PERSON_NAME": "PERSON", "FULL_NAME": "PERSON", "COMPANY": "ORGANIZATION", "ORG": "ORGANIZATION", "PHONE": "PHONE_NUMBER",
    "MOBILE": "PHONE_NUMBER", "TELEPHONE": "PHONE_NUMBER", "FAX": "FAX_NUMBER", "ADDRESS": "STREET_ADDRESS", "STATE": "JURISDICTION_STATE", "AMOUNT": "FINANCIAL_AMOUNT",
}
HIGH_RISK = [
    "CREDIT_CARD", "CRYPTO", "IBAN_CODE", "IP_ADDRESS", "NRP", "PASSWORD", "US_BANK_NUMBER", "US_DRIVER_LICENSE", "US_ITIN", "US_PASSPORT",
    "US_SSN", "ACCOUNT_NUMBER", "BANK_ACCOUNT_NUMBER", "FINANCIAL_ACCOUNT", "CUSTOMER_IDENTIFIER", "SECURITY_CODE",
]
NON_SENSITIVE = [
    "BUSINESS_CATEGORY", "CATEGORY", "COMPLIANCE_REQUIREMENT", "DATA_CATEGORY", "DISPOSAL_METHOD", "DOCUMENT_TITLE",
    "RETENTION_DURATION", "RETENTION_POLICY", "ROLE", "STORAGE_LOCATION",
]
POLICY_WORDS = (
    "account authorized category cloud compliance customer data disposal duration files information intern location log management method "
    "party personnel policy requirements responsible retention secure storage support tickets user"
).split()
STOP_WORDS = (
    "a an and any are as at be been being but by dear for from here i if in is it its me my not of on or our ours please sincerely thank thanks "
    "that the their them there these they this those to us was we were with you your yours"
).split()
STATE_NAMES = [
    "alabama", "alaska", "arizona", "arkansas", "california", "colorado", "connecticut", "delaware", "florida", "georgia", "hawaii", "idaho",
    "illinois", "indiana", "iowa", "kansas", "kentucky", "louisiana", "maine", "maryland", "massachusetts", "michigan", "minnesota",
    "mississippi", "missouri", "montana", "nebraska", "nevada", "new hampshire", "new jersey", "new mexico", "new york", "north carolina",
    "north dakota", "ohio", "oklahoma", "oregon", "pennsylvania", "rhode island", "south carolina", "south dakota", "tennessee", "texas",
    "utah", "vermont", "virginia", "washington", "west virginia", "wisconsin", "wyoming", "district of columbia",
]
STATE_CODES = (
    "AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY DC"
).split()
# Fixed patterns: words of company names, and phrases before identifiers and codes.
BUSINESS = r"(?i)\b(?:inc|llc|corp|corporation|co|company|ltd|plc|bioventures|ventures)\b"
IDENTIFIER_CONTEXT = r"(?i)\b(?:customer|client|member|user|policy|account|receipt|transaction|order)\s*(?:identifier|id|number|no\.?|#)"
CODE_CONTEXT = r"(?i)\b(?:pin|otp|one[-\s]*time\s*(?:password|pin)|passcode|security\s*code|verification\s*code)\b"


def _lookup(mapping: dict, key: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*map(F.lit, chain(*mapping.items()))), key), key)


def normalize_label(c) -> Column:
    """Upper snake case with aliases resolved; blank is UNKNOWN."""
    x = F.regexp_replace(F.upper(F.trim(F.coalesce(col(c), F.lit("")))), "[^A-Za-z0-9]+", "_")
    x = F.regexp_replace(x, "^_+|_+$", "")
    return F.when(x == "", "UNKNOWN").otherwise(_lookup(LABEL_ALIASES, x))


def capability_label(c) -> Column:
    """The normalized label if the engine claims it, else null."""
    x = normalize_label(c)
    return F.when(x.isin(CAPABILITY), x)


def classify_quote(c) -> Column:
    """Type of a quote that came without one."""
    quote = col(c)
    return (
        F.when(quote.rlike(r"\$\s?[0-9][0-9,]*(?:\.[0-9]+)?"), "FINANCIAL_PENALTY_AMOUNT")
        .when(F.lower(F.trim(F.regexp_replace(quote, r"[.,]", ""))).isin(STATE_NAMES), "JURISDICTION_STATE")
        .when(F.upper(F.trim(quote)).isin(STATE_CODES), "JURISDICTION_STATE")
        .otherwise("LEGAL_PARTY_NAME")
    )


def normalize_category(category, quote) -> Column:
    x = F.regexp_replace(F.replace(F.trim(F.coalesce(col(category), F.lit(""))), F.lit("-"), F.lit("_")), r"[^A-Za-z0-9_\s]", " ")
    x = F.upper(F.regexp_replace(F.regexp_replace(F.trim(x), r"\s+", "_"), "^_+|_+$", ""))
    return F.when(x == "", classify_quote(quote)).otherwise(_lookup(CATEGORY_ALIASES, x))


def is_low_signal(quote, entity_type) -> Column:
    """Whether a quote says too little to be a finding; the reasons are tried in order."""
    raw, kind = F.trim(F.coalesce(col(quote), F.lit(""))), F.upper(F.trim(F.coalesce(col(entity_type), F.lit(""))))
    tokens = F.regexp_extract_all(F.lower(raw), F.lit("[a-z0-9]+"), F.lit(0))
    digits = raw.rlike("[0-9]")
    every = lambda words: F.forall(tokens, lambda t: t.isin(words))
    bare = F.regexp_replace(raw, "[^A-Za-z0-9]+", "")
    acronym = (bare == F.upper(bare)) & bare.rlike("[A-Z]") & (F.length(bare) >= 2)
    words = F.regexp_extract_all(raw, F.lit("[A-Za-z]+"), F.lit(0))
    lower = F.size(F.filter(words, lambda w: w == F.lower(w)))
    alphabetic = F.size(F.filter(tokens, lambda t: t.rlike("^[a-z]+$")))
    return (
        (F.size(tokens) == 0)
        | kind.isin(NON_SENSITIVE)
        | (~digits & (every(POLICY_WORDS) | every(STOP_WORDS)))
        | (~digits & (F.size(tokens) == 1) & kind.isin("LEGAL_PARTY_NAME", "PERSON", "ORGANIZATION") & (F.length(bare) <= 3) & ~acronym)
        | (~digits & kind.isin("LEGAL_PARTY_NAME", "PERSON") & (alphabetic <= 2) & (lower == alphabetic))
    )


def is_oversized(c, max_tokens: int = DEFAULT.max_span_tokens, max_chars: int = DEFAULT.max_span_chars) -> Column:
    """Whether a localized text is too long for an entity."""
    x = F.trim(F.coalesce(col(c), F.lit("")))
    tokens = F.regexp_count(x, F.lit("[A-Za-z0-9]+"))
    return (x != "") & ((tokens > max_tokens) | (F.length(x) > max_chars) | ((F.regexp_count(x, F.lit("[.!?;]")) >= 2) & (tokens >= 8)))


def reclassify(entity_type, text) -> Column:
    """A person whose name holds a business word is an organization."""
    return F.when((col(entity_type) == "PERSON") & col(text).rlike(BUSINESS), "ORGANIZATION").otherwise(col(entity_type))


def promote(entity_type, score, match, context) -> Column:
    """Struct(entity_type, score) of a finding below 0.7 whose context tells what it is.

    ``context``: the text from 48 characters before the match to 24 after it.
    """
    kind, s, m, ctx = map(col, (entity_type, score, match, context))
    digits = F.length(F.regexp_replace(m, "[^0-9]", ""))
    result = lambda t, least: F.struct((F.lit(t) if isinstance(t, str) else t).alias("entity_type"), F.greatest(s, F.lit(least)).alias("score"))
    same = F.struct(kind.alias("entity_type"), s.alias("score"))
    return (
        F.when(s >= 0.7, same)
        .when(kind.isin("URL", "EMAIL_ADDRESS"), result(kind, 0.85))
        .when(m.rlike("^[0-9]{4,7}$") & ctx.rlike(CODE_CONTEXT), result("SECURITY_CODE", 0.89))
        .when(kind.isin("PHONE_NUMBER", "US_BANK_NUMBER", "US_DRIVER_LICENSE") & digits.between(8, 18) & ctx.rlike(IDENTIFIER_CONTEXT), result("CUSTOMER_IDENTIFIER", 0.86))
        .otherwise(same)
    )


def risk_tier(c) -> Column:
    return F.when(col(c).isin(HIGH_RISK), "high").otherwise("standard")


def target_types(requested: str | None, supported: list[str]) -> tuple[list[str], list[str]]:
    """Requested and supported types in the order of the request, and the unknown ones.

    ``ALL``, an empty request and one without a supported type give all.
    """
    names = [x.strip().upper() for x in (requested or "").split(",") if x.strip()]
    if not names or names == ["ALL"]:
        return sorted(supported), []
    found = [x for x in dict.fromkeys(names) if x in supported]
    return found or sorted(supported), [x for x in names if x not in supported and x != "ALL"]
