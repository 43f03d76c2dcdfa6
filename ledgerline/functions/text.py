"""Column expressions over descriptions, dates and amounts."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import DOMAIN_ALIASES, KEYWORD_RULES, MERCHANTS, PLACES, TRANSFER_WORDS

# What cleaning removes from an upper-cased description, in this order, and what takes its place.
CLEANING = [
    (r"SQ \*|TST\* ?|PAYPAL \*|\*(TRIP|EATS|RIDE) ", ""), (r"\.COM\b", ""), (r"/", " "), (r"\b\d{10}\b", ""), (r"#\d+", ""), (r"\*[A-Z0-9]{2,4}\b", ""), (r"\b\d{3,6}\b", ""),
]


def clean_descriptor(raw: Column) -> Column:
    """A description without processors, phone and store numbers and places."""
    out = F.upper(raw)
    for pattern, to in CLEANING:
        out = F.regexp_replace(out, pattern, to)
    words = F.filter(F.split(out, r"\s+"), lambda w: (w != "") & ~w.isin(PLACES))
    return F.regexp_replace(F.array_join(words, " "), r"[\s*./]+$", "")


def domain_alias(raw: Column) -> Column:
    return F.coalesce(*[F.when(F.upper(raw).contains(k), F.lit(v)) for k, v in DOMAIN_ALIASES.items()])


def subset_alias(cleaned: Column) -> Column:
    """The first merchant whose words all stand in the text, or the other way round: a token-set score of 100."""
    words = F.split(cleaned, " ")

    def holds(name: str) -> Column:
        own = F.array(*[F.lit(w) for w in name.upper().split()])
        return (F.size(F.array_intersect(words, own)) > 0) & ((F.size(F.array_except(own, words)) == 0) | (F.size(F.array_except(words, own)) == 0))

    return F.coalesce(*[F.when(holds(m), F.lit(m)) for m in MERCHANTS])


def keyword_category(raw: Column, rules: dict[str, str] = KEYWORD_RULES) -> Column:
    return F.coalesce(*[F.when(F.upper(raw).contains(k.upper()), F.lit(v)) for k, v in rules.items()], F.lit(None).cast("string"))


def looks_like_transfer(raw: Column) -> Column:
    return F.upper(raw).rlike(TRANSFER_WORDS)


# The states that descriptions name.
STATES = r"\b(GA|TX|CO|WA|ID|FL|NY|CA)\b"


def state(raw: Column) -> Column:
    return F.nullif(F.regexp_extract(raw, STATES, 1), F.lit(""))


def parse_date(text: Column, layout: str) -> Column:
    """layout: M/d/yyyy, d/M/yyyy or yyyy-M-d; null where the text isn't such a date."""
    return F.try_to_timestamp(F.trim(text), F.lit(layout)).cast("date")


def parse_amount(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), "[,$]", "").try_cast("decimal(12,2)")


def txn_id(account: Column, posted: Column, amount_text: Column, description: Column, occurrence: Column, fitid: Column | None = None) -> Column:
    content = F.concat_ws("|", account, F.date_format(posted, "yyyy-MM-dd"), amount_text, description, occurrence.cast("string"))
    if fitid is not None:
        content = F.when(F.coalesce(fitid, F.lit("")) != "", F.concat(F.lit("fitid|"), fitid)).otherwise(content)
    return F.substring(F.sha2(content.cast("binary"), 256), 1, 16)


def amount_bucket(amount: Column) -> Column:
    size = F.abs(amount)
    return F.when(size < 1, 0).otherwise(F.least(F.floor(F.log2(size)) + 1, F.lit(9))).cast("long")
