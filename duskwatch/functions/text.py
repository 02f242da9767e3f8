"""Text expressions: entropy, truncation, risk words, technique links."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Entropy of the text {s} in bits per character: log2(n) - sum(c * log2(c)) / n over its n characters, c of each kind.
_ENTROPY_SQL = (
    "case when length({s}) > 0 then greatest(0D, log2(length({s})) - aggregate("
    "transform(array_distinct(split({s}, '')), "
    "ch -> (octet_length({s}) - octet_length(replace({s}, ch, ''))) / octet_length(ch)), "
    "0D, (acc, c) -> acc + c * log2(c)) / length({s})) else 0D end"
)


def shannon_entropy(text: Column) -> Column:
    """Bits per character of the whole text; null and empty give 0."""
    total = F.length(text)

    def occurrences(ch: Column) -> Column:
        return (F.octet_length(text) - F.octet_length(F.replace(text, ch, F.lit("")))) / F.octet_length(ch)

    counts = F.transform(F.array_distinct(F.split(text, "")), occurrences)
    weighted = F.aggregate(counts, F.lit(0.0), lambda acc, c: acc + c * F.log2(c))
    return F.when(total > 0, F.greatest(F.lit(0.0), F.log2(total) - weighted / total)).otherwise(F.lit(0.0))


def mean_token_entropy(tokens: Column) -> Column:
    """Average entropy of the non-empty tokens of an array; no tokens give 0."""
    kept = F.filter(tokens, lambda token: F.length(token) > 0)
    total = F.aggregate(kept, F.lit(0.0), lambda acc, token: acc + shannon_entropy(token))
    return F.when(F.size(kept) > 0, total / F.size(kept)).otherwise(F.lit(0.0))


def text_entropy(command_line: Column, message: Column) -> Column:
    """Entropy of the command line, or of the message where there is no command line."""
    return F.when(F.length(command_line) > 0, shannon_entropy(command_line)).otherwise(shannon_entropy(message))


def register_sql_functions(spark: SparkSession) -> None:
    """Make ``shannon_entropy`` callable from SQL text; the body stays a Catalyst expression."""
    body = _ENTROPY_SQL.format(s="txt")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION shannon_entropy(txt STRING) RETURNS DOUBLE RETURN {body}")


def truncate(text: Column, limit: int) -> Column:
    """At most ``limit`` characters, the last three being dots when something was cut; null gives ''."""
    whole = F.coalesce(text, F.lit(""))
    cut = F.concat(F.substring(whole, 1, limit - 3), F.lit("..."))
    return F.when(F.length(whole) <= limit, whole).otherwise(cut)


# Words that name a risk level, in English and Vietnamese.
RISK_WORDS = {
    "HIGH": ["cao", "nghiêm\\s*trọng", "critical", "high"],
    "MEDIUM": ["trung\\s*bình", "vừa", "medium", "med", "moderate"],
    "LOW": ["thấp", "low"],
}


def risk_from_text(text: Column, default: str = "LOW") -> Column:
    """Risk level named in a text, the most severe one first."""
    result = F.lit(default)
    for level in ("LOW", "MEDIUM", "HIGH"):
        pattern = "(?iU)\\b(" + "|".join(RISK_WORDS[level]) + ")\\b"
        result = F.when(text.rlike(pattern), F.lit(level)).otherwise(result)
    return F.when(F.length(text) > 0, result).otherwise(F.lit(default))


def technique_url(technique: Column) -> Column:
    """Public page of an ATT&CK technique; sub-techniques become a path step, blank gives ''."""
    trimmed = F.trim(F.coalesce(technique, F.lit("")))
    link = F.concat(F.lit("https://attack.mitre.org/techniques/"), F.replace(trimmed, F.lit("."), F.lit("/")), F.lit("/"))
    return F.when(trimmed == "", F.lit("")).otherwise(link)


def dedup_in_order(items: Column) -> Column:
    """Non-empty strings of an array, each at its first position."""
    return F.array_distinct(F.filter(items, lambda item: F.length(item) > 0))
