"""Column expressions over log text. All of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# What counts as white space at either end of a message.
ASCII_SPACE = " \t\n\x0b\x0c\r"
UNICODE_SPACE = (
    ASCII_SPACE
    + "\x1c\x1d\x1e\x1f\x85\xa0 "
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "    　"
)

# Message templating, applied in this order.
TEMPLATE_RULES = [
    (r"blk_-?\d+", "<BLOCK>"),
    (r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(:\d+)?", "<IP>"),
    (r"java\.nio\.channels\.\w+\[[\w\s=/:.]+\]", "<CHANNEL>"),
    (r"@[0-9a-fA-F]+", "<HASH>"),
    (r"/[\w./\-]+", "<PATH>"),
    (r"(?<![a-zA-Z])-?\d{8,}(?![a-zA-Z])", "<ID>"),
    (r"(?<![a-zA-Z_])\d+(?![a-zA-Z_])", "<NUM>"),
]

# Case-sensitive words that raise an INFO line of the storage logs.
STORAGE_ERROR_WORDS = [
    "Exception",
    "exception",
    "Error",
    "error",
    "Failed",
    "failed",
    "timeout",
    "Timeout",
    "refused",
    "Broken pipe",
    "Connection reset",
    "No route to host",
    "does not belong",
    "not found",
    "invalid",
    "timed out",
]
STORAGE_WARN_WORDS = [
    "Unexpected",
    "Reopen",
    "already existing",
    "Removing block",
    "Changing block file offset",
]

# Lower-case words that grade free-form text.
TEXT_ERROR_WORDS = [
    "exception",
    "error",
    "failed",
    "failure",
    "fatal",
    "crash",
    "refused",
    "timeout",
    "timed out",
]
TEXT_WARN_WORDS = ["warn", "warning", "unexpected", "retry", "retrying"]

# Spellings of the severity levels.
SEVERITY_SPELLINGS = {
    "FATAL": ["FATAL", "CRITICAL", "CRIT"],
    "ERROR": ["ERROR", "ERR", "SEVERE"],
    "WARN": ["WARN", "WARNING"],
    "DEBUG": ["DEBUG", "TRACE", "FINE", "FINER", "FINEST"],
}


def strip(c: Column, unicode: bool = True) -> Column:
    return F.trim(c, F.lit(UNICODE_SPACE if unicode else ASCII_SPACE))


def is_blank(c: Column) -> Column:
    return c.isNull() | (strip(c) == "")


def fill_unknown(c: Column) -> Column:
    return F.when(is_blank(c), "unknown").otherwise(c)


def clean_message(c: Column, unicode: bool = True) -> Column:
    """Replace identifiers by placeholders and collapse white space."""
    flag = "(?U)" if unicode else ""
    for pattern, placeholder in TEMPLATE_RULES:
        c = F.regexp_replace(c, flag + pattern, placeholder)
    space = r"[\s\x1c-\x1f]+" if unicode else r"\s+"
    return strip(F.regexp_replace(c, flag + space, " "), unicode)


def any_word(c: Column, words: list[str]) -> Column:
    hit = F.contains(c, F.lit(words[0]))
    for word in words[1:]:
        hit = hit | F.contains(c, F.lit(word))
    return hit


def storage_severity(logged: Column, message: Column) -> Column:
    """The storage logs write INFO for everything; grade such lines by their words."""
    return (
        F.when(logged.isin("ERROR", "FATAL", "WARN"), logged)
        .when(any_word(message, STORAGE_ERROR_WORDS), "ERROR")
        .when(any_word(message, STORAGE_WARN_WORDS), "WARN")
        .otherwise("INFO")
    )


def text_severity(text: Column) -> Column:
    """Binds the lower-cased text to a variable, so that a long one is lowered once and not per word."""

    def grade(low: Column) -> Column:
        return (
            F.when(any_word(low, TEXT_ERROR_WORDS), "ERROR")
            .when(any_word(low, TEXT_WARN_WORDS), "WARN")
            .otherwise("INFO")
        )

    return F.get(F.transform(F.array(F.lower(text)), grade), F.lit(0))


def normalize_severity(raw: Column) -> Column:
    word = strip(F.upper(raw))
    level = F.lit("INFO")
    for name, spellings in SEVERITY_SPELLINGS.items():
        level = F.when(word.isin(spellings), name).otherwise(level)
    return level


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "FATAL", 4).when(severity == "ERROR", 3).when(severity == "WARN", 2).otherwise(1)


def base_service(service: Column) -> Column:
    """Drop a trailing replica number: cart-2 becomes cart."""
    return F.regexp_replace(service, r"-\d+$", "")


def service_tagged_text(service: Column, cleaned: Column) -> Column:
    base = base_service(service)
    return F.when(
        base.isNotNull() & (base != "") & (base != "unknown"), F.concat(base, F.lit(": "), cleaned)
    ).otherwise(cleaned)


def clip(c: Column, n: int, ellipsis: str = "…") -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(ellipsis))).otherwise(c)


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later filters read but do not recompute.

    The optimizer copies the expression behind a column into any filter on it; it
    does not do so through a generator.
    """
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select("*", F.inline(F.array(row)))


def regex_groups(c: Column, pattern: str, groups: int) -> Column:
    """All capture groups of the first match as one array, from a single regex pass.

    The array has another length when the pattern does not occur. Lines that hold
    the separator themselves take one pass per group instead.
    """
    sep = "\x1f"
    joined = sep.join(f"${i}" for i in range(1, groups + 1))
    one_pass = F.split(F.regexp_replace(c, rf"(?s)\A.*?{pattern}.*\z", joined), sep)
    per_group = F.when(
        F.regexp_like(c, F.lit(pattern)),
        F.array(*[F.regexp_extract(c, pattern, i) for i in range(1, groups + 1)]),
    ).otherwise(F.array().cast("array<string>"))
    return F.when(F.contains(c, F.lit(sep)), per_group).otherwise(one_pass)
