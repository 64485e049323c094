"""Text functions: tokenisers, scores, hashes, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokenize_word(text: Column | str) -> Column:
    """Lower-cased runs of letters, digits and underscores (Unicode)."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


#: White space of Unicode, as it splits texts into words (fixed values).
BLANKS = r"[\s\x0B\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+"


def tokenize_ws(text: Column | str) -> Column:
    """Lower-cased, split at white space."""
    t = F.trim(F.regexp_replace(F.lower(text), BLANKS, " "))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " "))


def fingerprint(*parts: Column | str, sep: str = "|", length: int = 24) -> Column:
    """Leading hex digits of the sha256 of the parts; null parts count as empty."""
    cols = [F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts]
    return F.substring(F.sha2(F.concat_ws(sep, *cols), 256), 1, length)


def score_answer(expected: Column, predicted: Column) -> Column:
    """1 for the same text but for case and outer blanks, 0.8 if the expected text is contained, else 0."""
    e, p = F.lower(F.trim(F.coalesce(expected, F.lit("")))), F.lower(F.trim(F.coalesce(predicted, F.lit(""))))
    empty = F.coalesce(expected, F.lit("")) == ""
    return F.when(empty, (F.coalesce(predicted, F.lit("")) == "").cast("double")).when(e == p, 1.0).when(p.contains(e), 0.8).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two sets; 1 for two empty ones."""
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / either)


def score_condition(expected: Column, predicted: Column) -> Column:
    norm = lambda c: F.array_distinct(F.transform(F.coalesce(c, F.array()), lambda x: F.lower(F.trim(x))))
    e = norm(expected)
    return F.when(F.size(e) == 0, 1.0).otherwise(jaccard(e, norm(predicted)))


def score_grounding(expected: Column, cited: Column) -> Column:
    """Recall of distinct trimmed ids; 1 where none is expected."""
    norm = lambda c: F.array_distinct(F.transform(F.coalesce(c, F.array()), F.trim))
    e = norm(expected)
    return F.when(F.size(e) == 0, 1.0).otherwise(F.size(F.array_intersect(e, norm(cited))) / F.size(e))


def score_tool_name(expected: Column, predicted: Column) -> Column:
    return (F.trim(F.coalesce(expected, F.lit(""))) == F.trim(F.coalesce(predicted, F.lit("")))).cast("double")


def score_tool_args(expected: Column, predicted: Column) -> Column:
    """Share of expected JSON arguments with an equal trimmed value; extra ones are ignored."""
    kind = "map<string,string>"
    e, p = F.from_json(expected, kind), F.from_json(predicted, kind)
    hits = F.filter(F.map_keys(e), lambda k: F.trim(F.coalesce(F.try_element_at(e, k), F.lit(""))) == F.trim(F.coalesce(F.try_element_at(p, k), F.lit(""))))
    return F.when(F.coalesce(F.size(e), F.lit(0)) <= 0, 1.0).otherwise(F.coalesce(F.size(hits), F.lit(0)) / F.size(e))


#: Amounts, percentages and longer numbers (pattern; fixed value).
FACTS = r"\$[\d,.]+|\d+\.?\d*%|\d{2,}"


def facts(text: Column | str) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(FACTS), F.lit(0)))


def fact_recall(reference: Column | str, text: Column | str) -> Column:
    r = facts(reference)
    return F.size(F.array_intersect(r, facts(text))) / F.greatest(F.size(r), F.lit(1))


def sequence_ratio(a, b):
    """difflib's ratio of two text series (pandas UDF body)."""
    from difflib import SequenceMatcher

    import pandas as pd

    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def ratio(a: Column, b: Column) -> Column:
    return F.pandas_udf(sequence_ratio, "double")(a, b)


def response_score(reference: Column, response: Column) -> Column:
    """0.7 of the sequence ratio plus 0.3 of the fact recall; 0 for an empty response."""
    text = F.coalesce(response, F.lit(""))
    return F.when(F.trim(text) == "", 0.0).otherwise(0.7 * ratio(F.lower(reference), F.lower(text)) + 0.3 * fact_recall(reference, text))


def reward_without_ratio(reference: Column, response: Column) -> Column:
    """Fact overlap, length adequacy and the penalty for degenerate text."""
    text = F.trim(F.coalesce(response, F.lit("")))
    n = F.size(tokenize_ws(text))
    has = F.size(facts(reference)) > 0
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return (
        F.when(has, 0.2 * fact_recall(reference, text)).otherwise(0.0)
        + F.when((n >= 10) & (n <= 200), 0.1).when(n < 5, -0.1).otherwise(0.0)
        + F.when((F.length(text) < 3) | (lines > 20), -0.3).otherwise(0.0)
    )


def reward(reference: Column, response: Column) -> Column:
    """Similarity to the reference (up to 0.6) plus the parts above, clamped to [-1, 1]."""
    text = F.lower(F.trim(F.coalesce(response, F.lit(""))))
    near = F.when(F.coalesce(reference, F.lit("")) != "", 0.6 * ratio(text, F.lower(reference))).otherwise(0.0)
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), near + reward_without_ratio(reference, response)))


#: Secrets to redact: mail addresses, account and card numbers (patterns; fixed values).
SECRETS = {"email": r"[\w.+-]+@[\w-]+\.[\w.]+", "account": r"\bAC-\d+\b", "card": r"\b\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}\b"}


def redact(text: Column | str) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    for name, pattern in SECRETS.items():
        c = F.regexp_replace(c, pattern, f"[{name}]")
    return c


def config_hash(*columns: str) -> Column:
    """The first 16 signs of the hash of a row's settings as a JSON object with sorted keys, ``", "``
    between them and ``": "`` behind each; null as null."""
    value = lambda c: F.regexp_extract(F.to_json(F.struct(F.col(c).alias("v")), {"ignoreNullFields": "false"}), r'^\{"v":(.*)\}$', 1)
    fields = [F.concat(F.lit(f'"{c}": '), value(c)) for c in sorted(columns)]
    text = F.concat(F.lit("{"), F.concat_ws(", ", *fields), F.lit("}"))
    return F.substring(F.sha2(text, 256), 1, 16)
