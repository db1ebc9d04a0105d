"""Model responses: JSON extraction, normalisation, validation, prompts, stage-1 decisions."""

from __future__ import annotations

import json
import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowspark import domains as D
from flowspark.functions.labels import normalise_attack_type
from flowspark.functions.text import strip

TRAILING_COMMA = re.compile(r",\s*([}\]])")
STRUCTURE = re.compile(r'\\.|["{}]', re.S)


def first_block(text: str) -> str | None:
    """First balanced ``{...}``; braces inside strings and escaped characters do not count."""
    start = text.find("{")
    if start < 0:
        return None
    depth, quoted = 0, False
    for token in STRUCTURE.finditer(text, start):
        mark = token.group()
        if mark == '"':
            quoted = not quoted
        elif quoted or len(mark) > 1:
            continue
        elif mark == "{":
            depth += 1
        else:
            depth -= 1
            if depth == 0:
                return text[start:token.end()]
    return None


def repaired(text: str | None) -> str | None:
    """Canonical JSON of a response that is not plain JSON by itself."""
    if not text:
        return None
    candidates = [text.strip()]
    block = first_block(text)
    if block is not None:
        candidates += [block, TRAILING_COMMA.sub(r"\1", block)]
    for candidate in candidates:
        try:
            value = json.loads(candidate)
        except ValueError:
            continue
        return None if value is None else json.dumps(finite(value), ensure_ascii=False)
    return None


def finite(value: object) -> object:
    """``value`` without NaN and Infinity, which JSON proper lacks: a confidence keeps them as text, any other field is 0."""
    if isinstance(value, dict):
        return {k: str(v) if k == "confidence" and isinstance(v, float) and not math.isfinite(v) else finite(v) for k, v in value.items()}
    if isinstance(value, list):
        return [finite(v) for v in value]
    return 0 if isinstance(value, float) and not math.isfinite(value) else value


@F.pandas_udf(T.StringType())
def _repair(texts: pd.Series) -> pd.Series:
    return texts.map(repaired, na_action="ignore")


FIELDS = ("attack_type", "severity", "confidence", "mitre_techniques", "explanation", "recommendations")


def parse(df: DataFrame, response: str = "response", output: str = "fields") -> DataFrame:
    """Add a struct with every expected field of a response as text, its JSON kind and its absence.

    A response that starts with an object and parses is handled by the JVM; only the others are
    handed to the Python helper (the rest reach it as nulls).  Each document is parsed once, into
    a variant that all fields are then read from.
    """
    trimmed = strip(F.col(response))
    staged = df.withColumn("_direct", F.when(trimmed.startswith("{"), F.try_parse_json(trimmed)))
    staged = staged.withColumn("_repaired", _repair(F.when(F.col("_direct").isNull(), F.col(response))))
    staged = staged.withColumn("_doc", F.coalesce("_direct", F.try_parse_json("_repaired")))
    document = F.col("_doc")
    parts = [
        document.isNotNull().alias("parsed"),
        F.coalesce(F.schema_of_variant(document).startswith("OBJECT"), F.lit(False)).alias("is_object"),
    ]
    for field in FIELDS:
        value = F.try_variant_get(document, f"$.{field}", "variant")
        parts += [
            F.try_variant_get(document, f"$.{field}", "string").alias(field),
            F.coalesce(F.schema_of_variant(value), F.lit("VOID")).alias(f"{field}_kind"),
            value.isNull().alias(f"{field}_absent"),
        ]
    return staged.withColumn(output, F.struct(*parts)).drop("_direct", "_repaired", "_doc")


def _text_list(fields: str, name: str) -> Column:
    is_list = F.col(f"{fields}.{name}_kind").startswith("ARRAY")
    items = F.from_json(F.when(is_list, F.col(f"{fields}.{name}")), "array<string>")
    return F.coalesce(items, F.array().cast("array<string>"))


def _keys(fields: str, name: str) -> Column:
    """The keys of a field that is an object instead of a list, sorted."""
    is_object = F.col(f"{fields}.{name}_kind").startswith("OBJECT")
    return F.map_keys(F.from_json(F.when(is_object, F.col(f"{fields}.{name}")), "map<string,string>"))


def technique_ids(items: Column) -> Column:
    """First technique id of every item; items without one are dropped."""
    found = F.transform(items, lambda item: F.regexp_extract(item, D.TECHNIQUE_ID_PATTERN, 0))
    return F.filter(found, lambda item: item != "")


def scaled_confidence(value: Column) -> Column:
    """Percentages become fractions."""
    return F.when(value > 1.0, value / 100.0).otherwise(value)


def _missing(name: str) -> str:
    return D.VALIDATION_TEXT["missing"].format(name)


def _wrap(key: str, value: Column) -> Column:
    before, after = D.VALIDATION_TEXT[key].split("{}")
    return F.concat(F.lit(before), value, F.lit(after))


def _confidence_error(value: Column, kind: Column) -> Column:
    as_number = value.try_cast("double")
    return (
        F.when(kind == "VOID", _missing("confidence"))
        .when(as_number.isNull(), _wrap("confidence_type", value))
        .when(F.isnan(as_number) | (as_number < 0) | (as_number > 1),
              _wrap("confidence_range", _number_text(as_number)))
    )


def _number_text(value: Column) -> Column:
    """A double as text; the values that are no numbers in lower case."""
    return (
        F.when(F.isnan(value), "nan").when(value == float("inf"), "inf").when(value == float("-inf"), "-inf")
        .otherwise(value.cast("string"))
    )


def _list_error(name: str, kind: Column) -> Column:
    return (
        F.when(kind == "VOID", _missing(name))
        .when(~kind.startswith("ARRAY"), D.VALIDATION_TEXT["list"].format(name))
    )


def _choice_error(name: str, key: str, value: Column, allowed: tuple[str, ...], checked: Column) -> Column:
    empty = value.isNull() | value.isin("", "0", "false", "[]", "{}")
    return F.when(empty, _missing(name)).when(~checked.isin(*allowed), _wrap(key, value))


def validation_errors(fields: str = "fields") -> Column:
    """Ordered error list of an unnormalised response (struct from ``parse``)."""
    f = {n: F.col(f"{fields}.{n}") for n in ("attack_type", "severity", "confidence", "explanation")}
    kind = {n: F.col(f"{fields}.{n}_kind") for n in
            ("confidence", "mitre_techniques", "explanation", "recommendations")}
    errors = F.array_compact(F.array(
        _choice_error("attack_type", "attack_type", f["attack_type"], D.ATTACK_CLASSES, f["attack_type"]),
        _choice_error("severity", "severity", f["severity"], D.SEVERITIES, F.lower(f["severity"])),
        _confidence_error(f["confidence"], kind["confidence"]),
        _list_error("mitre_techniques", kind["mitre_techniques"]),
        F.when((kind["explanation"] != "STRING") | (f["explanation"] == ""), D.VALIDATION_TEXT["explanation"]),
        _list_error("recommendations", kind["recommendations"]),
    ))
    return F.when(F.col(f"{fields}.is_object"), errors).otherwise(F.array(F.lit(D.VALIDATION_TEXT["not_object"])))


def normalise_response(df: DataFrame, fields: str = "fields", output: str = "normalised") -> DataFrame:
    """Add a struct with the six normalised answer fields and the errors left after it.

    Absent fields take their defaults first; malformed ones (null or non-numeric confidence,
    null severity, a list instead of an object) become errors and never fail the job.
    """
    is_object = F.col(f"{fields}.is_object")
    raw = {n: F.col(f"{fields}.{n}") for n in ("attack_type", "severity", "confidence", "explanation")}
    kind = {n: F.col(f"{fields}.{n}_kind") for n in ("attack_type", "severity", "confidence", "recommendations")}
    absent = {n: F.col(f"{fields}.{n}_absent") for n in ("confidence", "severity")}
    staged = df.withColumn("_n", F.struct(
        normalise_attack_type(raw["attack_type"]).alias("attack_type"),
        F.when(absent["severity"], "informational").otherwise(F.lower(raw["severity"])).alias("severity"),
        F.when(absent["confidence"], 0.0).otherwise(scaled_confidence(raw["confidence"].try_cast("double"))).alias("confidence"),
        technique_ids(F.coalesce(_keys(fields, "mitre_techniques"), _text_list(fields, "mitre_techniques"))).alias("mitre_techniques"),
        F.coalesce(raw["explanation"], F.lit("")).alias("explanation"),
        _text_list(fields, "recommendations").alias("recommendations"),
    ))
    explained = (F.col(f"{fields}.explanation_kind") == "STRING") & (raw["explanation"] != "")
    errors = F.array_compact(F.array(
        _choice_error("severity", "severity", F.col("_n.severity"), D.SEVERITIES, F.col("_n.severity")),
        F.when(absent["confidence"], F.lit(None)).otherwise(F.coalesce(
            F.when(F.col("_n.confidence").isNull(), _confidence_error(raw["confidence"], kind["confidence"])),
            _confidence_error(F.col("_n.confidence").cast("string"), F.lit("DOUBLE")))),
        F.when(~explained, D.VALIDATION_TEXT["explanation"]),
        _list_error("recommendations", kind["recommendations"]),
    ))
    result = F.struct(
        F.col("_n.*"),
        F.when(is_object, errors).otherwise(F.array(F.lit(D.VALIDATION_TEXT["not_object"]))).alias("validation_errors"),
    )
    return staged.withColumn(output, result).drop("_n")


def stage1_decision(response: Column, failed: Column | None = None) -> Column:
    """BENIGN or THREAT from a one-word answer; ERROR when the answer never came."""
    first_word = F.split(F.upper(strip(response)), r"\s+")[0]
    decided = F.when(first_word.contains("BENIGN"), "BENIGN").otherwise("THREAT")
    broken = response.isNull() if failed is None else failed | response.isNull()
    return F.when(broken, "ERROR").otherwise(decided)


def flow_prompt(description: Column, context: Column, template: str = D.FLOW_PROMPT) -> Column:
    lead, rest = template.split("{description}")
    middle, tail = rest.split("{context}")
    shown = F.when(F.coalesce(context, F.lit("")) == "", D.NO_CONTEXT_TEXT).otherwise(strip(context))
    return F.concat(F.lit(lead), strip(description), F.lit(middle), shown, F.lit(tail))


def stage1_prompt(description: Column, template: str = D.STAGE1_PROMPT) -> Column:
    lead, tail = template.split("{description}")
    return F.concat(F.lit(lead), strip(description), F.lit(tail))
