"""Column functions: hashing and ids, text, JSON, numbers and vectors."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNIT = "\u001f"
#: Characters that Python's str.strip removes and that occur in text data.
WHITE = " \t\n\r\x0b\x0c   　"


# -- ids, seeds and hashes -------------------------------------------------------------------------------------------


def canonical_json(*names: str) -> Column:
    """One JSON object of the columns in order of their names, nulls included."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(names)]), {"ignoreNullFields": "false"})


def json_part(*names: str, first: bool, last: bool) -> Column:
    """The columns' part of a canonical_json of more columns, of which these are neighbours: the parts in order are the whole."""
    own = canonical_json(*names)
    inner = F.substr(own, F.lit(2), F.length(own) - 2)
    return F.concat(F.lit("{" if first else ","), inner, F.lit("}" if last else ""))


def row_hash(*names: str) -> Column:
    return F.sha2(canonical_json(*names), 256)


def _joined(separator: str, parts: tuple) -> Column:
    return F.sha2(F.concat_ws(separator, *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]), 256)


def stable_seed(*parts: Column | str | int) -> Column:
    """31 bits: the first 8 hexadecimal digits of the SHA-256 of the parts joined by U+001F, without the top bit."""
    return F.conv(F.substring(_joined(UNIT, parts), 1, 8), 16, 10).cast("long").bitwiseAND(F.lit(0x7FFFFFFF))


def stable_seed64(*parts: Column | str | int) -> Column:
    """The first 8 bytes of the SHA-256 of the parts joined by ``|``, as an unsigned number."""
    return F.conv(F.substring(_joined("|", parts), 1, 16), 16, 10).cast("decimal(20,0)")


def hash_id(prefix: str, *parts: Column | str | int, digits: int = 20) -> Column:
    return F.concat(F.lit(prefix), F.substring(_joined(UNIT, parts), 1, digits))


def digest_parity(key: Column) -> Column:
    """0 or 1: the first byte of the SHA-256 modulo 2 (the order of two options of an item)."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 2), 16, 10).cast("int") % 2


# -- text ------------------------------------------------------------------------------------------------------------


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE))


def fill_template(template: str, **values: Column) -> Column:
    """The template with each ``{name}`` replaced by a column. It is cut at its markers once, so braces inside values
    stay as they are. A name without a value, or a value without a name, is an error."""
    import re

    parts = re.split(r"\{([a-z_]+)\}", template)
    if set(parts[1::2]) != set(values):
        raise ValueError(f"template names {sorted(set(parts[1::2]))}, values {sorted(values)}")
    return F.concat(*[values[p] if i % 2 else F.lit(p) for i, p in enumerate(parts)])


@F.pandas_udf(T.StringType())
def _folded(text: pd.Series) -> pd.Series:
    import unicodedata

    return text.map(lambda x: None if x is None else " ".join(unicodedata.normalize("NFKC", x).casefold().split()))


def folded(text: Column) -> Column:
    """NFKC, case folding and single spaces. ASCII texts stay in the JVM."""
    plain = F.btrim(F.regexp_replace(F.lower(text), r"[ \t\n\r\x0b\x0c\x1c-\x1f]+", " "), F.lit(" "))
    return F.when(text.rlike(r"\A[\x00-\x7f]*\z"), plain).otherwise(_folded(text))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _casefolded(texts: pd.Series) -> pd.Series:
    return texts.map(lambda xs: None if xs is None else [None if x is None else x.strip().casefold() for x in xs])


def casefolded(texts: Column) -> Column:
    """Each text of an array without white space around it, case folded. ASCII texts stay in the JVM."""
    plain = F.transform(texts, lambda x: F.lower(F.btrim(x, F.lit(" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f"))))
    return F.when(F.array_join(texts, "").rlike(r"\A[\x00-\x7f]*\z"), plain).otherwise(_casefolded(texts))


def token_estimate(text: Column, language: Column) -> Column:
    """Characters by 4.0, or by 1.8 in Japanese, rounded up, 1 at least."""
    return F.greatest(F.lit(1), F.ceil(F.length(text) / F.when(language == "ja", 1.8).otherwise(4.0))).cast("long")


@F.pandas_udf(T.StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    import unicodedata

    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@F.pandas_udf(T.StringType())
def _nfkc_folded(text: pd.Series) -> pd.Series:
    import unicodedata

    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).casefold())


def nfkc(text: Column) -> Column:
    """NFKC. ASCII texts stay in the JVM."""
    return F.when(text.rlike(r"\A[\x00-\x7f]*\z"), text).otherwise(_nfkc(text))


def nfkc_folded(text: Column) -> Column:
    """NFKC and case folding, white space as it is. ASCII texts stay in the JVM."""
    return F.when(text.rlike(r"\A[\x00-\x7f]*\z"), F.lower(text)).otherwise(_nfkc_folded(text))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("left", T.StringType()), T.StructField("right", T.StringType())])))
def diff_spans(left: pd.Series, right: pd.Series, language: pd.Series) -> pd.Series:
    """The spans in which two sentences differ: what single spaces part in English, characters in every other language. A
    side without text of its own at such a place is empty there."""
    import difflib

    def spans(a: str | None, b: str | None, lang: str | None) -> list[dict] | None:
        if a is None or b is None:
            return None
        x, y, glue = (a.split(" "), b.split(" "), " ") if lang == "en" else (list(a), list(b), "")
        return [{"left": glue.join(x[i:j]), "right": glue.join(y[k:m])} for op, i, j, k, m in difflib.SequenceMatcher(None, x, y).get_opcodes() if op != "equal"]

    return pd.Series([spans(*row) for row in zip(left, right, language, strict=True)])


# -- JSON ------------------------------------------------------------------------------------------------------------


def unfenced(text: Column) -> Column:
    """What a code fence around the whole text holds, or the text."""
    return F.coalesce(F.nullif(F.regexp_extract(stripped(text), r"(?is)\A```(?:json)?\s*(.*?)\s*```\z", 1), F.lit("")), stripped(text))


def parse_object(text: Column, schema: str) -> Column:
    """The JSON object, inside a code fence or not; null where it isn't one."""
    inner = unfenced(text)
    return F.when(inner.rlike(r"(?s)\A\{.*\}\z"), F.from_json(inner, schema, {"mode": "PERMISSIVE"}))


def parse_label(text: Column, labels: tuple[str, ...] = ("evaluation", "deployment")) -> Column:
    """The label of a reply: the field ``label`` of a JSON object (null if that is another one), else the label alone, else
    the only one of the labels that stands as ``"label": "..."``, in either quotes, in the text; else null."""
    own = stripped(text)
    inner = F.when(own.startswith("```"), stripped(F.regexp_replace(own, r"(?m)^[ \t]*```.*$", ""))).otherwise(own)
    fields = F.from_json(inner, "map<string,string>")
    field = F.lower(stripped(F.element_at(fields, F.lit("label"))))
    low = F.lower(inner)
    quoted = F.replace(low, F.lit("'"), F.lit('"'))
    hits = [F.contains(quoted, F.lit(f'"label": "{x}"')) for x in labels]
    count = sum((h.cast("int") for h in hits), F.lit(0))
    only = F.coalesce(*[F.when(h & (count == 1), x) for h, x in zip(hits, labels, strict=True)])
    return F.when(F.coalesce(F.map_contains_key(fields, F.lit("label")), F.lit(False)), F.when(field.isin(*labels), field)).when(low.isin(*labels), low).otherwise(only)


def truncated(response: Column) -> Column:
    """Whether a model's JSON response was cut off at its length limit."""
    first = lambda name: F.get_json_object(response, f"$.choices[0].{name}")
    return F.coalesce(first("finish_reason") == "length", F.lit(False)) | F.coalesce(first("native_finish_reason") == "max_output_tokens", F.lit(False))


# -- numbers and vectors ---------------------------------------------------------------------------------------------


def sigmoid(z: Column) -> Column:
    return F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))


def softplus(z: Column) -> Column:
    """log(1 + exp(z)) without overflow."""
    return F.when(z > 0, z + F.log1p(F.exp(-z))).otherwise(F.log1p(F.exp(z)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """Null for a vector of zeros."""
    return F.when(norm(a) > 0, F.transform(a, lambda x: x.cast("double") / norm(a)))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
