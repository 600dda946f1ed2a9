"""Column functions on text and JSON. All of them stay inside the JVM, except
the last resort of :func:`extract_json`."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Whitespace as Python's str.strip and str.split see it.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# The same set for patterns; listed one by one it would be tested sign by sign.
_RUN_WS = r"(?U)[\s\x1c-\x1f]+"
_WORD = r"(?U)[^\s\x1c-\x1f]+"

# A fenced block, and the tokens used for scoring.
FENCE = r"(?s)```(?:json)?\s*(.+?)\s*```"
CODE_BLOCK = r"(?s)```(?:[a-zA-Z0-9_+-]+)?\n(.*?)```"
SCORE_TOKEN = r"[a-z0-9]+"

# Textual forms of a missing cell.
NULL_WORDS = ["", "none", "null", "nan", "n/a", "na"]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it.

    Without it an expression that uses its input twice doubles the work and the
    plan at every level of nesting.
    """
    return F.transform(F.array(value), body)[0]


def compute_once(df: DataFrame, keep: Sequence[str], **computed: Column) -> DataFrame:
    """The kept columns and the computed ones, each computed exactly once.

    The optimizer copies an expression into every filter and aggregation that
    uses it, and sorts its inputs along. It does not look into a generator, so
    the rows pass through one of a single element.
    """
    cells = [F.col(name) for name in keep] + [c.alias(name) for name, c in computed.items()]
    return df.select(F.explode(F.array(F.struct(*cells))).alias("__r")).select("__r.*")


def strip_ws(c: Column) -> Column:
    """Remove whitespace of every kind from both ends."""
    return F.btrim(c, F.lit(WHITESPACE))


def collapse_ws(c: Column) -> Column:
    """Strip, and turn every inner run of whitespace into one space."""
    return F.regexp_replace(strip_ws(c), _RUN_WS, " ")


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def normalize_text(c: Column, keep_math: bool = False) -> Column:
    """Lower case, every run of non-letters and non-digits as one space, trimmed.

    ``keep_math`` leaves the signs ``+ - = < > ^ * / \\`` in place so that two
    formulas which differ only in an operator stay different.
    """
    kept = r"+\-=<>^*/\\" if keep_math else ""
    return F.trim(F.regexp_replace(F.lower(c), rf"[^\p{{L}}\p{{N}}{kept}]+", " "))


def word_count(c: Column) -> Column:
    """Number of whitespace separated words; null counts 0."""
    return F.coalesce(F.regexp_count(c, F.lit(_WORD)), F.lit(0))


def tokens(c: Column) -> Column:
    """Lower-case ASCII tokens used for scoring."""
    return F.regexp_extract_all(F.lower(c), F.lit(SCORE_TOKEN), F.lit(0))


def clip_text(c: Column, limit: int = 400) -> Column:
    """Strip; empty is null; a longer text keeps ``limit - 3`` characters and ``...``."""

    def clipped(text: Column) -> Column:
        head = F.rtrim(F.substring(text, 1, limit - 3), F.lit(WHITESPACE))
        return F.when(F.length(text) > limit, F.concat(head, F.lit("..."))).when(text != "", text)

    return let(strip_ws(c), clipped)


def is_null_word(c: Column) -> Column:
    """True for null and for a textual form of a missing cell."""
    return c.isNull() | F.lower(strip_ws(c)).isin(NULL_WORDS)


def looks_numeric(c: Column) -> Column:
    """True when the stripped text reads as a floating-point number.

    Digits of any script count, and single underscores may stand between digits.
    """
    digits = r"\p{Nd}(_?\p{Nd})*"
    number = rf"^[+-]?(inf|infinity|nan|({digits}\.?({digits})?|\.{digits})(e[+-]?{digits})?)$"
    return F.coalesce(F.lower(strip_ws(c)).rlike(number), F.lit(False))


def url_host(c: Column) -> Column:
    """Network location of a URL; null when there is none."""
    return F.try_parse_url(c, F.lit("AUTHORITY"))


@F.pandas_udf(T.StringType())
def absolute_url(base: pd.Series, href: pd.Series) -> pd.Series:
    """Resolve ``href`` against ``base``."""
    joined = []
    for b, h in zip(base, href):
        try:
            joined.append(None if h is None else urljoin(b or "", h))
        except ValueError:
            joined.append(h)
    return pd.Series(joined, dtype=object)


# --------------------------------------------------------------------------- JSON


def fenced_block(c: Column) -> Column:
    """Body of the first fenced block; null when there is none."""
    return blank_to_null(F.regexp_extract(c, FENCE, 1))


def _sole_value(text: Column) -> Column:
    """Is the text exactly one JSON value?

    It is parsed as the only element of an array, because the parser itself
    ignores whatever follows the first value.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    alone = F.try_variant_get(listed, "$[1]", "variant").isNull()
    return listed.isNotNull() & alone


def _shaped(c: Column, opener: str, closer: str) -> Column:
    def check(text: Column) -> Column:
        framed = text.startswith(opener) & text.endswith(closer)
        return F.when(framed, F.when(let(text, _sole_value), text))

    return let(strip_ws(c), check)


def json_object(c: Column) -> Column:
    """The stripped text when it is one JSON object, else null."""
    return _shaped(c, "{", "}")


def json_array(c: Column) -> Column:
    """The stripped text when it is one JSON array, else null."""
    return _shaped(c, "[", "]")


def json_text(document: Column, key: str) -> Column:
    """A member of a JSON object as Python's ``str`` would print it."""

    def printed(text: Column) -> Column:
        member = F.try_variant_get(F.try_parse_json(text), f"$.{key}", "variant")
        truth = F.schema_of_variant(member) == "BOOLEAN"
        return let(F.get_json_object(text, f"$.{key}"), lambda v: F.when(truth, F.initcap(v)).otherwise(v))

    return let(document, printed)


def strip_fence(c: Column) -> Column:
    """Inner lines of a text that is one fenced block as a whole; otherwise the stripped text."""
    fence = r"(?s)^```[^\n]*\n(.*)\n[^\n]*```$"
    return let(
        strip_ws(c),
        lambda t: F.when(t.rlike(fence), strip_ws(F.regexp_extract(t, fence, 1))).otherwise(t),
    )


def _aligned(a: list[int], b: list[int]) -> list[int]:
    """Two stacks as one: of the openers at equal depth only the first can give the answer."""
    deep, flat = (a, b) if len(a) >= len(b) else (b, a)
    shift = len(deep) - len(flat)
    for i, at in enumerate(flat):
        deep[shift + i] = min(deep[shift + i], at)
    return deep


def _balanced(text: str, opener: str, closer: str) -> str | None:
    """First slice of ``text`` from an opener to the closer that balances it.

    Strings are read as they look from the opener, so that a quote before it does not turn its
    content into a string. Read from different openers, a place of the text is inside a string or
    not, never anything else: one pass keeps a stack of pending openers for each of the two cases.
    A quote swaps them, and an escaped one, which only those inside skip, brings them together.
    """
    outside: list[int] = []
    inside: list[int] = []
    escaped, first, best = -1, text.find(opener), None
    for mark in re.finditer(f'["\\\\{opener}\\{closer}]', text):
        at, sign = mark.start(), mark.group()
        if sign == "\\":
            escaped = -1 if at == escaped else at + 1
        elif sign == '"':
            inside, outside = (_aligned(inside, outside), []) if at == escaped else (outside, inside)
        elif sign == opener:
            outside.append(at)
        elif outside:
            start = outside.pop()
            if best is None or start < best[0]:
                best = (start, mark.end())
            if start == first:
                break
    return text[slice(*best)] if best else None


@F.pandas_udf(T.StringType())
def _balanced_slice(texts: pd.Series) -> pd.Series:
    return texts.map(
        lambda t: None if t is None else _balanced(t, "{", "}") or _balanced(t, "[", "]"),
        na_action="ignore",
    ).astype(object)


def extract_json(c: Column, field: str | None = None) -> Column:
    """JSON object found in a model's text: whole, unfenced, or the first balanced slice.

    With ``field`` (the only required string member) a text without an object
    yields ``{field: code block or stripped text}``. Python sees only the rows
    that the expressions could not parse.
    """
    direct = F.coalesce(json_object(c), json_object(strip_fence(c)))
    sliced = _balanced_slice(F.when(direct.isNull(), c))
    found = F.coalesce(direct, json_object(sliced))
    if field is None:
        return found
    code = blank_to_null(strip_ws(F.regexp_extract(c, CODE_BLOCK, 1)))
    body = F.coalesce(code, blank_to_null(strip_ws(c)))
    return F.coalesce(found, F.when(body.isNotNull(), F.to_json(F.struct(body.alias(field)))))


# JSON that keeps every null and every microsecond.
EXACT_JSON = {
    "ignoreNullFields": "false",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def stable_json(c: Column, dtype: T.DataType) -> Column:
    """Text form of a nested cell that does not depend on key order.

    Maps and structs have their keys sorted, also inside arrays. A JSON string
    is sorted through its map form by :func:`stable_json_text`.
    """
    return F.to_json(_sorted_keys(c, dtype), EXACT_JSON)


def _sorted_keys(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.MapType):
        inner = F.transform_values(c, lambda _, v: _sorted_keys(v, dtype.valueType))
        return F.map_from_entries(F.array_sort(F.map_entries(inner)))
    if isinstance(dtype, T.StructType):
        members = sorted(dtype.fields, key=lambda f: f.name)
        rebuilt = F.struct(*[_sorted_keys(c[f.name], f.dataType).alias(f.name) for f in members])
        return F.when(c.isNotNull(), rebuilt)
    if isinstance(dtype, T.ArrayType):
        return F.transform(c, lambda item: _sorted_keys(item, dtype.elementType))
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        # The two zeros are equal.
        return c + F.lit(0.0).cast(dtype)
    return c


def stable_json_text(c: Column) -> Column:
    """Key-sorted form of a JSON object held as text; other text is unchanged."""

    def rebuilt(document: Column) -> Column:
        parsed = F.from_json(document, "map<string,string>")
        keys = F.array_sort(F.json_object_keys(document))
        members = F.transform(
            keys, lambda k: F.concat(F.lit('"'), k, F.lit('":'), _json_member(parsed, k))
        )
        return F.concat(F.lit("{"), F.array_join(members, ","), F.lit("}"))

    return F.coalesce(let(json_object(c), rebuilt), c)


def _json_member(parsed: Column, key: Column) -> Column:
    def printed(value: Column) -> Column:
        is_json = F.try_parse_json(value).isNotNull()
        quoted = F.regexp_extract(F.to_json(F.array(value)), r"(?s)^\[(.*)\]$", 1)
        return F.when(value.isNull(), F.lit("null")).when(is_json, value).otherwise(quoted)

    return let(F.try_element_at(parsed, key), printed)


# ------------------------------------------------------------------- row identity


def content_key(columns: list[tuple[str, T.DataType]]) -> Column:
    """SHA-256 of the values of several columns, null equal to null.

    Equal rows share the 32-byte key, so grouping shuffles the digest and not
    the text. Cells are equal as Spark groups them: timestamps to the microsecond,
    the two zeros and all NaN alike. Maps and structs compare without the order
    of their keys.
    """
    cells = [_sorted_keys(F.col(f"`{name}`"), dtype).alias(name) for name, dtype in columns]
    whole = F.to_json(F.struct(*cells), EXACT_JSON)
    return F.unhex(F.sha2(whole, 256))


def text_key(c: Column) -> Column:
    """SHA-256 of a text; null stays null."""
    return F.unhex(F.sha2(c, 256))


def seeded_hash(seed: int, key: Column) -> Column:
    """Hex digest that orders rows at random but repeatably for a seed."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def seeded_uniform(seed: int, key: Column) -> Column:
    """Repeatable value in [0, 1) for a key."""
    head = F.conv(F.substring(seeded_hash(seed, key), 1, 8), 16, 10).cast("double")
    return head / F.lit(float(2**32))
