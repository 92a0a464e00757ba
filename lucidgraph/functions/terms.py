"""Terms: URLs, variables, ids and how they are written."""

from __future__ import annotations

import sys
from urllib.parse import quote, unquote, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

# The names of relations and clusters that are made rather than read.
AUX_RELATION = "http://execute_aux.org/auxBelongsTo"
AUX_CLUSTER = "http://execute_aux.org/auxC"
FEEDBACK = "http://execute.org/"


def is_variable(x: Column) -> Column:
    return x.startswith("?")


def is_url(x: Column) -> Column:
    return x.startswith("http:") | x.startswith("https:")


def in_braces(x: Column) -> Column:
    return x.startswith("<") & x.endswith(">")


def strip_braces(x: Column) -> Column:
    return F.when(in_braces(x) & (F.length(x) > 1), F.substring(x, F.lit(2), F.length(x) - 2)).otherwise(x)


def add_braces(x: Column) -> Column:
    left = F.when(x.startswith("<"), x).otherwise(F.concat(F.lit("<"), x))
    return F.when(left.endswith(">"), left).otherwise(F.concat(left, F.lit(">")))


def valid_id(x: Column) -> Column:
    """No backslash; null is valid."""
    return ~F.coalesce(x.contains("\\"), F.lit(False))


def url_path(x: Column) -> Column:
    """A URL's path without its first slash; what is no URL as it is."""
    path = F.coalesce(F.regexp_extract(x, r"^https?:(?://[^/?#]*)?([^?#]*)", 1), F.lit(""))
    return F.when(is_url(x), F.when(path.startswith("/"), F.substring(path, F.lit(2), F.length(path))).otherwise(path)).otherwise(x)


def query_term(x: Column) -> Column:
    """A variable as it is, a constant in angle brackets."""
    return F.when(is_variable(x) | in_braces(x), x).otherwise(F.concat(F.lit("<"), x, F.lit(">")))


def query_pattern(s: Column, p: Column, o: Column) -> Column:
    return F.concat(F.concat_ws(" ", query_term(s), query_term(p), query_term(o)), F.lit("."))


def tab_separated(s: Column, p: Column, o: Column) -> Column:
    return F.concat_ws("\t", query_term(s), query_term(p), query_term(o))


def tuple_text(s: Column, p: Column, o: Column) -> Column:
    return F.concat(F.lit("("), F.concat_ws(",", s, p, o), F.lit(")"))


def _entity(x: str | None, prefix: str, quoted: bool) -> str | None:
    if x is None:
        return None
    x = x[1:-1] if x.startswith("<") and x.endswith(">") else x
    if not prefix and not quoted:
        return x
    if x.startswith(("http:", "https:")):
        parts = list(urlsplit(x))
        parts[2] = quote(parts[2], encoding="utf-8") if quoted else parts[2]
        return urlunsplit(parts)
    return urljoin(prefix, quote(x, encoding="utf-8") if quoted else x)


#: What joins to an absolute prefix by appending, and quotes to itself.
_PLAIN = r"^[A-Za-z0-9_~-][A-Za-z0-9_.~-]*$"


def _joined(x: Column, prefix: str, quoted: bool, slow) -> Column:
    """Plain names natively, by the prefix up to its last slash; others exactly, in Arrow batches."""
    parts = urlsplit(prefix)
    if prefix and not (parts.scheme and parts.netloc) or parts.query or parts.fragment:
        return slow(x)
    base = prefix[: prefix.rindex("/") + 1] if parts.path else prefix + "/"
    bare = strip_braces(x)
    return F.when(bare.rlike(_PLAIN), F.concat(F.lit(base if prefix else ""), bare)).otherwise(slow(x))


def entity_url(x: Column, prefix: str = "", quoted: bool = False) -> Column:
    """A full URL of an entity: joined to the prefix, path quoted on demand. Without either, only brackets go."""
    if not prefix and not quoted:
        return strip_braces(x)

    def batch(v: pd.Series) -> pd.Series:
        return v.map(lambda t: _entity(t, prefix, quoted), na_action="ignore")

    return _joined(x, prefix, quoted, F.pandas_udf(batch, "string"))


def relation_url(x: Column, prefix: str = "") -> Column:
    """A full URL of a relation: URLs as they are, others joined to the prefix; never quoted."""
    if not prefix:
        return strip_braces(x)

    def batch(v: pd.Series) -> pd.Series:
        return v.map(lambda t: _entity(t, prefix, False) if not _url_in(t) else t.removeprefix("<").removesuffix(">"), na_action="ignore")

    return _joined(x, prefix, False, F.pandas_udf(batch, "string"))


def _url_in(t: str) -> bool:
    return t.removeprefix("<").startswith(("http:", "https:"))


def unquoted(x: Column) -> Column:
    """Percent codes decoded; ``+`` and malformed codes stay."""

    def batch(v: pd.Series) -> pd.Series:
        return v.map(unquote, na_action="ignore")

    return F.when(x.contains("%"), F.pandas_udf(batch, "string")(x)).otherwise(x)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
