"""SQL expressions of features, checked against an allow-list before they become columns.

They are checked twice: as written (``check``), and, where a session runs, as Spark's own parser reads them (``check_parsed``), so
that comments, quotes and qualified names can't make a call look like something else.
"""

from __future__ import annotations

import re

from py4j.protocol import Py4JError
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tessera.errors import UnsafeExpressionError

ALLOWED = frozenset(
    """abs sqrt cbrt exp ln log log1p log2 log10 pow power sign signum floor ceil round bround tanh sin cos greatest least
    coalesce nanvl nullif isnull isnotnull isnan try_divide width_bucket concat_ws concat lower upper length char_length trim
    substring regexp_replace regexp_extract split size array_distinct year month day dayofmonth quarter weekofyear weekday
    hour minute datediff months_between avg sum min max count stddev_samp stddev var_pop median percentile rank dense_rank
    row_number percent_rank ntile lag lead if cast try_cast get_json_object mod pmod""".split()
)
KEYWORDS = frozenset("and or not in is null case when then else end between like as over partition by order asc desc rows range preceding following unbounded current row distinct nulls first last true false interval".split())
TYPES = frozenset("double float int integer bigint string boolean date timestamp decimal smallint tinyint long".split())
TOKEN = re.compile(r"\s+|(?P<text>'(?:[^'\\]|\\.)*')|(?P<name>`[^`]+`|[A-Za-z_][A-Za-z0-9_]*)|(?P<number>\d+(?:\.\d*)?(?:[eE][+-]?\d+)?[DLdl]?|\.\d+)|(?P<sign><=>|<=|>=|<>|!=|==|\|\||-(?!-)|/(?!\*)|[+*%=<>(),.\[\]])")  # and no comment
BANNED = frozenset("select from join union with values lateral exists explode insert delete update drop create".split())


def check(text: str) -> str:
    """The expression itself, or ``UnsafeExpressionError``: every call must be allowed, and nothing but an expression may stand there."""
    tokens, at = [], 0
    while at < len(text):
        found = TOKEN.match(text, at)
        if not found:
            raise UnsafeExpressionError(f"unexpected {text[at]!r}")
        if found.lastgroup:
            tokens.append((found.lastgroup, found.group(found.lastgroup)))
        at = found.end()
    if not tokens:
        raise UnsafeExpressionError("empty expression")
    for i, (kind, value) in enumerate(tokens):
        following = tokens[i + 1][1] if i + 1 < len(tokens) else ""
        if kind != "name":
            continue
        if following == "." and i + 3 < len(tokens) and tokens[i + 3][1] == "(":
            raise UnsafeExpressionError("functions are called by plain names")
        if value.startswith("`"):
            if following == "(":
                raise UnsafeExpressionError("functions are called by names without quotes")
            continue
        low = value.lower()
        if low in BANNED:
            raise UnsafeExpressionError(f"{value} isn't allowed")
        if following == "(" and low not in ALLOWED | KEYWORDS | TYPES:
            raise UnsafeExpressionError(f"function {value} isn't allowed")
        if low.startswith("current_") or low in ("rand", "randn", "uuid"):
            raise UnsafeExpressionError(f"{value} isn't deterministic")
    return text


#: Kinds of nodes of a parsed expression: names, literals, operators, conditions, casts and windows; no subquery, lambda, alias or star.
NODES = frozenset(
    """Add And Between CaseWhen Cast Concat CurrentRow Divide EqualNullSafe EqualTo GreaterThan GreaterThanOrEqual If In IntegralDivide
    IsNotNull IsNull LessThan LessThanOrEqual Like LikeAll LikeAny Literal Multiply Not NotLikeAll NotLikeAny Or Remainder SortOrder
    SpecifiedWindowFrame StringTrim StringTrimLeft StringTrimRight Subtract UnaryMinus UnaryPositive UnboundedFollowing
    UnboundedPreceding UnresolvedAttribute UnresolvedExtractValue UnresolvedFunction UnspecifiedFrame WindowExpression WindowSpecDefinition""".split()
)


def check_parsed(spark: SparkSession, text: str) -> str:
    """The expression itself, or ``UnsafeExpressionError``: its parsed tree holds allowed kinds of nodes and plain calls of allowed functions."""
    try:
        left = [spark._jsparkSession.sessionState().sqlParser().parseExpression(text)]
    except Py4JError as err:
        raise UnsafeExpressionError(f"it can't be parsed: {str(err).splitlines()[0]}") from err
    while left:
        node = left.pop()
        kind = node.getClass().getSimpleName().rstrip("$")
        if kind not in NODES:
            raise UnsafeExpressionError(f"{kind} isn't allowed")
        if kind == "UnresolvedFunction":
            parts = [node.nameParts().apply(i) for i in range(node.nameParts().size())]
            if len(parts) != 1 or parts[0].lower() not in ALLOWED | {"between"}:
                raise UnsafeExpressionError(f"function {'.'.join(parts)} isn't allowed")
        left += [node.children().apply(i) for i in range(node.children().size())]
    return text


def safe_expr(text: str) -> Column:
    spark = SparkSession.getActiveSession()
    if spark is not None:
        check_parsed(spark, check(text))
    return F.expr(check(text))
