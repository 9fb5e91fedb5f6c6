"""Errors as values: a nullable struct column instead of an exception."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ERROR = (
    "struct<error string, code string, hint string, next_actions array<struct<action string, reason string, example map<string,string>>>, "
    "retryable boolean, detail struct<status int, url string, cause string>>"
)

#: The codes that are in use.
CODES = (
    "INVALID_ARGUMENT INVALID_ARTICLE_NUM OUT_OF_SCOPE LAW_NOT_FOUND ARTICLE_NOT_FOUND SOURCE_API_ERROR SOURCE_TIMEOUT "
    "SOURCE_RATE_LIMITED SOURCE_UNAVAILABLE UNKNOWN_TOOL INTERNAL_ERROR"
).split()

#: What an unreachable network leaves in a cause.
UNREACHABLE = ("ECONNREFUSED", "ENOTFOUND", "EAI_AGAIN", "getaddrinfo", "Connection refused", "Name or service not known")


def _text(x: Column | str | None) -> Column:
    return x if isinstance(x, Column) else F.lit(x).cast("string")


def make_error(code: str, message: Column | str, hint: Column | str | None = None, next_actions: list[Column] | None = None, retryable: bool | None = None, detail: Column | None = None) -> Column:
    """An error struct; an empty hint and no actions are null."""
    if code not in CODES:
        raise ValueError(code)
    actions = F.array(*next_actions) if next_actions else F.lit(None)
    return F.struct(
        _text(message).alias("error"),
        F.lit(code).alias("code"),
        F.nullif(_text(hint), F.lit("")).alias("hint"),
        actions.alias("next_actions"),
        F.lit(retryable).cast("boolean").alias("retryable"),
        (detail if detail is not None else F.lit(None)).alias("detail"),
    ).cast(ERROR)


def action(name: str, reason: str, **example: Column | str) -> Column:
    pairs = [x for k, v in example.items() for x in (F.lit(k), _text(v))]
    return F.struct(F.lit(name).alias("action"), F.lit(reason).alias("reason"), (F.create_map(*pairs) if pairs else F.lit(None)).cast("map<string,string>").alias("example"))


def try_alias(abbr: Column | str) -> Column:
    return action("resolve_abbreviation", "Look the abbreviation up for its formal name.", abbr=abbr)


def try_search(keyword: Column | str) -> Column:
    return action("search_law", "Search titles by a part of the name.", keyword=keyword)


def try_toc(law_name: Column | str) -> Column:
    return action("get_toc", "Read the outline to find the right article number.", law_name=law_name)


def try_later() -> Column:
    return action("retry_later", "The failure may pass; try again in a few minutes.")


def try_site(url: Column | str) -> Column:
    return action("visit_site", "Read the law on its public site meanwhile.", url=url)


def try_owner(owner: Column | str) -> Column:
    return action("delegate", "Another service holds this text.", owner=owner)


def detail(status: Column | None = None, url: Column | None = None, cause: Column | None = None) -> Column:
    none = F.lit(None)
    return F.struct((none if status is None else status).cast("int").alias("status"), (none if url is None else url).cast("string").alias("url"), (none if cause is None else cause).cast("string").alias("cause"))


def http_error(status: Column, url: Column, cause: Column) -> Column:
    """Error of a failed request: status (0: timed out, null: no answer), its URL and the cause; null without any of status and cause."""
    unreachable = F.lit(False)
    for mark in UNREACHABLE:
        unreachable = unreachable | F.contains(cause, F.lit(mark))
    at = detail(status, url)
    return (
        F.when(status == 429, make_error("SOURCE_RATE_LIMITED", "The source limits the rate (429).", "Many requests in a short time cause this.", [try_later()], True, at))
        .when(status == 0, make_error("SOURCE_TIMEOUT", "The source timed out.", "Check the network or try again later.", [try_later(), try_site(url)], True, detail(url=url)))
        .when(status >= 500, make_error("SOURCE_API_ERROR", F.concat(F.lit("The source failed: "), status.cast("string")), "The source may be down for a while.", [try_later(), try_site(url)], True, at))
        .when(status.isNotNull(), make_error("SOURCE_API_ERROR", F.concat(F.lit("The source refused: "), status.cast("string")), None, None, False, at))
        .when(unreachable, make_error("SOURCE_UNAVAILABLE", F.concat(F.lit("The source can't be reached: "), cause), "The network or its names may be at fault.", [try_later(), try_site(url)], True, detail(cause=cause)))
        .when(cause.isNotNull(), make_error("SOURCE_API_ERROR", F.concat(F.lit("The request failed: "), cause), None, [try_later()], True, detail(cause=cause)))
    )


def is_error(x: Column) -> Column:
    return x.isNotNull() & x["error"].isNotNull() & x["code"].isNotNull()


def first_error(*errors: Column) -> Column:
    """The first error in the order of the checks."""
    return F.coalesce(*errors)
