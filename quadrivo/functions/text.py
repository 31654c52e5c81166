"""Text rules as column expressions: markup, secrets, addresses, keys, messages."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .instants import as_column

MESSAGE_CHARS, ERROR_CHARS, DESCRIPTION_CHARS, SECRET_CHARS = 4096, 1000, 200, 8
#: What marks a secret in a text.
TOKEN_PARAMETER = r"(?i)((?:ws)?token=)[^&\s'\"<>]+"
BOT_TOKEN = r"[0-9]{6,}:[A-Za-z0-9_-]{30,}"
AUTH_ERRORS = ("invalidtoken", "invalidlogin")
SUBJECT = "assignment:"


def strip(c: Column | str) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(as_column(c), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def strip_markup(c: Column | str) -> Column:
    """A short fragment of HTML as plain text; null when nothing is left."""
    return F.nullif(strip(F.regexp_replace(as_column(c), "<[^>]+>", "")), F.lit(""))


def redact(c: Column | str, secrets: Sequence[str] = ()) -> Column:
    """Without tokens in parameters, tokens of bots, and literal secrets long enough to be real."""
    out = F.regexp_replace(F.regexp_replace(as_column(c), TOKEN_PARAMETER, "$1***"), BOT_TOKEN, "***")
    for secret in secrets:
        if len(secret.strip()) >= SECRET_CHARS:
            out = F.replace(out, F.lit(secret.strip()), F.lit("***"))
    return out


def bounded(c: Column | str, most: int, mark: str) -> Column:
    """At most `most` characters, the mark at the end of what was cut."""
    c = as_column(c)
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(most - len(mark))), F.lit(mark))).otherwise(c)


def safe_error(kind: Column | str, message: Column | str, secrets: Sequence[str] = ()) -> Column:
    """The one form in which an error may be kept or shown."""
    return bounded(redact(F.concat(as_column(kind), F.lit(": "), as_column(message)), secrets), ERROR_CHARS, "...")


def message(title: Column | str, body: Column | str) -> Column:
    return bounded(F.concat(as_column(title), F.lit("\n"), as_column(body)), MESSAGE_CHARS, "…")


def error_description(reply: Column | str) -> Column:
    """The reason in an error reply (JSON), as a suffix; empty when there is none."""
    said = F.get_json_object(as_column(reply), "$.description")
    return F.when(F.coalesce(said, F.lit("")) == "", F.lit("")).otherwise(F.concat(F.lit(": "), F.left(said, F.lit(DESCRIPTION_CHARS))))


def api_error(reply: Column | str) -> Column:
    """auth, api or null: whether a reply (JSON) reports an error."""
    keys = F.json_object_keys(as_column(reply))
    code = F.get_json_object(as_column(reply), "$.errorcode")
    failed = F.array_contains(keys, "exception") & F.array_contains(keys, "errorcode")
    return F.when(failed, F.when(code.isin(*AUTH_ERRORS), F.lit("auth")).otherwise(F.lit("api")))


# --- addresses --------------------------------------------------------------------------------------


def _query(url: Column) -> tuple[Column, Column, Column]:
    """What stands before, in and behind the query of an address."""
    before = F.regexp_extract(url, "^[^?#]*", 0)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    return before, query, F.regexp_extract(url, "#.*$", 0)


def _rebuilt(url: Column, change) -> Column:
    before, query, behind = _query(url)
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    made = F.array_join(change(pairs), "&")
    return F.concat(before, F.when(made == "", F.lit("")).otherwise(F.concat(F.lit("?"), made)), behind)


def _is_token(pair: Column) -> Column:
    return F.lower(F.substring_index(pair, "=", 1)) == "token"


def redact_url(url: Column | str) -> Column:
    """An address with the value of its token parameter hidden (percent-encoded, as in a rebuilt query)."""
    return _rebuilt(as_column(url), lambda ps: F.transform(ps, lambda p: F.when(_is_token(p), F.concat(F.substring_index(p, "=", 1), F.lit("=%2A%2A%2A"))).otherwise(p)))


def authenticated_url(url: Column | str, token: str) -> Column:
    """An address whose token parameter is the given one, put last."""
    return _rebuilt(as_column(url), lambda ps: F.concat(F.filter(ps, lambda p: ~_is_token(p)), F.array(F.concat(F.lit("token="), F.url_encode(F.lit(token))))))


def trusted(url: Column | str, host: str, scheme: str = "https") -> Column:
    """Whether a token may be sent to an address: exactly this host, over http or https, and never from https down to http."""
    url = as_column(url)
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)", 1))
    how = F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    return F.coalesce((found == host.lower()) & (how.isin("http", "https") if scheme == "http" else how == "https"), F.lit(False))


def extension(name: Column | str) -> Column:
    """The last suffix of a file name with its dot, lower-cased; empty when there is none."""
    return F.lower(F.regexp_extract(as_column(name), r"[^./\\](\.[^./\\]+)$", 1))


# --- keys and templates -----------------------------------------------------------------------------


def subject_key(assignment: Column | str) -> Column:
    return F.concat(F.lit(SUBJECT), as_column(assignment).cast("string"))


def subject_id(key: Column | str) -> Column:
    """The assignment that a subject key names, else null."""
    key = as_column(key)
    return F.when(F.rlike(key, F.lit(f"^{SUBJECT}[0-9]+$")), F.substring(key, len(SUBJECT) + 1, 20).cast("bigint"))


def segments(template: str) -> list[tuple[bool, str]]:
    """A template's parts in order: (whether a placeholder, its text). Doubled braces stand for themselves."""
    parts: list[tuple[bool, str]] = []
    for literal, name, bad in re.findall(r"((?:[^{}]|\{\{|\}\})+)|\{(\w+)\}|([{}])", template):
        if bad:
            raise ValueError(f"not a valid template: {template!r}")
        parts.append((True, name) if name else (False, literal.replace("{{", "{").replace("}}", "}")))
    return parts


def render(template: str, context: Mapping[str, Column]) -> Column:
    """A template filled in one pass: values are put in as they are, braces and all."""
    made = [as_column(context[text]).cast("string") if slot else F.lit(text) for slot, text in segments(template)]
    return F.concat(*made) if made else F.lit("")
