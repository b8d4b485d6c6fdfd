"""http(s) address check and normal form, as columns.

Plain lower-case addresses are recognised by one pattern and returned as they
are (with a slash when the path is missing).  Only the others go through the
full split into authority, path, query and fragment.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
MAX_LENGTH = 2083
DEFAULT_PORT = {"http": "80", "https": "443"}
MESSAGE_NULL = "URL input should be a string or URL"
MESSAGE_LONG = "URL should have at most 2083 characters"
MESSAGE_EMPTY = "Input should be a valid URL, input is empty"
MESSAGE_RELATIVE = "Input should be a valid URL, relative URL without a base"
MESSAGE_SCHEME = "URL scheme should be 'http' or 'https'"
MESSAGE_HOST = "Input should be a valid URL, empty host"
MESSAGE_PORT = "Input should be a valid URL, invalid port number"
MESSAGE_DOMAIN = "Input should be a valid URL, invalid international domain name"
# characters written as %XX, per part of the address
ESCAPE_PATH = r"[\x00-\x20\"<>`{}\x7f]|[^\x00-\x7f]"
ESCAPE_QUERY = r"[\x00-\x20\"'<>\x7f]|[^\x00-\x7f]"
ESCAPE_FRAGMENT = r"[\x00-\x20\"<>`\x7f]|[^\x00-\x7f]"
BAD_HOST = r"[\x00-\x20#%/:<>?@\[\\\]^|\x7f]"
PLAIN = (
    r"^https?://(?:[a-z][a-z0-9-]*\.)*[a-z][a-z0-9-]*"
    r"(?:/(?:[A-Za-z0-9_~!$&()*+,;=:@-][A-Za-z0-9._~!$&()*+,;=:@-]*(?:/|\z))*)?"
    r"(?:\?[A-Za-z0-9._~!$&()*+,;=:@/?-]*)?(?:#[A-Za-z0-9._~!$&()*+,;=:@/?-]*)?\z"
)
# ----------------------------------------------------------------------------


def _escape(text: Column, unsafe: str) -> Column:
    """Percent-encode the UTF-8 bytes of every unsafe character."""
    def one(ch: Column) -> Column:
        return F.when(
            ch.rlike(unsafe), F.regexp_replace(F.hex(F.encode(ch, "UTF-8")), "(..)", "%$1")
        ).otherwise(ch)

    return F.when(
        text.rlike(unsafe), F.array_join(F.transform(F.split(text, ""), one), "")
    ).otherwise(text)


def _resolve_dots(path: Column) -> Column:
    """Drop ``.`` segments and let ``..`` remove the segment before it."""
    dot, two = r"^(?:\.|%2[eE])\z", r"^(?:\.|%2[eE]){2}\z"
    parts = F.split(F.substring(path, 2, 1 << 20), "/")
    last = F.element_at(parts, -1)
    folded = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, seg: F.when(seg.rlike(dot), acc)
        .when(seg.rlike(two), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(seg))),
    )
    tail = F.when(last.rlike(dot) | last.rlike(two), F.array(F.lit(""))).otherwise(
        F.array().cast("array<string>")
    )
    resolved = F.concat(F.lit("/"), F.array_join(F.concat(folded, tail), "/"))
    return F.when(path.rlike(r"(?:^|/)(?:\.|%2[eE]){1,2}(?:/|\z)"), resolved).otherwise(path)


def _taken_apart(raw: Column) -> Column:
    """Struct of normal form and failure message, by the full split."""
    text = F.regexp_replace(
        F.regexp_replace(raw, r"^[\x00-\x20]+|[\x00-\x20]+\z", ""), r"[\t\n\r]", ""
    )
    scheme = F.lower(F.regexp_extract(text, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    rest = F.regexp_replace(text, r"^[A-Za-z][A-Za-z0-9+.-]*:[/\\]*", "")
    authority = F.regexp_extract(rest, r"^([^/\\?#]*)", 1)
    user = F.regexp_extract(authority, r"^(.*)@", 1)
    host_port = F.regexp_extract(authority, r"([^@]*)\z", 1)
    host = F.lower(F.regexp_extract(host_port, r"^(\[[^\]]*\]|[^:]*)", 1))
    port_text = F.regexp_extract(host_port, r"^(?:\[[^\]]*\]|[^:\[]*):(.*)\z", 1)
    port = F.regexp_replace(port_text, r"^0+(?=\d)", "")
    ascii_host = F.when(
        host.rlike(r"[^\x00-\x7f]"),
        F.call_function("try_reflect", F.lit("java.net.IDN"), F.lit("toASCII"), host),
    ).otherwise(host)
    tail = F.regexp_replace(F.regexp_extract(rest, r"^[^/\\?#]*([^?#]*)", 1), r"\\", "/")
    path = F.when(tail == "", F.lit("/")).otherwise(_resolve_dots(_escape(tail, ESCAPE_PATH)))
    query = F.regexp_extract(rest, r"^[^?#]*(\?[^#]*)", 1)
    fragment = F.regexp_extract(rest, r"^[^#]*(#.*)", 1)
    default_port = F.when(scheme == "http", F.lit("80")).otherwise(F.lit("443"))

    normal = F.concat(
        scheme, F.lit("://"),
        F.when(user == "", F.lit("")).otherwise(F.concat(user, F.lit("@"))),
        ascii_host,
        F.when((port == "") | (port == default_port), F.lit("")).otherwise(F.concat(F.lit(":"), port)),
        path, _escape(query, ESCAPE_QUERY), _escape(fragment, ESCAPE_FRAGMENT),
    )
    bad_port = (port != "") & (~port.rlike(r"^\d{1,5}\z") | (port.cast("int") > 65535))
    bad_host = ascii_host.isNull() | (
        ~ascii_host.startswith("[") & ascii_host.rlike(BAD_HOST)
    )
    error = (
        F.when(text == "", MESSAGE_EMPTY)
        .when(scheme == "", MESSAGE_RELATIVE)
        .when(~scheme.isin("http", "https"), MESSAGE_SCHEME)
        .when(host == "", MESSAGE_HOST)
        .when(bad_host, MESSAGE_DOMAIN)
        .when(bad_port, MESSAGE_PORT)
    )
    return F.struct(normal.alias("value"), error.alias("error"))


def http_url(raw: Column) -> tuple[Column, Column]:
    """(normal form, failure message); exactly one of the two is null.

    The full split sits in a lambda over a one-element array: Spark evaluates
    lambdas outside the generated code, which keeps the method every row runs
    through small enough to be compiled.
    """
    plain = raw.rlike(PLAIN) & (F.length(raw) <= MAX_LENGTH)
    no_path = raw.rlike(r"^https?://[^/?#]*(?:\z|[?#])")
    plain_value = F.when(
        no_path, F.regexp_replace(raw, r"^(https?://[^/?#]*)", "$1/")
    ).otherwise(raw)
    parts = F.transform(F.array(raw), _taken_apart)[0]
    usable = raw.isNotNull() & (F.length(raw) <= MAX_LENGTH)
    value = F.when(plain, plain_value).when(usable & parts["error"].isNull(), parts["value"])
    error = (
        F.when(plain, F.lit(None).cast("string"))
        .when(raw.isNull(), MESSAGE_NULL)
        .when(F.length(raw) > MAX_LENGTH, MESSAGE_LONG)
        .otherwise(parts["error"])
    )
    return value, error
