"""URL functions: split, rebuild, sanitise, join and next-page addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagegrain.functions.binding import bind

# scheme, host part, path, query, fragment; matches every text
_URL = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?\z"
_MARK = "\x00"
_LEADING_NOISE = "".join(chr(code) for code in range(33))


def _cut(url: Column) -> Column:
    """The five parts of a URL as an array; an absent part is the empty string."""
    clean = F.regexp_replace(F.ltrim(url, F.lit(_LEADING_NOISE)), r"[\t\r\n\x00]", "")
    return F.split(F.regexp_replace(clean, _URL, _MARK.join(f"${n}" for n in range(1, 6))), _MARK)


class SplitUrl:
    """Named parts of a cut URL."""

    def __init__(self, parts: Column):
        self.scheme = F.lower(parts[0])
        self.netloc, self.path, self.query, self.fragment = (parts[n] for n in range(1, 5))

    def base(self) -> Column:
        return F.concat(self.scheme, F.lit("://"), self.netloc)

    def rebuild(self, query: Column) -> Column:
        return build_url(self.scheme, self.netloc, self.path, query, self.fragment)


def with_parts(url: Column, then) -> Column:
    """``then(SplitUrl)`` with the URL cut once."""
    return bind(_cut(url), lambda parts: then(SplitUrl(parts)))


def query_string(url: Column) -> Column:
    return SplitUrl(_cut(url)).query


def build_url(scheme: Column, netloc: Column, path: Column, query: Column, fragment: Column) -> Column:
    # A lone ";" at the end of the last segment holds no parameters and is dropped.
    path = F.regexp_replace(path, r"^((?:.*/)?[^;/]*);\z", "$1")
    rooted = F.concat(F.when((path == "") | path.startswith("/"), F.lit("")).otherwise(F.lit("/")), path)
    web = scheme.isin("http", "https", "ftp", "file", "ws", "wss")
    bare = ((path == "") | path.startswith("/")) & (web | path.startswith("//"))
    return F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(F.lit("")),
        F.when((netloc != "") | bare, F.concat(F.lit("//"), netloc, rooted)).otherwise(path),
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")),
        F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(F.lit("")),
    )


# -- query strings ---------------------------------------------------------------


def decode(text: Column) -> Column:
    """``+`` to space and percent escapes to characters; a stray ``%`` stays."""
    return F.try_url_decode(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"))


def encode(text: Column) -> Column:
    """Percent-encode everything but letters, digits and ``_.-~``."""
    return F.replace(encode_form(text), F.lit("+"), F.lit("%20"))


def encode_form(text: Column) -> Column:
    """As ``encode``, with ``+`` for a space."""
    starred = F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A"))
    return F.replace(starred, F.lit("%7E"), F.lit("~"))


def parse_query(query: Column, keep_blank: bool = True) -> Column:
    """``array<struct<key, values>>``, keys in the order first seen."""

    def pair(part: Column) -> Column:
        at = F.instr(part, "=")
        value = F.when(at > 0, F.substr(part, at + 1)).otherwise(F.lit(""))
        return F.struct(
            decode(F.substring_index(part, "=", 1)).alias("key"), decode(value).alias("value")
        )

    parts = F.filter(F.split(query, "&"), lambda part: part != "")
    pairs = F.transform(parts, pair)
    if not keep_blank:
        pairs = F.filter(pairs, lambda p: p["value"] != "")

    def grouped(pairs: Column) -> Column:
        keys = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
        return F.transform(
            keys,
            lambda key: F.struct(
                key.alias("key"),
                F.transform(
                    F.filter(pairs, lambda p: p["key"] == key), lambda p: p["value"]
                ).alias("values"),
            ),
        )

    return bind(pairs, grouped)


def escape_nested(params: Column) -> Column:
    """A decoded value holding both ``&`` and ``=`` gets its ``&`` escaped once more."""

    def value(text: Column) -> Column:
        nested = text.contains("&") & text.contains("=")
        return F.when(nested, F.replace(text, F.lit("&"), F.lit("%26"))).otherwise(text)

    return F.transform(
        params,
        lambda p: F.struct(p["key"].alias("key"), F.transform(p["values"], value).alias("values")),
    )


def query_params(query: Column) -> Column:
    """Parameters of a query string, blank ones kept, nested separators escaped."""
    return escape_nested(parse_query(query))


def build_query(params: Column, encoder=encode) -> Column:
    pieces = F.transform(
        params,
        lambda p: F.transform(
            p["values"], lambda v: F.concat(encoder(p["key"]), F.lit("="), encoder(v))
        ),
    )
    return F.array_join(F.flatten(pieces), "&")


def sanitise_url(url: Column) -> Column:
    """Rebuild a URL with its query string decoded and encoded afresh."""
    return with_parts(url, lambda parts: parts.rebuild(build_query(query_params(parts.query))))


def append_param(url: Column, name: Column, value: Column) -> Column:
    """Set one query parameter; blank parameters fall away, the rest is form-encoded."""

    def replaced(params: Column) -> Column:
        fresh = F.struct(name.alias("key"), F.array(value).alias("values"))
        swapped = F.transform(params, lambda p: F.when(p["key"] == name, fresh).otherwise(p))
        known = F.exists(params, lambda p: p["key"] == name)
        return F.when(known, swapped).otherwise(F.concat(params, F.array(fresh)))

    def rebuilt(parts: SplitUrl) -> Column:
        params = bind(parse_query(parts.query, keep_blank=False), replaced)
        return parts.rebuild(build_query(params, encode_form))

    return with_parts(url, rebuilt)


# -- hosts -----------------------------------------------------------------------


def base_url(url: Column) -> Column:
    return with_parts(url, SplitUrl.base)


def domain(url: Column) -> Column:
    """Host part with port and user information, as written."""
    return SplitUrl(_cut(url)).netloc


def bare_domain(url: Column) -> Column:
    return F.regexp_replace(domain(url), r"^www\.", "")


def is_url(text: Column) -> Column:
    parts = _cut(text)
    return F.coalesce((parts[0] != "") & (parts[1] != ""), F.lit(False))


def split_domain(url: Column) -> Column:
    """Text behind the last ``//`` up to the next ``/``."""
    # Split from the left: the last "//" of "///" is not where it would be from the right.
    return F.substring_index(F.element_at(F.split(url, "//"), -1), "/", 1)


# -- joining -----------------------------------------------------------------------


def _resolve(path: Column) -> Column:
    """Remove ``.``, ``..`` and empty inner segments from a rooted path."""
    parts = F.split(path, "/")

    def cleaned(parts: Column) -> Column:
        count = F.size(parts)
        kept = F.filter(parts, lambda part, at: (part != "") | (at == 0) | (at == count - 1))
        walked = F.aggregate(
            kept,
            F.array().cast("array<string>"),
            lambda done, part: F.when(
                part == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
            )
            .when(part == ".", done)
            .otherwise(F.concat(done, F.array(part))),
        )
        tail = F.when(F.element_at(parts, -1).isin(".", ".."), F.array(F.lit("")))
        joined = F.array_join(F.concat(walked, F.coalesce(tail, F.array().cast("array<string>"))), "/")
        return F.when(joined == "", F.lit("/")).otherwise(joined)

    return bind(parts, cleaned)


def join_url(base: Column, relative: Column) -> Column:
    """Join below ``base``, which counts as a directory; ``/x`` is not root-relative."""
    folder = F.when(base.endswith("/"), base).otherwise(F.concat(base, F.lit("/")))
    rest = F.when(relative.startswith("/"), F.substr(relative, F.lit(2))).otherwise(relative)

    def joined(cut: Column) -> Column:
        b, r = SplitUrl(cut["base"]), SplitUrl(cut["rest"])
        root = F.regexp_replace(b.path, r"[^/]+\z", "")
        below = F.concat(F.when(root == "", F.lit("/")).otherwise(root), r.path)
        same_path = (r.netloc == "") & (r.path == "")
        path = (
            F.when(r.netloc != "", r.path)
            .when(same_path, b.path)
            .otherwise(_resolve(F.when(r.path.startswith("/"), r.path).otherwise(below)))
        )
        netloc = F.when(r.netloc != "", r.netloc).otherwise(b.netloc)
        query = F.when(same_path & (r.query == ""), b.query).otherwise(r.query)
        return (
            F.when(relative.startswith("http"), relative)
            .when(rest == "", folder)
            .when((r.scheme != "") & (r.scheme != b.scheme), rest)
            .otherwise(build_url(b.scheme, netloc, path, query, r.fragment))
        )

    return bind(F.struct(_cut(folder).alias("base"), _cut(rest).alias("rest")), joined)


# -- next-page addresses ---------------------------------------------------------------


def _absolute(current: Column, href: Column, keep_slash: bool) -> Column:
    """Root-relative, absolute or folder-relative link; no dot segments are resolved."""

    def resolved(bound: Column) -> Column:
        parts, href = SplitUrl(bound["parts"]), bound["href"]
        folder = F.regexp_replace(parts.path, r"/?[^/]*\z", "")
        slash = F.when(folder.endswith("/") & F.lit(keep_slash), F.lit("")).otherwise(F.lit("/"))
        inside = F.when(href.startswith("/"), F.lit("")).otherwise(F.concat(folder, slash))
        return F.when(href.startswith("http"), href).otherwise(F.concat(parts.base(), inside, href))

    return bind(F.struct(_cut(current).alias("parts"), href.alias("href")), resolved)


def next_by_link(current: Column, href: Column) -> Column:
    return F.when(href != "", _absolute(current, href, keep_slash=True))


def next_by_button(current: Column, onclick: Column) -> Column:
    pattern = r"""location\.href\s*=\s*['"](.*?)['"]"""
    href = F.regexp_extract(onclick, pattern, 1)
    return F.when(onclick.rlike(pattern), _absolute(current, href, keep_slash=False))


def next_by_parameter(current: Column, found: Column, name: Column) -> Column:
    """Count an integer query parameter up by one; ``found`` says the page has the element."""
    params = parse_query(query_string(current), keep_blank=False)
    mine = F.filter(params, lambda p: p["key"] == name)
    first = F.coalesce(F.get(F.get(mine, F.lit(0))["values"], F.lit(0)), F.lit("1"))
    number = first.try_cast("bigint")
    return F.when(found & number.isNotNull(), append_param(current, name, (number + 1).cast("string")))


def next_page(kind: Column | str, current: Column, raw: Column, name: Column) -> Column:
    """Next address by pagination kind; ``raw`` is the matched attribute, null if no match."""
    rules = {
        "link": lambda: next_by_link(current, raw),
        "button": lambda: next_by_button(current, raw),
        "parameter": lambda: next_by_parameter(current, raw.isNotNull(), name),
    }
    if isinstance(kind, str):
        return rules[kind]() if kind in rules else F.lit(None).cast("string")
    return F.coalesce(*[F.when(kind == rule, address()) for rule, address in rules.items()])
