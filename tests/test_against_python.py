"""Random texts through the native expressions and through plain Python statements of the same rules."""

import html
import random
import re
import unicodedata
from datetime import datetime
from urllib.parse import parse_qs, parse_qsl, quote, urlencode, urlsplit, urlunsplit

from pyspark.sql import functions as F

from pagegrain.functions import text, urls, values

N = 3000


def texts(seed, pieces, longest, n=N):
    rng = random.Random(seed)
    return ["".join(rng.choices(pieces, k=rng.randint(0, longest))) for _ in range(n)]


def same(column, fn, expected, inputs):
    got = column(fn, inputs)
    wrong = [(i, g, e) for i, g, e in zip(inputs, got, map(expected, inputs)) if g != e]
    assert not wrong, (len(wrong), wrong[:5])


def number(text):
    try:
        return float(text)
    except ValueError:
        return None


def test_prices(column):
    def price(value):
        kept = "".join(c for c in value if c in "0123456789.,")
        comma, dot = kept.rfind(","), kept.rfind(".")
        if comma > dot and (dot >= 0 or len(kept) - comma <= 3):
            return number(kept.replace(".", "").replace(",", "."))
        return number(kept.replace(",", ""))

    same(column, values.parse_price, price, texts(1, list("0123456789.,,..  $€-aE"), 9))


def test_ratings(column):
    def rating(value):
        found = re.search("[0-9.]+", value)
        got = number(found[0]) if found else None
        low = value.lower()
        for top, share in (("5", 1), ("10", 2), ("100", 20)):
            if f"out of {top}" in low or f"/{top}" in value or low.endswith(top) or (top == "100" and "%" in value):
                return got if got is None else got / share
        return got

    pieces = ["5", "10", "100", "/", "%", " out of ", "Out Of ", "4.5", ".", "8", " ", "x", "0"]
    same(column, values.parse_rating, rating, texts(2, pieces, 5))


def test_dates(column):
    formats = (
        "%Y-%m-%d|%d/%m/%Y|%m/%d/%Y|%Y/%m/%d|%d-%m-%Y|%m-%d-%Y|%b %d, %Y|%B %d, %Y|%d %b %Y|%d %B %Y|"
        "%Y-%m-%d %H:%M:%S|%Y-%m-%dT%H:%M:%S|%Y-%m-%dT%H:%M:%S.%f|%Y-%m-%dT%H:%M:%S.%fZ"
    ).split("|")

    def iso(value):
        value = value.strip()
        for fmt in formats:
            try:
                return datetime.strptime(value, fmt).isoformat()
            except ValueError:
                pass
        first = re.search(r"([0-9]{4})[-/]([0-9]{1,2})[-/]([0-9]{1,2})", value)
        late = re.search(r"([0-9]{1,2})[-/]([0-9]{1,2})[-/]([0-9]{4})", value)
        try:
            if first:
                return datetime(*map(int, first.groups())).isoformat()
            if late:
                return datetime(*[int(late[n]) for n in (3, 2, 1)]).isoformat()
        except ValueError:
            pass
        return value

    rng = random.Random(3)
    made = []
    for _ in range(N):
        year = rng.choice(["2024", "1999", "0001", "0000", "24", "20245"])
        day = rng.choice(["1", "05", " 7", "29", "31", "32", "0", "12"])
        month = rng.choice(["1", "02", "12", "13", " 3", "00", "6"])
        name = rng.choice(["Jan", "feb", "MARCH", "Sept", "sep", "May", "December", "Junes"])
        gap = rng.choice(["-", "/", "/", "-", " ", "."])
        clock = rng.choice(["", " 10:30:00", "T1:2:3", "t23:59:59.5", "T10:00:00.123456Z", "T10:00:00Z", " 24:00:00", "T10:00:60", "T10:00:00.", "T9:9:9.000"])
        made.append(rng.choice([
            f"{year}{gap}{month}{gap}{day}", f"{day}{gap}{month}{gap}{year}", f"{month}{gap}{day}{gap}{year}",
            f"{name} {day}, {year}", f"{name}  {day},\t{year}", f"{day} {name} {year}", f"on {year}{gap}{month}{gap}{day}!",
            f"{year}-{month}-{day}{clock}", f" {day}{gap}{month}-{year} {year}/1/2",
        ]))
    same(column, values.parse_date, iso, made)


def test_whitespace_and_prose(column):
    spaces = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    pieces = [*spaces, *"abcé", " ", "​", "᠎", "﻿"]
    same(column, text.strip, str.strip, texts(4, pieces, 6))
    same(column, text.collapse, lambda v: re.sub(r"\s+", " ", v).strip(), texts(5, pieces, 8))

    entities = [("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")]

    def prose(value):
        value = " ".join(value.split())
        for name, char in entities:
            value = value.replace(name, char)
        return re.sub("<[^>]+>", "", value)

    pieces = ["&amp;", "lt;", "&lt;", "&gt;", "<b>", "<", ">", "&nbsp;", "&quot;", "&apos;", " ", "\n", "x", "&", "é"]
    same(column, text.normalise_text, prose, texts(6, pieces, 9))


def test_clean_strings(column):
    def clean(value):
        value = re.sub("<[^>]+>", "", html.unescape(value))
        return " ".join(unicodedata.normalize("NFKC", value).split())

    pieces = ["&eacute;", "&#65;", "&#x3c;", "&lt", "&copy", "ﬁ", "①", "＜", "Å", "<i>", "<", ">", " ", "\xa0", "&nbsp;", "a", "&", ";"]
    same(column, text.clean_string, clean, texts(7, pieces, 8))
    foreign = [*"aéßŒłΩжйかガ가漢–“€", "e\u0301", "\u304b\u3099", "ﬀ", "½", " ", "<b>", "\U0001d400", "\u1100\u1161"]
    same(column, text.clean_string, clean, texts(16, foreign, 5))
    bare = lambda value: " ".join(html.unescape(re.sub("<[^>]+>", "", value)).split())
    same(column, text.clean_html, bare, texts(8, pieces, 8))


def test_title_case(column):
    small = {"a", "an", "the", "and", "but", "or", "for", "nor", "on", "at", "to", "from", "by", "of", "in", "with", "as"}

    def title(value):
        words = value.split()
        done = []
        for at, word in enumerate(words):
            inside = 0 < at < len(words) - 1
            if inside and word.lower() in small and not word.isupper():
                done.append(word.lower())
            elif inside and word.isupper() and len(word) <= 5:
                done.append(word)
            else:
                done.append(word.capitalize())
        return " ".join(done)

    pieces = ["the ", "THE ", "Of ", "uSA ", "NASA ", "ABCDEF ", "x", "Y", "12 ", "A1 ", "é", "É ", " ", "a", "-b", "'S "]
    same(column, text.title_case, title, texts(9, pieces, 7))


def links(seed):
    return texts(seed, ["http://", "https:", "//", "a.com", ":80", "/", "p", "?", "&", "=", "k", "v", "+", "%20", "%", "%2", "%26", "%3D", "#", "é", ";", " ", "~", "*", "FTP:"], 9)


def test_sanitise(column):
    def sanitised(link):
        parts = urlsplit(link)
        grouped = parse_qs(parts.query, keep_blank_values=True)
        query = "&".join(
            f"{quote(key, safe='')}={quote(v.replace('&', '%26') if '&' in v and '=' in v else v, safe='')}"
            for key, found in grouped.items() for v in found
        )
        # The path parameters are split off and put back, which loses a lone ";".
        path = re.sub(r"^((?:.*/)?[^;/]*);$", r"\1", parts.path)
        return urlunsplit(parts._replace(path=path, query=query))

    same(column, urls.sanitise_url, sanitised, [x for x in links(10) if no_odd_scheme(x)])


def no_odd_scheme(link):
    """Skip schemes whose path parameters are not split, and hosts the library refuses."""
    return urlsplit(link).scheme in ("", "http", "https", "ftp")


def test_append(column):
    def appended(link):
        parts = urlsplit(link)
        grouped = parse_qs(parts.query)
        grouped["k"] = ["a b"]
        path = re.sub(r"^((?:.*/)?[^;/]*);$", r"\1", parts.path)
        return urlunsplit(parts._replace(path=path, query=urlencode(grouped, doseq=True)))

    chosen = [x for x in links(11) if no_odd_scheme(x)]
    same(column, lambda v: urls.append_param(v, F.lit("k"), F.lit("a b")), appended, chosen)


def test_parts(column):
    chosen = links(12)
    same(column, urls.domain, lambda v: urlsplit(v).netloc, chosen)
    same(column, urls.base_url, lambda v: f"{urlsplit(v).scheme}://{urlsplit(v).netloc}", chosen)
    same(column, urls.is_url, lambda v: bool(urlsplit(v).scheme and urlsplit(v).netloc), chosen)
    same(column, urls.split_domain, lambda v: v.split("//")[-1].split("/")[0], chosen)
    pairs = [dict(parse_qsl(urlsplit(x).query, keep_blank_values=True)) for x in chosen]
    last = lambda v: F.aggregate(urls.parse_query(urls.query_string(v)), F.lit(0), lambda n, p: n + 1)
    assert column(last, chosen) == [len(p) for p in pairs]


def test_file_names(column):
    import os.path

    def name(value):
        value = re.sub(r'[\\/*?:"<>|]', "_", value).strip(". ")
        if len(value) > 255:
            stem, extension = os.path.splitext(value)
            value = stem[:250] + extension
        return value or "unnamed_file"

    pieces = ["a", ".", "..", " ", "b/c", ":", "?", "x" * 130, "y" * 90, ".txt", "\n"]
    same(column, text.safe_file_name, name, texts(13, pieces, 6))
    same(column, text.safe_id, lambda v: "".join(c if c.isalnum() else "_" for c in v), texts(14, list("aé_-/1٣ß中 \n"), 6))
