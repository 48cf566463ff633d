from datetime import datetime
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from pagegrain.functions import text, urls, values


def test_price(column):
    cases = {
        "$1,299.99": 1299.99, "1.299,99 €": 1299.99, "12,50": 12.5, "1,234": 1234.0,
        "1.234": 1.234, "1.234,567.89": None, "1,234,567": 1234567.0, "1,234,56": None,
        "-5.00": 5.0, "Free": None, "": None, ",": None, "$10 - $20": 1020.0, "approx. 5": 0.5,
        "5.": 5.0, "1,2345.6": 12345.6, "1.2,3": 12.3, "1.234.567,8": 1234567.8, "1,": 1.0,
    }
    assert column(values.parse_price, list(cases)) == list(cases.values())


def test_rating(column):
    cases = {
        "4.5 out of 5 stars": 4.5, "8/10": 4.0, "8 out of 10": 4.0, "95%": 4.75, "45/50": 45.0,
        "7": 7.0, "80/100": 40.0, "80 out of 100": 40.0, "80 of 100": 4.0, "85": 85.0, "10": 5.0,
        "N/A": None, "1.2.3": None, "OUT OF 10: 6": 5.0,
    }
    assert column(values.parse_rating, list(cases)) == list(cases.values())


DATES = {
    "2024-01-05": "2024-01-05T00:00:00",
    "2024/1/5": "2024-01-05T00:00:00",
    "jan 5, 2024": "2024-01-05T00:00:00",
    "03/04/2024": "2024-04-03T00:00:00",
    "12/25/2024": "2024-12-25T00:00:00",
    "25-12-2024": "2024-12-25T00:00:00",
    "12-25-2024": "2024-12-25T00:00:00",
    "2024-01-05 10:30:00": "2024-01-05T10:30:00",
    "2024-01-05   1:3:7": "2024-01-05T01:03:07",
    "2024-01-05T10:30:00": "2024-01-05T10:30:00",
    "2024-01-05T10:30:00.5Z": "2024-01-05T10:30:00.500000",
    "2024-01-05T10:30:00.000": "2024-01-05T10:30:00",
    "2024-01-05T10:30:00Z": "2024-01-05T00:00:00",
    "2024-01-05 10:30": "2024-01-05T00:00:00",
    "posted 2024-01-05 ok": "2024-01-05T00:00:00",
    "31/12/2024 10:00": "2024-12-31T00:00:00",
    "5 September 2024": "2024-09-05T00:00:00",
    "5 may 2024": "2024-05-05T00:00:00",
    "MAY 31, 2024": "2024-05-31T00:00:00",
    "29 Feb 2024": "2024-02-29T00:00:00",
    "29 Feb 2023": "29 Feb 2023",
    "12/31/2024 10:00": "12/31/2024 10:00",
    "2024-13-45": "2024-13-45",
    "2024-13-45 or 05/01/2024": "2024-13-45 or 05/01/2024",
    "Sept 5, 2024": "Sept 5, 2024",
    "yesterday": "yesterday",
    "  2024-01- 5 ": "2024-01-05T00:00:00",
    "0000-01-05": "0000-01-05",
    "": "",
}


def test_date(column):
    assert column(values.parse_date, list(DATES)) == list(DATES.values())


FORMATS = [
    "%Y-%m-%d", "%d/%m/%Y", "%m/%d/%Y", "%Y/%m/%d", "%d-%m-%Y", "%m-%d-%Y", "%b %d, %Y", "%B %d, %Y",
    "%d %b %Y", "%d %B %Y", "%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%dT%H:%M:%S.%f",
    "%Y-%m-%dT%H:%M:%S.%fZ",
]


def test_every_date_format(column):
    moments = [datetime(2024, 2, 29, 23, 5, 9, 120), datetime(1999, 12, 1), datetime(2001, 7, 13, 0, 0, 1)]
    texts, expected = [], []
    for moment in moments:
        for fmt in FORMATS:
            written = moment.strftime(fmt)
            texts.append(written)
            # The first format that reads the text decides, so day comes before month.
            for candidate in FORMATS:
                try:
                    expected.append(datetime.strptime(written, candidate).isoformat())
                    break
                except ValueError:
                    pass
    assert column(values.parse_date, texts) == expected


def test_links(column):
    cases = {"/p/1": "https:///p/1", " a.com ": "https://a.com", "http://a": "http://a", "": "",
             "HTTP://a": "https://HTTP://a"}
    assert column(values.with_scheme, list(cases)) == list(cases.values())
    assert column(lambda v: values.escape_spaces(values.with_scheme(v)), ["a.com/b c"]) == ["https://a.com/b%20c"]


def test_rounding_times_and_hashes(column):
    amounts = [0.125, 0.135, 2.0, 2.675, 1.225, 1.275, 0.375, 1234567.895, -0.005, 0.0]
    assert column(values.round_cents, amounts, "v double") == [round(x, 2) for x in amounts]
    assert column(values.two_decimals, amounts, "v double") == [f"{x:.2f}" for x in amounts]
    assert column(values.format_elapsed, [0.5, 59.999, 60.0, 3599.0, 7200.0], "v double") == [
        "0.50 seconds", "60.00 seconds", "1.00 minutes", "59.98 minutes", "2.00 hours"]
    assert column(values.format_epoch, [0.0, 86399.9], "v double") == ["1970-01-01 00:00:00", "1970-01-01 23:59:59"]
    assert column(lambda v: values.format_epoch(v, "%d.%m.%y at %H'%M"), [0.0], "v double") == ["01.01.70 at 00'00"]
    with pytest.raises(ValueError):
        values.format_epoch(F.lit(0.0), "%Q")
    digest = md5(b"http://a_b").hexdigest()
    assert column(values.task_id, [("http://a", "b")], "u string, d string") == [digest]


def test_text(column):
    assert column(text.normalise_text, ["  a&nbsp;&amp;lt;b&gt;c  "]) == ["a c"]
    assert column(text.clean_string, ["&amp;lt;b&gt; x", "ﬁ①", "<b>plain</b>  x", " a\x1cb", None, "＜b＞"]) == [
        "&lt;b> x", "fi1", "plain x", "a b", None, "<b>"]
    assert column(text.clean_html, ["<i>x</i> &lt;b&gt;", "<p>no entity</p>", None]) == ["x <b>", "no entity", None]
    assert column(text.title_case, ["the LORD of THE rings", "iPhone USA", "", "  ", "a USA OF a", "on", "x AN y NASAXX z"]) == [
        "The LORD of THE Rings", "Iphone Usa", "", "", "A USA OF A", "On", "X AN Y Nasaxx Z"]
    assert column(text.strip, ["  a \x85\x1f"]) == ["a"]


def test_names(column):
    assert column(text.safe_id, ["a-b/é1_x"]) == ["a_b_é1_x"]
    long = "x" * 300 + ".tar.gz"
    assert column(text.safe_file_name, ['a/b:c?.txt', " .a. ", "...", long, "." + "y" * 300]) == [
        "a_b_c_.txt", "a", "unnamed_file", "x" * 250 + ".gz", "y" * 250]
    assert column(text.truncate, ["a" * 101, "a" * 100]) == ["a" * 97 + "...", "a" * 100]
    assert column(lambda v: text.truncate(v, 2), ["abcd"]) == ["abc..."]


SANITISED = {
    "http://a.com/p?a=1&b=&a=3&flag": "http://a.com/p?a=1&a=3&b=&flag=",
    "http://a.com/p?q=a%26b%3Dc": "http://a.com/p?q=a%2526b%3Dc",
    "http://a.com/p": "http://a.com/p",
    "HTTP://A.com:80/p;x?#f": "http://A.com:80/p;x#f",
    "http://a.com?x=a+b%20c~*&%zz=1&&=2": "http://a.com?x=a%20b%20c~%2A&%25zz=1&=2",
    "http://a.com/p?x=é/y": "http://a.com/p?x=%C3%A9%2Fy",
    "//host/p": "//host/p",
    "mailto:x@y": "mailto:x@y",
    "/p?x=%FF": "/p?x=%EF%BF%BD",
    " http://a.com/\tp": "http://a.com/p",
}


def test_sanitise(column):
    assert column(urls.sanitise_url, list(SANITISED)) == list(SANITISED.values())


def test_query_functions_agree_with_the_standard_library(column):
    from urllib.parse import parse_qs, quote, urlencode, urljoin, urlparse, urlunparse

    links = [
        "http://a.com/p?a=1&b=&a=3&flag", "https://u:p@a.com:8080/x/y;z?page=2&x=&k=v w#frag", "a/b?c=d+e%21",
        "http://a.com", "http://a.com/?page=07", "ftp://f/x?q=%E4%BD%A0&q=2", "http://a.com/p?x=a;b",
    ]

    def appended(link):
        parts = urlparse(link)
        params = parse_qs(parts.query)
        params["page"] = ["n&x"]
        return urlunparse(parts._replace(query=urlencode(params, doseq=True)))

    assert column(lambda v: urls.append_param(v, F.lit("page"), F.lit("n&x")), links) == [appended(x) for x in links]
    assert column(lambda v: urls.encode(v), links) == [quote(x, safe="") for x in links]
    assert column(urls.domain, links) == [urlparse(x).netloc for x in links]
    assert column(urls.base_url, links) == [f"{urlparse(x).scheme}://{urlparse(x).netloc}" for x in links]
    assert column(urls.is_url, links) == [bool(urlparse(x).scheme and urlparse(x).netloc) for x in links]

    bases = ["http://a.com/x", "http://a.com", "http://a.com/x/y?q=1", "http://a.com/x/./z/", "a/b"]
    rels = ["y", "../y", "../../../y", "./y/.", "..", "", "?z=1", "#f", "y//z/", "//h/p", "mailto:a", "httpx", ".", "y/../z?q#f", "y;p"]
    pairs = [(base, rel) for base in bases for rel in rels]

    def joined(base, rel):
        if rel.startswith("http"):
            return rel
        return urljoin(base if base.endswith("/") else base + "/", rel[1:] if rel.startswith("/") else rel)

    got = column(urls.join_url, pairs, "b string, r string")
    assert dict(zip(pairs, got)) == {pair: joined(*pair) for pair in pairs}


def test_hosts(column):
    assert column(urls.bare_domain, ["http://www.a.com/x", "http://a.www.com"]) == ["a.com", "a.www.com"]
    assert column(urls.split_domain, ["http://a.com/x", "a.com?q", "http://a//b/c"]) == ["a.com", "a.com?q", "b"]
    assert column(urls.is_url, ["x", None]) == [False, False]


def test_next_page(column):
    link = lambda cur, raw: urls.next_by_link(cur, raw)
    pairs = [("http://a.com/p/q", "?page=2"), ("http://a.com/p/q", "/r"), ("http://a.com", "r"),
             ("http://a.com/p//q", "r"), ("http://a.com/p", "http:x"), ("http://a.com/p", ""), ("http://a.com/p", None)]
    assert column(link, pairs, "c string, r string") == [
        "http://a.com/p/?page=2", "http://a.com/r", "http://a.com/r", "http://a.com/p/r", "http:x", None, None]
    button = [("http://a.com/p/q", "location.href = '/r'"), ("http://a.com/p/q", 'window.location.href="r"; x()'),
              ("http://a.com/p//q", "location.href='r'"), ("http://a.com/p", "go()"), ("http://a.com/p", None)]
    assert column(urls.next_by_button, button, "c string, r string") == [
        "http://a.com/r", "http://a.com/p/r", "http://a.com/p//r", None, None]
    step = lambda c: urls.next_by_parameter(c, F.lit(True), F.lit("page"))
    assert column(step, ["http://a.com/p?page=2&x=&k=v", "http://a.com/p", "http://a.com/p?page=x", "http://a.com/p?page="]) == [
        "http://a.com/p?page=3&k=v", "http://a.com/p?page=2", None, "http://a.com/p?page=2"]


def test_shown_as_python_prints(column):
    from pyspark.sql import types as T

    from pagegrain.functions.shown import as_text

    amounts = [0.1, 1.0, 1e7, 12345678.9, 123456789012345.6, 0.00025, 0.001, -1e7, 9999999.5, 100.0]
    assert column(lambda v: as_text(v, T.DoubleType()), amounts, "v double") == [str(x) for x in amounts]
    lists = [["a'b", 'c"d', "e'\"f", "tab\t\\", None], []]
    assert column(lambda v: as_text(v, T.ArrayType(T.StringType())), lists, "v array<string>") == [str(x) for x in lists]
