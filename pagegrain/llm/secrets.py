"""Secret scan: fixed key formats, and tokens that a battery of randomness tests takes for generated keys.

Three formats give the base spans (``assign``, ``access``, ``hex``). Further tokens of 20 or more key
characters are tested per inferred encoding (hex, base32, lower-case with digits, base64): chi-squared
uniformity over the encoding's alphabet, a runs test and lag-one serial correlation. A token must pass
as random (Fisher's combination of the three p-values), and must be improbable as natural text. The
latter p-values go through the Benjamini-Hochberg rule within each length class over the whole corpus,
so that short tokens, on which the tests have little power, don't borrow from long ones. Only a bounded
histogram (length class by binned p-value) reaches the driver.

Defined results: a null or empty text has no spans; repeated rows are scanned each; a null id stays a
null id; an empty table gives an empty table. Offsets are code points, end exclusive. A method span
that touches a base span is left out, as the base span already covers the secret.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegrain.llm.common import buffers, record, spans_of

KINDS = ["assign", "access", "hex", "random"]
RATE = 0.01  # share of false discoveries that the rule aims at
RANDOM_P = 0.001  # a token less probable than this as random text is not taken for random
LEAST = 20
CLASSES = [20, 28, 40, 64, 128]  # least lengths of the length classes
BIN = 0.05  # width of a bin of -log10 p
BINS = 800
SCHEMA = "doc_id long, base array<struct<start:long,kind:int,end:long>>, tokens array<struct<start:long,end:long,class:int,bin:int>>"

# The formats.
ASSIGN = re.compile(rb"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ASSIGN_KEYS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
HEX = _class(DIGITS + LOWER[:6])
TOKEN = _class(UPPER + LOWER + DIGITS + "+/_-")
ENCODINGS = [("hex", DIGITS + LOWER[:6]), ("HEX", DIGITS + UPPER[:6]), ("base32", UPPER + "234567"), ("alnum", DIGITS + LOWER), ("base64", UPPER + LOWER + DIGITS + "+/"), ("base64url", UPPER + LOWER + DIGITS + "-_")]
# Letter shares differ little between languages for this purpose: the sum of squared letter shares of prose.
PROSE_MATCH = 0.066
PROSE_SWITCH = 0.1  # chance that the character class changes between neighbours in identifiers and paths


def _tail(z: float) -> float:
    """Upper tail of the standard normal."""
    return max(0.5 * math.erfc(z / math.sqrt(2)), 1e-300)


def _fisher(ps: list[float]) -> float:
    """Combined p-value: tail of chi-squared with 2k degrees of freedom, in closed form."""
    half = -sum(math.log(p) for p in ps)
    return max(math.exp(-half) * sum(half**i / math.factorial(i) for i in range(len(ps))), 1e-300)


def encoding_of(token: str) -> tuple[str, str] | None:
    """The smallest encoding that holds the token; none for plain numbers and mixed separators."""
    body = set(token.rstrip("="))
    if body <= set(DIGITS):
        return None
    return next(((name, alphabet) for name, alphabet in ENCODINGS if body <= set(alphabet)), None)


def battery(token: str) -> tuple[float, float] | None:
    """(p-value as random text, p-value as natural text) of a token, or None without an encoding."""
    found = encoding_of(token)
    if found is None:
        return None
    body = token.rstrip("=")
    n, alphabet = len(body), found[1]
    k = len(alphabet)
    x = np.array([alphabet.index(c) for c in body], float)
    counts = np.bincount(x.astype(int), minlength=k)
    chi = float(((counts - n / k) ** 2).sum() * k / n)
    # Uniform: mean k-1, variance 2(k-1)(n-1)/n; skew is met by the cube-root transform.
    free = k - 1
    spread = math.sqrt(2 / (9 * free) * (n - 1) / n)
    p_chi = _tail(((chi / free) ** (1 / 3) - (1 - 2 / (9 * free))) / spread)
    median = (k - 1) / 2
    above = x > median
    a, b = int(above.sum()), int(n - above.sum())
    runs = 1 + int((above[1:] != above[:-1]).sum())
    if a and b:
        mean = 1 + 2 * a * b / n
        var = max(2 * a * b * (2 * a * b - n) / (n * n * (n - 1)), 1e-9)
        p_runs = min(1.0, 2 * _tail(abs(runs - mean) / math.sqrt(var)))
    else:
        p_runs = min(1.0, 2.0 ** (1 - n))
    d = x - x.mean()
    total = float((d * d).sum())
    r = float((d[1:] * d[:-1]).sum()) / total if total else 1.0
    p_serial = min(1.0, 2 * _tail(abs(r + 1 / n) * math.sqrt(n)))
    as_random = _fisher([max(p, 1e-300) for p in (p_chi, p_runs, p_serial)])
    # As prose: repeated letters raise chi-squared, and character classes change seldom.
    extra = max(k * PROSE_MATCH - 1, 0.25)
    mean, var = free + (n - 1) * extra, 2 * free + 4 * (n - 1) * extra
    q_chi = _tail((mean - chi) / math.sqrt(var))
    kinds = [0 if c in DIGITS else 1 if c in LOWER else 2 if c in UPPER else 3 for c in body]
    switches = sum(u != v for u, v in zip(kinds, kinds[1:]))
    q_switch = _tail((switches - 0.5 - (n - 1) * PROSE_SWITCH) / math.sqrt((n - 1) * PROSE_SWITCH * (1 - PROSE_SWITCH)))
    return as_random, _fisher([q_chi, q_switch])


def _scan_text(raw: bytes, hexes: list[tuple[int, int]], tokens: list[tuple[int, int]]) -> tuple[list, list]:
    """Base spans and tested tokens of one text, in bytes."""
    base = [(s, 2, e) for s, e in hexes]
    low = raw.lower()
    if any(key in low for key in ASSIGN_KEYS):
        base += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(raw) if m.end(2) - m.start(2) >= 8]
    if b"AKIA" in raw:
        base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(raw) if m.end() - m.start() >= 16]
    base.sort()
    tested = []
    for s, e in tokens:
        end = e
        while end < min(e + 2, len(raw)) and raw[end] == 61:
            end += 1
        if any(b < end and s < f for b, _, f in base):
            continue
        result = battery(raw[s:end].decode())
        if result is not None:
            place = sum(e - s >= least for least in CLASSES) - 1
            bin_ = min(BINS - 1, int(-math.log10(result[1]) / BIN)) if result[0] >= RANDOM_P else 0
            tested.append((s, end, place, bin_))
    return base, tested


def _found(batch_texts: pa.Array) -> tuple[list, list]:
    data, offsets = buffers(batch_texts)
    hex_s, hex_e = spans_of(HEX[data], offsets)
    keep = hex_e - hex_s >= 32
    tok_s, tok_e = spans_of(TOKEN[data], offsets)
    long = tok_e - tok_s >= LEAST
    pieces = [(hex_s[keep], hex_e[keep]), (tok_s[long], tok_e[long])]
    cuts = [np.searchsorted(s, offsets) for s, _ in pieces]
    all_base, all_tested = [], []
    for i in range(len(batch_texts)):
        at, raw = int(offsets[i]), data[offsets[i] : offsets[i + 1]].tobytes()
        hexes, tokens = ([(int(a) - at, int(b) - at) for a, b in zip(s[c[i] : c[i + 1]], e[c[i] : c[i + 1]])] for (s, e), c in zip(pieces, cuts))
        base, tested = _scan_text(raw, hexes, tokens)
        if (base or tested) and not raw.isascii():  # bytes to code points
            points = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
            base = [(int(points[s]), k, int(points[e])) for s, k, e in base]
            tested = [(int(points[s]), int(points[e]), c, b) for s, e, c, b in tested]
        all_base.append([{"start": s, "kind": k, "end": e} for s, k, e in base])
        all_tested.append([{"start": s, "end": e, "class": c, "bin": b} for s, e, c, b in tested])
    return all_base, all_tested


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
    token = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("class", pa.int32()), ("bin", pa.int32())]))
    schema = pa.schema([("doc_id", pa.int64()), ("base", span), ("tokens", token)])
    for batch in batches:
        if batch.num_rows:
            base, tested = _found(batch.column(1))
            yield record(schema, batch.column(0).cast(pa.int64()), base, tested)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Base spans and tested tokens of every whole text; no shuffle."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(_scan, SCHEMA)


def limits(scanned: DataFrame, rate: float = RATE) -> list[int]:
    """For each length class the least bin that the Benjamini-Hochberg rule accepts over all tokens; BINS: none.

    At most ``len(CLASSES) * BINS`` counts reach the driver.
    """
    token = scanned.select(F.explode("tokens").alias("t"))
    counts = {(r["class"], r["bin"]): r["count"] for r in token.groupBy("t.class", "t.bin").count().collect()}
    out = []
    for c in range(len(CLASSES)):
        own = [counts.get((c, b), 0) for b in range(BINS)]
        tests, found, least = sum(own), 0, BINS
        for b in range(BINS - 1, 0, -1):
            found += own[b]
            if found and tests * 10 ** (-b * BIN) <= rate * found:
                least = b
        out.append(least)
    return out


def method_spans(least: list[int]) -> Column:
    """The tokens of a scanned row that the battery takes for random."""
    bounds = F.array(*[F.lit(b) for b in least])
    chosen = F.filter("tokens", lambda t: t["bin"] >= F.get(bounds, t["class"]))
    return F.transform(chosen, lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("kind"), t["end"].alias("end")))


def find_secrets(scanned: DataFrame, least: list[int]) -> DataFrame:
    """``doc_id, base, spans``: arrays of (start, kind number, end) in order of start and kind."""
    return scanned.select("doc_id", "base", F.array_sort(F.concat("base", method_spans(least))).alias("spans"))


def count_of(kind: int) -> Column:
    """Base spans of a kind. The filter's function takes the span alone: a second parameter would be its place."""
    return F.size(F.filter("base", lambda span: span["kind"] == kind)).cast("long")


def shown(spans: str) -> Column:
    """``kind:start:end``, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")


def redact(docs: DataFrame, text: str = "text", mark: str = "[secret]", rate: float = RATE) -> DataFrame:
    """All rows and columns, with every span of the text replaced by ``mark``; overlapping spans make one mark.

    The corpus is scanned once for the limits and once for the spans; texts are not shuffled.
    """
    least = limits(scan(docs.select(F.lit(0).alias("doc_id"), text), "doc_id", text), rate)

    @F.pandas_udf("string")
    def cleaned(texts):
        base, tested = _found(pa.Array.from_pandas(texts, type=pa.large_string()))
        out = []
        for value, spans, tokens in zip(texts, base, tested):
            if value is None:
                out.append(None)
                continue
            cut = sorted([(s["start"], s["end"]) for s in spans] + [(t["start"], t["end"]) for t in tokens if t["bin"] >= least[t["class"]]])
            parts, at, masked = [], 0, -1
            for s, e in cut:
                if s >= masked:
                    parts += [value[at:s], mark]
                at = masked = max(masked, e)
            out.append("".join(parts) + value[at:] if cut else value)
        return pd.Series(out, dtype=object)

    return docs.withColumn(text, cleaned(F.col(text)))
