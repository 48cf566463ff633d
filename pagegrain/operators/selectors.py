"""Selector rules and the per-page reader behind the extraction operators.

Small on purpose: one pass over the markup gives elements in document order,
each with the number of its last descendant, and a selector step is a pass over
sorted element numbers. Everything else is done by Spark.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from html import unescape
from html.parser import HTMLParser

from pagegrain import fixed_values as fixed

_SIMPLE = re.compile(
    r"(?P<tag>\*|[A-Za-z][\w-]*)|#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)"
    r"|\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[~^$*|]?=)\s*(?P<val>\"[^\"]*\"|'[^']*'|[\w-]+)\s*(?P<flag>[iIsS])?\s*)?\]"
    r"|:(?P<pseudo>[a-z-]+)(?P<open>\(\s*)?"
)
_COMBINATOR = re.compile(r"\s*([>+~])\s*|\s+")
_END = re.compile(r"\s*(?=[,)])|\s*\Z")
_NTH = re.compile(r"(?:(odd|even)|([+-]?\d*)n\s*(?:([+-])\s*(\d+))?|([+-]?\d+))\s*\)", re.IGNORECASE)
#: Counted places: whether from the end, and whether among elements of the same tag.
_COUNTED = {"child": (False, False), "last-child": (True, False), "of-type": (False, True), "last-of-type": (True, True)}


def compile_selector(text: str) -> list[list[tuple]]:
    """Groups of ``(combinator, tag, tests)`` steps; ValueError outside the grammar."""
    text = text.strip()
    groups, at = _list(text, 0)
    if at < len(text):
        raise _unsupported(text, at)
    return groups


def _unsupported(text: str, at: int) -> ValueError:
    return ValueError(f"unsupported selector {text!r} at position {at}")


def _list(text: str, at: int, relative: bool = False) -> tuple[list[list[tuple]], int]:
    """Groups from ``at`` up to the end or an unmatched ``)``; relative ones may begin with a combinator."""
    groups = []
    while True:
        steps, comb = [], " " if relative else ""
        gap = _COMBINATOR.match(text, at)
        if gap and (relative or not gap[1]):
            comb, at = gap[1] or comb, gap.end()
        while True:
            tag, tests, at = _compound(text, at)
            steps.append((comb, tag, tests))
            end = _END.match(text, at)
            if end:
                at = end.end()
                break
            gap = _COMBINATOR.match(text, at)
            if not gap:
                raise _unsupported(text, at)
            comb, at = gap[1] or " ", gap.end()
        groups.append(steps)
        if text[at : at + 1] != ",":
            return groups, at
        at += 1


def _compound(text: str, at: int) -> tuple[str | None, tuple, int]:
    tag, tests, begin = None, [], at
    while found := _SIMPLE.match(text, at):
        if found["tag"]:
            if tag or tests:
                break
            tag = found["tag"].lower()
        elif found["id"]:
            tests.append(("id", "=", found["id"]))
        elif found["cls"]:
            tests.append(("class", "~=", found["cls"]))
        elif found["attr"]:
            value, op = found["val"], found["op"] or "has"
            if value and value[0] in "\"'":
                value = value[1:-1]
            folded = (found["flag"] or "").lower() == "i"
            tests.append((found["attr"].lower(), op + "i" if folded else op, value.lower() if folded else value))
        else:
            more, at = _pseudo(text, found)
            tests += more
            continue
        at = found.end()
    if at == begin:
        raise _unsupported(text, at)
    return tag, tuple(tests), at


def _pseudo(text: str, found: re.Match) -> tuple[list[tuple], int]:
    name, at = found["pseudo"], found.end()
    edge, _, rest = name.partition("-")
    if not found["open"]:
        if name in ("empty", "root"):
            return [("", name, None)], at
        if edge in ("first", "last", "only") and rest in ("child", "of-type"):
            ends = {"first": (False,), "last": (True,), "only": (False, True)}[edge]
            return [("", "nth", (0, 1, end, rest == "of-type")) for end in ends], at
    elif edge == "nth" and rest in _COUNTED:
        nth = _NTH.match(text, at)
        if nth:
            word, step, sign, more, alone = nth.groups()
            if word:
                a, b = 2, int(word.lower() == "odd")
            elif alone:
                a, b = 0, int(alone)
            else:
                a, b = int(step + "1" if step in ("", "+", "-") else step), int((sign or "") + (more or "0"))
            return [("", "nth", (a, b, *_COUNTED[rest]))], nth.end()
    elif name in ("not", "is", "where", "has"):
        groups, end = _list(text, at, name == "has")
        if text[end : end + 1] == ")":
            return [("", "is" if name == "where" else name, groups)], end + 1
    raise _unsupported(text, found.start())


class PageReader(HTMLParser):
    """Elements of one page in document order; element 0 is the document itself.

    Unclosed tags nest, void elements never do.
    """

    def __init__(self, markup: str, keep_markup: bool = True):
        super().__init__(convert_charrefs=True)
        self.tag, self.attrs, self.parent, self.prev, self.place = [], [], [], [], []
        self.last, self.last_kid, self.kid_count, self.only_kid = [], [], [], []
        self.text_span, self.markup_span, self.by_tag = [], [], {}
        self.pieces, self.parts, self.own_text = [], [], {}
        self._open, self._open_tags, self._hidden, self._kept_space = [], {}, 0, 0
        self._void_done, self._data, self._keep_markup = {}, [], keep_markup
        self._known, self._places = {}, None
        self._start("", [])
        # Behind the last ">" no tag can end. Left to the parser, that part would be
        # searched again from every "<" in it.
        end = markup.rfind(">") + 1
        self.feed(markup[:end])
        self.close()
        self._data.append(markup[end:] if self.cdata_elem else unescape(markup[end:]))
        while self._open:
            self._pop()

    # -- building
    def _flush(self, wrap: str = "", shown: bool = True):
        text, self._data = "".join(self._data), []
        if not text:
            return
        at = self._open[-1]
        if not wrap and not self._kept_space and text.isascii() and text.isspace():
            text = "\n" if "\n" in text else " "
        self._add_kid(at, text)
        if self._keep_markup:
            raw = self.tag[at] in fixed.RAW_TEXT
            self.parts.append(wrap % text if wrap else text if raw else _escape(text))
        piece = text.strip()
        if shown and piece:
            if not self._hidden:
                self.pieces.append(piece)
            elif self.tag[at] in fixed.HIDDEN_TEXT:
                self.own_text[at] = self.own_text.get(at, "") + piece

    def _add_kid(self, at, kid):
        self.kid_count[at] += 1
        self.only_kid[at] = kid if self.kid_count[at] == 1 else None

    def _wrapped(self, text, wrap, shown=False):
        self._flush()
        self._data.append(text)
        self._flush(wrap, shown)

    def updatepos(self, i, j):
        return j  # line numbers are of no use here

    def handle_data(self, data):
        self._data.append(data)

    def handle_comment(self, data):
        self._wrapped(data, "<!--%s-->")

    def handle_decl(self, decl):
        self._wrapped(decl, "<!%s>")

    def handle_pi(self, data):
        self._wrapped(data, "<?%s>")

    def unknown_decl(self, data):
        if data[:6].upper() == "CDATA[":
            self._wrapped(data[6:], "<![CDATA[%s]]>", shown=True)

    def handle_starttag(self, tag, attrs):
        self._start(tag, attrs)
        if tag in fixed.VOID_ELEMENTS:
            self._pop()
            self._void_done[tag] = self._void_done.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self._start(tag, attrs)
        self._pop()

    def handle_endtag(self, tag):
        if self._void_done.get(tag):
            self._void_done[tag] -= 1
        elif self._open_tags.get(tag):
            while self._pop() != tag:
                pass

    def _start(self, tag, attrs):
        at = len(self.tag)
        up = prev = -1
        if self._open:
            self._flush()
            up = self._open[-1]
            prev, self.last_kid[up] = self.last_kid[up], at
            self._add_kid(up, at)
        values = {name: value or "" for name, value in attrs}
        for name in fixed.LIST_ATTRIBUTES & values.keys():
            values[name] = " ".join(values[name].split())
        self.tag.append(tag)
        self.attrs.append(values)
        self.parent.append(up)
        self.prev.append(prev)
        self.place.append(self.place[prev] + 1 if prev >= 0 else 1)
        self.last.append(at)
        self.last_kid.append(-1)
        self.kid_count.append(0)
        self.only_kid.append(None)
        self.text_span.append([len(self.pieces), 0])
        self.markup_span.append([len(self.parts), 0])
        self.by_tag.setdefault(tag, []).append(at)
        self._open.append(at)
        self._open_tags[tag] = self._open_tags.get(tag, 0) + 1
        self._hidden += tag in fixed.HIDDEN_TEXT
        self._kept_space += tag in fixed.KEEP_SPACE
        if self._keep_markup and tag:
            shown = "".join(f" {name}={_quote(value)}" for name, value in values.items())
            self.parts.append(f"<{tag}{shown}{'/' if tag in fixed.VOID_ELEMENTS else ''}>")

    def _pop(self):
        self._flush()
        at = self._open.pop()
        tag = self.tag[at]
        self._open_tags[tag] -= 1
        self._hidden -= tag in fixed.HIDDEN_TEXT
        self._kept_space -= tag in fixed.KEEP_SPACE
        if self._keep_markup and tag and tag not in fixed.VOID_ELEMENTS:
            self.parts.append(f"</{tag}>")
        self.last[at] = len(self.tag) - 1
        self.text_span[at][1] = len(self.pieces)
        self.markup_span[at][1] = len(self.parts)
        return tag

    # -- matching: every step walks sorted element numbers once
    def select(self, groups) -> list[int]:
        hits = [self._walk(steps) for steps in groups]
        return hits[0] if len(hits) == 1 else sorted(set().union(*hits))

    def _walk(self, steps) -> list[int]:
        left = []
        for comb, tag, tests in steps:
            pool = self._pool(tag, tests)
            if comb == " ":
                pool = self._below(left, pool)
            elif comb in (">", "+"):
                link, known = (self.parent if comb == ">" else self.prev), set(left)
                pool = [e for e in pool if link[e] in known]
            elif comb == "~":
                first = {}
                for e in left:
                    first.setdefault(self.parent[e], e)
                pool = [e for e in pool if first.get(self.parent[e], e) < e]
            left = pool
        return left

    def _below(self, left, pool):
        reach, at, kept = -1, 0, []
        for e in pool:
            while at < len(left) and left[at] < e:
                reach = max(reach, self.last[left[at]])
                at += 1
            if e <= reach:
                kept.append(e)
        return kept

    def _test(self, e, name, op, value) -> bool:
        if not name:
            return self._structure(e, op, value)
        actual = self.attrs[e].get(name)
        if actual is None or op == "has":
            return actual is not None
        if op.endswith("i"):
            actual, op = actual.lower(), op[:-1]
        if op == "=":
            return actual == value
        if op == "~=":
            return value in actual.split()
        if op == "|=":
            return actual == value or actual.startswith(value + "-")
        if op == "^=":
            return value != "" and actual.startswith(value)
        if op == "$=":
            return value != "" and actual.endswith(value)
        return value != "" and value in actual

    def _structure(self, e, op, value) -> bool:
        if op == "nth":
            a, b, from_end, of_type = value
            if of_type:
                first, total = self._types()
                place = total[self.parent[e], self.tag[e]] - first[e] + 1 if from_end else first[e]
            else:
                place = self.place[self.last_kid[self.parent[e]]] - self.place[e] + 1 if from_end else self.place[e]
            return place == b if a == 0 else (place - b) % a == 0 and (place - b) // a >= 0
        if op == "empty":
            return self.kid_count[e] == 0
        if op == "root":
            return self.parent[e] == 0
        known = self._known.get(id(value))
        if known is None:
            found = set().union(*[self._having(steps) for steps in value]) if op == "has" else set(self.select(value))
            known = self._known[id(value)] = value, found  # the value is held, so its id stays its own
        return (e in known[1]) != (op == "not")

    def _types(self):
        """Place of each element among its siblings of the same tag, and how many there are; counted once."""
        if self._places is None:
            total, first = {}, [0]
            for e in range(1, len(self.tag)):
                key = self.parent[e], self.tag[e]
                total[key] = total.get(key, 0) + 1
                first.append(total[key])
            self._places = first, total
        return self._places

    def _pool(self, tag, tests) -> list[int]:
        pool = self.by_tag.get(tag, []) if tag and tag != "*" else range(1, len(self.tag))
        return [e for e in pool if all(self._test(e, *test) for test in tests)]

    def _having(self, steps) -> list[int]:
        """Elements from which the steps lead somewhere, found from the last step back."""
        reached = self._pool(*steps[-1][1:])
        for at in range(len(steps) - 1, -1, -1):
            comb = steps[at][0]
            pool = self._pool(*steps[at - 1][1:]) if at else range(1, len(self.tag))
            if comb == " ":
                reached = [e for e in pool if (nth := bisect_right(reached, e)) < len(reached) and reached[nth] <= self.last[e]]
            elif comb in (">", "+"):
                link = self.parent if comb == ">" else self.prev
                known = {link[e] for e in reached}
                reached = [e for e in pool if e in known]
            else:
                latest = {self.parent[e]: e for e in reached}
                reached = [e for e in pool if e < latest.get(self.parent[e], -1)]
        return reached

    # -- values
    def value(self, e: int, kind: str, attribute: str) -> str:
        if kind == "html":
            start, end = self.markup_span[e]
            return "".join(self.parts[start:end])
        if kind in ("attribute", "href", "src"):
            return self.attrs[e].get(attribute if kind == "attribute" else kind, "")
        if kind == "innerText":
            while isinstance(self.only_kid[e], int):
                e = self.only_kid[e]
            return (self.only_kid[e] or "").strip()
        if self.tag[e] in fixed.HIDDEN_TEXT:
            return self.own_text.get(e, "")
        start, end = self.text_span[e]
        return "".join(self.pieces[start:end])


def _escape(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def _quote(value: str) -> str:
    value = _escape(value)
    if '"' not in value:
        return f'"{value}"'
    return f"'{value}'" if "'" not in value else '"' + value.replace('"', "&quot;") + '"'


def is_container(rule: dict) -> bool:
    return rule.get("name") == "container" or bool(rule.get("container"))


def compile_rules(rules: list[dict]) -> dict:
    """Container and field selectors of one selector list, ready for ``read_items``."""
    container = next((r.get("selector") or "" for r in rules if is_container(r)), "")
    fields = [r for r in rules if r.get("selector") and not (container and is_container(r))]
    return {
        "container": compile_selector(container) if container else None,
        "fields": [
            (
                r["name"],
                compile_selector(r["selector"]),
                r.get("type") or "text",
                r.get("attribute") or "",
                bool(r.get("multiple")),
            )
            for r in fields
        ],
    }


def unusable(rules_json: str | None) -> list[dict]:
    """Rules of a catalogue row whose selector is outside the grammar."""
    found = []
    for rule in json.loads(rules_json) if rules_json else []:
        try:
            compile_selector(rule.get("selector") or "*")
        except ValueError:
            found.append({"name": rule.get("name"), "selector": rule["selector"], "is_container": bool(is_container(rule))})
    return found


def compile_known(rules_json: str | None) -> dict | None:
    """Rules from a catalogue row: bad field selectors drop out, a bad container voids the row."""
    rules = json.loads(rules_json) if rules_json else []
    kept = []
    for rule in rules:
        try:
            compile_selector(rule.get("selector") or "*")
        except ValueError:
            if is_container(rule):
                return None
            continue
        if rule.get("name") is not None:
            kept.append(rule)
    return compile_rules(kept)


def read_items(markup: str, rules: dict) -> list[dict]:
    """Records of one page: one per container element, or one for the whole page.

    Markup the parser rejects (a malformed ``<![`` section) gives none.
    """
    fields = rules["fields"]
    if not fields:
        return []
    try:
        page = PageReader(markup, any(kind == "html" for _, _, kind, _, _ in fields))
    except AssertionError:
        return []
    hits = [page.select(groups) for _, groups, _, _, _ in fields]
    scopes = [0] if rules["container"] is None else page.select(rules["container"])
    items = []
    for scope in scopes:
        item = {}
        for found, (name, _, kind, attribute, multiple) in zip(hits, fields):
            low, high = bisect_right(found, scope), bisect_right(found, page.last[scope])
            if multiple:
                item[name] = [page.value(e, kind, attribute) for e in found[low:high]]
            elif low < high:
                item[name] = page.value(found[low], kind, attribute)
        if item:
            items.append(item)
    return items
