import itertools
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from pagegrain.llm import near_dedup
from pagegrain.llm.components import components
from pagegrain.llm.near_dedup import joint_estimate, near_duplicates, sketches
from pagegrain.llm.queries import op8_near_dedup

UPPER = {i: i + 32 for i in range(65, 91)}


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute(texts):
    """All pairs that share a shingle, on the full sets."""
    sets, holders, shared = {d: shingles(t) for d, t in texts.items()}, defaultdict(list), Counter()
    for d in sorted(sets):
        for s in sets[d]:
            holders[s].append(d)
    for group in holders.values():
        shared.update(itertools.combinations(group, 2))
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), find(d), find(d) == d) for d in sets}


def found(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()}


def test_query_equals_brute_force(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert found(op8_near_dedup(spark, sf)) == brute(texts)


def edited(text, seed, share):
    rng, words = np.random.default_rng(seed), text.split()
    for i in rng.choice(len(words), int(share * len(words)), replace=False):
        words[i] = f"w{rng.integers(1 << 40)}"
    return " ".join(words)


@pytest.mark.parametrize("block", [8, 512])
def test_chains_groups_and_edges(docs, prose, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    base = prose(1, 200)
    # Copies with 2 % of the words edited link with the base, and not always with each other.
    texts = [edited(base, i, 0.015 + 0.001 * (i % 12)) for i in range(60)]
    chain = [prose(2, 120)]
    for i in range(8):
        words = chain[-1].split()
        chain.append(" ".join(words[6:] + prose(70 + i, 6).split()))
    texts += chain + [base.upper(), base.replace(" ", "\n"), "one two", "One  TWO", "three", None, "", "  ", prose(3, 4), "Ä b", "ä b", "word " * 30_000]
    texts += [prose(200 + i, 60) for i in range(20)]
    ids = list(np.random.default_rng(1).permutation(len(texts)) * 3)
    rows = docs(texts, ids=[int(i) for i in ids], extra=["n", "component", "key"])
    assert found(near_duplicates(rows)) == brute(dict(zip(ids, texts)))


def test_repeated_rows_null_ids_and_empty_table(docs, prose):
    text = prose(1)
    out = near_duplicates(docs([text, text, text, "x y"], ids=[3, 3, None, 1])).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"], r["kept"]) for r in out) == [(-1, None, True), (1, 1, True), (3, 3, True), (3, 3, True)]
    assert near_duplicates(docs([])).count() == 0
    kept = near_dedup.keep_one(docs([text, text, "other", None], ids=[9, 4, 5, 6], extra=["kept"]))
    assert sorted(r["doc_id"] for r in kept.collect()) == [4, 5, 6] and "kept" in kept.columns


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    parts = [np.sort(pool[:2000]), np.sort(pool[800:]), np.sort(pool)]
    k = sketches(parts)
    assert (np.maximum(k[0], k[1]) == k[2]).all()
    estimates = []
    for i in range(40):
        own = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
        a, b = sketches([np.sort(own[:900]), np.sort(own[100:])])
        estimates.append(joint_estimate(a[None], b[None], np.array([900]), np.array([900]))[0])
    assert abs(np.mean(estimates) - 0.8) < 0.03 and max(abs(e - 0.8) for e in estimates) < near_dedup.MARGIN
    assert (sketches([pool[:1]])[0] == sketches([pool[:1]])[0]).all() and not sketches([pool[:0]]).any()


def test_components_of_a_path(spark):
    links = [(i, i + 1) for i in range(0, 60, 2)] + [(i, i - 1) for i in range(2, 60, 2)] + [(100, 90), (90, 100), (7, 7)]
    out = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert out == {i: 0 for i in range(60)} | {90: 90, 100: 90}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_thue_morse_words_do_not_link(docs):
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    other = word.translate(str.maketrans("ab", "ba"))
    rows = near_dedup.near_duplicates(docs([f"a b c d {word}", f"a b c d {other}", f"A b c d {word.upper()}"]))
    assert {r["doc_id"]: r["component_id"] for r in rows.collect()} == {0: 0, 1: 1, 2: 0}


def test_parity_bound_refuses_no_link_and_most_pairs_well_below():
    rng = np.random.default_rng(4)
    pairs = []
    for n in [1, 2, 3, 7, 60, 64, 65, 146, 1000, 3000, 9000]:
        for share in [0.5, 0.6, 0.7, 0.75, 0.8, 1.0]:
            common = round(2 * n * share / (1 + share))
            own = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
            # Of equal size, and with all differing shingles on one side.
            pairs.append((own[:n], own[n - common : 2 * n - common]))
            pairs.append((own[:n], own[: max(1, round(n * share))]))
    sets = [s for pair in pairs for s in pair]
    n = np.array([len(s) for s in sets])
    x = np.arange(0, len(sets), 2)
    ok = near_dedup.Parities([near_dedup.parity_bits(s) for s in sets]).allow(x, x + 1, n)
    truth = []
    for a, b in pairs:
        common = len(np.intersect1d(a, b))
        truth.append(common / (len(a) + len(b) - common))
    truth = np.array(truth)
    assert ok[truth >= 0.75].all()
    large = np.array([len(a) >= 60 for a, _ in pairs])
    assert not ok[(truth <= 0.61) & large].any()


def test_edited_copies_that_do_not_link_leave_no_pairs(docs, prose, monkeypatch):
    base, sent = prose(9, 150), []
    checked = near_dedup.linked_pairs

    def counted(pairs, sets):
        pairs = pairs.persist()
        sent.append(pairs.count())
        return checked(pairs, sets)

    monkeypatch.setattr(near_dedup, "linked_pairs", counted)
    # 3 % of the words edited in each: two copies share about 0.6 of their shingles.
    texts = {i: edited(base, i, 0.033) for i in range(120)}
    assert found(near_duplicates(docs(list(texts.values())))) == brute(texts)
    # Of 7,140 pairs, nearly all of them in a common bucket.
    assert sent[2] < 500, sent
