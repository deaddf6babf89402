"""Near copies against all pairs by exact Jaccard similarity, by kind of edit."""

import random

import numpy as np
import pytest

from brindle.llm import nearcopies, simhash


def similarity(a, b):
    x, y = ({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in (a, b))
    return len(x & y) / len(x | y) if x | y else 1.0


def roots_of(docs):
    near = [(i, j) for i in range(len(docs)) for j in range(i) if similarity(docs[i], docs[j]) >= 0.8]
    return simhash.local_roots(len(docs), *(np.array([p[k] for p in near], np.int64) for k in (0, 1)))


def edited(r, words, kind, share):
    n = max(1, int(len(words) * share))
    new = [f"n{r.randrange(10**9)}" for _ in range(n)]
    if kind == "appended":
        return words + new
    if kind == "prepended":
        return new + words
    if kind == "truncated":
        return words[:-n]
    at = r.randrange(1, len(words) - n)
    if kind == "inserted":
        return words[:at] + new + words[at:]
    if kind == "removed":
        return words[:at] + words[at + n :]
    out = list(words)
    for k in r.sample(range(len(words)), max(1, n // 8)):
        out[k] = new[0]
    return out


KINDS = ("appended", "prepended", "truncated", "inserted", "removed", "replaced")


def corpus(seed, bases=12):
    """Per kind of edit, texts of 40 to 1200 words with a copy edited to a similarity around 0.8, either side."""
    r = random.Random(seed)
    common = [f"w{int(r.paretovariate(0.7))}" for _ in range(20_000)]
    docs = []
    for kind in KINDS:
        for _ in range(bases):
            text = [r.choice(common) for _ in range(r.choice((40, 150, 400, 1200)))]
            docs += [text, edited(r, text, kind, r.choice((0.1, 0.17, 0.2, 0.23, 0.3)))]
    return docs


def frame(spark, docs):
    return spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")


def test_bands_bring_together_every_kind_of_edit():
    """Appended and cut tails move every word fingerprint; bands must find 0.8 whatever the edit."""
    docs = corpus(1, 40)
    sets = nearcopies.shingle_sets([" ".join(d).encode() for d in docs])
    assert [len(s) for s in sets] == [len({tuple(d[k : k + 5]) for k in range(len(d) - 4)}) for d in docs]
    keys = nearcopies.band_keys(sets)
    checked = 0
    for i in range(0, len(docs), 2):
        if similarity(docs[i], docs[i + 1]) >= 0.8:
            checked += 1
            assert (keys[i] == keys[i + 1]).any()
    assert checked > 60
    assert nearcopies.band_keys([np.zeros(0, np.uint64)]).tolist() == [[0] * nearcopies.BANDS]


def test_band_rate():
    """Sets of exactly 0.8 share a band as often as the formula says."""
    r = np.random.default_rng(5)
    hits = []
    for n in (1, 20):
        for _ in range(200):
            h = r.integers(1 << 63, size=10 * n, dtype=np.uint64)
            a, b = nearcopies.band_keys([np.sort(h[: 9 * n]), np.sort(h[n:])])
            hits.append((a == b).mean())
    assert abs(np.mean(hits) - 0.8**nearcopies.ROWS) < 0.03 and min(hits) > 0


@pytest.mark.parametrize("block", [None, 3000])
def test_near_copies_are_exact(spark, monkeypatch, block):
    if block:
        monkeypatch.setattr(nearcopies, "BLOCK_SHINGLES", block)
    docs = corpus(2)
    r = random.Random(3)
    base = [f"g{r.randrange(900)}" for _ in range(300)]
    docs += [edited(r, base, "replaced", r.choice((0.1, 0.3))) for _ in range(25)]  # one large group, linked and not
    docs += [docs[0], docs[7], [], [], ["one"], ["One"], ["a", "b", "c"]]
    rows = nearcopies.near_copies(spark, frame(spark, docs)).collect()
    got = {x.doc_id: x.component_id for x in rows}
    lower = [[w.lower() for w in d] for d in docs]
    want = {i: c if docs[i] else i for i, c in enumerate(roots_of(lower).tolist())}  # without words: copies of nothing
    assert len(rows) == len(docs) and got == want


def test_copies_are_decided_by_row(spark):
    """An id with several texts, equal rows, rows without an id, texts without words, clashing names."""
    w, v = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    other = w.replace("w59", "end")  # a near copy
    rows = [(3, w, 1), (5, " ".join(f"u{i}" for i in range(60)), 2), (5, w, 3), (5, w, 3), (6, None, 4), (7, "", 5), (8, " \n", 6), (8, " \n", 6), (9, other, 7), (None, w, 8), (None, v, 9), (None, v, 9), (4, v.upper(), 10)]
    df = spark.createDataFrame([(i, t, s, s, s, "x") for i, t, s in rows], "doc_id long, text string, sig int, cluster int, k1 int, `a.b` string")
    got = nearcopies.without_near_copies(spark, df)
    assert got.columns == df.columns
    assert sorted(r.sig for r in got.collect()) == [1, 2, 4, 5, 6, 6, 10]
    alone = spark.createDataFrame([(None, w, 1), (None, w, 1), (2, v, 2), (2, v, 2)], "doc_id long, text string, sig int")
    assert sorted(r.sig for r in nearcopies.without_near_copies(spark, alone).collect()) == [1, 2]
    assert nearcopies.without_near_copies(spark, df.limit(0)).count() == 0
    counted = {(r.doc_id, r.component_id, r.n) for r in nearcopies.near_copies(spark, df).collect()}
    assert {(5, 3, 2), (None, 3, 1), (None, 4, 2), (9, 3, 1), (6, 6, 1), (8, 8, 2)} <= counted


def shuffled_bytes(spark):
    jsc = spark.sparkContext._jsc.sc()
    jsc.listenerBus().waitUntilEmpty()
    executors = jsc.statusStore().executorList(True)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


@pytest.fixture
def unbroadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("words", [None, 1])
def test_texts_without_copies_are_not_shuffled(spark, monkeypatch, tmp_path, unbroadcast, words):
    """Row by row what brute force keeps, even if a full filter lets all rows through to the joins."""
    if words:
        monkeypatch.setattr(nearcopies, "FILTER_WORDS", words)
    r = random.Random(8)
    texts = [[f"{r.getrandbits(64):x}" for _ in range(900)] for _ in range(200)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    rows += [(300 + i, " ".join(edited(r, texts[20 * i], "replaced", 0.1))) for i in range(5)]  # near copies
    rows += [(7, rows[7][1]), (8, "another text " + rows[9][1]), (None, rows[11][1]), (None, "alone " * 9), (400, None), (400, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.write.parquet(str(tmp_path / "in"))
    before = shuffled_bytes(spark)
    nearcopies.without_near_copies(spark, spark.read.parquet(str(tmp_path / "in"))).write.parquet(str(tmp_path / "out"))
    moved = shuffled_bytes(spark) - before
    got = sorted(str(tuple(x)) for x in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted(str(x) for x in [*rows[:9], rows[206], *rows[10:200], (None, "alone " * 9), (400, None), (400, None)])
    assert words or moved < 0.5 * sum(len(t or "") for _, t in rows)


def test_row_filter(spark):
    keys = [(i, i * i, -i) for i in range(500)] + [(None, 5, 6)]
    rows = spark.createDataFrame(keys + [(i, i * i, i) for i in range(1, 5001)], "doc_id long, k1 long, k2 long")
    known = nearcopies.row_filter(spark, spark.createDataFrame(keys, rows.schema))
    let, others = ({tuple(x) for x in nearcopies.filtered(rows, known, how).collect()} for how in ("left_semi", "left_anti"))
    assert set(keys) <= let and not let & others and len(let) + len(others) == 5501 and len(let) < 501 + 250
    none = nearcopies.row_filter(spark, rows.limit(0))
    assert nearcopies.filtered(rows, none, "left_semi").count() == 0


def test_exact_links_at_the_border():
    ten = np.arange(10, dtype=np.uint64)
    assert nearcopies.exact_links([ten[:4], ten[:5]]).tolist() == [0, 0]  # 4 of 5
    assert nearcopies.exact_links([ten[:7], ten[:9]]).tolist() == [0, 1]  # 7 of 9
    assert nearcopies.exact_links([ten[:0], ten[:3], ten[:0]]).tolist() == [0, 1, 0]
    assert nearcopies.exact_links([ten[:6], ten[:10], ten[:8]]).tolist() == [0, 1, 1]  # 6 of 8, 8 of 10
