"""The pipeline's stages on odd tables, and run() against brute force on a small corpus."""

import hashlib
import random

import numpy as np
import pytest

import corpus_pipeline
from brindle.llm import bpe, mixing, nearcopies, quality, simhash

from .test_operators import brute_repeats, brute_suffix

WORDS = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "nu", "re") for b in ("ta", "so", "vi", "du") for c in ("n", "l", "ra", "to")]


def sentence(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n)).capitalize() + "."


def documents(r):
    """(doc_id, text): clean ones, exact and near copies, a shared passage, short ones, repeats, toxic ones."""
    docs = [(i, "\n".join(sentence(r, 12) for _ in range(r.randint(4, 9)))) for i in range(60)]
    docs += [(100 + i, docs[i][1]) for i in range(6)]
    docs += [(110 + i, docs[10 + i][1] + " " + sentence(r, 3)) for i in range(6)]
    passage = sentence(r, 20)
    docs += [(120 + i, sentence(r, 30) + "\n" + passage + "\n" + sentence(r, 30)) for i in range(4)]
    docs += [(130, "short"), (131, ""), (132, None), (133, "one two three four five six seven eight " * 9)]
    docs += [(140 + i, "\n".join(sentence(r, 12) for _ in range(4)) + " vileness vileness") for i in range(12)]
    docs += [(3, docs[3][1]), (3, docs[3][1]), (4, "\n".join(sentence(r, 12) for _ in range(5))), (None, docs[7][1])]
    return docs


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    docs = documents(random.Random(11))
    rows = [(i, t, "en", "web", None if t is None else len(t), "x") for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, sig string").write.parquet(f"{at}/documents.parquet")
    labels = [(i, 1, 0) for i in range(0, 60, 2)] + [(i, 1, 1) for i in range(140, 150)] + [(130, 0, 0), (131, 0, 0), (133, 0, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at, docs


def brute_copies(rows):
    """The rows that stay: of each component of five-word Jaccard 0.8 or more the least (id, hashes); texts decide."""
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if (w := t.lower().split()) else frozenset() for _, t in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    root = simhash.local_roots(len(rows), *(np.array([p[k] for p in near], np.int64) for k in (0, 1)))
    groups = {}
    for i, r in enumerate(root.tolist()):
        groups.setdefault(r, []).append(i)
    return [[rows[i] for i in g] for g in groups.values()]


def test_run_by_brute_force(spark, folder):
    at, docs = folder
    frame = spark.read.parquet(f"{at}/documents.parquet")
    read = lambda df: [(r.doc_id, r.text) for r in df.collect()]
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality rules", "SimHash near-dedup", "suffix-array dedup", "mixing sources to target weights", "BPE encoding and decoding"]

    kept = read(corpus_pipeline.quality_rules(spark, frame, at))
    crf = quality.train_line_crf(spark, frame, spark.read.parquet(f"{at}/labels.parquet"))
    want = []
    for i, t in docs:
        words = (t or "").split()
        if len(words) >= 20 and 100 * brute_repeats(words) <= 30 * len(words) and quality.judge([t.encode()], crf)["kept"][0]:
            want.append((i, t))
    assert sorted(kept, key=repr) == sorted(want, key=repr) and len(kept) > 70

    first = spark.createDataFrame(kept, "doc_id long, text string")
    groups = brute_copies(kept)
    least = {min(i for i, _ in g if i is not None) for g in groups}
    unique = read(corpus_pipeline.simhash_dedup(spark, first, at))
    assert len(unique) == len(groups) and {i for i, _ in unique} == least and set(unique) <= set(kept)

    second = spark.createDataFrame(unique, "doc_id long, text string")
    cut = brute_suffix([(i, t.encode()) for i, t in unique])
    done = read(corpus_pipeline.suffix_dedup(spark, second, at))
    whole = {i: b for i, (n, b) in cut.items() if b or not n}
    assert sum(n > 0 for n, _ in cut.values()) >= 3
    assert {i: t for i, t in done if i != 4} == {i: b.decode() for i, b in whole.items() if i != 4}

    third = spark.createDataFrame([(i, t, "en") for i, t in done], "doc_id long, text string, lang string")
    table = {(r.doc_id, r.tokens): r for r in mixing.mixing_table(spark, third, spark.read.parquet(f"{at}/labels.parquet")).collect()}
    for k, (d, share) in enumerate(zip(mixing.DOMAINS, mixing.KEEP)):
        have = sum(r.tokens * r[f"p_{d}"] for r in table.values())
        assert abs(sum(r.tokens * r[f"p_{d}"] * r.rate for r in table.values()) - share * have) <= (table[next(iter(table))].missed + 1e-6) * max(1, have)
    mixed = read(corpus_pipeline.mix_domains(spark, third, at))
    count = {}
    for row in mixed:
        count[row] = count.get(row, 0) + 1
    assert count == {(i, t): table[i, len(t.split())].copies for i, t in done if table[i, len(t.split())].copies}
    toxic = [i for i, _ in mixed if i is not None and 140 <= i < 152]
    assert len(toxic) < 9 and sum(i is not None and i < 60 for i, _ in mixed) > 50

    out = corpus_pipeline.bpe_tokens(spark, spark.createDataFrame(mixed, "doc_id long, text string"), at).collect()
    library = bpe.tokenizer(bpe.default_tokenizer_path()).library
    coded = [(i, library.encode(t, add_special_tokens=False).ids) for i, t in mixed]
    want = [(i, len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(x, skip_special_tokens=False).encode()).hexdigest()) for i, x in coded]
    assert sorted(map(tuple, out)) == sorted(want)
    assert sorted(map(tuple, corpus_pipeline.run(spark, at).collect())) == sorted(want)


def test_stages_on_odd_and_empty_tables(spark, folder):
    at, _ = folder
    rows = [(0, "a b c d e " * 40, 1, "x"), (0, "a b c d e " * 40, 1, "x"), (1, None, 2, "y"), (None, "é" * 5000, 3, None), (2, "", 4, ""), (5, " ".join(WORDS) * 40, 5, "z"), (None, None, None, None)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, component_id int, `c0` string")
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, odd, at)
        if name != "BPE encoding and decoding":
            assert got.columns == odd.columns, name
        assert got.count() <= len(rows) + 1, name
        assert stage(spark, odd.limit(0), at).count() == 0, name
    assert nearcopies.without_near_copies(spark, odd).count() == 6
