"""The pipeline against brute force, stage by stage."""

import random

import numpy as np
import pytest

import corpus_pipeline
from lathe.llm import langid, line_dedup
from tests.llm.test_operators import DOCS, SYLLABLES, aligned_brute, blank_words, brute_components, brute_fingerprint, hits, spoken


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(11)
    path = str(tmp_path_factory.mktemp("sf"))
    rows = []
    for i in range(150):
        lang = rng.choice(list(SYLLABLES))
        rows.append((i, ".\n".join(spoken(rng, lang, rng.randint(4, 20)) for _ in range(rng.randint(1, 5))), lang, f"s{i % 4}", 0))
    texts = [r[1] for r in rows]
    passage = spoken(rng, "xx", 60)
    rows += [(200 + k, texts[k], rows[k][2], "s0", 0) for k in range(8)]  # exact copies
    rows += [(300 + k, texts[k] + "\n" + spoken(rng, rows[k][2], 2), rows[k][2], "s1", 0) for k in range(8)]  # with an own line
    rows += [(400 + k, spoken(rng, "yy", 12) + "\n" + passage + "\n" + spoken(rng, "yy", 12), "yy", "s2", 0) for k in range(4)]  # a shared passage
    item = spoken(rng, "zz", 14)
    rows += [(500 + k, spoken(rng, "zz", 10) + " " + item + " " + spoken(rng, "zz", 10), "zz", "s3", 0) for k in range(3)]  # contaminated
    rows += [(600, "12345 !!", None, "s0", 0), (601, None, None, None, None), (602, "", "xx", "s1", 0)]
    spark.createDataFrame(rows, DOCS).repartition(5).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, "kato mi")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, {r[0]: r for r in rows}, [(1, item), (2, "kato mi")]


def stage(spark, n, rows, path):
    df = spark.createDataFrame([rows[i] for i in sorted(rows)], DOCS)
    return {r.doc_id: tuple(r) for r in corpus_pipeline.STAGES[n][1](spark, df, path).collect()}


def test_stages(spark, sf_dir):
    path, rows, items = sf_dir
    model = langid.fit(spark.createDataFrame(list(rows.values()), DOCS))

    def score(text):
        p = langid.log_probs(model, langid.windows(text.encode())).mean(axis=0)
        return np.exp(p.max()) / np.exp(p).sum()

    kept = stage(spark, 0, rows, path)
    assert set(kept) == {i for i, r in rows.items() if r[1] and any(map(str.isalpha, r[1])) and score(r[1]) >= 0.35} and set(rows) - set(kept) >= {600, 601, 602}
    assert all(kept[i] == rows[i] for i in kept)

    edited = stage(spark, 1, kept, path)
    order = sorted(kept)
    gone = aligned_brute([kept[i][1] for i in order])
    for n, i in enumerate(order):
        text = "\n".join(x for k, x in enumerate(kept[i][1].split("\n")) if k not in set(gone.get(n, [])))
        assert edited[i][1] == text and edited[i][4] == len(text)
    assert all(edited[200 + k][1] == "" for k in range(8) if line_dedup.line_hashes(kept[k][1].encode())[1].sum() >= line_dedup.BLOCK_WORDS)
    assert sum(edited[400 + k][1] != kept[400 + k][1] for k in range(4)) == 3

    single = stage(spark, 2, edited, path)
    order = sorted(edited)
    comp = brute_components([brute_fingerprint(edited[i][1]) for i in order])
    assert set(single) == {order[c] for c in comp}

    clean = stage(spark, 3, single, path)
    assert set(clean) == {i for i, r in single.items() if not hits(r[1], items)[1]} and not {500, 501, 502} & set(clean)

    mixed = corpus_pipeline.STAGES[4][1](spark, spark.createDataFrame([clean[i] for i in sorted(clean)], DOCS), path).collect()
    assert {r.doc_id: r.size for r in mixed} == {i: len(blank_words(r[1])) for i, r in clean.items()}
    total = sum(r.size for r in mixed)
    assert sum({r.source: r.target for r in mixed}.values()) == pytest.approx(total) and abs(sum(r.taken for r in mixed) - total) <= 8
    key = lambda r: (r.doc_id, r.taken)
    assert sorted(corpus_pipeline.run(spark, path).collect(), key=key) == sorted((r for r in mixed), key=key)


def test_stages_of_nothing(spark, sf_dir):
    docs = spark.createDataFrame([], DOCS)
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, docs, sf_dir[0]).count() == 0, name
