"""The pipeline against stages worked by hand, on tables small enough for that."""

import os
import random
import re
from collections import Counter

import pytest
from llm_data import docs, prose
from pyspark.sql import functions as F
from test_minhash import brute_classes

import corpus_pipeline
from evidrank.llm import queries


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("tables"))
    made, labels = [], []
    for k in range(600):
        text = prose(k, 60)
        if k % 4 == 0:
            text += " grolm, snarv vexit!"
        if k % 7 == 0:
            text += " password=s3cr3tv4lue"
        made.append((k, text, "en", f"s{k % 3}", len(text)))
        labels.append((k, 1, int(k % 4 == 0)))
    made += [(1000 + k, made[k + 1][1], "en", "s1", 5) for k in range(0, 40, 4)]
    made += [(2000, None, None, None, None), (2001, "", "en", "s0", 0)]
    docs(spark, made).write.parquet(os.path.join(out, "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(os.path.join(out, "labels.parquet"))
    return out, made


def test_stages_take_effect(spark, folder):
    out, made = folder
    table = spark.read.parquet(f"{out}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "secrets", "mixing", "packing"]
    steps = [table]
    for _, stage in corpus_pipeline.STAGES:
        steps.append(stage(spark, steps[-1], out))
    for step in steps[1:-1]:
        assert step.columns == table.columns
    toxic = {i for i, t, *_ in made if "grolm" in (t or "")}
    kept = {r.doc_id for r in steps[1].collect()}
    assert kept == {i for i, *_ in made} - toxic
    texts = {i: t for i, t, *_ in made if i in kept}
    roots = {min(ids) for ids in brute_classes(texts).values()}  # by the true Jaccard similarity of all pairs
    assert Counter(r.doc_id for r in steps[2].collect()) == Counter(roots)
    masked = {r.doc_id: r for r in steps[3].collect()}
    assert set(masked) == roots
    for i, r in masked.items():
        want = re.sub("s3cr3tv4lue", "[SECRET]", texts[i]) if texts[i] is not None else None
        assert r.text == want and r.n_chars == (len(want) if want is not None else None)
    mix = Counter(r.doc_id for r in steps[4].collect())
    assert set(mix) <= roots and max(mix.values()) <= 2
    pieces = steps[5].collect()
    whole = Counter()
    for p in pieces:
        whole[p.doc_id] += p.length
    for i, n in mix.items():
        tokens = next(p.doc_tokens for p in pieces if p.doc_id == i)
        assert whole[i] == n * tokens


def test_run_is_the_stages_one_after_the_other(spark, folder):
    out, _ = folder
    step = spark.read.parquet(f"{out}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        step = stage(spark, step, out)
    ids = lambda df: Counter((r.doc_id, r.doc_tokens) for r in df.select("doc_id", "doc_tokens", "start").where("start = 0").collect())
    assert ids(corpus_pipeline.run(spark, out)) == ids(step)


def test_empty_documents(spark, folder, tmp_path):
    out, _ = folder
    spark.read.parquet(f"{out}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{out}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_names_of_the_queries():
    assert [int(n[2:].split("_")[0]) for n in sorted(queries.QUERIES, key=lambda n: int(n[2:].split("_")[0]))] == list(range(1, 14))


def test_columns_with_clashing_names(spark, folder):
    """Each stage keeps its documents and all their columns, whatever these are called."""
    out, _ = folder
    table = spark.read.parquet(f"{out}/documents.parquet")
    names = ["_toxicity", "score", "c0", "n0", "text_key", "component_key", "a", "b", "band", "label", "_id", "_key", "_source", "taken"]
    wide = table.select("*", *[F.lit("kept").alias(n) for n in names])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got, want = stage(spark, wide, out), stage(spark, table, out)
        assert got.columns == wide.columns
        assert got.select(*names).distinct().collect() == [tuple(["kept"] * len(names))]
        assert Counter(map(tuple, got.select(*table.columns).collect())) == Counter(map(tuple, want.collect()))


def test_edited_copies_are_dropped(spark):
    """Copies with scattered edits whose Jaccard similarity over five words is 0.8 or more; others stay."""
    words = [f"w{k}" for k in range(400)]
    made, near, apart = [], [], []
    for k in range(40):
        base = random.Random(k).choices(words, k=180)
        for n, ids in ((1, near), (3, near), (12, apart)):
            copy = list(base)
            for e in range(n):
                copy[7 + e * 14] = f"new{k}x{e}"
            i = 1000 * n + k
            made.append((i, " ".join(copy), "en", "a", 0))
            ids.append(i)
        made.append((k, " ".join(base), "en", "a", 0))
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs(spark, made), "").collect()}
    assert kept == set(range(40)) | set(apart)
