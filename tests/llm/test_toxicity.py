import zlib

from llm_data import docs, plain, prose, with_clashes

from evidrank.llm import toxicity

BAD = ["grolm", "snarv", "vexit", "druff"]
SMALL = toxicity.Ftrl(bits=18, l1=3.0, max_rows=600)


def corpus(spark, n=500):
    made, labels = [], []
    for k in range(n):
        toxic = k % 5 == 0
        text = prose(k, 40)
        if toxic:
            text += f" {BAD[k % 4]}, {BAD[k % 3]}!"
        made.append((k, text, "en", "a", len(text)))
        labels.append((k, 1, int(toxic)))
    return docs(spark, made), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_documents_are_told_apart(spark):
    table, labels = corpus(spark)
    scored = toxicity.score(table, toxicity.fit(table, labels, SMALL), SMALL).withColumn("held", toxicity.is_held_out()).collect()
    assert len(scored) == 500
    for r in scored:
        assert r.held == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
    held = [r for r in scored if r.held]
    right = sum((r.score >= 0.5) == (r.doc_id % 5 == 0) for r in held)
    assert len(held) > 50 and right >= 0.97 * len(held)


def test_labels_of_held_out_rows_change_nothing(spark):
    from pyspark.sql import functions as F

    table, labels = corpus(spark, 200)
    flipped = labels.withColumn("toxic", F.when(toxicity.is_held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert plain(toxicity.fit(table, labels, SMALL)) == plain(toxicity.fit(table, flipped, SMALL))


def test_sample_is_bounded_and_repeatable(spark):
    table, labels = corpus(spark, 200)
    first = toxicity.training_rows(table, labels, 40)
    assert first.count() <= 40 and plain(first) == plain(toxicity.training_rows(table.repartition(7), labels.repartition(3), 40))


def test_awkward_rows(spark):
    table = with_clashes(docs(spark))
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (3, None, None), (None, 1, 1), (7, 0, 0), (999, 1, 1), (8, 1, 0)], "doc_id long, quality int, toxic int")
    scored = toxicity.score(table, toxicity.fit(table, labels, SMALL), SMALL, out="toxicity")
    assert scored.columns == [*table.columns, "toxicity"]
    got = scored.collect()
    assert len(got) == table.count() and all(0 <= r.toxicity <= 1 for r in got)
    assert len({r.toxicity for r in got if not (r.text or "").split()}) == 1


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.score(docs(spark), toxicity.fit(docs(spark), empty, SMALL), SMALL).collect()} == {0.0}
    assert toxicity.score(docs(spark, []), toxicity.fit(docs(spark, []), empty, SMALL), SMALL).count() == 0


def test_a_cut_class_shifts_the_intercept(spark):
    """100 toxic and 400 clean rows, less the held-out ones; with at most 20 of each the odds of the sample are even."""
    import math

    table, labels = corpus(spark)
    known = toxicity.known_rows(table, labels)
    toxic, clean = known.where("toxic = 1").count(), known.where("toxic = 0").count()
    assert abs(toxicity.log_odds_shift(known, 40) - math.log(toxic / clean)) < 1e-9
    assert toxicity.log_odds_shift(known, 2000) == 0.0
    flat = toxicity.Ftrl(bits=18, l1=1e9, epochs=1, max_rows=40)  # the intercept alone
    w = {r.coordinate: r.weight for r in toxicity.fit(table, labels, flat).collect()}
    assert set(w) == {-1} and w[-1] < math.log(toxic / clean) / 2
