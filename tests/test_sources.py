"""Readers, declared schemas, stage tables and ledgers."""

import gzip

import pytest
from helpers import one, rows
from pyspark.sql import types as T
from pyspark.sql.functions import max as F_max

from evidrank.functions.joins import attach, widen
from evidrank.operators.constraint import constraint_columns
from evidrank.operators.orthology import marker_phenotypes, structure_phenotypes
from evidrank.sources import delimited, records, schema
from evidrank.sources.stages import StageStore, cut, drop_cuts, resume_remaining, write_id_list


def write(path, text):
    path.write_text(text)
    return str(path)


def test_null_tokens_and_ragged_rows(spark, tmp_path):
    path = write(tmp_path / "a.tsv", "id\tx\ty\n1\tNA\t.\n2\t\t3.5\n3\t4\n")
    assert rows(delimited.read_delimited(spark, path)) == [("1", None, None), ("2", None, "3.5"), ("3", "4", None)]


def test_comment_and_gzip(spark, tmp_path):
    path = tmp_path / "a.tsv.gz"
    path.write_bytes(gzip.compress(b"#made today\nid\tx\n1\ta\n2\tb\n"))
    df = delimited.read_delimited(spark, str(path), comment="#", partitions=3)
    assert rows(df) == [("1", "a"), ("2", "b")]
    assert df.rdd.getNumPartitions() == 3


def test_heads_cost_no_rows(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("# first\nname\tx\n#row\t1\n# first row\t2\n")
    (tmp_path / "d.tsv").write_text("x\tname\n3\t#4\n")
    df = delimited.read_delimited(spark, [str(tmp_path / "c.tsv"), str(tmp_path / "d.tsv")], comment="#")
    assert rows(df, "name", "x") == [("# first row", "2"), ("#4", "3"), ("#row", "1")]
    (tmp_path / "p.gct").write_text("#1.2\n3\t2\nName\tDescription\tA\tB\n101\t202\t\t5\n#n\td\t1\t2\n3\t2\t7\t8\n")
    assert rows(delimited.read_preamble(spark, str(tmp_path / "p.gct"))) == [("#n", "d", "1", "2"), ("101", "202", None, "5"), ("3", "2", "7", "8")]


def test_mapping_takes_one_hit_whole(spark):
    hits = [
        '{"query": "E1", "symbol": "ZZZ", "uniprot": {"Swiss-Prot": "P1"}}',
        '{"query": "E1", "symbol": "AAA", "uniprot": {"Swiss-Prot": "P9"}}',
        '{"query": "E2", "uniprot": {"Swiss-Prot": "P3"}}',
        '{"query": "E2", "symbol": "B"}',
    ]
    df = records.id_mapping(spark.createDataFrame([(h,) for h in hits], "hit string"), "hit")
    assert rows(df) == [("E1", "AAA", "P9"), ("E2", "B", None)]


def test_nan_is_no_value(spark):
    df = spark.createDataFrame([("1.5",), ("NaN",), ("x",)], "v string")
    assert rows(df.select(schema.lenient("v", "double").alias("v"))) == [(None,), (None,), (1.5,)]


def test_preamble(spark, tmp_path):
    head = "#1.2\n3\t2\nName\tDescription\tEye - Retina\tTestis\n"
    write(tmp_path / "a.gct", head + "ENSG1.5\tA\t1.5\tNA\nENSG2.1\tB\t2\t3\n")
    write(tmp_path / "b.gct", head + "3\tC\t9\t9\n")
    df = delimited.read_preamble(spark, [str(tmp_path / "a.gct"), str(tmp_path / "b.gct")])
    assert df.columns == ["Name", "Description", "Eye - Retina", "Testis"]
    assert rows(df) == [("3", "C", "9", "9"), ("ENSG1.5", "A", "1.5", None), ("ENSG2.1", "B", "2", "3")]


def test_conform_casts_and_backfills(spark):
    df = spark.createDataFrame([("1", "x"), ("no", "y")], "a string, b string")
    out = schema.conform(df, T.StructType.fromDDL("a bigint, c double, b string"))
    assert rows(out) == [(None, None, "y"), (1, None, "x")]
    assert schema.backfill(df, {"b": "string", "z": "double"}).columns == ["a", "b", "z"]


@pytest.mark.parametrize(
    "header, expected",
    [
        ("gene, transcript, `lof.pLI`, `lof.oe_ci.upper`, mean_coverage", ["gene_symbol", "transcript", "pli", "loeuf", "mean_depth", "loeuf_upper"]),
        ("gene_id, oe_lof_upper_ci", ["gene_id", "loeuf_upper", "loeuf"]),
        ("foo, bar", ["foo", "bar"]),
    ],
)
def test_alias_resolution(spark, header, expected):
    ddl = ", ".join(f"{c.strip()} string" for c in header.split(","))
    assert constraint_columns(spark.createDataFrame([], ddl)).columns == expected


def test_fuzzy_headers(spark):
    a = spark.createDataFrame([("M1", "MP:1"), ("M1", "MP:1")], "`Marker Symbol` string, `Mammalian Phenotype ID` string")
    assert rows(marker_phenotypes(a)) == [("M1", "MP:1", None)]
    b = spark.createDataFrame([("z", "eye", "ear")], "`Gene Symbol` string, `Affected Structure or Process 1` string, `Phenotype 2` string")
    assert rows(structure_phenotypes(b)) == [("z", None, "eye")]
    none = spark.createDataFrame([("q",)], "other string")
    assert marker_phenotypes(none).count() == 0 and structure_phenotypes(none).count() == 0
    assert marker_phenotypes(none).columns == ["mouse_gene", "mp_term_id", "mp_term_name"]


def lines(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "j string")


def test_universe_from_either_shape(spark):
    df = lines(spark, '{"ensembl":{"gene":"ENSG1"}}', '{"ensembl":[{"gene":"ENSG2"},{"gene":"LRG1"},{"gene":"ENSG1"}]}', "{}")
    assert rows(records.entity_ids(df, "j", "ENSG")) == [("ENSG1",), ("ENSG2",)]


def test_mapping_hits(spark):
    df = lines(
        spark,
        '{"query":"E1","symbol":"A","uniprot":{"Swiss-Prot":"P1"}}',
        '{"query":"E2","symbol":"B","uniprot":{"Swiss-Prot":["P2","P3"]}}',
        '{"query":"E3","notfound":true}',
        '{"query":"E4","symbol":"D"}',
    )
    assert rows(records.id_mapping(df, "j")) == [("E1", "A", "P1"), ("E2", "B", "P2"), ("E3", None, None), ("E4", "D", None)]


def test_annotation_hits(spark):
    df = lines(
        spark,
        '{"query":"E1","symbol":"A","go":{"BP":[{"id":"1"},{"id":"2"}],"MF":{"id":"3"}},"pathway":{"kegg":[{"id":"k"}]}}',
        '{"query":"E2","symbol":"B"}',
        '{"query":"E3","go":{"BP":[]},"pathway":{"wiki":[{"id":"w"}]}}',
        '{"query":"E4","pathway":{}}',
    )
    assert rows(records.annotation_counts(df, "j")) == [
        ("E1", "A", 3, 2, 1, None, True),
        ("E2", "B", None, None, None, None, None),
        ("E3", None, None, None, None, None, False),
        ("E4", None, None, None, None, None, None),
    ]


def test_feature_records(spark):
    df = lines(
        spark,
        '{"primaryAccession":"P1","sequence":{"length":100},"features":[{"type":"Domain","description":"PDZ"},'
        '{"type":"Domain","description":""},{"type":"Coiled coil"},{"type":"Transmembrane","description":"Helical"}]}',
        '{"primaryAccession":"P2","sequence":{"length":50}}',
    )
    ids = spark.createDataFrame([("P1",), ("P2",), ("P9",)], "uniprot_id string")
    assert rows(records.feature_counts(df, "j", ids)) == [
        ("P1", 100, ["PDZ"], 1, 1),
        ("P2", 50, [], 0, 0),
        ("P9", None, [], None, None),
    ]


def test_domain_and_phenotype_records(spark):
    df = spark.createDataFrame(
        [
            ("P1", '{"results":[{"metadata":{"accession":"I1","name":{"name":"PDZ"}}},{"metadata":{"accession":"I2","name":{"name":""}}}]}'),
            ("P2", '{"results":[]}'),
            ("P3", "{}"),
        ],
        "uniprot_id string, j string",
    )
    assert rows(records.domain_entries(df, "j")) == [("P1", ["PDZ"], ["I1", "I2"]), ("P2", [], []), ("P3", [], [])]
    docs = lines(
        spark,
        '{"response":{"docs":[{"marker_symbol":"m","mp_term_id":"MP:1","mp_term_name":"deaf","p_value":0.01},'
        '{"marker_symbol":"m","mp_term_id":"MP:1","mp_term_name":"deaf","p_value":0.01},{"marker_symbol":"m"},{"mp_term_id":"MP:2"}]}}',
    )
    assert rows(records.phenotype_documents(docs, "j")) == [("m", "MP:1", "deaf", 0.01)]


def test_union_conformed(spark):
    a = spark.createDataFrame([("x", "1")], "g string, n string")
    b = spark.createDataFrame([(1, "x"), (2, "x")], "n int, g string")
    assert rows(records.union_conformed([a, b], T.StructType.fromDDL("g string, n bigint"))) == [("x", 1), ("x", 2)]


def test_store_lifecycle(spark, tmp_path):
    store = StageStore(spark, str(tmp_path / "store"))
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, s string")
    assert store.load("t") is None and not store.exists("t")
    assert store.save(df, "t", "first") == 2
    assert store.save(df, "t", "more", replace=False) == 2
    assert store.load("t").count() == 4
    store.save(store.load("t").where("id = 1"), "t", "rebuilt from itself")
    assert rows(store.load("t")) == [(1, "a"), (1, "a")]
    store.save(df, "u")
    listed = store.list().collect()
    assert [r["table_name"] for r in listed] == ["u", "t"]
    assert [r["row_count"] for r in listed] == [2, 2]
    assert rows(store.query("SELECT s FROM u WHERE id > :low", {"low": 1})) == [("b",)]
    store.export("u", str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    store.delete("u")
    assert not store.exists("u") and store.load("u") is None
    with pytest.raises(KeyError):
        store.export("u", str(tmp_path / "out2"))


def test_stage_is_reused_unless_forced(spark, tmp_path):
    store = StageStore(spark, str(tmp_path / "store"))
    make = lambda n: lambda: spark.createDataFrame([(n,)], "n int")
    assert store.stage("t", make(1)).first()[0] == 1
    assert store.stage("t", make(2)).first()[0] == 1
    assert store.stage("t", make(3), force=True).first()[0] == 3


def test_run_ledger(spark, tmp_path):
    store = StageStore(spark, str(tmp_path / "store"))
    store.record_step("r1", "load", 10, 8, "known", {"kept": 8, "why": None})
    store.record_step("r1", "score")
    store.record_step("r2", "load")
    steps = store.steps("r1").collect()
    assert [s["step_name"] for s in steps] == ["load", "score"]
    assert steps[0]["details"] == {"kept": "8", "why": None} and steps[0]["output_count"] == 8


def test_a_build_commits_batches_and_repeats_none(spark, tmp_path):
    from pyspark.sql import functions as F

    keys = spark.createDataFrame([(k if k % 9 else None,) for k in range(200)], "k int")
    wanted, calls, broken = sorted([2 * k if k % 9 else -1 for k in range(200)]), [], [2]

    def work(part):
        calls.append(1)
        bad = F.when(F.lit(len(calls) - 1 in broken), F.raise_error(F.lit("lost"))).otherwise(F.lit(0))
        return part.select(F.coalesce(F.col("k") * 2 + bad, F.lit(-1)).alias("v"))

    store = StageStore(spark, str(tmp_path / "store"))
    store.save(spark.createDataFrame([(7,)], "v int"), "t", "the former table")
    with pytest.raises(Exception, match="lost"):
        store.build_in_batches(keys, "k", work, "t", batches=5)
    again = StageStore(spark, str(tmp_path / "store"))  # as another driver would
    assert again.progress("t") == (2, 5) and rows(again.load("t")) == [(7,)]
    built = again.build_in_batches(keys.repartition(3), "k", work, "t", batches=99)
    assert len(calls) == 6 and sorted(r[0] for r in built.collect()) == wanted
    assert again.progress("t") == (0, 0) and again.rows_of("t") == 200
    store.refresh()
    assert sorted(r[0] for r in store.load("t").collect()) == wanted
    again.build_in_batches(keys, "k", work, "t", batches=2)
    assert len(calls) == 8 and again.rows_of("t") == 200


def test_two_commits_of_one_batch_count_once(spark, tmp_path):
    keys = spark.createDataFrame([(k,) for k in range(20)], "k int")
    first, second = (StageStore(spark, str(tmp_path / "store")) for _ in range(2))
    assert not first.exists("t") and not second.exists("t")
    second.stages.rows()
    first.build_in_batches(keys, "k", lambda p: p, "t", batches=2)
    build = first.stages.rows()[0]["build"]
    second._record("t", row_count=9, rows_written=9, path=f"{first.root}/t/none", build=build, batch=1, batches=2)
    late = StageStore(spark, str(tmp_path / "store"))
    assert late.progress("t") == (0, 0) and late.rows_of("t") == 20 and sorted(r[0] for r in late.load("t").collect()) == list(range(20))


def test_ledgers_cost_no_job(spark, tmp_path):
    store = StageStore(spark, str(tmp_path / "store"))
    df = spark.createDataFrame([(1,), (2,)], "v int")
    spark.sparkContext.setJobGroup("ledger", "ledger")
    seen = store.save_measured(df, "t", metrics={"most": F_max("v")})
    store.record_step("r", "step", 2, 2)
    assert store.exists("t") and store.rows_of("t") == 2 and seen == {"_rows": 2, "most": 2}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("ledger"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs == 1


def test_cut_keeps_rows_and_schema(spark):
    df = spark.createDataFrame([(1, [1.0])], "a int, b array<double>")
    back = cut(df)
    assert rows(back) == [(1, [1.0])] and [f.dataType for f in back.schema] == [f.dataType for f in df.schema]
    drop_cuts(spark)


def test_resume_and_id_list(spark, tmp_path):
    want = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    done = spark.createDataFrame([("b",)], "k string")
    left = resume_remaining(want, done, "k")
    assert rows(left) == [("a",), ("c",)]
    write_id_list(left, "k", str(tmp_path / "ids"))
    assert rows(spark.read.text(str(tmp_path / "ids"))) == [("a",), ("c",)]


def test_attach_keeps_rows_without_key(spark):
    left = spark.createDataFrame([(1, "a"), (2, None), (3, "z")], "id int, k string")
    right = spark.createDataFrame([("a", 10)], "k string, v int")
    assert rows(attach(left, right, "k"), "id", "v") == [(1, 10), (2, None), (3, None)]


def test_widen_only_spreads_narrow_scans(spark):
    assert widen(spark.range(10, numPartitions=1)).rdd.getNumPartitions() >= 4
    wide = spark.range(10, numPartitions=64)
    assert widen(wide) is wide


def test_one_row_summary_of_nothing(spark):
    from evidrank.operators.entities import mapping_gate, mapping_report

    empty = spark.createDataFrame([], "gene_id string, gene_symbol string, uniprot_accession string")
    row = one(mapping_gate(mapping_report(empty)))
    assert row["symbol_rate"] == 0.0 and row["status"] == "failed"
