"""Semantics on tiny literal frames (the regression topics of the source product)."""

import pytest
from pyspark.sql import functions as F

from riskframe.functions import scoring as SC
from riskframe.functions.targets import normalize_binary_columns, normalize_target, relabel_two_classes
from riskframe.functions.text import missing_to_null, normalize_name, normalize_text, parse_double
from riskframe.operators import cleaning as C
from riskframe.operators import features as FE
from riskframe.operators import joins as J
from riskframe.operators import metrics as M
from riskframe.operators import prefix, stats
from riskframe.session import scratch_path
from riskframe.sources import readers as RD
from tests.conftest import SMALL


def test_mode_tie_takes_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "c string")
    assert stats.modes(df, ["c"]) == {"c": "a"}


def test_median_interpolates_and_all_null_is_zero(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (3.0, None), (10.0, None)], "x double, y double")
    assert stats.exact_medians(df, ["x", "y"]) == {"x": 2.5, "y": 0.0}


def test_exact_median_equals_spark_median(spark):
    df = spark.range(20001).select(((F.col("id") * 7919) % 10007 / 3.0).alias("x"))
    expected = df.agg(F.median("x")).first()[0]
    assert stats.exact_medians(df, ["x"])["x"] == pytest.approx(expected, abs=1e-12)
    hot = spark.range(9000).select(F.when(F.col("id") % 3 == 0, F.lit(5.0)).otherwise(F.col("id") / 1.0).alias("x"))
    assert stats.exact_medians(hot, ["x"])["x"] == pytest.approx(hot.agg(F.median("x")).first()[0], abs=1e-12)


def test_exact_median_wide_bracket_hot_values_and_nan(spark, monkeypatch):
    monkeypatch.setattr(stats, "APPROX_ACCURACY", 50)  # brackets of many values, ranked by counts
    df = spark.range(6001).select(F.when(F.col("id") % 2 == 0, F.lit(1.0)).when(F.col("id") % 3 == 0, F.lit(2.0))
                                  .otherwise(F.col("id") / 7.0).alias("x"), (F.col("id") * 37 % 6001 / 3.0).alias("y"))
    got = stats.exact_medians(df, ["x", "y"])
    want = df.agg(F.median("x"), F.median("y")).first()
    assert got == {"x": pytest.approx(want[0], abs=1e-12), "y": pytest.approx(want[1], abs=1e-12)}
    nan = spark.createDataFrame([(float("nan"),), (1.0,), (2.0,), (3.0,), (None,)], "x double")
    assert stats.exact_medians(nan, ["x"]) == {"x": 2.0}


def test_running_sums_many_partitions_keep_every_row(spark):
    rows = [(k * 97 % 1000 + 2 ** 53, 1) for k in range(1000)] + [(None, 5), (None, 7)]
    df = spark.createDataFrame(rows, "k long, v long").repartition(3)
    for descending in (False, True):
        got = prefix.running_sums(df, "k", ["v"], descending=descending, partitions=7).collect()
        assert len(got) == 1002  # no row is lost, and keys beyond 2^53 stay apart
        total, keyed = 0 if descending else 12, {r["k"]: r["cum_v"] for r in got}
        for k in sorted((k for k, _ in rows if k is not None), reverse=descending):
            total += 1
            assert keyed[k] == total
    real = spark.createDataFrame([(float(k), 1) for k in range(50)] + [(float("nan"), 1)], "k double, v long")
    assert {r["k"]: r["cum_v"] for r in prefix.running_sums(real, "k", ["v"], inclusive=False, partitions=5).collect()}[49.0] == 49


def test_running_sums_really_use_several_partitions(spark, monkeypatch):
    seen = []
    real = prefix.cut_lineage
    monkeypatch.setattr(prefix, "cut_lineage", lambda df, name="": seen.append(real(df, name)) or seen[-1])
    prefix.running_sums(spark.range(5000).select(F.col("id").alias("k"), F.lit(1).alias("v")), "k", ["v"], partitions=6).collect()
    assert seen[1].select("_part").distinct().count() >= 3


def test_split_keeps_rows_without_label_and_falls_back(spark):
    df = spark.range(100).select("id", F.when(F.col("id") % 5 > 0, F.col("id") % 2).cast("int").alias("y"))
    assert FE.stratified_split(df, "id", "y", 0.2, 42).count() == 100
    one = spark.range(50).select("id", (F.col("id") == 0).cast("int").alias("y"))  # a class of one row: plain split
    plain = FE.train_test_split(one, "id", "y", 0.2, 42)
    assert {tuple(r) for r in plain.collect()} == {tuple(r) for r in FE.hash_split(one, "id", 0.2, 42).collect()}


def test_stratified_split_bucketed_equals_exact(spark):
    df = spark.range(3000).select(F.col("id").alias("id"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    a = FE.stratified_split(df, "id", "y", 0.2, 42, rows_per_bucket=100)
    b = FE.stratified_split(df, "id", "y", 0.2, 42)
    assert {tuple(r) for r in a.collect()} == {tuple(r) for r in b.collect()}
    counts = {r["y"]: r["n"] for r in a.filter("split = 'test'").groupBy("y").agg(F.count("*").alias("n")).collect()}
    assert counts == {0: 400, 1: 200}


def test_single_member_class_still_splits(spark):
    df = spark.createDataFrame([(i, 1 if i == 0 else 0) for i in range(20)], "id long, y int")
    out = FE.stratified_split(df, "id", "y", 0.2, 42)
    assert out.count() == 20


def test_training_gate(spark):
    one_class = spark.createDataFrame([(1,)] * 60, "aprobado int")
    with pytest.raises(ValueError):
        C.check_training_gate(one_class)
    rows49 = spark.createDataFrame([(i % 2,) for i in range(49)], "aprobado int")
    with pytest.raises(ValueError):
        C.check_training_gate(rows49)
    rows50 = spark.createDataFrame([(i % 2,) for i in range(50)], "aprobado int")
    C.check_training_gate(rows50)


def test_binary_text_all_or_nothing(spark):
    df = spark.createDataFrame([("Yes", "Yes"), ("No", "No"), ("maybe", "yes")], "a string, b string")
    out, conv = normalize_binary_columns(df, ["a", "b"])
    assert conv == ["b"]
    assert [r["b"] for r in out.collect()] == [1.0, 0.0, 1.0]
    assert [r["a"] for r in out.collect()] == ["Yes", "No", "maybe"]


def test_two_class_relabel_and_rejects_three(spark):
    df = spark.createDataFrame([("x",), ("z",), ("x",)], "t string")
    out, mapping = relabel_two_classes(df, "t")
    assert [r["t"] for r in out.collect()] == [0, 1, 0]
    with pytest.raises(ValueError):
        relabel_two_classes(spark.createDataFrame([("x",), ("y",), ("z",)], "t string"), "t")


def test_target_dictionaries(spark):
    toks = ["Sí", " si ", "1", "0.7", "Aprobado", "no", "Rechazado", "0", "nan", "", "maybe", "impago", "v", None]
    df = spark.createDataFrame([(t,) for t in toks], "t string")
    prod = [r[0] for r in df.select(normalize_target("t", "production")).collect()]
    clean = [r[0] for r in df.select(normalize_target("t", "cleaner")).collect()]
    assert prod == [1, 1, 1, 1, 1, 0, 0, 0, None, None, None, 0, None, None]
    assert clean == [1, 1, 1, 1, 1, 0, 0, 0, None, None, None, None, 1, None]


def test_number_parsing_rules(spark):
    df = spark.createDataFrame([(v,) for v in [" 1.5 ", "1d", "inf", "nan", "abc", "-2e3", ".5", ""]], "v string")
    assert [r[0] for r in df.select(parse_double("v")).collect()] == [1.5, None, None, None, None, -2000.0, 0.5, None]
    assert [r[0] for r in df.select(missing_to_null("v")).collect()][3] is None


def test_header_normalisation_and_alias_clash(spark):
    assert normalize_name("\ufeff Decisión ") == "decision"
    df = spark.createDataFrame([(1, 2, 3)], "`Edad` int, `age` int, `Salario` int")
    out, renamed = C.remap_columns(df)
    assert out.columns == ["edad", "age", "ingresos_mensuales"]      # existing canonical column wins
    assert renamed == {"salario": "ingresos_mensuales"}
    t = spark.createDataFrame([("Situación  Laboral\t",)], "s string").select(normalize_text("s")).first()[0]
    assert t == "situacion_laboral"


def test_threshold_bands(spark):
    df = spark.createDataFrame([(0.40,), (0.65,), (0.66,)], "p double")
    r = df.select(SC.decision_band("p").alias("a"), SC.decision_band("p", 0.65, 0.40, strict=True).alias("b"),
                  SC.risk_band("p").alias("r")).collect()
    assert [x["a"] for x in r] == ["REVISAR", "REVISAR", "APROBAR"]
    assert [x["b"] for x in r] == ["RECHAZAR", "REVISAR", "APROBAR"]
    assert [x["r"] for x in r] == ["media", "media", "alta"]


def test_unseen_category_encodes_as_zeros(spark):
    train = spark.createDataFrame([("A",), ("B",)], "c string")
    model = FE.encoder_pipeline([], ["c"]).fit(train)
    new = spark.createDataFrame([("A",), ("Z",), (None,)], "c string")
    vecs = [r["features"].toArray().tolist() for r in model.transform(new).collect()]
    assert vecs == [[1.0, 0.0], [0.0, 0.0], [0.0, 0.0]]


def test_auc_ties_and_single_class(spark):
    df = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.4, 1), (0.8, 1)], "probability double, label int")
    assert M.auc(df).first()["auc"] == pytest.approx(0.875)
    one = spark.createDataFrame([(0.1, 1), (0.9, 1)], "probability double, label int")
    assert M.auc(one).first()["auc"] == 0.5


@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
@pytest.mark.parametrize("encoding", ["utf-8", "latin-1", "utf-8-sig"])
def test_csv_sniffing(spark, sep, encoding, tmp_path_factory):
    text = sep.join(["Edad", "Género", "Decisión"]) + "\n" + sep.join(["35", "Sí", "Aprobado"]) + "\n"
    folder = scratch_path(spark, "sniff")
    import os
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, "upload.csv"), "wb") as fh:
        fh.write(text.encode(encoding))
    df = RD.read_csv(spark, folder)
    assert df.columns == ["Edad", "Género", "Decisión"]
    assert tuple(df.first()) == ("35", "Sí", "Aprobado")


def test_friendly_labels(spark):
    df = spark.createDataFrame([("historial_pagos", "Excelente"), ("ingresos_mensuales", None)], "b string, v string")
    r = df.select(SC.friendly_label("b", "v").alias("d"), SC.friendly_label("b").alias("l")).collect()
    assert r[0]["d"] == "Historial de pagos: Excelente"
    assert r[1]["l"] == "Tus ingresos mensuales"


def test_workbook_round_trip(spark):
    import pandas as pd
    pdf = pd.DataFrame({"a": ["1", None, " x "], "b": ["é", "", "3"]})
    back = RD.parse_xlsx(RD.write_xlsx(pdf))
    assert back["a"].tolist() == ["1", None, " x "]
    assert back["b"].tolist() == ["é", "", "3"]


def _file(spark, name, data):
    import os
    folder = scratch_path(spark, "file")
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "wb") as fh:
        fh.write(data)
    return folder


def test_late_single_byte_character_decides_the_encoding(spark):
    lines = ["id;g"] + [f"{i};x" for i in range(200)] + ["200;G\u00e9nero"]
    df = RD.read_csv(spark, _file(spark, "a.csv", "\n".join(lines).encode("latin-1")))
    assert df.filter("id = '200'").first()["g"] == "G\u00e9nero"
    genuine = RD.read_csv(spark, _file(spark, "b.csv", "id;g\n1;\ufffd\u00e9\n".encode()))
    assert genuine.first()["g"] == "\ufffd\u00e9"


def test_quoted_line_break_stays_one_row(spark):
    df = RD.read_csv(spark, _file(spark, "a.csv", b'id,t\n1,"two\nlines ""q"""\n2,one\n'))
    assert [tuple(r) for r in df.orderBy("id").collect()] == [("1", 'two\nlines "q"'), ("2", "one")]


def test_json_array_and_lines(spark):
    a = RD.read_json_records(spark, _file(spark, "a.json", b'[{"id": 1},\n {"id": 2}]'))
    b = RD.read_json_records(spark, _file(spark, "b.json", b'{"id": 1}\n{"id": 2}\n'))
    assert sorted(r["id"] for r in a.collect()) == sorted(r["id"] for r in b.collect()) == [1, 2]


def test_workbooks_without_columns_take_the_union_of_headers(spark):
    folder = scratch_path(spark, "books")
    RD.write_workbooks(spark.createDataFrame([("1", "x")], "a string, b string").coalesce(1), folder + "/one")
    RD.write_workbooks(spark.createDataFrame([("2", "y")], "a string, c string").coalesce(1), folder + "/two")
    got = RD.read_workbooks(spark, folder + "/*")
    assert got.columns == ["a", "b", "c"] and sorted(tuple(r) for r in got.collect()) == [("1", "x", None), ("2", None, "y")]


def test_export_has_a_byte_order_mark_and_a_dated_name(spark):
    import datetime as dt
    import glob
    from riskframe.sources import sinks
    path = sinks.export_csv(spark.createDataFrame([(1, "\u00e9")], "id int, t string"), scratch_path(spark, "out"), "d", dt.datetime(2024, 5, 6, 7, 8, 9))
    assert path.endswith("d_20240506_070809.csv")
    assert open(glob.glob(path + "/part-*")[0], "rb").read().startswith(b"\xef\xbb\xbfid")
    assert RD.read_csv(spark, path).columns == ["id", "t"]


def test_equal_timestamps_give_one_answer(spark):
    rows = [(1, 0, 5), (1, 1, 5), (1, 0, 4)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "k int, v int, ts int").coalesce(1)
        assert tuple(J.latest_per_key(df, "k", "ts", ["v"]).first()) == (1, 1, 5)


def test_lab_refuses_other_targets_and_open_domains(spark):
    from riskframe.plans import jobs
    rows = [(i, float(i % 7), "ab"[i % 2], i % 3) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, x double, c string, y int")
    with pytest.raises(ValueError, match="0/1"):
        jobs.prepare_lab(df, "y", "id")
    with pytest.raises(ValueError, match="0/1"):
        jobs.prepare_lab(df.withColumn("y", F.lit(0.7)), "y", "id")
    with pytest.raises(ValueError, match="both classes"):
        jobs.prepare_lab(df.withColumn("y", F.lit(1)), "y", "id")
    wide = spark.range(1200).select("id", (F.col("id") % 2).alias("y"), F.concat(F.lit("n"), "id").alias("name"))
    with pytest.raises(ValueError, match="name"):
        jobs.prepare_lab(wide, "y", "id")
    constant = spark.range(40).select("id", (F.col("id") % 2).alias("y"), F.lit(3.0).alias("k"), (F.col("id") * 1.0).alias("x"))
    assert jobs.prepare_lab(constant, "y", "id").feature_names == ["x"]


def test_recommendations_with_repeated_ids_keep_one_result_per_row(spark):
    from riskframe import schema as S
    from riskframe.operators import explain as X
    from riskframe.sources import fixtures as fx
    from tests.conftest import SMALL
    rows = fx.applications(spark, SMALL).select(F.lit(1).alias("app_id"), *S.NUMERIC_FEATURES, *S.CATEGORICAL_FEATURES).limit(7)
    got = X.recommendations(rows, "app_id", lambda d: d.withColumn("p", SC.sigmoid(SC.scorecard_z(), clip=None)))
    assert got.count() == 7


def test_encoded_what_if(spark):
    """Against plain Python: top features by weight, flips and clamped moves, the better one, tips and explanation."""
    from riskframe.operators import explain as X
    names, ranges = ["a", "b", "flag"], {"a": (0.0, 10.0), "b": (0.0, 1.5), "flag": (0.0, 1.0)}
    coef = [0.02, -0.1, 0.3]
    rows = [(1, [9.5, 0.5, 0.0]), (1, [0.0, 1.5, 1.0]), (2, [10.0, 0.0, 1.0])]
    df = spark.createDataFrame([(i, x, [(n, c * v) for n, c, v in zip(names, coef, x)]) for i, x in rows],
                               "id int, x array<double>, contribs array<struct<feature:string,impact:double>>")

    def score(x, moves, count):
        weight = F.array(*[F.lit(c) for c in coef])
        base = 0.3 + F.aggregate(F.zip_with(x, weight, lambda v, c: c * v), F.lit(0.0), lambda a, b: a + b)
        return F.concat(F.array(base), F.transform(moves, lambda m: base + F.get(weight, m["slot"]) * (m["value"] - F.get(x, m["slot"]))))

    def plain(x):
        return 0.3 + sum(c * v for c, v in zip(coef, x))

    want = []
    for i, x in rows:
        gains = []
        for k, n in enumerate(names):
            lo, hi = ranges[n]
            moves = [1 - x[k]] if {lo, hi} <= {0.0, 1.0} else [v for v in (min(hi, x[k] + (hi - lo) / 10), max(lo, x[k] - (hi - lo) / 10)) if v != x[k]]
            d = max(((plain([*x[:k], v, *x[k + 1:]]) - plain(x), -m, v) for m, v in enumerate(moves)), default=None)
            if d and d[0] > 0.005:
                gains.append((round(-d[0], 9), n, x[k], round(d[2], 9)))
        want.append((i, round(plain(x), 9), [(n, c, v, -g) for g, n, c, v in sorted(gains)][:4]))
    got = X.encoded_sensitivity(df, "id", names, ranges, score).collect()
    assert sorted((r["id"], round(r["probability"], 9), [(m["feature"], m["current"], round(m["suggested"], 9), round(m["delta"], 9))
                                                        for m in r["improvers"]]) for r in got) == sorted(want)
    tips = {t for r in got for t in r["tips"]}
    assert "Activa «flag» → tu probabilidad subiría +30.0 pts (a 74%)." in tips and X.TIP_NONE in tips
    assert all(r["explanation"].startswith("El modelo (ensemble)") and r["explanation"].count("Δ=") == 3 for r in got)
    med = {n: 0.0 for n in names}
    impacts = X.encoded_ablation(df.drop("contribs"), "id", names, med, score).collect()
    assert sorted((r["id"], r["feature"], round(r["impact"], 9)) for r in impacts) == sorted(
        (i, n, round(c * v, 9)) for i, x in rows for n, c, v in zip(names, coef, x))


def test_the_dirty_upload_is_made_in_one_scan(spark):
    """Rows sent twice come from the same scan, not from a second join."""
    from riskframe.sources import fixtures as fx
    d = fx.dirty(spark, SMALL)
    assert "Union" not in d._jdf.queryExecution().optimizedPlan().toString()
    n = fx.applications(spark, SMALL).count()
    assert n < d.count() < 1.05 * n and d.dropDuplicates().count() == n


def test_blanks_are_stripped_without_a_pattern(spark):
    """All of ``\\s`` and nothing else goes on both sides, without two regular expressions per cell."""
    from riskframe.functions.text import strip_blanks
    texts = [" \t\n\x0b\f\r a b \t\n\x0b\f\r", "", "   ", "x", " x ", None, "a\n\nb\r\n"]
    d = spark.createDataFrame([(t,) for t in texts], "t string").select("t", strip_blanks("t").alias("s"))
    assert [r["s"] for r in d.collect()] == [t if t is None else t.strip(" \t\n\x0b\f\r") for t in texts]
    assert "regexp" not in d._jdf.queryExecution().optimizedPlan().toString()


def test_the_cleaner_reads_its_input_once(spark):
    """Copies, empty rows and empty columns are counted on the deduplicated table."""
    seen = spark.sparkContext.accumulator(0)

    def count(rows):
        for r in rows:
            seen.add(1)
            yield r
    rows = [("1", "x", None, "Si")] * 3 + [(None, None, None, None)] * 2 + [("2", None, None, "No"), (" 2", None, None, "No"), ("3", "", None, "??")]
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2).mapPartitions(count),
                               "edad string, sexo string, notas string, aprobado string")
    out, notes = C.clean_dataset(df)
    assert sorted((r["edad"], r["sexo"], r["aprobado"]) for r in out.collect()) == [(1.0, "x", 1), (2.0, "x", 0), (2.0, "x", 0)]
    assert out.columns == ["edad", "sexo", "aprobado"] and seen.value == len(rows)
    assert {(s, c): n for s, c, _, n in notes.lines} == {("drop_empty_rows", "*"): 2, ("drop_empty_column", "notas"): 0,
                                                         ("drop_duplicates", "*"): 2, ("target_unreadable", "aprobado"): 1, ("mode_fill", "sexo"): 2}
    unread = C.clean_dataset(df.withColumn("aprobado", F.lit(None).cast("string")))[0]  # an empty target goes like any empty column
    assert unread.columns == ["edad", "sexo"] and unread.count() == 4
