import pytest
from pyspark.sql import functions as F

from flowlens import schemas as SC
from flowlens.operators import evaluate as E

# Published confusion matrix of a ten-class detector (rows actual, columns predicted, class order of the schema)
# Published matrix, report and training figures.
MATRIX = [
    [93, 96, 23, 412, 16, 0, 37, 0, 0, 0], [93, 88, 23, 348, 17, 6, 2, 0, 6, 0], [206, 721, 426, 2543, 77, 26, 15, 24, 51, 0],
    [301, 703, 141, 9464, 147, 32, 97, 157, 86, 4], [200, 195, 64, 991, 3519, 6, 877, 7, 203, 0],
    [0, 3, 29, 428, 45, 18335, 6, 0, 21, 4], [512, 0, 29, 711, 7491, 4, 28105, 9, 138, 1],
    [15, 84, 14, 501, 14, 1, 6, 2833, 28, 0], [0, 1, 3, 33, 25, 0, 6, 1, 309, 0], [0, 0, 0, 22, 1, 1, 0, 0, 1, 19],
]
# Published report for it (two decimals) and the largest confusions
REPORT = {
    "Analysis": (.07, .14, .09, 677), "Backdoor": (.05, .15, .07, 583), "DoS": (.57, .1, .18, 4089), "Exploits": (.61, .85, .71, 11132),
    "Fuzzers": (.31, .58, .4, 6062), "Generic": (1.0, .97, .98, 18871), "Normal": (.96, .76, .85, 37000),
    "Reconnaissance": (.93, .81, .87, 3496), "Shellcode": (.37, .82, .51, 378), "Worms": (.68, .43, .53, 44),
}
PAIRS = [("Normal", "Fuzzers", 7491), ("DoS", "Exploits", 2543), ("Fuzzers", "Exploits", 991), ("Fuzzers", "Normal", 877), ("DoS", "Backdoor", 721)]
TRAINING = {
    "BENIGN": 1490162, "Bot": 1367, "DDoS": 89611, "DoS GoldenEye": 7200, "DoS Hulk": 120994, "DoS Slowhttptest": 3660,
    "DoS slowloris": 3770, "FTP-Patator": 4153, "Heartbleed": 8, "Infiltration": 25, "PortScan": 63573, "SSH-Patator": 2253,
    "Web Attack - Brute Force": 1029, "Web Attack - SQL Injection": 15, "Web Attack - XSS": 456,
}


def expand(spark, rows, schema):
    """Weighted rows to one row per unit."""
    df = spark.createDataFrame(rows, schema + ", n long").where("n > 0")
    return df.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n")))).drop("i", "n")


@pytest.fixture(scope="module")
def labelled(spark):
    c = SC.UNSW_CLASSES
    return expand(spark, [(c[i], c[j], MATRIX[i][j]) for i in range(10) for j in range(10)], "actual string, predicted string").cache()


def test_report(labelled):
    rows = {r["class"]: r for r in E.classification_report(labelled).collect()}
    for name, (p, r, f, n) in REPORT.items():
        got = rows[name]
        assert (round(got.precision, 2), round(got.recall, 2), round(got.f1, 2), got.support) == (p, r, f, n)
    assert rows["accuracy"].precision == pytest.approx(sum(MATRIX[i][i] for i in range(10)) / 82332, abs=1e-6)
    assert rows["weighted avg"].recall == pytest.approx(rows["accuracy"].recall)
    assert rows["macro avg"].precision == pytest.approx(sum(rows[c].precision for c in SC.UNSW_CLASSES) / 10, abs=1e-6)


def test_matrix_and_pairs(labelled, spark):
    matrix = E.confusion_matrix(labelled, SC.UNSW_CLASSES)
    got = {r.actual: [r[f"predicted_{c}"] for c in SC.UNSW_CLASSES] for r in matrix.collect()}
    assert got == dict(zip(SC.UNSW_CLASSES, MATRIX))
    norm = {r.actual: r for r in E.normalized_confusion(labelled, SC.UNSW_CLASSES).collect()}
    assert norm["Analysis"].predicted_Analysis == 0.137371 and norm["Normal"].predicted_Fuzzers == 0.202459 and norm["Worms"].predicted_Worms == 0.431818
    assert [tuple(r) for r in E.top_confusions(labelled, 5).collect()] == PAIRS
    assert E.top_confusions(labelled, 15).count() == 15 and E.top_confusions(labelled, None).count() == sum(
        MATRIX[i][j] > 0 for i in range(10) for j in range(10) if i != j)
    assert E.expand_matrix(spark, matrix, SC.UNSW_CLASSES).agg(F.sum("n")).first()[0] == 82332


def test_binary_metrics_from_cells(spark):
    cells = spark.createDataFrame([(63859, 336, 318985, 23)], "tp long, fp long, tn long, fn long")
    r = E.with_rates(cells, 9).first()
    want = {"accuracy": 0.9990631597, "precision": 0.9947659475, "recall": 0.9996399612, "f1": 0.9971969987, "fpr": 0.0010522327, "fnr": 0.0003600388}
    for k, v in want.items():
        assert r[k] == pytest.approx(v, abs=1e-9)
    p = E.cell_percentages(cells).first()
    assert (p.tn_percent, p.fn_percent) == (83.24, 0.01)


def test_weights(spark):
    # the published counts give the published weight; the operator is run on a table of 100 rows
    total, k = sum(TRAINING.values()), len(TRAINING)
    assert total / (k * TRAINING["BENIGN"]) == pytest.approx(0.08000365)
    small = expand(spark, [("a", 90), ("b", 9), ("c", 1)], "label string")
    got = {r["class"]: (r.balanced_weight, r.final_weight) for r in E.class_weights(small, "label").collect()}
    assert got == {"a": (0.3704, 0.3704), "b": (3.7037, 3.7037), "c": (33.3333, 20.0)}


def test_sweep_matches_brute_force(spark):
    rows = [(i % 3 == 0, round((i * 37 % 1000) / 1000, 4)) for i in range(1000)] + [(True, 1.0), (False, 0.0), (True, 0.57), (False, 0.57)]
    df = spark.createDataFrame(rows, "pos boolean, s double")
    for start, stop, step in ((50, 99, 1), (10, 95, 5)):
        got = {round(r.threshold, 2): r for r in E.threshold_sweep(df, F.col("pos"), "s", start, stop, step).collect()}
        assert len(got) == len(range(start, stop + 1, step))
        for h in range(start, stop + 1, step):
            t = h / 100
            tp, fp = sum(p and s >= t for p, s in rows), sum(not p and s >= t for p, s in rows)
            assert (got[t].tp, got[t].fp) == (tp, fp)
            assert got[t].tp + got[t].fn == sum(p for p, _ in rows)


def test_best_threshold_takes_the_highest_of_equals(spark):
    sweep = spark.createDataFrame([(0.92, 0.99736), (0.93, 0.9974), (0.94, 0.9974), (0.95, 0.99736)], "threshold double, f1 double")
    assert E.best_threshold(sweep).first().threshold == 0.94


def test_auc(spark):
    rows = [(True, 0.9), (True, 0.8), (False, 0.8), (False, 0.3), (True, 0.3), (False, 0.1)]
    wins = sum(1.0 if a > b else 0.5 if a == b else 0.0 for p, a in rows if p for q, b in rows if not q)
    df = spark.createDataFrame(rows, "pos boolean, s double")
    assert E.roc_auc(df, F.col("pos"), "s").first().roc_auc == pytest.approx(wins / 9, abs=1e-6)


def test_split_is_stratified_and_stable(spark):
    df = expand(spark, [("Bot", 1953), ("rare", 11)], "label string").withColumn("id", F.monotonically_increasing_id().cast("string"))
    df = spark.createDataFrame(df.toPandas())
    split = E.stratified_split(df, "label", "id")
    got = {r.category: r for r in E.split_distribution(split, "label").collect()}
    assert (got["Bot"].train_samples, got["Bot"].validation_samples, got["Bot"].test_samples) == (1367, 293, 293)
    again = E.stratified_split(df.repartition(5), "label", "id")
    assert split.select("id", "split").exceptAll(again.select("id", "split")).count() == 0
    shares = E.sampled_split(df, "id").groupBy("split").count().collect()
    assert {r.split for r in shares} == {"train", "validation", "test"}


def test_calibration(spark):
    rows = [(False, i / 100) for i in range(101)] + [(True, 0.95), (True, 0.2)]
    df = spark.createDataFrame(rows, "pos boolean, s double")
    got = {r.target_fpr: r for r in E.calibrate(df, F.col("pos"), "s", [0.01, 0.1]).collect()}
    assert got[0.1].threshold == pytest.approx(0.9) and got[0.1].recall == 0.5 and got[0.1].fp == 11


def test_classwise_risk(spark):
    rows = [("Bot", "Bot", 0.9, 0.8), ("DDoS", "Bot", 0.5, 0.1), ("BENIGN", "BENIGN", 0.99, 0.98)]
    got = E.classwise_risk(spark.createDataFrame(rows, "actual string, predicted string, confidence double, margin double")).collect()
    assert (got[0].predicted, got[0].median_confidence, got[0].error_rate, got[0].is_attack) == ("Bot", 0.7, 50.0, True)
    assert got[1].predicted == "BENIGN" and not got[1].is_attack
