import pytest

from retentio.operators.evaluation import classification_report, roc_auc
from retentio.operators.split import split_sizes, stratified_folds, stratified_split

# Confusion counts that reproduce the published hold-out reports.
GOLDEN = {
    "M1": ((195, 59, 14, 32), {"0": (0.9330, 0.7677, 0.8423), "1": (0.3516, 0.6957, 0.4672),
                               "accuracy": (0.7567,) * 3, "macro avg": (0.6423, 0.7317, 0.6547),
                               "weighted avg": (0.8439, 0.7567, 0.7848)}),
    "M2": ((206, 48, 15, 31), {"0": (0.9321, 0.8110, 0.8674), "1": (0.3924, 0.6739, 0.4960),
                               "accuracy": (0.79,) * 3, "macro avg": (0.6623, 0.7425, 0.6817),
                               "weighted avg": (0.8494, 0.7900, 0.8104)}),
    "M3": ((210, 44, 18, 28), {"0": (0.9211, 0.8268, 0.8714), "1": (0.3889, 0.6087, 0.4746),
                               "accuracy": (0.7933,) * 3, "macro avg": (0.6550, 0.7177, 0.6730),
                               "weighted avg": (0.8395, 0.7933, 0.8105)}),
}


@pytest.mark.parametrize("model", sorted(GOLDEN))
def test_classification_report_reproduces_published_figures(spark, model):
    (tn, fp, fn, tp), expected = GOLDEN[model]
    conf = spark.createDataFrame([(0, 0, tn), (0, 1, fp), (1, 0, fn), (1, 1, tp)],
                                 "label int, prediction int, n long")
    got = {r["class"]: (r.precision, r.recall, r.f1) for r in classification_report(conf).collect()}
    for k, v in expected.items():
        assert got[k] == pytest.approx(v, abs=1e-4), (k, got[k], v)


def test_roc_auc_average_ranks_on_ties(spark):
    df = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.4, 1), (0.9, 1)], "score double, label int")
    assert roc_auc(df).first().roc_auc == 0.875
    one = spark.createDataFrame([(0.1, 1), (0.4, 1)], "score double, label int")
    assert roc_auc(one).first().roc_auc is None


def test_split_sizes_follow_train_first_allocation():
    assert split_sizes({0: 792, 1: 708}, 0.2) == {0: 158, 1: 142}
    assert split_sizes({0: 1270, 1: 230}, 0.2) == {0: 254, 1: 46}


def test_split_and_folds_are_exact_per_class(spark):
    from retentio.plans.catalog import labeled
    lab = labeled(spark, "/root/testdata/sf0.01")
    s = {(r.churn, r.is_test): r["count"] for r in stratified_split(lab).groupBy("churn", "is_test").count().collect()}
    assert s == {(0, True): 158, (0, False): 634, (1, True): 142, (1, False): 566}
    f = stratified_folds(lab).groupBy("churn", "fold").count().collect()
    sizes = {}
    for r in f:
        sizes.setdefault(r.churn, []).append(r["count"])
    assert sorted(sizes[0], reverse=True) == [159, 159, 158, 158, 158]
    assert sorted(sizes[1], reverse=True) == [142, 142, 142, 141, 141]


def test_split_is_deterministic(spark):
    from retentio.plans.catalog import labeled
    lab = labeled(spark, "/root/testdata/sf0.001")
    a = stratified_split(lab).where("is_test").select("login")
    b = stratified_split(lab.repartition(5)).where("is_test").select("login")
    assert sorted(a.collect()) == sorted(b.collect())
