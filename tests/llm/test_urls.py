import numpy as np
from pyspark.sql import functions as F

from mirador.llm import url_labels, urls


def test_held_out_urls(spark):
    """A third of the labelled URLs in turn, judged by a model of the others."""
    rows, right, caught, bad = url_labels.rows(), 0, 0, 0
    for part in range(3):
        known = urls.labelled_urls(spark, [r for r in rows if r[0] % 3 != part])
        rest = spark.createDataFrame([(i, u) for i, u, _ in rows if i % 3 == part], "page_id long, url string")
        got = {r.page_id: r.verdict for r in urls.judge(rest, known, rules=[]).collect()}
        for i, _, v in rows:
            if i % 3 == part:
                right += got[i] == v
                bad += v == "block"
                caught += v == got[i] == "block"
    assert right >= 0.85 * len(rows) and caught >= 0.75 * bad, (right, len(rows), caught, bad)


def test_verdicts_equal_the_model_by_hand(spark, tmp_path):
    """Margins recomputed with numpy from the coefficients and the hashed n-grams."""
    model = urls.fit(urls.labelled_urls(spark))
    hashing, logistic = model.stages
    w, b = logistic.coefficients.toArray(), logistic.intercept
    texts = ["http://casino-9.example.net/a", "https://www.quiet-lake.example.org/boats", None, "no scheme", "http://x/" + "long/" * 2000]
    rows = [(i, u) for i, u in enumerate(texts * 2)]
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r for r in urls.op7_url_filter(spark, str(tmp_path)).collect()}
    for i, u in rows:
        host, path = got[i].host, got[i].path
        grams = {m + s[k:k + 3] for m, s in (("h:", f"^{host}$"), ("p:", f"^{path}$")) for k in range(max(len(s) - 2, 1))}
        margin = b + sum(w[k] for k in {hashing.indexOf(g) for g in grams})
        if got[i].rule is None:
            assert got[i].verdict == ("block" if margin > 0 else "allow"), (u, margin)
    assert (got[2].host, got[2].path) == ("", "") == (got[3].host, got[3].path) and len(got) == 10
    assert len(got[4].path) == 10_001 and np.isfinite(w).all()


def test_unseen_spellings(spark):
    pages = spark.createDataFrame([(1, "http://m.casino-win.example.org/en/1"), (2, "http://blog.adult-x.example.org/en/2"),
                                   (3, "http://ththly.example.org/de/3"), (4, "http://tionble.example.org/de/4")], "page_id long, url string")
    got = {r.page_id: r.verdict for r in urls.judge(pages, urls.labelled_urls(spark)).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow"}


def test_labels_are_urls_of_both_classes(spark):
    df = urls.labelled_urls(spark)
    n = {r.verdict: r["count"] for r in df.groupBy("verdict").count().collect()}
    assert min(n.values()) >= 70 and df.where("host = ''").count() == 0
    assert df.select("host", "path").distinct().count() == df.count() and df.where(F.col("host") != F.lower("host")).count() == 0
