"""Histories of one file are long: what one task and one worker take of them is not."""

from sylvan.functions import shipping
from sylvan.operators import store as W

from pyspark.sql import functions as F


def windows(df):
    """Windows of the plan, with the columns that they take."""
    plan = df._jdf.queryExecution().optimizedPlan()
    found, queue = [], [plan]
    while queue:
        x = queue.pop()
        if x.nodeName() == "Window":
            found.append((x.partitionSpec().mkString(","), x.child().output().mkString(",")))
        queue += [x.children().apply(k) for k in range(x.children().size())]
    return found


def test_no_task_takes_all_texts_of_a_file(spark, monkeypatch):
    monkeypatch.setattr(W, "RUN", 7)
    texts = {k: "\n".join(f"line {j} {k // 3 if j % 2 else k}" for j in range(6)) + f"\nend {k}" for k in range(40)}
    rows = [("en", k * 5, texts[k]) for k in range(40)] + [("de", k, texts[k]) for k in range(3)] + [("fr", None, None), ("fr", 2, "x")]
    numbered = W.numbered(spark.createDataFrame(rows, "lang string, id long, text string"), ["lang"], "id", "text")
    assert all("text" not in columns or len(spec.split(",")) > 1 for spec, columns in windows(numbered))
    want = {("en", texts[k], k + 1, texts[k - 1] if k else None) for k in range(40)} | {("de", texts[k], k + 1, texts[k - 1] if k else None) for k in range(3)} | {("fr", None, 1, None), ("fr", "x", 2, None)}
    got = [(r["lang"], r["text"], r["n"], r["_prev"]) for r in numbered.collect()]
    assert len(got) == len(want) and set(got) == want

    stored = W.version_rows(numbered.where("lang <> 'fr'").select(F.concat(F.lit("/"), "lang").alias("path"), F.col("text").alias("content"), "_prev", "n"), F.current_timestamp())
    back = W.reconstruct(stored)
    assert all("stored" not in columns for _, columns in windows(back))
    assert {(r["path"], r["version_number"], r["content"]) for r in back.collect()} == {("/" + x[0], x[2], x[1]) for x in want if x[0] != "fr"}


def test_repeated_keys_are_numbered_once_each(spark):
    rows = [("a", 1, "x"), ("a", 1, "x"), ("a", 2, "y")]
    got = W.numbered(spark.createDataFrame(rows, "lang string, id long, text string"), ["lang"], "id", "text").collect()
    assert sorted((r["n"], r["text"], r["_prev"]) for r in got) == [(1, "x", None), (2, "x", "x"), (3, "y", "x")]


def test_batches_to_python_end_at_bytes(spark):
    """Of long texts a batch has fewer rows, so that a worker's memory doesn't follow their length."""
    shipping.ship(spark)
    long = spark.range(400, numPartitions=1).select(F.repeat(F.lit("x"), 100_000).alias("text"))
    sizes = [r[0] for r in long.mapInArrow(lambda batches: ({"n": [b.nbytes]} and __import__("pyarrow").RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long").collect()]
    assert len(sizes) > 3 and max(sizes) < 10 << 20
