"""Copies and partitions don't change what is disclosed."""

from sylvan.llm import pii

PROSE = ["alpha", "beta", "gamma", "delta", "omega", "kappa", "sigma", "theta"]


def letters(k):
    return "qq" + "".join(chr(97 + int(c)) for c in str(k))


def test_copies_and_partitions_leave_spans(spark):
    """The term and the entity are always together, in 4 texts; then one is copied over many batches, with other numbers too."""
    told = [(k, f"{PROSE[k]} zorblax writes from z@corp.example.com {letters(k)}") for k in range(4)]
    rows = told + [(k, f"{PROSE[k % 8]} {PROSE[k // 8 % 8]} writes {letters(k)}") for k in range(4, 64)]
    more = [(1000 + k, told[0][1]) for k in range(1500)] + [(3000 + k, f"{told[0][1]} {k}") for k in range(1500)]
    spans = lambda rows, n: {r["doc_id"]: r["spans"] for r in pii.find_personal(spark.createDataFrame(rows, "doc_id long, text string").repartition(n)).collect() if r["doc_id"] < 64}
    plain = spans(rows, 1)
    assert all("remove" in plain[k] for k in range(4)) and not any(plain[k] for k in range(4, 64))
    assert spans(rows + more, 40) == plain == spans(rows + more, 3)
