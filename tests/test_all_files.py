"""The index and the edits cover documents, pages and conversations."""

from sylvan import catalog


def test_pages_and_conversations(spark, tmp_path):
    text = "Released under the MIT License."
    tables = {
        "documents": ([(1, "plain", "en", "s")], "doc_id long, text string, lang string, source string"),
        "pages": ([(7, f"xyz {text}")], "page_id long, html string"),
        "conversations": ([(2, 0, text), (2, 1, "XYZ")], "conv_id long, turn long, text string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    run = lambda name: catalog.QUERIES[name](spark, str(tmp_path)).collect()
    grams = {r["gram"]: (r["n"], r["files"]) for r in run("trigram_postings")}
    assert grams["xyz"] == (2, 2) and grams["pla"] == (1, 1)
    both = {"/pages/7.html", "/conv/2/0.md"}
    assert {r["path"]: r["content"] for r in run("edit_exact_replace_all")} == {"/pages/7.html": "xyz Released under the MIT Licence.", "/conv/2/0.md": "Released under the MIT Licence."}
    assert {r["path"] for r in run("edit_fuzzy")} == both
