"""What suffix_dedup writes between its steps."""
from feedyard.llm import suffixmerge as SM


def test_remove_stages_a_text_once_and_keeps_nulls(spark, monkeypatch):
    block = " ".join(f"w{i:03d}" for i in range(60))
    rows = [(1, block + " tail one", 309, "x"), (2, "head " + block, 304, None), (3, None, None, "y"), (4, "", 0, "z"), (4, "plain é text", 12, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, source string")
    seen = []
    monkeypatch.setattr(SM, "stage", lambda df, kind, was=SM.stage: (seen.append(df.schema), was(df, kind))[1])
    out = SM.remove(docs, length=101, words=50)
    assert out.columns == docs.columns
    got = sorted((tuple(r) for r in out.collect()), key=lambda r: (r[0], r[2] or 0))
    assert got == [(1, " tail one", 9, "x"), (2, "head ", 5, None), (3, None, None, "y"), (4, "", 0, "z"), (4, "plain é text", 12, "z")]
    staged = [s["doc"].dataType.names for s in seen if "doc" in s.names]
    assert staged and all("text" not in names for names in staged)
