from inspectra.operators import cleaning, surface


def test_spans_of_lines_are_those_of_their_words(spark):
    """Blank runs, lines without digits, null and empty texts; no word is shuffled."""
    texts = ["a 1 2 b 3\nno digit here\n 12  345 6 \n7", "", None, "1", "x 1\n\n2 3 4 5 6", "٣ 4 -"]
    texts = spark.createDataFrame(list(enumerate(texts)), "document_id long, text string")
    found = surface.line_spans(texts)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    want = surface.token_spans(cleaning.page_tokens(texts)).where("text rlike '[0-9]'")
    rows = lambda df: sorted(map(tuple, df.select("document_id", "line", "pos", "width", "text").collect()))
    assert rows(found) == rows(want) and found.count() > 20
