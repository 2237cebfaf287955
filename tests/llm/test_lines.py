"""Recurring lines that are short, or that only a few documents share word for word."""

from causalpanel.llm import linededup


def cut_texts(spark, rows):
    found = linededup.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    return {r["doc_id"]: r["text"] for r in found.collect()}


def own(k):
    return " ".join(f"{'abcdefghijklmnopqrst'[k]}{x}" for x in ("one", "two", "three", "four", "five"))


def test_short_lines_go_by_the_same_count(spark):
    rows = [(k, f"{own(k)}\nAll rights reserved.\n{'Read more' if k < 9 else 'Go'}\n\nPage {k}\n{k}") for k in range(20)]
    found = cut_texts(spark, rows)
    assert found[0] == rows[0][1]
    assert all(found[k] == f"{own(k)}\nRead more\n\n{k}" for k in range(1, 9))  # nine documents are too few
    assert found[9] == f"{own(9)}\nGo\n\n9" and all(found[k] == f"{own(k)}\n\n{k}" for k in range(10, 20))


def test_lines_shared_word_for_word_by_a_few_documents_go(spark):
    passage = " ".join(f"word{k}" for k in range(51))
    licence = "This is free software of 2007 under a licence"
    rows = [(k, "\n".join([own(k), *([passage] if k in (4, 7) else []), *([licence] if k in (1, 2, 3) else []), *(["only two documents share this"] if k in (5, 6) else []), f"seen on day {k} of the week"])) for k in range(9)]
    found = cut_texts(spark, rows)
    for k, text in rows:
        gone = passage if k == 7 else licence if k in (2, 3) else None
        assert found[k] == "\n".join(x for x in text.split("\n") if x != gone)
