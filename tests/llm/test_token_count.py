import random

import pytest

from cases import CLASHING, DOCS, ODD_IDS, ODD_TEXTS, documents
from palisade.llm import token_count

PIECES = ["a", "B", "'s", "'", " ", "  ", "\n", "\n\n", "1", "23", ".", "!?", "é", "ß", "\t",
          "don't", "word ", " the", "xxxxx", "日本", " ", "🙂"]


@pytest.fixture(scope="module")
def counts():
    return token_count.Counter()


def any_text(r, most):
    return "".join(r.choice(PIECES) for _ in range(r.randint(0, most)))


@pytest.mark.parametrize("leaf", [1, 3, 64])
def test_edited_trees_equal_full_counts(counts, leaf):
    r = random.Random(leaf)
    for _ in range(400):
        text = any_text(r, r.choice([3, 30, 300]))
        document = token_count.Document(text, counts, leaf)
        assert document.tokens == len(counts.encoding.encode_ordinary(text))
        for _ in range(r.randint(1, 6)):
            a = r.randint(0, len(text))
            b = min(len(text), a + r.choice([0, 1, 2, 5, 40]))
            new = any_text(r, r.choice([0, 1, 3, 50]))
            document.edit(a, b, new)
            text = text[:a] + new + text[b:]
            assert document.text() == text and document.length == len(text)
            assert document.tokens == len(counts.encoding.encode_ordinary(text))


def test_an_edit_touches_little(counts):
    text = "some words of a long text, " * 5000
    document = token_count.Document(text, counts)
    document.edit(60_000, 60_004, "other")
    assert document.reencoded < 500
    assert document.tokens == counts.total(text[:60_000] + "other" + text[60_004:])
    with pytest.raises(ValueError):
        document.edit(5, 10 ** 9, "")


def test_clean_up():
    text = "write  to a.b@c.org or\t\tcall 030 123-4567 now"
    edits = token_count.clean_up_edits(text)
    for a, b, new in reversed(edits):
        text = text[:a] + new + text[b:]
    assert text == "write to <mail> or call <number> now"
    assert token_count.clean_up_edits("nothing to do") == []


def test_whole_operator(spark, counts):
    r = random.Random(8)
    texts = [any_text(r, 200) + r.choice(["", " x@y.org ", " 0123456789 "]) for _ in range(120)]
    rows = {x["doc_id"]: x for x in token_count.count_tokens(documents(spark, texts)).collect()}
    for i, text in enumerate(texts):
        edited = text
        for a, b, new in reversed(token_count.clean_up_edits(text)):
            edited = edited[:a] + new + edited[b:]
        assert rows[i]["n_tokens"] == len(counts.encoding.encode_ordinary(text))
        assert rows[i]["n_tokens_edited"] == len(counts.encoding.encode_ordinary(edited))
        assert rows[i]["n_chars_edited"] == len(edited)


def test_odd_rows(spark, counts):
    docs = documents(spark, ODD_TEXTS, ODD_IDS, CLASHING)
    rows = token_count.count_tokens(docs).collect()
    assert sorted(r["n_tokens"] for r in rows) == sorted(counts.total(t or "") for t in ODD_TEXTS)
    given = spark.createDataFrame(
        [(1, "one two", [(4, 7, "three"), (0, 3, "")]), (2, "one", None), (3, None, [])],
        "doc_id bigint, text string, edits array<struct<start:int,stop:int,new:string>>")
    rows = token_count.count_tokens(given, edits_col="edits").collect()
    assert [(r["doc_id"], r["n_edits"], r["n_chars_edited"]) for r in rows] == [
        (1, 2, 6), (2, 0, 3), (3, 0, 0)]
    assert token_count.count_tokens(spark.createDataFrame([], DOCS)).count() == 0
