"""Words of long answers, split once."""

from test_slots import most_rows

from korvane.functions import texts


def test_context_words_split_texts_once(spark):
    long = " ".join(f"{'abcdefghij'[i % 10]}{'abcdefghij'[i // 10 % 10]}wordy" for i in range(3000))
    rows = [(1, 0, "assistant", "never these older words"), (1, 1, "assistant", "later alpha ab alpha"), (1, 2, "user", "users words"), (1, 3, "assistant", "Alpha beta; gamma x"), (2, 0, "assistant", None), (2, 1, "assistant", long), (3, 0, "user", "nothing here")]
    out = texts.context_words(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {}
    for r in sorted(out.collect(), key=lambda r: (r["conv_id"], r["place"])):
        got.setdefault(r["conv_id"], []).append(r["word"])
    assert got == {1: ["alpha", "gamma", "later"], 2: ["aawordy", "bawordy", "cawordy", "dawordy", "eawordy"]}
    assert most_rows(out) < 100
