"""The quality rules against a plain Python version, with the odd inputs."""

import re

from pyspark.sql import functions as F

from veriframe.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
        len(words) < 10 or 100 * len(covered) > 20 * len(words),
    )


TEXTS = [
    None, "", "  \n ", "one", "a b c d e f g h i j", "a b c d e " * 3, "x\n\nx\ny\n x", "# * $ % & | < > end", "  é  日本",
    "SHOUTING " * 12, "w " * 30, " ".join(f"w{i}" for i in range(60)), "a b c d e f a b c d e g h i j k l m n o p",
    " ".join(f"w{i % 7}" for i in range(3000)), "a\x0bb\x0cc\rd\te",
]


def test_measures_and_odd_rows(spark):
    rows = [(k, t, "w", 1) for k, t in enumerate(TEXTS)] + [(None, "a", None, 1), (3, "one", "w", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, words string, n_words int")
    m = F.col("_quality")
    found = quality.judge(docs).select("doc_id", "text", m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words, quality.base_failed(m), "words", m.kept).collect()
    assert len(found) == len(rows)
    for r in found:
        assert tuple(r[2:8]) == brute(r.text), r.text
        assert not (r[7] and r[9])


def test_table_decides(spark):
    good = "The cat sat on the mat and it was glad to be in the warm sun for a long while. " * 1 + " ".join(f"the w{i}" for i in range(40))
    bad = {"symbol_ratio": good + " # # # # # # # # # # # # # # # # #", "upper_case_ratio": " ".join(f"WORDWORD{i} the" for i in range(50)), "stop_word_ratio": " ".join(f"word{i}" for i in range(50))}
    docs = spark.createDataFrame([("good", good), *bad.items()], "doc_id string, text string")
    found = {r[0]: r[1] for r in quality.judge(docs).select("doc_id", "_quality.broken").collect()}
    assert found.pop("good") is None
    assert found == {k: k for k in bad}


def test_empty_table(spark):
    assert quality.judge(spark.createDataFrame([], "doc_id long, text string")).count() == 0
