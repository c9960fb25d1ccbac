"""Passages that are broken into lines below the least length."""

import random

from echomark.llm import paragraphs


def line(draw, n):
    return " ".join("".join(draw.choices("abcdefghij", k=5)) for _ in range(n))


def test_passage_of_short_lines(spark):
    draw = random.Random(8)
    verse = [line(draw, 12) for _ in range(6)]
    long_, short = line(draw, 30), line(draw, 7)
    own = [
        "\n".join([line(draw, 9), *verse, line(draw, 9)]),
        "\n\n".join([line(draw, 40), *(x.upper() for x in verse)]),
        f"{short}\n{line(draw, 11)}\n{short}",
        f"{short}\n{line(draw, 25)}",
        f"{line(draw, 5)}\n{verse[0]}\n{long_}\n{verse[1]}",
        f"{line(draw, 8)}\n{long_}",
        "one line of ten words that the table has twice",
        "\n".join(verse[:1] + [line(draw, 10)] + verse[3:4]),
    ]
    rows = [*enumerate(own), (6, own[6])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r["doc_id"], r["paragraph"], r["sentence"], r["n_words"]) for r in paragraphs.clusters(spark, docs).collect()}
    want = {(0, k, 0, 12) for k in range(1, 7)} | {(1, k, 0, 12) for k in range(1, 7)}
    want |= {(4, 1, 0, 12), (4, 2, None, 30), (4, 3, 0, 12), (5, 1, None, 30)}
    assert got == want
