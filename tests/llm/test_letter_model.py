"""The letter model of all whole texts, and rubble in lines of common words."""

import numpy as np

from quern.llm import textkinds


def test_every_whole_text_counts(spark):
    texts = ["the link copies all entries into the project " + "e" * (i % 7) for i in range(2500)] + ["plain words " * 400 + "qz " * 3000, None, " "]
    counts = sum(textkinds.Letters.pairs(t or "") for t in texts).reshape(28, 28) / textkinds.PARTS
    letters = textkinds.letter_model(spark.createDataFrame([(t,) for t in texts], "t string"))
    assert 700 < counts[17, 26] < 1200 and np.allclose(letters.logp, np.log((counts + 5) / (counts + 5).sum(axis=1, keepdims=True)))
    assert abs(letters.usual - np.median([letters.score(t) for t in texts if t and len(t) > 40])) <= 1 / textkinds.STEPS


def test_rubble_among_common_words():
    line = "the#the a~a of|of the#the a~a of|of the#the a~a and to in"
    words = textkinds._WORD.findall(line)
    alpha, solid = sum(map(len, words)), len("".join(line.split()))
    kinds = textkinds.line_scores(line, words, alpha, solid, len(words), False, False)
    assert max(range(4), key=kinds.__getitem__) == 3
