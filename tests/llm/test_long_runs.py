"""Languages of texts whose runs without white space are long."""

import random

from pagelens.llm import langid

POOLS = {"aa": "kalomi renato visuka mopela".split(), "bb": "\u6c34\u706b\u6728\u91d1 \u571f\u65e5\u6708\u661f \u5c71\u5ddd\u8349\u82b1".split()}


def words(lang, n, seed):
    r = random.Random(seed)
    return [r.choice(POOLS[lang]) for _ in range(n)]


def test_every_letter_of_a_run_counts():
    model = langid.fit([(lang, langid.words_of(" ".join(words(lang, 20, i)))) for lang in POOLS for i in range(40)])
    label = langid.Labeller(model).label
    for lang, other in (("aa", "bb"), ("bb", "aa")):
        # the run starts with 16 letters or more of the other language, and ends with three of it
        run = "".join(words(other, 5, 1))[:16] + "".join(words(lang, 60, 2)) + words(other, 1, 3)[0][:3]
        got, score = label([run])[0]
        assert got == lang and score > 0.8
        assert label(["_".join(words(lang, 30, 4))])[0][0] == lang


def test_pieces_hold_the_whole_run_in_fitting_and_prediction():
    run = "".join(chr(97 + i % 26) for i in range(100))
    assert langid.words_of(f"Ab {run} c") == ["ab", *[run[i:i + 16] for i in range(0, 100, 16)], "c"]
    assert max(map(len, langid.words_of(run))) == langid.LETTERS
    assert langid.words_of("a" * 16) == ["a" * 16]
