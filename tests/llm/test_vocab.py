import random

from hypothesis import given, settings
from hypothesis import strategies as st

from framelake.llm.vocab import Automaton, WordCounts, automaton, count_pieces, read_vocabulary, token_counts

PATH = "/opt/tokenizers/word_bpe_49k.json"


def greedy(pieces, word):
    count = 0
    while word:
        n = next((n for n in range(len(word), 0, -1) if tuple(word[:n]) in pieces), 0)
        if not n:
            return -1
        word, count = word[n:], count + 1
    return count


@settings(max_examples=300, deadline=None)
@given(st.sets(st.text("abc", min_size=1, max_size=5), max_size=12), st.text("abc", max_size=20))
def test_equals_greedy_search(pieces, word):
    assert Automaton(pieces).count(word) == greedy({tuple(p) for p in pieces}, tuple(word))


def test_real_vocabulary_against_greedy_search():
    machine = automaton(read_vocabulary(PATH))
    import json

    letters = __import__("framelake.llm.vocab", fromlist=["x"])._byte_letters()
    vocabulary = set(json.load(open(PATH))["model"]["vocab"])

    def slow(word):
        text = [letters[b] for b in word.encode()]
        text[-1] += "</w>"
        count = 0
        while text:
            n = next(n for n in range(len(text), 0, -1) if "".join(text[:n]) in vocabulary)
            text, count = text[n:], count + 1
        return count

    rng = random.Random(4)
    words = ["ré", "rele", "ciónmente", "the", "!!!", "7", "наука", "日本語", "a" * 200] + ["".join(rng.choice("theinonreédß") for _ in range(rng.randint(1, 14))) for _ in range(300)]
    counts = WordCounts(machine, most=50)
    assert [counts[w] for w in words] == [slow(w) for w in words]


def test_rows(spark):
    rows = [(1, "The the", "x"), (2, None, "x"), (3, "", "x"), (4, " \n\t", "x"), (None, "it's", "x"), (5, "the " * 200_000, "x"), (1, "The the", "x")]
    got = token_counts(spark, spark.createDataFrame(rows, "doc_id int, text string, n_words string"), PATH).collect()
    assert [(r.doc_id, r.n_words, r.n_pieces, r.n_unknown) for r in got] == [(1, 2, 2, 0), (2, 0, 0, 0), (3, 0, 0, 0), (4, 0, 0, 0), (None, 2, 2, 0), (5, 200_000, 200_000, 0), (1, 2, 2, 0)]
    assert token_counts(spark, spark.createDataFrame([], "doc_id int, text string"), PATH).count() == 0


def test_unknown_words_count_as_one_piece():
    import regex

    counts = WordCounts(Automaton([(97,), (97 + 256,)]))
    assert count_pieces("aa b aab", counts, regex.compile(r"\S+")) == (3, 4, 2)
