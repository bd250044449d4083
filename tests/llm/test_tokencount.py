from pathlib import Path

from hypothesis import given, settings
from hypothesis import strategies as st

from rosterflow.llm import tokencount
from rosterflow.llm.packing import default_tokenizer


def greedy(word, vocabulary):
    at = n = 0
    while at < len(word):
        size = next((k for k in range(len(word) - at, 1, -1) if word[at : at + k] in vocabulary), 1)
        at, n = at + size, n + 1
    return n


def test_query_against_greedy_matching(spark, sf):
    vocabulary = set(tokencount.surfaces(Path(default_tokenizer()).read_text(encoding="utf-8")))
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    words = {r.doc_id: r.text.encode().lower().split() for r in rows}
    memo = {w: greedy(w, vocabulary) for own in words.values() for w in own}
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in tokencount.op2_token_counts(spark, sf).collect()}
    assert got == {d: (len(own), sum(memo[w] for w in own)) for d, own in words.items()}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=6), max_size=12), st.lists(st.text("abcd", max_size=20), max_size=5))
def test_automaton_against_greedy_matching(vocabulary, words):
    vocabulary = [v.encode() for v in vocabulary]
    automaton = tokencount.LongestMatch(vocabulary)
    for word in words:
        assert automaton.count(word.encode()) == greedy(word.encode(), set(vocabulary))


def test_odd_rows(odd, none):
    got = {(r.doc_id, r.n_words, r.n_tokens) for r in tokencount.token_counts(odd).collect()}
    assert {(2, 0, 0), (4, 0, 0), (6, 0, 0)} <= got and len(got) == len({(r.doc_id, r.text) for r in odd.collect()})
    assert tokencount.token_counts(none).count() == 0
