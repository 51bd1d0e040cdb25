"""Token counts against the tokenizers library and against merging by hand."""

import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loglattice.llm.token_counts import Counter, merged_length, token_counts

WORDS = public_tokenizers.path("word_bpe_49k.json")


def by_hand(symbols, ranks):
    """The lowest rank of all pairs, leftmost first, again and again."""
    while True:
        pairs = [(ranks[p], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in ranks]
        if not pairs:
            return len(symbols)
        i = min(pairs)[1]
        symbols = [*symbols[:i], symbols[i] + symbols[i + 1], *symbols[i + 2 :]]


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=40), st.integers(0, 1000))
def test_merging_by_hand(word, seed):
    rng, symbols, pairs = random.Random(seed), list("abc"), []
    for _ in range(12):
        a, b = rng.choice(symbols), rng.choice(symbols)
        if (a, b) not in pairs and a + b not in symbols:
            pairs.append((a, b))
            symbols.append(a + b)
    ranks = {p: r for r, p in enumerate(pairs)}
    assert merged_length(list(word), ranks, [a + b for a, b in pairs]) == by_hand(list(word), ranks)


def test_counter_equals_the_library():
    random.seed(2)
    parts = [*"ab1'.,! \n\t\r\x0b\x1c\x85\xa0  é×÷ÀΣςé中あ👍<|>s_İſKǺ", "<|endoftext|>", "<|startoftext|>", "don't", " I'll", "''s", " Word", "Überß", "'RE"]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 50))) for _ in range(4000)] + ["", " ", "x" * 5000, "é!" * 3000]
    counter, library = Counter(WORDS, most=500), Tokenizer.from_file(WORDS)
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert counter.fast
    for at_once in (1, 40, 1 << 22):
        assert [counter.count(t.encode(), at_once) for t in texts] == want
    counter.fast = None
    counter.clear()
    assert [counter.count(t.encode()) for t in texts] == want


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        Counter(public_tokenizers.path("byte_bpe_50k.json"))


def test_counts_of_odd_documents(odd_docs, no_docs, rows):
    docs = odd_docs.withColumn("n_tokens", F.lit("clash")).withColumn("raw", F.lit("clash")).withColumn("key", F.lit("clash"))
    library = Tokenizer.from_file(WORDS)
    want = []
    for r in odd_docs.collect():
        text = r["text"] or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        want.append((r["doc_id"], len(text.encode()), n, n > 100))
    got = token_counts(docs, WORDS, limit=100)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert rows(got) == sorted(want, key=repr)
    assert any(w[3] for w in want) and not all(w[3] for w in want)
    assert token_counts(no_docs, WORDS).count() == 0


def test_counts_of_the_shared_documents(spark, sf_dir, rows):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    library = Tokenizer.from_file(WORDS)
    want = [(r["doc_id"], len(library.encode(r["text"] or "", add_special_tokens=False).ids)) for r in docs.collect()]
    assert rows(token_counts(docs, WORDS).select("doc_id", "n_tokens")) == sorted(want, key=repr)
