import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import token_counts

TEXTS = [
    "", " ", "a", "  a  b ", "it's we'll I'D they're 'tis", "a\n\n  b\t\tc \r\n d", "x<|endoftext|>y <|endoftext|><|endoftext|> z",
    "naïve café ŒUVRE Straße 北京 日本語テキスト 🙂🙂 é", "1234567 ²³ Ⅷ ٣٤", " a  b c　d\x85e\x1cf\x0bg\x00h", "###!!! ... --- ===>>>", "word " * 3000, "a" * 3000, " " * 700 + "x" + "\n" * 50,
    "foo_bar.baz(qux)[0] = {'k': \"v\"}; // comment", "x \n y", "end ", "end  ", "\nend", "l'été d'un côté 's 'S",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(token_counts.TOKENIZER))


def random_text(rng):
    alphabet = ["a", "B", "é", "ß", "th", "ing", " ", " ", "  ", "\n", "\t", ".", ",", "'s", "'", "1", "23", "<|endoftext|>", "中", "🙂", " ", "́", "-", "=", "\x1d"]
    return "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))


def test_whole_texts_match_the_library(library):
    rng, own = random.Random(5), token_counts.coder(token_counts.TOKENIZER)
    for text in TEXTS + [random_text(rng) for _ in range(2000)]:
        assert sum(own.sums(text)[1]) == len(library.encode(text).ids), repr(text)


def test_every_prefix_matches_the_library(library):
    rng, own = random.Random(6), token_counts.coder(token_counts.TOKENIZER)
    texts = [t for t in TEXTS if len(t) < 200] + [random_text(rng) for _ in range(150)]
    texts += ["we'll I're x've 'tis 'r", "!!<|endoftext|>!!<|endof", "a  \n b\t\t\tc   ", "中" * 40, "a,b;" * 30, "word\n" * 30]
    for text in texts:
        want = [len(library.encode(text[:i]).ids) for i in range(len(text) + 1)]
        assert own.prefix_counts(text) == want, repr(text)
        stored = token_counts.PrefixCounts(own, text)
        assert [stored.at(i) for i in range(len(text) + 1)] == want
        sums = own.sums(text)
        for budget in (0, 1, 2, 3, 5, 10, 17):
            best = max(i for i, n in enumerate(want) if n <= budget)
            assert stored.fits(budget) == best == own.limit_chars(text, *sums, budget), (text, budget)


def test_limits_of_texts_without_spaces(spark, library):
    texts = ["中" * 5000, "a,b;" * 3000, "word\n" * 3000, "x" * 9000, " " * 3000, "<|endoftext|>" * 1500, "plain words " * 900, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tables = token_counts.prefix_tables(docs).cache()
    cut = {r.doc_id: (r.chars, r.tokens) for r in token_counts.truncated(tables, 1024).collect()}
    for r in token_counts.count_tokens(docs).collect():
        text = texts[r.doc_id]
        assert (r.limit_chars, len(library.encode(text[: r.limit_chars]).ids)) == cut[r.doc_id]
        assert r.limit_chars == len(text) or len(library.encode(text[: r.limit_chars + 1]).ids) > 1024
        assert r.limit_chars > 0 or not text


def test_query(spark, library):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100, None), (None, "x y"), (0, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 as n_tokens")
    got = sorted(map(str, (tuple(r)[:4] for r in token_counts.count_tokens(docs).collect())))
    n = lambda t: len(library.encode(t or "").ids)
    assert got == sorted(str((i, len((t or "").encode()), n(t), n(t) > 1024)) for i, t in rows)
    assert token_counts.count_tokens(docs.limit(0)).count() == 0
