import random

import public_tokenizers
import pytest
import sentencepiece

from tidemark.llm import sentence_piece

TEXTS = ["", " ", "a", "  a  b ", "a\nb\t c", "ﬁ ①", "　x", "a\x00b", "▁x▁▁y", "x ▁", "naïve 北京 🙂 é", "word " * 2000, "a" * 500, " " * 33 + "x", "<s> </s> <0x41> <unk>", "​z﻿", "x   ", "thththth erer ininin", "aaaaabbbbb" * 30, "0000000000 1111"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(sentence_piece.MODEL))


def test_ids_and_decoding_match_the_library(library):
    rng, own = random.Random(8), sentence_piece.transducer(sentence_piece.MODEL)
    alphabet = ["a", "B", "é", "th", "er", "ing", "on", "the", " ", " ", "  ", "\n", ".", "1", "▁", "中", "🙂", " ", "́", "-", "qz", "ß", "\x01"]
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    for text in texts:
        ids = library.encode(text)
        assert own.encode(text) == ids, repr(text)
        assert own.decode(ids) == library.decode(ids) == own.normalised(text), repr(text)


def test_merging_machine_has_one_path():
    """The general search through the lattice finds what the table of a BPE model finds."""
    rng, own = random.Random(3), sentence_piece.transducer(sentence_piece.MODEL)
    for _ in range(300):
        text = "".join(rng.choice(["a", "th", "er", "▁", "ing", "on", "中", "\x01", "1"]) for _ in range(rng.randint(1, 12)))
        found = sentence_piece.shortest_path(text, own.machine)
        ends = [s for s, _ in found[1:]] + [len(text)]
        assert [text[s:e] for (s, _), e in zip(found, ends)] == own.paths.path(text), text


def built(kind, pieces, rule="identity", own=(), with_bytes=False, **rules):
    """A model of given pieces; nothing is trained."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    if rule != "identity":
        model.normalizer_spec.ParseFromString(pb.NormalizerSpec(precompiled_charsmap=charsmap(rule)).SerializeToString())
    model.normalizer_spec.name = rule
    for k, v in {"add_dummy_prefix": True, "remove_extra_whitespaces": True, "escape_whitespaces": True, **rules}.items():
        setattr(model.normalizer_spec, k, v)
    model.trainer_spec.model_type, model.trainer_spec.byte_fallback = kind, with_bytes
    model.pieces.add(piece="<unk>", score=0, type=2)
    model.pieces.add(piece="<s>", score=0, type=3)
    for p in own:
        model.pieces.add(piece=p, score=0, type=4)
    if with_bytes:
        for b in range(256):
            model.pieces.add(piece=f"<0x{b:02X}>", score=0, type=6)
    for p, s in pieces:
        model.pieces.add(piece=p, score=s, type=1)
    return model.SerializeToString()


def charsmap(rule):
    from sentencepiece import sentencepiece_model_pb2 as pb

    spec = pb.ModelProto()
    spec.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
    return spec.normalizer_spec.precompiled_charsmap


@pytest.mark.parametrize("kind", [1, 2])
@pytest.mark.parametrize("rule,with_bytes,own", [("identity", False, ()), ("nmt_nfkc_cf", True, ()), ("nmt_nfkc", False, ("<x>", "ab")), ("identity", True, ("@@",))])
def test_built_models_match_the_library(kind, rule, with_bytes, own):
    rng = random.Random(kind)
    letters = ["▁", "a", "b", "c", "d", "fi", "▁a", "▁▁"]
    if kind == 1:
        texts = dict.fromkeys(["▁", *"abcdef"] + ["".join(rng.choice(letters) for _ in range(rng.randint(2, 4))).replace("▁", "") or "a" for _ in range(60)] + ["▁" + "".join(rng.choices("abcd", k=rng.randint(1, 3))) for _ in range(30)])
        pieces = [(t, -rng.random() * 8 - 1) for t in texts if t not in own]
    else:  # merges in their order: each piece is made of two earlier ones
        names = ["▁", *"abcdef"]
        while len(names) < 90:
            a, b = rng.choice(names), rng.choice(names)
            if a + b not in names and len(a + b) < 7 and "▁" not in b:
                names.append(a + b)
        pieces = [(t, -float(i)) for i, t in enumerate(names[7:])] + [(t, -1000.0 - i) for i, t in enumerate(names[:7])]
        pieces = [p for p in pieces if p[0] not in own]
    for rules in ({}, {"remove_extra_whitespaces": False}, {"add_dummy_prefix": False}):
        proto = built(kind, pieces, rule, own, with_bytes, **rules)
        library, mine = sentencepiece.SentencePieceProcessor(model_proto=proto), sentence_piece.Transducer(proto)
        alphabet = ["a", "b", "c", "d", "ab", "fe", " ", "  ", "ﬁ", "①", "É", "\u3000", "z", "<x>", "@@", "\t", "ｱ", "ﾞ", "é"]
        for _ in range(600):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14)))
            assert mine.encode(text) == library.encode(text), (rules, text)
            assert mine.decode(mine.encode(text)) == library.decode(library.encode(text)), (rules, text)


def test_query(spark, library):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100, None), (None, "x y"), (0, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 as ids")
    got = sorted(str((r.doc_id, r.n_ids, r.ids, r.restored)) for r in sentence_piece.encode_decode(docs).collect())
    assert got == sorted(str((i, len(x), x, True)) for i, x in ((i, library.encode(t or "")) for i, t in rows))
    assert sentence_piece.encode_decode(docs.limit(0)).count() == 0


def test_remembered_words_take_bounded_memory():
    """A worker's words, however many distinct ones it meets."""
    import tracemalloc

    own = sentence_piece.Transducer(public_tokenizers.path(sentence_piece.MODEL))
    own.word.make = lambda w: w[:4].encode() * 4  # as much as the ids of a word of four pieces
    tracemalloc.start()
    for i in range(599_999):
        own.word[f"word{i}"]
    taken = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert len(own.word) + len(own.word.old) < 250_000 and taken < 60e6
