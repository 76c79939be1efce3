import random

import pytest

from spindrel.llm.tokenizer import PrefixTable, encoder, merge_pairs, vocabulary_path
from spindrel.llm.tokens import count_tokens, encode_corpus, token_budget

TEXTS = [
    "Hello world", "don't  we'll\n\n x", "  lead and trail  ", "a\tb\r\nc", "<|endoftext|> is text", "  ​ blank", "日本語のテキスト", "emoji 😀🚀 é ß",
    "x" * 700, "=" * 900, " " * 333 + "end", "1234567890 3.14159", "\x1c \x1d ctrl \x85", "İstanbul K", "naïve café résumé", "�", "a" + "́" * 40,
]


@pytest.fixture(scope="module")
def reference():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


def test_encoder_is_the_tokenizer(reference):
    own = encoder(vocabulary_path())
    r = random.Random(3)
    alphabet = "abcdefghij ABC 123 .,;-\n\téüñ日本😀'"
    for text in TEXTS + ["".join(r.choice(alphabet) for _ in range(r.randint(1, 80))) for _ in range(400)]:
        assert own.encode(text) == reference(text), repr(text)
    assert own.encode(None) == own.encode("") == []


def test_every_prefix_has_its_own_encoding():
    own = encoder(vocabulary_path())
    raw = b"unbelievablyinterpretable"
    last = own.extend(raw, [])
    for n in range(1, len(raw) + 1):
        assert own.backwards(last[:n]) == merge_pairs(raw[:n], own.ranks)


def test_appends_and_edits():
    own = encoder(vocabulary_path())
    r = random.Random(4)
    source = " ".join(TEXTS[:8])
    for _ in range(150):
        table = PrefixTable(own, source[: r.randint(0, len(source))])
        text = table.text
        for _ in range(4):
            piece = source[(k := r.randint(0, 60)) : k + r.randint(0, 15)]
            if r.random() < 0.5:
                table.append(piece)
                text += piece
            else:
                a = r.randint(0, len(text))
                b = min(len(text), a + r.randint(0, 12))
                table.edit(a, b, piece)
                text = text[:a] + piece + text[b:]
            assert table.text == text and table.ids == own.encode(text)


def test_an_edit_encodes_only_its_surroundings():
    table = PrefixTable(encoder(vocabulary_path()), "the quick brown fox jumps " * 200)
    assert table.edit(2500, 2503, "cat") < 12
    assert table.append(" over") < 5


def test_encode_corpus(spark, reference):
    rows = [(1, "Hello", "k"), (2, "", "k"), (3, None, "k"), (4, " \n\t ", "k"), (5, "long " * 20000, "k"), (1, "Hello", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted((r["doc_id"], r["ids"]) for r in encode_corpus(df).collect())
    assert got == sorted((k, reference(t) if t else []) for k, t, _ in rows)
    assert encode_corpus(df.where("false")).count() == 0
    counted = {r["doc_id"]: r["n_tokens"] for r in count_tokens(df).collect()}
    assert counted == {k: len(ids) for k, ids in got}


def test_budget(spark):
    schema = "id long, text string, source string, lang string, categories array<string>, ingested_at timestamp, tokens string"
    at = "2024-01-0{}T00:00:00"
    rows = [
        (1, "one two", "Src_A ", "EN", ["??", "CS.ir "], 1), (1, "one two", "src-a", "en", ["cs.IR"], 2), (2, "one two", "src a", "en-US", [None, "cs.IR"], 1),
        (3, None, None, None, None, 1), (4, "", "src-a", "", [], 1), (5, "x", "*", "de", ["zz"], 1),
    ]
    df = spark.createDataFrame([(*r[:5], None, "clash") for r in rows], schema)
    from pyspark.sql import functions as F

    df = df.withColumn("ingested_at", F.to_timestamp(F.lit(at.format(1))))
    taxonomy = spark.createDataFrame([("cs.IR", "computing")], "category string, domain string")
    got = {(r["source"], r["lang"], r["domain"]): (r["docs"], r["tokens"]) for r in token_budget(df, taxonomy).collect()}
    assert got[("src-a", "en", "computing")] == (2, 4)
    assert got[("*", "*", "*")] == (5, 5)
    assert got[("unknown", "und", "unknown")] == (1, 0)
    assert got[("\\*", "de", "unknown")] == (1, 1)
    assert token_budget(df.where("false"), taxonomy).count() == 0
    assert token_budget(df, taxonomy.where("false")).where("domain not in ('*', 'unknown')").count() == 0
