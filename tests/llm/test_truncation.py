import random

import pytest

from spindrel.llm.truncation import longer_values, truncated, truncation_report

SENTENCES = [
    "The cost is {n} ms per query, i.e. 20 times less than before.", "We release a collection of {n} passages about optics.", "Earlier reports on patents assumed a dense index; we rewrite that assumption.",
    "Each sampler is stored beside the balanced partition of the archive.", "When the robust shard drifts, both engines only disagree about every cluster.", "In short, any log narrows the archive at {n} percent.",
]

WHOLE = [
    "Modular Prototype for Hybrid Anchor", "- Add sparse vector to the loader\n- Drop the hybrid option\n", "The result holds.\nKeywords: index, shard, query", "It holds.\nhttps://a.papers.invalid/abs/123456",
    "Scores follow.\n| A | 0.5 |\n| B | 0.7 |", "```\n>>> search(k=3)\n```\n", '{"id": 1, "title": "On Words", "abstract": "It ends.", "year": 2019}', "It was late.\n— Losol Fenpel", "It holds.\n\nThanks  in  advance", "\ufeff" + '{"id": 2, "title": "On Words", "abstract": "It ends.", "year": 2019}', "It holds.\nPalabras  clave:  index,  shard", "Does it hold? Yes! 😀", "Seen on Ralota-19.", "The log says: “firga ...”.",
]

CUT = [
    "It holds. The cost is 0.55 ms per qu", "It holds. We release a collection of", "It holds. Each sampler is stored beside the ba [truncated]", "It holds. When the robust shard drifts...", "It holds. Earlier reports on…  ", "It holds. The cost is\n\n[Read more]",
    '{"id": 1, "title": "On Words", "abstract": "It ends. The cost', "It holds. We release a collection &am", "It holds. Each sampler is stored, e.g.", "It holds.\n\nIn short, [...]", "So it is.\n\nIn short,", "And so on.\n\nIn short,", "Scores follow.\n| A | 0.5 |\n| B |", "Look:\n```\n>>> sea", "It holds. When the robust �", "It holds.\n- Rename `index_shard` to `vec",
]


def corpus(n=120, seed=8):
    r = random.Random(seed)
    return [" ".join(r.choice(SENTENCES).format(n=r.randint(1, 99)) for _ in range(r.randint(2, 6))) for _ in range(n)] + ["It holds.\n\nThanks in advance", "So be it.\n\nThanks in advance", "Add partition to the loader. Rename the index and the collection."] * 2


def frame(spark, texts):
    return spark.createDataFrame([(i, t, f"s{i % 3}" if i % 7 else None, True, 0) for i, t in enumerate(texts)], "doc_id long, text string, source string, cut boolean, row int")


def verdicts(spark, texts):
    return {r["doc_id"]: r for r in truncated(frame(spark, texts)).collect()}


def test_kinds_of_endings(spark):
    texts = WHOLE + CUT + corpus()
    got = verdicts(spark, texts)
    wrong = [texts[i] for i in range(len(WHOLE)) if got[i]["cut"]] + [texts[i] for i in range(len(WHOLE), len(WHOLE) + len(CUT)) if not got[i]["cut"]]
    assert not wrong
    assert not [texts[i] for i in range(len(WHOLE) + len(CUT), len(texts)) if got[i]["cut"]]


def test_random_cuts_are_found(spark):
    r = random.Random(9)
    whole = corpus(200)
    texts = whole[:]
    for i in range(0, 200, 4):
        at = r.randint(30, len(texts[i]) - 2)
        texts[i] = texts[i][:at]
    got = verdicts(spark, texts)
    cases = [i for i in range(0, 200, 4) if not texts[i].rstrip().endswith(".")]
    assert sum(got[i]["cut"] for i in cases) >= 0.95 * len(cases)
    assert not [texts[i] for i in range(200) if i % 4 and got[i]["cut"]]


def test_prefixes_of_longer_values(spark):
    long = "A value that is much longer than the shortest prefix that is hashed, and goes on. And on."
    texts = [long, long[:40], long[:40], long[:70], long, long[:10], long[:33] + "#" + long[34:], "x" * 9000, "x" * 8500]
    df = spark.createDataFrame(list(enumerate(texts)), "key long, body string")
    assert {r["key"]: r["in_word"] for r in longer_values(df).collect()} == {1: True, 2: True, 3: True, 8: True}
    # a value that ends with a sentence isn't cut, though it goes on elsewhere; a title that goes on in its line is
    title = "The Modular Prototype of Interpretable Archives for Hybrid Anchors"
    rows = [long, long[: long.index(" And")], title, title[:-15], title[:-10], title + "\n\nIt holds."]
    got = {r["doc_id"]: (r["cut"], r["in_value"]) for r in truncated(spark.createDataFrame([(i, t, "s") for i, t in enumerate(rows)], "doc_id long, text string, source string")).collect()}
    assert got == {0: (False, False), 1: (False, True), 2: (False, True), 3: (True, True), 4: (True, True), 5: (False, False)}


def test_null_empty_and_report(spark):
    texts = [None, "", "  \n ", "​", "It holds.", "It holds. The cost is"] + corpus(30)
    got = verdicts(spark, texts)
    assert not set(got) & {0, 1, 2, 3} and not got[4]["cut"] and got[5]["cut"]
    report = truncation_report(frame(spark, texts)).collect()
    assert sum(r["texts"] for r in report) == len(texts) - 4 and any(r["source"] is None for r in report)
    assert truncated(frame(spark, texts).where("false")).count() == 0


@pytest.mark.parametrize("length", [60_000])
def test_very_long_text(spark, length):
    text = "It holds well. " * (length // 15)
    got = verdicts(spark, [text, text + "The cost is", *corpus(20)])
    assert not got[0]["cut"] and got[1]["cut"]


def test_titles_cut_to_the_same_fragment(spark):
    common = [f"We describe dense retrieval in setting {i}. It holds." for i in range(40)]
    cut_titles = ["A Modular Approach for Hybrid Retrie", "A Modular Approach for Hybrid Retrie", "On Robust Anchors of Sparse Retrie"]
    got = verdicts(spark, [*cut_titles, "On Robust Anchors of Sparse Retrieval", *common])
    assert [got[i]["cut"] for i in range(4)] == [True, True, True, False]


def cut_corpus(seed=11, n=240):
    """Texts of which every fourth is cut at a random place, and the numbers of those that don't happen to end with a sentence."""
    r = random.Random(seed)
    texts = corpus(n, seed)[:n]
    for i in range(0, n, 4):
        texts[i] = texts[i][: r.randint(30, len(texts[i]) - 2)]
    return texts, {i for i in range(0, n, 4) if not texts[i].rstrip().endswith(".")}


def test_joins_decide_and_frames_do_not(spark, monkeypatch):
    texts, cases = cut_corpus()
    found = {i for i, r in verdicts(spark, texts).items() if r["cut"]}
    assert len(found & cases) >= 0.95 * len(cases) and len(found - cases) <= 0.05 * len(found)
    # no frames, short forms: little is lost
    rows = verdicts(spark, texts)
    assert len({i for i in found if rows[i]["framed"] is None}) >= 0.95 * len(found)
    # no end goes on elsewhere: nothing is left
    monkeypatch.setattr("spindrel.llm.truncation.GOES_ON", -1.0)
    monkeypatch.setattr("spindrel.llm.truncation.LEAST_USES", 1 << 40)
    monkeypatch.setattr("spindrel.llm.truncation.LEAST_VALUE", 1 << 30)
    assert len({i for i, r in verdicts(spark, texts).items() if r["cut"]} & cases) <= 0.1 * len(cases)
