import random
import re
from collections import Counter

import pytest

from spindrel.llm import versions
from spindrel.llm.versions import Versions

SCHEMA = "id long, title string, abstract string, ingested_at long, words string, rep long"


def papers(n=120, seed=6, hot=0):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghijklm") for _ in range(r.randint(3, 8))) for _ in range(1500)]
    common = "the of a with and on is we that per from".split()
    rows = []
    for i in range(n):
        words = [r.choice(common) if r.random() < 0.3 else r.choice(vocabulary) for _ in range(r.randint(50, 110))]
        rows.append((i * 10, f"On {words[0]}", " ".join(words)))
        for j in range(r.choice([0, 0, 1, 2])):
            edited = list(words)
            for _ in range(r.randint(0, len(words) // 8)):
                k = r.randrange(len(edited))
                edited[k : k + r.choice([0, 1])] = [r.choice(vocabulary)] if r.random() < 0.7 else []
            r.random() < 0.3 and r.shuffle(edited)
            rows.append((i * 10 + j + 1, f"ON {words[0]}!", ", ".join(edited).upper()))
    rows += [(100_000 + i, rows[0][1], rows[0][2]) for i in range(hot)]
    return rows


def brute(rows, share=0.75):
    bags = {i: Counter(re.findall("[a-z0-9]+", f"{t} {a}".lower())) for i, t, a in rows if i is not None and t and a}
    bags = {i: b for i, b in bags.items() if b}
    ids = sorted(bags)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (bags[a] & bags[b]).total() >= share * max(bags[a].total(), bags[b].total())}


def frame(spark, rows):
    return spark.createDataFrame([(i, t, a, k, "clash", 0) for k, (i, t, a) in enumerate(rows)], SCHEMA)


def found(v):
    rows = [(r["id_a"], r["id_b"]) for r in v.pairs().collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("hot", [2_000, 10])
def test_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(versions, "HOT", hot)
    rows = papers(hot=60)
    rows += [(None, "a b", "c d"), (1_000_001, None, "a b c"), (1_000_002, "", "a b c"), (1_000_003, "?", "!!"), (1_000_004, "tiny", "text"), (1_000_005, "Tiny!", "TEXT"), rows[0], rows[5]]
    want = brute(rows)
    got = found(Versions(frame(spark, rows)))
    assert not got - want and len(got) >= 0.99 * len(want)


def test_latest_delivery_and_long_texts(spark):
    long = " ".join(f"w{i % 4000}" for i in range(20_000))
    rows = [(1, "t", "old words here"), (1, "t", long), (2, "t", long + " more"), (3, "t", "old words here")]
    assert found(Versions(frame(spark, rows))) == {(1, 2)}


def test_groups_have_a_row_per_record(spark):
    rows = papers(40, hot=5)
    got = {r["id"]: r for r in Versions(frame(spark, rows)).groups().collect()}
    assert set(got) == {i for i, *_ in rows}
    for a, b in brute(rows):
        assert got[a]["group_id"] == got[b]["group_id"]
    assert got[100_000]["class_id"] == 0 and got[100_000]["group_id"] == 0


def test_empty(spark):
    empty = frame(spark, [])
    assert Versions(empty).pairs().count() == 0 and Versions(empty).groups().count() == 0


def test_shared_words_count_repeats(spark):
    rows = [(1, "a", "b b b b c"), (2, "a", "b b b b d"), (3, "a", "b c d e f")]
    assert found(Versions(frame(spark, rows), share=0.8)) == {(1, 2)}


def test_tables_have_few_rows_a_record_at_every_size():
    for n in (0, 1, 50_000, 8_000_000, 40_000_000):
        segments, symbols = versions.layout(n)
        assert segments <= 80 and (1 - versions.AGREE**symbols) ** segments <= versions.MISS
    assert versions.layout(8_000_000)[0] <= 40  # disk of 4 times the input at 6 GB


def test_pairs_near_the_least_share_are_found(spark):
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(20_000)]
    rows = []
    for i in range(600):
        words = r.sample(vocabulary, 100)
        edited = [w if k % 4 else r.choice(vocabulary) + "x" for k, w in enumerate(words)]
        rows += [(2 * i, "t", " ".join(words)), (2 * i + 1, "t", " ".join(edited))]
    want = {(2 * i, 2 * i + 1) for i in range(600)}
    got = found(Versions(frame(spark, rows)))
    assert got <= want and len(got) >= 0.985 * len(want)
