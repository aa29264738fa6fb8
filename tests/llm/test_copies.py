import collections
import json
import re

from phraselode.llm import copies

SCHEMA = "cand_id bigint, topic string, doc string, candidate string, mentions array<string>, first_start int, first_end int, n_mentions int, kind string, k1 string, copies string, _id string"


def tuples(df):
    return copies.record_tuples(df, "cand_id", exact=["topic", "doc", "first_start", "first_end", "n_mentions"], by_words=["candidate"], sets=["mentions"], required=["candidate"])


def found(spark, rows, hot_rows=200_000):
    df = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA)
    out = copies.copies(copies.tuples_of({"candidates": tuples(df)}), hot_rows).collect()
    return sorted((r.first_id, r.copy_id) for r in out)


def test_formatting_and_order_of_mentions(spark):
    rows = [
        (5, "t", "d", "Coastal  Tremor", ["a b", "C"], 1, 2, 3),
        (3, "t", "d", "coastal-tremor", ["(c)", "A-B", "a b"], 1, 2, 3),
        (4, "t", "d", "coastal tremors", ["c", "a b"], 1, 2, 3),  # another word
        (6, "t", "d", "tremor coastal", ["c", "a b"], 1, 2, 3),  # another order
        (7, "t", None, "coastal tremor", ["c", "a b"], 1, 2, 3),  # null is a value of its own
        (8, "t", None, "COASTAL_TREMOR …", ["c", "a b"], 1, 2, 3),
        (9, "t", "d", "coastal tremor", None, 1, 2, 3),
        (10, "t", "d", "coastal tremor", [], 1, 2, 3),
        (11, "t", "d", "coastal tremor", [None], 1, 2, 3),
        (12, "t", "d", "…", ["c"], 1, 2, 3),  # no word: no case
        (13, "t", "d", "--", ["c"], 1, 2, 3),
        (14, "t", "d", None, ["c"], 1, 2, 3),
        (None, "t", "d", "coastal tremor", ["c", "a b"], 1, 2, 3),
        (15, "t", "d", "café", ["c"], None, 2, 3),
        (16, "t", "d", "CAFÉ", ["c"], None, 2, 3),
        (17, "t", "d", "cafe", ["c"], None, 2, 3),  # accents count
    ]
    assert found(spark, rows) == [(3, 5), (7, 8), (15, 16)]


def test_a_group_of_copies_holding_most_rows(spark):
    rows = [(i, "t", "d", "Hot Phrase" if i % 2 else "hot-phrase", ["m"], 1, 2, 3) for i in range(1, 301)] + [(1000, "t", "d", "cold", ["m"], 1, 2, 3), (1001, "t", "d", "Cold", ["m"], 1, 2, 3)]
    want = [(1, i) for i in range(2, 301)] + [(1000, 1001)]
    assert found(spark, rows, hot_rows=50) == want == found(spark, rows)


def test_empty(spark):
    assert found(spark, []) == []


def test_json():
    same = ['{"a_b": "X y", "l": ["p q", "r"], "n": 0.853, "o": {"k": null, "m": 1}}', ' {"O": {"M":1, "K": null}, "n": 0.853, "L": ["R", "P-q"], "A-B": "x/Y"} ']
    assert copies.canonical_json(same[0]) == copies.canonical_json(same[1]) is not None
    assert copies.canonical_json('{"a": [1, 2]}') != copies.canonical_json('{"a": [1, 2, 2]}')
    assert copies.canonical_json('{"a": null}') != copies.canonical_json('{"a": ""}')
    assert copies.canonical_json('{"a": {"b": 1}}') != copies.canonical_json('{"a": 1, "b": 1}')
    for bad in ("", "null", "[1]", '{"a": 1', "{'a': 1}", "3", '{"a": NaN}', "[" * 100_000):
        assert copies.canonical_json(bad) is None


def test_records_against_brute_force(spark, sf):
    from phraselode.llm.queries import p1_records

    def words(x):
        return None if x is None else tuple(re.findall(r"[^\W_]+", x.upper().lower()))

    want = collections.defaultdict(list)
    for r in spark.read.parquet(f"{sf}/candidates.parquet").collect():
        if words(r.candidate):
            want["candidates", r.topic, r.doc, r.first_start, r.first_end, r.n_mentions, words(r.candidate), None if r.mentions is None else frozenset(map(words, r.mentions))].append(r.cand_id)
    for r in spark.read.parquet(f"{sf}/gold.parquet").collect():
        if words(r.phrase):
            want["gold", r.topic, r.doc, words(r.phrase)].append(r.gold_id)
    for r in spark.read.parquet(f"{sf}/topic_runs.parquet").collect():
        try:
            if isinstance(json.loads(r.payload), dict):
                want["topic_runs", copies.canonical_json(r.payload)].append(r.run_id)
        except ValueError:
            pass
    got = {(r.kind, r.first_id, r.copies) for r in p1_records(spark, sf).collect()}
    assert got == {(k[0], min(v), len(v)) for k, v in want.items()}
