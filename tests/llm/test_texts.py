"""Encoding, packing, repetition, pieces and perplexity."""

import collections
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from phraselode.llm import encode, packing, perplexity, pieces, repetition
from phraselode.llm.sentences import Corpus
from pyspark.sql import functions as F

DOCS = "doc_id bigint, text string, lang string, ids string, key string, _id string, part string, share string"


def docs(spark, texts, ids=None):
    return spark.createDataFrame([(ids[i] if ids else i, t, "en", "x", "x", "x", "x", "x") for i, t in enumerate(texts)], DOCS)


LONG = ["word " * 700, "a" * 3000, "x1?" * 900 + " " * 1500 + "end", "汉字。" * 800, "it's " * 99 + "'" * 1200 + "s d'll \n\n" * 60, " \t\n" * 900, "é🙂 <|endoftext|> " * 120]


def test_chunks_give_the_ids_of_the_whole(spark):
    texts = [None, "", " ", "short text", *LONG, LONG[0]]
    got = {r.doc_id: list(r.ids) for r in encode.encode_documents(docs(spark, texts), chunk=256, overlap=48).collect()}
    assert got == {i: encode.encode(t).tolist() for i, t in enumerate(texts)}


def test_every_parse_has_the_resynchronising_boundaries():
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choices("ab1's  ?\n汉é…", k=60))
        own = set(encode.boundaries(text))
        sure = {m.start() for m in encode._compiled(encode.RESYNC).finditer(text)}
        assert sure <= own
        for begin in range(1, 59):
            assert {p for p in sure if p > begin} <= {begin + p for p in encode.boundaries(text[begin:])}


def test_copies_of_a_long_text_are_encoded_once(spark):
    text = LONG[0]
    df = spark.createDataFrame([(i, text) for i in range(300)], "doc_id bigint, text string").repartition(4)
    counted = spark.sparkContext.accumulator(0)
    kept = encode._encode_parts

    def counting(path):
        def run(batches):
            for b in batches:
                counted.add(b.num_rows)
                yield from kept(path)([b])

        return run

    encode._encode_parts = counting
    try:
        rows = encode.encode_documents(df, chunk=1024, overlap=64, copies=20).withColumn("p", F.spark_partition_id()).collect()
    finally:
        encode._encode_parts = kept
    assert counted.value == -(-len(text) // 1024)
    assert len(rows) == 300 and {tuple(r.ids) for r in rows} == {tuple(encode.encode(text).tolist())}


def test_null_and_repeated_ids_stay(spark):
    texts = [LONG[0], LONG[0], LONG[1], "a", None]
    got = encode.encode_documents(docs(spark, texts, [None, 1, 1, None, 1]), chunk=256, overlap=48).collect()
    assert sorted((r.doc_id or -1, len(r.ids)) for r in got) == sorted((i or -1, len(encode.encode(t))) for i, t in zip([None, 1, 1, None, 1], texts))
    assert encode.encode_documents(docs(spark, [])).count() == 0


@given(st.text())
def test_round_trip(text):
    assert encode.decode(encode.encode(text)) == text.encode("utf-8", "surrogatepass").decode("utf-8", "replace")


def test_ids_equal_the_other_library_s():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{encode.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    for text in LONG:
        assert t.encode(text, add_special_tokens=False).ids == encode.encode(text).tolist()


@given(st.lists(st.integers(0, 60), max_size=200))
@settings(deadline=None)
def test_packing_fits(sizes):
    room = collections.Counter()
    for size, at in zip(sizes, packing.pack(sizes, 60)):
        room[at] += size
    assert all(v <= 60 for v in room.values()) and sum(room.values()) == sum(sizes)


def test_packing_reaches_the_bound_where_sizes_are_perfect():
    rng = random.Random(1)
    sizes = [x for _ in range(400) for a in [rng.randint(1, 98)] for b in [rng.randint(1, 99 - a)] for x in (a, b, 100 - a - b)]
    rng.shuffle(sizes)
    assert len(set(packing.pack(sizes, 100))) <= 400 * 1.03


def test_containers(spark):
    rng = np.random.default_rng(2)
    sizes = [int(x) for x in rng.integers(0, 90, 400)] + [100, 200, 250, 1001, 0]
    df = spark.createDataFrame([(None if i % 50 == 0 else i // 2, n, "x") for i, n in enumerate(sizes)] + [(7, None, "x")], "doc_id bigint, n int, container string").repartition(6)
    rows = packing.fill_containers(df, "doc_id", "n", 100, narrowing=2).collect()
    filled = collections.defaultdict(list)
    for r in rows:
        filled[r.container].append(r)
    assert all(sum(r.n_tokens for r in x) <= 100 for x in filled.values())
    assert sum(r.n_tokens for r in rows) == sum(sizes)
    assert len(filled) <= sum(sizes) / 100 * 1.07 + 1
    split = sorted((r.part, r.tok_start, r.n_tokens) for r in rows if r.part or r.n_tokens == 100)
    assert (10, 1000, 1) in split and (2, 200, 50) in split and sum(1 for r in rows if r.n_tokens == 100) == 1 + 2 + 2 + 10
    assert len(rows) == len(sizes) + 1 + 1 + 2 + 10
    assert packing.fill_containers(df.limit(0), "doc_id", "n", 100).count() == 0


@pytest.mark.parametrize("low,high", [(1025, 1025), (1500, 1500), (1, 2048), (0, 3)])
def test_what_a_task_keeps_and_passes_on_is_bounded(low, high):
    sizes = np.random.default_rng(4).integers(low, high + 1, 5000).tolist()
    task, out, kept = packing.Task(2048, most_open=64), [], 0
    for i, size in enumerate(sizes):
        out += task.put((i, size), size)
        kept = max(kept, int(task.bins.counts.max()))
    rest = task.finish(10, 100)
    assert kept <= 64 + 1 and sum(1 for r in rest if r[2] is None) <= 100
    assert sorted(r[0] for r in out + rest) == list(range(5000))
    filled = collections.Counter()
    for _, size, at in out + rest:
        filled[at] += size if at is not None else 0
    assert max(filled.values()) <= 2048


def test_items_that_do_not_fit_together_are_not_carried_along(spark):
    df = spark.range(0, 20_000, 1, 64).select(F.col("id").alias("doc_id"), F.lit(1025).alias("n"))
    rows = packing.fill_containers(df, "doc_id", "n", 2048, narrowing=4)
    assert rows.select("doc_id").distinct().count() == rows.count() == rows.select("container").distinct().count() == 20_000
    # Items that complete one another find their like although a task keeps few of each.
    pairs = df.withColumn("n", F.when(F.col("doc_id") % 2 == 0, 1025).otherwise(1023))
    assert packing.fill_containers(pairs, "doc_id", "n", 2048, narrowing=4).select("container").distinct().count() <= 10_000 * 1.07


def test_repeated_share(spark):
    unit = "".join(random.Random(3).choices("abcdefghijklmnopqrstuvwxyz", k=60))
    texts = [None, "", "…", "short", unit, unit + " - " + unit.upper(), "A" * 40, unit[:29] * 1 + "zz" + unit[:29], "x" + unit + "\n" + unit * 3, unit]
    got = {r.doc_id: r for r in repetition.repeated_share(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        low = [ord(c) for c in (t or "").lower() if c.isalnum()]
        assert (got[i].n_kept, got[i].n_repeated) == (len(low), repetition._plain(np.array(low, np.uint32), 30)), i
    assert got[0].share == 0 and got[5].share == 0.5
    assert repetition.repeated_share(docs(spark, [])).count() == 0


def brute_cells(text, run):
    """Of each character with a context: r, m, k1, k2, k3 without the character itself."""
    low, out = [c for c in text.lower() if c.isalnum()], []
    for i in range(run - 1, len(low)):
        context = low[i - run + 1 : i]
        others = collections.Counter(low[j] for j in range(run - 1, len(low)) if j != i and low[j - run + 1 : j] == context)
        if others:
            out.append((others[low[i]], sum(others.values()), *(sum(1 for n in others.values() if (n == k if k < 3 else n >= 3)) for k in (1, 2, 3))))
    return collections.Counter(out)


@given(st.lists(st.text("ab c"), max_size=4))
@settings(deadline=None)
def test_what_predicts_characters(texts):
    times, cells, n = repetition.Runs(texts, 4).cells()
    for d, text in enumerate(texts):
        assert {tuple(c[1:].tolist()): k for c, k in zip(cells, n) if c[0] == d} == dict(brute_cells(text, 4))
        low = "".join(c for c in text if c.isalnum())
        found = collections.Counter(collections.Counter(low[i : i + 4] for i in range(len(low) - 3)).values())
        assert times[:, d].tolist() == [found[k] for k in (1, 2, 3, 4)]


def test_the_lower_band_rejects_every_text_that_repeats_a_third(spark):
    rng, texts = random.Random(6), [None, "", "…", "short"]
    fresh = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    for pieces_of in (30, 31, 45, 200):
        for share in (0.0, 0.34, 0.4, 0.9):
            # Each repeated stretch occurs twice only, with other text around: the least favourable form.
            units = [fresh(pieces_of) for _ in range(8)]
            new = int(16 * pieces_of / 2 / max(share, 0.05)) - 8 * pieces_of - 8 * pieces_of if share else 400
            texts.append("".join(u + fresh(max(1, new // 16)) for u in units + (units if share else [])))
    texts += ["a" * 100, "ab" * 60, "x" * 29, "0" * 31, fresh(60) * 20]
    got = {r.doc_id: r for r in repetition.self_perplexity(docs(spark, texts)).collect()}
    assert len(got) == len(texts) and [got[i].band for i in range(4)] == ["none"] * 3 + ["kept"]
    for i, t in enumerate(texts):
        low = np.array([ord(c) for c in (t or "").lower() if c.isalnum()], np.uint32)
        assert (got[i].n_kept, got[i].n_repeated) == (len(low), repetition._plain(low, 30))
        assert got[i].share < 1 / 3 or got[i].band == "low"
        assert got[i].n_repeated or got[i].band != "low"
    assert sum(1 for r in got.values() if r.share >= 1 / 3) > 10
    assert repetition.self_perplexity(docs(spark, []), lang_col=None).count() == 0


@given(st.lists(st.text("ab c"), max_size=6))
@settings(deadline=None)
def test_repetition_against_brute_force(texts):
    total, repeated = repetition.repeated_counts(texts, 5)
    for t, n, r in zip(texts, total, repeated):
        low = np.array([ord(c) for c in t.lower() if c.isalnum()], np.uint32)
        assert (n, r) == (len(low), repetition._plain(low, 5))


@given(st.text("ab. \n一", max_size=300), st.integers(5, 40), st.integers(0, 4))
@settings(deadline=None, max_examples=300)
def test_pieces_hold_everything(text, limit, overlap):
    prefix = pieces.char_prefix(text)
    level, spans = pieces.coarsest(text, Corpus(), prefix, limit, overlap)
    out = pieces.cut(text, spans, prefix, limit, overlap)
    at = 0
    for k, (a, b) in enumerate(out):
        assert b - a <= limit and a < b
        assert text[at:a].strip() == "" and (k == 0 or at - a <= overlap)
        assert k == 0 or (a > out[k - 1][0] and b > at)
        at = b
    assert text[at:].strip() == ""


def test_levels(spark):
    word = "abcdefghi "
    texts = [None, "", word * 150, (word * 150 + "\n \n") * 2, word.strip() + ". A" + (word * 150 + ". A" + word) * 2, word * 300, "x" * 2001, " " * 2001, word * 199 + "x" * 5000]
    got = collections.defaultdict(list)
    for r in pieces.split_texts(docs(spark, texts)).orderBy("part").collect():
        got[r.doc_id].append(r)
    assert {k: v[0].boundary for k, v in got.items()} == {3: "paragraph", 4: "sentence", 5: "word", 6: "none", 7: "paragraph", 8: "none"}
    assert [(r.piece_start, r.piece_end) for r in got[7]] == [(0, 0)]
    assert all(b.piece_start == a.piece_end - 200 for a, b in zip(got[6], got[6][1:]))
    assert pieces.split_texts(docs(spark, [])).count() == 0
    with pytest.raises(ValueError):
        pieces.split_texts(docs(spark, []), limit=5, overlap=5)


def test_pieces_in_tokens():
    text = "One two three four five. " * 30
    prefix = pieces.token_prefix(text)
    assert prefix[-1] == len(encode.encode(text))
    level, spans = pieces.coarsest(text, Corpus(), prefix, 40, 5)
    out = pieces.cut(text, spans, prefix, 40, 5)
    assert level == "sentence" and all(prefix[b] - prefix[a] <= 40 for a, b in out) and len(out) > 4


def test_perplexity(spark):
    common = "the gauge at the pass stood at the mark and the team saw the mark"
    texts = [None, "", "…", *[common] * 20, "unheard jumble qwx zzy vvk ooe", common]
    got = {r.doc_id: r for r in perplexity.document_perplexity(docs(spark, texts), low=0.05, high=0.95).collect()}
    assert len(got) == len(texts)
    assert [(got[i].n_words, got[i].perplexity, got[i].band) for i in range(3)] == [(0, None, "none")] * 3
    assert got[23].perplexity > got[3].perplexity == got[24].perplexity and got[3].n_words == len(common.split())
    assert perplexity.document_perplexity(docs(spark, [])).count() == 0


def test_probabilities_of_a_context_sum_to_one(spark):
    texts = ["a b c", "a b d", "a b c d", "b c a"]
    rows = spark.createDataFrame([("en", t, str(i)) for i, t in enumerate(texts)], "lang string, text string, key string")
    model = {r.h: r.log_p for r in perplexity.train(rows).collect()}
    assert all(p <= 0 for p in model.values())
    a, b, c = perplexity._trigrams("a b c")
    seen = {int(h) for t in texts for h in perplexity._mix(perplexity._mix(*perplexity._trigrams(t)[:2]), perplexity._trigrams(t)[2]).view(np.int64)}
    assert seen == set(model)


def test_words_by_script():
    assert len(perplexity._TOKEN.findall("में पानी बढ़ा")) == 3
    assert len(perplexity._TOKEN.findall("桥断了 ab")) == 4
    assert re.fullmatch(r"\d+", str(perplexity.word_hashes("x")[0]))


def test_every_query_of_the_package_runs(spark):
    from phraselode.llm import queries

    assert set(queries.ORACLES) <= set(queries.QUERIES)
    for query in queries.QUERIES.values():
        query(spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
