import base64
import hashlib
import random
import time
import zlib
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillflow.llm import byte_bpe, chat_format, chunks, fm_index, line_templates, maxent_lm, page_text, quality_rules, shared, super_minhash, token_files, warc_store
from quillflow.llm.shared import shared_path
from tests.llm import brute

RANKS = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
rng = random.Random(11)
VOCABULARY = ["".join(rng.choice(["the", "ing", "ea", "tion", "é", "sch", "ß", "o"]) for _ in range(rng.randint(1, 3))) for _ in range(300)]


def prose(n: int) -> str:
    return " ".join(rng.choice(VOCABULARY) + rng.choice(["", "", "", ",", ".", "\n"]) for _ in range(n))


@cache
def corpus() -> dict:
    """Texts by id: usual ones, copies, near copies, junk, shared lines and passages, and the edges."""
    texts: dict = {i: prose(rng.randint(5, 200)) for i in range(60)}
    for i in range(60, 80):
        w = texts[i - 60].split(" ")
        for _ in range(rng.randint(0, len(w) // 15 + 1)):
            w[rng.randrange(len(w))] = rng.choice(VOCABULARY)
        texts[i] = " ".join(w)
    texts |= {i: texts[5] for i in range(80, 90)}
    for i in range(90, 100):
        texts[i] = prose(30) + f"\nReleased under the licence number {i} of the city.\n" + prose(30)
    texts |= {100: None, 101: "", 102: " \n\t ", 103: "one", 104: "a  b   c", 105: "x" * 5000, 106: "é" * 700 + " " + prose(3000), 107: "ONE Two\tthree FOUR", 108: "one two three four", 109: "spam### eggs&&& " * 60}
    texts |= {110: "  lead and trail  ", 111: "it's 123 don’t — 中文字符 emoji 🙂🙂  \u00a0 end\n\n\n", 112: "<|endoftext|> a <|endoftext|>"}
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    """The corpus with columns whose names clash with those that the operators use."""
    rows = [(i, t, "en", len(t or ""), "n", i, 0.5, True) for i, t in corpus().items()]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, n_chars bigint, node string, key bigint, score double, kept boolean").repartition(3)


@pytest.fixture(scope="module")
def none(spark, docs):
    return spark.createDataFrame([], docs.schema)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# --- quality rules ------------------------------------------------------------------------------------------------------


def test_quality_counts(spark, docs):
    got = by_id(quality_rules.judge(docs, quality_rules.Model([0.0] * 256, None)))
    for i, t in corpus().items():
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.quality(t), i
        assert r.kept is not r.base_failed and r.lang == "en"


def test_repeats_by_sorting_and_by_list(spark):
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(n)) for n in (3, 40, 400, 2000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = by_id(quality_rules.judge(df, quality_rules.Model([0.0] * 2, None)))
    assert [got[i].n_repeat_words for i in range(4)] == [brute.quality(t)[4] for t in texts]


def test_quality_model_tells_junk(spark):
    rows = [(i, prose(80) if i % 3 else " ".join(f"{rng.choice(VOCABULARY)}###" for _ in range(80))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(150)], "doc_id bigint, quality int, toxic int")
    model = quality_rules.fit(df, labels)
    assert quality_rules.fit(df, labels, max_broadcast_labels=3) == model  # joined by a shuffle
    got = by_id(quality_rules.judge(df, model))
    held = [i for i in range(150, 300) if not got[i].base_failed]
    assert held and all(got[i].kept == (i % 3 > 0) for i in held)
    assert {r.doc_id for r in quality_rules.keep(df, model).collect()} == {i for i in got if got[i].kept}


def test_quality_without_labels_or_rows(spark, docs, none):
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    assert quality_rules.fit(docs, labels).threshold is None
    assert quality_rules.judge(none, quality_rules.fit(none, labels)).count() == 0
    assert quality_rules.best_threshold([(0, 1, 9), (5, 9, 0)]) == 0.003


# --- line dedup ---------------------------------------------------------------------------------------------------------


def line_order(key):
    """A line's place in the order of hashes."""
    return int(line_templates.parse_lines(pa.array([" ".join("0" if w is None else w for w in key)]), 3)[3][0])


def test_a_row_is_judged_once(spark, docs):
    """The filter holds the model's table once, and a heap that garbage has blown up shrinks."""
    model = quality_rules.Model([0.5] * 256, 0.1)
    plan = quality_rules.keep(docs, model)._jdf.queryExecution().analyzed().toString()
    assert plan.count("0.500000,0.500000") == 128  # the table has 256 numbers
    shared.shrink_heap(spark, above=1)
    assert spark.range(10).count() == 10


def test_driver_memory_is_given_back(spark):
    """Of a heap with little in it, no more stays than twice that and some; the JVM's settings stay."""
    jvm = spark._jvm
    runtime, bean = jvm.java.lang.Runtime.getRuntime(), jvm.java.lang.Class.forName("com.sun.management.HotSpotDiagnosticMXBean")
    ratio = lambda: jvm.java.lang.management.ManagementFactory.getPlatformMXBean(bean).getVMOption("MaxHeapFreeRatio").getValue()
    before = ratio()
    for _ in range(20):
        spark.sparkContext._gateway.new_array(jvm.long, 4 << 20)  # garbage of 32 MB
    shared.shrink_heap(spark, above=1)
    assert runtime.totalMemory() < 2 * (runtime.totalMemory() - runtime.freeMemory()) + (32 << 20)
    assert ratio() == before
    assert shared.trim_native(spark)


def test_line_templates(spark, docs):
    wanted = brute.kept_lines(corpus(), line_order)
    got = by_id(line_templates.drop_recurring(docs))
    assert {i: r.text for i, r in got.items()} == wanted
    assert all(r.n_chars == len(r.text or "") for r in got.values())
    assert "licence" in got[90].text and not any("licence" in got[i].text for i in range(91, 100))
    assert got[5].text == corpus()[5] and set(got[85].text.split("\n")) <= set(corpus()[5].split("\n"))


def test_equal_lines_and_empty_tables(spark, docs, none):
    assert line_templates.drop_recurring(none).count() == 0
    rows = [(i, f"same start of all lines here x{w} y{w} z{w}") for i, w in enumerate("abcdefghij" * 3)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = by_id(line_templates.drop_recurring(df, similarity=1.0))
    assert [i for i in got if got[i].text] == list(range(10))


def test_templates_are_the_greedy_ones(spark):
    """Copies that differ at word 4 or later, some with variables, in one leaf for each length."""
    own = random.Random(5)
    pool = [f"w{c}" for c in "abcdefghijklmnopqrst"]
    bases = [[own.choice(pool) for _ in range(own.choice([1, 2, 3, 5, 8]))] for _ in range(12)]
    texts = {}
    for i in range(500):
        w = list(own.choice(bases))
        for _ in range(own.choice([0, 1, 1, 2, 3])):
            w[own.choice([0, own.randrange(len(w))])] = own.choice([*pool, "7", "8"])
        texts[i] = " ".join(["all", "lines", "begin", *w])
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = by_id(line_templates.drop_recurring(df))
    assert {i: r.text for i, r in got.items()} == brute.kept_lines(texts, line_order)


@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from("ab 1\n\t\u00a0é\x0b"), max_size=30)), min_size=1, max_size=6))
@settings(max_examples=100, deadline=None)
def test_leaves_by_leading_words(texts):
    array = pa.array(texts, pa.string())
    owner, _, leaf, _, n, _ = line_templates.parse_lines(array, 3)
    for one, two in zip(line_templates.leaf_hashes(array, 3), (owner, leaf, n), strict=True):
        assert (one[n > 0] == two[n > 0]).all()


@pytest.mark.parametrize("n", [1900, 2500, 20_000])
def test_a_leaf_of_any_size(spark, n):
    """One line a document with a variable field, all in one leaf: it stays in the first document."""
    word = F.concat(*(F.element_at(F.array(*map(F.lit, "abcdefghij")), (F.floor(F.col("id") / 10**k) % 10 + 1).cast("int")) for k in range(5)))
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("please read the "), word, F.lit(" page for all further terms of use")).alias("text"))
    assert line_templates.drop_recurring(df).agg(F.sum("n_dropped")).first()[0] == n - 1


def test_long_lines(spark):
    """Lines of 40 words that differ in up to a fifth of their places."""
    own, base = random.Random(3), [f"{a}{b}" for a in "bcdfghjk" for b in "aeiou"]
    texts = {}
    for i in range(60):
        w = list(base)
        for k in own.sample(range(3, 40), own.randint(0, 4)):
            w[k] = own.choice("xyz") * own.randint(3, 9)
        texts[i] = " ".join(w)
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    assert [i for i, r in by_id(line_templates.drop_recurring(df)).items() if r.text] == [0]
    parts, miss = line_templates.places_parts(40, 3, 0.75)
    assert miss == 10 and len(parts) == 11 and line_templates.places_parts(11, 3, 0.75)[1] == 2 and len(line_templates.places_parts(11, 3, 0.75)[0]) == 8


# --- near duplicates ----------------------------------------------------------------------------------------------------


def test_groups(spark, docs):
    got = by_id(super_minhash.near_duplicates(docs))
    wanted = brute.groups(corpus())
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == wanted
    assert all(r.kept == (i == r.component_id) for i, r in got.items())


def test_groups_that_leaders_do_not_reach(spark):
    base = [f"w{i}" for i in range(120)]
    texts = {}
    for i in range(60):  # a chain: neighbours are similar, the ends are not
        w = list(base)
        w[: 2 * i] = [f"v{k}" for k in range(2 * i)]
        texts[i] = " ".join(w)
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = by_id(super_minhash.near_duplicates(df, leader_rounds=2, block_nodes=7))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == brute.groups(texts)


def test_groups_edges(spark, none):
    assert super_minhash.near_duplicates(none).count() == 0
    df = spark.createDataFrame([(None, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (1, "A B C D E F"), (3, None)], "doc_id bigint, text string")
    got = sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in super_minhash.near_duplicates(df).collect())
    assert got == [(-1, -1, True), (1, 1, True), (2, 1, False), (2, 1, False), (3, 3, True)]


def test_signatures_estimate_similarity():
    a, b = {f"s{i}" for i in range(400)}, {f"s{i}" for i in range(100, 500)}
    h = lambda s: np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in s], np.uint64)
    sig = super_minhash.signatures(np.concatenate([h(a), h(b), h(["one"])]), np.array([400, 400, 1]), 192)
    assert abs((sig[0] == sig[1]).mean() - 0.6) < 0.12
    assert len(set((sig[2] >> 24).tolist())) == 192  # one element: each level fills one slot


# --- decontamination ----------------------------------------------------------------------------------------------------


def items():
    w = brute.leak_words(corpus()[7])
    return [(1, " ".join(w[:25])), (2, "One, two THREE"), (3, None), (4, "..."), (5, " ".join(w[4:9]) + " nothing of this"), (5, "one two three four five six seven eight nine ten"), (6, "emoji")]


@pytest.mark.parametrize("block_words", [10**6, 20])
def test_leaks(spark, docs, block_words):
    bench = spark.createDataFrame(items(), "item_id bigint, text string")
    got = by_id(fm_index.find_leaks(docs, bench, block_words=block_words))
    for i, (n, hit, found) in brute.leaks(corpus(), items()).items():
        spans = [k for s in got[i].spans for k in range(s["start"], s["end"])]
        assert (got[i].n_words, spans, got[i]["items"]) == (n, sorted(hit), found), i
    clean = by_id(fm_index.remove_leaks(docs, bench, block_words=block_words))
    assert clean[0].text == corpus()[0] and clean[107].text == " FOUR" and clean[107].n_chars == 5 and clean[100].text is None
    assert clean[7].lang == "en" and fm_index.find_leaks(docs.limit(0), bench).count() == 0
    assert all(not r.spans for r in fm_index.find_leaks(docs, bench.limit(0)).collect())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60), st.lists(st.integers(1, 3), min_size=1, max_size=4))
def test_fm_index_finds_all(sequence, phrase):
    s = np.array([*sequence, 0], np.int64)
    index = fm_index.FMIndex(s, 3, sample=4)
    lo, hi = index.search(np.array([phrase]))
    wanted = [i for i in range(len(s)) if s[i : i + len(phrase)].tolist() == phrase]
    assert sorted(index.locate(np.arange(lo[0], hi[0])).tolist()) == wanted


# --- tokenizers ---------------------------------------------------------------------------------------------------------


@cache
def encoding():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def test_byte_bpe(spark, docs, none):
    encoded = byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN, fold_bytes=40)
    got = by_id(encoded.select("doc_id", "ids", byte_bpe.decode(F.col("ids"), RANKS).alias("raw"), *byte_bpe.digests(encoded, RANKS)))
    for i, t in corpus().items():
        ids = encoding().encode_ordinary(t or "")
        assert list(got[i]["ids"]) == ids and bytes(got[i].raw) == (t or "").encode(), i
        assert got[i].ids_sha256 == hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest()
        assert got[i].n_tokens == len(ids) and got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert byte_bpe.encode(none, RANKS, public_tokenizers.PATTERN).count() == 0


def test_merges_in_order_and_by_lowest_pair(spark):
    import tiktoken

    ranks = {bytes([i]): i for i in range(256)} | {b"bc": 400, b"abc": 300, b"ab": 350, b"aa": 310, b"xa": 320}
    texts = ["abcxabcaaabbcxaabc aaaa xaaabc", "bcbcabaab", "aaaaa", ""]
    assert byte_bpe.merge_order(ranks) is None  # abc comes before ab
    in_order = {bytes([i]): i for i in range(256)} | {b"bc": 256, b"aa": 257, b"abc": 258, b"xa": 259, b"aaaa": 260, b"zzz": 261}
    assert set(byte_bpe.merge_order(in_order)) == {256, 257, 258, 259, 260}  # nothing joins zzz
    begins = byte_bpe.Beginnings(in_order, byte_bpe.merge_order(in_order))
    assert begins.tokens_in([b"abcaaaa", b"", b"zzz", b"xab"]).to_pylist() == [[256, 257, 258, 260], [], [], [259]]
    words = [*RANKS, *(a + b for a, b in zip(list(RANKS)[300:], list(RANKS)[700:3000]))]
    assert set(byte_bpe.merge_order(RANKS)) == {r for t, r in RANKS.items() if len(t) > 1}
    for table, own in ((ranks, texts), (in_order, [*texts, "zzzz zzz"]), (RANKS, [w.decode() for w in words[-2300:] if w.isascii()])):
        exact = tiktoken.Encoding("other", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        df = spark.createDataFrame(list(enumerate(own)), "doc_id bigint, text string").coalesce(2)
        got = {r["doc_id"]: list(r["ids"]) for r in byte_bpe.encode(df, table, public_tokenizers.PATTERN).collect()}
        assert got == {i: exact.encode_ordinary(t) for i, t in enumerate(own)}


@given(st.text(max_size=60))
@settings(max_examples=100, deadline=None)
def test_heap_merges(text):
    raw = text.encode("utf-8", "ignore")
    wanted = encoding()._encode_single_piece(raw) if raw else []
    assert byte_bpe.merge_by_heap(raw, RANKS) == wanted


@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from("ab.' \n\t\u00a0é1"), max_size=20)), min_size=1, max_size=8))
@settings(max_examples=200, deadline=None)
def test_cutting_keeps_texts(texts):
    p = chunks.cut(pa.array(texts, pa.string()))
    pieces = [" " + x for x in p.inner.to_pylist()] + p.outer.to_pylist()
    at = 0
    for t, n in zip(texts, p.counts.tolist(), strict=True):
        assert "".join(pieces[c] for c in p.codes[at : at + n]) == (t or "")
        at += n


def test_token_files(spark, docs, none, tmp_path):
    from tokenizers import Tokenizer

    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    path = f"file://{tmp_path}/tokens"
    token_files.write_tokens(docs, path, vocabulary, row_group_bytes=1 << 16, page_bytes=4096)
    got, at, tok = by_id(token_files.checksums(token_files.read_tokens(spark, path))), 0, Tokenizer.from_file(vocabulary)
    for i in sorted(corpus()):
        ids = [*tok.encode(corpus()[i] or "", add_special_tokens=False).ids, 0]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())), i
        at += len(ids)
    meta = [pq.ParquetFile(f).metadata for f in (tmp_path / "tokens").glob("*.parquet")]
    column = next(c for m in meta if m.num_rows for c in [m.row_group(0).column(4)])
    assert column.path_in_schema.startswith("ids") and "RLE_DICTIONARY" in column.encodings
    assert token_files.read_tokens(spark, path).select("doc_id", "n_tokens").inputFiles()
    empty = f"file://{tmp_path}/empty"
    token_files.write_tokens(none, empty, vocabulary)
    assert token_files.checksums(token_files.read_tokens(spark, empty)).count() == 0


# --- language model -----------------------------------------------------------------------------------------------------


def test_base_scores(spark, docs, none):
    got = by_id(maxent_lm.score_documents(docs, updates=2))
    for i, (held, n, known, train, base) in brute.base_scores(corpus()).items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, train), i
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0
    dealt = by_id(maxent_lm.score_documents(docs.repartition(12), updates=1))  # twelve blocks, so the words are in more than one part
    assert all(dealt[i].n_known == r.n_known and dealt[i].base_score == pytest.approx(r.base_score, rel=1e-9) for i, r in got.items())
    assert maxent_lm.score_documents(none, updates=1).count() == 0


def test_model_learns_context(spark):
    left, right = [f"l{c}a" for c in "abcdefgh"], [f"r{c}o" for c in "abcdefgh"]
    rows = [(i, " ".join(w for _ in range(60) for w in (rng.choice(left), rng.choice(right)))) for i in range(120)]
    got = maxent_lm.score_documents(spark.createDataFrame(rows, "doc_id bigint, text string"), updates=20).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert (got[0] - got[1]) / got[2] > 0.2  # of log10(2) at most


def small_model() -> maxent_lm.Model:
    """24 buckets in 6 classes of at most 5, with weights of a size that training gives."""
    random_values = np.random.default_rng(1)
    class_of = maxent_lm.cluster(random_values.poisson(3, (24, 24)).astype(float), 6, 5)
    assert class_of[0] == 0 and (class_of[1:] > 0).all() and np.bincount(class_of).max() <= 5
    model = maxent_lm.Model(class_of, 6, 5, random_values.poisson(20, 24))
    model.weights[:] = random_values.normal(size=model.weights.shape)
    return model


def test_model_is_a_distribution_and_sees_words():
    """The shares of all buckets after a history add up to one; they follow from the words, not only from their classes."""
    model = small_model()
    log_p = lambda words, last: model.log_p(np.array([*words, 99], np.uint64), np.array([3, 4, 5, last]), np.array([4]))[-1]
    for words in ([11, 12, 13], [11, 12, 14], [7, 12, 13]):
        assert sum(np.exp(log_p(words, b)) for b in range(24)) == pytest.approx(1, abs=1e-5)
    assert len({round(log_p(w, 6), 6) for w in ([11, 12, 13], [11, 12, 14], [7, 12, 13])}) == 3


def test_model_scores_match_a_plain_sum(monkeypatch):
    """Against one token at a time, with the features written out; windows don't change a score, nor do other texts."""
    model, mask = small_model(), (1 << 64) - 1

    def mixed(x: int) -> int:
        return int(maxent_lm.words.mix(np.array([x & mask], np.uint64))[0])

    def one(words: list[int], marks: list[int], i: int) -> float:
        w = [words[i - k] if i >= k else maxent_lm.END_HASH for k in (1, 2, 3)]
        c = [int(model.class_of[marks[i - k]]) if i >= k else 0 for k in (1, 2)]
        k1, k2 = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
        two = (w[0] * k1 + w[1]) & mask
        contexts = [mixed(x + k) for k, x in enumerate([w[0], two, two * k2 + w[2], w[1], w[0] * k2 + w[2], (c[0] << 16) + c[1]])]
        own = int(model.class_of[marks[i]])
        place = [b for b in range(24) if model.class_of[b] == own].index(marks[i])
        total = 0.0
        for factor, plain, column in ((0, model.classes, own), (1, own, place)):
            logits = model.plain[plain].astype(float)
            for x, bits, start in zip(contexts, maxent_lm.FEATURE_BITS, model.starts):
                x = (x ^ mixed(own + 77)) * 0x9E3779B97F4A7C15 & mask if factor else x
                logits = logits + model.weights[factor, (x >> (64 - bits)) + start]
            total += logits[column] - np.log(np.exp(logits - logits.max()).sum()) - logits.max()
        return total

    lens = [1, 7, 2, 30]
    texts = [([rng.getrandbits(64) for _ in range(n - 1)] + [maxent_lm.END_HASH], [rng.randrange(1, 24) for _ in range(n - 1)] + [0]) for n in lens]
    wanted = [one(w, m, i) for w, m in texts for i in range(len(w))]
    flat = np.array([w for t in texts for w in t[0]], np.uint64), np.array([m for t in texts for m in t[1]])
    for window in (10_000, 5, 1):
        monkeypatch.setattr(maxent_lm, "WINDOW", window)
        assert np.allclose(model.log_p(*flat, np.array(lens)), wanted, atol=1e-4)


def test_words_of_a_bucket_follow_the_history():
    """Cells of all buckets add up to one after any history, and words of one bucket are told apart by the words before, which training on pairs teaches."""
    class_of = maxent_lm.cluster(np.random.default_rng(1).poisson(3, (24, 24)).astype(float), 6, 5)
    before, after = np.array([5, 6], np.uint64) * np.uint64(977), np.array([32 * 7 + 1, 32 * 9 + 2], np.uint64)
    pick = np.array([rng.randrange(2) for _ in range(2000)])
    hashes, marks = np.stack([before[pick], after[pick]], axis=1).ravel(), np.tile([3, 4], 2000)
    cell_n = np.zeros((24, 32))
    np.add.at(cell_n, (marks, maxent_lm.cells_of(hashes, 32)), 1)
    model = maxent_lm.Model(class_of, 6, 5, cell_n.sum(axis=1), cell_n)
    names, tokens = np.unique(hashes, return_inverse=True)
    lists = lambda x, t: pa.array([x.tolist()], pa.list_(t))
    bucket = np.where(np.isin(names, before), 3, 4)
    arrays = [lists(np.array([False]), pa.bool_()), lists(np.array([4000]), pa.int32()), lists(bucket, pa.int32()), lists(names.view(np.int64), pa.int64()), pa.array([tokens.astype(np.uint32).tobytes()])]
    block = pa.RecordBatch.from_arrays(arrays, names=["held", "lens", "buckets", "hashes", "tokens"])
    for k in range(3):
        for batch in maxent_lm._gradient(model, k == 0)(iter([block])):
            row, sums = batch.column("row").to_numpy(), np.array(batch.column("g").to_pylist())
            assert sums[:, : model.width].sum() == pytest.approx(sums[:, model.width :].sum(), rel=1e-4)
            for factor in range(3):
                own = row // model.starts[-1] == factor
                model.move(factor, row[own] % model.starts[-1], sums[own, : model.width], sums[own, model.width :], maxent_lm.STEP if k else maxent_lm.FIRST_STEP)
    log_p = lambda word, bucket, last: model.log_p(np.array([word, last], np.uint64), np.array([3, bucket]), np.array([2]))[-1]
    assert log_p(before[0], 4, after[0]) > log_p(before[0], 4, after[1]) + 0.5
    assert log_p(before[1], 4, after[1]) > log_p(before[1], 4, after[0]) + 0.5
    assert sum(np.exp(log_p(before[0], b, 32 + c)) for b in range(24) for c in range(32)) == pytest.approx(1, abs=1e-4)


def test_sums_and_maxima_of_rows():
    """Against plain loops: rows without values, with one, with a few pieces and with nearly all; no values at all; widths that don't halve."""
    values = np.random.default_rng(2)
    for n_values, n, width in ((0, 5, 3), (1, 1, 1), (7, 40, 6), (8, 1, 2), (9, 1, 5), (5000, 64, 32), (5000, 70_000, 7)):
        x = values.random((n_values, width), np.float32)
        rows = np.where(values.random(n_values) < 0.6, n // 2, values.integers(0, n, n_values))
        wanted = np.zeros((n, width))
        np.add.at(wanted, rows, x)
        assert np.allclose(maxent_lm.sum_rows(np.concatenate([x, np.zeros((1, width), np.float32)]), rows, n), wanted, rtol=1e-5), (n_values, n, width)
        x -= 2
        assert np.array_equal(maxent_lm.row_max(x), x.max(axis=1, keepdims=True)) and np.allclose(maxent_lm.row_sum(x), x.sum(axis=1))


def test_large_weights():
    """Weights beyond what exp takes leave a distribution; usual ones give the same shares with the maximum taken off and without."""
    model, n = small_model(), 300
    hashes, marks = np.array([rng.getrandbits(64) for _ in range(n)], np.uint64), np.array([rng.randrange(1, 24) for _ in range(n)])
    each = next(iter(model.factors(hashes, marks, np.array([n]), n)))
    assert model.tame() == [True, True]
    for f, (rows, plain, _) in enumerate(each):
        assert np.allclose(model.shares(f, rows, plain, True), model.shares(f, rows, plain, False), rtol=1e-4, atol=1e-7)
    model.weights[1] *= 60
    assert model.tame() == [True, False]
    with np.errstate(over="raise", invalid="raise"):
        for last in (hashes[-1], 7):
            log_p = lambda b: model.log_p(np.array([*hashes[:3], last], np.uint64), np.array([3, 4, 5, b]), np.array([4]))[-1]  # noqa: E731, B023
            assert sum(np.exp(log_p(b)) for b in range(24)) == pytest.approx(1, abs=1e-4)


def test_updates_cost_little_more_than_their_sums():
    """CPU seconds of an update, against those of its expected counts alone if each column is added up for itself (2.4 times as many, when updates did that)."""
    values, n = np.random.default_rng(3), 200_000
    class_of = maxent_lm.cluster(values.poisson(3, (512, 512)).astype(float), maxent_lm.CLASSES, maxent_lm.ROOM)
    cell_n = values.poisson(20, (512, maxent_lm.CELLS))
    model = maxent_lm.Model(class_of, maxent_lm.CLASSES, maxent_lm.ROOM, cell_n.sum(axis=1), cell_n)
    tokens = np.minimum(values.zipf(1.3, n), 20_000) - 1
    arrays = [pa.array([[False]]), pa.array([[n]], pa.list_(pa.int32())), pa.array([values.integers(1, 512, 20_000).tolist()], pa.list_(pa.int32()))]
    arrays += [pa.array([values.integers(0, 1 << 62, 20_000).tolist()], pa.list_(pa.int64())), pa.array([tokens.astype(np.uint32).tobytes()])]
    block = pa.RecordBatch.from_arrays(arrays, names=["held", "lens", "buckets", "hashes", "tokens"])
    shares, rows = values.random((model.width, 10_000)), values.integers(0, 2048, 10_000)

    def by_column():
        for _ in range(n // 10_000 * sum(len(k) for k in maxent_lm.KINDS)):
            for c in range(model.width):
                np.bincount(rows, shares[c], 2048)

    def cost(run) -> float:
        before = time.process_time()
        run()
        return time.process_time() - before

    update = lambda: list(maxent_lm._gradient(model, False)(iter([block])))
    assert min(cost(update) for _ in range(3)) < 2 * min(cost(by_column) for _ in range(3))


def test_updates_raise_the_likelihood():
    """Each update, from plain shares on, makes its own training texts more likely."""
    tokens, n = [rng.randrange(1, 24) for _ in range(4000)], 4000
    tokens = [t if i % 2 else tokens[i - 1] for i, t in enumerate(tokens)]
    model = small_model()
    model.weights[:] = 0
    marks, hashes = np.array(tokens), np.array(tokens, np.uint64) * np.uint64(977)
    got = [model.log_p(hashes, marks, np.array([n])).sum()]
    names = np.arange(24, dtype=np.uint64) * np.uint64(977)
    lists = lambda x, t: pa.array([x.tolist()], pa.list_(t))
    arrays = [lists(np.array([False]), pa.bool_()), lists(np.array([n]), pa.int32()), lists(np.arange(24), pa.int32()), lists(names.view(np.int64), pa.int64()), pa.array([marks.astype(np.uint32).tobytes()])]
    block = pa.RecordBatch.from_arrays(arrays, names=["held", "lens", "buckets", "hashes", "tokens"])
    for k in range(4):
        for batch in maxent_lm._gradient(model, k == 0)(iter([block])):
            row, sums = batch.column("row").to_numpy(), np.array(batch.column("g").to_pylist())
            assert sums[:, : model.width].sum() == pytest.approx(sums[:, model.width :].sum(), rel=1e-4)
            for factor in range(2):
                own = row // model.starts[-1] == factor
                model.move(factor, row[own] % model.starts[-1], sums[own, : model.width], sums[own, model.width :], maxent_lm.STEP if k else maxent_lm.FIRST_STEP)
        got.append(model.log_p(hashes, marks, np.array([n])).sum())
    assert got == sorted(got) and got[-1] - got[0] > 0.1 * n


# --- archive ------------------------------------------------------------------------------------------------------------


def test_archive(spark):
    big = "<p>é</p>\r\n\r\n" * 200
    rows = [(1, "u1", big), (9, "u9\r\nWARC-Type: y", big), (5, None, big), (2, "s", "small"), (3, "", "small"), (4, " n ", None), (6, "e", ""), (None, "z", big), (7, "http://a/\rb\nc", "\r\n\r\n"), (7, "again", "other"), (8, "l", "x" * 300_000)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("sha1", F.lit("clash")).withColumn("payload", F.lit(1))
    path = shared_path(spark, "test")
    warc_store.write_archive(df, path)
    got = {(r.page_id, r.url): r for r in warc_store.read_archive(spark, path).collect()}
    assert set(got) == {(i, u) for i, u, _ in rows} and len(got) == len(rows)  # urls come back as they were
    kinds = {(1, "u1"): ("revisit", 9), (5, None): ("revisit", 9)}
    for i, url, html in rows:
        raw, r = (html or "").encode(), got[i, url]
        assert (r.record_type, r.refers_to) == kinds.get((i, url), ("response", None))
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == raw
        head, body = bytes(r.record).split(b"\r\n\r\n", 1)
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: " + r.record_type.encode()) and head.count(b"\r\nWARC-Type: ") == 1
        assert body == (b"" if r.record_type == "revisit" else raw) + b"\r\n\r\n"
    assert spark.read.parquet(f"{path}/payloads").count() == 6  # each payload once
    empty = shared_path(spark, "test")
    warc_store.write_archive(df.limit(0), empty)
    assert warc_store.read_archive(spark, empty).count() == 0


def test_archive_finds_damage(spark):
    df = spark.createDataFrame([(1, "u", "some text"), (2, "v", "other text")], "page_id bigint, url string, html string")
    for part, change in (("payloads", F.expr("CAST(concat(CAST(payload AS STRING), 'x') AS BINARY)")), ("headers", F.expr("CAST(regexp_replace(CAST(header AS STRING), 'Content-Length: ', 'Content-Length: 1') AS BINARY)"))):
        path = shared_path(spark, "test")
        warc_store.write_archive(df, path)
        other = shared_path(spark, "test")
        for p in ("payloads", "headers"):
            t = spark.read.parquet(f"{path}/{p}")
            (t.withColumn("payload" if p == "payloads" else "header", change) if p == part else t).write.parquet(f"{other}/{p}")
        with pytest.raises(Exception, match="damaged|differ"):
            warc_store.read_archive(spark, other).collect()


# --- pages --------------------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x="</p><p>no</p>";</script></head><body><header><a href=/>Home</a></header>
<nav><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></nav><!-- <p>hidden</p> --><div class="cookie-notice">We use cookies.</div>
<div class="content"><h1>A title &amp; more</h1><p>First <b>bold</b>
text, long enough to be a paragraph of an article.</p><p>Second&nbsp;one &#233; goes on and on. It has two sentences.<p>Third stands unclosed, with many words in it too.
<div class="ad-slot">Buy this now!</div></div><form><p>Your name: <input></form><section id="comments"><p>I liked this article very much. Best one ever.</p></section>
<aside>Related things</aside><footer>&copy; 2020</footer></body></html>"""


def test_page_text():
    wanted = "A title & more First bold text, long enough to be a paragraph of an article. Second one é goes on and on. It has two sentences. Third stands unclosed, with many words in it too."
    assert page_text.main_text(PAGE, page_text.DEFAULT) == wanted
    assert page_text.main_text("", page_text.DEFAULT) == "" == page_text.main_text("<nav>a</nav>", page_text.DEFAULT)
    assert page_text.main_text("<article>" + "<p>A sentence of some words.</p>" * 3000, page_text.DEFAULT).count("sentence") == 3000
    for odd in ("<", "<p", "<p title='x>y", "</p></b>", "a<!--", "<p>&#xFFFFFFF; &am", "<![CDATA[x", "<script>x"):
        page_text.main_text(odd, page_text.DEFAULT)


#: Weights that fit() found on pages of the synthetic table.
FITTED = page_text.Classifier((-0.1252, -1.5143, -0.4494, 3.6541, 1.9319, -1.3456, -1.2265, 1.1222, -2.448, 0.9358, -0.9527, 0.8404, -1.2653))
LONG = "A sentence of many words, as articles have them, goes on for a while and then it ends."


def test_the_cut_decides():
    """A short line between paragraphs is content by its neighbours, though its own cost says otherwise; far from them in the tree it is not."""
    near = f"<div><p>{LONG}</p><p>{LONG}</p><span>x | y</span><p>{LONG}</p></div>"
    far = f"<div><p>{LONG}</p><p>{LONG}</p></div>" + "<div>" * 9 + "<span>x | y</span>" + "</div>" * 9 + f"<div><p>{LONG}</p></div>"
    weights = list(FITTED.weights)
    weights[0], weights[7], weights[8] = 0.6, 0.0, -1.2  # plain: long blocks are content, short ones are not
    c = page_text.Classifier(tuple(weights))
    for page, kept in ((near, True), (far, False)):
        blocks = page_text.parse_blocks(page)
        at = next(i for i, b in enumerate(blocks) if b.text == "x | y")
        assert (page_text.features(blocks) @ np.array(c.weights))[at] < 0
        assert page_text.content_blocks(blocks, c)[at] is kept and sum(page_text.content_blocks(blocks, c)) == len(blocks) - (not kept)


def test_page_without_semantic_tags():
    page = f"<div><a href=1>Home</a> | <a href=2>Shop</a></div><div><h1>The title</h1><p>{LONG}</p><p>{LONG} {LONG}</p></div><div><a href=3>About</a> | © 2020</div>"
    assert page_text.main_text(page, FITTED) == f"The title {LONG} {LONG} {LONG}"


def test_odd_markup():
    texts = lambda page: [b.text for b in page_text.parse_blocks(page)]
    assert texts("<p title='x>one</p><p class=\"a\">two</p>") == ["one", "two"]  # a quote without its partner
    assert texts("<p>&am<b>p;</b> &amp; &<i>lt;</i></p>") == ["&amp; & &lt;"]  # references don't cross tags
    assert texts("<b>a<div>b</b>c</div>d") == ["a", "bc", "d"] and texts("<ul><li>a<ul><li>b</ul><li>c</ul>") == ["a", "b", "c"]
    assert [(b.text, b.apart) for b in page_text.parse_blocks("<div><p>a</p><p>b</p></div><div><div><p>c</p></div></div>")][1:] == [("b", 2), ("c", 5)]


@pytest.mark.parametrize("page", ["<div>" * 200_000 + "x", "<b>" * 100_000 + "<div>" * 100_000 + "</b>" * 100_000 + "x", "<p a='x " * 200_000, "<li>" * 200_000 + "x"])
def test_hostile_pages_take_linear_time(page):
    import time

    start = time.perf_counter()
    page_text.parse_blocks(page)
    assert time.perf_counter() - start < 15  # a quadratic parser takes many minutes


def test_pages_on_spark(spark):
    rows = [(i, f"u{i}", PAGE.replace("First", f"First {i}").replace('<div class="content">', "<article>")) for i in range(30)] + [(99, None, None)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = by_id(page_text.extract(df, page_text.fit(df)), "page_id")
    assert len(got) == 31 and got[99].text == "" and got[3].text.startswith("A title & more First 3 bold text")
    assert page_text.extract(df.limit(0), page_text.fit(df.limit(0))).count() == 0


def test_page_classifier_learns_from_all_examples(spark):
    """More different examples than the driver takes: the same weights."""
    rows = [(i, PAGE.replace("First", "First " * (i + 1)).replace('<div class="content">', "<article>")) for i in range(12)]
    df = spark.createDataFrame(rows, "page_id bigint, html string")
    few = page_text.fit(df, steps=4, driver_rows=3)
    assert few.weights == pytest.approx(page_text.fit(df, steps=4).weights, abs=2e-4) and few != page_text.DEFAULT


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 6), st.data())
def test_minimum_cut(n, data):
    number = st.integers(0, 6)
    source, sink = ([float(data.draw(number)) for _ in range(n)] for _ in range(2))
    edges = [(i, j, float(data.draw(number))) for i in range(n) for j in range(i)]
    cost = lambda side: sum(sink[i] if s else source[i] for i, s in enumerate(side)) + sum(c for i, j, c in edges if side[i] != side[j])
    best = min(cost([k >> i & 1 == 1 for i in range(n)]) for k in range(1 << n))
    assert cost(page_text.max_flow_labels(source, sink, edges)) == pytest.approx(best)


# --- chats --------------------------------------------------------------------------------------------------------------

turns = st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "a: b", "", None]), st.one_of(st.none(), st.text(st.sampled_from("\\#<:/ shlcturn>\nx🙂"), max_size=14))), min_size=1, max_size=6)


@settings(max_examples=15, deadline=None)
@given(st.lists(turns, min_size=1, max_size=6))
def test_chats_come_back(spark, chats):
    rows = [(c, t, role, text, "clash") for c, turns_ in enumerate(chats) for t, (role, text) in enumerate(turns_)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, parts string")
    for r in chat_format.parse_chats(chat_format.format_chats(df)).collect():
        wanted = [(role or "", text or "") for role, text in chats[r.conv_id]]
        assert [(t["role"], t["text"]) for t in r.turns] == wanted
        assert list(r.loss_texts) == [text for role, text in wanted if role == "assistant"]


def test_chat_format(spark):
    df = spark.createDataFrame([(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 2, "assistant", "c </turn>")], "conv_id bigint, turn bigint, role string, text string")
    assert chat_format.format_chats(df).first()["formatted"] == "### user: a</turn>\n### assistant: b</turn>c \\l/turn></turn>\n"
    assert chat_format.format_chats(df.limit(0)).count() == 0


def test_base64_ranks_are_read():
    assert RANKS[base64.b64decode("dGhl")] < 50256 and min(RANKS.values()) == 0


# --- null ids, repeated rows, all-null columns -------------------------------------------------------------------------------


def test_null_ids_and_repeated_rows(spark, tmp_path):
    text = prose(60)
    rows = [(None, text), (7, text), (7, text), (8, None), (None, None), (9, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    n = len(rows)
    labels = spark.createDataFrame([(None, 1), (7, None), (7, 1)], "doc_id bigint, quality int")
    assert quality_rules.judge(df, quality_rules.fit(df, labels)).count() == n
    kept = sorted((r.doc_id is None, r.doc_id or 0, r.text or "", r.n_dropped) for r in line_templates.drop_recurring(df).collect())
    assert len(kept) == n and all(not x[3] for x in kept if x[1] == 7) and any(x[0] and x[3] for x in kept)
    bench = spark.createDataFrame([(None, text), (1, None), (2, " ".join(brute.leak_words(text)[:12]))], "item_id bigint, text string")
    assert sorted(len(r.spans) for r in fm_index.find_leaks(df, bench).collect()) == [0, 0, 0, 1, 1, 1]
    assert sorted(len(r["ids"]) for r in byte_bpe.encode(df, RANKS, public_tokenizers.PATTERN).collect())[:3] == [0, 0, 0]
    scores = maxent_lm.score_documents(df, updates=1).collect()
    assert len(scores) == n and {r.n_tokens for r in scores} == {1, 61}
    path = f"file://{tmp_path}/t"
    token_files.write_tokens(df, path, public_tokenizers.path("byte_bpe_50k.json"))
    starts = sorted(r.start for r in token_files.checksums(token_files.read_tokens(spark, path)).collect())
    assert len(starts) == n and starts[0] == 0 and len(set(starts)) == n
    nulls = spark.createDataFrame([(None, None)], "doc_id bigint, text string")
    assert line_templates.drop_recurring(nulls).count() == super_minhash.near_duplicates(nulls).count() == maxent_lm.score_documents(nulls, updates=1).count() == 1
