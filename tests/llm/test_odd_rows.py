"""Odd rows, crafted cases and brute force for the corpus operators."""

import hashlib
import itertools
import math
import random
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from coppice.llm import chat, common, decontaminate, exact_dedup, line_dedup, ngram_join, packing, quality, token_count, toxicity, url_filter

WORD = P.path("word_bpe_49k.json")


# ---- op1


def test_spans_with_odd_columns_and_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d", "x"), (1, "a b c d", "x"), (2, None, None)], "doc_id long, text string, `dotted.name` string")
    bench = spark.createDataFrame([(9, "b c d")], "item_id long, text string")
    out = decontaminate.decontaminate(docs, bench, window=3, max_coverage=0.9)
    assert out.columns == docs.columns and sorted(str(r["text"]) for r in out.collect()) == ["None", "a ", "a "]
    assert decontaminate.find_spans(docs, bench.limit(0)).agg(F.sum("n_hit")).first()[0] == 0
    assert decontaminate.find_spans(docs.limit(0), bench).count() == 0
    long = spark.createDataFrame([(1, "w " * 200_000 + "b c d")], "doc_id long, text string")
    assert decontaminate.find_spans(long, bench, window=3).first()["n_hit"] == 3


# ---- op2


def test_counts_of_long_texts_and_other_tokenizers(spark):
    texts = ["x" * 60_000, "ab" * 30_000 + " end", "é" * 20_000, "1" * 5000, " " * 5000 + "a", "a\n" * 3000, None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        library = Tokenizer.from_file(P.path(name))
        got = {r["doc_id"]: r["n_tokens"] for r in token_count.count_tokens(docs, P.path(name)).collect()}
        assert got == {k: len(library.encode(t or "", add_special_tokens=False).ids) for k, t in enumerate(texts)}
    assert token_count.count_tokens(docs.limit(0), P.path("byte_bpe_50k.json")).count() == 0


# ---- op3


def plain_features(text, bits):
    """Places of words, stems, pairs and skip-pairs, one by one."""
    words = common.words_of(text)
    m, mask = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], (1 << 64) - 1
    out = set()
    for w in words:
        for h in [zlib.crc32(w), *(zlib.crc32(w[:n], n) for n in toxicity.WordHashes.STEMS)]:
            out.add(((h * m[0]) & mask) >> (64 - bits))
    for k, other in ((1, m[1]), (2, m[2])):
        for a, b in zip(words, words[k:], strict=False):
            out.add(((zlib.crc32(a) * m[0] + zlib.crc32(b) * other) & mask) >> (64 - bits))
    return out


def test_toxicity_is_plain_ftrl(spark):
    r = random.Random(4)
    vocabulary = [f"w{k}" for k in range(30)]
    texts = [" ".join(r.choice(vocabulary) for _ in range(r.randrange(0, 12))) for _ in range(60)] + [None, ""]
    s = toxicity.Settings(bits=16, l1=0.2, epochs=2)
    docs = spark.createDataFrame([(f"id{k}", t) for k, t in enumerate(texts)], "doc_id string, text string")
    labels = spark.createDataFrame([(f"id{k}", int("w3" in (t or ""))) for k, t in enumerate(texts)], "doc_id string, toxic int")
    at, w, bias = toxicity.fit(docs, labels, settings=s)
    learnt = docs.join(labels, "doc_id").where(~common.held_out(F.col("doc_id"))).select(F.xxhash64("doc_id").alias("turn"), "text", "toxic").orderBy("turn").collect()
    z, n = {}, {}
    places = [(sorted(plain_features((t or "").encode(), 16)) + [1 << 16], y) for _, t, y in learnt]

    def weight(i):
        l1 = 0.0 if i == 1 << 16 else s.l1
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((s.beta + math.sqrt(n.get(i, 0.0))) / s.alpha + s.l2)

    for _ in range(s.epochs):
        for p, y in places:
            ws = {i: weight(i) for i in p}
            g = 1 / (1 + math.exp(-sum(ws.values()))) - y
            for i in p:
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / s.alpha
                z[i] = z.get(i, 0.0) + g - sigma * ws[i]
                n[i] = n.get(i, 0.0) + g * g
    want = {i: weight(i) for i in z if weight(i) and i != 1 << 16}
    got = dict(zip(at.tolist(), w.tolist(), strict=True))
    assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], abs_tol=1e-9) for i in want) and math.isclose(bias, weight(1 << 16), abs_tol=1e-9)
    scores = {x["doc_id"]: x["score"] for x in toxicity.score(docs, (at, w, bias), s).collect()}
    for k, t in enumerate(texts):
        logit = sum(want.get(i, 0.0) for i in plain_features((t or "").encode(), 16)) + bias
        assert math.isclose(scores[f"id{k}"], 1 / (1 + math.exp(-logit)), abs_tol=1e-5)


def test_long_texts_are_learnt_from_all_their_parts():
    s = toxicity.Settings(max_places=100)
    text = " ".join(f"a{k}" for k in range(4000)).encode()
    at = toxicity.learnt_places(text, toxicity.WordHashes(), s)
    assert len(at) == 100
    ends = [set(toxicity.WordHashes().places(" ".join(f"a{k}" for k in part).encode(), s.bits)) for part in (range(1000), range(3000, 4000))]
    assert all(len(e & set(at.tolist())) > 5 for e in ends)


def test_labels_that_conflict_count_as_one(spark):
    labels = spark.createDataFrame([(1, 0), (1, 1), (3, 0), (None, 1), (4, None)], "doc_id long, toxic int")
    rows = common.labelled_sample(labels, "toxic", 10).collect()
    assert {(r[0], r[1]) for r in rows} <= {(1, 1), (3, 0)}


def test_toxicity_without_rows(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["score"] for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()] == [0.5]
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), labels)).count() == 0


# ---- op4


def test_chunks_with_equal_hashes_are_told_apart(spark, monkeypatch):
    weak = lambda c: [(F.char_length(c) % 3).cast("long").alias("a"), F.lit(0).cast("long").alias("b")]
    monkeypatch.setattr(exact_dedup, "hashes", weak)
    texts = ["aaa", "bbb", "AAA", "ab", "abcde", "", None, "bbb", "x. " * 900, "y. " * 900, "X. " * 900]
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, n long")
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.deduplicate(docs).collect()}
    assert got == {0: (2, 2), 2: (2, 2), 1: (7, 2), 7: (7, 2), 3: (3, 1), 4: (4, 1), 5: (6, 2), 6: (6, 2), 8: (10, 2), 10: (10, 2), 9: (9, 1)}


def test_text_without_sentences_is_cut_by_content(spark):
    r = random.Random(1)
    text = "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(30_000))
    docs = spark.createDataFrame([(1, text), (2, "!" + text)], "doc_id long, text string")
    a, b = (set(r[0]) for r in docs.orderBy("doc_id").select(exact_dedup.chunks(F.col("text"))).collect())
    assert len(a & b) > 0.8 * len(a)


# ---- op5


def test_ids_of_any_kind(spark):
    text = " ".join(f"w{k}" for k in range(40))
    near = text.replace("w39", "x")
    docs = spark.createDataFrame([("b", text), ("a", near), (None, text), ("c", "other words than those"), (None, None), ("d", ""), ("c", text)], "doc_id string, text string")
    got = sorted((str(r["doc_id"]), str(r["component_id"]), r["n_shingles"]) for r in ngram_join.near_duplicates(docs).collect())
    assert got == sorted([("b", "a", 36), ("a", "a", 36), ("None", "a", 36), ("c", "c", 1), ("None", "None", 0), ("d", "d", 0), ("c", "a", 36)])
    kept = sorted((str(r["doc_id"]), str(r["text"])) for r in ngram_join.keep_one(docs).collect())
    assert kept == sorted([("a", near), ("c", "other words than those"), ("None", "None"), ("d", "")])


def test_short_signatures_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SIGNATURE", 8)
    r = random.Random(12)
    base = [f"w{r.randrange(10**6)}" for _ in range(3000)]
    rows = [(k, " ".join(w if r.random() > 0.004 else f"x{k}" for w in base)) for k in range(8)] + [(100 + k, " ".join(f"y{r.randrange(10**6)}" for _ in range(2900))) for k in range(8)]
    got = {x["doc_id"]: x["component_id"] for x in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[k] == 0 for k in range(8)) and all(got[100 + k] == 100 + k for k in range(8))


def test_rows_that_share_an_id_stay(spark):
    docs = spark.createDataFrame([(1, "x"), (1, "totally other text"), (1, "x")], "doc_id long, text string")
    assert sorted(r["text"] for r in ngram_join.keep_one(docs).collect()) == ["totally other text", "x"]


# ---- op6


def test_quality_of_odd_rows(spark):
    good, bad = "A calm line of words, as they come.\nAnd one more of them.", "BUY NOW!!! $$$ | 1111 | 2222\nBUY BUY BUY BUY $$$"
    texts = [good, bad] * 20 + [None, "", "\n\n\n", "x" * 40_000, "\n".join([good] * 400), good, good]
    docs = spark.createDataFrame([(k, t, "clash", 0.5) for k, t in enumerate(texts)], "doc_id long, text string, label string, score double")
    labels = spark.createDataFrame([(k, int(k % 2 == 0)) for k in range(40)] + [(44, 1), (None, 0), (1, None)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    assert len(got) == len(texts) and all(0 <= s <= 1 for s in got.values())
    assert min(got[k] for k in range(0, 40, 2)) > 0.7 > 0.3 > max(got[k] for k in range(1, 40, 2)) and got[45] == got[46] and got[40] == got[41]
    assert quality.score(docs.limit(0), model).count() == 0
    for some in (labels.where("quality = 1"), labels.limit(0)):
        assert quality.score(docs, quality.fit(docs, some)).where("score IS NULL").count() == 0
    # a document's score by hand: length-weighted mean of its lines' marginals, by enumeration
    x, size, lines = quality.line_features([bad.encode()])
    u, p = x @ model.w, np.zeros(2)
    z = 0.0
    for y in itertools.product((0, 1), repeat=2):
        w = math.exp(u[0] * y[0] + u[1] * y[1] + model.move[y[0], y[1]])
        z, p = z + w, p + w * np.array(y)
    mean = np.clip(np.sum(p / z * (size + 1)) / np.sum(size + 1), 1e-6, 1 - 1e-6)
    assert math.isclose(got[1], 1 / (1 + math.exp(-(model.scale * math.log(mean / (1 - mean)) + model.shift))), rel_tol=1e-6)


def test_long_labelled_texts_are_learnt_in_stretches():
    s = quality.Settings(max_lines=10, parts=5)
    got = quality.learnt_lines(1000, s)
    assert len(got) == 5 and got[0][0] == 0 and got[-1][-1] == 999 and all(len(g) == 2 for g in got)
    assert [g.tolist() for g in quality.learnt_lines(3, s)] == [[0, 1, 2]]


# ---- op7


@pytest.mark.parametrize("in_plan", [5000, 0])
def test_line_dedup_both_ways(spark, monkeypatch, in_plan):
    monkeypatch.setattr(line_dedup, "IN_PLAN", in_plan)
    r = random.Random(2)
    lines = [f"line {k}" for k in range(30)] + ["", " ", "dup", "dup"]
    rows = [(k // 2, "\n".join(r.choice(lines) for _ in range(r.randrange(0, 9))) if k % 11 else None, r.choice([None, "a", "b", "c", "d", "e"])) for k in range(80)]
    rows += [(900, "line 1\n" * 5000 + "end", "z"), rows[3], rows[3]]
    docs = spark.createDataFrame([(*x, 7, "x") for x in rows], "doc_id long, text string, source string, n_chars int, `line.a` string")
    sites = {}
    for _, t, s in rows:
        for line in (t or "").split("\n"):
            if line.strip():
                sites.setdefault(line, set()).add(s)
    gone = {line for line, s in sites.items() if len(s) >= 4}
    want = sorted((i, str(t if t is None or not any(x in gone for x in t.split("\n")) else "\n".join(x for x in t.split("\n") if x not in gone))) for i, t, _ in rows)
    out = line_dedup.remove_spread_lines(docs, min_sites=4)
    assert out.columns == docs.columns and sorted((x["doc_id"], str(x["text"])) for x in out.collect()) == want and gone


# ---- op8


def test_many_rules_and_held_out_hosts(spark):
    urls = ["https://a.b.c.org/x/1", "https://c.org/x", "https://b.c.org/y", "https://q.net/", None, "none", "http://zc.org/x/1", "http://c.org/x/12?q"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = [("allow", "org", "/"), ("block", "c.org", "/x"), ("allow", "b.c.org", "/x/1"), ("block", "c.org", "/x/1"), ("block", "net", "/zzz")]
    model = url_filter.train(url_filter.LABELS)
    few = sorted(map(str, url_filter.judge(pages, rules, *model).collect()))
    many = sorted(map(str, url_filter.judge(pages, rules + [("block", f"h{k}.example", "/") for k in range(300)], *model).collect()))
    assert few == many and any("c.org/x/1" in x for x in few)
    assert url_filter.judge(pages.limit(0), rules, *model).count() == 0
    assert url_filter.held_out_accuracy(url_filter.LABELS) > 0.9
    scores = {r["page_id"]: r["score"] for r in url_filter.judge(pages, rules, *model).collect()}
    assert all(scores[k] == url_filter.log_odds(u or "", *model) for k, u in enumerate(urls))


# ---- op9


def test_no_control_string_is_left_in_a_text(spark):
    t, r = chat.Template(), random.Random(8)
    f, alphabet = chat.Formatter(chat.Template()), [*chat.Template().controls(), "<", ">", "[", "]", "\\", "/", "s", "x"]
    for _ in range(3000):
        text = "".join(r.choice(alphabet) for _ in range(r.randrange(9)))
        assert f.unescape(f.escape(text)) == text and not any(c in f.escape(text) for c in t.controls())
    rows = [(c, k, "".join(r.choice(alphabet) for _ in range(r.randrange(4))), "".join(r.choice(alphabet) for _ in range(5))) for c in range(80) for k in range(3)]
    got = {x["conv_id"]: x["turns_sha256"] for x in chat.digests(chat.segments(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    for c in range(80):
        assert got[c] == hashlib.sha256("".join(f"{a}\n{x}\n" for i, _, a, x in rows if i == c).encode()).hexdigest()


def test_conversations_end_in_a_final_state(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (2, 0, "user", "q"), (3, 0, "user", "q"), (3, 1, "assistant", "a"), (3, 1, "assistant", "b")]
    docs = spark.createDataFrame([(*x, "clash") for x in rows], "conv_id long, turn long, role string, text string, segment string")
    assert {r["conv_id"]: r["valid"] for r in chat.digests(chat.segments(docs)).collect()} == {1: True, 2: False, 3: False}
    with pytest.raises(ValueError, match="mark"):
        chat.Template(marks={"user": ("USER:", "</s>")})


# ---- op10


def test_packing_in_sets_is_the_same_with_ids(spark, monkeypatch):
    monkeypatch.setattr(packing, "PACK_ROWS", 7)
    r = random.Random(5)
    texts = [" ".join(f"w{r.randrange(99)}" for _ in range(r.randrange(0, 700))) for _ in range(40)] + [None, ""]
    docs = spark.createDataFrame([(k // 2, t) for k, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    plain, ids = (sorted(map(tuple, packing.pack(docs, WORD, with_ids=x).select(columns).collect())) for x in (False, True))
    assert plain == ids
    used = {}
    for row in plain:
        used.setdefault(row[5], []).append((row[6], row[2]))
    for pieces in used.values():
        ends = [0, *itertools.accumulate(n for _, n in sorted(pieces))]
        assert [o for o, _ in sorted(pieces)] == ends[:-1] and ends[-1] <= 2048
    assert packing.pack(docs.limit(0), WORD).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_of_odd_texts_are_the_library_s(name):
    library = Tokenizer.from_file(P.path(name))
    ids, r = packing.TextIds(token_count.load(P.path(name))), random.Random(3)
    added = [t.content for t in library.get_added_tokens_decoder().values()]
    parts = [*added, "<|", "|>", " ", "\n", "\t", "it's", "WE'LL", "é", "É", "é", "Σ", "İ", "ß", "日本", "12", "½", "x", "don't!", "\x1c", "\x85", "\xa0", "“", "—", "й", "Ё", "ǅ", "𝔸", "_", "'s'"]
    for _ in range(3000):
        text = "".join(p if r.random() < 0.6 else "".join(r.choice([c.upper(), c.lower()]) for c in p) for p in r.choices(parts, k=r.randrange(1, 9)))
        assert ids.of(text) == b"".join(i.to_bytes(4, "little") for i in library.encode(text, add_special_tokens=False).ids), repr(text)


# ---- pipeline


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Every stage over nulls, empty and repeated rows, copies and extra columns; held against plain versions of the stages."""
    r = random.Random(6)
    own = lambda k: " ".join(f"own{k}x{r.randrange(10**6)}" for _ in range(60))
    bench = " ".join(f"bench{k}" for k in range(30))
    base = own(500)
    words = base.split(" ")
    rows = [(k, own(k) + "\nshared boiler line\n" + own(k + 50), "en", f"s{k % 7}") for k in range(14)]
    rows += [(100, base, "en", "s1"), (101, base, "en", "s2"), (102, " ".join([*words[:-1], "changed"]), "en", None), (103, own(7) + " " + bench + " " + own(8), None, "s1"), (104, bench, "en", "s3")]
    rows += [(105, None, "en", "s1"), (106, "", None, None), (None, own(9), "en", "s2"), (107, own(10), "en", "s1"), (107, own(11), "en", "s1"), rows[0], rows[0]]
    rows += [(200 + k, "toxicword toxicword " + own(300 + k), "en", "s1") for k in range(12)]
    rows += [(1000 + k, own(1000 + k), "en", "s1") for k in range(100)]  # clean ones, so that unknown words are not suspect
    docs = spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), "x") for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long, `extra.col` string")
    labels = [(200 + k, 1, 1) for k in range(12)] + [(k, 1, 0) for k in [*range(14), *range(1000, 1100)]] + [(None, 1, 1), (100, None, None)]
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, q, t) for i, q, t in labels] * 3, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, bench), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    at, texts = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = common.written(stage(spark, at, str(tmp_path)), "test")
        assert at.columns == docs.columns, name
        texts[name] = [(x["doc_id"], x["text"], x["n_chars"]) for x in at.collect()]
    # lines: "shared boiler line" is on seven sources and in 14 texts
    before, after = sorted(map(str, texts["toxicity"])), texts["line_dedup"]
    assert len(before) == len(after)
    plain = sorted(str((i, t if t is None else "\n".join(x for x in t.split("\n") if x != "shared boiler line"), n if t is None or "shared boiler" not in t else n - 19)) for i, t, n in texts["toxicity"])
    assert sorted(map(str, after)) == plain
    # near copies: of 100 to 102 one stays, repeated rows once, the two rows 107 both
    kept = [i for i, _, _ in texts["near_duplicates"]]
    assert kept.count(100) == 1 and 101 not in kept and 102 not in kept and kept.count(107) == 2 and kept.count(None) == 1 and kept.count(0) == 1 and {105, 106} <= set(kept)
    # benchmark: 104 is all benchmark and goes, 103 loses its passage
    clean = {i: t for i, t, _ in texts["decontamination"]}
    assert 104 not in clean and "bench" not in clean[103] and set(kept) - set(clean) == {104}
    pieces = corpus_pipeline.STAGES[-1][1](spark, at, str(tmp_path)).collect()
    assert sorted({str(p["doc_id"]) for p in pieces}) == sorted({str(i) for i in clean})
    empty = str(tmp_path / "none")
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(str(tmp_path / f"{t}.parquet")).limit(0).write.parquet(f"{empty}/{t}.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0
