"""Decontamination, token counts, packing and toxicity against brute force and the libraries."""

import re
import zlib

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from coppice.llm import decontaminate, packing, token_count, toxicity

ODD = [None, "", " ", "\n\n", "a  b", " a", "a ", "a \n b\t c", "a\n\n b", "It's <|endoftext|> here 's", " x y  z", "x" * 5000, "ÉÀ Σς don't WE'LL 123456", "a\x1cb \x1f c", "one two three " * 3000, "<|startoftext|>ab", "é ́x"]
DOCS = "doc_id long, text string, n_words string, score int"


def frame(spark, texts):
    return spark.createDataFrame([(k, t, "clash", 1) for k, t in enumerate(texts)], DOCS)


def all_texts(spark, sf):
    return [r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()] + ODD


def words(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_hits(doc, items, n):
    d, hit, ids = words(doc), set(), set()
    for i, t in items:
        w = words(t)
        k = min(n, len(w))
        for a in range(len(w) - k + 1 if k else 0):
            for b in range(len(d) - k + 1):
                if d[b : b + k] == w[a : a + k]:
                    hit |= set(range(b, b + k))
                    ids.add(str(i))
    return len(d), len(hit), sorted(ids)


@pytest.mark.parametrize("block", [4, 200_000])
def test_spans_are_those_of_brute_force(spark, block):
    items = [(1, "a b c d"), (2, "B c, d e"), (3, "q"), (4, "a b"), (5, None), (6, ""), (7, "a b c d"), (None, "c d e f g")]
    docs = ["x a b c d e y", "a b c", "q q", None, "", "b c d e f g", "A-B-C-D", "c d e", "a a b b c d e f", "z"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.find_spans(frame(spark, docs), bench, window=3, block_words=block).collect()}
    for k, t in enumerate(docs):
        n, hit, ids = brute_hits(t, [("" if i is None else i, x) for i, x in items], 3)
        assert (got[k]["n_words"], got[k]["n_hit"], got[k]["items"]) == (n, hit, ids), t


def test_cut_spans_leave_the_rest(spark):
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    docs = frame(spark, ["Keep this text, and: One, two THREE! and that too", "one two three", None, "", "clean"])
    got = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(docs, bench, window=3).collect()}
    assert got == {0: "Keep this text, and: ! and that too", 2: None, 3: "", 4: "clean"}
    assert decontaminate.decontaminate(docs, bench).columns == docs.columns
    assert decontaminate.decontaminate(docs.limit(0), bench.limit(0)).count() == 0


def test_counts_are_the_library_s(spark, sf):
    t, texts = Tokenizer.from_file(P.path("byte_bpe_50k.json")), all_texts(spark, sf)
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in token_count.count_tokens(frame(spark, texts), P.path("byte_bpe_50k.json")).collect()}
    for k, x in enumerate(texts):
        assert got[k] == (len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)), repr((x or "")[:80])


def test_proven_tokens_are_most_of_the_vocabulary():
    t = token_count.load(P.path("byte_bpe_50k.json"))
    proven = token_count.proven_tokens(t)
    assert len(proven) > 40_000 and " the" in proven and "<|endoftext|>" not in proven


def test_pieces_rebuild_every_document(spark, sf):
    t, texts = Tokenizer.from_file(P.path("word_bpe_49k.json")), all_texts(spark, sf)
    rows = packing.pack(frame(spark, texts), P.path("word_bpe_49k.json"), with_ids=True).collect()
    docs, seqs = {}, {}
    for r in rows:
        docs.setdefault(r["doc_id"], []).append((r["start"], r["ids"]))
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
    for k, x in enumerate(texts):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 1]
        assert b"".join(b for _, b in sorted(docs[k])) == b"".join(i.to_bytes(4, "little") for i in ids), repr((x or "")[:80])
    for pieces in seqs.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= 2048
    total = sum(r["length"] for r in rows)
    assert total / (2048 * len(seqs)) > 0.9


def test_best_fit_is_the_tightest_window():
    lengths = [5, 7, 3, 3, 2, 8, 1, 10, 4]
    window, offset, n = packing.best_fit(lengths, 10)
    free, want = [], {}
    for i in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        fits = [w for w in range(len(free)) if free[w] >= lengths[i]]
        if fits:
            best = min(free[w] for w in fits)
            assert free[window[i]] == best
        else:
            free.append(10)
            assert window[i] == len(free) - 1
        want[i] = 10 - free[window[i]]
        free[window[i]] -= lengths[i]
    assert n == len(free) and offset == [want[i] for i in range(len(lengths))]


def test_toxicity_learns_held_out_labels(spark):
    path = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    got = {r["doc_id"]: r for r in toxicity.op3(spark, path).collect()}
    assert len(got) == docs.count()
    right = n = caught = toxic = 0
    for r in labels.collect():
        g = got[r["doc_id"]]
        assert g["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        if g["held_out"]:
            n += 1
            right += g["predicted"] == r["toxic"]
            toxic += r["toxic"]
            caught += r["toxic"] and g["predicted"]
    print("held-out accuracy", right / n, "recall", caught / toxic)
    assert right / n > 0.98 and caught / toxic > 0.9


def test_toxicity_of_odd_rows(spark):
    docs = frame(spark, ["you idiot moron", "fine day", None, "", "idiot"] * 8)
    labels = spark.createDataFrame([(k, int(k % 5 in (0, 4))) for k in range(40)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    s = toxicity.Settings(l1=0.1, bits=16)
    got = [r["score"] for r in toxicity.score(docs, toxicity.fit(docs, labels, settings=s), s).orderBy("doc_id").collect()]
    assert min(got[0], got[4]) > 0.5 > max(got[1], got[2]) and got[2] == got[3]
    kept = toxicity.without_toxic(docs, labels, 0.5, s)
    assert kept.columns == docs.columns and kept.count() == 24
    assert toxicity.without_toxic(docs.limit(0), labels.limit(0)).count() == 0


def test_special_strings_count_only_in_their_own_case():
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    words = packing.TextIds(library)
    for text in ["<|EndOfText|>", "<|STARTOFTEXT|>", "Ab<|EndOfText|>Cd", "<|endoftext|>", "A<|endoftext|>B", "X <|startoftext|>Y.", "A<|B", "HELLO World."]:
        assert words.of(text) == b"".join(i.to_bytes(4, "little") for i in library.encode(text, add_special_tokens=False).ids), text


@pytest.mark.parametrize("block", [1000, 4])
def test_documents_are_scanned_and_cut_by_one_worker(spark, monkeypatch, block):
    """A second one for each task would wait in memory through the later stages."""
    monkeypatch.setattr(decontaminate._scanned, "__defaults__", tuple(block if x == decontaminate.BLOCK_WORDS else x for x in decontaminate._scanned.__defaults__))
    docs = spark.createDataFrame([(1, "x A, b c. y z", 13), (2, None, None), (3, "a b c", 5), (4, "é d-e-f é é é é", 15)], "doc_id int, text string, n_chars int")
    bench = spark.createDataFrame([("i", "a b c"), ("j", "d e f")], "item_id string, text string")
    out = decontaminate.decontaminate(docs, bench, window=3)
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow ") == 1
    assert sorted(map(tuple, out.collect())) == [(1, "x . y z", 7), (2, None, None), (4, "é  é é é é", 10)]
