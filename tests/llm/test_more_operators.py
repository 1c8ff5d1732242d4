"""Exact dedup, line dedup, URL filter, chat, quality and the pipeline on odd rows."""

import hashlib
import random
import zlib

import corpus_pipeline
from coppice.llm import chat, exact_dedup, line_dedup, quality, url_filter

DOCS = "doc_id long, text string, source string, n_chars long, line string, n long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, len(t or ""), "clash", 1) for i, t, s in rows], DOCS)


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def test_equal_texts_keep_the_largest_id(spark):
    long = "Éa sentence ends here. " * 2000
    rows = [(1, "Ab É", "s"), (2, "aB É", "s"), (3, "ab é", "s"), (4, None, "s"), (5, "", "s"), (6, long, None), (7, long.replace("s", "S"), "s"), (8, long + "x", "s"), (None, "ab É", "s"), (9, "x", "s"), (9, "x", "s")]
    got = exact_dedup.deduplicate(frame(spark, rows)).collect()
    keep = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in got}
    assert keep == {1: (2, 3), 2: (2, 3), None: (2, 3), 3: (3, 1), 4: (5, 2), 5: (5, 2), 6: (7, 2), 7: (7, 2), 8: (8, 1), 9: (9, 2)}
    assert sum(r["kept"] for r in got) == 6
    assert {r["text_sha256"] for r in got} == {hashlib.sha256(low(t).encode()).hexdigest() for _, t, _ in rows}
    assert exact_dedup.deduplicate(frame(spark, rows).limit(0)).count() == 0


def test_lines_of_many_sites_go(spark):
    rows = [(k, f"own {k}\nBOILER\n\nBOILER\nend {k % 2}", f"s{k % 4}") for k in range(12)] + [(20, None, "s1"), (21, "", None), (22, "BOILER", "s9"), (23, "BOILER\nx", None)]
    docs = frame(spark, rows)
    got = {r["doc_id"]: r for r in line_dedup.remove_spread_lines(docs, min_sites=3, counts=True).collect()}
    for k in range(12):
        assert got[k]["text"] == f"own {k}\n\nend {k % 2}" and got[k]["n_removed"] == 2 and got[k]["n_chars"] == len(got[k]["text"])
    assert (got[20]["text"], got[21]["text"], got[22]["text"], got[23]["text"]) == (None, "", "", "x")
    assert line_dedup.remove_spread_lines(docs).columns == docs.columns
    assert line_dedup.remove_spread_lines(docs.limit(0)).count() == 0


def test_url_rules_and_model(spark):
    urls = [(1, "HTTP://A.Example.ORG/en/1?x"), (2, "https://example.org/es/9#t"), (3, "https://notexample.org/es/"), (4, None), (5, "no scheme"), (6, "https://www.spam-farm.example.net/en/3"), (7, "https://museum.example.net/en/3"), (8, "http://x.com/de/"), (9, "http://x.com"), (10, "a://b://c/d"), (10, "a://b://c/d")]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in urls], "page_id long, url string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages, url_filter.RULES, *url_filter.train(url_filter.LABELS)).collect()}
    assert got[1] == ("a.example.org", "/en/1", "example.org/en/1", "block")
    assert got[2][2:] == ("example.org/es/", "block") and got[3][2:] == ("org/", "allow")
    assert got[4][:3] == got[5][:3] == ("", "", None)
    assert got[6][2:] == (None, "block") and got[7][2:] == (None, "allow") and got[8][3] == "block" and got[9][1:3] == ("", None)
    assert got[10][:2] == ("b:", "//c/d")


def test_chat_reads_back(spark):
    r = random.Random(3)
    parts = [*chat.Template().controls(), "\\", "\\\\", "a", "<", "s>", "\n", "é", "<<s>", "[", "]"]
    rows = []
    for conv in range(60):
        for turn in range(r.randrange(1, 6)):
            rows.append((conv, turn, r.choice(["system", "user", "assistant", None, "to<s>ol", ""]), r.choice([None, "".join(r.choice(parts) for _ in range(r.randrange(8)))])))
    df = spark.createDataFrame(rows + [(None, 1, "user", "x")], "conv_id long, turn long, role string, text string")
    got = {x["conv_id"]: x for x in chat.digests(chat.segments(df)).collect()}
    for conv in range(60):
        own = sorted((t, a or "", x or "") for c, t, a, x in rows if c == conv)
        loss = "".join(x for _, a, x in own if a == "assistant")
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{x}\n" for _, a, x in own).encode()).hexdigest()
        assert (got[conv]["n_turns"], got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(own), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[None]["n_turns"] == 1
    ok = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a"), (2, 0, "assistant", "a")], "conv_id long, turn long, role string, text string")
    assert {x["conv_id"]: x["valid"] for x in chat.digests(chat.segments(ok)).collect()} == {1: True, 2: False}
    assert chat.digests(chat.segments(ok.limit(0))).count() == 0


def test_quality_learns_held_out_labels(spark):
    path = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in quality.op6(spark, path).collect()}
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{path}/labels.parquet").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert sum(got[i]["predicted"] == y for i, y in labels) / len(labels) > 0.98


def test_marginals_are_those_of_enumeration():
    import itertools

    import numpy as np

    r = np.random.default_rng(2)
    lines, move = np.array([1, 4, 2]), r.normal(size=(2, 2))
    u = r.normal(size=7)
    got, _ = quality.marginals(u, lines, move)
    at = 0
    for n in lines:
        p, z = np.zeros(n), 0.0
        for y in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(u[at + k] * y[k] for k in range(n)) + sum(move[y[k], y[k + 1]] for k in range(n - 1)))
            z += w
            p += w * np.array(y)
        assert np.allclose(got[at : at + n], p / z)
        at += n
    odd = [b"", b"\n\n", b"a", b"x " * 30000]
    assert len(quality.Model().score(odd)) == 4


def test_pipeline_stages_keep_columns_and_clean_documents(spark):
    path = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, at = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, at, path)
        assert out.columns == columns, name
        at = corpus_pipeline.written(out, "test")
    n = at.count()
    pieces = corpus_pipeline.STAGES[-1][1](spark, at, path)
    assert 0.5 * docs.count() < n <= docs.count()
    assert pieces.select("doc_id").distinct().count() == n


def test_pipeline_keeps_one_copy_of_a_text_on_many_sources(spark):
    copied = "\n".join(f"passage {k} of the text that {k * 7919} sources took over whole {k * k}" for k in range(30))
    rows = [(k, copied, f"s{k}") for k in range(6)] + [(10 + k, f"BOILER\nown words {k} " + " ".join(str(k * 1000 + i) for i in range(40)), f"s{k}") for k in range(6)]
    lines = corpus_pipeline._lines(spark, frame(spark, rows), "")
    got = {r["doc_id"]: r["text"] for r in lines.collect()}
    assert all(got[k] == copied for k in range(6))
    assert all(got[10 + k] == rows[6 + k][1].removeprefix("BOILER\n") for k in range(6))
    left = [r["text"] for r in corpus_pipeline._near(spark, lines, "").collect()]
    assert left.count(copied) == 1 and len(left) == 7
