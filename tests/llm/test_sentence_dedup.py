"""Sentence spans against brute force, and edge cases."""

import hashlib
import re

from pyspark.sql import functions as F

from newsloom.llm import queries, sentence_dedup
from newsloom.storage import table


def _plain(rows):
    seen, out = set(), []
    for i, text in sorted(rows):
        parts = sentence_dedup.sentences((text or "").encode())
        assert b"".join(parts) == (text or "").encode()
        words = [b" ".join(p.lower().split()) for p in parts]
        gone = [False] * len(parts)
        for k in range(len(parts) - 2):
            span = tuple(words[k : k + 3])
            if span in seen:
                gone[k : k + 3] = [True] * 3
            seen.add(span)
        kept = b"".join(p for p, g in zip(parts, gone, strict=True) if not g)
        out.append((i, len(parts), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_spans_equal_brute_force(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    want = _plain([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(map(tuple, sentence_dedup.remove_repeated_spans(docs).collect())) == want
    assert sum(w[2] for w in want) > 100


def test_span_edges(spark):
    passage = "One two three. Four five six! Seven 8.5 nine?\nTen eleven twelve. "
    rows = [(1, passage), (2, "Start here. " + passage.upper() + "End here."), (3, None), (4, ""), (5, "\n \n"), (6, passage * 500), (7, "no marks at all " * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept_text", F.lit("clash"))
    assert sorted(map(tuple, sentence_dedup.remove_repeated_spans(docs).collect())) == _plain(rows)
    kept = {r.doc_id: r.kept_text for r in sentence_dedup.remove_repeated_spans(docs, with_text=True).collect()}
    assert kept[1] == passage and kept[2] == "Start here. End here."
    assert sentence_dedup.remove_repeated_spans(docs.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, passage), (None, passage)], "doc_id long, text string")
    assert [r.n_removed for r in sentence_dedup.remove_repeated_spans(odd).collect()] == [0, 0]


def _plain_words(rows, size=sentence_dedup.WORDS):
    """Sentence spans, whole short texts and runs of words, one text after the other."""
    spans, runs, out = set(), set(), []
    for i, text in sorted(rows):
        data = (text or "").encode()
        parts = sentence_dedup.sentences(data)
        words = [tuple(p.lower().split()) for p in parts]
        flat, of = [w for p in words for w in p], [k for k, p in enumerate(words) for _ in p]
        cut, gone = [False] * len(parts), [False] * len(flat)
        for k in range(max(len(parts) - 2, 1 if flat else 0)):
            span = tuple(words[k : k + 3])
            if span in spans:
                cut[k : k + 3] = [True] * len(span)
            spans.add(span)
        for k in range(len(flat) - size + 1):
            if (run := tuple(flat[k : k + size])) in runs:
                gone[k : k + size] = [True] * size
            runs.add(run)
        pieces = [re.findall(rb"\s*\S+\s*" if j == 0 else rb"\S+\s*", p) or [p] for j, p in enumerate(parts)]
        kept, at, n = b"", 0, 0
        for k, own in enumerate(pieces):
            stay = [p for j, p in enumerate(own) if not (words[k] and gone[at + j])]
            n += cut[k] or not stay
            kept += b"" if cut[k] else b"".join(stay)
            at += of.count(k)
        out.append((i, len(parts), int(n), hashlib.sha256(kept).hexdigest()))
    return out


def test_query_equals_brute_force_with_runs_of_words(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").collect()
    want = _plain_words([(r.doc_id, r.text) for r in docs])
    assert sorted(map(tuple, queries.op1_sentence_dedup(spark, "/root/testdata/sf0.01").collect())) == want


def test_spliced_passages_and_short_copies(spark):
    passage = " ".join(f"w{k}" + "." * (k in (20, 40)) for k in range(53))
    one = " ".join(f"v{k}" for k in range(60)) + "."
    rows = [
        (1, f"Start. {passage} End here."), (2, f"Own words {passage} own tail. More of it."), (3, one), (4, one.upper()), (5, "Two words. And three more."), (6, "two  words. and three more."), (7, "Two words. And four."),
        (8, " ".join(passage.split()[:49]) + " other end."), (9, None), (10, "\n \n"), (11, "\n \n"), (12, ""), (13, f"In it {one} again: {one} twice"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sentence_dedup.remove_repeated_spans(docs, with_text=True, min_words=sentence_dedup.WORDS).collect()
    kept = {r.doc_id: r.kept_text for r in got}
    assert kept[2] == "Own words own tail. More of it." and kept[4] == "" and kept[6] == "" and kept[13] == "In it again: twice"
    assert all(kept[i] == (text or "") for i, text in rows if i not in (2, 4, 6, 13))
    odd = spark.createDataFrame([(None, one), (None, one), (1, one)], "doc_id long, text string")
    assert [r.n_removed for r in sentence_dedup.remove_repeated_spans(odd, min_words=50).collect()] == [0, 0, 0]
    assert sentence_dedup.remove_repeated_spans(docs.limit(0), min_words=50).count() == 0
