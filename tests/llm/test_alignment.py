"""Alignment of tokenizers against plain loops over bytes."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from newsloom.llm import alignment, queries

FILES = [str(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def tools():
    a = Tokenizer.from_file(FILES[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=FILES[1])


def brute(rows: list[tuple], tools) -> list[tuple]:
    a, b = tools
    letters = sorted([*range(33, 127), *range(161, 173), *range(174, 256)])
    byte_of = {chr(x): x for x in letters} | {chr(256 + n): x for n, x in enumerate(x for x in range(256) if x not in letters)}

    def groups(text):
        if not text:
            return []
        whole = (" " + text).encode()
        sides = []
        for ids, bytes_of in (
            (a.encode(" " + text, add_special_tokens=False).ids, lambda i: bytes(byte_of[c] for c in a.id_to_token(i))),
            (b.encode(text), lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()),
        ):
            ends, at = [], 0
            for i in ids:
                assert (x := bytes_of(i))
                if whole[at : at + len(x)] != x:
                    return []
                at += len(x)
                ends.append((at, i))
            if at != len(whole):
                return []
            sides.append(ends)
        out, at = [], [0, 0]
        for end in sorted({e for e, _ in sides[0]} & {e for e, _ in sides[1]}):
            group = []
            for k, ends in enumerate(sides):
                first = at[k]
                while at[k] < len(ends) and ends[at[k]][0] <= end:
                    at[k] += 1
                group.append([i for _, i in ends[first : at[k]]])
            out.append(tuple(group))
        return out

    found = [(i, groups(t)) for i, t in rows]
    counts: Counter = Counter()
    for _, g in found:
        counts.update({(x, y) for xs, ys in g for x in xs for y in ys})
    most: dict = defaultdict(int)
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    out = []
    for i, g in found:
        links = [(x, y) for xs, ys in g for x in xs for y in ys]
        text = ";".join(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)) for xs, ys in g)
        out.append((
            i, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(links), sum(counts[p] == most[p[0]] for p in links),
            sum(counts[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if g else "",
        ))
    return sorted(out, key=str)


def aligned(spark, rows, partitions=3):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)
    out = alignment.align(df, *FILES)
    assert out.columns == COLUMNS
    return sorted(map(tuple, out.collect()), key=str)


def test_components_are_those_of_a_search():
    rng = np.random.default_rng(3)
    for n in (1, 2, 30):
        for _ in range(40):
            one, two = rng.integers(0, n, (2, int(rng.integers(0, 2 * n + 1))))
            want = list(range(n))
            for _ in range(n):
                for x, y in zip(one, two, strict=True):
                    want[x] = want[y] = min(want[x], want[y])
            assert alignment.components(one, two, n).tolist() == want
    chain = np.arange(5000)
    assert not alignment.components(chain[:-1], chain[1:], 5000).any()


def test_odd_texts(spark, tools):
    texts = [
        None, "", " ", "  ", "\n", "a", "Hello world", " Hello  world ", "<|endoftext|> and <s></s><unk>", "▁ is a piece", "nul\0byte", "é ñ ü ß 漢字 かな 🙂👩‍👩‍👧",
        "tab\tand\r\nlines\n\n\n", "aaaa" * 3000, "1234567890" * 300, "x" * 5000 + " " + "y" * 5000, "Zürich naïve café", "\u2028\u00a0\u3000 spaces", "ab" * 4000 + "ba" * 4000,
        "Hello world", "antidisestablishmentarianism " * 50, "\ufeffmark", "e\u0301 combined", "ﬁ ligature",
        "a  b", "a \nb", "a\n b", "a\x1c b \x1cc", " lead", "trail ", "a \u00a0 b", "x\u2003 y", "it's 's we 've  'll", "1 2  3   4", "a\t b\n \nc \n d", "a ▁ b", "…  — – ' ' ''",
    ]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "Hello world"), (3, "again"), (3, "again")]
    assert aligned(spark, rows) == brute(rows, tools)


def test_whole_tables(spark, sf, tools):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.op12_alignment(spark, sf).collect()), key=str) == brute(rows, tools)


def test_chunks_and_steps_do_not_matter(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    want = sorted(map(tuple, alignment.align(docs, *FILES).collect()))
    monkeypatch.setattr(alignment, "CHUNK_BYTES", 3000)
    monkeypatch.setattr(alignment, "STEP_BYTES", 1000)
    monkeypatch.setattr(alignment, "LARGE", 3)
    monkeypatch.setattr(alignment, "COUNTED", 50)
    assert sorted(map(tuple, alignment.align(docs, *FILES).collect())) == want
    for r in alignment.align(docs, *FILES, with_groups=True).collect():
        assert r.groups_sha256 == (hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "")


def test_empty_extra_columns_and_pairs(spark, tools):
    assert aligned(spark, []) == []
    assert aligned(spark, [(1, None), (2, ""), (3, "▁")]) == brute([(1, None), (2, ""), (3, "▁")], tools)
    rows = [(1, "some words here"), (2, "some words there"), (3, None)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, chunk string, pair int")
    assert sorted(map(tuple, alignment.align(df, *FILES).collect()), key=str) == brute(rows, tools)
    pairs = {(r.a, r.b): (r.docs, r.best) for r in alignment.pair_counts(df, *FILES).collect()}
    a, b = tools
    assert pairs[a.encode(" some").ids[0], b.encode("some")[0]] == (2, True)
