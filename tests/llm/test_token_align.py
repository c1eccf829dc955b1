"""Token alignment against brute force and the plain libraries."""

import bisect
import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from shopframe.llm import queries, token_align
from shopframe.llm.queries import tokenizer_file

PATHS = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")
ODD = [
    "", " ", "  ", "\n", "\n\n", " \n ", "a", "a b", "a  b", "a   b \n\n c", "trailing ", "trailing   ", "\ttab x", "x\ty z",
    "a\r\nb", "a\r b", "<|endoftext|> <s> </s> <unk> <0x41>", "▁a", "x ▁ y", "naïve café", "é 　 x", "漢字 かな 漢字", "a\xa0b c",
    "\x00 \x1c x", "  y", "👍🏽 ok", "don't we'll I'M", "12345 3.14", "ﬁ ²", "word" * 500, "a\x85b", "​ z", " lead", "\n lead",
    "x;\r\n y", "ё" * 300, "a" * 3000,
]


def ids_of(text):
    from tokenizers import Tokenizer
    import sentencepiece

    global _a, _b
    if "_a" not in globals():
        _a = Tokenizer.from_file(PATHS[0])
        _a.encode_special_tokens = True
        _b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    if not text:
        return [], []
    a, b = _a.encode(" " + text, add_special_tokens=False).ids, _b.encode(text)
    pair = token_align.pair_of(*PATHS)
    raw = (" " + text).encode()
    if b"".join(pair.bytes_a[i] for i in a) != raw or b"".join(pair.bytes_b[i] for i in b) != raw:
        return [], []
    return a, b


def spans(ids, tokens):
    at, out = 0, []
    for i in ids:
        out.append((at, at + len(tokens[i]), i))
        at = out[-1][1]
    return out


def brute(texts):
    """One tuple of the result's columns per text."""
    pair, docs, count = token_align.pair_of(*PATHS), [], Counter()
    for text in texts:
        a, b = ids_of(text)
        sa, sb = spans(a, pair.bytes_a), spans(b, pair.bytes_b)
        ends = [e for _, e, _ in sb]
        links = []
        for s, e, i in sa:
            k = bisect.bisect_right(ends, s)
            while k < len(sb) and sb[k][0] < e:
                links.append((i, sb[k][2]))
                k += 1
        count.update(links)
        cuts = sorted({e for _, e, _ in sa} & set(ends))
        groups = []
        for s, e in zip([0, *cuts], cuts):
            one = [",".join(str(i) for x, y, i in side if s <= x and y <= e) for side in (sa, sb)]
            groups.append("|".join(one))
        docs.append((len(a), len(b), len(groups), links, ";".join(groups)))
    top = Counter()
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    return [
        (na, nb, ng, len(links), sum(count[x] == top[x[1]] for x in links), sum(count[x] for x in links),
         text, hashlib.sha256(text.encode()).hexdigest() if text else "")
        for na, nb, ng, links, text in docs
    ]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups", "groups_sha256"]


@pytest.mark.parametrize("chunk", [1 << 22, 100])
def test_odd_texts(spark, monkeypatch, chunk):
    monkeypatch.setattr(token_align, "CHUNK_BYTES", chunk)
    texts = [*ODD, None, *ODD[:12]]
    ids = [None if i == 3 else i // 2 for i in range(len(texts))]  # null and repeated ids
    frame = spark.createDataFrame(
        [(i, t, 1, "a", 2, 3) for i, t in zip(ids, texts)], "doc_id long, text string, chunk int, groups string, codes int, code int"
    )
    got = token_align.align_tokens(frame, *PATHS).select("doc_id", *COLUMNS).collect()
    want = [(i, *r) for i, r in zip(ids, brute(texts))]
    key = lambda r: (r[0] is None, r[0] or 0, *map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    empty = token_align.align_tokens(frame.limit(0), *PATHS)
    assert empty.collect() == [] and empty.columns[0] == "doc_id"


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    columns = [c for c in COLUMNS if c != "groups"]
    want = sorted((d, *r[:6], r[7]) for (d, _), r in zip(rows, brute([t for _, t in rows])))
    got = queries.QUERIES["op11_token_align"](spark, sf)
    assert got.columns == ["doc_id", *columns]
    assert sorted(map(tuple, got.collect())) == want


@settings(max_examples=300, deadline=None, derandomize=True)
@given(st.text(st.one_of(st.sampled_from(" \n\t\r▁.;'aé1漢,\"²s)"), st.characters(codec="utf-8")), max_size=40))
def test_units_encode_as_the_libraries(text):
    pair = token_align.pair_of(*PATHS)
    pair.encode([text])  # what stays known of it does not matter
    n_a, n_b, a, b = pair.encode([text, "a b", text])
    want_a, want_b = ids_of(text)
    more_a, more_b = ids_of("a b")
    assert (a.tolist(), b.tolist()) == (want_a + more_a + want_a, want_b + more_b + want_b)
    assert (n_a.tolist(), n_b.tolist()) == ([len(want_a), len(more_a), len(want_a)], [len(want_b), len(more_b), len(want_b)])


@settings(max_examples=200, deadline=None, derandomize=True)
@given(st.lists(st.tuples(st.integers(1, 200), st.sets(st.integers(1, 199)), st.sets(st.integers(1, 199))), min_size=1, max_size=6))
def test_cuts(docs):
    """Against the plain intersection, cuts of several documents at once."""
    ends_a, ends_b, bounds, want, base = [], [], [], [], 0
    for size, a, b in docs:
        a, b = ({base + x for x in s if x < size} | {base + size} for s in (a, b))
        want += [len(ends_a) + i for i, x in enumerate(sorted(a)) if x in b]
        ends_a += sorted(a)
        ends_b += sorted(b)
        bounds.append(len(ends_a))
        base += size
    assert token_align.shared_cuts(np.array(ends_a), np.array(ends_b), np.array(bounds)).tolist() == want
