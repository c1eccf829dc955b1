"""The operators as Spark jobs: against brute force, and on odd rows."""

import itertools
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shopframe.llm import (
    chat_format, decontam, line_dedup, packing, quality_classifier, quality_rules, secret_scan, simhash, toxicity, warc,
)
from shopframe.llm.queries import tokenizer_file

DOCS = (
    "doc_id long, text string, lang string, source string, n_chars long, line string, key string, h string, i int, home long, "
    "_doc int, _lines int, _LOST string, _kept int, _found int, _parts int, __parts int, _times int, n int, lines int, fp string, w string"
)
SENTENCE = "the quick brown fox jumps over the lazy dog near the old river bank today"
VERY_LONG = " ".join(f"word{i} of the text" for i in range(30_000))


def frame(spark, rows):
    """Documents with extra columns whose names operators use inside."""
    return spark.createDataFrame(
        [(*r, "x", "y", "z", 1, 2, 1, 2, "l", 3, 4, 5, 6, 7, 8, 9, "f", "w") for r in rows], DOCS
    )


def odd_documents(spark):
    return frame(spark, [
        (1, SENTENCE, "en", "a", 5), (2, SENTENCE, "en", "a", 5), (2, SENTENCE, "en", "a", 5), (3, None, None, None, None),
        (4, "", "en", None, 0), (None, SENTENCE + " again", "en", "a", 1), (5, VERY_LONG, "de", "b", 9), (6, " \n\t ", "en", "a", 1),
        (None, None, None, None, None), (7, "one", "en", "b", 3),
    ])


def empty_documents(spark):
    return frame(spark, [])


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


BENCHMARK = "item_id long, text string, doc_id long, h string"
OPERATORS = {
    "pack": lambda s, d: packing.pack(d, tokenizer_file("word_bpe_49k.json")),
    "simhash": lambda s, d: simhash.near_duplicates(d),
    "keep_one": lambda s, d: simhash.keep_one(d),
    "lines": lambda s, d: line_dedup.drop_recurring_lines(d),
    "toxicity": lambda s, d: toxicity.score_toxicity(d, labels_of(s, [(1, 1, 0), (None, 1, 1), (2, None, None), (7, 0, 1)])),
    "secrets": lambda s, d: secret_scan.scan_secrets(d, tokenizer_file("byte_bpe_50k.tiktoken")),
    "classifier": lambda s, d: quality_classifier.score_quality(d, labels_of(s, [(1, 1, 0), (2, None, 0), (None, 0, 0), (7, 0, 1)])),
    "keep_good": lambda s, d: quality_classifier.keep_good(d, labels_of(s, [])),
    "rules": lambda s, d: quality_rules.judge_quality(d),
    "overlaps": lambda s, d: decontam.find_overlaps(d, s.createDataFrame([(1, SENTENCE, 1, ""), (2, None, 1, ""), (None, "a b", 1, "")], BENCHMARK)),
    "decontaminated": lambda s, d: decontam.drop_contaminated(d, s.createDataFrame([], BENCHMARK)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table_gives_an_empty_result(spark, name):
    assert OPERATORS[name](spark, empty_documents(spark)).count() == 0


def result(spark, name):
    return OPERATORS[name](spark, odd_documents(spark)).collect()


def test_odd_documents_pack(spark):
    got = result(spark, "pack")
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got if r.start == 0) == sorted(
        (i is None, i or 0) for i in (1, 2, 2, 3, 4, None, 5, 6, None, 7)
    )
    assert {r.doc_id: r.doc_tokens for r in got}[3] == 1
    assert sum(r.length for r in got if r.doc_id == 5) == next(r.doc_tokens for r in got if r.doc_id == 5)


def test_odd_documents_simhash(spark):
    got = {(r.doc_id, r.fingerprint): r.component_id for r in result(spark, "simhash")}
    assert got[(3, "0" * 16)] == got[(4, "0" * 16)] == got[(6, "0" * 16)] == got[(None, "0" * 16)] == 3
    assert {c for (i, _), c in got.items() if i in (1, 2)} == {1}
    assert len(result(spark, "simhash")) == 10
    kept = result(spark, "keep_one")
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [1, 3, 5, 7] and kept[0].home == 2
    assert sum(r.doc_id is None for r in kept) == 2


def test_odd_documents_lines(spark):
    got = [(r.doc_id, r.text) for r in result(spark, "lines")]
    assert sorted(t for i, t in got if i == 2) == ["", ""]
    assert (1, SENTENCE) in got and (3, None) in got and (4, "") in got and (None, SENTENCE + " again") in got
    assert (5, VERY_LONG) in got and len(got) == 10


def test_odd_documents_scores(spark):
    got = result(spark, "toxicity")
    assert len(got) == 10 and all(0 <= r.score <= 1 for r in got)
    assert {r.doc_id for r in got if r.held_out} == {i for i in (1, 2, 3, 4, 5, 6, 7) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert len(result(spark, "classifier")) == 10
    assert len(result(spark, "keep_good")) == 10  # nothing to learn from: all stay
    rules = {r.doc_id: r for r in result(spark, "rules")}
    assert rules[3].base_failed and not rules[7].kept and rules[5].n_words == 120_000
    secrets = result(spark, "secrets")
    assert len(secrets) == 10 and all(r.spans == "" for r in secrets)


def test_odd_documents_overlaps(spark):
    got = {(r.doc_id, r.item_id): r.matches for r in result(spark, "overlaps")}
    assert got == {(1, 1): 13, (2, 1): 13, (None, 1): 13}
    assert len(result(spark, "decontaminated")) == 10


# brute force ---------------------------------------------------------------

def naive_overlaps(docs, items, window=13, least=9):
    def tokens(t):
        return re.findall(r"[^\W_]+", (t or "").lower())

    out = {}
    for d, text in docs:
        a = tokens(text)
        for k, item in items:
            b = tokens(item)
            size = min(window, len(b))
            for i in range(len(a) - size + 1):
                for j in range(len(b) - size + 1):
                    same = sum(x == y for x, y in zip(a[i:i + size], b[j:j + size]))
                    if size and (same == size if size < 6 else same * window >= size * least):
                        out[(d, k)] = max(out.get((d, k), 0), same)
    return out


def test_overlaps_equal_brute_force(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    items = [(k, " ".join(rng.choices(words, k=rng.randint(13, 30)))) for k in range(12)]
    docs = []
    for d in range(60):
        body = rng.choices(words, k=rng.randint(0, 60))
        passage = items[d % 12][1].split()
        for at in rng.sample(range(len(passage)), rng.randint(0, len(passage) // 3)):
            passage[at] = "Other"
        cut = passage[rng.randint(0, 4):]
        docs.append((d, " ".join(body + cut + body[:5]) if d % 3 else " ".join(body)))
    got = decontam.find_overlaps(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    ).collect()
    want = naive_overlaps(docs, items)
    assert {(r.doc_id, r.item_id): r.matches for r in got} == want and len(want) > 20


@pytest.mark.parametrize("sizes", [(1, 20), (6, 12), (1, 6)])
def test_short_items_equal_brute_force(spark, sizes):
    """Items of few tokens, with as many other words as their rule allows and
    more, at every place."""
    rng = random.Random(sum(sizes))
    words = [f"w{i}" for i in range(90)]
    items = [(k, " ".join(rng.choices(words, k=rng.randint(*sizes)))) for k in range(30)]
    docs = []
    for d in range(240):
        body, passage = rng.choices(words, k=rng.randint(0, 25)), items[d % 30][1].split()
        for at in rng.sample(range(len(passage)), min(len(passage), d // 30 % 5)):
            passage[at] = "Other"
        docs.append((d, " ".join([*body, *passage, *body[:4]])))
    got = decontam.find_overlaps(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    ).collect()
    want = naive_overlaps(docs, items)
    assert {(r.doc_id, r.item_id): r.matches for r in got} == want and len(want) > 100


def test_masks_are_complete():
    """Wherever the differing positions lie, a mask sees equal ones only."""
    for n in range(6, 14):
        masks = next(m for low, high, m in decontam.GROUPS if low <= n < high)
        for bad in itertools.combinations(range(n), n - math.ceil(9 * n / 13)):
            assert any(not {s + o for o in m} & set(bad) for m in masks for s in range(n - m[-1])), (n, bad)


def test_bit_set_grows_with_the_benchmark(spark, monkeypatch):
    sizes = []
    build = decontam._bit_set
    monkeypatch.setattr(decontam, "_bit_set", lambda seeds, words: (sizes.append(words), build(seeds, words))[1])
    monkeypatch.setattr(decontam, "LEAST_WORDS", 4)
    monkeypatch.setattr(decontam, "MOST_WORDS", 4096)
    docs = spark.createDataFrame([(1, SENTENCE), (2, "nothing else")], "doc_id long, text string")
    for n in (1, 40, 2000):
        items = spark.createDataFrame([(0, SENTENCE), *((k, f"{k} " * 14 + "other") for k in range(1, n))], "item_id long, text string")
        assert [tuple(r)[:3] for r in decontam.find_overlaps(docs, items).collect()] == [(1, 0, 13)]
    assert sizes[0] < sizes[1] < sizes[2] == 4096


def test_overlap_operator_runs_no_python(spark):
    docs = spark.createDataFrame([(1, SENTENCE)], "doc_id long, text string")
    items = spark.createDataFrame([(1, SENTENCE)], "item_id long, text string")
    plan = decontam.find_overlaps(docs, items)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_components_equal_brute_force(spark):
    """Texts whose fingerprints lie near each other, by long common parts."""
    rng = random.Random(6)
    docs = []
    for g in range(15):
        base = [f"g{g}w{rng.randint(0, 999)}" for _ in range(300)]
        for _ in range(8):
            own = list(base)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(300)] = f"new{rng.randint(0, 9999)}"
            docs.append((len(docs) + 10, " ".join(own)))
    rng.shuffle(docs)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(
        spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    fps = {d: simhash.fingerprint(t) for d, t in docs}
    root = {d: d for d in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in fps:
        for b in fps:
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                a_, b_ = sorted((find(a), find(b)))
                root[b_] = a_
    assert got == {d: (f"{f:016x}", find(d)) for d, f in fps.items()}
    assert len({c for _, c in got.values()}) < len(docs) - 20


def test_long_chain_is_one_component(spark):
    """A path of links needs several rounds."""
    links = [(i, i + 1) for i in range(300)] + [(1000, 2000)]
    random.Random(1).shuffle(links)
    got = {r.node: r.root for r in simhash.connect(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 301)}, 2000: 1000}


def naive_lines(docs, min_tokens=1, similarity=0.8):
    first, places = {}, []
    for d, text in docs:
        if text is None or d is None:
            continue
        for no, raw in enumerate(text.split("\n")):
            tokens = tuple("<*>" if re.search("[0-9]", t) else t for t in re.split(r"[\x20\x09-\x0D]+", raw.strip(" \t\n\x0b\x0c\r")) if t)
            if len(tokens) >= min_tokens and set(tokens) != {"<*>"}:
                places.append((d, no, tokens))
                first[tokens] = min(first.get(tokens, d), d)
    leaves = {}
    for tokens in first:
        leaves.setdefault((len(tokens), tokens[:4]), []).append(tokens)
    return first, places, leaves


def test_lines_equal_sequential_parsing(spark):
    rng = random.Random(9)
    pool = [f"user {rng.choice('abc')} opened the door number {{}} in wing {{}} at noon" for _ in range(6)]
    prose = [" ".join(rng.choices("red green blue cat dog sun".split(), k=rng.randint(1, 9))) for _ in range(60)] + ["", "12", "7 8 9 10 11", "page 4", "page 17", "}"]
    docs = []
    for d in range(40):
        lines = [rng.choice(pool).format(rng.randint(0, 99), rng.choice("xyz")) for _ in range(2)] + rng.choices(prose, k=6)
        rng.shuffle(lines)
        docs.append((d + 1, "\n".join(lines)))
    got = {r.doc_id: r.lines for r in line_dedup.recurring_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    first, places, leaves = naive_lines(docs)
    line_hash = {r.t: r.h for r in spark.createDataFrame([(" ".join(t),) for t in first], "t string").select("t", F.xxhash64("t").alias("h")).collect()}
    home = {}
    for members in leaves.values():
        templates = []
        for tokens in sorted(members, key=lambda t: (first[t], line_hash[" ".join(t)])):
            scored = [(sum(a == b for a, b in zip(t, tokens)), -k) for k, (t, _) in enumerate(templates)]
            scored = [x for x in scored if x[0] >= 0.8 * len(tokens) - 1e-9]
            if scored:
                k = -max(scored)[1]
                templates[k][0][:] = [a if a == b else "<*>" for a, b in zip(templates[k][0], tokens)]
                home[tokens] = templates[k][1]
            else:
                templates.append((list(tokens), first[tokens]))
                home[tokens] = first[tokens]
    want = {}
    for d, no, tokens in places:
        if d != home[tokens]:
            want.setdefault(d, []).append(no)
    assert got == want and want


def test_warc_archives_round_trip(spark):
    pages = [
        (5, "http://a/5", "<p>x</p>"), (3, "http://a/3", "<p>x</p>"), (9, None, None), (8, "http://b c", ""),
        (7, "http://a/7", "ünï\r\n\r\nWARC/1.0"), (None, "http://n", "<p>x</p>"), (3, "http://a/3", "<p>x</p>"),
    ]
    df = spark.createDataFrame([(*p, "q") for p in pages], "page_id long, url string, html string, record string").repartition(3)
    records, path = warc.archive_pages(df)
    got = sorted((r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes, r.url) for r in records.collect())
    assert got == sorted([
        (5, "revisit", 3, 8, "http://a/5"), (3, "response", None, 8, "http://a/3"), (9, "revisit", 8, 0, "about:blank"),
        (8, "response", None, 0, "http://b%20c"), (7, "response", None, 17, "http://a/7"), (0, "revisit", 3, 8, "http://n"),
        (3, "revisit", 3, 8, "http://a/3"),
    ])
    assert warc.read_warc(spark, path).count() == 7
    few, _ = warc.archive_pages(df, min_payload=1)
    assert {(r.page_id, r.record_type) for r in few.collect() if r.page_id in (8, 9)} == {(8, "response"), (9, "response")}
    none, _ = warc.archive_pages(df.limit(0))
    assert none.count() == 0


def test_conversations_in_turn_order(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (None, 0, "user", "n"), (2, 0, None, None), (2, 0, "user", "t"), (2, 0, "user", "t")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat_format.format_conversations(df).collect()}
    assert got[1].formatted == "### user: a</turn>\n### assistant: b</turn>\n" and got[None].formatted == "### user: n</turn>\n"
    assert chat_format.read_marked_turns(got[2].formatted) == [("", ""), ("user", "t"), ("user", "t")]
    assert got[1].formatted[got[1].loss[0]:got[1].loss[1]] == "b"
    assert chat_format.format_conversations(df.limit(0)).count() == 0

    def newest_first(turns):
        return "".join(f"{r}|{t}\n" for r, t in reversed(turns))

    rewriting = {r.conv_id: r for r in chat_format.format_conversations(df, template=newest_first).collect()}
    assert rewriting[1].rewritten == [1] and rewriting[1].loss == []


def test_outliers_are_rejected_and_the_rest_kept(spark):
    rng = random.Random(3)
    vocabulary = [f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in "lmnr"]
    rows = []
    for d in range(900):
        words = rng.choices(vocabulary, k=rng.randint(40, 400))
        if d % 10 == 0:
            words = [w + "###" for w in words]
        rows.append((d, ". ".join(words), "en" if d % 3 else "de", "hot" if d % 2 else "rare" if d == 4 else None, 0))
    got = {r.doc_id: r.kept for r in quality_rules.judge_quality(frame(spark, rows)).collect()}
    assert got == {d: d % 10 != 0 for d in range(900)}


@pytest.mark.parametrize("share", [10, 20])
def test_a_cluster_of_outliers_does_not_hide_itself(spark, share):
    rng = random.Random(5)
    vocabulary = [f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in "lmnr"]
    rows = []
    for d in range(1500):
        words = rng.choices(vocabulary, k=rng.randint(40, 400))
        if d % 100 < share:  # templated: one form, the words differ
            words = [w.upper() + "##" for w in rng.choices(vocabulary, k=rng.randint(150, 160))]
        rows.append((d, ". ".join(words), "en" if d % 3 else "de", "hot", 0))
    got = {r.doc_id: r.kept for r in quality_rules.judge_quality(frame(spark, rows)).collect()}
    assert got == {d: d % 100 >= share for d in range(1500)}


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scored = toxicity.score_toxicity(docs, labels).where("held_out").join(labels, "doc_id")
    right = {(r.toxic, r.predicted): r["count"] for r in scored.groupBy("toxic", "predicted").count().collect()}
    assert right[(1, 1)] >= 0.9 * (right[(1, 1)] + right.get((1, 0), 0))
    assert right[(0, 0)] >= 0.98 * (right[(0, 0)] + right.get((0, 1), 0))
    # the classifier learns from ids that are even and is judged on the rest
    learned = labels.where("doc_id % 2 = 0")
    judged = quality_classifier.score_quality(docs, learned).join(labels.where("doc_id % 2 = 1"), "doc_id")
    kept = {(r.quality, r.kept): r["count"] for r in judged.groupBy("quality", "kept").count().collect()}
    assert kept[(1, True)] >= 0.995 * (kept[(1, True)] + kept.get((1, False), 0))
    assert kept[(0, False)] >= 0.95 * (kept[(0, False)] + kept.get((0, True), 0))


def test_lines_of_scripts_without_spaces(spark):
    one = "これは吾輩が書いた長い文章であり何度も同じ形で現れるので一度だけ残すべきものである"
    near = one.replace("長い", "短い")  # one character in over forty
    other = "全く違う内容の段落がここにあり他のどの文書にも現れないのでそのまま残るはずだと思う"
    docs = [(1, f"{one}\nfirst"), (2, f"second\n{one}"), (3, f"{near}\nthird"), (4, other), (5, "{\nYes"), (6, "Yes\n12\n")]
    got = {r.doc_id: r.text for r in line_dedup.drop_recurring_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: f"{one}\nfirst", 2: "second", 3: "third", 4: other, 5: "{\nYes", 6: "12\n"}


def test_very_many_lines(spark):
    # a text of a million recurring lines, and many lines in one leaf
    rng = random.Random(2)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(600)]
    leaf = ["one two three four " + " ".join(rng.choices(words, k=12)) for _ in range(20_000)]
    docs = [(1, "same\nline"), (2, "same\n" * 1_000_000 + "end"), (3, "\n".join(leaf)), (4, "\n".join(leaf[:100] + ["mine"]))]
    begun = time.time()
    got = {r.doc_id: r.text for r in line_dedup.drop_recurring_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[1] == docs[0][1] and got[2] == "end" and got[3] == docs[2][1] and got[4] == "mine"
    assert time.time() - begun < 90


def test_learned_words_stay_beside_their_stems(spark):
    plain = [(0, f"a calm text number {i} about the garden") for i in range(60)]
    bad = [(1, f"you {w} go away number {i}") for i in range(6) for w in ("idiot", "idiotic", "idiots", "idioms")]
    words, stems = toxicity.learn_lexicon(spark.createDataFrame(plain + bad, "label int, text string"), min_odds=2.0)
    assert "idiot" in words and any("idiot".startswith(s) for s in stems)
    assert toxicity.Lexicon(words, stems).match("id1ot")


def _vectors(rng, n, shift=0.0):
    """Texts of one style: statistics that vary little."""
    out = []
    for _ in range(n):
        words = [rng.choice(["river", "garden", "window", "table", "morning", "letter", "stone"]) for _ in range(rng.randint(80, 100))]
        text = " ".join(words[:40]) + ".\n" + " ".join(words[40:]) + "."
        out.append(text)
    return out


@pytest.mark.parametrize("size", [151, 199, 201, 251])
def test_one_verdict_at_every_group_size(spark, size):
    rng = random.Random(3)
    odd = " ".join([f"x{i}# y{i}$" for i in range(60)] + ["q" * 30 + str(i) for i in range(30)])  # symbols and long words
    rows = [(i, t, "en", "tidy", 1) for i, t in enumerate(_vectors(rng, size))] + [(9999, odd, "en", "tidy", 1)]
    # another source, whose texts vary much
    for i in range(300):
        words = ["w" * rng.randint(1, 14) + rng.choice(["", ",", "#", "1"]) for _ in range(rng.randint(25, 400))]
        rows.append((20_000 + i, " ".join(words), "en", "wild", 1))
    got = {r.doc_id: r for r in quality_rules.judge_quality(frame(spark, rows)).collect()}
    assert not got[9999].kept and not got[9999].base_failed
    assert sum(got[i].kept for i in range(size)) >= 0.97 * size


def test_estimates_equal_numpy(spark):
    """The shrunk estimates of one concentration step against numpy."""
    rng = np.random.default_rng(4)
    p = quality_rules.N_STATS
    rows = [(l, s, (rng.normal(size=p) * (1 + k) + k).tolist()) for k, (l, s) in enumerate([("en", "a"), ("en", "b"), ("de", "a"), (None, None)])
            for _ in range([40, 3, 90, 1][k])]
    df = spark.createDataFrame(rows, "lang string, source string, x array<double>")
    got, _ = quality_rules._estimates(quality_rules._sums(df), 1.0)
    mean = {}

    def moments(chosen):
        x = np.array(chosen)
        return x.mean(axis=0), np.cov(x.T, bias=True) if len(x) > 1 else np.zeros((p, p)), len(x)

    def shrunk(own, parent):
        m, c, n = own
        w = n / (n + quality_rules.PRIOR_ROWS)
        return w * m + (1 - w) * parent[0], w * c + (1 - w) * parent[1]

    every = moments([x for *_, x in rows])[:2]
    for r in got.collect():
        language = shrunk(moments([x for l, _, x in rows if l == r.lang]), every)
        m, c = shrunk(moments([x for l, s, x in rows if (l, s) == (r.lang, r.source)]), language)
        c = c + np.diag(np.maximum(np.array(quality_rules.FLOORS) ** 2 - np.diag(c), 1e-9))
        assert np.allclose(r["mean"], m, atol=1e-9)
        assert np.allclose(np.array(r["inverse"]).reshape(p, p), np.linalg.inv(c), atol=1e-6)
        mean[r.lang, r.source] = m
    assert len(mean) == 4


def test_sure_labels_teach_the_other_view(spark):
    rng = np.random.default_rng(0)
    y = np.tile([0.0, 1.0], 300)
    text = np.column_stack([*(y * 12 + rng.normal(size=600) for _ in range(3))])
    meta = np.column_stack([y * 2 + rng.normal(size=600), rng.normal(size=600)])
    few, rest = slice(0, 60), slice(400, 600)
    pool = spark.createDataFrame(
        [(a.tolist(), b.tolist()) for a, b in zip(text[60:400], meta[60:400])], "c array<double>, m array<double>"
    )
    alone = quality_classifier.View(meta[few], y[few])
    views = [quality_classifier.View(text[few], y[few]), quality_classifier.View(meta[few], y[few])]
    quality_classifier.co_train(pool, views, 3, 3)
    rate = [np.mean((v.raw(meta[rest]) > 0) == (y[rest] == 1)) for v in (alone, views[1])]
    assert rate[1] >= rate[0] and rate[1] > 0.8
    assert np.abs(views[1].weights - alone.weights).max() > 0.01
    quality_classifier.co_train(pool.limit(0), views, 3, 3)  # nothing to learn from
