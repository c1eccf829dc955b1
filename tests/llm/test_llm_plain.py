"""The operators' parts that need no Spark, against brute force."""

import hashlib
import random
import re
import zlib
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shopframe.llm import chat_format as chat
from shopframe.llm import line_dedup, packing, quality_classifier, quality_rules, secret_scan, simhash, toxicity, warc
from shopframe.llm.queries import tokenizer_file

ANY_TEXT = st.text(st.characters(exclude_categories=["Cs"]), max_size=60)


# packing -------------------------------------------------------------------

@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder(tokenizer_file("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))


WHITE = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (chr(c).isspace() or c in (0x180E, 0x200B, 0x1C))]


@pytest.mark.parametrize("text", [
    "", " ", "It's 10 o'clock, DON'T", "ΣΑΣ όΣ", "İstanbul ıI", "a\x1cb c\x1fd", "<|endoftext|> x", "hello <|endoftext|> world",
    "a<|startoftext|>b", "<|ENDOFTEXT|> y", "<|end oftext|>", "it'S 'sound 'TWAS we'd've x''s", "3.14 12a a12 1st £5 5€ “q” – a…b", "ĳ Ŀ ŉ ſ Ÿ × ÷ ª º µ", "éa ́b", "ﬁ ² Ⅷ ½",
    "naïve ÄÖÜß élan -- ***", "日本語 テスト。", "a_b__c", "🙂🙂 ok", "x" * 500, *[f"ab{c}cd {c}, e" for c in WHITE],
])
def test_ids_equal_the_library(encoder, library, text):
    assert encoder.encode([text])[0].tolist() == [*library.encode(text, add_special_tokens=False).ids, 2]


@settings(max_examples=300, derandomize=True, deadline=None)
@given(ANY_TEXT)
def test_ids_equal_the_library_on_any_text(encoder, library, text):
    assert encoder.encode([text])[0].tolist() == [*library.encode(text, add_special_tokens=False).ids, 2]


@settings(max_examples=400, derandomize=True, deadline=None)
@given(st.text(st.sampled_from([chr(c) for c in [9, 10, 13, *range(32, 127), *range(0xA0, 0x180)] + [0x2013, 0x2014, 0x2018, 0x201E, 0x2026, 0x20AC]]), max_size=40))
def test_ids_equal_the_library_on_plain_text(encoder, library, text):
    assert encoder.encode([text])[0].tolist() == [*library.encode(text, add_special_tokens=False).ids, 2]


def test_every_plain_character_alone_and_inside(encoder, library):
    plain = [chr(c) for c in range(0x3000) if not packing.PLAIN.search(chr(c))]
    assert len(plain) > 250
    texts = [t for c in plain for t in (c, f"ab{c}cd 1{c}2 {c}")]
    want = [[*e.ids, 2] for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in encoder.encode(texts)] == want


def test_cache_that_is_cleared_changes_nothing(encoder, library, monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 3)
    fresh = packing.Encoder(tokenizer_file("word_bpe_49k.json"))
    texts = ["one two three four five", "six one two", None, "seven one eight"] * 3
    for _ in range(3):
        got = fresh.encode(texts)
        assert [g.tolist() for g in got] == [[*library.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]


@pytest.mark.parametrize("sizes", [[1], [4096], [5000, 3, 9000, 1, 1], [1] * 50, [4095, 2, 8192, 7], list(range(1, 200))])
def test_pieces_cover_and_fill(sizes):
    rng = np.random.default_rng(1)
    docs = [rng.integers(3, 60, n).astype("<u4") for n in sizes]
    pieces = list(packing.pack_shard(docs))
    held: dict[int, list] = {}
    for d, start, n, sequence, offset in pieces:
        assert n > 0
        held.setdefault(sequence, []).append((offset, n))
    for d in range(len(docs)):
        own = sorted((s, n) for k, s, n, _, _ in pieces if k == d)
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(n for _, n in own) == len(docs[d])
    for parts in held.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:]))
        size = sum(n for _, n in parts)
        assert size <= 4096 and size & (size - 1) == 0


def test_bm25_scores_and_order():
    rng = random.Random(3)
    docs = [np.array([rng.randint(3, 40) for _ in range(rng.randint(5, 30))] + [2], dtype="<u4") for _ in range(40)]
    index = packing.Index(docs)
    mean = np.mean([len(d) - 1 for d in docs])
    df = {t: sum(t in d[:-1] for d in docs) for t in range(41)}
    for seed in range(0, 40, 7):
        want = []
        for d in docs:
            body, s = d[:-1].tolist(), 0.0
            for t in set(docs[seed][:-1].tolist()):
                tf = body.count(t)
                s += np.log1p((40 - df[t] + 0.5) / (df[t] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(body) / mean))
            want.append(s)
        assert np.allclose(index.scores(seed), want)
        unused = np.ones(40, bool)
        unused[[seed, 3, 9]] = False
        got = list(packing._best(index, seed, unused, 10))
        scores = index.scores(seed)
        assert got == sorted(np.flatnonzero(unused).tolist(), key=lambda i: (-scores[i], i))


# simhash -------------------------------------------------------------------

def naive_fingerprint(text, words=4):
    import xxhash

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    shingles = [" ".join(w[i:i + words]) for i in range(len(w) - words + 1)] or [" ".join(w)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=150, derandomize=True, deadline=None)
@given(st.lists(st.sampled_from(["A", "b", "Ärger", "x\x85y", " ", "of", "THE"]), max_size=14), st.sampled_from([" ", "\n\t", "\x0b"]))
def test_fingerprint_is_the_defined_one(words, blank):
    text = blank.join(words)
    assert simhash.fingerprint(text) == naive_fingerprint(text)


def test_every_link_shares_a_bucket():
    rng = random.Random(5)
    pairs = []
    for bits in range(1, 5):
        for _ in range(1500):
            x = rng.getrandbits(64)
            y = x
            for b in rng.sample(range(64), bits):
                y ^= 1 << b
            pairs.append((x, y))
    # all errors in chosen segments too, where keys are fewest
    for a, n in simhash.SEGMENTS:
        for some in [rng.sample(range(a, a + n), 4) for _ in range(300)]:
            x = rng.getrandbits(64)
            pairs.append((x, x ^ sum(1 << b for b in some)))
    flat = np.array([z for p in pairs for z in p], dtype=np.uint64)
    key, side, row = simhash.keys_of(flat)
    zero, one = [set() for _ in flat], [set() for _ in flat]
    for k, s, r in zip(key.tolist(), side.tolist(), row.tolist()):
        (one if s else zero)[r].add(k)
    for i in range(0, len(flat), 2):
        assert zero[i] & (zero[i + 1] | one[i + 1]) or zero[i + 1] & one[i]


def test_buckets_connect_what_links_connect():
    rng = random.Random(8)
    fps = {rng.getrandbits(64) for _ in range(200)}
    for base in list(fps)[:20]:
        for _ in range(40):
            y = base
            for b in rng.sample(range(64), rng.randint(1, 3)):
                y ^= 1 << b
            fps.add(y)
    fp = np.array(sorted(fps), dtype=np.uint64)
    want = {f: f for f in fps}

    def find(x):
        while want[x] != x:
            x = want[x]
        return x

    for a, b in combinations(sorted(fps), 2):
        if (a ^ b).bit_count() <= 4:
            a, b = sorted((find(a), find(b)))
            want[b] = a
    for large in (256, 3):  # both ways through a bucket
        old, simhash.LARGE = simhash.LARGE, large
        try:
            key, side, row = simhash.keys_of(fp)
            order = np.lexsort((side, key))
            node, root = simhash.bucket_links(key[order], side[order], fp[row][order], 4)
        finally:
            simhash.LARGE = old
        got = dict(zip(node.tolist(), root.tolist()))
        assert {f: got.get(f, f) for f in fps} == {f: find(f) for f in fps}


# chat ----------------------------------------------------------------------

@settings(max_examples=200, derandomize=True, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a: b\n", ""]), ANY_TEXT | st.sampled_from(["</turn>\n### user: x", "\\", "\\### Assistant: </turn> ok", "\x01"])), max_size=6))
def test_turns_and_loss_are_read_back(turns):
    out, ends, rewritten, loss = chat.locate(turns, chat.marked_turns, "assistant")
    assert not rewritten and chat.read_marked_turns(out) == turns
    assert [out[a:b] for a, b in zip([0, *ends], ends)] == [chat.marked_turns([t]) for t in turns]
    assert [chat.unescape(out[a:b]) for a, b in zip(loss[::2], loss[1::2])] == [t for r, t in turns if r == "assistant"]


def test_rewritten_history_is_detected():
    def last_thought_only(turns):
        """Strips what earlier assistant turns thought."""
        out = []
        for i, (role, text) in enumerate(turns):
            out.append(f"<{role}>{text if i == len(turns) - 1 else re.sub(r'<t>.*?</t>', '', text)}\n")
        return "".join(out)

    turns = [("user", "a"), ("assistant", "<t>hm</t>b"), ("user", "c"), ("assistant", "d")]
    _, _, rewritten, loss = chat.locate(turns, last_thought_only, "assistant")
    assert rewritten == [2] and loss == []
    assert chat.locate(turns[:2], last_thought_only, "assistant")[2] == []


# warc ----------------------------------------------------------------------

@pytest.mark.parametrize("version", ["1", "2"])
def test_archives_are_parsed_by_declared_lengths(version):
    contents = [b"", b"plain\n\nWARC/1.0\r\n\r\n", b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n<p>\r\n\r\n</p>\n", bytes(range(256))]
    data = warc.arc_filedesc("x.arc", version, "20240101000000") + b"\n" + b"".join(
        warc.arc_record(version, f"http://h/{i}", "1.2.3.4", "202401020304", "text/html", c, "x.arc") + b"\n" for i, c in enumerate(contents)
    )
    import gzip

    for packed in (data, gzip.compress(data), gzip.compress(data[:50]) + gzip.compress(data[50:])):
        got = list(warc.parse_arc(packed))
        assert [c for _, c in got] == contents and [h["url"] for h, _ in got] == [f"http://h/{i}" for i in range(4)]
    out = b"".join(warc.convert("x.arc", i, h, c, None) + warc.WARC_END.encode() for i, (h, c) in enumerate(got))
    back = list(warc.parse_warc(out))
    assert [b for _, b in back] == contents
    assert [h["WARC-Type"] for h, _ in back] == ["resource", "resource", "response", "resource"]
    assert back[0][0]["WARC-Date"] == "2024-01-02T03:04:00Z"
    assert len({h["WARC-Record-ID"] for h, _ in back}) == 4


def test_bad_archives_raise():
    start = warc.arc_filedesc("x.arc", "1", "20240101000000") + b"\n"
    with pytest.raises(ValueError):
        list(warc.parse_arc(start + b"http://h 1.2.3.4 20240101000000 text/html 50\nshort"))
    with pytest.raises(ValueError):
        list(warc.parse_arc(start + b"http://h text/html 0\n"))
    assert warc.safe_url("http://h/a b\nc") == "http://h/a%20b%0Ac" and warc.safe_url(None) == "about:blank"
    assert warc.w3c_date("x") == "1970-01-01T00:00:00Z"


# toxicity ------------------------------------------------------------------

def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


TERMS, STEMS = ["idiot", "pathetic", "scum", "trash", "worthless"], ["veju", "lowei"]


@settings(max_examples=600, derandomize=True, deadline=None)
@given(st.sampled_from(TERMS + STEMS), st.lists(st.tuples(st.integers(0, 10), st.sampled_from(["i", "t", "x", "ß", ""]), st.booleans()), max_size=3))
def test_automaton_equals_edit_distance(term, changes):
    lexicon = toxicity.Lexicon(TERMS, STEMS)
    word = term
    for at, c, replace in changes:
        word = word[:at] + c + word[at + replace:]
    if any(word.startswith(s) for s in STEMS):
        want = toxicity.STEM
    else:
        distances = [(edit_distance(word, t), toxicity.edits_allowed(t)) for t in TERMS]
        want = toxicity.WHOLE if any(d == 0 for d, _ in distances) else toxicity.FUZZY if any(d <= e for d, e in distances) else 0
    assert lexicon.match(word) == want


def test_quotation_is_told_from_abuse():
    lexicon = toxicity.Words(toxicity.Lexicon(["idiot", "scum"], []))
    abuse = toxicity.features("you idiot , you scum", lexicon)
    quote = toxicity.features('he wrote "idiot scum" in a letter', lexicon)
    misspelled = toxicity.features("what an idi0t he is", lexicon)
    assert abuse[0] > 0 and abuse[3] == 0 and abuse[4] > 0
    assert quote[0] == 0 and quote[3] > 0
    assert misspelled[1] > 0
    assert toxicity.features("", lexicon) == [0.0] * toxicity.N_FEATURES
    assert toxicity.features("idiot", toxicity.Words(toxicity.Lexicon([], []))) == [0.0] * toxicity.N_FEATURES


# secrets -------------------------------------------------------------------

def naive_spans(text):
    word = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found = [(m.start(), 0, m.end()) for m in re.finditer(word, text, re.I | re.A) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


@settings(max_examples=400, derandomize=True, deadline=None)
@given(st.lists(st.sampled_from(["PassWord", "token", "apikey", "API_KEY", "=", ": ", '"', " ", "AKIA", "ABCDEFGHIJ0123456", "deadbeef0123", "é", "ſecret", "x", "İ", "-", "\n"]), max_size=16))
def test_base_spans_are_the_defined_ones(parts):
    text = "".join(parts)
    assert secret_scan.base_spans(text) == naive_spans(text)


def test_random_strings_are_found_and_harmless_ones_are_not():
    import base64

    encoding = secret_scan.vocabulary(tokenizer_file("byte_bpe_50k.tiktoken"))
    rng = random.Random(4)
    for _ in range(100):
        s = base64.b64encode(rng.randbytes(30)).decode()
        assert secret_scan.random_spans(f"key {s}, ok", encoding, 20, 2.2) == [(4, 3, 4 + len(s))]
    for s in [
        hashlib.md5(b"x").hexdigest(), hashlib.sha1(b"x").hexdigest(), hashlib.sha256(b"x").hexdigest().upper(),
        "123e4567-e89b-12d3-a456-426614174000", "some_long_identifier_of_a_program_2024", "internationalization/of/paths", "unconscionableness",
    ]:
        assert secret_scan.random_spans(f"key {s}, ok", encoding, 16, 2.2) == []
    assert secret_scan.redacted("a token=abcdef b", secret_scan.written(secret_scan.base_spans("a token=abcdef b"))) == "a [assign] b"


def test_random_strings_behind_long_paths_and_names_are_found():
    import base64
    import string

    encoding = secret_scan.vocabulary(tokenizer_file("byte_bpe_50k.tiktoken"))
    rng = random.Random(5)
    for before in ("com/customer/account/settings/notification/callback/", "session_identifier_for_customer_account="):
        for size in (20, 24, 32, 40):
            for _ in range(25):
                key = "".join(rng.choices(string.ascii_letters + string.digits, k=size))
                text = f"see {before}{key}/customer/account"
                [(i, _, j)] = secret_scan.random_spans(text, encoding, 20, 2.2)
                assert i <= 4 + len(before) and j >= 4 + len(before) + size
        for _ in range(50):  # keys that hold separators themselves
            key = base64.urlsafe_b64encode(rng.randbytes(30)).decode()
            a = 4 + len(before)
            [(i, _, j)] = secret_scan.random_spans(f"see {before}{key} ok", encoding, 20, 2.2)
            assert min(j, a + 40) - max(i, a) >= 30
    for s in ["com/blog/2024/01/15/how-to-write-a-good-test-in-python", "usr/local/lib/python/site-packages/numpy/core",
              "com/files/d41d8cd98f00b204e9800998ecf8427e/download/customer/account", "someLongCamelCaseIdentifierOfAProgram"]:
        assert secret_scan.random_spans(f"see {s} ok", encoding, 20, 2.2) == []


def test_random_strings_of_one_case_are_found_and_words_are_not():
    import string

    encoding = secret_scan.vocabulary(tokenizer_file("byte_bpe_50k.tiktoken"))
    rng = random.Random(6)
    found = tried = 0
    for letters in (string.ascii_lowercase, string.ascii_uppercase):
        for size in (20, 24, 32, 40):
            for _ in range(25):
                key = "".join(rng.choices(letters, k=size))
                groups = "-".join([*(key[i:i + 5] for i in range(0, size, 5)), str(rng.randrange(10**7, 10**8))])
                for s in (key, groups, "customer/account/" + key):
                    tried += 1
                    found += any(j >= 4 + len(s) for _, _, j in secret_scan.random_spans(f"key {s} ok", encoding, 20, 2.2))
    assert found >= 0.97 * tried
    for s in ["INTERNATIONALIZATION_OF_THINGS_AND_STRINGS", "MAX_RETRY_COUNT_PER_REQUEST_2024", "a/b/c/d/e/f/g/h/i/j/k/l/m",
              "en-us-gb-fr-2024-01-15-id-7", "id-20240115-12345678-001", "Donaudampfschifffahrtsgesellschaft",
              "Rechtsschutzversicherungsgesellschaften", "anticonstitutionnellement", "electroencefalografista"]:
        assert secret_scan.random_spans(f"key {s} ok", encoding, 20, 2.2) == []


# quality rules -------------------------------------------------------------

@settings(max_examples=300, derandomize=True, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=40), st.integers(1, 3))
def test_repeated_words(words, times):
    words = words * times
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    cover = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 8)}
    assert quality_rules.repeated_words(words) == len(cover)


def test_base_figures():
    n, chars, symbols, dup, repeat, _ = quality_rules.text_statistics("a é# b\n\n \na é# b\n*|x\n\n")
    assert (n, chars, symbols, dup, repeat) == (7, 11, 4, 1, 0)
    assert quality_rules.text_statistics(None)[:5] == (0, 0, 0, 0, 0)


# line dedup ----------------------------------------------------------------

def test_leaf_generalises_fields():
    leaf = line_dedup.Leaf(0.8)
    a = "the user Anna logged in from the north gate today".encode().split()
    b = "the user Berta logged in from the north gate today".encode().split()
    c = "the user Carla went off to a south wall yesterday".encode().split()
    assert [leaf.place(a, 1), leaf.place(b, 2), leaf.place(c, 3), leaf.place(a, 4)] == [1, 1, 3, 1]
    assert leaf.templates[0][2] == line_dedup.FIELD


# classifier ----------------------------------------------------------------

def test_views_have_one_size():
    for text in (None, "", "a", "A!! B!! C!!", "x " * 500):
        assert len(quality_classifier.content_view(text)) == len(quality_classifier.PUNCTUATION) + 8
        assert len(quality_classifier.metadata_view(text, None, "s")) == 4 + 2 * quality_classifier.BUCKETS


def test_newton_steps_reach_the_plain_fit():
    """Steps over sums equal a fit on the rows themselves."""
    rng = np.random.default_rng(1)
    y = np.tile([0.0, 1.0], 40)
    x = np.column_stack([y + rng.normal(size=80), rng.normal(size=80)])
    views = [quality_classifier.View(x, y), quality_classifier.View(x[:, ::-1], y)]
    sure = [v.weights * 9 for v in views]  # so that the views are sure of some
    more = rng.normal(size=(200, 2)) * 2
    for _ in range(12):
        flat = quality_classifier.pseudo_sums([more, more[:, ::-1]], views, sure)
        d = 3
        half = 2 * (1 + d + d * d)
        for v, part in zip(views, (flat[:half], flat[half:])):
            one = [part[i * half // 2:(i + 1) * half // 2] for i in (0, 1)]
            v.step([(o[0], o[1:1 + d], o[1 + d:].reshape(d, d)) for o in one])
    for taker, giver, data, other in ((0, 1, more, more[:, ::-1]), (1, 0, more[:, ::-1], more)):
        view = views[taker]
        p = quality_classifier.sigmoid(views[giver].standard(other) @ sure[giver])
        picks = [np.flatnonzero(p <= 0.05), np.flatnonzero(p >= 0.95)]
        assert min(map(len, picks)) > 5
        gradient = view.x.T @ (view.y - quality_classifier.sigmoid(view.x @ view.weights))
        for label, rows in enumerate(picks):
            z = view.standard(data[rows])
            gradient += len(view.y) / 2 / len(rows) * z.T @ (label - quality_classifier.sigmoid(z @ view.weights))
        penalty = np.array([2.0, 2.0, 1e-6])
        assert np.abs(gradient - penalty * view.weights).max() < 1e-6


# toxicity: stems and words -------------------------------------------------

def test_misspellings_inside_a_stem_are_found():
    words = toxicity.Lexicon(["idiot"], [])
    both = toxicity.Lexicon(["idiot"], ["idio"])
    for word in ("idiot", "id1ot", "ldiot", "iidiot", "idot"):
        assert words.match(word) and both.match(word) == words.match(word), word
    assert both.match("idiocy") == toxicity.STEM and not words.match("idiocy")
    assert both.match("idiots") == words.match("idiots")
    assert not both.match("studio")
