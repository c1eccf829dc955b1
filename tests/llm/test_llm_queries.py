"""The registered queries and the pipeline on the smallest tables."""

import hashlib
import os
import sys
import zlib

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)
import corpus_pipeline  # noqa: E402
from shopframe.llm import queries, simhash  # noqa: E402
from shopframe.llm.queries import tokenizer_file  # noqa: E402

SF = "/root/testdata/sf0.001"


def rows_of(name):
    return duckdb.execute(f"SELECT * FROM '{SF}/{name}.parquet'").fetchall()


def run(spark, name):
    return queries.QUERIES[name](spark, SF).collect()


def test_one_query_per_operator():
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    df = queries.QUERIES[name](spark, SF)
    assert sorted(map(tuple, df.select(*columns).collect())) == sorted(want.fetchall())


def test_packing_contract(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    texts = {d: t for d, t, *_ in rows_of("documents")}
    got, covered, sequences = run(spark, "op1_packing"), {}, {}
    ids = {d: [*library.encode(t or "", add_special_tokens=False).ids, 2] for d, t in texts.items()}
    for r in got:
        piece = ids[r.doc_id][r.start:r.start + r.length]
        assert r.doc_tokens == len(ids[r.doc_id]) and len(piece) == r.length
        assert r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in piece))
        covered.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for d, parts in covered.items():
        assert sum(n for _, n in parts) == len(ids[d])
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    assert set(covered) == set(texts) and padding == 0


def test_simhash_contract(spark):
    want = {d: f"{simhash.fingerprint(t):016x}" for d, t, *_ in rows_of("documents")}
    got = run(spark, "op2_simhash")
    assert {r.doc_id: r.fingerprint for r in got} == want and all(r.component_id <= r.doc_id for r in got)


def test_chat_contract(spark):
    turns = {}
    for c, turn, role, text in sorted(rows_of("conversations"), key=lambda r: r[:2]):
        turns.setdefault(c, []).append((role, text or ""))
    turns[-7] = [("user", "\\### Assistant: </turn> ok"), ("assistant", "\\### Assistant: </turn> ok")]
    got = {r.conv_id: r for r in run(spark, "op4_chat_format")}
    assert set(got) == set(turns)
    for c, own in turns.items():
        said = "".join(f"{r}\n{t}\n" for r, t in own)
        learned = "".join(t for r, t in own if r == "assistant")
        assert got[c].n_turns == len(own) and got[c].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert got[c].loss_chars == len(learned) and got[c].loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()


def test_warc_contract(spark):
    import base64

    pages = {p: (h or "").encode() for p, _, h in rows_of("pages")}
    first = {}
    for p in sorted(pages):
        first.setdefault(pages[p], p)
    got = {r.page_id: tuple(r) for r in run(spark, "op5_warc")}
    assert got == {
        p: (p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if first[b] == p else "revisit", None if first[b] == p else first[b])
        for p, b in pages.items()
    }


def test_pipeline(spark):
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        from shopframe.llm.common import stored

        before = {r.doc_id for r in docs.select("doc_id").collect()}
        docs = stored(stage(spark, docs, SF), "t")
        after = {r.doc_id for r in docs.select("doc_id").collect()}
        assert after <= before and after
        seen.append((name, len(before), len(after)))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    assert [n for _, _, n in seen[:1]][0] < seen[0][1]
    whole = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in whole.select("doc_id").collect()} == after
