"""Every registered query over the smallest tables, against its SQL or a brute-force version."""

import html
import os
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import pytest

from samerow.llm.oracle import oracle_sql
from samerow.llm.queries import END_ID, N_SHARDS, queries
from samerow.session import shared_folder
from tests.llm import brute

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "pages", "conversations", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.fixture(scope="module")
def documents(duck):
    return dict(duck.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall())


@pytest.fixture(scope="module")
def byte_ids(documents):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = t.encode_batch([x or "" for x in documents.values()], add_special_tokens=False)
    return {d: [*e.ids, END_ID] for d, e in zip(documents, found)}


def by_id(df, key="doc_id"):
    rows = {r[key]: r for r in df.collect()}
    assert len(rows) == df.count()
    return rows


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = queries()[name](spark, SF)
    cursor = duck.execute(oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    expected = sorted(cursor.fetchall(), key=repr)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == expected and expected


def test_op1_files_hold_the_library_ids(spark, byte_ids):
    start = 0
    rows = by_id(queries()["op1_arrow_token_files"](spark, SF))
    assert len(rows) == len(byte_ids)
    for doc, ids in byte_ids.items():
        r = rows[doc]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), brute.crc(ids))
        start += len(ids)


def test_op2_equals_the_library(spark, documents):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    rows = by_id(queries()["op2_bpe_fragments"](spark, SF))
    for doc, text in documents.items():
        ids = t.encode(text or "", add_special_tokens=False).ids
        r = rows[doc]
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == brute.sha(brute.id_bytes(ids))
        assert r["decoded_sha256"] == brute.sha(t.decode(ids, skip_special_tokens=False))


def test_op3_masks_are_the_speakers_own_words(spark):
    rows = queries()["op3_perspective_rotation"](spark, SF).collect()
    whole = defaultdict(list)
    for r in rows:
        whole[r["conv_id"], r["perspective"]].append(r)
    for turns in whole.values():
        turns.sort(key=lambda r: r["start"])
        text = "".join(r["rendered"] for r in turns)
        for r in turns:
            assert text[r["start"] : r["end"]] == r["rendered"]
            masked = text[r["mask_start"] : r["mask_end"]]
            assert masked.endswith("<|end|>") if r["role"] == "assistant" else masked == ""


def test_op4_is_the_article(spark, duck):
    rows = by_id(queries()["op4_line_blocks"](spark, SF), "page_id")
    pages = duck.execute("SELECT page_id, url, html FROM pages").fetchall()
    assert len(pages) == len(rows)
    for page, url, source in pages:
        article = re.search("<article>(.*)</article>", source, re.S)[1]
        blocks = re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", article))
        expected = " ".join(html.unescape(blocks).split())
        assert (rows[page]["url"], rows[page]["text"], rows[page]["n_chars"]) == (url, expected, len(expected))


def test_op5_agrees_with_labels(spark, duck, documents):
    rows = by_id(queries()["op5_weak_supervision"](spark, SF))
    for doc, text in documents.items():
        expected = brute.measures(text)
        assert {k: rows[doc][k] for k in expected} == expected
    labels = duck.execute("SELECT doc_id, quality FROM labels").fetchall()
    judged = [(q, rows[d]["kept"]) for d, q in labels if not rows[d]["base_failed"]]
    good, bad = [k for q, k in judged if q], [k for q, k in judged if not q]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_op7_packs_whole_documents(spark, byte_ids):
    rows = queries()["op7_bin_completion"](spark, SF).collect()
    pieces, bins = defaultdict(dict), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]][r["piece"]] = r
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(byte_ids)
    for doc, ids in byte_ids.items():
        own = [pieces[doc][i] for i in range(len(pieces[doc]))]
        at = 0
        for r in own:
            assert r["start"] == at and r["ids_crc32"] == brute.crc(ids[at : at + r["length"]])
            at += r["length"]
        assert at == len(ids) and len(own) == -(-len(ids) // 1024)
        assert all(r["length"] == 1024 for r in own[1:])
    total = 0
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
        total += at
    assert len(bins) <= 1.02 * -(-total // 1024) + 1


def test_op8_rows_differ_by_one_at_most(spark, documents):
    rows = by_id(queries()["op8_bounded_ring"](spark, SF))
    assert set(rows) == set(documents)
    shards = defaultdict(list)
    for doc, text in documents.items():
        raw = (text or "").encode()
        r = rows[doc]
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 8, zlib.crc32(raw), "rows", None)
        shards[r["shard"]].append(r["slot"])
    sizes = [len(shards[s]) for s in range(N_SHARDS)]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == len(documents)
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())


def test_op9_equals_the_patterns(spark, documents):
    rows = by_id(queries()["op9_trigram_secrets"](spark, SF))
    found = 0
    for doc, text in documents.items():
        spans, r = brute.base_spans(text), rows[doc]
        kinds = Counter(k for _, k, _ in spans)
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == (kinds[0], kinds[1], kinds[2])
        assert r["base_sha256"] == brute.sha(brute.base_written(spans))
        written = r["spans"].split(",") if r["spans"] else []
        assert set(brute.base_written(spans).split(",")) - {""} <= set(written)
        found += len(spans)
    assert found


def test_op10_equals_all_pairs(spark, documents):
    rows = queries()["op10_parity_jaccard"](spark, SF).collect()
    expected = brute.component_ids(list(documents.items()))
    assert sorted(tuple(r) for r in rows) == sorted(expected)
    assert any(c != d for d, _, c in expected)


def test_pipeline(spark, documents, byte_ids):
    import corpus_pipeline
    from samerow.llm.quality import judge

    assert [n for n, _ in corpus_pipeline.STAGES] and 4 <= len(corpus_pipeline.STAGES) <= 5
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = {r["doc_id"] for r in judge(docs).filter("sound and n_words > 0").select("doc.doc_id").collect()}
    last = {}
    for doc in sorted(good):
        last[documents[doc]] = doc
    rows = sorted((d, t) for t, d in last.items())
    firsts = {c for _, _, c in brute.component_ids(rows, 5, 80)}
    shared = Path(shared_folder(spark).removeprefix("file:"))
    stored = set(shared.iterdir())
    packed = corpus_pipeline.run(spark, SF).collect()
    left = [x for x in shared.iterdir() if x not in stored]
    assert len(left) <= 4  # the last stage's input and its own tables
    assert {r["doc_id"] for r in packed} == firsts
    for r in packed:
        if not brute.base_spans(documents[r["doc_id"]]) and r["piece"] == 0:
            assert r["ids_crc32"] == brute.crc(byte_ids[r["doc_id"]][: r["length"]])
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns
