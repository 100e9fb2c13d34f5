"""The registered queries of the subpackage on the smallest tables: against their SQL, or plain Python."""

import hashlib
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loomfield.llm import queries as Q
from test_queries import SF, TABLES, canonical

ORACLES = Q.oracle_sql()


@pytest.fixture(scope="module")
def rows(sample):
    return sample.select("doc_id", "text", "lang").collect()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = Q.queries()[name](spark, SF).toPandas(), con.execute(ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns) and canonical(got) == canonical(want) and len(got)


def test_packing(spark, rows):
    found = Q.op5_packing(spark, SF).collect()
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for r in rows:
        ids = np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        for k in range(-(-len(ids) // 4096)):
            part = ids[4096 * k : 4096 * (k + 1)]
            want[(r.doc_id, k, 4096 * k, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == want


def test_simhash(spark, rows):
    from test_set_operators import plain_groups

    assert Counter(tuple(r) for r in Q.op7_simhash(spark, SF).collect()) == plain_groups([(r.doc_id, r.text) for r in rows])


def test_sharding(spark, rows):
    from test_set_operators import plain_loads

    found = Q.op8_sharding(spark, SF).collect()
    size = lambda t: 16 + len((t or "").encode())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == Counter((r.doc_id, size(r.text), zlib.crc32((r.text or "").encode())) for r in rows)
    assert {r.law for r in found} == {"bytes"} and {r.grown_shard for r in found} == {None} and {r.shard for r in found} <= set(range(40))
    shard, groups, loads = {r.doc_id: r.shard for r in found}, Counter(), [0] * 40
    for r in rows:
        groups[r.text] += size(r.text)
        loads[shard[r.doc_id]] += size(r.text)
    assert loads == plain_loads(groups.values(), 40)
    assert all(len({shard[r.doc_id] for r in rows if r.text == t}) == 1 for t in groups)


def test_repeats(spark, rows):
    from test_text_operators import plain_repeats, plain_spans

    want = plain_repeats({r.doc_id: (r.text or "").encode() for r in rows}, 200, "none")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in Q.op9_repeats(spark, SF).collect()}
    assert got == {k: (len(g), int(g.sum()), len(plain_spans(g)), hashlib.sha256(t).hexdigest()) for k, (g, t) in want.items()}


def test_language(spark, rows):
    found = {r.doc_id: r for r in Q.op10_language(spark, SF).collect()}
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 3 == 1) and 0 <= r.score <= 1 for k, r in found.items())
    held = [r for r in rows if found[r.doc_id].held_out and r.lang]
    assert sum(found[r.doc_id].lang_pred == r.lang for r in held) >= 0.98 * len(held) and len(found) == len(rows)
