"""The registered queries themselves, over whole tables: against their SQL in DuckDB, or against plain Python."""

import collections
import hashlib
import os

import duckdb
import pytest

from slickwake.llm import registry
from tests.llm.test_dedup import brute_components, brute_fingerprint, plain_boundaries
from tests.llm.test_others import plain_spans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.fixture(scope="module")
def texts(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_and_its_sql(spark, con, name):
    got = registry.queries()[name](spark, SF)
    want = con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    plain = lambda rows: sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=str)
    assert plain(got.select(names).collect()) == plain(want.fetchall())


def test_op2_columns(spark, texts):
    got = registry.queries()["op2_bootstrapped_pii"](spark, SF).collect()
    base = collections.Counter((i, hashlib.sha256(plain_spans(t).encode()).hexdigest()) for i, t in texts)
    assert collections.Counter((r["doc_id"], r["base_sha256"]) for r in got) == base
    own = dict(texts)
    for r in got:
        spans = [s.split(":") for s in r["spans"].split(",") if s]
        assert {k: r[f"n_{k}"] for k in ("email", "ip", "card", "phone")} == {k: sum(s[0] == k for s in spans) for k in ("email", "ip", "card", "phone")}
        assert set(plain_spans(own[r["doc_id"]]).split(",")) - {""} <= set(r["spans"].split(","))


def test_op7_rows(spark, texts):
    fps = [brute_fingerprint(t) for _, t in texts]
    comp = brute_components(set(fps), lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for (i, _), f in zip(texts, fps, strict=True):
        least[comp[f]] = min(i, least.get(comp[f], i))
    got = registry.queries()["op7_simhash_near_duplicates"](spark, SF).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted((i, f"{f:016x}", least[comp[f]]) for (i, _), f in zip(texts, fps, strict=True))


def test_op8_rows(spark, texts):
    """What goes is made of whole chunks that occur before, in passages; nothing goes where nothing is repeated."""
    chunks = {}
    for i, t in texts:
        ends = plain_boundaries((t or "").encode())
        chunks[i] = list(zip([0, *ends], ends))
    body = {i: (t or "").encode() for i, t in texts}
    first = {}
    for i in sorted(body):
        for a, b in chunks[i]:
            first.setdefault(body[i][a:b], (i, a))
    for r in registry.queries()["op8_content_defined_chunk_dedup"](spark, SF).collect():
        spans = lambda c: [tuple(map(int, s.split(":"))) for s in r[c].split(",") if s]  # noqa: B023, E731
        gone, passages = spans("removed"), spans("passages")
        assert r["n_bytes"] == len(body[r["doc_id"]]) and r["n_chunks"] == len(chunks[r["doc_id"]]) and r["n_spans"] == len(gone)
        assert r["n_removed"] == sum(b - a for a, b in gone) and r["n_repeated"] == sum(b - a for a, b in passages)
        for a, b in chunks[r["doc_id"]]:
            owns = first[body[r["doc_id"]][a:b]] == (r["doc_id"], a)
            inside = any(x <= a and b <= y for x, y in passages)
            assert any(x <= a and b <= y for x, y in gone) == (inside and not owns)


def test_op9_rows(spark, texts):
    got = registry.queries()["op9_kneser_ney_quality"](spark, SF).collect()
    assert sorted((r["doc_id"], r["n_tokens"]) for r in got) == sorted((i, len((t or "").encode())) for i, t in texts)
    assert all(r["perplexity"] is None if r["n_tokens"] == 0 else r["perplexity"] > 1 for r in got) and sum(r["kept"] for r in got) > 0.8 * len(got)
