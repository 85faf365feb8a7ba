"""The registered queries themselves on the smallest tables: their columns, rows and digests."""

import hashlib
import math
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

from locusframe.llm import pii, queries, simhash
from locusframe.llm.bpe import tokenizer_file

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")

COLUMNS = {
    "op1_decontaminate": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op2_lm_score": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op3_nearest": "query_id bigint, rank int, vec_id bigint, score double",
    "op4_secrets": "doc_id bigint, n_candidates bigint, n_secrets bigint, spans string, redacted_sha256 string",
    "op5_main_text": "page_id bigint, url string, text string, n_chars bigint",
    "op6_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op7_repeats": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op8_personal_data": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op9_near_duplicates": "doc_id bigint, fingerprint string, component_id bigint",
    "op10_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
}


@pytest.fixture(scope="module")
def found(spark):
    out = {}
    for name, run in queries.QUERIES.items():
        df = run(spark, DATA)
        assert ", ".join(f"{c} {t}" for c, t in df.dtypes) == COLUMNS[name]
        out[name] = df.toPandas()
    return out


@pytest.fixture(scope="module")
def docs():
    frame = pd.read_parquet(f"{DATA}/documents.parquet").set_index("doc_id")
    return {int(k): t or "" for k, t in frame["text"].items()}


def test_all_are_registered():
    assert sorted(queries.QUERIES) == sorted(COLUMNS) and set(queries.SQL) <= set(COLUMNS)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_every_row_has_a_row(found, docs, name):
    if name != "op3_nearest":
        key = "page_id" if name == "op5_main_text" else "doc_id"
        want = pd.read_parquet(f"{DATA}/pages.parquet")["page_id"] if key == "page_id" else list(docs)
        assert sorted(found[name][key]) == sorted(want)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql_agrees(found, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want = con.execute(queries.SQL[name]).df()
    rows = lambda f: sorted(tuple(r) for r in f[sorted(f.columns)].itertuples(index=False))
    assert rows(found[name]) == rows(want)


def test_op2_base(found, docs):
    lower = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    own = {k: [*t.encode().translate(lower).split(), None] for k, t in docs.items()}
    held = {k: zlib.crc32(str(k).encode()) % 10 == 0 for k in docs}
    train = Counter(w for k, ws in own.items() if not held[k] for w in ws)
    n, v = sum(train.values()), len(train)
    for r in found["op2_lm_score"].itertuples():
        ws = own[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(ws), sum(w in train for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) and r.score < 0


def test_op3_recall_and_scores(found):
    frame = pd.read_parquet(f"{DATA}/embeddings.parquet")
    x, ids = np.array(frame["embedding"].tolist(), np.float64), frame["vec_id"].to_numpy()
    at = {int(k): p for p, k in enumerate(ids)}
    hits = 0
    for q, rows in found["op3_nearest"].sort_values("rank").groupby("query_id"):
        assert q % 20 == 0 and rows["rank"].tolist() == list(range(1, 21))
        scores = x @ x[at[q]]
        assert np.allclose(rows["score"], [scores[at[k]] for k in rows["vec_id"]], rtol=0, atol=1e-12)
        assert list(zip(-rows["score"], rows["vec_id"])) == sorted(zip(-rows["score"], rows["vec_id"]))
        best = sorted((k for k in at if k != q), key=lambda k: (-scores[at[k]], k))[:20]
        hits += len({*rows["vec_id"]} & {*best})
    assert hits / len(found["op3_nearest"]) >= 0.9 and found["op3_nearest"]["query_id"].nunique() == sum(k % 20 == 0 for k in at)


def test_op5_lengths(found):
    f = found["op5_main_text"]
    assert all(len(r.text) == r.n_chars for r in f.itertuples()) and (f["n_chars"] > 0).all()
    assert not any("<" in r.text and "</" in r.text for r in f.itertuples())


def test_op6_digests(found, docs):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokenizer_file())
    for r in found["op6_bpe"].itertuples():
        ids = own.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(own.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_op8_digests(found, docs):
    automaton = pii.anchors()
    for r in found["op8_personal_data"].itertuples():
        spans = pii.spans(docs[r.doc_id], automaton)
        line = lambda kinds: ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in spans[k])  # noqa: B023, E731
        assert r.base_sha256 == hashlib.sha256(line(pii.BASE_KINDS).encode()).hexdigest() and r.spans == line((*pii.BASE_KINDS, *pii.MORE_KINDS))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(spans[k]) for k in pii.BASE_KINDS]


def test_op9_fingerprints_and_groups(found, docs):
    f = found["op9_near_duplicates"]
    prints = {r.doc_id: int(r.fingerprint, 16) for r in f.itertuples()}
    assert all(len(x) == 16 for x in f["fingerprint"]) and prints == {k: simhash.fingerprint(t.encode()) for k, t in docs.items()}
    ids = sorted(prints)
    group = {k: k for k in ids}
    for i in ids:
        for j in ids:
            if j < i and group[i] != group[j] and (prints[i] ^ prints[j]).bit_count() <= 3:
                lo, hi = sorted((group[i], group[j]))
                group = {k: lo if g == hi else g for k, g in group.items()}
    assert dict(zip(f["doc_id"], f["component_id"])) == group


def test_op10_columns(found):
    f = found["op10_toxicity"]
    assert ((f["score"] >= 0) & (f["score"] <= 1)).all() and (f["predicted"] == (f["score"] >= 0.7)).all()
    assert f["held_out"].tolist() == [zlib.crc32(str(k).encode()) % 3 == 1 for k in f["doc_id"]]
