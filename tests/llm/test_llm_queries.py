"""Registered queries and the pipeline against brute force over whole small tables."""

import hashlib
import html
import math
import os
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from dyadspark.llm import queries
from tests.llm.test_bpe import PATH
from tests.llm.test_mixing import plain_targets
from tests.llm.test_simhash import plain_components, plain_fingerprint
from tests.llm.test_spelling import plain as plain_variants
from tests.llm.test_substring_dedup import plain as plain_windows
from tests.llm.test_suffix_dedup import plain as plain_removal

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def read(name, columns="*"):
    return duckdb.sql(f"SELECT {columns} FROM '{DATA}/{name}.parquet'").fetchall()


@pytest.fixture(scope="module")
def docs():
    return {i: (t, source) for i, t, source in read("documents", "doc_id, text, source")}


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def rows(spark, name):
    return queries.QUERIES[name](spark, DATA).collect()


def test_op1(spark, docs):
    want = plain_removal([(i, t) for i, (t, _) in docs.items()], 100)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows(spark, "op1_suffix_dedup")} == want


def test_op2(spark, docs):
    lang = dict(read("documents", "doc_id, lang"))
    got = rows(spark, "op2_language")
    assert len(got) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in got if r.held_out]) > 0.9


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql_twins(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    cur = con.execute(queries.ORACLE_SQL[name])
    cols = [d[0] for d in cur.description]
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    want = sorted(tuple(plain(r[cols.index(c)]) for c in sorted(cols)) for r in cur.fetchall())
    assert sorted(tuple(plain(r[c]) for c in sorted(cols)) for r in rows(spark, name)) == want


def test_op5(spark, docs):
    fps = {i: plain_fingerprint(t) for i, (t, _) in docs.items()}
    want = plain_components(fps)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows(spark, "op5_simhash")} == {i: (f"{fps[i]:016x}", want[i]) for i in fps}


def test_op6(spark, docs, library):
    sha = lambda x: hashlib.sha256(x).hexdigest()
    want = {}
    for i, (t, _) in docs.items():
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[i] = (len(ids), sha(",".join(map(str, ids)).encode()), sha(library.decode(ids, skip_special_tokens=False).encode()))
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows(spark, "op6_bpe")} == want


def test_op7(spark, docs):
    toxic = dict(read("labels", "doc_id, toxic"))
    got = rows(spark, "op7_toxicity")
    assert len(got) == len(docs) and all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in got)
    known = [r for r in got if r.doc_id in toxic]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert np.mean([r.predicted == toxic[r.doc_id] for r in known]) > 0.8


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test data")
def test_op7_finds_toxic_texts_it_never_saw(spark):
    """Recall and precision of label 1 among held-out rows: a constant score has neither."""
    large = "/root/testdata/sf0.1"
    toxic = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{large}/labels.parquet' WHERE toxic IS NOT NULL").fetchall())
    out = [r for r in queries.QUERIES["op7_toxicity"](spark, large).collect() if r.held_out and r.doc_id in toxic]
    found, true = {r.doc_id for r in out if r.predicted}, {r.doc_id for r in out if toxic[r.doc_id]}
    assert len(true) > 50 and len(found & true) / len(true) > 0.75 and len(found & true) / len(found) > 0.75


def test_op11(spark, docs):
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in rows(spark, "op11_substring_dedup")]
    assert sorted(got, key=str) == plain_windows([(i, t) for i, (t, _) in docs.items()])


def test_op13(spark, docs):
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows(spark, "op13_spelling")}
    assert got == plain_variants([(i, t) for i, (t, _) in docs.items()])


def test_op8(spark):
    """These pages hold one article element each."""
    got = {r.page_id: r for r in rows(spark, "op8_main_text")}
    pages = read("pages", "page_id, url, html")
    assert len(got) == len(pages)
    for i, url, page in pages:
        inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", x))).strip() for x in re.split(r"</?(?:p|h1|br)>", inner)]
        want = "\n".join(x for x in parts if x)
        assert (got[i].url, got[i].text, got[i].n_chars) == (url, want, len(want))


def test_op10(spark, docs):
    good = dict(read("labels", "doc_id, quality"))
    got = {r.doc_id: r for r in rows(spark, "op10_quality")}
    assert len(got) == len(docs)
    assert np.mean([got[i].kept for i, q in good.items() if q == 1]) > 0.95
    assert np.mean([not got[i].kept for i, q in good.items() if q == 0]) > 0.5


def plain_mix(docs):
    """{doc_id: copies} of {doc_id: (text, source)}."""
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, (t, _) in docs.items()}
    total = Counter()
    for i, (_, s) in docs.items():
        total[s] += size[i]
    out = {}
    for s, goal in plain_targets(dict(total)).items():
        epochs = min(3, int(goal // total[s])) if total[s] else 0
        rest = goal - epochs * total[s]
        keys = []
        for i, (t, own) in docs.items():
            if own == s:
                u = (int(hashlib.md5(f"mix:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                w = 1.0 if 3 * size[i] <= len(t) <= 9 * size[i] else 0.5
                keys.append((math.floor((1 - u ** (1 / w)) * 4096), -math.log(u) / w, i))
        ahead = 0
        for _, _, i in sorted(keys):
            out[i] = min(3, epochs + (2 * ahead + size[i] <= 2 * rest))
            ahead += size[i]
    return out


def plain_near_copies(texts, size=5, similarity=0.8):
    """{doc_id: smallest id reachable by links} from the Jaccard similarity of all pairs."""
    sets = {}
    for i, t in texts.items():
        words = t.encode().lower().split()
        sets[i] = {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()
    low = {i: i for i in texts}
    ids = sorted(texts)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            a, b = sets[i], sets[j]
            if a == b or (min(len(a), len(b)) >= similarity * max(len(a), len(b)) and len(a & b) >= similarity * len(a | b)):
                x, y = sorted((low[i], low[j]))
                if x != y:
                    low = {k: x if v == y else v for k, v in low.items()}
    return low


def test_pipeline_against_brute_force(spark, docs, library):
    """What the classifier keeps, then plain versions of all other stages."""
    first = corpus_pipeline.drop_toxic(spark, spark.read.parquet(f"{DATA}/documents.parquet"), DATA)
    assert first.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    kept = {r.doc_id: (r.text, r.source) for r in first.collect()}
    toxic = dict(read("labels", "doc_id, toxic"))
    assert np.mean([i in kept for i, y in toxic.items() if y == 0]) > 0.8
    group = plain_near_copies({i: t for i, (t, _) in kept.items()})
    kept = {i: kept[i] for i in kept if group[i] == i}
    seen, cut = set(), {}
    for i in sorted(kept):
        raw = kept[i][0].encode()
        gone = bytearray(len(raw))
        for a in range(len(raw) - 99):
            if raw[a : a + 100] in seen:
                gone[a : a + 100] = b"\1" * 100
            seen.add(raw[a : a + 100])
        cut[i] = (bytes(b for b, g in zip(raw, gone, strict=True) if not g).decode("utf-8", "ignore"), kept[i][1])
    copies = plain_mix(cut)
    want = Counter()
    for i, n in copies.items():
        want[i, tuple(library.encode(cut[i][0], add_special_tokens=False).ids)] += int(n)
    got = Counter((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, DATA).collect())
    assert got == +want


def test_stages_take_unusual_rows(spark):
    """Nulls in every column, repeated rows and ids, an empty and a long text, columns with names used inside."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    first = docs.orderBy("doc_id").limit(60)
    long = " ".join(f"w{i}" for i in range(60_000))
    odd = [(None, None, None, None, None), (None, "a b", None, None, 3), (10**6, "", "en", None, 0), (10**6 + 1, None, None, "s", None), (10**6 + 2, long, "en", "s", len(long)), (10**6 + 3, "one text", "en", "s", 8), (10**6 + 3, "another text", "en", "s", 12), (10**6 + 3, "another text", "en", "s", 12)]
    frame = first.unionByName(spark.createDataFrame(odd, docs.schema))
    extra = ["toxicity", "toxic", "_size", "_key", "_b", "_copies", "_copy", "_row", "_u", "_w", "_a", "key", "fp", "n", "h", "component_id", "size", "target"]
    frame = frame.selectExpr("*", *[f"'{c}' AS `{c}`" for c in extra])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, DATA)
        rows = out.collect()
        assert out.columns == frame.columns and rows, name
        assert all(r[c] == c for r in rows for c in extra), name
        ids = Counter(r.doc_id for r in rows)
        if name == "mixing":  # takes what its budgets allow
            assert ids[10**6] <= 3
            break
        assert sum(r.text == long for r in rows) == 1 and ids[10**6 + 3] == 3, name
        frame = spark.createDataFrame(rows, frame.schema)
    ids = {r.doc_id: r.n_tokens for r in corpus_pipeline.STAGES[-1][1](spark, frame, DATA).collect()}
    assert ids[10**6 + 2] > 60_000


def test_stages_keep_the_columns(spark):
    frame = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, frame, DATA).columns == frame.columns
        assert stage(spark, frame, DATA).count() == 0
