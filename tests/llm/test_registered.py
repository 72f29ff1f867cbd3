"""The registered queries themselves: contract columns against brute force, libraries and their SQL, on the smallest tables."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from compare import connect, difference
from test_operators import BASE, brute_spans, tokenizer

import corpus_pipeline
from orderlens.llm import pii
from orderlens.llm import queries as q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    return [(r["doc_id"], r["text"], r["source"], r["lang"]) for r in q.table(spark, SF, "documents").collect()]


@pytest.mark.parametrize("name", ["op3_similar_documents", "op4_url_verdicts", "op9_top_vectors"])
def test_queries_with_sql_equal_it(spark, name):
    assert difference(q.QUERIES[name](spark, SF), connect(SF), q.ORACLE[name]) is None


def test_near_vectors_find_what_the_sql_finds(spark):
    want = {r[0]: r[1] for r in connect(SF).execute(f"SELECT vec_id, n_links FROM ({q.ORACLE['op5_near_vectors']})").fetchall()}
    found = {r["vec_id"]: r["n_links"] for r in q.op5_near_vectors(spark, SF).collect()}
    assert found.keys() == want.keys() and all(found[i] <= want[i] for i in want)
    assert sum(found.values()) >= 0.9 * sum(want.values())


def test_shards_have_the_least_possible_capacity(spark, rows):
    out = q.op1_shards(spark, SF).collect()
    texts = dict((i, t) for i, t, *_ in rows)
    assert sorted(r["doc_id"] for r in out) == sorted(texts)
    weight, order, groups = Counter(), defaultdict(list), defaultdict(set)
    for r in out:
        body = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(body) + 16, zlib.crc32(body), "bytes", None)
        weight[r["shard"]] += r["size"]
        order[r["shard"]].append(r["slot"])
        groups[body].add(r["shard"])
    assert max(weight) <= 39 and all(sorted(s) == list(range(len(s))) for s in order.values()) and all(len(g) == 1 for g in groups.values())
    sizes = Counter()
    for body, n in Counter((t or "").encode() for t in texts.values()).items():
        sizes[body] = n * (len(body) + 16)
    # No cut of any order goes below the largest group or the mean; with the groups in some fixed order the excess is one group at most.
    assert max(weight.values()) <= max(max(sizes.values()), sum(sizes.values()) / 40 + max(sizes.values()))


def test_language_contract(spark, rows):
    out = q.op2_language(spark, SF).collect()
    known = {i: lang for i, _, _, lang in rows}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in out)
    held = [r for r in out if r["held_out"] and known[r["doc_id"]] and r["lang_pred"] != "und"]
    assert len(out) == len(rows) and held and sum(r["lang_pred"] == known[r["doc_id"]] for r in held) >= 0.95 * len(held)


def test_mixture_takes_the_first_passes_of_every_source(spark, rows):
    out = q.op6_mixture(spark, SF).collect()
    source = {i: s for i, _, s, _ in rows}
    size, taken, target = Counter(), Counter(), {}
    for r in out:
        assert r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        size[source[r["doc_id"]]] += r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
        target[source[r["doc_id"]]] = (r["target"], r["source_size"])
    longest = {s: max(r["size"] for r in out if source[r["doc_id"]] == s) for s in size}
    assert sum(taken.values()) <= sum(size.values())
    for s, (wanted, whole) in target.items():
        assert whole == size[s] and wanted <= 3 * whole + 1e-6
        passes = {r["taken"] // r["size"] for r in out if source[r["doc_id"]] == s and r["size"]}
        assert max(passes) - min(passes) <= 1  # whole rounds, and the beginning of one more
        assert taken[s] <= wanted + longest[s]


def test_personal_data_digests(spark, rows):
    out = {r["doc_id"]: r for r in q.op7_personal_data(spark, SF).collect()}
    for i, text, *_ in rows:
        base = brute_spans(text)
        written = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert out[i]["base_sha256"] == hashlib.sha256(written.encode()).hexdigest()
        assert [out[i][f"n_{kind}"] for kind in pii.KINDS] == [sum(k == kind for k, *_ in base) for kind in BASE]
        assert set(filter(None, written.split(","))) <= set(out[i]["spans"].split(","))


def test_token_counts_and_packing_digests(spark, rows):
    words, whole = tokenizer("word_bpe_49k.json"), tokenizer("byte_bpe_50k.json")
    counted = {r["doc_id"]: r for r in q.op8_token_counts(spark, SF).collect()}
    pieces = defaultdict(list)
    sequences = defaultdict(list)
    for r in q.op10_packing(spark, SF).collect():
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, text, *_ in rows:
        n = len(words.encode(text or "", add_special_tokens=False).ids)
        assert (counted[i]["n_bytes"], counted[i]["n_tokens"], counted[i]["over_limit"]) == (len((text or "").encode()), n, n > 2048)
        ids, at = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 1], "<u4"), 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids[at:at + r["length"]].tobytes()))
            at += r["length"]
        assert at == len(ids)
    check_sequences(sequences)


def check_sequences(sequences):
    for found in sequences.values():
        end = 0
        for offset, length in sorted(found):
            assert offset == end
            end += length
        assert end <= 2048


def test_the_whole_pipeline(spark, rows):
    """Rows against a plain chain: language by letters, groups by SQL, spans by the operator, ids by the library."""
    out = corpus_pipeline.run(spark, SF).collect()
    letters = {i for i, t, *_ in rows if any(c.isalpha() for c in t or "")}
    groups = dict(connect(SF).execute(f"SELECT doc_id, component_id FROM ({q.ORACLE['op3_similar_documents']})").fetchall())
    kept = {min(i for i in letters if groups[i] == g) for g in {groups[i] for i in letters}}
    docs = q.table(spark, SF, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.Model(spark))
    clean = {r["doc_id"]: r["text"] for r in found.select("doc_id", pii.redact(found["text"], found["spans"]).alias("text")).collect()}
    whole = tokenizer("byte_bpe_50k.json")
    assert {r["doc_id"] for r in out} <= kept
    ids = {i: np.array([*whole.encode(clean[i] or "", add_special_tokens=False).ids, 1], "<u4") for i in {r["doc_id"] for r in out}}
    sequences, times = defaultdict(list), defaultdict(Counter)
    for r in out:
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own) and r["ids_crc32"] == zlib.crc32(own[r["start"]:r["start"] + r["length"]].tobytes())
        times[r["doc_id"]][r["start"]] += 1
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    check_sequences(sequences)
    for i, starts in times.items():  # every pass over a document has all of its pieces
        assert set(starts) == set(range(0, len(ids[i]), 2048)) and len(set(starts.values())) == 1 and max(starts.values()) <= 3
