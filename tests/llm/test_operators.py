"""Operators against brute force on small tables with nulls, empty and long texts, ties, copies and odd columns."""

import os
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from orderlens.llm import caps, components, jaccard, language, mixing, packing, pii, sharding, tokens, topk, urls
from orderlens.llm import queries as q

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, shard string, _row int"


def odd_rows():
    draw = random.Random(3)
    word = lambda: "".join(draw.choice(["an", "er", "on", "th"]) for _ in range(draw.randint(1, 3)))
    texts = [" ".join(word() for _ in range(draw.choice([1, 3, 5, 30, 60]))) for _ in range(40)]
    texts += [texts[3] + " more", texts[3].upper(), "  two  blanks \n\n x ", "", "1234 !!", "<|endoftext|>a b", "é ß 日本 \U0001f600"]
    texts += [texts[9]] * 12 + [None, None, " ".join(word() for _ in range(20_000))]
    rows = [(i, t, draw.choice(["aa", "bb", None]), draw.choice(["s1", "s2", "s3", None]), 1, "x", 0) for i, t in enumerate(texts)]
    return rows + [rows[5], rows[5], (None, "no id", None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_rows(), DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_shards_keep_copies_and_are_gapless(docs, none):
    rows = sharding.shard(docs, 5).collect()
    assert len(rows) == docs.count()
    by_shard = {}
    for r in rows:
        by_shard.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    of = {}
    for r in rows:
        of.setdefault(r["text_crc32"], set()).add(r["shard"])
    assert all(len(s) == 1 for s in of.values())
    assert sharding.shard(none, 5).count() == 0
    assert {r["shard"] for r in sharding.shard(docs.limit(1), 5).collect()} == {0}


def test_smallest_capacity_is_exact():
    draw = random.Random(5)
    for _ in range(30):
        sizes = [draw.choice([16, 17, 40, 3000]) for _ in range(draw.randint(1, 400))]
        ends = np.cumsum(sizes).tolist()

        def fetch(shift, inside):
            cells = {}
            for e in ends:
                if inside is None or (e - 1) >> inside[0] in inside[1]:
                    cells.setdefault((e - 1) >> shift, []).append(e)
            return [(c, max(v), len(v)) for c, v in cells.items()]

        def enough(k, capacity):
            used, filled = 1, 0
            for s in sizes:
                if s > capacity:
                    return False
                if filled + s > capacity:
                    used, filled = used + 1, 0
                filled += s
            return used <= k

        k = draw.randint(1, 9)
        known = sharding.Ends(fetch, 0, ends[-1])
        known.shift = 0
        known.cells = known._cells(9, None)
        known._index()
        while True:
            cuts = known.cuts(k)
            if not known.refine():
                break
        best = next(c for c in range(1, ends[-1] + 1) if enough(k, c))
        assert max(b - a for a, b in zip([0, *cuts], cuts)) == best


def test_language_holds_out_and_rejects(spark, docs, none):
    table = q.table(spark, SF, "documents")
    model = language.fit(table.filter(~language.held_out(F.col("doc_id"))))
    held = language.identify(table, model, keep=("lang",)).filter(language.held_out(F.col("doc_id"))).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)
    for r in language.identify(docs, model).collect():
        assert 0 <= r["score"] <= 1
    rows = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs, model).collect()}
    for i, t in texts(docs):
        assert (rows[i] == "und") == (not any(c.isalpha() for c in t or "")), t
    assert language.fit(none) is None and language.identify(none, None).count() == 0


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def reach(ids, linked):
    lowest = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(lowest[a], lowest[b])
            if (lowest[a], lowest[b]) != (low, low):
                lowest[a] = lowest[b] = low
                changed = True
    return lowest


def near_copies():
    draw = random.Random(8)
    made = []
    for _ in range(4):
        base = [f"w{draw.randint(0, 400)}" for _ in range(draw.randint(30, 80))]
        for _ in range(25):
            copy = list(base)
            for _ in range(draw.randint(0, 2)):
                copy[draw.randrange(len(copy))] = f"x{draw.randint(0, 30)}"
            made.append(" ".join(copy[:len(copy) - draw.randint(0, 6)]))
    return made


def test_similar_is_exact(spark, docs, none):
    rows = [(r[0], r[1]) for r in odd_rows() if r[0] is not None] + [(1000 + i, t) for i, t in enumerate(near_copies())]
    found = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.similar(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    linked = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    lowest = reach(ids, linked)
    assert found == {(i, len(sets[i]), lowest[i]) for i in ids}
    assert len(set(lowest.values())) < len(ids) - 40
    assert jaccard.similar(docs).count() == docs.count() and jaccard.similar(none).count() == 0


def test_url_rules(spark):
    rows = [(1, "https://a.example.org/en/12?x"), (2, "http://Example.ORG/es/"), (3, "http://x.com/de/1"), (4, "http://xcom/de/1"), (5, None),
            (6, "no scheme org/"), (7, "http://casino.net/"), (8, "http://casinos.net"), (9, "http://org"), (1, "https://a.example.org/en/12?x")]
    rules = [urls.path_rule(*r) for r in q.PATH_RULES] + [urls.word_rule("casino", "block")]
    out = sorted((r["page_id"], r["rule"], r["verdict"]) for r in urls.judge(spark.createDataFrame(rows, "page_id int, url string"), rules).collect())
    assert out == [(1, "example.org/en/1", "block")] * 2 + [
        (2, "example.org/es/", "block"), (3, "com/de/", "block"), (4, None, "allow"), (5, None, "allow"), (6, None, "allow"), (7, "casino", "block"),
        (8, None, "allow"), (9, None, "allow")]
    assert urls.judge(spark.createDataFrame(rows[:0], "page_id int, url string"), rules).count() == 0
    assert urls.judge(spark.createDataFrame(rows, "page_id int, url string"), []).filter("verdict = 'allow'").count() == 10


def test_near_vectors_recall_and_precision(spark):
    draw = np.random.default_rng(4)
    base = draw.standard_normal((150, 24))
    side = draw.standard_normal((150, 24))
    side -= (side * base).sum(1, keepdims=True) / (base * base).sum(1, keepdims=True) * base
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    pairs = 0.955 * unit(base) + (1 - 0.955 ** 2) ** 0.5 * unit(side)
    rows = [(i, v.tolist()) for i, v in enumerate(np.vstack([unit(base), pairs, unit(base)[:30]]))]
    rows += [(900, None), (901, [0.0] * 24), (902, [float("nan")] + [1.0] * 23), (903, [None] + [1.0] * 23), (904, []), (905, [1.0, 2.0])]
    out = {r["vec_id"]: r for r in caps.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()}
    assert len(out) == len(rows)
    assert all(out[i]["n_links"] == 0 and out[i]["kept"] and out[i]["component_id"] == i for i in range(900, 906))
    good = unit(np.array([v for _, v in rows[:330]]))
    truth = (good @ good.T >= 0.95).sum(1) - 1
    counted = np.array([out[i]["n_links"] for i in range(330)])
    assert (counted <= truth).all() and counted.sum() >= 0.9 * truth.sum()
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<double>")
    assert caps.near_duplicates(empty).count() == 0


def test_a_bucket_above_the_tile_is_counted_whole(spark, monkeypatch):
    draw = np.random.default_rng(2)
    rows = [(i, (np.ones(16) + 0.01 * draw.standard_normal(16)).tolist()) for i in range(70)]
    monkeypatch.setattr(caps, "TILE", 16)
    out = caps.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert all(r["n_links"] == 69 and r["component_id"] == 0 for r in out)


def test_mixture_meets_targets(docs, none):
    assert [float(t) for t in mixing.targets([10, 100, 100], [1, 2, 3], 210, 3)] == [30.0, 72.0, 108.0]
    out = mixing.mix(docs).collect()
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix(docs).collect()))
    assert len(out) == docs.count() and all(r["taken"] <= 3 * r["size"] for r in out)
    assert sum(r["taken"] for r in out) <= sum(r["size"] for r in out)
    assert sorted(r["size"] for r in out) == sorted(len((t or "").encode().split()) for _, t in texts(docs))
    assert mixing.mix(none).count() == 0


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    found = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0
            if {"email": True, "ip": all(int(p or 256) <= 255 for p in m.group().split(".")) if kind == "ip" else False,
                    "card": 13 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15}[kind]:
                found.append((kind, m.start(), m.end()))
    return found


def test_personal_data_base_is_exact(spark):
    draw = random.Random(6)
    parts = ["a", "b.c", "@", "@x.org", "_y@z.de", "1.2.3.4", "300.1.1.1", ".5", "4041894974608795", "4041 8949 7460 8795", "-", " ", "+1 (988) 555-2485",
             "+49", "0", "日", "\U0001f600", "\n", "00000000000255", "(", "mail (at) web.org"]
    rows = [(i, "".join(draw.choice(parts) for _ in range(draw.randint(0, 14)))) for i in range(1500)] + [(9000, None), (9001, "1 " * 4000 + "a" * 20_000 + ".a" * 9000)]
    found = pii.find(spark.createDataFrame(rows, "id int, text string"), pii.Model(spark)).select(
        "id", "text", "base", "spans", pii.redact(F.col("text"), F.col("spans")).alias("clean")).collect()
    assert len(found) == len(rows)
    for r in found:
        base = [(pii.KINDS[s["kind"]], s["start"], s["end"]) for s in r["base"]]
        assert base == brute_spans(r["text"]), r["text"]
        assert {(s["kind"], s["start"], s["end"]) for s in r["base"]} <= {(s["kind"], s["start"], s["end"]) for s in r["spans"]}
        if not r["spans"]:
            assert r["clean"] == r["text"]


def test_trees_add_what_rules_miss_and_leave_clean_text(spark):
    wanted = {"please call phone (212) 555-0187 today": ["phone:18:32"], "contact anon.tier (at) marone.com now": ["email:8:33"],
              "030 12345678": ["phone:0:12"], "ruf 0171 1234567 an": ["phone:4:16"], "0049 30 123456": ["phone:0:14"],
              "call 5551234567 now": ["phone:5:15"], "karte 3782.822463.10005 ok": ["card:6:23"], "anon.tier (at) marone.com": ["email:0:25"]}
    clean = ["version 10.2.3 of chapter 4 on 2024-01-05", "order 1234567890 shipped", "between 1990-2005 we", "the total 1.234.567 of",
             "isbn 978-3-16-148410-0", "2024-01-15 12:30:11", "the numbers 1 2 3 4 5 6 7 8 9 10 11 12 13"]
    rows = [(t,) for t in [*wanted, *clean]]
    out = {r["text"]: r["s"] for r in pii.find(spark.createDataFrame(rows, "text string"), pii.Model(spark)).select("text", pii.written(F.col("spans")).alias("s")).collect()}
    assert {t: s.split(",") for t, s in out.items() if s} == wanted


def test_many_spans_in_one_text(spark):
    """More spans than a chunk holds keep their positions, base spans win over candidates, and the rest is found."""
    import re

    text = " , ".join(f"a{i}@b.com tel 030 1{i:07d}" for i in range(700))
    row = pii.find(spark.createDataFrame([(text,)], "text string"), pii.Model(spark)).first()
    mails = [(0, m.start(), m.end()) for m in re.finditer(r"a\d+@b\.com", text)]
    phones = [(3, m.start(), m.end()) for m in re.finditer(r"030 \d{8}", text)]
    assert [tuple(s) for s in row["base"]] == mails and [tuple(s) for s in row["spans"]] == mails + phones


def tokenizer(name):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import tokenizers

    return tokenizers.Tokenizer.from_file(public_tokenizers.path(name))


def test_token_counts_and_cache(docs, none, tmp_path):
    text, cache = q.tokenizer_text("word_bpe_49k.json"), str(tmp_path / "cache")
    model = tokenizer("word_bpe_49k.json")
    for _ in range(2):
        out = sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in tokens.count_tokens(docs, text, cache).collect())
        assert out == sorted((str(i), len((t or "").encode()), len(model.encode(t or "", add_special_tokens=False).ids)) for i, t in texts(docs))
        stored = docs.sparkSession.read.parquet(cache)
        assert stored.count() == stored.select("content").distinct().count()
    assert tokens.count_tokens(none, text, str(tmp_path / "other")).count() == 0


def test_top_k_is_exact(spark):
    draw = np.random.default_rng(9)
    rows = [(i, np.round(draw.standard_normal(8), 1).tolist()) for i in range(700)] + [(i, [0.5] * 8) for i in range(700, 730)]
    rows += [(800, None), (900, [float("inf")] + [0.0] * 7), (1000, [None] * 8), (1100, [1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    out = topk.search(df, df.filter("vec_id % 100 = 0"), 10, block=16).collect()
    good = {i: np.floor(1024 * np.array(v)).astype(np.int64) for i, v in rows if v and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for query in sorted(i for i in good if i % 100 == 0):
        best = sorted((-int(good[query] @ v), i) for i, v in good.items() if i != query)[:10]
        want += [(query, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in out) == sorted(want)
    assert topk.search(df.limit(0), df.limit(0)).count() == 0


def test_top_k_in_cells_broadcasts_nothing_and_numbers_no_run(spark, monkeypatch):
    """The queries were repeated for every run, one literal each, and broadcast with their repeats."""
    draw = np.random.default_rng(4)
    rows = [(i, draw.integers(-3, 4, 4 if i % 3 else 6).astype(float).tolist()) for i in range(600)] + [(7, [1e9] * 4), (9, [-3e6] * 6), (8, [2.0 ** 38] * 4)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(5).cache()
    for name, value in {"_HELD": 7 * 16 * 5, "_CHUNK": 16, "GROUP": 100, "QUERIES": 4, "STEP": 1, "RUN": 3}.items():
        monkeypatch.setattr(topk, name, value)
    found = topk.search(df, df.filter("vec_id % 20 = 0"), 5, block=8)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    want = []
    whole = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows]
    for query, q in (r for r in whole if r[0] % 20 == 0):
        best = sorted((-sum(a * b for a, b in zip(q, v)), i) for i, v in whole if i != query and len(v) == len(q))[:5]
        want += [(query, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found.collect()) == sorted(want)


def test_packing_is_an_exact_round_trip(docs, none):
    text, model = q.tokenizer_text("byte_bpe_50k.json"), tokenizer("byte_bpe_50k.json")
    pieces = packing.pack(packing.cut(docs, text, window=64), window=64).collect()
    want = sorted((str(i), *model.encode(t or "", add_special_tokens=False).ids, 1) for i, t in texts(docs))
    by_doc, sequences = {}, {}
    for p in pieces:
        by_doc.setdefault(str(p["doc_id"]), []).append((p["start"], np.frombuffer(p["ids"], "<u4").tolist()))
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for s in sequences.values():
        end = 0
        for offset, length in sorted(s):
            assert offset == end
            end += length
        assert end <= 64
    copies = {}
    for row in want:
        copies.setdefault(row[0], []).append(list(row[1:]))
    for doc, found in by_doc.items():
        ids = [x for _, part in sorted(found) for x in part]
        assert len(ids) == sum(map(len, copies[doc])) and sorted(ids) == sorted(x for c in copies[doc] for x in c)
    assert packing.pack(packing.cut(none, text)).count() == 0


def test_plan_is_best_fit_decreasing():
    draw = random.Random(1)
    lengths = [draw.randint(1, 64) for _ in range(500)]
    counts = {n: lengths.count(n) for n in set(lengths)}
    windows = []
    for n in sorted(lengths, reverse=True):
        fits = [(64 - sum(w) - n, i) for i, w in enumerate(windows) if sum(w) + n <= 64]
        windows[min(fits)[1]].append(n) if fits else windows.append([n])
    placed = packing.plan(counts, 64)
    assert sum(k for _, _, k, _, _ in placed) == 500 and max(s + k for _, _, k, s, _ in placed) == len(windows)


def test_components(spark):
    draw = random.Random(2)
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(5, 5)] + [(draw.randint(200, 260), draw.randint(200, 260)) for _ in range(40)]
    out = {r["node"]: r["component"] for r in components.connected(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    lowest = reach({x for l in links for x in l}, links)
    assert out == {n: lowest[n] for n in out} and len(out) >= 100


def test_pipeline_stages_keep_columns(spark, docs, tmp_path):
    step = docs
    for n, (name, function) in enumerate(corpus_pipeline.STAGES):
        function(spark, step, SF).write.parquet(str(tmp_path / name))
        before, step = step, spark.read.parquet(str(tmp_path / name))
        if n < 4:
            assert step.columns == docs.columns
        if name == "language":
            assert step.count() == docs.filter("text rlike '\\\\p{L}'").count()
        if name == "near_duplicates":
            assert step.filter("doc_id is not null").count() == jaccard.similar(before).filter("doc_id is not null").select("component_id").distinct().count()
    assert step.count() > 0
