"""Cases in which the operators once did less than the whole job."""

import numpy as np

import corpus_pipeline
from pyspark.sql import functions as F

from orderlens.llm import caps, language, packing, topk


def test_near_vectors_of_every_group_are_found(spark):
    draw = np.random.default_rng(11)
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    centres = unit(draw.standard_normal((61, 64)))
    group = np.r_[np.repeat(np.arange(60), 10), np.full(300, 60)]  # the last group holds a third of all rows
    side = draw.standard_normal((len(group), 64))
    side = unit(side - (side * centres[group]).sum(1, keepdims=True) * centres[group])
    vectors = 0.955 ** 0.5 * centres[group] + 0.045 ** 0.5 * side
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    out = {r["vec_id"]: r for r in caps.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()}
    near = unit(vectors) @ unit(vectors).T >= 0.95
    truth, counted = near.sum(1) - 1, np.array([out[i]["n_links"] for i in range(len(rows))])
    assert (counted <= truth).all()
    recall = [counted[group == g].sum() / max(1, truth[group == g].sum()) for g in range(61) if truth[group == g].sum() >= 10]
    assert len(recall) > 50 and min(recall) >= 0.9, sorted(recall)[:5]


def test_one_row_of_similar_stays_whatever_the_ids(spark):
    words = lambda name, *more: " ".join([*(f"{name}{i}" for i in range(60)), *more])
    rows = [(1, words("a")), (2, words("a", "x")), (2, words("b")), (None, words("a", "y")), (3, words("c")), (3, words("c", "z")),
            (None, words("d")), (None, words("d", "z")), (4, words("d", "y")), (None, words("e")), (None, words("e", "x")), (5, ""), (5, ""), (6, ""), (7, None)]
    kept = corpus_pipeline.keep_one_of_similar(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), None).collect()
    groups = sorted((str(r["doc_id"]), (r["text"] or "-")[0]) for r in kept if r["text"])
    assert groups == [("1", "a"), ("2", "b"), ("3", "c"), ("4", "d"), ("None", "e")]
    assert sorted(str(r["doc_id"]) for r in kept if not r["text"]) == ["5", "6", "7"]


KIND = "doc_id bigint, text string, lang string"


def test_no_clean_text_is_lost_without_labels(spark):
    for label in (None, "aa"):
        bare = [(1, "some words", None), (2, "1234", None), (3, None, None), (4, "12", label), (None, "more words", None)]
        kept = corpus_pipeline.keep_known_languages(spark, spark.createDataFrame(bare, KIND), None).collect()
        assert sorted((str(r["doc_id"]), r["lang"]) for r in kept) == [("1", None), ("None", None)]


def test_a_language_with_long_texts_only_is_learnt(spark):
    long = [(10 + i, "der hund und die katze schlafen im haus " * 600, "de") for i in range(3)]
    short = [(20 + i, f"the dog and the cat are sleeping in house {i}", "en") for i in range(3)]
    asked = spark.createDataFrame([(1, "die katze und der hund", None), (2, "the cat and the dog", None)], KIND)
    for rows, want in ((long + short, ["de", "en"]), (long, ["de", "de"])):
        model = language.fit(spark.createDataFrame(rows, KIND))
        assert [r["lang_pred"] for r in language.identify(asked, model).orderBy("doc_id").collect()] == want


def test_top_k_counts_repeated_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.0]), (1, [0.5, 0.0]), (2, [0.4, 0.0]), (2, [0.40001, 0.0]), (3, [0.1, 0.0]), (100, [0.0, 1.0]), (100, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    out = topk.search(df, df.filter("vec_id % 100 = 0"), 5).collect()
    whole = [(i, np.floor(1024 * np.array(v)).astype(int)) for i, v in rows]
    want = []
    for query in (0, 100):
        best = sorted((-int(q @ d), i) for n, q in whole if n == query for i, d in whole if i != query)[:5]
        want += [(query, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in out) == sorted(want)


CLASHING = ["_key", "_times", "_pass", "_scored", "_candidates", "base", "spans", "_row", "_at", "_part", "_length", "_base", "_spans", "c0", "size", "taken"]


def test_columns_of_any_name_pass_through_every_stage(spark):
    rows = [(i, f"call +49 (30) 1234567{i} or the dog and the cat number {i} are sleeping in the house", "en", f"s{i % 2}", 60, *[f"{c}{i}" for c in CLASHING])
            for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` string" for c in CLASHING))
    for name, function in corpus_pipeline.STAGES[:-1]:
        out = function(spark, docs, None)
        assert out.columns == docs.columns, name
        seen = out.collect()
        assert seen and all(r[c] == f"{c}{r['doc_id']}" for r in seen for c in CLASHING), name
    pieces = docs.select(F.lit(5).alias("length"), "doc_id", F.lit(0).alias("start"), *CLASHING)
    packed = packing.pack(pieces).collect()
    assert len(packed) == 8 and all(r[c] == f"{c}{r['doc_id']}" for r in packed for c in CLASHING)
