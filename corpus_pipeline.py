"""A training corpus from ``documents``: language, near-duplicates, personal data, mixture, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last return
the columns of their input. Nulls, repeated rows and extra columns pass through as the operators define it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from orderlens.llm import jaccard, language, mixing, packing, pii
from orderlens.llm.columns import by_position, restored
from orderlens.llm.queries import table, tokenizer_text
from orderlens.operators.staging import stage

ORACLE_SQL = None  # the trees, the kernel machine and the tokenizer have no SQL form


def keep_known_languages(spark, docs, sf_dir):
    """Documents whose text has letters get a language; the others are rejected. A missing ``lang`` is filled in.

    If no text with letters is labelled, nothing can be learnt: ``lang`` stays null, and the same documents stay.
    """
    model = language.fit(docs.select("doc_id", "text", "lang"))
    if model is None:
        return docs.filter(F.col("text").rlike(language.LETTER))
    inner, at = by_position(docs)
    rest = tuple(c for c in inner.columns if c != at["doc_id"])
    found = language.identify(inner, model, id=at["doc_id"], text=at["text"], keep=rest).filter("lang_pred <> 'und'")
    source = at | {"doc_id": "doc_id"}
    return found.select(*[
        (F.coalesce(source[c], "lang_pred") if c == "lang" else F.col(source[c])).alias(c) for c in docs.columns])


def keep_one_of_similar(spark, docs, sf_dir):
    """Of every group of linked rows the one with the smallest id stays, and of equal rows one.

    Rows are told apart by a key of their own, so repeated and null ids decide nothing but the order: a null id comes
    last, and of equal ids any one row. Texts without words link with nothing; of those, rows of equal id and text are equal.
    """
    inner, at = by_position(docs)
    doc_id, text = at["doc_id"], at["text"]
    keyed = stage(inner.withColumn("_key", F.monotonically_increasing_id()), "similar-documents")
    found = jaccard.similar(keyed, id="_key", text=text).select(F.col("doc_id").alias("_found"), "n_shingles", "component_id")
    wordless = F.col("n_shingles") == 0
    rows = found.join(keyed.select("_key", doc_id, text), F.col("_found") == F.col("_key"))
    kept = rows.groupBy(
        F.when(~wordless, F.col("component_id")).alias("component"), F.when(wordless, F.col(doc_id)).alias("id"),
        F.when(wordless, F.col(text)).alias("empty")).agg(
        F.min(F.struct(F.col(doc_id).isNull().alias("none"), doc_id, "_key")).alias("least")).select("least._key")
    return keyed.join(kept, "_key", "left_semi").select(restored(docs.columns))


def redact_personal_data(spark, docs, sf_dir):
    """Every span of personal data gives way to its kind in brackets; ``n_chars`` follows."""
    inner, at = by_position(docs)
    text, n_chars = at["text"], at.get("n_chars")
    found = pii.find(inner, pii.Model(spark), text=text, base="_base", spans="_spans")
    found = found.withColumn(text, pii.redact(F.col(text), F.col("_spans")))
    if n_chars:
        found = found.withColumn(n_chars, F.length(text).cast(inner.schema[n_chars].dataType))
    return found.select(restored(docs.columns))


def mix_sources(spark, docs, sf_dir):
    """Documents as often as the mixture takes them: not at all, once, or in several passes."""
    inner, at = by_position(docs)
    keyed = stage(inner.withColumn("_key", F.monotonically_increasing_id()), "mix-documents")
    named = keyed.select("_key", *[F.col(at[c]).alias(c) for c in ("doc_id", "text", "source")])
    taken = mixing.mix(named, id="_key", shuffle="doc_id").filter("taken > 0").select(
        F.col("doc_id").alias("_taken_key"), (F.col("taken") / F.col("size")).cast("int").alias("_times"))
    chosen = keyed.join(taken, F.col("_key") == F.col("_taken_key"))
    return chosen.withColumn("_pass", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(restored(docs.columns))


def pack_windows(spark, docs, sf_dir):
    """Pieces of token ids in sequences of at most 2,048, as in ``op10_packing``."""
    pieces = packing.cut(docs, tokenizer_text("byte_bpe_50k.json"), ids=False)
    return packing.pack(pieces, order=("doc_id", "start", "ids_crc32")).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language", keep_known_languages),
    ("near_duplicates", keep_one_of_similar),
    ("personal_data", redact_personal_data),
    ("mixture", mix_sources),
    ("packing", pack_windows),
]


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
