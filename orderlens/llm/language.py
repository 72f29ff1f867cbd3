"""Language identification by a string kernel.

The blended-spectrum presence kernel of two texts counts the character n-grams (1 to 4 characters, told apart
by an 18-bit hash) that both hold, divided by the root of the product of the numbers each holds. Landmark
texts and the Nystroem method turn the kernel into a finite feature map, on which one-versus-rest kernel ridge
regression is solved in closed form. A batch of texts is scored by matrix products: presence
rows times landmark presence times the map and the weights of all languages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .memory import parts, tidy

ORDERS = 4
BITS = 18
LANDMARKS = 240
TRAINING = 3000  # labelled rows in the fit, over all languages
LETTER = r"\p{L}"
_AT_ONCE = 32


def held_out(id: Column) -> Column:
    return F.crc32(id.cast("string").cast("binary")) % 4 == 2


class Presence:
    """Which hashed n-grams whole texts hold. Case and everything but letters are levelled out."""

    def __init__(self):
        import sys

        import numpy as np

        self.letter = np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)

    def ids(self, text: str | None):
        """Hashes of the n-grams of a text, repeats included; none for a text without letters."""
        import numpy as np

        points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")
        letters = self.letter[points]
        if not letters.any():
            return np.zeros(0, np.uint32)
        points = np.where(letters, points, np.uint32(32))
        points = points[letters | np.r_[True, letters[:-1]]]  # one blank for a run of other characters
        found, rolling = [], np.zeros(len(points), np.uint32)
        for n in range(1, ORDERS + 1):
            if n > len(points):
                break
            rolling = rolling[:len(points) - n + 1] * np.uint32(0x01000193) + points[n - 1:]
            mixed = (rolling ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
            found.append((mixed ^ (mixed >> np.uint32(15))) & np.uint32((1 << BITS) - 1))
        return np.concatenate(found)

    def rows(self, texts):
        """For a few texts: row and hash of every n-gram a text holds, each once, in order of rows."""
        import numpy as np

        table = np.zeros((len(texts), 1 << BITS), dtype=bool)
        for row, text in enumerate(texts):
            table[row, self.ids(text)] = True
        return np.divmod(np.flatnonzero(table), 1 << BITS)


def kernel_map(kept, languages, landmarks: int, ridge: float):
    """(matrix of hash buckets by languages, names): scores are presence rows times the matrix, each divided by the root
    of the number of n-grams in its row. ``kept`` are presence rows as ``_presences`` packs them."""
    import zlib

    import numpy as np

    names = sorted(set(languages))

    def row(i):
        return np.flatnonzero(np.unpackbits(np.frombuffer(zlib.decompress(kept[i]), np.uint8)))

    filled = [i for i in range(len(kept)) if len(row(i))]
    if not filled:
        return np.zeros((1 << BITS, len(names)), np.float32), names
    by_language = [[i for i in filled if languages[i] == name] for name in names]
    turns = [i for turn in range(len(filled)) for found in by_language if turn < len(found) for i in [found[turn]]]
    chosen = turns[:landmarks]
    # Only n-grams of landmarks have a row in the driver's matrix; all others share the last, which is zero.
    used = np.unique(np.concatenate([row(i) for i in chosen]))
    at = np.full(1 << BITS, len(used))
    at[used] = np.arange(len(used))
    base = np.zeros((len(used) + 1, len(chosen)), np.float32)
    for column, i in enumerate(chosen):
        base[at[row(i)], column] = len(row(i)) ** -0.5
    kernel = np.array([base[at[row(i)]].sum(0) * len(row(i)) ** -0.5 for i in filled], np.float64)
    within = np.array([base[at[row(i)]].sum(0) * len(row(i)) ** -0.5 for i in chosen], np.float64)
    values, vectors = np.linalg.eigh(within)
    good = values > 1e-8 * values.max()
    nystroem = vectors[:, good] / np.sqrt(values[good])
    features = kernel @ nystroem
    target = np.array([[languages[i] == name for name in names] for i in filled], np.float64)
    # Rare languages weigh as much as frequent ones.
    weight = target @ (1 / np.maximum(1, target.sum(0)))
    left = (features * weight[:, None]).T @ features + ridge / len(filled) * np.eye(features.shape[1])
    weights = np.linalg.solve(left, (features * weight[:, None]).T @ target)
    scores = np.zeros((1 << BITS, len(names)), np.float32)
    scores[used] = base[:-1] @ (nystroem @ weights).astype(np.float32)
    return scores, names


def fit(labelled: DataFrame, *, text: str = "text", lang: str = "lang", id: str = "doc_id", landmarks: int = LANDMARKS,
        training: int = TRAINING, ridge: float = 0.3):
    """Fit on at most about ``training`` rows of ``labelled``, an equal number for every language.

    Rows without letters or language are left out. Whole texts of any length are read on executors, which turn each into
    a presence row of at most about 2 ** BITS / 8 bytes, so the driver's share is bounded by ``training`` alone. Which rows are taken
    follows from a hash of their ids. None without any such row.
    """
    rows = labelled.filter(F.col(text).rlike(LETTER) & F.col(lang).isNotNull())
    found = rows.groupBy(lang).agg(F.count(F.lit(1))).collect()
    if not found:
        return None
    each, share = max(1, training // len(found)), F.lit(0.0)
    for name, n in found:
        share = F.when(F.col(lang) == name, min(1.0, each / n)).otherwise(share)
    drawn = F.pmod(F.xxhash64(F.col(id).cast("string"), F.lit("fit")), F.lit(1 << 30)) / float(1 << 30)
    sampled = rows.filter(drawn < share).select(F.col(text).alias("t"), F.col(lang).alias("l"))
    sample = sorted((l, bytes(t)) for t, l in sampled.mapInArrow(_presences, "t binary, l string").collect())
    if not sample:
        return None
    return kernel_map([t for _, t in sample], [name for name, _ in sample], landmarks, ridge)


@tidy
def _presences(batches):
    """Presence rows of texts, as compressed bits, with their languages."""
    import zlib

    import numpy as np
    import pyarrow as pa

    presence = Presence()
    for batch in (part for whole in batches for part in parts(whole)):
        bits = []
        for text in batch.column(0):
            held = np.zeros(1 << BITS, bool)
            held[presence.ids(text.as_py())] = True
            bits.append(zlib.compress(np.packbits(held).tobytes(), 1))
        yield pa.RecordBatch.from_arrays([pa.array(bits, pa.binary()), batch.column(1)], ["t", "l"])


def identify(docs: DataFrame, model, *, id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, lang_pred, score`` (and the columns ``keep``) of every row of ``docs``; only the text decides.

    ``lang_pred`` is ``und`` with score 0 for a null text, a text without letters, and without a model (nothing
    labelled to learn from); ties go to the first name. ``score`` is the ridge output of the best language
    limited to 0 to 1. Whole texts are read, 32 at a time; equal rows stay; an empty table gives an empty table.
    """
    chosen = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("_text"), *[F.col(c).alias(f"_keep_{i}") for i, c in enumerate(keep)])

    @tidy
    def predict(batches):
        import numpy as np
        import pyarrow as pa

        presence = Presence()
        for batch in (part for whole in batches for part in parts(whole)):
            texts = batch.column(1).to_pylist()
            best, score = ["und"] * len(texts), [0.0] * len(texts)
            for at in range(0, len(texts) if model else 0, _AT_ONCE):
                some = texts[at:at + _AT_ONCE]
                rows, hashes = presence.rows(some)
                sizes = np.bincount(rows, minlength=len(some))
                filled = np.flatnonzero(sizes)
                if len(filled):
                    starts = np.r_[0, np.cumsum(sizes[filled])[:-1]]
                    scores = np.add.reduceat(model[0][hashes], starts, axis=0) / np.sqrt(sizes[filled])[:, None]
                    for row, k, s in zip(filled + at, scores.argmax(1), scores.max(1)):
                        best[row], score[row] = model[1][k], float(min(1.0, max(0.0, s)))
            columns = [batch.column(0), pa.array(best, pa.string()), pa.array(score, pa.float64()), *batch.columns[1:]]
            names = ["doc_id", "lang_pred", "score", *batch.schema.names[1:]]
            yield pa.RecordBatch.from_arrays(columns if keep else columns[:3], names if keep else names[:3])

    kinds = [f"doc_id {chosen.schema['doc_id'].dataType.simpleString()}", "lang_pred string", "score double"]
    if keep:
        kinds += [f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[1:]]
    found = chosen.mapInArrow(predict, ", ".join(kinds))
    return found.select("doc_id", "lang_pred", "score", *[F.col(f"_keep_{i}").alias(c) for i, c in enumerate(keep)])
