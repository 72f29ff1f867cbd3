"""Exact similarity join on word n-grams by prefixes, with n-grams dealt by hash.

The fragments below are hash parts of the n-gram space, not pieces of the global order cut at pivots; candidates come
from prefixes, and overlaps per part only verify pairs. No link depends on where a part is cut.

Documents with equal n-gram sets form one class; all later work is on classes.

1. The n-gram space is cut into fragments of bounded size. A fragment counts in how many classes
   each of its n-grams occurs. That number, then the n-gram, is the global order.
2. N-grams of one class link nothing and go no further. A class that shares too few n-grams to
   reach the similarity is done. Of the others, the rarest n-grams (as many as a partner may lack, and
   one) are its prefix; two similar classes share an n-gram of both prefixes.
3. Candidates share a prefix n-gram, with sizes and positions in the order that allow the similarity. Inside the list of
   one n-gram every class first meets one leader, then a few others; classes that links have joined
   already need no further comparison, so a group of thousands of near copies costs some comparisons per
   class. Of what is left, pairs of different components, a share is compared first, and then all
   that are still apart.
4. The n-grams of a pair are dealt into ``PARTS`` by their hash; overlaps are counted per part and
   summed per pair. The prefixes are counted first, and a pair that shares too little of them ends there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from orderlens.operators.staging import stage

from .components import connected
from .memory import tidy

WORDS = 5
PER_FRAGMENT = 3_000_000  # n-grams that one task of step 1 or 2 holds, about
PARTS = 4  # fragments in which the overlap of a pair is counted
LEADERS = (1, 8, 8, None)  # per n-gram and turn; in the last turn all pairs that are left are listed
FIRST = 4  # in the last turn one pair of so many is compared before the others, which their links may settle
_CHUNK = 1 << 22  # bytes of text hashed at once
_LOW = (1 << 48) - 1


def _mix(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


class Hasher:
    """64-bit hashes of the word n-grams of whole texts, A-Z lower-cased, words parted by ASCII white space."""

    def __init__(self, words: int = WORDS):
        self.words, self.powers = words, None

    def _powers(self, length: int):
        import numpy as np

        if self.powers is None or len(self.powers[0]) < length:
            base = 0x9E3779B97F4A7C15
            inverse = pow(base, -1, 1 << 64)
            powers = [np.full(max(length, _CHUNK + 1), b, np.uint64) for b in (base, inverse)]
            for p in powers:
                p[0] = 1
                np.multiply.accumulate(p, out=p)
            self.powers = powers
        return self.powers

    def sets(self, texts: list[bytes]):
        """(text numbers, hashes): the set of every text, ordered by text and hash."""
        import numpy as np

        data = np.frombuffer(b"\n".join(texts).lower() + b"\n", np.uint8)
        filled = ~((data == 32) | ((data >= 9) & (data <= 13)))
        edge = np.diff(np.r_[False, filled].astype(np.int8))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        power, inverse = self._powers(len(data) + 1)
        running = np.r_[np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:len(data)])]
        word = _mix((running[ends] - running[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
        begins = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
        text = np.searchsorted(begins, starts, "right") - 1
        n = self.words
        weight = _mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
        window = max(0, len(word) - n + 1)
        gram = np.zeros(window, np.uint64)
        for k in range(n):
            gram += word[k:k + window] * weight[k]
        whole = text[:window] == text[n - 1:n - 1 + window] if window else np.zeros(0, bool)
        owner, gram = text[:window][whole], _mix(gram[whole])
        counts = np.bincount(text, minlength=len(texts))
        short = np.flatnonzero((counts > 0) & (counts < n))
        if len(short):
            first = np.searchsorted(text, short)
            alone = np.zeros(len(short), np.uint64)
            for k in range(n - 1):
                has = counts[short] > k
                alone[has] += word[first[has] + k] * weight[k]
            owner = np.r_[owner, short]
            gram = np.r_[gram, _mix(alone + counts[short].astype(np.uint64) * np.uint64(0xA0761D6478BD642F))]
        order = np.lexsort((gram, owner))
        owner, gram = owner[order], gram[order]
        new = np.r_[True, (owner[1:] != owner[:-1]) | (gram[1:] != gram[:-1])][:len(owner)]
        return owner[new], gram[new]

    def chunks(self, texts):
        """Texts in chunks of about _CHUNK bytes: (number of the first, how many, text numbers, hashes)."""
        held, size, first = [], 0, 0
        for i, t in enumerate(texts):  # an Arrow column: texts become Python strings one by one
            held.append((t.as_py() or "").encode("utf-8", "surrogatepass"))
            size += len(held[-1])
            if size >= _CHUNK or i == len(texts) - 1:
                yield (first, len(held), *self.sets(held))
                held, size, first = [], 0, i + 1


def _digests(owner, gram, texts: int):
    """Size of every text's set and a digest of it in two numbers; the size 0 has none."""
    import numpy as np

    sizes = np.bincount(owner, minlength=texts)
    one, two = np.zeros(texts, np.uint64), np.zeros(texts, np.uint64)
    filled = np.flatnonzero(sizes)
    if len(filled):
        at = np.searchsorted(owner, filled)
        one[filled] = np.add.reduceat(_mix(gram * np.uint64(0x9FB21C651E98DF25)), at)
        two[filled] = np.bitwise_xor.reduceat(_mix(gram + np.uint64(0x2545F4914F6CDD1D)), at)
    return sizes, _mix(one + sizes.astype(np.uint64)).view(np.int64), two.view(np.int64)


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id, n_shingles, set, check`` of every row: the size and digest of its set."""

    @tidy
    def digest(batches):
        import pyarrow as pa

        hasher = Hasher(words)
        for batch in batches:
            for first, many, owner, gram in hasher.chunks(batch.column(1)):
                sizes, one, two = _digests(owner, gram, many)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, many), pa.array(sizes, pa.int64()),
                     pa.array(one, pa.int64(), mask=sizes == 0), pa.array(two, pa.int64(), mask=sizes == 0)],
                    ["doc_id", "n_shingles", "set", "check"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(digest, f"doc_id {kind}, n_shingles bigint, set bigint, check bigint")


_BLOCK = "bucket int, sets binary, sizes binary, counts binary, grams binary"


def _fragments(docs: DataFrame, words: int, fragments: int) -> DataFrame:
    """The n-grams of all sets, dealt by fragment in blocks of many texts; a set once per block."""

    @tidy
    def deal(batches):
        import numpy as np
        import pyarrow as pa

        hasher = Hasher(words)
        for batch in batches:
            for _, many, owner, gram in hasher.chunks(batch.column(1)):
                sizes, sets, _ = _digests(owner, gram, many)
                once = np.zeros(many, bool)
                once[np.unique(sets, return_index=True)[1]] = True
                owner, gram = owner[once[owner]], gram[once[owner]]
                bucket = ((gram >> np.uint64(48)) % np.uint64(fragments)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                owner, gram, bucket = owner[order], gram[order], bucket[order]
                rows = []
                for b, at, till in _runs(bucket):
                    mine, n = np.unique(owner[at:till], return_counts=True)
                    low = (gram[at:till] & np.uint64(_LOW)).view(np.uint8).reshape(-1, 8)[:, :6]
                    rows.append((b, sets[mine].tobytes(), sizes[mine].astype("<i4").tobytes(), n.astype("<i4").tobytes(), low.tobytes()))
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int32()] + [pa.binary()] * 4)], [c.split()[0] for c in _BLOCK.split(", ")])

    return docs.mapInArrow(deal, _BLOCK)


def _runs(sorted_values):
    """(value, from, till) of the runs of equal values."""
    import numpy as np

    if len(sorted_values):
        at = np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]])
        yield from zip(sorted_values[at].tolist(), at.tolist(), [*at[1:].tolist(), len(sorted_values)])


def _shared(buckets: int):
    """Of one fragment: its n-grams that several sets hold, dealt by set, with the number of sets."""

    @tidy
    def count(table):
        import numpy as np
        import pyarrow as pa

        read = lambda name, kind: np.concatenate([np.frombuffer(x, kind) for x in table.column(name).to_pylist()])
        sets, sizes, counts = read("sets", "<i8"), read("sizes", "<i4"), read("counts", "<i4")
        low = read("grams", np.uint8).reshape(-1, 6)
        gram = np.zeros((len(low), 8), np.uint8)
        gram[:, :6] = low
        gram = gram.reshape(-1).view("<u8").astype(np.int64) | (table.column("bucket")[0].as_py() << 48)
        holder = np.repeat(np.arange(len(sets)), counts)
        order = np.lexsort((sets[holder], gram))
        gram, holder = gram[order], holder[order]
        owner = sets[holder]
        new = np.r_[True, (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])]
        gram, holder, owner = gram[new], holder[new], owner[new]
        at = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
        many = np.repeat(np.diff(np.r_[at, len(gram)]), np.diff(np.r_[at, len(gram)]))
        keep = many > 1
        gram, owner, size, many = gram[keep], owner[keep], sizes[holder[keep]], many[keep]
        bucket = owner.view(np.uint64) % np.uint64(buckets)
        order = np.lexsort((owner, bucket))
        rows = []
        for b, first, till in _runs(bucket[order]):
            mine = order[first:till]
            rows.append((int(b), owner[mine].tobytes(), size[mine].astype("<i4").tobytes(), many[mine].astype("<i4").tobytes(), gram[mine].tobytes()))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, [pa.int32()] + [pa.binary()] * 4)],
                        names=[c.split()[0] for c in _BLOCK.split(", ")])

    return count


_CLASS = "set bigint, size int, alone int, prefix array<bigint>, parts array<array<bigint>>"


def _prefixes(percent: int):
    """Of one bucket of sets: those that share enough n-grams, with their prefix and the n-grams in parts by hash."""

    @tidy
    def choose(table):
        import numpy as np
        import pyarrow as pa

        read = lambda name, kind: np.concatenate([np.frombuffer(x, kind) for x in table.column(name).to_pylist()])
        sets, sizes, many, gram = read("sets", "<i8"), read("sizes", "<i4"), read("counts", "<i4"), read("grams", "<i8")
        order = np.lexsort((gram, many, sets))
        sets, sizes, gram = sets[order], sizes[order], gram[order]
        rows = []
        for key, at, till in _runs(sets):
            size, shared = int(sizes[at]), till - at
            needed = -(-percent * size // 100)
            if shared >= needed:
                mine = gram[at:till]
                rows.append((key, size, size - shared, mine[:shared - needed + 1], [np.sort(mine[(mine & 0xFFFF) % PARTS == p]) for p in range(PARTS)]))
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.list_(pa.int64()))]
        return pa.table([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [[]] * 5, kinds)],
                        names=["set", "size", "alone", "prefix", "parts"])

    return choose


def _needed(percent: int, size, other):
    """The overlap that two sets of these sizes need."""
    return F.ceil(percent * (F.col(size) + F.col(other)) / F.lit(100.0 + percent) - 1e-9)


def _promising(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Of the ``pairs`` (a, b), those whose prefixes share enough.

    Of the overlap needed, at most the n-grams behind the prefix can be missing from it, and what is common within
    the prefix that ends first lies in the other one too.
    """
    def heads(end):
        return classes.select(F.col("set").alias(end), F.col("size").alias(f"size_{end}"), F.col("prefix").alias(f"prefix_{end}"),
                              (F.col("size") - F.col("alone") - F.size("prefix")).alias(f"behind_{end}"))

    both = pairs.join(heads("a"), "a").join(heads("b"), "b")
    least = _needed(percent, "size_a", "size_b") - F.greatest("behind_a", "behind_b")
    return both.filter(F.size(F.array_intersect("prefix_a", "prefix_b")) >= least).select("a", "b")


def _apart(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """Pairs whose sets lie in different components."""
    for end in ("a", "b"):
        named = names.select(F.col("node").alias(end), F.col("component").alias(f"component_{end}"))
        pairs = pairs.join(named, end, "left")
    return pairs.filter(F.coalesce("component_a", "a") != F.coalesce("component_b", "b")).drop("component_a", "component_b")


def _links(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Of the ``pairs`` (a, b), those that reach the similarity: overlaps per part, summed."""
    def parts(end):
        return classes.select(F.col("set").alias(end), F.col("size").alias(f"size_{end}"), F.posexplode("parts").alias("part", f"grams_{end}"))

    both = pairs.join(parts("a"), "a").join(parts("b"), ["b", "part"])
    overlap = both.groupBy("a", "b").agg(
        F.sum(F.size(F.array_intersect("grams_a", "grams_b"))).alias("both"), F.first("size_a").alias("size_a"), F.first("size_b").alias("size_b"))
    return overlap.filter(100 * F.col("both") >= percent * (F.col("size_a") + F.col("size_b") - F.col("both"))).select("a", "b")


def similar(docs: DataFrame, *, percent: int = 75, words: int = WORDS, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs``.

    Two rows link if the Jaccard similarity of their sets of ``words``-grams is at least ``percent`` hundredths. A
    text with fewer words has one n-gram, its whole sequence; a null text or one without words has none and links with
    nothing. Equal rows are linked copies. ``component_id`` is the smallest id reachable by links; a null id is
    never the smallest. An empty table gives an empty table. N-grams are told apart by hashes of 51 bits for a few million n-grams,
    and of up to 62 bits as their number, and so that of the fragments, grows.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    sets = stage(_sets(source, words), "jaccard-sets")
    classes = stage(sets.filter("set is not null").groupBy("set", "check").agg(
        F.min("doc_id").alias("first"), F.first("n_shingles").alias("size")), "jaccard-classes")
    total = classes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    fragments = min(1 << 14, max(8, -(-total // PER_FRAGMENT)))
    shared = _fragments(source, words, fragments).groupBy("bucket").applyInArrow(_shared(fragments), _BLOCK)
    chosen = stage(shared.groupBy("bucket").applyInArrow(_prefixes(percent), _CLASS), "jaccard-prefixes")
    lists = chosen.select("set", "size", "alone", F.posexplode("prefix").alias("rank", "gram"))
    entries = stage(lists.select("set", "size", "gram", (F.col("alone") + F.col("rank")).alias("at")), "jaccard-lists")
    names = links = tried = None
    for turn, leaders in enumerate(LEADERS):
        open_ = entries
        if names is not None:
            open_ = entries.join(names, F.col("set") == F.col("node"), "left").select(
                "set", "size", "gram", "at", F.coalesce("component", "set").alias("component"))
            mixed = open_.groupBy("gram").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("gram")
            open_ = open_.join(mixed, "gram")
        else:
            open_ = open_.withColumn("component", F.col("set"))
        other = open_.select("gram", F.col("set").alias("b"), F.col("size").alias("size_b"), F.col("at").alias("at_b"), F.col("component").alias("component_b"))
        if leaders:
            seat = F.explode(F.sequence(F.lit(1), F.lit(leaders)))
            drawn = F.xxhash64("b", "seat", F.lit(turn))
            other = other.withColumn("seat", seat).groupBy("gram", "seat").agg(
                F.min_by(F.struct("b", "size_b", "at_b", "component_b"), drawn).alias("l")).select("gram", "l.*").distinct()
        # Two sets with the overlap needed share an n-gram among those that either may lack, and one.
        needed = _needed(percent, "size", "size_b")
        fits = (F.col("component") != F.col("component_b")) & (F.least("size", "size_b") >= needed) & (
            F.col("at") <= F.col("size") - needed) & (F.col("at_b") <= F.col("size_b") - needed)
        met = open_.join(other, "gram").filter(fits & (F.col("set") != F.col("b")) if leaders else fits & (F.col("set") < F.col("b")))
        pairs = met.select(F.least("set", "b").alias("a"), F.greatest("set", "b").alias("b")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = stage(_promising(pairs, chosen, percent), "jaccard-pairs")
        tried = pairs if tried is None else tried.union(pairs)
        for early in (False,) if leaders else (True, False):
            if pairs.isEmpty():
                break
            now = pairs.filter(F.pmod(F.xxhash64("a", "b"), F.lit(FIRST)) == 0) if early else pairs
            found = stage(_links(now, chosen, percent), "jaccard-links")
            links = found if links is None else links.union(found)
            names = connected(links)
            if early:
                pairs = stage(_apart(pairs.join(now, ["a", "b"], "left_anti"), names), "jaccard-left")
    ids = classes.select("set", "check", "first")
    if names is not None:
        ids = ids.join(names, F.col("set") == F.col("node"), "left")
        component = F.coalesce("component", "set")
    else:
        component = F.col("set")
    ids = ids.withColumn("component", component).select("set", "check", "first", "component")
    smallest = ids.groupBy("component").agg(F.min("first").alias("smallest"))
    named = ids.join(smallest, "component").select("set", "check", "smallest")
    return sets.join(named, ["set", "check"], "left").select(
        "doc_id", "n_shingles", F.coalesce("smallest", "doc_id").alias("component_id"))
