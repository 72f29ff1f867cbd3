"""Prefix encoding, alignment of tokenizers and the filter audit against brute force and the libraries."""

import hashlib
import itertools
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers

from orderlens.llm import align, audit, bpe
from orderlens.llm import queries as q

from compare import connect, difference

SF = "/root/testdata/sf0.001"
PARTS = [*"abcdefghijABC '.,!?-_<>|/0129\n\t\r\x0b\xa0 ", "é", "é", "É", "ß", "İ", "ſ", "Σ", "日本", "\U0001f600", "́", "ǅ", "<|endoftext|>",
         "<|startoftext|>", "<|ENDOFTEXT|>", "</w>", "<s>", "<unk>", "<0x41>", "▁", "'s", "'LL", "the", "ing", "\0", "힣", "Ⅷ", "½", "!!!!", "aaaa", "====", "  ", "\x85"]
KIND = "doc_id bigint, text string, source string, ids string, a string, block string, bucket string"


def odd_rows(n=400):
    draw = random.Random(12)
    texts = ["".join(draw.choice(PARTS) for _ in range(draw.randint(0, 30))) for _ in range(n)]
    texts += [None, None, "", " ", "\n\n", "a" * 3000, "!" * 3000, "=-" * 2000, "日本語" * 700, " ".join(draw.choice(["the", "Thing", "x1", "é"]) for _ in range(9000))]
    texts += ["the same text of all"] * 30
    rows = [(i, t, draw.choice(["s1", "s2", "", None]), "x", "y", "z", "w") for i, t in enumerate(texts)]
    return rows + [rows[7], (None, "the same text of all", "s1", *"....")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_rows(), KIND).repartition(5)


def word_tokenizer():
    return tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_prefix_encoding_gives_the_ids_of_the_library(spark, docs):
    library, source = word_tokenizer(), q.tokenizer_text("word_bpe_49k.json")
    out = bpe.code(docs, source).collect()
    assert len(out) == len(odd_rows())
    want = Counter()
    for i, text, *_ in odd_rows():
        ids = library.encode(text or "", add_special_tokens=False).ids
        want[i, tuple(ids), library.decode(ids, skip_special_tokens=False)] += 1
    assert Counter((r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4").tolist()), r["decoded"]) for r in out) == want
    for r in out:
        assert r["n_tokens"] * 4 == len(r["ids"]) and r["ids_sha256"] == hashlib.sha256(r["ids"]).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest()
    digests = bpe.code(docs, source, whole=False)
    assert digests.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(str, digests.collect())) == sorted(map(str, [r for r in bpe.code(docs, source).select(digests.columns).collect()]))
    assert bpe.code(docs.limit(0), source).count() == 0


def test_every_prefix_has_one_last_token_and_memory_is_bounded(monkeypatch):
    own, library = bpe.PrefixCoder(q.tokenizer_text("word_bpe_49k.json")), word_tokenizer()
    draw = random.Random(4)
    for _ in range(2000):
        letters = "".join(draw.choice("aeionrstth") for _ in range(draw.randint(1, 14)))
        assert own.word(letters[:-1] + chr(ord(letters[-1]) + own.final)) == library.encode(letters, add_special_tokens=False).ids
    monkeypatch.setattr(bpe, "KEPT_BYTES", 20_000)
    monkeypatch.setattr(bpe, "KEPT_PAIRS", 50)
    own.kept, own.held, own.pairs = {}, 0, {}
    for _ in range(400):
        text = " ".join("".join(draw.choice("aeionrstth") for _ in range(draw.randint(1, 9))) for _ in range(9))
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
        assert own.held <= 20_000 and len(own.pairs) <= 50


def brute_alignment(rows):
    a_side = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letter = {c: b for b, c in zip(
        [*range(33, 127), *range(161, 173), *range(174, 256), *range(33), 127, *range(128, 161), 173],
        [*map(chr, range(33, 127)), *map(chr, range(161, 173)), *map(chr, range(174, 256)), *map(chr, range(256, 324))])}

    def piece_bytes(i):
        p = b_side.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b_side.is_byte(i) else p.replace("▁", " ").encode()

    grouped = []
    for _, text, *_ in rows:
        groups = []
        if text:
            a, b = a_side.encode(" " + text, add_special_tokens=False).ids, b_side.encode(text)
            of_a, of_b = [bytes(letter[c] for c in a_side.id_to_token(i)) for i in a], [piece_bytes(i) for i in b]
            if b"".join(of_a) == b"".join(of_b) == b" " + text.encode():
                ends_a, ends_b = list(itertools.accumulate(map(len, of_a))), list(itertools.accumulate(map(len, of_b)))
                common = sorted(set(ends_a) & set(ends_b))
                for start, end in zip([0, *common], common):
                    groups.append(([i for i, e in zip(a, ends_a) if start < e <= end], [i for i, e in zip(b, ends_b) if start < e <= end]))
        grouped.append(groups)
    count = Counter()
    for groups in grouped:
        count.update({(x, y) for a, b in groups for x in set(a) for y in set(b)})
    most = Counter()
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    out = Counter()
    for (i, *_), groups in zip(rows, grouped):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        links = [(x, y, m * k) for a, b in groups for x, m in Counter(a).items() for y, k in Counter(b).items()]
        out[i, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(m for *_, m in links),
            sum(m for x, y, m in links if count[x, y] == most[x]), sum(m * count[x, y] for x, y, m in links), text] += 1
    return out, count, most


def test_alignment_is_exact_with_and_without_broadcast(spark, docs, monkeypatch):
    sources = q.tokenizer_text("byte_bpe_50k.json"), open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()
    want, count, most = brute_alignment(odd_rows())
    assert sum(n for key, n in want.items() if key[1]) > 300 and any(key[4] > 5000 for key in want)
    for limit, block, fan in ((align.BROADCAST_BYTES, align.BLOCK_BYTES, 64), (0, 1, 2)):  # the second: a block every few rows, and a deep tree
        monkeypatch.setattr(align, "BLOCK_BYTES", block)
        monkeypatch.setattr(align, "FAN", fan)
        monkeypatch.setattr(align, "SLICE", 1 << 19 if limit else 500)
        rows, pairs = align.align(docs, *sources, broadcast_bytes=limit)
        found = rows.collect()
        assert Counter((r["doc_id"], *[r[c] for c in align._NUMBERS], r["groups"]) for r in found) == want
        assert all(r["groups_sha256"] == (hashlib.sha256(r["groups"].encode()).hexdigest() if r["groups"] else "") for r in found)
        assert {(r["a"], r["b"]): (r["n_docs"], r["best"]) for r in pairs.collect()} == {p: (n, n == most[p[0]]) for p, n in count.items()}
        assert align.align(docs.limit(0), *sources, broadcast_bytes=limit)[0].count() == 0


def test_hash_is_minimal_and_perfect():
    keys = np.unique(np.random.default_rng(3).integers(0, 1 << 31, 20_000))
    keys = keys[keys // 32_000 % align.BUCKETS == 7]
    levels = align.hash_levels(keys)
    assert sum(int(x.sum()) for x in levels) == len(keys)
    row = {"bucket": 7, "n": len(keys), "sizes": [len(x) for x in levels], "levels": [np.packbits(x).tobytes() for x in levels], "keys": keys.astype("<u4").tobytes()}
    table = align.Table([row], 32_000)
    table.keys = keys  # any order: only the numbers count here
    numbers = np.concatenate([i[i >= 0] for i in table.index])
    assert sorted(numbers.tolist()) == list(range(len(keys)))
    assert align.Table([], 5).find(keys).tolist() == [-1] * len(keys)


def brute_audit(rows, labels):
    smallest = {}
    for i, text, *_ in rows:
        if i is not None:
            smallest[text or ""] = min(i, smallest.get(text or "", i))
    failed = []
    for i, text, source, *_ in rows:
        t = text or ""
        words = t.encode().split()
        bad = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t),
               "D": any(c in "#$%&*|" for c in t), "E": i is not None and smallest[t] < i}
        own = [x for x in labels if x[0] == i and i is not None]
        failed.append((source or "", {f for f in bad if bad[f]}, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    out = {}
    for part in {f[0] for f in failed}:
        mine = [f[1:] for f in failed if f[0] == part]
        shapley = Counter()
        for order in itertools.permutations("ABCDE"):
            for step, own in enumerate(order):
                before = set(order[:step])
                gone = [f for f in mine if own in f[0] and not f[0] & before]
                shapley[own] += len(gone)
                out[part, "".join(order), step + 1] = [
                    sum(1 for f in mine if not f[0] & (before | {own})), len(gone), sum(1 for f in mine if own in f[0] and f[0] & before),
                    sum(1 for f in mine if f[0] == {own}), sum(f[1] for f in gone), sum(f[2] for f in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return {(*key, *row) for key, row in out.items()}


def test_audit_is_exact(spark, docs, monkeypatch):
    labels = [(i, i % 2, i % 3 % 2) for i in range(0, 450, 2)] + [(4, 1, 1), (None, 1, 1), (6, None, None)]
    table = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    want = brute_audit(odd_rows(), labels)
    for block, fan in ((audit.BLOCK_BYTES, 64), (500, 2)):
        monkeypatch.setattr(audit, "BLOCK_BYTES", block)
        monkeypatch.setattr(audit, "FAN", fan)
        assert {tuple(r) for r in audit.audit(docs, table).collect()} == want
    assert audit.audit(docs.limit(0), table.limit(0)).count() == 0


def test_matrix_has_one_number_for_every_word(spark, docs, monkeypatch):
    monkeypatch.setattr(audit, "BLOCK_BYTES", 500)
    monkeypatch.setattr(audit, "FAN", 2)
    shards, known = audit.matrix(docs)
    words = {}
    for r in known.collect():
        words |= {r["first"] + i: w for i, w in enumerate(bytes(r["words"]).split(b"\n"))}
    assert sorted(words) == list(range(len(words))) and len(set(words.values())) == len(words)
    found = Counter()
    for r in shards.collect():
        ends, terms, counts = (np.frombuffer(r[c], k) for c, k in (("ends", "<i4"), ("terms", "<i8"), ("counts", "<u4")))
        for doc, start, end in zip(r["rows"], ends, ends[1:]):
            found[doc["doc_id"], tuple(sorted((words[t], int(n)) for t, n in zip(terms[start:end], counts[start:end])))] += 1
    assert found == Counter((i, tuple(sorted(Counter((t or "").encode().split()).items()))) for i, t, *_ in odd_rows())


def test_registered_queries_give_the_contract_columns(spark):
    assert difference(q.op13_filter_audit(spark, SF), connect(SF), q.ORACLE["op13_filter_audit"]) is None
    rows = [(r["doc_id"], r["text"]) for r in q.table(spark, SF, "documents").collect()]
    library = word_tokenizer()
    want = set()
    for i, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.add((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                  hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert {tuple(r) for r in q.op11_bpe(spark, SF).collect()} == want
    want, *_ = brute_alignment(rows)
    out = q.op12_alignment(spark, SF).collect()
    assert Counter((r["doc_id"], *[r[c] for c in align._NUMBERS], r["groups_sha256"]) for r in out) == Counter(
        {(*key[:-1], hashlib.sha256(key[-1].encode()).hexdigest() if key[-1] else ""): n for key, n in want.items()})
