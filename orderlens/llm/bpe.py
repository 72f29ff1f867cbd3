"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

Every prefix of a word has exactly one encoding, so the last token of each prefix says all: cut it off and go on with
the last token of what remains. For each prefix the automaton of the vocabulary's suffixes (Aho-Corasick: its failure
links list every token that ends there, the longest first) gives the candidates. A candidate is the last token if it and the last
token of the prefix before it are compatible, that is, if merging the two side by side leaves the border between them.

Whether a border stays follows from ranks alone. The tokens that touch it are, over time, the right edge of the left
token and the left edge of the right one; a merge across it happens if a pair of edges that exist together has a
rank below the one that ends the left edge and not above the one that ends the right edge (of equal pairs the left
one merges first). Tests of pairs are kept, and so are whole words, within bounded memory.
"""

from __future__ import annotations

import functools
import json
import re

from pyspark.sql import DataFrame, functions as F

from .bytelevel import letters
from .memory import parts, tidy
from .vocabulary import some

KEPT_BYTES = 96 << 20  # of words with their ids that a worker remembers
KEPT_PAIRS = 1 << 20
_FINAL = 0x1000  # added to the letter that ends a word

# How tokenizers of this kind cut normalised text (fixed values), and the texts that Python cuts alike: of Latin letters,
# whose normal form and lower case depend on no neighbour, and usual white space. Others are cut by the library.
NORMALIZER = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LATIN = re.compile("[\t\n\r\x20-\x7e\xa1-\u012f\u0131-\u0233]*+")


class PrefixCoder:
    """Encodes texts as a JSON tokenizer with a byte-level alphabet and a word end does; ``names`` are its tokens."""

    def __init__(self, source: str):
        import ahocorasick
        import tokenizers

        told = json.loads(source)
        model, whole = told["model"], tokenizers.Tokenizer.from_str(source)
        suffix = model.get("end_of_word_suffix") or ""
        if model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or told["decoder"]:
            raise ValueError("not a plain BPE tokenizer")
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] or re.search(r"[ \n]", t["content"]) for t in told["added_tokens"]):
            raise ValueError("added tokens that depend on their surroundings")
        self.normalize, self.cut = whole.normalizer.normalize_str, whole.pre_tokenizer.pre_tokenize_str
        before = told["pre_tokenizer"]["pretokenizers"]
        usual = told["normalizer"] == NORMALIZER and len(before) == 2 and before[0] == {
            "type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True}
        self.latin = self._latin_words() if usual else None
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.marks = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        vocabulary = model["vocab"]
        self.names = {i: t for t, i in (vocabulary | self.special).items()}
        self.final = _FINAL if suffix else 0
        self.written = {byte: letter for letter, byte in letters().items()}

        # Letters of every token, from the alphabet up; a merge needs both of its parts to be known before.
        spelled, self.rank, self.parts, self.merged = {}, {}, {}, {}
        for letter in letters():
            spelled[vocabulary[letter]] = letter
            spelled[vocabulary[letter + suffix]] = chr(ord(letter) + self.final)
        for rank, merge in enumerate(model["merges"]):
            left, right = (vocabulary[p] for p in (merge.split(" ") if isinstance(merge, str) else merge))
            made = vocabulary[self.names[left] + self.names[right]]
            if made in spelled or left not in spelled or right not in spelled:
                raise ValueError("merges that do not build the vocabulary from its letters")
            spelled[made] = spelled[left] + spelled[right]
            self.rank[made], self.parts[made], self.merged[left, right] = rank, (left, right), rank
        self.length = {i: len(s) for i, s in spelled.items()}

        # A token that its own letters never lead to is no candidate.
        own, self.automaton = set(), ahocorasick.Automaton()
        for token in sorted(spelled, key=lambda i: self.rank.get(i, -1)):
            left, right = self.parts.get(token, (None, None))
            if left is None or (left in own and right in own and not self.crossed(left, right, self.rank[token])):
                own.add(token)
                self.automaton.add_word(spelled[token], token)
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.kept: dict[str, bytes] = {}
        self.held = 0

    def crossed(self, left: int, right: int, before: float = float("inf")) -> bool:
        """A merge with a rank under ``before`` crosses the border between two tokens."""
        rank, parts, merged = self.rank, self.parts, self.merged
        left_ends = right_ends = float("inf")  # the ranks at which the edges are merged into what holds them
        while True:
            across = merged.get((left, right))
            if across is not None and across < before and across < left_ends and across <= right_ends:
                return True
            # Back in time: the edge that was made last parts; of equal ones the right one, which merges last.
            made_left, made_right = rank.get(left, -1), rank.get(right, -1)
            if made_left < 0 and made_right < 0:
                return False
            if made_left > made_right:
                left, left_ends = parts[left][1], made_left
            else:
                right, right_ends = parts[right][0], made_right

    def word(self, letters: str) -> list[int]:
        """Ids of one word in letters of the alphabet, the last one marked as final."""
        last, length, pairs = [None] * (len(letters) + 1), self.length, self.pairs
        for end, token in self.automaton.iter(letters):
            if last[end + 1] is None:
                start = end + 1 - length[token]
                if start:
                    pair = last[start], token
                    good = pairs.get(pair)
                    if good is None:
                        if len(pairs) >= KEPT_PAIRS:
                            pairs.clear()
                        good = pairs[pair] = not self.crossed(*pair)
                    if not good:
                        continue
                last[end + 1] = token
        ids, at = [], len(letters)
        while at:
            ids.append(last[at])
            at -= length[last[at]]
        return ids[::-1]

    @staticmethod
    def _latin_words():
        """The pattern for lower-case texts that _LATIN matches."""
        import unicodedata

        kinds = {"L": "", "N": ""}
        for c in map(chr, range(0x234)):
            if unicodedata.category(c)[0] in kinds:
                kinds[unicodedata.category(c)[0]] += c
        return re.compile(PATTERN.replace(r"\p{L}", kinds["L"]).replace(r"\p{N}", kinds["N"]))

    def _remembered(self, text: str, ids: bytes) -> bytes:
        size = len(ids) + 2 * len(text) + 200
        if size < KEPT_BYTES >> 6:
            if self.held + size > KEPT_BYTES:
                self.kept.clear()
                self.held = 0
            self.kept[text] = ids
            self.held += size
        return ids

    def _word(self, word: str) -> bytes:
        """Ids of one word as it is cut, kept for its next occurrence."""
        import numpy as np

        letters = word if word.isascii() else word.encode().decode("latin-1").translate(self.written)
        ids = np.array(self.word(letters[:-1] + chr(ord(letters[-1]) + self.final)), "<u4").tobytes()
        return self._remembered(word, ids)

    def _plain(self, text: str) -> bytes:
        """Ids of a text without special tokens."""
        import numpy as np

        if self.latin and _LATIN.fullmatch(text):
            get, make = self.kept.get, self._word
            return b"".join([get(w) or make(w) for w in self.latin.findall(text.lower())])
        chunks, ids = text.replace("\n", " ").split(" "), []
        if len(chunks) > 1:  # no word goes over a blank or a line feed
            return b"".join(map(self._plain, filter(None, chunks)))
        key = " " + text  # not to be taken for a word that is cut already
        found = self.kept.get(key)
        if found is None:
            for letters, _ in self.cut(self.normalize(text)):
                ids += self.word(letters[:-1] + chr(ord(letters[-1]) + self.final))
            found = self._remembered(key, np.array(ids, "<u4").tobytes())
        return found

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of a whole text; the strings of special tokens in it become these."""
        parts, at = [], 0
        for mark in self.marks.finditer(text):
            parts += [self._plain(text[at:mark.start()]), self.special[mark.group()].to_bytes(4, "little")]
            at = mark.end()
        return b"".join([*parts, self._plain(text[at:])])

    def decode(self, ids: bytes) -> str:
        """What the library gives without a decoder: the tokens, special ones included, with blanks between them."""
        import numpy as np

        return " ".join(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.lru_cache(maxsize=1)
def coder(source: str) -> PrefixCoder:
    """Kept for the tasks that a worker runs one after another."""
    return PrefixCoder(source)


def code(docs: DataFrame, tokenizer: str, *, id: str = "doc_id", text: str = "text", whole: bool = True) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``, with ``whole`` also ``ids`` and ``decoded``, of every row.

    ``tokenizer`` is the text of a JSON file. ``ids`` are little-endian unsigned 32-bit numbers of the whole text,
    ``decoded`` is the text they decode to. A null or empty text, or one of white space, has no ids. Rows are coded where they lie, copies each;
    other columns are not read, and an empty table gives an empty table.
    """
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "decoded", "ids"]

    @tidy
    def work(batches):
        from hashlib import sha256

        import pyarrow as pa

        own = coder(tokenizer)

        def rows(batch):
            for doc, body in zip(batch.column(0), batch.column(1)):
                ids = own.encode(body.as_py()) if body.is_valid else b""
                decoded = own.decode(ids)
                yield (doc.as_py(), len(ids) // 4, sha256(ids).hexdigest(), sha256(decoded.encode()).hexdigest(),
                       decoded if whole else "", ids if whole else b"")

        for batch in (part for whole in batches for part in parts(whole)):
            kinds = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
            for block in some(rows(batch)) if whole else [list(rows(batch))]:
                columns = [pa.array(c, k) for c, k in zip(zip(*block) if block else [[]] * 6, kinds)]
                n = len(names) if whole else 4
                yield pa.RecordBatch.from_arrays(columns[:n], names[:n])

    source = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(work, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
                                   + (", decoded string, ids binary" if whole else ""))
