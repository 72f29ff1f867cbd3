"""Token ids of whole texts by the ``tokenizers`` library, which sees every word once per task.

Encoding costs far more than a look-up, and words repeat. A text is cut where the tokenizer cuts
it in any case, so the ids of a text are the ids of its parts in order:

* ``spaced=True`` (byte-level vocabularies whose words carry the space before them): before a space
  that a character other than white space follows;
* ``spaced=False`` (vocabularies that drop white space): at spaces and line feeds.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable

LONGEST_KEPT = 11  # longer words rarely come again
MOST_KEPT = 1_200_000  # words remembered by one task before it starts anew
_NO_CUT = re.compile(r" (?:\s|\Z)")


class Words:
    """Little-endian unsigned 32-bit ids of words, as bytes, kept for the time of a task."""

    def __init__(self, source: str, spaced: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import numpy as np
        import tokenizers

        self.tokenizer = tokenizers.Tokenizer.from_str(source)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special}
        self.mark, self.mark_id = next(iter(special.items()), (None, None))
        self.spaced = spaced
        self.kept: dict[str, bytes] = {}
        if spaced:  # ids whose tokens start with a space, which byte-level vocabularies write as this letter
            vocabulary = self.tokenizer.get_vocab()
            self.begins = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
            self.begins[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True

    def cut(self, text: str) -> list[str]:
        """Words of a text. With ``spaced``, all but the first stand for a space and the word."""
        if not self.spaced:
            return [w for w in text.replace("\n", " ").split(" ") if w]
        words = text.split(" ")
        if _NO_CUT.search(text):
            parts = words[:1]
            for w in words[1:]:
                if w and not w[0].isspace():
                    parts.append(w)
                else:
                    parts[-1] += " " + w  # no cut before this space
            return parts
        return words

    def alone(self, word: str) -> bytes:
        import numpy as np

        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, words: list[str]) -> list[bytes]:
        """Many words in one call. Their ids part before a token that starts with a space, or at a special token."""
        import numpy as np

        if len(words) < 2 or (self.mark is None and not self.spaced):
            return [self.alone(" " + w if self.spaced else w) for w in words]
        text = " " + " ".join(words) if self.spaced else self.mark.join(words)
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        data = ids.tobytes()
        if self.spaced:
            starts = (np.flatnonzero(self.begins[ids]) * 4).tolist()
            ends = [*starts[1:], len(data)]
        else:
            at = np.flatnonzero(ids == self.mark_id)
            starts, ends = [0, *((at + 1) * 4).tolist()], [*(at * 4).tolist(), len(data)]
        if len(starts) != len(words):
            return [self.alone(" " + w if self.spaced else w) for w in words]
        return [data[a:b] for a, b in zip(starts, ends)]

    def of(self, texts: Iterable[str | None]) -> Iterable[bytes]:
        """The ids of every text."""
        for text in texts:
            words, head = self.cut(text) if text else [], b""
            if self.spaced and words:
                head, words = self.alone(words[0]), words[1:]
            kept = self.kept
            missing = [w for w in set(words) if w not in kept]
            if missing:
                # What holds a space or could complete a special token is encoded by itself.
                odd = {w for w in missing if "<" in w or ">" in w or " " in w}
                plain = [w for w in missing if w not in odd] if odd else missing
                kept.update(zip(plain, self.encode(plain)))
                for w in odd:
                    kept[w] = self.alone(" " + w if self.spaced else w)
            yield head + b"".join([kept[w] for w in words])
            for word in missing:
                if len(word) > LONGEST_KEPT:
                    del kept[word]
            if len(kept) > MOST_KEPT:
                self.kept = {}


def some(rows: Iterable, most: int = 4 << 20) -> Iterable[list]:
    """Lists of rows that end with a byte string, each list of about ``most`` bytes."""
    block, held = [], 0
    for row in rows:
        block.append(row)
        held += len(row[-1])
        if held >= most:
            yield block
            block, held = [], 0
    if block:
        yield block
