"""Token ids of byte-level vocabularies, and the bytes their tokens stand for.

A byte-level vocabulary whose merges make its ids in order is also a table of ranks, and ``tiktoken`` encodes by
ranks. On texts of all code points, in several contexts, it gave the ids of the ``tokenizers`` library, in a
quarter of the time, without words to be kept in memory.
"""

from __future__ import annotations

import json

# The pattern by which byte-level vocabularies of this kind cut a text (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def letters() -> dict[str, int]:
    """Letter by which a byte-level vocabulary writes a byte: printable bytes by themselves, the others from U+0100 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteLevel:
    """``encode`` gives ids as a numpy array of unsigned 32-bit numbers; ``token_bytes[i]`` are the bytes of id ``i``.

    ``source`` is the text of the tokenizer's JSON file. ``special`` says whether the strings of special tokens
    inside texts become those tokens, as is the default of ``tokenizers``. A vocabulary of another kind raises.
    """

    def __init__(self, source: str, special: bool = True):
        import tiktoken

        told = json.loads(source)
        model, before = told["model"], told["pre_tokenizer"] or {}
        if (told["normalizer"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space")
                or not before.get("use_regex") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix")):
            raise ValueError("not a plain byte-level vocabulary")
        added = {t["content"]: t["id"] for t in told["added_tokens"]}
        known, ranks = letters(), {}
        for token, i in model["vocab"].items():
            if token not in added:
                ranks[bytes(known[c] for c in token)] = i
        merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if any(a >= b for a, b in zip(merged, merged[1:])) or len(ranks) != 256 + len(merged) or min(merged, default=256) < 256:
            raise ValueError("the merges do not make the ids in their order")
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)
        self.allowed = "all" if special else set()
        self.token_bytes = [b""] * (1 + max([*ranks.values(), *added.values()]))
        for token, i in ranks.items():
            self.token_bytes[i] = token
        for token, i in added.items():
            self.token_bytes[i] = token.encode()

    def encode(self, text: str):
        return self.encoding.encode_to_numpy(text, allowed_special=self.allowed, disallowed_special=())
