"""Order status normalisation."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from .. import vocab
from .text import normalize_name, normalized_literal

_UNKNOWN = "unknown"
_WORDS = {
    status: sorted({normalized_literal(word) for word in words})
    for status, words in vocab.STATUS_WORDS.items()
}


def normalize_status(text: Column) -> Column:
    """Map a free-text status to one of the six standard values.

    A whole-word match decides first, by one look-up in a literal map. Only other texts are
    searched: the first status with a word contained in the text wins, so that ``退款完成``
    counts as completed.
    """
    name = normalize_name(text.cast("string"))
    entries = [F.lit(""), F.lit(_UNKNOWN)]
    for status, words in _WORDS.items():
        for word in words:
            entries += [F.lit(word), F.lit(status)]
    contained = F.lit(_UNKNOWN)
    for status, words in reversed(_WORDS.items()):
        pattern = "|".join(re.escape(word) for word in words if len(word) >= 2)
        contained = F.when(name.rlike(pattern), F.lit(status)).otherwise(contained)
    return F.coalesce(F.try_element_at(F.create_map(*entries), name), contained)
