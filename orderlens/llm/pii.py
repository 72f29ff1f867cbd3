"""Personal data by rules and boosted trees: spans of e-mail addresses, IP addresses, cards and phone numbers.

Strict rules give the base spans. Wider generators propose further, overlapping candidates (spaced or written-out
addresses, numbers with other separators or without a plus). Gradient-boosted trees judge every candidate by its
format and the words around it, and a threshold per kind, calibrated on examples held out of the
fit, decides. All work on texts is done by SQL functions; the trees, fitted on the driver, become a SQL expression.

The trees are trained here on examples made from templates: personal data as written in English, German, French and
Spanish, and look-alikes (dates, versions, order numbers, amounts) in neutral and telling context. EXAMPLES bounds their number.
The work on a text grows with its length and its spans, not with their square: positions, overlaps and choices come from
prefixes over arrays of spans.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import boosting
from .columns import by_position

KINDS = ("email", "ip", "card", "phone")
EXAMPLES = 4800
PRECISION = 0.99

# The base patterns of the contract. Possessive repeats and the start conditions change no match: they
# keep a failing or very long run of characters from being read again from each of its characters.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDE = {
    "email": r"(?<![\p{L}0-9._%+-])[\p{L}0-9._%+-]++ ?(?:@|[(\[]at[)\]]) ?[\p{L}0-9-]++(?:(?:\.| ?[(\[]dot[)\]] ?)[\p{L}0-9-]++)++",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?: ?[.:] ?[0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[ ./_-]{0,3}[0-9]){12,18}(?![0-9])",
    "phone": r"(?<![0-9+])\(?[0-9](?:[ ()./-]{0,3}[0-9]){6,14}(?![0-9])",
}
_TELLING = {
    "email": "mail|contact|write|schreib|correo|courriel|kontakt|escrib|écri",
    "ip": "address|server|host|login|ip|adresse|dirección|serveur",
    "card": "card|visa|credit|karte|tarjeta|carte|pay|zahl|pago",
    "phone": "phone|call|tel|mobile|fax|ruf|appel|llam|handy|mobil|móvil|portable|whatsapp",
}
_MISLEADING = "version|build|release|order|invoice|total|price|isbn|date|section|chapter|model|bestell|rechnung|datum|kapitel|pedido|factura|fecha|commande|facture|page|seite"
_AROUND = 24
_CHUNK = 128
_FAR = 2 ** 31 - 1


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once per row, not once for every element of an array."""
    return F.get(F.transform(F.array(value), use), 0)


def _prefix(values: Column, zero: int, combine) -> Column:
    """For every number of an array what ``combine`` makes of those before it.

    Spark copies the state of an aggregate at every step, so a state that held all results would cost their square. Chunks
    are aggregated one by one, then their totals, and each chunk starts from what lies before it.
    """
    def running(some):
        begin = F.struct(F.lit(zero).alias("at"), F.array().cast("array<int>").alias("seen"))
        return F.aggregate(some, begin, lambda state, value: F.struct(
            combine(state["at"], value).alias("at"), F.concat(state["seen"], F.array(state["at"])).alias("seen")))

    def whole(values):
        last = F.floor((F.size(values) - 1) / _CHUNK).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda c: running(F.slice(values, c * _CHUNK + 1, F.lit(_CHUNK))))

    def joined(chunks):
        before = running(F.transform(chunks, lambda c: c["at"]))["seen"]
        return F.flatten(F.zip_with(before, chunks, lambda at, c: F.transform(c["seen"], lambda x: combine(at, x))))

    return _let(values, lambda v: F.when(F.size(v) > 0, _let(whole(v), joined)).otherwise(F.array().cast("array<int>")))


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """The check digit of a string of digits is right."""
    def value(i):
        digit = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        doubled = digit * 2
        return F.when(i % 2 == 0, F.when(doubled > 9, doubled - 9).otherwise(doubled)).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda total, i: total + value(i)) % 10 == 0


def _valid(kind: str, found: Column) -> Column:
    digits = F.length(_digits(found))
    if kind == "card":
        return F.when(digits.between(13, 19), luhn(_digits(found))).otherwise(False)
    if kind == "phone":
        return digits.between(9, 15)
    if kind == "ip":
        def small(part):
            short = F.regexp_replace(part, "^0+", "")
            return F.when(F.length(short) > 3, False).otherwise(F.coalesce(short.try_cast("int"), F.lit(0)) <= 255)
        return F.forall(F.split(found, r"\."), small)
    return F.lit(True)


def _matches(text: Column, pattern: str, around: bool) -> Column:
    """``start, end, found`` of all matches, leftmost first and non-overlapping; ``around`` adds what stands ``before`` and ``after``.

    The text between the matches gives their positions and their surroundings.
    """
    cut = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps"))

    def beside(row, i, first: int, last: int):
        """Gaps and matches between, from the gap before match ``i`` plus ``first`` to the one plus ``last``."""
        parts = []
        for k in range(first, last + 1):
            parts += [F.get(row["gaps"], i + k)] + ([F.get(row["found"], i + k)] if k < last else [])
        return F.concat_ws("", *parts)

    def of(row):
        steps = F.transform(row["found"], lambda m, i: F.length(F.get(row["gaps"], i)) + F.length(m))
        pairs = F.zip_with(row["found"], _prefix(steps, 0, lambda a, b: a + b), lambda m, at: F.struct(m.alias("found"), at.alias("at")))

        def one(pair, i):
            start = pair["at"] + F.length(F.get(row["gaps"], i))
            before, after = F.lit(""), F.lit("")
            if around:
                before = F.lower(F.right(beside(row, i, -1, 0), F.lit(_AROUND)))
                after = F.lower(F.left(beside(row, i, 1, 2), F.lit(_AROUND)))
            return F.struct(start.alias("start"), (start + F.length(pair["found"])).alias("end"), pair["found"].alias("found"),
                            before.alias("before"), after.alias("after"))

        return F.transform(pairs, one)

    return _let(cut, of)


def _spans(text: Column, patterns: dict, around: bool) -> Column:
    """``kind, start, end, found, before, after`` of all kinds, in the order of KINDS; kinds are numbers."""
    none = F.array().cast("array<struct<kind:int,start:int,end:int,found:string,before:string,after:string>>")

    def of(number: int, kind: str) -> Column:
        if kind == "email":
            could = text.rlike(r"[@(\[]")
        elif kind == "phone" and patterns is BASE:
            could = F.contains(text, F.lit("+"))
        else:
            could = text.rlike("[0-9][^0-9]?[^0-9]?[^0-9]?[0-9]")
        return F.when(could, F.transform(_matches(text, patterns[kind], around), lambda m: F.struct(
            F.lit(number).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["found"].alias("found"),
            m["before"].alias("before"), m["after"].alias("after")))).otherwise(none)

    return F.concat(*[of(number, kind) for number, kind in enumerate(KINDS)])


def base_spans(text: Column) -> Column:
    def valid(s):
        right = F.lit(True)
        for number, kind in enumerate(KINDS):
            right = F.when(s["kind"] == number, _valid(kind, s["found"])).otherwise(right)
        return right

    return F.transform(F.filter(_spans(text, BASE, False), valid), lambda s: F.struct(s["kind"], s["start"], s["end"]))


def _candidates(text: Column, base: Column) -> Column:
    """Candidates that overlap no base span, by start, with the words around them.

    A span in the order of starts overlaps a base span before it if one of these ends after its start, and one after it if
    one of those starts before its end: one sweep forth and one back tell both.
    """
    own = F.transform(base, lambda s: F.struct(s["start"], s["end"], F.lit(False).alias("own"), s["kind"], F.lit("").alias("found"),
                                               F.lit("").alias("before"), F.lit("").alias("after")))
    wide = F.transform(_spans(text, WIDE, True), lambda s: F.struct(
        s["start"], s["end"], F.lit(True).alias("own"), s["kind"], s["found"], s["before"], s["after"]))

    def free(spans):
        furthest = _prefix(F.transform(spans, lambda s: F.when(s["own"], F.lit(-1)).otherwise(s["end"])), -1, F.greatest)
        starts = F.transform(spans, lambda s: F.when(s["own"], F.lit(_FAR)).otherwise(s["start"]))
        nearest = F.reverse(_prefix(F.reverse(starts), _FAR, F.least))
        ends = F.zip_with(furthest, nearest, lambda f, n: F.struct(f.alias("furthest"), n.alias("nearest")))
        clear = F.zip_with(spans, ends, lambda s, e: F.struct(
            s.alias("s"), (s["own"] & (e["furthest"] <= s["start"]) & (e["nearest"] >= s["end"])).alias("clear")))
        return F.transform(F.filter(clear, lambda c: c["clear"]), lambda c: c["s"])

    return _let(F.array_sort(F.concat(own, wide)), free)


def _features(c: Column) -> list[Column]:
    number, digits = (lambda x: x.cast("double")), _digits(c["found"])
    groups = F.split(c["found"], "[^0-9]+")
    telling = F.lit(False)
    for i, kind in enumerate(KINDS):
        telling = F.when(c["kind"] == i, c["before"].rlike(rf"(?<!\p{{L}})(?:{_TELLING[kind]})")).otherwise(telling)
    return [
        *[number(c["kind"] == i) for i in range(len(KINDS))],
        number(F.length(digits)), number(F.length(c["found"])), number(F.size(groups)),
        number(F.array_max(F.transform(groups, F.length))), number(F.array_min(F.transform(groups, F.length))),
        number(F.when(F.length(digits) >= 12, luhn(digits)).otherwise(False)),
        number(F.forall(groups, lambda g: (F.length(g) <= 3) & (F.coalesce(g.try_cast("int"), F.lit(0)) <= 255))),
        number(F.contains(c["found"], F.lit("."))), number(F.contains(c["found"], F.lit("("))), number(F.contains(c["found"], F.lit("@"))),
        number(F.contains(c["found"], F.lit(":"))), number(F.contains(c["found"], F.lit("/"))), number(c["found"].rlike(r"\.[a-z]{2,}$")),
        number(c["found"].rlike(r"^(?:19|20)[0-9]{2}[^0-9]")), number(c["found"].rlike(r"[^0-9](?:19|20)[0-9]{2}$")),
        number(telling), number(c["before"].rlike(rf"(?<!\p{{L}})(?:{_MISLEADING})")),
        number(c["found"].rlike(r"^\(?0")), number(c["found"].rlike("^00")),
        number(F.length(F.get(groups, F.lit(0)))), number(F.length(F.element_at(groups, -1))),
        number(c["before"].rlike(r"[\p{L}0-9#$€._-]$")), number(c["after"].rlike(r"^[\p{L}0-9%€$_-]")),
    ]


def _feature_array(c: Column) -> Column:
    return F.array(*_features(c))


def examples(count: int = EXAMPLES, seed: int = 11) -> list[tuple[str, int, int, int]]:
    """Texts with one marked span and whether it is personal data: ``text, start, end, label``."""
    draw = random.Random(seed)
    digits = lambda n: "".join(draw.choice("0123456789") for _ in range(n))
    word = lambda: "".join(draw.choice(["an", "er", "on", "th", "li", "ma", "do", "re", "sa", "ti"]) for _ in range(draw.randint(1, 4)))

    def checked(number):
        return sum(int(d) if i % 2 == 0 else int(d) * 2 - 9 * (int(d) > 4) for i, d in enumerate(reversed(number))) % 10 == 0

    def unlike(make):
        """A number whose check digit is wrong."""
        while checked("".join(filter(str.isdigit, found := make()))):
            pass
        return found

    def card():
        body = draw.choice("3456") + digits(14)
        lengths = (4, 6, 5) if body[0] == "3" else (4, 4, 4, 4)
        body = body[:sum(lengths) - 1]
        whole = next(body + d for d in "0123456789" if checked(body + d))
        mark = draw.choice(["", ".", "/", "_", "  ", " - ", "-", " "])
        return mark.join(whole[sum(lengths[:i]):sum(lengths[:i + 1])] for i in range(len(lengths)))

    def filled(form):
        """A form in which every # is a digit."""
        return "".join(digits(1) if c == "#" else c for c in form)

    def email():
        at, dot = draw.choice([("@", "."), (" @ ", "."), ("(at)", "."), ("[at]", "[dot]"), (" (at) ", " (dot) "), (" (at) ", "."), (" [at] ", ".")])
        return f"{word()}{draw.choice(['.', '_', '-', ''])}{word()}{at}{word()}{dot}{draw.choice(['com', 'org', 'net', 'de', 'es', 'fr', 'co', 'io', 'eu'])}"

    octet = lambda: str(draw.randint(1, 254))
    month, day = (lambda: f"{draw.randint(1, 12):02d}"), (lambda: f"{draw.randint(1, 28):02d}")
    year = lambda: f"{draw.choice(['19', '20'])}{digits(2)}"
    # English, German, French and Spanish ways of writing a number, then without any mark.
    calls = ["(###) ###-####", "### ### ####", "###-###-####", "###.###.####", "1-###-###-####",
             "0## ########", "0### #######", "0##/#######", "0### / ### ####", "(0##) ######", "0049 ## ######", "0049 ### #######",
             "0# ## ## ## ##", "0#.##.##.##.##", "0033 # ## ## ## ##", "6## ## ## ##", "9## ### ###", "0034 ### ### ###", "##########", "0##########"]
    numbers = ["####-####", "########", "##########", "############", "#.###.###", "##.###.###", "###-##-##-##", "## ## ## ##", "978-#-##-######-#",
               "##.#.#.####", "####/#####", "#-#-#-#-#-#-#", "#############", "####.######.#####", "#### ###### #####", "###############", "#### #### ####", "#.## #.## #.##"]
    real = {
        "email": email,
        "ip": lambda: draw.choice([".", " . ", ":"]).join(octet() for _ in range(4)),
        "card": card,
        "phone": lambda: filled(draw.choice(calls)),
    }
    alike = {
        "email": lambda: f"{word()} (at) {word()}.{digits(2)}" if draw.random() < 0.5 else f"{word()}@{digits(2)}.{digits(1)}",
        "ip": lambda: ".".join(str(draw.choice([draw.randint(0, 40), draw.randint(256, 999)])) for _ in range(3)) + f".{digits(3)}" if draw.random() < 0.6 else ":".join(f"{draw.randint(0, 59):02d}" for _ in range(4)),
        "card": lambda: unlike(lambda: draw.choice([digits(draw.randint(13, 19)), filled("#### #### #### ####"), filled("####.######.#####"), filled("978-#-##-######-#"), " ".join(digits(draw.randint(1, 2)) for _ in range(13))])),
        "phone": lambda: draw.choice([f"{year()}-{month()}-{day()}", f"{day()}.{month()}.{year()}", f"{day()}/{month()}/{year()}", f"{year()}-{year()}",
                                      f"{year()}-{month()}-{day()} {digits(2)}", " ".join(str(draw.randint(1, 99)) for _ in range(7)), *map(filled, numbers)]),
    }
    made = []
    for i in range(count):
        kind, label = (*KINDS, "phone", "phone")[i % 6], draw.random() < 0.5
        found = (real if label else alike)[kind]()
        bare = kind == "phone" and found.isdigit()  # only the words around tell a number without marks from others
        telling = draw.choice(_TELLING[kind].split("|")) if draw.random() < (1 if label and bare else 0.5 if label else 0 if bare else 0.1) else word()
        if not label and draw.random() < 0.5:
            telling = draw.choice(_MISLEADING.split("|"))
        if kind == "ip" and label and draw.random() < 0.9:
            telling = draw.choice(_TELLING["ip"].split("|"))
        before = f"{word()} {word()} {telling} "
        made.append((f"{before}{found} {word()} {word()}.", len(before), len(before) + len(found), int(label)))
    return made


def _flat(root, depth: int) -> tuple[list[int], list[float], list[float]]:
    """A fitted tree filled up to ``depth``: 1-based features and thresholds of its splits and values of its leaves, level by level.

    The children of split i are 2i + 1 and 2i + 2. A leaf above the last level stands for all leaves below it.
    """
    features, thresholds, level = [], [], [root]
    for _ in range(depth):
        below = []
        for node in level:
            inner = hasattr(node, "split")
            split = node.split() if inner else None
            features.append(split.featureIndex() + 1 if inner else 1)
            thresholds.append(split.threshold() if inner else 0.0)
            below += [node.leftChild(), node.rightChild()] if inner else [node, node]
        level = below
    return features, thresholds, [node.prediction() for node in level]


def _numbers(values: list, kind: str) -> Column:
    """Many fixed numbers as one constant, whose text the optimizer reads once."""
    texts = F.split(F.lit(",".join(map(repr, values))), ",") if values else F.array()
    return texts.cast(f"array<{kind}>")


class Model:
    """Boosted trees and a threshold per kind. ``score`` maps a column of features to a probability."""

    def __init__(self, spark: SparkSession, *, trees: int = 20, depth: int = 5):
        made = spark.createDataFrame(examples(), "text string, start int, end int, label int")
        one = F.explode(F.filter(_candidates(F.col("text"), F.array().cast("array<struct<kind:int,start:int,end:int>>")), lambda c: (c["start"] == F.col("start")) & (c["end"] == F.col("end"))))
        rows = made.select("text", "label", one.alias("c"))
        rows = rows.select("label", F.col("c.kind").alias("kind"), _feature_array(F.col("c")).alias("features"), (F.crc32(F.col("text").cast("binary")) % 3 == 0).alias("later"))
        known = rows.filter("not later").select("features", "label").collect()  # bounded by EXAMPLES
        fitted = boosting.fit([r["features"] for r in known], [r["label"] for r in known], trees=trees, depth=depth, step=0.4)
        self.depth = depth
        self.trees = [(weight, _flat(root, depth)) for weight, root in fitted]
        held = rows.filter("later").select("kind", "label", self.score(F.col("features")).alias("score")).collect()
        self.thresholds = [self._threshold([(r["score"], r["label"]) for r in held if r["kind"] == k]) for k in range(len(KINDS))]

    def score(self, features: Column) -> Column:
        # The plan holds the trees as numbers, not a condition for every split: the code for those outgrows a Java method.
        splits = 2 ** self.depth - 1
        at_split, limits, leaves = (_numbers([v for _, flat in self.trees for v in flat[i]], kind)
                                    for i, kind in enumerate(("int", "double", "double")))

        def leaf(tree):
            def down(at, _):
                left = F.element_at(features, F.get(at_split, tree * splits + at)) <= F.get(limits, tree * splits + at)
                return at * 2 + F.when(left, 1).otherwise(2)
            last = F.aggregate(F.array_repeat(F.lit(0), self.depth), F.lit(0), down)
            return F.get(leaves, tree * (splits + 1) + last - splits)

        weights = _numbers([w for w, _ in self.trees], "double")
        margin = F.aggregate(F.sequence(F.lit(0), F.lit(len(self.trees) - 1)), F.lit(0.0),
                             lambda total, tree: total + F.get(weights, tree) * leaf(tree))
        return 1 / (1 + F.exp(-2 * margin))

    @staticmethod
    def _threshold(held: list[tuple[float, int]]) -> float:
        """The lowest score from which on the share of personal data is PRECISION; never below one half."""
        held, lowest, right = sorted(held, reverse=True), 2.0, 0
        for n, (score, label) in enumerate(held, 1):
            right += label
            if right >= PRECISION * n and (n == len(held) or held[n][0] < score):
                lowest = score
        return max(lowest, 0.5)


def _added(scored: Column) -> Column:
    """Of candidates in the order of their starts, those that overlap none with a higher score that is accepted itself.

    Candidates fall into clusters that do not touch each other; each cluster decides by itself.
    """
    none = F.array().cast("array<struct<kind:int,start:int,end:int>>")

    def best(cluster):
        order = F.array_sort(F.transform(cluster, lambda c: F.struct((-c["score"]).alias("rank"), c["kind"], c["start"], c["end"])))

        def step(taken, c):
            overlaps = F.exists(taken, lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"]))
            return F.when(overlaps, taken).otherwise(F.concat(taken, F.array(F.struct(c["kind"], c["start"], c["end"]))))

        return F.aggregate(order, none, step)

    def clusters(all_):
        reach = _prefix(F.transform(all_, lambda c: c["end"]), 0, F.greatest)
        fresh = F.zip_with(all_, reach, lambda c, r: c["start"] >= r)
        begins = F.filter(F.transform(fresh, lambda f, i: F.when(f, i)), lambda i: i.isNotNull())
        return F.flatten(_let(begins, lambda at: F.transform(at, lambda b, i: best(
            F.slice(all_, b + 1, F.coalesce(F.get(at, i + 1), F.size(all_)) - b)))))

    return F.when(F.size(scored) > 0, _let(scored, clusters)).otherwise(none)


def find(docs: DataFrame, model: Model, *, text: str = "text", base: str = "base", spans: str = "spans") -> DataFrame:
    """Add two columns: the ``base`` spans and all ``spans`` of every row's whole text.

    Both are arrays of ``kind`` (a number in the order of KINDS), ``start`` and ``end`` in code points, end exclusive,
    ordered by kind and start. Base spans always stay; added ones overlap none of them. A null or empty text
    has none. Rows are judged where they lie, copies each; an empty table gives an empty table. Other columns pass through
    whatever their names; a column called like ``base`` or ``spans`` is replaced.
    """
    inner, at = by_position(docs)
    body = F.coalesce(F.col(at[text]), F.lit(""))
    found = inner.withColumn("_base", base_spans(body)).withColumn("_candidates", _candidates(body, F.col("_base")))
    found = found.withColumn("_scored", F.transform(
        "_candidates", lambda c: F.struct(c["kind"], c["start"], c["end"], _feature_array(c).alias("features"))))
    found = found.withColumn("_scored", F.transform(
        "_scored", lambda c: F.struct(c["kind"], c["start"], c["end"], model.score(c["features"]).alias("score"))))
    limits = F.array(*[F.lit(t) for t in model.thresholds])
    chosen = F.filter("_scored", lambda c: c["score"] >= F.get(limits, c["kind"]))
    every = F.array_sort(F.concat(F.col("_base"), _added(chosen)))
    found = found.withColumn("_spans", F.when(F.size("_scored") > 0, every).otherwise(F.col("_base")))
    return found.select(*[F.col(at[c]).alias(c) for c in docs.columns if c not in (base, spans)],
                        F.col("_base").alias(base), F.col("_spans").alias(spans))


def written(spans: Column) -> Column:
    """``kind:start:end``, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with every span, overlaps counted once, replaced by its kind in brackets."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    by_start = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["end"], s["kind"])))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(state, s):
        parts = F.concat(state["parts"], F.array(F.substring(text, state["at"] + 1, s["start"] - state["at"]), F.get(names, s["kind"])))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"),
                        F.when(s["start"] < state["at"], state["parts"]).otherwise(parts).alias("parts"))

    def whole(state):
        return F.concat(F.array_join(state["parts"], ""), F.substring(text, state["at"] + 1, F.length(text)))

    return F.when(F.size(spans) > 0, F.aggregate(by_start, begin, step, whole)).otherwise(text)
