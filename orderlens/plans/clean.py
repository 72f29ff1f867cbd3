"""Conservative cleaning of mapped order lines.

Only what is certain is repaired; doubtful values are flagged and never altered. The steps
must keep their order: filled values take part in the duplicate test, and generated order
numbers do not.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .. import vocab
from ..functions import (
    drop_nan, is_blank, main_category, normalize_status, parse_datetime, parse_number, strip,
)
from ..operators.columns import coalesce_same_named
from ..operators.joins import ROW, first_per_key, join_dimension
from ..operators.numbering import number_rows
from ..operators.staging import DENSE, stage, stage_observed

COPIES = "_copies"      # how many identical lines a kept line stands for
KEPT = "_kept"          # false for a line whose date cannot be read
_COUNT = "_n_"          # prefix of the counters behind the report
_PARSED = "_parsed_"    # prefix of values read from text cells
NO_INPUT = "no_orders_read"
_MOST_BITS = 27  # of the bits that tell lines with a repeated hash: 16 MB
_NUMBERS = ("quantity", "unit_price", "total_amount")

# Report rules in order: (step, rule).
RULES = (
    (1, "quantity_unparsed"),
    (1, "unit_price_unparsed"),
    (1, "total_amount_unparsed"),
    (1, "quantity_defaulted"),
    (2, "status_unrecognised"),
    (3, "payment_method_filled"),
    (3, "city_blank"),
    (3, "category_simplified"),
    (4, "duplicates_removed"),
    (5, "invalid_dates_removed"),
    (6, "unit_price_from_products"),
    (7, "total_amount_computed"),
    (7, "total_amount_unresolved"),
    (8, "order_id_generated"),
)


@dataclass(frozen=True)
class Cleaned:
    """Cleaned lines and the report of what was changed; both are lazy."""

    lines: DataFrame
    report: DataFrame


def _counter(rule: str) -> str:
    return _COUNT + rule


def _flag(test: Column) -> Column:
    return F.coalesce(test, F.lit(False)).cast("bigint")


def _is_text(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.StringType)


def _number(df: DataFrame, column: str) -> Column:
    if _is_text(df, column):
        return parse_number(F.col(column))
    return drop_nan(F.col(column).cast("double"))


def _visible(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in (ROW, COPIES, KEPT) and not c.startswith(_COUNT)]


def standardise_values(orders: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """Steps 1-3: numbers, status text, payment method, city and category.

    Each rule that needs the raw value leaves a 0/1 counter column for the report.
    """
    df = coalesce_same_named(orders)
    numbers = [c for c in (*_NUMBERS, "is_anomaly") if c in df.columns]
    # A projection of its own, so that each parsed value is computed once.
    parsed = {_PARSED + c: _number(df, c) for c in numbers}
    if "category" in df.columns:
        parsed[_PARSED + "category"] = main_category(F.col("category"))
    df = df.withColumns(parsed)

    def value(name: str) -> Column:
        return F.col(_PARSED + name) if name in numbers else F.lit(None).cast("double")

    columns: dict[str, Column] = {}
    for name in _NUMBERS:
        if name in numbers:
            columns[name] = value(name)
            columns[_counter(f"{name}_unparsed")] = _flag(F.col(name).isNotNull() & value(name).isNull())
    columns["quantity"] = F.coalesce(value("quantity"), F.lit(1.0))
    columns[_counter("quantity_defaulted")] = _flag(value("quantity").isNull())
    columns["is_anomaly"] = F.coalesce(value("is_anomaly"), F.lit(0.0))
    if "status" in df.columns:
        columns["status"] = strip(F.coalesce(F.col("status").cast("string"), F.lit(vocab.UNKNOWN_LABEL)))
    if "payment_method" in df.columns:
        blank = is_blank(F.col("payment_method"))
        columns["payment_method"] = F.when(blank, F.lit(vocab.UNKNOWN_LABEL)).otherwise(F.col("payment_method"))
        columns[_counter("payment_method_filled")] = _flag(blank)
    if "category" in df.columns:
        original = strip(F.coalesce(F.col("category"), F.lit("")))
        columns["category"] = F.col(_PARSED + "category")
        columns[_counter("category_simplified")] = _flag(original != F.col(_PARSED + "category"))
    df = df.withColumns(columns).drop(*parsed)
    return fill_city(df, users)


def fill_city(df: DataFrame, users: DataFrame | None) -> DataFrame:
    """A blank city takes the city of the user's first entry in the user table, if any."""
    if "city" not in df.columns:
        return df
    blank = is_blank(F.col("city"))
    city = F.col("city")
    if users is not None and {"user_id", "city"} <= set(users.columns) and "user_id" in df.columns:
        cities = first_per_key(users, "user_id", "city").select(
            F.col("user_id").alias("_lookup"), F.col("city").alias("_city"))
        looked_up = join_dimension(
            df.withColumn("_lookup", F.when(blank, F.col("user_id"))), cities, "_lookup"
        )
        df = looked_up.withColumn("_filled", F.when(blank, F.col("_city")).otherwise(city)).withColumn(
            _counter("city_blank"), _flag(blank)
        ).withColumn("city", F.col("_filled")).drop("_lookup", "_city", "_filled")
    return df.withColumn("city", F.when(blank, F.lit(vocab.UNKNOWN_LABEL)).otherwise(F.col("city")))


def _repeated(lines: DataFrame, cell_of: Column) -> DataFrame:
    """Bits of the cells that more than one line falls into: ``_part, _bits``, a broadcast of bounded size.

    ``cell_of`` is a hash. Its range is cut to 16 cells for each hash that comes twice, and to 2 ** _MOST_BITS at most; then more
    lines share a cell with others.
    """
    twice = stage(lines.groupBy(cell_of.alias("hash")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("hash"), "repeated")
    bits = max(15, min(_MOST_BITS, (16 * twice.count()).bit_length()))
    cell = F.col("hash").bitwiseAND((1 << bits) - 1)
    parts = twice.groupBy(F.bitmap_bucket_number(cell).alias("_part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(cell)).alias("_bits"))
    parts = stage(parts, "repeated-bits")
    own = cell_of.bitwiseAND((1 << bits) - 1)
    marked = lines.withColumns({"_part": F.bitmap_bucket_number(own), "_at": F.bitmap_bit_position(own)})
    byte = F.conv(F.hex(F.substring("_bits", (F.shiftright("_at", 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    shared = F.coalesce(F.getbit(byte, F.col("_at").bitwiseAND(7).cast("int")) == 1, F.lit(False))
    return marked.join(F.broadcast(parts), "_part", "left").withColumn("_shared", shared).drop("_part", "_at", "_bits")


def remove_duplicates(df: DataFrame) -> DataFrame:
    """Step 4: keep the first of identical lines, comparing every source column.

    The lines are written once, and only a hash of each is shuffled: a line whose hash no other line has is the only one of
    its kind. The others are compared in full by one hash aggregation, in which copies collapse before the shuffle, whatever
    their number. The counters of the copies are added up on the way, so the report needs no second pass.
    """
    counters = [c for c in df.columns if c.startswith(_COUNT)]
    keys = [c for c in _visible(df) if c not in ("is_anomaly", "status_norm")]
    totals = [F.sum(c).alias(c) for c in counters] + [F.count(F.lit(1)).alias(COPIES)]
    if ROW in df.columns:
        first = [F.min_by("is_anomaly", ROW).alias("is_anomaly"), F.min(ROW).alias(ROW)]
    else:
        first = [F.min("is_anomaly").alias("is_anomaly")]
    order = [*keys, "is_anomaly", *([ROW] if ROW in df.columns else []), *counters, COPIES]
    written = stage(df.select(*[c for c in order if c != COPIES]), "valued", DENSE)
    # A hash takes no account of where the nulls are; columns that cannot be hashed only make more lines alike.
    plain = [F.col(f"`{c}`") for c in keys if "map<" not in (kind := dict(df.dtypes)[c]) and "variant" not in kind]
    hashed = F.xxhash64(*plain, *[c.isNull() for c in plain]) if plain else F.lit(0).cast("bigint")
    lines = _repeated(written, hashed)
    alone = lines.filter("NOT _shared").withColumn(COPIES, F.lit(1).cast("bigint"))
    several = lines.filter("_shared").groupBy(*keys).agg(*first, *totals)
    return alone.select(order).unionAll(several.select(order))


def normalise_statuses(df: DataFrame) -> DataFrame:
    """Add the standard status; an export without a status column counts as completed."""
    if "status" not in df.columns:
        return df.withColumns({"status": F.lit(vocab.NO_STATUS_LABEL), "status_norm": F.lit("completed")})
    df = df.withColumn("status_norm", normalize_status(F.col("status")))
    copies = F.col(COPIES) if COPIES in df.columns else F.lit(1)
    return df.withColumn(
        _counter("status_unrecognised"), _flag(F.col("status_norm") == "unknown") * copies
    )


def parse_dates(df: DataFrame, year: int | None = None) -> DataFrame:
    """Step 5: read the order date; a line whose date cannot be read is marked as not kept."""
    if "order_date" not in df.columns:
        return df.withColumn(KEPT, F.lit(True))
    parsed = parse_datetime(F.col("order_date"), df.schema["order_date"].dataType, year)
    df = df.withColumn("order_date", parsed)
    return df.withColumns({
        KEPT: F.col("order_date").isNotNull(),
        _counter("invalid_dates_removed"): _flag(F.col("order_date").isNull()),
    })


def fill_prices(df: DataFrame, products: DataFrame | None = None) -> DataFrame:
    """Step 6: a missing unit price takes the price of the product's first entry."""
    if "unit_price" not in df.columns:
        df = df.withColumn("unit_price", F.lit(None).cast("double"))
    if products is None or not {"product_id", "price"} <= set(products.columns) \
            or "product_id" not in df.columns:
        return df
    prices = first_per_key(products, "product_id", "price")
    prices = prices.select(F.col("product_id").alias("_lookup"), _number(prices, "price").alias("_price"))
    missing = F.col("unit_price").isNull()
    found = join_dimension(df.withColumn("_lookup", F.when(missing, F.col("product_id"))), prices, "_lookup")
    return found.withColumn(
        _counter("unit_price_from_products"), _flag(missing & F.col("_price").isNotNull() & F.col(KEPT))
    ).withColumn("unit_price", F.coalesce("unit_price", "_price")).drop("_lookup", "_price")


def fill_amounts(df: DataFrame) -> DataFrame:
    """Step 7: only a missing amount is computed; an amount of zero stays zero."""
    product = F.col("quantity") * F.col("unit_price")
    if "total_amount" in df.columns:
        computed = F.col("total_amount").isNull() & product.isNotNull()
        amount = F.coalesce(F.col("total_amount"), product)
    else:
        computed, amount = F.lit(True), product
    df = df.withColumns({
        "total_amount": amount,
        _counter("total_amount_computed"): _flag(computed & F.col(KEPT)),
    })
    unresolved = F.col("total_amount").isNull()
    return df.withColumns({
        "is_anomaly": F.when(unresolved, F.lit(1.0)).otherwise(F.col("is_anomaly")),
        "total_amount": F.coalesce("total_amount", F.lit(0.0)),
        _counter("total_amount_unresolved"): _flag(unresolved & F.col(KEPT)),
    })


def fill_product_ids(df: DataFrame) -> DataFrame:
    """Step 8, second part: a missing product id takes the product name."""
    name = F.col("product_name").cast("string") if "product_name" in df.columns else None
    if "product_id" not in df.columns:
        return df.withColumn("product_id", F.lit(vocab.UNKNOWN_PRODUCT_ID) if name is None else name)
    if name is None:
        return df
    product = F.col("product_id")
    return df.withColumn("product_id", F.when(is_blank(product), name).otherwise(product))


def assign_order_ids(df: DataFrame, order_by: Sequence[str] | None = None) -> DataFrame:
    """Step 8, first part: lines without an order id get ROW0000001, ROW0000002, ...

    ``order_by`` names the columns that order the lines; the source position is used if
    there is one, else all columns. Only the lines without an id are sorted and written.
    """
    order = list(order_by) if order_by else [ROW] if ROW in df.columns else _visible(df)
    if KEPT not in df.columns:
        df = df.withColumn(KEPT, F.lit(True))
    if "order_id" in df.columns:
        missing = is_blank(F.col("order_id")) & F.col(KEPT)
        order = [c for c in order if c != "order_id"] or order
    else:
        missing = F.col(KEPT)
        df = df.withColumn("order_id", F.lit(None).cast("string"))
        order = [c for c in order if c != "order_id"]
    generated = number_rows(df.filter(missing), order, "_number").withColumn(
        "order_id", F.format_string(vocab.GENERATED_ORDER_ID, F.col("_number"))
    ).withColumn(_counter("order_id_generated"), F.lit(1).cast("bigint")).drop("_number")
    given = df.filter(~missing).withColumn("order_id", F.col("order_id").cast("string")).withColumn(
        _counter("order_id_generated"), F.lit(0).cast("bigint"))
    return given.unionByName(generated)


def _plausible_quantity(positive: Column) -> Column:
    spread = F.stddev_samp(positive)
    usual = F.greatest(F.bround(F.avg(positive) + 3 * spread), F.lit(float(vocab.MIN_QUANTITY_THRESHOLD)))
    chosen = F.when((F.count(positive) >= 2) & (spread > 0), usual)
    return F.coalesce(chosen, F.lit(float(vocab.DEFAULT_QUANTITY_THRESHOLD)))


def quantity_threshold(df: DataFrame) -> Column:
    """Largest plausible quantity: mean plus three standard deviations, at least ten."""
    return df.agg(_plausible_quantity(F.when(F.col("quantity") > 0, F.col("quantity")))).scalar()


def is_abnormal(threshold: Column) -> Column:
    return F.coalesce(
        (F.col("quantity") <= 0) | (F.col("quantity") > threshold)
        | F.coalesce(F.col("unit_price") < 0, F.lit(False)) | (F.col("total_amount") < 0),
        F.lit(False),
    )


def flag_anomalies(df: DataFrame, threshold: float | None = None) -> DataFrame:
    """Step 9: mark abnormal lines. Business values are never changed."""
    limit = quantity_threshold(df) if threshold is None else F.lit(float(threshold))
    given = F.coalesce(F.col("is_anomaly").try_cast("int"), F.lit(0))
    return df.withColumn("is_anomaly", F.when(is_abnormal(limit), F.lit(1)).otherwise(given))


def _status_mask() -> Column:
    """One bit per standard status, so that an order's statuses fit one integer."""
    bit = F.lit(0)
    for position, status in enumerate(vocab.STATUS_DOMAIN):
        bit = F.when(F.col("status_norm") == status, F.lit(1 << position)).otherwise(bit)
    return F.bit_or(bit)


def _rule_rows(counts: DataFrame, rules: Sequence[tuple[int, str, str]]) -> DataFrame:
    rows = [F.struct(F.lit(step).alias("step"), F.lit(rule).alias("rule"),
                     F.coalesce(F.col(column), F.lit(0)).cast("bigint").alias("affected_rows"))
            for step, rule, column in rules]
    return counts.select(F.inline(F.array(*rows)))


def _report_totals(steps: DataFrame) -> dict[str, Column]:
    """What the report and the quantity threshold need of all lines, as aggregates over the lines before numbering."""
    totals = {rule: F.sum(_counter(rule)) for _, rule in RULES if _counter(rule) in steps.columns}
    totals["duplicates_removed"] = F.sum(F.col(COPIES) - 1)
    nameless = is_blank(F.col("order_id")) if "order_id" in steps.columns else F.lit(True)
    totals["order_id_generated"] = F.count_if(nameless & F.col(KEPT))
    totals["threshold"] = _plausible_quantity(F.when(F.col(KEPT) & (F.col("quantity") > 0), F.col("quantity")))
    return totals


def cleaning_report(totals: dict, lines: DataFrame, threshold: float) -> DataFrame:
    """Rows affected by each rule, as (step, rule, affected_rows), zero counts left out.

    ``totals`` holds what was counted while the lines were written; ``lines``, the cleaned lines, are read once.
    """
    per_order = lines.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("rows"), _status_mask().alias("mask"),
        F.count_if(is_abnormal(F.lit(threshold))).alias("abnormal"))
    found = per_order.agg(
        F.sum("rows").alias("rows"), F.count("order_id").alias("orders"),
        F.count_if(F.bit_count("mask") > 1).alias("mixed"), F.sum("abnormal").alias("abnormal"))
    several = F.col("orders") < F.col("rows")
    counts = found.select(
        *[F.when(several, F.col(c)).alias(c) for c in ("rows", "orders", "mixed")], "abnormal",
        *[F.lit(totals.get(rule) or 0).alias(rule) for _, rule in RULES])
    rules = [(step, rule, rule) for step, rule in RULES]
    return _rule_rows(counts, [
        *rules, (8, "order_lines", "rows"), (8, "distinct_orders", "orders"), (8, "mixed_status_orders", "mixed"),
        (9, "anomalies_flagged", "abnormal")]).filter("affected_rows > 0")


def _nothing_read() -> Cleaned:
    """Without a table there are no lines and no columns, and the report says so."""
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    report = spark.createDataFrame([(0, NO_INPUT, 0)], "step int, rule string, affected_rows bigint")
    return Cleaned(spark.createDataFrame([], T.StructType([])), report)


def clean_orders(orders: DataFrame | None, products: DataFrame | None = None,
                 users: DataFrame | None = None, *, threshold: float | None = None,
                 order_by: Sequence[str] | None = None, year: int | None = None) -> Cleaned:
    """Clean mapped order lines.

    The lines after removal of duplicates are written once to the shared folder, because
    the order numbers, the report and every later metric read them. The counts of the report and the quantity threshold are
    gathered while they are written. No table (None) gives
    no lines and a report of one row, NO_INPUT.
    """
    if orders is None:
        return _nothing_read()
    df = remove_duplicates(standardise_values(orders, users))
    df = parse_dates(normalise_statuses(df), year)
    df = fill_product_ids(fill_amounts(fill_prices(df, products)))
    df, totals = stage_observed(df, "clean", _report_totals(df), DENSE)
    limit = float(totals.get("threshold") or vocab.DEFAULT_QUANTITY_THRESHOLD) if threshold is None else float(threshold)
    # The counters are in the totals; the numbers need not carry them.
    df = df.drop(*[c for c in df.columns if c.startswith(_COUNT)], COPIES)
    kept = assign_order_ids(df, order_by).filter(F.col(KEPT))
    lines = flag_anomalies(kept, limit)
    hidden = [c for c in lines.columns if c.startswith(_COUNT)] + [KEPT, COPIES]
    return Cleaned(lines.drop(*hidden), cleaning_report(totals, kept, limit))
