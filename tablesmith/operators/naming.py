"""Canonical column names and profile attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesmith.functions import profiles as P
from tablesmith.operators.ordered import lookup_join
from tablesmith.session import saved

# Canonical name per concept (generic, and telecom where it differs) and known synonyms.
CANONICAL = {
    "identifier": ("customer_id", "subscriber_id"), "phone": ("phone_number", "subscriber_msisdn"),
    "account": ("account_id", None), "segment": ("customer_segment", "subscriber_segment"),
    "product_code": ("product_code", "rate_plan_code"), "currency": ("currency_code", "wallet_currency"),
    "clv": ("customer_lifetime_value", None), "loyalty": ("loyalty_tier_customer", None),
    "event_timestamp": ("event_timestamp", None), "balance_before": ("balance_before", None),
    "balance_after": ("balance_after", None), "amount": ("transaction_amount", "recharge_amount"),
}
SYNONYMS = {
    "identifier": ["customer_id", "customerid", "subscriber_id", "client_id", "account_holder_id"],
    "phone": ["phone_number", "mobile_number", "msisdn", "customer_msisdn", "subscriber_msisdn", "contact_number"],
    "account": ["account_number", "acct_id", "account_id"],
    "segment": ["customer_segment", "user_segment", "subscriber_segment", "client_segment"],
    "product_code": ["plan_code", "tariff_plan", "rate_plan_code", "product_id", "subscription_plan"],
    "currency": ["currency", "wallet_currency", "currency_code"],
    "clv": ["clv", "customer_ltv", "customer_lifetime_value"],
    "loyalty": ["loyalty_tier", "customer_loyalty_tier", "loyalty_tier_customer"],
    "event_timestamp": ["timestamp", "event_time", "trigger_timestamp", "event_timestamp"],
    "balance_before": ["balance_prior", "previous_balance", "current_balance", "balance_before"],
    "balance_after": ["new_balance", "balance_post", "post_recharge_balance", "balance_after"],
    "amount": ["topup_amount", "recharge_value", "recharge_amount", "transaction_amount", "payment_amount", "purchase_amount"],
}


def canonical_name(concept: str, industry: str | None = None) -> str:
    generic, telecom = CANONICAL[concept]
    return telecom if telecom and P.match_industry(industry) == "telecom" else generic


def alias_map(industry: str | None = None) -> dict[str, str]:
    """Synonym to canonical name within an industry."""
    return {s: canonical_name(c, industry) for c, words in SYNONYMS.items() for s in words if s != canonical_name(c, industry)}


def canonical_columns(df: DataFrame, industry: str | None = None) -> DataFrame:
    """Rename synonyms to their canonical names; when two columns end up alike the first one stays."""
    aliases, seen, kept = alias_map(industry), set(), []
    for c in df.columns:
        name = aliases.get(c.strip().lower(), c)
        if name not in seen:
            seen.add(name)
            kept.append(F.col(c).alias(name))
    return df.select(*kept)


def with_profile(df: DataFrame, country: str, industry: str) -> DataFrame:
    """Add the conventions for the row's country (GLOBAL when unknown) and industry (loosely matched, else generic).

    The tables are fixed and tiny, so they are branches of an expression and nothing is joined.
    """
    where, kind = F.col(country), F.col(industry)
    profile = P.Profile(where)
    facts = lambda name: profile.pick(lambda f: F.lit(f[name]))
    noted = P.industry_note(kind, where, 0) != P.GENERIC_NOTES[0]
    listed = P.Profile(where)
    methods = F.when(noted, _country_methods(listed)).otherwise(F.array(*[F.lit(m) for m in P.GENERIC_METHODS]))
    return df.withColumns({
        "country_name": facts("country_name"), "currency": facts("currency"), "phone_country_code": facts("phone_country_code"),
        "industry_key": P.industry_key(kind), "regulator": P.industry_note(kind, where, 0),
        "typical_denominations": P.industry_note(kind, where, 1), "payment_methods": methods,
    })


def _country_methods(profile: P.Profile):
    return profile.pick(lambda f: F.array(*[F.lit(m) for m in P.COUNTRIES[f["country_code"]]["payment_methods"]]))


# Profiles given as tables

GENERIC, ANYWHERE = "generic", "GLOBAL"
BLOCK_WORDS = 1024  # words of 64 bits in a block of a sketch
SKETCH_BLOCKS = 4096  # 32 MB


def _folded(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c.cast("string"), F.lit(""))))


def _pieces(df: DataFrame, name: str, shortest: int, longest: int) -> DataFrame:
    """Every stretch of a text with a length in the given range, a row each."""
    lengths = F.sequence(F.lit(shortest), F.least(F.lit(longest), F.length(name)))
    sized = df.filter(F.length(name) >= shortest).select(name, F.explode(lengths).alias("__n"))
    starts = F.explode(F.sequence(F.lit(1), F.length(name) - F.col("__n") + 1))
    return sized.select(name, "__n", starts.alias("__at")).select(name, F.substring(F.col(name), F.col("__at"), F.col("__n")).alias("piece"))


def _bits(value: Column) -> tuple[Column, Column]:
    """Where a value stands in a sketch: its word, and three bits of that word."""
    at = F.xxhash64(value)
    bit = lambda shift: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.shiftright(at, shift), F.lit(64)).cast("int"))
    return at, bit(40).bitwiseOR(bit(46)).bitwiseOR(bit(52))


def _among(pieces: DataFrame, values: DataFrame, name: str) -> DataFrame:
    """The pieces that are among the values, and a few others: pieces nothing equals are dropped where they are made.

    A bit sketch of the values (16 bits each, SKETCH_BLOCKS blocks of 8 KB at most) is sent to the pieces. Beyond that size
    more of the others pass; equality is left to a join.
    """
    blocks = 1
    while blocks < SKETCH_BLOCKS and blocks * BLOCK_WORDS * 4 < values.count():
        blocks *= 2
    at, mask = _bits(F.col(name))
    marks = values.select(F.pmod(at, F.lit(blocks * BLOCK_WORDS)).alias("word"), mask.alias("mask"))
    every = values.sparkSession.range(blocks * BLOCK_WORDS).select(F.col("id").alias("word"), F.lit(0).cast("bigint").alias("mask"))
    words = marks.unionByName(every).groupBy("word").agg(F.bit_or("mask").alias("mask"))
    one = F.struct(F.pmod("word", F.lit(BLOCK_WORDS)).alias("word"), "mask")
    sketch = words.groupBy(F.call_function("div", F.col("word"), F.lit(BLOCK_WORDS)).alias("__block")).agg(
        F.transform(F.array_sort(F.collect_list(one)), lambda w: w["mask"]).alias("__words"))
    at, mask = _bits(F.col("piece"))
    word = F.pmod(at, F.lit(blocks * BLOCK_WORDS))
    placed = pieces.withColumns({"__block": F.call_function("div", word, F.lit(BLOCK_WORDS)), "__word": F.pmod(word, F.lit(BLOCK_WORDS)).cast("int"), "__mask": mask})
    found = placed.join(F.broadcast(sketch), "__block")
    return found.filter(F.get("__words", F.col("__word")).bitwiseAND(F.col("__mask")) == F.col("__mask")).select(*pieces.columns)


def _spans(df: DataFrame, name: str):
    """The least and the largest length, null for an empty table."""
    return df.agg(F.min(F.length(name)).alias("least"), F.max(F.length(name)).alias("most")).first()


def resolve_names(texts: DataFrame, names: DataFrame) -> DataFrame:
    """The name each text means: itself; else the longest name inside it; else the shortest name it is inside of; ties
    go to the name first in order. Texts that mean no name are left out.

    ``texts`` (column ``text``) and ``names`` (column ``name``) are distinct, trimmed and in lower case. Containment is
    an equality join of stretches with names or texts, so the work grows with the lengths and not with texts times names.
    Each step sees only the texts the steps before left, and only stretches that a sketch lets pass are moved.
    """
    spark = texts.sparkSession
    texts, names = texts.filter("text <> ''"), saved(names.filter("name <> ''"))
    if (sizes := _spans(names, "name")).most is None:
        return spark.createDataFrame([], "text string, name string")
    texts = saved(texts.join(names.select("name", F.col("name").alias("text")), "text", "left"))
    same, texts = texts.filter("name IS NOT NULL"), texts.filter("name IS NULL").select("text")

    pieces = saved(_among(_pieces(texts, "text", sizes.least, sizes.most), names, "name"))
    inside = lookup_join(pieces, names.select(F.col("name").alias("piece"), "name"), ["piece"], "text", "inner")
    inside = saved(inside.groupBy("text").agg(F.min(F.struct((-F.length("name")).alias("by"), "name")).alias("m")).select("text", "m.name"))
    found = same.select("text", "name").unionByName(inside)

    left = saved(texts.join(inside, "text", "left_anti"))
    if (spans := _spans(left, "text")).most is None:
        return found
    pieces = saved(_among(_pieces(names, "name", spans.least, min(spans.most, sizes.most)), left, "text"))
    around = lookup_join(pieces, left.select(F.col("text").alias("piece"), "text"), ["piece"], "name", "inner")
    around = around.groupBy("text").agg(F.min(F.struct(F.length("name").alias("by"), "name")).alias("m")).select("text", "m.name")
    return found.unionByName(around)


def with_profile_table(df: DataFrame, profiles: DataFrame, country: str, industry: str, spread: str) -> DataFrame:
    """Add ``industry_key`` and the attributes of a table of profiles (columns ``industry``, ``country``, and any others).

    A row takes the first profile there is of: its industry in its country, its industry anywhere, the generic industry
    in its country, the generic one anywhere (``country`` null or GLOBAL, ``industry`` null or generic); without any, the
    attributes are null. Industries are named loosely (``resolve_names``). Names are resolved and profiles chosen once for
    every different pair of values; the table then meets the pairs in one join that spreads the rows of a frequent pair by ``spread``.
    """
    attributes = [c for c in profiles.columns if c not in ("industry", "country")]
    if clash := sorted({*attributes, "industry_key"} & set(df.columns)):
        raise ValueError(f"columns {clash} are in the table already")
    code = lambda c: F.coalesce(F.nullif(F.upper(F.trim(c)), F.lit("")), F.lit(ANYWHERE))
    name = lambda c: F.coalesce(F.nullif(_folded(c), F.lit("")), F.lit(GENERIC))
    known = profiles.select(name(F.col("industry")).alias("__industry"), code(F.col("country")).alias("__country"), F.struct(*attributes).alias("__facts"))
    if twice := known.groupBy("__industry", "__country").count().filter("count > 1").limit(1).collect():
        raise ValueError(f"several profiles of {twice[0][0]!r} in {twice[0][1]!r}")

    placed = df.withColumns({"__text": name(F.col(industry)), "__code": code(F.col(country))})
    pairs = saved(placed.groupBy("__text", "__code").agg(F.count(F.lit(1)).alias("__rows")))
    names = known.select(F.col("__industry").alias("name")).filter(F.col("name") != GENERIC).distinct()
    meant = resolve_names(pairs.select(F.col("__text").alias("text")).filter(F.col("text") != GENERIC).distinct(), names)
    keyed = lookup_join(pairs.select("__text", "__code"), meant.withColumnRenamed("text", "__text"), ["__text"], "__code")
    keyed = saved(keyed.withColumn("industry_key", F.coalesce("name", F.lit(GENERIC))).drop("name"))
    first = lookup_join(keyed, known.toDF("industry_key", "__code", "__0"), ["industry_key", "__code"], "__text")
    own = lookup_join(first, known.filter(F.col("__country") == ANYWHERE).select(F.col("__industry").alias("industry_key"), F.col("__facts").alias("__1")), ["industry_key"], "__text")
    generic = known.filter(F.col("__industry") == GENERIC)
    third = lookup_join(own, generic.select(F.col("__country").alias("__code"), F.col("__facts").alias("__2")), ["__code"], "__text")
    tried = third.join(F.broadcast(generic.filter(F.col("__country") == ANYWHERE).select(F.col("__facts").alias("__3"))), F.lit(True), "left")
    chosen = tried.select("__text", "__code", F.struct("industry_key", F.coalesce("__0", "__1", "__2", "__3").alias("__facts")).alias("__chosen"))
    out = lookup_join(placed, chosen, ["__text", "__code"], spread, counts=pairs)
    return out.select(*df.columns, "__chosen.industry_key", *[F.col(f"__chosen.__facts.{a}").alias(a) for a in attributes])
