"""Cleaning, projection, filter and validation operators.

All operators are ``DataFrame -> DataFrame`` and compose lazily; filters sit
directly above the scan so Catalyst pushes them into Parquet.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import encode as E


class SchemaError(ValueError):
    """Raised when required columns are missing."""


def missing_columns(df: DataFrame, required: Iterable[str]) -> list[str]:
    """Required columns that the frame lacks (in the order given)."""
    have = set(df.columns)
    return [c for c in required if c not in have]


def require_columns(df: DataFrame, required: Iterable[str]) -> DataFrame:
    missing = missing_columns(df, required)
    if missing:
        raise SchemaError(f"missing required columns: {missing}")
    return df


def drop_columns(df: DataFrame, columns: Sequence[str], missing: str = "error") -> DataFrame:
    """Projection by a configured drop list.

    ``missing="error"`` fails like the reference when a listed column is
    absent; ``"ignore"`` drops only the present ones.
    """
    if missing == "error":
        require_columns(df, columns)
    present = [c for c in columns if c in df.columns]
    return df.drop(*present)


def derive_age(df: DataFrame, as_of_year: int, year_col: str = "yearOfRegistration") -> DataFrame:
    """P2."""
    return df.withColumn("age", E.age(year_col, as_of_year))


def drop_null_rows(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Drop rows holding a null in any (or the given) column."""
    return df.na.drop("any", subset=list(subset) if subset else None)


def cleaning_predicate(target: str = C.TARGET,
                       excluded_fuel: str = C.EXCLUDED_FUEL,
                       excluded_damage: str = C.EXCLUDED_DAMAGE) -> Column:
    """P4-P6 as one predicate (price band, power band, two exclusions)."""
    return (F.col(target).between(C.PRICE_MIN, C.PRICE_MAX)
            & (F.col("powerPS") > C.POWER_MIN_EXCLUSIVE) & (F.col("powerPS") <= C.POWER_MAX)
            & (F.col("fuelType") != excluded_fuel)
            & (F.col("notRepairedDamage") != excluded_damage))


def clean_listings(df: DataFrame, as_of_year: int, drop: Sequence[str] = C.COLUMNS_CLEANUP,
                   missing: str = "ignore") -> DataFrame:
    """P2 -> P3 -> P4..P6 -> P1, in the reference's order.

    The null drop runs on every source column before the projection, so a
    null in a column that is dropped afterwards still removes the row.
    """
    out = derive_age(df, as_of_year)
    out = drop_null_rows(out).where(cleaning_predicate())
    return drop_columns(out, drop, missing=missing)


def year_range(df: DataFrame, lo: int = C.YEAR_MIN, hi: int = C.YEAR_MAX,
               year_col: str = "yearOfRegistration") -> DataFrame:
    """P7."""
    return df.where(F.col(year_col).between(lo, hi))


def encode_binary(df: DataFrame) -> DataFrame:
    """Strict ``ja/nein`` and ``automatik/manuell`` codes; an unmapped
    value raises when the job runs."""
    return (df.withColumn("notRepairedDamage",
                          E.strict_code("notRepairedDamage", C.DAMAGE_CODES, "notRepairedDamage"))
              .withColumn("gearbox", E.strict_code("gearbox", C.GEARBOX_CODES, "gearbox")))


def decode_binary(df: DataFrame) -> DataFrame:
    """``1/0 -> Yes/No`` and ``Automatic/Manual``."""
    return (df.withColumn("notRepairedDamage", E.decode("notRepairedDamage", C.DAMAGE_LABELS))
              .withColumn("gearbox", E.decode("gearbox", C.GEARBOX_LABELS)))


def encode_request(df: DataFrame) -> DataFrame:
    """P10: lenient request encoding (anything but yes/automatic -> 0)."""
    return (df.withColumn("notRepairedDamage", E.lenient_flag("notRepairedDamage", "yes"))
              .withColumn("gearbox", E.lenient_flag("gearbox", "automatic")))


def translate_values(df: DataFrame) -> DataFrame:
    """German -> English fuel and body names; unmapped -> null."""
    return (df.withColumn("fuelType", E.translate("fuelType", C.FUEL_TRANSLATION))
              .withColumn("vehicleType", E.translate("vehicleType", C.BODY_TRANSLATION)))


def rename_columns(df: DataFrame, mapping: dict[str, str] | None = None,
                   reverse: bool = False) -> DataFrame:
    """camelCase <-> snake_case."""
    mapping = dict(mapping or C.RENAME_TO_STORED)
    if reverse:
        mapping = {v: k for k, v in mapping.items()}
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns and k != v})


def cast_for_import(df: DataFrame) -> DataFrame:
    """The stored listing types (strings, doubles, int year, decimal price)."""
    casts = {
        "brand": "string", "model": "string", "vehicle_type": "string",
        "fuel_type": "string", "power_ps": "double", "kilometer": "double",
        "year_of_registration": "int", "gearbox": "string",
        "not_repaired_damage": "string", "price": "decimal(12,2)",
    }
    return df.select(*[F.col(c).cast(t).alias(c) for c, t in casts.items()])


def market_listings(df: DataFrame, as_of_year: int) -> DataFrame:
    """The cleaned table behind the dashboard: clean -> encode -> decode,
    ``age`` recomputed on read."""
    return decode_binary(encode_binary(clean_listings(df, as_of_year)))


def training_listings(df: DataFrame, as_of_year: int) -> DataFrame:
    """The training table: clean with the training drop list, strict encode."""
    return encode_binary(clean_listings(df, as_of_year, drop=C.COLUMNS_TO_DROP))


# ---- request validation (P15) --------------------------------------------

REQUEST_FIELDS = list(C.REQUEST_DEFAULTS)


def with_request_defaults(df: DataFrame) -> DataFrame:
    """Missing fields take the schema defaults (``coalesce``)."""
    cols = []
    for name, default in C.REQUEST_DEFAULTS.items():
        if name in df.columns:
            cols.append(F.coalesce(F.col(name), F.lit(default)).alias(name))
        else:
            cols.append(F.lit(default).alias(name))
    rest = [c for c in df.columns if c not in C.REQUEST_DEFAULTS]
    return df.select(*rest, *cols)


def request_valid(as_of_year: int) -> Column:
    return ((F.col("powerPS") > 0) & (F.col("kilometer") > 0)
            & F.col("yearOfRegistration").between(C.REQUEST_MIN_YEAR, as_of_year))


def validate_requests(df: DataFrame, as_of_year: int) -> DataFrame:
    """Defaults then a validity flag; callers split valid/quarantine
    with ``where``.  One pass, no shuffle."""
    out = with_request_defaults(df)
    return out.withColumn("is_valid", F.coalesce(request_valid(as_of_year), F.lit(False)))


# ---- user validation (P16, J5) -------------------------------------------

def validate_users(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """Per candidate registration, the reasons it is rejected.

    * username length outside 3..50
    * username or email already registered (left-semi probes, no row blow-up)
    * username or email repeated inside the batch (grouped counts)
    """
    taken_user = existing.select(F.col("username").alias("_u")).distinct()
    taken_mail = existing.select(F.col("email").alias("_e")).distinct()
    dup_user = (candidates.groupBy("username").agg(F.count(F.lit(1)).alias("_n_user")))
    dup_mail = (candidates.groupBy("email").agg(F.count(F.lit(1)).alias("_n_mail")))
    out = (candidates
           .join(taken_user, candidates.username == taken_user._u, "left")
           .join(taken_mail, candidates.email == taken_mail._e, "left")
           .join(dup_user, "username", "left")
           .join(dup_mail, "email", "left"))
    return out.select(
        *candidates.columns,
        (~F.length("username").between(3, 50)).alias("bad_username_length"),
        F.col("_u").isNotNull().alias("username_taken"),
        F.col("_e").isNotNull().alias("email_taken"),
        (F.col("_n_user") > 1).alias("username_repeated"),
        (F.col("_n_mail") > 1).alias("email_repeated"),
    ).withColumn("is_valid", ~(F.col("bad_username_length") | F.col("username_taken")
                                | F.col("email_taken") | F.col("username_repeated")
                                | F.col("email_repeated")))


# ---- explorer (P17) -------------------------------------------------------

def explore(df: DataFrame, brands: Sequence[str] = (), fuels: Sequence[str] = (),
            vehicles: Sequence[str] = (), price_min: float | None = None,
            price_max: float | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """Optional ``isin`` filters (empty list = no filter) + price range."""
    out = df
    if brands:
        out = out.where(F.col("brand").isin(list(brands)))
    if fuels:
        out = out.where(F.col("fuelType").isin(list(fuels)))
    if vehicles:
        out = out.where(F.col("vehicleType").isin(list(vehicles)))
    if price_min is not None and price_max is not None:
        out = out.where(F.col("price").between(price_min, price_max))
    return out.select(*columns) if columns else out


def explore_counts(df: DataFrame, filtered_flag: Column) -> DataFrame:
    """"n of N": both counts in one aggregation pass."""
    return df.agg(F.count_if(filtered_flag).alias("n_shown"), F.count(F.lit(1)).alias("n_total"))
